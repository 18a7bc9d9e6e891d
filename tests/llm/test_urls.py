import datetime as dt

import duckdb

from tessera.llm import urls


def day(n):
    return dt.date(2023, 1, 1) + dt.timedelta(n)


def test_as_of_join_against_brute_force(spark):
    entries = [("example.com", 10, "add"), ("example.com", 20, "remove"), ("Bad.Example.com", 15, "add"), ("x.org", 5, "add"), ("x.org", 5, "remove"), ("y.org", 7, "remove"), ("y.org", 8, "add"), ("y.org", 9, "add"), (None, 1, "add"), ("z.org", None, "add"), ("z.org", 1, "odd")]
    captures = [(k, u, d) for k, (u, d) in enumerate((u, d) for u in ("http://example.com/a", "https://u:p@a.BAD.example.com:80/?q", "ftp://x.org", "http://y.org#f", "http://z.org", "nothing", None, "http://localhost/x", "http://notexample.com") for d in (None, 0, 9, 10, 15, 19, 20, 400))]
    got = urls.filter_captures(
        spark.createDataFrame([(k, u, None if d is None else day(d), "x") for k, u, d in captures], "page_id long, url string, day date, blocked string"),
        spark.createDataFrame([(n, None if d is None else day(d), a) for n, d, a in entries], "domain string, day date, action string"),
    ).collect()
    active = {"example.com": [(10, 20)], "bad.example.com": [(15, 999)], "y.org": [(8, 9), (9, 999)]}
    hosts = ["example.com", "a.bad.example.com", "x.org", "y.org", "z.org", "", "", "localhost", "notexample.com"]
    assert len(got) == len(captures)
    for r in got:
        _, _, d = captures[r.page_id]
        host = hosts[r.page_id // 8]
        hits = [(len(n), n, a) for n, spans in active.items() for a, b in spans if d is not None and (host == n or host.endswith("." + n)) and a <= d < b]
        assert (r.host, r.blocked) == (host, bool(hits))
        assert (r.matched_domain, r.listed_on) == ((max(hits)[1], day(max(hits)[2])) if hits else (None, None))


def test_query_equals_its_oracle(spark, sf_dir):
    got = sorted(tuple(r[c] for c in ("page_id", "host", "day", "blocked", "matched_domain", "listed_on")) for r in urls.op5_temporal_list(spark, sf_dir).collect())
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{sf_dir}/pages.parquet')")
    want = sorted(con.execute(f"select page_id, host, day, blocked, matched_domain, listed_on from ({urls.ORACLE})").fetchall())
    assert got == want and any(r[3] for r in got)


def test_empty_tables(spark):
    captures = spark.createDataFrame([(1, "http://a.b.c", day(3))], "page_id long, url string, day date")
    entries = spark.createDataFrame([("b.c", day(1), "add")], "domain string, day date, action string")
    assert not urls.filter_captures(captures, entries.limit(0)).first().blocked
    assert urls.filter_captures(captures.limit(0), entries).count() == 0
    assert urls.filter_captures(captures.union(captures), entries).where("blocked").count() == 2
