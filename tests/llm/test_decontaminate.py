import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import decontaminate as d


def plain_distance(pattern, text):
    """Least edit distance of the pattern to any substring, by dynamic programming."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


short = st.text(alphabet="abc é", max_size=14)


@given(short, st.text(alphabet="abc é", max_size=40))
def test_myers_equals_dynamic_programming(pattern, text):
    assert d.myers(pattern, text)[0] == (plain_distance(pattern, text) if pattern else 0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab ", min_size=1, max_size=24), min_size=1, max_size=4), st.text(alphabet="ab c", max_size=70), st.sampled_from([0.0, 0.1, 0.3]))
def test_matches_equal_brute_force(items, text, rate):
    own = d.Matcher([(k, t) for k, t in enumerate(items)], rate)
    want = {}
    for k, t in enumerate(items):
        t = d.normal(t)
        best = plain_distance(t, d.normal(text)) if t else 99
        if t and best <= int(rate * len(t)) and d.normal(text):
            want[k] = best
    assert {i: dist for i, dist, _, _ in own.matches(text)} == want


def test_query_finds_whole_and_edited_items(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = {(i, k) for i, t in docs.items() for k, x in items.items() if d.normal(x) in d.normal(t)}
    got = {(r.doc_id, r.item_id): r.distance for r in d.op1_pigeonhole_edit(spark, sf_dir).collect()}
    assert want <= got.keys() and all(got[k] == 0 for k in want)
    for (i, k), distance in got.items():
        assert plain_distance(d.normal(items[k]), d.normal(docs[i])) == distance


def test_blocks_and_edges(spark):
    long = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    edited = long.replace("quick", "quikc").replace("far", "for")
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "so: " + edited.upper() + " end", "x"), (3, long, "y"), (None, "a\n" + long.replace(" ", "\n"), "z"), (5, "clean words only", "q")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, long), (2, long), (3, ""), (4, None)], "item_id long, text string")
    for chars in (10, 10**6):
        got = sorted((r.doc_id or 0, r.item_id, r.distance) for r in d.find_leaks(docs, items, block_chars=chars).collect())
        assert got == [(0, 1, 0), (0, 2, 0), (3, 1, 0), (3, 1, 3), (3, 2, 0), (3, 2, 3)]
        assert sorted(r.doc_id for r in d.decontaminate(docs, items, block_chars=chars).collect()) == [1, 2, 5]
    assert d.find_leaks(docs, items.limit(0)).count() == 0 and d.decontaminate(docs, items.limit(0)).count() == 6
    assert d.find_leaks(docs.limit(0), items).count() == 0


def test_query_on_edited_items_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    words = "river stone amber night harbour winter music paper garden iron silver lantern".split()
    items = [" ".join(rng.choices(words, k=rng.randint(4, 16))) for _ in range(14)] + ["short", "a b"]

    def edited(text, n):
        out = list(text)
        for _ in range(n):
            k = rng.randrange(len(out))
            out[k : k + 1] = rng.choice([[], [rng.choice("xyz")], [out[k], rng.choice("xyz")]])
        return "".join(out)

    docs = []
    for k in range(70):
        item = rng.choice(items)
        docs.append(f"{' '.join(rng.choices(words, k=12))} {edited(item, rng.randint(0, 6))} {' '.join(rng.choices(words, k=9))}")
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = {(i, k): n for i, t in enumerate(docs) for k, x in enumerate(items) if (n := plain_distance(d.normal(x), d.normal(t))) <= int(0.05 * len(d.normal(x)))}
    got = {(r.doc_id, r.item_id): r.distance for r in d.op1_pigeonhole_edit(spark, str(tmp_path)).collect()}
    assert got == want and len({n for n in want.values()}) > 3
