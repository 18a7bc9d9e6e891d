import pickle
import tracemalloc

import numpy as np
import pytest

from tessera.llm import hnsw


def data(n=1500, d=24, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for k in range(0, n, 3):
        x[k] = x[(k * 7) % n if k % 2 else 5] + 0.15 * rng.normal(size=d)
    return hnsw.unit(x)


@pytest.mark.parametrize("width", [4, 48])
def test_links_of_a_graph_against_brute_force(width):
    x = data()
    graph = hnsw.Graph(x)
    assert sorted(graph.order.tolist()) == list(range(len(x)))
    want = set(zip(*np.nonzero(x @ x.T >= 0.9)))
    shard = hnsw.Shard(graph, x, 0.9, width=width)
    got = {(int(a), int(b)) for i, j in shard.linked(x) for a, b in zip(i, j)}
    assert got <= want and len(got) >= 0.97 * len(want) and shard.found >= 0.98 * shard.true > 0


def test_probes_have_true_pairs():
    for x in (data(), hnsw.unit(np.array([[1.0], [-1.0]])), hnsw.unit(np.ones((1, 3)))):
        assert ((hnsw.probes(x, 0.9, 50) @ x.T).max(axis=1) >= 0.9).all()


def brute(rows):
    """{vec_id: (links, smallest id reachable)} by all pairs."""
    good = {k: hnsw.unit(np.array([v], float) / np.abs(v).max())[0] for k, v in rows}
    ids, x = list(good), np.array(list(good.values()))
    near = x @ x.T >= 0.9
    least = np.array(ids)
    while not np.array_equal(least, new := np.where(near, least[None, :], max(ids)).min(axis=1)):
        least = new
    return {k: (int(near[i].sum()) - 1, int(least[i])) for i, k in enumerate(ids)}


@pytest.mark.parametrize("shards, task_rows, shard_bytes", [(8, 10_000, 96_000_000), (5, 100, 96_000_000), (2, 300, 40_000)])
def test_query_on_vectors_with_links_against_brute_force(spark, tmp_path, shards, task_rows, shard_bytes):
    x = data(1200, 24, 11)
    rows = [(k, (3.0 * v).tolist()) for k, v in enumerate(x)] + [(2000 + k, x[k].tolist()) for k in range(0, 60, 2)]
    spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = brute(rows)
    if shards == 8:
        got = hnsw.op6_hnsw_shards(spark, str(tmp_path)).collect()
    else:
        got = hnsw.near_vectors(spark.read.parquet(str(tmp_path / "embeddings.parquet")), shards=shards, task_rows=task_rows, shard_bytes=shard_bytes).collect()
    assert len(got) == len(rows) and sum(n for n, _ in want.values()) > 1000
    assert all(r.n_links <= want[r.vec_id][0] for r in got)
    assert sum(r.n_links for r in got) >= 0.98 * sum(n for n, _ in want.values())
    assert sum(r.n_links for r in got) % 2 == 0  # a link counts at both ends
    assert np.mean([r.component_id == want[r.vec_id][1] for r in got]) > 0.99
    assert {r.audited_recall for r in got} == {got[0].audited_recall} and 0.98 <= got[0].audited_recall <= 1


def test_near_vectors_against_brute_force(spark):
    x = data(400, 16)
    rows = [(k, x[k].tolist(), "label") for k in range(len(x))]
    rows += [(1000, x[3].tolist(), ""), (1001, x[3].tolist(), ""), (1002, None, ""), (1003, [0.0] * 16, ""), (1004, [float("nan")] * 16, ""), (1005, [1.0, None], ""), (1006, [1e300, 2e300], ""), (1007, [1e-300, 2e-300], ""), (1008, [], ""), (1009, [float("inf"), 1.0], "")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string")
    good = {r[0]: hnsw.unit(np.array([r[1]]) / np.abs(r[1]).max())[0] for r in rows if r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])}
    got = {r.vec_id: r for r in hnsw.near_vectors(frame, shards=3, task_rows=150).collect()}
    assert len(got) == len(rows)
    root = {r[0]: r[0] for r in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = {r[0]: 0 for r in rows}
    for a in good:
        for b in good:
            if a != b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.9:
                links[a] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    assert sum(got[k].n_links for k in links) >= 0.97 * sum(links.values())
    assert all(got[k].n_links <= links[k] for k in links)
    assert np.mean([got[k].component_id == find(k) for k in links]) > 0.99
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert all(got[k].n_links == 0 and got[k].kept for k in (1002, 1003, 1004, 1005, 1008, 1009)) and got[1006].n_links == 1
    assert hnsw.near_vectors(frame.limit(0)).count() == 0


def test_graph_of_rows_is_the_graph():
    x = data(700, 12)
    graph = hnsw.Graph(x)
    links, lengths = (np.concatenate(p) for p in zip(*(graph.node_links(low, low + 300) for low in range(0, 700, 300))))
    again = hnsw.Graph.of_rows(x[graph.order], links, lengths)
    assert again.sizes == graph.sizes and len(graph.sizes) > 1 and all(np.array_equal(a, b) for a, b in zip(again.layers, graph.layers))


def test_no_cell_grows_with_a_shard_and_waves_give_the_same_rows(spark, monkeypatch):
    x, kept = data(900, 16, 3), {}
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")

    def kept_sizes(df, label, keep=hnsw.keep):
        out = keep(df, label)
        if label in ("vectors", "graphs"):
            kept[label] = max(len(pickle.dumps(tuple(r))) for r in out.collect())
        return out

    monkeypatch.setattr(hnsw, "keep", kept_sizes)
    one = sorted(map(tuple, hnsw.near_vectors(frame, shards=5).drop("audited_recall").collect()))
    assert kept["graphs"] < kept["vectors"] + 1000  # one node's links, whatever the shard's size
    waves = sorted(map(tuple, hnsw.near_vectors(frame, shards=5, wave_bytes=1).drop("audited_recall").collect()))
    assert one == waves and sum(r[1] for r in one) > 1000


def test_memory_of_a_search_among_many_copies():
    rng = np.random.default_rng(2)
    x = hnsw.unit(rng.normal(size=24) + 0.05 * rng.normal(size=(12_000, 24)))
    graph = hnsw.Graph(x)
    tracemalloc.start()
    found = sum(len(i) for i, _ in graph.search(x[:300], 16, 0.9))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found >= 0.98 * 300 * len(x) and peak < 90_000_000
