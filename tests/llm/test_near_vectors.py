import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import near_vectors as nv
from tracewright.llm.components import components


def union(nodes, pairs):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=60))
def test_components_equal_union_find(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = union({x for e in edges for x in e}, edges)
    assert got == {x: c for x, c in want.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}


def brute(rows, least=0.98):
    links, pairs = {}, []
    ok = [(i, np.array(e, float), y) for i, e, y in rows if i is not None and y is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    for k, (i, e, y) in enumerate(ok):
        for j, f, z in ok[:k]:
            if y == z and len(e) == len(f) and e @ f / np.sqrt(e @ e) / np.sqrt(f @ f) >= least:
                pairs.append((i, j))
                links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
    roots = union({i for i, _, _ in ok}, pairs)
    return {i: (links.get(i, 0), roots.get(i, i)) for i, _, _ in rows}


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(8)
    rows = [(i, (base + 0.05 * rng.standard_normal(8)).tolist(), 1) for i in range(40)]
    rows += [(100 + i, base.tolist(), 1) for i in range(30)] + [(200 + i, base.tolist(), 2) for i in range(3)]
    rows += [(300, None, 1), (301, [0.0] * 8, 1), (302, [None, *base.tolist()[1:]], 1), (303, [float("nan"), *base.tolist()[1:]], 1), (304, [float("inf")] * 8, 1), (305, base.tolist(), None), (306, [], 1), (307, base.tolist()[:5], 1), (308, (base * 1e300).tolist(), 1), (None, base.tolist(), 1)]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links int, p string")
    got = nv.near_vectors(df, block=16).collect()
    want = brute([r if r[0] != 308 else (308, base.tolist(), 1) for r in rows])
    assert len(got) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)
    assert nv.near_vectors(df.limit(0)).count() == 0


def test_recall_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2500, 64))
    x[1000:1400] = x[0] + 0.11 * rng.standard_normal((400, 64)) * np.linalg.norm(x[0]) / 8  # a large group of near copies
    for k in range(1400, 2200):
        x[k] = x[rng.integers(1, 900)] + rng.uniform(0.02, 0.2) * rng.standard_normal(64)
    labels = rng.integers(0, 2, len(x))
    labels[1000:1400] = labels[0]
    rows = [(i, v.astype(np.float32).tolist(), int(y)) for i, (v, y) in enumerate(zip(x, labels, strict=True))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in nv.op2_near_vectors(spark, str(tmp_path)).collect()}
    u = nv.unit(x.astype(np.float32))
    linked = ((u @ u.T) >= nv.LEAST_COSINE) & (labels[:, None] == labels)
    n = linked.sum(1) - 1
    assert len(got) == len(rows) and all(got[i].n_links <= k for i, k in enumerate(n))
    assert sum(r.n_links for r in got.values()) >= 0.99 * n.sum() > 80_000
    assert all(r.component_id <= r.vec_id for r in got.values())
