"""Near duplicates among vectors against all cosines."""

import numpy as np
import pytest

from eventloom.llm import near_vectors as nv


def plain(rows, threshold=0.9):
    """[(n_links, component)] by comparing all pairs."""
    n = len(rows)
    fine = [v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    up, degree = list(range(n)), [0] * n

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if ok else None for (_, v), ok in zip(rows, fine, strict=True)]
    for i in range(n):
        for j in range(i):
            if fine[i] and fine[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                degree[i] += 1
                degree[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[root(i)] = min(least.get(root(i), name), name)
    return [(degree[i], least.get(root(i))) for i in range(n)]


def families(rng, n, d, members, spread):
    centres = rng.normal(size=(n, d))
    return np.concatenate([c + spread * rng.normal(size=(members, d)) for c in centres])


def found(spark, rows, kind="float", **options):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], k) for k, (i, v) in enumerate(rows)], f"vec_id long, embedding array<{kind}>, place int")
    got = {r["place"]: (r["n_links"], r["component_id"]) for r in nv.near_duplicate_vectors(df, keep=["place", "vec_id"], **options).collect()}
    return [got[k] for k in range(len(rows))]


@pytest.mark.parametrize(("seed", "d", "spread"), [(1, 16, 0.33), (2, 64, 0.33), (3, 3, 0.2)])
def test_families_and_strangers(spark, monkeypatch, seed, d, spread):
    monkeypatch.setattr(nv, "BLOCK_ROWS", 64)
    monkeypatch.setattr(nv, "TILE", 40)
    monkeypatch.setattr(nv, "SUMMARY_CHUNK", 4)
    rng = np.random.default_rng(seed)
    x = np.concatenate([families(rng, 12, d, 25, spread), rng.normal(size=(300, d))]).astype(np.float32)
    x = np.concatenate([x, np.repeat(x[:3], 60, axis=0), 7 * x[:5]])
    rows = [(int(i), x[i].tolist()) for i in rng.permutation(len(x))]
    want = plain(rows)
    assert found(spark, rows) == want
    assert any(0 < k < 20 for k, _ in want)


def test_the_bound_holds_and_little_is_computed_again():
    rng = np.random.default_rng(8)
    x = np.concatenate([families(rng, 20, 32, 40, 0.3), rng.normal(size=(1200, 32))])
    u = nv.unit(x)
    q, s, e = nv.quantised(u)
    estimate = np.outer(s, s) * (q.astype(np.int64) @ q.T.astype(np.int64))
    bound = e[:, None] + e + np.outer(e, e)
    assert (np.abs(u @ u.T - estimate) <= bound).all()
    one = nv.Comparison([nv.Block(np.arange(len(x)), np.ones(len(x), np.int64), x, u[:0])])
    one.compare(0, 0)
    links = np.triu(u @ u.T >= 0.9, 1)
    assert one.links.tolist() == (links + links.T).sum(axis=1).tolist()
    assert one.done["computed"] < 0.01 * one.done["pairs"] and one.done["sure"] > one.done["computed"]


def test_angles_to_pivots_spare_products():
    rng = np.random.default_rng(3)
    x = families(rng, 8, 24, 200, 0.08)
    pivots = nv.unit(x[::200])
    blocks = [nv.Block(np.arange(i, i + 200), np.ones(200, np.int64), x[i : i + 200], pivots) for i in range(0, len(x), 200)]
    c = nv.Comparison(blocks)
    for i in range(8):
        for j in range(i, 8):
            c.compare(i, j)
    assert c.done["apart"] >= 20 and c.done["whole"] == 8 and c.done["multiplied"] <= 8
    u = nv.unit(x)
    assert c.links.tolist() == ((u @ u.T >= 0.9).sum(axis=1) - 1).tolist()
    assert len(c.rows()[0]) == 8 * (200 + 199)  # a forest, not pairs


def test_thresholds_met_exactly_are_links():
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.5, 0.5, 0.5, 0.5]), (3, [0.0, 0.0, 0.0, -2.0])]
    vectors = [np.array([v]) for _, v in rows]
    assert nv.cosines(vectors[0], vectors[1])[0] == 0.5
    blocks = [nv.Block(np.arange(3), np.ones(3, np.int64), np.concatenate(vectors), np.empty((0, 4)))]
    c = nv.Comparison(blocks, 0.5)
    c.compare(0, 0)
    assert c.links.tolist() == [1, 1, 0]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1, 0]), (None, [2, 0]), (None, [0, 1]), (4, None), (3, []), (2, [0, 0]), (1, [1, None]), (9, [nan, 1]), (8, [inf, 1])]
    rows += [(7, [1, 0, 0]), (6, [1e300, 1e299]), (6, [1e-320, 0.0]), (12, [-0.0, 3.0]), (11, [0.0, 3.0]), (11, [0.0, 3.0])]
    want = plain([(i, v if v is None or None in v or max(map(abs, v), default=0) not in (1e300, 1e-320) else [1, v[1] / v[0]]) for i, v in rows])
    assert found(spark, rows, "double") == want
    df = spark.createDataFrame([("b", [1.0, 2.0], {"a": 1}, 3, True), ("a", [1.0, 2.1], None, None, None)], "vec_id string, embedding array<float>, vector map<string,int>, N_LINKS int, node boolean")
    got = nv.near_duplicate_vectors(df)
    assert got.columns == ["vec_id", "embedding", "vector", "node", "n_links", "component_id", "kept"]
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got.collect()) == [("a", 1, "a", True), ("b", 1, "a", False)]
    assert nv.near_duplicate_vectors(df.limit(0)).count() == 0


def test_blocks_are_bounded_and_keep_lengths_apart():
    bins = [{"size": s, "cell": c, "bin": 0, "n": n} for s, c, n in ((2, 0, 5), (2, 1, 4), (2, 2, 30), (3, 0, 1), (3, 1, 9))]
    assert nv._blocks_of(bins, 10) == [(2, 0, 0, 0, 1), (2, 1, 0, 0, 1), (2, 2, 0, 1, 3), (3, 0, 0, 4, 1), (3, 1, 0, 4, 1)]
