import numpy as np
import pytest
from pyspark.sql import functions as F

from wayspark.llm import hard_negatives as M

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(data, is_anchor, k=5, most=10):
    rows = []
    for i, (v, e, lab) in enumerate(data):
        if lab is not None and e is not None and all(x is not None and np.isfinite(x) for x in e):
            rows.append((i, v, lab, [int(np.floor(256 * float(np.float32(x)))) for x in e]))
    out = []
    key = lambda t: (-t[0], t[1] is None, t[1] or 0)
    for i, v, lab, e in rows:
        if not is_anchor(v):
            continue
        scored = [(sum(a * b for a, b in zip(e, f)), w, m) for j, w, m, f in rows if j != i]
        for p, pid, _ in sorted((t for t in scored if t[2] == lab), key=key)[:k]:
            fit = sorted((t for t in scored if t[2] != lab and 30 * p <= 100 * t[0] <= 90 * p), key=key)[:most]
            out += [(v, pid, r + 1, t[1], p, t[0]) for r, t in enumerate(fit)]
    return sorted(out, key=repr)


def got(spark, data):
    df = spark.createDataFrame(data, SCHEMA).repartition(3).withColumns({"uid": F.lit(7), "rank": F.lit("x"), "a.b": F.lit(1)})
    return sorted(map(tuple, M.mined(M.taking_part(df), F.coalesce(F.col("vec_id") % 10 == 0, F.lit(False))).collect()), key=repr)


@pytest.mark.parametrize("leaf,tree", [(4, 37), (32, 8192)])
def test_against_all_pairs(spark, monkeypatch, leaf, tree):
    monkeypatch.setattr(M, "LEAF", leaf)
    monkeypatch.setattr(M, "TREE_ROWS", tree)
    rng = np.random.default_rng(1)
    spots = rng.normal(size=(6, 8))
    data = [(int(i), (spots[i % 6] + rng.normal(size=8) * 0.4).astype(np.float32).tolist(), int(i) % 4) for i in range(300)]
    data += [(300 + i, data[20][1], i % 3) for i in range(80)]  # copies of an anchor's vector
    data += [data[10], data[10], data[11], (None, data[12][1], 1), (None, data[12][1], 2)]
    data += [(1000, None, 1), (1010, [1.0, None], 1), (1020, [float("nan")] * 8, 1), (1030, [float("inf")] * 8, 2), (1040, data[3][1], None), (1050, [], 1), (1060, [0.5, 0.25], 3)]
    assert got(spark, data) == plain(data, lambda v: v is not None and v % 10 == 0)


def test_blocks_of_anchors(spark):
    rng = np.random.default_rng(2)
    data = [(i, rng.normal(size=4).astype(np.float32).tolist(), i % 2) for i in range(200)]
    own = M.durable(M.taking_part(spark.createDataFrame(data, SCHEMA)).withColumn("uid", F.monotonically_increasing_id()), "v")
    queries = M.numbered(own.withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")}), "query", "uid")
    trees = M.durable(M.ball_trees(own), "t")
    one, many = (sorted(map(tuple, M.best_rows(trees, queries, True, 3, block).collect())) for block in (10_000, 17))
    assert one == many and len(one) == 600


def test_large_numbers_and_few_rows(spark):
    big = 3.0e5
    data = [(0, [big] * 5, 1), (1, [big - 1] * 5, 1), (2, [big / 2] * 5, 2), (10, [1.0] * 5, 3)]
    assert got(spark, data) == plain(data, lambda v: v % 10 == 0)
    assert got(spark, [(0, [1.0], 1)]) == [] and got(spark, []) == [] and got(spark, [(1, [1.0], 1), (3, [1.0], 2)]) == []


def test_bounds_hold_and_prune(monkeypatch):
    rng = np.random.default_rng(4)
    spots = rng.normal(size=(40, 6)) * 2000
    rows = np.floor(np.concatenate([s + rng.normal(size=(100, 6)) * 50 for s in spots]))
    tree = M.Tree.unpacked(*M.Tree.build(rows, np.arange(4000), np.arange(4000), np.zeros(4000, np.int64)).packed())
    for k in range(len(tree.lo)):
        own = tree.rows[tree.lo[k] : tree.hi[k]]
        assert (np.sqrt(((own - tree.centre[k]) ** 2).sum(axis=1)) <= tree.radius[k]).all()
    seen = []
    take = M.Best.take
    monkeypatch.setattr(M.Best, "take", lambda self, t, r, lo, hi, *rest: (seen.append(hi - lo), take(self, t, r, lo, hi, *rest)))
    best = M.Best(rows[:1], np.array([0]), np.array([0]), np.array([-np.inf]), np.array([np.inf]), True, 5)
    best.search(tree)
    want = sorted(((int(s), -i) for i, s in enumerate(rows @ rows[0]) if i), reverse=True)[:5]
    assert [(int(s), -int(i)) for s, i in zip(best.score[0], best.id[0])] == want
    assert sum(seen) < 800
