import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wayspark.llm import simhash as M


def plain_fingerprint(text, shingle=3):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, bits):
    """Smallest index reachable over values that differ in at most ``bits`` bits."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def test_fingerprint_of_odd_texts(odd, monkeypatch):
    monkeypatch.setattr(M, "PART", 7)
    for t in [*odd, "A b C d e", "é B\x0bc d", "a b", "Ab aB ab AB"]:
        assert M.fingerprint(t) == plain_fingerprint(t)


@pytest.mark.parametrize("seed, bits, bucket", [(1, 2, 64), (2, 2, 3), (3, 3, 2), (4, 0, 64), (5, 1, 2)])
def test_components_against_brute_force(spark, seed, bits, bucket):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = [b ^ sum(1 << k for k in rng.sample(range(64), rng.choice((0, 1, 2, 3, 5)))) for b in base for _ in range(25)]
    signed = [int(np.array(v, np.uint64).view(np.int64)) for v in values]
    fps = spark.createDataFrame([(v,) for v in set(signed)], "fp long")
    found = {frozenset((r.u, r.v)) for r in M.links(fps, bits, bucket).collect()}
    u = sorted(set(values))
    want = {frozenset(int(np.array(x, np.uint64).view(np.int64)) for x in (a, b)) for i, a in enumerate(u) for b in u[:i] if (a ^ b).bit_count() <= bits}
    assert found == want
    rows = spark.createDataFrame(list(enumerate(signed)), "first long, fp long")
    least = {r.fp: r.least for r in M.classes(rows, bits).collect()}
    assert [least[s] for s in signed] == brute_components(values, bits)


def test_dense_ball_splits_and_stays_exact(spark):
    ball = [1 << i | 1 << j for i in range(24) for j in range(i)] + [1 << i for i in range(24)] + [0]
    fps = spark.createDataFrame([(v,) for v in ball], "fp long")
    assert M.links(fps, 2, 8).count() == sum((a ^ b).bit_count() <= 2 for i, a in enumerate(ball) for b in ball[:i])


def test_thresholds_are_enough_for_every_pair():
    rng = random.Random(9)
    for m in (2, 3, 4):
        groups = M.group_bits(list(range(64)), m, np.zeros((64, 64)))
        assert sorted(b for g in groups for b in g) == list(range(64))
        costs = [[0.0, *sorted(rng.uniform(1, 100) for _ in range(3))] for _ in range(m)]
        _, t = M.allot(costs, 3)
        assert sum(x + 1 for x in t) == 3
        masks = M.masks_for(groups, t)
        for _ in range(200):
            apart = sum(1 << k for k in rng.sample(range(64), rng.randint(0, 2)))
            assert any(not (apart & (mask & (1 << 64) - 1)) for mask in masks)


def test_documents(make_docs, odd):
    docs = make_docs(list(enumerate(odd)) + [(None, "one")])
    got = {r.doc_id: r for r in M.near_duplicates(docs).collect()}
    assert got[0].component_id == got[1].component_id == got[2].component_id == 0 and got[0].fp == 0
    assert got[4].component_id == 3 and got[None].component_id == 3
    wide = docs.withColumns({"uid": F.lit(1), "fp": F.lit(2), "a.b": F.lit(4), "my col": F.lit(5), "my-col": F.lit(6), "x`y": F.lit(7)})
    kept = M.one_of_each(wide)
    assert kept.columns == wide.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in got.values()})
    assert M.one_of_each(make_docs([(1, "x"), (1, "x")])).count() == 1
    assert M.near_duplicates(make_docs([])).count() == 0
