import hashlib
import random
from itertools import islice

import pytest
from pyspark.sql import functions as F

from wayspark.llm import mixing as M


def places(sizes, shares, block):
    """(source, block) by slot, scheduled one slot at a time over all blocks."""
    left, had, order = {n: -(-k // block) for n, k in sizes.items()}, dict.fromkeys(sizes, 0), []
    while left:
        total, t, use, ended = sum(shares[n] for n in left), 0, dict.fromkeys(left, 0), False
        while not ended:
            due, n = min((-(-(use[n] + 1) * total // shares[n]), n) for n in left if use[n] * total // shares[n] <= t)
            assert due > t  # no deadline is missed
            order.append((n, had[n] + use[n]))
            use[n] += 1
            t += 1
            assert all(abs(use[m] - t * shares[m] / total) < 1 for m in left)
            ended = use[n] == left[n]
        for n in list(left):
            had[n] += use[n]
            left[n] -= use[n]
            if not left[n]:
                del left[n]
    return {x: i for i, x in enumerate(order)}


@pytest.mark.parametrize("weights", [None, {"a": 5, "b": 3, "c": 1}])
def test_places_follow_the_schedule(make_docs, weights):
    rng = random.Random(3)
    docs = make_docs([(i, "t", "en", rng.choice("aaaabbc")) for i in range(700)])
    rows = M.mixed(docs, weights, block=4, parts=50).select("doc.doc_id", "source", "slot", "place").collect()
    sizes = {n: sum(r.source == n for r in rows) for n in "abc"}
    shares = M.whole_parts(weights or {n: k**M.POWER for n, k in sizes.items()}, 50)
    slot = places(sizes, shares, 4)
    by = {n: sorted((r for r in rows if r.source == n), key=lambda r: hashlib.md5(f"1:{r.doc_id}".encode()).hexdigest()) for n in "abc"}
    for n, own in by.items():
        for k, r in enumerate(own):
            assert r.slot == slot[n, k // 4] and r.place == r.slot * 4 + k % 4
    assert len({r.place for r in rows}) == 700


def test_a_million_slots_keep_within_a_block_of_skewed_weights():
    given = {"a": 2 / 3, "b": 1 / 3 - 2e-6, "c": 1e-6, "d": 1e-6, "none": 0.0}
    weights = M.whole_parts(given)
    assert "none" not in weights and M.whole_parts({"a": 1, "b": 0}) == {"a": M.PARTS} and M.whole_parts({}) == {}
    had = dict.fromkeys(weights, 0)
    for t, (n, j) in enumerate(islice(M.order(weights), 1_000_000), 1):
        assert j == had[n]
        had[n] += 1
        assert abs(had[n] - given[n] * t) < 1 + 1e-5
        if t % 1000 == 0:
            assert all(abs(had[m] - given[m] * t) < 1 + 1e-5 for m in had)
    assert had["c"] == had["d"] == 1


def test_sources_of_weight_0_are_not_in_the_mix(make_docs):
    docs = make_docs([(i, "t", "en", "ab"[i % 2]) for i in range(40)])
    rows = M.mixed(docs, {"a": 1, "b": 0}, block=4).collect()
    assert len(rows) == 40 and all((r.slot is None, r.place is None, r.phase is None) == ((r.source == "b",) * 3) for r in rows)


def test_blocks_grow_where_there_would_be_too_many(make_docs):
    docs = make_docs([(i, "t", "en", "ab"[i % 2]) for i in range(100)])
    rows = M.mixed(docs, block=1, most=10).collect()
    assert {r.slot for r in rows} == set(range(10)) and len({r.place for r in rows}) == 100


def test_odd_rows(spark, make_docs):
    docs = make_docs([(None, None, None, None), (None, None, None, None), (1, "", "en", "s"), (1, "", "en", "s")]).withColumns({"doc": F.lit(1), "rank": F.lit(2), "place": F.lit(3), "a.b": F.lit(4), "my col": F.lit(5), "my-col": F.lit(6), "x`y": F.lit(7)})
    out = M.mixed(docs)
    assert out.count() == 4 and out.select("place").distinct().count() == 4
    assert out.select("doc.*").columns == docs.columns
    assert M.mixed(docs.limit(0)).count() == 0


def test_too_many_sources(make_docs):
    with pytest.raises(ValueError):
        M.mixed(make_docs([(i, "t", "en", f"s{i}") for i in range(M.MAX_SOURCES + 1)]))


def test_given_weights_hold_with_many_sources(make_docs):
    names = [f"s{k:02}" for k in range(20)]
    docs = make_docs([(i, "t", "en", names[1 + i % 19] if i < 800 else "s00") for i in range(1600)])
    weights = {n: 0.5 if n == "s00" else 0.5 / 19 for n in names}
    first = [r.source for r in M.mixed(docs, weights, block=1).where("phase = 0").orderBy("place").select("source").collect()]
    assert len(first) > 1000
    for n, w in weights.items():
        had = 0
        for t, source in enumerate(first, 1):
            had += source == n
            assert abs(had - w * t) < 1 + 1e-6


def test_a_schedule_in_chunks_is_whole(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 4)
    monkeypatch.setattr(M, "WRITTEN", 3)
    blocks, weights = {"a": 41, "b": 8, "c": 1}, {"a": 5, "b": 3, "c": 2}
    got = {(r.source, r.chunk * 4 + k): (s, p) for r in M.schedule(spark, blocks, weights).collect() for k, (s, p) in enumerate(zip(r.slots, r.phases, strict=True))}
    assert got == {(n, j): (s, p) for s, (n, j, p) in enumerate(M.scheduled(blocks, weights))} and len(got) == 50
