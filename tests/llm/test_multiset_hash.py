import hashlib

import pytest
from pyspark.sql import functions as F

from wayspark.llm import multiset_hash as M


def test_order_insertion_and_deletion():
    a, b = "one two\nthree four\nfive six", "five six\none two\nthree four"
    assert M.Fingerprint.of(a) == M.Fingerprint.of(b)
    assert M.Fingerprint.of(a) - M.paragraph("three four") + M.paragraph("new line") == M.Fingerprint.of("one two\nfive six\nnew line")
    assert M.Fingerprint.of("a\na") != M.Fingerprint.of("a")
    assert M.Fingerprint.of("x\n" * 10_000) == M.Fingerprint.of("\n" + "x\n" * 9_999 + "x")


def test_likeness():
    words = [f"w{i} v{i} u{i}" for i in range(400)]
    f = [M.Fingerprint.of("\n".join(w)) for w in (words, words[:200] + [w + "z" for w in words[200:]], [w[::-1] for w in words])]
    assert f[0].likeness(f[0]) == 1
    assert 0.3 < f[0].likeness(f[1]) < 0.9 and f[0].likeness(f[2]) < 0.35
    assert M.Fingerprint.of("").likeness(M.Fingerprint.of(None)) == 1


@pytest.mark.parametrize("rows", [5, 0, 7])
def test_edits_against_brute_force(make_docs, odd, monkeypatch, rows):
    monkeypatch.setattr(M, "BLOCK_ROWS", rows or 1)
    texts = [(3 * i - 20, t) for i, t in enumerate(odd * 3)]
    docs = make_docs(texts).withColumns({"block": F.lit(1), "extra": F.lit(2), "key": F.lit(3)})
    got = {r.doc_id: r for r in M.with_edits(docs).collect()}
    order = sorted(((k, t or "") for k, t in texts), reverse=True)
    assert len(got) == len(order)
    for (k, own), (_, following) in zip(order, order[1:] + order[:1]):
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        assert got[k].n_chars == len(own) and got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[k].fingerprint == M.Fingerprint.of(own).hex() and got[k].edited_fingerprint == M.Fingerprint.of(edited).hex()
        assert got[k].near_next == M.Fingerprint.of(own).likeness(M.Fingerprint.of(following))


def test_repeated_and_null_ids_and_empty_table(make_docs):
    rows = M.with_edits(make_docs([(1, "a b"), (1, "a b"), (1, "c d"), (None, "e"), (None, None)])).collect()
    assert len(rows) == 5
    assert M.with_edits(make_docs([(1, "x")])).first().near_next == 1
    assert M.with_edits(make_docs([])).count() == 0
    assert M.fingerprints(make_docs(["a", "a"])).select("fingerprint").distinct().count() == 1


def test_likeness_of_very_repetitive_texts():
    a, b, c = (M.Fingerprint.of("\n".join(["same pair"] * n)) for n in (100_000, 65_536, 30_000))
    assert a.likeness(b) > 0.9 and 0.5 < a.likeness(c) < b.likeness(c) < 0.8


def test_a_hot_id_is_parted(make_docs, monkeypatch):
    """Half of the rows without an id, in many blocks; each row still meets the next one."""
    monkeypatch.setattr(M, "BLOCK_ROWS", 5)
    texts = [(i if i % 2 else None, f"t{i} w{i % 7}") for i in range(200)]
    docs = make_docs(texts)
    blocks = M.in_blocks(docs).where("extra = 0").groupBy("block").count().collect()
    assert len(blocks) > 25 and max(r["count"] for r in blocks) < 40
    rows = M.with_edits(docs).collect()
    assert len(rows) == 200 and sum(r.doc_id is None for r in rows) == 100
    of = {M.Fingerprint.of(t).hex(): t for _, t in texts}
    order = sorted((k for k, _ in texts if k is not None), reverse=True)
    text = dict(texts)
    for r in rows:
        if r.doc_id in order[:-1]:
            following = text[order[order.index(r.doc_id) + 1]]
            own = text[r.doc_id]
            assert r.edited_sha256 == hashlib.sha256((own[: len(own) - len(own) // 2] + following[: len(own) // 2]).encode()).hexdigest()
    assert len({of[r.fingerprint] for r in rows}) == 200


def test_equal_rows_are_parted(make_docs, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 5)
    docs = make_docs([(None, "the same text") for _ in range(200)] + [(k, f"t {k}") for k in range(20)])
    blocks = M.in_blocks(docs).where("extra = 0").groupBy("block").count().collect()
    assert len(blocks) > 20 and max(r["count"] for r in blocks) < 40
    rows = M.with_edits(docs).collect()
    assert len(rows) == 220 and sum(r.doc_id is None and r.near_next == 1 for r in rows) == 199


def test_cuts_part_hot_keys_in_order():
    import numpy as np

    c = M.Cuts([1, 5, 5, 5, 9])
    h = np.array([-(1 << 63), 0, (1 << 63) - 1])
    assert c.of(np.array([0, 1, 2, 4]), np.zeros(4, np.int64)).tolist() == [0, 0, 1, 1]
    assert c.of(np.full(3, 5), h).tolist() == [1, 2, 3]
    assert c.of(np.array([6, 9, 10]), np.zeros(3, np.int64)).tolist() == [4, 4, 5]
