import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from wayspark.llm import near_copies as M
from wayspark.llm import simhash


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept(texts):
    """Smallest index of each component of near copies, all pairs compared."""
    sets, root = [plain_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {find(i) for i in range(len(texts))}


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"x{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("seed, bucket", [(1, 64), (2, 3)])
def test_near_copies_against_all_pairs(make_docs, seed, bucket):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    common = [rng.choice(words) for _ in range(30)]
    texts = ["", None, "a b", "A  b", "one"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice((20, 100, 300)))] + common * rng.randint(0, 1)
        texts += [edited(rng, base, rng.randint(0, max(1, len(base) // 35))) for _ in range(6)]
    want = kept(texts)
    assert {r.doc_id for r in M.one_of_each(make_docs(texts), bucket).collect()} == want


def test_copies_that_three_bits_miss(spark, make_docs):
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = [" ".join(base), edited(rng, base, 4)]
    assert (simhash.fingerprint(texts[0]) ^ simhash.fingerprint(texts[1])).bit_count() > 3
    assert [r.doc_id for r in P.near_copies(spark, make_docs(texts), "").collect()] == [0]


def test_odd_rows(make_docs, odd):
    docs = make_docs([*enumerate(odd), (None, "one"), (7, "q"), (7, "q")]).withColumns({"uid": F.lit(1), "n": F.lit(2), "key": F.lit(3), "a.b": F.lit(4), "my col": F.lit(5), "my-col": F.lit(6), "x`y": F.lit(7)})
    out = M.one_of_each(docs)
    assert out.columns == docs.columns and out.where("doc_id is null").count() == 0 and out.where("text = 'q'").count() == 1
    assert M.one_of_each(make_docs([])).count() == 0
