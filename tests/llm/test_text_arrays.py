import random
from collections import Counter

import numpy as np
import pytest

from wayspark.llm import text_arrays as M

SPACES = " \t\n\v\f\r"


def plain_words(text, word):
    out, run = [], ""
    for c in text + " ":
        if c in SPACES or len(run) == word:
            out += [run] if run else []
            run = ""
        if c not in SPACES:
            run += c
    return out


def texts(rng, n=40):
    kinds = ["ab ", "a", "abcdefgh \n", "日本é\U0001f600 ", " \t"]
    return ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.choice((0, 1, 5, 30, 200)))) for _ in range(n)] + ["x" * 150, " " * 150, "y" * 64]


@pytest.mark.parametrize("size, word", [(1 << 20, 4096), (20, 7), (33, 32), (64, 10)])
def test_words_and_grams_do_not_depend_on_the_cut(size, word):
    own = texts(random.Random(size))
    words, grams = [[] for _ in own], Counter()
    for piece in M.pieces(own, 2, size, word):
        h, text = M.word_hashes(piece, word)
        for a, b in zip(h.tolist(), text.tolist(), strict=True):
            words[b].append(a)
        for n, (bucket, text) in enumerate(M.gram_buckets(piece, (1, 2, 3), 48), 1):
            grams.update((n, a, b) for a, b in zip(bucket.tolist(), text.tolist(), strict=True))
        assert len(piece.flat) <= max(size, word + 1) + 2 * len(piece.own)
    seen: dict = {}
    for hashes, t in zip(words, own, strict=True):
        want = plain_words(t, word)
        assert len(hashes) == len(want)
        for h, w in zip(hashes, want, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    # every n-gram of every text once: equal n-grams, and only these, share a bucket
    plain = Counter((n, t[i : i + n], k) for k, t in enumerate(own) for n in (1, 2, 3) for i in range(len(t) - n + 1))
    assert sum(plain.values()) == sum(grams.values())
    assert sorted(plain.values()) == sorted(grams.values())


def test_gram_hash_against_plain_arithmetic():
    def bucket(gram, bits):
        h = 0
        for n, c in enumerate(gram, 1):
            h = (h * 0x100000001B3 + ord(c) + n) % 2**64
        return (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64 >> (64 - bits)

    own = ["héllo wörld", "日", ""]
    (piece,) = M.pieces(own, 2)
    for n, (got, text) in zip((1, 3), M.gram_buckets(piece, (1, 3), 12)):
        want = [(k, bucket(t[i : i + n], 12)) for k, t in enumerate(own) for i in range(len(t) - n + 1)]
        assert list(zip(text.tolist(), got.tolist(), strict=True)) == want


def test_no_texts():
    assert list(M.pieces([], 2)) == []
    (piece,) = M.pieces([""], 2)
    assert [len(x) for x in M.word_hashes(piece)] == [0, 0]
    assert all(not len(b) for b, _ in M.gram_buckets(piece, (1, 2), 8)) and piece.flat.dtype == np.uint32
