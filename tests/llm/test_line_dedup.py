import random

import pytest
from pyspark.sql import functions as F

from wayspark.llm import line_dedup as M


def brute(texts, min_words):
    """What is left of (doc_id, text): every run of lines with enough words that occurred before goes."""
    split = [(i, t.split("\n")) for i, t in sorted(texts)]
    seen, gone = set(), {i: set() for i, _ in split}
    starts = [(i, k, lines) for i, lines in split for k in range(len(lines))]
    for i, k, lines in starts:
        for j in range(k + 1, len(lines) + 1):
            run = tuple(lines[k:j])
            if sum(len(x.split()) for x in run) >= min_words:
                if run in seen:
                    gone[i].update(range(k, j))
                seen.add(run)
    return {i: "\n".join(x for k, x in enumerate(lines) if k not in gone[i]) for i, lines in split}


@pytest.mark.parametrize("seed, words", [(1, 3), (2, 6), (3, 1)])
def test_against_brute_force(make_docs, seed, words):
    rng = random.Random(seed)
    lines = ["a", "b c", "d e f", "", "g", "h i"]
    texts = [(i, "\n".join(rng.choice(lines) if rng.random() < 0.9 else f"own {rng.random()}" for _ in range(rng.randint(1, 14)))) for i in range(60)]
    got = {r.doc_id: r.left for r in M.line_dedup(make_docs(texts), words).select("doc.doc_id", "left").collect()}
    assert got == brute(texts, words)


def test_long_runs_need_several_levels(make_docs):
    run = "\n".join(f"w{i}" for i in range(40))
    docs = make_docs([(1, "x\n" + run + "\ny"), (2, "z\n" + run), (3, run)])
    got = {r.doc_id: (r.left, [tuple(x) for x in r.removed]) for r in M.line_dedup(docs, 33).select("doc.doc_id", "left", "removed").collect()}
    assert got == {1: ("x\n" + run + "\ny", []), 2: ("z", [(1, 40)]), 3: ("", [(0, 40)])}


def test_odd_rows(make_docs, odd):
    docs = make_docs([(7, t) for t in odd] + [(None, "one two three")] * 2).withColumns({"uid": F.lit(1), "line": F.lit(2), "left": F.lit(3), "a.b": F.lit(4), "my col": F.lit(5), "my-col": F.lit(6), "x`y": F.lit(7)})
    rows = M.line_dedup(docs, 3).collect()
    assert len(rows) == len(odd) + 2
    assert sum(r.n_removed for r in rows) >= 1 and all(r.left is None and r.n_lines == 0 for r in rows if r.n_lines == 0)
    assert M.line_dedup(make_docs([]), 3).count() == 0


def test_shortest_runs():
    import numpy as np

    ahead, back = M.shortest_runs(np.array([2, 0, 1, 3, 0]), 3)
    assert ahead.tolist() == [3, 3, 2, 1, 0] and back.tolist() == [0, 0, 3, 1, 2]
