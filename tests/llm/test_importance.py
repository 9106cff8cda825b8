import random
from collections import Counter
from math import exp, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayspark.llm import importance as M

MASK = 2**64 - 1


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    clean = lambda: " ".join(rng.choice(words) for _ in range(80)) + "."
    junk = lambda: " ".join(rng.choice(words).upper() + "!!" for _ in range(80))
    twice = lambda: " ".join(w for _ in range(30) for w in [rng.choice(words)] * 4)
    return [(i, (junk() if i % 10 == 0 else twice() if i % 10 == 5 else clean())) for i in range(600)]


def labels(spark, n=300):
    return spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(n)], "doc_id long, quality int")


def test_held_out_accuracy(spark, make_docs, corpus):
    rows = M.resample(make_docs(corpus), labels(spark)).select("doc.doc_id", "kept").collect()
    late = [r for r in rows if r.doc_id >= 300]
    assert sum(r.kept == (r.doc_id % 5 != 0) for r in late) / len(late) > 0.97


def plain_mixed(h):
    return (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & MASK


def plain_grams(text, bits):
    """(family, bucket) of every n-gram, one at a time."""
    out = []
    for n in (1, 2, 3):
        for i in range(len(text) - n + 1):
            h = 0
            for k, c in enumerate(text[i : i + n], 1):
                h = (h * 0x100000001B3 + ord(c) + k) & MASK
            out.append((0, plain_mixed(h) >> (64 - bits)))
    hashes = []
    for w in text.split():
        h = plain_mixed(sum((ord(c) + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, c in enumerate(w)) & MASK)
        hashes.append(h ^ h >> 32)
    out += [(1, h >> (64 - bits)) for h in hashes]
    part = [plain_mixed(h) >> (64 - bits // 2) for h in hashes]
    return out + [(2, (a << bits // 2) + b) for a, b in zip(part, part[1:])]


def plain_ratios(docs, good, bits):
    """The log ratio of every text of one language, from counts in dicts."""
    own = {i: plain_grams(t, bits) for i, t in docs.items()}
    raw, target = Counter(), Counter()
    for i, g in own.items():
        raw.update(g)
        target.update(g if i in good else [])
    n = [sum(c for (f, _), c in target.items() if f == k) for k in range(3)]
    m = [sum(c for (f, _), c in raw.items() if f == k) for k in range(3)]
    out = {}
    for i, g in own.items():
        mean = [[], [], []]
        for f, b in g:
            mean[f].append(log(target[f, b] + M.SMOOTHING) - log(raw[f, b] * n[f] / m[f] + M.SMOOTHING))
        out[i] = sum(sum(x) / len(x) for x in mean if x) * min(len(mean[1]), M.LENGTH)
    return out


def test_scores_and_sample_against_plain_models(spark, make_docs, corpus):
    docs = dict(corpus[:200])
    few = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(100)], "doc_id long, quality int")
    got = {r.doc_id: r for r in M.resample(make_docs(corpus[:200]), few, k=150).select("doc.doc_id", "log_ratio", "key", "kept").collect()}
    want = plain_ratios(docs, {i for i in range(100) if i % 5}, M.BITS)
    assert all(got[i].log_ratio == pytest.approx(want[i], abs=1e-4) for i in docs)
    noisy = {i: want[i] + M.gumbel(np.array([i]))[0] for i in docs}
    assert {i for i in docs if got[i].kept} == set(sorted(docs, key=lambda i: -noisy[i])[:150])


def test_samples_of_two_seeds_follow_the_ratios(spark, make_docs):
    """Texts of every mixture of two styles: other seeds keep other texts, the likelier the higher the ratio."""
    rng = random.Random(5)
    style = lambda p: " ".join(rng.choice("abcd" if rng.random() < p else "wxyz") * 3 for _ in range(30))
    docs = [(i, style(i % 20 / 19)) for i in range(400)]
    few = spark.createDataFrame([(i, int(rng.random() < (i % 20 / 19) ** 2)) for i in range(400)], "doc_id long, quality int")
    runs = []
    for seed in range(12):
        rows = M.resample(make_docs(docs), few, seed=seed, k=120).select("doc.doc_id", "log_ratio", "kept").collect()
        runs.append({r.doc_id: r.kept for r in rows})
        ratio = {r.doc_id: r.log_ratio for r in rows}
    assert all(sum(r.values()) == 120 for r in runs)
    both = [i for i in ratio if runs[0][i] and runs[1][i]]
    assert 30 < len(both) < 117
    rate = [np.mean([r[i] for r in runs]) for i in ratio]
    order = np.argsort(list(ratio.values()))
    fourths = [np.mean(np.array(rate)[part]) for part in np.array_split(order, 4)]
    assert fourths == sorted(fourths) and fourths[3] > fourths[0] + 0.3
    # the rate of k draws without replacement, by drawing
    weight = np.exp(np.array([ratio[i] for i in ratio]))
    drawn = np.zeros(len(weight))
    gen = np.random.default_rng(1)
    for _ in range(300):
        drawn[gen.choice(len(weight), 120, replace=False, p=weight / weight.sum())] += 1 / 300
    want = [np.mean(drawn[part]) for part in np.array_split(order, 4)]
    assert np.allclose(fourths, want, atol=0.06)


def test_languages_without_models_use_the_pooled_one(spark, make_docs, corpus):
    """Junk in no language or a rare one goes, clean texts of these stay."""
    rng = random.Random(8)
    other = ["".join(rng.choice("klmnopqrst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = [(i, t, "en", "s") for i, t in corpus]
    rows += [(1000 + i, t, None if i % 2 else "rare", "s") for i, t in corpus[:60]]
    rows += [(2000 + i, " ".join(rng.choice(other) for _ in range(80)) + ".", "xx", "s") for i in range(40)]
    rows += [(3000 + i, " ".join(rng.choice(other).upper() + "!!" for _ in range(80)), "xx", "s") for i in range(10)]
    kept = {r.doc_id: r.kept for r in M.resample(make_docs(rows), labels(spark)).select("doc.doc_id", "kept").collect()}
    clean = [kept[1000 + i] for i in range(60) if i % 5]
    junk = [kept[1000 + i] for i in range(60) if i % 5 == 0]
    assert np.mean(clean) > 0.95 and np.mean(junk) < 0.1
    assert np.mean([kept[2000 + i] for i in range(40)]) > 0.9 and np.mean([kept[3000 + i] for i in range(10)]) < 0.2


def test_expected_good_and_curve(spark):
    x = np.arange(-20, 21) / 4
    p = 1 / (1 + np.exp(-(1.5 * x - 2)))
    slope, base = M.logistic(x, 1000 * p, 1000 * (1 - p))
    assert slope == pytest.approx(1.5, abs=0.02) and base == pytest.approx(-2, abs=0.02)
    assert M.logistic(np.array([-5.0, 5.0]), np.array([0.0, 9.0]), np.array([9.0, 0.0]))[0] > 0.3
    rng = random.Random(3)
    values = [(i, rng.gauss(0, 3)) for i in range(4000)]
    good = {i: rng.random() < 1 / (1 + exp(-v)) for i, v in values}
    rows = spark.createDataFrame([(i, v, 1) for i, v in values] + [(None, 0.0, None)], "id long, log_ratio double, key long")
    few = spark.createDataFrame([(i, int(good[i])) for i, _ in values[:2000]] + [(5, None), (None, 1)], "doc_id long, quality int")
    assert M.expected_good(rows, few) == pytest.approx(sum(good.values()), rel=0.05)
    assert M.expected_good(rows, few.where("quality = 1")) == 4000


def test_pieces_do_not_change_the_ngrams():
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(2500)), "", "one two", " " * 9000 + "end"]
    whole, cut = (Counter((f, b, t) for f, bs, ts in M.grams(texts, size=size) for b, t in zip(bs.tolist(), ts.tolist(), strict=True)) for size in (1 << 20, 5000))
    assert whole == cut and sum(whole.values()) == sum(len(plain_grams(t, M.BITS)) for t in texts)


def test_order_keys_and_kth_largest(spark):
    x = np.array([-np.inf, -2.5, -1e-300, -0.0, 0.0, 1e-9, 3.0, 1e300])
    key = M.order_key(x)
    assert (np.diff(key) >= 0).all() and key[3] == key[4]
    rng = random.Random(2)
    values = [rng.choice((rng.getrandbits(63), -rng.getrandbits(63), 5, -5)) for _ in range(500)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "key long")
    order = sorted((v for v in values if v is not None), reverse=True)
    for k in (1, 2, 77, 499, 500):
        assert M.kth_largest(df, k) == order[k - 1]
    assert M.kth_largest(df, 0) is None


def test_odd_rows_and_no_labels(spark, make_docs, odd):
    docs = make_docs([(None, t, None, None) for t in odd]).withColumns({"doc": F.lit(1), "key": F.lit(2), "kept": F.lit(3), "a.b": F.lit(4), "my col": F.lit(5), "my-col": F.lit(6), "x`y": F.lit(7)})
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = M.resample(docs, none)
    assert out.count() == len(odd) and out.where("kept").count() == sum(bool((t or "").strip()) for t in odd)
    assert out.select("doc.*").columns == docs.columns
    assert M.resample(make_docs([]), none).count() == 0
