import random
from collections import Counter
from math import exp, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayspark.llm import language_id, quality_rules, url_filter


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert got.where("lang = lang_pred").count() / got.count() > 0.97


def test_language_odd_rows(spark, make_docs, odd):
    docs = make_docs([(i, t, "en", "s") for i, t in enumerate(odd)] + [(None, "abc", "fr", None)])
    model = language_id.train(docs)
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2, 11))
    assert got[3].lang_pred in ("en", "fr") and 0 < got[3].score <= 1
    nothing = language_id.train(make_docs([]))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(make_docs([]), model).count() == 0


def plain_bucket(gram, bits):
    h = 0
    for n, c in enumerate(gram, 1):
        h = (h * 0x100000001B3 + ord(c) + n) % 2**64
    return (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64 >> (64 - bits)


def plain_bayes(rows, texts):
    """Language and score of each text, learned and scored n-gram by n-gram with dicts."""
    bits, alpha = language_id.BITS, language_id.SMOOTHING
    grams = lambda t: [plain_bucket(t[i : i + n], bits) for t in [t.lower()] for n in (1, 2, 3) for i in range(len(t) - n + 1)]
    counts, docs = {}, Counter(x for _, x in rows)
    for t, x in rows:
        counts.setdefault(x, Counter()).update(grams(t))
    out = []
    for t in texts:
        if not any(c.isalpha() for c in t):
            out.append(("und", 0.0))
            continue
        s = {x: log(docs[x] / len(rows)) + sum(log((c[g] + alpha) / (c.total() + alpha * 2**bits)) for g in grams(t)) for x, c in counts.items()}
        best = min(s, key=lambda x: (-s[x], x))
        out.append((best, 1 / sum(exp((v - s[best]) / 3) for v in s.values())))
    return out


def test_language_against_plain_bayes(make_docs):
    """Counts, priors, scores and ties (to the language that sorts first), learned over several tasks."""
    rng = random.Random(6)
    letters = {"a": "abcdeé", "b": "bcdefß", "c": "cdefgh"}
    say = lambda x, n: "".join(rng.choice(letters[x] + " ") for _ in range(n)).title()
    rows = [(say(x, rng.randint(0, 60)), x) for x in "aabbbc" * 15] + [("zzz", "a"), ("zzz", "b")]
    texts = [say(rng.choice("abc"), rng.randint(1, 25)) for _ in range(80)] + ["", "12 !", "\u0130x", "zzz"]
    model = language_id.train(make_docs([(i, t, x, "s") for i, (t, x) in enumerate(rows)], parts=4))
    got = {r.doc_id: r for r in language_id.predict(make_docs(texts), model).collect()}
    for i, (lang, score) in enumerate(plain_bayes(rows, texts)):
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=1e-9)
    same = language_id.train(make_docs([(0, "xyz", "q", "s"), (1, "xyz", "p", "s")]))
    assert [r.lang_pred for r in language_id.predict(make_docs(["xyz"]), same).collect()] == ["p"]


def test_language_scores_do_not_depend_on_pieces(make_docs):
    model = language_id.train(make_docs([(0, "the cat sat", "en", "s"), (1, "die katze saß", "de", "s")]))
    text = "the cat die katze " * 1000
    assert np.allclose(model.scores([text, "saß"]), model.scores([text, "saß"], 5000), rtol=1e-12)


def test_repeated_words_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        words = [rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 60))]
        seen: dict = {}
        for i in range(len(words) - 7):
            seen.setdefault(tuple(words[i : i + 8]), []).append(i)
        cover = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
        assert quality_rules.repeated_words(words) == len(cover)


def test_rules_odd_rows(make_docs, odd):
    docs = make_docs([(None, t, None, None) for t in odd]).withColumn("ratio", F.lit(1))
    rows = quality_rules.quality_rules(docs).collect()
    assert len(rows) == len(odd) and sum(r.n_words == 0 for r in rows) == 4
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 20)
    assert quality_rules.quality_rules(make_docs([])).count() == 0


def test_sources_have_fences_of_their_own(make_docs):
    """The same text passes where its like is common, and fails where it isn't; small groups lean on all."""
    plain = lambda i: f"word{i % 7} " * 5 + " ".join(f"w{i}x{k}" for k in range(30))
    marked = lambda i: plain(i) + " # a$ % b|"
    rows = [(i, marked(i) if i % 3 else plain(i), "en", "code") for i in range(300)]
    rows += [(1000 + i, marked(i) if i % 50 == 0 else plain(i), "en", "news") for i in range(1000)]
    rows += [(2000 + i, marked(i), "en", "few") for i in range(2)]
    out = {r.doc_id: r for r in quality_rules.quality_rules(make_docs(rows)).collect()}
    assert all(out[i].kept for i in range(300))
    assert all(out[1000 + i].kept == (i % 50 != 0) for i in range(1000))
    assert all(out[2000 + i].kept for i in range(2))
    sketch = quality_rules.sketches(quality_rules.with_counts(make_docs(rows)))
    high = {(r.source, r.ratio): r.high for r in quality_rules.fences(sketch).collect()}
    assert high["news", "symbol_share"] < high["few", "symbol_share"] < high["code", "symbol_share"]


def test_fences_against_plain_quantiles(make_docs):
    rng = random.Random(9)
    rows = [(i, " ".join("w" * rng.randint(1, 9) + rng.choice(["", "", "#", "."]) for _ in range(rng.randint(20, 60))), rng.choice(["en", "fr"]), rng.choice("abc")) for i in range(200)]
    counts = quality_rules.with_counts(make_docs(rows))
    got = {(r.lang, r.source, r.ratio): (r.low, r.high) for r in quality_rules.fences(quality_rules.sketches(counts)).collect()}
    own = {r.doc_id: r for r in counts.collect()}
    for ratio, top, bottom, scale, level, two_sided in (("word_length", "word_chars", "n_words", 1000, 0.9, True), ("symbol_share", "n_symbols", "word_chars", 10**6, 0.9, False), ("repeat_share", "n_repeat_words", "n_words", 10**6, 0.99, False)):
        def quantiles(pick):
            v = sorted(scale * own[i][top] // own[i][bottom] for i, _, x, s in rows if pick(x, s) and 100 * own[i].n_repeat_words <= 30 * own[i].n_words)
            v = [x - x % (1 << max(0, x.bit_length() - 7)) for x in v]
            at = lambda p: v[max(0, -(-round(p * 1000) * len(v) // 1000) - 1)]
            return len(v), at(1 - level), at(level)
        blend = lambda n, q, parent: (n * q + 200 * parent) // (n + 200)
        every = quantiles(lambda x, s: True)
        for lang in ("en", "fr"):
            n, *q = quantiles(lambda x, s: x == lang)
            mid = [blend(n, a, b) for a, b in zip(q, every[1:])]
            for source in "abc":
                n, *q = quantiles(lambda x, s: (x, s) == (lang, source))
                low, high = (blend(n, a, b) for a, b in zip(q, mid))
                assert got[lang, source, ratio] == (low - 2 * (high - low) if two_sided else None, high + 2 * (high - low))


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"h{i}.example.com" for i in range(3000)]
    universe, listed = (spark.createDataFrame([(k,) for k in x], "key string") for x in (keys, keys[::3] + ["elsewhere.org", None]))
    c = url_filter.build_cascade(universe, listed, bits_per_key=3, n_hashes=2)
    assert len(c.levels) > 2
    assert c.contains(keys).tolist() == [i % 3 == 0 for i in range(3000)]
    assert url_filter.build_cascade(universe, listed.limit(0)).contains(keys[:5]).tolist() == [False] * 5


def test_urls(spark):
    rows = [(1, "http://A.Example.com/en/7x?q#f"), (2, "https://b.example.net/de/81"), (3, "x://org/es/"), (4, None), (5, "no scheme"), (6, "http://ads-track.example.com"), (7, "http://y.ads-track.example.com/#a://b"), (8, ""), (8, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("z"))
    listed = spark.createDataFrame([(x,) for x in url_filter.BLOCKED_DOMAINS], "key string")
    for limit in (1 << 20, 0):  # by the cascade, and by the join for lists too large to broadcast
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, listed, max_bytes=limit).collect()}
        assert got == {
            1: ("a.example.com", "/en/7x", "example.com/en/7", "allow"), 2: ("b.example.net", "/de/81", "example.net/de/8", "block"), 3: ("org", "/es/", "org/es/", "block"),
            4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("ads-track.example.com", "", None, "block"), 7: ("y.ads-track.example.com", "/", None, "block"), 8: ("", "", None, "allow"),
        }


def test_every_rule_its_subdomains_and_neighbours(spark):
    """The five rules of the query: their host, a subdomain, a neighbour, another path, and both overrides."""
    want = {
        "http://com/en/": ("com/en/", "block"), "http://a.com/en/1": ("com/en/", "block"), "http://xcom/en/1": (None, "allow"), "http://a.com/fr/en/": (None, "allow"), "http://a.com/en": (None, "allow"),
        "http://example.com/en/7": ("example.com/en/7", "allow"), "http://w.example.com/en/70": ("example.com/en/7", "allow"), "http://xexample.com/en/7": ("com/en/", "block"), "http://example.com/en/6": ("com/en/", "block"),
        "http://net/de/": ("net/de/", "allow"), "http://a.net/de/8": ("net/de/", "allow"), "http://xnet/de/": (None, "allow"), "http://a.net/DE/8": (None, "allow"),
        "http://example.net/de/8": ("example.net/de/8", "block"), "http://W.Example.NET/de/81#x": ("example.net/de/8", "block"), "http://xexample.net/de/8": ("net/de/", "allow"), "http://example.net/de/7": ("net/de/", "allow"),
        "http://org/es/": ("org/es/", "block"), "http://a.org/es/?x": ("org/es/", "block"), "http://xorg/es/": (None, "allow"), "http://a.org/es": (None, "allow"),
        # a listed domain is blocked unless a rule says otherwise
        "http://ads-track.example.com/en/7": ("example.com/en/7", "allow"), "http://adult-x.example.net/de/1": ("net/de/", "allow"), "http://adult-x.example.net/x": (None, "block"),
    }
    pages = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    listed = spark.createDataFrame([(x,) for x in url_filter.BLOCKED_DOMAINS], "key string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, listed).collect()}
    assert {u: got[i] for i, u in enumerate(want)} == want
