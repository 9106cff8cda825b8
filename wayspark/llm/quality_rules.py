"""Operator 6, quality rules: fences taken from the data of each language and source.

Each text gets a few counts. Their ratios are summed up in quantile sketches: a sketch
is a table of counts by bucket (an integer cut to its SUB_BITS leading bits, so a value
is known to 1/2**SUB_BITS of itself). Sketches merge by adding counts, whatever the order,
so Spark's partial aggregation builds them and a retried task changes nothing.

A ratio has a quantile level: the fence lies ``reach`` times the distance between the
quantiles at that level and at its opposite beyond the outer one, so nothing about it is
fixed but the level. Quantiles of a group are blended with those of its language, which
are blended with those of all texts: a group of n texts counts n times, its parent ``prior``
times. Texts outside a fence are not kept.

Edge cases: a null or empty text has no words and fails the base rules; a null language
or source counts as an empty name; repeated rows are counted and judged each; other
columns of ``docs`` are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayspark.functions.durable import durable

SPACES = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?.,;:"
WINDOW = 8
SUB_BITS = 6

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks")

#: ratio: (numerator, denominator, scale, quantile level in thousandths, two-sided)
RATIOS = {
    "word_length": ("word_chars", "n_words", 1_000, 900, True),
    "symbol_share": ("n_symbols", "word_chars", 1_000_000, 900, False),
    "dup_line_share": ("n_dup_lines", "n_lines", 1_000_000, 990, False),
    "repeat_share": ("n_repeat_words", "n_words", 1_000_000, 990, False),
    "marks_per_word": ("n_marks", "n_words", 1_000, 900, False),
}
REACH, PRIOR = 2, 200


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """How many words lie in a ``width``-word window that occurs twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.uint64)
    if len(seen) == len(words):
        return 0
    with np.errstate(over="ignore"):
        key = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            key = key * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n] + np.uint64(1)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    rows = ids[order[:, None] + np.arange(width)] if n <= 4096 else None
    if rows is not None:  # equal keys are compared word by word
        equal = same & (rows[1:] == rows[:-1]).all(axis=1)
    else:
        equal = same.copy()
        at = np.flatnonzero(same)
        for k in range(width):
            equal[at] &= ids[order[at] + k] == ids[order[at + 1] + k]
    hit = np.zeros(n, dtype=bool)
    hit[order[1:][equal]] = True
    hit[order[:-1][equal]] = True
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(hit)
    cover[:-width] += np.bincount(starts, minlength=n)[: len(words) + 1 - width]
    cover[width:] -= np.bincount(starts, minlength=n)
    return int((np.cumsum(cover) > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The values of COUNTS for one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    spaces = len(raw) - len(raw.translate(None, SPACES))
    return (
        len(words),
        len(text or "") - spaces,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(raw) - len(raw.translate(None, MARKS)),
    )


def with_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and COUNTS of every text, in one pass without a shuffle."""

    def run(batches):
        for batch in batches:
            rows = [text_counts(t) for t in batch.column("text").to_pylist()]
            columns = [np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)] or [np.zeros(0, np.int64)] * len(COUNTS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "lang", "source")] + [pa.array(c) for c in columns],
                names=["doc_id", "lang", "source", *COUNTS],
            )

    cols = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"), "text",
    )
    return cols.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def bucket(value: Column, sub_bits: int = SUB_BITS) -> Column:
    """``value`` cut to its leading bits: the lower end of its sketch bucket."""
    step = F.pow(F.lit(2), F.greatest(F.lit(0), F.length(F.bin(value)) - sub_bits - 1)).cast("long")
    return value - value % step


def _ratio(numerator: str, denominator: str, scale: int) -> Column:
    return F.expr(f"{scale} * {numerator} div {denominator}")


def sketches(counts: DataFrame) -> DataFrame:
    """lang, source, ratio, bucket, n over the texts that pass the base rules."""
    values = [
        F.struct(F.lit(name).alias("ratio"), bucket(_ratio(a, b, scale)).alias("bucket"))
        for name, (a, b, scale, _, _) in RATIOS.items()
    ]
    return (
        counts.where(~base_failed()).select("lang", "source", F.explode(F.array(*values)).alias("v"))
        .groupBy("lang", "source", "v.ratio", "v.bucket").agg(F.count("*").alias("n"))
    )


def fences(sketch: DataFrame, reach: int = REACH, prior: int = PRIOR) -> DataFrame:
    """lang, source, ratio, low, high: one row for each group that has a sketch.

    All numbers are whole, so fences are exact.
    """
    level = F.create_map(*(F.lit(x) for name, r in RATIOS.items() for x in (name, r[3])))[F.col("ratio")]

    def quantiles(table: DataFrame, by: list[str], name: str) -> DataFrame:
        merged = table.groupBy(*by, "ratio", "bucket").agg(F.sum("n").alias("n"))
        w = W.partitionBy(*by, "ratio")
        cum = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
        at = lambda part: F.min(F.when(1000 * F.col("upto") >= part * F.col("total"), F.col("bucket")))
        return cum.groupBy(*by, "ratio").agg(F.max("total").alias(f"{name}_n"), at(1000 - level).alias(f"{name}_low"), at(level).alias(f"{name}_high"))

    both = quantiles(sketch, ["lang", "source"], "own").join(quantiles(sketch, ["lang"], "lang"), ["lang", "ratio"]).join(quantiles(sketch, [], "all"), "ratio")
    blend = lambda n, own, parent: F.expr(f"({n} * {own} + {prior} * {parent}) div ({n} + {prior})")
    for side in ("low", "high"):
        both = both.withColumn("parent", blend("lang_n", f"lang_{side}", f"all_{side}")).withColumn(side, blend("own_n", f"own_{side}", "parent"))
    spread = reach * (F.col("high") - F.col("low"))
    two_sided = [name for name, r in RATIOS.items() if r[4]]
    return both.select("lang", "source", "ratio", (F.col("high") + spread).alias("high"), F.when(F.col("ratio").isin(two_sided), F.col("low") - spread).alias("low"))


def quality_rules(docs: DataFrame, reach: int = REACH, prior: int = PRIOR, broadcast_groups: int = 50_000) -> DataFrame:
    """Every document with its counts, ``base_failed`` and ``kept``.

    The fences are joined by language and source: broadcast up to ``broadcast_groups``
    groups, with a shuffled join (whose hot groups AQE splits) beyond.
    """
    counts = durable(with_counts(docs), "counts")
    limits = fences(sketches(counts), reach, prior).groupBy("lang", "source").agg(
        *(F.max(F.when(F.col("ratio") == name, F.col(side))).alias(f"{name}_{side}") for name in RATIOS for side in ("low", "high"))
    )
    limits = durable(limits, "fences")
    small = limits.count() <= broadcast_groups
    joined = counts.join(F.broadcast(limits) if small else limits, ["lang", "source"], "left")
    inside = F.lit(True)
    for name, (a, b, scale, _, two_sided) in RATIOS.items():
        value = _ratio(a, b, scale)
        inside = inside & (value <= F.col(f"{name}_high"))
        if two_sided:
            inside = inside & (value >= F.col(f"{name}_low"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), F.when(base_failed(), False).otherwise(F.coalesce(inside, F.lit(True))).alias("kept"),
        "n_lines", "n_marks",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Written out, apart from the constants above.
ORACLE = r"""
with t as (select row_number() over () as row_id, doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
g as (select row_id, i, array_to_string(words[i:i+7], ' ') as gram
      from (select row_id, words, unnest(range(1, len(words) - 6)) as i from w where len(words) >= 8)),
m as (select row_id, i from (select row_id, i, count(*) over (partition by row_id, gram) as k from g) where k > 1),
p as (select row_id, count(distinct i + d) as n_repeat_words from m, range(8) r(d) group by row_id),
b as (select row_id, doc_id, lang, source, len(words)::BIGINT as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT as word_chars,
      (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT as n_symbols,
      (len(lines) - len(list_distinct(lines)))::BIGINT as n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT as n_repeat_words,
      len(lines)::BIGINT as n_lines, (length(text) - length(regexp_replace(text, '[!?.,;:]', '', 'g')))::BIGINT as n_marks
      from w left join p using (row_id)),
c as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from b),
v as (select lang, source, unnest([
        {'ratio': 'word_length', 'p': 900, 'v': (1000 * word_chars) // n_words}, {'ratio': 'symbol_share', 'p': 900, 'v': (1000000 * n_symbols) // word_chars},
        {'ratio': 'dup_line_share', 'p': 990, 'v': (1000000 * n_dup_lines) // n_lines}, {'ratio': 'repeat_share', 'p': 990, 'v': (1000000 * n_repeat_words) // n_words},
        {'ratio': 'marks_per_word', 'p': 900, 'v': (1000 * n_marks) // n_words}], recursive := true) from c where not base_failed),
sk as (select *, (v // step) * step as bucket from (select *, (1::BIGINT << greatest(0, length(ltrim(bin(v), '0')) - 7)) as step from v)),
own as (select lang, source, ratio, max(n) as n, min(bucket) filter (1000 * i >= (1000 - p) * n) as low, min(bucket) filter (1000 * i >= p * n) as high
  from (select *, row_number() over (partition by lang, source, ratio order by bucket) as i, count(*) over (partition by lang, source, ratio) as n from sk) group by lang, source, ratio),
per_lang as (select lang, ratio, max(n) as n, min(bucket) filter (1000 * i >= (1000 - p) * n) as low, min(bucket) filter (1000 * i >= p * n) as high
  from (select *, row_number() over (partition by lang, ratio order by bucket) as i, count(*) over (partition by lang, ratio) as n from sk) group by lang, ratio),
every as (select ratio, max(n) as n, min(bucket) filter (1000 * i >= (1000 - p) * n) as low, min(bucket) filter (1000 * i >= p * n) as high
  from (select *, row_number() over (partition by ratio order by bucket) as i, count(*) over (partition by ratio) as n from sk) group by ratio),
up as (select l.lang, ratio, (l.n * l.low + 200 * e.low) // (l.n + 200) as low, (l.n * l.high + 200 * e.high) // (l.n + 200) as high from per_lang l join every e using (ratio)),
z as (select o.lang, o.source, ratio, (o.n * o.low + 200 * u.low) // (o.n + 200) as low, (o.n * o.high + 200 * u.high) // (o.n + 200) as high from own o join up u using (lang, ratio)),
f as (select lang, source, max(high + 2 * (high - low)) filter (ratio = 'word_length') as long_, min(low - 2 * (high - low)) filter (ratio = 'word_length') as short_,
      max(high + 2 * (high - low)) filter (ratio = 'symbol_share') as symbols, max(high + 2 * (high - low)) filter (ratio = 'dup_line_share') as dups,
      max(high + 2 * (high - low)) filter (ratio = 'repeat_share') as repeats, max(high + 2 * (high - low)) filter (ratio = 'marks_per_word') as marks from z group by all)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       case when base_failed then false else (1000 * word_chars) // n_words between short_ and long_ and (1000000 * n_symbols) // word_chars <= symbols
         and (1000000 * n_dup_lines) // n_lines <= dups and (1000000 * n_repeat_words) // n_words <= repeats and (1000 * n_marks) // n_words <= marks end as kept, n_lines, n_marks
from c left join f using (lang, source)
"""

QUERIES = {"op6_quality_rules": query}
ORACLE_SQL = {"op6_quality_rules": ORACLE}
