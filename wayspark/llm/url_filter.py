"""Operator 10, URL filters: exact block lists by a cascade of Bloom filters.

Level 1 encodes the listed keys. Every key of the corpus's universe that passes level 1
without being listed is a false positive and goes into level 2, listed keys that pass
level 2 go into level 3, and so on until a level passes no key that it should not. Over
that universe the cascade answers exactly, so judging a page needs no join.

Keys are hosts and their parent domains; a listed domain covers all its subdomains.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule
and is allowed. An empty block list gives an empty cascade (nothing listed). Repeated
pages are judged alike. Columns of ``pages`` other than those named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspark.functions.durable import durable, release

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host and path prefix); the part before the first slash is the host.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)

#: Domains that the query blocks by default.
BLOCKED_DOMAINS = (
    "casino-win.example.com",
    "free-bets.example.com",
    "ads-track.example.com",
    "spam-farm.example.com",
    "cheap-pills.example.com",
    "adult-x.example.net",
)

#: A cascade above this size isn't broadcast; membership is then found by a semi-join.
MAX_CASCADE_BYTES = 64 << 20


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``; A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?`` or ``#``."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value).otherwise(found)
    return found


def suffixes_of(host: Column) -> Column:
    """The host and all its parent domains, as an array; empty for an empty host."""
    parts = F.split(host, r"\.")
    every = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
    )
    return F.when(host != "", every).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Level:
    n_bits: int
    n_hashes: int
    words: np.ndarray

    def bits_of(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Positions, one row for each key."""
        steps = np.arange(self.n_hashes, dtype=np.uint64)
        with np.errstate(over="ignore"):
            return (h1[:, None] + steps * (h2[:, None] | np.uint64(1))) % np.uint64(self.n_bits)

    def passes(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = self.bits_of(h1, h2)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def _hashes(keys, level: int) -> tuple[np.ndarray, np.ndarray]:
    both = [xxhash.xxh3_128_intdigest(k, seed=level) for k in keys]
    low = np.array([x & 0xFFFFFFFFFFFFFFFF for x in both], dtype=np.uint64)
    return low, np.array([x >> 64 for x in both], dtype=np.uint64)


@dataclass(frozen=True)
class Cascade:
    """Levels of alternating sense: odd ones encode listed keys, even ones the others."""

    levels: tuple[Level, ...]

    @property
    def n_bytes(self) -> int:
        return sum(x.words.nbytes for x in self.levels)

    def contains(self, keys) -> np.ndarray:
        """Exact for every key of the universe that the cascade was built over."""
        listed = np.zeros(len(keys), dtype=bool)
        open_ = np.arange(len(keys))
        for k, level in enumerate(self.levels, 1):
            if not len(open_):
                break
            passed = level.passes(*_hashes([keys[i] for i in open_], k))
            listed[open_[~passed]] = k % 2 == 0
            open_ = open_[passed]
        listed[open_] = len(self.levels) % 2 == 1
        return listed


def _encode(keys: DataFrame, level: int, bits_per_key: int, n_hashes: int, max_bytes: int) -> Level | None:
    """Build one level: positions are found in tasks and OR-ed by word, map side first."""
    n = keys.count()
    if n == 0:
        return None
    n_bits = max(64, -(-n * bits_per_key // 64) * 64)
    if n_bits // 8 > max_bytes:
        raise OverflowError(f"level {level} takes {n_bits // 8} bytes")
    shape = Level(n_bits, n_hashes, np.zeros(0, dtype=np.uint64))

    def words_of(batches):
        for batch in batches:
            at = shape.bits_of(*_hashes(batch.column("key").to_pylist(), level)).ravel()
            bit = np.left_shift(np.uint64(1), at & np.uint64(63)).view(np.int64)
            yield pa.RecordBatch.from_pydict({"word": pa.array((at >> np.uint64(6)).astype(np.int64)), "bits": pa.array(bit)})

    rows = keys.select("key").mapInArrow(words_of, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    words = np.zeros(n_bits // 64, dtype=np.uint64)
    found = rows.toPandas()
    words[found["word"].to_numpy()] = found["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return Level(n_bits, n_hashes, words)


def build_cascade(
    universe: DataFrame, listed: DataFrame, bits_per_key: int = 10, n_hashes: int = 4, max_bytes: int = MAX_CASCADE_BYTES
) -> Cascade:
    """Cascade for the keys (column ``key``) of ``listed`` over those of ``universe``.

    What reaches the driver is one bitset a level: its size follows the list and is
    checked against ``max_bytes`` before it is built; OverflowError beyond that.
    """
    listed = listed.select("key").where("key is not null").distinct()
    universe = universe.select("key").where("key is not null").distinct()
    levels: list[Level] = []
    inside, outside = listed, universe.join(listed, "key", "left_anti")
    kept: list[DataFrame] = []
    while (level := _encode(inside, len(levels) + 1, bits_per_key, n_hashes, max_bytes)) is not None:
        levels.append(level)
        if sum(x.words.nbytes for x in levels) > max_bytes:
            raise OverflowError("the cascade exceeds max_bytes")
        k = len(levels)
        shared = universe.sparkSession.sparkContext.broadcast(level)

        def passing(batches, k=k, shared=shared):
            for batch in batches:
                keys = batch.column("key")
                yield pa.RecordBatch.from_pydict({"key": keys.filter(pa.array(shared.value.passes(*_hashes(keys.to_pylist(), k))))})

        wrong = durable(outside.mapInArrow(passing, "key string"), "cascade")
        kept.append(wrong)
        inside, outside = wrong, inside
    for table in kept:
        release(table)
    return Cascade(tuple(levels))


def listed_hosts(hosts: DataFrame, listed: DataFrame, max_bytes: int = MAX_CASCADE_BYTES) -> DataFrame:
    """``hosts`` with boolean ``listed``: whether the host or a parent domain is listed.

    The universe is every host of ``hosts`` with its parents. Lists whose cascade would
    exceed ``max_bytes`` are looked up with a join on the distinct hosts instead.
    """
    spark = hosts.sparkSession
    distinct = hosts.select("host").distinct()
    universe = distinct.select(F.explode(suffixes_of(F.col("host"))).alias("key")).distinct()
    try:
        cascade = build_cascade(durable(universe, "hosts"), listed, max_bytes=max_bytes)
    except OverflowError:
        hit = (
            distinct.select("host", F.explode(suffixes_of(F.col("host"))).alias("key"))
            .join(listed.select("key").distinct(), "key", "left_semi").select("host").distinct()
        )
        return hosts.join(hit.withColumn("listed", F.lit(True)), "host", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    shared = spark.sparkContext.broadcast(cascade)

    @F.pandas_udf("boolean")
    def is_listed(host: pd.Series) -> pd.Series:
        codes, names = pd.factorize(host)
        keys: dict[str, int] = {}
        owners, wanted = [], []
        for i, name in enumerate(names):
            while name:
                owners.append(i)
                wanted.append(keys.setdefault(name, len(keys)))
                name = name.partition(".")[2]
        hit = shared.value.contains(list(keys))
        any_ = np.zeros(len(names) + 1, dtype=bool)
        np.logical_or.at(any_, owners, hit[wanted] if len(keys) else [])
        return pd.Series(any_[codes])

    return hosts.withColumn("listed", is_listed("host"))


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES, max_bytes: int = MAX_CASCADE_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict for every page.

    The longest fitting rule decides; without one a listed domain is blocked and any
    other page allowed. ``rules`` is a short list (it becomes one expression).
    """
    hosts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = listed_hosts(hosts, listed, max_bytes).withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return found.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    listed = spark.createDataFrame([(x,) for x in BLOCKED_DOMAINS], "key string")
    return judge_urls(pages, listed)


#: The rules and the domains written out, apart from RULES and BLOCKED_DOMAINS.
ORACLE = """
with r as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
f as (select *, case
  when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/7') then 'example.com/en/7'
  when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/de/8') then 'example.net/de/8'
  when (host = 'com' or host like '%.com') and starts_with(path, '/en/') then 'com/en/'
  when (host = 'net' or host like '%.net') and starts_with(path, '/de/') then 'net/de/'
  when (host = 'org' or host like '%.org') and starts_with(path, '/es/') then 'org/es/'
  end as rule from h)
select page_id, host, path, rule, case
  when rule in ('example.com/en/7', 'net/de/') then 'allow'
  when rule in ('com/en/', 'example.net/de/8', 'org/es/') then 'block'
  when regexp_matches(host, '(^|[.])(casino-win|free-bets|ads-track|spam-farm|cheap-pills)[.]example[.]com$|(^|[.])adult-x[.]example[.]net$') then 'block'
  else 'allow' end as verdict
from f"""

QUERIES = {"op10_url_filters": query}
ORACLE_SQL = {"op10_url_filters": ORACLE}
