"""Operator 13, repair of conversation structure by error-correcting Earley parsing.

The roles of a conversation should read ``(s?(ua)+)?``: PRODUCTIONS, to which the parser adds
productions that delete a turn, give it another role or insert an empty one, each at a cost.
The grammar is left-linear, so all chart items begin at the first turn and a column of the
chart holds one completed item a nonterminal: its least (cost, audit), the audit being the
initials of the edits so far. Two audits of one cost over the same turns are never the one
the beginning of the other, so the least item of a column is enough for what follows.

Rows are hashed by conversation, sorted and read as a stream; a conversation is held while
it is parsed. One with more than LONG_TURNS turns or LONG_BYTES of text isn't: it is dealt
by ranges of turns, its chunks of CHUNK turns are parsed from every nonterminal that they may
begin with, and the results are put together in a tree. Only its turns then pass through one
task, as a stream that holds none, in the order that any digest of it needs.

Edge cases: a null role or text is one space, so its text is blank and its role unknown.
Rows without conv_id are one conversation; null turns come first. Turns of equal number are
ordered by role and then by a hash of the text; of repeated rows all but the first are
duplicates. Very long texts are never split, only moved. Other columns are ignored. An empty
table gives no rows; a conversation without rows gives a report of zeros. A role of no
characters is as unknown as one with another initial.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspark.functions.durable import durable, release

#: Nonterminals: nothing yet, a system turn, an open question, a complete dialogue.
EMPTY, SYSTEM, OPEN, DONE = range(4)
#: (left side, nonterminal it begins with, initial of the role that follows).
PRODUCTIONS = ((SYSTEM, EMPTY, "s"), (OPEN, EMPTY, "u"), (OPEN, SYSTEM, "u"), (OPEN, DONE, "u"), (DONE, OPEN, "a"))
ACCEPT = (EMPTY, DONE)
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LEGAL = {"su", "ua", "au"}

LONG_TURNS, LONG_BYTES = 1024, 64 << 20
CHUNK, FAN_IN = 1024, 64
#: Conversations that a broadcast may name.
MAX_BROADCAST = 100_000

_AFTER = {n: [(left, t) for left, begin, t in PRODUCTIONS if begin == n] for n in range(4)}
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
SCHEMA = "conv_id {conv}, pos long, edit string, role string, text string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"

Column = dict[int, tuple[int, str]]


def insert_turns(column: Column) -> Column:
    """Complete the items that inserted turns lead to."""
    todo = list(column)
    while todo:
        cost, audit = column[begin := todo.pop()]
        for left, t in _AFTER[begin]:
            if t in ROLES and (item := (cost + INSERT, audit + "I")) < column.get(left, (1 << 62, "")):
                column[left] = item
                todo.append(left)
    return column


def read_turn(column: Column, initial: str, fault: str) -> Column:
    """The next column: items whose next role this turn has, takes or, deleted, leaves open."""
    out: Column = {}
    extra = TRUNCATED if fault == "t" else 0
    for begin, (cost, audit) in column.items():
        found = [(begin, (cost + DELETE, audit + "D"))]
        if fault not in ("b", "d"):
            for left, t in _AFTER[begin]:
                if t == initial:
                    found.append((left, (cost + KEEP + extra, audit + "K")))
                elif t in ROLES:
                    found.append((left, (cost + REROLE + extra, audit + "R")))
        for left, item in found:
            if left not in out or item < out[left]:
                out[left] = item
    return insert_turns(out)


def parse(turns: Iterable[tuple[str, str]], begin: int = EMPTY) -> Column:
    """The last column of the chart over (initial, fault) of the turns, from ``begin`` completed."""
    column = insert_turns({begin: (0, "")})
    for initial, fault in turns:
        column = read_turn(column, initial, fault)
    return column


def best(column: Column) -> tuple[int, str]:
    return min(column[n] for n in ACCEPT if n in column)


@lru_cache(maxsize=1 << 14)
def cheapest(turns: tuple[tuple[str, str], ...]) -> tuple[int, str]:
    return best(parse(turns))


class Repair:
    """Counts the faults of a conversation's turns and applies an audit to them, one at a time."""

    def __init__(self, conv, audit: str, cost: int):
        self.conv, self.audit, self.at, self.open, self.pos = conv, audit, 0, False, 0
        self.count = dict.fromkeys("bdt", 0)
        self.illegal, self.last, self.cost = 0, None, cost
        self.low = self.high = self.turn = None
        self.distinct = 0

    def _line(self, edit: str, role: str, text: str) -> tuple:
        self.pos += 1
        return (self.conv, self.pos, edit, role, text, *[None] * 7)

    def _inserted(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            yield self._line("I", ROLES["a" if self.open else "u"], "")
            self.open, self.at = not self.open, self.at + 1

    def turn_of(self, turn, role: str, text: str, fault: str) -> Iterator[tuple]:
        if fault:
            self.count[fault] += 1
        if self.last is not None and self.last + role[:1] not in LEGAL:
            self.illegal += 1
        self.last = role[:1]
        if turn is not None:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.distinct += turn != self.turn
            self.turn = turn
        yield from self._inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "R":
            role = ROLES["a" if self.open else "u"]
        if edit != "D":
            self.open = role[:1] == "u"
            yield self._line(edit, role, text)

    def report(self) -> Iterator[tuple]:
        yield from self._inserted()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        yield (self.conv, None, None, None, None, gaps, *self.count.values(), self.illegal, self.cost, self.audit)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096, most_bytes: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[4] or "")
        if len(held) >= most or size >= most_bytes:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _streamed(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], lines: Callable[[Iterator[tuple]], Iterator[tuple]]) -> Iterator[pa.RecordBatch]:
    """What ``lines`` makes of the rows of a sorted partition."""
    batches = iter(batches)
    first = next(batches, None)
    if first is not None:
        rows = (r for b in chain([first], batches) for r in zip(*(b.column(n).to_pylist() for n in names), strict=True))
        yield from _batches(lines(rows), _out_schema(first.schema.field("conv_id").type))


def _out_schema(conv: pa.DataType) -> pa.Schema:
    texts = ("edit", "role", "text")
    fields = [("conv_id", conv), ("pos", pa.int64()), *((n, pa.string()) for n in texts), *((n, pa.int64()) for n in COUNTS), ("audit", pa.string())]
    return pa.schema(fields)


def prepared(conversations: DataFrame) -> DataFrame:
    """Rows with nulls replaced and ``fault`` b (blank), t (truncated) or nothing."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), *(["lost"] if "lost" in conversations.columns else [F.lit(False).alias("lost")]))
    last = F.right(F.rtrim("text", F.lit(_SPACES)), F.lit(1))
    return rows.withColumn("fault", F.when(last == "", "b").when(~last.isin(".", "!", "?"), "t").otherwise("")).withColumn("th", F.xxhash64("text"))


def _short(rows: DataFrame, conv: str) -> DataFrame:
    order = ("conv_id", "turn", "role", "th")

    def whole(held: list[tuple]) -> Iterator[tuple]:
        seen, turns = set(), []
        for _, turn, role, text, fault, lost in held:
            if lost:
                continue
            if fault != "b":
                if (role, text) in seen:
                    fault = "d"
                seen.add((role, text))
            turns.append((turn, role, text, fault))
        cost, audit = cheapest(tuple((role[:1], fault) for _, role, _, fault in turns))
        done = Repair(held[0][0], audit, cost)
        for t in turns:
            yield from done.turn_of(*t)
        yield from done.report()

    def lines(rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, held in groupby(rows, key=lambda r: r[0]):
            yield from whole(list(held))

    def run(batches):
        return _streamed(batches, ("conv_id", "turn", "role", "text", "fault", "lost"), lines)

    return rows.repartition("conv_id").sortWithinPartitions(*order).drop("th").mapInArrow(run, SCHEMA.format(conv=conv))


def _tables(df: DataFrame, keys: list[str]) -> DataFrame:
    """The chart tables of each group of ``keys`` in the order of ``at``, as one."""

    def join_up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        whole: dict[tuple[int, int], tuple[int, str]] = {(n, n): (0, "") for n in range(4)}
        for table in pdf["cells"]:
            by: dict[int, list] = {}
            for c in table:
                by.setdefault(c["begin"], []).append((c["left"], c["cost"], c["audit"]))
            nxt: dict = {}
            for (a, b), (cost, audit) in whole.items():
                for left, more, rest in by[b]:
                    item = (cost + int(more), audit + rest)
                    if (a, left) not in nxt or item < nxt[a, left]:
                        nxt[a, left] = item
            whole = nxt
        out = pdf[["conv_id", *keys]].head(1).copy()
        out["at"] = int(pdf["at"].iloc[0])
        out["cells"] = [[{"begin": a, "left": b, "cost": c, "audit": s} for (a, b), (c, s) in whole.items()]]
        return out

    schema = f"conv_id {df.schema['conv_id'].dataType.simpleString()}, {''.join(f'{k} long, ' for k in keys)}at long, cells array<struct<begin int, left int, cost long, audit string>>"
    return df.groupBy("conv_id", *keys).applyInPandas(join_up, schema)


def _long(rows: DataFrame, conv: str) -> DataFrame:
    order = ("conv_id", "turn", "role", "th")
    own = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "turns")
    real = own.where(~F.col("lost"))
    repeated = real.where("fault <> 'b'").groupBy("conv_id", "role", F.sha2("text", 256).alias("key")).agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    g = repeated.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("key").alias("_k"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.sha2("text", 256) == F.col("_k")) & (F.col("fault") != "b") & ~F.col("lost")
    marked = own.join(g, same, "left").withColumn("fault", F.when(F.col("at") > F.col("first"), "d").otherwise(F.col("fault"))).select(*own.columns)
    marked = durable(marked, "marked")
    release(own)

    def chunk_tables(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        turns = list(zip(pdf["initial"], pdf["fault"], strict=True))
        cells = [{"begin": n, "left": left, "cost": c, "audit": s} for n in range(4) for left, (c, s) in parse(turns, n).items()]
        return pd.DataFrame({"conv_id": pdf["conv_id"].head(1), "chunk": pdf["chunk"].head(1), "at": [int(pdf["at"].iloc[0])], "cells": [cells]})

    cells = "array<struct<begin int, left int, cost long, audit string>>"
    chunk = F.shiftright("at", CHUNK.bit_length() - 1)
    tables = durable(
        marked.where(~F.col("lost")).select("conv_id", chunk.alias("chunk"), "at", F.left("role", F.lit(1)).alias("initial"), "fault")
        .groupBy("conv_id", "chunk").applyInPandas(chunk_tables, f"conv_id {conv}, chunk long, at long, cells {cells}"),
        "tables",
    )
    while True:
        most = tables.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= FAN_IN:
            break
        # chunks of one range of turns are neighbours; ranges follow each other
        shift = FAN_IN.bit_length() - 1
        up = tables.withColumn("chunk", F.shiftright("chunk", shift))
        nxt = durable(_tables(up, ["chunk"]), "tables")
        release(tables)
        tables = nxt
    whole = durable(_tables(tables.drop("chunk"), []), "charts")
    release(tables)
    cell = F.array_min(F.transform(F.filter("cells", lambda c: (c["begin"] == EMPTY) & c["left"].isin(*ACCEPT)), lambda c: F.struct(c["cost"], c["audit"])))
    audits = whole.select("conv_id", cell.alias("c")).select("conv_id", F.lit(-1).cast("long").alias("at"), F.col("c.cost").alias("cost"), F.col("c.audit").alias("audit"))
    stream = marked.select("conv_id", "at", "turn", "role", "text", "fault", "lost").unionByName(audits, allowMissingColumns=True)

    def lines(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv_id, held in groupby(rows, key=lambda r: r[0]):
            done = None
            for _, at, turn, role, text, fault, lost, cost, audit in held:
                done = done or Repair(conv_id, audit or "", cost or 0)  # the audit comes first, if any turn is left
                if at >= 0 and not lost:
                    yield from done.turn_of(turn, role, text, fault)
            yield from done.report()

    def run(batches):
        return _streamed(batches, ("conv_id", "at", "turn", "role", "text", "fault", "lost", "cost", "audit"), lines)

    return stream.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(run, SCHEMA.format(conv=conv))


def repair(conversations: DataFrame, long_turns: int = LONG_TURNS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """The repaired turns (conv_id, pos, edit, role, text) of every conversation, then its report.

    A report has no ``pos``; it has the counts of faults, the cost and the audit. The rows of
    a conversation follow each other within a partition. Rows with ``lost`` (if there is
    such a column) are not there but keep their conversation in the result.
    """
    rows = prepared(conversations)
    conv = conversations.schema["conv_id"].dataType.simpleString()
    sizes = conversations.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("size"))
    large = durable(sizes.where((F.col("n") > long_turns) | (F.col("size") > long_bytes)).select(F.col("conv_id").alias("_large")), "long-conversations")
    n = large.count()
    if not n:
        release(large)
        return _short(rows, conv)
    side = F.broadcast(large) if n <= MAX_BROADCAST else large
    on = F.col("conv_id").eqNullSafe(F.col("_large"))
    return _short(rows.join(side, on, "left_anti"), conv).unionByName(_long(rows.join(side, on, "left_semi"), conv))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with turns lost, emptied, cut, repeated or of another role, by a checksum of conv_id and turn."""
    rows = conversations.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key) % 20
    rows = rows.withColumn("_k", kind).withColumn("lost", F.col("_k") == 0)
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("_k") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("_n", F.explode(F.sequence(F.lit(1), F.when(F.col("_k") == 3, 2).otherwise(1)))).drop("_k", "_n")


def digests(repaired: DataFrame) -> DataFrame:
    """The reports of :func:`repair`, with ``repaired_sha256`` of the lines role:text."""
    conv = repaired.schema["conv_id"].dataType.simpleString()
    names = ("conv_id", "pos", "role", "text", *COUNTS, "audit")

    def run(batches):
        digest = hashlib.sha256()
        for batch in batches:
            out = []
            for _, pos, role, text, *rest in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if pos is not None:
                    digest.update(f"{chr(10) if pos > 1 else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                else:
                    out.append((_, *rest, digest.hexdigest()))
                    digest = hashlib.sha256()
            if out:
                fields = [("conv_id", batch.schema.field("conv_id").type), *((n, pa.int64()) for n in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], schema=pa.schema(fields))

    return repaired.mapInArrow(run, f"conv_id {conv}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


#: The chart as a recursion over the turns; CRC-32 bit by bit.
ORACLE = """
with recursive k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce([ascii(x) for x in string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), '')]::bigint[],
        lambda c, x: list_reduce(range(8), lambda y, i: xor(y >> 1, (y & 1) * 3988292384), xor(c, x)), 4294967295::bigint), 4294967295::bigint) % 20 as k from conversations),
d as (select conv_id, turn, case k when 4 then 'user' else role end as role, unnest(range(case k when 0 then 0 when 3 then 2 else 1 end)) as copy,
    case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text from k),
f as (select *, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') as body,
    row_number() over (partition by conv_id order by turn nulls first, role, copy) as i,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth from d),
g as (select *, role[1] as t, case when body = '' then 'b' when nth > 1 then 'd' when right(body, 1) not in ('.', '!', '?') then 't' else '' end as fault,
    lead(role[1]) over (partition by conv_id order by i) as nx from f),
ins(m, n, c, a, t) as (values (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
    (0, 2, 5, 'I', chr(10) || 'user:'), (1, 2, 5, 'I', chr(10) || 'user:'), (3, 2, 5, 'I', chr(10) || 'user:'), (2, 3, 5, 'I', chr(10) || 'assistant:'),
    (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
ed(m, n, kind, t, role) as (values (0, 1, 'K', 's', null), (0, 2, 'K', 'u', null), (1, 2, 'K', 'u', null), (3, 2, 'K', 'u', null), (2, 3, 'K', 'a', null),
    (0, 2, 'R', null, 'user'), (1, 2, 'R', null, 'user'), (3, 2, 'R', null, 'user'), (2, 3, 'R', null, 'assistant'),
    (0, 0, 'D', null, null), (1, 1, 'D', null, null), (2, 2, 'D', null, null), (3, 3, 'D', null, null)),
p as (select conv_id, 0::bigint as i, 0 as m, {'c': 0, 'a': '', 't': ''} as item from (select distinct conv_id from conversations)
    union all
    select p.conv_id, p.i + 1, ed.n, min({'c': p.item.c + ins.c + case ed.kind when 'D' then 2 else (ed.kind = 'R')::int + 5 * (g.fault = 't')::int end, 'a': p.item.a || ins.a || ed.kind,
        't': p.item.t || ins.t || case ed.kind when 'D' then '' else chr(10) || coalesce(ed.role, g.role) || ':' || g.text end})
    from p join g on p.conv_id is not distinct from g.conv_id and g.i = p.i + 1 join ins on ins.m = p.m join ed on ed.m = ins.n and (ed.t is null or ed.t = g.t) and (ed.kind = 'D' or g.fault not in ('b', 'd'))
    group by all),
z as (select conv_id, count(i) as n, count_if(fault = 'b') as blank, count_if(fault = 'd') as duplicate, count_if(fault = 't') as truncated,
    count_if(nx is not null and t || nx not in ('su', 'ua', 'au')) as illegal, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps
    from (select distinct conv_id from conversations) left join g using (conv_id) group by 1),
w as (select z.*, b.item from z join (select p.conv_id, p.i, min({'c': p.item.c + ins.c, 'a': p.item.a || ins.a, 't': p.item.t || ins.t}) as item from p join ins on ins.m = p.m and ins.n in (0, 3) group by all) b
    on b.conv_id is not distinct from z.conv_id and b.i = z.n)
select conv_id, gaps, blank, duplicate, truncated, illegal, item.c::bigint as cost, item.a as audit, sha256(substr(item.t, 2)) as repaired_sha256 from w"""

QUERIES = {"op13_conversation_repair": query}
ORACLE_SQL = {"op13_conversation_repair": ORACLE}
