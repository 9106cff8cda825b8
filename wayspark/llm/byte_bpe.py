"""Operator 4, byte-level BPE encoding and decoding with the tokenizers library.

Tasks work on Arrow batches. A text is split by the vocabulary's pattern; pieces that the
worker has not met are encoded by the library, a batch at a time, the others come from a
table of bounded size. Decoding goes back from token strings to bytes by the table that
maps each byte to a printable character. A token may end inside a character; such tokens
have that character's offsets, and bytes are joined before they are read as UTF-8.

Edge cases: a null or empty text has no tokens and decodes to no bytes. Texts of any
length are cut between two matches of the pattern, so memory follows ``CUT``, or the longest
match, plus the ids of one text. A null list of ids decodes to no bytes; an unknown id raises KeyError.
Repeated rows are encoded each; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, pre_tokenizers

from wayspark.llm.columns import named

VOCABULARY = "byte_bpe_50k.json"
#: Characters encoded at once, and ids held before a batch goes out.
CUT = 1 << 20
#: Pieces of text that a worker remembers, each of at most MAX_REMEMBERED characters.
REMEMBERED, MAX_REMEMBERED = 200_000, 64
#: Pieces that the library encodes in one call.
TOGETHER = 4096
#: Characters after a match that can decide about it (as in 'll).
LOOK = 4


def byte_characters() -> list[str]:
    """The printable character that stands for each byte.

    Visible Latin-1 characters stand for themselves; the other bytes, in order, take the
    characters from U+0100 on.
    """
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(rest)) for b in range(256)]


def token_bytes(tokenizer: Tokenizer) -> dict[int, bytes]:
    """The bytes of every ordinary token."""
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    return {i: bytes(byte_of[c] for c in t) for t, i in tokenizer.get_vocab().items() if t not in special}


def latin_pattern(pattern: str) -> str | None:
    """The pattern for texts below U+0100 in terms of the re module, which is faster.

    None for patterns other than that of the vocabulary, whose classes are letters,
    numbers and white space.
    """
    if pattern != public_tokenizers.PATTERN:
        return None
    kinds = {k: "".join(f"\\x{c:02x}" for c in range(256) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    kinds["S"] = r"\x09-\x0d\x20\x85\xa0"
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{kinds['S']}{kinds['L']}{kinds['N']}]").replace(r"(?!\S)", f"(?![^{kinds['S']}])")
    for name, kind in ((r"\p{L}", "L"), (r"\p{N}", "N"), (r"\s", "S")):
        out = out.replace(name, f"[{kinds[kind]}]")
    return out


class Encoder:
    """Ids (and character spans) of texts, with a table of pieces met before."""

    def __init__(self, path: str, pattern: str, spans: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)
        self.any_pieces: Callable[[str], list[str]] = regex.compile(pattern).findall
        latin = latin_pattern(pattern)
        self.latin_pieces = re.compile(latin).findall if latin else None
        self.spans = spans
        self.met: dict[str, tuple] = {}

    def finder(self, text: str) -> Callable[[str], list[str]]:
        if self.latin_pieces:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                return self.latin_pieces
        return self.any_pieces

    def pieces(self, text: str, size: int = CUT) -> Iterator[list[str]]:
        """All matches in the text, those in about ``size`` characters at a time.

        A match that ends LOOK characters before the end of a part is one of the whole text.
        """
        find, at, n = self.finder(text), 0, max(size, LOOK + 1)
        while len(text) - at > n:
            found = find(text[at : at + n])
            ends = list(accumulate(map(len, found)))
            whole = bisect_right(ends, n - LOOK)
            if not whole:
                n *= 2
                continue
            yield found[:whole]
            at, n = at + ends[whole - 1], max(size, LOOK + 1)
        yield find(text[at:] if at else text)

    def lookup(self, parts: list[str]) -> dict[str, tuple]:
        new = [p for p in set(parts) if p not in self.met]
        if len(self.met) + len(new) > REMEMBERED:
            self.met = {}
            new = list(set(parts))
        table = self.met
        for at in range(0, len(new), TOGETHER):
            some = new[at : at + TOGETHER]
            e = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids, cut = e.ids, np.searchsorted(np.array(e.word_ids), np.arange(len(some) + 1)).tolist()
            spans = e.offsets if self.spans else None
            for piece, a, b in zip(some, cut, cut[1:]):
                table[piece] = (ids[a:b], spans[a:b]) if self.spans else tuple(ids[a:b])
        if any(len(p) > MAX_REMEMBERED for p in new):
            self.met = {p: x for p, x in table.items() if len(p) <= MAX_REMEMBERED}
        return table

    def ids(self, text: str) -> np.ndarray:
        out = []
        for pieces in self.pieces(text):
            table = self.lookup(pieces)
            out.append(np.fromiter(chain.from_iterable(map(table.__getitem__, pieces)), np.int32))
        return np.concatenate(out)

    def ids_and_spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        ids, ends, at = [], [], 0
        for pieces in self.pieces(text):
            table = self.lookup(pieces)
            for p in pieces:
                own, spans = table[p]
                ids.extend(own)
                ends.extend((at + a, at + b) for a, b in spans)
                at += len(p)
        return np.array(ids, np.int32), np.array(ends, np.int32).reshape(-1, 2)


def _lists(values: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(values) if values else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat, pa.int32()))


def _encoded(path: str | None, pattern: str, offsets: bool, names: list[str]) -> Callable:
    """Batches with the text last become batches with ids (and spans) in its place.

    Spark hands over plain names only, so columns are numbered on the way.
    """

    def run(batches):
        encoder = Encoder(path or public_tokenizers.path(VOCABULARY), pattern, offsets)
        for batch in batches:
            keys, texts = batch.columns[:-1], batch.columns[-1]
            at, held, rows = 0, 0, []
            for i in range(len(texts)):
                text = texts[i].as_py() or ""
                ids, spans = encoder.ids_and_spans(text) if offsets else (encoder.ids(text), None)
                rows.append((ids, spans))
                held += len(ids)
                if held >= CUT or i + 1 == len(texts):
                    columns = [_lists([r[0] for r in rows])]
                    if offsets:
                        columns += [_lists([r[1][:, k] for r in rows]) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*(k.slice(at, len(rows)) for k in keys), *columns], names=names)
                    at, held, rows = i + 1, 0, []

    return run


def _decoded(path: str | None) -> Callable:
    """Batches with ``ids`` get ``content`` as their last column."""

    def run(batches):
        table = token_bytes(Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY)))
        for batch in batches:
            ids = batch.column("ids")
            at, held, out = 0, 0, []
            for i in range(len(ids)):
                value = ids[i].values
                out.append(b"".join(map(table.__getitem__, value.to_numpy(zero_copy_only=False).tolist())) if value is not None else b"")
                held += len(out[-1])
                if held >= 4 * CUT or i + 1 == len(ids):
                    yield pa.RecordBatch.from_arrays([*(c.slice(at, len(out)) for c in batch.columns), pa.array(out, pa.binary())], names=[*batch.schema.names, "content"])
                    at, held, out = i + 1, 0, []

    return run


def _kind(df: DataFrame, **more: T.DataType) -> T.StructType:
    return T.StructType([*df.schema, *(T.StructField(n, t) for n, t in more.items())])


def _texts(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(named(c).alias(f"_{i}") for i, c in enumerate(keep)), "text")


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, offsets: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep`` and ``ids`` of every row; with ``offsets`` also ``starts`` and ``ends``.

    ``path`` is the vocabulary in the library's own format, on every executor. Spans
    count characters of the text.
    """
    texts = _texts(docs, keep)
    names = ["ids", "starts", "ends"] if offsets else ["ids"]
    found = texts.mapInArrow(_encoded(path, pattern, offsets, [*texts.columns[:-1], *names]), _kind(texts.drop("text"), **{n: T.ArrayType(T.IntegerType()) for n in names}))
    return found.toDF("doc_id", *keep, *names)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """All columns and ``content``, the bytes that ``ids`` stand for."""
    plain = tokens.toDF(*(c if c == "ids" else f"_{i}" for i, c in enumerate(tokens.columns)))
    return plain.mapInArrow(_decoded(path), _kind(plain, content=T.BinaryType())).toDF(*tokens.columns, "content")


def encode_and_decode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep``, ``ids`` and ``content``: both ways in one worker a task."""
    texts = _texts(docs, keep)
    encoded, decoded = _encoded(path, pattern, False, [*texts.columns[:-1], "ids"]), _decoded(path)
    found = texts.mapInArrow(lambda batches: decoded(encoded(batches)), _kind(texts.drop("text"), ids=T.ArrayType(T.IntegerType()), content=T.BinaryType()))
    return found.toDF("doc_id", *keep, "ids", "content")


def text_of(content: bytes) -> str:
    """Decoded bytes as text; characters cut at either end become U+FFFD."""
    return content.decode("utf-8", "replace")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """What encoding and decoding every text gives: the count and two digests."""
    return encode_and_decode(docs, path).select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("content", 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_byte_bpe": query}
ORACLE_SQL: dict[str, str] = {}
