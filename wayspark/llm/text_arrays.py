"""Texts of an Arrow batch as flat numpy arrays, in pieces of bounded size.

A word is a run of characters other than space and U+0009 to U+000D; a run of more than
WORD characters counts as several words of WORD characters and a rest. So a text can be cut
between words within WORD characters of any place, and what is counted doesn't depend on
where it is cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Characters that one piece holds at most; temporary arrays take some 100 bytes each.
PIECE = 1 << 20
WORD = 4096

_FACTOR = 0x9E3779B97F4A7C15
_SPACES = re.compile(r"[\x20\x09-\x0D]")


@dataclass(frozen=True)
class Piece:
    """Parts of texts in a row: part k is of text ``index[k]`` and starts at ``bounds[k]``.

    The first ``own[k]`` characters of a part are its own; those after it are there to
    complete n-grams, and belong to the part that follows.
    """

    index: np.ndarray
    own: np.ndarray
    flat: np.ndarray
    bounds: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        """The part of each character."""
        return np.repeat(np.arange(len(self.own)), np.diff(self.bounds))


def _cut(text: str, at: int, size: int, word: int) -> int:
    """The last place up to ``at + size`` at which no word goes on; ``at`` is one."""
    end = at + size
    if end >= len(text):
        return len(text)
    space = next((k for k in range(end, max(at, end - word - 1), -1) if _SPACES.match(text[k - 1])), 0)
    if space:
        return space
    run = max((text.rfind(c, at, end) for c in " \t\n\v\f\r"), default=-1) + 1 or at
    return max(run + (end - run) // word * word, at + 1)


def pieces(texts: list[str], ahead: int, size: int = PIECE, word: int = WORD) -> Iterator[Piece]:
    """All texts in pieces of at most ``size`` characters and ``ahead`` more for each cut.

    Short texts share pieces. Parts of one text follow each other, in order.
    """
    size = max(size, word + 1)
    held: list[tuple[int, str, int]] = []
    total = 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            end = len(text) if len(text) - at <= size else _cut(text, at, size, word)
            if total + end - at > size and held:
                yield _piece(held)
                held, total = [], 0
            held.append((i, text if at == 0 and end == len(text) else text[at : end + ahead], end - at))
            total += end - at
            at = end
            if at >= len(text):
                break
    if held:
        yield _piece(held)


def _piece(held: list[tuple[int, str, int]]) -> Piece:
    index, parts, own = zip(*held, strict=True)
    flat, bounds = code_points(parts)
    return Piece(np.array(index), np.array(own, np.int64), flat, bounds)


def code_points(texts) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points in a row, and where each text starts and the last ends."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return flat, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def mixed(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def gram_buckets(piece: Piece, orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order n, (bucket of every n-gram that begins in a part's own characters, its text)."""
    owner = piece.owner
    text = piece.index[owner]
    mine = np.arange(len(owner)) - piece.bounds[owner] < piece.own[owner]
    code = piece.flat.astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(code), dtype=np.uint64)
        for n in range(1, max(orders, default=0) + 1):
            if len(code) < n:
                return
            h = h[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(n)
            if n in orders:
                whole = mine[: len(h)] & (owner[: len(h)] == owner[n - 1 :])
                yield (mixed(h) >> np.uint64(64 - bits)).astype(np.int64)[whole], text[: len(h)][whole]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of _FACTOR, and of its inverse, modulo 2**64."""
    out = []
    for base in (_FACTOR, pow(_FACTOR, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[:1] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def word_hashes(piece: Piece, word: int = WORD) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word in a part's own characters, in order, and its text."""
    owner, flat = piece.owner, piece.flat
    at = np.arange(len(flat)) - piece.bounds[owner]
    solid = (at < piece.own[owner]) & (flat != 32) & ((flat < 9) | (flat > 13))
    fresh = np.concatenate([at == 0, [True]])
    starts = np.flatnonzero(solid & (fresh[:-1] | ~np.concatenate([[False], solid[:-1]])))
    ends = np.flatnonzero(solid & (fresh[1:] | ~np.concatenate([solid[1:], [False]]))) + 1
    times = -(-(ends - starts) // word)
    if len(times) and times.max() > 1:
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        starts, ends = np.repeat(starts, times) + nth * word, np.repeat(ends, times)
        ends = np.minimum(ends, starts + word)
    power, back = _powers(len(flat) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
        h = mixed((sums[ends] - sums[starts]) * back[starts])
    return h ^ (h >> np.uint64(32)), piece.index[owner[starts]]
