"""Columns of any name, such as ``my col``, ``a.b`` or one with a backquote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str, *inside: str) -> str:
    """``name``, after the structs that it is in, for use where Spark parses names."""
    return ".".join("`" + n.replace("`", "``") + "`" for n in (*inside, name))


def named(name: str, *inside: str) -> Column:
    return F.col(quoted(name, *inside))


def whole_row(df: DataFrame, but: tuple[str, ...] = ()) -> Column:
    """All columns but those of ``but`` in a struct; without any, a struct with a constant."""
    fields = [named(c).alias(c) for c in df.columns if c not in but]
    return F.struct(*fields) if fields else F.struct(F.lit(1).alias("one"))
