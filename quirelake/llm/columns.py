"""The caller's columns out of the way of an operator's own."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, added: Iterable[str], **beside: Column) -> DataFrame:
    """One struct ``row`` of the columns of ``docs`` but those named in ``added`` in any letter case, and the columns ``beside``.

    Whatever the caller's columns are called, they meet no name of the operator's.
    """
    replaced = {a.lower() for a in added}
    kept = [quoted(c) for c in docs.columns if c.lower() not in replaced]
    return docs.select((F.struct(*kept) if kept else F.lit(None)).alias("row"), *[column.alias(name) for name, column in beside.items()])


def unpacked(docs: DataFrame, added: Iterable[str]) -> list[Column]:
    """The columns that ``packed`` put into ``row``."""
    replaced = {a.lower() for a in added}
    return [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in replaced]


def shielded(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``operator``, whose working columns all begin with two underscores, for tables with columns that do so too.

    Those are called otherwise while it works, and by their names again in its result.
    """

    @functools.wraps(operator)
    def run(docs: DataFrame, *args: object, **options: object) -> DataFrame:
        taken = {c.lower() for c in docs.columns}
        free = (name for k in itertools.count() if (name := f"callers_{k}") not in taken)
        names = {c: next(free) for c in docs.columns if c.startswith("__")}
        if not names:
            return operator(docs, *args, **options)

        def inner(value: object) -> object:
            return names.get(value, value) if isinstance(value, str) else value

        out = operator(docs.withColumnsRenamed(names), *map(inner, args), **{k: inner(v) for k, v in options.items()})
        return out.withColumnsRenamed({new: old for old, new in names.items()})

    return run
