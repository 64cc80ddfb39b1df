"""Row generators that evaluate an expression exactly once.

The optimiser copies the expression behind a column into every filter that
uses the column, and it adds a filter on the array of an inner ``explode``.
For a long parse or score this repeats the work. An outer explode takes no
such filter, and no filter moves below it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` many times."""
    return F.transform(F.array(value), body)[0]


def compute_once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps must not compute again."""
    once = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(
        *kept, F.explode_outer(F.array(once)).alias("_once")
    ).select(*kept, *[F.col(f"_once.{n}").alias(n) for n in columns])


def explode_rows(
    rows: DataFrame, keep: Sequence, array: Column, name: str,
    position: str | None = None,
) -> DataFrame:
    """One row per non-null array element, with its position if asked for."""
    if position is None:
        out = rows.select(*keep, F.explode_outer(array).alias(name))
    else:
        out = rows.select(
            *keep, F.posexplode_outer(array).alias(position, name)
        )
    return out.where(F.col(name).isNotNull())
