"""Running sums and maxima over arrays, as DataFrame expressions, in time that follows the array's length.

``aggregate`` that appends to an array copies it at each step. Here it runs over blocks of ``BLOCK`` values and then over the
blocks' last values, so a value is copied ``BLOCK`` times at most, plus once for each block of its array.

No lambda refers to another column: the optimizer may put that column's expression in its place, to be evaluated for each element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256
Op = Callable[[Column, Column], Column]


def add(a: Column, b: Column) -> Column:
    return a + b


def _appended(values: Column, op: Op, inclusive: bool) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = op(acc["at"], x)
        return F.struct(new.alias("at"), F.concat(acc["out"], F.array(new if inclusive else acc["at"])).alias("out"))

    return F.aggregate(values, start, step, lambda acc: acc["out"])


def running(df: DataFrame, values: dict[str, Column], op: Op = add) -> DataFrame:
    """``df`` with, for each name, the running sum (or other ``op`` with the neutral element 0) of an array of ints, each value included.

    A null array gives an empty one. The steps are columns of their own, so that none is computed twice.
    """
    df = df.withColumns({f"{k}_in": F.coalesce(v, F.array().cast("array<int>")) for k, v in values.items()})

    def blocks(k: str) -> Column:
        x = F.col(f"{k}_in")
        firsts = F.sequence(F.lit(1), F.size(x), F.lit(BLOCK))
        return F.when(F.size(x) > 0, F.transform(firsts, lambda i: _appended(F.slice(x, i, F.lit(BLOCK)), op, True))).otherwise(F.array().cast("array<array<int>>"))

    df = df.withColumns({f"{k}_by": blocks(k) for k in values}).drop(*(f"{k}_in" for k in values))
    df = df.withColumns({f"{k}_up": F.when(F.size(f"{k}_by") > 1, _appended(F.transform(f"{k}_by", lambda b: F.element_at(b, -1)), op, False)) for k in values})

    def whole(k: str) -> Column:
        several = F.flatten(F.zip_with(f"{k}_by", f"{k}_up", lambda b, up: F.transform(b, lambda x: op(x, up))))
        return F.when(F.size(f"{k}_by") > 1, several).otherwise(F.flatten(f"{k}_by"))

    return df.withColumns({k: whole(k) for k in values}).drop(*(f"{k}_{x}" for k in values for x in ("by", "up")))
