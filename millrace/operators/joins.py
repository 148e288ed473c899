"""Joins that Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], at: tuple[str, str], op: str = ">=", how: str = "left") -> DataFrame:
    """For each left row the right row of equal keys that is nearest in ``at``: left.at op right.at.

    Both sides go into one sorted pass per key (a union and a window), so the cost is that of a sort and no key's rows
    are paired with each other. Equal right times: one of them. Rows without a match stay with nulls if how is left. Keys
    that are null match nothing. Names of the two sides must differ.
    """
    lcols, rcols = left.columns, right.columns
    forward = op in ("<=", "<")
    strict = op in (">", "<")
    # At equal times a right row counts before the left one unless the comparison is strict.
    side_l, side_r = (F.lit(0), F.lit(1)) if strict else (F.lit(1), F.lit(0))
    names = [f"__k{i}" for i in range(len(keys))]
    a = left.select(*[F.col(l).alias(n) for n, (l, _) in zip(names, keys, strict=True)], F.col(at[0]).alias("__t"), side_l.alias("__s"), F.struct(*lcols).alias("__l"), F.lit(None).cast(right.select(F.struct(*rcols).alias("x")).schema["x"].dataType).alias("__r"))
    b = right.filter(F.col(at[1]).isNotNull()).select(*[F.col(r).alias(n) for n, (_, r) in zip(names, keys, strict=True)], F.col(at[1]).alias("__t"), side_r.alias("__s"), F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), F.struct(*rcols).alias("__r"))
    order = [F.col("__t").desc() if forward else F.col("__t").asc(), F.col("__s").asc()]
    window = Window.partitionBy(*names).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matched = F.last("__r", ignorenulls=True).over(window)
    known = F.col("__t").isNotNull()
    for n in names:
        known = known & F.col(n).isNotNull()
    found = a.unionByName(b).withColumn("__m", F.when(known, matched)).filter(F.col("__l").isNotNull())
    if how == "inner":
        found = found.filter(F.col("__m").isNotNull())
    return found.select(*[F.col("__l")[c].alias(c) for c in lcols], *[F.col("__m")[c].alias(c) for c in rcols])


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float, condition: Column | None = None) -> DataFrame:
    """Rows of left whose point lies in low..high of a right row. Points fall into bins of ``width``; a right row is in
    each bin that it touches, so the join is by bin and only then by comparison. An interval of many widths is in many
    bins: choose the width near the usual length."""
    bin_of = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    spread = right.filter(F.col(low) <= F.col(high)).withColumn("__bin", F.explode(F.sequence(bin_of(low), bin_of(high))))
    joined = left.withColumn("__bin", bin_of(point)).join(spread, "__bin").filter((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high)))
    return (joined if condition is None else joined.filter(condition)).drop("__bin")


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int, how: str = "inner") -> DataFrame:
    """An equi-join in which each key of the left side is dealt to ``salts`` partitions, for keys that hold a large
    part of all rows; the right side, small per key, is repeated. how: inner, left or left_semi or left_anti."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    # Of the row itself, so that a task that is run again deals its rows as before.
    a = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    b = right.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return a.join(b, [key, "__salt"], how).drop("__salt")
