"""Relational helpers that Spark has no word for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """DISTINCT ON: the first row of each key. ``order`` should end in a unique column.

    ``row_number() = 1`` is planned with a group limit before the shuffle, so a hot key sends one row a task.
    """
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def top_k_by(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key with their place."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def prefix_cascade(left: DataFrame, code: str, lookup: DataFrame, prefix: str, value: str, lengths: list[int], default: str | None = None) -> DataFrame:
    """Value of the longest prefix of ``code`` in the lookup, then of ``default``; and how it was matched.

    One equi-join a length on unique keys; no OR-joins, no correlated sub-query.
    """
    found, how, out = [], [], left
    for n in lengths:
        part = lookup.select(F.col(prefix).alias(f"__p{n}"), F.col(value).alias(f"__v{n}"))
        out = out.join(part, F.substring(code, 1, n) == F.col(f"__p{n}"), "left")
        found.append(F.col(f"__v{n}"))
        how.append((F.col(f"__v{n}"), n))
    if default is not None:
        part = lookup.where(F.col(prefix) == default).select(F.col(value).alias("__vd"))
        out = out.join(part, F.lit(True), "left")  # one row
        found.append(F.col("__vd"))
    level = F.lit(0)
    for v, n in reversed(how):
        level = F.when(v.isNotNull(), F.lit(n)).otherwise(level)
    return out.select(*left.columns, F.coalesce(*found).alias(value), level.alias("matched_length"))


def interval_join(left: DataFrame, x: str, right: DataFrame, low: str, high: str, step: float) -> DataFrame:
    """Rows with ``low <= x < high`` by an equi-join on cells of ``step``; intervals are spread over their cells."""
    cells = F.explode(F.sequence(F.floor(F.col(low) / step), F.floor(F.col(high) / step)))
    spread = right.withColumn("__cell", cells)
    return left.withColumn("__cell", F.floor(F.col(x) / step)).join(spread, "__cell").where((F.col(x) >= F.col(low)) & (F.col(x) < F.col(high))).drop("__cell")


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row at or before it: one union, one window, no pair join."""
    l = left.withColumn("__t", F.col(time)).withColumn("__side", F.lit(1))
    r = right.select(*keys, F.col(right_time).alias("__t"), F.struct(*values, F.col(right_time)).alias("__v")).withColumn("__side", F.lit(0))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("__last", F.last("__v", ignorenulls=True).over(w)).where("__side = 1").select(*left.columns, *[F.col(f"__last.{v}").alias(v) for v in values], F.col(f"__last.{right_time}").alias(right_time))


def percent_rank_of_values(df: DataFrame, value: str, name: str = "percentile") -> DataFrame:
    """PERCENT_RANK over the whole table, nulls first, without sorting it in one task.

    Counts per distinct value are summed up in order and joined back; the one-task window sees one row for each
    distinct value (scores are rounded, so they are few however many rows there are).
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    order = Window.orderBy(F.col(value).asc_nulls_first())
    ranked = counts.withColumn("__below", F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__all", F.sum("__n").over(Window.partitionBy()))
    rank = F.when(F.col("__all") > 1, F.col("__below") / (F.col("__all") - 1)).otherwise(F.lit(0.0))
    ranked = ranked.select(F.col(value).alias("__value"), rank.alias(name))
    return df.join(ranked, df[value].eqNullSafe(ranked["__value"])).drop("__value")


def min_max(df: DataFrame, columns: list[str], suffix: str = "_scaled") -> DataFrame:
    """Columns scaled to 0..1 by whole-table bounds: one aggregate row, joined to all."""
    bounds = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.join(F.broadcast(bounds))  # exactly one row
    for c in columns:
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        out = out.withColumn(c + suffix, (F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0)))
    return out.drop(*[f"__{n}_{c}" for c in columns for n in ("lo", "hi")])


def upsert(current: DataFrame, change: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """INSERT ... ON CONFLICT DO UPDATE: the newest row of each key; on a tie the change wins."""
    both = current.withColumn("__side", F.lit(0)).unionByName(change.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    return first_by(both, keys, [F.col(newest).desc_nulls_last(), F.col("__side").desc()]).drop("__side")


def page(df: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """One page of an ordered list; the sort keeps ``offset + size`` rows a task."""
    return df.orderBy(*order).offset(offset).limit(size)


def filters(df: DataFrame, given: dict, allowed: dict) -> DataFrame:
    """AND of the given parameters that are not null; ``allowed`` maps a name to a function from value to Column."""
    for name, value in given.items():
        if value is not None:
            df = df.where(allowed[name](value))
    return df


def run_diff(before: DataFrame, after: DataFrame, key: str, value: str, score: str) -> DataFrame:
    """NEW, LOST, CHANGED, IMPROVED, DEGRADED or SAME for each key of two runs."""
    b, a = before.select(key, F.col(value).alias("old_value"), F.col(score).alias("old_score")), after.select(key, F.col(value).alias("new_value"), F.col(score).alias("new_score"))
    kind = (
        F.when(F.col("old_value").isNull(), "NEW").when(F.col("new_value").isNull(), "LOST").when(F.col("old_value") != F.col("new_value"), "CHANGED")
        .when(F.col("new_score") > F.col("old_score"), "IMPROVED").when(F.col("new_score") < F.col("old_score"), "DEGRADED").otherwise("SAME")
    )
    return b.join(a, key, "full_outer").withColumn("change", kind)


def most_specific(df: DataFrame, by: list[str], levels: list[tuple[str, Column]], code: str, lengths: tuple[int, ...], reference: DataFrame, on: tuple[str, str, str], valid: str = "true") -> DataFrame:
    """``*by`` and the one row of ``reference`` that is most specific: by level in order, then by the longest prefix of the code.

    Every row lists the (level, place, prefix) keys it may meet, from the most specific on, so that one equi-join
    and one grouped minimum do for any number of levels. ``on`` names the reference's level, place and code
    columns; rows that meet none, or have no code, do not come back. Equal keys of the reference: the smallest other columns.
    """
    level, place, key = on
    ranked = [F.struct(F.lit(i * len(lengths) + j).alias("__rank"), F.lit(name).alias(level), where.cast("string").alias(place), F.when(F.length(code) >= n, F.substring(code, 1, n)).alias(key)) for i, (name, where) in enumerate(levels) for j, n in enumerate(lengths)]
    keyed = df.select(*by, F.explode(F.array(*ranked)).alias("__k")).select(*by, "__k.*").where(F.col(key).isNotNull() & F.col(place).isNotNull())
    rest = [c for c in reference.columns if c not in on]
    met = keyed.join(reference.where(valid), list(on))
    best = met.groupBy(*by).agg(F.min(F.struct("__rank", level, place, key, *rest)).alias("__b"))
    return best.select(*by, *[F.col(f"__b.{c}").alias(c) for c in (level, place, key, *rest)])
