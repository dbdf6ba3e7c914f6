"""Exact ranks in groups of any size: range partitions and a two-level count, no window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from culler.session import cut_lineage

#: Row ids of a partition start at its number shifted by so many bits (Spark's own layout).
_ID_BITS = 33


def _numbered(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Rows range partitioned and sorted by (group, order) and written, with ``__at`` (ascending) and ``__part``."""
    keys = [F.col(c) for c in group]
    spread = df.repartitionByRange(*keys, *order) if keys or order else df
    numbered = spread.sortWithinPartitions(*keys, *order).withColumn("__at", F.monotonically_increasing_id())
    return cut_lineage(numbered).withColumn("__part", F.shiftright("__at", _ID_BITS))


def _with_starts(numbered: DataFrame, group: list[str], measures: dict[str, Column], total: str) -> DataFrame:
    """``numbered`` with each (partition, group)'s measures, ``total`` replaced by its sum over the group's earlier partitions.
    That table has at most partitions + groups rows."""
    names = [f"__g_{i}" for i in range(len(group))]
    starts = numbered.groupBy("__part", *[F.col(c).alias(g) for c, g in zip(group, names)]).agg(*[m.alias(k) for k, m in measures.items()])
    before = Window.partitionBy(*names).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn(total, F.coalesce(F.sum(total).over(before), F.lit(0))).withColumnRenamed("__part", "__p")
    on = F.col("__part") == F.col("__p")
    for c, g in zip(group, names):
        on = on & F.col(c).eqNullSafe(F.col(g))
    return numbered.join(starts, on)


def ranked(df: DataFrame, group: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """``df`` with the long column ``rank``: 1, 2, 3, ... inside each group (null is a group) by ``order``.

    A row's place in its sorted partition is counted on from where the group's earlier partitions end. ``order`` should
    tell a group's rows apart (end it with an id): equal rows stay in one partition and are ranked in any order."""
    placed = _with_starts(_numbered(df, group, order), group, {"__first": F.min("__at"), "__n": F.count("*")}, "__n")
    return placed.select(*df.columns, (F.col("__at") - F.col("__first") + F.col("__n") + 1).alias(rank))


def prefix_sums(df: DataFrame, group: list[str], order: list[Column], weight: str, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``weight`` over the rows before each row of its group, by ``order``."""
    placed = _with_starts(_numbered(df, group, order), group, {"__n": F.sum(weight)}, "__n")
    inside = Window.partitionBy("__part", *group).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn(name, F.col("__n") + F.coalesce(F.sum(weight).over(inside), F.lit(0))).select(*df.columns, name)


def quantiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """group + a double column per share: the exact quantile with linear interpolation (nulls don't count). Equal values
    are counted first, then placed by prefix sums of the counts: no buffer holds a group's values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    placed = prefix_sums(counts, group, [F.col("__v")], "__c", "__b")
    sizes = placed.groupBy(*[F.col(c).alias(f"__k_{i}") for i, c in enumerate(group)]).agg(F.sum("__c").alias("__all"))
    on = F.lit(True)
    for i, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"__k_{i}"))
    placed = placed.join(sizes, on)
    at = lambda i: F.max(F.when((F.col("__b") <= i) & (i < F.col("__b") + F.col("__c")), F.col("__v")))
    place = {k: p * (F.col("__all") - 1) for k, p in shares.items()}
    ends = [x for k, i in place.items() for x in (at(F.floor(i)).alias(f"__{k}_lo"), at(F.ceil(i)).alias(f"__{k}_hi"))]
    found = placed.groupBy(*group, "__all").agg(*ends)
    return found.select(*group, *[(F.col(f"__{k}_lo") + (F.col(f"__{k}_hi") - F.col(f"__{k}_lo")) * (i - F.floor(i))).alias(k) for k, i in place.items()])
