"""Ranks within groups of any size: numbering and medians without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import settled

#: Values of a group that are sorted in one task at most.
LIMIT = 1_000_000
#: Middle ranks are looked for between percentiles this far from the middle, twice the error of the sketch that gives them.
SPAN, ACCURACY = 0.001, 2000


def numbered(rows: DataFrame, within: list[str], order: list[str | Column], name: str = "position") -> DataFrame:
    """The rows with their number, from 1, in the order of each group of within; order should tell all rows of a group apart.

    Rows are dealt by range over group and order, so a large group is in many tasks. A row's number is its place in
    its partition and the number of the group's rows in the partitions before.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in [*within, *order]]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = settled(dealt.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).alias("__part")
    before = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = dealt.groupBy(*within, part).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    pieces = pieces.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    pieces = pieces.select("__part", "__first", "__before", *(F.col(c).alias(f"__{c}") for c in within))
    same = F.col("__here") == F.col("__part")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    out = dealt.withColumn("__here", F.shiftright("__at", 33)).join(pieces, same)
    return out.select(*rows.columns, (F.col("__at") - F.col("__first") + F.col("__before") + 1).alias(name))


def exact_median(rows: DataFrame, group: str, value: str, limit: int = LIMIT) -> DataFrame:
    """``group, median`` of the values that aren't null, of each group that has any; the mean of the two middle ones of an even number.

    While a group has more than limit candidates, percentiles of a sketch bound its middle ranks, counts of what is
    below and between tell whether they do, and what is outside goes. A group whose bounds meet is done.
    """
    left = rows.where(F.col(value).isNotNull()).select(group, F.col(value).alias("v"))
    state = settled(left.groupBy(group).agg(F.count("*").alias("size"), F.min("v").alias("low"), F.max("v").alias("high")))
    state = state.withColumns({"under": F.lit(0).cast("long"), "inside": F.col("size")})
    first, last = F.floor((F.col("size") + 1) / 2), F.floor((F.col("size") + 2) / 2)
    wide = (F.col("inside") > limit) & (F.col("low") < F.col("high"))
    while not (large := state.where(wide)).isEmpty():
        left = settled(left.join(large.select(group, "low", "high", "under", "size"), group).where(F.col("v").between(F.col("low"), F.col("high"))).select(group, "v"))
        middle = (first - F.col("under")) / F.col("inside")
        bounds = left.join(large.select(group, middle.alias("middle")), group)
        # the middle's share among what is left, of every group the same sketch at its own percentile
        sketch = F.percentile_approx("v", F.array(*(F.lit(k / 1000) for k in range(1001))), ACCURACY)
        bounds = bounds.groupBy(group).agg(sketch.alias("cuts"), F.first("middle").alias("middle"))
        at = lambda x: F.element_at("cuts", (F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)) * 1000).cast("int") + 1)
        # a row for each group, and written, so that Spark knows how few and doesn't deal the values by group
        bounds = settled(bounds.select(group, at(F.col("middle") - SPAN).alias("new_low"), at(F.col("middle") + 2 * SPAN).alias("new_high")))
        counts = left.join(bounds, group).groupBy(group).agg(
            F.count_if(F.col("v") < F.col("new_low")).alias("less"), F.count_if(F.col("v").between(F.col("new_low"), F.col("new_high"))).alias("kept"),
            F.first("new_low").alias("new_low"), F.first("new_high").alias("new_high"),
        )
        both = state.join(counts, group, "left")
        below = F.col("under") + F.col("less")
        holds = (below < first) & (last <= below + F.col("kept")) & F.col("less").isNotNull()
        progress = holds & ((F.col("kept") < F.col("inside")) | (F.col("new_low") == F.col("new_high")))
        state = settled(both.select(
            group, "size", F.when(holds, F.col("new_low")).otherwise(F.col("low")).alias("low"), F.when(holds, F.col("new_high")).otherwise(F.col("high")).alias("high"),
            F.when(holds, below).otherwise(F.col("under")).alias("under"), F.when(holds, F.col("kept")).otherwise(F.col("inside")).alias("inside"),
            F.coalesce(progress, F.lit(False)).alias("progress"),
        ))
        if state.where(wide & ~F.col("progress")).count() == state.where(wide).count():
            break  # the sketch can't narrow further: what is left is sorted
        state = state.drop("progress")
    met = state.where(F.col("low") == F.col("high")).select(group, F.col("low").alias("median"))
    rest = state.where(F.col("low") < F.col("high"))
    among = rows.select(group, F.col(value).alias("v")).join(rest, group).where(F.col("v").between(F.col("low"), F.col("high")))
    rank = F.row_number().over(Window.partitionBy(group).orderBy("v")) + F.col("under")
    chosen = among.withColumn("rank", rank).where(F.col("rank").between(first, last))
    return settled(met.unionByName(chosen.groupBy(group).agg(F.avg("v").alias("median"))))
