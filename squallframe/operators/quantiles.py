"""Exact quantiles (linear interpolation between the two closest ranks)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keyed import join_keys

#: Bits of a value's fraction its code keeps, and how many of them the first pass leaves out.
FRACTION_BITS, FINE_BITS = 18, 10
#: Codes of the least positive double's power of two, of infinity and of NaN.
LEAST_POWER, INFINITE, NOT_A_NUMBER = -1074, 2**40, 2**41


def order_code(v: Column) -> Column:
    """A whole number that never falls as the value grows: its power of two and the leading bits of its fraction.

    A logarithm that rounds to the next power only moves the split between two numbers, never their order.
    """
    size = F.abs(v)
    power = F.floor(F.log2(size))
    fraction = F.floor((size / F.pow(F.lit(2.0), power) - 1.0) * F.lit(float(2**FRACTION_BITS)))
    code = (power - LEAST_POWER + 1) * F.lit(2**FRACTION_BITS) + fraction
    code = F.when(size == float("inf"), F.lit(INFINITE)).when(size == 0, F.lit(0)).otherwise(code)
    return F.when(F.isnan(v), F.lit(NOT_A_NUMBER)).when(v < 0, -code).otherwise(code).cast("long")


def exact_quantiles_of(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Quantiles of several columns at once: ``wanted`` names each result by (column, probability).

    For groups of any size, without gathering a group. Values are counted by the leading bits of their codes, which tells the part that holds
    each wanted rank; the values of those parts by their whole codes; and those of the codes found
    are ranked themselves. All columns and probabilities share the three passes, a pass orders
    a few thousand counts of a group at most, and only a 2**-18 th of an octave of values is ever ranked.
    Groups without any value are left out; NaN counts as the largest value.
    """
    keys = list(keys)
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    if len(columns) == 1:
        rows = df.select(*keys, F.lit(0).alias("__i"), F.col(columns[0]).cast("double").alias("__v"))
    else:
        stacked = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])
        rows = df.select(*keys, F.explode(stacked).alias("__x")).select(*keys, F.col("__x.i").alias("__i"), F.col("__x.v").alias("__v"))
    rows = rows.filter("__v is not null").withColumn("__code", order_code(F.col("__v"))).withColumn("__part", F.shiftright("__code", FINE_BITS))

    def ranks(of: int) -> Column:
        """Both ranks each quantile of a column lies between, in a group of ``__n`` values."""
        out = []
        for slot, (column, p) in enumerate(wanted.values()):
            if column == columns[of]:
                at = F.lit(float(p)) * (F.col("__n") - 1)
                out += [F.struct(F.lit(2 * slot + up).alias("slot"), (F.ceil(at) if up else F.floor(at)).alias("rank"), (at - F.floor(at)).alias("w")) for up in (0, 1)]
        return F.array(*out)

    def holding(counted: DataFrame, within: list[str], by: str, asked: Column | None = None) -> DataFrame:
        """Of the counts ``__m`` along ``by``, those that hold an asked rank, with these ranks seen from their own first value."""
        group = Window.partitionBy(*within)
        earlier = group.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        placed = counted.withColumn("__first", F.coalesce(F.sum("__m").over(earlier), F.lit(0)))
        if asked is not None:
            placed = placed.withColumn("__n", F.sum("__m").over(group)).withColumn("__asked", asked)
        own = F.filter("__asked", lambda t: (t["rank"] >= F.col("__first")) & (t["rank"] < F.col("__first") + F.col("__m")))
        seen = F.transform(own, lambda t: F.struct(t["slot"].alias("slot"), (t["rank"] - F.col("__first")).alias("rank"), t["w"].alias("w")))
        return placed.withColumn("__asked", seen).filter(F.size("__asked") > 0).select(*within, by, "__asked")

    asked = F.when(F.col("__i") == 0, ranks(0))
    for i in range(1, len(columns)):
        asked = asked.when(F.col("__i") == i, ranks(i))
    n = F.count(F.lit(1)).alias("__m")
    group = [*keys, "__i"]
    parts = holding(rows.groupBy(*group, "__part").agg(n), group, "__part", asked)
    inside = join_keys(rows, parts, [*group, "__part"]).groupBy(*group, "__part", "__code").agg(n, F.first("__asked").alias("__asked"))
    codes = holding(inside, [*group, "__part"], "__code").drop("__part")
    ranked = join_keys(rows, codes, [*group, "__code"]).groupBy(*group, "__code", "__v").agg(n, F.first("__asked").alias("__asked"))
    found = holding(ranked, [*group, "__code"], "__v").select(*keys, "__v", F.explode("__asked").alias("__t"))
    results = []
    for slot, name in enumerate(wanted):
        low, high = (F.max(F.when(F.col("__t.slot") == 2 * slot + up, F.col("__v"))) for up in (0, 1))
        weight = F.max(F.when(F.col("__t.slot") == 2 * slot, F.col("__t.w")))
        results.append(F.when(low == high, low).otherwise(low + (high - low) * weight).alias(name))
    return found.groupBy(*keys).agg(*results)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, names: dict[str, float]) -> DataFrame:
    """Quantiles of one column, named by their probabilities."""
    return exact_quantiles_of(df, keys, {name: (value, p) for name, p in names.items()})
