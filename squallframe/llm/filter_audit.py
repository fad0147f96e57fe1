"""How filters interact: what each removes in every order, from sorted posting lists.

Every row gets a key. For each part and range of keys there is one sorted list of the failing keys of each
filter, and one of each mark (such as good or toxic). Unions grow filter by filter in a k-way merge, differences
and intersections look the keys of the shorter list up in the longer one; both gallop: sorted keys are found from
where the one before was found. Only sizes leave a range, and sizes add up over ranges, as ranges share no key.

With k filters there are k * 2**(k - 1) pairs of a filter and a set of filters applied before it. They answer every
order: what a filter removes depends on the set before it, not on that set's order. The lists of one group are bounded by
``RANGE`` keys, so neither a large part nor a common failure is ever gathered in one task.

Keys are row keys and not document ids, as ids may be null or repeat: every row counts for itself. A null part is the empty string; a
null failure or mark is none; empty tables give no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Keys of a range: 2 to this power.
RANGE = 16
NO_KEYS = np.empty(0, dtype=np.int64)


def places(keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: where each stands or would stand in the sorted list, and whether it is there."""
    at = np.searchsorted(among, keys)
    return at, among[np.minimum(at, len(among) - 1)] == keys if len(among) else np.zeros(len(keys), dtype=bool)


def both(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted lists of distinct keys."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    return int(places(short, long)[1].sum())


def without(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of ``a`` that ``b`` lacks."""
    if len(a) <= len(b):
        return a[~places(a, b)[1]]
    at, there = places(b, a)
    return np.delete(a, at[there])


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sorted union of two sorted lists of distinct keys."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    at, there = places(short, long)
    return np.insert(long, at[~there], short[~there])


def sizes(lists: list[np.ndarray], marks: list[np.ndarray]) -> np.ndarray:
    """A row for each (filter, set of filters before it): both numbers, keys left of the union of both, keys removed, and of these with each mark."""
    unions = [NO_KEYS] * 2 ** len(lists)
    for taken in range(1, len(unions)):
        last = taken.bit_length() - 1
        unions[taken] = merged(unions[taken - (1 << last)], lists[last])
    out = []
    for i, own in enumerate(lists):
        for before in range(len(unions)):
            if not before >> i & 1:
                gone = without(own, unions[before])
                out.append([i, before, len(unions[before | 1 << i]), len(gone), *[both(gone, m) for m in marks]])
    return np.array(out, dtype=np.int64)


def posting_lists(rows: DataFrame, part: str, fails: list[str], marks: list[str]) -> DataFrame:
    """Per part and range of row keys: ``n`` rows and the sorted keys for which each named boolean column holds.

    A range lies in one partition of ``rows``, so lists are complete before the shuffle, which moves one row for each.
    """
    keyed = rows.withColumn("key", F.monotonically_increasing_id())
    listed = [F.sort_array(F.collect_list(F.when(F.col(c), F.col("key")))).alias(c) for c in [*fails, *marks]]
    return keyed.groupBy(part, F.shiftright("key", RANGE).alias("range")).agg(F.count(F.lit(1)).alias("n"), *listed)


def interaction_sizes(rows: DataFrame, part: str, fails: list[str], marks: list[str]) -> DataFrame:
    """Per part, filter number and bit set of filters before it: ``n`` rows, ``left_out`` by either, ``removed`` and a count for each mark."""
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                table = sizes(*[[np.asarray(row[c], dtype=np.int64) for c in names] for names in (fails, marks)])
                out = pd.DataFrame(table, columns=["filter", "before", "left_out", "removed", *marks])
                out.insert(0, part, row[part])
                out.insert(1, "n", row["n"])
                yield out

    counts = ["left_out", "removed", *marks]
    found = posting_lists(rows, part, fails, marks).drop("range").mapInPandas(
        apply, f"{part} string, n long, filter long, before long, {', '.join(f'{c} long' for c in counts)}")
    return found.groupBy(part, "filter", "before").agg(*[F.sum(c).alias(c) for c in ["n", *counts]])


def orders(names: list[str]) -> list[tuple[str, int, int, int]]:
    """Every order of the filters, each step: the order, the step, the filter's number, the bit set before it."""
    return [("".join(names[i] for i in order), at + 1, order[at], sum(1 << i for i in order[:at]))
            for order in itertools.permutations(range(len(names))) for at in range(len(names))]


def interaction_audit(rows: DataFrame, part: Column, fails: dict[str, Column], marks: dict[str, Column]) -> DataFrame:
    """Per part, order of the filters and step: what is kept, removed, redundant, failed alone, lost of each mark, and the Shapley sum.

    ``fails`` names each filter by one letter. Marks count the removed rows that have them, in a column of the mark's name.
    The steps of all orders (k * k! rows, 600 for five filters) are a literal table.
    """
    names, spark = list(fails), rows.sparkSession
    columns, noted = [f"fails_{i}" for i in range(len(names))], [f"mark_{i}" for i in range(len(marks))]
    flag = lambda c: F.coalesce(c.cast("boolean"), F.lit(False))
    facts = stored(rows.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), *[flag(c).alias(n) for c, n in zip(fails.values(), columns)],
                               *[flag(c).alias(n) for c, n in zip(marks.values(), noted)]))
    found = stored(interaction_sizes(facts, "part", columns, noted))
    k = len(names)
    weight = F.element_at(F.array(*[F.lit(math.factorial(b) * math.factorial(k - 1 - b)) for b in range(k)]), F.bit_count("before").cast("int") + 1)
    alone = F.bit_count("before") == k - 1
    totals = found.groupBy("part", "filter").agg(
        F.max(F.when(F.col("before") == 0, F.col("removed"))).alias("failing"), F.max(F.when(alone, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * weight).alias("shapley"))
    steps = spark.createDataFrame(orders(names), "filter_order string, step int, filter long, before long")
    return (found.join(totals, ["part", "filter"]).join(F.broadcast(steps), ["filter", "before"])
            .select("part", "filter_order", "step", (F.col("n") - F.col("left_out")).alias("kept"), "removed",
                    (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails",
                    *[F.col(n).alias(m) for n, m in zip(noted, marks)], "shapley"))
