"""I-Match fingerprints with randomised lexicons, in DataFrame functions only.

The lexicon holds the terms whose share of documents lies in a band: rarer terms are too often typing
errors or names, more frequent ones tell nothing. A document keeps its distinct terms that are in the lexicon,
sorted, and hashes them once for each of several random subsets of the lexicon: slot k keeps one in
so many terms. Small subsets miss most edits and so agree more often
than the whole list does; subsets of several rates make the share of agreeing slots fall evenly as
texts grow apart.

The band's lower end bounds the lexicon: terms in at least a share f of the documents number at most (mean
distinct terms of a document) / f, however large the corpus, which is what lets it be broadcast.

A text with terms but none of the lexicon has the hash of all its sorted distinct terms in every slot.

Defined results: null text is empty text; a slot without terms is null and tells nothing; two fingerprints
are alike by the share of slots that agree among those where either has terms, sparse slots weighing more; if no slot has, by 1 for
equal texts and 0 else; empty tables give no rows; rows that repeat have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERM = r"[\p{L}\p{N}]+"
#: Rates of the random subsets, one in so many terms: as many slots as there are entries.
RATES = tuple(r for r in (8, 32, 128, 512) for _ in range(8))
#: Shares of documents between which a term must lie.
BAND = (0.0005, 0.2)


def terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def term_hash(term: Column) -> Column:
    return F.xxhash64(term)


def lexicon(texts: DataFrame, text: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """Terms in the band, with their hashes, counted over all rows.

    At most (mean distinct terms of a row) / band[0] rows.
    """
    counted = texts.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = texts.agg(F.count(F.lit(1)).alias("total"))
    share = F.col("df") / F.col("total")
    return (counted.join(F.broadcast(total)).filter((share >= band[0]) & (share <= band[1]))
            .select("term", term_hash(F.col("term")).alias("hash")))


def in_slot(term_hashed: Column, slot: int) -> Column:
    """Whether the slot's random subset of the lexicon holds a term: one residue of some bits of its hash."""
    rate = RATES[slot]
    level, place = sorted(set(RATES)).index(rate), RATES[:slot].count(rate)
    return F.pmod(F.shiftright(term_hashed, 12 * level), F.lit(rate)) == place


def slot_hashes(sorted_terms: Column) -> Column:
    """One hash for each slot over the sorted terms it keeps, null where it keeps none."""
    def one(slot: int) -> Column:
        own = F.filter(sorted_terms, lambda t: in_slot(t, slot))
        return F.when(F.size(own) > 0, F.xxhash64(own))
    return F.array(*[one(k) for k in range(len(RATES))])


def fingerprints(texts: DataFrame, keys: list[str], words: DataFrame, columns: list[str]) -> DataFrame:
    """``keys`` and, for each text column, its slots under the same name. The keys identify rows; rows that repeat them are one.

    Terms meet the broadcast lexicon where they are read; only hashes of the terms it holds are gathered, in the order of
    their hashes. If the rows lie together by some of the keys, nothing is shuffled.
    """
    exploded = (texts.select(*keys, F.posexplode(F.array(*[F.col(c) for c in columns])).alias("which", "__text"))
                .select(*keys, "which", terms(F.col("__text")).alias("__terms"))
                # A select of its own: beside the explode it would be worked out for every term.
                .select(*keys, "which", "__terms", F.when(F.size("__terms") > 0, F.xxhash64(F.sort_array("__terms"))).alias("__all"))
                .select(*keys, "which", "__all", F.explode_outer("__terms").alias("term")))
    kept = exploded.join(F.broadcast(words), "term", "left")
    listed = kept.groupBy(*keys).agg(*[F.array_sort(F.collect_set(F.when(F.col("which") == i, F.col("hash")))).alias(c)
                                       for i, c in enumerate(columns)],
                                     *[F.max(F.when(F.col("which") == i, F.col("__all"))).alias(f"__all_{i}") for i in range(len(columns))])
    return listed.select(*keys, *[F.when(F.size(c) > 0, slot_hashes(F.col(c))).otherwise(F.array_repeat(F.col(f"__all_{i}"), len(RATES))).alias(c)
                                  for i, c in enumerate(columns)])


def fingerprint_text(slots: Column) -> Column:
    """The slots in hexadecimal, ``-`` for one without terms."""
    return F.array_join(F.transform(slots, lambda s: F.coalesce(F.lpad(F.hex(s), 16, "0"), F.lit("-"))), "")


def likeness(a: Column, b: Column, equal_texts: Column) -> Column:
    """Share of agreeing slots among those where either holds terms, each weighing its rate.

    A sparse subset seldom holds more than one of two texts' terms, so it agrees about as often as their terms do.
    """
    rates = F.array(*[F.lit(r) for r in RATES])
    pairs = F.transform(F.arrays_zip(a.alias("a"), b.alias("b"), rates.alias("r")), lambda p: F.struct(
        F.when(p["a"].isNotNull() | p["b"].isNotNull(), p["r"]).otherwise(0).alias("told"),
        F.when(p["a"] == p["b"], p["r"]).otherwise(0).alias("same")))
    total = lambda name: F.aggregate(F.transform(pairs, lambda p: p[name]), F.lit(0), lambda s, x: s + x)
    return F.when(equal_texts, F.lit(1.0)).when(total("told") == 0, F.lit(0.0)).otherwise(total("same") / total("told")).cast("double")


def range_bounds(docs: DataFrame, order: str, ranges: int) -> list[int]:
    """At most ``ranges`` - 1 values that cut the rows into ranges of about equal counts."""
    cuts = F.percentile_approx(order, [i / ranges for i in range(1, ranges)], max(10_000, 20 * ranges)) if ranges > 1 else F.array()
    return sorted(set(docs.agg(cuts.alias("cuts")).first()["cuts"] or []))


def range_of(value: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below the value, found in two steps of about the root of their number."""
    width = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i:i + width] for i in range(0, len(bounds), width)]
    if not rows:
        return F.lit(0)
    below = lambda known: F.size(F.filter(known, lambda b: b <= value))
    whole = F.array(*[F.lit(r[0]).cast("long") for r in rows])
    fine = F.array(*[F.array(*[F.lit(b).cast("long") for b in r]) for r in rows])
    row = below(whole)
    return F.when(row == 0, 0).otherwise((row - 1) * width + below(F.element_at(fine, F.greatest(row, F.lit(1)))))


def with_next(docs: DataFrame, bounds: list[int], order: str = "id", tie: str = "key", text: str = "text") -> DataFrame:
    """Distinct rows by (order, tie) with the same columns of their successors, next_*; after the last comes the first.

    Rows are cut into ranges of ``order`` and ordered within their range, in one shuffle. Only the
    ranges' first rows (one a range) are linked across ranges. ``range`` stays, for what comes next lies together by it.
    """
    ranged = docs.withColumn("range", range_of(F.col(order), bounds))
    inside = Window.partitionBy("range").orderBy(order, tie)
    lead = ranged.withColumns({f"next_{c}": F.lead(c).over(inside) for c in (order, tie, text)})
    once = lead.filter(~F.coalesce((F.col(order) == F.col(f"next_{order}")) & (F.col(tie) == F.col(f"next_{tie}")), F.lit(False)))
    first = ranged.groupBy("range").agg(F.min(F.struct(order, tie)).alias("f")).select("range", f"f.{order}", f"f.{tie}")
    heads = (docs.select(order, tie, text).join(F.broadcast(first), [order, tie])  # one row for each range
             .groupBy("range").agg(F.first(F.struct(order, tie, text)).alias("head")))
    whole = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select(F.col("range").alias("__range"), F.coalesce(F.lead("head").over(Window.orderBy("range")), F.first("head").over(whole)).alias("__after"))
    met = once.join(after, F.col("range") == F.col("__range"), "left")
    return met.select(*docs.columns, "range", *[F.when(F.col(f"next_{order}").isNull(), F.col("__after")[c]).otherwise(F.col(f"next_{c}")).alias(f"next_{c}")
                                                for c in (order, tie, text)])
