"""Disaster records matched to storms by date and name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.calendar import imputed_end, imputed_start
from .keyed import count_by, join_keys
from .ranges import overlap_join


def prepare_records(records: DataFrame, pad_days: int = 1) -> DataFrame:
    """Dates imputed and padded, loss in USD with the field it came from."""
    y0, m0, d0 = (F.col(f"start_{p}") for p in ("year", "month", "day"))
    y1, m1, d1 = (F.col(f"end_{p}") for p in ("year", "month", "day"))
    adjusted, raw = F.col("damage_adj_kusd"), F.col("damage_kusd")
    return (records
            .withColumn("start_date", imputed_start(y0, m0, d0))
            .withColumn("end_date", imputed_end(y1, m1, d1))
            .withColumn("date_imputed", (d0.isNull() | d1.isNull()).cast("int"))
            .withColumn("pad_start", F.date_sub("start_date", pad_days))
            .withColumn("pad_end", F.date_add("end_date", pad_days))
            .withColumn("loss_usd", F.coalesce(adjusted, raw) * F.lit(1000.0))
            .withColumn("loss_source", F.when(adjusted.isNotNull(), "adjusted")
                        .when(raw.isNotNull(), "raw_fallback").otherwise("missing")))


def storm_lives(points: DataFrame, storm: str = "storm_id", day: str = "obs_date",
                carry: tuple[str, ...] = ()) -> DataFrame:
    """First and last day of each storm."""
    return points.groupBy(storm).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"),
                                     *[F.min(c).alias(c) for c in carry])


def same_day_steps(points: DataFrame, storm: str = "storm_id", day: str = "obs_date") -> DataFrame:
    """Number of the storm's steps on each of its days, beside every step."""
    return join_keys(points, count_by(points, [storm, day]).withColumnRenamed("n", "same_day"), [storm, day])


def name_scores(pairs: DataFrame, left: str, right: str, fold: bool = True) -> DataFrame:
    """Similarity of two name columns, computed once per distinct pair of names."""
    names = pairs.select(F.col(left).alias("__l"), F.col(right).alias("__r")).distinct()
    for side in ("l", "r"):
        words = tx.canonical(tx.tokens(tx.normalize(F.col(f"__{side}"), fold)))
        names = names.withColumn(f"__t{side}", words)
    both = (F.size("__tl") > 0) & (F.size("__tr") > 0)
    scored = (names.withColumn("__seq", tx.sequence_ratio(F.array_join("__tl", " "), F.array_join("__tr", " ")))
              .withColumn("jaccard", tx.jaccard(F.col("__tl"), F.col("__tr")))
              .withColumn("score", F.when(both, F.greatest("jaccard", "__seq")).otherwise(F.lit(0.0)))
              .select(F.col("__l").alias(left), F.col("__r").alias(right), "jaccard", "score"))
    return join_keys(pairs, scored, [left, right])


def grade_candidates(candidates: DataFrame, record: str, score: str = "score", overlap: str = "overlap",
                     tie: str = "ordinal") -> DataFrame:
    """Rank and grade a record's candidates and flag the selected ones.

    A: a clear best (score >= 0.8 and 0.15 ahead of the second). Otherwise, from 0.6 on, all
    within 0.1 of the best are kept: one is A, several are B. Else all are kept as C. Candidates
    of a record are the storms alive on its few days.
    """
    order = [F.col(score).desc(), F.col(overlap).desc(), F.col(tie).asc()]
    spec = Window.partitionBy(record).orderBy(*order)
    group = Window.partitionBy(record)
    ranked = (candidates.withColumn("rank", F.row_number().over(spec))
              .withColumn("__s1", F.max(score).over(group))
              .withColumn("__s2", F.coalesce(F.max(F.when(F.col("rank") == 2, F.col(score))).over(group), F.lit(0.0)))
              .withColumn("__n", F.count(F.lit(1)).over(group)))
    floor = F.greatest(F.lit(0.6), F.col("__s1") - 0.1)
    ranked = ranked.withColumn("__close", F.sum((F.col(score) >= floor).cast("int")).over(group))
    clear = (F.col("__s1") >= 0.8) & ((F.col("__n") == 1) | (F.col("__s1") - F.col("__s2") >= 0.15))
    grade = (F.when(clear, "A").when(F.col("__s1") >= 0.6, F.when(F.col("__close") == 1, "A").otherwise("B"))
             .otherwise("C"))
    selected = (F.when(clear, F.col("rank") == 1)
                .when(F.col("__s1") >= 0.6, F.col(score) >= floor).otherwise(F.lit(True)))
    return (ranked.withColumn("grade", grade).withColumn("selected", selected)
            .drop("__s1", "__s2", "__n", "__close"))


def match_records(records: DataFrame, storms: DataFrame, record: str = "rec_id", name: str = "event_name",
                  storm_name: str = "storm_name", storm: str = "storm_id") -> DataFrame:
    """Candidates by overlapping dates, scored by name, graded; one row per candidate."""
    pairs = overlap_join(records, storms, ("pad_start", "pad_end"), ("first_day", "last_day"))
    scored = name_scores(pairs, name, storm_name)
    return grade_candidates(scored.withColumn("ordinal", F.col(storm)), record)


def match_audit(records: DataFrame, matches: DataFrame, sources: DataFrame, record: str = "rec_id",
                storm: str = "storm_id") -> DataFrame:
    """One audit row per record, also for those without a candidate."""
    label = F.col(storm).cast("string")
    scored = F.concat(label, F.lit(":"), F.format_string("%.3f", F.col("score")))
    in_order = lambda told, wanted: F.array_join(F.transform(F.array_sort(F.collect_list(
        F.when(wanted, F.struct("rank", told.alias("told"))))), lambda s: s["told"]), ";")
    per_record = matches.groupBy(record).agg(
        F.max("grade").alias("grade"), F.count(F.lit(1)).alias("n_candidates"),
        in_order(label, F.col("selected")).alias("selected_storms"), in_order(scored, F.lit(True)).alias("candidate_groups"))
    status = (F.when(F.col("loss_usd").isNull(), "missing_loss")
              .when(F.col("n_candidates").isNull() | (F.col("source") == "none"), "unmatched")
              .otherwise("matched"))
    return (records.join(per_record, record, "left").join(sources, record, "left")
            .withColumn("status_prealloc", status)
            .withColumn("candidate_groups", F.coalesce("candidate_groups", F.lit("")))
            .withColumn("grade", F.coalesce("grade", F.lit("D")))
            .withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
            .withColumn("selected_storms", F.coalesce("selected_storms", F.lit(""))))
