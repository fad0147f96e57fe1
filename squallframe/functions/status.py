"""PASS / WARN / FAIL columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Order of the statuses and of the match grades.
STATUSES = ("PASS", "WARN", "FAIL")
GRADES = ("A", "B", "C", "D")


def rank_of(status: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STATUSES]), status).cast("int")


def status_of(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATUSES]), rank)


def worst(status: Column) -> Column:
    """Aggregate: the worst status of a group."""
    return status_of(F.max(rank_of(status)))


def grade_priority(grade: Column) -> Column:
    position = F.array_position(F.array(*[F.lit(g) for g in GRADES]), F.upper(F.trim(grade)))
    return F.when(position > 0, position.cast("int") - 1).otherwise(F.lit(len(GRADES)))


def from_counts(fails: Column, warns: Column) -> Column:
    return F.when(fails > 0, F.lit("FAIL")).when(warns > 0, F.lit("WARN")).otherwise(F.lit("PASS"))


def below(value: Column, fail: float | None, warn: float | None) -> Column:
    """Smaller is worse; a missing value warns."""
    out = F.when(value.isNull(), F.lit("WARN"))
    if fail is not None:
        out = out.when(value < fail, F.lit("FAIL"))
    if warn is not None:
        out = out.when(value < warn, F.lit("WARN"))
    return out.otherwise(F.lit("PASS"))


def above(value: Column, fail: float | None, warn: float | None) -> Column:
    """Larger is worse; a missing value warns."""
    out = F.when(value.isNull(), F.lit("WARN"))
    if fail is not None:
        out = out.when(value > fail, F.lit("FAIL"))
    if warn is not None:
        out = out.when(value > warn, F.lit("WARN"))
    return out.otherwise(F.lit("PASS"))


def release_decision(level: Column, status: Column) -> Column:
    """Aggregate: the release verdict over the levels."""
    gate = F.coalesce(F.bool_or(level.isin("L0", "L1", "L4", "L5") & (status == "FAIL")), F.lit(False))
    warn = F.coalesce(F.bool_or(status == "WARN"), F.lit(False))
    return (F.when(gate, F.lit("No Go")).when(warn, F.lit("Conditional Go")).otherwise(F.lit("Go")))


def verdict(fails: dict[str, Column], warns: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Status and the two reason texts of named conditions; an unknown condition does not hold."""
    def named(rules):
        return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    failed, warned = named(fails), named(warns)
    return from_counts(F.size(failed), F.size(warned)), F.array_join(failed, ";"), F.array_join(warned, ";")
