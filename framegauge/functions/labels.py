"""Bands, labels and formats that reports put on profile values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Report labels and the limits they start at.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
SCORE_RANGES = (("90-100", 90), ("80-89", 80), ("70-79", 70), ("60-69", 60), ("<60", None))
STRONG_CORRELATION = 0.7
MISSING_LEVELS = ((50, "high"), (20, "medium"), (0, "low"))
QUALITY_LABELS = ((80, "Excellent dataset quality"), (50, "Dataset needs cleaning"))
LOW_QUALITY_LABEL = "Poor dataset quality"
QUALITY_BANDS = ((90, "green"), (70, "yellow"))
LOW_QUALITY_BAND = "red"
NO_DUPLICATES = "No duplicate rows found."
SOME_DUPLICATES = "Dataset contains duplicate records that may require cleaning."
KILO = 1024


def missing_severity(percent: Column) -> Column:
    label = F.lit("none")
    for limit, name in reversed(MISSING_LEVELS):
        label = F.when(percent > limit, name).otherwise(label)
    return label


def _from_start(score: Column, starts: tuple, below: str) -> Column:
    """Label of the first start, in descending order, that ``score`` reaches."""
    label = F.lit(below)
    for start, name in reversed(starts):
        label = F.when(score >= start, name).otherwise(label)
    return label


def quality_label(score: Column) -> Column:
    return _from_start(score, QUALITY_LABELS, LOW_QUALITY_LABEL)


def quality_band(score: Column) -> Column:
    return _from_start(score, QUALITY_BANDS, LOW_QUALITY_BAND)


def score_range(score: Column) -> Column:
    """Label of the score range; a missing score has none."""
    label = F.lit(SCORE_RANGES[-1][0])
    for name, start in reversed(SCORE_RANGES[:-1]):
        label = F.when(score >= start, name).otherwise(label)
    return F.when(score.isNotNull(), label)


def correlation_label(corr: Column) -> Column:
    return (F.when(corr > STRONG_CORRELATION, "positive")
            .when(corr < -STRONG_CORRELATION, "negative").otherwise("neutral"))


def duplicate_advice(count: Column) -> Column:
    return F.when(F.coalesce(count, F.lit(0)) == 0, NO_DUPLICATES).otherwise(SOME_DUPLICATES)


def fixed(value: Column, decimals: int) -> Column:
    """Fixed-point text without grouping."""
    return F.round(value, decimals).cast(f"decimal(30,{decimals})").cast("string")


def size_label(size: Column, decimals: int = 2, largest: str = "GB") -> Column:
    """Bytes in the largest fitting unit, up to ``largest``."""
    units = ["KB", "MB", "GB"][: ["KB", "MB", "GB"].index(largest) + 1]

    def in_unit(power: int) -> Column:
        return F.concat(fixed(size / F.lit(KILO ** power), decimals), F.lit(f" {units[power - 1]}"))

    label = in_unit(len(units))
    for power in range(len(units) - 1, 0, -1):
        label = F.when(size < KILO ** (power + 1), in_unit(power)).otherwise(label)
    return F.when(size < KILO, F.concat(size.cast("string"), F.lit(" B"))).otherwise(label)


def kilobyte_label(size: Column) -> Column:
    return F.concat(fixed(size / F.lit(KILO), 2), F.lit(" KB"))


def date_label(ts: Column) -> Column:
    return F.date_format(ts, "dd MMM yyyy")


def month_name(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS]), month)


def name_contains(name: Column, search: str) -> Column:
    """Literal, case-insensitive substring test."""
    return F.contains(F.lower(name), F.lower(F.lit(search)))
