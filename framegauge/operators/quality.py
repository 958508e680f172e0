"""Quality score and summary sentence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points lost per unit share of the table's rows.
MISSING_WEIGHT = 40
DUPLICATE_WEIGHT = 30
OUTLIER_WEIGHT = 30
# The sentences of a summary.
SHAPE = "The dataset contains %,d rows and %d columns."
SIZE = "It occupies approximately %s KB of memory."
NO_MISSING = "No missing values were detected."
SOME_MISSING = "There are %d missing values in the dataset."
NO_DUPLICATES = "No duplicate rows were found."
SOME_DUPLICATES = "%d duplicate rows were detected."


def quality_score(rows: Column, missing: Column, duplicates: Column, outliers: Column) -> Column:
    """100 minus three truncated penalties, at least 0.

    Missing cells and outliers are summed over columns, so their penalties may
    exceed their weights.
    """
    n = F.greatest(rows, F.lit(1))

    def penalty(count: Column, weight: int) -> Column:
        return (count / n * weight).cast("bigint")

    score = (F.lit(100) - penalty(missing, MISSING_WEIGHT) - penalty(duplicates, DUPLICATE_WEIGHT)
             - penalty(outliers, OUTLIER_WEIGHT))
    return F.greatest(score, F.lit(0)).cast("int")


def summary_text(rows: Column, columns: Column, size: Column, missing: Column, duplicates: Column) -> Column:
    """The fixed-template description of a table."""
    kilobytes = F.bround(size.cast("decimal(27,0)") / F.lit(1024).cast("decimal(5,0)"), 2).cast("string")
    return F.concat_ws(
        " ",
        F.format_string(SHAPE, rows, columns), F.format_string(SIZE, kilobytes),
        F.when(missing == 0, F.lit(NO_MISSING)).otherwise(F.format_string(SOME_MISSING, missing)),
        F.when(duplicates == 0, F.lit(NO_DUPLICATES)).otherwise(F.format_string(SOME_DUPLICATES, duplicates)))
