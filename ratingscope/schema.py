"""The long ratings table and the tables made from it.

ratings: one row for each cell (giver, recipient) of a team's matrix, self included; a missing score is NULL, never NaN.
Operators take ``keys``, the columns that name a team's matrix; variants and permutations only add a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["csv_path", "team", "question"]
RATINGS = "csv_path string, year string, semester string, session_number int, team string, question string, giver string, recipient string, score double"
IWF = "email string, model string, iwf double, hub double, converged boolean, iterations int, final_l1 double, error string"


def no_nan(df: DataFrame, column: str = "score") -> DataFrame:
    """NaN means missing where tables come from elsewhere; inside it is NULL, which aggregates skip."""
    return df.withColumn(column, F.when(~F.isnan(column), F.col(column)))


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Equality of keys, NULL equal to NULL."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Correlation from sums; 0 where it is undefined (fewer than two points, or a constant side). A variance of less
    than a 1e-12th of the mean square counts as none, for sums of equal numbers need not cancel exactly."""
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    fine = (n >= 2) & (vx > F.lit(1e-12) * sxx) & (vy > F.lit(1e-12) * syy)
    return F.when(fine, (sxy - sx * sy / n) / F.sqrt(vx * vy)).otherwise(0.0)
