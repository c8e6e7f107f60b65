"""Score rows and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.exprs import rounded

SCORES = ("task_correctness", "reference_similarity", "code_quality")


def number_in(v: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """A JSON number (never a boolean or a text) within the bounds; v is a VARIANT."""
    kind = F.schema_of_variant(v)
    return F.coalesce((kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL"))) & F.try_variant_get(v, "$", "double").between(lo, hi), F.lit(False))


def valid_score_row(row: Column) -> Column:
    """task_id is a text and the four scores are numbers in [0, 1]; row is a VARIANT."""
    is_text = F.coalesce(F.schema_of_variant(F.try_variant_get(row, "$.task_id", "variant")) == "STRING", F.lit(False))
    ok = is_text
    for c in (*SCORES, "overall"):
        ok = ok & number_in(F.try_variant_get(row, f"$.judge.{c}", "variant"))
    return ok


def overall() -> Column:
    """Weights are fixed values."""
    return rounded(0.45 * F.col("task_correctness") + 0.40 * F.col("reference_similarity") + 0.15 * F.col("code_quality"), 6)


def summary(rows: DataFrame, by: str) -> DataFrame:
    """Count, mean and population deviation of overall, and the means of the three scores; sums are exact decimals."""
    exact = lambda c: F.col(c).cast("decimal(20,8)")
    d = rows.groupBy(by).agg(F.count("overall").alias("n"), F.sum(exact("overall")).alias("_s"), F.sum((exact("overall") * exact("overall")).cast("decimal(30,12)")).alias("_q"), *[F.sum(exact(c)).alias(f"_{c}") for c in SCORES])
    mean = F.col("_s").cast("double") / F.col("n")
    var = F.greatest(F.lit(0.0), F.col("_q").cast("double") / F.col("n") - mean * mean)
    std = F.when(F.col("n") == 1, 0.0).when(F.col("n") > 1, F.sqrt(var))
    return d.select(by, "n", rounded(mean, 4).alias("mean_overall"), rounded(std, 4).alias("std_overall"), *[rounded(F.col(f"_{c}").cast("double") / F.col("n"), 4).alias(f"mean_{c}") for c in SCORES])


def histogram(rows: DataFrame, by: str, value: str, bins: int = 20) -> DataFrame:
    """The share of each bin of [0, 1]; 1.0 lies in the last."""
    b = F.least(F.floor(F.col(value).cast("decimal(20,8)") * bins), F.lit(bins - 1)).cast("int")
    counts = rows.groupBy(by, b.alias("bin")).agg(F.count("*").alias("n"))
    total = counts.groupBy(by).agg(F.sum("n").alias("total"))
    return counts.join(total, by).select(by, "bin", "n", rounded(F.col("n") / F.col("total"), 6).alias("share"))


def only_setup(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The one setup that rows name, or that each group of rows names, as the results of a folder; another number of setups is an error."""
    lo, hi = F.min("setup"), F.max("setup")
    named = F.when(lo == hi, hi).otherwise(F.raise_error(F.concat(F.lit("expected one setup, found "), F.coalesce(F.concat_ws(" and ", lo, hi), F.lit("none")))))
    return rows.groupBy(*by or []).agg(named.alias("setup"))
