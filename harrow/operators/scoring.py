"""Episode scores: outcome, token roll-up, normalisation within an item's group, preference pairs, attempt scores."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.exprs import filled, first_true, rounded, truthy

#: Weights of passed, coverage and semantic score; how far token cost lowers a weight. Fixed values.
PASSED_W, COVERAGE_W, SEMANTIC_W, COST = 0.5, 0.3, 0.2, 0.2
FAILED_CAP = 0.2
GROUP = ["stage", "item_id"]


@dataclass(frozen=True)
class Gate:
    coverage: float = 70.0
    semantic: float = 75.0


def outcome(gate: Gate = Gate()) -> Column:
    """struct(score, passed) from stage, validated, passed, ok, coverage_pct, semantic_score, error, unit_test_failed."""
    cov, sem = F.coalesce("coverage_pct", F.lit(0.0)), F.coalesce("semantic_score", F.lit(0.0))
    passed = truthy(F.col("passed"))
    raw = F.when(passed, PASSED_W).otherwise(0.0) + COVERAGE_W * cov / 100 + SEMANTIC_W * sem / 100
    gated = passed & (cov >= gate.coverage) & (sem >= gate.semantic)
    failed = filled(F.col("error")).isNotNull() | truthy(F.col("unit_test_failed"))
    unit = F.when(~gated & failed, F.least(raw, F.lit(FAILED_CAP))).otherwise(raw)
    ok = lambda c: F.when(truthy(F.col(c)), 1.0).otherwise(0.0)
    stubs, units = F.col("stage").isin("collect-stubs", "stubs"), F.col("stage").isin("collect-unit-tests", "unit-tests")
    score = F.when(stubs, ok("validated")).when(units, rounded(unit, 4)).otherwise(ok("ok"))
    flag = F.when(stubs, truthy(F.col("validated"))).when(units, passed).otherwise(truthy(F.col("ok")))
    return F.struct(score.alias("score"), flag.alias("passed"))


def hit_cap() -> Column:
    """P5."""
    return truthy(F.col("hit_cap")) | F.coalesce(F.startswith("error", F.lit("max attempts reached")), F.lit(False))


def item_id() -> Column:
    """Empty counts as missing."""
    return F.coalesce(*[filled(F.col(c)) for c in ("safe_id", "safe_name", "func_id", "process_name")], F.lit("unknown"))


def quality_bucket(stage: Column, passed: Column, coverage: Column, semantic: Column) -> Column:
    """P7."""
    bit = F.when(passed, "1").otherwise("0")
    band = lambda x: F.floor(F.coalesce(x, F.lit(0.0)) / 10).cast("int").cast("string")
    return F.when(stage.isin("collect-unit-tests", "unit-tests"), F.concat_ws(".", bit, band(coverage), band(semantic))).otherwise(bit)


def passing(bucket: Column) -> Column:
    """P8."""
    return F.split_part(bucket, F.lit("."), F.lit(1)) == "1"


def trace_kind(stem: Column) -> Column:
    """Markers are whole underscore-parted words; a hang fix is no marker."""
    s = F.concat(F.lit("_"), F.lower(stem), F.lit("_"))
    return first_true((s.rlike("_(stub_fix|compile_fix|integrate_fix|pre_integration_fix|master_fix|integrate_cleanup)_"), "compile_fix"), (F.contains(s, F.lit("_semantic_repair_")), "semantic_repair"), default="gen")


def roll_up(traces: DataFrame, keys: list[str]) -> DataFrame:
    """A1: traces (keys, kind, tokens, elapsed, timed_out) to one row per episode; partial sums before the shuffle."""
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.coalesce("tokens", F.lit(0))).otherwise(0)).alias(f"tokens_{k}")
    kinds = ("gen", "compile_fix", "semantic_repair")
    d = traces.groupBy(*keys).agg(*[of(k) for k in kinds], F.count_if(F.col("kind") != "gen").alias("fix_loops"), F.count("*").alias("traces_seen"), F.sum(F.coalesce("elapsed", F.lit(0.0)).cast("decimal(20,8)")).alias("_e"), F.coalesce(F.bool_or("timed_out"), F.lit(False)).alias("timed_out"))
    total = sum((F.col(f"tokens_{k}") for k in kinds), F.lit(0))
    return d.withColumn("tokens_total", total).withColumn("extraction_failed", F.col("tokens_total") == 0).withColumn("elapsed", rounded(F.col("_e"), 2)).drop("_e")


def normalise(scores: DataFrame) -> DataFrame:
    """Adds tokens_norm, advantage, sft_weight and tier. A group's bounds and mean are added up in each task first and joined back, so that no task gathers a group."""
    t = F.when(F.col("tokens_total") > 0, F.col("tokens_total"))
    of = scores.groupBy(*[F.col(c).alias(f"_{c}") for c in GROUP]).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"), F.avg(F.col("score").cast("decimal(20,8)")).alias("_mean"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in GROUP]
    d = scores.join(of, reduce(and_, same), "left").drop(*[f"_{c}" for c in GROUP])
    norm = F.when(F.col("extraction_failed"), 1.0).when((F.col("tokens_total") > 0) & (F.col("_hi") > F.col("_lo")), (F.col("tokens_total") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    blocked = F.col("hit_cap") | (F.col("timed_out") & ~F.col("passed"))
    d = d.withColumn("_norm", norm)
    return d.withColumns({"tokens_norm": rounded(F.col("_norm"), 4), "advantage": rounded(F.col("score") - F.col("_mean"), 4), "sft_weight": F.when(blocked, 0.0).otherwise(rounded(F.col("score") * (1 - COST * F.col("_norm")), 4)), "tier": F.greatest(F.coalesce("tier", F.lit(0)), F.lit(2))}).drop("_lo", "_hi", "_mean", "_norm")


def accuracy_pairs(scores: DataFrame) -> DataFrame:
    """A group's best against each strictly worse member; ties go to the first path."""
    side = F.struct("path", "score", "tokens_total")
    best = scores.groupBy(*GROUP).agg(F.min_by(side, F.struct((-F.col("score")).alias("s"), "path")).alias("chosen"))
    return scores.select(*GROUP, side.alias("rejected")).join(best, GROUP).where(F.col("rejected.score") < F.col("chosen.score") - 1e-9).select(*GROUP, F.lit("accuracy").alias("pair_type"), "chosen", "rejected")


def efficiency_pairs(scores: DataFrame) -> DataFrame:
    """In a passing bucket, the cheapest against each costlier member."""
    side = F.struct("path", "score", "tokens_total")
    d = scores.where(passing(F.col("bucket")) & (F.col("tokens_total") > 0) & ~F.col("extraction_failed"))
    cheap = d.groupBy(*GROUP, "bucket").agg(F.min_by(side, F.struct("tokens_total", "path")).alias("chosen"))
    return d.select(*GROUP, "bucket", side.alias("rejected")).join(cheap, [*GROUP, "bucket"]).where(F.col("rejected.tokens_total") > F.col("chosen.tokens_total")).select(*GROUP, F.lit("efficiency").alias("pair_type"), "chosen", "rejected")


def preference_pairs(scores: DataFrame) -> DataFrame:
    return accuracy_pairs(scores).unionByName(efficiency_pairs(scores))


def attempt_score(answered: Column, output: Column, call_number: Column, iterations: Column, random_calls: Column, other_errors: Column, tokens: Column) -> Column:
    """Additive heuristic."""
    out = F.coalesce(output, F.lit(""))
    unresolved = F.regexp_count(F.upper(out), F.lit("UNRESOLVED"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    known = F.coalesce(~call_number.isin("None", "NONE", "UNRESOLVED", ""), F.lit(False))
    return (
        F.when(answered, 100).otherwise(-500)
        + F.when(out == "", -200).when(unresolved == 0, 50).otherwise(-25 * unresolved)
        + F.when(out.isin("READF", "WRITEF"), 40).otherwise(0)
        + F.when(known, 10).otherwise(0)
        - 30 * zero(random_calls)
        - 25 * zero(other_errors)
        - 2 * F.greatest(F.lit(0), zero(iterations) - 1)
        - F.floor(zero(tokens) / 20_000)
    ).cast("long")


def attempt_score_simple(output: Column, iterations: Column, random_calls: Column, other_errors: Column, tokens: Column) -> Column:
    """R2."""
    return rounded(F.lit(100.0) - F.when(F.contains(F.coalesce(output, F.lit("")), F.lit("UNRESOLVED")), 50).otherwise(0) - 5 * iterations - 20 * random_calls - 10 * other_errors - 2 * tokens / 1000, 4)


#: The score of an attempt that failed. Fixed value.
FAILED_ATTEMPT = -1_000_000


def best_attempt(attempts: DataFrame, key: str) -> DataFrame:
    """Highest score; ties go to the first attempt."""
    return attempts.groupBy(key).agg(F.max_by(F.struct("attempt_no", "score", "output"), F.struct("score", -F.col("attempt_no"))).alias("b")).select(key, "b.*")


def majority_attempt(attempts: DataFrame, key: str) -> DataFrame:
    """The best of the most common answer; if all differ, the best; with no success, the first attempt. The answer that comes first wins among equally common ones."""
    ok = attempts.withColumn("ok", F.col("output").isNotNull() & F.col("error").isNull())
    votes = ok.where("ok").groupBy(key, "output", "call_number").agg(F.count("*").alias("votes"), F.min("attempt_no").alias("first"), F.max_by(F.struct("attempt_no", "score", "output"), F.struct("score", -F.col("attempt_no"))).alias("best"))
    top = F.max_by("best", F.struct("votes", -F.col("first")))
    alone = F.max_by("best", F.struct("best.score", -F.col("best.attempt_no")))
    won = votes.groupBy(key).agg(F.when(F.max("votes") > 1, top).otherwise(alone).alias("b"))
    none = ok.groupBy(key).agg(F.bool_or("ok").alias("any"), F.min_by(F.struct("attempt_no", "score", "output"), "attempt_no").alias("b")).where("not any")
    return won.select(key, "b.*").unionByName(none.select(key, "b.*"))
