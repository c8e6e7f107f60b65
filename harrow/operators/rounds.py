"""Evaluation rounds: latest row wins, checks by fingerprint, outstanding pairs, merge, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["task_id", "setup"]


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key in file order. An aggregate, so one row a key leaves each task."""
    every = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*keys).agg(F.max_by(every, order).alias("_r")).select("_r.*")


def fingerprint(*parts: Column) -> Column:
    """The internal identity of a result: a canonical form that both sides of a join use. As a JSON array, so neither nulls nor signs within parts make two results alike."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def result_payload() -> Column:
    """the result as the JSON object that its published fingerprint is made of; the names and their columns are fixed values."""
    names = {"task_id": "task_id", "setup": "setup", "code": "extracted_code", "raw_response": "raw_response", "required": "required", "called": "called", "missing": "missing", "compile_pass": "compile_pass", "hard_pass": "hard_pass", "input_tokens": "input_tokens", "output_tokens": "output_tokens", "latency_ms": "latency_ms", "rag_queries": "rag_queries"}
    return F.to_json(F.struct(*[F.col(c).alias(n) for n, c in names.items()]), {"ignoreNullFields": "false"})


def judge_payload(result_fingerprint: Column, dev: bool, judge_model: str) -> Column:
    """what a judgment's fingerprint is made of: the result's, the task and the judge. Fixed names."""
    return F.to_json(F.struct(result_fingerprint.alias("result"), F.col("question"), F.col("answer"), F.coalesce("task_required", F.array().cast("array<string>")).alias("required"), F.lit(dev).alias("dev"), F.lit(judge_model).alias("judge_model")), {"ignoreNullFields": "false"})


def in_order(tasks: DataFrame, setups: DataFrame, results: DataFrame) -> DataFrame:
    """The results of known tasks and chosen setups, with both positions to be ordered by. Joins on the keys, not a product that is thinned out afterwards."""
    return results.join(tasks.select("task_id", "task_pos"), "task_id").join(setups.select("setup", "setup_pos"), "setup")


def valid_check() -> Column:
    """A check must say retry exactly when its class is not coherent_c."""
    return F.coalesce(F.col("retry") != (F.col("classification") == "coherent_c"), F.lit(False))


def checked(results: DataFrame, checks: DataFrame) -> DataFrame:
    """Results whose current fingerprint was checked and needs no retry."""
    ok = checks.where(~F.col("retry")).select(*KEY, "result_fingerprint")
    return results.join(ok, [*KEY, "result_fingerprint"], "left_semi")


def newest_decision(results: DataFrame, checks: DataFrame) -> DataFrame:
    """Per pair the retry flag of its newest round among checks that match that round's result."""
    m = results.select(*KEY, "round", "result_fingerprint").join(checks.select(*KEY, "round", "result_fingerprint", "retry"), [*KEY, "round", "result_fingerprint"])
    return m.groupBy(*KEY).agg(F.max_by("retry", "round").alias("retry"), F.max("round").alias("round"))


def merge_best(candidates: DataFrame) -> DataFrame:
    """T5: per pair the best by (hard, compile, required, round)."""
    rank = F.struct("hard_pass", "compile_pass", "required_pass", "round")
    return candidates.groupBy(*KEY).agg(F.max_by(F.struct("round", "hard_pass", "compile_pass", "required_pass"), rank).alias("_b")).select(*KEY, "_b.*")


#: Setups up to which their names are part of the plan.
SETUPS = 10_000


def expected(tasks: DataFrame, observed: DataFrame) -> DataFrame:
    """Tasks times observed setups; the product is the result. Setups are those of configured models: up to SETUPS of them are an array that each task is exploded by, more are a table that tasks are joined with."""
    every = observed.select("setup").where("setup is not null").distinct()
    setups = [r[0] for r in every.limit(SETUPS + 1).collect()]
    ids = tasks.select("task_id").distinct()
    if len(setups) > SETUPS:
        return ids.join(every, how="cross")
    return ids.withColumn("setup", F.explode(F.array(*[F.lit(s) for s in sorted(setups)]) if setups else F.array().cast("array<string>")))


def missing(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """J4, U3."""
    return wanted.join(have.select(*KEY), KEY, "left_anti")


def to_generate(wanted: DataFrame, have: DataFrame, order: str, limit: int | None) -> DataFrame:
    """What has no result yet, the first `limit` of each setup in task order."""
    left = wanted.join(have.select(*KEY), KEY, "left_anti")
    if limit is None:
        return left
    w = Window.partitionBy("setup").orderBy(order)
    return left.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def to_judge(results: DataFrame, judged: DataFrame) -> DataFrame:
    """Results whose latest judgment has another fingerprint, or that have none."""
    return results.join(judged.select(*KEY, "judge_fingerprint"), [*KEY, "judge_fingerprint"], "left_anti")


def merge_summary(merged: DataFrame, wanted: DataFrame) -> DataFrame:
    """A11."""
    lost = missing(wanted, merged).groupBy("task_id").agg(F.count("*").alias("pairs"))
    gone = lost.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("missing_pairs"), F.count("*").alias("missing_tasks"), F.array_sort(F.collect_list("task_id")).alias("missing_task_ids"))
    return merged.agg(F.count("*").alias("selected_count")).join(gone, how="cross")


def check_summary(checks: DataFrame) -> DataFrame:
    """A10."""
    return checks.groupBy("round").agg(F.count("*").alias("checked"), F.count_if("retry").alias("bad"))


def round_state(results: DataFrame, checks: DataFrame) -> DataFrame:
    """The latest round that has checks, and the last that has none."""
    r = results.select("round").distinct()
    c = checks.select("round").distinct().withColumn("has", F.lit(True))
    d = r.join(c, "round", "left")
    return d.agg(F.max(F.when(F.col("has"), F.col("round"))).alias("latest_checked_round"), F.max(F.when(F.col("has").isNull(), F.col("round"))).alias("next_unchecked_round"))
