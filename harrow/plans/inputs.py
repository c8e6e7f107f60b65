"""Operator inputs made from the test tables, once for Spark and once as SQL for the check.

The agent logs that the operators read have no table of their own; these are deterministic stand-ins of the same shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with k, the number in props."""
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


K_EVENTS = "k_events as (select *, cast(json_extract_string(props, '$.k') as int) as k from events)"


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One episode per event: stage by event_type, item by user."""
    e, k = keyed_events(spark, sf_dir), F.col("k")
    stage = F.when(F.col("event_type") == "signup", "stubs").when(F.col("event_type").isin("purchase", "view"), "unit-tests").otherwise("minimal")
    return e.select(
        stage.alias("stage"), F.concat(F.lit("item_"), F.col("user_id").cast("string")).alias("safe_id"), F.lit("").alias("safe_name"), F.lit(None).cast("string").alias("func_id"), F.lit("proc").alias("process_name"),
        F.format_string("ep_%09d", "event_id").alias("path"), (k >= 30).alias("validated"), (k >= 50).alias("passed"), (k >= 60).alias("ok"),
        F.least(F.lit(100.0), F.col("value")).alias("coverage_pct"), F.when(k % 11 != 0, k.cast("double")).alias("semantic_score"),
        F.when(k % 13 == 0, "max attempts reached (5)").when(k % 7 == 0, "build failed").alias("error"), (k % 17 == 0).alias("unit_test_failed"), (k % 19 == 0).alias("hit_cap"), (k % 9 == 0).alias("timed_out"), (k * 100).cast("long").alias("tokens_total"),
    )


EPISODES = K_EVENTS + """,
episodes as (select case when event_type = 'signup' then 'stubs' when event_type in ('purchase', 'view') then 'unit-tests' else 'minimal' end as stage,
  'item_' || user_id as item_id, printf('ep_%09d', event_id) as path, k >= 30 as validated, k >= 50 as ep_passed, k >= 60 as ok, least(100.0, value) as cov, case when k % 11 <> 0 then k::double end as sem,
  case when k % 13 = 0 then 'max attempts reached (5)' when k % 7 = 0 then 'build failed' end as error, k % 17 = 0 as unit_failed, k % 19 = 0 or k % 13 = 0 as hit_cap, k % 9 = 0 as timed_out, (k * 100)::bigint as tokens_total from k_events),
scored as (select *, tokens_total = 0 as extraction_failed,
  case stage when 'stubs' then validated when 'unit-tests' then ep_passed else ok end as passed,
  case stage when 'stubs' then case when validated then 1.0 else 0.0 end
    when 'unit-tests' then round((case when not (ep_passed and cov >= 70 and coalesce(sem, 0) >= 75) and (error is not null or unit_failed)
      then least(case when ep_passed then 0.5 else 0.0 end + 0.3 * cov / 100 + 0.2 * coalesce(sem, 0) / 100, 0.2)
      else case when ep_passed then 0.5 else 0.0 end + 0.3 * cov / 100 + 0.2 * coalesce(sem, 0) / 100 end)::decimal(20,8), 4)::double
    else case when ok then 1.0 else 0.0 end end::double as score from episodes),
bucketed as (select *, case when stage = 'unit-tests' then (case when passed then '1' else '0' end) || '.' || floor(cov / 10)::int || '.' || floor(coalesce(sem, 0) / 10)::int else case when passed then '1' else '0' end end as bucket from scored),
grouped as (select *, min(case when tokens_total > 0 then tokens_total end) over g as lo, max(case when tokens_total > 0 then tokens_total end) over g as hi, avg(score) over g as mean_score from bucketed window g as (partition by stage, item_id)),
normed as (select *, case when extraction_failed then 1.0 when tokens_total > 0 and hi > lo then (tokens_total - lo)::double / (hi - lo) else 0.0 end as tnorm from grouped)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results, checks and their fingerprints, one per event: task by user, setup by event type, round by k."""
    e, k = keyed_events(spark, sf_dir), F.col("k")
    return e.select(
        F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("task_id"), F.col("event_type").alias("setup"), (k % 3).alias("round"), F.col("event_id").alias("line_no"), (k >= 70).alias("hard_pass"), (k >= 40).alias("compile_pass"), (k % 2 == 0).alias("required_pass"),
        F.concat(F.lit("code"), k.cast("string")).alias("extracted_code"), (k % 5 == 0).alias("retry"), F.when(k % 5 == 0, "provider_failure").otherwise("coherent_c").alias("classification"), k,
    )


RUNS = K_EVENTS + """,
runs as (select 't' || user_id as task_id, event_type as setup, k % 3 as round, event_id as line_no, k >= 70 as hard_pass, k >= 40 as compile_pass, k % 2 = 0 as required_pass, 'code' || k as extracted_code, k % 5 = 0 as retry,
  case when k % 5 = 0 then 'provider_failure' else 'coherent_c' end as classification, k from k_events)"""
