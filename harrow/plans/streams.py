"""Queries of streams over events, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.plans.inputs import K_EVENTS, RUNS, runs, table
from harrow.sources.scratch import folder
from harrow.streaming import tables as S


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")


def _parts(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """events as a stream of n files, a file a batch."""
    at = f"{folder(spark)}/parts-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "events")
    for k in range(n):
        d.where(F.col("event_id") % n == k).coalesce(1).write.mode("append").parquet(at)
    return S.tail(spark, at, d.schema, "parquet", 1)


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3: the latest row of each key over five batches, of which two pairs are merged on the way."""
    at, keys = f"{folder(spark)}/stream-{uuid.uuid4().hex}", ["user_id", "event_type"]
    d = _parts(spark, sf_dir, 5).select("user_id", "event_type", "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    S.upsert_latest(d, keys, "event_id", f"{at}/table", f"{at}/log", merge=2).awaitTermination()
    return S.read_latest(spark, f"{at}/table", keys, "event_id")


def stream_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4, T7: the best attempt of each user by keyed state, and the users closed a day after their last row."""
    d = _stream(spark, sf_dir).where("value is not null")
    return S.once(S.best_attempts(d, "user_id", "ts", "event_id", "value", "86400000", "1 hour"))


def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5, J5: tasks asked of two setups, of which one has no results yet, run, run again, and run once more after new tasks came; those without a result, by batch."""
    at = f"{folder(spark)}/resume-{uuid.uuid4().hex}"
    tasks = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("t"), F.col("item_id").cast("string")).alias("task_id"))
    have = lambda: runs(spark, sf_dir).select("task_id", "setup")
    for new in (tasks.where("item_id % 3 = 0"), None, tasks.where("item_id % 3 > 0")):
        if new is not None:
            new.select("task_id").coalesce(1).write.mode("append").json(f"{at}/tasks")
        asked = S.tail(spark, f"{at}/tasks", "task_id string").withColumn("setup", F.explode(F.array(F.lit("view"), F.lit("deep"))))
        S.outstanding(asked, have, ["task_id", "setup"], f"{at}/table", f"{at}/log").awaitTermination()
    return S.asked_so_far(spark, f"{at}/table")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(S.once(S.windowed(_stream(spark, sf_dir), "ts", "1 day", "1 hour", by=("event_type",)), "complete"))


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two days, a new one each day."""
    return _days(S.once(S.windowed(_stream(spark, sf_dir), "ts", "2 days", "1 hour", "1 day", ("event_type",)), "complete"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user, ended by an hour without an event."""
    t = S.once(S.sessions(_stream(spark, sf_dir), "ts", "1 hour", "1 hour", "user_id"), "complete")
    return t.select("user_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(a) for c, a in (("start", "first_at"), ("end", "until"))], "n")


def _days(t: DataFrame) -> DataFrame:
    return t.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


QUERIES = {f.__name__: f for f in (stream_latest, stream_best, stream_resume, stream_windows, stream_sliding, stream_sessions)}
SQL = {
    "stream_latest": f"with {K_EVENTS} select user_id, event_type, event_id, k from k_events qualify row_number() over (partition by user_id, event_type order by event_id desc) = 1",
    "stream_best": """with l as (select user_id, max(ts) as seen, max((value, event_id)) as m from events where value is not null group by 1), b as (select user_id::varchar as key, m[1]::double as score, m[2]::bigint as attempt, seen from l)
      select key, 'best' as event, attempt, score from b union all select key, 'closed', attempt, score from b where seen + interval 1 day <= (select max(ts) from events) - interval 1 hour""",
    "stream_resume": f"with {RUNS}, a as (select 't' || item_id as task_id, unnest(['view', 'deep']) as setup, case when item_id % 3 = 0 then 0 else 1 end::int as batch from benchmark) select * from a anti join runs using (task_id, setup)",
    "stream_windows": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events group by 1, 2",
    "stream_sliding": "select strftime(date_trunc('day', ts) - to_days(b), '%Y-%m-%d') as day, event_type, count(*) as n from events, (values (0), (1)) p(b) group by all",
    "stream_sessions": """with l as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 1 hour then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from l)
      select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_at, strftime(max(ts) + interval 1 hour, '%Y-%m-%d %H:%M:%S') as until, count(*) as n from s group by user_id, s""",
}
