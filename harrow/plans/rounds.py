"""Queries of the evaluation rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.operators import rounds as R
from harrow.plans.inputs import RUNS, runs, table


def _fp(d: DataFrame) -> DataFrame:
    return d.withColumn("result_fingerprint", R.fingerprint(F.col("task_id"), F.col("setup"), F.col("extracted_code"), F.col("hard_pass")))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fp(R.latest(runs(spark, sf_dir), [*R.KEY, "round"], "line_no"))


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks exist for results of even lines and of rounds 0 and 1; the latest valid one of a round counts."""
    d = _fp(runs(spark, sf_dir)).where((F.col("line_no") % 2 == 0) & (F.col("round") < 2) & R.valid_check())
    return R.latest(d, [*R.KEY, "round"], "line_no")


def latest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest(runs(spark, sf_dir), R.KEY, "line_no").select("task_id", "setup", "line_no", "round", "hard_pass", "extracted_code")


def latest_valid_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checks(spark, sf_dir).select("task_id", "setup", "round", "line_no", "retry", "result_fingerprint")


def checked_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.checked(_results(spark, sf_dir), _checks(spark, sf_dir)).select("task_id", "setup", "round", "line_no")


def retry_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.newest_decision(_results(spark, sf_dir), _checks(spark, sf_dir))


def merged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge_best(R.checked(_results(spark, sf_dir), _checks(spark, sf_dir)))


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("t"), F.col("item_id").cast("string")).alias("task_id"), F.col("item_id").alias("task_pos"))


def missing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _results(spark, sf_dir)
    return R.missing(R.expected(_tasks(spark, sf_dir), r), R.checked(r, _checks(spark, sf_dir)))


def merge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _results(spark, sf_dir)
    d = R.merge_summary(R.merge_best(R.checked(r, _checks(spark, sf_dir))), R.expected(_tasks(spark, sf_dir), r))
    return d.select("selected_count", "missing_pairs", "missing_tasks", F.array_join("missing_task_ids", ",").alias("missing_task_ids"))


def resume_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = R.latest(runs(spark, sf_dir), R.KEY, "line_no").where("hard_pass")
    wanted = R.expected(_tasks(spark, sf_dir), have).join(_tasks(spark, sf_dir), "task_id")
    return R.to_generate(wanted, have, "task_pos", 5).select("task_id", "setup", "task_pos")


def resume_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.latest(runs(spark, sf_dir), R.KEY, "line_no").withColumn("judge_fingerprint", R.fingerprint(F.col("task_id"), F.col("setup"), F.col("k")))
    judged = R.latest(runs(spark, sf_dir).where("line_no % 3 <> 0"), R.KEY, "line_no").withColumn("judge_fingerprint", R.fingerprint(F.col("task_id"), F.col("setup"), F.col("k")))
    return R.to_judge(r, judged).select("task_id", "setup", "k")


def unmatched_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by whether their task is known."""
    r = R.latest(runs(spark, sf_dir), R.KEY, "line_no")
    t = _tasks(spark, sf_dir).withColumn("known", F.lit(True)).select("task_id", "known")
    return r.join(t, "task_id", "left").groupBy("setup").agg(F.count("known").alias("checked"), F.count_if(F.col("known").isNull()).alias("skipped"))


def check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.check_summary(_checks(spark, sf_dir))


def round_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.round_state(runs(spark, sf_dir), _checks(spark, sf_dir))


QUERIES = {f.__name__: f for f in (latest_results, latest_valid_checks, checked_results, retry_decisions, merged_results, missing_pairs, merge_summary, resume_generate, resume_judge, unmatched_results, check_summary, round_state)}

_FP = "sha256(to_json([task_id, setup, extracted_code, hard_pass::varchar])::varchar)"
_BASE = RUNS + f""",
results as (select *, {_FP} as fp from runs qualify row_number() over (partition by task_id, setup, round order by line_no desc) = 1),
checks as (select *, {_FP} as fp from runs where line_no % 2 = 0 and round < 2 and retry <> (classification = 'coherent_c') qualify row_number() over (partition by task_id, setup, round order by line_no desc) = 1),
checked as (select r.* from results r where exists (select 1 from checks c where c.task_id = r.task_id and c.setup = r.setup and c.fp = r.fp and not c.retry)),
merged as (select * from checked qualify row_number() over (partition by task_id, setup order by hard_pass desc, compile_pass desc, required_pass desc, round desc) = 1),
tasks as (select 't' || item_id as task_id, item_id as task_pos from benchmark),
wanted as (select task_id, task_pos, setup from tasks, (select distinct setup from runs)),
latest as (select * from runs qualify row_number() over (partition by task_id, setup order by line_no desc) = 1)"""
SQL = {
    "latest_results": f"with {_BASE} select task_id, setup, line_no, round, hard_pass, extracted_code from latest",
    "latest_valid_checks": f"with {_BASE} select task_id, setup, round, line_no, retry, fp as result_fingerprint from checks",
    "checked_results": f"with {_BASE} select task_id, setup, round, line_no from checked",
    "retry_decisions": f"with {_BASE} select r.task_id, r.setup, arg_max(c.retry, r.round) as retry, max(r.round) as round from results r join checks c using (task_id, setup, round, fp) group by 1, 2",
    "merged_results": f"with {_BASE} select task_id, setup, round, hard_pass, compile_pass, required_pass from merged",
    "missing_pairs": f"with {_BASE} select task_id, setup from wanted w where not exists (select 1 from checked c where c.task_id = w.task_id and c.setup = w.setup)",
    "merge_summary": f"""with {_BASE}, gone as (select task_id, setup from wanted w where not exists (select 1 from merged c where c.task_id = w.task_id and c.setup = w.setup))
      select (select count(*) from merged) as selected_count, (select count(*) from gone) as missing_pairs, (select count(distinct task_id) from gone) as missing_tasks, coalesce((select string_agg(task_id, ',' order by task_id) from (select distinct task_id from gone)), '') as missing_task_ids""",
    "resume_generate": f"""with {_BASE}, hv as (select * from latest where hard_pass), wnt as (select t.task_id, t.task_pos, s.setup from tasks t, (select distinct setup from hv) s)
      select task_id, setup, task_pos from wnt w where not exists (select 1 from hv l where l.task_id = w.task_id and l.setup = w.setup) qualify row_number() over (partition by setup order by task_pos) <= 5""",
    "resume_judge": f"""with {_BASE}, judged as (select * from runs where line_no % 3 <> 0 qualify row_number() over (partition by task_id, setup order by line_no desc) = 1)
      select task_id, setup, k from latest l where not exists (select 1 from judged j where j.task_id = l.task_id and j.setup = l.setup and j.k = l.k)""",
    "unmatched_results": f"with {_BASE} select setup, count(t.task_id) as checked, count(*) filter (t.task_id is null) as skipped from latest l left join tasks t using (task_id) group by setup",
    "check_summary": f"with {_BASE} select round, count(*) as checked, count(*) filter (retry) as bad from checks group by round",
    "round_state": f"with {_BASE} select (select max(round) from checks) as latest_checked_round, (select max(round) from runs where round not in (select round from checks)) as next_unchecked_round",
}
