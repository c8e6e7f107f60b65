"""Queries of the scoring operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.operators import scoring as S
from harrow.plans.inputs import EPISODES, K_EVENTS, episodes, keyed_events


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = episodes(spark, sf_dir).withColumns({"item_id": S.item_id(), "o": S.outcome(), "cap": S.hit_cap()})
    d = d.withColumns({"score": F.col("o.score"), "out_passed": F.col("o.passed"), "extraction_failed": F.col("tokens_total") == 0})
    d = d.withColumn("bucket", S.quality_bucket(F.col("stage"), F.col("out_passed"), F.col("coverage_pct"), F.col("semantic_score")))
    return d.select("stage", "item_id", "path", "score", F.col("out_passed").alias("passed"), "bucket", F.col("cap").alias("hit_cap"), "timed_out", "tokens_total", "extraction_failed", F.lit(1).alias("tier"))


def episode_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("stage", "item_id", "path", "score", "passed", "bucket", "hit_cap", S.passing(F.col("bucket")).alias("passing"))


def score_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.normalise(_scored(spark, sf_dir)).select("stage", "item_id", "path", "score", "tokens_norm", "advantage", "sft_weight", "tier")


def _pairs(d: DataFrame) -> DataFrame:
    return d.select("stage", "item_id", "pair_type", F.col("chosen.path").alias("chosen"), F.col("rejected.path").alias("rejected"), F.col("chosen.score").alias("chosen_score"), F.col("rejected.score").alias("rejected_score"), F.col("rejected.tokens_total").alias("rejected_tokens"))


def accuracy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(S.accuracy_pairs(_scored(spark, sf_dir)))


def efficiency_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(S.efficiency_pairs(_scored(spark, sf_dir)))


def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: outcome, normalisation and pairs, counted by stage and type."""
    d = S.normalise(_scored(spark, sf_dir))
    return S.preference_pairs(d).groupBy("stage", "pair_type").agg(F.count("*").alias("pairs"), F.count_distinct("item_id").alias("items"))


def token_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = keyed_events(spark, sf_dir)
    stem = F.concat(F.lit("fn_"), F.when(F.col("event_type") == "error", "compile_fix_01").when(F.col("event_type") == "click", "semantic_repair_02").when(F.col("event_type") == "view", "hang_fix_03").otherwise("judge_packet"))
    t = e.select("user_id", S.trace_kind(stem).alias("kind"), F.when(F.col("k") % 4 != 0, F.col("k").cast("long")).alias("tokens"), F.col("value").alias("elapsed"), (F.col("k") == 7).alias("timed_out"))
    return S.roll_up(t, ["user_id"]).select("user_id", "tokens_gen", "tokens_compile_fix", "tokens_semantic_repair", "tokens_total", "fix_loops", "traces_seen", "elapsed", "timed_out", "extraction_failed")


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of a job: a job per user and hour-of-k; output from k."""
    e, k = keyed_events(spark, sf_dir), F.col("k")
    output = F.when(k % 5 == 0, "READF").when(k % 5 == 1, "UNRESOLVED:unresolved").when(k % 5 == 2, "").when(k % 5 == 3, F.concat(F.lit("1:"), (k % 4).cast("string")))
    call = F.when(k % 3 == 0, "7").when(k % 3 == 1, "NONE")
    d = e.select(F.concat_ws("::", F.col("user_id").cast("string"), "event_type").alias("job"), F.col("event_id").alias("attempt_no"), output.alias("output"), call.alias("call_number"), F.when(k % 10 == 9, "timeout").alias("error"), (k % 6).alias("it"), (k % 4).alias("rnd"), (k % 2).alias("oth"), (k * 1000).cast("long").alias("tok"))
    score = S.attempt_score(F.col("output").isNotNull(), F.col("output"), F.col("call_number"), F.col("it"), F.col("rnd"), F.col("oth"), F.col("tok"))
    return d.withColumn("score", F.when(F.col("error").isNotNull(), F.lit(S.FAILED_ATTEMPT).cast("long")).otherwise(score)).withColumn("simple", S.attempt_score_simple(F.col("output"), F.col("it"), F.col("rnd"), F.col("oth"), F.col("tok")))


def attempt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attempts(spark, sf_dir).select("job", "attempt_no", "score", "simple")


def attempt_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.best_attempt(_attempts(spark, sf_dir), "job")


def attempt_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.majority_attempt(_attempts(spark, sf_dir), "job")


QUERIES = {f.__name__: f for f in (episode_outcome, score_normalise, accuracy_pairs, efficiency_pairs, pair_counts, token_roll_up, attempt_scores, attempt_best, attempt_majority)}

_ACC = """acc as (select r.stage, r.item_id, 'accuracy' as pair_type, b.path as chosen, r.path as rejected, b.score as chosen_score, r.score as rejected_score, r.tokens_total as rejected_tokens
  from normed r join (select * from normed qualify row_number() over (partition by stage, item_id order by score desc, path) = 1) b using (stage, item_id) where r.score < b.score - 1e-9)"""
_ELIG = """elig as (select * from normed where split_part(bucket, '.', 1) = '1' and tokens_total > 0 and not extraction_failed),
eff as (select r.stage, r.item_id, 'efficiency' as pair_type, b.path as chosen, r.path as rejected, b.score as chosen_score, r.score as rejected_score, r.tokens_total as rejected_tokens
  from elig r join (select * from elig qualify row_number() over (partition by stage, item_id, bucket order by tokens_total, path) = 1) b using (stage, item_id, bucket) where r.tokens_total > b.tokens_total)"""
_ATT = K_EVENTS + """,
att0 as (select user_id || '::' || event_type as job, event_id as attempt_no, case k % 5 when 0 then 'READF' when 1 then 'UNRESOLVED:unresolved' when 2 then '' when 3 then '1:' || (k % 4) end as output,
  case k % 3 when 0 then '7' when 1 then 'NONE' end as call_number, case when k % 10 = 9 then 'timeout' end as error, k % 6 as it, k % 4 as rnd, k % 2 as oth, k * 1000 as tok from k_events),
att as (select *, (case when error is not null then -1000000 else case when output is not null then 100 else -500 end
   + case when coalesce(output, '') = '' then -200 when output like '%UNRESOLVED%' then -50 else 50 end + case when output in ('READF', 'WRITEF') then 40 else 0 end + case when call_number = '7' then 10 else 0 end
   - 30 * rnd - 25 * oth - 2 * greatest(0, it - 1) - tok // 20000 end)::bigint as score,
  round((100 - case when output like '%UNRESOLVED%' then 50 else 0 end - 5 * it - 20 * rnd - 10 * oth - 2 * tok / 1000.0)::decimal(20,8), 4)::double as simple from att0)"""
SQL = {
    "episode_outcome": f"with {EPISODES} select stage, item_id, path, score, passed, bucket, hit_cap, split_part(bucket, '.', 1) = '1' as passing from bucketed",
    "score_normalise": f"""with {EPISODES} select stage, item_id, path, score, round(tnorm::decimal(20,8), 4)::double as tokens_norm, round((score - mean_score)::decimal(20,8), 4)::double as advantage,
      case when hit_cap or (timed_out and not passed) then 0.0 else round((score * (1 - 0.2 * tnorm))::decimal(20,8), 4)::double end::double as sft_weight, 2 as tier from normed""",
    "accuracy_pairs": f"with {EPISODES}, {_ACC} select * from acc",
    "efficiency_pairs": f"with {EPISODES}, {_ELIG} select * from eff",
    "pair_counts": f"with {EPISODES}, {_ACC}, {_ELIG} select stage, pair_type, count(*) as pairs, count(distinct item_id) as items from (select * from acc union all select * from eff) group by all",
    "token_roll_up": f"""with {K_EVENTS}, t as (select *, case event_type when 'error' then 'compile_fix' when 'click' then 'semantic_repair' else 'gen' end as kind, case when k % 4 <> 0 then k else 0 end as tok from k_events)
      select user_id, sum(case when kind = 'gen' then tok else 0 end)::bigint as tokens_gen, sum(case when kind = 'compile_fix' then tok else 0 end)::bigint as tokens_compile_fix, sum(case when kind = 'semantic_repair' then tok else 0 end)::bigint as tokens_semantic_repair,
      sum(tok)::bigint as tokens_total, count(*) filter (kind <> 'gen') as fix_loops, count(*) as traces_seen, round(sum(value::decimal(20,8)), 2)::double as elapsed, bool_or(k = 7) as timed_out, sum(tok) = 0 as extraction_failed from t group by user_id""",
    "attempt_scores": f"with {_ATT} select job, attempt_no, score, simple from att",
    "attempt_best": f"with {_ATT} select job, attempt_no, score, output from att qualify row_number() over (partition by job order by score desc, attempt_no) = 1",
    "attempt_majority": f"""with {_ATT}, ok as (select * from att where output is not null and error is null),
      v as (select job, output, call_number, count(*) as votes, min(attempt_no) as first from ok group by all), m as (select job, max(votes) as most from v group by job),
      w as (select v.* from v join m using (job) where most > 1 qualify row_number() over (partition by job order by votes desc, first) = 1),
      a as (select o.* from ok o join w on o.job = w.job and o.output = w.output and o.call_number is not distinct from w.call_number union all select o.* from ok o join m using (job) where most = 1),
      won as (select job, attempt_no, score, output from a qualify row_number() over (partition by job order by score desc, attempt_no) = 1)
      select * from won union all select job, attempt_no, score, output from att where job not in (select job from ok) qualify row_number() over (partition by job order by attempt_no) = 1""",
}
