"""Queries of traces, events and configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.operators import graph as G
from harrow.operators import traces as T
from harrow.plans.inputs import K_EVENTS, keyed_events, table


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_events(spark, sf_dir).select(F.concat_ws("::", F.col("user_id").cast("string"), "event_type").alias("job"), F.col("event_id").alias("path_index"), F.col("k").cast("long").alias("input_tokens"), (F.col("k") * 2).cast("long").alias("output_tokens"))


def function_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.function_totals(_paths(spark, sf_dir), "job")
    return d.withColumn("each_path", F.array_join(F.transform("each_path", lambda x: F.concat_ws(":", x["path_index"].cast("string"), x["input_tokens"].cast("string"), x["output_tokens"].cast("string"))), ","))


def running_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.running_totals(_paths(spark, sf_dir), "job").select("job", "path_index", "total_so_far")


def retry_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    d = keyed_events(spark, sf_dir).select((F.col("event_id") - F.col("event_id") % 3).alias("run"), F.when(k % 3 > 0, k.cast("long")).alias("provider_tokens"), (k + 1).cast("long").alias("estimated_tokens"))
    return T.with_retries(d, "run")


def stub_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    g = table(spark, sf_dir, "supplier").select(F.create_map(F.lit("g"), F.array(F.concat(F.lit("F"), (n % 7).cast("string")), F.concat(F.lit("F"), (n % 3).cast("string"))), F.lit("h"), F.array(F.lit("F0"))).alias("stub_candidates"))
    return T.candidates(g)


def link_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = keyed_events(spark, sf_dir)
    links = e.select("event_id", F.concat(F.lit("w"), F.col("k").cast("string")).alias("symbol"))
    return T.without_overrides(links, e.where("event_type = 'error' and k < 50").select(F.concat(F.lit("w"), F.col("k").cast("string")).alias("symbol"))).select("event_id", "symbol")


def functions_called(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), "p_size")
    return T.called_of_interest(p, table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("callee")))


def paired_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _paths(spark, sf_dir)
    return T.paired(p.select("job", "path_index", "input_tokens"), p.where("path_index % 2 = 0").select("job", "path_index", F.col("output_tokens").alias("dependent")))


def first_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = keyed_events(spark, sf_dir).select(F.col("event_id").alias("id"), F.array("event_type", F.concat(F.lit("n"), F.col("k").cast("string"))).alias("path"))
    return G.first_place(p)


def main_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    f = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("path"), n.alias("pos"), (n % 4 == 0).alias("has_main"), (n % 3 == 0).alias("listed"))
    stays, last = T.main_files(f)
    return f.where(stays).select("path", "pos").join(last, how="cross").select("path", (F.col("path") == F.col("main_file")).alias("is_main"))


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    kind = F.when(k % 4 == 0, "run-failed").otherwise("message")
    status = F.when(k % 5 == 0, "completed").when(k % 5 == 1, "running")
    v = F.try_parse_json(F.concat(F.lit('{"'), F.when(k % 3 == 0, "query").when(k % 3 == 1, "path").otherwise("other"), F.lit('":"'), "event_type", F.lit('"}')))
    return keyed_events(spark, sf_dir).select(
        "event_id", T.terminal(status).alias("done"), T.terminal_event(F.when(k % 7 == 1, "").when(k % 7 > 1, F.col("user_id").cast("string")), F.lit("3"), kind, status).alias("ends"), T.input_summary(v).alias("summary"), T.output_length(status, v).alias("length"), T.backoff(k % 9 + 1).alias("wait"), T.function_name(F.concat("event_type", F.when(k % 2 == 0, "()").otherwise(""))).alias("name_ok"),
        T.test_dir(F.concat(F.lit("/w/src/"), "event_type")).alias("tests"), T.contract(F.concat(F.lit("TEST_PROGRAM = x+\n"), F.when(k % 2 == 0, "TEST_SRCS=t.c \n").otherwise("TEST_SRCS = t.cc\n"), F.when(k % 3 == 0, "$(notdir $(PROD_SRC)).gcov ").otherwise(""), F.lit("gcov -p -b -c")), F.lit("x+"), F.lit("t.c")).alias("contract"),
    )


QUERIES = {f.__name__: f for f in (function_tokens, running_tokens, retry_tokens, stub_candidates, link_list, functions_called, paired_paths, first_places, main_file, session_events)}

_PATHS = K_EVENTS + ", paths as (select user_id || '::' || event_type as job, event_id as path_index, k::bigint as i, (k * 2)::bigint as o from k_events)"
SQL = {
    "function_tokens": f"with {_PATHS} select job, sum(i)::bigint as total_input, sum(o)::bigint as total_output, sum(i + o)::bigint as total, string_agg(path_index || ':' || i || ':' || o, ',' order by path_index) as each_path from paths group by job",
    "running_tokens": f"with {_PATHS} select job, path_index, sum(i + o) over (partition by job order by path_index rows unbounded preceding)::bigint as total_so_far from paths",
    "retry_tokens": f"""with {K_EVENTS} select event_id - event_id % 3 as run, sum(case when k % 3 > 0 then k else k + 1 end)::bigint as tokens, case when bool_and(k % 3 > 0) then 'provider_usage' when bool_or(k % 3 > 0) then 'mixed' else 'approximate' end as token_source, count(*) as attempts from k_events group by 1""",
    "stub_candidates": "select distinct 'F' || unnest([s_suppkey % 7, s_suppkey % 3, 0]) as name from supplier",
    "link_list": f"with {K_EVENTS} select event_id, 'w' || k as symbol from k_events where k not in (select k from k_events where event_type = 'error' and k < 50)",
    "functions_called": "select 'p' || p_partkey as name, p_size from part where p_partkey in (select l_partkey from lineitem)",
    "paired_paths": f"with {_PATHS} select job, path_index, i as input_tokens, o as dependent from paths where path_index % 2 = 0",
    "first_places": f"""with {K_EVENTS}, x as (select event_id as id, unnest([event_type, 'n' || k]) as node, unnest([0, 1]) as pos from k_events) select node, id, pos from x qualify row_number() over (partition by node order by id, pos) = 1""",
    "main_file": "select s_name as path, s_name = (select arg_max(s_name, s_suppkey) from supplier where s_suppkey % 4 = 0 and s_suppkey % 3 = 0) as is_main from supplier where s_suppkey % 4 <> 0 or s_suppkey % 3 = 0",
    "session_events": f"""with {K_EVENTS} select event_id, k % 5 = 0 as done, (k % 7 < 2 or user_id = 3) and (k % 5 = 0 or k % 4 = 0) as ends, case k % 3 when 2 then '{{"other":"' || event_type || '"}}' when 0 then 'query="' || event_type || '"' else 'path="' || event_type || '"' end as summary,
      case k % 5 when 0 then 9 when 1 then 7 else length('{{"":""}}' || case k % 3 when 0 then 'query' when 1 then 'path' else 'other' end || event_type) end::int as length, least(60, 2 ** least(k % 9, 6))::int as wait, k % 2 <> 0 as name_ok, '/w/tests/' || event_type as tests, k % 2 = 0 and k % 3 <> 0 as contract from k_events""",
}
