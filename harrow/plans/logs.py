"""Queries of logs that are written and read back, fingerprints, usage and C sources."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from harrow.functions import udfs as U
from harrow.operators import rounds as R
from harrow.operators import selection as S
from harrow.operators.usage import usage_totals
from harrow.plans.inputs import K_EVENTS, RUNS, keyed_events, runs, table
from harrow.sources import files, sinks
from harrow.sources.scratch import folder


def _new(spark: SparkSession) -> str:
    return f"{folder(spark)}/logs-{uuid.uuid4().hex}"


def log_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results appended to a log in two runs, read back line by line, the latest of each pair."""
    at, d = _new(spark), runs(spark, sf_dir).select("task_id", "setup", F.col("line_no").alias("seq"), "hard_pass", "extracted_code")
    for part in (d.where("seq % 2 = 0"), d.where("seq % 2 = 1")):
        sinks.append_jsonl(part, at)
    rows, _ = files.jsonl(spark, at, "*.json")
    typed = files.exact_rows(rows, StructType.fromDDL("task_id string, setup string, seq long, hard_pass boolean, extracted_code string"))
    return R.latest(typed.drop("name", "line_no"), R.KEY, "seq")


def log_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks written once and read strictly."""
    at = _new(spark)
    sinks.create(table(spark, sf_dir, "benchmark").select(F.concat(F.lit("t"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("question"), F.lit("a").alias("answer"), F.array(F.lit("f"), F.lit("g")).alias("required")), at)
    return files.tasks(*files.jsonl(spark, at, "*.json")).select("id", F.md5(F.encode("question", "UTF-8")).alias("question_md5"), F.array_join("required", ",").alias("required"), "answer")


def _log(spark: SparkSession, d: DataFrame, line: Column) -> str:
    """A log of (task_id, line_no): files of whole tasks, each in order of line_no."""
    at = _new(spark)
    d.repartition("task_id").sortWithinPartitions("line_no").select(line.alias("value")).write.text(at)
    return at


def log_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log for each kind of event, its lines numbered as they stand there; every other line is no object."""
    at, d = _new(spark), keyed_events(spark, sf_dir)
    line = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct("event_id", "props"))).otherwise(F.concat(F.lit("event "), F.col("event_id").cast("string")))
    d.repartition("event_type").sortWithinPartitions("event_type", "event_id").select("event_type", line.alias("value")).write.partitionBy("event_type").text(at)
    rows, rejects = files.jsonl(spark, at, "*.txt")
    kind = F.regexp_extract("path", "event_type=([a-z]+)/", 1).alias("event_type")
    both = rows.select(kind, "line_no", F.try_variant_get("row", "$.event_id", "long").alias("event_id"))
    return both.union(rejects.select(kind, "line_no", F.regexp_extract("line", "[0-9]+", 0).cast("long")))


def log_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments of which six of nine have a fault each; the last valid one of each pair."""
    d, n = runs(spark, sf_dir), F.col("line_no")
    fault, f = n % 9, F.concat(F.lit('"f'), n.cast("string"), F.lit('"'))
    judge = F.when(fault == 3, '{"error": null, "overall": 1}').when(fault == 4, "[1]").when(fault == 8, "null").otherwise('{"overall": 0.5, "note": "error"}')
    line = F.concat(F.lit("{"), F.when(fault == 7, "").otherwise(F.concat(F.lit('"task_id": "'), "task_id", F.lit('", '))), F.lit('"setup": '), F.when(fault == 6, "null").otherwise(F.concat(F.lit('"'), "setup", F.lit('"'))), F.lit(', "judge_fingerprint": '), F.when(fault == 5, n.cast("string")).otherwise(f), F.lit(', "judge": '), judge, F.lit("}"))
    return files.judgments_latest(files.jsonl(spark, _log(spark, d, line), "*.txt")[0]).drop("line_no")


def log_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of which nine of twelve have a fault each; the last valid one of each pair, with its round."""
    d, n = runs(spark, sf_dir), F.col("line_no")
    fault, text = n % 12, n.cast("string")
    kind = F.when(fault == 6, "odd").when((fault == 7) | (fault == 2), "coherent_c").otherwise(F.when(n % 2 == 0, "non_code").otherwise("empty_output"))
    retry = F.when(fault == 5, '"true"').when(fault == 2, "false").otherwise("true")
    check = F.concat(F.lit('{"retry": '), retry, F.lit(', "classification": "'), kind, F.lit('"'), F.when(fault == 4, "").otherwise(F.concat(F.lit(', "reasoning": '), F.when(fault == 10, "null").otherwise(F.concat(F.lit('"r'), text, F.lit('"'))))), F.when(fault == 3, ', "more": 1').otherwise(""), F.lit("}"))
    line = F.concat(F.lit('{"task_id": "'), "task_id", F.lit('", "setup": "'), "setup", F.lit('", '), F.when(fault == 11, "").otherwise(F.concat(F.lit('"result_fingerprint": '), F.when(fault == 8, text).otherwise(F.concat(F.lit('"f'), text, F.lit('"'))), F.lit(", "))), F.lit('"round": '), F.col("round").cast("string"), F.lit(', "check": '), check, F.when(fault == 9, "").otherwise("}"))
    return files.checks_latest(files.jsonl(spark, _log(spark, d, line), "*.txt")[0]).drop("line_no")


def log_by_setup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: a folder for each setup, read back with the setup from the folder's name."""
    at = _new(spark)
    sinks.by_setup(runs(spark, sf_dir).select("task_id", "setup", "line_no"), at)
    return spark.read.json(at).groupBy("setup").agg(F.count("*").alias("n"), F.sum("line_no").alias("lines"))


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return runs(spark, sf_dir).withColumns({"raw_response": F.concat(F.lit("r"), k.cast("string")), "required": F.array(F.lit("f"), F.lit("g")), "called": F.array(F.lit("g")), "missing": F.array(F.lit("f")), "input_tokens": k.cast("long"), "output_tokens": F.when(k % 2 == 0, k.cast("long")), "latency_ms": (k * 3).cast("long"), "rag_queries": F.array().cast("array<string>")})


def result_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the published fingerprints, byte for byte."""
    d = _full(spark, sf_dir).withColumn("fingerprint", U.canonical_sha256(R.result_payload()))
    d = d.withColumns({"question": F.concat(F.lit("q"), "task_id"), "answer": F.lit("a"), "task_required": F.when(F.col("k") % 2 == 0, F.array(F.lit("f")))})
    return d.select("line_no", "fingerprint", U.canonical_sha256(R.judge_payload(F.col("fingerprint"), False, "m")).alias("judge"))


def usage_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: the tokens that a trace states, at any depth and in texts that hold JSON."""
    k = F.col("k").cast("string")
    x = F.concat(F.lit('{"usage": {"prompt_tokens": '), k, F.lit(', "completion_tokens": 1, "Total_Tokens": '), F.when(F.col("k") % 2 == 0, F.col("k") + 5).otherwise(0).cast("string"), F.lit(', "max_tokens": 999}, "steps": [{"token_count": 3}, {"body": "{\\"tokens\\": 4}"}, {"body": "{\\"n\\": 4}"}], "flag_tokens": true}'))
    # A split of the small columns of events makes texts of many times its bytes: they are dealt out by rows.
    d = keyed_events(spark, sf_dir).select("event_id", "k").repartition(4 * spark.sparkContext.defaultParallelism, "event_id")
    return usage_totals(d.select("event_id", x.alias("text")), "event_id", "text")


def ordered_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2."""
    tasks = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("t"), F.col("item_id").cast("string")).alias("task_id"), F.col("item_id").alias("task_pos"))
    setups = spark.createDataFrame([("view", 0), ("click", 1)], "setup string, setup_pos int")
    return R.in_order(tasks, setups, R.latest(runs(spark, sf_dir), R.KEY, "line_no")).select("task_id", "setup", "line_no", "task_pos", "setup_pos").orderBy("task_pos", "setup_pos")


def selected_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P27."""
    k = F.col("k")
    text = k.cast("string")
    x = F.concat(F.lit('{"func_id": "'), F.when(k % 2 == 0, text).otherwise(""), F.lit('", "passed": '), F.when(k % 3 == 0, "true").otherwise("false"), F.when(k % 4 == 0, ', "coverage_pct": null').when(k % 4 == 1, F.concat(F.lit(', "coverage_pct": '), text)).otherwise(""), F.lit(', "result": {"func_id": "'), F.when(k % 5 > 0, "r").otherwise(""), F.lit('", "passed": '), F.when(k % 7 == 0, "true").otherwise("false"), F.lit(', "coverage_pct": 90, "verdict": "v"}}'))
    d = keyed_events(spark, sf_dir).select("event_id", F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("folder"), F.parse_json(x).alias("selected"))
    return S.selected_units(d)


def known_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U9."""
    n = F.col("s_suppkey")
    name = lambda c: F.concat(F.lit("s"), c.cast("string"))
    d = table(spark, sf_dir, "supplier").select(name(n).alias("name"), F.array(name(n * 3), name(n), name(n - 1)).alias("dependents"))
    return S.known_dependents(d).select("name", F.array_join("known", ",").alias("known"), "check_others")


def c_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions and calls of C texts, comments and strings out of the way."""
    k = F.col("k").cast("string")
    x = F.concat(F.lit("static int f"), k, F.lit("(int a) {\n  /* g(1); } */ char *s = \"h(2) {\";\n  g"), k, F.lit("(a, &cb);\n  return (*fp)(1);\n}\n// z() {\nvoid main(void)\n{ f"), k, F.lit("(3); }\n"))
    d = keyed_events(spark, sf_dir).select("event_id", U.c_definitions(x).alias("d"), U.c_calls(x).alias("c"), U.blank_comments(x).alias("b"))
    defs = F.transform("d", lambda e: F.concat_ws(":", e["name"], e["is_static"].cast("string"), e["start_line"].cast("string"), e["end_line"].cast("string")))
    calls = F.transform("c", lambda e: F.concat_ws(":", e["callee"], e["line_number"].cast("string"), F.array_join(e["passed"], "+")))
    return d.select("event_id", F.array_join(defs, ",").alias("definitions"), F.array_join(calls, ",").alias("calls"), F.contains("b", F.lit("z()")).alias("comment_left"))


def _c_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k").cast("string")
    x = F.concat(F.lit("void a(void) {\n  f"), k, F.lit("(&cb, (int)x, g(1));\n  s->run(2); /* no(3); */\n  (*fp)(4);\n  t.m[i](cb);\n  sizeof(int);\n}\n"))
    return keyed_events(spark, sf_dir).select("event_id", "k", x.alias("text"))


def _c_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _c_texts(spark, sf_dir).select("event_id", "k", F.inline(U.c_written_calls("text")))


def c_call_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three policies of what is a callee, each by the calls of one walk through the text."""
    plain = F.col("callee") == F.col("written")
    each = F.array(F.when(plain, F.struct(F.lit("identifier").alias("policy"), "callee")), F.struct(F.lit("indirect").alias("policy"), "callee"), F.struct(F.lit("text").alias("policy"), F.col("written").alias("callee")))
    passed = F.array_join(F.array_distinct(F.array_compact("names")), "+")
    return _c_calls(spark, sf_dir).select("event_id", "line_number", passed.alias("passed"), F.inline(F.array_compact(each))).select("event_id", "policy", "callee", "line_number", "passed")


def c_callback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callbacks at configured places of the callees that have any."""
    places = F.when(F.col("written").isin("g") | (F.col("written") == F.concat(F.lit("f"), F.col("k").cast("string"))), F.array(F.lit(1)))
    names = F.array_distinct(F.array_compact(F.transform("places", lambda p: F.get("names", p - 1))))
    return _c_calls(spark, sf_dir).withColumn("places", places).where("places is not null").select("event_id", "callee", F.explode(names).alias("callback"))


def c_test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered tests and definitions as rows of table functions."""
    U.register(spark)
    k = F.col("k").cast("string")
    x = F.concat(F.lit("static void t"), k, F.lit("(void) { init(); }\nvoid add(void) {\n  CU_add_test(s, \"one\", t"), k, F.lit(");\n  CU_add_test(s, \"two\", lost);\n}\n"))
    d = keyed_events(spark, sf_dir).select("event_id", x.alias("text"))
    tests = spark.sql("SELECT t.event_id, c.name, c.body, c.registration FROM {t} t, LATERAL c_tests_in(t.text, 'p') c", t=d)
    found = spark.sql("SELECT t.event_id, c.name, concat_ws(':', c.is_static, c.start_line, c.end_line) AS body, CAST(NULL AS STRING) AS registration FROM {t} t, LATERAL c_definitions_in(t.text) c", t=d)
    return tests.union(found)


QUERIES = {f.__name__: f for f in (log_results, log_tasks, log_line_numbers, log_judgments, log_checks, log_by_setup, result_fingerprints, usage_roll_up, ordered_results, selected_units, known_dependents, c_sources, c_call_rows, c_callback_rows, c_test_rows)}

_PAYLOAD = """'{"called": ["g"], "code": "' || extracted_code || '", "compile_pass": ' || compile_pass || ', "hard_pass": ' || hard_pass || ', "input_tokens": ' || k || ', "latency_ms": ' || 3 * k || ', "missing": ["f"], "output_tokens": ' || case when k % 2 = 0 then k::varchar else 'null' end || ', "rag_queries": [], "raw_response": "r' || k || '", "required": ["f", "g"], "setup": "' || setup || '", "task_id": "' || task_id || '"}'"""
SQL = {
    "log_results": f"with {RUNS} select task_id, setup, line_no as seq, hard_pass, extracted_code from runs qualify row_number() over (partition by task_id, setup order by line_no desc) = 1",
    "log_tasks": "select 't' || item_id as id, md5(text) as question_md5, 'f,g' as required, 'a' as answer from benchmark",
    "log_line_numbers": "select event_type, row_number() over (partition by event_type order by event_id) as line_no, event_id from events",
    "log_judgments": f"with {RUNS} select task_id, setup, 'f' || line_no as judge_fingerprint from runs where line_no % 9 < 3 qualify row_number() over (partition by task_id, setup order by line_no desc) = 1",
    "log_checks": f"with {RUNS} select task_id, setup, 'f' || line_no as result_fingerprint, line_no % 12 <> 2 as retry, case when line_no % 12 = 2 then 'coherent_c' when line_no % 2 = 0 then 'non_code' else 'empty_output' end as classification, 'r' || line_no as reasoning, round from runs where line_no % 12 < 3 qualify row_number() over (partition by task_id, setup order by line_no desc) = 1",
    "log_by_setup": f"with {RUNS} select setup, count(*) as n, sum(line_no)::bigint as lines from runs group by 1",
    "result_fingerprints": f"""with {RUNS}, f as (select *, sha256({_PAYLOAD}) as fp from runs)
      select line_no, fp as fingerprint, sha256('{{"answer": "a", "dev": false, "judge_model": "m", "question": "q' || task_id || '", "required": ' || case when k % 2 = 0 then '["f"]' else '[]' end || ', "result": "' || fp || '"}}') as judge from f""",
    "usage_roll_up": f"with {K_EVENTS} select event_id, greatest(k + 1, case when k % 2 = 0 then k + 5 else 0 end)::bigint + 3 + 4 as tokens from k_events",
    "ordered_results": f"with {RUNS}, l as (select * from runs where setup in ('view', 'click') qualify row_number() over (partition by task_id, setup order by line_no desc) = 1) select task_id, setup, line_no, item_id as task_pos, case setup when 'view' then 0 else 1 end::int as setup_pos from l join benchmark on task_id = 't' || item_id",
    "selected_units": f"""with {K_EVENTS} select 'd' || event_id as function_key, case when k % 2 = 0 then k::varchar when k % 5 > 0 then 'r' else 'd' || event_id end as func_id, k % 3 = 0 or k % 7 = 0 as passed, case k % 4 when 0 then null when 1 then k else 90 end::double as coverage_pct, null::double as semantic_score, 'v' as verdict from k_events""",
    "known_dependents": """with s as (select s_suppkey as n from supplier), d as (select a.n, p.pos, p.dep from s a, lateral (select unnest([0, 1, 2]) as pos, unnest([a.n * 3, a.n, a.n - 1]) as dep) p), k as (select n, string_agg('s' || dep, ',' order by pos) as known, arg_min(dep, pos) as first from d where dep in (select n from s) group by 1)
      select 's' || n as name, known, first <> n as check_others from k""",
    "c_sources": f"with {K_EVENTS} select event_id, 'f' || k || ':true:1:5,main:false:7:8' as definitions, 'g' || k || ':3:a+cb,f' || k || ':8:' as calls, false as comment_left from k_events",
    "c_call_rows": f"""with {K_EVENTS}, c as (select event_id, k, unnest(['identifier', 'indirect', 'text']) as policy from k_events), x as (
        select event_id, policy, unnest([{{'c': 'f' || k, 'l': 2, 'p': 'cb+x', 'only': ['identifier', 'indirect', 'text']}}, {{'c': 'g', 'l': 2, 'p': '', 'only': ['identifier', 'indirect', 'text']}}, {{'c': 's->run', 'l': 3, 'p': '', 'only': ['text']}}, {{'c': '(*fp)', 'l': 4, 'p': '', 'only': ['text']}}, {{'c': 't.m[i]', 'l': 5, 'p': 'cb', 'only': ['text']}},
          {{'c': 'indirect_call', 'l': 3, 'p': '', 'only': ['indirect']}}, {{'c': 'indirect_call', 'l': 4, 'p': '', 'only': ['indirect']}}, {{'c': 'indirect_call', 'l': 5, 'p': 'cb', 'only': ['indirect']}}]) as x from c)
      select event_id, policy, x.c as callee, x.l::int as line_number, x.p as passed from x where list_contains(x.only, policy)""",
    "c_callback_rows": f"with {K_EVENTS} select event_id, 'f' || k as callee, 'cb' as callback from k_events",
    "c_test_rows": f"""with {K_EVENTS} select event_id, 'p_t' || k as name, 'void p_t' || k || '(void) {{ init(); }}' as body, 'CU_add_test(suite, "one", p_t' || k || ');' as registration from k_events
      union all select event_id, 'p_lost', null, 'CU_add_test(suite, "two", p_lost);' from k_events union all select event_id, 't' || k, 'true:1:1', null from k_events union all select event_id, 'add', 'false:2:5', null from k_events""",
}
