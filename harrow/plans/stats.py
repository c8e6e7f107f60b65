"""Queries of score statistics and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.operators import coverage as C
from harrow.operators import stats as S
from harrow.plans.inputs import K_EVENTS, keyed_events, table


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    d = d.select("doc_id", "source", F.col("quality").cast("double").alias("task_correctness"), (1 - F.col("toxic")).cast("double").alias("reference_similarity"), F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("code_quality"))
    return d.withColumn("overall", S.overall())


def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.summary(_scores(spark, sf_dir), "source")


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.histogram(_scores(spark, sf_dir), "source", "overall")


def valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as judge lines of every kind of fault, and which are valid."""
    k = F.col("k")
    value = F.when(k % 7 == 0, "true").when(k % 7 == 1, '"0.5"').when(k % 7 == 2, "1.5").when(k % 7 == 3, "null").otherwise(F.concat(F.lit("0."), k.cast("string")))
    task = F.when(k % 5 == 0, "12").otherwise('"t"')
    line = F.concat(F.when(k % 11 == 0, "[").otherwise(""), F.lit('{"task_id": '), task, F.lit(', "judge": {"task_correctness": '), value, F.lit(', "reference_similarity": 0.5, "code_quality": 1, "overall": 0.25}}'))
    v = F.try_parse_json(line)
    return keyed_events(spark, sf_dir).select("event_id", F.coalesce(S.valid_score_row(v), F.lit(False)).alias("valid"))


def only_setup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a folder for each kind of event and hundred of users; each folder names one setup."""
    folder = F.concat(F.col("event_type"), F.lit("/"), F.floor(F.col("user_id") / 100).cast("string"))
    return S.only_setup(table(spark, sf_dir, "events").select(folder.alias("folder"), F.col("event_type").alias("setup")), ["folder"])


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage text of a file per order: a line per line item."""
    count = F.when(F.col("l_returnflag") == "N", F.when(F.col("l_quantity") < 5, "#####").otherwise(F.col("l_quantity").cast("int").cast("string"))).when(F.col("l_returnflag") == "A", "-").otherwise(F.when(F.col("l_quantity") < 25, "=====").otherwise("x"))
    text = F.concat(F.lpad(count, 9, " "), F.lit(":"), F.lpad(F.col("l_linenumber").cast("string"), 5, " "), F.lit(":part "), F.col("l_partkey").cast("string"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.inline(F.array(C.parse_line(text))))


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two functions a file: lines 1-3 and 4-7."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), F.explode(F.array(F.struct(F.lit("head").alias("name"), F.lit(1).alias("start_line"), F.lit(3).alias("end_line")), F.struct(F.lit("tail").alias("name"), F.lit(4).alias("start_line"), F.lit(7).alias("end_line")))).alias("f"))
    return o.select("file", "f.*")


def _coverage(spark: SparkSession, sf_dir: str, none: float, lax: bool) -> DataFrame:
    d = C.summarise(C.in_ranges(_lines(spark, sf_dir), _functions(spark, sf_dir)), ["file", "name"], none, lax)
    return d.withColumn("missed", F.array_join("missed", ","))


def function_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir, 0.0, False)


def function_coverage_lax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir, 100.0, True)


def coverage_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    a = F.when(k % 4 == 1, "n/a").when(k % 4 > 1, k.cast("string"))
    b = F.when(k % 3 > 0, F.col("value").cast("string"))
    d = keyed_events(spark, sf_dir).withColumns({"master": C.first_number(a, b), "unit": C.first_present(a, b)})
    d = d.withColumns({"gate": C.integration_gate(F.col("master"), F.col("unit"), 70.0), "j": C.judged(F.col("unit"), k % 2 == 0, 70.0)})
    return d.select("event_id", "master", "unit", "gate", F.col("j.covered").alias("covered"), F.col("j.accepted").alias("accepted"), F.col("j.reason").alias("reason"))


def enclosing_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "lineitem").select(F.format_string("%d:%d", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line_no"))
    return C.enclosing(hits, _functions(spark, sf_dir))


def stage_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stage_ratio(keyed_events(spark, sf_dir).withColumn("ok", F.col("k") >= 40), "event_type", "ok")


def line_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("pos", "source")).select("file", (F.col("pos") + 1).alias("line_no"), "source")
    hits = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("file"), (F.col("doc_id") % 40 + 1).cast("int").alias("line_no"))
    return C.snippet(lines, hits)


QUERIES = {f.__name__: f for f in (score_summary, score_histogram, valid_rows, only_setup, function_coverage, function_coverage_lax, coverage_gates, enclosing_functions, stage_ratios, line_snippets)}

_SCORES = """sc as (select doc_id, source, quality::double as tc, (1 - toxic)::double as rs, least(1.0, n_chars / 5000.0)::double as cq from documents join labels using (doc_id)),
scores as (select *, round((0.45 * tc + 0.40 * rs + 0.15 * cq)::decimal(20,8), 6)::double as overall from sc)"""
_LINES = """lines as (select l_orderkey as file, l_linenumber as line_no, case l_returnflag when 'N' then case when l_quantity < 5 then '#####' else l_quantity::int::varchar end when 'A' then '-' else case when l_quantity < 25 then '=====' else 'x' end end as ct from lineitem),
fns as (select o_orderkey as file, unnest(['head', 'tail']) as name, unnest([1, 4]) as s, unnest([3, 7]) as e from orders),
ranged as (select l.file, name, line_no, case when ct = '-' then null when ct in ('#####', '=====') then 'missed' when ct = 'x' then OTHER else case when ct::int > 0 then 'covered' else 'missed' end end as st from lines l join fns f on l.file = f.file and line_no between s and e)"""


def _cov(none: str, other: str) -> str:
    return f"""with {_LINES.replace('OTHER', other)} select file, name, count(*) filter (st = 'covered') as covered, count(st) as executable,
  case when count(st) = 0 then {none} else round((100.0 * count(*) filter (st = 'covered') / count(st))::decimal(20,8), 2)::double end::double as coverage_pct,
  coalesce(string_agg(line_no::varchar, ',' order by line_no) filter (st = 'missed'), '') as missed from ranged group by 1, 2"""


_R = lambda x, n=4: f"round(({x})::decimal(20,8), {n})::double"
SQL = {
    "score_summary": f"with {_SCORES} select source, count(*) as n, {_R('avg(overall)')} as mean_overall, {_R('stddev_pop(overall)')} as std_overall, {_R('avg(tc)')} as mean_task_correctness, {_R('avg(rs)')} as mean_reference_similarity, {_R('avg(cq)')} as mean_code_quality from scores group by source",
    "score_histogram": f"with {_SCORES}, b as (select source, least(floor(overall::decimal(20,8) * 20), 19)::int as bin, count(*) as n from scores group by all) select source, bin, n, {_R('n / sum(n) over (partition by source)', 6)} as share from b",
    "valid_rows": f"with {K_EVENTS} select event_id, k % 11 <> 0 and k % 5 <> 0 and k % 7 > 3 as valid from k_events",
    "only_setup": "select event_type || '/' || (user_id // 100) as folder, any_value(event_type) as setup from events group by 1",
    "function_coverage": _cov("0.0", "'missed'"),
    "function_coverage_lax": _cov("100.0", "null"),
    "coverage_gates": f"""with {K_EVENTS}, x as (select event_id, k, case when k % 4 = 1 then 'n/a' when k % 4 > 1 then k::varchar end as a, case when k % 3 > 0 then value::varchar end as b from k_events),
      y as (select *, coalesce(try_cast(a as double), try_cast(b as double)) as master, try_cast(coalesce(a, b) as double) as unit from x)
      select event_id, master, unit, case when master is null then false when unit is null then master >= 70 else master >= greatest(70, unit - 5) end as gate, coalesce(unit >= 70, false) as covered, coalesce(unit >= 70, false) and k % 2 = 0 as accepted,
      case when unit is null then 'no coverage' when unit < 70 then 'below threshold' when k % 2 = 0 then 'accepted' else 'rejected by judge' end as reason from y""",
    "enclosing_functions": "select l_orderkey || ':' || l_linenumber as id, l_orderkey as file, l_linenumber as line_no, case when o_orderkey is not null and l_linenumber between 1 and 3 then 'head' when o_orderkey is not null and l_linenumber between 4 and 7 then 'tail' else 'Global Scope' end as scope from lineitem left join orders on o_orderkey = l_orderkey",
    "stage_ratios": f"with {K_EVENTS} select event_type, count(*) filter (k >= 40) as n_ok, count(*) as n, bool_and(k >= 40) as all_ok, {_R('count(*) filter (k >= 40) / count(*)')} as ratio from k_events group by 1",
    "line_snippets": "with l as (select doc_id, unnest(string_split(text, chr(10))) as source, generate_subscripts(string_split(text, chr(10)), 1) as n from documents) select doc_id as id, string_agg(source, chr(10) order by n) as snippet from l where n between doc_id % 40 + 1 - 10 and doc_id % 40 + 1 + 10 and trim(source, ' ') <> '' group by 1",
}
