"""Queries of the text and structure expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions import structs as X
from harrow.functions import text as T
from harrow.plans.inputs import K_EVENTS, keyed_events, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def code_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F2, F13, T10 on documents put in fences."""
    i = F.col("doc_id") % 4
    x = F.when(i == 0, F.concat(F.lit("Here:\n```C\n"), "text", F.lit("\n```\nbye"))).when(i == 1, F.concat(F.lit("```\n"), "text", F.lit("\n```"))).when(i == 2, F.concat(F.lit("  "), "text", F.lit("\n "))).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(F.encode(T.fenced_code(x), "UTF-8")).alias("code_md5"), T.approx_tokens(x).alias("tokens"), F.md5(F.encode(T.strip_fences(x), "UTF-8")).alias("bare_md5"), F.md5(F.encode(T.tail(x, 300), "UTF-8")).alias("tail_md5"))


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3, F4 on transcripts made of events."""
    k = F.col("k")
    call = F.concat(F.lit("● "), "event_type", F.lit("_info (MCP: srv"), (k % 3).cast("string"), F.lit(")"), F.when(k % 2 == 0, F.concat(F.lit(' · name: "fn_'), k.cast("string"), F.lit('"'))).otherwise(""))
    x = F.concat(call, F.lit("\nnoise\n"), call, F.when(k % 5 > 0, F.concat(F.lit("\nTokens     ↑ "), k.cast("string"), F.when(k % 2 == 0, ".5k").otherwise(""), F.lit(" • ↓ "), (k * 3).cast("string"))).otherwise(""))
    t = T.token_line(x)
    return keyed_events(spark, sf_dir).select("event_id", F.array_join(T.tool_calls(x), "|").alias("calls"), t["input"].alias("input_tokens"), t["output"].alias("output_tokens"))


def names_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7-F11, F40, F52."""
    head = F.concat(F.lit("_"), "source", F.lit(" <é-"), F.md5(F.encode("text", "UTF-8")), F.lit(">"))
    name = F.concat(F.lit("src/"), "lang", F.lit("/_"), head, F.lit(".v1.c"))
    j = X.job_key(F.col("source"), head, F.col("doc_id").cast("int"), F.col("lang"), F.col("source"))
    return _docs(spark, sf_dir).select("doc_id", T.safe_filename(name).alias("safe"), T.safe_filename(name, False).alias("safe_untrimmed"), T.safe_identifier(F.concat((F.col("doc_id") % 7).cast("string"), head)).alias("identifier"), T.safe_identifier(F.lit("--")).alias("generated"), T.artifact_key(F.col("source"), head).alias("artifact"), T.safe_name(F.when(F.col("doc_id") % 5 > 0, F.concat(head, F.lit("=1")))).alias("named"), T.doc_key(name).alias("doc_key"), X.short_hash(F.col("source"), 12).alias("h12"), X.short_hash(F.col("source"), 8, "md5").alias("m8"), j["job"].alias("job"), j["folder"].alias("folder"), j["run"].alias("run"))


def code_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5, F6, F14, F16-F18, F21-F23, F33, F54, P17-P20, P33 on small C texts made of events."""
    k = F.col("k").cast("string")
    x = F.concat(F.lit("#define MAX_"), k, F.lit(" 1 /* c */\n  # define MIN"), k, F.lit("(x) \\\n (x)\nint (*fp_"), k, F.lit(')(int); // CU_add_test(\nchar *s = "CU_add_test (";\nint __wrap_f'), k, F.lit("(int a) { return __wrap_g(a); }\n"), F.when(F.col("k") % 3 == 0, F.lit("CU_add_test (s, \"n\", t);\n// BEGIN\nx = __real_f0;\n// END\n")).otherwise(""))
    n = F.col("k") % 6
    out = F.when(n == 0, "all good").when(n == 1, "a.c:1: Error: bad").when(n == 2, "Undefined reference to '__wrap_x'").when(n == 3, "make: *** No rule to make target x").when(n == 4, "heap out of memory").otherwise("duplicate symbol y")
    f = F.concat(F.lit("f"), k)
    return keyed_events(spark, sf_dir).select(
        "event_id", F.array_join(T.macro_names(x), ",").alias("macros"), F.array_join(T.function_pointers(x), ",").alias("pointers"), F.md5(T.strip_comments_and_strings(x)).alias("stripped"), F.md5(T.strip_comments(x)).alias("uncommented"),
        F.array_join(T.wrapped_names(x), ",").alias("wrapped"), F.array_join(T.defined_wrappers(x), ",").alias("defined"), T.marker_section(x, "// BEGIN", "// END").alias("section"), F.md5(T.joined_macro(x)).alias("joined"), T.bare_include(F.concat(F.lit("<"), f, F.lit('.h">'))).alias("include"),
        T.word_hits(x, F.concat(F.lit("__WRAP_F"), k)).alias("hit"), T.build_ok(F.col("k") % 2, out).alias("built"), T.failure_hint(out).alias("hint"), T.stub_body_ok(x, f).alias("stub_ok"), T.registers_test(x).alias("registers"), x.rlike(r"__wrap_f1\b").alias("stub_there"),
        F.md5(T.insert_once(x, "__wrap_f7", "// BEGIN", "new")).alias("inserted"),
    )


def label_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F24-F29, F32, F35-F37, F42, F47."""
    k = F.col("k").cast("string")
    label = F.concat(F.lit("[main.c:"), k, F.lit("]"), F.when(F.col("k") % 2 == 0, F.lit("[1:4]")).otherwise(""), F.lit(" fn_"), "event_type")
    ans = F.concat(F.lit("a:"), k, F.when(F.col("k") % 3 == 0, ",b: unresolved").otherwise(",7"))
    p = T.label_parts(label)
    num = F.when(F.col("k") % 5 == 0, -1.0).when(F.col("k") % 5 == 1, F.lit(float("nan"))).when(F.col("k") % 5 > 2, F.col("k") + 0.5)
    return keyed_events(spark, sf_dir).select(
        "event_id", p["first"].alias("first"), p["second"].alias("second"), p["name"].alias("name"), T.bare_label(label).alias("bare"), F.array_join(T.answer_values(ans), "|").alias("answers"), F.array_join(T.answer_numbers(ans), "|").alias("strict"), T.n_unresolved(ans).alias("unresolved"),
        F.array_join(F.split(ans, ","), "->").alias("path"), T.ellipsis(label, 12).alias("short"), T.chunk_text(F.col("k"), F.lit(None).cast("string"), F.when(F.col("k") % 2 == 0, ""), label).alias("chunk"), T.csv_value(num).alias("csv"), X.answer_key(ans, F.when(F.col("k") % 2 == 0, k)).alias("answer_key"), k.try_cast("int").alias("weight"),
    )


def line_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F35, F56, U7."""
    lines = F.split("text", "\n")
    return _docs(spark, sf_dir).select("doc_id", F.md5(F.encode(T.line_slice(F.col("text"), F.lit(2), (F.col("doc_id") % 6).cast("int")), "UTF-8")).alias("slice_md5"), F.size(F.array_distinct(lines)).alias("n_distinct"), F.md5(F.encode(X.source_list(F.filter(lines, lambda s: F.length(s) < 30), "(none)"), "UTF-8")).alias("list_md5"))


def json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1, S12, F55, P11."""
    k = F.col("k")
    x = F.when(k % 6 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k % 6 == 1, F.concat(F.lit("so: "), "props", F.lit(" done"))).when(k % 6 == 2, F.lit("none")).when(k % 6 == 3, F.lit("[1, 2]")).when(k % 6 == 4, F.concat(F.lit("```json\n{\"k\": 1, \"z\": 2}```"))).otherwise(F.col("props"))
    v = X.loose_json(x)
    b = X.json_block(x, ["k"])
    judge = X.verdict(F.try_parse_json(F.concat(F.lit('{"score": '), F.when(k % 4 == 0, "null").when(k % 4 == 1, "140.7").otherwise(k.cast("string")), F.lit("}"))), 75)
    return keyed_events(spark, sf_dir).select("event_id", F.try_variant_get(v, "$.k", "int").alias("loose_k"), X.json_object(x).isNotNull().alias("is_object"), b["ok"].alias("block_ok"), b["why"].alias("block_why"), judge["score"].alias("score"), judge["passed"].alias("judge_passed"))


def map_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F34, F44, F48-F51, F53, P21, P31, U10."""
    k = F.col("k").cast("string")
    env = X.env_map(F.array(F.lit("http_x=old"), F.concat(F.lit("no_proxy=/bin:"), k), F.concat(F.lit("http_x="), k, F.lit("=1")), F.lit("NOT_http_=1"), F.lit("EMPTY")))
    have = F.create_map(F.lit("no_proxy"), F.lit("/usr"), F.lit("HOME"), F.lit("/root"))
    fwd = X.forwarded(env, have)
    path = F.concat(F.when(F.col("k") % 5 == 0, F.lit("/a/../")).when(F.col("k") % 5 == 1, F.lit("//./")).otherwise(F.lit("x\\")), k, F.lit("/y"))
    spec = F.when(F.col("k") % 3 == 0, F.concat(F.lit("/s:/t"), k, F.lit(":ro"))).when(F.col("k") % 3 == 1, F.lit("only")).otherwise(F.concat(F.lit("/s:/t"), k))
    m = X.mount(F.concat(F.lit("type="), F.when(F.col("k") % 4 == 0, "tmpfs").otherwise("bind"), F.lit(",src=/a"), k, F.lit(",dst=/b")))
    red = T.redacted(F.create_map(F.lit("Authorization"), k, F.lit("accept"), k))
    return keyed_events(spark, sf_dir).select(
        "event_id", F.array_join(F.transform(F.array_sort(F.map_entries(fwd)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("env"), X.relative_path(path).alias("path"), X.finish_status(F.when(F.col("k") % 2 == 0, "idle-timeout").otherwise(F.col("event_type"))).alias("finish"), X.event_status(F.when(F.col("k") % 3 == 0, "run-failed").otherwise("ended"), F.when(F.col("k") % 4 == 0, "").when(F.col("k") % 4 == 1, F.col("event_type"))).alias("status"), X.bind(spec)["target"].alias("bind_target"), m["source"].alias("mount_source"),
        F.array_join(X.positional(F.split(spec, ":"), ["a", "b", "c"]), "|").alias("positional"), red["Authorization"].alias("auth"), red["accept"].alias("accept"), T.leaked_prefix(path, F.array(F.lit("/a"), F.lit(""), F.lit("x"), F.lit("./1"))).isNotNull().alias("forbidden"),
    )


def verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15, P16, U1, U2, A17."""
    k = F.col("k")
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs])
    required = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(arr("a", "b", "c"))
    called = F.when(k % 3 == 0, arr("a", "b")).otherwise(arr("a", "b", "c"))
    shadow = F.array_union(F.when(k % 7 == 0, arr("c")).otherwise(F.array().cast("array<string>")), F.when(k % 11 == 0, arr("a", "c")).otherwise(F.array().cast("array<string>")))
    s = X.set_filters(required, called, shadow)
    ext, cor = F.when(k % 2 == 0, k % 4), F.when(k % 2 == 0, F.lit(2))
    d = keyed_events(spark, sf_dir).select("event_id", "k", required.alias("required"), s.alias("s"), ext.alias("ext"), cor.alias("cor"))
    return d.select("event_id", F.array_join("s.missing", ",").alias("missing"), F.array_join("s.present", ",").alias("present"), F.array_join("s.shadowed_required", ",").alias("shadowed"), X.hard_pass(F.col("k") > 20, F.col("s.missing"), F.col("required"), F.col("ext"), F.col("cor")).alias("hard_pass"), F.size("s.present").alias("n_passed"), F.size("required").alias("n_required"))


QUERIES = {f.__name__: f for f in (code_extraction, transcript_lines, names_and_keys, code_text, label_answers, line_slices, json_text, map_merges, verification)}

_STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
SQL = {
    "code_extraction": rf"""with d as (select doc_id, case doc_id % 4 when 0 then 'Here:' || chr(10) || '```C' || chr(10) || text || chr(10) || '```' || chr(10) || 'bye' when 1 then '```' || chr(10) || text || chr(10) || '```' when 2 then '  ' || text || chr(10) || ' ' else text end as x from documents)
      select doc_id, md5({_STRIP(r"case when regexp_matches(x, '(?is)```(?:c)?\s*(.*?)```') then regexp_extract(x, '(?is)```(?:c)?\s*(.*?)```', 1) else x end")}) as code_md5, greatest(1, length(x) // 4)::bigint as tokens,
      md5(regexp_replace(regexp_replace(x, '^\s*```[A-Za-z]*\s*', ''), '\s*```\s*$', '')) as bare_md5, md5(case when length(x) > 300 then right(x, 300) else x end) as tail_md5 from d""",
    "transcript_lines": f"""with {K_EVENTS} select event_id, (select string_agg(c, '|') from (select unnest([1, 2]), 'srv' || (k % 3) || '.' || event_type || '_info' || case when k % 2 = 0 then '(name=fn_' || k || ')' else '' end as c)) as calls,
      case when k % 5 > 0 then case when k % 2 = 0 then k * 1000 + 500 else k end end::bigint as input_tokens, case when k % 5 > 0 then k * 3 end::bigint as output_tokens from k_events""",
    "names_and_keys": r"""with d as (select *, ('_' || source || ' <é-' || md5(text) || '>') as head, 'src/' || lang || '/_' || ('_' || source || ' <é-' || md5(text) || '>') || '.v1.c' as name from documents),
      e as (select *, trim(regexp_replace((doc_id % 7) || head, '[^A-Za-z0-9_]+', '_', 'g'), '_') as ident, trim(regexp_replace(case when doc_id % 5 > 0 then head || '=1' else '' end, '[^A-Za-z0-9_.=\-]+', '_', 'g'), '_')[1:120] as nm, coalesce(nullif(trim(regexp_replace(head, '[^A-Za-z0-9_.=\-]+', '_', 'g'), '_')[1:120], ''), 'unknown') as fn,
        sha256('"' || lang || '"') as hp, sha256('"' || source || '"') as hc from d)
      select doc_id, trim(regexp_replace(name, '[^A-Za-z0-9_.\-]+', '_', 'g'), '_') as safe, regexp_replace(name, '[^A-Za-z0-9_.\-]+', '_', 'g') as safe_untrimmed,
      case when ident = '' then 'generated' when regexp_matches(ident, '^[0-9]') then 'f_' || ident else ident end as identifier, 'generated' as generated, trim(regexp_replace(source || '__' || head, '[^A-Za-z0-9_.\-]+', '_', 'g'), '_') as artifact,
      coalesce(nullif(nm, ''), 'unknown') as named, trim(regexp_replace(lower(regexp_replace(regexp_extract(name, '([^/]*)$', 1), '\.[^.]*$', '')), '[^a-z0-9]+', '_', 'g'), '_') as doc_key, left(sha256(source), 12) as h12, left(md5(source), 8) as m8,
      printf('%s::%s::path_%04d::p_%s::c_%s', source, head, doc_id, left(hp, 8), left(hc, 8)) as job, printf('path_%04d__%s__fp_%s', doc_id, fn, left(hp, 16)) as folder, printf('%s__path_%04d__p_%s__c_%s', fn, doc_id, left(hp, 8), left(hc, 8)) as run from e""",
    "code_text": rf"""with {K_EVENTS}, c as (select *, '#define MAX_' || k || ' 1 /* c */' || chr(10) || '  # define MIN' || k || '(x) \' || chr(10) || ' (x)' || chr(10) || 'int (*fp_' || k || ')(int); // CU_add_test(' || chr(10) || 'char *s = "CU_add_test (";' || chr(10) || 'int __wrap_f' || k || '(int a) {{ return __wrap_g(a); }}' || chr(10)
        || case when k % 3 = 0 then 'CU_add_test (s, "n", t);' || chr(10) || '// BEGIN' || chr(10) || 'x = __real_f0;' || chr(10) || '// END' || chr(10) else '' end as x from k_events),
      s as (select *, regexp_replace(regexp_replace(regexp_replace(x, '(?s)/\*.*?\*/', '', 'g'), '//[^\n]*', '', 'g'), '"(?:[^"\\]|\\.)*"', '""', 'g') as st, case when contains(x, '// BEGIN') then x else x || chr(10) || '// BEGIN' || chr(10) end as b from c)
      select event_id, 'MAX_' || k || ',MIN' || k as macros, 'fp_' || k as pointers, md5(st) as stripped, md5(regexp_replace(x, '(?s)/\*.*?\*/|//[^\n]*', '', 'g')) as uncommented, 'f' || k || ',g' as wrapped, 'f' || k as defined,
      case when k % 3 = 0 then 'x = __real_f0;' else '' end as section, md5({_STRIP("replace(x, '\\' || chr(10), ' ')")}) as joined, 'f' || k || '.h' as include, true as hit, k % 2 = 0 and k % 6 in (0, 4) as built,
      case k % 6 when 0 then null when 1 then null when 2 then 'wrap_symbol' when 3 then 'stale_contract' when 4 then 'runtime' else 'symbol_owner' end as hint, not (k % 3 = 0 and contains(x, '__real_f' || k)) as stub_ok, k % 3 = 0 as registers, k = 1 as stub_there,
      md5(case when contains(x, '__wrap_f7') then x else substr(b, 1, strpos(b, '// BEGIN') + 7) || chr(10) || 'new' || substr(b, strpos(b, '// BEGIN') + 8) end) as inserted from s""",
    "label_answers": rf"""with {K_EVENTS}, l as (select *, '[main.c:' || k || ']' || case when k % 2 = 0 then '[1:4]' else '' end || ' fn_' || event_type as label, 'a:' || k || case when k % 3 = 0 then ',b: unresolved' else ',7' end as ans from k_events)
      select event_id, 'main.c:' || k as first, case when k % 2 = 0 then '1:4' end as second, 'fn_' || event_type as name, ' fn_' || event_type as bare, k || case when k % 3 = 0 then '| unresolved' else '|UNRESOLVED' end as answers, k || '|UNRESOLVED' as strict, case when k % 3 = 0 then 1 else 0 end::bigint as unresolved,
      replace(ans, ',', '->') as path, case when length(label) > 12 then left(label, 12) || '...' else label end as short, '[' || k || '] ' || label as chunk, case when k % 5 > 2 then (k + 0.5)::varchar else 'NA' end as csv,
      '{{"call_number":' || case when k % 2 = 0 then '"' || k || '"' else 'null' end || ',"output":"' || ans || '"}}' as answer_key, k as weight from l""",
    "line_slices": """with d as (select doc_id, string_split(text, chr(10)) as l from documents)
      select doc_id, md5(array_to_string(l[2:(doc_id % 6)::int], chr(10))) as slice_md5, len(list_distinct(l))::int as n_distinct,
      md5(case when len(list_filter(l, lambda s: length(s) < 30)) > 0 then array_to_string(list_transform(list_filter(l, lambda s: length(s) < 30), lambda s: ' - ' || s), chr(10)) else '(none)' end) as list_md5 from d""",
    "json_text": f"""with {K_EVENTS} select event_id, case k % 6 when 2 then null when 3 then null when 4 then 1 else k end::int as loose_k, k % 6 = 5 as is_object, k % 6 = 0 as block_ok, case k % 6 when 0 then null when 4 then 'keys' else 'no block' end as block_why,
      case k % 4 when 0 then null when 1 then 100 else k end::int as score, case k % 4 when 0 then null when 1 then true else k >= 75 end as judge_passed from k_events""",
    "map_merges": rf"""with {K_EVENTS} select event_id, 'HOME=/root;http_x=' || k || '=1;no_proxy=/usr' as env, case k % 5 when 0 then null when 1 then k || '/y' else 'x/' || k || '/y' end as path, case when k % 2 = 0 then 'idle-timeout' else 'completed' end as finish, case when k % 4 = 1 then event_type when k % 3 = 0 then 'failed' else 'completed' end as status,
      case k % 3 when 1 then null else '/t' || k end as bind_target, case when k % 4 <> 0 then '/a' || k end as mount_source, case k % 3 when 0 then '/s|/t' || k || '|ro' when 1 then 'only|b|c' else '/s|/t' || k || '|c' end as positional, '[REDACTED]' as auth, k::varchar as accept, k % 5 <> 1 or starts_with(k::varchar, '1') as forbidden from k_events""",
    "verification": f"""with {K_EVENTS}, r as (select *, case when k % 5 = 0 then [] else ['a', 'b', 'c'] end::varchar[] as req, case when k % 3 = 0 then ['a', 'b'] else ['a', 'b', 'c'] end as called, list_distinct(list_concat(case when k % 7 = 0 then ['c'] else [] end, case when k % 11 = 0 then ['a', 'c'] else [] end))::varchar[] as sh from k_events),
      f as (select *, list_filter(req, lambda x: not list_contains(called, x) or list_contains(sh, x)) as missing, list_filter(req, lambda x: list_contains(called, x) and not list_contains(sh, x)) as present, list_filter(req, lambda x: list_contains(sh, x)) as shadowed from r)
      select event_id, array_to_string(missing, ',') as missing, array_to_string(present, ',') as present, array_to_string(shadowed, ',') as shadowed, k > 20 and len(missing) = 0 and not (len(req) > 0 and k % 2 = 0 and (k % 4 = 0 or k % 4 <> 2)) as hard_pass, len(present)::int as n_passed, len(req)::int as n_required from f""",
}
