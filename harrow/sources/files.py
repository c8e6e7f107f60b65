"""Readers of agent logs: JSONL, JSON files by folder, coverage text, makefiles, bytes of unknown encoding.

Logs are read line by line, split over tasks; a line's number is its place in its block of the file and the lines of the blocks before, so no row and no task holds a file.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from harrow.functions.structs import below, json_object, loose_json, resolved_path
from harrow.functions.text import has_text
from harrow.operators.coverage import parse_line
from harrow.sources.scratch import cut

#: Blocks of files up to which their line counts are broadcast (some 100 bytes each); beyond, lines are joined to them by block.
BLOCKS = 100_000
#: Where a folder has its packed artifacts; Spark's listing of files passes it over.
PACKS = "_packs"
#: The classes of a coherence check; fixed values.
CLASSIFICATIONS = ["coherent_c", "empty_output", "provider_failure", "stdout_transcript", "non_code"]


def packed(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame | None:
    """(path, inner, name, text, modified, length) of the artifacts that sinks.pack_artifacts put below a folder, None if none were; pattern as for files, of names, * and ?."""
    jvm = spark._jvm.org.apache.hadoop.fs
    at = jvm.Path(path.rstrip("/"), PACKS)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    d = spark.read.parquet(at.toString()).select(F.concat(F.lit(path.rstrip("/") + "/"), "place").alias("path"), F.col("place").alias("inner"), "name", "text", "modified", "length")
    if pattern is None:
        return d
    if re.search(r"[*?]", pattern) is None:
        return d.where(F.col("name") == pattern)
    return d.where(F.col("name").rlike("^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"))


def text_files(spark: SparkSession, path: str, pattern: str | None = None, depth: int | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """Whole files below a folder as (path, name, text, modified); pattern is a glob of names, depth a bound of folder levels, skip names folders to pass over."""
    r = spark.read.option("recursiveFileLookup", True)
    d = (r.option("pathGlobFilter", pattern) if pattern else r).text(path, wholetext=True)
    d = d.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified"))
    if (packs := packed(spark, path, pattern)) is not None:
        d = d.union(packs.select("path", "name", "text", "modified"))
    root = re.sub("^[a-z0-9]+:/+", "/", path.rstrip("/")) + "/"
    inner = F.split(F.substring_index(F.regexp_replace("path", "^[a-z0-9]+:/+", "/"), root, -1), "/")
    if depth is not None:
        d = d.where(F.size(inner) <= depth + 1)
    return d.where(~F.arrays_overlap(inner, F.array(*[F.lit(s) for s in skip]))) if skip else d


def lines(files: DataFrame) -> DataFrame:
    """(path, name, line_no from 1, line)."""
    return files.select("path", "name", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("path", "name", (F.col("pos") + 1).alias("line_no"), "line")


def before_block(rows: DataFrame, n: Column, alias: str) -> DataFrame:
    """(path, block, alias): the sum of n over the blocks of the file before this one."""
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy("path", "block").agg(n.alias("_n")).select("path", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(alias))


def numbered_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, name, block, line_no from 1, line) of the text files below a folder; block is where the part of the file begins that a task read.

    Files are read in splits. The lines are written once with their order in the split, since how a file is split may change from one query to the next; only counts of lines by block are gathered. Lines end by LF, CR or both; a file without lines gives no rows.
    """
    r = spark.read.option("recursiveFileLookup", True)
    d = (r.option("pathGlobFilter", pattern) if pattern else r).text(path)
    meta = F.col("_metadata")
    d = cut(d.select(meta["file_path"].alias("path"), meta["file_name"].alias("name"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line")))
    first = d.groupBy("path", "block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = cut(first.select("path", "block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift")))
    first = F.broadcast(first) if first.count() <= BLOCKS else first
    d = d.join(first, ["path", "block"]).select("path", "name", "block", (F.col("_at") + F.col("_shift")).alias("line_no"), "line")
    if (packs := packed(spark, path, pattern)) is None:
        return d
    # a packed artifact is small, a row, so its lines are numbered in it
    each = packs.where("text <> ''").select("path", "name", F.lit(0).cast("long").alias("block"), F.posexplode(F.split(F.regexp_replace("text", r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n")).alias("pos", "line"))
    return d.union(each.select("path", "name", "block", (F.col("pos") + 1).cast("long").alias("line_no"), "line"))


def jsonl(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> tuple[DataFrame, DataFrame]:
    """(objects, rejects): lines that are JSON objects as VARIANT, and the others that are not blank, with path, name, block and line_no."""
    d = numbered_lines(spark, path, pattern).where(has_text(F.col("line"))).withColumn("row", json_object(F.col("line")))
    return d.where("row is not null").drop("line"), d.where("row is null").drop("row")


def _get(name: str, kind: str = "string") -> Column:
    return F.try_variant_get("row", f"$.{name}", kind)


def _kind(name: str) -> Column:
    """The type of a key's value: null without the key, VOID for a JSON null."""
    return F.schema_of_variant(_get(name, "variant"))


def _keys(name: str) -> Column:
    return F.json_object_keys(F.to_json(_get(name, "variant")))


def judgments_latest(rows: DataFrame) -> DataFrame:
    """(task_id, setup, judge_fingerprint, line_no) of the last valid judgment of each pair: three texts, and a judge that is an object without a key error, whatever that key holds. An invalid line doesn't hide a valid one before it."""
    texts = [_kind(c) == "STRING" for c in ("task_id", "setup", "judge_fingerprint")]
    ok = texts[0] & texts[1] & texts[2] & F.startswith(_kind("judge"), F.lit("OBJECT")) & ~F.array_contains(_keys("judge"), "error")
    d = rows.where(ok).select(_get("task_id").alias("task_id"), _get("setup").alias("setup"), _get("judge_fingerprint").alias("judge_fingerprint"), "line_no")
    return d.groupBy("task_id", "setup").agg(F.max_by("judge_fingerprint", "line_no").alias("judge_fingerprint"), F.max("line_no").alias("line_no"))


def checks_latest(rows: DataFrame) -> DataFrame:
    """(task_id, setup, result_fingerprint, retry, classification, reasoning, round, line_no) of the last valid check of each pair.

    Valid are three texts and a check of exactly the keys retry (a boolean), classification (one that is known) and reasoning (a text), with retry false exactly for coherent_c. round is whatever the line says, null if it is no whole number.
    """
    names = ("task_id", "setup", "result_fingerprint")
    ok = F.lit(True)
    for c in names:
        ok &= _kind(c) == "STRING"
    known = F.coalesce(_get("check.classification").isin(CLASSIFICATIONS) & (_kind("check.classification") == "STRING"), F.lit(False))
    shape = F.startswith(_kind("check"), F.lit("OBJECT")) & (F.array_sort(_keys("check")) == F.array(*map(F.lit, ("classification", "reasoning", "retry"))))
    typed = (_kind("check.retry") == "BOOLEAN") & known & (_kind("check.reasoning") == "STRING")
    retry = _get("check.retry", "boolean")
    d = rows.where(ok & shape & typed & (retry != (_get("check.classification") == "coherent_c")))
    d = d.select(*[_get(c).alias(c) for c in names], retry.alias("retry"), _get("check.classification").alias("classification"), _get("check.reasoning").alias("reasoning"), _get("round", "int").alias("round"), "line_no")
    return d.groupBy("task_id", "setup").agg(F.max_by(F.struct(*d.columns[2:]), "line_no").alias("_c")).select("task_id", "setup", "_c.*")


def exact_rows(rows: DataFrame, schema: StructType, optional: tuple[str, ...] = ()) -> DataFrame:
    """S3: objects of exactly the schema's keys (optional ones may lack) as typed columns; others are left out."""
    keys = F.json_object_keys(F.to_json("row"))
    need = F.array(*[F.lit(f.name) for f in schema.fields if f.name not in optional])
    every = F.array(*[F.lit(f.name) for f in schema.fields])
    ok = (F.size(F.array_except(need, keys)) == 0) & (F.size(F.array_except(keys, every)) == 0)
    # a VARIANT path per column, so a value of another type is null
    return rows.where(ok).select("name", "line_no", *[F.try_variant_get("row", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in schema.fields])


def results_latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Falsy keys are passed over; the last valid line of a key counts."""
    d = rows
    for k in keys:
        d = d.where(F.coalesce(F.col(k).cast("string"), F.lit("")) != "")
    return d.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in d.columns]), "line_no").alias("_r")).select("_r.*")


def tasks(rows: DataFrame, rejects: DataFrame) -> DataFrame:
    """Strict tasks; a fault raises, with its line. A false id (missing, null, empty, 0, false, an empty list or object) becomes task_%05d by the row's place among the file's rows, counted block by block."""
    if (bad := rejects.select("name", "line_no").first()) is not None:
        raise ValueError(f"{bad['name']}:{bad['line_no']}: not a JSON object")
    required = _get("required", "array<string>")
    list_ok = _kind("required").isNull() | (_kind("required").isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(F.coalesce(required, F.array(F.lit(""))), lambda x: ~has_text(x)))
    answer_ok = _kind("answer").isNull() | _kind("answer").isin("STRING", "VOID")
    whole = F.to_json(_get("id", "variant"))
    no_id = _kind("id").isNull() | whole.isin('""', "null", "false", "[]", "{}") | F.coalesce(_get("id", "double") == 0, F.lit(False)) & (_kind("id") != "STRING")
    id_ok = no_id | (_kind("id") == "STRING") & has_text(_get("id"))
    fault = F.when(~F.coalesce((_kind("question") == "STRING") & has_text(_get("question")), F.lit(False)), "question").when(~list_ok, "required").when(~answer_ok, "answer").when(~id_ok, "id")
    d = rows.withColumn("fault", fault)
    if (bad := d.where("fault is not null").select("name", "line_no", "fault").first()) is not None:
        raise ValueError(f"{bad['name']}:{bad['line_no']}: bad {bad['fault']}")
    d = d.join(before_block(rows, F.count("*"), "_before"), ["path", "block"])
    place = F.col("_before") + F.row_number().over(Window.partitionBy("path", "block").orderBy("line_no")) - 1
    d = d.withColumn("_p", place)
    return d.select(F.when(no_id, F.format_string("task_%05d", "_p")).otherwise(_get("id")).alias("id"), _get("question").alias("question"), F.coalesce(required, F.array().cast("array<string>")).alias("required"), F.coalesce(_get("answer"), F.lit("")).alias("answer"), "name", "line_no")


def json_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """JSON files as (path, dir, name, row), row an empty object where the file can't be read."""
    d = text_files(spark, path, pattern)
    return d.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("dir"), "name", "modified", loose_json(F.col("text")).alias("row"))


def traces(spark: SparkSession, path: str) -> DataFrame:
    """Every <stem>.result.json with the <stem>.json beside it, if there is one."""
    r = json_files(spark, path, "*.result.json").select("dir", F.regexp_replace("name", r"\.result\.json$", "").alias("stem"), F.col("row").alias("result"))
    m = text_files(spark, path, "*.json").where(~F.endswith("name", F.lit(".result.json"))).select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.regexp_replace("name", r"\.json$", "").alias("stem"), F.col("text").alias("main"))
    return r.join(m, ["dir", "stem"], "left")


def unscored(metadata: DataFrame, scores: DataFrame) -> DataFrame:
    """Metadata without a score in the same folder."""
    return metadata.join(scores.select("dir"), "dir", "left_anti")


def rounds(files: DataFrame) -> DataFrame:
    """Results.jsonl is round 0, results_N.jsonl is N."""
    n = F.regexp_extract("name", r"^results(?:_([0-9]+))?\.jsonl$", 1)
    return files.where(F.col("name").rlike(r"^results(_[0-9]+)?\.jsonl$")).select("path", F.when(n == "", 0).otherwise(n.try_cast("int")).alias("round")).distinct()


def coverage_files(lines: DataFrame, test_dir: str, source_root: str | None = None) -> DataFrame:
    """(path, name, source): coverage files and what they are of, by the first line that names a Source, resolved from the test folder. Those of sources in the test folder, or outside the source root, are left out."""
    head = lines.where(F.contains("line", F.lit("Source:"))).groupBy("path", "name").agg(F.min_by("line", "line_no").alias("line"))
    d = head.select("path", "name", resolved_path(F.trim(F.regexp_extract("line", "Source:(.*)$", 1)), test_dir).alias("source"))
    root = lambda x: resolved_path(F.lit(x))
    d = d.where(~below(F.col("source"), root(test_dir)))
    return d if source_root is None else d.where(below(F.col("source"), root(source_root)))


def coverage_lines(spark: SparkSession, path: str, wanted: DataFrame | str, test_dir: str, source_root: str | None = None) -> DataFrame:
    """(wanted, name, count_text, line_no, source): the lines of the first coverage file, by name, of each wanted source (a table of `source`, or one). Only files right in the folder count. A source without a file has no lines."""
    if isinstance(wanted, str):
        wanted = spark.createDataFrame([(wanted,)], "source string")
    lines = cut(numbered_lines(spark, path, "*.gcov").where(F.regexp_extract("path", "([^/]*)/[^/]*$", 1) == path.rstrip("/").rsplit("/", 1)[-1]))
    asked = wanted.select(F.col("source").alias("wanted"), resolved_path(F.col("source")).alias("source")).distinct()
    first = coverage_files(lines, test_dir, source_root).join(asked, "source").groupBy("wanted").agg(F.min_by(F.struct("path", "name"), "name").alias("f")).select("wanted", "f.path", "f.name")
    parsed = lines.drop("name").join(first, "path").select("wanted", "name", F.inline(F.array(parse_line(F.col("line")))))
    return parsed.where("line_no > 0")


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompt files with their time of change."""
    return text_files(spark, path, "*.prompt.txt").select("path", F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.regexp_replace("name", r"\.prompt\.txt$", "").alias("stem"), "modified")


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV with NA taken literally; an empty field is an empty text."""
    return spark.read.option("header", True).option("nullValue", "\u0000").option("emptyValue", "").option("multiLine", True).csv(path).na.fill("")


def trace_interactions(messages: DataFrame) -> DataFrame:
    """(id, pos, status, model, usage as VARIANT) of the raw HTTP interactions in a message's VARIANT `row`."""
    trace = F.try_variant_get("row", "$.metadata.rawHttpTrace", "variant")
    d = messages.select("id", F.try_variant_get(trace, "$.modelId", "string").alias("model"), F.posexplode_outer(F.try_variant_get(trace, "$.interactions", "array<variant>")).alias("pos", "i"))
    body = F.try_variant_get("i", "$.response.body", "variant")
    as_text = F.try_parse_json(F.try_variant_get("i", "$.response.body", "string"))
    return d.where("i is not null").select("id", "model", "pos", F.try_variant_get("i", "$.response.status", "int").alias("status"), F.to_json(F.coalesce(F.try_variant_get(body, "$.usage", "variant"), F.try_variant_get(as_text, "$.usage", "variant"))).alias("usage"))


def binary(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Files as bytes with their SHA-256."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (r.option("pathGlobFilter", pattern) if pattern else r).load(path).select("path", "content", "length", F.sha2("content", 256).alias("sha256"))
