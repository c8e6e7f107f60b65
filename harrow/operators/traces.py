"""Traced functions, events and configuration rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions.structs import json_text
from harrow.functions.text import ellipsis

#: States and events that end a session. Fixed values.
TERMINAL_STATES = ["completed", "failed", "cancelled", "canceled", "aborted"]
TERMINAL_EVENTS = ["ended", "session-ended", "run-completed", "completed", "run-failed"]


def function_totals(paths: DataFrame, key: str) -> DataFrame:
    """A function's token totals and the tokens of each of its paths, in path order."""
    each = F.array_sort(F.collect_list(F.struct("path_index", "input_tokens", "output_tokens")))
    return paths.groupBy(key).agg(F.sum("input_tokens").alias("total_input"), F.sum("output_tokens").alias("total_output"), (F.sum("input_tokens") + F.sum("output_tokens")).alias("total"), each.alias("each_path"))


def running_totals(paths: DataFrame, key: str) -> DataFrame:
    """A12, as it is kept between paths."""
    w = Window.partitionBy(key).orderBy("path_index").rowsBetween(Window.unboundedPreceding, 0)
    return paths.withColumn("total_so_far", F.sum(F.col("input_tokens") + F.col("output_tokens")).over(w))


def with_retries(attempts: DataFrame, key: str) -> DataFrame:
    """Tokens of all attempts, and where the numbers come from: the provider if each attempt has them, else an estimate."""
    known = F.bool_and(F.col("provider_tokens").isNotNull())
    tokens = F.sum(F.coalesce("provider_tokens", "estimated_tokens"))
    return attempts.groupBy(key).agg(tokens.alias("tokens"), F.when(known, "provider_usage").when(F.bool_or(F.col("provider_tokens").isNotNull()), "mixed").otherwise("approximate").alias("token_source"), F.count("*").alias("attempts"))


def candidates(groups: DataFrame) -> DataFrame:
    """The distinct names of a map of groups."""
    return groups.select(F.explode(F.flatten(F.map_values("stub_candidates"))).alias("name")).distinct()


def without_overrides(links: DataFrame, overrides: DataFrame) -> DataFrame:
    """J14."""
    return links.join(overrides.select("symbol"), "symbol", "left_anti")


def called_of_interest(interest: DataFrame, calls: DataFrame) -> DataFrame:
    """Functions that some file calls."""
    return interest.join(calls.select(F.col("callee").alias("name")), "name", "left_semi")


def paired(paths: DataFrame, dependents: DataFrame) -> DataFrame:
    """A path and the dependent path of the same index; the index is data, not the order of arrival."""
    return paths.join(dependents, ["job", "path_index"])


def main_files(files: DataFrame) -> tuple[Column, DataFrame]:
    """Which rows stay (no main, or a listed one), and the last listed file with main."""
    stays = ~F.col("has_main") | F.col("listed")
    return stays, files.where("has_main and listed").agg(F.max_by("path", "pos").alias("main_file"))


def terminal(status: Column) -> Column:
    """P22."""
    return F.coalesce(status.isin(TERMINAL_STATES), F.lit(False))


def terminal_event(session: Column, wanted: Column, kind: Column, status: Column) -> Column:
    """An event whose type or status ends its session, unless it names another session; an empty name is none."""
    return F.coalesce(F.nullif(session.cast("string"), F.lit("")) == wanted.cast("string"), F.lit(True)) & (F.coalesce(kind.isin(TERMINAL_EVENTS), F.lit(False)) | terminal(status))


def function_name(x: Column) -> Column:
    """P24."""
    return F.coalesce((x != "") & ~x.rlike(r"[()]"), F.lit(False))


def test_dir(source: Column) -> Column:
    """.../src/<name> has its tests at .../tests/<name>; another parent is an error."""
    return F.when(source.rlike(r"/src/[^/]+/?$"), F.regexp_replace(source, r"/src/([^/]+)/?$", "/tests/$1")).otherwise(F.raise_error(F.concat(F.lit("not below src: "), source)))


def contract(makefile: Column, program: Column, source: Column, absent: str = "$(notdir $(PROD_SRC)).gcov", present: str = "gcov -p -b -c") -> Column:
    """Both variables have these values on lines of their own, one text is absent and one present."""
    line = lambda name, v: F.regexp_like(makefile, F.concat(F.lit(rf"(?m)^{name}\s*=\s*\Q"), v, F.lit(r"\E\s*$")))
    return line("TEST_PROGRAM", program) & line("TEST_SRCS", source) & ~F.contains(makefile, F.lit(absent)) & F.contains(makefile, F.lit(present))


def input_summary(v: Column) -> Column:
    """key=value of the first of these keys that a tool's VARIANT input has, the value as JSON; else the input's start."""

    def part(key: str, kind: str) -> Column:
        x = F.try_variant_get(v, f"$.{key}", "variant")
        text = json_text(ellipsis(F.try_variant_get(v, f"$.{key}", "string"), 500)) if kind == "STRING" else F.to_json(x)
        return F.when(F.startswith(F.schema_of_variant(x), F.lit(kind)), F.concat(F.lit(f"{key}="), text))

    keys = [("query", "STRING"), ("question", "STRING"), ("questions", "ARRAY"), ("command", "STRING"), ("path", "STRING"), ("paths", "ARRAY"), ("file", "STRING"), ("url", "STRING")]
    return F.coalesce(*[part(k, t) for k, t in keys], ellipsis(F.to_json(v), 500))


def output_length(text: Column, v: Column) -> Column:
    """F31."""
    return F.length(F.coalesce(text, F.to_json(v)))


def backoff(attempt: Column) -> Column:
    """Seconds before attempt n + 1: min(60, 2 ** min(n - 1, 6))."""
    return F.least(F.lit(60.0), F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(6)))).cast("int")
