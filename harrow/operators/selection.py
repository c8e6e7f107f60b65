"""Selecting, ordering and projecting episodes and attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def leaf_first(functions: DataFrame, pos: str = "pos") -> DataFrame:
    """Rank by depth downwards, then position; a bad depth is 0 and duplicates stay. The rank is for ordering by; no task gathers the table."""
    return functions.withColumn("depth_no", F.coalesce(F.col("depth").try_cast("int"), F.lit(0))).orderBy(F.desc("depth_no"), pos)


def targets(functions: DataFrame, only_level: int | None = None, only_function: str | None = None, limit: int | None = None) -> DataFrame:
    """P10: leaf-first targets after the filters; an ordered limit is a top-k per task, then a merge."""
    d = functions
    if only_function is not None:
        d = d.where(F.col("id") == only_function)
    if only_level is not None:
        d = d.where(F.col("depth").try_cast("int") == only_level)
    d = leaf_first(d)
    return d.limit(limit) if limit is not None else d


def best_unit(episodes: DataFrame, key: str) -> DataFrame:
    """Per item the most by (passed, coverage else -1, semantic else -1, episode); it need not have passed."""
    rank = F.struct("passed", F.coalesce("coverage_pct", F.lit(-1.0)).alias("c"), F.coalesce("semantic_score", F.lit(-1.0)).alias("s"), "episode_id")
    return episodes.groupBy(key).agg(F.max_by(F.struct("episode_id", "passed", "coverage_pct", "semantic_score"), rank).alias("b")).select(key, "b.*")


def first_valid(episodes: DataFrame, key: str) -> DataFrame:
    """The first validated episode by name."""
    return episodes.where("validated").groupBy(key).agg(F.min("episode_id").alias("episode_id"))


def promoted(episodes: DataFrame, key: str) -> DataFrame:
    """T4: the lowest episode that is ok, for every stage alike, so that the result does not hang on who ended first."""
    return episodes.where("ok").groupBy(key).agg(F.min("episode_id").alias("episode_id"))


def best_so_far(attempts: DataFrame, key: str, threshold: float) -> DataFrame:
    """Whether an attempt becomes the backup: covered, and a score (0 if there is none) at least the best before; a best of 0 counts as -1."""
    w = Window.partitionBy(key).orderBy("attempt_no").rowsBetween(Window.unboundedPreceding, -1)
    ok = F.col("coverage_pct") >= threshold
    score = F.coalesce("semantic_score", F.lit(0.0))
    before = F.coalesce(F.nullif(F.max(F.when(ok, score)).over(w), F.lit(0.0)), F.lit(-1.0))
    return attempts.withColumn("stored", F.coalesce(ok & (score >= before), F.lit(False)))


def oldest_prompt(prompts: DataFrame, key: str) -> DataFrame:
    """The oldest gen prompt, else the oldest."""
    return prompts.groupBy(key).agg(F.min_by("path", F.struct((F.col("kind") != "gen").alias("other"), "mtime", "path")).alias("path"))


def top_k(rows: DataFrame, key: str, order: Column, k: int) -> DataFrame:
    """T9."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("rank") <= k)


def depth_batches(functions: DataFrame) -> DataFrame:
    """Functions of each depth, root first."""
    return functions.groupBy(F.coalesce(F.col("depth").try_cast("int"), F.lit(0)).alias("batch")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def key_or_id(left: DataFrame, results: DataFrame) -> DataFrame:
    """A unit result by function_key, else by func_id."""
    by_key = results.where("function_key is not null").groupBy("function_key").agg(F.max("coverage").alias("by_key"))
    by_id = results.where("func_id is not null").groupBy("func_id").agg(F.max("coverage").alias("by_id"))
    return left.join(by_key, "function_key", "left").join(by_id, "func_id", "left").withColumn("coverage", F.coalesce("by_key", "by_id")).drop("by_key", "by_id")


def first_seen_index(rows: DataFrame, group: list[str], identity: list[str], order: str) -> DataFrame:
    """A running number of identities in the order in which they are first seen."""
    first = rows.groupBy(*group, *identity).agg(F.min(order).alias("_first"))
    first = first.withColumn("index", F.row_number().over(Window.partitionBy(*group).orderBy("_first")) - 1).drop("_first")
    return rows.join(first, [*group, *identity])


def resume_at(rows: DataFrame, group: list[str], index: str) -> DataFrame:
    """W9."""
    return rows.groupBy(*group).agg((F.max(index) + 1).alias("next_index"))


def requested(registry: DataFrame, ids: list[str]) -> DataFrame:
    """Registry rows in the order asked for; an unknown id is an error when the row is read."""
    asked = registry.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], "pos int, id string")
    known = registry.groupBy("id").agg(F.count("*").alias("n"))
    d = asked.join(known, "id", "left")
    return d.withColumn("id", F.when(F.col("n").isNull(), F.raise_error(F.concat(F.lit("unknown setup "), "id"))).otherwise(F.col("id"))).select("pos", "id", "n")


def selected_units(frontiers: DataFrame) -> DataFrame:
    """Selected rows (folder, selected as VARIANT) as the results of their functions. Ids and the flag fall back to the nested result where they are falsy; coverage and score only where the key is absent, so a null that is there stays."""
    at = lambda path, kind: F.try_variant_get("selected", path, kind)
    text = lambda k: F.coalesce(F.nullif(at(f"$.{k}", "string"), F.lit("")), F.nullif(at(f"$.result.{k}", "string"), F.lit("")), F.col("folder"))
    number = lambda k: F.when(at(f"$.{k}", "variant").isNotNull(), at(f"$.{k}", "double")).otherwise(at(f"$.result.{k}", "double"))
    flag = F.coalesce(at("$.passed", "boolean"), F.lit(False)) | F.coalesce(at("$.result.passed", "boolean"), F.lit(False))
    return frontiers.select(text("function_key").alias("function_key"), text("func_id").alias("func_id"), flag.alias("passed"), number("coverage_pct").alias("coverage_pct"), number("semantic_score").alias("semantic_score"), at("$.result.verdict", "string").alias("verdict"))


def known_dependents(functions: DataFrame) -> DataFrame:
    """Functions (name, dependents) with the dependents that are functions themselves, in their order, and whether the first is another one. Names are joined, since the set of all functions may be large."""
    d = functions.select("name", F.posexplode("dependents").alias("pos", "dep")).join(functions.select(F.col("name").alias("dep")).distinct(), "dep", "left_semi")
    kept = d.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dep"))), lambda x: x["dep"]).alias("known"))
    out = functions.select("name").join(kept, "name", "left").select("name", F.coalesce("known", F.array().cast("array<string>")).alias("known"))
    return out.withColumn("check_others", F.get("known", 0) != F.col("name"))


def turn_numbers(events: DataFrame, session: str, order: str, starts: Column) -> DataFrame:
    """The turn counter of a session: it grows with each event that starts a turn."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("turn_no", F.sum(F.when(starts, 1).otherwise(0)).over(w))


#: Variables that matter. Fixed values.
MAKE_KEYS = ["CFLAGS", "CFLAGS_LINUX", "CPPFLAGS", "INCLUDE", "LDFLAGS", "LDLIBS", "LIBS"]


def continuation_groups(lines: DataFrame, file: str, line_no: str, text: str, wanted: list[str] = MAKE_KEYS) -> DataFrame:
    """KEY = value lines with what continues them after a backslash, one row a definition. A line that assigns a wanted key is a definition even there."""
    assign = r"^([A-Za-z_][A-Za-z0-9_]*)\s*[:+?]?=\s*(.*)$"
    w = Window.partitionBy(file).orderBy(line_no)
    d = lines.withColumn("_open", F.coalesce(F.endswith(F.rtrim(F.lag(text).over(w)), F.lit("\\")), F.lit(False)) & ~F.regexp_extract(text, assign, 1).isin(wanted))
    d = d.withColumn("_g", F.sum(F.when(~F.col("_open"), 1).otherwise(0)).over(w))
    body = F.regexp_replace(F.when(F.col("_open"), F.col(text)).otherwise(F.regexp_extract(text, assign, 2)), r"\\\s*$", "")
    d = d.withColumns({"_key": F.when(~F.col("_open"), F.regexp_extract(text, assign, 1)), "_body": F.when(F.col("_open") & F.ltrim(text).startswith("#"), "").otherwise(F.trim(body))})
    g = d.groupBy(file, "_g").agg(F.max("_key").alias("key"), F.min(line_no).alias("line_no"), F.array_sort(F.collect_list(F.struct(line_no, "_body"))).alias("_b"))
    return g.where("key <> ''").select(file, "key", "line_no", F.array_join(F.filter(F.transform("_b", lambda x: x["_body"]), lambda s: s != ""), " ").alias("value"))


def make_variables(groups: DataFrame, file: str, wanted: list[str] = MAKE_KEYS) -> DataFrame:
    """The values of the wanted keys, repeated ones joined by a space."""
    g = groups.where(F.col("key").isin(wanted)).groupBy(file, "key").agg(F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("v"))
    return g.select(file, "key", F.array_join(F.transform("v", lambda x: x["value"]), " ").alias("value"))
