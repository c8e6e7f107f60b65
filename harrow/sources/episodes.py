"""Episode folders: which files are there is settled by a listing; contents are read of small named files alone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions.structs import json_object
from harrow.sources.files import packed, text_files

#: Folders that a search doesn't go into; fixed values. Spark's listing enters none whose name begins with a dot.
SKIP = (".git", "node_modules", ".cache")


def plain(path: Column | str) -> Column | str:
    """A path without its scheme."""
    pattern = "^[a-zA-Z][a-zA-Z0-9+.-]*:/+"
    return re.sub(pattern, "/", path) if isinstance(path, str) else F.regexp_replace(path, pattern, "/")


def listing(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, inner, length): the files below a folder, and their place in it. Contents are a column of the source that is not asked for, so no file is opened."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    root = plain(path.rstrip("/")) + "/"
    d = (r.option("pathGlobFilter", pattern) if pattern else r).load(path).select(plain(F.col("path")).alias("path"), "length")
    d = d.select("path", F.expr(f"substr(path, {len(root) + 1})").alias("inner"), "length")
    packs = packed(spark, path, pattern)
    return d if packs is None else d.union(packs.select(plain(F.col("path")), "inner", "length"))


def first_by_level(files: DataFrame, name: str, depth: int = 8, skip: tuple[str, ...] = SKIP, by: int = 0) -> DataFrame:
    """(root, path, level): the file of this name that lies highest, of equals the first by path; levels count from 0, those beyond depth and below skipped folders don't count. by: how many leading folders tell searches apart."""
    parts = F.split("inner", "/")
    inside = F.slice(parts, by + 1, F.greatest(F.lit(0), F.size(parts) - 1 - by))
    d = files.where(F.size(parts) > by).select(F.array_join(F.slice(parts, 1, by), "/").alias("root"), "path", F.size(inside).alias("level"), F.element_at(parts, -1).alias("_name"), F.arrays_overlap(inside, F.array(*map(F.lit, skip))).alias("_skipped"))
    return d.where((F.col("_name") == name) & ~F.col("_skipped") & (F.col("level") <= depth)).groupBy("root").agg(F.min(F.struct("level", "path")).alias("f")).select("root", "f.path", "f.level")


def complete(files: DataFrame, required: list[str]) -> DataFrame:
    """(episode): the folders that hold every one of the required places (metadata.json, workspace/result.json, ...), as a bit for each, put together by folder."""
    bit = F.coalesce(*[F.when(F.endswith("path", F.lit("/" + r)), F.struct(F.lit(1 << k).alias("bit"), F.expr(f"left(path, length(path) - {len(r) + 1})").alias("episode"))) for k, r in sorted(enumerate(required), key=lambda x: -len(x[1]))])
    d = files.select(bit.alias("b")).where("b is not null").groupBy("b.episode").agg(F.bit_or("b.bit").alias("mask"))
    return d.where(F.col("mask") == (1 << len(required)) - 1).select("episode")


def objects(spark: SparkSession, path: str, place: str) -> DataFrame:
    """(episode, row): the JSON objects at this place in their folders, as VARIANT; what is none is left out. Only files of that name are opened."""
    d = text_files(spark, path, place.rsplit("/", 1)[-1]).select(plain(F.col("path")).alias("path"), json_object(F.col("text")).alias("row"))
    return d.where(F.endswith("path", F.lit("/" + place)) & F.col("row").isNotNull()).select(F.expr(f"left(path, length(path) - {len(place) + 1})").alias("episode"), "row")


def truthy(row: str, key: str) -> Column:
    """Whether a key's value is there and neither null, false, zero nor empty."""
    v = F.try_variant_get(row, f"$.{key}", "variant")
    zero = F.coalesce(F.try_variant_get(row, f"$.{key}", "double") == 0, F.lit(False)) & (F.schema_of_variant(v) != "STRING")
    return F.coalesce(~F.to_json(v).isin("null", "false", '""', "[]", "{}") & ~zero, F.lit(False))


def episodes(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """(item, name, episode, metadata, result) of the complete episodes: item and name are the folder's last two names. metadata.json and the result.json among the required are read; an unreadable one leaves the episode out."""
    found = complete(listing(spark, path), required)
    result = next(r for r in required if r.endswith("result.json"))
    d = found.join(objects(spark, path, "metadata.json").withColumnRenamed("row", "metadata"), "episode").join(objects(spark, path, result).withColumnRenamed("row", "result"), "episode")
    part = lambda k: F.element_at(F.split("episode", "/"), -k)
    return d.select(part(2).alias("item"), part(1).alias("name"), "episode", "metadata", "result")


def first_validated(found: DataFrame) -> DataFrame:
    """Of each item the first episode by name whose result is validated."""
    return found.where(truthy("result", "validated")).groupBy("item").agg(F.min_by(F.struct("name", "episode", "metadata"), "name").alias("e")).select("item", "e.*")


def validated_stubs(spark: SparkSession, path: str) -> DataFrame:
    """(stub, func_name) of every validated result with a body beside it; func_name is the folder's name only where the result has no such key, null where it says null. Only folders right below the path count."""
    root = plain(path.rstrip("/"))
    bodies = complete(listing(spark, path), ["result.json", "stub.c"])
    d = objects(spark, path, "result.json").where(truthy("row", "validated")).join(bodies, "episode").where(F.regexp_replace("episode", "/[^/]*$", "") == root)
    has = F.schema_of_variant(F.try_variant_get("row", "$.func_name", "variant")).isNotNull()
    return d.select(F.concat("episode", F.lit("/stub.c")).alias("stub"), F.when(has, F.try_variant_get("row", "$.func_name", "string")).otherwise(F.element_at(F.split("episode", "/"), -1)).alias("func_name"))


def histories(unscored: DataFrame, files: DataFrame) -> DataFrame:
    """Unscored episodes (episode, agent_history, workspace) with their history and the step (1 to 4) that gave it: the recorded one, else that of the recorded workspace; where that is not there, agent_history in the episode, else in its workspace, which stands even if it isn't there.

    A folder is there if the listing has a file below it. Candidates are rows, joined to the folders once.
    """
    recorded = F.when(F.coalesce("agent_history", F.lit("")) != "", F.struct(F.lit(1).alias("step"), F.col("agent_history").alias("history"))).when(F.coalesce("workspace", F.lit("")) != "", F.struct(F.lit(2).alias("step"), F.concat("workspace", F.lit("/agent_history")).alias("history")))
    guess = lambda k, place: F.struct(F.lit(k).alias("step"), F.concat("episode", F.lit(place)).alias("history"))
    asked = unscored.select("episode", F.explode(F.array_compact(F.array(recorded, guess(3, "/agent_history"), guess(4, "/workspace/agent_history")))).alias("c")).select("episode", "c.*")
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda k: F.array_join(F.slice(F.split("path", "/"), F.lit(1), k), "/"))
    folders = files.where(F.contains("path", F.lit("agent_history/"))).select(F.explode(above).alias("history")).distinct().withColumn("there", F.lit(True))
    d = asked.join(folders, "history", "left").where(F.col("there") | (F.col("step") == 4))
    return d.groupBy("episode").agg(F.min(F.struct("step", "history")).alias("h")).select("episode", "h.step", "h.history")


def semantic_contexts(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(episode, row) of every wanted episode: its semantic_context.json, or {"functions": {}} where there is none, or it is no object, or its functions are none."""
    d = wanted.select("episode").join(objects(spark, path, "semantic_context.json"), "episode", "left")
    ok = F.startswith(F.schema_of_variant(F.try_variant_get("row", "$.functions", "variant")), F.lit("OBJECT"))
    return d.select("episode", F.when(ok, F.col("row")).otherwise(F.parse_json(F.lit('{"functions": {}}'))).alias("row"))
