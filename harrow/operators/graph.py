"""Call graphs as edge tables (src, dst, ...); trees and paths are rows with the path as an array."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.operators.calls import LEVELS, walked
from harrow.sources.scratch import cut


def expand(edges: DataFrame, roots: DataFrame, max_depth: int = LEVELS) -> DataFrame:
    """The call tree of each root as rows (root, path, node, depth, is_leaf). A node that its own path holds already is a leaf, so trees end by themselves. With a max_depth, rows end there, and a row there that is no leaf says that its tree goes on."""
    return walked(
        edges.sparkSession,
        """WITH RECURSIVE tree (root, path, node, depth, is_leaf) MAX RECURSION LEVEL 100000 AS (
             SELECT root, array(root), root, 0, false FROM {roots}
             UNION ALL
             SELECT t.root, array_append(t.path, e.dst), e.dst, t.depth + 1, array_contains(t.path, e.dst)
             FROM tree t JOIN {edges} e ON e.src = t.node
             WHERE NOT t.is_leaf AND t.depth < {limit})
           SELECT * FROM tree""",
        roots=roots, edges=edges.select("src", "dst").distinct(), limit=max_depth,
    )


def paths_to(edges: DataFrame, roots: DataFrame, target: object, max_depth: int = LEVELS) -> DataFrame:
    """All simple paths from each root to the target, each ending at its first hit; the search is pruned there, not afterwards. With a max_depth, those of at most so many calls."""
    return walked(
        edges.sparkSession,
        """WITH RECURSIVE walk (root, path, node, depth) MAX RECURSION LEVEL 100000 AS (
             SELECT root, array(root), root, 0 FROM {roots}
             UNION ALL
             SELECT w.root, array_append(w.path, e.dst), e.dst, w.depth + 1
             FROM walk w JOIN {edges} e ON e.src = w.node
             WHERE w.node <> {target} AND NOT array_contains(w.path, e.dst) AND w.depth < {limit})
           SELECT root, path, depth FROM walk WHERE node = {target}""",
        roots=roots, edges=edges.select("src", "dst").distinct(), target=target, limit=max_depth,
    )


def last_path(paths: DataFrame) -> DataFrame:
    """Of a root's paths (root, key, path) the last in preorder: that of the greatest key."""
    return paths.groupBy("root").agg(F.max_by("path", "key").alias("path"))


def reaching(edges: DataFrame, target: object) -> DataFrame:
    """Nodes other than the target that reach it; breadth first, a table of new nodes for each level, so each node is written and joined once."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    seen = e.where(F.col("dst") == target).select(F.col("src").alias("node")).where(F.col("node") != target).distinct()
    levels = [cut(seen)]
    while not levels[-1].isEmpty():
        new = e.join(levels[-1], F.col("dst") == F.col("node")).select(F.col("src").alias("node")).where(F.col("node") != target).distinct()
        levels.append(cut(new.join(reduce(DataFrame.union, levels), "node", "left_anti")))
    return reduce(DataFrame.union, levels)


def highest_parents(edges: DataFrame, target: object) -> DataFrame:
    """Nodes that reach the target and are reached by none themselves."""
    called = edges.where("src <> dst").select(F.col("dst").alias("node")).distinct()
    return reaching(edges, target).join(called, "node", "left_anti")


def entry_points(nodes: DataFrame) -> DataFrame:
    """G11."""
    return nodes.where("name = 'main'")


def expand_macros(macros: DataFrame) -> DataFrame:
    """Where a macro's chain of expansions ends; a chain that comes back to itself ends before it does."""
    return walked(
        macros.sparkSession,
        """WITH RECURSIVE chain (name, at, path, depth) MAX RECURSION LEVEL 100000 AS (
             SELECT name, value, array(name), 1 FROM {macros}
             UNION ALL
             SELECT c.name, m.value, array_append(c.path, c.at), c.depth + 1
             FROM chain c JOIN {macros} m ON m.name = c.at
             WHERE NOT array_contains(c.path, c.at))
           SELECT name, max_by(at, depth) AS target, max(depth) AS depth FROM chain GROUP BY name""",
        macros=macros.select("name", "value"),
    )


def last_macro(macros: DataFrame, order: str) -> DataFrame:
    """A macro's last definition."""
    return macros.groupBy("name").agg(F.max_by("value", order).alias("value"))


def register_nodes(nodes: DataFrame, order: str) -> DataFrame:
    """One row of a unique id, the first registration."""
    return nodes.groupBy("unique_id").agg(F.min_by(F.struct("name", "file_name", "is_external"), order).alias("n")).select("unique_id", "n.*")


def call_edges(calls: DataFrame) -> DataFrame:
    """An edge for each callback of a call, or one without; a callback that is named twice counts once."""
    cb = F.when(F.size("callbacks") > 0, F.array_distinct("callbacks")).otherwise(F.array(F.lit(None).cast("string")))
    return calls.select("src", "dst", "line_number", F.explode(cb).alias("callback"))


def classify(paths: DataFrame, launches: DataFrame) -> DataFrame:
    """Paths (id, path of struct(name, callback)): at the first node that takes a callback, its launch type and the next node; else FORK and main."""
    first = F.filter(F.transform(F.slice("path", F.lit(1), F.greatest(F.lit(0), F.size("path") - 1)), lambda n, i: F.struct(i.alias("i"), n["name"].alias("name"), n["callback"].alias("callback"))), lambda n: n["callback"].isNotNull())
    d = paths.withColumn("_f", F.get(first, 0))
    d = d.withColumns({"_name": F.col("_f.name"), "call_function": F.coalesce(F.get("path", F.col("_f.i") + 1)["name"], F.lit("main"))})
    d = d.join(launches.select(F.col("name").alias("_name"), "launch"), "_name", "left")
    return d.select("id", F.when(F.col("_f").isNull(), "FORK").otherwise(F.coalesce("launch", F.lit("NO DATA"))).alias("launch_via"), "call_function")


def adjacency(paths: DataFrame) -> DataFrame:
    """Edges (src, dst, level) of paths (id, path); the neighbours of one path meet inside its row."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.get("path", i - 1).alias("src"), F.get("path", i).alias("dst"), (i + 1).alias("level")))
    return paths.where(F.size("path") > 1).select(F.explode(pairs).alias("e")).select("e.*").distinct()


def first_place(paths: DataFrame) -> DataFrame:
    """The place of each node where it is first seen on any path."""
    return paths.select("id", F.posexplode("path").alias("pos", "node")).groupBy("node").agg(F.min(F.struct("id", "pos")).alias("at")).select("node", "at.id", "at.pos")


def bundle(edges: DataFrame, fan: int = 6, shown: int = 30) -> DataFrame:
    """Per (src, dst) the number of edges; beyond `fan` also their sum, bounds, first labels in order and width."""
    n, w = F.count("*"), F.col("weight").try_cast("long")
    many = F.col("n") > fan
    d = edges.groupBy("src", "dst").agg(n.alias("n"), F.sum(w).alias("_s"), F.min(w).alias("_lo"), F.max(w).alias("_hi"), F.max("level").alias("level"))
    # the first labels by counts of equal ones, so that no group's labels are gathered
    ranked = edges.where("weight is not null").groupBy("src", "dst", F.col("weight").cast("string").alias("_w")).agg(F.count("*").alias("_c"))
    ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("src", "dst").orderBy("_w"))).where(F.col("_r") <= shown)
    labels = ranked.groupBy("src", "dst").agg(F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_w", "_c"))), lambda x: F.array_repeat(x["_w"], F.least(x["_c"], F.lit(shown)).cast("int")))), 1, shown).alias("_l"))
    d = d.join(labels, ["src", "dst"], "left")
    only = lambda c, alias: F.when(many, c).alias(alias)
    width = F.least(F.lit(15.0), 1.5 + 2.0 * F.log2("n"))
    return d.select("src", "dst", "n", "level", only(F.col("_s"), "total"), only(F.col("_lo"), "least"), only(F.col("_hi"), "most"), only(F.array_join("_l", ", "), "labels"), only(F.round(width.cast("decimal(20,8)"), 4).cast("double"), "width"))


def mermaid(edges: DataFrame, direction: str = "TD") -> DataFrame:
    """Lines (kind, key, line) of a flow chart: nodes by name with running ids, then edges; to be written in order of kind and key. Ids come from a global order of the names, so this is for graphs that are drawn."""
    names = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    ids = names.withColumn("id", F.concat(F.lit("n"), (F.row_number().over(Window.orderBy("node")) - 1).cast("string")))
    head = edges.sparkSession.createDataFrame([(0, "", f"flowchart {direction}")], "kind int, key string, line string")
    nodes = ids.select(F.lit(1).alias("kind"), F.col("node").alias("key"), F.concat(F.lit("    "), "id", F.lit("["), "node", F.lit("]")).alias("line"))
    e = edges.join(ids.select(F.col("node").alias("src"), F.col("id").alias("a")), "src").join(ids.select(F.col("node").alias("dst"), F.col("id").alias("b")), "dst")
    lines = e.select(F.lit(2).alias("kind"), F.concat_ws("|", "src", "dst", F.col("weight").cast("string")).alias("key"), F.concat(F.lit("    "), "a", F.lit(" -->|"), F.col("weight").cast("string"), F.lit("| "), "b").alias("line"))
    return head.union(nodes).union(lines)


def definition_counts(definitions: DataFrame) -> DataFrame:
    """A18."""
    return definitions.agg(F.count_if(~F.col("is_static")).alias("n_global"), F.count_if("is_static").alias("n_static"))


def label(name: Column, line: Column, is_external: Column) -> Column:
    """A call site's label, or the definition's where line is null."""
    return F.concat(F.when(line.isNotNull(), F.concat(F.lit("["), line.cast("string"), F.lit("]"))).otherwise(F.lit("")), name, F.when(is_external, " (external)").otherwise(""))
