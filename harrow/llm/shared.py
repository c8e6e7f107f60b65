"""What the operators share: reading tables, the shared folder, distributed ranks, bounded filters."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bounds of an Arrow batch while a table is stashed. Rows hold whole texts or blocks of them, so batches are bounded by bytes too; a larger row is a batch of its own.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}
#: Links up to which one task finds the components; it holds about 100 bytes for each.
SOLVED = 1_000_000
_own: dict[str, str] = {}
_caches: dict[str, dict] = {}


def cache(owner: str) -> dict:
    """What an operator remembers in this Python worker. A worker serves one operator after the other, so what the others remember is forgotten."""
    for name, held in _caches.items():
        if name != owner:
            held.clear()
    return _caches.setdefault(owner, {})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode, where it may be unset, a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="harrow-"))


def stash(df: DataFrame, label: str) -> DataFrame:
    """Writes df to a new table in the shared folder and reads it back: lineage ends there, and a lost executor costs only its own tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    was = {k: spark.conf.get(k) for k in BATCH}
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes stashed tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_stash_path", None)
        if path:
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ranked(df: DataFrame, part: list[str], keys: list[Column], n_rows: int, out: str, per_bucket: int = 5_000) -> DataFrame:
    """Adds out: gapless positions from 0 within the columns `part`, without sorting a part in one task.

    Rows are dealt by a hash of `keys` into buckets of about per_bucket rows, and buckets into shelves of about as many. A row's position is its place in its bucket, plus the counts of the buckets before on its shelf, plus the counts of the shelves before; a row for each shelf (one of per_bucket squared rows) is all that is put in order as a whole.
    """
    buckets = max(256, n_rows // per_bucket)
    d = df.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    sizes = d.groupBy(*part, "_b").agg(F.count("*").alias("_n")).withColumn("_shelf", F.floor(F.col("_b") / per_bucket))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.coalesce(F.sum("_n").over(before(*part, "_shelf").orderBy("_b")), F.lit(0))
    shelves = sizes.groupBy(*part, "_shelf").agg(F.sum("_n").alias("_n"))
    shelves = shelves.select(*part, "_shelf", F.coalesce(F.sum("_n").over(before(*part).orderBy("_shelf")), F.lit(0)).alias("_first"))
    sizes = sizes.select(*part, "_b", "_shelf", so_far.alias("_before")).join(shelves, [*part, "_shelf"]).select(*part, "_b", (F.col("_first") + F.col("_before")).alias("_before"))
    inside = Window.partitionBy(*part, "_b").orderBy(*keys)
    d = d.withColumn("_r", F.row_number().over(inside))
    return d.join(sizes, [*part, "_b"]).withColumn(out, F.col("_before") + F.col("_r") - 1).drop("_b", "_r", "_before")


def flagged(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, flag: str) -> DataFrame:
    """df with a boolean column: whether the key may be among wanted's keys. It is true for all that are and for few others.

    wanted becomes a bitmap of 16 bits a key, of 2**16 to 2**27 bits in all, so what is broadcast has a bound whatever the size of wanted. With more keys than a sixteenth of 2**27 it is true for more others; an exact join follows in any case.
    """
    bits = min(27, max(16, (16 * wanted.count()).bit_length()))
    size = F.lit(1 << bits)
    slots = wanted.select(F.pmod(F.xxhash64(wanted_key), size).alias("_s"))
    words = slots.groupBy(F.shiftright("_s", 6).alias("_w")).agg(F.expr("bit_or(shiftleft(1L, cast(_s & 63 as int)))").alias("_bits"))
    d = df.withColumn("_s", F.pmod(F.xxhash64(key), size)).withColumn("_w", F.shiftright("_s", 6))
    d = d.join(F.broadcast(words), "_w", "left").withColumn(flag, F.expr("coalesce((shiftright(_bits, cast(_s & 63 as int)) & 1L) = 1L, false)"))
    return d.drop("_s", "_w", "_bits")


def maybe_in(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """Rows of df whose key may be among wanted's keys: never loses one, lets few others through."""
    return flagged(df, key, wanted, wanted_key, "_in").where("_in").drop("_in")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (a, b), and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        if (rx == ry).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while ((further := root[root]) != root).any():
            root = further


def _solved(links: DataFrame, parts: int) -> DataFrame:
    """(u, v) with v the smallest node that u reaches by the links of its partition, u > v. Links are dealt over `parts` tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(x.column("u").to_numpy(), x.column("v").to_numpy()) for x in batches]
        if held:
            node, root = forest(*(np.concatenate(c) for c in zip(*held)))
            far = node > root
            yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(root[far])], ["u", "v"])

    return links.repartition(parts).mapInArrow(run, "u long, v long")


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """(node, root) for every node of links (a, b), which are longs: root is the smallest node it reaches.

    Every task first contracts the links that it holds. Up to SOLVED links one task does that, and it is all. Beyond, alternating large-star and small-star steps follow; each ends in a stashed table, and nothing but counts reaches the driver.
    """
    e = stash(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), label)
    n = e.count()
    new = stash(_solved(e, max(1, -(-n // SOLVED)) if SOLVED else 4), label)
    discard(e)
    e = new

    def mark(d: DataFrame) -> tuple:
        row = d.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    was = mark(e) if n > SOLVED else None
    while was and was[0]:
        # what a join needs is a table of its own, so that it can split a node of very many links
        both = stash(e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), label)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = stash(low, label)
        large = stash(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), label)
        least = stash(large.groupBy("u").agg(F.min("v").alias("m")), label)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        new = stash(small.where("u > v").distinct(), label)
        now = mark(new)
        discard(e, both, low, large, least)
        e = new
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
