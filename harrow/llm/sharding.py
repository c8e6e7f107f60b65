"""Shards by balanced label propagation.

Rows of equal text are linked. They begin spread over all shards and move, round by round, to the shard where most of their group is or can be, as far as its quota of rows goes. A round is a few joins of a table of labels; rows without links are left out of it and fill the shards up at the end, to the row. A group is moved in parts of bounded size, so one that is larger than a shard, or that holds a third of all rows, is neither gathered in a task nor left where it fell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.shared import discard, ranked, stash

#: Rounds of moves at most, and rows of a part of a group at most (about).
ROUNDS, PART_ROWS = 12, 20_000


def _moves(units: DataFrame, caps: dict[int, int], shards: int, step: int) -> DataFrame:
    """Units with the label that they have after a round, and whether they moved."""
    held = {r["label"]: r["n"] for r in units.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # a row for each shard
    room = F.element_at(F.create_map(*[F.lit(x) for s in range(shards) for x in (s, max(0, caps[s] - held.get(s, 0)))]), F.col("label"))
    cells = units.groupBy("gid", "label").agg(F.sum("n").alias("n"), F.first("g").alias("g"))
    # where most of the group is, or would be with all that the shard has room for
    worth = F.struct(F.least("g", F.col("n") + room).alias("reach"), "n", F.xxhash64(F.lit(step), "gid", "label").alias("h"), "label")
    best = cells.groupBy("gid").agg(F.max(worth).alias("best")).select("gid", F.col("best.label").alias("to"))
    u = units.join(best, "gid")
    wish = u.where("label <> to")
    leaving = {r["label"]: r["n"] for r in wish.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    quota = F.element_at(F.create_map(*[F.lit(x) for s in range(shards) for x in (s, max(0, caps[s] - held.get(s, 0) + leaving.get(s, 0)))]), F.col("to"))
    # running totals of what wants to move to a shard, in buckets, so that no task gathers a shard
    buckets = max(64, sum(held.values()) // 20_000)
    w = wish.withColumn("b", F.pmod(F.xxhash64(F.lit(step), "gid", F.floor(F.col("part") / 256)), F.lit(buckets)))
    sums = w.groupBy("to", "b").agg(F.sum("n").alias("s"))
    sums = sums.select("to", "b", F.coalesce(F.sum("s").over(Window.partitionBy("to").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("to", "b").orderBy("gid", "part").rowsBetween(Window.unboundedPreceding, 0))
    go = w.withColumn("upto", inside).join(sums, ["to", "b"]).where(F.col("before") + F.col("upto") <= quota).select("gid", "part", F.col("to").alias("new"))
    return units.drop("moved").join(go, ["gid", "part"], "left").select("gid", "part", "g", "n", F.coalesce("new", "label").alias("label"), F.col("new").isNotNull().alias("moved"))


def assign(docs: DataFrame, shards: int = 40, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of docs, by the law `rows`: shards differ by one row at most.

    A null text has no bytes, so size 16, and no links. Texts of any length are read once, for their digest. Repeated rows are rows like others, linked by their text; an empty table gives no rows; other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("gid"))
    base = stash(base.withColumn("rid", F.monotonically_increasing_id()), "rows")
    total = base.count()
    caps = {s: total // shards + (s < total % shards) for s in range(shards)}
    parts = max(64, total // PART_ROWS)
    rows = base.where("gid is not null").withColumn("part", F.pmod(F.xxhash64("rid"), F.lit(parts)))
    sizes = rows.groupBy("gid", "part").agg(F.count("*").alias("n"))
    sizes = stash(sizes, "sizes")
    groups = sizes.groupBy("gid").agg(F.sum("n").alias("g")).where("g > 1")
    spread = F.greatest(F.lit(1), F.ceil(F.col("g") / max(1, total // shards)))
    # a group that no shard can hold begins in as many as it needs, others anywhere
    label = F.when(spread > 1, F.pmod(F.pmod(F.xxhash64("gid"), F.lit(shards)) + F.pmod("part", spread), F.lit(shards))).otherwise(F.pmod(F.xxhash64("gid", "part"), F.lit(shards)))
    units = stash(sizes.join(groups, "gid").select("gid", "part", "g", "n", label.cast("int").alias("label")), "units")
    for step in range(rounds):
        new = stash(_moves(units, caps, shards, step), "units")
        discard(units)
        units = new
        if new.where("moved").isEmpty():
            break
    wish = rows.join(units.select("gid", "part", "label"), ["gid", "part"]).select("rid", "label")
    wish = stash(ranked(wish, ["label"], [F.col("rid")], total, "slot"), "wishes")
    cap = F.element_at(F.create_map(*[F.lit(x) for s in caps for x in (s, caps[s])]), F.col("label"))
    held = wish.where(F.col("slot") < cap)
    n = {r["label"]: r["n"] for r in held.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row for each shard
    placed = base.join(held, "rid", "left").select("rid", "doc_id", "size", "text_crc32", F.col("label").alias("shard"), "slot")
    placed = stash(placed, "placed")
    rest = ranked(placed.where("shard is null").drop("shard", "slot"), [], [F.col("rid")], total, "q")
    first = F.element_at(F.create_map(*[F.lit(x) for s in range(shards) for x in (s, n.get(s, 0) - sum(caps[x] - n.get(x, 0) for x in range(s)))]), F.col("shard"))
    free = [(s, sum(caps[x] - n.get(x, 0) for x in range(s)), caps[s] - n.get(s, 0)) for s in range(shards)]
    shard = F.coalesce(*[F.when((F.col("q") >= at) & (F.col("q") < at + k), F.lit(s)) for s, at, k in free])
    rest = rest.withColumn("shard", shard).withColumn("slot", F.col("q") + first)
    out = placed.where("shard is not null").select("doc_id", "size", "text_crc32", "shard", "slot").union(rest.select("doc_id", "size", "text_crc32", "shard", "slot"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
