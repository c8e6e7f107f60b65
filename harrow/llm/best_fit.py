"""Best-fit packing in rounds: what is unplaced and what room is left are sorted together by size, over range partitions.

A sweep goes down its partition and gives each piece the smallest room that it has passed and that holds the piece. What a partition can't settle by itself is a run of pieces larger than all its rooms and a run of rooms larger than all that is left below: the runs of all partitions are matched by counts alone, the nearest run of rooms first, and pieces meet rooms by their ranks in the runs. Then rooms shrink, and the next round begins; pieces larger than any room left open sequences.

No partition holds more than its range of rows, whatever the sizes are: equal sizes are told apart by id.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.packing import pieces
from harrow.llm.shared import discard, stash

#: Rows of a range partition, about. A round of fewer rows is the last one.
ROWS = 20_000
_SWEPT = "kind int, id long, size int, seq long, part int, rank long"
#: Kinds of rows: a room and a piece, as they are sorted; a placed piece.
ROOM, PIECE, PLACED = 0, 1, 2


def sweep(rows: list[tuple[int, int, int]], last: bool, capacity: int) -> tuple[list, list, list]:
    """(placed (piece, size, sequence), unplaced (piece, size), rooms (sequence, room)) of rows (size, kind, id), the largest first, rooms before pieces of their size. Rooms come smallest first. last: a piece without a room opens a sequence of its own id."""
    rooms: list[tuple[int, int]] = []
    placed, unplaced = [], []
    for size, kind, i in rows:
        if kind == ROOM:
            insort(rooms, (size, i))
            continue
        at = bisect_left(rooms, (size, -(1 << 63)))
        if at < len(rooms):
            room, seq = rooms.pop(at)
        elif last:
            room, seq = capacity, i
        else:
            unplaced.append((i, size))
            continue
        placed.append((i, size, seq))
        if room > size:
            insort(rooms, (room - size, seq))
    return placed, unplaced, [(seq, room) for room, seq in rooms]


def matched(runs: list[tuple[int, int, int, int, int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each partition of unplaced pieces, spans (first rank, partition of rooms, first rank there, pieces a room) in order of rank; the last span of all ends with a partition of -1.

    runs: (partition, pieces, largest piece, rooms, smallest room), from the largest sizes to the smallest; rooms count only if they hold whatever comes later. A run of pieces takes the rooms of the nearest partition before it, as many pieces to a room as the smallest of these rooms holds of the largest of these pieces.
    """
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    open_runs: list[list[int]] = []
    for part, n_pieces, largest, n_rooms, smallest in runs:
        spans, rank = [], 0
        while rank < n_pieces and open_runs:
            of, used, n, least = open_runs[-1]
            fit = max(1, least // largest)
            spans.append((rank, of, used, fit))
            if (n - used) * fit > n_pieces - rank:
                open_runs[-1][1] += -(-(n_pieces - rank) // fit)
                rank = n_pieces
            else:
                rank += (n - used) * fit
                open_runs.pop()
        if n_pieces:
            out[part] = [*spans, (rank, -1, 0, 1)]
        if n_rooms:
            open_runs.append([part, 0, n_rooms, smallest])
    return out


def _swept(state: DataFrame, n: int, capacity: int) -> DataFrame:
    """The rows of state (kind, id, size) after a sweep of each range partition. rank: a piece's or room's place in its run; a room smaller than the partition's smallest row is in none."""
    parts = max(1, n // ROWS)
    order = [F.desc("size"), F.asc("kind"), F.asc("id")]
    d = state.repartition(1) if parts == 1 else state.repartitionByRange(parts, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("size", "kind", "id")))]
        if not rows:
            return
        placed, unplaced, rooms = sweep(rows, parts == 1, capacity)
        low = rows[-1][0]
        small = bisect_left(rooms, low, key=lambda x: x[1])
        out = [(PLACED, i, size, seq, part, -1) for i, size, seq in placed]
        out += [(PIECE, i, size, None, part, k) for k, (i, size) in enumerate(unplaced)]
        out += [(ROOM, seq, room, None, part, k - small if k >= small else -1) for k, (seq, room) in enumerate(rooms)]
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["kind", "id", "size", "seq", "part", "rank"])

    return d.sortWithinPartitions(*order).mapInArrow(run, _SWEPT)


def _dealt(swept: DataFrame) -> DataFrame:
    """The unplaced pieces of swept (id, size) with the run (to) and the rank there (nth) of the room that each goes to; to is -1 for those without one. A row for each partition reaches the driver."""
    ends = swept.where((F.col("kind") != PLACED) & (F.col("rank") >= 0)).groupBy("part").agg(F.count_if(F.col("kind") == PIECE).alias("n"), F.coalesce(F.max(F.when(F.col("kind") == PIECE, F.col("size"))), F.lit(0)).alias("most"), F.count_if(F.col("kind") == ROOM).alias("m"), F.coalesce(F.min(F.when(F.col("kind") == ROOM, F.col("size"))), F.lit(0)).alias("least"))
    spans = swept.sparkSession.sparkContext.broadcast(matched(sorted(tuple(r) for r in ends.collect())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, rank = b.column("part").to_numpy(), b.column("rank").to_numpy()
            to, nth = np.full(len(part), -1, np.int32), np.zeros(len(part), np.int64)
            for p in np.unique(part).tolist():
                own = np.flatnonzero(part == p)
                first, of, used, fit = np.array(spans.value[p]).T
                k = np.searchsorted(first, rank[own], "right") - 1
                to[own], nth[own] = of[k], used[k] + (rank[own] - first[k]) // fit[k]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("size"), pa.array(to), pa.array(nth)], ["id", "size", "to", "nth"])

    return swept.where(F.col("kind") == PIECE).select("id", "size", "part", "rank").mapInArrow(run, "id long, size int, to int, nth long")


def placed(items: DataFrame, capacity: int) -> DataFrame:
    """(id, seq, offset) of items (id long >= 0, size int, below capacity), packed by best fit; stashed. An item's own id names the sequence that it opens, negative numbers those opened empty."""
    spark = items.sparkSession
    openers = items.where(2 * F.col("size") > capacity)
    done = [stash(openers.select("id", F.col("id").alias("seq"), "size", F.lit(0).alias("round")), "placed")]
    state = stash(items.select(F.when(2 * F.col("size") > capacity, ROOM).otherwise(PIECE).alias("kind"), "id", F.when(2 * F.col("size") > capacity, capacity - F.col("size")).otherwise(F.col("size")).cast("int").alias("size")), "state")
    opened = 0
    while True:
        counts = {ROOM: {}, PIECE: {}}
        for r in state.groupBy("kind", "size").agg(F.count("*").alias("n")).collect():  # at most two rows for each size below capacity
            counts[r["kind"]][r["size"]] = r["n"]
        if not counts[PIECE]:
            break
        smallest, room = min(counts[PIECE]), max(counts[ROOM], default=0)
        too_large = sum(size * n for size, n in counts[PIECE].items() if size > room)
        new = -(-too_large // capacity)
        rows = state.where((F.col("kind") == PIECE) | (F.col("size") >= smallest))
        if new:
            rows = rows.union(spark.range(opened, opened + new).select(F.lit(ROOM), -1 - F.col("id"), F.lit(capacity)))
        opened += new
        n = new + sum(counts[PIECE].values()) + sum(c for size, c in counts[ROOM].items() if size >= smallest)
        swept = stash(_swept(rows, n, capacity), "swept")
        dealt = _dealt(swept)
        rooms = swept.where(F.col("kind") == ROOM)
        met = dealt.where("to >= 0").join(rooms.where("rank >= 0").select(F.col("part").alias("to"), F.col("rank").alias("nth"), F.col("id").alias("seq")), ["to", "nth"])
        by_rank = stash(met.select("id", "seq", "size", F.lit(len(done)).alias("round")), "placed")
        used = by_rank.groupBy("seq").agg(F.sum("size").alias("used"))
        left = rooms.join(used, rooms["id"] == used["seq"], "left").select("kind", "id", (F.col("size") - F.coalesce("used", F.lit(0))).cast("int").alias("size"))
        before, state = state, stash(left.union(dealt.where("to < 0").select(F.lit(PIECE), "id", "size")), "state")
        # the sweep's pieces came before those that went by rank, for these took what it left
        done += [stash(swept.where(F.col("kind") == PLACED).select("id", "seq", "size", F.lit(len(done) - 0.5).alias("round")), "placed"), by_rank]
        discard(before, swept)
    every = done[0].select("id", "seq", "size", F.col("round").cast("double").alias("round"))
    for d in done[1:]:
        every = every.union(d.select("id", "seq", "size", F.col("round").cast("double")))
    before = Window.partitionBy("seq").orderBy("round", F.desc("size"), "id").rowsBetween(Window.unboundedPreceding, -1)  # a sequence holds at most capacity pieces
    out = stash(every.select("id", "seq", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset")), "offsets")
    discard(state, *done)
    return out


def pack(docs: DataFrame, path: str, end_id: int = 0, max_len: int = 2048, keep: bool = False) -> DataFrame:
    """The pieces of docs (doc_id, piece, start, length, ids_crc32, sequence_id, offset; with keep also ids) in sequences of at most max_len tokens.

    A document of more tokens is cut into pieces of max_len and a rest; nothing else is cut. A null or empty text is the end id alone. Texts of any length are taken whole. Repeated rows are packed each for itself, and equal lengths are told apart by the place of their rows. An empty table gives no pieces; other columns are not read.
    """
    made = pieces(docs, path, end_id, max_len, keep).withColumn("id", F.monotonically_increasing_id())
    made = stash(made.drop("part", "nth", "doc_tokens").withColumn("piece", (F.col("start") / max_len).cast("int")), "pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep]
    at = placed(made.where(F.col("length") < max_len).select("id", F.col("length").cast("int").alias("size")), max_len)
    whole = made.where(F.col("length") == max_len).select(*names, F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = made.where(F.col("length") < max_len).join(at, "id").select(*names, F.col("seq").alias("sequence_id"), "offset")
    return whole.union(rest)
