"""Near-duplicate documents by HyperMinHash.

A document is its set of distinct shingles. The shingles' hashes fall into buckets, and a bucket's register keeps the leading zeros of its smallest hash and some bits after them, 16 bits in all. Registers are banded: documents that agree in all registers of a band meet. Their similarity is estimated from all registers, corrected for collisions of the short registers; what may reach the threshold is verified on the full sets.

Documents of equal sets are one class, and one row of each stands for it, before anything is compared. Each class is first compared with one other of each of its bands, the hub: that settles bands of two classes, and connects most of a large group of near copies with no more pairs than there are band entries. Then what a band still holds of other components than its largest is compared with all of the band. In a large band of unlike documents, with a passage in common and of many components, only classes meet that agree in a second band as well; one of near copies, or with few others than its largest component, is compared in full with these. Blocks are bounded by classes and by shingles. Only pairs of different components whose estimate may reach the threshold become rows, and where a second band is large too only links.

Two sets at the threshold agree in no band with a probability of MISS at most, and in one alone with miss_twice(); only pairs whose one band is large are lost to that.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from harrow.llm.shared import cache, components, discard, flagged, maybe_in, stash

#: Registers; bits of the mantissa; how likely two sets at the threshold may miss each other in all bands.
BUCKETS, MANTISSA, MISS = 128, 10, 1e-6
#: Standard errors that the estimate may lie below the threshold.
SLACK = 5
#: Registers that are equal by chance in two sets of one size, by the published analysis of such sketches.
CHANCE = 0.16991948715 * BUCKETS / 2**MANTISSA
#: Orders in which hubs are chosen; classes and shingles of a block (about); entries beyond which a band is large, and those beside its largest component beyond which it takes a second band.
HUBS, BLOCK, BLOCK_SHINGLES, WIDE, OTHERS = 8, 128, 1 << 17, 64, 128
#: Share of a large band's rows that are together in the next band too beyond which the band is one of near copies.
ALIKE = 0.25
#: Bytes of text hashed at once (a longer word is hashed whole).
CHUNK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_GAP = re.compile(rb"[\t-\r ]")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64. Those for a chunk are kept."""
    most = CHUNK + (1 << 17)
    kept = cache("near_dedup")
    if "powers" in kept and n <= most:
        return kept["powers"]
    made = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, most) - 1, b, np.uint64))]) for b in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64)))]
    if n <= most:
        kept["powers"] = made[0], made[1]
    return made[0], made[1]


def word_hashes(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin in a buffer, and a 64-bit hash of each: a polynomial over its bytes, mixed with its length."""
    a = np.frombuffer(buffer, np.uint8)
    inside = np.concatenate([[False], ~_SPACE[a], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _power(len(a) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[a] * up[: len(a)], dtype=np.uint64)])
        h = (total[end] - total[start]) * down[start]
        return start, _mix(h + (end - start).astype(np.uint64))


def _long_hashes(raw: bytes) -> np.ndarray:
    """The hashes of the words of a long text, a chunk after the other."""
    out, at = [], 0
    while at < len(raw):
        gap = _GAP.search(raw, at + CHUNK)
        end = gap.start() if gap else len(raw)
        out.append(word_hashes(raw[at:end])[1])
        at = end
    return np.concatenate(out)


def _combine(s: np.ndarray, h: np.ndarray) -> np.ndarray:
    return _mix(s * np.uint64(0x9FB21C651E98DF25) + h)


def _shingles(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` words in a row."""
    s = h
    for k in range(1, size):
        s = _combine(s[: len(h) - k], h[k:])
    return s


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words is empty."""
    out: list[np.ndarray] = []
    at = 0
    raw = [(t or "").encode().translate(_FOLD) for t in texts]
    with np.errstate(over="ignore"):
        while at < len(raw):
            end, n = at + 1, len(raw[at])
            while end < len(raw) and n + len(raw[end]) < CHUNK:
                n += len(raw[end]) + 1
                end += 1
            if n > CHUNK:
                h, first = _long_hashes(raw[at]), np.zeros(2, np.int64)
                first[1] = len(h)
            else:
                start, h = word_hashes(b"\n".join(raw[at:end]))
                first = np.searchsorted(start, np.cumsum([0] + [len(x) + 1 for x in raw[at:end]]))
            s = _shingles(h, size) if len(h) >= size else h[:0]
            for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
                if hi - lo >= size:
                    out.append(np.unique(s[lo : hi - size + 1]))
                elif hi > lo:
                    x = h[lo : lo + 1]
                    for k in range(lo + 1, hi):
                        x = _combine(x, h[k : k + 1])
                    out.append(x + np.uint64(hi - lo))
                else:
                    out.append(h[:0])
            at = end
    return out


_EDGE = np.arange(BUCKETS + 1, dtype=np.float64) * 2.0 ** (64 - BUCKETS.bit_length() + 1)
_EDGE = np.array([min(int(x), (1 << 64) - 1) for x in _EDGE], np.uint64)
EMPTY = np.uint16(0xFFFF)


def registers(s: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a sorted set: leading zeros of each bucket's smallest hash, and MANTISSA bits after its first one."""
    i = np.searchsorted(s, _EDGE[:-1])
    filled = np.concatenate([i[1:], [len(s)]]) > i
    rest = s[np.minimum(i, max(0, len(s) - 1))] << np.uint64(BUCKETS.bit_length() - 1) if len(s) else np.zeros(BUCKETS, np.uint64)
    zeros = 53 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1].astype(np.uint64)
    bits = (rest << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA)
    return np.where(filled, (zeros << np.uint64(MANTISSA) | bits).astype(np.uint16), EMPTY)


def band_rows(percent: int) -> int:
    """Registers of a band: as many as the chance of a miss allows."""
    t = percent / 100
    return next((r for r in range(16, 1, -1) if (1 - t**r) ** (BUCKETS // r) <= MISS), 1)


def miss_twice(percent: int) -> float:
    """How likely two sets at the threshold agree in one band at most."""
    t, bands = (percent / 100) ** band_rows(percent), BUCKETS // band_rows(percent)
    return (1 - t) ** bands + bands * t * (1 - t) ** (bands - 1)


_PROBE = np.random.default_rng(7).integers(0, BUCKETS, (1024, BUCKETS))


def densified(r: np.ndarray) -> np.ndarray:
    """Registers without gaps: an empty one takes the value of the first filled one in an order of its own, the same for all documents. So a band of a short document needs all of its registers' sources to agree, not only the one or two that are filled."""
    filled = r != EMPTY
    gaps, out = np.flatnonzero(~filled), r.copy()
    for probe in _PROBE:
        if not len(gaps):
            return out
        source = probe[gaps]
        ok = filled[source]
        out[gaps[ok]] = r[source[ok]]
        gaps = gaps[~ok]
    out[gaps] = r[np.flatnonzero(filled)[0]]
    return out


def band_keys(r: np.ndarray, rows: int) -> list[int] | None:
    """A key for each band; null for an empty document."""
    if (r == EMPTY).all():
        return None
    bands = BUCKETS // rows
    b = densified(r)[: bands * rows].reshape(bands, rows)
    with np.errstate(over="ignore"):
        k = np.arange(1, bands + 1, dtype=np.uint64)
        for c in range(rows):
            k = _mix(k * np.uint64(0x9FB21C651E98DF25) + b[:, c].astype(np.uint64))
    return k.view(np.int64).tolist()


def sketches(docs: DataFrame, size: int, rows: int) -> DataFrame:
    """Of every row of docs: rid (a number of its own), doc_id, text_hash (Spark's of the text), n_shingles, c1 and c2 (a digest of the set), registers and bands; the last four are null for a row without words."""
    d = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"), "text")
    shape = StructType([*StructType.fromDDL("rid long").fields, d.schema["doc_id"], *StructType.fromDDL("text_hash long, n_shingles long, c1 long, c2 long, registers binary, bands array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets = shingle_sets(part.column("text").to_pylist(), size)
                regs = [registers(s) if len(s) else None for s in sets]
                digests = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist() if len(s) else (None, None) for s in sets]
                columns = [[len(s) for s in sets], *zip(*digests), [r if r is None else r.tobytes() for r in regs], [r if r is None else band_keys(r, rows) for r in regs]]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + part.num_rows)), part.column("doc_id"), part.column("text_hash"), *map(pa.array, columns, kinds)], shape.names)
                rid += part.num_rows

    return d.mapInArrow(run, shape)


def _matrix(registers: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(registers), np.uint16).reshape(len(registers), BUCKETS)


def may_reach(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of rows of registers, of sets of these sizes, may be as similar as `least`, by the estimate and its slack."""
    filled = (a != EMPTY) | (b != EMPTY)
    n = np.maximum(1, filled.sum(axis=1))
    low, high = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    ratio = high / np.maximum(1, low)
    chance = CHANCE * 4 * ratio / (1 + ratio) ** 2 * (n / BUCKETS)
    j = (((a == b) & filled).sum(axis=1) - chance) / n
    return (low >= least * high) & (j >= least - SLACK * (least * (1 - least) / n) ** 0.5)


class Sets:
    """The shingle sets of texts that a task meets again and again, up to `most` bytes of them."""

    def __init__(self, size: int, most: int = 64 << 20) -> None:
        self.size, self.most, self.held, self.bytes = size, most, {}, 0

    def of(self, rids: list[int], texts: list[str]) -> list[np.ndarray]:
        new = [k for k, r in enumerate(rids) if r not in self.held]
        if self.bytes > self.most:
            self.held, self.bytes, new = {}, 0, range(len(rids))
        for k, s in zip(new, shingle_sets([texts[k] for k in new], self.size)):
            self.held[rids[k]] = s
            self.bytes += s.nbytes
        return [self.held[r] for r in rids]


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many numbers each set of a shares with each of b."""
    flat, owner = np.concatenate(b), np.repeat(np.arange(len(b)), [len(s) for s in b])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    out = np.zeros((len(a), len(b)), np.int64)
    for i, s in enumerate(a):
        lo = np.searchsorted(flat, s, "left")
        k = np.searchsorted(flat, s, "right") - lo
        lo, k = lo[k > 0], k[k > 0]
        if len(k):
            out[i] = np.bincount(owner[np.repeat(lo - (np.cumsum(k) - k), k) + np.arange(k.sum())], minlength=len(b))
    return out


def _near_in_blocks(blocks: DataFrame, least: float, size: int = 0) -> DataFrame:
    """Pairs (a, b) of two blocks of a band: of different components, of sizes and estimates that may reach the threshold, and in no earlier band together. at and then are the band's place and, where a second band told the block apart, the place of that one (else -1), in which the pair must be together next.

    With a shingle size, the blocks hold texts and the pairs are verified here, on the full sets of both; then one link of a class to a component is enough.
    """
    percent = round(100 * least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Sets(size)
        for x in batches:
            out: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
            for k, (at, then) in enumerate(zip(x.column("at").to_pylist(), x.column("then").to_pylist())):
                few, every = (x.column(c)[k].values for c in ("few", "all"))
                ca, oa, na, cb, ob, nb = (s.field(c).to_numpy() for s in (few, every) for c in ("rid", "component", "n_shingles"))
                ba, bb = (s.field("bands").flatten().to_numpy().reshape(len(s), -1) for s in (few, every))
                met = oa[:, None] != ob[None, :]  # and which share this band, but none before it and none up to the second one
                for j in range(max(at, then) + 1):
                    same = ba[:, None, j] == bb[None, :, j]
                    met &= same if j in (at, then) else ~same
                i, q = np.nonzero(met)
                ra, rb = (_matrix(s.field("registers").to_pylist()) for s in (few, every))
                ok = np.concatenate([may_reach(ra[i[p : p + 4096]], rb[q[p : p + 4096]], na[i[p : p + 4096]], nb[q[p : p + 4096]], least) for p in range(0, len(i), 4096)] or [np.zeros(0, bool)])
                i, q = i[ok], q[ok]
                if size and len(i):
                    (ui, i), (uq, q) = (np.unique(v, return_inverse=True) for v in (i, q))
                    ca, na, cb, ob, nb = ca[ui], na[ui], cb[uq], ob[uq], nb[uq]
                    sets = [known.of(c.tolist(), s.field("text").take(pa.array(u)).to_pylist()) for c, s, u in ((ca, few, ui), (cb, every, uq))]
                    both = shared_counts(*sets)[i, q]
                    ok = 100 * both >= percent * (na[i] + nb[q] - both)
                    i, q = i[ok], q[ok]
                    one = np.unique(np.stack([i, ob[q]]), axis=1, return_index=True)[1]
                    i, q = i[one], q[one]
                out.append(np.stack([ca[i], cb[q]], axis=1))
            found = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return blocks.mapInArrow(run, "a long, b long")


def _likely(pairs: DataFrame, made: DataFrame, least: float) -> DataFrame:
    """Which of the pairs (a, b) of rids may reach the threshold, by their registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                ok = may_reach(*(_matrix(x.column(c).to_pylist()) for c in ("ra", "rb")), *(x.column(c).to_numpy() for c in ("na", "nb")), least)
                yield x.select(["a", "b"]).filter(pa.array(ok))

    side = lambda c: made.select(F.col("rid").alias(c), F.col("registers").alias(f"r{c}"), F.col("n_shingles").alias(f"n{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _verified(likely: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Which of the pairs (a, b) of rids are links, by their full sets: 100 * intersection >= percent * union; stashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Sets(size)
        for x in batches:
            sets = [known.of(x.column(c).to_pylist(), x.column(f"t{c}").to_pylist()) for c in ("a", "b")]
            both = np.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(*sets)], np.int64)
            every = np.array([len(a) + len(b) for a, b in zip(*sets)], np.int64) - both
            yield x.select(["a", "b"]).filter(pa.array(100 * both >= percent * every))

    side = lambda c: texts.select(F.col("rid").alias(c), F.col("text").alias(f"t{c}"))
    return stash(likely.join(side("b"), "b").join(side("a"), "a").mapInArrow(run, "a long, b long"), "verified")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("rid"))


def _texts(wanted: DataFrame, made: DataFrame, docs: DataFrame) -> DataFrame:
    """(rid, text) of the wanted rows; stashed. Rows are found again by doc_id and the text's hash."""
    reps = stash(made.join(wanted.distinct(), "rid").select("rid", "text_hash", F.col("doc_id").alias("_id")), "reps")
    near = maybe_in(docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"), "text"), F.col("text_hash"), reps, F.col("text_hash"))
    near = near.join(reps, (near["doc_id"].eqNullSafe(reps["_id"])) & (near["text_hash"] == reps["text_hash"])).select("rid", "text")
    out = stash(near.groupBy("rid").agg(F.first("text").alias("text")), "texts")
    discard(reps)
    return out


def _rest(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, at, then, rid, component, largest, n, others, work) of the bands of three classes or more that hold more than one component; stashed. at: the band's place; then: -1."""
    e = met.where("n > 2").join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left")
    return _open(e.select("band", "at", F.lit(-1).alias("then"), "rid", "n_shingles", F.coalesce("root", "rid").alias("component")))


def _twice(once: DataFrame, made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(band) of the bands of _rest() that take a second one, and their rows by a second, later band: as _rest() has them, but of what agrees in both; stashed.

    Bands are large, have many others, and are not alike: if more than ALIKE of a band's rows are also together in the next band in large groups, it is one of near copies, which a second band would part as little.
    """
    wide = once.where((F.col("n") > WIDE) & (F.col("others") > OTHERS)).select("band", "at", "rid", "component")
    wide = stash(wide.join(made.select("rid", "n_shingles", "bands"), "rid"), "wide")
    after = wide.groupBy("band", F.get("bands", (F.col("at") + 1) % F.size("bands")).alias("next")).agg(F.count("*").alias("n"))
    alike = F.sum(F.when(F.col("n") > WIDE, F.col("n")).otherwise(0)) / F.sum("n")
    chosen = stash(after.groupBy("band").agg(alike.alias("alike")).where(F.col("alike") <= ALIKE).select("band"), "chosen")
    e = wide.join(chosen, "band")
    e = e.select("band", "at", "rid", "n_shingles", "component", F.posexplode("bands").alias("then", "other")).where(F.col("then") > F.col("at"))
    out = _open(e.select(F.xxhash64("band", "other").alias("band"), "at", "then", "rid", "n_shingles", "component"))
    discard(wide)
    return chosen, out


def _open(e: DataFrame) -> DataFrame:
    """e (band, at, then, rid, n_shingles, component) with largest, n, others and work, of the bands that hold more than one component; stashed. largest: the component of most classes; others: classes of the other ones; work: shingles of the band."""
    e = stash(e, "open")
    sizes = e.groupBy("band", "component").agg(F.count("*").alias("k"), F.sum("n_shingles").alias("w"))
    state = sizes.groupBy("band").agg(F.count("*").alias("parts"), F.sum("k").alias("n"), (F.sum("k") - F.max("k")).alias("others"), F.sum("w").alias("work"), F.max_by("component", F.struct("k", "component")).alias("largest"))
    state = stash(state.where("parts > 1").drop("parts"), "bands")
    out = stash(maybe_in(e, F.col("band"), state, F.col("band")).join(state, "band").select("band", "at", "then", "rid", "component", "largest", "n", "others", "work"), "rest")
    discard(e, state)
    return out


def groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs; stashed.

    component_id is the smallest doc_id of those that links reach; nulls are passed over unless there is nothing else. Rows without words (null or empty text) are their own components. Rows of equal doc_id and equal sets share one. Texts of any length are taken whole; an empty table gives no rows; other columns are not read.
    """
    made = stash(sketches(docs, size, band_rows(percent)), "sketches")
    classes = made.where("n_shingles > 0").groupBy("c1", "c2").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("first_id"), F.count("*").alias("members"))
    classes = stash(classes, "classes")
    banded = stash(made.select("rid", "n_shingles", "bands").join(classes.select("rid"), "rid", "left_semi"), "banded")
    entries = banded.select("rid", "n_shingles", F.posexplode("bands").alias("at", "band"))
    mask = F.xxhash64(F.pmod("band", F.lit(HUBS)))  # an order of rids for each of HUBS kinds of bands, so that a class meets several hubs
    state = entries.groupBy("band").agg(F.count("*").alias("n"), F.min(F.col("rid").bitwiseXOR(mask)).alias("first")).where("n > 1")
    state = stash(state.select("band", "n", F.col("first").bitwiseXOR(mask).alias("hub")), "bands")
    met = stash(maybe_in(entries, F.col("band"), state, F.col("band")).join(state, "band"), "met")
    discard(banded, state)
    least = percent / 100
    pairs = met.where("rid <> hub").select(F.least("rid", "hub").alias("a"), F.greatest("rid", "hub").alias("b")).distinct()
    likely = stash(_likely(pairs, made, least), "likely")
    texts = _texts(_ends(likely), made, docs)
    links = _verified(likely, texts, size, percent)
    roots = stash(components(links), "roots")
    discard(likely, texts, links)
    # the rest: what is not of a band's largest component against all of the band, large bands by a second one
    once = _rest(met, roots)
    chosen, twice = _twice(once, made)
    rest = once.join(chosen, "band", "left_anti").union(twice)
    columns = ["rid", "component", "registers", "n_shingles", "bands"]
    full = rest.join(made.select("rid", "registers", "n_shingles", "bands"), "rid")

    def blocks(full: DataFrame, names: list[str], n_blocks: Column) -> DataFrame:
        full = full.select("band", "at", "then", n_blocks.alias("blocks"), "largest", *names).withColumn("block", F.pmod(F.xxhash64("rid"), "blocks"))
        every = full.groupBy("band", "block").agg(F.collect_list(F.struct(*names)).alias("all"))
        few = full.where("component <> largest").groupBy("band", "at", "then", "blocks", F.col("block").alias("part")).agg(F.collect_list(F.struct(*names)).alias("few"))
        # each block of few goes to every block of its band, so a large band's work is dealt over as many tasks as it has blocks
        few = few.select("band", "at", "then", "few", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        return few.join(every, ["band", "block"]).select("band", "at", "then", "few", "all")

    likely = stash(_near_in_blocks(blocks(full.where(F.col("n") <= WIDE), columns, F.lit(1).cast("long")), least), "likely")
    # in a band that is still large, pairs below the threshold may be too many to be rows: they are verified where they meet
    wide = full.where(F.col("n") > WIDE)
    texts = _texts(_ends(likely).union(rest.where(F.col("n") > WIDE).select("rid")), made, docs)
    n_blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("work") / BLOCK_SHINGLES))
    met_there = stash(_near_in_blocks(blocks(wide.join(texts, "rid"), [*columns, "text"], n_blocks), least, size), "wide")
    links = _verified(likely, texts, size, percent)
    found = links.union(met_there)
    if not found.isEmpty():
        old, roots = roots, stash(components(found.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))), "roots")
        discard(old)
    discard(met, once, chosen, twice, likely, texts, links, met_there)
    of = classes.join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left")
    least_id = stash(of.where("root is not null").groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    of = stash(of.where("root is not null or members > 1").join(least_id, "root", "left").select("c1", "c2", F.coalesce("component_id", "first_id").alias("component_id")), "classes")
    # rows without words have no class; a class of one row and no link is that row
    out = stash(made.select("doc_id", "n_shingles", "c1", "c2").join(of, ["c1", "c2"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), "groups")
    discard(made, classes, roots, least_id, of)
    return out


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group: that of the smallest doc_id. Rows that repeat its doc_id stay with it; rows without a doc_id stay. The columns are those of docs, whatever their names. Only rows that may go are shuffled."""
    found = groups(docs, size, percent).where("doc_id is not null").groupBy("doc_id").agg(F.min(F.col("doc_id") != F.col("component_id")).alias("gone"))
    gone = stash(found.where("gone").select(F.col("doc_id").alias("id")), "gone")
    d = flagged(docs.select(F.struct("*").alias("doc")), F.col("doc.doc_id"), gone, F.col("id"), "may_go")
    stay = d.where("not may_go").union(d.where("may_go").join(gone, F.col("doc.doc_id") == F.col("id"), "left_anti"))
    return stay.select("doc.*")
