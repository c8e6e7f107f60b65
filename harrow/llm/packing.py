"""Packing: shortest-pack-first over the length histogram.

Each document becomes token ids; what is longer than a sequence is cut into whole sequences and a rest. Only the histogram of piece lengths (at most max_len counts) reaches the driver, where lengths are placed longest first and packs that look alike are one packing pattern with a count. Patterns are joined back to pieces by their rank among the pieces of that length.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from struct import pack as to_bytes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.shared import cache, stash

#: Remembered words of a worker, twice: when as many are new, those of before that were not met again are forgotten. Longer words than KEPT bytes are not remembered, so this bounds the bytes too.
MEMORY, KEPT = 300_000, 64
#: Characters of text encoded at once; a longer text is cut at white space.
CHUNK = 1 << 21
#: The marks that an ASCII letter can be composed with.
_MARKS = re.compile("[\u0300-\u036f]")
_SPACE = re.compile("[ \t-\r]")
#: Classes of bytes: white space, letters, digits, other signs, and those next to which a word is not cut.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[:128] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = 1
_CLASS[np.frombuffer(b"0123456789", np.uint8)] = 2
_CLASS[ord("'")] = 4


def parts_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The parts of the texts that the tokenizer encodes apart from one another, and how many of them come before each text.

    White space parts words. In a word, letters, each digit, and runs of other signs are parts, but next to an apostrophe or a character beyond ASCII nothing is cut. A-Z are folded. A text that may hold a special string, or a mark that a letter is composed with, is cut at white space alone and not folded: special strings are matched by case and before folding, and marks are composed before it.
    """
    raw, whole = [], []
    for t in texts:
        b = t.encode()
        plain = b"<|" not in b and (len(b) == len(t) or not _MARKS.search(t))
        raw.append(b.lower() if plain else b)
        whole.append(not plain)
    size = np.array([len(b) + 1 for b in raw], np.int64)
    a = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    kind = _CLASS[a]
    for at, n in zip((np.cumsum(size) - size)[whole], size[whole]):
        own = kind[at : at + n]
        own[own > 0] = 4
    before = np.concatenate([np.zeros(1, np.uint8), kind[:-1]])
    cut = ((kind != before) & (kind != 4) & (before != 4)) | (kind == 2) | (before == 0)
    inside = kind > 0
    cut &= inside & ~((kind == 2) & (before == 4))
    # parts follow one another once white space is left out
    place = np.cumsum(inside)
    starts = place[cut] - 1
    offsets = np.append(starts, place[-1] if len(place) else 0).astype(np.int32)
    parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(a[inside])])
    return parts, np.concatenate([[0], np.cumsum(cut)])[np.concatenate([[0], np.cumsum(size)])]


class Words:
    """Token ids of parts of texts, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        for token, i in self.tok.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.now: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _each(self, words: list[str]) -> list[bytes]:
        return [to_bytes(f"<{len(e.ids)}I", *e.ids) for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    def _plain(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters alone: the tokenizer takes each as one, so one text of many is parted again where its words end. If their number is another (a letter may become two signs), each is encoded by itself."""
        ids = np.array(self.tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        end = np.flatnonzero(self.ends[ids]) + 1
        if len(end) != len(words):
            return self._each(words)
        flat, at = ids.tobytes(), [0, *(4 * end).tolist()]
        return [flat[x:y] for x, y in zip(at[:-1], at[1:])]

    def ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words."""
        found = list(map(self.now.get, words))
        if None not in found:
            return found
        missing = [k for k, x in enumerate(found) if x is None]
        if len(self.now) + len(missing) > MEMORY and self.now:
            self.before, self.now = self.now, {}
        now, before = self.now, self.before
        new = [w for k in missing if (w := words[k]) not in before]
        own: dict[bytes, bytes] = {}
        if new:
            text = [w.decode() for w in new]
            letters = [k for k, t in enumerate(text) if t.isalpha()]
            odd = [k for k, t in enumerate(text) if not t.isalpha()]
            for which, how in ((letters, self._plain), (odd, self._each)):
                for at in range(0, len(which), 2_000):
                    some = which[at : at + 2_000]
                    own.update(zip([new[k] for k in some], how([text[k] for k in some])))
        for k in missing:
            w = words[k]
            x = own.get(w)
            found[k] = x = before[w] if x is None else x
            if len(w) <= KEPT:
                now[w] = x
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Texts are cut into parts and these numbered without Python objects; only different parts become such."""
        parts, bounds = parts_of(texts)
        coded = pc.dictionary_encode(parts)
        found = self.ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        offsets = np.zeros(len(found) + 1, np.int32)
        np.cumsum(np.fromiter(map(len, found), np.int32, len(found)) >> 2, out=offsets[1:])
        each = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<u4")))
        taken = each.take(coded.indices)
        ids, at = taken.values.to_numpy(), taken.offsets.to_numpy()[bounds].tolist()
        return [ids[x:y] for x, y in zip(at[:-1], at[1:])]


def _cut(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        gap = _SPACE.search(text, at + CHUNK)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def encode(texts: list[str | None], path: str) -> list[np.ndarray]:
    """The ids of each text; a null text is empty."""
    loaded = cache("packing")
    if path not in loaded:
        loaded[path] = Words(path)
    words, out, at = loaded[path], [], 0
    while at < len(texts):
        some, n = [], 0
        while at < len(texts) and (not some or n + len(texts[at] or "") <= CHUNK):
            some.append(texts[at] or "")
            n += len(some[-1])
            at += 1
        out += [np.concatenate([words.encode([x])[0] for x in _cut(some[0])])] if n > CHUNK else words.encode(some)
    return out


def spread(counts: dict[int, int], max_len: int = 4096) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns [(lengths, how many sequences)] for a histogram {length: pieces}.

    Longest lengths first; each goes to the packs with the most room left (the shortest packs), and opens new packs only when it fits none. A length that fits a pack several times is placed there several times at once, so the number of patterns stays within a few times max_len, whatever the counts are.
    """
    open_packs: dict[int, list[list]] = defaultdict(list)  # room left -> [pattern, count]
    done: list[tuple[tuple[int, ...], int]] = []
    rooms: list[int] = []  # sorted rooms that open_packs holds

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room == 0:
            done.append((pattern, n))
            return
        if not open_packs[room]:
            rooms.insert(bisect_right(rooms, room), room)
        open_packs[room].append([pattern, n])

    for length in sorted((k for k in counts if k > 0), reverse=True):
        left = counts[length]
        while left:
            room = rooms[-1] if rooms else 0
            if room < length:
                fits = max_len // length
                if whole := left // fits:
                    put(max_len - fits * length, (length,) * fits, whole)
                if rest := left % fits:
                    put(max_len - rest * length, (length,) * rest, 1)
                left = 0
                continue
            pattern, n = open_packs[room].pop()
            if not open_packs[room]:
                rooms.pop()
            used = min(left, n)
            if used < n:
                put(room, pattern, n - used)
            put(room - length, (*pattern, length), used)
            left -= used
    return done + [(p, n) for packs in open_packs.values() for p, n in packs]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[list[int], list[tuple[int, int]]]]:
    """For each length: the ranks where a run of equal slots begins, and each run's (first sequence, offset)."""
    out: dict[int, tuple[list[int], list[tuple[int, int]]]] = defaultdict(lambda: ([], []))
    nxt: dict[int, int] = defaultdict(int)
    first = 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            starts, runs = out[length]
            starts.append(nxt[length])
            runs.append((first, offset))
            nxt[length] += n
            offset += length
        first += n
    return dict(out)


def pieces(docs: DataFrame, path: str, end_id: int, max_len: int = 4096, keep: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens; part and nth: the task that made it and how many pieces of its length came before there. keep: also the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), [0] * (max_len + 1)
        end = np.array([end_id], "<u4")
        for b in batches:
            rows: list[list] = [[] for _ in range(8)]
            for k, ids in enumerate(encode(b.column("text").to_pylist(), path)):
                ids = np.concatenate([ids, end])
                total = len(ids)
                for start in range(0, total, max_len):
                    piece = ids[start : start + max_len]
                    n = len(piece)
                    for column, v in zip(rows, (start, n, zlib.crc32(piece), total, part, seen[n], piece.tobytes() if keep else None, k)):
                        column.append(v)
                    seen[n] += 1
            ids_of = b.column("doc_id").take(pa.array(rows[7], pa.int64()))
            columns = [ids_of, *(pa.array(c, pa.int64()) for c in rows[:6])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"]
            if keep:
                columns, names = [*columns, pa.array(rows[6], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    d = docs.select("doc_id", "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long" + ", ids binary" * keep)


def pack(docs: DataFrame, path: str, end_id: int = 2, max_len: int = 4096, keep: bool = False) -> DataFrame:
    """The pieces of docs with sequence_id and offset. A null or empty text is the end id alone. Texts of any length are taken whole and cut into pieces. Repeated rows are packed each for itself; pieces of equal length are ties, placed in the order of the tasks that made them. An empty table gives no pieces; other columns are not read.

    Pieces are stashed, so that ranks do not change when a task runs again. The broadcast holds the packing patterns, whose number has a bound by max_len alone.
    """
    made = stash(pieces(docs, path, end_id, max_len, keep), "pieces")
    per_part = made.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most max_len rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranks = made.join(offsets, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    at = docs.sparkSession.sparkContext.broadcast(places(spread(counts, max_len)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, ranks = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == length)
                starts, runs = (np.array(x) for x in at.value[length])
                k = np.searchsorted(starts, ranks[own], "right") - 1
                seq[own], off[own] = runs[k, 0] + ranks[own] - starts[k], runs[k, 1]
            kept = [n for n in b.schema.names if n not in ("part", "nth", "before", "rank")]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(seq), pa.array(off)], [*kept, "sequence_id", "offset"])

    kept = [f for f in ranks.schema.fields if f.name not in ("part", "nth", "before", "rank")]
    return ranks.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long")
