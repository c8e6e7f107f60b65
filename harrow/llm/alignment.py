"""Alignment of two tokenizers over the same bytes, by byte-owner arrays.

Each byte of a text has an owner in A and one in B: the token that it lies in. Token numbers repeated over their bytes are the owner arrays; wherever the pair of owners changes, a new link begins, and where both change at once, a group ends.

A text is cut at spaces that both tokenizers cut at, and only different segments are encoded, each once while a worker remembers it. One pass over the texts counts the links of each pair of ids in the corpus; a second one sums, for each document, what its links are worth.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from harrow.llm.shared import cache, discard, stash
from harrow.llm.token_counts import divisible

#: Remembered segments of a worker, twice: when as many are new, those of before that were not met again are forgotten. Longer ones than KEPT bytes are not remembered.
MEMORY, KEPT = 200_000, 64
#: Characters of text worked on at once; a longer text is cut where segments begin.
CHUNK = 1 << 21
#: Pairs of ids of which a task holds counts before it hands them on.
HELD = 1 << 19
#: Pairs of ids up to which all counts go to every task (17 bytes each); with more, a document's pairs are joined to them.
PAIRS = 4_000_000
#: White space beyond ASCII: before a space, it is no end of a segment.
_WIDE = re.compile("[\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_GAP = re.compile("(?<=[!-~]) ")


def _byte_of() -> dict[str, int]:
    """The signs by which byte-level vocabularies write bytes: those that can be printed stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Pair:
    """The two tokenizers, and what is remembered of segments."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        byte_of, n = _byte_of(), self.a.get_vocab_size()
        entries = [self.a.id_to_token(i) or "" for i in range(n)]
        self.a_bytes = [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in entries]
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        how = json.loads(self.a.to_str())
        pre = how["pre_tokenizer"] or {}
        #: Whether a text may be cut: A parts words before it merges, B has no token with a space after another sign.
        self.safe = how["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and divisible(self.b)
        self.now: dict[str, dict] = {}
        self.before: dict[str, dict] = {}

    def segments(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The segments of texts that begin with a space, and how many come before each text."""
        raw = [t.encode() for t in texts]
        size = np.array([len(b) for b in raw], np.int64)
        a = np.frombuffer(b"".join(raw), np.uint8)
        first = np.cumsum(size) - size
        prev = np.concatenate([np.zeros(1, np.uint8), a[:-1]])
        cut = (a == 32) & (prev > 32) & (prev != 127)
        for k, t in enumerate(texts):
            if len(t) != size[k] and _WIDE.search(t):
                own = slice(first[k], first[k] + size[k])
                cut[own] &= prev[own] < 128
        if not self.safe:
            cut[:] = False
        cut[first + size - 1] = False  # a space that ends a text
        cut[first] = True
        starts = np.flatnonzero(cut)
        offsets = np.append(starts, len(a)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(a)])
        return parts, np.append(np.searchsorted(starts, first), len(starts))

    def _ids(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of A and of B of segments taken as one text; None if they are not its bytes."""
        whole = b"".join(segments)
        text = whole.decode()
        ids = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:])
        if any(b"".join(map(own.__getitem__, i)) != whole for own, i in zip((self.a_bytes, self.b_bytes), ids)):
            return None
        return np.array(ids[0], np.int64), np.array(ids[1], np.int64)

    def _owned(self, segments: list[bytes], said: bool) -> tuple | None:
        """aligned() of segments that can be encoded as one text; None if the tokens are not its bytes."""
        ids = self._ids(segments)
        if ids is None:
            return None
        a, b = ids
        owner_a, owner_b = np.repeat(np.arange(len(a)), self.a_len[a]), np.repeat(np.arange(len(b)), self.b_len[b])
        new_a, new_b = (np.concatenate([[True], o[1:] != o[:-1]]) for o in (owner_a, owner_b))
        link, cut = np.flatnonzero(new_a | new_b), np.flatnonzero(new_a & new_b)
        keys = a[owner_a[link]] << 32 | b[owner_b[link]]
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)))])
        ends = [np.searchsorted(x, starts) for x in (np.flatnonzero(new_a), np.flatnonzero(new_b), cut, link)]
        counts = np.stack([np.diff(x) for x in ends], axis=1)
        text = [b""] * len(segments)
        if said:
            sa, sb = list(map(str, a.tolist())), list(map(str, b.tolist()))
            ga, gb = [*owner_a[cut].tolist(), len(a)], [*owner_b[cut].tolist(), len(b)]
            each = [f"{sa[w] if x - w == 1 else ','.join(sa[w:x])}|{sb[y] if z - y == 1 else ','.join(sb[y:z])};" for w, x, y, z in zip(ga[:-1], ga[1:], gb[:-1], gb[1:])]
            at = ends[2].tolist()
            text = ["".join(each[x:y]).encode() for x, y in zip(at[:-1], at[1:])]
        return counts, keys, text

    def aligned(self, segments: list[bytes], said: bool) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(counts, keys, texts) of segments. counts: of each its tokens in A and in B, groups and links, all -1 if the tokens are not its bytes; keys: its links as a << 32 | b, one segment's after the other's; texts: with `said` its groups, each ended by a semicolon."""
        last = np.array([x[-1] for x in segments], np.uint8)
        alone = (last < 33) | (last == 127) | (not self.safe)
        for k in np.flatnonzero(last > 127).tolist():
            alone[k] |= bool(_WIDE.search(segments[k].decode()))
        joined = np.flatnonzero(~alone).tolist()
        found = self._owned([segments[k] for k in joined], said) if joined else None
        if found is None:
            joined = []
        counts, texts, keys = np.full((len(segments), 4), -1, np.int64), [b""] * len(segments), [np.zeros(0, np.int64)] * len(segments)
        if joined:
            if len(joined) == len(segments):
                return found
            counts[joined] = found[0]
            at = np.cumsum(found[0][:, 3])
            for k, own, text in zip(joined, np.split(found[1], at[:-1]), found[2]):
                keys[k], texts[k] = own, text
        for k in sorted(set(range(len(segments))) - set(joined)):
            own = self._owned([segments[k]], said)
            if own is not None:
                counts[k], keys[k], texts[k] = own[0][0], own[1], own[2][0]
        return counts, np.concatenate(keys), texts

    def facts(self, name: str, segments: list[bytes], said: bool, made: Callable[[np.ndarray, np.ndarray, list[bytes]], list]) -> list:
        """made(*aligned(...)) of different segments; `name` tells what was made of them before from what is made now."""
        if name not in self.now:
            self.now, self.before = {name: {}}, {name: {}}
        now, before = self.now[name], self.before[name]
        found = list(map(now.get, segments))
        missing = [k for k, x in enumerate(found) if x is None]
        if len(now) + len(missing) > MEMORY and now:
            self.before, self.now = {name: now}, {name: {}}
            now, before = self.now[name], self.before[name]
        new = []
        for k in missing:
            x = before.get(segments[k])
            if x is None:
                new.append(k)
            else:
                found[k] = now[segments[k]] = x
        for at in range(0, len(new), 2_000):
            some = new[at : at + 2_000]
            for k, x in zip(some, made(*self.aligned([segments[k] for k in some], said))):
                found[k] = x
                if len(segments[k]) <= KEPT:
                    now[segments[k]] = x
        return found


def _pair(a_path: str, b_path: str) -> Pair:
    held = cache("alignment")
    if (a_path, b_path) not in held:
        held[a_path, b_path] = Pair(a_path, b_path)
    return held[a_path, b_path]


def _chunks(texts: list[str | None], cuttable: bool) -> Iterator[tuple[list[int], list[str]]]:
    """(rows, parts) of about CHUNK characters: texts with a space before them; the parts of a longer one follow one another. Null and empty texts have none."""
    rows: list[int] = []
    parts: list[str] = []
    n = 0
    for k, t in enumerate(texts):
        if not t:
            continue
        t, at = " " + t, 0
        while at < len(t):
            gap = _GAP.search(t, at + CHUNK, len(t) - 1) if cuttable else None
            end = gap.start() if gap else len(t)
            if n and n + end - at > CHUNK:
                yield rows, parts
                rows, parts, n = [], [], 0
            rows.append(k)
            parts.append(t[at:end])
            n, at = n + end - at, end
    if rows:
        yield rows, parts


def _summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and how many times each stands there."""
    every, n = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])[: len(every)])
    return every[first], np.add.reduceat(n[order], first) if len(first) else n


def _links(facts: list[bytes], times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of segments (the bytes of their keys) that stand there so many times."""
    some = np.flatnonzero(times).tolist()
    each = [facts[k] for k in some]
    return _summed([np.frombuffer(b"".join(each), np.int64)], [np.repeat(times[some], [len(x) >> 3 for x in each])])


def link_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(key, n, best): how many links of the corpus hold an id of A linked with one of B (key: a << 32 | b), and whether no other id of A is linked more often with that of B; stashed. A task adds up its own links first."""

    def keys_only(counts: np.ndarray, keys: np.ndarray, texts: list[bytes]) -> list[bytes]:
        """The bytes of each one's keys; one byte marks a segment without tokens."""
        raw, at = keys.tobytes(), np.concatenate([[0], 8 * np.cumsum(np.maximum(0, counts[:, 3]))]).tolist()
        return [b"-" if n < 0 else raw[x:y] for n, x, y in zip(counts[:, 3].tolist(), at[:-1], at[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        times: list[np.ndarray] = []

        def summed() -> pa.RecordBatch:
            own, n = _summed(keys, times)
            keys[:], times[:] = [own], [n]
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array(n)], ["key", "n"])

        for b in batches:
            pair, texts, held, bad = _pair(a_path, b_path), b.column("text").to_pylist(), [], set()
            for rows, parts in _chunks(texts, pair.safe):
                segments, bounds = pair.segments(parts)
                coded = pc.dictionary_encode(segments)
                facts, codes = pair.facts("links", coded.dictionary.to_pylist(), False, keys_only), coded.indices.to_numpy()
                odd = np.array([len(x) == 1 for x in facts])
                if odd.any():
                    at = np.searchsorted(bounds, np.flatnonzero(odd[codes]), "right") - 1
                    bad.update(rows[k] for k in np.unique(at).tolist())
                held.append((rows, bounds, codes, facts))
            for rows, bounds, codes, facts in held:
                if bad:
                    facts = [b"" if len(x) == 1 else x for x in facts]
                    codes = codes[np.repeat([r not in bad for r in rows], np.diff(bounds))]
                own, n = _links(facts, np.bincount(codes, minlength=len(facts)))
                keys.append(own)
                times.append(n)
            if sum(map(len, keys)) > HELD:
                out = summed()
                if len(keys[0]) > HELD:
                    yield out
                    keys.clear()
                    times.clear()
        if keys:
            yield summed()

    each = docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    each = stash(each, "links")
    low = F.col("key").bitwiseAND(0xFFFFFFFF)
    most = each.groupBy(low.alias("b")).agg(F.max("n").alias("most"))  # a row for each id of B's vocabulary at most
    out = stash(each.join(F.broadcast(most), low == F.col("b")).select("key", "n", (F.col("n") == F.col("most")).alias("best")), "counts")
    discard(each)
    return out


_BASE = "n_a long, n_b long, n_groups long, n_links long"


def align(docs: DataFrame, a_path: str, b_path: str, keep: bool = False, most: int = PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs; with keep also groups, the text that is hashed: ids of A, a bar, ids of B, groups parted by semicolons.

    A text that is null or empty, or whose tokens in A or B are other bytes than a space and the text, has no tokens: zeros, and an empty groups_sha256. Texts of any length are taken whole. Repeated rows count each for themselves, equal counts are all the best; an empty table gives no rows; other columns are not read.

    Up to `most` pairs of ids their counts are broadcast. With more, each document's different pairs are rows, which are joined to the counts and added up again.
    """
    counts = link_counts(docs, a_path, b_path)
    spark, few = docs.sparkSession, counts.count() <= most
    worth = None
    if few:
        t = counts.toArrow()
        key, n, best = (t.column(c).to_numpy() for c in ("key", "n", "best"))
        order = np.argsort(key)
        worth = spark.sparkContext.broadcast((counts._stash_path, key[order], n[order], best[order]))
    d = docs.select("doc_id", "text")
    more = "n_best long, count_sum long" if few else "rid long, links array<struct<key: long, times: long>>"
    shape = StructType([d.schema["doc_id"], *StructType.fromDDL(f"{_BASE}, {more}, groups_sha256 string" + ", groups string" * keep).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        name, key, n, best = worth.value if few else ("", None, None, None)

        def valued(counts: np.ndarray, keys: np.ndarray, texts: list[bytes]) -> list[tuple[bytes, bytes, bytes]]:
            """(counts, then best links and the sum of counts, as bytes; groups as text; keys)."""
            ends = np.concatenate([[0], np.cumsum(np.maximum(0, counts[:, 3]))])
            at = np.searchsorted(key, keys) if few else None
            sums = [np.diff(np.concatenate([[0], np.cumsum(v[at])])[ends]) if few else np.zeros(len(texts), np.int64) for v in (best, n)]
            raw, heads = b"" if few else keys.tobytes(), np.column_stack([counts, *sums]).astype(np.int64).tobytes()
            cut = (8 * ends).tolist()
            return [(heads[48 * k : 48 * k + 48], t, raw[cut[k] : cut[k + 1]]) for k, t in enumerate(texts)]

        for b in batches:
            pair, texts = _pair(a_path, b_path), b.column("text").to_pylist()
            total = np.zeros((len(texts), 6), np.int64)
            bad = np.zeros(len(texts), bool)
            sha: list = [None] * len(texts)
            said: list[list[str]] = [[] for _ in texts]
            links: list[list[tuple]] = [[] for _ in texts]
            for rows, parts in _chunks(texts, pair.safe):
                segments, bounds = pair.segments(parts)
                coded = pc.dictionary_encode(segments)
                facts, codes = pair.facts("worth" + name, coded.dictionary.to_pylist(), True, valued), coded.indices.to_numpy()
                heads, text, own = zip(*facts)
                table = np.frombuffer(b"".join(heads), np.int64).reshape(-1, 6)
                odd = np.concatenate([[0], np.cumsum((table[:, 0] < 0)[codes])])
                sums = np.add.reduceat(table[codes], bounds[:-1], axis=0)
                taken = pa.array(text, pa.binary()).take(coded.indices)
                at, whole = taken.buffers()[1], memoryview(taken.buffers()[2] or b"")
                at = np.frombuffer(at, np.int32)[bounds].tolist()
                for k, r in enumerate(rows):
                    total[r] += sums[k]
                    if odd[bounds[k + 1]] > odd[bounds[k]]:
                        bad[r] = True
                        continue
                    if sha[r] is None:
                        sha[r] = hashlib.sha256()
                    else:
                        sha[r].update(b";")
                    group = whole[at[k] : at[k + 1] - 1]
                    sha[r].update(group)
                    if keep:
                        said[r].append(str(group, "ascii"))
                    if not few:
                        mine, times = np.unique(codes[bounds[k] : bounds[k + 1]], return_counts=True)
                        links[r].append(_links([own[c] for c in mine.tolist()], times))
            total[bad] = 0
            digest = ["" if bad[r] or h is None else h.hexdigest() for r, h in enumerate(sha)]
            columns = [b.column("doc_id"), *(pa.array(total[:, c]) for c in range(4))]
            if few:
                columns += [pa.array(total[:, 4]), pa.array(total[:, 5])]
            else:
                of = [_summed(*zip(*x)) if x and not bad[r] else ((), ()) for r, x in enumerate(links)]
                kind = pa.list_(pa.struct([("key", pa.int64()), ("times", pa.int64())]))
                columns += [pa.array(np.arange(rid, rid + len(texts))), pa.array([[{"key": int(x), "times": int(y)} for x, y in zip(*p)] for p in of], kind)]
                rid += len(texts)
            columns.append(pa.array(digest, pa.string()))
            if keep:
                columns.append(pa.array(["" if bad[r] else ";".join(s) for r, s in enumerate(said)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, shape.names)

    made = stash(d.mapInArrow(run, shape), "aligned")
    if few:
        return made
    each = made.select("rid", F.explode("links").alias("x")).select("rid", "x.key", "x.times")
    sums = each.join(counts, "key").groupBy("rid").agg(F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256"]
    return made.drop("links").join(sums, "rid", "left").select(*names, *["groups"] * keep)
