"""Benchmark decontamination by suffix arrays over the training documents.

The benchmark is the query set. It is read in blocks of bounded size, each broadcast by itself; documents are never shuffled. A task cuts its documents into shards of bounded size, builds a word-level suffix array of each, and binary-searches every suffix of every benchmark item there: that gives each suffix's longest verbatim match, its places, and the places of its window. Words that no item of a block holds end a suffix, since no match goes through them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from harrow.llm.shared import cache

#: Words of documents in a shard, and of benchmark items in a block.
SHARD_WORDS, BLOCK_WORDS = 1_000_000, 2_000_000
#: A-Z become a-z; other ASCII than digits and letters parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class Block:
    """Suffixes of some benchmark items, as numbers of their words."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int) -> None:
        self.number: dict[bytes, int] = {}
        self.ids = [i for i, _ in items]
        flat, self.item, self.start = [], [], []
        for k, (_, ws) in enumerate(items):
            flat += [self.number.setdefault(w, len(self.number) + 1) for w in ws] + [0]
            self.item += [k] * (len(ws) + 1)
            self.start += range(len(ws) + 1)
        self.flat = np.array(flat, np.int64)
        self.item, self.start = np.array(self.item, np.int64), np.array(self.start, np.int64)
        length = np.array([len(ws) for _, ws in items], np.int64)
        self.left = length[self.item] - self.start if len(flat) else np.zeros(0, np.int64)
        self.window = np.minimum(window, length)[self.item] if len(flat) else np.zeros(0, np.int64)
        self.longest = int(length.max(initial=0))
        self.bits = max(1, int(len(self.number)).bit_length())


def suffix_array(a: np.ndarray, bits: int, depth: int) -> np.ndarray:
    """Positions of a with a[p] > 0, sorted by what follows, to the first 0 or `depth` numbers. a ends in zeros, one at least."""
    step = max(1, 63 // bits)
    padded = np.concatenate([a, np.zeros(step, a.dtype)])
    key, alive = np.zeros(len(a), np.int64), np.ones(len(a), bool)
    for k in range(step):
        w = padded[k : k + len(a)]
        alive &= w > 0
        key = (key << bits) | np.where(alive, w, 0)
    low = (1 << bits) - 1
    sa = np.flatnonzero(a > 0)
    sa = sa[np.argsort(key[sa], kind="stable")]
    if not len(sa):
        return sa
    k = key[sa]
    group = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
    open_ = (k & low) > 0
    done = step
    while done < depth:
        size = np.bincount(group)
        sel = np.flatnonzero(open_ & (size[group] > 1))
        if not len(sel):
            break
        nxt = key[np.minimum(sa[sel] + done, len(a) - 1)]
        order = np.lexsort((nxt, group[sel]))
        sa[sel], nxt = sa[sel][order], nxt[order]
        own = group[sel]
        split = np.zeros(len(sa), np.int64)
        split[sel[1:]] = (own[1:] == own[:-1]) & (nxt[1:] != nxt[:-1])
        group = group + np.cumsum(split)
        open_ = np.zeros(len(sa), bool)
        open_[sel] = (nxt & low) > 0
        done += step
    return sa


def _bound(a: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: int, want: np.ndarray, right: bool) -> np.ndarray:
    lo, hi = lo.copy(), hi.copy()
    while (go := lo < hi).any():
        mid = (lo + hi) // 2
        v = a[np.minimum(sa[np.minimum(mid, len(sa) - 1)] + at, len(a) - 1)]
        up = go & ((v <= want) if right else (v < want))
        lo = np.where(up, mid + 1, lo)
        hi = np.where(go & ~up, mid, hi)
    return lo


def search(a: np.ndarray, sa: np.ndarray, b: Block) -> tuple[np.ndarray, ...]:
    """For each suffix of the block: the length of its longest match and that match's range in sa; the range of its window."""
    n = len(b.flat)
    longest, lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    wlo, whi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    live = np.flatnonzero(b.flat > 0) if len(sa) else np.zeros(0, np.int64)
    l, h = np.zeros(len(live), np.int64), np.full(len(live), len(sa), np.int64)
    depth = 0
    while len(live):
        want = b.flat[live + depth]
        l, h = _bound(a, sa, l, h, depth, want, False), _bound(a, sa, l, h, depth, want, True)
        ok = l < h
        live, l, h = live[ok], l[ok], h[ok]
        depth += 1
        longest[live], lo[live], hi[live] = depth, l, h
        at = b.window[live] == depth
        wlo[live[at]], whi[live[at]] = l[at], h[at]
        more = b.left[live] > depth
        live, l, h = live[more], l[more], h[more]
    return longest, lo, hi, wlo, whi


def common_prefixes(a: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, wlo: np.ndarray, whi: np.ndarray, depth: int) -> np.ndarray:
    """How many words the suffixes at ranks r and r + 1 share, to `depth`; only where a window's range is wider than its longest match's, else 0."""
    edge = np.zeros(len(sa) + 1, np.int64)
    wide = (whi > wlo) & ((wlo < lo) | (hi < whi))
    np.add.at(edge, wlo[wide], 1)
    np.add.at(edge, whi[wide] - 1, -1)
    out = np.zeros(len(sa), np.int64)
    live = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
    for k in range(depth):
        x, y = (a[np.minimum(sa[r] + k, len(a) - 1)] for r in (live, live + 1))
        live = live[(x == y) & (x > 0)]
        if not len(live):
            break
        out[live] = k + 1
    return out


def own_matches(common: np.ndarray, longest: int, lo: int, hi: int, wlo: int, whi: int) -> np.ndarray:
    """The length of a suffix's match at each rank of its window's range: the longest in [lo, hi), from there outwards what all between share."""
    n = np.full(whi - wlo, longest, np.int64)
    n[: lo - wlo] = np.minimum.accumulate(common[wlo:lo][::-1])[::-1]
    n[hi - wlo :] = np.minimum.accumulate(common[hi - 1 : whi - 1])
    return n


def _shard(docs: list[list[bytes]], blocks: Iterator[Block]) -> list[tuple]:
    """Of each document: hit spans of words, ids of items found, longest match (words, item_id, word in the item, word here)."""
    begin = np.cumsum([0] + [len(d) + 1 for d in docs])
    mark = np.zeros(begin[-1] + 2, np.int64)
    items: dict[int, set] = defaultdict(set)
    best: dict[int, tuple] = {}
    reached = np.zeros(len(docs), np.int64)
    for b in blocks:
        flat: list[int] = []
        for d in docs:
            flat.extend(map(b.number.get, d, repeat(0)))
            flat.append(0)
        a = np.array(flat + [0], np.int64)
        sa = suffix_array(a, b.bits, b.longest)
        longest, lo, hi, wlo, whi = search(a, sa, b)
        by_range: dict[tuple, list[int]] = defaultdict(list)
        for s in np.flatnonzero(whi > wlo):
            by_range[int(wlo[s]), int(whi[s]), int(b.window[s])].append(s)
        for (l, h, w), found in by_range.items():
            at = sa[l:h]
            np.add.at(mark, at, 1)
            np.add.at(mark, at + w, -1)
            own = {b.ids[b.item[s]] for s in found}
            for d in np.unique(np.searchsorted(begin, at, "right") - 1):
                items[int(d)] |= own
        owner = np.searchsorted(begin, sa, "right") - 1
        common = common_prefixes(a, sa, lo, hi, wlo, whi, b.longest)
        for s in np.flatnonzero(whi > wlo):
            l, h = int(wlo[s]), int(whi[s])
            n, at, who = own_matches(common, int(longest[s]), int(lo[s]), int(hi[s]), l, h), sa[l:h], owner[l:h]
            order = np.lexsort((at, -n, who))  # of each document the longest, then the first place
            order = order[np.diff(who[order], prepend=-1) > 0]
            order = order[n[order] > reached[who[order]]]
            reached[who[order]] = n[order]
            for d, k, p in zip(who[order].tolist(), n[order].tolist(), at[order].tolist()):
                best[d] = (k, b.ids[b.item[s]], int(b.start[s]), p - int(begin[d]))
    inside = np.cumsum(mark) > 0
    out = []
    for k, d in enumerate(docs):
        hit = inside[begin[k] : begin[k] + len(d)].astype(np.int8)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
        out.append((list(zip(edge[::2].tolist(), edge[1::2].tolist())), items.get(k, set()), best.get(k)))
    return out


def blocks_of(benchmark: DataFrame, window: int) -> list:
    """The benchmark's blocks as broadcasts, in order of its ids. Rows come to the driver one partition at a time, and it holds one block."""
    sc = benchmark.sparkSession.sparkContext
    out, items, n = [], [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        if ws := words_of(r["text"]):
            items.append((r["item_id"], ws))
            n += len(ws)
            if n >= BLOCK_WORDS:
                out.append(sc.broadcast(Block(items, window)))
                items, n = [], 0
    return [*out, sc.broadcast(Block(items, window))] if items else out


def with_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Every row of docs as (doc, n_words, hit_spans, item_ids, longest): doc is the whole row, so its columns' names can't clash.

    hit_spans are [start, end) words inside an occurrence of a window of `window` item words (an item of fewer words is one window); item_ids are strings, sorted; longest is the document's own longest verbatim match of at least a window with its places, ties to the smallest item id, then to the first place in the item and in the document; it does not hang on the other documents of the shard. A null text has no words. An item without words is never found. Repeated item ids count once. Texts of any length are searched whole, repeated rows each give a row; without documents there are no rows, without items no hits.
    """
    held = blocks_of(benchmark, window)
    d = docs.select(F.struct("*").alias("doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache("decontaminate")

        def each_block() -> Iterator[Block]:
            for h in held:
                yield h.value
                if len(held) > 1 and hasattr(h, "_value"):
                    del h._value  # one block in memory at a time

        def flush(part: pa.RecordBatch, docs: list[list[bytes]]) -> pa.RecordBatch:
            found = _shard(docs, each_block())
            spans = pa.array([[{"start": s, "end": e} for s, e in f[0]] for f in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            ids = pa.array([sorted(map(str, f[1])) for f in found], pa.list_(pa.string()))
            keys = ("words", "item_id", "item_start", "doc_start")
            longest = pa.array([dict(zip(keys, (f[2][0], str(f[2][1]), f[2][2], f[2][3]))) if f[2] else None for f in found], pa.struct([("words", pa.int64()), ("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64())]))
            return pa.RecordBatch.from_arrays([part.column("doc"), pa.array([len(x) for x in docs], pa.int64()), spans, ids, longest], ["doc", "n_words", "hit_spans", "item_ids", "longest"])

        for b in batches:
            texts, at, ws, n = b.column("doc").field("text"), 0, [], 0
            for k in range(b.num_rows):
                ws.append(words_of(texts[k].as_py()))
                n += len(ws[-1])
                if n >= SHARD_WORDS:
                    yield flush(b.slice(at, k + 1 - at), ws)
                    at, ws, n = k + 1, [], 0
            if ws:
                yield flush(b.slice(at), ws)

    more = StructType.fromDDL("n_words long, hit_spans array<struct<start:long,end:long>>, item_ids array<string>, longest struct<words:long,item_id:string,item_start:long,doc_start:long>")
    return d.mapInArrow(run, StructType([d.schema["doc"], *more.fields]))


def remove(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs without the rows that hold a window of any item."""
    return with_matches(docs, benchmark, window).where("size(hit_spans) = 0").select("doc.*")


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_words, longest_item, longest_start) of every row of docs; the last three are null without a match."""
    m = with_matches(docs.select("doc_id", "text"), benchmark, window)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return m.select("doc.doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.col("longest.words").alias("longest_words"), F.col("longest.item_id").alias("longest_item"), F.col("longest.doc_start").alias("longest_start"))


#: report()'s rows in DuckDB's SQL, over the tables documents and benchmark. A match is a run of windows on one diagonal.
SQL = r"""
with d as (select row_number() over () as r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda s: s <> '') as w from documents),
b as (select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda s: s <> '') as w from benchmark),
bs as (select row_number() over (order by item_id, array_to_string(w, ' ')) as q, item_id, w, least(10, len(w)) as n from b where len(w) > 0),
bw as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as win from (select *, unnest(range(1, len(w) - n + 2)) as i from bs)),
dw as (select r, i, n, array_to_string(w[i:i + n - 1], ' ') as win from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from bs) where len(w) >= n)),
h as (select r, i, n, item_id from dw join bw using (n, win)),
p as (select r, count(distinct i + k) as n_hit from h, (select unnest(range(10)) as k) where k < n group by r),
x as (select r, q, item_id, n, i, j, i - row_number() over (partition by r, q, i - j order by i) as g from dw join (select q, item_id, n, i as j, array_to_string(w[i:i + n - 1], ' ') as win from (select *, unnest(range(1, len(w) - n + 2)) as i from bs)) using (n, win)),
l as (select r, item_id::varchar as longest_item, count(*) + n - 1 as longest_words, min(i) - 1 as longest_start from x group by r, q, item_id, n, i - j, g qualify row_number() over (partition by r order by count(*) + n desc, q, min(j), min(i)) = 1),
t as (select r, count(*) as n_items, sha256(string_agg(item_id::varchar, ',' order by item_id::varchar)) as s from (select distinct r, item_id from h) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, coalesce(s, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, longest_words::bigint as longest_words, longest_item, longest_start::bigint as longest_start
from d left join p using (r) left join t using (r) left join l using (r)"""
