"""A document's longest match is its own, whatever documents share its shard."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from harrow.llm import decontaminate
from harrow.llm.decontaminate import Block, _shard


def brute_longest(doc, items, window):
    """(words, item, place in the item, place here); ties to the first item, then its place, then the place here."""
    best = None
    for i, ws in items:
        w = min(window, len(ws))
        for k in range(len(ws)):
            for p in range(len(doc)):
                n = 0
                while k + n < len(ws) and p + n < len(doc) and ws[k + n] == doc[p + n]:
                    n += 1
                if n >= w and n and k + w <= len(ws) and (best is None or n > best[0]):
                    best = n, i, k, p
    return best


def test_two_lengths_in_one_shard(spark):
    item = [f"w{k}" for k in range(40)]
    docs = [(0, "x " + " ".join(item[:30]) + " y"), (1, "a b " + " ".join(item[:15]) + " c"), (2, " ".join(item[20:31])), (3, " ".join(item[:9]))]
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: (r.longest_words, r.longest_item, r.longest_start) for r in decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), items).collect()}
    assert got == {0: (30, "7", 1), 1: (15, "7", 2), 2: (11, "7", 0), 3: (None, None, None)}


@given(st.integers(0, 10**9), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_longest_by_brute_force(seed, window):
    r = random.Random(seed)
    text = lambda n, top: [b"%d" % r.randint(0, top) for _ in range(n)]
    items = [(k, text(r.randint(1, 9), 2)) for k in range(r.randint(1, 3))]
    docs = [text(r.randint(0, 14), 3) for _ in range(r.randint(1, 5))]
    got = [f[2] for f in _shard(docs, iter([Block(items, window)]))]
    assert got == [brute_longest(d, items, window) for d in docs]
