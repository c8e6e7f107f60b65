from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[1])]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(n)]
    return "\n".join(" ".join(words[k : k + 12]) for k in range(0, n, 12))


def texts() -> list[tuple]:
    """Nulls, empty and long texts, copies, near copies, repeated rows, ties and odd characters."""
    base = prose(1, 200)
    near = base.split(" ")
    near[50] = "changed"
    rows = [(0, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, "  \n \n"), (6, "one"), (7, "one two"), (8, "One TWO"), (9, prose(2, 30_000)), (10, "x" * 60_000), (11, "é ü ▁a  b \n\n c <s> <|endoftext|> 日本語. ..."), (12, base), (12, base), (None, prose(3, 40)), (None, None), (13, "\t\n tab\tand  two  spaces "), (14, "1.2.3.4 a@b.co +1 (555) 010-9999 4111 1111 1111 1111"), (15, "Released under the MIT Licence!\nCopyright (c) 2020 X\nfoo"), (16, "a b c d e f " * 40)]
    rows += [(100 + k, f"job has ended {prose(50 + k, 1)} after {k} ms on host {prose(90 + k, 1)} with code zero\n{prose(200 + k, 40)}") for k in range(12)]
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(texts(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Columns whose names operators use for themselves."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(1).alias(c) for c in ("doc", "n_words", "kept", "rule", "h1", "leaf", "class", "_n", "_id", "gone", "item_ids", "component_id", "part", "length")])
