"""Token counts: whole-token shortcut.

Offline, every string of the vocabulary that encodes alone as one token is proven by encoding it. A text is cut into pre-tokens no merge can cross; those that are proven strings count one, and only the rest is merged, each different one once while it stays in the worker's bounded memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.shared import cache

#: Remembered pre-tokens of a worker; when full, it starts again from the proven ones.
MEMORY = 400_000
_SEGMENT = re.compile(r" +[^ ]*|[^ ]+")


def proven(sp) -> dict[str, int]:
    """Pre-tokens (with their leading space, or as at the start of a line) that are one token alone."""
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    spaced = [p for p in pieces if len(p) > 1 and p[0] == "▁" and "▁" not in p[1:]]
    bare = [p for p in pieces if "▁" not in p]
    out = {" " + p[1:]: 1 for p, ids in zip(spaced, sp.encode([p[1:] for p in spaced], num_threads=1)) if len(ids) == 1}
    return out | {p: 1 for p, ids in zip(bare, sp.encode(["\n" + p for p in bare], num_threads=1)) if len(ids) == 3}


def divisible(sp) -> bool:
    """That no vocabulary string crosses a pre-token's ends: none holds a line break, or a space after another character; and that text is taken as it is."""
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return all("\n" not in p and "▁" not in p.lstrip("▁") for p in pieces) and sp.encode(" a  b ", out_type=str) == sp.encode(" a", out_type=str) + sp.encode(" b ", out_type=str) and len(sp.encode("\n")) == 2


def _model(path: str) -> tuple:
    loaded = cache("token_counts")
    if path not in loaded:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        sure = proven(sp)
        loaded[path] = (sp, sure, dict(sure), divisible(sp))
    return loaded[path]


def segments(text: str) -> list[str]:
    """The pre-tokens of a text after its dummy space; line breaks are left out, one token each."""
    lines = (" " + text).split("\n")
    if "  " in text or " \n" in text or text[:1] == " " or text[-1:] == " " or "\n " in text:
        return [s for line in lines for s in _SEGMENT.findall(line)]
    out: list[str] = []
    for k, line in enumerate(lines):
        if line:
            words = line.split(" ")
            if k:
                out.append(words[0])
            out += [" " + w for w in words[1:]]
    return out


def count_tokens(texts: list[str | None], path: str) -> list[int]:
    sp, sure, memory, safe = _model(path)
    cut: list[list[str] | None] = [segments(t) if t and safe and "▁" not in t else None for t in texts]
    missing = {s for c in cut if c is not None for s in c if s not in memory}
    if len(memory) + len(missing) > MEMORY and len(memory) > len(sure):
        memory.clear()
        memory.update(sure)
        missing = {s for c in cut if c is not None for s in c if s not in memory}
    if missing:
        todo = list(missing)
        asked = [("\n" + s) if s[0] != " " else s[1:] for s in todo]
        for s, ids in zip(todo, sp.encode(asked, num_threads=1)):
            memory[s] = len(ids) - 2 if s[0] != " " else max(1, len(ids))
    get = memory.__getitem__
    return [(len(sp.encode(t)) if t else 0) if c is None else sum(map(get, c)) + t.count("\n") for t, c in zip(texts, cut)]


def with_token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs; a null text is empty and counts 0. Texts of any length are counted whole. Other columns are not read; repeated rows each give a row, an empty table none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column("text").to_pylist()
                n = count_tokens(texts, path)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    d = docs.select("doc_id", "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
