"""Quality rules as a short-circuit cascade.

A text is kept if no rule rejects it. On a bounded sample each rule's rejections and cost are estimated, and rules run in the order of rejection per cost, each only on what the ones before let through: the next rule is the one that rejects most of what is left for what it costs beside what earlier rules have measured already. The order changes what a verdict costs, never the verdict.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from harrow.llm.shared import cache

#: Rows of each task that make the sample on which costs and selectivities are estimated: its first ones, so no task reads on.
SAMPLE_ROWS = 64
_WORD = re.compile(r"[^ \t-\r]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


class Text:
    """A text's measures; each is made when first asked for."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return _WORD.findall(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return len(_SYMBOL.findall(self.text))

    @cached_property
    def n_upper(self) -> int:
        return len(_UPPER.findall(self.text))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if _WORD.search(x)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        if len(w) < 6:
            return 0
        windows = list(zip(w, w[1:], w[2:], w[3:], w[4:]))
        if len(set(windows)) == len(windows):
            return 0
        n = Counter(windows)
        total, covered = 0, 0  # words before `covered` are counted
        for k, x in enumerate(windows):
            if n[x] > 1:
                total += k + 5 - max(k, covered)
                covered = k + 5
        return total


#: Name and what rejects. Texts of fewer than 10 words and those of repeated windows come first by contract, not by order.
RULES: list[tuple[str, Callable[[Text], bool]]] = [
    ("few_words", lambda t: t.n_words < 10),
    ("repeated_windows", lambda t: 100 * t.n_repeat_words > 20 * t.n_words),
    ("symbols", lambda t: 100 * t.n_symbols > 25 * t.n_words),
    ("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words),
    ("duplicate_lines", lambda t: len(t.lines) >= 4 and 100 * t.n_dup_lines > 50 * len(t.lines)),
    ("capitals", lambda t: 100 * t.n_upper > 50 * t.word_chars),
]
BASE = ("few_words", "repeated_windows")


def rejected_by(text: str | None, order: list[str]) -> str | None:
    """The first rule in this order that rejects the text."""
    rules, t = dict(RULES), Text(text)
    return next((name for name in order if rules[name](t)), None)


def profile(docs: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[dict[int, int], dict[str, float], dict[str, bool], float]:
    """What order_of() needs, from a sample of the first `rows` rows of each task: how many texts each set of rules (as bits) rejects, each rule's seconds a text once its words are there, whether it needs the words, and the seconds of making them.

    The sample is measured where its rows are read, and a task stops after them, so this is no second scan; a task hands on a row for each set of rules that it met, so at most 2 ** len(RULES) from each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache("quality")
        met, spent, needs, words, left = Counter(), [0.0] * len(RULES), 0, 0.0, rows
        for b in batches:
            some = b.column("text").slice(0, left).to_pylist()
            left -= len(some)
            for text in some:
                which, split = 0, Text(text)
                began = time.perf_counter()
                split.words
                words += time.perf_counter() - began
                for k, (_, rule) in enumerate(RULES):
                    t, bare = Text(text), Text(text)
                    t.words
                    began = time.perf_counter()
                    which |= rule(t) << k
                    spent[k] += time.perf_counter() - began
                    if not needs >> k & 1:
                        rule(bare)
                        needs |= ("words" in bare.__dict__) << k
                met[which] += 1
            if not left:
                break
        out = [(w, n, None, None) for w, n in met.items()] + [(None, None, k, s) for k, s in enumerate([*spent, words])] + [(None, needs, -1, 0.0)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["which", "n", "rule", "seconds"])

    made = docs.select("text").mapInArrow(run, "which long, n long, rule long, seconds double")
    made = made.groupBy("which", "rule").agg(F.when(F.col("rule") == -1, F.bit_or("n")).otherwise(F.sum("n")).alias("n"), F.sum("seconds").alias("seconds")).collect()
    sample = {r["which"]: r["n"] for r in made if r["which"] is not None}
    total = max(1, sum(sample.values()))
    spent = {r["rule"]: r["seconds"] / total for r in made if r["rule"] is not None}
    needs = next((r["n"] for r in made if r["rule"] == -1), 0) or 0
    return sample, {name: spent.get(k, 0.0) for k, (name, _) in enumerate(RULES)}, {name: bool(needs >> k & 1) for k, (name, _) in enumerate(RULES)}, spent.get(len(RULES), 0.0)


def order_of(sample: dict[int, int], cost: dict[str, float], needs: dict[str, bool], words: float) -> list[str]:
    """The rules by what they reject, of what those before let through, for what they cost; the words are paid for once. Ties, and rules that the sample does not show, stay in the order of RULES."""
    left, out, split = dict(sample), [], False
    names = [n for n, _ in RULES]
    while len(out) < len(names):

        def worth(name: str) -> float:
            rejects = sum(n for which, n in left.items() if which >> names.index(name) & 1)
            return rejects / max(1e-9, cost.get(name, 0.0) + (words if needs.get(name) and not split else 0.0))

        best = max((n for n in names if n not in out), key=worth)
        out.append(best)
        split |= needs.get(best, False)
        left = {which: n for which, n in left.items() if not which >> names.index(best) & 1}
    return out


def with_verdict(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Every row of docs as (doc, kept, rule): doc is the whole row, so its columns' names can't clash; rule is the first that rejected it, else null. A null or empty text has no words and is rejected. Texts of any length are judged whole, repeated rows each alike; an empty table gives no rows."""
    order = order or order_of(*profile(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache("quality")
        for b in batches:
            texts = b.column("doc").field("text")
            why = [rejected_by(x.as_py(), order) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array([w is None for w in why]), pa.array(why, pa.string())], ["doc", "kept", "rule"])

    d = docs.select(F.struct("*").alias("doc"))
    return d.mapInArrow(run, StructType([d.schema["doc"], *StructType.fromDDL("kept boolean, rule string").fields]))


def keep(docs: DataFrame) -> DataFrame:
    """docs without the rows that a rule rejects."""
    return with_verdict(docs).where("kept").select("doc.*")


def measures(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, the measures, base_failed, kept and rule. The measures are wanted of every text; of those that the base rules let through, the cascade of the other rules decides, which stops at the first that rejects. Which rule that is hangs on the sample's times; whether one does, does not. Nulls and other cases as in with_verdict()."""
    order = [n for n in order or order_of(*profile(docs)) if n not in BASE]
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache("quality")
        rules = dict(RULES)
        for b in batches:
            rows: list[tuple] = []
            for x in b.column("text"):
                t = Text(x.as_py())
                why = next((n for n in BASE if rules[n](t)), None)
                failed = why is not None
                why = why or next((n for n in order if rules[n](t)), None)
                rows.append((*(getattr(t, f) for f in fields), failed, why is None, why))
            columns = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", *fields, "base_failed", "kept", "rule"])

    d = docs.select("doc_id", "text")
    return d.mapInArrow(run, StructType([d.schema["doc_id"], *StructType.fromDDL(", ".join(f"{f} long" for f in fields) + ", base_failed boolean, kept boolean, rule string").fields]))


#: The measures and verdicts in DuckDB's SQL, over the table documents.
SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from d),
l as (select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from (select r, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
x as (select r, i, w[i:i + 4] as win from (select r, w, unnest(range(1, len(w) - 3)) as i from w where len(w) > 4)),
m as (select r, i from (select r, i, count(*) over (partition by r, win) as n from x) where n > 1),
p as (select r, count(distinct i + k) as n_repeat_words from m, (select unnest(range(5)) as k) group by r),
a as (select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda s: length(s))), 0)::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
  coalesce(n_repeat_words, 0)::bigint as n_repeat_words, length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) as n_upper, coalesce(n_lines, 0) as n_lines from w left join l using (r) left join p using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or 100 * n_symbols > 25 * n_words or word_chars < 2 * n_words or word_chars > 15 * n_words or (n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines) or 100 * n_upper > 50 * word_chars) as kept
from a"""
