"""Personal data, by patterns and by what gives it away.

Base spans are e-mail addresses, IP and card and phone numbers. Information-theoretic sanitisation adds terms: an entity (a base span's value) is protected, and a term near it discloses it as far as their pointwise mutual information reaches the entity's information content. Terms of a ratio of at least `alpha` are spans too. sanitise() generalises entities and terms to their category in the text, or removes the terms; find() gives the same spans without the texts.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from harrow.llm.shared import stash

KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # a match begins where its digits begin, so none is tried inside them
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9]([ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"\w[\w'-]*")
#: Different words that a task counts before it hands its counts on.
COUNTED = 300_000
#: Bits of the bitmap of telling terms, a power of two: 1 MB.
SLOTS = 1 << 23


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    if "@" not in text:
        return []
    out = []
    for run in _RUN.finditer(text):  # a match lies in one run of the characters that it may hold
        if "@" in run[0]:
            out += [(m.start() + run.start(), m.end() + run.start()) for m in _EMAIL.finditer(run[0])] if run.end() - run.start() < 400 else _long_emails(text, run.start(), run.end())
    return out


def _long_emails(text: str, at: int, end: int) -> list[tuple[int, int]]:
    """The same over a long run, in linear time: the pattern is tried once for each piece before an @."""
    out, local = [], re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    start = at
    for sign in re.compile("@").finditer(text, at, end):
        if sign.start() < start:
            continue
        if sign.start() > start and (m := local.match(text, sign.start(), end)):
            out.append((start, m.end()))
            start = m.end()
        else:
            start = sign.end()
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """{kind: [(start, end)]} in code points, leftmost and not overlapping within a kind."""
    found = {"email": _emails(text), "ip": [], "card": [], "phone": []}
    if _DIGITS.search(text):
        if "." in text:
            found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15]
    return found


def spelled(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def near(text: str, start: int, end: int, width: int) -> Iterator[tuple[str, int, int]]:
    """The `width` words before and after a span, lower-cased, with their places, however far they are."""
    reach, before = width * 65, []
    while True:
        at = max(0, start - reach)
        before = list(_WORD.finditer(text, at, start))
        if at == 0:
            break
        if len(before) > width:  # the first may be cut off
            break
        reach *= 2
    for m in (*before[-width:], *islice(_WORD.finditer(text, end), width)):
        yield m[0].lower(), m.start(), m.end()


def clear_of(covered: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a word lies apart from all base spans, which are sorted."""
    i = bisect_left(covered, (end, 0))
    return not any(start < y for _, y in covered[max(0, i - len(KINDS)) : i])


def scan(docs: DataFrame, width: int = 10) -> DataFrame:
    """Rows of two kinds in one pass over the texts: 'doc' (a document's base spans) and 'near' (a term near an entity, its place and the digest of the words around)."""
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    shape = StructType([d.schema["doc_id"], *StructType.fromDDL("th long, what string, entity string, term string, start long, end long, around string, n_email long, n_ip long, n_card long, n_phone long, base string").fields])
    kinds = [pa.string()] * 3 + [pa.int64()] * 2 + [pa.string()] + [pa.int64()] * 4 + [pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, rows, take = b.slice(at, 256), [], []
                for k, text in enumerate(part.column("text").to_pylist()):
                    text = text or ""
                    found = base_spans(text)
                    spans = [(kind, s, e) for kind in KINDS for s, e in found[kind]]
                    rows.append(("doc", None, None, None, None, None, *(len(found[kind]) for kind in KINDS), spelled(spans)))
                    take.append(k)
                    covered = sorted((s, e) for _, s, e in spans)
                    for kind, s, e in spans:
                        close = list(near(text, s, e, width))
                        around = hashlib.md5(" ".join(w for w, _, _ in close).encode(), usedforsecurity=False).hexdigest()
                        for w, ws, we in close:
                            if clear_of(covered, ws, we):
                                rows.append(("near", f"{kind}:{text[s:e].lower()}", w, ws, we, around, *[None] * 5))
                                take.append(k)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(take, pa.int64())) for c in ("doc_id", "th")), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], shape.names)

    return d.mapInArrow(run, shape)


def word_documents(docs: DataFrame) -> DataFrame:
    """(term, n_term): how many documents hold a word. A task hands its counts on whenever it holds COUNTED different words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])
            counts.clear()
            return out

        for b in batches:
            for text in b.column("text"):
                counts.update({w.lower() for w in set(_WORD.findall(text.as_py() or ""))})
                if len(counts) > COUNTED:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, th, terms): every place of the terms in the whole texts that lies apart from base spans, sorted; th is the text's hash. Only of documents with such a place.

    A bitmap of the terms' checksums goes to the tasks, of one size whatever the number of terms is; it loses no term, and what it lets through besides is turned away by an exact join.
    """
    slot = F.crc32(F.col("term").cast("binary")).bitwiseAND(F.lit(SLOTS - 1))
    words = terms.select(slot.alias("s")).groupBy(F.shiftright("s", 3).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1, cast(s & 7 as int)))").alias("bits"))
    bitmap = bytearray(SLOTS // 8)
    for r in words.toLocalIterator():
        bitmap[r["w"]] = r["bits"]
    held = docs.sparkSession.sparkContext.broadcast(bytes(bitmap))
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    places = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    shape = StructType([d.schema["doc_id"], *StructType.fromDDL("th long, term string, places array<struct<start:long,end:long>>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, may = held.value, {}  # word as it stands -> the term that it may be, or None

        def term_of(word: str) -> str | None:
            w = word.lower()
            s = zlib.crc32(w.encode()) & (SLOTS - 1)
            return w if bits[s >> 3] >> (s & 7) & 1 else None

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, take, found_terms, found_places = b.slice(at, 256), [], [], []
                for k, text in enumerate(part.column("text").to_pylist()):
                    every = set(_WORD.findall(text or ""))
                    if len(may) + len(every) > COUNTED:
                        may.clear()
                    for w in [w for w in every if w not in may]:
                        may[w] = term_of(w)
                    if not any(map(may.__getitem__, every)):
                        continue
                    covered, own = sorted(x for spans in base_spans(text).values() for x in spans), defaultdict(list)
                    for m in _WORD.finditer(text):
                        if (t := may[m[0]]) and clear_of(covered, m.start(), m.end()):
                            own[t].append({"start": m.start(), "end": m.end()})
                    take += [k] * len(own)
                    found_terms += own
                    found_places += own.values()
                which = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(which), part.column("th").take(which), pa.array(found_terms, pa.string()), pa.array(found_places, places)], shape.names)

    hits = d.mapInArrow(run, shape).join(terms, "term", "left_semi")
    return hits.groupBy("doc_id", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("terms"))


def marked(docs: DataFrame, alpha: float = 0.9, support: int = 3, width: int = 10) -> tuple[DataFrame, DataFrame]:
    """Rows of docs with their base spans (doc_id, th, n_email, n_ip, n_card, n_phone, base), and the places of telling terms (doc_id, th, terms).

    With p as shares of all documents, a term t within `width` words of entity e discloses it if log2(p(t, e) / (p(t) p(e))) >= alpha * -log2 p(e). Where e stands in `support` different surroundings or more, as many must show both, so copies of one document prove nothing; where it stands in fewer, the ratio alone decides. A telling term is marked wherever it stands, with its entity or without. Terms are words of any length, digits among them.
    """
    made = stash(scan(docs, width), "pii")
    rows, seen = made.where("what = 'doc'"), made.where("what = 'near'")
    total = rows.count()
    entities = seen.groupBy("entity").agg(F.count_distinct(F.xxhash64("doc_id")).alias("n_entity"), F.count_distinct("around").alias("n_around"))
    pairs = seen.groupBy("entity", "term").agg(F.count_distinct("around").alias("shown"), F.count_distinct(F.xxhash64("doc_id")).alias("n_both"))
    pairs = pairs.join(entities, "entity").where((F.col("shown") >= support) | (F.col("n_around") < support))
    ratio = F.log2(F.col("n_both") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity"))) / F.log2(F.lit(float(total)) / F.col("n_entity"))
    told = pairs.join(word_documents(docs), "term").where((F.col("n_entity") < total) & (ratio >= alpha))
    told = stash(told.select("term").distinct(), "told")
    return rows.drop("what", "entity", "term", "start", "end", "around"), occurrences(docs, told)


def find(docs: DataFrame, alpha: float = 0.9, support: int = 3, width: int = 10) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of docs; spans are the base ones by kind and start, then those of telling terms (marked()) by start. A null text is empty; texts of any length are searched whole. Repeated rows each give a row and prove no more than one; an empty table gives no rows; other columns are not read."""
    rows, terms = marked(docs, alpha, support, width)
    text = F.concat_ws(",", F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["end"].cast("string"))))
    spans = terms.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), text.alias("terms"))
    out = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    whole = F.concat_ws(",", F.nullif("base", F.lit("")), "terms")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), whole.alias("spans"))


def redact(text: str, terms: list[tuple[int, int]], remove: bool = False) -> str:
    """text with base spans as labels of their category and terms as [TERM], or removed. Spans that overlap are one, by the label of the first."""
    spans = sorted([(s, -e, f"[{kind.upper()}]") for kind, found in base_spans(text).items() for s, e in found] + [(s, -e, "" if remove else "[TERM]") for s, e in terms])
    out, at = [], 0
    for s, e, label in spans:
        if s >= at:
            out += [text[at:s], label]
        at = max(at, -e)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, alpha: float = 0.9, support: int = 3, width: int = 10, remove: bool = False) -> DataFrame:
    """docs with every span that find() gives generalised to its category in the text, and the same columns. remove: terms are removed instead. A null text stays null."""
    cols = docs.columns
    _, terms = marked(docs, alpha, support, width)
    spans = terms.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("terms").alias("_terms"))
    d = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_t"))
    d = d.join(spans, F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_th")), "left").select("doc", "_terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, terms = b.column("doc").field("text").to_pylist(), b.column("_terms").to_pylist()
            clean = [t if t is None else redact(t, [(x["start"], x["end"]) for x in own or ()], remove) for t, own in zip(texts, terms)]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(clean, pa.string())], ["doc", "clean"])

    out = d.mapInArrow(run, StructType([d.schema["doc"], *StructType.fromDDL("clean string").fields]))
    return out.select(*[F.col("clean").alias("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in cols])
