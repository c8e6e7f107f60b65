"""Line dedup by a log-template tree, in DataFrame operations only.

A line goes down a tree of fixed depth: by its number of tokens, then by its leading tokens (one that holds a digit is a field). In a leaf, lines become templates. A run of digits is a field, in lines most of whose tokens hold none; other lines must be equal. Where a leaf holds many different lines, a position's token that few of them share is a field as well: few by number, and in a second reading few by their share of the leaf, so that a field with many values stays one however often each of them occurs. Lines that then look alike are one template, if most of it is fixed. A template that recurs across documents is dropped from all of them but the one of the smallest doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.shared import discard, flagged, maybe_in, stash

#: Leading tokens of the tree; different lines that make a field, the share of a leaf's lines below which a token is none of its fixed ones, and the fixed share of a template.
LEADING, VARIANTS, SHARE, FIXED = 3, 8, 0.05, 0.8
FIELD = "<*>"


def _lines(docs: DataFrame) -> DataFrame:
    """Every line as (doc_id, th, pos, line): its tokens parted by single spaces, every run of digits as one field sign 0 if enough of its tokens hold no digit."""
    text = F.regexp_replace("text", r"[ \t\r\f\x0B]{2,}|[\t\r\f\x0B]", " ")
    d = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    masked = F.regexp_replace("line", "[0-9]+", "0")
    fields, n = F.regexp_count(masked, F.lit("0[^ ]*")), _spaces(F.col("line")) + 1
    return d.select("doc_id", "th", "pos", F.when(F.col("line").rlike("[0-9]") & (n - fields >= FIXED * n), masked).otherwise(F.col("line")).alias("line"))


def _spaces(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))


def _leaf(line: Column) -> Column:
    """The number of tokens, and the leading tokens with those that hold a digit as a field. A token is looked at once, at its start."""
    lead = F.regexp_replace(F.substring_index(line, " ", LEADING), "(?<![^ ])[^ ]*[0-9][^ ]*", FIELD)
    return F.xxhash64(_spaces(line), lead)


def _key(line: Column) -> list[Column]:
    """128 bits that stand for a line: two hashes of different seeds."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def verdicts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, dropped): every line by (doc_id, th, pos) with its key, and the keys of recurring templates with the document (none, doc_id, th) that keeps them."""
    keys = _lines(docs).withColumn("full", F.nullif("line", F.lit("")))
    keys = keys.select("doc_id", "th", "pos", *[F.when(F.col("full").isNotNull(), k).alias(n) for k, n in zip((*_key(F.col("full")), _leaf(F.col("full"))), ("h1", "h2", "leaf"))])
    lines = stash(keys, "lines")
    doc = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    same = lines.where("leaf is not null").groupBy("h1", "h2").agg(F.first("leaf").alias("leaf"), F.min(doc).alias("lo"), F.max(doc).alias("hi"))
    same = stash(same, "same")
    exact = same.where("lo <> hi").select("h1", "h2", F.col("lo").alias("keeper"))
    # leaves with enough different lines for a field
    leaves = stash(same.groupBy("leaf").agg(F.count("*").alias("n_lines")).where(F.col("n_lines") >= VARIANTS), "leaves")
    few = _lines(docs).where("line <> ''").withColumn("leaf", _leaf(F.col("line")))
    few = maybe_in(few, F.col("leaf"), leaves, F.col("leaf")).join(leaves.select("leaf"), "leaf", "left_semi")
    few = few.select("leaf", *_key(F.col("line")), "line", doc.alias("doc")).groupBy("leaf", "h1", "h2").agg(F.first("line").alias("line"), F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    few = stash(few, "variants")
    at = few.select("leaf", "h1", "h2", F.posexplode(F.split("line", " ")).alias("pos", "token"))
    counted = at.groupBy("leaf", "pos", "token").agg(F.count("*").alias("n")).where(F.col("n") >= VARIANTS).join(leaves, "leaf")
    # tables of their own, so that the joins with them can split a leaf of very many lines
    shared = stash(counted.select("leaf", "pos", "token", (F.col("n") >= SHARE * F.col("n_lines")).alias("often")), "shared")
    d = at.join(shared, ["leaf", "pos", "token"], "left")
    form = lambda fixed: F.array_sort(F.collect_list(F.struct("pos", F.when(fixed, F.col("token")).otherwise(F.lit(FIELD)).alias("t"))))
    by_number, by_share = F.col("often").isNotNull(), F.coalesce("often", F.lit(False))
    forms = d.groupBy("leaf", "h1", "h2").agg(F.array(F.struct(form(by_number).alias("form"), F.count_if(by_number).alias("n_fixed")), F.struct(form(by_share).alias("form"), F.count_if(by_share).alias("n_fixed"))).alias("both"), F.count("*").alias("n"))
    forms = forms.select("leaf", "h1", "h2", "n", F.explode(F.array_distinct("both")).alias("f"))
    forms = forms.where((F.col("f.n_fixed") < F.col("n")) & (F.col("f.n_fixed") >= FIXED * F.col("n"))).select("leaf", "h1", "h2", F.xxhash64("f.form").alias("f1"), F.xxhash64(F.lit(1), "f.form", "n").alias("f2"))
    forms = stash(forms.join(few.select("leaf", "h1", "h2", "lo", "hi"), ["leaf", "h1", "h2"]), "forms")
    wide = forms.groupBy("leaf", "f1", "f2").agg(F.count("*").alias("n"), F.min("lo").alias("keeper"), F.max("hi").alias("last")).where((F.col("n") >= VARIANTS) & (F.col("keeper") != F.col("last")))
    wide = stash(wide.select("leaf", "f1", "f2", "keeper"), "wide")
    general = forms.join(wide, ["leaf", "f1", "f2"]).select("h1", "h2", "keeper")
    # as a table of its own, so that the join of lines with it can split a line that is very common
    both = stash(exact.union(general).groupBy("h1", "h2").agg(F.min("keeper").alias("keeper")), "recurring")
    discard(same, leaves, few, shared, forms, wide)
    return lines, both


def drop_lines(docs: DataFrame) -> DataFrame:
    """Every row of docs as (doc, n_lines, n_dropped, kept_text): doc is the whole row, so its columns' names can't clash.

    kept_text is the text without the dropped lines; null stays null, and a text of dropped lines only becomes empty. Lines without tokens are never dropped. Lines that repeat within one document stay, and so do those of rows that repeat the keeping document's doc_id and text. Lines and texts of any length are taken whole; an empty table gives no rows. Only documents that may lose a line are shuffled.
    """
    lines, dropped = verdicts(docs)
    doc = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    marked = lines.where("h1 is not null").join(dropped, ["h1", "h2"]).where(doc != F.col("keeper")).select("doc_id", "th", "pos")
    touched = marked.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    # a flag for each line up to the last one that goes, so that a line's verdict is looked up by its place
    flags = F.expr("flatten(transform(gone, (p, i) -> concat(array_repeat(false, p - if(i = 0, 0, gone[i - 1] + 1)), array(true))))")
    touched = stash(touched.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.size("gone").alias("_n"), flags.alias("_flags")), "gone")
    d = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_t"))
    discard(lines, dropped)
    d = flagged(d, F.struct("_d", "_t"), touched, F.struct("_id", "_th"), "_may")
    hit = d.where("_may").join(touched, F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_th")), "left").select("doc", "_n", "_flags")
    d = hit.union(d.where("not _may").select("doc", F.lit(None).cast("int").alias("_n"), F.lit(None).cast("array<boolean>").alias("_flags")))
    text = F.col("doc.text")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.coalesce(F.get("_flags", i), F.lit(False))), "\n")
    n = F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.split(text, "\n"))).cast("long")
    return d.select("doc", n.alias("n_lines"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("_n").isNull(), text).otherwise(kept).alias("kept_text"))


def dedup(docs: DataFrame) -> DataFrame:
    """docs with kept_text for text, and the same columns."""
    cols = docs.columns
    return drop_lines(docs).select(*[F.col("kept_text").alias("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in cols])


#: drop_lines()'s rows in DuckDB's SQL, over the table documents, whose doc_ids differ.
SQL = rf"""
with d as (select doc_id, text, string_split(text, chr(10)) as raw, string_split(regexp_replace(text, '[ \t\r\f\x0B]{{2,}}|[\t\r\f\x0B]', ' ', 'g'), chr(10)) as even from documents),
p as (select doc_id, pos, raw[pos] as raw, trim(even[pos], ' ') as line from (select *, unnest(range(1, len(raw) + 1)) as pos from d)),
l as (select doc_id, pos, raw, case when len(list_filter(string_split(line, ' '), lambda t: not regexp_matches(t, '[0-9]'))) >= {FIXED} * len(string_split(line, ' ')) then regexp_replace(line, '[0-9]+', '0', 'g') else line end as line from p),
k as (select *, string_split(line, ' ') as tok from l where line <> ''),
f as (select doc_id, pos, line, len(tok) || ' ' || array_to_string(list_transform(tok[1:{LEADING}], lambda t: case when regexp_matches(t, '[0-9]') then '{FIELD}' else t end), ' ') as leaf, tok from k),
same as (select line, any_value(leaf) as leaf, any_value(tok) as tok, min(doc_id) as lo, max(doc_id) as hi from f group by line),
leaves as (select leaf, count(*) as n_lines from same group by leaf having count(*) >= {VARIANTS}),
t as (select line, leaf, lo, hi, tok[pos] as token, pos from (select *, unnest(range(1, len(tok) + 1)) as pos from same where leaf in (select leaf from leaves))),
shared as (select leaf, pos, token, c >= {SHARE} * n_lines as often from (select leaf, pos, token, count(*) as c from t group by all having count(*) >= {VARIANTS}) join leaves using (leaf)),
j as (select t.*, s.often from t left join shared s on s.leaf = t.leaf and s.pos = t.pos and s.token = t.token),
form as (select leaf, line, lo, hi, string_agg(case when often is null then '{FIELD}' else token end, ' ' order by pos) as form, count(often) as fixed, count(*) as n from j group by 1, 2, 3, 4
  union select leaf, line, lo, hi, string_agg(case when often then token else '{FIELD}' end, ' ' order by pos), count(*) filter (often), count(*) from j group by 1, 2, 3, 4),
part as (select * from form where fixed < n and fixed >= {FIXED} * n),
wide as (select leaf, form, min(lo) as keeper from part group by 1, 2 having count(*) >= {VARIANTS} and min(lo) <> max(hi)),
keep as (select line, min(keeper) as keeper from (select line, lo as keeper from same where lo <> hi union all select line, keeper from part join wide using (leaf, form)) group by 1),
gone as (select doc_id, pos from f join keep using (line) where doc_id <> keeper),
left_over as (select doc_id, string_agg(raw, chr(10) order by pos) as kept from l where not exists (select 1 from gone g where g.doc_id = l.doc_id and g.pos = l.pos) group by 1)
select d.doc_id, coalesce(len(d.raw), 0)::bigint as n_lines, coalesce(c.n, 0)::bigint as n_dropped, case when d.text is not null then coalesce(o.kept, '') end as kept_text
from d left join left_over o using (doc_id) left join (select doc_id, count(*) as n from gone group by 1) c using (doc_id)"""
