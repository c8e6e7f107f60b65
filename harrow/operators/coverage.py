"""Line coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.exprs import rounded


def parse_line(line: Column) -> Column:
    """S13: 'count: line: source' as a struct; null where it is no such line. Put it through inline() of an array of it, so that it is made once and not for each of its fields."""
    made = F.transform(F.array(F.split(line, ":", 3)), lambda p: F.when((F.size(p) == 3) & p[0].rlike(r"^\s*[^:\s]+$") & p[1].rlike(r"^\s*[0-9]+$"), F.struct(F.ltrim(p[0]).alias("count_text"), F.ltrim(p[1]).try_cast("int").alias("line_no"), p[2].alias("source"))))
    return F.get(made, 0)


def state(count_text: Column, lax: bool = False) -> Column:
    """'covered', 'missed' or null (not executable). What is no number is missed, or not executable if lax."""
    digits = F.regexp_extract(count_text, r"^([0-9]+)\*?$", 1)
    other = F.lit(None).cast("string") if lax else F.lit("missed")
    return F.when(count_text == "-", None).when(count_text.isin("#####", "====="), "missed").when(digits != "", F.when(digits.rlike("[1-9]"), "covered").otherwise("missed")).otherwise(other)


#: Lines of a block by which lines meet ranges.
BLOCK = 256


def _meet(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """Lines with the ranges that hold them. They meet by file and block of lines, so a long file doesn't give every line with every range; a line is in one block and a range once in each of its blocks, so no pair comes twice."""
    block = lambda c: F.floor(c / BLOCK)
    r = ranges.where("start_line <= end_line").withColumn("_b", F.explode(F.sequence(block(F.col("start_line")), block(F.col("end_line")))))
    return lines.withColumn("_b", block(F.col("line_no"))).join(r, ["file", "_b"]).where(F.col("line_no").between(F.col("start_line"), F.col("end_line"))).drop("_b")


def in_ranges(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """Lines with the functions whose range holds them."""
    return _meet(lines, ranges)


def summarise(lines: DataFrame, keys: list[str], when_none: float = 0.0, lax: bool = False) -> DataFrame:
    """Covered and executable lines and the percentage, `when_none` where nothing is executable; the missed lines too."""
    s = state(F.col("count_text"), lax)
    d = lines.withColumn("_s", s).groupBy(*keys).agg(F.count_if(F.col("_s") == "covered").alias("covered"), F.count("_s").alias("executable"), F.array_sort(F.collect_list(F.when(F.col("_s") == "missed", F.col("line_no")))).alias("missed"))
    pct = F.when(F.col("executable") == 0, when_none).otherwise(rounded(100.0 * F.col("covered") / F.col("executable"), 2))
    return d.select(*keys, "covered", "executable", pct.alias("coverage_pct"), "missed")


def first_number(*parts: Column) -> Column:
    """The first that is a number."""
    return F.coalesce(*[p.try_cast("double") for p in parts])


def first_present(*parts: Column) -> Column:
    """The first that is present, as a number; not the next one if it is none."""
    return F.coalesce(*parts).try_cast("double")


def integration_gate(master: Column, unit: Column, threshold: float) -> Column:
    """P14."""
    t = F.lit(threshold)
    return F.when(master.isNull(), False).when(unit.isNull(), master >= t).otherwise(master >= F.greatest(t, unit - 5))


def judged(pct: Column, verdict: Column, threshold: float) -> Column:
    """struct(covered, accepted, reason)."""
    low = F.coalesce(pct < threshold, F.lit(True))
    reason = F.when(pct.isNull(), "no coverage").when(pct < threshold, "below threshold").when(verdict, "accepted").otherwise("rejected by judge")
    return F.struct((~low).alias("covered"), (~low & F.coalesce(verdict, F.lit(False))).alias("accepted"), reason.alias("reason"))


def enclosing(hits: DataFrame, functions: DataFrame) -> DataFrame:
    """Hits (id, file, line_no) with the first enclosing function in preorder, else 'Global Scope'."""
    m = _meet(hits, functions).groupBy("id").agg(F.min_by("name", F.struct("start_line", "name")).alias("name"))
    return hits.join(m, "id", "left").select(*hits.columns, F.coalesce("name", F.lit("Global Scope")).alias("scope"))


def stage_ratio(episodes: DataFrame, stage: str, ok: str) -> DataFrame:
    """Ok, all, their ratio, and whether all passed (never for an empty stage)."""
    return episodes.groupBy(stage).agg(F.count_if(F.col(ok)).alias("n_ok"), F.count("*").alias("n"), F.coalesce(F.bool_and(ok), F.lit(False)).alias("all_ok")).withColumn("ratio", rounded(F.col("n_ok") / F.col("n"), 4))


def snippet(lines: DataFrame, hits: DataFrame, around: int = 10) -> DataFrame:
    """The lines around each hit, blank ones left out, joined in order. Only a window's neighbours meet: lines are explicit rows, found by file and a block of lines."""
    size = 2 * around + 1
    block = lambda c: F.floor(c / size)
    near = hits.select("id", "file", F.col("line_no").alias("at")).withColumn("_b", F.explode(F.sequence(block(F.greatest(F.col("at") - around, F.lit(0))), block(F.col("at") + around))))
    d = lines.withColumn("_b", block(F.col("line_no"))).join(near, ["file", "_b"]).where(F.col("line_no").between(F.col("at") - around, F.col("at") + around) & (F.trim("source") != ""))
    return d.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "source"))), lambda x: x["source"]), "\n").alias("snippet"))
