"""Lookups written as joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.udfs import sequence_ratio


def resolve_callee(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """A static function of the same file, else a global one, else external."""
    static = definitions.where("is_static").select(F.col("file_name"), F.col("name").alias("callee"), F.col("unique_id").alias("_s"))
    glob = definitions.where("not is_static").groupBy(F.col("name").alias("callee")).agg(F.max_by("unique_id", "file_name").alias("_g"))
    d = calls.join(static, ["file_name", "callee"], "left").join(glob, "callee", "left")
    return d.withColumn("target", F.coalesce("_s", "_g", "callee")).withColumn("is_external", F.col("_s").isNull() & F.col("_g").isNull()).drop("_s", "_g")


def latest_definition(definitions: DataFrame) -> DataFrame:
    """G1: of a global name the last file wins, static ones stay per file."""
    key = F.when(F.col("is_static"), F.concat(F.lit("["), "file_name", F.lit("]"), "name")).otherwise(F.col("name"))
    return definitions.groupBy(key.alias("unique_id")).agg(F.max_by(F.struct("file_name", "start_line", "end_line"), F.struct("file_name", "start_line")).alias("d")).select("unique_id", "d.*")


def unique_suffix(asked: DataFrame, files: DataFrame) -> DataFrame:
    """The file that a relative source names: of one such basename that one, else the only path that ends so; more are ambiguous. Both sides have a basename, so this is an equi join on it."""
    base = lambda c: F.substring_index(c, "/", -1)
    m = asked.withColumn("_b", base("source")).join(files.withColumn("_b", base("path")), "_b", "left")
    ends = F.coalesce((F.col("path") == F.col("source")) | F.endswith(F.col("path"), F.concat(F.lit("/"), "source")), F.lit(False))
    g = m.groupBy("source").agg(F.count("path").alias("n"), F.count_if(ends).alias("n_ends"), F.max("path").alias("one"), F.max(F.when(ends, F.col("path"))).alias("ending"))
    return g.select("source", F.when(F.col("n") == 1, F.col("one")).when(F.col("n_ends") == 1, F.col("ending")).alias("path"), F.when(F.col("n") == 0, "missing").when((F.col("n") > 1) & (F.col("n_ends") != 1), "ambiguous").otherwise("ok").alias("status"))


def rewrite_prefixes(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Every occurrence of each prefix, the longest first."""
    for a, b in sorted(pairs, key=lambda p: (-len(p[0]), p[0])):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def overlay(entries: DataFrame) -> DataFrame:
    """The paths of stacked layers: the last layer of a path counts; .wh.X in a later layer removes X, .wh..wh..opq what earlier layers have below its folder."""
    name, folder = F.substring_index("path", "/", -1), F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    d = entries.withColumns({"_name": name, "_dir": folder})
    opaque = d.where("_name = '.wh..wh..opq'").groupBy(F.col("_dir").alias("_od")).agg(F.max("layer").alias("_ol"))
    gone = d.where(F.startswith("_name", F.lit(".wh.")) & (F.col("_name") != ".wh..wh..opq")).groupBy(F.concat("_dir", F.expr("substr(_name, 5)")).alias("path")).agg(F.max("layer").alias("_gl"))
    last = d.where(~F.startswith("_name", F.lit(".wh."))).groupBy("path").agg(F.max("layer").alias("layer"), F.max_by("content", "layer").alias("content"))
    parents = F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"), F.lit("/"))))
    hidden = last.select("path", "layer", F.explode(parents).alias("_od")).join(opaque, "_od").where(F.col("layer") < F.col("_ol")).select("path").distinct()
    return last.join(gone, "path", "left").where(F.col("_gl").isNull() | (F.col("layer") >= F.col("_gl"))).drop("_gl").join(hidden, "path", "left_anti")


def unmatched(total: int, least: float) -> int:
    """Of two keys of so many characters together the most that may match nothing."""
    return total - 2 * math.ceil(least * total / 2 - 1e-9)


def _cuts(weights: list[float], m: int) -> list[tuple[int, int]]:
    """(start, length) of m segments, none empty, of about equal weight."""
    total, done, at = sum(weights), 0.0, [0]
    for k, w in enumerate(weights):
        if len(at) < m and k > at[-1] and (done * m >= total * len(at) - 1e-9 or len(weights) - k <= m - len(at)):
            at.append(k)
        done += w
    return [(x, y - x) for x, y in zip(at, [*at[1:], len(weights)])]


def _segments(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(lb, i, start, len, first, next, half, rest): the segments of b's keys of each length that may be like one of a's: one more than the most characters that may be unmatched. Of the segment after each, which after the last is the first again (first), next is the start, half and rest are the lengths of two parts of about equal weight.

    A place of a key weighs what its character tells: no more than one common to all keys, so that every segment is as rare as it can be. Lengths and the weights of places come to the driver, no key does.
    """
    la = [r.n for r in a.select(F.length("key").alias("n")).distinct().collect()]
    chars = F.transform(F.sequence(F.lit(1), F.length("key")), lambda k: F.struct(k.alias("k"), F.substring("key", k, F.lit(1)).alias("c")))
    each = b.where(F.length("key") > 0).select(F.length("key").alias("lb"), F.explode(chars).alias("x")).groupBy("lb", "x.k", "x.c").agg(F.count("*").cast("double").alias("n"))
    weighed = each.groupBy("lb", "k").agg((-F.log2(F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n")))).alias("w"))
    out = []
    for lb, ws in weighed.groupBy("lb").agg(F.array_sort(F.collect_list(F.struct("k", "w"))).alias("w")).collect():
        if near := [unmatched(n + lb, least) for n in la if 2 * min(n, lb) >= least * (n + lb)]:
            weights = [max(w.w, 1e-3) for w in ws]
            cuts = _cuts(weights, max(near) + 1)
            for i, x in enumerate(cuts):
                start, n = cuts[(i + 1) % len(cuts)]
                half = _cuts(weights[start : start + n], 2)[0][1] if n > 1 else 0
                out.append((lb, i, *x, i + 1 == len(cuts), start, half, n - half))
    return a.sparkSession.createDataFrame(out, "lb int, i int, start int, len int, first boolean, next int, half int, rest int")


#: Bits of the names' hashes that are broadcast: 32 MB at most.
BITS = 2**28


def _asked_for(right: DataFrame, left: DataFrame) -> DataFrame:
    """The rows of right whose hash part is, but for chance, one of left's, by bits of these, so the others are not shuffled."""
    k = F.pmod("part", F.lit(BITS))
    bits = left.groupBy(F.bitmap_bucket_number(k).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(k)).alias("_bits"))
    at = F.bitmap_bit_position(k).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("long")
    d = right.withColumn("_bucket", F.bitmap_bucket_number(k)).join(F.broadcast(bits), "_bucket")
    return d.where(F.getbit(byte, at.bitwiseAND(7)) == 1).select(right.columns)


def _meetings(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(a, apart, b): the keys that a join by segments tries, all pairs that are similar among them; apart: the most that may be unmatched.

    Of T characters in both, a pair has at least least * T / 2 in common runs. An unmatched one counts to the segment of b's key that it is in, one of a's key to that of the character that it comes before; there is a segment more than unmatched ones. So going round from some segment, as many segments as one likes hold fewer unmatched ones than they are: that segment is whole in a's key, as far from its place as unmatched characters can move it, and the next holds one at most, so its first part follows at once or its second a character too early or too late. Each document's key is a row for each segment and part of the next, each name's key one for each place where they may be; they meet by hashes of both.
    """
    parts = F.broadcast(_segments(a, b, least))
    met_by = lambda kind, key, at, then, n: F.xxhash64("lb", "i", F.lit(kind), F.substring(key, at + 1, F.col("len")), F.substring(key, then + 1, F.col(n)))
    second = F.col("next") + F.col("half")
    right = b.withColumn("lb", F.length("key")).join(parts, "lb").select(F.explode(F.array(met_by(0, "key", F.col("start"), F.col("next"), "half"), met_by(1, "key", F.col("start"), second, "rest"))).alias("part"), F.col("key").alias("b"))
    total = F.length("key") + F.col("lb")
    common = F.ceil(least * total / 2 - 1e-9).cast("int")
    asked = a.crossJoin(parts).where(2 * F.least(F.length("key"), F.col("lb")) >= least * total).withColumns({"lo": F.greatest(F.lit(0), F.col("start") - (F.col("lb") - common)), "hi": F.least(F.length("key") - F.col("len"), F.col("start") + F.length("key") - common)})
    each = asked.where("lo <= hi").select("lb", "i", "len", "half", "rest", "first", (total - 2 * common).alias("apart"), F.col("key").alias("a"), F.explode(F.sequence("lo", "hi")).alias("at"))
    after = F.when(F.col("first"), F.lit(0)).otherwise(F.col("at") + F.col("len"))
    keys = [met_by(0, "a", F.col("at"), after, "half"), *[met_by(1, "a", F.col("at"), after + F.col("half") + k, "rest") for k in (-1, 1)]]
    left = each.select(F.explode(F.array(*keys)).alias("part"), "a", "apart").distinct()
    return left.hint("merge").join(_asked_for(right, left), "part").drop("part")


def similar_keys(names: DataFrame, documents: DataFrame, least: float = 0.90) -> DataFrame:
    """(a, b, ratio): pairs of different keys of names and of documents whose sequence ratio is at least `least` (0.8 or more).

    What meets by segments (_meetings) is tried by a bounded edit distance at once, and only what passes is compared in full.
    """
    if not 0.8 <= least <= 1:
        raise ValueError("least must be between 0.8 and 1")
    a, b = (d.select("key").where("key is not null").distinct() for d in (names, documents))
    met = _meetings(a, b, least).where((F.col("a") != F.col("b")) & F.expr("levenshtein(a, b, apart) >= 0")).select("a", "b").distinct()
    return met.withColumn("ratio", sequence_ratio("a", "b")).where(F.col("ratio") >= least)


def fuzzy(names: DataFrame, documents: DataFrame, least: float = 0.90, k: int = 5) -> DataFrame:
    """(name, doc, ratio, rank): per name the documents of the same key, else those most similar by the sequence ratio, k at most; ties by doc. Null keys are like none."""
    from harrow.operators.selection import top_k

    same = names.select("name", "key").join(documents.select("doc", "key"), "key").select("name", "doc", F.lit(1.0).alias("ratio"))
    rest = names.join(documents.select("key").distinct(), "key", "left_anti")
    pairs = similar_keys(rest, documents, least)
    scored = rest.select("name", F.col("key").alias("a")).join(pairs, "a").join(documents.select("doc", F.col("key").alias("b")), "b").select("name", "doc", "ratio")
    return top_k(same.union(scored).withColumn("_o", F.struct((-F.col("ratio")).alias("r"), "doc")), "name", F.col("_o"), k).drop("_o")


def with_default(left: DataFrame, right: DataFrame, on: str, value: str, default: str = "NO DATA") -> DataFrame:
    """J23, J26."""
    return left.join(right, on, "left").withColumn(value, F.coalesce(value, F.lit(default)))


#: What a lookup of a prototype says where there is none; fixed values.
NOT_STORED = "The function is not stored look up in the headers or c files associated."
NO_REGISTRY = "Lookup in the headers or c files no functions are stored right now."


def prototypes(asked: DataFrame, registry: DataFrame | None) -> DataFrame:
    """Asked (function_name, ...) with a message: the prototype by the registry (function_name, prototype), that it isn't stored, or that nothing is, where there is no registry at all. A name that is there without a prototype counts as not stored."""
    if registry is None:
        return asked.withColumn("message", F.lit(NO_REGISTRY))
    one = registry.groupBy("function_name").agg(F.max("prototype").alias("_p"))
    return asked.join(one, "function_name", "left").withColumn("message", F.coalesce(F.concat(F.lit("Prototype: "), "_p", F.lit("\n")), F.lit(NOT_STORED))).drop("_p")


def resolve_aliases(calls: DataFrame, macros: DataFrame, definitions: DataFrame) -> DataFrame:
    """Calls (file_name, callee, ...) whose callee is a macro go where its chain of expansions ends, and are then resolved like any other; expanded says what that was."""
    from harrow.operators.graph import expand_macros

    ends = expand_macros(macros).select(F.col("name").alias("callee"), F.col("target").alias("_end"))
    d = calls.join(ends, "callee", "left").withColumn("expanded", F.coalesce("_end", "callee")).drop("_end")
    named = d.withColumnRenamed("callee", "_called").withColumnRenamed("expanded", "callee")
    return resolve_callee(named, definitions).withColumnRenamed("callee", "expanded").withColumnRenamed("_called", "callee")


def flatten_levels(levels: DataFrame, functions: DataFrame) -> DataFrame:
    """A map of level to function ids, joined to the functions."""
    return levels.select(F.explode("function_levels").alias("level", "ids")).select("level", F.explode("ids").alias("id")).join(functions, "id")
