"""Expressions over JSON, maps, arrays, paths and keys."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.functions.exprs import filled
from harrow.functions.text import safe_name


def made_once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, where x is made once a row and not at each place, or for each element, where f has it."""
    return F.get(F.transform(F.array(x), f), 0)


def loose_json(x: Column) -> Column:
    """The text, or without its fence, or from the first { to the last }; else an empty object. As VARIANT."""
    bare = F.regexp_replace(F.regexp_replace(x, r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", "")
    return F.coalesce(F.try_parse_json(x), F.try_parse_json(bare), F.try_parse_json(F.regexp_extract(x, r"(?s)\{.*\}", 0)), F.parse_json(F.lit("{}")))


def json_object(x: Column) -> Column:
    """The object that a line is; null for anything else."""
    v = F.try_parse_json(x)
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v)


def json_text(x: Column) -> Column:
    """A text as JSON."""
    return F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")


def short_hash(x: Column, n: int, kind: str = "sha256") -> Column:
    """the first n digits; for a text's hash as a value, pass its json_text()."""
    return F.left(F.sha2(x, 256) if kind == "sha256" else F.md5(x), F.lit(n))


def answer_key(output: Column, call_number: Column) -> Column:
    """F42."""
    return F.to_json(F.struct(call_number.alias("call_number"), output.alias("output")), {"ignoreNullFields": "false"})


def env_pairs(items: Column) -> Column:
    """K=V, parted at the first =, as structs in their order."""
    pair = lambda s: F.struct(F.substring_index(s, "=", 1).alias("key"), F.when(F.contains(s, F.lit("=")), F.substring(s, F.instr(s, "=") + 1, F.length(s))).otherwise(F.lit("")).alias("value"))
    return F.transform(items, pair)


def env_map(items: Column) -> Column:
    """K=V items as a map; the last value of a key counts."""
    later = lambda pairs, p, i: F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"])
    return made_once(env_pairs(items), lambda pairs: F.map_from_entries(F.filter(pairs, lambda p, i: ~later(pairs, p, i))))


def last_wins(*maps: Column) -> Column:
    """The maps' entries, a later map's over an earlier one's."""
    def over(a: Column, b: Column) -> Column:
        return made_once(b, lambda m: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(m, k)), m))

    return reduce(over, maps)


#: What is forwarded. Fixed values.
ENV_KEYS = ["http_proxy", "https_proxy", "no_proxy", "HTTP_PROXY", "HTTPS_PROXY", "NO_PROXY"]
ENV_PREFIXES = ["http_", "https_", "HTTP_", "HTTPS_"]


def forwarded(env: Column, have: Column, exact: list[str] = ENV_KEYS, prefixes: list[str] = ENV_PREFIXES) -> Column:
    """Entries of env by exact key or prefix, those that `have` holds already stay."""
    def go(k: Column, v: Column) -> Column:
        out = k.isin(exact)
        for p in prefixes:
            out = out | F.startswith(k, F.lit(p))
        return out

    return last_wins(F.map_filter(env, go), have)


def relative_path(x: Column) -> Column:
    """slashes forward, no leading ones, no '.'; null if it is empty or climbs."""
    parts = F.filter(F.split(F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("/")), "^/+", ""), "/"), lambda p: ~p.isin("", "."))
    return made_once(parts, lambda own: F.when((F.size(own) > 0) & ~F.array_contains(own, ".."), F.array_join(own, "/")))


def finish_status(reason: Column) -> Column:
    """a run's status by why it ended."""
    return F.when(reason.isin("timeout", "idle-timeout"), reason).otherwise("completed")


def event_status(kind: Column, status: Column) -> Column:
    """an event's own status, else by its type."""
    return F.coalesce(filled(status), F.when(kind == "run-failed", "failed").otherwise("completed"))


def bind(x: Column) -> Column:
    """'src:dst[:mode]' as struct(source, target)."""
    p = F.split(x, ":")
    return F.when(F.size(p).isin(2, 3) & (F.get(p, 0) != "") & (F.get(p, 1) != ""), F.struct(F.get(p, 0).alias("source"), F.get(p, 1).alias("target")))


def mount(x: Column) -> Column:
    """'k=v,k=v' with synonyms; the type must be absent or bind."""
    def read(m: Column) -> Column:
        any_of = lambda *ks: F.coalesce(*[filled(F.try_element_at(m, F.lit(k))) for k in ks])
        source, target, kind = any_of("source", "src"), any_of("target", "destination", "dst"), any_of("type")
        return F.when(source.isNotNull() & target.isNotNull() & (F.coalesce(kind, F.lit("bind")) == "bind"), F.struct(source.alias("source"), target.alias("target")))

    return made_once(env_map(F.split(x, ",")), read)


def job_key(process: Column, function: Column, path_no: Column, path: Column, context: Column) -> Column:
    """the three keys of a traced path."""
    h = lambda c, n: short_hash(json_text(c), n)
    return F.struct(
        F.format_string("%s::%s::path_%04d::p_%s::c_%s", process, function, path_no, h(path, 8), h(context, 8)).alias("job"),
        F.format_string("path_%04d__%s__fp_%s", path_no, safe_name(function), h(path, 16)).alias("folder"),
        F.format_string("%s__path_%04d__p_%s__c_%s", safe_name(function), path_no, h(path, 8), h(context, 8)).alias("run"),
    )


def positional(items: Column, defaults: list[str]) -> Column:
    """each position's item, or its default."""
    return F.array(*[F.coalesce(filled(F.get(items, i)), F.lit(d)) for i, d in enumerate(defaults)])


def source_list(paths: Column, empty: str) -> Column:
    """F56."""
    return F.when(F.size(paths) > 0, F.array_join(F.transform(paths, lambda p: F.concat(F.lit(" - "), p)), "\n")).otherwise(F.lit(empty))


def json_block(x: Column, keys: list[str]) -> Column:
    """struct(ok, why) of a fenced json block: found, parses, and has exactly these keys."""
    p = r"(?s)```json\s*(.*?)```"
    body = F.regexp_extract(x, p, 1)
    v = F.try_parse_json(body)
    got = F.array_sort(F.json_object_keys(F.to_json(v)))
    why = F.when(~x.rlike(p), "no block").when(v.isNull(), "no json").when(~F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False)), "no object").when(F.coalesce(got != F.array(*[F.lit(k) for k in sorted(keys)]), F.lit(True)), "keys")
    return F.struct(why.isNull().alias("ok"), why.alias("why"))


def set_filters(required: Column, called: Column, shadowed: Column) -> Column:
    """Missing, present and shadowed, in the order of `required`."""
    bad = lambda r: ~F.array_contains(called, r) | F.array_contains(shadowed, r)
    return F.struct(F.filter(required, bad).alias("missing"), F.filter(required, lambda r: ~bad(r)).alias("present"), F.filter(required, lambda r: F.array_contains(shadowed, r)).alias("shadowed_required"))


def hard_pass(compiled: Column, missing: Column, required: Column, external: Column, correct: Column) -> Column:
    """P15, A17."""
    external_ok = ~((F.size(required) > 0) & external.isNotNull() & correct.isNotNull() & ((external == 0) | (correct != external)))
    return F.coalesce(compiled, F.lit(False)) & (F.size(missing) == 0) & F.coalesce(external_ok, F.lit(True))


def verdict(v: Column, least: int) -> Column:
    """struct(score, passed) of a judge's VARIANT; null without a number."""
    s = F.try_variant_get(v, "$.score", "double")
    n = F.greatest(F.lit(0), F.least(F.lit(100), s.cast("int")))
    return F.when(s.isNotNull(), F.struct(n.alias("score"), (n >= least).alias("passed")))


def resolved_path(path: Column, folder: str = "/") -> Column:
    """A path without `.` and `..`, from the folder if it is relative; by its text alone, so links are not followed."""
    whole = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), path))
    step = lambda done, x: F.when(x.isin("", "."), done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/"))


def below(path: Column, folder: Column) -> Column:
    """Whether a resolved path is the resolved folder or lies in it."""
    return (path == folder) | F.startswith(path, F.concat(F.rtrim(folder, F.lit("/")), F.lit("/")))
