"""Token usage that JSON texts state, added up level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.udfs import NO_USAGE, TOTALS

#: Levels that are walked before it is asked whether any are left, and bytes of a text for each time that it is asked: a level takes a byte at least.
AT_ONCE = 16


def _fields(v: Column) -> Column:
    """The fields (key, value) of a VARIANT object, the items of an array with null for a key; null for what is neither."""
    of_object = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    of_array = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
    return F.coalesce(of_object, of_array)


def _below(e: Column) -> Column:
    """The fields below a field: of its object or array, or of the JSON of a text in an object that names tokens."""
    is_text = e["key"].isNotNull() & (F.schema_of_variant(e["value"]) == "STRING")
    told = F.try_variant_get(e["value"], "$", "string")
    in_text = F.when(is_text & F.contains(F.lower(told), F.lit("token")), F.try_parse_json(told))
    return F.coalesce(_fields(e["value"]), F.get(F.transform(F.array(in_text), _fields), F.lit(0)))


def _number(v: Column) -> Column:
    kinds = F.array(F.schema_of_variant(v))
    read = lambda kind: F.when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint")).when((kind == "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(v, "$", "double").cast("bigint"))
    return F.get(F.transform(kinds, read), F.lit(0))


def _own(fields: Column) -> Column:
    """The tokens that an object with these fields states itself: the larger of its greatest total and the sum of its other token counts."""
    has = lambda e, words: F.rlike(F.lower(e["key"]), F.lit("|".join(words)))
    named = F.filter(fields, lambda e: F.contains(F.lower(e["key"]), F.lit("token")) & ~has(e, NO_USAGE))
    none = F.struct(F.lit(0).cast("long").alias("most"), F.lit(0).cast("long").alias("rest"))
    n = lambda e: F.coalesce(_number(e["value"]), F.lit(0))
    add = lambda s, e: F.when(has(e, TOTALS), F.struct(F.greatest(s["most"], n(e)).alias("most"), s["rest"].alias("rest"))).otherwise(F.struct(s["most"].alias("most"), (s["rest"] + n(e)).alias("rest")))
    return F.aggregate(named, none, add, lambda s: F.greatest(s["most"], s["rest"]))


def usage_totals(rows: DataFrame, key: str, text: str) -> DataFrame:
    """A2: (key, tokens) of each row: what every object in its JSON text states itself, at any depth.

    An object states the larger of its greatest total and the sum of its other token counts; booleans and names of budgets don't count, fractions are cut off. A text in an object's field that names tokens is read as JSON as well. A row without JSON has 0. Each row is walked for itself, a level at a time: nothing is shuffled or written, no Python runs.
    """
    found = lambda x: F.filter(x, lambda fields: fields.isNotNull())
    level = lambda s, _: F.when(F.size(s["open"]) == 0, s).otherwise(F.struct(found(F.transform(F.flatten(s["open"]), _below)).alias("open"), F.aggregate(s["open"], s["tokens"], lambda n, fields: n + _own(fields)).alias("tokens")))
    levels = lambda s, _: F.when(F.size(s["open"]) == 0, s).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(AT_ONCE)), s, level))
    start = F.struct(found(F.array(_fields(F.try_parse_json(text)))).alias("open"), F.lit(0).cast("long").alias("tokens"))
    tokens = F.aggregate(F.sequence(F.lit(0), F.floor(F.octet_length(text) / AT_ONCE).cast("int")), start, levels, lambda s: s["tokens"])
    return rows.select(F.col(key).alias(key), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"))
