"""Text expressions. All are built-in functions, so they run inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.functions.exprs import first_true


def has_text(x: Column) -> Column:
    """Whether a text has anything but white space (of Unicode, and the separators of ASCII); false for null."""
    return F.coalesce(x.rlike(r"[^\s\x1c-\x1f\x85\p{Z}]"), F.lit(False))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def fenced_code(x: Column) -> Column:
    """the first fenced block, else the whole text."""
    p = r"(?is)```(?:c)?\s*(.*?)```"
    return strip(F.when(x.rlike(p), F.regexp_extract(x, p, 1)).otherwise(x))


def approx_tokens(x: Column) -> Column:
    """a token for four code points, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(x) / 4)).cast("long")


def token_line(x: Column) -> Column:
    """struct(input, output) of a line 'Tokens ↑ 14.4k • ↓ 2.5k'; nulls if there is none."""
    p = r"(?i)Tokens\s+↑\s*([0-9.]+k?)\s*•\s*↓\s*([0-9.]+k?)"

    def number(i: int) -> Column:
        s = F.lower(F.regexp_extract(x, p, i))
        v = F.regexp_replace(s, "k$", "").try_cast("double")
        return F.when(s != "", F.when(F.endswith(s, F.lit("k")), v * 1000).otherwise(v).cast("long"))

    return F.struct(number(1).alias("input"), number(2).alias("output"))


def tool_calls(x: Column) -> Column:
    """every '● tool (MCP: server) … name: "x"' as server.tool(name=x), in order."""
    p = r"●\s+([^\n]+?)\s+\(MCP:\s*([^)]+)\)([^\n]*)"

    def one(m: Column) -> Column:
        part = lambda i: F.trim(F.regexp_extract(m, p, i))
        name = F.trim(F.regexp_extract(F.regexp_extract(m, p, 3), r'\bname:\s*"([^"]+)"', 1))
        call = F.concat(part(2), F.lit("."), part(1))
        return F.when(name != "", F.concat(call, F.lit("(name="), name, F.lit(")"))).otherwise(call)

    return F.transform(F.regexp_extract_all(x, F.lit(p), F.lit(0)), one)


def macro_names(x: Column) -> Column:
    """F5."""
    return F.regexp_extract_all(x, F.lit(r"(?m)^\s*#\s*define\s+([A-Za-z_]\w*)"), F.lit(1))


def function_pointers(x: Column) -> Column:
    """F6."""
    return F.regexp_extract_all(x, F.lit(r"\(\s*\*\s*([A-Za-z_]\w*)\s*\)\s*\("), F.lit(1))


def safe_filename(x: Column, trim: bool = True) -> Column:
    """F7."""
    s = F.regexp_replace(x, r"[^A-Za-z0-9_.\-]+", "_")
    return F.regexp_replace(s, "^_+|_+$", "") if trim else s


def safe_identifier(x: Column) -> Column:
    """F8: letters, digits and underscores; 'generated' if nothing is left, 'f_' before a digit."""
    s = F.regexp_replace(F.regexp_replace(x, "[^A-Za-z0-9_]+", "_"), "^_+|_+$", "")
    return F.when(s == "", "generated").when(s.rlike("^[0-9]"), F.concat(F.lit("f_"), s)).otherwise(s)


def artifact_key(source: Column, name: Column) -> Column:
    """F9."""
    return safe_filename(F.concat(source, F.lit("__"), name))


def safe_name(x: Column, limit: int = 120) -> Column:
    """F10."""
    s = F.substring(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"[^A-Za-z0-9_.=\-]+", "_"), "^_+|_+$", ""), 1, limit)
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unknown"))


def doc_key(x: Column) -> Column:
    """the file's stem, lower-cased, other characters as single underscores."""
    stem = F.regexp_replace(F.regexp_extract(x, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.regexp_replace(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def strip_fences(x: Column) -> Column:
    """F13."""
    return F.regexp_replace(F.regexp_replace(x, r"^\s*```[A-Za-z]*\s*", ""), r"\s*```\s*$", "")


def strip_comments_and_strings(x: Column) -> Column:
    """F14."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", ""), r'"(?:[^"\\]|\\.)*"', '""')


def strip_comments(x: Column) -> Column:
    """F16."""
    return F.regexp_replace(x, r"(?s)/\*.*?\*/|//[^\n]*", "")


def wrapped_names(x: Column) -> Column:
    """F17."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(r"__wrap_(\w+)"), F.lit(1))))


def defined_wrappers(x: Column) -> Column:
    """F18."""
    return F.regexp_extract_all(x, F.lit(r"__wrap_(\w+)\s*\([^;{]*\)\s*\{"), F.lit(1))


def marker_section(x: Column, begin: str, end: str) -> Column:
    """what stands between two markers; empty without the first."""
    tail = F.when(F.contains(x, F.lit(begin)), F.substring_index(F.substring(x, F.instr(x, begin) + len(begin), 1 << 30), end, 1))
    return strip(F.coalesce(tail, F.lit("")))


def joined_macro(x: Column) -> Column:
    """F22."""
    return strip(F.regexp_replace(x, r"\\\n", " "))


def bare_include(x: Column) -> Column:
    """F23."""
    return F.btrim(x, F.lit('<">'))


def label_parts(x: Column) -> Column:
    """struct(first, second, name) of '[a][b]name'."""
    blocks = F.regexp_extract_all(x, F.lit(r"\[([^\[\]]*)\]"), F.lit(1))
    return F.struct(F.get(blocks, 0).alias("first"), F.get(blocks, 1).alias("second"), strip(F.regexp_replace(x, r"\[[^\[\]]*\]", "")).alias("name"))


def bare_label(x: Column) -> Column:
    """F25."""
    return F.regexp_replace(x, r"\[.*?\]", "")


def answer_values(x: Column) -> Column:
    """what follows the first ':' of each comma-parted piece: text if it is quoted or no whole number; UNRESOLVED without a ':'. An empty text has no values."""

    def one(p: Column) -> Column:
        v = F.get(F.split(p, ":"), 1)
        bare = F.btrim(v, F.lit('"'))
        return F.when(v.isNull(), "UNRESOLVED").when(~F.contains(v, F.lit('"')) & F.trim(v).rlike("^[+-]?[0-9]+$"), F.trim(v)).otherwise(bare)

    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(x, ","), one))


def answer_pieces(x: Column) -> Column:
    """F26, the third form: of each comma-parted piece what stands between its first ':' and the next one, or all of it without one; quotes around it go. An empty text is one empty value."""
    return F.transform(F.split(x, ","), lambda p: F.btrim(F.coalesce(F.get(F.split(p, ":"), 1), p), F.lit('"')))


def answer_numbers(x: Column) -> Column:
    """F26, the strict form: a whole number or UNRESOLVED."""
    return F.transform(answer_values(x), lambda v: F.when(v.rlike("^-?[0-9]+$"), v).otherwise(F.lit("UNRESOLVED")))


def n_unresolved(x: Column) -> Column:
    """F27."""
    return F.regexp_count(F.upper(x), F.lit("UNRESOLVED")).cast("long")


def ellipsis(x: Column, n: int) -> Column:
    """F29."""
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("..."))).otherwise(x)


def chunk_text(rank: Column, *parts: Column) -> Column:
    """F32: the first filled part, numbered."""
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] "), F.coalesce(*[F.nullif(p, F.lit("")) for p in parts], F.lit("{}")))


def word_hits(line: Column, word: Column) -> Column:
    """whether a whole word occurs, as it is or lower-cased."""
    # a pattern made of a column is compiled for each row, so it is only where the word stands at all
    hit = lambda w: F.contains(line, w) & F.regexp_like(line, F.concat(F.lit(r"\b\Q"), w, F.lit(r"\E\b")))
    return hit(word) | hit(F.lower(word))


def redacted(headers: Column) -> Column:
    """authorization values of a header map."""
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin("authorization", "x-api-key", "proxy-authorization", "cookie"), "[REDACTED]").otherwise(v))


def leaked_prefix(x: Column, prefixes: Column) -> Column:
    """The first of the prefixes that stands anywhere in a text; null if none does. An empty prefix is none."""
    return F.get(F.filter(prefixes, lambda p: (p != "") & F.contains(x, p)), 0)


def without_prefixes(x: Column, prefixes: Column, label: str) -> Column:
    """The text; one that holds a forbidden prefix is an error when it is read."""
    found = leaked_prefix(x, prefixes)
    return F.when(found.isNotNull(), F.raise_error(F.concat(F.lit(f"forbidden path prefix in {label}: "), found))).otherwise(x)


def line_slice(x: Column, start: Column, end: Column) -> Column:
    """lines start to end, from 1, both included; a start below 1 is 1."""
    start = F.greatest(F.lit(1), start)
    return F.array_join(F.slice(F.split(x, "\n"), start, F.greatest(F.lit(0), end - start + 1)), "\n")


def csv_value(x: Column) -> Column:
    """-1 and not-a-number are NA."""
    s = x.cast("string")
    return F.when(s.isNull() | s.isin("-1", "-1.0", "NaN", "nan"), "NA").otherwise(s)


def tail(x: Column, n: int) -> Column:
    """T10."""
    return F.when(F.length(x) > n, F.right(x, F.lit(n))).otherwise(x)


#: Lines of a failed build. Fixed values.
BUILD_ERRORS = [
    r"make(?:\[\d+\])?: \*\*\* .* Error \d+",
    r"make(?:\[\d+\])?: .* Error \d+ \(ignored\)",
    r"\berror:",
    r"undefined reference",
    r"collect2:\s+error",
    r"ld returned \d+ exit status",
    r"cannot open output file",
    r"cannot find -l",
    r"No such file or directory",
    r"No rule to make target",
    r"recipe for target .* failed",
    r"\bStop\.",
]


def build_ok(code: Column, out: Column) -> Column:
    """Exit code 0 and no line of an error."""
    return (code == 0) & ~out.rlike("(?i)" + "|".join(BUILD_ERRORS))


def failure_hint(x: Column) -> Column:
    """P20: what a repeated failure points to, by the first of five rules; null if by none."""
    low = F.lower(x)
    return first_true(
        (F.contains(low, F.lit("no rule to make target")), "stale_contract"),
        (F.contains(low, F.lit("overriding recipe for target")), "overridden_target"),
        (low.rlike("multiple definition|duplicate symbol"), "symbol_owner"),
        (low.rlike("undefined reference to ['\"]__wrap_"), "wrap_symbol"),
        (low.rlike("heap out of memory|invalid table size"), "runtime"),
        default=None,
    )


def stub_body_ok(body: Column, name: Column) -> Column:
    """P18."""
    return (strip(body) != "") & F.contains(body, F.concat(F.lit("__wrap_"), name)) & ~F.contains(body, F.concat(F.lit("__real_"), name))


def registers_test(x: Column) -> Column:
    """P19."""
    return strip_comments_and_strings(x).rlike(r"\bCU_add_test\s*\(")


def insert_once(text: Column, symbol: str, marker: str, line: str) -> Column:
    """the line after the first marker; the marker is appended if absent, and nothing happens if the symbol is there."""
    base = F.when(F.contains(text, F.lit(marker)), text).otherwise(F.concat(text, F.lit("\n" + marker + "\n")))
    at = F.instr(base, marker) + len(marker)
    return F.when(F.contains(text, F.lit(symbol)), text).otherwise(F.concat(F.substring(base, F.lit(1), at - 1), F.lit("\n" + line), F.substring(base, at, F.length(base))))
