"""Functions that built-in expressions can't state: recursion over unknown JSON, byte-exact fingerprints, sequence matching, lexing of C.

All take whole Arrow batches. register() makes them callable from SQL.
"""

from __future__ import annotations

import difflib
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of key names that are budgets, not usage, and names of totals. Fixed values.
NO_USAGE = ("limit", "max", "window", "budget", "remaining", "left")
TOTALS = ("total_tokens", "totaltokens", "tokens_total")


def own_usage(v: dict) -> int:
    """The tokens that an object states itself: the larger of its greatest total and the sum of its other token counts."""
    counts = {k.lower(): int(n) for k, n in v.items() if isinstance(n, (int, float)) and not isinstance(n, bool)}
    named = {k: n for k, n in counts.items() if "token" in k and not any(w in k for w in NO_USAGE)}
    is_total = lambda k: any(w in k for w in TOTALS)
    return max(max((n for k, n in named.items() if is_total(k)), default=0), sum(n for k, n in named.items() if not is_total(k)))


def usage(x: object) -> int:
    """A2: tokens of a JSON value: what each object in it states itself, at any depth. JSON inside a text field of an object counts if the text names tokens."""
    total, level = 0, [x]
    while level:
        objects = [v for v in level if isinstance(v, dict)]
        total += sum(map(own_usage, objects))
        fields = [v for o in objects for v in o.values()]
        level = [v for v in fields if isinstance(v, (dict, list))] + [y for v in level if isinstance(v, list) for y in v]
        level += [_json(v) for v in fields if isinstance(v, str) and "token" in v.lower()]
    return total


def _json(text: str | None) -> object:
    try:
        return json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.LongType())
def usage_tokens(x: pd.Series) -> pd.Series:
    return x.map(lambda t: usage(_json(t))).astype("int64")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp, as difflib has it."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.StringType())
def canonical_sha256(x: pd.Series) -> pd.Series:
    """SHA-256 of a JSON object in the byte form of sorted keys and ', ' and ': ' between parts; null for no JSON."""
    def one(t: str | None) -> str | None:
        v = _json(t)
        return None if v is None else hashlib.sha256(json.dumps(v, ensure_ascii=False, sort_keys=True).encode()).hexdigest()

    return x.map(one)


_LEX = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|/\*.*?(?:\*/|\Z)|//(?:\\\n|[^\n])*', re.S)


def blank(text: str, strings: bool = False) -> str:
    """comments as spaces, line breaks kept, so every place stays where it is; strings: text literals too."""
    hide = lambda s: re.sub(r"[^\n]", " ", s)
    return _LEX.sub(lambda m: hide(m[0]) if strings or m[0][0] == "/" else m[0], text)


@F.pandas_udf(T.StringType())
def blank_comments(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else blank(t))


def closing(code: str, at: int) -> int:
    """The place after the brace that closes the one at `at`; -1 if none does. `code` has its comments and strings blanked."""
    depth = 0
    for m in re.compile("[{}]").finditer(code, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return -1


def body_of(text: str | None, name: str) -> str | None:
    """the text of `void name(...) {...}`."""
    code = blank(text or "", strings=True)
    m = re.search(rf"\bvoid\s+{re.escape(name)}\s*\([^)]*\)\s*\{{", code)
    end = closing(code, m.end() - 1) if m else -1
    return text[m.start() : end] if m and end >= 0 else None


@F.pandas_udf(T.StringType())
def function_body(x: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([body_of(t, n) for t, n in zip(x, name)], dtype=object)


_KEYWORDS = {"if", "for", "while", "switch", "return", "sizeof", "do", "else", "case", "typedef", "struct", "union", "enum", "defined"}
_DEFINE = re.compile(r"(?m)^[ \t]*((?:[A-Za-z_][\w]*[\s*]+)+)\(?\s*\*?\s*([A-Za-z_]\w*)\s*\)?\s*\(([^;{}]*)\)\s*\{")


def definitions_of(text: str | None) -> list[tuple[str, bool, int, int]]:
    """(name, is_static, first line, last line) of the functions that a C text defines, by a lexer that knows comments, strings and braces."""
    code = blank(text or "", strings=True)
    out, at = [], 0
    while m := _DEFINE.search(code, at):
        end = closing(code, m.end() - 1)
        if m[2] in _KEYWORDS or set(m[1].split()) & (_KEYWORDS - {"struct", "union", "enum"}):
            at = m.end()
            continue
        start = m.start(1)
        last = end if end >= 0 else len(code)
        out.append((m[2], "static" in m[1].split(), code.count("\n", 0, start) + 1, code.count("\n", 0, last) + 1))
        at = last
    return out


def _spaces(code: str, end: int) -> int:
    """Where the white space begins that ends at `end`."""
    while end and code[end - 1].isspace():
        end -= 1
    return end


def _word(code: str, end: int) -> int:
    """Where the name or number begins that ends at `end`; `end` if none does."""
    while end and (code[end - 1].isalnum() or code[end - 1] == "_"):
        end -= 1
    return end


def _opening(code: str, at: int) -> int:
    """The place of the bracket that the one at `at` closes; -1 if there is none."""
    depth, own, pair = 0, code[at], {")": "(", "]": "["}[code[at]]
    for k in range(at, -1, -1):
        depth += (code[k] == own) - (code[k] == pair)
        if depth == 0:
            return k
    return -1


def _control(code: str, opened: int) -> bool:
    """Whether the bracket is that of a condition."""
    end = _spaces(code, opened)
    return code[_word(code, end) : end] in {"if", "while", "for", "switch"}


def _callee_start(code: str, end: int) -> int:
    """Where the expression begins that ends at `end`: names, brackets and the members that it goes through."""
    at = end
    while True:
        end = _spaces(code, at)
        if end and code[end - 1] in ")]":
            opened = _opening(code, end - 1)
            if opened < 0:
                return at
            at, before = opened, _spaces(code, opened)
            word = _word(code, before)
            if before and (code[before - 1] == "]" or code[before - 1] == ")" and not _control(code, _opening(code, before - 1)) or word < before and code[word:before] not in _KEYWORDS):
                continue
        elif (word := _word(code, end)) < end:
            at = word
        else:
            return at
        end = _spaces(code, at)
        if end and code[end - 1] == ".":
            at = end - 1
        elif code[max(0, end - 2) : end] == "->":
            at = end - 2
        else:
            return at


#: What follows a type and a bracket where a pointer to functions is declared.
_POINTER = re.compile(r"\s*\*[\s*]*\w*\s*\)\s*\(")


def arguments_of(code: str, at: int) -> list[str]:
    """The arguments of the call whose bracket opens at `at`; commas within brackets part nothing."""
    depth, out, start = 0, [], at + 1
    for p in re.compile(r"[()\[\]{},]").finditer(code, at):
        if p[0] == "," and depth == 1:
            out.append(code[start : p.start()])
            start = p.end()
        elif p[0] in "([{":
            depth += 1
        elif p[0] in ")]}":
            depth -= 1
            if depth == 0:
                last = code[start : p.start()]
                return [*out, last] if out or last.strip() else []
    return [*out, code[start:]]


_PLAIN = re.compile(r"[A-Za-z_]\w*")


def _calls(text: str | None, policy: str) -> list[tuple[str, int, list[str | None]]]:
    """(callee as it is written, line, the name that each argument is, or null) of the calls by a policy."""
    code = blank(text or "", strings=True)
    defined = {m.start(2) for m in _DEFINE.finditer(code)}
    out = []
    for m in re.finditer(r"(?<=[\w)\]])\s*\(", code):
        word = _word(code, m.start())
        if word < m.start() and (code[word : m.start()] in _KEYWORDS or word in defined or _POINTER.match(code, m.end())):
            continue
        if code[m.start() - 1] == ")" and _control(code, _opening(code, m.start() - 1)):
            continue
        start = _callee_start(code, m.start())
        callee = " ".join(code[start : m.start()].split())
        plain = _PLAIN.fullmatch(callee)
        if not callee or not plain and re.fullmatch(r"\((?:\s*(?:const|unsigned|signed|struct|enum|union|void|char|short|int|long|float|double|size_t|\w+_t)\b[\w\s*]*)\)", callee):
            continue  # a cast
        if re.match(r"[A-Za-z_]\w*[\s*]+\(\s*\*", callee):
            continue  # the declaration of a pointer to functions
        if not plain and policy == "identifier":
            continue
        opened = m.end() - 1
        args = arguments_of(code, opened)
        args = [re.sub(r"^\(\s*[A-Za-z_][\w\s*]*\)\s*", "", a.strip()) for a in args]
        out.append((callee, code.count("\n", 0, opened) + 1, [g[1] if (g := re.fullmatch(r"&?\s*\(?\s*([A-Za-z_]\w*)\s*\)?", a)) else None for a in args]))
    return out


def calls_of(text: str | None, policy: str = "identifier", positions: dict[str, list[int]] | None = None) -> list[tuple[str, int, list[str]]]:
    """(callee, line, names passed as arguments) of the calls in a C text, in the order in which their brackets open.

    policy: 'identifier' takes calls by a plain name alone, so neither members nor pointers; 'indirect' also has the others, as indirect_call; 'text' has whatever is called as it is written. A name that is passed plainly, by & or behind a cast is given once; with positions, only callees named there pass any, and only at these places (from 1).
    """
    if policy not in ("identifier", "indirect", "text"):
        raise ValueError(f"no such policy: {policy}")
    out = []
    for callee, line, names in _calls(text, policy):
        passed = [g for k, g in enumerate(names, 1) if g is not None and (positions is None or k in positions.get(callee, []))]
        out.append((callee if policy == "text" or _PLAIN.fullmatch(callee) else "indirect_call", line, list(dict.fromkeys(passed))))
    return out


_DEFS = T.ArrayType(T.StructType().add("name", T.StringType()).add("is_static", T.BooleanType()).add("start_line", T.IntegerType()).add("end_line", T.IntegerType()))
_CALLS = T.ArrayType(T.StructType().add("callee", T.StringType()).add("line_number", T.IntegerType()).add("passed", T.ArrayType(T.StringType())))


@F.pandas_udf(_DEFS)
def c_definitions(x: pd.Series) -> pd.Series:
    keys = ("name", "is_static", "start_line", "end_line")
    return x.map(lambda t: [dict(zip(keys, d)) for d in definitions_of(t)])


@F.pandas_udf(_CALLS)
def c_calls(x: pd.Series) -> pd.Series:
    return x.map(lambda t: [dict(zip(("callee", "line_number", "passed"), c)) for c in calls_of(t)])


_WRITTEN = T.ArrayType(T.StructType().add("callee", T.StringType()).add("written", T.StringType()).add("line_number", T.IntegerType()).add("names", T.ArrayType(T.StringType())))


def written_calls_of(text: str | None) -> list[tuple[str, str, int, list[str | None]]]:
    """(callee, as it is written, line, names) of the calls in a C text; callee is indirect_call for what is no name; names has a place for each argument, null where it is no name. Every policy and every choice of places is made of these columns, so a text is gone through once."""
    return [(c if _PLAIN.fullmatch(c) else "indirect_call", c, n, names) for c, n, names in _calls(text, "text")]


@F.arrow_udf(_WRITTEN)
def c_written_calls(x: pa.Array) -> pa.Array:
    """written_calls_of() of each text; equal texts of a batch are gone through once."""
    d = x.dictionary_encode()
    found = pa.array([[dict(zip(("callee", "written", "line_number", "names"), c)) for c in written_calls_of(t)] for t in d.dictionary.to_pylist()], pa.list_(pa.struct([("callee", pa.string()), ("written", pa.string()), ("line_number", pa.int32()), ("names", pa.list_(pa.string()))])))
    return found.take(d.indices)


_TEST = re.compile(r'CU_add_test\s*\(\s*(\w+)\s*,\s*("(?:[^"\\]|\\.)*")\s*,\s*(\w+)\s*\)')


def tests_of(text: str | None, prefix: str, suite: str = "suite") -> list[tuple[str, str | None, str]]:
    """(name, body, registration) of each registration of a test, the registered names alone renamed to prefix_name; calls of other functions stay. A body is given with the first registration of its test."""
    found = list(_TEST.finditer(text or ""))
    names = list(dict.fromkeys(m[3] for m in found))
    sub = lambda s: re.sub(rf"\b({'|'.join(map(re.escape, names))})\b", lambda m: f"{prefix}_{m[1]}", s)
    out, seen = [], set()
    for m in found:
        body = None if m[3] in seen else body_of(text, m[3])
        seen.add(m[3])
        out.append((f"{prefix}_{m[3]}", sub(body) if body else None, f"CU_add_test({suite}, {m[2]}, {prefix}_{m[3]});"))
    return out


def renamed_tests(text: str | None, prefix: str, suite: str = "suite") -> str:
    """the bodies of tests_of(), then the registrations, as one text."""
    found = tests_of(text, prefix, suite)
    return "\n".join([b for _, b, _ in found if b] + [line for _, _, line in found])


@F.pandas_udf(T.StringType())
def prefixed_tests(x: pd.Series, prefix: pd.Series) -> pd.Series:
    return pd.Series([renamed_tests(t, p) for t, p in zip(x, prefix)], dtype=object)


def rebased(v: object, pairs: list[tuple[str, str]]) -> object:
    """every text of a JSON value with its path prefixes rewritten, the longest first."""
    if isinstance(v, dict):
        return {k: rebased(x, pairs) for k, x in v.items()}
    if isinstance(v, list):
        return [rebased(x, pairs) for x in v]
    if isinstance(v, str):
        for a, b in sorted(pairs, key=lambda p: -len(p[0])):
            v = v.replace(a, b)
    return v


def rebase_json(pairs: list[tuple[str, str]]):
    @F.pandas_udf(T.StringType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if (v := _json(t)) is None else json.dumps(rebased(v, pairs), ensure_ascii=False))

    return run


def json_safe(v: object) -> object:
    """a value of JSON's own types; others as text, not-a-number as null, sets in order."""
    if v is None or isinstance(v, (bool, int, str)):
        return v
    if isinstance(v, float):
        return v if v == v and abs(v) != float("inf") else None
    if isinstance(v, dict):
        return {str(k): json_safe(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [json_safe(x) for x in v]
    if isinstance(v, (set, frozenset)):
        return sorted((json_safe(x) for x in v), key=str)
    return str(v)


#: Encodings in the order in which they are tried. Fixed values.
ENCODINGS = ("utf-8", "euc_jp", "cp932", "shift_jis", "latin-1")
RAW_ENCODINGS = ("utf-8", "shift_jis", "euc_jp", "cp932", "latin-1")


def decoded(encodings: tuple[str, ...] = ENCODINGS):
    """Bytes as text by the first encoding that fits."""

    def one(b: bytes | None) -> str | None:
        for e in encodings if b is not None else ():
            try:
                return bytes(b).decode(e)
            except UnicodeDecodeError:
                continue
        return None

    @F.pandas_udf(T.StringType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(one)

    return run


def token_counts(path: str):
    """Tokens of a text by a tokenizer file of the tokenizers library, found on every executor."""

    @F.pandas_udf(T.LongType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        for x in batches:
            yield pd.Series([len(e.ids) for e in tok.encode_batch_fast(x.fillna("").tolist(), add_special_tokens=False)], dtype="int64")

    return run


@F.udtf(returnType="callee string, line_number int, passed array<string>", useArrow=True)
class CallsOf:
    """The calls of a C text as rows; the policy is an argument."""

    def eval(self, text: str, policy: str):
        yield from calls_of(text, policy or "identifier")


@F.udtf(returnType="callee string, line_number int, passed array<string>", useArrow=True)
class PassedTo:
    """The calls of a C text as rows, callbacks taken from the places that a map of callees to places (from 1) names."""

    def eval(self, text: str, positions: dict):
        yield from calls_of(text, "indirect", positions or {})


@F.udtf(returnType="name string, is_static boolean, start_line int, end_line int", useArrow=True)
class DefinitionsIn:
    """The functions that a C text defines, as rows."""

    def eval(self, text: str):
        yield from definitions_of(text)


@F.udtf(returnType="name string, body string, registration string", useArrow=True)
class TestsIn:
    """the registered tests of a C text as rows, renamed to prefix_name; a test without a body has none."""

    def eval(self, text: str, prefix: str):
        yield from tests_of(text, prefix)


def register(spark: SparkSession) -> None:
    """Makes the functions callable from SQL by their names; those that give rows by lateral joins."""
    for name, f in {"c_calls_of": CallsOf, "c_passed_to": PassedTo, "c_definitions_in": DefinitionsIn, "c_tests_in": TestsIn}.items():
        spark.udtf.register(name, f)
    spark.udf.register("decoded_raw", decoded(RAW_ENCODINGS))
    for f in (usage_tokens, sequence_ratio, canonical_sha256, blank_comments, function_body, c_definitions, c_calls, prefixed_tests):
        spark.udf.register(f.__name__, f)
    spark.udf.register("decoded", decoded())
