"""Small cases with values worked out by hand."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from harrow.functions import structs as X
from harrow.functions import text as T
from harrow.functions import udfs as U
from harrow.operators import coverage as C
from harrow.operators import graph as G
from harrow.operators import lookups as L
from harrow.operators import rounds as R
from harrow.operators import scoring as S
from harrow.operators import selection as P
from harrow.operators import stats as A


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def test_token_line_and_calls(spark):
    text = F.lit('● function_info (MCP: srv) · name: "library_call"\nTokens     ↑ 14.4k • ↓ 2.5k')
    assert one(spark, T.tool_calls(text)) == ["srv.function_info(name=library_call)"]
    assert tuple(one(spark, T.token_line(text))) == (14400, 2500)
    assert tuple(one(spark, T.token_line(F.lit("none")))) == (None, None)


def test_judgment(spark):
    d = spark.createDataFrame([(0.8, 0.9, 0.8)], "task_correctness double, reference_similarity double, code_quality double")
    assert d.select(A.overall().alias("o")).first().o == 0.84
    c = spark.createDataFrame([(True, "coherent_c"), (False, "coherent_c"), (True, "provider_failure"), (None, "coherent_c")], "retry boolean, classification string")
    assert [r.v for r in c.select(R.valid_check().alias("v")).collect()] == [False, True, True, False]


def test_latest_score_statistics(spark):
    rows = spark.createDataFrame([(1, "t1", 0.17, 0.1, 0.2, 0.3), (2, "t1", 0.825, 0.8, 0.9, 0.7)], "line_no int, task_id string, overall double, task_correctness double, reference_similarity double, code_quality double").withColumn("setup", F.lit("s"))
    r = A.summary(R.latest(rows, ["task_id"], "line_no"), "setup").first()
    assert (r.n, r.mean_overall, r.std_overall) == (1, 0.825, 0.0)


def test_attempt_score(spark):
    s = S.attempt_score(F.lit(True), F.lit("1:42"), F.lit("7"), F.lit(1), F.lit(0), F.lit(0), F.lit(16))
    assert one(spark, s) == 160
    none = S.attempt_score(F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0), F.lit(1), F.lit(1), F.lit(40_000))
    assert one(spark, none) == -500 - 200 - 30 - 25 - 2


def test_outcome_cap_and_bucket(spark):
    row = Row(stage="unit-tests", validated=False, passed=True, ok=None, coverage_pct=100.0, semantic_score=100.0, error=None, unit_test_failed=None)
    schema = "stage string, validated boolean, passed boolean, ok boolean, coverage_pct double, semantic_score double, error string, unit_test_failed boolean"
    d = spark.createDataFrame([row, row.__class__(**{**row.asDict(), "passed": False, "error": "x"}), row.__class__(**{**row.asDict(), "passed": False}), row.__class__(**{**row.asDict(), "stage": "final", "ok": True})], schema)
    got = [tuple(r.o) for r in d.select(S.outcome().alias("o")).collect()]
    assert got == [(1.0, True), (0.2, False), (0.5, False), (1.0, True)]
    assert one(spark, S.quality_bucket(F.lit("unit-tests"), F.lit(True), F.lit(100.0), F.lit(100.0))) == "1.10.10"


def test_trace_kind(spark):
    d = spark.createDataFrame([("judge_packet",), ("x_hang_fix_01",), ("a_Stub_Fix_02",), ("semantic_repair_1",), ("repair",)], "s string")
    assert [r[0] for r in d.select(S.trace_kind(F.col("s"))).collect()] == ["gen", "gen", "compile_fix", "semantic_repair", "gen"]


SCORE = "stage string, item_id string, path string, score double, passed boolean, bucket string, hit_cap boolean, timed_out boolean, tokens_total long, extraction_failed boolean, tier int"


def scores(spark, *rows):
    return spark.createDataFrame([("s", "i", p, sc, ps, b, hc, to, tk, tk == 0, 1) for p, sc, ps, b, hc, to, tk in rows], SCORE)


def test_normalise(spark):
    d = scores(spark, ("a", 1.0, True, "1", False, True, 100), ("b", 0.0, False, "0", False, True, 300), ("c", 1.0, True, "1", True, False, 200), ("d", 1.0, True, "1", False, False, 0))
    got = {r.path: (r.tokens_norm, r.advantage, r.sft_weight, r.tier) for r in S.normalise(d).collect()}
    assert got == {"a": (0.0, 0.25, 1.0, 2), "b": (1.0, -0.75, 0.0, 2), "c": (0.5, 0.25, 0.0, 2), "d": (1.0, 0.25, 0.8, 2)}
    alone = S.normalise(scores(spark, ("a", 1.0, True, "1", False, False, 100))).first()
    assert alone.tokens_norm == 0.0


def test_pairs_ties(spark):
    d = scores(spark, ("b", 1.0, True, "1", False, False, 100), ("a", 1.0, True, "1", False, False, 100), ("c", 1.0, True, "1", False, False, 150), ("d", 0.0, False, "0", False, False, 1))
    acc = [(r.chosen.path, r.rejected.path) for r in S.accuracy_pairs(d).collect()]
    eff = [(r.chosen.path, r.rejected.path) for r in S.efficiency_pairs(d).collect()]
    assert acc == [("a", "d")] and eff == [("a", "c")]


def test_majority(spark):
    d = spark.createDataFrame([("j", 1, "x", "1", None, 50), ("j", 2, "y", "1", None, 10), ("j", 3, "y", "1", None, 20), ("k", 1, "x", "1", None, 5), ("k", 2, "y", "1", None, 9), ("l", 2, None, None, "e", -1), ("l", 1, None, None, "e", -1)], "job string, attempt_no int, output string, call_number string, error string, score int")
    assert {r.job: r.attempt_no for r in S.majority_attempt(d, "job").collect()} == {"j": 3, "k": 2, "l": 1}


def test_coverage_text(spark):
    text = ["        -:    0:Source:x/test_mode.c", "        1:    1:int test_mode(void) {", "    #####:    2:    return 1;", "        -:    3:}"]
    d = spark.createDataFrame([(x,) for x in text], "line string").select(F.lit("f").alias("file"), C.parse_line(F.col("line")).alias("p")).select("file", "p.*")
    r = C.summarise(C.in_ranges(d, spark.createDataFrame([("f", "g", 1, 2)], "file string, name string, start_line int, end_line int")), ["file", "name"]).first()
    assert (r.covered, r.executable, r.coverage_pct, r.missed) == (1, 2, 50.0, [2])
    empty = d.where("line_no = 3")
    assert C.summarise(empty, ["file"]).first().coverage_pct == 0.0 and C.summarise(empty, ["file"], 100.0, True).first().coverage_pct == 100.0


def test_histogram_edges(spark):
    d = spark.createDataFrame([("s", 1.0), ("s", 0.0), ("s", 0.05), ("s", 0.95)], "setup string, v double")
    assert {r.bin: r.share for r in A.histogram(d, "setup", "v").collect()} == {19: 0.5, 0: 0.25, 1: 0.25}


def test_cycle_is_a_leaf(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    got = {(tuple(r.path), r.is_leaf) for r in G.expand(e, spark.createDataFrame([("a",)], "root string"), 10).collect()}
    assert got == {(("a",), False), (("a", "b"), False), (("a", "b", "a"), True)}


def test_highest_parents(spark):
    e = spark.createDataFrame([("main", "x"), ("x", "f"), ("y", "f"), ("z", "z"), ("f", "g")], "src string, dst string")
    assert {r.node for r in G.highest_parents(e, "f").collect()} == {"main", "y"}


def test_leaf_first_keeps_duplicates(spark):
    d = spark.createDataFrame([("init", "1", "b.c", 1), ("init", "2", "a.c", 0), ("x", None, "c.c", 2)], "id string, depth string, file string, pos int")
    assert [r.file for r in P.leaf_first(d).collect()] == ["a.c", "b.c", "c.c"]


def test_ambiguous_source(spark):
    files = spark.createDataFrame([("foo/main.c",), ("bar/main.c",), ("one.c",)], "path string")
    asked = spark.createDataFrame([("main.c",), ("foo/main.c",), ("one.c",), ("no.c",)], "source string")
    assert {r.source: (r.path, r.status) for r in L.unique_suffix(asked, files).collect()} == {"main.c": (None, "ambiguous"), "foo/main.c": ("foo/main.c", "ok"), "one.c": ("one.c", "ok"), "no.c": (None, "missing")}


def test_overlay(spark):
    d = spark.createDataFrame([(1, "a/x", "1"), (2, "a/.wh.x", ""), (3, "a/y", "3"), (1, "b/c/z", "1"), (2, "b/.wh..wh..opq", ""), (3, "b/c/w", "3"), (4, "a/x", "4")], "layer int, path string, content string")
    assert {r.path: r.content for r in L.overlay(d).collect()} == {"a/x": "4", "a/y": "3", "b/c/w": "3"}


def test_fuzzy(spark):
    names = spark.createDataFrame([("n1", "read_sensor_value"), ("n2", "abc"), ("n3", "exact")], "name string, key string")
    docs = spark.createDataFrame([("d1", "read_sensor_values"), ("d2", "other"), ("d3", "exact"), ("d4", "abcd")], "doc string, key string")
    assert [(r.name, r.doc, r.rank) for r in L.fuzzy(names, docs).orderBy("name").collect()] == [("n1", "d1", 1), ("n3", "d3", 1)]


@pytest.mark.parametrize("least", [0.8, 0.9, 0.95])
def test_similar_keys_by_brute_force(spark, least):
    """Every pair is found, though most keys begin alike and some are short."""
    import difflib
    import random

    r = random.Random(int(100 * least))
    word = lambda k: "".join(r.choices("abcd", k=k))
    names = [("common_" * (k % 2)) + word(k % 14) for k in range(120)]
    docs = []
    for w in names:
        x = list(w)
        for _ in range(r.randrange(3)):
            at = r.randrange(len(x) + 1)
            x[at : at + r.randrange(2)] = word(r.randrange(2))
        docs.append("".join(x))
    frame = lambda keys, n: spark.createDataFrame(list(enumerate(keys)), f"{n} long, key string")
    got = {(x.a, x.b): x.ratio for x in L.similar_keys(frame(names, "name"), frame(docs, "doc"), least).collect()}
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    assert got == {(a, b): ratio(a, b) for a in set(names) for b in set(docs) if a != b and ratio(a, b) >= least}


def test_similar_keys_meet_few_others(spark):
    """Unlike keys hardly meet, pairs with as many unmatched characters as there may be are found."""
    import difflib
    import random

    r = random.Random(3)
    docs = ["name-" + "".join(r.choices("01234567", k=32)) for _ in range(3000)]
    names = []
    for d in docs[:150]:
        x = list(d)
        for _ in range(3):
            at = r.randrange(len(x) + 1)
            x[at : at + 1] = r.choice("01234567")
        x.insert(r.randrange(len(x) + 1), r.choice("01234567"))
        names.append("".join(x))
    a, b = (spark.createDataFrame([(k,) for k in keys], "key string") for keys in (names, docs))
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    got = {(x.a, x.b) for x in L.similar_keys(a, b).collect()}
    assert got >= {(x, y) for x, y in zip(names, docs) if x != y and ratio(x, y) >= 0.9} and len(got) > 50
    assert L._meetings(a, b, 0.9).select("a", "b").distinct().count() < 6000


def test_asked_for(spark):
    """All rows whose hash is asked for stay, negative ones too, and hardly any others."""
    d = spark.range(20000).selectExpr("xxhash64(id) as part", "cast(id as string) as b", "id")
    kept = {r.id for r in L._asked_for(d, d.where("id % 100 = 0").select("part")).collect()}
    assert kept >= set(range(0, 20000, 100)) and len(kept) < 220


def test_usage_by_levels(spark):
    """As the walk of one text has it."""
    import json

    from harrow.functions.udfs import usage
    from harrow.operators.usage import usage_totals

    rows = [{"tokens": 1, "b": {"input_tokens": 2, "total_tokens": 5, "max_tokens": 9}, "c": [{"tokens": 1.9}, [{"Tokens": 3}], "tokens"]}, [{"tokens": True, "n": 4}], 5, {"body": json.dumps({"body": json.dumps({"token_count": 7})}), "other": '{"n": 1}', "bad": "token {"}, {"tokens": None, "t_tokens": "4", "x_tokens": -3}, {"total_tokens": 1, "TotalTokens": 4, "a_tokens": 2}, {}]
    texts = [*map(json.dumps, rows), "token", None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {x.i: x.tokens for x in usage_totals(d, "i", "t").collect()}
    assert got == {i: usage(rows[i]) if i < len(rows) else 0 for i in range(len(texts))}
    assert "Python" not in usage_totals(d, "i", "t")._jdf.queryExecution().toString()


def test_usage_row_by_row(spark, monkeypatch):
    """Rows are walked each for itself: keys may repeat or be null, and nothing is shuffled or written. Levels may be many, also in texts within texts."""
    import json

    from harrow.operators.usage import usage_totals
    from harrow.sources import scratch

    monkeypatch.setattr(scratch, "cut", lambda df: pytest.fail("a table was written"))
    monkeypatch.setattr("harrow.operators.calls.cut", scratch.cut)
    deep, told = "[" * 300 + '{"tokens": 5}' + "]" * 300, {"tokens": 6}
    for _ in range(7):
        told = {"body": json.dumps([told])}
    escaped = '{"a": "\\u007b\\u0022token\\u0022: 7}"}'
    wide = json.dumps({"steps": [{"tokens": 1, "more": [{"x": {"total_tokens": 2}}]}] * 500})
    texts = ['{"tokens": 1}', '{"tokens": 2}', deep, json.dumps(told), escaped, wide]
    d = spark.createDataFrame([(key, t) for t in texts for key in (1, None)], "i long, t string")
    got = usage_totals(d, "i", "t")
    assert sorted((r.i or 0, r.tokens) for r in got.collect()) == sorted((i, n) for n in (1, 2, 5, 6, 7, 1500) for i in (1, 0))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_expected_pairs_of_any_number_of_setups(spark, monkeypatch):
    tasks, seen = spark.range(3).selectExpr("concat('t', id) as task_id"), spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "setup string")
    want = {(f"t{k}", s) for k in range(3) for s in "ab"}
    for most in (10, 1):
        monkeypatch.setattr(R, "SETUPS", most)
        assert {tuple(r) for r in R.expected(tasks, seen).collect()} == want
    assert R.expected(tasks, seen.where("false")).count() == 0


def test_prototypes_and_aliases(spark):
    asked = spark.createDataFrame([("f",), ("g",), ("h",)], "function_name string")
    known = spark.createDataFrame([("f", "int f(void);"), ("h", None)], "function_name string, prototype string")
    assert {r.function_name: r.message for r in L.prototypes(asked, known).collect()} == {"f": "Prototype: int f(void);\n", "g": L.NOT_STORED, "h": L.NOT_STORED}
    assert {r.message for r in L.prototypes(asked, None).collect()} == {L.NO_REGISTRY}
    macros = spark.createDataFrame([("M", "N"), ("N", "f"), ("X", "Y"), ("Y", "X")], "name string, value string")
    defs = spark.createDataFrame([("f", "a.c", True, "[a.c]f"), ("f", "b.c", False, "f")], "name string, file_name string, is_static boolean, unique_id string")
    calls = spark.createDataFrame([(1, "a.c", "M"), (2, "c.c", "M"), (3, "a.c", "X"), (4, "a.c", "f"), (5, "a.c", "z")], "id int, file_name string, callee string")
    assert {r.id: (r.callee, r.expanded, r.target, r.is_external) for r in L.resolve_aliases(calls, macros, defs).collect()} == {1: ("M", "f", "[a.c]f", False), 2: ("M", "f", "f", False), 3: ("X", "X", "X", True), 4: ("f", "f", "[a.c]f", False), 5: ("z", "z", "z", True)}


def test_answer_pieces(spark):
    for text, want in {"a:1,b": ["1", "b"], '"x:y:z",:': ["y", ""], "": [""], 'k:"v"': ["v"]}.items():
        assert one(spark, F.struct(T.answer_pieces(F.lit(text)).alias("v"))).v == want


def test_only_setup(spark):
    d = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "folder string, setup string")
    assert {tuple(r) for r in A.only_setup(d, ["folder"]).collect()} == {("a", "x"), ("b", "y")}
    for bad in (d, d.where("false")):
        with pytest.raises(Exception, match="expected one setup"):
            A.only_setup(bad).collect()


def test_resolved_paths(spark):
    d = spark.createDataFrame([("/a/./b/../c",), ("x/../y",), ("../../..",), ("/",), ("a//b/",), (None,)], "p string")
    assert [x.r for x in d.select(X.resolved_path(F.col("p"), "/t/u").alias("r")).collect()] == ["/a/c", "/t/u/y", "/", "/", "/t/u/a/b", None]
    s = one(spark, F.struct(*[X.below(F.lit(a), F.lit(b)).alias(f"c{k}") for k, (a, b) in enumerate((("/a/b", "/a"), ("/a", "/a"), ("/ab", "/a"), ("/x", "/")))]))
    assert tuple(s) == (True, True, False, True)


def test_verification(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x]) if x else F.array().cast("array<string>")
    s = one(spark, X.set_filters(arr("lib", "other"), arr("lib"), arr("lib")))
    assert (s.missing, s.present, s.shadowed_required) == (["lib", "other"], [], ["lib"])
    assert one(spark, X.hard_pass(F.lit(True), arr(), arr(), F.lit(None).cast("int"), F.lit(None).cast("int"))) is True
    assert one(spark, X.hard_pass(F.lit(True), arr(), arr("a"), F.lit(0), F.lit(0))) is False


def test_loose_json(spark):
    d = spark.createDataFrame([('say {"a": 1} ok',), ('```json\n{"a": 2}\n```',), ("none",)], "x string")
    assert [r[0] for r in d.select(F.try_variant_get(X.loose_json(F.col("x")), "$.a", "int")).collect()] == [1, 2, None]


def test_booleans_are_no_numbers(spark):
    d = spark.createDataFrame([('{"v": true}',), ('{"v": 1}',), ('{"v": 0.5}',), ('{"v": "1"}',), ('{"v": 2}',)], "x string")
    assert [r[0] for r in d.select(A.number_in(F.try_variant_get(F.parse_json("x"), "$.v", "variant"))).collect()] == [False, True, True, False, False]


def test_usage():
    body = {"usage": {"prompt_tokens": 17, "completion_tokens": 1, "total_tokens": 18, "details": {"cached_tokens": 0}}}
    assert U.usage(body) == 18
    assert U.usage({"max_tokens": 9, "input_tokens": True, "output_tokens": 3.9, "x": '{"tokens": 5}'}) == 8
    assert U.usage([{"token": 1}, {"n": [{"tokens_total": 2, "a_tokens": 5}]}]) == 6


def test_fingerprint(spark):
    import hashlib

    want = hashlib.sha256('{"a": [1, "é"], "b": null}'.encode()).hexdigest()
    d = spark.createDataFrame([('{"b":null,"a":[1,"\\u00e9"]}',), ("no",)], "x string")
    assert [r[0] for r in d.select(U.canonical_sha256("x")).collect()] == [want, None]


C_CODE = """#include <x.h>
/* int hidden(void) { } */
static int helper(int a) { return a; }
char *s = "int fake(void) {";
void test_init(void)
{
    init(); // call(
    reg(handler, &other, 3);
    (*fp)(1);
}
int main(void) { CU_add_test(local_suite, "init", test_init); return helper(1); }
"""


def test_c_text(spark):
    defs = U.definitions_of(C_CODE)
    assert defs == [("helper", True, 3, 3), ("test_init", False, 5, 10), ("main", False, 11, 11)]
    calls = U.calls_of(C_CODE, "indirect")
    assert ("init", 7, []) in calls and ("reg", 8, ["handler", "other"]) in calls and ("helper", 11, []) in calls and ("indirect_call", 9, []) in calls
    assert not {"hidden", "fake", "call", "test_init"} & {c[0] for c in calls}
    d = spark.createDataFrame([(C_CODE,)], "x string")
    row = d.select(U.c_definitions("x").alias("d"), U.c_calls("x").alias("c"), U.blank_comments("x").alias("b"), U.function_body("x", F.lit("test_init")).alias("f"), U.prefixed_tests("x", F.lit("p__init")).alias("t")).first()
    assert len(row.d) == 3 and len(row.b) == len(C_CODE) and "hidden" not in row.b and row.b.count("\n") == C_CODE.count("\n")
    assert row.f.startswith("void test_init") and row.f.endswith("}")
    assert "void p__init_test_init" in row.t and "init();" in row.t and 'CU_add_test(suite, "init", p__init_test_init);' in row.t


def test_decoding_and_rebase(spark):
    d = spark.createDataFrame([(bytearray("日本".encode("euc_jp")),), (bytearray(b"plain"),), (bytearray(b"\xff\xfe\x81"),), (None,)], "b binary")
    got = [r[0] for r in d.select(U.decoded()("b")).collect()]
    assert got[:2] == ["日本", "plain"] and got[2] is not None and got[3] is None
    assert U.rebased({"a": ["/x/y/z", 1]}, [("/x", "/p"), ("/x/y", "/q")]) == {"a": ["/q/z", 1]}
    assert U.json_safe({1: {3, 2}, "n": float("nan"), "t": (1,)}) == {"1": [2, 3], "n": None, "t": [1]}


def test_register(spark):
    U.register(spark)
    assert spark.sql("select usage_tokens('{\"a_tokens\": 4}') as n").first().n == 4


def test_ranges_across_blocks(spark):
    """Every line and every range that holds it, as by comparing all, with ranges within others and over several blocks."""
    import random

    rng = random.Random(5)
    ranges = [(f, f"r{i}", a, a + rng.choice([0, 5, 255, 256, 900])) for f in ("a", "b") for i, a in enumerate(rng.sample(range(1, 2000), 20))]
    lines = [(f, n) for f in ("a", "b", "c") for n in range(1, 2200, 7)]
    got = C.in_ranges(spark.createDataFrame(lines, "file string, line_no int"), spark.createDataFrame([*ranges, ("a", "void", 9, 3)], "file string, name string, start_line int, end_line int")).select("file", "line_no", "name").collect()
    assert sorted(map(tuple, got)) == sorted((f, n, r) for f, n in lines for g, r, a, b in ranges if f == g and a <= n <= b)


def test_segments_of_similar_keys():
    from harrow.operators.lookups import _cuts, unmatched

    assert unmatched(77, 0.9) == 7 and unmatched(20, 0.9) == 2 and unmatched(2, 0.9) == 0
    for weights in ([0.001] * 6 + [4.0] * 32, [1.0] * 9, [9.0] + [0.001] * 8, [0.001] * 8 + [9.0]):
        for m in range(1, 9):
            got = _cuts(weights, m)
            assert len(got) == m and all(n > 0 for _, n in got) and [s for s, _ in got] == [sum(n for _, n in got[:k]) for k in range(m)] and sum(n for _, n in got) == len(weights)
    # what all keys begin with makes no segment of its own
    assert _cuts([0.001] * 6 + [4.0] * 32, 8)[0] == (0, 10)


def test_written_calls_give_every_policy():
    positions = {"f": [2], "g": [1, 3], "t.m[i]": [1]}
    for code in (C_CODE, "void a(void) {\n  f(&cb, (int)x, g(1));\n  s->run(h, h);\n  (*fp)(k);\n  t.m[i](cb);\n}\n", "", None):
        every = U.written_calls_of(code)
        names = lambda ns: list(dict.fromkeys(n for n in ns if n))
        assert [(c, n, names(a)) for c, w, n, a in every if c == w] == U.calls_of(code)
        assert [(c, n, names(a)) for c, _, n, a in every] == U.calls_of(code, "indirect") and [(w, n, names(a)) for _, w, n, a in every] == U.calls_of(code, "text")
        assert [(c, n, names(a[p - 1] for p in positions.get(w, []) if p <= len(a))) for c, w, n, a in every] == U.calls_of(code, "indirect", positions)


def test_equal_texts_are_gone_through_once(monkeypatch):
    import pyarrow as pa

    seen, walk = [], U.written_calls_of
    monkeypatch.setattr(U, "written_calls_of", lambda t: seen.append(t) or walk(t))
    got = U.c_written_calls.func(pa.array(["f(a);", None, "f(a);", "g(1);"])).to_pylist()
    assert sorted(seen) == ["f(a);", "g(1);"] and got[1] is None and got[0] == got[2] and got[3][0]["written"] == "g"


def test_maps_are_made_once(spark):
    d = spark.range(1).select(F.split(F.lit("a=1,b=2,a=3"), ",").alias("items"))
    plan = lambda c: d.select(c.alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan(X.env_map(F.col("items"))).count("substring_index") == 1
    assert plan(X.mount(F.lit("src=/a,dst=/b"))).count("substring_index") == 1
