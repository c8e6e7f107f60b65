"""Sources and sinks on small files."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from harrow.sources import files as S
from harrow.sources import sinks as K
from harrow.streaming import tables as T


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_jsonl_and_latest(spark, tmp_path):
    write(tmp_path / "results.jsonl", '{"task_id": "t1", "setup": "s", "n": 1}\n\nbad\n[1]\n{"task_id": "t1", "setup": "s", "n": 2}\n{"task_id": "", "setup": "s", "n": 3}\n{"task_id": "t1", "setup": "s", "n": 4, "extra": 1}\n')
    rows, rejects = S.jsonl(spark, str(tmp_path))
    assert rows.count() == 4 and {r.line_no for r in rejects.collect()} == {3, 4}
    typed = S.exact_rows(rows, StructType.fromDDL("task_id string, setup string, n int"))
    assert [(r.task_id, r.n) for r in S.results_latest(typed, ["task_id", "setup"]).collect()] == [("t1", 2)]


def test_tasks(spark, tmp_path):
    write(tmp_path / "tasks.jsonl", '{"id": "a", "question": "q"}\n\n{"question": "q2", "answer": "x", "required": ["f"]}\n')
    rows = {r.id: (r.question, r.answer, r.required) for r in S.tasks(*S.jsonl(spark, str(tmp_path))).collect()}
    assert rows == {"a": ("q", "", []), "task_00001": ("q2", "x", ["f"])}
    write(tmp_path / "more" / "tasks.jsonl", "".join(f'{{"question": "q", "id": {i}}}\n\n' for i in ('"x"', '""', "0", "false", "[]", "{}", "null", '"y"')))
    assert [r.id for r in S.tasks(*S.jsonl(spark, str(tmp_path / "more"))).orderBy("line_no").collect()] == ["x", *(f"task_{k:05d}" for k in range(1, 7)), "y"]
    for bad in ('{"question": "q", "id": " \\t"}', '{"question": "q", "id": 5}', '{"question": "q", "required": null}', '{"question": "\\u00a0"}', '{"id": "a"}', '{"question": " "}', '{"question": "q", "required": [1]}', '{"question": "q", "answer": 1}', "[]"):
        write(tmp_path / "bad" / "tasks.jsonl", bad)
        with pytest.raises(ValueError, match="tasks.jsonl:1"):
            S.tasks(*S.jsonl(spark, str(tmp_path / "bad")))


def test_line_numbers_of_split_files(spark, tmp_path, monkeypatch):
    """Blocks of a few bytes, lines longer than a block, all kinds of line ends, files of the same name."""
    texts = {"a.jsonl": "\n".join("x" * (k % 37) for k in range(300)), "d/a.jsonl": "one\r\ntwo\n\n\nthree" + "y" * 500 + "\nend\n", "e.jsonl": ""}
    for name, text in texts.items():
        write(tmp_path / name, text)
    want = {(name, k, line) for name, text in texts.items() for k, line in enumerate(text.splitlines(), 1)}
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("64b", "1000b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "10b")
            for few in (S.BLOCKS, 0):
                monkeypatch.setattr(S, "BLOCKS", few)
                d = S.numbered_lines(spark, str(tmp_path), "*.jsonl")
                got = [(r.path.rsplit(tmp_path.name + "/", 1)[1], r.line_no, r.line) for r in d.collect()]
                assert len(got) == len(want) and set(got) == want
        assert d.select("path", "block").distinct().count() > 5
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_traces_and_backfill(spark, tmp_path):
    write(tmp_path / "e1" / "gen.result.json", '{"elapsed": 1.5}')
    write(tmp_path / "e1" / "gen.json", '{"a_tokens": 2}')
    write(tmp_path / "e1" / "fix.result.json", "broken")
    write(tmp_path / "e1" / "metadata.json", "{}")
    write(tmp_path / "e2" / "metadata.json", "{}")
    write(tmp_path / "e1" / "score.json", "{}")
    got = {r.stem: r.main for r in S.traces(spark, str(tmp_path)).collect()}
    assert got == {"gen": '{"a_tokens": 2}', "fix": None}
    left = S.unscored(S.json_files(spark, str(tmp_path), "metadata.json"), S.json_files(spark, str(tmp_path), "score.json"))
    assert [r.dir.rsplit("/", 1)[1] for r in left.collect()] == ["e2"]


def test_rounds_and_depth(spark, tmp_path):
    for n in ("results.jsonl", "results_2.jsonl", "results_x.jsonl"):
        write(tmp_path / n, "{}")
    write(tmp_path / ".git" / "results_3.jsonl", "{}")
    write(tmp_path / "a" / "b" / "results_4.jsonl", "{}")
    f = S.text_files(spark, str(tmp_path), "*.jsonl", depth=1, skip=(".git",))
    assert {r.round for r in S.rounds(f).collect()} == {0, 2}


def test_coverage_files(spark, tmp_path):
    write(tmp_path / "a.gcov", "        -:    0:Source:/p/tests/x.c\n        1:    1:y\n")
    write(tmp_path / "b.gcov", "        -:    0:Source:/p/src/x.c\n        1:    1:int f(void) {\n    #####:    2:  return 1;\n")
    d = S.coverage_lines(spark, str(tmp_path), "/p/src/x.c", "/p/tests")
    assert [(r.count_text, r.line_no) for r in d.orderBy("line_no").collect()] == [("1", 1), ("#####", 2)]
    write(tmp_path / "c.gcov", "        -:    0:Source:../src/y.c\n        3:    1:z\n")
    write(tmp_path / "d.gcov", "        -:    0:Source:x.c\n        3:    1:z\n")
    write(tmp_path / "e.gcov", "        -:    0:Source:/q/src/x.c\n        3:    1:z\n")
    write(tmp_path / "deep" / "f.gcov", "        -:    0:Source:/p/src/w.c\n        3:    1:z\n")
    write(tmp_path / "g.gcov", "no source\n")
    wanted = spark.createDataFrame([(x,) for x in ("/p/src/./x.c", "/p/src/y.c", "/q/src/x.c", "/p/tests/x.c", "/p/src/w.c")], "source string")
    got = S.coverage_lines(spark, str(tmp_path), wanted, "/p/tests", "/p/src")
    assert {(r.wanted, r.name) for r in got.collect()} == {("/p/src/./x.c", "b.gcov"), ("/p/src/y.c", "c.gcov")}


def test_episode_details(spark, tmp_path):
    from harrow.sources import episodes as E

    write(tmp_path / "e1" / "semantic_context.json", '{"functions": {"f": 1}}')
    write(tmp_path / "e2" / "semantic_context.json", '{"functions": [1]}')
    write(tmp_path / "e3" / "semantic_context.json", "[1]")
    write(tmp_path / "deep" / "x" / "stub.c", "int f;")
    write(tmp_path / "deep" / "x" / "result.json", '{"validated": true}')
    at = str(tmp_path)
    wanted = spark.createDataFrame([(f"{at}/e{k}",) for k in range(1, 5)], "episode string")
    got = {r.episode[-2:]: json.loads(r.j) for r in E.semantic_contexts(spark, at, wanted).select("episode", F.to_json("row").alias("j")).collect()}
    assert got == {"e1": {"functions": {"f": 1}}, "e2": {"functions": {}}, "e3": {"functions": {}}, "e4": {"functions": {}}}
    assert E.validated_stubs(spark, at).count() == 0 and E.validated_stubs(spark, f"{at}/deep").count() == 1
    d = spark.createDataFrame([(i, f'{{"v": {v}}}') for i, v in enumerate(("true", "0", "0.0", '""', '"0"', "[]", "[0]", "null", "{}", "-1"))], "i int, j string").select("i", F.parse_json("j").alias("row"))
    assert [r.i for r in d.where(E.truthy("row", "v")).orderBy("i").collect()] == [0, 4, 6, 9]
    plan = E.listing(spark, at)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_selected_tables(spark, tmp_path):
    at = str(tmp_path / "t")
    d = spark.createDataFrame([("a", True, 1), ("b", False, 2)], "item string, passed boolean, n int")
    K.select_items(d, at)
    K.select_items(d.where("item = 'a'"), at)
    assert [(r.item, r.n) for r in spark.read.json(at).collect()] == [("a", 1)]
    wanted = d.select("item")
    assert not K.materialise(d, wanted, f"{at}2") and K.materialise(d, wanted.where("item = 'a'"), f"{at}2") and not K.materialise(d, wanted.where("false"), f"{at}2")


def test_http_trace(spark):
    body = {"usage": {"total_tokens": 18}}
    msg = {"metadata": {"rawHttpTrace": {"modelId": "m", "interactions": [{"request": {"headers": {}}, "response": {"status": 200, "body": body}}, {"response": {"status": 500, "body": json.dumps(body)}}]}}}
    d = spark.createDataFrame([(1, json.dumps(msg)), (2, "{}")], "id int, j string").select("id", F.parse_json("j").alias("row"))
    assert [(r.id, r.model, r.pos, r.status, json.loads(r.usage)) for r in S.trace_interactions(d).orderBy("pos").collect()] == [(1, "m", 0, 200, {"total_tokens": 18}), (1, "m", 1, 500, {"total_tokens": 18})]


def test_flat_csv(spark, tmp_path):
    d = spark.createDataFrame([Row(a=Row(b=1, c=Row(d=-1)), e=["x", "y"], f="NA")], "a struct<b:int,c:struct<d:int>>, e array<string>, f string")
    assert K.flat(d).columns == ["a->b", "a->c->d", "e", "f"]
    K.append_csv(d, str(tmp_path / "out"))
    K.append_csv(d, str(tmp_path / "out"))
    got = S.csv_rows(spark, str(tmp_path / "out")).collect()
    assert [tuple(r) for r in got] == [("1", "NA", "x, y", "NA")] * 2


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a/b", 1), ("c", 2)], "setup string, n int")
    K.create(d, str(tmp_path / "x"))
    with pytest.raises(Exception, match="already exists"):
        K.create(d, str(tmp_path / "x"))
    K.append_jsonl(d, str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "x")).count() == 4
    K.by_setup(d, str(tmp_path / "y"))
    assert {r.setup for r in spark.read.json(str(tmp_path / "y")).collect()} == {"a/b", "c"}
    K.append_run(d, str(tmp_path / "r"))
    K.replace(d, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    both = K.union_rows(d, d.withColumn("m", F.lit(1)))
    assert both.count() == 4 and "m" in both.columns


def test_stream_latest_by_deltas(spark, tmp_path):
    """A batch writes its own rows only; deltas are merged and what two merges replaced goes; a lost table raises."""
    src, target, log = (str(tmp_path / x) for x in ("src", "target", "log"))
    keys, want = ["task_id", "setup"], {}
    for k in range(9):
        spark.createDataFrame([("t", "s", k), (f"t{k}", "s", k)], "task_id string, setup string, line_no int").coalesce(1).write.mode("append").json(src)
        want |= {"t": k, f"t{k}": k}
        T.upsert_latest(T.tail(spark, src, "task_id string, setup string, line_no int"), keys, "line_no", target, log, merge=3).awaitTermination()
        assert spark.read.parquet(f"{target}/delta-{k}").count() == 2
        assert {r.task_id: r.line_no for r in T.read_latest(spark, target, keys, "line_no").collect()} == want
    assert T._tables(spark, target) == {"full": [5, 8], "delta": [6, 7, 8]}
    T._drop(spark, f"{target}/delta-8")
    T._drop(spark, f"{target}/full-8")
    spark.createDataFrame([("t", "s", 9)], "task_id string, setup string, line_no int").coalesce(1).write.mode("append").json(src)
    with pytest.raises(Exception, match="delta-8 is not there"):
        T.upsert_latest(T.tail(spark, src, "task_id string, setup string, line_no int"), keys, "line_no", target, log, merge=3).awaitTermination()


def test_resume_as_a_stream(spark, tmp_path):
    src, target, log, have = str(tmp_path / "src"), str(tmp_path / "target"), str(tmp_path / "log"), [("a", 1)]

    def run():
        d = T.tail(spark, src, "task_id string, n int")
        T.outstanding(d, lambda: spark.createDataFrame(have, "task_id string, other int"), ["task_id"], target, log).awaitTermination()
        return sorted((r.task_id, r.batch) for r in T.asked_so_far(spark, target).collect())

    spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "task_id string, n int").coalesce(1).write.json(src)
    assert run() == [("b", 0)] and run() == [("b", 0)]
    spark.createDataFrame([("c", 1), ("b", 2), ("a", 5)], "task_id string, n int").coalesce(1).write.mode("append").json(src)
    have.append(("d", 1))
    assert run() == [("b", 0), ("c", 1)] and run() == [("b", 0), ("c", 1)]


def test_best_attempts_over_batches(spark, tmp_path):
    """Ties go to the later attempt; state outlives a batch and a restart; idle keys are closed once and begin anew."""
    src, log, out = str(tmp_path / "src"), str(tmp_path / "log"), []
    schema = "item string, at timestamp, attempt long, score double"

    def run(rows):
        spark.createDataFrame([(i, f"2024-01-01 {t}:00", n, s) for i, t, n, s in rows], "item string, at string, attempt long, score double").selectExpr("item", "cast(at as timestamp) as at", "attempt", "score").coalesce(1).write.mode("append").parquet(src)
        d = T.best_attempts(T.tail(spark, src, schema, "parquet"), "item", "at", "attempt", "score", "600000", "1 minute")
        before = len(out)
        T.started(d.writeStream.foreachBatch(lambda b, n: out.extend(tuple(r) for r in b.collect())).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True)).awaitTermination()
        return sorted(out[before:])

    assert run([("a", "10:00", 1, 5.0), ("a", "10:01", 2, 5.0), ("b", "10:00", 1, None)]) == [("a", "best", 2, 5.0), ("b", "best", 1, 0.0)]
    assert run([("a", "10:02", 3, 4.0), ("b", "10:03", 2, 1.0)]) == [("b", "best", 2, 1.0)]
    assert run([("c", "10:30", 1, 1.0)]) == [("a", "closed", 2, 5.0), ("b", "closed", 2, 1.0), ("c", "best", 1, 1.0)]
    assert run([("a", "10:31", 4, 1.0)]) == [("a", "best", 4, 1.0)]


def test_callees_by_policy():
    from harrow.functions.udfs import calls_of

    code = "int f(int (*cb)(int)) {\n  a(b(1), (c));\n  s->d(2);\n  x.y[3].e(4)(5);\n  (*p)(6); (q)(7);\n  int z = (int)(8) + (size_t)(w);\n  return g(h, &i, (void *)j, 1), sizeof(k);\n}\nif (l) (m)(9);"
    names = lambda policy: [c for c, _, _ in calls_of(code, policy)]
    assert names("identifier") == ["a", "b", "g"]
    assert names("text") == ["a", "b", "s->d", "x.y[3].e", "x.y[3].e(4)", "(*p)", "(q)", "g", "(m)"]
    assert names("indirect") == ["a", "b", *["indirect_call"] * 5, "g", "indirect_call"]
    assert [p for c, _, p in calls_of(code) if c == "g"] == [["h", "i", "j"]]
    assert [p for c, _, p in calls_of(code, positions={"g": [2, 4]}) if c in ("a", "g")] == [[], ["i"]]
    assert [n for _, n, _ in calls_of(code)] == [2, 2, 7] and calls_of(None) == [] and calls_of("a(") == [("a", 1, [])]
    with pytest.raises(ValueError, match="no such policy"):
        calls_of(code, "any")


def test_binary_digest(spark, tmp_path):
    write(tmp_path / "f.bin", "abc")
    assert S.binary(spark, str(tmp_path)).first().sha256.startswith("ba7816bf")


def test_packed_artifacts(spark, tmp_path):
    """Packs and files lie side by side; the readers see both, and packs make no file for each artifact."""
    from harrow.sources import episodes as E

    at = str(tmp_path / "t")
    d = spark.range(300).select(F.concat(F.lit("e"), "id", F.lit("/"), F.when(F.col("id") % 2 == 0, "metadata.json").otherwise("x.txt")).alias("place"), F.concat(F.lit('{"n": '), "id", F.lit("}")).alias("text"))
    K.pack_artifacts(d.where("id < 200"), at)
    K.pack_artifacts(d.where("id >= 200"), at)
    assert sum(1 for _ in tmp_path.rglob("*.parquet")) < 30 and not list(tmp_path.rglob("*.json"))
    write(tmp_path / "t" / "own" / "metadata.json", '{"n": -1}\n')
    there = {(r.inner, r.length) for r in E.listing(spark, at).collect()}
    assert len(there) == 301 and {("e7/x.txt", 9), ("own/metadata.json", 10)} <= there
    assert len(E.objects(spark, at, "metadata.json").collect()) == 151 and S.text_files(spark, at, "*.tx?").count() == 150 and S.text_files(spark, at, "*.txt", depth=0).count() == 0
    K.pack_artifacts(spark.createDataFrame([("a.log", "x\r\n\ry"), ("b.log", "")], "place string, text string"), at)
    assert [(r.name, r.line_no, r.line) for r in S.numbered_lines(spark, at, "*.log").orderBy("name", "line_no").collect()] == [("a.log", 1, "x"), ("a.log", 2, ""), ("a.log", 3, "y"), ("b.log", 1, "")]
    with pytest.raises(FileExistsError):
        K.pack_artifacts(d.where("id = 0"), at)
