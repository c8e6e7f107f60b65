"""Telling terms are marked wherever they stand, and rare entities have them too."""

import pytest

from harrow.llm import pii

PLAIN = [(100 + k, f"plan {k} about the wrote note to") for k in range(2000)]  # so many that a term of two documents can tell a rare entity


def terms_of(spark, rows):
    out = {}
    for r in pii.find(spark.createDataFrame(rows + PLAIN, "doc_id long, text string")).collect():
        text = dict(rows + PLAIN)[r.doc_id]
        out[r.doc_id] = [(int(s), text[int(s) : int(e)]) for kind, s, e in (x.split(":") for x in r.spans.split(",") if x) if kind == "term"]
    return out


def test_terms_far_from_their_entity(spark):
    rows = [(k, f"note {k} zebulon wrote to joe@x.org about the {w} plan") for k, w in enumerate(("red", "blue", "green", "grey"))]
    far = "Zebulon, and zebulon@x.org " + "plan " * 30 + "joe@x.org"
    got = terms_of(spark, rows + [(10, "the note of Zebulon to the plan")])
    assert got[10] == [(12, "Zebulon")] and all(t == [] for k, t in got.items() if k >= 100)
    assert [t for _, t in got[0]] == ["zebulon"]
    got = terms_of(spark, rows + [(11, far)])
    assert (0, "Zebulon") in got[11] and not any(s == far.index("zebulon@") for s, _ in got[11])


def test_rare_entities(spark):
    got = terms_of(spark, [(1, "note to quimby about 10.1.2.3 wrote the plan"), (2, "quimby")])
    assert got[1] == [(8, "quimby")] and got[2] == [(0, "quimby")]


def test_short_terms_and_terms_with_digits(spark):
    """Two letters, or digits, tell as much as any other word."""
    got = terms_of(spark, [(1, "note to qz 10.1.2.3 wrote room b52 the plan"), (2, "qz, B52")])
    assert [t for _, t in got[1]] == ["qz", "room", "b52"] and [t for _, t in got[2]] == ["qz", "B52"]


def test_clashing_columns_and_no_rows(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(1, "a@b.co"), (1, "a@b.co"), (2, None), (3, "")], "doc_id long, text string")
    odd = d.select("*", *[F.lit(1).alias(c) for c in ("th", "what", "term", "start", "spans", "_id", "base", "entity")])
    rows = lambda x: sorted((r.doc_id, r.n_email, r.spans) for r in pii.find(x).collect())
    assert rows(odd) == rows(d) == [(1, 1, "email:0:6"), (1, 1, "email:0:6"), (2, 0, ""), (3, 0, "")] and pii.find(odd.where("false")).count() == 0


def test_rows_of_one_id_have_their_own_places(spark):
    rows = [(1, "note to quimby about 10.1.2.3 wrote the plan"), (1, "about quimby")]
    d = spark.createDataFrame(rows + PLAIN, "doc_id long, text string")
    assert sorted(r.spans for r in pii.find(d).where("doc_id = 1").collect()) == ["ip:21:29,term:8:14", "term:6:12"]


@pytest.mark.parametrize("gap", ["." * 3000, " " + "x" * 3000 + " "])
def test_near_looks_as_far_as_its_words(gap):
    text = f"alpha beta{gap}10.1.2.3{gap}gamma delta"
    at = text.index("10.1")
    words = [w for w, _, _ in pii.near(text, at, at + 8, 10)]
    assert words[:2] == ["alpha", "beta"] and words[-2:] == ["gamma", "delta"]
    many = "one two three four five six seven eight nine ten eleven twelve " + "." * 640 + "10.1.2.3"
    assert [w for w, _, _ in pii.near(many, len(many) - 8, len(many), 10)] == "three four five six seven eight nine ten eleven twelve".split()
