"""The sanitised text holds no base span and no telling term."""

from harrow.llm import pii

PLAIN = [(100 + k, f"plan {k} about the wrote note to") for k in range(60)]


def test_sanitised_texts(spark):
    rows = [(k, f"note {k} zebulon wrote to joe@x.org about the {w} plan") for k, w in enumerate(("red", "blue", "green", "grey"))] + [(10, "the note of Zebulon"), (11, None), (None, "call +1 (555) 010-9999"), (12, "")]
    d = spark.createDataFrame([(i, t, 1) for i, t in rows + PLAIN], "doc_id long, text string, doc int")
    out = pii.sanitise(d)
    got = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == d.columns and len(got) == len(rows + PLAIN)
    assert got[0] == "note 0 [TERM] wrote to [EMAIL] about the red plan" and got[10] == "the note of [TERM]"
    assert got[11] is None and got[None] == "[TERM] [PHONE]" and got[12] == "" and all(got[i] == t for i, t in PLAIN)
    assert {r.text for r in pii.sanitise(d, remove=True).where("doc_id = 10").collect()} == {"the note of "}


def test_the_spans_of_the_query_are_those_that_go(spark, docs):
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    spans = {r.doc_id: r.spans for r in pii.find(docs.where("doc_id is not null")).collect()}
    got = {r.doc_id: r.text for r in pii.sanitise(docs.where("doc_id is not null")).collect()}
    for i, text in texts:
        if i is not None and text is not None:
            terms = [tuple(map(int, x.split(":")[1:])) for x in spans[i].split(",") if x.startswith("term:")]
            assert got[i] == pii.redact(text, terms) and (spans[i] == "") == (got[i] == text)


def test_overlapping_spans():
    text = "a 4111 1111 1111 1111 b +4111 1111 1111 c"
    assert "1111" not in pii.redact(text, [(0, 1)]) and pii.redact(text, [(0, 1)]).startswith("[TERM] [CARD] b ")
