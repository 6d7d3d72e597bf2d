"""Toxicity: held-out accuracy on the labelled documents, rules of the grammar, edge cases."""

import zlib

from ledgerlens.llm import toxicity

DIR = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity.rated(docs, labels).collect()}
    assert len(got) == docs.count()
    pairs = [(r.toxic, got[r.doc_id]) for r in labels.collect()]
    for _, g in pairs:
        assert g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0)
        assert 0 <= g.score <= 1 and g.predicted == int(g.score >= 0.5)
    out = [(t, g.predicted) for t, g in pairs if g.held_out]
    wrong = sum(t != p for t, p in out)
    assert wrong <= 0.02 * len(out)
    assert sum(t for t, _ in out) and sum(t and p for t, p in out) >= 0.85 * sum(t for t, _ in out)


def test_scope_and_aim():
    m = toxicity.Matcher({"vill~": 4.0})
    kinds = lambda text: [k for k, _ in m.matches(text)][:-1]
    assert kinds("You are an idiot.") == ["aimed"]
    assert kinds("He is not an idiot.") == ["negated"]
    assert kinds("Somebody said idiot, villain") == ["reported", "reported"]
    assert kinds("An idiot. It is not.") == ["plain"]
    assert kinds("I will kill you") == ["threat"]
    assert kinds("kill the process, it is fine. Villages") == ["plain"]
    assert kinds("kill the process, it is fine. Villageoises") == []


def test_cover_takes_causes_only():
    texts = [(True, ["vile", "once"])] * 4 + [(True, ["vile"])] * 3 + [(True, ["awfu"])] * 3 + [(True, ["rare"])] * 2 + [(False, ["many"])] * 9
    texts += [(True, ["many"])] * 4
    assert list(toxicity.cover(texts, dict.fromkeys(["vile", "once", "awfu", "rare", "many"], 1.0))) == ["vile", "awfu"]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x", 1.0), (2, "", "x", 1.0), (None, "you idiot", "x", 1.0), (3, "word " * 200_000, "x", 0.0),
                                  (3, "word", "x", 0.0)], "doc_id bigint, text string, held_out string, score double")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 0, 0), (2, 0, 1)], none.schema)
    for labels in (none, odd):
        got = sorted(((r.doc_id, r.predicted) for r in toxicity.rated(docs, labels).collect()), key=str)
        assert got == [(1, 0), (2, 0), (3, 0), (3, 0), (None, 1)]
    assert toxicity.rated(docs.where("false"), odd).count() == 0
