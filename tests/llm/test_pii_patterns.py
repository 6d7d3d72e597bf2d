"""Patterns of personal data that touch the identifier, and chains of patterns."""

from ledgerlens.llm import pii


def spans_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {texts[r.doc_id]: r.spans for r in pii.personal_data(df).collect()}


def test_words_that_touch_the_identifier(spark):
    long = "w" * 80 + ":"
    texts = [f"call tel:+1 212 555 01{k:02d} or mailto:user{k}@site{k}.org or <u{k}@s{k}.org> {long} v{k}@t{k}.org" for k in range(10)]
    new = {"x tel:212 555 0199 y": "phone:6:18", "a mailto:jane[at]corp.com b": "email:9:25", "the <jane [at] corp.org> of": "email:5:23",
           f"at {long} jane (at) home.net": f"email:{len(long) + 4}:{len(long) + 22}"}
    # as often before something else as before an identifier: touching it, and between white space
    texts += [f"ref:+1 212 555 02{k:02d} num: +1 212 555 03{k:02d}" for k in range(10)] + ["ref: x ref:123 num: x num:"] * 5
    got = spans_of(spark, texts + list(new) + ["ref:212 555 0188", "num: 212 555 0177"])
    assert {t: got[t] for t in new} == new
    assert got["ref:212 555 0188"] == "" and got["num: 212 555 0177"] == ""


def test_chain_of_patterns_to_its_end(spark):
    value = lambda hop, k: f"jane{hop}{k} [at] corp{hop}.com"
    texts = [f"word0: seed{k}@site.org" for k in range(30)] + [f"word0: {value(1, k)}" for k in range(3)]
    for hop in range(1, 8):
        texts += [f"word{hop}: {value(hop, k)} {n}" for k in range(3) for n in range(6)]
        texts += [f"word{hop}: {value(hop + 1, k)}" for k in range(3)]
    got = spans_of(spark, texts)
    assert got[f"word7: {value(8, 0)}"] == "email:7:28"
    assert all(s.startswith("email:7:") for s in got.values())
