"""Every alternative of the looser shapes, alone in a text."""

import re

import pytest

from ledgerlens.llm import pii

ALONE = {
    "email": ["jane at corp.com", "jane at corp (dot) com", "jane at corp{dot}com", "jane [at) corp.com", "jane(at)corp.com", "jane {at} corp dot com",
              "jane[at]corp[dot]com", "jane at corp dot com"],
    "ip": ["10[.]1[.]2[.]3", "10(.)1(.)2(.)3", "10 dot 1 dot 2 dot 3", "10[.]1(.)2 dot 3", "2001:db8:0:0:0:0:0:1"],
    "card": ["4111.1111.1111.1111", "4111/1111/1111/1111", "4111_1111_1111_1111", "3782 822463 10005", "378282246310005"],
    "phone": ["212 555 0199", "212-555-0199", "212.555.0199", "(212) 555 0199"],
}


@pytest.mark.parametrize("kind", list(pii.KINDS))
def test_each_alternative_alone(spark, kind):
    df = spark.createDataFrame([(v, f"x, {v}, y") for v in ALONE[kind]], "value string, text string")
    got = {r.value: r.found for r in df.select("value", pii.loose_spans(df["text"], kind).alias("found")).collect()}
    for v in ALONE[kind]:
        assert re.search(pii.LOOSE[kind], f"x, {v}, y")[0] == v
        assert [(x.s, x.e, x.value) for x in got[v]] == [(3, 3 + len(v), v)]
