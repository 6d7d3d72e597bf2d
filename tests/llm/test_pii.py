"""Personal data against Python's re module, and a planted case of bootstrapping."""

import hashlib
import re

import numpy as np

from ledgerlens.llm import pii

SCHEMA = "doc_id bigint, text string, spans int, key string"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")),
            "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def base(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if ok(k, m[0])] for k, p in BASE.items()}


def expected(doc_id, text):
    found = base(text or "")
    listed = ",".join(f"{k}:{s}:{e}" for k in BASE for s, e in found[k])
    return (doc_id, *[len(found[k]) for k in BASE], hashlib.sha256(listed.encode()).hexdigest(), listed)


def test_seeds_as_documented(spark):
    r = np.random.default_rng(5)
    texts = [None, "", "a@b.c%d@e.f", "a@b.c.@d.e x..@q.w-.e", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.04", "+1 (262) 555-3752 4795326016703902",
             "4111 1111 1111 1111-4111-1111-1111-1111", "é👍+49 30 1234567é a.b@c.d👍x@y.z", "+1+22 333 444 55 +1 2", "@@a@b", "x" * 100_000 + "@", "1." * 50_000,
             "a@" + "b." * 30_000 + "c", "1 " * 40_000, "+1" + "(" * 50_000, "4111111111111111 " * 300, "9" * 50_000, "+1-" * 3000 + "5"]
    texts += ["".join(r.choice(list("ab1@.+- 2(%é"), r.integers(5, 80))) for _ in range(400)]
    rows = [(k, t, 1, "x") for k, t in enumerate(texts)] + [(None, "p@q.r", 1, ""), (7, texts[7], 1, ""), (7, texts[7], 1, "")]
    got = sorted(map(tuple, pii.personal_data(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted((expected(a, b) for a, b, *_ in rows), key=str)


def test_patterns_find_unseen_identifiers(spark):
    rows = [(k, f"write to mailbox: user{k}@site{k}.org or phone desk: +1 212 555 01{k:02d} today") for k in range(10)]
    rows += [(20, "write to mailbox: jane [at] corp [dot] com today"), (21, "the jane [at] corp [dot] com again"),
             (22, "see the part 212 555 0199 of it"), (23, "phone desk: 212 555 0199 of it"), (24, "nothing here at the dot")]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame([(a, b, 1, "") for a, b in rows], SCHEMA)).collect()}
    for a, b in rows[:10]:
        assert tuple(got[a]) == expected(a, b)
    assert got[20].spans == "email:18:42" and got[20].n_email == 0
    assert got[21].spans == "email:4:28"
    assert got[23].spans == "phone:12:24" and got[22].spans == "phone:13:25"
    assert got[24].spans == ""


def test_empty_table(spark):
    assert pii.personal_data(spark.createDataFrame([], SCHEMA)).count() == 0
