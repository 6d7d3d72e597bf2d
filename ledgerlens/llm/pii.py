"""Personal data by bootstrapped contextual extraction (native).

Seeds: e-mail addresses, IP addresses, card and phone numbers that fixed
patterns find (possessive forms of the documented expressions, which match the
same spans without backtracking over long runs).

Bootstrapping: a lexical pattern is the word before an identifier, whole, with
white space after it or not ('tel:', '<').  Its confidence for a kind is the
share of the pattern's occurrences in the whole corpus (before white space, or
touching what an expression matches) that are followed by a known identifier of
that kind; it must also have
introduced ``SUPPORT`` different ones.  Candidates are spans of a looser shape
(obfuscated addresses, IPv6, local phone numbers, other card layouts) that
touch no seed.  Patterns and candidate values form a graph: a value's
confidence is 1 - prod(1 - confidence) over the patterns it follows, values of
at least ``CONFIDENCE`` count as known in the next round and vouch for the
patterns they stand behind.  Rounds end when no value is added.  Spans of
accepted values are added to the seeds, which all stay.

Texts are read twice and never shuffled: once for spans, once for counting the
words that are patterns (partial counts per task).  Positions count code
points, ends are exclusive.

Null text counts as empty.  Every row gives a row; rows that agree in doc_id
and text get the same spans.  Null doc_ids are kept.  An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch, lower_az, pick

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 3
CONFIDENCE = 0.8

# The seeds' expressions.
SEEDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
#: What stands for the @ of a loose address and for the dots of a loose IPv4 address.
AT = r"(?:\x20?[\[({]at[\])}]\x20?|\x20at\x20)"
IP_DOT = r"(?:\[\.\]|\(\.\)|\x20dot\x20)"
#: Looser shapes that only a confident pattern can turn into findings.
LOOSE = {
    "email": rf"[A-Za-z0-9._%+-]{{1,64}}+{AT}" + r"[A-Za-z0-9-]{1,63}(?:(?:\x20?[\[({]dot[\])}]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63}){1,8}",
    "ip": rf"(?<![0-9])[0-9]{{1,3}}(?:{IP_DOT}[0-9]{{1,3}}){{3}}(?![0-9])|" + r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4,6}){2,4}(?![0-9])|(?<![0-9])(?<![0-9][\x20-])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9+.(-])(?<![0-9]\x20)(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![\x20.-]?[0-9])",
}
#: A part that the expression itself asks of every loose match, so texts without it need no search.
HINTS = {"email": AT, "ip": f"{IP_DOT}|:"}
SPAN = "array<struct<kind:int,s:bigint,e:bigint,value:string,before:string,beside:boolean>>"
#: The last word and the white space after it; looked for at the beginnings of words only, so in linear time.
LAST_WORD = r"(?<!\S)(\S++\s*+)\z"


def spans(text: Column, kind: str, pattern: str) -> Column:
    """The matches of a pattern with their places and the word before; the pieces between matches give the places.

    ``beside``: the word before touches the match, or the match before it, so it is no word between white space.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    parts = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc, x):
        s = acc["at"] + F.char_length(x["g"])
        e = s + F.char_length(x["m"])
        last = F.regexp_extract(x["g"], LAST_WORD, 1)
        before = lower_az(F.regexp_replace(last, r"\s++\z", ""))
        beside = (last != "") & ((F.char_length(last) == F.char_length(before)) | ((acc["at"] > 0) & (last == x["g"])))
        span = F.struct(F.lit(KINDS.index(kind)).alias("kind"), s.alias("s"), e.alias("e"), x["m"].alias("value"),
                        before.alias("before"), beside.alias("beside"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(parts, start, step)["out"]).otherwise(F.array().cast(SPAN))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    d = F.reverse(digits(value))
    doubled = F.transform(F.split(d, ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    n = F.char_length(digits(value))
    if kind == "ip":
        return value.rlike(IP)
    if kind == "card":
        return n.between(16, 19) & F.when(n.between(16, 19), luhn(value)).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def loose_spans(text: Column, kind: str) -> Column:
    found = spans_any(text, kind, LOOSE[kind])
    return F.when(text.rlike(HINTS[kind]), found).otherwise(F.array().cast(SPAN)) if kind in HINTS else found


def spans_any(text: Column, kind: str, pattern: str) -> Column:
    """As ``spans``, with the looser checks of candidates."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.size(found) > 0, spans_checked(text, kind, pattern)).otherwise(F.array().cast(SPAN))


def spans_checked(text: Column, kind: str, pattern: str) -> Column:
    raw = spans(text, kind, pattern)
    n = lambda x: F.char_length(digits(x["value"]))
    if kind == "card":
        return F.filter(raw, lambda x: n(x).between(13, 19) & luhn(x["value"]))
    return raw


def located(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), seeds, loose, beside: the spans of each document; loose ones touch no seed.

    ``beside`` has the words that touch what an expression matches, once for each place.
    """
    text = F.col("text")
    d = pick(docs, doc_id="bigint", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", F.struct(F.xxhash64("text"), F.char_length("text")).alias("key"),
                 F.array(*[spans(text, k, SEEDS[k]) for k in KINDS]).alias("shapes"),
                 F.concat(*[loose_spans(text, k) for k in KINDS]).alias("loose"))
    held = lambda i, k: F.filter(F.col("shapes")[i], lambda x: valid(k, x["value"]))
    seeds = F.concat(*[held(i, k) for i, k in enumerate(KINDS)])
    beside = F.filter(F.concat(F.flatten("shapes"), "loose"), lambda x: x["beside"])
    places = F.array_distinct(F.transform(beside, lambda x: F.struct(x["s"].alias("s"), x["before"].alias("before"))))
    d = d.select("doc_id", "key", seeds.alias("seeds"), "loose", F.transform(places, lambda x: x["before"]).alias("beside"))
    apart = F.filter("loose", lambda c: ~F.exists("seeds", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    return d.select("doc_id", "key", "seeds", apart.alias("loose"), "beside")


def occurrences(docs: DataFrame, found: DataFrame, patterns: DataFrame, scratch: Scratch) -> DataFrame:
    """before, total: how often each pattern word stands in the corpus, between white space or beside an identifier."""
    d = pick(docs, text="string").select(F.explode(F.split(lower_az(F.coalesce("text", F.lit(""))), r"\s+")).alias("before"))
    d = d.where("before <> ''").union(found.select(F.explode("beside")))
    counts = d.groupBy("before").agg(F.count(F.lit(1)).alias("total"))
    return scratch.write(counts.join(patterns, "before", "left_semi"), "occurrences")


def bootstrapped(docs: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame | None:
    """kind, value of the candidates that confident patterns support."""
    loose = found.select(F.explode("loose").alias("x")).select("x.kind", "x.value", "x.before").where("before <> ''")
    loose = scratch.write(loose.groupBy("kind", "value", "before").agg(F.count(F.lit(1)).alias("n")), "loose")
    if loose.isEmpty():
        return None
    # only words that stand before some candidate can ever add a span or be vouched for by one
    words = scratch.write(loose.select("before").distinct(), "words")
    seeds = found.select(F.explode("seeds").alias("x")).select("x.kind", "x.value", "x.before").where("before <> ''")
    seeds = seeds.groupBy("kind", "value", "before").agg(F.count(F.lit(1)).alias("n"))
    known = scratch.write(seeds.join(words, "before", "left_semi"), "known")
    total = occurrences(docs, found, words, scratch)
    accepted = None
    while True:  # the accepted values only grow and are finite
        patterns = known.groupBy("kind", "before").agg(F.sum("n").alias("n"), F.countDistinct("value").alias("support"))
        patterns = patterns.where(F.col("support") >= SUPPORT).join(total, "before")
        patterns = scratch.write(patterns.select("kind", "before", F.least(F.lit(1.0), F.col("n") / F.col("total")).alias("confidence")), "patterns")
        miss = F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))
        edges = loose.select("kind", "value", "before").join(patterns, ["kind", "before"])
        values = edges.groupBy("kind", "value").agg((1 - F.exp(F.sum(miss))).alias("confidence"))
        values = values.where(F.col("confidence") >= CONFIDENCE).select("kind", "value")
        values = scratch.write(values if accepted is None else values.union(accepted).distinct(), "values")
        n = values.count()
        if n == (0 if accepted is None else accepted.count()):
            break
        accepted = values
        known = scratch.write(known.union(loose.join(values, ["kind", "value"], "left_semi").select(known.columns)).distinct(), "known")
    return accepted


def listed(spans_: Column) -> Column:
    """kind:start:end of spans, by kind, then start."""
    name = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans_, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", name[x["kind"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.write(located(docs), "found")
    accepted = bootstrapped(docs, found, scratch)
    bare = F.transform("seeds", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    out = found.select("doc_id", "key", bare.alias("seeds"))
    if accepted is None:
        out = out.withColumn("more", F.slice("seeds", 1, 0))
    else:
        more = found.select("doc_id", "key", F.explode("loose").alias("x")).select("doc_id", "key", "x.*")
        more = more.join(accepted, ["kind", "value"], "left_semi")
        more = more.groupBy("doc_id", "key").agg(F.collect_set(F.struct("kind", "s", "e")).alias("more"))
        more = scratch.write(more, "more").withColumnsRenamed({"doc_id": "d", "key": "k"})
        out = out.join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
        out = out.withColumn("more", F.coalesce("more", F.slice("seeds", 1, 0)))
    count = lambda k: F.size(F.filter("seeds", lambda x: x["kind"] == k)).cast("bigint")
    return out.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                      F.sha2(listed(F.col("seeds")), 256).alias("base_sha256"),
                      listed(F.concat("seeds", "more")).alias("spans"))
