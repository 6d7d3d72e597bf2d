"""Toxicity by a weighted finite-state pattern grammar over clauses.

Four transducers are composed, each reading the output of the one before it:

* words -> symbols: insult, threat, target, negation, reported speech, other;
* scope: an insult or threat shortly after a negation is ``negated``, one after
  a reporting word is ``reported``, else it is ``plain``;
* aim: an insult or threat near a target of its clause is ``aimed``;
* weights: a match is worth the weight of its word times the factor of its
  kind; a text is scored by a logistic function of the sum over its clauses,
  the number of matches and their density.

The insult vocabulary is a fixed list plus word stems learned from labels, each
with its log-odds as weight: stems are chosen one after another by how many
toxic texts they explain that no earlier stem does, less a share of the clean
texts they would touch.  So a word that only happens to stand in copies of one
toxic text is not taken.  The logistic weights are fitted on the same rows,
shrunk towards fixed ones.

Labels are learned from a sample of at most ``SAMPLE`` labelled rows (those
with the smallest hash of doc_id), never from rows that are held out; equal
texts count once, as toxic if one label says so.  Every feature that qualifies
is counted anew after each pass, in Spark; the driver holds the texts of the
``BLOCK`` commonest ones and goes on choosing among them as long as no other
feature can explain as many texts, so the stems are those of a search over all
of them.  Scoring reads every whole text.

Null text counts as empty; a long text is read whole, clause by clause; a text
without a match has the base score, which is
under 0.5.  A null doc_id counts as the empty text for the hold-out rule and
takes no label.  A doc_id with several labels is toxic if one says so; null
labels are ignored.  Without labels the fixed list and weights decide.  Every
row gives a row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch, pick

SAMPLE = 20_000
BLOCK = 5_000
STEMS = (4, 5, 6, 7, 8)
ENDING = 6
MIN_TEXTS = 3
MIN_ODDS = 8.0
CLEAN_COST = 0.25
SCOPE = 4

# Seed lexicon.
INSULTS = """arsehole asshole bastard bitch clown coward creep cretin degenerate disgusting dumbass fool freak garbage
    idiot imbecile jerk liar loser lunatic moron pathetic pig rat scum scumbag shithead stupid trash vermin weasel worthless
    abschaum arschloch bastardo basura cerdo connard crétin cretino dummkopf estúpido imbécil imbécile inútil ordure
    salaud schwein trottel versager wertlos""".split()
THREATS = """kill murder hurt destroy beat strangle stab shoot burn hang slaughter töten umbringen matar golpear tuer frapper""".split()
TARGETS = """you your yours yourself he him his she her they them their ye thou du dich dir ihr euch sie tu te toi vous votre
    usted ustedes tú ti vosotros""".split()
NEGATIONS = """not no never none neither nor isn't aren't don't nicht kein keine nie ne pas jamais nunca jamás""".split()
REPORTS = """said says say called calls wrote writes quoted quote claimed reported alleged sagte dit dijo llamó""".split()

#: Kinds of matches and the factor of a match's weight.
KINDS = {"plain": 1.0, "aimed": 1.25, "negated": 0.6, "reported": 0.75, "threat": 1.0}
INSULT_WEIGHT, THREAT_WEIGHT = 5.0, 2.5
#: Weights of the base, of log(1 + sum), log(1 + matches) and log(1 + sum per 1000 words) before any label is seen.
PRIOR = np.array([-5.5, 2.0, 0.0, 1.0])
SCORED = "doc_id bigint, score double"
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:\n]+")


@dataclass
class Grammar:
    stems: dict[str, float]
    weights: np.ndarray


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


class Matcher:
    """The composed transducers; ``facts`` is what a text's score is made of."""

    def __init__(self, stems: dict[str, float]):
        self.stems, self.memo = stems, {}
        self.fixed = {w: ("T", THREAT_WEIGHT) for w in THREATS} | {w: ("I", INSULT_WEIGHT) for w in INSULTS}
        self.fixed |= {w: (s, 0.0) for s, words in (("Y", TARGETS), ("N", NEGATIONS), ("R", REPORTS)) for w in words}

    def symbol(self, word: str) -> tuple[str, float]:
        known = self.memo.get(word)
        if known is None:
            weight = max((self.stems[f] for f in forms(word) if f in self.stems), default=0.0)
            known = ("I", weight) if weight else self.fixed.get(word, ("", 0.0))
            if len(self.memo) > 500_000:
                self.memo.clear()
            self.memo[word] = known
        return known

    def matches(self, text: str):
        """(kind, weight) of each match, and at last the number of words."""
        words = 0
        for clause in CLAUSE.split(text.lower()):
            symbols = [self.symbol(w) for w in WORD.findall(clause)]
            words += len(symbols)
            if any(s in ("I", "T") for s, _ in symbols):
                yield from self.aim(self.scope(symbols))
        yield "words", words

    def facts(self, text: str) -> list[float]:
        *found, (_, words) = self.matches(text)
        total = sum(KINDS[kind] * weight for kind, weight in found)
        return [1.0, math.log1p(total), math.log1p(len(found)), math.log1p(1000 * total / (words + 10))]

    @staticmethod
    def scope(symbols):
        """(position, symbol, weight, state) with the state plain, negated or reported."""
        negated, reported = 0, False
        for at, (s, weight) in enumerate(symbols):
            if s == "N":
                negated = SCOPE
                continue
            reported |= s == "R"
            state = "negated" if negated else "reported" if reported else "plain"
            negated = max(0, negated - 1)
            if s in ("I", "T", "Y"):
                yield at, s, weight, state

    @staticmethod
    def aim(scoped):
        """The kind and weight of each insult, and of each threat that has a target in reach."""
        scoped = list(scoped)
        targets = [at for at, s, _, _ in scoped if s == "Y"]
        for at, s, weight, state in scoped:
            if s == "Y":
                continue
            near = any(abs(at - t) <= SCOPE for t in targets)
            if s == "I":
                yield "aimed" if near and state == "plain" else state, weight
            elif near and state == "plain":
                yield "threat", weight


def scores(facts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(facts @ weights, -30, 30)))


def forms(word: str):
    """The stems of a word: itself ($), its beginnings, and beginnings with a short ending (~)."""
    yield word + "$"
    for n in STEMS:
        if n <= len(word):
            yield word[:n]
            if len(word) - n <= ENDING:
                yield word[:n] + "~"


def features(text: str) -> set[str]:
    return {f for w in set(WORD.findall(text.lower())) for f in forms(w)}


def counted(batches):
    """feature, toxic, clean: texts of this task with the feature."""
    toxic, clean = Counter(), Counter()

    def sums():
        names = list(toxic.keys() | clean.keys())
        out = pd.DataFrame({"feature": names, "toxic": [toxic[f] for f in names], "clean": [clean[f] for f in names]})
        toxic.clear()
        clean.clear()
        return out

    for batch in batches:
        for text, label in zip(batch["text"], batch["toxic"]):
            (toxic if label else clean).update(features(text))
            if len(toxic) + len(clean) > 100_000:
                yield sums()
    if toxic or clean:
        yield sums()


def cover(texts: list[tuple[bool, list[str]]], weight: dict[str, float], others: int = 0) -> dict[str, float]:
    """Stems by how many toxic texts they explain that no stem before them does, less CLEAN_COST for each clean one.

    The first one is the best of all features; ``others`` is the most toxic texts of a feature that is not among
    these, so later ones are chosen while they gain more.
    """
    toxic, clean = {f: set() for f in weight}, {f: set() for f in weight}
    for k, (label, found) in enumerate(texts):
        for f in found:
            (toxic if label else clean)[f].add(k)
    chosen = {}
    while toxic:
        gain = {f: len(ks) - CLEAN_COST * len(clean[f]) for f, ks in toxic.items()}
        best = max(gain, key=lambda f: (gain[f], len(f.rstrip("$~")), f))
        if gain[best] < MIN_TEXTS or chosen and gain[best] <= others:
            break
        chosen[best] = weight[best]
        gone, touched = toxic.pop(best), clean.pop(best)
        toxic = {f: rest for f, ks in toxic.items() if (rest := ks - gone)}
        clean = {f: clean[f] - touched for f in toxic}
    return chosen


def listed(batches):
    """k, toxic, found: the features of each text."""
    for batch in batches:
        for at in range(0, len(batch), 32):
            part = batch.iloc[at:at + 32]
            yield pd.DataFrame({"k": part["k"], "toxic": part["toxic"], "found": [list(features(t)) for t in part["text"]]})


def covered(edges: DataFrame, odds: DataFrame, scratch: Scratch, block: int = BLOCK) -> dict[str, float]:
    """``cover`` over all features of edges (k, toxic, feature), each counted in Spark before a pass."""
    chosen = {}
    while True:
        sums = edges.groupBy("feature").agg(F.count_if("toxic").alias("toxic"), F.count_if(~F.col("toxic")).alias("clean"))
        sums = scratch.write(sums.where(F.col("toxic") >= MIN_TEXTS), "sums")
        stem = F.char_length(F.regexp_replace("feature", "[$~]$", ""))
        best = sums.orderBy((F.col("toxic") - CLEAN_COST * F.col("clean")).desc(), stem.desc(), F.desc("feature")).first()
        if best is None or best.toxic - CLEAN_COST * best.clean < MIN_TEXTS:
            return chosen
        rest = sums.where(F.col("feature") != best.feature).orderBy(F.desc("toxic"), "feature").limit(block).collect()
        others = rest.pop().toxic if len(rest) == block else 0
        names = edges.sparkSession.createDataFrame([(r.feature,) for r in [best, *rest]], "feature string")
        weight = {r.feature: math.log(r.odds) for r in odds.join(F.broadcast(names), "feature").collect()}
        texts = edges.join(F.broadcast(names), "feature").groupBy("k", "toxic").agg(F.collect_list("feature").alias("found"))
        new = cover([(r.toxic, r.found) for r in texts.select("toxic", "found").collect()], weight, others)
        chosen |= new
        gone = edges.where(F.col("feature").isin(list(new))).select("k").distinct()
        edges = scratch.write(edges.join(gone, "k", "left_anti"), "edges")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    """The grammar learned from at most ``sample`` labelled rows that are not held out."""
    marks = pick(labels, doc_id="bigint", toxic="int").where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    marks = marks.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    d = pick(docs, doc_id="bigint", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = d.join(F.broadcast(marks), "doc_id").select("doc_id", "text", (F.col("toxic") > 0).alias("toxic")).dropDuplicates(["doc_id"])
    rows = rows.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("k"))
    scratch = Scratch(docs.sparkSession, "labelled")
    rows = scratch.write(rows)

    n = rows.agg(F.count_if("toxic").alias("toxic"), F.count_if(~F.col("toxic")).alias("clean")).first()
    counts = rows.select("text", "toxic").mapInPandas(counted, "feature string, toxic bigint, clean bigint")
    counts = counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = (F.col("toxic") + 0.5) / (n.toxic + 1.0) / ((F.col("clean") + 0.5) / (n.clean + 1.0))
    odds = counts.withColumn("odds", odds).where((F.col("toxic") >= MIN_TEXTS) & (F.col("odds") >= MIN_ODDS))
    odds = scratch.write(odds.select("feature", "odds"), "odds")
    edges = rows.mapInPandas(listed, "k bigint, toxic boolean, found array<string>")
    edges = edges.select("k", "toxic", F.explode("found").alias("feature")).join(odds, "feature", "left_semi")
    stems = covered(scratch.write(edges, "edges"), odds, scratch)

    def observed(batches):
        m = Matcher(stems)
        for batch in batches:
            yield pd.DataFrame({"facts": [m.facts(t) for t in batch["text"]], "toxic": batch["toxic"]})

    seen = rows.select("text", "toxic").mapInPandas(observed, "facts array<double>, toxic boolean").collect()
    facts = np.array([r.facts for r in seen], dtype=float).reshape(-1, len(PRIOR))
    return Grammar(stems, fitted(facts, np.array([r.toxic for r in seen], dtype=float)))


def fitted(x: np.ndarray, labels: np.ndarray, shrink: float = 0.3) -> np.ndarray:
    """Logistic weights by Newton steps, shrunk towards the fixed ones."""
    w = PRIOR.copy()
    for _ in range(50):
        p = scores(x, w)
        slope = x.T @ (p - labels) + shrink * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink * np.eye(len(w)), slope)
        w -= step * min(1.0, 4.0 / np.abs(step).max()) if step.any() else 0
        if np.abs(step).max() < 1e-9:
            break
    return w


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    stems, weights = grammar.stems, grammar.weights

    def run(batches):
        m = Matcher(stems)
        for batch in batches:
            facts = np.array([m.facts(t or "") for t in batch["text"]], dtype=float).reshape(-1, len(PRIOR))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": scores(facts, weights)})

    scored = pick(docs, doc_id="bigint", text="string").mapInPandas(run, SCORED)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of documents, of those that are not predicted toxic."""
    g = learn(docs, labels)
    stems, weights = g.stems, g.weights
    d = pick(docs, doc_id="bigint", text="string", lang="string", source="string", n_chars="bigint")

    def run(batches):
        m = Matcher(stems)
        for batch in batches:
            facts = np.array([m.facts(t or "") for t in batch["text"]], dtype=float).reshape(-1, len(PRIOR))
            yield batch[scores(facts, weights) < 0.5]

    return d.mapInPandas(run, d.schema)
