import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import basket as mb
from ledgerlens.operators import stats as st


def baskets(spark, lists):
    rows = []
    for b, items in enumerate(lists):
        for it in items:
            rows.append((b, it))
    df = spark.createDataFrame(rows, "basket_id long, item string")
    return df.groupBy("basket_id", "item").agg(F.count(F.lit(1)).alias("lines"))


def test_itemsets_and_rules_x11(spark):
    b = baskets(spark, [["a", "b", "c"], ["a", "b"], ["a", "c"], ["a", "b", "c"]])
    its = mb.frequent_itemsets(b, 0.5)
    assert its.count() == 7
    rules = mb.association_rules(its, min_lift=0.0, min_confidence=None)
    assert rules.count() == 12
    good = {(r["antecedent_key"], r["consequent_key"]) for r in
            mb.association_rules(its, min_lift=1.0, min_confidence=0.1).collect()}
    assert good == {("a", "b"), ("b", "a"), ("a", "c"), ("c", "a"), ("a", "b, c"), ("b, c", "a")}


def test_duplicate_item_x12(spark):
    b = baskets(spark, [["a", "a", "b"], ["a", "b"]])
    its = {r["itemset"]: r["count"] for r in mb.frequent_itemsets(b, 0.5).collect()}
    assert its["a"] == 2 and its["a, b"] == 2
    m = mb.basket_metrics(b).collect()[0]
    assert m["max_basket_size"] == 3 and m["most_popular_item"] == "a" and m["most_popular_count"] == 3


def test_affinity_min_lift_x13(spark):
    rules = spark.createDataFrame([(["a"], ["b"], 3.0), (["a"], ["b", "c"], 2.0)],
                                  "antecedents array<string>, consequents array<string>, lift double")
    cells = {(r["product_a"], r["product_b"]): r["lift"] for r in mb.affinity_matrix(rules).collect()}
    assert cells[("a", "b")] == 2.0 and cells[("a", "c")] == 2.0


def test_chi_square_x17(spark):
    rows = [("r1", "c1")] * 10 + [("r1", "c2")] * 20 + [("r2", "c1")] * 20 + [("r2", "c2")] * 10
    df = spark.createDataFrame(rows, "a string, b string")
    r = st.chi_square_test(df, "a", "b").collect()[0]
    assert r["chi2"] == pytest.approx(5.4) and r["p_value"] == pytest.approx(0.0201368, abs=1e-7)
    assert r["degrees_of_freedom"] == 1
    u = st.chi_square_test(df, "a", "b", correction=False).collect()[0]
    assert u["chi2"] == pytest.approx(6.666667, abs=1e-6)


def test_t_test_and_anova_x18(spark):
    df = spark.createDataFrame([("g1", 1.0), ("g1", 2.0), ("g1", 3.0), ("g2", 4.0), ("g2", 5.0), ("g2", 6.0)],
                               "g string, v double")
    t = st.t_test(df, "g", "v", "g1", "g2").collect()[0]
    assert t["t_statistic"] == pytest.approx(-3.674235, abs=1e-6)
    assert t["p_value"] == pytest.approx(0.0213116, abs=1e-7)
    assert t["cohens_d"] == pytest.approx(-3.0) and t["effect_size"] == "large"
    a = st.anova(df, "g", "v").collect()[0]
    assert a["f_statistic"] == pytest.approx(13.5) and a["eta_squared"] == pytest.approx(0.771429, abs=1e-6)
    assert a["effect_size"] == "large"


def test_correlation_constant_column_x19(spark):
    df = spark.createDataFrame([(float(i), 1.0, float(i * i)) for i in range(10)], "x double, c double, y double")
    rows = {(r["var1"], r["var2"]): r for r in st.correlation_matrix(df, ["x", "c", "y"]).collect()}
    assert rows[("x", "c")]["correlation"] is None
    assert rows[("x", "y")]["correlation"] == pytest.approx(np.corrcoef(range(10), [i * i for i in range(10)])[0, 1])
    sp = {(r["var1"], r["var2"]): r for r in st.correlation_matrix(df, ["x", "y"], "spearman").collect()}
    assert sp[("x", "y")]["correlation"] == pytest.approx(1.0)


def test_bootstrap_is_deterministic(spark):
    df = spark.createDataFrame([(i, float(i % 17)) for i in range(300)], "k long, v double")
    a = st.bootstrap_ci(df, "k", "v", 200).collect()[0]
    b = st.bootstrap_ci(df.repartition(7), "k", "v", 200).collect()[0]
    assert a == b
    assert a["ci_lower"] < a["statistic"] < a["ci_upper"]


@pytest.mark.parametrize("statistic", ["mean", "median", "sum", "std"])
def test_bootstrap_statistics_against_plain_replicates(spark, statistic):
    import hashlib
    r = np.random.default_rng(3)
    values = [*r.normal(50, 10, 150).round(2).tolist(), None, 0.0, 0.0, 500.0]
    df = spark.createDataFrame(list(enumerate(values)), "k long, v double")
    known = [(k, v) for k, v in enumerate(values) if v is not None]
    v = np.array([x for _, x in known])
    stats = []
    for b in range(90):
        u = [int(hashlib.md5(f"{k}:{b // 4}".encode()).hexdigest()[8 * (b % 4):][:8], 16) / 2**32 for k, _ in known]
        sample = np.repeat(v, [sum(x >= c for c in st.POISSON1_CDF) for x in u])
        stats.append({"mean": sample.mean(), "median": np.median(sample), "sum": sample.mean() * len(v), "std": sample.std()}[statistic])
    own = {"mean": v.mean(), "median": np.median(v), "sum": v.sum(), "std": v.std()}[statistic]
    got = st.bootstrap_ci(df, "k", "v", 90, 0.9, statistic).collect()[0]
    assert tuple(got) == pytest.approx((own, np.percentile(stats, 5), np.percentile(stats, 95), np.mean(stats), np.std(stats), 0.9))
    few = st.bootstrap_ci(df.where("k < 3"), "k", "v", 8, 0.9, statistic).collect()[0]
    assert few["statistic"] is not None
    assert st.bootstrap_ci(df.where("v IS NULL"), "k", "v", 8, 0.9, statistic).collect()[0]["statistic"] is None


def test_bootstrap_bracket_widens(spark):
    from ledgerlens.operators.stats import _medians
    df = spark.createDataFrame([(i, float(i * i % 101)) for i in range(400)], "_k long, _v double")
    narrow = sorted(map(tuple, _medians(df, 400, 40, spread=0.05).collect()))
    assert narrow == sorted(map(tuple, _medians(df, 400, 40, spread=1000.0).collect())) and None not in dict(narrow).values()


def brute_itemsets(lists, min_support):
    from itertools import combinations
    sets, out = [set(x) for x in lists], {}
    for k in range(1, max(map(len, sets)) + 1):
        for c in combinations(sorted(set().union(*sets)), k):
            n = sum(set(c) <= x for x in sets)
            if n / len(sets) >= min_support:
                out[c] = n
    return out


def test_itemsets_of_any_length(spark):
    r = np.random.default_rng(4)
    lists = [[f"i{v}" for v in r.choice(9, int(r.integers(1, 9)), replace=False)] for _ in range(60)] + [["i1", "i2", "i3", "i4", "i5", "i6"]] * 12
    want = brute_itemsets(lists, 0.2)
    assert max(map(len, want)) >= 5
    b = baskets(spark, lists)
    every = {tuple(x["items"]): x["count"] for x in mb.frequent_itemsets(b, 0.2, None).collect()}
    assert every == want
    five = mb.frequent_itemsets(b, 0.2, 5)
    assert {tuple(x["items"]): x["count"] for x in five.collect()} == {k: v for k, v in want.items() if len(k) <= 5}
    rules = mb.association_rules(five, 0.0, None)
    assert rules.count() == sum(2 ** len(k) - 2 for k in want if 2 <= len(k) <= 5)
    with pytest.raises(ValueError):
        mb.frequent_itemsets(b, 0.2, 0)


def test_itemsets_of_empty_tables(spark):
    assert mb.frequent_itemsets(baskets(spark, [["a"]]).limit(0), 0.1, None).count() == 0
    assert mb.frequent_itemsets(baskets(spark, [["a"], ["b"], ["c"]]), 0.5, None).count() == 0


def test_hot_basket_is_spread(spark):
    """One basket holds most lines: its pairs come from many rows, and the counts are those of plain Python."""
    lists = [[f"i{k:03d}" for k in range(150)] + ["i000"] * 2] + [["i000", "i001"], ["i001", "i149", "i149"]]
    b = baskets(spark, lists)
    blocks = mb.pair_blocks(b, 16)
    groups = -(-150 // 16)
    assert blocks.where("basket_id = 0").count() == groups * (groups + 1) // 2
    sizes = blocks.select(F.size("low") + F.size("high")).collect()
    assert max(x[0] for x in sizes) < 5 * 16
    pairs = {(x["a"]["item"], x["b"]["item"]) for x in mb.item_pairs(b.where("basket_id = 0"), 16).collect()}
    assert len(pairs) == 150 * 149 // 2 == mb.item_pairs(b.where("basket_id = 0"), 16).count()
    want = {}
    for x in lists:
        for i, p in enumerate(x):
            for j, q in enumerate(x):
                if i != j:
                    want[p, q] = want.get((p, q), 0) + 1
    assert {(x["item_a"], x["item_b"]): x["co_count"] for x in mb.co_occurrence(b).collect()} == want


def test_no_pair_table_is_kept(spark):
    before = spark._jsc.sc().getPersistentRDDs().size()
    b = baskets(spark, [["a", "b", "c"], ["a", "b"], ["a", "c"], ["a", "b", "c"]])
    mb.frequent_itemsets(b, 0.5).count()
    assert spark._jsc.sc().getPersistentRDDs().size() == before


def test_baskets_take_one_pass_over_the_lines(spark):
    """No join of the (basket, item) counts with their own totals; orders of one product line, null items and null orders stay out."""
    sales = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 1, "a"), (3, 1, "b"), (3, 2, "b"), (None, 1, "a"), (None, 2, "b"), (4, None, "a"), (4, 1, "b")],
                                  "SalesOrderID int, ProductID int, ProductName string")
    baskets = mb.prepare_baskets(sales)
    assert sorted(map(tuple, baskets.collect())) == [(1, "a", 1), (3, "b", 2)]
    plan = baskets._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_recommendations_meet_few_rules(spark):
    """As many rows as by all rules (ties, several rules for an item, items in the basket too), from the best rules of an input item only."""
    import itertools
    import random
    r = random.Random(5)
    names = "abcdefgh"
    sets = [(x, y) for n, m in ((1, 1), (1, 2), (2, 1)) for x in itertools.combinations(names, n) for y in itertools.combinations(names, m) if not set(x) & set(y)]
    rules = [(list(x), list(y), ", ".join(x), float(r.randint(1, 4)), r.randint(1, 3) / 4, 0.5) for x, y in sets]
    lists = [["a"], ["a", "b", "c"], ["c", "c", "h"], ["z"], list(names)]
    want = []
    for basket, items in enumerate(lists):
        best = {}
        for ante, cons, key, lift, conf, support in rules:
            for i, rec in itertools.product(set(ante) & set(items), cons):
                best[rec] = min(best.get(rec, ((math.inf,),)), ((-lift, -conf, i, key), (basket, i, rec, conf, lift, support)))
        top = sorted(best.values(), key=lambda x: (x[0][0], x[1][2]))[:3]
        want += [(*row, rank) for rank, (_, row) in enumerate(top, 1)]
    table = spark.createDataFrame(rules, "antecedents array<string>, consequents array<string>, antecedent_key string, lift double, confidence double, support double")
    held = spark.createDataFrame([(k, x) for k, items in enumerate(lists) for x in items], "basket_id int, item string")
    out = mb.recommendations(table, held, 3)
    assert sorted(map(tuple, out.select("basket_id", "input_item", "recommended_item", "confidence", "lift", "support", "rank").collect())) == sorted(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" in plan[plan.index("Join Inner"):]


def test_candidates_go_to_the_baskets(spark):
    """Baskets are not dealt by the first item of a set, nor sent whole to the task that holds the sets."""
    lists = [sorted({c for i, c in enumerate("abcdefgh") if (7 * n + i * i) % 5 < 3}) for n in range(60)]
    want = {k: v for k, v in brute_itemsets(lists, 0.01).items() if len(k) == 3}
    held = spark.createDataFrame([(x,) for x in lists], "items array<string>")
    cand = spark.createDataFrame([(list(k),) for k in want], "items array<string>").localCheckpoint()
    blocks = mb.candidate_blocks(cand, 3, 5)
    assert len(blocks) > 1 and sum(b.count() for b in blocks) == len(want)
    out = [mb.counted(b, held, 3) for b in blocks]
    assert {tuple(x["items"]): x["count"] for o in out for x in o.collect()} == want
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = mb.counted(cand, held, 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Inner, BuildRight" in plan and plan.index("Inner, BuildRight") < plan.index("posexplode")
