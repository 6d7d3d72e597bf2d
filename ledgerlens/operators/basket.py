"""Market-basket analysis (MBK-1..11, FLT-6/7, JOIN-8, TOP-6/7, SET-4).

Baskets stay in long form ``(basket_id, item)``; nothing unbounded is collected
per basket.  Frequent itemsets of any length are mined level by level:

* Level 1 counts distinct (basket, item) rows per item.  The frequent items are
  at most ``avg distinct items per basket / min_support``.
* Level 2 and the co-occurrence table form pairs by a triangular block split:
  the items of a basket are dealt by hash to groups of about ``BLOCK`` items and
  each pair of groups is a row of its own, so one basket that holds a third of
  all lines is spread over many tasks.  Pairs are counted as they are made
  (map-side combining) and stored nowhere.
* Level k joins frequent (k-1)-sets that share all but their last item and
  keeps a candidate if all its subsets are frequent.  It is counted on baskets
  as sorted arrays of frequent items: for each item of a basket the candidates
  that start with it are matched against the items that follow.  The candidates
  go to the baskets, ``SETS`` at a time, and the baskets stay where they are:
  there are few first items, so dealing baskets by them would fill few tasks.

Rules split every frequent itemset of size >= 2 into antecedent and
consequent by bitmask (all non-empty proper subsets); supports of both
sides are looked up in the itemset table by their sorted-string key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.order_stats import collect_scalars, exact_quantile
from ledgerlens.session import stored

SEP = ", "
#: Items of a basket that are paired in one row.
BLOCK = 256
#: Candidates that are sent to all tasks at once.
SETS = 100_000


def _key(arr: Column) -> Column:
    return F.array_join(arr, SEP)


def prepare_baskets(sales: DataFrame, item_col: str = "ProductName", min_products: int = 2) -> DataFrame:
    """MBK-1 / FLT-6: lines of orders with at least ``min_products`` non-null
    product lines, as (basket_id, item, lines) with duplicates counted."""
    # one pass over the lines: (basket, item) counts; a basket's total runs over that smaller table,
    # which a join with the totals would make twice in the same tasks
    per_item = sales.groupBy(F.col("SalesOrderID").alias("basket_id"), F.col(item_col).alias("item")).agg(
        F.count(F.lit(1)).alias("lines"), F.count("ProductID").alias("_p"))
    large = per_item.withColumn("_n", F.sum("_p").over(Window.partitionBy("basket_id"))).where(F.col("_n") >= min_products)
    return large.where(F.col("basket_id").isNotNull() & F.col("item").isNotNull()).select("basket_id", "item", "lines")


def basket_count(baskets: DataFrame) -> int:
    return collect_scalars(baskets.agg(F.countDistinct("basket_id")))[0]


def pair_blocks(baskets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of (basket, pair of groups): ``low`` and ``high`` hold the (item, lines) of the two groups.

    A basket of up to ``block`` items is one row whose two groups are the same
    (``high`` is empty then); one of s items makes about (s / block)^2 / 2 rows.
    """
    sizes = baskets.groupBy("basket_id").agg(F.ceil(F.count(F.lit(1)) / block).alias("groups")).where("groups > 1")
    dealt = baskets.join(sizes, "basket_id", "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    own = F.pmod(F.xxhash64("item"), F.col("groups"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1))
    rows = dealt.withColumn("own", own).withColumn("other", other).select(
        "basket_id", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") <= F.col("other")).alias("first"), F.struct("item", "lines").alias("x"))
    return rows.groupBy("basket_id", "i", "j").agg(
        F.collect_list(F.when(F.col("first"), F.col("x"))).alias("low"), F.collect_list(F.when(~F.col("first"), F.col("x"))).alias("high"))


def item_pairs(baskets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b), a.item < b.item: each pair of a basket's distinct items once, as structs (item, lines)."""
    blocks = pair_blocks(baskets, block).withColumn("other", F.when(F.col("i") == F.col("j"), F.col("low")).otherwise(F.col("high")))
    each = blocks.select("i", "j", "other", F.explode("low").alias("x"))
    each = each.select("i", "j", "x", F.explode("other").alias("y")).where((F.col("i") < F.col("j")) | (F.col("x.item") < F.col("y.item")))
    return each.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def candidates(level: DataFrame, k: int) -> DataFrame:
    """The k-sets (``items``) all of whose (k-1)-subsets are in ``level``."""
    x = level.select(F.slice("items", 1, k - 2).alias("prefix"), F.element_at("items", -1).alias("x"))
    y = level.select(F.slice("items", 1, k - 2).alias("prefix"), F.element_at("items", -1).alias("y"))
    made = x.join(y, "prefix").where("x < y").select(F.concat("prefix", F.array("x", "y")).alias("items"))
    # the subsets without the last or the last but one item are the parents
    drop = F.transform(F.sequence(F.lit(1), F.lit(k - 2)), lambda i: F.filter("items", lambda v, j: j != i - 1))
    known = made.select("items", F.explode(drop).alias("subset")).join(level.select(F.col("items").alias("subset")), "subset", "left_semi")
    return known.groupBy("items").agg(F.count(F.lit(1)).alias("of")).where(F.col("of") == k - 2).select("items")


def candidate_blocks(cand: DataFrame, k: int, size: int = SETS) -> list[DataFrame]:
    """The candidate k-sets in blocks of about ``size``; those that differ in their last item only stay together."""
    n = max(1, -(-cand.count() // size))
    block = F.pmod(F.xxhash64(F.slice("items", 1, k - 1)), F.lit(n))
    return [cand.where(block == b) for b in range(n)]


def counted(cand: DataFrame, sorted_baskets: DataFrame, k: int, per_row: int = 512) -> DataFrame:
    """How many baskets (sorted arrays ``items``) hold each candidate k-set; the candidates go to every task."""
    heads = cand.groupBy(F.slice("items", 1, k - 1).alias("head")).agg(F.collect_list(F.element_at("items", -1)).alias("tails"))
    first = F.element_at("head", 1)
    sizes = heads.groupBy(first.alias("item")).agg(F.ceil(F.count(F.lit(1)) / per_row).alias("parts"))
    heads = heads.withColumn("item", first).join(sizes, "item").groupBy("item", F.pmod(F.xxhash64("head"), F.col("parts")).alias("part"))
    heads = heads.agg(F.collect_list(F.struct("head", "tails")).alias("sets"))
    each = sorted_baskets.where(F.size("items") >= k).select("items", F.posexplode("items").alias("at", "item"))
    each = each.where(F.col("at") <= F.size("items") - k).select("item", F.expr("slice(items, at + 2, size(items))").alias("rest"))
    held = each.join(F.broadcast(heads), "item").select("rest", F.explode("sets").alias("s"))
    held = held.where(F.size(F.array_except(F.expr("slice(s.head, 2, size(s.head))"), "rest")) == 0)
    found = held.select("s.head", F.explode(F.array_intersect("s.tails", "rest")).alias("tail"))
    return found.groupBy("head", "tail").agg(F.count(F.lit(1)).alias("count")).select(F.concat("head", F.array("tail")).alias("items"), "count")


def frequent_itemsets(baskets: DataFrame, min_support: float = 0.01, max_len: int | None = 3,
                      items: DataFrame | None = None, n_baskets: int | None = None) -> DataFrame:
    """MBK-2: itemsets (sorted array ``items``, ``itemset`` key, ``length``,
    ``count``, ``support``) with support >= min_support, up to ``max_len``
    items (None: of any length).

    ``items`` optionally restricts mining to a given item list (MBK-4);
    the basket count stays the full count.  Each level is stored.
    """
    if max_len is not None and max_len < 1:
        raise ValueError("itemsets have one item at least")
    bi = baskets.select("basket_id", "item").where("item IS NOT NULL").distinct()
    if items is not None:
        bi = bi.join(items.select("item"), "item", "left_semi")
    n = n_baskets if n_baskets is not None else basket_count(baskets)

    def frequent(counts: DataFrame) -> DataFrame:
        level = counts.withColumn("support", F.col("count") / F.lit(float(n))).where(F.col("support") >= F.lit(float(min_support)))
        return stored(level.select("items", "count", "support"), "level")

    levels = [frequent(bi.groupBy("item").agg(F.count(F.lit(1)).alias("count")).withColumn("items", F.array("item")))]
    k, sorted_baskets = 2, None
    while (max_len is None or k <= max_len) and not levels[-1].isEmpty():
        if k == 2:
            known = stored(bi.join(levels[0].select(F.element_at("items", 1).alias("item")), "item", "left_semi"), "baskets")
            pairs = item_pairs(known.withColumn("lines", F.lit(1)))
            counts = [pairs.groupBy("a.item", "b.item").agg(F.count(F.lit(1)).alias("count")).toDF("x", "y", "count").withColumn("items", F.array("x", "y"))]
        else:
            if sorted_baskets is None:  # at most the frequent items in a row
                sorted_baskets = stored(known.groupBy("basket_id").agg(F.array_sort(F.collect_list("item")).alias("items")).where(F.size("items") >= k), "sorted")
            blocks = candidate_blocks(stored(candidates(levels[-1], k), "candidates"), k)
            counts = [counted(block, sorted_baskets, k) for block in blocks]
        levels.append(reduce(DataFrame.unionByName, [frequent(c) for c in counts]))
        k += 1
    out = levels[0].withColumn("length", F.lit(1))
    for length, level in enumerate(levels[1:], 2):
        out = out.unionByName(level.withColumn("length", F.lit(length)))
    return out.select("items", "length", "count", "support", _key(F.col("items")).alias("itemset"))


def association_rules(itemsets: DataFrame, min_lift: float = 1.0, min_confidence: float | None = 0.1) -> DataFrame:
    """MBK-3: all antecedent/consequent splits of the frequent itemsets,
    lift >= min_lift, then confidence >= min_confidence (None: no filter)."""
    multi = itemsets.where(F.col("length") >= 2)
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), F.col("length")).cast("int") - 2)
    split = multi.select("items", "support", F.explode(masks).alias("mask")).select(
        "support",
        F.filter("items", lambda x, i: _bit(i)).alias("antecedents"),
        F.filter("items", lambda x, i: ~_bit(i)).alias("consequents"))
    sup = itemsets.select("itemset", F.col("support").alias("_s"))
    r = (split.join(sup.withColumnRenamed("itemset", "_ak").withColumnRenamed("_s", "antecedent_support"),
                    _key(F.col("antecedents")) == F.col("_ak"))
         .join(sup.withColumnRenamed("itemset", "_ck").withColumnRenamed("_s", "consequent_support"),
               _key(F.col("consequents")) == F.col("_ck"))
         .drop("_ak", "_ck"))
    conf = F.col("support") / F.col("antecedent_support")
    r = r.withColumn("confidence", conf).withColumn("lift", F.col("confidence") / F.col("consequent_support")) \
        .withColumn("leverage", F.col("support") - F.col("antecedent_support") * F.col("consequent_support")) \
        .withColumn("conviction", F.when(F.col("confidence") >= 1.0, F.lit(float("inf"))).otherwise(
            (F.lit(1.0) - F.col("consequent_support")) / (F.lit(1.0) - F.col("confidence"))))
    r = r.where(F.col("lift") >= F.lit(float(min_lift)))
    if min_confidence is not None:
        r = r.where(F.col("confidence") >= F.lit(float(min_confidence)))
    return r.withColumn("antecedent_key", _key(F.col("antecedents"))) \
        .withColumn("consequent_key", _key(F.col("consequents")))


def _bit(i: Column) -> Column:
    return F.col("mask").bitwiseAND(F.pow(F.lit(2), i).cast("int")) != 0


def rule_order() -> list[Column]:
    return [F.desc("lift"), F.asc("antecedent_key"), F.asc("consequent_key")]


def top_rules(rules: DataFrame, n: int) -> DataFrame:
    """TOP-6: the n rules of highest lift (ties by antecedent, consequent)."""
    return rules.orderBy(*rule_order()).limit(n)


def top_items(baskets: DataFrame, n: int = 100) -> DataFrame:
    """TOP-7: the n most frequent items by line occurrences (ties by name)."""
    return baskets.groupBy("item").agg(F.sum("lines").alias("occurrences")) \
        .orderBy(F.desc("occurrences"), F.asc("item")).limit(n)


def market_basket_metrics(baskets: DataFrame, min_support: float = 0.01, min_lift: float = 1.0,
                          items: DataFrame | None = None) -> DataFrame:
    """MBK-4: itemsets of up to 3 items over all items, rules with lift >=
    min_lift (no confidence filter).  ``items`` restricts the mining to a
    chosen list, for instance ``top_items`` (TOP-7)."""
    its = frequent_itemsets(baskets, min_support, 3, items=items)
    return association_rules(its, min_lift, None)


def recommendations(rules: DataFrame, basket_items: DataFrame, top_n: int = 5) -> DataFrame:
    """MBK-5 (batch form): for every basket, rules whose antecedents contain
    one of its items; one row per recommended item (its best-lift rule);
    the ``top_n`` items by lift.  Items already in the basket are not
    excluded (as in the reference).

    Only the best rule from an input item to a recommended item can win, and
    of those the ``top_n`` items of highest lift: items that are ahead of
    another by the same input are ahead of it in every basket that holds it.
    So the rules are cut to these before the baskets meet them."""
    ant = rules.select(F.explode("antecedents").alias("input_item"), "consequents", "confidence", "lift",
                       "support", "antecedent_key")
    ant = ant.select("input_item", F.explode("consequents").alias("recommended_item"), "confidence", "lift", "support", "antecedent_key")
    w = Window.partitionBy("input_item", "recommended_item").orderBy(F.desc("lift"), F.desc("confidence"), F.asc("antecedent_key"))
    ant = ant.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
    w = Window.partitionBy("input_item").orderBy(F.desc("lift"), F.asc("recommended_item"))
    ant = ant.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top_n).drop("_r")
    cand = basket_items.select("basket_id", F.col("item").alias("input_item")).distinct() \
        .join(ant, "input_item", "inner") \
        .select("basket_id", "input_item", "recommended_item", "confidence", "lift", "support", "antecedent_key")
    w1 = Window.partitionBy("basket_id", "recommended_item").orderBy(
        F.desc("lift"), F.desc("confidence"), F.asc("input_item"), F.asc("antecedent_key"))
    best = cand.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") == 1).drop("_r")
    w2 = Window.partitionBy("basket_id").orderBy(F.desc("lift"), F.asc("recommended_item"))
    return best.withColumn("rank", F.row_number().over(w2).cast("bigint")).where(F.col("rank") <= top_n) \
        .drop("antecedent_key")


def affinity_matrix(rules: DataFrame, how: str = "min") -> DataFrame:
    """MBK-6: (product_a, product_b, lift) for each antecedent x consequent
    item of a rule.  Later rules overwrite earlier ones and rules are sorted
    by lift descending, so the reference keeps the *minimum* lift; cells
    without a rule are 0 (left implicit: the long form holds non-zero cells)."""
    agg = F.min("lift") if how == "min" else F.max("lift")
    return rules.select(F.explode("antecedents").alias("product_a"), "consequents", "lift") \
        .select("product_a", F.explode("consequents").alias("product_b"), "lift") \
        .groupBy("product_a", "product_b").agg(agg.alias("lift"))


def cross_sell(rules: DataFrame, categories: list[str], top_n: int = 10) -> DataFrame:
    """MBK-7: for category pairs (i < j in list order), rules whose
    antecedents contain an item with cat_i as substring and consequents an
    item with cat_j; mean/max lift, count, strength = mean * log1p(count)."""
    cats = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(c).alias("cat")) for i, c in enumerate(categories)])
    r = rules.select(
        "lift",
        F.filter(cats, lambda c: F.exists("antecedents", lambda x: x.contains(c["cat"]))).alias("_a"),
        F.filter(cats, lambda c: F.exists("consequents", lambda x: x.contains(c["cat"]))).alias("_c"))
    pairs = r.select("lift", F.explode("_a").alias("a"), "_c").select("lift", "a", F.explode("_c").alias("c")) \
        .where(F.col("a.idx") < F.col("c.idx"))
    out = pairs.groupBy(F.col("a.cat").alias("Category1"), F.col("c.cat").alias("Category2")).agg(
        F.avg("lift").alias("AvgLift"), F.max("lift").alias("MaxLift"), F.count(F.lit(1)).alias("NumRules"))
    out = out.withColumn("Strength", F.col("AvgLift") * F.log1p(F.col("NumRules")))
    return out.orderBy(F.desc("Strength"), "Category1", "Category2").limit(top_n)


def basket_metrics(baskets: DataFrame) -> DataFrame:
    """MBK-8: basket size mean/median/max, unique items, most popular item
    (ties -> smallest name) and mean item frequency; sizes and frequencies
    count duplicate lines."""
    sizes = baskets.groupBy("basket_id").agg(F.sum("lines").alias("size"))
    s = collect_scalars(sizes.agg(F.avg("size").alias("avg"), F.max("size").alias("max")))
    med = exact_quantile(sizes, "size", 0.5)
    freq = baskets.groupBy("item").agg(F.sum("lines").alias("freq"))
    f = collect_scalars(freq.agg(F.count(F.lit(1)).alias("n"), F.avg("freq").alias("avg")))
    top = freq.orderBy(F.desc("freq"), F.asc("item")).limit(1).collect()[0]
    return baskets.sparkSession.createDataFrame(
        [(float(s["avg"]), float(med), int(s["max"]), int(f["n"]), top["item"], int(top["freq"]), float(f["avg"]))],
        "avg_basket_size double, median_basket_size double, max_basket_size bigint, total_unique_items bigint, "
        "most_popular_item string, most_popular_count bigint, avg_item_frequency double")


def co_occurrence(baskets: DataFrame) -> DataFrame:
    """MBK-9 / JOIN-8: symmetric pair counts over line positions in a basket:
    items x != y co-occur m_x * m_y times; x with itself m_x * (m_x - 1)."""
    pairs = item_pairs(baskets).groupBy(F.col("a.item").alias("item_a"), F.col("b.item").alias("item_b")).agg(
        F.sum(F.col("a.lines") * F.col("b.lines")).alias("co_count"))
    # counted once for a < b, mirrored after that
    both = pairs.select(F.explode(F.array(F.struct("item_a", "item_b", "co_count"), F.struct(
        F.col("item_b").alias("item_a"), F.col("item_a").alias("item_b"), "co_count"))).alias("x")).select("x.*")
    own = baskets.groupBy(F.col("item").alias("item_a")).agg(F.sum(F.col("lines") * (F.col("lines") - 1)).alias("co_count"))
    return both.unionByName(own.select("item_a", F.col("item_a").alias("item_b"), "co_count")).where(F.col("co_count") > 0)


def affinity_edges(rules: DataFrame, n_rules: int = 20) -> DataFrame:
    """MBK-10 / SET-4 / CHT-13: top rules -> sorted list of all their nodes ->
    (source, target, indices, lift).  Nodes are bounded by the top rules."""
    top = top_rules(rules, n_rules)
    nodes = top.select(F.explode(F.array_union("antecedents", "consequents")).alias("node")).distinct()
    idx = nodes.withColumn("idx", F.row_number().over(Window.orderBy("node")) - 1)
    e = top.select(F.explode("antecedents").alias("source"), "consequents", "lift") \
        .select("source", F.explode("consequents").alias("target"), "lift")
    s = F.broadcast(idx.select(F.col("node").alias("source"), F.col("idx").alias("source_idx")))
    t = F.broadcast(idx.select(F.col("node").alias("target"), F.col("idx").alias("target_idx")))
    return e.join(s, "source", "inner").join(t, "target", "inner")


def cross_sell_table(rules: DataFrame, n: int = 10) -> DataFrame:
    """MBK-11: top rules as display rows (joined items, lift 'x.x' + 'x', confidence %)."""
    return top_rules(rules, n).select(
        F.col("antecedent_key").alias("IfCustomerBuys"), F.col("consequent_key").alias("Recommend"),
        F.format_string("%.1fx", F.col("lift")).alias("Lift"),
        F.format_string("%.1f%%", F.col("confidence") * 100.0).alias("Confidence"))


def filter_rules(rules: DataFrame, min_lift: float | None = None, min_confidence: float | None = None,
                 antecedent_item: str | None = None, item_substring: str | None = None) -> DataFrame:
    """FLT-7: lift / confidence thresholds, antecedent membership and
    substring match on any item of a rule."""
    out = rules
    if min_lift is not None:
        out = out.where(F.col("lift") >= F.lit(float(min_lift)))
    if min_confidence is not None:
        out = out.where(F.col("confidence") >= F.lit(float(min_confidence)))
    if antecedent_item is not None:
        out = out.where(F.array_contains("antecedents", antecedent_item))
    if item_substring is not None:
        out = out.where(F.exists(F.array_union("antecedents", "consequents"), lambda x: x.contains(item_substring)))
    return out
