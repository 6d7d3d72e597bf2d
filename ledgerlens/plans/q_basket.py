"""Registered queries: market-basket analysis.

The test tables have 64 product names and 25 brands; with the reference's
1 % support, product-name pairs are all infrequent, so most queries mine
brand baskets (``SubcategoryName``) and use a lower support where the
3-item level should be exercised.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import basket as mb
from ledgerlens.plans.common import catalog, finish
from ledgerlens.plans.registry import query
from ledgerlens.plans.sql import with_ctes
from ledgerlens.session import stored

BRAND = "SubcategoryName"
RULE_SUPPORT = 0.002
CROSS_SELL_CATEGORIES = ["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5"]


def baskets(spark, sf_dir, item_col=BRAND):
    return mb.prepare_baskets(catalog(spark, sf_dir).sales_lines(), item_col)


def kept_baskets(spark, sf_dir, item_col=BRAND):
    """Baskets for queries that read them more than once: made once and stored."""
    return stored(baskets(spark, sf_dir, item_col), "prepared")


def brand_rules(spark, sf_dir, min_support=RULE_SUPPORT, min_lift=1.0, min_conf=0.1):
    b = kept_baskets(spark, sf_dir)
    return mb.association_rules(mb.frequent_itemsets(b, min_support), min_lift, min_conf)


# -- SQL twins ---------------------------------------------------------------

def _bk(item_col: str) -> str:
    return with_ctes("sales") + f""", bk AS (
  SELECT SalesOrderID AS basket_id, {item_col} AS item, count(*) AS lines FROM sales
  WHERE SalesOrderID IN (SELECT SalesOrderID FROM sales GROUP BY SalesOrderID HAVING count(ProductID) >= 2)
    AND {item_col} IS NOT NULL
  GROUP BY SalesOrderID, {item_col}),
nb AS (SELECT count(DISTINCT basket_id) AS n FROM bk)"""


def _itemsets(item_col: str, s: float, restrict: str = "") -> str:
    src = f"(SELECT * FROM bk WHERE item IN ({restrict}))" if restrict else "bk"
    return _bk(item_col) + f""",
l1 AS (SELECT item AS i1, count(*) AS cnt FROM {src} b GROUP BY item
       HAVING count(*) / (SELECT n FROM nb) >= {s}),
l2 AS (SELECT a.item AS i1, b.item AS i2, count(*) AS cnt FROM {src} a JOIN {src} b
         ON a.basket_id = b.basket_id AND a.item < b.item
       GROUP BY a.item, b.item HAVING count(*) / (SELECT n FROM nb) >= {s}),
l3 AS (SELECT a.item AS i1, b.item AS i2, c.item AS i3, count(*) AS cnt FROM {src} a
         JOIN {src} b ON a.basket_id = b.basket_id AND a.item < b.item
         JOIN {src} c ON a.basket_id = c.basket_id AND b.item < c.item
       GROUP BY a.item, b.item, c.item HAVING count(*) / (SELECT n FROM nb) >= {s}),
its AS (SELECT i1 AS itemset, 1 AS length, cnt, cnt / (SELECT n FROM nb) AS support FROM l1
        UNION ALL SELECT i1 || ', ' || i2, 2, cnt, cnt / (SELECT n FROM nb) FROM l2
        UNION ALL SELECT i1 || ', ' || i2 || ', ' || i3, 3, cnt, cnt / (SELECT n FROM nb) FROM l3)"""


def _rules(item_col: str, s: float, min_lift: float, min_conf: float | None, restrict: str = "") -> str:
    conf = f" AND confidence >= {min_conf}" if min_conf is not None else ""
    return _itemsets(item_col, s, restrict) + f""",
splits AS (
  SELECT i1 AS ak, i2 AS ck, i1 || ', ' || i2 AS k FROM l2 UNION ALL SELECT i2, i1, i1 || ', ' || i2 FROM l2
  UNION ALL SELECT i1, i2 || ', ' || i3, i1 || ', ' || i2 || ', ' || i3 FROM l3
  UNION ALL SELECT i2, i1 || ', ' || i3, i1 || ', ' || i2 || ', ' || i3 FROM l3
  UNION ALL SELECT i3, i1 || ', ' || i2, i1 || ', ' || i2 || ', ' || i3 FROM l3
  UNION ALL SELECT i1 || ', ' || i2, i3, i1 || ', ' || i2 || ', ' || i3 FROM l3
  UNION ALL SELECT i1 || ', ' || i3, i2, i1 || ', ' || i2 || ', ' || i3 FROM l3
  UNION ALL SELECT i2 || ', ' || i3, i1, i1 || ', ' || i2 || ', ' || i3 FROM l3),
rules AS (
  SELECT * FROM (
    SELECT sp.ak, sp.ck, a.support AS antecedent_support, c.support AS consequent_support, s.support,
           s.support / a.support AS confidence, s.support / a.support / c.support AS lift,
           s.support - a.support * c.support AS leverage,
           CASE WHEN s.support / a.support >= 1.0 THEN 'inf'::DOUBLE
                ELSE (1.0 - c.support) / (1.0 - s.support / a.support) END AS conviction
    FROM splits sp JOIN its s ON sp.k = s.itemset JOIN its a ON sp.ak = a.itemset JOIN its c ON sp.ck = c.itemset)
  WHERE lift >= {min_lift}{conf})"""


RULE_COLS_SQL = """ak AS antecedents, ck AS consequents, round(antecedent_support, 12) AS antecedent_support,
       round(consequent_support, 12) AS consequent_support, round(support, 12) AS support,
       round(confidence, 10) AS confidence, round(lift, 10) AS lift, round(leverage, 12) AS leverage,
       round(conviction, 10) AS conviction"""
RULE_SPEC = {"antecedents": None, "consequents": None, "antecedent_support": 12, "consequent_support": 12,
             "support": 12, "confidence": 10, "lift": 10, "leverage": 12, "conviction": 10}


def _rule_out(r):
    return finish(r.withColumn("antecedents", F.col("antecedent_key")).withColumn("consequents", F.col("consequent_key")),
                  RULE_SPEC)


@query("mbk1_baskets", _bk("ProductName") + "\nSELECT basket_id, item, lines FROM bk")
def mbk1_baskets(spark, sf_dir):
    return baskets(spark, sf_dir, "ProductName")


@query("mbk2_frequent_itemsets", _itemsets(BRAND, 0.001) + """
SELECT itemset, length, cnt AS count, round(support, 12) AS support FROM its""")
def mbk2_frequent_itemsets(spark, sf_dir):
    its = mb.frequent_itemsets(kept_baskets(spark, sf_dir), 0.001)
    return finish(its.withColumn("count", F.col("count").cast("bigint")),
                  {"itemset": None, "length": None, "count": None, "support": 12})


@query("mbk3_association_rules", _rules(BRAND, RULE_SUPPORT, 1.0, 0.1) + f"\nSELECT {RULE_COLS_SQL} FROM rules")
def mbk3_association_rules(spark, sf_dir):
    return _rule_out(brand_rules(spark, sf_dir))


@query("mbk4_basket_metrics_rules", _rules("ProductName", RULE_SUPPORT, 1.0, None) + f"\nSELECT {RULE_COLS_SQL} FROM rules")
def mbk4_basket_metrics_rules(spark, sf_dir):
    return _rule_out(mb.market_basket_metrics(kept_baskets(spark, sf_dir, "ProductName"), RULE_SUPPORT, 1.0))


@query("mbk5_recommendations", _rules(BRAND, RULE_SUPPORT, 1.0, 0.1) + """,
x AS (SELECT r.*, unnest(string_split(ak, ', ')) AS input_item FROM rules r),
cand AS (SELECT b.basket_id, x.input_item, unnest(string_split(x.ck, ', ')) AS recommended_item,
                x.confidence, x.lift, x.support, x.ak
         FROM (SELECT DISTINCT basket_id, item FROM bk) b JOIN x ON b.item = x.input_item),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY basket_id, recommended_item
                                  ORDER BY lift DESC, confidence DESC, input_item, ak) AS r1 FROM cand) WHERE r1 = 1)
SELECT basket_id, input_item, recommended_item, round(confidence, 10) AS confidence, round(lift, 10) AS lift,
       round(support, 12) AS support, rank
FROM (SELECT *, row_number() OVER (PARTITION BY basket_id ORDER BY lift DESC, recommended_item) AS rank FROM best)
WHERE rank <= 5""")
def mbk5_recommendations(spark, sf_dir):
    b = kept_baskets(spark, sf_dir)
    rules = mb.association_rules(mb.frequent_itemsets(b, RULE_SUPPORT), 1.0, 0.1)
    out = mb.recommendations(rules, b, 5)
    return finish(out, {"basket_id": None, "input_item": None, "recommended_item": None, "confidence": 10,
                        "lift": 10, "support": 12, "rank": None})


@query("mbk6_affinity_matrix", _rules(BRAND, RULE_SUPPORT, 1.0, 0.1) + """
SELECT product_a, product_b, round(min(lift), 10) AS lift FROM (
  SELECT unnest(string_split(ak, ', ')) AS product_a, ck, lift FROM rules) a,
  LATERAL (SELECT unnest(string_split(a.ck, ', ')) AS product_b) b
GROUP BY product_a, product_b""")
def mbk6_affinity_matrix(spark, sf_dir):
    return finish(mb.affinity_matrix(brand_rules(spark, sf_dir)), {"product_a": None, "product_b": None, "lift": 10})


def _cross_sell_sql() -> str:
    cats = ", ".join(f"({i}, '{c}')" for i, c in enumerate(CROSS_SELL_CATEGORIES))
    return _rules(BRAND, RULE_SUPPORT, 1.0, 0.1) + f""",
cats AS (SELECT * FROM (VALUES {cats}) t(idx, cat)),
hits AS (SELECT c1.cat AS Category1, c2.cat AS Category2, r.lift
         FROM rules r, cats c1, cats c2
         WHERE c1.idx < c2.idx AND contains(r.ak, c1.cat) AND contains(r.ck, c2.cat))
SELECT Category1, Category2, round(avg(lift), 10) AS AvgLift, round(max(lift), 10) AS MaxLift,
       count(*) AS NumRules, round(avg(lift) * ln(1 + count(*)), 10) AS Strength
FROM hits GROUP BY Category1, Category2 ORDER BY Strength DESC, Category1, Category2 LIMIT 10"""


@query("mbk7_cross_sell", _cross_sell_sql())
def mbk7_cross_sell(spark, sf_dir):
    out = mb.cross_sell(brand_rules(spark, sf_dir), CROSS_SELL_CATEGORIES, 10)
    return finish(out, {"Category1": None, "Category2": None, "AvgLift": 10, "MaxLift": 10, "NumRules": None,
                        "Strength": 10})


@query("mbk8_basket_metrics", _bk("ProductName") + """,
sz AS (SELECT basket_id, sum(lines) AS size FROM bk GROUP BY basket_id),
fq AS (SELECT item, sum(lines) AS freq FROM bk GROUP BY item)
SELECT round((SELECT avg(size) FROM sz), 10) AS avg_basket_size,
       (SELECT median(size) FROM sz) AS median_basket_size, (SELECT CAST(max(size) AS BIGINT) FROM sz) AS max_basket_size,
       (SELECT count(*) FROM fq) AS total_unique_items,
       (SELECT item FROM fq ORDER BY freq DESC, item LIMIT 1) AS most_popular_item,
       (SELECT CAST(max(freq) AS BIGINT) FROM fq) AS most_popular_count, round((SELECT avg(freq) FROM fq), 10) AS avg_item_frequency""")
def mbk8_basket_metrics(spark, sf_dir):
    out = mb.basket_metrics(kept_baskets(spark, sf_dir, "ProductName"))
    return finish(out, {"avg_basket_size": 10, "median_basket_size": None, "max_basket_size": None,
                        "total_unique_items": None, "most_popular_item": None, "most_popular_count": None,
                        "avg_item_frequency": 10})


@query("mbk9_co_occurrence", _bk(BRAND) + """
SELECT a.item AS item_a, b.item AS item_b,
       CAST(sum(CASE WHEN a.item = b.item THEN a.lines * (a.lines - 1) ELSE a.lines * b.lines END) AS BIGINT) AS co_count
FROM bk a JOIN bk b ON a.basket_id = b.basket_id GROUP BY a.item, b.item HAVING co_count > 0""")
def mbk9_co_occurrence(spark, sf_dir):
    return mb.co_occurrence(kept_baskets(spark, sf_dir))


@query("mbk10_affinity_edges", _rules(BRAND, RULE_SUPPORT, 1.0, 0.1) + """,
top AS (SELECT * FROM rules ORDER BY lift DESC, ak, ck LIMIT 20),
nodes AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (
            SELECT DISTINCT node FROM (SELECT unnest(string_split(ak, ', ')) AS node FROM top
                                       UNION ALL SELECT unnest(string_split(ck, ', ')) FROM top)
            ORDER BY node)),
e AS (SELECT s.source, unnest(string_split(s.ck, ', ')) AS target, s.lift
      FROM (SELECT unnest(string_split(ak, ', ')) AS source, ck, lift FROM top) s)
SELECT e.target, e.source, round(e.lift, 10) AS lift, ns.idx AS source_idx, nt.idx AS target_idx
FROM e JOIN nodes ns ON e.source = ns.node JOIN nodes nt ON e.target = nt.node""")
def mbk10_affinity_edges(spark, sf_dir):
    out = mb.affinity_edges(brand_rules(spark, sf_dir))
    return finish(out.withColumn("source_idx", F.col("source_idx").cast("bigint"))
                  .withColumn("target_idx", F.col("target_idx").cast("bigint")),
                  {"target": None, "source": None, "lift": 10, "source_idx": None, "target_idx": None})


@query("mbk11_cross_sell_table", _rules(BRAND, RULE_SUPPORT, 1.0, 0.1) + """
SELECT ak AS IfCustomerBuys, ck AS Recommend, printf('%.1fx', lift) AS Lift,
       printf('%.1f%%', confidence * 100.0) AS Confidence
FROM (SELECT * FROM rules ORDER BY lift DESC, ak, ck LIMIT 10) t""")
def mbk11_cross_sell_table(spark, sf_dir):
    return mb.cross_sell_table(brand_rules(spark, sf_dir), 10)


@query("top7_top_items", _bk("ProductName") + """
SELECT item, CAST(sum(lines) AS BIGINT) AS occurrences FROM bk GROUP BY item ORDER BY occurrences DESC, item LIMIT 100""")
def top7_top_items(spark, sf_dir):
    return mb.top_items(baskets(spark, sf_dir, "ProductName"), 100)
