"""Catalogue-view queries over ``items_p`` (milestones 0 and 1)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import views as V
from . import proxies as P
from .registry import query
from .sql_proxies import (ITEMS, ITEMS_P, ITEMS_W, LINES_P, PURCHASES_P, SIGHTINGS_P,  # noqa: F401
                          TODAY_SQL, with_)

LINE_TOTAL_SQL = "ROUND(price * COALESCE(NULLIF(quantity, 0), 1), 2)"


def _items(spark, sf_dir):
    return P.items_p(spark, sf_dir)


REPORT_COLS = ["id", "name", "price", "quantity", "currency", "purchased_at", "delivered_at",
               "return_by", "return_state"]


@query("returns_report", ITEMS_W + """
SELECT id, name, state, section, section_rank,
       ROW_NUMBER() OVER (PARTITION BY section_rank ORDER BY
         CASE section WHEN 'open' THEN days_left WHEN 'expired' THEN -days_left ELSE 0 END, id) AS rank,
       days_left, window_return_by, basis, """ + LINE_TOTAL_SQL + """ AS line_total
FROM sec""")
def returns_report(spark, sf_dir):
    # project first: the ranking step writes its input once
    r = V.returns_report(_items(spark, sf_dir).select(*REPORT_COLS), P.TODAY, P.POLICY_DAYS)
    return r.select("id", "name", "state", "section", "section_rank", "rank", "days_left",
                    "window_return_by", "basis", F.round(V.line_total(), 2).alias("line_total"))


@query("return_window", ITEMS_W + """
SELECT id, name, state, window_return_by, days_left, basis, window_status, returnable FROM sec""")
def return_window_q(spark, sf_dir):
    r = V.with_return_window(_items(spark, sf_dir), P.TODAY, P.POLICY_DAYS)
    return r.select("id", "name", "state", "window_return_by", "days_left", "basis",
                    "window_status", "returnable")


@query("returns_section_counts", ITEMS_W + """
SELECT section, section_rank, COUNT(*) AS n_items,
       CAST(SUM(CASE WHEN state = 'evaluate' THEN 1 ELSE 0 END) AS BIGINT) AS n_evaluate
FROM sec GROUP BY section, section_rank""")
def returns_section_counts(spark, sf_dir):
    return V.returns_section_counts(_items(spark, sf_dir), P.TODAY, P.POLICY_DAYS)


ITEM_COLS = ["id", "profile", "name", "maker", "price", "currency", "quantity", "seller",
             "order_id", "purchased_at", "category", "delivered_at", "return_by", "return_state"]
ITEM_COLS_SQL = ", ".join(ITEM_COLS)


@query("items_for_profile", ITEMS + f"""
SELECT {ITEM_COLS_SQL} FROM items_p WHERE COALESCE(profile, '') = 'market'""")
def items_for_profile(spark, sf_dir):
    return V.items_for_profile(_items(spark, sf_dir), P.PROFILE).select(*ITEM_COLS)


@query("items_since", ITEMS + """
SELECT id, name, COALESCE(purchased_at, delivered_at) AS dated_at FROM items_p
WHERE COALESCE(profile, '') = 'market' AND COALESCE(purchased_at, delivered_at) >= DATE '2001-01-01'""")
def items_since(spark, sf_dir):
    return V.items_since(_items(spark, sf_dir), P.PROFILE, "2001-01-01").select("id", "name", "dated_at")


@query("items_last_n_months", ITEMS + """
SELECT id, name, COALESCE(purchased_at, delivered_at) AS dated_at FROM items_p
WHERE COALESCE(profile, '') = 'market' AND COALESCE(purchased_at, delivered_at) >= DATE '2001-04-01'""")
def items_last_n_months(spark, sf_dir):
    # today 2001-07-01, three months back, day clamped to 28 -> 2001-04-01
    r = V.items_last_n_months(_items(spark, sf_dir), P.PROFILE, 3, P.TODAY)
    return r.select("id", "name", "dated_at")


SEARCH_COLS = ["id", "profile", "name", "order_id"]


def search_keys(spark, sf_dir):
    """decisions_p keys in three tiers: item ids, order ids, part-name nouns."""
    orders = P.table(spark, sf_dir, "orders")
    part = P.table(spark, sf_dir, "part")
    ids = orders.select((F.col("o_orderkey") * 1000 + 1).cast("string").alias("key"))
    oids = orders.select(F.col("o_orderkey").cast("string").alias("key"))
    nouns = part.select(F.element_at(F.split("p_name", " "), -1).alias("key"))
    return ids.union(oids).union(nouns).distinct()


SEARCH_KEYS_SQL = """keys AS (
  SELECT DISTINCT key FROM (
    SELECT CAST(o_orderkey * 1000 + 1 AS VARCHAR) AS key FROM orders
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR) FROM orders
    UNION ALL SELECT split_part(p_name, ' ', -1) FROM part) k)"""

FIND_SQL = """it AS (SELECT * FROM items_p WHERE COALESCE(profile, '') = 'market'),
t AS (
  SELECT key, 1 AS tier, it.* FROM keys JOIN it
    ON regexp_full_match(key, '[0-9]+') AND TRY_CAST(key AS BIGINT) = it.id
  UNION ALL SELECT key, 2 AS tier, it.* FROM keys JOIN it ON key = it.order_id
  UNION ALL SELECT key, 3 AS tier, it.* FROM keys JOIN it ON it.name ILIKE '%' || key || '%'),
found AS (SELECT *, MIN(tier) OVER (PARTITION BY key) AS best FROM t)"""


@query("find_items", with_(LINES_P, ITEMS_P, SEARCH_KEYS_SQL, FIND_SQL) + """
SELECT key, tier, id, name, order_id FROM found WHERE tier = best""")
def find_items(spark, sf_dir):
    r = V.find_items(_items(spark, sf_dir).select(*SEARCH_COLS), search_keys(spark, sf_dir), P.PROFILE)
    return r.select("key", "tier", "id", "name", "order_id")


@query("export_json", ITEMS_W + """
SELECT id, json_object('id', id, 'profile', profile, 'name', name, 'maker', maker, 'price', price,
  'currency', currency, 'quantity', quantity, 'seller', seller, 'order_id', order_id,
  'purchased_at', CAST(purchased_at AS VARCHAR), 'category', category,
  'image_path', NULL, 'image_sha', NULL, 'source', NULL,
  'delivered_at', CAST(delivered_at AS VARCHAR), 'return_by', CAST(return_by AS VARCHAR),
  'return_state', return_state, 'zone', NULL, 'zone_secondary', NULL, 'zone_signal', NULL, 'zone_confidence', NULL,
  'created_at', NULL,
  'return_window', json_object('return_by', CAST(window_return_by AS VARCHAR), 'days_left', days_left,
     'status', CASE WHEN return_state = 'returned' THEN 'returned' ELSE window_status END,
     'basis', basis))::VARCHAR AS json
FROM sec""")
def export_json(spark, sf_dir):
    return V.export_json(_items(spark, sf_dir), P.TODAY, P.POLICY_DAYS)


@query("high_spend_items", ITEMS + f"""
SELECT id, name, {LINE_TOTAL_SQL} AS line_total FROM items_p
WHERE price * COALESCE(NULLIF(quantity, 0), 1) > {P.HIGH_SPEND}""")
def high_spend_items(spark, sf_dir):
    r = V.high_spend_items(_items(spark, sf_dir), P.HIGH_SPEND)
    return r.select("id", "name", F.round("line_total", 2).alias("line_total"))


def _clusters_sql(source: str, owner: bool) -> str:
    o = "owner, " if owner else ""
    part = "PARTITION BY owner " if owner else ""
    return f"""od AS (
  SELECT {o}order_id, arg_min(purchased_at, id) AS day FROM {source}
  WHERE order_id IS NOT NULL AND order_id <> '' AND purchased_at IS NOT NULL GROUP BY {o}order_id),
pd AS (SELECT {o}day, COUNT(*) AS cnt FROM od GROUP BY {o}day),
win AS (
  SELECT {o}day,
         SUM(cnt) OVER ({part}ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS n,
         MIN(day) OVER ({part}ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS start
  FROM pd)
SELECT {o}start, CAST(MAX(n) AS BIGINT) AS n_orders FROM win WHERE n >= 3 GROUP BY {o}start"""


@query("order_clusters", ITEMS.rstrip() + ",\n" + _clusters_sql("items_p", False))
def order_clusters(spark, sf_dir):
    return V.order_clusters(_items(spark, sf_dir)).select("start", "n_orders")


@query("purchase_clusters_by_user", with_(PURCHASES_P) .rstrip() + ",\n" + _clusters_sql("purchases_p", True))
def purchase_clusters_by_user(spark, sf_dir):
    return V.order_clusters(P.purchases_p(spark, sf_dir), owner_col="owner").select(
        "owner", "start", "n_orders")


@query("shelf_by_category", ITEMS + "SELECT id, category, name FROM items_p")
def shelf_by_category(spark, sf_dir):
    return V.shelf_by_category(_items(spark, sf_dir)).select("id", "category", "name")


@query("preorder_radar", ITEMS + """
SELECT id, name, purchased_at FROM items_p
WHERE purchased_at IS NOT NULL AND delivered_at IS NULL AND COALESCE(return_state, '') <> 'returned'""")
def preorder_radar(spark, sf_dir):
    return V.preorder_radar(_items(spark, sf_dir)).select("id", "name", "purchased_at")


@query("spend_by_category", ITEMS + """
SELECT category, strftime(purchased_at, '%Y-%m') AS month,
       ROUND(SUM(price * COALESCE(NULLIF(quantity, 0), 1)), 2) AS spend, COUNT(*) AS n_lines
FROM items_p GROUP BY category, strftime(purchased_at, '%Y-%m')""")
def spend_by_category(spark, sf_dir):
    return V.spend_by_category(_items(spark, sf_dir))


@query("receipt_search", with_(LINES_P, ITEMS_P, "terms AS (SELECT DISTINCT p_brand AS term FROM part)") + """
SELECT term, id, name FROM items_p JOIN terms
  ON concat_ws(chr(1), name, maker, seller, order_id) ILIKE '%' || term || '%'""")
def receipt_search(spark, sf_dir):
    terms = P.table(spark, sf_dir, "part").select(F.col("p_brand").alias("term")).distinct()
    return V.receipt_search(_items(spark, sf_dir), terms).select("term", "id", "name")


@query("repeat_purchases", ITEMS + """
SELECT maker, name, COUNT(DISTINCT order_id) AS n_orders, COUNT(*) AS n_lines
FROM items_p GROUP BY maker, name HAVING COUNT(DISTINCT order_id) > 1""")
def repeat_purchases(spark, sf_dir):
    return V.repeat_purchases(_items(spark, sf_dir))


_RET_LINE_SQL = """
  '  [' || printf('%3s', CAST(id AS VARCHAR)) || '] ' || printf('%-40.40s', COALESCE(name, '(unnamed)')) || ' '
  || printf('%-9s', state) || ' '
  || printf('%14s', CASE WHEN price IS NULL THEN '?' ELSE
        trim(printf('%.2f', price * COALESCE(NULLIF(quantity, 0), 1)) || ' ' || COALESCE(currency, ''))
        || CASE WHEN COALESCE(NULLIF(quantity, 0), 1) <> 1
                THEN ' (x' || CAST(COALESCE(NULLIF(quantity, 0), 1) AS VARCHAR) || ')' ELSE '' END END)
  || CASE WHEN section IN ('open', 'expired') THEN '   ⏳ ' ||
       CASE WHEN days_left IS NULL THEN 'no dates — window unknown'
            WHEN days_left < 0 THEN 'expired ' || CAST(-days_left AS VARCHAR) || 'd ago (' || CAST(window_return_by AS VARCHAR) || ')'
            WHEN days_left = 0 THEN 'LAST DAY today (' || CAST(window_return_by AS VARCHAR) || ')'
            ELSE CAST(days_left AS VARCHAR) || ' days left (until ' || CAST(window_return_by AS VARCHAR) || ')' END
     ELSE '' END
  || CASE WHEN state = 'evaluate' THEN '  <-- EVALUATE: decide before the window closes!' ELSE '' END"""


@query("report_returns_lines", ITEMS_W + f""",
body AS (
  SELECT section_rank, CAST(ROW_NUMBER() OVER (PARTITION BY section_rank ORDER BY
           CASE section WHEN 'open' THEN days_left WHEN 'expired' THEN -days_left ELSE 0 END, id) AS BIGINT) AS rank,
         {_RET_LINE_SQL} AS line, name FROM sec),
secs AS (SELECT * FROM (VALUES (1, 'open'), (2, 'unknown'), (3, 'expired'), (4, 'returned')) t(section_rank, section)),
cnt AS (SELECT s.section_rank, s.section, COUNT(x.id) AS n,
               COUNT(x.id) FILTER (WHERE x.state = 'evaluate') AS n_eval
        FROM secs s LEFT JOIN sec x USING (section_rank) GROUP BY ALL)
SELECT 0 AS section_rank, CAST(0 AS BIGINT) AS rank, '==== Returns — 2001-07-01 (policy window 30d) ====' AS line, CAST(NULL AS VARCHAR) AS name
UNION ALL
SELECT section_rank, 0, CASE section WHEN 'open' THEN 'Still returnable (' || n || ') — most urgent first:'
  WHEN 'unknown' THEN 'Window unknown (' || n || ') — no usable dates:' WHEN 'expired' THEN 'Expired (' || n || '):'
  ELSE 'Already returned (' || n || '):' END, NULL FROM cnt WHERE section <> 'unknown' OR n > 0
UNION ALL SELECT * FROM body
UNION ALL SELECT section_rank, 1, '  (none)', NULL FROM cnt WHERE n = 0 AND section <> 'unknown'
UNION ALL SELECT section_rank, n + 1, '  (' || n_eval || ' item(s) flagged `evaluate` — these need a decision)', NULL
  FROM cnt WHERE section = 'open' AND n_eval > 0""")
def report_returns_lines(spark, sf_dir):
    return V.report_returns_lines(_items(spark, sf_dir).select(*REPORT_COLS), P.TODAY, P.POLICY_DAYS)


@query("unshipped_orders", with_(LINES_P, SIGHTINGS_P) + """
SELECT DISTINCT profile, order_id FROM sightings_p s WHERE via = 'order'
  AND NOT EXISTS (SELECT 1 FROM sightings_p t WHERE t.via = 'shipment' AND t.profile = s.profile
                  AND t.order_id = s.order_id)""")
def unshipped_orders(spark, sf_dir):
    """Orders with an order sighting and no shipment sighting."""
    return V.unshipped_orders(P.sightings_p(spark, sf_dir))
