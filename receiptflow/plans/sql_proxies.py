"""The proxy definitions as SQL text, for the DuckDB oracle side.

Same meaning as :mod:`receiptflow.plans.proxies`; each constant is a list of
CTE bodies joined by :func:`with_`.
"""
from __future__ import annotations

from .proxies import PRODUCT_WORDS

TODAY_SQL = "DATE '2001-07-01'"
_WORDS_SQL = "[" + ", ".join("'" + w + "'" for w in PRODUCT_WORDS) + "]"

LINES_P = """lines_p AS (
  SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_linestatus, l_returnflag, l_discount,
         p_name, p_brand, p_type, p_retailprice, p_size, o_custkey, o_orderpriority, l_partkey AS partkey,
         upper(substr(p_name, 1, 1)) || substr(p_name, 2) || ' ' ||
           """ + _WORDS_SQL + """[((p_size - 1) % 25) + 1] AS title,
         CAST(o_orderdate AS DATE) AS o_day, CAST(l_shipdate AS DATE) AS s_day,
         ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
             l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax, l_returnflag,
             l_linestatus) AS pos
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""

ITEMS_P = """items_p AS (
  SELECT l_orderkey * 1000 + pos AS id, 'market' AS profile, p_name AS name, p_brand AS maker,
         p_retailprice AS price, 'USD' AS currency, CAST(l_quantity AS INTEGER) AS quantity,
         'market.example' AS seller, CAST(l_orderkey AS VARCHAR) AS order_id,
         CASE WHEN l_linenumber < 7 THEN o_day END AS purchased_at, p_type AS category,
         CASE WHEN l_linestatus = 'F' THEN s_day END AS delivered_at,
         CASE WHEN l_returnflag = 'A' AND l_discount >= 0.08
              THEN CAST(s_day + INTERVAL '14' DAY AS DATE) END AS return_by,
         CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'keep' END AS return_state,
         o_custkey AS owner, title
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, p_name ORDER BY pos) AS rn
        FROM lines_p) f
  WHERE rn = 1)"""

WINDOWED = """w AS (
  SELECT *, COALESCE(NULLIF(return_state, ''), 'evaluate') AS state,
         CASE WHEN return_by IS NOT NULL THEN return_by
              WHEN delivered_at IS NOT NULL THEN CAST(delivered_at + INTERVAL '30' DAY AS DATE)
              WHEN purchased_at IS NOT NULL THEN CAST(purchased_at + INTERVAL '30' DAY AS DATE)
         END AS window_return_by,
         CASE WHEN return_by IS NOT NULL THEN 'explicit'
              WHEN delivered_at IS NOT NULL THEN 'delivered+policy'
              WHEN purchased_at IS NOT NULL THEN 'ordered+policy' ELSE 'unknown' END AS basis
  FROM items_p),
w2 AS (
  SELECT *, CAST(window_return_by - """ + TODAY_SQL + """ AS INTEGER) AS days_left FROM w),
w3 AS (
  SELECT *, CASE WHEN days_left IS NULL THEN 'unknown' WHEN days_left >= 0 THEN 'returnable'
                 ELSE 'expired' END AS window_status,
            days_left >= 0 AS returnable,
            CASE WHEN state = 'returned' THEN 'returned'
                 WHEN days_left >= 0 THEN 'open'
                 WHEN days_left < 0 THEN 'expired' ELSE 'unknown' END AS section
  FROM w2),
sec AS (
  SELECT *, CASE section WHEN 'open' THEN 1 WHEN 'unknown' THEN 2 WHEN 'expired' THEN 3
                         ELSE 4 END AS section_rank
  FROM w3)"""

PURCHASES_P = """purchases_p AS (
  SELECT user_id AS owner, CAST(event_id AS VARCHAR) AS order_id, CAST(ts AS DATE) AS purchased_at,
         event_id AS id
  FROM events WHERE event_type = 'purchase')"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


TITLED_P = """titled_p AS (
  SELECT * REPLACE (title AS name), CASE WHEN maker = 'Brand#7' THEN 'gift receipt' END AS is_gift
  FROM items_p)"""

RULES_P = """rules_p AS (
  SELECT 'kw:' || pattern AS label, pattern, DENSE_RANK() OVER (ORDER BY pattern) AS priority
  FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS pattern FROM part
        UNION SELECT DISTINCT split_part(p_name, ' ', -1) FROM part) w)"""

ITEMS = with_(LINES_P, ITEMS_P)
ITEMS_W = with_(LINES_P, ITEMS_P, WINDOWED)


SIGHTINGS_P = """sightings_p AS (
  SELECT 'm' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(kind AS VARCHAR) AS uid,
         l_orderkey * 8 + kind AS seq, CAST(pos AS INTEGER) AS pos,
         CASE kind WHEN 1 THEN 'order' WHEN 2 THEN 'shipment' ELSE 'return_window' END AS via,
         'market' AS profile, 'market.example' AS seller, CAST(l_orderkey AS VARCHAR) AS order_id,
         p_name AS name, p_brand AS maker, p_retailprice AS price, 'USD' AS currency,
         CAST(l_quantity AS INTEGER) AS quantity,
         CASE WHEN kind = 1 THEN o_day END AS purchased_at,
         CASE WHEN kind = 2 THEN s_day END AS delivered_at,
         CASE WHEN kind = 3 THEN CAST(s_day + INTERVAL '14' DAY AS DATE) END AS return_by,
         CASE WHEN kind = 1 AND p_size <= 45
              THEN 'https://img.example/p/' || CAST(l_partkey AS VARCHAR) || '.jpg' END AS image_url,
         'template' AS source, o_day
  FROM lines_p JOIN (VALUES (1), (2), (3)) k(kind)
    ON kind = 1 OR (kind = 2 AND l_linestatus = 'F') OR (kind = 3 AND l_returnflag = 'A'))"""

REFUNDS_P = """refunds_p AS (
  SELECT 'm' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(kind AS VARCHAR) AS uid,
         l_orderkey * 8 + kind AS seq, 'refund' AS via, 'market' AS profile,
         CAST(l_orderkey AS VARCHAR) AS order_id, CAST(NULL AS VARCHAR) AS name, o_day
  FROM (SELECT l_orderkey, MIN(o_day) AS o_day,
               CASE WHEN l_orderkey % 10 = 0 THEN 0 ELSE 4 END AS kind
        FROM lines_p GROUP BY l_orderkey
        HAVING MAX(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1) r)"""

DEDUPED = """dd AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY uid, seller, order_id, name ORDER BY pos) AS rn
    FROM sightings_p) x WHERE rn = 1)"""

# Per natural key: the first sighting's row, the first delivery / return-by
# sighting, counters; then order-level refunds.  o = seq * 1000 + pos.
MERGED = """ks AS (
  SELECT COALESCE(profile, '') AS k_profile, COALESCE(seller, '') AS k_seller,
         COALESCE(order_id, '') AS k_order_id, COALESCE(name, '') AS k_name,
         seq * 1000 + pos AS o, * FROM dd),
firsts AS (
  SELECT * EXCLUDE (krn) FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY k_profile, k_seller, k_order_id, k_name ORDER BY o) AS krn
    FROM ks) x WHERE krn = 1),
agg AS (
  SELECT k_profile, k_seller, k_order_id, k_name, COUNT(*) AS n_sightings,
         arg_min(delivered_at, o) FILTER (WHERE delivered_at IS NOT NULL) AS first_delivered,
         MIN(o) FILTER (WHERE delivered_at IS NOT NULL) AS d_o,
         arg_min(return_by, o) FILTER (WHERE return_by IS NOT NULL) AS first_return_by,
         MIN(o) FILTER (WHERE return_by IS NOT NULL) AS r_o
  FROM ks GROUP BY ALL),
ref AS (
  SELECT COALESCE(profile, '') AS k_profile, order_id AS k_order_id, MAX(seq) AS rseq
  FROM refunds_p WHERE COALESCE(order_id, '') <> '' AND COALESCE(name, '') = ''
  GROUP BY ALL),
merged AS (
  SELECT f.profile, f.seller, f.order_id, f.name, f.maker, f.price,
         COALESCE(NULLIF(f.quantity, 0), 1) AS quantity, f.purchased_at, f.image_url,
         a.first_delivered AS delivered_at, a.first_return_by AS return_by,
         f.seq AS first_seq, f.pos AS first_pos, f.o AS first_o,
         CASE WHEN r.rseq > f.seq THEN 'returned' ELSE 'evaluate' END AS return_state,
         COALESCE(r.rseq > f.seq, FALSE) AS flipped,
         CAST((a.d_o IS NOT NULL AND a.d_o <> f.o) AS INTEGER)
           + CAST((a.r_o IS NOT NULL AND a.r_o <> f.o) AS INTEGER)
           - CAST(COALESCE(a.d_o <> f.o AND a.d_o = a.r_o, FALSE) AS INTEGER) AS n_enriched,
         a.n_sightings
  FROM firsts f JOIN agg a USING (k_profile, k_seller, k_order_id, k_name)
  LEFT JOIN ref r ON r.k_profile = f.k_profile AND r.k_order_id = f.k_order_id)"""

MESSAGES_LOG_P = """messages_log_p AS (
  SELECT DISTINCT uid, seq, via, o_day FROM sightings_p
  UNION ALL SELECT uid, seq, via, o_day FROM refunds_p)"""

PRIOR_LOG_P = """prior_log_p AS (
  SELECT uid AS email_uid, 'added' AS status FROM messages_log_p WHERE o_day < DATE '1995-03-01')"""

SNAPSHOT_P = """snapshot_p AS (SELECT * FROM items_p WHERE purchased_at < DATE '1996-01-01')"""

OID_SQL = ("'113-' || lpad(CAST(l_orderkey // 10000000 AS VARCHAR), 7, '0') || '-' || "
           "lpad(CAST(l_orderkey % 10000000 AS VARCHAR), 7, '0')")

# Per order: what the rendered mails say (see proxies.messages_p).
MAIL_ORDERS = """mo AS (
  SELECT l_orderkey, MIN(o_day) AS o_day, MIN(o_orderpriority) AS pri, COUNT(*) AS n,
         """ + OID_SQL + """ AS oid,
         arg_min(title, pos) AS first_title, arg_min(p_retailprice, pos) AS first_price,
         arg_min(partkey, pos) FILTER (WHERE p_size <= 45) AS img_part,
         MAX(s_day) FILTER (WHERE l_linestatus = 'F') AS f_day,
         MAX(s_day) FILTER (WHERE l_returnflag = 'A') AS a_day,
         COUNT(*) FILTER (WHERE l_linestatus = 'F') AS n_f,
         COUNT(*) FILTER (WHERE l_returnflag = 'A') AS n_a,
         BOOL_OR(l_returnflag = 'R') AS has_r
  FROM lines_p GROUP BY l_orderkey),
mails AS (
  SELECT l_orderkey, 1 AS kind, * EXCLUDE (l_orderkey) FROM mo
  UNION ALL SELECT l_orderkey, 2, * EXCLUDE (l_orderkey) FROM mo WHERE n_f > 0
  UNION ALL SELECT l_orderkey, 3, * EXCLUDE (l_orderkey) FROM mo WHERE n_a > 0
  UNION ALL SELECT l_orderkey, CASE WHEN l_orderkey % 10 = 0 THEN 0 ELSE 4 END, * EXCLUDE (l_orderkey)
            FROM mo WHERE has_r),
mail AS (
  SELECT 'm' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(kind AS VARCHAR) AS uid,
         l_orderkey * 8 + kind AS seq, * FROM mails
  UNION ALL
  SELECT 'n' || CAST(c_custkey AS VARCHAR), 1000000000000000 + c_custkey, NULL, -1, NULL, c_name, 0,
         NULL, NULL, NULL, NULL, NULL, NULL, 0, 0, FALSE
  FROM customer)"""

MAIL_SUBJECT = """CASE
  WHEN kind = -1 THEN 'Deals for ' || pri || ': 20% off'
  WHEN kind = 1 AND pri = '3-MEDIUM' THEN 'Ordered: "' || first_title || '..." and ' || CAST(n - 1 AS VARCHAR) || ' more item(s)'
  WHEN kind = 1 THEN 'Your Amazon.com order #' || oid || ' of ' || CAST(n AS VARCHAR) || ' item(s)'
  WHEN kind = 2 THEN 'Delivered: your package from order #' || oid
  WHEN kind = 3 THEN 'Return window closing for order #' || oid
  ELSE 'Your refund for order #' || oid || ' has been issued' END"""
MAIL_FROM = """CASE kind WHEN -1 THEN 'deals@amazon.example' WHEN 1 THEN 'auto-confirm@amazon.example'
  WHEN 2 THEN 'shipment-tracking@amazon.example' WHEN 3 THEN 'return@amazon.example'
  ELSE 'refund@amazon.example' END"""
MAIL_DATE = """CASE WHEN kind IN (1, 0, 4) THEN o_day WHEN kind = 2 THEN f_day WHEN kind = 3 THEN a_day END"""

# Plain text of the rendered order, delivery, return-window and refund mails.
_PRICE = "format('{:,.2f}', p_retailprice)"
_DAY = "strftime(%s, '%%B %%-d, %%Y')"
MAIL_TEXTS = f"""mail_lines AS (
  SELECT l_orderkey,
    string_agg('* ' || title || chr(10) || '  Quantity: ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || chr(10) ||
               '  ' || {_PRICE} || ' USD', chr(10) ORDER BY pos) AS blocks,
    string_agg(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' x ' || title || ' - $' || {_PRICE},
               chr(10) ORDER BY pos) AS plain,
    string_agg('- ' || title, chr(10) ORDER BY pos) FILTER (WHERE l_linestatus = 'F') AS bare_f,
    string_agg('- ' || title, chr(10) ORDER BY pos) FILTER (WHERE l_returnflag = 'A') AS bare_a
  FROM lines_p GROUP BY l_orderkey),
mail_text AS (
  SELECT m.*, CASE kind
    WHEN 1 THEN 'Order Confirmation' || chr(10) || 'Order #' || oid || chr(10) ||
      CASE pri WHEN '2-HIGH' THEN blocks WHEN '3-MEDIUM' THEN '' ELSE plain END ||
      CASE WHEN pri = '1-URGENT' THEN chr(10) || 'This order is a gift.' ELSE '' END ||
      chr(10) || 'Thank you for shopping with us.'
    WHEN 2 THEN 'Your package was delivered.' || chr(10) || 'Delivered on ' || {_DAY % 'f_day'} || chr(10) || bare_f
    WHEN 3 THEN 'The return window closes on ' || {_DAY % "a_day + INTERVAL '14' DAY"} || ' for:' || chr(10) || bare_a
    WHEN -1 THEN 'Recommended for you. Based on your order history.'
    ELSE 'We issued your refund for order #' || oid || '.' END AS text
  FROM mail m LEFT JOIN mail_lines USING (l_orderkey))"""
