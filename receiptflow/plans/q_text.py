"""Text, decoding-free parse and extraction queries (milestone 4) over the
rendered proxy mail; oracles derive the expected values from the order lines."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import extract as E
from ..operators import profiles as PR
from . import proxies as P
from .registry import query
from .sql_proxies import LINES_P, MAIL_ORDERS, OID_SQL, with_  # noqa: F401

MAIL = with_(LINES_P, MAIL_ORDERS)


def _msgs(spark, sf_dir):
    return P.messages_p(spark, sf_dir)


def _body(m):
    """Messages with the combined body the templates read (P2 + P3)."""
    return m.withColumn("text", X.combine_body(F.col("text"), X.html_to_text("html")))


def _found(m, value, name):
    """(uid, value) where there is one.  An explode, as a filter on the value would be pushed
    below the projections and build bodies and values again, once per place that names them."""
    return m.select("uid", F.explode(F.array_compact(F.array(value))).alias(name))


# --- P2 / P3 on pages -------------------------------------------------------------

_HTML_TO_TEXT_SQL = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  replace(replace(regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(COALESCE(html, ''), '(?is)<script.*?>.*?</script>', ' ', 'g'),
                   '(?is)<style.*?>.*?</style>', ' ', 'g'),
    '(?i)</?(p|div|br|tr|td|th|li|ul|ol|h[1-6]|table|section|header|footer)\\b[^>]*>', chr(10), 'g'),
    '(?s)<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'),
  '[ \\t]+', ' ', 'g'), '\\n\\s*\\n+', chr(10), 'g'), '^\\s+', '', ''), '\\s+$', '', ''), '', '', 'g')"""


@query("html_to_text", f"SELECT page_id, {_HTML_TO_TEXT_SQL} AS text FROM pages")
def html_to_text(spark, sf_dir):
    pg = P.table(spark, sf_dir, "pages")
    return pg.select("page_id", X.html_to_text("html").alias("text"))


@query("combine_body", f"""
WITH t AS (SELECT page_id, url, {_HTML_TO_TEXT_SQL} AS ht FROM pages)
SELECT page_id, regexp_replace(regexp_replace(
         regexp_replace(regexp_replace(concat_ws(chr(10), NULLIF(url, ''), NULLIF(ht, '')), '^\\s+', ''),
                        '\\s+$', ''),
         'https?://\\S+', ' ', 'g'), '[ \\t]+', ' ', 'g') AS text
FROM t""")
def combine_body(spark, sf_dir):
    """P3 on pages: the URL plays the plain part (and is blanked as a bare URL)."""
    pg = P.table(spark, sf_dir, "pages")
    return pg.select("page_id", X.combine_body(F.col("url"), X.html_to_text("html")).alias("text"))


# --- gates and dispatch --------------------------------------------------------------

@query("subject_blocklist", MAIL + "SELECT uid, kind <> -1 AS passes FROM mail")
def subject_blocklist(spark, sf_dir):
    prof = PR.load_profile("amazon")
    return _msgs(spark, sf_dir).select("uid", prof.passes_subject_blocklist().alias("passes"))


@query("keyword_gate", MAIL + "SELECT uid, kind <> -1 AS passes FROM mail")
def keyword_gate(spark, sf_dir):
    prof = PR.load_profile("amazon")
    return _body(_msgs(spark, sf_dir)).select("uid", prof.passes_keyword_gate().alias("passes"))


_VIA = ("CASE WHEN kind = -1 THEN 'gate' WHEN kind = 1 THEN 'template:amazon_order' "
        "WHEN kind = 2 THEN 'template:amazon_shipment' WHEN kind = 3 THEN 'template:amazon_return_window' "
        "ELSE 'template:amazon_refund' END")
_N_ITEMS = ("CASE WHEN kind = -1 THEN 0 WHEN kind = 1 AND pri = '3-MEDIUM' THEN 1 WHEN kind = 1 THEN 2 * n "
            "WHEN kind = 2 THEN n_f WHEN kind = 3 THEN n_a ELSE 1 END")


@query("dispatch_templates", MAIL + f"SELECT uid, {_VIA} AS via, CAST({_N_ITEMS} AS INTEGER) AS n_items FROM mail")
def dispatch_templates(spark, sf_dir):
    """X19 + F2: gate, then the first matching template and its raw item count."""
    prof = PR.load_profile("amazon")
    p = PR.parse_messages(_msgs(spark, sf_dir), prof)
    return p.select("uid", "via", F.col("n_found").alias("n_items"))


# --- extractors ------------------------------------------------------------------

def _exploded(spark, sf_dir, arr_fn):
    m = _body(_msgs(spark, sf_dir))
    x = m.select("uid", F.posexplode(arr_fn()).alias("idx0", "it"))
    return x.select("uid", (F.col("idx0") + 1).alias("idx"), "it.*")


_LINES_EXPECT = """lx AS (
  SELECT 'm' || CAST(l_orderkey AS VARCHAR) || '-1' AS uid, pos, title, CAST(l_quantity AS INTEGER) AS qty,
         p_retailprice AS price, o_orderpriority AS pri,
         COUNT(*) OVER (PARTITION BY l_orderkey) AS n
  FROM lines_p)"""


@query("extract_line_items", with_(LINES_P, _LINES_EXPECT) + """
SELECT uid, CAST(pos + k * n AS INTEGER) AS idx, title, qty AS quantity, price, 'USD' AS currency
FROM lx, (VALUES (0), (1)) t(k) WHERE pri NOT IN ('2-HIGH', '3-MEDIUM')""")
def extract_line_items(spark, sf_dir):
    """``q x name - $price`` lines (plain part, then the HTML twin)."""
    return _exploded(spark, sf_dir, lambda: E.line_items(F.col("text"))).select(
        "uid", F.col("idx").cast("int").alias("idx"), "title", "quantity", "price", "currency")


@query("extract_block_items", with_(LINES_P, _LINES_EXPECT) + """
SELECT uid, CAST(pos + k * n AS INTEGER) AS idx, title, qty AS quantity, price, 'USD' AS currency
FROM lx, (VALUES (0), (1)) t(k) WHERE pri = '2-HIGH'""")
def extract_block_items(spark, sf_dir):
    """``* name / Quantity: n / price USD`` blocks."""
    return _exploded(spark, sf_dir, lambda: E.block_items(F.col("text"))).select(
        "uid", F.col("idx").cast("int").alias("idx"), "title", "quantity", "price", "currency")


@query("extract_bare_items", with_(LINES_P) + """
SELECT uid, CAST(ROW_NUMBER() OVER (PARTITION BY uid ORDER BY pos) AS INTEGER) AS idx, title FROM (
  SELECT 'm' || CAST(l_orderkey AS VARCHAR) || '-2' AS uid, pos, title FROM lines_p WHERE l_linestatus = 'F'
  UNION ALL
  SELECT 'm' || CAST(l_orderkey AS VARCHAR) || '-3', pos, title FROM lines_p WHERE l_returnflag = 'A') b""")
def extract_bare_items(spark, sf_dir):
    """``- name`` lines of the delivery and return-window mails."""
    return _exploded(spark, sf_dir, lambda: E.bare_items(F.col("text"))).select(
        "uid", F.col("idx").cast("int").alias("idx"), "title")


@query("extract_subject_item", MAIL + """
SELECT uid, first_title AS title FROM mail WHERE kind = 1 AND pri = '3-MEDIUM'""")
def extract_subject_item(spark, sf_dir):
    """The quoted item name of a subject."""
    return _exploded(spark, sf_dir, lambda: E.subject_item(F.col("subject"))).select("uid", "title")


@query("extract_items_cascade", with_(LINES_P, _LINES_EXPECT, MAIL_ORDERS) + """
SELECT uid, CAST(pos + k * n AS INTEGER) AS idx, title FROM lx, (VALUES (0), (1)) t(k)
WHERE pri <> '3-MEDIUM'
UNION ALL SELECT uid, 1, first_title FROM mail WHERE kind = 1 AND pri = '3-MEDIUM'""")
def extract_items_cascade(spark, sf_dir):
    """Block -> line -> subject, the first non-empty list wins."""
    return _exploded(spark, sf_dir, lambda: E.market_items(F.col("text"), F.col("subject"))).select(
        "uid", F.col("idx").cast("int").alias("idx"), "title")


# --- scalar functions over the mail ---------------------------------------------------

@query("marketplace_order_id", MAIL + "SELECT uid, oid AS order_id FROM mail")
def marketplace_order_id(spark, sf_dir):
    """X10 (NULL for the marketing mails)."""
    m = _body(_msgs(spark, sf_dir))
    return m.select("uid", X.marketplace_order_id("subject", "text").alias("order_id"))


@query("lifecycle_dates", MAIL + """
SELECT uid, CASE WHEN kind = 2 THEN f_day END AS delivered_at,
       CASE WHEN kind = 3 THEN CAST(a_day + INTERVAL '14' DAY AS DATE) END AS return_by FROM mail""")
def lifecycle_dates(spark, sf_dir):
    """X11 + X12 + X13: delivery and return-by dates read from the text."""
    m = _body(_msgs(spark, sf_dir))
    return m.select("uid", X.delivered_date("text", "subject", "msg_date").alias("delivered_at"),
                    X.return_by_date("text").alias("return_by"))


@query("first_product_image", MAIL + """
SELECT uid, 'https://img.example/p/' || CAST(img_part AS VARCHAR) || '.jpg' AS image_url
FROM mail WHERE kind = 1 AND img_part IS NOT NULL""")
def first_product_image(spark, sf_dir):
    """Chrome and tracking images (pixel, banner) are skipped."""
    m = _msgs(spark, sf_dir)
    return _found(m, X.first_product_image("html"), "image_url")


@query("best_product_image", MAIL + """
SELECT uid, 'https://img.example/p/' || CAST(img_part AS VARCHAR) || '.jpg' AS image_url
FROM mail WHERE kind = 1 AND img_part IS NOT NULL""")
def best_product_image(spark, sf_dir):
    """X20, else any product-looking image URL in the raw HTML."""
    m = _msgs(spark, sf_dir)
    return _found(m, X.best_product_image("html"), "image_url")


@query("gift_signal", MAIL + """
SELECT uid, 'This order is a gift' AS gift FROM mail WHERE kind = 1 AND pri = '1-URGENT'""")
def gift_signal(spark, sf_dir):
    """X26 (gift phrase; the ship-to half needs an owner name)."""
    from ..operators.zones import DEFAULT_TAXONOMY
    m = _body(_msgs(spark, sf_dir))
    return _found(m, X.gift_signal("text", DEFAULT_TAXONOMY.gift_regex), "gift")


@query("first_price", MAIL + """
SELECT uid, CASE WHEN kind = 1 AND pri <> '3-MEDIUM' THEN first_price END AS price,
       CASE WHEN kind = 1 AND pri <> '3-MEDIUM' THEN 'USD' END AS currency FROM mail""")
def first_price(spark, sf_dir):
    """X1 + X2 + X3: leftmost money mention."""
    m = _body(_msgs(spark, sf_dir))
    return m.select("uid", X.first_price("text").alias("p")).select("uid", "p.price", "p.currency")


@query("seller_domain", MAIL + "SELECT uid, 'amazon.example' AS seller FROM mail")
def seller_domain(spark, sf_dir):
    return _msgs(spark, sf_dir).select("uid", X.seller_domain("from_addr").alias("seller"))


_SUBJECT_NAME = """CASE
  WHEN kind = -1 THEN '20% off'
  WHEN kind = 1 AND pri = '3-MEDIUM' THEN '"' || first_title || '..." and ' || CAST(n - 1 AS VARCHAR) || ' more item(s)'
  WHEN kind = 1 THEN 'Your Amazon.com order #' || oid || ' of ' || CAST(n AS VARCHAR) || ' item(s)'
  WHEN kind = 2 THEN 'your package from order #' || oid
  WHEN kind = 3 THEN 'Return window closing for order #' || oid
  ELSE 'Your refund for order #' || oid || ' has been issued' END"""


@query("item_name_from_subject", MAIL + f"SELECT uid, {_SUBJECT_NAME} AS name FROM mail")
def item_name_from_subject(spark, sf_dir):
    """Tail after the last delimiter, else the cleaned subject."""
    return _msgs(spark, sf_dir).select("uid", X.item_name_from_subject("subject").alias("name"))


@query("generic_order_id", MAIL + """
SELECT uid, CASE WHEN kind = 1 THEN 'Confirmation' WHEN kind IN (0, 4) THEN oid
                 WHEN kind = -1 THEN 'history' END AS order_id FROM mail""")
def generic_order_id(spark, sf_dir):
    """The generic pattern takes the first word after 'order' (so an
    'Order Confirmation' heading yields 'Confirmation', as in the original)."""
    m = _body(_msgs(spark, sf_dir))
    return m.select("uid", X.generic_order_id("text").alias("order_id"))


@query("parse_generic_order", MAIL + f"""
SELECT uid, {_SUBJECT_NAME} AS name,
       CASE WHEN pri <> '3-MEDIUM' THEN first_price END AS price,
       CASE WHEN pri <> '3-MEDIUM' THEN 'USD' END AS currency,
       'Confirmation' AS order_id, 'amazon.example' AS seller, CAST(1 AS INTEGER) AS quantity
FROM mail WHERE kind = 1 AND (pri <> '3-MEDIUM' OR img_part IS NOT NULL)""")
def parse_generic_order(spark, sf_dir):
    """The catch-all template; a row only when a price or an image was found."""
    m = _body(_msgs(spark, sf_dir))
    x = m.select("uid", F.explode(PR.parse_generic_order()).alias("r"))
    return x.select("uid", "r.name", "r.price", "r.currency", "r.order_id", "r.seller", "r.quantity")


_RAW_LINES = """rl AS (
  SELECT 'm' || CAST(l_orderkey AS VARCHAR) || '-1' AS uid, pos, title, l_quantity, p_retailprice
  FROM lines_p WHERE o_orderpriority NOT IN ('2-HIGH', '3-MEDIUM'))"""


def _raw_line_groups(spark, sf_dir):
    """Raw capture groups of the plain-part order lines (first n matches)."""
    m = _msgs(spark, sf_dir)
    g = [F.regexp_extract_all(F.col("text"), F.lit(E.LINE_RE), i) for i in range(1, 5)]
    z = m.select("uid", F.posexplode(F.arrays_zip(*g)).alias("i", "z"))
    return z.select("uid", (F.col("i") + 1).alias("pos"), F.col("z.0").alias("qty"),
                    F.col("z.1").alias("title"), F.col("z.2").alias("sym"), F.col("z.3").alias("amt"))


@query("to_amount", with_(LINES_P, _RAW_LINES) + """
SELECT uid, CAST(pos AS INTEGER) AS pos, printf('%.2f', p_retailprice) AS raw, p_retailprice AS amount FROM rl""")
def to_amount(spark, sf_dir):
    r = _raw_line_groups(spark, sf_dir)
    return r.select("uid", F.col("pos").cast("int").alias("pos"), F.col("amt").alias("raw"),
                    X.to_amount("amt").alias("amount"))


@query("to_quantity", with_(LINES_P, _RAW_LINES) + """
SELECT uid, CAST(pos AS INTEGER) AS pos, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS raw,
       CAST(l_quantity AS INTEGER) AS quantity FROM rl""")
def to_quantity(spark, sf_dir):
    r = _raw_line_groups(spark, sf_dir)
    return r.select("uid", F.col("pos").cast("int").alias("pos"), F.col("qty").alias("raw"),
                    X.to_quantity("qty").alias("quantity"))


@query("normalize_currency", with_(LINES_P, _RAW_LINES) + """
SELECT uid, CAST(pos AS INTEGER) AS pos, '$' AS raw, 'USD' AS currency FROM rl""")
def normalize_currency(spark, sf_dir):
    r = _raw_line_groups(spark, sf_dir)
    return r.select("uid", F.col("pos").cast("int").alias("pos"), F.col("sym").alias("raw"),
                    X.normalize_currency("sym").alias("currency"))


@query("clean_text", with_(LINES_P, _RAW_LINES) + """
SELECT uid, CAST(pos AS INTEGER) AS pos, title FROM rl""")
def clean_text(spark, sf_dir):
    r = _raw_line_groups(spark, sf_dir)
    return r.select("uid", F.col("pos").cast("int").alias("pos"), X.clean_text("title").alias("title"))


# --- images -----------------------------------------------------------------------

@query("content_addressed_images", """
SELECT sha256(html) AS sha, MIN(page_id) AS first_id, COUNT(*) AS copies FROM pages GROUP BY 1""")
def content_addressed_images(spark, sf_dir):
    """One stored copy per sha-256 digest (pages' bytes stand in for
    downloaded image bodies)."""
    pg = P.table(spark, sf_dir, "pages")
    return (pg.select(F.sha2(F.col("html").cast("binary"), 256).alias("sha"), "page_id")
              .groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")))


# Leading bytes of a body by page_id % 7: five image kinds, a RIFF that is no image, none.
MAGIC = ["FFD8FFE0", "89504E470D0A1A0A", "474946383761", "474946383961", "524946460000000057454250",
         "524946460000000057415645", ""]


@query("image_sniff", "SELECT page_id, page_id % 7 < 5 AS is_image FROM pages")
def image_sniff(spark, sf_dir):
    """Magic bytes of bodies that are images, nearly images, and pages."""
    pg = P.table(spark, sf_dir, "pages")
    head = F.element_at(F.array(*map(F.lit, MAGIC)), (F.col("page_id") % 7 + 1).cast("int"))
    body = F.unhex(F.concat(head, F.hex(F.col("html").cast("binary"))))
    return pg.select("page_id", X.image_sniff(body).alias("is_image"))


@query("image_ext", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.webp' WHEN 2 THEN '.gif' ELSE '.jpg' END AS ext FROM pages""")
def image_ext(spark, sf_dir):
    """The extension by content type, else by address, else .jpg."""
    pg = P.table(spark, sf_dir, "pages")
    k = F.col("page_id") % 4
    kind = F.when(k == 0, "image/png; q=1").when(k == 1, " IMAGE/WEBP").when(k == 3, "text/html")
    url = F.when(k == 2, F.concat(F.lit("https://a.example/"), F.col("page_id").cast("string"), F.lit(".GIF?v=2"))).otherwise("https://a.example/p")
    return pg.select("page_id", X.image_ext(kind, url).alias("ext"))


@query("reserved_host", """
SELECT page_id, regexp_matches(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1)),
                               '\\.(example|invalid|test|localhost)$') AS reserved FROM pages""")
def reserved_host(spark, sf_dir):
    pg = P.table(spark, sf_dir, "pages")
    return pg.select("page_id", X.reserved_host("url").alias("reserved"))


@query("decode_raw_payload", "SELECT doc_id, text FROM documents")
def decode_raw_payload(spark, sf_dir):
    """base64url payloads (here: every document, encoded by Spark) back
    to their bytes/text -- whole texts, no prefixes."""
    from ..sources.mail import decode_raw_payload as decode
    d = P.table(spark, sf_dir, "documents")
    enc = d.select("doc_id", F.translate(F.base64(F.col("text").cast("binary")), "+/", "-_").alias("raw_b64url"))
    return decode(enc).select("doc_id", F.col("raw").cast("string").alias("text"))


@query("english_date", MAIL + """
SELECT uid, CASE kind WHEN 2 THEN f_day WHEN 3 THEN CAST(a_day + INTERVAL '14' DAY AS DATE) END AS day
FROM mail""")
def english_date(spark, sf_dir):
    """X11: the 'Month d, yyyy' phrase of every mail that has one."""
    m = _msgs(spark, sf_dir)
    phrase = F.regexp_extract("text", r"(?:on|closes on) ([A-Z][a-z]+ \d{1,2}, \d{4})", 1)
    return m.select("uid", X.english_date(phrase).alias("day"))


@query("delivered_date", MAIL + "SELECT uid, f_day AS delivered_at FROM mail WHERE kind = 2")
def delivered_date(spark, sf_dir):
    """X12 (rows that carry a delivery date)."""
    m = _body(_msgs(spark, sf_dir))
    return _found(m, X.delivered_date("text", "subject", "msg_date"), "delivered_at")


@query("return_by_date", MAIL + """
SELECT uid, CAST(a_day + INTERVAL '14' DAY AS DATE) AS return_by FROM mail WHERE kind = 3""")
def return_by_date(spark, sf_dir):
    """X13 (rows that carry a return-by date)."""
    m = _body(_msgs(spark, sf_dir))
    return _found(m, X.return_by_date("text"), "return_by")


# Size suffixes used to build CDN-style image URLs from part keys.
_CDN_SUFFIXES = ["_large", "_compact_cropped", "_100x", "_x200", "_master"]


@query("alt_image_url", """
SELECT p_partkey, CASE WHEN p_size <= 45 THEN 'https://cdn.shopify.com/s/files/p/' || CAST(p_partkey AS VARCHAR)
                         || '.jpg?v=1' END AS alt_url FROM part""")
def alt_image_url(spark, sf_dir):
    """CDN size suffix stripped (other hosts -> NULL)."""
    part = P.table(spark, sf_dir, "part")
    suf = F.element_at(F.array(*[F.lit(s) for s in _CDN_SUFFIXES]),
                       (F.pmod(F.col("p_partkey"), F.lit(len(_CDN_SUFFIXES))) + 1).cast("int"))
    host = F.when(F.col("p_size") <= 45, F.lit("https://cdn.shopify.com/s/files/p/")) \
            .otherwise(F.lit("https://img.example/p/"))
    url = F.concat(host, F.col("p_partkey").cast("string"), suf, F.lit(".jpg?v=1"))
    return part.select("p_partkey", X.alt_image_url(url).alias("alt_url"))
