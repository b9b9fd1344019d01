"""Completion-fallback and extraction-contract queries (milestone 7)."""
from __future__ import annotations

import string

from pyspark.sql import functions as F

from ..operators import completions as CO
from ..operators import profiles as PR
from . import proxies as P
from .registry import query
from .sql_proxies import LINES_P, MAIL_FROM, MAIL_ORDERS, MAIL_SUBJECT, MAIL_TEXTS, OID_SQL, with_

MAIL = with_(LINES_P, MAIL_ORDERS)


def _answers(spark, sf_dir, fields=()):
    """Cached answers joined to their messages (of which only the named fields are
    rendered), JSON salvaged (X32)."""
    c = P.completions_p(spark, sf_dir)
    m = P.messages_p(spark, sf_dir, fields)
    j = c.join(m, c.email_uid == m.uid)
    return j.withColumn("json", CO.completion_json("response_json"))


@query("completion_cache_miss", MAIL + "SELECT uid FROM mail WHERE kind <> 1")
def completion_cache_miss(spark, sf_dir):
    """Messages without a cached answer."""
    return CO.cache_misses(P.messages_p(spark, sf_dir, ()), P.completions_p(spark, sf_dir)).select("uid")


@query("completion_json", MAIL + "SELECT uid, n AS n_items FROM mail WHERE kind = 1")
def completion_json(spark, sf_dir):
    """Fenced / prose-wrapped answers salvaged to JSON (item count shown)."""
    a = _answers(spark, sf_dir)
    return a.select("uid", F.json_array_length(F.get_json_object("json", "$.items")).cast("bigint")
                    .alias("n_items"))


@query("normalize_completions", with_(LINES_P) + f"""
SELECT 'm' || CAST(l_orderkey AS VARCHAR) || '-1' AS uid, CAST(pos AS INTEGER) AS idx,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED'
            THEN 'Your Amazon.com order #' || {OID_SQL} || ' of ' ||
                 CAST(COUNT(*) OVER (PARTITION BY l_orderkey) AS VARCHAR) || ' item(s)'
            ELSE title END AS name,
       p_brand AS maker, p_retailprice AS price, 'USD' AS currency, CAST(l_quantity AS INTEGER) AS quantity,
       p_brand AS seller, {OID_SQL} AS order_id, o_day AS purchased_at, 'llm' AS source
FROM lines_p""")
def normalize_completions(spark, sf_dir):
    """Answers -> sightings with the original coercions."""
    return CO.normalize_completions(_answers(spark, sf_dir, ("subject", "msg_date")))


def _prompt_sql() -> str:
    """The prompt of a mail as SQL: the template with its fields as columns."""
    noun = PR.load_profile("amazon").llm_noun
    columns = {"noun": "'" + noun + "'", "sender": MAIL_FROM, "subject": MAIL_SUBJECT, "body": "text"}
    parts = []
    for literal, field, _, _ in string.Formatter().parse(CO.PROMPT):
        parts.append("'" + literal.replace("'", "''") + "'")
        if field:
            parts.append("(" + columns[field] + ")")
    return " || ".join(parts)


@query("completion_prompts", with_(LINES_P, MAIL_ORDERS, MAIL_TEXTS) + f"""
SELECT uid, sha256({_prompt_sql()}) AS prompt_sha256 FROM mail_text WHERE kind <> -1""")
def completion_prompts(spark, sf_dir):
    """The whole prompt (as digest) of every mail that the gate lets through."""
    prof = PR.load_profile("amazon")
    m = P.messages_p(spark, sf_dir).filter(prof.passes_keyword_gate())
    return CO.prompts(m, prof.llm_noun).select("uid", F.sha2("prompt", 256).alias("prompt_sha256"))


@query("check_items_json", with_(LINES_P) + """
SELECT 'm' || CAST(l_orderkey AS VARCHAR) || '-1' AS uid, CAST(pos AS INTEGER) AS item,
       CASE o_orderpriority WHEN '3-MEDIUM' THEN 'price not a number' ELSE 'item keys' END AS violation
FROM lines_p WHERE o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED')""")
def check_items_json(spark, sf_dir):
    """Contract violations of the cached answers (string prices, missing
    name keys)."""
    return CO.contract_violations(_answers(spark, sf_dir)).select(
        "uid", F.col("item").cast("int").alias("item"), "violation")


# A suggestion block in the middle of every mail; order lines follow it.
STRIP = "\n\nYou might also like:\nBlue lamp - $5.00\n2 x Trending now poster - $3.00\n\n2 x Desk lamp - $5.00\n"


@query("cut_recommendations", with_(LINES_P, MAIL_ORDERS, MAIL_TEXTS) + """
SELECT uid, sha256(text || chr(10) || chr(10) || chr(10) || '2 x Desk lamp - $5.00' || chr(10)) AS kept_sha256
FROM mail_text""")
def cut_recommendations(spark, sf_dir):
    """Every mail with a suggestion block put in: the block goes, the lines
    before and after it and heading words inside a line stay."""
    m = P.messages_p(spark, sf_dir).select("uid", F.concat("text", F.lit(STRIP)).alias("text"))
    return m.select("uid", F.sha2(CO.cut_recommendations("text"), 256).alias("kept_sha256"))


ACCOUNTING = ["Subtotal", "Total:", "Order total: $1,204.50", "Shipping $4.99", "Tax (8.25%)", "Gift card -$10.00",
              "DISCOUNT", "Store credit applied"]
PRODUCTS = ["Total War Box", "Tax Guide 2026 Edition", "Shipping Scale", "Discount Card Deck", "Gift Card Holder"]


@query("drop_accounting_rows", with_(LINES_P) + f"""
SELECT 'm' || CAST(l_orderkey AS VARCHAR) || '-1' AS uid, CAST(pos AS INTEGER) AS idx, title FROM lines_p
UNION ALL
SELECT DISTINCT 'm' || CAST(l_orderkey AS VARCHAR) || '-1', -1, p
FROM lines_p, (SELECT unnest({PRODUCTS}) AS p)""")
def drop_accounting_rows(spark, sf_dir):
    """The order lines plus accounting rows, which go, and products whose
    names begin with an accounting word, which stay."""
    lp = P.lines_p(spark, sf_dir)
    uid = F.concat(F.lit("m"), F.col("l_orderkey").cast("string"), F.lit("-1")).alias("uid")
    rows = lp.select(uid, F.col("pos").cast("int").alias("idx"), F.col("title"))
    more = lp.select(uid).distinct().select("uid", F.lit(-1).alias("idx"), F.explode(F.array(
        *map(F.lit, ACCOUNTING + PRODUCTS))).alias("title"))
    return rows.unionByName(more).filter(~CO.is_accounting_row("title"))


@query("unit_price_from_total", with_(LINES_P) + """
SELECT 'm' || CAST(l_orderkey AS VARCHAR) || '-1' AS uid, CAST(pos AS INTEGER) AS idx,
       ROUND(ROUND(p_retailprice * l_quantity, 2) / l_quantity, 2) AS price
FROM lines_p""")
def unit_price_from_total(spark, sf_dir):
    """Line totals (price x quantity, as printed) back to per-unit prices."""
    lp = P.lines_p(spark, sf_dir)
    total = F.format_number(F.round(F.col("p_retailprice") * F.col("l_quantity"), 2), 2)
    return lp.select(F.concat(F.lit("m"), F.col("l_orderkey").cast("string"), F.lit("-1")).alias("uid"),
                     F.col("pos").cast("int").alias("idx"),
                     CO.unit_price(total, F.col("l_quantity"), F.lit(False)).alias("price"))
