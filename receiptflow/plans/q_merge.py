"""Merge / state-transition queries (milestone 3)."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import merge as M
from ..operators import views as V
from ..operators import zones as Z
from . import proxies as P
from .q_views import FIND_SQL, SEARCH_COLS, SEARCH_KEYS_SQL, search_keys
from .registry import query
from .sql_gen import route_ctes
from .sql_proxies import (DEDUPED, ITEMS_P, LINES_P, MERGED, MESSAGES_LOG_P, REFUNDS_P, SIGHTINGS_P,
                          SNAPSHOT_P, TITLED_P, with_)

BASE = [LINES_P, SIGHTINGS_P, REFUNDS_P]


def _deduped(spark, sf_dir):
    return M.dedupe_in_message(P.sightings_p(spark, sf_dir))


@query("dedupe_in_message", with_(*BASE, DEDUPED) + "SELECT uid, pos, name FROM dd")
def dedupe_in_message(spark, sf_dir):
    return _deduped(spark, sf_dir).select("uid", "pos", "name")


@query("merge_lifecycle", with_(*BASE, DEDUPED, MERGED) + """
SELECT ROW_NUMBER() OVER (ORDER BY first_o) AS id, profile, seller, order_id, name, quantity,
       purchased_at, delivered_at, return_by, return_state, first_seq
FROM merged""")
def merge_lifecycle(spark, sf_dir):
    m = M.merge_lifecycle(_deduped(spark, sf_dir), P.refunds_p(spark, sf_dir))
    return m.select("id", "profile", "seller", "order_id", "name", "quantity", "purchased_at",
                    "delivered_at", "return_by", "return_state", "first_seq")


@query("merge_counts", with_(*BASE, DEDUPED, MERGED) + """
SELECT COUNT(*) AS added, CAST(SUM(n_enriched) AS BIGINT) AS enriched,
       CAST(SUM(n_sightings - 1 - n_enriched) AS BIGINT) AS duplicate_items,
       COUNT(*) FILTER (WHERE flipped) AS returned
FROM merged""")
def merge_counts(spark, sf_dir):
    return M.merge_counts(_deduped(spark, sf_dir), P.refunds_p(spark, sf_dir))


@query("refund_marks_returned", with_(*BASE, DEDUPED, MERGED) + """
SELECT order_id, name, return_state FROM merged WHERE flipped""")
def refund_marks_returned(spark, sf_dir):
    m = M.merge_lifecycle(_deduped(spark, sf_dir), P.refunds_p(spark, sf_dir), assign_ids=False)
    return m.filter("flipped").select("order_id", "name", "return_state")


_PREVIEW_SQL = """pv AS (
  SELECT r.uid, r.order_id, COUNT(i.order_id) AS would_flip
  FROM refunds_p r LEFT JOIN (SELECT * FROM snapshot_p WHERE COALESCE(return_state, '') <> 'returned') i
    ON COALESCE(r.profile, '') = COALESCE(i.profile, '') AND r.order_id = COALESCE(i.order_id, '')
   AND (COALESCE(r.name, '') = '' OR r.name = COALESCE(i.name, ''))
  GROUP BY r.uid, r.order_id)"""


@query("refund_preview", with_(*BASE, ITEMS_P, SNAPSHOT_P, _PREVIEW_SQL) + "SELECT * FROM pv")
def refund_preview(spark, sf_dir):
    return M.refund_preview(P.snapshot_p(spark, sf_dir), P.refunds_p(spark, sf_dir))


@query("known_items", with_(*BASE, ITEMS_P, SNAPSHOT_P, DEDUPED) + """,
known AS (SELECT DISTINCT COALESCE(profile, '') AS p, COALESCE(seller, '') AS s,
                 COALESCE(order_id, '') AS o, COALESCE(name, '') AS n FROM snapshot_p)
SELECT uid, pos, k.p IS NOT NULL AS known FROM dd LEFT JOIN known k
  ON COALESCE(dd.profile, '') = k.p AND COALESCE(dd.seller, '') = k.s
 AND COALESCE(dd.order_id, '') = k.o AND COALESCE(dd.name, '') = k.n""")
def known_items(spark, sf_dir):
    """does each sighting's natural key already exist in the catalogue."""
    return M.known_items(_deduped(spark, sf_dir), P.snapshot_p(spark, sf_dir)).select("uid", "pos", "known")


@query("distinct_order_lines", with_(*BASE) + """
SELECT COUNT(DISTINCT (COALESCE(profile, ''), COALESCE(seller, ''), COALESCE(order_id, ''),
                       COALESCE(name, ''))) AS n_keys,
       COUNT(DISTINCT uid) AS n_uids
FROM sightings_p""")
def distinct_order_lines(spark, sf_dir):
    """Distinct natural keys and distinct message ids among the sightings."""
    return M.distinct_keys(P.sightings_p(spark, sf_dir))


@query("catalog_insert", with_(*BASE, ITEMS_P, SNAPSHOT_P, DEDUPED) + """,
known AS (SELECT DISTINCT COALESCE(profile, '') AS p, COALESCE(seller, '') AS s,
                 COALESCE(order_id, '') AS o, COALESCE(name, '') AS n FROM snapshot_p),
fresh AS (
  SELECT dd.*, ROW_NUMBER() OVER (PARTITION BY COALESCE(dd.profile, ''), COALESCE(dd.seller, ''),
                                  COALESCE(dd.order_id, ''), COALESCE(dd.name, '') ORDER BY seq, pos) AS krn
  FROM dd LEFT JOIN known k ON COALESCE(dd.profile, '') = k.p AND COALESCE(dd.seller, '') = k.s
   AND COALESCE(dd.order_id, '') = k.o AND COALESCE(dd.name, '') = k.n
  WHERE k.p IS NULL)
SELECT (SELECT MAX(id) FROM snapshot_p) + ROW_NUMBER() OVER (ORDER BY seq, pos) AS id,
       profile, seller, order_id, name, COALESCE(NULLIF(quantity, 0), 1) AS quantity,
       COALESCE(source, 'template') AS source
FROM fresh WHERE krn = 1""")
def catalog_insert(spark, sf_dir):
    """Rows a run inserts into an existing catalogue (first sighting of
    each unknown key, quantity 1 when missing, ids after the current maximum)."""
    # project first: the merge carries and writes every column that its sides have
    snap = P.snapshot_p(spark, sf_dir).select("id", *M.KEY_COLS)
    seen = _deduped(spark, sf_dir).select("seq", "pos", *M.KEY_COLS, "quantity", "source")
    m = M.merge_lifecycle(seen, existing=snap)
    return m.filter("added").select("id", "profile", "seller", "order_id", "name", "quantity", "source")


@query("upsert_latest", """
SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type,
       arg_max(value, (ts, event_id)) AS value
FROM events GROUP BY user_id""")
def upsert_latest(spark, sf_dir):
    """Last write wins per key (here: each user's latest event)."""
    ev = P.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return M.upsert_latest(ev, "user_id", ["ts", "event_id"]).select(
        "user_id", "event_id", "event_type", "value")


_DECISIONS_SQL = """dec AS (
  SELECT key, CASE WHEN regexp_full_match(key, '[0-9]+') AND length(key) > 3 AND key LIKE '%001'
                   THEN 'evaluate' WHEN regexp_full_match(key, '[0-9]+') THEN 'keep' ELSE 'return' END AS state,
         CASE WHEN NOT regexp_full_match(key, '[0-9]+') THEN 1
              WHEN key LIKE '%001' AND length(key) > 3 THEN 3 ELSE 2 END AS seq
  FROM keys)"""


def decisions_p(spark, sf_dir):
    """Manual decisions: name fragments -> return (seq 1), order ids -> keep
    (seq 2), item ids -> evaluate (seq 3)."""
    k = search_keys(spark, sf_dir)
    digits = F.col("key").rlike("^[0-9]+$")
    item_id = digits & F.col("key").endswith("001") & (F.length("key") > 3)
    return k.select("key",
                    F.when(item_id, "evaluate").when(digits, "keep").otherwise("return").alias("state"),
                    F.when(~digits, 1).when(item_id, 3).otherwise(2).alias("seq"))


@query("apply_decisions", with_(LINES_P, ITEMS_P, SEARCH_KEYS_SQL, FIND_SQL, _DECISIONS_SQL) + """,
res AS (SELECT d.seq, d.key, d.state, f.id, f.return_state FROM found f JOIN dec d USING (key)
        WHERE f.tier = f.best)
SELECT seq, key, id, COALESCE(LAG(state) OVER (PARTITION BY id ORDER BY seq, key),
                              COALESCE(return_state, '(none)')) AS old_state, state AS new_state
FROM res""")
def apply_decisions(spark, sf_dir):
    items = P.items_p(spark, sf_dir)
    dec = decisions_p(spark, sf_dir)
    found = V.find_items(items.select(*SEARCH_COLS), dec.select("key"), P.PROFILE).select("key", "id")
    resolved = found.join(dec, "key")
    return M.apply_decisions(items, resolved).select("seq", "key", "id", "old_state", "new_state")


TARGET = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("quantity", T.IntegerType()), T.StructField("delivered_at", T.DateType()),
    T.StructField("return_state", T.StringType()), T.StructField("zone", T.StringType())])


@query("migrate_columns", with_(LINES_P, ITEMS_P) + """
SELECT id, name, COALESCE(CASE WHEN quantity % 3 <> 0 THEN quantity END, 1) AS quantity,
       CAST(NULL AS DATE) AS delivered_at, CAST(NULL AS VARCHAR) AS return_state,
       CAST(NULL AS VARCHAR) AS zone, maker FROM items_p""")
def migrate_columns(spark, sf_dir):
    """M9: a catalogue with missing quantities, written before the lifecycle
    and zone columns, and with a column that the layout doesn't name."""
    legacy = P.items_p(spark, sf_dir).select(
        "id", "name", "maker", F.when(F.col("quantity") % 3 != 0, F.col("quantity")).alias("quantity"))
    return M.migrate_columns(legacy, TARGET)


@query("remap_zone_ids", with_(LINES_P, ITEMS_P, TITLED_P, route_ctes(Z.DEFAULT_TAXONOMY, "titled_p"))
       + "SELECT id, zone, zone_secondary FROM routed")
def remap_zone_ids(spark, sf_dir):
    """A catalogue that stored legacy zone ids, remapped."""
    routed = Z.route_items(P.titled_items_p(spark, sf_dir), Z.DEFAULT_TAXONOMY)
    inverse = {v: k for k, v in M.LEGACY_ZONE_MAP.items()}
    back = F.create_map(*[x for k, v in inverse.items() for x in (F.lit(k), F.lit(v))])
    legacy = routed.select("id", F.coalesce(back[F.col("zone")], F.col("zone")).alias("zone"),
                           F.coalesce(back[F.col("zone_secondary")], F.col("zone_secondary"))
                           .alias("zone_secondary"))
    return M.remap_zone_ids(legacy)[0]


@query("catalog_counts", with_(*BASE, DEDUPED, MESSAGES_LOG_P) + """
SELECT (SELECT COUNT(*) FROM (SELECT DISTINCT COALESCE(profile, ''), COALESCE(seller, ''),
                                     COALESCE(order_id, ''), COALESCE(name, '') FROM dd)) AS items,
       (SELECT COUNT(*) FROM embeddings) AS embeddings,
       (SELECT COUNT(*) FROM messages_log_p) AS emails_logged""")
def catalog_counts(spark, sf_dir):
    """A1: rows of the merged catalogue, the embedding index and the log."""
    items = M.merge_lifecycle(_deduped(spark, sf_dir), assign_ids=False)
    return V.catalog_counts(items, P.table(spark, sf_dir, "embeddings"), P.messages_log_p(spark, sf_dir))


ITEM_REFUNDS_SQL = """item_refunds_p AS (
  SELECT 'i' || CAST(l_orderkey AS VARCHAR) AS uid, l_orderkey * 8 + 5 AS seq, 'market' AS profile,
         CAST(l_orderkey AS VARCHAR) AS order_id, p_name AS name
  FROM lines_p WHERE l_linenumber = 2 AND l_orderkey % 4 = 0)"""

# The catalogue of an earlier run: half of the delivery dates are not known yet.
EXISTING_SQL = """existing_p AS (
  SELECT * REPLACE (CASE WHEN id % 2 = 0 THEN delivered_at END AS delivered_at),
         'note ' || CAST(id AS VARCHAR) AS note FROM snapshot_p)"""


def existing_p(spark, sf_dir):
    """A catalogue as an earlier run left it, with a column that no mail fills."""
    return P.snapshot_p(spark, sf_dir).withColumn(
        "delivered_at", F.when(F.col("id") % 2 == 0, F.col("delivered_at"))).withColumn(
        "note", F.concat(F.lit("note "), F.col("id").cast("string")))


def all_refunds_p(spark, sf_dir):
    """Order-level refunds and refunds of single items."""
    lp = P.lines_p(spark, sf_dir).filter((F.col("l_linenumber") == 2) & (F.col("l_orderkey") % 4 == 0))
    order = F.col("l_orderkey").cast("string")
    single = lp.select(F.concat(F.lit("i"), order).alias("uid"), (F.col("l_orderkey") * 8 + 5).alias("seq"),
                       F.lit(P.PROFILE).alias("profile"), order.alias("order_id"), F.col("p_name").alias("name"))
    return P.refunds_p(spark, sf_dir).select("uid", "seq", "profile", "order_id", "name").unionByName(single)


@query("merge_into_existing", with_(*BASE, ITEMS_P, SNAPSHOT_P, DEDUPED, ITEM_REFUNDS_SQL, EXISTING_SQL) + """,
old AS (SELECT id, profile, seller, order_id, name, maker, price, quantity, purchased_at, delivered_at, return_by,
               return_state, owner, note, -1 AS seq, id AS pos FROM existing_p),
fresh AS (
  SELECT NULL AS id, profile, seller, order_id, name, maker, price, quantity, purchased_at, delivered_at, return_by,
         NULL AS return_state, NULL AS owner, NULL AS note, seq, pos FROM dd),
both_ AS (SELECT * FROM old UNION ALL SELECT * FROM fresh),
firsts AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY order_id, name ORDER BY seq, pos) AS rn
                          FROM both_) x WHERE rn = 1),
dates AS (SELECT order_id, name, arg_min(delivered_at, (seq, pos)) FILTER (WHERE delivered_at IS NOT NULL) AS d,
                 arg_min(return_by, (seq, pos)) FILTER (WHERE return_by IS NOT NULL) AS r
          FROM both_ GROUP BY order_id, name),
ref AS (SELECT order_id, MAX(seq) AS s FROM refunds_p GROUP BY order_id),
iref AS (SELECT order_id, name, MAX(seq) AS s FROM item_refunds_p GROUP BY order_id, name),
placed AS (SELECT f.*, d.d, d.r, greatest(coalesce(ref.s, -9), coalesce(iref.s, -9)) AS refund
  FROM firsts f JOIN dates d USING (order_id, name) LEFT JOIN ref USING (order_id) LEFT JOIN iref USING (order_id, name))
SELECT CASE WHEN seq < 0 THEN id ELSE (SELECT MAX(id) FROM old) + ROW_NUMBER() OVER (PARTITION BY seq < 0 ORDER BY seq, pos)
            END AS id,
       profile, seller, order_id, name, maker, price, quantity, purchased_at, d AS delivered_at, r AS return_by,
       CASE WHEN refund > seq THEN 'returned' WHEN seq < 0 THEN return_state ELSE 'evaluate' END AS return_state,
       owner, note, seq >= 0 AS added
FROM placed""")
def merge_into_existing(spark, sf_dir):
    """M1 + M2 + S6 against a catalogue that is there already: its rows keep
    ids, states, prices and their own columns, missing dates are filled,
    refunds of orders and of single items flip old and new rows."""
    m = M.merge_lifecycle(_deduped(spark, sf_dir), all_refunds_p(spark, sf_dir), existing_p(spark, sf_dir))
    return m.select("id", "profile", "seller", "order_id", "name", "maker", "price", "quantity", "purchased_at",
                    "delivered_at", "return_by", "return_state", "owner", "note", "added")


@query("decided_catalogue", with_(LINES_P, ITEMS_P, SEARCH_KEYS_SQL, FIND_SQL, _DECISIONS_SQL) + """,
res AS (SELECT f.id, arg_max(d.state, (d.seq, d.key)) AS state FROM found f JOIN dec d USING (key)
        WHERE f.tier = f.best GROUP BY f.id)
SELECT i.id, i.name, coalesce(res.state, i.return_state) AS return_state, i.price
FROM items_p i LEFT JOIN res USING (id)""")
def decided_catalogue(spark, sf_dir):
    """M4: the whole catalogue after the manual decisions."""
    items = P.items_p(spark, sf_dir)
    dec = decisions_p(spark, sf_dir)
    found = V.find_items(items.select(*SEARCH_COLS), dec.select("key"), P.PROFILE).select("key", "id")
    return M.decided_catalogue(items, found.join(dec, "key")).select("id", "name", "return_state", "price")
