"""Catalogue views: return windows, the returns report, date windows, key
search, export, counts, spend flags, order clusters and the README questions.

Every view is a DataFrame -> DataFrame function; ``today`` is always a
parameter so results are reproducible.
"""
from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import (DEFAULT_STATE, POLICY_WINDOW_DAYS, months_back_cutoff_py,
                               return_window, state_or_default)
from ..session import materialize
from .joins import substring_join
from .ranking import position_within

# Report sections in print order and the cluster knobs.
SECTIONS = ("open", "unknown", "expired", "returned")
CLUSTER_MIN_ORDERS = 3
CLUSTER_DAYS = 7
SPEND_FLAG_THRESHOLD = 75.0
UNKNOWN_DAYS_SORT = 1000000


def with_return_window(items: DataFrame, today, policy_days: int = POLICY_WINDOW_DAYS,
                       typed: bool = True) -> DataFrame:
    """X30 + M5 as flat columns next to the item."""
    w = return_window(today=today, policy_days=policy_days, typed=typed)
    return (items.withColumn("_w", w)
                 .withColumn("state", state_or_default("return_state"))
                 .withColumn("window_return_by", F.col("_w.return_by"))
                 .withColumn("days_left", F.col("_w.days_left"))
                 .withColumn("basis", F.col("_w.basis"))
                 .withColumn("window_status", F.col("_w.status"))
                 .withColumn("returnable", F.col("days_left") >= 0)
                 .drop("_w"))


def _section() -> Column:
    return (F.when(F.col("state") == "returned", "returned")
             .when(F.col("window_status") == "returnable", "open")
             .when(F.col("window_status") == "expired", "expired")
             .otherwise("unknown"))


def returns_sections(items: DataFrame, today, policy_days: int = POLICY_WINDOW_DAYS) -> DataFrame:
    """Section of each item in the returns report (state ``returned`` wins)."""
    rank_map = F.create_map(*[x for i, s in enumerate(SECTIONS) for x in (F.lit(s), F.lit(i + 1))])
    return (with_return_window(items, today, policy_days)
            .withColumn("section", _section())
            .withColumn("section_rank", rank_map[F.col("section")]))


def returns_report(items: DataFrame, today, policy_days: int = POLICY_WINDOW_DAYS,
                   order_col: str = "id") -> DataFrame:
    """O1: open by days_left ascending, expired by days_left descending
    (freshest first), unknown and returned in input order; ``rank`` is the
    position inside the section.  Sections are few and can be huge, so the rank
    comes from a distributed sort, not from a per-section window."""
    s = returns_sections(items, today, policy_days)
    key = (F.when(F.col("section") == "open", F.col("days_left"))
            .when(F.col("section") == "expired", -F.col("days_left"))
            .otherwise(F.lit(0)))
    s = s.withColumn("_k", key)
    out = position_within(s, "section_rank", [F.col("_k"), F.col(order_col)], name="rank")
    return out.drop("_k")


def returns_section_counts(items: DataFrame, today, policy_days: int = POLICY_WINDOW_DAYS) -> DataFrame:
    """Section sizes and how many of them still wait for a decision."""
    s = returns_sections(items, today, policy_days)
    return (s.groupBy("section", "section_rank")
             .agg(F.count(F.lit(1)).alias("n_items"),
                  F.count_if(F.col("state") == DEFAULT_STATE).alias("n_evaluate")))


# --- date windows -------------------------------------------------------------

def items_for_profile(items: DataFrame, profile: str) -> DataFrame:
    """S11 + F5: the profile's rows (NULL profile equals '')."""
    return items.filter(F.coalesce(F.col("profile"), F.lit("")) == (profile or ""))


def items_since(items: DataFrame, profile: str, since) -> DataFrame:
    """rows dated on/after ``since`` by order date, else delivery date;
    undated rows drop.  Carries the window date for ordering."""
    d = F.coalesce(F.col("purchased_at"), F.col("delivered_at"))
    since_c = F.lit(_dt.date.fromisoformat(since) if isinstance(since, str) else since)
    return (items_for_profile(items, profile)
            .withColumn("dated_at", d)
            .filter(F.col("dated_at") >= since_c))


def items_last_n_months(items: DataFrame, profile: str, months: int, today) -> DataFrame:
    """``--months N`` becomes a literal cut-off (day clamped to 28), so the
    filter stays a plain comparison the scan can push down."""
    return items_since(items, profile, months_back_cutoff_py(months, today))


# --- key search ---------------------------------------------------------------

def find_items(items: DataFrame, keys: DataFrame, profile: str) -> DataFrame:
    """F8 for a batch of keys: tier 1 numeric id, tier 2 exact order id,
    tier 3 case-insensitive name substring; per key only the best non-empty tier.

    Tiers 1 and 2 are equi-joins; tier 3 is a substring match, run only for the
    keys that found nothing in tiers 1-2, as an equi-join on their rare grams
    (no key x item comparison).  Digits beyond a BIGINT are no id.

    Items and the hits of tiers 1-2 are read many times and written once; give
    only the columns that are asked for."""
    it = materialize(items_for_profile(items, profile), "searched-items")
    k = keys.select("key")
    k_id = k.filter(F.col("key").rlike("^[0-9]+$")).withColumn("_kid", F.col("key").try_cast("long"))
    t1 = (k_id.join(it, F.col("_kid") == it.id)
              .select("key", F.lit(1).alias("tier"), *[it[c] for c in it.columns]))
    t2 = (k.join(it, F.col("key") == it.order_id)
           .select("key", F.lit(2).alias("tier"), *[it[c] for c in it.columns]))
    exact = materialize(t1.unionByName(t2), "exact-hits")
    best = exact.groupBy("key").agg(F.min("tier").alias("_best"))
    # Keys still unresolved: written once, the substring join sizes them.
    left = materialize(k.join(best, "key", "left_anti"), "unresolved-keys")
    t3 = (substring_join(it, left, "name", "key")
            .select("key", F.lit(3).alias("tier"), *it.columns))
    return exact.join(best, "key").filter(F.col("tier") == F.col("_best")).drop("_best").unionByName(t3)


# --- export -------------------------------------------------------------------

# Fixed value: the stored columns of a catalogue row, in their order.
EXPORT_FIELDS = ["id", "profile", "name", "maker", "price", "currency", "quantity", "seller", "order_id",
                 "purchased_at", "category", "image_path", "image_sha", "source", "delivered_at", "return_by",
                 "return_state", "zone", "zone_secondary", "zone_signal", "zone_confidence", "created_at"]


def export_json(items: DataFrame, today, policy_days: int = POLICY_WINDOW_DAYS,
                fields=EXPORT_FIELDS) -> DataFrame:
    """One JSON object per item, every stored field (NULL where the table
    hasn't got the column) plus ``return_window`` (status ``returned`` outranks
    the window); NULL fields are kept."""
    w = with_return_window(items, today, policy_days)
    rw = F.struct(
        F.col("window_return_by").cast("string").alias("return_by"),
        F.col("days_left").alias("days_left"),
        F.when(F.col("return_state") == "returned", "returned")
         .otherwise(F.col("window_status")).alias("status"),
        F.col("basis").alias("basis"))
    def value(c):
        if c not in w.columns:
            return F.lit(None).cast("string").alias(c)
        return F.col(c).cast("string").alias(c) if c.endswith("_at") or c == "return_by" else F.col(c)
    obj = F.struct(*map(value, fields), rw.alias("return_window"))
    return w.select("id", F.to_json(obj, {"ignoreNullFields": "false"}).alias("json"))


# --- counts and flags ---------------------------------------------------------

def catalog_counts(items: DataFrame, embeddings: DataFrame, ingest_log: DataFrame) -> DataFrame:
    """A1: global row counts of the three tables as one row."""
    tagged = (items.select(F.lit(0).alias("_t"))
              .unionByName(embeddings.select(F.lit(1).alias("_t")))
              .unionByName(ingest_log.select(F.lit(2).alias("_t"))))
    return tagged.agg(F.count_if(F.col("_t") == 0).alias("items"),
                      F.count_if(F.col("_t") == 1).alias("embeddings"),
                      F.count_if(F.col("_t") == 2).alias("emails_logged"))


def line_total() -> Column:
    return F.col("price") * F.coalesce(F.nullif(F.col("quantity"), F.lit(0)), F.lit(1))


def high_spend_items(items: DataFrame, threshold: float = SPEND_FLAG_THRESHOLD) -> DataFrame:
    """A5: line total strictly above the threshold; NULL price never flags."""
    return (items.withColumn("line_total", line_total())
                 .filter(F.col("line_total") > F.lit(threshold)))


def order_start_days(items: DataFrame, owner_col: str | None = None,
                     order_col: str = "id") -> DataFrame:
    """Per order the first non-empty purchase date in input order."""
    keys = ([owner_col] if owner_col else []) + ["order_id"]
    dated = items.filter(F.col("order_id").isNotNull() & (F.col("order_id") != "")
                         & F.col("purchased_at").isNotNull())
    return dated.groupBy(*keys).agg(F.min_by("purchased_at", order_col).alias("day"))


def order_clusters(items: DataFrame, owner_col: str | None = None, order_col: str = "id",
                   min_orders: int = CLUSTER_MIN_ORDERS, days: int = CLUSTER_DAYS) -> DataFrame:
    """W1 + A7: bursts of >= ``min_orders`` orders within ``days`` days.

    Orders are first reduced to (owner, day, count) -- bounded by the number of
    calendar days per owner, so one very active owner is still a small group --
    then a day-valued range frame gives, for each day, the orders in the
    preceding ``days`` days and the earliest of them; the largest window per
    start day is kept."""
    owner = [owner_col] if owner_col else []
    per_day = (order_start_days(items, owner_col, order_col)
               .groupBy(*owner, "day").agg(F.count(F.lit(1)).alias("cnt"))
               .withColumn("_d", F.unix_date("day")))
    w = Window.partitionBy(*owner).orderBy("_d").rangeBetween(-days, 0)
    win = (per_day.withColumn("n_orders", F.sum("cnt").over(w))
                  .withColumn("start", F.min("day").over(w))
                  .filter(F.col("n_orders") >= min_orders))
    return win.groupBy(*owner, "start").agg(F.max("n_orders").alias("n_orders"))


# --- questions from the README ------------------------------------------------

def shelf_by_category(items: DataFrame) -> DataFrame:
    """The shelf sorted by category (NULL last), name, id."""
    return items.orderBy(F.col("category").asc_nulls_last(), "name", "id")


def preorder_radar(items: DataFrame) -> DataFrame:
    """R2: paid but not arrived, oldest first."""
    st = F.coalesce(F.col("return_state"), F.lit(""))
    return (items.filter(F.col("purchased_at").isNotNull() & F.col("delivered_at").isNull()
                         & (st != "returned"))
                 .orderBy("purchased_at", "id"))


def unshipped_orders(sightings: DataFrame) -> DataFrame:
    """Orders with an order sighting but no shipment/delivery sighting."""
    ordered = sightings.filter(F.col("via") == "order").select("profile", "order_id").distinct()
    shipped = sightings.filter(F.col("via") == "shipment").select("profile", "order_id").distinct()
    return ordered.join(shipped, ["profile", "order_id"], "left_anti")


def spend_by_category(items: DataFrame) -> DataFrame:
    """Spend and line count per category and month of purchase."""
    return (items.withColumn("month", F.date_format("purchased_at", "yyyy-MM"))
                 .groupBy("category", "month")
                 .agg(F.round(F.sum(line_total()), 2).alias("spend"),
                      F.count(F.lit(1)).alias("n_lines")))


def receipt_search(items: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows whose name, maker, seller or order id holds the term (any case),
    by the rare grams of the terms."""
    with_hay = items.withColumn("_hay", F.concat_ws("\u0001", "name", "maker", "seller", "order_id"))
    return substring_join(with_hay, terms, "_hay", "term", id_col="id").drop("_hay")


def repeat_purchases(items: DataFrame) -> DataFrame:
    """(maker, name) bought in more than one order."""
    return (items.groupBy("maker", "name")
                 .agg(F.count_distinct("order_id").alias("n_orders"),
                      F.count(F.lit(1)).alias("n_lines"))
                 .filter(F.col("n_orders") > 1))


# --- text report rows (S9) ------------------------------------------------------

def price_text() -> Column:
    """Line total and currency, '(xN)' when N != 1, '?' without a price."""
    q = F.coalesce(F.nullif(F.col("quantity"), F.lit(0)), F.lit(1))
    base = F.trim(F.format_string("%.2f %s", F.col("price") * q, F.coalesce(F.col("currency"), F.lit(""))))
    return F.when(F.col("price").isNull(), F.lit("?")).otherwise(
        F.concat(base, F.when(q != 1, F.format_string(" (x%d)", q)).otherwise(F.lit(""))))


def clock_text() -> Column:
    """The window clock of the returns report."""
    d = F.col("days_left")
    rb = F.col("window_return_by").cast("string")
    return (F.when(d.isNull(), F.lit("no dates — window unknown"))
             .when(d < 0, F.format_string("expired %dd ago (%s)", -d, rb))
             .when(d == 0, F.format_string("LAST DAY today (%s)", rb))
             .otherwise(F.format_string("%d days left (until %s)", d, rb)))


def report_returns_lines(items: DataFrame, today, policy_days: int = POLICY_WINDOW_DAYS) -> DataFrame:
    """The returns report as rows (section_rank, rank, line): a title
    (section 0), one heading per section (rank 0), the item lines in report
    order, '(none)' for empty sections and the evaluate note under the open
    section.  The layout cuts names in ``line``; ``name`` has them whole."""
    r = returns_report(items, today, policy_days)
    show_clock = F.col("section").isin("open", "expired")
    flag = F.when(F.col("state") == DEFAULT_STATE,
                  F.lit("  <-- EVALUATE: decide before the window closes!")).otherwise(F.lit(""))
    line = F.concat(
        F.format_string("  [%3s] %-40.40s %-9s %14s", F.coalesce(F.col("id").cast("string"), F.lit("-")),
                        F.coalesce(F.col("name"), F.lit("(unnamed)")), F.col("state"), price_text()),
        F.when(show_clock, F.concat(F.lit("   ⏳ "), clock_text())).otherwise(F.lit("")), flag)
    body = r.select("section_rank", F.col("rank").cast("long").alias("rank"), line.alias("line"), "name")
    counts = r.groupBy("section_rank").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("state") == DEFAULT_STATE).alias("n_eval"))
    spark = items.sparkSession
    secs = spark.createDataFrame([(i + 1, s) for i, s in enumerate(SECTIONS)], "section_rank INT, section STRING")
    c = secs.join(F.broadcast(counts), "section_rank", "left").fillna(0, ["n", "n_eval"])
    # Fixed text of the section headings: (before the count, after it).
    titles = {"open": ("Still returnable (", ") — most urgent first:"),
              "unknown": ("Window unknown (", ") — no usable dates:"),
              "expired": ("Expired (", "):"), "returned": ("Already returned (", "):")}
    pre = F.create_map(*[x for k, v in titles.items() for x in (F.lit(k), F.lit(v[0]))])
    post = F.create_map(*[x for k, v in titles.items() for x in (F.lit(k), F.lit(v[1]))])
    heads = c.filter((F.col("section") != "unknown") | (F.col("n") > 0)).select(
        "section_rank", F.lit(0).cast("long").alias("rank"),
        F.concat(pre[F.col("section")], F.col("n").cast("string"), post[F.col("section")]).alias("line"))
    nones = c.filter((F.col("n") == 0) & (F.col("section") != "unknown")).select(
        "section_rank", F.lit(1).cast("long").alias("rank"), F.lit("  (none)").alias("line"))
    note = c.filter((F.col("section") == "open") & (F.col("n_eval") > 0)).select(
        "section_rank", (F.col("n") + 1).cast("long").alias("rank"),
        F.format_string("  (%d item(s) flagged `evaluate` — these need a decision)", F.col("n_eval")).alias("line"))
    title = spark.range(1).select(F.lit(0).alias("section_rank"), F.lit(0).cast("long").alias("rank"),
                                  F.lit(f"==== Returns — {today} (policy window {policy_days}d) ====").alias("line"))
    rest = title.unionByName(heads).unionByName(nones).unionByName(note)
    return rest.withColumn("name", F.lit(None).cast("string")).unionByName(body)


def triage_clock_text() -> Column:
    d = F.col("days_left")
    return (F.when(d.isNull(), F.lit("window unknown"))
             .when(d < 0, F.format_string("(expired %s)", F.col("window_return_by").cast("string")))
             .otherwise(F.format_string("⏳ %d days left", d)))
