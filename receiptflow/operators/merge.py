"""Order-sensitive, idempotent merge of sightings into the catalogue.

The sequential rule -- process sightings in message order; the first sighting
of a natural key inserts, later ones fill still-NULL lifecycle dates (enriched)
or change nothing (duplicate); a refund flips rows that existed before it --
is restated as per-key aggregates:

* the inserted row is the one with the smallest ``(seq, pos)``;
* a later sighting "fills" exactly when it is the first one carrying a
  delivery date, or the first one carrying a return-by date;
* a refund flips a row when the refund's ``seq`` is larger than the row's
  first ``seq`` (flips are idempotent, so only the largest refund matters).

All of these are ``min_by`` / ``max`` aggregates, which Spark computes with a
map-side partial aggregation, so a natural key holding a large share of all
sightings is combined before the shuffle instead of landing in one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import DEFAULT_STATE, STATES
from ..session import materialize
from .ranking import global_position

KEY_COLS = ["profile", "seller", "order_id", "name"]
DATE_COLS = ["delivered_at", "return_by"]
ROW_FIELDS = ["maker", "price", "currency", "quantity", "purchased_at", "category",
              "image_url", "source", "zone", "zone_secondary", "zone_signal", "zone_confidence",
              "return_state"]

DEFAULTS = {"quantity": 1, "source": "template", "return_state": DEFAULT_STATE}

# Legacy zone ids and the generic ids they map to.
LEGACY_ZONE_MAP = {
    "panda": "crafting",
    "pashmina": "home-org",
    "oxnard": "fandom-fun",
    "howdy": "resale",
    "dexter": "language-learning",
    "auntie-viv": "fitness",
    "hamtaro": "dev-hardware",
    "boss": "work-office",
    "cappy": "trips-events",
    "sandy": "gifts",
    "bijou": "content-gear",
    "maxwell": "academic",
}


#: What a merge adds to its rows about the run; no part of a catalogue that comes in.
RUN_COLS = ["first_seq", "first_pos", "added", "n_enriched", "n_duplicate", "flipped"]


def key_cols() -> list[Column]:
    """Natural key with NULL == '' (never ``<=>``)."""
    return [F.coalesce(F.col(c), F.lit("")).alias(f"k_{c}") for c in KEY_COLS]


K = [f"k_{c}" for c in KEY_COLS]


def _blank_null(c: str) -> Column:
    """Empty-string dates count as missing."""
    return F.when(F.col(c).cast("string") != "", F.col(c))


def dedupe_in_message(sightings: DataFrame) -> DataFrame:
    """M7: inside one message keep the first row per raw (seller, order_id,
    name) -- NULL groups with NULL, '' is a different value.  Partitioned by
    message id, so it is local to the message's rows."""
    w = Window.partitionBy("uid", "seller", "order_id", "name").orderBy("pos")
    return sightings.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def _rows(df: DataFrame, types: dict, seq: Column, pos: Column, item_id: Column) -> DataFrame:
    """Rows of either side in one layout: every column of ``types``, NULL where
    the side hasn't got it."""
    own = [(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()]
    dates = [(_blank_null(c) if c in df.columns else F.lit(None)).cast("date").alias(c) for c in DATE_COLS]
    return df.select(*own, *dates, *key_cols(), item_id.cast("long").alias("id"),
                     F.struct(seq.cast("long").alias("seq"), pos.cast("long").alias("pos")).alias("_o"))


def key_summary(sightings: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row per natural key: the inserted row's fields, its position, the
    first delivery / return-by date and where they came from, and counts.

    ``existing`` catalogue rows take part with ``seq = -1`` (they were there
    first) and keep every column they have, also those that no sighting has;
    they are never counted as added."""
    return judged(key_partials(sightings, existing))


def key_partials(sightings: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The aggregates behind :func:`key_summary`; partials of several sets of sightings
    add up to those of all (:func:`combine_partials`)."""
    types = {c: sightings.schema[c].dataType for c in [*KEY_COLS, *ROW_FIELDS] if c in sightings.columns}
    if existing is not None:
        types |= {f.name: f.dataType for f in existing.schema.fields
                  if f.name not in {*DATE_COLS, *K, *RUN_COLS, "id"}}
    fields = [c for c in types if c not in KEY_COLS]
    s = _rows(sightings, types, F.col("seq"), F.col("pos"), F.lit(None))
    if existing is not None:
        s = s.unionByName(_rows(existing, types, F.lit(-1), F.col("id"), F.col("id")))
    aggs = [F.min("_o").alias("first_o"),
            F.count(F.lit(1)).alias("n_sightings"),
            F.min_by(F.struct(*KEY_COLS, *fields, "id"), "_o").alias("row")]
    for c in DATE_COLS:
        aggs.append(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_o"))).alias(c))
        aggs.append(F.min(F.when(F.col(c).isNotNull(), F.col("_o"))).alias(f"{c}_o"))
    return s.groupBy(*K).agg(*aggs)


def combine_partials(partials: DataFrame, keys: list[str] = K, also: tuple[Column, ...] = ()) -> DataFrame:
    """Partials of the same key added up."""
    dates = [a for c in DATE_COLS for a in (F.min_by(c, f"{c}_o").alias(c), F.min(f"{c}_o").alias(f"{c}_o"))]
    return partials.groupBy(*keys).agg(
        F.min("first_o").alias("first_o"), F.sum("n_sightings").alias("n_sightings"),
        F.min_by("row", "first_o").alias("row"), *dates, *also)


def judged(g: DataFrame) -> DataFrame:
    """What came of a key's sightings, told by its partials."""
    fill_d = F.col("delivered_at_o").isNotNull() & (F.col("delivered_at_o") != F.col("first_o"))
    fill_r = F.col("return_by_o").isNotNull() & (F.col("return_by_o") != F.col("first_o"))
    both_same = fill_d & fill_r & (F.col("delivered_at_o") == F.col("return_by_o"))
    enriched = (fill_d.cast("int") + fill_r.cast("int") - both_same.cast("int"))
    return (g.withColumn("n_enriched", enriched)
             .withColumn("n_duplicate", F.col("n_sightings") - 1 - F.col("n_enriched"))
             .withColumn("added", F.col("first_o.seq") >= 0))


def known_items(sightings: DataFrame, catalogue: DataFrame) -> DataFrame:
    """sightings with ``known``, is their natural key in the catalogue."""
    keys = catalogue.select(*key_cols()).distinct().withColumn("known", F.lit(True))
    return sightings.select("*", *key_cols()).join(keys, K, "left").withColumn(
        "known", F.coalesce("known", F.lit(False))).drop(*K)


def distinct_keys(sightings: DataFrame) -> DataFrame:
    """Distinct natural keys and messages, one row."""
    return sightings.agg(F.count_distinct(*key_cols()).alias("n_keys"), F.count_distinct("uid").alias("n_uids"))


def refund_max_seq(refunds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Refund events reduced to their largest ``seq`` per (profile, order_id)
    (order-level) and per (profile, order_id, name) (item-level).  Refunds
    with an empty order id do nothing."""
    r = refunds.filter(F.coalesce(F.col("order_id"), F.lit("")) != "")
    p = F.coalesce(F.col("profile"), F.lit(""))
    order_lvl = (r.filter(F.coalesce(F.col("name"), F.lit("")) == "")
                  .groupBy(p.alias("k_profile"), F.col("order_id").alias("k_order_id"))
                  .agg(F.max("seq").alias("refund_seq_order")))
    item_lvl = (r.filter(F.coalesce(F.col("name"), F.lit("")) != "")
                 .groupBy(p.alias("k_profile"), F.col("order_id").alias("k_order_id"),
                          F.col("name").alias("k_name"))
                 .agg(F.max("seq").alias("refund_seq_item")))
    return order_lvl, item_lvl


def merge_lifecycle(sightings: DataFrame, refunds: DataFrame | None = None,
                    existing: DataFrame | None = None, assign_ids: bool = True) -> DataFrame:
    """M1 + M2 + S6: the catalogue after folding ``sightings`` (and refund
    events) into ``existing``.  New rows get ``id`` in insertion order after
    the largest existing id; quantity defaults to 1, source to ``template``,
    state to ``evaluate``.  Existing rows keep id, state and every other
    column; only missing dates are filled and refunds flip the state."""
    out = catalogue_rows(key_summary(sightings, existing), None if refunds is None else refund_max_seq(refunds))
    return assign_item_ids(out, existing) if assign_ids else out


def catalogue_rows(g: DataFrame, refunded: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """The catalogue's rows from one row per key and the refunds of :func:`refund_max_seq`."""
    fields = [c for c in g.schema["row"].dataType.fieldNames() if c not in KEY_COLS]
    out = g.select(
        *[F.col(f"row.{c}").alias(c) for c in [*KEY_COLS, *fields]],
        *DATE_COLS, *K, F.col("first_o.seq").alias("first_seq"),
        F.col("first_o.pos").alias("first_pos"), "added", "n_enriched", "n_duplicate")

    def fresh(column: str, kind: str, value) -> Column:
        """The column, with a default on new rows only."""
        own = F.col(column).cast(kind) if column in out.columns else F.lit(None).cast(kind)
        return F.when(F.col("added"), F.coalesce(value(own), F.lit(DEFAULTS[column]))).otherwise(own)

    out = out.withColumn("quantity", fresh("quantity", "int", lambda q: F.nullif(q, F.lit(0))))
    if "source" in out.columns:
        out = out.withColumn("source", fresh("source", "string", lambda x: x))
    out = out.withColumn("return_state", fresh("return_state", "string", lambda x: x))
    flipped = F.lit(False)
    if refunded is not None:
        order_lvl, item_lvl = refunded
        out = (out.join(order_lvl, ["k_profile", "k_order_id"], "left")
                  .join(item_lvl, ["k_profile", "k_order_id", "k_name"], "left"))
        last_refund = F.greatest(F.col("refund_seq_order"), F.col("refund_seq_item"))
        flipped = F.coalesce((last_refund > F.col("first_seq"))
                             & (F.coalesce("return_state", F.lit(DEFAULT_STATE)) != "returned"), F.lit(False))
    return out.withColumn("flipped", flipped).withColumn(
        "return_state", F.when(F.col("flipped"), "returned").otherwise(F.col("return_state"))).drop(
        "refund_seq_order", "refund_seq_item")


def assign_item_ids(merged: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Autoincrement emulation: existing rows keep their id, new rows are
    numbered in insertion order after the maximum.  The merged rows are written once:
    bounds, positions and the old rows read them."""
    merged = materialize(merged, "merged")
    base = 0 if existing is None else existing.agg(F.max(F.col("id").cast("long"))).first()[0] or 0
    numbered = global_position(merged.filter("added"), [F.col("first_seq"), F.col("first_pos"), *map(F.col, K)],
                               name="_p")
    numbered = numbered.withColumn("id", F.col("_p") + F.lit(base)).drop("_p")
    return numbered if existing is None else numbered.unionByName(merged.filter("NOT added"))


def merge_counts(sightings: DataFrame, refunds: DataFrame | None = None,
                 existing: DataFrame | None = None) -> DataFrame:
    """Counters of the apply run: added, enriched, duplicate_items, returned
    (one aggregate over the per-key summary)."""
    m = merge_lifecycle(sightings, refunds, existing, assign_ids=False)
    return m.agg(F.count_if("added").alias("added"),
                 F.coalesce(F.sum("n_enriched"), F.lit(0)).cast("long").alias("enriched"),
                 F.coalesce(F.sum("n_duplicate"), F.lit(0)).cast("long").alias("duplicate_items"),
                 F.count_if("flipped").alias("returned"))


def refund_preview(items: DataFrame, refunds: DataFrame) -> DataFrame:
    """M3: per refund event, how many catalogue rows it would flip now
    (same profile and order id, name too when the refund names one, state not
    yet ``returned``).  Refunds with an empty order id count 0."""
    r = refunds.select("uid", "profile", "order_id", "name")
    it = items.select(F.coalesce("profile", F.lit("")).alias("ip"),
                      F.coalesce("order_id", F.lit("")).alias("io"),
                      F.coalesce("name", F.lit("")).alias("iname"),
                      F.coalesce("return_state", F.lit("")).alias("ist"))
    it = it.filter(F.col("ist") != "returned")
    cond = ((F.coalesce(r.profile, F.lit("")) == it.ip) & (r.order_id == it.io)
            & ((F.coalesce(r.name, F.lit("")) == "") | (r.name == it.iname)))
    j = r.join(it, cond, "left")
    return j.groupBy("uid", "order_id").agg(F.count("io").alias("would_flip"))


def check_states(states: DataFrame, column: str = "state") -> None:
    """raise if any decision asks for a state that doesn't exist."""
    bad = [r[0] for r in states.filter(~F.coalesce(F.col(column).isin(*STATES), F.lit(False)))
           .select(column).distinct().limit(5).collect()]
    if bad:
        raise ValueError(f"unknown return state(s) {bad}; known: {', '.join(STATES)}")


def apply_decisions(items: DataFrame, resolved: DataFrame) -> DataFrame:
    """M4 + F11: ``resolved(seq, key, state, id)`` are manual decisions already
    resolved to item ids by :func:`views.find_items`.  An unknown state fails
    the run; per item the decisions apply in ``seq`` order, each reporting
    old -> new.  Decisions are ordered by (seq, key), so equal ``seq`` values
    still give one answer."""
    resolved = materialize(resolved, "decisions")   # the check reads all of them, and then the join
    check_states(resolved)
    cur = items.select("id", F.coalesce(F.col("return_state"), F.lit("(none)")).alias("_orig"))
    j = resolved.join(cur, "id")
    w = Window.partitionBy("id").orderBy("seq", "key")
    return j.select("seq", "key", "id",
                    F.coalesce(F.lag("state").over(w), F.col("_orig")).alias("old_state"),
                    F.col("state").alias("new_state"))


def decided_catalogue(items: DataFrame, resolved: DataFrame) -> DataFrame:
    """M4: the catalogue after the decisions: per item the last one's state,
    every other column and row unchanged."""
    resolved = materialize(resolved, "decisions")
    check_states(resolved)
    last = resolved.groupBy("id").agg(F.max_by("state", F.struct("seq", "key")).alias("_state"))
    return items.join(last, "id", "left").withColumn(
        "return_state", F.coalesce("_state", "return_state")).drop("_state").select(*items.columns)


def dry_run_counts(sightings: DataFrame, refunds: DataFrame, snapshot: DataFrame) -> DataFrame:
    """M6: what a dry run reports against a catalogue snapshot.  It writes
    nothing, so every sighting is judged against the snapshot alone: unknown
    key -> added (repeats too, without an image ``no_image`` as well), known key
    with any date -> enriched, else duplicate; refunds count the snapshot rows
    they would flip."""
    snap = snapshot.select(*key_cols()).distinct().withColumn("_known", F.lit(True))
    image = F.col("image_url") if "image_url" in sightings.columns else F.lit(None)
    s = sightings.select(*key_cols(), *[_blank_null(c).alias(c) for c in DATE_COLS], image.isNull().alias("_bare"))
    j = s.join(snap, K, "left")
    known = F.coalesce(F.col("_known"), F.lit(False))
    has_date = F.col("delivered_at").isNotNull() | F.col("return_by").isNotNull()
    names = ["added", "enriched", "duplicate_items", "no_image", "returned"]
    zero = F.lit(0).cast("long")
    per_row = j.select(*[c.cast("long").alias(n) for n, c in zip(names, (
        ~known, known & has_date, known & ~has_date, ~known & F.col("_bare"), zero))])
    flips = refund_preview(snapshot, refunds).select(
        *[zero.alias(n) for n in names[:-1]], F.col("would_flip").cast("long").alias("returned"))
    return per_row.unionByName(flips).agg(*[F.coalesce(F.sum(n), zero).alias(n) for n in names])


#: Layout of a catalogue whose zone ids are the current ones.
ZONE_LAYOUT = 1


def remap_zone_ids(items: DataFrame, version: int = 0) -> tuple[DataFrame, int]:
    """Legacy zone ids -> current ids in ``zone`` and ``zone_secondary``,
    once: a catalogue whose ``version`` is ``ZONE_LAYOUT`` already is returned as
    it is (its user may have given a legacy name to a zone of their own)."""
    if version >= ZONE_LAYOUT:
        return items, version
    m = F.create_map(*[x for k, v in LEGACY_ZONE_MAP.items() for x in (F.lit(k), F.lit(v))])
    out = items
    for c in ("zone", "zone_secondary"):
        out = out.withColumn(c, F.coalesce(m[F.col(c)], F.col(c)))
    return out, ZONE_LAYOUT


MIGRATION_DEFAULTS = {"quantity": 1}


def migrate_columns(old: DataFrame, target_schema) -> DataFrame:
    """M9: bring rows of an older table layout to ``target_schema``: missing
    columns are added (NULL, quantity 1), NULL quantities become 1, and columns
    that the target doesn't name stay, after the others."""
    def column(f):
        value = (F.col(f.name) if f.name in old.columns else F.lit(None)).cast(f.dataType)
        default = MIGRATION_DEFAULTS.get(f.name)
        return (value if default is None else F.coalesce(value, F.lit(default).cast(f.dataType))).alias(f.name)
    known = set(target_schema.fieldNames())
    return old.select(*map(column, target_schema.fields), *[c for c in old.columns if c not in known])


def upsert_latest(rows: DataFrame, key: str | list[str], order_cols: list[str]) -> DataFrame:
    """Last write wins per key.  ``max_by`` over a struct of the ordering
    columns is a partial aggregate, so a hot key is combined map-side."""
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in rows.columns if c not in keys]
    order = F.struct(*[F.col(c) for c in order_cols])
    g = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])
