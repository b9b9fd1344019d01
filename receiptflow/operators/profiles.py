"""Collection profiles: gates, templates, item predicate, classifier, enricher.

A profile is driver-side configuration that *builds Column expressions*; it
never runs per row in Python, but for messages that a ``PythonTemplate`` claims.  A template is ``(name, matches, items)`` where
``matches`` is a boolean Column and ``items`` an ARRAY<STRUCT> Column over the
message columns (uid, seq, from_addr, subject, msg_date, text, html).
Dispatch is one CASE (first matching template wins, and only the winning
template's extractors are evaluated).
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as X
from ..functions.dates import DEFAULT_STATE
from . import classify as C
from . import extract as E
from .zones import DEFAULT_TAXONOMY, Taxonomy, route_items

ROW_SCHEMA = ("name STRING, maker STRING, price DOUBLE, currency STRING, quantity INT, "
              "seller STRING, order_id STRING, purchased_at DATE, image_url STRING, "
              "source STRING, delivered_at DATE, return_by DATE, is_gift STRING, "
              "return_event STRING")
ROW_TYPE = "array<struct<" + ", ".join(
    f"{n}:{t.lower()}" for n, t in (p.strip().split(" ") for p in ROW_SCHEMA.split(","))) + ">>"


def empty_rows() -> Column:
    return F.array().cast(ROW_TYPE)


def row(name=None, maker=None, price=None, currency=None, quantity=None, seller=None,
        order_id=None, purchased_at=None, image_url=None, source="template",
        delivered_at=None, return_by=None, is_gift=None, return_event=None) -> Column:
    """One sighting struct with the fixed field order and types."""
    def v(x, t):
        if x is None:
            return F.lit(None).cast(t)
        return (F.lit(x) if not isinstance(x, Column) else x).cast(t)
    return F.struct(v(name, "string").alias("name"), v(maker, "string").alias("maker"),
                    v(price, "double").alias("price"), v(currency, "string").alias("currency"),
                    v(quantity, "int").alias("quantity"), v(seller, "string").alias("seller"),
                    v(order_id, "string").alias("order_id"),
                    v(purchased_at, "date").alias("purchased_at"),
                    v(image_url, "string").alias("image_url"), v(source, "string").alias("source"),
                    v(delivered_at, "date").alias("delivered_at"),
                    v(return_by, "date").alias("return_by"), v(is_gift, "string").alias("is_gift"),
                    v(return_event, "string").alias("return_event"))


@dataclass
class Template:
    name: str
    matches: Callable[[], Column]
    items: Callable[[], Column]


@dataclass
class PythonTemplate(Template):
    """H7: a template whose rows come from Python.  ``read`` gets a message as a dict (uid,
    from_addr, subject, msg_date, text) and gives dicts of row fields; it must be importable
    on the workers or a closure.  It runs on the messages that ``matches`` claims, in Arrow
    batches; all other mail stays in the JVM.  A message on which it fails has no rows."""
    items: Callable[[], Column] = empty_rows
    read: Callable[[dict], list[dict]] = lambda message: []


READ_FIELDS = ["uid", "from_addr", "subject", "msg_date", "text"]


def _rows_type() -> T.DataType:
    return T.StructType.fromDDL(f"items {ROW_TYPE}")[0].dataType


def _read_batches(batches, readers: dict, names: list[str], kind: pa.DataType):
    fields = [f.name for f in kind.value_type]
    for batch in batches:
        told = batch.select([*READ_FIELDS, "via"]).to_pylist()
        out = []
        for message in told:
            try:
                rows = [{"source": "template"} | r for r in readers[message.pop("via")](message)]
                out.append(pa.array([[{f: r.get(f) for f in fields} for r in rows]], kind).to_pylist()[0])
            except Exception:  # noqa: BLE001 - one bad mail must not fail the job
                out.append([])
        kept = [batch.column(n) for n in names]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(out, kind)], [*names, "items"])


def _with_python_rows(parsed: DataFrame, readers: dict) -> DataFrame:
    """``parsed`` with the rows of the messages that Python templates have claimed."""
    claimed = F.col("via").isin(*readers)
    names = [c for c in parsed.columns if c != "items"]
    schema = T.StructType([parsed.schema[c] for c in names]).add("items", _rows_type())
    kind = to_arrow_type(_rows_type())
    read = parsed.filter(claimed).select(*names).mapInArrow(lambda b: _read_batches(b, readers, names, kind), schema)
    return parsed.filter(~claimed).select(*names, "items").unionByName(read)


@dataclass
class CollectionProfile:
    name: str
    description: str
    sender_allowlist: list
    keyword_gate: list
    subject_blocklist: list
    merchant_denylist: list
    templates: list
    item_predicate: Callable[[], Column] | None = None
    classifier: Callable[[], Column] | None = None
    item_enricher: Callable[[DataFrame], DataFrame] | None = None
    llm_noun: str = "purchase"
    # H5: noun -> prompt Column; None takes the library's prompt.
    prompt_builder: Callable[[str], Column] | None = None
    # Per-message helper columns computed once before dispatch (name -> builder).
    message_columns: dict = field(default_factory=dict)
    # Columns staged after ``via`` is known (ordered; may read ``via`` and the
    # columns before them), so each extractor array is built once per message.
    stage_columns: list = field(default_factory=list)

    # F1
    def passes_subject_blocklist(self, subject="subject") -> Column:
        low = F.lower(F.coalesce(F.col(subject), F.lit("")))
        return ~C.contains_any(low, self.subject_blocklist)

    # F2 (cheap subject test first)
    def passes_keyword_gate(self, subject="subject", text="text") -> Column:
        hay = F.lower(F.concat(F.coalesce(F.col(subject), F.lit("")), F.lit("\n"),
                               F.coalesce(F.col(text), F.lit(""))))
        return self.passes_subject_blocklist(subject) & C.contains_any(hay, self.keyword_gate)

    # F3
    def is_denied_merchant(self, seller="seller", maker="maker") -> Column:
        hay = F.lower(F.concat(F.coalesce(F.col(seller), F.lit("")), F.lit(" "),
                               F.coalesce(F.col(maker), F.lit(""))))
        return C.contains_any(hay, self.merchant_denylist)

    # F4
    def is_item(self) -> Column:
        ok = ~self.is_denied_merchant()
        if self.item_predicate is not None:
            ok = ok & self.item_predicate()
        return ok

    def dispatch(self) -> tuple[Column, Column]:
        """(via, items).  First matching template claims the message
        even when it extracts nothing; no match -> via 'none'."""
        via = F.lit("none")
        items = empty_rows()
        for t in reversed(self.templates):
            via = F.when(t.matches(), F.lit(f"template:{t.name}")).otherwise(via)
        for t in reversed(self.templates):
            items = F.when(F.col("via") == f"template:{t.name}", t.items()).otherwise(items)
        return via, items


PROFILES: dict[str, CollectionProfile] = {}


def register(p: CollectionProfile) -> CollectionProfile:
    PROFILES[p.name] = p
    return p


def load_profile(name: str) -> CollectionProfile:
    """H6: unknown names fail with the list of available profiles."""
    if name not in PROFILES:
        raise KeyError(f"unknown profile {name!r}; available: {', '.join(available())}")
    return PROFILES[name]


def available() -> list[str]:
    return sorted(PROFILES)


# --- the marketplace profile ------------------------------------------------------

KIND_RE = r"(?iU)\b(shipped|delivered|out for delivery|arriving)\b"
MARKET_SENDER_HINT = "amazon."


def _from_has(hint: str) -> Column:
    return F.contains(F.coalesce(F.col("from_addr"), F.lit("")), F.lit(hint))


def _lower(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def _market_rows(arr: Column, *, purchased=True, delivered=None, return_by=None,
                 gift=None) -> Column:
    oid = F.col("_oid")          # computed once per message (message_columns)
    img = F.col("_img")
    return F.transform(arr, lambda it: row(
        name=it["title"], maker="Amazon", price=it["price"], currency=it["currency"],
        quantity=it["quantity"], seller="amazon.com", order_id=oid,
        purchased_at=F.col("msg_date") if purchased else None, image_url=img,
        delivered_at=delivered, return_by=return_by, is_gift=gift))


def market_templates(tax: Taxonomy = DEFAULT_TAXONOMY, owner: str | None = None,
                     hint: str = MARKET_SENDER_HINT) -> list[Template]:
    def body():
        return F.col("text")

    def subj():
        return F.col("subject")

    def refund_items():
        oid = F.col("_oid")
        one = F.array(row(maker="Amazon", seller="amazon.com", order_id=oid, return_event="returned"))
        return F.when(oid.isNotNull(), one).otherwise(empty_rows())

    def staged():
        return [F.col(c) for c in ("_blk", "_line", "_subj")]

    def shipment_items():
        arr = E.cascade(*staged(), F.col("_bare"))
        return _market_rows(arr, purchased=False, delivered=F.col("_delivered"))

    def return_window_items():
        arr = E.cascade(*staged(), F.col("_bare"))
        return _market_rows(arr, purchased=False, return_by=F.col("_return_by"))

    def order_items():
        arr = E.cascade(*staged())
        return _market_rows(arr, return_by=F.col("_return_by"), gift=F.col("_gift"))

    # Fixed order: refund first (its subjects also trip the others), then
    # shipment, return window, order.
    return [
        Template("amazon_refund", lambda: _from_has(hint) & subj().rlike(r"(?iU)\brefund"), refund_items),
        Template("amazon_shipment", lambda: _from_has(hint) & F.coalesce(subj(), F.lit("")).rlike(KIND_RE),
                 shipment_items),
        Template("amazon_return_window", lambda: _from_has(hint) & F.contains(_lower("subject"), F.lit("return")),
                 return_window_items),
        Template("amazon_order",
                 lambda: (_from_has(hint)
                          & (F.contains(_lower("subject"), F.lit("order"))
                             | F.contains(_lower("text"), F.lit("order confirmation")))
                          & ~F.coalesce(subj(), F.lit("")).rlike(KIND_RE)),
                 order_items),
    ]


def market_stages(tax: Taxonomy = DEFAULT_TAXONOMY, owner: str | None = None) -> list:
    """What only some templates read, as staged columns: dates and gift signal, then
    the extractor cascade: block items for the item templates, line items only when
    no block matched, the subject item only when neither did, bare lines (shipment /
    return window) last."""
    item_vias = ["template:amazon_shipment", "template:amazon_return_window", "template:amazon_order"]
    bare_vias = item_vias[:2]

    def empty(c):
        return F.coalesce(F.size(F.col(c)), F.lit(0)) == 0

    via = lambda: F.col("via")
    return [
        ("_delivered", lambda: F.when(via() == item_vias[0], X.delivered_date("text", "subject", "msg_date"))),
        ("_return_by", lambda: F.when(via().isin(*item_vias[1:]), X.return_by_date("text"))),
        ("_gift", lambda: F.when(via() == item_vias[2], X.gift_signal("text", tax.gift_regex, owner))),
        ("_blk", lambda: F.when(via().isin(*item_vias), E.block_items(F.col("text")))),
        ("_line", lambda: F.when(via().isin(*item_vias) & empty("_blk"), E.line_items(F.col("text")))),
        ("_subj", lambda: F.when(via().isin(*item_vias) & empty("_blk") & empty("_line"),
                                 E.subject_item(F.col("subject")))),
        ("_bare", lambda: F.when(via().isin(*bare_vias) & empty("_blk") & empty("_line") & empty("_subj"),
                                 E.bare_items(F.col("text")))),
    ]


def _market_enrich(tax: Taxonomy):
    def enrich(df: DataFrame) -> DataFrame:
        df = df.withColumn("return_state", F.coalesce(F.col("return_state"), F.lit(DEFAULT_STATE))) \
            if "return_state" in df.columns else df.withColumn("return_state", F.lit(DEFAULT_STATE))
        return route_items(df, tax)
    return enrich


def marketplace_profile(tax: Taxonomy = DEFAULT_TAXONOMY, owner: str | None = None,
                        hint: str = MARKET_SENDER_HINT) -> CollectionProfile:
    # Sender allowlist, keyword gate and subject blocklist.
    return CollectionProfile(
        name="amazon",
        description="Marketplace orders with a returns tracker and life-zone triage.",
        sender_allowlist=["amazon.com"],
        keyword_gate=["your order", "order confirmation", "order #", "has shipped",
                      "shipped:", "delivered", "out for delivery", "arriving",
                      "return window", "your package", "your amazon.com order", "refund"],
        subject_blocklist=["% off", "deal", "deals", "sponsored", "recommended for you",
                           "coupon", "lightning", "prime day", "kindle unlimited",
                           "rate your", "review your purchase", "how was your",
                           "verify your", "reset your", "sign-in", "sign in"],
        merchant_denylist=[],
        templates=market_templates(tax, owner, hint),
        classifier=lambda: C.market_category("name"),
        item_enricher=_market_enrich(tax),
        llm_noun="Amazon purchase",
        message_columns={"_oid": lambda: X.marketplace_order_id("subject", "text"),
                         "_img": lambda: X.first_product_image("html")},
        stage_columns=market_stages(tax, owner),
    )


# --- the demo profile ------------------------------------------------------------

# Accessory words that are not games.
NON_GAME_TYPES = ("card sleeve", "sleeves", "playmat", "play mat", "dice tray", "insert",
                  "organizer", "gift card", "shipping protection")
DEMO_ORDER_RE = r"(?iU)order\s*#?\s*([A-Za-z0-9-]{4,})"


def demo_templates() -> list[Template]:
    def meeple_items():
        oid = F.nullif(F.regexp_extract(F.coalesce(F.col("text"), F.lit("")), DEMO_ORDER_RE, 1), F.lit(""))
        img = X.first_product_image("html")
        arr = E.line_items(F.col("text"), E.LINE_OPEN_RE)
        return F.transform(arr, lambda it: row(
            name=it["title"], maker="Meeple Market", price=it["price"], currency=it["currency"],
            quantity=it["quantity"], seller="Meeple Market", order_id=oid,
            purchased_at=F.col("msg_date"), image_url=img))

    return [
        Template("meeple_shipment", lambda: _from_has("meeplemarket.example"), meeple_items),
        Template("generic", lambda: F.lit(True), lambda: parse_generic_order()),
    ]


def parse_generic_order() -> Column:
    """One row (subject-derived name, first price, generic order id,
    sender domain) when a price or a product image was found."""
    p = X.first_price("text")
    img = X.first_product_image("html")
    one = F.array(row(name=X.item_name_from_subject("subject"), price=p["price"],
                      currency=p["currency"], quantity=1, seller=X.seller_domain("from_addr"),
                      order_id=X.generic_order_id("text"), purchased_at=F.col("msg_date"),
                      image_url=img))
    # a test of the built row: a CASE on price and image would find both a second time
    return F.filter(one, lambda r: r["price"].isNotNull() | r["image_url"].isNotNull())


def demo_profile() -> CollectionProfile:
    # The demo shops, gate words, blocklist and infra denylist.
    return CollectionProfile(
        name="demo",
        description="Synthetic board-game collection (fictional shops, offline fixtures).",
        sender_allowlist=["meeplemarket.example", "tabletoptrove.example",
                          "boardgamebazaar.example", "shop.app"],
        keyword_gate=["your order", "order confirmation", "order confirmed",
                      "thank you for your order", "thank you for your purchase",
                      "receipt", "your purchase", "order #", "order number",
                      "your games shipped", "has shipped", "board game", "tabletop"],
        subject_blocklist=["% off", "flash sale", "coupon", "coming soon", "price drop",
                           "back in stock", "abandoned cart", "still in your cart", "wishlist",
                           "newsletter", "leave a review", "rate your", "how was your",
                           "refund", "return label", "we received your return",
                           "verify your", "reset your", "sign in", "log in"],
        merchant_denylist=["cloudflare", "github", "vercel", "namecheap", "godaddy", "openai",
                           "anthropic", "aws", "google cloud", "spotify", "netflix", "uber",
                           "doordash", "stamps.com", "pirate ship", "pitney bowes"],
        templates=demo_templates(),
        item_predicate=lambda: ~C.contains_any(F.lower(F.coalesce(F.col("name"), F.lit(""))),
                                               NON_GAME_TYPES),
        classifier=lambda: C.demo_category("name", "maker"),
        llm_noun="board-game purchase",
    )


register(marketplace_profile())
register(demo_profile())


# --- the message -> sightings pipeline --------------------------------------------

def parse_messages(messages: DataFrame, profile: CollectionProfile) -> DataFrame:
    """Gate + dispatch: one row per message with ``gate_ok``, ``via``,
    ``msg_image`` and ``items`` (empty when gated out), an array of
    (pos, row) in which each (seller, order_id, name) stands once (M7);
    ``n_found`` counts the rows before that.

    The cheap subject test comes first: the HTML is only stripped, and the
    patterns only run, for messages that are still in."""
    via, items = profile.dispatch()
    body = X.combine_body(F.col("text"), X.html_to_text("html"))
    d = messages.withColumn("text", F.when(profile.passes_subject_blocklist(), body).otherwise(F.col("text")))
    d = d.withColumn("gate_ok", profile.passes_keyword_gate())
    for name, build in profile.message_columns.items():
        d = d.withColumn(name, F.when(F.col("gate_ok"), build()))
    d = d.withColumn("via", F.when(F.col("gate_ok"), via).otherwise(F.lit("gate")))
    for name, build in profile.stage_columns:
        d = d.withColumn(name, F.when(F.col("gate_ok"), build()))
    d = d.withColumn("items", F.when(F.col("gate_ok"), items).otherwise(empty_rows()))
    image = F.col("_img") if "_img" in profile.message_columns else X.first_product_image("html")
    d = d.withColumn("msg_image", F.when(F.col("gate_ok"), image))
    if readers := {f"template:{t.name}": t.read for t in profile.templates if isinstance(t, PythonTemplate)}:
        d = _with_python_rows(d, readers)
    d = d.withColumn("n_found", F.size("items")).withColumn("items", first_of_each(F.col("items")))
    return d.drop(*profile.message_columns, *[n for n, _ in profile.stage_columns])


def first_of_each(items: Column) -> Column:
    """M7 inside a message: (pos, row) of the first row per (seller, order_id, name), a
    NULL like any other value.  No window and no shuffle: a message is one row."""
    keys = F.transform(items, lambda x: F.struct(x["seller"], x["order_id"], x["name"]))
    placed = F.transform(items, lambda x, i: F.struct((i + 1).alias("pos"), x.alias("it")))
    # the keys are bound outside the filter, which would make all of them anew for each row
    return F.get(F.transform(F.array(keys), lambda own: F.filter(
        placed, lambda x: F.array_position(own, F.get(own, x["pos"] - 1)) == x["pos"])), 0)


#: What the explode reads of a parsed message; bodies and HTML stay behind.
PARSED = ["uid", "seq", "via", "msg_image", "items"]


def explode_sightings(parsed: DataFrame, profile: CollectionProfile) -> DataFrame:
    """One row per item with the profile's name; keeps ``keep`` (F4) so that
    callers can count ``non_item`` rows."""
    x = parsed.select("uid", "seq", "via", "msg_image", F.explode("items").alias("x"))
    x = x.select("uid", "seq", "via", "msg_image", "x.pos", "x.it.*").withColumn("profile", F.lit(profile.name))
    return x.withColumn("keep", F.col("return_event").isNotNull() | profile.is_item())


def finish_items(sightings: DataFrame, profile: CollectionProfile) -> DataFrame:
    """Classifier + enricher + image fallback for kept, non-event rows."""
    return finish_sightings(sightings.filter("keep AND return_event IS NULL"), profile)


def finish_sightings(sightings: DataFrame, profile: CollectionProfile) -> DataFrame:
    """Classifier + enricher + the message's image as fallback on every row
    (refund events keep NULLs there); ``keep`` and ``return_event`` stay for
    the caller."""
    s = sightings.withColumn("category", profile.classifier() if profile.classifier
                             else F.lit(None).cast("string"))
    if profile.item_enricher:
        s = profile.item_enricher(s)
    return s.withColumn("image_url", F.coalesce("image_url", "msg_image")).drop("msg_image")
