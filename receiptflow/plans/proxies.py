"""Deterministic proxy inputs built from the driver tables.

The driver tables hold no mail, so the catalogue questions run on proxies
derived from them (order lines -> catalogue rows, purchase events -> orders,
embeddings -> the image index).  Every proxy is a lazy DataFrame over the whole
tables; nothing is sampled or capped.
"""
from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import global_position
from ..session import materialize

# Fixed values the proxy questions are asked with (oracle parity needs them pinned).
TODAY = _dt.date(2001, 7, 1)
POLICY_DAYS = 30
PROFILE = "market"
SELLER = "market.example"
HIGH_SPEND = 40000.0

# Fixed values for the proxy catalogue titles: one product word per p_size
# bucket, so item names carry the vocabulary the classifiers and the default
# taxonomy look for (p_size 1..50 cycles through the 25 words).
PRODUCT_WORDS = [
    "Craft Vinyl Roll", "Acrylic Sheet Pack", "Storage Bins", "Anime Figure", "Manga Paperback",
    "Bulk Lot of 100", "Spanish Phrasebook", "Yoga Mat", "Raspberry Pi Kit", "Mechanical Keyboard",
    "Travel Adapter", "Ring Light", "Poster Tube", "Cutting Board", "Protein Powder",
    "Enamel Pins", "Poly Mailers", "USB Cable", "Hoodie", "Board Game",
    "Card Sleeves", "Wholesale Display Board", "Candle Set", "Dumbbell Pair", "Wingspan Expansion",
]

# Stable tie-break for the position of a line inside its order.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
              "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lines_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with a total position ``pos`` inside each order."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    part = table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_retailprice", "p_size")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate",
                                                   "o_orderpriority")
    # part first (shuffle on partkey), then orders: the result stays hash
    # partitioned on the order key, which the per-order window below reuses.
    j = (li.join(part, li.l_partkey == part.p_partkey)
           .join(orders, F.col("l_orderkey") == orders.o_orderkey))
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    return j.select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_linestatus", "l_returnflag",
        "l_discount", "p_name", "p_brand", "p_type", "p_retailprice", "p_size", "o_custkey",
        "o_orderpriority",
        product_title().alias("title"),
        F.col("o_orderdate").cast("date").alias("o_day"),
        F.col("l_shipdate").cast("date").alias("s_day"),
        F.row_number().over(w).alias("pos"))


def items_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows: one per (order, part name), first line wins."""
    lp = lines_p(spark, sf_dir)
    w = Window.partitionBy("l_orderkey", "p_name").orderBy("pos")
    f = lp.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return f.select(
        (F.col("l_orderkey") * 1000 + F.col("pos")).alias("id"),
        F.lit(PROFILE).alias("profile"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("maker"),
        F.col("p_retailprice").alias("price"),
        F.lit("USD").alias("currency"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.lit(SELLER).alias("seller"),
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.when(F.col("l_linenumber") < 7, F.col("o_day")).alias("purchased_at"),
        F.col("p_type").alias("category"),
        F.when(F.col("l_linestatus") == "F", F.col("s_day")).alias("delivered_at"),
        F.when((F.col("l_returnflag") == "A") & (F.col("l_discount") >= 0.08),
               F.date_add("s_day", 14)).alias("return_by"),
        F.when(F.col("l_returnflag") == "R", "returned")
         .when(F.col("l_returnflag") == "A", "keep").alias("return_state"),
        F.col("o_custkey").alias("owner"),
        F.col("title"),
    )


def product_title() -> "F.Column":
    """Catalogue title: part name with a capital first letter + product word."""
    words = F.array(*[F.lit(w) for w in PRODUCT_WORDS])
    idx = F.pmod(F.col("p_size") - 1, F.lit(len(PRODUCT_WORDS))) + 1
    head = F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"))
    return F.concat(head, F.lit(" "), F.element_at(words, idx))


def titled_items_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``items_p`` with the product title as name and a gift signal on one brand."""
    it = items_p(spark, sf_dir)
    return (it.withColumn("name", F.col("title"))
              .withColumn("is_gift", F.when(F.col("maker") == "Brand#7", F.lit("gift receipt"))))


def rules_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule table from the part vocabulary: every distinct first and last word
    of a part name is a substring rule; priority = alphabetical rank."""
    part = table(spark, sf_dir, "part")
    words = (part.select(F.element_at(F.split("p_name", " "), 1).alias("pattern"))
                 .union(part.select(F.element_at(F.split("p_name", " "), -1).alias("pattern")))
                 .distinct())
    return global_position(words, [F.col("pattern")], "priority").select(
        F.concat(F.lit("kw:"), "pattern").alias("label"), "pattern", F.col("priority").cast("int").alias("priority"))


def purchases_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase events as orders: owner = user, one order per event."""
    ev = table(spark, sf_dir, "events")
    return (ev.filter(F.col("event_type") == "purchase")
              .select(F.col("user_id").alias("owner"),
                      F.col("event_id").cast("string").alias("order_id"),
                      F.col("ts").cast("date").alias("purchased_at"),
                      F.col("event_id").alias("id")))


# Sighting kinds per order (seq = l_orderkey * 8 + kind): 1 order mail, 2 delivery
# mail (lines with status F), 3 return-window mail (lines with flag A), refund
# mail 4 -- or 0, i.e. before the order mail, for order keys ending in 0.
KIND_VIA = {1: "order", 2: "shipment", 3: "return_window", 4: "refund", 0: "refund"}
IMG_BASE = "https://img.example/p/"
SNAPSHOT_BEFORE = _dt.date(1996, 1, 1)
PRIOR_LOG_BEFORE = _dt.date(1995, 3, 1)


def _uid(kind) -> "F.Column":
    return F.concat(F.lit("m"), F.col("l_orderkey").cast("string"), F.lit("-"), F.lit(kind).cast("string"))


def sightings_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-line sightings from three kinds of mail, one pass over lines_p."""
    lp = lines_p(spark, sf_dir)
    kinds = F.filter(F.array(F.lit(1), F.when(F.col("l_linestatus") == "F", F.lit(2)),
                             F.when(F.col("l_returnflag") == "A", F.lit(3))), lambda k: k.isNotNull())
    x = lp.withColumn("kind", F.explode(kinds))
    via = F.create_map(*[y for k, v in KIND_VIA.items() for y in (F.lit(k), F.lit(v))])
    return x.select(
        F.concat(F.lit("m"), F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("kind").cast("string")).alias("uid"),
        (F.col("l_orderkey") * 8 + F.col("kind")).alias("seq"),
        F.col("pos").cast("int").alias("pos"),
        via[F.col("kind")].alias("via"),
        F.lit(PROFILE).alias("profile"), F.lit(SELLER).alias("seller"),
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("p_name").alias("name"), F.col("p_brand").alias("maker"),
        F.col("p_retailprice").alias("price"), F.lit("USD").alias("currency"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.when(F.col("kind") == 1, F.col("o_day")).alias("purchased_at"),
        F.when(F.col("kind") == 2, F.col("s_day")).alias("delivered_at"),
        F.when(F.col("kind") == 3, F.date_add("s_day", 14)).alias("return_by"),
        F.when((F.col("kind") == 1) & (F.col("p_size") <= 45),
               F.concat(F.lit(IMG_BASE), F.col("l_partkey").cast("string"), F.lit(".jpg"))).alias("image_url"),
        F.lit("template").alias("source"),
        F.col("o_day"))


def refunds_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order-level refund per order that has a returned (R) line."""
    lp = lines_p(spark, sf_dir)
    r = (lp.groupBy("l_orderkey")
           .agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("has_r"),
                F.min("o_day").alias("o_day"))
           .filter("has_r = 1"))
    kind = F.when(F.col("l_orderkey") % 10 == 0, F.lit(0)).otherwise(F.lit(4))
    return r.select(
        F.concat(F.lit("m"), F.col("l_orderkey").cast("string"), F.lit("-"), kind.cast("string")).alias("uid"),
        (F.col("l_orderkey") * 8 + kind).alias("seq"),
        F.lit("refund").alias("via"), F.lit(PROFILE).alias("profile"),
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.lit(None).cast("string").alias("name"), "o_day")


def messages_log_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per message (sighting mails and refund mails): uid, seq, via, day."""
    s = sightings_p(spark, sf_dir).select("uid", "seq", "via", "o_day").distinct()
    r = refunds_p(spark, sf_dir).select("uid", "seq", "via", "o_day")
    return s.unionByName(r)


def prior_log_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier run's ingest log: every message of orders placed before 1995-03-01."""
    return messages_log_p(spark, sf_dir).filter(F.col("o_day") < F.lit(PRIOR_LOG_BEFORE)).select(
        F.col("uid").alias("email_uid"), F.lit("added").alias("status"))


def snapshot_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue as it stood before 1996: items ordered before then."""
    return items_p(spark, sf_dir).filter(F.col("purchased_at") < F.lit(SNAPSHOT_BEFORE))


# --- rendered mail ------------------------------------------------------------------
# Fixed layout of the rendered proxy mail (each kind-1 mail picks its layout
# from the order priority so every extractor sees real input).
MAIL_FROM = {1: "auto-confirm@amazon.example", 2: "shipment-tracking@amazon.example",
             3: "return@amazon.example", 4: "refund@amazon.example", 0: "refund@amazon.example"}
NOISE_FROM = "deals@amazon.example"
PIXEL_IMG = '<img src="https://t.example/open?pixel=1">'
BLOCK_PRIORITY = "2-HIGH"
SUBJECT_ONLY_PRIORITY = "3-MEDIUM"
GIFT_PRIORITY = "1-URGENT"
NOISE_SEQ_BASE = 10 ** 15


def market_order_id(k) -> "F.Column":
    """ddd-ddddddd-ddddddd from an integer order key."""
    k = F.col(k) if isinstance(k, str) else k
    return F.concat(F.lit("113-"), F.lpad(F.floor(k / 10000000).cast("string"), 7, "0"), F.lit("-"),
                    F.lpad(F.pmod(k, F.lit(10000000)).cast("string"), 7, "0"))


def _long_date(d) -> "F.Column":
    return F.date_format(d, "MMMM d, yyyy")


MAIL_FIELDS = ("subject", "msg_date", "text", "html")


def messages_p(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = MAIL_FIELDS) -> DataFrame:
    """Mails rendered from the order lines: order confirmation (line, block or
    subject-only layout; gift line on urgent orders), delivery mail with bare
    item lines, return-window mail, refund mail, and one marketing mail per
    customer.  Columns: uid, seq, from_addr, subject, msg_date, text, html; of the
    last four only those in ``fields`` are rendered and returned."""
    lp = lines_p(spark, sf_dir)
    body = "text" in fields or "html" in fields
    shown = [F.col("l_quantity").cast("int").alias("qty"), F.col("p_retailprice").alias("price"),
             F.col("l_partkey").alias("partkey"), F.col("p_size").alias("size")] if body else []
    ln = F.struct(
        F.col("pos"), *shown, *([F.col("title")] if body or "subject" in fields else []),
        F.col("l_linestatus").alias("st"), F.col("l_returnflag").alias("rf"), F.col("s_day").alias("s_day"))
    per_order = (lp.groupBy("l_orderkey", "o_day", "o_orderpriority")
                   .agg(F.sort_array(F.collect_list(ln)).alias("lines")))   # by pos, unique in an order
    oid = market_order_id("l_orderkey")

    def line_text(l):
        return F.format_string("%d x %s - $%s", l["qty"], l["title"], F.format_number(l["price"], 2))

    def block_text(l):
        return F.format_string("* %s\n  Quantity: %d\n  %s USD", l["title"], l["qty"],
                               F.format_number(l["price"], 2))

    def img(l):
        return F.when(l["size"] <= 45, F.format_string('<img src="https://img.example/p/%d.jpg">',
                                                       l["partkey"])).otherwise(F.lit(""))

    pri = F.col("o_orderpriority")
    lines = F.col("lines")
    plain_lines = F.when(pri == BLOCK_PRIORITY, F.array_join(F.transform(lines, block_text), "\n")) \
                   .when(pri == SUBJECT_ONLY_PRIORITY, F.lit("")) \
                   .otherwise(F.array_join(F.transform(lines, line_text), "\n"))
    html_lines = F.when(pri == BLOCK_PRIORITY, F.array_join(F.transform(lines, lambda l: F.concat(
                     F.lit("<p>"), F.replace(block_text(l), F.lit("\n"), F.lit("<br>")), F.lit("</p>"), img(l))), "")) \
                  .when(pri == SUBJECT_ONLY_PRIORITY, F.array_join(F.transform(lines, img), "")) \
                  .otherwise(F.array_join(F.transform(lines, lambda l: F.concat(
                      F.lit("<tr><td>"), line_text(l), F.lit("</td></tr>"), img(l))), ""))
    gift = F.when(pri == GIFT_PRIORITY, F.lit("\nThis order is a gift.")).otherwise(F.lit(""))
    n = F.size(lines)
    subj1 = F.when(pri == SUBJECT_ONLY_PRIORITY,
                   F.format_string('Ordered: "%s..." and %d more item(s)', lines[0]["title"], n - 1)) \
             .otherwise(F.format_string("Your Amazon.com order #%s of %d item(s)", oid, n))
    kept = [f for f in MAIL_FIELDS if f in fields]

    def mail(kind, *values):
        return F.struct(kind.alias("kind"), *[v.alias(f) for f, v in zip(MAIL_FIELDS, values) if f in kept])

    order_mail = mail(
        F.lit(1), subj1, F.col("o_day"),
        F.concat(F.lit("Order Confirmation\nOrder #"), oid, F.lit("\n"), plain_lines, gift,
                 F.lit("\nThank you for shopping with us.")),
        F.concat(F.lit("<html><body><p>Order Confirmation</p>"), F.lit(PIXEL_IMG), F.lit("<table>"),
                 html_lines, F.lit("</table></body></html>")))
    f_lines = F.filter(lines, lambda l: l["st"] == "F")
    a_lines = F.filter(lines, lambda l: l["rf"] == "A")
    d_day = F.array_max(F.transform(f_lines, lambda l: l["s_day"]))
    r_day = F.date_add(F.array_max(F.transform(a_lines, lambda l: l["s_day"])), 14)
    bare = lambda arr: F.array_join(F.transform(arr, lambda l: F.concat(F.lit("- "), l["title"])), "\n")
    ship_mail = F.when(F.size(f_lines) > 0, mail(
        F.lit(2), F.concat(F.lit("Delivered: your package from order #"), oid), d_day,
        F.concat(F.lit("Your package was delivered.\nDelivered on "), _long_date(d_day), F.lit("\n"),
                 bare(f_lines)),
        F.concat(F.lit("<p>Delivered on "), _long_date(d_day), F.lit("</p>"))))
    ret_mail = F.when(F.size(a_lines) > 0, mail(
        F.lit(3), F.concat(F.lit("Return window closing for order #"), oid), F.date_sub(r_day, 14),
        F.concat(F.lit("The return window closes on "), _long_date(r_day), F.lit(" for:\n"),
                 bare(a_lines)),
        F.lit("")))
    has_r = F.exists(lines, lambda l: l["rf"] == "R")
    rkind = F.when(F.pmod(F.col("l_orderkey"), F.lit(10)) == 0, F.lit(0)).otherwise(F.lit(4))
    refund_mail = F.when(has_r, mail(
        rkind, F.concat(F.lit("Your refund for order #"), oid, F.lit(" has been issued")), F.col("o_day"),
        F.concat(F.lit("We issued your refund for order #"), oid, F.lit(".")),
        F.lit("")))
    mails = per_order.select("l_orderkey", F.explode(F.filter(
        F.array(order_mail, ship_mail, ret_mail, refund_mail), lambda m: m.isNotNull())).alias("m"))
    from_map = F.create_map(*[x for k, v in MAIL_FROM.items() for x in (F.lit(k), F.lit(v))])
    orders_mail = mails.select(
        F.concat(F.lit("m"), F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("m.kind").cast("string")).alias("uid"),
        (F.col("l_orderkey") * 8 + F.col("m.kind")).alias("seq"),
        from_map[F.col("m.kind")].alias("from_addr"), *[F.col(f"m.{f}").alias(f) for f in kept])
    cust = table(spark, sf_dir, "customer")
    noise = cust.select(
        F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("uid"),
        (F.lit(NOISE_SEQ_BASE) + F.col("c_custkey")).alias("seq"),
        F.lit(NOISE_FROM).alias("from_addr"),
        F.concat(F.lit("Deals for "), F.col("c_name"), F.lit(": 20% off")).alias("subject"),
        F.lit(None).cast("date").alias("msg_date"),
        F.lit("Recommended for you. Based on your order history.").alias("text"),
        F.lit('<p>Shop now</p><img src="https://img.example/banner/sale.jpg">').alias("html"))
    return orders_mail.unionByName(noise.select(*orders_mail.columns))


def completions_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached model answers for every order mail: the order's lines as JSON;
    urgent orders wrapped in a code fence, high ones in prose, medium ones with
    string prices, unspecified ones without names."""
    lp = lines_p(spark, sf_dir)
    oid = market_order_id("l_orderkey")
    pri = F.col("o_orderpriority")
    price = F.when(pri == SUBJECT_ONLY_PRIORITY, F.col("p_retailprice").cast("string"))
    item = F.struct(
        F.col("pos"),
        F.when(pri != "4-NOT SPECIFIED", F.col("title")).alias("name"),
        F.col("p_brand").alias("maker"),
        F.coalesce(price, F.col("p_retailprice").cast("string")).alias("_p"),
        F.lit("USD").alias("currency"), F.col("l_quantity").cast("int").alias("quantity"),
        oid.alias("order_id"))
    g = lp.groupBy("l_orderkey", "o_orderpriority").agg(F.sort_array(F.collect_list(item)).alias("its"))
    as_num = F.transform("its", lambda t: F.struct(t["name"].alias("name"), t["maker"].alias("maker"),
                                                   t["_p"].cast("double").alias("price"), t["currency"].alias("currency"),
                                                   t["quantity"].alias("quantity"), t["order_id"].alias("order_id")))
    as_str = F.transform("its", lambda t: F.struct(t["name"].alias("name"), t["maker"].alias("maker"),
                                                   t["_p"].alias("price"), t["currency"].alias("currency"),
                                                   t["quantity"].alias("quantity"), t["order_id"].alias("order_id")))
    js = F.when(pri == SUBJECT_ONLY_PRIORITY, F.to_json(F.struct(as_str.alias("items")))) \
          .otherwise(F.to_json(F.struct(as_num.alias("items"))))
    wrapped = (F.when(pri == GIFT_PRIORITY, F.concat(F.lit("```json\n"), js, F.lit("\n```")))
                .when(pri == BLOCK_PRIORITY, F.concat(F.lit("Sure! Here is the data: "), js,
                                                      F.lit(" Let me know if you need more.")))
                .otherwise(js))
    return g.select(F.concat(F.lit("m"), F.col("l_orderkey").cast("string"), F.lit("-1")).alias("email_uid"),
                    wrapped.alias("response_json"), F.lit("small-model").alias("model"))


def landed(mail: DataFrame) -> DataFrame:
    """Mail as it lies in a source: written once, in as many files as keep all cores busy
    (decoding is work by message; few small files would leave it to one task)."""
    return materialize(mail.repartition(2 * mail.sparkSession.sparkContext.defaultParallelism), "raw-mail")


def raw_messages_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``messages_p`` rendered to RFC 822 bytes (multipart/alternative,
    8bit parts, Message-ID from the uid): (uid, seq, raw)."""
    m = messages_p(spark, sf_dir)
    date = F.when(F.col("msg_date").isNotNull(),
                  F.concat(F.lit("Date: "), F.date_format("msg_date", "EEE, dd MMM yyyy"),
                           F.lit(" 10:00:00 +0000\n"))).otherwise(F.lit(""))
    raw = F.concat(
        F.lit("From: "), F.col("from_addr"), F.lit("\nTo: me@example.com\nSubject: "), F.col("subject"),
        F.lit("\n"), date, F.lit("Message-ID: <"), F.col("uid"), F.lit("@proxy.example>\n"),
        F.lit('MIME-Version: 1.0\nContent-Type: multipart/alternative; boundary="=b1="\n\n'),
        F.lit('--=b1=\nContent-Type: text/plain; charset="utf-8"\nContent-Transfer-Encoding: 8bit\n\n'),
        F.col("text"),
        F.lit('\n--=b1=\nContent-Type: text/html; charset="utf-8"\nContent-Transfer-Encoding: 8bit\n\n'),
        F.col("html"), F.lit("\n--=b1=--\n"))
    return m.select("uid", "seq", raw.cast("binary").alias("raw"))
