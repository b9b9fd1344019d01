"""Regex Column functions against the Python-semantics cases (CRLF, NBSP, non-ASCII)."""
import datetime as dt

from pyspark.sql import functions as F

from receiptflow.functions import text as X
from receiptflow.operators import extract as E


def one(spark, col, **vals):
    schema = ", ".join(f"{k} string" for k in vals)
    return spark.createDataFrame([tuple(vals.values())], schema).select(col.alias("v")).first().v


def test_html_to_text(spark):
    html = "<html><style>p{}</style><p>A&nbsp;&amp; B</p><script>x()</script><div>C</div>\n\n\n<b>D</b> "
    assert one(spark, X.html_to_text("h"), h=html) == "A & B\nC\n D"


def test_first_price_and_currency(spark):
    p = one(spark, X.first_price("t"), t="Total: 1,200 jpy then $5.00")
    assert (p.price, p.currency) == (1200.0, "JPY")
    p = one(spark, X.first_price("t"), t="no money here")
    assert (p.price, p.currency) == (None, None)
    assert one(spark, X.normalize_currency("t"), t="£") == "GBP"
    assert one(spark, X.normalize_currency("t"), t="chf") is None


def test_quantity_and_clean(spark):
    assert one(spark, X.to_quantity("q"), q=" 3 ") == 3
    assert one(spark, X.to_quantity("q"), q="0") == 1
    assert one(spark, X.to_quantity("q"), q="x") == 1
    assert one(spark, X.clean_text("s"), s="  a \t b  ") == "a b"
    assert one(spark, X.clean_text("s"), s="  \n ") is None


def test_subject_name_and_ids(spark):
    assert one(spark, X.item_name_from_subject("s"), s="Your order: Wingspan") == "Wingspan"
    assert one(spark, X.item_name_from_subject("s"), s="Order confirmed - ab") == "ab"
    assert one(spark, X.item_name_from_subject("s"), s="Receipt  Azul") == "Azul"
    assert one(spark, X.item_name_from_subject("s"), s="") == "Item"
    assert one(spark, X.generic_order_id("t"), t="Order #TT-10428 placed") == "TT-10428"
    assert one(spark, X.marketplace_order_id("s", "t"), s="x", t="order #113-2591024-7364219") == \
        "113-2591024-7364219"
    assert one(spark, X.seller_domain("f"), f="Shop <Orders@Shop.Example>") == "shop.example"


def test_dates(spark):
    assert one(spark, X.english_date("s"), s="june 24, 2026") == dt.date(2026, 6, 24)
    assert one(spark, X.english_date("s"), s="Jun 24, 2026") == dt.date(2026, 6, 24)
    assert one(spark, X.return_by_date("t"), t="is return eligible through July 8, 2026:") == dt.date(2026, 7, 8)
    d = spark.createDataFrame([("x", "Delivered: today", dt.date(2026, 6, 1))], "t string, s string, d date")
    assert d.select(X.delivered_date("t", "s", "d")).first()[0] == dt.date(2026, 6, 1)


def test_line_items_crlf_and_symbols(spark):
    text = "2 x Craft Vinyl - $12.99 each\r\n1 × Sheets: €3\r\n10x  Big  Thing — 1,234.50\r\nnot a line"
    rows = one(spark, E.line_items(F.col("t")), t=text)
    assert [(r.title, r.quantity, r.price, r.currency) for r in rows] == [
        ("Craft Vinyl", 2, 12.99, "USD"), ("Sheets", 1, 3.0, "EUR"), ("Big Thing", 10, 1234.5, "USD")]


def test_block_bare_subject(spark):
    text = "* Very Long Product Name\n  Quantity: 2\n  8.98 USD\n* Order #113-2591024-7364219\nQuantity: 1"
    rows = one(spark, E.block_items(F.col("t")), t=text)
    assert [(r.title, r.quantity, r.price, r.currency) for r in rows] == [("Very Long Product Name", 2, 8.98, "USD")]
    bare = one(spark, E.bare_items(F.col("t")), t="- Item One\n• Item Two \n- ab\n- Order #113-2591024-7364219")
    assert [r.title for r in bare] == ["Item One", "Item Two"]
    subj = one(spark, E.subject_item(F.col("s")), s='Shipped: "Manga Volume 1…" and 2 more')
    assert [r.title for r in subj] == ["Manga Volume 1"]


def test_images(spark):
    html = ('<img src="https://x.example/pixel.gif"><img src=\'https://cdn.example/logo.png\'>'
            '<img width=1 src="https://cdn.example/p/item_large.jpg">')
    assert one(spark, X.first_product_image("h"), h=html) == "https://cdn.example/p/item_large.jpg"
    assert one(spark, X.best_product_image("h"), h='<a href="https://a.example/p.webp">') == "https://a.example/p.webp"
    assert one(spark, X.alt_image_url("u"), u="https://cdn.shopify.com/s/a_compact_cropped.jpg?v=1") == \
        "https://cdn.shopify.com/s/a.jpg?v=1"
    assert one(spark, X.alt_image_url("u"), u="https://other.example/a_small.jpg") is None
    assert one(spark, X.reserved_host("u"), u="https://img.shop.example/a.jpg&amp;x=1") is True
    assert one(spark, X.image_ext("c", "u"), c="image/png; q=1", u="x") == ".png"
    assert one(spark, X.image_ext("c", "u"), c=None, u="https://a/b.WEBP?x") == ".webp"


def test_gift_signal_owner(spark):
    text = "Ship to:\nJessica - PORTLAND, OR\n"
    assert one(spark, X.gift_signal("t", "gift receipt", owner="alex"), t=text) == "ships to Jessica"
    assert one(spark, X.gift_signal("t", "gift receipt", owner="jess"), t=text) is None
