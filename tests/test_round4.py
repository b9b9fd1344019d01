"""Faster forms of text functions give what the plain ones gave; written stages leave no shuffle files."""
from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from receiptflow import session
from receiptflow.functions import text as X
from receiptflow.operators import extract as E
from receiptflow.operators import zones as Z


def _column(spark, values, use):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in rows.select("i", use("s").alias("v")).orderBy("i").select("v").collect()]


def test_strip_is_the_pattern(spark):
    edges = [f"{chr(c)}a {chr(c)}b{chr(c)}" for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    values = [*edges, "", " \n\t", None, "a\n", "\na \u0085", "x \r\n"]
    want = _column(spark, values, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    assert _column(spark, values, lambda s: X.strip_blanks(F.col(s))) == want
    assert _column(spark, values, X.clean_text) == _column(spark, values, lambda s: F.nullif(F.regexp_replace(
        F.regexp_replace(s, r"(?U)\s+", " "), r"(?U)^\s+|\s+$", ""), F.lit("")))


@pytest.mark.parametrize("mark", ["", "\x01", "\x02", "\x01\x02\x01"])
def test_groups_of_one_pass(spark, mark):
    body = f"2 x A{mark} b - $1,009.50 each\nnoise{mark}\n1 x C: 5\n* Title{mark} one\n  Quantity: 3\n  9.99 USD\n"
    line, block = _column(spark, [body], lambda s: E.line_items(F.col(s)))[0], _column(
        spark, [body], lambda s: E.block_items(F.col(s)))[0]
    assert [tuple(r) for r in line] == [(f"A{mark} b", 2, 1009.5, "USD"), ("C", 1, 5.0, "USD")]
    assert [tuple(r) for r in block] == [(f"Title{mark} one", 3, 9.99, "USD")]
    assert _column(spark, [None, "", "nothing"], lambda s: E.line_items(F.col(s))) == [[], [], []]


def test_body_and_dates(spark):
    html = ["<p>a  b</p><STYLE>x</STYLE>c\t d", "<style>x", "&nbsp;a&amp;b", None, ""]
    assert _column(spark, html, X.html_to_text) == ["a b\n c d", "x", "a&b", "", ""]
    assert _column(spark, ["see http://x.y/z  now", None], lambda s: X.combine_body(s, F.lit(" "))) == ["see now", ""]
    texts = ["Delivered on June 24, 2026", "DELİVERED: June 1, 2026", "delivered", None]
    got = _column(spark, texts, lambda s: X.delivered_date(s, F.lit("x"), F.lit(None).cast("date")))
    assert [str(d) for d in got] == ["2026-06-24", "2026-06-01", "None", "None"]


def test_signals_by_their_text(spark):
    """Signals are found in every case and by signs that fold to ASCII letters."""
    names = ["Craft VINYL roll", "ſtorage bİn", "old Keycap", "pins", "spinning", "", None, "desk mat é", "hookſ"]
    tax = Z.DEFAULT_TAXONOMY

    def plain(zone):
        return lambda s: F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(F.col(s), F.lit("")), Z.java_regex(p), 0), F.lit(
            "")) for p in tax.signals[zone]])
    for zone in ("crafting", "home-org", "fandom-fun", "work-office"):
        assert _column(spark, names, lambda s: tax.zone_signal(zone, F.coalesce(F.col(s), F.lit("")))) == _column(
            spark, names, plain(zone))
    assert X.required_words("gift receipt|this (?:order|item) is a gift") == [" is a gift", "gift receipt"]
    assert X.required_words(r"gift|\d+") == []


def test_written_stage_drops_its_shuffles(spark, monkeypatch):
    jvm = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [f.getPath() for f in jvm.localDirs()]
    files = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*")}
    before = files()
    out = session.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "few")
    assert out.count() == 7 and all(os.path.exists(d) for d in folders)
    assert not [f for f in files() - before if f.endswith(".data") and os.path.getsize(f) > 400]
    assert spark.conf.get(session.SHUFFLE_CLEANUP, None) in (None, "false")


def test_landed_archives_are_compressed(spark):
    """Mail lands gzipped, in whole, and a second copy holds the same mail."""
    from receiptflow.plans import proxies as P, q_stream
    src, _ = q_stream.land_archives(spark, "/root/testdata/sf0.001")
    files = [f for f in spark.read.text(src).inputFiles()]
    assert files and all(f.endswith(".gz") for f in files)
    n = P.messages_p(spark, "/root/testdata/sf0.001").count()
    assert spark.read.option("lineSep", "\nFrom ").text(src).count() == n
    inbox, schema, _ = q_stream._land_messages(spark, "/root/testdata/sf0.001", copies=2)
    both = spark.read.schema(schema).parquet(inbox).groupBy("uid").count()
    assert both.count() == n and both.filter("count <> 2").count() == 0
