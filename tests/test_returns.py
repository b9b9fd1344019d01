"""Return window precedence, statuses and the months cut-off."""
import datetime as dt

from pyspark.sql import functions as F

from receiptflow.functions import dates as D
from receiptflow.operators import views as V

TODAY = dt.date(2026, 7, 1)


def test_window_precedence_and_status(spark):
    rows = [(1, "2026-07-10", "2026-06-24", "2026-06-18", None),     # explicit wins
            (2, None, "2026-06-24", "2026-06-18", "keep"),           # delivered + policy
            (3, None, None, "2026-06-18", ""),                       # ordered + policy
            (4, None, None, None, None),                             # unknown
            (5, "not a date", "2026-05-01", None, "returned"),       # bad explicit ignored
            (6, "2026-07-01T10:00:00", None, None, None)]            # date-time text, last day
    df = spark.createDataFrame(rows, "id int, return_by string, delivered_at string, purchased_at string, "
                                     "return_state string")
    w = df.withColumn("w", D.return_window(today=TODAY, policy_days=30)).withColumn("st", D.state_or_default())
    got = {r.id: (r.w.basis, r.w.days_left, r.w.status, r.st) for r in w.collect()}
    assert got[1] == ("explicit", 9, "returnable", "evaluate")
    assert got[2] == ("delivered+policy", 23, "returnable", "keep")
    assert got[3] == ("ordered+policy", 17, "returnable", "evaluate")
    assert got[4] == ("unknown", None, "unknown", "evaluate")
    assert got[5] == ("delivered+policy", -31, "expired", "returned")
    assert got[6] == ("explicit", 0, "returnable", "evaluate")


def test_months_cutoff_clamps_day():
    assert D.months_back_cutoff_py(3, dt.date(2026, 5, 31)) == dt.date(2026, 2, 28)
    assert D.months_back_cutoff_py(1, dt.date(2026, 1, 15)) == dt.date(2025, 12, 15)


def test_months_cutoff_column_matches_driver(spark):
    d = spark.range(1).select(D.months_back_cutoff(3, dt.date(2026, 5, 31)).alias("c")).first().c
    assert d == dt.date(2026, 2, 28)


def test_report_order(spark):
    rows = [(1, None, "2026-06-20", None, "evaluate"), (2, None, "2026-06-10", None, "keep"),
            (3, None, "2026-05-01", None, None), (4, None, "2026-04-01", None, None),
            (5, None, None, None, None), (6, None, "2026-06-25", None, "returned")]
    df = spark.createDataFrame(rows, "id long, return_by string, delivered_at string, purchased_at string, "
                                     "return_state string")
    df = df.select("id", "return_state", *[F.col(c).cast("date").alias(c)
                                           for c in ("return_by", "delivered_at", "purchased_at")])
    df = df.withColumn("name", F.lit("x")) \
        .withColumn("price", F.lit(1.0)).withColumn("quantity", F.lit(1)).withColumn("currency", F.lit("USD"))
    r = V.returns_report(df, TODAY, 30).orderBy("section_rank", "rank")
    got = [(x.section, x.id) for x in r.collect()]
    # open: most urgent first; expired: freshest first; returned outranks the window
    assert got == [("open", 2), ("open", 1), ("unknown", 5), ("expired", 3), ("expired", 4),
                   ("returned", 6)]
