"""Keyword classifiers: first matching label wins.

Small fixed rule lists compile to one CASE WHEN over ``contains`` (X28).  A
rule *table* (many rules, maintained as data) is matched with a broadcast
nested-loop join and reduced with ``min_by(label, priority)`` (J6)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import required_literal
from .joins import substring_join

# The marketplace profile's coarse categories (name only, no default).
MARKET_CATEGORY_SIGNALS = [
    ("craft-supply", ("craft vinyl", "vinyl", "resin", "acrylic", "blanks",
                      "craft paint", "yarn")),
    ("book", ("book", "workbook", "manga", "novel", "textbook", "paperback")),
    ("electronics", ("keyboard", "monitor", "usb", "charger", "raspberry",
                     "arduino", "speaker", "webcam", "cable")),
    ("home", ("storage", "organizer", "bin", "shelf", "hook", "mailer", "tape")),
    ("toy-collectible", ("plush", "figure", "pin", "blind box", "toy")),
    ("apparel", ("shirt", "hoodie", "sock", "blazer", "legging")),
    ("health-fitness", ("protein", "creatine", "yoga", "dumbbell", "skincare")),
]

# The demo profile's game categories (name + maker, default label).
DEMO_CATEGORY_SIGNALS = [
    ("strategy", ("strategy", "engine builder", "worker placement", "wingspan",
                  "terraforming", "scythe", "gloomhaven")),
    ("party", ("party", "codenames", "dixit", "telestrations", "wavelength")),
    ("family", ("family", "ticket to ride", "carcassonne", "azul", "splendor")),
    ("expansion", ("expansion", "expacks", " exp.", "europe expansion")),
]
DEMO_DEFAULT_CATEGORY = "uncategorized"


def contains_any(hay: Column, words) -> Column:
    """OR of lower-case substring tests (the reference gates use substrings)."""
    conds = [F.contains(hay, F.lit(w)) for w in words]
    if not conds:
        return F.lit(False)
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def keyword_classifier(rules, hay: Column, default: str | None = None) -> Column:
    """Label of the first rule with a signal inside lower(hay)."""
    low = F.lower(F.coalesce(hay, F.lit("")))
    expr = F.lit(default).cast("string")
    for label, words in reversed(list(rules)):
        expr = F.when(contains_any(low, words), F.lit(label)).otherwise(expr)
    return expr


def market_category(name="name") -> Column:
    return keyword_classifier(MARKET_CATEGORY_SIGNALS, F.col(name))


def demo_category(name="name", maker="maker") -> Column:
    hay = F.concat(F.coalesce(F.col(name), F.lit("")), F.lit(" "), F.coalesce(F.col(maker), F.lit("")))
    return keyword_classifier(DEMO_CATEGORY_SIGNALS, hay, DEMO_DEFAULT_CATEGORY)


def rules_join_classify(items: DataFrame, rules: DataFrame, hay_col: str = "name",
                        key: str = "id") -> DataFrame:
    """``rules(label, priority, pattern)``; every item gets the label of its
    lowest-priority matching rule (substring of the lower-cased text), NULL if
    none.  Items and rules meet by their rare grams, and the reduction is a
    group-by on the item key (unique, so no hot group)."""
    r = rules.select("label", "priority", F.lower("pattern").alias("_pat"))
    it = items.select(key, F.lower(F.coalesce(F.col(hay_col), F.lit(""))).alias("_hay"))
    matched = substring_join(it, r, "_hay", "_pat", id_col=key, literal=True)
    best = matched.groupBy(key).agg(F.min_by(F.struct("priority", "label"),
                                             F.struct("priority", "label"))["label"].alias("label"))
    return items.select(key).join(best, key, "left")


def regex_rules_classify(items: DataFrame, rules: DataFrame, hay_col: str = "name", key: str = "id") -> DataFrame:
    """J6 for ``rules(label, priority, pattern)`` whose patterns are regular expressions
    (ignoring case): the label of the matching rule with the lowest priority, NULL if none.

    Each pattern has a text that all its matches hold (:func:`required_literal`); items and
    rules meet by the rare grams of that text, so only items that hold it are tested by the
    pattern, and no plan compares all items with all rules.  A pattern without such a text
    meets every item."""
    literal = F.pandas_udf(lambda s: s.map(required_literal), "string")
    r = rules.filter("pattern IS NOT NULL").select(
        "label", "priority", F.col("pattern").alias("_re"), literal("pattern").alias("_pat"))
    it = items.select(key, F.lower(F.coalesce(F.col(hay_col), F.lit(""))).alias("_hay"), F.coalesce(
        F.col(hay_col), F.lit("")).alias("_text"))
    met = substring_join(it, r, "_hay", "_pat", id_col=key, literal=True)
    matched = met.filter(F.rlike("_text", F.concat(F.lit("(?i)"), F.col("_re"))))
    order = F.struct("priority", "label")
    best = matched.groupBy(key).agg(F.min_by(order, order)["label"].alias("label"))
    return items.select(key).join(best, key, "left")
