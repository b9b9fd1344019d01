"""Item extractors: regex matches -> ARRAY<STRUCT> columns.

A pattern of several capture groups runs over the whole body once: each match is
replaced by its groups between two control characters and the result is split at
them (an optional group that did not take part yields '').  A body that holds these
characters itself is read once per group instead.  Nothing is re-matched against the
matched substring, so anchors and ``\\b`` see the same context as the
original ``finditer``.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import LINE_SYMBOL, MARKET_ORDER_RE, clean_text, to_amount, whole_number

# Fixed patterns (Python ``re.M`` / ``re.I`` originals, Java flags applied).
LINE_RE = (r"(?mdU)^\s*(\d+)\s*[x×]\s*(.+?)\s*[—\-:]\s*([$£€])?(\d[\d,]*(?:\.\d{2})?)"
           r"(?:\s*(?:each|/ea))?\s*$")
# Same line shape without the end anchor (the demo shop's variant).
LINE_OPEN_RE = r"(?mdU)^\s*(\d+)\s*[x×]\s*(.+?)\s*[—\-:]\s*([$£€])?(\d[\d,]*(?:\.\d{2})?)"
# ``{longest}``: the most characters of a title; empty for any length.
BARE_LINE_RE = r"(?mdU)^\s*[-•]\s+([^\n]{{3,{longest}}})\s*$"
BLOCK_WORD = "Quantity:"
BLOCK_RE = (r"(?mdU)^\s*\*\s*([^\n]{{4,{longest}}}?)\s*\n\s*Quantity:\s*(\d+)\s*\n?"
            r"(?:\s*(\d[\d,]*(?:\.\d{{2}})?)\s*(USD|EUR|GBP|CAD|AUD|JPY)\b)?")
SUBJ_ITEM_RE = (r"(?iU)(?:ordered|shipped|delivered|out for delivery|arriving[^:]*):\s*"
                r"[\"“](.+?)(?:\.\.\.|…)?[\"”]")

ITEM_TYPE = "array<struct<title:string,quantity:int,price:double,currency:string>>"


def empty_items() -> Column:
    return F.array().cast(ITEM_TYPE)


#: Where a match begins, and what ends each of its groups.
_MATCH, _GROUP = "\x01", "\x02"


def _matches(text: Column, pattern: str, n: int) -> Column:
    """ARRAY<ARRAY<STRING>>: the groups 1 to ``n`` of each match."""
    t = F.coalesce(text, F.lit(""))
    marked = F.regexp_replace(t, pattern, _MATCH + "".join(f"${i}{_GROUP}" for i in range(1, n + 1)))
    pieces = F.split(marked, _MATCH)
    found = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: F.split(p, _GROUP))
    one_by_one = F.transform(
        F.arrays_zip(*[F.regexp_extract_all(t, F.lit(pattern), i) for i in range(1, n + 1)]),
        lambda s: F.array(*[s[str(i)] for i in range(n)]))
    return F.when(F.contains(t, F.lit(_MATCH)) | F.contains(t, F.lit(_GROUP)), one_by_one).otherwise(found)


def _item(title: Column, qty: Column, price: Column, cur: Column) -> Column:
    return F.struct(title.alias("title"), qty.alias("quantity"), price.alias("price"),
                    cur.alias("currency"))


def _is_title(r: Column) -> Column:
    """A title that holds no order id."""
    return r["title"].isNotNull() & ~r["title"].rlike(MARKET_ORDER_RE)


def line_items(text: Column, pattern: str = LINE_RE) -> Column:
    """``2 x Name - $9.99 [each]`` lines; price per line, currency from
    the symbol (default USD); empty titles dropped."""
    sym = F.create_map(*[x for k, v in LINE_SYMBOL.items() for x in (F.lit(k), F.lit(v))])
    rows = F.transform(_matches(text, pattern, 4), lambda r: _item(   # qty, title, symbol, amount
        clean_text(r[1]), whole_number(r[0]), to_amount(r[3]),
        F.coalesce(sym[F.when(r[2] == "", F.lit("$")).otherwise(r[2])], F.lit("USD"))))
    return F.filter(rows, lambda r: r["title"].isNotNull())


def block_items(text: Column, longest: int | None = None) -> Column:
    """``* Name / Quantity: n / 8.98 USD`` blocks; titles holding an
    order id are skipped, and those of more than ``longest`` characters."""
    pattern = BLOCK_RE.format(longest=longest or "")
    rows = F.transform(_matches(text, pattern, 4), lambda r: _item(   # title, qty, amount, currency
        clean_text(r[0]), whole_number(r[1]),
        F.when(r[2] != "", to_amount(r[2])), F.nullif(r[3], F.lit(""))))
    # the word that every match holds is a cheap look before the pattern
    return F.when(F.contains(F.coalesce(text, F.lit("")), F.lit(BLOCK_WORD)), F.filter(rows, _is_title)).otherwise(
        empty_items())


def bare_items(text: Column, longest: int | None = None) -> Column:
    """``- Name`` lines (no price); titles holding an order id skipped, and
    those of more than ``longest`` characters."""
    pattern = BARE_LINE_RE.format(longest=longest or "")
    titles = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 1)
    rows = F.transform(titles, lambda t: _item(clean_text(t), F.lit(1), F.lit(None).cast("double"),
                                               F.lit(None).cast("string")))
    return F.filter(rows, _is_title)


def subject_item(subject: Column) -> Column:
    """The quoted (possibly truncated) item name in the subject."""
    t = clean_text(F.regexp_extract(F.coalesce(subject, F.lit("")), SUBJ_ITEM_RE, 1))
    one = F.array(_item(t, F.lit(1), F.lit(None).cast("double"), F.lit(None).cast("string")))
    return F.filter(one, lambda r: r["title"].isNotNull())


def cascade(*arrays: Column) -> Column:
    """The first non-empty array wins.  A fold over the extractors' numbers: each is
    evaluated at most once, and only when the earlier ones found nothing."""
    def step(found, k):
        out = found
        for i, a in enumerate(arrays):
            out = F.when((F.size(found) == 0) & (k == i), F.coalesce(a, empty_items())).otherwise(out)
        return out
    return F.aggregate(F.array(*[F.lit(i) for i in range(len(arrays))]), empty_items(), step)


def market_items(text: Column, subject: Column) -> Column:
    """The marketplace cascade: block -> line -> subject."""
    return cascade(block_items(text), line_items(text), subject_item(subject))
