"""Text and extraction Column functions (JVM regex, no Python per row).

Python ``re`` -> Java regex rules used throughout:
  * ``re.I`` -> ``(?iU)`` (Unicode case folding and Unicode ``\\s \\d \\w \\b``);
  * ``re.M`` -> ``(?mdU)`` (``(?d)``: only ``\\n`` ends a line, like Python);
  * ``regexp_extract`` yields ``''`` for "no match", so wrap with ``nullif``;
  * Python ``str.strip()`` removes Unicode blanks, Spark ``trim`` only spaces,
    so strips are regexes.
"""
from __future__ import annotations

import re
from functools import reduce

from re import _parser as regex_parser

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def filled(c: Column) -> Column:
    """The text, NULL for an empty one; built once (``nullif`` names it twice)."""
    return F.get(F.filter(F.array(c), lambda x: x != F.lit("")), 0)


# Currency symbols and codes the price parser knows.
CUR_SYMBOL = {"$": "USD", "£": "GBP", "€": "EUR", "¥": "JPY", "₩": "KRW"}
CUR_CODES = ("USD", "GBP", "EUR", "JPY", "KRW", "CAD", "AUD")
LINE_SYMBOL = {"$": "USD", "£": "GBP", "€": "EUR"}

# Fixed patterns (Python syntax shown in comments where the Java form differs).
_AMT = r"\d[\d,]*(?:\.\d{2})?"
_CODES = "USD|GBP|EUR|JPY|KRW|CAD|AUD"
# A mention starts with a symbol, a digit or the first two letters of a code (both cases,
# and the signs that fold to them): one cheap look before three alternatives are tried.
_PRICE_START = (r"(?=(?-iU:[$£€¥₩Uu\u212AKkGgEeJjCcAa])|\d)(?!(?-iU:[Uu][^Ss\u017F]|[Gg][^Bb]|[Ee][^Uu]"
                r"|[Jj][^Pp]|[Kk\u212A][^Rr]|[Cc][^Aa]|[Aa][^Uu]))")
PRICE_RE = (r"(?iU)" + _PRICE_START + r"(?:(?:([$£€¥₩])\s?(" + _AMT + r"))|(?:(" + _CODES + r")\s?(" + _AMT + r"))"
            r"|(?:(" + _AMT + r")\s?(" + _CODES + r")))")
BLOCK_TAG_RE = r"(?i)</?(p|div|br|tr|td|th|li|ul|ol|h[1-6]|table|section|header|footer)\b[^>]*>"
GENERIC_ORDER_RE = r"(?iU)order\s*(?:#|number|no\.?|id)?\s*[:#]?\s*([A-Za-z0-9-]{4,})"
MARKET_ORDER_RE = r"#?\s*(\d{3}-\d{7}-\d{7})"
DATE_TEXT_RE = r"([A-Z][a-z]+ \d{1,2}, \d{4})"
DELIVERED_RE = r"(?iU)delivered(?:\s+on)?[:\s]+" + DATE_TEXT_RE
RETURN_BY_RE = (r"(?iU)(?:return(?:able| eligible)?(?: is)?(?:\s+\w+){0,3}?\s+"
                r"(?:through|until|by|closes? on)|return window closes? on)\s+" + DATE_TEXT_RE)
NAME_STRIP_RE = (r"(?iU)^(order confirmation|your order is confirmed|your order|"
                 r"order confirmed|order is confirmed|receipt|confirmed|"
                 r"thank you for your (?:order|purchase))[:\-\s]*")
IMG_SRC_RE = r"(?i)<img[^>]+src=[\"']([^\"']+)[\"']"
GENERIC_IMG_RE = r"(?i)https?://[^\s\"'<>)]+\.(?:jpe?g|png|webp)"
# Python: r"_(?:...)(?=\.(?:jpe?g|png|webp|gif)(?:\?|$))" (look-ahead is fine in Java)
SIZE_SUFFIX_RE = (r"(?i)_(?:compact_cropped|compact|grande|large|medium|small|pico|icon|thumb|"
                  r"master|\d+x\d*|\d*x\d+)(?=\.(?:jpe?g|png|webp|gif)(?:\?|$))")
SHIP_TO_RE = r"(?mdU)^\s*([A-Z][\w.'’-]{1,40}) - [A-Z][A-Z ,.]{2,40}$"

# URL fragments that mark chrome / tracking images.
SKIP_HINTS = ("spacer", "pixel", "tracking", "1x1", "logo", "icon", "facebook",
              "twitter", "instagram", "footer", "header", "divider", ".gif",
              "brand", "sprite", "badge", "stars", "rating", "email-assets",
              "/assets/", "banner", "social", "pstmrk", "/open?", "open?m=",
              "theme_images", "/theme/", "storefront", "/avatars/",
              "shopifycloud", "notifications")
NO_HINT_RE = r"(?s)(?!.*(?:" + "|".join(re.escape(h) for h in SKIP_HINTS) + "))"
EXT_BY_CONTENT_TYPE = {"image/jpeg": ".jpg", "image/jpg": ".jpg", "image/png": ".png",
                       "image/webp": ".webp", "image/gif": ".gif"}
RESERVED_HOST_RE = r"\.(example|invalid|test|localhost)$"


#: Signs that fold to an ASCII letter without being its other case.
FOLDED = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}


#: What ``\s`` is to a pattern with ``(?U)``.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
                           0x202F, 0x205F, 0x3000]))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is built once, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def folded(text: Column) -> Column:
    """Lower case, in which the signs that a pattern takes for an ASCII letter are that letter:
    a text that holds no match's letters here holds no match."""
    signs = {sign: letter for letter, alike in FOLDED.items() for sign in alike}
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.lower(F.translate(text, "".join(signs), "".join(signs.values()))))


def _literal(sequence) -> str:
    """The longest run of literal characters on the top level of a parsed pattern."""
    best = run = ""

    def walk(sequence) -> None:
        nonlocal best, run
        for op, value in sequence:
            if op is regex_parser.LITERAL:
                run += chr(value).lower()
            elif op is regex_parser.SUBPATTERN and not value[1] and not value[2]:
                walk(value[3])
            elif op is regex_parser.MAX_REPEAT and value[0] > 0 and len(value[2]) == 1 and value[2][0][0] is regex_parser.LITERAL:
                run += chr(value[2][0][1]).lower()
                best, run = max(best, run, key=len), ""
                continue
            elif op is not regex_parser.AT:
                best, run = max(best, run, key=len), ""
                continue
            best = max(best, run, key=len)

    walk(sequence)
    return best if best.isascii() else ""


def required_literal(pattern: str) -> str:
    """The longest text (lower case) that every match of a regular expression holds: a run
    of literal characters on its top level.  Empty where there is none, or where only Java
    reads the pattern."""
    try:
        return _literal(regex_parser.parse(pattern, re.IGNORECASE))
    except (re.error, OverflowError):
        return ""


def required_words(pattern: str) -> list[str]:
    """Texts of which every match holds one, by the pattern's alternatives; empty where one
    of these has none."""
    try:
        parsed = regex_parser.parse(pattern, re.IGNORECASE)
    except (re.error, OverflowError):
        return []
    ways = parsed[0][1][1] if len(parsed) == 1 and parsed[0][0] is regex_parser.BRANCH else [parsed]
    words = sorted({_literal(w) for w in ways})
    return words if all(words) else []


def _where_held(text: Column, words, found: Column) -> Column:
    """``found`` where the text holds one of the words (folded): a cheap look before a pattern
    whose matches all hold one."""
    return F.when(_let(folded(text), lambda low: reduce(
        Column.__or__, [F.contains(low, F.lit(w)) for w in words])), found)


# --- P2 / P3 --------------------------------------------------------------------

def strip_unicode(c: Column) -> Column:
    """Python ``str.strip()``."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_blanks(c: Column) -> Column:
    """:func:`strip_unicode` without a pattern, for long texts."""
    return F.trim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    """Runs of spaces and tabs -> one space; a text without two together stays."""
    return _let(c, lambda t: F.when(F.contains(t, F.lit("  ")) | F.contains(t, F.lit("\t")), F.regexp_replace(
        t, r"[ \t]+", " ")).otherwise(t))


def html_to_text(html) -> Column:
    """Drop script/style, block tags -> newline, other tags -> space,
    two entities, squeeze blanks and blank lines, strip."""
    h = F.coalesce(_c(html), F.lit(""))
    t = F.when(F.contains(h, F.lit("<s")) | F.contains(h, F.lit("<S")), F.regexp_replace(
        h, r"(?is)<(script|style).*?>.*?</\1>", " ")).otherwise(h)
    t = F.regexp_replace(t, BLOCK_TAG_RE, "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    t = F.replace(F.replace(t, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    t = F.regexp_replace(squeeze(t), r"(?U)\n\s*\n+", "\n")
    return strip_blanks(t)


def combine_body(plain, html_text) -> Column:
    """Plain part + stripped HTML (non-empty parts, newline-joined), bare
    URLs blanked, runs of spaces/tabs squeezed."""
    parts = F.concat_ws("\n", F.filter(F.array(_c(plain), _c(html_text)), lambda x: x != F.lit("")))
    return squeeze(_let(strip_blanks(parts), lambda t: F.when(F.contains(t, F.lit("://")), F.regexp_replace(
        t, r"(?U)https?://\S+", " ")).otherwise(t)))


# --- X1-X8 ----------------------------------------------------------------------

def normalize_currency(token) -> Column:
    """A symbol, or one of seven codes (any case), else NULL."""
    t = strip_blanks(_c(token))
    sym = F.create_map(*[x for k, v in CUR_SYMBOL.items() for x in (F.lit(k), F.lit(v))])
    up = F.upper(t)
    return F.coalesce(sym[t], F.when(up.isin(*CUR_CODES), up))


def to_amount(amt) -> Column:
    """X3: '1,234.50' -> 1234.5; unparseable -> NULL."""
    return F.replace(_c(amt), F.lit(","), F.lit("")).try_cast("double")


def to_quantity(v) -> Column:
    """Positive integer, else 1."""
    return whole_number(strip_blanks(_c(v).cast("string")))


def whole_number(digits) -> Column:
    """X4 of a text without blanks around it."""
    n = _c(digits).try_cast("int")
    return F.when(n > 0, n).otherwise(F.lit(1))


def first_price(text) -> Column:
    """STRUCT<price DOUBLE, currency STRING> of the leftmost money mention.

    The body is searched once.  A mention is one amount (digits, commas, a point)
    and one symbol or code, so each is what is left without the other."""
    found = F.regexp_extract(F.coalesce(_c(text), F.lit("")), PRICE_RE, 0)
    return F.struct(to_amount(F.regexp_replace(found, r"(?U)[^\d,.]+", "")).alias("price"),
                    normalize_currency(F.regexp_replace(found, r"(?U)[\d,.]+", "")).alias("currency"))


def seller_domain(from_addr) -> Column:
    """Domain after '@' lower-cased, else the input ('' for NULL)."""
    a = F.coalesce(_c(from_addr), F.lit(""))
    d = F.regexp_extract(a, r"(?U)@([\w.-]+)", 1)
    return F.when(d != "", F.lower(d)).otherwise(a)


def clean_text(s) -> Column:
    """Whitespace runs -> one space, stripped, empty -> NULL.  No other blank than
    the space is left to strip."""
    return filled(F.trim(F.regexp_replace(_c(s), r"(?U)\s+", " ")))


def item_name_from_subject(subject) -> Column:
    """Tail after the last ': ', ' - ' or ' — ' if >= 3 chars, else the
    subject without a known prefix, else the subject, else 'Item'."""
    s = F.coalesce(_c(subject), F.lit(""))
    out = F.coalesce(clean_text(F.regexp_replace(s, NAME_STRIP_RE, "")), clean_text(s), F.lit("Item"))
    for delim in reversed((": ", " - ", " — ")):
        tail = strip_blanks(F.substring_index(s, delim, -1))
        hit = F.contains(s, F.lit(delim)) & (F.length(tail) >= 3)
        out = F.when(hit, F.coalesce(clean_text(tail), s)).otherwise(out)
    return out


def generic_order_id(text) -> Column:
    """X8."""
    return filled(F.regexp_extract(F.coalesce(_c(text), F.lit("")), GENERIC_ORDER_RE, 1))


def marketplace_order_id(subject, text) -> Column:
    """``ddd-ddddddd-ddddddd`` from the subject, else from the body."""
    def one(c):
        return filled(F.regexp_extract(F.coalesce(_c(c), F.lit("")), MARKET_ORDER_RE, 1))
    return F.coalesce(one(subject), one(text))


def english_date(s) -> Column:
    """X11: 'June 24, 2026' / 'Jun 24, 2026' -> DATE."""
    return _let(strip_blanks(_c(s)), lambda t: F.coalesce(
        F.try_to_date(t, "MMMM d, yyyy"), F.try_to_date(t, "MMM d, yyyy")))


def delivered_date(text, subject, msg_date) -> Column:
    """X12: 'Delivered on <date>' in the body, else the mail's own date when
    the subject starts with 'delivered'."""
    t = F.coalesce(_c(text), F.lit(""))
    d = english_date(_where_held(t, ["delivered"], filled(F.regexp_extract(t, DELIVERED_RE, 1))))
    starts = F.coalesce(_c(subject), F.lit("")).rlike(r"(?iU)^\s*delivered")
    return F.coalesce(d, F.when(starts, _c(msg_date)))


def return_by_date(text) -> Column:
    """X13."""
    t = F.coalesce(_c(text), F.lit(""))
    return english_date(_where_held(t, ["return"], filled(F.regexp_extract(t, RETURN_BY_RE, 1))))


# --- X20-X25 --------------------------------------------------------------------

def image_candidates(html) -> Column:
    """``<img src>`` URLs that are http(s) and carry none of the chrome hints."""
    srcs = F.regexp_extract_all(F.coalesce(_c(html), F.lit("")), F.lit(IMG_SRC_RE), 1)

    # both forms are bound first: a lambda's expression is evaluated anew wherever it stands
    urls = F.transform(F.transform(srcs, strip_unicode), lambda u: F.struct(u.alias("u"), F.lower(u).alias("low")))
    kept = F.filter(urls, lambda x: (x["low"].startswith("http://") | x["low"].startswith("https://")) & ~reduce(
        Column.__or__, [F.contains(x["low"], F.lit(h)) for h in SKIP_HINTS]))
    return F.transform(kept, lambda x: x["u"])


def first_product_image(html, prefer_hosts=None) -> Column:
    """First surviving candidate, a preferred host first when given."""
    cands = image_candidates(html)
    first = F.get(cands, 0)
    if not prefer_hosts:
        return first
    def pref(u):
        low = F.lower(u)
        ok = F.lit(False)
        for h in prefer_hosts:
            ok = ok | F.contains(low, F.lit(h.lower()))
        return ok
    return F.coalesce(F.get(F.filter(cands, pref), 0), first)


def best_product_image(html, prefer_hosts=None) -> Column:
    """X20, else any .jpg/.png/.webp URL in the raw HTML without hints."""
    urls = F.regexp_extract_all(F.coalesce(_c(html), F.lit("")), F.lit(GENERIC_IMG_RE), 0)

    kept = F.filter(urls, lambda u: F.lower(u).rlike(r"\A" + NO_HINT_RE))
    return F.coalesce(first_product_image(html, prefer_hosts), F.get(kept, 0))


def alt_image_url(url) -> Column:
    """CDN size-suffix stripped; NULL when not that CDN or unchanged."""
    u = _c(url)
    stripped = F.regexp_replace(u, SIZE_SUFFIX_RE, "")
    return F.when(F.contains(u, F.lit("cdn.shopify.com")) & (stripped != u), stripped)


def image_sniff(content) -> Column:
    """JPEG / PNG / GIF / WebP magic bytes."""
    h = F.hex(F.substring(_c(content), 1, 12))
    return (h.startswith("FFD8FF") | h.startswith("89504E470D0A1A0A")
            | h.startswith("474946383761") | h.startswith("474946383961")
            | (h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250")))


def image_ext(content_type, url) -> Column:
    """Extension from the content type, else from the URL, else .jpg."""
    ct = F.lower(strip_blanks(F.split(F.coalesce(_c(content_type), F.lit("")), ";").getItem(0)))
    m = F.create_map(*[x for k, v in EXT_BY_CONTENT_TYPE.items() for x in (F.lit(k), F.lit(v))])
    from_url = F.regexp_extract(F.coalesce(_c(url), F.lit("")), r"(?i)\.(jpg|jpeg|png|webp|gif)(?:\?|$)", 1)
    return F.coalesce(m[ct], F.when(from_url != "", F.concat(F.lit("."), F.lower(from_url))),
                      F.lit(".jpg"))


def html_unescape_url(url) -> Column:
    """The entities raw mail HTML leaves in URLs (``&amp;`` and friends)."""
    u = _c(url)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        u = F.replace(u, F.lit(a), F.lit(b))
    return u


def reserved_host(url) -> Column:
    """Host under a reserved TLD (.example/.invalid/.test/.localhost)."""
    host = F.lower(F.coalesce(F.parse_url(html_unescape_url(url), F.lit("HOST")), F.lit("")))
    return host.rlike(RESERVED_HOST_RE)


def ship_to_name(text) -> Column:
    return filled(F.regexp_extract(F.coalesce(_c(text), F.lit("")), SHIP_TO_RE, 1))


def gift_signal(text, gift_regex: str, owner: str | None = None) -> Column:
    """The gift phrase, else (owner known) 'ships to <name>' when the
    ship-to name does not contain the owner's name."""
    t = F.coalesce(_c(text), F.lit(""))
    phrase = filled(F.regexp_extract(t, "(?iU)" + gift_regex, 0))
    if words := required_words(gift_regex):
        phrase = _where_held(t, words, phrase)
    if not owner or not owner.strip():
        return phrase
    who = ship_to_name(text)
    alt = F.when(who.isNotNull() & ~F.contains(F.lower(who), F.lit(owner.strip().lower())),
                 F.concat(F.lit("ships to "), who))
    return F.coalesce(phrase, alt)
