"""WARC derivative builder (DataFrame functions only).

``responses`` frames fetched pages as WARC response records; ``derive`` turns
each response into two linked records: a *conversion* record whose block is the
page's plain text, and a *metadata* record (application/warc-fields) that keeps
the source's HTTP status, headers and digest, the title, the number of links
and the conversion's identifier and digest.  Both name the response in
WARC-Refers-To and each other in WARC-Concurrent-To / ``conversion-id``, so the
three can be joined again after any shuffle.  Identifiers are version-8 style
UUIDs cut from a SHA-256 of kind, page id, address and payload digest: reruns
give equal records, and equal input rows give equal records.

``write_warc`` writes the records as gzip text files whose line separator is
the two CRLF that end every WARC record.

Defined results: null or empty html has an empty payload and text (records are
still written); a null address or page id is an empty header value; control
characters in addresses and titles become spaces; an empty table gives no
records; markup that never closes reaches to the end of the page.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
EOL = "\r\n"
HTTP = "HTTP/1.1 200 OK"
MIME = "text/html; charset=utf-8"

#: Replacements that turn markup into text, in this order (Java and RE2 agree on the
#: patterns); a step without a pattern is a list of plain strings.
STEPS = [
    (r"(?is)<!--.*?(-->|\z)|<script\b.*?(</script[^>]*>|\z)|<style\b.*?(</style[^>]*>|\z)"
     r"|<title\b.*?(</title[^>]*>|\z)", " "),
    (r"[\x00-\x20]+", " "),
    (r"(?i)</?(p|br|div|li|ul|ol|h[1-6]|tr|td|th|table|article|section|nav|header|footer|main|aside|body)\b[^>]*>",
     "\n"),
    (r"<[^>]*(>|\z)", ""),
    (None, [("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&#60;", "<"), ("&gt;", ">"), ("&#62;", ">"),
            ("&quot;", "\""), ("&#34;", "\""), ("&apos;", "'"), ("&#39;", "'"), ("&#38;", "&"), ("&amp;", "&")]),
    (r" *\n[ \n]*", "\n"), (r"  +", " "),
]
TITLE = r"(?is)<title\b[^>]*>(.*?)</title"
LINK = r"(?i)<a\s[^>]*href"
CONTROL = r"[\x00-\x20]+"


def plain_text(html: Column) -> Column:
    for pattern, by in STEPS:
        if pattern:
            html = F.regexp_replace(html, pattern, by)
        else:
            for entity, sign in by:
                html = F.replace(html, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(html, r"\A\n|\n\z", ""))


def _line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, CONTROL, " "))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def _id(kind: str, *parts: Column) -> Column:
    h = F.sha2(F.concat_ws("|", F.lit(kind), *parts), 256)
    cut = [h.substr(1, 8), h.substr(9, 4), F.concat(F.lit("8"), h.substr(14, 3)),
           F.concat(F.lit("8"), h.substr(18, 3)), h.substr(21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    parts: list[Column] = [F.lit("WARC/1.1" + EOL)]
    for name, value in [*headers, ("Content-Length", F.octet_length(block).cast("string"))]:
        parts += [F.lit(f"{name}: "), value, F.lit(EOL)]
    return F.concat(*parts, F.lit(EOL), block)


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
              date: str = DATE) -> DataFrame:
    """page_id, target_uri, warc_date, http_header, payload, payload_digest, response_id."""
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"),
                        _line(F.coalesce(F.col(url), F.lit(""))).alias("target_uri"),
                        F.lit(date).alias("warc_date"), payload.alias("payload"),
                        _digest(payload).alias("payload_digest"),
                        F.concat(F.lit(f"{HTTP}{EOL}Content-Type: {MIME}{EOL}Content-Length: "),
                                 F.octet_length(payload).cast("string"),
                                 F.lit(EOL)).alias("http_header"))
    own = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    return rows.withColumn("response_id", _id("response", own, F.col("target_uri"), F.col("payload_digest")))


def response_records(rows: DataFrame) -> DataFrame:
    """record_type, record_id and the whole text of the response record."""
    block = F.concat("http_header", F.lit(EOL), "payload")
    headers = [("WARC-Type", F.lit("response")), ("WARC-Record-ID", F.col("response_id")),
               ("WARC-Target-URI", F.col("target_uri")), ("WARC-Date", F.col("warc_date")),
               ("WARC-Payload-Digest", F.col("payload_digest")), ("WARC-Block-Digest", _digest(block)),
               ("Content-Type", F.lit("application/http;msgtype=response"))]
    return rows.select("page_id", F.lit("response").alias("record_type"),
                       F.col("response_id").alias("record_id"), _record(headers, block).alias("record"))


def derive(rows: DataFrame) -> DataFrame:
    """Two rows for each response (of ``responses``): its metadata and its conversion record."""
    own = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    found = rows.select(
        "*", plain_text(F.col("payload")).alias("text"),
        _line(F.regexp_extract("payload", TITLE, 1)).alias("title"),
        F.regexp_count("payload", F.lit(LINK)).alias("n_links"),
        *[_id(k, own, F.col("target_uri"), F.col("payload_digest")).alias(f"{k}_id")
          for k in ("conversion", "metadata")]).withColumn("text_digest", _digest(F.col("text")))
    fields = [("source-http-status", F.lit("200")), ("source-content-type", F.lit(MIME)),
              ("source-content-length", F.octet_length("payload").cast("string")),
              ("source-payload-digest", F.col("payload_digest")), ("title", F.col("title")),
              ("links", F.col("n_links").cast("string")), ("conversion-id", F.col("conversion_id")),
              ("conversion-digest", F.col("text_digest"))]
    block = F.concat(*[x for name, value in fields for x in (F.lit(f"{name}: "), value, F.lit(EOL))])
    found = found.withColumn("fields", block).withColumn("fields_digest", _digest(F.col("fields")))

    def one(kind: str, other: str, mime: str, body: str, digest: str) -> Column:
        headers = [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", F.col(f"{kind}_id")),
                   ("WARC-Refers-To", F.col("response_id")), ("WARC-Concurrent-To", F.col(f"{other}_id")),
                   ("WARC-Target-URI", F.col("target_uri")), ("WARC-Date", F.col("warc_date")),
                   ("WARC-Block-Digest", F.col(digest)), ("Content-Type", F.lit(mime))]
        return F.struct(F.lit(kind).alias("record_type"), F.col(f"{kind}_id").alias("record_id"),
                        F.col("response_id").alias("refers_to"), F.col("target_uri"),
                        F.col("payload_digest"), F.col(digest).alias("block_digest"),
                        F.octet_length(body).cast("long").alias("content_length"), F.col("title"),
                        F.col("n_links").cast("long").alias("n_links"),
                        _record(headers, F.col(body)).alias("record"))

    return found.select("page_id", F.inline(F.array(
        one("metadata", "conversion", "application/warc-fields", "fields", "fields_digest"),
        one("conversion", "metadata", "text/plain; charset=utf-8", "text", "text_digest"))))


def write_warc(records: DataFrame, path: str) -> None:
    """Write the ``record`` column as .gz WARC files under ``path``."""
    records.select("record").write.option("lineSep", EOL + EOL).option("compression", "gzip").text(path)


def op10_warc_derivatives(spark, sf_dir):
    out = derive(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return out.withColumn("record_sha256", F.sha2("record", 256)).drop("record")


def _sql(text: str) -> str:
    """A string as DuckDB literal."""
    if any(ord(c) < 32 for c in text):
        return "e'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\r", "\\r").replace("\n", "\\n") + "'"
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    line = f"trim(regexp_replace(%s, {_sql(CONTROL)}, ' ', 'g'))"
    text = "payload"
    for pattern, by in STEPS:
        if pattern:
            text = f"regexp_replace({text}, {_sql(pattern)}, {_sql(by)}, 'g')"
        else:
            for entity, sign in by:
                text = f"replace({text}, {_sql(entity)}, {_sql(sign)})"
    text = f"trim(regexp_replace({text}, {_sql(chr(92) + 'A' + chr(92) + 'n|' + chr(92) + 'n' + chr(92) + 'z')}, '', 'g'))"

    def id_(kind):
        h = f"sha256('{kind}|' || own || '|' || target_uri || '|' || payload_digest)"
        return (f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-8' || substr({h}, 14, 3)"
                f" || '-8' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12) || '>'")

    def record(kind, other, mime, body, digest):
        heads = [("WARC-Type", f"'{kind}'"), ("WARC-Record-ID", f"{kind}_id"), ("WARC-Refers-To", "response_id"),
                 ("WARC-Concurrent-To", f"{other}_id"), ("WARC-Target-URI", "target_uri"),
                 ("WARC-Date", f"'{DATE}'"), ("WARC-Block-Digest", digest), ("Content-Type", f"'{mime}'"),
                 ("Content-Length", f"CAST(strlen({body}) AS VARCHAR)")]
        whole = " || ".join([_sql("WARC/1.1" + EOL), *(f"'{k}: ' || {v} || {_sql(EOL)}" for k, v in heads),
                             _sql(EOL), body])
        return (f"SELECT page_id, '{kind}' AS record_type, {kind}_id AS record_id, response_id AS refers_to, "
                f"target_uri, payload_digest, {digest} AS block_digest, strlen({body}) AS content_length, title, "
                f"n_links, sha256({whole}) AS record_sha256 FROM c")

    fields = [("source-http-status", "'200'"), ("source-content-type", f"'{MIME}'"),
              ("source-content-length", "CAST(strlen(payload) AS VARCHAR)"),
              ("source-payload-digest", "payload_digest"), ("title", "title"),
              ("links", "CAST(n_links AS VARCHAR)"), ("conversion-id", "conversion_id"),
              ("conversion-digest", "text_digest")]
    block = " || ".join(f"'{k}: ' || {v} || {_sql(EOL)}" for k, v in fields)
    return f"""
WITH r AS (SELECT page_id, coalesce(CAST(page_id AS VARCHAR), '') AS own,
  {line % "coalesce(url, '')"} AS target_uri, coalesce(html, '') AS payload,
  'sha256:' || sha256(coalesce(html, '')) AS payload_digest FROM pages),
a AS (SELECT *, {id_('response')} AS response_id, {id_('conversion')} AS conversion_id,
  {id_('metadata')} AS metadata_id, {text} AS text,
  {line % f"regexp_extract(payload, {_sql(TITLE)}, 1)"} AS title,
  len(regexp_extract_all(payload, {_sql(LINK)})) AS n_links FROM r),
b AS (SELECT *, 'sha256:' || sha256(text) AS text_digest FROM a),
c AS (SELECT *, {block} AS fields, 'sha256:' || sha256({block}) AS fields_digest FROM b)
{record('metadata', 'conversion', 'application/warc-fields', 'fields', 'fields_digest')}
UNION ALL {record('conversion', 'metadata', 'text/plain; charset=utf-8', 'text', 'text_digest')}"""
