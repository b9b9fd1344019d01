"""What large inputs showed: mail decoded without the library's parser, values found once, items routed once."""
from pyspark.sql import functions as F

from receiptflow.sources import mail as S

PARTS = (b'From: "Shop, A" <Shop@X.example>\nSubject: Order %d  of 2\nDate: Tue, 3 Mar 1998 23:59:59 -0800\n'
         b'Message-ID: <a.%d@x.example>\nContent-Type: multipart/alternative; boundary="=b1="\n\npreamble\n--=b1=\n'
         b'Content-Type: text/plain; charset="utf-8"\nContent-Transfer-Encoding: 8bit\n\ncaf\xc3\xa9 \n--=b1x\n\n--=b1=\n'
         b'Content-Type: text/html; charset=iso-8859-1\n\n<p>caf\xe9</p>\n--=b1=\nContent-Type: image/png\n\nx\n--=b1=--\n')
ONE = b"Subject: plain\nFrom: a@b.example\n\nbody\n\n"


def test_plain_mail_is_read_without_the_parser(monkeypatch):
    mails = [PARTS % (k, k) if k % 2 else ONE for k in range(40)]
    want = [S._parsed_mail(m) for m in mails]
    S._content_kind('multipart/alternative; boundary="b"')
    for kind in ('text/plain; charset="utf-8"', "text/html; charset=iso-8859-1", "image/png"):
        S._content_kind(kind)

    def used(*_, **__):
        raise AssertionError("the parser was used")
    monkeypatch.setattr(S, "message_from_bytes", used)
    assert [S.decode_one(m) for m in mails] == want
    assert want[1]["text"] == "café \n--=b1x\n" and want[1]["html"] == "<p>café</p>" and str(want[1]["msg_date"]) == "1998-03-03"


def test_odd_mail_goes_to_the_parser():
    whole = PARTS % (1, 1)
    odd = [whole.replace(b"\n", b"\r\n"), whole.replace(b"8bit", b"base64"), whole.replace(b"--=b1=--\n", b""),
           whole.replace(b"Order", b"=?utf-8?q?=C3=A9?="), whole.replace(b"Subject: ", b"Subject:\n "),
           whole.replace(b"image/png", b"message/rfc822"), whole.replace(b"image/png", b"text/plain\nContent-Disposition: attachment"),
           whole.replace(b"Tue, 3 Mar", b"Tue, 33 Mar"), whole.replace(b"<a.1@x", b"<a 1@x"), ONE[:20], b"",
           whole.replace(b"=b1=--", b"=b1=-- "), whole.replace(b"iso-8859-1", b"nope")]
    assert [S.decode_one(m) for m in odd] == [S._parsed_mail(m) for m in odd]


def test_decode_keeps_keys_and_errors(spark):
    raw = spark.createDataFrame([("a", 1, bytearray(ONE)), (None, None, None)], "uid string, seq int, raw binary")
    rows = {r["uid"]: r for r in S.decode_mime(raw).collect()}
    assert rows["a"]["seq"] == 1 and rows["a"]["text"] == "body\n\n" and rows["a"]["decode_error"] is None
    assert rows[None]["seq"] is None and rows[None]["decode_error"].startswith("TypeError")


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bodies_are_built_once_for_found_values(spark):
    """A filter on the value used to be pushed down and to build the body up to five times."""
    from receiptflow.plans import q_text as Q
    from .conftest import SF001
    for q in (Q.gift_signal, Q.return_by_date, Q.delivered_date):
        assert _plan(q(spark, SF001)).count("https?://") <= 2, q.__name__   # order mail and marketing mail


def test_first_price_searches_a_body_once(spark):
    from receiptflow.functions import text as X
    texts = ["a $ 1,234.50 b", "usd12", "5 Krw", "1,5.00 eur EUR 3", "UUSD 7", "A cad", "£", "", None, "12 34 AUD", "x ¥٣",
             "e EUR 2.10", "9.999 gbp", "$,1", "7.00EUR5"]
    old = (r"(?iU)(?:([$£€¥₩])\s?(\d[\d,]*(?:\.\d{2})?))|(?:(USD|GBP|EUR|JPY|KRW|CAD|AUD)\s?(\d[\d,]*(?:\.\d{2})?))"
           r"|(?:(\d[\d,]*(?:\.\d{2})?)\s?(USD|GBP|EUR|JPY|KRW|CAD|AUD))")
    t = F.coalesce(F.col("t"), F.lit(""))
    g = [F.regexp_extract(t, old, i) for i in range(1, 7)]
    amt = F.when(g[0] != "", g[1]).when(g[2] != "", g[3]).when(g[5] != "", g[4])
    tok = F.when(g[0] != "", g[0]).when(g[2] != "", g[2]).when(g[5] != "", g[5])
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    for was, now in df.select(F.struct(X.to_amount(amt), X.normalize_currency(tok)), X.first_price("t")).collect():
        assert tuple(was) == tuple(now)
    price = df.select(X.first_price("t")["price"].alias("p"))
    assert _plan(price).count("regexp_extract(") == 1


def test_cascade_takes_the_first_that_found_something(spark):
    from receiptflow.operators import extract as E
    df = spark.createDataFrame([([], None, ["c"]), (None, ["b"], ["c"]), (["a"], [], []), (None, None, None)],
                               "a array<string>, b array<string>, c array<string>")
    as_items = [F.transform(c, lambda t: E._item(t, F.lit(1), F.lit(None).cast("double"), F.lit(None).cast("string")))
                for c in ("a", "b", "c")]
    found = df.select(E.cascade(*as_items)["title"].alias("t"))
    assert [r["t"] for r in found.collect()] == [["c"], ["b"], ["a"], []]
    assert _plan(found).count("transform(") <= 3


def test_triage_routes_items_once(spark, monkeypatch):
    from receiptflow import session
    from receiptflow.operators import ranking, zones as Z
    written = []

    def spy(df, name="stage", inner=session.materialize):
        written.append((name, _plan(df).count("RLIKE")))
        return inner(df, name)
    monkeypatch.setattr(session, "materialize", spy)
    monkeypatch.setattr(ranking, "materialize", spy)
    items = spark.createDataFrame([(1, "Yoga Mat", 1, None, 3), (2, "Stone", 1, None, None), (3, "Mat yoga mat", 1, None, 1)],
                                  "id long, name string, quantity int, is_gift string, days_left int")
    got = Z.triage_report(Z.route_items(items)).select("zone_key", "rank", "id").collect()
    assert sorted(map(tuple, got)) == [("fitness", 1, 3), ("fitness", 2, 1), ("unrouted", 1, 2)]
    assert [n for n, k in written if k] == ["routed"]


def test_row_keys_of_a_message_are_made_once(spark):
    from receiptflow.operators import profiles as PR
    rows = "array<struct<seller:string,order_id:string,name:string>>"
    df = spark.createDataFrame([([("s", "1", "a"), ("s", "1", None), ("s", "1", "a"), ("s", "1", None), ("s", "1", "")],), (None,)],
                               f"items {rows}")
    got = df.select(PR.first_of_each(F.col("items")).alias("x"))
    assert [r["x"] and [i["pos"] for i in r["x"]] for r in got.collect()] == [[1, 2, 5], None]
    assert _plan(got).count("transform(items") + _plan(got).count("transform(knownnotnull(items") <= 2   # keys, rows


def test_first_letters():
    from receiptflow.operators import zones as Z
    assert Z.first_letters([r"\bbulk\b", "lot of"]) == "(?=(?-iU:[BLbl]))"
    assert "K" in Z.first_letters(["kit"])
    assert {Z.first_letters([p, "x"]) for p in (r"\d+", "a?b", "a*", "a|b", "(a)", ".", "", "[ab]")} == {""}


def test_decisions_are_searched_once(spark, monkeypatch):
    from receiptflow.operators import merge as M
    written, inner = [], M.materialize
    monkeypatch.setattr(M, "materialize", lambda df, name: written.append(name) or inner(df, name))
    items = spark.createDataFrame([(1, None), (2, "keep")], "id long, return_state string")
    asked = spark.createDataFrame([(1, "a", "return", 1), (2, "b", "keep", 1)], "seq int, key string, state string, id long")
    got = [tuple(r) for r in M.apply_decisions(items, asked).orderBy("seq").collect()]
    assert got == [(1, "a", 1, "(none)", "return"), (2, "b", 1, "return", "keep")]
    assert M.decided_catalogue(items, asked).orderBy("id").collect()[0]["return_state"] == "keep"
    assert written == ["decisions", "decisions"]


def _old_completion_json(raw):
    """The same steps without values that are computed once (as it was before)."""
    from receiptflow.functions.text import strip_unicode
    r = strip_unicode(F.coalesce(F.col(raw), F.lit("")))
    fenced = F.regexp_extract(F.regexp_replace(r, r"^`+|`+$", ""), r"(?s)\{.*", 0)
    cand = F.when(r.startswith("```"), F.when(F.instr(fenced, "{") > 0, fenced).otherwise(F.lit(""))).otherwise(r)
    start, end = F.instr(cand, "{"), F.length(cand) - F.instr(F.reverse(cand), "}") + 1
    inner = F.when((start > 0) & (F.instr(F.reverse(cand), "}") > 0) & (start < end), F.substring(cand, start, end - start + 1))
    return F.when(F.try_parse_json(cand).isNotNull(), cand).when(F.try_parse_json(inner).isNotNull(), inner)


ITEM = '{"name":%s,"maker":null,"price":%s,"currency":"USD","quantity":%s,"order_id":"1"}'
ANSWERS = ['{"items":[]}', ' \u00a0{"a":1}\n', "```json\n{\"a\":1}\n```", "```", "```json```", "``` {\"a\": ```", "Sure! {\"a\":[1]} more",
           "}{", "{", "", None, "true", "tRue {}", "null", "[1]", "x", 'N {"é":"}"} \u2028', "NaN", "Infinity", "-1", '"s"', "```\n[1]\n```",
           "`{}`", "{}\n ", "Sure", 'a {"a":1} {"b":2}', '{"a":1,"a":2}', "```{\"a\":1}``` {", "\u0085{}\u0085", '\u3000z{"k":"``"}`',
           "```\u00e9{\"\u00e9\":1} \n```\n"]


def test_completion_is_read_once(spark):
    from receiptflow.operators import completions as CO
    df = spark.createDataFrame([(a,) for a in ANSWERS], "a string")
    both = df.select("a", CO.completion_json("a").alias("now"), _old_completion_json("a").alias("was")).collect()
    assert [(r.a, r.now) for r in both] == [(r.a, r.was) for r in both]
    assert sum(r.now is not None for r in both) > 12
    plan = _plan(df.select(CO.completion_json("a").alias("x")))
    assert plan.count("regexp_replace(") == 2 and plan.count("parseJson") == 2   # strip, fence; whole, salvaged


def test_contract_is_checked_in_one_pass(spark):
    from receiptflow.operators import completions as CO
    ok = ITEM % ('"n"', "1.5", "2")
    answers = {"ok": '{"items":[%s,%s]}' % (ok, ITEM % ("null", "null", "1")), "none": '{"items":[]}', "top": '{"items":[],"x":1}',
               "top2": '{"x":1,"items":[%s,%s]}' % (ok, ok), "list": "[%s]" % ok, "null": None, "gap": '{"items":[null]}',
               "bad": '{"items":[%s,%s,{"name":"n"}]}' % (ITEM % ("5", '"1"', "0"), ITEM % ('"n"', "1", "1.5"))}
    df = spark.createDataFrame(list(answers.items()), "uid string, json string")
    found = CO.contract_violations(df)
    got = sorted((r.uid, r["item"], r.violation) for r in found.collect())
    keys, price, name, qty, top = "item keys", "price not a number", "name not text", "quantity not a positive int", "top-level keys"
    assert got == sorted([("top", 0, top), ("top2", 0, top), ("list", 0, top), ("null", 0, top), ("gap", 1, keys), ("gap", 1, qty),
                          ("bad", 1, price), ("bad", 1, name), ("bad", 1, qty), ("bad", 2, qty), ("bad", 3, keys), ("bad", 3, qty)])
    plan = _plan(found)
    assert "Union" not in plan and plan.count("parseJson") == 1


def test_mail_is_rendered_as_far_as_asked(spark):
    from receiptflow.plans import proxies as P, q_completions as Q
    from .conftest import SF001
    whole = P.messages_p(spark, SF001)
    part = P.messages_p(spark, SF001, ("msg_date", "subject"))
    assert part.columns == [c for c in whole.columns if c not in ("text", "html")]
    assert part.exceptAll(whole.select(*part.columns)).count() == 0 and part.count() == whole.count()
    for q in (Q.check_items_json, Q.normalize_completions):
        assert "https://" not in _plan(q(spark, SF001)), q.__name__


def test_positions_in_one_group_are_no_task_of_their_own(spark):
    from receiptflow.operators.ranking import position_within
    df = spark.range(4000).select((F.col("id") % 4000 == 7).alias("g"), (F.col("id") * 7919 % 4000).alias("v"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = position_within(df, "g", [F.col("v")], name="r").withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(r.r for r in rows if not r.g) == list(range(1, 4000)) and [r.r for r in rows if r.g] == [1]
    assert [r.v for r in sorted(rows, key=lambda r: r.r) if not r.g] == sorted(r.v for r in rows if not r.g)
    tasks = [r.task for r in rows]
    assert max(map(tasks.count, set(tasks))) < 3000


def test_searched_items_are_built_once(spark):
    from receiptflow.operators.views import find_items
    items = spark.range(1, 60).select("id", F.lit("p").alias("profile"), F.concat(F.lit("lamp "), "id").alias("name"),
                                      (F.col("id") + 50).cast("string").alias("order_id"))
    keys = spark.createDataFrame([(k,) for k in ("55", "55", "80", "5", "mp 59", "LAMP 58", None, "zz")], "key string")
    found = find_items(items, keys, "p")
    got = sorted((r.key, r.tier, r.id) for r in found.collect())
    assert got == [("5", 1, 5), ("55", 1, 55), ("55", 1, 55), ("80", 2, 30), ("LAMP 58", 3, 58), ("mp 59", 3, 59)]
    assert "Range (" not in _plan(found)


def test_merged_rows_are_made_once(spark, monkeypatch):
    from receiptflow.operators import merge as M
    from receiptflow.plans import q_merge
    from .conftest import SF001
    ranked, written, inner, keep = [], [], M.global_position, M.materialize
    monkeypatch.setattr(M, "global_position", lambda df, *a, **k: ranked.append(_plan(df)) or inner(df, *a, **k))
    monkeypatch.setattr(M, "materialize", lambda df, name: written.append(df.columns) or keep(df, name))
    assert q_merge.catalog_insert(spark, SF001).count() > 0
    assert len(ranked) == 1 and "Aggregate" not in ranked[0]
    assert not {"price", "image_url", "category", "owner"} & set(written[0])
