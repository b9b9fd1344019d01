"""Catalogue merges into existing rows, decisions, cuts, mailboxes, joins and whole runs."""
import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from receiptflow.operators import completions as CO
from receiptflow.operators import ingest as I
from receiptflow.operators import merge as M
from receiptflow.operators import profiles as PR
from receiptflow.operators import vectors as VX
from receiptflow.operators.joins import substring_join
from receiptflow.sources import mail as S

D = dt.date(2026, 3, 1)


def _sightings(spark, rows):
    return spark.createDataFrame(rows, "uid string, seq long, pos int, profile string, seller string, order_id string, "
                                       "name string, delivered_at date, return_by date")


def test_existing_rows_keep_everything_but_missing_dates(spark):
    big = 3_000_000_000
    old = spark.createDataFrame(
        [(big, "p", "s", "A", "x", 9.5, "keep", None, None, "mine"), (7, "p", "s", "A", "y", 1.0, None, D, None, None)],
        "id long, profile string, seller string, order_id string, name string, price double, return_state string, "
        "delivered_at date, return_by date, note string")
    new = _sightings(spark, [("u1", 1, 1, "p", "s", "A", "x", D, None), ("u1", 1, 2, "p", "s", "A", "z", None, None),
                             ("u2", 2, 1, "p", "s", "A", "y", dt.date(2026, 4, 1), D)])
    got = {r.name: r for r in M.merge_lifecycle(new, None, old).collect()}
    x, y, z = got["x"], got["y"], got["z"]
    assert (x.id, x.price, x.return_state, x.delivered_at, x.note, x.added) == (big, 9.5, "keep", D, "mine", False)
    assert (y.id, y.return_state, y.delivered_at, y.return_by) == (7, None, D, D)
    assert (z.id, z.return_state, z.quantity, z.added) == (big + 1, "evaluate", 1, True)
    refunds = spark.createDataFrame([("r", 5, "p", "A", "x")], "uid string, seq long, profile string, order_id string, name string")
    got = {r.name: r.return_state for r in M.merge_lifecycle(new, refunds, old).collect()}
    assert got == {"x": "returned", "y": None, "z": "evaluate"}


def test_decisions(spark):
    items = spark.createDataFrame([(1, "keep", "a"), (2, None, "b"), (3, "return", "c")], "id long, return_state string, name string")
    told = spark.createDataFrame([(1, "k", "return", 1), (2, "k", "evaluate", 1), (1, "k", "keep", 2)],
                                 "seq int, key string, state string, id long")
    got = {r.id: (r.return_state, r.name) for r in M.decided_catalogue(items, told).collect()}
    assert got == {1: ("evaluate", "a"), 2: ("keep", "b"), 3: ("return", "c")}
    for f in (M.apply_decisions, M.decided_catalogue):
        with pytest.raises(ValueError, match="sold"):
            f(items, told.withColumn("state", F.lit("sold")))


def test_remap_runs_once_and_migration_keeps_columns(spark):
    items = spark.createDataFrame([("panda", None), ("x", "boss")], "zone string, zone_secondary string")
    out, version = M.remap_zone_ids(items)
    assert [tuple(r) for r in out.collect()] == [("crafting", None), ("x", "work-office")]
    again, _ = M.remap_zone_ids(items, version)
    assert again is items
    old = spark.createDataFrame([(1, None, "e"), (2, 4, "f")], "id int, quantity int, extra string")
    target = T.StructType([T.StructField("id", T.LongType()), T.StructField("quantity", T.IntegerType()),
                           T.StructField("zone", T.StringType())])
    got = M.migrate_columns(old, target)
    assert got.columns == ["id", "quantity", "zone", "extra"]
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, 1, None, "e"), (2, 4, None, "f")]


def test_cuts(spark):
    text = ("Your order: Trending now poster x 1\n2 x Lamp - $5.00\n\nYou might also like:\nChair - $9\nTable - $8\n\n"
            "1 x Desk - $3.00\nRecommended for you\nSofa\n")
    got = spark.createDataFrame([(text,)], "t string").select(CO.cut_recommendations("t")).first()[0]
    assert got == "Your order: Trending now poster x 1\n2 x Lamp - $5.00\n\n\n1 x Desk - $3.00\n"
    rows = {"Total War Box": False, "Tax Guide for you": False, "Shipping Scale": False, "Discount Card Deck": False,
            "Gift Card Holder": False, "Total": True, "subtotal:": True, "Tax (8.25%) $1.20": True, None: False}
    df = spark.createDataFrame([(k,) for k in rows], "n string")
    assert {r[0]: r[1] for r in df.select("n", CO.is_accounting_row("n")).collect()} == rows


def test_prompts_carry_the_whole_body(spark):
    m = spark.createDataFrame([("u", "a@b", "s {x}", "w " * 9000 + "END")], "uid string, from_addr string, subject string, text string")
    got = CO.prompts(m, "toy purchase").first().prompt
    assert got.rstrip().endswith("END") and "toy purchase" in got and "Subject: s {x}" in got
    own = CO.prompts(m, "toy", lambda noun: F.concat(F.lit(noun + ":"), "subject")).first().prompt
    assert own == "toy:s {x}"


def test_mailbox_files_in_order(spark, tmp_path):
    def mail(k, body, charset, message_id=True):
        head = f"From a@b Thu Jan  1 00:00:00 2026\nFrom: a@b\nSubject: m{k}\n" + (f"Message-ID: <{k}@x>\n" if message_id else "")
        return (head + f"Content-Type: text/plain; charset={charset}\nContent-Transfer-Encoding: 8bit\n\n").encode() + \
            body.encode(charset) + b"\n\n"
    (tmp_path / "a.mbox").write_bytes(mail(0, "café", "iso-8859-1") + mail(1, ">From here\nMessage-ID: no", "utf-8", False))
    (tmp_path / "b.mbox").write_bytes(b"".join(mail(2 + k, "x" * 3000 * k, "utf-8", False) for k in range(3)))
    got = sorted(S.decode_mime(S.scan_mbox(spark, str(tmp_path))).collect(), key=lambda r: r.seq)
    assert [r.subject for r in got] == ["m0", "m1", "m2", "m3", "m4"]
    assert [r.uid for r in got] == ["<0@x>", "mbox-a-000001", "mbox-b-000000", "mbox-b-000001", "mbox-b-000002"]
    assert got[0].text == "café\n" and got[1].text == ">From here\nMessage-ID: no\n"


def test_broken_and_strange_mail(spark):
    raw = [("ok", 0, b"Subject: =?utf-8?q?caf=C3=A9?=\nFrom: A@B\nDate: nonsense\n\nhi"),
           ("single-html", 1, b"Content-Type: text/html\n\n<p>x</p>"), ("none", 2, None),
           ("attached", 3, b'Content-Type: multipart/mixed; boundary="q"\n\n--q\nContent-Type: text/plain\n\nbody\n--q\n'
                           b'Content-Type: text/plain\nContent-Disposition: attachment; filename="f.txt"\n\nfile\n--q--\n'),
           ("charset", 4, b"Content-Type: text/plain; charset=no-such\n\nabc")]
    got = {r.uid: r for r in S.decode_mime(spark.createDataFrame(raw, "uid string, seq long, raw binary")).collect()}
    assert (got["ok"].subject, got["ok"].from_addr, got["ok"].msg_date, got["ok"].text) == ("café", "a@b", None, "hi")
    assert (got["single-html"].html, got["single-html"].text) == ("<p>x</p>", "")
    assert got["none"].decode_error and got["attached"].text.strip() == "body" and got["charset"].text == ""


def test_all_candidates_without_a_cap(spark):
    m = spark.range(6000).select(F.col("id").cast("string").alias("uid"), F.col("id").alias("seq"),
                                 F.lit("a@shop.x").alias("from_addr"), F.lit(D).alias("msg_date"))
    assert S.candidate_messages(m, ["shop.x"]).count() == 6000
    assert [r.seq for r in S.candidate_messages(m, ["shop.x"], cap=3).collect()] == [0, 1, 2]


def test_keys_with_one_prefix_meet_few_items(spark):
    items = spark.range(400).select("id", F.concat(F.lit("brand#"), F.col("id").cast("string")).alias("name"))
    keys = spark.createDataFrame([("Brand#39",), ("b_and#7",), ("%#11%",), ("a\\",), ("%",), ("zzz",)], "key string")
    got = substring_join(items, keys, "name")
    names = {r.id: r.name for r in items.collect()}
    want = {("Brand#39", i) for i, n in names.items() if "brand#39" in n} | {("b_and#7", i) for i, n in names.items() if "brand#7" in n} \
        | {("%#11%", i) for i, n in names.items() if "#11" in n} | {("%", i) for i in names}
    assert {(r.key, r.id) for r in got.filter("key <> 'a\\\\'").collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_numbers_beyond_a_bigint_are_no_ids(spark):
    from receiptflow.operators.views import find_items
    items = spark.createDataFrame([(1, "p", "lamp", "o1")], "id long, profile string, name string, order_id string")
    keys = spark.createDataFrame([("9" * 20,), ("1",), ("lam",)], "key string")
    assert sorted((r.key, r.id) for r in find_items(items, keys, "p").collect()) == [("1", 1), ("lam", 1)]


def test_reindex_job(spark):
    items = spark.createDataFrame([(1, "a.jpg"), (2, None), (3, "c.jpg")], "id long, image_path string")
    emb = spark.createDataFrame([(1, [1.0])], "item_id long, vector array<double>")

    def predict(plan):
        return plan.select(F.col("id").alias("item_id"), F.when(F.col("id") != 3, F.array(F.lit(2.0))).alias("vector"))
    index, stats = VX.reindex(items, emb, predict, force=True)
    assert sorted((r.item_id, r.vector) for r in index.collect()) == [(1, [2.0])]
    assert tuple(stats.first()) == (1, 1, 1)
    index, stats = VX.reindex(items, emb, predict)
    assert sorted((r.item_id, r.vector) for r in index.collect()) == [(1, [1.0])]
    assert tuple(stats.first()) == (0, 1, 1)


def test_model_hook_and_completion_fallback(spark):
    raw = spark.createDataFrame([("u1", 0, b"From: n@shop.x\nSubject: your order\n\nhello"),
                                 ("u2", 1, b"From: n@shop.x\nSubject: your order\n\nworld")], "uid string, seq long, raw binary")
    cache = spark.createDataFrame([("u1", '{"items": [{"name": "A"}, {"name": "A"}, {"name": "B", "quantity": 2.5}]}')],
                                  "email_uid string, response_json string")
    asked = []

    def model(prompts):
        asked.extend(r.uid for r in prompts.collect())
        return prompts.select(F.col("uid").alias("email_uid"), F.lit('{"items": [{"name": "C"}]}').alias("response_json"))
    res = I.run_ingest(raw, PR.load_profile("amazon"), cache=cache, model=model)
    assert asked == ["u2"]
    assert sorted((r.name, r.quantity, r.source) for r in res.catalogue.collect()) == [("A", 1, "llm"), ("B", 2, "llm"), ("C", 1, "llm")]
    assert {r.email_uid: (r.status, r.parsed_via, r.items_found) for r in res.log.collect()} == {
        "u1": ("added", "llm", 2), "u2": ("added", "llm", 1)}
    dry = I.run_ingest(raw, PR.load_profile("amazon"), cache=cache, dry_run=True)
    assert dry.catalogue is None and dry.summary.first().added == 2 and dry.summary.first().no_parse == 1


def test_no_body_in_a_shuffle(spark):
    msgs = spark.createDataFrame([("u", 0, "auto@amazon.com", "Your order", D, "t", "<p>h</p>")],
                                 "uid string, seq long, from_addr string, subject string, msg_date date, text string, html string")
    prof = PR.load_profile("amazon")
    s = PR.finish_sightings(PR.explode_sightings(PR.parse_messages(msgs, prof), prof), prof)
    assert "Exchange" not in s._jdf.queryExecution().executedPlan().toString()
    assert not {"html", "text"} & set(s.columns)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from receiptflow import session

    class Context:
        master = "spark://host:7077"
        def getCheckpointDir(self): return None
        def getConf(self): return {}

    class Session:
        sparkContext = Context()
        conf = {}
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
