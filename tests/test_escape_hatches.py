"""Python templates, batched models, regular-expression rules, long titles, sliced kNN."""
import dataclasses
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from receiptflow.operators import classify as C
from receiptflow.operators import extract as E
from receiptflow.operators import profiles as PR
from receiptflow.operators import vectors as V


def test_long_titles_are_kept(spark):
    long = "A very long title " * 60
    assert len(long) > 1000
    text = f"* {long}\n  Quantity: 2\n  8.98 USD\n\n- {long}\n- Short one\n"
    df = spark.createDataFrame([(text,)], "t string")
    block, bare, cut = df.select(E.block_items(F.col("t")), E.bare_items(F.col("t")),
                                 E.bare_items(F.col("t"), longest=100)).first()
    assert [(r["title"], r["quantity"], r["price"]) for r in block] == [(long.strip(), 2, 8.98)]
    assert [r["title"] for r in bare] == [long.strip(), "Short one"]
    assert [r["title"] for r in cut] == ["Short one"]


def read_note(message):
    if "broken" in message["text"]:
        raise ValueError("no")
    return [{"name": w, "quantity": 1, "purchased_at": message["msg_date"]} for w in re.findall(r"item:(\w+)", message["text"])]


def test_python_template_reads_what_it_claims(spark):
    note = PR.PythonTemplate("note", lambda: F.contains("subject", F.lit("note")), read=read_note)
    prof = dataclasses.replace(PR.load_profile("demo"), templates=[note, *PR.load_profile("demo").templates],
                               keyword_gate=["note", "receipt"])
    rows = [("a", 1, "x@y.example", "a note", "item:one item:two item:one", None),
            ("b", 2, "x@y.example", "a note", "broken item:one", None),
            ("c", 3, "shop@y.example", "receipt", "Total $12.50", None),
            ("d", 4, "x@y.example", "flash sale note", "item:one", None)]
    mail = spark.createDataFrame(rows, "uid string, seq long, from_addr string, subject string, text string, html string")
    mail = mail.withColumn("msg_date", F.to_date(F.lit("2024-05-06")))
    parsed = PR.parse_messages(mail, prof)
    got = {r["uid"]: r for r in parsed.collect()}
    assert {u: r["via"] for u, r in got.items()} == {"a": "template:note", "b": "template:note", "c": "template:generic", "d": "gate"}
    assert [(x["pos"], x["it"]["name"], x["it"]["source"]) for x in got["a"]["items"]] == [(1, "one", "template"), (2, "two", "template")]
    assert got["a"]["n_found"] == 3 and got["b"]["items"] == [] and len(got["c"]["items"]) == 1 and got["d"]["items"] == []
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


@pytest.mark.parametrize("pattern, literal", [
    (r"\bgreen\b", "green"), (r"gr(?:e)en tea", "green tea"), (r"a|b", ""), (r"colou?r tv", "colo"), (r"[gG]reen", "reen"),
    (r"(ab)+c", "c"), (r"x{2,3}yz", "yz"), (r"café", ""), (r"(?P<a", ""), ("", ""), (r"\d+", ""), (r"Tea", "tea"), (r"(?=ab)cd", "cd")])
def test_required_literal(pattern, literal):
    assert C.required_literal(pattern) == literal


def test_every_match_holds_the_literal():
    texts = ["green tea", "Green  Tea", "colour tv", "color tv", "xxyz", "abababc", "cd", "café", "12"]
    for pattern in (r"\bgreen\b", r"colou?r tv", r"[gG]reen", r"(ab)+c", r"x{2,3}yz", r"a|b", r"c(?:o)+lo", r"(?:gr|G)een"):
        for text in texts:
            if re.search(pattern, text, re.I):
                assert C.required_literal(pattern) in text.lower()


def test_regex_rules_equal_brute_force(spark):
    words = ["green tea", "black tea set", "colour tv", "Color TV", "tv stand", "xxyz", "", "plain", "GREEN-light", "café 12"]
    rules = [("tea", 5, r"\btea\b"), ("tv", 4, r"colou?r tv$"), ("any", 9, r"[a-z]"), ("green", 1, r"^green[ -]l"), ("x", 2, r"x{2}y"),
             ("number", 3, r"\d+"), ("none", 0, None), ("java", 6, r"\p{Lu}{3,}")]
    rng = np.random.default_rng(0)
    rules += [(f"r{k}", 20 + k, "".join(rng.choice(list("abc"), 3)) + "+z") for k in range(500)]
    items = spark.createDataFrame([(k, w) for k, w in enumerate([*words, None])], "id long, name string")
    out = {r["id"]: r["label"] for r in C.regex_rules_classify(
        items, spark.createDataFrame(rules, "label string, priority int, pattern string")).collect()}
    for k, w in enumerate([*words, None]):
        hits = [(p, n) for n, p, r in rules if r and "\\p" not in r and re.search(r, w or "", re.I)]
        if re.search("[a-zA-Z]{3,}", w or ""):
            hits.append((6, "java"))   # ignoring case, upper-case letters are any
        assert out[k] == (min(hits)[1] if hits else None), w


def test_batched_model_loads_once_and_isolates_failures(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        open(f"{folder}/{np.random.default_rng().integers(1 << 60)}", "w").close()

        def model(ids):
            if (ids == 7).any():
                raise ValueError("bad")
            return np.stack([ids, np.where(ids == 5, np.nan, ids * 2.0)], axis=1)
        return model

    items = spark.range(40).withColumn("image_path", F.when(F.col("id") != 3, F.lit("x"))).repartition(1)
    emb = spark.createDataFrame([(7, [9.0])], "item_id long, vector array<float>")
    index, stats = V.reindex(items, emb, V.batched_model(make, "id", batch_size=16), force=True)
    got = {r["item_id"]: r["vector"] for r in index.collect()}
    assert got[8] == [8.0, 16.0] and got[7] == [9.0] and 5 not in got and 3 not in got
    assert tuple(stats.first()) == (37, 1, 2)
    assert V.batched_model(lambda: (lambda ids: 1 / 0), "id")(items).filter("vector IS NOT NULL").count() == 0


def test_sliced_knn_equals_one_product(monkeypatch):
    rng = np.random.default_rng(1)
    index = pd.DataFrame({"item_id": range(97), "vector": list(rng.integers(-3, 4, (97, 4)).astype(float))})
    queries = pd.DataFrame({"query_id": range(11), "_q": list(rng.integers(-3, 4, (11, 4)).astype(float))})
    whole = V._best_of_block(5, "item_id", "vector")(queries, index)
    monkeypatch.setattr(V, "SLICE", 7)
    sliced = V._best_of_block(5, "item_id", "vector")(queries, index)
    key = ["query_id", "item_id"]
    pd.testing.assert_frame_equal(whole.sort_values(key, ignore_index=True), sliced.sort_values(key, ignore_index=True))
