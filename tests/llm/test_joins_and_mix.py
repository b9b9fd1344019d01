"""Decontamination, Jaccard join, vector dedup, mixing, WARC records and the pipeline."""
import gzip
import itertools
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from receiptflow.llm import decontaminate as D
from receiptflow.llm import graph as G
from receiptflow.llm import jaccard_join as J
from receiptflow.llm import mixing as M
from receiptflow.llm import vector_dedup as V
from receiptflow.llm import warc as W

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text):
    return WORD.findall((text or "").translate(LOWER))


def leaks_by_hand(docs, items, window=10):
    patterns = {}
    for i, t in items:
        w = _words(t)
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            patterns.setdefault(tuple(w[k:k + m]), set()).add(str(i))
    sizes = {len(p) for p in patterns}
    out = []
    for d, t in docs:
        w, hit, found = _words(t), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if who := patterns.get(tuple(w[k:k + m])):
                    hit.update(range(k, k + m))
                    found |= who
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,bound", [(0, 1 << 20), (1, 1 << 20), (2, 400)])
def test_leaks_match_brute_force(spark, monkeypatch, seed, bound):
    monkeypatch.setattr(D, "PATTERN_BYTES", bound)
    rng = np.random.default_rng(seed)
    word = lambda: rng.choice(["aa", "Bb", "é", "d4", "ee"])
    items = [(i, " ".join(word() for _ in range(rng.integers(0, 25)))) for i in range(12)] + [(50, None), (50, "aa, Bb")]
    docs = []
    for d in range(40):
        text = " ".join(word() for _ in range(rng.integers(0, 300)))
        if d % 3 == 0:
            text += "! " + (items[int(rng.integers(12))][1]).upper() + " ?"
        docs.append((d, text))
    docs += [(100, None), (101, ""), (102, "!!!"), (1, docs[1][1])]
    got = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string").withColumn("hits", F.lit(1)),
                          spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=str) == leaks_by_hand(docs, items)
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in got)


def test_leaks_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert D.decontaminate(docs.limit(0), items).count() == 0
    assert [r.n_hit for r in D.decontaminate(docs, items.limit(0)).collect()] == [0]
    assert [r.n_hit for r in D.decontaminate(docs, items).collect()] == [2]


def groups_by_hand(docs, size, percent):
    sets = {}
    for d, t in docs:
        w = (t or "").translate(LOWER).split()
        sets[d] = {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    holders = {}
    for d in sorted(sets):
        for x in sets[d]:
            holders.setdefault(x, []).append(d)
    common = Counter(pair for ds in holders.values() for pair in itertools.combinations(ds, 2))
    for (a, b), k in common.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("seed,size,percent", [(0, 4, 85), (1, 5, 80), (2, 4, 85), (3, 2, 60)])
def test_groups_match_brute_force(spark, seed, size, percent):
    rng = np.random.default_rng(seed)
    docs, passage = [], [f"p{k}" for k in range(60)]
    for d in range(150):
        kind = rng.integers(4)
        if kind == 0 and docs:
            w = docs[int(rng.integers(len(docs)))][1].split()
            for _ in range(rng.integers(0, 4)):
                if w:
                    w[int(rng.integers(len(w)))] = f"e{rng.integers(99)}"
        elif kind == 1:
            w = passage + [f"w{rng.integers(500)}" for _ in range(rng.integers(0, 30))]
        else:
            w = [f"w{rng.integers(500)}" for _ in range(rng.integers(0, 90))]
        docs.append((d, " ".join(w)))
    got = J.jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
                           size=size, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == groups_by_hand(docs, size, percent)


def test_pivots_and_windows_find_every_link():
    rng = np.random.default_rng(7)
    for _ in range(60):
        base = [rng.choice(400, 40, replace=False).astype(np.uint64) for _ in range(3)]
        sets = []
        for _ in range(int(rng.integers(1, 25))):
            x = set(base[int(rng.integers(3))].tolist())
            for _ in range(rng.integers(0, 6)):
                x.discard(int(rng.choice(sorted(x))))
                x.add(int(rng.integers(400, 500)))
            sets.append(np.array(sorted(x), np.uint64))
        docs = [(k, " ".join(map(str, s))) for k, s in enumerate(sets)]
        want = groups_by_hand(docs, 1, 85)
        assert [want[k][1] for k in range(len(sets))] == J.link(sets, 85).tolist()


def test_group_edges(spark):
    rows = [(1, "a b c d e", 1), (2, "A B C D E", 2), (3, None, 3), (4, "", 4), (None, "a b c d e", 5), (5, "a b", 6),
            (6, "a b", 7), (1, "a b c d e", 8), (None, "only here you see it", 9)]
    got = J.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string, component_id int")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(
        [(1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (None, 2, 1), (5, 1, 5), (6, 1, 5), (1, 2, 1), (None, 2, None)], key=str)
    assert J.jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_groups_go_by_class_not_by_id(spark):
    base = [f"a{k}" for k in range(40)]
    one, mid, nine = base, ["x0", "x1"] + base[2:], ["x0", "x1", "x2", "x3"] + base[4:]   # 1 - null - 9, not 1 - 9
    alone = [f"n{k}" for k in range(40)]
    other = [f"b{k}" for k in range(40)]
    rows = [(1, one), (None, mid), (9, nine), (None, alone), (None, ["y"] + alone[1:]), (3, other),
            (5, ["z"] + other[1:]), (5, [f"c{k}" for k in range(40)])]
    rows = [(d, " ".join(w)) for d, w in rows]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = J.jaccard_groups(table, size=1).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(
        [(1, 1), (None, 1), (9, 1), (None, None), (None, None), (3, 3), (5, 3), (5, 5)], key=str)
    assert len({r.group_key for r in got}) == 4


def test_pipeline_keeps_one_row_of_a_group(spark):
    def words(x, last):
        return " ".join([f"{x}{k}" for k in range(99)] + [last])
    rows = [(None, words("n", "p")), (None, words("n", "q")), (None, words("n", "q")), (5, words("a", "p")),
            (3, words("a", "q")), (5, words("b", "p")), (7, words("d", "p")), (7, words("d", "q")),
            (None, words("b", "q")), (None, words("e", "p"))]
    kept = C.jaccard_groups(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(((r.doc_id, r.text[0]) for r in kept), key=str) == sorted(
        [(None, "n"), (3, "a"), (5, "b"), (7, "d"), (None, "e")], key=str)


def test_pipeline_keeps_letters_without_languages(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 34", None), (3, None, None), (4, "", None),
                                  (5, "\u00e9t\u00e9", None), (None, "a\nb", None)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in C.language_id(spark, docs, "").collect()} == {1, 5, None}


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 60), (7, 7), (None, 3)]
    got = {r.node: r.component for r in G.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 50, 50: 50, 60: 50}
    assert G.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(V, "SHARD", 150)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 16))
    for k in range(0, 300, 3):
        x[k + 1] = x[k] + rng.normal(size=16) * 0.08
    x[600:640] = x[0] + rng.normal(size=(40, 16)) * 0.05
    x[650:660] = x[5]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] + [1.0] * 15, 1),
             (904, [1.0], 1), (905, [], 1), (906, [float("inf")] * 16, 1)]
    got = V.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    links = near.sum(1) - 1
    assert sum(r.n_links for r in got) >= 0.97 * links.sum()
    by = {r.vec_id: r for r in got}
    assert len(got) == len(rows) and all(by[i].n_links <= links[i] for i in range(700))
    assert all(by[i].n_links == 0 and by[i].component_id == i and by[i].kept for i in range(900, 907))
    assert by[655].component_id == by[5].component_id
    assert by[0].recall >= 0.97
    assert V.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_group_of_many_shards_has_all_links(spark, monkeypatch):
    monkeypatch.setattr(V, "SHARD", 40)
    rng = np.random.default_rng(18)
    x = rng.normal(size=(1500, 16))
    x[:1200] = x[0] + rng.normal(size=(1200, 16)) * 0.06 * np.linalg.norm(x[0]) / 4
    for k in range(1300, 1400, 2):
        x[k + 1] = x[k] + rng.normal(size=16) * 0.05
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    assert near[:1200, :1200].mean() > 0.99
    got = V.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)],
                                               "vec_id long, embedding array<double>")).collect()
    by = {r.vec_id: r for r in got}
    assert [by[i].n_links for i in range(1500)] == (near.sum(1) - 1).tolist()
    assert all(by[i].component_id == 0 for i in range(1200))


def test_audit_is_per_vector_and_needs_evidence(spark, monkeypatch):
    rng = np.random.default_rng(19)
    x = rng.normal(size=(900, 16))
    x[:400] = x[0] + rng.normal(size=(400, 16)) * 0.05
    for k in range(400, 700, 2):
        x[k + 1] = x[k] + rng.normal(size=16) * 0.05
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    with monkeypatch.context() as m:   # the pairs are missed, the group is found
        m.setattr(V, "_forest", lambda *a: spark.createDataFrame([(0, i) for i in range(1, 400)], "a long, b long"))
        with pytest.raises(RuntimeError):
            V.near_vectors(table)
    lonely = table.filter("vec_id >= 700")
    assert {r.recall for r in V.near_vectors(lonely).collect()} == {1.0}    # all were audited
    monkeypatch.setattr(V, "AUDIT", 5)
    monkeypatch.setattr(V, "AUDIT_MOST", 20, raising=False)
    assert {r.recall for r in V.near_vectors(lonely).collect()} == {None}


def _water_level(sizes, weights, cap):
    """Targets by resharing the excess until none is above."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while True:
        w = sum(weights[k] for k in open_)
        over = {k for k in open_ if left * weights[k] / w > cap * sizes[k] + 1e-9}
        if not over:
            for k in open_:
                target[k] = left * weights[k] / w
            return target
        for k in over:
            target[k] = cap * sizes[k]
            left -= target[k]
        open_ -= over


def test_bits_of_classes(spark):
    from receiptflow.llm import jaccard_join as J

    names = np.array([0, 1, 7, 8, 32767, 32768, (1 << 26) - 1, 1 << 26, -1, -(1 << 40) + 5], np.int64)
    bits = J.member_bits(spark.createDataFrame([(int(c),) for c in names], "c long"))
    place = names & ((1 << 26) - 1)
    want = np.zeros(1 << 26, np.uint8)
    want[place] = 1
    assert np.array_equal(np.unpackbits(bits, bitorder="little"), want)
    assert J.member_bits(spark.createDataFrame([], "c long")).sum() == 0


def test_mix(spark):
    rng = np.random.default_rng(9)
    source = ["a", "b", "c", "d", None, "é"]
    share = [0.4, 0.3, 0.01, 0.1, 0.15, 0.04]
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), source[int(rng.choice(6, p=share))], 1, 2)
            for i in range(3000)] + [(1, None, "a", 1, 2), (None, "x y", "b", 1, 2)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, key int")
    got = M.mix_sources(docs).collect()
    assert len(got) == len(rows)
    order = sorted([s for s in source if s]) + [None]
    sizes = [sum(r.size for r in got if r.source == s) for s in order]
    want = dict(zip(order, _water_level(sizes, [1, 2, 3, 1, 2, 3], 3)))
    for s in order:
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[order.index(s)] for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 60
    assert all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in got)
    again = M.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert M.mix_sources(docs.limit(0)).count() == 0


def test_mix_with_one_document_longer_than_the_rest(spark):
    rng = np.random.default_rng(10)
    rows = [(i, "w " * int(rng.integers(20, 60)), "abc"[i % 3]) for i in range(240)]
    rows += [(900 + i, "w " * n, "abc"[i]) for i, n in enumerate((4_000, 2_500, 6_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.mix_sources(docs).collect()
    assert all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in got) and len(got) == len(rows)
    for s in "abc":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= min(r.size for r in own) / 2


def test_mix_keeps_expected_copies(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "a" if i < 700 else "b") for i in range(1400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = np.zeros(1400)
    for seed in range(6):
        for r in M.mix_sources(docs, seed=seed).collect():
            copies[r.doc_id] += r.copies / 6
    assert abs(copies[:700].mean() - 2 / 3) < 0.04 and abs(copies[700:].mean() - 4 / 3) < 0.04


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([
        (1, "http://a.example/x", "<html><title>T &amp; x</title><script>if (a<b) {}</script><p>One<br>two &lt;3 é</p>"
         "<a href='/y'>go</a></html>", "r"), (2, None, None, "r"), (None, "http://b/\r\nX: y", "", "r"),
        (1, "http://a.example/x", "<p>open <!-- never closed", "r")], "page_id long, url string, html string, record string")
    rows = W.responses(pages)
    records = rows.transform(W.response_records).select("record").union(W.derive(rows).select("record"))
    W.write_warc(records, str(tmp_path / "out"))
    found = {}
    for p in Path(tmp_path / "out").glob("*.gz"):
        data = gzip.decompress(p.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
            assert lines[0] == "WARC/1.1"
            n = int(fields["Content-Length"])
            fields["block"] = rest[:n]
            assert rest[n:n + 4] == b"\r\n\r\n"
            data = rest[n + 4:]
            found[fields["WARC-Record-ID"]] = fields
    kinds = [f["WARC-Type"] for f in found.values()]
    assert sorted(map(kinds.count, ("response", "metadata", "conversion"))) == [4, 4, 4]
    import hashlib
    for f in found.values():
        assert f["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(f["block"]).hexdigest()
        if f["WARC-Type"] == "response":
            assert f["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(f["block"].split(b"\r\n\r\n", 1)[1]).hexdigest()
            continue
        source = found[f["WARC-Refers-To"]]
        other = found[f["WARC-Concurrent-To"]]
        assert source["WARC-Type"] == "response" and other["WARC-Refers-To"] == f["WARC-Refers-To"]
        assert f["WARC-Target-URI"] == source["WARC-Target-URI"]
        if f["WARC-Type"] == "metadata":
            said = dict(x.split(": ", 1) for x in f["block"].decode().splitlines() if ": " in x)
            assert said["source-payload-digest"] == source["WARC-Payload-Digest"]
            assert said["conversion-id"] == other["WARC-Record-ID"]
            assert said["conversion-digest"] == other["WARC-Block-Digest"]
    texts = {f["block"].decode() for f in found.values() if f["WARC-Type"] == "conversion"}
    assert "One\ntwo <3 é\ngo" in texts and "open" in texts
    assert W.derive(W.responses(pages.limit(0))).count() == 0


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(90_001, None, "en", "src0", 0), (90_002, "12 34", "en", "src0", 5),
                                   (90_003, "", "en", "src0", 0)], docs.schema)
    docs = docs.unionByName(extra).withColumn("row", F.lit(1)).withColumn("key", F.lit("k"))
    names = [name for name, _ in C.STAGES]
    assert names == ["language_id", "jaccard_groups", "decontaminate", "secret_scan", "mix_sources"]
    stage = dict(C.STAGES)

    def step(name, rows):
        from receiptflow.session import materialize
        return materialize(stage[name](spark, rows, sf), name)

    kept = step("language_id", docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in kept.collect()} == {90_001, 90_002, 90_003}
    one = step("jaccard_groups", kept)
    want = groups_by_hand([(r.doc_id, r.text) for r in kept.collect()], 5, 80)
    assert one.columns == docs.columns
    assert sorted(r.doc_id for r in one.collect()) == sorted(d for d, (_, c) in want.items() if c == d)
    clean = step("decontaminate", one)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {d for d, _, n, _ in leaks_by_hand([(r.doc_id, r.text) for r in one.collect()], items) if n}
    assert {r.doc_id for r in one.collect()} - {r.doc_id for r in clean.collect()} == hit
    safe = step("secret_scan", clean)
    assert safe.columns == docs.columns and safe.count() == clean.count()
    from test_text_models import by_hand
    assert all(by_hand(r.text) == [] and r.n_chars == len(r.text) for r in safe.collect())
    before = {r.doc_id: r.text for r in clean.collect()}
    assert all(r.text == before[r.doc_id] for r in safe.collect() if not by_hand(before[r.doc_id])
               and "[SECRET]" not in r.text)
    mix = step("mix_sources", safe)
    assert mix.count() == safe.count()
    assert all(r.taken <= 3 * r.size for r in mix.collect())
    empty = docs.limit(0)
    for name in names:
        empty2 = step(name, empty)
        assert empty2.count() == 0
