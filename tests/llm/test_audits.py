"""License scan, filter interaction audit and source divergence audit against brute force."""
import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from receiptflow.llm import divergence as V
from receiptflow.llm import filter_audit as A
from receiptflow.llm import licenses as L
from receiptflow.llm import textkit as K

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


# ---- license scan

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def licensed_by_hand(text, per_edit=L.PER_EDIT):
    """Every (notice, first word, words, edits) within the bound, and the base places."""
    words = WORD.findall((text or "").translate(LOWER))
    near = set()
    for _, notice in L.NOTICES:
        most = len(notice) // per_edit
        for a in range(len(words)):
            for b in range(a + 1, len(words) + 1):
                place = " ".join(words[a:b])
                if len(place) > len(notice) + most:
                    break
                if abs(len(place) - len(notice)) <= most and (n := distance(place, notice)) <= most:
                    near.add((notice, a, b - a, n))
    base = [(label, k) for label, phrase in L.BASE for k in range(len(words))
            if words[k:k + len(phrase.split())] == phrase.split()]
    return words, near, base


TEXTS = [
    None, "", " \t\n", "MIT License", "mit  licence!", "Released under the M1T License.", "xmit license", "mit licensed",
    "The MIT\n# License and the Apache\n * License, Version 2.0; MIT license mit license",
    "Licensed under the Apach License, Versin 2.0", "GNU Generl Publik License", "gnu genral publik licens",
    "Permission is hereby granted, free of charge, to any persn obtaining a copy off this sofware",
    "Redistribution and use in source and binary forms, with or without modfication, are permited",
    "This is free and unencumbered software released into the publik domain.", "all rights reservd",
    "Licensed under CC BY-NC 4.0.", "licensed under cc by-sa 4.1", "Ünder the MIT Licénse é", "mitlicense", "mi t license",
    "SPDX-License-Identifier: Apache-2.0", "general public", "licens", "日本語 mit license 日本語",
    "word " * 3000 + "mit license " * 50 + "word " * 3000 + "Apache Licence",
]


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [(k, t, "x", 7) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 7), (None, TEXTS[8], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, n_words int")
    return [r.asDict(recursive=True) for r in L.scan_licenses(docs).collect()]


def test_license_scan_equals_levenshtein_by_hand(scanned):
    assert len(scanned) == len(TEXTS) + 2
    by_text = {t: licensed_by_hand(t) for t in TEXTS if len(t or "") < 2000}
    for r in scanned:
        if r["text"] not in by_text:
            continue
        words, near, base = by_text[r["text"]]
        assert r["n_words"] == len(words)
        assert sorted((b["label"], b["word"]) for b in r["base"]) == sorted(base)
        assert {m["notice"] for m in r["matches"]} == {n for n, *_ in near}, r["text"]
        for m in r["matches"]:
            place = " ".join(words[m["word"]:m["word"] + m["n_words"]])
            assert distance(place, m["notice"]) <= m["edits"] <= len(m["notice"]) // L.PER_EDIT
            span = r["text"][m["start"]:m["end"]]
            assert " ".join(WORD.findall(span.translate(LOWER))) == place
        best = max([0.0, *(1 - n / len(t) for t, _, _, n in near)])
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (best > 0) and r["score"] <= best + 1e-9


def test_license_scan_long_and_repeated_places(scanned):
    long = next(r for r in scanned if r["text"] == TEXTS[-1])
    assert len(long["base"]) == 50 and long["base"][0]["word"] == 3000
    assert sum(m["notice"] == "mit license" for m in long["matches"]) == 50
    assert [m["edits"] for m in long["matches"] if m["notice"] == "apache license"] == [1]
    assert long["n_words"] == 6102
    twice = [r for r in scanned if r["text"] == "MIT License"]
    assert len(twice) == 2 and twice[0]["matches"] == twice[1]["matches"]
    assert all(r["label"] in ("x", None) for r in scanned)


def test_license_scan_of_misspelt_notices(spark):
    rng = np.random.default_rng(5)
    alphabet, rows = "abcdefghijklmnop ", []
    for k in range(150):
        notice = L.NOTICES[k % len(L.NOTICES)][1]
        for _ in range(int(rng.integers(0, len(notice) // L.PER_EDIT + 2))):
            at, c = int(rng.integers(len(notice))), alphabet[int(rng.integers(len(alphabet)))]
            notice = [notice[:at] + c + notice[at:], notice[:at] + notice[at + 1:], notice[:at] + c + notice[at + 1:]][int(rng.integers(3))]
        rows.append((k, f"some words {notice} more words"))
    out = {r["doc_id"]: r for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        assert {m["notice"] for m in out[k]["matches"]} == {n for n, *_ in licensed_by_hand(text)[1]}, text


def test_pieces_are_whole():
    for _, notice in L.NOTICES:
        for edits in range(8):
            found = L.pieces(notice, edits)
            assert len(found) == edits + 1 and "".join(p for _, p in found) == notice
            assert all(notice[a:a + len(p)] == p and p for a, p in found)


def test_license_query_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "mit license or apache license, mit licence"), (2, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in L.op11_license_scan(spark, str(tmp_path)).collect()}
    assert tuple(rows[1])[1:] == (7, 2, 0, 3, "apache,mit", "apache,mit", 1.0)
    assert tuple(rows[2])[1:] == (0, 0, None, None, "", "", 0.0)
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert L.op11_license_scan(spark, str(tmp_path)).count() == 0


# ---- filter interaction audit

def filters_by_hand(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = defaultdict(Counter)
    for d, t, part in docs:
        t, part = t or "", part or ""
        w = SPACED.findall(t)
        fails = {f for f, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            bool(re.search(r"[#$%&*|]", t)), d is not None and d > least[t])) if bad}
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                c, earlier = out[part, "".join(order), step], fails & set(order[:step - 1])
                c["kept"] += not (fails & set(order[:step]))
                c["removed"] += f in fails and not earlier
                c["redundant"] += f in fails and bool(earlier)
                c["unique_fails"] += fails == {f}
                c["good_lost"] += f in fails and not earlier and d in good
                c["toxic_lost"] += f in fails and not earlier and d in toxic
    shapley = Counter()
    for (part, order, step), c in out.items():
        shapley[part, order[step - 1]] += c["removed"]
    return {(*k, *(c[x] for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")),
             shapley[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def filter_rows():
    rng = np.random.default_rng(3)
    vocabulary = ["the", "The", "of", "a", "BIG", "ünder", "x$", "日本", "it's", "word", "\x0b", " ", "two halves"]
    vocabulary += [f"w{k}" for k in range(300)]
    docs = []
    for k in range(60):
        size = int(rng.choice([0, 1, 5, 198, 199, 200, 201, 400]))
        words = rng.choice(len(vocabulary) if k % 3 else 14, size)
        docs.append((k, " \n".join(vocabulary[i] for i in words), ["en", "de", None, ""][k % 4]))
    docs += [(100, None, "en"), (101, "", "en"), (None, "", None), (None, docs[7][1], "de"), (5, docs[7][1], "fr"),
             (5, docs[7][1], "fr"), (200, "word " * 5000, "en"), (201, "word " * 5000, "de"), (-3, "word " * 5000, "de")]
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 60, 2)] + [(3, None, None), (3, 1, 0), (None, 1, 1), (999, 1, 1)]
    return docs, labels


def test_filter_audit_equals_brute_force(spark):
    docs, labels = filter_rows()
    frame = spark.createDataFrame([(*d, k, "x") for k, d in enumerate(docs)],
                                  "doc_id long, text string, lang string, step int, words string").repartition(5)
    out = A.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                           "toxic_lost", "shapley"]
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == 600 * 4 and set(rows) == filters_by_hand(docs, labels)


def test_matrix_has_each_word_under_one_number(spark, monkeypatch):
    monkeypatch.setattr(A, "BUCKET_WORDS", 50)
    docs, _ = filter_rows()
    shards = A.document_term_matrix(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4)).collect()
    assert len({r["shard"] for r in shards}) == len(shards) > 1
    text = dict(enumerate(t or "" for _, t, _ in docs))
    digests = {hashlib.sha256(t.encode()).digest(): Counter(SPACED.findall(t)) for t in text.values()}
    rows, columns = 0, defaultdict(Counter)
    for r in shards:
        for d, row in enumerate(r["docs"]):
            own = slice(r["indptr"][d], r["indptr"][d + 1])
            words = digests[bytes(row["digest"])]
            assert sorted(r["data"][own]) == sorted(words.values())
            assert r["indices"][own] == sorted(set(r["indices"][own]))
            rows += 1
            for column, n in zip(r["indices"][own], r["data"][own]):
                columns[column][d, r["shard"]] += n
    assert rows == len(docs)
    # a column's counts over all documents are those of one word
    of_words = Counter(w for t in text.values() for w in SPACED.findall(t))
    assert sorted(sum(c.values()) for c in columns.values()) == sorted(of_words.values())


def test_filter_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert A.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# ---- source divergence audit

@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text("ab", min_size=1, max_size=20), st.text(st.characters(min_codepoint=0x80, max_codepoint=0xD7FF), min_size=1, max_size=6),
                          st.sampled_from(["a" * 64, "a" * 65, "a" * 72, "a" * 500, "a" * 499 + "b", "abcdefgh", "abcdefghi"])),
                min_size=1, max_size=60))
def test_pointers_are_sorted_with_equal_runs(terms):
    raw, offsets = np.frombuffer(" ".join(terms).encode(), np.uint8), None
    words = K.Words(raw, np.array([0, len(raw)]), K.NOT_SPACE)
    order, run = V.sort_pointers(words.raw, words.start, words.end)
    data = [t.encode() for t in terms]
    want = sorted(range(len(data)), key=lambda i: (data[i], i))
    assert order.tolist() == want
    first = {}
    for k, i in enumerate(want):
        first.setdefault(data[i], k)
    assert run.tolist() == [first[data[i]] for i in want]


def divergence_by_hand(docs, least=3, top=200):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    held, count, groups = Counter(), Counter(), set()
    for text, lang, source in docs:
        text, lang, source = (text or "").translate(LOWER), lang or "", source or ""
        groups.add((lang, source))
        found = term.findall(text)
        held.update((lang, t) for t in set(found))
        count.update((lang, source, t) for t in found)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for (g, t), n in held.items() if g == lang and n >= least]
        sources = sorted(s for g, s in groups if g == lang)
        counts = {s: {t: count[lang, s, t] for t in kept} for s in sources}
        counts[None] = {t: sum(counts[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in counts.items()}
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [(-((p[s][t] - p[None][t]) ** 2 // p[None][t]), t) for t in kept
                     if counts[s][t] and p[s][t] > p[None][t]]
            for part, rows, most in (("pair", pairs, None), ("term", terms, top)):
                rows.sort(key=lambda r: (r[0], r[1].encode()))
                out |= {(lang, s, part, x, -v, k) for k, (v, x) in enumerate(rows[:most], 1)}
    return out


def test_divergence_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    vocabulary = [f"{a}{b}{c}" for a in ("The", "of", "é", "日本") for b in "xyz" for c in ("", "ing", "a" * 90)]
    docs = []
    for k in range(120):
        size = int(rng.choice([0, 1, 3, 40]))
        words = np.minimum(rng.geometric(0.08, size), len(vocabulary)) - 1
        docs.append((" 1,".join(vocabulary[i] for i in words), ["en", "de", None][k % 3], [f"s{k % 7}", None, "hot"][min(k % 8, 2)]))
    docs += [(None, "en", "quiet"), ("", "", ""), ("only once", "xx", "a"), (None, "xx", "b"), *[("same same", "yy", "a")] * 3, ("", "yy", "b")]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs],
                                  "text string, lang string, source string, rank int, term string").repartition(6)
    for top in (200, 3):
        rows = [tuple(r) for r in V.audit(frame, top=top).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == divergence_by_hand(docs, top=top)


def test_divergence_of_many_sources(spark, monkeypatch):
    rng = np.random.default_rng(4)
    docs = [(" ".join(f"t{chr(97 + int(x))}" for x in rng.integers(0, 20, 30)), "en", f"s{k % 40}") for k in range(200)]
    monkeypatch.setattr(V, "CELLS", 64)
    sums = defaultdict(int)
    frame = spark.createDataFrame(docs, "text string, lang string, source string")
    for r in V.audit(frame).filter("part = 'pair'").collect():
        sums[r["source"], r["item"]] = r["value"]
    assert {(k[1], k[3]): k[4] for k in divergence_by_hand(docs) if k[2] == "pair"} == dict(sums)


def test_divergence_of_nothing(spark):
    assert V.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
