"""The two exact-repeat operators against brute force, and their parts."""
import hashlib
from collections import Counter

import numpy as np
import pytest

from receiptflow.llm import substring_dedup as S
from receiptflow.llm import suffix_dedup as B
from receiptflow.llm import textkit as K

SCHEMA = "doc_id long, text string"


def _sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def words_by_hand(docs, window):
    """(n_words, n_removed, kept hash) by id."""
    words = {d: (t or "").split() for d, t in docs}
    first = {}
    for d, w in words.items():
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), _sha(kept.encode()))
    return out


def random_docs(seed, n=60, vocabulary=4):
    """Documents with shared passages, runs of one word and near copies."""
    rng = np.random.default_rng(seed)
    passages = [[f"p{rng.integers(vocabulary * 3)}" for _ in range(rng.integers(4, 40))] for _ in range(6)]
    docs = []
    for d in range(n):
        words = []
        for _ in range(rng.integers(0, 5)):
            kind = rng.integers(4)
            if kind == 0:
                words += passages[rng.integers(len(passages))]
            elif kind == 1:
                words += ["run"] * int(rng.integers(1, 60))
            elif kind == 2:
                words += ["ab", "cd"] * int(rng.integers(1, 20))
            else:
                words += [f"w{rng.integers(vocabulary)}" for _ in range(rng.integers(1, 30))]
        docs.append((d, " ".join(words)))
        if rng.random() < 0.1 and docs:
            docs[-1] = (d, docs[int(rng.integers(len(docs)))][1])
    return docs


@pytest.mark.parametrize("seed,window", [(0, 5), (1, 12), (2, 50)])
def test_words_match_brute_force(spark, seed, window):
    docs = random_docs(seed)
    got = S.dedup_words(spark.createDataFrame(docs, SCHEMA).repartition(5), window=window).collect()
    want = words_by_hand(docs, window)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    assert all(_sha(r.kept_text.encode()) == r.kept_sha256 for r in got)


def test_equal_windows_share_their_anchor():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 4, 4000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    words[500:700] = words[100:300]
    first = np.array([0, 450, 900, 4000])
    name, place, p0, p1 = S.anchors(words, first, 20)
    anchor = {}
    for n, at, a, b in zip(name, place, p0, p1):
        for p in range(a, b + 1):
            anchor[p] = (int(n), int(at - p))
    by_window = {}
    for p, found in anchor.items():
        assert by_window.setdefault(words[p:p + 20].tobytes(), found) == found
        assert 0 <= found[1] < 20


def test_symbols_stand_for_their_words():
    rng = np.random.default_rng(4)
    words = K.mix(rng.integers(7, 10, 3000).astype(np.uint64))
    for level in S.levels(words, np.array([0, 1000, 3000])):
        assert level.s[0] == 0 and level.e[-1] == 3000 and (level.s[1:] == level.e[:-1]).all()
        said = {}
        for n, s, e in zip(level.name, level.s, level.e):
            assert said.setdefault(int(n), words[s:e].tobytes()) == words[s:e].tobytes()


def bytes_by_hand(docs, window):
    data = [(d, (t or "").encode()) for d, t in docs]
    count = Counter(b[p:p + window] for _, b in data for p in range(len(b) - window + 1))
    out = {}
    for d, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            if count[b[p:p + window]] > 1:
                gone[p:p + window] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out[d] = (len(b), int(gone.sum()), spans, _sha(np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("seed,window", [(0, 10), (1, 40), (2, 400)])
def test_bytes_match_brute_force(spark, seed, window):
    docs = random_docs(seed + 10) + [(1000, "é" * 600), (1001, "x" * 900), (1002, None), (1003, "")]
    got = B.dedup_bytes(spark.createDataFrame(docs, SCHEMA).repartition(5), window=window).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == bytes_by_hand(docs, window)


@pytest.mark.parametrize("seed", range(5))
def test_columnwise_construction(seed):
    rng = np.random.default_rng(seed)
    for _ in range(40):
        window, n = 5, int(rng.integers(1, 12))
        group, left = np.sort(rng.integers(0, 3, n)), rng.integers(0, 4, n)
        size = left + rng.integers(3, 9, n)
        texts = [bytes(rng.integers(97, 99, k).astype(np.uint8)) for k in size]
        at = np.concatenate([[0], np.cumsum(size)])
        s, p = B.repeats(group, left, np.frombuffer(b"".join(texts), np.uint8), at, window)
        want = set()
        for i in range(n):
            for q in range(len(texts[i]) - window + 1):
                for j in range(n):
                    r = q - left[i] + left[j]
                    if j != i and group[i] == group[j] and 0 <= r <= len(texts[j]) - window \
                            and texts[i][q:q + window] == texts[j][r:r + window]:
                        want.add((i, q))
        assert set(zip(s.tolist(), p.tolist())) == want


def test_edge_rows(spark):
    long = " ".join(f"t{i}" for i in range(120))
    rows = [(1, long, "x", 1), (1, long, "y", 2), (2, long, "z", 3), (3, None, None, None), (4, "", "", 0),
            (None, long, "q", 5), (5, " \t ", "k", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, kind int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in S.dedup_words(docs).collect())
    # rows of one id and rows without an id keep their words; document 2 loses them to document 1
    assert got == [(False, 1, 120, 0), (False, 1, 120, 0), (False, 2, 120, 120), (False, 3, 0, 0),
                   (False, 4, 0, 0), (False, 5, 0, 0), (True, 0, 120, 0)]
    n = len(long)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in B.dedup_bytes(docs).collect())
    assert got == [(False, 1, n, n), (False, 1, n, n), (False, 2, n, n), (False, 3, 0, 0), (False, 4, 0, 0),
                   (False, 5, 3, 0), (True, 0, n, n)]
    empty = docs.limit(0)
    assert S.dedup_words(empty).count() == B.dedup_bytes(empty).count() == 0


def test_words_of_a_chunk_stay_in_their_text():
    texts = ["ab cd", "", "  e\tf\x0bg ", None, "h", "ié j"]
    import pyarrow as pa
    raw, offsets = K.utf8(pa.array(texts, pa.string()))
    w = K.Words(raw, offsets, K.NOT_SPACE)
    got = [[raw[s:e].tobytes().decode() for s, e in zip(w.start[a:b], w.end[a:b])]
           for a, b in zip(w.first, w.first[1:])]
    assert got == [(t or "").split() for t in texts]
