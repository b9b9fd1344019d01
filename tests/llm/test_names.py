"""Names that must tell different things apart."""
import numpy as np

from receiptflow.llm import substring_dedup as S
from receiptflow.llm import suffix_dedup as X
from receiptflow.llm import textkit as K
from receiptflow.llm import toxicity as T


def parity(n, one, other):
    return "".join(one if bin(k).count("1") % 2 else other for k in range(n))


def test_words_that_a_polynomial_confuses_have_two_names():
    for n in (512, 1024, 2048, 4096):
        raw = np.frombuffer(f"{parity(n, 'a', 'b')} {parity(n, 'b', 'a')}".encode(), np.uint8)
        for salt in (0, 7):
            a, b = K.Words(raw, np.array([0, len(raw)]), K.NOT_SPACE).names(salt)
            assert a != b


def test_such_words_are_not_removed_as_repeats(spark):
    rest = " ".join(f"word{k}" for k in range(49))
    docs = spark.createDataFrame([(k, f"{parity(1024, *x)} {rest}") for k, x in enumerate(("ab", "ba", "ab"))],
                                 "doc_id long, text string")
    out = {r["doc_id"]: r["n_removed"] for r in S.dedup_words(docs).collect()}
    assert out == {0: 0, 1: 0, 2: 50}


def test_rows_without_id_keep_their_own_spans(spark, monkeypatch):
    """One key for two texts: spans stay inside the texts."""
    monkeypatch.setattr(X.A, "row_key", lambda text: X.F.length(text).cast("long"))
    again, other = "a" * 20 + "xyz" * 164, "0123456789abcdef" * 32
    assert len(again) == len(other)
    docs = spark.createDataFrame([(1, again), (None, again), (None, other), (2, "short")], "doc_id long, text string")
    rows = X.dedup_bytes(docs, with_bytes=False).collect()
    assert all(r["n_removed"] <= r["n_bytes"] for r in rows)
    assert [r["n_removed"] for r in rows if r["doc_id"] == 2] == [0]


def test_toxicity_sample_is_the_same_in_every_run(spark, monkeypatch):
    monkeypatch.setattr(T, "SAMPLE_UNLABELLED", 5)
    rows = [(k, f"text {k % 7} bad word{k % 2}") for k in range(300)] + [(4, f"hot {k}") for k in range(300)]
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(0, 300)], "doc_id long, toxic int")
    scores = []
    for n in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        out = T.score_toxicity(docs, T.train(docs, labels)).collect()
        scores.append(sorted((r["doc_id"], r["text"], r["score"]) for r in out))
    assert scores[0] == scores[1]
