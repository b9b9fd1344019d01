"""Substring dedup by recompression.

The words of all documents are renamed in rounds.  A round first gives every
run of one symbol a new name, then every pair of neighbours whose left symbol
falls on side L and whose right symbol falls on side R of this round's split
of the names.  A new name is a hash of what it stands for, so it needs no
coordination and is the same in every task: equal strings get equal symbols,
except near their ends, where a symbol may depend on words outside.

With each symbol goes the stretch of words that fixes it (its own words, and
the neighbours that decided that it was or wasn't joined).  A window of 50
words takes as anchor the leftmost symbol of the highest round whose stretch
lies in the window; so equal windows share the anchor, and a shared high-level
symbol reveals the repeat.  Spark deals the symbols by name (anchors.py); what
has an equal region in a smaller document is settled there.  At the borders of
repeats, where the surroundings differ, each window is verified on its own by
two 64-bit names of its 50 words.

Defined results: null or empty text has no words and keeps nothing (the hash
of no bytes); rows with a null doc_id are kept whole and remove nothing from
others (null is not smaller); rows that share a doc_id don't remove each
other's words; equal rows get equal results; an empty table gives no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import anchors as A
from . import textkit as K

WINDOW = 50
ROUNDS = 9
#: Words that a symbol stands for at most.
LONGEST = 24
#: Keeps names of runs apart from other names.
RUN = np.uint64(0xD1B54A32D192ED03)
SECOND = K.Powers(0xDA942042E4DD58B5)


class Level:
    """Symbols after a round: name, words [s, e), and the words [cs, ce) that fix it."""

    def __init__(self, name, s, e, cs, ce):
        self.name, self.s, self.e, self.cs, self.ce = name, s, e, cs, ce


def runs(x: Level, words: np.ndarray, first: np.ndarray, last: np.ndarray) -> Level:
    """Join runs of one symbol.  ``first``/``last`` are the bounds of each word's document."""
    n = len(x.name)
    lo, hi = first[x.s], last[x.s]
    same = np.zeros(n, bool)
    same[1:] = (x.name[1:] == x.name[:-1]) & (x.s[1:] > lo[1:])
    head = np.flatnonzero(~same)
    size = np.diff(np.append(head, n))
    tail = head + size - 1
    s, e = x.s[head], x.e[tail]
    # a neighbour that ends (begins) with another word is another symbol
    left = np.where((s > lo[head]) & (words[s - 1] == words[x.e[head] - 1]),
                    np.minimum(x.cs[head], x.cs[head - 1]), np.minimum(x.cs[head], s - 1))
    after = np.minimum(e, len(words) - 1)
    nxt = np.minimum(tail + 1, n - 1)
    right = np.where((e < hi[head]) & (words[after] == words[x.s[tail]]),
                     np.maximum(x.ce[tail], x.ce[nxt]), np.maximum(x.ce[tail], e + 1))
    joined = (size > 1) & (e - s <= LONGEST)
    name = np.where(joined, K.mix(x.name[head] * np.uint64(5) + size.astype(np.uint64) * RUN), x.name[head])
    copies = np.where(joined, 1, size)
    at = np.repeat(head, copies) + K.ranges(np.zeros_like(copies), copies)
    one = np.repeat(joined, copies)
    return Level(np.repeat(name, copies), x.s[at], np.where(one, np.repeat(e, copies), x.e[at]),
                 np.repeat(left, copies), np.repeat(right, copies))


def pairs(x: Level, salt: int, first: np.ndarray, last: np.ndarray) -> Level:
    """Join neighbours (left on side L, right on side R)."""
    n = len(x.name)
    right_side = (K.mix(x.name + np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))) & np.uint64(1)).astype(bool)
    size = x.e - x.s
    lo, hi = first[x.s], last[x.s]
    join = np.zeros(n, bool)
    join[:-1] = ~right_side[:-1] & right_side[1:] & (size[:-1] + size[1:] <= LONGEST) & (x.e[:-1] < hi[:-1])
    taken = np.zeros(n, bool)
    taken[1:] = join[:-1]
    alone = ~join & ~taken & (size < LONGEST)
    # a symbol that stays alone depends on the neighbour that it could have joined
    cs, ce = x.cs.copy(), x.ce.copy()
    up = np.flatnonzero(alone & right_side)
    cs[up] = np.where(x.s[up] > lo[up], np.minimum(cs[up], x.cs[up - 1]), lo[up] - 1)
    down = np.flatnonzero(alone & ~right_side)
    ce[down] = np.where(x.e[down] < hi[down], np.maximum(ce[down], x.ce[np.minimum(down + 1, n - 1)]), hi[down] + 1)
    keep = np.flatnonzero(~taken)
    to = np.minimum(keep + join[keep], n - 1)
    name = np.where(join[keep], K.mix(x.name[keep] * np.uint64(3) + K.mix(x.name[to] + np.uint64(salt))), x.name[keep])
    return Level(name, x.s[keep], x.e[to], cs[keep], ce[to])


def levels(words: np.ndarray, first_of_doc: np.ndarray, rounds: int = ROUNDS) -> list[Level]:
    """The words and the symbols after each round."""
    sizes = np.diff(first_of_doc)
    first = np.repeat(first_of_doc[:-1], sizes)
    last = np.repeat(first_of_doc[1:], sizes)
    at = np.arange(len(words))
    out = [Level(words, at, at + 1, at, at + 1)]
    for k in range(1, rounds + 1):
        out.append(pairs(runs(out[-1], words, first, last), k, first, last))
    return out


def anchors(words: np.ndarray, first_of_doc: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS):
    """(name, place, first window, last window) of the regions of a chunk; window numbers
    are word positions."""
    count = np.maximum(np.diff(first_of_doc) - window + 1, 0)
    open_ = K.ranges(first_of_doc[:-1], count)
    level_of = np.zeros(len(words), np.int8)
    symbol = np.zeros(len(words), np.int64)
    found = levels(words, first_of_doc, rounds)
    for k in range(rounds, -1, -1):
        x = found[k]
        at = np.searchsorted(x.cs, open_)
        hit = at < len(x.cs)
        hit[hit] = x.ce[at[hit]] <= open_[hit] + window
        level_of[open_[hit]], symbol[open_[hit]] = k, at[hit]
        open_ = open_[~hit]
    p = K.ranges(first_of_doc[:-1], count)
    if not len(p):
        return np.zeros(0, np.uint64), p, p, p
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1] + 1) | (symbol[p[1:]] != symbol[p[:-1]]) | (level_of[p[1:]] != level_of[p[:-1]])
    start = np.flatnonzero(new)
    p0, p1 = p[start], p[np.append(start[1:], len(p)) - 1]
    name, place = np.zeros(len(p0), np.uint64), np.zeros(len(p0), np.int64)
    for k in range(rounds + 1):
        own = level_of[p0] == k
        name[own] = K.mix(found[k].name[symbol[p0[own]]] + np.uint64(k + 1))
        place[own] = found[k].s[symbol[p0[own]]]
    return name, place, p0, p1


def _columns(batch, *names):
    return [batch.column(batch.schema.names.index(x)) for x in names]


def _regions(batches, window: int):
    for batch in K.chunks(batches, "text"):
        doc, key, text = _columns(batch, "doc", "key", "text")
        raw, offsets = K.utf8(text)
        w = K.Words(raw, offsets, K.NOT_SPACE)
        words = w.names()
        name, place, p0, p1 = anchors(words, w.first, window)
        if not len(name):
            continue
        h = K.mix(K.Rolling(words).name(p0, p1 + window) + ((place - p0) * 1024 + (p1 - p0)).astype(np.uint64))
        d = np.searchsorted(w.first, p0, "right") - 1
        doc, key = doc.to_numpy()[d], key.to_numpy()[d]
        start, end = p0 - w.first[d], p1 - w.first[d]
        stay = A.fold_smaller(name, h, doc)
        kind = np.where(stay, A.SINGLE, A.DECIDED).astype(np.int8)
        yield A.batch_of(name, h, doc, key, start, np.where(stay, end, end + window), kind)


def _windows(batches, window: int):
    """Two names for every candidate window."""
    for batch in K.chunks(batches, "text"):
        doc, key, text, regions = _columns(batch, "doc", "key", "text", "regions")
        raw, offsets = K.utf8(text)
        w = K.Words(raw, offsets, K.NOT_SPACE)
        words = w.names()
        flat = regions.flatten()
        lo, hi = flat.field("p0").to_numpy(), flat.field("p1").to_numpy()
        d = np.repeat(np.arange(batch.num_rows), regions.value_lengths().to_numpy())
        at = K.ranges(lo.astype(np.int64), (hi - lo + 1).astype(np.int64))
        d = np.repeat(d, hi - lo + 1)
        p = at + w.first[d]
        one = K.Rolling(words).name(p, p + window)
        two = K.Rolling(words, SECOND).name(p, p + window, 7)
        doc, key = doc.to_numpy()[d], key.to_numpy()[d]
        stay = A.fold_smaller(one, two, doc)
        yield A.batch_of(one[stay], two[stay], doc[stay], key[stay], at[stay], at[stay],
                         np.full(stay.sum(), A.SINGLE))
        # windows that a smaller document of the chunk has too: neighbours as one span
        gone = np.flatnonzero(~stay)
        new = np.ones(len(gone), bool)
        new[1:] = (d[gone[1:]] != d[gone[:-1]]) | (at[gone[1:]] != at[gone[:-1]] + 1)
        first = gone[new]
        last = gone[np.append(np.flatnonzero(new)[1:], len(gone)) - 1] if len(gone) else gone
        yield A.batch_of(one[first], two[first], doc[first], key[first], at[first], at[last] + window,
                         np.full(len(first), A.DECIDED))


def _cut(batches, with_text: bool):
    names = ["n_words", "n_removed", "kept_sha256", "kept_text"][:4 if with_text else 3]
    for batch in K.chunks(batches, "text"):
        text, cut = _columns(batch, "text", "cut")
        raw, offsets = K.utf8(text)
        w = K.Words(raw, offsets, K.NOT_SPACE)
        n = np.diff(w.first)
        lists = cut.combine_chunks() if isinstance(cut, pa.ChunkedArray) else cut
        sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        flat = lists.flatten()
        shift = np.repeat(w.first[:-1], sizes)
        gone = K.covered(len(w), flat.field("p0").to_numpy() + shift, flat.field("p1").to_numpy() + shift)
        keep = np.flatnonzero(~gone)
        size = w.end[keep] - w.start[keep] + 1
        data = np.append(raw, np.uint8(32))[K.ranges(w.start[keep], size)]
        ends = np.cumsum(size)
        data[ends - 1] = 32
        data = data.tobytes()
        edge = np.searchsorted(keep, w.first)
        at = np.concatenate([[0], ends])[edge]
        kept = [data[a:b - 1] if b > a else b"" for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        more = [pa.array(n, pa.int64()), pa.array(n - np.diff(edge), pa.int64()),
                pa.array([K.sha256(x) for x in kept], pa.string())]
        if with_text:
            more.append(pa.array([x.decode("utf-8", "replace") for x in kept], pa.string()))
        rest = [k for k, x in enumerate(batch.schema.names) if x not in ("doc", "key", "text", "cut")]
        yield pa.RecordBatch.from_arrays([batch.column(k) for k in rest] + more,
                                         [batch.schema.names[k] for k in rest] + names)


def dedup_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
                with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (with_text) kept_text of every row."""
    rows = K.bounded(docs).select(F.col(doc_id).cast("long").alias("doc"), A.row_key(F.col(text)).alias("key"),
                       F.col(text).cast("string").alias("text"))
    known = rows.filter("doc is not null")
    regions = known.mapInArrow(lambda b: _regions(b, window), A.ROW)
    met = materialize(A.dealt(regions).mapInArrow(lambda b: A.resolve_smaller(b, window, True), A.ROW)
                      .select("doc", "key", "p0", "p1", "kind"), "regions")
    asked = met.filter(F.col("kind") != A.DECIDED).groupBy("doc", "key").agg(
        F.collect_set(F.struct("p0", "p1")).alias("regions"))
    windows = known.join(asked, ["doc", "key"]).mapInArrow(lambda b: _windows(b, window), A.ROW)
    more = materialize(A.dealt(windows).mapInArrow(lambda b: A.resolve_smaller(b, window, False), A.ROW)
                       .select("doc", "key", "p0", "p1"), "windows")
    cuts = A.spans_by_row(met.filter(F.col("kind") == A.DECIDED).select("doc", "key", "p0", "p1").unionByName(more))
    joined = rows.join(cuts, ["doc", "key"], "left").select(
        F.col("doc").alias("doc_id"), "key", "text", "cut")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (
        ", kept_text string" if with_text else "")
    return joined.mapInArrow(lambda b: _cut(b, with_text), schema)


def op1_substring_dedup(spark, sf_dir):
    return dedup_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
