"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are all windows of ``WINDOW`` consecutive benchmark words; an item of
fewer words is one pattern.  Words are lower-cased runs of letters, digits and
non-ASCII characters.  For each pattern length m the scan keeps a SHIFT table
over blocks of words: the block that ends at a position says how far the
position may jump.  Documents are cut into overlapping lanes that all jump at
once (one numpy step moves every lane).  Where the shift is zero, the hash of
the last block picks a bucket of patterns, their word names are tested, and the
bytes of the window are compared with the pattern's.

The scan is one map over the documents, without a shuffle.  Patterns travel to
the tasks in blocks of at most ``PATTERN_BYTES`` benchmark bytes, a size that
is measured before; a larger benchmark is scanned block by block and the hits
are united per document row.

Defined results: null or empty text has no words and no hits; a null benchmark
text gives no pattern; a null item_id is named ``null``; equal item texts are
found together; repeated document rows each get a row; item_ids that occur more
than once count once.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

WINDOW = 10
#: Benchmark text that one scan ships to the tasks.
PATTERN_BYTES = 32 << 20
#: Words of a document that one lane walks.
LANE = 256

SCHEMA = ("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
          "hits array<struct<start:int,end:int>>, items array<string>")


class Patterns:
    """Wu-Manber tables of a block of benchmark items, one set for each length."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.items = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.items)}
        found: dict[bytes, set[int]] = {}
        sized: dict[bytes, int] = {}
        for item, text in items:
            raw = K.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            w = K.Words(raw, np.array([0, len(raw)]), K.ALNUM)
            words = [raw[s:e].tobytes() for s, e in zip(w.start, w.end)]
            m = min(window, len(words))
            for k in range(len(words) - m + 1 if m else 0):
                key = b" ".join(words[k:k + m])
                found.setdefault(key, set()).add(number[item])
                sized[key] = m
        self.tables = []
        for m in sorted(set(sized.values())):
            keys = [k for k, size in sized.items() if size == m]
            self.tables.append((m, *self._table(keys, m), keys,
                                [np.array(sorted(found[k])) for k in keys]))

    @staticmethod
    def _table(keys: list[bytes], m: int):
        raw = np.frombuffer(b" ".join(keys), np.uint8)
        w = K.Words(raw, np.array([0, len(raw)]), K.ALNUM)
        names = w.names().reshape(len(keys), m)
        block = min(2, m)
        blocks = np.stack([_blocks(names[:, k:k + block].T) for k in range(m - block + 1)], 1)
        best = {}
        for k in range(m - block + 1):
            for x in np.unique(blocks[:, k]):
                best[int(x)] = m - block - k
        known = np.array(sorted(best), np.uint64)
        shift = np.array([best[int(x)] for x in known], np.int64)
        whole = K.Rolling(names.ravel()).name(np.arange(len(keys)) * m, np.arange(1, len(keys) + 1) * m)
        order = np.argsort(whole)
        return block, known, shift, whole[order], order


def _blocks(parts: np.ndarray) -> np.ndarray:
    out = parts[0]
    for p in parts[1:]:
        out = K.mix(out * np.uint64(3) + p)
    return out


def _shift_of(known, shift, default, names):
    at = np.minimum(np.searchsorted(known, names), len(known) - 1)
    return np.where(known[at] == names, shift[at], default)


def search(words: K.Words, names: np.ndarray, compact: tuple, patterns: Patterns):
    """(first word, size, pattern table, pattern number) of every occurrence."""
    out = []
    data, at = compact
    rolling = K.Rolling(names)
    count = np.diff(words.first)
    for t, (m, block, known, shift, whole, order, keys, _) in enumerate(patterns.tables):
        blocks = _blocks(np.stack([names[k:len(names) - block + 1 + k] for k in range(block)]))
        # lanes of window ends: a window that starts in [lo, hi) belongs to the lane
        starts = np.maximum(count - m + 1, 0)
        lanes = -(-starts // LANE)
        lo = np.repeat(words.first[:-1], lanes) + (K.ranges(np.zeros_like(lanes), lanes)) * LANE
        hi = np.minimum(lo + LANE, np.repeat(words.first[:-1] + starts, lanes))
        while len(lo):
            jump = _shift_of(known, shift, m - block + 1, blocks[lo + m - block])
            here = lo[jump == 0]
            if len(here):
                name = rolling.name(here, here + m)
                k = np.minimum(np.searchsorted(whole, name), len(whole) - 1)
                for p, j in zip(here[whole[k] == name], order[k[whole[k] == name]]):
                    if data[at[p]:at[p + m] - 1] == keys[j]:
                        out.append((p, m, t, j))
            lo = lo + np.maximum(jump, 1)
            lo, hi = lo[lo < hi], hi[lo < hi]
    return np.array(out, np.int64).reshape(-1, 4)


def _compact(words: K.Words) -> tuple[bytes, np.ndarray]:
    """The words joined by one space, and where each begins there."""
    size = words.end - words.start + 1
    at = np.concatenate([[0], np.cumsum(size)])
    pick = K.ranges(words.start, size)
    data = np.append(words.raw, np.uint8(32))[np.minimum(pick, len(words.raw))]
    data[at[1:] - 1] = 32
    return data.tobytes(), at


def _scan(batches, text: str, patterns: Patterns):
    for batch in K.chunks(batches, text):
        raw, offsets = K.utf8(batch.column(batch.schema.names.index(text)))
        words = K.Words(K.LOWER[raw], offsets, K.ALNUM)
        hits = (search(words, words.names(), _compact(words), patterns)
                if patterns.tables and len(words) else np.zeros((0, 4), np.int64))
        hits = hits[np.argsort(hits[:, 0], kind="stable")]
        doc = np.searchsorted(words.first, hits[:, 0], "right") - 1
        edges = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        spans, items = [], []
        for d in range(batch.num_rows):
            own = hits[edges[d]:edges[d + 1]]
            start = own[:, 0] - words.first[d]
            spans.append(merge(start, start + own[:, 1]))
            at = {(t, j) for t, j in own[:, 2:].tolist()}
            items.append(sorted({patterns.items[i] for t, j in at for i in patterns.tables[t][-1][j]}))
        yield _rows(batch, np.diff(words.first).tolist(), spans, items)


def merge(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of spans."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(zip(start.tolist(), end.tolist())):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _rows(batch: pa.RecordBatch, n_words, spans, items) -> pa.RecordBatch:
    n_hit = [sum(e - s for s, e in x) for x in spans]
    digest = [K.sha256(",".join(x).encode()) for x in items]
    more = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
            pa.array([len(x) for x in items], pa.int64()), pa.array(digest, pa.string()),
            pa.array([n > 0 for n in n_hit], pa.bool_()),
            pa.array([[{"start": s, "end": e} for s, e in x] for x in spans],
                     pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            pa.array(items, pa.list_(pa.string()))]
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits", "items"]
    kept = [k for k, x in enumerate(batch.schema.names) if x not in names]
    return pa.RecordBatch.from_arrays([batch.column(k) for k in kept] + more,
                                      [batch.schema.names[k] for k in kept] + names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text",
                  item_id: str = "item_id", item_text: str = "text",
                  window: int = WINDOW) -> DataFrame:
    """Every row of ``docs`` with its benchmark hits (word spans, items, digest).
    Columns of ``docs`` that are named like a result column give way to it."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"),
                             F.col(item_text).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // PATTERN_BYTES) or 1
    docs, schema = K.fields(K.bounded(docs), SCHEMA)

    def scan(rows: list) -> DataFrame:
        patterns = Patterns([tuple(r) for r in rows], window)
        return docs.mapInArrow(lambda batches: _scan(batches, text, patterns), schema)

    if blocks == 1:
        return scan(items.collect())
    return _united(docs, schema, items, blocks, window, text)


def _united(docs: DataFrame, schema, items: DataFrame, blocks: int, window: int, text: str) -> DataFrame:
    """Scan after scan over the same rows: each adds its block's hits to those before."""
    out = docs
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    for k in range(blocks):
        patterns = Patterns([tuple(r) for r in items.filter(block == k).collect()], window)
        out = out.mapInArrow(lambda batches, p=patterns: _add(batches, text, p), schema)
    return out


def _add(batches, text: str, patterns: Patterns):
    for whole in batches:
        for batch in K.chunks([whole], text):
            before = {x: batch.column(batch.schema.names.index(x)).to_pylist()
                      for x in ("hits", "items") if x in batch.schema.names}
            for out in _scan([batch], text, patterns):
                spans, items = out.column("hits").to_pylist(), out.column("items").to_pylist()
                if before:
                    spans = [[*a, *b] for a, b in zip(before["hits"], spans)]
                    items = [sorted({*a, *b}) for a, b in zip(before["items"], items)]
                spans = [merge(np.array([x["start"] for x in s], np.int64),
                               np.array([x["end"] for x in s], np.int64)) for s in spans]
                yield _rows(out, out.column("n_words").to_pylist(), spans, items)


def op2_decontaminate(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate(docs.select("doc_id", "text"), items).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
