"""Suffix-array dedup: column-wise construction over many documents.

A repeat is a 400-byte string that starts at two places.  Every window of 400
bytes takes an anchor inside it (the least named gram of ``GRAM`` bytes, the
leftmost if equal), so equal windows share it at the same place, and regions
(anchors.py) deal them by anchor.  Equal regions are folded into one with a
mark.  Regions that share the anchor but differ go, with their bytes, to the
construction.

There the strings of a sorted partition are laid out with their anchors in one
column and are worked on from the last column to the first.  Each round puts
one symbol in front of every string's suffix: a stable sort by that symbol
within an anchor keeps the suffixes in order (the collection's Burrows-Wheeler
order of the aligned suffixes), and the common prefixes are updated by
one plus the least common prefix between the two places before, for equal
symbols, else zero.  A window is a repeat where the common prefix with a
neighbour in the order reaches 400.  The sequential external files are Spark's
sorted shuffle files, which a task reads front to back; it holds at most
``BUCKET`` bytes of strings (and always one anchor's whole group of different
regions, copies being folded before).

Defined results: null or empty text has no bytes; documents shorter than the
window lose nothing; every row counts as a document, so equal rows of 400
bytes or more remove each other whole; null doc_ids are like any other;
an empty table gives no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import anchors as A
from . import textkit as K

WINDOW = 400
GRAM = 160
#: Bytes of strings that one construction holds.
BUCKET = 8 << 20
NO_ID = -(1 << 63)


def least_in_window(names: np.ndarray, span: int) -> np.ndarray:
    """Place of the least value (leftmost if equal) of each ``span`` neighbours."""
    n = len(names)
    bits = np.uint64(max(n, 2).bit_length())
    x = (names >> bits << bits) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // span)
    x = np.append(x, np.full(blocks * span - n, 2**64 - 1, np.uint64)).reshape(blocks, span)
    before = np.minimum.accumulate(x, 1).ravel()
    after = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(after[:n - span + 1], before[span - 1:n])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def regions(raw: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    """(name, region name, anchor, first window, last window) of a chunk's windows."""
    count = np.maximum(np.diff(offsets) - window + 1, 0)
    p = K.ranges(offsets[:-1], count)
    if not len(p):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), p, p, p
    roll = K.Rolling(K.BYTE_VALUES[raw])
    grams = roll.grams(gram)
    anchor = least_in_window(grams, window - gram + 1)[p]
    new = np.ones(len(p), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1)
    start = np.flatnonzero(new)
    p0, p1, anchor = p[start], p[np.append(start[1:], len(p)) - 1], anchor[start]
    h = K.mix(roll.name(p0, p1 + window, 3) + ((anchor - p0) * 4096 + (p1 - p0)).astype(np.uint64))
    return grams[anchor], h, anchor, p0, p1


def _regions(batches, window: int, gram: int):
    for batch in K.chunks(batches, "text"):
        doc, key, text = (batch.column(batch.schema.names.index(x)) for x in ("doc", "key", "text"))
        raw, offsets = K.utf8(text)
        name, h, anchor, p0, p1 = regions(raw, offsets, window, gram)
        if not len(name):
            continue
        d = np.searchsorted(offsets, p0, "right") - 1
        doc, key = doc.to_numpy()[d], key.to_numpy()[d]
        start, end = p0 - offsets[d], p1 - offsets[d]
        size, lead = A.fold_equal(name, h)
        several = size > 1
        # copies within the chunk are spans at once; their first row stays as a witness
        yield A.batch_of(name[several], h[several], doc[several], key[several], start[several],
                         end[several] + window, np.full(several.sum(), A.DECIDED))
        kind = np.where(several, A.SEVERAL, A.SINGLE)[lead]
        yield A.batch_of(name[lead], h[lead], doc[lead], key[lead], start[lead], end[lead], kind,
                         (anchor - p0)[lead])


def _strings(batches, window: int):
    """The bytes of the asked regions: name, doc, key, p0, left (anchor's place), kind, bytes."""
    for batch in K.chunks(batches, "text"):
        doc, key, text, asked = (batch.column(batch.schema.names.index(x)) for x in ("doc", "key", "text", "asked"))
        raw, offsets = K.utf8(text)
        flat = asked.flatten()
        d = np.repeat(np.arange(batch.num_rows), asked.value_lengths().to_numpy())
        p0 = flat.field("p0").to_numpy().astype(np.int64)
        p1 = flat.field("p1").to_numpy().astype(np.int64)
        size = p1 - p0 + window
        ends = np.cumsum(size)
        data = raw[K.ranges(p0 + offsets[d], size)]
        left = flat.field("place").to_numpy()
        yield pa.RecordBatch.from_arrays(
            [flat.field("name"), pa.array(doc.to_numpy()[d]), pa.array(key.to_numpy()[d]),
             pa.array(p0.astype(np.int32)), pa.array(left), flat.field("kind"),
             pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size),
                                              [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)),
                                               pa.py_buffer(data)]).cast(pa.binary())],
            ["name", "doc", "key", "p0", "left", "kind", "data"])


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of values[lo..hi] (inclusive) for many ranges."""
    size = hi - lo + 1
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(lo), values.dtype)
    table = values
    for k in range(int(level.max(initial=0)) + 1):
        own = np.flatnonzero(level == k)
        if len(own):
            out[own] = np.minimum(table[lo[own]], table[hi[own] - (1 << k) + 1])
        if len(table) > 1 << k:
            table = np.minimum(table[:-(1 << k)], table[1 << k:])
    return out


def repeats(group: np.ndarray, left: np.ndarray, data: np.ndarray, at: np.ndarray,
            window: int) -> tuple[np.ndarray, np.ndarray]:
    """Column-wise construction.  Strings data[at[i]:at[i + 1]] of sorted ``group``s, aligned
    at byte ``left[i]``.  Returns (string, start) of each window that another string has too."""
    n = len(group)
    size = np.diff(at)
    begin = int(left.max(initial=0)) - left           # the string's first column
    end = begin + size
    order = np.arange(n)
    common = np.zeros(n, np.int32)                     # with the string before, in this order
    head = np.concatenate([[True], group[1:] != group[:-1]])
    head_of = np.flatnonzero(head)[np.cumsum(head) - 1]
    found_s, found_p = [], []
    for col in range(int(end.max(initial=0)) - 1, -1, -1):
        inside = (begin <= col) & (col < end)
        sym = data[np.minimum(at[:-1] + np.maximum(col - begin, 0), len(data) - 1)].astype(np.int32)
        sym[~inside] = 256
        now = sym[order]
        same = np.zeros(n, bool)
        same[1:] = (now[1:] == now[:-1]) & ~head[1:]
        # groups whose strings all show one symbol keep their order
        broken = np.zeros(n, bool)
        broken[head_of[~same & ~head]] = True
        mixed = np.flatnonzero(broken[head_of])
        common[same] += 1
        if len(mixed):
            g, c = head_of[mixed], now[mixed]
            old = common[mixed] - same[mixed]          # undo, the ranges use the values before
            perm = np.argsort(g * 257 + c, kind="stable")
            gs, cs = g[perm], c[perm]
            joined = np.zeros(len(perm), bool)
            joined[1:] = (gs[1:] == gs[:-1]) & (cs[1:] == cs[:-1])
            new = np.zeros(len(perm), np.int32)
            k = np.flatnonzero(joined)
            new[k] = 1 + _range_min(old, perm[k - 1] + 1, perm[k])
            common[mixed] = new
            order[mixed] = order[mixed][perm]
            now[mixed] = cs
        common[now == 256] = 0
        long = common >= window
        if long.any():
            long[:-1] |= long[1:]
            hit = order[long]
            found_s.append(hit)
            found_p.append(np.full(len(hit), col) - begin[hit])
    if not found_s:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_s), np.concatenate(found_p)


def _construct(batches, window: int):
    """Sorted strings, whole anchors at a time -> spans."""
    held: list[pa.RecordBatch] = []
    bytes_held = 0

    def work(table: pa.Table):
        col = {x: table.column(x).combine_chunks() for x in table.schema.names}
        binary = col["data"].cast(pa.large_binary())
        at = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset:binary.offset + len(binary) + 1]
        raw = np.frombuffer(binary.buffers()[2], np.uint8)
        s, p = repeats(col["name"].to_numpy(), col["left"].to_numpy(), raw[at[0]:at[-1]], at - at[0], window)
        alone = col["kind"].to_numpy()[s] == A.SINGLE   # the others' spans are out already
        s, p = s[alone], p[alone]
        if len(s):
            order = np.lexsort((p, s))
            s, p = s[order], p[order]
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (p[1:] != p[:-1] + 1)
            start = np.flatnonzero(new)
            s0, lo, hi = s[start], p[start], p[np.append(start[1:], len(p)) - 1]
            base = col["p0"].to_numpy()[s0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(col["doc"].to_numpy()[s0]), pa.array(col["key"].to_numpy()[s0]),
                 pa.array((base + lo).astype(np.int32)), pa.array((base + hi + window).astype(np.int32))],
                ["doc", "key", "p0", "p1"])

    for batch in batches:
        held.append(batch)
        bytes_held += batch.nbytes
        if bytes_held < BUCKET:
            continue
        table = pa.Table.from_batches(held)
        name = table.column("name").to_numpy()
        cut = int(np.searchsorted(name, name[-1]))
        if cut:
            yield from work(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
            bytes_held = sum(b.nbytes for b in held) * (len(name) - cut) // max(len(name), 1)
    if held:
        yield from work(pa.Table.from_batches(held))


def _cut(batches, with_bytes: bool):
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"][:5 if with_bytes else 4]
    for batch in K.chunks(batches, "text"):
        text, cut = (batch.column(batch.schema.names.index(x)) for x in ("text", "cut"))
        raw, offsets = K.utf8(text)
        sizes = np.nan_to_num(cut.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        flat = cut.flatten()
        shift = np.repeat(offsets[:-1], sizes)
        # no span reaches into the next text, whatever the key
        end = np.repeat(offsets[1:], sizes)
        p0, p1 = (np.minimum(flat.field(x).to_numpy() + shift, end) for x in ("p0", "p1"))
        gone = K.covered(len(raw), p0, p1)
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        inner = offsets[:-1][(offsets[:-1] > 0) & (offsets[:-1] < len(raw))]
        first[inner] = gone[inner]
        count = np.concatenate([[0], np.cumsum(gone)])
        begun = np.concatenate([[0], np.cumsum(first)])
        data, at = raw[~gone].tobytes(), offsets - count[offsets]
        kept = [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        more = [pa.array(np.diff(offsets)), pa.array(np.diff(count[offsets])), pa.array(np.diff(begun[offsets])),
                pa.array([K.sha256(x) for x in kept], pa.string())]
        if with_bytes:
            more.append(pa.array(kept, pa.binary()))
        rest = batch.schema.names.index("doc_id")
        yield pa.RecordBatch.from_arrays([batch.column(rest), *more], ["doc_id", *names])


def dedup_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
                gram: int | None = None, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (with_bytes) kept_bytes of every row."""
    gram = gram or max(1, window * GRAM // WINDOW)
    own = F.col(doc_id).cast("long")
    rows = K.bounded(docs).select(own.alias("doc_id"), F.coalesce(own, F.lit(NO_ID)).alias("doc"),
                       A.row_key(F.col(text)).alias("key"), F.col(text).cast("string").alias("text"))
    texts = rows.select("doc", "key", "text")
    found = texts.mapInArrow(lambda b: _regions(b, window, gram), A.ROW)
    met = materialize(A.dealt(found).mapInArrow(lambda b: A.resolve_equal(b, window), A.ROW)
                      .select("name", "doc", "key", "p0", "p1", "kind", "place"), "regions")
    asked = met.filter(F.col("kind") != A.DECIDED).groupBy("doc", "key").agg(
        F.collect_set(F.struct("name", "p0", "p1", "kind", "place")).alias("asked"))
    strings = texts.join(asked, ["doc", "key"]).mapInArrow(
        lambda b: _strings(b, window),
        "name long, doc long, key long, p0 int, left int, kind byte, data binary")
    more = materialize(strings.repartition("name").sortWithinPartitions("name", "doc", "key", "p0").mapInArrow(
        lambda b: _construct(b, window), "doc long, key long, p0 int, p1 int"), "repeats")
    cuts = A.spans_by_row(met.filter(F.col("kind") == A.DECIDED).select("doc", "key", "p0", "p1").unionByName(more))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (
        ", kept_bytes binary" if with_bytes else "")
    return rows.join(cuts, ["doc", "key"], "left").select("doc_id", "text", "cut").mapInArrow(
        lambda b: _cut(b, with_bytes), schema)


def op7_suffix_dedup(spark, sf_dir):
    return dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_bytes=False)
