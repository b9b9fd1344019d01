"""Anchored regions: how the two exact-repeat operators meet equal windows.

A window (fixed-length stretch of a document) is assigned an anchor inside it
by a rule that reads nothing but the window, so equal windows have equal
anchors at equal places.  Neighbouring windows with one anchor form a region;
a region is one row (anchor name, region name, document, key, first and last
window).  Rows are dealt by anchor name and sorted; one pass over a sorted
partition then decides every region that has equal copies, and passes on as
candidates only the regions whose anchor also occurs in another surrounding.

Only a constant state is carried from batch to batch, so a very common anchor
is a long stream, not a group in memory; copies inside a chunk of documents
are already folded before the shuffle.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "name long, h long, doc long, key long, p0 int, p1 int, kind byte, place int"
FIELDS = ["name", "h", "doc", "key", "p0", "p1", "kind", "place"]
#: Values of ``kind``: a span already decided, a region, a region that stands for several.
DECIDED, SINGLE, SEVERAL = 0, 1, 2


def row_key(text: Column) -> Column:
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def batch_of(name, h, doc, key, p0, p1, kind, place=None) -> pa.RecordBatch:
    """Rows; ``place`` is the anchor's distance from p0 where it is of use."""
    place = np.zeros(len(name)) if place is None else place
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(name).view(np.int64)), pa.array(np.asarray(h).view(np.int64)),
         pa.array(np.asarray(doc, np.int64)), pa.array(np.asarray(key, np.int64)),
         pa.array(np.asarray(p0, np.int32)), pa.array(np.asarray(p1, np.int32)),
         pa.array(np.asarray(kind, np.int8)),
         pa.array(np.asarray(place, np.int32))], FIELDS)


def columns_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(FIELDS))]


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of one name together, sorted by name, region and document; spans that are
    decided already go anywhere."""
    to = F.when(F.col("kind") == DECIDED, F.xxhash64("doc", "p0")).otherwise(F.col("name"))
    return rows.repartition(to).sortWithinPartitions("name", "h", "doc", "key", "p0")


def fold_smaller(name, h, doc):
    """Within a chunk: which rows stay, namely those of the smallest document of each
    (name, h).  The others have an equal region in a smaller document."""
    order = np.lexsort((doc, h, name))
    n, g, d = name[order], h[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = (n[1:] != n[:-1]) | (g[1:] != g[:-1])
    least = d[new][np.cumsum(new) - 1] if len(order) else d
    stay = np.empty(len(order), bool)
    stay[order] = d == least
    return stay


def resolve_smaller(batches, window: int, candidates: bool):
    """Sorted rows -> spans [p0, p1) that have an equal region in a smaller document
    (kind DECIDED) and, if asked for, the regions of the smallest document of each
    class whose anchor also occurs in other documents (kind SINGLE, p1 inclusive)."""
    last = None       # (name, h) of the row before
    least = first = 0  # smallest document of that class; of the first class of that name
    mixed = False     # the name has classes with different smallest documents
    waiting: list[np.ndarray] | None = None
    for batch in batches:
        cols = columns_of(batch)
        done = cols[6] == DECIDED
        if done.any():
            yield _spans([c[done] for c in cols], 0)
            cols = [c[~done] for c in cols]
        name, h, doc = cols[:3]
        if not len(name):
            continue
        new_name = np.ones(len(name), bool)
        new_name[1:] = name[1:] != name[:-1]
        new_name[0] = last is None or name[0] != last[0]
        new = new_name.copy()
        new[1:] |= h[1:] != h[:-1]
        new[0] |= last is None or h[0] != last[1]
        least_of = np.concatenate([[least], doc[new]])[np.cumsum(new)]
        group = np.cumsum(new_name)
        first_of = np.concatenate([[first], doc[new_name]])
        other = np.bincount(group, least_of != first_of[group], int(group[-1]) + 1) > 0
        other[0] |= mixed
        if (over := doc > least_of).any():
            yield _spans([c[over] for c in cols], window)
        if candidates:
            own = ~over
            if waiting is not None and other[0]:
                yield _candidates(waiting)
            if other[0] or group[-1] > 0:
                waiting = None
            if (out := own & other[group]).any():
                yield _candidates([c[out] for c in cols])
            if not other[-1]:
                hold = [c[own & (group == group[-1])] for c in cols]
                waiting = hold if waiting is None else [np.concatenate(x) for x in zip(waiting, hold)]
        last, least, first, mixed = (name[-1], h[-1]), least_of[-1], first_of[group[-1]], bool(other[-1])


def _spans(cols, window: int) -> pa.RecordBatch:
    """Removed spans; regions of ``window`` long windows become half-open spans."""
    return batch_of(*cols[:5], cols[5] + window, np.zeros(len(cols[0]), np.int8))


def _candidates(cols) -> pa.RecordBatch:
    return batch_of(*cols[:6], np.maximum(cols[6], SINGLE), cols[7])


def fold_equal(name, h):
    """Within a chunk: (number of equal rows, is it the first of them) by row."""
    order = np.lexsort((h, name))
    n, g = name[order], h[order]
    new = np.ones(len(order), bool)
    new[1:] = (n[1:] != n[:-1]) | (g[1:] != g[:-1])
    size = np.empty(len(order), np.int64)
    lead = np.empty(len(order), bool)
    size[order] = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] if len(order) else 0
    lead[order] = new
    return size, lead


def resolve_equal(batches, window: int):
    """Sorted rows -> spans of regions that occur more than once (DECIDED) and one
    region of each class whose anchor has other classes too (SINGLE or SEVERAL)."""
    held = None     # the last class so far: one row, with kind SEVERAL if its spans are out
    mixed = False   # its name had a class before

    def settle(cols, mixed, final):
        """Split rows into spans, candidates and the class to hold."""
        name, h, kind = cols[0], cols[1], cols[6]
        new_name = np.concatenate([[True], name[1:] != name[:-1]])
        new = new_name | np.concatenate([[True], h[1:] != h[:-1]])
        cls, grp = np.cumsum(new) - 1, np.cumsum(new_name) - 1
        several = (np.bincount(cls) > 1) | (np.bincount(cls, kind == SEVERAL) > 0)
        classes = np.bincount(grp[new])
        if mixed:
            classes[0] += 1
        out = several[cls] & (kind == SINGLE)
        spans = [c[out] for c in cols]
        heads = np.flatnonzero(new)
        head = [c[heads] for c in cols]
        head[6] = np.where(several, SEVERAL, SINGLE).astype(np.int8)
        pick = classes[grp[heads]] > 1
        if not final:
            pick[-1] = False
        cands = [c[pick] for c in head]
        rest = None if final else [c[-1:] for c in head]
        return spans, cands, rest, bool(classes[-1] > 1)

    for batch in batches:
        cols = columns_of(batch)
        done = cols[6] == DECIDED
        if done.any():
            yield _spans([c[done] for c in cols], 0)
            cols = [c[~done] for c in cols]
        if not len(cols[0]):
            continue
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        spans, cands, held, mixed = settle(cols, mixed, False)
        if len(spans[0]):
            yield _spans(spans, window)
        if len(cands[0]):
            yield _candidates(cands)
    if held is not None:
        spans, cands, _, _ = settle(held, mixed, True)
        if len(spans[0]):
            yield _spans(spans, window)
        if len(cands[0]):
            yield _candidates(cands)


def spans_by_row(spans: DataFrame) -> DataFrame:
    """doc, key -> array of removed spans [p0, p1)."""
    return spans.groupBy("doc", "key").agg(
        F.collect_set(F.struct("p0", "p1")).alias("cut"))
