"""N-gram Jaccard join in metric space: exact links and their components.

Jaccard distance is a metric, but texts that aren't copies of each other all
lie about 1 apart, where windows around pivots hold everything.  So regions
are made in two steps, both exact.

1. Regions of close documents.  Sets of one size class are cut into m parts by
   hash.  Two sets within the threshold differ in at most h elements, so with
   m > h some part is equal in both; parts that are empty or hold nothing but
   very common shingles may be left out as long as h + 1 others remain, else
   all of a set's parts are used (if either set has h + 1 others, one of them
   is equal in both).  Equal parts are dealt by their name; each sends its sets
   to the region of the least one among them, so two sets with an equal part
   meet in a region, and regions don't grow along chains.  Which shingles count
   as common is taken from a bounded sample and has no influence on the result.
2. Pivots inside a region.  The first document without a pivot becomes one;
   distances of the region's documents that share a shingle with it are computed
   (through an inverted index, the others are 1 apart).  Its cell are
   the documents within t (nearest pivot first), all linked to it, hence one
   component; its window are those within 2t, which by the triangle inequality
   holds every link that leaves the cell.  Only window documents of another
   component are compared, and only with the cell's documents whose distance
   to the pivot differs by at most t; the cells so join until their components
   don't change.  The links of all regions make the components.

Equal sets are one class before anything is dealt; copies never meet in pairs.
Classes are placed, linked and connected by their own name, whatever rows hold
them; a component's id is the least doc_id of its classes.

Defined results: null or empty texts (no words) have an empty set and link
with nothing; with fewer words than the shingle, the whole sequence is one
shingle; a null doc_id links like any other but is no component id unless the
whole component is null; different texts under one doc_id link each for
itself; repeated rows are copies; an empty table gives no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import textkit as K
from .graph import components

SHINGLE = 4
PERCENT = 85
#: Bound of the sample that tells common shingles.
SAMPLE_DOCS = 4_096
#: A shingle is common if so many documents of the sample hold it.
COMMON = 6
BUCKET_BITS = 22
#: Bits (as a power of 2) of the table of classes that are in a region: 8 MB whatever the input.
MEMBER_BITS = 26


class Sets:
    """Distinct shingles of a chunk's documents, sorted by document and name."""

    def __init__(self, text: pa.Array, size: int):
        raw, offsets = K.utf8(text)
        w = K.Words(K.LOWER[raw], offsets, K.NOT_SPACE)
        names = w.names()
        roll = K.Rolling(names)
        count = np.diff(w.first)
        n = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
        start = K.ranges(w.first[:-1], n)
        doc = np.repeat(np.arange(len(n)), n)
        h = roll.name(start, np.minimum(start + size, w.first[doc + 1]))
        order = np.argsort(h)
        by_doc = doc[order]
        order = order[np.argsort(by_doc.astype(np.uint16) if len(n) < 65536 else by_doc, kind="stable")]
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.h, self.doc = h[new], doc[new]
        self.first = np.searchsorted(self.doc, np.arange(len(n) + 1))
        self.n = np.diff(self.first)
        self.roll = K.Rolling(self.h)
        #: One name for the whole set.
        self.name = self.roll.name(self.first[:-1], self.first[1:], 11)


def row_key(text: Column) -> Column:
    """Tells rows of one doc_id (or of none) apart by their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def differ(x, y, percent: int):
    """Elements that sets of sizes x and y within the threshold may differ in."""
    return (100 - percent) * (x + y) // (100 + percent)


def n_parts(k, percent: int):
    """Parts of size class k (sizes up to 2 ** (k + 1) - 1)."""
    top = (1 << (k + 1)) - 1
    return (differ(top, top, percent) + 1) * 9 // 8 + 1


def signatures(sets: Sets, pick: np.ndarray, common: np.ndarray, percent: int):
    """(signature, document) rows of the documents ``pick`` (mask)."""
    n = sets.n
    own = np.log2(np.maximum(n, 1)).astype(np.int64)
    own += (1 << (own + 1)) <= n
    own -= (1 << own) > np.maximum(n, 1)
    out = []
    rare = ~common[(sets.h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
    for step in (0, 1):
        k = own + step
        top = (np.int64(1) << (k + 1)) - 1
        reach = n * 100 // percent
        use = pick & (n > 0) & ((reach > (np.int64(1) << k) - 1) if step else True)
        if not use.any():
            continue
        m = n_parts(k, percent)
        at = np.flatnonzero(use[sets.doc])
        doc = sets.doc[at]
        part = ((sets.h[at] >> np.uint64(32)) * m[doc].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])
        head = np.flatnonzero(new)
        end = np.append(head[1:], len(at))
        d, p = doc[head], part[head]
        good = np.logical_or.reduceat(rare[at], head)
        enough = np.bincount(d, good, len(n)) > differ(n, np.minimum(reach, top), percent)
        name = sets.roll.name(at[head], at[end - 1] + 1)
        send = good | ~enough[d]
        salt = (k[d] * 1_000_003 + p).astype(np.uint64)
        out.append((K.mix(name[send] + K.mix(salt[send])), d[send]))
        for x in np.flatnonzero(use & ~enough).tolist():   # empty parts count as equal too
            blank = np.setdiff1d(np.arange(m[x]), p[d == x])
            salt = (np.int64(k[x]) * 1_000_003 + blank).astype(np.uint64)
            out.append((K.mix(K.mix(salt) + np.uint64(77)), np.full(len(blank), x)))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _classes(batches, size: int):
    for batch in K.chunks(batches, "text"):
        sets = Sets(batch.column(2), size)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets.n), K.signed(sets.name)],
                                         ["doc", "key", "n", "c"])


def _sample(batches, size: int):
    for batch in K.chunks(batches, "text"):
        sets = Sets(batch.column(0), size)
        b = (sets.h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        key = np.unique((sets.doc << BUCKET_BITS) | b) & ((1 << BUCKET_BITS) - 1)
        bucket, n = np.unique(key, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(n)], ["bucket", "n"])


def _signatures(batches, size: int, common: np.ndarray, percent: int):
    for batch in K.chunks(batches, "text"):
        sets = Sets(batch.column(0), size)
        once = np.zeros(len(sets.n), bool)
        once[np.unique(sets.name, return_index=True)[1]] = True   # one document of each class
        sig, doc = signatures(sets, once, common, percent)
        yield pa.RecordBatch.from_arrays([K.signed(sig), K.signed(sets.name[doc])], ["sig", "c"])


def member_bits(members: DataFrame) -> np.ndarray:
    """Bits of all classes ``c`` (by their low bits), packed.  A class that isn't in ``members``
    may have its bit set, none of ``members`` lacks it."""
    place = (F.pmod("c", F.lit(1 << MEMBER_BITS)) + 1).alias("place")
    got = members.select(place).distinct().select(
        F.bitmap_bucket_number("place").alias("bucket"), F.bitmap_bit_position("place").alias("bit")).repartition(
        "bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).toArrow()
    out = np.zeros((1 << MEMBER_BITS) >> 3, np.uint8)
    for bucket, bits in zip(got["bucket"].to_pylist(), got["bits"].to_pylist()):
        out[(bucket - 1) * len(bits):bucket * len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def _texts(batches, size: int, members: np.ndarray):
    """Class and text, one of each class of a chunk that has its bit in ``members``."""
    for batch in K.chunks(batches, "text"):
        sets = Sets(batch.column(0), size)
        place = (sets.name & np.uint64((1 << MEMBER_BITS) - 1)).astype(np.int64)
        asked = (members[place >> 3] >> (place & 7).astype(np.uint8)) & 1
        at = np.unique(sets.name, return_index=True)[1]
        at = np.sort(at[(sets.n[at] > 0) & (asked[at] == 1)])
        yield pa.RecordBatch.from_arrays([K.signed(sets.name[at]), batch.column(0).take(pa.array(at))], ["c", "text"])


def _stars(batches):
    """Rows sorted by (sig, c) -> edges from each class to the least class of its signature."""
    sig0 = lead0 = None
    for batch in batches:
        sig, c = (batch.column(k).to_numpy() for k in range(2))
        if not len(sig):
            continue
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        new[0] = sig[0] != sig0 if sig0 is not None else True
        lead = np.concatenate([[0 if lead0 is None else lead0], c[new]])[np.cumsum(new)]
        sig0, lead0 = sig[-1], lead[-1]
        far = lead != c
        pairs = np.unique(np.stack([lead[far], c[far]], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def link(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Component numbers (of the first member) of a region's sets, by pivots and windows."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    parent = np.arange(n)
    first = np.concatenate([[0], np.cumsum(size)])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(int(ids.max()) + 1, bool)
    doc = np.repeat(np.arange(n), size)
    holders = doc[np.argsort(ids, kind="stable")]     # documents by element
    held = np.bincount(ids)
    begin = np.cumsum(held) - held

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(x, y):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)

    def shared(x, others):
        """Elements that x has in common with each of the others (or with all)."""
        own = ids[first[x]:first[x + 1]]
        if others is None:
            return np.bincount(holders[K.ranges(begin[own], held[own])], minlength=n)
        mark[own] = True
        at = K.ranges(first[others], size[others])
        got = np.bincount(np.repeat(np.arange(len(others)), size[others])[mark[ids[at]]], minlength=len(others))
        mark[own] = False
        return got

    t = (100 - percent) / 100 + 1e-9
    best = np.full(n, np.inf)
    home = np.full(n, -1)
    windows = []
    for p in range(n):
        if home[p] >= 0:
            continue
        both = shared(p, None)
        union_size = size + size[p] - both
        near = np.flatnonzero(100 * both >= percent * union_size)
        far = 1 - both / union_size
        for x in near.tolist():
            union(x, p)
        closer = near[far[near] < best[near]]
        best[closer], home[closer] = far[closer], p
        home[p], best[p] = p, 0.0
        around = np.flatnonzero(far <= 2 * t)
        windows.append((p, around, far[around]))
    cells = {p: np.flatnonzero(home == p) for p, *_ in windows}
    for p, around, far in windows:
        cell = cells[p]
        for y, d in zip(around.tolist(), far.tolist()):
            if root(y) == root(p):
                continue
            x = cell[best[cell] >= d - t]
            if len(x):
                both = shared(y, x)
                hit = x[100 * both >= percent * (size[x] + size[y] - both)]
                if len(hit):
                    union(y, int(hit[0]))
    return np.array([root(x) for x in range(n)])


def _join(batches, size: int, percent: int):
    """Rows (region, c, text), sorted by region and class -> links between classes, a star for
    each component of a region."""
    held: list[pa.RecordBatch] = []

    def work(table: pa.Table):
        region, c = table.column("region").to_numpy(), table.column("c").to_numpy()
        sets = []
        for part in K.chunks(table.combine_chunks().to_batches(), "text"):
            s = Sets(part.column(part.schema.names.index("text")), size)
            sets += [s.h[s.first[d]:s.first[d + 1]] for d in range(part.num_rows)]
        edges = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1], [True]])) if len(region) else [0]
        out_a, out_b = [], []
        for a, b in zip(edges[:-1], edges[1:]):
            a, b = int(a), int(b)
            root = link(sets[a:b], percent)
            far = np.flatnonzero(root != np.arange(len(root)))
            out_a += c[a + root[far]].tolist()
            out_b += c[a + far].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    for batch in batches:
        held.append(batch)
        table = pa.Table.from_batches(held)
        group = table.column("region").to_numpy()
        cut = int(np.searchsorted(group, group[-1])) if len(group) else 0
        if cut:
            yield from work(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield from work(pa.Table.from_batches(held))


def jaccard_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE,
                   percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, row_key (of the text) and group_key (of the component, also
    where no row of it has a doc_id; null where nothing can link) of every row."""
    rows = K.bounded(docs).select(F.col(doc_id).cast("long").alias("doc"), row_key(F.col(text)).alias("key"),
                       F.col(text).cast("string").alias("text"))
    classes = materialize(rows.mapInArrow(lambda b: _classes(b, size), "doc long, key long, n long, c long"), "classes")
    reps = classes.filter("n > 0").groupBy("c").agg(F.min("doc").alias("rep"))
    total = classes.count()
    sample = rows.filter(F.pmod(F.xxhash64("text", F.lit(9)), F.lit(max(total, 1))) < SAMPLE_DOCS) \
        .dropDuplicates(["text"]).limit(2 * SAMPLE_DOCS).select("text")
    got = sample.mapInArrow(lambda b: _sample(b, size), "bucket int, n long").groupBy("bucket").agg(
        F.sum("n").alias("n")).filter(F.col("n") >= COMMON).toArrow()
    common = np.zeros(1 << BUCKET_BITS, bool)
    common[got["bucket"].to_numpy()] = True
    packed = np.packbits(common)
    signed = rows.select("text").mapInArrow(
        lambda b: _signatures(b, size, np.unpackbits(packed).astype(bool), percent), "sig long, c long")
    edges = materialize(signed.repartition("sig").sortWithinPartitions("sig", "c").mapInArrow(
        _stars, "a long, b long").distinct(), "regions")
    members = edges.select(F.col("a").alias("region"), F.col("b").alias("c")).union(
        edges.select("a", "a").distinct())
    asked = member_bits(members)
    texts = rows.select("text").mapInArrow(lambda b: _texts(b, size, asked), "c long, text string").groupBy("c").agg(
        F.min("text").alias("text"))
    near = members.join(texts, "c").select("region", "c", "text")
    links = near.repartition("region").sortWithinPartitions("region", "c").mapInArrow(
        lambda b: _join(b, size, percent), "a long, b long")
    comps = components(links)
    grouped = materialize(reps.join(comps, reps.c == comps.node, "left").select(
        "c", "rep", F.coalesce("component", "c").alias("group")), "components")
    found = grouped.join(grouped.groupBy("group").agg(F.min("rep").alias("component")), "group").select(
        "c", "group", "component")
    own = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc"))
    return classes.join(found, "c", "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id"),
        F.col("key").alias("row_key"), F.col("group").alias("group_key"))


def op6_jaccard_join(spark, sf_dir):
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_key", "group_key")
