"""Embedding near-dedup over a robust-pruned flat graph.

Equal vectors are one class first.  Centroids come from a bounded sample; each
class goes to its ``OVERLAPS`` nearest centroids, so cluster shards overlap.  In
a shard every vector's candidate neighbours are robust-pruned: the nearest is
kept, and candidates that are ``ALPHA`` times nearer to it than to the vector
go.  The adjacency lists of all shards are united per vector: one flat graph.

Every vector is searched for, in each shard that holds it: a greedy walk on
the united lists from the shard's medoid (and from the vector itself, which
is a node) with a beam, then a range expansion that opens every vector found within
the radius less a margin until none is left.  Hits are verified by cosine in
double precision, and each shard gives a forest of them.

The search only has to connect a group, not to find its every link: a group of
many times ``SHARD`` near copies is itself cut into many shards, and most of its
pairs share none.  So the forests of all shards make components, and within a
component all pairs are compared: its vectors are salted into blocks of about
``SHARD``, every pair of blocks is a group of bounded size, and only counts leave
it.  A link is missed only if the search connects its ends by no path.

Recall is audited by brute force for a sample of vectors against all, which grows
until ``AUDIT_LINKED`` of them have a link, but few (up to ``AUDIT_MOST`` vectors).
It is the mean of each vector's share of links found, over all vectors with links
or over those with few, whichever is less, so a hot group can't outweigh the sparse
pairs.  Below ``RECALL`` the search is run again with a wider beam and more shards
for each vector, and at the last width the operator raises.  Where the sample held
no link recall is null; only if it was the whole table, no link is a recall of 1.

Defined results: vectors that are null, empty, zero, of another length than
most, or hold null or non-finite components link with nothing; null ids are
rows of their own that link with nothing; repeated rows are copies and link
with each other; an empty table gives no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .graph import components

RADIUS = 0.95
#: Vectors of a shard (before the overlap) and of a component's block, about.
SHARD = 1_000
MAX_CENTROIDS = 4_096
#: Bound of the sample that the centroids are fitted on.
SAMPLE = 20_000
ROUNDS = 6
CANDIDATES = 48
DEGREE = 24
ALPHA = 1.2
#: Widths of the search, tried in order: the beam, and the shards of each vector.
BEAMS = (16, 48, 128)
OVERLAPS = (3, 6, 12)
#: How far under the radius a vector may lie and still be opened.
MARGIN = 0.04
#: Vectors audited first and at most; how many of them shall have links, but no more than FEW.
AUDIT = 200
AUDIT_MOST = 6_400
AUDIT_LINKED = 50
FEW = 8
RECALL = 0.97
#: Numbers gathered at once in a search step.
STEP_FLOATS = 8 << 20


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds if k > 1 else 0):
        home = np.concatenate([(x[a:a + 4096] @ c.T).argmax(1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-12)[:, None], c)
    return c


def _vectors(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, 1))


def _assign(batches, c: np.ndarray, overlap: int):
    near = min(overlap, len(c))
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            sim = _vectors(part.column(1)) @ c.T
            shard = np.argpartition(-sim, near - 1, axis=1)[:, :near]
            pick = np.repeat(np.arange(part.num_rows), near)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.ravel().astype(np.int32)), part.column(0).take(pa.array(pick)),
                 part.column(1).take(pa.array(pick))], ["shard", "vec_id", "embedding"])


def _by_shard(batches, keys: tuple[str, ...] = ("shard",)):
    """Whole shards (runs of equal keys) of a partition sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        new = np.zeros(table.num_rows - 1, bool)
        for k in keys:
            new |= np.diff(table.column(k).to_numpy()) != 0
        if new.any():
            edge = np.flatnonzero(new) + 1
            for a, b in zip([0, *edge[:-1]], edge):
                yield table.slice(a, b - a).combine_chunks()
            held = table.slice(edge[-1]).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _build(batches):
    for table in _by_shard(batches):
        ids = table.column("vec_id").to_numpy()
        x = _vectors(table.column("embedding").combine_chunks()).astype(np.float32)
        n, c = len(ids), min(CANDIDATES, len(ids) - 1)
        if not c:
            continue
        for a in range(0, n, 512):
            sim = x[a:a + 512] @ x.T
            sim[np.arange(len(sim)), np.arange(a, a + len(sim))] = -2
            near = np.argpartition(-sim, c - 1, axis=1)[:, :c]
            near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sim, near, 1), axis=1), 1)
            rows = np.arange(a, a + len(sim))
            kept = prune(x, rows, near)
            r, k = np.nonzero(kept >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows[r]]), pa.array(ids[kept[r, k]])], ["vec_id", "to"])


def prune(x: np.ndarray, rows: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Robust pruning of the rows' candidates (``near``, nearest first); -1 fills."""
    own = np.einsum("nd,ncd->nc", x[rows], x[near])
    alive = np.ones(near.shape, bool)
    out = np.full((len(rows), DEGREE), -1)
    row = np.arange(len(rows))
    for k in range(DEGREE):
        first = alive.argmax(1)
        some = alive[row, first]
        if not some.any():
            break
        picked = near[row, first]
        out[some, k] = picked[some]
        between = np.einsum("nd,ncd->nc", x[picked], x[near])
        # squared distance of unit vectors is 2 - 2 * cosine
        alive &= ~((ALPHA ** 2 * (1 - between) <= 1 - own) & some[:, None])
        alive[row, first] = False
    return out


def search(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: int, beam: int,
           radius: float = RADIUS, margin: float = MARGIN) -> tuple[np.ndarray, np.ndarray]:
    """(query, found) pairs: for each query row, a beam walk from ``entry`` and the query's
    node, then everything in range is opened.  ``links`` holds neighbours, -1 fills."""
    n, degree = links.shape
    q = len(queries)
    seen = np.zeros((q, n), bool)          # compared with the query
    opened = np.zeros((q, n), bool)
    sim = np.full((q, n), -2.0, np.float32)
    row = np.arange(q)
    for start in (np.full(q, entry), queries):
        seen[row, start] = True
        sim[row, start] = np.einsum("qd,qd->q", x[queries], x[start])
    walking = np.ones(q, bool)
    while walking.any():
        live = np.flatnonzero(walking)
        waiting = np.where(opened[live], -2.0, sim[live])
        best = waiting.argmax(1)
        value = waiting[np.arange(len(live)), best]
        # greedy while the best waiting one is among the beam's best, later only within range
        count = opened[live].sum(1)
        go = (value > -2) & ((count < beam) | (value >= radius - margin))
        walking[live[~go]] = False
        live, best = live[go], best[go]
        if not len(live):
            break
        opened[live, best] = True
        to = links[best]
        r, k = np.nonzero(to >= 0)
        r, to = live[r], to[r, k]
        fresh = ~seen[r, to]
        r, to = r[fresh], to[fresh]
        seen[r, to] = True
        sim[r, to] = np.einsum("nd,nd->n", x[queries[r]], x[to])
    return np.nonzero(sim >= radius - 1e-3)


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the ends of links; ``label`` holds each one's least connected place."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def _find(batches, beam: int, radius: float):
    """Links of each shard's forest: from the least vector to each one connected with it."""
    for table in _by_shard(batches):
        ids = table.column("vec_id").to_numpy()
        exact = _vectors(table.column("embedding").combine_chunks())
        x = exact.astype(np.float32)
        lists = table.column("links").combine_chunks()
        place = np.argsort(ids)
        flat = lists.flatten().to_numpy()
        at = np.minimum(np.searchsorted(ids[place], flat), len(ids) - 1)
        here = ids[place][at] == flat
        owner = np.repeat(np.arange(len(ids)), np.nan_to_num(
            lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))[here]
        local = place[at[here]]
        order = np.argsort(owner, kind="stable")
        owner, local = owner[order], local[order]
        size = np.bincount(owner, minlength=len(ids))
        links = np.full((len(ids), max(int(size.max(initial=0)), 1)), -1)
        links[owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)] = local
        medoid = int((x @ unit(x.sum(0, keepdims=True) + 1e-12)[0]).argmax())
        step = max(16, STEP_FLOATS // max(len(ids) * 2, links.shape[1] * x.shape[1]))
        label = np.arange(len(ids))
        for a in range(0, len(ids), step):
            queries = np.arange(a, min(a + step, len(ids)))
            r, to = search(x, links, queries, medoid, beam, radius)
            r = queries[r]
            ok = (r != to)
            r, to = r[ok], to[ok]
            ok = np.einsum("nd,nd->n", exact[r], exact[to]) >= radius
            join(label, r[ok], to[ok])
        far = np.flatnonzero(label != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[label[far]]), pa.array(ids[far])], ["a", "b"])


def _tally(batches, radius: float):
    """Pairs of a component's blocks -> for each vector the vectors and rows it links with there."""
    for table in _by_shard(batches, ("component", "low", "high")):
        ids, n = table.column("vec_id").to_numpy(), table.column("n").to_numpy()
        x = _vectors(table.column("embedding").combine_chunks())
        block = table.column("block").to_numpy()
        one = np.flatnonzero(block == table.column("low")[0].as_py())
        two = np.flatnonzero(block == table.column("high")[0].as_py())
        found, far = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        same = table.column("low")[0] == table.column("high")[0]
        for a in range(0, len(one), 512):
            part = one[a:a + 512]
            near = (x[part] @ x[two].T >= radius) & (ids[part][:, None] != ids[two])
            found[part] += near.sum(1)
            far[part] += near @ n[two]
            if not same:
                found[two] += near.sum(0)
                far[two] += n[part] @ near
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found), pa.array(far)], ["vec_id", "found", "far"])


def _brute(batches, ids: np.ndarray, x: np.ndarray, radius: float):
    """How many vectors of these batches each audited one links with."""
    true = np.zeros(len(ids), np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            near = _vectors(part.column(1)) @ x.T >= radius
            true += (near & (part.column(0).to_numpy()[:, None] != ids)).sum(0)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(true)], ["vec_id", "links"])


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                 radius: float = RADIUS) -> DataFrame:
    """vec_id, n_links, component_id, kept and recall (of the audit) of every row."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    e = F.col("e")
    fine = F.coalesce(F.col("vec_id").isNotNull() & (F.size(e) > 0) & F.forall(
        e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0),
        F.lit(False))
    rows = rows.withColumn("fine", fine)
    width = rows.filter("fine").groupBy(F.size("e").alias("w")).count().orderBy(F.desc("count"), "w").first()
    width = width.w if width else 0
    rows = rows.withColumn("fine", F.col("fine") & (F.size("e") == width))
    classes = materialize(rows.filter("fine").groupBy("e").agg(
        F.min("vec_id").alias("vec_id"), F.count("*").alias("n")), "vectors")
    nodes = classes.select("vec_id", F.col("e").alias("embedding"), "n")
    total = nodes.count()
    members = classes.select("vec_id", "e", "n").join(
        rows.filter("fine").select(F.col("vec_id").alias("id"), "e"), "e").select("id", "vec_id", "n")
    if total:
        counts, recall = _counts(nodes, total, radius)
        members = members.join(counts, "vec_id", "left").select(
            "id", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"))
    else:
        recall = None
        members = members.select("id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    alone = rows.filter("not fine").select(F.col("vec_id").alias("id"), F.lit(0).cast("long").alias("n_links"),
                                           F.col("vec_id").alias("component_id"))
    return members.unionByName(alone).select(
        F.col("id").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"),
        F.col("component_id"), F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
        F.lit(recall).cast("double").alias("recall"))


def _counts(nodes: DataFrame, total: int, radius: float) -> tuple[DataFrame, float | None]:
    """vec_id, component, found (vectors linked with), far (their rows) of vectors with links; recall."""
    draw = F.pmod(F.xxhash64("vec_id"), F.lit(total))
    taught = _vectors(nodes.filter(draw < SAMPLE).limit(2 * SAMPLE).toArrow()["embedding"].combine_chunks())
    if not len(taught):
        taught = _vectors(nodes.limit(1).toArrow()["embedding"].combine_chunks())
    k = max(1, min(-(-total // SHARD), MAX_CENTROIDS, len(taught)))
    c = centroids(taught, k)
    true, whole = _audit(nodes, total, radius)
    for beam, overlap in zip(BEAMS, OVERLAPS):
        counts = _within(nodes, components(_forest(nodes, c, beam, overlap, radius)), radius)
        share = F.least(F.coalesce("found", F.lit(0)), "links") / F.col("links")
        recall = true.filter("links > 0").join(counts, "vec_id", "left").agg(F.least(
            F.avg(share), F.avg(F.when(F.col("links") <= FEW, share)))).first()[0]
        if recall is None:
            return counts, 1.0 if whole else None
        if recall >= RECALL:
            return counts, recall
    if recall < 0.9:
        raise RuntimeError(f"the graph search finds {recall:.3f} of the audited links")
    return counts, recall


def _audit(nodes: DataFrame, total: int, radius: float) -> tuple[DataFrame, bool]:
    """vec_id and true number of links of the audited vectors; whether these are all."""
    draw = F.pmod(F.xxhash64("vec_id", "embedding", F.lit(1)), F.lit(total))
    size = AUDIT
    while True:
        asked = nodes.filter(draw < size).toArrow()
        ids, x = asked["vec_id"].to_numpy(), _vectors(asked["embedding"].combine_chunks())
        true = materialize(nodes.mapInArrow(lambda b: _brute(b, ids, x, radius), "vec_id long, links long").groupBy(
            "vec_id").agg(F.sum("links").alias("links")), "audit")
        if size >= min(total, AUDIT_MOST) or true.filter(F.col("links").between(1, FEW)).count() >= AUDIT_LINKED:
            return true, size >= total
        size = min(4 * size, AUDIT_MOST)


def _forest(nodes: DataFrame, c: np.ndarray, beam: int, overlap: int, radius: float) -> DataFrame:
    """Links that connect what the search connects."""
    shards = materialize(nodes.mapInArrow(lambda b: _assign(b, c, overlap),
                                          "shard int, vec_id long, embedding array<double>"), "shards")
    graph = shards.repartition("shard").sortWithinPartitions("shard", "vec_id").mapInArrow(
        _build, "vec_id long, to long").groupBy("vec_id").agg(F.collect_set("to").alias("links"))
    placed = materialize(shards.join(graph, "vec_id", "left"), "graph")
    return placed.repartition("shard").sortWithinPartitions("shard", "vec_id").mapInArrow(
        lambda b: _find(b, beam, radius), "a long, b long")


def _within(nodes: DataFrame, comps: DataFrame, radius: float) -> DataFrame:
    """Every link within a component, counted by pairs of its blocks."""
    comps = materialize(comps, "components")
    block = SHARD
    large = comps.groupBy("component").count().filter(F.col("count") > block).select(
        "component", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    rows = nodes.join(comps, nodes.vec_id == comps.node).drop("node").join(
        F.broadcast(large), "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn(
        "block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = rows.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                        "block", "vec_id", "embedding", "n")
    got = dealt.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high").mapInArrow(
        lambda b: _tally(b, radius), "vec_id long, found long, far long")
    return materialize(got.groupBy("vec_id").agg(F.sum("found").alias("found"), F.sum("far").alias("far")).join(
        comps.withColumnRenamed("node", "vec_id"), "vec_id"), "links")


def op8_vector_dedup(spark, sf_dir):
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
