"""Image-vector index: normalisation, exact cosine top-k (one query or a
block of queries), index maintenance plans (V1-V3, J1, J2, X35-X37)."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Similarity bands (tuned for the default image model).
HIGH_BAND = 0.85
MEDIUM_BAND = 0.75
DEFAULT_TOP_K = 5
INDEX_BLOCK = 50_000
QUERY_BLOCK = 2_000


def confidence(score: Column) -> Column:
    """X35."""
    return (F.when(score >= HIGH_BAND, "high").when(score >= MEDIUM_BAND, "medium")
             .otherwise("low"))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed in element order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def normalize(v: Column) -> Column:
    """V / |v| (double elements)."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / norm)


def knn_topk(index: DataFrame, query: list[float], k: int = DEFAULT_TOP_K,
             vec_col: str = "vector", id_col: str = "item_id") -> DataFrame:
    """V1 + O3: the query vector is a literal (one vector), the score is a
    projection over the index, and ``orderBy(...).limit(k)`` plans as a
    TakeOrderedAndProject (per-partition top-k, then a k-row merge)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = index.select("*", dot(F.col(vec_col), q).alias("score"))
    return (scored.orderBy(F.desc("score"), F.asc(id_col)).limit(k)
                  .withColumn("confidence", confidence(F.col("score"))))


#: Index vectors that are compared with a block of queries at once.
SLICE = 4096


def _best_of_block(k: int, id_col: str, vec_col: str):
    """Top k (and ties with the k-th) of an index block for each of a block of queries."""
    def best(queries: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], id_col: [], "score": []}
        if len(queries) and len(index):
            q = np.vstack(queries["_q"].to_numpy()).astype(np.float64)
            top, found = np.empty((len(q), 0)), []
            for at in range(0, len(index), SLICE):
                part = index.iloc[at:at + SLICE]
                sims = q @ np.vstack(part[vec_col].to_numpy()).astype(np.float64).T
                top = np.hstack([top, sims])
                n = min(k, top.shape[1])
                top = np.partition(top, top.shape[1] - n, axis=1)[:, top.shape[1] - n:]
                row, col = np.nonzero(sims >= top.min(axis=1)[:, None])
                found.append((row, at + col, sims[row, col]))
            row, col, score = (np.concatenate(x) for x in zip(*found))
            stay = score >= top.min(axis=1)[row]
            out = {"query_id": queries["query_id"].to_numpy()[row[stay]], id_col: index[id_col].to_numpy()[col[stay]],
                   "score": score[stay]}
        return pd.DataFrame(out)
    return best


def knn_batch(index: DataFrame, queries: DataFrame, k: int = DEFAULT_TOP_K,
              vec_col: str = "vector", id_col: str = "item_id",
              qid_col: str = "query_id", qvec_col: str = "query_vector") -> DataFrame:
    """V2: exact top-k for a table of query vectors.

    Index and queries are numbered by blocks of about ``INDEX_BLOCK`` and
    ``QUERY_BLOCK`` vectors; every pair of blocks meets in a cogroup (an
    equi-join on both numbers) and is one matrix product, of which only the top
    k per query (plus ties) go on.  Neither table passes through the driver,
    and the plan is the same for every size."""
    blocks = [max(1, -(-df.count() // n)) for df, n in ((index, INDEX_BLOCK), (queries, QUERY_BLOCK))]
    def numbered(df, key, own, other):
        mine = F.pmod(F.xxhash64(key), F.lit(blocks[own])).cast("int")
        theirs = F.explode(F.sequence(F.lit(0), F.lit(blocks[other] - 1)))
        return df.withColumn("_b0", mine if own == 0 else theirs).withColumn("_b1", theirs if own == 0 else mine)
    left = numbered(queries.select(F.col(qid_col).alias("query_id"), F.col(qvec_col).alias("_q")), "query_id", 1, 0)
    right = numbered(index.select(id_col, vec_col), id_col, 0, 1)
    schema = T.StructType([T.StructField("query_id", queries.schema[qid_col].dataType),
                           T.StructField(id_col, index.schema[id_col].dataType),
                           T.StructField("score", T.DoubleType())])
    cand = left.groupBy("_b0", "_b1").cogroup(right.groupBy("_b0", "_b1")).applyInPandas(
        _best_of_block(k, id_col, vec_col), schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col))
    return (cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
                .withColumn("confidence", confidence(F.col("score"))))


def vectors_to_bytes(df: DataFrame, vec_col: str = "vector", out: str = "blob") -> DataFrame:
    """X36 (export side): float32 little-endian bytes, Arrow-batched."""
    @F.pandas_udf(T.BinaryType())
    def pack(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())
    return df.withColumn(out, pack(F.col(vec_col)))


def bytes_to_vectors(df: DataFrame, blob_col: str = "blob", out: str = "vector") -> DataFrame:
    """X36 (import side): legacy float32 blobs -> ARRAY<FLOAT>."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def unpack(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4").tolist())
    return df.withColumn(out, unpack(F.col(blob_col)))


def embeddings_with_items(emb: DataFrame, items: DataFrame, id_col: str = "id") -> DataFrame:
    """Inner equi-join (vectors without an item row drop out)."""
    return emb.join(items, emb.item_id == items[id_col], "inner")


def items_missing_embedding(items: DataFrame, emb: DataFrame, id_col: str = "id") -> DataFrame:
    """Items with an image but no vector (left anti join)."""
    with_img = items.filter(F.col("image_path").isNotNull())
    return with_img.join(emb, with_img[id_col] == emb.item_id, "left_anti")


def reindex_plan(items: DataFrame, emb: DataFrame, force: bool = False, id_col: str = "id") -> DataFrame:
    """V3: what a (re)index run embeds: missing vectors only, or every item
    with an image when forced."""
    if force:
        return items.filter(F.col("image_path").isNotNull())
    return items_missing_embedding(items, emb, id_col)


def reindex(items: DataFrame, emb: DataFrame, predict, force: bool = False,
            id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """V3 + A10 as a job: (the index afterwards, embedded / skipped / failed).
    ``predict`` (H8) maps the planned rows to rows (item_id, vector), a NULL
    vector for a failure; what it embeds replaces the stored vector."""
    plan = reindex_plan(items, emb, force, id_col)
    made = predict(plan)
    new = made.filter(F.col("vector").isNotNull()).select("item_id", "vector")
    kept = emb.select("item_id", "vector").join(new.select("item_id"), "item_id", "left_anti")
    considered = items if force else items.join(emb, items[id_col] == emb.item_id, "left_anti")
    return kept.unionByName(new), reindex_stats(considered, made, id_col)


def reindex_stats(plan: DataFrame, embedded: DataFrame, id_col: str = "id") -> DataFrame:
    """A10: embedded / skipped / failed after the embedding job, where
    ``embedded(item_id, vector)`` is the job's output (NULL vector = failure)."""
    j = plan.join(embedded, plan[id_col] == embedded.item_id, "left")
    return j.agg(F.count_if(F.col("image_path").isNotNull() & F.col("vector").isNotNull()).alias("embedded"),
                 F.count_if(F.col("image_path").isNull()).alias("skipped"),
                 F.count_if(F.col("image_path").isNotNull() & F.col("vector").isNull()).alias("failed"))


def batched_model(make_model, *columns: str, batch_size: int = 256, id_col: str = "id"):
    """H8: a ``predict`` for :func:`reindex` from a model on numpy arrays.  ``make_model()``
    runs once on each worker and gives a function of a batch of ``columns`` that returns a
    vector for each row.  Where a batch fails its rows are tried one by one, and a row that
    fails, or gives a number that isn't finite, has the vector NULL."""
    def make():
        model = make_model()

        def rows(*batch):
            try:
                return np.asarray(model(*batch), np.float32)
            except Exception:  # noqa: BLE001 - found row by row below
                if len(batch[0]) == 1:
                    return None
            made = [rows(*[c[k:k + 1] for c in batch]) for k in range(len(batch[0]))]
            width = next((m.shape[1] for m in made if m is not None), 1)
            return np.vstack([np.full((1, width), np.nan, np.float32) if m is None else m for m in made])

        def predict(*batch):
            made = rows(*batch)
            return np.full((len(batch[0]), 1), np.nan, np.float32) if made is None else made
        return predict

    embed = predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    finite = lambda v: ~F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))

    def predict(plan: DataFrame) -> DataFrame:
        made = plan.select(F.col(id_col).alias("item_id"), embed(*columns).alias("vector"))
        return made.withColumn("vector", F.when(finite(F.col("vector")), F.col("vector")))
    return predict
