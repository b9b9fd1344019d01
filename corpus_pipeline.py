"""Training-corpus pipeline over ``documents``: five stages, each a Spark job.

A stage takes (spark, docs, sf_dir) and works on every row that its predecessor
kept; ``run`` writes each stage's rows as Parquet in the shared folder and
reads them again for the next.  All stages but the last return the columns of
``docs``, in order, whatever these are besides doc_id, text, lang and source.

1. language_id        rows with a null text or no letter in it go, whatever the
                      languages learned
2. jaccard_groups     of each group of near copies (five-word shingles, 80 %)
                      one row stays, that with the smallest doc_id
3. decontaminate      rows that hold a benchmark window go
4. secret_scan        every span found is replaced by ``[SECRET]``; n_chars follows
5. mix_sources        the copies that each row has in the mix

Defined results: null and empty texts leave in stage 1, so that no later stage
has them; equal rows are near copies and leave in stage 2; a row without a
doc_id stays only where no row of its group has one, and one of them does;
an empty table gives empty stages.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from receiptflow.llm import decontaminate, jaccard_join, langid, mixing, secrets
from receiptflow.session import materialize

#: Of SQL the learned stages (language ID, secret scan) and the random one have no equivalent.
ORACLE_SQL = None

SHINGLE, PERCENT = 5, 80


def _wrapped(docs: DataFrame, *names: str) -> DataFrame:
    """The whole row as ``row`` beside the columns an operator needs, so that no name clashes."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       *[F.col(f"`{c}`") for c in names])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = langid.identify(_wrapped(docs, "doc_id", "text", "lang"))
    # without a language to learn from every text is und, and only the letters tell
    return out.filter((F.col("lang_pred") != "und") | F.col("row.text").rlike(r"\p{L}")).select("row.*")


def jaccard_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard_join.jaccard_groups(docs, size=SHINGLE, percent=PERCENT)
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row_key").alias("key"))
    linked = groups.filter("group_key is not null").groupBy("group_key").agg(F.min(row).alias("first"))
    stay = linked.select("first.id", "first.key").union(groups.filter("group_key is null").select(
        "doc_id", "row_key").distinct())
    rows = _wrapped(docs, "doc_id").withColumn("key", jaccard_join.row_key(F.col("row.text")))
    kept = rows.alias("r").join(stay.alias("s"), F.col("r.doc_id").eqNullSafe(F.col("s.id")) & (
        F.col("r.key") == F.col("s.key")), "left_semi")
    # rows that share id and text are copies of each other
    return kept.groupBy("doc_id", "key").agg(F.min("row").alias("row")).select("row.*")


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(_wrapped(docs, "text"), items).filter("NOT contaminated").select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.scan_secrets(_wrapped(docs, "text"), redact=True).withColumn(
        "row", F.when(F.col("row.text").isNotNull(), F.col("row").withField("text", F.col("redacted")))
        .otherwise(F.col("row")))
    if "n_chars" in docs.columns:
        out = out.withColumn("row", F.col("row").withField(
            "n_chars", F.length("row.text").cast(docs.schema["n_chars"].dataType)))
    return out.select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", language_id),
    ("jaccard_groups", jaccard_groups),
    ("decontaminate", decontaminate_benchmark),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
