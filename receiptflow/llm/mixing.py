"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

Each source gets a target number of words; a document's expected copies are
target / source words, split into whole copies and a fractional probability.
Rounding pairs two fractional documents of a source and moves words between
them: with the right odds either the first or the second becomes 0 or 1, so
that their expected copies stay and so do their summed words.  A bucket of
documents is folded this way in one pass (an ``aggregate`` over its array); it
leaves one fractional document, and buckets of those are folded again, up a
tree with a fan-in of ``FAN_IN``; a last chain leaves one document for each
source, which is taken or not.  The words that this costs or adds go to other
documents of the last chain, largest first, in whole copies (0 to ``CAP`` each).
So a source misses its target by half of the shortest of them at most, unless
all their copies together can't make up for it.
Buckets are numbered by a hash, hence a source with a third of all rows is many
small groups.  Draws are hashes of the row and the seed: reruns agree.

Targets: sources sorted by code point (null last) weigh 1, 2, 3, 1, ...; they
share the words by weight, none above ``CAP`` times its own; the excess is
shared again by weight.  That is a water level: sources in order of words per
weight are capped as long as their cap lies under the level of the rest.

Defined results: null or empty text has size 0 and is taken 0 times; an empty
table gives no rows; repeated rows (also of one doc_id) are drawn one by one;
a null doc_id is a value like any other.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

CAP = 3
WEIGHTS = (1, 2, 3)
FAN_IN = 64
#: Documents of a source that wait for the last chain.
RESERVE = 512
#: Up to so many sources travel to every task.
BROADCAST_SOURCES = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, n -> with target.  One row per source comes in."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("rank"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)),
                               (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    level = ((F.sum("source_size").over(all_rows)
              - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
             / F.sum("weight").over(after))
    levels = ranked.withColumn("level", level)
    # levels of sources that are capped too early only get lower, so the largest fitting one holds
    first = F.max(F.when(F.col("level") * F.col("weight") <= cap * F.col("source_size"),
                         F.col("level"))).over(all_rows)
    return levels.select("source", "source_size", "n", F.least(
        F.col("weight") * first, cap * F.col("source_size")).cast("double").alias("target"))


def _uniform(seed: int, *parts) -> Column:
    """Draw in [0, 1) from the parts and the seed."""
    return (F.xxhash64(F.lit(seed), *parts).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52)))


def _pivot(state: Column, x: Column, seed: int) -> Column:
    """One fold step: the fractional document so far (``state.open``) meets ``x``."""
    a, eps = state["open"], 1e-12
    # words that may move from one to the other until one is 0 or 1
    up = F.least((1 - a["p"]) * a["size"], x["p"] * x["size"])
    down = F.least(a["p"] * a["size"], (1 - x["p"]) * x["size"])
    goes_up = _uniform(seed, a["key"], x["key"]) * (up + down) < down
    moved = F.when(goes_up, up).otherwise(-down)
    pa, px = a["p"] + moved / a["size"], x["p"] - moved / x["size"]

    def settled(p):
        return F.when(p < eps, F.lit(0.0)).when(p > 1 - eps, F.lit(1.0)).otherwise(p)

    pa, px = settled(pa), settled(px)
    a_done = (pa == 0.0) | (pa == 1.0)
    left, right = a.withField("p", pa), x.withField("p", px)
    return F.when(a["key"].isNull(), F.struct(x.alias("open"), state["done"].alias("done"))).otherwise(
        F.struct(F.when(a_done, right).otherwise(left).alias("open"),
                 F.concat(state["done"], F.array(F.when(a_done, left).otherwise(right))).alias("done")))


def _fold(groups, kind: str, seed: int) -> DataFrame:
    """Each group's documents, largest first, in one chain: settled ones and the open one."""
    item = F.struct((-F.col("size")).alias("order"), "key", "doc_id", "size", "whole", "p")
    folded = groups.agg(F.sort_array(F.collect_list(item)).alias("xs")).select(
        "source", F.aggregate(
            "xs", F.struct(F.lit(None).cast(kind).alias("open"),
                           F.array().cast(f"array<{kind}>").alias("done")),
            lambda s, x: _pivot(s, x, seed)).alias("state"))
    return materialize(folded, "pivotal")


def _settle(state: Column, cap: int) -> Column:
    """The last open document is taken or not, whichever the settled ones can better make up for
    (then the nearer); its error goes to them, largest first."""
    a, others = state["open"], state["done"]

    def words(copies):
        return F.aggregate(others, F.lit(0.0), lambda s, x: s + copies(x["whole"] + x["p"]) * x["size"])

    over = F.greatest(F.lit(0.0), (1 - a["p"]) * a["size"] - words(lambda have: have))
    under = F.greatest(F.lit(0.0), a["p"] * a["size"] - words(lambda have: cap - have))
    rounded = F.when(over < under, 1.0).when(over > under, 0.0).otherwise(F.round(a["p"]))
    error = F.when(a["p"].isNull(), F.lit(0.0)).otherwise((a["p"] - rounded) * a["size"])

    def pass_on(s, x):
        have = x["whole"] + x["p"]
        change = F.greatest(-have, F.least(cap - have, F.round(s["error"] / x["size"])))
        return F.struct((s["error"] - change * x["size"]).alias("error"),
                        F.concat(s["done"], F.array(x.withField("p", x["p"] + change))).alias("done"))

    start = F.struct(error.alias("error"), F.filter(others, lambda x: F.lit(False)).alias("done"))
    passed = F.aggregate(F.sort_array(others), start, pass_on)["done"]
    return F.when(a["key"].isNull(), others).otherwise(
        F.concat(passed, F.array(a.withField("p", rounded))))


def round_copies(rows: DataFrame, seed: int = 11, cap: int = CAP) -> DataFrame:
    """Rows (source, key, doc_id, size, whole, p, slots) with 0 < p < 1 and size > 0
    -> the same rows with p rounded to 0 or 1, words kept per source.

    About ``RESERVE`` rows of a source (one of ``slots``, by hash) stay out of
    the tree: the tree's residuals, mostly long documents, go down a last chain
    with them, largest first.  A document longer than all others' open words stays
    open there; it is rounded, and a few of the chain's documents (p then from
    -whole to cap - whole) make up for that."""
    kind = "struct<order:bigint,key:bigint,doc_id:" + \
        rows.schema["doc_id"].dataType.simpleString() + ",size:bigint,whole:bigint,p:double>"
    columns = ["source", "key", "doc_id", "size", "whole", "p"]
    spared = F.pmod(F.xxhash64("key", F.lit(seed - 7)), F.col("slots")) == 0
    reserve, rows = rows.filter(spared).select(columns), rows.filter(~spared).select(columns)
    settled = (F.col("p") == 0.0) | (F.col("p") == 1.0)
    done, level = [], 0
    while True:
        most = rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        last = most <= FAN_IN
        groups = rows.unionByName(reserve).groupBy("source") if last else rows.groupBy(
            "source", F.pmod(F.xxhash64("key", F.lit(seed + level)), F.lit(-(-most // FAN_IN))).alias("bucket"))
        folded = _fold(groups, kind, seed + level)
        if last:
            done.append(folded.select("source", F.inline(_settle(F.col("state"), cap))).select(columns))
            break
        done.append(folded.select("source", F.inline("state.done")).select(columns))
        left = folded.select("source", "state.open.*").filter("key is not null").select(columns)
        done.append(left.filter(settled))
        rows, level = left.filter(~settled), level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
                weights=WEIGHTS, cap: int = CAP, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and source of every row of ``docs``."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                        n_words(F.col(text)).alias("size"))
    # equal rows meet here, before the shuffle; each gets a number of its own again
    counted = materialize(sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("m")), "sizes")
    plan = materialize(targets(counted.groupBy("source").agg(
        F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("n")), weights, cap), "targets")
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    rows = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m").cast("int")))).alias("r").join(
        plan.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select(
        "r.source", "r.doc_id", "r.size", F.ceil(F.col("t.n") / RESERVE).alias("slots"),
        F.xxhash64(F.lit(seed), "r.doc_id", "r.size", "r.copy").alias("key"),
        F.coalesce(F.col("t.target") / F.nullif("t.source_size", F.lit(0)), F.lit(0.0)).alias("rate"))
    rows = rows.withColumn("whole", F.floor("rate")).withColumn("p", F.col("rate") - F.col("whole"))
    open_ = (F.col("p") > 1e-12) & (F.col("p") < 1 - 1e-12) & (F.col("size") > 0)
    rounded = round_copies(rows.filter(open_).drop("rate"), seed, cap)
    fixed = rows.filter(~open_).select("source", "key", "doc_id", "size", "whole",
                                       F.round("p").alias("p"))
    out = rounded.unionByName(fixed).alias("r").join(
        plan.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    copies = F.when(F.col("r.size") > 0, F.col("r.whole") + F.col("r.p").cast("long")).otherwise(F.lit(0))
    return out.select("r.doc_id", "r.size", "t.source_size", "t.target",
                      (copies * F.col("r.size")).cast("long").alias("taken"),
                      copies.cast("long").alias("copies"), "r.source")


def op3_mix_sources(spark, sf_dir):
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
