"""Source divergence audit: how far each source's words stray from its language and from
the language's other sources.

Terms are runs of letters (A-Z lower-cased, any non-ASCII character is a letter).  A
task reads a shard of documents as one Arrow buffer, points at every term's first
byte and sorts the pointers by multikey quicksort, a symbol being eight bytes: all open
slices are split by their pointers' next symbol at once (numpy's sort puts every pivot
in place where the textbook puts one), a slice of one symbol moves on to the next, and
one whose terms end is a run of equal terms.  A run tells the term's occurrences and
documents by source.  Spark adds the shards up; a language keeps the terms that enough
of its documents hold.

A group's share of a term is p = 1 + floor(SCALE * (count + 1) / (N + V)) of its N
kept occurrences and the language's V kept terms, all in integers.  The divergence
of p from q is the sum of floor((p - q)^2 / q).  Sums over pairs of sources are not
taken over V terms each: a term that a source lacks has one known share p0 there, so
for a pair (i, j)

    sum f = V f(p0i, p0j) + sum over i's terms [f(p, p0j) - f(p0i, p0j)]
                          + sum over j's terms [f(p0i, q) - f(p0i, p0j)]
                          + sum over common terms [f(p, q) - f(p, p0j) - f(p0i, q) + f(p0i, p0j)]

The middle sums need how often each share occurs in a source, the last one is taken
by numpy over blocks of terms, which yield one number for a pair, never a row for a
pair and term.

Defined results: a null text, language or source is an empty string; every row is a
document of its own, repeated rows and null ids too; an empty or very long text is
like any other; a group without terms has count 0 for each term; a language without
kept terms has value 0 for each pair and no terms; an empty table gives no rows;
further columns aren't read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import textkit as K

#: Bytes of text whose pointers are sorted together; a longer text is its own shard.
SHARD_BYTES = 8 << 20
#: Documents of a language that keep a term, whole of a distribution, ranks of terms.
LEAST_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Terms that agree in so many bytes are told apart by comparing the rest at once.
DEEP = 64
#: Cells (terms x sources) of a block of the pair sums.
CELLS = 1 << 18

LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


def _symbols(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one number, zero beyond the end."""
    left = np.clip(end - at, 0, 8).astype(np.uint64)
    found = data[np.minimum(at, len(data) - 8)[:, None] + np.arange(8)].view(">u8").ravel().astype(np.uint64)
    keep = np.where(left > 0, ~np.uint64(0) << (np.uint64(8) * (np.uint64(8) - np.maximum(left, np.uint64(1)))),
                    np.uint64(0))
    return found & keep


def sort_pointers(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers to terms [start, end) in the terms' byte order, equal ones in the order
    given, and for each sorted pointer the place where its run of equal terms begins.
    Terms hold no zero byte."""
    n = len(start)
    data = np.concatenate([raw, np.zeros(16, np.uint8)])
    order, run = np.empty(n, np.int64), np.empty(n, np.int64)
    # open slices: pointers, first places of their slices, own places
    idx, seg, place, depth = np.arange(n), np.zeros(n, np.int64), np.arange(n), 0
    while len(idx):
        key = _symbols(data, start[idx] + depth, end[idx])
        by = np.lexsort((key, seg)) if depth else np.argsort(key, kind="stable")
        idx, key = idx[by], key[by]
        new = np.ones(len(idx), bool)
        new[1:] = (seg[1:] != seg[:-1]) | (key[1:] != key[:-1])
        seg = place[new][np.cumsum(new) - 1]
        alone = new & np.append(new[1:], True)
        done = alone | ((key & np.uint64(255)) == 0)
        order[place[done]], run[place[done]] = idx[done], seg[done]
        idx, seg, place, depth = idx[~done], seg[~done], place[~done], depth + 8
        if depth >= DEEP and len(idx):
            _by_rest(data, idx, seg, start[idx] + depth, end, order, run)
            break
    return order, run


def _by_rest(data, idx, seg, at, end, order, run) -> None:
    rest = [data[a:e].tobytes() for a, e in zip(at.tolist(), end[idx].tolist())]
    last, place, begin = None, 0, 0
    for s, r, i in sorted(zip(seg.tolist(), rest, idx.tolist())):
        if last is None or s != last[0]:
            place = begin = s
        elif r != last[1]:
            begin = place
        order[place], run[place] = i, begin
        place, last = place + 1, (s, r)


def _strings(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    data = raw[K.ranges(start, size)]
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(at), pa.py_buffer(data)]).cast(
        pa.string())


def _count(batches):
    """Rows (lang, source, term, n, n_docs) of each shard."""
    for chunk in K.chunks(batches, "text", SHARD_BYTES):
        lang, source = (pc.dictionary_encode(chunk.column(x)) for x in ("lang", "source"))
        group = (lang.indices.to_numpy().astype(np.int64) * len(source.dictionary)
                 + source.indices.to_numpy())
        groups, group = np.unique(group, return_inverse=True)
        raw, offsets = K.utf8(chunk.column("text"))
        words = K.Words(K.LOWER[raw], offsets, LETTERS)
        if not len(words):
            continue
        order, run = sort_pointers(words.raw, words.start, words.end)
        doc = words.doc()[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])
        heads = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        term = np.searchsorted(heads, run)
        cell, inverse = np.unique(term * len(groups) + group[doc], return_inverse=True)
        pick = order[heads][cell // len(groups)]
        of = groups[cell % len(groups)]
        yield pa.RecordBatch.from_arrays([
            lang.dictionary.take(pa.array(of // len(source.dictionary))),
            source.dictionary.take(pa.array(of % len(source.dictionary))),
            _strings(words.raw, words.start[pick], words.end[pick]),
            pa.array(np.bincount(inverse, minlength=len(cell))),
            pa.array(np.bincount(inverse, fresh, len(cell)).astype(np.int64))],
            ["lang", "source", "term", "n", "n_docs"])


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, n_docs): occurrences of a term in a group and documents that hold it."""
    read = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
                         for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    shards = K.bounded(read).mapInArrow(_count, "lang string, source string, term string, n long, n_docs long")
    return shards.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS, **columns: str) -> DataFrame:
    """Counts of the terms that at least ``least`` documents of the language hold, with the
    language's count, and ``head`` on one row of each term."""
    term = Window.partitionBy("lang", "term")
    return term_counts(docs, **columns).select(
        "lang", "source", "term", "n", F.sum("n").over(term).alias("n_lang"),
        F.sum("n_docs").over(term).alias("docs_lang"),
        (F.min("source").over(term) == F.col("source")).alias("head")).filter(
        F.col("docs_lang") >= least).drop("docs_lang")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)); in decimals where 64 bits don't hold it."""
    small = F.call_function("div", F.lit(SCALE).cast("long") * (count + 1), total + terms)
    large = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"),
                            (total + terms).cast("decimal(20,0)"))
    return F.lit(1) + F.when(count < 9 * 10**18 // SCALE - 1, small).otherwise(large)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _common(batches):
    """Last sum of the module's formula over blocks of terms; rows come sorted by lang, term."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        table = table.combine_chunks()
        lang, term = table.column("lang"), table.column("term")
        n = len(table)
        last = pc.and_(pc.equal(lang, lang[n - 1]), pc.equal(term, term[n - 1])).to_numpy()
        cut = int(np.argmax(last)) if n else 0
        held = table.slice(cut)
        yield from _pair_sums(table.slice(0, cut))
    if held is not None:
        yield from _pair_sums(held)


def _pair_sums(table: pa.Table):
    if not len(table):
        return
    lang, source, term = (table.column(x).combine_chunks().dictionary_encode() for x in ("lang", "source", "term"))
    lang, source, term = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (lang, source, term))
    l, s, t = (x.indices.to_numpy().astype(np.int64) for x in (lang, source, term))
    p, p0 = (table.column(x).to_numpy() for x in ("p", "p0"))
    for one in np.unique(l):
        own = np.flatnonzero(l == one)
        sources, col = np.unique(s[own], return_inverse=True)
        _, row = np.unique(t[own], return_inverse=True)
        n = len(sources)
        if n < 2:
            continue
        absent = np.ones(n, np.int64)
        absent[col] = p0[own]
        total = np.zeros((n, n), np.int64)
        by_row = np.argsort(row, kind="stable")
        step = max(1, CELLS // n)
        edges = np.searchsorted(row[by_row], np.arange(0, int(row.max()) + 1 + step, step))
        for a, b in zip(edges[:-1], edges[1:]):
            if a == b:
                continue
            pick = by_row[a:b]
            r = row[pick] - row[pick[0]]
            cells = np.zeros((int(r.max()) + 1, n), np.int64)
            cells[r, col[pick]] = p[own[pick]]
            there = cells > 0
            q = np.where(there, cells, absent)
            gain = (q - absent)
            for i in range(n):
                rows = there[:, i]
                if not rows.any():
                    continue
                x, y, z = q[rows, i][:, None], q[rows], absent[None, :]
                both = (x - y) ** 2 // y - (x - z) ** 2 // z
                if gain[rows].any():
                    both -= (absent[i] - y) ** 2 // y - (absent[i] - z) ** 2 // z
                total[i] += np.where(there[rows], both, 0).sum(0)
        i, j = np.nonzero(total)
        keep = i != j
        i, j = i[keep], j[keep]
        names = source.dictionary
        yield pa.RecordBatch.from_arrays(
            [pa.repeat(lang.dictionary[int(one)], len(i)), names.take(pa.array(sources[i])),
             names.take(pa.array(sources[j])), pa.array(total[i, j])], ["lang", "source", "other", "part"])


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
          least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): for each group its divergence from each
    other source of the language (part ``pair``) and the ``top`` terms that it holds more
    often than the language does (part ``term``)."""
    kept = materialize(kept_terms(docs, least, text=text, lang=lang, source=source), "divergence_terms")
    seen = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
                         for c, name in ((lang, "lang"), (source, "source"))]).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("head").cast("long")).alias("heads"))
    every = Window.partitionBy("lang")
    none = F.lit(0).cast("long")
    groups = materialize(seen.join(sums, ["lang", "source"], "left").select(
        "lang", "source", F.coalesce("total", none).alias("total"),
        F.coalesce(F.sum("total").over(every), none).alias("total_lang"),
        F.coalesce(F.sum("heads").over(every), none).alias("terms")).withColumn(
        # without terms nothing is shared out; any positive number does
        "p0", share(none, F.col("total"), F.greatest("terms", F.lit(1).cast("long")))), "divergence_groups")

    rows = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "p0", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("n_lang"), F.col("total_lang"), F.col("terms")).alias("q"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = rows.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                        divergence(F.col("p"), F.col("q")).alias("value")).withColumn(
        "rank", F.row_number().over(best)).filter(F.col("rank") <= top)

    shares = rows.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("k"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    wide, p, p0, q0, k = "decimal(38,0)", F.col("p"), F.col("p0"), F.col("q0"), F.col("k")
    met = shares.join(other, "lang").filter("source <> other")
    sides = met.select("lang", "source", "other", (k.cast(wide) * (divergence(p, q0) - divergence(p0, q0))).alias("part")).union(
        met.select("lang", F.col("other").alias("source"), F.col("source").alias("other"),
                   (k.cast(wide) * (divergence(q0, p) - divergence(q0, p0))).alias("part")))
    common = rows.select("lang", "source", "term", "p", "p0").repartition("lang", "term").sortWithinPartitions(
        "lang", "term").mapInArrow(_common, "lang string, source string, other string, part long")
    parts = sides.groupBy("lang", "source", "other").agg(F.sum("part").alias("part")).union(
        common.select("lang", "source", "other", F.col("part").cast(wide)))
    summed = parts.groupBy("lang", "source", "other").agg(F.sum("part").alias("part"))
    flat = groups.join(other, "lang").filter("source <> other").select(
        "lang", "source", "other", F.when(F.col("terms") > 0, F.col("terms").cast(wide) * divergence(p0, q0))
        .otherwise(F.lit(0)).alias("flat"))
    pairs = flat.join(summed, ["lang", "source", "other"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"),
        (F.col("flat") + F.coalesce("part", F.lit(0))).cast("long").alias("value")).withColumn(
        "rank", F.row_number().over(best))
    return pairs.union(terms)


def op13_source_divergence(spark, sf_dir):
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
v AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN v USING (lang, term)
  GROUP BY lang, source, term),
vl AS (SELECT lang, count(*) AS v, sum(n) AS nl FROM v GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
tot AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
p AS MATERIALIZED (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS k,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(tot.n, 0) + vl.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (v.n + 1)) // (vl.nl + vl.v)::HUGEINT AS q
  FROM g JOIN v ON g.lang = v.lang JOIN vl ON vl.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
  LEFT JOIN tot ON tot.lang = g.lang AND tot.source = g.source),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
o AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value
    FROM pairs LEFT JOIN pv USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE k > 0 AND p > q)
SELECT * FROM (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part
  ORDER BY value DESC, item) AS INTEGER) AS rank FROM o) WHERE part = 'pair' OR rank <= 200"""
