"""Language ID by unigram piece models, marginalised over all segmentations.

A word (run of letters: ASCII letters and non-ASCII bytes, lower-cased in
ASCII, with a space in front) is scored by the forward algorithm: the sum over
every way to cut it into pieces of a fixed public vocabulary, each piece with
its probability in a language.  A text's score in a language is the sum of its
words' log-probabilities; the language with the best sum wins and its
posterior under equal priors is the score.

The piece probabilities come from expectation maximisation (forward-backward)
over the words of at most ``SAMPLE_PER_LANG`` training documents of each
language.  Words are counted by Spark, expected piece counts are summed by
Spark, and only the table of pieces by languages reaches the driver.  Scoring
is one map over the documents; each distinct word of a chunk is scored once.

Defined results: null texts and texts without a letter are ``und`` with score
0, as is everything when no row teaches a language; an equal posterior goes to
the smaller language name; runs of any length are scored over all their
segmentations (learning takes runs in parts of ``RUN`` bytes); a null doc_id is
neither held out nor learned from; repeated rows each get a row.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import textkit as K

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Bound of the sample that each language is learned from.
SAMPLE_PER_LANG = 3_000
#: Most languages that are learned; more distinct values are refused.
MAX_LANGS = 1_000
ROUNDS = 3
SMOOTH = 0.02
#: Bytes of a segment that is scored beside others (longer ones alone), and of a word with
#: its space in learning.
RUN = 512
#: Bytes of a word that is searched for segments at all, and of a block of a longer one.
LONG_WORD = 1 << 16
#: Bytes of words by languages that are scored together.
GROUP = 4 << 20

LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True
ASCII_LETTER = LETTER & (np.arange(256) < 0x80)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def load_pieces(path: str = VOCABULARY) -> list[bytes]:
    """The vocabulary's pieces as bytes (word starts as a space), all single bytes first."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {bytes([b]) for b in range(256)}
    for k in range(model.get_piece_size()):
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k)):
            piece = K.LOWER[np.frombuffer(model.id_to_piece(k).replace("▁", " ").encode(), np.uint8)]
            pieces.add(piece.tobytes())
    return sorted(pieces, key=lambda p: (len(p), p))


class Pieces:
    """Piece numbers by name: two direct tables, checked against the whole name."""

    BITS = 19

    def __init__(self, pieces: list[bytes]):
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        self.sizes = sorted({len(p) for p in pieces})
        self.names = K.Rolling(K.BYTE_VALUES[data]).name(ends - [len(p) for p in pieces], ends)
        mask = np.uint64((1 << self.BITS) - 1)
        self.tables = [np.zeros(1 << self.BITS, np.int32) for _ in range(3)]
        left = np.arange(len(pieces))
        for k, table in enumerate(self.tables):
            slot = (self.names[left] >> np.uint64(k * self.BITS)) & mask
            table[slot] = left
            left = left[table[slot] != left]
        assert not len(left)

    def __call__(self, names: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 where there is none."""
        mask = np.uint64((1 << self.BITS) - 1)
        out = np.full(len(names), -1, np.int32)
        todo = np.arange(len(names))
        for k, table in enumerate(self.tables):
            found = table[(names[todo] >> np.uint64(k * self.BITS)) & mask]
            hit = self.names[found] == names[todo]
            out[todo[hit]] = found[hit]
            todo = todo[~hit]
        return out


def word_parts(raw: np.ndarray, offsets: np.ndarray):
    """(lower-cased bytes, starts, ends, document) of a chunk's letter runs, in parts that
    have RUN bytes with their space."""
    w = K.Words(raw, offsets, LETTER)
    size = w.end - w.start
    parts = -(-size // (RUN - 1))
    which = np.repeat(np.arange(len(size)), parts)
    start = w.start[which] + (RUN - 1) * K.ranges(np.zeros_like(parts), parts)
    return K.LOWER[raw], start, np.minimum(start + RUN - 1, w.end[which]), w.doc()[which]


def gather(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of a space and their bytes, end to end; with their offsets."""
    size = end - start + 1
    at = np.concatenate([[0], np.cumsum(size)])
    data = raw[np.maximum(K.ranges(start - 1, size), 0)]
    data[at[:-1]] = 0x20
    return data, at


def piece_ids(data: np.ndarray, left: np.ndarray, pieces: Pieces) -> np.ndarray:
    """For every size of piece and byte the piece that begins there, -1 if none;
    ``left`` are the bytes up to the end of the word."""
    roll = K.Rolling(K.BYTE_VALUES[data])
    ids = np.full((len(pieces.sizes), len(left)), -1, np.int32)
    for j, k in enumerate(pieces.sizes):
        pos = np.flatnonzero(left >= k)
        ids[j, pos] = pieces(roll.name(pos, pos + k))
    return ids


class Lattice:
    """All cuts of a set of words into pieces.  Where no piece crosses a position, what is
    before and after it are independent: words are taken apart there, exactly.  These
    segments are handled longest first, so that a step's segments are a prefix; ``rest`` are
    those over ``RUN`` bytes, which are left to :func:`run_forward`."""

    def __init__(self, data: np.ndarray, at: np.ndarray, pieces: Pieces):
        self.sizes = pieces.sizes
        self.ids = piece_ids(data, np.repeat(at[1:], np.diff(at)) - np.arange(len(data)), pieces)
        reach = np.arange(len(data))
        for j, k in enumerate(self.sizes):
            on = np.flatnonzero(self.ids[j] >= 0)
            reach[on] = on + k
        apart = np.concatenate([[0], np.flatnonzero(np.maximum.accumulate(reach)[:-1] <= np.arange(1, len(data))) + 1])
        size = np.diff(np.append(apart, len(data)))
        owner = np.searchsorted(at, apart, "right") - 1
        self.rest = [(int(owner[k]), int(apart[k]), int(apart[k] + size[k])) for k in np.flatnonzero(size > RUN)]
        order = np.argsort(-size, kind="stable")[len(self.rest):]
        self.start, self.size, self.owner = apart[order], size[order], owner[order]
        self.longest = int(self.size[0]) if len(order) else 0
        # segments that still have a byte t, for t = 0, 1, ...
        self.alive = np.searchsorted(-self.size, -np.arange(self.longest + 1), "right")

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """Log-probabilities of the segments; ``scales`` keeps the sums by position."""
        n, langs = len(self.size), prob.shape[1]
        self.scales = [np.zeros((n, langs))]
        out = np.zeros((n, langs))
        for t in range(1, self.longest + 1):
            live = int(self.alive[t])
            total = np.zeros((live, langs))
            for j, k in enumerate(self.sizes):
                if k > t:
                    break
                ids = self.ids[j, self.start[:live] + t - k]
                on = np.flatnonzero(ids >= 0)
                if len(on):
                    # sums are kept relative to the scale of the position before
                    total[on] += prob[ids[on]] * np.exp(self.scales[t - k][on] - self.scales[t - 1][on])
            self.scales.append(self.scales[t - 1][:live] + np.log(total))
            ends = slice(int(self.alive[t + 1]) if t < self.longest else 0, live)
            out[ends] = self.scales[t][ends]
        return out


def run_forward(data: np.ndarray, pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Log-probabilities of one long word or segment by language: one step for each byte,
    with the sums of the last positions that a piece can reach back to."""
    back, sizes = pieces.sizes[-1], np.array(pieces.sizes)
    some = np.concatenate([prob, np.zeros((1, prob.shape[1]))])  # the last row stands for no piece
    log = np.zeros(prob.shape[1])
    sums = np.zeros((back, prob.shape[1]))
    sums[-1] = 1.0
    block = max(1024, LONG_WORD // max(1, prob.shape[1]))
    for lo in range(0, len(data), block):
        hi = min(lo + block, len(data))
        first = max(lo - back, 0)
        ids = piece_ids(data[first:hi], hi - np.arange(first, hi), pieces)
        ends = np.arange(lo + 1, hi + 1)[:, None] - sizes - first  # where a piece that ends here begins
        found = np.where(ends >= 0, ids[np.arange(len(sizes)), np.maximum(ends, 0)], -1)
        window = np.concatenate([sums, np.zeros((hi - lo, prob.shape[1]))])
        for t in range(hi - lo):
            now = (window[back + t - sizes] * some[found[t]]).sum(0)
            window[back + t] = now
            if t % 8 == 7:
                log += np.log(now)
                window[t:back + t + 1] /= now
        sums = window[-back:]
    return log + np.log(sums[-1])


def log_forward(data, at, pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Log-probabilities of words (end to end in ``data``, at the offsets ``at``) by language."""
    out = np.zeros((len(at) - 1, prob.shape[1]))
    size = np.diff(at)
    for w in np.flatnonzero(size > LONG_WORD).tolist():
        out[w] = run_forward(data[at[w]:at[w + 1]], pieces, prob)
    short = np.flatnonzero(size <= LONG_WORD)
    group = np.cumsum(size[short]) * prob.shape[1] // GROUP
    for words in np.split(short, np.flatnonzero(np.diff(group)) + 1) if len(short) else []:
        part = data[K.ranges(at[words], size[words])]
        lat = Lattice(part, np.concatenate([[0], np.cumsum(size[words])]), pieces)
        np.add.at(out, words[lat.owner], lat.forward(prob))
        for w, s, e in lat.rest:
            out[words[w]] += run_forward(part[s:e], pieces, prob)
    return out


def expected(data, at, counts: np.ndarray, pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Expected uses of each piece by language, words of at most RUN bytes weighted by ``counts``."""
    out = np.zeros((len(prob), prob.shape[1]))
    if len(at) < 2:
        return out
    lat = Lattice(data, at, pieces)
    whole, counts = lat.forward(prob), counts[lat.owner]
    beta: dict[int, np.ndarray] = {}
    for t in range(lat.longest - 1, -1, -1):
        total = np.full((int(lat.alive[t + 1]), prob.shape[1]), -np.inf)
        for j, k in enumerate(lat.sizes):
            if k > lat.longest - t:
                break
            reach = int(lat.alive[t + k])
            ids = lat.ids[j, lat.start[:reach] + t]
            on = np.flatnonzero(ids >= 0)
            if not len(on):
                continue
            after = np.where((lat.size[on] == t + k)[:, None], 0.0, _padded(beta.get(t + k), reach)[on])
            step = np.log(prob[ids[on]]) + after
            use = np.exp(lat.scales[t][on] + step - whole[on]) * counts[on]
            for lang in range(prob.shape[1]):
                out[:, lang] += np.bincount(ids[on], use[:, lang], len(prob))
            total[on] = np.logaddexp(total[on], step)
        beta[t] = total
        beta.pop(t + lat.sizes[-1] + 1, None)
    return out


def _padded(x, n: int):
    if x is None:
        return np.zeros((n, 1))
    return x if len(x) >= n else np.concatenate([x, np.zeros((n - len(x), x.shape[1]))])


def _count_words(batches):
    """(lang, word, count) of each chunk."""
    for batch in K.chunks(batches, "text"):
        raw, offsets = K.utf8(batch.column(batch.schema.names.index("text")))
        low, start, end, doc = word_parts(raw, offsets)
        if not len(start):
            continue
        lang = batch.column(batch.schema.names.index("lang")).dictionary_encode()
        code = np.asarray(lang.indices)[doc]
        name = K.Rolling(K.BYTE_VALUES[low]).name(start, end) + code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        _, first, n = np.unique(name, return_index=True, return_counts=True)
        words = [low[s:e].tobytes() for s, e in zip(start[first], end[first])]
        yield pa.RecordBatch.from_arrays(
            [lang.dictionary.take(pa.array(code[first])), pa.array(words, pa.binary()), pa.array(n)],
            ["lang", "word", "n"])


def _expect(batches, langs: list[str], pieces: Pieces, prob: np.ndarray):
    """(piece, lang, expected uses) of a partition's words."""
    total = np.zeros((len(prob), len(langs)))
    number = {x: k for k, x in enumerate(langs)}
    for batch in batches:
        for at0 in range(0, batch.num_rows, 20_000):
            part = batch.slice(at0, 20_000).to_pydict()
            counts = np.zeros((len(part["n"]), len(langs)))
            counts[np.arange(len(part["n"])), [number[x] for x in part["lang"]]] = part["n"]
            words = [b" " + w for w in part["word"]]
            at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
            total += expected(np.frombuffer(b"".join(words), np.uint8), at, counts, pieces, prob)
    p, k = np.nonzero(total)
    if len(p):
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int32()),
                                          pa.array(total[p, k])], ["piece", "lang", "uses"])


class Model:
    def __init__(self, langs: list[str], pieces: list[bytes], prob: np.ndarray):
        self.langs, self.pieces, self.prob = langs, Pieces(pieces), prob


def learn(rows: DataFrame, path: str = VOCABULARY, per_lang: int = SAMPLE_PER_LANG,
          rounds: int = ROUNDS) -> Model:
    """Fit from rows (doc_id, text, lang) with a non-null lang and doc_id."""
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages to learn")
    langs, pieces = sorted(counts), load_pieces(path)
    if not langs:
        return Model([], pieces, np.zeros((len(pieces), 0)))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, counts[lang])])
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), share[F.col("lang")]) < per_lang).select("lang", "text")
    words = materialize(sample.mapInArrow(_count_words, "lang string, word binary, n long")
                        .groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    table = Pieces(pieces)
    prob = np.full((len(pieces), len(langs)), 1.0 / len(pieces))
    for _ in range(rounds):
        now = prob
        got = words.mapInArrow(lambda b: _expect(b, langs, table, now), "piece int, lang int, uses double") \
            .groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toArrow()
        uses = np.zeros_like(prob)
        uses[got["piece"].to_numpy(), got["lang"].to_numpy()] = got["uses"].to_numpy()
        pooled = (uses.sum(1) + SMOOTH) / (uses.sum() + SMOOTH * len(uses))
        uses += SMOOTH * len(uses) * pooled[:, None]
        prob = uses / uses.sum(0)
    return Model(langs, pieces, prob)


def _predict(batches, model: Model, text: str):
    names = ["lang_pred", "score"]
    for batch in K.chunks(batches, text):
        column = batch.column(batch.schema.names.index(text))
        raw, offsets = K.utf8(column)
        words = K.Words(K.LOWER[raw], offsets, LETTER)
        n, langs = batch.num_rows, len(model.langs)
        total = np.zeros((n, langs))
        if len(words) and langs:
            doc = words.doc()
            _, first, back = np.unique(words.names(), return_index=True, return_inverse=True)
            score = log_forward(*gather(words.raw, words.start[first], words.end[first]), model.pieces, model.prob)
            for k in range(langs):
                total[:, k] = np.bincount(doc, score[back, k], n)
        known = np.concatenate([[0], np.cumsum(ASCII_LETTER[raw])])
        letters = known[offsets[1:]] > known[offsets[:-1]]
        for d in np.flatnonzero(~letters & (np.diff(offsets) > 0)).tolist():
            letters[d] = any(map(str.isalpha, column[d].as_py()))
        if langs:
            best = total.argmax(1)
            post = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            said = [model.langs[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist())]
            post = np.where(letters, post, 0.0)
        else:
            said, post = ["und"] * n, np.zeros(n)
        kept = [k for k, x in enumerate(batch.schema.names) if x not in names]
        yield pa.RecordBatch.from_arrays(
            [batch.column(k) for k in kept] + [pa.array(said, pa.string()), pa.array(post)],
            [batch.schema.names[k] for k in kept] + names)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``lang_pred`` and ``score`` (columns of these names give way)."""
    docs, schema = K.fields(K.bounded(docs), "lang_pred string, score double")
    return docs.mapInArrow(lambda b: _predict(b, model, text), schema)


def identify(docs: DataFrame, path: str = VOCABULARY, text: str = "text", lang: str = "lang",
             doc_id: str = "doc_id") -> DataFrame:
    """Learn from the rows that are not held out, then predict every row (with ``held_out``)."""
    teach = docs.filter(~held_out(F.col(doc_id)) & F.col(doc_id).isNotNull() & F.col(lang).isNotNull()) \
        .select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    return predict(docs.withColumn("held_out", held_out(F.col(doc_id))), learn(teach, path), text)


def op5_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs.select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")
