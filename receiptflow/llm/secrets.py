"""Secret scans: fixed patterns plus a linear-chain conditional random field.

The patterns give the base spans.  The field tags tokens (runs of letters,
digits and ``+/_.-``) as outside, begin or inside of a secret.  Its emission
features are the token's shape (length, character classes, changes of class,
first characters), the neighbouring tokens, the characters between them, and
features of the whole text (length, share of digits).  Weights are fitted by
maximum likelihood (forward-backward) on at most ``SAMPLE_DOCS`` distinct texts,
with the base spans as labels; decoding is Viterbi over every whole text.

So that the field does not just repeat the patterns, each text with a secret is
also learned from in a disguise: the marker before the secret (keyword, sign and
quote) becomes a word of the text and the secret itself random characters of a
wider alphabet, which no pattern takes.  What tells it then is its shape among
its neighbours.  Texts without a secret give the window at their middle and that
around the token that looks most like a secret, at most ``PLAIN_SEQUENCES`` in all.

Decoding is exact and cheap: where "outside" leads by more than any path can
gain back through two transitions, the best path is outside, so only the runs
between such tokens are decoded, all at once.  A decoded span that touches no
base span is added as kind ``crf``; base spans always stay.

Defined results: null and empty texts have no spans; offsets count code points;
repeated rows are scanned one by one; an empty table gives no rows; a sample
without any secret gives a field that adds nothing.
"""
from __future__ import annotations

import re
import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

#: Bound of the sample that the field is fitted on: distinct texts, and sequences without a secret.
SAMPLE_DOCS = 8_000
PLAIN_SEQUENCES = 4_000
#: Alphabets and lengths of secrets in disguise.
ALPHABETS = [string.ascii_letters + string.digits, string.ascii_uppercase + string.digits,
             string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/_-"]
LENGTHS = (12, 44)
#: Tokens around a labelled or a random token that make a training sequence.
SIDE = 12
EPOCHS = 80

#: Fixed patterns by kind: pattern, group that is measured, least length.
BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.IGNORECASE | re.ASCII), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
]
#: The same matches with the least length inside, for patterns of one class of characters.
FAST = {"access": re.compile(r"AKIA[A-Z0-9]{14,}"), "hex": re.compile(r"[0-9a-f]{16,}")}

TOKEN = np.zeros(256, bool)
TOKEN[0x30:0x3A] = TOKEN[0x41:0x5B] = TOKEN[0x61:0x7B] = TOKEN[0x80:] = True
TOKEN[[ord(c) for c in "+/_.-"]] = True

#: Class of a byte: 0 other, 1 digit, 2 a-f, 3 g-z, 4 upper case, 5 not ASCII.
KIND = np.zeros(256, np.uint8)
KIND[0x30:0x3A] = 1
KIND[0x61:0x67] = 2
KIND[0x67:0x7B] = 3
KIND[0x41:0x5B] = 4
KIND[0x80:] = 5

#: Number of values of each feature.
SIZES = [12, 64, 12, 10, 8, 256, 64, 12, 64, 16, 256]
#: Stands for a secret in a redacted text.
MASK = "[SECRET]"
STATES = 3  # outside, begin, inside
SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    out = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        if kind in FAST:
            out += [(m.start(), rank, m.end(), kind) for m in FAST[kind].finditer(text)]
        else:
            out += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text)
                    if m.end(group) - m.start(group) >= least]
    return [(s, e, kind) for s, _, e, kind in sorted(out)]


def _log_bucket(x: np.ndarray, top: int) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(x, 0) + 1.0) * 2, top - 1).astype(np.int64)


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[K.Words, np.ndarray]:
    """Tokens of a chunk and their feature values, one column for each of SIZES."""
    t = K.Words(raw, offsets, TOKEN)
    n = len(t)
    if not n:
        return t, np.zeros((0, len(SIZES)), np.int64)
    s, e, size = t.start, t.end, t.end - t.start
    kind = KIND[raw]
    count = {}
    for k in range(6):
        sums = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)])
        count[k] = sums[e] - sums[s]
    change = np.concatenate([[0, 0], np.cumsum(kind[1:] != kind[:-1], dtype=np.int32)])
    turns = change[e] - change[s + 1]
    mask = sum((count[k] > 0).astype(np.int64) << k for k in range(6))
    length = np.minimum(_log_bucket(size, 12), 11)
    hexes = count[1] + count[2]
    digit = np.minimum(count[1] * 5 // size, 5) + 6 * (hexes == size)
    mark = np.concatenate([[0], np.cumsum((raw == 0x3D) | (raw == 0x3A), dtype=np.int32)])
    quote = np.concatenate([[0], np.cumsum((raw == 0x22) | (raw == 0x27), dtype=np.int32)])
    doc = t.doc()
    left = np.concatenate([[0], e[:-1]])
    left = np.maximum(left, offsets[doc])  # characters between tokens of one text only
    gap = ((mark[s] > mark[left]) * 1 + (quote[s] > quote[left]) * 2 + (s - left > 1) * 4)
    low = K.Rolling(K.BYTE_VALUES[K.LOWER[raw]])
    word = (low.name(s, e) >> np.uint64(56)).astype(np.int64)
    head = (low.name(s, np.minimum(s + 4, e)) >> np.uint64(56)).astype(np.int64)
    first = np.zeros(n, bool)
    first[t.first[:-1][np.diff(t.first) > 0]] = True
    final = np.zeros(n, bool)
    final[t.first[1:][np.diff(t.first) > 0] - 1] = True

    def shifted(x, by, edge):
        out = np.roll(x, by)
        out[first if by > 0 else final] = edge
        return out

    digits = np.concatenate([[0], np.cumsum(kind == 1, dtype=np.int64)])
    whole = np.diff(offsets)
    share = np.minimum((digits[offsets[1:]] - digits[offsets[:-1]]) * 40 // np.maximum(whole, 1), 3)
    file = share * 4 + np.minimum(_log_bucket(whole, 40) // 8, 3)
    return t, np.stack([length, mask, digit, np.minimum(turns, 9), gap, shifted(word, 1, 0),
                        shifted(mask, -1, 0), shifted(length, 1, 0), shifted(mask, 1, 0),
                        file[doc], head], 1)


OFFSETS = np.concatenate([[0], np.cumsum(SIZES)])


def _byte_spans(text: str, spans) -> list[tuple[int, int]]:
    """Code-point spans of the secret part as byte spans."""
    if text.isascii():
        return spans
    out = []
    for s, e in spans:
        a = len(text[:s].encode())
        out.append((a, a + len(text[s:e].encode())))
    return out


def _secret_parts(text: str) -> list[tuple[int, int]]:
    parts = []
    for kind, pattern, group, least in BASE:
        for m in FAST.get(kind, pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                parts.append((m.start(group), m.end(group)))
    return parts


def disguised(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with every secret and its marker disguised, and the spans of the secrets."""
    rng = np.random.default_rng(zlib.crc32(text.encode()))
    found = sorted((m.start(), -m.end(), *m.span(group)) for kind, pattern, group, least in BASE
                   for m in FAST.get(kind, pattern).finditer(text) if m.end(group) - m.start(group) >= least)
    taken: list[tuple[int, int, int, int]] = []
    for f in found:
        if not taken or f[0] >= taken[-1][3]:
            taken.append(f)
    edges = [0, *(x for start, _, _, e in taken for x in (start, e)), len(text)]
    words = [w for a, b in zip(edges[::2], edges[1::2]) for w in re.findall(r"[^\W\d_]{2,}", text[a:b])] or ["a"]
    out, parts, size, at = [], [], 0, 0
    for start, _, s, e in taken:
        letters = ALPHABETS[rng.integers(len(ALPHABETS))]
        secret = "".join(letters[k] for k in rng.integers(len(letters), size=rng.integers(*LENGTHS)))
        before = text[at:start] + (words[rng.integers(len(words))] + " " if start < s else "")
        size += len(before)
        out += [before, secret]
        parts.append((size, size + len(secret)))
        size += len(secret)
        at = e + (start < s and text[e:e + 1] in ("\"", "'"))
    return "".join(out) + text[at:], parts


def _sequences(texts: list[str], parts: list[list[tuple[int, int]]], plain: bool):
    """Feature values and tags of SIDE tokens on each side of every secret and, if
    ``plain``, of each text's middle and of its most secret-like token outside."""
    raw, offsets = K.utf8(pa.array(texts, pa.large_string()))
    t, x = features(raw, offsets)
    tags = np.zeros(len(t), np.int8)
    for d, spans in enumerate(parts):
        for a, b in _byte_spans(texts[d], spans):
            k = np.searchsorted(t.end, offsets[d] + a, "right")
            m = np.searchsorted(t.start, offsets[d] + b, "left")
            tags[k:m] = 2
            if k < m:
                tags[k] = 1
    doc = t.doc()
    points = set(np.flatnonzero(tags == 1).tolist())
    if plain:
        some = t.first[1:] > t.first[:-1]
        points.update(((t.first[:-1] + t.first[1:]) // 2)[some].tolist())
        looks = np.where(tags > 0, -1, 2 * x[:, 3] + x[:, 0])  # changes of class, length
        best = np.lexsort((-looks, doc))
        points.update(best[np.searchsorted(doc, np.flatnonzero(some))].tolist())
    for at in sorted(points):
        lo, hi = max(at - SIDE, t.first[doc[at]]), min(at + SIDE, t.first[doc[at] + 1])
        yield (x[lo:hi] + OFFSETS[:-1]).astype(np.int16).tobytes(), tags[lo:hi].tobytes()


def _examples(batches, text: str):
    """Training sequences of texts as they are and, where they hold a secret, in disguise."""
    for batch in K.chunks(batches, text):
        texts = [x or "" for x in batch.column(batch.schema.names.index(text)).to_pylist()]
        parts = [_secret_parts(x) for x in texts]
        hidden = [disguised(x) for x, p in zip(texts, parts) if p]
        rows = [*_sequences(texts, parts, True), *_sequences([x for x, _ in hidden], [p for _, p in hidden], False)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)], ["x", "y"])


class Crf:
    """Weights by feature value and state, transitions, and first-state scores."""

    def __init__(self):
        self.w = np.zeros((OFFSETS[-1], STATES))
        self.trans = np.zeros((STATES, STATES))
        self.trans[0, 2] = -8.0  # inside never follows outside

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return self.w[x + OFFSETS[:-1]].sum(1)

    def fit(self, xs: list[np.ndarray], ys: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.1):
        """Adam on the penalised log-likelihood; xs hold global feature numbers."""
        if not any((y > 0).any() for y in ys):
            self.w[OFFSETS[0]:OFFSETS[1], 0] = 50.0
            return self
        longest = max(map(len, ys))
        x = np.zeros((len(xs), longest, len(SIZES)), np.int64)
        y = np.zeros((len(xs), longest), np.int64)
        live = np.zeros((len(xs), longest))
        for k, (a, b) in enumerate(zip(xs, ys)):
            x[k, :len(b)], y[k, :len(b)], live[k, :len(b)] = a, b, 1
        total = live.sum()
        moments = [np.zeros_like(p) for p in (self.w, self.trans)], [np.zeros_like(p) for p in (self.w, self.trans)]
        gold = np.eye(STATES)[y] * live[..., None]
        gold_t = np.einsum("nts,ntr->sr", gold[:, :-1], gold[:, 1:])
        for step in range(1, epochs + 1):
            em = self.w[x].sum(2)
            p, pair = self._marginals(em, live)
            grad_w = np.zeros_like(self.w)
            diff = (gold - p) * live[..., None]
            for s in range(STATES):
                grad_w[:, s] = np.bincount(x.ravel(), np.repeat(diff[..., s].ravel(), len(SIZES)), OFFSETS[-1])
            for k, (param, grad) in enumerate(((self.w, grad_w / total - 1e-6 * self.w),
                                               (self.trans, (gold_t - pair) / total - 1e-6 * self.trans))):
                moments[0][k] = 0.9 * moments[0][k] + 0.1 * grad
                moments[1][k] = 0.999 * moments[1][k] + 0.001 * grad * grad
                param += rate * (moments[0][k] / (1 - 0.9**step)) / (
                    np.sqrt(moments[1][k] / (1 - 0.999**step)) + 1e-8)
            self.trans[0, 2] = -8.0
        return self

    def _marginals(self, em, live):
        """Token marginals and expected transitions of padded sequences (scaled
        forward and backward sums)."""
        n, length, _ = em.shape
        e, step = np.exp(em - em.max(2, keepdims=True)), np.exp(self.trans)
        f, b = np.empty_like(e), np.ones_like(e)
        f[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        for k in range(1, length):
            x = (f[:, k - 1] @ step) * e[:, k]
            f[:, k] = np.where(live[:, k, None] > 0, x / x.sum(1, keepdims=True), f[:, k - 1])
        for k in range(length - 2, -1, -1):
            x = (e[:, k + 1] * b[:, k + 1]) @ step.T
            b[:, k] = np.where(live[:, k + 1, None] > 0, x / x.sum(1, keepdims=True), 1.0)
        p = f * b
        p *= live[..., None] / p.sum(2, keepdims=True)
        joint = f[:, :-1, :, None] * step * (e[:, 1:] * b[:, 1:])[:, :, None, :]
        joint *= live[:, 1:, None, None] / joint.sum((2, 3), keepdims=True)
        return p, joint.sum((0, 1))

    def decode(self, em: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best state of every token; ``first`` marks tokens that begin a text."""
        n = len(em)
        out = np.zeros(n, np.int8)
        sure = self._surely_outside(em)
        opens = np.flatnonzero(~sure & (np.concatenate([[True], sure[:-1]]) | first)) if n else np.zeros(0, int)
        if not len(opens):
            return out
        stops = np.flatnonzero(~sure & (np.concatenate([sure[1:], [True]]) |
                                        np.concatenate([first[1:], [True]]))) + 1
        length = stops - opens
        for size in np.unique(np.minimum(2 ** np.ceil(np.log2(length)).astype(int), length.max())):
            group = (length <= size) & (length > size // 2) if size > 1 else length == 1
            if group.any():
                self._viterbi(em, first, opens[group], length[group], out)
        return out

    def _surely_outside(self, em: np.ndarray) -> np.ndarray:
        """Tokens that are outside on the best path, whatever their neighbours are: from
        any path with another state there, the path with outside there (and with begin
        for an inside that follows) scores more."""
        t = self.trans
        tail = max(0.0, (t[2] - t[1]).max())   # of what follows a begin that was an inside
        follow = np.append(em[1:, 2] - em[1:, 1], 0.0)
        ahead = {s: max(0.0, (t[:, s] - t[:, 0]).max()) for s in (1, 2)}
        sure = np.ones(len(em), bool)
        for s in (1, 2):
            plain = max(0.0, (t[s, :2] - t[0, :2]).max())
            inside = t[s, 2] - t[0, 1] + tail + follow
            sure &= em[:, 0] - em[:, s] > ahead[s] + np.maximum(plain, inside)
        return sure

    def _viterbi(self, em, first, at, length, out):
        longest, n = int(length.max()), len(em)
        row = np.arange(len(at))
        # a neighbour outside the run is surely outside, or there is none
        start = np.where(first[at][:, None], 0.0, self.trans[0])
        score = em[at] + start
        back = np.zeros((len(at), longest, STATES), np.int8)
        for k in range(1, longest):
            paths = score[:, :, None] + self.trans
            best = paths.argmax(1)
            back[:, k] = best
            new = np.take_along_axis(paths, best[:, None, :], 1)[:, 0] + em[np.minimum(at + k, n - 1)]
            score = np.where((k < length)[:, None], new, score)
        ends_inside = np.concatenate([~first[1:], [False]])[at + length - 1]
        state = (score + np.where(ends_inside[:, None], self.trans[:, 0], 0.0)).argmax(1)
        for k in range(longest - 1, -1, -1):
            on = k < length
            out[at[on] + k] = state[on]
            if k:
                state = np.where(on, back[row, k, state], state)


def fit_field(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS) -> Crf:
    """Fit the field on the ``sample_docs`` distinct texts with the least hash, so that reruns
    agree and a text that many rows hold counts once.  What travels of the other rows is a hash."""
    name = F.xxhash64(F.col(text), F.lit(5))
    drawn = docs.filter(F.col(text).isNotNull()).select(name.alias("name")).distinct().orderBy("name").limit(sample_docs)
    names = [r.name for r in drawn.collect()]
    chosen = F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in names], "name long"))
    rows = docs.select(F.col(text).alias(text), name.alias("name")).join(chosen, "name", "left_semi") \
        .groupBy("name").agg(F.min(text).alias(text)).select(text)
    got = sorted(K.bounded(rows).mapInArrow(lambda b: _examples(b, text), "x binary, y binary").collect())
    plain = [r for r in got if not any(r.y)]
    got = [r for r in got if any(r.y)] + plain[::max(1, -(-len(plain) // PLAIN_SEQUENCES))]
    return Crf().fit([np.frombuffer(r.x, np.int16).reshape(-1, len(SIZES)).astype(np.int64) for r in got],
                     [np.frombuffer(r.y, np.int8) for r in got])


def _points(raw: np.ndarray, at: int, positions: list[int]) -> list[int]:
    """Byte positions of a text that begins at ``at`` as code points."""
    return [p - at - int(np.count_nonzero((raw[at:p] & 0xC0) == 0x80)) for p in positions]


def redacted(text: str | None, spans) -> str | None:
    """The text with every run of spans replaced by ``MASK``."""
    if text is None:
        return None
    out, at = [], 0
    for s, e, _ in sorted(spans):
        if s >= at:
            out += [text[at:s], MASK]
        at = max(at, e)
    return "".join(out) + text[at:]


def _scan(batches, text: str, field: Crf, redact: bool):
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "spans_list", "redacted"][:7 if redact else 6]
    for batch in K.chunks(batches, text):
        column = batch.column(batch.schema.names.index(text))
        raw, offsets = K.utf8(column)
        t, x = features(raw, offsets)
        first = np.zeros(len(t), bool)
        first[t.first[:-1][np.diff(t.first) > 0]] = True
        tags = field.decode(field.emissions(x), first) if len(t) else np.zeros(0, np.int8)
        tagged = np.flatnonzero(tags)
        tagged_doc = np.searchsorted(t.first, tagged, "right") - 1
        edges = np.searchsorted(tagged_doc, np.arange(batch.num_rows + 1))
        cols: list[list] = [[] for _ in names]
        for d, value in enumerate(column.to_pylist()):
            base = base_spans(value or "")
            extra = []
            for k in tagged[edges[d]:edges[d + 1]].tolist():
                if tags[k] == 2 and extra and extra[-1][2] == k:
                    extra[-1] = (extra[-1][0], t.end[k], k + 1)
                else:
                    extra.append((t.start[k], t.end[k], k + 1))
            more = []
            for s, e, _ in extra:
                s, e = _points(raw, offsets[d], [s, e])
                if not any(s < b and a < e for a, b, _ in base):
                    more.append((s, e, "crf"))
            rank = {kind: k for k, kind in enumerate(("assign", "access", "hex", "crf"))}
            spans = sorted([*base, *more], key=lambda x: (x[0], rank[x[2]], x[1]))
            said = ["%s:%d:%d" % (k, s, e) for s, e, k in base]
            cols[0].append(sum(k == "assign" for *_, k in base))
            cols[1].append(sum(k == "access" for *_, k in base))
            cols[2].append(sum(k == "hex" for *_, k in base))
            cols[3].append(K.sha256(",".join(said).encode()))
            cols[4].append(",".join("%s:%d:%d" % (k, s, e) for s, e, k in spans))
            cols[5].append([{"kind": k, "start": s, "end": e} for s, e, k in spans])
            if redact:
                cols[6].append(redacted(value, spans))
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [SPAN, pa.string()]
        kept = [k for k, name in enumerate(batch.schema.names) if name not in names]
        yield pa.RecordBatch.from_arrays(
            [batch.column(k) for k in kept] + [pa.array(c, kind) for c, kind in zip(cols, types)],
            [batch.schema.names[k] for k in kept] + names)


def scan_secrets(docs: DataFrame, text: str = "text", field: Crf | None = None,
                 redact: bool = False) -> DataFrame:
    """Every row of ``docs`` with its secrets: counts by kind, digests, ``spans`` as
    text, ``spans_list`` as array and, if asked for, the ``redacted`` text.
    Columns of the same names give way."""
    field = field or fit_field(docs, text)
    docs, schema = K.fields(K.bounded(docs), "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
                            "spans_list array<struct<kind:string,start:int,end:int>>"
                            + (", redacted string" if redact else ""))
    return docs.mapInArrow(lambda batches: _scan(batches, text, field, redact), schema)


def op9_secret_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
