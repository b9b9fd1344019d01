"""License scans: fuzzy search for short notices by pigeonhole seeds and bounded edits.

A text is read as its words (lower-cased runs of letters, digits and non-ASCII
characters) joined by one space, so that line breaks, comment marks and punctuation
cost nothing.  A notice of m characters may be misspelt by m // ``per_edit`` edits.
Split into one piece more than it has edits, it leaves at least one piece whole in any
such place: an Aho-Corasick automaton over all pieces of all notices finds these seeds
in one pass.  Each seed says where its notice can lie; the places of one notice are
united, and there the ``regex`` library matches the notice with its error bound, from
a word's first character to a word's last.  What it returns is reported with its
edits and its span in the original text.

Three phrases are counted apart (``base``): every place where their words stand as
they are.  They are found by the same automaton and compared exactly.

The scan is one map over the documents, without a shuffle.

Defined results: null and empty texts have no words and no places; places never cross
documents; the matches of one notice don't overlap, the first to begin comes first;
repeated rows are scanned one by one; columns named like a result give way to it; an
empty table gives no rows.
"""
from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

#: Characters of a notice for each edit that it may have.
PER_EDIT = 11

#: Phrases that are counted, with their labels.
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

#: Short license notices as their words, with labels.
NOTICES = [
    ("agpl", "gnu affero general public license"),
    ("apache", "apache license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "spdx license identifier apache 2 0"),
    ("boost", "boost software license version 1 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "spdx license identifier bsd 3 clause"),
    ("cc-by", "creative commons attribution"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "creative commons zero"),
    ("epl", "eclipse public license"),
    ("gpl", "general public license"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "mit license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "mozilla public license"),
    ("proprietary", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

SCHEMA = ("n_words long, base array<struct<label:string,word:int>>, "
          "matches array<struct<label:string,notice:string,word:int,n_words:int,start:int,end:int,edits:int>>, "
          "score double")


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): ``edits + 1`` pieces of nearly equal length."""
    cuts = [len(notice) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


class Finder:
    """The automaton over seeds and phrases, and the bounded patterns that verify."""

    def __init__(self, notices, base, per_edit: int):
        self.notices, self.base = list(notices), list(base)
        self.edits = [len(text) // per_edit for _, text in self.notices]
        told: dict[str, list[tuple[int, int, int]]] = {}
        for k, (_, text) in enumerate(self.notices):
            for at, piece in pieces(text, self.edits[k]):
                told.setdefault(piece, []).append((0, k, at))
        for k, (_, text) in enumerate(self.base):
            told.setdefault(text, []).append((1, k, 0))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in told.items():
            self.seeds.add_word(piece, (len(piece), uses))
        if told:
            self.seeds.make_automaton()
        # from a word's first character to a word's last
        self.patterns = [regex.compile(r"(?e)(?<=[ \n])(?![ \n])(?:%s){e<=%d}(?<![ \n])(?=[ \n])" % (regex.escape(t), e))
                         for (_, t), e in zip(self.notices, self.edits)]
        # places with the same words are verified once
        self.verify = lru_cache(1 << 14)(self._verify)

    def _verify(self, k: int, place: str) -> list[tuple[int, int, int]]:
        return [(*m.span(), sum(m.fuzzy_counts)) for m in self.patterns[k].finditer(place)]

    def search(self, joined: str, bounds: np.ndarray):
        """Base places (position, phrase) and matches (start, end, notice, edits) in texts of
        words; newlines, at ``bounds``, stand before, between and behind the texts."""
        exact, found = [], []
        seeds: list[list[tuple[int, int]]] = [[] for _ in self.notices]
        for last, (size, uses) in self.seeds.iter(joined) if len(self.seeds) else ():
            at = last + 1 - size
            for kind, k, offset in uses:
                if not kind:
                    seeds[k].append((at, offset))
                elif joined[at - 1] in " \n" and joined[last + 1] in " \n":
                    exact.append((at, k))
        for k, own in enumerate(seeds):
            if not own:
                continue
            at, offset = np.array(own).T
            text = np.searchsorted(bounds, at, "right") - 1
            begin = np.maximum(at - offset - self.edits[k] - 1, bounds[text])
            end = np.minimum(at - offset + len(self.notices[k][1]) + self.edits[k] + 1, bounds[text + 1] + 1)
            order = np.lexsort((end, begin, text))
            begin, end, text = begin[order], end[order], text[order]
            new = np.ones(len(at), bool)
            # within a text the ends rise with the beginnings
            new[1:] = (text[1:] != text[:-1]) | (begin[1:] > end[:-1])
            heads = np.flatnonzero(new)
            ends = np.maximum.reduceat(end, heads)
            for a, b in zip(begin[heads].tolist(), ends.tolist()):
                found.extend((a + s, a + e, k, n) for s, e, n in self.verify(k, joined[a:b]))
        return exact, found


def _join(words: K.Words) -> tuple[str, np.ndarray, np.ndarray]:
    """The words of a chunk joined by spaces, texts by newlines; where words begin and where
    the newlines are."""
    size = words.end - words.start + 1
    at = np.concatenate([[0], np.cumsum(size)])
    data = np.append(words.raw, np.uint8(32))[K.ranges(words.start, size)]
    data[at[1:] - 1] = 32
    last = np.unique(words.first[1:][np.diff(words.first) > 0]) - 1
    data[at[last + 1] - 1] = 10
    data = np.concatenate([[np.uint8(10)], data])
    starts, newlines = at[:-1] + 1, np.concatenate([[0], at[last + 1]])
    try:
        joined = data.tobytes().decode()
    except UnicodeDecodeError:  # not UTF-8: a byte is a character
        return data.tobytes().decode("latin-1"), starts, newlines
    if len(joined) < len(data):
        point = np.cumsum((data & 0xC0) != 0x80) - 1
        starts, newlines = point[starts], point[newlines]
    return joined, starts, newlines


def _scan(batches, text: str, notices, base, per_edit: int):
    finder = Finder(notices, base, per_edit)
    names = ["n_words", "base", "matches", "score"]
    types = [pa.int64(), pa.list_(pa.struct([("label", pa.string()), ("word", pa.int32())])),
             pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("word", pa.int32()),
                                 ("n_words", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
                                 ("edits", pa.int32())])), pa.float64()]
    for batch in K.chunks(batches, text):
        raw, offsets = K.utf8(batch.column(batch.schema.names.index(text)))
        words = K.Words(K.LOWER[raw], offsets, K.ALNUM)
        n = batch.num_rows
        bases, matches, scores = [[] for _ in range(n)], [[] for _ in range(n)], [0.0] * n
        if len(words):
            joined, starts, newlines = _join(words)
            exact, found = finder.search(joined, newlines)
            point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)]) if found else None
            for at, k in sorted(exact):
                word = int(np.searchsorted(starts, at, "right")) - 1
                d = int(np.searchsorted(words.first, word, "right")) - 1
                bases[d].append({"label": base[k][0], "word": word - int(words.first[d])})
                scores[d] = 1.0
            for s, e, k, edits in sorted(found):
                a, b = (int(np.searchsorted(starts, x, "right")) - 1 for x in (s, e - 1))
                d = int(np.searchsorted(words.first, a, "right")) - 1
                first, begin = int(words.first[d]), int(point[offsets[d]])
                label, notice = notices[k]
                matches[d].append({"label": label, "notice": notice, "word": a - first, "n_words": b - a + 1,
                                   "start": int(point[words.start[a]]) - begin,
                                   "end": int(point[words.end[b]]) - begin, "edits": edits})
                scores[d] = max(scores[d], 1 - edits / len(notice))
        cols = [np.diff(words.first).tolist(), bases, matches, scores]
        kept = [k for k, x in enumerate(batch.schema.names) if x not in names]
        yield pa.RecordBatch.from_arrays(
            [batch.column(k) for k in kept] + [pa.array(c, kind) for c, kind in zip(cols, types)],
            [batch.schema.names[k] for k in kept] + names)


def scan_licenses(docs: DataFrame, text: str = "text", notices=NOTICES, base=BASE, per_edit: int = PER_EDIT) -> DataFrame:
    """Every row of ``docs`` with its number of words, the places of the ``base`` phrases, the
    fuzzy ``matches`` (label, notice, words, code points of the span, edits) and a score: 1
    less the share of edits in the best match's notice, 0 without any."""
    docs, schema = K.fields(K.bounded(docs), SCHEMA)
    return docs.mapInArrow(lambda batches: _scan(batches, text, notices, base, per_edit), schema)


def op11_license_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    told = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base, found, word = F.col("base.label"), F.col("matches.label"), F.col("base.word")
    return scan_licenses(docs).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(word).cast("long").alias("first_word"),
        F.array_max(word).cast("long").alias("last_word"), told(base).alias("base_labels"),
        told(F.concat(base, found)).alias("labels"), "score")
