"""Licence scan: a trained paragraph classifier, confirmed against templates.

Every paragraph of a text, and every line of it for itself, is read in windows of ``WINDOW`` words, half
overlapping, and of half as many, so that a notice inside a long paragraph is not diluted and one wrapped over lines
is judged whole. Paragraphs end at lines without a letter or digit; other line feeds and comment marks are spaces. A window's features are its hashed words and pairs of neighbouring words
(letters and digits only, lower case); a softmax regression trained by stochastic gradient descent in numpy
gives the chances of the licence families, of an unknown licence and of no licence. Training windows
are the templates below, varied at random, for the families; sentences about licences that are no
family's, for the unknown class; and windows of a bounded sample of documents (``SAMPLE``) for none. A
part is kept back to fit the softmax temperature and the least chance at which a window counts as a
licence notice (``MISS``: the share of kept-back notices that may fall below it).

A window that counts is compared with the templates, together with the ``WINDOW`` words of its paragraph before and after,
so that no notice is judged by a part: every family whose template it holds (at least
``CONFIRM`` of the template's pairs of words) is reported, but for templates whose matched words lie inside a longer match. Without one, a window of at least ``FEW`` different words is an unknown licence if its chance
exceeds ``SURE`` and that of the share ``ORDINARY`` of the ordinary windows kept back. Sampled windows that hold a
template or the frame of a sentence about licences, or that a first model takes for notices, are no examples of
ordinary text, so licences without a template stay unknown ones however common they are. Texts above ``CHUNK`` bytes are
read in pieces that overlap by ``OVERLAP`` words, and a window cut by a piece's edge is judged in the next piece. Texts are read whole in their own tasks; nothing is shuffled but the sample.

Defined cases: a null or empty text has no notice (empty array, null licence). Repeated rows are scanned
each. Without any document the model knows no ordinary text, and an empty table gives an empty result.
Input columns named like a result column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faintline.llm.common import table, without
from faintline.llm.grams import CHUNK, groups, pairs, run_hashes, spans, split_words, text_bytes
from faintline.llm.training import distinct_sample

WINDOW = 48
OVERLAP = 3 * WINDOW  # words that pieces of a long text share with their neighbours on either side
BUCKET_BITS = 14
SAMPLE = 800
SAMPLE_WINDOWS = 40  # of one sampled document
VARIANTS = 60  # of each template
EPOCHS = 8
RATE = 8.0
KEPT_BACK = 0.25
MISS = 0.002
SURE = 0.9
ORDINARY = 0.999  # share of kept-back ordinary windows that are less likely than a sure notice
FEW = 4  # different words without which a window cannot tell of an unknown licence
LIKELY = 0.5  # chance under the first model from which a sampled window is no example of ordinary text
FIRST_EPOCHS = 2
CONFIRM = 0.6
UNKNOWN, NONE = "unknown", "none"
ADDED = ["license", "licenses", "license_score"]

#: Notices of licence families, as projects write them.
TEMPLATES = {
    "AGPL-3.0": ["This program is licensed under the GNU Affero General Public License, version 3.", "Licensed under the GNU AGPL v3."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
    ],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU GPL v2."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3",
        "Licensed under the GNU GPL v3.",
    ],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License.", "Licensed under the GNU LGPL."],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
}
#: Sentences of the unknown class; a made-up name takes the place of {}.
OTHERS = [
    "Licensed under the {} License.", "Released under the {} Public License, version 1.", "This work is licensed under the terms of {}.",
    "Use of this software is governed by the {} licence agreement.", "Distributed under the {} licence, all rights reserved.",
]
#: Lines without a letter or digit, which end paragraphs.
WORDLESS = re.compile(r"\n(?:[\x00-\x09\x0b-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]*\n)+")
GAPS = np.ones(256, dtype=bool)
GAPS[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass(frozen=True)
class LicenseModel:
    classes: list[str]
    weights: np.ndarray  # bucket x class
    bias: np.ndarray
    temperature: float
    least: float  # chance of any notice from which a window is compared with the templates
    sure: float  # chance from which it is a notice even if no template confirms it


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word, the number of its text, and its first byte's place."""
    body, begins, text = split_words(data, offsets, GAPS)
    places = np.flatnonzero(~GAPS[data])[begins]
    return run_hashes(LOWER[body], np.flatnonzero(begins)), text, places


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _windows(data: np.ndarray, hashes: np.ndarray, places: np.ndarray, text: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 word of every window; lines end at line feeds and texts."""
    line = np.searchsorted(np.flatnonzero(data == 10), places)
    cut = np.flatnonzero((line[1:] != line[:-1]) | (text[1:] != text[:-1])) + 1
    starts = np.concatenate([[0], cut]) if len(hashes) else np.zeros(0, dtype=np.int64)
    ends = np.append(cut, len(hashes)) if len(hashes) else starts
    step = size // 2
    counts = np.maximum(1, -(-(ends - starts - step) // step))
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    lo = np.repeat(starts, counts) + nth * step
    return lo, np.minimum(lo + size, np.repeat(ends, counts))


def _unwrapped(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bytes with spaces for line feeds inside paragraphs; those next to a line without a word stay, as do those between texts."""
    feeds = np.flatnonzero(data == 10)
    out = data.copy()
    if not len(feeds):
        return out
    words = np.concatenate([[0], np.cumsum(~GAPS[data])])
    edges = np.concatenate([[0], feeds + 1, [len(data)]])
    full = words[edges[1:]] > words[edges[:-1]]
    out[feeds[full[:-1] & full[1:]]] = 32
    return out


def _all_windows(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, places: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last + 1 word of every window of lines and paragraphs, and of the paragraph it lies in."""
    whole = _unwrapped(data, offsets)
    found = [_windows(d, hashes, places, text, size) for d in (data, whole) for size in (WINDOW, WINDOW // 2)]
    # the same stretch of words counts once
    both = np.unique(np.concatenate([lo * (len(hashes) + 1) + hi for lo, hi in found]))
    lo, hi = both // (len(hashes) + 1), both % (len(hashes) + 1)
    line = np.searchsorted(np.flatnonzero(whole == 10), places)
    cut = np.flatnonzero((line[1:] != line[:-1]) | (text[1:] != text[:-1])) + 1
    edges = np.concatenate([[0], cut, [len(hashes)]])
    nth = np.searchsorted(edges, lo, "right") - 1
    return lo, hi, edges[nth], edges[nth + 1]


def _logits(weights: np.ndarray, bias: np.ndarray, hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Mean weight of the words and pairs of every window."""
    one = np.zeros((len(hashes) + 1, len(bias)), dtype=np.float64)
    np.cumsum(weights[_bucket(hashes)], axis=0, out=one[1:])
    two = np.zeros_like(one)
    if len(hashes) > 1:
        both, _ = pairs(hashes, np.zeros(len(hashes), dtype=np.int64))
        np.cumsum(weights[_bucket(both)], axis=0, out=two[2:])
    n = 2 * (hi - lo) - 1
    return (one[hi] - one[lo] + two[hi] - two[np.minimum(lo + 1, hi)]) / n[:, None] + bias


def _features(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    hashes, number, _ = _tokens(data, np.array([0, len(data)]))
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    both = pairs(hashes, number)[0] if len(hashes) > 1 else hashes[:0]
    return _bucket(np.concatenate([hashes, both]))


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _examples(corpus: list[str], seed: int = 17) -> list[tuple[str, str]]:
    """Templates with words of the corpus around them and a few words lost, sentences of unknown licences, corpus windows."""
    draw = np.random.default_rng(seed)
    filler = [w for t in corpus[:200] for w in t.split()[:40]] or ["text"]

    def some(most: int) -> list[str]:
        return [filler[i] for i in draw.integers(0, len(filler), int(draw.integers(0, most + 1)))]

    def varied(sentence: str) -> str:
        words = [w for w in sentence.split() if draw.random() > 0.03]
        around = 14 if draw.random() < 0.4 else 0
        text = " ".join([*some(around), *words, *some(around)])
        return text.upper() if draw.random() < 0.1 else text

    out = [(varied(t), family) for family, texts in TEMPLATES.items() for t in texts for _ in range(VARIANTS)]
    for t in OTHERS:
        for _ in range(VARIANTS):
            name = " ".join("".join(draw.choice(list("aeioubcdfglmnprst"), int(draw.integers(3, 9)))).title() for _ in range(int(draw.integers(1, 3))))
            out.append((varied(t.format(name)), UNKNOWN))
    return out + [(t, NONE) for t in corpus]


def _corpus_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bounded number of windows of each sampled text, evenly spread over it, as text."""
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            found = []
            for paragraph in WORDLESS.sub("\n\n", text).split("\n\n"):
                lines = paragraph.split("\n")
                parts = [(paragraph, "")] + [(line, " ".join(lines[max(k - 1, 0) : k + 2])) for k, line in enumerate(lines) if len(lines) > 1]
                found += [(" ".join(w[i : i + WINDOW]), near) for part, near in parts for w in [part.split()] for i in range(0, len(w), WINDOW)]
            # a line that may be part of a wrapped notice is no example
            out += [w for w, near in found[:: -(-len(found) // SAMPLE_WINDOWS)] if not _likely(near)] if found else []
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["window"])


def _words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


#: Pairs of words of every sentence in OTHERS, whatever the name.
_FRAMES = [{p for part in t.split("{}") for p in zip(_words(part), _words(part)[1:])} for t in OTHERS]
#: Pairs that begin such sentences, and words of which a window with one of them needs another to be a likely notice.
_CUES = {("licensed", "under"), ("released", "under"), ("distributed", "under"), ("governed", "by")}
_NAMED = {"license", "licence", "licensed"}


def _likely(window: str) -> bool:
    """Whether a window holds a template, the beginning and name of a licence, or ``CONFIRM`` of a sentence about some licence but its name."""
    words = _words(window)
    own = set(zip(words, words[1:]))
    if own & _CUES and _NAMED & set(words) or any(len(frame & own) >= CONFIRM * len(frame) for frame in _FRAMES):
        return True
    return bool(_best(words))


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> LicenseModel:
    rows = distinct_sample(docs.select(F.col(text).alias("text")).filter("text IS NOT NULL"), F.xxhash64("text"), sample)
    corpus = sorted(r.window for r in rows.mapInArrow(_corpus_windows, "window string").collect())
    # sampled windows that hold a template, or the frame of a sentence about a licence, are no ordinary text; equal ones count once
    corpus = [w for w in dict.fromkeys(corpus) if not _likely(w)]
    # nor are those that a first model takes for notices
    first = _learn(_examples(corpus), FIRST_EPOCHS)
    chance = _notice(first, corpus)
    corpus = [w for w, c in zip(corpus, chance) if c <= LIKELY]
    return _learn(_examples(corpus), EPOCHS)


def _notice(model: LicenseModel, texts: list[str]) -> np.ndarray:
    """The chance that each text is a notice."""
    found = [_features(t) for t in texts]
    logits = [model.weights[f].mean(axis=0) + model.bias if len(f) else model.bias for f in found]
    return 1 - _softmax(np.stack(logits) / model.temperature)[:, -1] if logits else np.zeros(0)


def _learn(examples: list[tuple[str, str]], epochs: int) -> LicenseModel:
    classes = [*TEMPLATES, UNKNOWN, NONE]
    number = {c: i for i, c in enumerate(classes)}
    found = [(f, number[c]) for f, c in ((_features(t), c) for t, c in examples) if len(f)]
    draw = np.random.default_rng(29)
    order = draw.permutation(len(found))
    back = order[: int(len(order) * KEPT_BACK)]
    weights, bias = np.zeros((1 << BUCKET_BITS, len(classes)), dtype=np.float32), np.zeros(len(classes))
    learn = order[len(back) :]
    steps, step = epochs * len(learn), 0
    for _ in range(epochs):
        for i in draw.permutation(learn):
            grams, label = found[i]
            wrong = _softmax((weights[grams].mean(axis=0) + bias)[None])[0]
            wrong[label] -= 1
            rate = RATE * (1 - step / steps)
            step += 1
            np.subtract.at(weights, grams, (rate / len(grams) * wrong).astype(np.float32))
            bias -= 0.05 * (1 - step / steps) * wrong
    logits = np.stack([weights[found[i][0]].mean(axis=0) + bias for i in back])
    labels = np.array([found[i][1] for i in back])
    grid = np.geomspace(0.05, 10, 80)
    losses = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    notice = np.sort(1 - _softmax(logits / temperature)[labels != number[NONE], number[NONE]])
    least = float(min(0.5, notice[int(MISS * len(notice))]))
    ordinary = np.sort(1 - _softmax(logits / temperature)[labels == number[NONE], number[NONE]])
    sure = float(max(SURE, ordinary[int(ORDINARY * (len(ordinary) - 1))])) if len(ordinary) else SURE
    return LicenseModel(classes, weights, bias, temperature, least, sure)


def _marks() -> tuple[list[tuple[str, dict, set, int]], dict[tuple[str, str], list[int]]]:
    """Of every template its family, its pairs of words with their places, those that tell it from other families and how many of them it needs; and the templates of every pair.

    A template with pairs that no other family has must hold half of them. One without is told by its rarest pairs together, and needs all.
    """
    pairs_of = [(family, {p: i for i, p in reversed([*enumerate(zip(w, w[1:]))])}) for family, texts in TEMPLATES.items() for w in map(_words, texts)]
    families: dict[tuple[str, str], set[str]] = {}
    has: dict[tuple[str, str], list[int]] = {}
    for t, (family, own) in enumerate(pairs_of):
        for p in own:
            families.setdefault(p, set()).add(family)
            has.setdefault(p, []).append(t)
    out = []
    for family, own in pairs_of:
        least = min(len(families[p]) for p in own)
        marks = {p for p in own if len(families[p]) == least}
        out.append((family, own, marks, -(-len(marks) // 2) if least == 1 else len(marks)))
    return out, has


_TOLD, _HAS = _marks()


def _held(words: list[str]) -> list[tuple[int, float, str, set[int]]]:
    """Templates held close together in a text: pairs, share of the template, family and places of the words."""
    at: dict[int, list[tuple[int, tuple[str, str]]]] = {}
    for i, pair in enumerate(zip(words, words[1:])):
        for t in _HAS.get(pair, ()):
            at.setdefault(t, []).append((i, pair))
    out = []
    for t, hits in at.items():
        family, own, marks, need = _TOLD[t]
        while len(hits) >= CONFIRM * len(own):
            # of stretches of at most twice the template's length the one with most of its pairs in their order, and of those the shortest
            best = (0, 0, 0, 0)
            for first, (start, _) in enumerate(hits):
                n, at_pair = 0, -1
                for last in range(first, len(hits)):
                    if hits[last][0] - start >= 2 * len(own):
                        break
                    if own[hits[last][1]] > at_pair:
                        n, at_pair = n + 1, own[hits[last][1]]
                        best = max(best, (n, start - hits[last][0], first, last + 1))
            _, _, first, last = best
            while last < len(hits) and hits[last][0] == hits[last - 1][0] + 1:  # a pair that the template has twice
                last += 1
            near = hits[first:last]
            seen = {p for _, p in near}
            if best[0] < CONFIRM * len(own):
                break
            if len(seen & marks) >= need:
                out.append((best[0], best[0] / len(own), family, {w for i, _ in near for w in (i, i + 1)}))
            hits = hits[:first] + hits[last:]
    return out


def _best(words: list[str]) -> list[tuple[str, set[int]]]:
    """Every family whose template the words hold, and where.

    A template is left out whose words lie inside a longer match, or are all words of others that are held as closely.
    """
    kept: list[tuple[str, set[int]]] = []
    for _, _, family, places in sorted(_held(words), key=lambda h: h[:3], reverse=True):
        if not any(places <= longer for _, longer in kept):
            kept.append((family, places))

    def filled(places: set[int]) -> float:
        return len(places) / (max(places) + 1 - min(places))

    for match in kept[::-1]:
        others = [p for f, p in kept if p is not match[1] and filled(p) >= filled(match[1])]
        if match[1] <= set().union(*others):
            kept.remove(match)
    return kept


def confirm(window: str) -> list[str]:
    """The families of which the window holds ``CONFIRM`` of a template, the longest match first."""
    return list(dict.fromkeys(family for family, _ in _best(_words(window))))


def _reach(data: np.ndarray, words: int) -> int:
    """Bytes at the end of ``data`` that hold its last ``words`` words; all of them if it has fewer."""
    size = 64 * words
    while True:
        dark = ~GAPS[data[max(0, len(data) - size) :]]
        starts = np.flatnonzero(dark[1:] & ~dark[:-1]) + 1
        if len(starts) >= words:
            return len(dark) - int(starts[-words])
        if size >= len(data):
            return len(data)
        size *= 2


def _in_pieces(data: np.ndarray, notices: Callable) -> Iterator[tuple[int, str, float]]:
    """Notices of one long text, from pieces that reach ``OVERLAP`` words (at most ``CHUNK`` bytes) into their neighbours."""
    for lo, hi in spans(data):
        begin = lo - _reach(data[max(0, lo - CHUNK) : lo], OVERLAP)
        end = hi + _reach(data[hi : hi + CHUNK][::-1], OVERLAP)
        # an edge that is the text's own cuts nothing
        piece = (0 if begin == 0 else lo - begin, end - begin if end == len(data) else hi - begin)
        yield from notices(data[begin:end], np.array([0, end - begin]), piece)


def scan(docs: DataFrame, model: LicenseModel, text: str = "text") -> DataFrame:
    """Documents with ``license`` (of their surest notice), ``licenses`` (distinct, sorted), ``license_score``."""
    rows = without(docs, [c for c in ADDED if c != text])
    kept, none = rows.columns, model.classes.index(NONE)

    def notices(data: np.ndarray, offsets: np.ndarray, piece: tuple[int, int] | None = None) -> Iterator[tuple[int, str, float]]:
        hashes, number, places = _tokens(data, offsets)
        if not len(hashes):
            return
        n = len(hashes)
        lo, hi, first, last = _all_windows(data, offsets, hashes, places, number)
        chance = 1 - _softmax(_logits(model.weights, model.bias, hashes, lo, hi) / model.temperature)[:, none]

        def words(begin: int, end: int) -> list[str]:
            if begin == end:
                return []
            stop = places[end] if end < len(places) and number[end] == number[begin] else offsets[number[begin] + 1] - offsets[0]
            return _words(data[places[begin] : stop].tobytes().decode("utf-8", "replace"))

        counts = chance >= model.least
        if piece is not None:
            # at a cut edge a window counts that begins in the piece, or has all its neighbouring words
            counts &= ((lo >= WINDOW) & (hi + WINDOW <= n)) | ((places[lo] >= piece[0]) & (places[lo] < piece[1]))
        for w in np.flatnonzero(counts):
            before = words(max(first[w], lo[w] - WINDOW), lo[w])
            inner = words(lo[w], hi[w])
            after = words(hi[w], min(last[w], hi[w] + WINDOW))
            own = range(len(before), len(before) + len(inner))
            families = [family for family, at in _best([*before, *inner, *after]) if any(i in own for i in at)]
            for family in families or ([UNKNOWN] if chance[w] > model.sure and len(set(inner)) >= FEW else []):
                yield int(number[lo[w]]), family, float(chance[w])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = text_bytes(batch.column(text))
            found: list[dict[str, float]] = [{} for _ in range(batch.num_rows)]
            for first, last in groups(offsets, CHUNK // 2):
                begin, end = int(offsets[first]), int(offsets[last])
                if end - begin <= CHUNK:
                    heard = notices(data[begin:end], offsets[first : last + 1] - begin)
                else:
                    heard = _in_pieces(data[begin:end], notices)
                for i, family, chance in heard:
                    seen = found[first + i]
                    seen[family] = max(chance, seen.get(family, 0.0))
            best = [max(((family != UNKNOWN, c, family) for family, c in f.items()), default=None) for f in found]
            added = [
                pa.array([b[2] if b else None for b in best], pa.string()),
                pa.array([sorted(f) for f in found], pa.list_(pa.string())),
                pa.array([round(b[1], 6) if b else 0.0 for b in best], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + added, [*kept, *ADDED])

    added = [T.StructField("license", T.StringType()), T.StructField("licenses", T.ArrayType(T.StringType())), T.StructField("license_score", T.DoubleType())]
    return rows.mapInArrow(answer, T.StructType([*rows.schema.fields, *added]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return scan(docs, fit(docs)).select("doc_id", *ADDED)
