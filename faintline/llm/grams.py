"""Hashed n-grams of Arrow text columns, as numpy arrays.

Texts are taken from the column's bytes in groups of at most ``CHUNK`` bytes; a longer text is a
group of its own and is read in pieces that end between words, so memory does not follow the length of
texts or batches. Words are runs of anything but ASCII white space, as everywhere in this package.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
BASE = np.uint64(0x100000001B3)
MIX = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Kinds of bytes in word shapes: lower case (and all of other scripts), upper case, digits; symbols stand for themselves.
KIND = np.arange(256, dtype=np.uint8)
KIND[ord("a") : ord("z") + 1] = 1
KIND[128:] = 1
KIND[ord("A") : ord("Z") + 1] = 2
KIND[ord("0") : ord("9") + 1] = 3


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its texts; null is an empty text."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    return data, offsets


def groups(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of together at most ``most`` bytes, or of one longer text."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Spread every bit of a hash over all 64."""
    hashes = (hashes ^ (hashes >> np.uint64(31))) * MIX
    return hashes ^ (hashes >> np.uint64(29))


def run_hashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of every run of ``values``; runs begin at ``starts`` (the first at 0) and fill the array."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = np.diff(starts, append=len(values))
    place = np.arange(len(values)) - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), BASE, dtype=np.uint64))
    return mixed(np.add.reduceat((values.astype(np.uint64) + np.uint64(1)) * powers[place], starts))


def split_words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words one after another, a mark at each word's first byte, and for each word the number of its text.

    ``gaps``: which bytes stand between words.
    """
    dark = ~gaps[data]
    start = dark.copy()
    start[1:] &= ~dark[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]] - offsets[0]
    start[firsts] = dark[firsts]
    text = np.searchsorted(offsets[1:] - offsets[0], np.flatnonzero(start), "right")
    return data[dark], start[dark], text


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every word in the texts: its hash, the hash of its shape, and the number of its text.

    A shape is the word's kinds of characters without repeats; a word equal to the one before has a
    shape of its own, so that repetition shows in shapes.
    """
    body, begins, text = split_words(data, offsets)
    hashes = run_hashes(body, np.flatnonzero(begins))
    kinds = KIND[body]
    turn = begins.copy()
    turn[1:] |= kinds[1:] != kinds[:-1]
    shapes = run_hashes(kinds[turn], np.flatnonzero(begins[turn]))
    if len(hashes) > 1:
        shapes[1:][(hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])] = MIX
    return hashes, shapes, text


def pairs(hashes: np.ndarray, text: np.ndarray, apart: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a token with the one ``apart`` places before it, within a text, and the text's number."""
    same = text[apart:] == text[:-apart]
    both = mixed(hashes[:-apart] * BASE + hashes[apart:] * MIX)
    return both[same], text[apart:][same]


def spans(data: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Pieces of a long text that end after white space; a word longer than ``most`` stays whole."""
    first = 0
    while first < len(data):
        last = first + most
        if last < len(data):
            back = np.flatnonzero(SPACE[data[first:last]])
            if len(back):
                last = first + int(back[-1]) + 1
            else:
                ahead = last
                while ahead < len(data) and not SPACE[data[ahead]]:
                    ahead += 1
                last = ahead
        yield first, min(last, len(data))
        first = last
