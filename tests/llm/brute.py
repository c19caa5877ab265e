"""Plain versions of the operators' rules, for small inputs."""

import math
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def signed(n):
    return n - (1 << 64) if n >= 1 << 63 else n


def xx(text, seed=42):
    return signed(xxhash.xxh64_intdigest(text.encode(), seed & (1 << 64) - 1))


def xx_long(value, seed=42):
    return signed(xxhash.xxh64_intdigest((value & (1 << 64) - 1).to_bytes(8, "little"), seed & (1 << 64) - 1))


def base_counts(text, window=8):
    found = words(text)
    at = Counter(tuple(found[i : i + window]) for i in range(len(found) - window + 1))
    covered = {
        j
        for i in range(len(found) - window + 1)
        if at[tuple(found[i : i + window])] > 1
        for j in range(i, i + window)
    }
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {
        "n_words": len(found),
        "word_chars": sum(map(len, found)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def buckets(text, n):
    hashes = [xx(w) for w in words(text)]
    grams = hashes + [xx_long(b, xx_long(a)) for a, b in zip(hashes, hashes[1:])]
    return [h % n for h in grams]


def llr(corpus, trusted, n):
    """Score of a text under bucket ratios of the two collections."""
    raw, good = Counter(b for t in corpus for b in buckets(t, n)), Counter(b for t in trusted for b in buckets(t, n))
    all_raw, all_good = sum(raw.values()) + n, sum(good.values()) + n

    def score(text):
        found = buckets(text, n)
        if not found or not good:
            return 0.0
        return sum(round(math.log((good[b] + 1) / all_good) - math.log((raw[b] + 1) / all_raw), 6) for b in found) / len(found)

    return score
