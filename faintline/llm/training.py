"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST = 20  # rows of each label, if it has so many
SLACK = 4  # times as many rare rows are looked at


def distinct_sample(rows: DataFrame, key: Column, most: int, label: str | None = None) -> DataFrame:
    """At most ``most`` rows with different ``key`` (a 64-bit hash of what is learned from), chosen by that hash.

    The same rows come out whatever the partitioning, and a large group of copies counts once. Rows
    are first thinned by their hash to about twice the sample, by the number of different hashes (estimated within a few
    hundredths), so copies do not make the sample smaller.

    With ``label`` the ``LEAST`` first rows of each label (all, if it has fewer) come before the others, so that
    no label is lost among frequent ones; only where ``LEAST`` rows of each make more than ``most``, so many come out. Of
    more than ``most`` labels the most frequent ones are served.
    """
    hashed = rows.withColumn("__llm_key", key)
    by = [] if label is None else [label]
    counts = hashed.groupBy(*by).agg(F.approx_count_distinct("__llm_key", 0.03).alias("__llm_n"))
    found = counts.orderBy(F.desc("__llm_n"), *by).limit(most).collect()
    total = sum(r["__llm_n"] for r in found)
    if total <= 2 * most:
        kept = hashed
    else:
        part = F.shiftrightunsigned("__llm_key", 32)
        share = 2 * most / total
        kept = part < int((1 << 32) * share)
        rare = [(r[0], SLACK * LEAST / max(r["__llm_n"], 1)) for r in found] if by else []
        for value, own in rare:
            if own > share:
                kept = kept | (F.col(label).eqNullSafe(F.lit(value)) & (part < int((1 << 32) * min(1.0, own))))
        kept = hashed.filter(kept)
    distinct = kept.dropDuplicates(["__llm_key"])
    if not by:
        return distinct.orderBy("__llm_key").limit(most)
    nth = F.row_number().over(Window.partitionBy(label).orderBy("__llm_key"))
    ranked = distinct.withColumn("__llm_late", nth > LEAST)
    return ranked.orderBy("__llm_late", "__llm_key").limit(max(most, LEAST * len(found))).drop("__llm_late")
