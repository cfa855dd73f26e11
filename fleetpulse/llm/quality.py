"""Quality rules: hashed n-gram log-likelihood ratio of trusted text against the raw corpus.

Two multinomials over hashed byte trigrams are counted in one pass, one over a
bounded set of trusted documents and one over the whole corpus.  A document's
score is the mean log ratio of its trigrams, so its length does not matter, and
every document below a fixed threshold is rejected.  Cheap base rules (too few
words, too many repeated words) reject on their own.

Defined cases: a null text counts as empty; a text under 50 words fails the
base rules; an empty corpus or an empty trusted set gives a ratio of 0, so only
the base rules decide; repeated rows and null ids are judged row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_column

BUCKETS = 1 << 15
#: Mean log ratio under which a document is rejected.
THRESHOLD = -0.25
#: Bound of the trusted sample, whose ids go to every executor (8 bytes each).
TRUSTED_IDS = 20_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SPACE = b"\t\n\x0b\x0c\r "
_SYMBOLS = b"#*$%&|<>"
_CHUNK = 1 << 20

VERDICT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, score double"
)


def gram_buckets(data: bytes) -> np.ndarray:
    """Bucket of every byte trigram of the lower-cased text, blanks around it included."""
    b = np.frombuffer(b" " + data.lower() + b"  ", np.uint8).astype(np.uint32)
    key = b[:-2] | (b[1:-1] << 8) | (b[2:] << 16)
    return (key * np.uint32(2654435761)) >> np.uint32(17)


def trusted_ids(labels: DataFrame, bound: int = TRUSTED_IDS) -> list[int]:
    """At most ``bound`` ids of documents labelled good, the same ones on every run."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return [r[0] for r in good.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(bound).collect()]


def gram_counts(docs: DataFrame, trusted: list[int]) -> DataFrame:
    """Per bucket the trigrams of trusted documents and of all documents; each task sends one row a bucket."""
    chosen = frozenset(trusted)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            held: tuple[list, list] = ([], [])
            size = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = gram_buckets((text or "").encode())
                held[doc_id not in chosen].append(grams)
                size += len(grams)
                if size > _CHUNK:
                    _add(total, held)
                    size = 0
            _add(total, held)
        seen = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array(total[0][seen]), pa.array(total[1][seen])],
            names=["bucket", "trusted", "raw"],
        )

    counts = docs.select("doc_id", "text").mapInArrow(tally, "bucket int, trusted long, raw long")
    return counts.groupBy("bucket").agg(F.sum("trusted").alias("trusted"), F.sum("raw").alias("raw"))


def _add(total: np.ndarray, held: tuple[list, list]) -> None:
    for is_other, grams in enumerate(held):
        if grams:
            n = np.bincount(np.concatenate(grams), minlength=BUCKETS)
            total[1] += n
            if not is_other:
                total[0] += n
            grams.clear()


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log(trusted share / raw share) per bucket, add-one smoothed.  Collects ``BUCKETS`` rows at most."""
    both = np.zeros((2, BUCKETS))
    for r in counts.collect():
        both[:, r["bucket"]] = r["trusted"], r["raw"]
    if not both[0].any():
        return np.zeros(BUCKETS)
    share = (both + 1) / (both.sum(axis=1, keepdims=True) + BUCKETS)
    return np.log(share[0]) - np.log(share[1])


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter(map(ids.setdefault, words, count()), np.int64, n)  # a word's number is its first place
    if n < 1 << 21:
        windows = (w[:-2] * n + w[1:-1]) * n + w[2:]
    else:  # the product would overflow: number the pairs first
        windows = np.unique(w[:-1] * n + w[1:], return_inverse=True)[1][:-1] * n + w[2:]
    ordered = np.sort(windows)
    repeated = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(repeated):
        return 0
    at = np.flatnonzero(np.isin(windows, repeated))
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[at + k] = True
    return int(hit.sum())


def verdict(text: Column, ratios: np.ndarray, threshold: float = THRESHOLD) -> Column:
    """Struct ``VERDICT`` of each text."""

    def judge(x: str) -> tuple:
        data = x.encode()
        words = data.split()
        n = len(words)
        lines = [line for line in data.split(b"\n") if line.strip()]
        repeated = repeat_words(words)
        failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
        score = float(ratios[gram_buckets(data)].mean())
        return (
            n,
            len(x) - (len(data) - len(data.translate(None, _SPACE))),
            len(data) - len(data.translate(None, _SYMBOLS)),
            len(lines) - len(set(lines)),
            repeated,
            failed,
            not failed and score >= threshold,
            score,
        )

    return text_column(VERDICT, judge, text)


def fitted(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    return log_ratios(gram_counts(docs, trusted_ids(labels)))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and ``VERDICT`` for every row of ``docs``."""
    judged = docs.select("doc_id", verdict(F.col("text"), fitted(docs, labels)).alias("v"))
    return judged.select("doc_id", "v.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
