"""Toxicity by the nearest labelled examples.

A bounded sample of labelled documents is indexed by TF-IDF over all their words,
with real counts.  Terms that occur more often in toxic documents than chance
allows (words and their beginnings, so that unseen forms of a word still meet)
weigh more.  Every document then looks up its exact nearest examples by cosine:
postings are cut into blocks of examples, the largest weight of each term in each
block bounds what a block can offer, and only blocks that can beat the k-th best
of the most promising ones are read.  The list of a term that many examples have
is stored dense, a weight for every example, and read by slices.  The examples
vote with weights that fall with their distance.

Defined cases: a null, empty or very long text is scored like any other; a text
without any word of an example takes the toxic share of the examples without one;
without labelled examples every score is 0; of equal similarities at the cut the
order of the examples decides, which follows from their words, texts and labels
alone; repeated rows and null ids are scored row by row, a null id is not held out.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_process, table, text_column, written

#: Bounds of the labelled sample that is indexed: documents, and bytes of their texts.
EXAMPLES = 2_000
SAMPLE_BYTES = 64 << 20
#: A list that reaches this share of the examples is stored dense.
DENSE = 1 / 16
#: Bound of the telling terms, the most telling ones first; all other words are indexed too.
TERMS = 4096
LEAST_DOCS = 5
LEAST_CHI2 = 40.0
PREFIXES = (3, 4, 5, 6, 7)
NEIGHBOURS = 15
BLOCK = 64
#: A vote weighs 1 / (``NEAR`` + 1 - cosine), the prior as much as a distant vote.
NEAR = 0.02
PRIOR_WEIGHT = 1.0
#: Beside telling terms, the number of all other words is one more term, so that their share counts too.
OTHERS_IDF = 2.0
#: What any other word weighs, where a telling term weighs 1.
COMMON = 0.1
#: Blocks that are read before the k-th best is known.
FIRST = 4
FOLDS = 5

SCORED = "score double, predicted int, n_terms int, evidence string"

_WORDS = re.compile(r"[^\W\d_]+")
_ANSWERS = 10_000


def terms_of(token: str) -> set[str]:
    out = set()
    for word in _WORDS.findall(token):
        out.add(word)
        out.update("^" + word[:n] for n in PREFIXES if len(word) > n)
    return out


def _tokens(text: str) -> Counter[str]:
    return Counter(text.lower().split())


def _words(text: str) -> Counter[str]:
    """How often each word stands in a text: those of its tokens, most of which are words already."""
    counts = Counter(text.lower().split())
    mixed = [(t, counts.pop(t)) for t in [t for t in counts if not t.isalpha()]]
    counts.update(_WORDS.findall(" ".join([t for t, n in mixed for _ in range(n)])))
    return counts


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of all the ranges, in order."""
    n = ends - starts
    return np.repeat(ends - np.cumsum(n), n) + np.arange(n.sum())


@dataclass
class ExampleIndex:
    """Block-max inverted index of the labelled examples; its size is bounded by the texts of ``EXAMPLES`` documents."""

    vocabulary: dict[str, int]  # telling terms, then all other words of the examples
    telling: int
    beginnings: frozenset[str]  # of the telling beginnings of words
    rooted: np.ndarray  # [term]: whether it is a word that begins like one of them
    idf: np.ndarray  # weights of the terms, and last of the number of other words
    unseen: float  # weight of a word that no example has
    labels: np.ndarray | None = None  # of the indexed examples
    ids: list[int] = field(default_factory=list)
    starts: np.ndarray | None = None  # [term, 2]: where its postings begin and end
    posted: np.ndarray | None = None  # example of each posting
    weights: np.ndarray | None = None  # its weight
    pieces: np.ndarray | None = None  # [term]: where its pieces begin, one for each block with a posting
    piece_block: np.ndarray | None = None
    piece_max: np.ndarray | None = None
    piece_start: np.ndarray | None = None  # where the postings of the piece begin
    dense_row: np.ndarray | None = None  # [term]: row of its dense list, or -1
    dense: np.ndarray | None = None  # [row, block, example of the block]: weights
    dense_max: np.ndarray | None = None  # [row, block]: largest weight
    blank_share: float = 0.0
    share: float = 0.0
    answers: dict = field(default_factory=dict)

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Sorted terms of a text and their weights; with the words that no example has, of length one."""
        found = _words(text)
        ids = np.fromiter(map(self.vocabulary.get, found, repeat(-1)), np.int64, len(found))
        times = np.fromiter(found.values(), np.float64, len(found))
        known = ids >= 0
        unseen, terms, counts = times[~known], ids[known], times[known]
        more = self._beginnings(list(found), np.flatnonzero(~known | self.rooted[ids]).tolist())
        if more:
            of, beginning = zip(*more)
            terms, at = np.unique(np.append(terms, beginning), return_inverse=True)
            counts = np.bincount(at, np.append(counts, times[list(of)]), minlength=len(terms))
        else:  # words differ, so do their terms
            order = np.argsort(terms)
            terms, counts = terms[order], counts[order]
        if len(terms) and terms[0] < self.telling:
            others = counts[terms >= self.telling].sum() + unseen.sum()
            terms, counts = np.append(terms, len(self.vocabulary)), np.append(counts, max(1.0, others))
        weights = (1 + np.log(counts)) * self.idf[terms]
        new = (((1 + np.log(unseen)) * self.unseen) ** 2).sum()
        return terms, weights / math.sqrt(float((weights**2).sum() + new)) if len(terms) else weights

    def _beginnings(self, words: list[str], asked: list[int]) -> list[tuple[int, int]]:
        """The telling beginnings of the asked words: number of the word, and term."""
        out = []
        for k in asked:
            if (w := words[k])[: PREFIXES[0]] in self.beginnings:  # few words begin like a telling term
                ends = ("^" + w[:n] for n in PREFIXES if len(w) > n)
                out += [(k, self.vocabulary[x]) for x in ends if x in self.vocabulary]
        return out

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        """Exact k best (cosine, example), best first; examples without a common term are none."""
        rows = self.dense_row[terms]
        wide, wide_weights = rows[rows >= 0], weights[rows >= 0]
        terms, weights = terms[rows < 0], weights[rows < 0]
        pieces = _ranges(self.pieces[terms], self.pieces[terms + 1])
        asked = np.repeat(weights, self.pieces[terms + 1] - self.pieces[terms])
        blocks = self.piece_block[pieces]
        n_blocks = self.dense_max.shape[1]
        bound = wide_weights @ self.dense_max[wide] + np.bincount(blocks, asked * self.piece_max[pieces], minlength=n_blocks)

        def many(chosen: np.ndarray) -> bool:
            return len(chosen) * 3 > n_blocks

        def scored(chosen: np.ndarray) -> np.ndarray:
            """Scores of all examples in the chosen blocks, 0 elsewhere; of many chosen blocks those of all blocks."""
            if many(chosen):
                first, end = self.starts[terms].T
                per = weights
            else:
                used = np.bincount(chosen, minlength=n_blocks)[blocks] > 0
                first, end = self.piece_start[pieces[used]], self.piece_start[pieces[used] + 1]
                per = asked[used]
            at = _ranges(first, end)
            each = np.repeat(per, end - first) * self.weights[at]
            out = np.bincount(self.posted[at], each, minlength=n_blocks * BLOCK).astype(np.float64, copy=False)
            if per is weights:
                buffer = np.empty(len(out))
                for row, weight in zip(wide.tolist(), wide_weights.tolist()):
                    np.multiply(self.dense[row].ravel(), weight, out=buffer)
                    out += buffer
            else:
                out.reshape(-1, BLOCK)[chosen] += np.tensordot(wide_weights, self.dense[wide[:, None], chosen], 1)
            return out

        order = np.argsort(-bound, kind="stable")
        score = scored(order[:FIRST])
        least = float(np.partition(score, -k)[-k]) if len(score) > k else 0.0
        # Blocks by falling bound: the first that cannot reach the k-th best ends the search.
        rest = order[FIRST : int(np.searchsorted(-bound[order], -max(least - 1e-9, 1e-300), "right"))]
        if len(rest) and not many(order[:FIRST]):
            score = scored(rest) if many(rest) else score + scored(rest)
        hit = np.flatnonzero(score > 0)
        if len(hit) > k:
            hit = hit[score[hit] >= np.partition(score[hit], -k)[-k]]
        hit = hit[np.argsort(-score[hit], kind="stable")][:k]
        return list(zip(score[hit].tolist(), hit.tolist()))

    def score(self, text: str) -> tuple:
        """The fields of ``SCORED``."""
        terms, weights = self.vector(text)
        if not len(terms):
            return self.blank_share, int(self.blank_share >= 0.5), 0, ""
        key = hashlib.blake2b(terms.tobytes() + weights.tobytes(), digest_size=16).digest()
        if key not in self.answers:
            if len(self.answers) >= _ANSWERS:
                self.answers.clear()
            best = self.nearest(terms, weights)
            votes = [(1 / (NEAR + 1 - s), self.labels[i]) for s, i in best]
            mass = sum(v for v, _ in votes) + PRIOR_WEIGHT
            p = min(1.0, (sum(v * y for v, y in votes) + PRIOR_WEIGHT * self.share) / mass)
            shown = ",".join(f"{self.ids[i]}:{self.labels[i]}:{s:.3f}" for s, i in best[:3])
            self.answers[key] = float(p), int(p >= 0.5), len(terms), shown
        return self.answers[key]


def _by_value(spark: SparkSession, index: ExampleIndex) -> tuple[str, Broadcast]:
    """The index as bytes that need no installed copy of this package, and a name for it; its size is
    bounded by that of the sample."""
    return uuid4().hex, spark.sparkContext.broadcast(cloudpickle.dumps(index))


def _shared_index(shared: tuple[str, Broadcast]) -> ExampleIndex:
    name, index = shared
    held = per_process("toxicity", dict)
    if name not in held:
        held.clear()  # a process keeps one index
        held[name] = pickle.loads(index.value)
    return held[name]


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = EXAMPLES) -> DataFrame:
    """Texts and labels of at most ``bound`` labelled documents outside the held-out fold, the same on every
    run; of very long texts only as many as ``SAMPLE_BYTES`` hold."""
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(
        F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0
    )
    chosen = (
        usable.groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
        .limit(bound)
        .collect()
    )
    toxic = {r["doc_id"]: r["toxic"] for r in chosen}

    def label(ids: pa.Array) -> pa.Array:
        return pa.array([toxic.get(i) for i in ids.to_pylist()], pa.int32())

    labelled = docs.select("doc_id", "text").withColumn("toxic", F.arrow_udf(label, "int")(F.col("doc_id")))
    sample = written(labelled.where("toxic IS NOT NULL"), "toxicity-sample")
    sizes = sample.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("n")).collect()
    total, within = 0, []
    for r in sorted(sizes, key=lambda r: (hashlib.md5(str(r["doc_id"]).encode()).digest(), r["doc_id"])):
        total += r["n"] or 0
        if total <= SAMPLE_BYTES:
            within.append(r["doc_id"])
    return sample if len(within) == len(sizes) else sample.where(F.col("doc_id").isin(within))


def term_counts(sample: DataFrame) -> DataFrame:
    """Documents and toxic documents of every term of the sample: term, docs, toxic."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, toxic = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = set().union(*map(terms_of, _tokens(text or "")))
                docs.update(found)
                if label:
                    toxic.update(found)
        names = list(docs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([docs[t] for t in names], pa.int64()), pa.array([toxic[t] for t in names], pa.int64())],
            names=["term", "docs", "toxic"],
        )

    counted = sample.select("text", "toxic").mapInArrow(count, "term string, docs long, toxic long")
    return counted.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))


def telling_terms(summed: DataFrame, n: int, n_toxic: int) -> DataFrame:
    """At most ``TERMS`` terms by their chi-square for the toxic label: term, docs."""
    expected = F.col("docs") * (n_toxic / n)
    surplus = F.col("toxic") - expected
    chi2 = surplus * surplus / expected + surplus * surplus / (F.col("docs") - expected)
    telling = summed.where(F.col("docs") >= LEAST_DOCS).where((surplus > 0) & (F.col("toxic") * 2 >= F.col("docs")))
    ranked = telling.withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2)
    return ranked.orderBy(F.desc("chi2"), "term").limit(TERMS).select("term", "docs")


def fit(docs: DataFrame, labels: DataFrame, bound: int = EXAMPLES) -> ExampleIndex:
    """The index of a labelled sample.  The words of ``bound`` documents and their counts reach the driver, as Arrow."""
    sample = labelled_sample(docs, labels, bound)
    n, n_toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    summed = written(term_counts(sample), "toxicity-terms")
    found = telling_terms(summed, n, n_toxic).collect() if 0 < n_toxic < n else []
    vocabulary = {r["term"]: i for i, r in enumerate(found)}
    words = summed.where(~F.col("term").startswith("^")).select("term", "docs").orderBy("term").toArrow()
    n_docs = [r["docs"] for r in found]
    for word, count in zip(words["term"].to_pylist(), words["docs"].to_pylist()):
        if word not in vocabulary:
            vocabulary[word] = len(vocabulary)
            n_docs.append(count)
    idf = np.log((n + 1) / (np.array(n_docs, np.float64) + 1)) + 1
    idf[len(found) :] *= COMMON
    beginnings = frozenset(x[1 : 1 + PREFIXES[0]] for x in vocabulary if x.startswith("^"))
    rooted = np.array([*(w[: PREFIXES[0]] in beginnings for w in vocabulary), False])
    unseen = COMMON * (math.log(n + 1) + 1)
    index = ExampleIndex(vocabulary, len(found), beginnings, rooted, np.append(idf, OTHERS_IDF), unseen)
    shared = _by_value(docs.sparkSession, index)

    def row(text: str) -> tuple:
        terms, weights = _shared_index(shared).vector(text)
        return terms.tolist(), weights.tolist()

    vectors = sample.select("doc_id", "toxic", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), text_column("terms array<int>, weights array<double>", row, F.col("text")).alias("v"))
    rows = vectors.select("doc_id", "toxic", "digest", "v.*").toArrow().combine_chunks()
    shared[1].unpersist()
    digests = rows["digest"].to_pylist()
    toxic = rows["toxic"].to_numpy().astype(np.int64)
    sizes = np.array([len(x) for x in rows["terms"]], np.int64)
    ends = np.cumsum(sizes)
    terms, weights = (rows[c].combine_chunks().flatten().to_numpy() for c in ("terms", "weights"))
    ids = rows["doc_id"].to_pylist()

    def place(i: int) -> tuple:  # like examples share blocks, which makes their bounds tight
        own = terms[ends[i] - sizes[i] : ends[i]]
        return own[own < index.telling].tolist(), digests[i], int(toxic[i])

    order = np.array(sorted(np.flatnonzero(sizes).tolist(), key=place), np.int64)
    at = _ranges(ends[order] - sizes[order], ends[order])
    example, term, weight = np.repeat(np.arange(len(order)), sizes[order]), terms[at], weights[at]
    by_term = np.lexsort((example, term))
    example, term, index.weights = example[by_term], term[by_term].astype(np.int64), weight[by_term]
    index.posted = example.astype(np.int32)
    begins = np.searchsorted(term, np.arange(len(index.idf) + 1))
    index.starts = np.stack([begins[:-1], begins[1:]], axis=1)
    block = example // BLOCK
    change = np.ones(len(term), bool)
    change[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
    first = np.flatnonzero(change)
    index.pieces = np.searchsorted(term[first], np.arange(len(index.idf) + 1))
    index.piece_block = block[first].astype(np.int32)
    index.piece_max = np.maximum.reduceat(index.weights, first) if len(first) else np.zeros(0)
    index.piece_start = np.append(first, len(term))
    index.labels = toxic[order]
    begin, end = index.starts.T
    wide = np.flatnonzero(end - begin >= max(1, DENSE * len(order)))
    index.dense_row = np.full(len(index.idf), -1, np.int32)
    index.dense_row[wide] = np.arange(len(wide))
    blocks = -(-len(order) // BLOCK)
    padded = np.zeros((len(wide), blocks * BLOCK))
    for row, t in enumerate(wide.tolist()):
        padded[row, index.posted[begin[t] : end[t]]] = index.weights[begin[t] : end[t]]
    index.dense = padded.reshape(len(wide), blocks, BLOCK)
    index.dense_max = index.dense.max(axis=2)
    index.ids = [ids[i] for i in order.tolist()]
    index.share = n_toxic / n if n else 0.0
    blank = toxic[sizes == 0]
    index.blank_share = float(blank.mean()) if len(blank) else 0.0
    return index


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out and ``SCORED`` for every row of ``docs``."""
    shared = _by_value(docs.sparkSession, fit(docs, labels))
    score = text_column(SCORED, lambda x: _shared_index(shared).score(x), F.col("text"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return docs.select("doc_id", held_out.alias("held_out"), score.alias("s")).select("doc_id", "held_out", "s.*")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
