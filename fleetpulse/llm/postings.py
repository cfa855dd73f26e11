"""Benchmark decontamination by a distributed positional inverted index.

The training texts are cut into chunks of some megabytes.  Each task turns its
chunks into postings: one row per chunk and term with the ascending places of
the term, written once to the shared folder.  A document's words follow each
other in a chunk, and documents lie ``GAP`` places apart, so no match crosses
from one into the next.

The benchmark's windows are asked in blocks of bounded size.  A block's terms
are counted over the whole index, which tells the rarest ones; a window with a
term that occurs nowhere is done.  The lists of the block's terms meet per
chunk.  A window begins with the list of its rarest term, moved back by the
term's offset, and is intersected with the moved list of the next rarest one
until no start or no term is left: starts that are left are exact phrases.  In
the same way a proximity match is a stretch of at most ``SLACK`` words more
than the window that holds all its words in any order.

A term's list is split by chunk, so a term that is a third of all words is
never in one task.  A chunk holds ``CHUNK_BYTES`` of text or one longer text.

Defined cases: a null text has no words; a row of the documents gives a row,
also when rows or ids repeat; a benchmark row without words matches nothing;
rows of one item_id are one item, and rows without an item_id are one item with
an empty name; no benchmark leaves every document clean; no documents give no
rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

WINDOW = 10
#: Words that a proximity match may have more than its window.
SLACK = 5
GAP = WINDOW + SLACK
CHUNK_BYTES = 4 << 20
#: Words of a block of windows, in bytes; what is broadcast at once has about this size.
BLOCK_BYTES = 4 << 20
#: Starts that are intersected at once.
STARTS = 1 << 20
#: The term under which a chunk lists where its documents begin; no word is empty.
BEGINS = ""
_SHIFT = 40

#: A-Z become a-z, signs and blanks become blanks, all other bytes stay.
_FOLD = np.array(
    [b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8
)


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each one begins; nulls are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(ends) or ends[0] == ends[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def split_words(data: np.ndarray, begins: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts laid end to end in ``data``, and how many each text has."""
    folded = _FOLD[data]
    word = folded != 32
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = begins[1:-1]
    inner = inner[inner < len(word)]
    first[inner] |= word[inner]  # a text's first word begins with it
    at = np.flatnonzero(first)
    size = np.diff(np.append(np.cumsum(word)[at] - 1, np.count_nonzero(word))) if len(at) else at
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    words = pa.Array.from_buffers(
        pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(folded[word]))]
    )
    return words, np.diff(np.searchsorted(at, begins))


def chunk_postings(data: np.ndarray, begins: np.ndarray) -> tuple[pa.Array, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Terms of a chunk, their counts and places; first place and number of words of each document."""
    words, counts = split_words(data, begins)
    document = np.repeat(np.arange(len(counts)), counts)
    place = (np.arange(len(words)) + document * GAP).astype(np.int32)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    n = np.bincount(codes, minlength=len(coded.dictionary))
    ends = np.concatenate([[0], np.cumsum(n)]) * 4
    raw = place[order].tobytes()
    places = [raw[a:b] for a, b in zip(ends, ends[1:])]
    starts = (np.cumsum(counts) - counts + np.arange(len(counts)) * GAP).astype(np.int32)
    return coded.dictionary, n, places, starts, counts


def _pieces(begins: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``CHUNK_BYTES``, or of one longer text."""
    a, n = 0, len(begins) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(begins, begins[a] + CHUNK_BYTES, "right")) - 1)
        yield a, min(b, n)
        a = b


def positional_index(docs: DataFrame) -> DataFrame:
    """The stored index: chunk, term, n, places; the rows of ``BEGINS`` also hold the chunk's documents."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"chunk long, term string, n int, places binary, documents array<struct<doc_id: {id_type}, n_words: long>>"

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.columns
            data, begins = _flat(texts)
            for a, b in _pieces(begins):
                terms, n, places, starts, counts = chunk_postings(data[begins[a] : begins[b]], begins[a : b + 1] - begins[a])
                listed = pa.StructArray.from_arrays(
                    [ids.slice(a, b - a), pa.array(counts, pa.int64())], names=["doc_id", "n_words"]
                )
                own = pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed)
                size = len(terms) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(size, chunk)),
                        pa.concat_arrays([pa.array([BEGINS]), terms.cast(pa.string())]),
                        pa.array(np.append(len(starts), n).astype(np.int32)),
                        pa.array([starts.tobytes(), *places], pa.binary()),
                        pa.concat_arrays([own, pa.nulls(size - 1, own.type)]),
                    ],
                    names=["chunk", "term", "n", "places", "documents"],
                )
                chunk += 1

    return written(docs.select("doc_id", "text").mapInArrow(index, schema), "postings")


def words_of(text: Column) -> Column:
    """The array of words of each text."""

    def split(texts: pa.Array) -> pa.Array:
        words, counts = split_words(*_flat(texts))
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        return pa.ListArray.from_arrays(ends, words.cast(pa.string()))

    return F.arrow_udf(split, "array<string>")(text)


def benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The distinct windows of each item, item_id as text and the words, dealt over blocks; how many blocks."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_of(F.col("text")).alias("w"))
    size = F.least(F.size("w"), F.lit(WINDOW))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    each = items.where(F.size("w") > 0).select("item_id", "w", F.explode(starts).alias("at"), size.alias("size"))
    windows = written(each.select("item_id", F.slice("w", F.col("at"), F.col("size")).alias("words")).distinct(), "windows")
    total = windows.agg(F.sum(F.length(F.array_join("words", " ")) + F.length("item_id"))).first()[0] or 0
    blocks = math.ceil(total / BLOCK_BYTES)
    return windows.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), F.lit(max(1, blocks)))), blocks


class Block:
    """A block of windows as arrays: the number of each word's term, rarest term first, and its offset."""

    def __init__(self, items: list[str], windows: list[list[str]], counts: dict[str, int]):
        alive = [k for k, words in enumerate(windows) if all(w in counts for w in words)]
        self.items = sorted({items[k] for k in alive})
        number = {name: k for k, name in enumerate(self.items)}
        self.terms = sorted({w for k in alive for w in windows[k]})
        code = {t: k for k, t in enumerate(self.terms)}
        self.item = np.array([number[items[k]] for k in alive], np.int64)
        self.size = np.array([len(windows[k]) for k in alive], np.int64)
        self.term = np.full((len(alive), WINDOW), -1, np.int64)
        self.offset = np.zeros((len(alive), WINDOW), np.int64)
        for row, k in enumerate(alive):
            ranked = sorted(range(len(windows[k])), key=lambda i: (counts[windows[k][i]], i))
            self.term[row, : len(ranked)] = [code[windows[k][i]] for i in ranked]
            self.offset[row, : len(ranked)] = ranked


class Lists:
    """The lists of one chunk's terms as one ascending array of (term, place)."""

    def __init__(self, codes: np.ndarray, places: list[bytes], n_terms: int):
        order = np.argsort(codes)
        values = [np.frombuffer(places[k], np.int32) for k in order]
        sizes = np.array([len(v) for v in values], np.int64)
        self.count = np.zeros(n_terms, np.int64)
        self.count[codes[order]] = sizes
        self.begin = np.cumsum(self.count) - self.count
        self.place = np.concatenate(values).astype(np.int64)
        self.key = (np.repeat(codes[order], sizes) << _SHIFT) + self.place

    def has(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each term's list has a place from ``low`` to ``high``."""
        base = term << _SHIFT
        at = np.searchsorted(self.key, base + np.maximum(low, 0))
        return (at < len(self.key)) & (self.key[np.minimum(at, len(self.key) - 1)] <= base + high) & (high >= 0)

    def starts(self, block: Block, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each window of ``rows`` with all places of its rarest term."""
        rarest = block.term[rows, 0]
        n = self.count[rarest]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(rows, n), self.place[np.repeat(self.begin[rarest], n) + inside]


def phrases(lists: Lists, block: Block, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows, starts and places left after the moved lists of all their terms are intersected."""
    for rank in range(1, WINDOW):
        term, at = block.term[row, rank], place - block.offset[row, 0] + block.offset[row, rank]
        keep = (term < 0) | lists.has(term, at, at)
        row, place = row[keep], place[keep]
        if not len(row):
            break
    return row, place - block.offset[row, 0], place


def stretches(lists: Lists, block: Block, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows whose words all lie in a stretch of ``SLACK`` words more that holds ``place``, and its start."""
    for rank in range(1, WINDOW):
        term, reach = block.term[row, rank], block.size[row] + SLACK - 1
        keep = (term < 0) | lists.has(term, place - reach, place + reach)
        row, place = row[keep], place[keep]
        if not len(row):
            return row, place, place
    reach = block.size[row] + SLACK - 1
    start = np.full(len(row), -1)
    for back in range(WINDOW + SLACK):
        begin = place - back
        good = (start < 0) & (back <= reach) & (begin >= 0)
        for rank in range(1, WINDOW):
            at = np.flatnonzero(good)
            term = block.term[row[at], rank]
            good[at] = (term < 0) | lists.has(term, begin[at], begin[at] + reach[at])
        start[good] = begin[good]
    found = start >= 0
    return row[found], start[found], place[found]


def _runs(first: np.ndarray, last: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping or touching intervals of a group as one each."""
    order = np.lexsort((first, group))
    first, last, group = first[order], last[order], group[order]
    # Groups are kept apart by moving each behind the one before.
    rank = np.unique(group, return_inverse=True)[1]
    moved = rank * (last.max() + 1)
    reach = np.maximum.accumulate(last + moved)
    new = np.append(True, (first + moved)[1:] > reach[:-1])
    ends = np.append(np.flatnonzero(new)[1:], len(first)) - 1
    return first[new], reach[ends] - moved[ends], group[new]


MATCH = "chunk long, document int, item_id string, first long, last long, exact boolean"
_MATCH = pa.schema(
    [("chunk", pa.int64()), ("document", pa.int32()), ("item_id", pa.string())]
    + [("first", pa.int64()), ("last", pa.int64()), ("exact", pa.bool_())]
)


def _match(block: Block, key: tuple, group: pa.Table) -> pa.Table:
    """Matches of a block in one chunk: words ``first`` to ``last`` (exclusive) of its documents."""
    code = {t: k for k, t in enumerate(block.terms)}
    terms, places = group["term"].to_pylist(), group["places"].to_pylist()
    begins = np.frombuffer(places[terms.index(BEGINS)], np.int32).astype(np.int64)
    own = [(code[t], p) for t, p in zip(terms, places) if t != BEGINS]
    found = []
    if own:
        lists = Lists(np.array([c for c, _ in own]), [p for _, p in own], len(block.terms))
        there = np.append(lists.count > 0, True)
        rows = np.flatnonzero(there[block.term].all(axis=1))
        cost = np.cumsum(lists.count[block.term[rows, 0]])
        cuts = np.searchsorted(cost, np.arange(STARTS, cost[-1], STARTS)) if len(rows) else []
        for part in np.split(rows, cuts):
            row, place = lists.starts(block, part)
            for exact, find in ((True, phrases), (False, stretches)):
                at, start, inside = find(lists, block, row, place)
                end = start + block.size[at] + (0 if exact else SLACK)
                found.append((np.searchsorted(begins, inside, "right") - 1, block.item[at], start, end, np.full(len(at), exact)))
    if not sum(len(x[0]) for x in found):
        return _MATCH.empty_table()
    document, item, first, last, exact = map(np.concatenate, zip(*found))
    first, last, group_of = _runs(first, last, (document * len(block.items) + item) * 2 + exact)
    document, item = np.divmod(group_of // 2, len(block.items))
    columns = [
        pa.array(np.full(len(first), key[0].as_py())),
        pa.array(document.astype(np.int32)),
        pa.array(block.items).take(pa.array(item)),
        pa.array(np.maximum(first - begins[document], 0)),
        pa.array(last - begins[document]),
        pa.array(group_of % 2 == 1),
    ]
    return pa.table(columns, schema=_MATCH)


def _matcher(block: Block) -> Callable:
    def match(key, group):
        return _match(block, key, group)

    return match


def matches(index: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All phrase and proximity matches of the items' windows: ``MATCH``, runs of an item put together."""
    spark = index.sparkSession
    windows, blocks = benchmark_windows(benchmark)
    found = spark.createDataFrame([], MATCH)
    for number in range(blocks):
        asked = windows.where(F.col("block") == number).select("item_id", "words").toArrow()
        names, words = asked["item_id"].to_pylist(), asked["words"].to_pylist()
        terms = spark.createDataFrame([(t,) for t in sorted({w for x in words for w in x})], "term string")
        # A block's terms have a bounded size, so they may be broadcast.
        counts = index.select("term", "n").join(F.broadcast(terms), "term").groupBy("term").agg(F.sum("n").alias("n"))
        block = Block(names, words, dict(counts.collect()))
        if not len(block.item):
            continue
        lookup = spark.createDataFrame([(t,) for t in (BEGINS, *block.terms)], "term string")
        wanted = index.select("chunk", "term", "places").join(F.broadcast(lookup), "term")
        found = found.unionByName(written(wanted.groupBy("chunk").applyInArrow(_matcher(block), MATCH), "matches"))
    return found


def decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: its words, those inside a phrase match, and the items matched."""
    index = positional_index(docs)
    found = matches(index, benchmark)
    key = ["chunk", "document"]
    # Words under at least one phrase: what each run adds to the runs before it.
    before = Window.partitionBy(*key).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("last").over(before), F.lit(0))
    added = F.greatest(F.lit(0), F.col("last") - F.greatest("first", reached))
    hit = found.where("exact").withColumn("added", added).groupBy(*key).agg(F.sum("added").alias("n_hit"))
    items = found.select(*key, "item_id", "exact").distinct().groupBy(*key).agg(
        F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item_id")))).alias("items"),
        F.count_distinct("item_id").alias("n_near_items"),
    )
    listed = index.where(F.col("term") == BEGINS).select("chunk", F.posexplode("documents").alias("document", "d"))
    named = F.coalesce("items", F.array().cast("array<string>"))
    return (
        listed.join(hit, key, "left")
        .join(items, key, "left")
        .select(
            "d.doc_id",
            "d.n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(named).cast("long").alias("n_items"),
            F.sha2(F.array_join(named, ","), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
            F.coalesce("n_near_items", F.lit(0)).cast("long").alias("n_near_items"),
        )
    )


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
  doc AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_WORDS}, []) AS w FROM documents),
  asked AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size,
      w[k:k + least(len(w), {WINDOW}) - 1] AS words FROM item, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS u(k) WHERE len(w) > 0),
  place AS (SELECT r, k, size, w[k:k + size - 1] AS words FROM doc, (SELECT DISTINCT size FROM asked) z,
      unnest(range(1, len(w) - size + 2)) AS u(k)),
  met AS (SELECT r, k, place.size AS size, item_id FROM place JOIN asked USING (words)),
  hit AS (SELECT r, count(DISTINCT k + j) AS n FROM met, unnest(range(size)) AS u(j) GROUP BY r),
  place1 AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM doc),
  freq AS (SELECT word, count(*) AS n FROM place1 GROUP BY word),
  rare AS (SELECT item_id, size, words, arg_min(x, freq.n) AS word FROM (SELECT *, unnest(words) AS x FROM asked) LEFT JOIN freq ON word = x
    GROUP BY ALL HAVING count(*) = count(freq.n)),
  near AS (SELECT r, count(DISTINCT item_id) AS n FROM rare JOIN place1 USING (word) JOIN doc USING (r) WHERE len(list_filter(range(size + {SLACK}),
      lambda b: list_has_all(w[greatest(1, k - b):k - b + size + {SLACK} - 1], words))) > 0 GROUP BY r),
  named AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM met) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated,
  CAST(coalesce(near.n, 0) AS BIGINT) AS n_near_items
FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r) LEFT JOIN near USING (r)
"""
