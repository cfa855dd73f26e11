"""Document fingerprints by a homomorphic multiset hash.

A document is the multiset of its paragraphs (lines; long ones in pieces of
``PIECE`` characters from their start, numbered).  Each piece is hashed to a
wide vector, and the fingerprint is the sum of the vectors lane by lane modulo
powers of two.  So the order of paragraphs does not matter, and a paragraph is
inserted or deleted by adding or subtracting its vector, without the rest.

Lanes: ``WIDE`` of 32 bits for equality, one of 32 bits that counts the pieces,
and ``SIGNS`` of 16 bits that sum +1 or -1 each.  The squared difference of two
sums of signs estimates how many pieces two documents do not share (relative
error about 12 %), which gives the likeness 1 - different / all pieces.

Defined cases: a null text counts as empty, which is one empty paragraph; equal
doc_ids stand in the order of the MD5 of their texts and null ids come last; a
table of one document has itself as the next one; texts are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

PIECE = 256
WIDE = 12
SIGNS = 128
_DIGEST = 4 * WIDE + SIGNS // 8

EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


class Multiset:
    """A fingerprint: sums that pieces can be added to and taken from."""

    __slots__ = ("wide", "count", "signs")

    def __init__(self, wide: np.ndarray, count: int, signs: np.ndarray):
        self.wide, self.count, self.signs = wide, count, signs

    def __add__(self, other: Multiset) -> Multiset:
        return Multiset(self.wide + other.wide, self.count + other.count, self.signs + other.signs)

    def __sub__(self, other: Multiset) -> Multiset:
        return Multiset(self.wide - other.wide, self.count - other.count, self.signs - other.signs)

    def hex(self) -> str:
        count = (self.count % (1 << 32)).to_bytes(4, "big")
        return (self.wide.astype(">u4").tobytes() + count + self.signs.astype(">u2").tobytes()).hex()

    def likeness(self, other: Multiset) -> float:
        """Estimated share of pieces in common, 0 to 1; exactly 1 for equal fingerprints."""
        apart = (self.signs - other.signs).view(np.int16).astype(np.float64)
        if not apart.any() and np.array_equal(self.wide, other.wide):
            return 1.0
        return max(0.0, 1.0 - float((apart**2).mean()) / max(1, self.count + other.count))


def pieces(text: str) -> list[str]:
    """The pieces of a text, those that are not the first of their paragraph marked by their number."""
    out = []
    for line in text.split("\n"):
        if len(line) <= PIECE:
            out.append(line)
        else:
            out += [f"{k // PIECE}\n{line[k : k + PIECE]}" if k else line[:PIECE] for k in range(0, len(line), PIECE)]
    return out


def digests(parts: list[str]) -> np.ndarray:
    raw = b"".join([hashlib.blake2b(p.encode(), digest_size=_DIGEST).digest() for p in parts])
    return np.frombuffer(raw, np.uint8).reshape(-1, _DIGEST)


def total(hashed: np.ndarray) -> Multiset:
    n = len(hashed)
    wide = np.ascontiguousarray(hashed[:, : 4 * WIDE]).view("<u4").sum(axis=0, dtype=np.uint32)
    ones = np.zeros(SIGNS, np.int64)
    for k in range(0, n, 1 << 16):
        ones += np.unpackbits(hashed[k : k + (1 << 16), 4 * WIDE :], axis=1).sum(axis=0, dtype=np.int64)
    return Multiset(wide, n, (2 * ones - n).astype(np.uint16))


def multiset(text: str) -> Multiset:
    return total(digests(pieces(text)))


class Document:
    """A text with its pieces and their hashes."""

    __slots__ = ("doc_id", "text", "parts", "hashed", "print")

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.parts = pieces(text)
        self.hashed = digests(self.parts)
        self.print = total(self.hashed)

    def edited(self, following: str) -> tuple[str, Multiset]:
        """The text with its last half replaced from ``following``, and its fingerprint, got from
        this one by deleting the pieces that go and inserting those that come."""
        n = len(self.text)
        text = self.text[: n - n // 2] + following[: n // 2]
        new = pieces(text)
        same = next((k for k, (a, b) in enumerate(zip(self.parts, new)) if a != b), min(len(self.parts), len(new)))
        changed = self.print - total(self.hashed[same:]) + total(digests(new[same:]))
        return text, changed

    def row(self, following: Document) -> tuple:
        text, changed = self.edited(following.text)
        return (
            self.doc_id,
            len(self.text),
            hashlib.sha256(text.encode()).hexdigest(),
            self.print.hex(),
            changed.hex(),
            self.print.likeness(changed),
            self.print.likeness(following.print),
        )


def _squeezed(texts: pa.Array) -> pa.Array:
    pack = zstandard.ZstdCompressor(level=1).compress
    return pa.array([pack((x or "").encode()) for x in texts.to_pylist()], pa.binary())


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, guest, doc_id, packed) in order: each document with the one behind it in its
    bucket.  The last one of a bucket is a guest, there only to be followed."""
    unpack = zstandard.ZstdDecompressor().decompress
    names = [x.split()[0] for x in EDITED.split(",")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def found() -> Iterator[tuple]:
        before, bucket_before = None, None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for bucket, guest, doc_id, packed in zip(*columns):
                own = Document(doc_id, unpack(packed).decode())
                if before is not None and bucket == bucket_before:
                    yield before.row(own)
                before, bucket_before = (None if guest else own), bucket

    rows = found()
    while part := list(islice(rows, 2000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), kinds)], names=names)


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """``EDITED`` for every row of ``docs``.

    The order by doc_id is cut into buckets at quantiles of the ids.  Each bucket
    also gets the first document of the next one as a guest, so every document
    meets its successor with one shuffle of the texts, which travel compressed.
    Buckets are found from the ids alone, so only texts without an id are read before.
    """
    spark = docs.sparkSession
    tie = F.md5(F.coalesce("text", F.lit("")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Small buckets spread evenly; at most so many cuts and first documents reach the driver, whatever the table holds.
    n_buckets = 4 * n
    quantiles = [k / n_buckets for k in range(1, n_buckets)]
    cuts = np.array(docs.approxQuantile("doc_id", quantiles, 0.25 / n_buckets), np.float64)

    def place(ids: pa.Array) -> pa.Array:
        """0 for the greatest ids; null ids come last."""
        known = np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        last = n_buckets + 1
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), last, len(cuts) - known), pa.int32())

    bucket = F.arrow_udf(place, "int")(F.col("doc_id"))
    rows = docs.select("doc_id", "text").withColumn("bucket", bucket)
    known = docs.select("doc_id").where("doc_id IS NOT NULL").withColumn("bucket", bucket)
    firsts = [(r[0], r[1], None) for r in known.groupBy("bucket").agg(F.max("doc_id")).orderBy("bucket").collect()]
    nameless = docs.where("doc_id IS NULL").agg(F.min(tie)).first()[0]
    if nameless is not None:
        firsts.append((n_buckets + 1, None, nameless))
    # bucket of the guest's host, by the guest
    hosts = {(doc_id, tie_of): firsts[k - 1][0] for k, (_, doc_id, tie_of) in enumerate(firsts)}

    def host(ids: pa.Array, ties: pa.Array) -> pa.Array:
        return pa.array([hosts.get(x) for x in zip(ids.to_pylist(), ties.to_pylist())], pa.int32())

    seats = F.array(
        F.struct("bucket", F.lit(False).alias("guest")), F.struct(F.col("host").alias("bucket"), F.lit(True).alias("guest"))
    )
    seated = (
        rows.withColumn("host", F.arrow_udf(host, "int")(F.col("doc_id"), F.when(F.col("doc_id").isNull(), tie)))
        .withColumn("packed", F.arrow_udf(_squeezed, "binary")(F.col("text")))
        .select("doc_id", tie.alias("tie"), "packed", F.explode(seats).alias("seat"))
        .where("seat.bucket IS NOT NULL")
        .select("seat.bucket", "seat.guest", "doc_id", "tie", "packed")
    )
    ordered = seated.repartition(n, "bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "tie")
    return ordered.select("bucket", "guest", "doc_id", "packed").mapInArrow(_follow, EDITED)


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(table(spark, sf_dir, "documents"))
