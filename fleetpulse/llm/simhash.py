"""SimHash near-duplicates: byte-position index, count filter, verification, components.

A fingerprint has eight bytes.  If two fingerprints differ in at most two bits
they share at least six positional bytes, and so at least two of the four byte
pairs whole.  The index therefore holds every fingerprint under the six ways to
choose two byte pairs (a list of a single byte would hold 1/256 of all
fingerprints, and all pairs of them).  Fingerprints that meet in a list are
tallied: those with six or more shared bytes are verified bit by bit.

A list longer than ``LIST_LIMIT`` comes from a large family of near copies and
would emit all its pairs.  Its members are linked exactly in another way: each
is put under itself and its 64 one-bit neighbours.  Two fingerprints meet under
such a key if and only if they differ in at most two bits, a key has at most 65
members, and each links to the least of them.  No pair is lost or capped.

Defined cases: a null or blank text has fingerprint zero and is linked like any
other; equal fingerprints are one node; a component without any doc_id has a
null id; repeated rows give repeated results; texts of any length count whole.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_column, with_row_key, written
from .components import components

MAX_BITS = 2
LEAST_SHARED_BYTES = 8 - MAX_BITS
LIST_LIMIT = 16
SHINGLE = 3

_hash = partial(xxhash.xxh64_intdigest, seed=42)
_BLOCK = 1 << 16


def fingerprint(text: str) -> bytes:
    """The eight bytes, highest bit first."""
    words = text.encode().lower().split()
    if not words:
        return bytes(8)
    if len(words) < SHINGLE:
        shingles, n = [b" ".join(words)], 1
    else:
        shingles, n = map(b" ".join, zip(words, words[1:], words[2:])), len(words) - SHINGLE + 1
    hashes = np.fromiter(map(_hash, shingles), ">u8", n).view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, _BLOCK):
        ones += np.unpackbits(hashes[k : k + _BLOCK], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(text: Column) -> Column:
    """Struct of the fingerprint as hex digits and as a 64-bit integer."""

    def row(x: str) -> tuple:
        f = fingerprint(x)
        return f.hex(), int.from_bytes(f, "big", signed=True)

    return text_column("fingerprint string, bits long", row, text)


def _word16(bits: Column, k: int) -> Column:
    return F.shiftrightunsigned(bits, 16 * k).bitwiseAND(0xFFFF)


def links(nodes: DataFrame) -> DataFrame:
    """Links (u, v) between the distinct ``bits`` of ``nodes``: all pairs of short lists, and of long
    lists enough of them to connect the same fingerprints."""
    bits = F.col("bits")
    lists = F.array(
        *(
            F.struct(F.lit(k).alias("choice"), (F.shiftleft(_word16(bits, i), 16) + _word16(bits, j)).alias("key"))
            for k, (i, j) in enumerate(combinations(range(4), 2))
        )
    )
    index = nodes.select("bits", F.explode(lists).alias("at")).select("bits", "at.choice", "at.key")
    sizes = index.groupBy("choice", "key").agg(F.count("*").alias("size")).where("size > 1")
    index = written(index.join(sizes, ["choice", "key"]), "simhash-index")

    short = index.where(F.col("size") <= LIST_LIMIT)
    a, b = short.alias("a"), short.alias("b")
    met = a.join(b, ["choice", "key"]).where("a.bits < b.bits")
    differ = F.col("a.bits").bitwiseXOR(F.col("b.bits"))
    shared = sum((F.shiftrightunsigned(differ, 8 * p).bitwiseAND(0xFF) == 0).cast("int") for p in range(8))
    pairs = (
        met.where(shared >= LEAST_SHARED_BYTES)
        .where(F.bit_count(differ) <= MAX_BITS)
        .select(F.col("a.bits").alias("u"), F.col("b.bits").alias("v"))
    )

    flips = F.array(F.lit(0), *(F.lit(1 << p if p < 63 else -(1 << 63)) for p in range(64)))
    family = index.where(F.col("size") > LIST_LIMIT).select("bits").distinct()
    near = family.select("bits", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(bits))).alias("key"))
    least = near.groupBy("key").agg(F.min("bits").alias("v"), F.count("*").alias("n")).where("n > 1")
    stars = near.join(least, "key").where("bits <> v").select(F.col("bits").alias("u"), "v")
    return pairs.unionByName(stars).distinct()


def rooted(found: DataFrame) -> DataFrame:
    """``bits`` and ``root`` of every distinct fingerprint of ``found``, and the least doc_id that has it."""
    nodes = found.groupBy("bits").agg(F.min("doc_id").alias("first"))
    roots = components(links(nodes)).withColumnRenamed("node", "bits")
    # Only linked nodes take their component from elsewhere.
    return written(nodes.join(roots, "bits", "left").withColumn("root", F.coalesce("root", "bits")), "simhash-nodes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id (least doc_id reachable over links) of every row of ``docs``."""
    found = written(docs.select("doc_id", fingerprints(F.col("text")).alias("f")).select("doc_id", "f.*"), "simhash")
    nodes = rooted(found)
    least = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = nodes.join(least, "root").select("bits", "component_id")
    return found.join(ids, "bits").select("doc_id", "fingerprint", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` of every component: that of the least doc_id, of several such rows the first written;
    a component without any doc_id keeps a row too."""
    rows, row = with_row_key(docs, "simhash-rows")
    keyed = rows.select("doc_id", F.col(row).alias("row"), fingerprints(F.col("text")).alias("f"))
    found = written(keyed.select("doc_id", "row", "f.bits"), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    # Copies are combined per fingerprint before they meet their component.
    picks = found.groupBy("bits").agg(first.alias("pick")).join(rooted(found).select("bits", "root"), "bits")
    kept = picks.groupBy("root").agg(F.min("pick").alias("pick")).select(F.col("pick.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
