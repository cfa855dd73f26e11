"""Conversation prefix trie in balanced parentheses, a shard of neighbouring paths at a time.

Every conversation is rebuilt: it begins with the first turns of the first
conversation of its hundred.  A path is the row of its turns' hashes (128 bits),
so equal paths are one row with a count after a combine.  Paths are sorted over
ranges; a shard is a run of neighbouring paths, and its trie is written as
parentheses: closing those that the next path leaves, opening those it adds.

The excess of opened over closed parentheses has its range per block and a tree
of minima above; a search for the first fall needs the lower end of a range only.
``findclose`` of a parenthesis looks in the rest of its block, climbs to the next
block whose minimum is low enough, and looks in that block.  It delimits the subtree, and everything else is a
difference at the two ends: the rank of ``()`` pairs counts leaves, cumulative
arrays give members and savings, and the least member is a range minimum.

A node on the first or last path of a shard may go on in the next shard.  These
spines are emitted as partial rows and merged by node: members, children and
leaves add up, and a merged node's own leaf and saving are passed up the spines
of its owner, one of the shards that hold it.  Other nodes are final.

A path holds ``SEGMENT`` turns at most.  A longer conversation hangs its next
segment under the node where the segment before ends; segments are done from
the deepest, whose totals enter the ends of the paths above.  So no row grows
with a conversation, and turns are numbered without gathering one.

Defined cases: turns go by number, nulls first, then by a hash of role and text;
a null role or text is empty; rows without conv_id belong to no conversation and
are left out, since members are told by their numbers; repeated rows are repeated
turns; no conversations give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .turns import joined_digests, with_position

HUNDRED, MOST_SHARED = 100, 6
#: Turns of a path; nodes of a shard, about; parentheses of a block of the excess.
SEGMENT = 1024
SHARD_NODES = 1 << 18
EXCESS_BLOCK = 64
PARTS = ("s1", "s2", "s3", "s4")


# --- rebuilt conversations


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, position, hashes a and b, chars) and all conv_ids."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    light = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"),
        "turn",
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(text, F.lit(SEGMENT), role).alias("b"),
        F.length(text).alias("chars"),
    )
    own = written(with_position(light, "conv_id", [F.col("turn"), F.col("a"), F.col("b")]).drop("turn"), "own-turns")
    shared = (F.crc32(F.col("conv_id").cast("string")) % MOST_SHARED).alias("h")
    host = (F.col("conv_id") - F.col("conv_id") % HUNDRED).alias("host")
    hosts = own.where((F.col("conv_id") % HUNDRED == 0) & (F.col("position") < MOST_SHARED))
    first = hosts.select(F.col("conv_id").alias("host"), "position", "a", "b", "chars")
    ids = own.select("conv_id").distinct()
    begun = ids.select("conv_id", shared, host).join(first, "host").where(F.col("position") <= F.col("h"))
    there = first.groupBy("host").agg(F.count("*").alias("n"))
    rest = own.select("*", shared, host).where(F.col("position") > F.col("h")).join(there, "host", "left")
    moved = F.col("position") - F.col("h") + F.least("h", F.coalesce("n", F.lit(0)))
    columns = ["conv_id", "position", "a", "b", "chars"]
    return begun.select(*columns).unionByName(rest.withColumn("position", moved).select(*columns)), ids


def paths(turns: DataFrame) -> DataFrame:
    """Distinct paths: segment, keys of the node they start from and end at, turns, members, and
    the digest of the members that end there (null if none does)."""
    rows, ids = rebuilt(turns)
    halves = [
        x
        for h in (F.xxhash64("position", "a", "b"), F.xxhash64("b", F.lit(SEGMENT), "position", "a"))
        for x in (h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))
    ]
    turn = F.struct("position", "a", "b", "chars")
    segments = rows.groupBy("conv_id", F.floor((F.col("position") - 1) / SEGMENT).alias("segment")).agg(
        F.array_sort(F.collect_list(turn)).alias("turns"), *(F.sum(x).alias(p) for p, x in zip(PARTS, halves))
    )
    # Conversations without turns end at the root.
    bare = ids.join(rows.select("conv_id").distinct(), "conv_id", "left_anti").withColumn("segment", F.lit(0).cast("long"))
    segments = segments.unionByName(bare, allowMissingColumns=True)
    order = Window.partitionBy("conv_id").orderBy("segment")
    sofar = order.rowsBetween(Window.unboundedPreceding, 0)
    sums = {p: F.sum(F.coalesce(p, F.lit(0))).over(sofar) for p in PARTS}
    reached = segments.withColumns(sums).withColumn("last", F.lead("segment").over(order).isNull())
    end = F.md5(F.concat_ws(",", *PARTS)).alias("end")
    reached = reached.select("conv_id", "segment", "turns", "last", end)
    start = F.coalesce(F.lag("end").over(order), F.lit("root")).alias("start")
    reached = written(reached.select("*", start), "segments")
    path = F.transform(F.coalesce("turns", F.array()), lambda t: F.struct(t.a.alias("a"), t.b.alias("b"), t.chars.alias("chars")))
    found = reached.groupBy("segment", "start", "end").agg(
        F.first("turns").alias("turns"), F.count("*").alias("n"), F.min("conv_id").alias("least")
    )
    ended = joined_digests(
        reached.where("last").select("end", "conv_id", F.col("conv_id").cast("string").alias("id")), "end", ["conv_id"], "id", ","
    )
    # Conversations that end where a deeper segment starts are members of that node too.
    before = found.select((F.col("segment") + 1).alias("segment"), F.col("end").alias("start"), F.col("least").alias("start_least"))
    named = found.withColumn("path", path).drop("turns").join(before, ["segment", "start"], "left")
    return written(named.join(ended, "end", "left"), "paths")


# --- balanced parentheses


class Parentheses:
    """A trie as bits, 1 to open and 0 to close, with the excess in blocks."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.opens = np.flatnonzero(bits)
        self.rank = np.cumsum(bits)
        self.excess = np.cumsum(np.where(bits, 1, -1))
        blocks = -(-len(bits) // EXCESS_BLOCK)
        padded = np.full(blocks * EXCESS_BLOCK, np.iinfo(np.int64).max)
        padded[: len(bits)] = self.excess
        self.grid = padded.reshape(blocks, EXCESS_BLOCK)
        # Minima of blocks, of pairs of blocks, and so on.  The excess is never negative, so a close is
        # found where it first falls and the minima alone decide.
        self.levels = [self.grid.min(axis=1)]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            low = np.append(low, np.iinfo(np.int64).max) if len(low) % 2 else low
            self.levels.append(low.reshape(-1, 2).min(axis=1))

    def _first(self, block: np.ndarray, after: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Place in ``block`` behind ``after`` where the excess first is at most ``target``; -1 if nowhere."""
        out = np.full(len(block), -1)
        for k in range(0, len(block), 1 << 14):
            part = slice(k, k + (1 << 14))
            place = block[part, None] * EXCESS_BLOCK + np.arange(EXCESS_BLOCK)
            low = (self.grid[block[part]] <= target[part, None]) & (place > after[part, None])
            at = low.argmax(axis=1)
            out[part] = np.where(low[np.arange(len(at)), at], block[part] * EXCESS_BLOCK + at, -1)
        return out

    def _next_block(self, block: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first block behind ``block`` with a minimum of at most ``target``; there is one."""
        node, level = block.copy(), np.zeros(len(block), np.int64)
        found = np.full(len(block), -1)
        climbing = np.arange(len(block))
        for height, low in enumerate(self.levels):
            # A right neighbour that is low enough ends the climb.
            right = node[climbing] + 1
            is_left = node[climbing] % 2 == 0
            good = is_left & (right < len(low)) & (low[np.minimum(right, len(low) - 1)] <= target[climbing])
            found[climbing[good]], level[climbing[good]] = right[good], height
            climbing = climbing[~good]
            node[climbing] //= 2
        for height in range(len(self.levels) - 1, 0, -1):
            down = np.flatnonzero(level == height)
            left = found[down] * 2
            low = self.levels[height - 1]
            found[down] = np.where(low[left] <= target[down], left, left + 1)
            level[down] -= 1
        return found

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The parenthesis that closes each opening one."""
        target = self.excess[at] - 1
        block = at // EXCESS_BLOCK
        out = self._first(block, at, target)
        far = np.flatnonzero(out < 0)
        if len(far):
            there = self._next_block(block[far], target[far])
            out[far] = self._first(there, np.full(len(far), -1), target[far])
        return out


def _common(starts: np.ndarray, size: np.ndarray, begin: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Nodes, the one they start from included, that each path shares with the one before."""
    n = len(size)
    shared = np.zeros(n, np.int64)
    alive = np.flatnonzero(starts[1:] == starts[:-1]) + 1
    depth = 0
    while len(alive):
        shared[alive] += 1
        alive = alive[(size[alive] > depth) & (size[alive - 1] > depth)]
        x, y = begin[alive] + depth, begin[alive - 1] + depth
        alive = alive[(a[x] == a[y]) & (b[x] == b[y])]
        depth += 1
    return shared


def _range_minimum(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of ``values[low..high]``, both included."""
    steps = [values]
    while 2 * (1 << (len(steps) - 1)) <= len(values):
        last, half = steps[-1], 1 << (len(steps) - 1)
        steps.append(np.minimum(last[:-half], last[half:]))
    power = np.floor(np.log2(high - low + 1)).astype(np.int64)
    out = np.empty(len(low), values.dtype)
    for k in np.unique(power):
        at = power == k
        out[at] = np.minimum(steps[k][low[at]], steps[k][high[at] - (1 << k) + 1])
    return out


def _child_key(key: str, a: int, b: int) -> str:
    return hashlib.blake2b(f"{key},{a},{b}".encode(), digest_size=16).hexdigest()


NODE = (
    "shard long, side int, `key` string, parent_key string, is_start boolean, depth long, conv_id long, parent_conv_id long,"
    " n_convs long, n_children long, n_leaves long, saved_tokens long, chars long, ends string"
)
#: Sides: a node that is final, or one on the first or on the last path of a shard.
FINAL, FIRST, LAST = range(3)


class Paths:
    """Neighbouring distinct paths with the counts that belong to their ends."""

    def __init__(self, batch: pa.RecordBatch):
        flat = batch["path"].flatten()
        self.a, self.b, self.chars = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        self.size = batch["path"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.start = np.array(batch["start"].to_pylist(), object)
        self.ends = np.array(batch["ends"].to_pylist(), object)
        for name in ("n", "least", "start_least", "more_children", "more_leaves", "more_saved"):
            setattr(self, name, batch[name].to_numpy(zero_copy_only=False).astype(np.int64))


def shard_nodes(p: Paths, shard: int, base: int) -> pa.RecordBatch:
    """All nodes of a shard; ``base`` is the depth of the nodes that its paths start from."""
    rows = len(p.size)
    shared = _common(p.start, p.size, p.begin, p.a, p.b)
    added = p.size + 1 - shared
    closed = np.append(0, p.size[:-1] + 1) - shared
    counts = np.append(np.stack([closed, added], axis=1).ravel(), p.size[-1] + 1)
    trie = Parentheses(np.repeat(np.arange(len(counts)) % 2, counts))

    # Nodes in the order in which they open.
    n = len(trie.opens)
    row = np.repeat(np.arange(rows), added)
    tip = np.cumsum(added) - 1
    level = np.arange(n) - np.repeat(tip + 1 - added, added) + shared[row]
    turn = np.maximum(p.begin[row] + level - 1, 0)
    chars = np.where((level > 0), p.chars[np.minimum(turn, max(0, len(p.chars) - 1))] if len(p.chars) else 0, 0)
    by_level = np.argsort(level * n + np.arange(n))
    ordered = (level * n + np.arange(n))[by_level]
    parent = np.where(level > 0, by_level[np.searchsorted(ordered, (level - 1) * n + np.arange(n)) - 1], -1)

    close = trie.findclose(trie.opens)
    final = trie.rank[close] - 1  # last node of the subtree

    def subtree(per_node: np.ndarray) -> np.ndarray:
        total = np.cumsum(per_node)
        return total[final] - total + per_node

    def at_tips(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[tip] = values
        return out

    side = np.full(n, FINAL)
    last = [int(tip[-1])]
    while parent[last[-1]] >= 0:
        last.append(int(parent[last[-1]]))
    last.reverse()
    first = np.arange(tip[0] + 1)
    side[last] = LAST
    side[first] = FIRST
    whole = side == FINAL

    members = subtree(at_tips(p.n))
    least = _range_minimum(p.least, row, row[final])
    least = np.where(level == 0, np.minimum(least, p.start_least[row]), least)
    own_children = np.bincount(parent[(parent >= 0) & whole], minlength=n) + at_tips(p.more_children)
    # A pair () is a leaf, unless its conversations go on in a deeper segment.
    pair = (close == trie.opens + 1) & (at_tips(p.more_children) == 0)
    leaves = subtree(np.where(whole & pair, 1, 0) + at_tips(p.more_leaves))
    saved = subtree(np.where(whole, (members - 1) * chars, 0) + at_tips(p.more_saved))
    ends = np.full(n, None, object)
    ends[tip] = p.ends

    key = np.full(n, None, object)
    for chain in (first, last):
        for v in chain:
            up = parent[v]
            key[v] = p.start[row[v]] if up < 0 else _child_key(key[up], int(p.a[turn[v]]), int(p.b[turn[v]]))
    starts = level == 0
    key[starts] = p.start[row[starts]]
    above = np.where(parent >= 0, key[parent], None)  # known where the parent is on a spine
    above[(parent >= 0) & whole[parent]] = None
    known = np.where(parent >= 0, least[parent], -1)

    # Spine nodes that both the first and the last path pass are told again on the last one, empty.
    again = np.array([v for v in last if side[v] == FIRST], np.int64)
    at = np.concatenate([np.arange(n), again])
    empty = np.arange(len(at)) >= n

    def col(values: np.ndarray, kind: pa.DataType = pa.int64(), blank: bool = False, mask: np.ndarray | None = None) -> pa.Array:
        out = values[at]
        if blank:
            out = np.where(empty, 0, out)
        return pa.array(out, kind, mask=mask)

    parent_known = (parent >= 0) & np.append(whole, False)[parent]
    columns = [
        pa.array(np.full(len(at), shard)),
        pa.array(np.where(empty, LAST, side[at]).astype(np.int32)),
        col(key, pa.string()),
        col(above, pa.string()),
        pa.array(starts[at]),
        col(level + base),
        col(least),
        col(known, mask=~parent_known[at]),
        col(members, blank=True),
        col(own_children, blank=True),
        col(leaves, blank=True),
        col(saved, blank=True),
        col(chars.astype(np.int64)),
        pa.array(np.where(empty, None, ends[at]), pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0].strip("`") for x in NODE.split(", ")])


def _sharder(base: int) -> Callable:
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        nodes = 0
        for batch in batches:
            sizes = np.cumsum(batch["path"].value_lengths().to_numpy(zero_copy_only=False) + 1)
            a = 0
            while a < batch.num_rows:
                before = sizes[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(sizes, before + SHARD_NODES - nodes, "right")))
                held.append(batch.slice(a, b - a))
                nodes += int(sizes[b - 1] - before)
                a = b
                if nodes >= SHARD_NODES or a < batch.num_rows:
                    yield shard_nodes(_paths(held), shard, base)
                    held, nodes, shard = [], 0, shard + 1
        if held:
            yield shard_nodes(_paths(held), shard, base)

    return shards


def _paths(held: list[pa.RecordBatch]) -> Paths:
    return Paths(pa.concat_batches(held))


# --- spines


def merged(nodes: DataFrame) -> DataFrame:
    """Final rows of all nodes: those of the shards, and the spines put together."""
    spine = nodes.where(F.col("side") != FINAL)
    at = F.struct("shard", "side")
    one = spine.groupBy("key").agg(
        F.min(at).alias("owner"), F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"), F.bool_or("is_start").alias("is_start"),
        F.max("ends").alias("ends"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
    )
    inner = one.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("on_spine"))
    one = one.join(inner, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("on_spine", F.lit(0)))
    one = written(one, "spine-nodes")
    # What a merged node has itself goes up the chain of its owner.
    own = one.select(
        "key", "owner", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saving")
    )
    chain = spine.select("key", at.alias("at"), "depth").join(own, "key")
    mine = F.col("at") == F.col("owner")
    upward = Window.partitionBy("at").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    passed = chain.select(
        "key",
        F.sum(F.when(mine, F.col("leaf")).otherwise(0)).over(upward).alias("leaf"),
        F.sum(F.when(mine, F.col("saving")).otherwise(0)).over(upward).alias("saving"),
    )
    summed = passed.groupBy("key").agg(F.sum("leaf").alias("leaf"), F.sum("saving").alias("saving"))
    one = one.join(summed, "key").select(
        "key", "parent_key", "is_start", "depth", "conv_id", "n_convs", "n_children",
        (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"), (F.col("saved_tokens") + F.col("saving")).alias("saved_tokens"),
        "ends", F.lit(None).cast("long").alias("parent_conv_id"),
    )
    one = written(one, "spine-totals")
    both = nodes.where(F.col("side") == FINAL).select(*one.columns).unionByName(one)
    name = one.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("named"))
    return both.join(name, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("named", "parent_conv_id")).drop("named")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """All nodes of the trie of rebuilt conversations."""
    every = paths(turns)
    deepest = every.agg(F.max("segment")).first()[0]
    out, below = None, None
    for segment in range(deepest if deepest is not None else 0, -1, -1):
        here = every.where(F.col("segment") == segment)
        if below is None:
            zero = F.lit(0).cast("long")
            here = here.withColumns({"more_children": zero, "more_leaves": zero, "more_saved": zero})
        else:
            more = below.select(
                F.col("key").alias("end"), F.col("n_children").alias("more_children"),
                F.col("n_leaves").alias("more_leaves"), F.col("saved_tokens").alias("more_saved"),
            )
            here = here.join(more, "end", "left").fillna(0, ["more_children", "more_leaves", "more_saved"])
        here = here.withColumn("start_least", F.coalesce("start_least", "least"))
        here = here.select("start", "path", "n", "least", "start_least", F.col("digest").alias("ends"), "more_children", "more_leaves", "more_saved")
        near = here.repartitionByRange("start", "path").sortWithinPartitions("start", "path")
        nodes = written(merged(written(near.mapInArrow(_sharder(segment * SEGMENT), NODE), "shards")), "nodes")
        below = nodes.where("is_start")
        kept = nodes if segment == 0 else nodes.where(~F.col("is_start"))
        out = kept if out is None else out.unionByName(kept)
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


# DuckDB has no CRC-32; its table of 256 entries follows from the polynomial.
_CRC_TABLE = (
    "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:"
    " CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT)))"
)
ORACLE = f"""
WITH crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
  own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM conversations WHERE conv_id IS NOT NULL),
  ids AS (SELECT conv_id, conv_id - conv_id % {HUNDRED} AS host, xor(4294967295, list_reduce(
      list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), CAST(4294967295 AS BIGINT))) % {MOST_SHARED} AS h
      FROM (SELECT DISTINCT conv_id FROM own) CROSS JOIN crc),
  rows AS (SELECT i.conv_id, 0 AS part, o.k, role, text FROM ids i JOIN own o ON o.conv_id = i.host AND o.k <= i.h
    UNION ALL SELECT i.conv_id, 1, o.k, role, text FROM ids i JOIN own o USING (conv_id) WHERE o.k > i.h),
  convs AS (SELECT i.conv_id, coalesce(list(struct_pack(role := role, text := text) ORDER BY part, k) FILTER (WHERE k IS NOT NULL), []) AS s
    FROM ids i LEFT JOIN rows r USING (conv_id) GROUP BY i.conv_id),
  member AS (SELECT conv_id, s, s[1:d] AS p, d FROM convs, unnest(range(len(s) + 1)) AS u(d)),
  node AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n,
      coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(s) = d), '') AS ids FROM member GROUP BY p, d),
  child AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
  worth AS (SELECT node.p, d, CASE WHEN child.n IS NULL THEN 1 ELSE 0 END AS leaf,
      CASE WHEN d > 0 THEN (node.n - 1) * length(node.p[d].text) ELSE 0 END AS saved FROM node LEFT JOIN child USING (p)),
  subtree AS (SELECT w.p[1:k] AS p, sum(leaf) AS leaves, sum(saved) AS saved FROM worth w, unnest(range(d + 1)) AS u(k) GROUP BY ALL)
SELECT node.conv_id, CAST(d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, node.n AS n_convs, CAST(coalesce(child.n, 0) AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ids) AS ends_sha256
FROM node JOIN subtree USING (p) LEFT JOIN child USING (p)
  LEFT JOIN (SELECT p, conv_id FROM node) up ON node.d > 0 AND up.p = node.p[1:d - 1]
"""
