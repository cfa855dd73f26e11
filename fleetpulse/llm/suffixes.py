"""Removal of passages that repeat across documents, by families of sparse suffix arrays.

A byte is removed if it lies in a ``SPAN``-byte string that also starts in a
document with a smaller doc_id.  The work goes in three steps, each one shuffle.

1. Anchors.  In every ``SPAN``-byte string one position is its anchor: that of
   the ``GRAM`` bytes with the least hash.  Equal strings have equal anchors, so
   only the suffixes at anchors (one byte in 17) need an index.  They are dealt
   out by the hash of their first ``GRAM`` bytes.  Within such a part they come
   in batches by doc_id: every batch gets its sorted suffix array, is
   merge-scanned against the levels that stand, and joins them; levels of equal
   size merge, so n batches leave log n levels.  A suffix that meets an equal
   beginning of another document is a candidate.
2. Segments.  Candidates return to their texts, and the bytes around each, as
   far as the strings reach whose anchor it is, are cut out and dealt by the
   same hash.  Every string of a segment is compared with all others, byte by
   byte where hashes agree, and its least doc_id decides.
3. Removal.  The spans return to their texts.

Texts travel compressed.  A suffix that many documents of one task share is sent
on once, and equal segments of one task share their bytes, so copies and common
passages collapse before the shuffle.  No step drops, caps or samples.

Defined cases: a null text counts as empty, and a text shorter than ``SPAN``
loses nothing; a row without doc_id is neither searched nor a source; rows of
one doc_id do not remove each other's bytes; texts of any length go in chunks;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

SPAN = 50
GRAM = 16
#: Strings that start in one stretch of a text are looked at together.
CHUNK = 1 << 20
#: Places in rows of the same doc_id are this far apart; a Spark value is shorter.
ROW = 1 << 40
#: A part's strings are compared in so many turns.
TURNS = 8
#: Batches that a part of the suffixes is indexed in.
BATCHES = 8

REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

_REACH = SPAN - GRAM + 1  # grams in a span


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the ``GRAM`` bytes at every position that has them."""
    n = len(data) - GRAM + 1
    words = np.ndarray((n + GRAM - 8,), "<u8", data.tobytes(), strides=(1,))
    return _mixed(words[:n] * np.uint64(0x9E3779B97F4A7C15) ^ _mixed(words[GRAM - 8 :] + np.uint64(1)))


@dataclass
class Anchors:
    """Anchors of one chunk: gram hash, and the first and last start of the strings it stands for."""

    doc: np.ndarray
    key: np.ndarray
    first: np.ndarray
    last: np.ndarray


def anchors(texts: list[bytes]) -> tuple[np.ndarray, Anchors]:
    """The joined bytes of ``texts``, none longer than a chunk and a span, and their anchors; ``doc`` counts the texts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    none = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return data, Anchors(none, none.astype(np.uint64), none, none)
    n = len(data) - SPAN + 1  # strings
    # Hash above, position below: the least is the leftmost gram of the least hash.
    order = (gram_hashes(data) & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n + _REACH - 1, dtype=np.uint64)
    least, width = order, 1
    while 2 * width <= _REACH:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < _REACH:
        least = np.minimum(least[:n], least[_REACH - width : _REACH - width + n])
    at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    for end in ends[:-1].tolist():  # strings that reach into the next text
        at[max(0, end - SPAN + 1) : end] = -1
    change = np.flatnonzero(at[1:] != at[:-1]) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change, [n]]) - 1
    real = at[first] >= 0
    first, last = first[real], last[real]
    key = gram_hashes_at(data, at[first])
    return data, Anchors(np.searchsorted(ends, first, side="right"), key, first, last)


def gram_hashes_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    words = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))
    return _mixed(words[at] * np.uint64(0x9E3779B97F4A7C15) ^ _mixed(words[at + GRAM - 8] + np.uint64(1)))


def chunks(rows: Iterable[tuple[Any, bytes]]) -> Iterator[tuple[list[Any], list[int], list[bytes]]]:
    """Texts packed into chunks: ids, offsets and bytes.  Stretches of a long text overlap so that each string is in one."""
    ids, offsets, parts, size = [], [], [], 0
    for doc_id, text in rows:
        for k in range(0, max(1, len(text) - SPAN + 1), CHUNK):
            part = text[k : k + CHUNK + SPAN - 1]
            if size and size + len(part) > CHUNK:
                yield ids, offsets, parts
                ids, offsets, parts, size = [], [], [], 0
            ids.append(doc_id)
            offsets.append(k)
            parts.append(part)
            size += len(part)
    if parts:
        yield ids, offsets, parts


def _zip(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x if isinstance(x, bytes) else x.tobytes())


def _unzip(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def _packed_ids(ids: np.ndarray) -> bytes:
    """Ids, best in order, as compressed differences."""
    return _zip(np.diff(ids, prepend=np.int64(0)))


def _ids(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(_unzip(packed), np.int64))


def _groups(values: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(value, places) for each value, places in order."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order])) + 1
    return [(int(values[p[0]]), p) for p in np.split(order, cuts) if len(p)]


def _home(ids: np.ndarray, homes: int) -> np.ndarray:
    return (_mixed(ids.astype(np.uint64)) % np.uint64(homes)).astype(np.int64)


# --- 1. anchors -------------------------------------------------------------------------------------------------------

_SENT = "part long, doc_ids binary, keys binary, known boolean"


def _send(ids: np.ndarray, keys: np.ndarray, parts: int) -> Iterator[tuple]:
    """Anchors of one batch of documents by part: of each key one, and apart those that already met here."""
    order = np.lexsort((ids, keys))
    ids, keys = ids[order], keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    runs = np.diff(np.append(starts, len(keys)))
    met = np.repeat(ids[starts] != ids[starts + runs - 1], runs) if len(keys) else np.zeros(0, bool)
    for known, chosen in ((False, starts), (True, np.flatnonzero(met))):
        i, k = ids[chosen], keys[chosen]
        # What is known needs no meeting any more, so it is dealt by document and cannot heap up.
        part = _home(i, parts) if known else (k % np.uint64(parts)).astype(np.int64)
        by_id = np.lexsort((i, part))
        i, k, part = i[by_id], k[by_id], part[by_id]
        for p, at in _groups(part):
            yield p, _packed_ids(i[at]), k[at].tobytes(), known


def sent_anchors(docs: DataFrame, parts: int) -> DataFrame:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = (
                (i, t.encode())
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                if i is not None and t
            )
            ids, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for doc_ids, _, texts in chunks(rows):
                found = anchors(texts)[1]
                ids.append(np.array(doc_ids, np.int64)[found.doc])
                keys.append(found.key)
            out = list(_send(np.concatenate(ids), np.concatenate(keys), parts))
            if out:
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["part", "doc_ids", "keys", "known"]
                )

    return docs.select("doc_id", "text").mapInArrow(send, _SENT)


class Family:
    """Sorted suffix arrays of one part.  Levels hold 1, 2, 4, ... batches; inserting one marks what meets."""

    def __init__(self, size: int):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []  # batches, sorted keys, their entries
        self.met = np.zeros(size, bool)

    def insert(self, keys: np.ndarray, entries: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        keys, entries = keys[order], entries[order]
        same = np.flatnonzero(keys[1:] == keys[:-1])
        self.met[entries[same]] = self.met[entries[same + 1]] = True
        for _, old, old_entries in self.levels:
            # Merge-scan: where the array's runs of equal keys begin and end in the level, and the other way round.
            here = np.searchsorted(old, keys)
            self.met[entries[old[np.minimum(here, len(old) - 1)] == keys]] = True
            there = np.searchsorted(keys, old)
            self.met[old_entries[keys[np.minimum(there, len(keys) - 1)] == old]] = True
        level = (1, keys, entries)
        while self.levels and self.levels[-1][0] == level[0]:
            n, k, e = self.levels.pop()
            k, e = np.concatenate([k, level[1]]), np.concatenate([e, level[2]])
            order = np.argsort(k, kind="stable")  # two sorted runs: a merge
            level = (2 * n, k[order], e[order])
        self.levels.append(level)


def _candidates(homes: int, batches: int):
    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        ids, keys, known = [], [], []
        for doc_ids, packed, is_known in zip(*(rows.column(c).to_pylist() for c in ("doc_ids", "keys", "known"))):
            ids.append(_ids(doc_ids))
            keys.append(np.frombuffer(packed, np.uint64))
            known.append(np.full(len(ids[-1]), is_known))
        i, k, met = np.concatenate(ids), np.concatenate(keys), np.concatenate(known)
        fresh = np.flatnonzero(~met)
        order = fresh[np.argsort(i[fresh], kind="stable")]
        family = Family(len(i))
        for batch in np.array_split(order, batches):
            if len(batch):
                family.insert(k[batch], batch)
        hit = np.flatnonzero(met | family.met)
        i, k = i[hit], k[hit]
        by_id = np.lexsort((k, i))
        i, k = i[by_id], k[by_id]
        out = [(h, _packed_ids(i[at]), k[at].tobytes()) for h, at in _groups(_home(i, homes))]
        columns = zip(*out) if out else ([], [], [])
        kinds = (pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["home", "doc_ids", "keys"])

    return meet


def candidates(docs: DataFrame, parts: int, homes: int, batches: int = BATCHES) -> DataFrame:
    """Anchors that meet another document's: (home of the document, ids, keys)."""
    sent = sent_anchors(docs, parts)
    return sent.groupBy("part").applyInArrow(_candidates(homes, batches), "home long, doc_ids binary, keys binary")


# --- 2. segments ------------------------------------------------------------------------------------------------------


def housed(docs: DataFrame, homes: int) -> DataFrame:
    """Documents by home, their texts compressed; rows without id live at a home by their text."""

    def house(ids: pa.Array, texts: pa.Array) -> pa.Array:
        own = ids.fill_null(0).to_numpy(zero_copy_only=False)
        sizes = np.array([len(t or "") for t in texts.to_pylist()], np.int64)
        keys = np.where(ids.is_null().to_numpy(zero_copy_only=False), sizes, own)
        return pa.array(_home(keys, homes))

    def pack(texts: pa.Array) -> pa.Array:
        return pa.array([_zip((t or "").encode()) for t in texts.to_pylist()], pa.binary())

    text = F.col("text")
    return docs.select(
        F.arrow_udf(house, "long")(F.col("doc_id"), text).alias("home"),
        "doc_id",
        F.arrow_udf(pack, "binary")(text).alias("packed"),
    )


def _numbered(texts: pa.Table) -> Iterator[tuple[int | None, int, bytes]]:
    """(id, base of places, text) of each row.  Rows of one id have places of their own, the same
    ones in every step: row k of them, by text, counts from k * ``ROW``."""
    rows = list(zip(texts.column("doc_id").to_pylist(), texts.column("packed").to_pylist()))
    rows.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    before, number = None, 0
    for doc_id, packed in rows:
        number = number + 1 if doc_id is not None and doc_id == before else 0
        before = doc_id
        yield doc_id, number * ROW, _unzip(packed)


def _of_documents(rows: pa.Table, *names: str) -> dict[int, list[np.ndarray]]:
    """The arrays ``names`` behind ``doc_ids``, by document."""
    ids, columns = [np.zeros(0, np.int64)], [[] for _ in names]
    for packed, *values in zip(*(rows.column(c).to_pylist() for c in ("doc_ids", *names))):
        ids.append(_ids(packed))
        for c, v in zip(columns, values):
            c.append(np.frombuffer(v, np.uint64))
    i = np.concatenate(ids)
    joined = [np.concatenate(c) if c else np.zeros(0, np.uint64) for c in columns]
    return {doc: [c[at] for c in joined] for doc, at in _groups(i)}


_SEGMENTS = "part long, doc_ids binary, places binary, which binary, shapes binary, data binary"


def _segments(parts: int):
    """Cut the segments of one home's candidates: per part the occurrences (document, place, which
    segment) and each different segment once (its key, its length, its bytes)."""

    def cut(key: tuple, texts: pa.Table, found: pa.Table) -> pa.Table:
        wanted = _of_documents(found, "keys")
        rows = (((i, base), t) for i, base, t in _numbered(texts) if i in wanted)
        doc, place, which, segments, number = [], [], [], [], {}
        for ids, offsets, parts_of_texts in chunks(rows):
            data, a = anchors(parts_of_texts)
            raw = data.tobytes()
            starts = np.cumsum([0] + [len(t) for t in parts_of_texts])
            bounds = np.searchsorted(a.doc, np.arange(len(ids) + 1))
            for d, (doc_id, base) in enumerate(ids):
                own = np.arange(bounds[d], bounds[d + 1])
                own = own[np.isin(a.key[own], wanted[doc_id][0])]
                for f, e, k in zip(a.first[own].tolist(), a.last[own].tolist(), a.key[own].tolist()):
                    segment = (k, raw[f : e + SPAN])
                    doc.append(doc_id)
                    place.append(base + offsets[d] + f - int(starts[d]))
                    which.append(number.setdefault(segment, len(number)))
        segments = list(number)
        doc, place, which = (np.array(x, np.int64) for x in (doc, place, which))
        part_of = np.array([k % parts for k, _ in segments], np.int64)
        out = []
        if len(doc):
            order = np.lexsort((place, doc, part_of[which]))
            doc, place, which = doc[order], place[order], which[order]
            for p, at in _groups(part_of[which]):
                used, local = np.unique(which[at], return_inverse=True)
                shapes = np.array([[segments[u][0], len(segments[u][1])] for u in used.tolist()], np.uint64)
                data = b"".join([segments[u][1] for u in used.tolist()])
                packed = (_packed_ids(doc[at]), _zip(place[at]), _zip(local.astype(np.int64)), _zip(shapes), _zip(data))
                out.append((p, *packed))
        columns = zip(*out) if out else ([] for _ in range(6))
        kinds = (pa.int64(), *[pa.binary()] * 5)
        names = [x.split()[0] for x in _SEGMENTS.split(",")]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return cut


def _string_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hash of the ``SPAN`` bytes at each of ``starts``."""
    words = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))
    h = np.zeros(len(starts), np.uint64)
    for k in (*range(0, SPAN - 7, 8), SPAN - 8):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[starts + k])
    return h


def _equal_strings(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number for each of ``starts``, equal exactly where the ``SPAN`` bytes there are."""
    group = np.unique(_string_hashes(data, starts), return_inverse=True)[1]
    order = np.argsort(group, kind="stable")
    head = np.zeros(len(starts), np.int64)
    first = np.concatenate([[True], np.diff(group[order]) != 0])
    head[order] = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    offsets = np.arange(SPAN)
    step = 1 << 16
    for k in range(0, len(starts), step):
        at = np.flatnonzero(head[k : k + step] != np.arange(k, min(k + step, len(starts)))) + k
        if (data[starts[at, None] + offsets] != data[starts[head[at], None] + offsets]).any():
            # Different strings of one hash: number the strings themselves.
            raw = data.tobytes()
            numbers: dict[bytes, int] = {}
            return np.array([numbers.setdefault(raw[s : s + SPAN], len(numbers)) for s in starts.tolist()], np.int64)
    return group


def _spans(homes: int):
    """Compare all strings of one part's segments; spans of them that a smaller document has, by home."""

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        doc, place, which, segments = [], [], [], {}
        names = ("doc_ids", "places", "which", "shapes", "data")
        for ids, places, local, shapes, data in zip(*(rows.column(c).to_pylist() for c in names)):
            doc.append(_ids(ids))
            place.append(np.frombuffer(_unzip(places), np.int64))
            raw, numbers, at = _unzip(data), [], 0
            for k, n in np.frombuffer(_unzip(shapes), np.uint64).reshape(-1, 2).tolist():
                numbers.append(segments.setdefault((k, raw[at : at + n]), len(segments)))
                at += n
            which.append(np.array(numbers, np.int64)[np.frombuffer(_unzip(local), np.int64)])
        doc, place, which = np.concatenate(doc), np.concatenate(place), np.concatenate(which)
        # Strings meet only under one key, so the keys are taken in turns and memory stays small.
        turn = np.array([k >> 40 for k, _ in segments], np.int64) % TURNS
        texts = [t for _, t in segments]
        found = []
        for t in range(TURNS):
            own = np.flatnonzero(turn == t)
            if len(own):
                number = np.zeros(len(turn), np.int64)
                number[own] = np.arange(len(own))
                at = np.flatnonzero(turn[which] == t)
                found.append(_smaller_spans(doc[at], place[at], number[which[at]], [texts[k] for k in own.tolist()]))
        i, s, e = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((s, i))
        i, s, e = i[order], s[order], e[order]
        out = [(h, _packed_ids(i[at]), s[at].tobytes(), e[at].tobytes()) for h, at in _groups(_home(i, homes))]
        columns = zip(*out) if out else ([] for _ in range(4))
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["home", "doc_ids", "starts", "ends"])

    return compare


def _smaller_spans(
    doc: np.ndarray, place: np.ndarray, which: np.ndarray, segments: list[bytes]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of the spans that a smaller document has, among occurrences of ``segments``."""
    size = np.array([len(s) for s in segments], np.int64)
    data = np.frombuffer(b"".join(segments), np.uint8)
    begin = np.cumsum(size) - size
    # Least document of each different segment, then of each different string.
    least = np.full(len(size), np.iinfo(np.int64).max)
    np.minimum.at(least, which, doc)
    strings = size - SPAN + 1
    owner = np.repeat(np.arange(len(size)), strings)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
    group = _equal_strings(data, begin[owner] + inside)
    first_doc = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first_doc, group, least[owner])
    # A document that is not the least of its segment loses all of it.
    later = doc > least[which]
    i, s, e = [doc[later]], [place[later]], [place[later] + size[which[later]]]
    # The least one loses the strings that another segment gives to a smaller document.
    gone = first_doc[group] < least[owner]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)) != 0)
    cuts = np.flatnonzero(inside == 0)  # a run ends with its segment
    runs: dict[int, list[tuple[int, int]]] = {}
    for a, b in edge.reshape(-1, 2).tolist():
        inner = cuts[np.searchsorted(cuts, a, side="right") : np.searchsorted(cuts, b)].tolist()
        for x, y in zip([a, *inner], [*inner, b]):
            runs.setdefault(int(owner[x]), []).append((int(inside[x]), int(inside[y - 1]) + SPAN))
    if runs:
        has = np.isin(which, np.fromiter(runs, np.int64)) & ~later
        found = [
            (d, p + x, p + y)
            for d, p, w in zip(doc[has].tolist(), place[has].tolist(), which[has].tolist())
            for x, y in runs[w]
        ]
        if found:
            more = np.array(found, np.int64)
            i, s, e = [*i, more[:, 0]], [*s, more[:, 1]], [*e, more[:, 2]]
    return np.concatenate(i), np.concatenate(s), np.concatenate(e)


# --- 3. removal -------------------------------------------------------------------------------------------------------


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return list(zip(s[new].tolist(), e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)].tolist()))


def kept_bytes(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in runs:
        out.append(text[at:s])
        at = e
    return b"".join([*out, text[at:]])


def _remove(key: tuple, texts: pa.Table, spans: pa.Table) -> pa.Table:
    found = _of_documents(spans, "starts", "ends")
    out = []
    for doc_id, base, text in _numbered(texts):
        runs = []
        if doc_id in found:
            s, e = (x.astype(np.int64) - base for x in found[doc_id])
            own = (s >= 0) & (s < ROW)
            runs = merged(s[own], e[own]) if own.any() else []
        kept = kept_bytes(text, runs)
        out.append((doc_id, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    columns = zip(*out) if out else ([] for _ in range(5))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    names = [x.split()[0] for x in REMOVED.split(",")]
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def repeated_spans(docs: DataFrame, parts: int, homes: int, batches: int = BATCHES) -> DataFrame:
    """Spans of bytes that a document with a smaller id has too: (home, ids, starts, ends), packed by home."""
    found = candidates(docs, parts, homes, batches)
    texts = housed(docs.where("doc_id IS NOT NULL"), homes)
    cut = texts.groupBy("home").cogroup(found.groupBy("home")).applyInArrow(_segments(parts), _SEGMENTS)
    return cut.groupBy("part").applyInArrow(_spans(homes), "home long, doc_ids binary, starts binary, ends binary")


def remove_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``REMOVED`` for every row of ``docs``.

    A part or a home is the load of one task: their number is that of
    ``spark.sql.shuffle.partitions``, which is to grow with the input.  What goes
    from a part to a home is one packed row, so the rows between two steps are as
    many as the blocks of the shuffle, and never more than the suffixes in them.
    """
    groups = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = written(repeated_spans(docs, groups, groups, batches), "suffix-spans")
    texts = housed(docs, groups)
    return texts.groupBy("home").cogroup(spans.groupBy("home")).applyInArrow(_remove, REMOVED)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
