"""Prefix trie, structure repair and decontamination against brute force; hot and odd inputs."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from fleetpulse.llm import grammar, postings, trie
from fleetpulse.llm.common import table
from fleetpulse.llm.queries import ORACLES, QUERIES
from fleetpulse.llm.turns import joined_digests, with_position

TURNS = "conv_id long, turn long, role string, text string"
CLASHING = "position long, a long, b long, `key` string, n long, kind string, fault string, chars long, h int, host long, start string, `end` string"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def taken(df) -> list[tuple]:
    return [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]


def odd_turns(spark, seed: int = 4, ids=range(-30, 130), long: int = 150):
    """Nulls in every column, empty, blank and long texts, repeated rows, a hot conversation, clashing columns."""
    rnd = random.Random(seed)
    texts = ["Hi.", "x", "?", "", None, " \t\n", "ok!\n", "Ünï 🙂.", "same.", "no. \x0b", "y" * 30_000]
    rows = [
        (c, k, rnd.choice(["user", "assistant", "system", "tool", "", None]), rnd.choice(texts))
        for c in [None, *ids]
        for k in range(rnd.choice([1, 2, 5, 9]))
    ]
    rows += [(700, k, "user" if k % 2 else "assistant", f"turn {k}" + rnd.choice(".,")) for k in range(long)]
    rows += [(701, None, "user", "no number."), *[(702, 3, "user", "thrice")] * 3, (703, None, None, None)]
    extra = CLASHING.count(",") + 1
    return spark.createDataFrame([(*r, *[None] * extra) for r in rows], f"{TURNS}, {CLASHING}").repartition(5)


# --- prefix trie


def plain_trie(rows: list[tuple]) -> list[tuple]:
    convs: dict = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    for turns in convs.values():
        turns.sort()
    nodes: dict = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        first = convs.get(c - (abs(c) % 100 * (1 if c >= 0 else -1)), [])[:h]
        whole = [t[2:] for t in (*first, *turns[h:])]
        for d in range(len(whole) + 1):
            node = nodes.setdefault(tuple(whole[:d]), {"members": [], "ends": [], "children": 0, "leaves": 0, "saved": 0})
            node["members"].append(c)
        node["ends"].append(c)
    for path in sorted(nodes, key=len, reverse=True):
        node = nodes[path]
        node["leaves"] += not node["children"]
        if path:
            node["saved"] += (len(node["members"]) - 1) * len(path[-1][1])
            up = nodes[path[:-1]]
            up["children"] += 1
            up["leaves"] += node["leaves"]
            up["saved"] += node["saved"]
    return sorted(
        (
            (min(n["members"]), len(p), min(nodes[p[:-1]]["members"]) if p else None, len(n["members"]), n["children"])
            + (n["leaves"], n["saved"], sha(",".join(map(str, sorted(n["ends"])))))
            for p, n in nodes.items()
        ),
        key=repr,
    )


def by_repr(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)


def test_trie_of_odd_turns(spark):
    turns = odd_turns(spark)
    assert by_repr(trie.prefix_trie(turns)) == plain_trie(taken(turns))


@pytest.mark.parametrize("segment,nodes", [(1024, 7), (3, 5), (4, 50), (2, 3)])
def test_trie_merges_shards_and_segments(spark, monkeypatch, segment, nodes):
    monkeypatch.setattr(trie, "SEGMENT", segment)
    monkeypatch.setattr(trie, "SHARD_NODES", nodes)
    rnd = random.Random(segment * nodes)
    rows = [(c, t, rnd.choice("ua"), "x" * rnd.choice([1, 1, 2])) for c in range(-30, 150) for t in range(rnd.choice([1, 4, 8, 20]))]
    turns = spark.createDataFrame(rows, TURNS).repartition(3)
    assert by_repr(trie.prefix_trie(turns)) == plain_trie(rows)


def test_trie_of_one_conversation_many_times(spark):
    rows = [(c, t, "user", f"{t}") for c in range(400) for t in range(3)]
    assert by_repr(trie.prefix_trie(spark.createDataFrame(rows, TURNS))) == plain_trie(rows)
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0


def test_trie_ties_do_not_follow_row_order(spark):
    rows = [(5, k // 4, "user", f"text {k}") for k in range(40)]
    found = [by_repr(trie.prefix_trie(spark.createDataFrame(x, TURNS).repartition(n))) for x, n in ((rows, 1), (rows[::-1], 4))]
    assert found[0] == found[1] and len(found[0]) > 30


def test_findclose_equals_a_stack():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 50, 3000):
        bits, depth, left = [], 0, n
        while left or depth:
            up = left > 0 and (depth == 0 or rnd.random() < (0.9 if left > n // 2 else 0.3))
            bits.append(int(up))
            depth, left = depth + (1 if up else -1), left - up
        stack, want = [], {}
        for k, bit in enumerate(bits):
            if bit:
                stack.append(k)
            else:
                want[stack.pop()] = k
        found = trie.Parentheses(np.array(bits))
        assert found.findclose(found.opens).tolist() == [want[k] for k in found.opens]


# --- structure repair


NEXT, REACHED, NAME = {0: "u", 1: "u", 2: "a", 3: "u"}, {"s": 1, "u": 2, "a": 3}, {"u": "user", "a": "assistant"}


def plain_damage(rows: list[tuple]) -> dict:
    convs: dict = {}
    for c, t, r, x in rows:
        convs.setdefault(c, [])
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = (" " if v is None else v for v in (r, x))
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        convs[c] += [(t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return convs


def plain_repair(turns: list[tuple]) -> tuple:
    turns = sorted(turns, key=lambda v: (v[0] is not None, v[0] or 0, v[1]))
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    seen, faults = set(), []
    for _, r, x in turns:
        s = x.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not s else "d" if (r, x) in seen else "t" if s[-1] not in ".!?" else "")
        seen.add((r, x))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    # Cheapest, then least audit by uniform-cost search over (turns done, state).
    heap, done = [(0, "", 0, 0)], set()
    while True:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(turns) and state in (0, 3):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        heapq.heappush(heap, (cost + 2, audit + "I", i, REACHED[NEXT[state]]))
        if i < len(turns):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            initial = turns[i][1][:1]
            if faults[i] not in ("b", "d"):
                more = faults[i] == "t"
                if initial == NEXT[state] or (state == 0 and initial == "s"):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, REACHED[initial]))
                heapq.heappush(heap, (cost + more + 2, audit + "R", i + 1, REACHED[NEXT[state]]))
    lines, state, i = [], 0, 0
    for edit in audit:
        role, text = (NAME[NEXT[state]], "") if edit == "I" else turns[i][1:]
        if edit == "R":
            role = NAME[NEXT[state]]
        if edit != "D":
            lines.append(f"{role}:{text}")
            state = REACHED[role[:1]]
        i += edit != "I"
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, sha("\n".join(lines))


@pytest.mark.parametrize("seed,long", [(4, 150), (9, 700)])
def test_repair_of_odd_turns(spark, monkeypatch, seed, long):
    monkeypatch.setattr(grammar, "BLOCK", 64 if seed == 4 else 7)
    monkeypatch.setattr(grammar, "LEVEL", 64 if seed == 4 else 3)
    turns = odd_turns(spark, seed, long=long)
    rows = [r for r in taken(turns)]
    want = {c: plain_repair(v) for c, v in plain_damage(rows).items()}
    found = {r[0]: tuple(r)[1:] for r in grammar.repaired(turns).collect()}
    assert found == want


def test_repair_of_the_given_table(spark, sf_dir):
    turns = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "conversations")
    want = {c: plain_repair(v) for c, v in plain_damage(taken(turns)).items()}
    assert {r[0]: tuple(r)[1:] for r in grammar.repaired(turns).collect()} == want


def test_repair_without_turns(spark):
    assert grammar.repaired(spark.createDataFrame([], TURNS)).count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = spark.createDataFrame([(dropped, 0, "user", "Hi.")], TURNS)
    assert [tuple(r) for r in grammar.repaired(rows).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", sha(""))]


def test_blocks_join_to_the_alignment_of_the_whole():
    rnd = random.Random(2)
    for n in (1, 2, 5, 9, 24):
        for _ in range(20):
            signs = "".join(rnd.choice("suax") + rnd.choice("...-!") for _ in range(n))
            cut = 2 * rnd.randint(0, n)
            parts = [grammar.aligned(x) for x in (signs[:cut], signs[cut:]) if x]
            assert [list(r) for r in grammar._joined(parts)] == [list(r) for r in grammar.aligned(signs)]


# --- order and digests


def test_positions_of_a_hot_key(spark):
    rows = spark.range(0, 3000).selectExpr("IF(id % 3 = 0, id, NULL) AS conv_id", "id % 11 AS t", "id")
    found = with_position(rows, "conv_id", [rows.t, rows.id]).toPandas()
    hot = found[found.conv_id.isna()].sort_values(["t", "id"])
    assert hot.position.tolist() == list(range(1, 2001)) and (found[~found.conv_id.isna()].position == 1).all()


def test_joined_digests(spark):
    rows = spark.range(0, 30_000).selectExpr("CAST(id % 2 AS STRING) AS key", "id", "CAST(id AS STRING) AS piece")
    found = dict(joined_digests(rows, "key", ["id"], "piece", ",").collect())
    assert found == {k: sha(",".join(map(str, range(int(k), 30_000, 2)))) for k in "01"}


# --- decontamination


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_hits(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    def words(text):
        return WORD.findall((text or "").translate(LOWER))

    windows: dict = {}
    for item, text in items:
        w = words(text)
        size = min(10, len(w))
        for a in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[a : a + size]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, met, near = words(text), set(), set(), set()
        for size in {len(x) for x in windows}:
            for a in range(len(w) - size + 1):
                found = windows.get(tuple(w[a : a + size]), set())
                met |= found
                hit |= set(range(a, a + size)) if found else set()
        for a in range(len(w)):
            for window, names in windows.items():
                if set(window) <= set(w[a : a + len(window) + postings.SLACK]):
                    near |= names
        out.append((doc, len(w), len(hit), len(met), sha(",".join(sorted(met))), bool(hit), len(near)))
    return sorted(out, key=repr)


def leaky_documents(spark):
    rnd = random.Random(8)
    vocabulary = ["the", "of", "and", *[f"w{k}" for k in range(40)], "été", "日本"]
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 2, 9, 10, 25])))) for k in range(12)]
    items += [(3, items[5][1]), (None, "an item without id, of more than ten words, it is here"), (20, None), (21, "")]
    docs = [(None, None), (1, ""), (2, "..."), (3, "THE item WITHOUT Id"), (3, "THE item WITHOUT Id"), (None, items[13][1])]
    for k in range(60):
        own = " ".join(rnd.choice(vocabulary) for _ in range(30))
        said = rnd.choice(items)[1] or ""
        mixed = said.split()
        rnd.shuffle(mixed)
        docs.append((10 + k, rnd.choice([own, f"{own} {said}. {own}", said.upper(), own + " " + " ".join(mixed)])))
    # One passage in a third of all documents, and words that run into the next document.
    docs += [(100 + k, f"{items[13][1]} {k}") for k in range(40)]
    docs += [(200, "an item without id of more than"), (201, "ten words it is here")]
    extra = "chunk long, term string, n int, places binary, item_id string, n_words long"
    rows = [(*d, *[None] * 6) for d in docs]
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra}").repartition(4), items


@pytest.mark.parametrize("chunk,block", [(4 << 20, 4 << 20), (300, 900)])
def test_decontamination_of_odd_documents(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(postings, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(postings, "BLOCK_BYTES", block)
    monkeypatch.setattr(postings, "STARTS", 50)
    docs, items = leaky_documents(spark)
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = by_repr(postings.decontamination(docs, asked))
    assert found == plain_hits([(r.doc_id, r.text) for r in docs.collect()], items)
    assert sum(r[5] for r in found) > 60


def test_decontamination_of_nothing(spark):
    docs, items = leaky_documents(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    clean = postings.decontamination(docs, none).collect()
    assert len(clean) == docs.count() and not any(r.contaminated or r.n_items for r in clean)
    assert postings.decontamination(docs.limit(0), spark.createDataFrame(items, none.schema)).count() == 0


def test_very_long_document(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    text = "word " * 400_000 + passage + " word" * 400_000
    docs = spark.createDataFrame([(1, text), (2, "word " * 5)], "doc_id long, text string")
    rows = {r.doc_id: r for r in postings.decontamination(docs, spark.createDataFrame([(7, passage)], "item_id long, text string")).collect()}
    assert (rows[1].n_words, rows[1].n_hit, rows[1].n_items, rows[2].contaminated) == (800_030, 30, 1, False)


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_decontamination"])
def test_rows_equal_checking_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = QUERIES[name](spark, sf_dir)
    columns = ", ".join(found.columns)
    want = con.execute(f"SELECT {columns} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
