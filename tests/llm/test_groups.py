"""Operators that compare documents: SimHash, mixing, fingerprints, chats, toxicity, suffixes, pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from conftest_llm import by_rows, messy_rows
from pyspark.sql import functions as F

import corpus_pipeline
from fleetpulse.llm import bpe, chat, fingerprint, mixing, quality, secrets, simhash, suffixes, toxicity
from fleetpulse.llm.common import table
from fleetpulse.llm.components import components


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def rows_of(df) -> list[tuple]:
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def roots(nodes, pairs) -> dict:
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


# --- SimHash


def plain_fingerprint(text: str) -> int:
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in words.translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(docs):
    prints = [(d, plain_fingerprint(t)) for d, t in docs]
    values = sorted({p for _, p in prints})
    pairs = [(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if (a ^ b).bit_count() <= 2]
    root = roots(values, pairs)
    least = defaultdict(list)
    for d, p in prints:
        if d is not None:
            least[root[p]].append(d)
    return [(d, f"{p:016x}", min(least[root[p]], default=None)) for d, p in prints]


@pytest.mark.parametrize("which", ["documents", "messy"])
def test_simhash_equals_brute_force(spark, sf_dir, messy, which):
    docs = table(spark, sf_dir, "documents") if which == "documents" else messy
    assert by_rows(simhash.near_duplicates(docs)) == sorted(plain_components(rows_of(docs)), key=repr)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def test_links_of_large_families_connect_the_same(spark):
    """Families far above the list limit, chains of two-bit steps, single pairs and strangers."""
    rnd = random.Random(3)
    values = set()
    for _ in range(3):
        centre = rnd.getrandbits(64)
        for _ in range(150):
            values.add(centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3))))
    for _ in range(40):
        x = rnd.getrandbits(64)
        values.add(x)
        for _ in range(3):
            x ^= 1 << rnd.randrange(64) | 1 << rnd.randrange(64)
            values.add(x)
    values |= {0, 1, 1 << 63, (1 << 64) - 1}
    nodes = spark.createDataFrame([(signed(v),) for v in values], "bits long")
    found = simhash.links(nodes).collect()
    assert all(((r.u ^ r.v) & (1 << 64) - 1).bit_count() <= 2 for r in found)
    v = sorted(values)
    want = roots(v, [(a, b) for k, a in enumerate(v) for b in v[k + 1 :] if (a ^ b).bit_count() <= 2])
    back = {signed(x): x for x in values}
    got = roots(v, [(back[r.u], back[r.v]) for r in found])
    classes = lambda root: sorted(sorted(k for k in root if root[k] == r) for r in set(root.values()))
    assert classes(got) == classes(want)


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(4)
    pairs = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1400)] + [(5000, 5000)]
    pairs += [(rnd.randrange(2000, 2400), rnd.randrange(2000, 2400)) for _ in range(250)]
    rnd.shuffle(pairs)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = roots({x for p in pairs for x in p}, pairs)
    assert got == {k: v for k, v in want.items() if k != 5000 and k in got} and len(got) >= len(want) - 1 - sum(
        a == b for a, b in pairs
    )
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_stage_and_empty(messy, no_documents):
    assert simhash.near_duplicates(no_documents).count() == 0
    kept = simhash.one_of_each(messy)
    assert kept.columns == messy.columns
    every = {c for _, _, c in plain_components(rows_of(messy))}
    ids = [r.doc_id for r in kept.collect()]
    values = sorted({plain_fingerprint(t) for _, t in rows_of(messy)})
    pairs = [(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if (a ^ b).bit_count() <= 2]
    assert set(ids) - {None} == every - {None} and len(ids) == len(set(roots(values, pairs).values()))


def test_one_row_of_each_group_stays(spark):
    """Rows without id, of one id, or equal in all columns are told apart."""
    rnd = random.Random(3)
    text = " ".join(rnd.choice(["ka", "lo", "mi", "ren", "sut"]) + str(k) for k in range(80))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    no_ids = [(None, text, "en", "s1", 1)] * 5 + [(None, "quite another text of seven words here", "en", "s1", 1)]
    one_id = [(7, text, "en", "s1", 1)] * 5
    assert simhash.one_of_each(spark.createDataFrame(no_ids, schema).repartition(3)).count() == 2
    assert [tuple(r) for r in simhash.one_of_each(spark.createDataFrame(one_id, schema).repartition(3)).collect()] == one_id[:1]


def test_a_mix_holds_its_budget_without_ids(spark):
    """Half of the rows have no id; none of them comes or goes with another one."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = " ".join(["word"] * 20)
    unnamed = [(None, words + f" {k}", "en", "s1", 1) for k in range(50)]
    for rows in (
        [(k, words + " x", "en", "s1", 1) for k in range(50)] + unnamed,
        [(3, words + " x", "en", "s1", 1)] * 50 + unnamed,
        [(None, words + " x", "en", "s1", 1)] * 100,
    ):
        taken = mixing.mix_documents(spark.createDataFrame(rows, schema).repartition(4), 50)
        assert taken.columns == schema.replace(" long", "").replace(" string", "").split(", ")
        assert 49 <= taken.count() <= 50


# --- Mixing


def test_mixing_equals_sql_on_messy_rows(messy):
    con = duckdb.connect()
    documents = messy.select("doc_id", "text", "lang", "source").toPandas()  # noqa: F841
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con.register("documents", documents)
    # Ids must be set here: the SQL leaves out the ones that are not.
    got = by_rows(mixing.mixed(messy).where("doc_id IS NOT NULL"))
    names = [d[0] for d in con.execute(mixing.ORACLE).description]
    at = [names.index(c) for c in ("doc_id", "domain", "language", "source_name", "tokens", "leaf_budget", "copies")]
    want = [tuple(r[i] for i in at) for r in con.fetchall()]
    want = [r for r in want if r[0] is not None]
    assert [r[:6] for r in got] == sorted([r[:6] for r in want], key=repr)
    # Rows of one id and size may swap places; the number of copies of each must agree.
    assert Counter(got) == Counter(want)


def fill(budget, children):
    """Water level by bisection over fractions: (name, weight, capacity) to shares."""
    lo, hi = 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(c, mid * w) for _, w, c in children) <= budget else (lo, mid)
    return {n: min(c, lo * w) for n, w, c in children}


def test_shortage_goes_to_siblings_before_ancestors(spark):
    # domain0: en has src0 (10 words) and src3 (1000); domain1: en has src1 (5000).
    rows = [(k, "w " * 10, "en", "src0", 0) for k in range(1)]
    rows += [(100 + k, "w " * 10, "en", "src3", 0) for k in range(100)]
    rows += [(1000 + k, "w " * 10, "en", "src1", 0) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mixed(docs, budget_percent=20, max_epochs=1).groupBy("source_name").agg(
        F.max("leaf_budget").alias("budget"), F.sum(F.col("copies") * F.col("tokens")).alias("taken")
    )
    got = {r.source_name: (r.budget, r.taken) for r in got.collect()}
    # 1202 tokens, two thirds to domain0; src0 can give 10, its sibling the rest.
    assert got["src0"][0] == 10 and got["src3"][0] + 10 + got["src1"][0] == 6010 * 20 // 100
    assert got["src3"][0] + 10 in (801, 802)
    assert all(b - 10 < t <= b for b, t in got.values())


def test_mixing_random_trees_match_bisection(spark):
    rnd = random.Random(8)
    for _ in range(3):
        rows, n = [], 0
        for s in range(7):
            for lang in ("en", "de", "zz"):
                for _ in range(rnd.choice([0, 1, 5, 30])):
                    rows.append((n, "w " * rnd.randint(0, 40), lang, f"src{s}", 0))
                    n += 1
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        size = Counter()
        for _, text, lang, source, _ in rows:
            size[f"domain{int(source[3:]) % 3}", lang, source] += len(text.split())
        weight = {**mixing.DOMAIN_WEIGHTS, **mixing.LANGUAGE_WEIGHTS}
        level = lambda depth, under: sorted({k[depth] for k in size if k[:depth] == under})
        cap = lambda path: 2 * sum(v for k, v in size.items() if k[: len(path)] == path)
        budgets = {(): min(sum(size.values()) * 70 // 100, cap(()))}
        for depth in range(3):
            for under in [p for p in budgets if len(p) == depth]:
                kids = [(k, weight.get(k, 1), cap((*under, k))) for k in level(depth, under)]
                budgets |= {(*under, k): b for k, b in fill(budgets[under], kids).items()}
        got = {(r.domain, r.language, r.source_name): r.leaf_budget for r in mixing.mixed(docs, max_epochs=2).collect()}
        assert all(abs(b - budgets[k]) <= 3 for k, b in got.items())
        assert sum(got.values()) == budgets[()] - sum(b for p, b in budgets.items() if len(p) == 3 and p not in got)


def test_mixing_is_native_and_takes_empty_tables(messy, no_documents):
    assert mixing.mixed(no_documents).count() == 0
    plan = mixing.mixed(messy)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Python", "Arrow", "Cartesian", "NestedLoop") if x in plan]
    # Only the two leaves without tokens, of a row each, give none.
    assert mixing.mix_documents(messy, 100).count() == len(messy_rows()) - 2
    assert mixing.mix_documents(messy, 50).columns == messy.columns


# --- Fingerprints


@pytest.mark.parametrize("which", ["documents", "messy", "one"])
def test_fingerprints_equal_brute_force(spark, sf_dir, messy, which):
    docs = {"documents": table(spark, sf_dir, "documents"), "messy": messy, "one": messy.where("doc_id = 7")}[which]
    rows = rows_of(docs)
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    want = []
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        n = len(text)
        edited = text[: n - n // 2] + following[: n // 2]
        own, other, nxt = map(fingerprint.multiset, (text, edited, following))
        want.append((i, n, sha(edited.encode()), own.hex(), other.hex(), own.likeness(other), own.likeness(nxt)))
    assert by_rows(fingerprint.document_fingerprints(docs)) == sorted(want, key=repr)


def test_multiset_is_homomorphic():
    a, b, c = "one line", "another " * 100, "three"
    m = fingerprint.multiset
    assert m("\n".join([a, b, c])).hex() == m("\n".join([c, a, b])).hex() == (m(a) + m(b) + m(c)).hex()
    assert (m("\n".join([a, b])) - m(b)).hex() == m(a).hex()
    assert m(f"{a}\n{a}").hex() != m(a).hex() != m("").hex() != m("\n").hex()


def test_likeness_estimates_the_share_in_common():
    lines = [f"line {k}" for k in range(400)]
    for same in (0, 100, 300, 400):
        other = lines[:same] + [f"other {k}" for k in range(400 - same)]
        got = fingerprint.multiset("\n".join(lines)).likeness(fingerprint.multiset("\n".join(other)))
        assert abs(got - same / 400) < 0.35 * (1 - same / 400) + 1e-9


def test_fingerprints_read_texts_once(spark):
    """Buckets come from ids; only the texts of rows without an id are read before the shuffle, which keeps its width."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        read.add(1)
        return f"text {i}"

    docs = spark.range(400).select(F.when(F.col("id") >= 10, F.col("id")).alias("doc_id"), text("id").alias("text"))
    found = fingerprint.document_fingerprints(docs)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    read.value = 0
    assert fingerprint.document_fingerprints(docs).count() == 400
    assert read.value == 410


def test_fingerprints_empty_table(no_documents):
    assert fingerprint.document_fingerprints(no_documents).count() == 0


# --- Chats

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def plain_maximal(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        shown = f"<|im_start|>{role or 'unknown'}\n{text or ''}<|im_end|>\n"
        turns[conv].append(shown)
    inner = {tuple(t[:k]) for t in turns.values() for k in range(1, len(t))}
    first = {}
    for conv in sorted(turns, key=lambda c: (c is None, c or 0)):
        first.setdefault(tuple(turns[conv]), conv)
    kept = {c for t, c in first.items() if t not in inner}
    return sorted([(c, k + 1, len(t), x) for c, t in turns.items() if c in kept for k, x in enumerate(t)], key=repr)


def test_chat_collapses_snapshots(spark):
    rnd = random.Random(2)
    rows = []
    for c in range(0, 300, 10):
        full = [(f"r{k % 2}", rnd.choice(["hi", "ok", "no", ""]) + str(rnd.randint(0, 3))) for k in range(rnd.randint(1, 6))]
        for snap in range(rnd.randint(1, 5)):
            rows += [(c + snap, k, *t) for k, t in enumerate(full[: rnd.randint(1, len(full))])]
    rows += [(1000, k, "user", f"turn {k}") for k in range(900)]  # several blocks
    rows += [(1001, k, "user", f"turn {k}") for k in range(700)]
    rows += [(1002, k + 5, "user", f"turn {k}") for k in range(900)]  # equal, other numbers
    rows += [(1003, 0, None, None), (1003, 1, "user", None), (1004, 0, None, None), (None, 0, "user", "x"), (None, 1, "user", "y")]
    rows += [(1005, None, "user", "x"), (1005, 3, "user", "z")]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], CONVERSATIONS + ", rendered string, position int")
    assert by_rows(chat.maximal_conversations(df)) == plain_maximal(rows)


def test_chat_edge_cases(spark):
    repeated = [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a")]
    df = spark.createDataFrame(repeated, CONVERSATIONS)
    assert by_rows(chat.maximal_conversations(df)) == plain_maximal(repeated)
    assert chat.maximal_conversations(df.limit(0)).count() == 0
    plan = chat.maximal_conversations(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chat_of_a_hot_conversation_without_numbers(spark):
    """Most turns are of one conversation and have no number, or all the same one; each stays, in one order."""
    rows = [(1, None, "user", f"turn {k}") for k in range(3000)] + [(2, 7, "user", f"turn {k}") for k in range(900)]
    rows += [(3, 0, "user", "same")] * 700 + [(4, 0, "user", "same")] * 699 + [(5, 0, "user", "x")]
    found = [by_rows(chat.maximal_conversations(spark.createDataFrame(x, CONVERSATIONS).repartition(n))) for x, n in ((rows, 3), (rows[::-1], 5))]
    assert found[0] == found[1]
    turns = defaultdict(list)
    for conv, position, n, text in sorted(found[0], key=lambda r: (r[0], r[1])):
        turns[conv].append(text)
        assert position == len(turns[conv]) and n == {1: 3000, 2: 900, 3: 700, 5: 1}[conv]
    assert {c: len(t) for c, t in turns.items()} == {1: 3000, 2: 900, 3: 700, 5: 1} and len(set(turns[1])) == 3000


def test_chat_sql_on_planted_snapshots(spark):
    rows = [(1, 0, "u", "a"), (2, 0, "u", "a"), (2, 1, "s", "b"), (3, 0, "u", "c"), (4, 0, "u", "c"), (5, 0, "u", "a"), (5, 1, "s", "d")]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = by_rows(chat.maximal_conversations(spark.createDataFrame(rows, CONVERSATIONS)))
    assert got == sorted(con.execute(f"SELECT conv_id, position, n_turns, rendered FROM ({chat.ORACLE})").fetchall(), key=repr)
    assert {r[0] for r in got} == {2, 3, 5}


# --- Toxicity


def test_nearest_examples_are_exact(spark, sf_dir):
    docs, labels = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents"), table(spark, sf_dir.replace("sf0.001", "sf0.01"), "labels")
    index = toxicity.fit(docs, labels)
    dense = np.zeros((len(index.labels), len(index.idf)))
    for t in range(len(index.idf)):
        s, e = index.starts[t, 0], index.starts[t, -1]
        dense[index.posted[s:e], t] = index.weights[s:e]
    asked = 0
    for _, text in rows_of(docs):
        terms, weights = index.vector(text)
        if len(terms):
            cosine = dense[:, terms] @ weights
            got = index.nearest(terms, weights)
            want = np.sort(cosine[cosine > 0])[::-1][: toxicity.NEIGHBOURS]
            assert np.allclose([s for s, _ in got], want) and all(math.isclose(cosine[i], s) for s, i in got)
            asked += 1
    assert asked > 100


def test_vectors_in_plain_python(spark, sf_dir, monkeypatch):
    """Terms and weights of every text, and that a text's words are searched once, not token by token."""
    small = sf_dir.replace("sf0.001", "sf0.01")
    docs = table(spark, small, "documents")
    index = toxicity.fit(docs, table(spark, small, "labels"))
    words, searched = toxicity._WORDS, []

    class Counted:
        def findall(self, text):
            searched.append(text)
            return words.findall(text)

    monkeypatch.setattr(toxicity, "_WORDS", Counted())
    texts = [t for _, t in rows_of(docs)]
    texts += ["", "12 _ 34", "half½word a1b2 ﬁne ünï", " ".join(f"{w}, {w}! {w}" for w in texts[0].split()), texts[1].upper() * 3]
    for text in texts:
        counts = Counter(words.findall(text.lower()))
        want = Counter()
        for w, n in counts.items():
            for term in (w, *("^" + w[:k] for k in toxicity.PREFIXES if len(w) > k)):
                if term in index.vocabulary:
                    want[index.vocabulary[term]] += n
        if want and min(want) < index.telling:
            others = sum(n for t, n in want.items() if t >= index.telling)
            want[len(index.vocabulary)] = max(1, others + sum(n for w, n in counts.items() if w not in index.vocabulary))
        weights = [(1 + math.log(want[t])) * index.idf[t] for t in sorted(want)]
        new = [(1 + math.log(n)) * index.unseen for w, n in counts.items() if w not in index.vocabulary]
        size = math.sqrt(sum(x * x for x in [*weights, *new]))
        terms, got = index.vector(text)
        assert terms.tolist() == sorted(want)
        assert np.allclose(got, [x / size for x in weights], rtol=1e-12, atol=0)
    assert index.telling and len(searched) == len(texts)


def test_held_out_accuracy(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    labels = table(spark, big, "labels")
    scored = toxicity.toxicity(table(spark, big, "documents"), labels)
    rows = scored.where("held_out").join(labels.where("toxic IS NOT NULL"), "doc_id").select("doc_id", "score", "predicted", "toxic").collect()
    assert len(rows) > 500 and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.98
    # At 3,000 examples folds 0, 1 and 2 as the held-out one gave 0.948, 0.938 and 0.938 here.
    assert np.mean([r.predicted for r in rows if r.toxic]) > 0.92
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([(r.score - r.toxic) ** 2 for r in rows]) < 0.02


def test_votes_follow_from_the_neighbours(spark, sf_dir):
    """The score in plain Python, and equal texts with other ids score alike."""
    small = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    index = toxicity.fit(docs, labels)
    moved = toxicity.fit(docs.selectExpr("1000000 - doc_id AS doc_id", "text"), labels.selectExpr("1000000 - doc_id AS doc_id", "toxic"))
    assert index.share == pytest.approx(sum(index.labels) / len(index.labels), abs=0.02) and len(moved.labels) > 100
    for _, text in rows_of(docs)[:200]:
        terms, weights = index.vector(text)
        best = index.nearest(terms, weights)
        votes = [(1 / (toxicity.NEAR + 1 - s), index.labels[i]) for s, i in best]
        mass = sum(v for v, _ in votes) + toxicity.PRIOR_WEIGHT
        want = min(1.0, (sum(v * y for v, y in votes) + toxicity.PRIOR_WEIGHT * index.share) / mass)
        got = index.score(text)
        assert got[0] == pytest.approx(want) and got[1] == (want >= 0.5)


def test_ties_do_not_follow_doc_ids(spark):
    """Examples of one text and both labels: whichever ids they have, the same votes win."""
    usable = [i for i in range(5000) if zlib.crc32(str(i).encode()) % 5][:1200]
    texts = ["bad zork words here"] * 60 + [f"plain text number w{k}" for k in range(60)]
    toxic = [k % 2 for k in range(60)] + [0] * 60

    def score(ids):
        docs = spark.createDataFrame([*zip(ids, texts), (None, "bad zork words here")], "doc_id long, text string")
        scored = toxicity.toxicity(docs, spark.createDataFrame([*zip(ids, toxic)], "doc_id long, toxic int"))
        return [r.score for r in scored.collect() if r.doc_id is None]

    assert score(usable[:120]) == score(usable[:120][::-1]) == score(usable[300:420])


def test_copy_of_an_example_with_rare_words(spark):
    """Its only telling word stands in no other example; copies of it must still meet it."""
    rnd = random.Random(4)
    plain = [(i, " ".join(rnd.choices(["ka", "lo", "mi", "ren", "sut", "vel", "dor"], k=30))) for i in range(1, 300)]
    rare = "zorgel quimp ka lo fraxen dulb mi vostrick"
    usable = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([*plain, (usable[0], rare), (usable[1], rare), (None, rare)], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, int(i % 50 == 0)) for i, _ in plain), (usable[0], 1)], "doc_id long, toxic int")
    scored = [r for r in toxicity.toxicity(docs, labels).collect() if r.doc_id is None or r.doc_id >= 1000]
    assert len(scored) == 3
    for r in scored:
        assert r.evidence.startswith(f"{usable[0]}:1:1.000") and r.predicted == 1, r


def test_toxicity_edge_cases(messy, no_documents, labels, no_labels):
    rows = toxicity.toxicity(messy, labels).collect()
    assert len(rows) == len(messy_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert all(not r.held_out for r in rows if r.doc_id is None)
    assert {r.score for r in toxicity.toxicity(messy, no_labels).collect()} == {0.0}
    assert toxicity.toxicity(no_documents, no_labels).count() == 0


# --- Suffixes


def plain_removal(rows):
    docs = sorted(((i, t.encode()) for i, t in rows if i is not None), key=lambda r: r[0])
    first, out = {}, []
    for i, b in docs:
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, b in [*docs, *((None, t.encode()) for i, t in rows if i is None)]:
        gone = bytearray(len(b) + 1)
        for k in range(len(b) - 49 if i is not None else 0):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        out.append((i, len(b), len(b) - len(kept), spans, sha(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("which", ["documents", "messy"])
def test_removal_equals_brute_force(spark, sf_dir, messy, which):
    docs = table(spark, sf_dir, "documents") if which == "documents" else messy
    assert by_rows(suffixes.remove_repeats(docs)) == plain_removal(rows_of(docs))


def test_removal_of_planted_passages(spark, monkeypatch):
    """Few letters, periods, nested and shifted copies, in small chunks."""
    rnd = random.Random(6)
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    rows, pool = [], ["".join(rnd.choice("ab") for _ in range(rnd.randint(45, 90))) for _ in range(12)] + ["a" * 120, "ab" * 60, "é🙂" * 20]
    for i in range(60):
        parts = [rnd.choice(pool) for _ in range(rnd.randint(0, 4))]
        parts += ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 80))) for _ in range(rnd.randint(0, 3))]
        if rnd.random() < 0.2:
            parts.append("".join(rnd.choice("abcd") for _ in range(3000)))
        rnd.shuffle(parts)
        rows.append((rnd.randint(-20, 40), "".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert by_rows(suffixes.remove_repeats(docs)) == plain_removal(rows)


def test_removal_of_short_and_empty(spark, no_documents):
    assert suffixes.remove_repeats(no_documents).count() == 0
    rows = [(1, "x" * 49), (2, "x" * 49), (3, ""), (4, "y" * 50), (5, "y" * 50), (5, "y" * 50), (6, "z" + "y" * 50)]
    assert by_rows(suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == plain_removal(rows)


def test_families_merge_geometrically():
    rnd = np.random.default_rng(1)
    keys = rnd.integers(0, 5000, 4000).astype(np.uint64)
    family, sizes = suffixes.Family(len(keys)), []
    for batch in np.array_split(np.arange(len(keys)), 13):
        family.insert(keys[batch], batch)
        sizes.append([n for n, _, _ in family.levels])
    assert sizes[7] == [8] and sizes[12] == [8, 4, 1]
    number = Counter(keys.tolist())
    assert family.met.tolist() == [number[k] > 1 for k in keys.tolist()]


def test_equal_strings_survive_equal_hashes(monkeypatch):
    monkeypatch.setattr(suffixes, "_string_hashes", lambda data, starts: np.zeros(len(starts), np.uint64))
    data = np.frombuffer(b"a" * 60 + b"b" * 50 + b"a" * 50, np.uint8)
    group = suffixes._equal_strings(data, np.array([0, 5, 60, 110]))
    assert group[0] == group[1] == group[3] != group[2]


# --- Pipeline


def test_pipeline_stages_and_run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    ratios = quality.fitted(docs, labels)
    judged = {r.doc_id for r in docs.where(quality.verdict(docs.text, ratios)["kept"]).select("doc_id").collect()}
    rows = [(r.doc_id, r.text or "", r.lang, r.source) for r in docs.collect() if r.doc_id in judged]
    single = {i for i, _, c in plain_components([r[:2] for r in rows]) if i == c}
    clean = [(i, secrets.redact(t), lang, source) for i, t, lang, source in rows if i in single]
    frame = spark.createDataFrame(clean, "doc_id long, text string, lang string, source string")
    taken = mixing.mixed(frame, corpus_pipeline.MIX_PERCENT, max_epochs=1).where("copies > 0").select("doc_id").collect()
    taken = {r.doc_id for r in taken}
    encoder = bpe.WordBpe(bpe.vocabulary_path())
    want = {i: np.frombuffer(encoder.encode(t), "<u4").tolist() for i, t, *_ in clean if i in taken}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want and 0 < len(got) < len(clean) < len(rows)


@pytest.mark.parametrize("which", ["messy", "no_documents"])
def test_pipeline_stages_keep_columns(spark, request, sf_dir, which):
    docs = request.getfixturevalue(which).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
        assert after.count() <= docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count()
