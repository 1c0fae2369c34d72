import random
import re
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from weftarc.llm import components, simhash
from weftarc.llm.simhash import EXACT, SIMILAR

SCHEMA = "doc_id long, text string"


def brute_fingerprint(text, size=4):
    words = [w.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))) for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(ids, fps, bits=4):
    root = {i: i for i in range(len(ids))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= bits:
            root[find(i)] = find(j)
    least = {}
    for i, n in enumerate(ids):
        least[find(i)] = min(least.get(find(i), n), n)
    return {n: least[find(i)] for i, n in enumerate(ids)}


def test_any_four_positions_hold_a_listed_triple():
    assert len(EXACT.lists) == 20
    assert all(any(set(t) <= set(c) for t in EXACT.lists) for c in combinations(range(8), 4))


def test_fingerprints_and_components_against_brute_force(spark):
    rnd = random.Random(5)
    vocabulary = [f"Wörd{i}" for i in range(40)]
    texts = [None, "", "  \n", "One", "one", "A\tb  c", "a B c d", "a b c d e"]
    base = rnd.choices(vocabulary, k=400)
    for _ in range(40):
        copy = list(base)
        for _ in range(rnd.randint(0, 3)):
            copy[rnd.randrange(400)] = rnd.choice(vocabulary)
        texts.append(rnd.choice([" ", "\n", "  "]).join(copy))
    texts += [" ".join(rnd.choices(vocabulary, k=rnd.randint(1, 60))) for _ in range(60)] + ["one", "X y\x0bz"] * 3
    docs = spark.createDataFrame([(len(texts) - i, t, "clash") for i, t in enumerate(texts)], SCHEMA + ", fp string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    ids = [len(texts) - i for i in range(len(texts))]
    assert {i: got[i].fp[0] & (1 << 64) - 1 for i in ids} == dict(zip(ids, fps, strict=True))
    want = brute_components(ids, fps)
    assert len(set(want.values())) < len(set(fps))  # some different fingerprints are linked
    assert {i: r.component_id for i, r in got.items()} == want


def test_long_lists_are_cut_into_blocks_without_losing_a_link(spark):
    rnd = random.Random(6)
    centre = rnd.getrandbits(64)
    fps = list({centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3))) for _ in range(150)} | {rnd.getrandbits(64) for _ in range(50)})
    rows = [(i, [f - (1 << 64) if f >> 63 else f], i) for i, f in enumerate(fps)]
    table = spark.createDataFrame(rows, "doc_id long, fp array<long>, text_key long")
    for block in (5, 2048):
        named = simhash.components_of(table, EXACT, block=block)
        got = {r.fp[0]: r.component_id for r in named.collect()}
        want = brute_components(list(range(len(fps))), fps)
        assert {i: got[f[0]] for i, f, _ in rows} == want


def test_forest_and_pairs():
    runs, fps = np.array([1, 1, 1, 2, 2]), np.array([[0], [1], [3], [0], [0b11111]], np.uint64)
    left, right, bits = simhash.linked_pairs(runs, fps, 4, 4)
    assert sorted(zip(left.tolist(), right.tolist(), bits.tolist(), strict=True)) == [(0, 1, 1), (0, 2, 2), (1, 2, 1)]
    tree = simhash.nearest_tree(5, left, right, bits)
    assert sorted(zip(left[tree].tolist(), right[tree].tolist(), strict=True)) == [(0, 1), (1, 2)]
    assert simhash.forest(6, np.array([4, 2, 5]), np.array([5, 4, 1])).tolist() == [0, 1, 1, 3, 1, 1]


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(20)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.a: r.b for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {100 + i: 100 for i in range(1, 20)} | {201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_tables_null_ids_and_repeated_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert simhash.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0
    long = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(None, long), (3, long), (3, long), (4, long), (5, "other words here"), (5, "other words here")], SCHEMA)
    assert [r.component_id for r in simhash.near_duplicates(docs).orderBy("component_id").collect()] == [3, 3, 3, 3, 5, 5]
    assert sorted((r.doc_id is None, r.doc_id, r.text[:1]) for r in simhash.keep_one(docs).collect() if r.doc_id) == [(False, 3, "w"), (False, 5, "o")]


def shingles(text, size=5):
    w = text.split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def test_families_near_the_bound_lose_no_candidate(spark):
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for size in (3, 5, 8, 12, 20, 30, 50) * 3:
        base = rnd.choices(vocabulary, k=300)
        for _ in range(size):
            words = list(base)
            for at in rnd.sample(range(0, 300, 7), rnd.randint(3, 5)):
                words[at] = rnd.choice(vocabulary)
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs, SIMILAR).collect()}
    fps = np.array([got[i].fp for i in range(len(texts))], np.int64).view(np.uint64)
    sets = [shingles(t) for t in texts]
    edges = []
    for i in range(len(texts)):
        equal = (fps[i] ^ fps).view(np.uint8).reshape(len(fps), -1) == 0
        listed = np.any([equal[:, p] & equal[:, q] for p, q in SIMILAR.lists], axis=0)
        bits = np.bitwise_count(fps[i] ^ fps).sum(axis=1, dtype=np.int64)
        for j in np.flatnonzero(listed & (equal.sum(axis=1) >= SIMILAR.min_shared) & (bits <= SIMILAR.max_bits)):
            if i < j and len(sets[i] & sets[j]) >= SIMILAR.similarity * len(sets[i] | sets[j]):
                edges.append((i, int(j)))
    root = list(range(len(texts)))
    for _ in texts:
        before = list(root)
        for i, j in edges:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    assert {i: r.component_id for i, r in got.items()} == dict(enumerate(root))


def test_similar_texts_are_found_and_less_similar_ones_stay(spark):
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, pairs = [], []
    for k in range(240):
        words = rnd.choices(vocabulary, k=300)
        rows.append((2 * k, " ".join(words)))
        for at in rnd.sample(range(0, 300, 7), 2 + k % 8):  # each changes some 5 shingles
            words[at] = "changed"
        rows.append((2 * k + 1, " ".join(words)))
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        pairs.append(len(a & b) / len(a | b))
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA), SIMILAR).collect()}
    assert {2 * k for k in range(240)} <= kept
    far = {2 * k + 1 for k, j in enumerate(pairs) if j < 0.8}
    assert len(far) > 40 and far <= kept  # exact: nothing below goes
    near = [2 * k + 1 for k, j in enumerate(pairs) if j >= 0.8]
    assert len(near) > 100 and len(kept.intersection(near)) <= 0.08 * len(near)
    close = [2 * k + 1 for k, j in enumerate(pairs) if j >= 0.85]
    assert len(kept.intersection(close)) <= 0.02 * len(close)


def test_texts_that_only_share_a_repeated_word_stay(spark):
    rnd = random.Random(10)
    own = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    body, filler = own(150), "again " * 4000
    rows = [(1, filler + own(150)), (2, filler + body), (3, filler + body + " end"), (4, filler + own(150)), (5, filler), (6, own(3)), (7, own(3))]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == {1, 2, 4, 5, 6, 7}  # only 3 has a near copy


def test_a_third_text_does_not_part_two_copies(spark):
    rnd = random.Random(11)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
    near = list(words)
    near[100] = "x"
    between = words[:145] + [f"v{i}" for i in range(35)] + words[180:]
    rows = [(1, "a b c d e " * 5 + " ".join(words)), (2, "a b c d e " * 9 + " ".join(between)), (3, "a b c d e " * 40 + " ".join(near))]
    pairs = {(i, j): len(shingles(rows[i][1]) & shingles(rows[j][1])) / len(shingles(rows[i][1]) | shingles(rows[j][1])) for i in range(3) for j in range(i)}
    assert pairs[2, 0] > 0.9 and max(pairs[1, 0], pairs[2, 1]) < 0.8
    assert {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()} == {1, 2}


def test_groups_of_many_blocks_lose_no_candidate(spark, monkeypatch):
    rnd = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = rnd.choices(vocabulary, k=300)
    texts = []
    for size, changes in ((60, 2), (40, 5), (20, 9)):  # a part of many, then more and more that are apart
        for _ in range(size):
            words = list(base)
            for at in rnd.sample(range(0, 300, 7), changes):
                words[at] = rnd.choice(vocabulary)
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    want = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, SIMILAR).collect()}  # one block
    assert 3 < len(set(want.values())) < 100
    monkeypatch.setattr(simhash, "VERIFIED_ROWS", 8)
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, SIMILAR).collect()} == want


def test_shared_shingles_against_sets(monkeypatch):
    rnd = random.Random(13)
    monkeypatch.setattr(simhash, "_COLUMNS", 7)
    sets = [{rnd.randrange(60) for _ in range(rnd.randint(0, 40))} for _ in range(12)]
    got = simhash.shared_shingles(np.array([x for s in sets for x in sorted(s)]), np.array([len(s) for s in sets]))
    assert all(got[i, j] == len(sets[i] & sets[j]) for i, j in combinations(range(12), 2))


def test_callers_columns_and_a_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, long, "a", "b", "c"), (2, long + " end", "d", "e", "f"), (3, "short one", "g", None, "h")]
    docs = spark.createDataFrame(rows, SCHEMA + ", gone_id string, `text_key` string, row string")
    got = simhash.keep_one(docs)
    assert got.schema == docs.schema and sorted(tuple(r) for r in got.collect()) == [rows[0], rows[2]]


def test_texts_that_can_be_similar_share_a_class_of_sizes(spark):
    rows = [(a, b) for a in [*range(0, 70), 127, 128, 129, 1023, 1024, 1639] for b in range(a, int(a / 0.8) + 1)]
    df = spark.createDataFrame(rows, "a long, b long").withColumn("fp", F.array(*[F.lit(7 * k).cast("long") for k in range(4)]))
    keys = lambda c: simhash.list_keys(F.col("fp"), simhash.SIMILAR, F.col(c))
    got = df.select(F.size(F.array_intersect(keys("a"), keys("b"))).alias("n"), F.size(keys("a")).alias("m")).collect()
    assert all(r.n >= len(simhash.SIMILAR.lists) and r.m <= 2 * len(simhash.SIMILAR.lists) for r in got)
