import random
import time

from weftarc.llm import decontaminate as D

rnd = random.Random(11)
VOCABULARY = [f"wörd{i}" for i in range(2000)]
ITEMS = [" ".join(rnd.choices(VOCABULARY, k=n)) + "." for n in (40, 30, 25, 7)]


def words(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isascii() and not c.isalnum():
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def brute(docs, items):
    """(doc, item) with some shift at which the best segment agrees in enough words; every shift is tried."""
    found = set()
    for d, text in docs:
        w = words(text)
        for n, item in items:
            v = words(item)
            if len(v) < D.LEAST_ITEM:
                continue
            for shift in range(-len(v) + 1, len(w)):
                same = [w[shift + k] == v[k] for k in range(len(v)) if 0 <= shift + k < len(w)]
                if sum(same) < min(D.MIN_WORDS, len(v)):
                    continue
                m, length, _ = D.best_segment(D.np.array(same))
                if m >= min(D.MIN_WORDS, len(v)) and m >= D.MIN_SHARE * length:
                    found.add((d, n))
    return found


def cases():
    filler = lambda n: " ".join(rnd.choices(VOCABULARY, k=n))
    docs = [None, "", filler(200), ITEMS[0], f"{filler(50)}\n{ITEMS[1].upper()} {filler(50)}", f"{filler(30)} {ITEMS[3]} {filler(30)}"]
    for k in (0, 1, 2):
        w = ITEMS[k].split()
        for at in range(4, len(w), 8):  # a word in eight is another
            w[at] = "other"
        docs.append(f"{filler(20)} {' '.join(w)} {filler(20)}")
    docs.append(" ".join(ITEMS[0].split()[:20]) + " " + filler(40))  # half an item
    docs.append(" ".join(ITEMS[0].split()[:9]) + " " + filler(40))  # too little of it
    docs.append(" ".join(x for pair in zip(ITEMS[1].split(), filler(30).split(), strict=True) for x in pair))  # every second word
    return list(enumerate(docs))


def found(spark, docs, items, **params):
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return D.find_leaks(rows, bench, **params).collect()


def test_leaks_against_brute_force_in_one_block_and_in_many(spark):
    docs, items = cases(), [*enumerate(ITEMS, 10), (20, None), (21, "too short"), (22, "")]
    want = brute(docs, items)
    assert {d for d, _ in want} == {3, 4, 5, 6, 7, 8, 9}
    for block in (D.BLOCK_BYTES, 200):
        assert {(r.doc_id, r.item_id) for r in found(spark, docs, items, block_bytes=block)} == want


def test_best_segment_against_every_segment():
    draw = random.Random(12)
    cases = [[1] * 13 + [0] * 8 + [1] * 13, [1] * 20 + [0] * 12 + [1] * 20]
    cases += [[int(draw.random() < share) for _ in range(draw.randint(1, 60))] for share in (0.5, 0.7, 0.8, 0.9) for _ in range(150)]
    for same in cases:
        whole = [(i, j) for i in range(len(same)) for j in range(i + 1, len(same) + 1) if 5 * sum(same[i:j]) >= 4 * (j - i)]
        want = max(((sum(same[i:j]), i - j, -i) for i, j in whole), default=(0, 0, 0))
        assert D.best_segment(D.np.array(same, bool)) == (want[0], -want[1], -want[2]), same


def test_a_changed_middle_does_not_hide_an_item():
    other = lambda n: [f"changed{k}" for k in range(n)]
    for ends, middle in ((13, 8), (20, 12)):
        item = [f"word{k}" for k in range(2 * ends + middle)]
        text = " ".join(item[:ends] + other(middle) + item[ends + middle :])
        ((_, words, first, _),) = D._word_hashes(D.pa.array([text]))
        ((no, matched, length, start),) = D.SeedIndex([" ".join(item)]).leaks(words, first)[0]
        assert (no, matched, length, start) == (0, ends, ends, 0)


def test_dropping_keeps_columns_and_clean_rows(spark):
    docs = spark.createDataFrame([(d, t, "x") for d, t in cases()], "doc_id long, text string, leak string")
    bench = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    kept = D.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {0, 1, 2, 10, 11}


def test_empty_tables(spark):
    assert found(spark, cases(), []) == []
    assert found(spark, [], list(enumerate(ITEMS))) == []


def test_short_items_count_where_they_are_a_whole_line(spark):
    items = [(1, "Yes, it is"), (2, "Paris"), (3, "..."), (4, "Paris"), (5, "one two three four five")]
    docs = [(1, "a line\n yes it IS!\nmore"), (2, "Yes, it is so"), (3, "Paris"), (4, "In Paris.\nYes it\nis"), (5, "one two three four five"), (6, None), (7, "\n\n...\n")]
    assert {(r.doc_id, r.item_id) for r in found(spark, docs, items)} == {(1, 1), (3, 2), (3, 4), (5, 5)}


def test_a_template_of_very_many_items():
    draw = D.np.random.default_rng(3)
    template = [f"template{k}" for k in range(12)]
    texts = [" ".join(template + [f"own{x}" for x in draw.integers(0, 10**6, 20)]) for _ in range(4000)]
    index = D.SeedIndex(texts)
    filler = [f"filler{k}" for k in range(300)]
    docs = [" ".join(filler + template + filler), " ".join(filler + texts[17].split() + filler), texts[5]]
    ((_, words, first, begins),) = D._word_hashes(D.pa.array(docs))
    began = time.perf_counter()
    got = index.leaks(words, first, begins)
    took = time.perf_counter() - began
    assert {r: [x[0] for x in v] for r, v in got.items()} == {1: [17], 2: [5]}
    assert took < 1


def test_recall_at_the_bound():
    draw = random.Random(14)
    texts = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(n)) for n in range(17, 41) for _ in range(20)]
    index, docs = D.SeedIndex(texts), []
    for t in texts:
        w = t.split()
        for at in draw.sample(range(len(w)), len(w) - -(-len(w) * 4 // 5)):  # four in five words stay
            w[at] = f"x{draw.randrange(10**6)}"
        docs.append(" ".join([f"a{draw.randrange(10**6)}" for _ in range(30)] + w + [f"b{draw.randrange(10**6)}" for _ in range(30)]))
    caught, row = 0, 0
    for lo, words, first, begins in D._word_hashes(D.pa.array(docs)):
        got = index.leaks(words, first, begins)
        caught += sum(any(x[0] == lo + r for x in got.get(r, ())) for r in range(len(first) - 1))
    assert caught >= 0.97 * len(texts)


def test_repeated_items_and_a_very_long_text(spark):
    docs = [(1, " ".join(f"w{i}" for i in range(300_000)) + " " + ITEMS[0])]
    assert sorted(r.item_id for r in found(spark, docs, [(k, ITEMS[0]) for k in range(5)] + [(9, ITEMS[1])])) == [0, 1, 2, 3, 4]
