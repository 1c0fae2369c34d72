import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftarc.llm import packing, queries

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def check(pieces, docs):
    """Pieces against the library's ids of the rows ``docs`` (doc_id, text): all ids once, sequences without gaps and padding."""
    library = Tokenizer.from_file(BYTES)
    want = defaultdict(list)
    for i, text in docs:
        want[i].append(library.encode(text or "", add_special_tokens=False).ids + [0])
    of, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        of[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    assert set(of) == set(want)
    for i, lists in want.items():
        crc = lambda ids, p: zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        assert sum(p.length for p in of[i]) == sum(map(len, lists))
        if len(lists) == 1:
            assert all(p.doc_tokens == len(lists[0]) and p.ids_crc32 == crc(lists[0], p) for p in of[i])
            at = 0
            for p in sorted(of[i], key=lambda p: p.start):
                assert p.start == at and p.length > 0
                at += p.length
    short = []
    for rows in sequences.values():
        at = 0
        for p in sorted(rows, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        if at != packing.WINDOW:
            assert at < packing.WINDOW and at & (at - 1) == 0
            short.append(at)
    assert len(set(short)) == len(short)  # each power of two once at most
    return sequences


def test_pieces_of_whole_texts(spark, monkeypatch):
    texts = ["", None, "one two", "same", "same", "a b c " * 9000, "é\U0001f600 <|endoftext|> x", "word " * 700] * 3
    rows = [(i, t, [None, "web", "books", "code"][i % 4], 0, "x") for i, t in enumerate(texts)] + [(90, "again and again", "web", 1, "y"), (90, "again and again", "web", 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, queue int, part string").repartition(3)
    check(packing.pack(docs, BYTES).collect(), [r[:2] for r in rows])
    assert packing.pack(docs.limit(0), BYTES).count() == 0
    monkeypatch.setattr(packing, "MAX_BROADCAST_ROWS", 0)
    check(packing.pack(docs, BYTES, targets={"web": 1, "code": 3}).collect(), [r[:2] for r in rows])


def test_the_query_over_its_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    pieces = queries.op13_packing(spark, sf).collect()
    sequences = check(pieces, [(d.doc_id, d.text) for d in docs])
    source = {d.doc_id: d.source for d in docs}
    tokens = defaultdict(int)
    for p in pieces:
        tokens[source[p.doc_id]] += p.length
    total, met = sum(tokens.values()), defaultdict(int)
    for w in sorted(sequences):
        for p in sequences[w]:
            met[source[p.doc_id]] += p.length
        done = sum(met.values())
        assert all(abs(met[s] - done * tokens[s] / total) <= 2 * packing.PACKET for s in tokens)


@settings(max_examples=60, deadline=None)
@given(amounts=st.lists(st.integers(0, 400), min_size=1, max_size=6), packet=st.sampled_from([1, 2, 4]))
def test_round_robin(amounts, packet):
    served = packing.round_robin(np.array(amounts), 16, packet)
    total = sum(amounts)
    assert served.sum(axis=0).tolist() == amounts if total else not len(served)
    assert all(n == 16 for n in served.sum(axis=1)[:-1])
    for w, given_ in enumerate(np.cumsum(served, axis=0) if total else []):
        done = min(16 * (w + 1), total)
        assert all(abs(g - a * done / total) <= (len(amounts) + 1) * packet for g, a in zip(given_, amounts, strict=True))


@settings(max_examples=80, deadline=None)
@given(totals=st.lists(st.integers(0, 3000), min_size=1, max_size=5), weights=st.one_of(st.none(), st.lists(st.integers(0, 9), min_size=5, max_size=5)), cut=st.integers(1, 97))
def test_schedules_place_every_token_once(totals, weights, cut):
    weights = None if weights is None else np.array(weights[: len(totals)], float)
    phases = packing.schedule(np.array(totals), weights, window=16, packet=2, period=4)
    places = packing.Places(phases, 16)
    sequences = defaultdict(list)
    for q, n in enumerate(totals):
        first = np.arange(0, n, cut)
        last = np.minimum(first + cut, n)
        row, start, length, sequence, offset = places.pieces(q, first, last)
        assert sorted(x for r, s, k in zip(row, start, length, strict=True) for x in range(first[r] + s, first[r] + s + k)) == list(range(n))
        for s, o, k in zip(sequence.tolist(), offset.tolist(), length.tolist(), strict=True):
            sequences[s] += range(o, o + k)
    assert sorted(sequences) == list(range(len(sequences)))
    sizes = [len(v) for v in sequences.values()]
    assert all(sorted(v) == list(range(len(v))) for v in sequences.values())
    assert sum(sizes) == sum(totals) and sizes.count(16) == sum(totals) // 16 and all(n & (n - 1) == 0 for n in sizes)


def test_long_schedules_are_short():
    rng = np.random.default_rng(5)
    for n in (1, 3, 20, 255):
        totals = (rng.pareto(0.7, n) * 10**8).astype(np.int64) + 1
        phases = packing.schedule(totals)
        assert len(phases) < 400 and sum(int(p.served.sum()) * p.periods for p in phases) == totals.sum()
        full = phases[0].served
        shares = full.sum(axis=0) / full.sum()
        assert np.abs(shares - totals / totals.sum()).max() < n / (packing.PERIOD * packing.WINDOW / packing.PACKET)


@pytest.mark.parametrize("rows", [[], [(1, None, None)]])
def test_least_tables(spark, rows):
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), BYTES).collect()
    assert [tuple(r) for r in got] == [(1, 0, 1, zlib.crc32(bytes(4)), 1, 0, 0)] * len(rows)
