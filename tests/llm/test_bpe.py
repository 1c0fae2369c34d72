import hashlib
import random
import time

import pyarrow as pa
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftarc.llm import bpe, bpe_codec, queries, token_counts

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SPECIAL = ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "x <|startoftext|>y", "<|endoftext", "ΑΣ ΟΔΟΣ Σ", "İstanbul", "  \n a \t", "'s 'LL don't", "aaaaaaa" * 9, "1２³", "éé", "\x1c\x85 "]
known = st.characters(max_codepoint=0x2FF, exclude_categories=("Cs", "Cn"))


def ids_of(path, texts):
    return bpe_codec.encode_batch(pa.array(texts, pa.string()), bpe.WordStore(bpe.load(path))).to_pylist()


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(st.one_of(known, st.sampled_from(" \n'sdtaΣσé<|>endoftext")), max_size=60), max_size=8))
def test_ids_are_the_librarys(path, texts):
    library = Tokenizer.from_file(path)
    texts = texts + SPECIAL
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(path, texts) == want
    got = bpe_codec.decode_batch(pa.array(want, pa.list_(pa.int32())), WORDS if path == WORDS else BYTES).to_pylist()
    if path == WORDS:
        assert got == [library.decode(i, skip_special_tokens=False) for i in want]


def test_long_texts_are_cut_where_no_word_can_cross(monkeypatch):
    monkeypatch.setattr(bpe, "PIECE_CHARS", 10)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 50)
    text = "One two  three\n\n four 'll don't     end of  a text. " * 20 + "  "
    for path in (BYTES, WORDS):
        assert ids_of(path, [text, "x"]) == [e.ids for e in Tokenizer.from_file(path).encode_batch([text, "x"], add_special_tokens=False)]


def test_a_full_store_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STORED_WORDS", 3)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 10)
    texts = ["alpha beta gamma", "alpha delta", "beta epsilon zeta eta", "alpha"]
    assert ids_of(BYTES, texts) == [e.ids for e in Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False)]


def test_unsafe_merges_go_one_by_one():
    """Of (a, bc) -> abc, whose product has a pair of a lower rank, only the first is merged before that pair is looked at."""
    import json
    import tempfile

    chars = bpe.byte_characters()
    vocab = {c: i for i, c in enumerate(chars)} | {"bc": 256, "ab": 257, "abc": 258, "abca": 259}
    merges = [["b", "c"], ["abc", "a"], ["a", "bc"]]
    spec = {"added_tokens": [{"content": "<|x|>", "id": 300}], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel"}, "model": {"vocab": vocab, "merges": merges, "end_of_word_suffix": None}}
    with tempfile.NamedTemporaryFile("w", suffix=".json") as f:
        json.dump(spec, f)
        f.flush()
        table = bpe.Table(f.name)
    assert table.unsafe.tolist() == [False, False, True]
    symbols, offsets = bpe.merge_rounds(*bpe.first_symbols(["abcabc"], table), table)
    assert symbols.tolist() == [259, 256] and offsets.tolist() == [0, 2]


def test_counts_and_digests_of_every_row(spark):
    texts = [None, "", "hello  world", "<|endoftext|>", "é" * 3000, "hello  world"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    library = Tokenizer.from_file(BYTES)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, BYTES).collect()}
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert got == {i: (len((t or "").encode()), n[i], n[i] > 1024) for i, t in enumerate(texts)}
    back = {r.doc_id: r for r in bpe_codec.decode(bpe_codec.encode(docs, WORDS), WORDS).collect()}
    both = {r.doc_id: r for r in bpe_codec.round_trip(docs, WORDS).collect()}
    words = Tokenizer.from_file(WORDS)
    for i, t in enumerate(texts):
        ids = words.encode(t or "", add_special_tokens=False).ids
        assert (back[i].token_ids, back[i].decoded_text) == (both[i].token_ids, both[i].decoded_text) == (ids, words.decode(ids, skip_special_tokens=False))


def test_queries_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    words, library = Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in queries.op9_bpe_codec(spark, sf).collect():
        ids = words.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(words.decode(ids, skip_special_tokens=False)))
    got = {r.doc_id: r.n_tokens for r in queries.op8_token_counts(spark, sf).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in docs.items()}


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_long_words_are_the_librarys(path):
    rnd = random.Random(4)
    words = ["a" * 3001, "".join(rnd.choices("etaoinshrdlu", k=5000)), "the" * 900, "".join(rnd.choices("abcé日本", k=1500)), "x" * 399 + " " + "ing" * 134]
    texts = [*words, " and ".join(words) + " end", ""]
    assert ids_of(path, texts) == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_a_very_long_word_takes_no_longer_than_its_merges():
    word = "".join(random.Random(5).choices("etaoinshrdlucmfw", k=80_000))
    table = bpe.load(BYTES)
    table.pairs()
    began = time.perf_counter()
    symbols, _ = bpe.merge_words(*bpe.first_symbols([word], table), table)
    assert time.perf_counter() - began < 2
    assert symbols.tolist() == Tokenizer.from_file(BYTES).encode(word, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_every_character_is_cut_and_lowered_as_in_the_library(path):
    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(f"a{c}b1{c}2 {c}" for c in characters[k : k + 500]) for k in range(0, len(characters), 500)]
    assert ids_of(path, texts) == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_empty_tables_and_clashing_columns(spark):
    schema = "doc_id long, text string, token_ids string, n_tokens string, decoded_text string"
    none, some = spark.createDataFrame([], schema), spark.createDataFrame([(None, None, "a", "b", "c"), (1, "", "a", "b", "c"), (1, "", "a", "b", "c")], schema)
    assert token_counts.count_tokens(none, BYTES).count() == bpe_codec.round_trip(none, WORDS).count() == 0
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(some, BYTES).collect()] == [(0, 0, False)] * 3
    assert [(r.token_ids, r.decoded_text) for r in bpe_codec.round_trip(some, WORDS).collect()] == [([], "")] * 3
