import numpy as np
import pyarrow as pa

from weftarc.llm import flat, queries
from weftarc.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string"


def test_held_out_accuracy_and_contract(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op4_language_id(spark, sf).collect()
    assert len(got) == len(docs)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    judged = [r for r in got if r.held_out and docs[r.doc_id].lang is not None and r.lang_pred != "und"]
    assert len(judged) > 150 and np.mean([r.lang_pred == docs[r.doc_id].lang for r in judged]) >= 0.97


def test_undetermined_rows_unlabelled_tables_and_nulls(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", "en"), (4, "words here " * 20, "en"), (5, "mots là " * 20, "fr"), (8, "mots là " * 9, None), (None, "words here", "en")]
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and [got[i].score for i in (1, 2, 3)] == [0.0] * 3
    assert got[None].held_out is False and got[None].lang_pred in ("en", "fr")
    none = L.identify(spark.createDataFrame([(1, "text", None)], SCHEMA)).first()
    assert (none.lang_pred, none.score) == ("und", 0.0)
    assert L.identify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_look_ups_give_what_the_network_gives():
    rng = np.random.default_rng(1)
    windows = rng.integers(97, 123, (300, L.WINDOW)).astype(np.uint8)
    windows[150:, ::3] = ord("z")
    labels = np.repeat([0, 1], 150)
    model = L.train(windows, labels, ["a", "b"], steps=150)
    texts = [bytes(w).decode() for w in windows[::10]]
    (_, _, buf, offsets), = flat.slices(pa.array(texts))
    got = L.probabilities(model, L.Tables(model), buf, offsets)
    p = {"embedding": model.embedding, "out": model.out, "out_bias": model.out_bias}
    for w, f, b in zip(L.WIDTHS, model.filters, model.biases, strict=True):
        p |= {f"filters{w}": f, f"bias{w}": b}
    assert np.allclose(got, L._forward(p, windows[::10])[2], atol=1e-4)
    assert (got.argmax(1) == labels[::10]).mean() > 0.95


def test_long_texts_are_the_mean_of_all_their_windows():
    rng = np.random.default_rng(2)
    model = L.train(rng.integers(97, 123, (40, L.WINDOW)).astype(np.uint8), np.repeat([0, 1], 20), ["a", "b"], steps=20)
    parts = ["".join(map(chr, rng.integers(97, 123, L.WINDOW))) for _ in range(9)]
    run = lambda texts: np.concatenate([L.probabilities(model, L.Tables(model), b, o) for _, _, b, o in flat.slices(pa.array(texts))])
    whole = run(["".join(parts), "", "x"])
    assert np.allclose(whole.sum(1), [1, 0, 1], atol=1e-6)
    assert np.abs(whole[0] - run(parts).mean(0)).max() < 0.1


def test_many_dirty_labels_do_not_make_the_sample_grow(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_LANGS", 2)
    rows = [(i, f"text number {i} with words", "en" if i % 3 else "de") for i in range(60)] + [(100 + i, "some text here", f"dirty{i}") for i in range(30)]
    _, _, langs = L.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert langs == ["de", "en"]
