import random
import re

from weftarc.llm import substring_dedup as S

SCHEMA = "doc_id long, text string"


def sentences(text):
    """(start, stop, words) of each sentence of a text of single-byte characters; stop is where the next begins."""
    out, at, words = [], None, []
    for m in re.finditer(r"\S+", text or ""):
        at = m.start() if at is None else at
        words.append(m[0].lower())
        rest = text[m.end() :]
        space = re.match(r"\s*", rest)[0]
        if m[0][-1] in ".!?" or "\n" in space or not rest.strip():
            out.append((at, m.end() + len(space), words))
            at, words = None, []
    return out


def brute(rows):
    """Texts left, with the rule applied to every run in turn: the shortest from each sentence, and the shortest up to it."""
    runs = {}
    for d, text in rows:
        cut = sentences(text)
        found = set()
        for i, (_, _, w) in enumerate(cut):
            j, n = i, len(w)
            while len(w) < S.LONG_SENTENCE and (n < S.MIN_RUN_WORDS or j - i + 1 < S.MIN_SENTENCES):
                j += 1
                if j == len(cut):
                    break
                n += len(cut[j][2])
            if j < len(cut):
                found.add((i, j))
            j, n = i, len(w)
            while len(w) < S.LONG_SENTENCE and (n < S.MIN_RUN_WORDS or i - j + 1 < S.MIN_SENTENCES):
                j -= 1
                if j < 0:
                    break
                n += len(cut[j][2])
            if j >= 0:
                found.add((j, i))
        for i, j in found:
            stop = cut[j][1] if j + 1 < len(cut) else len(text)
            runs.setdefault(tuple(x for s in cut[i : j + 1] for x in s[2]), []).append((d, cut[i][0], stop))
    gone = {}
    for places in runs.values():
        for d, start, stop in sorted(places)[1:]:
            gone.setdefault(d, set()).update(range(start, stop))
    return {d: "".join(c for k, c in enumerate(text or "") if k not in gone.get(d, ())) for d, text in rows}, set(gone)


def corpus():
    rnd = random.Random(12)
    sentence = lambda: " ".join(f"w{rnd.randrange(500)}" for _ in range(rnd.randint(3, 14))).capitalize() + rnd.choice(". ! ?".split())
    shared = [" ".join(sentence() for _ in range(6)) for _ in range(5)] + ["x " * 45 + "end."]
    rows = [(1, ""), (2, "One. Two. Three."), (3, "no stop at all")]
    for d in range(4, 60):
        parts = [sentence() for _ in range(rnd.randint(1, 8))]
        for _ in range(rnd.randint(0, 2)):
            parts.insert(rnd.randint(0, len(parts)), rnd.choice(shared).upper() if rnd.random() < 0.3 else rnd.choice(shared))
        rows.append((d, rnd.choice([" ", "\n", "  "]).join(parts)))
    rows.append((60, rows[10][1]))
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    want, cut = brute(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in S.remove_repeats(docs).collect()}
    assert {d: r.text for d, r in got.items()} == want
    assert {d for d, r in got.items() if r.removed_bytes} == cut == {r.doc_id for r in S.removals(docs).collect()}
    assert got[60].text == "" and len(cut) > 10
    assert all(len(r.text.encode()) + r.removed_bytes == len(dict(rows)[d].encode()) for d, r in got.items())


def test_nulls_repeated_rows_and_clashing_columns(spark):
    passage = " ".join(f"word{i}" for i in range(60)) + "."
    rows = [(None, passage, 1), (7, passage, 2), (7, passage, 3), (8, "Only this. " + passage, 4), (9, None, 5)]
    got = {r.removed_bytes: r for r in S.remove_repeats(spark.createDataFrame(rows, SCHEMA + ", removed_bytes int")).collect()}
    assert len(S.remove_repeats(spark.createDataFrame(rows, SCHEMA + ", note int")).collect()) == 5
    by = {r.note: (r.text, r.removed_bytes) for r in S.remove_repeats(spark.createDataFrame(rows, SCHEMA + ", note int")).collect()}
    assert by == {1: (passage, 0), 2: ("", len(passage)), 3: ("", len(passage)), 4: ("Only this. ", len(passage)), 5: (None, 0)}
    assert set(got) == {0, len(passage)}


def test_multi_byte_texts_are_cut_at_characters(spark):
    passage = " ".join(f"wörd{i}é" for i in range(50)) + "."
    rows = [(1, f"Ünicode before. {passage} Nach dem Zitat ß."), (2, f"Ää öö. {passage} Ende ß.")]
    got = {r.doc_id: r.text for r in S.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: rows[0][1], 2: "Ää öö. Ende ß."}


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_of_all_runs(rows):
    """The sentences (document, place) that a later occurrence of any run of several sentences, or of one long one, covers."""
    runs = {}
    for d, text in rows:
        cut = [w for _, _, w in sentences(text)]
        for i in range(len(cut)):
            for j in range(i, len(cut)):
                n = sum(map(len, cut[i : j + 1]))
                if (j > i and n >= S.MIN_RUN_WORDS) or (j == i and n >= S.LONG_SENTENCE):
                    runs.setdefault(tuple(map(tuple, cut[i : j + 1])), []).append((d, i, j))
    return {(d, k) for places in runs.values() for d, i, j in sorted(places)[1:] for k in range(i, j + 1)}


def covered(rows):
    """The same by the runs that are hashed."""
    data = [text.encode() for _, text in rows]
    offsets = S.np.cumsum([0, *map(len, data)])
    row, run, start, stop = S.runs_of_slice(S.np.frombuffer(b"".join(data), S.np.uint8), offsets, S.MIN_SENTENCES, S.MIN_RUN_WORDS, S.LONG_SENTENCE)
    at = {}
    for r, h, a, b in zip(row.tolist(), run.tolist(), start.tolist(), stop.tolist(), strict=True):
        at.setdefault(h, []).append((rows[r][0], a, b))
    starts = {d: [s[0] for s in sentences(text)] for d, text in rows}
    return {(d, k) for places in at.values() for d, a, b in sorted(places)[1:] for k, s in enumerate(starts[d]) if a <= s < b}


def test_runs_that_start_or_end_with_a_sentence_cover_every_repeated_run():
    rnd = random.Random(13)
    sentence = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n)) + "."
    for lengths in ((45, 10), (30, 8, 7), (8, 10, 8), (10, 45), (45, 3, 3), (12, 9), (9, 9)):
        passage = " ".join(map(sentence, lengths))
        rows = [(1, f"{sentence(9)} {passage} {sentence(30)}"), (2, f"{sentence(25)} {passage} {sentence(30)}")]
        want = {(2, k + 1) for k in range(len(lengths))} if sum(lengths) >= 20 else set()
        assert covered(rows) == brute_of_all_runs(rows) == want, lengths
    shared = [" ".join(sentence(rnd.choice((2, 5, 8, 12, 18, 41))) for _ in range(rnd.randint(2, 6))) for _ in range(12)]
    rows = [(d, " ".join(rnd.choice((sentence(rnd.randint(2, 25)), rnd.choice(shared))) for _ in range(rnd.randint(1, 6)))) for d in range(80)]
    assert covered(rows) == brute_of_all_runs(rows)


def test_the_query_cuts_a_repeated_passage_to_its_end(spark, tmp_path):
    from weftarc.llm.queries import op10_substring_dedup

    words = iter(range(10**6))
    sentence = lambda n: " ".join(f"w{next(words)}" for _ in range(n)) + "."
    passage = f"{sentence(45)} {sentence(10)}"
    rows = [(1, f"{passage} {sentence(30)}"), (2, f"First. {passage} Last one.")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.doc_id, r.text) for r in op10_substring_dedup(spark, str(tmp_path)).collect()] == [(2, "First. Last one.")]


def test_callers_columns_stay_whatever_their_names(spark):
    passage = " ".join(f"word{i}" for i in range(60)) + "."
    columns = "doc_id long, text string, n_chars int, removed_spans string, first_doc_ids int, `of.doc` string, row string, left string"
    rows = [(1, passage, 1, "s", 7, "d", "r", "l"), (2, f"Mine. {passage}", 2, None, 8, "e", None, "m"), (3, None, 3, "t", 9, "f", "q", None)]
    docs = spark.createDataFrame(rows, columns)
    got = S.without_repeats(docs, length="n_chars")
    assert got.schema == docs.schema
    assert sorted(tuple(r) for r in got.collect()) == [rows[0], (2, "Mine. ", 6, None, 8, "e", None, "m"), rows[2]]


def test_runs_meet_only_if_both_hashes_agree(spark, monkeypatch):
    texts = [" ".join(f"{k}w{i}" for i in range(60)) + "." for k in "ab"]
    whole = S._runs

    def clash(*args):
        rows, (first, second), start, stop = whole(*args)
        return rows, (S.np.zeros_like(first), second), start, stop

    data = S.pa.array(texts + texts[:1])
    monkeypatch.setattr(S, "_runs", clash)
    found = S.run_finder().func(data).to_pylist()
    assert [r[0]["run"] for r in found] == [0, 0, 0]
    assert found[0][0]["proof"] == found[2][0]["proof"] != found[1][0]["proof"]


def test_a_very_long_text(spark):
    passage = " ".join(f"word{i}" for i in range(60)) + "."
    long = " ".join(f"Sentence {i} of a long text has its own words{i}, many{i} and more{i}." for i in range(40_000))
    got = {r.doc_id: r.text for r in S.remove_repeats(spark.createDataFrame([(1, passage), (2, f"{long} {passage}")], SCHEMA)).collect()}
    assert got == {1: passage, 2: long + " "}
