import random
import re

import numpy as np

from weftarc.llm import quality_rules as Q
from weftarc.llm.queries import op6_quality_rules

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = list(zip(words, words[1:], words[2:], strict=False))
    many = {t for t in triples if triples.count(t) > 1} if len(triples) < 400 else {t for t, n in __import__("collections").Counter(triples).items() if n > 1}
    flags = [False] * len(words)
    for i, t in enumerate(triples):
        if t in many:
            flags[i : i + 3] = [True] * 3
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(flags)


def test_counts_of_every_document(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in op6_quality_rules(spark, "/root/testdata/sf0.001").collect():
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_odd_texts(spark):
    texts = [None, "", "\n\n \n", "a\na\n\na\r\na", "x y z x y z x y", "é ü ö #*$%&|<>", "last line\nlast line"]
    docs = spark.createDataFrame([(i, t, None, "s") for i, t in enumerate(texts)], SCHEMA)
    for r in Q.quality_verdicts(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])
        assert r.base_failed and not r.kept


def test_outliers_go_and_others_stay_in_every_group(spark):
    rnd = random.Random(13)
    text = lambda n: " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(2, 8))) for _ in range(n))
    rows = [(i, text(rnd.randint(60, 200)), rnd.choice(["en", "de", None]), rnd.choice(["a", "b", None])) for i in range(600)]
    junk = [(1000 + i, " ".join(w + "###%%%" for w in text(80).split()), "en", "a") for i in range(20)]
    got = {r.doc_id: r for r in Q.quality_verdicts(spark.createDataFrame(rows + junk, SCHEMA), prior_rows=40).collect()}
    assert not any(got[i].base_failed for i in got)
    assert [i for i in range(600) if not got[i].kept] == [] and not any(got[1000 + i].kept for i in range(20))


def test_an_outlier_alone_in_its_source_or_language_is_held_against_all_rows(spark):
    rnd = random.Random(14)
    text = lambda n: " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(2, 8))) for _ in range(n))
    junk = " ".join(w + "###%%%" for w in text(80).split())
    rows = [(i, text(rnd.randint(60, 200)), "en", "hot") for i in range(300)]
    rows += [(1000, junk, "en", "small"), (1001, junk, "fr", "hot"), (1002, text(80), "de", None)]
    got = {r.doc_id: r for r in Q.quality_verdicts(spark.createDataFrame(rows, SCHEMA), prior_rows=40).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == {1000, 1001}


def test_empty_tables_and_columns_that_clash(spark):
    assert Q.quality_verdicts(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, " ".join(f"w{i}" for i in range(60)), "en", "s", "mine", 5), (2, "short", "en", "s", "mine", 6)]
    kept = Q.keep_good(spark.createDataFrame(rows, SCHEMA + ", stats string, kept int"))
    assert [tuple(r) for r in kept.collect()] == [rows[0]]


def fixed(stats):
    """The four statistics in fixed point."""
    n_words, chars, symbols, lines, repeats = stats
    n = max(n_words, 1)
    v = [np.log(max(chars, 1) / n), np.log1p(100 * symbols / n), np.log1p(100 * lines / n), np.sqrt(repeats / n)]
    return [min(int(np.rint(x * Q.UNIT)), 16 * Q.UNIT) for x in v]


def estimates(groups):
    """The drawn mean and covariance of each group, by numpy on all rows of a group at once."""
    least = np.diag(np.square(Q.LEAST_SPREAD))
    state = {}
    for g, x in groups.items():
        q = np.percentile(x, (25, 50, 75), axis=0)
        wide = ((q[2] - q[0]) / Q.UNIT) ** 2 / 1.82 + np.diag(least)
        state |= {(g, 0): (q[1] / Q.UNIT, np.diag(wide)), (g, 1): (q[1] / Q.UNIT, least), (g, 2): (x.mean(0) / Q.UNIT, np.diag(x.var(0) / Q.UNIT**2 + np.diag(least)))}
    dets = None
    for _ in range(Q.MAX_STEPS):
        for (g, k), (m, c) in state.items():
            x = groups[g] / Q.UNIT
            d = np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)
            bins = np.minimum(np.floor(np.log1p(d) * 100), 1500)
            weight, before = np.zeros(len(x)), 0
            for b in sorted(set(bins)):
                here = bins == b
                weight[here] = min(1, max(0, (Q.KEPT_SHARE * len(x) - before) / here.sum()))
                before += here.sum()
            m = weight @ x / weight.sum()
            state[g, k] = m, (x * weight[:, None]).T @ x / weight.sum() - np.outer(m, m) + least
        new = {key: np.linalg.det(c) for key, (_, c) in state.items()}
        if dets is not None and all(new[key] >= (1 - Q.TOLERANCE) * dets[key] for key in new):
            break
        dets = new
    best = {g: state[g, min((np.linalg.det(state[g, k][1]), k) for k in range(3))[1]] for g in groups}
    out = {}
    for g in sorted(groups, key=len):
        n = len(groups[g]) / (len(groups[g]) + Q.PRIOR_ROWS)
        out[g] = best[g] if not g else tuple(n * a + (1 - n) * b for a, b in zip(best[g], out[g[:-1]], strict=True))
    return out


def test_verdicts_against_numpy(spark):
    rnd = random.Random(15)
    text = lambda n: " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(2, 8))) + rnd.choice(("", "", "", "#")) for _ in range(n))
    rows = [(i, text(rnd.randint(60, 120)), "en", "a") for i in range(250)] + [(300 + i, text(70) + " b" * (5 * i), "en", "b") for i in range(3)]
    rows += [(400 + i, (text(60) + "\n") * rnd.choice((1, 1, 1, 1, 2)), "de", None) for i in range(120)]
    rows += [(600 + i, rows[260 + i % 5][1], "de", None) for i in range(40)]  # ties
    rows += [(700 + i, " ".join(w + "###%%" for w in text(80).split()), *rnd.choice((("en", "a"), ("en", "b"), ("de", None)))) for i in range(8)]
    got = {r.doc_id: r for r in Q.quality_verdicts(spark.createDataFrame(rows, SCHEMA)).collect()}
    x = {d: fixed(brute(t)) for d, t, _, _ in rows}
    judged = [r for r in rows if not got[r[0]].base_failed]
    groups = {}
    for d, _, lang, source in judged:
        for g in ((), (lang,), (lang, source)):
            groups.setdefault(g, []).append(x[d])
    of = estimates({g: np.array(v, float) for g, v in groups.items()})
    far = 0
    for d, _, lang, source in judged:
        m, c = of[lang, source]
        z = np.array(x[d]) / Q.UNIT - m
        distance = np.sqrt(z @ np.linalg.inv(c) @ z)
        assert abs(got[d].distance - distance) <= 0.02 * distance + 0.02, d
        if abs(distance - Q.CUTOFF) > 0.1:
            assert got[d].kept == (distance <= Q.CUTOFF), d
            far += not got[d].kept
    assert far >= 8 and len({got[600 + i].distance for i in range(0, 40, 5)}) == 1


def test_one_row_and_groups_of_equal_rows(spark):
    text = " ".join(f"word{i}" for i in range(60))
    one = Q.quality_verdicts(spark.createDataFrame([(1, text, None, None)], SCHEMA)).collect()
    assert [(r.base_failed, round(r.distance, 9), r.kept) for r in one] == [(False, 0.0, True)]
    many = [(i, text, "en", "a") for i in range(30)] + [(50, None, "en", "a"), (51, "", None, "b")]
    got = Q.quality_verdicts(spark.createDataFrame(many, SCHEMA)).collect()
    assert sorted((r.base_failed, r.kept) for r in got) == [(False, True)] * 30 + [(True, False)] * 2


def test_a_very_long_text(spark):
    long = " ".join(f"word{i}" for i in range(400_000))
    (r,) = Q.quality_verdicts(spark.createDataFrame([(1, long, "en", "a")], SCHEMA)).collect()
    assert (r.n_words, r.n_repeat_words, r.kept) == (400_000, 0, True)
