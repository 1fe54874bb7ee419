import numpy as np
import pandas as pd

import pytest

from evograph.llm import quality
from evograph.llm.holdout import HOLDOUT, SEEDS
from evograph.llm.quality import FEATURES, NAMES, Lexicon, Trees, classify, described, document_statistics, matrix, statistics, train, weak_labels

WORDS = [("en", w) for w in "the of and to in is that it was for on are with as be at this have from or had by but what some we can out other were all there when use your how said an each she they not you he do no so if about who has more".split()]
WORDS += [("de", w) for w in "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei noch aber wir haben".split()]
WORDS += [("es", w) for w in "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ya o este porque cuando".split()]
LEXICON = Lexicon(WORDS)


def test_statistics():
    s = dict(zip(NAMES, statistics("The cat sat. It was\nhappy!\n\n- one\n", LEXICON)))
    assert s["n_words"] == 7 and s["n_lines"] == 3 and s["line_end_share"] == 1 / 3 and s["bullet_share"] == 1 / 3 and s["language"] == "en"
    assert abs(s["mean_word"] - 22 / 7) < 1e-9 and abs(s["common_share"] - 3 / 7) < 1e-9
    assert statistics(None, LEXICON)[:3] == statistics("", LEXICON)[:3] == (0, 0, 0) and statistics(" \n\t", LEXICON)[1] == 0


def test_masses():
    text = "The cat sat on the mat and it was happy with us all day.\n\n- one\n- two\n- three\n\n" + "Gulp…\nSnap…\n"
    s = dict(zip(NAMES, statistics(text, LEXICON)))
    prose, items, cut = len("The cat sat on the mat and it was happy with us all day."), len("- one- two- three"), len("Gulp…Snap…")
    total = prose + items + cut
    assert s["item_mass"] == items / total and s["cut_mass"] == cut / total and s["common_mass"] == prose / total and s["worded_mass"] == prose / total
    # lines that the text has three times or more are characters without properties in all blocks but the first
    assert dict(zip(NAMES, statistics("- one\n\n" * 10, LEXICON)))["item_mass"] == 0.1


def test_labels_and_features_see_different_statistics():
    x, _ = described(SEEDS + HOLDOUT, LEXICON)
    assert set(FEATURES) <= set(x.columns) and (weak_labels(x) == weak_labels(x.assign(**{f: 0.5 for f in FEATURES}))).all()


def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    t = Trees().fit(x[:400], y[:400]).calibrate(x[400:500], y[400:500])
    p = t.probability(x[500:])
    assert ((p > 0.5) == (y[500:] == 1)).mean() > 0.95 and p.min() >= 0 and p.max() <= 1


def corpus():
    prose, junk = [t for t, p in SEEDS if p], [t for t, p in SEEDS if not p]
    rows = []
    for i in range(60):
        rows.append((2 * i, prose[i % len(prose)] + "\n\n" + prose[(i * 7 + 3) % len(prose)]))
        rows.append((2 * i + 1, junk[i % len(junk)] + "\n\n" + junk[(i * 5 + 2) % len(junk)]))
    return rows


def test_table(spark):
    rows = corpus() + [(1000, None), (1001, " \n "), (1002, "a b " * 50_000), (1003, "x")]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string").selectExpr("*", "'en' AS language", "1 AS n_words")
    words = spark.createDataFrame([(a, b, n) for n, (a, b) in enumerate(WORDS)] + [(None, None, None)], "lang string, word string, freq_rank int")
    got = {r.doc_id: r.not_prose for r in classify(docs, words).collect()}
    assert len(got) == len(rows) and got[1000] and got[1001]
    wrong = [i for i in range(120) if got[i] != bool(i % 2)]
    assert len(wrong) <= 2, wrong
    assert classify(docs.limit(0), words).count() == 0
    small = classify(docs.where("doc_id < 6"), words).collect()
    assert all(r.not_prose == bool(r.doc_id % 2) for r in small)
    assert document_statistics(docs, words.limit(0)).count() == len(rows)


def test_holdout_accuracy():
    """On texts by other hands, which neither the rules nor the training have seen; 120 examples of few kinds train here."""
    sample = pd.DataFrame([statistics(t, LEXICON) for _, t in corpus()], columns=NAMES)
    held, truth = described(HOLDOUT, LEXICON)
    model = train(sample, LEXICON)
    assert ((model.probability(matrix(held)) > 0.5) == (truth == 1)).mean() >= 0.75
    seeds, known = described(SEEDS, LEXICON)
    assert ((model.probability(matrix(seeds)) > 0.5) == (known == 1)).mean() >= 0.97


def test_the_holdout_never_trains(monkeypatch):
    fitted = []
    monkeypatch.setattr(Trees, "fit", lambda self, x, y: fitted.append(x) or self)
    held, _ = described(HOLDOUT, LEXICON)
    train(held.iloc[:0], LEXICON)
    seeds, _ = described(SEEDS, LEXICON)
    known = {tuple(r) for r in matrix(seeds)} | {tuple(r) for r in matrix(seeds.assign(common_mass=0.0))}
    assert {tuple(r) for r in fitted[0]} <= known


def test_a_dictionary_beyond_the_bound_is_refused(spark, monkeypatch):
    monkeypatch.setattr(quality, "DICTIONARY", 3)
    words = spark.createDataFrame([("en", w, i) for i, w in enumerate("the of and to".split())], "lang string, word string, freq_rank int")
    with pytest.raises(ValueError):
        quality.lexicon_of(words)
    assert set(quality.lexicon_of(words.where("freq_rank < 3")).by) == {"the", "of", "and"}


def test_distinct_words_are_those_of_the_whole_text():
    at = NAMES.index("distinct_word_share")
    letters = "abcdefghijklmnopqrstuvwxyz"
    varied = [f"{a}{b}{c}" for a in "xy" for b in letters for c in letters][:400]
    share = lambda ws: statistics(" ".join(ws), LEXICON)[at]
    assert share(varied) == 1 and share(varied * 5) == 1 and share(varied + ["same"] * 3600) == (400 + 9) / 4000 and share([]) == 0
