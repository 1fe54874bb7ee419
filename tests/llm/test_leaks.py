import random

from collections import Counter

from evograph.llm.leaks import Tables, document_leaks, held, leaks, parts, prepare, sentences, stretches, words

RNG = random.Random(7)
VOCAB = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "sa", "to", "vi") for b in ("bar", "den", "fil", "gos", "hem", "jup", "kar", "lom", "mun", "nop")]
RULE = "Answer in one paragraph and cite the file path and the line number of every finding you rely on, without guessing at code that is not shown here."


def sentence(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n)) + "."


ITEMS = [(i, sentence(15) + " " + RULE, sentence(20) + " " + sentence(15)) for i in range(60)]


def prepared(items):
    """Words and own places of items, in plain Python."""
    said = {i: [tuple(ws) for ws in sentences(q, a)] for i, q, a in items}
    many = Counter(s for ss in said.values() for s in set(ss))
    w = {i: [x for s in ss if many[s] <= max(2, 0.05 * len(items)) for x in s] for i, ss in said.items()}
    runs = Counter(tuple(ws[k : k + 4]) for ws in w.values() for k in range(len(ws) - 3))
    return w, {i: frozenset(k for k in range(len(ws) - 3) if runs[tuple(ws[k : k + 4])] == 1) for i, ws in w.items()}


W, OWN = prepared(ITEMS)
T = Tables(W, OWN)
PROSE = "The build was slow again this week because nobody cleaned the cache after the release. "


def test_search_is_brute_force():
    for _ in range(60):
        i = RNG.randrange(60)
        p = RNG.randrange(30)
        text = words(PROSE) + W[i][p : p + RNG.randint(3, 12)] + words(PROSE) + W[RNG.randrange(60)][:5]
        want = {(k, a, b) for k, ws in W.items() for a in range(len(ws) - 3) for b in range(len(text) - 3) if ws[a : a + 4] == text[b : b + 4]}
        assert set(T.occurrences(text)) == want


def cases():
    yield "whole", " ".join(W[3]), {3}
    yield "twenty words", PROSE + " ".join(W[4][5:27]) + ". " + PROSE, {4}
    yield "upper case, wrapped, quoted", "> " + "\n> ".join(" ".join(W[5][k : k + 6]).upper() for k in range(0, 30, 6)) + "\n\n" + PROSE, {5}
    yield "marked up", "<p>" + " ".join(f"<b>{w}</b>," for w in W[6][:24]) + "</p>", {6}
    changed = list(W[7][:30])
    changed[6] = "other"
    changed[17:18] = []
    changed.insert(24, "really")
    yield "changed", PROSE + " ".join(changed), {7}
    yield "two stretches", " ".join(W[8][4:16]) + " " + PROSE + PROSE + " ".join(W[8][16:28]), {8}
    yield "wrong order", " ".join(W[9][16:28]) + " " + PROSE + " ".join(W[9][4:16]), set()
    yield "short quotation", PROSE + " ".join(W[10][:14]) + " " + PROSE, set()
    yield "instruction", PROSE + RULE + " " + PROSE, set()
    yield "other wording", " ".join(w if n % 3 else "else" for n, w in enumerate(W[11])), set()
    yield "shuffled", " ".join(RNG.sample(W[12], len(W[12]))), set()
    yield "two items", " ".join(W[13][:25]) + " " + PROSE + " ".join(W[14][10:40]), {13, 14}
    yield "empty", "", set()


def test_cases():
    for name, text, want in cases():
        assert {x[0] for x in document_leaks(T, text)} == want, name


def test_table(spark):
    docs = [(n, text) for n, (_, text, _) in enumerate(cases())] + [(100, None), (101, "x " * 200_000 + " ".join(W[3])), (None, "word")]
    want = {(n, i) for n, (_, _, ids) in enumerate(cases()) for i in ids} | {(101, 3)}
    d = spark.createDataFrame(docs + docs[:3], "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS held")
    items = spark.createDataFrame(ITEMS + [ITEMS[0], (900, None, None), (901, "short", "one")], "item_id long, question string, answer string").selectExpr("*", "3 AS doc_id")
    assert {(r.doc_id, r.item_id) for r in leaks(d, items).collect()} == want
    assert leaks(d.limit(0), items).count() == 0 and leaks(d, items.limit(0)).count() == 0


def found(item, text):
    t = Tables({1: item}, {1: frozenset(range(len(item)))})
    return {x[0]: x[1:] for x in document_leaks(t, " ".join(text))}


def test_the_part_within_the_rate_counts():
    item = [f"w{n}" for n in range(100)]
    noisy = [w if n % 5 else f"other{n}" for n, w in enumerate(item)]
    assert found(item, item[:24] + noisy[24:])[1][0] >= 24 and found(item, noisy[:70] + item[70:])[1][0] >= 24
    assert found(item, noisy) == {}


def test_any_two_stretches_count():
    item = [f"w{n}" for n in range(60)]
    other = [f"x{n}" for n in range(30)]
    assert found(item, item[:8] + other + item[13:27]) == {1: (22, 0)}
    assert found(item, item[13:27] + other + item[:8]) == {} and found(item, item[:8] + other + item[13:24]) == {}
    # the pair that counts is behind many longer stretches that don't go together
    texts = [w for n in range(70) for w in [*item[30:42], f"a{n}", f"b{n}", f"c{n}", f"d{n}"]]
    assert found(item, item[:11] + other + item[15:26])[1] == (22, 0)
    assert found(item, texts) == {} and found(item, texts + item[:11] + other + item[15:26])[1] == (22, 0)


def test_pairs_are_brute_force():
    rng = random.Random(9)
    for _ in range(200):
        item = [rng.choice("abcdefghijkl") + rng.choice("xyz") for _ in range(50)]
        text = []
        for _ in range(6):
            a, k = rng.randrange(46), rng.randint(4, 14)
            text += [w if rng.random() < 0.93 else "-" for w in item[a : a + k]] + ["?" * rng.randint(1, 9)] * 5
        seeds = [(i, j) for i in range(len(item) - 3) for j in range(len(text) - 3) if item[i : i + 4] == text[j : j + 4]]
        ss = [p for s in stretches(item, text, seeds) for p in parts(s)]
        one = [(b - a, -e) for a, b, _, _, e in ss]
        two = [(b - a + y - x - max(b - x, 0), -e - f) for a, b, _, d, e in ss for x, y, c, _, f in ss if c >= d - 2 and x >= b - 2 and (a, y) != (x, b)]
        want = max(((n, e) for n, e in one + two if -e * 8 <= n), default=(0, 0))
        n, e = held(item, text, seeds, frozenset(range(50)))
        assert (n, -e) == want


def test_stock_phrases_are_no_evidence(spark):
    stock, other = [f"s{n}" for n in range(10)], [f"x{n}" for n in range(30)]
    one, two = [f"a{n}" for n in range(30)], [f"b{n}" for n in range(30)]
    items = [(1, " ".join(one + stock), None), (2, " ".join(two[:5] + stock + two[5:]), None)]
    w, own = prepared(items)
    df = spark.createDataFrame(items + items[:1], "item_id long, question string, answer string")
    assert {r.item_id: (list(r.words), frozenset(r.own)) for r in prepare(df).collect()} == {i: (w[i], own[i]) for i in w}
    t = Tables(w, own)
    # ten own words and ten of a phrase that both items have are not two stretches of the item
    assert document_leaks(t, " ".join(one[:12] + other + stock)) == []
    assert [x[0] for x in document_leaks(t, " ".join(one[:12] + other + one[20:] + stock))] == [1]


def test_shared_sentences_are_counted_over_all_items(spark, monkeypatch):
    from evograph.llm import leaks as module

    docs = spark.createDataFrame([(n, text) for n, (_, text, _) in enumerate(cases())], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, question string, answer string")
    whole = {tuple(r) for r in leaks(docs, items).collect()}
    monkeypatch.setattr(module, "ITEMS", 25)
    assert {tuple(r) for r in leaks(docs, items).collect()} == whole
