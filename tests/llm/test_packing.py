import itertools
import random

import numpy as np
import pytest

from evograph.llm.packing import Container, best_fit, pack, packing_summary, sizes, token_counter


def test_best_fit_keeps_every_constraint():
    rng = random.Random(1)
    for c in (Container(tokens=100), Container(tokens=100, documents=3), Container(tokens=100, attention=0.3)):
        items = np.array(sorted((rng.randint(1, 100) for _ in range(400)), reverse=True))
        at = best_fit(items, c)
        for b in set(at):
            x = items[at == b]
            assert x.sum() <= 100 and len(x) <= c.documents and ((x.astype(float) ** 2).sum() <= c.attention * 100**2 or len(x) == 1)
    assert len(set(best_fit(np.array([60, 50, 40, 30, 20]), Container(tokens=100)))) == 2
    assert len(best_fit(np.array([], dtype=int), Container())) == 0


def test_near_the_optimum_of_small_cases():
    rng = random.Random(2)

    def optimum(items, cap):
        for n in range(1, len(items) + 1):
            for a in itertools.product(range(n), repeat=len(items)):
                if all(sum(x for x, k in zip(items, a) if k == b) <= cap for b in range(n)):
                    return n

    for _ in range(15):
        items = sorted((rng.randint(1, 10) for _ in range(6)), reverse=True)
        assert len(set(best_fit(np.array(items), Container(tokens=10)))) <= optimum(items, 10) + 1


def test_tokenizers():
    import os

    base = "/opt/tokenizers"
    if not os.path.exists(base):
        pytest.skip("no vocabularies here")
    text = "Half of the budget goes to the first layer. <|endoftext|>"
    a, b = token_counter(f"{base}/byte_bpe_50k.tiktoken")(text), token_counter(f"{base}/byte_bpe_50k.json")(text)
    assert a == b > 5 and token_counter(f"{base}/piece_bpe_32k.model")(text) > 5


def test_table(spark):
    rng = random.Random(3)
    rows = [(i, "word " * rng.choice([1, 3, 20, 90, 300, 700])) for i in range(400)] + [(1000, "word " * 20_000), (1001, None), (1002, ""), (1003, "w" * 3000)]
    df = spark.createDataFrame(rows + rows[:10], "doc_id long, text string").selectExpr("*", "1 AS tokens", "'x' AS container")
    size = {r.doc_id: r.tokens for r in sizes(df).collect()}
    for c in (Container(), Container(group=50, documents=10), Container(tokens=512), Container(group=40, documents=6, attention=0.25)):
        got = pack(df, c).collect()
        assert {r.doc_id for r in got if r.container is None} == {1001, 1002} == {i for i, n in size.items() if n == 0}
        pieces = {}
        for r in got:
            pieces.setdefault(r.doc_id, []).append(r)
        for i, ps in pieces.items():
            ps.sort(key=lambda r: r.piece)
            assert sum(p.tokens for p in ps) == size[i] and [p.piece for p in ps] == list(range(len(ps)))
            assert len(ps) == max(1, -(-size[i] // c.tokens)) and all(p.first_token == p.piece * c.tokens for p in ps)
        bins = {}
        for r in got:
            if r.container:
                bins.setdefault(r.container, []).append(r)
        assert all(sum(r.tokens for r in b) == b[0].filled <= c.tokens and len(b) <= c.documents for b in bins.values())
        room = c.attention * c.tokens**2
        assert all(sum(r.tokens**2 for r in b) <= room or len(b) == 1 for b in bins.values())
        s = packing_summary(pack(df, c), c).collect()[0]
        assert s.least_containers == max(-(-sum(size.values()) // c.tokens), -(-sum(len(b) for b in bins.values()) // c.documents), -(-sum(min(r.tokens**2, room) for b in bins.values() for r in b) // room))
        assert s.containers == len(bins) and s.tokens == sum(size.values()) and s.split_documents == sum(n > c.tokens for n in size.values())
        if c.documents > 10:
            assert s.containers <= 1.02 * s.least_containers + 1
    assert pack(df.limit(0)).count() == 0 and packing_summary(pack(df.limit(0))).collect()[0].containers == 0
