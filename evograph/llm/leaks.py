"""Held-out evaluation texts inside documents.

The search is Wu and Manber's for many patterns at once, over words instead of characters: the patterns are
all runs of four words of the test items, the blocks are pairs of words. A shift table tells how far a pair
lets the window jump; most pairs of a corpus occur in no pattern and allow the longest jump. Where the shift
is zero, the bucket of the pair holds the patterns that end in it, and a direct comparison confirms. Every
passage that counts holds at least two such runs, so nothing is lost. Confirmed runs are then extended in both
directions over changed and added words, and the stretches of one item are put together.

The test items are fixed and few: their table of patterns is built once and shipped with the code of the
tasks, behind a check of its size. Beyond the bound the items are searched for in blocks.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread

#: Words of a pattern; 20 words with one in eight changed in two stretches hold a run of four, and a second.
PATTERN = 4
#: Words of a block.
BLOCK = 2
#: Items whose patterns one table holds; more are searched for in further passes.
ITEMS = 20_000
#: Words of one item that a document must hold.
WORDS = 20
#: Words per changed or added word.
EIGHTH = 8
#: A sentence that this share of the items has in common is an instruction and not part of the item.
SHARED = 0.05

TOKEN = re.compile(r"[^\W_]+")
TAGS = re.compile(r"</?[A-Za-z][^<>]{0,200}>|&(?:[a-z]+|#\d+);|\]\([^)\s]{0,300}\)")
WRAP = re.compile(r"\n[ \t]*(?:[>|#*+•\-]+[ \t]*)+")


def words(text: str) -> list[str]:
    """Lower-case words of a text without markup and quoting marks."""
    return [w.lower() for w in TOKEN.findall(WRAP.sub("\n", TAGS.sub(" ", text)))]


def sentences(question: str | None, answer: str | None) -> list[list[str]]:
    """The words of each sentence of an item, its question and answer read on."""
    return [words(s) for part in (question, answer) for s in re.split(r"(?<=[.?!])\s+", (part or "").strip()) if s]


def prepare(items: DataFrame) -> DataFrame:
    """Rows (item_id, words, own): an item's words without shared instructions, and the places of the patterns that no
    other place of any item has. Counted over all items, so that blocks of them don't matter."""
    rows = items.select("item_id", "question", "answer").dropDuplicates(["item_id"]).where("item_id IS NOT NULL")

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [(i, n, ws) for i, q, a in zip(f.item_id, f.question, f.answer) for n, ws in enumerate(sentences(q, a))]
            yield pd.DataFrame(found, columns=["item_id", "n", "ws"])

    said = rows.mapInPandas(split, "item_id long, n int, ws array<string>").where(F.size("ws") > 0)
    total = rows.agg(F.greatest(F.lit(2.0), F.lit(SHARED) * F.count("*")).alias("most"))
    shared = said.select("item_id", "ws").distinct().groupBy("ws").agg(F.count("*").alias("k")).join(F.broadcast(total), F.col("k") > F.col("most"), "left_semi")  # against one row
    kept = said.join(shared.select("ws"), "ws", "left_anti")
    whole = kept.groupBy("item_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "ws"))), lambda x: x["ws"])).alias("words"))  # an item's sentences
    runs = whole.where(F.size("words") >= PATTERN).select("item_id", "words", F.explode(F.sequence(F.lit(0), F.size("words") - PATTERN)).alias("at"))
    runs = runs.select("item_id", "at", F.xxhash64(*[F.get("words", F.col("at") + i) for i in range(PATTERN)]).alias("run"))
    own = runs.groupBy("run").agg(F.count("*").alias("k"), F.min("item_id").alias("item_id"), F.min("at").alias("at")).where("k = 1").groupBy("item_id").agg(F.collect_list("at").alias("own"))
    return whole.join(own, "item_id", "left").select("item_id", "words", F.coalesce("own", F.array().cast("array<int>")).alias("own"))


class Tables:
    """Shift table, suffix buckets and patterns of a set of items."""

    def __init__(self, items: dict[int, list[str]], own: dict[int, frozenset[int]]):
        self.items = items
        self.own = own  # places of the patterns that no other place has
        self.shift: dict[tuple[str, str], int] = {}
        self.bucket: dict[tuple[str, str], dict[tuple[str, ...], list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        longest = PATTERN - BLOCK + 1
        self.default = longest
        for i, ws in items.items():
            for at in range(len(ws) - PATTERN + 1):
                p = tuple(ws[at : at + PATTERN])
                for j in range(longest):
                    block = p[j : j + BLOCK]
                    self.shift[block] = min(self.shift.get(block, longest), longest - 1 - j)
                self.bucket[p[-BLOCK:]][p].append((i, at))
        self.bucket = {k: dict(v) for k, v in self.bucket.items()}

    def occurrences(self, ws: list[str]) -> Iterator[tuple[int, int, int]]:
        """(item, place in the item, place in the text) of every pattern in a text's words."""
        shift, bucket, default, n = self.shift, self.bucket, self.default, len(ws)
        p = PATTERN - 1
        while p < n:
            block = (ws[p - 1], ws[p])
            s = shift.get(block, default)
            if s:
                p += s
                continue
            found = bucket[block].get(tuple(ws[p - PATTERN + 1 : p + 1]))
            if found:
                for i, at in found:
                    yield i, at, p - PATTERN + 1
            p += 1


#: Run of equal words: from, to in the item, from, to in the text, changed or added words before it in its stretch.
Run = tuple[int, int, int, int, int]


def extend(a: list[str], b: list[str], i: int, j: int, step: int) -> list[tuple[int, int, int]]:
    """From places i, j on in one direction: (place in a, place in b, words changed or added so far) of each equal word of the best prefix."""
    out = []
    top = score = edits = best = 0
    x, y = i, j
    inside = lambda u, v: 0 <= u < len(a) and 0 <= v < len(b)
    while inside(x, y):
        if a[x] == b[y]:
            out.append((x, y, edits))
            x, y, score = x + step, y + step, score + 1
            if score > top:
                top, best = score, len(out)
            continue
        # the cheapest way back to two equal words in a row, or to one at an end
        for da, db in ((1, 1), (0, 1), (1, 0), (2, 2), (1, 2), (2, 1), (0, 2), (2, 0), (3, 3)):
            u, v = x + da * step, y + db * step
            if inside(u, v) and a[u] == b[v] and (not inside(u + step, v + step) or a[u + step] == b[v + step]):
                break
        else:
            break
        cost = max(da, db)
        x, y, edits, score = u, v, edits + cost, score - 3 * cost
        if score < top - 8:
            break
    return out[:best]


def stretches(item: list[str], text: list[str], seeds: list[tuple[int, int]]) -> list[list[Run]]:
    """Maximal stretches around confirmed runs, each as its runs of equal words."""
    out: list[list[Run]] = []
    covered: set[tuple[int, int]] = set()
    for i, j in sorted(seeds, key=lambda s: (s[1], s[0])):
        if (i, j) in covered:
            continue
        left = [(x, y, -e) for x, y, e in extend(item, text, i - 1, j - 1, -1)]
        path = left[::-1] + extend(item, text, i, j, 1)
        covered.update((x, y) for x, y, _ in path)
        runs: list[Run] = []
        for n, (x, y, e) in enumerate(path):
            if n and (x, y) == (path[n - 1][0] + 1, path[n - 1][1] + 1):
                runs[-1] = (runs[-1][0], x + 1, runs[-1][2], y + 1, runs[-1][4])
            else:
                runs.append((x, x + 1, y, y + 1, e - path[n - 1][2] if n else 0))
        out.append(runs)
    return out


def parts(runs: list[Run]) -> Iterator[tuple[int, int, int, int, int]]:
    """(item from, to, text from, to, changed words) of the parts of a stretch that keep to the rate of changes.

    The whole stretch is one of them. A part begins and ends with a run and holds a pattern; words beyond a change
    count if they are more than three for each change. A sentence of the same pattern with other names in it has more changes than the rate.
    """
    for n, (i, _, j, _, _) in enumerate(runs):
        edits = longest = score = top = 0
        for start, to, _, end, e in runs[n:]:
            if score or top:
                edits, score = edits + e, score - 3 * e
                if score <= 0 and n:
                    break
            longest, score = max(longest, to - start), score + to - start
            if score > top or n == 0 and to == runs[-1][1]:
                top = max(top, score)
                if longest >= PATTERN and edits * EIGHTH <= max(to - i, EIGHTH if to - i < 10 else 0):
                    yield i, to, j, end, edits


def held(item: list[str], text: list[str], seeds: list[tuple[int, int]], own: frozenset[int]) -> tuple[int, int]:
    """(words of the item that a text holds in one or two stretches, changed or added ones among them).

    A stretch counts if it holds a run of words that is this item's own: a phrase that several places of the items
    share doesn't tell that this one leaked.
    """
    telling = [(i, j) for i, j in seeds if i in own]
    ss = [
        p for p in {p for runs in stretches(item, text, seeds) for p in parts(runs)}
        if any(p[0] <= i <= p[1] - PATTERN and p[2] <= j <= p[3] - PATTERN for i, j in telling)
    ]
    best = max(((b - a, -e) for a, b, _, _, e in ss if e * EIGHTH <= b - a), default=(0, 0))
    # two stretches in the item's order: a sweep over the text, with the best stretch so far that ends at or before
    # each place of the item, by what it leaves over of the rate of changes (more than `most` is never needed)
    least, most = -EIGHTH, EIGHTH + 2
    none = (-1, 0)
    until = {r: [none] * (len(item) + 1) for r in range(least, most + 1)}
    exact = {r: [none] * (len(item) + 1) for r in until}
    ended = sorted(ss, key=lambda s: s[3])
    k = 0
    for a, b, c, _, e in sorted(ss, key=lambda s: s[2]):
        while k < len(ended) and ended[k][3] <= c + 2:
            x, y, _, _, f = ended[k]
            k += 1
            v, r = (y - x, -f), min(y - x - f * EIGHTH, most)
            exact[r][y] = max(exact[r][y], v)
            for z in range(y, len(item) + 1):
                if until[r][z] >= v:
                    break
                until[r][z] = v
        # words that both hold count once
        for shared in (0, 1, 2):
            rest = b - a - e * EIGHTH - shared
            for r in range(max(least, -rest), most + 1):
                n, f = until[r][a] if not shared else exact[r][a + shared] if a + shared <= len(item) else none
                if n > shared and b - a > shared:
                    best = max(best, (b - a + n - shared, f - e))
    return best[0], -best[1]


def document_leaks(tables: Tables, text: str | None) -> list[tuple[int, int, int]]:
    """(item, words held, changed words) of the items that a text leaks."""
    ws = words(text or "")
    if len(ws) < PATTERN:
        return []
    seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, at, place in tables.occurrences(ws):
        seeds[i].append((at, place))
    out = []
    for i, ss in seeds.items():
        if len(ss) < 2 or len({a + k for a, _ in ss for k in range(PATTERN)}) < 8:
            continue
        n, changed = held(tables.items[i], ws, ss, tables.own[i])
        if n >= WORDS and changed * EIGHTH <= n:
            out.append((i, n, changed))
    return out


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, held, changed): documents that hold a passage of a test item.

    documents: doc_id, text; items: item_id, question, answer. Repeated rows count once. Null, empty and short
    texts hold nothing, items shorter than the 20 words can't leak. Other columns are ignored.
    """
    # the held-out items are a small fixed set; a table beyond the bound is taken in blocks, never at once
    rows = cut(prepare(items))
    n = rows.count()
    docs = spread(documents.select("doc_id", "text").where("text <> ''"), "doc_id").dropDuplicates(["doc_id"])
    blocks = max(1, -(-n // ITEMS))
    out = None
    for b in range(blocks):
        part = list(rows.where(f"pmod(xxhash64(item_id), {blocks}) = {b}").toLocalIterator())
        tables = Tables({r.item_id: list(r.words) for r in part}, {r.item_id: frozenset(r.own) for r in part})
        shared = documents.sparkSession.sparkContext.broadcast((tables.items, tables.own, tables.shift, tables.bucket, tables.default))

        def search(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            t = Tables({}, {})
            t.items, t.own, t.shift, t.bucket, t.default = shared.value
            for f in frames:
                found = [(d, *x) for d, text in zip(f.doc_id, f.text) for x in document_leaks(t, text)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "held", "changed"])

        one = docs.mapInPandas(search, "doc_id long, item_id long, held int, changed int")
        out = one if out is None else out.unionByName(one)
    return out
