"""Per-document text statistics, and a classifier that tells running prose from everything else.

The statistics are taken per document over its whole text, line by line: counts and ratios of the text as a whole, and
*masses*: the shares of its characters that lie in stretches with a property of sentences or of their absence
(frequent words, words of mixed lengths, words spelled in letters, list items, entries that each begin anew). No
statistic decides anything. Gradient-boosted trees are trained on the masses with weak labels: simple rules over the
other statistics, those of the text as a whole, vote for prose or for structural junk, so that labels and features
look at a document from two sides. The scores are calibrated to probabilities on a small holdout of texts by other
hands, checked by hand and never trained on. Training takes a bounded sample of documents, statistics and decisions
cover all of them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from .holdout import HOLDOUT, SEEDS

#: Documents of the training sample, at most: those with the smallest hashes.
SAMPLE = 4000
TREES, DEPTH, RATE, BINS, LEAF = 80, 3, 0.15, 32, 8

WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
LINK = re.compile(r"\(?(?:see )?\[[^\]\n]{0,200}\]\([^)\n]{0,300}\)\)?|https?://\S+")
MARK = re.compile(r"^[ \t]*(?:>[ \t]?)+|^[ \t]*#{1,6}[ \t]+")
BULLET = re.compile(r"^[ \t]*(?:[-+*•‣·–]|\d{1,3}[.):]|[a-z][.)]|\[[ xX]\])[ \t]+")
# Whole tokens (no white space around is left out) that are a word with any signs around it.
LETTERS = re.compile(r"(?<!\S)[^\w\s]*[^\W\d_]+(?:['’\-][^\W\d_]+)*[^\w\s]*(?!\S)")
END = re.compile(r"[.!?:;…。！？]['\"”’»)\]]*\s*$")
BLANK = re.compile(r"\n[ \t]*\n")
CUT = re.compile(r"(?:…|\.\.\.)\s*$")
CODE = re.compile(r"[{};]\s*$|^\s*(?:function|const|let|var|return|import|export|class|def|if|for|while|case|default|try|catch|break)\b.*[({;:=]|=>|^\s*[@+\-]{1,3} |^\s*at .*\(.*:\d+|^\s*\|.*\|\s*$|^[^\w\s]*$|^\s*[\w.\-/]+\s*[=:]\s*\S+$|^\d{4}-\d\d-\d\d|\t.*\t")

STATISTICS = (
    "n_chars long, n_words long, n_lines int, mean_word double, word_spread double, symbol_ratio double, digit_ratio double, letter_ratio double, upper_ratio double,"
    " line_end_share double, bullet_share double, cut_share double, mean_line_words double, short_line_share double, common_share double, short_word_share double,"
    " distinct_line_share double, distinct_word_share double, code_line_share double, plain_token_share double, junk_char_ratio double, fluent_mass double, common_mass double, spelled_mass double, item_mass double,"
    " begun_mass double, worded_mass double, varied_mass double, cut_mass double, language string"
)
NAMES = [x.split()[0] for x in STATISTICS.split(", ")]
#: What the trees see; the weak labels see the rest.
FEATURES = [x for x in NAMES if x.endswith("_mass")]


class Lexicon:
    """Frequent words per language."""

    def __init__(self, rows: list[tuple[str, str]]):
        by: dict[str, set[str]] = {}
        for lang, word in rows:
            if lang and word:
                by.setdefault(word.lower(), set()).add(lang)
        self.by = {w: tuple(sorted(x)) for w, x in by.items()}

    def language(self, words: list[str]) -> tuple[str | None, float]:
        """The language whose frequent words cover most of the words, and their share; ties go by name."""
        found: dict[str, int] = {}
        for langs, k in Counter(map(self.by.get, words)).items():
            for lang in langs or ():
                found[lang] = found.get(lang, 0) + k
        if not found:
            return None, 0.0
        lang = min(found, key=lambda x: (-found[x], x))
        return lang, found[lang] / len(words)


class Line(NamedTuple):
    """A line with what is asked of it more than once."""

    text: str
    low: list[str]  # its words in lower case
    words: int
    tokens: int
    lettered: int  # tokens that are a word with any signs around it
    bullet: bool
    code: bool  # looks like code, a log or a table
    cut: bool  # ends in an ellipsis
    ended: bool  # ends like a sentence
    capital: bool  # its first letter is one
    said: tuple[list[str], int, int]  # words, tokens, lettered ones without marks, tags and links


def line_of(text: str) -> Line:
    low = WORD.findall(text.lower())
    tokens, lettered = len(text.split()), len(LETTERS.findall(text))
    clean = MARK.sub("", text)
    if "<" in text or "[" in text or "http" in text:
        clean = LINK.sub(" ", TAG.sub(" ", clean))
        said = WORD.findall(clean.lower()), len(clean.split()), len(LETTERS.findall(clean))
    elif clean != text:
        said = low, len(clean.split()), lettered  # marks hold no words
    else:
        said = low, tokens, lettered
    first = next((c for c in text if c.isalpha()), "")
    return Line(text, low, len(low), tokens, lettered, BULLET.match(text) is not None, CODE.search(text) is not None, CUT.search(text) is not None, END.search(text) is not None, first.isupper(), said)


def moments(lengths: Counter) -> tuple[float, float]:
    """Mean and standard deviation of counted lengths; zeros for none."""
    count = max(sum(lengths.values()), 1)
    mean = sum(x * k for x, k in lengths.items()) / count
    return mean, math.sqrt(sum(k * (x - mean) ** 2 for x, k in lengths.items()) / count)


def distinct_share(words: list[str], window: int = 400) -> float:
    """Share of distinct words within consecutive windows over all words, so that it doesn't fall with a text's length."""
    return sum(len(set(words[k : k + window])) for k in range(0, len(words), window)) / max(len(words), 1)


def masses(blocks: list[list[Line]], lexicon: Lexicon) -> list[float]:
    """Shares of a text's characters in runs of lines with a property, in the order of FEATURES.

    A line that the text has three times or more tells nothing new in the blocks behind the first that holds it: there
    it counts as characters, but has none of the properties.
    """
    total = 0
    sums = [0] * len(FEATURES)
    seen = Counter(x.text.strip() for block in blocks for x in block)
    counted: set[str] = set()
    for block in blocks:
        total += sum(len(x.text) for x in block)
        fresh = [x for x in block if seen[x.text.strip()] < 3 or x.text.strip() not in counted]
        counted.update(x.text.strip() for x in block)
        for run in runs(fresh):
            size = sum(len(x.text) for x in run)
            words = [w for x in run for w in x.said[0]]
            n, tokens = max(len(words), 1), max(sum(x.said[1] for x in run), 1)
            lengths = Counter(map(len, words))
            short = sum(k for x, k in lengths.items() if x <= 3) / n
            holds = (
                0.2 <= short <= 0.65 and moments(lengths)[1] >= 1.7,  # short words between longer ones, as in any language
                sum(map(lexicon.by.__contains__, words)) >= 0.15 * n,
                sum(x.said[2] for x in run) >= 0.7 * tokens,
                item(run[0]),
                len(run) >= 3 and n < 4.5 * len(run) and sum(x.capital for x in run) > 0.5 * len(run),  # lines of wrapped text go on
                len(words) >= 8,
                len(set(words)) >= 0.4 * min(n, 60),
            )
            for i, h in enumerate(holds):
                sums[i] += size * h
            sums[-1] += sum(len(x.text) for x in run if x.cut and x.words < 6)
    return [x / max(total, 1) for x in sums]


def statistics(text: str | None, lexicon: Lexicon) -> tuple:
    """The statistics of a text in the order of STATISTICS; blank texts have zeros and no language."""
    text = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    infos = {x: line_of(x) for x in set(text.split("\n")) if x.strip()}
    blocks = [[infos[x] for x in block.split("\n") if x in infos] for block in BLANK.split(text)]
    lines = [x for block in blocks for x in block]
    words = [w for x in lines for w in x.low]
    dense = "".join(text.split())
    n, size, count = max(len(lines), 1), max(len(dense), 1), max(len(words), 1)
    chars = Counter(dense)
    of = lambda f: sum(k for c, k in chars.items() if f(c))
    letters, digits = of(str.isalpha), of(str.isdigit)
    lengths = Counter(map(len, words))
    mean, spread_of_lengths = moments(lengths)
    lang, common = lexicon.language(words)
    junk = of(lambda c: not c.isprintable() or c in "\ufffd¶¤" or 0x80 <= ord(c) < 0xC0)
    return (
        len(text), len(words), len(lines), mean, spread_of_lengths,
        (len(dense) - letters - digits) / size, digits / size, letters / size, of(str.isupper) / max(letters, 1),
        sum(x.ended for x in lines) / n, sum(x.bullet for x in lines) / n, sum(x.cut for x in lines) / n,
        len(words) / n, sum(x.words < 4 for x in lines) / n, common, sum(k for x, k in lengths.items() if x <= 3) / count,
        len({x.text.strip() for x in lines}) / n, distinct_share(words), sum(x.code for x in lines) / n,
        sum(x.lettered for x in lines) / max(sum(x.tokens for x in lines), 1), junk / size, *masses(blocks, lexicon), lang,
    )


def item(x: Line) -> bool:
    """Whether a line is an entry of a list, code or the like."""
    return x.bullet or x.code and x.words < 12


def runs(lines: list[Line]) -> Iterator[list[Line]]:
    """A block's lines in runs of one kind: items of lists, code and the like, apart from text between them."""
    run: list[Line] = []
    kind = None
    for x in lines:
        k = "bullet" if x.bullet else item(x)
        if run and k != kind:
            yield run
            run = []
        kind = k
        run.append(x)
    if run:
        yield run


# ---- weak labels ----


def weak_labels(x: pd.DataFrame) -> np.ndarray:
    """1 junk, 0 prose, -1 where the rules are silent or are not two votes apart.

    The rules look at single statistics of the whole document and at no feature of the trees. Lines that break off are
    made of words as prose is, so that this vote outweighs those for its words.
    """
    junk = (
        5 * (x.cut_share >= 0.5).astype(int) + 2 * ((x.short_word_share < 0.1) | (x.n_words < 3)) + (x.word_spread < 1.4) + (x.symbol_ratio >= 0.2) + (x.digit_ratio >= 0.15) + (x.bullet_share >= 0.6)
        + (x.code_line_share >= 0.6) + (x.distinct_line_share <= 0.5) + (x.mean_line_words < 3.5) + (x.common_share < 0.12) + (x.plain_token_share < 0.5) + (x.letter_ratio < 0.75) + (x.junk_char_ratio > 0.1)
    )
    prose = (
        (x.common_share >= 0.3).astype(int) + (x.plain_token_share >= 0.85) + (x.mean_line_words >= 8) + x.word_spread.between(1.7, 3.5) + x.short_word_share.between(0.25, 0.65)
    )
    return np.where((junk >= 2) & (junk >= prose + 2), 1, np.where((prose >= 3) & (prose >= junk + 2), 0, -1))


# ---- gradient-boosted trees ----


class Trees:
    """Boosted regression trees for the logistic loss on binned features."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, leaf: int = LEAF):
        self.trees, self.depth, self.rate, self.bins, self.leaf = trees, depth, rate, bins, leaf
        self.edges: list[np.ndarray] = []
        self.model: list[list[tuple]] = []
        self.start, self.a, self.b = 0.0, 1.0, 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)])

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        # quantiles, and even steps where a feature has few values between its extremes
        steps = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.r_[np.quantile(v, steps), v.min() + (v.max() - v.min()) * steps[1::2]]) for v in x.T]
        b = self.binned(x)
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = math.log(p / (1 - p))
        score = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree, value = self._grow(b, y - p, p * (1 - p))
            self.model.append(tree)
            score += self.rate * value
        return self

    def _grow(self, b, g, h):
        tree, value = [], np.zeros(len(g))
        todo = [(np.arange(len(g)), 0, 0)]
        nodes = {}
        while todo:
            rows, at, depth = todo.pop()
            best = (1e-6, None, None)
            if depth < self.depth and len(rows) >= 2 * self.leaf:
                whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
                for j in range(b.shape[1]):
                    n = len(self.edges[j]) + 1
                    cg = np.cumsum(np.bincount(b[rows, j], g[rows], n))[:-1]
                    ch = np.cumsum(np.bincount(b[rows, j], h[rows], n))[:-1]
                    cn = np.cumsum(np.bincount(b[rows, j], minlength=n))[:-1]
                    gain = cg**2 / (ch + 1) + (g[rows].sum() - cg) ** 2 / (h[rows].sum() - ch + 1) - whole
                    gain = np.where((cn >= self.leaf) & (len(rows) - cn >= self.leaf), gain, -1)
                    if len(gain) and gain.max() > best[0]:
                        same = np.flatnonzero(gain >= gain.max() - 1e-9)
                        best = (gain.max(), j, int(same[len(same) // 2]))  # the middle of a gap
            if best[1] is None:
                v = g[rows].sum() / (h[rows].sum() + 1)
                value[rows] = v
                nodes[at] = (-1, 0, v)
            else:
                left = b[rows, best[1]] <= best[2]
                nodes[at] = (best[1], best[2], 0.0)
                todo += [(rows[left], 2 * at + 1, depth + 1), (rows[~left], 2 * at + 2, depth + 1)]
        return nodes, value

    def raw(self, x: np.ndarray) -> np.ndarray:
        if not self.edges:
            return np.zeros(len(x))
        b = self.binned(x)
        score = np.full(len(x), self.start)
        for nodes in self.model:
            at = np.zeros(len(x), dtype=int)
            for _ in range(self.depth + 1):
                for node in np.unique(at):
                    j, cut_at, _v = nodes[node]
                    if j >= 0:
                        here = at == node
                        at[here] = np.where(b[here, j] <= cut_at, 2 * node + 1, 2 * node + 2)
            score += self.rate * np.array([nodes[a][2] for a in at])
        return score

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """Platt's scaling of the scores on a holdout: a logistic curve by Newton's steps, smoothed targets."""
        s = self.raw(x)
        pos, neg = y.sum(), len(y) - y.sum()
        t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
        a, b = 1.0, 0.0
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a * s + b, -50, 50)))
            w = np.maximum(p * (1 - p), 1e-6)
            # a weak pull to the uncalibrated scores keeps the curve finite where the holdout is separable
            m = np.array([[(w * s * s).sum() + 1, (w * s).sum()], [(w * s).sum(), w.sum() + 1]])
            step = np.linalg.solve(m, np.array([((t - p) * s).sum() - (a - 1), (t - p).sum() - b]))
            step = np.clip(step, -0.5, 0.5)
            a, b = a + step[0], b + step[1]
            if abs(step).max() < 1e-8:
                break
        self.a, self.b = max(a, 1e-3), b
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.raw(x) + self.b, -50, 50)))


def matrix(x: pd.DataFrame) -> np.ndarray:
    return x[FEATURES].to_numpy(dtype=float)


def described(texts: list[tuple[str, bool]], lexicon: Lexicon) -> tuple[pd.DataFrame, np.ndarray]:
    """Statistics of labelled texts (text, whether it is prose), and 1 for junk."""
    return pd.DataFrame([statistics(t, lexicon) for t, _ in texts], columns=NAMES), np.array([int(not prose) for _, prose in texts])


def train(sample: pd.DataFrame, lexicon: Lexicon) -> Trees:
    """Fit on the sample's weak labels and on the seeds, calibrate on the holdout, which never trains.

    The seeds are texts by the author of the rules, of kinds that a small corpus may lack. Prose trains a
    second time as if its language had no dictionary, for prose in other languages is prose.
    """
    y = weak_labels(sample) if len(sample) else np.array([], dtype=int)
    x, y = sample[y >= 0] if len(sample) else sample, y[y >= 0]
    seeds, truth = described(SEEDS, lexicon)
    x, y = pd.concat([x, seeds], ignore_index=True), np.concatenate([y, truth])
    held, truth = described(HOLDOUT, lexicon)
    x, y = pd.concat([x, x[y == 0].assign(common_mass=0.0)], ignore_index=True), np.concatenate([y, y[y == 0]])
    return Trees().fit(matrix(x), y.astype(float)).calibrate(matrix(held), truth)


# ---- operators ----


#: Frequent words that the dictionary may hold; it travels to every task.
DICTIONARY = 50_000


def lexicon_of(common_words: DataFrame) -> Lexicon:
    """The frequent words, a dictionary of a few hundred per language; one beyond the bound is refused, never cut."""
    rows = common_words.select("lang", "word").where("lang IS NOT NULL AND word IS NOT NULL").distinct().limit(DICTIONARY + 1).collect()
    if len(rows) > DICTIONARY:
        raise ValueError(f"a dictionary of more than {DICTIONARY} frequent words")
    return Lexicon([(r.lang, r.word) for r in rows])


def document_statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """Rows (doc_id, ...STATISTICS) for every document; repeated doc_ids count once, nulls are blank texts."""
    lexicon = lexicon_of(common_words)

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(i, *statistics(t, lexicon)) for i, t in zip(frame.doc_id, frame.text)], columns=["doc_id", *NAMES])

    return spread(documents.select("doc_id", "text"), "doc_id").dropDuplicates(["doc_id"]).mapInPandas(f, f"doc_id long, {STATISTICS}")


def classify(documents: DataFrame, common_words: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The statistics of every document with junk_probability and not_prose (blank, or probability above one half)."""
    lexicon = lexicon_of(common_words)
    s = cut(document_statistics(documents, common_words))
    rows = s.where("n_words > 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toPandas()
    model = train(rows, lexicon)

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            p = model.probability(matrix(frame)) if len(frame) else np.array([])
            yield frame.assign(junk_probability=p, not_prose=(p > 0.5) | (frame.n_words == 0))

    return s.mapInPandas(f, f"doc_id long, {STATISTICS}, junk_probability double, not_prose boolean")
