"""Variant spellings of names typed by people, brought together per person or organisation.

Names are folded (case, accents, damaged encodings, titles, remarks, nicknames, legal forms) to keys of full
tokens. Similar keys are found by a *trie join*: keys are sharded by an exact half, every shard's keys form a
trie, and each key traverses it with a Levenshtein automaton that also knows transpositions, in all orders of
its tokens. Mails add evidence where they belong to one person; whether they do is judged from the names seen
with them. Spellings with too little in them for a key (initials, handles) join the one person they can stand
for, and nobody if there are several.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations, islice, permutations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..session import cut, spread, width

# Common short forms of first names.
NICKNAMES = {
    "abby": "abigail", "al": "albert", "alex": "alexander", "sasha": "alexander", "lex": "alexander", "andy": "andrew", "tony": "anthony", "ben": "benjamin", "benny": "benjamin",
    "bill": "william", "billy": "william", "will": "william", "liam": "william", "bob": "robert", "bobby": "robert", "rob": "robert", "bert": "robert", "cathy": "catherine",
    "charlie": "charles", "chuck": "charles", "chris": "christopher", "kit": "christopher", "dan": "daniel", "danny": "daniel", "dave": "david", "dick": "richard",
    "rick": "richard", "dima": "dmitri", "mitya": "dmitri", "don": "donald", "ed": "edward", "eddie": "edward", "ted": "edward", "ned": "edward", "beth": "elizabeth", "betty": "elizabeth",
    "liz": "elizabeth", "eliza": "elizabeth", "lisa": "elizabeth", "lizzie": "elizabeth", "fred": "frederick", "freddy": "frederick", "fritz": "frederick", "gabi": "gabriela", "gabby": "gabriela",
    "gid": "gideon", "greg": "gregory", "harry": "henry", "hank": "henry", "heiner": "heinrich", "heinz": "heinrich", "nacho": "ignacio", "jack": "john", "jim": "james", "jimmy": "james",
    "jo": "josephine", "josie": "josephine", "joe": "joseph", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kat": "katherine", "ken": "kenneth", "larry": "lawrence", "len": "leonard",
    "leo": "leonard", "lenny": "leonard", "liv": "olivia", "livvy": "olivia", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "greta": "margaret", "rita": "margaret", "matt": "matthew",
    "mike": "michael", "mick": "michael", "mickey": "michael", "mina": "wilhelmina", "minna": "wilhelmina", "willa": "wilhelmina", "nick": "nicholas", "nicky": "nicholas", "klaus": "nicholas",
    "pat": "patricia", "patty": "patricia", "trish": "patricia", "tricia": "patricia", "penny": "penelope", "pete": "peter", "quin": "quentin", "raph": "raphael", "raf": "raphael", "rafa": "raphael", "ray": "raymond", "ron": "ronald",
    "sam": "samuel", "sammy": "samuel", "steve": "stephen", "sue": "susan", "tom": "thomas", "tommy": "thomas", "tim": "timothy", "ulli": "ulrike", "uli": "ulrike", "rike": "ulrike",
    "vic": "victoria", "vicky": "victoria", "tori": "victoria", "vince": "vincent", "vinnie": "vincent", "zhenya": "yevgenia", "zenya": "yevgenia", "jenya": "yevgenia", "zach": "zachary", "zack": "zachary", "zak": "zachary",
}
# Words around a name that don't belong to it.
TITLES = frozenset("dr prof professor mr mrs ms miss sir herr frau ing dipl phd msc bsc md jr sr ii iii".split())
LEGAL = frozenset("gmbh inc ltd ag sa llc plc co corp corporation limited company the team kg ohg se spa srl bv nv oy ab as pty".split())
# Short forms in names of organisations.
SHORT = {"cons": "consulting", "sw": "software", "soft": "software", "sys": "systems", "tech": "technologies", "techn": "technologies", "anal": "analytics", "anlt": "analytics", "analyt": "analytics", "intl": "international"}
# Local parts of mails that name a role.
ROLES = frozenset("noreply no-reply builds build ci bot bots dev devs team dev-team developers admin info root oss support contact hello office mail git github gitlab nobody unknown users user test postmaster webmaster".split())

#: Tokens of a name that handles are made of, any two of them, at most; what has more is a sentence rather than a name.
TOKENS = 12

#: Names of which one shard may hold before it is divided further.
SHARD = 2000


def fold(s: str) -> str:
    """Lower case without accents; damaged encodings repaired."""
    for _ in range(2):
        try:
            fixed = s.encode("latin-1").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            try:
                fixed = s.encode("cp1252").decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                break
        if fixed == s:
            break
        s = fixed
    s = unicodedata.normalize("NFKD", s.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("Ł", "L"))
    return "".join(c for c in s if not unicodedata.combining(c)).lower()


def plain(w: str) -> str:
    """A folded token in its canonical form."""
    return NICKNAMES.get(w, SHORT.get(w, w))


def tokens(name: str | None) -> list[str]:
    """Canonical tokens of a name in the order typed; remarks, quoted nicknames, titles and legal forms are dropped."""
    s = re.sub(r"\([^)]*\)|\[[^\]]*\]|[\"“„«][^\"”“»]*[\"”“»]|'[^']{2,}'(?=\s)", " ", name or "")
    s = re.sub(r"\bs\.\s?a\.?(?=\W|$)|\bs\.p\.a\b|\bb\.v\b", " ", fold(s))
    words = [w for w in re.split(r"[\s,;._\-/|+&]+", s) if w]
    words = [re.sub(r"[^\w']", "", w).replace("'", "") for w in words]
    kept = [w for w in words if w and w not in TITLES and w not in LEGAL]
    return [plain(w) for w in kept]


def key(name: str | None) -> str | None:
    """The name's full tokens, sorted; None if it has less than two of them or is a handle."""
    t = [w for w in tokens(name) if len(w) > 1 and not w.isdigit()]
    if len(t) < 2 or all(len(w) < 3 for w in t) or (len(t) == 2 and min(map(len, t)) < 2):
        return None
    # two letters of initials beside a legal form or a surname are no token of a name
    t = [w for w in t if len(w) > 2 or len(t) > 2] if sum(len(w) > 2 for w in t) >= 2 else t
    if sum(len(w) > 2 for w in t) < 2 and not (len(t) == 2 and name and not re.search(r"\b[A-Z]{2}\b", name)):
        return None
    return " ".join(sorted(t)) if len(t) >= 2 else None


def local_part(mail: str | None) -> str | None:
    """The local part of a mail without numbers around it; None for roles and missing mails."""
    if not mail or "@" not in mail:
        return None
    local = fold(mail.split("@")[0])
    local = re.sub(r"^\d+\+", "", local)
    local = re.sub(r"\d+$", "", local).strip("._-+")
    return None if local in ROLES or all(p in ROLES for p in re.split(r"[._\-+]", local)) or len(local) < 3 else local


def mail_key(mail: str | None) -> str | None:
    """The key of a mail whose local part spells a first name and a surname apart."""
    local = local_part(mail)
    if local is None or not re.search(r"[._\-]", local):
        return None
    return key(local)


def near(a: str, b: str) -> bool:
    """Whether one edit (or exchange of neighbours) at most leads from a to b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def fits(weak: list[str], full: list[str]) -> bool:
    """Whether a name's tokens can be short, wrong or partial forms of different tokens of a full one."""

    def within(w: str, f: str) -> bool:
        letters = iter(f)
        return len(f) > len(w) + 2 and w[0] == f[0] and all(c in letters for c in w)

    def one(w: str, f: str) -> bool:
        return w == f or len(w) > 2 and within(w, f) or len(w) == 1 and f.startswith(w) or len(w) > 3 and near(w, f) or len(w) > 2 and f.startswith(w) or len(w) > 5 and len(f) > 5 and w[:3] == f[:3] and abs(len(w) - len(f)) < 3 and sum(a == b for a, b in zip(w[::-1], f[::-1])) >= len(f) - 5

    if not weak or len(weak) > len(full):
        return False
    return any(all(one(w, f) for w, f in zip(weak, p)) for p in permutations(full, len(weak)))


def compatible(a: str, b: str) -> bool:
    """Whether two names can be of one person: their tokens, initials or joined handles fit."""
    ta, tb = tokens(a), tokens(b)
    if not ta or not tb:
        return False
    la, lb = [x for x in ta if len(x) > 1] or ta, [x for x in tb if len(x) > 1] or tb
    if fits(ta, tb) or fits(tb, ta) or fits(la, lb) or fits(lb, la):
        return True
    for x, y in ((ta, tb), (tb, ta)):
        joined = "".join(x)
        # initials, or a handle of letters only
        if 2 <= len(y) <= TOKENS:
            if len(joined) <= 4 and sorted(joined)[: len(y)] == sorted(w[0] for w in y):
                return True
            if len(joined) <= 4 and "".join(w[0] for w in y) in (joined, joined[::-1]):
                return True
            if joined in handles(" ".join(y)):
                return True
    return False


def handles(k: str) -> set[str]:
    """Handles of letters only that a full key can stand behind."""
    t = [w for w in k.split(" ") if len(w) > 1]
    out = set()
    for f, s in permutations(t, 2) if len(t) <= TOKENS else ():
        out |= {f + s, f[0] + s, s + f[0], f + s[:4], f + s[0], f"{f[0]}|{s}", f"{f}|{s[0]}"}
    # initials of an organisation that owns the mail's domain
    initials = "".join(sorted(w[0] for w in t))
    out |= {f"@{w}|{initials}" for w in t}
    return out


def weak_handles(name: str | None, mail: str | None) -> list[str]:
    """Handles that a spelling without a key offers."""
    out = []
    t = tokens(name)
    if len(t) == 1 and len(t[0]) >= 6:
        out.append(t[0])
    long = [w for w in t if len(w) > 1]
    short = [w for w in t if len(w) == 1]
    if len(long) == 1 and len(short) == 1:
        out.append(f"{short[0]}|{long[0]}")
        if len(long[0]) > 2:
            out.append(f"{long[0]}|{short[0]}")
    if len(t) == 1 and 2 <= len(t[0]) <= 4 and mail and "@" in mail:
        out.append(f"@{fold(mail.split('@')[1].split('.')[0])}|{''.join(sorted(t[0]))}")
    local = local_part(mail)
    if local and re.fullmatch(r"[a-z]{6,}", local):
        out.append(local)
    return out


# ---- trie join ----


def halves(rest: str, n: int) -> tuple[tuple[str, str], tuple[str, str]]:
    """(name of the part, what is left) for both halves of a string that is compared with strings of n characters or one more.

    One edit can't touch both halves of a string (an exchange across the middle touches the ends of both, so
    the halves leave out a character there), and what is left of two strings that agree in a half is within one edit again.
    """
    h = max((n - 1) // 2, 1)
    return (f"<{rest[:h]}", rest[h:]), (f">{rest[len(rest) - h :]}", rest[: len(rest) - h])


def shards(s: str) -> list[tuple[str, str, int]]:
    """(name, rest, length of the shorter rest) of the shards of a string. Two strings within one edit meet in one at least.

    The shorter string's length decides where the halves end.
    """
    return [(f"{n}{part}", rest, n - max((n - 1) // 2, 1)) for n in sorted({len(s), len(s) - 1}) for part, rest in halves(s, n)]


def trie(words: list[str]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node.setdefault("", []).append(w)
    return root


def neighbours(root: dict, word: str, k: int = 1) -> Iterator[str]:
    """Words of the trie within k edits of a word (exchanges of neighbours count one), by running its
    Levenshtein automaton along the trie; a state is a row of distances, and dead states end the branch."""
    n = len(word)
    start = tuple(range(n + 1))
    stack = [(root, start, None, "")]
    while stack:
        node, row, before, last = stack.pop()
        for c, child in node.items():
            if c == "":
                if row[n] <= k:
                    yield from child
                continue
            new = [row[0] + 1]
            for i in range(1, n + 1):
                d = min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (word[i - 1] != c))
                if before is not None and i > 1 and word[i - 1] == last and word[i - 2] == c:
                    d = min(d, before[i - 2] + 1)
                new.append(d)
            if min(new) <= k or min(row) <= k:
                stack.append((child, tuple(new), row, c))


def _orders(k: str) -> set[str]:
    """Orders of a key's tokens: all of up to four; of more, every two tokens side by side in every place of the rest.

    That is enough for one edit: it changes a token, which moves that alone, or joins or parts two neighbours.
    """
    t = k.split(" ")
    if len(t) <= 4:
        return {" ".join(p) for p in permutations(t)}
    out = {k}
    for i, j in permutations(range(len(t)), 2):
        rest = [w for n, w in enumerate(t) if n not in (i, j)]
        out |= {" ".join([*rest[:n], t[i], t[j], *rest[n:]]) for n in range(len(rest) + 1)}
    return out


def enough(a: str, b: str, least: int) -> bool:
    """Whether keys within one edit hold enough to be similar; short ones need an equal token and no changed one of two letters."""
    if min(len(a), len(b)) >= least:
        return True
    x, y = a.split(" "), b.split(" ")
    return not set(x).isdisjoint(y) and all(len(w) > 2 for w in set(x) ^ set(y))


_SHARD = "shard string, rest string, n int, typed string, k string, asks boolean"


def _shard_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [(*x, o, k, o == k) for k in frame.k for o in _orders(k) for x in set(shards(o))]
        yield pd.DataFrame(rows, columns=["shard", "rest", "n", "typed", "k", "asks"])


def _divided(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [
            (f"{shard}\x01{part}", left, n - max((n - 1) // 2, 1), typed, k, asks)
            for shard, rest, n, typed, k, asks in f.itertuples(index=False)
            for part, left in halves(rest, n)
        ]
        yield pd.DataFrame(rows, columns=["shard", "rest", "n", "typed", "k", "asks"])


def _join_shard(frame: pd.DataFrame, least: int) -> pd.DataFrame:
    owner: dict[str, set[str]] = {}
    for typed, k in zip(frame.typed, frame.k):
        owner.setdefault(typed, set()).add(k)
    root = trie(sorted(owner))
    out = set()
    for k, asks in zip(frame.k, frame.asks):
        if asks:
            for typed in neighbours(root, k):
                out |= {(min(k, o), max(k, o)) for o in owner[typed] if o != k and enough(k, o, least)}
    return pd.DataFrame(sorted(out), columns=["a", "b"])


def similar_keys(keys: DataFrame, least: int = 9, shard: int = SHARD) -> DataFrame:
    """Pairs (a < b) of different keys, one of them within one edit of some order of the other's tokens.

    keys: one column k, distinct. Keys shorter than `least` characters are similar by chance more easily, and pair
    only if a token is equal and the others have three letters at least. A shard of more than `shard` entries is divided by
    halves of what is left, again and again, which loses no pair, so no task holds an unbounded group: what can't be divided
    any further differs in three characters at most.
    """
    # the rows are kept, for they are counted, joined and perhaps divided
    rows = cut(keys.mapInPandas(_shard_rows, _SHARD))
    cold = None
    while True:
        size = rows.groupBy("shard", "n").count().where("count > 1")
        hot = size.where((F.col("count") > shard) & (F.col("n") > 2)).select("shard")
        some = not hot.isEmpty()
        now = rows.join(size.where((F.col("count") <= shard) | (F.col("n") <= 2)).select("shard") if some else size.select("shard"), "shard", "left_semi")
        cold = now if cold is None else cold.unionByName(now)
        if not some:
            break
        rows = cut(rows.join(hot, "shard", "left_semi").mapInPandas(_divided, _SHARD))
    # few bytes, but much work: a set number of tasks, which isn't coalesced by size. One more than the joins before have, for
    # else the planner takes their partitions, which it does coalesce, and leaves this exchange out.
    both = spread(cold.select("shard", "typed", "k", "asks"), "shard", n=width(keys.sparkSession) + 1)
    pairs = both.groupBy("shard").applyInPandas(lambda frame: _join_shard(frame, least), "a string, b string")
    return pairs.distinct()


# ---- entities ----


def _mentions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for name, mail in zip(f["name"], f["email"]):
            k, m = key(name), mail_key(mail)
            if m is not None and not (name and compatible(name, m)):
                m = None
            rows.append((name, mail, f"{name or ''}\x01{mail or ''}", k, m, [] if k or m else weak_handles(name, mail)))
        yield pd.DataFrame(rows, columns=["name", "email", "row", "k", "mk", "weak"])


def _handle_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame([(c, h) for c, k in zip(f.component, f.k) for h in handles(k)], columns=["component", "handle"])


def blocks(name: str) -> tuple[set[str], set[str]]:
    """(blocks a name asks in, blocks it stands in). If two names are compatible, one asks where the other stands.

    The shorter of two names that fit has all its tokens matched: so has any one of them, or any two. Tokens that
    match begin with the same letter, or differ in their first letters only. Initials and joined handles are looked
    up as they are.
    """

    def marks(w: str) -> set[str]:
        return {w[0], *(f"-{w[k:]}" for k in range(3) if len(w) > 2)}

    asks: set[str] = set()
    stands: set[str] = set()
    t = tokens(name)
    if not t:
        return asks, stands
    for ws in (t, [w for w in t if len(w) > 1] or t):
        a = sorted(ws, key=len)[-2:]
        asks |= marks(a[0]) if len(a) == 1 else {"&".join(sorted((x, y))) for x in marks(a[0]) for y in marks(a[1])}
        stands |= {x for w in ws for x in marks(w)}
        stands |= {"&".join(sorted((x, y))) for v, w in combinations(ws, 2) for x in marks(v) for y in marks(w)}
    joined = "".join(t)
    asks |= {f"={joined}", *("*" + "".join(sorted(joined)[:k]) for k in range(2, 5) if len(joined) <= 4)}
    if 2 <= len(t) <= TOKENS:
        stands |= {"*" + "".join(sorted(w[0] for w in t)), *(f"={h}" for h in handles(" ".join(t)))}
    return asks, stands


class Blocks:
    """Names in groups; a name is compared with those of its blocks only, which loses none that fits."""

    def __init__(self) -> None:
        self.groups: list[list[str]] = []
        self.asked: dict[str, list[tuple[int, str]]] = {}
        self.stood: dict[str, list[tuple[int, str]]] = {}

    def fitting(self, name: str) -> Iterator[int]:
        """Numbers of the groups that hold a compatible name, rising."""
        asks, stands = blocks(name)
        near_by = {x for b in asks for x in self.stood.get(b, ())} | {x for b in stands for x in self.asked.get(b, ())}
        last = -1
        for i, x in sorted(near_by):
            if i > last and compatible(name, x):
                last = i
                yield i

    def add(self, name: str) -> None:
        """To the first group with a compatible name, or to a new one."""
        i = next(self.fitting(name), len(self.groups))
        if i == len(self.groups):
            self.groups.append([])
        self.groups[i].append(name)
        asks, stands = blocks(name)
        for b in asks:
            self.asked.setdefault(b, []).append((i, name))
        for b in stands:
            self.stood.setdefault(b, []).append((i, name))


def _mail_groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per mail: rows get the number of the group of fitting names they belong to.

    The only group of a mail has the number 0, as the mail's rows without a name have; several count from 1.
    """
    for f in frames:
        out = []
        for mail, people in zip(f.email, f.people):
            full = sorted(p["sample"] for p in people if p["full"]) or sorted((p["sample"] for p in people), key=lambda x: (-len(x), x))
            some = any(p["full"] for p in people)
            known = Blocks()
            for s in full:
                known.add(s)
            groups = known.groups
            first = int(len(groups) > 1)
            single = {s: first + i for i, g in enumerate(groups) for s in g}
            for p in people:
                if p["full"] or not some:
                    out.append((mail, p["who"], single[p["sample"]]))
                    continue
                fit = list(islice(known.fitting(p["sample"]), 2))
                if len(groups) <= 1:
                    # a mail of one person only: short forms are theirs if they can be
                    if fit or len("".join(tokens(p["sample"]))) <= 3:
                        out.append((mail, p["who"], 0))
                elif len(fit) == 1:
                    out.append((mail, p["who"], first + fit[0]))
        yield pd.DataFrame(out, columns=["email", "who", "grp"])


def entities(mentions: DataFrame) -> DataFrame:
    """Rows (name, email, entity): one class per person or organisation for every spelling.

    mentions: name, email; repeated rows count once. A mention without name and mail is a class of its own; a
    null name is told by its mail, a null mail adds nothing. A mail belongs to one person if the full names
    seen with it fit each other; else it links only what fits. Namesakes by surname stay apart.
    """
    m = cut(mentions.select("name", "email").distinct().mapInPandas(_mentions, "name string, email string, row string, k string, mk string, weak array<string>"))
    typed = m.select("k").union(m.select("mk")).where("k IS NOT NULL").distinct()
    # a transcribed umlaut and its vowel are one spelling; either may hold a typing error besides
    folded = typed.select(F.col("k").alias("a"), F.regexp_replace("k", "([uo])e", "$1").alias("b")).where("a <> b")
    keys = typed.union(folded.select("b")).distinct()
    pairs = cut(similar_keys(keys).union(folded))
    spelled = connected_components(pairs.union(keys.select(F.col("k").alias("a"), F.col("k").alias("b")))).select(F.col("node").alias("k"), F.col("component").alias("who"))
    # persons per mail: full names by the class of their key, others by themselves
    seen = (
        m.where("email IS NOT NULL AND name IS NOT NULL")
        .join(spelled, "k", "left")
        .select("email", F.coalesce(F.concat(F.lit("K"), "who"), F.concat(F.lit("W"), "row")).alias("who"), F.col("who").isNotNull().alias("full"), "name", "row")
    )
    person = seen.groupBy("email", "who", "full").agg(F.min("name").alias("sample"))
    groups = (
        person.groupBy("email").agg(F.collect_list(F.struct("who", "full", "sample")).alias("people")).mapInPandas(_mail_groups, "email string, who string, grp int")
    )
    by_mail = seen.join(groups, ["email", "who"]).select(F.concat(F.lit("R"), "row").alias("a"), F.concat_ws("\x01", F.lit("M"), "email", F.col("grp").cast("string")).alias("b"))
    r = F.concat(F.lit("R"), "row").alias("a")
    nameless = m.where("name IS NULL AND email IS NOT NULL").select(r, F.concat(F.lit("M"), F.lit("\x01"), "email", F.lit("\x01"), F.lit("0")).alias("b"))
    by_key = m.where("k IS NOT NULL").join(spelled, "k").select(r, F.concat(F.lit("K"), "who").alias("b"))
    by_mail_key = m.where("mk IS NOT NULL").join(spelled.withColumnRenamed("k", "mk"), "mk").select(r, F.concat(F.lit("K"), "who").alias("b"))
    alone = m.select(r, r.alias("b"))
    first = cut(connected_components(cut(by_key.union(by_mail_key).union(by_mail).union(nameless).union(alone))))
    component = m.join(first, F.concat(F.lit("R"), "row") == F.col("node")).select("name", "email", "row", "k", "mk", "weak", "component")
    component = cut(component)
    # what has no full name yet joins the only person that its handles can stand for
    strong = component.where("k IS NOT NULL OR mk IS NOT NULL").select("component", F.coalesce("k", "mk").alias("k")).distinct()
    known = strong.mapInPandas(_handle_rows, "component string, handle string").distinct()
    weak = (
        component.join(strong.select("component").distinct(), "component", "left_anti")
        .select(F.col("component").alias("weak_component"), F.explode("weak").alias("handle"))
        .distinct()
    )
    target = (
        weak.join(known, "handle")
        .groupBy("weak_component")
        .agg(F.countDistinct("component").alias("n"), F.min("component").alias("target"))
        .where("n = 1")
        .select(F.col("weak_component").alias("component"), "target")
    )
    return component.join(target, "component", "left").select("name", "email", F.coalesce("target", "component").alias("entity"))


def expert_entities(experts: DataFrame, commits: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Rows (expert_id, entity), one per expert_id; entity names the class.

    experts: expert_id, name, email. Commit authors (author_name, author_email) and the contributors of nodes
    take part as further spellings, through which experts can be linked. Null expert_ids are left out.
    """
    e = experts.select("expert_id", "name", "email").where("expert_id IS NOT NULL").distinct()
    all_mentions = e.select("name", "email")
    if commits is not None:
        all_mentions = all_mentions.union(commits.select("author_name", "author_email").distinct())
    if nodes is not None:
        all_mentions = all_mentions.union(nodes.select(F.explode("contributors").alias("name")).distinct().select("name", F.lit(None).cast("string")))
    blank = lambda c: F.when(F.trim(c) != "", F.col(c))
    known = entities(all_mentions.select(blank("name").alias("name"), blank("email").alias("email")))
    x, y = e.select("expert_id", blank("name").alias("name"), blank("email").alias("email")).alias("x"), known.alias("y")
    joined = x.join(y, F.col("x.name").eqNullSafe(F.col("y.name")) & F.col("x.email").eqNullSafe(F.col("y.email")))
    # rows of nobody in particular are nobody's doubles
    entity = F.when(F.col("x.name").isNull() & F.col("x.email").isNull(), F.concat(F.lit("id"), F.col("x.expert_id").cast("string"))).otherwise(F.col("y.entity"))
    return joined.groupBy("x.expert_id").agg(F.min(entity).alias("entity"))


def entity_classes(members: DataFrame) -> DataFrame:
    """Rows (expert_id, entity, links): links counts the other expert_ids of the class."""
    size = members.groupBy("entity").agg((F.count("*") - 1).alias("links"))
    return members.join(size, "entity").select("expert_id", "entity", "links")


def entity_pairs(members: DataFrame) -> DataFrame:
    """All pairs (expert_id_a < expert_id_b) within the classes."""
    a, b = members.select("entity", F.col("expert_id").alias("expert_id_a")), members.select("entity", F.col("expert_id").alias("expert_id_b"))
    return a.join(b, "entity").where("expert_id_a < expert_id_b").select("expert_id_a", "expert_id_b")
