"""Texts packed into containers of a fixed number of tokens.

Vector best fit: an item and the room left in a container are vectors of tokens, documents and attention cost
(the sum of squared lengths, which is what attention within documents costs). Items come in order of falling
size; of the containers that can take an item under every constraint it goes to the one whose weighted
residual is smallest afterwards, and to a new one if there is none.

Groups of a bounded number of items are packed in parallel. Containers that came out all but full by any capacity are
final; the rest are opened again and their items packed together in fewer groups, until one group is left or a
round leaves nearly all its items over. Only texts larger than a container are split, into full pieces and a rest.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread

#: Folder of the public vocabularies.
TOKENIZERS = "/opt/tokenizers"
#: How the byte-level vocabularies split text before merging (fixed value of their format).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Container:
    """Capacities of a container, and how the packing goes about it."""

    tokens: int = 2048
    documents: int = 256
    attention: float = 1.0  # of the cost of one text that fills the container
    weights: tuple[float, float, float] = (1.0, 0.05, 0.1)  # of the residuals of tokens, documents, attention
    group: int = 20_000  # items that are packed in one task, at most
    full: float = 0.998  # share of any capacity from which a container is final
    shrink: float = 0.9  # share of its items, at most, that a round may leave over for another one to be worth it


def token_counter(path: str):
    """text -> number of tokens, for a vocabulary file of ranks (.tiktoken), merges (.json) or pieces (.model)."""
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(encoding.encode_ordinary(text))
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda text: len(t.encode(text, add_special_tokens=False).ids)
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: len(s.encode(text, num_threads=1))


def sizes(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Rows (doc_id, tokens) of the whole texts; repeated doc_ids count once, null texts have no tokens."""
    path = tokenizer or os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = token_counter(path)
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame.doc_id, "tokens": [count(t) if t else 0 for t in frame.text]})

    return spread(documents.select("doc_id", "text"), "doc_id").dropDuplicates(["doc_id"]).mapInPandas(f, "doc_id long, tokens long")


def best_fit(tokens: np.ndarray, c: Container) -> np.ndarray:
    """The container of each item; items come in falling order of size. An item heavier than a capacity other than
    tokens gets a container of its own."""
    cap = np.array([c.tokens, c.documents, c.attention * c.tokens**2], dtype=float)
    weight = np.array(c.weights) / cap
    room = np.empty((1024, 3))
    names = np.empty(1024, dtype=np.int64)  # of the open containers
    n = made = 0
    out = np.empty(len(tokens), dtype=np.int64)
    least = tokens.min() if len(tokens) else 0
    for i, t in enumerate(tokens):
        item = np.array([t, 1.0, float(t) * t])
        left = room[:n] - item
        fits = np.flatnonzero((left >= 0).all(axis=1))
        if len(fits):
            norm = ((left[fits] * weight) ** 2).sum(axis=1)
            at = fits[int(norm.argmin())]
            room[at] = left[at]
            out[i] = names[at]
        else:
            if n == len(room):
                room, names = np.concatenate([room, np.empty_like(room)]), np.concatenate([names, np.empty_like(names)])
            at = n
            room[at], names[at] = cap - item, made
            out[i] = made
            n, made = n + 1, made + 1
        # what has no room for the smallest item is closed
        if room[at, 0] < least or room[at, 1] < 1 or room[at, 2] < least * least:
            n -= 1
            room[at], names[at] = room[n], names[n]
    return out


_PACKED = "grp int, bin long, doc_id long, piece int, first_token long, tokens long, filled long, done boolean"


def pack(documents: DataFrame, container: Container = Container(), tokenizer: str | None = None) -> DataFrame:
    """Rows (container, doc_id, piece, first_token, tokens, filled), one per document, or per piece of a split one.

    documents: doc_id, text. container names the container, filled tells its tokens. A document that fits is one
    piece; a larger one is split into full pieces and a rest. Texts without tokens (null, empty) take no room:
    their container is null. An empty table gives an empty result.
    """
    c = container
    sized = cut(sizes(documents, tokenizer))
    none = sized.where("tokens = 0").select(
        F.lit(None).cast("string").alias("container"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("first_token"), "tokens", F.lit(0).cast("long").alias("filled")
    )
    pieces = (
        sized.where("tokens > 0")
        .withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("tokens") - 1) / c.tokens).cast("int"))))
        .select("doc_id", "piece", (F.col("piece").cast("long") * c.tokens).alias("first_token"), "tokens")
        .withColumn("tokens", F.least(F.lit(c.tokens).cast("long"), F.col("tokens") - F.col("first_token")))
    )

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        frame["bin"] = best_fit(frame.tokens.to_numpy(), c)
        in_bin = frame.groupby("bin").tokens
        frame["filled"] = in_bin.transform("sum")
        cost = (frame.tokens.astype(float) ** 2).groupby(frame.bin).transform("sum")
        frame["done"] = (frame.filled >= c.full * c.tokens) | (in_bin.transform("size") >= c.full * c.documents) | (cost >= c.full * c.attention * c.tokens**2)
        return frame[["grp", "bin", "doc_id", "piece", "first_token", "tokens", "filled", "done"]]

    done = none
    todo = pieces
    turn, before = 0, None
    while (n := todo.count()) > 0:
        groups = -(-n // c.group)
        packed = cut(
            todo.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), F.lit(groups)).cast("int")).groupBy("grp").applyInPandas(one, _PACKED)
        )
        last = groups == 1 or before is not None and n > c.shrink * before
        final = packed if last else packed.where("done")
        done = done.unionByName(
            final.select(F.concat_ws(".", F.lit(str(turn)), F.col("grp").cast("string"), F.col("bin").cast("string")).alias("container"), "doc_id", "piece", "first_token", "tokens", "filled")
        )
        if last:
            break
        todo = packed.where("NOT done").select("doc_id", "piece", "first_token", "tokens")
        turn, before = turn + 1, n
    return done


def packing_summary(packed: DataFrame, container: Container = Container()) -> DataFrame:
    """One row: documents, tokens, containers, the least number there can be, fill rates and split documents.

    The least number is the largest of those that tokens, documents and attention cost need by themselves; a text
    beyond the attention capacity counts as one that takes all of it. The fill rates are the shares of the containers' tokens,
    documents and attention cost that are used.
    """
    c = container
    room = float(c.attention * c.tokens**2)
    cost = F.least(F.col("tokens").cast("double") * F.col("tokens"), F.lit(room))
    per = packed.where("container IS NOT NULL")
    used = per.agg(
        F.countDistinct("container").alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.countDistinct("doc_id").alias("documents"),
        F.count("*").alias("pieces"), F.coalesce(F.sum(cost), F.lit(0.0)).alias("cost"),
    )
    split = per.where("piece > 0").agg(F.countDistinct("doc_id").alias("split_documents"))
    least = F.greatest(F.ceil(F.col("tokens") / c.tokens), F.ceil(F.col("pieces") / c.documents), F.ceil(F.col("cost") / room))
    rate = lambda x, most: F.round(F.try_divide(F.col(x), F.col("containers") * F.lit(most)), 6)
    return used.crossJoin(F.broadcast(split)).select(  # one row beside one row
        "documents", "split_documents", "tokens", "containers", least.alias("least_containers"), rate("tokens", c.tokens).alias("fill_rate"), rate("pieces", c.documents).alias("document_rate"), rate("cost", room).alias("attention_rate")
    )
