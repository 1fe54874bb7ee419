"""The k most similar vectors for every vector, by cosine.

Vectors are partitioned into cells (spherical k-means on a bounded sample); every vector is stored once, in
its nearest cell, and asks the few nearest cells. In a cell it is held against product-quantised codes of four
bits a subspace. The codebooks are trained for inner products: the loss weighs the part of the residual that
is parallel to the vector more than the orthogonal part (score-aware, anisotropic). A query's table of partial
products is looked up by the codes, two subspaces a byte; the best of the scan are reranked with exact
products. Exact copies are one representative with its smallest ids, so copies are never paired with each
other at length, and cells that are crowded nevertheless are worked through in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, spread


@dataclass(frozen=True)
class Plan:
    """Parameters of the index."""

    dim: int = 64
    k: int = 5  # neighbours
    cell: int = 500  # vectors of an average cell
    cells: int = 4096  # cells, at most
    probes: int = 8  # cells that a vector asks
    sample: int = 20_000  # vectors from which cells and codebooks are trained, at most
    subspaces: int = 32  # of four bits each
    threshold: float = 0.2  # cosine from which on pairs matter to the anisotropic loss
    rerank: int = 40  # candidates of a scan whose exact products are taken
    block: int = 4096  # vectors of a cell in one task, at most
    asked: int = 16_384  # queries of a cell in one task, at most


@dataclass
class Index:
    """Centres of the cells and codebooks of the residuals."""

    plan: Plan
    centres: np.ndarray  # (cells, dim), unit length
    books: np.ndarray  # (subspaces, 16, dim / subspaces)
    eta: float = field(default=1.0)

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        n = min(n, len(self.centres))
        s = x @ self.centres.T
        top = np.argpartition(-s, n - 1, axis=1)[:, :n]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)

    def encode(self, x: np.ndarray, cell: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (n, subspaces) of the residuals, chosen by coordinate descent on the anisotropic loss."""
        m, w = self.books.shape[0], self.books.shape[2]
        y = (x - self.centres[cell]).reshape(len(x), m, w)
        xs = x.reshape(len(x), m, w)
        codes = np.zeros((len(x), m), dtype=np.uint8)
        # start from the nearest codeword of each subspace
        for j in range(m):
            codes[:, j] = (((y[:, j, None] - self.books[j][None]) ** 2).sum(2)).argmin(1)
        parallel = self._parallel(y, xs, codes)
        for _ in range(sweeps):
            for j in range(m):
                r = y[:, j, None] - self.books[j][None]
                along = (r * xs[:, j, None]).sum(2)
                rest = parallel - np.take_along_axis(along, codes[:, j : j + 1].astype(int), 1)[:, 0]
                codes[:, j] = ((r**2).sum(2) + (self.eta - 1) * (rest[:, None] + along) ** 2).argmin(1)
                parallel = rest + np.take_along_axis(along, codes[:, j : j + 1].astype(int), 1)[:, 0]
        return codes

    def _parallel(self, y, xs, codes):
        p = np.zeros(len(y), dtype=y.dtype)
        for j in range(len(self.books)):
            p += ((y[:, j] - self.books[j][codes[:, j]]) * xs[:, j]).sum(1)
        return p

    def scan(self, q: np.ndarray, centre: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Approximate products (queries, vectors) from tables of 256 entries for each pair of subspaces."""
        m, w = self.books.shape[0], self.books.shape[2]
        parts = np.einsum("qmw,mkw->qmk", q.reshape(len(q), m, w), self.books)
        tables = (parts[:, 0::2, :, None] + parts[:, 1::2, None, :]).reshape(len(q), m // 2, 256)
        out = np.repeat((q @ centre)[:, None], len(packed), axis=1)
        for j in range(m // 2):
            out += np.take(tables[:, j], packed[:, j], axis=1)
        return out


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(scale > 0, scale, 1)  # so that very small and very large vectors keep their direction
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def train(x: np.ndarray, n: int, plan: Plan) -> Index:
    """Cells and codebooks from a sample of unit vectors, for a collection of n; deterministic."""
    rng = np.random.default_rng(17)
    cells = int(min(max(n // plan.cell, 1), plan.cells, len(x)))
    centres = x[rng.choice(len(x), cells, replace=False)].copy()
    for _ in range(10):
        at = np.concatenate([(part @ centres.T).argmax(1) for part in np.array_split(x, max(1, len(x) // 8192))])
        for c in range(cells):
            v = x[at == c].sum(0) if (at == c).any() else x[rng.integers(len(x))]
            norm = np.linalg.norm(v)
            centres[c] = v / norm if norm > 1e-9 else centres[c]
    at = np.concatenate([(part @ centres.T).argmax(1) for part in np.array_split(x, max(1, len(x) // 8192))])
    m = plan.subspaces
    w = plan.dim // m
    y = (x - centres[at]).reshape(len(x), m, w)
    xs = x.reshape(len(x), m, w)
    t2 = plan.threshold**2
    eta = max(1.0, (plan.dim - 1) * t2 / (1 - t2))
    books = np.stack([y[rng.choice(len(x), 16, replace=len(x) < 16), j] for j in range(m)]).astype(np.float32)
    for j in range(m):
        for _ in range(8):
            near = ((y[:, j, None] - books[j][None]) ** 2).sum(2).argmin(1)
            for k in range(16):
                if (near == k).any():
                    books[j, k] = y[near == k, j].mean(0)
    index = Index(plan, centres, books, eta)
    for _ in range(4):
        codes = index.encode(x, at, 1)
        parallel = index._parallel(y, xs, codes)
        for j in range(m):
            rest = parallel - ((y[:, j] - books[j][codes[:, j]]) * xs[:, j]).sum(1)
            for k in range(16):
                i = codes[:, j] == k
                if not i.any():
                    continue
                u, v = xs[i, j].astype(float), y[i, j].astype(float)
                a = i.sum() * np.eye(w) + (eta - 1) * u.T @ u
                b = v.sum(0) + (eta - 1) * (u * (rest[i] + (u * v).sum(1))[:, None]).sum(0)
                books[j, k] = np.linalg.solve(a, b)
            parallel = rest + ((y[:, j] - books[j][codes[:, j]]) * xs[:, j]).sum(1)
    return index


def usable(chunks: DataFrame, dim: int) -> DataFrame:
    """(id, embedding) once per id, of embeddings that have the right length, no null, NaN or infinite number, and direction."""
    ok = (
        (F.size("embedding") == dim)
        & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    return chunks.select("id", "embedding").where("id IS NOT NULL AND embedding IS NOT NULL").where(ok).groupBy("id").agg(F.min("embedding").alias("embedding"))


def neighbours(chunks: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """Rows (id, neighbour, cosine, rank): the k most similar other vectors of every vector with a usable embedding.

    chunks: id, embedding; repeated ids count once (the smallest embedding, should they differ). Ties go to the
    smaller id. Unusable embeddings take no part, one vector alone has no neighbours. Cosines are exact,
    the choice of candidates is approximate.
    """
    spark = chunks.sparkSession
    k = plan.k
    vectors = cut(usable(chunks, plan.dim))
    # exact copies: one representative with the k + 1 smallest ids
    w = Window.partitionBy("embedding").orderBy("id")
    leaders = vectors.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
    classes = cut(leaders.groupBy("embedding").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("cid", F.col("ids")[0]))
    n = classes.count()
    crowd = vectors.join(classes.where(F.size("ids") > k).select("embedding", "ids"), "embedding").select("id", "ids")
    copies = crowd.select("id", F.posexplode(F.slice(F.filter("ids", lambda x: x != F.col("id")), 1, k)).alias("rank", "neighbour")).select(
        "id", "neighbour", F.lit(1.0).alias("cosine"), (F.col("rank") + 1).cast("int").alias("rank")
    )
    few = classes.where(F.size("ids") <= k)
    if n < 2:
        pairs = classes.select(F.col("cid").alias("qid"), "cid", F.lit(1.0).alias("cosine")).limit(0)
    else:
        rows = classes.select("cid", "embedding").orderBy(F.xxhash64("cid"), "cid").limit(plan.sample).toPandas()
        index = train(unit(np.stack(rows.embedding.to_numpy())), n, plan)
        pairs = _search(classes, index, spark)
    last = Window.partitionBy("qid").orderBy(F.desc("cosine"), "cid")
    best = pairs.withColumn("n", F.row_number().over(last)).where(F.col("n") <= k).drop("n")
    asked = few.select(F.col("cid").alias("qid"), F.col("ids").alias("own"))
    near = best.join(asked, "qid").join(classes.select("cid", "ids"), "cid")
    others = near.select(F.explode("own").alias("id"), "ids", "cosine").select("id", F.explode("ids").alias("neighbour"), "cosine")
    same = few.where(F.size("ids") > 1).select(F.explode("ids").alias("id"), "ids").select("id", F.explode("ids").alias("neighbour"), F.lit(1.0).alias("cosine")).where("id <> neighbour")
    rank = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    found = others.union(same).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return found.unionByName(copies)


def _search(classes: DataFrame, index: Index, spark) -> DataFrame:
    """(qid, cid, cosine): the best of every asked cell for every representative."""
    plan = index.plan
    shared = spark.sparkContext.broadcast(index)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for f in frames:
            if len(f):
                x = unit(np.stack(f.embedding.to_numpy()))
                cells = index.nearest(x, plan.probes)
                codes = index.encode(x, cells[:, 0])
                packed = codes[:, 0::2] * 16 + codes[:, 1::2]
                yield pd.DataFrame({"cid": f.cid, "vector": [v.tobytes() for v in x], "codes": [c.tobytes() for c in packed], "cells": list(cells.astype(np.int32))})

    placed = cut(spread(classes.select("cid", "embedding"), "cid").mapInPandas(place, "cid string, vector binary, codes binary, cells array<int>"))
    # crowded cells are worked through in blocks of vectors and of queries; a row per cell tells into how many
    held = placed.groupBy(F.col("cells")[0].alias("cell")).agg(F.count("*").alias("held"))
    asks = placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("asks"))
    blocks = held.join(asks, "cell").select("cell", F.ceil(F.col("held") / plan.block).cast("int").alias("vb"), F.ceil(F.col("asks") / plan.asked).cast("int").alias("qb"))
    part = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    vectors = (
        placed.withColumn("cell", F.col("cells")[0]).join(F.broadcast(blocks), "cell").withColumn("v", part("vb")).withColumn("q", every("qb")).select("cell", "v", "q", "cid", "vector", "codes")
    )
    queries = (
        placed.select("cid", "vector", F.explode("cells").alias("cell"))
        .join(F.broadcast(blocks), "cell")
        .withColumn("q", part("qb"))
        .withColumn("v", every("vb"))
        .select(F.col("cell").alias("qcell"), F.col("v").alias("qv"), F.col("q").alias("qq"), F.col("cid").alias("qid"), F.col("vector").alias("asked"))
    )

    def meet(data: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qid": pd.Series(dtype=str), "cid": pd.Series(dtype=str), "cosine": pd.Series(dtype=float)})
        if not len(data) or not len(ask):
            return empty
        index = shared.value
        x = np.frombuffer(b"".join(data.vector), dtype=np.float32).reshape(len(data), plan.dim)
        packed = np.frombuffer(b"".join(data.codes), dtype=np.uint8).reshape(len(data), plan.subspaces // 2)
        q = np.frombuffer(b"".join(ask.asked), dtype=np.float32).reshape(len(ask), plan.dim)
        centre = index.centres[int(data.cell.iloc[0])]
        ids, qids = data.cid.to_numpy(), ask.qid.to_numpy()
        own = {c: i for i, c in enumerate(ids)}
        r, out = min(plan.rerank + 1, len(x)), []
        step = max(16, 2_000_000 // max(len(x), 1))
        for a in range(0, len(q), min(step, 512)):
            qa = q[a : a + min(step, 512)]
            s = index.scan(qa, centre, packed)
            top = np.argpartition(-s, r - 1, axis=1)[:, :r]
            exact = np.einsum("qd,qrd->qr", qa.astype(np.float64), x[top].astype(np.float64))
            for i in range(len(qa)):
                me = own.get(qids[a + i], -1)
                if me >= 0:
                    exact[i, top[i] == me] = -9
            keep = min(plan.k, r)
            best = np.argpartition(-exact, keep - 1, axis=1)[:, :keep]
            score = np.take_along_axis(exact, best, 1)
            who = np.take_along_axis(top, best, 1)
            good = score > -2
            rows, cols = np.nonzero(good)
            out.append(pd.DataFrame({"qid": qids[a + rows], "cid": ids[who[rows, cols]], "cosine": np.clip(score[rows, cols], -1, 1)}))
        return pd.concat(out, ignore_index=True) if out else empty

    return vectors.groupBy("cell", "v", "q").cogroup(queries.groupBy("qcell", "qv", "qq")).applyInPandas(meet, "qid string, cid string, cosine double")


def similar_pairs(found: DataFrame, least: float) -> DataFrame:
    """Pairs (chunk_id_a < chunk_id_b) of which one is among the neighbours of the other, of at least a cosine."""
    return found.where(F.col("cosine") >= least).select(F.least("id", "neighbour").alias("chunk_id_a"), F.greatest("id", "neighbour").alias("chunk_id_b")).distinct()
