"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector less the centroid is rotated at random and kept as the signs of its
components, its norm, and the inner product of the unit vector with its own signs. A
query's inner product with every code is estimated from the packed bits and the
query's bit planes; the estimate's error bound says which vectors may still be among
the nearest, and only those are compared exactly, in double precision.

The stated queries meet all rows in blocks: a task holds one block of queries and one
of rows, and passes on the nearest few of each query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLANES = 4  # bits of a quantised query component
#: Rows from which the centroid is taken, at most about so many (chosen by a hash of the id).
SAMPLE_ROWS = 20_000


@dataclass
class Code:
    """What estimates need, shared by all rows; ``errors`` is the bound's width in standard deviations."""

    centroid: np.ndarray
    rotation: np.ndarray
    errors: float

    @classmethod
    def fit(cls, centroid: np.ndarray, errors: float, seed: int = 5) -> "Code":
        d = len(centroid)
        wide = -(-d // 64) * 64  # zero components fill up the last word
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((wide, wide)))
        return cls(centroid, (q * np.sign(np.diag(r)))[:d], errors)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs, norm and correction of each row."""
        rest = x - self.centroid
        norm = np.linalg.norm(rest, axis=1)
        turned = rest @ self.rotation / np.where(norm > 0, norm, 1)[:, None]
        bits = np.packbits(turned > 0, axis=1, bitorder="little").view("<u8")
        fit = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
        return bits, norm, np.where(norm > 0, fit, 1.0)

    def bounds(self, q: np.ndarray, bits: np.ndarray, norm: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimates and error bounds of the inner products of queries (rows) with coded vectors (columns)."""
        turned = q @ self.rotation
        wide = turned.shape[1]
        low = turned.min(axis=1, keepdims=True)
        step = np.maximum((turned.max(axis=1, keepdims=True) - low) / (2**PLANES - 1), 1e-30)
        level = np.rint((turned - low) / step).astype(np.uint8)
        dot = np.zeros((len(q), len(bits)), dtype=np.uint32 if wide > 2048 else np.uint16)
        for p in range(PLANES):
            plane = np.packbits(level >> p & 1, axis=1, bitorder="little").view("<u8")
            for w in range(bits.shape[1]):
                dot += np.left_shift(np.bitwise_count(plane[:, w, None] & bits[:, w]), p, dtype=dot.dtype)
        # sum over +-1 signs = 2 * sum over ones - sum over all, for the quantised query
        ones = np.bitwise_count(bits).sum(axis=1).astype(np.float32)
        scale = (norm / fit / np.sqrt(wide)).astype(np.float32)
        estimate = dot * (2 * step).astype(np.float32)
        estimate += (2 * low).astype(np.float32) * ones - (step * level.sum(axis=1, dtype=np.float64)[:, None] + low * wide).astype(np.float32)
        estimate *= scale
        estimate += (q @ self.centroid).astype(np.float32)[:, None]
        spread = norm * np.sqrt(np.maximum(1 - fit**2, 0)) / fit / np.sqrt(max(wide - 1, 1))
        length = np.linalg.norm(q, axis=1)[:, None]
        # spread of the code, and rounding of the query's components
        error = (self.errors * length).astype(np.float32) * spread.astype(np.float32)
        error += (self.errors * step / np.sqrt(12)).astype(np.float32) * (norm / fit).astype(np.float32)
        return estimate, error


def _sure(estimate: np.ndarray, q: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """A score that ``k`` candidates of each query reach: the ``k``-th best exact one of a few with large estimates."""
    rows, n = estimate.shape
    if n <= 4 * k:
        return np.full(rows, np.finfo(np.float32).min)
    group = max(1, n // (8 * k))
    best = estimate[:, : n // group * group].reshape(rows, -1, group)
    at = best.argmax(axis=2) + np.arange(best.shape[1]) * group
    few = np.argpartition(np.take_along_axis(estimate, at, axis=1), -2 * k, axis=1)[:, -2 * k :]
    at = np.take_along_axis(at, few, axis=1)
    score = np.einsum("ij,ikj->ik", q, x[at])
    score[~np.isfinite(np.take_along_axis(estimate, at, axis=1))] = -np.inf  # the query itself
    return np.maximum(np.partition(score, -k, axis=1)[:, -k] - 1e-9, np.finfo(np.float32).min)


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, vec`` of the rows that take part, one for each id."""
    v = F.col("vec")
    whole = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(
        F.col("id").isNotNull()
        & v.isNotNull()
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    return whole.groupBy("id").agg(F.min("vec").alias("vec"))


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", errors: float = 1.9) -> DataFrame:
    """Each query's ``k`` rows of largest inner product: ``query_id, rank, vec_id, score``.

    ``is_query`` maps the id column to a condition. Candidates are all rows but the
    query's own; ties go to the smaller id. Null ids and vectors that are null, zero or
    hold null or non-finite components take no part, nor do those whose number of
    components isn't the most frequent one (the smaller, if two are). Repeated rows of
    one id count once (the least vector). With fewer candidates all are returned; an
    empty table gives an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    valid = _vectors(vectors, id_col, vec_col)
    sizes = valid.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"), F.count_if(is_query(F.col("id"))).alias("q")).orderBy(F.col("n").desc(), "d").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes or not sizes[0]["q"]:
        return empty
    d, n, nq = sizes[0]["d"], sizes[0]["n"], sizes[0]["q"]
    valid = valid.where(F.size("vec") == d)
    part = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < int(min(1.0, SAMPLE_ROWS / n) * (1 << 30))
    middle = valid.where(part).select(F.posexplode("vec")).groupBy("pos").agg(F.avg("col").alias("m")).collect()  # d numbers
    centroid = np.zeros(d)
    for r in middle:
        centroid[r["pos"]] = r["m"]
    code = Code.fit(centroid, errors)
    n_rows = -(-n // min(65_536, max(1024, n // 16)))
    n_queries = -(-nq // min(16_384, max(512, nq // 4)))

    def encode(batches):
        for df in batches:
            if not len(df):
                continue
            x = np.array(df["vec"].tolist(), dtype=np.float64)
            bits, norm, fit = code.encode(x)
            yield pd.DataFrame({"id": df["id"], "vec": [r.tobytes() for r in x], "bits": [b.tobytes() for b in bits], "norm": norm, "fit": fit})

    coded = valid.mapInPandas(encode, "id long, vec binary, bits binary, norm double, fit double")
    rows = coded.withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(n_rows))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    queries = (
        valid.where(is_query(F.col("id")))
        .withColumn("qb", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_queries)).cast("int"))
        .withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_rows - 1).cast("long"))))
    )

    def block(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if not len(q) or not len(c):
            return pd.DataFrame(columns=columns)
        c = c.sort_values("id")
        ids, x = c["id"].to_numpy(), np.frombuffer(b"".join(c["vec"]), dtype=np.float64).reshape(len(c), -1)
        bits = np.frombuffer(b"".join(c["bits"]), dtype="<u8").reshape(len(c), -1)
        norm, fit = c["norm"].to_numpy(), c["fit"].to_numpy()
        q_ids, q_vec = q["id"].to_numpy(), np.array(q["vec"].tolist(), dtype=np.float64)
        out = []
        few = max(1, (1 << 18) // len(c))  # queries whose bounds are in the cache at once
        place = {v: i for i, v in enumerate(ids.tolist())}
        own = np.array([place.get(v, -1) for v in q_ids.tolist()])
        for lo in range(0, len(q), few):
            part, mine = q_vec[lo : lo + few], q_ids[lo : lo + few]
            estimate, error = code.bounds(part, bits, norm, fit)
            self_at = np.flatnonzero(own[lo : lo + few] >= 0)
            estimate[self_at, own[lo : lo + few][self_at]] = -np.inf
            floor = _sure(estimate, part, x, k)
            estimate += error
            for i, v in enumerate(part):
                ci = np.flatnonzero(estimate[i] >= floor[i])
                score = x[ci] @ v
                if len(ci) > k:
                    ci = ci[score >= np.partition(score, -k)[-k] - 1e-9 * max(1.0, np.abs(score).max())]
                score = (x[ci] * v).sum(axis=1)  # one way to add for all, so that equal vectors tie
                order = np.lexsort((ids[ci], -score))[:k]
                out.append((np.full(len(order), mine[i]), ids[ci[order]], score[order]))
        return pd.DataFrame(dict(zip(columns, (np.concatenate(z) for z in zip(*out)))))

    found = queries.groupBy("qb", "rb").cogroup(rows.groupBy("qb", "rb")).applyInPandas(block, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every(n: int):
    """Queries are the rows whose id is divisible by ``n``."""

    def is_query(id_col: Column) -> Column:
        return id_col % n == 0

    return is_query
