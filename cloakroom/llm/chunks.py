"""Asking the whole corpus about hashes without a row per hash.

Documents are dealt into chunks by a hash of their id and text. Each chunk sends
its distinct hashes, sorted, as one binary block to each of a number of buckets
(a bucket owns a range of hash values); a bucket compares what all chunks sent
and answers each chunk with one small array in the order of its block. A hash
that a third of all documents share reaches its bucket once for each chunk, not
once for each row, so no group grows with a hot value.

The chunked texts are shuffled once: every later use of ``Chunks.docs`` grouped
by ``chunk`` has the same exchange, which Spark reuses.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakroom.llm.common import lean


@dataclass
class Chunks:
    docs: DataFrame  # id, text, chunk and perhaps more
    n_chunks: int
    text_bytes: int


def chunked(docs: DataFrame, least_bytes: int = 4 << 20, most_bytes: int = 64 << 20) -> Chunks:
    """Deal ``docs`` (with ``id`` and ``text``) into chunks whose size grows as the root of the corpus."""
    total = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    each = min(most_bytes, max(least_bytes, int(least_bytes * (total / 2**30) ** 0.5)))
    n = max(8, -(-total // each))
    return Chunks(docs.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(n))), n, total)


def buckets_for(entries: int, entry_bytes: int, each: int = 16 << 20) -> int:
    return max(8, -(-entries * entry_bytes // each))


def cuts(sorted_hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where each bucket's range begins in sorted 64-bit hashes (``n_buckets + 1`` offsets)."""
    edges = np.array([(b << 64) // n_buckets for b in range(n_buckets)], dtype=np.uint64)
    return np.append(np.searchsorted(sorted_hashes, edges), len(sorted_hashes))


def shorten(hashes: np.ndarray, width: int, skip_bits: int) -> bytes:
    """``width`` bytes of each hash, below its ``skip_bits`` highest bits (the bucket knows about those)."""
    shift = np.uint64(64 - skip_bits - 8 * width)
    return np.ascontiguousarray((hashes >> shift).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def widen(data: bytes, width: int) -> np.ndarray:
    short = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
    out = np.zeros((len(short), 8), dtype=np.uint8)
    out[:, :width] = short
    return out.view("<u8").ravel()


def shared_by_chunks(sent: DataFrame, width: int) -> DataFrame:
    """``sent``: bucket, chunk, block of distinct short hashes; answers: a bit each, set if another chunk sent it too."""

    def judge(df: pd.DataFrame) -> pd.DataFrame:
        parts = [widen(b, width) for b in df["block"]]
        sizes = [len(p) for p in parts]
        values = np.concatenate(parts)
        order = np.argsort(values)
        ranked = values[order]
        same = ranked[1:] == ranked[:-1]
        hit = np.zeros(len(values), dtype=bool)
        hit[order] = np.append(same, False) | np.append(False, same)
        ends = np.cumsum(sizes)
        return pd.DataFrame({"chunk": df["chunk"], "bucket": df["bucket"], "answer": [np.packbits(hit[e - n : e]).tobytes() for n, e in zip(sizes, ends)]})

    return sent.groupBy("bucket").applyInPandas(lean(judge), "chunk long, bucket int, answer binary")


def answer_bits(answers: pd.DataFrame, cut: np.ndarray) -> np.ndarray:
    """The answers of all buckets in the order of the chunk's sorted hashes."""
    out = np.zeros(cut[-1], dtype=bool)
    for b, data in zip(answers["bucket"], answers["answer"]):
        n = cut[b + 1] - cut[b]
        out[cut[b] : cut[b + 1]] = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n).astype(bool)
    return out
