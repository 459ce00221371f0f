"""Removal of repeated word windows: Rabin-Karp hashes of every fixed-length window, counted over the corpus.

Two questions go to the whole corpus (see ``chunks``). First: which window
hashes occur in more than one chunk, asked with a few bytes of each hash (a
filter: what it lets through wrongly the second question settles). Then, for
those alone and with the whole 64-bit hash: does the window start in a document
with a smaller id than the smallest in this chunk? Windows found so, or found in
a smaller document of the same chunk, merge into maximal removal intervals.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakroom.llm.chunks import answer_bits, buckets_for, chunked, cuts, shared_by_chunks, shorten
from cloakroom.llm.common import PrefixHash, _powers, lean, mix64, text_batches, word_spans
from cloakroom.sources.tables import spread

_NO_ID = np.iinfo(np.int64).max  # a null id comes last


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words of each text."""
    hashes, counts = [np.zeros(0, np.uint64)], []
    for lo, hi in text_batches(texts):
        data = np.frombuffer(b"\n".join(texts[lo:hi]), dtype=np.uint8)
        start, end = word_spans(data)
        hashes.append(PrefixHash(data).slices(start, end))
        edges = np.cumsum([len(t) + 1 for t in texts[lo:hi]])
        counts.append(np.diff(np.searchsorted(start, np.concatenate(([0], edges)))))
    return np.concatenate(hashes), np.concatenate(counts) if counts else np.zeros(0, np.int64)


class _Chunk:
    """The windows of a chunk's documents, the documents in a fixed order."""

    def __init__(self, df: pd.DataFrame, window: int):
        ids = [_NO_ID if pd.isna(x) else int(x) for x in df["id"]]
        texts = [t.encode() for t in df["text"]]
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids = np.array([ids[i] for i in self.order], dtype=np.int64)
        self.texts = [texts[i] for i in self.order]
        words, self.counts = _words(self.texts)
        n = len(words)
        self.ends = np.cumsum(self.counts)
        p, inv = _powers(n + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * p[:n], dtype=np.uint64)))
        doc = np.repeat(np.arange(len(self.ids)), self.counts)
        self.at = np.flatnonzero(np.arange(n) + window <= self.ends[doc]) if n else np.zeros(0, np.int64)
        self.doc = doc[self.at]
        hashes = mix64((sums[self.at + window] - sums[self.at]) * inv[self.at])
        # documents come by rising id, so the first of equal windows has the smallest id
        self.unique, first, self.which = np.unique(hashes, return_index=True, return_inverse=True)
        self.least = self.ids[self.doc[first]]


def remove_repeated_windows(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, carry: str | None = None) -> DataFrame:
    """Remove each word covered by a window that also starts in a document with a smaller id.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, unchanged. Returns
    ``doc_id, n_words, n_removed, kept_sha256`` per input row (kept words joined by
    one space); with ``with_text`` also ``text``, the text without the removed
    stretches and otherwise as it was; ``carry`` names one string column to hand
    through. Null text counts as empty. A null id is larger than any other. Rows of
    equal id are no earlier documents to each other, so repeated rows lose nothing
    to one another. An empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([F.col(carry).alias("carry")] if carry else []))
    plan = chunked(spread(base))
    entries = plan.text_bytes // 5 + 1  # a rough count of words
    nb = buckets_for(entries, 5)
    skip = max(0, nb.bit_length() - 1)
    width = min(8, max(4, -(-(entries.bit_length() + 10 - skip) // 8)))
    skip = min(skip, 64 - 8 * width)
    sent_type = "bucket int, chunk long, block binary"

    def send(df: pd.DataFrame) -> pd.DataFrame:
        c = _Chunk(df, window)
        cut = cuts(c.unique, nb)
        rows = [(b, df["chunk"].iloc[0], shorten(c.unique[cut[b] : cut[b + 1]], width, skip)) for b in range(nb) if cut[b + 1] > cut[b]]
        return pd.DataFrame(rows, columns=["bucket", "chunk", "block"])

    slim = plan.docs.select("id", "text", "chunk") if not carry else plan.docs
    shared = shared_by_chunks(slim.groupBy("chunk").applyInPandas(lean(send), sent_type), width)

    def ask(df: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(df):
            return pd.DataFrame(columns=["bucket", "chunk", "block", "least"])
        c = _Chunk(df, window)
        hit = answer_bits(answers, cuts(c.unique, nb))
        found, least = c.unique[hit], c.least[hit]
        cut, number = cuts(found, nb), np.packbits(hit).tobytes()
        small = "<i4" if not len(least) or -(2**31) <= least.min() and least.max() < 2**31 else "<i8"
        rows = [(b, df["chunk"].iloc[0], found[cut[b] : cut[b + 1]].tobytes(), least[cut[b] : cut[b + 1]].astype(small).tobytes()) for b in range(nb) if cut[b + 1] > cut[b]]
        # bucket -1 - chunk holds which hashes were asked about, for the chunk itself
        rows.append((-1 - int(df["chunk"].iloc[0]) % 2**31, df["chunk"].iloc[0], number, b""))
        return pd.DataFrame(rows, columns=["bucket", "chunk", "block", "least"])

    asked = slim.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInPandas(lean(ask), "bucket int, chunk long, block binary, least binary")

    def judge(df: pd.DataFrame) -> pd.DataFrame:
        if df["bucket"].iloc[0] < 0:
            return pd.DataFrame({"chunk": df["chunk"], "bucket": df["bucket"], "answer": df["block"]})
        parts = [np.frombuffer(b, dtype="<u8") for b in df["block"]]
        least = np.concatenate([np.frombuffer(x, dtype="<i4" if len(x) == len(b) // 2 else "<i8").astype(np.int64) for x, b in zip(df["least"], df["block"])])
        values = np.concatenate(parts)
        order = np.lexsort((least, values))
        ranked = values[order]
        new = np.append(True, ranked[1:] != ranked[:-1])
        lowest = least[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        earlier = np.zeros(len(values), dtype=bool)
        earlier[order] = lowest < least[order]
        ends = np.cumsum([len(p) for p in parts])
        return pd.DataFrame({"chunk": df["chunk"], "bucket": df["bucket"], "answer": [np.packbits(earlier[e - len(p) : e]).tobytes() for p, e in zip(parts, ends)]})

    answers = asked.groupBy("bucket").applyInPandas(lean(judge), "chunk long, bucket int, answer binary")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", text string" if with_text else "") + (f", {carry} string" if carry else "")

    def cut_out(df: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        names = [x.split(" ")[0] for x in schema.split(", ")]
        if not len(df):
            return pd.DataFrame(columns=names)
        c = _Chunk(df, window)
        own = replies["bucket"] < 0
        hit = np.unpackbits(np.frombuffer(replies["answer"][own].iloc[0], dtype=np.uint8), count=len(c.unique)).astype(bool)
        earlier = np.zeros(len(c.unique), dtype=bool)
        earlier[hit] = answer_bits(replies[~own], cuts(c.unique[hit], nb))
        gone = earlier[c.which] | (c.ids[c.doc] > c.least[c.which])
        edge = np.zeros(int(c.counts.sum()) + 1, dtype=np.int64)
        np.add.at(edge, c.at[gone], 1)
        np.add.at(edge, c.at[gone] + window, -1)
        keep = np.cumsum(edge[:-1]) == 0
        rows = []
        for k, i in enumerate(c.order):
            hi = int(c.ends[k])
            mine = keep[hi - int(c.counts[k]) : hi]
            raw = c.texts[k]
            words = raw.split()
            left = int(mine.sum())
            kept = b" ".join(words if left == len(words) else compress(words, mine))
            row = [None if c.ids[k] == _NO_ID else int(c.ids[k]), len(words), len(words) - left, hashlib.sha256(kept).hexdigest()]
            if with_text:
                row.append(raw.decode() if left == len(words) else _without(raw, mine))
            if carry:
                row.append(df["carry"].iloc[i])
            rows.append(row)
        out = pd.DataFrame(rows, columns=names)
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    return slim.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(lean(cut_out), schema)


def _without(raw: bytes, keep: np.ndarray) -> str:
    """The text less each run of words not kept, up to the next word."""
    start, _ = word_spans(np.frombuffer(raw, dtype=np.uint8))
    stops = np.append(start[1:], len(raw))
    out = [raw[: start[0]]]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], keep.astype(np.int8), [0]))))
    for a, b in zip(edges[::2], edges[1::2]):
        out.append(raw[start[a] : stops[b - 1]])
    return b"".join(out).decode()
