"""Context-triggered piecewise hashing of texts, compared by edit distance.

A rolling hash over ``WINDOW`` bytes ends a piece wherever its low bits are zero; how
many bits (the block size) follows from the text's length. Each piece gives one
character of the signature, which has ``LONGEST`` at most: the last one stands for all
that is left. A fingerprint is ``block:signature:signature at twice the block``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakroom.llm.common import PrefixHash, blocks_of, text_batches
from cloakroom.session import materialize

WINDOW = 7
LONGEST = 64  # a signature fits one machine word of the bit-parallel edit distance
LEAST_BITS = 2
_CHARS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)


def fingerprints(texts: list[bytes]) -> list[str]:
    out: list[str] = []
    for lo, hi in text_batches(texts):
        out += _batch(texts[lo:hi])
    return out


def _batch(texts: list[bytes]) -> list[str]:
    size = np.array([len(t) for t in texts], dtype=np.int64)
    stop = np.cumsum(size)
    start = stop - size
    bits = np.maximum(LEAST_BITS, np.ceil(np.log2(np.maximum(size, 1) / LONGEST)).astype(np.int64))
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    signatures: list[list[str]] = [[], []]
    sums = PrefixHash(data)
    ends = np.arange(WINDOW, len(data) + 1)
    hashes = sums.slices(ends - WINDOW, ends) if len(ends) else np.zeros(0, np.uint64)
    some = np.flatnonzero(hashes & np.uint64((1 << LEAST_BITS) - 1) == 0)
    ends, hashes = ends[some], hashes[some]
    doc = np.searchsorted(stop, ends, "left")
    inside = ends - start[np.minimum(doc, len(size) - 1)] >= WINDOW
    ends, hashes, doc = ends[inside], hashes[inside], doc[inside]
    for level in (0, 1):
        mask = (np.uint64(1) << (bits[doc] + level).astype(np.uint64)) - np.uint64(1)
        hit = (hashes & mask) == 0
        at, of = ends[hit], doc[hit]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        keep = (rank < LONGEST - 1) & (at < stop[of])
        at, of = at[keep], of[keep]
        whole = np.flatnonzero(size > 0)  # the last piece ends with the text
        at, of = np.append(at, stop[whole]), np.append(of, whole)
        order = np.lexsort((at, of))
        at, of = at[order], of[order]
        begin = np.maximum(np.append(0, at[:-1]), start[of]) if len(at) else at
        text = _CHARS[(sums.slices(begin, at) & np.uint64(63)).astype(np.int64)].tobytes().decode() if len(at) else ""
        cut = np.searchsorted(of, np.arange(len(size) + 1))
        signatures[level] = [text[a:b] for a, b in zip(cut[:-1], cut[1:])]
    return [f"{1 << b}:{s}:{d}" for b, s, d in zip(bits.tolist(), *signatures)]


def _distances(left: list[str], right: list[str]) -> np.ndarray:
    """Edit distances of many pairs of signatures at once (bit-parallel, a word for each pair)."""
    n = len(left)
    if not n:
        return np.zeros(0, dtype=np.int64)
    la, lb = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    a = np.zeros((n, LONGEST), dtype=np.uint8)
    b = np.zeros((n, LONGEST), dtype=np.uint8)
    for m, texts, sizes in ((a, left, la), (b, right, lb)):
        m[np.arange(LONGEST) < sizes[:, None]] = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    at = np.zeros((n, 128), dtype=np.uint64)
    rows = np.arange(n)
    for i in range(int(la.max(initial=0))):
        live = rows[i < la]
        at[live, a[live, i]] |= np.uint64(1) << np.uint64(i)
    one, top = np.uint64(1), np.uint64(1) << np.maximum(la - 1, 0).astype(np.uint64)
    plus, minus = np.full(n, ~np.uint64(0)), np.zeros(n, dtype=np.uint64)
    score = la.astype(np.int64)
    for j in range(int(lb.max(initial=0))):
        eq = at[rows, b[:, j]]
        x = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(x | plus), plus & x
        live = j < lb
        score += np.where(live & (up & top > 0), 1, 0) - np.where(live & (down & top > 0), 1, 0)
        up, down = (up << one) | one, down << one
        plus, minus = np.where(live, down | ~((eq | minus) | up), plus), np.where(live, up & (eq | minus), minus)
    return np.where(la == 0, lb, score)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """1 less the edit distance over the longer signature, at the best common block size; 0 without one."""
    pairs: tuple[list[str], list[str], list[int]] = ([], [], [])
    for i, (x, y) in enumerate(zip(left, right)):
        (b1, s1, d1), (b2, s2, d2) = x.split(":"), y.split(":")
        for p, q, u, v in ((b1, b2, s1, s2), (2 * int(b1), 2 * int(b2), d1, d2), (b1, 2 * int(b2), s1, d2), (2 * int(b1), b2, d1, s2)):
            if int(p) == int(q):
                pairs[0].append(u)
                pairs[1].append(v)
                pairs[2].append(i)
    out = np.zeros(len(left))
    if pairs[2]:
        longer = np.maximum(1, [max(len(u), len(v)) for u, v in zip(*pairs[:2])])
        np.maximum.at(out, pairs[2], 1 - _distances(*pairs[:2]) / longer)
    return out


def _compared(rows: list[tuple], following: list[tuple]) -> pd.DataFrame:
    """``rows`` and those that follow them: (id, text, fingerprint)."""
    edited = [(t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode() for (_, t, _), (_, nxt, _) in zip(rows, following)]
    marks = fingerprints(edited)
    own = [r[2] for r in rows]
    return pd.DataFrame(
        {
            "doc_id": pd.array([r[0] for r in rows], dtype="Int64"),
            "n_chars": [len(r[1]) for r in rows],
            "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
            "fingerprint": own,
            "edited_fingerprint": marks,
            "near_edited": likeness(own, marks),
            "near_next": likeness(own, [r[2] for r in following]),
        }
    )


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_each: int = 4000) -> DataFrame:
    """Fingerprint every whole text and its edited text, in the order of the ids.

    The edited text has its last half (rounded down, in code points) replaced by as
    many first code points of the next document (or all); the first follows the last.
    Rows of equal id follow each other by text; null ids come first; null texts are
    empty; a lone document follows itself; an empty table gives an empty result.
    Other columns are not read. The texts are dealt by ranges of id and streamed in
    order; only the first and last row of each range meet those of other ranges.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranged = base.repartitionByRange(blocks_of(base, rows_each, 8), "id").sortWithinPartitions("id", "text")

    def run(batches):
        place, held = TaskContext.get().partitionId(), None
        for df in batches:
            texts, ids = df["text"].tolist(), [None if pd.isna(x) else int(x) for x in df["id"]]
            for lo, hi in text_batches(texts):
                rows = list(zip(ids[lo:hi], texts[lo:hi], fingerprints([t.encode() for t in texts[lo:hi]])))
                if held is None:
                    yield _edge(place, "first", rows[0])
                else:
                    rows.insert(0, held)
                held = rows[-1]
                if len(rows) > 1:
                    yield _compared(rows[:-1], rows[1:]).assign(place=place, edge="", text="")
        if held is not None:
            yield _edge(place, "last", held)

    done = materialize(ranged.mapInPandas(run, _RESULT + ", place int, edge string, text string"))
    inner = done.where("edge = ''").drop("place", "edge", "text")
    places = sorted(r[0] for r in done.where("edge = 'first'").select("place").collect())  # a number for each range
    if not places:
        return inner
    follows = F.create_map(*[F.lit(v) for pair in zip(places, places[1:] + places[:1]) for v in pair])
    lasts = done.where("edge = 'last'").select("doc_id", "text", "fingerprint", follows[F.col("place")].alias("place"))
    firsts = done.where("edge = 'first'").select("place", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))

    def close(batches):
        for df in batches:
            if len(df):
                ids = [None if pd.isna(x) else int(x) for x in df["doc_id"]]
                yield _compared(list(zip(ids, df["text"], df["fingerprint"])), [(None, t, f) for t, f in zip(df["next_text"], df["next_fingerprint"])])

    return inner.unionByName(lasts.join(firsts, "place").mapInPandas(close, _RESULT))


def _edge(place: int, edge: str, row: tuple) -> pd.DataFrame:
    return pd.DataFrame(
        {"doc_id": pd.array([row[0]], dtype="Int64"), "n_chars": [0], "edited_sha256": [""], "fingerprint": [row[2]], "edited_fingerprint": [""], "near_edited": [0.0], "near_next": [0.0], "place": [place], "edge": [edge], "text": [row[1]]}
    )
