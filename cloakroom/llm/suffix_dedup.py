"""Removal of byte strings that occur more than once, by a logarithmic family of suffix arrays.

Only suffixes that can matter are indexed. Every ``length``-byte window holds an
anchor: the least hash among its ``ANCHOR``-byte strings, a choice that depends
on the window's bytes alone, so equal windows have equal anchors at equal places.
Consecutive windows with one anchor form a run. The corpus is asked (see
``chunks``) how often each anchor, and each whole run, occurs:

* an anchor that occurs in one run only has no repeated window;
* a run that occurs again as a whole is repeated throughout;
* the rest (runs that share an anchor but differ somewhere) send their bytes to
  the suffix index of their anchor's bucket. There the batches get suffix arrays
  one after the other; a new array is merge-scanned against the existing levels
  for matches of the full length; levels of equal size merge.

An anchor shared by more than ``CROWD`` different runs (a boilerplate passage in a
large part of all documents) would make one bucket grow without bound; the windows
of such runs are compared as 64-bit hashes in the same way as the runs, once for
each chunk. Both ways find the same windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakroom.llm.chunks import buckets_for, chunked, cuts
from cloakroom.llm.common import PrefixHash, mix64
from cloakroom.sources.tables import spread

ANCHOR = 64
CROWD = 2000
_SEGMENT = 1 << 19  # window starts handled at once
_PLACE_BITS = 24

# what a bucket says about a run
NONE, REPEATED, OPEN, SAMPLE, OPEN_CROWD, SAMPLE_CROWD = range(6)


class SuffixFamily:
    """Sorted arrays of suffixes (by their first ``length`` bytes) in levels of doubling size."""

    def __init__(self, length: int):
        self.kind = f"S{length}"
        self.length = length
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.repeated = np.zeros(0, dtype=bool)

    def add(self, text: np.ndarray, starts: np.ndarray) -> None:
        """Index the suffixes of a batch; sets ``repeated`` for them and for those that they match."""
        base = len(self.repeated)
        self.repeated = np.append(self.repeated, np.zeros(len(starts), dtype=bool))
        windows = np.lib.stride_tricks.sliding_window_view(text, self.length)[starts]
        keys = np.ascontiguousarray(windows).view(self.kind).ravel()
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], base + order
        same = keys[1:] == keys[:-1]
        self.repeated[owner[1:][same]] = True
        self.repeated[owner[:-1][same]] = True
        for other, other_owner in self.levels:
            at = np.minimum(np.searchsorted(other, keys), len(other) - 1)
            hit = other[at] == keys
            self.repeated[owner[hit]] = True
            self.repeated[other_owner[at[hit]]] = True
        self.levels.append((keys, owner))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= len(self.levels[-1][0]):
            (k1, o1), (k2, o2) = self.levels[-2:]
            keys, owner = np.concatenate((k1, k2)), np.concatenate((o1, o2))
            order = np.argsort(keys, kind="stable")
            self.levels[-2:] = [(keys[order], owner[order])]


class _Bytes:
    """The runs of a chunk's documents, the documents in a fixed order."""

    def __init__(self, df: pd.DataFrame, length: int):
        texts = [t.encode() for t in df["text"]]
        ids = [(pd.isna(x), 0 if pd.isna(x) else int(x)) for x in df["id"]]
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids = [None if ids[i][0] else ids[i][1] for i in self.order]
        self.texts = [texts[i] for i in self.order]
        self.length = length
        self.offset = np.concatenate(([0], np.cumsum([len(t) for t in self.texts]))).astype(np.int64)
        self.buffer = np.frombuffer(b"".join(self.texts), dtype=np.uint8)
        parts = [self._runs(lo, min(lo + _SEGMENT, len(self.buffer) - length + 1)) for lo in range(0, max(0, len(self.buffer) - length + 1), _SEGMENT)]
        parts = parts or [[np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * 2]
        self.first, self.last, self.anchor, self.content = (np.concatenate(x) for x in zip(*parts))
        # distinct (anchor, content) entries in the order of the anchors
        by = np.lexsort((self.content, self.anchor))
        a, c = self.anchor[by], self.content[by]
        new = np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1]))[: len(by)]
        self.entry = np.empty(len(by), dtype=np.int64)
        self.entry[by] = np.cumsum(new) - 1
        self.sample = by[new]  # one run of each entry
        self.anchors, self.contents = a[new], c[new]
        self.many = np.bincount(self.entry, minlength=len(self.sample)) > 1

    def _runs(self, lo: int, hi: int) -> list[np.ndarray]:
        """Runs among the window starts ``lo`` to ``hi - 1``."""
        n, width = self.length, self.length - ANCHOR + 1
        data = self.buffer[lo : hi - 1 + n]
        sums = PrefixHash(data)
        starts = np.arange(len(data) - ANCHOR + 1)
        hashes = sums.slices(starts, starts + ANCHOR)
        low = np.uint64((1 << _PLACE_BITS) - 1)
        ranked = (hashes & ~low) | starts.astype(np.uint64)  # equal hashes: the leftmost
        blocks = -(-len(ranked) // width)
        padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
        padded[: len(ranked)] = ranked
        padded = padded.reshape(blocks, width)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        behind = np.ascontiguousarray(np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1]).ravel()
        count = hi - lo
        least = np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])
        place = (least & low).astype(np.int64)
        ends = self.offset[1:]
        at = np.arange(lo, hi)
        inside = at + n <= ends[np.searchsorted(ends, at, "right")]
        change = np.append(True, (place[1:] != place[:-1]) | ~inside[:-1])
        first = np.flatnonzero(change & inside)
        stop = np.append(np.flatnonzero(change | ~inside), count)
        last = stop[np.searchsorted(stop, first, "right")] - 1
        where = place[first]
        content = sums.slices(first, last + n) ^ mix64((where - first).astype(np.uint64) + np.uint64(1))
        # anchors are small hashes by their choice; mixed again they spread over the buckets' ranges
        return [first + lo, last + lo, mix64(hashes[where] + np.uint64(1)), content]

    def contexts(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of one run of each entry, joined, and the window starts in them."""
        a, b = self.first[self.sample[entries]], self.last[self.sample[entries]]
        size = b - a + self.length
        text = self.buffer[np.repeat(a - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())]
        windows = b - a + 1
        starts = np.repeat(np.append(0, np.cumsum(size)[:-1]) - np.append(0, np.cumsum(windows)[:-1]), windows) + np.arange(windows.sum())
        return text, starts

    def windows(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start in the buffer and 64-bit hash of all windows of the entries' runs."""
        text, starts = self.contexts(entries)
        a, b = self.first[self.sample[entries]], self.last[self.sample[entries]]
        n = b - a + 1
        at = np.repeat(a - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        return at, PrefixHash(text).slices(starts, starts + self.length) if len(text) else np.zeros(0, np.uint64)


def _codes(c: _Bytes, answers: pd.DataFrame, nb: int) -> np.ndarray:
    out = np.zeros(len(c.anchors), dtype=np.uint8)
    cut = cuts(c.anchors, nb)
    for b, data in zip(answers["bucket"], answers["answer"]):
        out[cut[b] : cut[b + 1]] = np.frombuffer(data, dtype=np.uint8)
    return out


def _judge_runs(df: pd.DataFrame, most: int) -> pd.DataFrame:
    """Codes for every run that the chunks sent to one bucket of anchors."""
    parts = [np.frombuffer(b, dtype="<u8").reshape(2, -1) for b in df["block"]]
    sizes = [p.shape[1] for p in parts]
    anchors, contents = np.concatenate(parts, axis=1)
    times = 1 + np.concatenate([np.unpackbits(np.frombuffer(m, dtype=np.uint8), count=n) for m, n in zip(df["meta"], sizes)]).astype(np.int64)
    order = np.lexsort((contents, anchors))
    a, c = anchors[order], contents[order]
    new_anchor = np.append(True, a[1:] != a[:-1])
    new_run = new_anchor | np.append(True, c[1:] != c[:-1])
    run = np.cumsum(new_run) - 1
    group = (np.cumsum(new_anchor) - 1)[new_run]
    repeated = np.bincount(run, weights=times[order]) > 1
    runs_of, lone_of = np.bincount(group), np.bincount(group, weights=~repeated)
    code = np.where(repeated, REPEATED, np.where(runs_of[group] > 1, OPEN, NONE))
    sample = repeated & (lone_of[group] > 0)
    crowd = runs_of[group] > most
    code = np.where(crowd & (code == OPEN), OPEN_CROWD, code)[run]
    code = np.where(new_run & sample[run], np.where(crowd[run], SAMPLE_CROWD, SAMPLE), code)
    out = np.empty(len(order), dtype=np.uint8)
    out[order] = code
    ends = np.cumsum(sizes)
    return pd.DataFrame({"chunk": df["chunk"], "bucket": df["bucket"], "answer": [out[e - n : e].tobytes() for n, e in zip(sizes, ends)]})


def _index_bucket(df: pd.DataFrame, length: int, batch: int = 1 << 16) -> list[bytes]:
    """Run the batches of one bucket through a suffix family; a bit for each window sent."""
    family = SuffixFamily(length)
    texts, starts, base, held, sizes = [], [], 0, 0, []
    for block, meta in zip(df["block"], df["meta"]):
        text, at = np.frombuffer(block, dtype=np.uint8), np.frombuffer(meta, dtype="<u4").astype(np.int64)
        texts.append(text)
        starts.append(at + base)
        base, held = base + len(text), held + len(at)
        sizes.append(len(at))
        if held >= batch:
            family.add(np.concatenate(texts), np.concatenate(starts))
            texts, starts, base, held = [], [], 0, 0
    if held:
        family.add(np.concatenate(texts), np.concatenate(starts))
    ends = np.cumsum(sizes)
    return [np.packbits(family.repeated[e - n : e]).tobytes() for n, e in zip(sizes, ends)]


def _judge_windows(df: pd.DataFrame) -> list[bytes]:
    parts = [np.frombuffer(b, dtype="<u8") for b in df["block"]]
    times = 1 + np.concatenate([np.unpackbits(np.frombuffer(m, dtype=np.uint8), count=len(p)) for m, p in zip(df["meta"], parts)]).astype(np.int64)
    _, which = np.unique(np.concatenate(parts), return_inverse=True)
    hit = (np.bincount(which, weights=times) > 1)[which]
    ends = np.cumsum([len(p) for p in parts])
    return [np.packbits(hit[e - len(p) : e]).tobytes() for p, e in zip(parts, ends)]


def remove_repeated_bytes(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False, crowd: int = CROWD) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts anywhere else.

    Texts are whole UTF-8 byte strings; matches never cross documents; overlapping
    matches and those within one document count; strings are judged on the input.
    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per input row, with
    ``with_spans`` also ``spans array<struct<start, end>>``. Null and empty texts, and
    those shorter than ``length``, keep everything. Repeated rows and rows of equal or
    null id are different documents (so both lose what they share). Other columns are
    not read; an empty table gives an empty result. ``length`` must exceed ``ANCHOR``;
    ``crowd`` only moves work between the two ways to compare windows.
    """
    if length <= ANCHOR:
        raise ValueError(f"length must exceed {ANCHOR}")
    plan = chunked(spread(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))))
    nb = buckets_for(plan.text_bytes // 60 + 1, 17, 4 << 20)
    nb2 = buckets_for(plan.text_bytes, 1, 2 << 20)

    def send(df: pd.DataFrame) -> pd.DataFrame:
        c = _Bytes(df, length)
        cut = cuts(c.anchors, nb)
        rows = []
        for b in range(nb):
            lo, hi = cut[b], cut[b + 1]
            if hi > lo:
                rows.append((b, df["chunk"].iloc[0], np.concatenate((c.anchors[lo:hi], c.contents[lo:hi])).tobytes(), np.packbits(c.many[lo:hi]).tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "chunk", "block", "meta"])

    sent = plan.docs.groupBy("chunk").applyInPandas(send, "bucket int, chunk long, block binary, meta binary")
    answers = sent.groupBy("bucket").applyInPandas(lambda df: _judge_runs(df, crowd), "chunk long, bucket int, answer binary")

    def selected(c: _Bytes, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Entries for the suffix index by bucket, their buckets, and entries of crowded anchors."""
        cold = np.flatnonzero((code == OPEN) | (code == SAMPLE))
        bucket = (mix64(c.anchors[cold]) % np.uint64(nb2)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        hot = np.flatnonzero((code == OPEN_CROWD) | (code == SAMPLE_CROWD))
        return cold[by], bucket[by], np.append(np.flatnonzero(np.append(True, np.diff(bucket[by]) != 0)), len(by)) if len(by) else np.zeros(1, np.int64), hot

    def open_runs(df: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        columns = ["kind", "bucket", "chunk", "block", "meta"]
        if not len(df):
            return pd.DataFrame(columns=columns)
        c, chunk = _Bytes(df, length), int(df["chunk"].iloc[0])
        code = _codes(c, replies, nb)
        rows = [(2, chunk, chunk, code.tobytes(), b"")]  # the chunk's own codes, for the last step
        cold, bucket, edge, hot = selected(c, code)
        for a, b in zip(edge[:-1], edge[1:]):
            text, starts = c.contexts(cold[a:b])
            rows.append((0, int(bucket[a]), chunk, text.tobytes(), starts.astype("<u4").tobytes()))
        if len(hot):
            hashes, times = np.unique(c.windows(hot)[1], return_counts=True)
            cut = cuts(hashes, nb)
            for b in range(nb):
                if cut[b + 1] > cut[b]:
                    rows.append((1, b, chunk, hashes[cut[b] : cut[b + 1]].tobytes(), np.packbits(times[cut[b] : cut[b + 1]] > 1).tobytes()))
        return pd.DataFrame(rows, columns=columns)

    opened = plan.docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(open_runs, "kind int, bucket long, chunk long, block binary, meta binary")

    def judge(df: pd.DataFrame) -> pd.DataFrame:
        kind = df["kind"].iloc[0]
        answer = df["block"] if kind == 2 else _index_bucket(df, length) if kind == 0 else _judge_windows(df)
        return pd.DataFrame({"chunk": df["chunk"], "kind": df["kind"], "bucket": df["bucket"], "answer": answer})

    replies = opened.groupBy("kind", "bucket").applyInPandas(judge, "chunk long, kind int, bucket long, answer binary")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["spans"] if with_spans else [])

    def cut_out(df: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(df):
            return pd.DataFrame(columns=names)
        c = _Bytes(df, length)
        by_key = {(k, b): a for k, b, a in zip(replies["kind"], replies["bucket"], replies["answer"])}
        code = np.frombuffer(by_key[2, int(df["chunk"].iloc[0])], dtype=np.uint8)
        edge = np.zeros(len(c.buffer) + 1, dtype=np.int64)
        whole = np.isin(code, (REPEATED, SAMPLE, SAMPLE_CROWD))[c.entry]
        np.add.at(edge, c.first[whole], 1)
        np.add.at(edge, c.last[whole] + length, -1)
        cold, bucket, cut, hot = selected(c, code)
        for a, b in zip(cut[:-1], cut[1:]):
            at, _ = c.windows(cold[a:b])
            hit = np.unpackbits(np.frombuffer(by_key[0, int(bucket[a])], dtype=np.uint8), count=len(at)).astype(bool)
            np.add.at(edge, at[hit], 1)
            np.add.at(edge, at[hit] + length, -1)
        if len(hot):
            at, hashes = c.windows(hot)
            unique, which = np.unique(hashes, return_inverse=True)
            where, hit = cuts(unique, nb), np.zeros(len(unique), dtype=bool)
            for b in range(nb):
                n = where[b + 1] - where[b]
                if n:
                    hit[where[b] : where[b + 1]] = np.unpackbits(np.frombuffer(by_key[1, b], dtype=np.uint8), count=n).astype(bool)
            hit = hit[which]
            np.add.at(edge, at[hit], 1)
            np.add.at(edge, at[hit] + length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        rows = []
        for k, i in enumerate(c.ids):
            mine = gone[c.offset[k] : c.offset[k + 1]]
            removed = int(mine.sum())
            if removed:
                flips = np.flatnonzero(np.diff(np.concatenate(([0], mine.astype(np.int8), [0]))))
                kept = c.buffer[c.offset[k] : c.offset[k + 1]][~mine].tobytes()
            else:
                flips, kept = np.zeros(0, np.int64), c.texts[k]
            row = (i, len(mine), removed, len(flips) // 2, hashlib.sha256(kept).hexdigest())
            rows.append(row + ([{"start": int(a), "end": int(b)} for a, b in zip(flips[::2], flips[1::2])],) if with_spans else row)
        out = pd.DataFrame(rows, columns=names)
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<struct<start: long, end: long>>" if with_spans else "")
    return plan.docs.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(cut_out, schema)
