"""Best-fit packing of token sequences by a configuration linear program.

Only the histogram of piece lengths (at most ``capacity`` rows) reaches the
driver. The covering program over patterns (multisets of lengths that fit one
sequence) is solved by multiplicative weights: a knapsack dynamic program prices
the patterns at the lengths' weights, the best ones are taken, and lengths that
they cover too little gain weight. The average of the rounds is rounded, the program is
solved again for what stays uncovered, and the last few pieces are packed best fit,
length by length, over the histogram. The pieces are numbered within their length in
Spark and take the places of the patterns by that number.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakroom.llm.common import PrefixHash, give_back, id_and_text, lean, text_batches
from cloakroom.session import materialize

#: Token ids of the end marker that follows each document.
END_ID = 0
#: How often the linear program is solved: for all pieces, then for those that rounding left.
SOLVES = 4
#: Salts that split the numbering of one length (a length may hold a third of all pieces).
SALTS = 256
#: Texts of ASCII and Latin-1 letters alone are cut byte by byte.
_OTHER = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ÿ]")
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
#: The pre-tokenizer whose rules allow those cuts (fixed values of the tokenizer's file).
_RULES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_BLANK, _LETTER, _DIGIT, _MARK = range(4)
_KIND = np.full(256, _MARK, dtype=np.uint8)
_KIND[[0x20, 0x0A]] = _BLANK
_KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = _LETTER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[[*range(ord("A"), ord("Z") + 1), *range(0x80, 0x9F)]] += 32  # the second byte of Latin-1 capitals, too
#: Masks of a string's first 0 to 8 bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


class WordIds:
    """Ids of whole texts, with the ids of their strings cached.

    The tokenizer drops white space and never joins characters across it, so a
    text's ids are those of its strings one after the other. It also lower-cases,
    takes digits one by one and never joins letters with what isn't a letter, but
    for what follows an apostrophe; that makes the strings of plain Latin texts
    shorter still. Texts that hold ``<|`` may hold a special token and are cut at
    blanks alone, as are those with other characters. Many texts are cut at once, by
    their bytes, and a string that occurs often in them is looked up once: in a table
    of its hash (64 bits, its length mixed in) and its first eight bytes. The table grows
    with the strings it holds.
    """

    CACHE = 1_200_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocab.values()) + 1, dtype=bool)  # ids that end a word
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.end = np.array([END_ID], dtype="<u4").tobytes()
        spec = json.loads(self.tok.to_str())
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.plain = bool(steps) and steps[0].get("pattern", {}).get("Regex") == _RULES
        if self.plain:  # the same model for words of small letters, which need no normalizing and no rules
            spec["normalizer"], steps[0] = None, {"type": "WhitespaceSplit"}
            self.letters = Tokenizer.from_str(json.dumps(spec))
        self._forget()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, the end id included."""
        easy = [self.plain and (t.isascii() or not _OTHER.search(t)) and "<|" not in t for t in texts]
        fine = iter(self._encode([t.encode() for t, e in zip(texts, easy) if e], True))
        coarse = iter(self._encode([t.encode() for t, e in zip(texts, easy) if not e], False))
        return [next(fine if e else coarse) + self.end for e in easy]

    def _encode(self, raw: list[bytes], fine: bool) -> list[bytes]:
        if not raw:
            return []
        data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        if fine:
            data = _LOWER[data]
            kind = _KIND[data]
        else:
            kind = np.where(_KIND[data] == _BLANK, np.uint8(_BLANK), np.uint8(_LETTER))
        apart = kind != np.concatenate(([np.uint8(_BLANK)], kind[:-1]))
        if fine:
            apart |= kind == _DIGIT
            apart[1:] &= (kind[1:] != _LETTER) | (data[:-1] != ord("'"))
        edge = np.flatnonzero(apart)  # ends with the last newline
        word = np.flatnonzero(kind[edge] != _BLANK)
        stops = np.searchsorted(edge[word], np.cumsum([len(r) + 1 for r in raw]))
        if not len(word):
            return [b""] * len(raw)
        start, end = edge[word], edge[word + 1]
        keys, first, which = np.unique(PrefixHash(data).slices(start, end), return_index=True, return_inverse=True)
        rows = self._rows(data, start[first], end[first], keys)[which]
        sizes = self.size[rows]
        ends = np.cumsum(sizes)
        flat = self.ids[np.repeat(self.at[rows] - ends + sizes, sizes) + np.arange(ends[-1])]
        cut = np.concatenate(([0], ends))[stops].tolist()
        return [flat[a:b].tobytes() for a, b in zip([0, *cut[:-1]], cut)]

    def _forget(self, least: int = 0) -> None:
        """Empty the cache: slots of (hash, first bytes, row), and the rows' places and sizes in one array of ids.

        It holds ``least`` strings, if one text has that many, and ``CACHE`` otherwise.
        """
        room = max(self.CACHE, least)
        self.n, self.used = 0, 0
        self._open(min(1 << 16, 1 << (room * 3 // 2).bit_length()))
        self.ids = np.zeros(1 << 16, dtype="<u4")
        self.at, self.size = np.zeros(room, dtype=np.int64), np.zeros(room, dtype=np.int64)

    def _open(self, slots: int) -> None:
        self.slots = slots
        self.slot_key, self.slot_head = np.zeros(slots, dtype=np.uint64), np.zeros(slots, dtype=np.uint64)
        self.slot_row = np.full(slots, -1, dtype=np.int64)

    def _find(self, keys: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Cached rows, -1 where there is none."""
        rows = np.full(len(keys), -1, dtype=np.int64)
        slot, left = (keys % np.uint64(self.slots)).astype(np.int64), np.arange(len(keys))
        while len(left):
            there = self.slot_row[slot]
            hit = (there >= 0) & (self.slot_key[slot] == keys[left]) & (self.slot_head[slot] == heads[left])
            rows[left[hit]] = there[hit]
            on = (there >= 0) & ~hit
            left, slot = left[on], (slot[on] + 1) % self.slots
        return rows

    def _store(self, keys: np.ndarray, heads: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        rows = np.arange(self.n, self.n + len(keys))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[rows], self.size[rows] = self.used + np.cumsum(sizes) - sizes, sizes
        self.n, self.used = self.n + len(keys), self.used + len(ids)
        if self.n * 3 > self.slots * 2:  # two thirds full at most
            taken = np.flatnonzero(self.slot_row >= 0)
            old = self.slot_key[taken], self.slot_head[taken], self.slot_row[taken]
            self._open(1 << (self.n * 3 // 2).bit_length())
            self._place(*old)
        self._place(keys, heads, rows)

    def _place(self, keys: np.ndarray, heads: np.ndarray, rows: np.ndarray) -> None:
        slot, left = (keys % np.uint64(self.slots)).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = self.slot_row[slot] < 0
            self.slot_row[slot[free]] = rows[left[free]]
            own = self.slot_row[slot] == rows[left]  # of several for one slot the last has it
            self.slot_key[slot[own]], self.slot_head[slot[own]] = keys[left[own]], heads[left[own]]
            left, slot = left[~own], (slot[~own] + 1) % self.slots

    def _rows(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The cached rows of different strings; those that aren't there yet are encoded."""
        eights = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(8, dtype=np.uint8)), 8)
        heads = np.ascontiguousarray(eights[start]).view("<u8").ravel() & _FIRST[np.minimum(end - start, 8)]
        rows = self._find(keys, heads)
        new = np.flatnonzero(rows < 0)
        if not len(new):
            return rows
        if self.n + len(new) > self.CACHE:
            self._forget(len(keys))
            new = np.arange(len(keys))
        whole = data.tobytes()
        words = [whole[a:b].decode() for a, b in zip(start[new].tolist(), end[new].tolist())]
        letters = np.array([bool(self.plain and _LETTERS.fullmatch(w)) for w in words])
        # words of letters alone go through the tokenizer many at once: each ends with its one closing id
        for lo in range(0, len(plain := np.flatnonzero(letters)), 5000):
            some = plain[lo : lo + 5000]
            ids = np.array(self.letters.encode_batch_fast([" ".join([words[i] for i in some.tolist()])], add_special_tokens=False)[0].ids, dtype="<u4")
            stop = np.flatnonzero(self.closes[ids]) + 1
            if len(stop) != len(some):
                raise ValueError("the tokenizer doesn't close each word once")
            self._store(keys[new[some]], heads[new[some]], ids, np.diff(stop, prepend=0))
        for lo in range(0, len(others := np.flatnonzero(~letters)), 2048):
            some = others[lo : lo + 2048]
            found = [e.ids for e in self.tok.encode_batch_fast([words[i] for i in some.tolist()], add_special_tokens=False)]
            self._store(keys[new[some]], heads[new[some]], np.array([i for x in found for i in x], dtype="<u4"), np.array([len(x) for x in found]))
        return self._find(keys, heads)


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids`` as little-endian bytes) per piece."""

    def run(batches):
        words = WordIds(tokenizer_path)
        give_back()  # what reading the tokenizer took
        width = 4 * capacity
        for df in batches:
            texts, ids = df["text"].tolist(), df["id"].tolist()
            for lo, hi in text_batches(texts, 1 << 19):
                rows = []
                for doc_id, data in zip(ids[lo:hi], words.encode(texts[lo:hi])):
                    for k, at in enumerate(range(0, len(data), width)):
                        part = data[at : at + width]
                        rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
                out["doc_id"] = pd.array([None if pd.isna(x) else int(x) for x in out["doc_id"]], dtype="Int64")
                yield out

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return id_and_text(docs, id_col, text_col).mapInPandas(lean(run), schema)


def _price(weight: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack over lengths: best value within each capacity, and the length taken last (0: none)."""
    lengths = np.flatnonzero(weight > 0)
    value = np.zeros(capacity + 1)
    last = np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        fit = lengths[: np.searchsorted(lengths, c, "right")]
        if len(fit):
            got = value[c - fit] + weight[fit]
            k = int(got.argmax())
            if got[k] > value[c - 1]:
                value[c], last[c] = got[k], fit[k]
                continue
        value[c] = value[c - 1]
    return value, last


def _pattern(first: int, last: np.ndarray, capacity: int) -> dict[int, int]:
    out = {first: 1}
    room = capacity - first
    while room > 0:
        if last[room]:
            out[int(last[room])] = out.get(int(last[room]), 0) + 1
            room -= int(last[room])
        else:
            room -= 1
    return out


def _fractional(counts: np.ndarray, capacity: int, rounds: int, rate: float = 0.3, near: float = 0.03) -> dict[tuple, float]:
    """Multiplicative weights on the covering program; patterns with their average amounts.

    Each round prices patterns at the weights and spends the weights' own bound on the
    number of sequences on the patterns worth nearly as much as the best one; then the
    weights of lengths covered too little rise and those of the others fall.
    """
    lengths = np.flatnonzero(counts)
    demand = counts[lengths].astype(float)
    weight = lengths / capacity  # full patterns are worth 1
    amounts: dict[tuple, float] = {}
    for step in range(1, rounds + 1):
        prices = np.zeros(capacity + 1)
        prices[lengths] = weight
        value, last = _price(prices, capacity)
        worth = (weight + value[capacity - lengths]) / value[capacity]  # of the best pattern with each length
        heads = np.flatnonzero(worth >= 1 - near)
        patterns = [_pattern(int(lengths[i]), last, capacity) for i in heads]
        times = np.array([demand[i] / p[int(lengths[i])] for i, p in zip(heads, patterns)])
        times *= (demand * weight).sum() / value[capacity] / times.sum()
        cover = np.zeros(capacity + 1)
        for pattern, n in zip(patterns, times):
            key = tuple(sorted(pattern.items(), reverse=True))
            amounts[key] = amounts.get(key, 0.0) + n / rounds
            for v, k in pattern.items():
                cover[v] += k * n
        weight = weight * np.exp(rate / np.sqrt(step) * np.clip((demand - cover[lengths]) / demand, -1, 1))
        weight /= weight.max()
    return amounts


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Pack a histogram longest first; each gap is closed by the one, two or three lengths that fill it best."""
    left = left.copy()
    out = []
    while True:
        have = np.flatnonzero(left)
        if not len(have):
            return out
        pattern: dict[int, int] = {}

        def take(v: int, pattern=pattern) -> int:
            pattern[v] = pattern.get(v, 0) + 1
            return v

        def there(v: np.ndarray | int, pattern=pattern):
            used = np.zeros(capacity + 1, dtype=np.int64)
            for a, n in pattern.items():
                used[a] = n
            return left[v] - used[v] > 0

        room = capacity - take(int(have[-1]))
        while room > 0:
            fit = have[have <= room]
            fit = fit[there(fit)] if len(fit) else fit
            if not len(fit):
                break
            if fit[-1] == room:
                room -= take(room)
                break
            pair = fit[there(room - fit) & ((2 * fit != room) | (left[fit] - [pattern.get(int(x), 0) for x in fit] > 1))]
            if len(pair):
                a = int(pair[-1])
                take(a)
                room -= a
                room -= take(room)
                break
            room -= take(int(fit[-1]))
        times = min(int(left[v]) // n for v, n in pattern.items())
        for v, n in pattern.items():
            left[v] -= n * times
        out.append((pattern, times))


def plan(histogram: dict[int, int], capacity: int, rounds: int = 60) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> how many) with the number of sequences of each; places match the histogram exactly.

    The linear program's amounts are rounded, fullest patterns first, as far as there are
    lengths left; the program is solved again for what is left, up to ``SOLVES`` times; the
    rest is packed best fit. Rounding up leaves less, rounding down wastes less where most
    lengths occur only a few times. Of the plans so made the one with the fewest sequences is
    taken, of equal ones that with the most from the program.
    """
    whole = np.zeros(capacity + 1, dtype=np.int64)
    for v, n in histogram.items():
        whole[v] = n
    if not whole.any():
        return []
    first, best = _fractional(whole, capacity, rounds), None
    for nearest, solves in ((np.ceil, SOLVES), (np.floor, 1)):
        left, out, placed = whole.copy(), [], 0
        for k in range(solves):
            amounts = first if k == 0 else _fractional(left, capacity, rounds)
            for key, amount in sorted(amounts.items(), key=lambda x: (capacity - sum(a * n for a, n in x[0]), -x[1], x[0])):
                times = min(int(nearest(amount)), *(int(left[v]) // n for v, n in key))
                if times > 0:
                    for v, n in key:
                        left[v] -= n * times
                    out.append((dict(key), times))
                    placed += times
            rest = _best_fit(left, capacity)
            total = placed + sum(t for _, t in rest)
            if best is None or (total, -placed) < best[:2]:
                best = (total, -placed, out + rest)
            if not left.any():
                break
    return best[2]


def _places(patterns: list[tuple[dict[int, int], int]], capacity: int) -> pd.DataFrame:
    """Per pattern and slot: the piece numbers (within the length) that take it.

    Bounded by the rounds and the capacity, not by the data: at most
    ``(SOLVES * rounds + 1) * capacity`` patterns of few slots each.
    """
    seen = np.zeros(capacity + 1, dtype=np.int64)
    rows, base = [], 0
    for pattern, times in patterns:
        offset = 0
        for v, n in sorted(pattern.items(), reverse=True):
            for _ in range(n):
                rows.append((v, int(seen[v]), base, offset))
                seen[v] += times
                offset += v
        base += times
    return pd.DataFrame(rows, columns=["v", "first", "base", "offset"]).sort_values(["v", "first"], ignore_index=True)


def pack(pieces: DataFrame, capacity: int = 2048, rounds: int = 60) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces with a ``length`` of 1 to ``capacity``.

    Any other columns stay. Ties and repeated rows are different pieces; an
    empty table gives an empty result; pieces of null or out-of-range length are
    not part of the domain and raise. The pieces are written to the checkpoint
    folder once (histogram and places must see the same rows), numbered within
    length and salt, and never gathered.
    """
    spark = pieces.sparkSession
    marked = pieces.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in pieces.columns if c in ("doc_id", "piece", "start")], F.col("length")), F.lit(SALTS)).cast("int"))
    marked = materialize(marked)
    cells = marked.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    before = cells.select("length", "_salt", (F.sum("n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("n")).alias("_before"))
    rows = marked.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    if any(r["length"] is None or not 0 < r["length"] <= capacity for r in rows):
        raise ValueError("piece lengths must be between 1 and the capacity")
    table = _places(plan({r["length"]: r["n"] for r in rows}, capacity, rounds), capacity)
    starts = np.searchsorted(table["v"].to_numpy(), np.arange(capacity + 2))
    shared = spark.sparkContext.broadcast((starts, table["first"].to_numpy(), table["base"].to_numpy(), table["offset"].to_numpy()))
    numbered = marked.withColumn(
        "_nth", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*[F.col(f"`{c}`") for c in pieces.columns if c in ("doc_id", "piece", "start")] or [F.lit(0)]))
    ).join(before, ["length", "_salt"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        start, first, base, offset = shared.value
        v, i = length.to_numpy(), number.to_numpy()
        seq, off = np.zeros(len(v), dtype=np.int64), np.zeros(len(v), dtype=np.int64)
        for x in np.unique(v):
            lo, hi = start[x], start[x + 1]
            at = np.flatnonzero(v == x)
            k = lo + np.searchsorted(first[lo:hi], i[at], "right") - 1
            seq[at], off[at] = base[k] + i[at] - first[k], offset[k]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    got = numbered.withColumn("_at", place("length", F.col("_before") + F.col("_nth") - 1))
    return got.select(*[F.col(f"`{c}`") for c in pieces.columns], "_at.sequence_id", "_at.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize whole texts, cut those over ``capacity`` and pack all pieces.

    Null and empty texts are the end id alone. Rows with equal or null ids are
    packed like any other. Other columns are not read.
    """
    return pack(pieces_of(docs, tokenizer_path, capacity, id_col, text_col), capacity)
