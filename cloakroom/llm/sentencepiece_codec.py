"""Exact merge-type SentencePiece encoding by backtracking, and decoding.

The normalised text is cut where no piece can span: before each run of word
marks, and, as far as the model's pieces show it, around line breaks and behind
runs of Latin letters. Every distinct segment
is encoded once per worker cache: it is covered left to right by the longest
match of an Aho-Corasick automaton over the pieces, stepping back to the next
shorter match. Two neighbouring
pieces are allowed only if re-merging their joined characters by piece score
gives just these two, which makes the one full cover without a bad neighbour
equal to the merge result. Positions from which no cover exists are marked in a
bit field and never tried again, so the work stays linear in the segment.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame

from cloakroom.llm.common import id_and_text, text_batches

MARK = "▁"
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_WORKER: dict[str, "Codec"] = {}


class Codec:
    """A model's pieces with cached segment encodings."""

    #: Entries of the segment cache; a full cache is emptied (results don't depend on it).
    CACHE = 700_000

    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        sp = self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes_at = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.bytes_at.items()}
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.eos, self.unk = sp.eos_id(), sp.unk_id()
        self.known = {c for p in self.ids for c in p}
        if not self.known <= self.ids.keys() or any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("this model has pieces over unknown characters or word marks inside pieces")
        self.matches = ahocorasick.Automaton()
        for p in self.ids:
            self.matches.add_word(p, len(p))
        self.matches.make_automaton()
        # Where the pieces allow it, a line break stands alone and a segment ends behind its Latin letters.
        self.segment = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        if "\n" not in self.known and not any(re.search(f"[{LETTERS}][^{LETTERS}]", p) for p in self.ids):
            other = f"[^{MARK}{LETTERS}\n]"
            self.segment = re.compile(f"{MARK}*{other}*[{LETTERS}]+|{MARK}*{other}+|{MARK}+|\n")
        self.cache: dict[str, tuple[int, str, str | bytes]] = {}
        self.prefix: dict[str, str] = {}
        self.width = max(map(len, self.ids))
        self.pair_ok: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Plain merging by score, leftmost first among equals (used for joins of two pieces)."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether the two pieces stay apart and whole when their characters are merged anew."""
        key = (left, right)
        ok = self.pair_ok.get(key)
        if ok is None:
            if len(self.pair_ok) >= self.CACHE:
                self.pair_ok.clear()
            ok = self.pair_ok[key] = self.merged(left + right) == ([left, right] if left else [right])
        return ok

    def longest(self, text: str) -> str:
        """The longest piece that starts ``text`` (its first character is one)."""
        head = text[: self.matches.longest_prefix(text)]
        return head if head in self.ids else self.prefix.get(head) or self.shorter(head)

    def shorter(self, piece: str) -> str:
        """The next shorter piece that starts ``piece``, or an empty string."""
        got = self.prefix.get(piece)
        if got is None:
            got = piece[:-1]
            while got and got not in self.ids:
                got = got[:-1]
            self.prefix[piece] = got
        return got

    def cover(self, text: str) -> list[str]:
        """The one cover of ``text`` by pieces whose neighbours are all compatible."""
        n, at, out = len(text), 0, []
        failed = 0  # bit i: no valid cover goes on from a piece boundary at i
        known, ids, shorter, width, reach = self.pair_ok, self.ids, self.prefix, self.width, self.matches.longest_prefix
        prev, piece = "", self.longest(text)
        while True:
            while piece:
                if not (failed and failed >> (at + len(piece)) & 1):
                    ok = known.get((prev, piece))
                    if ok or (ok is None and self.compatible(prev, piece)):
                        break
                piece = shorter.get(piece) or self.shorter(piece)
            if piece:
                out.append(piece)
                at += len(piece)
                if at == n:
                    return out
                prev = piece
                ahead = text[at : at + width]
                head = ahead[: reach(ahead)]
                piece = head if head in ids else shorter.get(head) or self.shorter(head)
            else:
                failed |= 1 << at
                last = out.pop()
                at -= len(last)
                prev = out[-1] if out else ""
                piece = shorter.get(last) or self.shorter(last)

    def encode_segments(self, segments: list[str]) -> None:
        """Put segments into the cache: (number of ids, " id id", what the ids decode to, marks kept)."""
        for seg in segments:
            ids: list[int] = []
            at, n = 0, len(seg)
            while at < n:
                if seg[at] not in self.ids:  # a character of no piece: its bytes
                    ids += [self.byte_id.get(b, self.unk) for b in seg[at].encode()]
                    at += 1
                    continue
                end = at + 1
                while end < n and seg[end] in self.ids:
                    end += 1
                ids += [self.ids[p] for p in self.cover(seg[at:end])]
                at = end
            self.cache[seg] = (len(ids), "".join([f" {i}" for i in ids]), self._shown(ids))

    def encode_texts(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text: number of ids (the end id counted), ids joined by spaces, decoded text."""
        cache = self.cache
        parts = [self.segment.findall(self.sp.normalize(t)) if t else [] for t in texts]
        need = set().union(*parts).difference(cache)
        if len(cache) + len(need) > self.CACHE:
            cache.clear()
            need = set().union(*parts)
        self.encode_segments(list(need))
        out = []
        for p in parts:
            got = [cache[s] for s in p]
            text = "".join([g[2] for g in got])
            if text.startswith(MARK):
                text = text[1:]
            out.append((sum([g[0] for g in got]) + 1, ("".join([g[1] for g in got]) + f" {self.eos}")[1:], text.replace(MARK, " ")))
        return out

    def _shown(self, ids: list[int]) -> str:
        """The pieces of ids with their marks; runs of byte ids as UTF-8 with U+FFFD for each bad byte."""
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + size]).decode())
                    except UnicodeDecodeError:
                        continue
                    at += min(size, len(run) - at)
                    break
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids:
            if i in self.bytes_at:
                run.append(self.bytes_at[i])
                continue
            if run:
                flush()
            if i not in self.control:
                out.append(" ⁇ " if i == self.unk else self.pieces[i])
        flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of any id sequence; the mark that starts it is none of it."""
        text = self._shown(ids)
        return (text[1:] if text.startswith(MARK) else text).replace(MARK, " ")


def codec(model_path: str) -> Codec:
    if model_path not in _WORKER:
        _WORKER[model_path] = Codec(model_path)
    return _WORKER[model_path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode whole texts and decode the ids again.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256`` (with ``with_ids``
    also ``ids array<int>`` and ``decoded``), one row per input row. Null and
    empty texts give the end id alone and an empty decoded text; repeated rows
    give repeated results; a null id stays null; other columns are not read.
    Work is one pass over the scan without a shuffle.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded string"

    def run(batches):
        c = codec(model_path)
        for df in batches:
            texts = df["text"].tolist()
            rows = []
            for lo, hi in text_batches(texts, 1 << 20):
                for n, ids, text in c.encode_texts(texts[lo:hi]):
                    row = (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                    rows.append(row + (([int(x) for x in ids.split(" ")], text) if with_ids else ()))
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] + (["ids", "decoded"] if with_ids else [])
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", df["id"])
            yield out

    return id_and_text(docs, id_col, text_col).mapInPandas(run, schema)
