"""Toxicity scores from a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, unifies compatibility forms, maps homoglyphs of other alphabets
to Latin letters, and reads digits and signs inside a word as the letters they stand
for. Marks stay on letters: words of several languages differ by them alone. The lexicon (whole words and word beginnings) and its weights come from labelled
rows; so do the exception phrases (a term's whole word, alone or with a neighbour)
that keep a hit from counting. Hits, normalised by length, go through a logistic
calibration.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakroom.llm.common import give_back, held_out, lean
from cloakroom.session import materialize

#: Labelled rows to learn from, at most about so many (chosen by a hash of their id).
SAMPLE_ROWS = 12_000
#: Terms that the lexicon holds at most.
MOST_TERMS = 400
#: Likelihood ratio statistic that a term must reach.
LEAST_GAIN = 20
#: Letters of other alphabets that look like Latin ones.
HOMOGLYPHS = dict(zip("аеорсухіјѕһԁӏкмтвнɡαεορικντυχɑ", "aeopcyxijshdlkmtbhgaeopikvtuxa"))
#: Digits and signs that stand for a letter inside a word.
SUBSTITUTES = dict(zip("0134578@$!", "oieastbasi"))
_FOLDED: dict[str, str] = {}
#: Strings of letters and substitutes that hold both side by side.
_MIXED = re.compile(r"(?<![a-z0-9@$!])(?=[a-z0-9@$!]*?(?:[a-z][0-9@$!]|[0-9@$!][a-z]))[a-z0-9@$!]++")
_READ = str.maketrans(SUBSTITUTES)
_WORD = re.compile(r"[^\W\d_]+")


def _latin(m: re.Match) -> str:
    run = m.group()
    got = _FOLDED.get(run)
    if got is None:
        if len(_FOLDED) > 50_000:
            _FOLDED.clear()
        got = _FOLDED[run] = "".join(HOMOGLYPHS.get(c, c) for c in unicodedata.normalize("NFKC", run).casefold())
    return got


def fold(text: str) -> str:
    text = text.casefold()
    if not text.isascii():
        text = re.sub("[^\x00-\x7f]+", _latin, text)
    return _MIXED.sub(_read, text)


def _read(m: re.Match) -> str:
    word = m.group()
    core = word.rstrip("@$!")  # signs behind a word are no letters
    return core.translate(_READ) + word[len(core) :]


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)  # "$" at the end: whole word only
    exceptions: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)  # of the features, the constant first; empty: nothing learned


class Matcher:
    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        self.terms = ahocorasick.Automaton()
        by_text: dict[str, list[tuple[bool, float]]] = {}
        for term, w in model.terms.items():
            by_text.setdefault(term.rstrip("$"), []).append((term.endswith("$"), w))
        for text, kinds in by_text.items():
            self.terms.add_word(text, (len(text), kinds))
        self.exceptions = ahocorasick.Automaton()
        for text in model.exceptions:
            self.exceptions.add_word(text, len(text))
        for a in (self.terms, self.exceptions):
            if len(a):
                a.make_automaton()

    def hits(self, folded: str):
        """(start, end, weight) of each hit: at a word's beginning, whole words where so marked."""
        if not len(self.terms):
            return
        n = len(folded)
        for last, (size, kinds) in self.terms.iter(folded):
            lo, hi = last - size + 1, last + 1
            if lo and folded[lo - 1].isalpha():
                continue
            ends = hi == n or not folded[hi].isalpha()
            found = [w for whole, w in kinds if ends or not whole]
            if found:
                yield lo, hi, max(found)

    def features(self, text: str) -> list[float]:
        folded = fold(text)
        found = list(self.hits(folded))
        if found and len(self.exceptions):
            spared = [(last - size + 1, last + 1) for last, size in self.exceptions.iter(folded) if _bounded(folded, last - size + 1, last + 1)]
            found = [h for h in found if not any(a <= h[0] and h[1] <= b for a, b in spared)]
        # of the terms that begin at one place the heaviest counts
        best: dict[int, float] = {}
        for lo, _, w in found:
            best[lo] = max(w, best.get(lo, 0.0))
        total, words = sum(best.values()), max(1, folded.count(" ") + folded.count("\n") + 1)
        return [1.0, math.log1p(total), math.log1p(100 * total / words), float(bool(best)), float(len(best) > 1), math.log1p(words)]


def _bounded(text: str, lo: int, hi: int) -> bool:
    return (lo == 0 or not text[lo - 1].isalpha()) and (hi == len(text) or not text[hi].isalpha())


def _candidates(folded: str) -> set[str]:
    out = set()
    for w in set(_WORD.findall(folded)):
        if len(w) > 2:
            out.add(w + "$")
            out.update(w[:k] for k in range(4, min(9, len(w))))
    return out


def _sketch(folded: str) -> int:
    """The least hash of five-word strings: near copies mostly share it."""
    import zlib

    words = folded.split()
    return min((zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))), default=0)


def _gain(a: float, b: float, n1: float, n0: float) -> float:
    """Likelihood ratio statistic of a term in ``a`` of ``n1`` and ``b`` of ``n0`` documents."""

    def part(x: float, y: float) -> float:
        return x * math.log(x / y) if x > 0 else 0.0

    share = (a + b) / (n1 + n0)
    return 2 * (part(a, n1 * share) + part(b, n0 * share) + part(n1 - a, n1 * (1 - share)) + part(n0 - b, n0 * (1 - share)))


def _counted(sample: DataFrame, keys) -> DataFrame:
    """How many toxic and other sample rows have each key of ``keys(folded)``."""

    def run(batches):
        for df in batches:
            n = (Counter(), Counter())
            for text, y in zip(df["text"], df["y"]):
                n[int(y)].update(keys(fold(text)))
            both = list(n[0].keys() | n[1].keys())
            if both:
                yield pd.DataFrame({"key": both, "n0": [n[0][k] for k in both], "n1": [n[1][k] for k in both]})

    return sample.mapInPandas(lean(run), "key string, n0 long, n1 long").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from labelled rows that aren't held out (``crc32(id) % 4 != 2``).

    At most about ``sample_rows`` of them (chosen by a hash of the id; near copies
    count once), which bounds all that reaches the driver. Rows without an id, a
    label or a text teach nothing; contradicting labels of one id count as toxic.
    """
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    marks = marks.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    known = marks.count()
    if not known:
        return Model()
    chosen = F.pmod(F.xxhash64(F.col("id"), F.lit(17)), F.lit(1 << 30)) < int(min(1.0, sample_rows / known) * (1 << 30))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & chosen)
    sketch = F.pandas_udf(lambda s: pd.Series([_sketch(fold(t)) for t in s], dtype="int64"), "long")
    sample = texts.join(marks.where(chosen), "id").withColumn("sketch", sketch("text")).dropDuplicates(["sketch", "y"]).select("text", "y")
    sample = materialize(sample)
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return Model()
    lift = (F.col("n1") / n1) / ((F.col("n0") + 0.5) / n0)
    rows = _counted(sample, _candidates).where((F.col("n1") >= 5) & (lift > 3)).orderBy((F.col("n1") * F.log(lift)).desc(), "key").limit(20 * MOST_TERMS).collect()
    ranked = sorted(((_gain(r["n1"], r["n0"], n1, n0), len(r["key"]), r["key"], r["n1"], r["n0"]) for r in rows), key=lambda x: (-round(x[0], 6), -x[1], x[2]))
    terms: dict[str, float] = {}
    seen_in: dict[str, tuple[int, int]] = {}
    for gain, _, key, a, b in ranked:
        plain = key.rstrip("$")
        if gain < LEAST_GAIN or len(terms) >= MOST_TERMS:
            break
        if any(plain.startswith(t.rstrip("$")) for t in terms):
            continue
        # a beginning of terms already taken must tell of other documents than those
        longer = [seen_in[t] for t in terms if t.startswith(plain)]
        rest1, rest0 = max(0, a - sum(x for x, _ in longer)), max(0, b - sum(x for _, x in longer))
        if not longer or (_gain(rest1, rest0, n1, n0) >= LEAST_GAIN and rest1 / n1 > 3 * rest0 / n0):
            terms[key] = math.log((rest1 + 0.5) / (n1 + 1)) - math.log((rest0 + 0.5) / (n0 + 1))
            seen_in[key] = (a, b)
    model = Model(terms)
    if terms:
        matcher = None

        def phrases(folded: str) -> set[str]:
            nonlocal matcher
            matcher = matcher or Matcher(Model(terms))
            out = set()
            for lo, hi, _ in matcher.hits(folded):
                after = _WORD.match(folded, hi)
                end = after.end() if after else hi
                out.add(folded[lo:end])
                before, behind = re.search(r"[^\W\d_]+ $", folded[max(0, lo - 40) : lo]), re.match(r" [^\W\d_]+", folded[end : end + 40])
                if before:
                    out.add(before.group() + folded[lo:end])
                if behind:
                    out.add(folded[lo:end] + behind.group())
            return out

        spared = _counted(sample, phrases).where((F.col("n0") >= 8) & (F.col("n1") / n1 < 0.5 * F.col("n0") / n0)).orderBy(F.col("n0").desc(), "key").limit(MOST_TERMS)
        model.exceptions = [r["key"] for r in spared.collect()]
    features = F.pandas_udf(_feature_udf(model), "array<double>")
    seen = sample.select(features("text").alias("x"), "y").collect()  # bounded by sample_rows
    model.weights = [float(v) for v in _logistic(np.array([r["x"] for r in seen]), np.array([r["y"] for r in seen], dtype=float))]
    return model


def _feature_udf(model: Model):
    matcher = None

    def features(s: pd.Series) -> pd.Series:
        nonlocal matcher
        matcher = matcher or Matcher(model)
        return pd.Series([matcher.features(t) for t in s], dtype="object")

    return features


def score(text: Column, model: Model) -> Column:
    """Probability of the toxic label for each whole text (null: empty). 0 if nothing could be learned."""
    if not model.weights:
        return F.lit(0.0)
    matcher = None

    def run(s: pd.Series) -> pd.Series:
        nonlocal matcher
        matcher = matcher or Matcher(model)
        z = np.array([matcher.features(t) for t in s]).reshape(-1, len(model.weights)) @ np.array(model.weights)
        give_back()
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return F.pandas_udf(run, "double")(F.coalesce(text, F.lit("")))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Empty and null texts are scored like any text without hits; repeated rows get
    equal scores; a null id is never held out and teaches nothing. Without usable
    labels all scores are 0. Only ``doc_id`` and ``text`` are read; empty tables
    give empty results.
    """
    model = learn(docs, labels, sample_rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
