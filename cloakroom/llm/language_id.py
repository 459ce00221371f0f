"""Language identification by interpolated Kneser-Ney character models.

Every language has a character model of order ``ORDER`` over words with a blank on
either side. The n-grams of all languages lie in sorted arrays of 64-bit hashes, one
array an order, with the log probability in each language beside them; a second pair
of arrays holds the contexts' back-off weights. A text's language is that of lowest
cross-entropy per character. Words recur, so a worker keeps the log probabilities of
the words it has seen.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakroom.llm.common import held_out, mix64
from cloakroom.sources.tables import spread

ORDER = 5
#: Training documents of one language, at most about so many (chosen by a hash of id).
DOCS_PER_LANGUAGE = 1500
#: Languages learned at most (the most frequent), and n-grams kept over all of them.
MOST_LANGUAGES = 200
MOST_NGRAMS = 1_500_000
_WORD = re.compile(r"[^\W\d_]+")
_PLACE = np.random.default_rng(7).integers(1, 1 << 63, ORDER, dtype=np.uint64) | np.uint64(1)


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters (fractions and the like may stand in them, but don't make a word)."""
    words = _WORD.findall(text.lower())
    return words if any(map(str.isalpha, words)) else [w for w in words if any(map(str.isalpha, w))]


def _tail_hashes(chars: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` characters that end at each position (garbage where they begin before the array)."""
    out = np.full(len(chars), np.uint64(size), dtype=np.uint64)
    for j in range(size):
        out[j:] += mix64(chars[: len(chars) - j] + np.uint64(1)) * _PLACE[j]
    return mix64(out)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def _events(text_words: Counter) -> Counter:
    """Counts of the longest n-gram (``ORDER`` characters, or from the word's blank on) that ends at each character."""
    out: Counter = Counter()
    for word, n in text_words.items():
        w = f" {word} "
        for i in range(2, len(w) + 1):
            out[w[max(0, i - ORDER) : i]] += n
    return out


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    hashes: list[np.ndarray] = field(default_factory=list)  # by order, sorted
    logp: list[np.ndarray] = field(default_factory=list)  # rows as hashes, a column per language
    contexts: list[np.ndarray] = field(default_factory=list)  # by order of the n-gram that follows
    backoff: list[np.ndarray] = field(default_factory=list)
    unseen: np.ndarray | None = None  # log probability of a character never seen
    slope: float = 1.0  # calibration of the score: margin of the log likelihoods, damped
    reject_above: float = math.inf  # cross-entropy over which a text is like no learned language

    @classmethod
    def build(cls, events: dict[str, dict[str, int]]) -> "Model":
        """``events``: for each language the counts of ``_events``."""
        m = cls(sorted(events))
        k = len(m.languages)
        tables: list[list[dict[str, int]]] = []  # [language][order - 1]
        for lang in m.languages:
            by_order: list[dict[str, int]] = [defaultdict(int) for _ in range(ORDER)]
            for gram, n in events[lang].items():
                by_order[len(gram) - 1][gram] += n
            for size in range(ORDER - 1, 0, -1):  # lower orders: in how many contexts; from the blank on: how often
                for gram in by_order[size]:
                    by_order[size - 1][gram[1:]] += 1
            tables.append(by_order)
        chars = {g for t in tables for g in t[0]}
        lower: dict[str, np.ndarray] = {}
        m.unseen = np.zeros(k)
        for size in range(1, ORDER + 1):
            grams = sorted({g for t in tables for g in t[size - 1]})
            total, kinds = [defaultdict(int) for _ in range(k)], [defaultdict(int) for _ in range(k)]
            cut = []
            for i, t in enumerate(tables):
                counts = t[size - 1]
                for g, n in counts.items():
                    total[i][g[:-1]] += n
                    kinds[i][g[:-1]] += 1
                ones, twos = sum(n == 1 for n in counts.values()), sum(n == 2 for n in counts.values())
                cut.append(min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5)
            contexts = sorted({c for t in total for c in t})
            weight = {c: np.array([cut[i] * kinds[i][c] / total[i][c] if c in total[i] else 1.0 for i in range(k)]) for c in contexts}
            here: dict[str, np.ndarray] = {}
            for g in grams:
                c = g[:-1]
                own = np.array([max(tables[i][size - 1].get(g, 0) - cut[i], 0) / total[i][c] if c in total[i] else 0.0 for i in range(k)])
                base = lower[g[1:]] if size > 1 else np.full(k, 1 / (len(chars) + 1))
                here[g] = own + weight[c] * base
            if size == 1:
                m.unseen = np.log(weight[""] / (len(chars) + 1)) if "" in weight else np.zeros(k)
            for names, values, to_h, to_v, n in ((grams, here, m.hashes, m.logp, size), (contexts, weight, m.contexts, m.backoff, size - 1)):
                codes = _codes("".join(names)).reshape(len(names), n) if names and n else np.zeros((len(names), n), np.uint64)
                h = np.full(len(names), np.uint64(n), dtype=np.uint64)
                for j in range(n):
                    h += mix64(codes[:, n - 1 - j] + np.uint64(1)) * _PLACE[j]
                h = mix64(h)
                by = np.argsort(h)
                to_h.append(h[by])
                to_v.append(np.log(np.array([values[x] for x in names]).reshape(len(names), k))[by].astype(np.float32))
            lower = here
        return m

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word (and the blank behind it) in every language."""
        k = len(self.languages)
        text = "".join([f" {w} " for w in words])
        chars = _codes(text)
        sizes = np.array([len(w) + 2 for w in words])
        start = np.repeat(np.append(0, np.cumsum(sizes)[:-1]), sizes)
        place = np.arange(len(chars)) - start
        hashes = [_tail_hashes(chars, n) for n in range(ORDER + 1)]
        out = np.zeros((len(chars), k), dtype=np.float32)
        todo = place > 0
        for n in range(ORDER, 0, -1):
            at = np.flatnonzero(todo & (place >= n - 1))
            if not len(at):
                continue
            found, row = _find(self.hashes[n - 1], hashes[n][at])
            out[at[found]] += self.logp[n - 1][row[found]]
            todo[at[found]] = False
            rest = at[~found]
            if n > 1:
                found, row = _find(self.contexts[n - 1], hashes[n - 1][rest - 1])
                out[rest[found]] += self.backoff[n - 1][row[found]]
        out[todo] += self.unseen
        return np.add.reduceat(out, np.append(0, np.cumsum(sizes)[:-1]))


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted), dtype=np.int64)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return table[at] == wanted, at


class Scorer:
    """A model with a worker's cache of word scores (a full cache is emptied; results don't change)."""

    CACHE = 600_000

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.model.languages)), dtype=np.float32)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of each text in every language, and its number of scored characters."""
        parts = [words_of(t) for t in texts]
        need = set().union(*parts).difference(self.row)
        if len(self.row) + len(need) > self.CACHE and self.row:
            self.clear()
            need = set().union(*parts)
        if need:
            new, n = list(need), len(self.row)
            if n + len(new) > len(self.scores):
                grown = np.zeros((2 * (n + len(new)), self.scores.shape[1]), dtype=np.float32)
                grown[:n] = self.scores[:n]
                self.scores = grown
            for lo in range(0, len(new), 20_000):
                some = new[lo : lo + 20_000]
                self.scores[n + lo : n + lo + len(some)] = self.model.word_scores(some)
            self.row.update(zip(new, range(n, n + len(new))))
        get = self.row.__getitem__
        out, chars = np.zeros((len(texts), self.scores.shape[1])), np.zeros(len(texts))
        for i, p in enumerate(parts):
            if p:
                out[i] = self.scores[np.fromiter(map(get, p), dtype=np.int64, count=len(p))].sum(axis=0, dtype=np.float64)
                chars[i] = sum(map(len, p)) + len(p)
        return out, chars


def _damped(logs: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Evidence for calibration: the margins in log likelihood, growing as the root of the length."""
    return (logs - logs.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(chars, 1))[:, None]


def learn(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, most_languages: int = MOST_LANGUAGES, most_ngrams: int = MOST_NGRAMS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from rows with text and language that aren't held out (``crc32(id) % 4 != 2``).

    A bounded sample: about ``docs_per_language`` documents of each of the
    ``most_languages`` most frequent languages, and the ``most_ngrams`` most frequent
    n-grams in equal shares, whatever the size of the table. Without a usable row the
    model knows no language.
    """
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)))
    counts = known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(most_languages).collect()
    if not counts:
        return Model()
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], int(min(1.0, docs_per_language / r["n"]) * (1 << 30)))])
    dealt = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(23)), F.lit(1 << 30))
    sample = known.where(dealt < share[F.col(lang_col)]).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def run(batches):
        for df in batches:
            for lang, texts in df.groupby("lang")["text"]:
                n: Counter = Counter()
                for t in texts:
                    n.update(words_of(t))
                events = _events(n)
                if events:
                    yield pd.DataFrame({"lang": lang, "gram": list(events), "n": list(events.values())})

    events = sample.mapInPandas(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_lang: dict[str, dict[str, int]] = {r["lang"]: {} for r in counts}
    kept = events.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))).where(F.col("r") <= most_ngrams // len(counts))
    for r in kept.select("lang", "gram", "n").collect():
        by_lang[r["lang"]][r["gram"]] = r["n"]
    by_lang = {k: v for k, v in by_lang.items() if v}
    if not by_lang:
        return Model()
    model = Model.build(by_lang)
    # Calibration on a part of the same rows: a bounded number of rows and floats.
    shared = sample.sparkSession.sparkContext.broadcast(model)
    seen = sample.where(F.pmod(F.xxhash64("text"), F.lit(4)) == 0).mapInPandas(lambda it: _scored(it, shared), "lang string, logs array<double>, chars double").collect()
    seen = [r for r in seen if r["chars"] and r["lang"] in model.languages]
    if seen:
        logs, chars = np.array([r["logs"] for r in seen]), np.array([r["chars"] for r in seen])
        truth = np.array([model.languages.index(r["lang"]) for r in seen])
        margin = _damped(logs, chars)
        grid = [2.0**e for e in np.arange(-6, 5, 0.25)]
        model.slope = max(grid, key=lambda s: _log_score(margin, truth, s))
        model.reject_above = float(np.quantile(-logs.max(axis=1) / chars, 0.999)) * 1.25
    return model


def _scored(batches, shared):
    scorer = Scorer(shared.value)
    for df in batches:
        logs, chars = scorer.texts(df["text"].tolist())
        yield pd.DataFrame({"lang": df["lang"], "logs": list(logs), "chars": chars})


def _log_score(margin: np.ndarray, truth: np.ndarray, slope: float) -> float:
    z = margin * slope
    return float((z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(axis=1))).mean())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, cross_entropy, rejected`` for every row, from whole texts alone.

    ``score`` is the calibrated probability of the predicted language. Null texts and
    those without letters are ``und`` with score 0. ``rejected``: the cross-entropy is
    above that of nearly all training texts. If no language could be learned all are
    ``und``. Repeated rows get equal results; other columns are not read.
    """
    base = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    schema = "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = _worker_scorer(shared)
        names = np.array([*shared.value.languages, "und"], dtype=object)
        for df in batches:
            texts = df["text"].tolist()
            best, score, entropy = np.full(len(texts), len(names) - 1), np.zeros(len(texts)), np.zeros(len(texts))
            for lo in range(0, len(texts) if len(names) > 1 else 0, 500):
                logs, chars = scorer.texts(texts[lo : lo + 500])
                ok = chars > 0
                z = np.exp(_damped(logs, chars) * shared.value.slope)
                part = slice(lo, lo + len(logs))
                best[part] = np.where(ok, logs.argmax(axis=1), len(names) - 1)
                score[part] = np.where(ok, z.max(axis=1) / z.sum(axis=1), 0.0)
                entropy[part] = np.where(ok, -logs.max(axis=1) / np.maximum(chars, 1), 0.0)
            yield pd.DataFrame({"doc_id": df["doc_id"], "held_out": df["held_out"], "lang_pred": names[best], "score": score, "cross_entropy": entropy, "rejected": entropy > shared.value.reject_above})

    return base.mapInPandas(run, schema)


_SCORERS: dict = {}


def _worker_scorer(shared) -> Scorer:
    """One scorer per worker process and model, kept between tasks."""
    key = shared.id if hasattr(shared, "id") else id(shared.value)
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(shared.value)
    return _SCORERS[key]


def identify_documents(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """Learn from the documents' own languages and predict all of them."""
    return identify(docs, learn(docs, docs_per_language))
