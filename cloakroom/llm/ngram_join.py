"""Jaccard self-join on word n-grams with Bayesian pruning of candidate pairs.

Documents with equal n-gram sets form a class. Classes become candidates where one of
``BANDS`` bands of MinHash values agrees (a pair at the threshold is missed with
probability (1 - 0.8**5)**40, about 1e-7). Within a band's bucket the pairs' MinHash
values are compared a few at a time; a pair is dropped as soon as the posterior
probability that its similarity reaches the threshold falls below ``TOLERANCE``. What
survives only connects classes into families; inside a family all pairs are compared in
blocks, pruned in the same way and verified on the whole n-gram sets. Pairs are counted
where they are found and never become rows.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakroom.llm.chunks import answer_bits, buckets_for, cuts, shared_by_chunks, shorten
from cloakroom.llm.common import PrefixHash, id_and_text, lean, mix64, text_batches, word_spans
from cloakroom.llm.components import connected
from cloakroom.session import materialize

BANDS, ROWS = 40, 5
SKETCH = 128  # MinHash values, a byte each, that pairs are compared by
STEP = 32
TOLERANCE = 1e-6
BUCKET = 2048  # classes of one bucket held at once; larger buckets meet in pairs of such blocks
BLOCK = 128  # classes of one family held at once, with their n-gram sets
_RNG = np.random.default_rng(99)
_XOR = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_MULTIPLY = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_PLACE = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def gram_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text; fewer than ``n`` words are one gram."""
    out = []
    raw = [t.encode() for t in texts]
    for lo, hi in text_batches(raw):
        data = np.frombuffer(b"\n".join(raw[lo:hi]), dtype=np.uint8)
        start, end = word_spans(data)
        words = PrefixHash(data).slices(start, end)
        stop = np.searchsorted(start, np.cumsum([len(t) + 1 for t in raw[lo:hi]]))
        grams = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
        for j in range(n):
            grams += words[j : j + len(grams)] * _PLACE[j]
        grams = mix64(grams)
        for a, b in zip(np.append(0, stop[:-1]), stop):
            if b - a >= n:
                out.append(np.unique(grams[a : b - n + 1]))
            elif b > a:
                out.append(mix64(np.array([(words[a:b] * _PLACE[n : n + b - a]).sum() + np.uint64(b - a)], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def _minhash(grams: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, dtype=np.uint32)
    values = (grams >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(values), 2048):
        np.minimum(low, ((values[i : i + 2048, None] ^ _XOR) * _MULTIPLY).min(axis=0), out=low)
    return low


def _class_key(grams: np.ndarray) -> bytes:
    """128 bits that stand for a whole n-gram set."""
    a = mix64(grams).sum(dtype=np.uint64) + np.uint64(len(grams))
    b = mix64(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return np.array([a, b], dtype=">u8").tobytes()


@cache
def least_agreements(threshold: float, tolerance: float) -> tuple[int, ...]:
    """After ``STEP``, 2 ``STEP``, ... values: the fewest agreements whose posterior is still above the tolerance."""
    s = (np.arange(4000) + 0.5) / 4000  # uniform prior over the similarity
    agree = s + (1 - s) / 256  # bytes agree by chance, too
    out = []
    for n in range(STEP, SKETCH + 1, STEP):
        for m in range(n + 1):
            logs = m * np.log(agree) + (n - m) * np.log1p(-agree + 1e-15)
            weight = np.exp(logs - logs.max())
            if weight[s >= threshold].sum() / weight.sum() >= tolerance:
                out.append(m)
                break
    return tuple(out)


def surviving(left: np.ndarray, right: np.ndarray, need: tuple[int, ...]) -> np.ndarray:
    """Which pairs of sketches (rows; one of the sides may be a single row) are not pruned, compared step by step."""
    n = max(len(left), len(right))
    alive, agreed = np.arange(n), np.zeros(n, dtype=np.int64)
    for k, least in enumerate(need):
        part = slice(k * STEP, (k + 1) * STEP)
        a = left[:, part] if len(left) == 1 and n > 1 else left[alive, part]
        b = right[:, part] if len(right) == 1 and n > 1 else right[alive, part]
        agreed = agreed + (a == b).sum(axis=1)
        ok = agreed >= least
        alive, agreed = alive[ok], agreed[ok]
        if not len(alive):
            break
    out = np.zeros(n, dtype=bool)
    out[alive] = True
    return out


def _forest(sketch: np.ndarray, need: tuple[int, ...]) -> list[tuple[int, int]]:
    """Edges that connect whatever surviving pairs connect, found breadth first."""
    waiting, out = np.arange(len(sketch)), []
    queue: list[int] = []
    while len(waiting):
        if not queue:
            queue.append(int(waiting[0]))
            waiting = waiting[1:]
            continue
        x = queue.pop()
        ok = surviving(sketch[x : x + 1], sketch[waiting], need)
        out += [(x, int(y)) for y in waiting[ok]]
        queue += waiting[ok].tolist()
        waiting = waiting[~ok]
    return out


def _families(classes: DataFrame, need: tuple[int, ...]) -> DataFrame:
    """``cid, family`` of every class that some surviving pair connects to another."""
    n_classes = classes.count()
    n_chunks = max(8, -(-n_classes // 8192))
    entries = n_classes * BANDS
    nb = buckets_for(entries, 5, 4 << 20)
    skip = max(0, nb.bit_length() - 1)
    width = min(8, max(4, -(-(entries.bit_length() + 10 - skip) // 8)))
    skip = min(skip, 64 - 8 * width)
    dealt = classes.where("n > 0").select("cid", "bands", "sketch", F.pmod(F.xxhash64("cid"), F.lit(n_chunks)).alias("chunk"))

    def bands_of(df: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        df = df.sort_values("cid")
        keys = np.frombuffer(b"".join(df["bands"]), dtype="<u8")
        unique, which, times = np.unique(keys, return_inverse=True, return_counts=True)
        return unique, which, times

    def send(df: pd.DataFrame) -> pd.DataFrame:
        unique, _, _ = bands_of(df)
        cut = cuts(unique, nb)
        rows = [(b, df["chunk"].iloc[0], shorten(unique[cut[b] : cut[b + 1]], width, skip)) for b in range(nb) if cut[b + 1] > cut[b]]
        return pd.DataFrame(rows, columns=["bucket", "chunk", "block"])

    shared = shared_by_chunks(dealt.groupBy("chunk").applyInPandas(lean(send), "bucket int, chunk long, block binary"), width)

    def keep(df: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(df):
            return pd.DataFrame(columns=["band", "cid", "sketch"])
        unique, which, times = bands_of(df)
        df = df.sort_values("cid")
        hit = (answer_bits(answers, cuts(unique, nb)) | (times > 1))[which]
        at = np.flatnonzero(hit)
        row = at // BANDS
        return pd.DataFrame({"band": unique[which[at]].view(np.int64), "cid": df["cid"].to_numpy()[row], "sketch": df["sketch"].to_numpy()[row]})

    rows = dealt.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInPandas(lean(keep), "band long, cid binary, sketch binary")
    rows = materialize(rows)
    large = rows.groupBy("band").agg(F.count("*").alias("m")).where(F.col("m") > BUCKET)
    split = rows.join(large, "band", "left").withColumn("nb", F.coalesce(F.ceil(F.col("m") / BUCKET), F.lit(1)).cast("long")).withColumn("at", F.pmod(F.xxhash64("cid", F.lit(5)), "nb"))
    met = split.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))).select("band", "cid", "sketch", F.least("at", "with").alias("i"), F.greatest("at", "with").alias("j"))

    def connect(batches):
        held = None
        for df in batches:
            if held is not None:
                df = pd.concat([held, df])
            if not len(df):
                continue
            key = df[["band", "i", "j"]].to_numpy()
            last = int((key != key[-1]).any(axis=1)[::-1].argmax()) if (key != key[-1]).any() else len(df)
            yield edges_of(df.iloc[: len(df) - last], key[: len(df) - last])
            held = df.iloc[len(df) - last :]
        if held is not None:
            yield edges_of(held, held[["band", "i", "j"]].to_numpy())

    def edges_of(df: pd.DataFrame, key: np.ndarray) -> pd.DataFrame:
        if not len(df):
            return pd.DataFrame({"a": [], "b": []})
        cid = df["cid"].to_numpy()
        sketch = np.frombuffer(b"".join(df["sketch"]), dtype=np.uint8).reshape(-1, SKETCH)
        start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
        size = np.diff(np.append(start, len(df)))
        pairs: set[tuple[bytes, bytes]] = set()
        for m in range(2, 9):  # small buckets of one size together
            at = start[size == m]
            for i in range(m):
                for j in range(i + 1, m):
                    ok = np.flatnonzero(surviving(sketch[at + i], sketch[at + j], need)) if len(at) else []
                    pairs.update((cid[x + i], cid[x + j]) for x in at[ok])
        for lo, m in zip(start[size > 8], size[size > 8]):
            pairs.update((cid[lo + x], cid[lo + y]) for x, y in _forest(sketch[lo : lo + m], need))
        return pd.DataFrame(list(pairs), columns=["a", "b"])

    ordered = met.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return connected(ordered.mapInPandas(lean(connect), "a binary, b binary").distinct()).select(F.col("node").alias("cid"), F.col("root").alias("family"))


def _verified(members: DataFrame, threshold: float, need: tuple[int, ...]) -> DataFrame:
    """``members``: family, cid, sketch, grams. Rows: a class with its links in one block pair, and a link's other end."""
    sizes = members.groupBy("family").agg(F.count("*").alias("m"))
    total = members.count()
    split = members.join(sizes, "family").withColumn("nb", F.ceil(F.col("m") / BLOCK).cast("long")).withColumn("at", F.pmod(F.xxhash64("cid", F.lit(6)), "nb"))
    met = split.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))).withColumn("i", F.least("at", "with")).withColumn("j", F.greatest("at", "with"))
    # small families share a task call; a block pair of a large one has its own
    few = F.pmod(F.xxhash64("family"), F.lit(max(1, total // 256)))
    keyed = met.withColumn("call", F.when(F.col("nb") == 1, few).otherwise(F.xxhash64("family", "i", "j"))).select("call", "family", "i", "j", "at", "cid", "sketch", "grams")

    def run(df: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for (_, i, j), g in df.groupby(["family", "i", "j"], sort=False):
            cid, side = g["cid"].to_numpy(), g["at"].to_numpy()
            sketch = np.frombuffer(b"".join(g["sketch"]), dtype=np.uint8).reshape(-1, SKETCH)
            a, b = np.triu_indices(len(g), 1)
            if i != j:  # pairs inside one block belong to that block's own call
                across = side[a] != side[b]
                a, b = a[across], b[across]
            ok = np.concatenate([surviving(sketch[a[k : k + 65536]], sketch[b[k : k + 65536]], need) for k in range(0, len(a), 65536)]) if len(a) else np.zeros(0, bool)
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            a, b = _similar(a, b, [np.frombuffer(x, dtype="<u8") for x in g["grams"]], threshold)
            links = np.bincount(np.append(a, b), minlength=len(g))
            root = _roots(len(g), a, b)
            for x in np.flatnonzero(links):
                rows.append((cid[x], int(links[x]), cid[root[x]]))
        return pd.DataFrame(rows, columns=["cid", "links", "other"])

    return keyed.groupBy("call").applyInPandas(lean(run), "cid binary, links long, other binary")


def _similar(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose exact Jaccard similarity reaches the threshold, from bit sets over the grams in use."""
    used = np.unique(np.append(a, b))
    sizes = np.array([len(s) for s in sets])
    _, which = np.unique(np.concatenate([sets[x] for x in used]), return_inverse=True)
    width = -(-(int(which.max(initial=0)) + 1) // 64)
    ends = np.cumsum(sizes[used])
    bits = np.zeros((len(sets), width), dtype=np.uint64)
    for x, lo, hi in zip(used, ends - sizes[used], ends):
        flags = np.zeros(width * 64, dtype=np.uint8)
        flags[which[lo:hi]] = 1
        bits[x] = np.packbits(flags, bitorder="little").view("<u8")
    common = np.empty(len(a), dtype=np.int64)
    step = max(1, (1 << 21) // max(1, width))
    for k in range(0, len(a), step):
        common[k : k + step] = np.bitwise_count(bits[a[k : k + step]] & bits[b[k : k + step]]).sum(axis=1)
    # in integers, so that exactly the threshold counts whatever rounding does
    part = round(threshold * 10_000)
    ok = common * 10_000 >= part * (sizes[a] + sizes[b] - common)
    return a[ok], b[ok]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
    return np.array([find(x) for x in range(n)])


def similar_documents(docs: DataFrame, threshold: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text", with_group: bool = False) -> DataFrame:
    """Per input row ``doc_id, class_id, n_links, group_id`` (and ``row_key``, a hash of id and text;
    with ``with_group`` also ``group_key``, which tells groups apart where ids repeat or are null).

    ``class_id``: least id among the documents with the same n-gram set (equal texts
    always share it). ``n_links``: how many other classes reach the threshold with this
    one. ``group_id``: least id of all documents connected by links. Words are
    ``[^\\x20\\x09-\\x0D]+``, unchanged; texts with fewer than ``words`` words have all of
    them as their one n-gram; null and empty texts form one class without links.
    Repeated rows are repeated in the result; null ids are passed over when the least
    id is taken, so a class of null ids alone has a null ``class_id``. An empty table
    gives an empty result. Other columns are not read.
    """
    need = least_agreements(threshold, TOLERANCE)
    base = id_and_text(docs, id_col, text_col).withColumn("row_key", F.xxhash64("id", "text"))

    def sign(batches):
        for df in batches:
            out = []
            for grams in gram_sets(df["text"].tolist(), words):
                low = _minhash(grams)
                bands = mix64((low.reshape(BANDS, ROWS).astype(np.uint64) * _PLACE[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _PLACE[ROWS])
                out.append((_class_key(grams), len(grams), bands.astype("<u8").tobytes(), (low[:SKETCH] >> np.uint32(7)).astype(np.uint8).tobytes()))
            part = pd.DataFrame(out, columns=["cid", "n", "bands", "sketch"])
            part["id"], part["row_key"] = df["id"].to_numpy(), df["row_key"].to_numpy()
            part["id"] = part["id"].astype("Int64") if part["id"].notna().all() else pd.array([None if pd.isna(x) else int(x) for x in part["id"]], dtype="Int64")
            yield part

    signed = materialize(base.mapInPandas(lean(sign), "id long, row_key long, cid binary, n long, bands binary, sketch binary"))
    classes = signed.groupBy("cid").agg(F.min("id").alias("class_id"), F.min("row_key").alias("row_key"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = materialize(classes)
    families = materialize(_families(classes, need))
    chosen = classes.select("cid", "row_key", "sketch").join(families, "cid")

    def grams(batches):
        for df in batches:
            df = df.drop(columns="text").assign(grams=[g.astype("<u8").tobytes() for g in gram_sets(df["text"].tolist(), words)])
            yield df[["family", "cid", "sketch", "grams"]]

    texts = base.select("row_key", "text").join(chosen, "row_key").select("family", "cid", "sketch", "text")
    members = texts.mapInPandas(lean(grams), "family binary, cid binary, sketch binary, grams binary").dropDuplicates(["cid"])
    links = materialize(_verified(materialize(members), threshold, need))
    counted = links.groupBy("cid").agg(F.sum("links").alias("n_links"))
    groups = connected(links.select(F.col("cid").alias("a"), F.col("other").alias("b")))
    grouped = classes.select("cid", "class_id").join(groups.withColumnRenamed("node", "cid"), "cid")
    names = grouped.groupBy("root").agg(F.min("class_id").alias("group_id"))
    info = classes.select("cid", "class_id").join(counted, "cid", "left").join(grouped.join(names, "root").select("cid", "group_id", "root"), "cid", "left")
    out = signed.select("id", "row_key", "cid").join(info, "cid")
    return out.select(F.col("id").alias("doc_id"), "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id"), "row_key", *([F.coalesce("root", "cid").alias("group_key")] if with_group else []))
