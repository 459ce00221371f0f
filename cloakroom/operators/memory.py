"""Recallable memories: keyword (BM25) and vector recall, fusion, budget, lifecycle.

Tables: ``memories(id, content, kind, egress_policy, created_ms, recall_count,
accessed_ms, promoted)``, derived ``postings(id, term, tf)`` and ``lengths(id,
dl)``; queries arrive as ``(qid, text)`` rows.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakroom.functions.joins import sized
from cloakroom.functions.text import NON_ALNUM_RUN, ascii_lower
from cloakroom.session import materialize, stored

# --- fixed values that must equal the reference's for right results --------
RECALL_K = 8  # recall depth
BUDGET_TOKENS = 400  # injection budget, cost = bytes/4 + 2 per memory
PROMOTE_AT = 3  # recalls before a memory is promoted
QUERY_MIN_BYTES = 3  # shorter query words are ignored
EMBED_DIM = 64  # hash-embedding width
EMBED_MIN_BYTES = 2  # shorter tokens are not embedded
BM25_K1, BM25_B, BM25_IDF_FLOOR = 1.2, 0.75, 1e-6  # full-text ranking constants
LOCAL_POLICY_NAMES = ("local_only", "local-only", "local")
BLOCK_HEADER = "Relevant context about the user (use only if helpful):"
# ---------------------------------------------------------------------------


def _fold_map() -> tuple[str, str]:
    """Latin letters with diacritics -> base letter, by Unicode decomposition.

    Covers U+00C0..U+024F (the letters a full-text tokenizer folds); letters
    without an ASCII base (e.g. sharp s) are left alone.
    """
    src, dst = [], []
    for cp in range(0xC0, 0x250):
        ch = chr(cp)
        base = unicodedata.normalize("NFD", ch)[0]
        if base != ch and base.isascii() and base.isalpha():
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


FOLD_FROM, FOLD_TO = _fold_map()


def fold(c: Column) -> Column:
    """Full-text normal form of a token: Unicode lower case, diacritics removed."""
    return F.translate(F.lower(c), FOLD_FROM, FOLD_TO)


def normalize_policy(p: Column) -> Column:
    return F.when(F.lower(F.trim(p)).isin(*LOCAL_POLICY_NAMES), F.lit("local_only")).otherwise(F.lit("anonymized"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, NON_ALNUM_RUN, -1), lambda w: F.length(w) > 0)


def memory_id(*parts: Column) -> Column:
    """Deterministic 16-hex id from the memory's identity (retries stay idempotent)."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def postings(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, term, tf) and (id, dl) from memory contents."""
    toks = memories.select("id", F.explode(F.transform(words(F.col("content")), fold)).alias("term"))
    post = toks.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    lengths = memories.select("id", F.size(words(F.col("content"))).alias("dl"))
    return post, lengths


def query_terms(queries: DataFrame, cap: int | None = None) -> DataFrame:
    """(qid, qpos, term): distinct (ASCII-lowercased) words of >= 3 bytes, folded; with ``cap`` the first so many."""
    w = F.filter(words(F.col("text")), lambda x: F.octet_length(x) >= QUERY_MIN_BYTES)
    terms = F.array_distinct(F.transform(w, ascii_lower))
    if cap is not None:
        terms = F.slice(terms, 1, cap)
    return queries.select("qid", F.posexplode(terms).alias("qpos", "t")).select("qid", "qpos", fold(F.col("t")).alias("term"))


def bm25_scores(queries: DataFrame, memories: DataFrame, k: int | None = None, cap: int | None = None) -> DataFrame:
    """(qid, id, score): Okapi BM25 over memories sharing a term with the query.

    Equi-joins on ``term`` only. Terms in half of all memories or more carry the
    floor idf; joined as they are, they would pair nearly every query with every
    memory. With ``k`` only pairs that can reach a query's top ``k`` are scored:
    rare terms first, then the floor terms of those pairs whose score so far is
    within reach of the k-th one. A query with fewer than ``k`` such pairs, or whose
    k-th score the floor terms alone could still reach, joins its floor terms in full.
    """
    post, lengths = postings(memories)
    stats = lengths.agg(F.count(F.lit(1)).alias("N"), F.avg("dl").alias("avgdl"))
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("nhit"))
    idf_raw = F.log((F.col("N") - F.col("nhit") + 0.5) / (F.col("nhit") + 0.5))
    # the one-row statistics join every term: no pairs come of it
    terms = df.crossJoin(F.broadcast(stats)).select(
        "term", (idf_raw <= 0).alias("common"), F.when(idf_raw <= 0, F.lit(BM25_IDF_FLOOR)).otherwise(idf_raw).alias("idf"), "avgdl"
    )
    tf, dl = F.col("tf"), F.col("dl")
    part = F.col("idf") * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / F.col("avgdl")))
    q = query_terms(queries, cap).join(terms, "term")

    def parts(some: DataFrame, keys: list[str]) -> DataFrame:
        return some.join(post, keys).join(lengths, "id").select("qid", "id", part.alias("part"))

    if k is None:
        return parts(q, ["term"]).groupBy("qid", "id").agg(F.sum("part").alias("score"))
    q = materialize(q)
    rare, floor = q.where(~F.col("common")), q.where("common")
    got = materialize(parts(rare, ["term"]).groupBy("qid", "id").agg(F.sum("part").alias("score")))
    kth = top_k(got, k).where(F.col("rk") == k).select("qid", F.col("score").alias("kth"))
    reach = floor.groupBy("qid").agg((F.count(F.lit(1)) * (BM25_IDF_FLOOR * (BM25_K1 + 1)) + 1e-8).alias("reach"))
    state = q.select("qid").distinct().join(kth, "qid", "left").join(reach, "qid", "left").select(
        "qid", "kth", F.coalesce("reach", F.lit(0.0)).alias("reach")
    ).withColumn("closed", F.coalesce(F.col("kth") > F.col("reach"), F.lit(False)))
    near = got.join(state.where("closed"), "qid").where(F.col("score") >= F.col("kth") - F.col("reach")).select("qid", "id", "score")
    whole = got.join(state.where("not closed").select("qid"), "qid").select("qid", "id", "score")
    added = parts(near.select("qid", "id").join(floor, "qid"), ["term", "id"]).unionByName(parts(floor.join(state.where("not closed").select("qid"), "qid"), ["term"]))
    every = near.unionByName(whole).withColumnRenamed("score", "part").unionByName(added)
    return every.groupBy("qid", "id").agg(F.sum("part").alias("score"))


def top_k(scored: DataFrame, k: int, group: str = "qid", score: str = "score", tie: str = "id") -> DataFrame:
    """``k`` best rows per group (score desc, ``tie`` asc) with rank ``rk``.

    ``row_number() <= k`` plans as a per-partition WindowGroupLimit before
    the shuffle, so only k rows per group and partition move.
    """
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(tie).asc())
    return scored.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def recall(queries: DataFrame, memories: DataFrame, k: int = RECALL_K, cap: int | None = None) -> DataFrame:
    """Keyword recall: (qid, id, rk) top ``k`` by BM25 (ties by id)."""
    s = bm25_scores(queries, memories, k, cap).withColumn("score", F.round("score", 9))
    return top_k(s, k).select("qid", "id", "rk")


# --- hash embedding -----------------------------------------------------------


def hash_embed(df: DataFrame, key: str, text: str, out: str = "vec", dim: int = EMBED_DIM) -> DataFrame:
    """(key, out): signed feature hashing of ASCII-lowercased tokens (>= 2 bytes), L2-normalised.

    bucket = first 32 bits of md5(token) mod dim; sign from the next hex digit. Tokens
    are summed by (key, bucket) before the cells of a key come together; a text
    without tokens gets the zero vector.
    """
    toks = F.filter(words(F.col(text)), lambda t: F.octet_length(t) >= EMBED_MIN_BYTES)
    h = df.select(F.col(key), F.explode_outer(toks).alias("t")).withColumn("h", F.md5(ascii_lower(F.col("t"))))
    bucket = (F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") % dim).cast("int")
    sign = F.when(F.conv(F.substring("h", 9, 1), 16, 10).cast("int") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    cells = h.groupBy(key, bucket.alias("b")).agg(F.sum(F.when(F.col("h").isNotNull(), sign)).alias("x"))
    per = cells.groupBy(key).agg(
        F.sqrt(F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0.0))).alias("norm"),
        F.map_from_entries(F.collect_list(F.when(F.col("b").isNotNull(), F.struct("b", "x")))).alias("m"),
    )
    norm = F.when(F.col("norm") > 0, F.col("norm")).otherwise(F.lit(1.0))
    return per.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.coalesce(F.col("m")[d], F.lit(0.0)) / norm).alias(out))


# --- vector top-k ---------------------------------------------------------------


def vector_top_k(queries: DataFrame, items: DataFrame, k: int = RECALL_K, min_score: float = 0.0, block: tuple[int, int] = (2048, 8192)) -> DataFrame:
    """Cosine top-``k`` items per query: (qid, id, score, rk), score > ``min_score``.

    Equal query vectors are compared once: their best ``k`` go to every query that has them.
    These vectors and the items are dealt into blocks of about ``block`` rows; a task multiplies
    one block of vectors with one of items and passes on each vector's best ``k``, by
    the rounded score that the final ranking uses (so ties don't depend on the blocks).
    Vectors meet only those of as many entries; null and empty ones, and those with null
    or non-finite entries, take no part.
    """
    entry = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", entry)
    queries, items = (df.withColumn("vec", F.col("vec").cast("array<double>")).where(usable).withColumn("d", F.size("vec")) for df in (queries, items))
    itype = items.schema["id"].dataType.simpleString()
    # no -0.0, which is equal to 0.0 but has other bits
    asked = stored(queries.select("qid", F.transform("vec", lambda x: x + F.lit(0.0)).alias("vec")))
    key = F.concat(F.xxhash64("vec"), F.lit("-"), F.xxhash64(F.lit(7), "vec")).alias("key")
    distinct = stored(asked.select("vec").distinct().select(key, "vec", F.size("vec").alias("d")))
    n_q, n_i = (max(1, -(-df.count() // rows)) for df, rows in zip((distinct, items), block))
    q = distinct.select("key", "vec", "d", F.pmod(F.xxhash64("key"), F.lit(n_q)).alias("qb")).withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(n_i - 1)).cast("array<bigint>")))
    i = items.select("id", "vec", "d", F.pmod(F.xxhash64("id"), F.lit(n_i)).alias("ib")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)).cast("array<bigint>")))

    def unit(vectors) -> np.ndarray:
        m = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            right = right.sort_values("id")
            ids, m, a = right["id"].to_numpy(), unit(right["vec"]).T, unit(left["vec"])
            keys, few = left["key"].to_numpy(), max(1, (1 << 22) // len(right))
            for lo in range(0, len(a), few):
                score = np.round(a[lo : lo + few] @ m, 9)
                cut = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), -np.inf)
                qi, ii = np.nonzero((score >= cut[:, None]) & (score > min_score))
                order = np.lexsort((ii, -score[qi, ii], qi))
                qi, ii = qi[order], ii[order]
                top = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
                rows.append(pd.DataFrame({"key": keys[lo + qi[top]], "id": ids[ii[top]], "score": score[qi[top], ii[top]]}))
        return pd.concat(rows) if rows else pd.DataFrame({"key": pd.Series([], dtype=object), "id": pd.Series([], dtype=object), "score": pd.Series([], dtype="float64")})

    partial = q.groupBy("qb", "ib", "d").cogroup(i.groupBy("qb", "ib", "d")).applyInPandas(best, f"key string, id {itype}, score double")
    ranked = top_k(partial.withColumn("score", F.round("score", 9)), k, "key")
    hits = ranked.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rk", "id", "score"))).alias("hits"))
    hits = sized(hits, n_q * block[0])
    # a qid with one vector has its hits as they are, one with several the best of all of them
    per = stored(asked.select("qid", key).groupBy("qid").agg(F.collect_list("key").alias("keys")))
    one, several = F.size("keys") == 1, F.size("keys") > 1
    found = lambda df: df.join(hits, "key").select("qid", F.explode("hits").alias("h")).select("qid", "h.id", "h.score", "h.rk")
    single = found(per.where(one).select("qid", F.col("keys")[0].alias("key")))
    rest = per.where(several)
    if rest.isEmpty():
        return single
    return single.unionByName(top_k(found(rest.select("qid", F.explode("keys").alias("key"))).drop("rk"), k))


# --- fusion, budget, lifecycle -----------------------------------------------------


def fuse(keyword: DataFrame, semantic: DataFrame, k: int = RECALL_K) -> DataFrame:
    """Keyword hits first, then semantic hits not already present: (qid, id, rank)."""
    kw = keyword.select("qid", "id", F.col("rk").cast("bigint").alias("rank"))
    sem = semantic.join(kw, ["qid", "id"], "left_anti").select(
        "qid", "id", (F.col("rk") + F.lit(k)).cast("bigint").alias("rank")
    )
    return kw.unionByName(sem)


def select_injectable(fused: DataFrame, memories: DataFrame, budget: int = BUDGET_TOKENS) -> DataFrame:
    """Anonymized-policy hits in rank order while their running cost fits the budget.

    Costs are positive, so the running-sum filter is the same prefix a loop
    with ``break`` at the first overflow selects. Groups are one query's hits
    (<= 2k rows).
    """
    m = fused.join(memories.select("id", "content", "egress_policy"), "id")
    m = m.where(F.col("egress_policy") == "anonymized")
    cost = (F.floor(F.octet_length("content") / 4) + 2).cast("bigint")
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return m.withColumn("cost", cost).withColumn("used", F.sum("cost").over(w)).where(F.col("used") <= budget)


def memory_block(selected: DataFrame) -> DataFrame:
    """(qid, block): header line + one ``- content`` line per selected memory, in rank order."""
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: F.concat(F.lit("- "), x["content"])
    )
    return selected.groupBy("qid").agg(F.concat_ws("\n", F.lit(BLOCK_HEADER), F.array_join(lines, "\n")).alias("block"))


def nth_smallest(events: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """(key, value of the n-th smallest ``order``).

    ``row_number() <= n`` keeps only the first n rows of a key and partition before
    the shuffle (WindowGroupLimit), so a key holding a third of all rows never meets
    in one task.
    """
    w = Window.partitionBy(key).orderBy(order)
    first = events.select(key, order, F.row_number().over(w).alias("_r")).where(F.col("_r") <= n)
    return first.where(F.col("_r") == n).select(key, F.col(order).alias(f"nth_{order}"))


def record_recalls(memories: DataFrame, recalls: DataFrame) -> DataFrame:
    """Apply recall events (id, ts_ms, ev): counts, last access, promotion + when."""
    agg = recalls.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.max("ts_ms").alias("_last"))
    third = nth_smallest(recalls.select("id", F.struct("ts_ms", "ev").alias("o")), "id", "o", PROMOTE_AT)
    m = memories.join(agg, "id", "left").join(third, "id", "left")
    n = F.col("recall_count") + F.coalesce(F.col("_n"), F.lit(0))
    return m.select(
        "id",
        "content",
        "kind",
        "egress_policy",
        "created_ms",
        n.cast("bigint").alias("recall_count"),
        F.coalesce(F.col("_last"), F.col("accessed_ms")).alias("accessed_ms"),
        (F.col("promoted") | (n >= PROMOTE_AT)).alias("promoted"),
        F.col("nth_o.ts_ms").alias("promoted_at_ms"),
    )


#: Second heading of the export, ours.
EXPORT_NOTE = "One line per stored memory: text, kind, egress policy and how often it was recalled; * marks promoted ones."


def export_lines(memories: DataFrame) -> DataFrame:
    """Markdown audit view as (line_no, line), promoted first, then most recalled, newest."""
    from cloakroom.operators.vault import number_by_first

    star = F.when(F.col("promoted"), F.lit("* ")).otherwise(F.lit(""))
    line = F.format_string("- %s%s  _(%s, %s, recalled %dx)_", star, F.col("content"), F.col("kind"), F.col("egress_policy"), F.col("recall_count"))
    order = F.struct(
        (~F.col("promoted")).alias("a"), (-F.col("recall_count")).alias("b"), (-F.col("created_ms")).alias("c"), F.col("id").alias("d")
    )
    body = memories.select(order.alias("_o"), line.alias("line"), F.lit(0).alias("_g"))
    numbered = number_by_first(body, ["_g"], "_o", out="_n").select((F.col("_n") + 4).alias("line_no"), "line")
    head = memories.sparkSession.createDataFrame(
        [(1, "# Memory"), (2, ""), (3, EXPORT_NOTE), (4, "")],
        "line_no bigint, line string",
    )
    return head.unionByName(numbered)


def list_memories(memories: DataFrame) -> DataFrame:
    """The memories with ``list_rank``: newest first, ties by id."""
    from cloakroom.operators.vault import number_by_first

    keyed = memories.withColumn("_g", F.lit(0)).withColumn("_o", F.struct((-F.col("created_ms")).alias("a"), F.col("id").alias("b")))
    return number_by_first(keyed, ["_g"], "_o", out="list_rank").drop("_g", "_o")


def delete_memories(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """Memories without the deleted ids (rewrite to a new version of the table)."""
    return memories.join(ids.select("id").distinct(), "id", "left_anti")
