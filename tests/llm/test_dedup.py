"""Substring, suffix-array and n-gram operators against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cloakroom.llm import ngram_join, substring_dedup, suffix_dedup
from cloakroom.llm.components import connected

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def _windows_removed(rows, window=13):
    least = {}
    for i, t in rows:
        w = WORD.findall(t)
        for k in range(len(w) - window + 1):
            key, mine = tuple(w[k : k + window]), float("inf") if i is None else i
            least[key] = min(mine, least.get(key, mine))
    out = []
    for i, t in rows:
        w = WORD.findall(t)
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < (float("inf") if i is None else i):
                keep[k : k + window] = [False] * window
        kept = " ".join(x for x, y in zip(w, keep) if y)
        out.append((i, len(w), len(w) - sum(keep), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.fixture(scope="module")
def overlapping(spark):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 50)}" for _ in range(400)]
    rows = []
    for i in range(120):
        a, n = rng.randint(0, 350), rng.choice([5, 12, 13, 14, 40])
        words = [f"u{rng.randint(0, 9)}" for _ in range(rng.randint(0, 20))] + base[a : a + n] + [f"v{rng.randint(0, 9)}" for _ in range(rng.randint(0, 20))]
        rows.append((i // 2 if i % 11 else None, rng.choice([" ", "\n", "  \t"]).join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("table", ["documents", "overlapping", "odd_documents"])
def test_repeated_windows(request, table):
    df = request.getfixturevalue(table)
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["text"]) for r in substring_dedup.remove_repeated_windows(df, with_text=True).collect()]
    want = _windows_removed(_pairs(df))
    assert Counter(g[:4] for g in got) == Counter(w[:4] for w in want)
    texts = defaultdict(set)
    for w in want:
        texts[w[:4]].add(tuple(w[4].split()))
    for g in got:
        assert tuple(WORD.findall(g[4])) in {tuple(WORD.findall(" ".join(t))) for t in texts[g[:4]]}


def test_untouched_texts_stay_as_they_are(spark):
    rows = [(1, " a  b\n c "), (2, "x\ty"), (3, "")]
    got = substring_dedup.remove_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == rows


def test_repeated_windows_of_nothing(no_documents):
    assert substring_dedup.remove_repeated_windows(no_documents).count() == 0


def _bytes_removed(rows, length=200):
    seen = Counter(t.encode()[k : k + length] for _, t in rows for k in range(len(t.encode()) - length + 1))
    out = []
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b) + 1, dtype=int)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()))
    return Counter(out)


@pytest.fixture(scope="module")
def spliced(spark):
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefgh \x00é") for _ in range(3000))
    rows = []
    for i in range(150):
        a, n = rng.randint(0, 2700), rng.choice([100, 199, 200, 201, 230, 400])
        rows.append((i if i % 7 else None, "x" * rng.randint(0, 450) + base[a : a + n] + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 300))) + base[:150] + str(i)))
    rows += [(1, None), (2, ""), (3, "ab" * 500), (4, "abc" * 200), (5, base), (5, base)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("crowd", [suffix_dedup.CROWD, 1])
def test_repeated_bytes(spliced, crowd):
    got = suffix_dedup.remove_repeated_bytes(spliced, with_spans=True, crowd=crowd).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == _bytes_removed(_pairs(spliced))
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got)


def test_repeated_bytes_of_odd_documents(odd_documents, no_documents):
    short = odd_documents.where("doc_id is null or doc_id not in (5, 6)")
    got = suffix_dedup.remove_repeated_bytes(short, length=70).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == _bytes_removed(_pairs(short), 70)
    assert suffix_dedup.remove_repeated_bytes(odd_documents).count() == odd_documents.count()
    assert suffix_dedup.remove_repeated_bytes(no_documents).count() == 0


def test_levels_merge_geometrically():
    family = suffix_dedup.SuffixFamily(4)
    rng = np.random.default_rng(7)
    text = rng.integers(97, 100, 400).astype(np.uint8)
    for lo in range(0, 360, 30):
        family.add(text[lo : lo + 33], np.arange(30))
        sizes = [len(k) for k, _ in family.levels]
        assert sorted(sizes, reverse=True) == sizes and len(set(sizes)) == len(sizes)
    raw = text.tobytes()
    seen = Counter(raw[i : i + 4] for i in range(360))
    assert family.repeated.tolist() == [seen[raw[i : i + 4]] > 1 for i in range(360)]


def _similar(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(t)
        sets.append(frozenset(tuple(w[a : a + 5]) for a in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    classes = defaultdict(list)
    for k, s in enumerate(sets):
        classes[s].append(k)
    keys = list(classes)
    links = defaultdict(set)
    for a in range(len(keys)):
        for b in range(a + 1, len(keys)):
            n = len(keys[a] & keys[b])
            if n and 10 * n >= 8 * (len(keys[a]) + len(keys[b]) - n):
                links[a].add(b)
                links[b].add(a)
    group = {}
    for a in range(len(keys)):
        if a in group:
            continue
        todo = [a]
        while todo:
            x = todo.pop()
            if x not in group:
                group[x] = a
                todo += links[x]

    def least(ids):
        return min((i for i in ids if i is not None), default=None)

    own = {a: least(rows[k][0] for k in classes[s]) for a, s in enumerate(keys)}
    of = {g: least(own[a] for a in group if group[a] == g) for g in set(group.values())}
    return Counter((rows[k][0], own[a], len(links[a]), of[group[a]]) for a, s in enumerate(keys) for k in classes[s])


@pytest.fixture(scope="module")
def near_copies(spark):
    rng = random.Random(8)
    base = [str(rng.randint(0, 9999)) for _ in range(120)]
    rows = []
    for i in range(330):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randint(0, 119)] = str(rng.randint(0, 9999))
        rows.append((i if i % 9 else None, " ".join(w)))
    rows += [(1, None), (2, ""), (3, "a b"), (4, "a  b"), (5, "a b c d e"), (5, "a b c d e"), (6, " ".join("xy" * 400))]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("table", ["documents", "near_copies", "odd_documents"])
def test_similar_documents(request, table):
    df = request.getfixturevalue(table)
    got = Counter((r["doc_id"], r["class_id"], r["n_links"], r["group_id"]) for r in ngram_join.similar_documents(df).collect())
    assert got == _similar(_pairs(df))


def test_large_buckets_meet_in_blocks(near_copies, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUCKET", 40)
    got = Counter((r["doc_id"], r["class_id"], r["n_links"], r["group_id"]) for r in ngram_join.similar_documents(near_copies).collect())
    assert got == _similar(_pairs(near_copies))


def test_similar_documents_of_nothing(no_documents):
    assert ngram_join.similar_documents(no_documents).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    need = ngram_join.least_agreements(0.8, 1e-6)
    assert list(need) == sorted(need)
    rng = np.random.default_rng(9)
    left = rng.integers(0, 256, (20_000, ngram_join.SKETCH), dtype=np.uint8)
    for similarity, share in ((0.8, 1.0), (0.9, 1.0), (0.3, 0.0)):
        right = np.where(rng.random(left.shape) < similarity, left, rng.integers(0, 256, left.shape, dtype=np.uint8))
        assert abs(ngram_join.surviving(left, right, need).mean() - share) < 0.002


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(60)}}
