"""Language identification, toxicity, fingerprints and vector search."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakroom.llm import fingerprints, language_id, toxicity, vector_search

DIR = "/root/testdata/sf0.01"


def _held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_kneser_ney_probabilities_sum_to_one():
    events = {lang: language_id._events(dict_of) for lang, dict_of in (("a", {"abab": 3, "abba": 2, "ca": 1}), ("b", {"cab": 4, "bb": 1}))}
    model = language_id.Model.build(events)
    letters = sorted({c for e in events.values() for g in e for c in g})
    for lang in range(2):
        for word in ("ab", "abb", "xa"):
            base = model.word_scores([word])[0, lang] - _last(model, word, " ")[lang]
            total = sum(np.exp(_last(model, word, c)[lang]) for c in letters) + np.exp(_last(model, word, "\x7f")[lang])
            assert np.isfinite(base) and abs(total - 1) < 1e-4


def _last(model, word, char):
    """Log probability of ``char`` after a blank and ``word``."""
    if char == " ":
        return model.word_scores([word])[0] - sum(_last(model, word[:i], word[i]) for i in range(len(word)))
    chars = language_id._codes(f" {word}{char}")
    out = np.zeros(len(model.languages))
    for n in range(min(language_id.ORDER, len(chars)), 0, -1):
        found, row = language_id._find(model.hashes[n - 1], language_id._tail_hashes(chars, n)[-1:])
        if found[0]:
            return out + model.logp[n - 1][row[0]]
        if n > 1:
            found, row = language_id._find(model.contexts[n - 1], language_id._tail_hashes(chars[:-1], n - 1)[-1:])
            if found[0]:
                out = out + model.backoff[n - 1][row[0]]
    return out + model.unseen


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = language_id.identify_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    test = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in test} == {r["doc_id"] for r in rows if _held_out(r["doc_id"])}
    assert sum(r["lang_pred"] == r["lang"] for r in test) / len(test) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_and_copies_of_id_are_no_input(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = language_id.learn(docs)
    plain = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, model).collect()}
    shifted = docs.withColumn("doc_id", F.col("doc_id") + 7).withColumn("lang", F.lit("xx"))
    assert plain == {r["doc_id"] - 7: r["lang_pred"] for r in language_id.identify(shifted, model).collect()}


def test_languages_of_odd_documents(odd_documents, no_documents):
    rows = language_id.identify_documents(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (2, 3, 4, 8) or (r["doc_id"] is None and r["score"] == 0))
    assert language_id.identify_documents(no_documents).count() == 0
    assert {r["lang_pred"] for r in language_id.identify_documents(odd_documents.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_folding_and_exceptions():
    assert toxicity.fold("1D10T") == "idiot" and toxicity.fold("stуpid") == "stypid"
    assert toxicity.fold("іdіot $cum 2024 4.0 x$$$") == "idiot scum 2024 4.0 x$$$"
    model = toxicity.Model({"idiot$": 3.0, "scum": 2.0}, ["useful idiot", "scumble"], [-1.0, 1.0, 1.0, 0.0, 0.0, 0.0])
    m = toxicity.Matcher(model)
    assert [h[2] for h in m.hits(toxicity.fold("An IDIOT, scummy; idiots"))] == [3.0, 2.0]
    assert m.features("useful idiot scumble")[3] == 0 and m.features("useful idiot, idiot")[3] == 1


def test_toxicity_of_held_out_documents(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    bad = [r for r in rows if r["toxic"]]
    assert sum(r["predicted"] for r in bad) / len(bad) > 0.85
    assert sum(r["predicted"] for r in rows if not r["toxic"]) / len(rows) < 0.01
    assert all(_held_out(r["doc_id"]) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_toxicity_of_odd_documents(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, None), (None, 1, 1), (6, None, 1), (6, 1, 0), (8, 0, 1)], "doc_id long, toxic int, quality int")
    rows = toxicity.score_documents(odd_documents, labels).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == _held_out(r["doc_id"]) for r in rows)
    assert toxicity.score_documents(no_documents, labels).count() == 0
    assert {r["score"] for r in toxicity.score_documents(odd_documents, labels.where("false")).collect()} == {0.0}


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distances_equal_the_plain_table():
    rng = random.Random(11)
    left, right = (["".join(rng.choice("abc") for _ in range(rng.randint(0, 64))) for _ in range(150)] for _ in range(2))
    left[:3], right[:3] = ["", "", "a" * 64], ["", "abc", "a" * 64]
    assert fingerprints._distances(left, right).tolist() == [_edit(a, b) for a, b in zip(left, right)]


def test_fingerprints_follow_the_text_alone():
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcdef \né") for _ in range(rng.choice([0, 3, 50, 900, 7000]))).encode() for _ in range(60)]
    together = fingerprints.fingerprints(texts)
    assert together == [fingerprints.fingerprints([t])[0] for t in texts]
    assert all(len(s) <= fingerprints.LONGEST for f in together for s in f.split(":")[1:])
    long = texts[[len(t) > 6000 for t in texts].index(True)]
    cut, other = long[:3000] + b"changed here" + long[3000:], bytes(reversed(long))
    a, b, c = fingerprints.fingerprints([long, cut, other])
    assert fingerprints.likeness([a], [a])[0] == 1 and fingerprints.likeness([a], [b])[0] > 0.8 > 0.4 > fingerprints.likeness([a], [c])[0]


@pytest.mark.parametrize("table", ["documents", "odd_documents"])
def test_comparison_with_the_next(request, table):
    df = request.getfixturevalue(table)
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in df.collect()))
    want = []
    for k, (known, doc, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][2]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, marked, other = fingerprints.fingerprints([text.encode(), edited.encode(), after.encode()])
        want.append((doc if known else None, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, marked, fingerprints.likeness([own], [marked])[0], fingerprints.likeness([own], [other])[0]))
    for rows_each in (4000, 3):
        got = [tuple(r) for r in fingerprints.compare_with_next(df, rows_each=rows_each).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_comparison_of_few(spark, no_documents):
    assert fingerprints.compare_with_next(no_documents).count() == 0
    one = fingerprints.compare_with_next(spark.createDataFrame([(9, "abcdef")], "doc_id long, text string")).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and one[0]["near_next"] == 1


def test_code_bounds_hold():
    rng = np.random.default_rng(13)
    for d in (3, 64, 100):
        x = rng.standard_normal((2000, d)) * rng.lognormal(0, 0.5, (2000, 1)) + 0.3
        code = vector_search.Code.fit(x.mean(axis=0), 3.0)
        estimate, error = code.bounds(x[:40], *code.encode(x))
        exact = x[:40] @ x.T
        assert (np.abs(estimate - exact) <= error).mean() > 0.985


def _nearest(rows, k):
    out = []
    rows = sorted(rows.items())
    for q, v in rows:
        if q % 20 == 0:
            best = sorted(((float((np.array(v) * np.array(x)).sum()), i) for i, x in rows if i != q), key=lambda z: (-z[0], z[1]))[:k]
            out += [(q, r, i, s) for r, (s, i) in enumerate(best, 1)]
    return out


def test_recall_on_the_table(spark):
    e = spark.read.parquet(f"{DIR}/embeddings.parquet")
    want = _nearest({r["vec_id"]: [float(v) for v in r["embedding"]] for r in e.collect()}, 20)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vector_search.nearest(e, vector_search.every(20)).collect()}
    assert len(got) == len(want)
    found = {(q, v) for (q, _), (v, _) in got.items()}
    assert sum((q, i) in found for q, _, i, _ in want) / len(want) > 0.99
    exact = {(q, i): s for q, _, i, s in want}
    assert all(abs(s - exact[q, v]) < 1e-12 for (q, _), (v, s) in got.items() if (q, v) in exact)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, [-3.0, 0.5]), (8, [1.0]), (9, []), (None, [5.0, 5.0]), (40, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, norm string, id int")
    got = sorted(tuple(r) for r in vector_search.nearest(df, vector_search.every(20)).collect())
    assert got == _nearest({0: [1, 2], 20: [1, 2], 1: [1, 2], 7: [-3, 0.5]}, 20)
    assert vector_search.nearest(df.where("false"), vector_search.every(20)).count() == 0
    assert vector_search.nearest(df.where("vec_id = 20"), vector_search.every(20)).count() == 0
