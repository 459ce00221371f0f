"""The positional phrase join against the inline scan of every term."""

import random

import pytest
from pyspark.sql import functions as F

from cloakroom.functions import sqltext as Q
from cloakroom.operators.detect import Gazetteer, Profile
from cloakroom.operators.gazetteer_join import JoinedGazetteer, attach_terms, placed_tokens


def spans(df, profile):
    out = df.select("ord", profile.candidates(F.col("text")).alias("c")).collect()
    return {r["ord"]: sorted((c["s"], c["e"], c["v"], c["ins"] % 1000) for c in r["c"]) for r in out}


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_inline_gazetteer(spark, texts, seed):
    rng = random.Random(seed)
    alphabet = ["a", "b", "A", "é", "7", " ", "-", ".", "\n", "ab", "a b", "😀"]
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    rows = [(None if i % 5 == 0 else "s", i, 0, make(rng.randint(0, 40))) for i in range(80)]
    terms = list({make(rng.randint(1, 6)).strip("\n") for _ in range(60)} - {""})
    vocab = spark.createDataFrame([(t, "project", i) for i, t in enumerate(terms)], "term string, label string, ins int")
    df = texts(rows)
    got = spans(attach_terms(df, vocab), Profile([JoinedGazetteer()]))
    want = spans(df, Profile([Gazetteer([(t, "project") for t in terms])]))
    assert got == want and sum(map(len, want.values())) > 50


def test_terms_of_a_session_stay_in_it(spark, texts):
    vocab = spark.createDataFrame([(None, "blue heron", "person", 0), ("s", "heron", "org", 0)], "session string, term string, label string, ins int")
    df = attach_terms(texts([(None, 1, 0, "a blue heron"), ("s", 2, 0, "a blue heron"), ("t", 3, 0, "a blue heron")]), vocab, by_session=True)
    assert {k: [x[:3] for x in v] for k, v in spans(df, Profile([JoinedGazetteer()])).items()} == {1: [(2, 12, "blue heron")], 2: [(7, 12, "heron")], 3: []}


def test_places_of_tokens_in_long_texts(spark):
    text = " ".join(f"w{i},é" for i in range(5000))
    row = spark.createDataFrame([(text,), ("",), ("--",), ("x",)], "t string").select("t", F.expr(placed_tokens("`t`")).alias("k")).collect()
    for r in row:
        assert all(r["t"][k["at"] : k["at"] + len(k["v"])] == k["v"] for k in r["k"])
    assert [len(r["k"]) for r in row] == [10000, 0, 0, 1] and row[0]["k"][0]["nx"] == "é" and row[0]["k"][-1]["nx"] is None


def test_running_sums(spark):
    n = 1000
    df = spark.range(1).select(F.expr(f"transform(sequence(1, {n}), i -> CAST(i AS INT))").alias("xs"), F.expr("CAST(array() AS array<int>)").alias("none"))
    got = df.select(F.expr(Q.running("`xs`")).alias("r"), F.expr(Q.running("`none`")).alias("z")).first()
    assert list(got["r"]) == [i * (i + 1) // 2 for i in range(1, n + 1)] and list(got["z"]) == []
