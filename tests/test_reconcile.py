"""Reconciliation against a plain walk of the ranking, and its cost on many spans."""

import random
import time

import pytest
from pyspark.sql import functions as F

from cloakroom.operators.detect import CANDS_TYPE
from cloakroom.operators.reconcile import reconcile_sql

FIELDS = [f.name for f in CANDS_TYPE.elementType.fields]


def cand(s, e, pri=3, blen=None, score=0.5, ins=0, secret=False):
    v = "x" * (e - s)
    return dict(s=s, e=e, v=v, kind="k", tag="T", secret=secret, custom=False, score=score, detector="d", pri=pri, ins=ins, blen=e - s if blen is None else blen)


def plain(cands):
    kept = []
    for c in sorted(cands, key=lambda c: (-c["pri"], -c["blen"], -c["score"], c["s"], c["ins"])):
        if not any(c["s"] < k["e"] and k["s"] < c["e"] for k in kept):
            kept.append(c)
    return sorted((c["s"], c["e"], c["ins"]) for c in kept)


def run(spark, rows, harden=False):
    schema = "id int, c " + CANDS_TYPE.simpleString()
    df = spark.createDataFrame([(i, [tuple(c[f] for f in FIELDS) for c in r]) for i, r in enumerate(rows)], schema)
    out = df.select("id", F.expr(reconcile_sql("`c`", harden)).alias("k")).orderBy("id").collect()
    return [[(k["s"], k["e"], k["ins"]) for k in r["k"]] for r in out]


@pytest.mark.parametrize("spread", [12, 60, 400])
def test_equals_the_plain_walk(spark, spread):
    rng = random.Random(spread)
    rows = [[], [cand(0, 1)]]
    for _ in range(60):
        row = []
        for i in range(rng.randint(1, 40)):
            s = rng.randrange(spread)
            row.append(cand(s, s + rng.randint(1, 9), rng.randint(1, 3), rng.randint(1, 9), rng.choice([0.5, 0.75]), i))
        rows.append(row)
    assert run(spark, rows) == [plain(r) for r in rows]


def test_components_that_touch_and_nest(spark):
    rows = [
        [cand(0, 5), cand(5, 8, ins=1), cand(8, 9, ins=2)],
        [cand(0, 20, pri=1), cand(2, 4, ins=1), cand(4, 6, ins=2), cand(19, 25, pri=1, blen=1, ins=3)],
        [cand(3, 6, blen=3, ins=0), cand(3, 6, blen=3, ins=1)],
    ]
    assert run(spark, rows) == [plain(r) for r in rows]


def test_hardening_masks_the_rest_of_a_secret(spark):
    rows = [[cand(0, 30, pri=1, secret=True), cand(5, 10, ins=1), cand(40, 50, ins=2)]]
    got = run(spark, rows, harden=True)[0]
    assert sorted(x[:2] for x in got) == [(0, 5), (5, 10), (10, 30), (40, 50)]


def test_sixteen_thousand_spans_in_one_text(spark):
    rows = [[cand(4 * i, 4 * i + (5 if i % 3 else 3), ins=i) for i in range(16_000)]]
    run(spark, [rows[0][:10]])
    t = time.time()
    got = run(spark, rows)
    assert time.time() - t < 20 and len(got[0]) > 8_000
