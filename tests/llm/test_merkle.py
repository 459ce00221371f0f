"""The Merkle manifest against a plain tree, and its SQL."""

import hashlib
import random
import zlib

import pytest

from cloakroom.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def said(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(nodes):
    """Root and each leaf's siblings as a list of (before, after)."""
    proofs, below = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 3, len(nodes))) for i in range(0, len(nodes), 3)]
        for run in runs:
            for k in run:
                step = ([nodes[x] for x in run if x < k], [nodes[x] for x in run if x > k])
                for i in below[k]:
                    proofs[i].append(step)
        below = [[i for k in run for i in below[k]] for run in runs]
        nodes = [H(*(nodes[k] for k in run)) for run in runs]
    return nodes[0], proofs


def plain(rows):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of dict rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r, H(*(said(r[c]) for c in COLUMNS))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = []
    for s in names:
        groups[s].sort(key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
        subs.append(plain_tree([leaf for _, leaf in groups[s]]))
    root, tops = plain_tree([r for r, _ in subs])
    out = []
    for s, (subroot, proofs), top in zip(names, subs, tops):
        for (r, leaf), proof in zip(groups[s], proofs):
            new = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None:
                new["text"] = r["text"].replace("\n", "")
            folded = H(*(said(new[c]) for c in COLUMNS))
            for before, after in proof + top:
                folded = H(*before, folded, *after)
            flat = [d for step in proof + top for side in step for d in side]
            out.append((r["doc_id"], leaf, subroot, root, H(*flat), folded, folded == root))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def check(df):
    got = [tuple(r) for r in merkle.prove_documents(df, COLUMNS, merkle.without_newlines()).collect()]
    want = plain([r.asDict() for r in df.select(*COLUMNS).collect()])
    assert sorted(got, key=key) == sorted(want, key=key)


def frame(spark, sizes):
    rng = random.Random(3)
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            i += rng.randint(1, 5)
            text = rng.choice([None, "", "one line", "two\nlines", "Ünï\ncödé 漢字 😀\n", "\n\n"])
            rows.append((i, s, rng.choice([None, "en", ""]), rng.choice([None, 0, -5, 1 << 60]), text))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


def test_documents(documents):
    check(documents)


def test_group_sizes_around_blocks(spark):
    sizes = {None: 5, "": 1, "a": 2, "b": 3, "c": 4, "d": 27, "e": 80, "f": 81, "g": 82, "h": 244, "é": 9, "z": 10, "~": 1}
    check(frame(spark, sizes).repartition(5))


def test_one_hot_group_beyond_two_block_levels(spark):
    check(frame(spark, {"hot": 81 * 81 + 5, "cold": 3}).repartition(7))


@pytest.mark.parametrize("sizes", [{"only": 1}, {"only": 4}, {str(i): 1 for i in range(250)}])
def test_lone_leaves_and_many_groups(spark, sizes):
    check(frame(spark, sizes))


def test_odd_documents(spark, odd_documents):
    from pyspark.sql import functions as F

    odd = odd_documents.withColumn("n_chars", F.lit(None).cast("long")).withColumn("known", F.lit(1)).withColumn("digest", F.lit("x")).withColumn("pos", F.lit(2))
    check(odd.unionByName(odd).unionByName(odd.where("doc_id is null")))
    assert merkle.prove_documents(odd.where("false"), COLUMNS, merkle.without_newlines()).collect() == []


def test_witness_of_the_manifest_folds_to_the_root(spark):
    rows = merkle.manifest(frame(spark, {"a": 100, "b": 7, None: 1}), COLUMNS).collect()
    assert len(rows) == 108
    for r in rows:
        assert merkle.fold(bytes(r["leaf"]), bytes(r["witness"])) == bytes(r["root"])
        assert merkle.fold(bytes(32), bytes(r["witness"])) != bytes(r["root"])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 28, 80, 81])
def test_appender(n):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    tree = merkle.Appender()
    witnesses = [tree.append(d) for d in leaves]
    root, proofs = plain_tree([d.hex() for d in leaves])
    assert tree.finish().hex() == root
    for d, w, p in zip(leaves, witnesses, proofs):
        assert merkle.siblings(bytes(w)).hex() == "".join(x for step in p for side in step for x in side)
        assert merkle.fold(d, bytes(w)).hex() == root
