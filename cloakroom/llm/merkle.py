"""Merkle manifest of a table: a root for each group of rows, one above them, and a witness for each row.

Rows of a group are leaves in the order of their ids. Three consecutive nodes (fewer at
the end) become one of the next level until a single one remains. The tree is built by
aligned append: nodes arrive in order, every open subtree keeps the partial witnesses of
the leaves below it, and each sibling that completes later extends them. Aligned blocks
of ``ARITY**LEVELS`` leaves are appended apart from each other; their roots are nothing
but further appends to the next tree up, and so on to the groups' roots and the one root.
A block is all that a task ever holds, whatever the size of a group.

A witness is a run of steps from the leaf to the root: a byte for the node's place among
its siblings, a byte for their number, and the siblings' digests from left to right.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakroom.session import materialize

ARITY = 3
LEVELS = 4  # of a block
BLOCK = ARITY**LEVELS

_GROUP = ["known", "grp"]  # whether the group's name is there (null names come first), and the name


def node_hash(digests: list[bytes]) -> bytes:
    """sha256 over the digests' hexadecimal text."""
    return sha256(b"".join(digests).hex().encode()).digest()


class Appender:
    """One aligned tree under append. ``leaves`` hold what is known of their witnesses so far."""

    def __init__(self) -> None:
        self.open: list[list[tuple[bytes, list[bytearray], bytearray]]] = [[]]

    def append(self, digest: bytes) -> bytearray:
        """Append a leaf; its witness grows in the returned buffer as its siblings complete."""
        witness = bytearray()
        self._complete(0, digest, [witness])
        return witness

    def _complete(self, level: int, digest: bytes, below: list[bytearray]) -> None:
        if level == len(self.open):
            self.open.append([])
        run = self.open[level]
        for _, _, siblings in run:
            siblings += digest
        run.append((digest, below, bytearray(b"".join(d for d, _, _ in run))))
        if len(run) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        for place, (_, below, siblings) in enumerate(run):
            step = bytes((place, len(run))) + siblings
            for witness in below:
                witness += step
        self._complete(level + 1, node_hash([d for d, _, _ in run]), [w for _, below, _ in run for w in below])

    def finish(self, levels: int | None = None) -> bytes:
        """Close what is open up to ``levels`` levels (until one node remains, if None) and give that node."""
        level = 0
        while level != levels and (levels is not None or len(self.open[level]) != 1 or any(self.open[level + 1 :])):
            if self.open[level]:
                self._close(level)
            level += 1
        return self.open[level][0][0]


def fold(leaf: bytes, witness: bytes) -> bytes:
    """The root that a leaf and its witness lead to."""
    at = 0
    while at < len(witness):
        place, n = witness[at], witness[at + 1]
        cut, end = at + 2 + 32 * place, at + 2 + 32 * (n - 1)
        leaf = node_hash([witness[at + 2 : cut], leaf, witness[cut:end]])
        at = end
    return leaf


def siblings(witness: bytes) -> bytes:
    """The digests of a witness alone, level by level, left to right."""
    out, at = [], 0
    while at < len(witness):
        end = at + 2 + 32 * (witness[at + 1] - 1)
        out.append(witness[at + 2 : end])
        at = end
    return b"".join(out)


def leaf_hash(columns: list[Column]) -> Column:
    """sha256 (binary) of the columns as text: ``-`` for null, else byte count, colon, value."""
    said = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat(*said).cast("binary"), 256))


def _in_order(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``pos``, the row's place in its group, and ``total``, the group's rows. No group meets in one task.

    Rows are dealt by ranges of (group, order), numbered within their partition, and moved
    on by the rows of their group in earlier partitions (a table of partitions and groups).
    """
    dealt = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    local = materialize(dealt.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    before = Window.partitionBy(*group).orderBy("part")
    runs = local.groupBy("part", *group).agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("first"))
    moved = runs.select("part", *group, (F.sum("n").over(before) - F.col("n") - F.col("first")).alias("move"), F.sum("n").over(Window.partitionBy(*group)).alias("total"))
    return local.join(moved, ["part", *group]).withColumn("pos", F.col("nth") + F.col("move")).drop("part", "nth", "move")


def _blocks(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[list[tuple]]:
    """The rows of each block, given sorted by block, as tuples of ``columns`` (key columns first)."""
    key, held = None, []
    for df in batches:
        for row in zip(*(df[c].tolist() for c in columns)):
            if row[:3] != key:
                if held:
                    yield held
                key, held = row[:3], []
            held.append(row)
    if held:
        yield held


def _by_block(df: DataFrame) -> DataFrame:
    keyed = df if "block" in df.columns else df.withColumn("block", F.floor(F.col("pos") / BLOCK))
    return keyed.repartition(*_GROUP, "block").sortWithinPartitions(*_GROUP, "block", "pos")


def _tree(rows: list[tuple], total: int) -> tuple[list[bytearray], bytes]:
    """Witnesses and root of one block; ``rows``: digests in order."""
    tree = Appender()
    witnesses = [tree.append(d) for d in rows]
    return witnesses, tree.finish(LEVELS if total > BLOCK else None)


def _ascend(nodes: DataFrame) -> DataFrame:
    """The blocks' roots, in the form of ``nodes``: known, grp, pos, total, digest."""

    def run(batches):
        out = []
        for rows in _blocks(batches, [*_GROUP, "block", "total", "digest"]):
            known, grp, block, total, _ = rows[0]
            out.append((known, grp, block, -(-total // BLOCK), _tree([r[4] for r in rows], total)[1]))
            if len(out) == 4096:
                yield pd.DataFrame(out, columns=[*_GROUP, "pos", "total", "digest"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=[*_GROUP, "pos", "total", "digest"])

    return _by_block(nodes.select(*_GROUP, "pos", "total", "digest")).mapInPandas(run, "known boolean, grp string, pos long, total long, digest binary")


def _descend(nodes: DataFrame, above: DataFrame, carried: list[str], finish: Callable, schema: str) -> DataFrame:
    """Append once more, and let the path that a block's root has upwards extend its nodes' witnesses.

    ``above``: known, grp, pos (of the block), path, subroot, root. ``finish`` makes a result
    row of a node's row (its columns: the key, pos, total, digest and ``carried``), witness,
    subroot and root.
    """
    head = above.select(*_GROUP, F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("total"), F.col("path").alias("digest"), F.col("pos").alias("block"), "subroot", "root", *[F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in carried])
    rows = nodes.select(*_GROUP, "pos", "total", "digest", F.floor(F.col("pos") / BLOCK).alias("block"), F.lit(None).cast("binary").alias("subroot"), F.lit(None).cast("binary").alias("root"), *carried)
    names = [*_GROUP, "block", "subroot", "root", "pos", "total", "digest", *carried]

    def run(batches):
        out = []
        for first, *rest in _blocks(batches, names):
            path, subroot, root = first[7], first[3], first[4]
            witnesses, _ = _tree([r[7] for r in rest], rest[0][6])
            out += [finish(r[:3] + r[5:], bytes(w + path), subroot, root) for r, w in zip(rest, witnesses)]
            if len(out) >= 2048:
                yield pd.DataFrame(out, columns=_names(schema))
                out = []
        if out:
            yield pd.DataFrame(out, columns=_names(schema))

    return _by_block(rows.unionByName(head)).mapInPandas(run, schema)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


_PATHS = "known boolean, grp string, pos long, path binary, subroot binary, root binary"


def _path(row: tuple, witness: bytes, subroot: bytes, root: bytes) -> tuple:
    return (*row[:2], row[3], witness, subroot, root)


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` and the roots of their blocks, of these blocks' blocks, and so on to one node a group."""
    out = [nodes]
    most = nodes.agg(F.max("total")).collect()[0][0] or 0
    while most > 1:
        out.append(materialize(_ascend(out[-1])))
        most = -(-most // BLOCK)
    return out


def _witnessed(leaves: DataFrame, carried: list[str], finish: Callable, schema: str) -> DataFrame:
    """``leaves``: known, grp, pos, total, digest and what is carried on to ``finish``."""
    levels = _levels(leaves)
    if len(levels) == 1:  # single leaves everywhere: blocks of one
        levels.append(materialize(_ascend(leaves)))
    names = levels[-1].select(F.lit(True).alias("known"), F.lit("").alias("grp"), F.col("known").alias("sub_known"), F.col("grp").alias("sub_grp"), "digest")
    subroots = _in_order(names, ["known", "grp"], ["sub_known", "sub_grp"])
    top = _levels(subroots)
    if len(top) == 1:
        top.append(materialize(_ascend(subroots)))
    paths = top[-1].select(*_GROUP, "pos", F.lit(b"").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    for nodes in top[-2:0:-1]:
        paths = _descend(nodes, paths, [], _path, _PATHS)

    def subroot(row, witness, _, root):
        return (row[6], row[7], 0, witness, row[5], root)

    paths = _descend(subroots, paths, ["sub_known", "sub_grp"], subroot, _PATHS)
    for nodes in levels[-2:0:-1]:
        paths = _descend(nodes, paths, [], _path, _PATHS)
    return _descend(leaves, paths, carried, finish, schema)


def _leaves(docs: DataFrame, columns: list[str], group_col: str, id_col: str, more: dict[str, Column]) -> DataFrame:
    group = F.col(group_col).cast("string")
    hashed = docs.select(
        group.isNotNull().alias("known"),
        F.coalesce(group, F.lit("")).alias("grp"),
        F.col(id_col).cast("long").alias("id"),
        leaf_hash([F.col(c) for c in columns]).alias("digest"),
        *[c.alias(n) for n, c in more.items()],
        F.monotonically_increasing_id().alias("tie"),  # parts equal rows, whose order makes no difference
    )
    ordered = _in_order(materialize(hashed), _GROUP, ["id", "digest", "tie"]).drop("tie")
    return ordered.withColumn("id", F.col("id").cast("string"))  # whole numbers with nulls would be floats in pandas


def manifest(docs: DataFrame, columns: list[str], group_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``id, leaf, subroot, root`` and ``witness`` (all binary but the id).

    ``columns`` make the leaf; ``fold(leaf, witness)`` gives the root. Leaves of a group
    ascend by id, null ids first, rows of equal id by their leaf; repeated rows are leaves
    of their own. Groups are ordered by name, null first, then bytewise; an empty name is
    not a null one. Null and empty values differ. An empty table gives an empty result.
    Other columns are not read.
    """

    def finish(row, witness, subroot, root):
        return (row[6], row[5], subroot, root, witness)

    leaves = _leaves(docs, columns, group_col, id_col, {})
    out = _witnessed(leaves, ["id"], finish, "id string, leaf binary, subroot binary, root binary, witness binary")
    return out.withColumn("id", F.col("id").cast("long"))


def prove_documents(docs: DataFrame, columns: list[str], tampered: dict[str, Column], group_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """Manifest of ``docs`` and a check of their changed form against it.

    ``tampered`` maps columns to what they have become; a row's new leaf is folded with its
    original witness. Per row ``doc_id, leaf, subroot, root, proof_sha256, folded_root``
    (lowercase hex; the proof is the sha256 of the siblings' hex text) and ``verified``.
    Nulls, ties, repeated rows and empty tables as in ``manifest``.
    """
    same = F.lit(True)
    for c, new in tampered.items():
        same = same & F.col(c).eqNullSafe(new)
    changed = F.when(~same, leaf_hash([tampered.get(c, F.col(c)) for c in columns]))

    def finish(row, witness, subroot, root):
        *_, leaf, doc_id, other = row
        folded = fold(other or leaf, witness)
        proof = sha256(siblings(witness).hex().encode()).hexdigest()
        return (doc_id, leaf.hex(), subroot.hex(), root.hex(), proof, folded.hex(), folded == root)

    leaves = _leaves(docs, columns, group_col, id_col, {"changed": changed})
    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _witnessed(leaves, ["id", "changed"], finish, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def without_newlines(id_col: str = "doc_id", text_col: str = "text") -> dict[str, Column]:
    """Tampering that deletes the newlines of texts whose id has an even crc32 (of its decimal form)."""
    hit = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return {text_col: F.when(hit, F.replace(F.col(text_col), F.lit("\n"), F.lit(""))).otherwise(F.col(text_col))}
