"""Merkle trees over the rows of a table, with a proof for every row, by time-forward processing."""

from __future__ import annotations

import heapq
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.positions import with_position
from flowsieve.llm.shipping import ready
from flowsieve.session import cut

#: Children of an inner node, and the levels that one task hashes: a block has ARITY ** LEVELS nodes.
ARITY, LEVELS = 2, 10

STEP = "array<struct<left: string, right: string>>"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 (hex) of the fields in order: ``-`` for null, else the length in bytes, ``:`` and the value."""
    shown = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in shown]
    return F.sha2(F.concat(*parts), 256)


def height(nodes: int, arity: int) -> int:
    """Levels until one node is left."""
    levels = 0
    while nodes > 1:
        nodes = -(-nodes // arity)
        levels += 1
    return levels


def climb(digests: list[str], levels: int, arity: int) -> tuple[str, list[list[dict]]]:
    """(digest of the node ``levels`` above, proof of every given node up to there).

    Forward sweep: a priority queue ordered by node label (level, index) delivers the digests of its
    children to each node, which sends its own one on to its parent. Reversed sweep: labels come out from the
    root down; a node gets its proof from its parent and sends its children theirs, with what they need
    of each other in front. A proof's step has the digests left and right of the node, concatenated.
    """
    queue = [(0, index, 0, digest) for index, digest in enumerate(digests)]
    children: dict[tuple[int, int], list[str]] = {}
    top = ""
    while queue:
        level, index, _, digest = heapq.heappop(queue)
        if level:
            parts = [digest]
            while queue and queue[0][:2] == (level, index):
                parts.append(heapq.heappop(queue)[3])
            children[level, index] = parts
            digest = sha256("".join(parts).encode()).hexdigest()
        if level < levels:
            heapq.heappush(queue, (level + 1, index // arity, index, digest))
        else:
            top = digest
    proofs: list[list[dict]] = [[] for _ in digests]
    back: list[tuple] = [(-levels, 0, ())]
    while back:
        level, index, proof = heapq.heappop(back)
        if not level:
            while proof:
                step, proof = proof
                proofs[index].append(step)
            continue
        parts = children[-level, index]
        for k in range(len(parts)):
            step = {"left": "".join(parts[:k]), "right": "".join(parts[k + 1 :])}
            heapq.heappush(back, (level + 1, index * arity + k, (step, proof)))
    return top, proofs


def _climb_block(arity: int, levels: int):
    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("position")
        size = block["size"][0].as_py()
        up = min(levels, height(size, arity))
        top, proofs = climb(block["digest"].to_pylist(), up, arity)
        step = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        columns = {c: block[c] for c in ("tree", "position", "size", "block")}
        return pa.table({**columns, "proof": pa.array(proofs, step), "top": pa.array([top] * len(proofs), pa.string())})

    return run


def forest(nodes: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """(tree, position, proof, root) of ``nodes(tree, position, size, digest)``, the leaves of any number of trees.

    Leaves of a tree have the positions 0 .. size - 1. The external queue is Spark's: each round deals the nodes
    to their blocks, a task sweeps one block at a time, forward and back, and what leaves the block, its top, is
    a row of the next round. As many rounds as it takes for one block per tree; then the proofs
    of the tops go back down, round by round. A block has arity ** levels nodes, however large its tree.
    """
    width = arity**levels
    rounds = []
    schema = f"tree bigint, position bigint, size bigint, block bigint, proof {STEP}, top string"
    while True:
        dealt = nodes.withColumn("block", F.floor(F.col("position") / width))
        done = cut(dealt.groupBy("tree", "block").applyInArrow(_climb_block(arity, levels), schema))
        rounds.append(done)
        larger = done.where(F.col("size") > width)
        if not (largest := done.agg(F.max("size")).first()[0]) or largest <= width:
            break
        nodes = larger.where(F.col("position") % width == 0).select(
            "tree", F.col("block").alias("position"), F.ceil(F.col("size") / width).alias("size"), F.col("top").alias("digest")
        )
    above = rounds.pop().select("tree", "position", "proof", F.col("top").alias("root"))
    while rounds:
        upper = above.select("tree", F.col("position").alias("block"), F.col("proof").alias("__more"), "root")
        joined = rounds.pop().join(upper, ["tree", "block"], "left")
        proof = F.concat("proof", F.coalesce("__more", F.expr(f"cast(array() as {STEP})")))
        above = joined.select("tree", "position", proof.alias("proof"), F.coalesce("root", "top").alias("root"))
    return above


def merkle_manifest(
    docs: DataFrame,
    leaf: Column,
    id_col: str = "doc_id",
    group_col: str = "lang",
    carried: dict[str, Column] | None = None,
    arity: int = ARITY,
    levels: int = LEVELS,
) -> DataFrame:
    """One row per row of ``docs``: its id and group, leaf, proof, subroot, root, and the ``carried`` columns.

    Per group the leaves ascend by id; every ``arity`` consecutive nodes of a level become one (the last run has
    fewer, even one) until one is left, the subroot; a lone leaf is one itself. Subroots in the order of their groups
    (null first, strings by their bytes) make one more tree in the same way, whose top is the root. The proof lists,
    from the leaf to the root, the digests left and right of the node in its run (``fold_proof``).

    Null ids come first in their group, null groups are a group; rows with the same id are ordered by their digests, so
    repeated rows are leaves of their own; an empty table has no rows and no root. Only digests and ids are
    shuffled, never the columns of ``docs``, so their names cannot clash.
    """
    ready(docs.sparkSession)
    more = [c.alias(f"__c{k}") for k, c in enumerate((carried or {}).values())]
    names = [f"__c{k}" for k in range(len(more))]
    rows = cut(docs.select(F.col(f"`{group_col}`").alias("__group"), F.col(f"`{id_col}`").alias("__id"), leaf.alias("__leaf"), *more))
    placed = cut(with_position(rows, F.struct("__group", "__id", "__leaf"), "__at"))
    groups = cut(placed.groupBy("__group").agg(F.min("__at").alias("tree"), F.count(F.lit(1)).alias("size")))
    groups = groups.withColumnRenamed("__group", "__of")
    leaves = placed.join(groups, F.col("__group").eqNullSafe(F.col("__of"))).withColumn("position", F.col("__at") - F.col("tree"))
    leaves = cut(leaves.select("tree", "position", "size", "__id", "__group", "__leaf", *names))
    inner = forest(leaves.select("tree", "position", "size", F.col("__leaf").alias("digest")), arity, levels)
    inner = cut(inner.withColumnRenamed("root", "subroot"))

    tops = inner.where("position = 0").select("tree", F.col("subroot").alias("digest"))
    tops = cut(with_position(tops, F.col("tree"), "position"))
    count = tops.count()
    upper = forest(tops.select(F.lit(0).cast("long").alias("tree"), "position", F.lit(count).cast("long").alias("size"), "digest"), arity, levels)
    upper = cut(upper.join(tops.select("position", F.col("tree").alias("__tree")), "position").select(
        F.col("__tree").alias("tree"), F.col("proof").alias("__more"), "root"
    ))
    whole = leaves.join(inner, ["tree", "position"]).join(upper, "tree")
    return whole.select(
        F.col("__id").alias(id_col), F.col("__group").alias(group_col), F.col("__leaf").alias("leaf"),
        F.concat("proof", "__more").alias("proof"), "subroot", "root",
        *[F.col(n).alias(name) for n, name in zip(names, carried or {})],
    )


def fold_proof(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 (hex) of all digests of a proof, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""), 256)
