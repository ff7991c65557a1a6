"""Merkle manifest of a dataset by nested-struct rollup.

Every row is a leaf; the leaves of a language, ascending by doc_id, form a
binary tree, and the subroots of the languages form one above them.  A leaf's
rank in its language is written in binary digits.  Blocks of ``2 ** bits``
consecutive ranks are dealt to tasks, and inside a block the digit columns are
grouped away one after the other, lowest first: each grouping nests the two
child structs in their parent and hashes them, without another shuffle, as the
block is part of every grouping key.  What is left, one row a block with its
digest and the nested tree, is a leaf of the next tier, which is rolled up the
same way.  On the way down a ``transform`` for each level walks the nested
structs and an ``explode`` emits the proofs: a block meets the proof of its own
digest in one grouping by block, so proofs need no join.

Bounds: a task holds blocks of ``2 ** bits`` leaves (about 300 bytes each) and
their proofs; nothing but the size of the largest tree reaches the driver.
Ranks come from a range partitioning of the leaves (ids and digests, no texts)
and the row counts of its partitions; equal rows are parted by a tie number, so
a row repeated a million times is spread too.

Defined results: a null value is the token ``-`` and differs from an empty
one; rows with a null doc_id come first in their language; rows of one doc_id
are leaves of their own, ordered by digest; a null language is a tree of its
own, before all others and apart from the empty one; a tree of one leaf has
that leaf as its root and no sibling; an empty table has no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

BITS = 6  # 64 leaves a block
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

PATH = "array<struct<side:string,digest:string>>"
ABOVE = f"struct<path:{PATH},subroot:string,root:string>"


def hashed(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def token(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    return hashed(F.concat(*[token(changed.get(f, F.col(f))) for f in FIELDS]))


def levels(n: Column) -> Column:
    """Levels of hashing above ``n`` nodes: the bits of ``n - 1``."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (g, digest, body and the columns of ``order``) as ``(g, rank, n,
    digest, body)``: the place in the order of its group, and the group's size."""
    order = ["g", *order, "_tie"]
    placed = checkpointed(
        rows.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .select("g", "digest", "body", F.monotonically_increasing_id().alias("at")))
    placed = placed.withColumn("part", F.shiftright("at", 33))
    parts = placed.groupBy("g", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("g", "part", (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
                         F.sum("rows").over(Window.partitionBy("g")).alias("n"))
    return placed.join(parts, ["g", "part"]).select("g", (F.col("at") + F.col("shift")).alias("rank"), "n", "digest", "body")


def rolled_up(rows: DataFrame, bits: int) -> DataFrame:
    """``(g, block, n, digest, tree)``: every block of ranks as one nested tree."""
    d = rows.repartition("g", F.shiftright("rank", bits)).select(
        "g", F.shiftright("rank", bits).alias("block"), "n",
        *[F.shiftright("rank", i).bitwiseAND(1).cast("int").alias(f"digit{i}") for i in range(bits)],
        F.struct("digest", "body").alias("node"))
    for k in range(1, bits + 1):
        digit = F.col(f"digit{k - 1}")
        kid = [F.first(F.when(digit == side, F.col("node")), ignorenulls=True).alias(f"kid{side}") for side in (0, 1)]
        d = d.groupBy("g", "block", *[f"digit{i}" for i in reversed(range(k, bits))]).agg(F.first("n").alias("n"), *kid)
        below = F.concat(F.col("kid0.digest"), F.coalesce("kid1.digest", F.lit("")))
        digest = F.when(levels(F.col("n")) >= k, hashed(below)).otherwise(F.col("kid0.digest"))
        node = F.struct(digest.alias("digest"), F.array_compact(F.array("kid0", "kid1")).alias("kids"))
        d = d.withColumn("node", node).drop("kid0", "kid1")
    return d.select("g", "block", "n", "node.digest", F.col("node").alias("tree"))


def tiers(rows: DataFrame, bits: int) -> list[DataFrame]:
    """The blocks of each tier, leaves first; the last has one block a group."""
    made = []
    while True:
        made.append(checkpointed(rolled_up(rows, bits)))
        last = made[-1].agg(F.max("block")).first()[0]
        if not last:
            return made
        rows = made[-1].select("g", F.col("block").alias("rank"), F.shiftright(F.col("n") + ((1 << bits) - 1), bits).alias("n"),
                               "digest", F.struct("block").alias("body"))


def _steps(k: int, n: Column) -> Callable[[Column], Column]:
    """From a node of level ``k`` of a group of ``n`` to its children, each with
    the proof steps from itself upwards."""
    def below(child: Column, side: Column, sibling: Column, path: Column) -> Column:
        step = F.array(F.struct(side.alias("side"), sibling.alias("digest")))
        return F.struct(child.alias("node"), F.when(levels(n) >= k, F.concat(step, path)).otherwise(path).alias("path"))

    def children(x: Column) -> Column:
        a, b = F.get(x["node"]["kids"], F.lit(0)), F.get(x["node"]["kids"], F.lit(1))
        lone = F.when(b.isNull(), F.lit("none")).otherwise(F.lit("right"))
        return F.array_compact(F.array(below(a, lone, b["digest"], x["path"]),
                                       F.when(b.isNotNull(), below(b, F.lit("left"), a["digest"], x["path"]))))
    return children


def handed_down(blocks: DataFrame, above: DataFrame, bits: int) -> DataFrame:
    """``(g, digest, body, above)`` of every node under the blocks; ``above``
    has the proof of each block as ``(g, block, above)``."""
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    d = blocks.select("g", "block", "n", "tree", none("above", ABOVE)).unionByName(
        above.select("g", "block", none("n", "long"), none("tree", blocks.schema["tree"].dataType), "above"))
    d = d.groupBy("g", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "tree", "above")])
    paths = F.array(F.struct(F.col("tree").alias("node"), F.col("above.path").alias("path")))
    for k in reversed(range(1, bits + 1)):
        paths = F.flatten(F.transform(paths, _steps(k, F.col("n"))))
    d = d.select("g", "above", F.explode(paths).alias("at"))
    return d.select("g", "at.node.digest", "at.node.body", F.struct(
        F.col("at.path").cast(PATH).alias("path"), "above.subroot", "above.root").alias("above"))


def proofs(made: list[DataFrame], above: DataFrame, bits: int) -> DataFrame:
    """Proofs of all leaves under the tiers ``made``, from those of their tops."""
    for blocks in reversed(made[1:]):
        above = handed_down(blocks, above, bits).select("g", "body.block", "above")
    return handed_down(made[0], above, bits)


def merkle_manifest(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Per row ``(doc_id, leaf, subroot, root, proof, tampered)``: ``proof`` has
    the siblings from the leaf up, each with its side (``none``: the node is
    alone and is hashed again), ``tampered`` the leaf digest after adding 1 to
    n_chars where 7 divides the crc32 of the decimal doc_id, else null."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    leaves = checkpointed(docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")).alias("g"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf_digest().alias("digest"), F.when(hit, leaf_digest(n_chars=more)).alias("tampered")))
    leaves = leaves.select("g", "doc_id", "digest", F.struct("doc_id", "tampered").alias("body"))
    trees = tiers(ranked(leaves, "doc_id", "digest"), bits)
    tops = trees[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), "digest", F.struct("g").alias("body"))
    forest = tiers(ranked(checkpointed(tops), "name"), bits)
    root = forest[-1].select("g", "block", F.struct(
        F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root")).alias("above"))
    named = proofs(forest, root, bits).select(
        "body.g", F.lit(0).cast("long").alias("block"),
        F.struct("above.path", F.col("digest").alias("subroot"), "above.root").alias("above"))
    return proofs(trees, named, bits).select(
        "body.doc_id", F.col("digest").alias("leaf"), "above.subroot", "above.root", F.col("above.path").alias("proof"), "body.tampered")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda acc, s: F.when(s["side"] == "left", hashed(F.concat(s["digest"], acc)))
                       .when(s["side"] == "right", hashed(F.concat(acc, s["digest"]))).otherwise(hashed(acc)))


def proof_digests(manifest: DataFrame) -> DataFrame:
    d = manifest.select(
        "doc_id", "leaf", "subroot", "root",
        hashed(F.array_join(F.transform("proof", lambda s: s["digest"]), "")).alias("proof_sha256"),
        folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return d.withColumn("verified", F.col("folded_root") == F.col("root"))
