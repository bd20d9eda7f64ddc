"""Merkle manifest of a dataset: checkpoint and recompute.

Every document is a leaf, every group (language) a binary tree over its leaves,
and the groups' roots are the leaves of one more tree.  Only one level in
``LEVELS_KEPT`` is stored: its nodes lie in packs of 2 ** LEVELS_KEPT, each the
base of an aligned subtree.  The levels between are never written: a proof
regenerates them from the pack, takes the siblings and lets them go.

* ``leaf_hash``: sha256 of the length-prefixed fields.
* ``ranked``: positions within a group by a range partition and run offsets, so
  that a group is never one task, however many rows it holds.
* ``plant``: the stored levels of all trees of a table of nodes.
* ``prove``: paths of all leaves, from the top pack down; what a pack knows of
  the levels above it travels once a pack, not once a leaf.
* ``manifest``: both trees, with root and path of every document.

A path is an array of (l, r): the sibling's digest on its side and the empty
string on the other; a node without sibling has two empty strings.  ``folded``
turns a leaf and its path into a root, so a proof can be checked without the
table.  Hashing is SQL functions throughout.

Defined cases: null fields hash as ``-``; a null group is a group of its own
and comes first; null ids come first in a group; rows that share an id are
ordered by leaf; repeated rows are leaves of their own; an empty table has no
rows (and no root).  Columns other than the named ones play no part.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemspace.llm.runtime import id_bucket, stored

LEVELS_KEPT = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field_text(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field_text(v) for v in values]), 256)


def group_key(group: Column) -> Column:
    """A text that orders as the group does, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def ranked(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes`` (key, ...) with pos, the place in the key by ``order``, and n,
    the key's rows.  Equal rows are spread by chance: any of their orders is right."""
    by = ["key", *order, "_tie"]
    dealt = (nodes.withColumn("_tie", F.rand(13)).repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
             .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    placed = stored(dealt, "ranked")
    runs = placed.groupBy("key", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("key", "part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"),
                       F.sum("rows").over(Window.partitionBy("key")).alias("n"))
    return (placed.join(runs, ["key", "part"])
            .withColumn("pos", F.col("before") + F.col("at") - F.col("first"))
            .drop("part", "at", "first", "before"))


def _halved(level: Column) -> Column:
    """The level above: every two digests together, an odd last one alone."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(level) + 1) / 2).cast("int") - 1)
    return F.transform(pairs, lambda i: F.sha2(
        F.concat(F.get(level, 2 * i), F.coalesce(F.get(level, 2 * i + 1), F.lit(""))), 256))


def _steps(kept: int) -> Column:
    """0, 1, ... for every level that the pack's subtree rises."""
    return F.slice(F.array(*[F.lit(i) for i in range(kept)]), 1, F.col("rise"))


def _levels(kept: int) -> Column:
    """The pack's nodes and all levels above them, the subtree's top last."""
    return F.aggregate(_steps(kept), F.array("nodes"),
                       lambda found, _: F.concat(found, F.array(_halved(F.element_at(found, -1)))))


class Forest(NamedTuple):
    """Stored levels, lowest first, and the root of every key.  A level's rows
    are packs: key, g (number of the pack in its level), rise (levels up to the
    next stored one or the root), last (the root is at its top), nodes; the
    lowest level also holds the leaves' items."""
    packs: list[DataFrame]
    roots: DataFrame
    kept: int


def plant(nodes: DataFrame, kept: int = LEVELS_KEPT) -> Forest:
    """Trees of ``nodes`` (key, pos, n, node, item), one per key."""
    height = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(F.lit(0))
    level = nodes.withColumn("height", height).drop("n")
    packs, roots, done = [], [], 0
    while True:
        cells = ["pos", "node"] + ([] if packs else ["item"])
        rise = F.least(F.lit(kept), F.col("height") - done)
        pack = (level.groupBy("key", F.shiftright("pos", kept).alias("g"))
                .agg(F.max("height").alias("height"), F.sort_array(F.collect_list(F.struct(*cells))).alias("c"))
                .select("key", "g", "height", rise.alias("rise"), (F.col("height") <= done + kept).alias("last"),
                        F.col("c.node").alias("nodes"), *([] if packs else [F.col("c.item").alias("items")])))
        pack = stored(pack, f"level{done}")
        packs.append(pack)
        top = pack.select("key", F.col("g").alias("pos"), "height", "last",
                          F.element_at(_levels(kept), -1)[0].alias("node"))
        roots.append(top.where("last").select("key", F.col("node").alias("root")))
        level = top.where("not last").drop("last")
        if pack.where("not last").isEmpty():
            break
        done += kept
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return Forest(packs, stored(found, "roots"), kept)


def _paths(kept: int) -> Column:
    """Per node of a pack its siblings within the pack's subtree."""
    def sibling(j: Column, i: Column) -> Column:
        at = F.call_function("shiftright", j, i)
        other = F.coalesce(F.get(F.get(F.col("levels"), i), at.bitwiseXOR(F.lit(1))), F.lit(""))
        odd = at % 2 == 1
        return F.struct(F.when(odd, other).otherwise(F.lit("")).alias("l"),
                        F.when(odd, F.lit("")).otherwise(other).alias("r"))
    return F.transform(F.sequence(F.lit(0), F.size("nodes") - 1),
                       lambda j: F.transform(_steps(kept), lambda i: sibling(j, i)))


def prove(forest: Forest, above: DataFrame) -> DataFrame:
    """Every leaf's item and path.  ``above`` (key, tail, ...) is the path that
    goes on from each key's root; its other columns come along."""
    extra = [c for c in above.columns if c not in ("key", "tail")]
    beyond = None
    for k in range(len(forest.packs) - 1, -1, -1):
        pack = forest.packs[k]
        heads = pack.where("last").select("key").join(above, "key").withColumn("pos", F.lit(0).cast("long"))
        beyond = heads if beyond is None else beyond.unionByName(heads)
        held = (pack.join(beyond.withColumnRenamed("pos", "g"), ["key", "g"])
                .withColumn("levels", _levels(forest.kept)))
        if k:
            beyond = held.select("key", "g", "tail", *extra, F.posexplode(_paths(forest.kept)).alias("j", "own")).select(
                "key", (F.shiftleft("g", forest.kept) + F.col("j")).alias("pos"),
                F.concat("own", "tail").alias("tail"), *extra)
        else:
            own = F.arrays_zip(F.col("items").alias("item"), _paths(forest.kept).alias("own"))
            return held.select("key", "tail", *extra, F.explode(own).alias("z")).select(
                "key", F.col("z.item").alias("item"), F.concat("z.own", "tail").alias("path"), *extra)
    raise ValueError("a forest has at least one level")


def manifest(leaves: DataFrame, order: Sequence[str], kept: int = LEVELS_KEPT) -> DataFrame:
    """Per row of ``leaves`` (key, node, the ``order`` columns and any others)
    its columns as struct ``item``, with path, subroot and root."""
    leaves = leaves.withColumn("item", F.struct(*leaves.columns))
    trees = plant(ranked(leaves, [*order, "node"]).select("key", "pos", "n", "node", "item"), kept)
    tops = trees.roots.select(F.lit("").alias("key"), F.col("key").alias("of"), F.col("root").alias("node"))
    crown = plant(ranked(tops, ["of"]).select(
        "key", "pos", "n", "node", F.struct("of", F.col("node").alias("subroot")).alias("item")), kept)
    nothing = F.array().cast("array<struct<l:string,r:string>>")
    ends = prove(crown, crown.roots.select("key", nothing.alias("tail"), "root"))
    above = ends.select(F.col("item.of").alias("key"), F.col("path").alias("tail"), "item.subroot", "root")
    return prove(trees, stored(above, "subroots")).select("item", "path", "subroot", "root")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["l"], h, p["r"]), 256))


def path_digest(path: Column) -> Column:
    """sha256 of a path's siblings from leaf to root."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["l"], p["r"])), ""), 256)


def audit(docs: DataFrame, tampered: Column | None = None, kept: int = LEVELS_KEPT) -> DataFrame:
    """The manifest of ``docs`` by language, and whether each document still
    proves its root: one where ``tampered`` (a condition on doc_id) holds is
    read back with n_chars one more, against the path of the original."""
    f = {c: F.col(f"`{c}`") for c in FIELDS}
    if tampered is None:
        tampered = id_bucket(f["doc_id"], 7) == 0
    changed = {**f, "n_chars": f["n_chars"] + 1}
    leaves = docs.select(*[f[c] for c in FIELDS], group_key(f["lang"]).alias("key")).select(
        "key", "doc_id", leaf_hash([f[c] for c in FIELDS]).alias("node"),
        F.when(tampered, leaf_hash([changed[c] for c in FIELDS])).alias("read"))
    found = manifest(stored(leaves, "leaves"), ["doc_id"], kept)
    read = F.coalesce("item.read", "item.node")
    return found.select(
        "item.doc_id", F.col("item.node").alias("leaf"), "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"),
        folded(read, F.col("path")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
