"""Near-duplicate vectors: random-hyperplane sign hashing in several tables,
exact cosine verification, distributed connected components.

1. ``classes``: equal vectors of a label become one node (map-side combined, so
   a vector that a third of all rows share costs one row a task).
2. ``hash_plan``: a code of one sign bit per hyperplane; bits grow with the
   logarithm of the nodes, so that unrelated nodes seldom meet, and the tables
   are as many as hold the chance that a pair at the threshold meets in none
   of them under MISS.
3. Nodes of equal (label, table, code) are a bucket.  Buckets of one node end
   here, before any vector is shuffled; large ones are cut into blocks that meet
   in pairs.
4. Every pair of a bucket is decided by its cosine in double precision, in the
   first table where the pair meets, so each link counts once.  A task
   emits per node the number of its links, and of the links as many as connect
   the same nodes: never all pairs.
5. Components by ``graph.components``; sizes of classes go into the counts.

Defined cases: a null label, a null, empty or zero vector, and one with a null or
non-finite component link with nothing.  Vectors of different lengths are not
compared.  Rows that share an id count as separate vectors.  Rows without an id
take part; a component's id is its smallest id (null if it has none), and
``kept`` compares null-safe.  An empty table has no rows.  Columns other than the
three named play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspace.llm.graph import components
from itemspace.llm.runtime import lean, prepare, stored
from itemspace.llm.skew import join_counted

THRESHOLD = 0.98
MISS = 1e-4
BLOCK = 256
SEED = 20

BUCKET = ["dims", "label", "table", "code"]
PIECE = [*BUCKET, "b0", "b1"]


def hash_plan(nodes: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Sign bits of a code and number of tables."""
    bits = min(max(math.ceil(math.log2(max(nodes, 2))), 4), 62)
    meet = (1 - math.acos(min(max(threshold, -1.0), 1.0)) / math.pi) ** bits
    return bits, 1 if meet >= 1 else math.ceil(math.log(miss) / math.log1p(-meet))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sign_codes(vectors: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """(rows, tables) codes: the sides of ``bits`` hyperplanes in each table."""
    planes = np.random.default_rng((seed, vectors.shape[1])).standard_normal((vectors.shape[1], tables * bits))
    sides = (vectors.astype(np.float64) @ planes >= 0).reshape(-1, tables, bits)
    return sides @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _coded(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims):
                at = pa.array(np.flatnonzero(dims == d))
                part = batch.take(at)
                codes = sign_codes(_matrix(part.column("e")), bits, tables)
                flat = pa.array(codes.reshape(-1))
                ends = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * tables)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(ends, flat)],
                                                 names=["node", "codes"])
    return lean(run)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each piece; batches come sorted by piece."""
    held: list[pa.Table] = []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        change = np.zeros(t.num_rows, dtype=bool)
        for c in PIECE:
            x = t.column(c).combine_chunks().dictionary_encode().indices.to_numpy()
            change[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), t.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            part = t.slice(lo, hi - lo)
            if lo == 0 and held and part.slice(0, 1).select(PIECE).to_pylist() != held[0].slice(0, 1).select(PIECE).to_pylist():
                yield pa.concat_tables(held)
                held = []
            if lo:
                yield pa.concat_tables(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held)


def linked(unit: np.ndarray, codes: np.ndarray, table: int, side: np.ndarray | None, threshold: float) -> np.ndarray:
    """Matrix of the pairs of cosine ``threshold`` or more that meet in ``table`` and in
    none before; with ``side`` only pairs across."""
    meet = unit @ unit.T >= threshold
    np.fill_diagonal(meet, False)
    if side is not None:
        meet &= side[:, None] != side[None, :]
    if meet.any():
        for before in codes.T[:table]:
            meet &= before[:, None] != before[None, :]
    return meet


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Per node the least node that the pairs connect it with."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, before[j])
        np.minimum.at(label, j, before[i])
        label = label[label]
        if (label == before).all():
            return label


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _pieces(batches):
            if t.num_rows < 2:
                continue
            e = _matrix(t.column("e")).astype(np.float64)
            unit = e / np.sqrt((e * e).sum(axis=1, keepdims=True))
            first = t.slice(0, 1).select(["table", "b0", "b1"]).to_pylist()[0]
            side = t.column("block").to_numpy() if first["b0"] != first["b1"] else None
            meet = linked(unit, _matrix(t.column("codes")), first["table"], side, threshold)
            at = np.flatnonzero(meet.any(axis=1))
            if not len(at):
                continue
            size = t.column("n").to_numpy()
            links = np.array([size[row].sum() for row in meet])
            i, j = np.nonzero(np.triu(meet))
            node = t.column("node").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[at]), pa.array(links[at]), pa.array(node[spanning(t.num_rows, i, j)[at]])],
                names=["node", "links", "other"])
    return lean(run)


def links(nodes: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """node, links (rows that a task found it linked with) and other (a node of
    the same component), of ``nodes`` (node, dims, label, e, n)."""
    bits, tables = hash_plan(nodes.count(), threshold, miss)
    coded = stored(nodes.select("node", "dims", "e").mapInArrow(_coded(bits, tables), "node long, codes array<long>"),
                   "codes")
    known = nodes.join(coded, "node")
    entries = stored(known.select("node", "dims", "label", F.posexplode("codes").alias("table", "code")), "entries")
    buckets = entries.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    live = join_counted(entries, stored(buckets, "buckets"), BUCKET, "m")
    blocks = F.ceil(F.col("m") / block).cast("int")
    spread = (live.withColumn("block", F.pmod(F.xxhash64("node", "table"), blocks).cast("int"))
              .withColumn("b", F.explode(F.sequence(F.lit(0), blocks - 1)))
              .select("node", *BUCKET, "block", F.least("block", "b").alias("b0"), F.greatest("block", "b").alias("b1")))
    dealt = (spread.join(known.select("node", "e", "codes", "n"), "node")
             .repartition(*PIECE).sortWithinPartitions(*PIECE))
    return dealt.mapInArrow(_verified(threshold), "node long, links long, other long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
                    threshold: float = THRESHOLD, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links (other rows of the same label with a cosine of ``threshold`` or
    more), component_id and kept, one row per row of ``vectors``."""
    prepare(vectors.sparkSession)
    e, label = F.col(f"`{vector_col}`"), F.col(f"`{label_col}`")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    able = F.coalesce(label.isNotNull() & ~bad & F.exists(e, lambda x: x != 0), F.lit(False))
    # two chains of 64 bits, seeded apart, name a class
    rows = stored(vectors.select(
        F.col(f"`{id_col}`").alias("vec_id"), label.alias("label"), F.when(able, e).alias("e"),
        F.when(able, F.xxhash64(F.lit(1), label, e)).alias("h0"), F.when(able, F.xxhash64(F.lit(2), label, e)).alias("h1")),
        "vectors")
    same = rows.where("e is not null").groupBy("h0", "h1").agg(
        F.min("label").alias("label"), F.min("e").alias("e"), F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    nodes = stored(same.withColumn("node", F.monotonically_increasing_id()).withColumn("dims", F.size("e")), "nodes")
    found = stored(links(nodes, threshold, miss, block), "links")
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b"))
                        .distinct()).withColumnRenamed("label", "root")
    named = (nodes.select("node", "h0", "h1", "first", "n").join(degree, "node", "left").join(labels, "node", "left")
             .withColumn("root", F.coalesce("root", "node")))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    known = stored(named.join(least, "root").select(
        "h0", "h1", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "classes")
    linked = join_counted(rows.where("e is not null").select("vec_id", "h0", "h1"), known, ["h0", "h1"], "n")
    alone = rows.where("e is null").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                           F.col("vec_id").alias("component_id"))
    return linked.select("vec_id", "n_links", "component_id").unionByName(alone).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
