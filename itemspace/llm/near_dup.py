"""MinHash near-dedup with ProbMinHash sketches.

A text is the weighted set of its five-word shingles (a shorter text is one
shingle), with weight 1 + ln(count).  Every shingle is a Poisson process whose rate
is its weight; its arrivals fall into random slots, a slot keeps the shingle that
arrives first, and a shingle stops once its next arrival is later than every
slot's.  Two sketches agree in a slot with the probability Jaccard similarity.

Texts with the same words are one node.  Bands of four slots give buckets.  In a
bucket every node is compared with one leader (another one in each bucket): the
Jaccard similarity of the shingle sets, 0.8 or more.  Sketches only deal the
buckets; how far they agree decides nothing, as they weigh counts and the link does
not.  Only pairs whose set sizes rule the similarity out are passed over unread.
Members known to be of their leader's class by an earlier band are passed over.
What these links leave apart is compared block by block inside each bucket; only the
links that join components leave a task.  Classes are the connected components;
copies are never paired.

Cases: null texts and texts without words are a class each; repeated rows and
copies share a class; a class's id is its least doc_id; null ids belong to their
text's class like others; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemspace.llm.decontam import ranges
from itemspace.llm.graph import components
from itemspace.llm.runtime import lean, prepare, stored
from itemspace.llm.words import Words, counter, mix, words

SHINGLE = 5
SIMILARITY = 80          # hundredths
SLOTS, BAND = 96, 4
BATCH_BYTES = 4 << 20    # sketches take many times a batch's memory
FIRST_BANDS = 3          # bands whose links are verified before the others are looked at
BLOCK = 512              # members of one bucket compared in one piece

_FACTORS = counter(SHINGLE, 3)


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row in chunk, shingle, count) of the distinct shingles, by row."""
    n = len(w.counts)
    ends = np.cumsum(w.counts)
    starts = ends - w.counts
    owner = np.repeat(np.arange(n), w.counts)
    left = np.repeat(ends, w.counts) - np.arange(len(owner))        # words from here to the text's end
    padded = np.concatenate([w.hashes, np.zeros(SHINGLE, dtype=np.uint64)])
    total = np.zeros(len(owner), dtype=np.uint64)
    for k in range(SHINGLE):
        total += np.where(left > k, mix(padded[k:k + len(owner)] * _FACTORS[k]), np.uint64(0))
    whole = (left >= SHINGLE) | (np.arange(len(owner)) == starts[owner])
    row, value = owner[whole], mix(total[whole])
    order = np.argsort((row.astype(np.uint64) << np.uint64(45)) | (value >> np.uint64(19)), kind="stable")
    row, value = row[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])])) \
        if len(row) else np.zeros(0, np.int64)
    return row[first], value[first], np.diff(np.append(first, len(row)))


def sketches(row: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """(n, slots): the shingle that arrives first in each slot (0 for rows
    without shingles)."""
    out = np.zeros((n, slots), dtype=np.uint64)
    rate = np.bincount(row, weights=weight, minlength=n)
    reach = 3.0 + math.log(slots)
    todo = rate > 0
    while todo.any():
        mine = todo[row]
        limit = np.where(todo, reach * slots / np.maximum(rate, 1e-300), 0)
        found, when = _arrivals(row[mine], value[mine], weight[mine], limit, n, slots)
        full = todo & np.isfinite(when).all(axis=1)
        out[full] = found[full]
        todo &= ~full
        reach *= 2
    return out


def _arrivals(row, value, weight, limit, n, slots):
    """All arrivals before the rows' limits, with early termination."""
    when = np.full(n * slots, np.inf)
    what = np.zeros(n * slots, dtype=np.uint64)
    time, j, latest = np.zeros(len(row)), 0, limit
    while len(row):
        j += 1
        seed = mix(value + np.uint64(j * 0x9E3779B97F4A7C15 % 2 ** 64))
        uniform = ((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53
        time = time - np.log(uniform) / weight
        live = time < latest[row]
        row, value, weight, time, seed = row[live], value[live], weight[live], time[live], seed[live]
        slot = row * slots + (mix(seed) % np.uint64(slots)).astype(np.int64)
        better = np.flatnonzero(time < when[slot])
        better = better[np.argsort(-time[better], kind="stable")]   # the earliest is written last
        when[slot[better]] = time[better]
        what[slot[better]] = value[better]
        latest = np.minimum(limit, when.reshape(n, slots).max(axis=1))
    return what.reshape(n, slots), when.reshape(n, slots)


def digests(w: Words) -> np.ndarray:
    """16 bytes for each row's word sequence (two 64-bit sums)."""
    place = np.arange(len(w.hashes)) - np.repeat(np.cumsum(w.counts) - w.counts, w.counts)
    out = np.zeros((len(w.counts), 2), dtype=np.uint64)
    starts = np.minimum(np.cumsum(w.counts) - w.counts, max(len(w.hashes), 1))
    salt = mix(place.astype(np.uint64))
    for k, m in enumerate(counter(2, 9)):
        sums = np.add.reduceat(np.append(mix(w.hashes * m + salt), np.uint64(0)), np.minimum(starts, len(w.hashes)))
        out[:, k] = np.where(w.counts > 0, mix(sums + w.counts.astype(np.uint64)), np.uint64(0))
    return out


def _binary(matrix: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    data = np.ascontiguousarray(matrix)
    fixed = pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(data.shape[1] * data.itemsize), len(data), [None, pa.py_buffer(data.tobytes())])
    out = fixed.cast(pa.binary())
    return out if valid is None else pa.compute.if_else(pa.array(valid), out, pa.scalar(None, pa.binary()))


def sketched(source: DataFrame) -> DataFrame:
    """_id, _text_hash, node, size (distinct shingles), bands and sketch of every
    text (node: null if it has no words)."""
    kind = source.schema["_id"].dataType.simpleString()
    n_bands = SLOTS // BAND
    factors = counter(SLOTS, 5)

    def run(batches):
        for batch in batches:
            for w in words(batch.column("text")):
                n = len(w.counts)
                row, value, count = shingles(w)
                sketch = sketches(row, value, 1 + np.log(count), n)
                bands = mix((sketch * factors).reshape(n, n_bands, BAND).sum(axis=2, dtype=np.uint64)
                            + np.arange(n_bands, dtype=np.uint64))
                has = w.counts > 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(w.first, n), batch.column("_text_hash").slice(w.first, n),
                     _binary(digests(w), has), pa.array(np.bincount(row, minlength=n).astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * n_bands),
                                              pa.array(bands.ravel().view(np.int64))),
                     _binary(sketch.astype(np.uint32))],
                    names=["_id", "_text_hash", "node", "size", "bands", "sketch"])

    return source.mapInArrow(lean(run), f"_id {kind}, _text_hash long, node binary, size int, bands array<long>, "
                                        "sketch binary")


def shingle_sets(source: DataFrame) -> DataFrame:
    """node and its distinct shingles."""
    def run(batches):
        for batch in batches:
            for w in words(batch.column("text")):
                row, value, _ = shingles(w)
                bounds = np.searchsorted(row, np.arange(len(w.counts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [_binary(digests(w)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(value.view(np.int64)))],
                    names=["node", "shingles"])

    return source.select("text").mapInArrow(lean(run), "node binary, shingles array<long>").dropDuplicates(["node"])


def _matrix(column: pa.Array) -> np.ndarray:
    """Sketches of a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, SLOTS)


def sizes_allow(a: Column, b: Column, hundredths: int) -> Column:
    """Sets of these sizes can be that similar."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * hundredths


def similar(a: Column, b: Column, hundredths: int) -> Column:
    """Jaccard similarity of two distinct arrays is at least that."""
    both = F.size(F.array_intersect(a, b))
    return both * 100 >= (F.size(a) + F.size(b) - both) * hundredths


def verified(pairs: DataFrame, sets: DataFrame, hundredths: int) -> DataFrame:
    return (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb")), "b")
            .where(similar(F.col("xa"), F.col("xb"), hundredths)).select("a", "b"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows come sorted by piece; yields tables of whole pieces, and their bounds."""
    held: pa.Table | None = None

    def bounds(t: pa.Table) -> np.ndarray:
        piece = t.column("piece").to_numpy()
        return np.append(np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]])), len(piece))

    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
        if held.num_rows:
            at = bounds(held)
            if len(at) > 2:                           # the last piece may go on
                yield held.slice(0, at[-2]).combine_chunks(), at[:-1]
                held = held.slice(at[-2]).combine_chunks()
    if held is not None and held.num_rows:
        yield held, bounds(held)


def _pairs_apart(t: pa.Table, bounds: np.ndarray, least: int, hundredths: int) -> Iterator[tuple[int, np.ndarray]]:
    """(x, ys): rows of one piece with different labels and
    sizes that allow a link, whose sketches agree in ``least`` slots and whose first
    common band is this bucket's, so that a pair is met once."""
    sketch = _matrix(t.column("sketch"))
    label = t.column("label").chunk(0).dictionary_encode().indices.to_numpy()
    side, band, size = (t.column(c).to_numpy() for c in ("side", "band", "size"))
    size = size.astype(np.int64)
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        across = side[lo] != side[hi - 1]             # two blocks: only pairs between them
        for x in range(lo, hi - 1):
            rest = slice(x + 1, hi)
            fit = ((label[rest] != label[x])
                   & (np.minimum(size[rest], size[x]) * 100 >= np.maximum(size[rest], size[x]) * hundredths))
            if across:
                fit &= side[rest] != side[x]
            other = x + 1 + np.flatnonzero(fit)
            if len(other):
                same = sketch[other] == sketch[x]
                first = same.reshape(-1, SLOTS // BAND, BAND).all(axis=2).argmax(axis=1)
                yield x, other[(first == band[x]) & (same.sum(axis=1) >= least)]


def _members_apart(batches: Iterator[pa.RecordBatch], least: int, hundredths: int) -> Iterator[pa.RecordBatch]:
    """The members that may have a link to another component."""
    for t, bounds in _pieces(batches):
        some = np.zeros(t.num_rows, dtype=bool)
        for x, ys in _pairs_apart(t, bounds, least, hundredths):
            some[ys] = True
            some[x] |= len(ys) > 0
        yield from t.select(["key", "band", "node", "label"]).filter(pa.array(some)).combine_chunks().to_batches()


def _links_apart(batches: Iterator[pa.RecordBatch], least: int, hundredths: int) -> Iterator[pa.RecordBatch]:
    """Verified links between components, as many as join them."""
    for t, bounds in _pieces(batches):
        label = t.column("label").chunk(0).dictionary_encode().indices.to_pylist()
        node = t.column("node").to_pylist()
        size = t.column("size").to_numpy().astype(np.int64)
        flat = np.array(t.column("shingles").chunk(0).flatten())
        ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(t.column("shingles").chunk(0)).to_numpy())])
        distinct, code = np.unique(flat, return_inverse=True)
        mark = np.zeros(len(distinct), dtype=bool)
        parent = np.arange(max(label) + 1)

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = k = parent[parent[k]]
            return k

        out: tuple[list, list] = ([], [])
        for x, ys in _pairs_apart(t, bounds, least, hundredths):
            mine = root(label[x])
            ys = np.array([y for y in ys if root(label[y]) != mine], dtype=np.int64)
            if not len(ys):
                continue
            mark[code[ends[x]:ends[x + 1]]] = True
            lens = ends[ys + 1] - ends[ys]
            both = np.add.reduceat(mark[code[ranges(ends[ys], lens)]].astype(np.int64), np.cumsum(lens) - lens)
            mark[code[ends[x]:ends[x + 1]]] = False
            for y in ys[both * 100 >= (size[x] + size[ys] - both) * hundredths]:
                if root(label[x]) != root(label[y]):
                    parent[root(label[x])] = root(label[y])
                    out[0].append(node[x])
                    out[1].append(node[y])
        yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.binary()) for c in out], names=["a", "b"])


def _dealt(members: DataFrame, nodes: DataFrame, block: int) -> DataFrame:
    """``members`` of buckets with several labels, with what ``nodes`` knows of
    them, dealt in pieces: a bucket's blocks in pairs."""
    size = members.groupBy("key").agg(
        F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"),
        F.min("label").alias("l0"), F.max("label").alias("l1"))
    live = members.join(size.where("l0 <> l1").drop("l0", "l1"), "key").join(nodes, "node")
    own = live.withColumn("side", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = spread.withColumn("piece", F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other")))
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (dealt.select("piece", "side", "key", "band", "label", *nodes.columns).repartition(n, "piece")
            .sortWithinPartitions("piece", "side", "node"))


def links_apart(members: DataFrame, nodes: DataFrame, sets: DataFrame, least: int, hundredths: int,
                block: int | None = None) -> DataFrame:
    """Links (a, b) that join components among ``members`` (key, band, node,
    label) of the same buckets.  A large bucket is split into blocks, and each pair
    of blocks is a piece of work of its own.  Labels, set sizes and common bands tell
    which members need a look; only these are dealt again, with their shingles.  No pairs
    leave a task but the links that join components.  ``least`` is the number of slots
    in which a pair's sketches agree; members of one bucket agree in a band."""
    block = block or BLOCK
    sketch = nodes.select("node", "sketch").join(sets.select("node", F.size("shingles").alias("size")), "node")
    some = stored(_dealt(members, sketch, block).mapInArrow(
        lean(lambda it: _members_apart(it, least, hundredths)), "key long, band int, node binary, label binary").distinct(), "apart")
    return _dealt(some, sketch.join(sets, "node"), block).mapInArrow(
        lean(lambda it: _links_apart(it, least, hundredths)), "a binary, b binary").distinct()


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components of the labelled nodes and further links.  A component known
    already is a star around its label, so only the new links take rounds."""
    if links.isEmpty():
        return labels
    star = labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    return components(star.unionAll(links))


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """_id, _text_hash, class_id (least id of the class) and first (this row's
    id and text are the least of its class) for every row."""
    spark = docs.sparkSession
    prepare(spark, BATCH_BYTES)
    source = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("_text_hash"),
                         F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    seen = stored(sketched(source), "sketches")
    nodes = stored(seen.where("node is not null").groupBy("node").agg(
        F.min(F.struct("_id", "_text_hash")).alias("least"), F.first("size").alias("size"),
        F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes")
    banded = nodes.select("node", "size", F.posexplode("bands").alias("band", "key"))
    # A bucket's leader differs from bucket to bucket; (hash, node) by map-side minimum.
    leaders = banded.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key").alias("h"), "node", "size")).alias("lead"),
                                        F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = stored(banded.join(leaders, "key").select(
        "key", "band", "node", F.col("lead.node").alias("leader"),
        sizes_allow(F.col("size"), F.col("lead.size"), similarity).alias("possible")), "buckets")
    # Only texts that share a bucket are read again for their shingles.
    wanted = nodes.join(buckets.select("node").distinct(), "node").select("least.*")
    sets = stored(shingle_sets(source.alias("s").join(
        wanted.select(F.col("_id").alias("i"), F.col("_text_hash").alias("h")),
        F.col("_id").eqNullSafe(F.col("i")) & F.col("_text_hash").eqNullSafe(F.col("h")), "left_semi")), "sets")

    def linked(members: DataFrame) -> DataFrame:
        """Verified links between members of buckets and their leaders."""
        pairs = members.where("node <> leader and possible").select(
            F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
        return stored(verified(pairs, sets, similarity), "links")

    # A few bands join most of a group; in the others only a member that is not
    # yet in its leader's component is compared.
    labels = components(linked(buckets.where(F.col("band") < FIRST_BANDS)))
    of_leader = labels.select(F.col("node").alias("leader"), F.col("label").alias("leader_label"))
    others = (buckets.where(F.col("band") >= FIRST_BANDS).join(labels, "node", "left").join(of_leader, "leader", "left")
              .where(~F.coalesce(F.col("label") == F.col("leader_label"), F.lit(False))))
    labels = joined(labels, linked(others))
    # A leader has met all of its bucket; the others may still hold unseen links.
    rest = (buckets.where("node <> leader").join(labels, "node", "left")
            .select("key", "band", "node", F.coalesce("label", "node").alias("label")))
    more = stored(links_apart(rest, nodes, sets, BAND, similarity), "links")
    labels = joined(labels, more)
    members = (seen.join(labels, "node", "left")
               .select("_id", "_text_hash", F.coalesce("label", "node").alias("label")))
    worded = members.where("label is not null")
    least = worded.groupBy("label").agg(F.min(F.struct("_id", "_text_hash")).alias("m"), F.min("_id").alias("class_id"))
    me = F.struct("_id", "_text_hash")
    return (worded.join(least, "label").select("_id", "_text_hash", "class_id", me.eqNullSafe(F.col("m")).alias("first"))
            .unionAll(members.where("label is null").select(
                "_id", "_text_hash", F.col("_id").alias("class_id"), F.lit(True).alias("first"))))


def dedup(docs: DataFrame, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class: the least by id."""
    kept = near_duplicates(docs, similarity, id_col, text_col).where("first").select("_id", "_text_hash").distinct()
    text = F.col(f"`{text_col}`")
    has_words = text.rlike("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]")
    keyed = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("_i"), F.xxhash64(text).alias("_h"),
                        F.coalesce(has_words, F.lit(False)).alias("_w"))
    joined = keyed.join(kept, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_text_hash")), "left_semi")
    # Repeated rows of a text with words are copies of each other.
    return (joined.where("_w").dropDuplicates(["_i", "_h"]).unionAll(joined.where("not _w"))).select("row.*")
