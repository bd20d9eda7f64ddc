"""Line dedup by a log-template tree of fixed depth.

A line's path is its token count, then its tokens; tokens are words (case and
punctuation aside).  Variable fields are

* tokens with a digit, in lines where tokens without one are MIN_CONSTANT at least
  and half of all at least (a row of numbers is no template: it is compared exactly);
* in lines of SEGMENT_TOKENS or more, one of four consecutive segments of the whole line,
  leading tokens included, as long as the rest holds that many constant tokens.
  Fields that lie in different segments do not generalise together.

A template that occurs in two or more documents recurs: its lines stay in the
document with the least id and are dropped from the others.  Templates travel as
hashes; per template only the least and greatest id are kept (map-side
aggregates, so a line in a third of all documents is no burden).

Lines of fewer than SHORT_TOKENS words are compared by their exact words, and two documents
may well share one by chance.  Such a line recurs if SHORT_DOCS documents or more hold
it, and OFTEN times as many as hold another line of that many words on average
(over all documents).

Cases: null or empty texts have no lines to drop; rows with one id are one document; null ids
are one document after all others; an empty table gives an empty result; other
columns pass through, whatever their names (one called ``_dropped`` is replaced).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspace.llm.runtime import prepare, stored
from itemspace.llm.words import buffers, counter, mix, words

SHORT_TOKENS = 5
SHORT_DOCS = 3
OFTEN = 10
MIN_CONSTANT = 3
SEGMENTS = 4
SEGMENT_TOKENS = 8       # lines from this length on are generalised

_FIELD = np.uint64(0x5DEECE66D)
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True


def _enough(constant: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether so many constant tokens may stand for a line of n."""
    return (constant >= MIN_CONSTANT) & (2 * constant >= n)


def templates(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, line number, template hash, words of a short line or 0) of all lines."""
    offsets, raw = buffers(column)
    rows, lines, keys, shorts = [], [], [], []
    for w in words(column):
        if not len(w.hashes):
            continue
        i, j = w.first, w.last
        base = offsets[i]
        data = raw[base:offsets[j]]
        owner = np.repeat(np.arange(j - i), w.counts)
        shift = offsets[i:j][owner] - base
        starts = w.starts + shift
        breaks = np.flatnonzero(data == 0x0A)
        line = np.searchsorted(breaks, starts)                       # counted over the chunk
        line_no = line - np.searchsorted(breaks, offsets[i:j] - base)[owner]
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        first = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])]))
        n = np.diff(np.append(first, len(line)))
        many = np.repeat(n, n)
        place = np.arange(len(line)) - np.repeat(first, n)
        field = digits[w.ends + shift] > digits[starts]
        short = n < SHORT_TOKENS
        masked = ~short & _enough(n - np.add.reduceat(field.astype(np.int64), first), n)
        field &= np.repeat(masked, n)
        term = mix(np.where(field, _FIELD, w.hashes) + counter(int(n.max()), 1)[place])
        whole = np.add.reduceat(term, first)
        path = mix(n.astype(np.uint64))
        rows.append(owner[first] + i)
        lines.append(line_no[first])
        keys.append(mix(whole + path))
        shorts.append(np.where(short, n, 0))
        segment = np.where(many >= SEGMENT_TOKENS, place * SEGMENTS // many, SEGMENTS)
        for s in range(SEGMENTS):
            gone = segment == s
            rest = whole - np.add.reduceat(np.where(gone, term, np.uint64(0)), first)
            wide = (n >= SEGMENT_TOKENS) & _enough(np.add.reduceat((~gone & ~field).astype(np.int64), first), n)
            rows.append(owner[first][wide] + i)
            lines.append(line_no[first][wide])
            keys.append(mix(rest + path + np.uint64(s + 1))[wide])
            shorts.append(np.zeros(int(wide.sum()), dtype=np.int64))
    if not rows:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return np.concatenate(rows), np.concatenate(lines), np.concatenate(keys), np.concatenate(shorts)


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _text_hash and _dropped (sorted line numbers from 0) of the
    documents that lose lines."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("_text_hash"),
                         F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kind = source.schema["_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            row, line, key, short = templates(batch.column("text"))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(at), batch.column("_text_hash").take(at), pa.array(line.astype(np.int32)),
                 pa.array(key.view(np.int64)), pa.array(short.astype(np.int8))],
                names=["_id", "_text_hash", "line", "template", "short"])

    found = stored(source.mapInArrow(run, f"_id {kind}, _text_hash long, line int, template long, short byte"), "lines")
    several = (F.col("first") != F.col("last")) | (F.col("first").isNotNull() & (F.col("named") < F.col("n")))
    ends = [F.min("_id").alias("first"), F.max("_id").alias("last"), F.count("_id").alias("named"),
            F.count(F.lit(1)).alias("n")]
    recurring = found.where("short = 0").groupBy("template").agg(*ends).where(several).select("template", "first")
    # short lines: a row per line and document, then per line
    held = found.where("short > 0").groupBy("template", "short", "_id").agg(F.count(F.lit(1)).alias("times"))
    few = stored(held.groupBy("template", "short").agg(
        F.min("_id").alias("first"), F.max("_id").alias("last"), F.count("_id").alias("named"),
        F.count(F.lit(1)).alias("n")), "short")
    usual = few.groupBy("short").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))  # SHORT_TOKENS - 1 rows at most
    others = (F.col("all") - F.col("n")) / F.greatest(F.col("kinds") - 1, F.lit(1))
    often = few.join(usual, "short").where(several & (F.col("n") >= SHORT_DOCS) & (F.col("n") >= OFTEN * others))
    recurring = recurring.unionByName(often.select("template", "first"))
    return (found.join(recurring, "template")
            .where(~F.col("_id").eqNullSafe(F.col("first")))
            .groupBy("_id", "_text_hash").agg(F.sort_array(F.collect_set("line")).alias("_dropped")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the recurring lines cut from the text, and _dropped (their
    line numbers, empty if none)."""
    dropped = recurring_lines(docs, id_col, text_col)
    text = F.col(f"`{text_col}`")
    # the row travels as one column, so that its names clash with nothing
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("of"),
                        F.xxhash64(text).alias("hash"), F.split(text, "\n").alias("lines"))
    joined = keyed.join(dropped, F.col("of").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_text_hash")), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("_dropped"))
    cut = F.when(F.col("_dropped").isNull(), F.col("row")[text_col]).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    return joined.select(*[cut.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c != "_dropped"],
                         F.coalesce("_dropped", F.array().cast("array<int>")).alias("_dropped"))
