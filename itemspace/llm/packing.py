"""Best-fit packing of tokenised documents into sequences.

A document is its token ids and a closing id.  Longer ones than a sequence are
cut into whole sequences, the first piece taking the rest.  The short pieces are
dealt evenly into shards of bounded size, where they arrive longest first and are
packed online by bounded-space best fit: open bins are kept in a bitset keyed by free
space, a piece goes to the fullest bin that holds it, and when too many bins are open
the fullest closes.  Bins that are nearly full close at a shard's end; the others are
emptied and their pieces packed again in the next, smaller level, until one shard
is left or a level closes less than a quarter of its pieces.

Cases: null or empty text is the closing id alone; repeated rows are packed each;
texts with the tokenizer's own special strings, or unusual white space, go whole
through the tokenizer; an empty table gives an empty result; other columns pass by.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspace.llm.runtime import lean, narrow, prepare, stored

SEQUENCE = 2048
CLOSING_ID = 0
SHARD_PIECES = 16_384
OPEN_BINS = 8192
BATCH_BYTES = 4 << 20     # beside the remembered parts, a worker holds little
NEARLY_FULL = 32         # a bin with at most 1/32 of its space free stays closed
CACHE_PIECES = 250_000   # remembered text pieces of a worker

_TOKENIZERS: dict[str, "Tokens"] = {}
# A space inside a run of white space, where cutting at spaces would differ from
# the tokenizer's own cutting.
_ODD_SPACE = re.compile(r"\s \s|\s \Z")


class Tokens(dict):
    """Ids of texts, as bytes of little-endian 32-bit numbers.

    The byte-level tokenizer cuts a text before every single space, so the ids
    of the parts between spaces can be remembered.  The dict holds them, keyed
    by the part without its leading space."""

    def __init__(self, path: str, ranks_path: str | None, pattern: str | None):
        super().__init__()
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path and pattern:
            import tiktoken
            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, part: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        self[part] = ids = self._fast(" " + part)
        return ids

    def _fast(self, text: str) -> bytes:
        return np.asarray(self.fast.encode_ordinary(text), dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if _ODD_SPACE.search(text):
            return self._fast(text)
        first, *rest = text.split(" ")
        return self._fast(first) + b"".join(map(self.__getitem__, rest))


def tokens(path: str, ranks_path: str | None, pattern: str | None) -> Tokens:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokens(path, ranks_path, pattern)
    return _TOKENIZERS[path]


def cuts(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: only the first may be shorter."""
    first = length % size or size
    return [(0, first)] + [(s, size) for s in range(first, length, size)]


def tokenized_pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None,
                     size: int = SEQUENCE, closing_id: int = CLOSING_ID, with_ids: bool = True,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece.
    ``ranks`` and ``pattern``: the same vocabulary for a faster encoder."""
    prepare(docs.sparkSession, BATCH_BYTES)
    closing = np.asarray([closing_id], dtype="<u4").tobytes()

    def run(batches):
        t = tokens(tokenizer, ranks, pattern)
        for batch in batches:
            rows, out = [], ([], [], [], [], [])
            texts = batch.column("text")
            for k in range(len(texts)):
                data = t.ids(texts[k].as_py()) + closing
                for p, (start, length) in enumerate(cuts(len(data) // 4, size)):
                    ids = data[4 * start:4 * (start + length)]
                    rows.append(k)
                    for held, v in zip(out, (p, start, length, zlib.crc32(ids), ids)):
                        held.append(v)
            columns = [batch.column("doc_id").take(pa.array(rows, type=pa.int64())),
                       pa.array(out[0], type=pa.int32()), *(pa.array(x, type=pa.int64()) for x in out[1:4])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                flat = np.frombuffer(b"".join(out[4]), dtype="<u4").astype(np.int32)
                bounds = np.concatenate([[0], np.cumsum(out[2])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    source = narrow(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(lean(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
                             + (", ids array<int>" if with_ids else ""))


class OpenBins:
    """Bounded-space best fit: lists of bins by free space, and a bitset of
    the free spaces at which there are bins."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits, self.open, self.made = 0, 0, 0
        self.closed: list[bool] = []

    def _pop(self, free: int) -> int:
        held = self.by_free[free]
        b = held.pop()
        if not held:
            self.bits ^= 1 << free
        self.open -= 1
        return b

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = self._pop(free)
        else:
            free, b = self.size, self.made
            self.made += 1
            self.closed.append(False)
        left = free - length
        if not left:
            self.closed[b] = True
            return b, self.size - free
        self.by_free[left].append(b)
        self.bits |= 1 << left
        self.open += 1
        if self.open > self.most:
            fullest = (self.bits & -self.bits).bit_length() - 1
            self.closed[self._pop(fullest)] = True
        return b, self.size - free

    def close_nearly_full(self) -> None:
        for free in range(1, self.size // NEARLY_FULL + 1):
            for b in self.by_free[free]:
                self.closed[b] = True


def _packed(size: int, most: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row_no"], ascending=[False, True])
        bins = OpenBins(size, most)
        put = [bins.put(n) for n in pdf["length"].tolist()]
        bins.close_nearly_full()
        where = np.array(put, dtype=np.int64).reshape(-1, 2)
        done = np.array(bins.closed, dtype=bool)
        return pd.DataFrame({"row_no": pdf["row_no"].to_numpy(), "shard": pdf["shard"].to_numpy(),
                             "length": pdf["length"].to_numpy(), "bin": where[:, 0], "offset": where[:, 1],
                             "done": done[where[:, 0]]})
    return run


def pack(pieces: DataFrame, size: int = SEQUENCE, open_bins: int = OPEN_BINS,
         shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` (with a length column) with sequence_id and offset.  Numbers:
    whole pieces are negative (a sequence each); others are level, shard and
    bin.  ``pieces`` should be a stored table: it is read more than once."""
    numbered = pieces.withColumn("_row", F.monotonically_increasing_id())
    todo = numbered.where(F.col("length") < size).select(F.col("_row").alias("row_no"), "length")
    placed, level, n = [], 0, todo.count()
    while True:
        shards = max(1, -(-n // shard_pieces))
        dealt = todo.withColumn("shard", F.pmod(F.xxhash64("row_no", F.lit(level)), F.lit(shards)).cast("int"))
        level_out = stored(dealt.groupBy("shard").applyInPandas(
            _packed(size, open_bins),
            "row_no long, shard int, length long, bin long, offset long, done boolean"), f"pack{level}")
        left = level_out.where("not done").count()
        # Where a level closes few bins, dealing anew would not help.
        last = shards == 1 or left * 4 > n * 3
        done = level_out if last else level_out.where("done")
        number = (F.lit(level).cast("long") * (1 << 56) + F.col("shard").cast("long") * (1 << 28) + F.col("bin"))
        placed.append(done.select("row_no", number.alias("sequence_id"), F.col("offset").alias("_offset")))
        if last:
            break
        todo, level, n = level_out.where("not done").select("row_no", "length"), level + 1, left
    found = placed[0]
    for p in placed[1:]:
        found = found.unionAll(p)
    whole = numbered.where(F.col("length") >= size)
    short = numbered.where(F.col("length") < size).join(found, F.col("_row") == F.col("row_no"))
    names = pieces.columns
    return (whole.select(*names, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
            .unionAll(short.select(*names, "sequence_id", F.col("_offset").alias("offset"))))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids and length of the packed sequences (needs ids)."""
    joined = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return joined.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids")).withColumn(
        "length", F.size("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None,
                   size: int = SEQUENCE, with_ids: bool = False, **names) -> DataFrame:
    """Tokenise and pack: a row per piece with its sequence and place there."""
    pieces = stored(tokenized_pieces(docs, tokenizer, ranks, pattern, size, with_ids=with_ids, **names), "pieces")
    return pack(pieces, size)
