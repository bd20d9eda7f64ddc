"""Benchmark decontamination: an FM-index per training shard.

Each task turns its documents into symbols of the benchmark's vocabulary (any
other word is a separator; separators in a row, and runs shorter than the
shortest phrase, hold no occurrence and are left out), builds FM-indexes over
shards of bounded size, and searches all test phrases backward through the
wavelet matrix's ranks.  Occurrences are located by sampled suffix positions
and merged into removal spans of word numbers.  Documents never move: there is
no shuffle.  The benchmark comes in blocks of bounded size, one broadcast at a
time, each adding to the rows' spans.

Cases: null or empty texts and items have no words and no hits; items of fewer
words than the window are one phrase; repeated items and repeated rows are
treated each by itself; a null item id is not reported but its phrases count;
empty tables give an empty result or no hits; other columns pass through.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemspace.llm.runtime import prepare, stored
from itemspace.llm.words import hash_words, words

WINDOW = 10
BLOCK_BYTES = 8 << 20      # benchmark text in one broadcast
SHARD_SYMBOLS = 1 << 20    # symbols in one index
SAMPLE = 8                 # every 8th text position keeps its suffix position

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ADDED = [("_words", T.LongType()), ("_spans", SPANS), ("_items", T.ArrayType(T.StringType()))]
SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class FmIndex:
    """Over a sequence of symbols > 0 and terminators 0 (it must end with one).
    Terminators differ by position, so suffixes are compared within runs."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        n = len(text)
        self.symbols = np.unique(text)          # 0 first
        dense = np.searchsorted(self.symbols, text)
        order = self._suffixes(dense)
        bwt = dense[order - 1]
        self.heads = np.concatenate([[0], np.cumsum(np.bincount(dense, minlength=len(self.symbols)))])
        self.levels = max(1, int(len(self.symbols) - 1).bit_length())
        self.ones, self.zeros = [], []
        row = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(n - int(self.ones[-1][-1]))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        marked = (order % sample == 0) | (bwt == 0)
        self.marked = np.concatenate([[0], np.cumsum(marked)]).astype(np.int32)
        self.sampled = order[marked]

    @staticmethod
    def _suffixes(dense: np.ndarray) -> np.ndarray:
        """Suffix order by prefix doubling."""
        ends = dense == 0
        rank = dense + int(ends.sum())
        rank[ends] = np.arange(int(ends.sum()))
        step, n = 1, len(dense)
        while True:
            after = np.zeros(n, dtype=np.int64)
            after[:-step] = rank[step:] + 1
            key = rank.astype(np.int64) * (int(rank.max()) + 2) + np.where(ends, 0, after)
            order = np.argsort(key, kind="stable")
            fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank = np.empty(n, dtype=np.int64)
            rank[order] = fresh
            if fresh[-1] == n - 1:
                return order
            step *= 2
            # A suffix whose next ``step`` symbols hold a terminator is already unique.

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each dense symbol stands before each position."""
        low, high = np.zeros_like(at), at
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            r_low, r_high = self.ones[k][low], self.ones[k][high]
            low = np.where(one, self.zeros[k] + r_low, low - r_low)
            high = np.where(one, self.zeros[k] + r_high, high - r_high)
        return high - low

    def step_back(self, at: np.ndarray) -> np.ndarray:
        """LF: the row of the suffix one symbol longer."""
        symbol, low, high = np.zeros_like(at), np.zeros_like(at), at
        for k in range(self.levels):
            ones = self.ones[k]
            bit = ones[high + 1] - ones[high]
            symbol = symbol * 2 + bit
            r_low, r_high = ones[low], ones[high]
            low = np.where(bit == 1, self.zeros[k] + r_low, low - r_low)
            high = np.where(bit == 1, self.zeros[k] + r_high, high - r_high)
        return self.heads[symbol] + high - low

    def count(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of rows of symbols: (phrase number, first row, end
        row) of those that occur."""
        dense = np.minimum(np.searchsorted(self.symbols, phrases), len(self.symbols) - 1)
        number = np.flatnonzero((self.symbols[dense] == phrases).all(axis=1))
        dense = dense[number]
        low = self.heads[dense[:, -1]]
        high = self.heads[dense[:, -1] + 1]
        for k in range(phrases.shape[1] - 2, -1, -1):
            live = np.flatnonzero(high > low)
            number, dense, low, high = number[live], dense[live], low[live], high[live]
            if not len(number):
                break
            c = dense[:, k]
            both = self.rank(np.concatenate([c, c]), np.concatenate([low, high]))
            low, high = self.heads[c] + both[:len(c)], self.heads[c] + both[len(c):]
        live = np.flatnonzero(high > low)
        return number[live], low[live], high[live]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, walking back to a sampled one."""
        place = np.zeros(len(rows), dtype=np.int64)
        todo, at, walked = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            there = self.marked[at + 1] > self.marked[at]
            place[todo[there]] = self.sampled[self.marked[at[there]]] + walked
            todo, at = todo[~there], at[~there]
            if len(todo):
                at = self.step_back(at)
            walked += 1
        return place


class Phrases:
    """Test phrases of one benchmark block, compiled for search."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], window: int):
        self.items = [name for name, _ in items]
        self.vocabulary = np.unique(np.concatenate([h for _, h in items] or [np.zeros(0, np.uint64)]))
        grouped: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for k, (_, hashes) in enumerate(items):
            if not len(hashes):
                continue
            s = np.searchsorted(self.vocabulary, hashes) + 1
            rows = np.lib.stride_tricks.sliding_window_view(s, min(window, len(s)))
            grouped.setdefault(rows.shape[1], []).append((rows, np.full(len(rows), k)))
        # length -> distinct phrases, and the items of each (as a ragged list)
        self.by_length = []
        for length, parts in sorted(grouped.items()):
            rows, inverse = np.unique(np.concatenate([p[0] for p in parts]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([inverse.ravel(), np.concatenate([p[1] for p in parts])]), axis=1)
            self.by_length.append((length, rows, pairs[1], np.searchsorted(pairs[0], np.arange(len(rows) + 1))))
        self.shortest = min(grouped, default=0)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))


class Shards:
    """Collects the searchable runs of many documents and searches them."""

    def __init__(self, phrases: Phrases, limit: int = SHARD_SYMBOLS):
        self.phrases, self.limit = phrases, limit
        self.text, self.origin, self.size = [], [], 0
        self.spans, self.items = [], []   # (start, end) flat; (flat start, item)

    def add(self, symbols: np.ndarray, origin: int) -> None:
        """``symbols`` ends with 0; its flat position is ``origin``."""
        if not self.phrases.shortest:
            return
        edge = np.diff(np.concatenate([[0], (symbols > 0).astype(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = ends - starts >= self.phrases.shortest
        at = ranges(starts[long], (ends - starts)[long] + 1)   # with the 0 after the run
        if not len(at):
            return
        self.text.append(symbols[at])
        self.origin.append(at + origin)
        self.size += len(at)
        if self.size >= self.limit:
            self.search()

    def search(self) -> None:
        if not self.size:
            return
        text, origin = np.concatenate(self.text), np.concatenate(self.origin)
        self.text, self.origin, self.size = [], [], 0
        index = FmIndex(text)
        for length, rows, items, bounds in self.phrases.by_length:
            number, low, high = index.count(rows)
            if not len(number):
                continue
            lens = high - low
            place = origin[index.locate(ranges(low, lens))]
            which = np.repeat(number, lens)
            self.spans.append(np.stack([place, place + length]))
            n_items = bounds[which + 1] - bounds[which]
            self.items.append(np.stack([np.repeat(place, n_items), items[ranges(bounds[which], n_items)]]))

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """Merged spans and (start, item) pairs, by flat position."""
        self.search()
        spans = np.concatenate(self.spans, axis=1) if self.spans else np.zeros((2, 0), dtype=np.int64)
        items = np.concatenate(self.items, axis=1) if self.items else np.zeros((2, 0), dtype=np.int64)
        return merged(spans), items


def merged(spans: np.ndarray) -> np.ndarray:
    """Union of intervals, sorted (touching intervals become one)."""
    if not spans.shape[1]:
        return spans
    spans = spans[:, np.lexsort((spans[1], spans[0]))]
    reach = np.maximum.accumulate(spans[1])
    first = np.concatenate([[True], spans[0][1:] > reach[:-1]])
    starts = np.flatnonzero(first)
    return np.stack([spans[0][starts], reach[np.append(starts[1:], len(reach)) - 1]])


def find(column: pa.Array, phrases: Phrases) -> tuple[np.ndarray, list[np.ndarray], list[list[str]]]:
    """Per text: its number of words, merged spans (2 x k, word numbers) and
    the items that occur."""
    n = len(column)
    counts = np.zeros(n, dtype=np.int64)
    shards, flat = Shards(phrases), np.zeros(n + 1, dtype=np.int64)
    at = 0
    for w in words(column):
        counts[w.first:w.last] = w.counts
        ends = np.cumsum(w.counts + 1)
        flat[w.first:w.last] = at + ends - (w.counts + 1)
        symbols = np.zeros(int(ends[-1]), dtype=np.int64)
        symbols[np.arange(len(w.hashes)) + np.repeat(np.arange(len(w.counts)), w.counts)] = phrases.symbols(w.hashes)
        shards.add(symbols, at)
        at += len(symbols)
    flat[n] = at
    spans, items = shards.result()
    row = np.searchsorted(flat[:n], spans[0], side="right") - 1
    bounds = np.searchsorted(row, np.arange(n + 1))
    per_row = [spans[:, bounds[k]:bounds[k + 1]] - flat[k] for k in range(n)]
    found: list[list[str]] = [[] for _ in range(n)]
    if items.shape[1]:
        owner = np.searchsorted(flat[:n], items[0], side="right") - 1
        for k, item in np.unique(np.stack([owner, items[1]]), axis=1).T:
            if phrases.items[item] is not None:
                found[k].append(phrases.items[item])
    return counts, per_row, found


def without(text: str, spans: np.ndarray) -> str:
    """``text`` with the words of the spans, and what is between them, replaced by a line end."""
    column = pa.array([text], type=pa.string())
    w = list(words(column))[0]
    raw, out, at = text.encode(), [], 0
    for a, b in spans.T:
        out.append(raw[at:w.starts[a]])
        at = int(w.ends[b - 1])
    out.append(raw[at:])
    return b"\n".join(out).decode()


def cleaned(text: str, phrases: Phrases, spans: np.ndarray) -> str:
    """Remove spans until no phrase is left (a cut can join new ones)."""
    while spans.shape[1]:
        text = without(text, spans)
        spans = find(pa.array([text], type=pa.string()), phrases)[1][0]
    return text


def blocks(items: DataFrame, id_col: str, text_col: str, window: int, limit: int) -> Iterator[Phrases]:
    """The benchmark in blocks of at most ``limit`` bytes of text (or one item)."""
    held, size = [], 0
    for row in items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        grown = len((row.t or "").encode())
        if held and size + grown > limit:
            yield Phrases(held, window)
            held, size = [], 0
        held.append((row.i, hash_words(row.t)))
        size += grown
    yield Phrases(held, window)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", remove: bool = False,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with _words (their number), _spans (merged, word numbers) and
    _items (ids of the items that occur); columns of these names are replaced.  With
    ``remove`` the spans are cut out of the text too, until no test phrase is left."""
    spark = docs.sparkSession
    docs = docs.drop(*[n for n, _ in ADDED])
    prepare(spark)
    queue = blocks(items, item_id, item_text, window, block_bytes)
    now, following = next(queue), next(queue, None)
    if remove and following is not None:
        return removed_by_rounds(docs, items, window, text_col, item_id, item_text, block_bytes)
    schema = T.StructType(docs.schema.fields + [T.StructField(n, t) for n, t in ADDED])
    names = docs.columns
    state = docs.select("*", F.lit(None).cast("long").alias("_words"), F.lit(None).cast(SPANS).alias("_spans"),
                        F.lit(None).cast("array<string>").alias("_items"))

    def search(compiled):
        def run(batches):
            phrases = compiled.value
            for batch in batches:
                col = dict(zip(batch.schema.names, batch.columns))
                counts, spans, found = find(col[text_col], phrases)
                hit = [k for k, s in enumerate(spans) if s.shape[1]]
                before_spans, before_items = {}, {}
                if col["_spans"].null_count < len(counts):
                    before_spans = {k: v for k, v in enumerate(col["_spans"].to_pylist()) if v}
                    before_items = {k: v for k, v in enumerate(col["_items"].to_pylist()) if v}
                if remove and hit:
                    texts = col[text_col].to_pylist()
                    for k in hit:
                        texts[k] = cleaned(texts[k], phrases, spans[k])
                    col[text_col] = pa.array(texts, type=col[text_col].type)
                else:
                    for k, old in before_spans.items():
                        spans[k] = merged(np.concatenate(
                            [spans[k], np.array([[s["start"], s["end"]] for s in old], dtype=np.int64).T], axis=1))
                for k, old in before_items.items():
                    found[k] = sorted(set(found[k]) | set(old))
                yield pa.RecordBatch.from_arrays(
                    [col[c] for c in names] + [
                        pa.array(counts, type=pa.int64()),
                        pa.array([[{"start": int(a), "end": int(b)} for a, b in s.T] if s.shape[1] else []
                                  for s in spans], type=SPANS_ARROW),
                        pa.array(found, type=pa.list_(pa.string()))],
                    names=[f.name for f in schema.fields])
        return run

    while now is not None:
        state = state.mapInArrow(search(spark.sparkContext.broadcast(now)), schema)
        if following is not None:
            state = stored(state, "decontam")
        now, following = following, next(queue, None)
    return state


def removed_by_rounds(docs: DataFrame, items: DataFrame, window: int, text_col: str, item_id: str, item_text: str,
                      block_bytes: int) -> DataFrame:
    """Removal by a benchmark of several blocks, with the result of a single one.
    A round searches the same text for all blocks and then cuts what they found;
    rows that were cut go through all blocks again until none is hit.  _words,
    _spans and _items are those of the first round."""
    names = [f"`{c}`" for c in docs.columns]

    def searched(rows):
        return stored(decontaminate(rows, items, window, text_col, item_id, item_text, False, block_bytes), "decontam")

    def cut(batches):
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns))
            texts = [without(t, np.array([[s["start"], s["end"]] for s in spans], dtype=np.int64).T)
                     for t, spans in zip(col[text_col].to_pylist(), col.pop("_spans").to_pylist())]
            col[text_col] = pa.array(texts, type=col[text_col].type)
            yield pa.RecordBatch.from_arrays(list(col.values()), names=list(col))

    found = searched(docs)
    parts = [found.where("size(_spans) = 0")]
    live = found.where("size(_spans) > 0").select(*names, F.struct(*[n for n, _ in ADDED]).alias("_found"), "_spans")
    while not live.isEmpty():
        again = searched(stored(live.mapInArrow(cut, live.drop("_spans").schema), "cut"))
        parts.append(again.where("size(_spans) = 0").select(*names, "_found.*"))
        live = again.where("size(_spans) > 0").select(*names, "_found", "_spans")
    return functools.reduce(DataFrame.unionAll, parts)


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: words, words hit, items and whether it is contaminated."""
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        F.col(id_col).alias("doc_id"), F.col("_words").alias("n_words"), hit.alias("n_hit"),
        F.size(F.array_distinct("_items")).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(F.array_distinct("_items")), ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"))
