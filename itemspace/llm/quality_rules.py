"""Quality rules: a threshold table compiled into one Spark projection.

Everything is built-in expressions over one row, so there is no shuffle and no
user function.  A document is kept when every rule of the table holds.

Cases: null or empty text has no words and fails ``min_words``; repeated rows
give repeated results; an empty table gives an empty result; other input
columns are ignored.  Texts of any length are measured whole.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemspace.llm.runtime import narrow

# White space, symbols, letters and marks at a word's edges, list marks
# and ellipses at a line's, and frequent function words (en, fr, de, es).
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EDGES = ".,;:!?\"()[]"
BULLETS = "\u2022-*"
ELLIPSES = ("...", "\u2026")
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the of and to in is that for with on as by be this it are was at from or an "
    "de la le les et des du un une est que qui dans pour sur en au par avec "
    "der die das und den von zu mit sich auf ist im dem nicht ein eine "
    "el los las del se por con una su para es al lo y"
).split()
WINDOW = 5


class Rule(NamedTuple):
    """``low * whole <= 1000 * part <= high * whole`` (a bound may be None);
    a ratio says little on a short text, so texts under ``from_words`` pass."""
    name: str
    part: str
    whole: str
    low: int | None
    high: int | None
    from_words: int = 0


# Bounds are in thousandths of ``whole``; ``one`` stands for the number 1.
RULES = (
    Rule("length", "n_words", "one", 10_000, None),
    Rule("word_length", "word_chars", "n_words", 2_000, 12_000),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("stop_words", "n_stop", "n_words", 40, None, 40),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 300),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 900),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 300),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 200),
)


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression over the measures."""
    def holds(r: Rule) -> list[Column]:
        part = F.col(r.part) * 1000
        whole = F.lit(1).cast("long") if r.whole == "one" else F.col(r.whole)
        bounds = ([part >= whole * r.low] if r.low is not None else []) + (
            [part <= whole * r.high] if r.high is not None else [])
        return [b | (F.col("n_words") < r.from_words) if r.from_words else b for b in bounds]
    return reduce(lambda a, b: a & b, [c for r in rules for c in holds(r)], F.lit(True))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts that the rules use, one row per input row."""
    t = F.col("text")
    blank = F.translate(t, WHITE, "")
    base = narrow(docs, id_col, text_col).select(
        "doc_id",
        F.array_remove(F.split(t, "[\\x20\\x09-\\x0D]+"), "").alias("w"),
        F.filter(F.split(t, "\n"), lambda line: F.translate(line, WHITE, "") != "").alias("lines"),
        F.length(blank).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    w, n = F.col("w"), F.size("w")
    hashed = base.select(
        "doc_id", "word_chars", "n_symbols",
        n.cast("long").alias("n_words"),
        F.size(F.filter(w, lambda x: F.btrim(F.translate(x, UPPER, LOWER), F.lit(EDGES)).isin(STOP_WORDS)))
        .cast("long").alias("n_stop"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: F.substring(F.btrim(x, F.lit(WHITE)), 1, 1).isin(*BULLETS)))
        .cast("long").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: F.btrim(x, F.lit(WHITE)).endswith(ELLIPSES[0])
                        | F.btrim(x, F.lit(WHITE)).endswith(ELLIPSES[1]))).cast("long").alias("n_ellipsis_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform(
            F.sequence(F.lit(0), n - WINDOW),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])))
        .otherwise(F.array().cast("array<bigint>")).alias("h"))
    # Only texts with a repeated window go on: (hash, position) sorted, so that
    # equal windows are neighbours.
    keep = ["doc_id", "word_chars", "n_symbols", "n_words", "n_stop", "n_lines", "n_dup_lines", "n_bullet_lines",
            "n_ellipsis_lines"]
    packed = hashed.select(*keep, F.when(
        F.size(F.array_distinct("h")) < F.size("h"),
        F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))).alias("s"))
    s = F.col("s")
    found = packed.select(*keep, F.sort_array(F.transform(
        F.filter(s, lambda x, j: x["h"].eqNullSafe(F.get(s, j - 1)["h"]) | x["h"].eqNullSafe(F.get(s, j + 1)["h"])),
        lambda x: x["i"])).alias("at"))
    at = F.col("at")
    return found.select(*keep, F.coalesce(F.aggregate(
        F.transform(at, lambda p, j: F.least(F.lit(WINDOW).cast("long"),
                                             F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW).cast("long")))),
        F.lit(0).cast("long"), lambda acc, x: acc + x), F.lit(0).cast("long")).alias("n_repeat_words"))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row per document: the measures, ``base_failed`` (too short or too
    repetitive) and ``kept``."""
    bad = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return (measures(docs, id_col, text_col)
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "n_stop", "n_lines", "n_bullet_lines", "n_ellipsis_lines", bad.alias("base_failed"), (~bad & verdict(rules)).alias("kept")))
