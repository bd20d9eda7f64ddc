"""String expressions for codebook text (JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_sentence(s) -> Column:
    """Trim surrounding whitespace, then collapse runs of spaces (spaces
    only: tabs and newlines inside the text are kept)."""
    return F.regexp_replace(F.regexp_replace(_c(s), r"^\s+|\s+$", ""), " {2,}", " ")


def flag_multiline(s) -> Column:
    """True when the text holds more than one line ('\\n' breaks; one
    trailing break does not count)."""
    return F.size(F.split(F.regexp_replace(_c(s), "\n$", ""), "\n")) > 1


def strip_item_number(s) -> Column:
    """Drop a leading item number such as '12.' or '3 .' and the spaces
    after it."""
    return F.regexp_replace(_c(s), r"^([0-9.]\s*)*", "")


def parse_mode(mode) -> tuple[Column, Column, Column]:
    """(source, no_norm, random_dims) from a mode string such as
    'feat_raw', 'feat_agg_no_norm', 'llm_random_768' or 'llm_openai'; no number
    after 'llm_random_' gives null dims."""
    m = _c(mode)
    base = F.regexp_replace(m, "_no_norm$", "")
    source = F.when(m.startswith("llm_"), F.lit("embedding")).otherwise(F.lit("features"))
    no_norm = m.endswith("_no_norm")
    dims = F.when(base.startswith("llm_random_"),
                  F.regexp_extract(base, r"^llm_random_(\d+)$", 1).try_cast("int"))
    return source, no_norm, dims


def word_windows(s, max_len: int) -> Column:
    """Split a text on single spaces into windows of at most ``max_len - 1``
    words (below the limit), each next window keeping an overlap of
    (2 * max_len) // 3 words, until the rest fits in ``max_len`` words; the
    rest is the last window.  A text of at most ``max_len`` words is one
    window.  Returns array<string>; whole texts, no prefix is dropped."""
    w = max_len - 1
    n23 = (2 * max_len) // 3
    step = max(1, w - n23)
    words = F.split(_c(s), " ")
    n = F.size(words)
    m = F.when(n > max_len, F.ceil((n - max_len) / F.lit(step)).cast("int")).otherwise(F.lit(0))
    starts = F.sequence(F.lit(0), m * step, F.lit(step))
    return F.transform(starts, lambda st, i: F.array_join(
        F.when(i < m, F.slice(words, st + 1, F.lit(w))).otherwise(F.slice(words, st + 1, n - st)), " "))
