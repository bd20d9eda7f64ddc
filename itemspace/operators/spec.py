"""Survey specifications as data: rules and scores compiled into one scan.

A specification names a wide survey's item columns, its cleaning rules in order
and its scores.  ``compile_survey`` turns it into column expressions over one row, so
cleaned rows, the funnel (rows left after each rule) and the data-quality counts (rows
that each rule alone rejects) come from the same scan without a shuffle of rows: the
funnel by one aggregate, or as metrics observed while the rows are written.
Only an outlier rule adds a pass, for the mean and deviation of the rows that the
rules before it leave (one scalar subquery).
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Cols(NamedTuple):
    """Columns by name: those that the pattern matches whole, of the places
    [first, last) among the matches."""
    pattern: str
    first: int = 0
    last: int | None = None

    def of(self, df: DataFrame) -> list[str]:
        found = [c for c in df.columns if re.fullmatch(self.pattern, c)][self.first:self.last]
        if not found:
            raise ValueError(f"no column matches {self.pattern!r}")
        return found


class Rule(NamedTuple):
    """``complete``: no column null; ``equals``: every column has the value ``low``;
    ``between``: every column lies in [low, high]; ``total``: their sum does;
    ``outlier``: their sum lies within [mean - low sd, mean + high sd] of the rows left.
    Text is read as a number, and what is none counts as null; a null fails a rule."""
    name: str
    kind: str
    cols: Cols
    low: float | None = None
    high: float | None = None


class Score(NamedTuple):
    """Sum or mean of columns, or of scores named before."""
    name: str
    cols: Cols
    how: str = "sum"


class Survey(NamedTuple):
    name: str
    items: Cols
    rules: tuple[Rule, ...]
    scores: tuple[Score, ...] = ()


class Compiled(NamedTuple):
    """``flagged``: the input with ``_r1``, ``_r2``, ... (rule holds) and scores; its metrics per
    rule; and the names to keep."""
    flagged: DataFrame
    survey: Survey
    items: list[str]

    def rows(self, key: str = "subject") -> DataFrame:
        """(key, items, scores) of the rows that pass every rule."""
        return self.flagged.where(self._passed(len(self.survey.rules))).select(
            key, *self.items, *[s.name for s in self.survey.scores])

    def _passed(self, upto: int) -> Column:
        return functools.reduce(operator.and_, [F.col(f"_r{i + 1}") for i in range(upto)], F.lit(True))

    def metrics(self) -> list[Column]:
        n = len(self.survey.rules)
        return ([F.count_if(self._passed(i)).alias(f"left{i}") for i in range(n + 1)]
                + [F.count_if(~F.col(f"_r{i + 1}")).alias(f"bad{i + 1}") for i in range(n)])

    def report(self) -> DataFrame:
        """(step, rule, rows left, rows that the rule alone rejects), step 0 the input."""
        names = ["input", *[r.name for r in self.survey.rules]]
        stack = ", ".join(f"{i}, '{name}', left{i}, {f'bad{i}' if i else 'cast(0 as bigint)'}" for i, name in enumerate(names))
        return self.flagged.agg(*self.metrics()).selectExpr(f"stack({len(names)}, {stack}) as (step, rule, rows, rejected)")

    def observed_rows(self, key: str = "subject") -> tuple[DataFrame, Observation]:
        """``rows`` with the report's counts as an observation: one scan gives both once the
        rows are written (an action that scans twice, such as a global sort, counts twice)."""
        seen = Observation(f"survey-{self.survey.name}")
        return self._replace(flagged=self.flagged.observe(seen, *self.metrics())).rows(key), seen


def _number(df: DataFrame, c: str) -> Column:
    col = F.col(f"`{c}`")
    return col.try_cast("double") if dict(df.dtypes)[c] == "string" else col.cast("double")


def _sum(cols: Sequence[Column]) -> Column:
    return functools.reduce(operator.add, cols)


def _holds(df: DataFrame, rule: Rule) -> Column:
    names = rule.cols.of(df)
    if rule.kind == "complete":
        return functools.reduce(operator.and_, [F.col(f"`{c}`").isNotNull() for c in names])
    numbers = [_number(df, c) for c in names]
    if rule.kind == "equals":
        return functools.reduce(operator.and_, [x == rule.low for x in numbers])
    if rule.kind == "between":
        return functools.reduce(operator.and_, [x.between(rule.low, rule.high) for x in numbers])
    if rule.kind == "total":
        return _sum(numbers).between(rule.low, rule.high)
    raise ValueError(f"no rule is of kind {rule.kind!r}")


def compile_survey(df: DataFrame, survey: Survey) -> Compiled:
    """The specification on a wide table; a pattern without a match fails here, before
    any job."""
    items = survey.items.of(df)
    out = df
    for i, rule in enumerate(survey.rules):
        if rule.kind == "outlier":
            total = _sum([_number(df, c) for c in rule.cols.of(df)])
            passed = functools.reduce(operator.and_, [F.col(f"_r{j + 1}") for j in range(i)], F.lit(True))
            stats = out.where(passed).agg(F.struct(F.avg(total).alias("mu"), F.stddev_samp(total).alias("sd")).alias("s")).scalar()
            holds = (total >= stats["mu"] - rule.low * stats["sd"]) & (total <= stats["mu"] + rule.high * stats["sd"])
        else:
            holds = _holds(df, rule)
        out = out.withColumn(f"_r{i + 1}", F.coalesce(holds, F.lit(False)))
    known: dict[str, Column] = {}
    for score in survey.scores:
        parts = [known[c] for c in known if re.fullmatch(score.cols.pattern, c)] or [_number(df, c) for c in score.cols.of(df)]
        known[score.name] = _sum(parts) / len(parts) if score.how == "mean" else _sum(parts)
    for name, value in known.items():
        out = out.withColumn(name, value)
    return Compiled(out, survey, items)


# ------------------------------------------------ specifications (fixed values)
def _one_of(*names: str) -> str:
    return "|".join(re.escape(n) for n in names)


def _numbered(prefix: str, numbers: Sequence[int], suffix: str = "") -> str:
    return _one_of(*[f"{prefix}{n}{suffix}" for n in numbers])


ANY = Cols(".*")

# Fixed values of the eight surveys: scales, ages, attempts, accuracies, times, keys.
SURVEYS = {s.name: s for s in (
    Survey("IPIP", Cols("(EXT|EST|AGR|CSN|OPN)[0-9]+"), (
        Rule("complete", "complete", ANY), Rule("one attempt", "equals", Cols("IPC"), 1),
        Rule("answers", "between", Cols("(EXT|EST|AGR|CSN|OPN)[0-9]+", 0, 49), 1, 5),
        Rule("time", "total", Cols("(EXT|EST|AGR|CSN|OPN)[0-9]+_E"), 10_000, 1_000_000)),
        tuple(Score(n, Cols(f"{p}[0-9]+"), "mean") for n, p in (
            ("extraversion", "EXT"), ("emotional_stability", "EST"), ("agreeableness", "AGR"),
            ("conscientiousness", "CSN"), ("openness", "OPN")))),
    Survey("DASS", Cols("Q[0-9]+A"), (
        Rule("complete", "complete", ANY), Rule("one attempt", "equals", Cols("uniquenetworklocation"), 1),
        Rule("age", "between", Cols("age"), 18, 80), Rule("answers", "between", Cols("Q[0-9]+A"), 1, 4),
        Rule("secondary answers", "between", Cols("TIPI[0-9]+"), 1, 7), Rule("native", "equals", Cols("engnat"), 1),
        Rule("time", "total", Cols("(Q|TIPI).*E"), 10_000, 1_000_000)),
        (Score("Depression", Cols(_numbered("Q", (3, 5, 10, 13, 16, 17, 21, 24, 26, 31, 34, 37, 38, 42), "A"))),
         Score("Anxiety", Cols(_numbered("Q", (2, 4, 7, 9, 15, 19, 20, 23, 25, 28, 30, 36, 40, 41), "A"))),
         Score("Stress", Cols(_numbered("Q", (1, 6, 8, 11, 12, 14, 18, 22, 27, 29, 32, 33, 35, 39), "A"))))),
    Survey("HEXACO", Cols("[HEXACO][A-Z][a-z]+[0-9]+"), (
        Rule("complete", "complete", ANY), Rule("attention", "equals", Cols("V1|V2"), 7),
        Rule("answers", "between", Cols("[HEXACO][A-Z][a-z]+[0-9]+"), 1, 7),
        Rule("time", "between", Cols("elapse"), 100, 100_000)),
        tuple(Score(n, Cols(f"{p}[A-Z][a-z]+[0-9]+"), "mean") for n, p in (
            ("honesty", "H"), ("emotionality", "E"), ("extraversion", "X"), ("agreeableness", "A"),
            ("conscientiousness", "C"), ("openness", "O")))),
    Survey("16PF", Cols("[A-Z][0-9]+"), (
        Rule("complete", "complete", ANY), Rule("age", "between", Cols("age"), 18, 80),
        Rule("accuracy", "between", Cols("accuracy"), 85, 100), Rule("time", "between", Cols("elapsed"), 100, 100_000),
        Rule("answers", "between", Cols("[A-Z][0-9]+"), 1, 5)),
        (*[Score(f"_{p}", Cols(f"{p}[0-9]+")) for p in "ABCEFGHILMNO"],
         *[Score(n, Cols(_one_of(*[f"_{p}" for p in parts]))) for n, parts in (
             ("introextroversion", "AFHN"), ("anxiety", "CLO"), ("receptivity", "AIM"), ("accomodation", "EHL"),
             ("control", "FGM"))])),
    Survey("HAMILTON", Cols("[0-9]+"), (
        Rule("complete", "complete", ANY), Rule("outliers", "outlier", Cols("(?!10010$)[0-9]+"), 0.5, 2))),
    Survey("SRQA", Cols("SRQ_?[0-9]+"), (Rule("complete", "complete", ANY),), tuple(
        Score(f"{n}_score", Cols(n)) for n in ("SRQ_admir", "SRQ_negsoc", "SRQ_pass", "SRQ_prosoc", "SRQ_sociab"))),
    Survey("CU", Cols("CU_?[0-9]+"), (Rule("complete", "complete", ANY),), (Score("CU_total_score", Cols("CU_total")),)),
    Survey("SMARTPHONE", Cols("[0-9]+"), (
        Rule("complete", "complete", Cols("[0-9]+")), Rule("outliers", "outlier", Cols("[0-9]+"), 0.5, 2)),
        (Score("total", Cols("[0-9]+")),)),
)}
