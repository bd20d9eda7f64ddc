"""Survey specifications against the same rules one after the other."""

import re

import numpy as np
import pandas as pd
import pytest

from itemspace.operators import spec


def wide(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).to_dict("records"),
                                 ", ".join(f"`{c}` {'string' if pdf[c].dtype == object else 'double'}" for c in pdf.columns))


def answers(rng, names, low, high, n):
    x = rng.integers(low, high + 1, (n, len(names))).astype(float)
    x[rng.random(x.shape) < 0.004] = high + 1         # out of range
    x[rng.random(x.shape) < 0.002] = np.nan
    x[3, 0] = np.nan
    return pd.DataFrame(x, columns=names)


def made(name, rng, n=120):
    """A table with the survey's columns and every kind of bad row."""
    if name == "IPIP":
        q = [f"{p}{i}" for p in ("EXT", "EST", "AGR", "CSN", "OPN") for i in range(1, 11)]
        d = answers(rng, q, 1, 5, n)
        t = pd.DataFrame(rng.integers(100, 40000, (n, 50)).astype(float), columns=[f"{c}_E" for c in q])
        return pd.concat([d, t, pd.DataFrame({"IPC": rng.integers(1, 3, n).astype(float)})], axis=1)
    if name == "DASS":
        d = answers(rng, [f"Q{i}A" for i in range(1, 43)], 1, 4, n)
        t = pd.DataFrame(rng.integers(100, 45000, (n, 42)).astype(float), columns=[f"Q{i}E" for i in range(1, 43)])
        p = answers(rng, [f"TIPI{i}" for i in range(1, 11)], 1, 7, n)
        more = pd.DataFrame({"uniquenetworklocation": rng.integers(1, 3, n), "age": rng.integers(10, 90, n),
                             "engnat": rng.integers(1, 3, n)}).astype(float)
        return pd.concat([d, t, p, more], axis=1)
    if name == "HEXACO":
        d = answers(rng, [f"{p}{f}{i}" for p in "HEXACO" for f in ("Sinc", "Fair") for i in range(1, 4)], 1, 7, n)
        return pd.concat([d, pd.DataFrame({"V1": rng.choice([7.0, 3.0], n, p=[0.9, 0.1]), "V2": rng.choice([7.0, 1.0], n),
                                           "elapse": rng.choice(["50", "900", "x", "200000"], n, p=[0.1, 0.7, 0.1, 0.1])})], axis=1)
    if name == "16PF":
        d = answers(rng, [f"{p}{i}" for p in "ABCEFGHILMNO" for i in range(1, 4)], 1, 5, n)
        return pd.concat([d, pd.DataFrame({"age": rng.integers(10, 90, n).astype(float), "accuracy": rng.integers(70, 110, n).astype(float),
                                           "elapsed": rng.choice(["50", "900", "", "200000"], n, p=[0.1, 0.7, 0.1, 0.1])})], axis=1)
    if name == "SRQA":
        d = answers(rng, [f"SRQ_{i}" for i in range(1, 6)], 0, 4, n)
        return pd.concat([d, answers(rng, ["SRQ_admir", "SRQ_negsoc", "SRQ_pass", "SRQ_prosoc", "SRQ_sociab"], 0, 9, n)], axis=1)
    if name == "CU":
        return pd.concat([answers(rng, [f"CU_{i}" for i in range(1, 6)], 0, 4, n), answers(rng, ["CU_total"], 0, 9, n)], axis=1)
    return answers(rng, [str(i) for i in range(1, 9)] + (["10010"] if name == "HAMILTON" else []), 0, 4, n)


def step_by_step(survey, pdf):
    """(rows left after each rule, rows that each rule alone rejects, rows left)."""
    def numbers(cols):
        names = [c for c in pdf.columns if re.fullmatch(cols.pattern, c)][cols.first:cols.last]
        return pdf[names].apply(pd.to_numeric, errors="coerce")
    left, funnel, alone = pd.Series(True, index=pdf.index), [len(pdf)], []
    for r in survey.rules:
        x = numbers(r.cols)
        if r.kind == "complete":
            ok = pdf[x.columns].notna().all(axis=1)
        elif r.kind == "equals":
            ok = (x == r.low).all(axis=1)
        elif r.kind == "between":
            ok = ((x >= r.low) & (x <= r.high)).all(axis=1)
        else:
            total = x.sum(axis=1, skipna=False)
            low, high = r.low, r.high
            if r.kind == "outlier":
                mu, sd = total[left].mean(), total[left].std()
                low, high = mu - r.low * sd, mu + r.high * sd
            ok = (total >= low) & (total <= high)
        alone.append(int((~ok).sum()))
        left = left & ok
        funnel.append(int(left.sum()))
    return funnel, alone, left


@pytest.mark.parametrize("name", list(spec.SURVEYS))
def test_survey_as_data(spark, name):
    survey = spec.SURVEYS[name]
    pdf = made(name, np.random.default_rng(len(name)))
    pdf["subject"] = np.arange(len(pdf)).astype(float)
    got = spec.compile_survey(wide(spark, pdf), survey)
    funnel, alone, left = step_by_step(survey, pdf)
    report = got.report().orderBy("step").collect()
    assert [r.rows for r in report] == funnel and [r.rejected for r in report][1:] == alone
    assert 0 < funnel[-1] < funnel[0]
    rows, seen = got.observed_rows()
    kept = rows.toPandas().sort_values("subject")      # one scan: a sort in Spark would read, and count, twice
    assert kept["subject"].tolist() == pdf.index[left].astype(float).tolist()
    assert [seen.get[f"left{i}"] for i in range(len(funnel))] == funnel
    for s in survey.scores:
        if s.cols.pattern.startswith("_"):
            continue                                  # of scores, below
        x = pdf.loc[left, [c for c in pdf.columns if re.fullmatch(s.cols.pattern, c)]].astype(float)
        want = x.mean(axis=1) if s.how == "mean" else x.sum(axis=1)
        assert np.allclose(kept[s.name].astype(float), want)
    if name == "16PF":
        parts = {"introextroversion": "AFHN", "anxiety": "CLO", "receptivity": "AIM", "accomodation": "EHL", "control": "FGM"}
        for n, p in parts.items():
            assert np.allclose(kept[n], sum(kept[f"_{x}"] for x in p))


def test_one_scan_and_no_shuffle_of_rows(spark):
    pdf = made("DASS", np.random.default_rng(1))
    pdf["subject"] = 1.0
    got = spec.compile_survey(wide(spark, pdf), spec.SURVEYS["DASS"])
    plan = got.rows()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    report = got.report()._jdf.queryExecution().executedPlan().toString()
    assert report.count("Exchange") == 1 and "Join" not in report


def test_bad_specifications(spark):
    df = spark.createDataFrame([(1, 2.0)], "subject int, q1 double")
    items = spec.Cols("q[0-9]+")
    for rules in ((spec.Rule("x", "equals", spec.Cols("nothing"), 1),), (spec.Rule("x", "no such kind", items),)):
        with pytest.raises(ValueError):
            spec.compile_survey(df, spec.Survey("s", items, rules))
    none = spec.compile_survey(df.limit(0), spec.Survey("s", items, (spec.Rule("c", "complete", items),)))
    assert [r.rows for r in none.report().collect()] == [0, 0]
