"""Subject pooling over rows sorted by subject: no vector of another subject is held."""

import math

import pytest

from itemspace.operators import pooling
from itemspace.operators import vectors as V

BOOK = [(1, [1.0, -2.0, None]), (2, [0.5, 4.0, 3.0]), (2, [2.0, 1.0, 1.0]), (3, [math.nan, 1.0, 2.0]), (4, None), (5, [7.0])]
ANSWERS = [(10, 1, 2), (10, 2, 3), (10, 3, 1), (11, 1, None), (12, 9, 4), (13, 5, 2), (13, 5, 3), (14, 4, 1), (None, 2, 1), (None, 1, 1),
           (15, 1, None), (15, 2, 4)]


def _want(how):
    rows = {}
    for s, item, a in ANSWERS:
        for i, e in BOOK:
            if i == item:
                rows.setdefault(s, []).append((a, e))
    out = {}
    for s, pairs in rows.items():
        size = max(-1 if e is None else len(e) for _, e in pairs)
        v = None if size < 0 else []
        for d in range(max(size, 0)):
            x = [a * e[d] for a, e in pairs if a is not None and e is not None and d < len(e) and e[d] is not None]
            real = [y for y in x if not math.isnan(y)]
            nan = len(real) < len(x)
            if not x:
                v.append(None)
            elif how == "min":
                v.append(min(real) if real else math.nan)
            else:
                v.append(math.nan if nan else max(x) if how == "max" else sum(x) / (len(x) if how == "mean" else 1))
        out[s] = (sum(a is not None for a, _ in pairs), v)
    return out


@pytest.mark.parametrize("how", ["max", "min", "sum", "mean"])
@pytest.mark.parametrize("piece", [1, 2, 8192])
def test_pooling_of_nulls_copies_and_uneven_vectors(spark, monkeypatch, how, piece):
    import numpy as np
    import pyarrow as pa
    book = pooling.Codebook.of(pa.array([e for _, e in BOOK], pa.list_(pa.float64())))
    rows = sorted(((s, at, a) for s, item, a in ANSWERS for at, (i, _) in enumerate(BOOK) if i == item),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
                                        pa.array([r[2] for r in rows], pa.float64())], names=["subject", "_at", "_a"])
    monkeypatch.setattr(pooling, "PIECE", piece)

    class Held:
        value = book
    got = [r for b in pooling.pooled(Held, how)(iter([batch])) for r in b.to_pylist()]
    want = _want(how)
    assert len(got) == len(want)
    for r in got:
        n, v = want[r["subject"]]
        assert r["_n"] == n
        assert (r["v"] is None) == (v is None)
        for x, y in zip(r["v"] or [], v or [], strict=True):
            assert (x is None and y is None) or np.allclose(x, y, equal_nan=True)


def test_embed_subjects_holds_no_wide_state(spark):
    resp = spark.createDataFrame([(s, i, (s * i) % 5 + 1) for s in range(3000) for i in (1, 2, 3)], "subject long, item_id int, answer int")
    book = [(i, [math.sin(i * d) for d in range(70)]) for i in (1, 2, 3)]
    iv = spark.createDataFrame(book, "item_id int, e array<double>")
    for how, f in (("mean", lambda x: sum(x) / len(x)), ("max", max)):
        out = V.embed_subjects(resp, iv, how, n_items=3)
        # wide aggregates held every subject of a task
        assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString()
        got = {r.subject: r.v for r in out.collect()}
        assert len(got) == 3000
        for s in (0, 7, 2999):
            want = [f([((s * i) % 5 + 1) * e[d] for i, e in book]) for d in range(70)]
            assert max(abs(a - b) for a, b in zip(got[s], want, strict=True)) < 1e-12
