import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from temporalis.functions.formula import And, Atom, Eventually, Globally, Not, Or, Sampler, Until, children, fold, horizon, parse, shifted, simplify, variables
from temporalis.functions.robustness import Graph, check_horizon, column, extrema, features, long_features, register_robustness, sql, trace
from temporalis.functions.traces import block_traces, trace_sql, window_trace


def brute(phi, x, t=0):
    """Straight from the definition, for one series x [variable][step]."""
    match phi:
        case Atom(v, c, lte):
            return c - x[v][t] if lte else x[v][t] - c
        case Not(c):
            return -brute(c, x, t)
        case And(a, b):
            return min(brute(a, x, t), brute(b, x, t))
        case Or(a, b):
            return max(brute(a, x, t), brute(b, x, t))
        case Globally(c, lo, hi):
            return min(brute(c, x, t + k) for k in range(lo, hi + 1))
        case Eventually(c, lo, hi):
            return max(brute(c, x, t + k) for k in range(lo, hi + 1))
        case Until(a, b, lo, hi):
            return max(min(brute(b, x, t + k), min((brute(a, x, t + j) for j in range(k)), default=math.inf)) for k in range(lo, hi + 1))


def drawn(n, seed=0, v=2, steps=9):
    return Sampler([-1.0] * v, [1.0] * v, steps - 1, 3, seed, only_temporal=False, until_weight=2.0).sample(n)


def test_numpy_equals_definition_and_shift_identity():
    x = np.random.default_rng(0).normal(size=(5, 2, 9))
    for phi in drawn(300):
        assert horizon(phi) <= 8
        got = trace(phi, x)[:, 0]
        assert got == pytest.approx([brute(phi, s) for s in x])
        assert trace(shifted(phi, 0.3), x)[:, 0] == pytest.approx(got + 0.3)
        assert trace(simplify(phi), x)[:, 0] == pytest.approx(got)
        assert trace(Not(Not(phi)), x)[:, 0] == pytest.approx(got)


def test_text_is_read_back():
    for phi in drawn(500, 11, v=12, steps=80):
        for p in (phi, simplify(phi), shifted(phi, 1e-7), Or(phi, phi)):
            assert parse(str(p)) == p and str(parse(str(p))) == str(p)
    a, b, c = Atom(0, 1.0), Atom(1, -2.5e-7, True), Atom(10, float("inf"))
    assert parse(" x0 >= 1 | x1<=-2.5e-07&x10 >= inf U[0,3] !x0 >= 1 ") == Or(a, And(b, Until(c, Not(a), 0, 3)))
    assert parse("x0 >= 1 | x1 <= -2.5e-07 | x0 >= 1") == Or(Or(a, b), a) and parse("G[1,2]F[0,3] x0 >= 1") == Globally(Eventually(a, 0, 3), 1, 2)
    for bad in ("", "x0", "x0 >= ", "(x0 >= 1", "x0 >= 1)", "G[1,2]", "x0 >= 1 &", "x0 > 1", "H[0,1](x0 >= 1)", "x0 >= 1 x0 >= 1", "U[0,1]"):
        with pytest.raises(ValueError):
            parse(bad)


def test_robustness_in_sql(spark):
    r = random.Random(3)
    some = drawn(20, 8)
    rows = [(i, [[r.uniform(-1, 1) for _ in range(9 + i % 2)] for _ in range(2)], str(some[i % 20])) for i in range(60)]
    odd = [(100, None, "x0 >= 1"), (101, [[1.0]], None), (102, [[None, 1.0]], "x0 >= 1"), (103, [], "x0 >= 1"), (104, [[1.0], [1.0, 2.0]], "x0 >= 1")]
    register_robustness(spark)
    got = {x.i: x.rho for x in spark.sql("select i, robustness(v, text) as rho from {t}", t=spark.createDataFrame(rows + odd, "i int, v array<array<double>>, text string")).collect()}
    assert got == {i: brute(some[i % 20], v) for i, v, _ in rows} | {i: None for i, *_ in odd}
    for text in ("x5 >= 1", "G[0,9](x0 >= 1)", "x0 !"):
        with pytest.raises(Exception, match="x5|G|no formula|missing|more"):
            spark.sql("select robustness(array(array(1D)), {text})", text=text).collect()


def test_columns_sql_and_numpy_agree(spark):
    import duckdb

    r = random.Random(1)
    rows = [(i, "a", "TRAIN", [[r.uniform(-1, 1) for _ in range(9)] for _ in range(2)]) for i in range(6)]
    panel = spark.createDataFrame(rows, "series_id long, label string, split string, vars array<array<double>>")
    some = drawn(25, 3)
    a = {(x.series_id, x.formula_id): x.rho for x in long_features(features(panel, some, 9, vectorised=False)).collect()}
    b = {(x.series_id, x.formula_id): x.rho for x in long_features(features(panel, some, 9, vectorised=True)).collect()}
    assert a == pytest.approx(b) and len(a) == 150
    for i, _, _, x in rows:
        said = duckdb.connect().execute("select " + ", ".join(sql(p) for p in some) + " from (select ?::double[][] as vars)", [x]).fetchall()[0]
        assert [a[i, j] for j in range(25)] == pytest.approx(said)


def size(phi):
    return 1 + sum(map(size, children(phi)))


def test_extrema_of_any_width():
    x = np.random.default_rng(1).normal(size=(40, 4))
    for lo, width, steps in itertools.product((0, 3), (1, 2, 5, 16, 30), (1, 2, 7)):
        own = np.lib.stride_tricks.sliding_window_view(x[lo : lo + steps + width - 1], width, axis=0)
        assert (extrema(x, lo, lo + width - 1, steps, np.minimum) == own.min(axis=2)).all() and (extrema(x, lo, lo + width - 1, steps, np.maximum) == own.max(axis=2)).all()


def test_a_bank_is_one_graph():
    """1,000 formulas with each node evaluated once, held no longer than it is used."""
    some = drawn(1000, 5, v=3, steps=40)
    graph = Graph(some)
    assert len(graph.nodes) < 0.6 * sum(map(size, some)) and graph.horizon() == max(map(horizon, some))
    x = np.random.default_rng(2).normal(size=(3, 3, 40))
    got = dict(graph.values(np.moveaxis(x, 0, 2)))
    assert sorted(got) == list(range(1000))
    for j, phi in enumerate(some):
        assert (trace(phi, x) == got[j].T).all()
    for j in range(0, 1000, 20):
        assert got[j][0].tolist() == [brute(some[j], s) for s in x]
    # one formula with other thresholds and its negation are one node
    assert len(Graph([Globally(Atom(0, 0.5), 2, 6), Eventually(Atom(0, -1.0, True), 2, 6), Not(Globally(Atom(0, 0.1), 2, 6))]).nodes) == 2


def cut_short(phi, x, t):
    """The value at step t of one series, null where there is none."""
    at = lambda v, k: x[v][k] if k < len(x[v]) else None
    some = lambda pick, v: pick(known) if (known := [y for y in v if y is not None]) else None
    match phi:
        case Atom(v, c, lte):
            return None if at(v, t) is None else c - at(v, t) if lte else at(v, t) - c
        case Not(c):
            return None if (y := cut_short(c, x, t)) is None else -y
        case And(a, b) | Or(a, b):
            return some(min if isinstance(phi, And) else max, [cut_short(a, x, t), cut_short(b, x, t)])
        case Globally(c, lo, hi) | Eventually(c, lo, hi):
            return some(min if isinstance(phi, Globally) else max, [cut_short(c, x, t + k) for k in range(lo, hi + 1)])
        case Until(a, b, lo, hi):
            right = [(k, cut_short(b, x, t + k)) for k in range(lo, hi + 1)]
            return some(max, [some(min, [y, *(cut_short(a, x, t + j) for j in range(k))]) for k, y in right if y is not None])


def test_traces_agree_also_past_the_end_and_over_gaps(spark):
    import duckdb

    r = random.Random(4)
    lengths = [13, 1, 6, 20, 13]
    series = {i: [[None if r.random() < 0.15 else r.uniform(-1, 1) for _ in range(n)] for _ in range(2)] for i, n in enumerate(lengths)}
    rows = [(i, v, t, y) for i, s in series.items() for v in range(2) for t, y in enumerate(s[v]) if y is not None]
    long = spark.createDataFrame(rows, "series_id long, var int, t int, x double").repartition(3).cache()
    some = [p for p in drawn(60, 9) if not isinstance(p, Atom)][:14]
    want = {(i, t, j): cut_short(p, s, t) for j, p in enumerate(some) for i, s in series.items() for t in range(lengths[i])}
    for block in (4, 1, 4096):
        got = {(x.series_id, x.t, j): y for x in block_traces(long, some, block).collect() for j, y in enumerate(x.rhos)}
        assert {k: y for k, y in got.items()} == {k: want[k] for k in got}
        assert {k[:2] for k in got} == {(i, t) for i, _, t, _ in rows if any(v in variables(p) for p in some for v in range(2))}
    first = {(x.series_id, j): y for x in block_traces(long, some, first_only=True).collect() for j, y in enumerate(x.rhos)}
    assert first == {(i, j): want[i, t, j] for i, t, j in got if t == 0}
    db = duckdb.connect()
    db.execute("create table long(series_id bigint, var int, t int, x double)")
    db.executemany("insert into long values (?, ?, ?, ?)", rows)
    for j, p in list(enumerate(some))[:5]:
        by_sql = {(i, t): y for i, t, y in db.execute(trace_sql(p, "long")).fetchall()}
        assert by_sql == {k: want[*k, j] for k in by_sql} and by_sql
        assert {(x.series_id, x.t): x.rho for x in window_trace(long, p).collect()} == by_sql


def test_edges(spark):
    with pytest.raises(ValueError):
        check_horizon(Globally(Atom(0, 0.0), 0, 5), 5)
    with pytest.raises(ValueError):
        fold([])
    with pytest.raises(TypeError):
        shifted("x", 1.0)
    one = spark.createDataFrame([(1, [[2.0]])], "series_id long, vars array<array<double>>")
    assert one.select(column(Until(Atom(0, 9.0), Atom(0, 0.5), 0, 0), F.col("vars"))).first()[0] == 1.5
    assert str(And(Globally(Atom(0, 0.25), 1, 3), Not(Atom(1, 2.0, True)))) == "(G[1,3](x0 >= 0.25) & !(x1 <= 2))"
    assert simplify(And(Atom(0, 1.0), Atom(0, 2.0))) == Atom(0, 2.0) and simplify(Or(Atom(0, 1.0, True), Atom(0, 2.0, True))) == Atom(0, 2.0, True)
    assert simplify(Globally(Globally(Atom(0, 1.0), 1, 2), 3, 4)) == Globally(Atom(0, 1.0), 4, 6)
    assert [str(p) for p in drawn(5, 7)] == [str(p) for p in drawn(5, 7)]
