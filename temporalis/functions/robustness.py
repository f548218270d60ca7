"""Robustness of formulas: as Spark columns over packed series, as SQL text, and by numpy in tasks.

A packed series has a column ``vars``: one array of values for each variable. All three
forms agree; columns suit a few formulas, numpy in Arrow batches suits hundreds. Robustness
is at step 0. A formula must not look beyond the series (``check_horizon``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .formula import And, Atom, Eventually, Formula, Globally, Not, Or, Until, horizon, parse


#: More formulas than these are evaluated by numpy in Arrow batches: array functions aren't compiled by Spark.
COLUMNS = 4


def check_horizon(phi: Formula, steps: int) -> None:
    if horizon(phi) > steps - 1:
        raise ValueError(f"{phi} looks {horizon(phi)} steps ahead, a series has {steps}")


def column(phi: Formula, series: Column, t: Column | int = 0) -> Column:
    """Robustness at step t as a column; series is the array of the variables' arrays."""
    t = F.lit(t) if isinstance(t, int) else t
    match phi:
        case Atom(v, c, lte):
            x = F.get(F.get(series, F.lit(v)), t)
            return F.lit(c) - x if lte else x - F.lit(c)
        case Not(c):
            return -column(c, series, t)
        case And(a, b):
            return F.least(column(a, series, t), column(b, series, t))
        case Or(a, b):
            return F.greatest(column(a, series, t), column(b, series, t))
        case Globally(c, lo, hi):
            return F.array_min(F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda i: column(c, series, t + i)))
        case Eventually(c, lo, hi):
            return F.array_max(F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda i: column(c, series, t + i)))
        case Until(a, b, lo, hi):
            before = lambda i: F.when(i > 0, F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(i - 1, F.lit(0))), lambda k: column(a, series, t + k)))).otherwise(F.lit(float("inf")))
            return F.array_max(F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda i: F.least(column(b, series, t + i), before(i))))
    raise TypeError(f"not a formula: {phi!r}")


def sql(phi: Formula, series: str = "vars", t: str = "0", depth: int = 0) -> str:
    """The same as SQL text with list functions (1-based subscripts)."""
    i = f"i{depth}"
    match phi:
        case Atom(v, c, lte):
            x = f"{series}[{v + 1}][{t} + 1]"
            return f"({c!r}::double - {x})" if lte else f"({x} - {c!r}::double)"
        case Not(c):
            return f"(-{sql(c, series, t, depth)})"
        case And(a, b) | Or(a, b):
            return f"{'least' if isinstance(phi, And) else 'greatest'}({sql(a, series, t, depth)}, {sql(b, series, t, depth)})"
        case Globally(c, lo, hi) | Eventually(c, lo, hi):
            pick = "list_min" if isinstance(phi, Globally) else "list_max"
            return f"{pick}(list_transform(range({lo}, {hi + 1}), lambda {i}: {sql(c, series, f'({t} + {i})', depth + 1)}))"
        case Until(a, b, lo, hi):
            k = f"k{depth}"
            before = f"coalesce(list_min(list_transform(range(0, {i}), lambda {k}: {sql(a, series, f'({t} + {k})', depth + 1)})), 'inf'::double)"
            return f"list_max(list_transform(range({lo}, {hi + 1}), lambda {i}: least({sql(b, series, f'({t} + {i})', depth + 1)}, {before})))"
    raise TypeError(f"not a formula: {phi!r}")


def extrema(x: np.ndarray, lo: int, hi: int, steps: int, pick: np.ufunc) -> np.ndarray:
    """pick over x[t + lo : t + hi + 1] for the first steps t of x [step, series], in three passes whatever the width.

    x is cut into blocks as wide as the window: any window is the end of one and the start of the next.
    """
    width = hi - lo + 1
    own = x[lo : lo + steps + width - 1]
    if width == 1:
        return own
    if steps == 1:
        return pick.reduce(own, axis=0, keepdims=True)
    size, n = own.shape
    blocks = np.pad(own, ((0, -size % width), (0, 0))).reshape(-1, width, n)
    fore, back = blocks.copy(), blocks
    for k in range(1, width):  # a pass over all series of all blocks at once
        pick(fore[:, k], fore[:, k - 1], out=fore[:, k])
        pick(back[:, -1 - k], back[:, -k], out=back[:, -1 - k])
    return pick(back.reshape(-1, n)[:steps], fore.reshape(-1, n)[width - 1 : width - 1 + steps])


def until(left: np.ndarray, right: np.ndarray, lo: int, hi: int, steps: int, least: np.ufunc, most: np.ufunc) -> np.ndarray:
    """Until at the first steps in one pass from the end, of left and right [step, series].

    It holds as far as right does within the window, left holds up to lo, and from lo on left holds
    until right does at any later step: where that is after hi, left holds at all steps before.
    """
    reach = np.empty(right.shape)
    later = np.full(right.shape[1], np.nan)
    for t in range(len(right) - 1, -1, -1):
        later = reach[t] = np.fmax(right[t], np.where(np.isnan(later), np.nan, least(left[t], later)))
    found, after = extrema(right, lo, hi, steps, most), reach[lo : lo + steps]
    out = np.where(np.isnan(found) | np.isnan(after), np.nan, np.minimum(found, after))
    return np.where(np.isnan(out), np.nan, least(out, extrema(left, 0, lo - 1, steps, least))) if lo else out


class Graph:
    """The distinct sub-formulas of a list of formulas, each evaluated once a batch and freed after its last use.

    A threshold only shifts a value, and a negation turns least into most: so chains of negations
    and windows over one variable are nodes without either (``_refer`` keeps sign and shift beside),
    and formulas share them whatever their thresholds. Rounding keeps order, so values are the same.
    """

    def __init__(self, formulas: list[Formula], steps: int = 1):
        self.steps = steps
        self.nodes: list[tuple] = []
        self._known: dict[tuple, int] = {}
        self.roots = [self._refer(phi) for phi in formulas]
        self._known.clear()
        self.need = [0] * len(self.nodes)
        self.uses = [0] * len(self.nodes)
        for i, _, _ in self.roots:
            self.need[i], self.uses[i] = steps, self.uses[i] + 1
        for i in range(len(self.nodes) - 1, -1, -1):
            kind, refs, lo, hi = self.nodes[i]
            if kind == "x":
                continue
            for j, _, _ in refs:
                self.need[j], self.uses[j] = max(self.need[j], self.need[i] + hi), self.uses[j] + 1

    def _node(self, kind: str, refs: tuple, lo: int = 0, hi: int = 0) -> tuple[int, int, float]:
        key = (kind, refs, lo, hi)
        if key not in self._known:
            self._known[key] = len(self.nodes)
            self.nodes.append(key)
        return self._known[key], 1, 0.0

    def _refer(self, phi: Formula) -> tuple[int, int, float]:
        """(node, sign, shift): the formula's value is sign * node + shift."""
        match phi:
            case Atom(v, c, lte):
                i, _, _ = self._node("x", (v,))
                return (i, -1, c) if lte else (i, 1, -c)
            case Not(c):
                i, sign, shift = self._refer(c)
                return i, -sign, -shift
            case And(a, b) | Or(a, b):
                return self._node("and" if isinstance(phi, And) else "or", (self._refer(a), self._refer(b)))
            case Globally(c, lo, hi) | Eventually(c, lo, hi):
                i, sign, shift = self._refer(c)
                j, _, _ = self._node("least" if isinstance(phi, Globally) == (sign > 0) else "most", ((i, 1, 0.0),), lo, hi)
                return j, sign, shift
            case Until(a, b, lo, hi):
                return self._node("until", (self._refer(a), self._refer(b)), lo, hi)
        raise TypeError(f"not a formula: {phi!r}")

    def horizon(self) -> int:
        return max(self.need, default=self.steps) - self.steps

    def values(self, x: np.ndarray, absent: bool = False):
        """(formula's place, robustness [steps, series]) of each formula as it is done, for x [variable, step, series].

        With absent a NaN is a step without a value: windows pass over it, and over none but such are NaN.
        """
        least, most = (np.fmin, np.fmax) if absent else (np.minimum, np.maximum)
        held: list[np.ndarray | None] = [None] * len(self.nodes)
        left = list(self.uses)
        wanted: dict[int, list[tuple[int, int, float]]] = {}
        for place, (i, sign, shift) in enumerate(self.roots):
            wanted.setdefault(i, []).append((place, sign, shift))

        def moved(ref: tuple[int, int, float], n: int) -> np.ndarray:
            i, sign, shift = ref
            v = held[i][:n]
            return v if (sign, shift) == (1, 0.0) else v + shift if sign > 0 else shift - v

        for i, (kind, refs, lo, hi) in enumerate(self.nodes):
            n = self.need[i]
            if kind == "x":
                held[i] = x[refs[0], :n]
            elif kind in ("and", "or"):
                a, b = (moved(r, n) for r in refs)
                held[i] = (least if kind == "and" else most)(a, b)
            elif kind == "until":
                a, b = (moved(r, n + hi) for r in refs)
                held[i] = until(a, b, lo, hi, n, least, most)
            else:
                held[i] = extrema(held[refs[0][0]], lo, hi, n, least if kind == "least" else most)
            for place, sign, shift in wanted.get(i, ()):
                yield place, moved((i, sign, shift), self.steps)
                left[i] -= 1
            for j in {r[0] for r in refs} if kind != "x" else ():
                left[j] -= sum(r[0] == j for r in refs)
                if not left[j]:
                    held[j] = None
            if not left[i]:
                held[i] = None


def trace(phi: Formula, x: np.ndarray, steps: int = 1) -> np.ndarray:
    """Robustness [series, t] at the first steps, of series x [series, variable, step]."""
    return next(v for _, v in Graph([phi], steps).values(np.moveaxis(x, 0, 2))).T


def features(panel: DataFrame, formulas: list[Formula], steps: int, vectorised: bool | None = None, append: bool = False) -> DataFrame:
    """panel (series_id, label, split, vars) with feats: the robustness of each formula, in order.

    With append, panel has feats already: they come first, and vars stay in the row.
    """
    for phi in formulas:
        check_horizon(phi, steps)
    if not append and not (len(formulas) > COLUMNS if vectorised is None else vectorised):
        return panel.select("series_id", "label", "split", F.array(*[column(phi, F.col("vars")) for phi in formulas]).alias("feats"))

    ship(panel.sparkSession)

    def evaluate(batches):
        graph = Graph(formulas)
        for b in batches:
            n = b.num_rows
            lists = b.column(3)
            x = lists.flatten().flatten().to_numpy(zero_copy_only=False).reshape(n, -1, steps) if n else np.zeros((0, 1, steps))
            rho = np.empty((len(formulas), n))
            for place, own in graph.values(np.ascontiguousarray(np.moveaxis(x, 0, 2))):
                rho[place] = own[0]
            own = rho.T
            if append:
                own = np.hstack([b.column(4).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1), own]) if n else own
            feats = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * own.shape[1], pa.int32()), pa.array(own.ravel()))
            kept = [b.column(0), b.column(1), b.column(2), *([lists] if append else [])]
            yield pa.RecordBatch.from_arrays([*kept, feats], names=["series_id", "label", "split", *(["vars"] if append else []), "feats"])

    if append:
        return panel.select("series_id", "label", "split", "vars", "feats").mapInArrow(evaluate, "series_id long, label string, split string, vars array<array<double>>, feats array<double>")
    return panel.select("series_id", "label", "split", "vars").mapInArrow(evaluate, "series_id long, label string, split string, feats array<double>")


#: Formulas that a worker keeps parsed.
PARSED = 10_000
_graphs: dict[str, Graph] = {}


def robustness_of(series: pa.Array, texts: pa.Array) -> pa.Array:
    """Robustness at step 0 of each series (an array a variable) under the formula that its text tells.

    Rows of one text and shape are evaluated side by side. Null where series, text or any value is null, or where the
    variables differ in length; a formula that looks beyond its series, or at a variable that it lacks, is an error.
    """
    texts, rows = texts.to_pylist(), series.to_pylist()
    groups: dict[tuple, list[int]] = {}
    for i, (text, own) in enumerate(zip(texts, rows, strict=True)):
        if text is not None and own and all(v is not None and len(v) == len(own[0]) and None not in v for v in own):
            groups.setdefault((text, len(own), len(own[0])), []).append(i)
    out = np.full(len(texts), np.nan)
    for (text, count, steps), at in groups.items():
        if text not in _graphs:
            if len(_graphs) >= PARSED:
                _graphs.clear()
            _graphs[text] = Graph([parse(text)])
        graph = _graphs[text]
        if graph.horizon() >= steps or any(kind == "x" and refs[0] >= count for kind, refs, _, _ in graph.nodes):
            raise ValueError(f"{text}: a series has {count} variables and {steps} steps")
        x = np.ascontiguousarray(np.moveaxis(np.array([rows[i] for i in at]), 0, 2))
        out[at] = next(v for _, v in graph.values(x))[0]
    return pa.array(out, mask=np.isnan(out))


def register_robustness(spark: SparkSession) -> None:
    """The SQL function ``robustness(vars, formula)``: the formula is a column of texts."""
    ship(spark)

    @F.arrow_udf("double")
    def robustness(series: pa.Array, texts: pa.Array) -> pa.Array:
        return robustness_of(series, texts)

    spark.udf.register("robustness", robustness)


def long_features(feats: DataFrame) -> DataFrame:
    """One row (series_id, label, split, formula_id, rho) a series and formula."""
    return feats.select("series_id", "label", "split", F.posexplode("feats").alias("formula_id", "rho"))


