"""Robustness at every step: by window frames, as SQL text, and by time blocks of long series.

At the end of a series windows are cut short, and a step without a value is passed over; a
window of none but such steps has no value (null). And, Or take what there is. Until looks
at the steps where its right side has a value. All three forms agree.

``window_trace`` and ``trace_sql`` turn a formula into stages, a column a sub-formula, over
the long panel. ``block_traces`` never gathers a series: values go to blocks of steps, each
with those of the ``horizon`` steps after it, so that a task holds some blocks, whatever
the length of the series.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .formula import And, Atom, Eventually, Formula, Globally, Not, Or, Until, children, horizon, variables
from .robustness import Graph

#: Steps of a block, and values that are evaluated side by side.
BLOCK = 4096
SIDE_BY_SIDE = 1 << 21


def _stages(phi: Formula) -> list[tuple[str, Formula, list[str]]]:
    """(name, sub-formula, names of its parts), parts first; equal sub-formulas are one."""
    names: dict[Formula, str] = {}
    out = []

    def visit(f: Formula) -> str:
        if f not in names:
            parts = [visit(c) for c in children(f)]
            names[f] = f"n{len(names)}"
            out.append((names[f], f, parts))
        return names[f]

    visit(phi)
    return out


def wide(long: DataFrame, some: set[int]) -> DataFrame:
    """(series_id, t, x0, x1, ...): a column for each of some variables."""
    if len(some) == 1:
        return long.where(F.col("var") == min(some)).select("series_id", "t", F.col("x").alias(f"x{min(some)}"))
    return long.where(F.col("var").isin(*some)).groupBy("series_id", "t").agg(*[F.max(F.when(F.col("var") == v, F.col("x"))).alias(f"x{v}") for v in sorted(some)])


def window_trace(long: DataFrame, phi: Formula) -> DataFrame:
    """(series_id, t, rho) of a formula over a long panel (series_id, var, t, x). Spark holds a series' rows one after another."""
    w = Window.partitionBy("series_id").orderBy("t")

    def over(pick, name: str, lo: int, hi: int) -> Column:
        return pick(name).over(w.rangeBetween(lo, hi))

    def stage(f: Formula, parts: list[str]) -> Column:
        match f:
            case Atom(v, c, lte):
                return F.lit(c) - F.col(f"x{v}") if lte else F.col(f"x{v}") - F.lit(c)
            case Not():
                return -F.col(parts[0])
            case And() | Or():
                return (F.least if isinstance(f, And) else F.greatest)(*parts)
            case Globally(_, lo, hi):
                return over(F.min, parts[0], lo, hi)
            case Eventually(_, lo, hi):
                return over(F.max, parts[0], lo, hi)
            case Until(_, _, lo, hi):
                at = [(over(F.max, parts[1], k, k), over(F.min, parts[0], 0, k - 1) if k else None) for k in range(lo, hi + 1)]
                each = [right if before is None else F.when(right.isNotNull(), F.least(right, before)) for right, before in at]
                return F.greatest(*each) if len(each) > 1 else each[0]
        raise TypeError(f"not a formula: {f!r}")

    rows = wide(long, variables(phi))
    for name, f, parts in _stages(phi):
        rows = rows.withColumn(name, stage(f, parts))
    return rows.select("series_id", "t", F.col(name).alias("rho"))


def trace_sql(phi: Formula, table: str) -> str:
    """The same as SQL text over a table of the long panel."""
    over = lambda pick, name, lo, hi: f"{pick}({name}) over (partition by series_id order by t range between {lo} following and {hi} following)"

    def stage(f: Formula, parts: list[str]) -> str:
        match f:
            case Atom(v, c, lte):
                return f"{c!r}::double - x{v}" if lte else f"x{v} - {c!r}::double"
            case Not():
                return f"-{parts[0]}"
            case And() | Or():
                return f"{'least' if isinstance(f, And) else 'greatest'}({', '.join(parts)})"
            case Globally(_, lo, hi) | Eventually(_, lo, hi):
                return over("min" if isinstance(f, Globally) else "max", parts[0], lo, hi)
            case Until(_, _, lo, hi):
                at = [(over("max", parts[1], k, k), over("min", parts[0], 0, k - 1) if k else None) for k in range(lo, hi + 1)]
                return "greatest(" + ", ".join(r if b is None else f"case when {r} is not null then least({r}, {b}) end" for r, b in at) + ")"
        raise TypeError(f"not a formula: {f!r}")

    some = sorted(variables(phi))
    text = f"select series_id, t, {', '.join(f'max(x) filter (var = {v}) as x{v}' for v in some)} from {table} where var in ({', '.join(map(str, some))}) group by series_id, t"
    for name, f, parts in _stages(phi):
        text = f"select *, {stage(f, parts)} as {name} from ({text})"
    return f"select series_id, t, {name} as rho from ({text})"


def _blocks(batches, width: int):
    """Sorted rows (series_id, block, var, t, x) in runs of whole blocks: (series_id, block, row's group, var, step in block, x)."""
    held: pa.Table | None = None

    def told(table: pa.Table):
        series, block, var, t, x = (c.to_numpy() for c in table.columns)
        new = np.concatenate([[True], (series[1:] != series[:-1]) | (block[1:] != block[:-1])])
        group = np.cumsum(new) - 1
        return series[new], block[new], group, var, t - block * width, x

    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([b])
        table = table if held is None else pa.concat_tables([held, table])
        series, block = table.column(0).to_numpy(), table.column(1).to_numpy()
        last = int(np.argmax((series == series[-1]) & (block == block[-1])))
        held = table.slice(last)
        if last:
            yield told(table.slice(0, last))
    if held is not None:
        yield told(held)


def block_traces(long: DataFrame, formulas: list[Formula], block: int = BLOCK, first_only: bool = False) -> DataFrame:
    """(series_id, t, rhos): robustness of each formula at each step of a long panel (series_id, var, t, x), steps from 0 on.

    Each value is sent to its own block and to the blocks before it whose horizon reaches it: 1 + horizon /
    block at most. A group is a block's values, never a series. With first_only, at step 0
    alone: no step after the horizon is read.
    """
    ship(long.sparkSession)
    some = sorted(set().union(*map(variables, formulas)))
    ahead = max(map(horizon, formulas))
    count = len(formulas)
    rows = long.where(F.col("var").isin(*some)).select(F.col("series_id").cast("long").alias("series_id"), F.col("var").cast("int").alias("var"), F.col("t").cast("long").alias("t"), F.col("x").cast("double").alias("x"))
    if first_only:
        block = 1
        dealt = rows.where(F.col("t") <= ahead).withColumn("block", F.lit(0).cast("long"))
    else:
        back = F.greatest(F.floor((F.col("t") - ahead) / block), F.lit(0).cast("long"))
        dealt = rows.withColumn("block", F.explode(F.sequence(back, F.floor(F.col("t") / block))))
    dealt = dealt.select("series_id", "block", "var", "t", "x").repartition("series_id", "block").sortWithinPartitions("series_id", "block", "var", "t")

    def evaluate(batches):
        for series, number, group, var, step, x in _blocks(batches, block):
            edges = np.searchsorted(group, np.arange(len(series) + 1))
            share = max(1, SIDE_BY_SIDE // ((max(some) + 1) * (block + ahead)))
            for lo in range(0, len(series), share):
                hi = min(len(series), lo + share)
                rows = slice(edges[lo], edges[hi])
                steps = min(block, int(step[rows].max()) + 1)
                graph = Graph(formulas, steps)
                panel = np.full((max(some) + 1, steps + ahead, hi - lo), np.nan)
                panel[var[rows], step[rows], group[rows] - lo] = x[rows]
                there = ~np.isnan(panel[:, :steps]).all(axis=0)
                who, t = np.nonzero(there.T)
                rho = np.empty((len(who), count))
                for place, own in graph.values(panel, absent=True):
                    rho[:, place] = own[t, who]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(who) + 1, dtype=np.int32) * count), pa.array(rho.ravel(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([pa.array(series[lo:hi][who]), pa.array(t + number[lo:hi][who] * block), lists], names=["series_id", "t", "rhos"])

    return dealt.mapInArrow(evaluate, "series_id long, t long, rhos array<double>")
