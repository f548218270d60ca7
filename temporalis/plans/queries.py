"""Queries over the driver's tables, one a group of operators, each with its SQL form.

The fixed bank and the fixed weights stand in for a sampled bank and a trained model, so
that both engines can compute every step that follows them. Queries named ``_whole`` take
every round, pair or formula, as the operators do.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.formula import And, Atom, Eventually, Globally, Not, Or, Sampler, Until, depth, horizon, variables
from ..functions.robustness import column, features, long_features, register_robustness, sql
from ..functions.traces import block_traces, trace_sql, window_trace
from ..operators import analytics, bank, classify, explain, path, scale
from ..session import cut, r6, shared_dir
from ..sources import archives, panels, results, sinks
from . import experiment

STEPS = 64
BANK = [
    Globally(Atom(0, -0.25), 0, 15),
    Eventually(Atom(0, 0.2), 0, 31),
    Globally(Eventually(Atom(0, 0.05), 0, 6), 4, 12),
    Eventually(Globally(Atom(0, 0.1, True), 0, 3), 8, 40),
    And(Eventually(Atom(0, 0.15), 0, 20), Eventually(Atom(0, -0.15, True), 20, 40)),
    Or(Globally(Atom(0, 0.2, True), 0, 4), Eventually(Atom(0, 0.25), 50, 63)),
    Not(Eventually(Atom(0, 0.22), 10, 30)),
    Until(Atom(0, -0.2), Atom(0, 0.18), 2, 20),
    Not(Not(Eventually(Atom(0, 0.21), 0, 31))),
]
ONE = {
    "atom_ge": Atom(0, 0.1), "atom_le": Atom(0, 0.1, True), "stl_not": BANK[6], "stl_and": BANK[4], "stl_or": BANK[5], "stl_globally": BANK[0], "stl_eventually": BANK[1], "stl_until": BANK[7], "stl_nested_gf": BANK[2], "stl_nested_fg": BANK[3],
}
MULTI = And(Globally(Or(Atom(0, 40.0, True), Atom(1, 1.0)), 0, 20), Eventually(And(Atom(2, 5.0), Not(Atom(3, 30.0))), 3, 28))
#: Formulas over the daily events, some of whose windows pass the end of a series.
EVENT_BANK = [MULTI, Until(Atom(0, 60.0, True), And(Atom(1, 2.0), Not(Atom(4, 30.0))), 2, 11), Not(Until(Not(Atom(2, 1.0)), Atom(3, 20.0), 0, 25)), Eventually(Globally(Or(Atom(2, 3.0), Atom(0, 1.0, True)), 1, 4), 0, 40)]
#: Formulas drawn as a bank draws them.
SAMPLED = 100
#: Numbers of formulas and depths of the runs, and how far each run shrinks its class means.
SETTINGS = [(5, 2), (5, 3), (9, 3)]
SHRINKS = [0.0, 0.008, 0.016]
TOP, POOL, LIMIT, CORR = 3, 4, 0.75, 0.9

# Text shared by the SQL forms: each entry is one common table.
_M = "as materialized"
TABLES = {
    "emb": f"emb {_M} (select vec_id as series_id, label::varchar as label, case when vec_id % 3 < 2 then 'TRAIN' else 'TEST' end as split, [list_transform(embedding, lambda v: v::double)] as vars from embeddings)",
    "embl": f"embl {_M} (select series_id, label, split, 0 as var, t::int as t, vars[1][t + 1] as x from emb, (select unnest(range(0, {STEPS})) as t))",
    "evtc": f"evtc {_M} (select user_id, event_type, ts::date as dt, sum(value) as x, count(*) as n from events group by all)",
    "evtl": f"""evtl {_M} (
      with lab as (select user_id, event_type as label from (select user_id, event_type, row_number() over (partition by user_id order by sum(n) desc, event_type) as k from evtc group by user_id, event_type) where k = 1),
      kinds as (select event_type, (row_number() over (order by event_type) - 1)::int as var from (select distinct event_type from evtc)),
      days as (select a + i::int as dt, i::int as t from (select min(dt) as a, max(dt) as z from evtc), unnest(range(0, (z - a) + 1)) as u(i))
      select l.user_id as series_id, l.label, case when l.user_id % 3 < 2 then 'TRAIN' else 'TEST' end as split, k.var, d.t, coalesce(c.x, 0.0) as x
      from lab l cross join kinds k cross join days d left join evtc c on c.user_id = l.user_id and c.event_type = k.event_type and c.dt = d.dt)""",
    "cust": f"""cust {_M} (
      with dated as (select o_custkey, year(o_orderdate) * 4 + quarter(o_orderdate) as q, o_totalprice from orders where o_orderdate is not null),
      span as (select min(q) as a, max(q) as z from dated),
      cells as (select o_custkey, (q - a)::int as t, count(*)::double as n, sum(o_totalprice) as price from dated, span group by all),
      grid as (select c_custkey, c_mktsegment, t::int as t from customer, (select unnest(range(0, z - a + 1)) as t from span))
      select c_custkey as series_id, c_mktsegment as label, case when c_custkey % 3 < 2 then 'TRAIN' else 'TEST' end as split, var, g.t, case when var = 0 then coalesce(n, 0.0) else coalesce(price, 0.0) end as x
      from grid g left join cells c on c.o_custkey = g.c_custkey and c.t = g.t cross join (values (0), (1)) as v(var))""",
    "stats": f"stats {_M} (select var, avg(x) as mean, stddev_pop(x) as std from evtl where split = 'TRAIN' group by var)",
    "feat": f"feat {_M} (select series_id, label, split, unnest(range(0, {len(BANK)}))::int as formula_id, unnest([{', '.join(sql(p) for p in BANK)}]) as rho from emb)",
    "deltas": f"deltas {_M} (select formula_id, -avg(rho) as delta from feat where split = 'TRAIN' group by formula_id)",
    "corr": f"""corr {_M} (
      select k, i, (xy - mx * my) / case when sx > 1e-12 and sy > 1e-12 then sx * sy end as r from (
        select a.formula_id as k, b.formula_id as i, avg(a.rho * b.rho) as xy, avg(a.rho) as mx, avg(b.rho) as my, stddev_pop(a.rho) as sx, stddev_pop(b.rho) as sy
        from feat a join feat b on a.series_id = b.series_id and a.formula_id < b.formula_id where a.split = 'TRAIN' group by all))""",
    "coef": f"coef {_M} (select c::int as class_idx, f::int as formula_id, ((c * 7 + f * 3) % 5 - 2) / 4.0::double as w from unnest(range(0, 10)) as a(c), unnest(range(0, {len(BANK)})) as b(f))",
    "score": f"score {_M} (select series_id, class_idx, sum(w * rho) as score from feat join coef using (formula_id) where split = 'TEST' group by all)",
    "pred": f"pred {_M} (select series_id, class_idx, class_idx::varchar as pred from (select *, row_number() over (partition by series_id order by round(score, 9) desc, class_idx) as k from score) where k = 1)",
    "judged": f"judged {_M} (select e.series_id, e.label, p.pred from emb e join pred p using (series_id))",
    "conf": f"conf {_M} (select label, pred, count(*) as n from judged group by all)",
    "report": f"""report {_M} (
      select label, coalesce(tp / nullif(positives, 0), 0.0) as precision, coalesce(tp / nullif(support, 0), 0.0) as recall, coalesce(2 * tp / nullif(positives + support, 0), 0.0) as f1, support::bigint as support from (
        select label, coalesce(sum(n) filter (side = 't'), 0)::double as support, coalesce(sum(n) filter (side = 't' and label = other), 0)::double as tp, coalesce(sum(n) filter (side = 'p'), 0)::double as positives
        from (select label, pred as other, n, 't' as side from conf union all select pred, label, n, 'p' from conf) group by label))""",
    "contrib": f"contrib {_M} (select f.series_id, b.class_idx as competitor, f.formula_id, (a.w - b.w) * f.rho as c from feat f join pred p using (series_id) join coef a on a.class_idx = p.class_idx and a.formula_id = f.formula_id join coef b on b.formula_id = f.formula_id and b.class_idx <> p.class_idx)",
    "topm": f"topm {_M} (select * from (select series_id, formula_id, total, row_number() over (partition by series_id order by round(total, 9) desc, formula_id)::int as rank from (select series_id, formula_id, sum(c) as total from contrib group by all)) where rank <= {POOL})",
    "med": f"med {_M} (select formula_id, label, median(rho) as med from feat where split = 'TRAIN' group by all)",
    "refs": f"""refs {_M} (
      with p as (select t.formula_id, t.label as target, t.med as mt, o.label as other, o.med as mo,
          count(*) filter (o.med < t.med) over w as nb, count(*) filter (o.med > t.med) over w as na
        from med t join med o on t.formula_id = o.formula_id and t.label <> o.label window w as (partition by t.formula_id, t.label)),
      k as (select *, case when nb = 0 and na = 0 then null when nb = 0 then case when mo > mt then mo end when na = 0 then case when mo < mt then -mo end
          when na = nb then -abs(mo - mt) when nb > na then case when mo < mt then -mo end else case when mo > mt then mo end end as key from p),
      f as (select *, row_number() over (partition by formula_id, target order by key asc nulls last, other) as nth from k)
      select formula_id, target, mt as med_t, case when key is null then target else other end as reference, case when key is null then mt else mo end as med_r from f where nth = 1)""",
    "rep": f"rep {_M} (select formula_id, target, reference, case when med_t < med_r then -1 else 1 end as sign, -(case when med_t < med_r then -1 else 1 end) * (med_t + med_r) / 2 as delta from refs)",
    "moved": f"moved {_M} (select f.series_id, f.label, f.split, f.formula_id, r.target, r.sign * f.rho + r.delta as rho from feat f join rep r using (formula_id))",
    "pool": f"pool {_M} (select t.series_id, p.pred as target, t.formula_id, t.rank from topm t join pred p using (series_id))",
    "greedy1": f"""greedy1 {_M} (
      select series_id, target, formula_id, prec, n_tp from (
        select q.series_id, q.target, q.formula_id, coalesce(m.tp / nullif(m.pos, 0), 0.0) as prec, m.tp as n_tp, row_number() over (partition by q.series_id order by coalesce(m.tp / nullif(m.pos, 0), 0.0) desc, q.rank) as k
        from pool q join (select formula_id, target, count(*) filter (rho > 0)::double as pos, count(*) filter (rho > 0 and label = target)::bigint as tp from moved where split = 'TRAIN' group by all) m using (formula_id, target)) where k = 1)""",
    "box": f"box {_M} (select formula_id, quantile_cont(rho, 0.1) as vmin, quantile_cont(rho, 0.9) as vmax from feat where split = 'TRAIN' group by formula_id)",
    "locals": f"locals {_M} (select target, formula_id, min(series_id) as first_id from greedy1 group by all)",
    "gvals": f"gvals {_M} (select l.target, m.series_id, m.label, max(m.rho) as rho from locals l join moved m using (formula_id, target) where m.split = 'TEST' group by all)",
    "quality": f"""quality {_M} (select *, 2 * precision * coverage / nullif(precision + coverage, 0) as f1 from (
      select *, tp / nullif(n_pos::double, 0) as precision, tp / nullif(n_class::double, 0) as coverage from (
        select target, count(*) filter (rho > 0) as n_pos, count(*) filter (rho > 0 and label = target) as tp, count(*) filter (label = target) as n_class from gvals group by target)))""",
    "means": f"means {_M} (select label, formula_id, round(avg(rho) - any_value(m), 9) as d from feat join (select formula_id, avg(rho) as m from feat where split = 'TRAIN' group by formula_id) using (formula_id) where split = 'TRAIN' group by label, formula_id)",
    "shrunk": f"shrunk {_M} (select (dense_rank() over (order by label) - 1)::int as class_idx, formula_id, sign(d) * greatest(abs(d) - {SHRINKS[-1]}::double, 0.0) as w from means)",
    "judgedr": f"""judgedr {_M} (
      with settings(n_formulas, depth_max, ids) as (values {', '.join(f'({n}, {d}, {[j for j, p in enumerate(BANK) if depth(p) <= d][:n]})' for n, d in SETTINGS)}),
      shrinks(run, shrink) as (values {', '.join(f'({i}, {x}::double)' for i, x in enumerate(SHRINKS))}),
      s as (select n_formulas, depth_max, run, series_id, f.label, m.label as pred, sum(sign(d) * greatest(abs(d) - shrink, 0.0) * rho) as score
        from feat f join means m using (formula_id) join settings on list_contains(ids, formula_id) cross join shrinks where f.split = 'TEST' group by all)
      select n_formulas, depth_max, run, label, pred from s qualify row_number() over (partition by n_formulas, depth_max, run, series_id order by round(score, 9) desc, pred) = 1)""",
    "reportr": f"""reportr {_M} (
      select n_formulas, depth_max, run, label, coalesce(tp / nullif(positives, 0), 0.0) as precision, coalesce(tp / nullif(support, 0), 0.0) as recall, coalesce(2 * tp / nullif(positives + support, 0), 0.0) as f1, support from (
        select n_formulas, depth_max, run, label, count(*) filter (side = 't')::double as support, count(*) filter (side = 't' and label = other)::double as tp, count(*) filter (side = 'p')::double as positives
        from (select n_formulas, depth_max, run, label, pred as other, 't' as side from judgedr union all select n_formulas, depth_max, run, pred, label, 'p' from judgedr) group by all))""",
    "runs": f"""runs {_M} (
      select 'embeddings' as dataset, * from (select n_formulas, depth_max, run, avg(recall) filter (support > 0) as balanced_accuracy, avg(f1) as macro_f1 from reportr group by all)
      join (select n_formulas, depth_max, run, avg((label = pred)::int) as accuracy from judgedr group by all) using (n_formulas, depth_max, run))""",
}


def _greedy_tables(rounds: int) -> str:
    """Common tables of the greedy picks, a group a round: trials c, best b, held series h, and state g. Returns their names."""
    TABLES["g0"] = f"g0 {_M} (select distinct series_id, target, []::int[] as picks, -1.0::double as prec, 0::bigint as n_tp from pool)"
    TABLES["h0"] = f"h0 {_M} (select g.series_id, e.series_id as s from g0 g, emb e where e.split = 'TRAIN')"
    names = ["g0", "h0"]
    for r in range(1, rounds + 1):
        TABLES[f"c{r}"] = f"""c{r} {_M} (
      select g.series_id, g.target, g.picks, p.formula_id, p.rank, count(*) filter (m.rho > 0 and h.s is not null)::double as pos, count(*) filter (m.rho > 0 and h.s is not null and m.label = g.target)::bigint as tp
      from g{r - 1} g join pool p using (series_id) join moved m on m.formula_id = p.formula_id and m.target = g.target and m.split = 'TRAIN' left join h{r - 1} h on h.series_id = g.series_id and h.s = m.series_id
      where g.prec < {LIMIT} and not list_contains(g.picks, p.formula_id) group by all)"""
        TABLES[f"b{r}"] = f"b{r} {_M} (select series_id, target, picks, formula_id, coalesce(tp / nullif(pos, 0), 0.0) as prec, tp from c{r} qualify row_number() over (partition by series_id order by coalesce(tp / nullif(pos, 0), 0.0) desc, rank) = 1)"
        TABLES[f"g{r}"] = f"g{r} {_M} (select series_id, target, list_append(picks, formula_id) as picks, prec, tp as n_tp from b{r} union all select * from g{r - 1} where series_id not in (select series_id from b{r}))"
        TABLES[f"h{r}"] = f"h{r} {_M} (select b.series_id, h.s from b{r} b join h{r - 1} h using (series_id) join moved m on m.series_id = h.s and m.formula_id = b.formula_id and m.target = b.target where m.rho > 0)"
        names += [f"c{r}", f"b{r}", f"g{r}", f"h{r}"]
    TABLES["wlocals"] = f"wlocals {_M} (select target, list_sort(picks) as picks, min(series_id) as first_id from g{rounds} group by all)"
    TABLES["wvals"] = f"""wvals {_M} (select target, series_id, label, max(rho) as rho from (
      select l.target, l.first_id, m.series_id, m.label, min(m.rho) as rho from (select target, first_id, unnest(picks) as formula_id from wlocals) l join moved m using (formula_id, target) where m.split = 'TEST' group by all) group by target, series_id, label)"""
    TABLES["wquality"] = TABLES["quality"].replace("quality as", "wquality as").replace("from gvals", "from wvals")
    return " ".join(names)


_GREEDY = _greedy_tables(POOL)


def _sql(tables: str, select: str) -> str:
    return "with " + ",\n".join(TABLES[t] for t in tables.split()) + "\n" + select


def _r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def _unlike(text: str) -> str:
    """The SQL form with the weights of ``Frames.with_unlike_classes``."""
    return text.replace(TABLES["coef"], TABLES["coef"].replace("/ 4.0::double as w", "/ 4.0::double + ((c * 3 + f * 5) % 7 - 3) / 40.0::double as w"))


class Frames:
    """The DataFrames that the queries share, by the names of the SQL tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.unlike = False
        self._kept: dict[str, DataFrame] = {}

    def _keep(self, *names: str) -> None:
        """Cut what a query goes over again and again; from then on the methods of these names return it."""
        for name in names:
            if name not in self._kept:
                self._kept[name] = cut(getattr(self, name)())

    def emb(self):
        return panels.packed_embeddings(self.spark, self.dir)

    def feat(self):
        return long_features(self.packed())

    def coef(self):
        rows = self.spark.range(10).select(F.col("id").cast("int").alias("class_idx"), F.explode(F.sequence(F.lit(0), F.lit(len(BANK) - 1))).alias("formula_id"))
        w = ((F.col("class_idx") * 7 + F.col("formula_id") * 3) % 5 - 2) / F.lit(4.0)
        return rows.withColumn("w", w + ((F.col("class_idx") * 3 + F.col("formula_id") * 5) % 7 - 3) / F.lit(40.0) if self.unlike else w)

    def with_unlike_classes(self) -> Frames:
        """The same with weights under which no two classes tie (those of coef repeat after five classes)."""
        other = Frames(self.spark, self.dir)
        other.unlike = True
        return other

    def scored(self):
        return self._kept.get("scored") or classify.scored(self.packed().where("split = 'TEST'"), self.coef())

    def score(self):
        return classify.scores(self.scored())

    def pred(self):
        return self.scored().select("series_id", "class_idx", F.col("class_idx").cast("string").alias("pred"))

    def judged(self):
        return self.scored().select("series_id", "label", F.col("class_idx").cast("string").alias("pred"))

    def contrib(self):
        return explain.contributions(self.scored(), self.coef())

    def top_m(self, m: int):
        return explain.top_m(self.scored(), self.coef(), m)

    def top_m_each(self):
        return explain.top_m_each(self.scored(), self.coef(), TOP)

    def rep(self):
        return self._kept.get("rep") or explain.reparametrised(explain.reference_classes(explain.class_medians(self.feat())))

    def pool(self):
        return self.top_m(POOL).join(self.pred().select("series_id", F.col("pred").alias("target")), "series_id").select("series_id", "target", "formula_id", "rank")

    def packed(self):
        return self._kept.get("packed") or features(self.emb(), BANK, STEPS)

    def words(self, split: str):
        if split not in self._kept:
            self._kept[split] = cut(explain.block_words(self.packed(), self.rep(), split))
        return self._kept[split]

    def greedy(self, rounds: int):
        self._keep("packed", "scored", "rep")
        return explain.greedy_picks(self.pool(), self.words("TRAIN"), rounds, LIMIT)

    def first_picks(self):
        return self.greedy(1).select("series_id", "target", F.get("picks", F.lit(0)).alias("formula_id"), "precision", "n_tp")

    def locals(self):
        return self.first_picks().groupBy("target", "formula_id").agg(F.min("series_id").alias("first_id"))

    def glob(self):
        picks = self.locals().select("target", F.col("first_id").alias("pick_id"), "formula_id")
        return explain.global_quality(self.words("TEST"), picks)

    def whole_locals(self):
        return explain.distinct_locals(self.greedy(POOL))

    def run_directories(self, explained: bool = False):
        """(runs, locals, globals) read back from directories of runs over the panel that are written first; one has no metrics."""
        root, write = f"{shared_dir(self.spark)}/runs-{uuid.uuid4().hex}", sinks.shared_writer(self.spark)
        configs = [experiment.Config(dataset="embeddings", n_formulas=n, depth_max=d, n_run=len(SHRINKS)) for n, d in SETTINGS]
        for config, runs in zip(configs, experiment.grid_runs(self.packed(), BANK, configs, SHRINKS), strict=True):
            out = f"{root}/embeddings_{config.n_formulas}_{config.depth_max}"
            sinks.save_config(config, out, write)
            sinks.save_accuracy(runs, out, write)
        sinks.save_config(configs[0], f"{root}/unfinished", write)
        if explained:
            local, disjuncts, kinds = experiment.explanations(cut(self.greedy(POOL)), BANK, self.rep(), self.words("TEST"))
            sinks.save_locals(local, out)
            sinks.save_globals(disjuncts, kinds, out)
        return results.load_results(self.spark, root)

    def whole_glob(self):
        picks = self.whole_locals().select("target", F.col("first_id").alias("pick_id"), F.explode("picks").alias("formula_id"))
        return explain.global_quality(self.words("TEST"), picks)

    def events(self):
        return panels.daily_events(self.spark, self.dir)

    def runs(self):
        return self.run_directories()[0]

    def shrunken(self):
        """Weights of class means, drawn towards that of all until some are zero."""
        return classify.shrunken(classify.class_means(self.feat()), SHRINKS[-1])


Query = tuple[Callable[[Frames], DataFrame], str | None]


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in columns})


def _all() -> dict[str, Query]:
    q: dict[str, Query] = {}

    def add(name: str, build: Callable[[Frames], DataFrame], text: str | None) -> None:
        q[name] = (build, text)

    # sources and scaling
    add("scan_panel", lambda f: _rounded(panels.embeddings(f.spark, f.dir), "x"), _sql("emb embl", f"select series_id, label, split, var, t, {_r('x')} as x from embl"))
    add("scan_events_panel", lambda f: _rounded(f.events(), "x"), _sql("evtc evtl", f"select series_id, label, split, var, t, {_r('x')} as x from evtl"))
    add("scan_orders_panel", lambda f: f.spark and panels.quarterly_orders(f.spark, f.dir).withColumn("x", F.round("x", 2) + F.lit(0.0)), _sql("cust", "select series_id, label, split, var, t, round(x, 2) + 0.0 as x from cust"))
    add("pack_unpack", lambda f: _rounded(panels.unpacked(panels.packed(f.events())), "x"), _sql("evtc evtl", f"select series_id, label, split, var, t, {_r('x')} as x from evtl"))

    def archived(f: Frames) -> DataFrame:
        """The events panel, written in the text layout and read back."""
        path = f"{shared_dir(f.spark)}/archive-{uuid.uuid4().hex}"
        archives.write_archive(panels.packed(f.events()), path, "events")
        return _rounded(panels.unpacked(archives.read_archive(f.spark, f"{path}/*")).drop("series_id"), "x")

    add("archive_round_trip", archived, _sql("evtc evtl", f"select label, split, var, t, {_r('x')} as x from evtl"))
    add("scale_stats", lambda f: _rounded(scale.fit(f.events()), "mean", "std"), _sql("evtc evtl stats", f"select var, {_r('mean')} as mean, {_r('std')} as std from stats"))
    add("scale_stats_sample", lambda f: _rounded(scale.fit(f.events(), sample=True), "mean", "std"), _sql("evtc evtl", f"select var, {_r('avg(x)')} as mean, {_r('stddev_samp(x)')} as std from evtl where split = 'TRAIN' group by var"))
    add("scale_apply", lambda f: _rounded(scale.transform(f.events(), scale.fit(f.events())), "x").select("series_id", "label", "split", "var", "t", "x"), _sql("evtc evtl stats", f"select series_id, label, split, var, t, {_r('(x - mean) / (std + 1e-8)')} as x from evtl join stats using (var)"))
    add("var_bounds", lambda f: _rounded(scale.bounds(f.events()), "low", "high"), _sql("evtc evtl", f"select var, {_r('min(x)')} as low, {_r('max(x)')} as high from evtl where split = 'TRAIN' group by var"))
    # formulas
    for name, phi in ONE.items():
        add(name, lambda f, phi=phi: f.emb().select("series_id", r6(column(phi, F.col("vars"))).alias("rho")), _sql("emb", f"select series_id, {_r(sql(phi))} as rho from emb"))
    packed = "(select series_id, list(xs order by var) as vars from (select series_id, var, list(x order by t) as xs from evtl group by all) group by series_id)"
    add("stl_multivar", lambda f: panels.packed(f.events()).select("series_id", r6(column(MULTI, F.col("vars"))).alias("rho")), _sql("evtc evtl", f"select series_id, {_r(sql(MULTI))} as rho from {packed}"))
    add("stl_trace", lambda f: _rounded(window_trace(panels.embeddings(f.spark, f.dir), Globally(Atom(0, 0.05), 2, 9)), "rho"), _sql("emb embl", f"select series_id, t, {_r('min(x - 0.05) over (partition by series_id order by t rows between 2 following and 9 following)')} as rho from embl"))
    pct = lambda c: F.percentile("rho", c)
    add("stl_trace_quantiles", lambda f: window_trace(panels.embeddings(f.spark, f.dir), Eventually(Atom(0, 0.05), 0, 5)).groupBy("series_id").agg(r6(pct(0.25)).alias("q25"), r6(pct(0.5)).alias("q50"), r6(pct(0.75)).alias("q75")), _sql("emb embl", f"select series_id, {', '.join(_r(f'quantile_cont(rho, {p})') + f' as q{int(100 * p)}' for p in (0.25, 0.5, 0.75))} from (select series_id, max(x - 0.05) over (partition by series_id order by t rows between current row and 5 following) as rho from embl) group by series_id"))
    for name, phi, table in (("stl_trace_nested", And(BANK[2], Not(BANK[3])), "emb embl"), ("stl_trace_until", BANK[7], "emb embl"), ("stl_trace_multivar", Not(EVENT_BANK[1]), "evtc evtl")):
        add(name, lambda f, phi=phi, table=table: _rounded(window_trace(panels.embeddings(f.spark, f.dir) if table == "emb embl" else f.events(), phi), "rho"), _sql(table, f"select series_id, t, {_r('rho')} as rho from ({trace_sql(phi, table.split()[1])})"))
    blocks = lambda f, **how: block_traces(f.events(), EVENT_BANK, **how).select("series_id", "t", F.posexplode("rhos").alias("formula_id", "rho"))
    by_sql = " union all ".join(f"select series_id, t, {j} as formula_id, rho from ({trace_sql(p, 'evtl')})" for j, p in enumerate(EVENT_BANK))
    add("stl_trace_blocks", lambda f: _rounded(blocks(f, block=7), "rho"), _sql("evtc evtl", f"select series_id, t::bigint as t, formula_id, {_r('rho')} as rho from ({by_sql})"))
    add("feature_matrix_blocks", lambda f: _rounded(blocks(f, first_only=True).drop("t"), "rho"), _sql("evtc evtl", f"select series_id, formula_id, {_r('rho')} as rho from ({by_sql}) where t = 0"))
    add("horizon_pruned", lambda f: panels.embeddings(f.spark, f.dir).where(F.col("t") <= horizon(BANK[0])).groupBy("series_id").agg(r6(F.min(F.col("x") + 0.25)).alias("rho")), _sql("emb embl", f"select series_id, {_r('min(x + 0.25)')} as rho from embl where t <= {horizon(BANK[0])} group by series_id"))
    add("feature_matrix_long", lambda f: _rounded(long_features(features(f.emb(), BANK, STEPS, vectorised=False)), "rho"), _sql("emb feat", f"select series_id, label, split, formula_id, {_r('rho')} as rho from feat"))
    add("feature_matrix_vectorised", lambda f: _rounded(long_features(features(f.emb(), BANK, STEPS, vectorised=True)), "rho"), _sql("emb feat", f"select series_id, label, split, formula_id, {_r('rho')} as rho from feat"))

    def by_text(f: Frames) -> DataFrame:
        """Each series under each formula of a table of texts, in SQL."""
        register_robustness(f.spark)
        texts = f.spark.createDataFrame([(j, str(p)) for j, p in enumerate(BANK)], "formula_id int, formula string")
        return f.spark.sql("select series_id, formula_id, formula, robustness(vars, formula) as rho from {emb}, {texts}", emb=f.emb(), texts=F.broadcast(texts))

    said_bank = "[" + ", ".join(f"'{p}'" for p in BANK) + "]"
    add("robustness_sql", lambda f: _rounded(by_text(f), "rho"), _sql("emb feat", f"select series_id, formula_id, {said_bank}[formula_id + 1] as formula, {_r('rho')} as rho from feat"))
    drawn = Sampler([-0.3], [0.3], STEPS - 1, 3, 17, until_weight=1.0).sample(SAMPLED)
    add("feature_matrix_sampled", lambda f: _rounded(long_features(features(f.emb(), drawn, STEPS)).select("series_id", "formula_id", "rho"), "rho"), _sql("emb", f"select series_id, unnest(range(0, {SAMPLED}))::int as formula_id, {_r('unnest([' + ', '.join(sql(p) for p in drawn) + '])')} as rho from emb"))
    add("feature_matrix_wide", lambda f: features(f.emb(), BANK, STEPS, vectorised=False).select("series_id", *[r6(F.get("feats", F.lit(j))).alias(f"f{j}") for j in range(len(BANK))]), _sql("emb", "select series_id, " + ", ".join(f"{_r(sql(p))} as f{j}" for j, p in enumerate(BANK)) + " from emb"))
    # bank
    add("center_features", lambda f: _rounded(bank.centred(f.feat()).select("series_id", "split", "formula_id", "rho"), "rho"), _sql("emb feat deltas", f"select series_id, split, formula_id, {_r('rho + delta')} as rho from feat join deltas using (formula_id)"))
    add("corr_pairs", lambda f: _rounded(bank.correlations(f.packed(), len(BANK)), "r"), _sql("emb feat corr", f"select k, i, {_r('r')} as r from corr"))
    ids = lambda f: f.spark.range(len(BANK)).select(F.col("id").cast("int").alias("formula_id"))
    gone = f"formula_id not in (select i from corr where abs(r) > {CORR})"
    add("corr_prune_anti", lambda f: bank.kept(ids(f), bank.correlations(f.packed(), len(BANK)), CORR), _sql("emb feat corr", f"select formula_id from (select unnest(range(0, {len(BANK)}))::int as formula_id) where {gone}"))
    add("bank_trim", lambda f: bank.kept(ids(f), bank.correlations(f.packed(), len(BANK)), CORR).withColumn("ord", F.row_number().over(Window.orderBy("formula_id")) - 1).where("ord < 5"), _sql("emb feat corr", f"select formula_id, ord from (select formula_id, (row_number() over (order by formula_id) - 1)::int as ord from (select unnest(range(0, {len(BANK)}))::int as formula_id) where {gone}) where ord < 5"))
    # classifier and metrics
    add("class_weights", lambda f: _rounded(classify.class_weights(f.emb().where("split = 'TRAIN'")), "weight"), _sql("emb", f"select label, count(*) as n, {_r('sum(count(*)) over () / (count(*) over () * count(*))')} as weight from emb where split = 'TRAIN' group by label"))
    add("decision_scores", lambda f: _rounded(f.score(), "score"), _sql("emb feat coef score", f"select series_id, class_idx, {_r('score')} as score from score"))
    add("predict_argmax", lambda f: f.pred().select("series_id", "class_idx"), _sql("emb feat coef score pred", "select series_id, class_idx from pred"))
    fit = "emb feat means shrunk"
    two = lambda f: f.shrunken().where("class_idx = 3").select("formula_id", "w")  # noqa: E731  one class against all others
    add("binary_expand", lambda f: classify.binary_expanded(two(f)).select("class_idx", "formula_id", r6("w").alias("w")), _sql(fit, f"select 0 as class_idx, formula_id, {_r('-w')} as w from shrunk where class_idx = 3 union all select 1, formula_id, {_r('w')} from shrunk where class_idx = 3"))
    add("nonzero_features", lambda f: classify.nonzero_features(f.shrunken()), _sql(fit, "select formula_id from shrunk group by formula_id having max(abs(w)) > 0"))
    add("accuracy", lambda f: f.judged().agg(r6(F.avg((F.col("label") == F.col("pred")).cast("double"))).alias("accuracy")), _sql("emb feat coef score pred judged", f"select {_r('avg((label = pred)::int)')} as accuracy from judged"))
    add("balanced_accuracy", lambda f: _rounded(classify.balanced_accuracy(f.judged()), "balanced_accuracy"), _sql("emb feat coef score pred judged", f"select {_r('avg(r)')} as balanced_accuracy, count(*) as n_classes from (select label, avg((label = pred)::int) as r from judged group by label)"))
    add("confusion", lambda f: classify.confusion(f.judged()), _sql("emb feat coef score pred judged conf", "select * from conf"))
    add("class_report", lambda f: _rounded(classify.report(classify.confusion(f.judged())), "precision", "recall", "f1"), _sql("emb feat coef score pred judged conf report", f"select label, {_r('precision')} as precision, {_r('recall')} as recall, {_r('f1')} as f1, support from report"))
    add("macro_f1", lambda f: classify.report(classify.confusion(f.judged())).agg(r6(F.avg("f1")).alias("macro_f1")), _sql("emb feat coef score pred judged conf report", f"select {_r('avg(f1)')} as macro_f1 from report"))
    # local explanations
    base = "emb feat coef score pred contrib"
    add("contributions", lambda f: _rounded(f.contrib(), "c"), _sql(base, f"select series_id, competitor, formula_id, {_r('c')} as c from contrib"))
    add("topm_aggregate", lambda f: _rounded(f.top_m(POOL), "total"), _sql(base + " topm", f"select series_id, formula_id, {_r('total')} as total, rank from topm"))
    each = f"(select *, row_number() over (partition by series_id, competitor order by round(c, 9) desc, formula_id)::int as rank from contrib)"
    add("topm_per_competitor", lambda f: _rounded(f.top_m_each(), "c"), _sql(base, f"select series_id, competitor, formula_id, {_r('c')} as c, rank, case when c > 0 then 'supports' else 'threatens' end as role from {each} where rank <= {TOP}"))
    add("picks_union", lambda f: f.top_m_each().select("series_id", "formula_id").distinct(), _sql(base, f"select distinct series_id, formula_id from {each} where rank <= {TOP}"))
    add("class_medians", lambda f: _rounded(explain.class_medians(f.feat()), "med"), _sql("emb feat med", f"select formula_id, label, {_r('med')} as med from med"))
    add("reference_class", lambda f: _rounded(explain.reference_classes(explain.class_medians(f.feat())), "med_t", "med_r"), _sql("emb feat med refs", f"select formula_id, target, {_r('med_t')} as med_t, reference, {_r('med_r')} as med_r from refs"))
    add("reparam", lambda f: _rounded(f.rep(), "delta"), _sql("emb feat med refs rep", f"select formula_id, target, reference, sign, {_r('delta')} as delta from rep"))
    add("reparam_values", lambda f: f.feat().join(F.broadcast(f.rep()), "formula_id").select("series_id", "formula_id", "target", r6(explain.moved(F.col("rho"))).alias("rho")), _sql("emb feat med refs rep moved", f"select series_id, formula_id, target, {_r('rho')} as rho from moved"))
    more = base + " topm med refs rep moved pool greedy1"
    add("greedy_round1", lambda f: _rounded(f.first_picks(), "precision"), _sql(more, f"select series_id, target, formula_id, {_r('prec')} as precision, n_tp from greedy1"))
    whole = more.removesuffix(" greedy1") + " " + _GREEDY
    said = lambda: F.concat_ws(",", "picks").alias("picks")
    add("greedy_picks", lambda f: f.greedy(POOL).select("series_id", "target", said(), r6("precision").alias("precision"), "n_tp"), _sql(whole, f"select series_id, target, array_to_string(picks, ',') as picks, {_r('prec')} as precision, n_tp from g{POOL}"))
    add("local_quality", lambda f: f.first_picks().select("target", "formula_id", r6("precision").alias("precision"), "n_tp").distinct(), _sql(more, f"select distinct target, formula_id, {_r('prec')} as precision, n_tp from greedy1"))
    # global explanations
    add("distinct_locals", lambda f: f.locals(), _sql(more + " locals", "select target, formula_id, first_id from locals"))
    add("global_f1", lambda f: _rounded(f.glob(), "precision", "coverage", "f1"), _sql(more + " locals gvals quality", f"select target, n_pos, tp, n_class, {_r('precision')} as precision, {_r('coverage')} as coverage, {_r('f1')} as f1 from quality"))
    add("global_macro", lambda f: _rounded(explain.macro(f.glob()), "macro_f1"), _sql(more + " locals gvals quality", f"select {_r('avg(f1)')} as macro_f1, count(f1) as n_defined from quality"))
    add("local_quality_whole", lambda f: f.greedy(POOL).select("target", F.array_sort("picks").alias("picks"), r6("precision").alias("precision"), "n_tp").distinct().select("target", said(), "precision", "n_tp"), _sql(whole, f"select distinct target, array_to_string(list_sort(picks), ',') as picks, {_r('prec')} as precision, n_tp from g{POOL}"))
    add("distinct_locals_whole", lambda f: f.whole_locals().select("target", said(), "first_id"), _sql(whole + " wlocals", "select target, array_to_string(picks, ',') as picks, first_id from wlocals"))
    add("disjuncts", lambda f: f.whole_locals().groupBy("target").agg(F.count("*").alias("n_disjuncts")), _sql(whole + " wlocals", "select target, count(*) as n_disjuncts from wlocals group by target"))
    wq = whole + " wlocals wvals wquality"
    add("global_f1_whole", lambda f: _rounded(f.whole_glob(), "precision", "coverage", "f1"), _sql(wq, f"select target, n_pos, tp, n_class, {_r('precision')} as precision, {_r('coverage')} as coverage, {_r('f1')} as f1 from wquality"))
    add("global_macro_whole", lambda f: _rounded(explain.macro(f.whole_glob()), "macro_f1"), _sql(wq, f"select {_r('avg(f1)')} as macro_f1, count(f1) as n_defined from wquality"))
    add("fp_rate", lambda f: f.feat().where("split = 'TEST'").join(F.broadcast(f.rep()), "formula_id").groupBy("formula_id", "target").agg(r6(F.avg(F.when(F.col("label") == F.col("target"), (explain.moved(F.col("rho")) > 0).cast("double")))).alias("tp_rate"), r6(F.avg(F.when(F.col("label") != F.col("target"), (explain.moved(F.col("rho")) > 0).cast("double")))).alias("fp_rate")), _sql("emb feat med refs rep moved", f"select formula_id, target, {_r('avg((rho > 0)::int) filter (label = target)')} as tp_rate, {_r('avg((rho > 0)::int) filter (label <> target)')} as fp_rate from moved where split = 'TEST' group by all"))
    # further analytics
    test = lambda f: f.feat().where("split = 'TEST'")
    add("contribution_grid", lambda f: explain.class_contributions(f.scored(), f.coef()).withColumn("c", r6("c")), _sql("emb feat coef", f"select series_id, class_idx, formula_id, {_r('w * rho')} as c from feat join coef using (formula_id) where split = 'TEST'"))
    add("margins", lambda f: explain.margins(f.scored(), f.coef(), TOP, POOL).select("series_id", "competitor", r6("full_margin").alias("margin")), _sql(base, f"select series_id, competitor, {_r('sum(c)')} as margin from contrib group by all"))
    a, b = "coef a", "coef b"
    pair = lambda f: f.coef().where("class_idx = 1").select("formula_id", F.col("w").alias("w1")).join(f.coef().where("class_idx = 4").select("formula_id", F.col("w").alias("w4")), "formula_id").select("formula_id", (F.col("w1") - F.col("w4")).alias("d"))
    add("quantile_box", lambda f: _rounded(analytics.quantile_box(f.feat()), "vmin", "vmax"), _sql("emb feat box", f"select formula_id, {_r('vmin')} as vmin, {_r('vmax')} as vmax from box"))
    worst = f"(select a.formula_id, a.w - b.w as d, case when a.w > b.w then (a.w - b.w) * vmin when a.w < b.w then (a.w - b.w) * vmax else 0.0 end as worst from {a} join {b} using (formula_id) join box using (formula_id) where a.class_idx = 1 and b.class_idx = 4)"
    add("worst_case", lambda f: analytics.worst_case(pair(f), analytics.quantile_box(f.feat())).select("formula_id", "d", r6("worst").alias("worst")), _sql("emb feat coef box", f"select formula_id, d, {_r('worst')} as worst from {worst}"))

    def gains(f: Frames) -> DataFrame:
        low = analytics.worst_case(pair(f), analytics.quantile_box(f.feat()))
        bar = low.agg((F.lit(1e-6) - F.sum("worst")).alias("lb"))
        return test(f).join(F.broadcast(low), "formula_id").crossJoin(F.broadcast(bar)).select("series_id", F.lit(4).alias("competitor"), "formula_id", F.round(F.col("d") * F.col("rho") - F.col("worst"), 9).alias("a"), F.round("lb", 9).alias("lb"))

    gain_sql = f"(select f.series_id, f.formula_id, round(d * rho - worst, 9) as a, round(1e-6 - sum_w, 9) as lb from feat f join {worst} using (formula_id) cross join (select sum(worst) as sum_w from {worst}) where f.split = 'TEST')"
    add("abduce_binary", lambda f: analytics.abduce_binary(gains(f)), _sql("emb feat coef box", f"""select series_id, case when max(lb) <= 0 then 0 else min(k) filter (total >= lb) end::int as n_needed, max(lb) <= 0 or count(*) filter (total >= lb) > 0 as enough from (
      select *, case when a > 0 then row_number() over w end as k, case when a > 0 then sum(a) over w end as total from {gain_sql} window w as (partition by series_id order by a desc, formula_id rows between unbounded preceding and current row)) group by series_id"""))
    ranked = f"(select *, row_number() over w as k, sum(a) over w as total from {gain_sql} where a > 0 window w as (partition by series_id order by a desc, formula_id rows between unbounded preceding and current row))"
    needed = f"(select series_id, max(lb) as lb, case when max(lb) <= 0 then 0 else min(k) filter (total >= lb) end as n from (select g.series_id, g.lb, r.k, r.total from (select distinct series_id, lb from {gain_sql}) g left join {ranked} r using (series_id)) group by series_id)"

    def one_pair(f: Frames) -> DataFrame:
        """The search in packed rows for the gains of class 1 over class 4, as classes 0 and 1."""
        two = f.coef().where("class_idx in (1, 4)").withColumn("class_idx", F.when(F.col("class_idx") == 1, 0).otherwise(1))
        rows = f.packed().where("split = 'TEST'").withColumn("class_idx", F.lit(0))
        return analytics.abduced(rows, two, analytics.quantile_box(f.feat()))

    add("abduce_check", lambda f: one_pair(f).select("series_id", "n_needed"), _sql("emb feat coef box", f"select series_id, coalesce(n, -1)::int as n_needed from {needed}"))
    add("verified_margins", lambda f: _rounded((lambda g: analytics.verified_margins(g, analytics.prefix_picks(g)))(gains(f)), "margin"), _sql("emb feat coef box", f"select series_id, 4 as competitor, {_r('coalesce(total, 0.0) - lb')} as margin, coalesce(total, 0.0) >= lb as secured from {needed} left join (select series_id, k as n, total from {ranked}) using (series_id, n)"))
    add("sufficiency_zero", lambda f: classify.predictions(_rounded(classify.long_scores(test(f).join(f.top_m(POOL).select("series_id", "formula_id"), ["series_id", "formula_id"], "left_semi"), f.coef()), "score")).join(f.pred().select("series_id", F.col("class_idx").alias("own")), "series_id").select("series_id", (F.col("class_idx") == F.col("own")).alias("sufficient")), _sql(base + " topm", f"select series_id, s.class_idx = p.class_idx as sufficient from (select series_id, class_idx, row_number() over (partition by series_id order by {_r('sum(w * rho)')} desc, class_idx) as k from feat join topm using (series_id, formula_id) join coef using (formula_id) group by series_id, class_idx) s join pred p using (series_id) where k = 1"))
    kinds = lambda f: f.emb().select("label").distinct()
    quarters = "(select f.formula_id, t.target, quantile_cont(rho, 0.25) filter (f.label = t.target) as qt, quantile_cont(rho, 0.75) filter (f.label <> t.target) as qo from feat f cross join (select distinct label as target from emb) t where f.split = 'TRAIN' group by all)"
    add("separation_loss", lambda f: _rounded(analytics.separation(f.feat(), kinds(f)), "q_t", "q_o", "loss", "delta"), _sql("emb feat", f"select formula_id, target, {_r('qt')} as q_t, {_r('qo')} as q_o, {_r('-least(qt, -qo)')} as loss, {_r('-(qt + qo) / 2')} as delta from {quarters}"))
    weighted = lambda f, w: f.coef().select("formula_id", F.col("class_idx").cast("string").alias("target"), w.alias("w"))

    def shifts_sql(w: str, select: str) -> str:
        """The prototype's search for weights w of coef, by its grid and where both sides of the loss meet."""
        return _sql("emb feat coef", f"""select {select} from (
      select *, case when negated then -1 else 1 end as way, greatest(least(-(case when negated then -1 else 1 end) * (qt + qo) / 2, g + 2 * h / 200), g - 2 * h / 200) as delta from (
        select *, -h + 2 * h * k / 200 as g, row_number() over (partition by formula_id, target order by round(-least(qt + case when negated then -1 else 1 end * (-h + 2 * h * k / 200), -(qo + case when negated then -1 else 1 end * (-h + 2 * h * k / 200))), 9), k) as nth from (
          select f.formula_id, t.target, t.negated, quantile_cont(v, 0.25) filter (own) as qt, quantile_cont(v, 0.75) filter (not own) as qo, median(v) filter (own) as mt, median(v) filter (not own) as mo, list(v) filter (own) as vt, list(v) filter (not own) as vo
          from (select formula_id, class_idx::varchar as target, {w} < 0 as negated from coef) t join lateral (select f.formula_id, f.label = t.target as own, case when t.negated then -f.rho else f.rho end as v from feat f where f.formula_id = t.formula_id and f.split = 'TRAIN') f on true group by all)
        join (select formula_id, 2 * (quantile_cont(rho, 0.95) - quantile_cont(rho, 0.05) + 1e-6) as h from feat where split = 'TRAIN' group by formula_id) using (formula_id), (select unnest(range(0, 201))::int as k)) where nth = 1)""")

    add("delta_grid", lambda f: analytics.searched_shifts(f.feat(), weighted(f, F.lit(1.0)), kinds(f)).select("formula_id", "target", "best_k"), shifts_sql("1", "formula_id, target, k as best_k"))
    found = ["delta", "loss", "med_target", "med_others", "satisfied", "violated"]
    add("reparam_prototype", lambda f: _rounded(analytics.searched_shifts(f.feat(), weighted(f, F.col("w")), kinds(f)).drop("best_k"), *found), shifts_sql("w", f"formula_id, target, negated, {_r('delta')} as delta, {_r('-least(qt + way * delta, -(qo + way * delta))')} as loss, {_r('mt + way * delta')} as med_target, {_r('mo + way * delta')} as med_others, {_r('list_avg(list_transform(vt, lambda v: (v + way * delta > 0)::int))')} as satisfied, {_r('list_avg(list_transform(vo, lambda v: (v + way * delta < 0)::int))')} as violated"))
    add("reparam_diagnostics", lambda f: _rounded(analytics.diagnostics(f.feat(), f.rep()), "med_target", "med_others", "satisfied", "violated"), _sql("emb feat med refs rep moved", f"select formula_id, target, {_r('median(rho) filter (label = target)')} as med_target, {_r('median(rho) filter (label <> target)')} as med_others, {_r('avg((rho > 0)::int) filter (label = target)')} as satisfied, {_r('avg((rho <= 0)::int) filter (label <> target)')} as violated from moved where split = 'TRAIN' group by all"))
    add("kde", lambda f: _rounded(analytics.density(f.feat().where("split = 'TRAIN' and formula_id = 1").select("label", F.col("rho").alias("x")), 50), "g", "density"), _sql("emb feat", f"""select v.label, k::int as k, {_r('g')} as g, {_r('avg(exp(-(((g - rho) / h) ** 2) / 2)) / (h * sqrt(2 * pi()))')} as density from (select label, rho from feat where split = 'TRAIN' and formula_id = 1) v
      join (select label, k, s * n ** -0.2 as h, a - 1 + (z - a + 2) * k / 49 as g from (select label, count(*)::double as n, stddev_samp(rho) as s, min(rho) as a, max(rho) as z from feat where split = 'TRAIN' and formula_id = 1 group by label), (select unnest(range(0, 50))::double as k)) t on v.label = t.label group by v.label, k, g, h"""))
    def all_pairs(f: Frames) -> DataFrame:
        """(class_idx, competitor, formula_id, d, worst) of every two classes."""
        a, b = f.coef(), f.coef().select(F.col("class_idx").alias("competitor"), "formula_id", F.col("w").alias("other"))
        d = a.join(b, "formula_id").where("class_idx <> competitor").select("class_idx", "competitor", "formula_id", (F.col("w") - F.col("other")).alias("d"))
        return analytics.worst_case(d, analytics.quantile_box(f.feat())).select("class_idx", "competitor", "formula_id", "d", "worst")

    pairs_sql = "(select a.class_idx, b.class_idx as competitor, formula_id, a.w - b.w as d, case when a.w > b.w then (a.w - b.w) * vmin when a.w < b.w then (a.w - b.w) * vmax else 0.0 end as worst from coef a join coef b using (formula_id) join box using (formula_id) where a.class_idx <> b.class_idx)"
    add("worst_case_whole", lambda f: _rounded(all_pairs(f), "worst"), _sql("emb feat coef box", f"select class_idx, competitor, formula_id, d, {_r('worst')} as worst from {pairs_sql}"))
    # maps of scores and of contributions, as text in order of class
    mapped = lambda key, value: F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda s: F.format_string("%d:%.3f", s[key], s[value])))
    score4 = "(select series_id, class_idx, round(score, 3) + 0.0 as v from score)"
    add("score_map", lambda f: f.score().withColumn("v", F.round("score", 3) + F.lit(0.0)).groupBy("series_id").agg(mapped("class_idx", "v").alias("scores")), _sql("emb feat coef score", f"select series_id, string_agg(class_idx || ':' || printf('%.3f', v), ',' order by class_idx) as scores from {score4} group by series_id"))
    add("pick_breakdown", lambda f: f.contrib().join(f.top_m(POOL).select("series_id", "formula_id"), ["series_id", "formula_id"], "left_semi").withColumn("v", F.round("c", 3) + F.lit(0.0)).groupBy("series_id", "formula_id").agg(mapped("competitor", "v").alias("by_competitor")), _sql(base + " topm", "select series_id, formula_id, string_agg(competitor || ':' || printf('%.3f', v), ',' order by competitor) as by_competitor from (select c.series_id, c.formula_id, competitor, round(c, 3) + 0.0 as v from contrib c join topm using (series_id, formula_id)) group by all"))

    three_ways = lambda f: _rounded(explain.margins(f.scored(), f.coef(), TOP, POOL), "full_margin", "own_margin", "top_margin")
    add("margins_three_ways", three_ways, _sql(base + " topm", f"select c.series_id, c.competitor, {_r('sum(c.c)')} as full_margin, {_r(f'sum(case when c.rank <= {TOP} then c.c else 0.0 end)')} as own_margin, {_r('sum(case when t.formula_id is not null then c.c else 0.0 end)')} as top_margin from {each} c left join topm t on t.series_id = c.series_id and t.formula_id = c.formula_id group by all"))
    add("selected_features", lambda f: classify.nonzero_features(f.shrunken()).withColumn("selected_idx", F.row_number().over(Window.orderBy("formula_id")) - 1), _sql(fit, "select formula_id, (row_number() over (order by formula_id) - 1)::int as selected_idx from shrunk group by formula_id having max(abs(w)) > 0"))
    # every subset of the bank, for every competitor of the predicted class
    subsets_sql = f"""(with low as materialized (select *, sum(worst) over (partition by class_idx, competitor) as sum_w from {pairs_sql}),
      g as materialized (select f.series_id, l.competitor, list(round(l.d * f.rho - l.worst, 9) order by f.formula_id) as a, any_value(round(1e-6 - l.sum_w, 9)) as lb
        from feat f join pred p using (series_id) join low l on l.class_idx = p.class_idx and l.formula_id = f.formula_id where f.split = 'TEST' group by all),
      s as (select unnest(range(0, {1 << len(BANK)})) as mask)
      select series_id, coalesce(min(n), -1)::int as n_needed from (select distinct series_id from g) left join (
        select series_id, mask, bit_count(mask)::int as n from g, s group by series_id, mask having min({' + '.join(f'(mask >> {j} & 1) * a[{j + 1}]' for j in range(len(BANK)))} - lb) >= -1e-12) using (series_id) group by series_id)"""
    abduced = "emb feat coef score pred box"

    def against_all(f: Frames, search: Callable) -> DataFrame:
        """What each formula of a TEST series adds to the margin of its predicted class over every other one, searched in packed rows."""
        f = f.with_unlike_classes()
        return search(f.scored(), f.coef(), analytics.quantile_box(f.feat()))

    add("abduce_whole", lambda f: against_all(f, analytics.abduced).select("series_id", "n_needed"), _unlike(_sql(abduced, f"select series_id, n_needed from {subsets_sql}")))
    add("verified_margins_whole", lambda f: against_all(f, analytics.abduced_margins).select("series_id", "competitor", "secured"), _unlike(_sql(abduced, f"select series_id, c.class_idx as competitor, true as secured from {subsets_sql} n join pred p using (series_id) join (select distinct class_idx from coef) c on c.class_idx <> p.class_idx where n_needed >= 0")))
    add("kde_whole", lambda f: _rounded(analytics.density(f.feat().where("split = 'TRAIN'").select(F.struct("formula_id", "label").alias("label"), F.col("rho").alias("x"))), "g", "density").select(F.col("label.formula_id").alias("formula_id"), F.col("label.label").alias("label"), "k", "g", "density"), _sql("emb feat", f"""select formula_id, label, k::int as k, {_r('g')} as g, {_r('density')} as density from (
      with v as (select formula_id, label, rho from feat where split = 'TRAIN'),
      t as (select formula_id, label, count(*)::double as n, avg(rho) as mean, stddev_samp(rho) as s, min(rho) as a, max(rho) as z from v group by formula_id, label),
      h as (select formula_id, label, k, s * n ** -0.2 as h, a - 1 + (z - a + 2) * k / 399 as g from t, (select unnest(range(0, 400))::double as k) where n > 1 and s > 1e-12)
      select v.formula_id, v.label, k, g, avg(exp(-(((g - rho) / h) ** 2) / 2)) / (h * sqrt(2 * pi())) as density from v join h on v.formula_id = h.formula_id and v.label = h.label group by v.formula_id, v.label, k, g, h
      union all select formula_id, label, 0, mean, null from t where not coalesce(n > 1 and s > 1e-12, false))"""))
    # settings and results
    # the tasks of a grid: every data set (here, a nation's customers would be one) in each setting
    def grid(f: Frames) -> DataFrame:
        names = f.spark.read.parquet(f"{f.dir}/nation.parquet").select((F.row_number().over(Window.orderBy("n_nationkey")) - 1).cast("long").alias("dataset_no"), F.col("n_name").alias("dataset"))  # a row a data set
        tasks = f.spark.range(2 * names.count()).select(F.col("id").alias("task"))
        n = names.agg(F.count("*").alias("n"))
        of_each = tasks.crossJoin(F.broadcast(n)).select("task", F.pmod("task", "n").alias("dataset_no"), F.when(F.floor(F.col("task") / F.col("n")) % 2 == 0, 100).otherwise(1000).alias("n_formulas"), F.lit(3).alias("depth_max"))
        return of_each.join(F.broadcast(names), "dataset_no")

    task = "select task, dataset_no, dataset, case when (task // n) % 2 = 0 then 100 else 1000 end as n_formulas, 3 as depth_max from (select n, unnest(range(0, 2 * n)) as task from (select count(*) as n from nation)) join (select row_number() over (order by n_nationkey) - 1 as dataset_no, n_name as dataset from nation) on dataset_no = task % n"
    add("task_decode", grid, task)
    add("config_grid", lambda f: grid(f).groupBy("n_formulas", "depth_max").agg(F.count("*").alias("n_tasks")), f"select n_formulas, depth_max, count(*) as n_tasks from ({task}) group by all")
    # runs over the panel, written as run directories and read back
    ran = "emb feat means judgedr reportr runs"
    add("run_summary", lambda f: _rounded(results.summary(f.runs()), "mean_balanced_accuracy", "std_balanced_accuracy", "mean_macro_f1"), _sql(ran, f"select dataset, n_formulas, depth_max, {_r('avg(balanced_accuracy)')} as mean_balanced_accuracy, {_r('stddev_pop(balanced_accuracy)')} as std_balanced_accuracy, {_r('avg(macro_f1)')} as mean_macro_f1, count(*) as n_run from runs group by all"))
    timed = lambda: F.min((F.col("time_total_s") > 0) & (F.abs(F.col("time_features_s") + F.col("time_train_s") - F.col("time_total_s")) < 1e-3)).alias("timed")
    add("results_groupby", lambda f: f.runs().groupBy("n_formulas", "depth_max").agg(r6(F.avg("balanced_accuracy")).alias("mean_acc"), r6(F.stddev_samp("balanced_accuracy")).alias("std_acc"), timed(), F.countDistinct("dataset").alias("n_datasets"), F.max(F.format_string("n=%d d=%d", "n_formulas", "depth_max")).alias("setting")), _sql(ran, f"select n_formulas, depth_max, {_r('avg(balanced_accuracy)')} as mean_acc, {_r('stddev_samp(balanced_accuracy)')} as std_acc, true as timed, count(distinct dataset) as n_datasets, max('n=' || n_formulas || ' d=' || depth_max) as setting from runs group by all"))
    by_depth = f"select dataset, n_formulas, {_r('avg(balanced_accuracy) filter (depth_max = 2)')} as d2, {_r('avg(balanced_accuracy) filter (depth_max = 3)')} as d3 from runs group by all"
    add("results_pivot", lambda f: f.runs().groupBy("dataset", "n_formulas").pivot("depth_max", [2, 3]).agg(r6(F.avg("balanced_accuracy"))).withColumnsRenamed({"2": "d2", "3": "d3"}), _sql(ran, by_depth))
    add("results_class_grid_left", lambda f: f.emb().select(F.col("label").alias("class")).distinct().crossJoin(f.runs().select("n_formulas").distinct()).join(f.glob().select(F.col("target").alias("class"), r6("f1").alias("f1")), "class", "left"), _sql(more + " locals gvals quality means judgedr reportr runs", f"select class, n_formulas, {_r('f1')} as f1 from (select distinct label as class from emb) cross join (select distinct n_formulas from runs) left join quality on quality.target = class"))
    add("results_class_grid_whole", lambda f: f.emb().select(F.col("label").alias("class")).distinct().crossJoin(f.runs().select("n_formulas").distinct()).join(f.whole_glob().select(F.col("target").alias("class"), r6("f1").alias("f1")), "class", "left"), _sql(wq + " means judgedr reportr runs", f"select class, n_formulas, {_r('f1')} as f1 from (select distinct label as class from emb) cross join (select distinct n_formulas from runs) left join wquality on wquality.target = class"))
    keys = ["dataset", "n_formulas", "depth_max"]
    metrics = ("balanced_accuracy", "accuracy", "macro_f1")
    add("results_loaded", lambda f: f.runs().select(*keys, "run", "seed", *[r6(c).alias(c) for c in metrics]), _sql(ran, f"select dataset, n_formulas, depth_max, run, run as seed, {', '.join(f'{_r(c)} as {c}' for c in metrics)} from runs"))
    add("results_class_metrics", lambda f: _rounded(results.class_metrics(f.runs()).select(*keys, "run", "class", "precision", "recall", "f1", "support"), "precision", "recall", "f1"), _sql(ran, f"select 'embeddings' as dataset, n_formulas, depth_max, run, label as class, {_r('precision')} as precision, {_r('recall')} as recall, {_r('f1')} as f1, support::int as support from reportr"))
    add("results_class_means", lambda f: _rounded(results.class_means(results.class_metrics(f.runs())), "mean_f1"), _sql(ran, "select 'embeddings' as dataset, label as class, round(avg(round(f1, 6)), 6) + 0.0 as mean_f1 from reportr group by label"))
    add("results_settings", lambda f: results.settings(f.runs()), _sql(ran, "select distinct dataset, n_formulas, depth_max from runs"))
    add("results_accuracy_pivot", lambda f: results.accuracy_pivot(f.runs(), [2, 3]).select("dataset", "n_formulas", r6(F.col("2")).alias("d2"), r6(F.col("3")).alias("d3")), _sql(ran, by_depth))
    last = f"'embeddings_{SETTINGS[-1][0]}_{SETTINGS[-1][1]}' as run_dir"
    add("results_locals", lambda f: f.run_directories(explained=True)[1].select("run_dir", "sample_idx", "target_class", (F.length("formula") > 0).alias("worded"), "n_picks", r6("precision_train").alias("precision_train"), "n_tp"), _sql(whole, f"select {last}, series_id as sample_idx, target as target_class, true as worded, len(picks)::int as n_picks, {_r('prec')} as precision_train, n_tp from g{POOL}"))
    add("results_globals", lambda f: f.run_directories(explained=True)[2].select("run_dir", "class", (F.size(F.split("formula", r" \| ")) >= F.col("n_unique_locals")).alias("worded"), "n_unique_locals", r6("f1").alias("f1")), _sql(wq, f"select {last}, target as class, true as worded, n::int as n_unique_locals, {_r('f1')} as f1 from wquality join (select target, count(*) as n from wlocals group by target) using (target)"))

    # a sampled bank and a trained model: no SQL can follow them
    def sampled(f: Frames) -> DataFrame:
        panel = cut(panels.packed_embeddings(f.spark, f.dir))
        formulas, feats = bank.build_bank(panel, panels.embeddings(f.spark, f.dir), STEPS, 12, batch=24, threshold=CORR, depth=2, seed=7)
        about = f.spark.createDataFrame([(j, horizon(phi), len(variables(phi))) for j, phi in enumerate(formulas)], "formula_id int, horizon int, n_variables int")
        means = long_features(feats).where("split = 'TRAIN'").groupBy("formula_id").agg(r6(F.avg("rho")).alias("train_mean"), F.count("*").alias("n"))
        return means.join(F.broadcast(about), "formula_id")

    def l1_path(f: Frames) -> DataFrame:
        """A row a penalty of the prototype's path: features with a weight, loss, and how far at most the objective is from its least."""
        data = path.prepared(classify.balanced_rows(features(f.emb(), BANK, STEPS)), standardised=False)
        fits = path.l1_path(data, classify.prototype_path(round(data.total)))
        told = [(x.penalty, int((x.weights != 0).any(axis=0).sum()), x.loss, x.gap) for x in fits]
        return f.spark.createDataFrame(told, "penalty double, n_nonzero int, loss double, gap double")

    def trained(f: Frames) -> DataFrame:
        feats = cut(features(f.emb(), BANK, STEPS))
        model = classify.train(feats)
        names = classify.classes(feats.where("split = 'TRAIN'")).withColumnRenamed("label", "pred")
        judged = classify.scored(feats.where("split = 'TEST'"), classify.coefficients(model, f.spark)).join(F.broadcast(names), "class_idx")
        return _rounded(classify.report(classify.confusion(judged)), "precision", "recall", "f1")

    add("bank_built", sampled, None)
    add("l1_path", l1_path, None)
    add("trained_report", trained, None)
    return q


ALL = _all()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, build=build: build(Frames(spark, sf_dir))) for name, (build, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in ALL.items() if text}
