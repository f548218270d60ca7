"""Experiments: scale, build a bank, train, evaluate, explain; and the command line."""

from __future__ import annotations

import argparse
import time
from dataclasses import dataclass, fields, replace
from datetime import datetime
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formula import And, Formula, Not, depth, fold, shifted, simplify
from ..functions.robustness import long_features
from ..operators import bank, classify, explain, scale
from ..session import cut, ship
from ..sources import panels, sinks


#: Names and defaults of the settings, as config.json holds them.
@dataclass(frozen=True)
class Config:
    dataset: str = "embeddings"
    n_formulas: int = 1000
    depth_max: int = 3
    batch_size: int = 500
    threshold_corr: float = 0.98
    max_iter: int = 20
    only_temporal: bool = True
    until_weight: float = 0.0
    cv: int = 3
    pool_size: int = 10
    precision_threshold: float = 0.75
    n_run: int = 5
    base_seed: int = 0
    output_dir: str = "results"


SOURCES = {"embeddings": panels.embeddings, "events": panels.daily_events, "orders": panels.quarterly_orders}


def load(spark: SparkSession, name: str, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """(long, packed, steps) of a scaled panel."""
    long = SOURCES[name](spark, sf_dir)
    long = scale.transform(long, scale.fit(long))
    panel = cut(panels.packed(long))
    return long, panel, panel.select(F.size(F.get("vars", F.lit(0)))).first()[0]


def _fit(panel, long, steps, config: Config, seed: int):
    began = time.perf_counter()
    formulas, feats = bank.build_bank(panel, long, steps, config.n_formulas, config.batch_size, config.threshold_corr, config.max_iter, config.depth_max, config.only_temporal, config.until_weight, seed)
    middle = time.perf_counter()
    model = classify.train(feats, config.cv)
    return formulas, feats, model, middle - began, time.perf_counter() - middle


def _predicted(feats: DataFrame, model) -> tuple[DataFrame, DataFrame]:
    """(coefficients, scored rows of TEST with pred)."""
    coef = classify.coefficients(model, feats.sparkSession)
    names = classify.classes(feats.where("split = 'TRAIN'")).withColumnRenamed("label", "pred")
    return coef, classify.scored(feats.where("split = 'TEST'"), coef).join(F.broadcast(names), "class_idx")  # a row a class


def run_single(panel: DataFrame, long: DataFrame, steps: int, config: Config, run: int) -> dict:
    """Metrics and times of one run."""
    seed = config.base_seed + run
    _, feats, model, t_features, t_train = _fit(panel, long, steps, config, seed)
    rows = cut(_predicted(feats, model)[1].select("series_id", "label", "pred"))
    per_class = classify.report(classify.confusion(rows)).orderBy("label").collect()
    accuracy = rows.agg(F.avg((F.col("label") == F.col("pred")).cast("double"))).first()[0]
    return _metrics(run, seed, classify.balanced_accuracy(rows).first()[0], accuracy, per_class, t_features, t_train)


def _metrics(run: int, seed: int, balanced: float, accuracy: float, per_class: list, t_features: float, t_train: float) -> dict:
    """A run as accuracy.json holds it."""
    if not per_class:
        raise ValueError("a run needs TEST series to be judged by")
    return {
        "run": run, "seed": seed, "balanced_accuracy": balanced, "accuracy": accuracy, "macro_f1": sum(r.f1 for r in per_class) / len(per_class),
        "per_class": {r.label: {"precision": round(r.precision, 6), "recall": round(r.recall, 6), "f1": round(r.f1, 6), "support": r.support} for r in per_class},
        "time_features_s": round(t_features, 4), "time_train_s": round(t_train, 4), "time_total_s": round(t_features + t_train, 4),
    }


def _text(formulas: list[Formula], chosen, target: str, picks) -> str:
    parts = []
    for j in picks:
        sign, delta = chosen[j, target]
        parts.append(shifted(Not(formulas[j]) if sign < 0 else formulas[j], delta))
    return str(simplify(fold(parts, And)))


def grid_runs(feats: DataFrame, formulas: list[Formula], configs: list[Config], shrinks: list[float]) -> list[list[dict]]:
    """The metrics of each setting's runs, all settings and runs in one job over one table of features.

    A setting takes the first n_formulas of those not deeper than depth_max; run i has weights of class means
    shrunken by shrinks[i]. A row a setting, run and class comes back.
    """
    began = time.perf_counter()
    means = cut(classify.class_means(long_features(feats)))
    names = classify.classes(feats.where("split = 'TRAIN'")).withColumnRenamed("label", "pred")
    middle = time.perf_counter()
    test, judged = feats.where("split = 'TEST'"), []
    for i, config in enumerate(configs):
        kept = [j for j, phi in enumerate(formulas) if depth(phi) <= config.depth_max][: config.n_formulas]
        for run, shrink in enumerate(shrinks[: config.n_run]):
            coef = classify.shrunken(means, shrink).where(F.col("formula_id").isin(kept))
            judged.append(classify.scored(test, coef).select(F.lit(i).alias("setting"), F.lit(run).alias("run"), "label", "class_idx"))
    by = ["setting", "run"]
    conf = cut(classify.confusion(reduce(DataFrame.unionByName, judged).join(F.broadcast(names), "class_idx"), by))  # a row a class
    rows = classify.report(conf, by).orderBy(*by, "label").collect()
    right = {(r.setting, r.run): r.a for r in conf.groupBy(*by).agg((F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("a")).collect()}
    took = (time.perf_counter() - middle) / max(1, len(right))
    out: list[list[dict]] = [[] for _ in configs]
    for i, run in sorted(right):
        own = [r for r in rows if (r.setting, r.run) == (i, run)]
        recalls = [r.recall for r in own if r.support]
        out[i].append(_metrics(run, configs[i].base_seed + run, sum(recalls) / len(recalls), right[i, run], own, middle - began, took))
    return out


def explanations(found: DataFrame, formulas: list[Formula], rep: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(local explanations, a row a series; disjuncts, a row a distinct local; classes, a row each with F1) of greedy picks.

    words are those of TEST. Spark words the formulas; no class's explanation passes through the driver.
    """
    chosen = {(r.formula_id, r.target): (r.sign, r.delta) for r in rep.collect()}  # a row a formula and class

    @F.pandas_udf("string")
    def written(targets: pd.Series, picks: pd.Series) -> pd.Series:
        return pd.Series([_text(formulas, chosen, t, [int(j) for j in own]) for t, own in zip(targets, picks, strict=True)], dtype=object)

    ship(found.sparkSession)
    # a conjunction doesn't depend on the order of its picks: texts are of sorted picks, and so are told apart as these are
    distinct = cut(explain.distinct_locals(found).withColumn("formula", written("target", "picks")))
    texts = distinct.select("target", F.col("picks").alias("sorted"), "formula")
    local = found.withColumn("sorted", F.array_sort("picks")).join(texts, ["target", "sorted"])
    local = local.select(F.col("series_id").alias("sample_idx"), F.col("target").alias("target_class"), "formula", F.size("picks").alias("n_picks"), F.col("precision").alias("precision_train"), "n_tp")
    picks = distinct.select("target", F.col("first_id").alias("pick_id"), F.explode("picks").alias("formula_id"))
    counts = distinct.groupBy("target").agg(F.count("*").alias("n_unique_locals"), F.min("first_id").alias("first_id"))
    kinds = counts.join(explain.global_quality(words, picks).select("target", "f1"), "target", "left").select(F.col("target").alias("class"), "first_id", "n_unique_locals", "f1")
    return local, distinct.select(F.col("target").alias("class"), "first_id", "formula"), cut(kinds)


def explain_run(panel: DataFrame, long: DataFrame, steps: int, config: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Local explanations, disjuncts and classes, as ``explanations`` gives them."""
    formulas, feats, model, _, _ = _fit(panel, long, steps, config, config.base_seed + config.n_run)
    coef, rows = _predicted(feats, model)
    rep = cut(explain.reparametrised(explain.reference_classes(explain.class_medians(long_features(feats)))))
    pool = explain.top_m(rows, coef, config.pool_size).join(rows.select("series_id", F.col("pred").alias("target")), "series_id").select("series_id", "target", "formula_id", "rank")
    found = cut(explain.greedy_picks(pool, cut(explain.block_words(feats, rep, "TRAIN")), config.pool_size, config.precision_threshold))
    return explanations(found, formulas, rep, cut(explain.block_words(feats, rep, "TEST")))


def parse(args: list[str] | None = None) -> tuple[Config, str]:
    parser = argparse.ArgumentParser(description="Temporal-logic features, a sparse classifier, and explanations.")
    for f in fields(Config):
        kind = {"int": int, "float": float, "bool": lambda x: x.lower() != "false"}.get(f.type, str)
        parser.add_argument(f"--{f.name}", type=kind, default=f.default)
    parser.add_argument("--data", required=True, help="folder of the source tables")
    found = vars(parser.parse_args(args))
    data = found.pop("data")
    return replace(Config(), **found), data


def _percent(x: float | None) -> str:
    return "-" if x is None else f"{100 * x:.1f} %"


def main(args: list[str] | None = None) -> str:
    config, data = parse(args)
    spark = SparkSession.builder.appName("temporalis").getOrCreate()
    write = sinks.shared_writer(spark)
    out = sinks.run_directory(spark, config.output_dir, config.dataset, datetime.now())
    sinks.save_config(config, out, write)
    long, panel, steps = load(spark, config.dataset, data)
    sinks.save_accuracy([run_single(panel, long, steps, config, i) for i in range(config.n_run)], out, write)
    local, disjuncts, kinds = explain_run(panel, long, steps, config)
    sinks.save_locals(local, out)
    sinks.save_globals(disjuncts, kinds, out)
    told = kinds.orderBy("first_id").collect()  # a row a class
    for r in told:
        print(f"{r['class']:>12} {r.n_unique_locals:5d} {_percent(r.f1)}")
    defined = [r.f1 for r in told if r.f1 is not None]
    print(f"{'macro':>12} {'':5} {_percent(sum(defined) / len(defined) if defined else None)}")
    return out


if __name__ == "__main__":
    main()
