"""Run every analysis over one marketplace and write the results.

The notebook flow upstream is linear: load -> quality checks -> KPIs ->
hypotheses -> features -> models -> segments -> exports.  Here each step
is an independent Spark job over the same canonical tables, written to
``out_dir/<name>`` (Parquet or CSV); the dashboard marts go to
``out_dir/marts``.

    python -m repeatlens.report --csv RAW_DIR --out OUT_DIR [--models] [--fmt csv]
        [--files orders=my_orders.csv ...] [--scope window_start='2019-01-01 00:00:00' ...]
    python -m repeatlens.report --parquet CANONICAL_DIR --out OUT_DIR
"""

from __future__ import annotations

import argparse
import json
import time
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from repeatlens.scope import Scope
from repeatlens.sources.schemas import CSV_FILES
from repeatlens.sources.tables import Marketplace

MODEL_JOBS = ("cv_model_comparison", "feature_importances", "final_model_evaluation",
              "final_confusion_matrix", "logistic_regression", "grid_search")


class ReportError(RuntimeError):
    """Some analyses failed; ``result`` has what ``run_report`` would return."""

    def __init__(self, message: str, result: dict):
        super().__init__(message)
        self.result = result


def run_report(spark: SparkSession, mp: Marketplace, scope: Scope, out_dir: str, fmt: str = "parquet",
               include_models: bool = False) -> dict[str, float | str]:
    """Write each analysis; returns seconds per analysis.

    One that fails (e.g. RFM scores raise, like pandas ``qcut``, when recency
    quantile edges repeat) does not stop the others; in the end a
    ``ReportError`` names those that failed, with their error texts."""
    from repeatlens.catalog import JOBS
    from repeatlens.plans.bi import write_dashboard_marts
    from repeatlens.sources.sinks import write_table

    from repeatlens.plans import features, modeling, targeting
    from repeatlens.session import materialize, release, written

    # shared marts, built once on first use and read by every consumer
    shared: dict[str, DataFrame] = {}

    def mart() -> DataFrame:
        if "features" not in shared:
            shared["features"] = materialize(features.features_imputed(mp, scope))
        return shared["features"]

    def frame() -> DataFrame:
        if "frame" not in shared:
            shared["frame"] = materialize(modeling.model_frame(mp, scope))
        return shared["frame"]

    targeting_jobs = {"class_weights", "stratified_folds", "stratified_split", "roc_auc_rank",
                      "confusion_matrix", "classification_report", "top_decile_lift"}
    model_jobs = {"cv_model_comparison": modeling.cv_model_comparison,
                  "feature_importances": modeling.feature_importances,
                  "final_model_evaluation": modeling.final_model_evaluation,
                  "final_confusion_matrix": modeling.final_confusion_matrix,
                  "logistic_regression": modeling.logistic_regression,
                  "grid_search": modeling.grid_search}

    def build(name: str, job) -> DataFrame:
        if name in targeting_jobs:
            return getattr(targeting, name)(mp, scope, features=mart())
        if name in model_jobs:
            return model_jobs[name](mp, scope, frame=frame())
        return job(mp, scope)

    steps = {name: (lambda job=job, name=name: write_table(build(name, job), f"{out_dir.rstrip('/')}/{name}", fmt))
             for name, job in JOBS.items() if include_models or name not in MODEL_JOBS}
    steps["dashboard_marts"] = lambda: write_dashboard_marts(mp, scope, f"{out_dir.rstrip('/')}/marts", fmt)
    result: dict[str, float | str] = {}
    spark = mp.orders.sparkSession
    for name, step in steps.items():
        t0, mark = time.perf_counter(), written(spark)
        try:
            step()
            result[name] = round(time.perf_counter() - t0, 3)
        except Exception as exc:  # noqa: BLE001 -- reported per analysis
            result[name] = f"error: {str(exc).splitlines()[0][:300]}"
        release(spark, mark)  # the step's result is written; the marts are checkpointed
    failed = sorted(n for n, v in result.items() if isinstance(v, str))
    if failed:
        raise ReportError(f"{len(failed)} of {len(result)} analyses failed: {', '.join(failed)}", result)
    return result


def scope_from(args: list[str]) -> Scope:
    """A scope from ``field=value`` pairs; fields that are not named keep
    their defaults."""
    kinds = {f.name: type(f.default) for f in fields(Scope)}
    given = dict(a.split("=", 1) for a in args)
    unknown = sorted(set(given) - set(kinds))
    if unknown:
        raise ValueError(f"no scope field {', '.join(unknown)}; there are {', '.join(kinds)}")
    return Scope(**{k: kinds[k](v) for k, v in given.items()})


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="python -m repeatlens.report")
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--csv", help="folder of raw CSV files")
    ap.add_argument("--files", nargs="*", default=[], metavar="TABLE=NAME",
                    help="names of raw files that are not called <table>.csv")
    ap.add_argument("--scope", nargs="*", default=[], metavar="FIELD=VALUE",
                    help="scope fields, such as window_start='2019-01-01 00:00:00'")
    src.add_argument("--parquet", help="folder of canonical Parquet tables (from ingest_to_parquet)")
    ap.add_argument("--out", required=True)
    ap.add_argument("--fmt", default="parquet", choices=["parquet", "csv"])
    ap.add_argument("--models", action="store_true", help="also train and evaluate the models")
    a = ap.parse_args(argv)

    from repeatlens.session import local_session
    from repeatlens.sources.csv_source import read_marketplace_csv, read_marketplace_parquet

    spark = SparkSession.getActiveSession() or local_session()
    files = CSV_FILES | dict(x.split("=", 1) for x in a.files)
    mp = (read_marketplace_csv(spark, a.csv, files) if a.csv
          else read_marketplace_parquet(spark, a.parquet))
    try:
        print(json.dumps(run_report(spark, mp, scope_from(a.scope), a.out, a.fmt, a.models)))
    except ReportError as e:
        print(json.dumps(e.result))
        raise SystemExit(1) from e


if __name__ == "__main__":
    main()
