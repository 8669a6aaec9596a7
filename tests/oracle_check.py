"""Compare queries with their SQL twins: python tests/oracle_check.py [scale] [name prefix ...]."""

from __future__ import annotations

import datetime
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__ as contract
from sitegauge.plans import catalogue
from sitegauge.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def mean(values):
    values = list(values)
    return sum(values) / len(values)


def between(rows, column, low, high):
    return all(low <= r[column] <= high for r in rows)


def learned(rows, guess, actual="days"):
    """A prediction is nearer than the mean of all."""
    middle = mean(r[actual] for r in rows)
    return mean(abs(r[guess] - r[actual]) for r in rows) < 0.7 * mean(abs(middle - r[actual]) for r in rows)


def cascade_holds(rows):
    scored = [r for r in rows if r["fold"] == -1]
    sums = all(abs(r["base"] + r["arbiter"] + r["stratified"] + r["corrector"] - r["prediction"]) < 1e-6 for r in rows)
    gated = all((r["head_north"] == 0) or r["lpa"] % 5 == 0 for r in rows) and all(r["expert"] == 0 or r["risk"] >= 0.5 for r in rows)
    whole = {}
    for r in rows:
        if r["fold"] >= 0:
            whole.setdefault(r["family"], set()).add(r["fold"])
    error = lambda c, some: mean((r[c] - r["days"]) ** 2 for r in some)
    known = [r for r in rows if r["fold"] >= 0]
    below = error("prediction", known) < error("base", known) and error("prediction", scored) < 1.05 * error("base", scored)
    return sums and gated and all(len(f) == 1 for f in whole.values()) and between(rows, "risk", 0, 1) and below


def surrogate_holds(rows):
    parts = {}
    for r in rows:
        parts.setdefault((r["site_id"], r["prediction"], r["mean_prediction"]), []).append(r["days"])
    return all(abs(sum(days) - (p - m)) < 1e-6 for (_, p, m), days in parts.items()) and len({len(d) for d in parts.values()}) == 1


def search_holds(rows):
    chosen = [r for r in rows if r["chosen"] == 1]
    most = max(r["folds_seen"] for r in rows)
    return len(chosen) == 1 and chosen[0]["rmse"] == min(r["rmse"] for r in rows if r["folds_seen"] == most) and min(r["folds_seen"] for r in rows) < most


def dossiers_hold(rows):
    scenarios = {1, 2.5, 5, 7.5, 10, 12.5, 15, 20, 25, 30, 35, 40, 45, 50}
    return len({r["site_id"] for r in rows}) == len(rows) and all(
        r["optimal_capacity_mw"] in scenarios and r["p10"] <= max(0, r["predicted_days"]) + 1e-9 and r["predicted_days"] <= r["p90"] + 1e-9 and r["scenarios"] == 14 and r["local_rmse"] >= r["local_mae"] - 1e-9
        and r["first_driver"] and r["local_rule"] in ("band", "all", "none") for r in rows)


#: What must hold of queries that SQL can't express: trained models, and projections with a round trip.
INVARIANTS = {
    "prj18_reproject": lambda rows: between(rows, "drift_m", 0, 0.01) and between(rows, "lon", -8, 3) and between(rows, "lat", 49, 61),
    "ml01_impute_columns": lambda rows: all(r["grid_km"] is not None and r["slope"] is not None for r in rows) and all(abs(r["grid_km"] - r["site_id"] % 89 / 10) < 1e-9 for r in rows if r["site_id"] % 4),
    "ml01_imputation_report": lambda rows: [r["target"] for r in rows] == ["grid_km"] and 0 < rows[0]["mae"] <= rows[0]["rmse"] < 5,
    "ml03_compress_tail": lambda rows: all(sum(c.startswith("tail_") for c in r) == 20 and sum(c.startswith("measure_") or c in ("capacity_mw", "month", "lpa", "grid_km", "slope", "tech_code") for c in r) == 6 for r in rows),
    "ml04_project_regimes": lambda rows: {r["regime"] for r in rows} == set(range(5)),
    "ml05_group_oof": lambda rows: learned(rows, "oof"),
    "ml06_flag_unlearnable": lambda rows: all((r["mean_error"] > 45) == (r["unlearnable"] == 1) for r in rows),
    "ml07_residual_stack": lambda rows: learned(rows, "prediction") and all(abs(r["base"] + r["head_north"] + r["head_large"] + r["corrector"] - r["prediction"]) < 1e-6 for r in rows),
    "ml07_gated_cascade": cascade_holds,
    "ml08_stratified_models": lambda rows: learned([r for r in rows if r["stratum_prediction"] is not None], "stratum_prediction"),
    "ml09_catastrophe_classifier": lambda rows: between(rows, "catastrophe_probability", 0, 1) and mean(r["catastrophe_probability"] for r in rows if r["error"] > 60) > mean(r["catastrophe_probability"] for r in rows if r["error"] < 30),
    "ml12_terminal_calibrator": lambda rows: all(abs(r["p_over"] + r["p_accurate"] + r["p_under"] - 1) < 1e-6 for r in rows),
    "ml15_tune": lambda rows: sorted(r["depth"] for r in rows) == [2, 3, 4] and all(0 < r["rmse"] < 100 for r in rows),
    "ml15_halving_search": search_holds,
    "ml16_rank_features": lambda rows: abs(sum(r["importance"] for r in rows) - 1) < 1e-6 and max(rows, key=lambda r: r["importance"])["feature"] == "capacity_mw",
    "ml17_local_surrogate": surrogate_holds,
    "ml19_typological_benchmark": lambda rows: len(rows) == 4 and all(r["mae"] <= r["rmse"] for r in rows),
    "ml20_site_dossiers": dossiers_hold,
    "ml24_ridge_arbiter": lambda rows: learned(rows, "arbiter"),
    "ml28_conditional_expert": lambda rows: all((r["expert"] != 0) == (r["lpa"] % 5 == 0) for r in rows),
}


def compare(name: str, df, con) -> tuple[bool, str]:
    columns = sorted(df.columns)
    got = [tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    if name not in contract.oracle_sql():
        if name in INVARIANTS:
            rows = [dict(zip(columns, r, strict=True)) for r in got]
            return bool(rows) and bool(INVARIANTS[name](rows)), f"{len(got)} rows against an invariant"
        # Queries of other packages have tests of their own.
        return name not in catalogue.QUERIES, f"{len(got)} rows, neither SQL nor invariant"
    rel = con.sql(contract.oracle_sql()[name])
    if sorted(rel.columns) != columns:
        return False, f"columns {columns} vs {sorted(rel.columns)}"
    order = [rel.columns.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in order) for r in rel.fetchall()]
    if len(got) != len(want):
        return False, f"{len(got)} rows vs {len(want)}"
    extra, missing = list((set(got) - set(want))), list((set(want) - set(got)))
    if extra or missing or sorted(map(repr, got)) != sorted(map(repr, want)):
        return False, f"{columns}: {len(extra)} differ, e.g. {sorted(map(repr, extra))[:2]} vs {sorted(map(repr, missing))[:2]}"
    return True, f"{len(got)} rows equal"


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con, bad = local_session(8), connect(sf_dir), 0
    for name, run in contract.queries().items():
        if not name.startswith(prefixes):
            continue
        began = time.time()
        try:
            ok, note = compare(name, run(spark, sf_dir), con)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - began:.1f}s {note}", flush=True)
        spark.catalog.clearCache()
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main())
