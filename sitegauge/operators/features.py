"""Interaction features: stateless column expressions over the wide site table (FS-*).

Each family maps output names to expressions. Inputs that are absent take the value in DEFAULTS.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.scalar import only_row
from sitegauge.operators.quantiles import group_quantiles
from sitegauge.operators.windows import months_to_window

EPS = 1e-6

# Inputs taken as these when missing (distances in metres unless the name says km).
DEFAULTS = {
    "sssi_m": 5000.0, "sac_m": 5000.0, "spa_m": 5000.0, "aw_m": 5000.0, "ph_m": 5000.0, "hp_m": 5000.0,
    "aonb_m": 5000.0, "np_m": 5000.0, "trail_m": 5000.0, "kv": 11.0, "ohm": 1.0, "headroom": 10.0, "sub_km": 5.0, "line_km": 5.0,
    "fault": 100.0,
}

Expr = Callable[[], dict[str, Column]]


def val(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(DEFAULTS.get(name, 0.0)))


def flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def band_gate(lo: float, hi: float | None = None) -> Column:
    """1 when lo <= capacity < hi."""
    cap = val("cap")
    return flag((cap >= lo) & (cap < hi)) if hi is not None else flag(cap >= lo)


def near(name: str, limit: float) -> Column:
    return flag(val(f"{name}_m") < limit)


def near_count(names: Sequence[str], limit: float) -> Column:
    return sum((near(n, limit) for n in names), F.lit(0.0))


def over(c: Column, threshold: float) -> Column:
    return F.greatest(c - threshold, F.lit(0.0))


def month_in(*months: int) -> Column:
    return flag(F.col("month").isin(list(months)))


def either(*flags: Column) -> Column:
    return F.greatest(*flags)


def ecological_calendar():
    n = near_count(["sssi", "sac", "spa", "aw", "ph"], 100)
    w = month_in(9, 10, 11, 12, 1, 2)
    return {"micro_survey": band_gate(0, 1) * flag(n > 0) * w, "mid_survey": band_gate(5, 10) * n * w, "large_survey": -band_gate(10) * n * w}


def developer_competence():
    cap = val("cap")
    return {"mw_per_kv": flag(cap >= 1) * cap / (val("kv") + EPS), "mid_storage": band_gate(5, 10) * val("storage"),
            "large_storage": band_gate(10) * val("storage"), "large_chp": band_gate(10) * val("chp")}


def grid_physics():
    cap = val("cap")
    return {"thermal": flag(cap >= 1) * cap * val("ohm"), "fault_density": band_gate(5, 10) * val("fault") * (val("dens") + 0.1),
            "closeness": band_gate(10) / (F.least(val("sub_km"), val("line_km")) + 0.1)}


def grid_contention():
    hr, q, yrs = val("headroom"), val("queue_mw"), val("years_to_constraint")
    light = F.when(hr < 0, 2.0).when(hr <= 10, 1.0).otherwise(0.0)
    timing = F.when((yrs >= 0) & (yrs < 2), 2.0).when(yrs > 5, 0.5).otherwise(1.0)
    return {
        "light": light, "safe_but_full": band_gate(1, 5) * flag((hr > 10) & (q > 2)) * q, "mid_timing": band_gate(5, 10) * timing,
        "mid_relief": band_gate(5, 10) * flag(hr > 50) * 0.5,
        "large_balance": band_gate(10) * (flag(hr < 0) + flag(hr > 50) - flag((hr >= 0) & (hr <= 20))),
        "large_deferred": band_gate(10) * flag(yrs > 4),
    }


def constraint_hard_soft():
    hard = near_count(["sssi", "aw", "sac", "aonb", "hp"], 100)
    landscape = either(near("aonb", 100), near("np", 100), near("hp", 100), val("greenbelt"))
    habitat = either(near("sssi", 100), near("ph", 100), near("sac", 100))
    return {
        "small_hard": band_gate(1, 5) * 5 * hard, "mid_landscape": band_gate(5, 10) * 10 * landscape, "mid_habitat": band_gate(5, 10) * 2 * habitat,
        "large_habitat": band_gate(10) * 5 * near("ph", 100), "large_designed_out": -2.0 * band_gate(10) * either(near("aw", 100), near("sssi", 100)),
    }


def mobilisation():
    s, u, v = val("seniors"), val("group_u"), val("group_v")
    return {
        "micro_wealth": band_gate(0, 1) * val("wealth") / (val("dens") + 0.1),
        "mid_groups": band_gate(1, 10) * (3 * s + 1.5 * u + v) * (val("urban") + 1),
        "large_groups": band_gate(10) * (3 * s + 0.5 * u + v) * (val("gradient") + 1),
    }


def political_epochs():
    cap, year = val("cap"), F.col("year")
    epoch = F.when(year <= 2015, 0).when(year == 2016, 1).when(year <= 2019, 2).otherwise(3)
    return {"epoch": epoch, "after_2020": flag(cap >= 1) * flag(year >= 2020), "after_2024": flag(cap >= 5) * flag(year >= 2024)}


def constraint_severity():
    base = 10 * near_count(["sssi", "aw", "sac"], 50)
    small = base + F.when((base == 0) & (val("agri") > 50), 10.0).otherwise(0.0)
    n = near_count(["sssi", "aw", "sac", "hp", "ph"], 50)
    return {
        "small_severity": small * band_gate(1, 5), "mid_many": band_gate(5, 10) * flag(n >= 2), "mid_few": band_gate(5, 10) * flag(n < 2),
        "wide_none": band_gate(5, 15) * flag(n == 0), "wide_many": band_gate(5, 15) * flag(n >= 2),
        "large_severity": band_gate(10) * (1 - val("bmv")) * (near("ph", 50) + near("sssi", 50) + 1) * 10,
    }


def social_saturation():
    cap, k = val("cap"), val("nearby")
    level = F.when(k <= 1, 0.0).when(k <= 3, 1.0).otherwise(2.0)
    return {
        "micro_level": band_gate(0, 1) * level, "small_pressure": band_gate(1, 5) * F.pow(k, F.lit(1.5)) * (val("dens") + 0.1) * cap,
        "wide_fatigue": band_gate(5, 15) * flag(k > 5) * k, "large_few": band_gate(10) * flag(k <= 3),
        "large_some": band_gate(10) * flag((k > 3) & (k <= 10)), "large_many": band_gate(10) * flag(k > 10),
    }


def authority_regime():
    cap, days, bmv = val("cap"), val("lpa_days"), val("bmv")
    fast, spare = flag(days < 112), F.greatest(112 - days, F.lit(0.0))
    return {
        "small_fast": band_gate(0, 5) * fast * spare, "mid_fast": band_gate(5, 10) * fast * spare * val("variance"), "large_fast": band_gate(10) * fast * spare,
        "micro_bmv": band_gate(0, 1) * bmv, "mid_bmv": flag((cap > 2) & (cap < 10)) * bmv * cap, "large_bmv": band_gate(10) * bmv * 10,
        "low_voltage": band_gate(1, 5) * flag(val("kv") < 33) * cap, "mid_workload": band_gate(5, 15) * val("workload"),
    }


def zoning():
    cap, urban = val("cap"), val("urban")
    return {"residential_load": band_gate(0, 5) * val("residential") / (val("industrial") + 1) * cap, "mid_urban": band_gate(5, 10) * flag(urban > 15),
            "large_urban": -band_gate(10) * flag(urban > 50), "industrial_use": val("industrial")}


def regional_operator():
    score = F.when(F.col("operator") == "A", 0.8).when(F.col("operator") == "B", 0.3).otherwise(0.5)
    return {"operator_score": score, "operator_load": flag(val("cap") < 10) * score * val("cap")}


def constraint_hierarchy():
    weights = {"hp": 1.8, "aonb": 1.4, "ph": 1.1, "sssi": 1.6, "sac": 0.9}
    return {"top_constraint": F.greatest(*[near(n, 50) * w for n, w in weights.items()])}


def wayleave():
    base = val("path_km") * (1 + 5 * val("dens"))
    with_crossings = base + 3 * val("crossings")
    return {"wayleave": base, "wayleave_crossings": with_crossings, "wayleave_scaled": with_crossings * F.log1p(val("cap"))}


def black_holes():
    cap = val("cap")
    light = F.when(val("headroom") < 0, 2.0).when(val("headroom") <= 10, 1.0).otherwise(0.0)
    return {"named_site": val("named"), "named_light": val("named") * light, "weak_reach": flag(cap >= 1) * flag(val("kv") < 33) * val("path_km") * cap}


def small_context():
    cap = val("cap")
    return {
        "micro_wealth_density": band_gate(0, 5) * val("wealth") * val("dens"), "micro_open_farm": band_gate(0, 5) * val("agri") * (1 - val("dens")),
        "farm_and_industry": -band_gate(1, 5) * flag((val("agri") > 50) & (val("industrial") > 1)),
        "density_load": band_gate(1, 5) * val("dens") * cap, "line_load": band_gate(1, 5) * val("line_density") * cap,
    }


def edge_viability():
    cap, d = val("cap"), val("path_km")
    n = near_count(["sssi", "sac", "spa", "aw", "ph"], 100)
    return {"fault_share": band_gate(1, 5) * cap / (val("fault") + EPS), "weak_voltage": band_gate(5, 15) * flag(val("kv") < 33) * cap,
            "reach_per_mw": band_gate(1, 15) * d / (cap + EPS), "constrained_reach": band_gate(5, 15) * d * (1 + n)}


def speculator():
    cap = val("cap")
    r = cap / (val("nearby_mw") / (val("nearby") + EPS) + EPS)
    spec = band_gate(4, 16) * flag(r < 0.5) * (1 - r)
    return {"town_fringe": band_gate(4, 16) * val("near_town") * 10, "undersized": spec, "undersized_remote": spec * val("bmv") * val("path_km"),
            "undersized_withdrawn": spec * val("withdrawal")}


def national_jurisdiction():
    f = flag(val("cap") > 50)
    risk = 2 * near("sssi", 100) + 1.5 * near("aonb", 100) + 1.5 * near("hp", 100) + 2 * val("flood")
    return {"national_days": 500 * f, "is_national": f, "national_risk": 30 * f * risk}


def voltage_cliff():
    cap, kv, mw, d = val("cap"), val("kv"), val("nearby_mw"), val("path_km")
    ramp = flag(cap.between(30, 40)) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cap - 30) / 10))
    hug = band_gate(45, 50)
    flags = near("sssi", 100) + near("aonb", 100) + near("hp", 100)
    step = flag(cap >= 30) * F.when(kv < 33, 10.0).when(kv == 33, 5.0).when(kv >= 132, -2.0).otherwise(0.0)
    return {
        "cliff": ramp, "cliff_no_headroom": ramp * flag(val("headroom") < 10) * 100, "threshold_hug": hug,
        "combined_mw": flag((cap > 30) & (cap + mw > 60)) * (cap + mw), "hug_risk": hug * flags * 10, "step_up": step, "step_up_reach": step * d,
    }


def administrative_rhythm():
    return {"dead_months": 15 * month_in(8, 12), "legacy_pace": 1 / (val("legacy") / (val("volume") + EPS) + 0.1), "fourth_quarter": 20 * month_in(10, 11, 12)}


def visual_agitation():
    cap, small = val("cap"), band_gate(0, 5)
    ref, ok = val("refused_km"), val("granted_km")
    return {
        "slope_view": small * val("gradient") * val("dens") * cap, "poles_view": small * val("poles") * val("dens"), "urban_view": small * val("urban") * cap,
        "hostility": 1 / (ref + 0.1), "hostility_ratio": (ok + 0.1) / (ref + 0.1), "refusal_next_door": flag(ref < 1),
    }


def topology_depth():
    cap, gov, nearest = val("cap"), val("governing_km"), val("sub_km")
    delta = F.greatest(gov - nearest, F.lit(0.0))
    return {
        "depth_km": delta, "depth_ratio": (nearest + 0.1) / (gov + 0.1), "depth_load": cap * delta,
        "haul": flag(cap > 5) * cap / (val("road_m") + 0.1), "roadside": flag(cap > 5) * flag(val("road_m") < 100) * cap,
        "per_head": cap / (val("dens") + 0.01), "urban_relief": -flag(val("urban") > 20) * cap,
    }


def cable_and_scarcity():
    cap, d, grad = val("cap"), val("path_km"), val("gradient")
    scarcity = val("site_agri") / (val("region_agri") + EPS)
    return {
        "cable_slope": d * grad, "cable_wet": d * val("wet"), "scarcity": scarcity, "scarcity_load": scarcity * cap * val("bmv"),
        "autumn_access": month_in(9, 10, 11) / (val("road_m") + 0.1) * grad * cap,
    }


def mid_band():
    cap, d, g = val("cap"), val("path_km"), band_gate(5, 10)
    parts = {
        "per_kv": F.try_divide(cap, val("kv")), "reach": d / cap, "isolated": 10 * flag((d > 3) & (val("line_density") < 0.5)), "export": cap / (val("export_mw") + 1),
        "pace": val("lpa_days") / (cap + 0.1), "farmland": 5 * val("bmv"), "neighbours": val("nearby"), "farm_reach": val("bmv") * d,
        "density": val("dens") * cap, "pole_density": val("poles") * val("dens"), "access": 1 / (val("road_m") + 0.1), "queue": val("queue_mw") / cap,
    }
    return {f"mid_{k}": F.when(g == 1, v).otherwise(0.0) for k, v in parts.items()}


def distribution_grit():
    cap, d, cross = val("cap"), val("path_km"), val("crossings")
    spot = either(band_gate(5, 7), band_gate(0.5, 1))
    return {
        "crossing_rate": flag(cap < 15) * cross / (d + EPS), "many_crossings": band_gate(1, 10) * flag(cross > 5) * 10, "per_volume": band_gate(5, 7) / (val("volume") + EPS),
        "over_headroom": band_gate(1, 10) * F.greatest(cap - val("headroom"), F.lit(0.0)), "micro_reach": band_gate(0.5, 1) * d,
        "grit_density": band_gate(5, 10) * val("dens") * cap, "good_land": band_gate(1, 10) * flag(val("grade") <= 2) * 5, "spot": 5 * spot,
        "slope_relief": -band_gate(1, 10) * val("gradient"), "crowd": band_gate(1, 5) * val("nearby"),
    }


def hazards():
    cap, small = val("cap"), flag(val("cap") < 10)
    r = val("path_km") / (cap + 0.1)
    return {
        "rail_load": small * val("rail") * cap, "flat_habitat": small * flag(val("gradient") < 2) * flag(val("ph_m") < 200) * 5, "stretch": small * flag(r > 2) * r,
        "best_grade": small * flag(val("grade") <= 2) * 10, "not_roof": band_gate(0, 1) * flag(cap > 0.05), "settlement_rail": band_gate(1, 10) * val("settlements") * (val("rail") + 1),
    }


def edge_inertia():
    cap, small, yrs, ratio = val("cap"), flag(val("cap") < 10), val("years_to_constraint"), val("gen_ratio")
    return {
        "utilised": small * val("utilisation") / 100 * cap, "customer_load": small * val("customers") * cap, "private_network": flag(cap < 15) * val("idno") / (cap + 0.5),
        "own_voltage": band_gate(1, 10) * cap / (val("service_mw") + 0.1), "constraint_soon": flag(cap < 15) * flag((val("constraint_m") < 1000) & (yrs > 0) & (yrs < 3)) * yrs,
        "saturated": small * flag(ratio > 1) * ratio, "served": band_gate(1, 10) * val("customers") * cap, "deprived": -band_gate(1, 10) / (val("deprivation") + 1),
    }


def authority_friction():
    p90, spread, slow = val("lpa_p90"), val("variance"), val("slow_share")
    return {"friction_queue": p90 * val("queue_mw"), "friction_spread": spread * val("cap"), "friction_slow": slow * near_count(["sssi", "sac", "spa", "aw", "ph"], 500),
            "contention": (val("queue_mw") + val("cap")) / (val("headroom") + EPS)}


def excess_over_threshold():
    cap, mw = val("cap"), val("nearby_mw")
    return {"over_10": over(cap, 10), "over_25": over(cap, 25), "over_50": over(mw, 50), "first_20": F.least(mw, F.lit(20.0)), "log_cap": F.log1p(cap)}


def storage_gate():
    s = val("storage") * val("cap")
    return {"storage_score": F.when(val("cap") < 1, 0.0).otherwise(s * 1.5)}


def physical_footprint():
    area, cap = val("site_agri") + 1, val("cap")
    return {"log_area": F.log1p(area), "mw_per_ha": cap / area, "sprawl": area / (cap + 1) * val("dens")}


def survey_wait():
    m = F.col("month")
    species = (  # survey window, and the habitat that asks for it
        (3, 6, near("ph", 100) * val("wet_habitat")),
        (5, 8, either(near("ph", 100) * flag(val("wood_habitat") == 1), near("aw", 100))),
        (11, 2, either(near("spa", 500), near("ph", 500) * val("coastal_habitat"))),
        (4, 7, near("sssi", 100) * flag(val("flower_habitat") == 1)),
    )
    waits = [flag(val("cap") >= 5) * months_to_window(m, a, b) * habitat for a, b, habitat in species]
    return {"survey_wait_months": F.greatest(*waits)}


def storage_variance():
    store, cap = val("storage_mwh"), val("cap")
    together = cap * store
    return {"co_location": together, "fire_safety": store * val("settlements"), "two_way_grid": store / (val("headroom") + EPS),
            "volatile_storage": store * val("variance"), "greenfield_hub": together * (1 - (val("industrial_share") + val("urban_share")))}


def tower_density():
    cap, towers = val("cap"), val("tower_density")
    return {"tower_scale": cap * towers, "tower_crossings": val("crossings") * towers, "tower_fringe": val("settlements") * towers,
            "sterilised_load": cap * val("sterilised_ha")}


def crossing_obstacles():
    n = val("crossings")
    return {"obstacle_density": n / (val("path_km") + EPS), "crossing_load": n * val("cap"), "crossing_poles": n * val("poles"),
            "encircled": (val("road_km") + val("rail_km")) * n}


def habitat_proximity():
    ph, aw, sac = (1 / (val(f"{n}_m") + 100) for n in ("ph", "aw", "sac"))
    lock = ph + aw + sac
    return {"wet_habitat_near": ph * val("wet_habitat"), "coastal_habitat_near": ph * val("coastal_habitat"), "ancient_woodland": aw * val("ancient"),
            "replanted_woodland": aw * (1 - val("ancient")), "site_extent": sac * val("sac_ha"), "triple_lock": lock, "triple_lock_load": val("cap") * lock}


def demographic_resistance():
    score = 3 * val("seniors") + 1.5 * val("group_u") + val("group_v")
    amenity = F.least(val("trail_m"), val("hp_m"))
    return {"resistance": score, "resistance_load": score * val("cap"), "amenity_defence": score / (amenity + 100), "rural_resistance": score / (val("dens") + EPS)}


def legacy_shield():
    km, n = F.coalesce(F.col("legacy_km"), F.lit(50.0)), val("legacy_count")
    shield = n / (km + EPS)
    return {"shield": shield, "shield_approval": shield * 0.5 + val("lpa_rate") * 0.5, "shielded_load": shield * val("cap"), "legacy_next_door": F.log1p(1 / (km + EPS))}


def ecological_drag():
    cap, d = val("cap"), val("sssi_m")
    decay = (2000 - F.least(d, F.lit(2000.0))) / 2000
    return {
        "decay_score": decay, "drag_high": flag((cap > 25) & (d < 2000)) * decay * cap, "shield_low": flag((cap < 10) & (d < 500)) * decay,
        "impact_zone": cap * 1.6 / (d + EPS), "drag_unclear": flag((cap >= 10) & (cap <= 25) & (d < 1000)), "drag_load": cap * decay,
    }


def best_land():
    cap, bmv = val("cap"), val("bmv")
    return {"poor_land_slope": (1 - bmv) * val("gradient"), "best_land_mid": flag((cap >= 15) & (cap <= 40)) * bmv, "best_land_large": flag(cap > 40) * bmv,
            "best_land_rare": bmv * (1 - val("region_bmv_pct") / 100)}


def authority_competence():
    exp, cap, days = val("experience"), val("cap"), val("lpa_days")
    return {"maturity_load": F.log1p(exp) * cap, "queue_per_case": val("queue_mw") / (exp + 1), "speed_density": val("dens") * cap / (days + EPS), "days_load": days * cap}


def physics_and_politics():
    n, pressure = val("crossings"), val("on_agreement") * 2 + val("bmv")
    return {"connection_friction": val("path_km") * (1 + n * n), "property_pressure": val("wealth") * val("dens"), "land_pressure": pressure, "land_pressure_load": pressure * val("cap")}


def uncertainty_paradox():
    clean = flag(near_count(["sssi", "sac", "spa", "aw", "ph"], 100) == 0)
    heritage, eco = flag((val("hp_m") < 500) | (val("trail_m") < 200)), flag((val("sssi_m") < 500) | (val("aw_m") < 500))
    return {"clean_but_large": clean * over(val("cap"), 10), "mitigation_cost": heritage * 5 + eco * 3 + val("bmv"), "mitigation_conflict": heritage * eco}


def sociological_friction():
    cap, energy = val("cap"), val("seniors") + val("group_u") + val("group_v")
    return {"resistance_energy": energy * cap, "rational_scaling": val("group_u") * over(cap, 25), "offline_small": val("group_v") * flag(cap < 10)}


def contractual_inertia():
    cap, on, large = val("cap"), val("on_agreement"), flag(val("cap") > 20)
    return {"active_owner": on * flag(cap < 5), "public_money": on * large * cap, "swap_good_land": on * val("bmv"), "swap_poor_land": on * (1 - val("bmv")),
            "scheme_depth": F.log1p(val("agreement_value")) * large}


FAMILIES: dict[str, Expr] = {f.__name__: f for f in (
    ecological_calendar, developer_competence, grid_physics, grid_contention, constraint_hard_soft, mobilisation, political_epochs,
    constraint_severity, social_saturation, authority_regime, zoning, regional_operator, constraint_hierarchy, wayleave, black_holes,
    small_context, edge_viability, speculator, national_jurisdiction, voltage_cliff, administrative_rhythm, visual_agitation, topology_depth,
    cable_and_scarcity, mid_band, distribution_grit, hazards, edge_inertia, authority_friction, excess_over_threshold, storage_gate,
    physical_footprint, survey_wait, storage_variance, tower_density, crossing_obstacles, habitat_proximity, demographic_resistance,
    legacy_shield, ecological_drag, best_land, authority_competence, physics_and_politics, uncertainty_paradox, sociological_friction,
    contractual_inertia,
)}


def add_features(df: DataFrame, families: Sequence[str] | None = None) -> DataFrame:
    """All outputs of the named families (every family by default) as new columns, in one projection."""
    out: dict[str, Column] = {}
    for name in families or FAMILIES:
        out |= FAMILIES[name]()
    return df.withColumns(out)


def named_site_risk(df: DataFrame, prefix: str, keywords: Sequence[str], out: str) -> DataFrame:
    """1 when any one-hot column whose name holds a keyword is set."""
    hits = [F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in df.columns if c.startswith(prefix) and any(k in c for k in keywords)]
    value = F.lit(0) if not hits else hits[0] if len(hits) == 1 else F.greatest(*hits)
    return df.withColumn(out, value)


def quantile_regime_flags(df: DataFrame, columns: Sequence[str], low: float = 0.25, high: float = 0.75) -> DataFrame:
    """0/1 columns below the lower and above the upper quantile of the whole column."""
    flags = {}
    for c in columns:
        edges = only_row(group_quantiles(df, [], c, [low, high], ["lo", "hi"]))
        flags |= {f"{c}_low": (F.col(c) <= edges["lo"]).cast("int"), f"{c}_high": (F.col(c) >= edges["hi"]).cast("int")}
    return df.withColumns(flags)


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-scores from one pass over all columns; constant columns become 0."""
    stats = only_row(df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]))
    return df.withColumns({
        c: F.when(stats[f"s_{c}"] > 0, (F.col(c) - stats[f"m_{c}"]) / stats[f"s_{c}"]).otherwise(0.0) for c in columns
    })


def traffic_light(years: Column, edges: Sequence[float]) -> Column:
    """3 for the soonest constraint down to 0 beyond the last edge."""
    out = F.lit(0)
    for level, edge in reversed(list(zip(range(len(edges), 0, -1), edges, strict=True))):
        out = F.when(years < edge, level).otherwise(out)
    return out


def neighbour_interactions(measures: Mapping[str, Column], diversity: Column) -> dict[str, Column]:
    return {f"diversity_x_{n}": diversity * c for n, c in measures.items()}


def dominant_profile(df: DataFrame, columns: Sequence[str], days: str, min_rows: int = 10) -> DataFrame:
    """Rows grouped by their largest demographic column: count and mean days, small groups dropped."""
    top = F.array_min(F.array(*[F.struct((-F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias("v"), F.lit(c).alias("name")) for c in columns]))
    grouped = df.groupBy(top["name"].alias("profile")).agg(F.count(F.lit(1)).alias("n"), F.avg(days).alias("mean_days"))
    return grouped.filter(F.col("n") > min_rows)
