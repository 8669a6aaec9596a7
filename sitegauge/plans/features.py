"""Queries over the feature families (FS-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegauge.operators import features as fs
from sitegauge.operators import windows as wn
from sitegauge.plans.bindings import rnd, rounded, with_ctes
from sitegauge.plans.registry import query

# Site inputs derived from the site key: name -> (factor, modulus, divisor); value = key*factor % modulus / divisor.
INPUTS = {
    "sssi_m": (37, 1009, 1), "sac_m": (41, 1511, 1), "spa_m": (43, 1301, 1), "aw_m": (47, 1201, 1), "ph_m": (53, 907, 1), "hp_m": (59, 1607, 1),
    "aonb_m": (61, 1709, 1), "np_m": (67, 1801, 1), "kv": (1, 1, 1), "storage": (3, 2, 1), "chp": (7, 2, 1), "ohm": (71, 97, 10), "fault": (73, 211, 1),
    "dens": (79, 101, 100), "sub_km": (83, 103, 10), "line_km": (89, 107, 10), "headroom": (97, 109, 1), "queue_mw": (101, 113, 10), "years_to_constraint": (103, 11, 1),
    "greenbelt": (107, 2, 1), "wealth": (109, 127, 10), "seniors": (113, 131, 100), "group_u": (127, 137, 100), "group_v": (131, 139, 100), "urban": (137, 89, 1),
    "gradient": (139, 149, 10), "agri": (149, 101, 1), "bmv": (151, 2, 1), "nearby": (157, 17, 1), "lpa_days": (163, 251, 1), "variance": (167, 151, 100),
    "workload": (173, 157, 1), "residential": (179, 163, 1), "industrial": (181, 7, 1), "path_km": (191, 167, 10), "crossings": (193, 13, 1), "named": (197, 2, 1),
    "line_density": (199, 173, 100), "nearby_mw": (211, 179, 1), "near_town": (223, 2, 1), "withdrawal": (227, 181, 1000), "flood": (229, 2, 1), "legacy": (233, 191, 10),
    "volume": (239, 193, 10), "poles": (241, 19, 1), "refused_km": (251, 197, 50), "granted_km": (257, 199, 10), "governing_km": (263, 223, 10), "road_m": (269, 227, 1),
    "wet": (271, 229, 100), "site_agri": (277, 233, 10), "region_agri": (281, 239, 1), "export_mw": (283, 241, 10), "grade": (293, 6, 1), "rail": (307, 2, 1), "settlements": (311, 5, 1),
    "utilisation": (313, 101, 1), "customers": (317, 251, 10), "idno": (331, 3, 1), "service_mw": (337, 257, 10), "constraint_m": (347, 2003, 1), "gen_ratio": (349, 263, 100),
    "deprivation": (353, 11, 1), "lpa_p90": (359, 269, 1), "slow_share": (367, 271, 1000),
    "storage_mwh": (373, 277, 10), "industrial_share": (379, 281, 1000), "urban_share": (383, 283, 1000), "tower_density": (389, 293, 100), "sterilised_ha": (397, 307, 10),
    "road_km": (401, 311, 10), "rail_km": (409, 313, 10), "wet_habitat": (419, 2, 1), "coastal_habitat": (421, 2, 1), "ancient": (431, 2, 1), "sac_ha": (433, 317, 1),
    "trail_m": (439, 1409, 1), "legacy_km": (443, 331, 10), "legacy_count": (449, 9, 1), "lpa_rate": (457, 337, 1000), "region_bmv_pct": (461, 101, 1), "experience": (463, 347, 1),
    "wood_habitat": (487, 3, 1), "flower_habitat": (491, 5, 1), "on_agreement": (467, 2, 1), "agreement_value": (479, 9973, 1),
}


def wide(t):
    """The wide site table: capacity, month and year of each application plus derived measures."""
    key = F.col("site_id")
    base = t.places.select("site_id", (F.col("capacity_mw") * 1.2 - 0.1).alias("cap"), F.month("submission_date").alias("month"), (F.year("submission_date") + 20).alias("year"))
    derived = {n: (key * f % m / d).cast("double") for n, (f, m, d) in INPUTS.items()}
    derived["kv"] = F.when(key % 4 == 0, 11.0).when(key % 4 == 1, 33.0).when(key % 4 == 2, 66.0).otherwise(132.0)
    derived["sssi_m"] = F.when(key % 9 != 0, derived["sssi_m"])
    derived["operator"] = F.when(key % 3 == 0, "A").when(key % 3 == 1, "B").otherwise("C")
    return base.withColumns(derived)


_DERIVED = ", ".join(
    f"CAST(site_id*{f}%{m} AS DOUBLE)/{d} AS {n}" for n, (f, m, d) in INPUTS.items() if n not in ("kv", "sssi_m")
)
WIDE = f"""{with_ctes('sites')}, wide AS (SELECT site_id, capacity_mw*1.2e0-0.1e0 AS cap, CAST(month(submission_date) AS INTEGER) AS month, CAST(year(submission_date)+20 AS INTEGER) AS year,
 CASE site_id%4 WHEN 0 THEN 11e0 WHEN 1 THEN 33e0 WHEN 2 THEN 66e0 ELSE 132e0 END AS kv, CASE WHEN site_id%9=0 THEN 5000e0 ELSE CAST(site_id*37%1009 AS DOUBLE) END AS sssi_m,
 CASE site_id%3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS operator, {_DERIVED} FROM sites)"""


def b(lo, hi=None):
    return f"(cap>={lo} AND cap<{hi})::INT" if hi is not None else f"(cap>={lo})::INT"


def nr(names, limit):
    return "(" + "+".join(f"({n}_m<{limit})::INT" for n in names.split()) + ")"


def gr(*parts):
    return f"greatest({','.join(parts)})"


_N = nr("sssi sac spa aw ph", 100)
_N50 = nr("sssi aw sac hp ph", 50)
_W = "(month IN (9,10,11,12,1,2))::INT"
_LIGHT = "CASE WHEN headroom<0 THEN 2 WHEN headroom<=10 THEN 1 ELSE 0 END"
_SPARE = "greatest(112-lpa_days,0)"
_FAST = "(lpa_days<112)::INT"
_R = "(cap/(nearby_mw/(nearby+1e-6)+1e-6))"
_SPEC = f"({b(4, 16)}*({_R}<0.5)::INT*(1-{_R}))"
_RAMP = "((cap BETWEEN 30 AND 40)::INT*greatest(0,least(1,(cap-30)/10)))"
_STEP = "((cap>=30)::INT*CASE WHEN kv<33 THEN 10 WHEN kv=33 THEN 5 WHEN kv>=132 THEN -2 ELSE 0 END)"
_DEPTH = "greatest(governing_km-sub_km,0)"
_SCARCE = "(site_agri/(region_agri+1e-6))"
_SMALL = "(cap<10)::INT"
_REACH = "(path_km/(cap+0.1))"
_WAIT = "CASE WHEN {i} THEN 0 ELSE ({s}-month+12)%12 END"

TWINS = {
    "ecological_calendar": {"micro_survey": f"{b(0, 1)}*({_N}>0)::INT*{_W}", "mid_survey": f"{b(5, 10)}*{_N}*{_W}", "large_survey": f"-{b(10)}*{_N}*{_W}"},
    "developer_competence": {"mw_per_kv": f"{b(1)}*cap/(kv+1e-6)", "mid_storage": f"{b(5, 10)}*storage", "large_storage": f"{b(10)}*storage", "large_chp": f"{b(10)}*chp"},
    "grid_physics": {"thermal": f"{b(1)}*cap*ohm", "fault_density": f"{b(5, 10)}*fault*(dens+0.1)", "closeness": f"{b(10)}/(least(sub_km,line_km)+0.1)"},
    "grid_contention": {"light": _LIGHT, "safe_but_full": f"{b(1, 5)}*(headroom>10 AND queue_mw>2)::INT*queue_mw",
        "mid_timing": f"{b(5, 10)}*CASE WHEN years_to_constraint<2 THEN 2 WHEN years_to_constraint>5 THEN 0.5 ELSE 1 END", "mid_relief": f"{b(5, 10)}*(headroom>50)::INT*0.5",
        "large_balance": f"{b(10)}*((headroom<0)::INT+(headroom>50)::INT-(headroom BETWEEN 0 AND 20)::INT)", "large_deferred": f"{b(10)}*(years_to_constraint>4)::INT"},
    "constraint_hard_soft": {"small_hard": f"{b(1, 5)}*5*{nr('sssi aw sac aonb hp', 100)}", "mid_landscape": f"{b(5, 10)}*10*{gr(nr('aonb', 100), nr('np', 100), nr('hp', 100), 'greenbelt')}",
        "mid_habitat": f"{b(5, 10)}*2*{gr(nr('sssi', 100), nr('ph', 100), nr('sac', 100))}", "large_habitat": f"{b(10)}*5*{nr('ph', 100)}", "large_designed_out": f"-2*{b(10)}*{gr(nr('aw', 100), nr('sssi', 100))}"},
    "mobilisation": {"micro_wealth": f"{b(0, 1)}*wealth/(dens+0.1)", "mid_groups": f"{b(1, 10)}*(3*seniors+1.5*group_u+group_v)*(urban+1)", "large_groups": f"{b(10)}*(3*seniors+0.5*group_u+group_v)*(gradient+1)"},
    "political_epochs": {"epoch": "CASE WHEN year<=2015 THEN 0 WHEN year=2016 THEN 1 WHEN year<=2019 THEN 2 ELSE 3 END", "after_2020": f"{b(1)}*(year>=2020)::INT", "after_2024": f"{b(5)}*(year>=2024)::INT"},
    "constraint_severity": {"small_severity": f"(10*{nr('sssi aw sac', 50)}+({nr('sssi aw sac', 50)}=0 AND agri>50)::INT*10)*{b(1, 5)}", "mid_many": f"{b(5, 10)}*({_N50}>=2)::INT", "mid_few": f"{b(5, 10)}*({_N50}<2)::INT",
        "wide_none": f"{b(5, 15)}*({_N50}=0)::INT", "wide_many": f"{b(5, 15)}*({_N50}>=2)::INT", "large_severity": f"{b(10)}*(1-bmv)*({nr('ph', 50)}+{nr('sssi', 50)}+1)*10"},
    "social_saturation": {"micro_level": f"{b(0, 1)}*CASE WHEN nearby<=1 THEN 0 WHEN nearby<=3 THEN 1 ELSE 2 END", "small_pressure": f"{b(1, 5)}*pow(nearby,1.5)*(dens+0.1)*cap", "wide_fatigue": f"{b(5, 15)}*(nearby>5)::INT*nearby",
        "large_few": f"{b(10)}*(nearby<=3)::INT", "large_some": f"{b(10)}*(nearby>3 AND nearby<=10)::INT", "large_many": f"{b(10)}*(nearby>10)::INT"},
    "authority_regime": {"small_fast": f"{b(0, 5)}*{_FAST}*{_SPARE}", "mid_fast": f"{b(5, 10)}*{_FAST}*{_SPARE}*variance", "large_fast": f"{b(10)}*{_FAST}*{_SPARE}", "micro_bmv": f"{b(0, 1)}*bmv", "mid_bmv": "(cap>2 AND cap<10)::INT*bmv*cap",
        "large_bmv": f"{b(10)}*bmv*10", "low_voltage": f"{b(1, 5)}*(kv<33)::INT*cap", "mid_workload": f"{b(5, 15)}*workload"},
    "zoning": {"residential_load": f"{b(0, 5)}*residential/(industrial+1)*cap", "mid_urban": f"{b(5, 10)}*(urban>15)::INT", "large_urban": f"-{b(10)}*(urban>50)::INT", "industrial_use": "industrial"},
    "regional_operator": {"operator_score": "CASE operator WHEN 'A' THEN 0.8 WHEN 'B' THEN 0.3 ELSE 0.5 END", "operator_load": f"{_SMALL}*CASE operator WHEN 'A' THEN 0.8 WHEN 'B' THEN 0.3 ELSE 0.5 END*cap"},
    "constraint_hierarchy": {"top_constraint": gr(*[f"{w}*{nr(n, 50)}" for n, w in (("hp", 1.8), ("aonb", 1.4), ("ph", 1.1), ("sssi", 1.6), ("sac", 0.9))])},
    "wayleave": {"wayleave": "path_km*(1+5*dens)", "wayleave_crossings": "path_km*(1+5*dens)+3*crossings", "wayleave_scaled": "(path_km*(1+5*dens)+3*crossings)*ln(1+cap)"},
    "black_holes": {"named_site": "named", "named_light": f"named*{_LIGHT}", "weak_reach": f"{b(1)}*(kv<33)::INT*path_km*cap"},
    "small_context": {"micro_wealth_density": f"{b(0, 5)}*wealth*dens", "micro_open_farm": f"{b(0, 5)}*agri*(1-dens)", "farm_and_industry": f"-{b(1, 5)}*(agri>50 AND industrial>1)::INT", "density_load": f"{b(1, 5)}*dens*cap", "line_load": f"{b(1, 5)}*line_density*cap"},
    "edge_viability": {"fault_share": f"{b(1, 5)}*cap/(fault+1e-6)", "weak_voltage": f"{b(5, 15)}*(kv<33)::INT*cap", "reach_per_mw": f"{b(1, 15)}*path_km/(cap+1e-6)", "constrained_reach": f"{b(5, 15)}*path_km*(1+{_N})"},
    "speculator": {"town_fringe": f"{b(4, 16)}*near_town*10", "undersized": _SPEC, "undersized_remote": f"{_SPEC}*bmv*path_km", "undersized_withdrawn": f"{_SPEC}*withdrawal"},
    "national_jurisdiction": {"national_days": "500*(cap>50)::INT", "is_national": "(cap>50)::INT", "national_risk": f"30*(cap>50)::INT*(2*{nr('sssi', 100)}+1.5*{nr('aonb', 100)}+1.5*{nr('hp', 100)}+2*flood)"},
    "voltage_cliff": {"cliff": _RAMP, "cliff_no_headroom": f"{_RAMP}*(headroom<10)::INT*100", "threshold_hug": b(45, 50), "combined_mw": "(cap>30 AND cap+nearby_mw>60)::INT*(cap+nearby_mw)", "hug_risk": f"{b(45, 50)}*{nr('sssi aonb hp', 100)}*10", "step_up": _STEP, "step_up_reach": f"{_STEP}*path_km"},
    "administrative_rhythm": {"dead_months": "15*(month IN (8,12))::INT", "legacy_pace": "1/(legacy/(volume+1e-6)+0.1)", "fourth_quarter": "20*(month>=10)::INT"},
    "visual_agitation": {"slope_view": f"{b(0, 5)}*gradient*dens*cap", "poles_view": f"{b(0, 5)}*poles*dens", "urban_view": f"{b(0, 5)}*urban*cap", "hostility": "1/(refused_km+0.1)", "hostility_ratio": "(granted_km+0.1)/(refused_km+0.1)", "refusal_next_door": "(refused_km<1)::INT"},
    "topology_depth": {"depth_km": _DEPTH, "depth_ratio": "(sub_km+0.1)/(governing_km+0.1)", "depth_load": f"cap*{_DEPTH}", "haul": "(cap>5)::INT*cap/(road_m+0.1)", "roadside": "(cap>5)::INT*(road_m<100)::INT*cap", "per_head": "cap/(dens+0.01)", "urban_relief": "-(urban>20)::INT*cap"},
    "cable_and_scarcity": {"cable_slope": "path_km*gradient", "cable_wet": "path_km*wet", "scarcity": _SCARCE, "scarcity_load": f"{_SCARCE}*cap*bmv", "autumn_access": "(month BETWEEN 9 AND 11)::INT/(road_m+0.1)*gradient*cap"},
    "mid_band": {f"mid_{k}": f"CASE WHEN cap>=5 AND cap<10 THEN {v} ELSE 0 END" for k, v in {
        "per_kv": "cap/kv", "reach": "path_km/cap", "isolated": "10*(path_km>3 AND line_density<0.5)::INT", "export": "cap/(export_mw+1)", "pace": "lpa_days/(cap+0.1)", "farmland": "5*bmv", "neighbours": "nearby",
        "farm_reach": "bmv*path_km", "density": "dens*cap", "pole_density": "poles*dens", "access": "1/(road_m+0.1)", "queue": "queue_mw/cap"}.items()},
    "distribution_grit": {"crossing_rate": "(cap<15)::INT*crossings/(path_km+1e-6)", "many_crossings": f"{b(1, 10)}*(crossings>5)::INT*10", "per_volume": f"{b(5, 7)}/(volume+1e-6)", "over_headroom": f"{b(1, 10)}*greatest(cap-headroom,0)", "micro_reach": f"{b(0.5, 1)}*path_km",
        "grit_density": f"{b(5, 10)}*dens*cap", "good_land": f"{b(1, 10)}*(grade<=2)::INT*5", "spot": f"5*{gr(b(5, 7), b(0.5, 1))}", "slope_relief": f"-{b(1, 10)}*gradient", "crowd": f"{b(1, 5)}*nearby"},
    "hazards": {"rail_load": f"{_SMALL}*rail*cap", "flat_habitat": f"{_SMALL}*(gradient<2)::INT*(ph_m<200)::INT*5", "stretch": f"{_SMALL}*({_REACH}>2)::INT*{_REACH}", "best_grade": f"{_SMALL}*(grade<=2)::INT*10", "not_roof": f"{b(0, 1)}*(cap>0.05)::INT", "settlement_rail": f"{b(1, 10)}*settlements*(rail+1)"},
    "edge_inertia": {"utilised": f"{_SMALL}*utilisation/100*cap", "customer_load": f"{_SMALL}*customers*cap", "private_network": "(cap<15)::INT*idno/(cap+0.5)", "own_voltage": f"{b(1, 10)}*cap/(service_mw+0.1)",
        "constraint_soon": "(cap<15)::INT*(constraint_m<1000 AND years_to_constraint>0 AND years_to_constraint<3)::INT*years_to_constraint", "saturated": f"{_SMALL}*(gen_ratio>1)::INT*gen_ratio", "served": f"{b(1, 10)}*customers*cap", "deprived": f"-{b(1, 10)}/(deprivation+1)"},
    "authority_friction": {"friction_queue": "lpa_p90*queue_mw", "friction_spread": "variance*cap", "friction_slow": f"slow_share*{nr('sssi sac spa aw ph', 500)}", "contention": "(queue_mw+cap)/(headroom+1e-6)"},
    "excess_over_threshold": {"over_10": "greatest(cap-10,0)", "over_25": "greatest(cap-25,0)", "over_50": "greatest(nearby_mw-50,0)", "first_20": "least(nearby_mw,20)", "log_cap": "ln(1+cap)"},
    "storage_gate": {"storage_score": "CASE WHEN cap<1 THEN 0 ELSE storage*cap*1.5 END"},
    "physical_footprint": {"log_area": "ln(2+site_agri)", "mw_per_ha": "cap/(site_agri+1)", "sprawl": "(site_agri+1)/(cap+1)*dens"},
    "survey_wait": {"survey_wait_months": f"{b(5)}*" + gr(*[f"({_WAIT.format(i=i, s=s)})*({h})::INT" for i, s, h in (
        ("month BETWEEN 3 AND 6", 3, "ph_m<100 AND wet_habitat=1"), ("month BETWEEN 5 AND 8", 5, "(ph_m<100 AND wood_habitat=1) OR aw_m<100"),
        ("(month>=11 OR month<=2)", 11, "spa_m<500 OR (ph_m<500 AND coastal_habitat=1)"), ("month BETWEEN 4 AND 7", 4, "sssi_m<100 AND flower_habitat=1"))])},
}


_NEAR1 = {n: f"(1/({n}_m+100))" for n in ("ph", "aw", "sac")}
_LOCK = "(" + "+".join(_NEAR1.values()) + ")"
_RES = "(3*seniors+1.5*group_u+group_v)"
_SHIELD = "(legacy_count/(legacy_km+1e-6))"
_DECAY = "((2000-least(sssi_m,2000))/2000)"
_LAND = "(on_agreement*2+bmv)"
_HERITAGE, _ECO = "(hp_m<500 OR trail_m<200)::INT", "(sssi_m<500 OR aw_m<500)::INT"

TWINS |= {
    "storage_variance": {"co_location": "cap*storage_mwh", "fire_safety": "storage_mwh*settlements", "two_way_grid": "storage_mwh/(headroom+1e-6)", "volatile_storage": "storage_mwh*variance",
        "greenfield_hub": "cap*storage_mwh*(1-(industrial_share+urban_share))"},
    "tower_density": {"tower_scale": "cap*tower_density", "tower_crossings": "crossings*tower_density", "tower_fringe": "settlements*tower_density", "sterilised_load": "cap*sterilised_ha"},
    "crossing_obstacles": {"obstacle_density": "crossings/(path_km+1e-6)", "crossing_load": "crossings*cap", "crossing_poles": "crossings*poles", "encircled": "(road_km+rail_km)*crossings"},
    "habitat_proximity": {"wet_habitat_near": f"{_NEAR1['ph']}*wet_habitat", "coastal_habitat_near": f"{_NEAR1['ph']}*coastal_habitat", "ancient_woodland": f"{_NEAR1['aw']}*ancient", "replanted_woodland": f"{_NEAR1['aw']}*(1-ancient)",
        "site_extent": f"{_NEAR1['sac']}*sac_ha", "triple_lock": _LOCK, "triple_lock_load": f"cap*{_LOCK}"},
    "demographic_resistance": {"resistance": _RES, "resistance_load": f"{_RES}*cap", "amenity_defence": f"{_RES}/(least(trail_m,hp_m)+100)", "rural_resistance": f"{_RES}/(dens+1e-6)"},
    "legacy_shield": {"shield": _SHIELD, "shield_approval": f"{_SHIELD}*0.5+lpa_rate*0.5", "shielded_load": f"{_SHIELD}*cap", "legacy_next_door": "ln(1+1/(legacy_km+1e-6))"},
    "ecological_drag": {"decay_score": _DECAY, "drag_high": f"(cap>25 AND sssi_m<2000)::INT*{_DECAY}*cap", "shield_low": f"(cap<10 AND sssi_m<500)::INT*{_DECAY}", "impact_zone": "cap*1.6/(sssi_m+1e-6)",
        "drag_unclear": "(cap>=10 AND cap<=25 AND sssi_m<1000)::INT", "drag_load": f"cap*{_DECAY}"},
    "best_land": {"poor_land_slope": "(1-bmv)*gradient", "best_land_mid": "(cap>=15 AND cap<=40)::INT*bmv", "best_land_large": "(cap>40)::INT*bmv", "best_land_rare": "bmv*(1-region_bmv_pct/100)"},
    "authority_competence": {"maturity_load": "ln(1+experience)*cap", "queue_per_case": "queue_mw/(experience+1)", "speed_density": "dens*cap/(lpa_days+1e-6)", "days_load": "lpa_days*cap"},
    "physics_and_politics": {"connection_friction": "path_km*(1+crossings*crossings)", "property_pressure": "wealth*dens", "land_pressure": _LAND, "land_pressure_load": f"{_LAND}*cap"},
    "uncertainty_paradox": {"clean_but_large": f"({_N}=0)::INT*greatest(cap-10,0)", "mitigation_cost": f"{_HERITAGE}*5+{_ECO}*3+bmv", "mitigation_conflict": f"{_HERITAGE}*{_ECO}"},
    "sociological_friction": {"resistance_energy": "(seniors+group_u+group_v)*cap", "rational_scaling": "group_u*greatest(cap-25,0)", "offline_small": "group_v*(cap<10)::INT"},
    "contractual_inertia": {"active_owner": "on_agreement*(cap<5)::INT", "public_money": "on_agreement*(cap>20)::INT*cap", "swap_good_land": "on_agreement*bmv", "swap_poor_land": "on_agreement*(1-bmv)",
        "scheme_depth": "ln(1+agreement_value)*(cap>20)::INT"},
}


def _add(family):
    names = list(TWINS[family])
    sql = f"{WIDE} SELECT site_id, " + ", ".join(f"{rnd(e, 6 if family == "habitat_proximity" else 4)} AS {n}" for n, e in TWINS[family].items()) + " FROM wide"

    @query(f"fs_{family}", sql)
    def _(t):
        out = fs.add_features(wide(t), [family]).select("site_id", *names)
        return rounded(out, names, 6 if family == "habitat_proximity" else 4)


for _family in fs.FAMILIES:
    _add(_family)


_EVERY = {n: e for f in fs.FAMILIES for n, e in TWINS[f].items()}


@query("fs_all_families", f"{WIDE} SELECT site_id, " + ", ".join(f"{rnd(e, 4)} AS {n}" for n, e in _EVERY.items()) + " FROM wide")
def _(t):
    """Every family in one projection over the wide table, as the scoring job uses it."""
    return rounded(fs.add_features(wide(t)).select("site_id", *_EVERY), list(_EVERY))


@query(
    "fs13_quantile_regime_flags",
    f"{WIDE}, q AS (SELECT quantile_cont(dens,0.25) a, quantile_cont(dens,0.75) b, quantile_cont(cap,0.25) c, quantile_cont(cap,0.75) d FROM wide) SELECT site_id, (dens<=a)::INT AS dens_low, (dens>=b)::INT AS dens_high, (cap<=c)::INT AS cap_low, (cap>=d)::INT AS cap_high FROM wide, q",
)
def _(t):
    return fs.quantile_regime_flags(wide(t).select("site_id", "dens", "cap"), ["dens", "cap"]).drop("dens", "cap")


@query("fs15_named_site_risk", "SELECT p_partkey, (p_type IN ('PROMO','ECONOMY'))::INT AS risk FROM part")
def _(t):
    from sitegauge.operators.clean import one_hot

    hot = one_hot(t.read("part").select("p_partkey", "p_type"), "p_type", ["PROMO", "ECONOMY", "SMALL", "LARGE"])
    return fs.named_site_risk(hot, "p_type_", ["promo", "econ"], "risk").select("p_partkey", "risk")


@query(
    "fs16_standardise_interactions",
    f"{WIDE}, x AS (SELECT site_id, cap*dens AS a, path_km*gradient AS b FROM wide), s AS (SELECT avg(a) am, stddev_pop(a) asd, avg(b) bm, stddev_pop(b) bsd FROM x) SELECT site_id, {rnd('(a-am)/asd', 5)} AS cap_density, {rnd('(b-bm)/bsd', 5)} AS cable_slope FROM x, s",
)
def _(t):
    x = wide(t).select("site_id", (F.col("cap") * F.col("dens")).alias("cap_density"), (F.col("path_km") * F.col("gradient")).alias("cable_slope"))
    return rounded(fs.standardise(x, ["cap_density", "cable_slope"]), ["cap_density", "cable_slope"], 5)


@query(
    "fs20_dominant_profile",
    f"{WIDE}, d AS (SELECT site_id%400 AS days, CASE greatest(seniors,group_u,group_v) WHEN group_u THEN 'group_u' WHEN group_v THEN 'group_v' ELSE 'seniors' END AS profile FROM wide) SELECT profile, count(*) AS n, {rnd('avg(days)')} AS mean_days FROM d GROUP BY 1 HAVING count(*)>10",
)
def _(t):
    w = wide(t).withColumn("days", F.col("site_id") % 400)
    return rounded(fs.dominant_profile(w, ["seniors", "group_u", "group_v"], "days"), ["mean_days"])


@query("fs_era_bands", f"{WIDE} SELECT site_id, CAST(CASE WHEN year<=2014 THEN 0 WHEN year<=2017 THEN 1 WHEN year<=2020 THEN 2 ELSE 3 END AS INTEGER) AS era, {rnd('CASE WHEN year<=2014 THEN 0 WHEN year<=2017 THEN 1 WHEN year<=2020 THEN 2 ELSE 3 END*lpa_days')} AS era_load FROM wide")
def _(t):
    era = wn.band(F.col("year"), [0, 2015, 2018, 2021]).cast("int")
    return rounded(wide(t).select("site_id", era.alias("era"), (era * F.col("lpa_days")).alias("era_load")), ["era_load"])


@query(
    "fs11_traffic_light",
    f"{WIDE} SELECT site_id, CAST(CASE WHEN years_to_constraint<1 THEN 3 WHEN years_to_constraint<3 THEN 2 WHEN years_to_constraint<6 THEN 1 ELSE 0 END AS INTEGER) AS light FROM wide",
)
def _(t):
    return wide(t).select("site_id", fs.traffic_light(F.col("years_to_constraint"), (1, 3, 6)).alias("light"))


@query(
    "fs17_post_knn_interaction",
    f"{WIDE} SELECT site_id, {rnd('variance*cap')} AS diversity_x_cap, {rnd('variance*lpa_days')} AS diversity_x_days FROM wide",
)
def _(t):
    out = fs.neighbour_interactions({"cap": F.col("cap"), "days": F.col("lpa_days")}, F.col("variance"))
    return rounded(wide(t).select("site_id", *[c.alias(n) for n, c in out.items()]), list(out))
