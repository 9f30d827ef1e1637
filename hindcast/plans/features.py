"""Feature blocks: named presets of the generic operators.

A block is a function ``DataFrame -> DataFrame`` that adds its columns to the run
frame.  Blocks are added to one frame (no join per block); blocks with the same
partition key that follow each other share one exchange and sort.

Run frame (one row per group and runner): group_id, line, entity, person_a,
person_b, parent, parent2, day, day_no, outcome, venue, surface, distance, going,
class_level, frame, pass_1, pass_3, pass_4, run_time, time_diff, last_3f,
first_3f, weight, weight_diff, impost, prize, t4, t3, t1, gear, sex, variant,
price, expected_rank, expected_time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S
from ..operators.calendar import before_group, global_before, smoothed, trailing_days, variant_index
from ..operators.history import COPY, ewm, ewm_recursive, history, lag, last_k, own_keys, past, seq
from ..operators.metrics import entropy
from ..operators.quantiles import expanding_mode
from ..operators.relative import kernel_sum, rank, standing, totals
from ..operators.slices import day_cells, last_rows, totals_before_group
from ..plans.hot import deal

KEYS = ["group_id", "line", "entity", "person_a"]
ENTITY_ORDER = ["day_no", "group_id", "line", "person_a"]
ROW_ORDER = ["day_no", "group_id", "line", "entity", "person_a"]

# Venue codes 1..10 and what they stand for.
LEFT_VENUES = [4, 5, 7]
LONG_STRAIGHT_VENUES = [4, 5, 7, 8, 9]
SLOPE_VENUES = [5, 6, 7, 9]
VENUE_REGION = {1: "N", 2: "N", 3: "E", 4: "E", 5: "E", 6: "E", 7: "W", 8: "W", 9: "W", 10: "W"}
AFFILIATION_REGION = {1: "E", 2: "W", 3: "L", 4: "O"}
TRAVEL_LOAD = {"EW": 1.0, "WE": 1.0, "EN": 0.7, "NE": 0.7, "WN": 0.8, "NW": 0.8}
# Load of a hop from or to an unknown region; weights of travel, short turn, long rest and runs since a rest.
UNKNOWN_LOAD = 0.4
ROTATION = (0.35, 0.35, 0.15, 0.15)
# Priors and smoothing weights.
WIN_PRIOR, TOP3_PRIOR = 0.08, 0.25
SMALL_FIELD, COLLAPSE_RANK = 10, 10

BLOCKS: dict[str, Callable[[DataFrame], DataFrame]] = {}

win = lambda: (F.col("outcome") == 1).cast("int")
top3 = lambda: (F.col("outcome") <= 3).cast("int")
flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")


def block(fn):
    BLOCKS[fn.__name__] = fn
    return fn


def build(df: DataFrame, names: list[str]) -> DataFrame:
    """Add the named blocks; every block sees only the run frame's own columns plus
    what earlier blocks added."""
    for n in names:
        before = set(df.columns)
        out = BLOCKS[n](df)
        fresh = [c for c in out.columns if c not in before]
        df = out.select(*df.columns, *fresh)
    return df


def _entity(df: DataFrame, **specs) -> DataFrame:
    return history(df, "entity", ENTITY_ORDER, **specs)


def _rate(hits: str, n: str) -> Column:
    return F.coalesce(F.try_divide(hits, n), F.lit(0.0))


def _flag_std(hits: str, n: str) -> Column:
    """Sample deviation of n flags, from how many are 1."""
    s, n = F.col(hits).cast("double"), F.col(n)
    return F.sqrt(F.try_divide(F.greatest(s - F.try_divide(s * s, n), F.lit(0.0)), n - 1))


def _flag_quantile(hits: str, n: str, q: float) -> Column:
    """Interpolated quantile of n flags, from how many are 1."""
    at, zeros = (F.col(n) - 1) * F.lit(q), F.col(n) - F.col(hits)
    return F.when(F.floor(at) >= zeros, 1.0).when(F.ceil(at) < zeros, 0.0).otherwise(at - F.floor(at))


def _keyed_rates(df: DataFrame, keys: list[str], **names: Column) -> DataFrame:
    """Expanding means of conditions per (entity-like) keys, 0 without history."""
    out = history(df, keys, ENTITY_ORDER if "entity" in keys else ROW_ORDER, **{n: past("mean", c, default=0.0) for n, c in names.items()})
    return out


def _venue_kinds(df: DataFrame) -> DataFrame:
    v = F.col("venue")
    return df.withColumn("__rot", v.isin(LEFT_VENUES)).withColumn("__str", v.isin(LONG_STRAIGHT_VENUES)).withColumn("__slp", v.isin(SLOPE_VENUES))


def _is_lead() -> Column:
    return (F.col("pass_1") == 1).cast("int")


@block
def base_attributes(df):
    return df.withColumn("field_no", F.col("frame") * 100 + F.col("line"))


@block
def history_stats(df):
    df = _entity(df, __money=past("sum", "prize", default=0))
    df = df.withColumn("__career", F.col("__money") + F.col("prize"))
    df = totals(df, "group_id", __lvl=F.avg("__career"), __wl=F.avg(F.when(F.col("outcome") == 1, F.col("__career"))))
    specs = {"run_count": seq(), "__prev": lag("day_no"), "mean_rank_5": last_k("mean", "outcome", 5), "mean_time_diff_5": last_k("mean", "time_diff", 5, default=3.0)}
    for i in range(1, 6):
        specs |= {f"lag{i}_rank": lag("outcome", i), f"lag{i}_time_diff": lag("time_diff", i, 3.0), f"lag{i}_race_level": lag("__lvl", i, 0.0),
                  f"lag{i}_winner_level": lag(F.coalesce("__wl", F.lit(0.0)), i, 0.0), f"lag{i}_grade": lag(F.col("class_level").cast("string"), i, "missing")}
    df = _entity(df, **specs)
    return df.withColumn("interval", F.col("day_no") - F.col("__prev")).drop("__money", "__career", "__lvl", "__wl", "__prev")


@block
def jockey_stats(df):
    df = trailing_days(df, "person_a", "day", {"__n": F.lit(1), "__w": win(), "__t": top3(), "__r": F.col("outcome")}, [365])
    return df.select(
        "*", F.col("__n_365d").alias("jockey_n_races"), _rate("__w_365d", "__n_365d").alias("jockey_win_rate"),
        _rate("__t_365d", "__n_365d").alias("jockey_top3_rate"), _rate("__r_365d", "__n_365d").alias("jockey_avg_rank"),
    ).drop("__n_365d", "__w_365d", "__t_365d", "__r_365d")


@block
def pace_stats(df):
    t, l = F.col("run_time"), F.col("last_3f")
    df = df.withColumn("__pci", F.when((t > l) & (l > 0), F.try_divide(l, t - l) * 100))
    df = totals(df, "group_id", __size=F.count(F.lit(1)))
    df = _entity(
        df, last_nige_rate=last_k("mean", _is_lead(), 5, default=0.0), avg_pci=last_k("mean", "__pci", 5, default=50.0),
        avg_first_corner_norm=last_k("mean", F.col("pass_1") / F.col("__size"), 5, default=0.5),
    )
    return df.drop("__pci", "__size")


@block
def pace_pressure_stats(df):
    df = _entity(df, __rate=last_k("mean", _is_lead(), 5, default=0.0), __exp=last_k("count", _is_lead(), 20))
    df = df.withColumn("nige_score", F.col("__rate") * F.sqrt(F.col("__exp") / (F.col("__exp") + 5.0)))
    df = df.withColumn("__cand", (F.col("__rate") > 0.2).cast("int")).withColumn("__wcand", (F.col("nige_score") > 0.15).cast("int"))
    df = totals(
        df, "group_id", race_nige_count_bin=F.sum("__cand"), race_nige_pressure_sum=F.sum("__rate"),
        race_nige_pressure_score_sum=F.sum("nige_score"), race_nige_count_weighted=F.sum("__wcand"),
    )
    r, s = F.col("__rate"), F.col("nige_score")
    return (
        df.withColumn("is_nige_interaction", r * (F.col("race_nige_count_bin") - F.col("__cand")))
        .withColumn("nige_pressure_interaction", r * (F.col("race_nige_pressure_sum") - r))
        .withColumn("nige_score_interaction", s * (F.col("race_nige_pressure_score_sum") - s))
        .drop("__rate", "__exp", "__cand", "__wcand")
    )


@block
def relative_stats(df):
    df = history(df, ["venue", "distance", "surface"], ROW_ORDER, __base=past("mean", "run_time"))
    df = _entity(
        df, base_speed_index=last_k("mean", F.col("__base") - F.col("run_time") + 80, 5, default=50.0), base_last_3f=last_k("mean", "last_3f", 5, default=35.0),
        base_nige_rate=last_k("mean", _is_lead(), 5, default=0.0), __prev=lag("day_no"),
    )
    df = df.withColumn("base_interval", F.coalesce(F.col("day_no") - F.col("__prev"), F.lit(999)).cast("double"))
    df = df.withColumn("base_impost", F.coalesce("impost", F.lit(55.0)))
    for c in ("speed_index", "last_3f", "nige_rate", "interval", "impost"):
        # equal values reached by different sums must compare equal
        df = standing(df.withColumn(f"base_{c}", F.round(f"base_{c}", 9)), "group_id", f"base_{c}").drop(f"base_{c}_dev", f"base_{c}_gap")
        df = df.withColumnsRenamed({f"base_{c}_{k}": f"relative_{c}_{k}" for k in ("z", "pct", "diff")})
    return df.drop("__base", "__prev", *[f"base_{c}" for c in ("speed_index", "last_3f", "nige_rate", "interval", "impost")])


@block
def jockey_trainer_stats(df):
    """Pair history smoothed towards the rate of all earlier days."""
    df = before_group(df, ["person_a", "person_b"], "group_id", "day", {"__n": F.lit(1), "__w": win(), "__t": top3(), "__r": F.col("outcome")})
    df = global_before(df, "day", {"__gn": F.lit(1), "__gw": win(), "__gt": top3(), "__gr": F.col("outcome")})
    n = F.col("__n_before")
    g = {k: F.coalesce(F.try_divide(f"__g{k}_before", "__gn_before"), F.lit(d)) for k, d in (("w", WIN_PRIOR), ("t", TOP3_PRIOR), ("r", 0.0))}
    out = df.select(
        "*", n.alias("jt_run_count"), smoothed(F.col("__t_before"), n, g["t"], 20).alias("jt_top3_rate_smoothed"),
        smoothed(F.col("__w_before"), n, g["w"], 20).alias("jt_win_rate_smoothed"), F.when(n > 0, F.try_divide("__r_before", "__n_before")).otherwise(g["r"]).alias("jt_avg_rank"),
    )
    return out.drop(*[c for c in out.columns if c.startswith("__")])


@block
def bloodline_stats(df):
    turf, dirt, heavy = ((F.col("surface") == "turf"), (F.col("surface") == "dirt"), F.col("going") >= 3)
    both = lambda c: (c & (F.col("outcome") == 1)).cast("int")
    m = {"__n": F.lit(1), "__w": win()}
    for name, c in (("turf", turf), ("dirt", dirt), ("heavy", heavy)):
        m |= {f"__{name}_n": c.cast("int"), f"__{name}_w": both(c)}
    df = before_group(df, "parent", "group_id", "day", m)
    out = df.select(
        "*", F.col("__n_before").alias("sire_n_races"), _rate("__w_before", "__n_before").alias("sire_win_rate"),
        *[_rate(f"__{x}_w_before", f"__{x}_n_before").alias(f"sire_{x}_win_rate") for x in ("turf", "dirt", "heavy")],
    )
    return out.drop(*[c for c in out.columns if c.startswith("__")])


@block
def odds_features(df):
    return df.withColumn("odds_10min", F.col("price"))


@block
def training_stats(df):
    return df.withColumn("training_time_4f", F.col("t4")).withColumn("training_time_3f", F.col("t3")).withColumn("training_time_last1f", F.col("t1"))


@block
def burden_stats(df):
    return df.withColumn("weight_ratio", F.try_divide("impost", "weight"))


@block
def changes_stats(df):
    """Person change, form of the new person against the old, distance and interval class."""
    df = before_group(df, "person_a", "group_id", "day", {"__n": F.lit(1), "__w": win()})
    df = df.withColumn("__form", _rate("__w_before", "__n_before"))
    df = _entity(df, __pj=lag("person_a"), __pf=lag("__form", default=0.0), __pd=lag("distance"), __day=lag("day_no"))
    d, p = F.col("distance"), F.col("__pd")
    out = (
        df.withColumn("jockey_change", flag(F.col("person_a") != F.col("__pj")))
        .withColumn("jockey_class_diff", F.col("__form") - F.col("__pf"))
        .withColumn("dist_change_category", F.when(d > p, "Lengthening").when(d < p, "Shortening").otherwise("Same"))
        .withColumn("interval_category", S.gap_category(F.col("day_no") - F.col("__day")))
    )
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def _distance_bin() -> Column:
    return S.cut("distance", [0, 1400, 1800, 2200, 2800, 99999], ["Sprint", "Mile", "Intermediate", "Long", "Stay"])


@block
def aptitude_stats(df):
    df = df.withColumn("__bin", _distance_bin())
    for key, name in (("venue", "course_win_rate"), ("__bin", "dist_win_rate"), ("surface", "surface_win_rate")):
        df = _keyed_rates(df, ["entity", key], **{name: win()})
    return df.drop("__bin")


@block
def speed_index_stats(df):
    df = history(df, ["venue", "distance", "surface"], ROW_ORDER, __m=past("mean", "run_time", min_n=30), __s=past("std", "run_time", min_n=30))
    z = F.coalesce(F.try_divide(F.col("__m") - F.col("run_time"), F.nullif(F.col("__s"), F.lit(0.0))), F.lit(0.0))
    df = df.withColumn("__idx", F.greatest(F.lit(-10.0), F.least(F.lit(10.0), z)))
    df = _entity(df, avg_speed_index=last_k("mean", "__idx", 5, default=0.0), max_speed_index=last_k("max", "__idx", 5, default=0.0))
    df = totals(df, "group_id", __field=F.avg("avg_speed_index"))
    return _entity(df, lag1_rival_speed_mean=lag("__field", default=50.0)).drop("__m", "__s", "__idx", "__field")


def _temporal(df, key, name):
    df = trailing_days(df, key, "day", {"__n": F.lit(1), "__w": win(), "__t": top3()}, [180, 365])
    for d in (180, 365):
        df = df.withColumn(f"{name}_n_{d}d", F.col(f"__n_{d}d")).withColumn(f"{name}_win_rate_{d}d", _rate(f"__w_{d}d", f"__n_{d}d")).withColumn(f"{name}_top3_rate_{d}d", _rate(f"__t_{d}d", f"__n_{d}d"))
    df = df.withColumn(f"{name}_momentum", F.col(f"{name}_win_rate_180d") - F.col(f"{name}_win_rate_365d"))
    df = standing(df, "group_id", f"{name}_win_rate_365d")
    df = df.withColumnRenamed(f"{name}_win_rate_365d_z", f"{name}_relative_z")
    return df.drop(*[c for c in df.columns if c.startswith("__")], *[f"{name}_win_rate_365d_{k}" for k in ("diff", "dev", "pct", "gap")])


@block
def temporal_jockey_stats(df):
    return _temporal(df, "person_a", "jockey")


@block
def temporal_trainer_stats(df):
    return _temporal(df, "person_b", "trainer")


@block
def strategy_pattern(df):
    df = rank(df, "group_id", "__r3f", F.col("last_3f"), "min")
    df = _entity(df, __pd=lag("distance"), __pj=lag("person_a"), __lead=lag(_is_lead(), default=0), __o=lag("outcome"), __td=lag("time_diff"), __p3=lag("__r3f"))
    change = F.col("distance") - F.col("__pd")
    out = (
        df.withColumn("is_dist_short_nige", flag((change < 0) & (F.col("__lead") == 1)))
        .withColumn("is_jockey_change_dist_change", flag((F.col("person_a") != F.col("__pj")) & (change != 0)))
        .withColumn("lag1_bad_luck_proxy", flag((F.col("__p3") <= 3) & (F.col("__o") >= 6) & (F.col("__td") <= 0.5)))
    )
    return out.drop(*[c for c in out.columns if c.startswith("__")])


@block
def class_stats(df):
    df = trailing_days(df, ["entity", "class_level"], "day", {"__n": F.lit(1), "__t": top3()}, [365])
    df = _entity(df, __pc=lag("class_level"))
    df = df.withColumn("__step", F.coalesce(F.signum((F.col("class_level") - F.col("__pc")).cast("double")), F.lit(0.0)))
    df = _entity(df, class_trend_3=last_k("mean", "__step", 3, default=0.0))
    out = df.select(
        "*", F.col("__n_365d").alias("hc_n_races_365d"), _rate("__t_365d", "__n_365d").alias("hc_top3_rate_365d"),
        flag(F.col("class_level") == F.col("__pc")).alias("is_same_class_prev"),
    )
    return out.drop(*[c for c in out.columns if c.startswith("__")])


@block
def segment_stats(df):
    df = totals(df, "group_id", __size=F.count(F.lit(1)))
    small, mile, good = F.col("__size") <= SMALL_FIELD, F.col("distance").between(1400, 1800), F.col("outcome") <= 3
    i = lambda c: c.cast("int")
    df = _entity(df, small_n_total=past("sum", i(small), default=0), __st=past("sum", i(small & good), default=0), mile_n_total=past("sum", i(mile), default=0), __mt=past("sum", i(mile & good), default=0))
    return df.withColumn("horse_small_top3_rate", _rate("__st", "small_n_total")).withColumn("horse_mile_top3_rate", _rate("__mt", "mile_n_total")).drop("__size", "__st", "__mt")


@block
def risk_stats(df):
    collapse = ((F.col("outcome") >= COLLAPSE_RANK) | (F.col("time_diff") >= 2.0)).cast("int")
    df = _entity(
        df, rank_std_5=last_k("std", "outcome", 5, min_n=2, default=0.0), time_diff_std_5=last_k("std", "time_diff", 5, min_n=2, default=0.0),
        collapse_rate_10=last_k("mean", collapse, 10, default=0.0), __pc=lag(collapse, default=0), __won=past("max", win(), default=0),
    )
    return df.withColumn("resurrection_flag", flag((F.col("__pc") == 1) & (F.col("__won") == 1))).drop("__pc", "__won")


@block
def course_aptitude(df):
    df = _venue_kinds(df)
    for k in ("rot", "str", "slp"):
        df = history(df, ["entity", f"__{k}"], ENTITY_ORDER, **{f"apt_{k}_win_rate": past("mean", win(), default=0.0), f"apt_{k}_top3_rate": past("mean", top3(), default=0.0), f"apt_{k}_count": seq()})
        df = df.withColumn(f"is_first_{k}", (F.col(f"apt_{k}_count") == 0).cast("int"))
    return df.drop("__rot", "__str", "__slp")


@block
def extended_aptitude(df):
    """Six sets of keys and two exchanges: parents are few and are dealt by stretches of days, persons are dealt once."""
    columns, kinds = df.columns, ("rot", "str", "slp")
    df, measures = _venue_kinds(df), {"__n": F.lit(1), "__w": win(), "__t": top3()}
    cells = day_cells(df, ["day"], ["parent", *[f"__{k}" for k in kinds]], measures)
    if cells is None:
        for k in kinds:
            df = before_group(df, ["parent", f"__{k}"], "group_id", "day", measures)
            df = df.withColumnsRenamed({f"{m}_before": f"{m}_sire_{k}" for m in measures})
    else:
        df = totals_before_group(df, cells, {f"sire_{k}": ["parent", f"__{k}"] for k in kinds}, "group_id", "day", measures)
        df = deal(df, *own_keys(df, ["person_a"]))
    for k in kinds:
        df = before_group(df, ["person_a", f"__{k}"], "group_id", "day", measures)
        df = df.withColumnsRenamed({f"{m}_before": f"{m}_jockey_{k}" for m in measures})
    rates = [(name, k, m, end) for name in ("sire", "jockey") for k in kinds for m, end in (("__w", ""), ("__t", "_top3"))]
    return df.select(*columns, *[_rate(f"{m}_{name}_{k}", f"__n_{name}_{k}").alias(f"{name}_apt_{k}{end}") for name, k, m, end in rates])


@block
def runstyle_fit(df):
    p = F.col("pass_1")
    df = df.withColumn("__style", F.when(p <= 1, 1).when(p <= 4, 2).when(p <= 10, 3).otherwise(4))
    df = expanding_mode(df, "entity", ENTITY_ORDER, "__style", [1, 2, 3, 4], "pred_runstyle", default=2)
    lead, closer = (F.col("pred_runstyle") == 1).cast("int"), (F.col("pred_runstyle") >= 3).cast("int")
    long = F.col("venue").isin(LONG_STRAIGHT_VENUES).cast("int")
    df = totals(df, "group_id", n_nige_in_race=F.count_if(F.col("pred_runstyle") == 1))
    df = df.withColumn("n_other_nige", F.col("n_nige_in_race") - lead)
    return (
        df.withColumn("fit_nige_short", lead * (1 - long)).withColumn("fit_inner_nige", lead * (F.col("frame") <= 3).cast("int"))
        .withColumn("fit_sashi_long", closer * long).withColumn("fit_nige_slow", lead * (F.col("n_other_nige") == 0).cast("int"))
        .withColumn("fit_sashi_high", closer * (F.col("n_other_nige") >= 2).cast("int")).drop("__style")
    )


@block
def jockey_trainer_compatibility(df):
    m = {"__n": F.lit(1), "__w": win(), "__t": top3()}
    df = before_group(df, ["person_a", "person_b"], "group_id", "day", m)
    df = df.withColumnsRenamed({f"{k}_before": f"{k}p" for k in m})
    df = before_group(df, "person_a", "group_id", "day", m)
    out = (
        df.withColumn("jt_win_diff", _rate("__wp", "__np") - _rate("__w_before", "__n_before")).withColumn("jt_top3_diff", _rate("__tp", "__np") - _rate("__t_before", "__n_before"))
        .withColumn("is_first_combo", (F.col("__np") == 0).cast("int")).withColumn("jt_log_count", F.log1p("__np"))
    )
    return out.drop(*[c for c in out.columns if c.startswith("__")])


@block
def interval_aptitude(df):
    df = _entity(df, __prev=lag("day_no"))
    df = df.withColumn("interval_days", F.coalesce(F.col("day_no") - F.col("__prev"), F.lit(999)))
    d = F.col("interval_days")
    df = df.withColumn("interval_type_code", F.when(d > 1800, 0).when(d > 60, 3).when(d > 28, 2).otherwise(1)).withColumn("__start", (d > 60).cast("int"))
    df = _entity(df, __b=past("sum", "__start", default=0)).withColumn("__campaign", F.col("__b") + F.col("__start"))
    df = history(df, ["entity", "__campaign"], ENTITY_ORDER, __nth=seq())
    df = history(df, ["entity", "interval_type_code"], ENTITY_ORDER, apt_int_win=past("mean", win(), default=0.0), apt_int_top3=past("mean", top3(), default=0.0), __k=seq())
    return df.withColumn("tataki_count", F.col("__nth") + 1).withColumn("is_first_int_type", (F.col("__k") == 0).cast("int")).drop("__prev", "__start", "__b", "__campaign", "__nth", "__k")


@block
def physique_training(df):
    w, d, t4, t1 = F.col("weight"), F.col("weight_diff"), F.col("t4"), F.col("t1")
    df = _entity(df, __best=past("mean", F.when(F.col("outcome") <= 3, w)), __all=past("mean", w))
    impact = F.try_divide(d, w) * 100 * F.when((w < 440) & (d < 0), 1.5).otherwise(1.0)
    return (
        df.withColumn("weight_impact_score", impact).withColumn("best_weight_diff", F.coalesce(w - F.coalesce("__best", "__all"), F.lit(0.0)))
        .withColumn("training_accel_score", F.when((t4 > t1) & (t1 > 0), (t4 - t1) / 3.0 - t1).otherwise(0.0)).drop("__best", "__all")
    )


@block
def jockey_strategy(df):
    df = before_group(df, "person_a", "group_id", "day", {"__n": F.lit(1), "__w": win()})
    df = df.withColumn("jockey_form", F.coalesce(F.try_divide("__w_before", "__n_before"), F.lit(0.05)))
    df = _entity(df, __p1=lag("person_a"), __p2=lag("person_a", 2), __pf=lag("jockey_form"))
    change = F.coalesce(F.col("person_a") != F.col("__p1"), F.lit(False))
    out = (
        df.withColumn("is_jockey_change", change.cast("int")).withColumn("jockey_rate_diff", F.coalesce(F.col("jockey_form") - F.col("__pf"), F.lit(0.0)))
        .withColumn("is_jockey_return", flag(change & (F.col("person_a") == F.col("__p2")))).withColumn("is_top_jockey_switch", flag(change & (F.col("jockey_form") >= 0.15)))
    )
    return out.drop(*[c for c in out.columns if c.startswith("__")])


@block
def race_dynamics(df):
    """Expected first-section time of every row; rows without history take the level of all earlier days."""
    df = _entity(df, __x=past("mean", "first_3f"), __front=lag(_is_lead(), default=0))
    df = global_before(df, "day", {"__gs": F.col("first_3f"), "__gn": F.lit(1)})
    df = df.withColumn("__x", F.round(F.coalesce("__x", F.try_divide("__gs_before", "__gn_before")), 9))
    df = totals(df, "group_id", front_runner_count=F.sum("__front"), race_pace_level_3f=F.avg("__x"), __sd=F.stddev_samp("__x"))
    sd = F.coalesce("__sd", F.lit(1.0))
    out = (
        df.withColumn("relative_3f_score", F.try_divide(F.col("race_pace_level_3f") - F.col("__x"), sd))
        .withColumn("is_sole_leader", ((F.col("front_runner_count") == 1) & (F.col("__front") == 1)).cast("int"))
        .withColumn("is_high_pace_warn", (F.col("front_runner_count") >= 3).cast("int"))
    )
    return out.drop(*[c for c in out.columns if c.startswith("__")])


@block
def sire_aptitude(df):
    """Smoothed and decayed rates of the parent in three contexts, spread of its recent
    results and closeness to the conditions its winners had."""
    df = df.withColumn("__course", F.concat_ws("_", "venue", "surface", "distance")).withColumn("__bin", S.step_bin("distance", 200))
    df = global_before(df, "day", {"__gn": F.lit(1), "__gw": win()})
    prior = F.coalesce(F.try_divide("__gw_before", "__gn_before"), F.lit(WIN_PRIOR))
    for key, name in (("__course", "course"), ("__bin", "dist"), ("surface", "surface")):
        df = history(df, ["parent", key], ROW_ORDER, __n=past("count"), __w=past("sum", win(), default=0), __d=ewm_recursive(win(), 0.18))
        df = df.withColumn(f"sire_{name}_win_rate", smoothed(F.col("__w"), F.col("__n"), prior, 10)).withColumn(f"sire_{name}_win_rate_decay", F.coalesce("__d", F.lit(WIN_PRIOR))).drop("__n", "__w", "__d")
    df = history(
        df, "parent", ROW_ORDER, sire_win_rate_std_50=last_k("std", win(), 50, min_n=5, default=WIN_PRIOR), __q3=last_k("quantile", win(), 50, min_n=8, q=0.75), __q1=last_k("quantile", win(), 50, min_n=8, q=0.25),
        __vt=past("sum", F.col("variant") * top3(), default=0.0), __tt=past("sum", top3(), default=0),
    )
    df = df.withColumn("sire_variant_pref", _rate("__vt", "__tt"))
    out = df.withColumn("sire_win_rate_iqr_50", F.coalesce(F.col("__q3") - F.col("__q1"), F.lit(WIN_PRIOR))).withColumn("blood_variant_fit", F.exp(-F.abs(F.col("variant") - F.col("sire_variant_pref")) / 0.8))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


@block
def track_bias(df):
    five = F.col("outcome") <= 5
    df = totals(df, "group_id", __pos=F.avg(F.when(five, F.col("pass_1"))), __frm=F.avg(F.when(five, F.col("frame"))))
    score = 1.0 / F.col("outcome") * (1.0 + F.abs(F.col("pass_1") - F.col("__pos")) + 0.5 * F.abs(F.col("frame") - F.col("__frm")))
    return _entity(df, bias_adversity_score_mean_5=last_k("mean", score, 5, default=0.0)).drop("__pos", "__frm")


@block
def frame_bias(df):
    df = df.withColumn("__cat", S.distance_category("distance")).withColumn("is_inner_frame", (F.col("frame") <= 4).cast("int"))
    for keys, name in ((["venue", "__cat", "surface", "frame"], "frame_cond_win_rate"), (["venue", "__cat", "surface", "is_inner_frame"], "inner_frame_win_rate")):
        df = before_group(df, keys, "group_id", "day", {"__n": F.lit(1), "__w": win()})
        df = df.withColumn(name, _rate("__w_before", "__n_before")).drop("__n_before", "__w_before")
    return df.withColumn("frame_advantage_score", (9 - F.col("frame")) / 8.0).drop("__cat")


@block
def weight_pattern(df):
    df = _entity(df, __pw=past("last", "weight"))
    df = df.withColumn("__w", F.coalesce("weight", "__pw"))
    w = F.col("__w")
    df = _entity(df, weight_volatility_5=last_k("std", w, 5, min_n=2, default=0.0), __m3=last_k("mean", w, 3), __avg=past("mean", w), __opt=past("mean", F.when(F.col("outcome") <= 3, w)))
    z = lambda c: F.coalesce(w - F.col(c), F.lit(0.0))
    return df.withColumn("weight_trend_3", z("__m3")).withColumn("weight_vs_avg", z("__avg")).withColumn("optimal_weight_diff", z("__opt")).drop("__pw", "__w", "__m3", "__avg", "__opt")


@block
def rest_pattern(df):
    df = _entity(df, __prev=lag("day_no"), __pr=lag(S.lookup("venue", VENUE_REGION, "U")), __po=lag("outcome", default=18))
    region = S.lookup("venue", VENUE_REGION, "U")
    df = df.withColumn("__gap", F.coalesce(F.col("day_no") - F.col("__prev"), F.lit(0))).withColumn("__hop", F.concat(F.coalesce(F.col("__pr"), region), region))
    gap, good = F.col("__gap"), F.col("outcome") <= 3
    df = df.withColumn("__rest", (gap >= 60).cast("int")).withColumn("is_long_rest", (gap >= 180).cast("int"))
    rested = F.when(F.col("__rest") == 1, top3())
    df = _entity(
        df, rest_success_rate=past("mean", rested, default=0.0), __rn=past("sum", "__rest", default=0), __rt=past("sum", rested, default=0), rest_success_rate_decay=ewm_recursive(rested, 0.25),
        __best=past("mean", F.when(good, gap), default=0.0), __sd=past("std", F.when(good, gap)), __prest=lag("__rest", default=0),
        __vt=past("sum", F.col("variant") * top3(), default=0.0), __tt=past("sum", top3(), default=0),
    )
    df = global_before(df, "day", {"__gn": F.lit(1), "__gt": top3()})
    prior = F.coalesce(F.try_divide("__gt_before", "__gn_before"), F.lit(TOP3_PRIOR))
    df = df.withColumn("rest_success_rate_smoothed", smoothed(F.col("__rt"), F.col("__rn"), prior, 8))
    df = df.withColumn("rest_success_rate_decay", F.coalesce("rest_success_rate_decay", "rest_success_rate_smoothed")).withColumn("optimal_rest_diff", gap - F.col("__best"))
    spread = F.greatest(F.lit(7.0), F.coalesce("__sd", F.lit(30.0)))
    df = df.withColumn("rest_optimality_score", F.exp(-F.abs(F.col("optimal_rest_diff")) / (spread + 1e-6)))
    df = _entity(df, tataki_effectiveness=past("mean", F.when(F.col("__prest") == 1, F.col("__po") - F.col("outcome")), default=0.0))
    load = F.when(F.col("__hop").contains("U"), UNKNOWN_LOAD).otherwise(S.lookup("__hop", TRAVEL_LOAD, 0.0))
    df = df.withColumn("travel_load", load).withColumn("horse_variant_pref", _rate("__vt", "__tt"))
    runs_since = F.least(F.greatest(F.coalesce(F.col("tataki_count").cast("double"), F.lit(1.0)), F.lit(1.0)), F.lit(6.0)) / 6.0 if "tataki_count" in df.columns else F.lit(0.0)
    short_turn = F.greatest(F.lit(0.0), 21.0 - gap) / 21.0
    df = df.withColumn("rotation_stress", ROTATION[0] * F.col("travel_load") + ROTATION[1] * short_turn + ROTATION[2] * F.col("is_long_rest") + ROTATION[3] * runs_since)
    out = df.withColumn("horse_variant_match", -F.abs(F.col("variant") - F.col("horse_variant_pref")))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


@block
def corner_dynamics(df):
    df = totals(df, "group_id", __size=F.count(F.lit(1)))
    p3, p4 = F.col("pass_3"), F.col("pass_4")
    return _entity(df, corner_advance_score=past("mean", p3 - p4, default=0.0), avg_final_corner_pct=past("mean", p4 / F.col("__size"), default=0.5), corner_acceleration=past("mean", p4 - F.col("outcome"), default=0.0)).drop("__size")


@block
def training_detail(df):
    t4, t3, t1 = F.col("t4"), F.col("t3"), F.col("t1")
    accel = F.when((t4 > 0) & (t1 > 0) & (t4 > t1), (t4 - t1) / 3.0 - t1).when((t3 > 0) & (t1 > 0) & (t3 > t1), (t3 - t1) / 2.0 - t1).otherwise(0.0)
    return df.withColumn("training_acceleration", accel).withColumn("training_intensity_score", F.when(t4 > 10, 40.0 / t4).when(t3 > 10, 30.0 / t3).otherwise(0.0))


@block
def bloodline_detail(df):
    df = df.withColumn("__bin", S.step_bin("distance", 400)).withColumn("__heavy", (F.col("going") >= 3).cast("int"))
    m = {"__n": F.lit(1), "__w": win(), "__t": top3()}
    ctx = ["surface", "__bin", "__heavy"]
    keysets = {"nicks": ["parent", "parent2"], "nctx": ["parent", "parent2", *ctx], "bms": ["parent2"], "sctx": ["parent", *ctx], "bctx": ["parent2", *ctx]}
    cells = day_cells(df, ["day", "day_no"], keysets["nctx"], m)
    if cells is None:
        for tag, keys in keysets.items():
            df = before_group(df, keys, "group_id", "day", m).withColumnsRenamed({f"{k}_before": f"{k}_{tag}" for k in m})
    else:
        df = totals_before_group(df, cells, keysets, "group_id", "day", m)
    df = global_before(df, "day", {f"__g{k[2:]}": c if cells is None else F.col(k) for k, c in m.items()}, cells)
    for tag in ("nicks", "bms"):
        df = df.withColumn(f"{tag}_count", F.col(f"__n_{tag}")).withColumn(f"{tag}_win_rate", _rate(f"__w_{tag}", f"__n_{tag}")).withColumn(f"{tag}_top3_rate", _rate(f"__t_{tag}", f"__n_{tag}"))
    df = df.withColumn("nicks_ctx_count", F.col("__n_nctx"))
    for k, name, d in (("w", "win", WIN_PRIOR), ("t", "top3", TOP3_PRIOR)):
        g = F.coalesce(F.try_divide(f"__g{k}_before", "__gn_before"), F.lit(d))
        top = F.col(f"__{k}_nctx") + 3.0 * _rate(f"__{k}_sctx", "__n_sctx") + 2.0 * _rate(f"__{k}_bctx", "__n_bctx") + 8.0 * g
        df = df.withColumn(f"nicks_ctx_{name}_rate_hier", top / (F.col("__n_nctx") + 13.0))
    last = {"__n50": last_k("count", top3(), 50, default=0), "__s50": last_k("sum", top3(), 50, default=0)}
    df = history(df, "parent", ROW_ORDER, **last) if cells is None else last_rows(df, cells, "parent", ROW_ORDER, 50, **last)
    df = df.withColumn("sire_top3_std_50", F.when(F.col("__n50") >= 5, _flag_std("__s50", "__n50")).otherwise(F.lit(0.0)))
    spread = _flag_quantile("__s50", "__n50", 0.75) - _flag_quantile("__s50", "__n50", 0.25)
    out = df.withColumn("sire_top3_iqr_50", F.when(F.col("__n50") >= 8, spread).otherwise(F.lit(0.0)))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


@block
def horse_gear(df):
    df = _entity(df, __p=lag("gear", default=0))
    df = df.withColumn("has_blinker", F.col("gear")).withColumn("lag1_blinker", F.coalesce("__p", F.lit(0)))
    return df.withColumn("is_first_blinker", flag((F.col("gear") == 1) & (F.col("__p") == 0))).withColumn("is_blinker_off", flag((F.col("gear") == 0) & (F.col("__p") == 1))).drop("__p")


@block
def race_attributes(df):
    df = totals(df, "group_id", field_size=F.count(F.lit(1)), __sd=F.stddev_samp("impost"))
    return df.withColumn("race_impost_std", F.coalesce("__sd", F.lit(0.0))).withColumn("is_handicap_race_guess", (F.col("race_impost_std") > 0.8).cast("int")).drop("__sd")


@block
def impost_features(df):
    df = _entity(df, __p=lag("impost"))
    d = F.coalesce(F.col("impost") - F.col("__p"), F.lit(0.0))
    return df.withColumn("impost_change", d).withColumn("impost_change_abs", F.abs(d)).drop("__p")


@block
def form_trend(df):
    df = _entity(df, rank_ewm_3=ewm("outcome", 0.5), rank_ewm_5=ewm("outcome", 1 / 3), time_diff_ewm_3=ewm("time_diff", 0.5), rank_std_5=last_k("std", "outcome", 5, min_n=3, default=0.0), **{f"__l{i}": lag("outcome", i) for i in (1, 2, 4, 5)})
    slope = (2 * F.col("__l1") + F.col("__l2") - F.col("__l4") - 2 * F.col("__l5")) / 10.0
    z = F.lit(0.0)
    return df.withColumns({c: F.coalesce(c, z) for c in ("rank_ewm_3", "rank_ewm_5", "time_diff_ewm_3")}).withColumn("rank_slope_5", F.coalesce(slope, z)).drop("__l1", "__l2", "__l4", "__l5")


@block
def race_conditions(df):
    """Condition variant of the group's day and venue: exact condition, else venue, else 0."""
    level = F.avg("run_time").alias("__v")
    exact = df.groupBy(*own_keys(df, ["group_id", "day_no", "venue", "surface"])).agg(level)
    exact = variant_index(exact, ["venue", "surface"], ["day_no", "group_id"], "__v").withColumnsRenamed({c: f"__{c}" for c in ("variant", "variant_robust", "uncertainty", "confidence")}).drop("__v", "day_no", COPY)
    broad = df.groupBy(*own_keys(df, ["group_id", "day_no", "venue"])).agg(level)
    broad = history(broad, "venue", ["day_no", "group_id"], __r=last_k("mean", "__v", 10), __l=past("mean", "__v")).select("group_id", "venue", (F.col("__r") - F.col("__l")).alias("__broad"))
    out = df.join(exact, ["group_id", "venue", "surface"], "left").join(broad, ["group_id", "venue"], "left")
    out = out.withColumn("track_variant", F.coalesce("__variant", "__broad", F.lit(0.0))).withColumn("track_variant_robust", F.coalesce("__variant_robust", F.lit(0.0)))
    out = out.withColumn("track_uncertainty", F.coalesce("__uncertainty", F.lit(0.0))).withColumn("track_confidence", F.coalesce("__confidence", F.lit(0.5)))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


@block
def race_structure(df):
    """Early-speed totals, style entropy, pace probability against earlier groups and front congestion."""
    df = pace_stats(df)
    df = runstyle_fit(df)
    df = df.withColumn("__nig", (F.col("last_nige_rate") > 0.2).cast("int"))
    df = totals(df, "group_id", struct_early_speed_sum=F.sum("last_nige_rate"), struct_early_speed_mean=F.avg("last_nige_rate"), struct_nige_count=F.sum("__nig"), __size=F.count(F.lit(1)),
                **{f"__s{k}": F.count_if(F.col("pred_runstyle") == k) for k in (1, 2, 3, 4)})
    ent = F.lit(0.0)
    for k in (1, 2, 3, 4):
        p = F.col(f"__s{k}") / F.col("__size")
        ent = ent - F.when(F.col(f"__s{k}") > 0, p * F.log(p)).otherwise(0.0)
    df = df.withColumn("style_entropy", ent)
    linear = F.lit(-0.5)
    one_per_group = {"__g1": F.col("struct_early_speed_sum"), "__g2": F.col("struct_nige_count"), "__g3": F.col("style_entropy"), "__g4": F.col("__size")}
    moments = {"__c": F.lit(1.0) / F.col("__size")}
    for n, c in one_per_group.items():
        moments |= {f"{n}s": c / F.col("__size"), f"{n}q": c * c / F.col("__size")}
    df = global_before(df, "day", moments)
    n = F.col("__c_before")
    for (name, c), weight in zip(one_per_group.items(), (0.9, 0.7, 0.4, 0.3)):
        mean = F.try_divide(F.col(f"{name}s_before"), n)
        var = F.try_divide(F.col(f"{name}q_before") - n * mean * mean, n - 1)
        z = F.when(var > 1e-9, (c - mean) / F.sqrt(var))
        linear = linear + weight * F.coalesce(z, F.lit(0.0))
    df = df.withColumn("pace_high_prob", S.sigmoid(linear))
    fit = lambda c: F.col(c).cast("double")
    df = df.withColumn("pace_fit_expected", F.col("pace_high_prob") * fit("fit_sashi_high") + (1 - F.col("pace_high_prob")) * fit("fit_nige_slow"))
    span = F.greatest(F.col("__size") - 1, F.lit(1))
    df = df.withColumn("__mu", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("avg_first_corner_norm"))) * span + 1.0, 9))
    df = kernel_sum(df, "group_id", "__mu", "last_nige_rate", 1.5, "front_congestion_idx")
    return df.drop(*[c for c in df.columns if c.startswith("__")])


@block
def lap_fit(df):
    df = pace_stats(df)
    df = totals(df, "group_id", __sum=F.sum("last_nige_rate"))
    return df.withColumn("lap_fit_interaction", F.col("avg_pci") * F.col("__sum")).drop("__sum")


@block
def deep_lag_extended(df):
    df = totals(df, "group_id", __size=F.count(F.lit(1)))
    plan = {"impost": ("impost", 2), "field_size": ("__size", 2), "last_3f": ("last_3f", 1), "first_corner_rank": ("pass_1", 1), "surface": ("surface", 3), "distance": ("distance", 3), "going_code": ("going", 3), "venue": ("venue", 3)}
    df = _entity(df, **{f"lag{i}_{name}": lag(src, i) for name, (src, depth) in plan.items() for i in range(1, depth + 1)})
    return df.withColumn("impost_diff_prev", F.col("impost") - F.col("lag1_impost")).drop("__size")


@block
def stable_form(df):
    for key, name in (("person_a", "jockey"), ("person_b", "trainer")):
        df = trailing_days(df, key, "day", {"__n": F.lit(1), "__w": win(), "__t": top3()}, [30, 60])
        for d in (30, 60):
            df = df.withColumn(f"{name}_win_rate_{d}d", _rate(f"__w_{d}d", f"__n_{d}d")).withColumn(f"{name}_top3_rate_{d}d", _rate(f"__t_{d}d", f"__n_{d}d"))
        df = df.drop(*[c for c in df.columns if c.startswith("__")])
    return df


@block
def horse_events(df):
    df = _entity(df, __pt=lag("person_b"), __ps=lag("sex"))
    return df.withColumn("trainer_change", flag(F.col("person_b") != F.col("__pt"))).withColumn("first_run_after_gelding", flag((F.col("__ps") == "M") & (F.col("sex") == "G"))).drop("__pt", "__ps")


@block
def aptitude_smoothing(df):
    df = jockey_stats(df)
    n = F.col("jockey_n_races")
    return df.withColumn("jockey_win_rate_smoothed", smoothed(F.col("jockey_win_rate") * n, n, F.lit(WIN_PRIOR), 10)).withColumn("jockey_top3_rate_smoothed", smoothed(F.col("jockey_top3_rate") * n, n, F.lit(TOP3_PRIOR), 10))


@block
def relative_expansion(df):
    df = _entity(df, __form=last_k("mean", "outcome", 5))
    df = standing(df.withColumn("__f", F.round("__form", 9)), "group_id", "__f")
    return df.withColumn("relative_form_z", F.coalesce("__f_z", F.lit(0.0))).withColumn("relative_form_pct", F.coalesce("__f_pct", F.lit(0.5))).withColumn("relative_form_gap", F.col("__f_gap")).drop("__form", "__f", "__f_z", "__f_diff", "__f_dev", "__f_pct", "__f_gap")


@block
def mining_features(df):
    """Predicted against actual result, of the previous start (the current one is not known yet)."""
    return _entity(df, yoso_time_diff=lag(F.col("run_time") - F.col("expected_time"), default=0.0), yoso_juni_diff=lag(F.col("outcome") - F.col("expected_rank"), default=0))


@block
def track_aptitude(df):
    df = history(df, ["entity", "going"], ENTITY_ORDER, horse_going_count=seq(), __w=past("sum", win(), default=0), __t=past("sum", top3(), default=0))
    heavy = (F.col("going") >= 3).cast("int")
    df = _entity(df, __pg=lag("going", default=0), __mn=past("sum", heavy, default=0), __mt=past("sum", heavy * top3(), default=0))
    df = df.withColumn("going_shift", F.col("going") - F.col("__pg"))
    df = _entity(
        df, going_shift_up_top3_rate=past("mean", F.when(F.col("going_shift") >= 1, top3()), default=0.0), going_shift_down_top3_rate=past("mean", F.when(F.col("going_shift") <= -1, top3()), default=0.0),
    )
    df = df.withColumn("horse_going_win_rate", _rate("__w", "horse_going_count")).withColumn("horse_going_top3_rate", _rate("__t", "horse_going_count"))
    return df.withColumn("is_proven_mudder", flag((F.col("__mn") >= 2) & (F.try_divide("__mt", "__mn") >= 0.33))).drop("__w", "__t", "__pg", "__mn", "__mt")


def attribute_features(df: DataFrame, people: DataFrame, key: str, name: str) -> DataFrame:
    """Age, career years and affiliation of a person from a master table (code, born, licensed, belongs)."""
    from .hot import sized_broadcast

    m = people.select(S.pad(F.trim(F.col("code").cast("string")), 5).alias("__code"), "born", "licensed", "belongs")
    out = df.withColumn("__code", S.pad(F.col(key), 5)).join(sized_broadcast(m), "__code", "left")
    return (
        out.withColumn(f"{name}_age", S.age_years("born", "day")).withColumn(f"{name}_career_years", S.age_years("licensed", "day"))
        .withColumn(f"{name}_belong_code", F.coalesce("belongs", F.lit(0))).drop("__code", "born", "licensed", "belongs")
    )


def logistics_features(df: DataFrame, belongs: Column, name: str) -> DataFrame:
    """1 when the person's home region differs from the venue's in a way that means travel."""
    home, venue = S.lookup(belongs, AFFILIATION_REGION, "U"), S.lookup("venue", VENUE_REGION, "U")
    away = ((home == "E") & (venue == "W")) | ((home == "W") & (venue == "E")) | (home.isin("E", "W") & (venue == "N"))
    return df.withColumn(name, away.cast("int"))


@block
def pace_features(df):
    """Pace balance of the group in its context, and what each entity has met so far."""
    g = df.groupBy(*own_keys(df, ["group_id", "day_no"])).agg(F.avg(F.col("first_3f") - F.col("last_3f")).alias("pace_diff"), F.min("venue").alias("__ven"), F.min("surface").alias("__sur"))
    g = g.withColumn("pace_diff", F.round("pace_diff", 9)).withColumn("pace_type", F.when(F.col("pace_diff") > 2, 2).when(F.col("pace_diff") < -2, 0).otherwise(1))
    g = history(g, ["__ven", "__sur"], ["day_no", "group_id"], __m=last_k("mean", "pace_diff", 50, min_n=10), __s=last_k("std", "pace_diff", 50, min_n=10))
    z = F.try_divide(F.col("pace_diff") - F.col("__m"), F.nullif(F.col("__s"), F.lit(0.0)))
    g = g.select("group_id", "pace_diff", "pace_type", F.coalesce(z, F.lit(0.0)).alias("pace_diff_z_ctx"))
    df = df.join(g, "group_id")
    x, y = F.col("pace_diff"), top3().cast("double")
    df = _entity(
        df, horse_avg_pace_diff=past("mean", x, default=0.0), horse_pace_versatility=past("std", x, default=0.0), horse_fast_pace_count=past("sum", (F.col("pace_type") == 2).cast("int"), default=0),
        horse_slow_pace_count=past("sum", (F.col("pace_type") == 0).cast("int"), default=0), __n=last_k("count", x, 20), __mx=last_k("mean", x, 20), __my=last_k("mean", y, 20), __mxy=last_k("mean", x * y, 20), __mxx=last_k("mean", x * x, 20),
    )
    n = F.col("__n")
    cov = (F.col("__mxy") - F.col("__mx") * F.col("__my")) * F.try_divide(n, n - 1)
    var = (F.col("__mxx") - F.col("__mx") * F.col("__mx")) * F.try_divide(n, n - 1)
    return df.withColumn("horse_pace_elasticity_20", F.when(n >= 5, cov / (var + 1e-6)).otherwise(0.0)).drop("__n", "__mx", "__my", "__mxy", "__mxx")


@block
def corner_features(df):
    df = totals(df, "group_id", __size=F.count(F.lit(1)))
    gain = F.col("pass_1") - F.col("pass_4")
    adv = F.greatest(F.lit(0), gain)
    return _entity(df, horse_avg_corner_change=past("mean", gain / F.col("__size"), default=0.0), horse_makuri_rate=past("mean", (adv > 0).cast("int"), default=0.0), horse_total_makuri=past("sum", adv, default=0)).drop("__size")


@block
def rating_elo(df):
    from ..operators.sequential import ratings

    df = ratings(df, "surface_pool", "group_id", "entity", "outcome", "day_no", ["line", "person_a"])
    df = totals(df, "group_id", field_elo_mean=F.avg("rating"), __top=F.max("rating"))
    return df.withColumn("elo_gap_to_top", F.col("__top") - F.col("rating")).drop("__top")


@block
def head_to_head(df):
    from ..operators.pairs import head_to_head as h2h

    return h2h(df, "group_id", "day_no", "entity", "outcome")


def odds_fluctuation(df: DataFrame, early: str, late: str, final: str) -> DataFrame:
    """Price movement between two snapshots and the final price, and the change in popularity."""
    e, l, f = F.col(early), F.col(late), F.col(final)
    return (
        df.withColumn("odds_ratio_early_late", F.try_divide(l, e)).withColumn("odds_ratio_late_final", F.try_divide(f, l))
        .withColumn("odds_log_ratio", F.log(F.try_divide(l, e))).withColumn("odds_drop_rate", F.try_divide(e - l, e))
    )


# --- blocks of older feature sets with logic of their own ---------------------------


@block
def undervalued_features(df):
    df = rank(df, "group_id", "__or", F.col("price"), "average")
    return (
        df.withColumn("odds_rank_vs_expected", F.col("__or") - F.col("expected_rank")).withColumn("is_high_odds", (F.col("price") >= 10).cast("int"))
        .withColumn("is_mid_odds", ((F.col("price") >= 5) & (F.col("price") < 10)).cast("int")).drop("__or")
    )


@block
def experience_features(df):
    df = df.withColumn("__cat", S.distance_category("distance"))
    df = history(df, ["entity", "__cat"], ENTITY_ORDER, __seen=seq())
    df = _entity(df, career_runs=seq(), __hi=past("max", "prize"), __mean=past("mean", "distance"))
    return (
        df.withColumn("is_first_distance", (F.col("__seen") == 0).cast("int")).withColumn("is_career_high_prize", flag(F.col("prize") > F.col("__hi")))
        .withColumn("distance_vs_usual", F.col("distance") - F.col("__mean")).drop("__cat", "__seen", "__hi", "__mean")
    )


@block
def opposition_features(df):
    df = _entity(df, __form=last_k("mean", "outcome", 5, default=9.0))
    df = totals(df, "group_id", __s=F.sum("__form"), __n=F.count(F.lit(1)), __b=F.min("__form"))
    return df.withColumn("rivals_form", F.try_divide(F.col("__s") - F.col("__form"), F.col("__n") - 1)).withColumn("form_behind_best", F.col("__form") - F.col("__b")).drop("__form", "__s", "__n", "__b")


@block
def race_level_features(df):
    df = totals(df, "group_id", __lvl=F.avg("prize"))
    return _entity(df, prev_race_level=lag("__lvl"), mean_race_level_3=last_k("mean", "__lvl", 3)).drop("__lvl")


@block
def disadvantage_features(df):
    """Troubled runs (wide path, far behind, against the bias), their expanding rate and last-three mean."""
    df = totals(df, "group_id", __mid=F.avg("pass_1"))
    wide = (F.col("frame") >= 6) & (F.col("pass_1") > F.col("__mid"))
    late = F.col("pass_1") >= 10
    trouble = wide.cast("int") + late.cast("int")
    return _entity(df, trouble_rate=past("mean", (trouble > 0).cast("int"), default=0.0), trouble_mean_3=last_k("mean", trouble, 3, default=0.0), position_spread=lag(S.split_std(F.concat_ws("-", "pass_1", "pass_3", "pass_4")))).drop("__mid")
