"""Feature blocks on the run frame, each with an independent oracle."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..plans import features as B
from ..plans.registry import query
from ..sources.tables import ENTRIES_SQL, entries, table
from .histories import K, KEY

RUNS_SQL = ENTRIES_SQL + """,
runs AS (SELECT *, entity % 40 AS parent, entity % 7 AS parent2, CAST(person_b % 10 + 1 AS INTEGER) AS venue, CASE status WHEN 'F' THEN 'turf' ELSE 'dirt' END AS surface,
 CAST(1000 + (qty % 8) * 200 AS INTEGER) AS distance, CAST(disc % 4 + 1 AS INTEGER) AS going, CAST(tax % 5 + 1 AS INTEGER) AS class_level, CAST(line % 8 + 1 AS INTEGER) AS frame,
 CAST((disc + line) % 14 + 1 AS INTEGER) AS pass_1, CAST((disc * 3 + line) % 14 + 1 AS INTEGER) AS pass_3, CAST((qty + line) % 14 + 1 AS INTEGER) AS pass_4,
 (600 + cents % 600) / 10.0 AS run_time, (cents % 47) / 10.0 AS time_diff, (330 + cents % 90) / 10.0 AS last_3f, (340 + cents % 60) / 10.0 AS first_3f,
 CAST(400 + cents % 120 AS INTEGER) AS weight, CAST(cents % 21 - 10 AS INTEGER) AS weight_diff, 50.0 + disc AS impost, cents AS prize, (500 + cents % 70) / 10.0 AS t4, (370 + cents % 50) / 10.0 AS t3, (120 + cents % 20) / 10.0 AS t1,
 CAST(cents % 3 = 0 AS INTEGER) AS gear, CASE WHEN cents % 3 = 0 THEN 'G' ELSE 'M' END AS sex, (cents % 41 - 20) / 10.0 AS variant, (10 + cents % 300) / 10.0 AS price, line AS expected_rank, (600 + cents % 550) / 10.0 AS expected_time FROM entries)"""


def runs(spark, sf):
    """Run frame derived from the order lines."""
    c, q, l, d = F.col("cents"), F.col("qty"), F.col("line"), F.col("disc")
    i = lambda x: x.cast("int")
    return entries(spark, sf).select(
        "*", (F.col("entity") % 40).alias("parent"), (F.col("entity") % 7).alias("parent2"), i(F.col("person_b") % 10 + 1).alias("venue"),
        F.when(F.col("status") == "F", "turf").otherwise("dirt").alias("surface"), i(1000 + (q % 8) * 200).alias("distance"), i(d % 4 + 1).alias("going"), i(F.col("tax") % 5 + 1).alias("class_level"),
        i(l % 8 + 1).alias("frame"), i((d + l) % 14 + 1).alias("pass_1"), i((d * 3 + l) % 14 + 1).alias("pass_3"), i((q + l) % 14 + 1).alias("pass_4"),
        ((600 + c % 600) / 10.0).alias("run_time"), ((c % 47) / 10.0).alias("time_diff"), ((330 + c % 90) / 10.0).alias("last_3f"), ((340 + c % 60) / 10.0).alias("first_3f"),
        i(400 + c % 120).alias("weight"), i(c % 21 - 10).alias("weight_diff"), (F.lit(50.0) + d).alias("impost"), c.alias("prize"), ((500 + c % 70) / 10.0).alias("t4"), ((370 + c % 50) / 10.0).alias("t3"),
        ((120 + c % 20) / 10.0).alias("t1"), i(c % 3 == 0).alias("gear"), F.when(c % 3 == 0, "G").otherwise("M").alias("sex"), ((c % 41 - 20) / 10.0).alias("variant"),
        ((10 + c % 300) / 10.0).alias("price"), l.alias("expected_rank"), ((600 + c % 550) / 10.0).alias("expected_time"),
    )


H = "PARTITION BY entity ORDER BY day_no, group_id, line, person_a"
ALL_ROWS = "ORDER BY day_no, group_id, line, entity, person_a"
UP = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
WINDOWS = f"o AS ({H}), p AS ({H} {UP}), " + ", ".join(f"k{k} AS ({H} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in (3, 5, 10, 20)) + ", g AS (PARTITION BY group_id)"
WIN, TOP3 = "CAST(outcome = 1 AS INTEGER)", "CAST(outcome <= 3 AS INTEGER)"
LEAD = "CAST(pass_1 = 1 AS INTEGER)"


def up(keys):
    return f"(PARTITION BY {keys} {ALL_ROWS} {UP})"


def cells(name, keys, src="runs", **measures):
    inner = ", ".join(f"sum({e}) AS {m}_" for m, e in measures.items())
    outer = ", ".join(f"CAST(coalesce(sum({m}_) OVER q, 0) AS BIGINT) AS {m}" for m in measures)
    return f"""{name} AS (SELECT {keys}, group_id, {outer} FROM (SELECT {keys}, group_id, day_no, {inner} FROM {src} GROUP BY ALL)
     WINDOW q AS (PARTITION BY {keys} ORDER BY day_no, group_id {UP}))"""


def glob(**measures):
    inner = ", ".join(f"sum({e}) AS {m}_" for m, e in measures.items())
    outer = ", ".join(f"coalesce(sum({m}_) OVER d, 0) AS {m}" for m in measures)
    return f"glb AS (SELECT day_no, {outer} FROM (SELECT day_no, {inner} FROM runs GROUP BY day_no) WINDOW d AS (ORDER BY day_no {UP}))"


def rate(a, b, default="0"):
    return f"coalesce({a} / nullif({b}, 0), {default})"


def sql(src, ctes=(), ints=None, dbls=None):
    """Oracle text: keys, integer-like columns as they are, doubles rounded to 6.

    Means of tenths often end exactly half-way between two roundings, where the two
    engines differ; both sides add the same tiny offset before rounding."""
    cols = [f"{e} AS {n}" for n, e in (ints or {}).items()] + [f"round(CAST({e} AS DOUBLE) + 2.37e-8, 6) + 0.0 AS {n}" for n, e in (dbls or {}).items()]
    return "WITH " + ",\n".join([RUNS_SQL, *ctes]) + f"\nSELECT {K}, {', '.join(cols)} FROM {src} WINDOW {WINDOWS}"


def finish(df, columns):
    out = []
    for c in columns:
        rounded = isinstance(df.schema[c].dataType, DoubleType)
        out.append((F.round(F.col(c) + F.lit(2.37e-8), 6) + F.lit(0.0)).alias(c) if rounded else F.col(c))
    return df.select(*KEY, *out)


def register(name, text):
    @query(f"b_{name}", text)
    def run(spark, sf):
        df = runs(spark, sf)
        out = B.build(df, [name])
        return finish(out, [c for c in out.columns if c not in df.columns])

    return run


register("base_attributes", sql("runs", ints={"field_no": "frame * 100 + line"}))

_LV = """c1 AS (SELECT *, coalesce(sum(prize) OVER (""" + H + " " + UP + """), 0) + prize AS career FROM runs),
c2 AS (SELECT *, avg(career) OVER (PARTITION BY group_id) AS lvl, coalesce(avg(career) FILTER (outcome = 1) OVER (PARTITION BY group_id), 0) AS wl FROM c1)"""
_HS_I = {"run_count": "count(*) OVER p", "interval": "day_no - lag(day_no) OVER o"}
_HS_D = {"mean_rank_5": "avg(outcome) OVER k5", "mean_time_diff_5": "coalesce(avg(time_diff) OVER k5, 3)"}
for _i in range(1, 6):
    _HS_I |= {f"lag{_i}_rank": f"lag(outcome, {_i}) OVER o", f"lag{_i}_grade": f"coalesce(lag(CAST(class_level AS VARCHAR), {_i}) OVER o, 'missing')"}
    _HS_D |= {f"lag{_i}_time_diff": f"coalesce(lag(time_diff, {_i}) OVER o, 3)", f"lag{_i}_race_level": f"coalesce(lag(lvl, {_i}) OVER o, 0)", f"lag{_i}_winner_level": f"coalesce(lag(wl, {_i}) OVER o, 0)"}
register("history_stats", sql("c2", [_LV], _HS_I, _HS_D))


def dw(key, d):
    return f"(PARTITION BY {key} ORDER BY day_no RANGE BETWEEN {d} PRECEDING AND 1 PRECEDING)"


def cnt(cond, w):
    return f"count(*) FILTER ({cond}) OVER {w}"


_J = dw("person_a", 365)
_JN = f"count(*) OVER {_J}"
register("jockey_stats", sql("runs", ints={"jockey_n_races": _JN}, dbls={
    "jockey_win_rate": rate(cnt("outcome = 1", _J), _JN), "jockey_top3_rate": rate(cnt("outcome <= 3", _J), _JN), "jockey_avg_rank": rate(f"sum(outcome) OVER {_J}", _JN)}))

_PACE = "pc AS (SELECT *, CASE WHEN run_time > last_3f THEN last_3f / (run_time - last_3f) * 100 END AS pci, pass_1 / count(*) OVER (PARTITION BY group_id) AS pn FROM runs)"
_PACE_D = {"last_nige_rate": f"coalesce(avg({LEAD}) OVER k5, 0)", "avg_pci": "coalesce(avg(pci) OVER k5, 50)", "avg_first_corner_norm": "coalesce(avg(pn) OVER k5, 0.5)"}
register("pace_stats", sql("pc", [_PACE], dbls=_PACE_D))

_PP = f"""pr AS (SELECT *, coalesce(avg({LEAD}) OVER ({H} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS r, count(*) OVER ({H} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS n FROM runs),
ps AS (SELECT *, r * sqrt(n / (n + 5.0)) AS s, CAST(r > 0.2 AS INTEGER) AS cand FROM pr)"""
register("pace_pressure_stats", sql("ps", [_PP], {"race_nige_count_bin": "CAST(sum(cand) OVER g AS BIGINT)", "race_nige_count_weighted": "count(*) FILTER (s > 0.15) OVER g"}, {
    "nige_score": "s", "race_nige_pressure_sum": "sum(r) OVER g", "race_nige_pressure_score_sum": "sum(s) OVER g", "is_nige_interaction": "r * (sum(cand) OVER g - cand)",
    "nige_pressure_interaction": "r * (sum(r) OVER g - r)", "nige_score_interaction": "s * (sum(s) OVER g - s)"}))

_RS = f"""r0 AS (SELECT *, avg(run_time) OVER {up('venue, distance, surface')} - run_time + 80 AS si FROM runs),
r1 AS (SELECT *, round(coalesce(avg(si) OVER k5, 50), 9) AS speed_index, round(coalesce(avg(last_3f) OVER k5, 35), 9) AS last3, round(coalesce(avg({LEAD}) OVER k5, 0), 9) AS nige_rate, CAST(coalesce(day_no - lag(day_no) OVER o, 999) AS DOUBLE) AS interval, impost AS imp FROM r0 WINDOW o AS ({H}), k5 AS ({H} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"""
_RSD = {}
for _c, _e in (("speed_index", "speed_index"), ("last_3f", "last3"), ("nige_rate", "nige_rate"), ("interval", "interval"), ("impost", "imp")):
    _RSD |= {f"relative_{_c}_diff": f"{_e} - avg({_e}) OVER g", f"relative_{_c}_z": f"coalesce(({_e} - avg({_e}) OVER g) / nullif(stddev_samp({_e}) OVER g, 0), 0)",
             f"relative_{_c}_pct": f"(rank() OVER (PARTITION BY group_id ORDER BY {_e}) + (count(*) OVER (PARTITION BY group_id, {_e}) - 1) / 2.0) / count(*) OVER g"}
register("relative_stats", sql("r1", [_RS], dbls=_RSD))

_G3 = glob(gn="1", gw=WIN, gt=TOP3, gr="outcome")
register("jockey_trainer_stats", sql("runs JOIN jt USING (person_a, person_b, group_id) JOIN glb USING (day_no)", [cells("jt", "person_a, person_b", n="1", w=WIN, t=TOP3, r="outcome"), _G3], {"jt_run_count": "n"}, {
    "jt_top3_rate_smoothed": f"(t + 20 * {rate('gt', 'gn', '0.25')}) / (n + 20)", "jt_win_rate_smoothed": f"(w + 20 * {rate('gw', 'gn', '0.08')}) / (n + 20)", "jt_avg_rank": f"CASE WHEN n > 0 THEN r / n ELSE {rate('gr', 'gn')} END"}))

_BS = {"n": "1", "w": WIN}
for _x, _cnd in (("turf", "surface = 'turf'"), ("dirt", "surface = 'dirt'"), ("heavy", "going >= 3")):
    _BS |= {f"{_x}_n": f"CAST({_cnd} AS INTEGER)", f"{_x}_w": f"CAST({_cnd} AND outcome = 1 AS INTEGER)"}
register("bloodline_stats", sql("runs JOIN b USING (parent, group_id)", [cells("b", "parent", **_BS)], {"sire_n_races": "n"}, {"sire_win_rate": rate("w", "n"), **{f"sire_{x}_win_rate": rate(f"{x}_w", f"{x}_n") for x in ("turf", "dirt", "heavy")}}))

register("odds_features", sql("runs", dbls={"odds_10min": "price"}))
register("training_stats", sql("runs", dbls={"training_time_4f": "t4", "training_time_3f": "t3", "training_time_last1f": "t1"}))
register("burden_stats", sql("runs", dbls={"weight_ratio": "impost / weight"}))

_CH = [cells("pa", "person_a", n="1", w=WIN), f"cf AS (SELECT *, {rate('w', 'n')} AS form FROM runs JOIN pa USING (person_a, group_id))",
       f"ch AS (SELECT *, lag(person_a) OVER o AS pj, lag(form) OVER o AS pf, lag(distance) OVER o AS pd, day_no - lag(day_no) OVER o AS gap FROM cf WINDOW o AS ({H}))"]
register("changes_stats", sql("ch", _CH, {
    "jockey_change": "CAST(coalesce(person_a <> pj, FALSE) AS INTEGER)", "dist_change_category": "CASE WHEN distance > pd THEN 'Lengthening' WHEN distance < pd THEN 'Shortening' ELSE 'Same' END",
    "interval_category": "CASE WHEN gap IS NULL THEN 'First' WHEN gap <= 7 THEN 'Rento' WHEN gap <= 30 THEN 'Short' WHEN gap <= 90 THEN 'Medium' WHEN gap <= 180 THEN 'Long' ELSE 'Rest' END"}, {"jockey_class_diff": "form - coalesce(pf, 0)"}))


def eup(key):
    return f"(PARTITION BY entity, {key} ORDER BY day_no, group_id, line, person_a {UP})"


_BIN = "CASE WHEN distance <= 1400 THEN 1 WHEN distance <= 1800 THEN 2 WHEN distance <= 2200 THEN 3 ELSE 4 END"
register("aptitude_stats", sql("runs", dbls={"course_win_rate": f"coalesce(avg({WIN}) OVER {eup('venue')}, 0)", "dist_win_rate": f"coalesce(avg({WIN}) OVER {eup(_BIN)}, 0)", "surface_win_rate": f"coalesce(avg({WIN}) OVER {eup('surface')}, 0)"}))

_SI = f"""s0 AS (SELECT *, CASE WHEN count(*) OVER c >= 30 THEN avg(run_time) OVER c END AS m, CASE WHEN count(*) OVER c >= 30 THEN stddev_samp(run_time) OVER c END AS s FROM runs WINDOW c AS {up('venue, distance, surface')}),
s1 AS (SELECT *, greatest(-10, least(10, coalesce((m - run_time) / nullif(s, 0), 0))) AS idx FROM s0),
s2 AS (SELECT *, coalesce(avg(idx) OVER k5, 0) AS av, coalesce(max(idx) OVER k5, 0) AS mx FROM s1 WINDOW k5 AS ({H} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, avg(av) OVER (PARTITION BY group_id) AS fld FROM s2)"""
register("speed_index_stats", sql("s3", [_SI], dbls={"avg_speed_index": "av", "max_speed_index": "mx", "lag1_rival_speed_mean": "coalesce(lag(fld) OVER o, 50)"}))


def temporal(key, name):
    w = {d: dw(key, d) for d in (180, 365)}
    n = {d: f"count(*) OVER {w[d]}" for d in w}
    wr = {d: rate(cnt("outcome = 1", w[d]), n[d]) for d in w}
    base = f"tp AS (SELECT *, {', '.join(f'{n[d]} AS n{d}, {wr[d]} AS w{d}, ' + rate(cnt('outcome <= 3', w[d]), n[d]) + f' AS t{d}' for d in w)} FROM runs)"
    i = {f"{name}_n_{d}d": f"n{d}" for d in w}
    dd = {f"{name}_win_rate_{d}d": f"w{d}" for d in w} | {f"{name}_top3_rate_{d}d": f"t{d}" for d in w}
    dd |= {f"{name}_momentum": "w180 - w365", f"{name}_relative_z": "coalesce((w365 - avg(w365) OVER g) / nullif(stddev_samp(w365) OVER g, 0), 0)"}
    return sql("tp", [base], i, dd)


@query("b_temporal_stats", temporal("person_a", "jockey"))
def temporal_jockey(spark, sf):
    df = runs(spark, sf)
    out = B.build(df, ["temporal_jockey_stats"])
    return finish(out, [c for c in out.columns if c not in df.columns])


register("temporal_trainer_stats", temporal("person_b", "trainer"))

_SP = [f"sp AS (SELECT *, rank() OVER (PARTITION BY group_id ORDER BY last_3f) AS r3 FROM runs)"]
register("strategy_pattern", sql("sp", _SP, {
    "is_dist_short_nige": f"CAST(coalesce(distance < lag(distance) OVER o AND lag({LEAD}) OVER o = 1, FALSE) AS INTEGER)",
    "is_jockey_change_dist_change": "CAST(coalesce(person_a <> lag(person_a) OVER o AND distance <> lag(distance) OVER o, FALSE) AS INTEGER)",
    "lag1_bad_luck_proxy": "CAST(coalesce(lag(r3) OVER o <= 3 AND lag(outcome) OVER o >= 6 AND lag(time_diff) OVER o <= 0.5, FALSE) AS INTEGER)"}))

_HC = dw("entity, class_level", 365)
_CS = [f"cs AS (SELECT *, coalesce(sign(class_level - lag(class_level) OVER ({H})), 0) AS step, count(*) OVER {_HC} AS n, {cnt('outcome <= 3', _HC)} AS t FROM runs)"]
register("class_stats", sql("cs", _CS, {"hc_n_races_365d": "n", "is_same_class_prev": "CAST(coalesce(class_level = lag(class_level) OVER o, FALSE) AS INTEGER)"}, {"hc_top3_rate_365d": rate("t", "n"), "class_trend_3": "coalesce(avg(step) OVER k3, 0)"}))

_SG = ["sg AS (SELECT *, count(*) OVER (PARTITION BY group_id) <= 10 AS small, distance BETWEEN 1400 AND 1800 AS mile FROM runs)"]
register("segment_stats", sql("sg", _SG, {"small_n_total": "count(*) FILTER (small) OVER p", "mile_n_total": "count(*) FILTER (mile) OVER p"}, {
    "horse_small_top3_rate": rate("count(*) FILTER (small AND outcome <= 3) OVER p", "count(*) FILTER (small) OVER p"), "horse_mile_top3_rate": rate("count(*) FILTER (mile AND outcome <= 3) OVER p", "count(*) FILTER (mile) OVER p")}))

_CO = "CAST(outcome >= 10 OR time_diff >= 2.0 AS INTEGER)"
register("risk_stats", sql("runs", ints={"resurrection_flag": f"CAST(coalesce(lag({_CO}) OVER o = 1 AND max({WIN}) OVER p = 1, FALSE) AS INTEGER)"}, dbls={
    "rank_std_5": "coalesce(stddev_samp(outcome) OVER k5, 0)", "time_diff_std_5": "coalesce(stddev_samp(time_diff) OVER k5, 0)", "collapse_rate_10": f"coalesce(avg({_CO}) OVER k10, 0)"}))

_KINDS = {"rot": "venue IN (4, 5, 7)", "str": "venue IN (4, 5, 7, 8, 9)", "slp": "venue IN (5, 6, 7, 9)"}
_CAI, _CAD = {}, {}
for _k, _e in _KINDS.items():
    _CAI |= {f"apt_{_k}_count": f"count(*) OVER {eup(_e)}", f"is_first_{_k}": f"CAST(count(*) OVER {eup(_e)} = 0 AS INTEGER)"}
    _CAD |= {f"apt_{_k}_win_rate": f"coalesce(avg({WIN}) OVER {eup(_e)}, 0)", f"apt_{_k}_top3_rate": f"coalesce(avg({TOP3}) OVER {eup(_e)}, 0)"}
register("course_aptitude", sql("runs", ints=_CAI, dbls=_CAD))

_XK = "xk AS (SELECT *, " + ", ".join(f"{e} AS {k}" for k, e in _KINDS.items()) + " FROM runs)"
_XC, _XJ, _XD = [_XK], "xk", {}
for _key, _nm in (("parent", "sire"), ("person_a", "jockey")):
    for _k in _KINDS:
        _t = f"x_{_nm}_{_k}"
        _XC.append(cells(_t, f"{_key}, {_k}", "xk", **{f"n_{_nm}_{_k}": "1", f"w_{_nm}_{_k}": WIN, f"t_{_nm}_{_k}": TOP3}))
        _XJ += f" JOIN {_t} USING ({_key}, {_k}, group_id)"
        _XD |= {f"{_nm}_apt_{_k}": rate(f"w_{_nm}_{_k}", f"n_{_nm}_{_k}"), f"{_nm}_apt_{_k}_top3": rate(f"t_{_nm}_{_k}", f"n_{_nm}_{_k}")}
register("extended_aptitude", sql(_XJ, _XC, dbls=_XD))

_ST = "CASE WHEN pass_1 <= 1 THEN 1 WHEN pass_1 <= 4 THEN 2 WHEN pass_1 <= 10 THEN 3 ELSE 4 END"
_RF = f"""rf0 AS (SELECT *, {', '.join(f'count(*) FILTER ({_ST} = {k}) OVER ({H} {UP}) AS m{k}' for k in (1, 2, 3, 4))} FROM runs),
rf1 AS (SELECT *, CASE WHEN m1 + m2 + m3 + m4 = 0 THEN 2 WHEN m1 >= m2 AND m1 >= m3 AND m1 >= m4 THEN 1 WHEN m2 >= m3 AND m2 >= m4 THEN 2 WHEN m3 >= m4 THEN 3 ELSE 4 END AS style FROM rf0),
rf AS (SELECT *, CAST(style = 1 AS INTEGER) AS lead, CAST(style >= 3 AS INTEGER) AS closer, CAST(venue IN (4, 5, 7, 8, 9) AS INTEGER) AS lng, count(*) FILTER (style = 1) OVER (PARTITION BY group_id) AS leads FROM rf1)"""
_RFI = {"pred_runstyle": "style", "n_nige_in_race": "leads", "n_other_nige": "leads - lead", "fit_nige_short": "lead * (1 - lng)", "fit_inner_nige": "lead * CAST(frame <= 3 AS INTEGER)", "fit_sashi_long": "closer * lng",
        "fit_nige_slow": "lead * CAST(leads - lead = 0 AS INTEGER)", "fit_sashi_high": "closer * CAST(leads - lead >= 2 AS INTEGER)"}
register("runstyle_fit", sql("rf", [_RF], _RFI))

register("jockey_trainer_compatibility", sql("runs JOIN jt USING (person_a, person_b, group_id) JOIN j USING (person_a, group_id)", [cells("jt", "person_a, person_b", n="1", w=WIN, t=TOP3), cells("j", "person_a", jn="1", jw=WIN, jt3=TOP3)],
    {"is_first_combo": "CAST(n = 0 AS INTEGER)"}, {"jt_win_diff": f"{rate('w', 'n')} - {rate('jw', 'jn')}", "jt_top3_diff": f"{rate('t', 'n')} - {rate('jt3', 'jn')}", "jt_log_count": "ln(1 + n)"}))

_IA = f"""ia0 AS (SELECT *, coalesce(day_no - lag(day_no) OVER ({H}), 999) AS gap FROM runs),
ia1 AS (SELECT *, CASE WHEN gap > 1800 THEN 0 WHEN gap > 60 THEN 3 WHEN gap > 28 THEN 2 ELSE 1 END AS code, CAST(sum(CAST(gap > 60 AS INTEGER)) OVER ({H} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS camp FROM ia0)"""
register("interval_aptitude", sql("ia1", [_IA], {"interval_days": "gap", "interval_type_code": "code", "tataki_count": "row_number() OVER (PARTITION BY entity, camp ORDER BY day_no, group_id, line, person_a)",
    "is_first_int_type": f"CAST(count(*) OVER {eup('code')} = 0 AS INTEGER)"}, {"apt_int_win": f"coalesce(avg({WIN}) OVER {eup('code')}, 0)", "apt_int_top3": f"coalesce(avg({TOP3}) OVER {eup('code')}, 0)"}))

register("physique_training", sql("runs", dbls={
    "weight_impact_score": "weight_diff / weight * 100 * CASE WHEN weight < 440 AND weight_diff < 0 THEN 1.5 ELSE 1 END",
    "best_weight_diff": "coalesce(weight - coalesce(avg(weight) FILTER (outcome <= 3) OVER p, avg(weight) OVER p), 0)", "training_accel_score": "CASE WHEN t4 > t1 AND t1 > 0 THEN (t4 - t1) / 3.0 - t1 ELSE 0 END"}))

_JS = [cells("pa", "person_a", n="1", w=WIN), f"jf AS (SELECT *, {rate('w', 'n', '0.05')} AS form FROM runs JOIN pa USING (person_a, group_id))"]
_JC = "coalesce(person_a <> lag(person_a) OVER o, FALSE)"
register("jockey_strategy", sql("jf", _JS, {"is_jockey_change": f"CAST({_JC} AS INTEGER)", "is_jockey_return": f"CAST(coalesce({_JC} AND person_a = lag(person_a, 2) OVER o, FALSE) AS INTEGER)", "is_top_jockey_switch": f"CAST({_JC} AND form >= 0.15 AS INTEGER)"},
    {"jockey_form": "form", "jockey_rate_diff": "coalesce(form - lag(form) OVER o, 0)"}))

_RD = [glob(gs="first_3f", gn="1"), f"rd AS (SELECT runs.*, round(coalesce(avg(first_3f) OVER ({H} {UP}), gs / nullif(gn, 0)), 9) AS x, coalesce(lag({LEAD}) OVER ({H}), 0) AS front FROM runs JOIN glb USING (day_no))",
       "rd2 AS (SELECT *, sum(front) OVER (PARTITION BY group_id) AS fc, avg(x) OVER (PARTITION BY group_id) AS lv, coalesce(stddev_samp(x) OVER (PARTITION BY group_id), 1) AS sd FROM rd)"]
register("race_dynamics", sql("rd2", _RD, {"front_runner_count": "CAST(fc AS BIGINT)", "is_sole_leader": "CAST(fc = 1 AND front = 1 AS INTEGER)", "is_high_pace_warn": "CAST(fc >= 3 AS INTEGER)"}, {"race_pace_level_3f": "lv", "relative_3f_score": "(lv - x) / nullif(sd, 0)"}))

_SA = [glob(gn="1", gw=WIN), f"sa0 AS (SELECT runs.*, {rate('gw', 'gn', '0.08')} AS prior, venue || '_' || surface || '_' || distance AS course, (distance // 200) * 200 AS bin FROM runs JOIN glb USING (day_no))"]
_SAD, _SAJ = {}, "sa0"
for _k, _n in (("course", "course"), ("bin", "dist"), ("surface", "surface")):
    _SAD[f"sire_{_n}_win_rate"] = f"(coalesce(sum({WIN}) OVER {up('parent, ' + _k)}, 0) + 10 * prior) / (count(*) OVER {up('parent, ' + _k)} + 10)"
    # s = 0.82 s + 0.18 x from the first value: weight 0.82^(age) * (1 for the first, else 0.18)
    _SA.append(f"""q_{_n} AS (SELECT *, row_number() OVER (PARTITION BY parent, {_k} {ALL_ROWS}) AS pos, {WIN} AS x FROM sa0),
      e_{_n} AS (SELECT group_id, line, entity, person_a, coalesce(power(0.82, pos - 2) * first_x + coalesce(power(0.82, pos - 1) * wsum, 0), 0.08) AS dec_{_n} FROM (
        SELECT *, first_value(x) OVER w1 AS first_x, sum(CASE WHEN pos > 1 THEN 0.18 * x * power(0.82, -pos) END) OVER w1 AS wsum FROM q_{_n} WINDOW w1 AS (PARTITION BY parent, {_k} {ALL_ROWS} {UP})))""")
    _SAJ += f" JOIN e_{_n} USING ({K})"
    _SAD[f"sire_{_n}_win_rate_decay"] = f"dec_{_n}"
_W50 = f"(PARTITION BY parent {ALL_ROWS} ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)"
_SAD |= {"sire_win_rate_std_50": f"CASE WHEN count(*) OVER {_W50} >= 5 THEN stddev_samp({WIN}) OVER {_W50} ELSE 0.08 END",
         "sire_win_rate_iqr_50": f"CASE WHEN count(*) OVER {_W50} >= 8 THEN quantile_cont({WIN}, 0.75) OVER {_W50} - quantile_cont({WIN}, 0.25) OVER {_W50} ELSE 0.08 END",
         "sire_variant_pref": rate(f"sum(variant * {TOP3}) OVER {up('parent')}", f"sum({TOP3}) OVER {up('parent')}"),
         "blood_variant_fit": f"exp(-abs(variant - {rate(f'sum(variant * {TOP3}) OVER ' + up('parent'), f'sum({TOP3}) OVER ' + up('parent'))}) / 0.8)"}
register("sire_aptitude", sql(_SAJ, _SA, dbls=_SAD))

_TB = ["tb AS (SELECT *, avg(pass_1) FILTER (outcome <= 5) OVER (PARTITION BY group_id) AS mp, avg(frame) FILTER (outcome <= 5) OVER (PARTITION BY group_id) AS mf FROM runs)"]
register("track_bias", sql("tb", _TB, dbls={"bias_adversity_score_mean_5": "coalesce(avg(1.0 / outcome * (1 + abs(pass_1 - mp) + 0.5 * abs(frame - mf))) OVER k5, 0)"}))

_FB = ["fb AS (SELECT *, CASE WHEN distance <= 1400 THEN 1 WHEN distance <= 1800 THEN 2 WHEN distance <= 2200 THEN 3 ELSE 4 END AS cat, CAST(frame <= 4 AS INTEGER) AS is_inner_frame FROM runs)",
       cells("f1", "venue, cat, surface, frame", "fb", n1="1", w1=WIN), cells("f2", "venue, cat, surface, is_inner_frame", "fb", n2="1", w2=WIN)]
register("frame_bias", sql("fb JOIN f1 USING (venue, cat, surface, frame, group_id) JOIN f2 USING (venue, cat, surface, is_inner_frame, group_id)", _FB, {"is_inner_frame": "is_inner_frame"},
    {"frame_cond_win_rate": rate("w1", "n1"), "inner_frame_win_rate": rate("w2", "n2"), "frame_advantage_score": "(9 - frame) / 8.0"}))

register("weight_pattern", sql("runs", dbls={"weight_volatility_5": "coalesce(stddev_samp(weight) OVER k5, 0)", "weight_trend_3": "coalesce(weight - avg(weight) OVER k3, 0)", "weight_vs_avg": "coalesce(weight - avg(weight) OVER p, 0)",
    "optimal_weight_diff": "coalesce(weight - avg(weight) FILTER (outcome <= 3) OVER p, 0)"}))

_REG = "CASE WHEN venue <= 2 THEN 'N' WHEN venue <= 6 THEN 'E' ELSE 'W' END"
_RP = [glob(gn="1", gt=TOP3), f"""rp0 AS (SELECT runs.*, {rate('gt', 'gn', '0.25')} AS prior, coalesce(day_no - lag(day_no) OVER o, 0) AS gap, coalesce(lag({_REG}) OVER o, {_REG}) || {_REG} AS hop, coalesce(lag(outcome) OVER o, 18) AS po FROM runs JOIN glb USING (day_no) WINDOW o AS ({H})),
 rp1 AS (SELECT *, CAST(gap >= 60 AS INTEGER) AS rest, CASE WHEN gap >= 60 THEN {TOP3} END AS rtop FROM rp0),
 rp2 AS (SELECT *, CASE WHEN lag(rest) OVER o = 1 THEN po - outcome END AS tat, count(rtop) OVER p AS rn, coalesce(sum(rtop) OVER p, 0) AS rt, row_number() OVER o AS pos, max(CASE WHEN rtop IS NOT NULL THEN pos0 END) OVER p AS lp
   FROM (SELECT *, row_number() OVER ({H}) AS pos0 FROM rp1) WINDOW o AS ({H}), p AS ({H} {UP})),
 rp2b AS (SELECT *, CASE WHEN rtop IS NULL OR lp IS NULL THEN 0 ELSE ln(power(0.75, pos - lp) / (power(0.75, pos - lp) + 0.25)) END AS la FROM rp2),
 rp2c AS (SELECT *, coalesce(sum(la) OVER p, 0) AS ab, coalesce(sum(la) OVER p, 0) + la AS aa FROM rp2b WINDOW p AS ({H} {UP})),
 rp3 AS (SELECT *, exp(ab) * sum(rtop * CASE WHEN lp IS NULL THEN 1 ELSE 1 - exp(la) END * exp(-aa)) OVER p AS dec FROM rp2c WINDOW p AS ({H} {UP}))"""]
_VP = rate(f"sum(variant * {TOP3}) OVER p", f"sum({TOP3}) OVER p")
_BI = "coalesce(avg(gap) FILTER (outcome <= 3) OVER p, 0)"
_TL = "CASE WHEN contains(hop, 'U') THEN 0.4 WHEN hop IN ('EW', 'WE') THEN 1.0 WHEN hop IN ('EN', 'NE') THEN 0.7 WHEN hop IN ('WN', 'NW') THEN 0.8 ELSE 0 END"
register("rest_pattern", sql("rp3", _RP, {"is_long_rest": "CAST(gap >= 180 AS INTEGER)"}, {
    "rest_success_rate": "coalesce(avg(rtop) OVER p, 0)", "rest_success_rate_smoothed": "(rt + 8 * prior) / (rn + 8)",
    "rest_success_rate_decay": "coalesce(dec, (rt + 8 * prior) / (rn + 8))",
    "optimal_rest_diff": f"gap - {_BI}", "rest_optimality_score": f"exp(-abs(gap - {_BI}) / (greatest(7.0, coalesce(stddev_samp(gap) FILTER (outcome <= 3) OVER p, 30)) + 1e-6))",
    "tataki_effectiveness": "coalesce(avg(tat) OVER p, 0)", "travel_load": _TL, "rotation_stress": f"0.35 * {_TL} + 0.35 * greatest(0, 21.0 - gap) / 21.0 + 0.15 * CAST(gap >= 180 AS INTEGER)",
    "horse_variant_pref": _VP, "horse_variant_match": f"-abs(variant - {_VP})"}))

_CD = ["cd AS (SELECT *, pass_4 / count(*) OVER (PARTITION BY group_id) AS fp FROM runs)"]
register("corner_dynamics", sql("cd", _CD, dbls={"corner_advance_score": "coalesce(avg(pass_3 - pass_4) OVER p, 0)", "avg_final_corner_pct": "coalesce(avg(fp) OVER p, 0.5)", "corner_acceleration": "coalesce(avg(pass_4 - outcome) OVER p, 0)"}))

register("training_detail", sql("runs", dbls={"training_acceleration": "CASE WHEN t4 > t1 THEN (t4 - t1) / 3.0 - t1 WHEN t3 > t1 THEN (t3 - t1) / 2.0 - t1 ELSE 0 END", "training_intensity_score": "CASE WHEN t4 > 10 THEN 40.0 / t4 WHEN t3 > 10 THEN 30.0 / t3 ELSE 0 END"}))

_BD = ["bd AS (SELECT *, (distance // 400) * 400 AS bin, CAST(going >= 3 AS INTEGER) AS heavy FROM runs)", glob(gn="1", gw=WIN, gt=TOP3)]
_BJ = "bd JOIN glb USING (day_no)"
for _t, _ks in (("nicks", "parent, parent2"), ("bms", "parent2"), ("nctx", "parent, parent2, surface, bin, heavy"), ("sctx", "parent, surface, bin, heavy"), ("bctx", "parent2, surface, bin, heavy")):
    _BD.append(cells(f"c_{_t}", _ks, "bd", **{f"n_{_t}": "1", f"w_{_t}": WIN, f"t_{_t}": TOP3}))
    _BJ += f" JOIN c_{_t} USING ({_ks}, group_id)"
_BDD = {f"{t}_{n}_rate": rate(f"{k}_{t}", f"n_{t}") for t in ("nicks", "bms") for k, n in (("w", "win"), ("t", "top3"))}
for _k, _n, _d in (("w", "win", "0.08"), ("t", "top3", "0.25")):
    _BDD[f"nicks_ctx_{_n}_rate_hier"] = f"({_k}_nctx + 3 * {rate(f'{_k}_sctx', 'n_sctx')} + 2 * {rate(f'{_k}_bctx', 'n_bctx')} + 8 * {rate(f'g{_k}', 'gn', _d)}) / (n_nctx + 13)"
_BDD |= {"sire_top3_std_50": f"CASE WHEN count(*) OVER {_W50} >= 5 THEN stddev_samp({TOP3}) OVER {_W50} ELSE 0 END",
         "sire_top3_iqr_50": f"CASE WHEN count(*) OVER {_W50} >= 8 THEN quantile_cont({TOP3}, 0.75) OVER {_W50} - quantile_cont({TOP3}, 0.25) OVER {_W50} ELSE 0 END"}
register("bloodline_detail", sql(_BJ, _BD, {"nicks_count": "n_nicks", "bms_count": "n_bms", "nicks_ctx_count": "n_nctx"}, _BDD))

_PG = "coalesce(lag(gear) OVER o, 0)"
register("horse_gear", sql("runs", ints={"has_blinker": "gear", "lag1_blinker": f"coalesce({_PG}, 0)", "is_first_blinker": f"CAST(gear = 1 AND {_PG} = 0 AS INTEGER)", "is_blinker_off": f"CAST(gear = 0 AND {_PG} = 1 AS INTEGER)"}))
register("race_attributes", sql("runs", ints={"field_size": "count(*) OVER g", "is_handicap_race_guess": "CAST(coalesce(stddev_samp(impost) OVER g, 0) > 0.8 AS INTEGER)"}, dbls={"race_impost_std": "coalesce(stddev_samp(impost) OVER g, 0)"}))
register("impost_features", sql("runs", dbls={"impost_change": "coalesce(impost - lag(impost) OVER o, 0)", "impost_change_abs": "abs(coalesce(impost - lag(impost) OVER o, 0))"}))

_FT = [f"fq AS (SELECT *, row_number() OVER ({H}) AS pos FROM runs)"]
for _c, _d, _n in (("outcome", "0.5", "r3"), ("outcome", "(2.0 / 3.0)", "r5"), ("time_diff", "0.5", "t3x")):
    _FT.append(f"e_{_n} AS (SELECT a.group_id, a.line, a.entity, a.person_a, sum(power({_d}, a.pos - b.pos) * b.{_c}) / sum(power({_d}, a.pos - b.pos)) AS {_n} FROM fq a JOIN fq b ON a.entity = b.entity AND b.pos < a.pos GROUP BY ALL)")
register("form_trend", sql(f"fq LEFT JOIN e_r3 USING ({K}) LEFT JOIN e_r5 USING ({K}) LEFT JOIN e_t3x USING ({K})", _FT, dbls={
    "rank_ewm_3": "coalesce(r3, 0)", "rank_ewm_5": "coalesce(r5, 0)", "time_diff_ewm_3": "coalesce(t3x, 0)", "rank_std_5": "CASE WHEN count(*) OVER k5 >= 3 THEN stddev_samp(outcome) OVER k5 ELSE 0 END",
    "rank_slope_5": "coalesce((2 * lag(outcome, 1) OVER o + lag(outcome, 2) OVER o - lag(outcome, 4) OVER o - 2 * lag(outcome, 5) OVER o) / 10.0, 0)"}))

_RC = [f"""x1 AS (SELECT group_id, venue, surface, avg(v) OVER r10 - avg(v) OVER p AS var, quantile_cont(v, 0.5) OVER r10 - quantile_cont(v, 0.5) OVER r50 AS rob, stddev_samp(v) OVER r10 / sqrt(count(v) OVER r10) AS u FROM (
  SELECT group_id, day_no, venue, surface, avg(run_time) AS v FROM runs GROUP BY ALL) WINDOW r10 AS (PARTITION BY venue, surface ORDER BY day_no, group_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), r50 AS (PARTITION BY venue, surface ORDER BY day_no, group_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), p AS (PARTITION BY venue, surface ORDER BY day_no, group_id {UP})),
 x2 AS (SELECT group_id, venue, avg(v) OVER r10 - avg(v) OVER p AS broad FROM (SELECT group_id, day_no, venue, avg(run_time) AS v FROM runs GROUP BY ALL) WINDOW r10 AS (PARTITION BY venue ORDER BY day_no, group_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), p AS (PARTITION BY venue ORDER BY day_no, group_id {UP}))"""]
register("race_conditions", sql("runs JOIN x1 USING (group_id, venue, surface) JOIN x2 USING (group_id, venue)", _RC, dbls={"track_variant": "coalesce(var, broad, 0)", "track_variant_robust": "coalesce(rob, 0)", "track_uncertainty": "coalesce(u, 0)", "track_confidence": "coalesce(1 / (1 + u), 0.5)"}))

_RST = [_PACE, _RF, f"""st0 AS (SELECT {K}, rf.*  EXCLUDE ({K}), lnr, afc FROM rf JOIN (SELECT {K}, coalesce(avg({LEAD}) OVER k5, 0) AS lnr, coalesce(avg(pn) OVER k5, 0.5) AS afc, coalesce(avg(pci) OVER k5, 50) AS avg_pci FROM pc WINDOW k5 AS ({H} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) USING ({K})),
 gl AS (SELECT group_id, day_no, sum(lnr) AS g1, avg(lnr) AS gm, CAST(count(*) FILTER (lnr > 0.2) AS DOUBLE) AS g2, CAST(count(*) AS DOUBLE) AS g4, {' + '.join(f'CASE WHEN count(*) FILTER (style = {k}) > 0 THEN -(count(*) FILTER (style = {k}) / count(*)) * ln(count(*) FILTER (style = {k}) / count(*)) ELSE 0 END' for k in (1, 2, 3, 4))} AS g3 FROM st0 GROUP BY group_id, day_no),
 gd AS (SELECT day_no, sum(c) OVER d AS c, {', '.join(f'sum(s{i}) OVER d AS s{i}, sum(q{i}) OVER d AS q{i}' for i in (1, 2, 3, 4))} FROM (SELECT day_no, count(*) AS c, {', '.join(f'sum(g{i}) AS s{i}, sum(g{i} * g{i}) AS q{i}' for i in (1, 2, 3, 4))} FROM gl GROUP BY day_no) WINDOW d AS (ORDER BY day_no {UP})),
 gp AS (SELECT group_id, g1, gm, g2, g3, g4, 1 / (1 + exp(-(-0.5 + {' + '.join(f'{w} * coalesce(CASE WHEN (q{i} - c * (s{i} / c) * (s{i} / c)) / nullif(c - 1, 0) > 1e-9 THEN (g{i} - s{i} / c) / sqrt((q{i} - c * (s{i} / c) * (s{i} / c)) / (c - 1)) END, 0)' for i, w in ((1, 0.9), (2, 0.7), (3, 0.4), (4, 0.3)))}))) AS php FROM gl JOIN gd USING (day_no)),
 st AS (SELECT st0.*, g1, gm, g2, g3, php, round(greatest(0, least(1, afc)) * greatest(g4 - 1, 1) + 1, 9) AS mu FROM st0 JOIN gp USING (group_id)),
 cg AS (SELECT a.group_id, a.line, a.entity, a.person_a, sum(exp(-abs(a.mu - b.mu) / 1.5) * b.lnr) - a.lnr AS cong FROM st a JOIN st b ON a.group_id = b.group_id GROUP BY a.group_id, a.line, a.entity, a.person_a, a.lnr)"""]


@query("b_race_structure", sql(f"st JOIN cg USING ({K})", _RST, {"struct_nige_count": "CAST(g2 AS BIGINT)"}, {
    "struct_early_speed_sum": "g1", "struct_early_speed_mean": "gm", "style_entropy": "g3", "pace_high_prob": "php",
    "pace_fit_expected": "php * (closer * CAST(leads - lead >= 2 AS INTEGER)) + (1 - php) * (lead * CAST(leads - lead = 0 AS INTEGER))", "front_congestion_idx": "cong"}))
def race_structure(spark, sf):
    out = B.build(runs(spark, sf), ["race_structure"])
    return finish(out, ["struct_nige_count", "struct_early_speed_sum", "struct_early_speed_mean", "style_entropy", "pace_high_prob", "pace_fit_expected", "front_congestion_idx"])


_LF = [_PACE, f"lf AS (SELECT *, {_PACE_D['last_nige_rate']} AS lnr, {_PACE_D['avg_pci']} AS ap FROM pc WINDOW k5 AS ({H} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"]


@query("b_lap_fit", sql("lf", _LF, dbls={"lap_fit_interaction": "ap * sum(lnr) OVER g"}))
def lap_fit(spark, sf):
    return finish(B.build(runs(spark, sf), ["lap_fit"]), ["lap_fit_interaction"])


_DL = ["dl AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS size FROM runs)"]
_DLI, _DLD = {}, {"impost_diff_prev": "impost - lag(impost) OVER o", "lag1_last_3f": "lag(last_3f) OVER o", "lag1_impost": "lag(impost) OVER o", "lag2_impost": "lag(impost, 2) OVER o"}
for _n, _c, _m in (("field_size", "size", 2), ("first_corner_rank", "pass_1", 1), ("surface", "surface", 3), ("distance", "distance", 3), ("going_code", "going", 3), ("venue", "venue", 3)):
    _DLI |= {f"lag{i}_{_n}": f"lag({_c}, {i}) OVER o" for i in range(1, _m + 1)}
register("deep_lag_extended", sql("dl", _DL, _DLI, _DLD))

_SFD = {}
for _k, _n in (("person_a", "jockey"), ("person_b", "trainer")):
    for _d in (30, 60):
        _w = dw(_k, _d)
        _SFD |= {f"{_n}_win_rate_{_d}d": rate(cnt("outcome = 1", _w), f"count(*) OVER {_w}"), f"{_n}_top3_rate_{_d}d": rate(cnt("outcome <= 3", _w), f"count(*) OVER {_w}")}
register("stable_form", sql("runs", dbls=_SFD))

register("horse_events", sql("runs", ints={"trainer_change": "CAST(coalesce(person_b <> lag(person_b) OVER o, FALSE) AS INTEGER)", "first_run_after_gelding": "CAST(coalesce(lag(sex) OVER o = 'M' AND sex = 'G', FALSE) AS INTEGER)"}))


@query("b_aptitude_smoothing", sql("runs", dbls={"jockey_win_rate_smoothed": f"({cnt('outcome = 1', _J)} + 10 * 0.08) / ({_JN} + 10)", "jockey_top3_rate_smoothed": f"({cnt('outcome <= 3', _J)} + 10 * 0.25) / ({_JN} + 10)"}))
def aptitude_smoothing(spark, sf):
    return finish(B.build(runs(spark, sf), ["aptitude_smoothing"]), ["jockey_win_rate_smoothed", "jockey_top3_rate_smoothed"])


_RX = [f"rx AS (SELECT *, round(avg(outcome) OVER ({H} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 9) AS f FROM runs)"]
register("relative_expansion", sql("rx", _RX, dbls={"relative_form_z": "coalesce((f - avg(f) OVER g) / nullif(stddev_samp(f) OVER g, 0), 0)",
    "relative_form_pct": "CASE WHEN f IS NULL THEN 0.5 ELSE (rank() OVER (PARTITION BY group_id ORDER BY f NULLS LAST) + (count(*) OVER (PARTITION BY group_id, f) - 1) / 2.0) / count(f) OVER g END", "relative_form_gap": "max(f) OVER g - f"}))

register("mining_features", sql("runs", ints={"yoso_juni_diff": "coalesce(lag(outcome - expected_rank) OVER o, 0)"}, dbls={"yoso_time_diff": "coalesce(lag(run_time - expected_time) OVER o, 0)"}))

_TA = [f"ta AS (SELECT *, going - coalesce(lag(going) OVER ({H}), 0) AS shift FROM runs)"]
_MN = "count(*) FILTER (going >= 3) OVER p"
_MT = "count(*) FILTER (going >= 3 AND outcome <= 3) OVER p"
_GN = f"count(*) OVER {eup('going')}"
register("track_aptitude", sql("ta", _TA, {"horse_going_count": _GN, "going_shift": "shift", "is_proven_mudder": f"CAST(coalesce({_MN} >= 2 AND {_MT} / nullif({_MN}, 0) >= 0.33, FALSE) AS INTEGER)"}, {
    "horse_going_win_rate": rate(cnt("outcome = 1", eup("going")), _GN), "horse_going_top3_rate": rate(cnt("outcome <= 3", eup("going")), _GN),
    "going_shift_up_top3_rate": f"coalesce(avg({TOP3}) FILTER (shift >= 1) OVER p, 0)", "going_shift_down_top3_rate": f"coalesce(avg({TOP3}) FILTER (shift <= -1) OVER p, 0)"}))


@query("b_attribute_features", sql("runs JOIN ppl ON person_a = code", ["ppl AS (SELECT s_suppkey AS code, DATE '1960-01-01' + CAST(s_suppkey * 37 % 9000 AS INTEGER) AS born, CASE WHEN s_nationkey < 20 THEN DATE '1985-01-01' + CAST(s_suppkey * 11 % 3000 AS INTEGER) END AS licensed, s_nationkey % 4 + 1 AS b FROM supplier)"],
    {"jockey_belong_code": "b"}, {"jockey_age": "date_diff('day', born, day) / 365.25", "jockey_career_years": "coalesce(date_diff('day', licensed, day) / 365.25, -1)"}))
def attribute_features(spark, sf):
    k = F.col("s_suppkey")
    shift = lambda base, n: F.date_add(F.lit(base).cast("date"), n.cast("int"))
    people = table(spark, sf, "supplier").select(k.alias("code"), shift("1960-01-01", k * 37 % 9000).alias("born"), F.when(F.col("s_nationkey") < 20, shift("1985-01-01", k * 11 % 3000)).alias("licensed"), (F.col("s_nationkey") % 4 + 1).alias("belongs"))
    out = B.attribute_features(runs(spark, sf), people, "person_a", "jockey")
    return finish(out, ["jockey_belong_code", "jockey_age", "jockey_career_years"])


_HOME = "CASE person_a % 4 + 1 WHEN 1 THEN 'E' WHEN 2 THEN 'W' WHEN 3 THEN 'L' ELSE 'O' END"


@query("b_logistics_features", sql("runs", ints={"is_away_jockey": f"CAST(({_HOME} = 'E' AND {_REG} = 'W') OR ({_HOME} = 'W' AND {_REG} = 'E') OR ({_HOME} IN ('E', 'W') AND {_REG} = 'N') AS INTEGER)"}))
def logistics_features(spark, sf):
    return finish(B.logistics_features(runs(spark, sf), F.col("person_a") % 4 + 1, "is_away_jockey"), ["is_away_jockey"])


_PF = [f"""pg AS (SELECT group_id, pd, CASE WHEN pd > 2 THEN 2 WHEN pd < -2 THEN 0 ELSE 1 END AS pt, coalesce(CASE WHEN count(*) OVER c >= 10 THEN (pd - avg(pd) OVER c) / nullif(stddev_samp(pd) OVER c, 0) END, 0) AS pz FROM (
  SELECT group_id, day_no, round(avg(first_3f - last_3f), 9) AS pd, min(venue) AS v, min(surface) AS s FROM runs GROUP BY group_id, day_no) WINDOW c AS (PARTITION BY v, s ORDER BY day_no, group_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING))"""]
register("pace_features", sql("runs JOIN pg USING (group_id)", _PF, {"pace_type": "pt", "horse_fast_pace_count": "count(*) FILTER (pt = 2) OVER p", "horse_slow_pace_count": "count(*) FILTER (pt = 0) OVER p"}, {
    "pace_diff": "pd", "pace_diff_z_ctx": "pz", "horse_avg_pace_diff": "coalesce(avg(pd) OVER p, 0)", "horse_pace_versatility": "coalesce(stddev_samp(pd) OVER p, 0)",
    "horse_pace_elasticity_20": f"CASE WHEN count(*) OVER k20 >= 5 THEN covar_samp({TOP3}, pd) OVER k20 / (var_samp(pd) OVER k20 + 1e-6) ELSE 0 END"}))

_CF = ["cf AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS size, pass_1 - pass_4 AS gain FROM runs)"]
register("corner_features", sql("cf", _CF, {"horse_total_makuri": "CAST(coalesce(sum(greatest(0, gain)) OVER p, 0) AS BIGINT)"}, {"horse_avg_corner_change": "coalesce(avg(gain / size) OVER p, 0)", "horse_makuri_rate": "coalesce(avg(CAST(gain > 0 AS INTEGER)) OVER p, 0)"}))


@query("b_rating_elo")
def rating_elo(spark, sf):
    # All columns would go to the fold and back.
    df = runs(spark, sf).select(*KEY, "day_no", "outcome", F.concat_ws("_", "surface", "venue").alias("surface_pool"))
    return finish(B.build(df, ["rating_elo"]), ["rating", "field_elo_mean", "elo_gap_to_top"])


_HH = ["ent AS (SELECT group_id, day_no, entity, min(outcome) AS oc FROM runs GROUP BY ALL)",
       "edges AS (SELECT a.group_id, a.day_no, a.entity AS e1, b.entity AS e2, CAST(a.oc < b.oc AS INT) AS won FROM ent a JOIN ent b ON a.group_id = b.group_id AND a.entity <> b.entity)",
       f"hh AS (SELECT group_id, e1 AS entity, sum(m) AS m, sum(w) AS w FROM (SELECT group_id, e1, count(*) OVER e AS m, coalesce(sum(won) OVER e, 0) AS w FROM edges WINDOW e AS (PARTITION BY e1, e2 ORDER BY day_no, group_id {UP})) GROUP BY ALL)"]


@query("b_head_to_head", sql("runs LEFT JOIN hh USING (group_id, entity)", _HH, {"vs_matches": "CAST(coalesce(m, 0) AS BIGINT)"}, {"vs_win_rate": rate("w", "m")}))
def head_to_head(spark, sf):
    return finish(B.build(runs(spark, sf), ["head_to_head"]), ["vs_matches", "vs_win_rate"])


@query("b_odds_fluctuation", sql("runs", dbls={"odds_ratio_early_late": "t4 / price", "odds_ratio_late_final": "t1 / t4", "odds_log_ratio": "ln(t4 / price)", "odds_drop_rate": "(price - t4) / price"}))
def odds_fluctuation(spark, sf):
    return finish(B.odds_fluctuation(runs(spark, sf), "price", "t4", "t1"), ["odds_ratio_early_late", "odds_ratio_late_final", "odds_log_ratio", "odds_drop_rate"])


register("undervalued_features", sql("runs", ints={"is_high_odds": "CAST(price >= 10 AS INTEGER)", "is_mid_odds": "CAST(price >= 5 AND price < 10 AS INTEGER)"}, dbls={
    "odds_rank_vs_expected": "rank() OVER (PARTITION BY group_id ORDER BY price) + (count(*) OVER (PARTITION BY group_id, price) - 1) / 2.0 - expected_rank"}))
register("experience_features", sql("runs", ints={"career_runs": "count(*) OVER p", "is_first_distance": f"CAST(count(*) OVER {eup('CASE WHEN distance <= 1400 THEN 1 WHEN distance <= 1800 THEN 2 WHEN distance <= 2200 THEN 3 ELSE 4 END')} = 0 AS INTEGER)",
    "is_career_high_prize": "CAST(coalesce(prize > max(prize) OVER p, FALSE) AS INTEGER)"}, dbls={"distance_vs_usual": "distance - avg(distance) OVER p"}))
_OP = [f"op AS (SELECT *, coalesce(avg(outcome) OVER ({H} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 9) AS f FROM runs)"]
register("opposition_features", sql("op", _OP, dbls={"rivals_form": "(sum(f) OVER g - f) / nullif(count(*) OVER g - 1, 0)", "form_behind_best": "f - min(f) OVER g"}))
_RL = ["rl AS (SELECT *, avg(prize) OVER (PARTITION BY group_id) AS lvl FROM runs)"]
register("race_level_features", sql("rl", _RL, dbls={"prev_race_level": "lag(lvl) OVER o", "mean_race_level_3": "avg(lvl) OVER k3"}))
_DF = ["df0 AS (SELECT *, avg(pass_1) OVER (PARTITION BY group_id) AS mid FROM runs)", "df1 AS (SELECT *, CAST(frame >= 6 AND pass_1 > mid AS INTEGER) + CAST(pass_1 >= 10 AS INTEGER) AS tr, sqrt(abs((pass_1 * pass_1 + pass_3 * pass_3 + pass_4 * pass_4) / 3.0 - power((pass_1 + pass_3 + pass_4) / 3.0, 2))) AS spread FROM df0)"]
register("disadvantage_features", sql("df1", _DF, dbls={"trouble_rate": "coalesce(avg(CAST(tr > 0 AS INTEGER)) OVER p, 0)", "trouble_mean_3": "coalesce(avg(tr) OVER k3, 0)", "position_spread": "lag(spread) OVER o"}))


@query("x01_block_selection", sql("pc", [_PACE], {"run_count": "count(*) OVER p", "trainer_change": "CAST(coalesce(person_b <> lag(person_b) OVER o, FALSE) AS INTEGER)"}, {"avg_pci": _PACE_D["avg_pci"], "impost_change": "coalesce(impost - lag(impost) OVER o, 0)"}))
def x01(spark, sf):
    """Several blocks by name on one frame: entity-keyed blocks share one exchange."""
    df = B.build(runs(spark, sf), ["history_stats", "pace_stats", "horse_events", "impost_features"])
    return finish(df, ["run_count", "avg_pci", "trainer_change", "impost_change"])
