"""SQL texts that a single-node SQL engine can run on the same tables to check
the registered queries. They are written independently of the operators, with
joins and plain aggregates, and start from the same derived readings."""

from __future__ import annotations

# Fixed values, written out so that the texts share nothing with the operators:
# features and models in their order, the columns of the day matrix, and the
# passes of the repair.
FEATURES = ["Temperature", "Solar_Irradiation", "Holiday", "DATE_day_year", "DATE_day_week", "DATE_weekday"]
MODELS = ["TOW", "ClustH", "ClustH_PRED"]
SERIES = ["Power", "Power_fitted_TOW", "Power_fitted_ClustH", "Power_fitted_ClustH_PRED"]
POWER_COLUMNS = [f"Power_{h:02d}" for h in range(24)]
SCHEDULE = [(1, 1), (1, 2), (2, 1), (1, 3), (2, 2), (3, 1), (1, 4), (2, 3), (3, 2), (4, 1), (1, 5), (2, 4), (3, 3), (4, 2), (5, 1)]

# --- shared common table expressions -------------------------------------------

WEATHER = """
  SELECT building_id, "DATE", (dy % 15 = 1) AS "Holiday",
         CASE WHEN ((dy - 1) * 24 + hh) % 211 = 7 THEN NULL
              ELSE ((dy * 13 + hh * 7) % 45) * 1.0E0 - 12.5E0 END AS "Temperature",
         CASE WHEN ((dy - 1) * 24 + hh) % 307 = 11 THEN NULL
              WHEN hh BETWEEN 6 AND 18 THEN ((dy * 31 + hh * 17) % 80) * 10.0E0
              ELSE 0.0E0 END AS "Solar_Irradiation",
         "Power"
  FROM (SELECT *, dayofyear("DATE") AS dy, hour("DATE") AS hh FROM {source})"""

EVENTS = {
    "ev_power": """
  SELECT event_type || '-' || CAST(user_id // 150 AS VARCHAR) AS building_id, date_trunc('hour', ts) AS "DATE",
         CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS "Power"
  FROM events GROUP BY 1, 2""",
    "ev_hours": """
  SELECT building_id, unnest(generate_series(min("DATE"), max("DATE"), INTERVAL 1 HOUR)) AS "DATE"
  FROM ev_power GROUP BY building_id""",
    "ev_grid": """
  SELECT h.building_id, h."DATE", p."Power" FROM ev_hours h LEFT JOIN ev_power p USING (building_id, "DATE")""",
    "r": WEATHER.format(source="ev_grid"),
}

LOST = {name: text for name, text in EVENTS.items() if name != "r"} | {
    "r_all": EVENTS["r"],
    "r": """
  SELECT * REPLACE (CASE WHEN ((dayofyear("DATE") - 1) * 24 + hour("DATE")) % 83 <> 17 THEN "DATE" END AS "DATE") FROM r_all""",
}

LINES = {
    "li_power": """
  SELECT 'site-' || CAST(l_suppkey // 100 AS VARCHAR) AS building_id,
         date_trunc('day', l_shipdate) + INTERVAL 1 HOUR * (l_orderkey % 24) AS "DATE",
         CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS "Power"
  FROM lineitem GROUP BY 1, 2""",
    "r": WEATHER.format(source="li_power"),
}

CAL = {
    "c": """
  SELECT r.*, CAST("DATE" AS DATE) AS "DATE_YYYY_MM_DD", year("DATE") AS "DATE_year", month("DATE") AS "DATE_month_year",
         weekofyear("DATE") AS "DATE_week_year", dayofyear("DATE") AS "DATE_day_year", day("DATE") AS "DATE_day_month",
         isodow("DATE") - 1 AS "DATE_day_week", (dayofyear("DATE") - 1) * 24 + hour("DATE") AS "DATE_hour_year",
         (isodow("DATE") - 1) * 24 + hour("DATE") AS "DATE_hour_week", hour("DATE") AS "DATE_hour_day",
         isodow("DATE") < 6 AS "DATE_weekday"
  FROM r"""
}


def params_sql(source: str, key: str, t: int, i: int, b: int, m: int, base: float) -> str:
    return f"""
  SELECT building_id, k AS "{key}", 0.0E0 - (k % {t} + 1) * 0.25E0 AS "slope_Temp",
         0.0E0 - (k % {i}) * 0.0625E0 AS "slope_Irrad", (k % {b}) * 4.0E0 + {base}E0 AS "intercept",
         (k % {m}) * 1.0E0 + 2.0E0 AS "minimum"
  FROM (SELECT DISTINCT building_id, "{key}" AS k FROM {source})"""


PAR = {"par": params_sql("c", "DATE_hour_week", 5, 3, 7, 2, 140.0)}


def fit_sql(missing: str = "NULL", floor: bool = True, minimum: str = '"minimum"') -> str:
    line = '"intercept" + "slope_Temp" * "Temperature" + "slope_Irrad" * "Solar_Irradiation"'
    value = f"greatest({minimum}, {line})"
    if floor:
        value = f"greatest({value}, 0.0E0)"
    return (
        f'CASE WHEN "slope_Temp" IS NULL THEN NULL WHEN "Temperature" IS NULL OR "Solar_Irradiation" IS NULL '
        f"THEN {missing} ELSE {value} END"
    )


SCORED = {
    "s": f"""
  SELECT *, "Power_fitted" - "Power" AS "Power_residuals"
  FROM (SELECT c.*, p."slope_Temp", p."slope_Irrad", p."intercept", p."minimum", {fit_sql()} AS "Power_fitted"
        FROM c LEFT JOIN par p USING (building_id, "DATE_hour_week"))"""
}

FLAGGED = {
    "f": """
  SELECT s.*, coalesce(abs(s."Power_residuals" - m.mu) > 1.96E0 * m.sd, false) AS is_outlier
  FROM s LEFT JOIN (SELECT building_id, avg("Power_residuals") AS mu, stddev_pop("Power_residuals") AS sd
                    FROM s GROUP BY building_id) m USING (building_id)"""
}

PENDING = {
    "pend": """
  SELECT *, is_missing OR is_outlier AS bad
  FROM (SELECT *, ("Temperature" IS NULL OR "Solar_Irradiation" IS NULL OR "Power" IS NULL) AS is_missing FROM f)"""
}


def repair_pass_sql(pre: int, post: int) -> dict[str, str]:
    """One pass by self-joins on exact times."""
    week = 168
    offsets = {"ph": -pre, "nh": post, "pw": -week, "nw": week, "pwp": -week - pre, "pwn": -week + post,
               "nwp": week - pre, "nwn": week + post}
    joins = "\n".join(
        f'  LEFT JOIN pend {a} ON {a}.building_id = t.building_id AND {a}."DATE" = t."DATE" + INTERVAL 1 HOUR * ({h})'
        for a, h in offsets.items()
    )
    trusted = " AND ".join(f"coalesce(NOT {a}.bad, false)" for a in offsets)
    value = ('(pw."Power" + nw."Power") / 2 + (ph."Power" + nh."Power") / 2 '
             '- (pwp."Power" + pwn."Power" + nwp."Power" + nwn."Power") / 4')
    return {
        "edges": f"""
  SELECT building_id, "DATE",
         bad AND NOT coalesce(lag(bad, {pre}) OVER w, false) AND NOT coalesce(lead(bad, {post}) OVER w, false) AS edge
  FROM pend WINDOW w AS (PARTITION BY building_id ORDER BY "DATE")""",
        "rp": f"""
  SELECT t.*, e.edge, {trusted} AS trusted, t.bad AND {trusted} AS "IS_Repaired",
         CASE WHEN e.edge AND {trusted} THEN {value} ELSE t."Power" END AS "Power_corrected"
  FROM pend t JOIN edges e USING (building_id, "DATE")
{joins}""",
    }


def repair_all_sql() -> dict[str, str]:
    """All passes; each reads the flags the previous one left."""
    ctes = {
        "q0": """
  SELECT building_id, "DATE", "Power", bad, bad AS pending, false AS repaired, "Power" AS corrected,
         epoch("DATE") // 3600 AS hr FROM pend WHERE "DATE" IS NOT NULL"""
    }
    week = 168

    def at(expr: str, h: int) -> str:
        bound = f"{abs(h)} {'FOLLOWING' if h > 0 else 'PRECEDING'}"
        return f"first({expr}) OVER (PARTITION BY building_id ORDER BY hr RANGE BETWEEN {bound} AND {bound})"

    for n, (pre, post) in enumerate(SCHEDULE, start=1):
        weekly, hourly = (-week, week), (-pre, post)
        corners = (-week - pre, -week + post, week - pre, week + post)
        trusted = " AND ".join(f"coalesce({at('NOT pending', h)}, false)" for h in (*weekly, *hourly, *corners))
        total = {name: " + ".join(at('"Power"', h) for h in hs)
                 for name, hs in (("w", weekly), ("h", hourly), ("c", corners))}
        ctes[f"p{n}"] = f"""
  SELECT *, {trusted} AS trusted,
         pending AND NOT coalesce(lag(pending, {pre}) OVER w, false) AND NOT coalesce(lead(pending, {post}) OVER w, false) AS edge,
         ({total['w']}) / 2 + ({total['h']}) / 2 - ({total['c']}) / 4 AS v
  FROM q{n - 1} WINDOW w AS (PARTITION BY building_id ORDER BY hr)"""
        ctes[f"q{n}"] = f"""
  SELECT building_id, "DATE", "Power", bad, pending AND NOT trusted AS pending, repaired OR (pending AND trusted) AS repaired,
         CASE WHEN edge AND trusted THEN v ELSE corrected END AS corrected, hr FROM p{n}"""
    return ctes


LAST_PASS = f"q{len(SCHEDULE)}"
REPAIR = repair_pass_sql(1, 1)

COMPARISON = {
    "typed": """
  SELECT *, cluster * 100 + "DATE_hour_day" AS "ClusterHour", cluster_pred * 100 + "DATE_hour_day" AS "ClusterHour_PRED"
  FROM (SELECT * EXCLUDE ("slope_Temp", "slope_Irrad", "intercept", "minimum"), "DATE_day_year" % 3 AS cluster,
               ("DATE_day_year" * 5 // 2) % 3 AS cluster_pred
        FROM pend WHERE NOT bad)""",
    "par_c": params_sql("typed", "ClusterHour", 4, 3, 9, 2, 150.0),
    "par_p": params_sql("typed", "ClusterHour_PRED", 3, 5, 11, 3, 145.0),
    "fit_c": f"""
  SELECT building_id, "DATE", {fit_sql(floor=False)} AS fit FROM typed LEFT JOIN par_c USING (building_id, "ClusterHour")""",
    "fit_p": f"""
  SELECT building_id, "DATE", {fit_sql(floor=False)} AS fit FROM typed LEFT JOIN par_p USING (building_id, "ClusterHour_PRED")""",
    "cmp": """
  SELECT t.*, t."Power_fitted" AS "Power_fitted_TOW", a.fit AS "Power_fitted_ClustH", b.fit AS "Power_fitted_ClustH_PRED"
  FROM typed t JOIN fit_c a USING (building_id, "DATE") JOIN fit_p b USING (building_id, "DATE")""",
    "res": """
  SELECT *, """ + ", ".join(f'"Power_fitted_{m}" - "Power" AS r_{m}' for m in MODELS) + " FROM cmp",
    "cum": "\n  SELECT *, " + ", ".join(
        f'sum(r_{m}) OVER (PARTITION BY building_id ORDER BY "DATE" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS r_{m}_{n}'
        for m in MODELS for n in (3, 6)
    ) + " FROM res",
}

MATRIX = {
    "dm": 'SELECT building_id, CAST("DATE" AS DATE) AS "DATE_YYYY_MM_DD", '
    + ", ".join(f'max("Power") FILTER (hour("DATE") = {h}) AS "{c}"' for h, c in enumerate(POWER_COLUMNS))
    + ' FROM r GROUP BY 1, 2 HAVING count("Power") > 0'
}
_ALL = ", ".join(f'"{c}"' for c in POWER_COLUMNS)
UNIT = {
    "whole_days": "SELECT *, " + f"greatest({_ALL}) AS hi, least({_ALL}) AS lo FROM dm WHERE "
    + " AND ".join(f'"{c}" IS NOT NULL' for c in POWER_COLUMNS),
    "unit": 'SELECT building_id, "DATE_YYYY_MM_DD", '
    + ", ".join(f'CASE WHEN hi = lo THEN 0.0E0 ELSE ("{c}" - lo) / (hi - lo) END AS "{c}"' for c in POWER_COLUMNS)
    + " FROM whole_days",
    "pts": f"""
  SELECT building_id, "DATE_YYYY_MM_DD" AS d, dayofyear("DATE_YYYY_MM_DD") AS dy, [{_ALL}] AS v FROM unit""",
    "cells": """
  SELECT building_id, d, dy, h - 1 AS "hour", v[h] AS "value" FROM pts, (SELECT unnest(range(1, 25)) AS h)""",
}

WSS = {
    "wss": "\n  UNION ALL ".join(
        f"""SELECT building_id, {k} AS k, sum(("value" - mu) * ("value" - mu)) AS wss
  FROM (SELECT *, avg("value") OVER (PARTITION BY building_id, dy % {k}, "hour") AS mu FROM cells) GROUP BY building_id"""
        for k in range(1, 31)
    ),
    "drops": """
  SELECT *, max(d) OVER (PARTITION BY building_id) AS top
  FROM (SELECT building_id, k, abs(lag(wss) OVER (PARTITION BY building_id ORDER BY k) - wss) AS d FROM wss)""",
    "elbow": """
  SELECT building_id, coalesce(min(k) FILTER (d > 0.05E0 * top), 3) AS k_elbow FROM drops GROUP BY building_id""",
}

SILHOUETTE = {
    "lab": """
  SELECT building_id, d, v, k, dy % k AS cl FROM pts, (SELECT unnest(range(2, 31)) AS k)""",
    "dist": """
  SELECT a.building_id, a.k, a.d, a.cl, b.cl AS other, sum(list_distance(a.v, b.v)) AS total, count(*) AS n
  FROM lab a JOIN lab b ON a.building_id = b.building_id AND a.k = b.k GROUP BY ALL""",
    "ab": """
  SELECT building_id, k, d, max(n) FILTER (other = cl) AS own, max(total / greatest(n - 1, 1)) FILTER (other = cl) AS a,
         min(total / n) FILTER (other <> cl) AS b, count(*) AS types FROM dist GROUP BY ALL""",
    "sil": """
  SELECT building_id, k, round(avg(CASE WHEN own = 1 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette
  FROM ab GROUP BY building_id, k HAVING max(types) > 1 AND max(types) < count(*)""",
}

FEATURE_DAYS = {
    "days": """
  SELECT building_id, CAST("DATE" AS DATE) AS "DATE_YYYY_MM_DD", avg("Temperature") AS "Temperature",
         coalesce(sum("Solar_Irradiation"), 0.0E0) AS "Solar_Irradiation", arg_min("Holiday", "DATE") AS "Holiday",
         dayofyear(CAST("DATE" AS DATE)) AS "DATE_day_year", isodow(CAST("DATE" AS DATE)) - 1 AS "DATE_day_week",
         isodow(CAST("DATE" AS DATE)) < 6 AS "DATE_weekday"
  FROM r GROUP BY ALL""",
    "fd": """
  SELECT *, "DATE_day_year" % 3 AS cluster, ("DATE_day_year" * 5 // 2) % 3 AS cluster_pred FROM days WHERE "Temperature" IS NOT NULL""",
}

SPLIT = {
    "cls": "SELECT building_id, cluster, count(*) AS n_class FROM fd GROUP BY 1, 2",
    "quota": """
  SELECT building_id, cluster, n_class - whole
         - CASE WHEN row_number() OVER (PARTITION BY building_id ORDER BY rest DESC, cluster)
                     <= train - sum(whole) OVER (PARTITION BY building_id) THEN 1 ELSE 0 END AS q
  FROM (SELECT *, n_class * train // n AS whole, n_class * train % n AS rest
        FROM (SELECT *, n - CAST(ceil(0.2E0 * n) AS BIGINT) AS train
              FROM (SELECT *, CAST(sum(n_class) OVER (PARTITION BY building_id) AS BIGINT) AS n FROM cls)))""",
    "split": """
  SELECT fd.*, row_number() OVER (PARTITION BY fd.building_id, fd.cluster
                ORDER BY md5('42|' || fd.building_id || '|' || CAST(fd."DATE_YYYY_MM_DD" AS VARCHAR))) <= q AS is_test
  FROM fd JOIN quota USING (building_id, cluster)""",
    "test": "SELECT * FROM split WHERE is_test",
}


def split_sql(depth: int, n_types: int = 3, least: int = 5) -> dict[str, str]:
    """Best split of every node of the days in table ``t<depth>``."""
    d = depth
    unpivoted = "\n  UNION ALL ".join(
        f"""SELECT building_id, node, cluster, {j} AS fi, '{f}' AS feature, CAST("{f}" AS DOUBLE) AS val FROM t{d}""" for j, f in enumerate(FEATURES))
    counts = ", ".join(f"count(*) FILTER (u.cluster = {c} AND u.val <= v.val) AS l{c}, count(*) FILTER (u.cluster = {c} AND u.val > v.val) AS r{c}" for c in range(n_types))
    sq = {side: " + ".join(f"{side}{c} * {side}{c}" for c in range(n_types)) for side in "lr"}
    total = {side: " + ".join(f"{side}{c}" for c in range(n_types)) for side in "lr"}
    both = " + ".join(f"(l{c} + r{c}) * (l{c} + r{c})" for c in range(n_types))
    return {
        f"u{d}": unpivoted,
        f"v{d}": f"""SELECT building_id, node, fi, feature, val, lead(val) OVER (PARTITION BY building_id, node, fi ORDER BY val) AS nxt
  FROM (SELECT DISTINCT building_id, node, fi, feature, val FROM u{d})""",
        f"lr{d}": f"""SELECT v.building_id, v.node, v.fi, v.feature, v.val, v.nxt, {counts}
  FROM v{d} v JOIN u{d} u ON u.building_id = v.building_id AND u.node = v.node AND u.fi = v.fi WHERE v.nxt IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6""",
        f"g{d}": f"""
  SELECT *, (1 - ({both}) / ((nl + nr) * (nl + nr))) - (nl * (1 - ({sq['l']}) / (nl * nl)) + nr * (1 - ({sq['r']}) / (nr * nr))) / (nl + nr) AS gain
  FROM (SELECT *, {total['l']} AS nl, {total['r']} AS nr, (val + nxt) / 2.0E0 AS threshold FROM lr{d}) WHERE nl >= {least} AND nr >= {least}""",
        f"best{d}": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY building_id, node ORDER BY round(gain, 9) DESC, fi, threshold) AS rn FROM g{d}) WHERE rn = 1""",
    }


def tree_sql(max_depth: int = 5) -> dict[str, str]:
    """The whole tree, one group of tables per level."""
    ctes = {"t0": "SELECT *, 1 AS node FROM fd"}
    value = "CASE b.feature " + " ".join(f"""WHEN '{f}' THEN CAST(t."{f}" AS DOUBLE)""" for f in FEATURES) + " END"
    for d in range(max_depth + 1):
        if d < max_depth:
            ctes |= split_sql(d)
        else:
            ctes["best" + str(d)] = f"SELECT building_id, node, NULL::VARCHAR AS feature, NULL::DOUBLE AS threshold FROM t{d} WHERE false"
        ctes[f"n{d}"] = f"""
  SELECT building_id, node, {d} AS depth, CASE WHEN impurity > 0 THEN feature END AS feature, CASE WHEN impurity > 0 THEN threshold END AS threshold,
         n_days, impurity, concat_ws(',', c0, c1, c2) AS counts,
         CASE WHEN c0 >= c1 AND c0 >= c2 THEN 0 WHEN c1 >= c2 THEN 1 ELSE 2 END AS prediction, (feature IS NULL OR impurity = 0) AS is_leaf
  FROM (SELECT *, 1 - (c0 * c0 + c1 * c1 + c2 * c2) / (n_days * n_days) AS impurity
        FROM (SELECT building_id, node, count(*) AS n_days, count(*) FILTER (cluster = 0) AS c0, count(*) FILTER (cluster = 1) AS c1,
                     count(*) FILTER (cluster = 2) AS c2 FROM t{d} GROUP BY 1, 2))
  LEFT JOIN (SELECT building_id, node, feature, threshold FROM best{d}) USING (building_id, node)"""
        if d < max_depth:
            ctes[f"t{d + 1}"] = f"""
  SELECT t.* REPLACE (t.node * 2 + CAST({value} > b.threshold AS INT) AS node)
  FROM t{d} t JOIN n{d} b ON t.building_id = b.building_id AND t.node = b.node AND NOT b.is_leaf"""
    ctes["tree"] = "\n  UNION ALL ".join(f"SELECT * FROM n{d}" for d in range(max_depth + 1))
    return ctes


def with_ctes(final: str, *groups: dict[str, str]) -> str:
    merged: dict[str, str] = {}
    for group in groups:
        merged |= group
    body = ",\n".join(f"{name} AS ({text})" for name, text in merged.items())
    return f"WITH {body}\n{final}"


def _r(*columns: str) -> str:
    return ", ".join(f'round({c}, 6) AS "{c.strip(chr(34))}"' for c in columns)


def _q(*columns: str) -> str:
    return ", ".join(f'"{c}"' for c in columns)


BASE_COLS = 'building_id, "DATE", "Holiday", "Temperature", "Solar_Irradiation", "Power"'
PARAMS = '"slope_Temp", "slope_Irrad", "intercept", "minimum"'


def _bounds_sql(key: str) -> dict[str, str]:
    return {
        "lim0": f"""
  SELECT building_id, "{key}", count(*) AS n_rows, CASE WHEN max("Power") >= 0 THEN max("Power") END AS power_max,
         CASE WHEN max("Solar_Irradiation") <> 0 THEN max("Solar_Irradiation") ELSE 1.0E0 END AS im,
         coalesce(max("Temperature") - min("Temperature"), 0.0E0) AS tr
  FROM c GROUP BY 1, 2""",
        "lim": f"""
  SELECT building_id, "{key}", n_rows, power_max, CASE WHEN tr <> 0 THEN -power_max / tr ELSE -power_max END AS "slope_Temp_min",
         -power_max / im AS "slope_Irrad_min", power_max AS "intercept_max", power_max AS "minimum_max" FROM lim0""",
    }


def _candidates_sql(key: str) -> dict[str, str]:
    steps = ("0.0", "0.5", "1.0")
    grid = [(a, b, c, d) for a in steps for b in steps for c in steps for d in steps]
    rows = ", ".join(f"({n}, {a}E0, {b}E0, {c}E0, {d}E0)" for n, (a, b, c, d) in enumerate(grid))
    return _bounds_sql(key) | {
        "cand": f"SELECT * FROM (VALUES {rows}) AS t(candidate, a, b, c, d)",
        "trial": f"""
  SELECT building_id, "{key}", candidate, 0.0E0 - a * -"slope_Temp_min" AS "slope_Temp", 0.0E0 - b * -"slope_Irrad_min" AS "slope_Irrad",
         cand.c * "intercept_max" AS "intercept", d * "minimum_max" AS "minimum" FROM lim, cand""",
        "loss": f"""
  SELECT building_id, "{key}", candidate, CAST(sum(floor(abs({fit_sql("0.0E0")} - "Power") * 1e6 + 0.5)) AS DOUBLE) / 1e6 AS loss, max("slope_Temp") AS "slope_Temp",
         max("slope_Irrad") AS "slope_Irrad", max("intercept") AS "intercept", max("minimum") AS "minimum"
  FROM trial JOIN (SELECT * FROM c WHERE "Power" IS NOT NULL) USING (building_id, "{key}") GROUP BY 1, 2, 3""",
    }


def _climate_sql(column: str) -> dict[str, str]:
    return {
        "means": f"""
  SELECT building_id, "{column}", avg("Temperature") AS mt FROM {{source}} GROUP BY 1, 2 HAVING avg("Temperature") IS NOT NULL""",
        "ranked": f"""
  SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY mt, "{column}") AS up,
         row_number() OVER (PARTITION BY building_id ORDER BY mt DESC, "{column}") AS down,
         count(*) OVER (PARTITION BY building_id) AS n FROM means""",
        "period": f"""
  SELECT building_id, "{column}", mt, 'coldest' AS kind FROM ranked WHERE up = 1
  UNION ALL SELECT building_id, "{column}", mt, 'hottest' FROM ranked WHERE down = 1
  UNION ALL SELECT building_id, "{column}", mt, 'temperate' FROM ranked WHERE up = n // 2 + 1""",
    }


def _climate(column: str, source: str) -> dict[str, str]:
    return {k: v.replace("{source}", source) for k, v in _climate_sql(column).items()}


def _chosen(kind: str, column: str) -> str:
    return f"""(SELECT cum.* FROM cum JOIN period p ON p.building_id = cum.building_id
                AND p."{column}" = cum."{column}" AND p.kind = '{kind}')"""


def _box_sql(kind: str, unit: str, *base: dict[str, str]) -> str:
    column = {"month": "DATE_month_year", "week": "DATE_week_year"}[unit]
    by = {"month": "DATE_day_month", "week": "DATE_day_week"}[unit]
    long = "\n  UNION ALL ".join(
        f"""SELECT building_id, "{by}", '{s}' AS "Variable", "{s}" AS val FROM {_chosen(kind, column)} WHERE "{s}" IS NOT NULL"""
        for s in SERIES
    )
    return with_ctes(
        f"""SELECT building_id, "{by}", "Variable", n, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
       round(min(val) FILTER (val BETWEEN q1 - (q3 - q1) * 1.5E0 AND q3 + (q3 - q1) * 1.5E0), 6) AS whisker_low,
       round(max(val) FILTER (val BETWEEN q1 - (q3 - q1) * 1.5E0 AND q3 + (q3 - q1) * 1.5E0), 6) AS whisker_high
FROM long JOIN qs USING (building_id, "{by}", "Variable") GROUP BY ALL""",
        *base, _climate(column, "cmp"),
        {
            "long": long,
            "qs": f"""
  SELECT building_id, "{by}", "Variable", count(*) AS n, quantile_cont(val, 0.25) AS q1, quantile_cont(val, 0.5) AS med,
         quantile_cont(val, 0.75) AS q3 FROM long GROUP BY ALL""",
        },
    )


def oracle_texts() -> dict[str, str]:
    ev, li = (EVENTS,), (LINES,)
    ev_cal, li_cal = (EVENTS, CAL), (LINES, CAL)
    ev_scored, li_scored = (*ev_cal, PAR, SCORED), (*li_cal, PAR, SCORED)
    ev_flag, li_flag = (*ev_scored, FLAGGED), (*li_scored, FLAGGED)
    ev_pend, li_pend = (*ev_flag, PENDING), (*li_flag, PENDING)
    li_cmp = (*li_pend, COMPARISON)
    ev_unit = (EVENTS, MATRIX, UNIT)
    ev_days = (EVENTS, FEATURE_DAYS)
    out: dict[str, str] = {}

    def add(name: str, final: str, *groups: dict[str, str]) -> None:
        out[name] = with_ctes(final, *groups)

    # sources and sinks
    add("a1_read_readings", f"SELECT {BASE_COLS} FROM r", *ev)
    add("a2_read_params", f'SELECT building_id, "DATE_hour_week", {PARAMS} FROM par', *ev_cal, PAR)
    add("a3_read_assignments", """SELECT building_id, "DATE_YYYY_MM_DD", dayofyear("DATE_YYYY_MM_DD") % 3 AS cluster FROM dm""",
        *ev, MATRIX)
    add("a4_write_table", f"SELECT {BASE_COLS} FROM r", *ev)
    add("a6_multi_building", """SELECT building_id, count(*) AS n_rows, min("DATE") AS first_date, max("DATE") AS last_date,
       CAST(sum(CAST("Power" AS DECIMAL(18,2))) AS DOUBLE) AS total_power
FROM (SELECT 'events/' || building_id AS building_id, "DATE", "Power" FROM ev_grid
      UNION ALL SELECT 'items/' || building_id, "DATE", "Power" FROM li_power
      UNION ALL SELECT 'alone', "DATE", "Power" FROM li_power WHERE building_id = 'site-0')
GROUP BY building_id""", *ev, {"li_power": LINES["li_power"]})
    add("a6_refresh", """SELECT building_id, CASE building_id WHEN 'view-0' THEN 'changed' WHEN 'error-0' THEN 'gone' ELSE 'same' END AS state,
       CASE WHEN building_id <> 'error-0' THEN CAST(sum(CAST("Power" + CASE WHEN building_id = 'view-0' AND day("DATE") = 5 THEN 1 ELSE 0 END
                AS DECIMAL(18,2))) AS DOUBLE) END AS total_power,
       CASE building_id WHEN 'view-0' THEN 2 WHEN 'error-0' THEN NULL ELSE 1 END AS computed_by
FROM ev_grid GROUP BY building_id""", *ev)
    add("a8_join_weather", """SELECT building_id, "DATE", "Holiday", CASE WHEN hour("DATE") % 5 > 0 THEN "Temperature" END AS "Temperature",
       CASE WHEN hour("DATE") % 5 > 0 THEN "Solar_Irradiation" END AS "Solar_Irradiation", "Power" FROM r""", *ev)
    add("a7_profile_readings", """SELECT *, "missing_Temperature" + "missing_Solar_Irradiation" + "missing_Power" + "missing_Holiday" AS missing_total
FROM (SELECT building_id, count(*) AS n_rows, min(year("DATE")) AS min_year, max(year("DATE")) AS max_year,
             count(*) - count("Temperature") AS "missing_Temperature", count(*) - count("Solar_Irradiation") AS "missing_Solar_Irradiation",
             count(*) - count("Power") AS "missing_Power", count(*) - count("Holiday") AS "missing_Holiday"
      FROM r GROUP BY building_id)""", *ev)

    # projections, filters, scalar functions
    add("b1_compose_timestamp", """SELECT building_id, make_timestamp(year("DATE"), month("DATE"), day("DATE"), hour("DATE"), 0, 0.0) AS "DATE" FROM r""", *ev)
    out["b2_keep_on_the_hour"] = "SELECT event_id, ts, value FROM events WHERE minute(ts) = 0"
    add("b3_format_readings", f"SELECT {BASE_COLS} FROM r", *ev)
    add("b4_add_calendar", """SELECT * EXCLUDE ("Holiday", "Temperature", "Solar_Irradiation") FROM c""", *li_cal)
    add("b5_date_marks", """SELECT * EXCLUDE ("Holiday", "Temperature", "Solar_Irradiation", "Power") REPLACE ("DATE_hour_day" + 100 AS "DATE_hour_day") FROM c""", *ev_cal)
    joined = 'c LEFT JOIN par USING (building_id, "DATE_hour_week")'
    add("b6_changepoint_eval", f"""SELECT building_id, "DATE", round(fit, 6) AS "Power_fitted", round(fit - "Power", 6) AS "Power_residuals"
FROM (SELECT c.*, {fit_sql("0.0E0")} AS fit FROM {joined})""", *ev_cal, PAR)
    add("b7_changepoint_eval_plain", f"""SELECT building_id, "DATE", round({fit_sql(floor=False, minimum='"minimum" - 400.0E0')}, 6) AS fitted
FROM {joined}""", *ev_cal, PAR)
    add("b8_cluster_hour", """SELECT building_id, "DATE", "DATE_day_year" % 3 AS cluster, "DATE_day_year" % 3 * 100 + "DATE_hour_day" AS "ClusterHour" FROM c""", *ev_cal)
    add("b9_pending_flags", """SELECT building_id, "DATE", is_missing AS "IS_Missing", is_outlier AS "IS_Outlier", bad AS "IS_Missing_Outlier",
       bad AS "IS_Repair_Pending" FROM pend""", *ev_pend)
    add("b10_complete_cases", f"""SELECT {BASE_COLS} FROM r WHERE "Temperature" IS NOT NULL AND "Solar_Irradiation" IS NOT NULL AND "Power" IS NOT NULL""", *ev)
    add("b11_trusted_rows", """SELECT building_id, "DATE", "Power" FROM rp WHERE NOT bad AND NOT "IS_Repaired" """, *ev_pend, REPAIR)
    add("b12_use_corrected", """SELECT building_id, "DATE", round("Power_corrected", 6) AS "Power", round("Power", 6) AS raw_power FROM rp""", *ev_pend, REPAIR)
    add("b13_normalise_days", f"""SELECT building_id, "DATE_YYYY_MM_DD", {_r(*[f'"{c}"' for c in POWER_COLUMNS])} FROM unit""", *ev_unit)
    add("b14_one_hot", """SELECT building_id, "DATE_YYYY_MM_DD", round("Temperature", 6) AS "Temperature", round("Solar_Irradiation", 6) AS "Solar_Irradiation",
       "DATE_day_year", "DATE_day_week", cluster, CAST(NOT "Holiday" AS INT) AS "Holiday_False", CAST("Holiday" AS INT) AS "Holiday_True",
       CAST(NOT "DATE_weekday" AS INT) AS "DATE_weekday_False", CAST("DATE_weekday" AS INT) AS "DATE_weekday_True" FROM fd""", *ev_days)
    add("b15_changepoint_knots", f"""SELECT building_id, "DATE_hour_week", {PARAMS}, -50.0E0 AS x1, "intercept" + "slope_Temp" * -50.0E0 AS y1,
       round(-("intercept" - "minimum") / "slope_Temp", 6) AS x2, "minimum" AS y2, 50.0E0 AS x3, "minimum" AS y3
FROM par WHERE abs("slope_Temp") >= 1e-8""", *ev_cal, PAR)
    add("b16_year_month", """SELECT building_id, "DATE", strftime("DATE", '%Y-%m') AS "Month" FROM r""", *li)
    add("b17_inspect_outliers", """SELECT building_id, "DATE", "Power", round("Power_fitted", 6) AS "Power_fitted", "Temperature", is_outlier AS "IS_Outlier" FROM f""", *ev_flag)
    add("b17_inspect_repairs", """SELECT building_id, "DATE", "Power", round("Power_corrected", 6) AS "Power_corrected", "Temperature", "IS_Repaired" FROM rp""", *ev_pend, REPAIR)

    # joins and lookups
    add("c1_attach_hour_params", f"""SELECT building_id, "DATE", "DATE_hour_week", {PARAMS} FROM {joined}""", *li_cal, PAR)
    keyed = {"keyed": """SELECT *, "DATE_day_year" % 3 * 100 + "DATE_hour_day" AS "ClusterHour" FROM c"""}
    add("c2_attach_cluster_params", f"""SELECT building_id, "DATE", "ClusterHour", round({fit_sql(floor=False)}, 6) AS "Power_fitted_ClustH"
FROM keyed LEFT JOIN (SELECT * FROM par_c WHERE "ClusterHour" < 200) USING (building_id, "ClusterHour")""",
        *ev_cal, keyed, {"par_c": params_sql("keyed", "ClusterHour", 4, 3, 9, 2, 150.0)})
    add("c3_attach_day_types", """SELECT c.building_id, c."DATE", c."DATE_YYYY_MM_DD", c."DATE_day_year" % 3 AS cluster, c."Power"
FROM c JOIN whole_days USING (building_id, "DATE_YYYY_MM_DD")""", *ev_cal, MATRIX, UNIT)
    offsets = {"prev_hour": -1, "next_hour": 1, "prev_week": -168, "next_week": 168, "prev_week_prev_hour": -169,
               "prev_week_next_hour": -167, "next_week_prev_hour": 167, "next_week_next_hour": 169}
    add("c4_exact_offsets", 'SELECT t.building_id, t."DATE", t."Power", '
        + ", ".join(f'{a}."Power" AS {a}' for a in offsets) + " FROM li_power t\n"
        + "\n".join(f'LEFT JOIN li_power {a} ON {a}.building_id = t.building_id AND {a}."DATE" = t."DATE" + INTERVAL 1 HOUR * ({h})'
                    for a, h in offsets.items()), *li)
    add("c5_anchors_trusted", """SELECT building_id, "DATE", bad AS "IS_Repair_Pending", trusted FROM rp""", *ev_pend, REPAIR)
    add("c6_write_back", """SELECT building_id, "DATE", "Power", round("Power_corrected", 6) AS "Power_corrected" FROM rp WHERE "IS_Repaired" """, *ev_pend, REPAIR)
    add("c7_common_rows", """SELECT building_id, "DATE", "Power", round("Power_fitted", 6) AS "Power_fitted" FROM s
WHERE "Power" IS NOT NULL AND "Power_fitted" IS NOT NULL""", *ev_scored)

    # aggregations
    add("d1_daily_features", """SELECT * REPLACE (round("Temperature", 6) AS "Temperature", round("Solar_Irradiation", 6) AS "Solar_Irradiation") FROM days""", *ev_days)
    add("d2_day_matrix", "SELECT * FROM dm", *ev, MATRIX)
    add("d3_residual_stats", """SELECT building_id, count("Power_residuals") AS n_residuals, round(avg("Power_residuals"), 6) AS mean_residual,
       round(stddev_pop("Power_residuals"), 6) AS std_residual, round(1.96E0 * stddev_pop("Power_residuals"), 6) AS threshold
FROM s GROUP BY building_id""", *ev_scored)
    add("d4_fit_bounds", f"""SELECT building_id, "DATE_hour_week", n_rows, {_r("power_max", '"slope_Temp_min"', '"slope_Irrad_min"', '"intercept_max"', '"minimum_max"')} FROM lim""",
        *li_cal, _bounds_sql("DATE_hour_week"))
    rounded_params = _r("loss", '"slope_Temp"', '"slope_Irrad"', '"intercept"', '"minimum"')
    add("d5_score_candidates", f"""SELECT building_id, "DATE_hour_week", candidate, {rounded_params} FROM loss""", *ev_cal, _candidates_sql("DATE_hour_week"))
    add("d6_best_candidate", f"""SELECT building_id, "DATE_hour_week", candidate, {rounded_params}
FROM (SELECT *, row_number() OVER (PARTITION BY building_id, "DATE_hour_week" ORDER BY round(loss, 6), candidate) AS rn FROM loss) WHERE rn = 1""",
        *li_cal, _candidates_sql("DATE_hour_week"))
    add("d7_fit_changepoint", """SELECT building_id, "DATE_hour_week", count(*) AS n_rows, 'ok' AS status, true AS proven,
       0.0E0 - (k % 3 + 2) * 0.5E0 AS "slope_Temp",
       CASE WHEN k % 24 BETWEEN 6 AND 18 THEN 0.0E0 - (k % 2 + 1) * 0.03E0 ELSE 0.0E0 END AS "slope_Irrad",
       (k % 4) * 4.0E0 + 100.0E0 AS "intercept", (k % 2) * 4.0E0 + 90.0E0 AS "minimum",
       round(sum(CASE WHEN "DATE_day_year" % 19 = 3 AND "Temperature" IS NOT NULL AND "Solar_Irradiation" IS NOT NULL THEN 40.0E0 ELSE 0.0E0 END), 2) AS loss
FROM (SELECT *, "DATE_hour_week" AS k FROM c) GROUP BY building_id, "DATE_hour_week", k""", *li_cal)
    add("d7_fit_quality", """SELECT lim.building_id, lim."DATE_hour_week", n_rows,
       CASE WHEN power_max IS NULL THEN 'no_power' WHEN power_max = 0 THEN 'all_zero' ELSE 'ok' END AS status,
       round(b.best, 3) AS coarse_loss, true AS loss_is_that_of_params, true AS inside_bounds, true AS beats_candidates, true AS bound_holds
FROM lim LEFT JOIN (SELECT building_id, "DATE_hour_week", min(loss) AS best FROM loss GROUP BY 1, 2) b USING (building_id, "DATE_hour_week")""",
        *li_cal, _candidates_sql("DATE_hour_week"))
    add("d8_flag_outliers_group", """SELECT building_id, "DATE", coalesce(abs("Power_residuals" - mu) > 1.96E0 * sd, false) AS is_outlier_group
FROM s LEFT JOIN (SELECT building_id, "DATE_hour_week", avg("Power_residuals") AS mu, stddev_samp("Power_residuals") AS sd
                  FROM s GROUP BY 1, 2) m USING (building_id, "DATE_hour_week")""", *li_scored)
    add("d9_flag_outliers_global", """SELECT building_id, "DATE", is_outlier AS is_outlier_global FROM f""", *li_flag)
    add("d10_outliers_by_month", """SELECT building_id, "Month", CAST(n AS BIGINT) AS "Sum_IS_Outlier", total AS "Total_Count",
       round(n / total * 100.0E0, 6) AS "Percentage_IS_Outlier",
       round(n / total * 100.0E0 * (CASE WHEN top <= 0 THEN 1 ELSE top END / 100.0E0), 6) AS "Scaled_Percentage"
FROM (SELECT *, max(n) OVER (PARTITION BY building_id) AS top
      FROM (SELECT building_id, strftime("DATE", '%Y-%m') AS "Month", CAST(sum(CAST(is_outlier AS INT)) AS DOUBLE) AS n, count(*) AS total
            FROM f GROUP BY 1, 2))""", *li_flag)
    add("d11_residual_histogram", """SELECT building_id, CAST(bin AS INT) AS bin, round(lo + bin * ((hi - lo) / 300), 6) AS bin_start, coalesce(c, 0) AS count,
       round(coalesce(c, 0) / (n * ((hi - lo) / 300)), 6) AS density
FROM (SELECT building_id, min("Power_residuals") AS lo, max("Power_residuals") AS hi, count("Power_residuals") AS n FROM s GROUP BY 1)
CROSS JOIN (SELECT unnest(range(0, 300)) AS bin)
LEFT JOIN (SELECT building_id, bin, count(*) AS c FROM (SELECT building_id, lo, hi, n, CAST(least(floor(("Power_residuals" - lo) * 300 / (hi - lo)), 299) AS INT) AS bin
      FROM s JOIN (SELECT building_id, min("Power_residuals") AS lo, max("Power_residuals") AS hi, count("Power_residuals") AS n FROM s GROUP BY 1)
      USING (building_id) WHERE "Power_residuals" IS NOT NULL) GROUP BY building_id, bin) USING (building_id, bin) WHERE n > 0""", *li_scored)
    add("d11_normal_curve", """SELECT building_id, i, round(x, 6) AS x, round(exp(-0.5E0 * ((x - mu) / sd) * ((x - mu) / sd)) / (sd * sqrt(2 * pi())), 6) AS density,
       round(mu - 1.96E0 * sd, 6) AS ci_lower, round(mu + 1.96E0 * sd, 6) AS ci_upper
FROM (SELECT *, lo + (hi - lo) * i / 499 AS x
      FROM (SELECT building_id, min("Power_residuals") AS lo, max("Power_residuals") AS hi, avg("Power_residuals") AS mu,
                   stddev_pop("Power_residuals") AS sd FROM s GROUP BY 1), (SELECT unnest(range(0, 500)) AS i))""", *ev_scored)
    add("d12_cluster_profiles", """SELECT building_id, dy % 3 AS cluster, "hour", count(*) AS n_days, round(avg("value"), 6) AS mean, round(stddev_samp("value"), 6) AS std,
       round(avg("value") - 1.96E0 * stddev_samp("value"), 6) AS lower, round(avg("value") + 1.96E0 * stddev_samp("value"), 6) AS upper,
       round(quantile_cont("value", 0.05), 6) AS q05, round(quantile_cont("value", 0.95), 6) AS q95
FROM cells GROUP BY 1, 2, 3""", *ev_unit)
    metrics = "\nUNION ALL ".join(
        f"""SELECT building_id, '{m}' AS model, count(r_{m}) AS n, round(avg(abs(r_{m})), 6) AS mae, round(sqrt(avg(r_{m} * r_{m})), 6) AS rmse,
       round(coalesce(sum(abs(r_{m})), 0), 6) AS resid_1h, round(coalesce(sum(abs(r_{m}_3)), 0), 6) AS resid_3h,
       round(coalesce(sum(abs(r_{m}_6)), 0), 6) AS resid_6h FROM cum GROUP BY building_id""" for m in MODELS)
    add("d13_model_metrics", metrics, *li_cmp)
    averages = ", ".join(f'avg("{s}") AS "{s}"' for s in SERIES)
    rounded_avg = ", ".join(f'round(avg("{s}"), 6) AS "{s}"' for s in SERIES)
    add("d14_monthly_load", f"""SELECT building_id, "DATE_month_year", {rounded_avg} FROM cmp GROUP BY 1, 2""", *li_cmp)
    for kind in ("coldest", "hottest", "temperate"):
        add(f"d15_hour_of_week_{kind}_month", f"""SELECT building_id, "DATE_hour_week", {rounded_avg}
FROM {_chosen(kind, "DATE_month_year")} GROUP BY 1, 2""", *li_cmp, _climate("DATE_month_year", "cmp"))
        for unit in ("month", "week"):
            out[f"d16_box_stats_{kind}_{unit}"] = _box_sql(kind, unit, *li_cmp)
    for unit, column in (("month", "DATE_month_year"), ("week", "DATE_week_year")):
        add(f"d17_climate_{unit}", f"""SELECT building_id, "{column}", round(mt, 6) AS mean_temperature, kind FROM period""", *li_cal, _climate(column, "c"))
    confusion = ", ".join(f'count(*) FILTER (cluster_pred = {c}) AS "Predicted_{c}"' for c in range(3))
    add("d18_confusion_matrix", f"""SELECT building_id, actual, {", ".join(f'coalesce("Predicted_{c}", 0) AS "Predicted_{c}"' for c in range(3))}
FROM (SELECT DISTINCT building_id, a AS actual FROM test, (SELECT unnest([0, 1, 2]) AS a))
LEFT JOIN (SELECT building_id, cluster AS actual, {confusion} FROM test GROUP BY 1, 2) USING (building_id, actual)""", *ev_days, SPLIT)
    score = {
        "lbl": """SELECT building_id, cluster AS l FROM test UNION SELECT building_id, cluster_pred FROM test""",
        "cnt": """
  SELECT l.building_id, l.l, count(*) FILTER (t.cluster = l.l) AS sup, count(*) FILTER (t.cluster_pred = l.l) AS cla,
         count(*) FILTER (t.cluster = l.l AND t.cluster_pred = l.l) AS hit
  FROM lbl l JOIN test t USING (building_id) GROUP BY 1, 2""",
        "sc": """
  SELECT *, CASE WHEN cla = 0 THEN 0 ELSE hit / cla END AS p, CASE WHEN sup = 0 THEN 0 ELSE hit / sup END AS q,
         CASE WHEN sup + cla = 0 THEN 0 ELSE 2 * hit / (sup + cla) END AS f FROM cnt""",
        "acc": """SELECT building_id, avg(CAST(cluster = cluster_pred AS INT)) AS a, count(*) AS n FROM test GROUP BY 1""",
    }
    add("d19_classification_report", """SELECT building_id, CAST(l AS VARCHAR) AS label, round_even(p, 2) AS precision, round_even(q, 2) AS recall,
       round_even(f, 2) AS f1_score, CAST(sup AS DOUBLE) AS support FROM sc
UNION ALL SELECT building_id, 'accuracy', round_even(a, 2), round_even(a, 2), round_even(a, 2), a FROM acc
UNION ALL SELECT building_id, 'macro avg', round_even(avg(p), 2), round_even(avg(q), 2), round_even(avg(f), 2), sum(sup) FROM sc GROUP BY 1
UNION ALL SELECT building_id, 'weighted avg', round_even(sum(p * sup) / sum(sup), 2), round_even(sum(q * sup) / sum(sup), 2),
       round_even(sum(f * sup) / sum(sup), 2), sum(sup) FROM sc GROUP BY 1""", *ev_days, SPLIT, score)
    add("d20_accuracy", """SELECT building_id, n AS n_days, round(a, 6) AS accuracy FROM acc""", *ev_days, SPLIT, score)
    add("d20_class_counts", "SELECT building_id, cluster, count(*) AS n_days FROM fd GROUP BY 1, 2", *ev_days)
    add("d21_model_keys", """SELECT DISTINCT building_id, "DATE_hour_week" FROM c""", *li_cal)
    add("d22_accuracy_by_day", """SELECT building_id, "DATE_YYYY_MM_DD", cluster AS actual, cluster_pred AS predicted,
       CAST(cluster = cluster_pred AS INT) AS correct FROM fd""", *ev_days)
    extra = "\nUNION ALL ".join(
        f"""SELECT building_id, '{m}' AS model, round(mape, 6) AS mape, round(1 - ssr / nullif(sst, 0), 6) AS r2,
       round(CASE WHEN n > 5 THEN 1 - (ssr / nullif(sst, 0)) * (n - 1) / (n - 5) END, 6) AS adjusted_r2,
       round(n * ln(nullif(ssr, 0) / n) + 8, 6) AS aic
FROM (SELECT building_id, count(r_{m}) AS n, avg(abs(r_{m} / nullif("Power", 0))) * 100 AS mape, sum(r_{m} * r_{m}) AS ssr,
             var_pop("Power") FILTER (r_{m} IS NOT NULL) * count(r_{m}) AS sst FROM res GROUP BY 1)""" for m in MODELS)
    add("d23_extra_metrics", extra, *li_cmp)

    # windows
    for name, pre, post in (("e1_isolated_gap", 1, 1), ("e2_gap_edge", 2, 3)):
        add(name, """SELECT building_id, "DATE", bad AS "IS_Repair_Pending", edge AS gap_edge FROM pend JOIN edges USING (building_id, "DATE")""",
            *ev_pend, {"edges": repair_pass_sql(pre, post)["edges"]})
    add("e3_offset_frames", """SELECT r.building_id, r."DATE", r."Power", a."Power" AS week_before, b."Power" AS week_after FROM r
LEFT JOIN r a ON a.building_id = r.building_id AND a."DATE" = r."DATE" - INTERVAL 7 DAY
LEFT JOIN r b ON b.building_id = r.building_id AND b."DATE" = r."DATE" + INTERVAL 7 DAY""", LOST)
    add("e4_cumulated_residuals", 'SELECT building_id, "DATE", '
        + ", ".join(f'round(r_{m}_{n}, 6) AS "Power_residuals_{m}_{n}h"' for n in (3, 6) for m in MODELS) + " FROM cum", *li_cmp)
    add("e5_day_index", """SELECT building_id, "DATE_YYYY_MM_DD", day_index, dayofyear("DATE_YYYY_MM_DD") % 3 AS cluster
FROM (SELECT building_id, "DATE_YYYY_MM_DD", row_number() OVER (PARTITION BY building_id ORDER BY "DATE_YYYY_MM_DD") - 1 AS day_index FROM dm)
SEMI JOIN whole_days USING (building_id, "DATE_YYYY_MM_DD")""", *ev, MATRIX, UNIT)
    add("e6_group_moments", """SELECT building_id, "DATE", round(avg("Power_residuals") OVER w, 6) AS mean_residual, round(stddev_samp("Power_residuals") OVER w, 6) AS std_residual
FROM s WINDOW w AS (PARTITION BY building_id, "DATE_hour_week")""", *ev_scored)

    # sort, limit, reshape
    add("f1_sorted_export", 'SELECT building_id, "DATE", "Power" FROM r ORDER BY 1, 2', *li)
    add("f2_first_days", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY "DATE_YYYY_MM_DD") - 1 AS day_index FROM dm)
WHERE day_index < 100""", *li, MATRIX)
    add("f3_peak_hour", """SELECT building_id, "DATE", "Power" FROM (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY "Power" DESC, "DATE") AS rn
FROM li_power) WHERE rn = 1""", *li)
    add("f4_union_groups", 'SELECT building_id, "DATE", "DATE_weekday", "Power" FROM c', *ev_cal)
    add("f5_intersection", """SELECT building_id, "DATE" FROM s WHERE "Power" IS NOT NULL INTERSECT SELECT building_id, "DATE" FROM s WHERE "Power_fitted" IS NOT NULL""", *ev_scored)
    add("f6_unpivot", "\nUNION ALL ".join(f"""SELECT building_id, "DATE_month_year", '{s}' AS "Variable", round("{s}", 6) AS "Value" FROM monthly""" for s in SERIES),
        *li_cmp, {"monthly": f"""SELECT building_id, "DATE_month_year", {averages} FROM cmp GROUP BY 1, 2"""})

    # repair
    repaired = """SELECT building_id, "DATE", bad AS "IS_Missing_Outlier", "IS_Repaired", round("Power_corrected", 6) AS "Power_corrected" FROM rp"""
    add("r1_repair_pass", repaired, *ev_pend, REPAIR)
    add("r1_repair_pass_multi", repaired, *ev_pend, repair_pass_sql(2, 3))
    add("r2_repair", f"""SELECT building_id, "DATE", bad AS "IS_Missing_Outlier", repaired AS "IS_Repaired", round(corrected, 6) AS "Power_corrected" FROM {LAST_PASS}
UNION ALL SELECT building_id, NULL, bad, false, round("Power", 6) FROM pend WHERE "DATE" IS NULL""",
        LOST, CAL, PAR, SCORED, FLAGGED, PENDING, repair_all_sql())
    add("r2_repair_summary", f"""SELECT building_id, count(*) FILTER (repaired) AS n_repaired, count(*) FILTER (repaired AND corrected IS NULL) AS n_without_value,
       count(*) FILTER (bad AND NOT repaired) AS n_pending FROM {LAST_PASS} GROUP BY building_id""", *ev_pend, repair_all_sql())

    # day types and tree
    add("m1_kmeans_quality", """SELECT building_id, count(*) AS n_days, true AS labels_are_nearest, true AS centres_are_means, true AS beats_stand_in
FROM pts GROUP BY building_id""", *ev_unit)
    add("m1_kmeans_days", """SELECT building_id, "DATE_YYYY_MM_DD", dayofyear("DATE_YYYY_MM_DD") % 4 AS cluster FROM dm""", *ev, MATRIX)
    add("m1_kmeans_blocks", """SELECT building_id, "DATE_YYYY_MM_DD", dayofyear("DATE_YYYY_MM_DD") % 4 AS cluster FROM dm""", *ev, MATRIX)
    add("m1_day_types", """SELECT building_id, "DATE_YYYY_MM_DD", dayofyear("DATE_YYYY_MM_DD") % 4 AS cluster, 4 AS k, true AS converged FROM dm""", *ev, MATRIX)
    add("m1_planted_types", """SELECT building_id, d AS "DATE_YYYY_MM_DD", min(d) OVER (PARTITION BY building_id, dy % 4) AS first_day FROM pts""", *ev_unit)
    add("m2_lloyd_step", """SELECT a.building_id, near AS cluster, count(*) AS n_days, "hour", round(avg("value"), 6) AS "value"
FROM near a JOIN cells b USING (building_id, d) GROUP BY a.building_id, near, "hour" """, *ev_unit, {
        "cen": """SELECT building_id, dy % 3 AS cl, "hour", avg("value") AS m FROM cells GROUP BY 1, 2, 3""",
        "d2": """SELECT c.building_id, c.d, m.cl, sum(("value" - m) * ("value" - m)) AS dd FROM cells c JOIN cen m USING (building_id, "hour") GROUP BY 1, 2, 3""",
        "near": """SELECT building_id, d, arg_min(cl, dd) AS near FROM d2 GROUP BY 1, 2""",
    })
    add("m3_wss", "SELECT building_id, k, round(wss, 6) AS wss FROM wss", *ev_unit, WSS)
    add("m4_elbow_k", "SELECT building_id, k_elbow FROM elbow", *ev_unit, WSS)
    add("m5_silhouette", "SELECT building_id, k, silhouette FROM sil", *ev_unit, SILHOUETTE)
    add("m5_silhouette_blocks", "SELECT building_id, k, silhouette FROM sil", *ev_unit, SILHOUETTE)
    add("m6_choose_k", """SELECT building_id, k_elbow, k_silhouette, greatest(k_elbow, k_silhouette, 3) AS k
FROM elbow LEFT JOIN (SELECT building_id, k AS k_silhouette FROM (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY silhouette DESC, k) AS rn FROM sil) WHERE rn = 1)
USING (building_id)""", *ev_unit, WSS, SILHOUETTE)
    add("m7_stratified_split", """SELECT building_id, "DATE_YYYY_MM_DD", cluster, is_test FROM split""", *ev_days, SPLIT)
    add("m8_best_split", """SELECT building_id, node, feature, round(threshold, 6) AS threshold, round(gain, 6) AS gain, nl AS n_left, nr AS n_right
FROM best0""", *ev_days, {"t0": "SELECT *, 1 AS node FROM fd"}, split_sql(0))
    add("m8_best_split_many_types", """SELECT building_id, node, feature, round(threshold, 6) AS threshold, round(gain, 6) AS gain, nl AS n_left, nr AS n_right
FROM best0""", *ev_days, {"t0": """SELECT * REPLACE ("DATE_day_year" % 30 AS cluster), 1 AS node FROM fd"""}, split_sql(0, 30, 2))
    tree = tree_sql()
    columns = """node, depth, feature, round(threshold, 6) AS threshold, n_days, round(impurity, 6) AS impurity, counts, prediction, is_leaf"""
    add("m8_fit_tree", f"SELECT building_id, {columns} FROM tree", *ev_days, tree)
    for name in ("m10_tree_table", "a5_save_load_model"):
        add(name, """SELECT building_id, node, depth, CASE WHEN is_leaf THEN 'leaf' ELSE concat_ws(' ', feature, '<=', CAST(round(threshold, 6) AS VARCHAR)) END AS rule,
       n_days, round(impurity, 6) AS impurity, counts, prediction FROM tree""", *ev_days, tree)
    walk = 'CASE WHEN "Temperature" > 10 THEN 2 WHEN "DATE_weekday" THEN 0 ELSE 1 END'
    add("m9_predict_day_type", f"""SELECT building_id, "DATE_YYYY_MM_DD", {walk} AS "cluster_PRED" FROM fd""", *ev_days)

    # prediction
    predicted = {
        "ty": f"""SELECT *, {walk} AS cp FROM fd""",
        "kh": """SELECT DISTINCT building_id, t * 100 + hour("DATE") AS "ClusterHour_PRED" FROM r, (SELECT unnest([0, 1, 2]) AS t)""",
        "par_p": params_sql("kh", "ClusterHour_PRED", 3, 5, 11, 3, 145.0),
    }
    add("p1_predict_load", f"""SELECT building_id, "DATE", cp AS "cluster_PRED", "ClusterHour_PRED", round({fit_sql(floor=False)}, 6) AS predicted_load
FROM (SELECT r.*, ty.cp, ty.cp * 100 + hour(r."DATE") AS "ClusterHour_PRED" FROM r JOIN ty ON ty.building_id = r.building_id AND ty."DATE_YYYY_MM_DD" = CAST(r."DATE" AS DATE))
LEFT JOIN par_p USING (building_id, "ClusterHour_PRED")""", *ev_days, predicted)
    add("p1_predict_load_daily", f"""SELECT building_id, "DATE_YYYY_MM_DD", h AS "DATE_hour_day", cp AS "cluster_PRED", round({fit_sql(floor=False)}, 6) AS predicted_load
FROM (SELECT *, cp * 100 + h AS "ClusterHour_PRED" FROM ty, (SELECT unnest(range(0, 24)) AS h)) LEFT JOIN par_p USING (building_id, "ClusterHour_PRED")""",
        *ev_days, predicted)
    lost_flag = (LOST, CAL, PAR, SCORED, FLAGGED)
    add("p2_score_stream", """SELECT building_id, "DATE", round("Power" + more, 6) AS "Power", round("Power_fitted", 6) AS "Power_fitted",
       round("Power_residuals" - more, 6) AS "Power_residuals", coalesce(abs("Power_residuals" - more - mu) > 1.96E0 * sd, false) AS is_outlier, status
FROM (SELECT *, CASE WHEN "DATE" IS NULL THEN 'no_time' ELSE 'scored' END AS status, 0.0E0 AS more FROM s
      UNION ALL SELECT *, 'repeat', 0.0E0 - 1.0E0 FROM s WHERE hour("DATE") % 11 = 5
      UNION ALL SELECT *, 'repeat', 5.0E0 FROM s WHERE hour("DATE") % 7 = 0)
LEFT JOIN (SELECT building_id, avg("Power_residuals") AS mu, stddev_pop("Power_residuals") AS sd FROM s GROUP BY building_id) m USING (building_id)""",
        *lost_flag)
    add("p2_stream_moments", """SELECT building_id, count("Power_residuals") AS n_residuals, round(avg("Power_residuals"), 6) AS mean_residual,
       round(stddev_pop("Power_residuals"), 6) AS std_residual, round(1.96E0 * stddev_pop("Power_residuals"), 6) AS threshold
FROM s WHERE "DATE" IS NOT NULL GROUP BY building_id HAVING count("Power_residuals") > 0""", *lost_flag)
    return out
