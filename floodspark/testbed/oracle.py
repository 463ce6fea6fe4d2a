"""The registered queries in SQL over the test tables, written from the definitions.

Where a closed form exists it is used instead of the library's method: points are placed by where
they lie in the unit square of their basin, not by counting edge crossings.
"""

from __future__ import annotations

import math

# The published tables of the curve, stated a second time so that a wrong one shows. By orientation and
# 2 * i-bit + j-bit the position on the curve; by position the change of orientation.
S2_POSITION = ((0, 1, 3, 2), (0, 3, 1, 2), (2, 3, 1, 0), (2, 1, 3, 0))
S2_TURN = (1, 0, 0, 3)

LEVELS = (4, 5, 6, 7, 8)
N_CODES = 9**8


def _located(key: str) -> str:
    """Columns n, pfaf, x, y of a basin number."""
    n = f"(({key} * 101) % {N_CODES})"
    digit = [f"(({n} // {9 ** (8 - i)}) % 9)" for i in range(1, 9)]
    x = " + ".join(f"({d} % 3) * {3 ** (8 - i)}" for i, d in enumerate(digit, 1))
    y = " + ".join(f"({d} // 3) * {3 ** (8 - i)}" for i, d in enumerate(digit, 1))
    pfaf = " || ".join(f"CAST({d} + 1 AS VARCHAR)" for d in digit)
    return f"{n} AS n, {pfaf} AS pfaf, {x} AS x, {y} AS y"


def _label(rank: str) -> str:
    return f"(CASE {rank} WHEN 0 THEN 'none' WHEN 1 THEN 'warning' WHEN 2 THEN 'danger' WHEN 3 THEN 'extreme' ELSE '' END)"


def _shown(rank: str) -> str:
    return f"(CASE WHEN {rank} > 0 THEN {_label(rank)} ELSE '' END)"


_RANK = "(CASE severity WHEN 'none' THEN 0 WHEN 'warning' THEN 1 WHEN 'danger' THEN 2 WHEN 'extreme' THEN 3 ELSE -1 END)"
_LEVEL_LIST = "[" + ", ".join(map(str, LEVELS)) + "]"

CTES = {
    "basin": f"SELECT c_custkey AS k, 8000000000 + c_custkey AS hybas, {_located('c_custkey')} FROM customer",
    "polygon": f"""
        SELECT 8 AS res, hybas, pfaf AS code, x / 64.0::DOUBLE - 50 AS xmin, y / 64.0::DOUBLE - 50 AS ymin,
               (x + 1) / 64.0::DOUBLE - 50 AS xmax, (y + 1) / 64.0::DOUBLE - 50 AS ymax FROM basin
        UNION ALL
        SELECT DISTINCT res, res::BIGINT * 1000000000 + n // CAST(power(9, 8 - res) AS BIGINT), pfaf[1:res],
               (x - x % side) / 64.0::DOUBLE - 50, (y - y % side) / 64.0::DOUBLE - 50,
               (x - x % side + side) / 64.0::DOUBLE - 50, (y - y % side + side) / 64.0::DOUBLE - 50
        FROM (SELECT *, CAST(power(3, 8 - res) AS BIGINT) AS side FROM basin, (SELECT unnest([4, 5, 6, 7]) AS res))""",
    # Rows with a later one for the same basin lose to it; a bad later row would not replace a good one.
    "crosswalk": """
        SELECT hybas, CASE WHEN k % 19 = 0 THEN (k + 1) * 7 + 1 ELSE k * 7 + 1 END AS comid FROM basin
        WHERE k % 19 = 0 OR (k % 13 <> 0 AND k % 17 <> 0)""",
    "reach": f"""
        SELECT * FROM (
          SELECT o_custkey * 7 + 1 AS comid, o_orderkey * 31 % 26 AS ret_per,
                 CASE WHEN o_orderkey % 23 = 0 THEN 0.0::DOUBLE ELSE o_totalprice END AS mean,
                 CASE WHEN o_orderkey % 29 <> 0 THEN y / 64.0::DOUBLE - 50 END AS lat,
                 CASE WHEN o_orderkey % 29 <> 0 THEN x / 64.0::DOUBLE - 50 END AS lon,
                 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS latest,
                 CASE WHEN o_orderkey * 31 % 26 >= 20 THEN 'extreme' WHEN o_orderkey * 31 % 26 >= 5 THEN 'danger'
                      ELSE 'warning' END AS severity
          FROM (SELECT *, {_located('o_custkey')} FROM orders) WHERE o_orderkey * 31 % 26 >= 2)
        WHERE latest = 1""",
    "gauge": f"""
        SELECT event_id, CAST(event_id AS VARCHAR) AS gauge_id, k, x, y, fx, fy, CAST(ts AS VARCHAR) AS issued,
               (y + fy) / 64 - 50 AS lat, (x + fx) / 64 - 50 AS lon,
               CASE event_type WHEN 'click' THEN 'warning' WHEN 'signup' THEN 'danger' ELSE 'extreme' END AS severity
        FROM (SELECT *, {_located('k')},
                     CASE WHEN event_id % 50 = 0 THEN 0.0::DOUBLE ELSE (event_id * 13 % 16) / 16.0::DOUBLE + 0.03125 END AS fx,
                     (event_id * 5 % 16) / 16.0::DOUBLE + 0.03125 AS fy
              FROM (SELECT *, event_id * 7 % (SELECT count(*) FROM customer) AS k FROM events))
        WHERE event_type IN ('click', 'signup', 'purchase')""",
    "placed": """
        SELECT *, 8000000000 + k AS hybas FROM gauge
        WHERE fx > 0 AND NOT (fx > 0.5 AND fy > 0.5)
          AND NOT (k % 5 = 0 AND fx >= 0.125 AND fx <= 0.25 AND fy >= 0.125 AND fy <= 0.25)""",
    "alert": """
        SELECT hybas, 'river' AS model, severity, CAST(comid AS VARCHAR) AS river_id, '' AS issued,
               ret_per, mean, lat, lon, 0 AS list_rank, 0 AS list_seq
        FROM crosswalk JOIN reach USING (comid)
        UNION ALL
        SELECT hybas, 'gauge', severity, gauge_id, issued, NULL, NULL, lat, lon, 1, event_id FROM placed""",
    "leveled": f"""
        SELECT alert.*, res, pfaf, CASE WHEN res = 8 THEN pfaf ELSE pfaf[1:res] END AS code
        FROM alert JOIN basin USING (hybas), (SELECT unnest({_LEVEL_LIST}) AS res)""",
    "tally": f"""
        SELECT res, code, model, count(*) AS n, max({_RANK}) AS worst FROM leveled GROUP BY ALL""",
    "region": """
        SELECT res, code, max(worst) AS worst, CAST(sum(n) AS BIGINT) AS model_count,
               string_agg(model, ',' ORDER BY model) AS models, count(*) >= 2 AS agree
        FROM tally GROUP BY res, code""",
    "feature": f"""
        SELECT region.*, hybas AS basin_id, {_label('worst')} AS severity, xmin, ymin, xmax, ymax
        FROM region JOIN polygon USING (res, code)""",
    "huc12": f"""
        SELECT o_orderkey, pfaf || CAST((o_orderkey // 729) % 9 + 1 AS VARCHAR) || CAST((o_orderkey // 81) % 9 + 1 AS VARCHAR)
               || CAST((o_orderkey // 9) % 9 + 1 AS VARCHAR) || CAST(o_orderkey % 9 + 1 AS VARCHAR) AS pfaf12
        FROM (SELECT *, {_located('o_custkey')} FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))""",
    "item": """
        SELECT pfaf12, l_quantity AS population, l_linenumber AS buildings, l_quantity * 1000 AS farmland_m2,
               l_linenumber / 8.0::DOUBLE AS highway_km, l_linenumber / 16.0::DOUBLE AS railway_km
        FROM lineitem JOIN huc12 ON o_orderkey = l_orderkey""",
    "impact": f"""
        SELECT res, pfaf12[1:res] AS code, sum(population)::DOUBLE AS population, sum(buildings)::DOUBLE AS buildings,
               sum(farmland_m2)::DOUBLE AS farmland_m2, sum(highway_km)::DOUBLE AS highway_km,
               sum(railway_km)::DOUBLE AS railway_km
        FROM item, (SELECT unnest({_LEVEL_LIST}) AS res)
        WHERE (res, pfaf12[1:res]) IN (SELECT (res, code) FROM region) GROUP BY ALL""",
    "exposed": """
        SELECT feature.*, CAST(round_even(population, 0) AS BIGINT) AS population,
               CAST(round_even(buildings, 0) AS BIGINT) AS buildings,
               CAST(round_even(farmland_m2, 0) AS BIGINT) AS farmland_m2,
               round_even(highway_km, 1) AS highway_km, round_even(railway_km, 1) AS railway_km
        FROM feature LEFT JOIN impact USING (res, code)""",
    "point": """
        SELECT 'river' AS model, severity, CAST(comid AS VARCHAR) AS river_id, ret_per, lat, lon FROM reach
        UNION ALL SELECT 'gauge', severity, gauge_id, NULL, lat, lon FROM gauge""",
    "usable": "SELECT * FROM point WHERE lat IS NOT NULL AND lon IS NOT NULL",
}


def _sql(body: str, **more: str) -> str:
    """A query with the common tables it uses, and those they use."""
    tables = {**CTES, **more}
    needed, queue = [], [body]
    while queue:
        text = queue.pop()
        for name, definition in tables.items():
            if name not in needed and any(name == w for w in _words(text)):
                needed.append(name)
                queue.append(definition)
    ordered = [name for name in tables if name in needed]
    return "WITH " + ", ".join(f"{name} AS MATERIALIZED ({tables[name]})" for name in ordered) + " " + body if ordered else body


def _words(text: str):
    return "".join(c if c.isalnum() or c == "_" else " " for c in text).split()


# --- grids -------------------------------------------------------------------------------------------


def _s2_cells(depth: int = 8) -> dict[str, str]:
    """Steps from points to the position on the curve, one table per step."""
    side = 1 << depth
    frames = [("y/x", "z/x"), ("-x/y", "z/y"), ("-x/z", "-y/z"), ("z/x", "y/x"), ("z/y", "-x/y"), ("-y/z", "-x/z")]

    def pick(axis):
        return "CASE face " + " ".join(f"WHEN {f} THEN {e[axis]}" for f, e in enumerate(frames)) + " END"

    def st(u):
        return f"CASE WHEN {u} >= 0 THEN 0.5 * sqrt(1 + 3 * {u}) ELSE 1 - 0.5 * sqrt(1 - 3 * {u}) END"

    def cell(u):
        return f"greatest(0, least({side - 1}, CAST(floor(({st(u)}) * {side}) AS BIGINT)))"

    steps = {
        "xyz": "SELECT *, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM usable",
        "faced": """SELECT *, CASE WHEN abs(x) > abs(y) THEN CASE WHEN abs(x) > abs(z) THEN 0 ELSE 2 END
                    WHEN abs(y) > abs(z) THEN 1 ELSE 2 END AS axis FROM xyz""",
        "sided": "SELECT *, axis + CASE WHEN CASE axis WHEN 0 THEN x WHEN 1 THEN y ELSE z END < 0 THEN 3 ELSE 0 END AS face FROM faced",
        "uv": f"SELECT *, {pick(0)} AS u, {pick(1)} AS v FROM sided",
        "curve0": f"SELECT model, severity, face, {cell('u')} AS i, {cell('v')} AS j, CAST(0 AS BIGINT) AS pos, face % 2 AS turn FROM uv",
    }
    position = "[" + ", ".join(str(p) for row in S2_POSITION for p in row) + "]"
    turned = "[" + ", ".join(map(str, S2_TURN)) + "]"
    for k in range(depth):
        bit = depth - 1 - k
        steps[f"digit{k + 1}"] = f"SELECT *, {position}[turn * 4 + ((i >> {bit}) & 1) * 2 + ((j >> {bit}) & 1) + 1] AS digit FROM curve{k}"
        steps[f"curve{k + 1}"] = (
            f"SELECT model, severity, face, i, j, pos * 4 + digit AS pos, xor(turn, {turned}[digit + 1]) AS turn FROM digit{k + 1}"
        )
    return steps


def _s2_corner_tables() -> dict[str, str]:
    """Corners of the distinct cells; none of them touches a pole or the 180th meridian here."""
    def uv(s):
        return f"CASE WHEN {s} >= 0.5 THEN (4 * {s} * {s} - 1) / 3 ELSE (1 - 4 * (1 - {s}) * (1 - {s})) / 3 END"

    axes = [("1", "u", "v"), ("-u", "1", "v"), ("-u", "-v", "1"), ("-1", "-v", "-u"), ("v", "-1", "-u"), ("v", "u", "-1")]

    def pick(axis):
        return "CASE face " + " ".join(f"WHEN {f} THEN {e[axis]}" for f, e in enumerate(axes)) + " END"

    return {
        "cell": "SELECT DISTINCT res, face, i, j, cell_id FROM celled",
        "st": "SELECT res, face, cell_id, (i + di) / pow(2, res) AS s, (j + dj) / pow(2, res) AS t "
              "FROM cell, (SELECT unnest([0, 1]) AS di), (SELECT unnest([0, 1]) AS dj)",
        "facing": f"SELECT res, face, cell_id, {uv('s')} AS u, {uv('t')} AS v FROM st",
        "space": f"SELECT res, cell_id, ({pick(0)})::DOUBLE AS px, ({pick(1)})::DOUBLE AS py, ({pick(2)})::DOUBLE AS pz FROM facing",
        "lonlat": "SELECT res, cell_id, degrees(atan2(py, px)) AS lon, degrees(atan2(pz, sqrt(px * px + py * py))) AS lat FROM space",
    }


_ROLLUP = f"""SELECT res, cell_id, {_label('max(worst)')} AS severity, CAST(sum(n) AS BIGINT) AS model_count,
    string_agg(model, ',' ORDER BY model) AS models, count(*) >= 2 AS agree FROM cell_tally GROUP BY res, cell_id"""


def _cell_tally(source: str) -> str:
    return f"SELECT res, cell_id, model, count(*) AS n, max({_RANK}) AS worst FROM {source} GROUP BY ALL"


def _s2_tables(levels=(2, 3, 4, 5, 6, 7, 8), depth: int = 8) -> dict[str, str]:
    # A token is the 3 face bits, 2 bits per level, a marker bit, padded to 64 and cut at the zeros.
    bits = f"((face * CAST(power(4, res) AS BIGINT) + (pos >> (2 * ({depth} - res)))) * 2 + 1) << ({2 * depth} - 2 * res)"
    # 3 + 16 + 1 bits make exactly five hexadecimal digits.
    token = f"rtrim(lpad(lower(to_hex({bits})), 5, '0'), '0')"
    return {
        **_s2_cells(depth),
        "celled": f"SELECT model, severity, res, face, i >> ({depth} - res) AS i, j >> ({depth} - res) AS j, {token} AS cell_id FROM curve{depth}, (SELECT unnest({list(levels)}) AS res)",
        "cell_tally": _cell_tally("celled"),
    }


_HEX_COLUMNS = f"(round_even({180.0 / (math.sqrt(3.0) * 10.0)!r}::DOUBLE * pow({math.sqrt(7.0)!r}::DOUBLE, res), 0) * 2)"


def _hex_tables(resolutions=(3, 4, 5, 6)) -> dict[str, str]:
    return {
        "plane": f"""SELECT model, severity, lon AS px, degrees(sin(radians(lat))) AS py, res,
            {_HEX_COLUMNS} AS columns, {360.0 / math.sqrt(3.0)!r}::DOUBLE / {_HEX_COLUMNS} AS edge FROM usable, (SELECT unnest({list(resolutions)}) AS res)""",
        "axial": f"""SELECT *, (px * {math.sqrt(3.0) / 3.0!r}::DOUBLE - py / 3) / edge AS q, (py * {2.0 / 3.0!r}::DOUBLE) / edge AS r FROM plane""",
        "cubed": """SELECT *, -q - r AS s, round_even(q, 0) AS nq, round_even(r, 0) AS nr, round_even(-q - r, 0) AS ns FROM axial""",
        "apart": "SELECT *, abs(nq - q) AS dq, abs(nr - r) AS dr, abs(ns - s) AS ds FROM cubed",
        "hexed": """SELECT model, severity, res, CAST(columns AS BIGINT) AS n,
            CAST(CASE WHEN dq > dr AND dq > ds THEN -nr - ns ELSE nq END AS BIGINT) AS hq,
            CAST(CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -nq - ns ELSE nr END AS BIGINT) AS hr FROM apart""",
        # The column counted from the 180th meridian, modulo the number of columns.
        "celled": """SELECT model, severity, res, res || ':' || (((hq + (hr >> 1) + n // 2) % n + n) % n - n // 2 - (hr >> 1)) || ':' || hr AS cell_id
            FROM hexed""",
        "cell_tally": _cell_tally("celled"),
    }


def _tile_x(z: str) -> str:
    return f"CAST(floor((lon + 180) / 360 * pow(2, {z})) AS BIGINT)"


def _tile_y(z: str) -> str:
    return f"CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * pow(2, {z})) AS BIGINT)"


def _tile_tables(zooms=(3, 5, 7)) -> dict[str, str]:
    return {
        "celled": f"""SELECT model, severity, river_id, ret_per, lon, res, res || '/' || {_tile_x('res')} || '/' || {_tile_y('res')} AS cell_id
            FROM usable, (SELECT unnest({list(zooms)}) AS res)""",
        "cell_tally": _cell_tally("celled"),
    }


# --- texts -------------------------------------------------------------------------------------------


def _one_decimal(x: str) -> str:
    """Ties up on the exact binary value: 20x - (2m + 1) is computed without rounding."""
    m = f"CAST(floor({x} * 10) AS BIGINT)"
    tenths = f"({m} + CASE WHEN ({x} * 16 - (2 * {m} + 1)) + {x} * 4 >= 0 THEN 1 ELSE 0 END)"
    return f"CASE WHEN {tenths} % 10 = 0 THEN CAST({tenths} // 10 AS VARCHAR) ELSE ({tenths} // 10) || '.' || ({tenths} % 10) END"


def _compact(x: str) -> str:
    return (
        f"CASE WHEN {x} IS NULL THEN '—' WHEN {x} >= 1e9 THEN ({_one_decimal(f'(({x}) / 1e9)')}) || 'B' "
        f"WHEN {x} >= 1e6 THEN ({_one_decimal(f'(({x}) / 1e6)')}) || 'M' "
        f"WHEN {x} >= 1e3 THEN ({_one_decimal(f'(({x}) / 1e3)')}) || 'k' "
        f"WHEN {x} >= 999.5 THEN '1,000' ELSE CAST(CAST(floor({x} + 0.5) AS BIGINT) AS VARCHAR) END"
    )


def _number_text(x: str) -> str:
    return f"regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"


_LINK = f"""CASE WHEN lat IS NULL OR lon IS NULL THEN NULL
    WHEN model = 'river' THEN 'https://rivers.example/#lon=' || {_number_text('lon')} || '&lat=' || {_number_text('lat')} || '&zoom=13'
    WHEN model = 'gauge' THEN 'https://gauges.example/l/' || {_number_text('lat')} || '/' || {_number_text('lon')} || '/10/g/' || river_id END"""
_TITLE = "CASE model WHEN 'river' THEN 'River model' WHEN 'gauge' THEN 'Gauge model' END"
_DETAIL = f"""SELECT hybas AS hybas_id, river_id AS "riverId", {_TITLE} AS title, {_LINK} AS link, severity AS severity_text,
    river_id AS "riverId_text", '—' AS country_text,
    CASE WHEN ret_per IS NULL THEN '—' ELSE ret_per || '-year' END AS "returnPeriodYr_text",
    CASE WHEN mean IS NULL THEN '—' ELSE {_number_text('mean')} || ' m³/s' END AS "peakDischargeCms_text",
    CASE WHEN issued = '' THEN '—' ELSE issued END AS "issuedTime_text", '—' AS "startTime_text", '—' AS "peakTime_text",
    '—' AS "endTime_text", CAST(NULL AS VARCHAR) AS note FROM alert"""


def _feature_text() -> dict[str, str]:
    def pair(x, y):
        return f"'[' || {x} || ',' || {y} || ']'"

    def ring(offsets, unit="1"):
        points = [pair(f"((x + {dx} * {unit}) / 64.0::DOUBLE - 50)", f"((y + {dy} * {unit}) / 64.0::DOUBLE - 50)") for dx, dy in offsets]
        return "'[' || " + " || ',' || ".join(points) + " || ']'"

    shell = ring([(0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1), (0, 0)])
    hole = ring([(0.125, 0.125), (0.125, 0.25), (0.25, 0.25), (0.25, 0.125), (0.125, 0.125)])
    square = ring([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)], "side")
    texts = f"""'{{"model":"' || model || '","severity":"' || severity || '","riverId":"' || river_id
        || '","country":"","issuedTime":"' || issued || '","startTime":"","peakTime":"","endTime":"","returnPeriodYr":'
        || coalesce(CAST(ret_per AS VARCHAR), '""') || ',"peakDischargeCms":' || coalesce(CAST(mean AS VARCHAR), '""')
        || ',"historicalComparison":"","lat":' || coalesce(CAST(lat AS VARCHAR), 'null') || ',"lon":'
        || coalesce(CAST(lon AS VARCHAR), 'null') || '}}'"""
    return {
        "corner": "SELECT 8 AS res, hybas, k, x, y, 1 AS side FROM basin UNION ALL "
                  "SELECT res, hybas, NULL, CAST((xmin + 50) * 64 AS BIGINT), CAST((ymin + 50) * 64 AS BIGINT), "
                  "CAST(power(3, 8 - res) AS BIGINT) FROM polygon WHERE res < 8",
        "outline": f"SELECT res, hybas AS basin_id, '[' || CASE WHEN res < 8 THEN {square} WHEN k % 5 = 0 THEN {shell} || ',' || {hole} ELSE {shell} END || ']' AS coordinates FROM corner",
        "listed": f"SELECT res, code, string_agg({texts}, ',' ORDER BY pfaf, list_rank, list_seq) AS forecasts FROM leveled GROUP BY res, code",
    }


_OPENED = {
    "opened": f"""SELECT event_id, severity, res, res || '/' || {_tile_x('res')} || '/' || {_tile_y('res')} AS cell_id
        FROM gauge, (SELECT unnest([3, 5, 7]) AS res) WHERE event_id % 31 <> 0""",
}


def oracle_sql() -> dict[str, str]:
    s2, hexes, tiles = _s2_tables(), _hex_tables(), _tile_tables()
    kept = "crosswalk_clean"
    out = {
        kept: _sql("SELECT hybas AS basin_id, comid FROM crosswalk"),
        "crosswalk_holes": """SELECT CAST(count(*) + count_if(c_custkey % 19 = 0) AS BIGINT) AS n_rows,
            CAST(count_if(c_custkey % 13 = 0 OR c_custkey % 17 = 0) AS BIGINT) AS n_holes FROM customer""",
        "reach_flagged": _sql("SELECT comid, ret_per, mean, lat, lon, severity FROM reach WHERE comid IN (SELECT comid FROM crosswalk)"),
        "gauge_alerts": _sql("SELECT gauge_id, severity, lat, lon, '' AS country, issued, '' AS starts, '' AS ends FROM gauge"),
        "severity_ranks": f"""SELECT event_id, rank, {_label('rank')} AS built, {_shown('rank')} AS shown FROM (
            SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3
                   WHEN 'view' THEN 0 ELSE -1 END AS rank FROM events)""",
        "parsed_numbers": """SELECT l_orderkey, l_linenumber,
            CASE WHEN l_linenumber IN (1, 2) THEN l_partkey END AS strict,
            CASE WHEN l_linenumber IN (1, 2, 3) THEN l_partkey WHEN l_linenumber = 4 THEN -l_partkey END AS truncated,
            CASE WHEN l_linenumber IN (1, 2) THEN l_partkey::DOUBLE WHEN l_linenumber = 3 THEN (l_partkey || '.9')::DOUBLE
                 WHEN l_linenumber = 4 THEN -(l_partkey || '.5')::DOUBLE END AS number FROM lineitem""",
        "polygon_ingest": _sql("""SELECT 8 AS level, hybas AS hybas_id, pfaf, false AS multi,
            CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END AS n_rings, CASE WHEN k % 5 = 0 THEN 12 ELSE 7 END AS n_points,
            xmin, ymin, xmax, ymax FROM basin JOIN polygon USING (hybas) WHERE res = 8"""),
        "usable_point_counts": _sql("SELECT count(lat) AS usable, count(*) - count(lat) AS skipped FROM point"),
        "basin_river_alerts": _sql("SELECT hybas AS hybas_id, severity, CAST(1 AS BIGINT) AS model_count FROM alert WHERE model = 'river'"),
        "forecast_union": _sql("""SELECT hybas AS hybas_id, model, severity, river_id AS "riverId", '' AS country, issued AS "issuedTime",
            '' AS "startTime", '' AS "peakTime", '' AS "endTime", ret_per AS "returnPeriodYr", mean AS "peakDischargeCms",
            '' AS "historicalComparison", lat, lon FROM alert"""),
        "gauge_in_basin": _sql("SELECT event_id, hybas AS hybas_id FROM placed"),
        "gauges_outside": _sql("SELECT gauge_id, severity FROM gauge WHERE event_id NOT IN (SELECT event_id FROM placed)"),
        "basin_features": _sql("SELECT res, basin_id, severity, model_count, models, agree FROM feature WHERE res = 8"),
        "rollup_levels": _sql("SELECT res, code, model, n, worst FROM tally"),
        "level_features": _sql("SELECT res, code, basin_id, severity, model_count, models, agree, xmin, ymin, xmax, ymax FROM feature"),
        "level_forecasts": _sql('SELECT res, code, model, severity, river_id AS "riverId" FROM leveled'),
        "build_report": _sql("""
            SELECT 'crosswalk_holes' AS metric, count(*) AS value FROM basin WHERE k % 13 = 0 OR k % 17 = 0
            UNION ALL SELECT 'crosswalk_basins', count(*) FROM crosswalk
            UNION ALL SELECT 'reaches_flooding', count(*) FROM reach WHERE comid IN (SELECT comid FROM crosswalk)
            UNION ALL SELECT 'basins_river', count(*) FROM alert WHERE model = 'river'
            UNION ALL SELECT 'gauge_alerts', count(*) FROM gauge
            UNION ALL SELECT 'gauges_placed', count(*) FROM placed
            UNION ALL SELECT 'gauges_outside', (SELECT count(*) FROM gauge) - (SELECT count(*) FROM placed)
            UNION ALL SELECT 'basins_both', count(DISTINCT hybas) FROM alert
            UNION ALL SELECT 'codes_shared', count(*) FROM (
                SELECT pfaf FROM alert JOIN basin USING (hybas) GROUP BY pfaf HAVING count(DISTINCT hybas) > 1)
            UNION ALL SELECT 'features_level_' || res, count(*) FROM feature GROUP BY res
            UNION ALL SELECT 'lookup_basins', count(*) FROM huc12
            UNION ALL SELECT 'impact_rows_matched', 4 * count(*) FROM item
                WHERE pfaf12[1:4] IN (SELECT code FROM region WHERE res = 4)
            UNION ALL SELECT 'features_with_impact', count(population) FROM exposed
            UNION ALL SELECT 'features', count(*) FROM feature"""),
        "point_report": _sql("""
            SELECT 'points' AS metric, count(*) AS value FROM point
            UNION ALL SELECT 'points_usable', count(*) FROM usable
            UNION ALL SELECT 'cells_' || res, count(DISTINCT cell_id) FROM celled GROUP BY res""", **s2),
        "impact_by_region": _sql("SELECT * FROM impact"),
        "features_with_impact": _sql("""SELECT res, basin_id, severity, model_count, population, buildings, farmland_m2,
            highway_km, railway_km FROM exposed"""),
        # Each item is a row in each of the four files.
        "impact_matched_rows": _sql("""SELECT CAST(4 * count(*) AS BIGINT) AS matched_rows FROM item
            WHERE pfaf12[1:4] IN (SELECT code FROM region WHERE res = 4)"""),
        # Prices have two decimals, so the only exact ties are at .25 and .75.
        "rounded_values": """SELECT l_orderkey, l_linenumber, l_extendedprice,
            (CASE WHEN 2 * m + 1 - 20 * CAST(l_extendedprice AS DECIMAL(18, 2)) <> 0
                  THEN m + CASE WHEN 20 * CAST(l_extendedprice AS DECIMAL(18, 2)) > 2 * m + 1 THEN 1 ELSE 0 END
                  WHEN (l_extendedprice * 16 - (2 * m + 1)) + l_extendedprice * 4 = 0 THEN m + m % 2
                  ELSE m + CASE WHEN (l_extendedprice * 16 - (2 * m + 1)) + l_extendedprice * 4 > 0 THEN 1 ELSE 0 END
             END) / 10.0::DOUBLE AS tenth, CAST(round_even(l_extendedprice / 2, 0) AS BIGINT) AS whole
            FROM (SELECT *, CAST(floor(CAST(l_extendedprice AS DECIMAL(18, 2)) * 10) AS BIGINT) AS m FROM lineitem)""",
        "s2_rollup": _sql(_ROLLUP, **s2),
        "hex_rollup": _sql(_ROLLUP, **hexes),
        "tile_rollup": _sql(_ROLLUP, **tiles),
        "tile_outlines": _sql("""SELECT res, cell_id, false AS multi,
            CAST(round((tx / pow(2, res) * 360 - 180) * 1e6) AS BIGINT) AS xmin,
            CAST(round(degrees(atan(sinh(pi() * (1 - 2 * (ty + 1) / pow(2, res))))) * 1e6) AS BIGINT) AS ymin,
            CAST(round(((tx + 1) / pow(2, res) * 360 - 180) * 1e6) AS BIGINT) AS xmax,
            CAST(round(degrees(atan(sinh(pi() * (1 - 2 * ty / pow(2, res))))) * 1e6) AS BIGINT) AS ymax
            FROM (SELECT DISTINCT res, cell_id, split_part(cell_id, '/', 2)::BIGINT AS tx, split_part(cell_id, '/', 3)::BIGINT AS ty FROM celled)""", **tiles),
        "s2_outlines": _sql("""SELECT res, cell_id, false AS multi, CAST(round(min(lon) * 1e6) AS BIGINT) AS xmin,
            CAST(round(min(lat) * 1e6) AS BIGINT) AS ymin, CAST(round(max(lon) * 1e6) AS BIGINT) AS xmax,
            CAST(round(max(lat) * 1e6) AS BIGINT) AS ymax FROM lonlat GROUP BY res, cell_id""", **s2, **_s2_corner_tables()),
        "hex_outlines": _sql(f"""SELECT res, cell_id, false AS multi,
            CAST(round((cx - edge * cos(radians(30))) * 1e6) AS BIGINT) AS xmin,
            CAST(round(degrees(asin(radians(cy - edge))) * 1e6) AS BIGINT) AS ymin,
            CAST(round((cx + edge * cos(radians(30))) * 1e6) AS BIGINT) AS xmax,
            CAST(round(degrees(asin(radians(cy + edge))) * 1e6) AS BIGINT) AS ymax
            FROM (SELECT res, cell_id, edge, edge * {math.sqrt(3.0)!r} * (q + r / 2.0) AS cx, edge * 1.5 * r AS cy FROM (
              SELECT DISTINCT res, cell_id, {360.0 / math.sqrt(3.0)!r}::DOUBLE / {_HEX_COLUMNS} AS edge,
                     split_part(cell_id, ':', 2)::BIGINT AS q, split_part(cell_id, ':', 3)::BIGINT AS r FROM celled))""", **hexes),
        "ready_cell_rollup": _sql(f"""SELECT 6 AS res, CAST(cell AS VARCHAR) AS cell_id, {_label(f'max({_RANK})')} AS severity,
            count(*) AS model_count FROM tiled WHERE cell IN (SELECT cell FROM tiled WHERE model = 'river') GROUP BY cell""",
            tiled=f"SELECT *, {_tile_x('6')} * 64 + {_tile_y('6')} AS cell FROM usable"),
        "map_tiles": _sql(f"SELECT gauge_id, {_tile_x('9')} AS tile_x, {_tile_y('9')} AS tile_y FROM gauge"),
        "visible_by_model": _sql(f"""SELECT res, code, {_shown('worst')} AS severity, n AS model_count, model AS models,
            false AS agree FROM tally WHERE model = 'river'"""),
        "visible_forecasts": _sql("""SELECT hybas AS hybas_id, model, severity, river_id AS "riverId" FROM alert WHERE model = 'river'"""),
        "zoom_resolution": """SELECT event_id, event_id % 40 / 2.0::DOUBLE AS zoom,
            CASE WHEN event_id % 40 >= 16 THEN 6 WHEN event_id % 40 >= 12 THEN 5 WHEN event_id % 40 >= 8 THEN 4 ELSE 3 END AS res FROM events""",
        "features_by_resolution": _sql("""SELECT CAST(declared AS INTEGER) AS res, count(feature.res) AS n_features
            FROM (SELECT unnest([3, 4, 5, 8]) AS declared) LEFT JOIN feature ON feature.res = declared GROUP BY declared"""),
        "model_list": _sql(f"SELECT DISTINCT model, {_TITLE} AS label FROM tally WHERE res = 4"),
        "extent": _sql("SELECT res, min(xmin) AS west, min(ymin) AS south, max(xmax) AS east, max(ymax) AS north FROM feature GROUP BY res"),
        "feature_detail": _sql(_DETAIL),
        "detail_rows": _sql("""SELECT hybas_id, "riverId", field_order, caption, text FROM detail, LATERAL (
            SELECT * FROM (VALUES (0, 'Severity', severity_text), (1, 'Gauge / River ID', "riverId_text"), (2, 'Country', country_text),
              (3, 'Return period', "returnPeriodYr_text"), (4, 'Mean discharge', "peakDischargeCms_text"), (5, 'Issued', "issuedTime_text"),
              (6, 'Start', "startTime_text"), (7, 'Peak', "peakTime_text"), (8, 'End', "endTime_text")) AS v(field_order, caption, text))""",
            detail=_DETAIL),
        "impact_display": _sql(f"""SELECT res, basin_id, {_compact('buildings')} AS buildings,
            {_compact('(farmland_m2 / 1e6)')} || ' km²' AS farmland, {_compact('highway_km')} || ' km' AS roads,
            {_compact('railway_km')} || ' km' AS railways, {_compact('population')} AS population
            FROM exposed WHERE population IS NOT NULL"""),
        "compact_counts": f"""SELECT o_orderkey, {_compact('o_totalprice')} AS price, {_compact('(o_totalprice * 1000)')} AS thousandfold,
            {_compact('(o_totalprice / 1000)')} AS thousandth FROM orders""",
        "model_labels": """SELECT c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' Model-' || c_custkey || ' X' AS label FROM customer""",
        "url_components": """SELECT doc_id, md5(replace(replace(replace(replace(replace(url_encode(text), '%21', '!'), '%27', ''''),
            '%28', '('), '%29', ')'), '%2A', '*')) AS encoded_md5 FROM documents""",
        "agreement": _sql("""SELECT res, code, CASE WHEN agree THEN '2 models agree' ELSE 'Single model' END AS agreement,
            severity || ' (' || model_count || CASE WHEN model_count = 1 THEN ' forecast)' ELSE ' forecasts)' END
            || CASE WHEN agree THEN ' · ✓ 2 models' ELSE '' END AS summary FROM feature"""),
        "lookup_cell": _sql("SELECT res, CAST(basin_id AS VARCHAR) AS cell_id, severity, model_count FROM feature WHERE basin_id = 8000000001"),
        "empty_check": _sql("SELECT count(*) = 0 AS empty FROM feature"),
        "geojson_lines": _sql("""SELECT res, '{"type":"Feature","geometry":{"type":"Polygon","coordinates":' || coordinates
            || '},"properties":{"res":' || res || ',"cell_id":"' || basin_id || '","basin_id":"' || basin_id || '","severity":"'
            || severity || '","model_count":' || model_count || ',"forecasts":[' || forecasts || ']'
            || CASE WHEN population IS NULL THEN '' ELSE ',"impact":{"population":' || population || ',"buildings":' || buildings
               || ',"farmland_m2":' || farmland_m2 || ',"highway_km":' || highway_km || ',"railway_km":' || railway_km || '}' END
            || ',"part":0,"parts":1}}' AS line
            FROM exposed JOIN outline USING (res, basin_id) JOIN listed USING (res, code)""", **_feature_text()),
        "geojson_roundtrip": _sql("""SELECT res, CAST(basin_id AS VARCHAR) AS cell_id, leveled.model, count(*) AS n,
            CAST(sum(ret_per) AS BIGINT) AS years, min(lat) AS south, max(lon) AS east
            FROM leveled JOIN feature USING (res, code) GROUP BY ALL"""),
        "geojson_features": _sql("""SELECT res, CAST(basin_id AS VARCHAR) AS cell_id, CAST(basin_id AS VARCHAR) AS basin_id, severity, model_count,
            CAST(population AS DOUBLE) AS population, CASE WHEN res = 8 AND (basin_id - 8000000000) % 5 = 0 THEN 2 ELSE 1 END AS n_rings FROM exposed"""),
        "cell_lines": _sql("SELECT res, cell_id, count(*) AS n, count(ret_per) AS n_rivers, min(lon) AS west FROM celled GROUP BY res, cell_id", **tiles),
        "open_point_cells": _sql(f"""SELECT res, cell_id, {_label(f'max({_RANK})')} AS severity, count(*) AS model_count, '' AS models,
            false AS agree, count(*) AS n, sum(event_id / 8.0::DOUBLE) AS levels, min('station ' || event_id % 97) AS station, 'm' AS unit,
            CAST(0 AS BIGINT) AS with_model FROM opened GROUP BY res, cell_id""", **_OPENED),
        "open_point_report": _sql("""SELECT 'points' AS metric, count(*) AS value FROM gauge
            UNION ALL SELECT 'points_usable', count(*) FROM gauge WHERE event_id % 31 <> 0
            UNION ALL SELECT 'points_placed', count(*) FROM gauge WHERE event_id % 31 <> 0
            UNION ALL SELECT 'points_skipped', count(*) FROM gauge WHERE event_id % 31 = 0
            UNION ALL SELECT 'points_off_globe', CAST(0 AS BIGINT)
            UNION ALL SELECT 'cells_' || res, count(DISTINCT cell_id) FROM opened GROUP BY res""", **_OPENED),
        "stored_lookup": _sql(f"""SELECT res, cell_id, {_label(f'max({_RANK})')} AS severity, count(*) AS model_count FROM opened
            WHERE res = 7 AND cell_id = (SELECT min(cell_id) FROM opened WHERE res = 7) GROUP BY res, cell_id""", **_OPENED),
        "serving_view": _sql(f"""SELECT res, CAST(basin_id AS VARCHAR) AS cell_id, {_shown('tally.worst')} AS severity, tally.n AS model_count,
            'river' AS models, false AS agree, xmin, ymax, 1 AS n_rings, population, buildings, farmland_m2, highway_km, railway_km,
            n_listed, years, west, south, east, north
            FROM exposed JOIN tally USING (res, code) JOIN listed_river USING (res, code), frame WHERE res = 5 AND tally.model = 'river'""",
            listed_river="""SELECT res, code, count(*) AS n_listed, CAST(sum(ret_per) AS BIGINT) AS years FROM leveled WHERE model = 'river' GROUP BY ALL""",
            frame="""SELECT min(xmin) AS west, min(ymin) AS south, max(xmax) AS east, max(ymax) AS north
                FROM feature WHERE res = 4 AND code IN (SELECT code FROM tally WHERE res = 4 AND model = 'river')"""),
        "resolution_forms": """SELECT CAST(c_custkey AS VARCHAR) AS cell_id, res, coalesce(res, 0) AS counted_as FROM (
            SELECT c_custkey, CASE WHEN c_custkey % 9 <= 3 THEN CAST(c_custkey % 9 + 4 AS INTEGER) WHEN c_custkey % 9 = 4 THEN 0
            WHEN c_custkey % 9 = 8 THEN 8 END AS res FROM customer)""",
    }
    out["stored_report"] = out["build_report"]
    return out
