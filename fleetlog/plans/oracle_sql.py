"""DuckDB twins of the registered fixture queries (the correctness oracle).

Each statement is self-contained: the fixture views of FIXTURES.md are
inlined as CTEs over the driver's tables.  The oracle is written the way a
SQL user would write each operator (ASOF JOINs, plain windows, naive
self-joins, one UNION branch per rule), independently of how the Spark
plans compute them.
"""

from __future__ import annotations

from datetime import datetime

# The statements' own parameters and patterns, written out: nothing is taken from the
# modules that they check.
HISTORY_K = 3
PRIMARY_NATIONS = ("GERMANY", "FRANCE", "ITALY")
IMPORT_CUTOFF = datetime(2024, 1, 4)
P_START, P_END = "TIMESTAMP '2024-01-08 00:00:00'", "TIMESTAMP '2024-01-21 23:59:59.999999'"
C_START, C_END = "TIMESTAMP '2024-01-08 00:00:00'", "TIMESTAMP '2024-01-21 23:59:59'"
RANGES = (
    ("month", "2024-01-01 00:00:00", "2024-01-31 23:59:59.999999"),
    ("last_month", "2023-12-01 00:00:00", "2023-12-31 23:59:59.999999"),
    ("ytd", "2024-01-01 00:00:00", "2024-01-20 12:00:00"),
    ("last_12_months", "2023-01-20 00:00:00", "2024-01-20 12:00:00"),
    ("all_time", "1970-01-01 00:00:00", "2024-01-20 12:00:00"),
    ("custom", "2024-01-08 00:00:00", "2024-01-21 23:59:59"),
)
ISO_TIMESTAMP = r"[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}(:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?)?)?"
NUMBER = r"[+-]?([0-9](_?[0-9])*\.?([0-9](_?[0-9])*)?|\.[0-9](_?[0-9])*)([eE][+-]?[0-9](_?[0-9])*)?"

TOL_US = 20 * 60 * 1_000_000


def lit_ts(t: datetime) -> str:
    return f"TIMESTAMP '{t.isoformat(sep=' ')}'"


def tstxt(e: str) -> str:
    """Python ``str(datetime)`` text of a TIMESTAMP expression."""
    return (f"(strftime({e}, '%Y-%m-%d %H:%M:%S') || CASE WHEN strftime({e}, '%f') <> '000000' "
            f"THEN '.' || strftime({e}, '%f') ELSE '' END)")


def isotxt(e: str) -> str:
    return (f"(strftime({e}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime({e}, '%f') <> '000000' "
            f"THEN '.' || strftime({e}, '%f') ELSE '' END)")


def strip(e: str) -> str:
    return f"regexp_replace(coalesce({e}, ''), '^\\s+|\\s+$', '', 'g')"


def ts_parse(e: str) -> str:
    return f"CASE WHEN regexp_full_match({e}, '{ISO_TIMESTAMP}') THEN TRY_CAST(replace({e}, ',', '.') AS TIMESTAMP) END"


def num_parse(e: str) -> str:
    return f"CASE WHEN regexp_full_match({e}, '{NUMBER}') THEN TRY_CAST(replace({e}, '_', '') AS DOUBLE) END"



def _exact_sums(sql: str) -> str:
    """Sums of the logs' doubles as decimals, so that no order of addition shows."""
    for c in ("amount_eur", "liters", "f.liters"):
        sql = sql.replace(f"sum({c})", f"CAST(sum(CAST({c} AS DECIMAL(28,9))) AS DOUBLE)")
    return sql


def _expand_r6(sql: str) -> str:
    """Inline ``r6(x)``: six-decimal rounding by the same IEEE formula the Spark side
    uses (``functions.text.round6``), so equal doubles always round equally."""
    out, i = [], 0
    while (j := sql.find("r6(", i)) >= 0:
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + 3])
            i = j + 3
            continue
        depth, k = 0, j + 2
        while True:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            if depth == 0:
                break
            k += 1
        out.append(sql[i:j] + f"(floor(({_expand_r6(sql[j + 3:k])}) * 1e6 + 0.5) / 1e6)")
        i = k + 1
    out.append(sql[i:])
    return "".join(out)

EV = """ev AS (SELECT user_id AS vehicle_id, ts AS event_ts, event_id AS row_num, event_type, value, props FROM events)"""

FUEL = EV + """,
fuel AS (SELECT vehicle_id, event_ts, row_num, value AS amount_eur, CAST(k AS DOUBLE) + 1 AS liters,
                value / (CAST(k AS DOUBLE) + 1) AS price_per_liter_eur,
                CASE WHEN k % 3 = 0 THEN 'E5' ELSE 'E10' END AS fuel_type, 'true' AS is_full_tank,
                'Station ' || (k % 7) AS station_name, 'City ' || (k % 5) AS city,
                CASE k % 3 WHEN 0 THEN 'DE' WHEN 1 THEN 'AT' ELSE 'IT' END AS country
         FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM ev WHERE event_type = 'purchase'))"""

ODO = """odo AS (SELECT vehicle_id, event_ts, row_num, odometer_km FROM (
         SELECT *, CAST(SUM(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY vehicle_id ORDER BY event_ts, row_num) AS DOUBLE) AS odometer_km
         FROM ev)
       WHERE event_type IN ('view','click','error') OR (event_type = 'purchase' AND row_num % 5 = 0))"""

ODO_RAW = """odo_raw AS (SELECT vehicle_id, event_ts, row_num, value AS odometer_km FROM ev)"""

LOG = """log AS (SELECT l_suppkey AS vehicle_id, l_shipdate AS event_ts, l_extendedprice AS amount_eur, l_quantity AS liters,
                l_extendedprice / l_quantity AS price_per_liter_eur,
                l_returnflag AS fuel_type, CASE l_linestatus WHEN 'F' THEN 'true' ELSE 'false' END AS is_full_tank,
                s_name AS station_name, CASE WHEN s_suppkey % 10 = 0 THEN ' ' ELSE s_name END AS city, n_name AS country
         FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""

GAP_LOG = LOG + """,
gaplog AS (SELECT * REPLACE (CASE WHEN month(event_ts) IN (2, 8) THEN event_ts + INTERVAL 31 DAYS ELSE event_ts END AS event_ts) FROM log)"""

DIRTY = """dirty AS (SELECT o_custkey AS vehicle_id, o_orderkey + 2 AS row_num,
  CASE WHEN o_orderkey % 97 = 0 THEN 'not-a-date' WHEN o_orderkey % 89 = 0 THEN ''
       ELSE ' ' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' ' END AS datetime,
  CASE WHEN o_orderkey % 83 = 0 THEN '-10' WHEN o_orderkey % 79 = 0 THEN 'abc'
       ELSE CAST(round(o_totalprice / 3000, 2) AS VARCHAR) END AS amount_eur,
  CASE WHEN o_orderkey % 73 = 0 THEN '0' ELSE CAST(20 + o_custkey % 40 AS VARCHAR) END AS liters,
  CASE WHEN o_orderkey % 71 = 0 THEN 'E15' WHEN o_orderstatus = 'F' THEN 'E5' ELSE 'E10' END AS fuel_type,
  CASE o_orderkey % 11 WHEN 0 THEN '' WHEN 1 THEN 'NO' WHEN 2 THEN 'na'
       WHEN 3 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'maybe' ELSE '1' END ELSE 'true' END AS is_full_tank,
  CASE WHEN o_orderkey % 67 = 0 THEN '  ' ELSE 'Station ' || o_custkey % 50 END AS station_name,
  CASE WHEN o_orderkey % 61 = 0 THEN '' ELSE 'City ' || o_custkey % 20 END AS city,
  CASE o_orderkey % 13 WHEN 0 THEN 'ES' WHEN 1 THEN 'de'
       WHEN 2 THEN CASE WHEN o_orderkey % 17 = 0 THEN 'Germany' ELSE 'FR' END ELSE 'DE' END AS country, '' AS notes
FROM orders)"""

DIRTY_PARSED = DIRTY + f""",
ds AS (SELECT *, {strip('datetime')} AS dt_s, {strip('amount_eur')} AS am_s, {strip('liters')} AS li_s,
              {strip('fuel_type')} AS ft, {strip('is_full_tank')} AS tk_s, {strip('station_name')} AS st,
              {strip('city')} AS ci, {strip('country')} AS co, {strip('notes')} AS nt FROM dirty),
dp AS (SELECT *, {ts_parse('dt_s')} AS ts, {num_parse('am_s')} AS amount, {num_parse('li_s')} AS lit,
              CASE WHEN lower(tk_s) IN ('', 'na', 'none') THEN 'unknown' WHEN lower(tk_s) IN ('true', '1', 'yes') THEN 'true'
                   WHEN lower(tk_s) IN ('false', '0', 'no') THEN 'false' END AS tank,
              regexp_full_match(co, '^[A-Z]{{2}}$') AS co_ok FROM ds),
good AS (SELECT * FROM dp WHERE ts IS NOT NULL AND amount > 0 AND lit > 0 AND ft IN ('E5', 'E10')
           AND tank IS NOT NULL AND st <> '' AND co_ok)"""

def duplicate_groups(name: str, rows: str, value: str, ts: str = "ts") -> str:
    """CTE ``name``: instants with partners of one value up to the tolerance before them."""
    return f"""{name}_at AS (SELECT vehicle_id, {value}, {ts} AS event_ts, CAST(count(*) AS BIGINT) AS rows, min(row_num) AS first_row,
         max(row_num) AS last_row FROM {rows} GROUP BY 1, 2, 3),
{name}_near AS (SELECT *, coalesce(CAST(sum(rows) OVER w AS BIGINT), 0) AS earlier_rows, max(event_ts) OVER w AS nearest_ts,
         last_value(last_row) OVER w AS nearest_row FROM {name}_at
         WINDOW w AS (PARTITION BY vehicle_id, {value} ORDER BY epoch_us(event_ts) RANGE BETWEEN {TOL_US} PRECEDING AND 1 PRECEDING)),
{name} AS (SELECT *, rows * (rows - 1) // 2 + rows * earlier_rows AS pairs FROM {name}_near
         WHERE rows * (rows - 1) // 2 + rows * earlier_rows > 0)"""


def _row_issues(dataset: str, rules: list[tuple], source: str) -> str:
    """One branch for each rule: severity, rule, field, message, condition (and another source)."""
    return "\n  UNION ALL ".join(
        f"SELECT vehicle_id, '{dataset}' AS dataset, '{sev}' AS severity, '{rule}' AS rule, row_num, '{field}' AS field, {msg} AS message, "
        f"NULL::BIGINT AS pair_row_a, NULL::BIGINT AS pair_row_b, 1::BIGINT AS pairs FROM {src[0] if src else source} WHERE {cond}"
        for sev, rule, field, msg, cond, *src in rules)


def _quoted(before: str, value: str, after: str = "'") -> str:
    esc = lambda t: t.replace("'", "''")
    return f"'{esc(before)}' || {value} || '{esc(after)}'"


_FUEL_RULES = [
    ("error", "datetime_unparsable", "datetime", _quoted("Unparsable datetime: '", "coalesce(datetime, '')"), "ts IS NULL"),
    ("error", "amount_eur_not_numeric", "amount_eur", _quoted("Invalid numeric value for amount_eur: '", "amount_eur"), "amount IS NULL"),
    ("error", "amount_eur_range", "amount_eur", "'amount_eur must be positive, got ' || amount", "amount <= 0"),
    ("error", "liters_not_numeric", "liters", _quoted("Invalid numeric value for liters: '", "liters"), "lit IS NULL"),
    ("error", "liters_range", "liters", "'liters must be positive, got ' || lit", "lit <= 0"),
    ("error", "fuel_type_invalid", "fuel_type", _quoted("Invalid fuel_type: '", "ft", "'. Allowed: ['E10', 'E5']"), "ft NOT IN ('E5', 'E10')"),
    ("error", "full_tank_invalid", "is_full_tank",
     _quoted("Invalid full tank value: '", "is_full_tank", "'. Expected true/false/empty or yes/no/1/0."), "tank IS NULL"),
    ("error", "station_missing", "station_name", "'Missing station_name'", "tank IS NOT NULL AND st = ''"),
    ("warning", "city_missing", "city", "'Missing city value'", "tank IS NOT NULL AND ci = ''"),
    ("error", "country_format", "country", _quoted("Invalid country code format: '", "co", "'. Expected 2-letter ISO code."),
     "tank IS NOT NULL AND NOT co_ok"),
    ("warning", "country_not_primary", "country",
     _quoted("Country '", "co", "' is not in the primary set ['AT', 'CH', 'DE', 'FR', 'HR', 'IT']"),
     "tank IS NOT NULL AND co_ok AND co NOT IN ('DE', 'AT', 'IT', 'FR', 'HR', 'CH')"),
    ("warning", "price_low", "amount_eur", "'Suspiciously low derived price per liter: ' || printf('%.3f', amount / lit) || ' EUR'",
     "amount / lit < 0.8", "good"),
    ("warning", "price_high", "amount_eur", "'Suspiciously high derived price per liter: ' || printf('%.3f', amount / lit) || ' EUR'",
     "amount / lit > 3.0", "good"),
]

FUEL_ISSUES = DIRTY_PARSED + f""",
{duplicate_groups('fd', 'good', 'lit')},
fi AS ({_row_issues('fuel', _FUEL_RULES, 'dp')}
  UNION ALL SELECT vehicle_id, 'fuel', 'warning', 'potential_duplicate', NULL, NULL,
         'Potential duplicate: rows with ' || lit || 'L at ' || {tstxt('coalesce(nearest_ts, event_ts)')} || ' and ' || {tstxt('event_ts')} || ' (within 0:20:00)',
         coalesce(nearest_row, first_row), last_row, pairs FROM fd)"""

_ODO_RULES = [
    ("error", "datetime_unparsable", "datetime", _quoted("Unparsable datetime: '", "coalesce(datetime, '')"), "ts IS NULL"),
    ("error", "odometer_km_not_numeric", "odometer_km", _quoted("Invalid numeric value for odometer_km: '", "amount_eur"), "km IS NULL"),
    ("error", "odometer_km_range", "odometer_km", "'odometer_km must be non-negative, got ' || km", "km < 0"),
]

ODO_TAIL = f"""ods AS (SELECT vehicle_id, row_num, datetime, amount_eur, {strip('datetime')} AS dt_s, {strip('amount_eur')} AS km_s, {strip('notes')} AS nt FROM dirty),
odp AS (SELECT *, {ts_parse('dt_s')} AS ts, {num_parse('km_s')} AS km FROM ods),
ogood AS (SELECT * FROM odp WHERE ts IS NOT NULL AND km >= 0),
oseq AS (SELECT *, lag(km) OVER w AS p_km, lag(row_num) OVER w AS p_row, lag(ts) OVER w AS p_ts FROM ogood
         WINDOW w AS (PARTITION BY vehicle_id ORDER BY ts, row_num)),
{duplicate_groups('od', 'ogood', 'km')},
oi AS ({_row_issues('odometer', _ODO_RULES, 'odp')}
  UNION ALL SELECT vehicle_id, 'odometer', 'warning', 'monotonicity', NULL, 'odometer_km',
         'Odometer monotonicity violation: ' || km || ' km at ' || {tstxt('ts')} || ' is less than ' || p_km || ' km at ' || {tstxt('p_ts')},
         p_row, row_num, 1 FROM oseq WHERE km < p_km
  UNION ALL SELECT vehicle_id, 'odometer', 'warning', 'potential_duplicate', NULL, NULL,
         'Potential duplicate: odometer readings of ' || km || ' km at ' || {tstxt('coalesce(nearest_ts, event_ts)')} || ' and ' || {tstxt('event_ts')} || ' (within 0:20:00)',
         coalesce(nearest_row, first_row), last_row, pairs FROM od)"""

ODO_DIRTY = DIRTY + ",\n" + ODO_TAIL


def asof_est(probe: str, readings: str, name: str) -> str:
    """CTE ``name``: probe rows + est_value/est_quality/est_interval via ASOF joins."""
    return f"""{name}_b AS (SELECT p.vehicle_id, p.row_num, p.event_ts, r.event_ts AS b_ts, r.odometer_km AS b_km
              FROM {probe} p ASOF LEFT JOIN {readings} r ON p.vehicle_id = r.vehicle_id AND p.event_ts > r.event_ts),
{name}_a AS (SELECT p.vehicle_id, p.row_num, r.event_ts AS a_ts, r.odometer_km AS a_km
              FROM {probe} p ASOF LEFT JOIN {readings} r ON p.vehicle_id = r.vehicle_id AND p.event_ts < r.event_ts),
{name}_x AS (SELECT p.vehicle_id, p.row_num, arg_min(r.odometer_km, r.row_num) AS x_km, min(r.event_ts) AS x_ts
              FROM {probe} p JOIN {readings} r ON p.vehicle_id = r.vehicle_id AND p.event_ts = r.event_ts
              GROUP BY p.vehicle_id, p.row_num),
{name} AS (SELECT b.vehicle_id, b.row_num, b.event_ts,
    CASE WHEN x.x_km IS NOT NULL THEN x.x_km
         WHEN b.b_ts IS NOT NULL AND a.a_ts IS NOT NULL THEN
              b.b_km + ((epoch_us(b.event_ts) - epoch_us(b.b_ts)) / 1e6) / ((epoch_us(a.a_ts) - epoch_us(b.b_ts)) / 1e6) * (a.a_km - b.b_km)
         ELSE 0.0 END AS est_value,
    CASE WHEN x.x_km IS NOT NULL THEN 'exact' WHEN b.b_ts IS NOT NULL AND a.a_ts IS NOT NULL THEN 'estimated'
         ELSE 'insufficient' END AS est_quality,
    CASE WHEN x.x_km IS NOT NULL THEN 'exact match at ' || {tstxt('x.x_ts')}
         WHEN b.b_ts IS NOT NULL AND a.a_ts IS NOT NULL THEN {tstxt('b.b_ts')} || ' -> ' || {tstxt('a.a_ts')}
         WHEN a.a_ts IS NOT NULL THEN 'before first record (' || {tstxt('a.a_ts')} || ')'
         WHEN b.b_ts IS NOT NULL THEN 'after last record (' || {tstxt('b.b_ts')} || ')' END AS est_interval
  FROM {name}_b b JOIN {name}_a a USING (vehicle_id, row_num) LEFT JOIN {name}_x x USING (vehicle_id, row_num))"""


def segments(probe: str = "fuel", readings: str = "odo", name: str = "seg") -> str:
    """CTE ``name``: accepted consecutive-refuel segments of ``probe``."""
    return f"""{asof_est(probe, readings, name + '_est')},
{name}_seq AS (SELECT f.vehicle_id, f.event_ts, f.row_num, f.liters, f.amount_eur, e.est_value, e.est_quality, e.est_interval,
          lag(f.event_ts) OVER w AS p_ts, lag(f.row_num) OVER w AS p_row, lag(e.est_value) OVER w AS p_value,
          lag(e.est_quality) OVER w AS p_quality, lag(e.est_interval) OVER w AS p_interval
        FROM {probe} f JOIN {name}_est e USING (vehicle_id, row_num)
        WINDOW w AS (PARTITION BY f.vehicle_id ORDER BY f.event_ts, f.row_num)),
{name} AS (SELECT *, est_value - p_value AS km,
          CASE WHEN p_quality = 'estimated' OR est_quality = 'estimated' THEN 'estimated' ELSE 'exact' END AS quality,
          {tstxt('p_ts')} || ' -> ' || {tstxt('event_ts')} AS interval
        FROM {name}_seq WHERE p_ts IS NOT NULL AND p_quality <> 'insufficient' AND est_quality <> 'insufficient'
          AND est_value - p_value > 0)"""


SEG_COLUMNS = """vehicle_id, p_ts AS previous_fuel_datetime, p_row AS previous_row_num, event_ts AS fuel_datetime, row_num,
       liters, amount_eur, r6(km) AS estimated_km,
       r6(p_value) AS odometer_at_previous, r6(est_value) AS odometer_at_current,
       r6(liters / km * 100) AS liters_per_100km, r6(amount_eur / km * 100) AS cost_per_100km,
       r6(amount_eur / km) AS cost_per_km, quality, interval AS source_interval"""


def _monthly(value: str, agg: str, fill: str | None) -> str:
    v = f"coalesce(g.v, {fill})" if fill is not None else "g.v"
    return f"""WITH {GAP_LOG},
g AS (SELECT vehicle_id, last_day(event_ts) AS month, {agg} AS v FROM gaplog GROUP BY 1, 2),
span AS (SELECT vehicle_id, min(month) AS lo, max(month) AS hi FROM g GROUP BY 1),
sk AS (SELECT vehicle_id, last_day(unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH))) AS month FROM span)
SELECT sk.vehicle_id, CAST(sk.month AS TIMESTAMP) AS month, r6({v}) AS {value}
FROM sk LEFT JOIN g ON sk.vehicle_id = g.vehicle_id AND sk.month = g.month"""


def _distance_between(readings_cte: str, readings: str) -> str:
    return f"""WITH {EV}, {readings_cte},
pr AS (SELECT vehicle_id, 0 AS row_num, {P_START} AS event_ts FROM (SELECT DISTINCT vehicle_id FROM {readings})
       UNION ALL SELECT vehicle_id, 1, {P_END} FROM (SELECT DISTINCT vehicle_id FROM {readings})),
{asof_est('pr', readings, 'est')},
se AS (SELECT s.vehicle_id, s.est_value AS sv, s.est_quality AS sq, s.est_interval AS si,
              e.est_value AS ev, e.est_quality AS eq, e.est_interval AS ei
       FROM est s JOIN est e ON s.vehicle_id = e.vehicle_id AND s.row_num = 0 AND e.row_num = 1),
sx AS (SELECT *, (sq = 'insufficient' OR eq = 'insufficient') AS insuf, ev - sv AS d FROM se)
SELECT vehicle_id, {P_START} AS start, {P_END} AS "end",
  CASE WHEN insuf OR d < 0 THEN 0.0 ELSE r6(d) END AS distance_km,
  CASE WHEN insuf OR d < 0 THEN 'insufficient' WHEN sq = 'estimated' OR eq = 'estimated' THEN 'estimated' ELSE 'exact' END AS quality,
  CASE WHEN insuf THEN 'start: ' || coalesce(si, 'unknown') || '; end: ' || coalesce(ei, 'unknown')
       WHEN d < 0 THEN 'negative distance between ' || {tstxt(P_START)} || ' and ' || {tstxt(P_END)}
       ELSE 'start: ' || coalesce(si, {tstxt(P_START)}) || '; end: ' || coalesce(ei, {tstxt(P_END)}) END AS source_interval
FROM sx"""


def _ranges_values() -> str:
    rows = [f"('{k}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for k, a, b in RANGES]
    return "rng(range, start, \"end\") AS (VALUES " + ", ".join(rows) + ")"


def queries() -> dict[str, str]:
    q: dict[str, str] = {}
    c_start, c_end = C_START, C_END

    # --- fuel aggregates -----------------------------------------------------
    q["fuel_totals"] = f"""WITH {LOG}
SELECT vehicle_id, CAST(count(*) AS BIGINT) AS entries, r6(sum(liters)) AS total_liters,
       r6(sum(amount_eur)) AS total_eur, r6(sum(amount_eur) / sum(liters)) AS avg_price_per_liter
FROM log GROUP BY vehicle_id"""

    q["month_to_date"] = f"""WITH {FUEL}
SELECT vehicle_id, CAST(count(*) AS BIGINT) AS month_entries, r6(sum(liters)) AS month_liters,
       r6(sum(amount_eur)) AS month_eur
FROM fuel WHERE event_ts BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-31 23:59:59.999999'
GROUP BY vehicle_id"""

    q["fuel_price_over_time"] = f"""WITH {FUEL}
SELECT vehicle_id, event_ts, row_num, amount_eur / liters AS price_per_liter_eur FROM fuel"""

    q["fuel_type_summary"] = f"""WITH {LOG}
SELECT vehicle_id, fuel_type, CAST(count(*) AS BIGINT) AS count, r6(sum(liters)) AS total_liters,
       r6(sum(amount_eur)) AS total_eur FROM log GROUP BY 1, 2"""

    q["fuel_type_share"] = f"""WITH {LOG},
s AS (SELECT vehicle_id, fuel_type, CAST(count(*) AS BIGINT) AS count, sum(liters) AS l, sum(amount_eur) AS e FROM log GROUP BY 1, 2)
SELECT vehicle_id, fuel_type, count,
  r6(count * 100.0 / sum(count) OVER (PARTITION BY vehicle_id)) AS stops_share_pct,
  r6(l * 100.0 / sum(l) OVER (PARTITION BY vehicle_id)) AS liters_share_pct,
  r6(e * 100.0 / sum(e) OVER (PARTITION BY vehicle_id)) AS eur_share_pct
FROM s"""

    q["avg_price_by_country"] = f"""WITH {LOG}
SELECT vehicle_id, country, r6(sum(amount_eur) / sum(liters)) AS avg_price_per_liter,
       r6(sum(liters)) AS total_liters FROM log GROUP BY 1, 2"""

    q["avg_price_by_city"] = f"""WITH {LOG}
SELECT vehicle_id, city, r6(sum(amount_eur) / sum(liters)) AS avg_price_per_liter,
       r6(sum(liters)) AS total_liters FROM log WHERE {strip('city')} <> '' GROUP BY 1, 2"""

    for col, where in (("country", ""), ("city", f"WHERE {strip('city')} <> ''")):
        q[f"location_overview_{col}"] = f"""WITH {LOG},
g AS (SELECT vehicle_id, {col}, CAST(count(*) AS BIGINT) AS stops, sum(liters) AS liters, sum(amount_eur) AS eur
      FROM log {where} GROUP BY 1, 2)
SELECT vehicle_id, {col}, stops, r6(liters) AS liters, r6(eur) AS eur,
       r6(eur / liters) AS avg_price_per_liter,
       CAST(row_number() OVER (PARTITION BY vehicle_id ORDER BY liters DESC, stops DESC, {col}) AS INTEGER) AS rank
FROM g"""

    q["monthly_liters"] = _monthly("liters", "sum(liters)", "0.0")
    q["monthly_spending"] = _monthly("amount_eur", "sum(amount_eur)", "0.0")
    q["fuel_price_trend"] = _monthly("avg_price_per_liter", "CAST(sum(CAST(amount_eur / liters AS DECIMAL(28,9))) AS DOUBLE) / count(*)", None)

    # --- odometer series -----------------------------------------------------
    for name, cte, src in (("total_distance", ODO, "odo"), ("total_distance_raw", ODO_RAW, "odo_raw")):
        q[name] = f"""WITH {EV}, {cte}
SELECT vehicle_id, CAST(count(*) AS BIGINT) AS readings,
       r6(CASE WHEN count(*) < 2 THEN 0.0 ELSE arg_max(odometer_km, event_ts) - arg_min(odometer_km, event_ts) END) AS total_km
FROM {src} GROUP BY vehicle_id"""

    q["monthly_km_driven"] = f"""WITH {EV}, {ODO}
SELECT vehicle_id, CAST(date_trunc('month', event_ts) AS TIMESTAMP) AS month,
       r6(CASE WHEN count(*) < 2 THEN 0.0 ELSE arg_max(odometer_km, event_ts) - arg_min(odometer_km, event_ts) END) AS km_driven
FROM odo GROUP BY 1, 2"""

    q["cumulative_distance"] = f"""WITH {EV}, {ODO}
SELECT vehicle_id, event_ts, row_num,
       r6(odometer_km - first_value(odometer_km) OVER (PARTITION BY vehicle_id ORDER BY event_ts, row_num)) AS cumulative_km
FROM odo"""

    q["distance_timeline"] = f"""WITH {EV}, {ODO},
d AS (SELECT *, odometer_km - lag(odometer_km) OVER (PARTITION BY vehicle_id ORDER BY event_ts, row_num) AS delta FROM odo)
SELECT vehicle_id, event_ts, row_num, r6(delta) AS km_since_last_entry FROM d
WHERE event_ts BETWEEN {P_START} AND {P_END} AND delta IS NOT NULL"""

    q["odometer_readings_in_period"] = f"""WITH {EV}, {ODO},
d AS (SELECT *, odometer_km - lag(odometer_km) OVER (PARTITION BY vehicle_id ORDER BY event_ts, row_num) AS delta FROM odo)
SELECT vehicle_id, event_ts, row_num, r6(odometer_km) AS odometer_km, r6(delta) AS km_since_previous FROM d
WHERE event_ts BETWEEN {P_START} AND {P_END}"""

    # --- as-of, consumption --------------------------------------------------
    q["odometer_at_fuel"] = f"""WITH {FUEL}, {ODO}, {asof_est('fuel', 'odo', 'est')}
SELECT vehicle_id, event_ts, row_num, r6(est_value) AS odometer_km, est_quality AS quality,
       'linear' AS method, est_interval AS source_interval FROM est"""

    q["consumption_segments"] = f"""WITH {FUEL}, {ODO}, {segments()}
SELECT {SEG_COLUMNS} FROM seg"""

    q["consumption_in_period"] = f"""WITH {FUEL}, {ODO},
fuel_p AS (SELECT * FROM fuel WHERE event_ts BETWEEN {P_START} AND {P_END}), {segments('fuel_p')}
SELECT {SEG_COLUMNS} FROM seg"""

    q["consumption_flat"] = f"""WITH {FUEL}, {ODO}, {segments()}
SELECT vehicle_id, p_row AS previous_row_num, row_num, p_ts AS previous_fuel_datetime, event_ts AS datetime, liters,
       r6(km) AS estimated_km,
       r6(p_value) AS odometer_at_previous, p_quality AS odometer_at_previous_quality,
       'linear' AS odometer_at_previous_method, p_interval AS odometer_at_previous_source_interval,
       r6(est_value) AS odometer_at_current, est_quality AS odometer_at_current_quality,
       'linear' AS odometer_at_current_method, est_interval AS odometer_at_current_source_interval,
       r6(liters / km * 100) AS liters_per_100km, quality AS liters_per_100km_quality,
       'linear' AS liters_per_100km_method,
       r6(amount_eur / km * 100) AS cost_per_100km, quality AS cost_per_100km_quality,
       r6(amount_eur / km) AS cost_per_km, quality AS cost_per_km_quality,
       'linear' AS estimation_method, interval AS source_interval, amount_eur
FROM seg"""

    q["consumption_summary"] = f"""WITH {FUEL}, {ODO}, {segments()}
SELECT vehicle_id, CAST(count(*) AS BIGINT) AS segments, r6(avg(liters / km * 100)) AS avg_l_per_100km,
       r6(avg(amount_eur / km * 100)) AS avg_cost_per_100km, r6(avg(amount_eur / km)) AS avg_cost_per_km,
       bool_or(quality = 'estimated') AS any_estimated
FROM seg GROUP BY vehicle_id"""

    q["distance_between"] = _distance_between(ODO, "odo")
    q["distance_between_raw"] = _distance_between(ODO_RAW, "odo_raw")

    q["boundary_estimates"] = f"""WITH {FUEL}, {ODO},
u AS (SELECT vehicle_id FROM fuel UNION SELECT vehicle_id FROM odo),
pr AS (SELECT vehicle_id, 0 AS row_num, 'Start of report' AS boundary, {P_START} AS event_ts FROM u
       UNION ALL SELECT vehicle_id, 1, 'End of report', {P_END} FROM u),
{asof_est('pr', 'odo', 'est')}
SELECT pr.vehicle_id, pr.boundary, pr.event_ts,
       CASE WHEN est_quality = 'insufficient' THEN NULL ELSE r6(est_value) END AS odometer_km,
       est_quality AS quality,
       coalesce(est_interval, CASE est_quality WHEN 'insufficient' THEN 'Not enough odometer data.'
                WHEN 'exact' THEN 'Exact reading.' ELSE 'Estimated by interpolation.' END) AS supporting_data
FROM pr JOIN est USING (vehicle_id, row_num)"""

    # --- validation ----------------------------------------------------------
    q["fuel_clean"] = f"""WITH {DIRTY_PARSED}
SELECT vehicle_id, row_num, ts AS event_ts, amount AS amount_eur, lit AS liters, amount / lit AS price_per_liter_eur,
       ft AS fuel_type, tank AS is_full_tank, st AS station_name, ci AS city, co AS country, nt AS notes FROM good"""

    q["fuel_issues"] = f"""WITH {FUEL_ISSUES}
SELECT vehicle_id, dataset, severity, rule, row_num, field, message, pair_row_a, pair_row_b, pairs FROM fi"""

    q["issue_summary"] = f"""WITH {FUEL_ISSUES}
SELECT dataset, severity, rule, CAST(sum(pairs) AS BIGINT) AS issues FROM fi GROUP BY 1, 2, 3"""

    group = "rows, first_row, last_row, earlier_rows, nearest_ts, nearest_row, pairs"
    q["fuel_duplicates"] = f"""WITH {DIRTY_PARSED}, {duplicate_groups('fd', 'good', 'lit')}
SELECT vehicle_id, lit AS liters, event_ts, {group} FROM fd"""

    q["odometer_clean"] = f"""WITH {ODO_DIRTY}
SELECT vehicle_id, row_num, ts AS event_ts, km AS odometer_km, nt AS notes FROM ogood"""

    q["odometer_issues"] = f"""WITH {ODO_DIRTY}
SELECT vehicle_id, dataset, severity, rule, row_num, field, message, pair_row_a, pair_row_b, pairs FROM oi"""

    q["quality_summary"] = f"""WITH {FUEL_ISSUES}, {ODO_TAIL}
SELECT 'fuel' AS dataset, (SELECT CAST(count(*) AS BIGINT) FROM good) AS valid_records,
       CAST(coalesce(sum(pairs) FILTER (WHERE severity = 'error'), 0) AS BIGINT) AS errors,
       CAST(coalesce(sum(pairs) FILTER (WHERE severity = 'warning'), 0) AS BIGINT) AS warnings,
       count(*) FILTER (WHERE severity = 'error') = 0 AS is_valid FROM fi
UNION ALL
SELECT 'odometer', (SELECT CAST(count(*) AS BIGINT) FROM ogood),
       CAST(coalesce(sum(pairs) FILTER (WHERE severity = 'error'), 0) AS BIGINT), CAST(coalesce(sum(pairs) FILTER (WHERE severity = 'warning'), 0) AS BIGINT),
       count(*) FILTER (WHERE severity = 'error') = 0 FROM oi"""

    q["odometer_monotonicity"] = f"""WITH {EV}, {ODO_RAW},
s AS (SELECT *, lag(event_ts) OVER w AS previous_ts, lag(row_num) OVER w AS previous_row_num,
             lag(odometer_km) OVER w AS previous_km FROM odo_raw
      WINDOW w AS (PARTITION BY vehicle_id ORDER BY event_ts, row_num))
SELECT vehicle_id, event_ts, row_num, odometer_km, previous_ts, previous_row_num, previous_km FROM s
WHERE odometer_km < previous_km"""

    q["odometer_duplicates"] = f"""WITH {EV}, {duplicate_groups('ed', 'ev', 'event_type', 'event_ts')}
SELECT vehicle_id, event_type, event_ts, {group} FROM ed"""

    def cleaned(c: str) -> str:
        return f"floor(TRY_CAST(regexp_replace({c}, '^([^,]*),', '\\1.') AS DOUBLE) * 100 + 0.5) / 100"

    checks = [("amount_eur", "coalesce(a <= 0, true)", "Must be greater than 0."), ("city", f"{strip('city')} = ''", "Required."),
              ("country", f"NOT regexp_full_match(upper({strip('country')}), '[A-Z]{{2}}')", "Must be a 2-letter ISO country code."),
              ("entry_date", f"({ts_parse(strip('datetime'))}) IS NULL", "Must be a valid date/time."),
              ("fuel_type", f"{strip('fuel_type')} NOT IN ('E5', 'E10')", "Must be one of [''E10'', ''E5'']."),
              ("is_full_tank", f"lower({strip('is_full_tank')}) NOT IN ('true', 'false', 'unknown')", "Must be true, false, or unknown."),
              ("liters", "coalesce(l <= 0, true)", "Must be greater than 0."), ("station_name", f"{strip('station_name')} = ''", "Required.")]
    listed = ", ".join(f"CASE WHEN {cond} THEN '{field}: {text}' END" for field, cond, text in checks)
    entries = f"""e AS (SELECT *, coalesce({cleaned('liters')}, {num_parse(strip('liters'))}) AS l,
             coalesce({cleaned('amount_eur')}, {num_parse(strip('amount_eur'))}) AS a FROM dirty),
c AS (SELECT *, list_filter([{listed}], lambda x: x IS NOT NULL) AS errs FROM e)"""
    q["entry_validation"] = f"""WITH {DIRTY}, {entries}
SELECT vehicle_id, row_num, len(errs) = 0 AS accepted, array_to_string(errs, ' ') AS errors,
       CAST(CASE WHEN len(errs) = 0 THEN (CASE WHEN a / l < 0.8 THEN 1 ELSE 0 END) + (CASE WHEN a / l > 3.0 THEN 1 ELSE 0 END) ELSE 0 END AS INTEGER) AS warnings,
       CASE WHEN len(errs) = 0 THEN l END AS liters, CASE WHEN len(errs) = 0 THEN a END AS amount_eur
FROM c"""

    plain = f"""e AS (SELECT *, {num_parse(strip('liters'))} AS l, {num_parse(strip('amount_eur'))} AS a FROM dirty),
c AS (SELECT *, list_filter([{listed}], lambda x: x IS NOT NULL) AS errs FROM e)"""
    q["stream_entries"] = f"""WITH {DIRTY}, {plain}
SELECT vehicle_id, row_num, array_to_string([split_part(x, ':', 1) for x in errs], ',') AS error_fields,
       CASE WHEN len(errs) > 0 THEN liters END AS entered FROM c"""

    # --- lookups, history, periods -------------------------------------------
    q["recent_history"] = f"""WITH {FUEL},
r AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY event_ts DESC, row_num DESC) AS recency FROM fuel)
SELECT vehicle_id, row_num, {isotxt('event_ts')} AS datetime, strftime(event_ts, '%Y-%m-%d') AS date,
       strftime(event_ts, '%H:%M') AS time, liters, amount_eur, CAST(recency AS INTEGER) AS recency
FROM r WHERE recency <= {HISTORY_K}"""

    dim = "dim AS (SELECT n_name AS code, lower(n_name) AS name FROM nation)"
    stops = """g AS (SELECT vehicle_id, CASE WHEN vehicle_id % 4 = 0 THEN country || '?' ELSE country END AS country,
      CAST(count(*) AS BIGINT) AS stops FROM log GROUP BY 1, 2)"""
    q["country_lookup"] = f"""WITH {LOG}, {dim}, {stops}
SELECT g.vehicle_id, g.country, coalesce(dim.name, g.country) AS country_name, g.stops
FROM g LEFT JOIN dim ON g.country = dim.code"""

    q["unknown_countries"] = f"""WITH {LOG}, {dim}, {stops}
SELECT vehicle_id, country, stops FROM g WHERE country NOT IN (SELECT code FROM dim)"""

    case = " ".join(f"WHEN '{c}' THEN {i + 1}" for i, c in enumerate(PRIMARY_NATIONS))
    q["country_options"] = f"""WITH {dim}
SELECT code, name, CAST(row_number() OVER (ORDER BY CASE code {case} ELSE {len(PRIMARY_NATIONS) + 1} END, name, code) AS INTEGER) AS position
FROM dim"""

    q["vehicles_for_user"] = """WITH bridge AS (SELECT DISTINCT o_custkey AS user_id, l_suppkey AS car_id
                FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT c_custkey AS user_id, s_suppkey AS car_id, c_name, s_name
FROM customer JOIN bridge ON c_custkey = bridge.user_id JOIN supplier ON s_suppkey = bridge.car_id"""

    q["import_missing_vehicles"] = f"""WITH {FUEL}
SELECT vehicle_id, CAST(count(*) AS BIGINT) AS imported_rows FROM fuel
WHERE vehicle_id NOT IN (SELECT vehicle_id FROM fuel WHERE event_ts < {lit_ts(IMPORT_CUTOFF)})
GROUP BY vehicle_id"""

    q["report_period"] = f"""WITH {FUEL}, {ODO},
b AS (SELECT vehicle_id, event_ts FROM fuel UNION ALL SELECT vehicle_id, event_ts FROM odo)
SELECT vehicle_id, min(event_ts) AS start, max(event_ts) AS "end" FROM b GROUP BY vehicle_id"""

    q["range_bounds"] = f"""WITH {FUEL}, {_ranges_values()}
SELECT f.vehicle_id, r.range, r.start, r."end", CAST(count(*) AS BIGINT) AS entries, r6(sum(f.liters)) AS liters
FROM fuel f JOIN rng r ON f.event_ts BETWEEN r.start AND r."end"
GROUP BY 1, 2, 3, 4"""

    # --- report and payload --------------------------------------------------
    q["report_cards"] = f"""WITH {FUEL}, {ODO},
u AS (SELECT vehicle_id FROM fuel UNION SELECT vehicle_id FROM odo),
fuel_p AS (SELECT * FROM fuel WHERE event_ts BETWEEN {P_START} AND {P_END}),
ft AS (SELECT vehicle_id, count(*) AS n, sum(liters) AS l, sum(amount_eur) AS e FROM fuel_p GROUP BY 1),
odo_p AS (SELECT * FROM odo WHERE event_ts BETWEEN {P_START} AND {P_END}),
ob AS (SELECT vehicle_id, count(*) AS n,
              CASE WHEN count(*) < 2 THEN 0.0 ELSE arg_max(odometer_km, event_ts) - arg_min(odometer_km, event_ts) END AS km
       FROM odo_p GROUP BY 1),
pr AS (SELECT vehicle_id, 0 AS row_num, {P_START} AS event_ts FROM u UNION ALL SELECT vehicle_id, 1, {P_END} FROM u),
{asof_est('pr', 'odo', 'be')},
se AS (SELECT s.vehicle_id, s.est_value AS sv, s.est_quality AS sq, s.est_interval AS si,
              e.est_value AS ev, e.est_quality AS eq, e.est_interval AS ei
       FROM be s JOIN be e ON s.vehicle_id = e.vehicle_id AND s.row_num = 0 AND e.row_num = 1),
dx AS (SELECT vehicle_id, sq = 'insufficient' OR eq = 'insufficient' OR ev - sv < 0 AS insuf,
              ev - sv AS d,
              CASE WHEN sq = 'insufficient' OR eq = 'insufficient' OR ev - sv < 0 THEN 'insufficient'
                   WHEN sq = 'estimated' OR eq = 'estimated' THEN 'estimated' ELSE 'exact' END AS q,
              CASE WHEN sq = 'insufficient' OR eq = 'insufficient' THEN 'start: ' || coalesce(si, 'unknown') || '; end: ' || coalesce(ei, 'unknown')
                   WHEN ev - sv < 0 THEN 'negative distance between ' || {tstxt(P_START)} || ' and ' || {tstxt(P_END)}
                   ELSE 'start: ' || coalesce(si, {tstxt(P_START)}) || '; end: ' || coalesce(ei, {tstxt(P_END)}) END AS i
       FROM se),
{segments('fuel_p')},
cs AS (SELECT vehicle_id, count(*) AS n, avg(liters / km * 100) AS l100, avg(amount_eur / km * 100) AS c100,
              avg(amount_eur / km) AS c1, bool_or(quality = 'estimated') AS anyest FROM seg GROUP BY 1),
cards AS (
  SELECT u.vehicle_id, 'fuel' AS section, 1 AS position, 'fuel_stops' AS metric, CAST(coalesce(ft.n, 0) AS DOUBLE) AS value,
         'count' AS unit, CASE WHEN coalesce(ft.n, 0) > 0 THEN 'exact' ELSE 'neutral' END AS tone, '' AS note
  FROM u LEFT JOIN ft USING (vehicle_id)
  UNION ALL SELECT vehicle_id, 'fuel', 2, 'fuel_purchased', l, 'L', 'exact', '' FROM ft
  UNION ALL SELECT vehicle_id, 'fuel', 3, 'fuel_spending', e, 'EUR', 'exact', '' FROM ft
  UNION ALL SELECT vehicle_id, 'fuel', 4, 'average_fuel_price', e / l, 'EUR/L', 'exact', '' FROM ft
  UNION ALL SELECT u.vehicle_id, 'distance', 1, 'observed_odometer_readings', CAST(coalesce(ob.n, 0) AS DOUBLE), 'count', 'exact', ''
  FROM u LEFT JOIN ob USING (vehicle_id)
  UNION ALL SELECT u.vehicle_id, 'distance', 2, 'observed_distance_driven', coalesce(ob.km, 0.0), 'km', 'exact', ''
  FROM u LEFT JOIN ob USING (vehicle_id)
  UNION ALL SELECT vehicle_id, 'distance', 3, 'estimated_overall_distance_driven', CASE WHEN insuf THEN NULL ELSE d END, 'km',
         CASE WHEN q = 'exact' THEN 'exact' ELSE 'estimated' END,
         CASE WHEN insuf THEN coalesce(i, 'Not enough odometer data is available for the selected period.')
              WHEN q = 'exact' THEN '' ELSE 'At least one report boundary required interpolation.' END FROM dx
  UNION ALL SELECT u.vehicle_id, 'estimated', 1, 'consumption_intervals', CAST(coalesce(cs.n, 0) AS DOUBLE), 'count',
         CASE WHEN cs.n IS NULL THEN 'neutral' WHEN cs.anyest THEN 'estimated' ELSE 'exact' END, ''
  FROM u LEFT JOIN cs USING (vehicle_id)
  UNION ALL SELECT vehicle_id, 'estimated', 2, 'average_consumption', l100, 'L/100km', CASE WHEN anyest THEN 'estimated' ELSE 'exact' END, '' FROM cs
  UNION ALL SELECT vehicle_id, 'estimated', 3, 'average_cost_per_100km', c100, 'EUR', CASE WHEN anyest THEN 'estimated' ELSE 'exact' END, '' FROM cs
  UNION ALL SELECT vehicle_id, 'estimated', 4, 'average_cost_per_km', c1, 'EUR', CASE WHEN anyest THEN 'estimated' ELSE 'exact' END, '' FROM cs)
SELECT vehicle_id, section, CAST(position AS INTEGER) AS position, metric, r6(value) AS value, unit, tone, note FROM cards"""

    q["summary_all"] = f"""WITH {FUEL}, {ODO},
u AS (SELECT vehicle_id FROM fuel UNION SELECT vehicle_id FROM odo),
ft AS (SELECT vehicle_id, count(*) AS n, sum(liters) AS l, sum(amount_eur) AS e FROM fuel GROUP BY 1),
ot AS (SELECT vehicle_id, count(*) AS n,
              CASE WHEN count(*) < 2 THEN 0.0 ELSE arg_max(odometer_km, event_ts) - arg_min(odometer_km, event_ts) END AS km
       FROM odo GROUP BY 1),
{segments()},
cs AS (SELECT vehicle_id, count(*) AS n, avg(liters / km * 100) AS l100, avg(amount_eur / km * 100) AS c100 FROM seg GROUP BY 1)
SELECT u.vehicle_id, CAST(coalesce(ft.n, 0) AS BIGINT) AS entries, r6(coalesce(ft.l, 0.0)) AS total_liters,
       r6(coalesce(ft.e, 0.0)) AS total_eur, r6(coalesce(ft.e / ft.l, 0.0)) AS avg_price_per_liter,
       CAST(coalesce(ot.n, 0) AS BIGINT) AS readings, r6(coalesce(ot.km, 0.0)) AS total_km,
       CAST(coalesce(cs.n, 0) AS BIGINT) AS segments, r6(cs.l100) AS avg_l_per_100km,
       r6(cs.c100) AS avg_cost_per_100km
FROM u LEFT JOIN ft USING (vehicle_id) LEFT JOIN ot USING (vehicle_id) LEFT JOIN cs USING (vehicle_id)"""

    q["analysis_metrics"] = f"""WITH {FUEL}, {ODO},
u AS (SELECT vehicle_id FROM fuel UNION SELECT vehicle_id FROM odo),
fuel_p AS (SELECT * FROM fuel WHERE event_ts BETWEEN {c_start} AND {c_end}),
ft AS (SELECT vehicle_id, count(*) AS n, sum(liters) AS l, sum(amount_eur) AS e FROM fuel_p GROUP BY 1),
{segments('fuel_p')},
cs AS (SELECT vehicle_id, avg(liters / km * 100) AS l100, avg(amount_eur / km * 100) AS c100 FROM seg GROUP BY 1)
SELECT u.vehicle_id, r6(coalesce(ft.l, 0.0)) AS total_liters, r6(coalesce(ft.e, 0.0)) AS total_eur,
       r6(coalesce(ft.e / ft.l, 0.0)) AS avg_price_per_liter, CAST(coalesce(ft.n, 0) AS BIGINT) AS entries,
       r6(cs.l100) AS avg_l_per_100km, r6(cs.c100) AS avg_cost_per_100km
FROM u LEFT JOIN ft USING (vehicle_id) LEFT JOIN cs USING (vehicle_id)"""

    q["analysis_payload"] = f"""WITH {FUEL}, {ODO},
u AS (SELECT vehicle_id FROM fuel UNION SELECT vehicle_id FROM odo),
fuel_p AS (SELECT * FROM fuel WHERE event_ts BETWEEN {c_start} AND {c_end}),
m AS (SELECT vehicle_id, CAST(date_diff('month', date_trunc('month', min(event_ts)), date_trunc('month', max(event_ts))) + 1 AS INTEGER) AS months,
             CAST(count(DISTINCT fuel_type) AS INTEGER) AS types, CAST(count(DISTINCT country) AS INTEGER) AS countries,
             CAST(count(*) AS BIGINT) AS n FROM fuel_p GROUP BY 1),
{segments('fuel_p')},
cs AS (SELECT vehicle_id, CAST(count(*) AS BIGINT) AS n FROM seg GROUP BY 1)
SELECT u.vehicle_id, 'custom' AS range, '2024-01-08T00:00:00' AS start, '2024-01-21T23:59:59' AS "end",
       coalesce(m.months, 0) AS n_price_trend, coalesce(m.months, 0) AS n_monthly_liters,
       coalesce(m.months, 0) AS n_monthly_spending, coalesce(m.types, 0) AS n_fuel_types,
       coalesce(m.countries, 0) AS n_countries, coalesce(cs.n, 0) AS n_consumption, coalesce(m.n, 0) AS entries
FROM u LEFT JOIN m USING (vehicle_id) LEFT JOIN cs USING (vehicle_id)"""

    # --- streaming (batch equivalents) ---------------------------------------
    q["stream_month_to_date"] = f"""WITH {FUEL}
SELECT vehicle_id, CAST(date_trunc('month', event_ts) AS TIMESTAMP) AS month, CAST(count(*) AS BIGINT) AS month_entries,
       r6(sum(liters)) AS month_liters, r6(sum(amount_eur)) AS month_eur
FROM fuel GROUP BY 1, 2"""

    q["stream_ingest"] = f"""WITH {DIRTY_PARSED}
SELECT row_num, ts AS event_ts, amount AS amount_eur, lit AS liters, ft AS fuel_type, tank AS is_full_tank,
       st AS station_name, ci AS city, co AS country FROM good"""
    # --- sources, stores, display and series -----------------------------------
    q["csv_round_trip"] = f"""WITH {DIRTY_PARSED}
SELECT ts AS event_ts, amount AS amount_eur, lit AS liters, ft AS fuel_type, tank AS is_full_tank,
       st AS station_name, ci AS city, co AS country FROM good"""

    place = """'part=' || (row_num % 3) AS file, CAST(1 + row_number() OVER (PARTITION BY row_num % 3 ORDER BY row_num) AS BIGINT) AS record"""
    q["csv_files"] = f"""WITH {DIRTY_PARSED}, placed AS (SELECT *, {place} FROM dp)
SELECT file, record, ts AS event_ts, amount AS amount_eur, lit AS liters, co AS country,
       CASE WHEN row_num % 3 = 1 AND row_num % 5 = 0 THEN 'say "one"' || chr(10) || 'and two,' ELSE '' END AS notes
FROM placed SEMI JOIN good USING (row_num)"""

    q["csv_file_issues"] = f"""WITH {ODO_DIRTY}, placed AS (SELECT row_num, {place} FROM dirty)
SELECT file, record, severity, rule, field, message FROM oi JOIN placed USING (row_num)"""

    q["csv_missing_columns"] = """SELECT 'fuel' AS dataset, 'error' AS severity, 'file' AS rule,
       'Missing required columns: [''city'', ''notes'']' AS message"""

    tied = f"""{EV}, {ODO_RAW},
tied AS (SELECT vehicle_id, CAST(date_trunc('day', event_ts) AS TIMESTAMP) AS event_ts, row_num % 3 AS row_num, odometer_km FROM odo_raw)"""
    q["tied_deltas"] = f"""WITH {tied}
SELECT vehicle_id, event_ts, row_num, odometer_km,
       r6(odometer_km - lag(odometer_km) OVER (PARTITION BY vehicle_id ORDER BY event_ts, row_num, odometer_km)) AS km_since_last_entry FROM tied"""

    q["tied_odometer_at"] = f"""WITH {FUEL}, {tied[len(EV) + 2:]},
ends AS (SELECT vehicle_id, event_ts, row_number() OVER up AS up, row_number() OVER down AS down, odometer_km FROM tied
         WINDOW up AS (PARTITION BY vehicle_id, event_ts ORDER BY row_num, odometer_km),
                down AS (PARTITION BY vehicle_id, event_ts ORDER BY row_num DESC, odometer_km DESC)),
firsts AS (SELECT * FROM ends WHERE up = 1), lasts AS (SELECT * FROM ends WHERE down = 1),
b AS (SELECT p.vehicle_id, p.row_num, p.event_ts, r.event_ts AS b_ts, r.odometer_km AS b_km
      FROM fuel p ASOF LEFT JOIN lasts r ON p.vehicle_id = r.vehicle_id AND p.event_ts > r.event_ts),
a AS (SELECT p.vehicle_id, p.row_num, r.event_ts AS a_ts, r.odometer_km AS a_km
      FROM fuel p ASOF LEFT JOIN firsts r ON p.vehicle_id = r.vehicle_id AND p.event_ts <= r.event_ts)
SELECT vehicle_id, event_ts, row_num,
  CASE WHEN a_ts = event_ts THEN r6(a_km) WHEN a_ts IS NOT NULL AND b_ts IS NOT NULL THEN
       r6(b_km + ((epoch_us(event_ts) - epoch_us(b_ts)) / 1e6) / ((epoch_us(a_ts) - epoch_us(b_ts)) / 1e6) * (a_km - b_km)) ELSE 0.0 END AS odometer_km,
  CASE WHEN a_ts = event_ts THEN 'exact' WHEN a_ts IS NOT NULL AND b_ts IS NOT NULL THEN 'estimated' ELSE 'insufficient' END AS quality,
  CASE WHEN a_ts = event_ts THEN 'exact match at ' || {tstxt('a_ts')}
       WHEN a_ts IS NOT NULL AND b_ts IS NOT NULL THEN {tstxt('b_ts')} || ' -> ' || {tstxt('a_ts')}
       WHEN a_ts IS NOT NULL THEN 'before first record (' || {tstxt('a_ts')} || ')'
       WHEN b_ts IS NOT NULL THEN 'after last record (' || {tstxt('b_ts')} || ')' END AS source_interval
FROM b JOIN a USING (vehicle_id, row_num)"""

    q["store_round_trip"] = f"""WITH {FUEL}
SELECT vehicle_id, row_num, event_ts, amount_eur, liters, price_per_liter_eur, city, is_full_tank
FROM fuel WHERE event_ts BETWEEN {P_START} AND {P_END}"""

    q["vehicle_reads"] = f"""WITH {FUEL}
SELECT vehicle_id, row_num, event_ts, amount_eur, liters FROM fuel WHERE vehicle_id IN (1, 7, 11)"""

    q["append_once"] = f"""WITH {DIRTY}, {plain}
SELECT vehicle_id, row_num, {ts_parse(strip('datetime'))} AS event_ts, a AS amount_eur, l AS liters, upper({strip('country')}) AS country,
       lower({strip('is_full_tank')}) AS is_full_tank FROM c WHERE len(errs) = 0"""

    q["fleet_overview"] = f"""WITH {LOG}, g AS (SELECT city, count(*) AS n, sum(liters) AS l, sum(amount_eur) AS e FROM log WHERE trim(city) <> '' GROUP BY 1)
SELECT city, CAST(n AS BIGINT) AS stops, r6(l) AS liters, r6(e) AS eur, r6(e / l) AS avg_price_per_liter,
       CAST(row_number() OVER (ORDER BY l DESC, n DESC, city) AS INTEGER) AS rank FROM g"""

    q["import_counts"] = f"""WITH {FUEL}, {ODO}
SELECT 'fuel' AS log, (SELECT CAST(count(*) AS BIGINT) FROM fuel WHERE vehicle_id NOT IN (SELECT vehicle_id FROM fuel WHERE event_ts < {lit_ts(IMPORT_CUTOFF)})) AS imported, CAST(0 AS BIGINT) AS imported_again
UNION ALL SELECT 'odometer', (SELECT CAST(count(*) AS BIGINT) FROM odo WHERE vehicle_id NOT IN (SELECT vehicle_id FROM odo WHERE event_ts < {lit_ts(IMPORT_CUTOFF)})), 0"""

    q["fuel_derived"] = f"""WITH {FUEL}
SELECT vehicle_id, row_num, price_per_liter_eur, liters * price_per_liter_eur AS computed_amount,
       strftime(event_ts, '%Y-%m') AS month_text, printf('%.1f', liters) AS liters_text FROM fuel"""

    q["location_table"] = f"""WITH {LOG}
SELECT vehicle_id, country AS "Country", CAST(count(*) AS BIGINT) AS "Stops", r6(sum(liters)) AS "Liters",
       r6(sum(amount_eur)) AS "EUR", r6(sum(amount_eur) / sum(liters)) AS "Avg_price" FROM log GROUP BY 1, 2"""

    q["consumption_series"] = f"""WITH {FUEL}, {ODO}, {segments()}
SELECT vehicle_id, row_num, event_ts AS datetime, r6(liters / km * 100) AS liters_per_100km, quality FROM seg"""

    q["payload_series"] = f"""WITH {FUEL}, {ODO},
fuel_p AS (SELECT * FROM fuel WHERE event_ts BETWEEN {c_start} AND {c_end}), {segments('fuel_p')},
m AS (SELECT vehicle_id, strftime(event_ts, '%Y-%m') AS label, sum(liters) AS l, sum(amount_eur) AS e, avg(price_per_liter_eur) AS p FROM fuel_p GROUP BY 1, 2)
SELECT vehicle_id, 'price_trend' AS series, label, r6(p) AS value FROM m
UNION ALL SELECT vehicle_id, 'monthly_liters', label, r6(l) FROM m
UNION ALL SELECT vehicle_id, 'monthly_spending', label, r6(e) FROM m
UNION ALL SELECT vehicle_id, 'fuel_type_summary', fuel_type, r6(sum(amount_eur)) FROM fuel_p GROUP BY 1, 3
UNION ALL SELECT vehicle_id, 'country_breakdown', country, r6(sum(amount_eur) / sum(liters)) FROM fuel_p GROUP BY 1, 3
UNION ALL SELECT vehicle_id, 'consumption_series', {isotxt('event_ts')}, r6(liters / km * 100) FROM seg"""

    q["report_sections"] = f"""WITH {FUEL}, {ODO},
fuel_p AS (SELECT * FROM fuel WHERE event_ts BETWEEN {P_START} AND {P_END}), {segments('fuel_p')},
d AS (SELECT *, odometer_km - lag(odometer_km) OVER (PARTITION BY vehicle_id ORDER BY event_ts, row_num) AS delta FROM odo),
o AS (SELECT * FROM d WHERE event_ts BETWEEN {P_START} AND {P_END})
SELECT vehicle_id, 'consumption' AS section, CAST(count(*) AS BIGINT) AS rows, r6(CAST(sum(CAST(km AS DECIMAL(28,9))) AS DOUBLE)) AS total FROM seg GROUP BY 1
UNION ALL SELECT vehicle_id, 'overview_fuel', count(*), r6(sum(liters)) FROM fuel_p GROUP BY 1
UNION ALL SELECT vehicle_id, 'overview_distance', count(*), r6(CAST(sum(CAST(delta AS DECIMAL(28,9))) AS DOUBLE)) FROM o WHERE delta IS NOT NULL GROUP BY 1
UNION ALL SELECT vehicle_id, 'price_over_time', count(*), r6(CAST(sum(CAST(price_per_liter_eur AS DECIMAL(28,9))) AS DOUBLE)) FROM fuel_p GROUP BY 1
UNION ALL SELECT vehicle_id, 'odometer_readings', count(*), r6(CAST(sum(CAST(odometer_km AS DECIMAL(28,9))) AS DOUBLE)) FROM o GROUP BY 1"""
    def long(source: str, part: str, label: str, names: dict[str, str], column: str = "section", extra: str = "") -> str:
        return "\n  UNION ALL ".join(
            f"SELECT vehicle_id, '{part}' AS {column}, {extra}CAST({label} AS VARCHAR) AS label, '{n}' AS name, r6(CAST({e} AS DOUBLE)) AS value FROM {source}"
            for n, e in names.items())

    months = f"""span AS (SELECT vehicle_id, unnest(generate_series(date_trunc('month', min(event_ts)), date_trunc('month', max(event_ts)), INTERVAL 1 MONTH)) AS m FROM fuel_p GROUP BY 1),
mon AS (SELECT s.vehicle_id, s.m, coalesce(CAST(sum(CAST(f.liters AS DECIMAL(28,9))) AS DOUBLE), 0.0) AS l, coalesce(CAST(sum(CAST(amount_eur AS DECIMAL(28,9))) AS DOUBLE), 0.0) AS e,
        CAST(sum(CAST(price_per_liter_eur AS DECIMAL(28,9))) AS DOUBLE) / count(price_per_liter_eur) AS p
        FROM span s LEFT JOIN fuel_p f ON f.vehicle_id = s.vehicle_id AND date_trunc('month', f.event_ts) = s.m GROUP BY 1, 2),
ty AS (SELECT vehicle_id, fuel_type, count(*) AS n, sum(liters) AS l, sum(amount_eur) AS e FROM fuel_p GROUP BY 1, 2),
co AS (SELECT vehicle_id, country, count(*) AS n, sum(liters) AS l, sum(amount_eur) AS e FROM fuel_p GROUP BY 1, 2)"""
    metrics = q["analysis_metrics"].split("\nSELECT u.vehicle_id")[0]
    am = metrics + f""",
am AS (SELECT u.vehicle_id, coalesce(ft.l, 0.0) AS l, coalesce(ft.e, 0.0) AS e, coalesce(ft.e / ft.l, 0.0) AS p, coalesce(ft.n, 0) AS n, cs.l100, cs.c100
       FROM u LEFT JOIN ft USING (vehicle_id) LEFT JOIN cs USING (vehicle_id)), {months},
vals AS ({long('am', 'metrics', "'2024-01-08 → 2024-01-21'", dict(total_liters='l', total_eur='e', avg_price_per_liter='p', entries='n', avg_l_per_100km='l100', avg_cost_per_100km='c100'), 'part')}
  UNION ALL {long('mon', 'price_trend', "strftime(m, '%Y-%m')", dict(avg_price_per_liter='p'), 'part')}
  UNION ALL {long('mon', 'monthly_liters', "strftime(m, '%Y-%m')", dict(value='l'), 'part')}
  UNION ALL {long('mon', 'monthly_spending', "strftime(m, '%Y-%m')", dict(value='e'), 'part')}
  UNION ALL {long('ty', 'fuel_type_summary', 'fuel_type', dict(count='n', total_liters='l', total_eur='e'), 'part')}
  UNION ALL {long('co', 'country_breakdown', 'country', dict(avg_price_per_liter='e / l', total_liters='l'), 'part')})"""
    q["payload_values"] = am + """
SELECT vehicle_id, part, CAST(CASE WHEN part = 'metrics' THEN 0 ELSE dense_rank() OVER (PARTITION BY vehicle_id, part ORDER BY label) - 1 END AS INTEGER) AS place,
       label, name, value FROM vals"""

    q["payload_chunks"] = f"""WITH {FUEL}, {ODO},
fuel_p AS (SELECT * FROM fuel WHERE event_ts BETWEEN {c_start} AND {c_end}), {segments('fuel_p')},
n AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY event_ts, row_num) - 1 AS pos FROM seg)
SELECT vehicle_id, CAST(pos // 7 AS BIGINT) AS chunk, CAST(count(*) OVER (PARTITION BY vehicle_id, pos // 7) AS INTEGER) AS size, CAST(pos % 7 AS INTEGER) AS place,
       event_ts AS datetime, row_num, r6(liters / km * 100) AS liters_per_100km, quality FROM n"""

    cards = q["report_cards"].split("\nSELECT vehicle_id, section")[0]
    ranked = lambda by: f"""(SELECT vehicle_id, {by}, count(*) AS n, sum(liters) AS l, sum(amount_eur) AS e,
      row_number() OVER (PARTITION BY vehicle_id ORDER BY sum(liters) DESC, count(*) DESC, {by}) AS rank FROM fuel_p GROUP BY vehicle_id, {by})"""  # noqa: E731
    over = dict(stops='n', liters='l', eur='e', avg_price_per_liter='e / l', rank='rank')
    default = """coalesce(est_interval, CASE est_quality WHEN 'insufficient' THEN 'Not enough odometer data.' WHEN 'exact' THEN 'Exact reading.' ELSE 'Estimated by interpolation.' END)"""
    q["report_rows"] = cards + f""", {months},
share AS (SELECT *, 100.0 * n / sum(n) OVER w AS sn, 100.0 * l / sum(l) OVER w AS sl, 100.0 * e / sum(e) OVER w AS se_ FROM ty WINDOW w AS (PARTITION BY vehicle_id)),
d AS (SELECT *, odometer_km - lag(odometer_km) OVER (PARTITION BY vehicle_id ORDER BY event_ts, row_num) AS delta FROM odo),
o AS (SELECT * FROM d WHERE event_ts BETWEEN {P_START} AND {P_END})
  SELECT vehicle_id, section || '_cards' AS section, metric AS label, 'value' AS name, r6(value) AS value FROM cards
  UNION ALL SELECT vehicle_id, 'boundaries', CASE row_num WHEN 0 THEN 'Start of report' ELSE 'End of report' END || ': ' || est_quality || ': ' || {default},
      'odometer_km', CASE WHEN est_quality = 'insufficient' THEN NULL ELSE r6(est_value) END FROM be
  UNION ALL {long('seg', 'consumption', 'row_num', dict(estimated_km='km', liters_per_100km='liters / km * 100', cost_per_100km='amount_eur / km * 100', cost_per_km='amount_eur / km'))}
  UNION ALL {long('fuel_p', 'overview_fuel', 'row_num', dict(liters='liters'))}
  UNION ALL {long('(SELECT * FROM o WHERE delta IS NOT NULL)', 'overview_distance', 'row_num', dict(km_since_last_entry='delta'))}
  UNION ALL {long('fuel_p', 'price_over_time', 'row_num', dict(price_per_liter_eur='price_per_liter_eur'))}
  UNION ALL {long('mon', 'monthly_liters', "strftime(last_day(m), '%Y-%m-%d')", dict(liters='l'))}
  UNION ALL {long('mon', 'monthly_spending', "strftime(last_day(m), '%Y-%m-%d')", dict(amount_eur='e'))}
  UNION ALL {long('ty', 'fuel_type_summary', 'fuel_type', dict(count='n', total_liters='l', total_eur='e'))}
  UNION ALL {long('share', 'fuel_type_share', 'fuel_type', dict(stops_share_pct='sn', liters_share_pct='sl', eur_share_pct='se_'))}
  UNION ALL {long(ranked('country'), 'country_overview', 'country', over)}
  UNION ALL {long(ranked('city'), 'city_overview', 'city', over)}
  UNION ALL {long('o', 'odometer_readings', 'row_num', dict(odometer_km='odometer_km', km_since_previous='delta'))}"""

    # every pair spelled out: what the report must count
    q["report_issue_counts"] = f"""WITH {DIRTY},
raw AS (SELECT vehicle_id % 5 AS v, row_num, {ts_parse(strip('datetime'))} AS ts FROM dirty)
SELECT 'odometer' AS dataset, 'error' AS severity, CAST(count(*) AS BIGINT) AS issues FROM raw WHERE ts IS NULL HAVING count(*) > 0
UNION ALL SELECT 'odometer', 'warning', CAST(count(*) AS BIGINT) FROM raw a JOIN raw b ON a.v = b.v AND a.row_num < b.row_num
  AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= {TOL_US}"""
    return {name: _expand_r6(_exact_sums(sql)) for name, sql in q.items()}
