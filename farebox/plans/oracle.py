"""DuckDB twins of the registered queries (the correctness oracle).

Each query is plain SQL over the driver's pre-registered tables. The rules
are written on their own: the global ``row_number()`` split, the
``row_number()`` mode, the as-of lookups, the two-pass R² and the fixed values
below. Only the tables that the stand-in inputs are made of (stations, venues
and their bodies) come from the library.
"""

from __future__ import annotations

from farebox.sources.dimensions import station_rows

# Fixed values, written out once more on purpose.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
             "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday"]
WEEKENDS = ["saturday", "sunday"]
CHOSEN = [("KovZpZAFFE1A", 20000), ("KovZpZAEkkIA", 17000), ("KovZpa3Bbe", 40000), ("KovZpZAE77aA", 30000),
          ("KovZpZAEdJIA", 12500), ("KovZpZAFFEJA", 3200), ("KovZpZAFnlnA", 2800), ("KovZpZAJt7FA", 9000)]
COLOURS = [("1", "#ffd700"), ("2", "#008000"), ("4", "#800080")]
RULE = "Mon–Fri 06:00–01:30; Sat–Sun 08:00–01:30 (next day)."


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return ", ".join(_q(v) for v in values)


def strip(c: str) -> str:
    return f"regexp_replace({c}, '\\A\\s+|\\s+\\z', '', 'g')"


def nulltok(c: str) -> str:
    return f"CASE WHEN {c} IN ({_list(NA_TOKENS)}) THEN NULL ELSE {c} END"


def number(c: str) -> str:
    shape = "[+-]?([0-9]+[.]?[0-9]*([eE][+-]?[0-9]+)?|[.][0-9]+([eE][+-]?[0-9]+)?|(?i:inf|infinity))"
    return f"CASE WHEN regexp_full_match(trim({c}), '{shape}') THEN try_cast(trim({c}) AS DOUBLE) END"


def open_train(day="day", hour="hour", minute="minute") -> str:
    m = f"coalesce({minute}, 0)" if minute else "0"
    return (f"coalesce((({hour} >= CASE WHEN {day} IN ({_list(WEEKDAYS)}) THEN 6 ELSE 8 END"
            f" AND {hour} <= 23) OR {hour} = 0 OR ({hour} = 1 AND {m} <= 30)), false)")


def open_serve(day="day", hour="hour") -> str:
    return (f"coalesce((({hour} >= CASE WHEN {day} IN ({_list(WEEKENDS)}) THEN 8 ELSE 6 END"
            f" AND {hour} <= 23) OR {hour} IN (0, 1)), false)")


def _stations_values() -> str:
    return ", ".join(f"({i}, {_q(name)}, {_q(line)})"
                     for i, (name, line, _a, _b) in enumerate(station_rows()))


def cte_raw(station: str = "station") -> str:
    """The observation stand-in (rows only) with missing tokens nulled."""
    n = len(station_rows())
    return f"""
st(idx, st_name, st_line) AS (VALUES {_stations_values()}),
raw0 AS (
  SELECT e.event_id AS obs_id,
    CASE WHEN e.event_id % 4 = 0 THEN concat('  ', st_name, ' ')
         WHEN e.event_id % 89 = 0 THEN upper(st_name)
         ELSE st_name END AS station,
    CASE WHEN e.event_id % 83 = 0 THEN 'NA'
         WHEN e.event_id % 7 = 0 THEN concat(' ', st_line)
         WHEN e.event_id % 11 = 0 THEN concat(st_line, chr(9))
         WHEN e.user_id % 10 = 0 THEN '4'
         ELSE st_line END AS line,
    CASE WHEN e.event_id % 97 = 0 THEN NULL
         WHEN e.event_id % 101 = 0 THEN 'Holiday'
         WHEN e.event_id % 5 = 0 THEN concat(' ', upper(dayname(e.ts)), ' ')
         WHEN e.event_id % 5 = 1 THEN lower(dayname(e.ts))
         ELSE dayname(e.ts) END AS day,
    CASE WHEN e.event_id % 79 = 0 THEN NULL
         WHEN e.event_id % 131 = 0 THEN 'n/a'
         WHEN hour(e.ts) = 0 AND e.event_id % 2 = 0 THEN '24'
         ELSE cast(hour(e.ts) AS VARCHAR) END AS hour,
    CASE WHEN e.event_id % 103 = 0 THEN NULL
         ELSE cast(cast(e.value AS DECIMAL(18,2)) AS VARCHAR) END AS riders,
    cast(cast(e.ts AS DATE) AS VARCHAR) AS date
  FROM events e JOIN st ON e.user_id % {n} = st.idx),
raw AS (
  SELECT obs_id, {nulltok(station)} AS station, {nulltok('line')} AS line,
         {nulltok('day')} AS day, {nulltok('hour')} AS hour,
         {nulltok('riders')} AS riders, {nulltok('date')} AS date
  FROM raw0)"""


def cte_obs() -> str:
    """Cleaning + null-hour drop -> ``obs``; mask + fallback -> ``kept``."""
    return f"""
norm0 AS (
  SELECT *, {number('hour')} AS h,
         {strip('lower(day)')} AS dn
  FROM raw),
norm AS (
  SELECT cast(obs_id AS BIGINT) AS obs_id, {strip('station')} AS station,
         {strip('line')} AS line, dn AS day,
         CASE WHEN h = 24 THEN 0 ELSE h END AS hour,
         0 AS minute,
         CASE WHEN dn IN ({_list(WEEKENDS)}) THEN 1 ELSE 0 END AS is_weekend,
         {number('riders')} AS riders,
         try_cast(date AS DATE) AS service_date
  FROM norm0),
obs AS (SELECT * FROM norm WHERE hour IS NOT NULL),
mask_n AS (SELECT count_if({open_train()}) AS n_open FROM obs),
kept AS (
  SELECT obs.* FROM obs, mask_n
  WHERE CASE WHEN mask_n.n_open > 0 THEN {open_train()} ELSE hour BETWEEN 0 AND 23 END)"""


def cte_split() -> str:
    """Exact split by global row_number over (md5 key, id) -> ``split``."""
    return """
split_keyed AS (SELECT *, md5(concat('42|', cast(obs_id AS VARCHAR))) AS split_k FROM kept),
split_ranked AS (SELECT *, row_number() OVER (ORDER BY split_k, obs_id) AS split_rn,
                        count(*) OVER () AS split_n FROM split_keyed),
split AS (SELECT * EXCLUDE (split_k, split_rn, split_n),
                 split_rn <= ceil(0.2::DOUBLE * split_n) AS is_test FROM split_ranked)"""


def cte_baseline() -> str:
    """Modes of the train part, filled train part, cell means, global mean."""
    return """
train AS (SELECT * FROM split WHERE NOT is_test),
cat_long AS (
  SELECT 'station' AS col, station AS val FROM train UNION ALL
  SELECT 'line', line FROM train UNION ALL
  SELECT 'day', day FROM train),
cat_counts AS (SELECT col, val, count(*) AS cnt FROM cat_long WHERE val IS NOT NULL GROUP BY col, val),
modes AS (
  SELECT col, val FROM (
    SELECT col, val, row_number() OVER (PARTITION BY col ORDER BY cnt DESC, val) AS rn
    FROM cat_counts) WHERE rn = 1),
filled_train AS (
  SELECT * REPLACE (
    coalesce(station, (SELECT val FROM modes WHERE col = 'station')) AS station,
    coalesce(line, (SELECT val FROM modes WHERE col = 'line')) AS line,
    coalesce(day, (SELECT val FROM modes WHERE col = 'day')) AS day)
  FROM train),
cell_means AS (
  SELECT station, line, day, hour, cast(sum(riders) AS DOUBLE) / count(riders) AS cell_mean
  FROM filled_train WHERE riders IS NOT NULL GROUP BY station, line, day, hour),
global_mean AS (
  SELECT cast(sum(riders) AS DOUBLE) / count(riders) AS g FROM filled_train WHERE riders IS NOT NULL)"""


def fill_expr(c: str) -> str:
    return f"coalesce({c}, (SELECT val FROM modes WHERE col = '{c}'))"


def predict_join(src: str, alias: str = "s") -> str:
    """FROM-clause fragment: ``src`` left-joined to the cell means."""
    return (f"{src} {alias} LEFT JOIN cell_means cm ON {alias}.station = cm.station AND "
            f"{alias}.line = cm.line AND {alias}.day = cm.day AND {alias}.hour = cm.hour")


PREDICTION = "coalesce(cm.cell_mean, (SELECT g FROM global_mean))"
SHOWN = f"round({PREDICTION}, 6) + 0.0::DOUBLE"


def with_ctes(*parts: str, body: str) -> str:
    return "WITH " + ",".join(p.strip("\n") for p in parts) + "\n" + body


def _front(*extra: str) -> tuple[str, ...]:
    return (cte_raw(), cte_obs(), *extra)


ORACLE: dict[str, str] = {}

ORACLE["hourly_profile_24h"] = with_ctes(*_front(cte_split(), cte_baseline(), """
combos AS (SELECT DISTINCT station, line, day FROM filled_train),
grid AS (SELECT station, line, day, cast(unnest(range(0, 24)) AS INTEGER) AS hour FROM combos)"""),
    body=f"""
SELECT s.station, s.line, s.day, s.hour, {open_serve('s.day', 's.hour')} AS is_open,
       CASE WHEN {open_serve('s.day', 's.hour')} THEN {SHOWN} ELSE 0.0::DOUBLE END AS riders
FROM {predict_join('grid')}""")

ORACLE["open_hours_profile"] = with_ctes(*_front(cte_split(), cte_baseline(), f"""
combos AS (SELECT DISTINCT station, line, day FROM filled_train),
grid0 AS (
  SELECT station, line, day,
         unnest(list_concat(range(CASE WHEN lower(day) IN ({_list(WEEKDAYS)}) THEN 6 ELSE 8 END, 24),
                            [0, 1])) AS hour
  FROM combos),
grid AS (SELECT station, line, day, cast(hour AS INTEGER) AS hour FROM grid0
         WHERE {open_train('day', 'hour', None)})"""),
    body=f"""
SELECT s.station, s.line, s.day, s.hour, {SHOWN} AS riders,
       concat(s.station, ' — Estimated riders by hour (',
              upper(left(s.day, 1)), lower(substr(s.day, 2)), ')') AS title
FROM {predict_join('grid')}""")

ORACLE["clean_observations"] = with_ctes(*_front(), body="SELECT * FROM obs")

ORACLE["service_filtered"] = with_ctes(*_front(), body="SELECT * FROM kept")

ORACLE["closed_hours_fallback"] = with_ctes(*_front(), body=f"""
SELECT * FROM obs WHERE NOT {open_train()} AND hour BETWEEN 0 AND 23""")

ORACLE["service_mask_counts"] = with_ctes(*_front(), body=f"""
SELECT n_before, n_open,
       CASE WHEN n_open > 0 THEN n_open ELSE n_in_range END AS n_after,
       n_open = 0 AS fallback_used
FROM (SELECT count(*) AS n_before, cast(count_if({open_train()}) AS BIGINT) AS n_open,
             cast(count_if(hour BETWEEN 0 AND 23) AS BIGINT) AS n_in_range FROM obs)""")

ORACLE["open_hours"] = with_ctes(*_front(), body="SELECT DISTINCT hour FROM kept")

ORACLE["service_hours_by_day"] = with_ctes(*_front(), body=f"""
SELECT day, hour, open_train, open_serve FROM (
  SELECT day, hour, {open_train('day', 'hour', None)} AS open_train,
         {open_serve('day', 'hour')} AS open_serve
  FROM (SELECT day, cast(unnest(range(0, 24)) AS INTEGER) AS hour
        FROM (SELECT DISTINCT day FROM obs WHERE day IS NOT NULL)))
WHERE open_train OR open_serve""")

ORACLE["minute_service"] = f"""
SELECT event_id, day, hour, minute, {open_train()} AS open_train, {open_serve()} AS open_serve
FROM (SELECT event_id, lower(dayname(ts)) AS day, cast(hour(ts) AS INTEGER) AS hour, cast(minute(ts) AS INTEGER) AS minute FROM events)"""

ORACLE["empty_input_refused"] = with_ctes(*_front(), body="""
SELECT 'out of range' AS input, count(*) = 0 AS refused FROM obs WHERE hour + 100 BETWEEN 0 AND 23
UNION ALL SELECT 'all', count(*) = 0 FROM kept""")

ORACLE["split_exact"] = with_ctes(*_front(cte_split()), body="SELECT obs_id, is_test FROM split")

ORACLE["split_bucket"] = with_ctes(*_front(), body="""
SELECT obs_id,
  (('0x' || substr(md5(concat('42|', cast(obs_id AS VARCHAR))), 1, 8))::BIGINT % 100) < 20 AS is_test
FROM kept""")



def cte_metrics() -> str:
    """Baseline hold-out metrics, in a second pass around the label's mean -> ``metrics``."""
    return f"""
test AS (SELECT * FROM split WHERE is_test),
scored AS (
  SELECT s.riders AS y, {PREDICTION} AS p
  FROM (SELECT * REPLACE ({fill_expr('station')} AS station, {fill_expr('line')} AS line,
                          {fill_expr('day')} AS day) FROM test) s
  LEFT JOIN cell_means cm ON s.station = cm.station AND s.line = cm.line
       AND s.day = cm.day AND s.hour = cm.hour),
both AS (SELECT y, p, (SELECT avg(y) FROM scored WHERE y IS NOT NULL AND p IS NOT NULL) AS m
         FROM scored WHERE y IS NOT NULL AND p IS NOT NULL),
metrics AS (
  SELECT count(*) AS n,
       round(CASE WHEN count(DISTINCT y) = 1 THEN (CASE WHEN max(abs(y - p)) = 0 THEN 1.0 ELSE 0.0 END)
                  ELSE 1.0 - sum((y - p) * (y - p)) / sum((y - m) * (y - m)) END, 6) + 0.0::DOUBLE AS r2,
       round(sqrt(avg((y - p) * (y - p))), 6) + 0.0::DOUBLE AS rmse,
       round(avg(abs(y - p)), 6) + 0.0::DOUBLE AS mae
  FROM both)""".replace("both", "judged")


ORACLE["baseline_holdout_metrics"] = with_ctes(*_front(cte_split(), cte_baseline(), cte_metrics()), body="""
SELECT (SELECT cast(count_if(NOT is_test) AS BIGINT) FROM split) AS n_train,
       (SELECT cast(count_if(is_test) AS BIGINT) FROM split) AS n_test,
       n AS n_scored, r2, rmse, mae
FROM metrics""")

ORACLE["typical_line"] = with_ctes(*_front(cte_split(), """
train AS (SELECT * FROM split WHERE NOT is_test),
keyed AS (SELECT lower(""" + strip("station") + """) AS station_key, line FROM train),
per_station AS (
  SELECT station_key, line FROM (
    SELECT station_key, line, row_number() OVER (
      PARTITION BY station_key ORDER BY line IS NULL, cnt DESC, line) AS rn
    FROM (SELECT station_key, line, count(*) AS cnt FROM keyed
          WHERE station_key IS NOT NULL GROUP BY station_key, line))
  WHERE rn = 1),
overall AS (
  SELECT line FROM (SELECT line, count(*) AS cnt FROM keyed WHERE line IS NOT NULL GROUP BY line)
  ORDER BY cnt DESC, line LIMIT 1)"""), body="""
SELECT station_key, coalesce(line, (SELECT line FROM overall)) AS line, line IS NULL AS is_fallback
FROM per_station""")


def cte_options() -> str:
    return f"""
opt_found AS (
  SELECT DISTINCT kind, value FROM (
    SELECT 'day' AS kind, {strip('lower(day)')} AS value FROM raw UNION ALL
    SELECT 'station', {strip('station')} FROM raw UNION ALL
    SELECT 'line', {strip('line')} FROM raw)
  WHERE value IS NOT NULL)"""


ORACLE["options_long"] = with_ctes(cte_raw(), cte_options(), body="""
SELECT kind, value FROM opt_found
UNION ALL SELECT 'hour', cast(range AS VARCHAR) FROM range(0, 24)""")

ORACLE["options_listing"] = with_ctes(cte_raw(), cte_options(), body="""
SELECT cast(range(0, 24) AS INTEGER[]) AS hours,
  coalesce((SELECT list_sort(list(value)) FROM opt_found WHERE kind = 'day'), []::VARCHAR[]) AS days,
  coalesce((SELECT list_sort(list(value)) FROM opt_found WHERE kind = 'station'), []::VARCHAR[]) AS stations,
  coalesce((SELECT list_sort(list(value)) FROM opt_found WHERE kind = 'line'), []::VARCHAR[]) AS lines""")

ORACLE["csv_clean_observations"] = with_ctes(*_front(), body="SELECT * EXCLUDE (obs_id, service_date) FROM obs")
QUOTED_STATION = ("CASE WHEN obs_id % 3 = 0 THEN station || chr(10) || chr(10) || '\"upper\", level, ' || day || chr(10) || '\",'"
                  " ELSE station END")
ORACLE["csv_quoted_observations"] = with_ctes(cte_raw(QUOTED_STATION), cte_obs(), body="SELECT * EXCLUDE (obs_id, service_date) FROM obs")
ORACLE["csv_options_long"] = ORACLE["options_long"]


def cte_requests() -> str:
    """The request stand-in (rows only), then parse + validate -> ``checked``."""
    n = len(station_rows())
    from farebox.sources.requests import TYPED_RECORDS
    return f"""
rq_st(idx, st_name, st_line) AS (VALUES {_stations_values()}),
rq_recs AS (
  SELECT e.event_id // 4 AS request_id, e.event_id,
    concat('{{',
      CASE WHEN e.event_id % 19 = 0 THEN ''
           ELSE concat('"station":"', CASE WHEN e.event_id % 5 = 0 THEN concat(' ', st_name, ' ')
                                          ELSE st_name END, '",') END,
      '"line":"', CASE WHEN e.event_id % 31 = 0 THEN '9' ELSE st_line END,
      '","day":"', CASE WHEN e.event_id % 3 = 0 THEN concat(upper(dayname(e.ts)), ' ')
                        WHEN e.event_id % 23 = 0 THEN 'Holiday' ELSE dayname(e.ts) END,
      '","hour":', CASE WHEN e.event_id % 13 = 0 THEN concat('"', e.hn, '"')
                        WHEN e.event_id % 17 = 0 THEN concat(e.hn, '.5') ELSE e.hn END,
      '}}') AS rec
  FROM (SELECT *, cast(CASE WHEN event_id % 29 = 0 THEN 24 ELSE hour(ts) END AS VARCHAR) AS hn
        FROM events) e
  JOIN rq_st ON e.user_id % {n} = rq_st.idx),
rq_grouped AS (
  SELECT request_id, string_agg(rec, ',' ORDER BY event_id) AS joined,
         arg_min(rec, event_id) AS first_rec
  FROM rq_recs GROUP BY request_id),
requests AS (
  SELECT request_id, concat('{{"records": [', joined, ']}}') AS body FROM rq_grouped WHERE request_id % 10 <> 3
  UNION ALL SELECT 1000000000000 + event_id, concat('{{"records": ', rec, '}}') FROM rq_recs WHERE request_id % 10 = 3
  UNION ALL SELECT -(request_id * 4) - 1, concat('{{"records": [', first_rec) FROM rq_grouped WHERE request_id % 10 = 7
  UNION ALL SELECT -(request_id * 4 + 1) - 1, '{{"records": []}}' FROM rq_grouped WHERE request_id % 50 = 11
  UNION ALL SELECT -(request_id * 4 + 2) - 1, concat('{{"records": [', first_rec, ']}} trailing')
            FROM rq_grouped WHERE request_id % 20 = 2
  UNION ALL SELECT -(request_id * 4 + 3) - 1, {_q('{"records": [' + ",".join(TYPED_RECORDS) + "]}")}
            FROM rq_grouped WHERE request_id % 20 = 4),
rq_parsed AS (
  SELECT request_id,
    CASE WHEN NOT json_valid(body) THEN NULL
         WHEN json_type(body, '$.records') = 'OBJECT' THEN [json_extract(body, '$.records')]
         WHEN json_type(body, '$.records') = 'ARRAY' THEN json_extract(body, '$.records[*]') END AS recs
  FROM requests),
rq_records AS (
  SELECT request_id, cast(pos0 - 1 AS INTEGER) AS pos, true AS body_ok, r
  FROM (SELECT request_id, generate_subscripts(recs, 1) AS pos0, unnest(recs) AS r
        FROM rq_parsed WHERE recs IS NOT NULL)
  UNION ALL
  SELECT request_id, -1, false, NULL FROM rq_parsed WHERE recs IS NULL),
rq_typed AS (
  SELECT request_id, pos, body_ok, coalesce(json_type(r) = 'OBJECT', false) AS is_object,
    {", ".join(f"coalesce(json_type(r, '$.{c}'), 'NULL') AS {c}_type, json_extract_string(r, '$.{c}') AS {c}_text"
               for c in ("station", "line", "day", "hour"))}
  FROM rq_records),
rq_hours AS (
  SELECT *, CASE WHEN hd = floor(hd) AND abs(hd) < 2147483648.0 THEN cast(hd AS INTEGER) END AS hour
  FROM (SELECT *, CASE WHEN hour_type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN try_cast(hour_text AS DOUBLE)
                       WHEN hour_type = 'BOOLEAN' THEN CASE WHEN hour_text = 'true' THEN 1 ELSE 0 END
                       WHEN hour_type = 'VARCHAR' AND regexp_full_match(trim(hour_text), '[+-]?[0-9]+([.]0+)?')
                       THEN try_cast(trim(hour_text) AS DOUBLE) END AS hd FROM rq_typed)),
checked0 AS (
  SELECT *,
    CASE WHEN NOT body_ok THEN 'invalid body'
         WHEN NOT is_object THEN 'record is not an object'
         WHEN station_type = 'NULL' THEN 'missing station' WHEN station_type <> 'VARCHAR' THEN 'station is not text'
         WHEN line_type = 'NULL' THEN 'missing line' WHEN line_type <> 'VARCHAR' THEN 'line is not text'
         WHEN day_type = 'NULL' THEN 'missing day' WHEN day_type <> 'VARCHAR' THEN 'day is not text'
         WHEN hour_type = 'NULL' THEN 'missing hour'
         WHEN hour IS NULL THEN 'hour is not an integer' END AS reason
  FROM rq_hours),
checked AS (
  SELECT *, station_text AS station, line_text AS line, day_text AS day,
    CASE WHEN reason IS NOT NULL THEN reason WHEN NOT (hour BETWEEN 0 AND 23) THEN 'hour out of range' END AS strict_reason
  FROM checked0),
rq_valid AS (
  SELECT request_id, pos, {strip('station')} AS station, {strip('line')} AS line,
         {strip('lower(day)')} AS day, hour
  FROM checked WHERE reason IS NULL)"""


MODEL_VERSION_SQL = "strftime(TIMESTAMP '2024-02-01 12:46:00', 'v%Y.%m.%d.%H%M')"

ORACLE["scored_requests"] = with_ctes(*_front(cte_split(), cte_baseline(), cte_requests()), body=f"""
SELECT s.request_id, s.pos, s.station, s.line, s.hour, s.day,
       CASE WHEN {open_serve('s.day', 's.hour')} THEN {SHOWN} ELSE 0.0::DOUBLE END AS riders,
       {MODEL_VERSION_SQL} AS model_version
FROM (SELECT * REPLACE ({fill_expr('station')} AS station, {fill_expr('line')} AS line,
                        {fill_expr('day')} AS day) FROM rq_valid) s
LEFT JOIN cell_means cm ON s.station = cm.station AND s.line = cm.line
     AND s.day = cm.day AND s.hour = cm.hour""")

ORACLE["rejected_records"] = with_ctes(cte_requests(), body="""
SELECT request_id, pos, reason FROM checked WHERE reason IS NOT NULL""")

ORACLE["rejected_records_strict"] = with_ctes(cte_requests(), body="""
SELECT request_id, pos, strict_reason AS reason FROM checked WHERE strict_reason IS NOT NULL""")

ORACLE["unknown_request_categories"] = with_ctes(
    *_front(cte_split(), cte_baseline(), cte_requests(), """
vocab AS (
  SELECT DISTINCT feature, value FROM (
    SELECT 'station' AS feature, station AS value FROM filled_train UNION ALL
    SELECT 'line', line FROM filled_train UNION ALL
    SELECT 'day', day FROM filled_train) WHERE value IS NOT NULL),
rq_long AS (
  SELECT request_id, pos, 'station' AS feature, station AS value FROM rq_valid UNION ALL
  SELECT request_id, pos, 'line', line FROM rq_valid UNION ALL
  SELECT request_id, pos, 'day', day FROM rq_valid)"""), body="""
SELECT r.request_id, r.pos, r.feature, r.value FROM rq_long r
WHERE NOT EXISTS (SELECT 1 FROM vocab v WHERE v.feature = r.feature AND v.value = r.value)""")


def _venue_values() -> str:
    return ", ".join(f"({_q(v)}, {c})" for v, c in CHOSEN)


def _venue_json_values() -> str:
    from farebox.sources.dimensions import VENUE_COORDS, VENUES
    from farebox.sources.payloads import OTHER_VENUE
    coords = {name: (lat, lon) for name, lat, lon in VENUE_COORDS}
    rows = []
    for i, (vid, name, _cap) in enumerate(VENUES + [OTHER_VENUE + (0,)]):
        loc = ""
        if name in coords:
            lat, lon = coords[name]
            loc = f',"location":{{"latitude":"{lat}","longitude":"{lon}"}}'
        rows.append(f"({i}, {_q('{' + f'\"id\":\"{vid}\",\"name\":\"{name}\"' + loc + '}')})")
    return ", ".join(rows)


def cte_context() -> str:
    from farebox.sources.dimensions import VENUES
    from farebox.sources.payloads import CONDITIONS, EVENT_PAGE_IDS
    ev_type = ('[{"id":"VARCHAR","name":"VARCHAR","dates":{"start":{"localDate":"VARCHAR",'
               '"localTime":"VARCHAR"}},"_embedded":{"venues":[{"id":"VARCHAR","name":"VARCHAR",'
               '"location":{"latitude":"VARCHAR","longitude":"VARCHAR"}}]}}]')
    conds = "[" + _list(CONDITIONS) + "]"
    nv = len(VENUES) + 1
    return f"""
venues_dim(venue_id, capacity) AS (VALUES {_venue_values()}),
w_land AS (
  SELECT ts AS fetched_at, 200 AS status,
    concat('{{"location":{{"name":"Metro"}},"current":{{"temp_c":', cast(cast(value AS DECIMAL(18,2)) - 15 AS VARCHAR),
           ',"condition":{{"text":"', ({conds})[user_id % {len(CONDITIONS)} + 1], '"}}}}}}') AS body
  FROM events
  UNION ALL
  SELECT ts, 500, '{{"error":{{"code":1006,"message":"No matching location found."}}}}' FROM events WHERE event_id % 13 = 0),
readings AS (
  SELECT fetched_at, try_cast(json_extract_string(body, '$.current.temp_c') AS DOUBLE) AS temp_c,
         json_extract_string(body, '$.current.condition.text') AS condition
  FROM w_land WHERE status = 200),
ev_venue(v_idx, venue_json) AS (VALUES {_venue_json_values()}),
ev_rows AS (
  SELECT cast(e.ts AS DATE) AS d, e.event_id // {EVENT_PAGE_IDS} AS page, e.ts, e.event_id,
    concat('{{"id":"E', cast(e.event_id AS VARCHAR), '",',
      CASE WHEN e.event_id % 17 = 0 THEN ''
           ELSE concat('"dates":{{"start":{{"localDate":"', cast(cast(e.ts AS DATE) AS VARCHAR),
                       '","localTime":"', strftime(e.ts, '%H:%M:%S'), '"}}}},') END,
      CASE WHEN e.event_id % 23 = 0 THEN ''
           WHEN e.event_id % 19 = 0 THEN '"_embedded":{{"venues":[]}},'
           ELSE concat('"_embedded":{{"venues":[', venue_json, ']}},') END,
      '"name":"Event ', cast(e.event_id AS VARCHAR), '"}}') AS ev
  FROM events e JOIN ev_venue ON e.user_id % {nv} = ev_venue.v_idx),
ev_pages AS (
  SELECT d, page, min(ts) AS fetched_at, string_agg(ev, ',' ORDER BY event_id) AS evs
  FROM ev_rows GROUP BY d, page),
e_land AS (
  SELECT fetched_at, 200 AS status, concat('{{"_embedded":{{"events":[', evs, ']}},"page":{{"number":',
                                           cast(page AS VARCHAR), '}}}}') AS body FROM ev_pages
  UNION ALL SELECT fetched_at, 200, '{{}}' FROM ev_pages WHERE page % 7 = 3
  UNION ALL SELECT fetched_at, 500, '{{"errors":[{{"code":"SERVER_ERROR"}}]}}' FROM ev_pages WHERE page % 11 = 5),
ev_flat AS (
  SELECT e.id AS event_id, e.name AS name, e.dates.start.localDate AS local_date,
         e.dates.start.localTime AS local_time, e._embedded.venues[1].id AS venue_id,
         e._embedded.venues[1].name AS venue_name,
         e._embedded.venues[1].location.latitude AS lat_text,
         e._embedded.venues[1].location.longitude AS lon_text
  FROM (SELECT unnest(from_json(json_extract(body, '$._embedded.events'), '{ev_type}')) AS e
        FROM e_land WHERE status = 200)),
listings AS (
  SELECT event_id, name, try_cast(local_date AS DATE) AS event_date, local_date, local_time,
         venue_id, venue_name, try_cast(lat_text AS DOUBLE) AS lat, try_cast(lon_text AS DOUBLE) AS lon,
         concat(coalesce(local_date, 'None'), ' ', coalesce(local_time, 'None'), ' — ',
                coalesce(name, 'None'), ' @ ', coalesce(venue_name, 'None'), ' (',
                coalesce(lat_text, 'None'), ',', coalesce(lon_text, 'None'), ')') AS message
  FROM ev_flat),
chosen AS (SELECT * FROM listings WHERE venue_id IN (SELECT venue_id FROM venues_dim))"""


ORACLE["weather_readings"] = with_ctes(cte_context(), body="SELECT * FROM readings")

ORACLE["failed_responses"] = with_ctes(cte_context(), body="""
SELECT fetched_at, status, body AS error_text, 'weather' AS feed FROM w_land WHERE status <> 200
UNION ALL
SELECT fetched_at, status, body AS error_text, 'events' AS feed FROM e_land WHERE status <> 200""")

ORACLE["event_listings"] = with_ctes(cte_context(), body="SELECT * FROM listings")

ORACLE["daily_event_listing"] = with_ctes(cte_context(), body="""
SELECT * FROM (
  SELECT *, cast(row_number() OVER (PARTITION BY event_date ORDER BY local_time, event_id)
                 AS INTEGER) AS rank
  FROM chosen
  WHERE event_date IS NOT NULL AND local_time IS NOT NULL
    AND concat(local_date, 'T', local_time, 'Z')
        BETWEEN strftime(event_date, '%Y-%m-%dT00:00:00Z') AND strftime(event_date, '%Y-%m-%dT23:59:59Z'))
WHERE rank <= 100""")

ORACLE["event_windows"] = with_ctes(cte_context(), body=f"""
SELECT d.event_date, strftime(d.event_date, '%Y-%m-%dT00:00:00Z') AS start_bound,
       strftime(d.event_date, '%Y-%m-%dT23:59:59Z') AS end_bound,
       {_q(",".join(v for v, _ in CHOSEN))} AS venue_query,
       (SELECT count(*) FROM chosen c WHERE c.event_date = d.event_date) AS n_events
FROM (SELECT DISTINCT cast(fetched_at AS DATE) AS event_date FROM e_land) d""")

ORACLE["fused_observations"] = with_ctes(*_front(cte_context(), """
hours AS (SELECT DISTINCT service_date, hour, service_date + to_hours(cast(hour AS INTEGER)) AS at FROM kept
          WHERE service_date IS NOT NULL),
one AS (SELECT fetched_at, max({'t': temp_c, 'c': condition}) AS rd FROM readings GROUP BY fetched_at),
hw AS (SELECT h.service_date, h.hour, o.fetched_at, o.rd FROM hours h ASOF JOIN one o ON h.at >= o.fetched_at),
de AS (
  SELECT l.event_date AS service_date, count(*) AS n_events,
         cast(sum(v.capacity) AS BIGINT) AS event_capacity
  FROM listings l JOIN venues_dim v ON l.venue_id = v.venue_id
  WHERE l.event_date IS NOT NULL GROUP BY l.event_date)"""), body="""
SELECT k.*, hw.fetched_at AS weather_at, hw.rd.t AS temp_c, hw.rd.c AS condition,
       coalesce(de.n_events, 0) AS n_events, coalesce(de.event_capacity, 0) AS event_capacity
FROM kept k
LEFT JOIN hw ON k.service_date = hw.service_date AND k.hour = hw.hour
LEFT JOIN de ON k.service_date = de.service_date""")


def _num(x: float) -> str:
    return f"'{x!r}'::DOUBLE"


def cte_profile() -> str:
    """The 24-hour baseline profile -> ``prof``."""
    return f"""
combos AS (SELECT DISTINCT station, line, day FROM filled_train),
grid AS (SELECT station, line, day, cast(unnest(range(0, 24)) AS INTEGER) AS hour FROM combos),
prof AS (
  SELECT s.station, s.line, s.day, s.hour, {open_serve('s.day', 's.hour')} AS is_open,
         CASE WHEN {open_serve('s.day', 's.hour')} THEN {SHOWN} ELSE 0.0::DOUBLE END AS riders
  FROM {predict_join('grid')})"""


def cte_map() -> str:
    from farebox.sources.dimensions import line_path_rows
    path_rows = ", ".join(
        f"({_q(line)}, {seq}, {_num(lat)}, {_num(lon)}, {_q(name) if name else 'NULL'}, {str(m).lower()})"
        for line, seq, lat, lon, name, m in line_path_rows())
    colour_rows = ", ".join(f"({_q(a)}, {_q(b)})" for a, b in COLOURS)
    return f"""
map_path(line, seq, lat, lon, name, show_marker) AS (VALUES {path_rows}),
map_colours(line, css_colour) AS (VALUES {colour_rows}),
markers AS (SELECT name, line, lat, lon FROM map_path WHERE show_marker)"""


ORACLE["station_predictions"] = with_ctes(
    *_front(cte_split(), cte_baseline(), cte_profile(), cte_map()), body="""
SELECT m.name, m.line, printf('%.4f', m.lat) AS lat_text, printf('%.4f', m.lon) AS lon_text,
       c.css_colour, p.day, p.hour, p.riders,
       format('{:,}', cast(CASE WHEN p.riders - floor(p.riders) >= 0.5 THEN floor(p.riders) + 1
                                ELSE floor(p.riders) END AS BIGINT)) AS riders_text,
       format('{:,.0f}', p.riders) AS riders_py_text
FROM markers m LEFT JOIN map_colours c ON m.line = c.line
LEFT JOIN prof p ON p.station = m.name AND p.line = m.line""")

ORACLE["line_summary"] = with_ctes(*_front(cte_map(), """
agg AS (SELECT line, count(*) AS n_obs, round(avg(riders), 6) + 0.0::DOUBLE AS mean_riders
        FROM kept WHERE line IS NOT NULL GROUP BY line),
pl AS (SELECT line, list_transform(list_sort(list({'seq': seq, 'lat': lat, 'lon': lon})),
                                   lambda x: [x.lat, x.lon]) AS path,
              cast(count_if(show_marker) AS BIGINT) AS n_stations
       FROM map_path GROUP BY line)"""), body="""
SELECT a.line, a.n_obs, a.mean_riders, coalesce(pl.path, []::DOUBLE[][]) AS path,
       coalesce(pl.n_stations, 0) AS n_stations,
       c.css_colour AS colour
FROM agg a LEFT JOIN pl ON a.line = pl.line LEFT JOIN map_colours c ON a.line = c.line""")

_RANGE_RE = r"^(\d{1,2})\s*[-–]\s*(\d{1,2})\s*([ap])\.?\s*m\.?$"

ORACLE["time_features"] = f"""
WITH src AS (
  SELECT event_id, ts,
    CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%-I:%M %p')
         WHEN event_id % 3 = 1 THEN strftime(ts, '%H:%M')
         ELSE concat(cast((hour(ts) + 11) % 12 + 1 AS VARCHAR), '–',
                     cast(((hour(ts) + 11) % 12 + 1) % 12 + 1 AS VARCHAR), ' ',
                     CASE WHEN hour(ts) < 12 THEN 'a.m.' ELSE 'p.m.' END) END AS clock_text
  FROM events),
p1 AS (
  SELECT *, coalesce(try_strptime(trim(clock_text), '%I:%M %p'),
                     try_strptime(trim(clock_text), '%H:%M')) AS pts,
         regexp_extract(lower(trim(clock_text)), '{_RANGE_RE}', 1) AS rs,
         regexp_extract(lower(trim(clock_text)), '{_RANGE_RE}', 3) AS rap
  FROM src),
p2 AS (SELECT *, CASE WHEN rs <> '' THEN cast(rs AS INTEGER) END AS si FROM p1),
p3 AS (
  SELECT event_id, clock_text, ts,
    cast(coalesce(hour(pts), CASE WHEN si BETWEEN 1 AND 12 THEN
         CASE WHEN rap = 'a' THEN CASE WHEN si = 12 THEN 0 ELSE si END
              WHEN rap = 'p' THEN CASE WHEN si = 12 THEN 12 ELSE si + 12 END END END) AS INTEGER) AS hour,
    cast(coalesce(minute(pts), CASE WHEN si BETWEEN 1 AND 12 THEN 0 END) AS INTEGER) AS minute
  FROM p2)
SELECT event_id, clock_text, hour, minute, hour * 60 + minute AS minute_of_day,
       round(sin({_num(6.283185307179586)} * (hour * 60 + minute) / 1440), 6) + 0.0::DOUBLE AS tod_sin,
       round(cos({_num(6.283185307179586)} * (hour * 60 + minute) / 1440), 6) + 0.0::DOUBLE AS tod_cos,
       dayname(ts) AS weekday, cast(hour(ts) AS INTEGER) AS ts_hour
FROM p3"""

ORACLE["congestion_levels"] = with_ctes(*_front(cte_split(), cte_baseline(), cte_profile(), """
q AS (SELECT quantile_disc(riders, 1/3) AS lo, quantile_disc(riders, 2/3) AS hi FROM prof WHERE is_open)"""),
    body="""
SELECT prof.*, CASE WHEN NOT is_open THEN 'closed' WHEN riders <= q.lo THEN 'low'
                    WHEN riders <= q.hi THEN 'medium' ELSE 'high' END AS level
FROM prof, q""")

ORACLE["model_card"] = with_ctes(*_front(cte_split(), cte_baseline(), cte_metrics()), body=f"""
SELECT {MODEL_VERSION_SQL} AS model_version,
       ['station', 'line', 'day', 'hour', 'minute', 'is_weekend'] AS features,
       'cell mean + categorical mode fill (baseline)' AS algo,
       {_q(RULE)} AS service_hours_rule,
       r2, rmse, mae
FROM metrics""")

ORACLE["streamed_scored_requests"] = ORACLE["scored_requests"]
ORACLE["streamed_rejected_records"] = ORACLE["rejected_records"]

ORACLE["category_vocabulary"] = with_ctes(*_front(cte_split(), cte_baseline()), body="""
SELECT feature, cast(row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS INTEGER) AS position, value
FROM (SELECT 'station' AS feature, station AS value FROM filled_train WHERE riders IS NOT NULL
      UNION SELECT 'line', line FROM filled_train WHERE riders IS NOT NULL
      UNION SELECT 'day', day FROM filled_train WHERE riders IS NOT NULL)""")

ORACLE["numeric_fill_means"] = with_ctes(*_front(cte_split()), body="""
SELECT 'hour' AS feature, round(avg(hour), 6) + 0.0::DOUBLE AS mean FROM split WHERE NOT is_test AND riders IS NOT NULL
UNION ALL SELECT 'minute', round(avg(minute), 6) + 0.0::DOUBLE FROM split WHERE NOT is_test AND riders IS NOT NULL
UNION ALL SELECT 'is_weekend', round(avg(is_weekend), 6) + 0.0::DOUBLE FROM split WHERE NOT is_test AND riders IS NOT NULL""")


def cte_labelled() -> str:
    """Labelled train rows and their own modes, nulls filled -> ``labelled``; the sorted categories -> ``vocabulary``."""
    fill = lambda c: (f"coalesce({c}, (SELECT {c} FROM learn WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}")
    return f"""
learn AS (SELECT * FROM split WHERE NOT is_test AND riders IS NOT NULL),
labelled AS (SELECT * REPLACE ({fill('station')}, {fill('line')}, {fill('day')}) FROM learn),
levels AS (
  SELECT 'station' AS feature, 0 AS k, station AS value, riders FROM labelled UNION ALL
  SELECT 'line', 1, line, riders FROM labelled UNION ALL
  SELECT 'day', 2, day, riders FROM labelled),
vocabulary AS (
  SELECT feature, value, cast(row_number() OVER (ORDER BY k, value) - 1 AS INTEGER) AS position
  FROM (SELECT DISTINCT feature, k, value FROM levels WHERE value IS NOT NULL))"""


ORACLE["design_matrix"] = with_ctes(*_front(cte_split(), cte_labelled(), cte_requests()), body=f"""
, valid AS (
  SELECT request_id, pos, {strip('station')} AS station, {strip('line')} AS line, {strip('lower(day)')} AS day, hour
  FROM checked WHERE reason IS NULL)
, every_row AS (
  SELECT 'observation' AS origin, obs_id AS id, 0 AS pos,
    coalesce(station, (SELECT station FROM learn WHERE station IS NOT NULL GROUP BY station ORDER BY count(*) DESC, station LIMIT 1)) AS station,
    coalesce(line, (SELECT line FROM learn WHERE line IS NOT NULL GROUP BY line ORDER BY count(*) DESC, line LIMIT 1)) AS line,
    coalesce(day, (SELECT day FROM learn WHERE day IS NOT NULL GROUP BY day ORDER BY count(*) DESC, day LIMIT 1)) AS day,
    hour, is_weekend
  FROM kept UNION ALL
  SELECT 'request', request_id, pos, station, line, day, hour, CASE WHEN day IN ({_list(WEEKENDS)}) THEN 1 ELSE 0 END FROM valid)
, cells AS (
  SELECT origin, id, pos, 'station' AS feature, station AS value FROM every_row UNION ALL
  SELECT origin, id, pos, 'line', line FROM every_row UNION ALL
  SELECT origin, id, pos, 'day', day FROM every_row)
, width AS (SELECT cast(count(*) AS INTEGER) AS n FROM vocabulary)
SELECT origin, id, pos, position, concat(feature, '=', value) AS "column", 1.0::DOUBLE AS value
FROM cells JOIN vocabulary USING (feature, value)
UNION ALL SELECT origin, id, pos, n, 'hour', hour::DOUBLE FROM every_row, width WHERE hour <> 0
UNION ALL SELECT origin, id, pos, n + 2, 'is_weekend', is_weekend::DOUBLE FROM every_row, width WHERE is_weekend <> 0""")

ORACLE["linear_normal_equations"] = with_ctes(*_front(cte_split(), cte_labelled()), body="""
SELECT feature, value, count(*) AS n, round(avg(riders), 6) + 0.0::DOUBLE AS mean_fitted FROM levels GROUP BY feature, value
UNION ALL SELECT 'hour', 'product', count(*), round(avg(hour * riders), 6) + 0.0::DOUBLE FROM labelled
UNION ALL SELECT 'minute', 'product', count(*), round(avg(minute * riders), 6) + 0.0::DOUBLE FROM labelled
UNION ALL SELECT 'is_weekend', 'product', count(*), round(avg(is_weekend * riders), 6) + 0.0::DOUBLE FROM labelled""")

ORACLE["gbt_root_split"] = with_ctes(*_front(cte_split(), cte_labelled()), body="""
, total AS (SELECT avg(riders) AS m, count(*) AS n FROM labelled)
, sides AS (
  SELECT k, feature, value, sum(m - riders) AS g, count(*) AS w, row_number() OVER (PARTITION BY feature ORDER BY value) AS i
  FROM levels, total GROUP BY k, feature, value
  UNION ALL
  SELECT 3, 'hour', cast(t.cut AS VARCHAR), sum(m - riders), count(*), row_number() OVER (ORDER BY t.cut)
  FROM (SELECT DISTINCT hour AS cut FROM labelled WHERE hour > (SELECT min(hour) FROM labelled)) t
  JOIN labelled l ON l.hour >= t.cut, total GROUP BY t.cut
  UNION ALL
  SELECT 5, 'is_weekend', '1.0', sum(m - riders), count(*), 1 FROM labelled, total WHERE is_weekend = 1)
, scored AS (
  SELECT k, i, feature, value, w, n - w AS rest, g * g / (w + 1) + g * g / (n - w + 1) AS gain, n FROM sides, total WHERE n > w)
SELECT feature, value, round(gain / n, 4) + 0.0::DOUBLE AS gain, rest AS n_left, w AS n_right,
  row_number() OVER (ORDER BY gain DESC, k, i) = 1 AS chosen
FROM scored""")

ORACLE["published_models"] = with_ctes(*_front(cte_split()), body="""
, parts AS (
  SELECT 1 AS position, station, line, day FROM split WHERE NOT is_test AND riders IS NOT NULL UNION ALL
  SELECT 2, station, line, day FROM split WHERE NOT is_test AND riders IS NOT NULL AND line = '1')
SELECT cast(position AS INTEGER) AS position, concat('v2024.02.01.', CASE WHEN position = 1 THEN '1246' ELSE '1346' END) AS model_version,
  concat('part ', position - 1) AS algo, count(*) AS n_rows, cast(count(DISTINCT station) AS INTEGER) AS stations,
  cast(count(DISTINCT line) AS INTEGER) AS lines, cast(count(DISTINCT day) AS INTEGER) AS days
FROM parts GROUP BY position""")


# Output presentation (see ``queries.present``): dates as text.
for _name, _column in {"clean_observations": "service_date", "service_filtered": "service_date",
                       "closed_hours_fallback": "service_date", "fused_observations": "service_date",
                       "event_listings": "event_date", "daily_event_listing": "event_date",
                       "event_windows": "event_date"}.items():
    ORACLE[_name] = f"SELECT * REPLACE (cast({_column} AS VARCHAR) AS {_column}) FROM (\n{ORACLE[_name]}\n)"
