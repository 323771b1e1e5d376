"""DuckDB SQL for every registered query, written apart from the Spark expressions.

All texts share one chain of common table expressions: the access log, its fields normalized, the
daily tables, and the log rendered as text and parsed again. Only the definition of the access
log itself is the same text for both engines, as it is the input.
"""

from __future__ import annotations

from logtally.sources.accesslog import ACCESS_LOG_SQL, LOG_LINES_SQL

from .spark_queries import BOUNDS, BROKEN_DATE, DEVICE, FIXED_ZONES, FOLDERLESS, REGISTRY, ROOTS, SERVICE

START, TODAY, LAST7 = (f"DATE '{d}'" for d in (BOUNDS.year_start, BOUNDS.today, BOUNDS.last7_start))
ROOT_LIST = ", ".join(f"'{r}'" for r in ROOTS)
IN_RANGE = f"local_date BETWEEN {START} AND {TODAY}"

_SERVICE_PATH = "seg[1] <> 'portal' AND seg[2] = 'rest' AND seg[3] = 'services'"
_CONTENT_PATH = "seg[1] = 'portal' AND seg[2] = 'sharing' AND seg[3] = 'rest' AND seg[4] = 'content'"
_LOGIN_PATH = "seg[1] = 'portal' AND seg[2] = 'sharing' AND seg[3] = 'rest' AND seg[4] = 'community' AND seg[5] = 'users'"

BASE = f"""
al AS ({ACCESS_LOG_SQL.format(events="events", pages="pages")}),
cut AS (
  SELECT *,
    CAST(utc_ts - INTERVAL 7 HOUR AS DATE) AS local_date,
    list_filter(string_split(lower(uri_stem), '/'), lambda s: s <> '') AS seg,
    list_filter(string_split(uri_stem, '/'), lambda s: s <> '') AS cased,
    trim(string_split(replace(forwarded_for, '+', ''), ',')[1]) AS hop
  FROM al
),
req AS (
  SELECT *,
    left(uri_stem, 1024) AS k_uri,
    coalesce(left(seg[1], 16), '-') AS k_root,
    left(lower(replace(user_agent, '+', ' ')), 1024) AS k_ua,
    CASE WHEN trim(lower(replace(referer, '+', ' '))) IN ('', '-') THEN '-'
      ELSE left(trim(lower(replace(referer, '+', ' '))), 4096) END AS k_referer,
    CASE WHEN forwarded_for IS NULL THEN NULL
      WHEN forwarded_for IN ('', '-') THEN '127.0.0.1'
      WHEN hop LIKE '[%]%' THEN split_part(substr(hop, 2), ']', 1)
      WHEN regexp_full_match(hop, '[0-9]+([.][0-9]+){{3}}(:[0-9]+)?') THEN split_part(hop, ':', 1)
      WHEN regexp_full_match(hop, '[0-9a-f:]*::[0-9a-f:]*') THEN hop
      ELSE '-' END AS k_ip,
    CASE WHEN {_SERVICE_PATH} AND len(seg) >= 6 AND ends_with(seg[6], 'server')
        THEN {{'site': left(seg[1], 16), 'folder': seg[4], 'service_name': seg[5], 'service_type': seg[6]}}
      WHEN {_SERVICE_PATH} AND len(seg) >= 5 AND ends_with(seg[5], 'server')
        THEN {{'site': left(seg[1], 16), 'folder': NULL, 'service_name': seg[4], 'service_type': seg[5]}}
    END AS k_service,
    CASE WHEN {_CONTENT_PATH} THEN left(CASE
      WHEN seg[5] = 'items' THEN cased[6]
      WHEN seg[5] = 'users' AND seg[7] = 'items' THEN cased[8]
      WHEN seg[5] = 'users' AND seg[8] = 'items' THEN cased[9] END, 64) END AS k_item,
    CASE WHEN {_LOGIN_PATH} THEN lower(replace(cased[6], '%40', '@')) END AS k_login,
    CASE WHEN user_agent ILIKE '%arcgis-fieldmaps%'
      THEN nullif(regexp_extract(lower(user_agent), '[(]([0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}})[)]$', 1), '') END AS k_field,
    CASE WHEN user_agent ILIKE '%appframework/%' AND user_agent ILIKE '%survey123%'
      THEN nullif(regexp_extract(lower(user_agent), ';[+]([0-9a-f]{{32}})[)]', 1), '') END AS k_survey,
    status < 400 AS ok
  FROM cut
)"""


def _flat(name: str, *keys: tuple[str, str], where: str = "true") -> str:
    cols = ", ".join(f"{expr} AS {alias}" for expr, alias in keys)
    group = ", ".join(str(i + 1) for i in range(len(keys) + 1))
    return f"""
{name} AS (
  SELECT local_date, {cols}, CAST(sum(time_taken_ms) AS BIGINT) AS ms, CAST(sum(time_taken_ms) AS DOUBLE) / 1e3 AS time_taken_second, count(*) AS hits
  FROM req WHERE {where} GROUP BY {group}
)"""


def _device(name: str, key: str) -> str:
    return f"""
{name} AS (
  SELECT local_date, {key} AS device_id,
    first(k_login ORDER BY utc_ts, event_id) FILTER (WHERE ok AND k_login IS NOT NULL) AS username,
    CAST(sum(time_taken_ms) AS DOUBLE) / 1e3 AS time_taken_second, count(*) AS hits, CAST(sum(time_taken_ms) AS BIGINT) AS ms
  FROM req WHERE {key} IS NOT NULL GROUP BY 1, 2
),
{name}_donor AS (
  SELECT device_id, username AS donor FROM (
    SELECT device_id, username, row_number() OVER (PARTITION BY device_id ORDER BY local_date, username) AS n
    FROM {name} WHERE username IS NOT NULL) WHERE n = 1
),
{name}_filled AS (
  SELECT t.local_date, t.device_id, coalesce(t.username, d.donor) AS username, t.time_taken_second, t.hits, t.ms
  FROM {name} t LEFT JOIN {name}_donor d ON t.device_id = d.device_id
)"""


TABLES = ",".join(
    [
        _flat("t_uri", ("k_uri", "uri_stem")),
        _flat("t_root", ("k_root", "root")),
        _flat("t_ua", ("k_ua", "user_agent")),
        _flat("t_referer", ("k_referer", "referer")),
        _flat("t_ip", ("k_ip", "forwarded_for_ip"), where="forwarded_for IS NOT NULL"),
        _flat("t_referer_uri", ("k_referer", "referer"), ("k_uri", "uri_stem")),
        """
t_service AS (
  SELECT local_date, k_service.site AS site, k_service.folder AS folder, k_service.service_name AS service_name,
    k_service.service_type AS service_type,
    CAST(coalesce(sum(time_taken_ms) FILTER (WHERE ok), 0) AS BIGINT) AS ok_ms,
    CAST(coalesce(sum(time_taken_ms) FILTER (WHERE NOT ok), 0) AS BIGINT) AS failed_ms,
    CAST(ok_ms AS DOUBLE) / 1e3 AS successful_time_taken_second,
    CAST(failed_ms AS DOUBLE) / 1e3 AS failed_time_taken_second,
    count(*) AS hits, count(*) FILTER (WHERE ok) AS successful_hits, count(*) FILTER (WHERE NOT ok) AS failed_hits
  FROM req WHERE k_service IS NOT NULL GROUP BY 1, 2, 3, 4, 5
)""",
        """
t_item AS (
  SELECT local_date, k_item AS portal_item_id, CAST(sum(time_taken_ms) AS BIGINT) AS ms,
    CAST(sum(time_taken_ms) AS DOUBLE) / 1e3 AS time_taken_second, count(*) AS hits,
    count(*) FILTER (WHERE ok) AS successful_hits, count(*) FILTER (WHERE NOT ok) AS failed_hits
  FROM req WHERE k_item IS NOT NULL GROUP BY 1, 2
)""",
        _device("t_field", "k_field"),
        _device("t_survey", "k_survey"),
        # A date west of UTC is whole only with its own and the next day's files.
        """
whole AS (
  SELECT DISTINCT utc_date AS local_date FROM al
  WHERE utc_date + 1 IN (SELECT utc_date FROM al)
)""",
    ]
)

TEXT = f"""
per_event AS ({LOG_LINES_SQL.format(access_log="al")}),
lines AS (
  SELECT *, CAST(strptime(substr(file, 5, 6), '%y%m%d') AS DATE) AS file_utc_date, row_number() OVER (PARTITION BY file ORDER BY event_id, kind) AS line_no FROM (
    SELECT file, event_id, 0 AS kind, header AS line FROM per_event WHERE header IS NOT NULL
    UNION ALL SELECT file, event_id, 1, remark FROM per_event WHERE remark IS NOT NULL
    UNION ALL SELECT file, event_id, 2, blank FROM per_event WHERE blank IS NOT NULL
    UNION ALL SELECT file, event_id, 3, data FROM per_event)
),
marked AS (
  SELECT *, CASE WHEN lower(line) LIKE '#fields:%' THEN list_filter(string_split(lower(substr(line, 9)), ' '), lambda s: s <> '') END AS own_names
  FROM lines
),
governed AS (
  SELECT *, last_value(own_names IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS names
  FROM marked
),
bad_header AS (
  SELECT file, min(line_no) AS line_no, arg_min(missing, line_no) AS missing FROM (
    SELECT file, line_no, list_filter(['date', 'time', 'cs-uri-stem', 'cs(User-Agent)', 'cs(Referer)', 'sc-status', 'time-taken'],
      lambda f: NOT list_contains(own_names, lower(f))) AS missing
    FROM marked WHERE own_names IS NOT NULL)
  WHERE len(missing) > 0 GROUP BY file
),
t_skipped AS (
  SELECT f.file, f.file_utc_date,
    CASE WHEN f.headers = 0 THEN 'no #Fields header block found'
      ELSE 'header block at line ' || b.line_no || ' is missing required field(s): ' || array_to_string(b.missing, ', ') END AS reason
  FROM (SELECT file, file_utc_date, count(own_names) AS headers FROM marked GROUP BY 1, 2) f
  LEFT JOIN bad_header b ON f.file = b.file
  WHERE f.headers = 0 OR b.file IS NOT NULL
),
all_data AS (
  SELECT *, list_filter(string_split(line, ' '), lambda s: s <> '') AS tok FROM governed
  WHERE line NOT LIKE '#%' AND trim(line) <> ''
),
data_lines AS (SELECT * FROM all_data WHERE file NOT IN (SELECT file FROM t_skipped)),
picked AS (
  SELECT *,
    tok[list_position(names, 'date')] || ' ' || tok[list_position(names, 'time')] AS ts_text,
    tok[list_position(names, 'sc-status')] AS status_text,
    tok[list_position(names, 'time-taken')] AS taken_text
  FROM data_lines
),
parsed AS (
  SELECT *,
    CASE WHEN names IS NULL THEN 'no header block seen yet'
      WHEN len(tok) <> len(names) THEN 'field count mismatch (expected ' || len(names) || ', got ' || len(tok) || ')'
      WHEN NOT regexp_full_match(ts_text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') OR TRY_CAST(ts_text AS TIMESTAMP) IS NULL
        THEN 'unparseable date/time ''' || ts_text || ''''
      WHEN NOT regexp_full_match(status_text, '[+-]?[0-9]+') THEN 'unparseable status ''' || status_text || ''''
      WHEN NOT regexp_full_match(taken_text, '[+-]?[0-9]+') THEN 'unparseable time-taken ''' || taken_text || ''''
    END AS reason
  FROM picked
)"""


def q(select: str) -> str:
    return f"WITH {BASE},{TABLES} {select}"


def qt(select: str) -> str:
    return f"WITH {BASE},{TEXT} {select}"


def _day(c: str = "local_date") -> str:
    return f"CAST({c} AS VARCHAR) AS {c}"


_REST = {
    "t_uri": "uri_stem, time_taken_second, hits",
    "t_root": "root, time_taken_second, hits",
    "t_ua": "user_agent, time_taken_second, hits",
    "t_referer": "referer, time_taken_second, hits",
    "t_ip": "forwarded_for_ip, time_taken_second, hits",
    "t_referer_uri": "referer, uri_stem, time_taken_second, hits",
    "t_service": "site, folder, service_name, service_type, successful_time_taken_second, failed_time_taken_second, hits, successful_hits, failed_hits",
    "t_item": "portal_item_id, time_taken_second, hits, successful_hits, failed_hits",
    "t_field": "device_id, username, time_taken_second, hits",
    "t_survey": "device_id, username, time_taken_second, hits",
}


def rows(name: str, where: str = "true", source: str | None = None) -> str:
    return q(f"SELECT {_day()}, {_REST[name]} FROM {source or name} WHERE {where}")


def scalar(expr: str, source: str = "req") -> str:
    return q(f"SELECT event_id, {expr} AS value FROM {source}")


SVC = "site, folder, service_name, service_type"
SUM_HITS = "CAST(sum(hits) AS BIGINT) AS hits"
SUM_COUNTS = SUM_HITS + ", CAST(sum(successful_hits) AS BIGINT) AS successful_hits, CAST(sum(failed_hits) AS BIGINT) AS failed_hits"
SUM_TIMES = (
    "CAST(sum(ok_ms) AS DOUBLE) / 1e3 AS successful_time_taken_second, CAST(sum(successful_hits) AS BIGINT) AS successful_hits, "
    "CAST(sum(failed_ms) AS DOUBLE) / 1e3 AS failed_time_taken_second, CAST(sum(failed_hits) AS BIGINT) AS failed_hits"
)


def service_is(site: str, folder: str | None, name: str, kind: str) -> str:
    f = "NULL" if folder is None else f"'{folder}'"
    return f"site = '{site}' AND folder IS NOT DISTINCT FROM {f} AND service_name = '{name}' AND service_type = '{kind}'"


def total(ms: str = "ms") -> str:
    return f"CAST(sum({ms}) AS DOUBLE) / 1e3"


def rounded_total(ms: str = "ms") -> str:
    return (
        f"(round_even(({total(ms)}) * 1000, 0) / 1e3) AS total_time_taken_second, "
        f"(round_even(({total(ms)} / sum(hits)) * 1000, 0) / 1e3) AS average_time_taken_second"
    )


def top_flat(name: str, key: str, where: str = "true") -> str:
    return q(
        f"SELECT {key} AS value, {SUM_HITS}, {total()} AS total_time_taken_second FROM {name} "
        f"WHERE {IN_RANGE} AND {where} GROUP BY 1 ORDER BY hits DESC, value LIMIT 500"
    )


def top_services(outcome: str, by_average: bool) -> str:
    ms = "ok_ms" if outcome == "successful" else "failed_ms"
    order = f"{total(ms)} / sum({outcome}_hits)" if by_average else f"sum({outcome}_hits)"
    extra = f"{total(ms)} AS total_time_taken_second, " if by_average else ""
    return q(
        f"SELECT * FROM (SELECT {SVC}, {extra}CAST(sum({outcome}_hits) AS BIGINT) AS hits, "
        f"CAST(row_number() OVER (PARTITION BY site ORDER BY {order} DESC, folder NULLS FIRST, service_name, service_type) AS INTEGER) AS rank "
        f"FROM t_service WHERE {IN_RANGE} GROUP BY {SVC} HAVING sum({outcome}_hits) > 0) WHERE rank <= 50"
    )


def top_items(outcome: str) -> str:
    return q(
        f"SELECT portal_item_id, CAST(sum({outcome}_hits) AS BIGINT) AS hits FROM t_item WHERE {IN_RANGE} "
        f"GROUP BY 1 HAVING sum({outcome}_hits) > 0 ORDER BY hits DESC, portal_item_id LIMIT 50"
    )


def top_devices(name: str) -> str:
    return q(
        f"SELECT t.device_id, d.donor AS username, t.hits FROM (SELECT device_id, {SUM_HITS} FROM {name} WHERE {IN_RANGE} "
        f"GROUP BY 1 ORDER BY hits DESC, device_id LIMIT 50) t LEFT JOIN {name}_donor d ON t.device_id = d.device_id"
    )


def device_totals(name: str) -> str:
    return q(
        f"SELECT t.device_id, d.donor AS username, {SUM_HITS}, {total()} AS total_time_taken_second, "
        f"CAST(max(local_date) AS VARCHAR) AS last_seen FROM {name} t LEFT JOIN {name}_donor d ON t.device_id = d.device_id "
        f"WHERE {IN_RANGE} GROUP BY 1, 2"
    )


def attribution(name: str) -> str:
    return q(
        f"SELECT CAST(a.local_date AS VARCHAR) AS local_date, count(*) AS devices_seen, count(a.username) AS same_day, "
        f"count(b.username) - count(a.username) AS backfilled, count(*) - count(b.username) AS unattributed "
        f"FROM {name} a JOIN {name}_filled b ON a.local_date = b.local_date AND a.device_id = b.device_id GROUP BY a.local_date"
    )


def both_ranges(name: str) -> str:
    """The last-seven-days range lies within the year here, so one definition serves all marts."""
    return (
        f"(SELECT 'all' AS range, * FROM {name} WHERE {IN_RANGE} "
        f"UNION ALL SELECT 'last-7-days', * FROM {name} WHERE local_date BETWEEN {LAST7} AND {TODAY})"
    )


SERIES = (
    "CAST(sum(successful_hits) AS BIGINT) AS successful_hits, CAST(sum(failed_hits) AS BIGINT) AS failed_hits, "
    f"CASE WHEN sum(successful_hits) > 0 THEN (round_even(({total('ok_ms')} / sum(successful_hits)) * 1000, 0) / 1e3) END AS average_successful_second, "
    f"CASE WHEN sum(failed_hits) > 0 THEN (round_even(({total('failed_ms')} / sum(failed_hits)) * 1000, 0) / 1e3) END AS average_failed_second"
)
LABEL = "CASE WHEN folder IS NULL THEN '' ELSE folder || '/' END || service_name || ' (' || service_type || ')'"
SITES = f"site IN ({ROOT_LIST})"


def _metric(name: str, hits: str, value: str) -> str:
    return (
        f"SELECT range, '{name}' AS metric, {SVC}, CAST({value} AS DOUBLE) AS value FROM {both_ranges('t_service')} "
        f"WHERE {SITES} GROUP BY range, {SVC} HAVING sum({hits}) > 0"
    )


SERVICE_LEADERBOARDS = q(
    f"SELECT range, site, metric, rank, {LABEL} AS label, (round_even((value) * 1000, 0) / 1e3) AS value FROM (SELECT *, CAST(row_number() OVER "
    "(PARTITION BY range, site, metric ORDER BY value DESC, folder NULLS FIRST, service_name, service_type) AS INTEGER) AS rank FROM ("
    + " UNION ALL ".join(
        [
            _metric("successful-hits", "successful_hits", "sum(successful_hits)"),
            _metric("failed-hits", "failed_hits", "sum(failed_hits)"),
            _metric("average-successful-time", "successful_hits", f"{total('ok_ms')} / sum(successful_hits)"),
            _metric("average-failed-time", "failed_hits", f"{total('failed_ms')} / sum(failed_hits)"),
        ]
    )
    + ")) WHERE rank <= 50"
)

PORTAL_LEADERBOARDS = q(
    "SELECT range, metric, rank, portal_item_id, hits FROM (SELECT *, CAST(row_number() OVER (PARTITION BY range, metric ORDER BY hits DESC, portal_item_id) AS INTEGER) AS rank FROM ("
    + " UNION ALL ".join(
        f"SELECT range, '{outcome}-hits' AS metric, portal_item_id, CAST(sum({outcome}_hits) AS BIGINT) AS hits "
        f"FROM {both_ranges('t_item')} GROUP BY 1, 2, 3 HAVING sum({outcome}_hits) > 0"
        for outcome in ("successful", "failed")
    )
    + ")) WHERE rank <= 50"
)


def device_leaderboard(name: str) -> str:
    return q(
        "SELECT range, rank, coalesce(donor || ' · ' || t.device_id, t.device_id) AS label, hits FROM ("
        "SELECT *, CAST(row_number() OVER (PARTITION BY range ORDER BY hits DESC, device_id) AS INTEGER) AS rank FROM ("
        f"SELECT range, device_id, {SUM_HITS} FROM {both_ranges(name)} GROUP BY 1, 2)) t "
        f"LEFT JOIN {name}_donor d ON t.device_id = d.device_id WHERE rank <= 50"
    )


def device_complete(name: str) -> str:
    return q(
        f"SELECT 'all' AS range, d.donor AS username, t.device_id, {SUM_HITS}, {rounded_total()}, CAST(max(local_date) AS VARCHAR) AS last_seen "
        f"FROM {name} t LEFT JOIN {name}_donor d ON t.device_id = d.device_id WHERE {IN_RANGE} GROUP BY t.device_id, d.donor"
    )


def device_detail(name: str) -> str:
    return q(
        f"SELECT range, t.device_id, coalesce(donor, 'Unattributed') || ' » ' || t.device_id AS heading, {_day()}, hits "
        f"FROM {both_ranges(name)} t LEFT JOIN {name}_donor d ON t.device_id = d.device_id"
    )


def _flat_board(dimension: str, name: str, key: str, where: str = "true") -> str:
    return (
        f"SELECT '{dimension}' AS dimension, range, {key} AS value, {SUM_HITS}, {rounded_total()} "
        f"FROM {both_ranges(name)} WHERE {where} GROUP BY range, {key}"
    )


FLAT_LEADERBOARDS = q(
    "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY dimension, range ORDER BY hits DESC, value) AS INTEGER) AS rank FROM ("
    + " UNION ALL ".join(
        [
            _flat_board("forwarded-for-ip", "t_ip", "forwarded_for_ip"),
            _flat_board("referer", "t_referer", "referer", "referer <> '-'"),
            _flat_board("uri", "t_uri", "uri_stem"),
            _flat_board("user-agent", "t_ua", "user_agent"),
        ]
    )
    + ")) WHERE rank <= 500"
)

# Around 2024-03-10 the zone goes from seven to six hours behind UTC, at 09:00 UTC.
SHIFTED = (
    "SELECT event_id, utc_date + 60 AS file_utc_date, utc_ts + INTERVAL 60 DAY AS ts FROM al"
)
DAY_OFFSET = "CASE WHEN d <= DATE '2024-03-10' THEN -25200 ELSE -21600 END"
FIXED_OFFSET = (
    f"SELECT event_id, d, {DAY_OFFSET} AS off, ts, ts + to_seconds({DAY_OFFSET}) AS local_ts "
    f"FROM (SELECT *, unnest([file_utc_date - 1, file_utc_date]) AS d FROM ({SHIFTED}))"
)
EXACT = (
    "SELECT event_id, CAST(ts - CASE WHEN ts < TIMESTAMP '2024-03-10 09:00:00' THEN INTERVAL 7 HOUR ELSE INTERVAL 6 HOUR END AS DATE) AS d "
    f"FROM ({SHIFTED})"
)
ZONE_DAYS = "SELECT DISTINCT CAST(utc_date + 60 AS DATE) AS d FROM al"
ZONES = (
    f"(SELECT d, {DAY_OFFSET} AS offset_s, 'America/Edmonton' AS zone FROM ({ZONE_DAYS}) "
    f"UNION ALL SELECT d, 0, 'UTC' FROM ({ZONE_DAYS}) UNION ALL SELECT d, 32400, 'Asia/Tokyo' FROM ({ZONE_DAYS}))"
)

CLEAN_FILE = (
    "'u_ex' || strftime(utc_date, '%y%m%d') || '_x_' || (event_id // 100000) || "
    "CASE WHEN forwarded_for IS NULL THEN 'b' ELSE 'a' END || '.log'"
)
CLEAN_LINE = (
    "strftime(utc_ts, '%Y-%m-%d %H:%M:%S') || ' ' || uri_stem || ' ' || user_agent || ' ' || referer || ' ' || status || ' ' "
    "|| time_taken_ms || coalesce(' ' || forwarded_for, '')"
)
CLEAN_HEADER = (
    "CASE WHEN max(forwarded_for) IS NULL THEN length('#Fields: date time cs-uri-stem cs(User-Agent) cs(Referer) sc-status time-taken') "
    "ELSE length('#Fields: date time cs-uri-stem cs(User-Agent) cs(Referer) sc-status time-taken X-Forwarded-For') END"
)

LAYOUT = ", ".join(
    f"CAST(list_position(names, '{f}') - 1 AS INTEGER) AS {a}"
    for f, a in [
        ("date", "date"),
        ("time", "time"),
        ("cs-uri-stem", "uri_stem"),
        ("cs(user-agent)", "user_agent"),
        ("cs(referer)", "referer"),
        ("sc-status", "status"),
        ("time-taken", "time_taken"),
        ("x-forwarded-for", "forwarded_for"),
    ]
)
HEADER_BLOCKS = qt(f"SELECT file, line_no, CAST(len(names) AS INTEGER) AS n_fields, {LAYOUT} FROM data_lines")


def _value(field: str) -> str:
    return f"tok[list_position(names, '{field}')]"


ODD_CELL = (
    "CASE event_id % 4 WHEN 0 THEN '=' || referer WHEN 1 THEN referer || ' x  y' ELSE referer END"
)


def _harvested(name: str, filled: bool = False) -> str:
    if not filled:
        return rows(name, "local_date IN (SELECT local_date FROM whole)")
    # Only whole dates are harvested, so only they give usernames.
    return q(
        f"SELECT CAST(t.local_date AS VARCHAR) AS local_date, t.device_id, coalesce(t.username, d.username) AS username, t.time_taken_second, t.hits "
        f"FROM {name} t LEFT JOIN (SELECT device_id, username, row_number() OVER (PARTITION BY device_id ORDER BY local_date, username) AS n "
        f"FROM {name} WHERE username IS NOT NULL AND local_date IN (SELECT local_date FROM whole)) d ON t.device_id = d.device_id AND d.n = 1 "
        f"WHERE t.local_date IN (SELECT local_date FROM whole)"
    )


ALL_SETS = " UNION ALL ".join(
    f"SELECT '{full}' AS table_name, {SUM_HITS}, CAST(sum({ms}) AS BIGINT) AS time_taken_ms FROM {t}"
    for full, t, ms in [
        ("aggregated_by_uri", "t_uri", "ms"),
        ("aggregated_by_root", "t_root", "ms"),
        ("aggregated_by_user_agent", "t_ua", "ms"),
        ("aggregated_by_referer", "t_referer", "ms"),
        ("aggregated_by_forwarded_for_ip", "t_ip", "ms"),
        ("aggregated_by_referer_and_uri", "t_referer_uri", "ms"),
        ("aggregated_by_arcgis_service", "t_service", "ok_ms + failed_ms"),
        ("aggregated_by_portal_item", "t_item", "ms"),
        ("aggregated_by_field_maps_device", "t_field", "ms"),
        ("aggregated_by_survey123_device", "t_survey", "ms"),
    ]
)

def _tsv(titles: tuple[str, ...], cells: list[str], rest: str) -> str:
    header = " || chr(9) || ".join(f"'{t}'" for t in titles)
    return q(f"SELECT {header} AS line UNION ALL SELECT {' || chr(9) || '.join(cells)} FROM {rest}")


def _tsv_number(value: str) -> str:
    return f"regexp_replace(CAST(CAST((round_even(({value}) * 1000, 0) / 1e3) AS DECIMAL(30,3)) AS VARCHAR), '[.]?0+$', '')"


def _tsv_times(ms: str = "ms") -> list[str]:
    return [_tsv_number(f"coalesce({total(ms)}, 0)"), _tsv_number(f"coalesce({total(ms)} / sum(hits), 0)")]


TIME_TITLES = ("Total Time Taken (s)", "Average Time Taken (s)")
TSV = _tsv(
    ("Portal Item", "Hits", *TIME_TITLES, "Successful Hits", "Failed Hits"),
    ["portal_item_id", "sum(hits)", *_tsv_times(), "sum(successful_hits)", "sum(failed_hits)"],
    f"t_item WHERE {IN_RANGE} GROUP BY portal_item_id",
)
TSV_ROOT = _tsv(
    ("Root", "Hits", *TIME_TITLES),
    ["r.root", "coalesce(sum(hits), 0)", *_tsv_times()],
    f"(SELECT unnest([{ROOT_LIST}]) AS root) r LEFT JOIN (SELECT * FROM t_root WHERE {IN_RANGE}) t ON t.root = r.root GROUP BY r.root",
)
TSV_SERVICE = _tsv(
    ("Site", "Folder", "Service Name", "Service Type", "Hits", *TIME_TITLES, "Successful Hits", "Failed Hits"),
    ["site", "coalesce(folder, '')", "service_name", "service_type", "sum(hits)", *_tsv_times("ok_ms + failed_ms"), "sum(successful_hits)", "sum(failed_hits)"],
    f"t_service WHERE {IN_RANGE} AND {SITES} GROUP BY {SVC}",
)


def tsv_device(name: str) -> str:
    return _tsv(
        ("Username", "Device ID", "Hits", *TIME_TITLES, "Last Seen"),
        ["coalesce(d.donor, '')", "t.device_id", "sum(hits)", *_tsv_times(), "max(local_date)"],
        f"{name} t LEFT JOIN {name}_donor d ON t.device_id = d.device_id WHERE {IN_RANGE} GROUP BY t.device_id, d.donor",
    )


REPORT_BOUNDARIES = q(
    "SELECT CAST(now AS VARCHAR) AS now, zone, CAST(year AS INTEGER) AS year, CAST(least(local_today, make_date(year, 12, 31)) AS VARCHAR) AS today, "
    "CAST(make_date(year, 1, 1) AS VARCHAR) AS year_start, CAST(local_today - 6 AS VARCHAR) AS last7_start FROM ("
    "SELECT now, zone, local_today, unnest([year(local_today), year(local_today) - 1]) AS year FROM ("
    "SELECT now, zone, CAST(now + to_hours(hours) AS DATE) AS local_today FROM (SELECT min(utc_ts) AS now FROM al GROUP BY utc_date UNION SELECT max(utc_ts) FROM al GROUP BY utc_date), "
    f"(VALUES {', '.join(f"('{z}', {h})" for z, h in FIXED_ZONES.items())}) zones(zone, hours)))"
)

# Local dates around the log, each with the two UTC days whose files it needs.
NEEDED = """(
  SELECT local_date, unnest([local_date, local_date + 1]) AS utc_date
  FROM (SELECT CAST(unnest(generate_series(min(utc_date) - INTERVAL 1 DAY, max(utc_date) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS local_date FROM al)
)"""

SQL: dict[str, str] = {
    "access_log": q(
        "SELECT event_id, user_id, CAST(utc_ts AS VARCHAR) AS utc_ts, CAST(utc_date AS VARCHAR) AS utc_date, uri_stem, user_agent, referer, forwarded_for, status, time_taken_ms FROM al"
    ),
    # 2.1
    "local_offset": q(f"SELECT CAST(d AS VARCHAR) AS local_date, CAST(offset_s AS BIGINT) AS offset_s, zone FROM {ZONES}"),
    "required_utc_dates": q(
        "SELECT CAST(d AS VARCHAR) AS local_date, CAST(offset_s AS BIGINT) AS offset_s, CAST(unnest(CASE WHEN offset_s < 0 THEN [d, d + 1] "
        f"WHEN offset_s > 0 THEN [d - 1, d] ELSE [d] END) AS VARCHAR) AS utc_date, zone FROM {ZONES}"
    ),
    "discover_files": q(f"SELECT DISTINCT {CLEAN_FILE} AS file, CAST(utc_date AS VARCHAR) AS file_utc_date FROM al"),
    "read_log_lines": q(
        f"SELECT {CLEAN_FILE} AS file, CAST(utc_date AS VARCHAR) AS file_utc_date, count(*) + 1 AS n_lines, "
        f"CAST(sum(length({CLEAN_LINE})) + {CLEAN_HEADER} AS BIGINT) AS n_chars FROM al GROUP BY 1, 2"
    ),
    "read_table": _harvested("t_root"),
    "table_or_empty": rows("t_field"),
    "date_completeness": q(
        f"SELECT CAST(local_date AS VARCHAR) AS local_date, CAST(utc_date AS VARCHAR) AS utc_date FROM {NEEDED} "
        "WHERE utc_date NOT IN (SELECT utc_date FROM al WHERE day(utc_date) <> 13)"
    ),
    "refusal_status": qt(
        "SELECT CAST(local_date AS VARCHAR) AS local_date, CAST(coalesce(sum(files), 0) AS BIGINT) AS files, CAST(coalesce(sum(bad), 0) AS BIGINT) AS skipped_files, "
        "CAST(count(*) FILTER (WHERE files IS NULL) AS INTEGER) AS missing, coalesce(sum(bad), 0) = 0 AND count(*) FILTER (WHERE files IS NULL) = 0 AS complete "
        f"FROM {NEEDED} LEFT JOIN (SELECT file_utc_date, count(DISTINCT file) AS files FROM lines GROUP BY 1) f ON f.file_utc_date = utc_date "
        "LEFT JOIN (SELECT file_utc_date, count(*) AS bad FROM t_skipped GROUP BY 1) s ON s.file_utc_date = utc_date GROUP BY local_date"
    ),
    "unreadable_file": q(
        "SELECT CAST(local_date AS VARCHAR) AS local_date, CAST(coalesce(sum(files), 0) AS BIGINT) AS files, "
        f"count(*) FILTER (WHERE utc_date = DATE '{BROKEN_DATE}') AS skipped_files, "
        f"count(*) FILTER (WHERE files IS NULL OR utc_date = DATE '{BROKEN_DATE}') = 0 AS complete "
        f"FROM {NEEDED} LEFT JOIN (SELECT utc_date AS d, count(DISTINCT (event_id // 100000, forwarded_for IS NULL)) AS files FROM al GROUP BY 1) ON d = utc_date GROUP BY local_date"
    ),
    # 2.2
    "header_blocks": HEADER_BLOCKS,
    "header_blocks_shuffled": HEADER_BLOCKS,
    "skipped_files": qt("SELECT file, CAST(file_utc_date AS VARCHAR) AS file_utc_date, reason FROM t_skipped"),
    "data_lines": qt("SELECT file, line FROM all_data"),
    "split_fields": qt("SELECT file, line, CAST(len(tok) AS INTEGER) AS n, tok[3] AS third, tok[-1] AS last FROM all_data"),
    "parse_lines": qt(
        f"SELECT file, CAST(CAST(ts_text AS TIMESTAMP) AS VARCHAR) AS utc_ts, {_value('cs-uri-stem')} AS uri_stem, {_value('cs(user-agent)')} AS user_agent, "
        f"{_value('cs(referer)')} AS referer, CAST(status_text AS INTEGER) AS status, CAST(taken_text AS INTEGER) AS time_taken_ms, "
        f"CASE WHEN list_contains(names, 'x-forwarded-for') THEN {_value('x-forwarded-for')} END AS forwarded_for FROM parsed WHERE reason IS NULL"
    ),
    "parse_utc_ts": q(
        "SELECT event_id, CASE WHEN event_id % 5 IN (1, 2, 3) THEN NULL ELSE strftime(utc_ts, '%Y-%m-%d %H:%M:%S') END AS utc_ts FROM al"
    ),
    "parse_int32": q(
        "SELECT event_id, CAST(CASE event_id % 6 WHEN 0 THEN time_taken_ms WHEN 1 THEN time_taken_ms WHEN 2 THEN -time_taken_ms END AS INTEGER) AS value FROM al"
    ),
    "reject_lines": qt("SELECT file, line_no, reason FROM parsed WHERE reason IS NOT NULL"),
    "line_counts": qt(
        "SELECT file, count(*) AS total, count(*) FILTER (WHERE reason IS NULL) AS valid, count(reason) AS invalid FROM parsed GROUP BY 1"
    ),
    "run_summary": qt(
        "SELECT count(*) AS total, count(*) FILTER (WHERE reason IS NULL) AS valid, count(reason) AS invalid FROM parsed"
    ),
    "union_files": qt(
        "SELECT CAST(status_text AS INTEGER) AS status, count(DISTINCT file) AS files, count(*) AS n FROM parsed WHERE reason IS NULL GROUP BY 1"
    ),
    "assign_local_date": q(
        f"SELECT event_id, CAST(d AS VARCHAR) AS local_date FROM ({FIXED_OFFSET}) WHERE CAST(local_ts AS DATE) = d"
    ),
    "assign_local_date_exact": q(f"SELECT event_id, CAST(d AS VARCHAR) AS local_date FROM ({EXACT})"),
    "local_ts": q(
        f"SELECT event_id, strftime(local_ts, '%Y-%m-%d %H:%M:%S') AS local_ts FROM ({FIXED_OFFSET}) WHERE CAST(local_ts AS DATE) = d"
    ),
    # 2.3
    "normalize_uri_stem": scalar("k_uri"),
    "normalize_root": scalar("k_root"),
    "normalize_user_agent": scalar("k_ua"),
    "normalize_referer": scalar("k_referer"),
    "normalize_forwarded_for": scalar("k_ip"),
    "path_segments": scalar("array_to_string(cased, '|')"),
    "service_identity": q(
        "SELECT event_id, k_service.site AS site, k_service.folder AS folder, k_service.service_name AS service_name, k_service.service_type AS service_type FROM req WHERE k_service IS NOT NULL"
    ),
    "portal_item_id": scalar("k_item"),
    "login_username": scalar("k_login"),
    "field_maps_device_id": scalar("k_field"),
    "survey123_device_id": scalar("k_survey"),
    "is_success": scalar("ok"),
    "is_failed": scalar("NOT ok"),
    "ms_to_seconds": scalar("CAST(time_taken_ms AS DOUBLE) / 1e3"),
    "round3": scalar("(round_even((CAST(time_taken_ms AS DOUBLE) / 7e3) * 1000, 0) / 1e3)"),
    "average_time": q(
        f"SELECT {_day()}, {SVC}, CASE WHEN failed_hits > 0 THEN (round_even((failed_time_taken_second / failed_hits) * 1000, 0) / 1e3) ELSE 0.0::DOUBLE END AS table_value, "
        "CASE WHEN failed_hits > 0 THEN (round_even((failed_time_taken_second / failed_hits) * 1000, 0) / 1e3) END AS series_value FROM t_service"
    ),
    "service_label": q(
        "SELECT event_id, CASE WHEN k_service.folder IS NULL THEN '' ELSE k_service.folder || '/' END || k_service.service_name || ' (' || k_service.service_type || ')' AS value FROM req WHERE k_service IS NOT NULL"
    ),
    "device_label": q(
        f"SELECT {_day()}, device_id, CASE WHEN username IS NULL THEN device_id ELSE username || ' · ' || device_id END AS label, "
        "coalesce(username, 'Unattributed') || ' » ' || device_id AS heading FROM t_field"
    ),
    "tsv_cell": q(
        f"SELECT event_id, CASE WHEN substr({ODD_CELL}, 1, 1) IN ('=', '+', '-', '@') THEN '''' ELSE '' END || {ODD_CELL} AS text_cell, "
        "CAST(-time_taken_ms AS VARCHAR) AS number_cell FROM al"
    ),
    # 2.4
    "filter_local_date": q(
        f"SELECT event_id AS line_id, {_day()}, uri_stem FROM req WHERE local_date = DATE '2024-01-10'"
    ),
    "filter_identity_matched": q(f"SELECT event_id AS line_id, {_day()}, uri_stem FROM req WHERE k_item IS NOT NULL"),
    "filter_forwarded_declared": q(
        f"SELECT event_id AS line_id, {_day()}, uri_stem FROM req WHERE event_id % 8 <> 0"
    ),
    "filter_date_range": rows("t_root", "local_date >= DATE '2024-01-10' AND local_date <= DATE '2024-01-20'"),
    "filter_site": rows("t_service", "site = 'mimas'"),
    "filter_included_roots": rows("t_root", f"root IN ({ROOT_LIST})"),
    "filter_service": rows("t_service", service_is(*FOLDERLESS)),
    "filter_portal_item": rows("t_item", "portal_item_id = 'item4'"),
    "filter_device": rows("t_field", f"device_id = '{DEVICE}'"),
    "filter_referer_present": rows("t_referer", "referer <> '-'"),
    "filter_last_7_days": rows("t_root", f"local_date >= {LAST7}"),
    "report_boundaries": REPORT_BOUNDARIES,
    "report_ranges": q(f"SELECT range, {_day()}, root, hits FROM {both_ranges('t_root')}"),
    # 2.5, 2.8
    "attach_login": q(f"SELECT {_day()}, device_id, username, hits FROM t_field"),
    "first_login": q(f"SELECT {_day()}, device_id, username FROM t_survey"),
    "backfill_usernames": rows("t_field", source="t_field_filled"),
    "backfill_usernames_survey123": rows("t_survey", source="t_survey_filled"),
    "backfilled_dates": q(
        f"SELECT DISTINCT {_day()} FROM t_field WHERE username IS NULL AND device_id IN (SELECT device_id FROM t_field_donor)"
    ),
    "donor_rank": q("SELECT device_id, donor FROM t_field_donor"),
    "resolve_username": q(
        "SELECT t.device_id, d.donor AS username FROM (SELECT DISTINCT device_id FROM t_field) t LEFT JOIN t_field_donor d ON t.device_id = d.device_id"
    ),
    "dense_root_grid": q(
        f"SELECT {_day()}, "
        + ", ".join(f"CAST(sum(hits) FILTER (WHERE root = '{r}') AS BIGINT) AS {r}" for r in ROOTS)
        + f" FROM t_root WHERE root IN ({ROOT_LIST}) GROUP BY local_date"
    ),
    "complete_roots": q(
        f"SELECT r.root, CAST(coalesce(sum(hits), 0) AS BIGINT) AS hits, coalesce({total()}, 0) AS total_time_taken_second "
        f"FROM (SELECT unnest([{ROOT_LIST}]) AS root) r LEFT JOIN (SELECT * FROM t_root WHERE {IN_RANGE}) t ON t.root = r.root GROUP BY r.root"
    ),
    "report_dates": q(f"SELECT DISTINCT {_day()} FROM t_root WHERE {IN_RANGE} AND root IN ({ROOT_LIST})"),
    # 2.6
    "aggregate_by_uri": rows("t_uri"),
    "aggregate_by_root": rows("t_root"),
    "aggregate_by_user_agent": rows("t_ua"),
    "aggregate_by_referer": rows("t_referer"),
    "aggregate_by_forwarded_for_ip": rows("t_ip"),
    "aggregate_by_referer_and_uri": rows("t_referer_uri"),
    "aggregate_by_service": rows("t_service"),
    "aggregate_by_portal_item": rows("t_item"),
    "aggregate_by_field_maps_device": rows("t_field"),
    "aggregate_by_survey123_device": rows("t_survey"),
    "aggregate_all": q(ALL_SETS),
    # 2.7
    "root_daily_totals": q(
        f"SELECT {_day()}, root, {SUM_HITS} FROM t_root WHERE {IN_RANGE} AND root IN ({ROOT_LIST}) GROUP BY local_date, root"
    ),
    "root_range_totals": q(
        f"SELECT root, {SUM_HITS}, {total()} AS total_time_taken_second FROM t_root WHERE {IN_RANGE} AND root IN ({ROOT_LIST}) GROUP BY root"
    ),
    "service_daily_hits": q(
        f"SELECT {_day()}, {SUM_COUNTS} FROM t_service WHERE {IN_RANGE} AND site = 'arcgis' GROUP BY local_date"
    ),
    "service_daily_average_time": q(
        f"SELECT {_day()}, {SUM_TIMES} FROM t_service WHERE {IN_RANGE} AND site = 'arcgis' GROUP BY local_date"
    ),
    "service_detail_daily_hits": q(
        f"SELECT {_day()}, {SUM_COUNTS} FROM t_service WHERE {IN_RANGE} AND {service_is(*SERVICE)} GROUP BY local_date"
    ),
    "service_detail_daily_hits_all": q(
        f"SELECT {_day()}, {SVC}, {SUM_COUNTS} FROM t_service WHERE {IN_RANGE} GROUP BY local_date, {SVC}"
    ),
    "service_detail_daily_average_time": q(
        f"SELECT {_day()}, {SUM_TIMES} FROM t_service WHERE {IN_RANGE} AND {service_is(*FOLDERLESS)} GROUP BY local_date"
    ),
    "service_detail_daily_average_time_all": q(
        f"SELECT {_day()}, {SVC}, {SUM_TIMES} FROM t_service WHERE {IN_RANGE} GROUP BY local_date, {SVC}"
    ),
    "service_range_totals": q(
        f"SELECT {SVC}, {SUM_COUNTS}, {total('ok_ms + failed_ms')} AS total_time_taken_second FROM t_service "
        f"WHERE {IN_RANGE} AND {SITES} GROUP BY {SVC} ORDER BY site, folder NULLS FIRST, service_name, service_type"
    ),
    "portal_daily_hits": q(f"SELECT {_day()}, {SUM_COUNTS} FROM t_item WHERE {IN_RANGE} GROUP BY local_date"),
    "portal_item_daily_hits": q(
        f"SELECT {_day()}, {SUM_COUNTS} FROM t_item WHERE {IN_RANGE} AND portal_item_id = 'item4' GROUP BY local_date"
    ),
    "portal_item_daily_hits_all": q(
        f"SELECT {_day()}, portal_item_id, {SUM_COUNTS} FROM t_item WHERE {IN_RANGE} GROUP BY local_date, portal_item_id"
    ),
    "portal_item_range_totals": q(
        f"SELECT portal_item_id, {SUM_COUNTS}, {total()} AS total_time_taken_second FROM t_item WHERE {IN_RANGE} GROUP BY 1"
    ),
    "device_daily_hits": q(
        f"SELECT {_day()}, {SUM_HITS} FROM t_field WHERE {IN_RANGE} AND device_id = '{DEVICE}' GROUP BY local_date"
    ),
    "device_daily_hits_all": q(
        f"SELECT {_day()}, device_id, {SUM_HITS} FROM t_field WHERE {IN_RANGE} GROUP BY local_date, device_id"
    ),
    "device_range_totals": device_totals("t_field"),
    "device_range_totals_survey123": device_totals("t_survey"),
    "attribution_counts": attribution("t_field"),
    "attribution_counts_survey123": attribution("t_survey"),
    # 2.9
    "top_uris": top_flat("t_uri", "uri_stem"),
    "top_user_agents": top_flat("t_ua", "user_agent"),
    "top_referers": top_flat("t_referer", "referer", "referer <> '-'"),
    "top_forwarded_for_ips": top_flat("t_ip", "forwarded_for_ip"),
    "top_services_by_successful_hits": top_services("successful", False),
    "top_services_by_failed_hits": top_services("failed", False),
    "top_services_by_avg_successful_time": top_services("successful", True),
    "top_services_by_avg_failed_time": top_services("failed", True),
    "top_portal_items_by_successful_hits": top_items("successful"),
    "top_portal_items_by_failed_hits": top_items("failed"),
    "top_devices_field_maps": top_devices("t_field"),
    "top_devices_survey123": top_devices("t_survey"),
    # 2.11
    "harvest_by_uri": _harvested("t_uri"),
    "harvest_by_root": _harvested("t_root"),
    "harvest_by_user_agent": _harvested("t_ua"),
    "harvest_by_referer": _harvested("t_referer"),
    "harvest_by_forwarded_for_ip": _harvested("t_ip"),
    "harvest_by_referer_and_uri": _harvested("t_referer_uri"),
    "harvest_by_arcgis_service": _harvested("t_service"),
    "harvest_by_portal_item": _harvested("t_item"),
    "harvest_by_field_maps_device": _harvested("t_field", filled=True),
    "harvest_by_survey123_device": _harvested("t_survey", filled=True),
    "harvest_skipped": qt("SELECT file, CAST(file_utc_date AS VARCHAR) AS file_utc_date, reason FROM t_skipped"),
    "harvest_rejects": qt("SELECT file, line_no, reason FROM parsed WHERE reason IS NOT NULL"),
    "replace_daily_batch": rows("t_service", "local_date <> DATE '2024-01-05'"),
    "export_tsv": TSV,
    "export_tsv_root": TSV_ROOT,
    "export_tsv_service": TSV_SERVICE,
    "export_tsv_field_maps": tsv_device("t_field"),
    "export_tsv_survey123": tsv_device("t_survey"),
    # 2.12
    "mart_root_evolution": q(
        f"SELECT range, {_day()}, "
        + ", ".join(f"CAST(sum(hits) FILTER (WHERE root = '{r}') AS BIGINT) AS {r}" for r in ROOTS)
        + f" FROM {both_ranges('t_root')} WHERE root IN ({ROOT_LIST}) GROUP BY range, local_date"
    ),
    "mart_root_complete": q(
        "SELECT 'all' AS range, r.root, CAST(coalesce(sum(hits), 0) AS BIGINT) AS hits, "
        f"coalesce((round_even(({total()}) * 1000, 0) / 1e3), 0) AS total_time_taken_second, coalesce((round_even(({total()} / sum(hits)) * 1000, 0) / 1e3), 0) AS average_time_taken_second "
        f"FROM (SELECT unnest([{ROOT_LIST}]) AS root) r LEFT JOIN (SELECT * FROM t_root WHERE {IN_RANGE}) t ON t.root = r.root GROUP BY r.root"
    ),
    "mart_service_evolution": q(
        f"SELECT range, site, {_day()}, {SERIES} FROM {both_ranges('t_service')} WHERE {SITES} GROUP BY range, site, local_date"
    ),
    "mart_service_leaderboards": SERVICE_LEADERBOARDS,
    "mart_service_complete": q(
        f"SELECT 'all' AS range, {SVC}, {SUM_COUNTS}, {rounded_total('ok_ms + failed_ms')} FROM t_service WHERE {IN_RANGE} AND {SITES} GROUP BY {SVC}"
    ),
    "mart_service_detail": q(
        f"SELECT range, {SVC}, {_day()}, {SERIES}, {LABEL} AS label FROM {both_ranges('t_service')} WHERE {SITES} GROUP BY range, {SVC}, local_date"
    ),
    "mart_portal_evolution": q(
        f"SELECT range, {_day()}, CAST(sum(successful_hits) AS BIGINT) AS successful_hits, CAST(sum(failed_hits) AS BIGINT) AS failed_hits FROM {both_ranges('t_item')} GROUP BY range, local_date"
    ),
    "mart_portal_leaderboards": PORTAL_LEADERBOARDS,
    "mart_portal_complete": q(
        f"SELECT 'all' AS range, portal_item_id, {SUM_COUNTS}, {rounded_total()} FROM t_item WHERE {IN_RANGE} GROUP BY portal_item_id"
    ),
    "mart_portal_detail": q(
        f"SELECT range, portal_item_id, {_day()}, successful_hits, failed_hits FROM {both_ranges('t_item')}"
    ),
    "mart_device_leaderboard": device_leaderboard("t_field"),
    "mart_device_complete": device_complete("t_field"),
    "mart_device_detail": device_detail("t_field"),
    "mart_device_leaderboard_survey123": device_leaderboard("t_survey"),
    "mart_device_complete_survey123": device_complete("t_survey"),
    "mart_device_detail_survey123": device_detail("t_survey"),
    "mart_flat_leaderboards": FLAT_LEADERBOARDS,
    # 2.13
    "stream_daily_totals": rows("t_root"),
}

assert SQL.keys() == REGISTRY.keys(), SQL.keys() ^ REGISTRY.keys()
