"""SQL for DuckDB over the test tables, one text per query whose result plain SQL can state.

The texts start from the joined events and follow the definition of each result, not the plan of the Spark query.
Double constants are written with an exponent, as plain ones are decimals there.
"""

from __future__ import annotations

_BASE = """
WITH biz AS (
  SELECT CAST(c_custkey AS VARCHAR) AS business_id, c_name AS business_name, n_name AS city, r_name AS state,
         30.0e0 + c_nationkey * 0.5e0 + (c_custkey % 7) * 0.004e0 AS latitude,
         -115.0e0 + c_nationkey * 0.5e0 + (c_custkey % 5) * 0.004e0 AS longitude,
         CAST(1 + c_custkey % 5 AS DOUBLE) AS business_stars,
         p_name, p_type
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       LEFT JOIN part ON p_partkey = c_custkey
), rev AS (
  SELECT CAST(event_id AS VARCHAR) AS review_id, CAST(user_id AS VARCHAR) AS business_id, event_type AS user_id,
         CAST(1 + (event_id * 7 + user_id * 3) % 5 AS DOUBLE) AS review_stars, ts AS event_time,
         event_type || ' ' || props AS review_text
  FROM events
), e AS (
  SELECT rev.*, business_name, city, state, latitude, longitude, business_stars, p_name, p_type
  FROM rev JOIN biz ON rev.business_id = biz.business_id
), g AS (
  SELECT *, 'grid' AS area_type,
         CAST(CAST(floor(latitude / (2.0e0 / 111.0e0)) AS BIGINT) AS VARCHAR) || '_' ||
         CAST(CAST(floor(longitude / (2.0e0 / 111.0e0)) AS BIGINT) AS VARCHAR) AS area_id,
         round((floor(latitude / (2.0e0 / 111.0e0)) + 0.5e0) * (2.0e0 / 111.0e0), 6) AS lat,
         round((floor(longitude / (2.0e0 / 111.0e0)) + 0.5e0) * (2.0e0 / 111.0e0), 6) AS lon
  FROM e
), x AS (
  SELECT g.*, trim(u.item) AS category
  FROM g, unnest(string_split(replace(p_name, ' ', ', ') || ', ' || p_type, ',')) AS u(item)
  WHERE trim(u.item) <> ''
)
"""

_VOLUME = """
WITH e AS (
  SELECT CAST(1 + (l_orderkey * 7 + l_suppkey * 3 + l_linenumber) % 5 AS DOUBLE) AS review_stars,
         l_shipdate AS event_time, n_name AS city, r_name AS state,
         30.0e0 + s_nationkey * 0.5e0 + (s_suppkey % 7) * 0.004e0 AS latitude,
         -115.0e0 + s_nationkey * 0.5e0 + (s_suppkey % 5) * 0.004e0 AS longitude
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), g AS (
  SELECT *, 'grid' AS area_type,
         CAST(CAST(floor(latitude / (2.0e0 / 111.0e0)) AS BIGINT) AS VARCHAR) || '_' ||
         CAST(CAST(floor(longitude / (2.0e0 / 111.0e0)) AS BIGINT) AS VARCHAR) AS area_id,
         round((floor(latitude / (2.0e0 / 111.0e0)) + 0.5e0) * (2.0e0 / 111.0e0), 6) AS lat,
         round((floor(longitude / (2.0e0 / 111.0e0)) + 0.5e0) * (2.0e0 / 111.0e0), 6) AS lon
  FROM e
)
"""

_DAY = 86_400_000_000


def _windows(length: int, slide: int) -> str:
    """CTE ``w``: single events copied to every window that holds them; window start and end."""
    copies = ", ".join(str(k) for k in range(-(-length // slide)))
    return f""", c AS (
  SELECT g.*, make_timestamp((epoch_us(event_time) // {slide} - k) * {slide}) AS window_start
  FROM g, (SELECT unnest([{copies}]) AS k) AS copies
), w AS (
  SELECT *, window_start + to_microseconds({length}) AS window_end FROM c
  WHERE event_time < window_start + to_microseconds({length})
)"""


def _scored(length: int, slide: int, min_events: int = 3) -> str:
    """CTE ``h``: unrounded window hotspots, baseline by a join back on the area."""
    return _windows(length, slide) + f""", a AS (
  SELECT area_type, area_id, city, state, lat AS latitude, lon AS longitude, window_start, window_end,
         count(*) AS event_count, avg(review_stars) AS avg_stars
  FROM w GROUP BY ALL
), b AS (
  SELECT area_id, city, state, avg(event_count) AS baseline_count, avg(avg_stars) AS baseline_stars
  FROM a GROUP BY ALL
), h AS (
  SELECT a.*, baseline_count, baseline_stars, event_count / baseline_count AS hotspot_score,
         avg_stars - baseline_stars AS rating_change
  FROM a JOIN b USING (area_id, city, state) WHERE event_count >= {min_events}
)"""


_ROUNDED_SCORES = ", ".join(
    f"round({name}, 6) AS {name}"
    for name in ("avg_stars", "baseline_count", "baseline_stars", "hotspot_score", "rating_change")
)
_WINDOW_COLUMNS = (
    "area_type, area_id, city, state, latitude, longitude, window_start, window_end, event_count, " + _ROUNDED_SCORES
)
_DAILY = _BASE + _scored(_DAY, _DAY // 2)
_EMERGING = """, m AS (
  SELECT * FROM h WHERE hotspot_score >= 1.5 AND rating_change >= 0.5
  QUALIFY row_number() OVER (PARTITION BY city, state, area_id ORDER BY window_end DESC) = 1
)"""
_CITY_WINDOWS = """, s AS (
  SELECT city, state, window_start, window_end, count(*) AS event_count, avg(review_stars) AS avg_stars
  FROM w GROUP BY ALL
)"""

# Current counts and all-time counts are taken separately and joined, each with its own totals.
_MIX = _BASE + """, t AS (
  SELECT max(event_time) AS latest FROM x
), cur AS (
  SELECT area_type, area_id, city, state, lat, lon, category, count(*) AS n
  FROM x, t WHERE event_time >= latest - INTERVAL 3 DAY GROUP BY ALL
), usual AS (
  SELECT area_id, city, state, category, count(*) AS n FROM x GROUP BY ALL
), cur_total AS (
  SELECT area_id, sum(n) AS n FROM cur GROUP BY ALL
), usual_total AS (
  SELECT area_id, sum(n) AS n FROM usual GROUP BY ALL
), mix AS (
  SELECT cur.area_type, cur.area_id, cur.city, cur.state, cur.lat AS latitude, cur.lon AS longitude, cur.category,
         cur.n AS current_count, cur.n / cur_total.n AS current_share, usual.n / usual_total.n AS baseline_share,
         cur.n / cur_total.n - usual.n / usual_total.n AS anomaly_score, latest AS window_end
  FROM cur JOIN cur_total USING (area_id)
       JOIN usual ON usual.area_id = cur.area_id AND usual.city = cur.city AND usual.state = cur.state
                 AND usual.category = cur.category
       JOIN usual_total ON usual_total.area_id = cur.area_id, t
)"""
_ROUNDED_SHARES = ", ".join(
    f"round({name}, 6) AS {name}" for name in ("current_share", "baseline_share", "anomaly_score")
)

_CITY_TOTALS = "SELECT city, state, count(*) AS review_count, round(avg(review_stars), 6) AS avg_stars FROM e GROUP BY ALL"
_CELLS = (
    "SELECT city, state, area_id AS grid_id, lat AS latitude, lon AS longitude, count(*) AS review_count, "
    "round(avg(review_stars), 6) AS avg_stars FROM g GROUP BY ALL"
)
_LEADERS = (
    "SELECT city, category, count(*) AS review_count, round(avg(review_stars), 6) AS avg_stars FROM x GROUP BY ALL"
)
_ISO = (
    "CASE WHEN epoch_us(event_time) % 1000000 = 0 THEN strftime(event_time, '%Y-%m-%dT%H:%M:%S') "
    "ELSE strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f') END"
)


def _latest(limit: int) -> str:
    return f"""SELECT review_id, business_id, business_name, city, state, review_stars AS stars,
         {_ISO} AS review_date, substring(review_text, 1, 280) AS summary
  FROM e ORDER BY event_time DESC, review_id, business_id LIMIT {limit}"""


_BUSINESSES = "SELECT DISTINCT business_id, city, state, latitude, longitude FROM e"
_CITY_WINDOW_HOTSPOTS = "SELECT * FROM h WHERE city = 'NATION_7' AND event_count >= 5 AND hotspot_score >= 1.2e0"

ORACLES: dict[str, str] = {
    "enriched_events": _BASE + """
SELECT review_id, business_id, user_id, review_stars, event_time AS review_date, review_text, business_name, city,
       state, latitude, longitude, business_stars, replace(p_name, ' ', '|') || '|' || p_type AS categories
FROM e""",
    "cleaned_reviews": _BASE + """
SELECT review_id, business_id, user_id, review_stars, event_time AS review_date, review_text FROM rev""",
    "parsed_dates": """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1) THEN date_trunc('second', o_orderdate)
         WHEN o_orderkey % 5 = 4 THEN NULL ELSE date_trunc('day', o_orderdate) END::TIMESTAMP AS parsed
FROM orders""",
    "order_dates_kept": """
SELECT CAST(o_orderkey AS VARCHAR) AS review_id, CAST(o_custkey AS VARCHAR) AS business_id,
       CASE WHEN o_orderkey % 5 IN (0, 1) THEN date_trunc('second', o_orderdate)
         ELSE date_trunc('day', o_orderdate) END::TIMESTAMP AS review_date
FROM orders WHERE o_orderkey % 5 <> 4""",
    "order_dates_rejected": """
SELECT CAST(o_orderkey AS VARCHAR) AS review_id, CAST(o_custkey AS VARCHAR) AS business_id,
       'on ' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS date
FROM orders WHERE o_orderkey % 5 = 4""",
    "oldest_reviews": _BASE + """
SELECT review_id, business_id, review_stars, event_time AS review_date
FROM rev ORDER BY event_time, review_id, business_id LIMIT 1000""",
    "oldest_reviews_by_day": """
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS review_id, CAST(l_suppkey AS VARCHAR) AS business_id,
       CAST(1 + (l_orderkey * 7 + l_suppkey * 3 + l_linenumber) % 5 AS DOUBLE) AS review_stars, l_shipdate AS review_date
FROM lineitem ORDER BY review_date, review_id, business_id LIMIT 3333""",
    "event_categories": _BASE + "SELECT review_id, city, review_stars, category FROM x",
    "event_grid_cells": _BASE + """
SELECT business_id, city, state, area_id AS grid_id, lat AS latitude, lon AS longitude, review_stars, event_time
FROM g""",
    "category_events": _BASE + """
SELECT business_id, area_type, area_id, city, state, lat AS latitude, lon AS longitude, category, event_time FROM x""",
    "city_metrics": _BASE + _CITY_TOTALS,
    "city_metrics_volume": _VOLUME + _CITY_TOTALS,
    "grid_hotspots": _BASE + _CELLS,
    "grid_hotspots_volume": _VOLUME + _CELLS,
    "category_leaders": _BASE + _LEADERS,
    "latest_reviews": _BASE + _latest(200),
    "business_projection": _BASE + f"""
SELECT business_id, city, state, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude
FROM ({_BUSINESSES})""",
    "dense_city_counts": _BASE + f"""
SELECT city, count(*) AS business_count FROM ({_BUSINESSES}) GROUP BY city HAVING count(*) >= 6""",
    "cluster_counts": _BASE + f"""
SELECT city, count(*) AS business_count,
       CAST(CASE WHEN count(*) <= 1 THEN 1 ELSE greatest(2, least(12, floor(sqrt(count(*))))) END AS INTEGER)
         AS cluster_count
FROM ({_BUSINESSES}) GROUP BY city""",
    "window_hotspots": _DAILY + f" SELECT {_WINDOW_COLUMNS} FROM h",
    "window_hotspots_tumbling": _BASE + _scored(_DAY, _DAY) + f" SELECT {_WINDOW_COLUMNS} FROM h",
    "window_hotspots_volume": _VOLUME + _scored(30 * _DAY, 10 * _DAY) + f" SELECT {_WINDOW_COLUMNS} FROM h",
    "emerging_areas": _DAILY + _EMERGING + f" SELECT {_WINDOW_COLUMNS} FROM m",
    "city_activity_windows": _BASE + _windows(_DAY, _DAY // 2) + _CITY_WINDOWS + """
SELECT city, state, window_start, window_end, event_count, round(avg_stars, 6) AS avg_stars FROM s""",
    "city_activity_minutely": _BASE + f""", m AS (
  SELECT city, state, make_timestamp((epoch_us(event_time) // 60000000 - k) * 60000000) AS window_start, count(*) AS n, sum(review_stars) AS stars
  FROM e, range(1440) AS copies(k) GROUP BY ALL
)
SELECT city, state, CAST(CAST(window_start AS DATE) AS VARCHAR) AS day, count(*) AS windows, CAST(sum(n) AS BIGINT) AS events,
       max(n) AS most_events, round(sum(stars), 6) AS stars
FROM m GROUP BY ALL""",
    "area_pane_totals": _BASE + f"""
SELECT area_type, area_id, city, state, lat AS latitude, lon AS longitude,
       make_timestamp(epoch_us(event_time) // {_DAY // 2} * {_DAY // 2}) AS pane_start,
       count(*) AS event_count, sum(review_stars) AS stars_sum
FROM g GROUP BY ALL""",
    "category_mix": _MIX + f"""
SELECT area_type, area_id, city, state, latitude, longitude, category, current_count, {_ROUNDED_SHARES}, window_end
FROM mix""",
    "city_options": _BASE + "SELECT DISTINCT city FROM e",
    "default_city": _BASE + """
SELECT CASE WHEN bool_or(city = 'NATION_7') THEN 'NATION_7' ELSE min(city) END AS city FROM e""",
    "category_options": _MIX + " SELECT DISTINCT category FROM mix WHERE city = 'NATION_7'",
    "area_options": _DAILY + " SELECT DISTINCT area_id FROM h WHERE city = 'NATION_7' AND area_type = 'grid'",
    "area_type_options": _DAILY + " SELECT DISTINCT area_type FROM h WHERE city = 'NATION_7'",
    "city_hotspots": _BASE + f"SELECT * FROM ({_CELLS}) WHERE city = 'NATION_7' AND review_count >= 5",
    "map_midpoint": _BASE + f"""
SELECT round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude
FROM ({_CELLS}) WHERE city = 'NATION_7' AND review_count >= 5""",
    "city_emerging": _DAILY + _EMERGING + """
SELECT area_type, area_id, event_count, round(hotspot_score, 6) AS hotspot_score, round(avg_stars, 6) AS avg_stars,
       round(rating_change, 6) AS rating_change, window_start
FROM m WHERE city = 'NATION_7'""",
    "city_window_hotspots": _DAILY + f"""
SELECT {_WINDOW_COLUMNS} FROM ({_CITY_WINDOW_HOTSPOTS})
WHERE CAST(window_start AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-27'""",
    "window_date_bounds": _DAILY + f"""
SELECT CAST(min(CAST(window_start AS DATE)) AS VARCHAR) AS first_day,
       CAST(max(CAST(window_start AS DATE)) AS VARCHAR) AS last_day
FROM ({_CITY_WINDOW_HOTSPOTS})""",
    "area_series": _DAILY + """
SELECT area_type, area_id, window_start, event_count, round(hotspot_score, 6) AS hotspot_score,
       round(avg_stars, 6) AS avg_stars, round(rating_change, 6) AS rating_change
FROM h WHERE city = 'NATION_7' AND area_type = 'grid' AND area_id = '1859_-6189'""",
    "areas_with_category": _MIX + " SELECT DISTINCT area_type, area_id FROM mix WHERE category = 'ECONOMY'",
    "area_top_categories": _MIX + f"""
SELECT category, current_count, {_ROUNDED_SHARES}
FROM mix WHERE city = 'NATION_7' AND area_id = '1859_-6189'
ORDER BY mix.current_share DESC, category, state LIMIT 10""",
    "area_chosen_category": _MIX + f"""
SELECT category, current_count, {_ROUNDED_SHARES}
FROM mix WHERE city = 'NATION_7' AND area_id = '1859_-6189' AND category = 'ECONOMY'
ORDER BY mix.current_share DESC, category, state LIMIT 10""",
    "top_categories_by_area": _MIX + f""", r AS (
  SELECT *, row_number() OVER (PARTITION BY city, area_id ORDER BY current_share DESC, category, state) AS rank
  FROM mix
)
SELECT city, area_type, area_id, CAST(rank AS INTEGER) AS rank, category, current_count, {_ROUNDED_SHARES}
FROM r WHERE rank <= 10""",
    "activity_series_thinned": _VOLUME + _windows(30 * _DAY, 10 * _DAY) + _CITY_WINDOWS + """, n AS (
  SELECT *, row_number() OVER (PARTITION BY city ORDER BY window_start, state) - 1 AS position,
         ceil(count(*) OVER (PARTITION BY city) / 50.0e0) AS step
  FROM s
)
SELECT city, state, window_start, window_end, event_count, round(avg_stars, 6) AS avg_stars
FROM n WHERE position % CAST(step AS BIGINT) = 0""",
    "city_activity_series": _BASE + _windows(_DAY, _DAY // 2) + _CITY_WINDOWS + """
SELECT city, state, window_start, window_end, event_count, round(avg_stars, 6) AS avg_stars
FROM s WHERE city = 'NATION_7'""",
    "city_leaderboard": _BASE + f"SELECT * FROM ({_CITY_TOTALS}) ORDER BY review_count DESC, city, state LIMIT 20",
    "top_city_categories": _BASE + f"""
SELECT * FROM ({_LEADERS}) WHERE city = 'NATION_7' ORDER BY review_count DESC, category LIMIT 20""",
    "recent_feed": _BASE + _latest(50),
}
ORACLES["area_choice"] = _MIX + _scored(_DAY, _DAY // 2) + """
SELECT DISTINCT area_type, area_id FROM h
WHERE city = 'NATION_7' AND area_id IN (SELECT area_id FROM mix WHERE category = 'ECONOMY' AND city = 'NATION_7')"""

# A stream that has ended has the tables of a batch over the same events.
for _name in ("city_metrics", "window_hotspots", "category_mix"):
    ORACLES[f"streamed_{_name}"] = ORACLES[_name]
ORACLES["watermarked_window_hotspots"] = ORACLES["window_hotspots"]

# Without the events that came too late, and only windows that had closed a day before the newest event.
ORACLES["watermarked_closed_windows"] = (
    _BASE.replace("FROM events", "FROM events WHERE NOT (event_id % 10 = 0 AND ts < '2024-01-11')")
    + _scored(_DAY, _DAY // 2).replace("FROM w GROUP BY ALL", "FROM w WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL", 1)
    + f" SELECT {_WINDOW_COLUMNS} FROM h"
)

_IN_DENSE_CITY = f"city IN (SELECT city FROM ({_BUSINESSES}) GROUP BY city HAVING count(*) >= 6)"
ORACLES["neighborhood_fit_checks"] = _BASE + f"""
SELECT city, count(*) AS business_count, count(*) AS assigned, CAST(0 AS BIGINT) AS with_a_nearer_center,
       CAST(0 AS BIGINT) AS centers_off_their_mean, CAST(0 AS BIGINT) AS clusters_beyond_the_bound
FROM ({_BUSINESSES}) GROUP BY city HAVING count(*) >= 6"""
ORACLES["neighborhood_fit_quality"] = _BASE + f"""
SELECT city, count(*) AS business_count, CAST(greatest(2, least(12, floor(sqrt(count(*))))) AS INTEGER) AS cluster_count,
       round((var_pop(latitude) + var_pop(longitude)) * count(*), 9) AS total_squares, TRUE AS near_even_parts
FROM ({_BUSINESSES}) GROUP BY city HAVING count(*) >= 6"""
ORACLES["neighborhood_city_totals"] = _BASE + f"SELECT * FROM ({_CITY_TOTALS}) WHERE {_IN_DENSE_CITY}"
ORACLES["neighborhood_cities"] = _BASE + f"SELECT DISTINCT city FROM e WHERE {_IN_DENSE_CITY}"
ORACLES["neighborhood_window_totals"] = _BASE + _windows(_DAY, _DAY // 2) + f"""
SELECT city, state, window_start, window_end, count(*) AS event_count FROM w WHERE {_IN_DENSE_CITY} GROUP BY ALL"""
ORACLES["neighborhood_category_totals"] = _MIX + f"""
SELECT city, state, category, CAST(sum(current_count) AS BIGINT) AS current_count
FROM mix WHERE {_IN_DENSE_CITY} GROUP BY ALL"""
for _name in ("city_metrics", "grid_hotspots", "category_leaders", "latest_reviews", "window_hotspots"):
    ORACLES[f"static_job_{_name}"] = ORACLES[_name]
ORACLES["file_stream_window_hotspots"] = ORACLES["window_hotspots"]
ORACLES["static_job_review_counts"] = ORACLES["file_stream_review_counts"] = """
SELECT 'kept' AS outcome, count(*) AS rows FROM events UNION ALL SELECT 'malformed', 1
UNION ALL SELECT 'without_key', count(*) FROM events WHERE event_id % 97 = 0
UNION ALL SELECT 'undated', count(*) FROM events WHERE event_id % 89 = 0"""
ORACLES["located_places"] = _BASE + """
SELECT business_id, city, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM biz
WHERE NOT (business_id::BIGINT % 7 = 0 OR business_id::BIGINT % 11 = 0 OR business_id::BIGINT % 13 = 0 OR business_id::BIGINT % 17 = 0)"""
ORACLES["appended_city_metrics"] = _BASE + """
SELECT city, state, count(*) AS review_count, round(avg(review_stars), 6) AS avg_stars FROM e GROUP BY city, state, review_id::BIGINT % 3"""
