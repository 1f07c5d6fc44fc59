"""The queries of ``registry.py`` as plain SQL, written independently of the operators."""

from __future__ import annotations

VIEWS = {
    "snap": """
SELECT user_id AS schedule_id, event_type AS seat_type,
  CAST(user_id % 3 AS INTEGER) AS operator_id, ts AS snapshot_ts, CAST(ts AS DATE) AS date_of_journey,
  '0' || CAST(hour(ts) % 4 AS VARCHAR) || ':00:00' AS departure_time,
  CAST(3 * (23 - hour(ts)) AS DOUBLE) AS hours_before_departure,
  CAST(value AS DECIMAL(18,2)) AS actual_fare,
  CASE WHEN k % 10 <> 0 THEN CAST(k AS DECIMAL(18,2)) END AS price,
  CASE WHEN k % 7 <> 0 THEN CAST(k AS DECIMAL(10,2)) END AS actual_occupancy,
  CAST(100 - k AS DECIMAL(10,2)) AS expected_occupancy,
  CASE k % 4 WHEN 0 THEN 'M/L' WHEN 1 THEN CAST(k AS VARCHAR) || '.5'
    WHEN 2 THEN CAST(k AS VARCHAR) END AS demand_index
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "raw_snap": """
SELECT CAST(user_id AS VARCHAR) AS schedule_id, event_type AS seat_type,
  CAST(user_id % 3 AS VARCHAR) AS operator_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date_of_journey,
  CASE WHEN k % 9 = 0 THEN 'soon' ELSE CAST(3 * (23 - hour(ts)) AS VARCHAR) END AS hours_before_departure,
  CASE WHEN k % 10 = 0 THEN '' WHEN k % 10 = 1 THEN 'abc' WHEN k % 10 = 2 THEN 'None'
    ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS actual_fare,
  CASE WHEN k % 6 = 0 THEN ' ' ELSE CAST(k AS VARCHAR) END AS price,
  strftime(ts, '%d-%m-%Y %H:%M:%S') AS stamp_text
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "seat": """
SELECT l_orderkey AS schedule_id, l_linenumber AS seat_number,
  l_returnflag AS seat_type,
  CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS final_price,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS actual_fare,
  l_partkey AS coach_layout_id, CAST(l_quantity AS INTEGER) AS sales_count,
  CAST(CAST(l_discount AS DECIMAL(4,2)) * 100 AS DECIMAL(10,2)) AS sales_percentage,
  l_suppkey AS operator_reservation_id,
  CAST(CASE WHEN o_custkey % 2 = 0 THEN 1646 ELSE 7 END AS INTEGER) AS origin_id,
  CAST(CASE WHEN o_custkey % 3 = 0 THEN 1821 ELSE 8 END AS INTEGER) AS destination_id,
  CAST(o_orderdate AS DATE) AS travel_date, l_shipdate AS snapshot_ts
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "trip": """
SELECT DISTINCT l_orderkey AS schedule_id, l_returnflag AS seat_type,
  l_shipdate AS snapshot_ts, CAST(month(l_shipdate) AS DOUBLE) AS hours_before_departure,
  CAST(o_orderdate AS DATE) AS date_of_journey, CAST(o_custkey % 3 AS INTEGER) AS operator_id,
  '0' || CAST(l_orderkey % 4 AS VARCHAR) || ':00:00' AS departure_time
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "snap_latest": """
SELECT s.* FROM snap s JOIN (SELECT date_of_journey, schedule_id, seat_type, max(snapshot_ts) AS m
  FROM snap GROUP BY ALL) x ON s.date_of_journey = x.date_of_journey AND s.schedule_id = x.schedule_id
  AND s.seat_type = x.seat_type AND s.snapshot_ts = x.m""",
    "seat_day_latest": """
SELECT s.* FROM seat s JOIN (SELECT travel_date, schedule_id, seat_number, max(snapshot_ts) AS m
  FROM seat GROUP BY ALL) x ON s.travel_date = x.travel_date AND s.schedule_id = x.schedule_id
  AND s.seat_number = x.seat_number AND s.snapshot_ts = x.m""",
    "snap_hour": """
SELECT * FROM snap QUALIFY row_number() OVER (PARTITION BY schedule_id, seat_type, hours_before_departure
  ORDER BY snapshot_ts DESC, actual_fare NULLS LAST, price NULLS LAST, expected_occupancy NULLS LAST) = 1""",
    "seats_newest": """
SELECT schedule_id, snapshot_ts, seat_number, actual_fare, final_price
FROM (SELECT * FROM seat s WHERE snapshot_ts =
        (SELECT max(snapshot_ts) FROM seat t WHERE t.schedule_id = s.schedule_id))
QUALIFY row_number() OVER (PARTITION BY schedule_id, seat_number
  ORDER BY coach_layout_id, operator_reservation_id, sales_count) = 1""",
    "feed": """
SELECT CAST(expected_occupancy AS DOUBLE) AS expected_occupancy,
  CAST(actual_occupancy AS DOUBLE) AS actual_occupancy, demand_index,
  CAST(NULL AS VARCHAR) AS time_step_to_check, operator_id, date_of_journey,
  CAST(NULL AS VARCHAR) AS time_slot, seat_type, hours_before_departure, CAST(price AS DOUBLE) AS price,
  CAST(NULL AS VARCHAR) AS origin, CAST(NULL AS VARCHAR) AS destination,
  CAST(actual_fare AS DOUBLE) AS actual_fare, CAST(schedule_id AS VARCHAR) AS schedule_id, CAST(NULL AS VARCHAR) AS coach_layout_id,
  departure_time, CAST(snapshot_ts AS DATE) AS snapshot_date,
  CASE WHEN hour(snapshot_ts) < 12 THEN '00:00:00' ELSE '12:00:00' END AS snapshot_time,
  date_trunc('day', snapshot_ts)
    + CASE WHEN hour(snapshot_ts) < 12 THEN INTERVAL 0 HOUR ELSE INTERVAL 12 HOUR END AS snapshot_ts,
  date_of_journey - CAST(dayofweek(date_of_journey) AS INTEGER) AS week_start
FROM snap""",
    "feed_table": """
SELECT * FROM feed QUALIFY row_number() OVER (PARTITION BY date_of_journey, schedule_id, seat_type, snapshot_ts
  ORDER BY expected_occupancy NULLS LAST, actual_occupancy NULLS LAST, demand_index NULLS LAST,
    operator_id NULLS LAST, hours_before_departure NULLS LAST, price NULLS LAST, actual_fare NULLS LAST,
    departure_time NULLS LAST) = 1""",
}

_SNAP_COLS = """schedule_id, seat_type, operator_id, snapshot_ts, date_of_journey, departure_time,
  hours_before_departure, CAST(actual_fare AS DOUBLE) AS actual_fare, CAST(price AS DOUBLE) AS price,
  CAST(actual_occupancy AS DOUBLE) AS actual_occupancy,
  CAST(expected_occupancy AS DOUBLE) AS expected_occupancy, demand_index"""

_SEAT_COLS = """schedule_id, seat_number, seat_type, CAST(final_price AS DOUBLE) AS final_price,
  CAST(actual_fare AS DOUBLE) AS actual_fare, coach_layout_id, sales_count,
  CAST(sales_percentage AS DOUBLE) AS sales_percentage, operator_reservation_id, origin_id,
  destination_id, travel_date, snapshot_ts"""

_STATUS = "CASE WHEN {m} > {a} THEN 'favourable' WHEN {m} < {a} THEN 'unfavourable' ELSE 'neutral' END"

_DAY_SUM = (
    """
SELECT date_of_journey, CAST(a AS DOUBLE) AS actual_sum, CAST(m AS DOUBLE) AS model_sum,
  CAST(a - m AS DOUBLE) AS delta, CAST(abs(a - m) AS DOUBLE) AS abs_delta, """
    + _STATUS.format(a="a", m="m")
    + """ AS status
FROM (SELECT d.date_of_journey, coalesce(sum(c.actual_fare), 0) AS a, coalesce(sum(c.model), 0) AS m
      FROM {dates} d LEFT JOIN chosen c ON c.schedule_id = d.schedule_id GROUP BY 1)"""
)

_MONTH_SUM = """
SELECT year, month, CAST(count(DISTINCT d.schedule_id) AS BIGINT) AS schedule_count,
  CAST(coalesce(sum(c.actual_fare), 0) AS DOUBLE) AS total_actual_price,
  CAST(coalesce(sum(c.model), 0) AS DOUBLE) AS total_model_price,
  CAST(coalesce(sum(c.actual_fare), 0) - coalesce(sum(c.model), 0) AS DOUBLE) AS price_difference
FROM (SELECT DISTINCT CAST(year(date_of_journey) AS INTEGER) AS year,
        CAST(month(date_of_journey) AS INTEGER) AS month, schedule_id FROM {snaps}) d
LEFT JOIN chosen c ON c.schedule_id = d.schedule_id GROUP BY year, month"""

_CHOSEN_SNAP_TYPE = """chosen AS (
  SELECT s.schedule_id, s.actual_fare, s.price AS model FROM snap s JOIN (
    SELECT schedule_id, seat_type, snapshot_ts FROM snap QUALIFY row_number() OVER (
      PARTITION BY schedule_id, seat_type ORDER BY hours_before_departure, snapshot_ts DESC) = 1) l
  ON s.schedule_id = l.schedule_id AND s.seat_type = l.seat_type AND s.snapshot_ts = l.snapshot_ts)"""

_CHOSEN_SNAP = """chosen AS (
  SELECT s.schedule_id, s.actual_fare, s.price AS model FROM snap s JOIN (
    SELECT schedule_id, snapshot_ts FROM snap QUALIFY row_number() OVER (
      PARTITION BY schedule_id ORDER BY hours_before_departure, snapshot_ts DESC) = 1) l
  ON s.schedule_id = l.schedule_id AND s.snapshot_ts = l.snapshot_ts)"""

_CHOSEN_SEAT = """chosen AS (
  SELECT s.schedule_id, s.actual_fare, s.final_price AS model FROM seat s JOIN (
    SELECT schedule_id, seat_number, max(snapshot_ts) AS m FROM seat GROUP BY ALL) l
  ON s.schedule_id = l.schedule_id AND s.seat_number = l.seat_number AND s.snapshot_ts = l.m)"""

_CHOSEN_SEAT_HOUR = """chosen AS (
  SELECT s.schedule_id, s.actual_fare, s.final_price AS model FROM seat s JOIN (
    SELECT t.schedule_id, t.seat_number, t.snapshot_ts FROM
      (SELECT DISTINCT schedule_id, seat_number, snapshot_ts FROM seat) t LEFT JOIN
      (SELECT schedule_id, snapshot_ts, min(hours_before_departure) AS h FROM trip GROUP BY ALL) h
      ON t.schedule_id = h.schedule_id AND t.snapshot_ts = h.snapshot_ts
    QUALIFY row_number() OVER (PARTITION BY t.schedule_id, t.seat_number
      ORDER BY h.h NULLS LAST, t.snapshot_ts DESC) = 1) l
  ON s.schedule_id = l.schedule_id AND s.seat_number = l.seat_number AND s.snapshot_ts = l.snapshot_ts)"""


def _means(source: str, key: str, model: str, zero: bool, occupancy: bool) -> str:
    def mean(c: str) -> str:
        n = "count(*)" if zero else f"count({c})"
        return f"CASE WHEN {n} > 0 THEN coalesce(CAST(sum({c}) AS DOUBLE), 0) / {n} ELSE 0.0 END"

    occ = mean("actual_occupancy") if occupancy else "CAST(0 AS DOUBLE)"
    exp = mean("expected_occupancy") if occupancy else "CAST(0 AS DOUBLE)"
    return f"""SELECT *, avg_actual_fare - avg_model_price AS avg_delta,
  CASE WHEN avg_model_price <> 0 THEN (avg_actual_fare - avg_model_price) / avg_model_price * 100
    ELSE 0.0 END AS avg_delta_pct
FROM (SELECT {key}, {mean("actual_fare")} AS avg_actual_fare, {mean(model)} AS avg_model_price,
        {occ} AS avg_occupancy, {exp} AS avg_expected_occupancy FROM {source} GROUP BY {key})"""


_OFFER_TYPE = """
SELECT s.date_of_journey, s.departure_time, s.operator_id,
  CASE WHEN s.operator_id = 0 THEN 'model' ELSE 'actual' END AS role, s.schedule_id, s.seat_type,
  s.hours_before_departure,
  CASE WHEN s.operator_id = 0 THEN s.price ELSE s.actual_fare END AS price
FROM snap s JOIN (
  SELECT date_of_journey, departure_time, operator_id, schedule_id, seat_type, max(snapshot_ts) AS m
  FROM snap GROUP BY ALL) x
ON s.date_of_journey = x.date_of_journey AND s.departure_time = x.departure_time
  AND s.operator_id = x.operator_id AND s.schedule_id = x.schedule_id
  AND s.seat_type = x.seat_type AND s.snapshot_ts = x.m"""

_OFFER_SEAT = """
SELECT r.date_of_journey, r.departure_time, r.operator_id,
  CASE WHEN r.operator_id = 0 THEN 'model' ELSE 'actual' END AS role, s.schedule_id, s.seat_number,
  TRY_CAST(s.seat_number AS BIGINT) AS seat_no, s.seat_type,
  CASE WHEN r.operator_id = 0 THEN s.final_price ELSE s.actual_fare END AS price
FROM seat_day_latest s JOIN (
  SELECT DISTINCT date_of_journey, departure_time, operator_id, schedule_id FROM trip) r
ON s.travel_date = r.date_of_journey AND s.schedule_id = r.schedule_id"""

_OFFER_STATS = """
SELECT m.date_of_journey, m.departure_time, m.operator_id AS model_operator, m.n AS model_count,
  CAST(m.t AS DOUBLE) AS model_total, m.a AS model_avg, o.operator_id AS actual_operator,
  o.n AS actual_count, CAST(o.t AS DOUBLE) AS actual_total, o.a AS actual_avg,
  CAST(o.t - m.t AS DOUBLE) AS price_diff, CAST(abs(o.t - m.t) AS DOUBLE) AS abs_price_diff
FROM stats m JOIN stats o ON m.date_of_journey = o.date_of_journey
  AND m.departure_time = o.departure_time
WHERE m.operator_id = 0 AND o.operator_id <> 0"""

_STATS = """stats AS (SELECT date_of_journey, departure_time, operator_id, count(*) AS n,
  coalesce(sum(price), 0) AS t, CAST(sum(price) AS DOUBLE) / count(price) AS a
  FROM offers GROUP BY ALL)"""

_DISTINCT_PRICES = """
SELECT date_of_journey, operator_id, departure_time, schedule_id, seat_type, hours_before_departure,
  snapshot_ts, CAST(actual_fare AS DOUBLE) AS actual_fare, CAST({price} AS DOUBLE) AS price,
  CAST(coalesce(actual_occupancy, 0) AS DOUBLE) AS actual_occupancy,
  CAST(coalesce(expected_occupancy, 0) AS DOUBLE) AS expected_occupancy
FROM snap QUALIFY row_number() OVER (PARTITION BY date_of_journey, operator_id, departure_time,
  schedule_id, seat_type, hours_before_departure
  ORDER BY snapshot_ts DESC, actual_fare, price NULLS LAST, expected_occupancy) = 1"""


def _nearest(requests: str) -> str:
    return f"""
SELECT q.schedule_id, q.x AS requested_hours, s.h AS matched_hours, s.ts AS snapshot_ts
FROM ({requests}) q JOIN (SELECT schedule_id, hours_before_departure AS h, max(snapshot_ts) AS ts
  FROM snap GROUP BY ALL) s ON q.schedule_id = s.schedule_id
QUALIFY row_number() OVER (PARTITION BY q.schedule_id, q.x
  ORDER BY CASE WHEN abs(s.h - q.x) < 0.01 THEN 0 ELSE abs(s.h - q.x) END, s.ts DESC) = 1"""


_HOURS = "VALUES (0.0::DOUBLE), (1.5), (10.5), (24.004), (48.0), (100.0)"

_PROFILE_COLUMNS = (
    "schedule_id", "seat_type", "departure_time", "price", "actual_occupancy", "demand_index",
)

_HOUR_KEY = "schedule_id, seat_type, hours_before_departure"

# name: (views used, in order of definition; further common table expressions; final select)
_QUERIES: dict[str, tuple[str, str, str]] = {
    "latest_seat_type": ("snap snap_latest", "", f"SELECT {_SNAP_COLS} FROM snap_latest"),
    "latest_seat": ("seat seat_day_latest", "", f"SELECT {_SEAT_COLS} FROM seat_day_latest"),
    "latest_seat_one": (
        "seat",
        "",
        f"""SELECT {_SEAT_COLS} FROM seat QUALIFY row_number() OVER (
          PARTITION BY schedule_id, seat_number
          ORDER BY snapshot_ts DESC, coach_layout_id, operator_reservation_id, sales_count) = 1""",
    ),
    "latest_snapshot_rows": (
        "seat",
        "",
        f"""SELECT {_SEAT_COLS} FROM seat s WHERE snapshot_ts =
          (SELECT max(snapshot_ts) FROM seat t WHERE t.schedule_id = s.schedule_id)""",
    ),
    "newest_first": ("snap", "", f"SELECT {_SNAP_COLS} FROM snap"),
    "hours_view": (
        "snap", "", "SELECT DISTINCT hours_before_departure, schedule_id, snapshot_ts FROM snap",
    ),
    "computed_hours": (
        "snap snap_latest",
        "",
        """SELECT date_of_journey, schedule_id, departure_time, snapshot_ts,
          date_sub('second', snapshot_ts,
            CAST(CAST(date_of_journey AS VARCHAR) || ' ' || departure_time AS TIMESTAMP)) / 3600.0::DOUBLE
            AS hours_before_departure FROM snap_latest""",
    ),
    "occupancy_view": (
        "snap",
        "",
        """SELECT DISTINCT CAST(actual_occupancy AS DOUBLE) AS actual_occupancy, seat_type,
          schedule_id, snapshot_ts FROM snap""",
    ),
    "expected_occupancy_view": (
        "snap",
        "",
        """SELECT DISTINCT CAST(expected_occupancy AS DOUBLE) AS expected_occupancy, seat_type,
          schedule_id, snapshot_ts FROM snap""",
    ),
    "latest_occupancy_view": (
        "snap snap_latest",
        "",
        """SELECT date_of_journey, schedule_id, operator_id, departure_time, snapshot_ts,
          CAST(expected_occupancy AS DOUBLE) AS expected_occupancy, CAST(NULL AS DOUBLE) AS occupancy
          FROM snap_latest UNION ALL
          SELECT date_of_journey, schedule_id, operator_id, departure_time, snapshot_ts, NULL, NULL
          FROM snap_latest""",
    ),
    "date_of_journey_view": (
        "trip", "", "SELECT DISTINCT date_of_journey, schedule_id, snapshot_ts FROM trip",
    ),
    "schedule_id_text": (
        "snap", "", "SELECT DISTINCT schedule_id, CAST(schedule_id AS VARCHAR) AS schedule_id_text FROM snap",
    ),
    "actual_price_view": (
        "snap",
        "",
        """SELECT DISTINCT seat_type, CAST(actual_fare AS DOUBLE) AS actual_fare, schedule_id,
          snapshot_ts FROM snap""",
    ),
    "model_price_view": (
        "snap",
        "",
        "SELECT DISTINCT seat_type, CAST(price AS DOUBLE) AS price, schedule_id, snapshot_ts FROM snap",
    ),
    "latest_model_price_view": (
        "snap snap_latest",
        "",
        """SELECT date_of_journey, schedule_id, seat_type, snapshot_ts,
          CAST(price AS DOUBLE) AS model_price FROM snap_latest""",
    ),
    "latest_actual_price_view": (
        "snap snap_latest",
        "",
        """SELECT date_of_journey, schedule_id, seat_type, snapshot_ts,
          CAST(actual_fare AS DOUBLE) AS actual_fare FROM snap_latest""",
    ),
    "sql_over_views": (
        "snap snap_latest",
        "",
        """SELECT seat_type, count(*) AS n, CAST(max(actual_fare) AS DOUBLE) AS top_fare
          FROM snap_latest WHERE date_of_journey >= DATE '2024-01-15' GROUP BY seat_type""",
    ),
    "latest_price_by_hour": ("snap snap_hour", "", f"SELECT {_SNAP_COLS} FROM snap_hour"),
    "latest_price_actual_model": (
        "snap snap_hour",
        "",
        f"""SELECT {_HOUR_KEY}, CAST(actual_fare AS DOUBLE) AS actual_price,
          CAST(coalesce(price, actual_fare) AS DOUBLE) AS model_price,
          CAST(abs(actual_fare - coalesce(price, actual_fare)) AS DOUBLE) AS abs_delta,
          {_STATUS.format(a="actual_fare", m="coalesce(price, actual_fare)")} AS status FROM snap_hour""",
    ),
    "latest_occupancy": (
        "snap snap_hour",
        "",
        f"""SELECT {_HOUR_KEY},
          CASE WHEN actual_occupancy IS NULL OR expected_occupancy IS NULL THEN 0.0
            ELSE CAST(actual_occupancy AS DOUBLE) END AS actual_occupancy,
          CASE WHEN actual_occupancy IS NULL OR expected_occupancy IS NULL THEN 0.0
            ELSE CAST(expected_occupancy AS DOUBLE) END AS expected_occupancy FROM snap_hour""",
    ),
    "demand_index_split": (
        "snap snap_hour",
        "",
        f"""SELECT {_HOUR_KEY},
          CASE WHEN TRY_CAST(demand_index AS DOUBLE) IS NULL THEN demand_index END AS demand_grade,
          TRY_CAST(demand_index AS DOUBLE) AS demand_value
          FROM snap_hour WHERE demand_index IS NOT NULL""",
    ),
    "demand_index_by_seat_type": (
        "snap",
        "",
        """SELECT schedule_id, seat_type,
          CASE WHEN TRY_CAST(demand_index AS DOUBLE) IS NULL THEN demand_index END AS demand_grade,
          TRY_CAST(demand_index AS DOUBLE) AS demand_value
          FROM (SELECT * FROM snap QUALIFY row_number() OVER (PARTITION BY schedule_id, seat_type
            ORDER BY snapshot_ts DESC, actual_fare, price NULLS LAST, expected_occupancy) = 1)
          WHERE demand_index IS NOT NULL""",
    ),
    "distinct_prices_timed": ("snap", "", _DISTINCT_PRICES.format(price="actual_fare")),
    "distinct_prices_plain": (
        "snap", "", _DISTINCT_PRICES.format(price="coalesce(price, actual_fare)"),
    ),
    "departure_times": (
        "snap", "", "SELECT schedule_id, min(departure_time) AS departure_time FROM snap GROUP BY 1",
    ),
    "nearest_hour_price": (
        "snap",
        "near AS ("
        + _nearest(
            f"SELECT DISTINCT schedule_id, x FROM snap CROSS JOIN ({_HOURS}) h(x)"
        )
        + ")",
        """SELECT n.schedule_id, n.requested_hours, n.matched_hours, n.snapshot_ts, s.seat_type,
          CAST(s.actual_fare AS DOUBLE) AS actual_price, CAST(s.price AS DOUBLE) AS model_price
          FROM near n JOIN (SELECT * FROM snap QUALIFY row_number() OVER (
            PARTITION BY schedule_id, seat_type, snapshot_ts
            ORDER BY date_of_journey, hours_before_departure, actual_fare, price NULLS LAST) = 1) s
          ON n.schedule_id = s.schedule_id AND n.snapshot_ts = s.snapshot_ts""",
    ),
    "kpi_cards": (
        "snap",
        "near AS ("
        + _nearest(f"SELECT DISTINCT schedule_id, x FROM snap CROSS JOIN ({_HOURS}) h(x)")
        + f"""), prices AS (SELECT n.schedule_id, n.requested_hours, n.matched_hours, s.seat_type,
            s.actual_fare AS a, s.price AS m
            FROM near n JOIN (SELECT * FROM snap QUALIFY row_number() OVER (
              PARTITION BY schedule_id, seat_type, snapshot_ts
              ORDER BY date_of_journey, hours_before_departure, actual_fare, price NULLS LAST) = 1) s
            ON n.schedule_id = s.schedule_id AND n.snapshot_ts = s.snapshot_ts),
          at_hour AS (SELECT * FROM snap JOIN ({_HOURS}) h(x) ON abs(hours_before_departure - x) < 0.01
            QUALIFY row_number() OVER (PARTITION BY schedule_id, seat_type, x
              ORDER BY snapshot_ts DESC, actual_fare, price NULLS LAST, expected_occupancy) = 1)""",
        f"""SELECT p.schedule_id, p.seat_type, p.requested_hours, p.matched_hours,
          CAST(a AS DOUBLE) AS actual_price, CAST(m AS DOUBLE) AS model_price,
          CAST(abs(a - m) AS DOUBLE) AS abs_delta, {_STATUS.format(a="a", m="m")} AS status,
          CASE WHEN actual_occupancy IS NULL OR expected_occupancy IS NULL THEN 0.0
            ELSE CAST(actual_occupancy AS DOUBLE) END AS actual_occupancy,
          CASE WHEN actual_occupancy IS NULL OR expected_occupancy IS NULL THEN 0.0
            ELSE CAST(expected_occupancy AS DOUBLE) END AS expected_occupancy,
          CASE WHEN TRY_CAST(demand_index AS DOUBLE) IS NULL THEN demand_index END AS demand_grade,
          TRY_CAST(demand_index AS DOUBLE) AS demand_value
          FROM prices p LEFT JOIN at_hour q ON p.schedule_id = q.schedule_id
            AND p.seat_type = q.seat_type AND p.requested_hours = q.x""",
    ),
    "nearest_hour_requests": (
        "snap",
        "",
        _nearest("SELECT DISTINCT user_id AS schedule_id, value AS x FROM events"),
    ),
    "seats_by_hour": (
        "seat trip",
        """one AS (SELECT * FROM seat QUALIFY row_number() OVER (
            PARTITION BY schedule_id, snapshot_ts, seat_number
            ORDER BY coach_layout_id, operator_reservation_id, sales_count) = 1)""",
        """SELECT o.schedule_id, h.hours_before_departure, o.snapshot_ts, o.seat_number,
          CAST(o.actual_fare AS DOUBLE) AS actual_fare, CAST(o.final_price AS DOUBLE) AS final_price
          FROM one o JOIN (SELECT schedule_id, hours_before_departure, max(snapshot_ts) AS m FROM trip
            GROUP BY ALL) h ON o.schedule_id = h.schedule_id AND o.snapshot_ts = h.m""",
    ),
    "seats_latest": (
        "seat seats_newest",
        "",
        """SELECT schedule_id, snapshot_ts, seat_number, CAST(actual_fare AS DOUBLE) AS actual_fare,
          CAST(final_price AS DOUBLE) AS final_price FROM seats_newest""",
    ),
    "seat_rows_at_hour": (
        "seat trip",
        "",
        f"""SELECT {_SEAT_COLS}, 6.0::DOUBLE AS hours_before_departure FROM seat s WHERE EXISTS (
          SELECT 1 FROM trip t WHERE t.schedule_id = s.schedule_id AND t.snapshot_ts = s.snapshot_ts
          AND t.hours_before_departure = 6)""",
    ),
    "journey_dates": (
        "seat trip",
        "",
        """SELECT DISTINCT s.schedule_id, s.snapshot_ts, t.date_of_journey FROM seat s JOIN trip t
          ON s.schedule_id = t.schedule_id AND s.snapshot_ts = t.snapshot_ts""",
    ),
    "date_summary_seat": (
        "seat trip",
        _CHOSEN_SEAT,
        _DAY_SUM.format(dates="(SELECT DISTINCT date_of_journey, schedule_id FROM trip)"),
    ),
    "date_summary_schedule": (
        "snap",
        _CHOSEN_SNAP_TYPE,
        _DAY_SUM.format(dates="(SELECT DISTINCT date_of_journey, schedule_id FROM snap)"),
    ),
    "date_summary_past_dates": (
        "snap",
        _CHOSEN_SNAP_TYPE,
        _DAY_SUM.format(
            dates="(SELECT DISTINCT date_of_journey, schedule_id FROM snap"
            " WHERE date_of_journey < DATE '2024-01-15')"
        ),
    ),
    "monthly_delta_schedule": ("snap", _CHOSEN_SNAP, _MONTH_SUM.format(snaps="snap")),
    "monthly_delta_seat": ("seat trip", _CHOSEN_SEAT_HOUR, _MONTH_SUM.format(snaps="trip")),
    "total_seat_prices": (
        "seat trip",
        "",
        """SELECT s.schedule_id, t.hours_before_departure,
          CAST(sum(actual_fare) AS DOUBLE) AS total_actual_price_all_rows,
          CAST(sum(final_price) AS DOUBLE) AS total_model_price_all_rows,
          count(*) AS seat_count_all_rows,
          CAST(sum(actual_fare) - sum(final_price) AS DOUBLE) AS price_difference
          FROM seat s JOIN (SELECT DISTINCT schedule_id, snapshot_ts, hours_before_departure FROM trip) t
          ON s.schedule_id = t.schedule_id AND s.snapshot_ts = t.snapshot_ts GROUP BY 1, 2""",
    ),
    "seat_totals": (
        "seat",
        "",
        """SELECT CAST(sum(actual_fare) AS DOUBLE) AS total_actual_price,
          CAST(sum(final_price) AS DOUBLE) AS total_model_price, count(*) AS seat_count,
          CAST(sum(actual_fare) - sum(final_price) AS DOUBLE) AS price_difference FROM seat""",
    ),
    "kpi_means": ("snap", "", _means("snap", "schedule_id", "price", True, True)),
    "kpi_means_ignore_blank": ("snap", "", _means("snap", "schedule_id", "price", False, True)),
    "kpi_means_seat": ("seat", "", _means("seat", "seat_type", "final_price", True, False)),
    "model_price_fallback": (
        "snap",
        "",
        """SELECT schedule_id, seat_type, snapshot_ts,
          CAST(coalesce(price, actual_fare) AS DOUBLE) AS model_price FROM snap""",
    ),
    "price_sum_by_hour": (
        "seat trip",
        """ls AS (SELECT schedule_id, hours_before_departure, seat_type, max(snapshot_ts) AS ts
            FROM trip GROUP BY ALL),
          ld AS (SELECT ls.schedule_id, ls.hours_before_departure, ls.seat_type, s.seat_number,
              s.actual_fare, s.final_price
            FROM ls JOIN seat s ON s.schedule_id = ls.schedule_id AND s.snapshot_ts = ls.ts
              AND s.seat_type = ls.seat_type
            QUALIFY row_number() OVER (PARTITION BY ls.schedule_id, ls.hours_before_departure,
              ls.seat_type, s.seat_number
              ORDER BY s.coach_layout_id, s.operator_reservation_id, s.sales_count) = 1)""",
        f"""SELECT {_HOUR_KEY}, CAST(sum(actual_fare) AS DOUBLE) AS total_actual_price,
          CAST(sum(final_price) AS DOUBLE) AS total_model_price,
          count(DISTINCT seat_number) AS seat_count FROM ld GROUP BY {_HOUR_KEY}""",
    ),
    "occupancy_trend": (
        "snap",
        "",
        f"""SELECT {_HOUR_KEY}, snapshot_ts, CAST(actual_occupancy AS DOUBLE) AS actual_occupancy,
          CAST(expected_occupancy AS DOUBLE) AS expected_occupancy FROM snap
          WHERE actual_occupancy IS NOT NULL AND expected_occupancy IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY {_HOUR_KEY}
            ORDER BY snapshot_ts DESC, date_of_journey, actual_occupancy, expected_occupancy) = 1""",
    ),
    "occupancy_history": (
        "snap",
        "",
        f"""SELECT {_HOUR_KEY}, snapshot_ts,
          CAST(coalesce(actual_occupancy, 0) AS DOUBLE) AS actual_occupancy,
          CAST(coalesce(expected_occupancy, 0) AS DOUBLE) AS expected_occupancy FROM snap""",
    ),
    "price_trend_delta": (
        "snap",
        "",
        """SELECT schedule_id, seat_type, snapshot_ts, CAST(a AS DOUBLE) AS actual_fare,
          CAST(m AS DOUBLE) AS price, CAST(a - m AS DOUBLE) AS delta,
          CASE WHEN m = 0 THEN 0.0 ELSE CAST(a - m AS DOUBLE) / CAST(m AS DOUBLE) * 100 END AS delta_pct
          FROM (SELECT *, coalesce(actual_fare, 0) AS a, coalesce(price, 0) AS m FROM snap)""",
    ),
    "seat_analysis": (
        "seat",
        "",
        """SELECT schedule_id, snapshot_ts, seat_number, seat_type,
          CAST(actual_fare AS DOUBLE) AS actual_fare, CAST(final_price AS DOUBLE) AS final_price,
          CAST(sales_percentage AS DOUBLE) AS sales_percentage,
          CAST(actual_fare - final_price AS DOUBLE) AS delta FROM seat""",
    ),
    "matching_times": (
        "snap",
        "o AS (SELECT DISTINCT operator_id, date_of_journey, departure_time FROM snap)",
        """SELECT DISTINCT CAST(1 AS INTEGER) AS actual_operator, a.date_of_journey, a.departure_time
          FROM o a JOIN o b ON a.departure_time = b.departure_time
            AND a.date_of_journey = b.date_of_journey
          WHERE a.operator_id = 0 AND b.operator_id = 1""",
    ),
    "matching_times_seat_type": (
        "snap",
        "o AS (SELECT DISTINCT operator_id, date_of_journey, departure_time, seat_type FROM snap)",
        """SELECT DISTINCT CAST(1 AS INTEGER) AS actual_operator, a.date_of_journey, a.departure_time
          FROM o a JOIN o b ON a.departure_time = b.departure_time
            AND a.date_of_journey = b.date_of_journey AND a.seat_type = b.seat_type
          WHERE a.operator_id = 0 AND b.operator_id = 1""",
    ),
    "matching_times_all_others": (
        "trip",
        """t AS (SELECT DISTINCT operator_id, date_of_journey, departure_time, seat_type FROM trip)""",
        """SELECT DISTINCT b.operator_id AS actual_operator, a.date_of_journey, a.departure_time
          FROM t a JOIN t b ON a.departure_time = b.departure_time
            AND a.date_of_journey = b.date_of_journey AND a.seat_type = b.seat_type
          WHERE a.operator_id = 2 AND b.operator_id <> 2""",
    ),
    "operator_match_counts": (
        "snap",
        """c AS (SELECT operator_id, date_of_journey, departure_time, count(*) AS n FROM snap
            GROUP BY ALL)""",
        """SELECT a.operator_id AS op1, b.operator_id AS op2, a.date_of_journey, a.departure_time,
          a.n * b.n AS match_count FROM c a JOIN c b ON a.date_of_journey = b.date_of_journey
          AND a.departure_time = b.departure_time AND a.operator_id <> b.operator_id""",
    ),
    "common_slots_intersect": (
        "snap",
        "",
        """SELECT departure_time, date_of_journey FROM snap WHERE operator_id = 1 INTERSECT
          SELECT departure_time, date_of_journey FROM snap WHERE operator_id = 2""",
    ),
    "operator_compare_seat_type": (
        "snap",
        f"offers AS ({_OFFER_TYPE})",
        """SELECT * REPLACE (CAST(price AS DOUBLE) AS price) FROM offers WHERE operator_id IN (0, 1)""",
    ),
    "operator_compare_seat": (
        "seat trip seat_day_latest",
        f"offers AS ({_OFFER_SEAT})",
        """SELECT * REPLACE (CAST(price AS DOUBLE) AS price) FROM offers WHERE operator_id IN (0, 1)""",
    ),
    "operator_compare_seat_one": (
        "seat trip",
        f"""seat_day_latest AS (SELECT * FROM seat QUALIFY row_number() OVER (
            PARTITION BY travel_date, schedule_id, seat_number
            ORDER BY snapshot_ts DESC, coach_layout_id, operator_reservation_id, sales_count) = 1),
          offers AS ({_OFFER_SEAT})""",
        """SELECT * REPLACE (CAST(price AS DOUBLE) AS price) FROM offers WHERE operator_id IN (0, 1)""",
    ),
    "operator_compare_stats": ("snap", f"offers AS ({_OFFER_TYPE}), {_STATS}", _OFFER_STATS),
    "operator_compare_seat_stats": (
        "seat trip seat_day_latest", f"offers AS ({_OFFER_SEAT}), {_STATS}", _OFFER_STATS,
    ),
    "distinct_schedules": ("trip", "", "SELECT DISTINCT schedule_id FROM trip"),
    "distinct_operators": ("trip", "", "SELECT DISTINCT operator_id FROM trip"),
    "distinct_seat_types": ("trip", "", "SELECT DISTINCT seat_type FROM trip"),
    "journey_dates_distinct": ("trip", "", "SELECT DISTINCT date_of_journey FROM trip"),
    "schedule_dim": (
        "trip",
        "",
        """SELECT schedule_id, min(operator_id) AS operator_id, min(departure_time) AS departure_time
          FROM trip GROUP BY 1""",
    ),
    "schedule_operators": (
        "trip", "", "SELECT schedule_id, min(operator_id) AS operator_id FROM trip GROUP BY 1",
    ),
    "seat_types_per_schedule": ("seat", "", "SELECT DISTINCT schedule_id, seat_type FROM seat"),
    "seat_types_count": (
        "seat",
        "",
        "SELECT schedule_id, count(DISTINCT seat_type) AS seat_types_count FROM seat GROUP BY 1",
    ),
    "seat_types_count_approx": (
        "seat",
        "",
        "SELECT schedule_id, count(DISTINCT seat_type) AS seat_types_count FROM seat GROUP BY 1",
    ),
    "hours_distinct": (
        "snap",
        "",
        """SELECT DISTINCT schedule_id, hours_before_departure,
          CAST(CAST(hours_before_departure AS BIGINT) AS VARCHAR) AS hours_label FROM snap""",
    ),
    "schedules_by_date": ("trip", "", "SELECT DISTINCT date_of_journey, schedule_id FROM trip"),
    "schedule_choices": ("snap", "", "SELECT DISTINCT schedule_id FROM snap"),
    "seat_type_choices": ("snap", "", "SELECT DISTINCT seat_type FROM snap"),
    "seat_types_union": (
        "snap",
        "",
        """SELECT schedule_id, seat_type FROM snap WHERE actual_fare IS NOT NULL UNION
          SELECT schedule_id, seat_type FROM snap WHERE price IS NOT NULL""",
    ),
    "other_operators": ("trip", "", "SELECT DISTINCT operator_id FROM trip WHERE operator_id <> 1"),
    "operator_names": (
        "",
        "",
        """SELECT l_suppkey AS operator_id, coalesce(s_name, 'Other') AS operator_name, count(*) AS n
          FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey
          GROUP BY 1, 2""",
    ),
    "operator_names_fixed": (
        "",
        "",
        """SELECT CASE l_partkey WHEN 191 THEN 'Pullman San Andreas' WHEN 296 THEN 'Pullman Bus TS'
          ELSE 'Other' END AS operator_name, count(*) AS n FROM lineitem GROUP BY 1""",
    ),
    "origin_destination": (
        "seat",
        "",
        """SELECT DISTINCT schedule_id, origin_id, destination_id,
          CASE origin_id WHEN 1646 THEN 'Santiago' ELSE 'Other' END AS origin_name,
          CASE destination_id WHEN 1821 THEN 'La Serena' ELSE 'Other' END AS destination_name
          FROM seat""",
    ),
    "filtered_snapshots": (
        "snap",
        "",
        f"""SELECT {_SNAP_COLS} FROM snap WHERE operator_id = 1 AND seat_type = 'click'
          AND abs(hours_before_departure - 24) < 0.01 AND departure_time = '03:00:00'""",
    ),
    "filtered_hours_text": (
        "raw_snap",
        "",
        """SELECT schedule_id, hours_before_departure, count(*) AS n FROM raw_snap
          WHERE hours_before_departure IN ('24', 'soon') GROUP BY 1, 2""",
    ),
    "zero_hour_in_month": (
        "snap",
        "",
        f"""SELECT {_SNAP_COLS} FROM snap WHERE hours_before_departure = 0
          AND snapshot_ts >= TIMESTAMP '2024-01-01' AND snapshot_ts < TIMESTAMP '2024-02-01'""",
    ),
    "source_fallback": (
        "snap",
        "",
        f"""SELECT {_SNAP_COLS} FROM snap WHERE price IS NOT NULL UNION ALL
          SELECT {_SNAP_COLS} FROM snap s WHERE NOT EXISTS (SELECT 1 FROM snap p
            WHERE p.price IS NOT NULL AND p.schedule_id = s.schedule_id AND p.seat_type = s.seat_type
            AND p.hours_before_departure = s.hours_before_departure)""",
    ),
    "delta_status": (
        "snap",
        "",
        f"""SELECT schedule_id, seat_type, snapshot_ts,
          CAST(coalesce(actual_fare - price, 0) AS DOUBLE) AS delta,
          CASE WHEN price IS NULL OR actual_fare IS NULL OR price = 0 THEN 0.0
            ELSE CAST(actual_fare - price AS DOUBLE) / CAST(price AS DOUBLE) * 100 END AS delta_pct,
          {_STATUS.format(a="actual_fare", m="price")} AS status FROM snap""",
    ),
    "typed_values": (
        "raw_snap",
        "",
        """SELECT schedule_id, seat_type, strptime(stamp_text, '%d-%m-%Y %H:%M:%S') AS snapshot_ts,
          CAST(date_of_journey AS DATE) AS date_of_journey,
          TRY_CAST(hours_before_departure AS DOUBLE) AS hours_before_departure,
          CAST(TRY_CAST(actual_fare AS DECIMAL(18,2)) AS DOUBLE) AS actual_fare,
          CAST(coalesce(TRY_CAST(actual_fare AS DECIMAL(18,2)), 0) AS DOUBLE) AS actual_or_zero,
          CAST(coalesce(TRY_CAST(price AS DECIMAL(18,2)), TRY_CAST(actual_fare AS DECIMAL(18,2))) AS DOUBLE)
            AS model_price,
          CAST(date_of_journey AS DATE) - CAST(dayofweek(CAST(date_of_journey AS DATE)) AS INTEGER)
            AS week_start,
          CAST(date_of_journey AS DATE) < DATE '2024-01-15' AS is_past FROM raw_snap""",
    ),
    "seat_price_table": (
        "seat seats_newest",
        "",
        f"""SELECT schedule_id, snapshot_ts, seat_number, CAST(actual_fare AS DOUBLE) AS actual_fare,
          CAST(final_price AS DOUBLE) AS final_price, TRY_CAST(seat_number AS BIGINT) AS seat_no,
          CAST(actual_fare - final_price AS DOUBLE) AS delta,
          CAST(abs(actual_fare - final_price) AS DOUBLE) AS abs_delta,
          {_STATUS.format(a="actual_fare", m="final_price")} AS status FROM seats_newest""",
    ),
    "seat_order": (
        "seat seats_newest",
        "",
        """SELECT schedule_id, TRY_CAST(seat_number AS BIGINT) AS seat_no,
          CAST(actual_fare AS DOUBLE) AS actual_fare, CAST(final_price AS DOUBLE) AS final_price
          FROM seats_newest""",
    ),
    "seat_details": (
        "seat seats_newest",
        "",
        """SELECT schedule_id, seat_number, CAST(actual_fare AS DOUBLE) AS actual_fare,
          CAST(final_price AS DOUBLE) AS final_price,
          CASE WHEN actual_fare <> 0 AND final_price <> 0 THEN CAST(final_price - actual_fare AS DOUBLE)
            ELSE 0.0 END AS price_diff,
          CASE WHEN actual_fare <> 0 AND final_price <> 0 THEN
            CAST(final_price - actual_fare AS DOUBLE) / CAST(actual_fare AS DOUBLE) * 100
            ELSE 0.0 END AS price_diff_pct FROM seats_newest""",
    ),
    "seat_rows_13": (
        "",
        """s AS (SELECT CAST(o_custkey AS VARCHAR) AS schedule_id, l_orderkey * 8 + l_linenumber AS seat_no,
            CAST(l_extendedprice AS DECIMAL(18,2)) AS a, CAST(l_quantity AS DECIMAL(18,2)) AS m
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey
            QUALIFY row_number() OVER (PARTITION BY o_custkey, l_orderkey * 8 + l_linenumber
              ORDER BY a DESC, m DESC) = 1),
          p AS (SELECT *, row_number() OVER (PARTITION BY schedule_id ORDER BY seat_no) - 1 AS position
            FROM s)""",
        f"""SELECT schedule_id, seat_no, CAST(a AS DOUBLE) AS actual_fare, CAST(m AS DOUBLE) AS final_price,
          CAST(a - m AS DOUBLE) AS delta, {_STATUS.format(a="a", m="m")} AS status,
          position, position // 13 AS seat_row, position % 13 AS seat_in_row FROM p""",
    ),
    "profile": (
        "snap",
        "",
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count,"
            f" count(DISTINCT {c}) AS distinct_count FROM snap"
            for c in _PROFILE_COLUMNS
        ),
    ),
    "rejects": (
        "raw_snap",
        "",
        """SELECT 'operator_id' AS column_name, 0::BIGINT AS reject_count UNION ALL
          SELECT 'date_of_journey', 0 UNION ALL
          SELECT 'hours_before_departure', count(*) FROM raw_snap WHERE hours_before_departure = 'soon'
          UNION ALL SELECT 'price', 0 UNION ALL
          SELECT 'actual_fare', count(*) FROM raw_snap WHERE actual_fare = 'abc'""",
    ),
    "date_extent": (
        "snap seat",
        "",
        """SELECT min(d) AS min_date, max(d) AS max_date FROM (SELECT date_of_journey AS d FROM snap
          UNION ALL SELECT travel_date FROM seat)""",
    ),
    "week_bucket_counts": (
        "seat",
        "",
        """SELECT travel_date - CAST(dayofweek(travel_date) AS INTEGER) AS week_start,
          count(*) AS row_count FROM seat GROUP BY 1""",
    ),
    "week_coverage": (
        "seat",
        """c AS (SELECT travel_date - CAST(dayofweek(travel_date) AS INTEGER) AS w, count(*) AS n
            FROM seat GROUP BY 1)""",
        """SELECT CAST(g AS DATE) AS week_start, coalesce(c.n, 0) AS row_count
          FROM (SELECT unnest(generate_series((SELECT min(w) FROM c), (SELECT max(w) FROM c),
            INTERVAL 7 DAY)) AS g) LEFT JOIN c ON c.w = CAST(g AS DATE)""",
    ),
    "month_zero_hour_fallback": (
        "trip",
        """m AS (SELECT CAST(date_trunc('month', snapshot_ts) AS DATE) AS month_start,
            hours_before_departure AS h, schedule_id FROM trip),
          u AS (SELECT month_start, CASE WHEN max(CASE WHEN h = 0 THEN 1 ELSE 0 END) = 1 THEN 0.0
            ELSE min(h) END AS used_hours FROM m GROUP BY 1)""",
        """SELECT u.month_start, u.used_hours, count(DISTINCT m.schedule_id) AS schedule_count
          FROM u JOIN m ON m.month_start = u.month_start AND m.h = u.used_hours GROUP BY 1, 2""",
    ),
    "sample_rows": (
        "seat",
        "",
        f"""SELECT {_SEAT_COLS} FROM seat ORDER BY schedule_id, seat_number, seat.snapshot_ts,
          coach_layout_id, operator_reservation_id, seat.sales_count LIMIT 5""",
    ),
    "csv_ingest_typed": ("snap feed", "", "SELECT * FROM feed UNION ALL SELECT * FROM feed"),
    "insert_ignore": ("snap feed feed_table", "", "SELECT * FROM feed_table"),
    "append_frame": (
        "snap",
        "",
        """SELECT CAST(schedule_id AS VARCHAR) AS schedule_id, seat_type, date_of_journey,
          CAST(actual_fare AS DOUBLE) AS actual_fare, CAST(NULL AS DOUBLE) AS price, snapshot_ts,
          date_of_journey - CAST(dayofweek(date_of_journey) AS INTEGER) AS week_start FROM snap""",
    ),
    "compacted_table": (
        "snap",
        "",
        """SELECT CAST(schedule_id AS VARCHAR) AS schedule_id, seat_type, date_of_journey,
          CAST(actual_fare AS DOUBLE) AS actual_fare, snapshot_ts,
          date_of_journey - CAST(dayofweek(date_of_journey) AS INTEGER) AS week_start FROM snap""",
    ),
    "table_grows": (
        "snap",
        "",
        """SELECT CAST(schedule_id AS VARCHAR) AS schedule_id, seat_type, date_of_journey,
          CAST(actual_fare AS DOUBLE) AS actual_fare, snapshot_ts,
          CASE WHEN hour(snapshot_ts) BETWEEN 6 AND 11 THEN 'd' || schedule_id % 5 END AS depot,
          CASE WHEN hour(snapshot_ts) BETWEEN 6 AND 11 THEN CAST(schedule_id % 4 AS VARCHAR) END AS stop_count,
          date_of_journey - CAST(dayofweek(date_of_journey) AS INTEGER) AS week_start FROM snap""",
    ),
    "load_folder_twice": ("snap feed feed_table", "", "SELECT * FROM feed_table"),
    "load_folder_recent": ("snap feed feed_table", "", "SELECT * FROM feed_table"),
    "partition_report": (
        "snap feed feed_table", "", "SELECT week_start, count(*) AS row_count FROM feed_table GROUP BY 1",
    ),
    "json_export": (
        "snap",
        "",
        """SELECT schedule_id, seat_type, date_trunc('millisecond', snapshot_ts) AS snapshot_ts,
          CAST(actual_fare AS DOUBLE) AS actual_fare, CAST(price AS DOUBLE) AS price FROM snap""",
    ),
    "stream_pickup": ("snap feed feed_table", "", "SELECT * FROM feed_table"),
    "stream_dedupe": ("snap feed feed_table", "", "SELECT * FROM feed_table"),
    "stream_dedupe_within": ("snap feed feed_table", "", "SELECT * FROM feed_table"),
    "rejected_files": (
        "snap",
        "",
        "SELECT DISTINCT 'seat_prices_with_dt' AS feed, date_of_journey AS day, 'no header' AS reason FROM snap",
    ),
    "stream_latest_table": (
        "snap feed feed_table",
        "",
        """SELECT * FROM feed_table f WHERE snapshot_ts = (SELECT max(snapshot_ts) FROM feed_table g
          WHERE g.date_of_journey = f.date_of_journey AND g.schedule_id = f.schedule_id
          AND g.seat_type = f.seat_type)""",
    ),
}



def _arm(name: str, condition: str, columns: str = "*") -> tuple[str, str, str]:
    """An operator's SQL, limited to what one argument chooses."""
    used, extra, select = _QUERIES[name]
    return used, extra, f"SELECT {columns} FROM ({select}) WHERE {condition}"


_ROUNDED = ", ".join(
    f"round({c}, 2) AS {c}"
    for c in (
        "avg_actual_fare", "avg_model_price", "avg_occupancy", "avg_expected_occupancy", "avg_delta",
        "avg_delta_pct",
    )
)
_SEAT_ROWS = f"SELECT {_SEAT_COLS} FROM seat"
_SNAP_ROWS = f"SELECT {_SNAP_COLS} FROM snap"

_SEAT_COLUMNS = (
    "schedule_id", "seat_number", "seat_type", "final_price", "actual_fare", "coach_layout_id", "sales_count",
    "sales_percentage", "operator_reservation_id", "origin_id", "destination_id", "travel_date", "snapshot_ts",
)


def _profile_beside(view: str) -> str:
    """Counts of every column; that the estimates are near the exact counts is what the query has to find."""
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count(v.{c}) AS null_count,
          count(DISTINCT v.{c}) AS exact_count, true AS within_bound FROM {view} v"""
        for c in _SEAT_COLUMNS
    )


_QUERIES |= {
    "kpi_means_rounded": _arm("kpi_means", "true", f"schedule_id, {_ROUNDED}"),
    "occupancy_trend_listed": _arm(
        "occupancy_trend",
        "true",
        """*, row_number() OVER (PARTITION BY schedule_id
          ORDER BY seat_type, hours_before_departure DESC)::INTEGER AS position""",
    ),
    "hours_listed": _arm(
        "hours_distinct",
        "hours_before_departure IS NOT NULL",
        "*, row_number() OVER (PARTITION BY schedule_id ORDER BY hours_before_departure DESC)::INTEGER AS position",
    ),
    "nearest_hour_price_of_seats": _arm(
        "nearest_hour_price",
        "(schedule_id, seat_type) IN (SELECT (schedule_id, seat_type) FROM snap WHERE actual_occupancy < 30)",
    ),
    "of_seat": ("seat", "", f"{_SEAT_ROWS} WHERE seat_number = 3"),
    "of_schedule_text": ("snap", "", f"{_SNAP_ROWS} WHERE schedule_id = 7"),
    "filtered_schedule_date": (
        "snap", "", f"{_SNAP_ROWS} WHERE schedule_id = 7 AND date_of_journey = DATE '2024-01-10'",
    ),
    "schedules_on_date": (
        "snap", "", "SELECT DISTINCT schedule_id FROM snap WHERE date_of_journey = DATE '2024-01-10'",
    ),
    "seat_types_of_schedule": ("seat", "", "SELECT DISTINCT seat_type FROM seat WHERE schedule_id = 7"),
    "seat_types_until": (
        "snap",
        "",
        """SELECT DISTINCT seat_type FROM snap WHERE (actual_fare IS NOT NULL OR price IS NOT NULL)
          AND schedule_id = 7 AND snapshot_ts <= TIMESTAMP '2024-01-10 12:00:00'""",
    ),
    "date_summary_one_day": _arm("date_summary_schedule", "date_of_journey = DATE '2024-01-10'"),
    "date_summary_seat_one_day": _arm("date_summary_seat", "date_of_journey = DATE '1996-05-01'"),
    "monthly_delta_one_month": _arm("monthly_delta_schedule", "year = 2024 AND month = 1"),
    "profile_sketch": ("seat", "", _profile_beside("seat")),
    "profile_of_weeks": (
        "seat",
        """days AS (SELECT * FROM seat WHERE travel_date - CAST(dayofweek(travel_date) AS INTEGER)
          BETWEEN DATE '1996-01-07' AND DATE '1996-12-22')""",
        _profile_beside("days"),
    ),
    "monthly_delta_seat_one_month": _arm("monthly_delta_seat", "year = 1996 AND month = 5"),
    "fallback_without_table": ("snap", "", _SNAP_ROWS),
    "columns_with_defaults": (
        "snap",
        "",
        """SELECT schedule_id, snapshot_ts, CAST(price AS DOUBLE) AS price, -1 AS occupancy, 'none' AS route
          FROM snap""",
    ),
    "columns_of_both": (
        "snap",
        "",
        """SELECT schedule_id, seat_type, snapshot_ts, CAST(NULL AS VARCHAR) AS seat_number,
          CAST(NULL AS VARCHAR) AS travel_date FROM snap""",
    ),
    "text_defaults": (
        "raw_snap",
        "",
        """SELECT schedule_id, stamp_text, coalesce(nullif(actual_fare, ''), 'missing') AS fare,
          monthname(CAST(date_of_journey AS DATE)) AS month_name FROM raw_snap""",
    ),
    "timed_views": (
        "snap seat snap_latest seat_day_latest",
        "",
        """SELECT 'seat_prices_with_dt_latest' AS view_name, count(*) AS n, max(snapshot_ts) AS newest FROM snap_latest
          UNION ALL SELECT 'seat_wise_prices_with_dt_latest', count(*), max(snapshot_ts) FROM seat_day_latest
          UNION ALL SELECT 'seat_prices_with_dt_view', count(*), max(snapshot_ts) FROM snap
          UNION ALL SELECT 'seat_wise_prices_raw_view', count(*), max(snapshot_ts) FROM seat
          UNION ALL SELECT 'computed_hours', count(*), max(snapshot_ts) FROM snap_latest
          UNION ALL SELECT 'dateofjourney', count(*), max(snapshot_ts)
            FROM (SELECT DISTINCT date_of_journey, schedule_id, snapshot_ts FROM snap)
          UNION ALL SELECT 'model_price_sp', count(*), max(snapshot_ts)
            FROM (SELECT DISTINCT seat_type, price, schedule_id, snapshot_ts FROM snap)""",
    ),
}

def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (used, extra, select) in _QUERIES.items():
        parts = [f"{v} AS ({VIEWS[v]})" for v in used.split()]
        if extra:
            parts.append(extra)
        out[name] = (f"WITH {', '.join(parts)}\n" if parts else "") + select
    return out
