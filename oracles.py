"""DuckDB SQL with the same results as the registered queries.

Written from the operators' definitions, not from their Spark code: each query
is a chain of common table expressions over the given tables.
"""

from __future__ import annotations

FACT_SLICE = [
    "sensor_key",
    "date_key",
    "event_hour",
    "day_of_week",
    "is_weekend",
    "pedestrian_count",
]

BRONZE_COLUMNS = (
    "location_id, sensing_datetime, sensing_date, sensing_time, direction_1, direction_2, "
    "total_of_directions, dedupe_key, ingested_at"
)
READING_COLUMNS = BRONZE_COLUMNS.split(", ")[:7]
TYPED_COLUMNS = (
    BRONZE_COLUMNS + ", event_ts_utc, ingested_ts_utc, event_ts_local, event_date, event_hour, "
    "day_of_week, is_weekend"
)
SILVER_COLUMNS = (
    "location_id, event_ts_utc, event_ts_local, event_date, event_hour, day_of_week, is_weekend, "
    "direction_1, direction_2, total_of_directions, dedupe_key, ingested_ts_utc"
)
FACT_COLUMNS = (
    "footfall_key, sensor_key, date_key, event_hour, is_weekend, day_of_week, pedestrian_count, "
    "count_direction_1, count_direction_2, minutes_reported, reading_completeness"
)

# Common table expressions, each with the ones it builds on.
STEPS: dict[str, tuple[list[str], str]] = {
    "sent": (
        [],
        """
        SELECT *, 0 AS copy FROM events
        UNION ALL
        SELECT *, 1 AS copy FROM events WHERE event_id % 10 = 0
        """,
    ),
    "bronze": (
        ["sent"],
        """
        SELECT
            CASE WHEN event_id % 101 = 0 THEN NULL ELSE CAST(user_id AS INTEGER) END AS location_id,
            CASE WHEN event_id % 97 = 0 THEN 'not-a-timestamp'
                 ELSE strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00'
            END AS sensing_datetime,
            strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Australia/Melbourne', '%Y-%m-%d')
                AS sensing_date,
            strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Australia/Melbourne', '%H:%M')
                AS sensing_time,
            CASE WHEN event_type = 'error' THEN NULL
                 ELSE CAST(floor(value) AS INTEGER) + copy END AS direction_1,
            CASE WHEN event_type = 'signup' THEN NULL
                 ELSE CAST(props ->> '$.k' AS INTEGER) END AS direction_2,
            CAST(floor(value) AS INTEGER) AS total_of_directions,
            CAST(user_id AS VARCHAR) || '#' ||
                CASE WHEN event_id % 97 = 0 THEN 'not-a-timestamp'
                     ELSE strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00'
                END AS dedupe_key,
            strftime(ts + to_hours(copy), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS ingested_at
        FROM sent
        """,
    ),
    "stamped": (
        ["bronze"],
        """
        SELECT *,
            TRY_CAST(sensing_datetime AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS event_ts_utc,
            TRY_CAST(ingested_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS ingested_ts_utc,
            TRY_CAST(sensing_datetime AS TIMESTAMPTZ) AT TIME ZONE 'Australia/Melbourne'
                AS event_ts_local
        FROM bronze
        """,
    ),
    "typed": (
        ["stamped"],
        """
        SELECT *,
            CAST(event_ts_local AS DATE) AS event_date,
            CAST(hour(event_ts_local) AS INTEGER) AS event_hour,
            CAST(dayofweek(event_ts_local) + 1 AS INTEGER) AS day_of_week,
            dayofweek(event_ts_local) IN (0, 6) AS is_weekend
        FROM stamped
        """,
    ),
    "valid": (
        ["typed"],
        """
        SELECT * FROM typed
        WHERE location_id IS NOT NULL AND location_id > 0 AND event_ts_utc IS NOT NULL
        """,
    ),
    "silver": (
        ["valid"],
        """
        SELECT location_id, event_ts_utc, event_ts_local, event_date, event_hour, day_of_week,
            is_weekend,
            coalesce(direction_1, 0) AS direction_1,
            coalesce(direction_2, 0) AS direction_2,
            coalesce(direction_1, 0) + coalesce(direction_2, 0) AS total_of_directions,
            dedupe_key, ingested_ts_utc
        FROM valid
        QUALIFY row_number() OVER (
            PARTITION BY dedupe_key
            ORDER BY ingested_ts_utc DESC NULLS LAST, location_id DESC NULLS LAST,
                event_ts_utc DESC NULLS LAST, coalesce(direction_1, 0) DESC,
                coalesce(direction_2, 0) DESC
        ) = 1
        """,
    ),
    "stg": (
        ["silver"],
        "SELECT * EXCLUDE (total_of_directions), total_of_directions AS pedestrian_count "
        "FROM silver",
    ),
    "hourly": (
        ["stg"],
        """
        SELECT location_id, event_date, event_hour, is_weekend, day_of_week,
            CAST(sum(pedestrian_count) AS BIGINT) AS pedestrian_count,
            CAST(sum(direction_1) AS BIGINT) AS count_direction_1,
            CAST(sum(direction_2) AS BIGINT) AS count_direction_2,
            count(*) AS minutes_reported,
            round(count(*) / CAST(60.0 AS DOUBLE), 3) AS reading_completeness,
            min(event_ts_utc) AS first_reading_ts,
            max(event_ts_utc) AS last_reading_ts
        FROM stg
        GROUP BY location_id, event_date, event_hour, is_weekend, day_of_week
        """,
    ),
    "observed": (
        ["stg"],
        """
        SELECT location_id, min(event_ts_utc) AS first_seen, max(event_ts_utc) AS last_seen,
            count(*) AS reading_count
        FROM stg GROUP BY location_id
        """,
    ),
    "dates": (["stg"], "SELECT DISTINCT event_date AS date_day FROM stg"),
    "calendar": (
        ["dates"],
        """
        SELECT date_day,
            CAST(year(date_day) AS INTEGER) AS year,
            CAST(month(date_day) AS INTEGER) AS month,
            CAST(day(date_day) AS INTEGER) AS day_of_month,
            CAST(isodow(date_day) AS INTEGER) AS day_of_week,
            isodow(date_day) IN (6, 7) AS is_weekend
        FROM dates
        """,
    ),
    "sensors": (
        ["observed"],
        """
        SELECT md5(CAST(location_id AS VARCHAR) || '-' ||
                   strftime(first_seen, '%Y-%m-%d %H:%M:%S')) AS sensor_key,
            location_id, first_seen AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to,
            TRUE AS is_current, last_seen, reading_count
        FROM observed
        """,
    ),
    "fact": (
        ["hourly", "sensors"],
        """
        SELECT md5(CAST(h.location_id AS VARCHAR) || '-' || strftime(h.event_date, '%Y-%m-%d')
                   || '-' || CAST(h.event_hour AS VARCHAR)) AS footfall_key,
            s.sensor_key, h.event_date AS date_key, h.event_hour, h.is_weekend, h.day_of_week,
            h.pedestrian_count, h.count_direction_1, h.count_direction_2, h.minutes_reported,
            h.reading_completeness
        FROM hourly h
        LEFT JOIN sensors s ON h.location_id = s.location_id AND s.is_current
        """,
    ),
    "facts": (
        ["fact", "sensors"],
        """
        SELECT f.sensor_key, s.location_id, f.date_key, f.event_hour, f.is_weekend,
            f.day_of_week, f.pedestrian_count
        FROM fact f LEFT JOIN sensors s ON f.sensor_key = s.sensor_key
        WHERE s.is_current = TRUE
        """,
    ),
    "totals": (
        ["facts"],
        """
        SELECT location_id, CAST(sum(pedestrian_count) AS BIGINT) AS total,
            CAST(trunc(avg(pedestrian_count) FILTER (event_hour = last_hour)) AS INTEGER)
                AS current
        FROM (SELECT *, max(event_hour) OVER (PARTITION BY location_id) AS last_hour FROM facts)
        GROUP BY location_id
        """,
    ),
    "profile": (
        ["facts"],
        """
        SELECT event_hour, CASE WHEN is_weekend THEN 'weekend' ELSE 'weekday' END AS day_type,
            avg(pedestrian_count) AS avg_count
        FROM facts GROUP BY 1, 2
        """,
    ),
    "dense": (
        ["profile"],
        """
        SELECT CAST(h.h AS INTEGER) AS event_hour, d.day_type,
            CAST(trunc(coalesce(p.avg_count, 0)) AS INTEGER) AS avg_count
        FROM range(24) h(h)
        JOIN (VALUES ('weekday'), ('weekend')) d(day_type) ON TRUE
        LEFT JOIN profile p ON p.event_hour = h.h AND p.day_type = d.day_type
        """,
    ),
    "slice": (["fact"], f"SELECT {', '.join(FACT_SLICE)} FROM fact"),
    "timed": (
        ["slice"],
        """
        SELECT sensor_key, date_key, event_hour, day_of_week, pedestrian_count,
            CAST(is_weekend AS INTEGER) AS is_weekend,
            round(sin(2 * pi() * event_hour / 24), 6) + 0.0 AS hour_sin,
            round(cos(2 * pi() * event_hour / 24), 6) + 0.0 AS hour_cos,
            round(sin(2 * pi() * day_of_week / 7), 6) + 0.0 AS dow_sin,
            round(cos(2 * pi() * day_of_week / 7), 6) + 0.0 AS dow_cos
        FROM slice
        """,
    ),
    "lagged": (
        ["timed"],
        """
        SELECT *,
            lag(pedestrian_count, 1) OVER w AS lag_1h,
            lag(pedestrian_count, 2) OVER w AS lag_2h,
            lag(pedestrian_count, 3) OVER w AS lag_3h,
            lag(pedestrian_count, 24) OVER w AS lag_24h,
            CASE WHEN lag(pedestrian_count, 3) OVER w IS NOT NULL THEN
                avg(pedestrian_count) OVER (PARTITION BY sensor_key ORDER BY date_key, event_hour
                    ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END AS roll_mean_3h,
            CASE WHEN lag(pedestrian_count, 6) OVER w IS NOT NULL THEN
                avg(pedestrian_count) OVER (PARTITION BY sensor_key ORDER BY date_key, event_hour
                    ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) END AS roll_mean_6h,
            lead(pedestrian_count, 1) OVER w AS target_next_hour
        FROM timed
        WINDOW w AS (PARTITION BY sensor_key ORDER BY date_key, event_hour)
        """,
    ),
    "feature": (
        ["lagged"],
        """
        SELECT * FROM lagged
        WHERE lag_24h IS NOT NULL AND roll_mean_6h IS NOT NULL AND target_next_hour IS NOT NULL
        """,
    ),
    "split": (
        ["feature"],
        """
        SELECT *, CASE WHEN
                row_number() OVER (ORDER BY date_key, event_hour, sensor_key)
                <= floor(0.8 * count(*) OVER ())
            THEN 'train' ELSE 'test' END AS split
        FROM feature
        """,
    ),
    "status": (
        [],
        """
        SELECT CAST(user_id AS INTEGER) AS location_id, ts AS observed_ts, event_type AS status
        FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
        """,
    ),
    "starts": (
        ["status"],
        """
        SELECT location_id, observed_ts AS valid_from, status FROM (
            SELECT *, lag(status) OVER (PARTITION BY location_id ORDER BY observed_ts) AS before
            FROM (SELECT location_id, observed_ts, max(status) AS status
                  FROM status GROUP BY 1, 2))
        WHERE status IS DISTINCT FROM before
        """,
    ),
    "versions": (
        ["starts"],
        """
        SELECT md5(CAST(location_id AS VARCHAR) || '-' || CAST(valid_from AS VARCHAR))
                AS sensor_key,
            location_id, status, valid_from,
            lead(valid_from) OVER (PARTITION BY location_id ORDER BY valid_from) AS valid_to,
            lead(valid_from) OVER (PARTITION BY location_id ORDER BY valid_from) IS NULL
                AS is_current
        FROM starts
        """,
    ),
    "page_records": (
        ["sent"],
        """
        SELECT
            CASE WHEN event_id % 101 = 0 THEN NULL ELSE CAST(user_id AS INTEGER) END AS location_id,
            strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00'
                AS sensing_datetime,
            strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Australia/Melbourne', '%Y-%m-%d')
                AS sensing_date,
            strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Australia/Melbourne', '%H:%M')
                AS sensing_time,
            CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value) AS INTEGER) END
                AS direction_1,
            CASE WHEN event_type = 'signup' THEN 0 ELSE CAST(props ->> '$.k' AS INTEGER) END
                AS direction_2,
            CAST(floor(value) AS INTEGER) AS total_of_directions,
            event_id % 101 = 0 OR event_id % 89 = 0 OR event_id % 83 = 0 AS malformed
        FROM sent
        """,
    ),
    "event_times": (
        ["bronze"],
        """
        SELECT *, TRY_CAST(sensing_datetime AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS event_ts_utc
        FROM bronze
        """,
    ),
}

LOCATIONS = """
(VALUES
    (1, -37.81340, 144.96520, 'Bourke St Mall (North)'),
    (2, -37.81357, 144.96506, 'Bourke St Mall (South)'),
    (3, -37.81101, 144.96429, 'Melbourne Central'),
    (4, -37.81496, 144.96660, 'Town Hall (West)'),
    (5, -37.81874, 144.96787, 'Princes Bridge'),
    (6, -37.81800, 144.96700, 'Flinders Street Station'),
    (9, -37.81830, 144.95270, 'Southern Cross'),
    (13, -37.81120, 144.95560, 'Flagstaff'),
    (15, -37.80970, 144.96470, 'State Library'),
    (18, -37.81430, 144.97260, 'Collins Place'),
    (23, -37.81870, 144.95430, 'Spencer-Collins'),
    (27, -37.80690, 144.95770, 'QV Market'),
    (30, -37.81000, 144.97260, 'Lonsdale-Spring'),
    (34, -37.81560, 144.97370, 'Flinders-Spring'),
    (47, -37.81150, 144.96650, 'Chinatown-Swanston')
) AS l(location_id, lat, lon, name)
"""


def chain(last: str, *steps: str) -> str:
    """``last`` preceded by the steps it needs, in order."""
    ordered: list[str] = []

    def need(step: str) -> None:
        if step not in ordered:
            for earlier in STEPS[step][0]:
                need(earlier)
            ordered.append(step)

    for step in steps:
        need(step)
    parts = [f"{name} AS ({STEPS[name][1].strip()})" for name in ordered]
    return f"WITH {', '.join(parts)} {last.strip()}" if parts else last.strip()


def _windows(slide_minutes: int) -> str:
    return f"""
    SELECT location_id, window_start, window_start + INTERVAL 1 HOUR AS window_end,
        CAST(sum(total_of_directions) AS BIGINT) AS pedestrians, count(*) AS minutes_reported
    FROM (
        SELECT location_id, total_of_directions,
            time_bucket(INTERVAL {slide_minutes} MINUTE, event_ts_utc)
                - to_minutes(CAST(k.k * {slide_minutes} AS BIGINT)) AS window_start
        FROM silver, range({60 // slide_minutes}) k(k))
    GROUP BY location_id, window_start
    """


def _rules() -> str:
    row_rules = [
        ("not_null_dedupe_key", "silver_pedestrian", "silver", "dedupe_key IS NULL"),
        ("not_null_date_day", "dim_date", "calendar", "date_day IS NULL"),
        ("not_null_sensor_key", "dim_sensor", "sensors", "sensor_key IS NULL"),
        ("not_null_location_id", "dim_sensor", "sensors", "location_id IS NULL"),
        ("not_null_is_current", "dim_sensor", "sensors", "is_current IS NULL"),
        ("not_null_footfall_key", "fact_footfall_hourly", "fact", "footfall_key IS NULL"),
        ("not_null_pedestrian_count", "fact_footfall_hourly", "fact", "pedestrian_count IS NULL"),
        ("not_null_event_hour", "fact_footfall_hourly", "fact", "event_hour IS NULL"),
        ("range_event_hour", "fact_footfall_hourly", "fact", "event_hour NOT BETWEEN 0 AND 23"),
        ("minutes_within_bounds", "fact_footfall_hourly", "fact", "minutes_reported > 60"),
    ]
    parts = [
        f"SELECT '{rule}' AS rule, '{table}' AS table_name, "
        f"count(*) FILTER ({broken}) AS violations FROM {step}"
        for rule, table, step, broken in row_rules
    ]
    for table, step, column in [
        ("silver_pedestrian", "silver", "dedupe_key"),
        ("dim_date", "calendar", "date_day"),
        ("dim_sensor", "sensors", "sensor_key"),
        ("fact_footfall_hourly", "fact", "footfall_key"),
    ]:
        parts.append(
            f"SELECT 'unique_{column}', '{table}', count(*) FROM (SELECT {column} FROM {step} "
            f"WHERE {column} IS NOT NULL GROUP BY {column} HAVING count(*) > 1)"
        )
    for column, step, parent in [
        ("sensor_key", "sensors", "sensor_key"),
        ("date_key", "calendar", "date_day"),
    ]:
        parts.append(
            f"SELECT 'reference_{column}', 'fact_footfall_hourly', count(*) FROM fact f "
            f"WHERE f.{column} IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM {step} p WHERE p.{parent} = f.{column})"
        )
    return (
        "SELECT rule, table_name, violations, violations = 0 AS passed FROM ("
        + " UNION ALL ".join(parts)
        + ")"
    )


def _clock_lags() -> str:
    lags = ", ".join(
        f"max(pedestrian_count) OVER (PARTITION BY sensor_key ORDER BY hour_no "
        f"RANGE BETWEEN {n} PRECEDING AND {n} PRECEDING) AS lag_{n}h"
        for n in (1, 2, 3, 24)
    )
    means = ", ".join(
        f"CASE WHEN count(pedestrian_count) OVER (PARTITION BY sensor_key ORDER BY hour_no "
        f"RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING) = {w} THEN avg(pedestrian_count) OVER "
        f"(PARTITION BY sensor_key ORDER BY hour_no RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING) "
        f"END AS roll_mean_{w}h"
        for w in (3, 6)
    )
    following = (
        "max(pedestrian_count) OVER (PARTITION BY sensor_key ORDER BY hour_no "
        "RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS target_next_hour"
    )
    return f"""
    SELECT {', '.join(FACT_SLICE)}, {lags}, {means}, {following}
    FROM (SELECT *, (date_key - DATE '1970-01-01') * 24 + event_hour AS hour_no FROM slice)
    """


def all_sql() -> dict[str, str]:
    feature_names = (
        "sensor_key, date_key, event_hour, day_of_week, is_weekend, pedestrian_count, hour_sin, "
        "hour_cos, dow_sin, dow_cos, lag_1h, lag_2h, lag_3h, lag_24h, roll_mean_3h, "
        "roll_mean_6h, target_next_hour"
    )
    silver = f"SELECT {SILVER_COLUMNS} FROM silver"
    bronze_arrival = (
        f"SELECT {BRONZE_COLUMNS}, substr(ingested_at, 1, 10) AS dt, "
        "substr(ingested_at, 12, 2) AS hour FROM bronze"
    )
    newest_state = f"""
        SELECT {SILVER_COLUMNS} FROM silver
        QUALIFY row_number() OVER (PARTITION BY location_id
                                   ORDER BY event_ts_utc DESC, ingested_ts_utc DESC) = 1
    """
    fact = f"SELECT {FACT_COLUMNS} FROM fact"
    return {
        # Bronze
        "bronze_rows": chain(f"SELECT {BRONZE_COLUMNS} FROM bronze", "bronze"),
        "bronze_landed": chain(bronze_arrival, "bronze"),
        "bronze_window": chain(
            f"SELECT * FROM ({bronze_arrival}) WHERE dt BETWEEN '2024-01-10' AND '2024-01-12'",
            "bronze",
        ),
        "bronze_day": chain(
            f"SELECT * FROM ({bronze_arrival}) WHERE dt = '2024-01-15'", "bronze"
        ),
        "bronze_summary": chain(
            """
            SELECT count(*) AS total_readings, count(DISTINCT location_id) AS distinct_sensors,
                min(sensing_datetime) AS earliest_event, max(sensing_datetime) AS latest_event
            FROM bronze
            """,
            "bronze",
        ),
        "bronze_busiest": chain(
            """
            SELECT location_id, CAST(sum(total_of_directions) AS BIGINT) AS pedestrians,
                count(*) AS minutes_reported
            FROM bronze GROUP BY location_id
            ORDER BY pedestrians DESC NULLS LAST, location_id NULLS LAST LIMIT 10
            """,
            "bronze",
        ),
        "bronze_duplicates": chain(
            """
            SELECT count(*) AS total_rows, count(DISTINCT dedupe_key) AS distinct_keys,
                count(*) - count(DISTINCT dedupe_key) AS duplicates
            FROM bronze
            """,
            "bronze",
        ),
        "bronze_latest_lag": chain(
            """
            SELECT location_id, sensing_datetime, ingested_at,
                CAST(trunc(epoch(ingested_ts_utc - event_ts_utc)) AS BIGINT) AS lag_seconds
            FROM stamped
            ORDER BY sensing_datetime DESC, location_id NULLS LAST, ingested_at LIMIT 5
            """,
            "stamped",
        ),
        "ingest_lag_stats": chain(
            """
            SELECT location_id, count(lag) AS readings, avg(lag) AS avg_lag_seconds,
                max(lag) AS max_lag_seconds
            FROM (SELECT location_id,
                    CAST(trunc(epoch(ingested_ts_utc - event_ts_utc)) AS BIGINT) AS lag
                  FROM stamped)
            GROUP BY location_id
            """,
            "stamped",
        ),
        "page_parse": chain(
            """
            SELECT location_id, sensing_datetime, sensing_date, sensing_time, direction_1,
                direction_2, total_of_directions
            FROM page_records WHERE NOT malformed
            """,
            "page_records",
        ),
        "page_coercion": """
            SELECT CAST(event_id AS INTEGER) AS location_id,
                strftime(ts, '%Y-%m-%dT%H:%M:%S') AS sensing_datetime,
                CAST(direction_1 AS INTEGER) AS direction_1, 0 AS direction_2
            FROM (SELECT *, [5, 3, -3, 4, 4, NULL, 1, 0, 0, 0, 0, 0, NULL, 10, 100, NULL, NULL,
                    3][event_id % 18 + 1] AS direction_1 FROM events)
            WHERE direction_1 IS NOT NULL
        """,
        "page_skips": chain(
            """
            SELECT count(*) AS records, count(*) FILTER (malformed) AS skipped FROM page_records
            """,
            "page_records",
        ),
        "stream_records": chain(
            f"""
            SELECT CAST(location_id AS VARCHAR) AS key, CAST(to_json(record) AS VARCHAR) AS value
            FROM (
                SELECT location_id, {{{', '.join(f"'{c}': {c}" for c in READING_COLUMNS)},
                    'dedupe_key': CAST(location_id AS VARCHAR) || '#' || sensing_datetime,
                    'ingested_at': '2024-01-15T12:00:00+00:00'}} AS record
                FROM bronze)
            """,
            "bronze",
        ),
        # Silver
        "typed": chain(f"SELECT {TYPED_COLUMNS} FROM typed", "typed"),
        "valid_rows": chain(f"SELECT {TYPED_COLUMNS} FROM valid", "valid"),
        "quarantine_rows": chain(
            f"""
            SELECT {TYPED_COLUMNS} FROM typed
            WHERE location_id IS NULL OR location_id <= 0 OR event_ts_utc IS NULL
            """,
            "typed",
        ),
        "clean_counts": chain(
            """
            SELECT location_id, sensing_datetime, sensing_date, sensing_time,
                coalesce(direction_1, 0) AS direction_1, coalesce(direction_2, 0) AS direction_2,
                coalesce(direction_1, 0) + coalesce(direction_2, 0) AS total_of_directions,
                dedupe_key, ingested_at
            FROM bronze
            """,
            "bronze",
        ),
        "dedup_latest": chain(
            f"""
            SELECT {TYPED_COLUMNS} FROM typed
            QUALIFY row_number() OVER (
            PARTITION BY dedupe_key
            ORDER BY ingested_ts_utc DESC NULLS LAST, location_id DESC NULLS LAST,
                event_ts_utc DESC NULLS LAST, coalesce(direction_1, 0) DESC,
                coalesce(direction_2, 0) DESC
        ) = 1
            """,
            "typed",
        ),
        "dedup_lineitem": """
            SELECT * FROM lineitem
            QUALIFY row_number() OVER (
                PARTITION BY l_orderkey, l_linenumber
                ORDER BY l_shipdate DESC NULLS LAST, l_partkey DESC NULLS LAST,
                    l_suppkey DESC NULLS LAST, l_quantity DESC NULLS LAST,
                    l_extendedprice DESC NULLS LAST, l_discount DESC NULLS LAST,
                    l_tax DESC NULLS LAST, l_returnflag DESC NULLS LAST,
                    l_linestatus DESC NULLS LAST) = 1
        """,
        "silver_rows": chain(silver, "silver"),
        "silver_table": chain(silver, "silver"),
        "silver_incremental": chain(silver, "silver"),
        "stream_silver": chain(silver, "silver"),
        "quarantine_table": chain(
            """
            SELECT sensing_date, count(*) AS quarantined_rows,
                count(location_id) AS with_location, count(event_ts_utc) AS with_time
            FROM typed
            WHERE location_id IS NULL OR location_id <= 0 OR event_ts_utc IS NULL
            GROUP BY sensing_date
            """,
            "typed",
        ),
        "late_flag": chain(
            """
            SELECT dedupe_key, event_ts_utc, ingested_ts_utc,
                ingested_ts_utc - event_ts_utc > INTERVAL 15 MINUTE AS is_late
            FROM silver
            """,
            "silver",
        ),
        # Gold
        "stg": chain(
            f"SELECT {SILVER_COLUMNS.replace('total_of_directions', 'pedestrian_count')} FROM stg",
            "stg",
        ),
        "hourly_counts": chain("SELECT * FROM hourly", "hourly"),
        "sensor_observations": chain("SELECT * FROM observed", "observed"),
        "observed_dates": chain("SELECT date_day FROM dates", "dates"),
        "dim_date": chain("SELECT * FROM calendar", "calendar"),
        "dim_sensor": chain("SELECT * FROM sensors", "sensors"),
        "fact_hourly": chain(fact, "fact"),
        "gold_published": chain(fact, "fact"),
        "marts_by_name": chain(
            """
            SELECT location_id, isodow(date_key) IN (6, 7) AS is_weekend, count(*) AS hours,
                CAST(sum(pedestrian_count) AS BIGINT) AS pedestrians
            FROM fact JOIN sensors USING (sensor_key)
            GROUP BY 1, 2
            """,
            "fact",
            "sensors",
        ),
        "scd2_versions": chain("SELECT * FROM versions", "versions"),
        "scd2_merged": chain("SELECT * FROM versions", "versions"),
        "scd2_merged_late": chain("SELECT * FROM versions", "versions"),
        "scd2_log": chain("SELECT * FROM versions", "versions"),
        "scd2_point_in_time": chain(
            """
            SELECT s.location_id, s.event_ts_utc, s.dedupe_key, s.total_of_directions,
                v.status, v.valid_from, v.valid_to
            FROM silver s LEFT JOIN versions v
                ON s.location_id = v.location_id AND s.event_ts_utc >= v.valid_from
                AND (v.valid_to IS NULL OR s.event_ts_utc < v.valid_to)
            """,
            "silver",
            "versions",
        ),
        # quality
        "dq_report": chain(_rules(), "silver", "calendar", "sensors", "fact"),
        "dq_repeated_keys": chain(
            """
            SELECT dedupe_key, count(*) AS copies FROM bronze WHERE dedupe_key IS NOT NULL
            GROUP BY dedupe_key HAVING count(*) > 1
            """,
            "bronze",
        ),
        "dq_minutes_bound": chain(
            """
            SELECT f.footfall_key, CAST(60 * count(*) AS INTEGER) AS minutes_bound,
                any_value(f.minutes_reported) > 60 * count(*) AS too_many
            FROM fact f JOIN range(-1, 2) k(k) ON
                timezone('Australia/Melbourne', timezone('Australia/Melbourne',
                    CAST(f.date_key AS TIMESTAMP) + to_hours(f.event_hour)) + to_hours(k.k))
                = CAST(f.date_key AS TIMESTAMP) + to_hours(f.event_hour)
            GROUP BY f.footfall_key
            """,
            "fact",
        ),
        "orphan_facts": chain(
            """
            SELECT footfall_key, sensor_key, date_key FROM fact
            WHERE sensor_key IS NOT NULL AND sensor_key NOT IN (
                SELECT sensor_key FROM sensors
                WHERE CAST(last_seen AS DATE) = (SELECT CAST(max(last_seen) AS DATE) FROM sensors))
            """,
            "fact",
            "sensors",
        ),
        "orphan_orders": """
            SELECT o_custkey, count(*) AS child_rows FROM orders
            WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (
                SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey IS NOT NULL)
            GROUP BY o_custkey
        """,
        "reconcile": chain(
            """
            SELECT *, bronze_rows = silver_rows + duplicate_rows + quarantined_rows AS reconciled
            FROM (
                SELECT (SELECT count(*) FROM typed) AS bronze_rows,
                    (SELECT count(*) FROM silver) AS silver_rows,
                    (SELECT count(*) - count(DISTINCT dedupe_key) FROM valid) AS duplicate_rows,
                    (SELECT count(*) FROM typed) - (SELECT count(*) FROM valid)
                        AS quarantined_rows)
            """,
            "silver",
            "valid",
        ),
        "freshness": chain(
            """
            SELECT newest_ingested, waiting_rows, waiting_rows > 0 AS has_new_data,
                CAST(trunc(epoch(TIMESTAMP '2024-02-01 00:00:00' - oldest)) AS BIGINT)
                    AS waited_seconds,
                coalesce(TIMESTAMP '2024-02-01 00:00:00' - oldest > INTERVAL 900 SECOND, FALSE)
                    AS is_stale
            FROM (
                SELECT max(ingested_ts_utc) AS newest_ingested,
                    count(*) FILTER (ingested_ts_utc > TIMESTAMP '2024-01-15 12:00:00')
                        AS waiting_rows,
                    min(ingested_ts_utc) FILTER
                        (ingested_ts_utc > TIMESTAMP '2024-01-15 12:00:00') AS oldest
                FROM stamped)
            """,
            "stamped",
        ),
        "quarantine_rate": chain(
            """
            SELECT sensing_date, count(*) AS bronze_rows, count(*) FILTER (bad)
                AS quarantined_rows, count(*) FILTER (bad) / count(*) AS quarantine_ratio
            FROM (SELECT sensing_date, location_id IS NULL OR location_id <= 0
                    OR event_ts_utc IS NULL AS bad FROM typed)
            GROUP BY sensing_date
            """,
            "typed",
        ),
        # serving
        "serving_facts_inner": chain("SELECT * FROM facts", "facts"),
        "serving_facts_left": chain(
            """
            SELECT f.sensor_key, s.location_id, f.event_hour, f.is_weekend, f.pedestrian_count
            FROM fact f LEFT JOIN sensors s ON f.sensor_key = s.sensor_key AND s.is_current
            """,
            "fact",
            "sensors",
        ),
        "sensor_lookup": chain(
            f"""
            SELECT t.location_id, t.total, t.current, CAST(l.lat AS DOUBLE) AS lat,
                CAST(l.lon AS DOUBLE) AS lon, l.name
            FROM totals t JOIN {LOCATIONS} ON t.location_id = l.location_id
            """,
            "totals",
        ),
        "headline": chain(
            """
            SELECT count(pedestrian_count) AS total_readings,
                count(DISTINCT sensor_key) AS distinct_sensors,
                (SELECT count(*) FROM (SELECT DISTINCT date_key, event_hour FROM facts))
                    AS distinct_hours,
                max(pedestrian_count) AS peak_count
            FROM facts
            """,
            "facts",
        ),
        "busiest_sensors": chain(
            """
            SELECT sensor_key, CAST(sum(pedestrian_count) AS BIGINT) AS total_pedestrians
            FROM facts GROUP BY sensor_key ORDER BY total_pedestrians DESC, sensor_key LIMIT 10
            """,
            "facts",
        ),
        "avg_by_hour": chain(
            """
            SELECT event_hour, avg(pedestrian_count) AS avg_count FROM facts
            GROUP BY event_hour ORDER BY event_hour
            """,
            "facts",
        ),
        "hourly_profile": chain("SELECT * FROM profile", "profile"),
        "hourly_profile_dense": chain("SELECT * FROM dense", "dense"),
        "profile_outlook": chain(
            """
            SELECT s.series, CAST(s.hour AS INTEGER) AS hour, d.avg_count
            FROM (SELECT 'actual' AS series, range AS hour FROM range(9, 16)
                  UNION ALL SELECT 'predicted', range FROM range(15, 22)) s
            JOIN dense d ON d.event_hour = s.hour % 24 AND d.day_type = 'weekday'
            """,
            "dense",
        ),
        "sensor_totals_current": chain("SELECT * FROM totals", "totals"),
        "latest_hour_counts": chain(
            """
            SELECT location_id, date_key, event_hour, pedestrian_count FROM facts
            QUALIFY row_number() OVER (PARTITION BY location_id
                                       ORDER BY date_key DESC, event_hour DESC) = 1
            """,
            "facts",
        ),
        "snapshot_meta": chain(
            """
            SELECT count(pedestrian_count) AS total_readings, count(*) AS gold_facts,
                count(DISTINCT sensor_key) AS sensor_versions
            FROM facts
            """,
            "facts",
        ),
        "load_bands": chain(
            """
            SELECT location_id, total, current, load,
                CASE WHEN load > 0.66 THEN 'high' WHEN load > 0.33 THEN 'medium' ELSE 'low' END
                    AS band
            FROM (SELECT *, CASE WHEN max(current) OVER () > 0
                THEN current / max(current) OVER () END AS load FROM totals)
            """,
            "totals",
        ),
        "top_bars": chain(
            """
            SELECT location_id, total, round(total / max(total) OVER () * 100, 1) AS width_pct
            FROM (SELECT * FROM totals ORDER BY total DESC, location_id LIMIT 8)
            """,
            "totals",
        ),
        "snapshot": chain(
            f"""
            SELECT CAST(to_json({{
                'sensors': (SELECT list({{'id': t.location_id, 'name': l.name,
                        'lat': CAST(l.lat AS DOUBLE), 'lon': CAST(l.lon AS DOUBLE),
                        'total': t.total, 'current': t.current}} ORDER BY t.location_id)
                    FROM totals t JOIN {LOCATIONS} ON t.location_id = l.location_id),
                'hourly': {{
                    'weekday': (SELECT list(avg_count ORDER BY event_hour) FROM dense
                        WHERE day_type = 'weekday'),
                    'weekend': (SELECT list(avg_count ORDER BY event_hour) FROM dense
                        WHERE day_type = 'weekend')}},
                'forecast': {{
                    'from_hour': 15,
                    'actual': (SELECT list(avg_count ORDER BY event_hour) FROM dense
                        WHERE day_type = 'weekday' AND event_hour BETWEEN 9 AND 15),
                    'predicted': (SELECT list(avg_count ORDER BY event_hour) FROM dense
                        WHERE day_type = 'weekday' AND event_hour BETWEEN 15 AND 21)}},
                'meta': {{
                    'total_readings': (SELECT count(pedestrian_count) FROM facts),
                    'gold_facts': (SELECT count(*) FROM facts),
                    'sensor_versions': (SELECT count(DISTINCT sensor_key) FROM facts)}}
            }}) AS VARCHAR) AS document
            """,
            "totals",
            "dense",
        ),
        # features and forecast
        "time_features": chain("SELECT * FROM timed", "timed"),
        "lag_features": chain(
            """
            SELECT s.*, l.lag_1h, l.lag_2h, l.lag_3h, l.lag_24h, l.roll_mean_3h, l.roll_mean_6h
            FROM lagged l JOIN slice s USING (sensor_key, date_key, event_hour)
            """,
            "lagged",
        ),
        "lag_features_calendar": chain(_clock_lags(), "slice"),
        "target": chain(
            """
            SELECT s.*, l.target_next_hour
            FROM lagged l JOIN slice s USING (sensor_key, date_key, event_hour)
            """,
            "lagged",
        ),
        "feature_rows": chain(f"SELECT {feature_names} FROM feature", "feature"),
        "feature_rows_chunked": chain(f"SELECT {feature_names} FROM feature", "feature"),
        "time_split": chain("SELECT sensor_key, date_key, event_hour, split FROM split", "split"),
        "split_sizes": chain("SELECT split, count(*) AS rows FROM split GROUP BY split", "split"),
        "gbt_reloaded": chain(
            """
            SELECT sensor_key, date_key, event_hour, true AS usable FROM split
            WHERE split = 'test'
            """,
            "split",
        ),
        "naive_metrics": chain(
            """
            SELECT round(avg(abs(target_next_hour - greatest(lag_24h, 0)))
                    FILTER (split = 'test'), 6) AS mae,
                round(avg(abs(greatest(target_next_hour, 1) - greatest(lag_24h, 1))
                    / greatest(target_next_hour, 1)) FILTER (split = 'test'), 6) AS mape,
                count(*) FILTER (split = 'train') AS n_train,
                count(*) FILTER (split = 'test') AS n_test
            FROM split
            """,
            "split",
        ),
        # increments and streams
        "incremental_new": chain(
            f"""
            SELECT {BRONZE_COLUMNS}, event_ts_utc FROM event_times
            WHERE event_ts_utc IS NULL OR event_ts_utc > TIMESTAMP '2024-01-15 12:00:00'
            """,
            "event_times",
        ),
        "watermark_max": chain(
            "SELECT max(event_ts_utc) AS last_event_ts FROM event_times", "event_times"
        ),
        "poll_summary": chain(
            """
            SELECT 'ok' AS status, (SELECT count(*) FROM bronze) AS fetched, n AS new,
                n AS emitted, n AS landed
            FROM (SELECT count(*) AS n FROM event_times
                  WHERE event_ts_utc IS NULL OR event_ts_utc > TIMESTAMP '2024-01-15 12:00:00')
            """,
            "event_times",
        ),
        "poll_pages": chain(
            """
            SELECT location_id, sensing_datetime, sensing_date, sensing_time, direction_1,
                direction_2, total_of_directions,
                CAST(location_id AS VARCHAR) || '#' || sensing_datetime AS dedupe_key
            FROM event_times
            WHERE event_ts_utc IS NULL OR event_ts_utc > TIMESTAMP '2024-01-15 12:00:00'
            """,
            "event_times",
        ),
        "current_state": chain(newest_state, "silver"),
        "stream_state": chain(newest_state, "silver"),
        "rolling_hourly_batch": chain(_windows(5), "silver"),
        "tumbling_hourly_batch": chain(_windows(60), "silver"),
        "stream_rolling": chain(
            """
            SELECT location_id, date_trunc('hour', event_ts_utc) AS window_start,
                date_trunc('hour', event_ts_utc) + INTERVAL 1 HOUR AS window_end,
                CAST(sum(coalesce(direction_1, 0) + coalesce(direction_2, 0)) AS BIGINT)
                    AS pedestrians,
                count(*) AS minutes_reported
            FROM valid GROUP BY ALL
            """,
            "valid",
        ),
        "stream_landing": chain(
            """
            SELECT count(*) FILTER (event_ts_utc IS NOT NULL) AS landed_rows,
                count(DISTINCT dedupe_key) FILTER (event_ts_utc IS NOT NULL) AS landed_keys,
                CAST(sum(direction_1) FILTER (event_ts_utc IS NOT NULL) AS BIGINT)
                    AS landed_direction_1,
                count(*) FILTER (event_ts_utc IS NULL) AS error_rows
            FROM stamped
            """,
            "stamped",
        ),
        "scalar_functions": chain(
            """
            SELECT dedupe_key, ingested_at, event_ts_utc AS strict_ts,
                strftime(event_ts_utc, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso_text,
                event_ts_local AS local_ts,
                strftime(event_date, '%Y-%m-%d') AS day_text,
                CAST(isodow(event_date) AS INTEGER) AS iso_weekday,
                CAST((event_date - DATE '1970-01-01') * 24 + event_hour AS INTEGER) AS hour_index,
                CAST(trunc(epoch(ingested_ts_utc - event_ts_utc)) AS BIGINT) AS lag_seconds,
                CAST(location_id AS VARCHAR) || '#' || sensing_datetime AS natural_key,
                md5(coalesce(CAST(location_id AS VARCHAR), '_dbt_utils_surrogate_key_null_')
                    || '-' || coalesce(strftime(event_ts_utc, '%Y-%m-%d %H:%M:%S'),
                                       '_dbt_utils_surrogate_key_null_')) AS surrogate_key,
                coalesce(direction_1, 0) AS zero_if_null,
                CAST(greatest(total_of_directions, 1) AS DOUBLE) AS at_least_one,
                round(ln(1 + CAST(total_of_directions AS DOUBLE)), 6) AS log1p,
                round(exp(CAST(event_hour AS DOUBLE) / 24) - 1, 6) AS expm1,
                CAST(NULL AS INTEGER) AS not_a_number,
                CAST((event_hour + 15) % 24 AS INTEGER) AS wrapped_hour
            FROM typed
            """,
            "typed",
        ),
    }
