"""The registered queries as plain SQL over the given tables.

Written independently of the operators: envelopes are not decoded but read off the
columns they were made of, percentiles use the engine's own functions, and packing is a
recursive walk.
"""

from __future__ import annotations

NAME = "'Customer#' || lpad(CAST({} AS VARCHAR), 9, '0')"
AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
START = "TIMESTAMP '2024-01-01 00:00:00'"


def time_text(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


VIEWS: dict[str, str] = {
    "fn": """
        SELECT r_name AS region, c_name AS function_name, c_mktsegment AS runtime,
               CAST(128 * (1 + c_custkey % 8) AS INTEGER) AS memory_size,
               CAST(round(abs(c_acctbal) * 1024) AS BIGINT) AS code_size,
               make_timestamp((1672531200 + c_custkey * 3600) * 1000000) AS last_modified,
               c_custkey
        FROM customer JOIN region ON r_regionkey = c_custkey % 5""",
    "ev": f"""
        SELECT e.*, r_name AS region, {NAME.format("user_id")} AS function_name
        FROM events e JOIN region ON r_regionkey = user_id % 5""",
    "od": f"""
        SELECT o.*, r_name AS region, {NAME.format("o_custkey")} AS function_name
        FROM orders o JOIN region ON r_regionkey = o_custkey % 5""",
    "su": "SELECT s.*, r_name AS region FROM supplier s JOIN region ON r_regionkey = s_suppkey % 5",
    "logs": """
        SELECT region, '1234567890:/aws/lambda/' || function_name AS log, ts,
               'stream-' || (event_id % 9973) AS log_stream,
               128 * (1 + (user_id + event_id % 2) % 8) * 1000000 AS memory_bytes,
               'REPORT RequestId: ' || event_id || ' Duration: ' || (event_id % 1000)
               || ' ms Billed Duration: ' || (event_id % 1000) || ' ms Memory Size: '
               || (128 * (1 + (user_id + event_id % 2) % 8)) || ' MB Max Memory Used: 64 MB'
               || CASE event_type WHEN 'signup' THEN ' Init Duration: ' || value || ' ms'
                                  WHEN 'error' THEN ' init duration: ' || value || ' ms'
                                  ELSE '' END AS message
        FROM ev""",
    "parsed": f"""
        SELECT region, regexp_extract(log, '/aws/lambda/(.*)', 1) AS function_name,
               memory_bytes / 1000000.0 AS memory_mb,
               TRY_CAST(nullif(regexp_extract(message, 'Init Duration: (.*) ms', 1), '') AS DOUBLE) AS init_ms,
               TRY_CAST(nullif(regexp_extract(message, ' Duration: ([0-9.]+) ms', 1), '') AS DOUBLE) AS duration_ms
        FROM logs
        WHERE message ILIKE '%init duration%' AND ts BETWEEN {START} AND {AS_OF}""",
    "stats": """
        SELECT region, function_name, memory_mb, count(*) AS cold_starts, median(init_ms) AS median_init_ms,
               quantile_cont(init_ms, 0.75) AS p75_init_ms, quantile_cont(init_ms, 0.95) AS p95_init_ms,
               max(init_ms) AS max_init_ms, stddev_samp(init_ms) AS stddev_init_ms
        FROM parsed GROUP BY ALL""",
    "pc": """
        SELECT region, function_name, CAST(sum(1 + o_orderkey % 50) AS BIGINT) AS provisioned_concurrency,
               count(*) AS qualifiers
        FROM od GROUP BY ALL""",
    "pc_used": f"""
        SELECT region, function_name, max(value / 500) AS pc_utilisation
        FROM ev WHERE ts BETWEEN {START} AND {AS_OF}
          AND (function_name, event_id % 4) IN (SELECT function_name, o_orderkey % 6 FROM od)
        GROUP BY ALL""",
    "pc_report": """
        SELECT region, function_name, provisioned_concurrency, qualifiers,
               round(coalesce(pc_utilisation, 0), 6) AS pc_utilisation
        FROM pc LEFT JOIN pc_used USING (region, function_name)""",
    "report": """
        SELECT region, function_name, runtime,
               round(coalesce(memory_mb, CAST(memory_size AS DOUBLE)), 6) AS memory_size, CAST(cold_starts AS DOUBLE) AS cold_starts,
               round(median_init_ms, 6) AS median_init_ms, round(p75_init_ms, 6) AS p75_init_ms,
               round(p95_init_ms, 6) AS p95_init_ms, round(max_init_ms, 6) AS max_init_ms,
               round(stddev_init_ms, 6) AS stddev_init_ms,
               coalesce(provisioned_concurrency, 0) AS provisioned_concurrency,
               coalesce(pc_utilisation, 0.0) AS pc_utilisation
        FROM fn LEFT JOIN stats USING (region, function_name) LEFT JOIN pc_report USING (region, function_name)""",
    "totals": f"""
        SELECT region, function_name, CAST(count(*) AS DOUBLE) AS n, sum(value) AS ms
        FROM ev WHERE ts BETWEEN {START} AND {AS_OF} GROUP BY ALL""",
    "cost": """
        SELECT region, function_name, runtime, memory_size, coalesce(n, 0.0) AS invocation_count,
               CASE WHEN n > 0 THEN ceil(ms / n / 100) * (memory_size / 128.0) * 0.000000208 + 0.0000002
                    ELSE 0.0 END AS average_cost
        FROM fn LEFT JOIN totals USING (region, function_name)""",
    "activity": f"""
        SELECT region, function_name, runtime, memory_size, code_size,
               {time_text("last_modified")} AS last_modified, {time_text("last_used")} AS last_used,
               last_used IS NULL AS is_inactive
        FROM fn LEFT JOIN (SELECT region, function_name, date_trunc('hour', max(ts)) AS last_used
                           FROM ev WHERE ts BETWEEN {START} AND {AS_OF} GROUP BY ALL)
             USING (region, function_name)""",
    "hourly": f"""
        SELECT region, function_name, date_trunc('hour', ts) AS bucket_start, sum(value) AS value
        FROM ev WHERE ts BETWEEN {START} AND {AS_OF} GROUP BY ALL""",
    "capacity": f"""
        SELECT region, 'table-' || (user_id % 10) AS table_name, date_trunc('day', ts) AS day,
               sum(value) AS consumed_read, sum(value / 2) AS consumed_write,
               avg(CAST(5 + user_id % 3 AS DOUBLE)) AS provisioned_read, avg(5.0) AS provisioned_write
        FROM ev WHERE ts BETWEEN {START} AND {AS_OF} GROUP BY ALL""",
    "streams": """
        SELECT DISTINCT region, event_type AS stream_name, CAST(1 + 2 * (length(event_type) % 3) AS INTEGER) AS shards
        FROM ev""",
    "lines": """
        SELECT source AS file, doc_id, CAST(i - 1 AS INTEGER) AS line_no, line, CAST(strlen(line) AS INTEGER) AS n_bytes
        FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line,
                     generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
        WHERE line <> ''""",
    "part_lines": """
        SELECT * FROM (
            SELECT *, sum(n_bytes + 1) OVER (PARTITION BY file ORDER BY doc_id, line_no) - n_bytes - 1 AS pos FROM (
                SELECT 'source=' || source || '/' || doc_id % 4 AS file, doc_id, CAST(i - 1 AS INTEGER) AS line_no,
                       CAST(strlen(line) AS INTEGER) AS n_bytes
                FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line,
                             generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)))
        WHERE n_bytes > 0""",
    "files": """
        SELECT CASE source WHEN 'src0' THEN '_src0 [a-b]{c}*' ELSE 'source=' || source END AS folder,
               doc_id % 4 AS part, doc_id, lang, n_chars, doc_id % 97 = 5 AS broken,
               CASE WHEN doc_id % 97 = 5 THEN '{"doc_id": ' || doc_id
                    ELSE '{"doc_id":' || doc_id || ',"lang":"' || coalesce(lang, '') || '","n_chars":' || n_chars || '}'
               END AS line FROM documents""",
    "msgs": """
        SELECT 'msg-' || event_id AS message_id, event_type || '-dlq' AS queue,
               '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type
               || '","value":' || value || '}' AS body, 'event_type=String:' || event_type AS attributes
        FROM ev""",
    "topic": """
        SELECT event_id, event_type AS subject, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS "timestamp",
               props AS message, CAST(user_id AS VARCHAR) AS message_attributes FROM ev""",
    "busev": """
        SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS "time", region, event_type AS source,
               function_name AS resources, CASE WHEN value > 50 THEN 'large' ELSE 'small' END AS detail_type,
               replace(props, ' ', '') AS detail FROM ev""",
    "change": """
        SELECT event_id AS source_id, 'change-' || event_id AS event_id,
               CASE event_type WHEN 'signup' THEN 'INSERT' ELSE 'MODIFY' END AS event_name,
               '49590338271490256608559692538361' || event_id AS sequence_number, length(props) AS size_bytes,
               'NEW_IMAGE' AS view_type, 'id=' || event_id AS keys,
               'kind=' || event_type || ',user=' || user_id AS new_image FROM ev""",
    "record": """
        SELECT 'shardId-00000000000' || (event_id % 5) AS shard_id,
               lpad(CAST(event_id AS VARCHAR), 20, '0') AS sequence_number,
               CASE WHEN event_type IN ('view', 'click', 'purchase') THEN props
                    ELSE 'message ' || event_id END AS text,
               event_type IN ('view', 'click', 'purchase') AS is_json FROM ev""",
    "res": """
        SELECT 'bucket' AS type, NULL AS region, CAST(p_partkey AS VARCHAR) AS id, 'bucket-' || p_partkey AS name,
               NULL AS status, NULL AS parent, NULL AS path, CAST(NULL AS BIGINT) AS bytes FROM part
        UNION ALL SELECT 'event_bus', region, CAST(c_custkey AS VARCHAR),
               CASE runtime WHEN 'BUILDING' THEN 'default' ELSE 'bus-' || c_custkey END, NULL, NULL, NULL, NULL FROM fn
        UNION ALL SELECT 'stack', region, CAST(o_orderkey AS VARCHAR), 'stack-' || o_orderkey,
               CASE o_orderstatus WHEN 'F' THEN 'CREATE_COMPLETE' WHEN 'O' THEN 'UPDATE_COMPLETE'
                                  ELSE 'DELETE_IN_PROGRESS' END, NULL, NULL, NULL FROM od
        UNION ALL SELECT 'http_api', region, CAST(s_suppkey AS VARCHAR), 'http-' || s_suppkey, NULL, NULL, NULL, NULL FROM su
        UNION ALL SELECT 'rest_api', r_name, CAST(n_nationkey AS VARCHAR), 'rest-' || n_nationkey, NULL, NULL, NULL, NULL
               FROM nation JOIN region ON r_regionkey = n_nationkey % 5
        UNION ALL SELECT 'role', region, CAST(s_suppkey AS VARCHAR), 'role-' || s_suppkey, NULL, NULL,
               CASE WHEN s_nationkey < 5 THEN '/aws-service-role/x/' ELSE '/my-roles/' END, NULL FROM su
        UNION ALL SELECT 'function', region, CAST(c_custkey AS VARCHAR), function_name, NULL, NULL, NULL, NULL FROM fn
        UNION ALL SELECT 'log_group', r_name, CAST(c_custkey AS VARCHAR), '/aws/lambda/' || c_name, NULL, NULL, NULL,
               CAST(round(abs(c_acctbal)) AS BIGINT) FROM customer JOIN region ON r_regionkey = c_custkey % 5
        UNION ALL SELECT 'nat_gateway', region, CAST(s_suppkey AS VARCHAR), 'nat-' || s_suppkey, NULL,
               'vpc-' || s_nationkey, NULL, NULL FROM su
        UNION ALL SELECT 'policy', NULL, CAST(p_partkey AS VARCHAR), 'policy-' || p_partkey,
               CASE WHEN p_size < 25 THEN 'Local' ELSE 'AWS' END, NULL, NULL, NULL FROM part""",
    "attempts": """
        SELECT o_orderpriority AS type, region, 'res-' || o_custkey AS name, o_orderkey AS attempt,
               CASE o_orderstatus WHEN 'F' THEN 'fail' WHEN 'O' THEN 'success' ELSE 'skip' END AS status,
               CASE o_orderstatus WHEN 'F' THEN 'error ' || o_orderkey END AS reason
        FROM od QUALIFY row_number() OVER (PARTITION BY type, region, name ORDER BY attempt DESC) = 1""",
    "ver": """
        SELECT p_brand AS app, p_partkey, p_type, p_size, p_size % 5 AS v1, p_size % 13 AS v2, p_partkey % 17 AS v3,
               (p_size % 5) || '.' || (p_size % 13) || '.' || (p_partkey % 17)
               || CASE p_type WHEN 'ECONOMY' THEN '-beta.' || p_size ELSE '' END AS version FROM part""",
    "latest": """
        SELECT app, version AS latest_version FROM ver
        QUALIFY row_number() OVER (PARTITION BY app ORDER BY v1 DESC, v2 DESC, v3 DESC,
            CASE p_type WHEN 'ECONOMY' THEN 0 ELSE 1 END DESC, p_size DESC) = 1""",
    "deployed": """
        SELECT app, version AS deployed_version, p_type FROM ver
        QUALIFY row_number() OVER (PARTITION BY app ORDER BY p_partkey) = 1""",
    "power": """
        SELECT region, function_name, memory_mb AS power, average_ms,
               ceil(average_ms / 100) * (memory_mb / 128.0) * 0.000000208 + 0.0000002 AS average_cost, invocations
        FROM (SELECT region, function_name, CAST(128 * (1 + event_id % 4) AS INTEGER) AS memory_mb,
                     avg(round(value * 20)) AS average_ms, count(*) AS invocations FROM ev GROUP BY ALL)""",
}

# Views that a view reads.
NEEDS = {
    "logs": ["ev"],
    "parsed": ["logs"],
    "stats": ["parsed"],
    "pc": ["od"],
    "pc_used": ["ev", "od"],
    "pc_report": ["pc", "pc_used"],
    "report": ["fn", "stats", "pc_report"],
    "totals": ["ev"],
    "cost": ["fn", "totals"],
    "activity": ["fn", "ev"],
    "hourly": ["ev"],
    "capacity": ["ev"],
    "streams": ["ev"],
    "msgs": ["ev"],
    "topic": ["ev"],
    "busev": ["ev"],
    "change": ["ev"],
    "record": ["ev"],
    "res": ["fn", "od", "su"],
    "attempts": ["od"],
    "latest": ["ver"],
    "deployed": ["ver"],
    "power": ["ev"],
}


def using(names: str, body: str, recursive: str = "") -> str:
    """The body below the named views and those they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    views = [f"{name} AS ({VIEWS[name]})" for name in ordered]
    if recursive:
        views.append(recursive)
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(views)} {body}"


def stat_sql(value: str, aggregate: str, period: str, metric: str) -> str:
    return using(
        "ev",
        f"""SELECT region, '{metric}' AS metric, function_name,
            {time_text(f"date_trunc('{period}', ts)")} AS bucket_start, round({aggregate}({value}), 8) AS value
            FROM ev WHERE ts BETWEEN {START} AND {AS_OF} GROUP BY ALL""",
    )


def stats_sql(value: str, suffix: str) -> str:
    return using(
        "parsed",
        f"""SELECT region, function_name, round(memory_mb, 6) AS memory_mb, count(*) AS cold_starts,
            round(median({value}), 6) AS median_{suffix}, round(quantile_cont({value}, 0.75), 6) AS p75_{suffix},
            round(quantile_cont({value}, 0.95), 6) AS p95_{suffix}, round(max({value}), 6) AS max_{suffix},
            round(stddev_samp({value}), 6) AS stddev_{suffix}
            FROM parsed GROUP BY region, function_name, parsed.memory_mb""",
    )


def cost_sql(where: str = "") -> str:
    return using(
        "cost",
        f"""SELECT region, function_name, runtime, memory_size,
            round(average_cost * invocation_count, 10) AS total_cost, invocation_count,
            round(average_cost, 10) AS average_cost FROM cost {where}""",
    )


def packing_sql(max_bytes: int, body: str, lines: str = "lines") -> str:
    """Batch starts by walking from each batch to the next, in every file at once."""
    sums = ", ".join(
        f"n_bytes + {' + '.join(f'lead(n_bytes, {j}) OVER w' for j in range(1, k))} AS s{k}"
        for k in range(2, 11)
    )
    fits = " + ".join(f"CAST(coalesce(s{k} < {max_bytes}, FALSE) AS INTEGER)" for k in range(2, 11))
    recursive = f"""
        numbered AS (
            SELECT *, row_number() OVER (PARTITION BY file ORDER BY doc_id, line_no) - 1 AS p FROM {lines}),
        summed AS (
            SELECT file, p, {sums} FROM numbered WINDOW w AS (PARTITION BY file ORDER BY p)),
        following AS (SELECT file, p, p + 1 + {fits} AS next_p FROM summed),
        walk AS (
            SELECT file, p, next_p, CAST(0 AS BIGINT) AS batch_id FROM following WHERE p = 0
            UNION ALL
            SELECT f.file, f.p, f.next_p, w.batch_id + 1 FROM walk w
            JOIN following f ON f.file = w.file AND f.p = w.next_p)"""
    return using(lines, body, recursive)


def activity_sql(where: str = "") -> str:
    return using("activity", f"SELECT * FROM activity {where}")


def power_sql(strategy: str, weight: float) -> str:
    def scaled(column: str) -> str:
        low = f"min({column}) OVER (PARTITION BY region, function_name)"
        high = f"max({column}) OVER (PARTITION BY region, function_name)"
        return f"CASE WHEN {high} > {low} THEN ({column} - {low}) / ({high} - {low}) ELSE 0.0 END"

    return using(
        "power",
        f"""SELECT region, function_name, '{strategy}' AS strategy, power, round(average_ms, 6) AS average_ms,
            round(average_cost, 10) AS average_cost, invocations
            FROM (SELECT *, {weight} * ({scaled("average_cost")}) + {1 - weight} * ({scaled("average_ms")}) AS score
                  FROM power)
            QUALIFY row_number() OVER (PARTITION BY region, function_name ORDER BY round(score, 9), power) = 1""",
    )


SHARD_VALUES = {
    "IncomingBytesPerSecond": "avg(value) / 60",
    "IncomingRecordsPerSecond": "avg(value / 2) / 60",
    "OutgoingRecordsPerSecond": "avg(value * 2) / 60",
    "OutgoingBytesPerSecond": "avg(value * 3) / 60",
    "ReadProvisionedThroughputExceededCount": "sum(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END)",
    "WriteProvisionedThroughputExceededCount": "sum(CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END)",
    "iterator_age_ms": "avg(value * 10)",
}


def shard_sql() -> str:
    hourly = ", ".join(f"{expr} AS {name}" for name, expr in SHARD_VALUES.items())
    shown = ", ".join(
        f"CASE WHEN stream_name <> 'view' THEN round(CAST(coalesce({name}, 0) AS DOUBLE), 8) END AS {name}"
        for name in SHARD_VALUES
    )
    return using(
        "streams",
        f"""SELECT region, stream_name, '00000000000' || shard AS shard_id, 'ACTIVE' AS status, {shown}
            FROM (SELECT *, unnest(range(shards)) AS shard FROM streams)
            LEFT JOIN (
                SELECT region, event_type AS stream_name, event_id % 5 AS shard, date_trunc('hour', ts) AS h, {hourly}
                FROM ev WHERE ts BETWEEN {START} AND {AS_OF} GROUP BY 1, 2, 3, 4
                QUALIFY row_number() OVER (PARTITION BY region, event_type, event_id % 5
                                           ORDER BY date_trunc('hour', ts) DESC) = 1)
            USING (region, stream_name, shard)""",
    )


def utilisation_sql(live: bool = False) -> str:
    # Capacity per shard and second.
    capacity = {
        "read_mb_pct": ("out_bytes", 2048 * 1024),
        "read_records_pct": ("out_records", 2000),
        "write_mb_pct": ("in_bytes", 1024 * 1024),
        "write_records_pct": ("in_records", 1000),
    }
    shown = ", ".join(
        f"round(coalesce({value}, 0) / (CAST(shards AS BIGINT) * {limit} * 300) * 100, 2) AS {name}"
        for name, (value, limit) in capacity.items()
    )
    if live:
        exact = shown.replace("* 100, 2)", "* 100, 8)")
        return using(
            "streams",
            f"""SELECT region, stream_name, {time_text("b")} AS bucket_start, shards, {exact} FROM (
                    SELECT region, event_type AS stream_name, time_bucket(INTERVAL '5 minutes', ts) AS b,
                           sum(length(props) * 10000000.0::DOUBLE) AS in_bytes, sum(value * 1000) AS in_records,
                           sum(length(props) * 20000000.0::DOUBLE) AS out_bytes, sum(value * 2000) AS out_records
                    FROM ev GROUP BY 1, 2, 3)
                JOIN (SELECT region, stream_name, unnest([1, 2]) AS k, CAST(shards * k AS INTEGER) AS shards FROM streams)
                USING (region, stream_name) WHERE (b >= TIMESTAMP '2024-01-16') = (k = 2) AND b >= {START}""",
        )
    return using(
        "streams",
        f"""SELECT region, stream_name, shards, 'ACTIVE' AS status, {shown} FROM streams LEFT JOIN (
                SELECT region, event_type AS stream_name, time_bucket(INTERVAL '5 minutes', ts) AS b,
                       sum(length(props) * 10000000.0::DOUBLE) AS in_bytes, sum(value * 1000) AS in_records,
                       sum(length(props) * 20000000.0::DOUBLE) AS out_bytes, sum(value * 2000) AS out_records
                FROM ev WHERE ts BETWEEN {START} AND {AS_OF} GROUP BY 1, 2, 3
                QUALIFY row_number() OVER (PARTITION BY region, event_type
                                           ORDER BY time_bucket(INTERVAL '5 minutes', ts) DESC) = 1)
            USING (region, stream_name)""",
    )


SIZE_SQL = """CASE WHEN code_size <= 0 THEN '0 bytes'
    WHEN code_size >= 1099511627776 THEN format('{:,.2f} TB', code_size / 1099511627776.0)
    WHEN code_size >= 1073741824 THEN format('{:,.2f} GB', code_size / 1073741824.0)
    WHEN code_size >= 1048576 THEN format('{:,.2f} MB', code_size / 1048576.0)
    WHEN code_size >= 1024 THEN format('{:,.2f} KB', code_size / 1024.0)
    ELSE format('{:,} bytes', code_size) END"""

AGE_SQL = f"""(SELECT CASE WHEN d < 26 THEN d || ' days ago' WHEN m <= 1 THEN 'a month ago'
    WHEN m < 11 THEN m || ' months ago' WHEN y <= 1 THEN 'a year ago' ELSE y || ' years ago' END
    FROM (SELECT CAST(round(s / 86400.0) AS BIGINT) AS d, CAST(round(s / 86400.0 * 4800 / 146097) AS BIGINT) AS m,
                 CAST(round(s / 86400.0 * 400 / 146097) AS BIGINT) AS y
          FROM (SELECT epoch({AS_OF}) - epoch(last_modified) AS s)))"""

ORACLE: dict[str, str] = {
    "cold_start_stats": stats_sql("init_ms", "init_ms"),
    "cold_start_total": stats_sql("(duration_ms + init_ms)", "total_ms"),
    "cold_start_report": using("report", "SELECT * FROM report"),
    "cold_start_report_one_region": using("report", "SELECT * FROM report WHERE region = 'ASIA'"),
    "cold_start_single_function": using(
        "report", "SELECT * FROM report WHERE region = 'ASIA' AND function_name = 'Customer#000000007'"
    ),
    "missing_log_groups": using(
        "fn ev",
        """SELECT region, '/aws/lambda/' || function_name AS log_group FROM fn
           WHERE function_name NOT IN (SELECT function_name FROM ev)""",
    ),
    "unlisted_log_groups": using(
        "fn",
        "SELECT region, '/aws/lambda/' || function_name AS log_group FROM fn WHERE c_custkey % 7 = 3",
    ),
    "regions_read": using("fn", "SELECT region, function_name, memory_size FROM fn WHERE region <> 'EUROPE'"),
    "region_errors": "SELECT unnest(['EUROPE', 'nowhere']) AS region, true AS has_error",
    "resolve_topic": using(
        "fn", "SELECT region, 'arn:aws:sns:1234567890:topic-' || c_custkey AS topic_arn FROM fn WHERE c_custkey = 7"
    ),
    "resolve_group": using(
        "fn",
        """SELECT region, '/aws/lambda/' || function_name AS log_group FROM fn
           WHERE c_custkey % 7 <> 3 AND function_name LIKE 'Customer#00000001%'""",
    ),
    "log_groups_scanned": using(
        "fn logs",
        f"""SELECT region, log, count(*) AS lines FROM logs
            WHERE ts BETWEEN {START} AND {AS_OF}
              AND log IN (SELECT '1234567890:/aws/lambda/' || function_name FROM fn) GROUP BY ALL""",
    ),
    "init_bands": using(
        "parsed",
        """SELECT CASE WHEN init_ms IS NULL THEN 'none' WHEN init_ms < 100 THEN 'good' WHEN init_ms < 500 THEN 'plain'
                       WHEN init_ms < 1000 THEN 'warn' ELSE 'bad' END AS band, count(*) AS cold_starts
           FROM parsed GROUP BY ALL""",
    ),
    "pc_totals": using("pc", "SELECT * FROM pc"),
    "pc_utilisation": using(
        "pc_report",
        """SELECT *, CASE WHEN pc_utilisation = 0 THEN '-'
                          WHEN pc_utilisation > 0.3 AND pc_utilisation < 0.8 THEN 'good' ELSE 'warn' END AS band
           FROM pc_report""",
    ),
    "metric_stat_sum_daily": stat_sql("value", "sum", "day", "Duration"),
    "metric_stat_avg_hourly": stat_sql("value", "avg", "hour", "Duration"),
    "metric_stat_max_hourly": stat_sql("value / 500", "max", "hour", "ProvisionedConcurrencyUtilization"),
    "lambda_cost": cost_sql(),
    "lambda_cost_single": cost_sql("WHERE region = 'ASIA' AND function_name = 'Customer#000000007'"),
    "lambda_cost_text": using(
        "cost",
        """SELECT region, CASE WHEN length(function_name) > 12 THEN left(function_name, 12) || '…'
                               ELSE function_name END AS name,
                  CASE WHEN invocation_count = 0 THEN '-'
                       ELSE printf('%.10f', average_cost * invocation_count) END AS cost,
                  CAST(invocation_count AS BIGINT) AS invocations FROM cost""",
    ),
    "lambda_activity": activity_sql(),
    "lambda_inactive": activity_sql("WHERE is_inactive"),
    "lambda_list_text": using(
        "fn",
        f"""SELECT region, function_name, {SIZE_SQL} AS code_size, {AGE_SQL} AS last_modified,
            runtime = 'BUILDING' AS is_deprecated FROM fn""",
    ),
    "table_capacity": using(
        "capacity",
        f"""SELECT region, table_name, {time_text("day")} AS day, round(consumed_read, 8) AS consumed_read,
            round(consumed_write, 8) AS consumed_write, round(provisioned_read, 8) AS provisioned_read,
            round(provisioned_write, 8) AS provisioned_write FROM capacity""",
    ),
    "stream_utilisation": utilisation_sql(),
    "stream_utilisation_live": utilisation_sql(live=True),
    "metric_rollup_late": using(
        "ev",
        f"""SELECT region, 'Duration' AS metric, function_name, {time_text("date_trunc('day', ts)")} AS bucket_start,
            count(*) AS n, round(sum(value), 9) AS total, round(sum(value) / count(*), 9) AS average,
            round(min(value), 9) AS least, round(max(value), 9) AS greatest FROM ev GROUP BY ALL""",
    ),
    "drain_progress": """SELECT CAST(event_id % 4 AS BIGINT) AS batch, count(*) AS messages,
        CAST(sum(count(*)) OVER (ORDER BY event_id % 4) AS BIGINT) AS so_far,
        CAST(sum(count(*)) OVER () AS BIGINT) AS delivered FROM events GROUP BY event_id % 4""",
    "shard_report": shard_sql(),
    "latest_value": using(
        "hourly",
        f"""SELECT region, function_name, {time_text("bucket_start")} AS bucket_start, round(value, 6) AS value
            FROM hourly
            QUALIFY row_number() OVER (PARTITION BY region, function_name ORDER BY hourly.bucket_start DESC) = 1""",
    ),
    "select_objects_dataset": """SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars
        FROM documents WHERE n_chars > 100 GROUP BY lang""",
    "select_objects_sql_per_object": """SELECT source AS object, doc_id, n_chars FROM documents WHERE lang = 'en'
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1""",
    "select_objects_sql_totals": """SELECT source AS object,
        count(*) FILTER (WHERE lang = 'en' AND n_chars > 20000) AS n,
        CAST(sum(n_chars) FILTER (WHERE lang = 'en' AND n_chars > 20000) AS DOUBLE) AS chars
        FROM documents GROUP BY source""",
    "select_objects_limit_per_object": """SELECT source AS object, doc_id, n_chars FROM documents WHERE lang = 'en'
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1""",
    "select_objects_agg_per_object": """SELECT source AS object,
        count(*) FILTER (WHERE lang = 'en' AND n_chars > 30000) AS n,
        CAST(max(n_chars) FILTER (WHERE lang = 'en' AND n_chars > 30000) AS DOUBLE) AS longest FROM documents GROUP BY source""",
    "object_listing": using(
        "files",
        """SELECT folder, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(min(size) AS BIGINT) AS least
           FROM (SELECT folder, part, sum(strlen(line) + 1) AS size FROM files GROUP BY ALL) GROUP BY folder
           UNION ALL VALUES ('empty.json', 1, 0, 0), ('.cut.json.gz', 1, 4, 4)""",
    ),
    "object_records": using(
        "files",
        """SELECT doc_id, coalesce(lang, '') AS lang, n_chars, folder || '/' || part AS object
           FROM files WHERE NOT broken""",
    ),
    "object_errors": using(
        "files",
        """SELECT folder || '/' || part AS object, 'malformed JSON' AS error, count(*) AS n
           FROM files WHERE broken GROUP BY ALL UNION ALL VALUES ('.cut.json.gz', 'unreadable', 1)""",
    ),
    "object_answers": using(
        "files",
        """SELECT folder || '/' || part AS object, count(*) FILTER (NOT broken AND n_chars > 1000) AS n,
                  max(n_chars) FILTER (NOT broken AND n_chars > 1000) AS longest
           FROM files GROUP BY ALL UNION ALL VALUES ('empty.json', 0, NULL), ('.cut.json.gz', 0, NULL)""",
    ),
    "scan_lines_pack": packing_sql(
        16 * 1024,
        """SELECT n.file, CAST(pos AS BIGINT) AS pos, n_bytes, batch_id, true AS same FROM numbered n
           JOIN walk w ON n.file = w.file AND n.p >= w.p AND n.p < w.next_p""",
        "part_lines",
    ),
    "object_totals": "SELECT count(*) AS objects, CAST(sum(strlen(text)) AS BIGINT) AS total_size FROM documents",
    "lines_nonblank": using(
        "lines",
        "SELECT file, count(*) AS messages, CAST(sum(n_bytes) AS BIGINT) AS bytes FROM lines GROUP BY file",
    ),
    "pack_batches": packing_sql(
        16 * 1024,
        """SELECT n.file, doc_id, line_no, n_bytes, batch_id FROM numbered n
           JOIN walk w ON n.file = w.file AND n.p >= w.p AND n.p < w.next_p""",
    ),
    "batch_totals": packing_sql(
        256 * 1024,
        """SELECT file, max(batch_id) + 1 AS batches, CAST(max(next_p) AS BIGINT) AS messages FROM walk GROUP BY file""",
    ),
    "send_failures": using(
        "lines",
        """SELECT sha256(file || ':' || doc_id || ':' || line_no) AS entry_id, 'message is too long' AS error,
                  line AS body FROM lines WHERE n_bytes >= 4096""",
    ),
    "send_results": using(
        "lines",
        """SELECT sha256(file || ':' || block || ':' || doc_id || ':' || line_no) AS entry_id, n_bytes,
                  CASE WHEN n_bytes >= 4096 THEN 'fail' ELSE 'success' END AS status,
                  CASE WHEN n_bytes >= 4096 THEN 'message is too long' END AS error
           FROM (SELECT *, CAST(floor(doc_id / 1000) AS BIGINT) AS block FROM lines)""",
    ),
    "drain_queue": """SELECT 'msg-' || event_id AS entry_id,
               CASE event_type WHEN 'error' THEN 'fail' ELSE 'success' END AS status,
               CASE event_type WHEN 'error' THEN 'refused' END AS error,
               count(*) FILTER (event_type <> 'error') OVER () AS accepted,
               count(*) FILTER (event_type = 'error') OVER () AS refused FROM events""",
    "replay_queue": using("msgs", "SELECT message_id, body, attributes FROM msgs"),
    "replay_topic": using("msgs", "SELECT body, attributes FROM msgs"),
    "replay_stream": using("msgs", "SELECT body AS data, message_id AS partition_key FROM msgs"),
    "replay_remaining": using("msgs", "SELECT message_id, queue FROM msgs WHERE queue <> 'error-dlq'"),
    "replay_keep": using("msgs", "SELECT message_id, queue FROM msgs"),
    "decode_topic": using("topic", "SELECT * FROM topic"),
    "decode_event": using("busev", "SELECT * FROM busev"),
    "decode_change": using("change", "SELECT * FROM change"),
    "decode_record": using("record", "SELECT * FROM record"),
    "tail_queue_dedup": using(
        "msgs",
        "SELECT message_id, body, 'event_type=String,raw=Binary,user_id=Number' AS attributes FROM msgs",
    ),
    "tail_logs": using(
        "logs", f"SELECT {time_text('ts')} AS ts, message FROM logs WHERE message LIKE '%Init Duration%'"
    ),
    "tail_events_bus": using("busev", "SELECT * FROM busev WHERE source <> 'view'"),
    "tail_events_rule": using("busev", "SELECT * FROM busev WHERE source = 'purchase' AND detail_type = 'large'"),
    "tail_topic": using("topic", "SELECT * FROM topic"),
    "tail_changes": using("change", "SELECT * FROM change"),
    "tail_records": using("record", "SELECT * FROM record"),
    "tail_shards": using(
        "record",
        """SELECT r.*, p.position, CAST(p.position // a.per_read + CASE WHEN r.shard_id = 'shardId-000000000004'
                  THEN (a.first_shard + a.per_read - 1) // a.per_read ELSE 0 END AS BIGINT) AS read_no
           FROM record r JOIN (SELECT shard_id, sequence_number,
                                      row_number() OVER (PARTITION BY shard_id ORDER BY sequence_number) - 1 AS position
                               FROM record) p USING (shard_id, sequence_number),
                (SELECT count(*) // 10 + 1 AS per_read,
                        count(*) FILTER (WHERE shard_id = 'shardId-000000000000') AS first_shard FROM record) a""",
    ),
    "tail_queue_bounded": using(
        "msgs",
        """SELECT message_id, body, 'event_type=String,raw=Binary,user_id=Number' AS attributes,
                  true AS within_bound FROM msgs""",
    ),
    "metric_stat_stream": using(
        "ev",
        f"""SELECT region, 'Duration' AS metric, function_name, {time_text("date_trunc('hour', ts)")} AS bucket_start,
            round(sum(value), 6) AS value FROM ev GROUP BY ALL""",
    ),
    "metric_stat_closed": using(
        "ev",
        f"""SELECT region, 'Duration' AS metric, function_name, {time_text("h")} AS bucket_start,
            round(value, 6) AS value
            FROM (SELECT region, function_name, date_trunc('hour', ts) AS h, sum(value) AS value FROM ev GROUP BY ALL)
            WHERE h + INTERVAL '1 hour' <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '10 minutes' FROM ev)""",
    ),
    "inventory_functions": using(
        "fn od",
        """SELECT region, function_name, 'resource' AS kind, runtime, 'segment=' || runtime AS tags,
                  CASE WHEN memory_size > 512 THEN memory_size // 128 END AS retries,
                  CASE WHEN runtime = 'BUILDING' THEN 'allow ' || function_name END AS policy, NULL AS child FROM fn
           UNION ALL
           SELECT region, function_name, kind, NULL, NULL, NULL, NULL, child FROM (
               SELECT region, function_name, unnest(['event_source_mappings', 'provisioned_concurrency_configs']) AS kind,
                      unnest([CAST(o_orderkey AS VARCHAR), 'alias-' || (o_orderkey % 6) || ':' || (1 + o_orderkey % 50)]) AS child
               FROM od JOIN fn USING (region, function_name))""",
    ),
    "inventory_tables": using(
        "capacity",
        f"""SELECT DISTINCT region, table_name, 'resource' AS kind, 'ACTIVE' AS table_status, 'name=' || table_name AS tags,
                   NULL AS day, NULL AS consumed_read, NULL AS provisioned_write FROM capacity
            UNION ALL
            SELECT region, table_name, 'metrics', NULL, NULL, {time_text("day")}, round(consumed_read, 8),
                   round(provisioned_write, 8) FROM capacity""",
    ),
    "inventory_topics": using(
        "fn od",
        """SELECT region, 'arn:aws:sns:topic-' || c_custkey AS topic_arn, 'resource' AS kind, runtime AS owner,
                  'segment=' || runtime AS tags, NULL AS subscription_id, NULL AS protocol FROM fn
           UNION ALL
           SELECT od.region, 'arn:aws:sns:topic-' || o_custkey, 'subscriptions', NULL, NULL, o_orderkey, o_orderpriority
           FROM od JOIN fn ON o_custkey = c_custkey""",
    ),
    "inventory_queues": """SELECT 'arn:aws:sqs:us-east-1:1234567890:queue-' || p_partkey AS queue_arn, 'resource' AS kind,
                  'https://sqs.us-east-1.amazonaws.com/1234567890/queue-' || p_partkey AS queue_url,
                  'stage=dev,team=' || p_brand AS tags, NULL AS source_queue_url,
                  CAST(0 AS BIGINT) AS sources, CAST(0 AS BIGINT) AS url_chars
           FROM part
           UNION ALL
           SELECT 'arn:aws:sqs:us-east-1:1234567890:dlq-' || p_brand, 'resource',
                  'https://sqs.us-east-1.amazonaws.com/1234567890/dlq-' || p_brand, '', NULL, count(*),
                  CAST(sum(length('https://sqs.us-east-1.amazonaws.com/1234567890/queue-' || p_partkey)) AS BIGINT)
           FROM part GROUP BY p_brand
           UNION ALL
           SELECT 'arn:aws:sqs:us-east-1:1234567890:dlq-' || p_brand, 'source_queues', NULL, NULL,
                  'https://sqs.us-east-1.amazonaws.com/1234567890/queue-' || p_partkey, NULL, NULL FROM part""",
    "inventory_report": using(
        "fn",
        """SELECT 'lambda' AS type, region, '{"region":"' || region || '","function_name":"' || function_name
                  || '","memory_size":' || memory_size || '}' AS document FROM fn
           UNION ALL
           SELECT 'sns', region, '{"region":"' || region || '","topic_arn":"arn:aws:sns:topic-' || c_custkey
                  || '","owner":"' || runtime || '"}' FROM fn""",
    ),
    "queue_sources": """SELECT 'us-east-1' AS region, 'arn:aws:sqs:us-east-1:1234567890:dlq-' || p_brand AS queue_arn,
        'https://sqs.us-east-1.amazonaws.com/1234567890/queue-' || p_partkey AS source_queue_url FROM part""",
    "resource_scan": using(
        "res",
        """SELECT type, region, id, name, path, parent, CAST(bytes AS DOUBLE) AS bytes FROM res
           WHERE type IN ('role', 'nat_gateway', 'log_group') AND region IN ('ASIA', 'EUROPE')""",
    ),
    "resource_counts": using("res", "SELECT type, count(*) AS resources FROM res GROUP BY type"),
    "resource_counts_by_region": using(
        "res",
        """SELECT type, coalesce(region, 'global') AS region, count(*) AS resources FROM res GROUP BY 1, 2
           UNION ALL SELECT type, 'all', count(*) FROM res GROUP BY type""",
    ),
    "cleanup_plan": using(
        "res",
        """SELECT CAST(CASE type WHEN 'bucket' THEN 1 WHEN 'event_bus' THEN 2 WHEN 'stack' THEN 3 WHEN 'http_api' THEN 4
                  WHEN 'rest_api' THEN 4 WHEN 'role' THEN 5 WHEN 'function' THEN 6 WHEN 'log_group' THEN 7
                  WHEN 'nat_gateway' THEN 8 ELSE 9 END AS INTEGER) AS step, type, region, id, name
           FROM res
           WHERE NOT (type = 'event_bus' AND name = 'default') AND NOT (type = 'stack' AND status = 'DELETE_IN_PROGRESS')
             AND NOT (type = 'role' AND path LIKE '/aws-service-role/%') AND NOT (type = 'policy' AND status = 'AWS')""",
    ),
    "last_attempt": using("attempts", "SELECT type, region, name, attempt, status, reason FROM attempts"),
    "failure_summary": using(
        "attempts",
        """SELECT type, name || ' [' || region || ']' AS key, reason, count(*) OVER (PARTITION BY type) AS failed_count
           FROM attempts WHERE status = 'fail'""",
    ),
    "failure_summary_global": using(
        "attempts",
        """SELECT type, CASE WHEN type = '1-URGENT' THEN name ELSE name || ' [' || region || ']' END AS key, reason,
                  count(*) OVER (PARTITION BY type) AS failed_count
           FROM attempts WHERE status = 'fail'""",
    ),
    "other_buckets": using(
        "od",
        """SELECT o.region, o.o_custkey AS stack, 'res-' || first AS deployment_bucket, 'res-' || o_orderkey AS bucket
           FROM od o JOIN (SELECT o_custkey, min(o_orderkey) AS first FROM od GROUP BY ALL) f USING (o_custkey)
           WHERE o_orderstatus <> 'P' AND o_orderkey <> first""",
    ),
    "bus_targets": using(
        "fn od",
        """SELECT f.region, c_custkey AS bus, CAST(o_orderkey AS VARCHAR) AS rule, l_suppkey || '/' || l_linenumber AS target
           FROM fn f LEFT JOIN od ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey""",
    ),
    "role_policies": """SELECT s_suppkey AS role, CAST(policy AS VARCHAR) AS policy, kind FROM supplier LEFT JOIN (
        SELECT DISTINCT l_suppkey, l_partkey AS policy,
               CASE l_returnflag WHEN 'R' THEN 'attached' ELSE 'inline' END AS kind FROM lineitem) ON l_suppkey = s_suppkey""",
    "disabled_rules": using(
        "od", "SELECT region, o_custkey AS bus, o_orderkey AS rule FROM od WHERE o_orderstatus = 'P'"
    ),
    "recent_log_streams": using(
        "logs",
        f"""SELECT region, log, log_stream, {time_text("e")} AS last_event, CAST(position AS INTEGER) AS position
            FROM (SELECT *, row_number() OVER (PARTITION BY region, log ORDER BY e DESC, log_stream) AS position
                  FROM (SELECT region, log, log_stream, max(ts) AS e FROM logs GROUP BY ALL))
            WHERE position <= 50""",
    ),
    "resolve_queue": """SELECT 'https://sqs.us-east-1.amazonaws.com/1234567890/queue-' || p_partkey AS queue_url
        FROM part WHERE 'queue-' || p_partkey = 'queue-1'""",
    "version_places": using(
        "ver",
        """SELECT DISTINCT app, version, CAST(dense_rank() OVER (PARTITION BY app ORDER BY v1 DESC, v2 DESC, v3 DESC,
                  CASE p_type WHEN 'ECONOMY' THEN 0 ELSE 1 END DESC,
                  CASE p_type WHEN 'ECONOMY' THEN p_size ELSE 0 END DESC) AS INTEGER) AS place FROM ver""",
    ),
    "written_results": """SELECT doc_id, lang, regexp_replace(substr(text, 1, 40), '\\s', ' ', 'g') AS head
        FROM documents WHERE n_chars > 200""",
    "written_inventory": using(
        "fn od",
        """SELECT 'sns' AS type, 'resource' AS kind, 'arn:aws:sns:topic-' || c_custkey AS name, NULL AS subscription_id FROM fn
           UNION ALL
           SELECT 'sns', 'subscriptions', 'arn:aws:sns:topic-' || o_custkey, o_orderkey FROM od JOIN fn ON o_custkey = c_custkey
           UNION ALL
           SELECT 'sqs', 'resource', 'arn:aws:sqs:us-east-1:1234567890:queue-' || p_partkey, NULL FROM part
           UNION ALL
           SELECT DISTINCT 'sqs', 'resource', 'arn:aws:sqs:us-east-1:1234567890:dlq-' || p_brand, NULL FROM part
           UNION ALL
           SELECT 'sqs', 'source_queues', 'arn:aws:sqs:us-east-1:1234567890:dlq-' || p_brand, NULL FROM part""",
    ),
    "shard_details": using(
        "ev",
        """SELECT region, stream_name, '{"shard_id":"shardId-00000000000' || shard || '","metric_id":"shardid00000000000' || shard
                  || lower(metric) || '","datapoints":' || n || '}' AS details
           FROM (SELECT region, event_type AS stream_name, event_id % 5 AS shard, count(*) AS n,
                        unnest(['IncomingBytesCount', 'IncomingRecordsCount', 'OutgoingRecordsPerSecond',
                                'OutgoingBytesPerSecond', 'ReadProvisionedThroughputExceededCount',
                                'WriteProvisionedThroughputExceededCount', 'IteratorAgeMillisecondsCount']) AS metric
                 FROM ev GROUP BY region, event_type, event_id % 5)""",
    ),
    "tail_events_stamped": using("busev", "SELECT event_id, time, detail_type, true AS seen FROM busev WHERE source = 'error'"),
    "latest_version": using("latest", "SELECT * FROM latest"),
    "version_drift": using(
        "latest deployed",
        """SELECT app, latest_version, CASE WHEN p_type <> 'ECONOMY' THEN deployed_version END AS deployed_version,
                  CASE WHEN p_type = 'ECONOMY' THEN 'not found' WHEN deployed_version = latest_version THEN 'active'
                       ELSE 'outdated' END AS status,
                  CASE WHEN p_type <> 'ECONOMY' AND deployed_version = latest_version
                       THEN 'arn:aws:states:us-east-1:1:stateMachine:' || app END AS state_machine_arn
           FROM latest JOIN deployed USING (app)""",
    ),
    "power_select_cost": power_sql("cost", 1.0),
    "power_select_speed": power_sql("speed", 0.0),
    "power_select_balanced": power_sql("balanced", 0.5),
}
