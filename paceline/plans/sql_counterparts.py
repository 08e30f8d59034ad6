"""The named queries as SQL on the same tables, for the comparison with a SQL engine."""

DAY = 86_400_000
START = 1_704_067_200_000
DELAY = 30_000

# --- shared table expressions -----------------------------------------------------------

# Events as messages; (o1, o2) is the order of arrival.
MESSAGES = """
m AS (
  SELECT event_id + (event_id * 7919) % 41 AS o1, event_id AS o2,
         (event_id + (event_id * 7919) % 41) * 41 + 40 - (event_id * 7919) % 41 AS arr,
         event_type || '-' || CAST(user_id % 20 AS VARCHAR) AS job_id,
         'a' || CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 10 AS VARCHAR)
           AS attempt_id,
         epoch_us(ts) // 1000 AS ts, user_id % 7 <> 0 AS is_worker, value AS load
  FROM events
)"""

ACCEPTED = (
    MESSAGES
    + """,
acc AS (
  SELECT * FROM (
    SELECT *, max(ts) OVER (PARTITION BY job_id, attempt_id ORDER BY o1, o2
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
    FROM m
  ) WHERE seen IS NULL OR ts >= seen
)"""
)

CONFIG = """
config AS (
  SELECT DISTINCT event_type || '-' || CAST(user_id % 20 AS VARCHAR) AS job_id,
         CAST(1024 * (1 + user_id % 20 % 4) AS INTEGER) AS container_mb,
         CAST(60 AS INTEGER) AS container_num_cores,
         CAST(1 + user_id % 20 % 3 AS INTEGER) AS container_count
  FROM events WHERE event_type <> 'view'
)"""

STATE = (
    ACCEPTED
    + ","
    + CONFIG
    + """,
plain_state AS (
  SELECT job_id, attempt_id, min(arr) AS created, arg_min(ts, arr) AS first_time,
         max(ts) AS last_time
  FROM acc GROUP BY job_id, attempt_id
),
state AS (
  SELECT s.*, coalesce(c.container_mb, 1024) AS container_mb,
         coalesce(c.container_num_cores, 60) AS container_num_cores,
         coalesce(c.container_count, 1) AS container_count
  FROM plain_state s LEFT JOIN config c USING (job_id)
),
latest AS (
  SELECT * FROM state QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY created DESC) = 1
)"""
)


def points(fold: str = "max(load)", source: str = "acc") -> str:
    return f"""
points AS (
  SELECT job_id, attempt_id, ts - ts % {DAY} AS bucket, {fold} AS v
  FROM {source} WHERE is_worker GROUP BY ALL
)"""


POINTS = ACCEPTED + "," + points()
STATE_POINTS = STATE + "," + points()


def window(days: int) -> str:
    """The last points of every deployment, as many days back."""
    return f"""
win AS (
  SELECT p.* FROM points p
  JOIN (SELECT job_id, attempt_id, max(bucket) AS last FROM points GROUP BY ALL) e
  USING (job_id, attempt_id)
  WHERE e.last - p.bucket <= {days * DAY}
)"""


SIZES = """
CASE WHEN wanted * container_count > least(container_count * 120, 300)
     THEN greatest(container_num_cores * container_count, least(container_count * 120, 300))
     ELSE wanted * container_count END"""


def proposals(
    up_target: str = "ceil(usage)",
    screen: str = "TRUE",
    base: str = STATE_POINTS,
    delay: int = DELAY,
) -> str:
    """Table expressions down to `prop`: one row per (attempt, policy) that wants a change."""
    return (
        base
        + ","
        + window(2)
        + f""",
stats AS (
  SELECT job_id, attempt_id, min(bucket) AS first_bucket, max(bucket) AS last_bucket,
         avg(v) AS usage FROM win GROUP BY ALL
),
cand AS (
  SELECT l.*, s.usage FROM latest l JOIN stats s USING (job_id, attempt_id)
  WHERE NOT regexp_full_match(job_id, 'signup-1[0-2]')
    AND (SELECT max(last_time) FROM state) - last_time <= {3 * DAY}
    AND last_bucket - first_bucket > 0 AND last_bucket - first_bucket >= {2 * DAY}
    AND first_bucket >= first_time + {delay}
    AND NOT isnan(usage) AND {screen}
),
wish AS (
  SELECT *, 1 AS prio, 'JOB_VCORE_SCALEUP' AS type, CAST({up_target} AS BIGINT) AS wanted
  FROM cand
  WHERE usage >= container_num_cores * 1.1::DOUBLE AND regexp_full_match(job_id, '.*-([0-9]|1[0-7])')
  UNION ALL
  SELECT *, 2 AS prio, 'JOB_VCORE_SCALEDOWN' AS type, CAST(ceil(usage) AS BIGINT) AS wanted
  FROM cand
  WHERE usage <= container_num_cores * 0.5::DOUBLE AND regexp_full_match(job_id, '[a-z]+-.*')
),
sized AS (SELECT *, {SIZES} AS total FROM wish),
prop AS (
  SELECT job_id, attempt_id, type, prio, round(usage, 6) AS usage, container_mb,
         container_num_cores AS current_cores,
         CAST(greatest(total // container_count, 1) AS INTEGER) AS target_cores,
         container_count AS containers
  FROM sized WHERE greatest(total // container_count, 1) <> container_num_cores
)"""
    )


FIRST_PROP = """,
firstprop AS (
  SELECT * FROM prop QUALIFY row_number() OVER (PARTITION BY job_id, attempt_id ORDER BY prio) = 1
)"""

ACTIONS = """
actions AS (
  SELECT event_id AS seq, event_type || '-' || CAST(user_id % 20 AS VARCHAR) AS job_id,
         'a' || CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 10 AS VARCHAR)
           AS attempt_id,
         CASE WHEN event_id % 5 <> 0 THEN CAST(60 AS INTEGER) ELSE CAST(0 AS INTEGER) END
           AS current_cores,
         CAST(40 + event_id % 60 AS INTEGER) AS target_cores,
         CAST(1 + user_id % 3 AS INTEGER) AS containers,
         CASE event_id % 3 WHEN 0 THEN 'ENQUEUED' WHEN 1 THEN 'ISSUED' ELSE 'COMPLETE' END
           AS status,
         CASE WHEN event_id % 60 >= 20 THEN 'JOB_VCORE_SCALEUP' ELSE 'JOB_VCORE_SCALEDOWN' END
           AS type,
         1024 AS mb
  FROM events
)"""
ACTION_COLUMNS = "seq, job_id, attempt_id, current_cores, target_cores, containers, status, type"

CAPACITY = """
capacity AS (
  SELECT DISTINCT event_type || '-' || CAST(user_id % 20 AS VARCHAR) AS job_id,
         user_id % 20 * 4 AS free_cores, user_id % 20 * 512 AS free_mb
  FROM events WHERE event_type IN ('click', 'error')
)"""


def heads(source: str) -> str:
    """The first enqueued action per job, and those that fit."""
    return f"""
heads AS (
  SELECT * FROM {source} WHERE status = 'ENQUEUED'
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq) = 1
),
fitting AS (
  SELECT h.* FROM heads h LEFT JOIN capacity c USING (job_id)
  WHERE (c.free_cores IS NULL
         OR (target_cores - current_cores) * containers <= c.free_cores)
    AND (c.free_mb IS NULL
         OR mb * containers
            - CASE WHEN current_cores = 0 THEN 0 ELSE mb * containers END <= c.free_mb)
)"""


FLAGGED = """
m AS (
  SELECT (event_id + (event_id * 7919) % 41) * 41 + 40 - (event_id * 7919) % 41 AS arr,
         event_type || '-' || CAST(user_id % 20 AS VARCHAR) AS job_id,
         'b' || CAST(event_id * 31 % 7 AS VARCHAR) AS attempt_id,
         event_id % 4 <> 1 AS enabled, epoch_us(ts) // 1000 AS ts,
         user_id % 7 <> 0 AS is_worker, value AS load
  FROM events
),
known AS (
  SELECT *, coalesce(max(CASE WHEN enabled THEN arr END) OVER (
              PARTITION BY job_id, attempt_id ORDER BY arr
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -2) AS last_on
  FROM m
),
resets AS (
  SELECT job_id, CAST(-1 AS BIGINT) AS reset FROM m GROUP BY job_id
  UNION ALL
  SELECT r.job_id, min(k.arr) FROM resets r JOIN known k
    ON k.job_id = r.job_id AND NOT k.enabled AND k.arr > r.reset AND k.last_on < r.reset
  GROUP BY r.job_id, r.reset
),
lives AS (
  SELECT k.*, r.reset AS life,
         r.reset = max(r.reset) OVER (PARTITION BY k.job_id) AS newest
  FROM known k ASOF JOIN resets r ON k.job_id = r.job_id AND k.arr > r.reset
),
final AS (SELECT job_id, max(reset) AS final_reset FROM resets GROUP BY job_id),
told AS (
  SELECT l.*, l.life = f.final_reset AS live
  FROM lives l JOIN final f USING (job_id)
  WHERE enabled OR last_on >= life
),
acc_all AS (
  SELECT * FROM (
    SELECT *, max(ts) OVER (PARTITION BY job_id, attempt_id, life ORDER BY arr
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
    FROM told
  ) WHERE seen IS NULL OR ts >= seen
)"""

# Message by message, with the list of known attempts, of which three are kept.
CROWDED = """
m AS (
  SELECT (event_id + (event_id * 7919) % 41) * 41 + 40 - (event_id * 7919) % 41 AS arr,
         CASE WHEN event_id % 3 = 0 THEN 'hot'
              ELSE event_type || '-' || CAST(user_id % 20 AS VARCHAR) END AS job_id,
         'c' || CAST(event_id * 31 % 7 AS VARCHAR) AS attempt_id,
         event_id % 16 <> 1 AS enabled, epoch_us(ts) // 1000 AS ts
  FROM events
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY arr) AS n FROM m),
walk AS (
  SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(a VARCHAR, born BIGINT)[]) AS known,
         CAST(NULL AS BIGINT) AS arr, CAST(NULL AS VARCHAR) AS attempt_id, CAST(NULL AS BIGINT) AS ts
  FROM m
  UNION ALL
  SELECT x.job_id, x.n,
         CASE WHEN len(list_filter(w.known, lambda k: k.a = x.attempt_id)) > 0 THEN w.known
              WHEN NOT x.enabled THEN []
              ELSE list_concat(CASE WHEN len(w.known) >= 3 THEN w.known[2:] ELSE w.known END,
                               [{'a': x.attempt_id, 'born': x.arr}]) END,
         x.arr, x.attempt_id, x.ts
  FROM walk w JOIN numbered x ON x.job_id = w.job_id AND x.n = w.n + 1
),
final AS (
  SELECT job_id, known AS at_end FROM walk
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY n DESC) = 1
),
told AS (
  SELECT job_id, arr, attempt_id, ts, list_filter(known, lambda k: k.a = attempt_id)[1].born AS life
  FROM walk WHERE len(list_filter(known, lambda k: k.a = attempt_id)) > 0
),
acc_all AS (
  SELECT t.* EXCLUDE (seen), list_contains(at_end, {'a': attempt_id, 'born': life}) AS live FROM (
    SELECT *, max(ts) OVER (PARTITION BY job_id, attempt_id, life ORDER BY arr
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
    FROM told
  ) t JOIN final USING (job_id) WHERE seen IS NULL OR ts >= seen
)"""

FLAGGED_STATE_POINTS = (
    FLAGGED
    + ", acc AS (SELECT * FROM acc_all WHERE live),"
    + CONFIG
    + STATE[STATE.index(",\nplain_state") :]
    + ","
    + points()
)

REGISTRY = r"""
log AS (
  SELECT event_id AS seq, 'p' || CAST(user_id % 20 AS VARCHAR) AS process,
         CASE WHEN event_id % 29 = 0 THEN '' WHEN event_id % 31 = 0 THEN '...'
              WHEN event_id % 2 = 0 THEN event_type || '.g-' || CAST(user_id % 20 % 4 AS VARCHAR)
              WHEN event_id % 5 = 0 THEN event_type || '..x y.'
              ELSE event_type END AS scope,
         'm' || CAST(event_id % 3 AS VARCHAR) AS name,
         CASE event_id % 3 WHEN 0 THEN 'counter' WHEN 1 THEN 'gauge' ELSE 'meter' END AS kind,
         value, CASE WHEN event_id % 7 < 5 THEN 'add' ELSE 'remove' END AS op
  FROM events
),
pathed AS (
  SELECT *, regexp_replace(replace(regexp_replace(scope, '\.+$', ''), '.', '/'),
                           '[^a-zA-Z0-9:_/]', '_', 'g') AS path
  FROM log WHERE scope NOT IN ('', '...')
),
current AS (
  SELECT process, path, name, arg_max(kind, seq) AS kind, arg_max(value, seq) AS value,
         arg_max(op, seq) AS op
  FROM pathed GROUP BY process, path, name
)"""

LABELS = """
labels_log AS (
  SELECT event_id AS seq, 'p' || CAST(user_id % 20 AS VARCHAR) AS process,
         '<' || event_type || '>' AS label,
         CASE WHEN event_type = 'view' THEN 'fixed' ELSE json_extract_string(props, '$.k') END
           AS value
  FROM events
),
merged AS (
  SELECT process, label, arg_min(value, seq) AS value, min(value) <> max(value) AS conflict
  FROM labels_log GROUP BY process, label
)"""

HEADERS = LABELS + """,
headers AS (
  SELECT process,
         '{' || string_agg('"' || label || '":"' || value || '"', ',' ORDER BY label) || '}'
           AS header
  FROM merged GROUP BY process
)"""

# Metric trees of the registry are at most three groups deep: type / (g_n | '' / x_y).
TREES = """
leaf AS (
  SELECT process, path, name, '"' || name || '":"' || CAST(value AS VARCHAR) || '"' AS txt
  FROM current WHERE op = 'add' AND kind IN ('counter', 'gauge')
),
grp AS (SELECT DISTINCT process, path FROM pathed),
d3 AS (
  SELECT g.process, split_part(g.path, '/', 1) AS t,
         coalesce(string_agg(l.txt, ',' ORDER BY l.name), '') AS body
  FROM grp g LEFT JOIN leaf l ON l.process = g.process AND l.path = g.path
  WHERE len(string_split(g.path, '/')) = 3 GROUP BY g.process, g.path
),
d2 AS (
  SELECT g.process, split_part(g.path, '/', 1) AS t, split_part(g.path, '/', 2) AS g2,
         coalesce(string_agg(l.txt, ',' ORDER BY l.name), '') AS body
  FROM grp g LEFT JOIN leaf l ON l.process = g.process AND l.path = g.path
  WHERE len(string_split(g.path, '/')) = 2 GROUP BY g.process, g.path
),
members AS (
  SELECT process, t, '' AS k, '"":{"x_y":{' || body || '}}' AS txt FROM d3
  UNION ALL SELECT process, t, g2, '"' || g2 || '":{' || body || '}' FROM d2
  UNION ALL SELECT process, path, name, txt FROM leaf WHERE path NOT LIKE '%/%'
),
types AS (SELECT DISTINCT process, split_part(path, '/', 1) AS t FROM grp),
roots AS (
  SELECT t.process, t.t,
         '"' || t.t || '":{' || coalesce(string_agg(m.txt, ',' ORDER BY m.k), '') || '}' AS txt
  FROM types t LEFT JOIN members m ON m.process = t.process AND m.t = t.t
  GROUP BY t.process, t.t
),
trees AS (
  SELECT process, '{' || string_agg(txt, ',' ORDER BY t) || '}' AS tree FROM roots GROUP BY process
)"""

ENVELOPES = """
env AS (
  SELECT event_id, user_id,
         event_type || '-' || CAST(user_id % 20 AS VARCHAR) AS job_id,
         CASE WHEN event_id % 19 = 0 THEN ''
              ELSE 'a' || CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 10
                               AS VARCHAR) END AS attempt_id,
         epoch_us(ts) // 1000 AS ts, value, event_type, user_id % 7 <> 0 AS is_worker,
         CASE WHEN event_id % 11 = 0 THEN '"Heap":{"Used":"1"}'
              WHEN event_id % 13 = 0 THEN '"CPU":{"Time":"-1.0"}'
              WHEN event_id % 14 = 0 THEN '"CPU":{"Load":"oops","Time":"-1.0"}'
              ELSE '"CPU":{"Load":"' || CAST(value AS VARCHAR) || '","Time":"-1.0"}' END AS grp
  FROM events
),
envtree AS (
  SELECT *, CASE WHEN is_worker THEN 'taskmanager' ELSE 'jobmanager' END AS root,
         '{"' || root || '":{"Status":{"JVM":{' || grp || '}},"job.name":"' || event_type || '"}}'
           AS tree,
         '{' || CASE WHEN event_id % 23 = 0 THEN '' ELSE '"<job_name>":"' || job_id || '",' END
             || '"<job_id>":"' || attempt_id || '","<tm_id>":"' || CAST(user_id AS VARCHAR)
             || '"}' AS header
  FROM env
)"""

REASON = """
CASE WHEN event_id % 17 = 0 THEN 'malformed'
     WHEN event_id % 23 = 0 THEN 'no job id'
     WHEN attempt_id = '' THEN 'no attempt id'
     WHEN is_worker AND event_id % 11 <> 0 AND (event_id % 13 = 0 OR event_id % 14 = 0)
       THEN 'unreadable load' END"""

CLICK_TIME = "strftime(%s, '%%d-%%m-%%Y %%I:%%M:%%S:%%g')"
CLICK_LINE = (
    """'{"timestamp":"' || """
    + CLICK_TIME % "ts"
    + """ || '","page":"' || event_type || '"}'"""
)

CLICKS = """
clicks AS (
  SELECT time_bucket(INTERVAL 15 SECOND, ts) AS window_start,
         time_bucket(INTERVAL 15 SECOND, ts) + INTERVAL 15 SECOND AS window_end,
         event_type AS page, count(*) AS count
  FROM events GROUP BY ALL
)"""

PROPOSAL_COLUMNS = (
    "job_id, attempt_id, type, usage, container_mb, current_cores, target_cores, containers"
)

# --- one statement per named query --------------------------------------------------------

# Messages as they come out of the JSON lines, without the rejects.
JSON_MESSAGES = f"""
{ENVELOPES},
m AS (
  SELECT event_id + (event_id * 7919) % 41 AS o1, event_id AS o2,
         (event_id + (event_id * 7919) % 41) * 41 + 40 - (event_id * 7919) % 41 AS arr,
         job_id, attempt_id, ts, is_worker,
         CASE WHEN NOT is_worker THEN NULL WHEN event_id % 11 = 0 THEN 0.0::DOUBLE
              ELSE value END AS load
  FROM env WHERE {REASON} IS NULL
)"""
FROM_JSON = JSON_MESSAGES + STATE_POINTS.removeprefix(MESSAGES)


def held(current: str) -> str:
    """All actions; those that are not current are about an earlier numbering."""
    return f"""
held_actions AS (
  SELECT * REPLACE (CASE WHEN {current} THEN attempt_id ELSE 'old-' || attempt_id END AS attempt_id)
  FROM actions
)"""


# Four files by time of the month; every fiftieth click of the first half is two files late.
LATE_CLICKS = """
span AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) + 1 AS b FROM events),
part AS (
  SELECT e.*, n + CASE WHEN event_id % 50 = 0 AND n < 2 THEN 2 ELSE 0 END AS file
  FROM (SELECT e.*, (epoch_us(ts) - a) * 4 // (b - a) AS n FROM events e, span) e
),
mark AS (SELECT file, max(epoch_us(ts)) // 1000 * 1000 - 200000 AS wm FROM part GROUP BY file),
placed AS (
  SELECT p.*, time_bucket(INTERVAL 15 SECOND, ts) AS window_start,
         time_bucket(INTERVAL 15 SECOND, ts) + INTERVAL 15 SECOND AS window_end,
         (SELECT max(wm) FROM mark WHERE mark.file < p.file - 1) AS seen FROM part p
)"""

SQL: dict[str, str] = {
    "click_count_15s": f"WITH {CLICKS} SELECT * FROM clicks",
    "click_json_encode": f"SELECT event_id, {CLICK_LINE} AS value FROM events",
    "click_json_decode": """
        SELECT event_id, event_type AS page,
               (epoch_us(ts) // 1000) - CASE WHEN hour(ts) >= 12 THEN 43200000 ELSE 0 END AS ts
        FROM events""",
    "click_rejects": f"""
        SELECT event_id, CASE WHEN event_id % 7 = 0 THEN substr(line, 1, 20)
                              ELSE replace(line, '-2024', '/2024') END AS value
        FROM (SELECT event_id, {CLICK_LINE} AS line FROM events)
        WHERE event_id % 7 = 0 OR event_id % 11 = 0""",
    "click_statistics_json": f"""
        WITH {CLICKS}
        SELECT '{{"windowStart":"' || {CLICK_TIME % "window_start"} || '","windowEnd":"'
               || {CLICK_TIME % "window_end"} || '","page":"' || page || '","count":'
               || CAST(count AS VARCHAR) || '}}' AS value FROM clicks""",
    "diagnostics_encode": f"""
        WITH {ENVELOPES}
        SELECT event_id, '{{"metricHeader":' || header || ',"metricsSnapshot":' || tree
               || ',"autoScalingEnabled":true,"timestamp":' || CAST(ts AS VARCHAR) || '}}' AS value
        FROM envtree""",
    "diagnostics_decode": f"""
        WITH {ENVELOPES}
        SELECT event_id, job_id, attempt_id, CAST(user_id AS VARCHAR) AS container,
               TRUE AS enabled, ts, is_worker,
               CASE WHEN NOT is_worker THEN NULL WHEN event_id % 11 = 0 THEN 0.0::DOUBLE
                    ELSE value END AS load
        FROM env WHERE {REASON} IS NULL""",
    "diagnostics_tail": f"""
        WITH {ENVELOPES}
        SELECT row_number() OVER (PARTITION BY job_id ORDER BY
                 (event_id + event_id * 7919 % 41) * 41 + 40 - event_id * 7919 % 41) AS n,
               job_id, attempt_id, CAST(user_id AS VARCHAR) AS container, ts, is_worker,
               CASE WHEN NOT is_worker THEN NULL WHEN event_id % 11 = 0 THEN 0.0::DOUBLE
                    ELSE value END AS load
        FROM env WHERE {REASON} IS NULL""",
    "diagnostics_rejects": f"""
        WITH {ENVELOPES} SELECT event_id, {REASON} AS reason FROM env WHERE {REASON} IS NOT NULL""",
    "accepted_messages": f"""
        WITH {ACCEPTED} SELECT arr, job_id, attempt_id, ts, is_worker, load FROM acc""",
    "fold_with_resets": f"""
        WITH RECURSIVE {FLAGGED} SELECT arr, job_id, attempt_id, ts, live FROM acc_all""",
    "state_with_resets": f"""
        WITH RECURSIVE {FLAGGED}
        SELECT job_id, attempt_id, min(arr) AS created, arg_min(ts, arr) AS first_time,
               max(ts) AS last_time
        FROM acc_all WHERE live GROUP BY job_id, attempt_id""",
    "fold_with_evictions": f"""
        WITH RECURSIVE {CROWDED} SELECT arr, job_id, attempt_id, ts, live FROM acc_all""",
    "state_with_evictions": f"""
        WITH RECURSIVE {CROWDED}
        SELECT job_id, attempt_id, min(arr) AS created, arg_min(ts, arr) AS first_time,
               max(ts) AS last_time
        FROM acc_all WHERE live GROUP BY job_id, attempt_id""",
    "job_state": f"""
        WITH {STATE}
        SELECT job_id, attempt_id, created, first_time, last_time, container_mb,
               container_num_cores, container_count FROM state""",
    "job_state_as_of": f"""
        WITH {STATE}, history AS (
          SELECT event_type || '-' || CAST(user_id % 20 AS VARCHAR) AS job_id,
                 epoch_us(ts) // 1000 // {DAY} * {DAY} AS valid_from,
                 CAST(1024 * (1 + event_id % 4) AS INTEGER) AS mb,
                 CAST(60 + event_id % 7 AS INTEGER) AS cores, CAST(1 + event_id % 3 AS INTEGER) AS n
          FROM events WHERE event_type <> 'view' AND event_id % 5 = 0
          QUALIFY row_number() OVER (PARTITION BY ALL_KEYS ORDER BY event_id DESC) = 1
        )
        SELECT s.job_id, attempt_id, created, first_time, coalesce(mb, 1024) AS container_mb,
               coalesce(cores, 60) AS container_num_cores, coalesce(n, 1) AS container_count
        FROM plain_state s ASOF LEFT JOIN history h
          ON h.job_id = s.job_id AND s.first_time >= h.valid_from""".replace(
        "ALL_KEYS", f"event_type, user_id % 20, epoch_us(ts) // 1000 // {DAY}"
    ),
    "latest_attempt": f"""
        WITH {STATE} SELECT job_id, attempt_id, first_time, last_time FROM latest""",
    "attempts_top_k": f"""
        WITH {STATE} SELECT job_id, attempt_id, created FROM state
        QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY created DESC) <= 2""",
    "removed_attempts": f"""
        WITH {POINTS} SELECT job_id, attempt_id, count(*) AS n_points FROM points
        WHERE NOT (attempt_id = 'a0' AND job_id LIKE 'click-%') GROUP BY ALL""",
    "deployment_age": f"""
        WITH {STATE} SELECT job_id, attempt_id FROM state WHERE last_time - first_time > {5 * DAY}""",
    "fresh_deployments": f"""
        WITH {STATE} SELECT job_id, attempt_id, last_time FROM state
        WHERE (SELECT max(last_time) FROM state) - last_time <= {DAY}""",
    "screened_jobs": f"""
        WITH {STATE}
        SELECT job_id, regexp_full_match(job_id, 'signup-1[0-2]') AS denied,
               FALSE AS denied_by_default,
               regexp_full_match(job_id, '.*-([0-9]|1[0-7])') AS may_scale_up,
               regexp_full_match(job_id, '[a-z]+-.*') AS may_scale_down
        FROM latest""",
    "job_totals": f"""
        WITH {STATE}
        SELECT job_id, attempt_id, CAST(container_mb AS BIGINT) * container_count AS total_mb,
               CAST(container_num_cores AS BIGINT) * container_count AS total_cores
        FROM state""",
    "running_counts": f"""
        WITH {MESSAGES}
        SELECT arr, job_id, row_number() OVER (PARTITION BY job_id ORDER BY o1, o2) AS n FROM m""",
    "counts_per_key": f"WITH {MESSAGES} SELECT job_id, count(*) AS n FROM m GROUP BY job_id",
    "bucket_max": f"WITH {POINTS} SELECT * FROM points",
    "bucket_sum": f"""
        WITH {ACCEPTED}, {points("sum(load)")}
        SELECT job_id, attempt_id, bucket, round(v, 6) AS v FROM points""",
    "bucket_custom_fold": f"WITH {ACCEPTED}, {points('min(load)')} SELECT * FROM points",
    "redelivered_sum": f"""
        WITH {ACCEPTED}, {points("sum(load)")}
        SELECT job_id, attempt_id, bucket, round(v, 6) AS v FROM points""",
    "retained_window": f"WITH {POINTS}, {window(2)} SELECT * FROM win",
    "trailing_window": f"WITH {POINTS}, {window(2)} SELECT * FROM win",
    "sub_window": f"""
        WITH {POINTS} SELECT * FROM points
        WHERE bucket BETWEEN {START + 3 * DAY} AND {START + 11 * DAY}""",
    "window_points": f"""
        WITH {POINTS}, {window(3)}
        SELECT job_id, attempt_id,
               CAST(row_number() OVER (PARTITION BY job_id, attempt_id ORDER BY bucket) - 1
                    AS INTEGER) AS pos,
               bucket AS ts, v AS value FROM win""",
    "window_stats": f"""
        WITH {POINTS}, {window(2)}
        SELECT job_id, attempt_id, min(bucket) AS first_bucket, max(bucket) AS last_bucket,
               max(bucket) - min(bucket) AS span_ms, max(v) AS max_v,
               round(max(v) / 60, 6) AS max_per_second, round(avg(v), 6) AS avg_v,
               count(*) AS n_points
        FROM win GROUP BY ALL""",
    "rolling_window": f"""
        WITH {POINTS}
        SELECT job_id, attempt_id, bucket, v, min(bucket) OVER w AS first_bucket,
               round(avg(v) OVER w, 6) AS avg_v, max(v) OVER w AS max_v,
               count(*) OVER w AS n_points, bucket - min(bucket) OVER w >= {2 * DAY} AS is_full
        FROM points
        WINDOW w AS (PARTITION BY job_id, attempt_id ORDER BY bucket
                     RANGE BETWEEN {2 * DAY} PRECEDING AND CURRENT ROW)""",
    "valid_windows": f"""
        WITH {STATE_POINTS}, {window(2)}
        SELECT job_id, attempt_id, min(bucket) AS first_bucket, max(bucket) AS last_bucket,
               max(bucket) > min(bucket) AND max(bucket) - min(bucket) >= {2 * DAY}
                 AND min(bucket) >= first_time + {DELAY} AS valid
        FROM latest JOIN win USING (job_id, attempt_id)
        GROUP BY job_id, attempt_id, first_time""",
    "within_limits": f"""
        WITH {POINTS}
        SELECT job_id, attempt_id, bucket, (hi - v) / hi <= 0.1 OR hi - v <= 10 AS close
        FROM (SELECT *, max(v) OVER (PARTITION BY job_id, attempt_id ORDER BY bucket
                                     RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS hi
              FROM points)""",
    "scale_up": f"WITH {proposals()} SELECT {PROPOSAL_COLUMNS} FROM prop WHERE prio = 1",
    "scale_down": f"WITH {proposals()} SELECT {PROPOSAL_COLUMNS} FROM prop WHERE prio = 2",
    "scale_up_bounded": f"""
        WITH {proposals(up_target="ceil(least(usage, 75))")}
        SELECT {PROPOSAL_COLUMNS} FROM prop WHERE prio = 1""",
    "evaluate_policies": f"WITH {proposals()} {FIRST_PROP} SELECT {PROPOSAL_COLUMNS} FROM firstprop",
    "evaluate_with_pending": f"""
        WITH {ACTIONS}, {held("job_id LIKE '%-1'")}, {proposals(screen='''(job_id, attempt_id) NOT IN
          (SELECT (job_id, attempt_id) FROM held_actions)''')} {FIRST_PROP}
        SELECT {PROPOSAL_COLUMNS} FROM firstprop""",
    "evaluate_with_resets": f"""
        WITH RECURSIVE {proposals(base=FLAGGED_STATE_POINTS, delay=0)} {FIRST_PROP}
        SELECT {PROPOSAL_COLUMNS} FROM firstprop""",
    "all_proposals": f"WITH {proposals()} SELECT DISTINCT {PROPOSAL_COLUMNS} FROM prop",
    "evaluate_from_json": f"""
        WITH {proposals(base=FROM_JSON)} {FIRST_PROP} SELECT {PROPOSAL_COLUMNS} FROM firstprop""",
    "resized": f"""
        WITH {STATE_POINTS}, {window(0)},
        wish AS (SELECT s.*, CAST(ceil(v) AS BIGINT) AS wanted
                 FROM state s JOIN win USING (job_id, attempt_id)),
        sized AS (SELECT *, {SIZES} AS total FROM wish)
        SELECT job_id, attempt_id, container_mb,
               CAST(greatest(total // container_count, 1) AS INTEGER) AS container_num_cores,
               container_count FROM sized""",
    "pending_anti_join": f"""
        WITH {STATE}, {ACTIONS}, {held("seq % 400 = 0")}
        SELECT s.job_id, s.attempt_id FROM state s
        ANTI JOIN held_actions a USING (job_id, attempt_id)""",
    "actions_trim": f"""
        WITH {ACTIONS} SELECT {ACTION_COLUMNS} FROM actions
        QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) <= 20""",
    "actions_trim_long": f"""
        WITH {ACTIONS} SELECT {ACTION_COLUMNS} FROM actions
        QUALIFY row_number() OVER (PARTITION BY type ORDER BY seq DESC) <= 2000""",
    "first_enqueued": f"""
        WITH {ACTIONS}, {CAPACITY}, {heads("actions")} SELECT {ACTION_COLUMNS} FROM heads""",
    "capacity_join": f"""
        WITH {ACTIONS}, {CAPACITY}, {heads("actions")} SELECT {ACTION_COLUMNS} FROM fitting""",
    "issue_actions": f"""
        WITH {ACTIONS}, {CAPACITY}, {heads("actions")}
        SELECT seq, job_id, attempt_id, current_cores, target_cores, containers,
               CASE WHEN seq IN (SELECT seq FROM fitting) THEN 'ISSUED' ELSE status END AS status,
               type FROM actions""",
    "issue_partly_failed": f"""
        WITH {ACTIONS}, {CAPACITY}, {heads("actions")}
        SELECT seq, job_id, attempt_id, current_cores, target_cores, containers,
               CASE WHEN seq IN (SELECT seq FROM fitting WHERE job_id NOT LIKE 'c%') THEN 'ISSUED'
                    ELSE status END AS status,
               type FROM actions""",
    "issued_log": f"""
        WITH {ACTIONS}, {CAPACITY}, {heads("actions")},
        later AS (SELECT * FROM actions WHERE seq NOT IN (SELECT seq FROM fitting)),
        {heads("later").replace("heads", "heads2").replace("fitting", "fitting2")}
        SELECT {ACTION_COLUMNS} FROM fitting UNION ALL SELECT {ACTION_COLUMNS} FROM fitting2""",
    "action_round": f"""
        WITH {ACTIONS}, {held("job_id LIKE '%-1'")}, {CAPACITY},
        {proposals(screen='''(job_id, attempt_id) NOT IN
          (SELECT (job_id, attempt_id) FROM held_actions)''')} {FIRST_PROP},
        held AS (
          SELECT {ACTION_COLUMNS}, CAST(mb AS BIGINT) AS mb FROM held_actions
          UNION ALL
          SELECT 1000000000, job_id, attempt_id, current_cores, target_cores, containers,
                 'ENQUEUED', type, container_mb FROM firstprop
        ),
        kept AS (SELECT * FROM held
                 QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) <= 20),
        {heads("kept")}
        SELECT seq, job_id, attempt_id, current_cores, target_cores, containers,
               CASE WHEN (job_id, seq) IN (SELECT (job_id, seq) FROM fitting) THEN 'ISSUED'
                    ELSE status END AS status, type FROM kept""",
    "scope_paths": f"""
        WITH {REGISTRY}
        SELECT seq, scope, path, CAST(len(string_split(path, '/')) AS INTEGER) AS n FROM pathed""",
    "scope_rejects": f"WITH {REGISTRY} SELECT seq, scope FROM log WHERE scope IN ('', '...')",
    "metric_registry": f"""
        WITH {REGISTRY} SELECT process, path, name, kind, value FROM current WHERE op = 'add'""",
    "metric_kinds": f"""
        WITH {REGISTRY} SELECT seq, kind, CAST(value AS VARCHAR) AS value FROM log
        WHERE kind IN ('counter', 'gauge')""",
    "label_conflicts": f"WITH {LABELS} SELECT * FROM merged",
    "header_merge": f"WITH {HEADERS} SELECT * FROM headers",
    "snapshot_messages": f"""
        WITH {REGISTRY}, {HEADERS}, {TREES}
        SELECT process, '{{"metricHeader":' || coalesce(header, '{{}}') || ',"metricsSnapshot":'
               || coalesce(tree, '{{}}') || ',"autoScalingEnabled":true,"timestamp":{START}}}'
               AS value
        FROM trees FULL JOIN headers USING (process)""",
    "metric_flatten": f"""
        WITH {ENVELOPES}
        SELECT event_id, root AS path, 'job.name' AS name, event_type AS value FROM envtree
        UNION ALL
        SELECT event_id, root || '/Status/JVM/Heap', 'Used', '1' FROM envtree WHERE event_id % 11 = 0
        UNION ALL
        SELECT event_id, root || '/Status/JVM/CPU', 'Time', '-1.0' FROM envtree
        WHERE event_id % 11 <> 0
        UNION ALL
        SELECT event_id, root || '/Status/JVM/CPU', 'Load',
               CASE WHEN event_id % 14 = 0 THEN 'oops' ELSE CAST(value AS VARCHAR) END
        FROM envtree WHERE event_id % 11 <> 0 AND event_id % 13 <> 0""",
    "metric_tree_round_trip": f"WITH {ENVELOPES} SELECT event_id, tree FROM envtree",
    "metric_flatten_deep": """
        SELECT event_id,
               rtrim(repeat('g/', CASE WHEN event_id % 500 = 7 THEN 900 ELSE event_id % 13 END), '/') AS path,
               'v' AS name,
               CASE WHEN event_id % 500 = 8 THEN repeat('{', 20000) ELSE event_type END AS value
        FROM events WHERE event_id % 500 <> 9""",
    "metric_flatten_rejects": """
        SELECT event_id,
               CASE WHEN event_id % 10 IN (1, 2, 3, 4, 5) OR event_id % 500 = 9 THEN NULL ELSE 'v' END AS name,
               CASE WHEN event_id % 10 IN (1, 2, 3, 4, 5) OR event_id % 500 = 9 THEN NULL
                    ELSE event_type END AS value,
               CASE WHEN event_id % 500 = 9 THEN 'malformed' ELSE CASE event_id % 10 WHEN 1 THEN 'no object' WHEN 2 THEN 'no object'
                    WHEN 3 THEN 'malformed' WHEN 4 THEN 'duplicate key' WHEN 5 THEN 'missing' END END
                 AS reason
        FROM events""",
    "metric_clashes": """
        WITH l AS (SELECT event_id, 'p' || CAST(event_id % 500 AS VARCHAR) AS process FROM events)
        SELECT process, 'a' AS path, 'b' AS name, lpad(CAST(event_id AS VARCHAR), 9, '0') AS value
        FROM l WHERE event_id % 3 = 0
          AND (process IN (SELECT process FROM l WHERE event_id % 3 <> 0)
               OR event_id < (SELECT max(event_id) FROM l k WHERE k.process = l.process))""",
    "sub_group_present": f"""
        WITH {ENVELOPES}
        SELECT event_id, is_worker AS worker, is_worker AND event_id % 11 <> 0 AS worker_cpu,
               NOT is_worker AND event_id % 11 = 0 AS manager_heap FROM env""",
    "stream_click_count": f"""
        WITH {CLICKS} SELECT * FROM clicks
        WHERE epoch_us(window_end) <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 200000 FROM events)""",
    "processing_time_count": """
        SELECT time_bucket(INTERVAL 15 SECOND, t) AS window_start,
               time_bucket(INTERVAL 15 SECOND, t) + INTERVAL 15 SECOND AS window_end,
               event_type AS page, count(*) AS count
        FROM (SELECT event_type, ts + to_seconds(event_id % 60) AS t FROM events) GROUP BY ALL""",
    "stream_late_clicks": f"""
        WITH {LATE_CLICKS}
        SELECT window_start, window_end, event_type AS page, count(*) AS count FROM placed
        WHERE (seen IS NULL OR epoch_us(window_end) > seen)
          AND epoch_us(window_end) <= (SELECT max(wm) FROM mark) GROUP BY ALL""",
    "stream_redelivered_sum": f"""
        WITH {ACCEPTED}, {points("sum(load)")}
        SELECT job_id, attempt_id, bucket, round(v, 6) AS v FROM points""",
    "stream_evaluate": f"""
        WITH {proposals()} {FIRST_PROP}
        SELECT job_id, attempt_id, current_cores, target_cores, containers, 'ISSUED' AS status,
               type FROM firstprop""",
}
SQL["stream_evaluate_keyed"] = SQL["stream_evaluate_timed"] = SQL["stream_evaluate"]
