"""The journal's tables as SQL over the driver's tables, for the oracles."""

#: Levels, claim kinds, event types and job states, in order.
LEVELS = ("micro", "episode", "task", "global")
CLAIM_KINDS = ("goal", "constraint", "progress", "open_loop", "preference", "emotional_context")
EVENT_TYPES = ("USER_MESSAGE", "ASSISTANT_MESSAGE", "TOOL_CALL", "TOOL_RESULT")
JOB_STATES = ("PENDING", "LEASED", "COMPILING", "AUDITING", "READY_TO_COMMIT", "RETRY_WAIT", "COMMITTED", "SUPERSEDED", "FAILED", "CANCELLED")
OPEN_STATES = JOB_STATES[:6]
WORKING_STATES = JOB_STATES[1:5]
CANDIDATE_STATES = ("READY_TO_COMMIT", "COMMITTED", "SUPERSEDED")
#: The oracles' time and token profile.
NOW = "2026-01-02T00:00:00.000000Z"
PROFILE = "utf8-bytes"

_list = lambda x: "[" + ", ".join(f"'{v}'" for v in x) + "]"

PRELUDE = f"""
WITH RECURSIVE journal AS (
  SELECT conv_id AS session, conv_id || ':' || turn AS event_id,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS sequence,
         CASE role WHEN 'user' THEN 'USER_MESSAGE' ELSE 'ASSISTANT_MESSAGE' END AS event_type,
         CASE role WHEN 'user' THEN 'USER' ELSE 'ASSISTANT' END AS role,
         text AS content,
         CASE role WHEN 'user' THEN 'ON_LLM_REQUEST' ELSE 'ON_AGENT_DONE' END AS source_hook,
         conv_id || ':' || turn AS idempotency_key, strlen(text)::BIGINT AS token_count
  FROM conversations WHERE role IN ('user', 'assistant')
), marks AS (
  SELECT session, max(sequence) AS high_water, max(sequence) // 2 AS covered FROM journal GROUP BY session
), snapshots AS (
  SELECT 'snap-' || session AS snapshot_id, session, covered AS covered_event_end, covered AS source_high_water_mark
  FROM marks WHERE covered >= 1
), pointers AS (
  SELECT session, snapshot_id, session % 3 + 1 AS pointer_version FROM snapshots
), covered AS (
  SELECT j.*, (sequence - 1) // 2 AS segment, 'cap-' || session || '-' || ((sequence - 1) // 2) AS capsule_id
  FROM journal j JOIN marks USING (session) WHERE sequence <= marks.covered
), capsules AS (
  SELECT capsule_id, session, segment, {_list(LEVELS)}[(segment + session) % 4 + 1] AS level,
         min(sequence) AS covered_event_start, max(sequence) AS covered_event_end, sum(token_count)::BIGINT AS token_cost
  FROM covered GROUP BY capsule_id, session, segment
), memberships AS (
  SELECT 'snap-' || session AS snapshot_id, segment AS ordinal, capsule_id, level AS slot FROM capsules
), items AS (
  SELECT session, capsule_id, segment, {_list(CLAIM_KINDS)}[(sequence + session) % 6 + 1] AS kind, 'claim-' || event_id AS item_id,
         content AS text, CASE WHEN sequence % 5 = 0 THEN 'superseded' ELSE 'active' END AS status,
         1.0::DOUBLE AS importance, event_id AS source, sequence
  FROM covered
  UNION ALL
  SELECT session, capsule_id, segment, 'anchor', 'anchor-' || event_id, left(content, 40), 'active',
         CASE WHEN sequence % 4 = 1 THEN 1.0 ELSE 0.5 END::DOUBLE, event_id, sequence
  FROM covered WHERE sequence % 2 = 1
  UNION ALL
  SELECT session, capsule_id, segment, 'decision', 'dec-' || event_id, left(content, 60), 'active', 1.0::DOUBLE, event_id, sequence
  FROM covered WHERE sequence % 3 = 1
  UNION ALL
  SELECT session, capsule_id, segment, 'entity', 'ent-' || event_id, left(content, 12), 'active', 1.0::DOUBLE, event_id, sequence
  FROM covered WHERE sequence % 4 = 2
  UNION ALL
  SELECT session, capsule_id, segment, 'dependency', 'dep-' || event_id, 'cap-' || session || '-' || (segment - 1), 'active', 1.0::DOUBLE, event_id, sequence
  FROM covered WHERE segment >= 1 AND sequence % 2 = 1
), delta AS (
  SELECT j.* FROM journal j JOIN marks USING (session) WHERE sequence > covered
), metrics AS (
  SELECT 'EVENT' AS artifact_kind, event_id AS artifact_id, '{PROFILE}' AS profile, token_count FROM journal WHERE session % 2 = 0
  UNION ALL
  SELECT 'CAPSULE', capsule_id, '{PROFILE}', token_cost FROM capsules WHERE segment % 2 = 0
), intents AS (
  SELECT 'EVENT' AS artifact_kind, event_id AS artifact_id, '{PROFILE}' AS profile, session FROM journal WHERE session % 2 = 1 AND session % 3 = 0
), jobs AS (
  SELECT 'job-' || session AS job_id, session, {_list(JOB_STATES)}[session % 10 + 1] AS state,
         high_water AS target, high_water + session % 2 AS intent, covered AS base_coverage,
         CASE WHEN session % 10 BETWEEN 1 AND 4 THEN 'worker-' || session % 3 END AS lease_owner,
         session % 4 + 1 AS lease_epoch, session % 3 AS attempt_count,
         CASE WHEN session % 10 BETWEEN 1 AND 4 THEN '2026-01-0' || (session % 4 + 1) || 'T00:00:00.000000Z' END AS lease_expires_at,
         CASE WHEN session % 10 = 5 THEN '2026-01-0' || (session % 3 + 1) || 'T00:00:00.000000Z' END AS next_retry_at,
         CASE WHEN session % 10 IN (5, 8) THEN 'TIMEOUT' END AS error_code,
         '2025-12-' || (10 + session % 20) || 'T00:00:00.000000Z' AS created_at
  FROM marks
)
"""
