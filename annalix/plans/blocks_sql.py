"""Candidate blocks as SQL: table ``ordered`` for one query text."""

QUERY = "the "

BLOCKS = """, ritems AS (SELECT *, row_number() OVER (PARTITION BY capsule_id, kind ORDER BY sequence) AS ordinal FROM items),
capsrc AS (SELECT capsule_id, list_sort(list(DISTINCT source)) AS all_sources FROM items GROUP BY capsule_id),
tasks AS (SELECT capsule_id, string_agg(t, chr(10) ORDER BY rank) AS task_text FROM (
  SELECT i.capsule_id, list_position(['progress','open_loop','preference','emotional_context'], i.kind) AS rank,
    CASE i.kind WHEN 'progress' THEN 'Progress' WHEN 'open_loop' THEN 'Open loops' WHEN 'preference' THEN 'Preferences' ELSE 'Emotional context' END || ': ' || string_agg(text, ' | ' ORDER BY sequence) AS t
  FROM items i JOIN capsules c USING (capsule_id) WHERE level = 'task' AND i.kind IN ('progress','open_loop','preference','emotional_context') GROUP BY i.capsule_id, i.kind) GROUP BY capsule_id),
deps AS (SELECT capsule_id, string_agg(item_id || ':follows->' || text, ' | ' ORDER BY sequence) AS dep_text, list(source ORDER BY sequence) AS dep_sources FROM items WHERE kind = 'dependency' GROUP BY capsule_id),
cand AS (
  SELECT session, 0 AS phase, segment AS major, CASE kind WHEN 'goal' THEN 0 ELSE 1 END AS sub, sequence AS minor, kind || ':' || capsule_id || ':' || item_id AS block_id,
    CASE kind WHEN 'goal' THEN 'active_goal' ELSE 'hard_constraint' END AS slot, kind, text, [source] AS sources, true AS required, 100.0::DOUBLE AS weight, capsule_id, NULL::BIGINT AS event_sequence, 'ACTIVE_REQUIRED' AS fixed
  FROM ritems WHERE kind IN ('goal','constraint') AND status = 'active'
  UNION ALL SELECT session, 1, 0, 0, sequence, 'event:' || event_id, 'raw_delta', 'raw_event', '[' || event_type || '/' || role || ' ' || event_id || ']' || chr(10) || content, [event_id], true, 90.0, NULL, sequence, 'UNCOMPACTED_DELTA' FROM delta
  UNION ALL SELECT session, 2, segment, 0, sequence, 'anchor:' || capsule_id || ':' || item_id, 'exact_anchor', 'exact_anchor', text, [source], true, 80.0 * importance, capsule_id, NULL, 'ACTIVE_EXACT_ANCHOR' FROM ritems WHERE kind = 'anchor' AND status = 'active'
  UNION ALL SELECT session, 3, segment, 0, covered_event_start, 'task:' || capsule_id, 'active_task', 'task_context', task_text, all_sources, false, 50.0, capsule_id, NULL, NULL FROM capsules JOIN tasks USING (capsule_id) JOIN capsrc USING (capsule_id)
  UNION ALL SELECT session, 4, segment, 0, sequence, 'decision:' || capsule_id || ':' || item_id, 'relevant_evidence', 'decision',
    'Decision: ' || text || chr(10) || 'Rationale: ' || chr(10) || 'Alternatives: ' || chr(10) || 'Supersedes: ' || chr(10) || 'Rejected because: ' || chr(10) || 'Dependencies: ' || coalesce(dep_text, ''),
    CASE WHEN dep_sources IS NULL THEN [source] ELSE [source] || list_filter(dep_sources, lambda x: x <> source) END, false, 40.0, i.capsule_id, NULL, NULL FROM ritems i LEFT JOIN deps USING (capsule_id) WHERE i.kind = 'decision'
  UNION ALL SELECT session, 4, segment, 1, sequence, 'entity:' || capsule_id || ':' || item_id, 'relevant_evidence', 'entity', 'Entity: ' || text || chr(10) || 'Kind: topic' || chr(10) || 'Aliases: ', [source], false, 30.0, capsule_id, NULL, NULL FROM ritems WHERE kind = 'entity'
  UNION ALL SELECT session, 4, segment, 2, sequence, 'dependency:' || capsule_id || ':' || item_id, 'relevant_evidence', 'dependency', 'Dependency: ' || item_id || chr(10) || 'Kind: follows' || chr(10) || 'Target: ' || text, [source], false, 30.0, capsule_id, NULL, NULL FROM ritems WHERE kind = 'dependency'
  UNION ALL SELECT session, 5, segment, 0, covered_event_start, 'background:' || capsule_id, level || '_background', level || '_background', 'Summary of ' || capsule_id, all_sources, false, 10.0, capsule_id, NULL, NULL FROM capsules JOIN capsrc USING (capsule_id) WHERE level IN ('episode','global')
), capped AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY session ORDER BY phase, major, sub, minor, block_id) <= 256),
scored AS (SELECT *, CASE WHEN contains(lower(left(text, 4096)), 'the') THEN 1.0 ELSE 0.0 END::DOUBLE AS fraction FROM capped),
ordered AS (SELECT session, block_id, slot, kind, text, sources, required, capsule_id, event_sequence, weight + 10.0 * fraction AS score,
  coalesce(fixed, CASE WHEN fraction > 0 THEN 'LEXICAL_MATCH' ELSE 'STRUCTURED_FALLBACK' END) AS reason,
  row_number() OVER (PARTITION BY session ORDER BY list_position(['active_goal','hard_constraint','raw_delta','exact_anchor','recent_raw','active_task','relevant_evidence','episode_background','global_background'], slot),
    CASE WHEN slot = 'raw_delta' THEN 0.0 ELSE -(weight + 10.0 * fraction) END, CASE WHEN slot = 'raw_delta' THEN event_sequence ELSE 0 END, block_id) - 1 AS position
  FROM scored)
"""

#: Dependency components of the blocks: table ``comp`` of each position's least one.
COMPONENTS = """, keyed AS (SELECT session, block_id, position, kind, 'c:' || capsule_id AS key FROM ordered WHERE capsule_id IS NOT NULL UNION ALL SELECT session, block_id, position, kind, 's:' || unnest(sources) FROM ordered),
link AS (SELECT DISTINCT a.session, a.position AS a, b.position AS b FROM keyed a JOIN keyed b ON a.session = b.session AND a.key = b.key WHERE a.kind = 'dependency' OR b.kind = 'dependency'),
reach AS (SELECT session, position AS a, position AS b FROM ordered UNION SELECT r.session, r.a, l.b FROM reach r JOIN link l ON l.session = r.session AND l.a = r.b),
comp AS (SELECT session, a AS position, min(b) AS least FROM reach GROUP BY session, a)
"""
