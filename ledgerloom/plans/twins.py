"""SQL twins of the pN_ queries of the general data problems."""

from __future__ import annotations

from .claims import _EV, _MS, _u

#: Parents by doubling: after 14 rounds what still has an ancestor leads into a circle, and those ancestors are its members.
_TREES = f"""{_EV}, n AS MATERIALIZED (SELECT event_id AS id, claim_id, CASE WHEN prev_event_id IN (SELECT event_id FROM ev) THEN prev_event_id END AS par FROM ev), j0 AS MATERIALIZED (SELECT id, par AS up FROM n WHERE par IS NOT NULL),
 {', '.join(f'j{i + 1} AS MATERIALIZED (SELECT a.id, b.up FROM j{i} a JOIN j{i} b ON a.up = b.id)' for i in range(14))}, mem AS MATERIALIZED (SELECT DISTINCT up AS id FROM j14),
 ring(start, cur) AS (SELECT id, id FROM mem UNION SELECT start, par FROM ring JOIN n ON n.id = cur), cmin AS MATERIALIZED (SELECT start AS id, min(cur) AS smallest FROM ring GROUP BY 1),
 tree AS MATERIALIZED (SELECT n.id, CASE WHEN n.id = smallest THEN NULL ELSE par END AS par, smallest IS NOT NULL AS on_circle, claim_id FROM n LEFT JOIN cmin USING (id)),
 walk(id, path, depth, circular) AS (SELECT id, [id], 0, on_circle FROM tree WHERE par IS NULL UNION ALL SELECT t.id, list_append(w.path, t.id), CASE WHEN t.on_circle THEN 0 ELSE w.depth + 1 END, w.circular FROM tree t JOIN walk w ON t.par = w.id)"""
P1_FOUND = f"WITH RECURSIVE {_TREES} SELECT walk.id AS event_id, path[1] AS root_event_id, CAST(depth AS INT) AS depth FROM walk JOIN n USING (id) JOIN n r ON r.id = path[1] WHERE circular OR r.claim_id IS DISTINCT FROM n.claim_id"
P1_PATHS = f"""WITH RECURSIVE {_TREES}, b AS (SELECT unnest(path[1:-2]) AS id, id AS x, path FROM walk), d AS (SELECT id, list(x ORDER BY path) AS xs FROM b GROUP BY 1)
 SELECT walk.id AS event_id, path[1] AS root_event_id, CAST(depth AS INT) AS depth, on_circle, path, CAST(coalesce(len(xs), 0) AS INT) AS n_descendants, coalesce(xs, []) AS descendants FROM walk JOIN tree USING (id) LEFT JOIN d USING (id)"""
P1_CIRCLES = f"WITH RECURSIVE {_TREES} SELECT smallest AS smallest_event_id, count(*) AS n_members, any_value(CASE WHEN n.id = smallest THEN par END) AS back_edge_from FROM cmin JOIN n USING (id) GROUP BY 1"

_KIND = "CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END"
_SORTED = "CASE WHEN json_type(v) = 'OBJECT' THEN CAST(list_sort(list_transform(json_keys(v), lambda k: k || CAST(json_extract(v, '$.\"' || k || '\"') AS VARCHAR))) AS VARCHAR) WHEN json_type(v) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(CAST(v AS DOUBLE) AS VARCHAR) ELSE CAST(json(v) AS VARCHAR) END"
_DRIFT = f"""raw AS (SELECT feed, file_seq, file_name, payload, CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN payload END AS p FROM manifest_raw), fl AS (SELECT DISTINCT feed, file_seq, file_name FROM raw), lg AS (SELECT *, lag(file_name) OVER (PARTITION BY feed ORDER BY file_seq, file_name) AS old FROM fl),
 k AS (SELECT file_name, p, unnest(json_keys(p)) AS field FROM raw WHERE p IS NOT NULL), t AS (SELECT file_name, p, field, json_extract(p, '$."' || field || '"') AS v FROM k), e AS (SELECT file_name, p, unnest(json_keys(v)) AS f, v AS o FROM t WHERE field = 'extensions' AND json_type(v) = 'OBJECT'),
 u AS (SELECT file_name, p, field, v FROM t UNION ALL SELECT file_name, p, 'extensions.' || f, json_extract(o, '$."' || f || '"') FROM e), w AS MATERIALIZED (SELECT file_name, {_u("CASE WHEN json_type(p, '$.package_id') = 'VARCHAR' THEN json_extract_string(p, '$.package_id') END")} AS pk, field, {_KIND} AS kind, {_KIND} || {_SORTED} AS val FROM u WHERE json_type(v) <> 'NULL'),
 s AS MATERIALIZED (SELECT file_name, field, list_sort(list(DISTINCT kind)) AS kinds FROM w GROUP BY 1, 2), c AS (SELECT lg.file_name, lg.old, s.field, s.kinds FROM lg JOIN s ON s.file_name = lg.old), b AS (SELECT lg.file_name, lg.old, s.field, s.kinds FROM lg JOIN s ON s.file_name = lg.file_name WHERE old IS NOT NULL),
 g AS (SELECT c.* FROM c ANTI JOIN b USING (file_name, field)), h AS (SELECT b.* FROM b ANTI JOIN c USING (file_name, field)), one AS MATERIALIZED (SELECT file_name, pk, field, min(val) AS lo, max(val) AS hi FROM w WHERE pk IS NOT NULL GROUP BY 1, 2, 3),
 rn AS MATERIALIZED (SELECT g.file_name, g.field AS f, h.field AS n FROM g JOIN h USING (file_name) JOIN one x ON x.file_name = g.old AND x.field = g.field JOIN one y ON y.file_name = h.file_name AND y.field = h.field AND y.pk = x.pk GROUP BY 1, 2, 3 HAVING count(*) >= 3 AND bool_and(x.lo = x.hi AND x.lo = y.lo AND x.lo = y.hi)),
 steps AS (SELECT file_name, n AS field, 'renamed' AS change FROM rn UNION ALL SELECT file_name, field, 'removed' FROM g WHERE (file_name, field) NOT IN (SELECT (file_name, f) FROM rn) UNION ALL SELECT file_name, field, 'added' FROM h WHERE (file_name, field) NOT IN (SELECT (file_name, n) FROM rn) UNION ALL SELECT b.file_name, b.field, 'retyped' FROM b JOIN c USING (file_name, field) WHERE b.kinds <> c.kinds)"""
P2_FOUND = f"WITH {_DRIFT} SELECT file_name, field, change FROM steps"
P2_VERSIONS = f"""WITH {_DRIFT}, x AS (SELECT file_name, count(*) AS n, '[' || string_agg('{{"field":' || CAST(to_json(field) AS VARCHAR) || ',"types":["' || array_to_string(kinds, '","') || '"]}}', ',' ORDER BY field) || ']' AS j FROM s GROUP BY 1), y AS (SELECT fl.*, coalesce(n, 0) AS n, sha256(coalesce(j, '[]')) AS fingerprint FROM fl LEFT JOIN x USING (file_name)),
 z AS (SELECT *, CAST(fingerprint IS DISTINCT FROM lag(fingerprint) OVER (PARTITION BY feed ORDER BY file_seq, file_name) AS INT) AS moved FROM y)
 SELECT feed, file_seq, file_name, CAST(n AS INT) AS n_fields, fingerprint, CAST(sum(moved) OVER (PARTITION BY feed ORDER BY file_seq, file_name) AS BIGINT) AS version, CAST((SELECT count(*) FROM steps WHERE steps.file_name = z.file_name) AS INT) AS n_steps FROM z"""

_MISSING = f"""{_EV}, mm AS (SELECT {_u('claim_id')} AS k, min(received_at) AS a, min(deleted_at) AS x FROM manifest GROUP BY 1), ii AS (SELECT {_u('claim_instance_id')} AS k, min(received_at) AS a FROM provenance WHERE claim_instance_id IS NOT NULL GROUP BY 1),
 dir AS MATERIALIZED (SELECT event_id, received_at, 'claim_id' AS field, unnest(list_filter([CASE WHEN mm.k IS NULL THEN 'missing' END, CASE WHEN mm.a > ev.received_at THEN 'late' END, CASE WHEN mm.x <= ev.received_at THEN 'deleted' END], lambda y: y IS NOT NULL)) AS kind FROM ev LEFT JOIN mm ON ev.claim_id = mm.k WHERE ev.claim_id IS NOT NULL
 UNION ALL SELECT event_id, received_at, 'target_claim_instance_id', unnest(list_filter([CASE WHEN ii.k IS NULL THEN 'missing' END, CASE WHEN ii.a > ev.received_at THEN 'late' END], lambda y: y IS NOT NULL)) FROM ev LEFT JOIN ii ON ev.target = ii.k WHERE ev.target IS NOT NULL),
 intro AS (SELECT instance, min_by(event_id, (received_at, event_id)) AS parent FROM ev WHERE instance IS NOT NULL GROUP BY 1), link AS MATERIALIZED (SELECT event_id AS id, parent FROM ev JOIN intro ON ev.target = intro.instance),
 fall(id, level) AS (SELECT DISTINCT event_id, 0 FROM dir UNION ALL SELECT link.id, level + 1 FROM link JOIN fall ON link.parent = fall.id WHERE link.id NOT IN (SELECT event_id FROM dir))"""
P3_CASCADE = f"WITH RECURSIVE {_MISSING} SELECT id AS event_id, CAST(level AS INT) AS level, CASE WHEN level = 0 THEN 'direct' ELSE 'inherited' END AS orphan FROM fall"
P3_REPORT = f"""WITH RECURSIVE {_MISSING}, x AS (SELECT received_at, field, kind FROM dir UNION ALL SELECT received_at, '*', '*' FROM fall JOIN ev ON ev.event_id = fall.id WHERE level > 0)
 SELECT 'provenance' AS table_name, strftime(received_at, '%Y-%m') AS period, field, kind, count(*) AS n_references FROM x GROUP BY 2, 3, 4"""

_LOGS = f"ln AS MATERIALIZED (SELECT DISTINCT {_u('package_id')} AS log, line_no AS seq FROM provenance WHERE package_id IS NOT NULL AND line_no IS NOT NULL), ends AS (SELECT log, min(seq) AS e FROM ln WHERE (log, seq + 1) NOT IN (SELECT (log, seq) FROM ln) GROUP BY 1), mark AS (SELECT log, CASE WHEN min(seq) = 1 THEN any_value(e) ELSE 0 END AS watermark FROM ln JOIN ends USING (log) GROUP BY 1)"
P4_WATERMARKS = f"WITH {_LOGS} SELECT log AS package_id, CAST(watermark AS BIGINT) AS watermark FROM mark"


def _state(name: str, source: str) -> str:
    return f"""s{name} AS (SELECT claim_id, min((ms, event_id)) AS s FROM {source} WHERE event_type IN ('create', 'publish') GROUP BY 1), t{name} AS (SELECT x.claim_id, min_by(event_type, (ms, event_id)) AS e FROM {source} x JOIN s{name} USING (claim_id) WHERE event_type IN ('supersede', 'withdraw') AND (ms, event_id) > s GROUP BY 1),
 r{name} AS (SELECT claim_id, CASE e WHEN 'supersede' THEN 'superseded' WHEN 'withdraw' THEN 'withdrawn' ELSE 'active' END AS st FROM s{name} LEFT JOIN t{name} USING (claim_id))"""


P4_STATE = f"""WITH {_EV}, {_LOGS}, fit AS (SELECT * FROM ev WHERE claim_id IS NOT NULL AND ms IS NOT NULL), tx AS (SELECT package_id, ms, max(line_no) AS last FROM fit GROUP BY 1, 2), hl AS (SELECT fit.*, coalesce(tx.last > watermark, false) AS held FROM fit LEFT JOIN tx ON tx.package_id = fit.package_id AND tx.ms = fit.ms LEFT JOIN mark ON mark.log = fit.package_id),
 ok AS (SELECT * FROM hl WHERE NOT held), {_state('a', 'fit')}, {_state('c', 'ok')}
 SELECT hl.claim_id, any_value(ra.st) AS state, any_value(rc.st) AS committed_state, count(*) AS n_changes, count(*) FILTER (held) AS n_held FROM hl LEFT JOIN ra ON ra.claim_id = hl.claim_id LEFT JOIN rc ON rc.claim_id = hl.claim_id GROUP BY 1"""


def _rows_sql() -> str:
    """Multiplicities cancel; what is left of a key is one kind of row on either side wherever SQL can pair it, as in the tables here."""
    digest = "CASE WHEN regexp_matches(lower(trim(hash)), '^(sha-?256[:=-])?[0-9a-f]{64}$') THEN right(lower(trim(hash)), 64) ELSE hash END"
    sides = {
        "manifest": ("claim_id", {"claim_instance_id": _u("claim_instance_id"), "hash": digest, "path": "path", "state": "lower(trim(state))", "superseded_by_claim_id": _u("superseded_by_claim_id"), "tags": "CAST(list_sort(list_distinct(tags)) AS VARCHAR)"}),
        "provenance": ("event_id", {"claim_id": _u("claim_id"), "event_type": "lower(trim(event_type))", "timestamp": f"CAST({_MS} AS VARCHAR)", "actor": "actor", "prev_event_id": _u("prev_event_id")}),
    }
    parts = []
    for name, (key, fields) in sides.items():
        cols = ", ".join(f"{e} AS f{i}" for i, e in enumerate(fields.values()))
        names = ", ".join(f"f{i}" for i in range(len(fields)))
        differs = ", ".join(f"CASE WHEN m > 0 AND a.f{i} IS DISTINCT FROM b.f{i} THEN {{'field': '{f}', 'diff': 'differs', 'n': m}} END" for i, f in enumerate(fields))
        parts.append(f"""SELECT '{name}' AS table_name, k AS key_id, x.field AS field, x.diff AS diff, CAST(x.n AS BIGINT) AS n FROM (SELECT k, unnest(list_filter([{differs}, CASE WHEN nl > m THEN {{'field': '*', 'diff': 'left_only', 'n': nl - m}} END, CASE WHEN nr > m THEN {{'field': '*', 'diff': 'right_only', 'n': nr - m}} END], lambda y: y IS NOT NULL)) AS x
 FROM (SELECT k, coalesce(sum(l - r) FILTER (l > r), 0) AS nl, coalesce(sum(r - l) FILTER (r > l), 0) AS nr, least(nl, nr) AS m, first({{{', '.join(f"'f{i}': f{i}" for i in range(len(fields)))}}}) FILTER (l > r) AS a, first({{{', '.join(f"'f{i}': f{i}" for i in range(len(fields)))}}}) FILTER (r > l) AS b
 FROM (SELECT k, {names}, sum(l) AS l, sum(r) AS r FROM (SELECT {_u(key)} AS k, {cols}, 1 AS l, 0 AS r FROM {name} UNION ALL SELECT {_u(key)}, {', '.join(fields.values())}, 0, 1 FROM {name}_mirror) WHERE k IS NOT NULL GROUP BY ALL) WHERE l <> r GROUP BY k))""")
    return " UNION ALL ".join(parts)


ORACLE = {
    "p1_found": P1_FOUND, "p1_paths": P1_PATHS, "p1_circles": P1_CIRCLES, "p2_found": P2_FOUND, "p2_versions": P2_VERSIONS, "p3_cascade": P3_CASCADE, "p3_report": P3_REPORT, "p4_state": P4_STATE, "p4_watermarks": P4_WATERMARKS,
    "p5_rows": _rows_sql(),
}
