"""The same results as the registered queries, as SQL that DuckDB runs."""

from __future__ import annotations

_TYPES = "['CONCEPT','MODEL','METHOD','DATASET','METRIC','PAPER','ORGANIZATION','PERSON']"


def _u(*parts: str) -> str:
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"((CAST(CAST('0x' || substr(md5({text}), 1, 8) AS UBIGINT) AS DOUBLE) + 0.5) / 4294967296.0)"


def _windows(size: int, overlap: int) -> str:
    """words, n and pieces of every record of `recs`."""
    step = size - overlap
    return f"""
worded AS (SELECT *, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS ws FROM recs),
counted AS (SELECT *, CASE WHEN len(ws) = 0 THEN 0 ELSE 1 + CAST(ceil(greatest(0, len(ws) - {size}) / {step}) AS BIGINT) END AS n FROM worded),
based AS (SELECT *, CAST(coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM counted),
cut AS (SELECT *, unnest(range(n)) AS i FROM based),
pieces AS (SELECT *, array_to_string(ws[i * {step} + 1 : i * {step} + {size}], ' ') AS piece FROM cut)"""


_DOCS = "recs AS (SELECT doc_id, lang, source, text FROM documents)"
_RECS = """recs AS (SELECT doc_id, source, text, CASE WHEN doc_id % 3 = 0 THEN 'Doc ' || doc_id ELSE '' END AS title,
  CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id AS VARCHAR) END AS base_id FROM documents WHERE trim(text, E' \\n\\t') <> '')"""

CHUNK_WORDS = f"WITH {_DOCS}, {_windows(128, 16)} SELECT doc_id, CAST(i AS INTEGER) AS i, piece FROM pieces"
CHUNK_COUNTS = f"WITH {_DOCS}, {_windows(512, 64)} SELECT lang, count(*) AS docs, CAST(sum(n) AS BIGINT) AS chunks FROM counted GROUP BY lang"
CHUNK_IDS = f"""WITH {_RECS}, {_windows(128, 16)}
SELECT CASE WHEN base_id IS NULL THEN source || '_' || substr(md5(source || '::' || title || '_' || i), 1, 8) || '_' || (base + i)
            WHEN n = 1 THEN base_id ELSE base_id || '_' || i END AS id, base + i AS chunk_seq, source FROM pieces"""
CHUNK_TITLES = f"""WITH {_RECS}, {_windows(128, 16)}
SELECT base + i AS chunk_seq, title, md5(CASE WHEN i = 0 AND title <> '' THEN title || E'\\n\\n' || piece ELSE piece END) AS text_md5 FROM pieces"""
BLANK = r"SELECT doc_id FROM documents WHERE doc_id % 7 <> 0 AND regexp_matches(text, '\S')"
FALLBACK = """SELECT doc_id AS line_no, 't' || doc_id AS text, CASE WHEN doc_id % 8 = 2 THEN 'T' ELSE '' END AS title,
  CASE doc_id % 8 WHEN 0 THEN CASE WHEN doc_id = 0 THEN 'none' ELSE CAST(doc_id AS VARCHAR) END WHEN 1 THEN 't' || doc_id WHEN 6 THEN '0' ELSE 'none' END AS base_id
  FROM documents WHERE doc_id % 8 IN (0, 1, 2, 3, 6)"""

_CHUNKS = "chunks AS (SELECT 'c' || doc_id AS id, text, '' AS title, source, doc_id AS chunk_seq FROM documents)"
HEAD = f"WITH {_CHUNKS} SELECT id, chunk_seq FROM chunks ORDER BY chunk_seq LIMIT 25"
FILES = f"WITH {_CHUNKS} SELECT id, row_number() OVER (ORDER BY chunk_seq) - 1 AS chunk_seq, CAST(floor((row_number() OVER (ORDER BY chunk_seq) - 1) / 40) AS BIGINT) AS batch_id FROM chunks"
OFFSET = f"WITH {_CHUNKS} SELECT id, chunk_seq FROM chunks ORDER BY chunk_seq LIMIT 20 OFFSET 10"

_MENTIONS = f"""{_CHUNKS},
listed AS (SELECT id, chunk_seq, regexp_extract_all(text, '[A-Z][a-z]{{3,}}') AS ts FROM chunks),
tok AS (SELECT id, chunk_seq, len(ts) AS n, unnest(ts) AS t, unnest(range(len(ts))) AS p FROM listed),
ent AS (SELECT t AS title, {_TYPES}[1 + (length(t) + p) % 8] AS type, t || ' at ' || p AS description, id AS source_id, chunk_seq % 4 AS batch_id, chunk_seq * 1000000 + p AS seq FROM tok),
rel AS (SELECT a.t AS source, b.t AS target, a.t || ' then ' || b.t AS description, CAST(1 + length(a.t) % 10 AS DOUBLE) AS weight, a.id AS source_id,
               a.chunk_seq % 4 AS batch_id, a.chunk_seq * 1000000 + a.n + a.p AS seq FROM tok a JOIN tok b ON a.id = b.id AND b.p = a.p + 1)"""


def _merged(by: str = "") -> str:
    return f"""
ments AS (SELECT {by} title, type, list(description ORDER BY seq) AS description, list(source_id ORDER BY seq) AS text_unit_ids, count(*) AS frequency, min(seq) AS first_seq
          FROM ent GROUP BY {by} title, type),
mrels AS (SELECT {by} source, target, list(description ORDER BY seq) AS description, list(source_id ORDER BY seq) AS text_unit_ids, sum(weight) AS weight, min(seq) AS first_seq
          FROM rel GROUP BY {by} source, target)"""


def _graph(by: str = "") -> str:
    return f"""
nodes AS (SELECT {by} title AS name, arg_max(type, first_seq) AS type, arg_max(description, first_seq) AS description, arg_max(text_unit_ids, first_seq) AS text_unit_ids,
                 arg_max(frequency, first_seq) AS frequency, min(first_seq) AS node_ord FROM ments GROUP BY {by} title),
edges AS (SELECT {by} least(source, target) AS u, greatest(source, target) AS v, arg_max(weight, first_seq) AS weight, arg_max(description, first_seq) AS description,
                 arg_max(text_unit_ids, first_seq) AS text_unit_ids, min(first_seq) AS edge_ord FROM mrels WHERE weight >= 1.0 GROUP BY {by} least(source, target), greatest(source, target))"""


_M = f"WITH {_MENTIONS}"
_G = f"{_M}, {_merged()}, {_graph()}"
_J = lambda c: f"array_to_string({c}, '|') AS {c}"
ENTITIES = f"{_M} SELECT title, type, description, source_id FROM ent"
RELATIONS = f"{_M} SELECT source, target, description, weight, source_id FROM rel"
GLEAN = """SELECT 'c' || doc_id AS source_id, title, 'MODEL' AS type, description FROM documents, (VALUES ('A', 'first'), ('"D"', 'kept')) AS v(title, description)"""
SKIPPED = """SELECT 'f' AS source, CASE doc_id % 8 WHEN 4 THEN 'kind' ELSE 'invalid' END AS status, count(*) AS n FROM documents WHERE doc_id % 8 IN (4, 5) GROUP BY 2"""
WEIGHTS = """SELECT * FROM (VALUES ('3', '3.0'), ('2.5', '2.5'), ('1_000', '1000.0'), ('1d', '1.0'), ('', '1.0'), ('nan', 'NaN'), ('-Infinity', '-Infinity'),
  (' 4e2 ', '400.0'), ('0x10', '1.0'), ('.5', '0.5'), ('5.', '5.0'), ('1__0', '1.0')) AS t(raw, weight)"""
MERGED_ENTITIES = f"{_M}, {_merged()} SELECT title, type, {_J('description')}, {_J('text_unit_ids')}, frequency, first_seq FROM ments"
MERGED_RELATIONS = f"{_M}, {_merged()} SELECT source, target, {_J('description')}, {_J('text_unit_ids')}, weight, first_seq FROM mrels"
ORPHANS = f"""{_M}, {_merged()}, kept AS (SELECT DISTINCT title FROM ent WHERE length(title) % 3 <> 0)
SELECT source, target, weight FROM mrels WHERE source IN (SELECT title FROM kept) AND target IN (SELECT title FROM kept)"""

NODES = f"{_G} SELECT name, type, {_J('description')}, {_J('text_unit_ids')}, frequency, node_ord FROM nodes"
EDGES = f"{_G} SELECT u, v, weight, {_J('description')}, {_J('text_unit_ids')}, edge_ord FROM edges"
_DEG = """deg AS (SELECT name, node_ord, frequency, (SELECT count(*) FROM edges WHERE u = name) + (SELECT count(*) FROM edges WHERE v = name) AS degree FROM nodes)"""
DEGREES = f"{_G}, {_DEG} SELECT name, degree FROM deg"
STATS = f"""{_G}, {_DEG} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, avg(degree) AS avg_degree,
  (SELECT name FROM deg ORDER BY degree DESC, node_ord LIMIT 1) AS max_degree_node FROM deg"""
_T = """WITH line AS (SELECT 'P' || l_partkey AS part, 'S' || l_suppkey AS supp FROM lineitem),
ends AS (SELECT part AS name FROM line UNION ALL SELECT supp FROM line),
pairs AS (SELECT DISTINCT part, supp FROM line),
deg AS (SELECT name, count(*) AS degree FROM (SELECT part AS name FROM pairs UNION ALL SELECT supp FROM pairs) GROUP BY name)"""
BIPARTITE_DEGREES = f"{_T} SELECT name, degree FROM deg"
START_FALLBACK = f"""{_T}, freq AS (SELECT name, count(*) AS f FROM ends GROUP BY name), anyone AS (SELECT count(*) AS n FROM freq WHERE f <= 2)
SELECT name, CASE WHEN (SELECT n FROM anyone) > 0 THEN CASE WHEN f <= 2 THEN 1.0 / (f * degree) ELSE 0.0 END ELSE CAST(degree AS DOUBLE) END AS weight FROM deg JOIN freq USING (name)"""

_B = f"{_M}, {_merged('batch_id,')}, {_graph('batch_id,')}"


def _tail(c: str) -> str:
    rest = f"flatten(list({c} ORDER BY batch_id)[2:])"
    first = f"list({c} ORDER BY batch_id)[1]"
    return f"struct_pack(f := {first}, r := coalesce({rest}, []))"


_UNSEEN = lambda c: f"list_concat({c}.f, list_filter({c}.r, lambda x, i: NOT list_contains({c}.f, x) AND list_position({c}.r, x) = i))"
FOLDED_NODES = f"""{_B}, g AS (SELECT name, arg_min(type, batch_id) AS type, {_tail('description')} AS d, {_tail('text_unit_ids')} AS t, count(*) AS k, min(frequency) AS f FROM nodes GROUP BY name)
SELECT name, type, array_to_string({_UNSEEN('d')}, '|') AS description, array_to_string({_UNSEEN('t')}, '|') AS text_unit_ids,
       CASE WHEN k = 1 THEN f ELSE CAST(len({_UNSEEN('t')}) AS BIGINT) END AS frequency FROM g"""
FOLDED_EDGES = f"""{_B}, g AS (SELECT u, v, sum(weight) AS weight, {_tail('description')} AS d, {_tail('text_unit_ids')} AS t FROM edges GROUP BY u, v)
SELECT u, v, weight, array_to_string({_UNSEEN('d')}, '|') AS description, array_to_string({_UNSEEN('t')}, '|') AS text_unit_ids FROM g"""
MIN_WEIGHT = f"""{_M}, {_merged()} SELECT least(source, target) AS u, greatest(source, target) AS v, arg_max(weight, first_seq) AS weight
FROM mrels WHERE weight >= 6.0 GROUP BY 1, 2"""
STREAMED = f"""{_B}, g AS (SELECT name, {_tail('text_unit_ids')} AS t, count(*) AS k, min(frequency) AS f FROM nodes GROUP BY name)
SELECT name, CASE WHEN k = 1 THEN f ELSE CAST(len({_UNSEEN('t')}) AS BIGINT) END AS frequency, CAST(len({_UNSEEN('t')}) AS INTEGER) AS ids FROM g"""
COVERED = f"{_G} SELECT DISTINCT unnest(text_unit_ids) AS id FROM nodes"
PENDING = f"{_B} SELECT id, chunk_seq FROM chunks WHERE id NOT IN (SELECT unnest(text_unit_ids) FROM nodes WHERE batch_id < 3)"

# ---- walks: the seed is 42, alpha 3, 3 to 5 hops, 4 attempts, 500 candidates a round, 500 walks
_W = f"""{_G}, {_DEG},
rare AS (SELECT name, degree, CASE WHEN degree > 0 AND frequency <= 2 THEN 1.0 / (frequency * degree) ELSE 0.0 END AS r FROM deg),
weights AS (SELECT name, degree, CASE WHEN (SELECT sum(r) FROM rare) > 0 THEN r ELSE CAST(degree AS DOUBLE) END AS weight FROM rare)"""
START_RARE = f"{_W} SELECT name, degree, CAST(weight AS DOUBLE) AS weight FROM weights"
ELIGIBLE = f"{_W} SELECT count(*) AS nodes, count(*) FILTER (WHERE weight > 0) AS eligible FROM weights"
START_DEGREE = f"{_W} SELECT name, CAST(degree AS DOUBLE) AS weight FROM weights"
_S = f"""{_W},
units AS (SELECT name, substr(md5(name), 1, 3) AS part, CAST(floor(weight * 4294967296) AS HUGEINT) AS units FROM weights WHERE floor(weight * 4294967296) > 0),
spans AS (SELECT name, units, sum(units) OVER (ORDER BY part, name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS high FROM units),
points AS (SELECT cand, {_u('42', "'start'", 'cand')} * (SELECT CAST(max(high) AS DOUBLE) FROM spans) AS point FROM (SELECT unnest(range(:n:)) AS cand)),
starts AS (SELECT cand, name AS start FROM points JOIN spans ON point >= CAST(high - units AS DOUBLE) AND point < CAST(high AS DOUBLE)),
adj AS (SELECT a, b, weight, text_unit_ids[1] AS b_chunk FROM (SELECT u AS a, v AS b, weight FROM edges WHERE u <> v UNION ALL SELECT v, u, weight FROM edges WHERE u <> v) JOIN nodes ON nodes.name = b)"""
START_SAMPLE = f"{_S.replace(":n:", "1000")} SELECT cand, start FROM starts"


def _hop(k: int) -> str:
    return f"""
m{k} AS (SELECT cand, attempt, b, b_chunk, weight * CASE WHEN coalesce(b_chunk, '') <> '' AND b_chunk IS DISTINCT FROM chunks[-1] THEN 3.0 ELSE 1.0 END AS score
         FROM f{k - 1} JOIN adj ON a = path[-1] WHERE live AND target >= {k} AND NOT list_contains(path, b)),
w{k} AS (SELECT cand, attempt, b, b_chunk FROM m{k} WHERE score > 0
         QUALIFY row_number() OVER (PARTITION BY cand, attempt ORDER BY -ln({_u('42', 'cand', 'attempt', str(k), 'b')}) / score, b) = 1),
f{k} AS (SELECT f.cand, f.attempt, f.target, CASE WHEN w.b IS NULL THEN f.path ELSE list_append(f.path, w.b) END AS path,
                CASE WHEN w.b IS NULL THEN f.chunks ELSE list_append(f.chunks, w.b_chunk) END AS chunks, f.live AND w.b IS NOT NULL AS live
         FROM f{k - 1} f LEFT JOIN w{k} w ON f.cand = w.cand AND f.attempt = w.attempt)"""


WALK_HOP1 = f"""{_S.replace(":n:", "500")}, f0 AS (SELECT cand, 0 AS attempt, 3 AS target, [start] AS path, ['c0'] AS chunks, true AS live FROM starts), {_hop(1)}
SELECT cand, array_to_string(path, '>') AS path FROM f1"""
_RAW = f"""{_S},
f0 AS (SELECT cand, attempt, 3 + CAST(floor({_u('42', 'cand', 'attempt', "'hops'")} * 3) AS INTEGER) AS target, [start] AS path, [text_unit_ids[1]] AS chunks, true AS live
       FROM starts JOIN nodes ON name = start, (SELECT unnest(range(4)) AS attempt)),
{_hop(1)}, {_hop(2)}, {_hop(3)}, {_hop(4)}, {_hop(5)},
raw AS (SELECT cand, CAST(attempt AS INTEGER) AS attempt, path, chunks, len(path) - 1 >= 3 AND len(list_distinct(chunks)) >= 2 AS accepted FROM f5)"""
_R = f"""{_RAW.replace(":n:", "1500")},
walks AS (SELECT cand, attempt, path, chunks, len(list_distinct(chunks)) AS crossed FROM raw WHERE accepted
          QUALIFY row_number() OVER (PARTITION BY cand ORDER BY attempt) = 1 ORDER BY cand LIMIT 500)"""
WALKS_RAW = f"{_RAW.replace(chr(58) + 'n:', '500')} SELECT cand, attempt, array_to_string(path, '>') AS path, accepted FROM raw"
WALKS_ACCEPTED = f"{_R} SELECT cand, attempt, array_to_string(path, '>') AS path, array_to_string(chunks, '>') AS chunks FROM walks"
WALK_SUMMARY = f"{_R} SELECT count(*) AS walks, avg(len(path) - 1) AS avg_hops, avg(crossed) AS avg_chunks FROM walks"
PATH_TEXT = f"""{_R},
steps AS (SELECT cand, path, len(path) AS n, unnest(path) AS name, unnest(range(len(path))) AS i FROM walks),
lines AS (SELECT s.cand, i, (i + 1) || '. ' || s.name || E'\\n   (' || nodes.description[1] || ')' ||
                 CASE WHEN i < n - 1 THEN E'\\n   → ' || e.description[1] ELSE '' END AS line
          FROM steps s JOIN nodes ON nodes.name = s.name LEFT JOIN edges e ON e.u = least(s.name, path[i + 2]) AND e.v = greatest(s.name, path[i + 2]))
SELECT cand, string_agg(line, E'\\n' ORDER BY i) AS path_text FROM lines GROUP BY cand"""
PASSAGES = f"""{_R},
once AS (SELECT cand, list_filter(chunks, lambda x, i: list_position(chunks, x) = i) AS ids FROM walks),
asked AS (SELECT cand, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS k FROM once),
told AS (SELECT cand, string_agg('[Passage ' || k || E']\\n' || text, E'\\n\\n' ORDER BY k) AS t FROM asked JOIN chunks c USING (id) GROUP BY cand)
SELECT cand, CAST(length(t) AS INTEGER) AS n, md5(t) AS md5 FROM told"""

_Q = f"""{_R},
told AS (SELECT cand, path, chunks, crossed, path[1] AS target, 'Step 1: start at ' || path[1] || E'\\nStep 2: go on to ' || path[2] AS why, 'Which one is number ' || cand || '?' AS asked FROM walks)"""
QA_PARSE = f"""{_Q} SELECT cand,
  CASE cand % 8 WHEN 1 THEN 'Is it ' || upper(target) || '?' WHEN 3 THEN '-' WHEN 4 THEN '-' WHEN 7 THEN 'SKIP' ELSE asked END AS question,
  CASE cand % 8 WHEN 2 THEN 'Too short to keep.' WHEN 3 THEN '-' WHEN 4 THEN '-' ELSE why END AS reasoning,
  CASE WHEN cand % 8 IN (3, 4) THEN '-' ELSE target END AS answer FROM told"""
_STATUS = "CASE cand % 8 WHEN 1 THEN 'leak' WHEN 2 THEN 'short' WHEN 3 THEN 'unparsed' WHEN 4 THEN 'unparsed' WHEN 5 THEN 'failed' ELSE 'ok' END"
QA_GATES = f"{_Q} SELECT cand, {_STATUS} AS status FROM told"
QA_YIELD = f"{_Q} SELECT {_STATUS} AS status, count(*) AS n FROM told GROUP BY 1"
QA_INTER = f"""{_Q} SELECT cand, CASE WHEN cand % 8 = 7 THEN 'SKIP' ELSE asked END AS human, why || E'\\n\\nFinal Answer: ' || target AS gpt, target AS target_node,
  array_to_string(list_filter(chunks, lambda x, i: list_position(chunks, x) = i), '>') AS chunk_ids, CAST(crossed AS INTEGER) AS chunks_crossed FROM told WHERE cand % 8 IN (0, 6, 7)"""
QA_INTRA = f"""WITH {_CHUNKS}, named AS (SELECT id, regexp_extract(text, '[A-Z][a-z]{{3,}}') AS name FROM chunks)
SELECT id, 'What begins ' || id || '?' AS human, 'It begins with ' || name || E'\\n\\nFinal Answer: ' || name AS gpt, 'intra' AS type FROM named WHERE name <> ''"""

LABELS = "SELECT * FROM (VALUES ('ORGANIZATION', 'Organization'), ('BIG_MODEL', 'Big_model'), ('3D', 'T_3d'), ('', 'Entity'), ('big model', 'Big_model'), ('x-y', 'X_y')) AS t(type, label)"
REL_TYPES = "SELECT * FROM (VALUES ('related to', 'RELATED_TO'), ('RELATED', 'RELATED'), ('2nd', 'R_2ND'), ('', 'RELATED'), (' cites ', 'CITES')) AS t(type, rel_type)"
_LABEL = "upper(left(type, 1)) || lower(substr(type, 2))"
PG_NODES = f"{_G} SELECT {_LABEL} AS label, name, type, {_J('description')}, frequency, {_J('text_unit_ids')} FROM nodes"
PG_RELS = f"""{_G}, ends AS (SELECT name, {_LABEL} AS label, node_ord FROM nodes),
both_ends AS (SELECT e.*, a.label AS ul, b.label AS vl, a.node_ord <= b.node_ord AS forth FROM edges e JOIN ends a ON a.name = e.u JOIN ends b ON b.name = e.v)
SELECT CASE WHEN forth THEN ul ELSE vl END AS src_label, 'MENTIONED_WITH' AS rel_type, CASE WHEN forth THEN vl ELSE ul END AS tgt_label,
  CASE WHEN forth THEN u ELSE v END AS source_name, CASE WHEN forth THEN v ELSE u END AS target_name, weight, {_J('text_unit_ids')} FROM both_ends"""
PG_BATCHES = f"""{_G}, numbered AS (SELECT {_LABEL} AS label, row_number() OVER (PARTITION BY type ORDER BY node_ord) - 1 AS k FROM nodes)
SELECT label, CAST(floor(k / 100) AS BIGINT) AS batch, count(*) AS n FROM numbered GROUP BY 1, 2"""
PG_UPSERT = f"""{_B} SELECT {_LABEL} AS label, name, arg_max(frequency, batch_id) AS frequency FROM nodes GROUP BY 1, 2"""

_TURNS = """WITH turns AS (SELECT conv_id, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)"""
MESSAGES = f"{_TURNS} SELECT conv_id, CAST(i AS INTEGER) AS i, role, md5(text) AS content_md5 FROM turns"
MIX = """SELECT DISTINCT conv_id, md5('42|' || conv_id) AS "order" FROM conversations"""
_PLAIN = f"""{_TURNS}, put AS (SELECT *, CASE role WHEN 'user' THEN '### Human: ' || text || E'\\n\\n### Assistant: ' WHEN 'assistant' THEN text || '</s>' ELSE '' END AS said FROM turns)"""
PLAIN = f"{_PLAIN}, whole AS (SELECT conv_id, string_agg(said, '' ORDER BY i) AS t FROM put GROUP BY conv_id) SELECT conv_id, CAST(length(t) AS INTEGER) AS n, md5(t) AS md5 FROM whole"
IM = f"""{_TURNS}, put AS (SELECT *, CASE WHEN role IN ('user', 'assistant') THEN '<|im_start|>' || role || E'\\n' || text || E'<|im_end|>\\n' ELSE '' END AS said FROM turns),
whole AS (SELECT conv_id, E'<|im_start|>system\\n' || CASE WHEN arg_min(role, i) = 'system' THEN arg_min(text, i) ELSE 'You are a helpful assistant.' END || E'<|im_end|>\\n' ||
          string_agg(said, '' ORDER BY i) AS t FROM put GROUP BY conv_id) SELECT conv_id, CAST(length(t) AS INTEGER) AS n, md5(t) AS md5 FROM whole"""
SPANS = f"""{_PLAIN}, placed AS (SELECT *, coalesce(sum(length(said)) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM put)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS INTEGER) AS k, CAST(pos AS INTEGER) AS start, CAST(pos + length(text) AS INTEGER) AS "end" FROM placed WHERE role = 'assistant'"""
