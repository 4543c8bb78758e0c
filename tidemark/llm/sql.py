"""SQL for the rows of those corpus queries that SQL can express on whole tables in reasonable time."""

from __future__ import annotations

OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
windows AS (
  SELECT doc_id, p, array_to_string(ws[p:p + 49], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w WHERE len(ws) >= 50)),
firsts AS (SELECT k, min(doc_id) AS d FROM windows GROUP BY k),
starts AS (SELECT doc_id, p FROM windows JOIN firsts USING (k) WHERE doc_id > d),
hit AS (SELECT DISTINCT doc_id, p + o AS i FROM starts, (SELECT unnest(range(50)) AS o)),
numbered AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (
  SELECT n.doc_id, string_agg(word, ' ' ORDER BY n.i) AS kept, count(*) AS n_kept
  FROM numbered n ANTI JOIN hit h ON n.doc_id = h.doc_id AND n.i = h.i GROUP BY n.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
OP6_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 800)) AS k FROM (SELECT doc_id, x, unnest(range(0, n - 399)) AS p FROM d WHERE n >= 400)),
twice AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
starts AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM windows JOIN twice USING (k)),
marked AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p - before > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM starts),
runs AS (SELECT doc_id, run, min(p) AS a, max(p) + 400 AS b FROM marked GROUP BY ALL),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY run)
         UNION ALL SELECT d.doc_id, coalesce(max(r.b), 0), any_value(d.n) FROM d LEFT JOIN runs r ON r.doc_id = d.doc_id GROUP BY d.doc_id),
kept AS (SELECT g.doc_id, string_agg(substr(x, 2 * g.a + 1, 2 * (g.b - g.a)), '' ORDER BY g.a, g.b) AS kept FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id),
sums AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN sums s ON s.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, array_to_string(ws[p:p + 2], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM w WHERE len(ws) >= 3)
    UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) IN (1, 2))),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x AS node, x AS other FROM both_ways UNION SELECT r.node, b.y FROM reach r JOIN both_ways b ON r.other = b.x),
component AS (SELECT node, min(other) AS c FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, w.doc_id) AS component_id, coalesce(c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN sizes s ON s.doc_id = w.doc_id LEFT JOIN component ON node = w.doc_id
"""


def _apportion(seats: str, out: str, group: str, key: str, value: str, total: str, limit: str) -> str:
    """Common table expressions that add quota to seats; see mixing.apportion for the rule."""
    return f"""
{out}_share AS (
  SELECT *, {value} / CASE WHEN sum({value}) OVER g > 0 THEN sum({value}) OVER g ELSE 1.0 END * {total} AS share, count(*) OVER g AS n_keys
  FROM {seats} WINDOW g AS (PARTITION BY {group})),
{out}_sure AS (
  SELECT *, CAST(least(greatest(floor(share - share * n_keys / (2 * greatest({total}, 1)) - 0.5), 0), {limit}) AS BIGINT) AS sure,
         CAST(least(ceil(share + share * n_keys / (2 * greatest({total}, 1)) + 0.5), {limit}) AS BIGINT) AS most_k FROM {out}_share),
{out}_free AS (SELECT *, {total} - sum(sure) OVER (PARTITION BY {group}) AS free, {key} AS own FROM {out}_sure),
{out}_rank AS (
  SELECT {group}, own, free, row_number() OVER (PARTITION BY {group} ORDER BY {value} / (2 * k + 1) DESC, own, k) AS r
  FROM (SELECT *, unnest(range(sure, most_k)) AS k FROM {out}_free)),
{out} AS (
  SELECT f.*, f.sure + (SELECT count(*) FROM {out}_rank r WHERE r.own IS NOT DISTINCT FROM f.own AND r.{group} IS NOT DISTINCT FROM f.{group} AND r.r <= r.free) AS quota
  FROM {out}_free f)"""


_NUMBER = "CAST(('0x' || substr({}, 1, 8)) AS BIGINT)"
OP7_SQL = rf"""
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('7|' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS mark FROM documents),
weighted AS (
  SELECT source, source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 3 * source_size AS cap
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source)),
filled AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_
  FROM weighted WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
first_open AS (SELECT rest, left_ FROM filled WHERE NOT cap * left_ <= weight * rest ORDER BY cap / weight, rest, left_ LIMIT 1),
sources AS (
  SELECT f.source, f.source_size, CASE WHEN f.cap * f.left_ <= f.weight * f.rest THEN CAST(f.cap AS DOUBLE) ELSE f.weight * CAST(o.rest AS DOUBLE) / o.left_ END AS target
  FROM filled f LEFT JOIN first_open o ON TRUE),
dealt AS (
  SELECT d.*, s.source_size, s.target, {_NUMBER.format('mark')} % greatest(CAST(ceil(s.source_size / 1048576) AS BIGINT), 1) AS shard
  FROM docs d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source),
shards AS (
  SELECT source, shard, CAST(sum(size) AS BIGINT) AS shard_size, any_value(target) AS target, any_value(source_size) AS source_size,
         CAST(ceil(sum(size) / 32) AS BIGINT) AS blocks FROM dealt GROUP BY source, shard),
seats AS (
  SELECT 0 AS everything, source, any_value(target) AS target, 3 * CAST(sum(blocks) AS BIGINT) AS most,
         (SELECT CAST(round(sum(target) / 32) AS BIGINT) FROM sources) AS total FROM shards GROUP BY source),
{_apportion('seats', 'by_source', 'everything', 'source', 'target', 'total', 'most')},
shard_seats AS (
  SELECT s.*, q.quota AS source_quota, 3 * s.blocks AS most FROM shards s JOIN by_source q ON s.source IS NOT DISTINCT FROM q.source),
{_apportion('shard_seats', 'by_shard', 'source', 'shard', 'shard_size', 'source_quota', 'most')},
parts AS (
  SELECT source, shard, shard_size, blocks, CASE WHEN blocks > 0 THEN quota // blocks ELSE 0 END AS whole, CASE WHEN blocks > 0 THEN quota % blocks ELSE 0 END AS part,
         {_NUMBER.format("md5('7|' || shard || '|' || coalesce(source, ''))")} % greatest(blocks, 1) AS start FROM by_shard),
placed AS (
  SELECT d.*, CAST(sum(size) OVER (PARTITION BY source, shard ORDER BY mark, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS put FROM dealt d),
cut AS (
  SELECT p.doc_id, p.size, p.source_size, p.target, whole,
         least(greatest(start * 32 - put, 0), size) AS a,
         least(greatest(least((start + least(part, blocks - start)) * 32, shard_size) - put, 0), size) AS b,
         least(greatest(least(greatest(start + part - blocks, 0) * 32, shard_size) - put, 0), size) AS c
  FROM placed p JOIN parts q ON p.source IS NOT DISTINCT FROM q.source AND p.shard = q.shard)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(b, a) - a + c AS BIGINT) AS taken FROM cut
"""


#: crc32 of a decimal number: the table follows from the polynomial, a number's digits are folded over it.
_CRC_TABLE = """(SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS tab FROM (SELECT unnest(range(256)) AS i))"""
_CRC = "xor(list_reduce(list_transform(string_split({0}, ''), lambda x: CAST(ord(x) AS BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"
_FIELD = "coalesce(octet_length(encode({0})) || ':' || {0}, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _levels(name: str, start: str) -> str:
    """Common table expression name(tree, level, i, n, d): all levels of the trees whose lowest one start gives."""
    return f"""
{name} AS (
  SELECT tree, 0 AS level, i, n, d FROM ({start})
  UNION ALL
  SELECT tree, level + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(d, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY tree, level, i // 2)"""


OP11_SQL = f"""
WITH RECURSIVE crc AS MATERIALIZED {_CRC_TABLE},
d AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_leaf('n_chars')} AS leaf,
         CASE WHEN {_CRC.format('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_leaf('(n_chars + 1)')} END AS tampered
  FROM documents, crc),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
{_levels('below', 'SELECT tree, i, n, leaf AS d FROM placed')},
subroots AS MATERIALIZED (SELECT tree AS own, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, d FROM below WHERE n = 1),
{_levels('above', "SELECT '' AS tree, i, n, d FROM subroots")},
path AS (
  SELECT p.tree, p.i AS leaf_i, b.level, b.n > 1 AS inner_, (p.i >> b.level) % 2 AS side, s.d AS sibling
  FROM placed p JOIN below b ON b.tree = p.tree AND b.i = p.i >> b.level AND b.n > 1
  LEFT JOIN below s ON s.tree = b.tree AND s.level = b.level AND s.i = xor(b.i, 1)),
up AS (
  SELECT r.own AS tree, a.level, (r.i >> a.level) % 2 AS side, s.d AS sibling
  FROM subroots r JOIN above a ON a.i = r.i >> a.level AND a.n > 1 LEFT JOIN above s ON s.level = a.level AND s.i = xor(a.i, 1)),
way AS (
  SELECT tree, leaf_i, level, side, sibling FROM path
  UNION ALL SELECT p.tree, p.i, 1000 + u.level, u.side, u.sibling FROM placed p JOIN up u ON u.tree = p.tree),
steps AS (
  SELECT tree, leaf_i, list(struct_pack(side := side, sibling := sibling) ORDER BY level) AS steps, coalesce(string_agg(sibling, '' ORDER BY level), '') AS siblings
  FROM way GROUP BY tree, leaf_i),
folded AS (
  SELECT p.doc_id, p.leaf, s.d AS subroot, (SELECT d FROM above WHERE n = 1) AS root, sha256(coalesce(w.siblings, '')) AS proof_sha256,
         list_reduce(list_transform(coalesce(w.steps, []), lambda x: struct_pack(d := '', s := x.sibling, side := x.side)),
                     lambda a, x: struct_pack(d := sha256(CASE WHEN x.side = 1 THEN coalesce(x.s, '') || a.d ELSE a.d || coalesce(x.s, '') END), s := '', side := CAST(0 AS BIGINT)),
                     struct_pack(d := coalesce(p.tampered, p.leaf), s := '', side := CAST(0 AS BIGINT))).d AS folded_root
  FROM placed p JOIN subroots s ON s.own = p.tree LEFT JOIN steps w ON w.tree = p.tree AND w.leaf_i = p.i)
SELECT *, folded_root = root AS verified FROM folded
"""
OP13_SQL = f"""
WITH crc AS MATERIALIZED {_CRC_TABLE},
said AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS x
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
lent AS (SELECT conv_id, x, {_CRC.format('CAST(conv_id AS VARCHAR)')} % 6 AS h FROM said, crc),
whole AS MATERIALIZED (
  SELECT c.conv_id, list_concat(coalesce(b.x, [])[1:c.h], c.x[c.h + 1:]) AS x
  FROM lent c LEFT JOIN said b ON b.conv_id = c.conv_id - c.conv_id % 100),
nodes AS MATERIALIZED (
  SELECT d AS depth, x[1:d] AS x, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(x) = d), '')) AS ends_sha256
  FROM (SELECT conv_id, x, unnest(range(0, len(x) + 1)) AS d FROM whole) GROUP BY d, x[1:d]),
kids AS (SELECT x[1:depth - 1] AS x, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
own AS MATERIALIZED (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN n.depth > 0 THEN (n_convs - 1) * length(n.x[n.depth].t) ELSE 0 END AS saved
  FROM nodes n LEFT JOIN kids k ON k.depth = n.depth AND k.x = n.x),
trees AS (
  SELECT depth, x, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT d AS depth, x[1:d] AS x, n_children, saved FROM (SELECT x, n_children, saved, unnest(range(0, depth + 1)) AS d FROM own)) GROUP BY depth, x)
SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, o.ends_sha256
FROM own o JOIN trees t ON t.depth = o.depth AND t.x = o.x LEFT JOIN nodes p ON p.depth = o.depth - 1 AND p.x = o.x[1:o.depth - 1]
"""
