"""DuckDB forms of the training-data queries that SQL can express."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit."""
    byte = "list_reduce(range(8), lambda r, k: xor(r >> 1, 3988292384 * (r & 1)), xor(c, b))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT), lambda c, b: {byte}, 4294967295), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR)))::VARCHAR || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ABOVE = "list_transform(range(0, (len(nodes) + 15) // 16), lambda k: sha256(array_to_string(nodes[16 * k + 1:16 * k + 16], '')))"

MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT coalesce('=' || source, '-') AS g, doc_id, {_leaf("text")} AS leaf,
    CASE WHEN {_crc32("doc_id::VARCHAR")} % 5 = 0 THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {_leaf("text")} END AS shown
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
levels AS (
  SELECT g, 0 AS level, list(leaf ORDER BY i) AS nodes FROM placed GROUP BY g
  UNION ALL SELECT g, level + 1, {_ABOVE} FROM levels WHERE len(nodes) > 1),
subroots AS (SELECT g, nodes[1] AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS i FROM levels WHERE len(nodes) = 1),
tops AS (
  SELECT 0 AS level, list(subroot ORDER BY i) AS nodes FROM subroots
  UNION ALL SELECT level + 1, {_ABOVE} FROM tops WHERE len(nodes) > 1),
steps AS (
  SELECT p.g, p.i, l.level, p.i // CAST(pow(16, l.level) AS BIGINT) AS pos, l.nodes FROM placed p JOIN levels l ON l.g = p.g AND len(l.nodes) > 1
  UNION ALL
  SELECT p.g, p.i, 1000 + t.level, s.i // CAST(pow(16, t.level) AS BIGINT), t.nodes FROM placed p JOIN subroots s ON s.g = p.g JOIN tops t ON len(t.nodes) > 1),
paths AS (
  SELECT g, i, list({{'l': array_to_string(nodes[pos - pos % 16 + 1:pos], ''), 'r': array_to_string(nodes[pos + 2:pos - pos % 16 + 16], '')}} ORDER BY level) AS path FROM steps GROUP BY g, i),
walk AS (
  SELECT p.g, p.i, coalesce(q.path, []) AS path, p.shown AS h, 0 AS k FROM placed p LEFT JOIN paths q ON q.g = p.g AND q.i = p.i
  UNION ALL SELECT g, i, path, sha256(path[k + 1].l || h || path[k + 1].r), k + 1 FROM walk WHERE k < len(path))
SELECT p.doc_id, p.leaf, s.subroot, t.nodes[1] AS root, sha256(array_to_string(list_transform(w.path, lambda x: x.l || x.r), '')) AS proof_sha256, w.h AS folded_root, w.h = t.nodes[1] AS verified
FROM placed p JOIN subroots s ON s.g = p.g JOIN tops t ON len(t.nodes) = 1 JOIN walk w ON w.g = p.g AND w.i = p.i AND w.k = len(w.path)
"""

TRIE = f"""
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 20 AS o, {_crc32("c::VARCHAR")} % 4 AS h, count(*) AS n FROM turns GROUP BY c),
heads AS (SELECT a.*, least(a.h, coalesce(b.n, 0)) AS given FROM convs a LEFT JOIN convs b ON b.c = a.o),
made AS (
  SELECT h.c, t.i AS d, t.role, t.text FROM heads h JOIN turns t ON t.c = h.o AND t.i <= h.given
  UNION ALL SELECT h.c, h.given + t.i - h.h, t.role, t.text FROM heads h JOIN turns t ON t.c = h.c AND t.i > h.h),
prefixes AS (
  SELECT c, d, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w,
    string_agg(octet_length(encode(role))::VARCHAR || ':' || role || octet_length(encode(text))::VARCHAR || ':' || text, '') OVER (PARTITION BY c ORDER BY d) AS prefix FROM made
  UNION ALL SELECT c, 0, 0, '' FROM heads),
sizes AS (SELECT c, max(d) AS size FROM prefixes GROUP BY c),
named AS (SELECT p.c, p.d, p.w, min(p.c) OVER (PARTITION BY p.d, p.prefix) AS name, p.d = s.size AS last FROM prefixes p JOIN sizes s ON s.c = p.c),
nodes AS (
  SELECT d, name, count(*) AS n, any_value(w) AS w, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends FROM named GROUP BY d, name),
linked AS (SELECT n.*, m.name AS up FROM nodes n LEFT JOIN named m ON m.c = n.name AND m.d = n.d - 1),
children AS (SELECT d - 1 AS d, up AS name, count(*) AS k FROM linked WHERE up IS NOT NULL GROUP BY ALL),
whole AS (SELECT l.*, coalesce(c.k, 0) AS k FROM linked l LEFT JOIN children c ON c.d = l.d AND c.name = l.name),
below AS (
  SELECT m.d, m.name, count(*) FILTER (v.k = 0) AS leaves, sum((v.n - 1) * v.w) AS saved FROM whole v JOIN named m ON m.c = v.name AND m.d <= v.d GROUP BY m.d, m.name)
SELECT w.name AS conv_id, w.d::BIGINT AS depth, w.up AS parent_conv_id, w.n AS n_convs, w.k AS n_children, b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, w.ends AS ends_sha256
FROM whole w JOIN below b ON b.d = w.d AND b.name = w.name
"""

SQL = {"op12_merkle_manifest": MERKLE, "op13_conversation_prefix_trie": TRIE}
