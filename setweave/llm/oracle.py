"""DuckDB SQL of the queries whose statement needs checksums or recursion."""

from __future__ import annotations

#: One byte x into the running checksum a, bit by bit; 3988292384 is the reversed polynomial of CRC-32.
_BYTE = "list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), xor(a, x))"
_ASCII = "list_transform(range(1, len({0}) + 1), lambda i: CAST(ascii({0}[i]) AS BIGINT))"
_LATIN = "flatten(list_transform(range(1, len({0}) + 1), lambda i: CASE WHEN unicode({0}[i]) < 128 THEN [CAST(unicode({0}[i]) AS BIGINT)] ELSE [195, CAST(unicode({0}[i]) - 64 AS BIGINT)] END))"  # UTF-8 up to U+00FF
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Words of lower-cased text, as a pattern.
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def crc32(data: str) -> str:
    """Unsigned CRC-32 of a list of byte values."""
    return f"xor(list_reduce({data}, lambda a, x: {_BYTE}, 4294967295), 4294967295)"


def _piece(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


#: t and u: the nodes of the trees of each group and of the groups, by level; r: their runs; w: each leaf on its way up.
MERKLE = f"""
WITH RECURSIVE d AS (SELECT *, coalesce('=' || lang, '') AS grp, {' || '.join(_piece(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} AS head, CAST(doc_id AS VARCHAR) AS id FROM documents),
l AS (SELECT doc_id, grp, sha256(head || {_piece('text')}) AS leaf,
  CASE WHEN {crc32(_ASCII.format('id'))} % 3 = 0 THEN sha256(head || {_piece(_LOWERED)}) END AS tampered FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
t AS (SELECT 0 AS level, grp, pos, leaf AS node, count(*) OVER (PARTITION BY grp) AS width FROM n
  UNION ALL SELECT any_value(level) + 1, grp, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), any_value(width + 7) // 8 FROM t WHERE width > 1 GROUP BY grp, pos // 8),
s AS (SELECT grp AS name, node AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS width FROM t WHERE width = 1),
u AS (SELECT 0 AS level, pos, subroot AS node, width FROM s
  UNION ALL SELECT any_value(level) + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), any_value(width + 7) // 8 FROM u WHERE width > 1 GROUP BY pos // 8),
r AS (SELECT 0 AS tier, grp, level, pos // 8 AS run, list(node ORDER BY pos) AS nodes FROM t WHERE width > 1 GROUP BY ALL
  UNION ALL SELECT 1, '', level, pos // 8, list(node ORDER BY pos) FROM u WHERE width > 1 GROUP BY ALL),
w AS (SELECT doc_id, leaf, n.grp, 0 AS tier, 0 AS level, n.pos AS pos, s.pos AS over, subroot, coalesce(tampered, leaf) AS cur, '' AS proof FROM n JOIN s ON n.grp = s.name
  UNION ALL SELECT doc_id, leaf, CASE WHEN nodes IS NULL THEN '' ELSE w.grp END, CASE WHEN nodes IS NULL THEN 1 ELSE w.tier END, CASE WHEN nodes IS NULL THEN 0 ELSE w.level + 1 END,
    CASE WHEN nodes IS NULL THEN over ELSE pos // 8 END, over, subroot,
    CASE WHEN nodes IS NULL THEN cur ELSE sha256(array_to_string(nodes[:pos % 8] || [cur] || nodes[pos % 8 + 2:], '')) END,
    CASE WHEN nodes IS NULL THEN proof ELSE proof || array_to_string(nodes[:pos % 8] || nodes[pos % 8 + 2:], '') END
  FROM w LEFT JOIN r ON r.tier = w.tier AND r.grp = w.grp AND r.level = w.level AND r.run = w.pos // 8 WHERE nodes IS NOT NULL OR w.tier = 0)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM w, (SELECT node AS root FROM u WHERE width = 1) WHERE w.tier = 1 AND NOT EXISTS (SELECT 1 FROM r WHERE r.tier = 1 AND r.level = w.level AND r.run = w.pos // 8)"""

#: bw: the items' windows; h: the windows of texts that are among them.
WINNOWING = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWERED}, '{_WORD}'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWERED}, '{_WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM (SELECT *, least(len(w), 10) AS m FROM b), unnest(range(1, len(w) - m + 2)) t(i) WHERE m > 0),
dw AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM d, (SELECT DISTINCT m FROM bw), unnest(range(1, len(w) - m + 2)) t(i)),
h AS (SELECT * FROM dw SEMI JOIN bw USING (m, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY 1),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h JOIN bw USING (m, win)) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)"""

#: e: words with one character left out; p: near words.
PERMUTERM = f"""
WITH RECURSIVE r AS (SELECT doc_id, run, count(*) AS c, doc_id || ':' || run AS s FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE len(run) >= 7 GROUP BY doc_id, run),
h AS (SELECT run, c, {crc32(_LATIN.format('s'))} AS h FROM r),
n AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT c, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word FROM h)
  WHERE len(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
e AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM n, unnest(range(1, len(word) + 1)) t(i)),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM e a JOIN e b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT e.word, n.word, n.n FROM e JOIN n ON rest = n.word UNION SELECT n.word, e.word, e.n FROM e JOIN n ON rest = n.word),
b AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS best, max(m) AS best_n FROM p GROUP BY word),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM n LEFT JOIN b USING (word)),
g AS (SELECT word, word AS root FROM f UNION ALL SELECT g.word, form FROM g JOIN f ON g.root = f.word WHERE form IS NOT NULL)
SELECT f.word, form, g.root, n, n_near, form_n FROM f JOIN g USING (word) WHERE NOT EXISTS (SELECT 1 FROM f x WHERE x.word = g.root AND x.form IS NOT NULL)"""
