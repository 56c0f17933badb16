"""SQL of the manifest and of the runs."""

from __future__ import annotations

#: crc32 of a whole number's digits, by the table of its 256 steps.
CRC = """
steps AS (
  SELECT range AS byte, range AS v, 0 AS k FROM range(256)
  UNION ALL SELECT byte, CASE WHEN v % 2 = 1 THEN xor(3988292384, v // 2) ELSE v // 2 END, k + 1 FROM steps WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY byte) AS t FROM steps WHERE k = 8),
crcs AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                     lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295) AS h
  FROM (SELECT DISTINCT doc_id FROM documents), crc_table)
"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}, '-')"


def _leaf(chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("d.doc_id", "source", "lang", chars, "text"))) + ")"


_LEVEL = """
  UNION ALL SELECT tree, level + 1, i // 2, sha256(string_agg(d, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {t}) WHERE n > 1 GROUP BY tree, level, i // 2"""

MERKLE = f"""
WITH RECURSIVE {CRC},
leaves AS (
  SELECT d.doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY d.doc_id) - 1 AS i, {_leaf("n_chars")} AS leaf,
         {_leaf("(n_chars + CASE WHEN h % 7 = 0 THEN 1 ELSE 0 END)")} AS shown
  FROM documents d JOIN crcs USING (doc_id)),
low AS (SELECT tree, 0 AS level, i, leaf AS d FROM leaves {_LEVEL.format(t="low")}),
tops AS (SELECT tree, max(level) AS height, arg_max(d, level) AS d FROM low GROUP BY tree),
high AS (SELECT 0 AS tree, 0 AS level, tree AS i, d FROM tops {_LEVEL.format(t="high")}),
sides AS (
  SELECT l.doc_id, 0 AS part, s.level, CASE WHEN (l.i >> s.level) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(n.d, '') AS step
  FROM leaves l JOIN tops t ON t.tree = l.tree JOIN (SELECT DISTINCT level FROM low) s ON s.level < t.height
  LEFT JOIN low n ON n.tree = l.tree AND n.level = s.level AND n.i = xor(l.i >> s.level, 1)
  UNION ALL
  SELECT l.doc_id, 1, s.level, CASE WHEN (l.tree >> s.level) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(n.d, '')
  FROM leaves l JOIN (SELECT DISTINCT level FROM high) s ON s.level < (SELECT max(level) FROM high)
  LEFT JOIN high n ON n.level = s.level AND n.i = xor(l.tree >> s.level, 1)),
proofs AS (SELECT doc_id, list(step ORDER BY part, level) AS steps FROM sides GROUP BY doc_id),
whole AS (
  SELECT l.doc_id, l.leaf, t.d AS subroot, (SELECT arg_max(d, level) FROM high) AS root,
         sha256(coalesce(array_to_string(list_transform(p.steps, lambda s: s[2:]), ''), '')) AS proof_sha256,
         list_reduce(list_prepend(l.shown, coalesce(p.steps, [])),
                     lambda a, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || a ELSE a || s[2:] END)) AS folded_root
  FROM leaves l JOIN tops t USING (tree) LEFT JOIN proofs p USING (doc_id))
SELECT *, folded_root = root AS verified FROM whole
"""

RUNS = rf"""
WITH RECURSIVE {CRC},
split AS (
  SELECT doc_id, h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents JOIN crcs USING (doc_id)),
sized AS (SELECT *, len(ws) AS n, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM split),
planted AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END + 1]) ELSE ws END AS ws
  FROM sized),
tok AS MATERIALIZED (SELECT doc_id, n, unnest(ws) AS word, unnest(range(n)) AS i FROM planted),
equal AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM tok x JOIN tok y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
islands AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM equal) GROUP BY doc_id, q, g
  HAVING count(*) + q >= greatest(12, 2 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM islands GROUP BY doc_id, start, length),
gone AS (SELECT DISTINCT t.doc_id, t.i FROM tok t JOIN runs r ON r.doc_id = t.doc_id AND t.i >= r.start + r.period AND t.i < r.start + r.length),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM tok t ANTI JOIN gone g USING (doc_id, i) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_runs, first(struct_pack(s := start, l := length, p := period) ORDER BY length DESC, start, period) AS best,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS shown
  FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l::BIGINT AS length, best.p AS period,
       (1000 * best.l // best.p)::BIGINT AS exponent_milli, sha256(coalesce(shown, '')) AS runs_sha256,
       sha256(coalesce(words, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
