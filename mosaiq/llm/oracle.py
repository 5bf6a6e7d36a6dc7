"""The same results in SQL, written independently of the operators, for small tables.

p6_ids and p7_containers have none: no SQL engine here encodes text, and packing has no single right answer. p6_texts and
p7_checks tell what must hold of them.
"""

_TAG_SETS = """
tag_rows AS (SELECT DISTINCT id, lower(trim(part, chr(32) || chr(9) || chr(10) || chr(13))) AS tag
  FROM (SELECT id, unnest(string_split(e, ',')) AS part FROM (SELECT id, unnest(tags) AS e FROM {source}) WHERE e IS NOT NULL)),
tagged AS (SELECT id, tag FROM tag_rows WHERE tag <> '' AND id IS NOT NULL)
"""

_P3 = (
    "WITH "
    + _TAG_SETS.format(source="pins")
    + """,
total AS (SELECT count(DISTINCT id) AS n_sets FROM tagged),
single AS (SELECT tag, count(*) AS n FROM tagged GROUP BY tag),
both_ AS (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n_ab FROM tagged a JOIN tagged b ON a.id = b.id AND a.tag < b.tag GROUP BY a.tag, b.tag),
kept AS (SELECT tag_a, tag_b, x.n AS n_a, y.n AS n_b, n_ab, n_sets FROM both_, total, single x, single y
  WHERE x.tag = tag_a AND y.tag = tag_b AND n_ab >= 5 AND 400 * n_ab >= n_sets AND n_ab * n_sets >= 3 * x.n * y.n)
"""
)

_RANK = "CASE lower(trim(source)) WHEN 'upload' THEN 3 WHEN 'link' THEN 2 WHEN 'seed' THEN 1 ELSE 0 END"
_P5 = """
WITH v AS (SELECT DISTINCT *, {rank} AS trust, length(trim(description)) AS chars FROM pin_versions),
s AS (SELECT *, row_number() OVER (PARTITION BY pin_id ORDER BY trust DESC, created_at DESC NULLS LAST, version_id DESC) AS r FROM v),
w AS (SELECT *, row_number() OVER (PARTITION BY pin_id ORDER BY created_at DESC NULLS LAST, version_id DESC) AS r FROM v WHERE width > 0),
d AS (SELECT *, row_number() OVER (PARTITION BY pin_id ORDER BY chars DESC, created_at DESC NULLS LAST, version_id DESC) AS r FROM v WHERE chars > 0)
SELECT s.pin_id, {columns} FROM s LEFT JOIN w ON w.pin_id = s.pin_id AND w.r = 1 LEFT JOIN d ON d.pin_id = s.pin_id AND d.r = 1
WHERE s.r = 1 AND s.pin_id IS NOT NULL
"""

_WIDE = ("".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)))
_LETTERS = (
    "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝкΑΒΕΖΗΙΚΜΝΟΡΤΥΧογινραυκσχ",
    "ABESIJKMHOPCTYXaesijopcyxhdqwkABEZHIKMNOPTYXoyivpaukox",
)
_SPACES = "               　"

SQL = {
    "p1_found": """
WITH RECURSIVE ends AS (SELECT id_a AS x, id_b AS y FROM pin_matches WHERE id_a <> id_b AND distance BETWEEN 0 AND 10),
e AS (SELECT x, y FROM ends UNION SELECT y, x FROM ends),
r AS (SELECT x AS pin_id, x AS other FROM e UNION SELECT r.pin_id, e.y FROM r JOIN e ON e.x = r.other)
SELECT pin_id, min(other) AS group_id FROM r GROUP BY pin_id
""",
    "p2_found": "WITH both_tables AS (SELECT id, tags FROM pins UNION ALL SELECT id, tags FROM incoming_pins), "
    + _TAG_SETS.format(source="both_tables")
    + """,
sized AS (SELECT id, tag, count(*) OVER (PARTITION BY id) AS n FROM tagged)
SELECT a.id AS id_a, b.id AS id_b FROM sized a JOIN sized b ON a.tag = b.tag AND a.id < b.id
WHERE a.n >= 4 AND b.n >= 4 GROUP BY a.id, b.id, a.n, b.n HAVING 10 * count(*) >= 7 * (a.n + b.n - count(*))
""",
    "p3_found": _P3 + "SELECT tag_a, tag_b FROM kept",
    "p3_odds": _P3
    + """SELECT tag_a, tag_b, n_a, n_b, n_ab, n_sets, round(CAST(n_ab AS DOUBLE) * n_sets / (CAST(n_a AS DOUBLE) * n_b), 6) AS lift,
round((n_ab + 0.5::DOUBLE) * (n_sets - n_a - n_b + n_ab + 0.5::DOUBLE) / ((n_a - n_ab + 0.5::DOUBLE) * (n_b - n_ab + 0.5::DOUBLE)), 6) AS odds_ratio FROM kept""",
    "p4_found": """
WITH RECURSIVE rows_ AS (SELECT DISTINCT arrival_id, phash, author_id, created_at FROM incoming_pins),
numbered AS (SELECT arrival_id, author_id, created_at, row_number() OVER (ORDER BY arrival_id) AS k,
  CASE WHEN regexp_full_match(phash, '[0-9a-f]{16}') THEN CAST('0x' || phash AS UBIGINT) END AS h FROM rows_),
old AS (SELECT DISTINCT author_id, created_at, CASE WHEN regexp_full_match(phash, '[0-9a-f]{16}') THEN CAST('0x' || phash AS UBIGINT) END AS h FROM pins),
seen AS (SELECT k FROM numbered n WHERE EXISTS (SELECT 1 FROM old o WHERE bit_count(xor(o.h, n.h)) <= 10)
  OR EXISTS (SELECT 1 FROM old o WHERE o.author_id = n.author_id AND o.created_at = n.created_at)),
near AS (SELECT x.k, y.k AS earlier FROM numbered x JOIN numbered y ON y.k < x.k
  AND (bit_count(xor(x.h, y.h)) <= 10 OR (x.author_id = y.author_id AND x.created_at = y.created_at))),
around AS (SELECT n.k, coalesce(list(e.earlier) FILTER (e.earlier IS NOT NULL), []) AS earlier, bool_or(s.k IS NOT NULL) AS seen
  FROM numbered n LEFT JOIN near e ON e.k = n.k LEFT JOIN seen s ON s.k = n.k GROUP BY n.k),
r AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS accepted UNION ALL
  SELECT a.k, CASE WHEN a.seen OR list_has_any(r.accepted, a.earlier) THEN r.accepted ELSE list_append(r.accepted, a.k) END
  FROM r JOIN around a ON a.k = r.k + 1),
last_ AS (SELECT accepted FROM r ORDER BY k DESC LIMIT 1)
SELECT arrival_id FROM numbered, last_ WHERE NOT list_contains(accepted, k)
""",
    "p5_found": _P5.format(rank=_RANK, columns="s.version_id AS source_version, w.version_id AS width_version, d.version_id AS description_version"),
    "p5_survivors": _P5.format(rank=_RANK, columns="s.source, w.width, d.description"),
    "p6_texts": "SELECT DISTINCT doc_id, md5(coalesce(text, '')) AS digest FROM documents WHERE doc_id IS NOT NULL",
    "p7_checks": "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS badly_cut, 0::BIGINT AS overfull, 0::BIGINT AS gaps FROM documents WHERE doc_id IS NOT NULL AND text <> ''",
    "p8_found": f"""
WITH t AS (SELECT doc_id, text, nfc_normalize(text) AS c FROM documents WHERE text IS NOT NULL),
plain AS (SELECT doc_id, text, regexp_replace(translate(translate(replace(replace(replace(replace(replace(c, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'),
  '{_WIDE[0].replace("'", "''")}', '{_WIDE[1].replace("'", "''")}'), '{_LETTERS[0]}', '{_LETTERS[1]}'), '[\\x{{200b}}-\\x{{200f}}\\x{{2060}}-\\x{{2064}}\\x{{feff}}\\x{{ad}}\\x{{fe00}}-\\x{{fe0f}}\\x{{202a}}-\\x{{202e}}]', '', 'g') AS c FROM t),
shape AS (SELECT doc_id, text, nfc_normalize(translate(c, '{_SPACES}', '{" " * len(_SPACES)}')) AS c FROM plain),
seen AS (SELECT * FROM shape WHERE regexp_matches(c, '\\S'))
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM seen a JOIN seen b ON a.c = b.c AND a.doc_id < b.doc_id AND a.text <> b.text
""",
}
