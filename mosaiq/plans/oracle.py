"""The queries of plans.queries in SQL, written apart from the operators. Queries not here are iterative per image or streams."""

from __future__ import annotations

from mosaiq.functions.color import FAMILIES, HUES, TO_XYZ, WHITE, families_near
from mosaiq.functions.text import STOP_WORDS
from mosaiq.operators.paging import decode_cursor
from mosaiq.plans.fixtures import AUTHOR, NOW

P = "p AS (SELECT DISTINCT * FROM pins)"
S = "s AS (SELECT DISTINCT user_id, pin_id FROM saves WHERE user_id IS NOT NULL AND pin_id IS NOT NULL)"
C = "c AS (SELECT DISTINCT * FROM comments)"
PSC = f"{P}, {S}, {C}"
SUBJECT = "subject AS (SELECT pin_id AS sid FROM s WHERE pin_id IN (SELECT id FROM p) GROUP BY pin_id ORDER BY count(*) DESC, pin_id LIMIT 1)"
VISIBLE = "visibility = 'public'"
MINE = f"({VISIBLE} OR author_id = '{AUTHOR}')"
PV, PM = f"p AS (SELECT DISTINCT * FROM pins WHERE {VISIBLE})", f"p AS (SELECT DISTINCT * FROM pins WHERE {MINE})"
MS = "epoch_ms(created_at)"
DOC = "(coalesce(title, '') || ' ' || coalesce(description, ''))"


def tokens(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""list_transform(list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains([{stop}], w)),
  lambda w: CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN w[:-4] || 'y' WHEN length(w) > 4 AND w LIKE '%es' THEN w[:-3] WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END)"""


HASHES = """raw AS (SELECT vec_id AS id, label, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings),
med AS (SELECT id, label, e, list_sort(e[2:64])[32] AS m FROM raw),
bits AS (SELECT id, label, unnest(e) > m AS bit, generate_subscripts(e, 1) AS i FROM med),
hashes AS (SELECT id, label, bit_or(CASE WHEN bit THEN 1::UBIGINT << (64 - i)::UBIGINT ELSE 0::UBIGINT END) AS h FROM bits GROUP BY id, label)"""
PIN_HASHES = f"{PM}, hashes AS (SELECT id, CAST('0x' || phash AS UBIGINT) AS h FROM p WHERE regexp_full_match(phash, '[0-9a-f]{{16}}'))"
VERDICT = "CASE WHEN distance <= 4 THEN 'identical' WHEN distance <= 10 THEN 'near-duplicate' ELSE 'distinct' END"


def pairs(hashes: str, t: int) -> str:
    return f"{hashes}, pairs AS (SELECT x.id AS a, y.id AS b, bit_count(xor(x.h, y.h))::INT AS distance FROM hashes x JOIN hashes y ON x.id < y.id AND bit_count(xor(x.h, y.h)) <= {t})"


def groups(hashes: str, t: int) -> str:
    return f"""{pairs(hashes, t)}, e AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT x AS id, x AS other FROM e UNION SELECT reach.id, e.y FROM reach JOIN e ON e.x = reach.other),
member AS (SELECT id, min(other) AS group_id FROM reach GROUP BY id),
wide AS (SELECT m.group_id, max(bit_count(xor(hx.h, hy.h)))::INT AS max_distance FROM member m JOIN member n ON n.group_id = m.group_id JOIN hashes hx ON hx.id = m.id JOIN hashes hy ON hy.id = n.id GROUP BY m.group_id),
sized AS (SELECT group_id, count(*) AS size FROM member GROUP BY group_id)"""


def engaged(pins: str) -> str:
    return f"""{pins}, {S}, {C}, sc AS (SELECT pin_id, count(*) AS n FROM s GROUP BY pin_id), cc AS (SELECT pin_id, count(*) AS n FROM c GROUP BY pin_id),
engaged AS (SELECT p.*, coalesce(sc.n, 0) AS saves, coalesce(cc.n, 0) AS comments, 3 * coalesce(sc.n, 0) + coalesce(cc.n, 0) AS score
  FROM p LEFT JOIN sc ON sc.pin_id = p.id LEFT JOIN cc ON cc.pin_id = p.id)"""


def popular(days: int | None) -> str:
    where = f"WHERE {MS} >= {NOW - days * 86_400_000}" if days else ""
    return f"WITH {engaged(PV)} SELECT row_number() OVER (ORDER BY score DESC, created_at DESC, id DESC) AS rank, id, saves, comments, score FROM engaged {where} ORDER BY rank LIMIT 500"


def cosine(words: str, subject: str) -> str:
    """Relations `words` (id, words) given: scored (id, score)."""
    return f"""words AS ({words}), total AS (SELECT count(*) AS n FROM words),
occ AS (SELECT id, len(words) AS len, unnest(words) AS term FROM words), tf AS (SELECT id, term, len, count(*) AS k FROM occ GROUP BY id, term, len),
df AS (SELECT term, ln((any_value(n) + 1.0::DOUBLE) / (count(*) + 1)) + 1 AS idf FROM tf, total GROUP BY term),
w AS (SELECT id, tf.term, k::DOUBLE / len * idf AS w FROM tf JOIN df ON df.term = tf.term),
norms AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY id),
dots AS (SELECT b.id, sum(a.w * b.w) AS dot FROM w a JOIN w b ON a.term = b.term AND a.id = {subject} AND b.id <> {subject} GROUP BY b.id),
content AS (SELECT d.id, dot / (x.norm * y.norm) AS score FROM dots d JOIN norms x ON x.id = d.id JOIN norms y ON y.id = {subject})"""


PIN_WORDS = f"SELECT id, {tokens(DOC)} AS words FROM p"
SID = "(SELECT sid FROM subject)"
JACCARD = """mine AS (SELECT user_id FROM s, subject WHERE pin_id = sid),
collab AS (SELECT s.pin_id AS id, count(m.user_id) AS shared, count(m.user_id)::DOUBLE / (count(*) + (SELECT count(*) FROM mine) - count(m.user_id)) AS score
  FROM s LEFT JOIN mine m ON m.user_id = s.user_id WHERE s.pin_id <> (SELECT sid FROM subject) GROUP BY s.pin_id HAVING count(m.user_id) > 0)"""
HYBRID = f"""WITH {PM}, {S}, {SUBJECT}, {cosine(PIN_WORDS, SID)}, {JACCARD}, sc AS (SELECT pin_id, count(*) AS n FROM s GROUP BY pin_id),
raw AS (SELECT p.id, created_at, coalesce(content.score, 0) AS c, coalesce(collab.score, 0) AS k, coalesce(sc.n, 0)::DOUBLE / (coalesce(sc.n, 0) + 5) AS pop,
  power(0.5::DOUBLE, greatest(0.0::DOUBLE, ({NOW} - {MS}) / 86400000.0::DOUBLE) / 30) AS r
  FROM p LEFT JOIN content ON content.id = p.id LEFT JOIN collab ON collab.id = p.id LEFT JOIN sc ON sc.pin_id = p.id WHERE p.id <> {SID}),
top AS (SELECT max(c) AS mc, max(k) AS mk, max(pop) AS mp, max(r) AS mr FROM raw),
scored AS (SELECT id, created_at, CASE WHEN mk > 0 THEN 0.45::DOUBLE ELSE 0.8::DOUBLE END * CASE WHEN mc > 0 THEN c / mc ELSE 0 END + 0.35::DOUBLE * CASE WHEN mk > 0 THEN k / mk ELSE 0 END
  + 0.1::DOUBLE * CASE WHEN mp > 0 THEN pop / mp ELSE 0 END + 0.1::DOUBLE * CASE WHEN mr > 0 THEN r / mr ELSE 0 END AS score FROM raw, top)
SELECT id, round(score, 6) AS score FROM scored WHERE score > 0 ORDER BY round(score, 9) DESC, created_at DESC, id DESC LIMIT 12"""

SWATCHES = "swatches AS (SELECT id, pos, " + ", ".join(f"CAST(least(255, greatest(0, floor(128 + 400 * e[3 * pos + {i}]::DOUBLE))) AS INT) AS {n}" for i, n in ((1, "r"), (2, "g"), (3, "b"))) + ", (5 - pos) / 15.0::DOUBLE AS share FROM (SELECT vec_id AS id, embedding AS e, unnest(range(0, 5)) AS pos FROM embeddings))"


def linear(c: str) -> str:
    return f"CASE WHEN {c} / 255.0::DOUBLE <= 0.04045::DOUBLE THEN {c} / 255.0::DOUBLE / 12.92::DOUBLE ELSE power(({c} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"


def lab(source: str, name: str) -> str:
    """Relations: `name` is source with lr, lg, lb, l, a, b_star."""
    d = lambda x: f"{x!r}::DOUBLE"
    xyz = ", ".join(f"({d(k[0])} * lr + {d(k[1])} * lg + {d(k[2])} * lb) / {d(w)} AS t{i}" for i, (k, w) in enumerate(zip(TO_XYZ, WHITE, strict=True)))
    curve = ", ".join(f"CASE WHEN t{i} > {d(216 / 24389)} THEN cbrt(t{i}) ELSE {d(24389 / 27 / 116)} * t{i} + {d(4 / 29)} END AS f{i}" for i in range(3))
    return f"""{name}_1 AS (SELECT *, {linear("r")} AS lr, {linear("g")} AS lg, {linear("b")} AS lb FROM {source}), {name}_2 AS (SELECT *, {xyz} FROM {name}_1), {name}_3 AS (SELECT *, {curve} FROM {name}_2),
{name} AS (SELECT *, 116 * f1 - 16 AS l, 500 * (f0 - f1) AS a, 200 * (f1 - f2) AS b_star FROM {name}_3)"""


HEX = "'#' || lower(lpad(to_hex(r), 2, '0') || lpad(to_hex(g), 2, '0') || lpad(to_hex(b), 2, '0'))"
HSV = """hsv_1 AS (SELECT *, greatest(r, g, b) / 255.0::DOUBLE AS top, least(r, g, b) / 255.0::DOUBLE AS low FROM {source}),
hsv_2 AS (SELECT *, top - low AS span, CASE WHEN top = low THEN 0.0::DOUBLE WHEN r = greatest(r, g, b) THEN ((g / 255.0::DOUBLE - b / 255.0::DOUBLE) / (top - low)) * 60
  WHEN g = greatest(r, g, b) THEN ((b / 255.0::DOUBLE - r / 255.0::DOUBLE) / (top - low) + 2) * 60 ELSE ((r / 255.0::DOUBLE - g / 255.0::DOUBLE) / (top - low) + 4) * 60 END AS hh FROM hsv_1),
hsv AS (SELECT *, CASE WHEN hh < 0 THEN hh + 360 ELSE hh END AS hue, CASE WHEN top = 0 THEN 0.0::DOUBLE ELSE span / top END AS saturation, top AS value FROM hsv_2)"""
FAMILY = "CASE WHEN saturation < 0.15 OR value < 0.12 THEN 'neutral' " + " ".join(f"WHEN hue < {end} THEN '{name}'" for name, end in HUES) + " ELSE 'red' END"
TEAL = "SELECT 20 AS r, 160 AS g, 150 AS b"


def color_rank(families: list[str] | None) -> str:
    some = f", {HSV.format(source='swatches')}, chosen AS (SELECT * FROM swatches WHERE id IN (SELECT id FROM hsv WHERE {FAMILY} IN ({', '.join(repr(f) for f in families)})))" if families else ", chosen AS (SELECT * FROM swatches)"
    return f"""WITH {SWATCHES}{some}, target AS ({TEAL}), {lab("target", "tlab")}, {lab("chosen", "slab")},
deltas AS (SELECT s.id, s.pos, s.share, '#' || lower(lpad(to_hex(s.r), 2, '0') || lpad(to_hex(s.g), 2, '0') || lpad(to_hex(s.b), 2, '0')) AS hex,
  round(sqrt(power(s.l - t.l, 2) + power(s.a - t.a, 2) + power(s.b_star - t.b_star, 2)), 9) AS delta FROM slab s, tlab t),
scored AS (SELECT id, sum(CASE WHEN delta < 60 THEN share * (1 - delta / 60) ELSE 0 END) AS score FROM deltas GROUP BY id),
closest AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY delta, pos) AS n FROM deltas)
SELECT scored.id, round(score, 6) AS score, hex AS closest_hex, round(share, 6) AS closest_share, round(delta, 6) AS closest_delta
FROM scored JOIN closest ON closest.id = scored.id AND n = 1 WHERE score >= 0.04 ORDER BY round(scored.score, 9) DESC, scored.id LIMIT 60"""


DISTANCES = f"""{HASHES}, distances AS (SELECT x.label, x.label = y.label AS positive, bit_count(xor(x.h, y.h))::INT AS distance FROM hashes x JOIN hashes y ON y.id % 50 = 0 AND x.id <> y.id)"""
SWEEP = f"""{DISTANCES}, counts AS (SELECT threshold::INT AS threshold, count(*) FILTER (positive AND distance <= threshold) AS tp, count(*) FILTER (positive AND distance > threshold) AS fn,
  count(*) FILTER (NOT positive AND distance <= threshold) AS fp FROM distances, range(0, 65) AS r(threshold) GROUP BY threshold),
ratios AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1 ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 1 ELSE tp::DOUBLE / (tp + fn) END AS recall FROM counts),
sweep AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM ratios)"""
TAGGED = "tagged AS (SELECT p_partkey AS id, p_brand AS author, list_concat(string_split(p_name, ' '), [lower(p_brand), lower(p_type)]) AS tags, p_size * 10 AS width, (p_partkey % 7 + 1) * 50 AS height FROM part)"
IDF_TAGS = """t AS (SELECT DISTINCT id, unnest(tags) AS tag FROM tagged), n AS (SELECT count(*) AS n FROM tagged),
df AS (SELECT tag, ln((any_value(n.n) + 1.0::DOUBLE) / (count(*) + 1)) + 1 AS w FROM t, n GROUP BY tag), w AS (SELECT t.id, t.tag, df.w FROM t JOIN df ON df.tag = t.tag)"""
_AT = decode_cursor("MTcwOTI5NDQwMDAwMC5t")
SLUG = "regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g')"

_RULES = {
    "title_present": "title IS NOT NULL", "image_url_present": "image_url IS NOT NULL", "author_id_present": "author_id IS NOT NULL", "created_at_present": "created_at IS NOT NULL",
    "title_length": "title IS NULL OR length(title) BETWEEN 1 AND 200", "description_length": "description IS NULL OR length(description) <= 2000",
    "image_url_format": "image_url IS NULL OR regexp_matches(image_url, '^https?://')", "thumb_url_format": "thumb_url IS NULL OR regexp_matches(thumb_url, '^https?://')",
    "phash_format": "phash IS NULL OR regexp_full_match(phash, '[0-9a-f]{16}')", "source_known": "source IS NULL OR source IN ('seed', 'upload', 'link')", "visibility_known": "visibility IS NULL OR visibility IN ('public', 'private')",
    "provider_known": "provider IS NULL OR provider = 'pixabay'",
}
_UNITS = (("year", 31_536_000_000), ("month", 2_592_000_000), ("day", 86_400_000), ("hour", 3_600_000), ("minute", 60_000))


def _ago() -> str:
    out = "CASE"
    for unit, length in _UNITS:
        n = f"floor(({MS} - {NOW}) / {length}.0::DOUBLE + 0.5)::BIGINT"
        word = {"year": "last year", "month": "last month", "day": "yesterday"}.get(unit)
        nil = {"year": "this year", "month": "this month", "day": "today", "hour": "this hour", "minute": "this minute"}[unit]
        special = f"WHEN {n} = 0 THEN '{nil}' " + (f"WHEN {n} = -1 THEN '{word}' " if word else f"WHEN {n} = -1 THEN '1 {unit} ago' ")
        out += f" WHEN abs({MS} - {NOW}) >= {length} THEN CASE {special} ELSE abs({n}) || ' {unit}s ago' END"
    return out + " ELSE 'just now' END"


def _b64(text: str) -> str:
    """Base64 for addresses, without filling."""
    return f"replace(replace(rtrim(to_base64(encode({text})), '='), '+', '-'), '/', '_')"


# the pictures of fixtures.images and their hashes: a cosine transform to 32 x 32 and back to the first 8 x 8
_PICTURES = """basis AS (SELECT u, x, cos((2 * x + 1) * u * pi() / 64) * CASE WHEN u = 0 THEN sqrt(1 / 32.0::DOUBLE) ELSE sqrt(2 / 32.0::DOUBLE) END AS c FROM range(8) AS a(u), range(32) AS b(x)),
v AS (SELECT vec_id AS id, k // 8 AS u, k % 8 AS v, embedding[k + 1]::DOUBLE AS e FROM embeddings, range(64) AS r(k)),
rows_ AS (SELECT id, b.x AS y, v, sum(c * e) AS t FROM v JOIN basis b ON b.u = v.u GROUP BY id, b.x, v),
gray AS (SELECT id, y, b.x, greatest(0, least(255, 128 + 400 * sum(c * t))) AS g FROM rows_ JOIN basis b ON b.u = v GROUP BY id, y, b.x),
back AS (SELECT id, b.u, gray.x, sum(c * g) AS t FROM gray JOIN basis b ON b.x = y GROUP BY id, b.u, gray.x),
block AS (SELECT id, back.u * 8 + b.u AS k, sum(c * t) AS w FROM back JOIN basis b ON b.x = back.x GROUP BY id, back.u * 8 + b.u),
mid AS (SELECT id, quantile_disc(w, 0.5) FILTER (k > 0) AS m FROM block GROUP BY id),
hashed AS (SELECT block.id, format('{:016x}', bit_or(CASE WHEN w > m THEN 1::UBIGINT << (63 - k)::UBIGINT ELSE 0::UBIGINT END)) AS phash FROM block JOIN mid ON mid.id = block.id GROUP BY block.id)"""

SQL: dict[str, str] = {
    "near_duplicate_pairs": f"WITH {pairs(HASHES, 18)} SELECT a, b, distance, {VERDICT} AS verdict FROM pairs",
    "pin_duplicate_pairs": f"WITH {pairs(PIN_HASHES, 10)} SELECT a, b, distance, {VERDICT} AS verdict FROM pairs",
    "near_duplicates_of": f"WITH {PIN_HASHES}, probe AS (SELECT h AS ph FROM hashes GROUP BY h ORDER BY count(*) DESC, h LIMIT 1), d AS (SELECT id, bit_count(xor(h, ph))::INT AS distance FROM hashes, probe) SELECT id, distance, {VERDICT} AS verdict FROM d WHERE distance <= 20 ORDER BY distance, id LIMIT 50",
    "duplicate_guard": f"WITH {PIN_HASHES}, probe AS (SELECT h AS ph FROM hashes ORDER BY id LIMIT 1), d AS (SELECT hashes.id, bit_count(xor(h, ph))::INT AS distance FROM hashes JOIN p ON p.id = hashes.id, probe WHERE {MINE}) SELECT distance, {VERDICT} AS verdict FROM d WHERE distance <= 10 ORDER BY distance, id LIMIT 1",
    "duplicate_clusters": f"WITH RECURSIVE {groups(HASHES, 18)} SELECT m.group_id, m.id, size, max_distance FROM member m JOIN wide w ON w.group_id = m.group_id JOIN sized z ON z.group_id = m.group_id",
    "pin_duplicate_groups": f"WITH RECURSIVE {groups(PIN_HASHES, 10)} SELECT m.group_id, m.id, size, max_distance FROM member m JOIN wide w ON w.group_id = m.group_id JOIN sized z ON z.group_id = m.group_id",
    "cluster_width": f"WITH RECURSIVE {groups(HASHES, 18)} SELECT w.group_id, size, max_distance FROM wide w JOIN sized z ON z.group_id = w.group_id",
    "feed_page": f"WITH {P} SELECT id, {MS} AS created_ms FROM p WHERE {VISIBLE} ORDER BY created_at DESC, id DESC LIMIT 24",
    "feed_page_after_cursor": f"WITH {P} SELECT id, {MS} AS created_ms, author_id FROM p WHERE {MINE} AND ({MS} < {_AT[0]} OR ({MS} = {_AT[0]} AND id < '{_AT[1]}')) ORDER BY created_at DESC, id DESC LIMIT 50",
    "author_board": f"WITH {P} SELECT id, {MS} AS created_ms FROM p WHERE author_id = '{AUTHOR}' ORDER BY created_at DESC, id DESC LIMIT 500",
    "board_oldest_first": f"WITH {P} SELECT id, title FROM p WHERE author_id = '{AUTHOR}' ORDER BY created_at DESC, id DESC LIMIT 100",
    "board_by_title": f"WITH {P} SELECT id, title FROM p WHERE author_id = '{AUTHOR}' ORDER BY created_at DESC, id DESC LIMIT 100",
    "feed_union": f"WITH {P} SELECT 0 AS phase, 'pin:' || id AS key, 'pin' AS kind, id FROM p WHERE {VISIBLE} UNION ALL SELECT 1, 'px:' || p_partkey, 'result', CAST(p_partkey AS VARCHAR) FROM part",
    "orders_keyset_page": "SELECT o_orderkey AS id, epoch_ms(o_orderdate) AS created_ms FROM orders WHERE epoch_ms(o_orderdate) < 820454400000 OR (epoch_ms(o_orderdate) = 820454400000 AND o_orderkey < 500) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100",
    "visible_pins": f"WITH {P} SELECT id FROM p WHERE {MINE}",
    "pins_by_ids": f"WITH {P}, {S} SELECT id, {MS} AS created_ms FROM p WHERE {VISIBLE} AND id IN (SELECT pin_id FROM s WHERE user_id = '{AUTHOR}') ORDER BY created_at DESC, id DESC LIMIT 500",
    "pin_view": f"WITH {P} SELECT id, title, {MS} AS created_at, epoch_ms(analyzed_at) AS analyzed_at, coalesce(source, CASE WHEN coalesce(public_id, '') <> '' THEN 'upload' ELSE 'link' END) AS source, coalesce(visibility, 'public') AS visibility FROM p",
    "unanalysed_batch": f"WITH {P} SELECT id, {MS} AS created_ms FROM p WHERE analyzed_at IS NULL ORDER BY created_at, id LIMIT 25",
    "pin_hash_list": f"WITH {P} SELECT id, phash, title, image_url FROM p WHERE {VISIBLE} AND phash IS NOT NULL ORDER BY id LIMIT 500",
    "analysis_coverage": f"WITH {P} SELECT count(*) AS total, count(phash) AS analyzed, round(CASE WHEN count(*) = 0 THEN 1 ELSE count(phash)::DOUBLE / count(*) END, 6) AS coverage FROM p WHERE {MINE}",
    "pin_counts": f"WITH {P} SELECT count(*) AS pins, 'public' AS scope FROM p WHERE {VISIBLE} UNION ALL SELECT count(*), 'author' FROM p WHERE author_id = '{AUTHOR}'",
    "private_count": f"WITH {P}, b AS (SELECT * FROM p WHERE author_id = '{AUTHOR}' ORDER BY created_at DESC, id DESC LIMIT 100) SELECT count(*) FILTER (visibility = 'private') AS private_pins FROM b",
    "saved_flags": f"WITH {P}, {S} SELECT id, id IN (SELECT pin_id FROM s WHERE user_id = '{AUTHOR}') AS saved FROM p",
    "tags_overlap": f"WITH {P} SELECT id, len(list_distinct(list_intersect(tags, ['photo', 'nature', 'lake', 'ocean'])))::INT AS overlap FROM p WHERE {VISIBLE} AND list_has_any(tags, ['photo', 'nature', 'lake', 'ocean']) ORDER BY overlap DESC, created_at DESC, id DESC LIMIT 50",
    "text_search": f"""WITH {P}, t AS (SELECT *, 5 * len(list_filter({tokens("title")}, lambda w: w IN ('lighthous', 'near', 'harbour') AND w <> 'near')) + len(list_filter({tokens("coalesce(description, '')")}, lambda w: w IN ('lighthous', 'harbour'))) AS score FROM p WHERE {VISIBLE})
SELECT id, score::INT AS score FROM t WHERE score > 0 ORDER BY score DESC, created_at DESC, id DESC LIMIT 60""",
    "discover_search": f"WITH {PV}, t AS (SELECT id, {tokens(DOC)} AS w FROM p) SELECT id FROM t WHERE len(list_filter(w, lambda x: starts_with(x, 'light'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'walk'))) > 0",
    "discover_search_plain": f"WITH {PV} SELECT id FROM p WHERE contains(lower({DOC}), 'at')",
    "popular_week": popular(7),
    "popular_month": popular(30),
    "popular_all": popular(None),
    "leaderboard_totals": f"WITH {engaged(PV)} SELECT coalesce(sum(saves), 0)::BIGINT AS saves, coalesce(sum(comments), 0)::BIGINT AS comments FROM engaged WHERE {MS} >= {NOW - 30 * 86_400_000}",
    "top_pins": f"WITH {engaged(PM)} SELECT id, saves, comments, score FROM engaged WHERE author_id = '{AUTHOR}' AND score > 0 ORDER BY score DESC, created_at DESC, id DESC LIMIT 5",
    "save_counts": f"WITH {S} SELECT pin_id, count(*) AS saves FROM s GROUP BY pin_id",
    "comment_counts": f"WITH {C} SELECT pin_id, count(*) AS comments FROM c GROUP BY pin_id",
    "comment_counts_by_author": f"WITH {C} SELECT author_id, count(*) AS comments FROM c GROUP BY author_id",
    "comment_thread": f"WITH {PM}, {S}, {C}, {SUBJECT} SELECT c.id, body, coalesce(u.name, c.author, 'Someone') AS author, author_id FROM c LEFT JOIN users u ON u.id = c.author_id WHERE pin_id = {SID}",
    "content_related": f"WITH {PM}, {S}, {SUBJECT}, {cosine(PIN_WORDS, SID)} SELECT p.id, round(score, 6) AS score FROM content JOIN p ON p.id = content.id WHERE score > 0 ORDER BY round(content.score, 9) DESC, created_at DESC, p.id DESC LIMIT 12",

    "content_reasons": f"""WITH {PM}, {S}, {SUBJECT}, {cosine(PIN_WORDS, SID)}, firsts AS (SELECT id, term, min(i) AS pos FROM (SELECT id, unnest(words) AS term, generate_subscripts(words, 1) AS i FROM words) GROUP BY id, term),
size AS (SELECT id, count(*) AS n FROM tf GROUP BY id),
part AS (SELECT b.id, b.term, round(a.w * b.w, 12) AS c, CASE WHEN (SELECT n FROM size WHERE id = {SID}) <= (SELECT n FROM size WHERE size.id = b.id) THEN x.pos ELSE y.pos END AS place
  FROM w a JOIN w b ON a.term = b.term AND a.id = {SID} AND b.id <> {SID} JOIN firsts x ON x.id = a.id AND x.term = a.term JOIN firsts y ON y.id = b.id AND y.term = b.term),
best AS (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY c DESC, place) AS k FROM part)
SELECT p.id, round(coalesce(score, 0), 6) AS score, coalesce('Both about “' || term || '”', 'Loosely related') AS reason FROM p LEFT JOIN content ON content.id = p.id LEFT JOIN best ON best.id = p.id AND k = 1 WHERE p.id <> {SID}""",
    "collaborative_related": f"WITH {PM}, {S}, {SUBJECT}, {JACCARD} SELECT p.id, round(score, 6) AS score, shared || CASE WHEN shared = 1 THEN ' person' ELSE ' people' END || ' saved both' AS reason FROM collab JOIN p ON p.id = collab.id ORDER BY round(collab.score, 9) DESC, created_at DESC, p.id DESC LIMIT 30",
    "hybrid_related": HYBRID,
    "similar_items_capped": f"""WITH {TAGGED}, {cosine("SELECT id, " + tokens("array_to_string(tags, ' ')") + " AS words FROM tagged", "1")}, one AS (SELECT * FROM tagged WHERE id = 1),
raised AS (SELECT t.id, t.author, coalesce(c.score, 0) * (1 + 0.15::DOUBLE * CASE WHEN t.width > 0 AND t.height > 0 AND one.width > 0 AND one.height > 0 THEN greatest(0.0::DOUBLE, 1 - abs(ln((t.width::DOUBLE / t.height) / (one.width::DOUBLE / one.height)))) ELSE 0.0::DOUBLE END
  + 0.1::DOUBLE * CASE WHEN t.author = one.author THEN 1 ELSE 0 END) AS score FROM tagged t LEFT JOIN content c ON c.id = t.id, one WHERE t.id <> 1),
kept AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY round(score, 9) DESC, id % 3, id) AS nth FROM raised WHERE score > 0.02)
SELECT id, author, round(score, 6) AS score FROM kept WHERE nth <= 3 ORDER BY round(kept.score, 9) DESC, id % 3, id LIMIT 24""",
    "tag_overlap_related": f"""WITH {TAGGED}, {IDF_TAGS}, mine AS (SELECT tag FROM w WHERE id = 1), r AS (SELECT id, sum(w) AS own, sum(CASE WHEN tag IN (SELECT tag FROM mine) THEN w END) AS both_ FROM w WHERE id <> 1 GROUP BY id)
SELECT id, round(both_ / (own + (SELECT sum(w) FROM w WHERE id = 1) - both_), 6) AS score FROM r WHERE both_ > 0 ORDER BY score DESC, id LIMIT 100""",
    "discover_topics": f"""WITH {PV}, t AS (SELECT DISTINCT id, unnest({tokens(DOC)}) AS term FROM p), n AS (SELECT count(*) AS n FROM p), f AS (SELECT term, count(*) AS df FROM t GROUP BY term)
SELECT term, df, round(df * (ln((n + 1.0::DOUBLE) / (df + 1)) + 1), 6) AS weight FROM f, n WHERE df >= 2 AND df <= greatest(2, floor(n * 0.5)) ORDER BY df * (ln((n + 1.0::DOUBLE) / (df + 1)) + 1) DESC, term LIMIT 10""",
    "board_keywords": f"WITH {P}, t AS (SELECT DISTINCT id, unnest({tokens(DOC)}) AS term FROM p WHERE author_id = '{AUTHOR}') SELECT term, count(*) AS df FROM t WHERE length(term) >= 4 GROUP BY term ORDER BY df DESC, term LIMIT 3",
    "document_frequencies": f"WITH {PV}, t AS (SELECT DISTINCT id, unnest({tokens(DOC)}) AS term FROM p) SELECT term, count(*) AS df FROM t GROUP BY term",
    "color_rank": color_rank(None),
    "color_rank_prefiltered": color_rank(families_near(20, 160, 150)),
    "color_family_slices": f"""WITH {SWATCHES}, {HSV.format(source="swatches")}, f AS (SELECT *, {FAMILY} AS family FROM hsv), labels(family, label, swatch) AS (VALUES {", ".join(str(x) for x in FAMILIES)})
SELECT f.family, label, swatch, count(DISTINCT id) AS pins, round(sum(share) / (SELECT count(DISTINCT id) FROM swatches), 6) AS weight FROM f JOIN labels ON labels.family = f.family GROUP BY f.family, label, swatch""",
    "palette_lab": f"""WITH {SWATCHES}, {lab("swatches", "slab")}, {HSV.format(source="slab")}, lum AS (SELECT *, 0.2126::DOUBLE * lr + 0.7152::DOUBLE * lg + 0.0722::DOUBLE * lb AS luminance FROM hsv)
SELECT id, pos::INT AS pos, {HEX} AS hex, round(l, 6) AS l, round(a, 6) AS a, round(b_star, 6) AS b_star, round(hue, 6) AS hue, round(saturation, 6) AS saturation, round(value, 6) AS value,
  round(luminance, 6) AS luminance, CASE WHEN luminance > 0.179 THEN '#000000' ELSE '#ffffff' END AS "on", {FAMILY} AS family FROM lum""",
    "palette_drift": f"""WITH {SWATCHES}, other AS (SELECT id, pos, least(255, r + 7) AS r, g, b FROM swatches), {lab("swatches", "x")}, {lab("other", "y")},
near AS (SELECT x.id, x.pos, min(sqrt(power(x.l - y.l, 2) + power(x.a - y.a, 2) + power(x.b_star - y.b_star, 2))) AS d FROM x JOIN y ON y.id = x.id GROUP BY x.id, x.pos) SELECT id, round(max(d), 6) AS drift FROM near GROUP BY id""",
    "pins_with_palette": f"WITH {P} SELECT id, {MS} AS created_ms FROM p WHERE {MINE} AND length(id) % 3 = 0 ORDER BY created_at DESC, id DESC LIMIT 100",
    "activity_14d": f"WITH {P}, days AS (SELECT CAST(d AS DATE) AS day FROM unnest(generate_series(DATE '2024-12-18', DATE '2024-12-31', INTERVAL 1 DAY)) AS g(d)) SELECT CAST(day AS VARCHAR) AS day, count(id) AS pins FROM days LEFT JOIN p ON CAST(created_at AS DATE) = day GROUP BY day",
    "board_counts": f"WITH {PSC} SELECT (SELECT count(*) FROM p WHERE author_id = '{AUTHOR}') AS mine, (SELECT count(*) FROM s WHERE user_id = '{AUTHOR}') AS saved, (SELECT count(*) FROM c WHERE pin_id IN (SELECT id FROM p WHERE author_id = '{AUTHOR}')) AS comments",
    "duplicate_counts": f"WITH RECURSIVE {groups(PIN_HASHES, 10)} SELECT count(DISTINCT group_id) AS duplicate_groups, count(*) AS duplicate_pins FROM member",
    "threshold_sweep": f"WITH {SWEEP} SELECT threshold, tp, fn, fp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM sweep",
    "best_threshold": f"WITH {SWEEP} SELECT threshold, round(f1, 6) AS f1 FROM sweep ORDER BY round(sweep.f1, 12) DESC, threshold LIMIT 1",
    "last_perfect_precision": f"WITH {SWEEP} SELECT coalesce(max(CASE WHEN fp = 0 THEN threshold END), min(threshold)) AS threshold FROM sweep",
    "edit_stats": f"""WITH {DISTANCES}, l AS (SELECT label, list_sort(list(distance)) AS v FROM distances WHERE positive GROUP BY label)
SELECT label, v[1] AS min, v[len(v)] AS max, len(list_filter(v, lambda x: x <= 18)) AS caught, len(v) AS total, v[len(v) // 2 + 1] AS median FROM l""",
    "distance_percentiles": f"""WITH {DISTANCES}, l AS (SELECT positive, list_sort(list(distance)) AS v FROM distances GROUP BY positive)
SELECT positive, p, v[least(len(v) - 1, CAST(floor(len(v) * p) AS BIGINT)) + 1] AS distance FROM l, (VALUES (0.05::DOUBLE), (0.5::DOUBLE), (0.95::DOUBLE)) AS q(p)""",
    "insert_if_absent": f"WITH {P} SELECT author_id, provider, provider_id FROM p WHERE provider_id IS NOT NULL UNION ALL SELECT DISTINCT author_id, provider, provider_id FROM incoming_pins i WHERE provider_id IS NOT NULL AND author_id IS NOT NULL AND provider IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p WHERE p.author_id = i.author_id AND p.provider = i.provider AND p.provider_id = i.provider_id) UNION ALL SELECT author_id, provider, provider_id FROM incoming_pins WHERE provider_id IS NOT NULL AND (author_id IS NULL OR provider IS NULL)",
    "upsert_by_id": f"WITH {P} SELECT id, CASE WHEN length(id) % 3 = 0 THEN upper(title) ELSE title END AS title FROM p UNION ALL SELECT 'new-pin', 'New'",
    "set_analysis": f"WITH {P} SELECT id, CASE WHEN analyzed_at IS NULL THEN '00ff00ff00ff00ff' ELSE phash END AS phash, CASE WHEN analyzed_at IS NULL THEN 'red' ELSE '' END AS families, epoch_ms(coalesce(analyzed_at, TIMESTAMP '2025-01-01 00:00:00')) AS analyzed_ms FROM p",
    "set_visibility": f"WITH {P} SELECT id, CASE WHEN id = (SELECT min(id) FROM p WHERE author_id = '{AUTHOR}') THEN 'private' ELSE visibility END AS visibility FROM p",
    "backfill_visibility": f"WITH {P} SELECT coalesce(visibility, 'public') AS visibility, count(*) AS pins FROM p GROUP BY coalesce(visibility, 'public')",
    "cascade_delete": f"""WITH {PSC}, gone AS (SELECT id FROM p WHERE author_id = '{AUTHOR}') SELECT count(*) AS "left", 'pins' AS part FROM p WHERE id NOT IN (FROM gone) UNION ALL SELECT count(*), 'saves' FROM s WHERE pin_id NOT IN (FROM gone)
UNION ALL SELECT count(*), 'comments' FROM c WHERE pin_id NOT IN (FROM gone) UNION ALL SELECT count(*), 'assets' FROM p WHERE id IN (FROM gone) AND source = 'upload' AND public_id IS NOT NULL""",
    "toggle_saves": f"WITH {S} SELECT user_id, pin_id FROM s WHERE length(pin_id) % 2 = 1 UNION ALL SELECT user_id, pin_id || '-x' FROM s",
    "validate_pins": f"WITH {P} SELECT id, concat_ws(',', {', '.join(f'''CASE WHEN NOT ({r}) THEN '{n}' END''' for n, r in _RULES.items())}) AS broken FROM p",
    "text_functions": f"""WITH {P}, t AS (SELECT *, length({DOC}) * 9973 AS n, trim({SLUG.format("description")}, '-') AS f FROM p)
SELECT id, array_to_string({tokens(DOC)}, ' ') AS tokens, CASE WHEN left(trim({SLUG.format("title")}, '-'), 48) = '' THEN 'pin' ELSE left(trim({SLUG.format("title")}, '-'), 48) END || '-abc123' AS slug,
  CASE WHEN coalesce(f, '') = '' THEN 'image' ELSE left(f, 60) END AS file, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN CAST(floor(n / 1024.0::DOUBLE + 0.5) AS BIGINT) || ' KB' ELSE format('{{:.1f}}', floor(n / 1048576.0::DOUBLE * 10 + 0.5) / 10) || ' MB' END AS bytes,
  CAST(5 * len(list_filter({tokens("title")}, lambda w: w = 'light')) + len(list_filter({tokens("coalesce(description, '')")}, lambda w: w = 'light')) AS INT) AS score FROM t""",
    "search_queries": f"WITH {TAGGED} SELECT id, array_to_string([array_to_string(tags[1:3], ' '), array_to_string(tags[1:2], ' '), tags[1]], '|') AS queries FROM tagged",
    "date_functions": f"WITH {P} SELECT id, {MS} AS created_ms, {_ago()} AS ago, round(power(0.5::DOUBLE, greatest(0.0::DOUBLE, ({NOW} - {MS}) / 86400000.0::DOUBLE) / 30), 6) AS recency FROM p",
    "hash_functions": f"""WITH {P}, h AS (SELECT id, regexp_full_match(phash, '[0-9a-f]{{16}}') AS valid, phash FROM p WHERE phash IS NOT NULL),
d AS (SELECT id, valid, CASE WHEN valid THEN phash END AS again, CASE WHEN valid THEN bit_count(xor(CAST('0x' || phash AS UBIGINT), 1085102592571150095::UBIGINT))::INT END AS distance FROM h)
SELECT *, round(1 - distance / 64.0::DOUBLE, 6) AS similarity, {VERDICT} AS verdict FROM d""",
    "external_normalise": """WITH t AS (SELECT p_partkey, p_brand, list_distinct(string_split(lower(p_name), ' ') || [lower(p_name)]) AS tags, lower(p_name) AS whole, string_split(lower(p_name), ' ') AS w FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS provider_id, upper(w[1][1]) || w[1][2:] AS title, array_to_string(CASE WHEN w[1] = w[2] THEN [w[1], whole] WHEN len(w) = 1 THEN w ELSE w || [whole] END, ', ') AS description, len(tags)::INT AS n_tags, p_brand AS credit FROM t""",
    "create_pins": f"""WITH {P}, n AS (SELECT DISTINCT id, title, author_id, provider, provider_id, public_id, source, visibility, tags FROM incoming_pins),
t AS (SELECT *, row_number() OVER (PARTITION BY author_id, provider, provider_id ORDER BY title NULLS FIRST, public_id NULLS FIRST, source NULLS FIRST, tags NULLS FIRST, visibility NULLS FIRST) AS nth FROM n),
c AS (SELECT *, provider_id IS NOT NULL AND (nth > 1 OR EXISTS (SELECT 1 FROM p WHERE p.author_id IS NOT DISTINCT FROM t.author_id AND p.provider IS NOT DISTINCT FROM t.provider AND p.provider_id = t.provider_id)) AS clash FROM t)
SELECT coalesce(nullif(left(trim({SLUG.format("title")}, '-'), 48), ''), 'pin') || '-' || left(md5(id), 6) AS id, author_id, provider_id, coalesce(source, CASE WHEN coalesce(public_id, '') <> '' THEN 'upload' ELSE 'link' END) AS source,
  coalesce(visibility, 'public') AS visibility, nullif(len(tags), 0)::INT AS n_tags, {NOW}::BIGINT AS created_ms FROM c WHERE NOT clash
UNION ALL SELECT NULL, author_id, provider_id, source, visibility, NULL, NULL FROM c WHERE clash""",
    "store_analysis": f"WITH {P} SELECT id, CASE WHEN analyzed_at IS NULL AND length(id) % 2 = 0 THEN '00ff00ff00ff00ff' ELSE phash END AS phash, epoch_ms(CASE WHEN analyzed_at IS NULL AND length(id) % 2 = 0 THEN TIMESTAMP '2025-01-01 00:00:00' ELSE analyzed_at END) AS analyzed_ms FROM p",
    "forgotten_comments": f"WITH {P}, {C} SELECT p.id AS pin_id, count(c.id) AS removed FROM p LEFT JOIN c ON c.pin_id = p.id WHERE p.author_id = '{AUTHOR}' GROUP BY p.id",
    "form_limits": f"""WITH {P}, {C}, e AS (SELECT 'pin' AS kind, id, concat_ws(',', CASE WHEN length(trim(coalesce(title, ''))) NOT BETWEEN 1 AND 120 THEN 'title' END, CASE WHEN length(trim(coalesce(description, ''))) > 500 THEN 'description' END) AS errors FROM p
UNION ALL SELECT 'comment', CAST(id AS VARCHAR), CASE WHEN length(trim(coalesce(body, ''))) NOT BETWEEN 1 AND 1000 THEN 'body' ELSE '' END FROM c) SELECT * FROM e WHERE errors <> ''""",
    "parsed_visibility": f"WITH {P} SELECT id, 'public' AS upper, CASE WHEN visibility = 'private' THEN 'private' ELSE 'public' END AS as_stored FROM p",
    "pin_list": f"WITH {PV} SELECT id, title, description, image_url, thumb_url, author, author_id, epoch_ms(created_at) AS created_at, source, public_id, width, height, provider, provider_id, provider_page_url, credit, array_to_string(list_filter(tags, lambda t: t IS NOT NULL), '|') AS tags, visibility, phash, true AS palette, true AS color_families, epoch_ms(analyzed_at) AS analyzed_at FROM p".replace("array_to_string(list_filter", "coalesce(array_to_string(list_filter").replace("'|') AS tags", "'|'), '') AS tags"),
    "feed_pages": f"""WITH {PV}, o AS (SELECT id, row_number() OVER (ORDER BY created_at DESC, id DESC) AS n, {MS} AS ms FROM p),
ext AS (SELECT p_partkey AS id, unnest([p_partkey % 12, p_size % 12]) AS topic, p_partkey % 5 + 1 AS page FROM part), placed AS (SELECT *, row_number() OVER (PARTITION BY topic, page ORDER BY id) AS n FROM ext)
SELECT ((n - 1) // 30)::INT AS page, 'pin:' || id AS key, 'pin' AS kind, (SELECT 'd.' || {_b64("ms || '.' || id")} FROM o x WHERE x.n = 30 * ((o.n - 1) // 30 + 1)) AS next FROM o WHERE n <= 60
UNION ALL SELECT 2, 'px:' || id, 'result', 'p.3.2' FROM placed WHERE topic = 3 AND page = 1 AND n <= 30
UNION ALL SELECT 3, 'px:' || id, 'result', NULL FROM placed WHERE topic = 11 AND page = 5 AND n <= 30""",
    "cursor_codec": f"WITH {P} SELECT id, {_b64(MS + " || '.' || id")} AS cursor, {MS} AS ms, id AS row_id, true AS title_is_none FROM p",
    "feed_cursors": "SELECT * FROM (VALUES ('d.abc', 'stored', 'abc', NULL), ('d.', 'stored', NULL, NULL), ('p.3.2', 'external', '3', 2), ('p.0.1', 'external', '0', 1), ('p.3.0', 'stored', NULL, NULL), ('p.x.1', 'stored', NULL, NULL), ('q.1.1', 'stored', NULL, NULL), ('', 'stored', NULL, NULL), ('p.11.16', 'external', '11', 16)) AS v(cursor, phase, \"at\", page)",
    "dashboard_stats": f"""WITH RECURSIVE {groups(PIN_HASHES, 10)}, {S}, {C}, mine AS (SELECT * FROM p WHERE author_id = '{AUTHOR}'),
sc AS (SELECT pin_id, count(*) AS n FROM s GROUP BY pin_id), cc AS (SELECT pin_id, count(*) AS n FROM c GROUP BY pin_id),
scored AS (SELECT mine.id, created_at, 3 * coalesce(sc.n, 0) + coalesce(cc.n, 0) AS score FROM mine LEFT JOIN sc ON sc.pin_id = mine.id LEFT JOIN cc ON cc.pin_id = mine.id),
top AS (SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, created_at DESC, id DESC LIMIT 5),
swatches AS (SELECT id, pos, CAST('0x' || phash[6 * pos + 3:6 * pos + 4] AS INT) AS r, CAST('0x' || phash[6 * pos + 5:6 * pos + 6] AS INT) AS g, CAST('0x' || phash[6 * pos + 7:6 * pos + 8] AS INT) AS b, CASE WHEN pos = 0 THEN 0.75 ELSE 0.25 END AS share
  FROM (SELECT id, phash, unnest([0, 1]) AS pos FROM mine WHERE regexp_full_match(phash, '[0-9a-f]{{16}}'))),
{HSV.format(source="swatches")}, f AS (SELECT id, share, {FAMILY} AS family FROM hsv),
days AS (SELECT CAST(d AS DATE) AS day FROM unnest(generate_series(DATE '2024-12-18', DATE '2024-12-31', INTERVAL 1 DAY)) AS g(d))
SELECT 'counts' AS part, 'mine' AS name, (SELECT count(*) FROM mine)::DOUBLE AS value UNION ALL SELECT 'counts', 'saved', (SELECT count(*) FROM s WHERE user_id = '{AUTHOR}')
UNION ALL SELECT 'counts', 'comments', (SELECT count(*) FROM c WHERE pin_id IN (SELECT id FROM mine)) UNION ALL SELECT 'analysis', 'total', count(*) FROM p UNION ALL SELECT 'analysis', 'analyzed', count(phash) FROM p
UNION ALL SELECT 'analysis', 'coverage', round(count(phash)::DOUBLE / count(*), 6) FROM p UNION ALL SELECT 'duplicates', 'duplicate_groups', count(DISTINCT group_id) FROM member UNION ALL SELECT 'duplicates', 'duplicate_pins', count(*) FROM member
UNION ALL SELECT 'activity', CAST(day AS VARCHAR), count(id) FROM days LEFT JOIN mine ON CAST(created_at AS DATE) = day GROUP BY day
UNION ALL SELECT 'palette', family, round(sum(share) / (SELECT count(DISTINCT id) FROM swatches), 6) FROM f GROUP BY family UNION ALL SELECT 'top', id, score FROM top UNION ALL SELECT 'pins', id, score FROM scored""",
    "hex_colors": f"WITH {P} SELECT id, CAST('0x' || phash[1:2] AS INT) AS r, CAST('0x' || phash[3:4] AS INT) AS g, CAST('0x' || phash[5:6] AS INT) AS b, 17 * CAST('0x' || phash[1] AS INT) AS short_r, 17 * CAST('0x' || phash[3] AS INT) AS short_b, true AS title_is_none FROM p WHERE regexp_full_match(phash, '[0-9a-f]{{16}}')",
    "hash_bits": f"WITH {P}, h AS (SELECT id, CASE WHEN regexp_full_match(phash, '[0-9a-f]{{16}}') THEN CAST('0x' || phash AS UBIGINT) END AS h FROM p WHERE phash IS NOT NULL) SELECT id, CASE WHEN h IS NOT NULL THEN array_to_string(list_transform(range(64), lambda i: CASE WHEN (h >> (63 - i)::UBIGINT) & 1 = 1 THEN '1' ELSE '0' END), '') END AS bits FROM h",
    "url_functions": f"""WITH {P}, a AS (SELECT *, 'https://res.cloudinary.com/demo/image/upload/' || coalesce(public_id, 'w_10/a') AS asset FROM p)
SELECT id, 'attachment; filename="' || coalesce(nullif(regexp_replace(regexp_replace(title, '[^ -~]', '', 'g'), '["\\\\]', '', 'g'), ''), 'image') || '"; filename*=UTF-8''''' || url_encode(title) AS header,
  CASE WHEN public_id IS NULL THEN asset ELSE replace(asset, '/upload/', '/upload/f_auto,q_auto,c_limit,w_320,dpr_auto/') END AS sized, image_url AS other, true AS is_asset FROM a""".replace("replace(asset, '/upload/', '/upload/f_auto,q_auto,c_limit,w_320,dpr_auto/')", "'https://res.cloudinary.com/demo/image/upload/f_auto,q_auto,c_limit,w_320,dpr_auto/' || public_id"),
    "seed_ages": f"WITH {P} SELECT id, {NOW} - width * 5400000 AS days_ms, {NOW} - width * 60000::BIGINT AS minutes_ms FROM p WHERE width IS NOT NULL".replace("width * 5400000", "width::BIGINT * 5400000").replace("width * 60000::BIGINT", "width::BIGINT * 60000"),
    "seed_addresses": f"WITH {P} SELECT id, CASE WHEN public_id IN (SELECT public_id FROM p WHERE author_id = '{AUTHOR}' AND public_id IS NOT NULL) THEN 'https://assets.invalid/demo/' || public_id ELSE image_url END AS image_url FROM p",
    "report_lines": "SELECT '## Regions' AS value UNION ALL SELECT '' UNION ALL SELECT '| r_regionkey | r_name |' UNION ALL SELECT '|-|-|' UNION ALL SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region UNION ALL SELECT ''",
    "external_image": "SELECT CAST(p_partkey AS VARCHAR) AS provider_id, upper(left(split_part(p_name, ' ', 1), 1)) || lower(split_part(p_name, ' ', 1))[2:] AS title, p_size AS width FROM part WHERE p_partkey = 17",
    "dct_phash": f"WITH {_PICTURES} SELECT id, phash FROM hashed",
    "analyse_images": f"WITH {_PICTURES} SELECT id, CASE WHEN id % 7 <> 0 THEN phash END AS phash, id % 11 <> 0 AS has_palette, id % 77 <> 0 AS analyzed, CASE WHEN id % 7 = 0 THEN 'no grey ma' WHEN id % 11 = 0 THEN 'no palette' END AS error FROM hashed",
    "comment_stream": f"WITH {C}, top AS (SELECT pin_id FROM c GROUP BY pin_id ORDER BY count(*) DESC, pin_id LIMIT 1) SELECT id, trim(body) AS body, author_id FROM c WHERE pin_id = (SELECT pin_id FROM top) AND length(trim(body)) BETWEEN 1 AND 1000",
    "comment_stream_daily": f"WITH {C} SELECT epoch_ms(date_trunc('day', created_at)::TIMESTAMP) AS start_ms, pin_id, count(*) AS comments FROM c GROUP BY ALL",
    "tag_overlap_all": f"""WITH {TAGGED}, {IDF_TAGS}, mine AS (SELECT tag FROM w WHERE id = 1), r AS (SELECT id, sum(w) AS own, sum(CASE WHEN tag IN (SELECT tag FROM mine) THEN w END) AS both_ FROM w WHERE id <> 1 GROUP BY id)
SELECT id, round(both_ / (own + (SELECT sum(w) FROM w WHERE id = 1) - both_), 6) AS score FROM r WHERE both_ > 0""",
}
