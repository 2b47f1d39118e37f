"""DuckDB twins of the engine's queries, written against the raw tables."""

from __future__ import annotations

PIM, ATLAS = "pim_product", "atlas_source_product"

_DIGIT = "((10 - list_sum(list_transform(range(1, 13), lambda i: substr({b}, i, 1)::BIGINT * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10)"
_BODY = "'590' || lpad(p_partkey::VARCHAR, 9, '0')"
_GTIN = f"({_BODY} || {_DIGIT.format(b=f'({_BODY})')}::VARCHAR)"
_NORM = "array_to_string(list_filter(string_split(lower({n}), ' '), lambda x: x NOT IN ('new', 'red', 'blue')), ' ')"

_COLOR = "coalesce(list_filter(string_split(lower({n}), ' '), lambda x: x IN ('red', 'blue'))[1], '')"
_WORDS = "array_to_string(list_sort(list_distinct(string_split({n}, ' '))), '|')"

_CATALOG = f"""
pics AS (SELECT vec_id, embedding, list_reduce(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END), lambda a, b: a + b) AS h FROM embeddings),
hashes AS (SELECT vec_id, embedding, (CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END)::BIGINT AS phash FROM pics),
cat AS (
  SELECT '{PIM}' AS kind, p_partkey::VARCHAR AS ref, p_partkey, {_GTIN} AS gtin, p_name || ' ' || p_type || ' ' || p_size::VARCHAR AS n, p_brand, p_size FROM part
  UNION ALL
  SELECT '{ATLAS}', 'A' || p_partkey::VARCHAR, p_partkey, CASE WHEN p_partkey % 4 = 0 THEN {_GTIN} END, p_type || ' ' || p_name || ' ' || p_size::VARCHAR, p_brand, p_size FROM part WHERE p_partkey % 2 = 0),
fp AS (
  SELECT kind, ref, p_partkey, coalesce('0' || gtin, '') AS gtin14, gtin IS NOT NULL AS gtin_trusted, lower(replace(p_brand, '#', ' ')) AS brand_norm,
    'MP' || lpad((p_partkey % 997)::VARCHAR, 5, '0') AS mpn_norm, {_NORM.format(n="n")} AS name_norm, {_COLOR.format(n="n")} AS color, p_size + 0.25 AS weight, p_size AS width,
    CASE WHEN kind = '{PIM}' THEN phash END AS phash, CASE WHEN kind = '{PIM}' THEN embedding END AS vec
  FROM cat LEFT JOIN hashes ON vec_id = p_partkey),
every AS (
  SELECT p_partkey AS query_id, (p_partkey // 50) % 5 AS mode, {_NORM.format(n="p_name || ' ' || p_type || ' ' || p_size::VARCHAR")} AS title, {_NORM.format(n="p_name")} AS pname,
    '0' || {_GTIN} AS gtin14, lower(replace(p_brand, '#', ' ')) AS brand_norm, 'MP' || lpad((p_partkey % 997)::VARCHAR, 5, '0') AS mpn_norm, {_COLOR.format(n="p_name")} AS color, p_size + 0.25 AS weight
  FROM part),
req AS (SELECT * FROM every WHERE query_id % 50 = 0)"""

_TRIGRAMS = "list_distinct(flatten(list_transform(string_split({x}, ' '), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_SIMILARITY = "(len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))))::FLOAT::DOUBLE"
# a parsed query: columns that its kind of request doesn't fill are empty
_PARSED = """SELECT query_id, mode, CASE WHEN mode = 2 THEN gtin14 ELSE '' END AS gtin14, CASE WHEN mode IN (1, 3) THEN brand_norm ELSE '' END AS brand_norm,
    CASE WHEN mode = 3 THEN mpn_norm ELSE '' END AS mpn_norm, CASE WHEN mode = 4 THEN query_id::VARCHAR ELSE '' END AS sku,
    CASE WHEN mode < 2 THEN title WHEN mode = 2 THEN 'looking ' || pname ELSE '' END AS name_norm, CASE WHEN mode <= 2 THEN color ELSE '' END AS color, CASE WHEN mode = 4 THEN weight END AS weight"""
_SEQUENCE = "flatten(list_transform(string_split({x}, ' '), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))"


def _pool(queries: str, image: bool = True, limit: int = 100) -> str:
    """CTEs from a table of queries (query_id, scope, gtin14, brand_norm, mpn_norm, sku, name_norm, phash, vec) to its pool. No
    query's name holds a brand here, so the similarity without the brand is never the larger one."""
    legs = ["exact", "tri", "words", *(["hash", "near"] if image else [])]
    return f"""
q AS ({queries}),
qn AS (SELECT DISTINCT name_norm AS qname, list_distinct({_SEQUENCE.format(x="name_norm")}) AS a FROM q WHERE name_norm <> ''),
fn AS (SELECT DISTINCT name_norm AS fname, {_SEQUENCE.format(x="name_norm")} AS seq, list_distinct(seq) AS b FROM fp WHERE name_norm <> ''),
sims AS (SELECT qname, fname, a, seq, len(list_intersect(a, b)) AS c, (c / (len(a) + len(b) - c))::FLOAT::DOUBLE AS s FROM qn, fn),
runs AS (SELECT qname, fname, a, seq, list_filter(range(1, len(seq) + 1), lambda i: list_contains(a, seq[i])) AS spots FROM sims WHERE c >= 0.6 * len(a) - 0.001),
cut AS (SELECT qname, fname, a, list_slice(seq, i, j) AS e FROM (SELECT *, unnest(spots) AS j FROM (SELECT *, unnest(spots) AS i FROM runs)) WHERE i <= j),
ws AS (SELECT qname, fname, max(n / (len(a) + u - n))::FLOAT::DOUBLE AS w FROM (SELECT qname, fname, a, len(list_intersect(a, e)) AS n, len(list_distinct(e)) AS u FROM cut) GROUP BY ALL),
keyed AS (
  SELECT query_id, kind, ref, CASE WHEN q.gtin14 <> '' AND q.gtin14 = fp.gtin14 THEN 0 WHEN q.mpn_norm <> '' AND q.mpn_norm = fp.mpn_norm THEN 1 ELSE 2 END AS o, coalesce(s, 0) AS s
  FROM q JOIN fp ON list_contains(scope, kind) AND ((q.gtin14 <> '' AND q.gtin14 = fp.gtin14) OR (q.mpn_norm <> '' AND q.brand_norm <> '' AND q.mpn_norm = fp.mpn_norm AND q.brand_norm = fp.brand_norm) OR (sku <> '' AND sku = ref))
  LEFT JOIN sims ON qname = q.name_norm AND fname = fp.name_norm),
exact AS (SELECT query_id, kind, ref, 1 AS leg, row_number() OVER (PARTITION BY query_id ORDER BY o, s DESC, kind, ref) AS place FROM keyed QUALIFY place <= 100),
hash AS (
  SELECT query_id, kind, ref, 2 AS leg, row_number() OVER (PARTITION BY query_id ORDER BY bit_count(xor(q.phash, fp.phash)), kind, ref) AS place
  FROM q JOIN fp ON list_contains(scope, kind) AND bit_count(xor(q.phash, fp.phash)) <= 10 QUALIFY place <= 20),
tri AS (
  SELECT query_id, kind, ref, 3 AS leg, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, kind, ref) AS place
  FROM q JOIN sims ON qname = q.name_norm JOIN fp ON fname = fp.name_norm AND list_contains(scope, kind) WHERE s >= 0.35 QUALIFY place <= 50),
near AS (
  SELECT query_id, kind, ref, 4 AS leg, row_number() OVER (PARTITION BY query_id ORDER BY round(1 - list_cosine_similarity(q.vec::DOUBLE[], fp.vec::DOUBLE[]), 12), kind, ref) AS place
  FROM q JOIN fp ON q.vec IS NOT NULL AND fp.vec IS NOT NULL AND list_contains(scope, kind) QUALIFY place <= 20),
words AS (
  SELECT query_id, kind, ref, 5 AS leg, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, kind, ref) AS place
  FROM q JOIN ws ON qname = q.name_norm JOIN fp ON fname = fp.name_norm AND list_contains(scope, kind)
  WHERE w >= 0.6::FLOAT::DOUBLE AND len(list_distinct(string_split(q.name_norm, ' '))) >= 2 QUALIFY place <= 50),
met AS ({" UNION ALL ".join(f"SELECT * FROM {leg}" for leg in legs)}),
first AS (SELECT query_id, kind, ref, min((leg, place)) AS f FROM met GROUP BY ALL),
pool AS (SELECT query_id, kind, ref, f[1] AS leg, f[2] AS place, row_number() OVER (PARTITION BY query_id ORDER BY f) AS pool_rank FROM first QUALIFY pool_rank <= {limit})"""


def _line(x: str, floor: float, ceiling: float, top: int) -> str:
    return f"CASE WHEN {x} <= {floor}::DOUBLE THEN 0 ELSE round_even({top}::DOUBLE * (least({x}, {ceiling}::DOUBLE) - {floor}::DOUBLE) / ({ceiling}::DOUBLE - {floor}::DOUBLE), 0) END::INT"


#: From pool to scored: the evidence of each pair, its sum, verdict and relevance.
_SCORED = f"""
both_sides AS (
  SELECT p.*, q.gtin14 AS q_gtin, fp.gtin14 AS c_gtin, q.brand_norm AS q_brand, fp.brand_norm AS c_brand, q.mpn_norm AS q_mpn, fp.mpn_norm AS c_mpn, q.sku, q.name_norm AS q_name, fp.name_norm AS c_name,
    q.color AS q_color, fp.color AS c_color, q.weight AS q_weight, fp.weight AS c_weight, q.phash IS NOT NULL OR q.vec IS NOT NULL AS has_image,
    CASE WHEN q.phash IS NOT NULL OR q.vec IS NOT NULL THEN bit_count(xor(q.phash, fp.phash)) END AS bits, list_cosine_similarity(q.vec::DOUBLE[], fp.vec::DOUBLE[]) AS cos
  FROM pool p JOIN q USING (query_id) JOIN fp USING (kind, ref)),
spelled AS (
  SELECT DISTINCT q_name, c_name, list_distinct(string_split(q_name, ' ')) AS x, list_distinct(string_split(c_name, ' ')) AS y, array_to_string(list_sort(list_filter(x, lambda w: list_contains(y, w))), ' ') AS b,
    array_to_string(list_sort(list_filter(x, lambda w: NOT list_contains(y, w))), ' ') AS ox, array_to_string(list_sort(list_filter(y, lambda w: NOT list_contains(x, w))), ' ') AS oy
  FROM both_sides WHERE q_name <> '' AND c_name <> ''),
-- the longest common subsequence, a bit for each character of ox
masks AS (
  SELECT *, (1::HUGEINT << len(ox)::INT) - 1 AS ones,
    list_transform(string_split(oy, ''), lambda ch: list_sum(list_transform(range(0, len(ox)), lambda i: CASE WHEN substr(ox, i + 1, 1) = ch THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END))) AS ms FROM spelled),
lcs AS (SELECT *, CASE WHEN ox = '' OR oy = '' THEN 0 ELSE len(ox) - bit_count(list_reduce(ms, lambda s, m: ((s + (s & m)) | (s - (s & m))) & ones, ones)) END AS l FROM masks),
sized AS (SELECT *, len(b) AS nb, CASE WHEN b = '' THEN 0 ELSE 1 END AS gap, len(ox) + len(oy) - 2 * l AS indel FROM lcs),
ratios AS (
  SELECT q_name, c_name, CASE WHEN b <> '' AND (ox = '' OR oy = '') THEN 100.0::DOUBLE
    ELSE greatest(100 - 100 * indel / (2 * (nb + gap) + len(ox) + len(oy)), CASE WHEN b <> '' THEN 100 - 100 * (gap + len(ox)) / (nb + nb + gap + len(ox)) ELSE 0 END,
      CASE WHEN b <> '' THEN 100 - 100 * (gap + len(oy)) / (nb + nb + gap + len(oy)) ELSE 0 END) END AS ratio FROM sized),
measured AS (
  SELECT t.*, coalesce(s, 0) AS s, coalesce(ratio, 0) / 100 AS tokens, {_line("least(coalesce(s, 0), 0.9::DOUBLE)", 0.35, 0.9, 25)} AS tri_points
  FROM both_sides t LEFT JOIN sims ON qname = q_name AND fname = c_name LEFT JOIN ratios r ON r.q_name = t.q_name AND r.c_name = t.c_name),
found AS (
  SELECT *, list_filter([
    CASE WHEN q_gtin <> '' AND q_gtin = c_gtin THEN {{'code': 'gtin_exact', 'points': 60}} END,
    CASE WHEN q_mpn <> '' AND q_mpn = c_mpn THEN CASE WHEN q_brand = '' OR c_brand = '' THEN {{'code': 'mpn_exact', 'points': 20}} WHEN q_brand = c_brand THEN {{'code': 'brand_mpn_exact', 'points': 45}}
      ELSE {{'code': 'mpn_exact_brand_conflict', 'points': -30}} END END,
    CASE WHEN sku <> '' AND sku = ref THEN {{'code': 'sku_exact', 'points': 30}} END,
    CASE WHEN s >= 0.35 AND tri_points <> 0 THEN {{'code': 'name_trigram', 'points': tri_points}} END,
    CASE WHEN tokens >= 0.85 THEN {{'code': 'name_tokens_strong', 'points': 20}} WHEN tokens >= 0.6 THEN {{'code': 'name_tokens_weak', 'points': 10}} END,
    CASE WHEN q_brand <> '' AND c_brand <> '' THEN CASE WHEN q_brand = c_brand THEN {{'code': 'brand_equal', 'points': 10}} ELSE {{'code': 'brand_conflict', 'points': -25}} END END,
    CASE WHEN q_weight IS NOT NULL AND c_weight IS NOT NULL THEN CASE WHEN abs(q_weight - c_weight) <= greatest(abs(q_weight) * 0.05, 0.01) THEN {{'code': 'weight_match', 'points': 5}} ELSE {{'code': 'weight_conflict', 'points': -15}} END END,
    CASE WHEN q_color <> '' AND c_color <> '' THEN CASE WHEN q_color = c_color THEN {{'code': 'color_equal', 'points': 5}} ELSE {{'code': 'color_conflict', 'points': -40}} END END], lambda r: r IS NOT NULL) AS texts,
    list_filter([
    CASE WHEN bits <= 5 THEN {{'code': 'image_near_exact', 'points': 10}} WHEN bits <= 10 THEN {{'code': 'image_near', 'points': 6}} END,
    CASE WHEN cos >= 0.9 THEN {{'code': 'image_similar_strong', 'points': 10}} WHEN cos >= 0.8 THEN {{'code': 'image_similar', 'points': 5}} END], lambda r: r IS NOT NULL) AS images
  FROM measured),
judged AS (
  SELECT *, list_transform(texts, lambda r: r.code) AS codes, list_contains(codes, 'gtin_exact') OR list_contains(codes, 'brand_mpn_exact') AS identified, list_contains(codes, 'color_conflict') AS variant,
    list_contains(codes, 'brand_conflict') AND NOT variant AND NOT list_contains(codes, 'weight_conflict') AND list_contains(codes, 'gtin_exact') AND (tokens >= 0.85 OR tri_points >= 20) AS dirty,
    list_contains(codes, 'brand_conflict') AND NOT dirty AS clash, len(images) > 0 AND len(list_filter(texts, lambda r: r.points > 0)) = 0 AS only_image,
    greatest(0, least(100, coalesce(list_sum(list_transform(texts, lambda r: r.points)), 0) + coalesce(list_sum(list_transform(images, lambda r: r.points)), 0)))::INT AS score,
    CASE WHEN list_contains(codes, 'gtin_exact') OR list_contains(codes, 'brand_mpn_exact') THEN 100 WHEN list_contains(codes, 'mpn_exact') OR list_contains(codes, 'sku_exact') THEN 80 ELSE 0 END AS id_points,
    CASE WHEN q_name <> '' AND c_name <> '' THEN greatest({_line("s", 0.35, 0.9, 100)}, {_line("tokens", 0.6, 1.0, 100)}) ELSE 0 END AS name_points,
    has_image AND coalesce(bits <= 5, false) AND (cos IS NULL OR cos >= 0.95) AS same, {_line("coalesce(cos, 0)", 0.8, 1.0, 100)} AS cos_points,
    CASE WHEN NOT has_image THEN 0 WHEN same THEN 100 WHEN bits <= 10 THEN greatest(85, cos_points) ELSE cos_points END AS picture
  FROM found),
scored AS (
  SELECT *, CASE WHEN NOT (clash OR variant OR only_image) AND (score >= 75 OR identified) THEN 'match' WHEN score >= 45 OR identified THEN 'review' ELSE 'no_match' END AS decision,
    CASE WHEN NOT has_image THEN greatest(id_points, name_points) WHEN q_gtin || q_mpn || sku || q_name || q_brand = '' THEN picture WHEN id_points = 100 THEN 100
      ELSE round_even(picture * 0.5::DOUBLE + greatest(id_points, name_points) * 0.5::DOUBLE, 0) END::INT AS relevance,
    CASE WHEN id_points = 100 OR same THEN 'exact' WHEN relevance > 0 THEN 'similar' ELSE 'none' END AS match_kind
  FROM judged)"""
_QUERIES = f"""{_PARSED}, ['{PIM}', '{ATLAS}'] AS scope, CASE WHEN mode IN (0, 4) THEN phash END AS phash, CASE WHEN mode IN (0, 4) THEN embedding END AS vec
  FROM req LEFT JOIN hashes ON vec_id = query_id"""
_POOL = f"WITH {_CATALOG}, {_pool(_QUERIES)}"
_FOUND = f"{_POOL}, {_SCORED}"
_CHECKED = "checked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s DESC, pool_rank) AS rank FROM scored QUALIFY rank <= 10)"
_OLDER = f"""old AS (
  SELECT kind, ref, mpn_norm, vec FROM fp WHERE NOT (kind = '{PIM}' AND p_partkey % 10 = 3)
  UNION ALL SELECT kind, 'gone-' || ref, mpn_norm, vec FROM fp WHERE kind = '{PIM}' AND p_partkey % 20 = 4)"""
_NO_KEYS = "'' AS gtin14, brand_norm, '' AS mpn_norm, '' AS sku"
_NO_IMAGE = "NULL::BIGINT AS phash, NULL::FLOAT[] AS vec"
_EVAL = f"""WITH {_CATALOG},
given AS (
  SELECT query_id, 'A' || query_id::VARCHAR AS ref, 'match' AS label, '{ATLAS}' AS kind FROM req UNION ALL SELECT query_id, (query_id + 1)::VARCHAR, 'no', '{PIM}' FROM req
  UNION ALL SELECT query_id, 'A' || (query_id + 2)::VARCHAR, 'variant', '{ATLAS}' FROM req UNION ALL SELECT query_id, 'x', 'perhaps', '{PIM}' FROM req),
rows AS (SELECT row_number() OVER () AS id, * FROM given),
asked AS (
  SELECT id AS query_id, gtin14, e.brand_norm, mpn_norm, '' AS sku, title AS name_norm, color, weight, [kind] AS scope, phash, embedding AS vec
  FROM rows r JOIN every e USING (query_id) LEFT JOIN hashes ON vec_id = r.query_id WHERE label <> 'perhaps'),
checked AS (WITH {_pool(f"SELECT query_id, gtin14, brand_norm, mpn_norm, sku, name_norm, color, weight, scope, {_NO_IMAGE} FROM asked", image=False)}, {_SCORED} SELECT query_id, kind, ref, score, decision FROM scored),
named AS (WITH {_pool(f"SELECT query_id, {_NO_KEYS}, name_norm, scope, {_NO_IMAGE} FROM asked", image=False, limit=50)} SELECT query_id, kind, ref FROM pool),
seen AS (WITH {_pool(f"SELECT query_id, {_NO_KEYS}, '' AS name_norm, scope, phash, vec FROM asked WHERE phash IS NOT NULL", limit=20)} SELECT query_id, kind, ref FROM pool),
outcomes AS (
  SELECT r.query_id::VARCHAR AS query_ref, r.ref AS candidate_ref, label, CASE WHEN label = 'perhaps' THEN 'bad label' END AS skip_reason, coalesce(c.score, 0)::INT AS score,
    coalesce(c.decision, 'no_match') AS decision, c.score IS NOT NULL AS retrieved, n.ref IS NOT NULL AS name_blocked, CASE WHEN a.phash IS NOT NULL THEN s.ref IS NOT NULL END AS image_blocked
  FROM rows r LEFT JOIN asked a ON a.query_id = r.id LEFT JOIN checked c ON c.query_id = r.id AND c.kind = r.kind AND c.ref = r.ref
  LEFT JOIN named n ON n.query_id = r.id AND n.kind = r.kind AND n.ref = r.ref LEFT JOIN seen s ON s.query_id = r.id AND s.kind = r.kind AND s.ref = r.ref),
o AS (SELECT * FROM outcomes WHERE skip_reason IS NULL)"""

SQL = {
    "normalize_gtin": """
WITH r AS (SELECT p_partkey, (p_partkey * 7919 + 20000000)::VARCHAR || CASE WHEN p_partkey % 3 = 0 THEN '1234' ELSE '' END AS d FROM part),
p AS (SELECT p_partkey, d, lpad(d, 14, '0') AS g FROM r),
v AS (SELECT *, len(d) IN (8, 12, 13, 14) AND list_sum(list_transform(range(1, 15), lambda i: substr(g, i, 1)::BIGINT * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) % 10 = 0 AS valid FROM p),
k AS (SELECT p_partkey, valid, CASE WHEN valid THEN g ELSE '' END AS gtin14 FROM v)
SELECT p_partkey, gtin14, valid, valid AND NOT regexp_matches(gtin14, '^[1-8]') AND NOT regexp_matches(gtin14, '^.(2|02|04)') AS trusted,
  regexp_matches(gtin14, '^[1-8]') AS related_unit FROM k""",
    "normalize_mpn": """
WITH k AS (SELECT p_partkey, '00' || p_partkey || upper(p_type) || p_size AS whole, '00' || p_partkey || upper(p_type) AS head FROM part)
SELECT p_partkey, CASE WHEN len(ltrim(whole, '0')) >= 4 THEN ltrim(whole, '0') ELSE whole END AS mpn_strict,
  CASE WHEN len(ltrim(head, '0')) >= 4 THEN ltrim(head, '0') ELSE head END AS mpn_loose FROM k""",
    "fold_text": r"""
WITH a AS (SELECT doc_id, regexp_replace(lower(strip_accents(replace(replace(replace(coalesce(text, ''), 'ß', 'ss'), 'ł', 'l'), 'Ł', 'L'))), '[^\p{L}\p{N}_&+.]+', ' ', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(\d)\.(\d)', '\1' || chr(1) || '\2', 'g'), '(\d)\.(\d)', '\1' || chr(1) || '\2', 'g') AS t FROM a)
SELECT doc_id, trim(regexp_replace(replace(replace(t, '.', ' '), chr(1), '.'), '\s+', ' ', 'g')) AS folded FROM b""",
    "normalize_brand": "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'hp' ELSE lower(replace(p_brand, '#', ' ')) END AS brand_norm FROM part",
    "normalize_name_tokens": """
WITH m AS (SELECT p_partkey, p_partkey % 5 AS mode, list_filter(string_split(lower(p_name), ' '), lambda x: x <> 'new') AS w FROM part),
t AS (SELECT *, list_concat(w, CASE mode WHEN 1 THEN ['1.5l', 'blue'] WHEN 2 THEN ['czarna'] WHEN 4 THEN ['m'] ELSE [] END) AS ts FROM m),
c AS (SELECT *, list_filter(range(1, len(ts) + 1), lambda i: ts[i] IN ('red', 'blue', 'czarna'))[1] AS spot FROM t),
n AS (SELECT *, list_transform(list_filter(range(1, len(ts) + 1), lambda i: i IS DISTINCT FROM spot AND NOT (mode = 4 AND i = len(ts))), lambda i: ts[i]) AS left_ FROM c)
SELECT p_partkey, array_to_string(left_, ' ') AS name_norm, array_to_string(list_sort(list_distinct(left_)), '|') AS tokens, CASE WHEN mode = 0 THEN 2 END::INT AS pack_qty,
  coalesce(CASE ts[spot] WHEN 'czarna' THEN 'black' ELSE ts[spot] END, '') AS color, CASE mode WHEN 2 THEN 'xl' WHEN 3 THEN '42.5' WHEN 4 THEN 'm' ELSE '' END AS size FROM n""",
    "parse_query": f"""
WITH {_CATALOG}, q AS ({_PARSED} FROM every)
SELECT query_id, gtin14, gtin14 <> '' AS gtin_trusted, brand_norm, mpn_norm, sku, name_norm, CASE WHEN name_norm = '' THEN '' ELSE {_WORDS.format(n="name_norm")} END AS tokens, weight::DOUBLE AS weight FROM q""",
    "validate_query": """
SELECT p_partkey AS query_id, CASE p_partkey % 20 WHEN 1 THEN 'q is longer than 500' WHEN 2 THEN 'ean is longer than 32' WHEN 3 THEN 'brand is longer than 255' WHEN 4 THEN 'mpn is longer than 255'
  WHEN 5 THEN 'sku is longer than 255' WHEN 6 THEN 'name is longer than 500' WHEN 7 THEN 'attrs.weight is negative' WHEN 8 THEN 'attrs.width is negative' WHEN 9 THEN 'attrs.height is negative'
  WHEN 10 THEN 'attrs.deep is negative' WHEN 11 THEN 'attrs.color is longer than 64' WHEN 12 THEN 'attrs.size is longer than 64' WHEN 13 THEN 'attrs.pack_qty is out of range' WHEN 14 THEN 'attrs.pack_qty is out of range'
  WHEN 15 THEN 'limit is out of range' WHEN 16 THEN 'limit is out of range' WHEN 17 THEN 'scope holds an unknown kind' WHEN 18 THEN 'no signal: one of q, ean, name, mpn, sku or an image is needed' END AS error FROM part""",
    "fingerprint_build": f"""
WITH {_CATALOG} SELECT kind, ref, gtin14, gtin_trusted, brand_norm, mpn_norm, name_norm, {_WORDS.format(n="name_norm")} AS tokens, NULL::INT AS pack_qty, color, '' AS size,
  weight::DOUBLE AS weight, width::DOUBLE AS width, phash FROM fp""",
    "coverage": f"""
WITH {_CATALOG} SELECT kind, count(*)::BIGINT AS n_rows, (count(*) FILTER (gtin14 <> ''))::BIGINT AS n_gtin14, (count(*) FILTER (mpn_norm <> ''))::BIGINT AS n_mpn_norm,
  (count(*) FILTER (brand_norm <> ''))::BIGINT AS n_brand_norm, (count(*) FILTER (name_norm <> ''))::BIGINT AS n_name_norm, count(phash)::BIGINT AS n_phash, count(vec)::BIGINT AS n_image_vec
FROM fp GROUP BY kind""",
    "reconcile_diff": f"""
WITH {_CATALOG}, {_OLDER},
d AS (SELECT kind, 1 AS c, 0 AS x FROM fp ANTI JOIN old USING (kind, ref) UNION ALL SELECT kind, 0, 1 FROM old ANTI JOIN fp USING (kind, ref))
SELECT kind, sum(c)::BIGINT AS n_created, sum(x)::BIGINT AS n_deleted FROM d GROUP BY kind""",
    "upsert_snapshot": f"""
WITH {_CATALOG}, {_OLDER},
new AS (SELECT kind, ref FROM fp WHERE kind = '{PIM}' AND p_partkey % 5 = 3)
SELECT kind, ref, 'NEW' || ref AS mpn_norm, old.vec IS NOT NULL AS has_vector FROM new LEFT JOIN old USING (kind, ref)
UNION ALL SELECT kind, ref, mpn_norm, vec IS NOT NULL FROM old ANTI JOIN new USING (kind, ref)""",
    "refresh_outcomes": f"""
WITH {_CATALOG}, {_OLDER},
refs AS (SELECT DISTINCT '{PIM}' AS kind, CASE WHEN user_id % 9 = 0 THEN 'gone-' ELSE '' END || user_id::VARCHAR AS ref FROM events)
SELECT r.kind, r.ref, CASE WHEN c.ref IS NOT NULL THEN 'refreshed' WHEN o.ref IS NOT NULL THEN 'deleted' ELSE 'absent' END AS outcome
FROM refs r LEFT JOIN cat c USING (kind, ref) LEFT JOIN old o USING (kind, ref)""",
    "stream_refresh": f"""
WITH {_CATALOG}, {_OLDER},
refs AS (SELECT DISTINCT '{PIM}' AS kind, CASE WHEN user_id % 9 = 0 THEN 'gone-' ELSE '' END || user_id::VARCHAR AS ref FROM events)
SELECT kind, ref, 'NEW' || ref AS mpn_norm, old.vec IS NOT NULL AS has_vector FROM refs JOIN cat USING (kind, ref) LEFT JOIN old USING (kind, ref)
UNION ALL SELECT kind, ref, mpn_norm, vec IS NOT NULL FROM old ANTI JOIN refs USING (kind, ref)""",
    "block_exact": f"""
WITH {_CATALOG}
SELECT DISTINCT query_id, kind, ref FROM (
  SELECT query_id, kind, ref FROM req JOIN fp USING (gtin14) WHERE mode = 2
  UNION ALL SELECT query_id, kind, ref FROM req JOIN fp USING (brand_norm, mpn_norm) WHERE mode = 3
  UNION ALL SELECT query_id, kind, ref FROM req JOIN fp ON ref = query_id::VARCHAR WHERE mode = 4)""",
    "block_phash": f"""
WITH {_CATALOG},
p AS (SELECT p_partkey, ref, phash FROM fp WHERE phash IS NOT NULL),
t AS (SELECT p_partkey, xor(phash, (1 << (p_partkey % 13)::INT)::BIGINT - 1) AS phash FROM p),
d AS (SELECT a.p_partkey AS query_id, b.p_partkey AS ref, b.ref AS s, bit_count(xor(a.phash, b.phash)) AS d FROM t a, p b WHERE bit_count(xor(a.phash, b.phash)) <= 10)
SELECT query_id, ref, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, s) AS place FROM d) WHERE place <= 20""",
    "block_vector_topk": f"""
WITH {_CATALOG},
p AS (SELECT p_partkey, ref, vec::DOUBLE[] AS v FROM fp WHERE vec IS NOT NULL),
d AS (SELECT a.p_partkey AS query_id, b.p_partkey AS ref, b.ref AS s, round(1 - list_cosine_similarity(a.v, b.v), 12) AS d FROM p a, p b WHERE a.p_partkey % 50 = 0)
SELECT query_id, ref, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, s) AS place FROM d) WHERE place <= 20""",
    "block_trigram_topk": f"""
WITH {_CATALOG},
q AS (SELECT query_id, {_TRIGRAMS.format(x="t")} AS a FROM (SELECT query_id, CASE WHEN mode < 2 THEN title ELSE 'looking ' || pname END AS t FROM req WHERE mode <= 2)),
f AS (SELECT kind, ref, {_TRIGRAMS.format(x="name_norm")} AS b FROM fp),
s AS (SELECT query_id, kind, ref, {_SIMILARITY.format(a="a", b="b")} AS s FROM q, f)
SELECT query_id, kind, ref, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, kind, ref) AS place FROM s WHERE s >= 0.35) WHERE place <= 50""",
    "block_words": f"{_POOL} SELECT query_id, kind, ref, place::INT AS place FROM words",
    "candidates_union": f"{_POOL} SELECT query_id, kind, ref, leg, place::INT AS place, pool_rank::INT AS pool_rank FROM pool",
    "score_levels": f"{_FOUND} SELECT query_id, kind, ref, r.code AS code, r.points AS points FROM (SELECT query_id, kind, ref, unnest(list_concat(texts, images)) AS r FROM scored)",
    "decide_verdict": f"""
{_FOUND} SELECT query_id, kind, ref, score, decision, array_to_string(list_sort(list_filter([CASE WHEN identified THEN 'identifier_exact' END, CASE WHEN clash THEN 'brand_conflict' END,
  CASE WHEN dirty THEN 'brand_dirty_data' END, CASE WHEN variant THEN 'variant_conflict' END, CASE WHEN only_image THEN 'image_only' END], lambda f: f IS NOT NULL)), ',') AS flags FROM scored""",
    "relevance_rank": f"{_FOUND} SELECT query_id, kind, ref, relevance, match_kind FROM scored",
    "search_topk": f"""
{_FOUND} SELECT query_id, rank::INT AS rank, kind, ref, relevance AS similarity, match_kind
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, score DESC, s DESC, pool_rank) AS rank FROM scored) WHERE rank <= 10""",
    "check_topk": f"{_FOUND}, {_CHECKED} SELECT query_id, rank::INT AS rank, kind, ref, score, decision FROM checked",
    "check_overall": f"""
{_FOUND}, {_CHECKED},
best AS (SELECT query_id, max(CASE decision WHEN 'match' THEN 2 WHEN 'review' THEN 1 ELSE 0 END) AS b FROM checked GROUP BY query_id)
SELECT query_id, CASE b WHEN 2 THEN 'match' WHEN 1 THEN 'review' ELSE 'no_match' END AS decision FROM q LEFT JOIN best USING (query_id)""",
    "trigram_similarity": f"""
WITH p AS (SELECT a.p_partkey, {_TRIGRAMS.format(x="lower(a.p_name)")} AS a, {_TRIGRAMS.format(x="lower(b.p_name)")} AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
SELECT p_partkey, round({_SIMILARITY.format(a="a", b="b")}, 6) AS similarity FROM p""",
    "rejected_pairs": """
SELECT DISTINCT (doc_id % 100)::VARCHAR AS subject_ref, (doc_id % 37)::VARCHAR AS candidate_ref FROM labels
WHERE toxic = 1 AND doc_id % 100 IN (SELECT doc_id % 100 FROM labels WHERE doc_id % 2 = 0)""",
    "eval_outcomes": f"{_EVAL} SELECT * FROM outcomes",
    "eval_summary": f"{_EVAL} SELECT skip_reason, count(*)::BIGINT AS n_pairs, (count(*) FILTER (NOT retrieved))::BIGINT AS n_not_retrieved FROM outcomes GROUP BY skip_reason",
    "eval_threshold_sweep": f"""
{_EVAL},
g AS (SELECT p AS positives, t::INT AS threshold, score >= t AS said, label = 'match' OR (label = 'variant' AND p = 'match+variant') AS actual
  FROM o, (VALUES ('match'), ('match+variant')) a(p), (VALUES (30), (45), (60), (75)) b(t)),
n AS (SELECT positives, threshold, (count(*) FILTER (said AND actual))::BIGINT AS tp, (count(*) FILTER (said AND NOT actual))::BIGINT AS fp,
  (count(*) FILTER (NOT said AND actual))::BIGINT AS fn, (count(*) FILTER (NOT said AND NOT actual))::BIGINT AS tn FROM g GROUP BY ALL),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rc FROM n)
SELECT positives, threshold, tp, fp, fn, tn, round(p, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END, 6) AS f1 FROM r""",
    "eval_confusion": f"{_EVAL} SELECT label, decision, count(*)::BIGINT AS n_pairs FROM o GROUP BY ALL",
    "eval_recall": f"""
{_EVAL} SELECT round(avg(name_blocked::INT), 6) AS recall_at_50_name, round(avg(image_blocked::INT), 6) AS recall_at_20_image FROM o WHERE label IN ('match', 'variant')""",
    "eval_decision_view": f"""
{_EVAL} SELECT (count(*) FILTER (label = 'match' AND decision = 'match'))::BIGINT AS linked, (count(*) FILTER (label = 'match' AND decision = 'review'))::BIGINT AS reviewed,
  (count(*) FILTER (label = 'match' AND decision = 'no_match'))::BIGINT AS missed, (count(*) FILTER (label = 'no' AND decision = 'match'))::BIGINT AS linked_wrongly FROM o""",
}
