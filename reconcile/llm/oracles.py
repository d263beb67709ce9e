"""The same results as plain SQL, written for a second engine, where SQL can express them."""

from __future__ import annotations

from reconcile.llm import licenses

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = f"regexp_extract_all({_LOWER}, '{licenses.WORD}')"
_SPACED = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

# Every pair of documents that share a shingle, with the size of their intersection.
_JACCARD = rf"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_SPACED.format('text')} AS words FROM documents
),
sets AS (
  SELECT r, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' '))) END AS shingles
  FROM docs
),
kinds AS (SELECT min(r) AS k, list_sort(shingles) AS shingles, min(doc_id) AS least FROM sets GROUP BY list_sort(shingles)),
rows AS (SELECT k, len(shingles) AS n, unnest(shingles) AS s FROM kinds),
links AS (
  SELECT a.k AS a, b.k AS b FROM rows a JOIN rows b ON a.s = b.s AND a.k <> b.k
  GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
component AS (
  SELECT k, least(any_value(kinds.least), min(other.least)) AS least
  FROM kinds LEFT JOIN reach ON reach.a = k LEFT JOIN (SELECT k AS o, least FROM kinds) other ON other.o = reach.b GROUP BY k
)
SELECT doc_id, CAST(len(sets.shingles) AS BIGINT) AS n_shingles,
  CASE WHEN len(sets.shingles) = 0 THEN doc_id ELSE component.least END AS component_id
FROM sets JOIN kinds ON list_sort(sets.shingles) = kinds.shingles JOIN component ON component.k = kinds.k
"""

# Every window of the benchmark looked for at every word of every document.
_DECONTAMINATE = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN.format('text')} AS words FROM documents),
items AS (SELECT item_id, {_PLAIN.format('text')} AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(words)) AS n,
    unnest(list_transform(range(1, greatest(len(words) - 12, 1) + 1), lambda i: array_to_string(words[i : i + 12], ' '))) AS w
  FROM items WHERE len(words) > 0
),
places AS (
  SELECT r, n, unnest(list_transform(range(1, len(words) - n + 2),
    lambda i: {{'i': i, 'w': array_to_string(words[i : i + n - 1], ' ')}})) AS p
  FROM docs JOIN (SELECT DISTINCT n FROM windows) ON len(words) >= n
),
hits AS (SELECT r, p.i AS i, n, item_id FROM places JOIN windows USING (n) WHERE p.w = windows.w),
words AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS spot FROM hits) GROUP BY r),
found AS (
  SELECT r, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hits GROUP BY r
)
SELECT doc_id, CAST(len(docs.words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(docs.words) AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""

# The cosine of every pair of one label.
_EMBEDDINGS = """
WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS x,
    label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
      AND len(list_filter(embedding, lambda c: c <> 0)) > 0 AS able
  FROM embeddings
),
links AS (
  SELECT a.r AS a, b.r AS b FROM rows a JOIN rows b ON a.label = b.label AND a.r <> b.r AND len(a.x) = len(b.x)
  WHERE a.able AND b.able
    AND list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x)) / sqrt(list_dot_product(b.x, b.x)) >= 0.98
),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
component AS (SELECT a, min(vec_id) AS least FROM reach JOIN rows ON rows.r = reach.b GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, component.least) AS component_id,
  vec_id IS NOT DISTINCT FROM least(vec_id, component.least) AS kept
FROM rows LEFT JOIN component ON component.a = r LEFT JOIN counts ON counts.a = r
"""

# One list of nodes per level of a tree; the tree of the languages' roots above those of the leaves.
_FIELDS = " || ".join(
    f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", "text")
)
_CRC32 = """xor(list_reduce([4294967295] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])), lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x)
  WHEN crc % 2 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END), 4294967295)"""
_PAIRED = """list_transform(range(0, (len(nodes) + 1) // 2), lambda j: sha256(nodes[2 * j + 1] || coalesce(nodes[2 * j + 2], '')))"""
_MANIFEST = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, sha256({_FIELDS}) AS leaf, CASE WHEN {_CRC32} % 7 = 0 THEN sha256({_FIELDS.replace('n_chars', '(n_chars + 1)')}) END AS tampered
  FROM documents
),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM leaves),
levels AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY p) AS nodes FROM placed GROUP BY lang
  UNION ALL SELECT lang, level + 1, {_PAIRED} FROM levels WHERE len(nodes) > 1
),
subroots AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS q FROM levels WHERE len(nodes) = 1),
tops AS (
  SELECT 0 AS level, list(subroot ORDER BY q) AS nodes FROM subroots
  UNION ALL SELECT level + 1, {_PAIRED} FROM tops WHERE len(nodes) > 1
),
root AS (SELECT nodes[1] AS root FROM tops WHERE len(nodes) = 1),
steps AS (
  SELECT placed.*, subroot, q, 0 AS tree, level, p AS spot, nodes
  FROM placed JOIN subroots ON placed.lang IS NOT DISTINCT FROM subroots.lang JOIN levels ON placed.lang IS NOT DISTINCT FROM levels.lang
  UNION ALL SELECT placed.*, subroot, q, 1, level, q, nodes
  FROM placed JOIN subroots ON placed.lang IS NOT DISTINCT FROM subroots.lang CROSS JOIN tops
),
paths AS (
  SELECT doc_id, lang, p, any_value(leaf) AS leaf, any_value(tampered) AS tampered, any_value(subroot) AS subroot,
    list(CASE WHEN (spot >> level) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(nodes[xor(spot >> level, 1) + 1], '') ORDER BY tree, level)
      FILTER (len(nodes) > 1) AS path
  FROM steps GROUP BY doc_id, lang, p
),
folds AS (
  SELECT *, list_reduce([coalesce(tampered, leaf)] || coalesce(path, []), lambda node, s:
    sha256(CASE WHEN s[1] = 'L' THEN s[2:] || node ELSE node || s[2:] END)) AS folded_root
  FROM paths
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda s: s[2:]), ''), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified
FROM folds CROSS JOIN root
"""

# All phrases of all pieces, counted.
_COLLOCATIONS = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format('text')}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
),
runs AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM runs GROUP BY lang),
places AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
  FROM runs CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k)
),
counts AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM places GROUP BY ALL),
candidates AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM counts WHERE k > 1 AND f >= 30),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM candidates),
scores AS (
  SELECT c.lang, c.phrase, c.k, c.a, c.cut, x.f AS l, y.f AS r, (2000000 * c.a) // (x.f + y.f) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.cut], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1 :], ' ')
),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
spans AS (SELECT lang, a, w, k, unnest(range(2, k)) AS size FROM candidates),
inside AS (SELECT lang, a, unnest(list_transform(range(1, k - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS phrase FROM spans),
most AS (SELECT lang, phrase, max(a) AS most FROM inside GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN most USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

# Every window of every document, grouped.
_PASSAGES = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT r, unnest(list_transform(range(1, len(words) - 33), lambda i: {'i': i, 'w': array_to_string(words[i : i + 34], ' ')})) AS p FROM docs),
twice AS (SELECT p.w AS w FROM windows GROUP BY p.w HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(p.i, p.i + 35)) AS i FROM windows JOIN twice ON p.w = twice.w),
spots AS (SELECT r, unnest(list_transform(range(1, len(words) + 1), lambda i: {'i': i, 'x': words[i]})) AS s FROM docs),
kept AS (
  SELECT spots.r, count(gone.i) AS n_removed, string_agg(s.x, ' ' ORDER BY s.i) FILTER (gone.i IS NULL) AS kept
  FROM spots LEFT JOIN gone ON gone.r = spots.r AND gone.i = s.i GROUP BY spots.r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""

ORACLES: dict[str, str] = {
    "op3_jaccard": _JACCARD,
    "op6_licenses": licenses.oracle(),
    "op8_decontaminate": _DECONTAMINATE,
    "op9_embeddings": _EMBEDDINGS,
    "op11_manifest": _MANIFEST,
    "op12_collocations": _COLLOCATIONS,
    "op13_passages": _PASSAGES,
}
