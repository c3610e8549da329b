"""DuckDB SQL for those queries that SQL can express on whole tables."""

from __future__ import annotations

#: words, shingles and Jaccard by an inverted index, spelled out in SQL
P1_FOUND = r"""
WITH w AS (
  SELECT spec_id, list_transform(regexp_extract_all(coalesce(title, '') || chr(10) || coalesce(statement, ''), '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w
  FROM problem_specs
), s AS (
  SELECT DISTINCT spec_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT spec_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 20)
), n AS (SELECT spec_id, count(*) AS n FROM s GROUP BY spec_id),
f AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
h AS (SELECT s.* FROM s JOIN f USING (g)),
c AS (SELECT a.spec_id AS a, b.spec_id AS b, count(*) AS c FROM h a JOIN h b ON a.g = b.g AND a.spec_id < b.spec_id GROUP BY 1, 2)
SELECT a AS spec_id_a, b AS spec_id_b FROM c JOIN n x ON x.spec_id = a JOIN n y ON y.spec_id = b WHERE 2 * c >= x.n + y.n - c
"""

_P1 = P1_FOUND.replace("WITH w AS", "WITH RECURSIVE w AS", 1)
P1_CLASSES = _P1[: _P1.rindex("SELECT a AS spec_id_a")].rstrip() + r""",
p AS (SELECT a, b FROM c JOIN n x ON x.spec_id = a JOIN n y ON y.spec_id = b WHERE 2 * c >= x.n + y.n - c),
k AS (SELECT spec_id, md5(string_agg(g, '|' ORDER BY g)) AS k FROM s GROUP BY spec_id),
m AS (SELECT spec_id, min(spec_id) OVER (PARTITION BY k) AS rep, count(*) OVER (PARTITION BY k) AS copies FROM k),
e AS (SELECT DISTINCT x.rep AS a, y.rep AS b FROM p JOIN m x ON x.spec_id = p.a JOIN m y ON y.spec_id = p.b WHERE x.rep <> y.rep),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT DISTINCT rep AS node, rep AS root FROM m UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node)
SELECT spec_id, (SELECT min(root) FROM r WHERE r.node = m.rep) AS class_id, copies, (SELECT count(*) FROM l WHERE l.a = m.rep) AS links FROM m
"""

_P2_COUNTS = r"""
WITH t AS (
  SELECT dimension, lower(trim(category)) AS category, CAST(round(target_share * 100) AS BIGINT) AS h, coalesce(min_rows, 0) AS m FROM sample_targets
), z AS (SELECT count(*) // 5 AS size FROM oracle_meta),
c AS (
  SELECT 'difficulty' AS dimension, lower(trim(difficulty)) AS category, count(*) AS n FROM oracle_meta GROUP BY 2
  UNION ALL SELECT 'source', lower(trim(source)), count(*) FROM oracle_meta GROUP BY 2
  UNION ALL SELECT 'tags', tag, count(DISTINCT oracle_id) FROM (SELECT oracle_id, lower(trim(unnest(tags))) AS tag FROM oracle_meta) GROUP BY 2
)
SELECT t.dimension, t.category FROM t CROSS JOIN z LEFT JOIN c ON c.dimension = t.dimension AND c.category = t.category
WHERE coalesce(c.n, 0) < greatest((t.h * size + 99) // 100, t.m)
"""

#: of the rows drawn: a category with no more rows than it needs is whole, and the size is a fifth of all rows
P2_MARGINS = _P2_COUNTS[: _P2_COUNTS.rindex("SELECT t.dimension")].replace("category, CAST(", "category, category AS label, CAST(", 1) + r""",
g AS (SELECT t.dimension, t.category, t.label, greatest((t.h * size + 99) // 100, t.m) AS need, coalesce(c.n, 0) AS available, size FROM t CROSS JOIN z LEFT JOIN c ON c.dimension = t.dimension AND c.category = t.category),
f AS (SELECT *, available <= need AND (dimension = 'tags' OR sum(least(available, need)) OVER (PARTITION BY dimension) <= size) AS flagged FROM g),
v AS (
  SELECT oracle_id, 'difficulty' AS dimension, lower(trim(difficulty)) AS category FROM oracle_meta
  UNION ALL SELECT oracle_id, 'source', lower(trim(source)) FROM oracle_meta UNION ALL SELECT oracle_id, 'tags', lower(trim(unnest(tags))) FROM oracle_meta
), q AS (SELECT count(DISTINCT oracle_id) AS scarce FROM v JOIN f USING (dimension, category) WHERE flagged)
SELECT dimension, label AS category, need, available, CASE WHEN flagged AND scarce <= size THEN available END AS whole, size, size AS ids FROM f CROSS JOIN q
"""

P6_FOUND = r"""
WITH w AS (
  SELECT case_id, suite = 'repair' AS train, regexp_extract_all(coalesce(stdin, ''), '\S+') AS a, regexp_extract_all(coalesce(expected_stdout, ''), '\S+') AS b
  FROM test_cases WHERE suite IS NOT NULL
), p AS (SELECT case_id, train, list_concat(a, b) AS w FROM w WHERE len(a) >= 12),
s AS (
  SELECT DISTINCT case_id, train, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT case_id, train, w, unnest(range(1, len(w) - 1)) AS i FROM p)
), n AS (SELECT case_id, count(*) AS n FROM s GROUP BY case_id),
c AS (SELECT e.case_id AS e, t.case_id AS t, count(*) AS c FROM s e JOIN s t ON e.g = t.g AND NOT e.train AND t.train GROUP BY 1, 2)
SELECT least(e, t) AS case_id_a, greatest(e, t) AS case_id_b FROM c JOIN n x ON x.case_id = e JOIN n y ON y.case_id = t
WHERE 10 * c >= 6 * (x.n + y.n - c)
"""


_P6 = P6_FOUND[: P6_FOUND.index("SELECT least(")]
P6_REPORT = _P6 + r"""
, l AS (SELECT e, max(c.c / x.n) AS containment, bool_or(c.c = x.n AND c.c = y.n) AS same FROM c JOIN n x ON x.case_id = e JOIN n y ON y.case_id = t WHERE 10 * c.c >= 6 * (x.n + y.n - c.c) GROUP BY e)
SELECT suite, source, count(*) AS rows, count(l.e) AS overlapping, count(*) FILTER (l.containment >= 1) AS contained, count(*) FILTER (l.same) AS exact
FROM test_cases k LEFT JOIN l ON l.e = k.case_id WHERE suite IS NOT NULL AND suite <> 'repair' GROUP BY suite, source
"""

#: windows of the least length, item against document, for each language's units
_LEAKS = r"""
WITH i AS (SELECT item_id, lower(lang) AS lang, CASE WHEN lower(lang) = 'zh' THEN regexp_replace(lower(text), '([\x{4E00}-\x{9FFF}])', ' \1 ', 'g') ELSE lower(text) END AS x FROM eval_items WHERE lower(lang) IN ('en', 'zh') AND text IS NOT NULL),
iu AS (SELECT item_id, lang, CASE WHEN lang = 'zh' THEN 25 ELSE 12 END AS k, regexp_extract_all(x, '[\p{L}\p{N}]+') AS u FROM i),
ig AS (SELECT DISTINCT item_id, lang, array_to_string(u[j : j + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(u) - k + 2)) AS j FROM iu)),
du AS (
  SELECT doc_id, 'en' AS lang, 12 AS k, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS u FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, 'zh', 25, regexp_extract_all(regexp_replace(lower(text), '([\x{4E00}-\x{9FFF}])', ' \1 ', 'g'), '[\p{L}\p{N}]+') FROM documents WHERE text IS NOT NULL
), dg AS (SELECT doc_id, lang, array_to_string(u[j : j + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(u) - k + 2)) AS j FROM du)),
hit AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (lang, g))
"""
#: the same windows with their places; a match is a run of windows on one diagonal
P8_ITEMS = _LEAKS[: _LEAKS.index("hit AS (")].replace("SELECT DISTINCT item_id, lang,", "SELECT item_id, lang, k, j,", 1).replace("SELECT doc_id, lang, array_to_string", "SELECT doc_id, lang, j, array_to_string", 1) + r"""
h AS (SELECT doc_id, item_id, ig.k, dg.j - ig.j AS diagonal, dg.j AS j FROM dg JOIN ig USING (lang, g)),
o AS (SELECT *, j - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY j) AS island FROM h),
x AS (SELECT doc_id, item_id, count(*) + any_value(k) - 1 AS units FROM o GROUP BY doc_id, item_id, diagonal, island)
SELECT item_id, count(DISTINCT doc_id) AS documents, max(units) AS longest FROM x GROUP BY item_id
"""
P8_FOUND = _LEAKS + "SELECT doc_id, item_id FROM hit"
P8_CLEAN = _LEAKS + "SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hit)"


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_classes": P1_CLASSES, "p2_found": _P2_COUNTS, "p2_margins": P2_MARGINS, "p6_found": P6_FOUND, "p6_report": P6_REPORT, "p8_found": P8_FOUND, "p8_items": P8_ITEMS, "p8_clean": P8_CLEAN}
