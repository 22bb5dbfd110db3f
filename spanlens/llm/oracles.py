"""SQL for DuckDB with the results of the operators that hash, by exact joins over whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _reach(nodes: str, key: str, links: str) -> str:
    """CTE `reach` (id, c): what each node reaches over links (a, b)."""
    return f"""sides AS (SELECT a, b FROM {links} UNION ALL SELECT b, a FROM {links}),
reach(id, c) AS (SELECT {key}, {key} FROM {nodes} UNION SELECT reach.id, sides.b FROM reach JOIN sides ON sides.a = reach.c)"""


OP3_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
{_reach('embeddings', 'vec_id', 'links')}, n AS (SELECT a AS vec_id, count(*) AS n FROM sides GROUP BY 1), c AS (SELECT id AS vec_id, min(c) AS component_id FROM reach GROUP BY 1)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)"""

OP4_SQL = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w),
g AS (SELECT doc_id, word || ' ' || lead(word, 1) OVER x || ' ' || lead(word, 2) OVER x AS g FROM t WINDOW x AS (PARTITION BY doc_id ORDER BY pos)),
s AS (SELECT DISTINCT doc_id, g FROM g WHERE g IS NOT NULL UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 2),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_n FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_n >= 85 * (x.n + y.n - both_n)),
{_reach('documents', 'doc_id', 'links')}, c AS (SELECT id AS doc_id, min(c) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""


def _grams(source: str, key: str, length: int) -> str:
    said = " || ' ' || ".join(["word", *(f"lead(word, {i}) OVER x" for i in range(1, length))])
    return f"SELECT {key}, pos, {length} AS n, {said} AS g FROM {source} WHERE {length} IN (SELECT n FROM lengths) WINDOW x AS (PARTITION BY {key} ORDER BY pos)"


_ALNUM = r"[\x00-/:-`{-\x7F]+"
OP5_SQL = f"""WITH d AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '{_ALNUM}'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex({_LOWER}, '{_ALNUM}'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
lengths AS (SELECT DISTINCT least(len(w), 10) AS n FROM b WHERE len(w) > 0),
dt AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d), bt AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM b),
dg AS ({" UNION ALL ".join(_grams("dt", "doc_id", n) for n in range(1, 11))}),
bg AS (SELECT DISTINCT x.item_id, n, g FROM ({" UNION ALL ".join(_grams("bt", "item_id", n) for n in range(1, 11))}) x JOIN b ON b.item_id = x.item_id WHERE g IS NOT NULL AND n = least(len(b.w), 10)),
m AS (SELECT doc_id, pos, n, item_id FROM dg JOIN bg USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM (SELECT DISTINCT doc_id, pos, n FROM m)) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)"""
