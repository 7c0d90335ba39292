"""DuckDB statements that say in SQL what two of the operators compute, for the whole tables."""

from __future__ import annotations


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::varchar)::varchar || ':' || {value}::varchar, '-')"


def _leaf(n_chars: str = "n_chars") -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


def crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of short text, bit by bit (reflected polynomial 0xEDB88320)."""
    bits = "list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(a, b))"
    octets = f"list_transform(range(1, strlen({text}) + 1), lambda p: ascii(substr({text}, p, 1))::bigint)"
    return f"xor(list_reduce({octets}, lambda a, b: {bits}, 4294967295::bigint), 4294967295)"


#: The trees level by level, the siblings of every row, and the fold from its leaf to the root.
MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS row, doc_id, lang, {_leaf()} AS leaf,
    CASE WHEN {crc32('doc_id::varchar')} % 7 = 0 THEN {_leaf('(n_chars + 1)')} ELSE {_leaf()} END AS begun
  FROM documents
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM leaves
), nodes(lang, h, i, n, node) AS (
  SELECT lang, 0::bigint, i, n, leaf FROM placed
  UNION ALL
  SELECT lang, h + 1, i // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, h, n, i // 2
), subroots AS MATERIALIZED (
  SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops(h, i, n, node) AS (
  SELECT 0::bigint, i, n, subroot FROM subroots
  UNION ALL
  SELECT h + 1, i // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY h, n, i // 2
), heights AS (SELECT DISTINCT lang, h FROM nodes WHERE n > 1
), near AS (
  SELECT p.row, t.h, (p.i >> t.h) % 2 = 1 AS is_left, s.node AS sibling
  FROM placed p JOIN heights t ON t.lang IS NOT DISTINCT FROM p.lang
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM p.lang AND s.h = t.h AND s.i = xor(p.i >> t.h, 1)
), far AS (
  SELECT p.row, 1000 + t.h AS h, (r.i >> t.h) % 2 = 1 AS is_left, s.node AS sibling
  FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang
  CROSS JOIN (SELECT DISTINCT h FROM tops WHERE n > 1) t
  LEFT JOIN tops s ON s.h = t.h AND s.i = xor(r.i >> t.h, 1)
), steps AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY h) AS k FROM (FROM near UNION ALL FROM far)
), proofs AS (SELECT row, string_agg(sibling, '' ORDER BY k) AS joined FROM steps GROUP BY row
), folds(row, k, node) AS (
  SELECT row, 0::bigint, begun FROM placed
  UNION ALL
  SELECT f.row, s.k, sha256(CASE WHEN s.is_left THEN coalesce(s.sibling, '') || f.node ELSE f.node || coalesce(s.sibling, '') END)
  FROM folds f JOIN steps s ON s.row = f.row AND s.k = f.k + 1
), ends AS (SELECT row, arg_max(node, k) AS folded_root FROM folds GROUP BY row)
SELECT p.doc_id, p.leaf, r.subroot, t.node AS root, sha256(coalesce(q.joined, '')) AS proof_sha256, e.folded_root, e.folded_root = t.node AS verified
FROM placed p
JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang
CROSS JOIN (SELECT node FROM tops WHERE n = 1) t
LEFT JOIN proofs q ON q.row = p.row
JOIN ends e ON e.row = p.row
"""


def rotated_clusters(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3") -> str:
    """Every distance of every round, over one row for each component."""
    out = f"""
WITH kept AS (
  SELECT row_number() OVER () AS v, vec_id, list_transform(embedding, lambda e: floor({scale} * e::double)::bigint) AS x
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}
), long_ AS MATERIALIZED (SELECT v, generate_subscripts(x, 1) AS i, unnest(x) AS x FROM kept
), c0 AS MATERIALIZED (
  SELECT c, generate_subscripts(x, 1) AS i, unnest(x) AS m
  FROM (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS c, x FROM kept QUALIFY c < {k})
)"""
    for r in range(rounds + 1):
        out += f""", a{r} AS MATERIALIZED (
  SELECT v, min(struct_pack(d := d, c := c)) AS best
  FROM (SELECT v, c, sum((x - m) * (x - m))::bigint AS d FROM long_ JOIN c{r} USING (i) GROUP BY v, c) GROUP BY v
)"""
        if r < rounds:
            out += f""", s{r} AS (
  SELECT best.c AS c, i, sum(x)::bigint AS s, count(*) AS n FROM long_ JOIN a{r} USING (v) GROUP BY ALL
), c{r + 1} AS MATERIALIZED (
  SELECT o.c, o.i, coalesce((s - ((s % n) + n) % n) // n, m)::bigint AS m FROM c{r} o LEFT JOIN s{r} s ON s.c = o.c AND s.i = o.i
)"""
    return out + f""", digests AS (SELECT c, sha256(string_agg(m::varchar, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, best.c::int AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::bigint AS cluster_inertia,
  (sum(best.d) OVER ())::bigint AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (v) JOIN digests ON digests.c = best.c
"""
