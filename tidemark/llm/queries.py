"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from tidemark.llm import cotraining, curve_packing, jaccard, mixing, packing, periodic_runs, pii, quality, sharding, simplex_clusters, suffix_dedup, vectors, window_dedup


def queries() -> dict:
    return {
        "op1_skip_chain_pii": pii.query,
        "op2_suffix_dedup": suffix_dedup.query,
        "op3_weak_supervision": quality.query,
        "op4_super_kmer_dedup": window_dedup.query,
        "op5_best_fit_packing": packing.query,
        "op6_source_mixing": mixing.query,
        "op7_cotraining": cotraining.query,
        "op8_lookup_sharding": sharding.query,
        "op9_grouped_prefix_join": jaccard.query,
        "op10_quantised_vectors": vectors.query,
        "op11_curve_packing": curve_packing.query,
        "op12_periodic_runs": periodic_runs.query,
        "op13_simplex_clusters": simplex_clusters.query,
    }


_WORDS = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP4 = f"""WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
win AS (SELECT rid, doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS s FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
least AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s),
gone AS (SELECT DISTINCT rid, i + k AS p FROM (SELECT win.rid, win.i FROM win JOIN least ON win.s = least.s WHERE win.doc_id > least.d), (SELECT unnest(range(0, 13)) AS k)),
word AS (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT word.rid, count(*) AS n, string_agg(word, ' ' ORDER BY word.p) AS t FROM word LEFT JOIN gone ON gone.rid = word.rid AND gone.p = word.p WHERE gone.rid IS NULL GROUP BY word.rid)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.rid = w.rid"""

_OP9 = f"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce({_LOWER}, ''), {_WORDS}) AS ws FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(list_slice(ws, i, i + 3), ' ') AS g FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
both_have AS (SELECT a.rid AS a, b.rid AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY a.rid, b.rid),
link AS (SELECT a, b FROM both_have JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach(a, b) AS (SELECT rid, rid FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM w LEFT JOIN n ON n.rid = w.rid
JOIN (SELECT reach.a AS rid, min(x.doc_id) AS component_id FROM reach JOIN w x ON x.rid = reach.b GROUP BY reach.a) c ON c.rid = w.rid"""

_OP10 = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE label IS NOT NULL AND e IS NOT NULL),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT v.vec_id, coalesce(l.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) l ON l.a = v.vec_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = v.vec_id"""


def _op13(k: int = simplex_clusters.CENTROIDS, rounds: int = simplex_clusters.ROUNDS, seed: int = simplex_clusters.SEED) -> str:
    """Rounds one after the other, all vectors against all centroids."""
    nearest = """a{r} AS MATERIALIZED (SELECT rid, arg_min(c, d * 1000 + c) AS c, min(d) AS d
FROM (SELECT rid, c, CAST(list_dot_product(v.x, v.x) + list_dot_product(c{r}.x, c{r}.x) - 2 * list_dot_product(v.x, c{r}.x) AS BIGINT) AS d FROM v, c{r}) GROUP BY rid)"""
    moved = """c{s} AS MATERIALIZED (SELECT c, list(m ORDER BY j) AS x FROM (SELECT c, j, floor(sum(v.x[j]) / count(*)) AS m FROM a{r} JOIN v USING (rid), (SELECT unnest(range(1, 65)) AS j) GROUP BY c, j) GROUP BY c
UNION ALL SELECT c, x FROM c{r} WHERE c NOT IN (SELECT c FROM a{r}))"""
    steps = [f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS x FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS c, x FROM v ORDER BY sha256('{seed}:' || vec_id), x LIMIT {k})"]
    for r in range(rounds):
        steps += [nearest.format(r=r), moved.format(r=r, s=r + 1)]
    steps += [nearest.format(r=rounds), f"i AS (SELECT c, sum(d) AS n FROM a{rounds} GROUP BY c)"]
    text = f"(SELECT c, sha256(array_to_string(list_transform(x, lambda e: CAST(e AS BIGINT)), ',')) AS name FROM c{rounds})"
    return ", ".join(steps) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(i.n AS BIGINT) AS cluster_inertia, CAST((SELECT sum(n) FROM i) AS BIGINT) AS inertia, name AS centroid_sha256
FROM a{rounds} a JOIN v USING (rid) JOIN i ON i.c = a.c JOIN {text} t ON t.c = a.c"""


def oracle_sql() -> dict[str, str]:
    """The other queries need hashes, tokenisers, fitted models or byte strings that SQL has not, or not fast enough."""
    return {"op4_super_kmer_dedup": _OP4, "op9_grouped_prefix_join": _OP9, "op10_quantised_vectors": _OP10, "op13_simplex_clusters": _op13()}
