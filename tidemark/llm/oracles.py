"""SQL of the queries that SQL can express, for DuckDB over views of the tables."""

from __future__ import annotations

from collections.abc import Mapping

#: A word, and the letters that are lower-cased.
_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def embedding_dedup(threshold: float = 0.93) -> str:
    """Links by the cosine in double precision, and what they reach."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {threshold}),
    r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON r.vec_id = l.a),
    c AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
    SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)"""


def sharding(seed: int = 17, shards: int = 8) -> str:
    """Proportional stratified interleaving. The CRC-32 is taken bit by bit, the low bit of each byte first."""
    byte = "list_transform(range(len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS INTEGER))"
    bits = f"flatten(list_transform({byte}, lambda b: list_transform(range(8), lambda k: CAST((b >> k) & 1 AS BIGINT))))"
    crc = f"xor(list_reduce({bits}, lambda c, b: xor(c >> 1, CASE WHEN xor(c & 1, b) = 1 THEN 3988292384 ELSE 0 END), CAST(4294967295 AS BIGINT)), 4294967295)"
    return f"""WITH d AS (SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h, md5('{seed}:' || doc_id) AS k, coalesce('=' || source, '') AS s FROM documents),
    c AS (SELECT doc_id, source, size, s, k, CAST(CASE WHEN h = '' THEN 0 ELSE {crc} END AS BIGINT) AS text_crc32 FROM d),
    f AS (SELECT *, (2 * (row_number() OVER (PARTITION BY s ORDER BY k, doc_id, text_crc32, size) - 1) + 1) / (2 * count(*) OVER (PARTITION BY s))::DOUBLE AS f FROM c),
    p AS (SELECT *, row_number() OVER (ORDER BY f, s, k, doc_id, text_crc32, size) - 1 AS p, count(*) OVER () AS n FROM f)
    SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(p * {shards} // n AS INTEGER) AS shard, CAST(p - ((p * {shards} // n) * n + {shards - 1}) // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source FROM p"""


def _case(column: str, values: Mapping[str, float], other: float) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


def mixing(domains: Mapping[str, list[int]], weights: Mapping[str, Mapping[str, float]], other: float, share: float, epochs: int, seed: int = 29) -> str:
    """Hierarchical budgets from the root down, and the token-prefix of each leaf's last epoch."""
    domain = "CASE " + " ".join(f"WHEN source IN ({', '.join(repr(f'src{n}') for n in numbers)}) THEN '{k}'" for k, numbers in domains.items()) + " ELSE 'other' END"
    steps, levels = [], ["domain", "lang", "source"]
    for depth, level in enumerate(levels):
        parents, path = levels[:depth], levels[: depth + 1]
        by = f"PARTITION BY {', '.join(parents)}" if parents else ""
        weight = _case(level, weights[level], other) if level in weights else str(other)
        given = f"floor((SELECT sum(leaf_tokens) FROM leaf) * {share})" if not depth else f"(SELECT share FROM share{depth - 1} p WHERE {' AND '.join(f'p.{c} = n.{c}' for c in parents)})"
        steps.append(
            f"""node{depth} AS (SELECT {', '.join(path)}, sum(leaf_tokens) * {epochs} AS cap, CAST({weight} AS DOUBLE) AS w FROM leaf GROUP BY {', '.join(path)}),
    lined{depth} AS (SELECT *, CAST({given} AS DOUBLE) AS budget, coalesce(sum(cap) OVER ({by} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier,
      sum(w) OVER ({by} ORDER BY cap / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead FROM node{depth} n),
    full{depth} AS (SELECT *, cap / w * ahead <= budget - earlier AS full_ FROM lined{depth}),
    share{depth} AS (SELECT {', '.join(path)}, CASE WHEN full_ THEN cap ELSE w * (budget - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER ({by})) / sum(CASE WHEN full_ THEN 0 ELSE w END) OVER ({by}) END AS share FROM full{depth})"""
        )
    return f"""WITH doc AS (SELECT doc_id, {domain} AS domain, lang, source, len(regexp_extract_all(text, '{_WORD}')) AS n_tokens FROM documents),
    leaf AS (SELECT domain, lang, source, sum(n_tokens) AS leaf_tokens FROM doc GROUP BY ALL),
    {', '.join(steps)},
    plan AS (SELECT domain, lang, source, CAST(leaf_tokens AS BIGINT) AS leaf_tokens, CAST(floor(share + 0.000001) AS BIGINT) AS leaf_budget FROM leaf JOIN share2 USING (domain, lang, source)),
    keyed AS (SELECT *, CASE WHEN leaf_tokens > 0 THEN leaf_budget // leaf_tokens ELSE 0 END AS whole, CASE WHEN leaf_tokens > 0 THEN leaf_budget % leaf_tokens ELSE 0 END AS rest FROM doc JOIN plan USING (domain, lang, source)),
    placed AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}:' || whole || ':' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM keyed)
    SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens, leaf_tokens, leaf_budget, CAST(whole + CASE WHEN earlier < rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM placed"""


def line_dedup(parts: int = 4, of: int = 5) -> str:
    """Lines that no earlier line matches at a Jaccard similarity of ``parts`` in ``of``; pairs meet at the rarest tokens, as any match shares one of these."""
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT k, doc_id, n - 1 AS n, list_distinct(regexp_extract_all({_LOWER.format('lines[n]')}, '{_WORD}')) AS t FROM (SELECT k, doc_id, lines, unnest(range(1, len(lines) + 1)) AS n FROM d)),
    w AS (SELECT *, row_number() OVER (ORDER BY doc_id, n, k) AS i, len(t) AS size FROM l WHERE len(t) > 0),
    u AS (SELECT i, doc_id, n, size, unnest(t) AS tok FROM w WHERE doc_id IS NOT NULL), df AS (SELECT tok, count(*) AS c FROM u GROUP BY tok),
    r AS (SELECT i, doc_id, n, size, tok, row_number() OVER (PARTITION BY i ORDER BY c, tok) AS p FROM u JOIN df USING (tok)),
    x AS (SELECT i, doc_id, n, size, tok FROM r WHERE p <= size - (size * {parts} + {of - 1}) // {of} + 1),
    m AS (SELECT DISTINCT a.i AS i, b.i AS j FROM x a JOIN x b ON a.tok = b.tok AND (b.doc_id < a.doc_id OR b.doc_id = a.doc_id AND b.n < a.n) AND b.size * {parts} <= a.size * {of} AND a.size * {parts} <= b.size * {of}),
    gone AS (SELECT DISTINCT m.i FROM m JOIN w a ON a.i = m.i JOIN w b ON b.i = m.j WHERE len(list_intersect(a.t, b.t)) * {of} >= (a.size + b.size - len(list_intersect(a.t, b.t))) * {parts}),
    stays AS (SELECT DISTINCT doc_id, n FROM w WHERE doc_id IS NOT NULL AND i NOT IN (SELECT i FROM gone)),
    f AS (SELECT w.k, w.n, w.doc_id IS NULL OR s.n IS NOT NULL AS stay FROM w LEFT JOIN stays s ON w.doc_id = s.doc_id AND w.n = s.n),
    g AS (SELECT k, count(*) AS n_lines, count(*) FILTER (stay) AS n_kept, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) FILTER (stay) AS kept FROM f GROUP BY k)
    SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_kept, 0) AS n_kept, coalesce(n_lines - n_kept, 0) AS n_removed, coalesce(kept, '') AS kept_lines FROM d LEFT JOIN g USING (k)"""
