"""Queries on texts: overlap with a benchmark, redaction; each beside the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwright.functions.types import big
from tarnwright.operators import neighbors, overlap, redaction
from tarnwright.plans.relational import query

# --- overlap with a benchmark

OVERLAP = r"""
WITH w AS (SELECT row_number() OVER () AS i, doc_id, [x FOR x IN string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
b AS (SELECT item_id, [x FOR x IN string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM benchmark WHERE item_id IS NOT NULL),
q AS (SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[k:k + 7], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 6, 2))) AS k FROM b WHERE len(w) > 0)),
g AS (SELECT i, k - 1 AS pos, n, array_to_string(w[k:k + n - 1], ' ') AS gram FROM (SELECT i, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM w, (SELECT DISTINCT n FROM q))),
h AS (SELECT DISTINCT i, item_id, pos, n FROM g JOIN q USING (n, gram)),
f AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY i, item_id ORDER BY pos) + n THEN 0 ELSE 1 END AS fresh FROM h),
s AS (SELECT i, item_id, min(pos) AS a, max(pos + n) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY i, item_id ORDER BY pos) AS island FROM f) GROUP BY i, item_id, island),
t AS (SELECT i, item_id, sum(e - a) AS covered, string_agg(a || '-' || e, ',' ORDER BY a) AS spans FROM s GROUP BY i, item_id)
SELECT doc_id, item_id, CAST(coalesce(covered, 0) AS BIGINT) AS covered, round(coalesce(covered / nullif(len(w), 0), 0), 6) AS share, coalesce(spans, '') AS spans FROM w LEFT JOIN t USING (i)
"""


@query(OVERLAP)
def benchmark_overlap(documents, benchmark):
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return overlap.overlap(documents, benchmark).select("doc_id", "item_id", big("covered").alias("covered"), F.round("share", 6).alias("share"), spans.alias("spans"))


# --- vector search

NEAREST = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 9) AS cosine FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, round(cosine, 6) AS cosine, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS BIGINT) AS place FROM p QUALIFY place <= 10
"""


@query(NEAREST)
def vector_search(embeddings):
    units = neighbors.units(embeddings, "vec_id", "embedding")
    found = neighbors.search(neighbors.index(units), units.filter("key % 20 = 0"), k=10)
    return found.select(F.col("query").alias("query_id"), F.col("key").alias("vec_id"), F.round("cosine", 6).alias("cosine"), big("place").alias("place"))


# --- redaction

# each kind's pattern, the first find first, and the check that finds x (d without spaces and hyphens) must pass
LUHN = "len(d) BETWEEN 13 AND 19 AND len(list_distinct(string_split(d, ''))) > 1 AND list_sum([CASE WHEN (len(d) - i) % 2 = 0 THEN CAST(d[i] AS BIGINT) WHEN CAST(d[i] AS BIGINT) > 4 THEN CAST(d[i] AS BIGINT) * 2 - 9 ELSE CAST(d[i] AS BIGINT) * 2 END FOR i IN range(1, len(d) + 1)]) % 10 = 0"
OCTETS = "len(string_split(x, '.')) = 4 AND len([p FOR p IN string_split(x, '.') IF len(p) > 3 OR TRY_CAST(p AS INTEGER) > 255]) = 0"
MIXED = "regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Fa-f]')"
MOD97 = "list_reduce([CAST(0 AS BIGINT)] || [CAST(CASE WHEN c < 'A' THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS BIGINT) FOR c IN string_split(b[5:] || b[:4], '')], lambda r, v: (r * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1"
PATTERNS = (
    r"[0-9A-Za-z._%+-]+@[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*\.[A-Za-z]{2,}",
    r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z])+",
    r"[0-9](?:[ -]?[0-9])*",
    r"(?:\+[0-9]+ )?\([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    r"[0-9]+(?:\.[0-9]+)+",
    r"[0-9A-Fa-f]{32,}",
)
# a find starts after the pieces and the finds before it
FOUND = " UNION ALL ".join(
    f"""SELECT i, {o} AS o, unnest(m) AS x, unnest([len(y) FOR y IN m]) AS n, unnest([list_sum([len(z) FOR z IN s[:k]]) + coalesce(list_sum([len(z) FOR z IN m[:k - 1]]), 0) FOR k IN range(1, len(m) + 1)]) AS a
FROM (SELECT i, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS s FROM w)"""
    for o, p in enumerate(PATTERNS)
)
# an account number is the longest start of its find that passes; of finds that overlap the longest is taken (ties: the first, then the kind), until none is left
REDACTED = f"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS i, doc_id, text FROM documents),
f AS MATERIALIZED ({FOUND}),
p AS (SELECT i, o, a, a + n AS e FROM (SELECT *, replace(replace(x, ' ', ''), '-', '') AS d FROM f WHERE o <> 1) WHERE CASE o WHEN 2 THEN {LUHN} WHEN 4 THEN {OCTETS} WHEN 5 THEN {MIXED} ELSE true END
UNION ALL SELECT i, 1, a, a + max(e) FROM (SELECT i, a, e, replace(x[:e], ' ', '') AS b FROM (SELECT *, unnest(range(15, n + 1)) AS e FROM f WHERE o = 1) WHERE x[e] <> ' ' AND (e = n OR x[e + 1] = ' ')) WHERE len(b) BETWEEN 15 AND 34 AND {MOD97} GROUP BY i, a),
t AS (SELECT i, list_reduce(list([{{'o': o, 'a': a, 'e': e}}] ORDER BY a - e, a, o), lambda t, f: CASE WHEN len([y FOR y IN t IF y.a < f[1].e AND f[1].a < y.e]) > 0 THEN t ELSE t || f END) AS t FROM p GROUP BY i)
SELECT doc_id, {", ".join(f"CAST(coalesce(len([y FOR y IN t IF y.o = {o}]), 0) AS BIGINT) AS {name}" for o, name in ((0, "emails"), (2, "cards"), (3, "phones"), (4, "addresses"), (5, "secrets")))} FROM w LEFT JOIN t USING (i)
"""


@query(REDACTED)
def redact_counts(documents):
    found = redaction.redact(documents.select("doc_id", "text"))
    of = lambda kind, name: big(F.size(F.filter("spans", lambda x: x["kind"] == kind))).alias(name)
    return found.select("doc_id", of("EMAIL", "emails"), of("CARD", "cards"), of("PHONE", "phones"), of("IP", "addresses"), of("SECRET", "secrets"))


@query(None)
def redact_documents(documents, benchmark):
    # benchmark texts are fixed strings, beside the personal data
    found = redaction.redact(documents.select("doc_id", "text"), benchmark.select("text"))
    spans = F.transform("spans", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"), x["kind"]))
    return found.select("doc_id", F.array_join(spans, ",").alias("spans"), "redacted")
