"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnwright.llm import bpe, embedding_dedup, exact_dedup, html_extract, language_id, license_scan, ngram_join, packing, periodic_runs, positional_index, quality, url_filter, vector_codes
from tarnwright.llm.shared import small_batches
from tarnwright.llm.shared import table as stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, in a session whose Arrow batches are bounded by bytes."""
    small_batches(spark)
    return stored(spark, sf_dir, name)


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The rules of the URL query: verdict, host, start of the path.
RULES: list[url_filter.Rule] = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page: extract() of html_extract, which says what nulls, empty, repeated and clashing columns give."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences of every document: a digest of license_scan.scan(), which says what nulls, empty and repeated rows give."""
    return license_scan.digest(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at a cosine of 0.93: near_duplicates(), which says what nulls, repeats and ties give."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of 2048 tokens: pack(), which says what nulls, empty and repeated rows give."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), cache=600_000)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of every document and whether the draw takes it: resample(), which says what nulls, ties and repeats give."""
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every page: judge(), which says what null urls, ties of rules, repeats and empty tables give."""
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document: exact_groups(), which says what nulls, repeats and ties give."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document by four-word shingles at 0.85: join(), which says what nulls and repeats give."""
    return ngram_join.join(table(spark, sf_dir, "documents"), words=4, percent=85)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document: identify(), which says what nulls, texts without letters, ties and repeats give."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and the decoded text of every document: digests(), which says what nulls and repeats give."""
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document hit by benchmark windows of ten words: contamination(), which says what nulls and repeats give."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return positional_index.digest(positional_index.contamination(docs, items))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document's words, a tenth of them with repeated tails: periodic_runs(), which says what nulls and repeats give."""
    docs = periodic_runs.with_periodic_tails(table(spark, sf_dir, "documents"))
    return periodic_runs.digest(periodic_runs.periodic_runs(docs))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product code of every vector: encode(), which says what nulls, ties, repeats and other lengths give."""
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_license_scan": op2_license_scan,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_packing": op4_packing,
    "op5_quality": op5_quality,
    "op6_url_filter": op6_url_filter,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_ngram_join": op8_ngram_join,
    "op9_language_id": op9_language_id,
    "op10_bpe": op10_bpe,
    "op11_decontamination": op11_decontamination,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_vector_codes": op13_vector_codes,
}

OP7_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)
"""

OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS i, doc_id,
    [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS words
  FROM documents
), g AS (
  SELECT DISTINCT i, CASE WHEN len(words) < 4 THEN array_to_string(words, ' ') ELSE array_to_string(words[k:k + 3], ' ') END AS shingle
  FROM (SELECT i, words, unnest(range(1, greatest(len(words) - 2, 2))) AS k FROM w WHERE len(words) > 0)
), n AS (SELECT i, count(*) AS n FROM g GROUP BY i), p AS (
  SELECT x.i AS a, y.i AS b, count(*) AS shared FROM g x JOIN g y ON x.shingle = y.shingle AND x.i <> y.i GROUP BY x.i, y.i
), l AS (
  SELECT a, b FROM p JOIN n x ON x.i = p.a JOIN n y ON y.i = p.b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), r AS (SELECT i AS a, i AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a AS i, min(w.doc_id) AS component_id FROM r JOIN w ON w.i = r.b GROUP BY r.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM w JOIN c USING (i) LEFT JOIN n USING (i)
"""

OP6_SQL = r"""
WITH RECURSIVE u AS (
  SELECT row_number() OVER () AS i, page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT i, page_id, html, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u
), rules(verdict, rhost, rpath, place) AS (VALUES ('block', 'net', '/', 1), ('allow', 'example.net', '/en/', 2), ('block', 'example.com', '/de/', 3), ('allow', 'org', '/fr/', 4)),
f AS (
  SELECT h.i, arg_max(rhost || rpath, length(rhost || rpath) * 10 - place) AS rule, arg_max(verdict, length(rhost || rpath) * 10 - place) AS verdict
  FROM h JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY h.i
), r AS (SELECT h.*, f.rule, f.verdict FROM h LEFT JOIN f USING (i)),
seeds AS (
  SELECT host, avg(CAST(coalesce(verdict, '') = 'allow' AS DOUBLE)) AS trust, avg(CAST(coalesce(verdict, '') = 'block' AS DOUBLE)) AS distrust FROM r WHERE host <> '' GROUP BY host
), t AS (
  SELECT host AS src, translate(regexp_extract(regexp_extract(link, '//(.*)', 1, 's'), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
  FROM (SELECT host, unnest(regexp_extract_all(html, '[ 	-
]href[ 	-
]*=[ 	-
]*["'']?[ 	-
]*((?:[a-z][a-z0-9+.-]*:)?//[^"'' 	-
>]+)', 1, 'i')) AS link FROM r)
), l AS (SELECT src, dst, count(*) AS n FROM t WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
e AS (
  SELECT 'trust' AS kind, src, dst, 0.85 * n / sum(n) OVER (PARTITION BY src) AS weight FROM l
  UNION ALL SELECT 'distrust', dst, src, 0.85 * n / sum(n) OVER (PARTITION BY dst) FROM l
), s AS (
  SELECT 'trust' AS kind, host, trust AS value, 0 AS k FROM seeds WHERE trust > 0
  UNION ALL SELECT 'distrust', host, distrust, 0 FROM seeds WHERE distrust > 0
), p AS (
  SELECT kind, host, value, k FROM s
  UNION ALL SELECT e.kind, e.dst, sum(e.weight * p.value), p.k + 1 FROM p JOIN e ON e.kind = p.kind AND e.src = p.host WHERE p.k < 120 GROUP BY e.kind, e.dst, p.k
), v AS (SELECT host, sum(value) FILTER (WHERE kind = 'trust') AS trust, sum(value) FILTER (WHERE kind = 'distrust') AS distrust FROM p GROUP BY host)
SELECT page_id, r.host, path, rule, coalesce(verdict, CASE WHEN coalesce(v.distrust, 0) - coalesce(v.trust, 0) >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN v ON v.host = r.host
"""

OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), q AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + 9], ' ') AS phrase FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS k FROM b WHERE len(w) > 0)
), g AS (
  SELECT i, k, n, array_to_string(w[k:k + n - 1], ' ') AS phrase FROM (SELECT i, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM q))
), h AS (SELECT i, k, n, item_id FROM g JOIN q USING (n, phrase)),
c AS (SELECT i, count(DISTINCT p) AS n_hit FROM (SELECT i, unnest(range(k, k + n)) AS p FROM h) GROUP BY i),
t AS (SELECT i, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT i, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY i)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (i) LEFT JOIN t USING (i)
"""

def _lloyd_sql(rounds: int) -> str:
    """The rounds one after another: c are codebooks, a assignments (squared distance * 64 + entry, the least of all)."""
    assign = "a{r} AS (SELECT i, p, min(list_sum([(x[j] - c[j]) * (x[j] - c[j]) FOR j IN [1, 2, 3, 4]]) * 64 + k) AS m FROM x JOIN c{r} USING (p) GROUP BY i, p)"
    mean = "CASE WHEN n > 0 THEN [(s[j] - (s[j] % n + n) % n) // n FOR j IN [1, 2, 3, 4]] ELSE c END"
    sums = "SELECT p, m % 64 AS k, CAST(count(*) AS BIGINT) AS n, [CAST(sum(x[1]) AS BIGINT), CAST(sum(x[2]) AS BIGINT), CAST(sum(x[3]) AS BIGINT), CAST(sum(x[4]) AS BIGINT)] AS s FROM a{r} JOIN x USING (i, p) GROUP BY p, m % 64"
    move = f"c{{s}} AS (SELECT p, k, {mean} AS c FROM c{{r}} LEFT JOIN ({sums}) USING (p, k))"
    steps = [part.format(r=r, s=r + 1) for r in range(rounds) for part in (assign, move)]
    return f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, label, [CAST(floor(256 * x) AS BIGINT) FOR x IN CAST(embedding AS DOUBLE[])] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), x AS (SELECT i, p, e[4 * p + 1:4 * p + 4] AS x FROM v, range(16) AS t(p)),
c0 AS (SELECT p, i - 1 AS k, x AS c FROM x WHERE i <= 64),
{", ".join(steps)},
{assign.format(r=rounds)},
o AS (SELECT i, string_agg(printf('%02x', m % 64), '' ORDER BY p) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a{rounds} GROUP BY i)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) FROM c{rounds}) AS codebooks_sha256
FROM v JOIN o USING (i)
"""


SQL: dict[str, str] = {"op6_url_filter": OP6_SQL, "op3_embedding_dedup": OP3_SQL, "op7_exact_dedup": OP7_SQL, "op8_ngram_join": OP8_SQL, "op11_decontamination": OP11_SQL, "op13_vector_codes": _lloyd_sql(2)}
