"""The operators' queries over the tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import clusters
from .common import read_table
from .exact_dedup import exact_dedup
from .html_extract import main_text
from .language_id import identify
from .minhash_join import minhash_join
from .mixing import plan
from .ngram_join import ngram_join
from .phrases import collocations
from .quality import assess
from .sentencepiece_codec import digest
from .sharding import assign
from .substring_dedup import repeats
from .url_filter import judge

URL_RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
SHARDS = tuple(f"shard-{n:03d}" for n in range(64))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan(read_table(spark, sf_dir, "documents"))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda total, p: total + p["words"])
    first = F.floor(F.get("passes", F.lit(0))["position"] * 1e9).cast("long")
    return planned.select("doc_id", "size", "source_size", "target", taken.alias("taken"), first.alias("first_position")).orderBy("first_position", "doc_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(read_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"), URL_RULES)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return assign(docs, "doc_id", SHARDS).select("doc_id", F.col("shard_slot").cast("long").alias("slot"), F.col("shard").cast("long").alias("shard"), "shard_name")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op8_url_filter": op8_url_filter,
    "op10_sharding": op10_sharding,
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORD = r"'[^\x20\x09-\x0D]+'"

ORACLES: dict[str, str] = {
    "op1_mixing": rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(k % 3)::INT + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
t AS (SELECT sum(source_size) * 1.5::DOUBLE AS budget FROM s),
f AS (SELECT a.k, sum(least(b.cap, a.cap / a.weight * b.weight)) < any_value(t.budget) AS is_full FROM w a, w b, t GROUP BY a.k),
r AS (SELECT any_value(t.budget) - coalesce(sum(cap) FILTER (is_full), 0) AS rest, sum(weight) FILTER (NOT is_full) AS sharing FROM w JOIN f USING (k), t),
g AS (SELECT w.*, CASE WHEN is_full THEN cap ELSE weight * r.rest / r.sharing END AS target FROM w JOIN f USING (k), r),
o AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.k, floor(g.target + 0.5)::BIGINT AS lim,
             (sum(d.size) OVER (PARTITION BY g.k ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS off
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
p AS (SELECT *, greatest(0, least(size, lim - off)) + greatest(0, least(size, lim - off - source_size)) AS taken, (off + size / 2.0::DOUBLE) / target AS share FROM o),
v AS (SELECT *, [4.5::DOUBLE, 0.5::DOUBLE, 2.0::DOUBLE][(k % 3)::INT + 1] AS w0, [1.5::DOUBLE, 1.5::DOUBLE, 2.0::DOUBLE][(k % 3)::INT + 1] AS w1, share * [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(k % 3)::INT + 1] AS need FROM p)
SELECT doc_id, size::BIGINT AS size, source_size, target, taken::BIGINT AS taken,
       CASE WHEN taken > 0 THEN floor(least(2.0::DOUBLE * need / (w0 + sqrt(greatest(w0 * w0 + 2 * (w1 - w0) * need, 0))), 1.0::DOUBLE) * 1e9)::BIGINT END AS first_position
FROM v""",
    "op2_exact_dedup": f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), {_AZ}) AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g USING (t)""",
    "op3_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, {_WORD}) AS words FROM d),
i AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM i),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM c, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, {_WORD}) GROUP BY doc_id),
m AS (SELECT doc_id, text, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM w LEFT JOIN r USING (doc_id) LEFT JOIN u USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND n_symbols <= 0.2 * n_words
       AND len(regexp_extract_all(text, '\p{{Lu}}')) <= 0.5 * len(regexp_extract_all(text, '\p{{L}}'))
       AND len(regexp_extract_all(text, '!')) <= 0.3 * n_words
       AND len(regexp_extract_all(text, '[\p{{L}}\p{{M}}]+')) >= 0.5 * n_words
       AND len(list_filter(regexp_extract_all(text, {_WORD}), lambda x: length(x) >= 60)) <= 0.1 * n_words
       AND len(regexp_extract_all(text, '[\x00-\x08\x0E-\x1F\x7F\x{{FFFD}}]')) <= 0.1 * n_words AS kept
FROM b""",
    "op8_url_filter": f"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_AZ}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(verdict, rule_host, rule_path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT h.*, r.rule_host || r.rule_path AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST, length(r.rule_host) DESC) AS n
      FROM h LEFT JOIN r ON (h.host = r.rule_host OR ends_with(h.host, '.' || r.rule_host)) AND starts_with(h.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1""",
}


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES["op5_sentencepiece"] = op5_sentencepiece


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read_table(spark, sf_dir, "documents"))


QUERIES["op7_ngram_join"] = op7_ngram_join


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))


QUERIES["op6_language_id"] = op6_language_id


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(read_table(spark, sf_dir, "documents")).drop("name")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages"))


QUERIES |= {"op4_substring_dedup": op4_substring_dedup, "op9_html_extract": op9_html_extract}


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(read_table(spark, sf_dir, "embeddings"))


def op12_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join(read_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


QUERIES |= {"op11_centroids": op11_centroids, "op12_minhash_join": op12_minhash_join, "op13_collocations": op13_collocations}


def _centroid_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """The rounds, written out one after the other."""
    near = """SELECT vec_id, v, c.cluster, c.centroid, list_sum(list_transform(list_zip(v, c.centroid), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance
         FROM {rows}, {centers} c"""
    place = f"SELECT vec_id, v, arg_min({{{{'c': cluster, 'd': distance}}}}, distance * {k} + cluster) AS best FROM ({near}) GROUP BY vec_id, v"
    out = [
        f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, v AS centroid FROM (SELECT sha256('2:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {k}))",
    ]
    for n in range(rounds + 1):
        out.append(f"a{n} AS MATERIALIZED ({place.format(rows='kept', centers=f'c{n}')})")
        if n < rounds:
            out.append(f"""c{n + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.centroid, c.centroid) AS centroid FROM c{n} c LEFT JOIN (
      SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS centroid FROM (
        SELECT best.c AS cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{n}, (SELECT unnest(range(1, {dims + 1})) AS i) GROUP BY best.c, i) GROUP BY cluster) m USING (cluster))""")
    return f"""WITH {', '.join(out)}
SELECT vec_id, best.c::INT AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.centroid, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.cluster = best.c"""


ORACLES["op11_centroids"] = _centroid_sql()
ORACLES["op13_collocations"] = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT id, lang, generate_subscripts(pieces, 1) AS pc, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM d),
i AS (SELECT id, lang, pc, generate_subscripts(w, 1) AS i, unnest(w) AS x1 FROM p),
y AS (SELECT lang, x1, lead(x1, 1) OVER z AS x2, lead(x1, 2) OVER z AS x3, lead(x1, 3) OVER z AS x4, lead(x1, 4) OVER z AS x5 FROM i WINDOW z AS (PARTITION BY id, pc ORDER BY i)),
g AS (SELECT lang, 1 AS k, x1 AS phrase FROM y UNION ALL SELECT lang, 2, x1 || ' ' || x2 FROM y WHERE x2 IS NOT NULL UNION ALL SELECT lang, 3, x1 || ' ' || x2 || ' ' || x3 FROM y WHERE x3 IS NOT NULL
      UNION ALL SELECT lang, 4, x1 || ' ' || x2 || ' ' || x3 || ' ' || x4 FROM y WHERE x4 IS NOT NULL UNION ALL SELECT lang, 5, x1 || ' ' || x2 || ' ' || x3 || ' ' || x4 || ' ' || x5 FROM y WHERE x5 IS NOT NULL),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
x AS (SELECT c.*, j FROM c, (SELECT unnest([1, 2, 3, 4]) AS j) WHERE j < k),
s AS (SELECT x.lang, x.phrase, x.k, x.a, x.j, l.f AS l, r.f AS r, n.n, (1000 * x.a::HUGEINT * n.n::HUGEINT // (l.f::HUGEINT * r.f::HUGEINT))::BIGINT AS score
      FROM x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:x.j], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.j + 1:], ' ') JOIN n ON n.lang = x.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS i FROM s),
e AS (SELECT lang, array_to_string(w[1:k - 1], ' ') AS phrase, a FROM c WHERE k > 2 UNION SELECT lang, array_to_string(w[2:], ' '), a FROM c WHERE k > 2),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank FROM b ANTI JOIN e ON e.lang = b.lang AND e.phrase = b.phrase AND e.a = b.a WHERE i = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000"""


def _near_sql(percent: int) -> str:
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_WORD}) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM w),
n AS MATERIALIZED (SELECT w.doc_id, count(s.shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
l AS MATERIALIZED (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2) p
      JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * m >= {percent} * (x.n + y.n - m)),
r(doc_id, low) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.doc_id)
SELECT n.doc_id, n.n AS n_shingles, min(r.low) AS component_id, min(r.low) = n.doc_id AS kept FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n"""


ORACLES["op12_minhash_join"] = _near_sql(85)
