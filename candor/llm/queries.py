"""The registered queries of the operators and their SQL checks."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.llm import (
    bpe, jaccard, language, packing, permutation_index, quality, rp_forest, secret_scan, source_divergence, spelling_variants, token_count,
    url_filter, warc,
)
from candor.llm.common import held_out, table

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


# fixed values: the rules of the query (host, path, verdict)
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = f"""
WITH rules(h, p, v) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
split AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
),
urls AS (
  SELECT page_id, translate(raw, '{url_filter.UPPER}', '{url_filter.LOWER}') AS host, path FROM split
),
fits AS (
  SELECT page_id, host, path, h || p AS rule, v,
    row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS place
  FROM urls LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fits WHERE place = 1
"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs.where(~held_out()), labels.where(~held_out()))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_BPE)
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    decoded = bpe.decode(ids.select("doc_id", "ids"), path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        bpe.id_digest("ids").alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_count.count_tokens(docs, public_tokenizers.path(PIECE_BPE))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.pieces(docs, public_tokenizers.path(BYTE_BPE)))


def op8_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rp_forest.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", "kept")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~held_out()))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = secret_scan.fit(secret_scan.labelled_samples(docs))
    found = secret_scan.scan(docs, model, keep=["doc_id"])
    numbers = [secret_scan.number_of(F.col("spans"), k).alias(f"n_{k}") for k in secret_scan.BASE_KINDS]
    base = F.sha2(secret_scan.listed(F.col("spans"), base_only=True), 256)
    return found.select("doc_id", *numbers, base.alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(table(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}') AS body
  FROM documents
),
numbered AS (SELECT row_number() OVER () AS d, lang, source, body FROM docs),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM numbered),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 30),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
every AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
shares AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source)::HUGEINT + 5 * v) AS p
  FROM every JOIN sizes USING (lang)
),
whole AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM every GROUP BY ALL),
langs AS (
  SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang)::HUGEINT + 5 * v) AS q
  FROM whole JOIN sizes USING (lang)
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
found AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs LEFT JOIN sums USING (lang, source, item)
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares JOIN langs USING (lang, term) WHERE n > 0 AND p > q
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH RECURSIVE table_steps(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM table_steps WHERE k < 8
),
lookup AS (SELECT list(c ORDER BY i) AS crc FROM table_steps WHERE k = 8),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, '{url_filter.UPPER}', '{url_filter.LOWER}'), '[a-zÀ-ÿ]+')) AS run
  FROM documents
),
grouped AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS bytes FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, length(bytes), 2), lambda i: ('0x' || substr(bytes, i, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h
  FROM grouped, lookup
),
changed AS (
  SELECT n, CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed
),
words AS (SELECT word, sum(n)::BIGINT AS n FROM changed GROUP BY word HAVING sum(n) >= 5 AND length(word) >= 6),
gaps AS (
  SELECT word, n, i, left(word, i) || '*' || substr(word, i + 2) AS replaced, left(word, i) || substr(word, i + 2) AS deleted
  FROM words, range(0, length(word)) t(i)
),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.replaced = b.replaced AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.deleted = b.word
  UNION
  SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.deleted = b.word
),
ranked AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM near
),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
  FROM words LEFT JOIN (FROM ranked WHERE place = 1) USING (word)
),
chains AS (
  SELECT word, word AS at FROM forms
  UNION ALL
  SELECT c.word, f.form FROM chains c JOIN forms f ON f.word = c.at AND f.form IS NOT NULL
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chains c ON c.word = f.word JOIN forms e ON e.word = c.at AND e.form IS NULL
"""


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_quality": op2_quality,
    "op3_permutation_index": op3_permutation_index,
    "op4_warc": op4_warc,
    "op5_bpe": op5_bpe,
    "op6_token_count": op6_token_count,
    "op7_packing": op7_packing,
    "op8_rp_forest": op8_rp_forest,
    "op9_language": op9_language,
    "op10_jaccard": op10_jaccard,
    "op11_secret_scan": op11_secret_scan,
    "op12_source_divergence": op12_source_divergence,
    "op13_spelling_variants": op13_spelling_variants,
}

#: The others cannot be written in SQL that ends; their tests compare with the libraries, brute force or held-out labels.
ORACLES: dict[str, str] = {"op1_url_filter": OP1_SQL, "op12_source_divergence": OP12_SQL, "op13_spelling_variants": OP13_SQL}
