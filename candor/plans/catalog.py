"""The registered queries: one per operator, each with its SQL check where SQL can express it.

Doubles are rounded to six digits and times are rendered as text on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candor import config
from candor.functions import scoring, text as tx, vectors as vx
from candor.operators import campaigns as rules
from candor.operators import clusters, graph, images, intervals, models, overlap, pairs, projections, rollups
from candor.plans import detection, reports
from candor.plans import fixtures as fx
from candor.plans.oracles import WS, build, hour_key, listed, messages, moment, quoted, r6, steps, words_of, IMAGE_RULES, REPETITION_RULE
from candor.session import cut_lineage, scratch_path, written
from candor.sources import corpus
from candor.sources.tables import ContentStore, embedding_rows, latest, score_rows, text_rows
from candor.streaming import monitors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def d6(column, name: str | None = None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return (F.floor(c.cast("double") * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)).alias(name or column)


def when_text(column: str, name: str | None = None) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(name or column)


def store(spark: SparkSession) -> ContentStore:
    """A fresh store in the shared workspace."""
    return ContentStore(spark, f"candor_{uuid.uuid4().hex[:12]}", scratch_path(spark, "store")).create()


def sized_content(spark, sf) -> DataFrame:
    return text_rows(fx.text_content(spark, sf))


# --- sources, sinks, catalogue ----------------------------------------------


@query(
    "store_text_content",
    build(
        f"""SELECT id, source, source_platform, language, {moment('timestamp')} AS posted, {moment('created_at')} AS created,
        len({words_of('content')}) AS word_count, length(content) AS char_count, n_chars, md5(content) AS content_md5 FROM content""",
        "content",
    ),
)
def store_text_content(spark, sf):
    s = store(spark)
    s.insert_text_content(fx.text_content(spark, sf))
    return s.read("text_content").select(
        "id",
        "source",
        "source_platform",
        "language",
        when_text("timestamp", "posted"),
        when_text("created_at", "created"),
        "word_count",
        "char_count",
        projections.json_field(F.col("metadata"), "$.n_chars", "long").alias("n_chars"),
        F.md5("content").alias("content_md5"),
    )


@query(
    "store_scores",
    build(
        f"""SELECT content_id, 'text' AS content_type, {r6('authenticity_score')} AS authenticity_score,
        {r6('confidence_score')} AS confidence_score, 'rule_based_v1.0' AS model_version, explanation, word_count FROM scores""",
        "scores",
    ),
)
def store_scores(spark, sf):
    s = store(spark)
    s.insert_authenticity_scores(scoring.score_text(fx.text_content(spark, sf)))
    return s.read("authenticity_scores").select(
        "content_id",
        "content_type",
        d6("authenticity_score"),
        d6("confidence_score"),
        "model_version",
        "explanation",
        projections.json_field(F.col("features"), "$.word_count", "long").alias("word_count"),
    )


@query(
    "store_embeddings",
    build(
        f"""SELECT id AS content_id, 'text' AS content_type, '{config.EMBEDDING_MODEL}' AS model_name, len(v) AS dim,
        {r6("list_sum(v)")} AS total FROM dense""",
        "dense",
    ),
)
def store_embeddings(spark, sf):
    s = store(spark)
    s.insert_embeddings(vx.embed(fx.text_content(spark, sf)))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return s.read("embeddings").select(
        "content_id", "content_type", "model_name", F.size("embedding").cast("long").alias("dim"), d6(total, "total")
    )


_ENDS = "(SELECT content_id_1 AS content_id, s FROM vector_pairs UNION ALL SELECT content_id_2, s FROM vector_pairs)"


@query(
    "store_campaigns",
    build(
        f"""SELECT campaign_id, campaign_type, detection_method, campaign_size, similarity_score, content_id FROM (
          SELECT 'volume_spike_' || strftime(hour, '%Y%m%d_%H') AS campaign_id, 'volume_spike' AS campaign_type,
            'volume_spikes' AS detection_method, n AS campaign_size, 0e0 AS similarity_score, id AS content_id FROM post_hours JOIN post_spikes USING (hour)
          UNION ALL
          SELECT 'length_pattern_' || bucket, 'length_pattern', 'length_pattern_campaigns', n, 0e0, id FROM turn_lengths l
            JOIN turn_length_patterns p ON p.bucket = CAST(floor(l.len / (l.len * 0.1e0 + 10e0)) AS INTEGER)
          UNION ALL
          SELECT 'similarity_' || CAST(similarity AS VARCHAR), 'text_similarity', 'similarity_campaigns', campaign_size, {r6('avg_similarity')}, content_id
          FROM (SELECT round(s, 2) AS similarity, count(DISTINCT content_id) AS campaign_size, avg(s) AS avg_similarity FROM {_ENDS} GROUP BY 1
            HAVING count(DISTINCT content_id) >= 5)
          JOIN (SELECT DISTINCT round(s, 2) AS similarity, content_id FROM {_ENDS}) USING (similarity))""",
        "post_hours",
        "post_spikes",
        "turn_lengths",
        "turn_length_patterns",
        "vector_pairs",
    ),
)
def store_campaigns(spark, sf):
    s = store(spark)
    members, near = pairs.similar_groups(fx.vectors(spark, sf), threshold=0.35)
    turns = fx.turns(spark, sf)
    found = detection.unify(
        {
            "volume_spikes": rules.volume_spikes(fx.event_posts(spark, sf)),
            "length_pattern_campaigns": rules.length_patterns(turns),
            "similarity_campaigns": detection.similarity_family(*pairs.equal_similarity_groups(members, near, digits=2)),
        }
    )
    s.insert_campaigns(detection.stored_rows(found), found.members)
    heads = s.read("campaigns").select(
        "campaign_id",
        "campaign_type",
        projections.json_field(F.col("metadata"), "$.detection_method").alias("detection_method"),
        "campaign_size",
        d6("similarity_score"),
    )
    return heads.join(s.read("campaign_members"), ["campaign_id", "detection_method"])


@query(
    "similarity_partners",
    build(
        f"""SELECT id AS content_id, CASE WHEN id = content_id_1 THEN content_id_2 ELSE content_id_1 END AS partner_id, {r6('s')} AS similarity_score
        FROM vector_pairs JOIN (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM labels WHERE quality = 0) ON id IN (content_id_1, content_id_2)""",
        "vector_pairs",
    ),
)
def similarity_partners(spark, sf):
    """Stored pairs of the vectors, and the partners of the contents that are labelled as bad ones."""
    s = store(spark)
    s.insert_similarity(pairs.similar_pairs(fx.vectors(spark, sf), threshold=0.35))
    bad = fx.table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("content_id"))
    return s.partners(bad).select("content_id", "partner_id", d6("similarity_score"))


@query(
    "latest_human_text",
    build(
        f"""SELECT id, source, {moment('created_at')} AS created, length(content) AS char_count FROM content
        WHERE source = 'human' ORDER BY created_at DESC, id LIMIT 1000""",
        "content",
    ),
)
def latest_human_text(spark, sf):
    rows = latest(sized_content(spark, sf).where("source = 'human'"), 1000)
    return rows.select("id", "source", when_text("created_at", "created"), "char_count")


@query(
    "latest_scores",
    build(
        f"""SELECT content_id, {r6('authenticity_score')} AS authenticity_score FROM scores
        JOIN content ON id = content_id ORDER BY created_at DESC, id LIMIT 1000""",
        "scores",
        "content",
    ),
)
def latest_scores(spark, sf):
    content = fx.text_content(spark, sf)
    rows = scoring.score_text(content, keep=("created_at",)).where("content_type = 'text'")
    return latest(rows, 1000, tie="content_id").select("content_id", d6("authenticity_score"))


@query(
    "latest_campaigns",
    build(
        """SELECT 'volume_spike_' || strftime(hour, '%Y%m%d_%H') AS campaign_id, n AS campaign_size FROM post_spikes
        ORDER BY hour DESC, 1 LIMIT 100""",
        "post_spikes",
    ),
)
def latest_campaigns(spark, sf):
    found, _ = rules.volume_spikes(fx.event_posts(spark, sf))
    rows = found.withColumnRenamed("campaign_key", "campaign_id").withColumn("detected_at", F.col("hour"))
    return latest(rows, 100, by="detected_at", tie="campaign_id").select("campaign_id", "campaign_size")


_FORUM = """SELECT 'hn_' || CAST(conv_id * 1000 + turn AS VARCHAR) AS id, text AS content, 'human' AS source,
  'hackernews' AS source_platform, 1704067200 + conv_id * 60 + turn AS epoch, 'en' AS language, turn AS score, conv_id AS parent
  FROM conversations WHERE text IS NOT NULL AND length(text) > 50 AND length(text) < 5000 AND role <> 'system' AND turn <= 5"""
_PAGES = """SELECT 'wiki_' || CAST(doc_id AS VARCHAR) AS id, text AS content, 'human' AS source, 'wikipedia' AS source_platform,
  'en' AS language, 'page ' || CAST(doc_id AS VARCHAR) AS title FROM documents
  WHERE text IS NOT NULL AND length(text) > 100 AND length(text) < 3000 AND doc_id >= 24"""


@query(
    "forum_extract",
    f"SELECT id, source, source_platform, epoch, language, score, parent, length(content) AS char_count FROM ({_FORUM})",
)
def forum_extract(spark, sf):
    meta = F.col("metadata")
    return fx.forum(spark, sf).select(
        "id",
        "source",
        "source_platform",
        F.unix_seconds("timestamp").alias("epoch"),
        "language",
        projections.json_field(meta, "$.score", "long").alias("score"),
        projections.json_field(meta, "$.parent", "long").alias("parent"),
        F.length("content").cast("long").alias("char_count"),
    )


@query(
    "encyclopedia_extract",
    f"SELECT id, source, source_platform, language, title, length(content) AS char_count FROM ({_PAGES})",
)
def encyclopedia_extract(spark, sf):
    return fx.encyclopedia_pages(spark, sf).select(
        "id",
        "source",
        "source_platform",
        "language",
        projections.json_field(F.col("metadata"), "$.title").alias("title"),
        F.length("content").cast("long").alias("char_count"),
    )


@query("random_sample", f"SELECT id, length(content) AS char_count FROM ({_FORUM}) ORDER BY md5(id) LIMIT 100")
def random_sample(spark, sf):
    return corpus.sample_rows(fx.forum(spark, sf), 100).select("id", F.length("content").cast("long").alias("char_count"))


@query(
    "collected_content",
    build(
        f"""SELECT source_platform, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars, count(score) AS scored FROM (
        SELECT id, content, source_platform, score FROM ({_FORUM}) UNION ALL
        SELECT id, content, source_platform, NULL FROM ({_PAGES}) UNION ALL
        SELECT id, content, source_platform, NULL FROM content) GROUP BY source_platform""",
        "content",
    ),
)
def collected_content(spark, sf):
    forum = fx.forum(spark, sf).withColumn("score", projections.json_field(F.col("metadata"), "$.score", "long"))
    every = corpus.collect(forum, fx.encyclopedia_pages(spark, sf), fx.text_content(spark, sf))
    return every.groupBy("source_platform").agg(
        F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"), F.count("score").alias("scored")
    )


_LINES = """content AS (SELECT row_number() OVER (ORDER BY doc_id, k) AS id, '' AS source, line AS content FROM (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS k,
    regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g') AS line FROM documents) WHERE length(line) > 0)"""


def _with_lines(sql: str) -> str:
    """The same check over lines instead of documents: the content CTE is replaced."""
    start = sql.index("content AS (")
    end = sql.index("tokens AS (")
    return sql[:start] + _LINES + ",\n" + sql[end:]


@query(
    "line_file_summary",
    _with_lines(
        build(
            f"""SELECT {r6('avg(authenticity_score)')} AS avg_authenticity, count(*) FILTER (authenticity_score < 0.3e0) AS low_count,
            count(*) AS total, {r6('avg(confidence_score)')} AS avg_confidence, CAST(sum(word_count) AS BIGINT) AS words FROM scores""",
            "scores",
        )
    ),
)
def line_file_summary(spark, sf):
    path = scratch_path(spark, "lines")
    fx.table(spark, sf, "documents").select("text").write.text(path)
    scored = scoring.score_text(corpus.line_items(spark, path))
    return scored.agg(
        d6(F.avg("authenticity_score"), "avg_authenticity"),
        F.count_if(scoring.is_low(F.col("authenticity_score"))).alias("low_count"),
        F.count("*").alias("total"),
        d6(F.avg("confidence_score"), "avg_confidence"),
        F.sum("features.word_count").alias("words"),
    )


# --- projections ---------------------------------------------------------------


def _share(char: str) -> str:
    return r6(f"CAST(length(content) - length(replace(content, '{char}', '')) AS DOUBLE) / length(content)")


@query(
    "classifier_inputs",
    build(
        f"""SELECT id, len({words_of('content')}) AS word_count, length(content) AS char_count,
        {r6(f"CAST(length(content) AS DOUBLE) / len({words_of('content')})")} AS avg_word_length,
        {_share(' ')} AS space_ratio, {_share('.')} AS period_ratio, {_share(',')} AS comma_ratio,
        source = 'human' AS is_authentic FROM content WHERE source IN ('human', 'ai_generated')""",
        "content",
    ),
)
def classifier_inputs(spark, sf):
    rows = projections.classifier_rows(sized_content(spark, sf))
    return rows.select(
        "id",
        "word_count",
        "char_count",
        *[d6(c) for c in ("avg_word_length", "space_ratio", "period_ratio", "comma_ratio")],
        "is_authentic",
    )


@query(
    "labels_above_five_words",
    build(
        f"SELECT source = 'human' AS is_authentic, count(*) AS n FROM content WHERE len({words_of('content')}) > 5 GROUP BY 1",
        "content",
    ),
)
def labels_above_five_words(spark, sf):
    rows = projections.classifier_rows(sized_content(spark, sf), labelled_only=False, min_words=5)
    return rows.groupBy("is_authentic").agg(F.count("*").alias("n"))


@query("columns_except", "SELECT * EXCLUDE (text, n_chars) FROM documents")
def columns_except(spark, sf):
    return projections.without(fx.table(spark, sf, "documents"), "text", "n_chars")


@query(
    "score_bands",
    build(
        """SELECT CASE WHEN authenticity_score > 0.7e0 THEN 'Likely Human' WHEN authenticity_score > 0.3e0 THEN 'Uncertain'
        ELSE 'Likely AI-Generated' END AS band, count(*) AS n FROM scores GROUP BY 1""",
        "scores",
    ),
)
def score_bands(spark, sf):
    scored = scoring.score_text(fx.text_content(spark, sf))
    return scored.groupBy(scoring.score_band(F.col("authenticity_score")).alias("band")).agg(F.count("*").alias("n"))


@query(
    "prediction_accuracy",
    build(
        f"""SELECT count(*) AS samples, count(*) FILTER (correct) AS correct, {r6('avg(CAST(correct AS INTEGER))')} AS accuracy,
        {r6('avg(confidence_score)')} AS avg_confidence FROM (
          SELECT *, CASE WHEN authenticity_score > 0.5e0 THEN 'human' ELSE 'ai_generated' END = source AS correct
          FROM scores WHERE source <> 'unknown')""",
        "scores",
    ),
)
def prediction_accuracy(spark, sf):
    content = fx.text_content(spark, sf).where("source <> 'unknown'")
    out = rollups.prediction_accuracy(scoring.score_text(content, keep=("source",)), expected="source")
    return out.select("samples", "correct", d6("accuracy"), d6("avg_confidence"))


@query(
    "text_previews",
    """SELECT doc_id, substr(text, 1, 50) || '...' AS p50, substr(text, 1, 100) || '...' AS p100,
    substr(text, 1, 200) || '...' AS p200 FROM documents""",
)
def text_previews(spark, sf):
    t = F.col("text")
    return fx.table(spark, sf, "documents").select(
        "doc_id", *[projections.preview(t, n).alias(f"p{n}") for n in (50, 100, 200)]
    )


@query("image_ids", "SELECT page_id, 'img_' || substr(md5(url), 1, 8) AS content_id FROM pages")
def image_ids(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", projections.image_id(F.col("url")).alias("content_id"))


@query("json_fields", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def json_fields(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", projections.json_field(F.col("props"), "$.k", "long").alias("k"))


@query(
    "time_buckets",
    f"""SELECT {moment("date_trunc('hour', ts)")} AS hour, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2""",
)
def time_buckets(spark, sf):
    posts = fx.event_posts(spark, sf)
    hour = projections.hour_bucket(F.col("timestamp"))
    day = projections.day_bucket(F.col("timestamp"))
    return posts.groupBy(
        F.date_format(hour, "yyyy-MM-dd HH:mm:ss").alias("hour"), day.cast("string").alias("day")
    ).agg(F.count("*").alias("n"))


# --- text features --------------------------------------------------------------

_COUNTS = ("char_count", "word_count", "sentence_count")


def _feature_query(name: str, *columns: str) -> None:
    """Register a query that reads only some features, so Spark computes only those."""
    shown = ", ".join(
        c if c in _COUNTS or c == "language" else f"{r6(c)} AS {c}" for c in columns
    )

    @query(name, build(f"SELECT id, {shown} FROM features", "features"))
    def run(spark, sf):
        rows = tx.with_text_features(fx.text_content(spark, sf).select("id", "content"))
        return rows.where("features is not null").select(
            "id",
            *[
                F.col(f"features.{c}").alias(c) if c in _COUNTS or c == "language" else d6(F.col(f"features.{c}"), c)
                for c in columns
            ],
        )


_feature_query("text_counts", *_COUNTS)
_feature_query("text_readability", "flesch_reading_ease", "flesch_kincaid_grade")
_feature_query("text_language", "language", "is_english")
_feature_query(
    "text_char_ratios", "exclamation_ratio", "question_ratio", "period_ratio", "comma_ratio", "uppercase_ratio", "digit_ratio"
)
_feature_query("text_word_lengths", "avg_word_length", "word_length_std")
_feature_query("text_sentence_lengths", "avg_sentence_length", "sentence_length_std")
_feature_query("text_phrases", "ai_phrase_density", "formal_language_density")
_feature_query("text_repetition", "repetition_score")
_feature_query("text_punctuation", "perfect_punctuation")
_feature_query("text_features", *tx.FEATURES)


@query(
    "language_agreement",
    build(
        "SELECT c.language AS given, f.language AS detected, count(*) AS n FROM features f JOIN content c USING (id) GROUP BY 1, 2",
        "features",
        "content",
    ),
)
def language_agreement(spark, sf):
    content = fx.text_content(spark, sf)
    rows = tx.with_text_features(content.select("id", "content", F.col("language").alias("given")))
    return rows.groupBy("given", F.col("features.language").alias("detected")).agg(F.count("*").alias("n"))


_LEXICON = "SELECT word, ['NOUN', 'VERB', 'ADJ', 'ADV', 'OTHER'][length(word) % 5 + 1] AS pos FROM (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS word FROM benchmark)"


@query(
    "text_tag_shares",
    build(
        f"""SELECT id, count(*) AS tokens, """
        + ", ".join(
            f"{r6(f'CAST(count(*) FILTER (pos = {quoted(t)}) AS DOUBLE) / count(*)')} AS {t.lower()}_ratio"
            for t in ("NOUN", "VERB", "ADJ", "ADV")
        )
        + f" FROM lower_words LEFT JOIN ({_LEXICON}) ON word = w GROUP BY id",
        "lower_words",
    ),
)
def text_tag_shares(spark, sf):
    tags = F.array(*[F.lit(t) for t in ("NOUN", "VERB", "ADJ", "ADV", "OTHER")])
    listed_words = (
        fx.table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("word")).distinct()
    )
    lexicon = listed_words.withColumn("pos", F.element_at(tags, F.length("word") % 5 + 1))
    out = tx.tag_shares(fx.text_content(spark, sf), lexicon)
    return out.select("id", "tokens", *[d6(f"{t}_ratio") for t in ("noun", "verb", "adj", "adv")])


# --- scoring --------------------------------------------------------------------


@query(
    "text_scores",
    build(
        f"""SELECT content_id, 'text' AS content_type, {r6('authenticity_score')} AS authenticity_score,
        {r6('confidence_score')} AS confidence_score, explanation, 'rule_based_v1.0' AS model_version FROM scores""",
        "scores",
    ),
)
def text_scores(spark, sf):
    return scoring.score_text(fx.text_content(spark, sf)).select(
        "content_id", "content_type", d6("authenticity_score"), d6("confidence_score"), "explanation", "model_version"
    )


_STATS = f"""SELECT {r6('avg(authenticity_score)')} AS avg_authenticity, {r6('avg(confidence_score)')} AS avg_confidence,
    count(*) FILTER (authenticity_score < 0.3e0) AS low_count, count(*) FILTER (authenticity_score > 0.7e0) AS high_count,
    count(*) AS total FROM scores"""


def _shown_stats(df: DataFrame) -> DataFrame:
    return df.select(d6("avg_authenticity"), d6("avg_confidence"), "low_count", "high_count", "total")


@query("analyze_content", build(_STATS, "scores"))
def analyze_content(spark, sf):
    """Score the stored content, append the scores, then summarise what was stored."""
    s = store(spark)
    s.insert_text_content(fx.text_content(spark, sf))
    s.insert_authenticity_scores(scoring.score_text(s.read("text_content")))
    return _shown_stats(rollups.score_statistics(s.read("authenticity_scores")))


_COSINES = """SELECT a.id AS id_1, b.id AS id_2, a.v AS a, CASE WHEN CAST(b.id AS INTEGER) % 5 = 0 THEN b.v[1:63] ELSE b.v END AS b
    FROM emb a JOIN emb b ON CAST(b.id AS INTEGER) = CAST(a.id AS INTEGER) + 1"""


def _neighbours(spark, sf) -> DataFrame:
    v = fx.vectors(spark, sf).select(F.col("content_id").cast("long").alias("id"), "embedding")
    nxt = v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("b"))
    cut = F.when((F.col("id") + 1) % 5 == 0, F.slice("b", 1, 63)).otherwise(F.col("b"))
    return v.join(nxt, "id").select(
        F.col("id").cast("string").alias("id_1"), (F.col("id") + 1).cast("string").alias("id_2"), F.col("embedding").alias("a"), cut.alias("b")
    )


@query(
    "sql_cosine",
    build(
        f"SELECT id_1, id_2, CASE WHEN len(a) = len(b) THEN {r6('list_cosine_similarity(a, b)')} END AS similarity FROM ({_COSINES})",
        "emb",
    ),
)
def sql_cosine(spark, sf):
    vx.register_cosine_similarity(spark)
    return _neighbours(spark, sf).select("id_1", "id_2", d6(F.expr("cosine_similarity(a, b)"), "similarity"))


@query(
    "pair_cosine",
    build(
        f"SELECT id_1, id_2, CASE WHEN len(a) = len(b) THEN {r6('list_cosine_similarity(a, b)')} ELSE 0e0 END AS similarity FROM ({_COSINES})",
        "emb",
    ),
)
def pair_cosine(spark, sf):
    return _neighbours(spark, sf).select("id_1", "id_2", d6(vx.cosine(F.col("a"), F.col("b")), "similarity"))


# --- embeddings -----------------------------------------------------------------


@query("hashing_embeddings", build(f"SELECT id, bucket, {r6('v')} AS v FROM sparse", "sparse"))
def hashing_embeddings(spark, sf):
    vec = vx.hashing_embedding(fx.text_content(spark, sf).select("id", "content"))
    return vec.select("id", F.posexplode_outer("embedding").alias("bucket", "v")).where("v <> 0").select("id", "bucket", d6("v"))


@query(
    "failed_embeddings",
    """SELECT d.doc_id, COALESCE(len(e.embedding), 768) AS dim, e.vec_id IS NULL AS failed,
    CASE WHEN e.vec_id IS NULL THEN 0e0 ELSE 1e0 END AS self_similarity
    FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
)
def failed_embeddings(spark, sf):
    vecs = fx.vectors(spark, sf).select(F.col("content_id").cast("long").alias("doc_id"), "embedding")
    rows = fx.table(spark, sf, "documents").select("doc_id").join(vecs, "doc_id", "left")
    full = vx.or_zero_vector(F.col("embedding"))
    return rows.withColumn("full", full).select(
        "doc_id",
        F.size("full").cast("long").alias("dim"),
        F.col("embedding").isNull().alias("failed"),
        d6(vx.cosine(F.col("full"), F.col("full")), "self_similarity"),
    )


_BENCH_DENSE = f"""bw AS (SELECT item_id, unnest({words_of('lower(text)')}) AS w FROM benchmark),
  bb AS (SELECT item_id, CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % {config.EMBEDDING_DIM} AS INTEGER) AS bucket,
    CAST(count(*) AS DOUBLE) AS n FROM bw GROUP BY 1, 2),
  bs AS (SELECT item_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY item_id)) AS v FROM bb),
  bd AS (SELECT k.item_id, list(COALESCE(s.v, 0e0) ORDER BY k.b) AS q FROM (SELECT item_id, unnest(range({config.EMBEDDING_DIM})) AS b
    FROM (SELECT DISTINCT item_id FROM bs)) k LEFT JOIN bs s ON s.item_id = k.item_id AND s.bucket = k.b GROUP BY k.item_id),
  hits AS (SELECT CAST(item_id AS VARCHAR) AS query_id, id AS content_id, round(list_cosine_similarity(q, v), 12) AS s FROM bd, dense)"""


def _search_sql(final: str) -> str:
    head = build("", "dense").rstrip()
    return f"{head},\n{_BENCH_DENSE}\n{final}"


def _search_sides(spark, sf):
    bench = fx.table(spark, sf, "benchmark").withColumnRenamed("text", "content")
    asked = vx.hashing_embedding(bench).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("query"))
    content = fx.text_content(spark, sf)
    held = vx.hashing_embedding(content).select(F.col("id").alias("content_id"), "embedding")
    return asked, held


@query("threshold_search", _search_sql(f"SELECT query_id, content_id, {r6('s')} AS similarity FROM hits WHERE s >= 0.7e0"))
def threshold_search(spark, sf):
    asked, held = _search_sides(spark, sf)
    return pairs.find_similar(asked, held, 0.7).select("query_id", "content_id", d6("similarity"))


@query(
    "top_similar",
    _search_sql(
        f"""SELECT query_id, content_id, {r6('s')} AS similarity, rank, substr(content, 1, 200) || '...' AS preview, source FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, content_id) AS rank FROM hits)
        JOIN content ON id = content_id WHERE rank <= 5"""
    ),
)
def top_similar(spark, sf):
    asked, held = _search_sides(spark, sf)
    shown = fx.text_content(spark, sf).select(
        F.col("id").alias("content_id"), projections.preview(F.col("content"), 200).alias("preview"), "source"
    )
    return pairs.top_similar(asked, held, 5).join(shown, "content_id").select(
        "query_id", "content_id", d6("similarity"), "rank", "preview", "source"
    )


# --- joins ------------------------------------------------------------------------


@query(
    "similar_vectors",
    build(f"SELECT content_id_1, content_id_2, {r6('s')} AS similarity_score, 'semantic' AS similarity_type FROM vector_pairs", "vector_pairs"),
)
def similar_vectors(spark, sf):
    found = pairs.similar_pairs(fx.vectors(spark, sf), threshold=0.35)
    return found.select("content_id_1", "content_id_2", d6("similarity_score"), "similarity_type")


def text_vectors(spark, sf) -> DataFrame:
    return detection.embedded(fx.text_content(spark, sf))


@query(
    "similar_texts",
    build(
        f"""SELECT a.rep AS rep_1, b.rep AS rep_2, a.copies AS copies_1, b.copies AS copies_2,
        {r6('round(list_cosine_similarity(a.v, b.v), 12)')} AS similarity_score
        FROM (SELECT min(id) AS rep, count(*) AS copies, v FROM dense GROUP BY v) a
        JOIN (SELECT min(id) AS rep, count(*) AS copies, v FROM dense GROUP BY v) b ON a.rep < b.rep
        WHERE round(list_cosine_similarity(a.v, b.v), 12) >= 0.85e0""",
        "dense",
    ),
)
def similar_texts(spark, sf):
    """Pairs of distinct texts with their copy counts (the factorised pair list)."""
    _, found = pairs.similar_groups(text_vectors(spark, sf), id="id")
    return found.select("rep_1", "rep_2", "copies_1", "copies_2", d6("similarity_score"))


@query(
    "copy_groups",
    build(
        "SELECT id, min(id) OVER (PARTITION BY v) AS rep, count(*) OVER (PARTITION BY v) AS copies FROM dense",
        "dense",
    ),
)
def copy_groups(spark, sf):
    """Every id with the representative of its identical vectors."""
    members, _ = pairs.similar_groups(text_vectors(spark, sf), id="id")
    return members.select("id", "rep", "copies")


@query("lsh_similar_vectors", "SELECT CAST(0 AS BIGINT) AS outside, TRUE AS enough")
def lsh_similar_vectors(spark, sf):
    """Approximate form of similar_vectors: pairs outside the exact ones, and whether nine tenths of those are found."""
    rows = fx.vectors(spark, sf)
    ids = ["content_id_1", "content_id_2"]
    near = pairs.lsh_pairs(rows, threshold=0.35).select(*ids, F.lit(1).alias("found"))
    exact = pairs.similar_pairs(rows, threshold=0.35).select(*ids, F.lit(1).alias("exact"))
    both = exact.join(near, ids, "full")
    return both.agg(
        F.count_if(F.col("exact").isNull()).alias("outside"),
        (F.count("found") >= 0.9 * F.count("exact")).alias("enough"),
    )


@query(
    "same_type_pairs",
    build(
        f"""SELECT content_id_1, content_id_2, {r6('s')} AS similarity_score FROM vector_pairs
        JOIN emb a ON a.id = content_id_1 JOIN emb b ON b.id = content_id_2
        WHERE a.content_type = b.content_type AND s > 0.35e0""",
        "vector_pairs",
    ),
)
def same_type_pairs(spark, sf):
    found = pairs.sql_similar_pairs(fx.vectors(spark, sf), threshold=0.35)
    return found.select("content_id_1", "content_id_2", d6("similarity_score"))


@query(
    "equal_similarity_campaigns",
    build(
        f"""SELECT similarity, content_id, campaign_size, {r6('avg_similarity')} AS avg_similarity FROM (
        SELECT round(s, 2) AS similarity, count(DISTINCT content_id) AS campaign_size, avg(s) AS avg_similarity FROM ends GROUP BY 1
        HAVING count(DISTINCT content_id) >= 5)
        JOIN (SELECT DISTINCT round(s, 2) AS similarity, content_id FROM ends) USING (similarity)""",
        "vector_pairs",
    ).replace(
        "\nSELECT similarity, content_id",
        """,\nends AS (SELECT content_id_1 AS content_id, s FROM vector_pairs UNION ALL SELECT content_id_2, s FROM vector_pairs)
        \nSELECT similarity, content_id""",
    ),
)
def equal_similarity_campaigns(spark, sf):
    members, found = pairs.similar_groups(fx.vectors(spark, sf), threshold=0.35)
    groups, ids = pairs.equal_similarity_groups(members, found, digits=2)
    return ids.join(groups, "similarity").select("similarity", "content_id", "campaign_size", d6("avg_similarity"))


_OVERLAP = f"""WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS id, list_distinct(string_split(lower(text), ' ')) AS ts FROM documents
    WHERE len({words_of('text')}) > 5),
  w AS (SELECT id, unnest(ts) AS token FROM t),
  shared AS (SELECT a.id AS id_1, b.id AS id_2, count(*) AS n FROM w a JOIN w b ON a.token = b.token AND a.id < b.id GROUP BY 1, 2),
  overlapping AS (SELECT id_1 AS content_id_1, id_2 AS content_id_2, CAST(n AS DOUBLE) / len(ts) AS ratio FROM shared JOIN t ON t.id = id_1
    WHERE CAST(n AS DOUBLE) / len(ts) > 0.5e0)
  """


def _plain_documents(spark, sf) -> DataFrame:
    return fx.documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), F.size(tx.words(F.col("text"))).alias("word_count")
    )


@query(
    "word_overlap_top",
    _OVERLAP + f"SELECT content_id_1, content_id_2, {r6('ratio')} AS word_overlap_ratio FROM overlapping ORDER BY ratio DESC, 1, 2 LIMIT 20",
)
def word_overlap_top(spark, sf):
    found = overlap.word_overlap_pairs(_plain_documents(spark, sf))
    return found.select("content_id_1", "content_id_2", d6("word_overlap_ratio"))


@query(
    "word_overlap_histogram",
    _OVERLAP + "SELECT CAST(least(floor(ratio * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM overlapping GROUP BY 1",
)
def word_overlap_histogram(spark, sf):
    found = overlap.word_overlap_counts(_plain_documents(spark, sf))
    return rollups.score_histogram(found.where("n > 0"), "word_overlap_ratio", 20, weight="n")


@query(
    "cross_platform_campaigns",
    build(
        """SELECT platform_1, platform_2, matches, count(*) AS campaign_size FROM cross_found
        JOIN cross_members USING (platform_1, platform_2) GROUP BY 1, 2, 3""",
        "cross_found",
        "cross_members",
    ),
)
def cross_platform_campaigns(spark, sf):
    found, _ = rules.cross_platform(text_vectors(spark, sf))
    return found.select("platform_1", "platform_2", "matches", "campaign_size")


@query(
    "cross_platform_members",
    build(
        "SELECT 'cross_platform_' || platform_1 || '_' || platform_2 AS campaign_id, content_id FROM cross_members",
        "cross_members",
    ),
)
def cross_platform_members(spark, sf):
    _, members = rules.cross_platform(text_vectors(spark, sf))
    return members.select(F.col("campaign_key").alias("campaign_id"), "content_id")


@query(
    "cross_kind_matches",
    build(
        f"""SELECT least(a.content_type, b.content_type) AS platform_1, greatest(a.content_type, b.content_type) AS platform_2,
        CASE WHEN a.content_type < b.content_type THEN a.id ELSE b.id END AS content_id_1,
        CASE WHEN a.content_type < b.content_type THEN b.id ELSE a.id END AS content_id_2, {r6('s')} AS similarity
        FROM vector_pairs JOIN emb a ON a.id = content_id_1 JOIN emb b ON b.id = content_id_2 WHERE a.content_type <> b.content_type""",
        "vector_pairs",
    ),
)
def cross_kind_matches(spark, sf):
    """The match list of the cross-platform join, vectors standing in for posts."""
    rows = fx.vectors(spark, sf)
    platforms = rows.select("content_id", F.col("content_type").alias("platform"))
    found = pairs.similar_pairs(rows.join(platforms, "content_id"), threshold=0.35, keep=["platform"])
    out = rules.cross_platform_matches(found)
    return out.select("platform_1", "platform_2", "content_id_1", "content_id_2", d6("similarity"))


_KINDS = """SELECT h.hour, count(*) FILTER (source_platform = 'view') AS images, count(*) FILTER (source_platform <> 'view') AS texts
    FROM post_hours h GROUP BY h.hour"""


def _texts_images(spark, sf):
    posts = fx.event_posts(spark, sf)
    return posts.where("source_platform <> 'view'"), posts.where("source_platform = 'view'")


@query(
    "multimodal_hours",
    build(
        f"""SELECT 'multimodal_' || {hour_key()} AS campaign_id, texts, images, texts + images AS campaign_size
        FROM ({_KINDS}) WHERE texts >= 2 AND images >= 2""",
        "post_hours",
    ),
)
def multimodal_hours(spark, sf):
    found, _ = rules.multimodal(*_texts_images(spark, sf))
    return found.select(F.col("campaign_key").alias("campaign_id"), "texts", "images", "campaign_size")


@query(
    "multimodal_members",
    build(
        f"""SELECT 'multimodal_' || {hour_key('p.hour')} AS campaign_id, id AS content_id,
        CASE WHEN source_platform = 'view' THEN 'image' ELSE 'text' END AS content_type
        FROM post_hours p JOIN ({_KINDS}) k ON k.hour = p.hour WHERE texts >= 2 AND images >= 2""",
        "post_hours",
    ),
)
def multimodal_members(spark, sf):
    _, members = rules.multimodal(*_texts_images(spark, sf))
    return members.select(F.col("campaign_key").alias("campaign_id"), "content_id", "content_type")


@query(
    "shared_hours",
    build(f"SELECT {moment('hour')} AS hour FROM ({_KINDS}) WHERE texts > 0 AND images > 0", "post_hours"),
)
def shared_hours(spark, sf):
    return rules.shared_hours(*_texts_images(spark, sf)).select(when_text("hour"))


@query(
    "rows_in_spike_hours",
    build(f"SELECT id, {moment('hour')} AS hour FROM post_hours WHERE hour IN (SELECT hour FROM post_spikes)", "post_hours", "post_spikes"),
)
def rows_in_spike_hours(spark, sf):
    posts = fx.event_posts(spark, sf)
    found, _ = rules.volume_spikes(posts)
    return rules.in_hours(posts, found).select("id", when_text("hour"))


# --- clusters and graph --------------------------------------------------------------


@query("semantic_cluster_members", build("SELECT cluster, id AS content_id, core FROM clustered", "clustered"))
def semantic_cluster_members(spark, sf):
    members, _ = clusters.semantic_clusters(text_vectors(spark, sf), id="id")
    return members.select("cluster", "content_id", "core")


@query(
    "semantic_clusters",
    build(
        f"SELECT cluster, n AS cluster_size, {r6('avg_similarity')} AS avg_similarity FROM cluster_sizes JOIN cohesion USING (cluster)",
        "cluster_sizes",
        "cohesion",
    ),
)
def semantic_clusters(spark, sf):
    _, found = clusters.semantic_clusters(text_vectors(spark, sf), id="id")
    return found.select("cluster", "cluster_size", d6("avg_similarity"))


def _graph(spark, sf):
    """Similarity graph of the vectors with copies as weighted vertices: (vertices, edges, ids by vertex)."""
    rows = fx.vectors(spark, sf)
    members, found = pairs.similar_groups(rows, threshold=0.35)
    return graph.factorised_graph(rows.select(F.col("content_id").alias("id")), cut_lineage(members), found)


@query("graph_components", build("SELECT id, component FROM graph_parts", "graph_parts"))
def graph_components(spark, sf):
    vertices, edges, named = _graph(spark, sf)
    return graph.of_ids(graph.connected_components(edges, vertices), named)


@query(
    "similarity_graph_edges",
    build(f"SELECT content_id_1 AS src, content_id_2 AS dst, {r6('s')} AS weight FROM vector_pairs", "vector_pairs"),
)
def similarity_graph_edges(spark, sf):
    rows = fx.vectors(spark, sf)
    found = pairs.similar_pairs(rows, threshold=0.35)
    return graph.similarity_graph(found, rows.select(F.col("content_id").alias("id")))[1].select("src", "dst", d6("weight"))


@query("clustering_coefficients", build(f"SELECT id, degree, triangles, {r6('coefficient')} AS coefficient FROM coefficients", "coefficients"))
def clustering_coefficients(spark, sf):
    vertices, edges, named = _graph(spark, sf)
    return graph.of_ids(graph.clustering_coefficients(vertices, edges), named).select("id", "degree", "triangles", d6("coefficient"))


_DENSITY = "CASE WHEN {n} > 1 THEN 2e0 * {m} / ({n} * ({n} - 1)) ELSE 0e0 END"


@query(
    "network_components",
    build(
        f"""SELECT component, size, edges, {r6(_DENSITY.format(n='size', m='edges'))} AS density,
        {r6('avg_clustering')} AS avg_clustering FROM components WHERE size >= 5""",
        "components",
    ),
)
def network_components(spark, sf):
    vertices, edges, _ = _graph(spark, sf)
    found, _, _ = graph.analyze_network(vertices, edges)
    return found.select("component", "size", "edges", d6("density"), d6("avg_clustering"))


@query(
    "network_component_members",
    build(
        "SELECT id, component FROM graph_parts WHERE component IN (SELECT component FROM components WHERE size >= 5)",
        "graph_parts",
        "components",
    ),
)
def network_component_members(spark, sf):
    vertices, edges, named = _graph(spark, sf)
    return graph.analyze_network(vertices, edges, named=named)[1].select("id", "component")


@query(
    "network_metrics",
    build(
        f"""SELECT total_nodes, total_edges, number_of_components, {r6('avg_clustering')} AS avg_clustering,
        {r6(_DENSITY.format(n='total_nodes', m='total_edges'))} AS density FROM (
          SELECT count(*) AS total_nodes, CAST(sum(degree) / 2 AS BIGINT) AS total_edges, avg(coefficient) AS avg_clustering FROM coefficients),
          (SELECT count(DISTINCT component) AS number_of_components FROM graph_parts)""",
        "coefficients",
        "graph_parts",
    ),
)
def network_metrics(spark, sf):
    vertices, edges, _ = _graph(spark, sf)
    _, _, totals = graph.analyze_network(vertices, edges)
    return totals.select("total_nodes", "total_edges", "number_of_components", d6("avg_clustering"), d6("density"))


# --- aggregations and campaign rules ---------------------------------------------------


@query(
    "content_stats",
    build(
        f"""SELECT source, source_platform, count(*) AS content_count, {r6(f"avg(len({words_of('content')}))")} AS avg_word_count,
        {r6('avg(length(content))')} AS avg_char_count FROM content GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2""",
        "content",
    ),
)
def content_stats(spark, sf):
    out = rollups.content_stats(sized_content(spark, sf))
    return out.select("source", "source_platform", "content_count", d6("avg_word_count"), d6("avg_char_count"))


@query(
    "temporal_campaigns",
    build(
        f"SELECT 'temporal_' || {hour_key()} AS campaign_id, n AS campaign_size, pairs AS similar_pairs_count FROM temporal",
        "temporal",
    ),
)
def temporal_campaigns(spark, sf):
    found, _ = rules.temporal_patterns(text_vectors(spark, sf))
    return found.select(F.col("campaign_key").alias("campaign_id"), "campaign_size", "similar_pairs_count")


@query(
    "temporal_members",
    build(f"SELECT 'temporal_' || {hour_key('h.hour')} AS campaign_id, h.id AS content_id FROM content_hours h JOIN temporal USING (hour)", "content_hours", "temporal"),
)
def temporal_members(spark, sf):
    _, members = rules.temporal_patterns(text_vectors(spark, sf))
    return members.select(F.col("campaign_key").alias("campaign_id"), "content_id")


@query(
    "volume_spikes",
    build(
        f"SELECT 'volume_spike_' || {hour_key()} AS campaign_id, n AS campaign_size, {r6('multiplier')} AS volume_multiplier FROM post_spikes",
        "post_spikes",
    ),
)
def volume_spikes(spark, sf):
    found, _ = rules.volume_spikes(fx.event_posts(spark, sf))
    return found.select(F.col("campaign_key").alias("campaign_id"), "campaign_size", d6("volume_multiplier"))


@query(
    "volume_spike_members",
    build(f"SELECT 'volume_spike_' || {hour_key()} AS campaign_id, id AS content_id FROM post_hours JOIN post_spikes USING (hour)", "post_hours", "post_spikes"),
)
def volume_spike_members(spark, sf):
    _, members = rules.volume_spikes(fx.event_posts(spark, sf))
    return members.select(F.col("campaign_key").alias("campaign_id"), "content_id")


@query(
    "length_patterns",
    build(
        f"""SELECT 'length_pattern_' || bucket AS campaign_id, n AS campaign_size, {r6('mean')} AS avg_length,
        {r6('consistency')} AS length_consistency FROM turn_length_patterns""",
        "turn_length_patterns",
    ),
)
def length_patterns(spark, sf):
    found, _ = rules.length_patterns(fx.turns(spark, sf))
    return found.select(
        F.col("campaign_key").alias("campaign_id"), "campaign_size", d6("avg_length"), d6("length_consistency")
    )


@query(
    "length_pattern_members",
    build(
        """SELECT 'length_pattern_' || bucket AS campaign_id, id AS content_id FROM turn_lengths l JOIN turn_length_patterns p
        ON p.bucket = CAST(floor(l.len / (l.len * 0.1e0 + 10e0)) AS INTEGER)""",
        "turn_lengths",
        "turn_length_patterns",
    ),
)
def length_pattern_members(spark, sf):
    _, members = rules.length_patterns(fx.turns(spark, sf))
    return members.select(F.col("campaign_key").alias("campaign_id"), "content_id")


@query(
    "authenticity_patterns",
    build(
        f"""SELECT 'auth_' || substr(md5(common_explanation), 1, 8) AS campaign_id, common_explanation, n AS campaign_size,
        {r6('mean')} AS avg_authenticity_score FROM auth_patterns""",
        "auth_patterns",
    ),
)
def authenticity_patterns(spark, sf):
    found, _ = rules.authenticity_patterns(fx.text_content(spark, sf))
    return found.select(
        F.col("campaign_key").alias("campaign_id"), "common_explanation", "campaign_size", d6("avg_authenticity_score")
    )


@query(
    "authenticity_pattern_members",
    build(
        """SELECT 'auth_' || substr(md5(common_explanation), 1, 8) AS campaign_id, content_id
        FROM low_scores JOIN auth_patterns USING (common_explanation)""",
        "low_scores",
        "auth_patterns",
    ),
)
def authenticity_pattern_members(spark, sf):
    _, members = rules.authenticity_patterns(fx.text_content(spark, sf))
    return members.select(F.col("campaign_key").alias("campaign_id"), "content_id")


@query(
    "source_counts",
    build(
        """SELECT count(*) AS total, count(*) FILTER (source = 'human') AS human,
        count(*) FILTER (source = 'ai_generated') AS ai_generated FROM content""",
        "content",
    ),
)
def source_counts(spark, sf):
    return rollups.source_counts(fx.text_content(spark, sf))


@query(
    "platform_counts",
    "SELECT event_type AS source_platform, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1",
)
def platform_counts(spark, sf):
    return rollups.value_counts(fx.event_posts(spark, sf), "source_platform")


@query(
    "daily_volume",
    build(
        """SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) FILTER (source = 'human') AS human,
        count(*) FILTER (source = 'ai_generated') AS ai_generated, count(*) FILTER (source = 'unknown') AS "unknown" FROM content GROUP BY 1""",
        "content",
    ),
)
def daily_volume(spark, sf):
    out = rollups.daily_volume(fx.text_content(spark, sf))
    return out.withColumn("date", F.col("date").cast("string"))


@query(
    "hourly_timeline",
    build(f"SELECT {moment('hour')} AS hour, source, count(*) AS n FROM content_hours GROUP BY 1, 2", "content_hours"),
)
def hourly_timeline(spark, sf):
    return rollups.timeline(fx.text_content(spark, sf)).select(when_text("hour"), "source", "n")


@query(
    "score_histogram",
    build(
        "SELECT source, CAST(least(floor(authenticity_score * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM scores GROUP BY 1, 2",
        "scores",
    ),
)
def score_histogram(spark, sf):
    scored = scoring.score_text(fx.text_content(spark, sf), keep=("source",))
    return rollups.score_histogram(scored, by=("source",))


@query("score_statistics", build(_STATS, "scores"))
def score_statistics(spark, sf):
    return _shown_stats(rollups.score_statistics(scoring.score_text(fx.text_content(spark, sf))))


@query(
    "score_points",
    build(
        f"SELECT content_id, source, {r6('authenticity_score')} AS authenticity_score, {r6('confidence_score')} AS confidence_score FROM scores",
        "scores",
    ),
)
def score_points(spark, sf):
    scored = scoring.score_text(fx.text_content(spark, sf), keep=("source",))
    return rollups.score_points(scored, ("source",)).select(
        "content_id", "source", d6("authenticity_score"), d6("confidence_score")
    )


@query(
    "suspicious_ids",
    build("SELECT content_id_1 AS content_id FROM vector_pairs UNION SELECT content_id_2 FROM vector_pairs", "vector_pairs"),
)
def suspicious_ids(spark, sf):
    return pairs.similar_ids(fx.vectors(spark, sf), threshold=0.35)


@query(
    "content_preview",
    build(
        "SELECT id, source, substr(content, 1, 100) || '...' AS preview FROM content ORDER BY created_at DESC, id LIMIT 10",
        "content",
    ),
)
def content_preview(spark, sf):
    rows = latest(fx.text_content(spark, sf), 10)
    return rows.select("id", "source", projections.preview(F.col("content"), 100).alias("preview"))


# --- windows --------------------------------------------------------------------------


def _interval_sql(name: str, factor: str) -> str:
    return build(
        f"""SELECT source_platform, n AS campaign_size, {r6('mean')} AS avg_interval, {r6('std')} AS interval_std,
        {r6('1 - std / mean')} AS posting_regularity, std < mean * {factor} AS is_regular FROM {name}""",
        name,
    )


def _shown_intervals(df: DataFrame) -> DataFrame:
    return df.select(
        "source_platform", "campaign_size", d6("avg_interval"), d6("interval_std"), d6("posting_regularity"), "is_regular"
    )


@query("platform_intervals", _interval_sql("post_gaps", "0.2e0"))
def platform_intervals(spark, sf):
    return _shown_intervals(intervals.interval_statistics(fx.event_posts(spark, sf)))


@query("network_intervals", _interval_sql("content_gaps", "0.1e0"))
def network_intervals(spark, sf):
    """Documents arrive at an exact rhythm per source, so every platform is flagged."""
    return _shown_intervals(intervals.interval_statistics(fx.text_content(spark, sf), factor=0.1))


@query("load_order_intervals", _interval_sql("loaded_gaps", "0.1e0"))
def load_order_intervals(spark, sf):
    """Gaps in load order, newest first: the mean is negative and nothing is regular."""
    posts = fx.event_posts(spark, sf).withColumn("created_at", F.date_trunc("hour", "timestamp"))
    return _shown_intervals(intervals.interval_statistics(posts, factor=0.1, order="created_at", descending=True))


@query(
    "regular_posters",
    build(
        "SELECT source_platform, c.id AS content_id FROM content c JOIN content_gaps g USING (source_platform) WHERE g.std < g.mean * 0.1e0",
        "content",
        "content_gaps",
    ),
)
def regular_posters(spark, sf):
    content = fx.text_content(spark, sf)
    return intervals.regular_groups(content, cut_lineage(intervals.interval_statistics(content, factor=0.1)))


# --- models ---------------------------------------------------------------------------


@query(
    "class_weights",
    build(
        f"""SELECT source = 'human' AS is_authentic, count(*) AS n,
        {r6('CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*))')} AS weight
        FROM content WHERE source <> 'unknown' GROUP BY 1""",
        "content",
    ),
)
def class_weights(spark, sf):
    rows = projections.classifier_rows(sized_content(spark, sf))
    return models.class_weights(rows).select("is_authentic", "n", d6("weight"))


@query(
    "train_split",
    build(
        f"""SELECT CASE WHEN ('0x' || substr(md5(id), 1, 8))::BIGINT % 100 < 80 THEN 'train' ELSE 'eval' END AS part, count(*) AS n
        FROM content WHERE len({words_of('content')}) > 5 GROUP BY 1""",
        "content",
    ),
)
def train_split(spark, sf):
    rows = projections.classifier_rows(sized_content(spark, sf), labelled_only=False, min_words=5)
    train, held = models.split_rows(rows)
    both = train.select(F.lit("train").alias("part")).unionByName(held.select(F.lit("eval").alias("part")))
    return both.groupBy("part").agg(F.count("*").alias("n"))


@query(
    "authenticity_classifier",
    build("SELECT source = 'human' AS label, count(*) AS n, TRUE AS rated FROM content WHERE source <> 'unknown' GROUP BY 1", "content"),
)
def authenticity_classifier(spark, sf):
    """Rows per label that the trained model rates, each as one of the two classes."""
    rows = cut_lineage(projections.classifier_rows(sized_content(spark, sf)))
    rated = models.predict(models.train_classifier(rows), rows)
    return rated.groupBy((F.col("label") == 1).alias("label")).agg(
        F.count("*").alias("n"), F.every(F.col("prediction").isin(0.0, 1.0)).alias("rated")
    )


@query(
    "authenticity_classifier_v2",
    build(
        f"""SELECT count(*) AS rows, count(*) FILTER (source = 'human') AS positives, TRUE AS in_range FROM content
        WHERE len({words_of('content')}) > 5 AND ('0x' || substr(md5(id), 1, 8))::BIGINT % 100 >= 80""",
        "content",
    ),
)
def authenticity_classifier_v2(spark, sf):
    """The held-out rows behind the evaluation of the second model."""
    _, held = models.train_classifier_v2(cut_lineage(sized_content(spark, sf)))
    rated = models.evaluate(held)
    return rated.select(
        (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("rows"),
        (F.col("tp") + F.col("fn")).alias("positives"),
        F.col("f1_score").between(0, 1).alias("in_range"),
    )


@query(
    "prediction_metrics",
    build(
        f"""SELECT tp, fp, fn, tn, {r6('CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn)')} AS accuracy, {r6('p')} AS precision,
        {r6('r')} AS recall, {r6('CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END')} AS f1_score FROM (
          SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0e0 END AS p,
            CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0e0 END AS r FROM (
            SELECT count(*) FILTER (authenticity_score > 0.5e0 AND source = 'human') AS tp,
              count(*) FILTER (authenticity_score > 0.5e0 AND source <> 'human') AS fp,
              count(*) FILTER (authenticity_score <= 0.5e0 AND source = 'human') AS fn,
              count(*) FILTER (authenticity_score <= 0.5e0 AND source <> 'human') AS tn
            FROM scores WHERE source <> 'unknown'))""",
        "scores",
    ),
)
def prediction_metrics(spark, sf):
    scored = scoring.score_text(fx.text_content(spark, sf).where("source <> 'unknown'"), keep=("source",))
    judged = scored.select(
        (F.col("source") == "human").cast("double").alias("label"), (F.col("authenticity_score") > 0.5).cast("double").alias("prediction")
    )
    return models.evaluate(judged).select(
        "tp", "fp", "fn", "tn", *[d6(c) for c in ("accuracy", "precision", "recall", "f1_score")]
    )


@query("embedding_kmeans", "SELECT count(*) AS rows, TRUE AS within_bound FROM embeddings")
def embedding_kmeans(spark, sf):
    """Every row gets one of at most 50 clusters."""
    rows = cut_lineage(fx.vectors(spark, sf).withColumn("content_type", F.lit("text")))
    found = models.embedding_clusters(rows)[1]
    return found.agg(F.count("cluster").alias("rows"), (F.count_distinct("cluster") <= 50).alias("within_bound"))


# --- images -----------------------------------------------------------------------------


def _image_query(name: str, source: str, columns: tuple[str, ...], features) -> None:
    shown = ", ".join(f"{r6(c)} AS {c}" for c in columns)

    @query(name, build(f"SELECT image_id, {shown} FROM {source}", source))
    def run(spark, sf):
        return features(fx.rasters(spark, sf)).select("image_id", *[d6(c) for c in columns])


@query(
    "image_sizes",
    build(
        f"SELECT image_id, CAST(w AS DOUBLE) AS width, CAST(h AS DOUBLE) AS height, {r6('CAST(w AS DOUBLE) / h')} AS aspect_ratio, CAST(w * h AS DOUBLE) AS total_pixels FROM raster",
        "raster",
    ),
)
def image_sizes(spark, sf):
    return images.basic_features(fx.rasters(spark, sf)).select("image_id", "width", "height", d6("aspect_ratio"), "total_pixels")


_image_query(
    "image_colors", "color_stats", ("mean_brightness", "brightness_stddev", "mean_saturation", "saturation_stddev"), images.color_features
)
_image_query(
    "image_texture",
    "texture_stats",
    ("texture_variance", "texture_mean", "noise_estimate", "edge_strength", "edge_consistency", "edge_density"),
    lambda r: images.texture_features(images.with_gray(r)),
)
_image_query(
    "image_blocking", "blocking_stats", ("blocking_artifacts",), lambda r: images.blocking_artifacts(images.with_gray(r))
)
_image_query("image_noise", "noise_stats", ("noise_uniformity",), lambda r: images.noise_uniformity(images.with_gray(r)))


def _uniformity(channel: str) -> str:
    return f"""SELECT image_id, sqrt(sum(n * n) / 256e0 - pow(sum(n) / 256e0, 2)) / (sum(n) / 256e0) AS u
      FROM (SELECT image_id, {channel} AS value, CAST(count(*) AS DOUBLE) AS n FROM px GROUP BY 1, 2) GROUP BY image_id"""


@query(
    "image_histograms",
    build(
        f"""SELECT image_id, {r6('r.u')} AS red_uniformity, {r6('g.u')} AS green_uniformity, {r6('b.u')} AS blue_uniformity
        FROM ({_uniformity('r')}) r JOIN ({_uniformity('g')}) g USING (image_id) JOIN ({_uniformity('b')}) b USING (image_id)""",
        "px",
    ),
)
def image_histograms(spark, sf):
    out = images.histogram_features(fx.rasters(spark, sf))
    return out.select("image_id", *[d6(f"{c}_uniformity") for c in ("red", "green", "blue")])


@query("image_repetition", build(f"SELECT image_id, {r6('pattern_repetition')} AS pattern_repetition FROM repetition_stats", "repetition_stats"))
def image_repetition(spark, sf):
    """Template matching over whole images."""
    return images.pattern_repetition(images.with_gray(fx.rasters(spark, sf))).select("image_id", d6("pattern_repetition"))


@query(
    "image_rule_scores",
    build(
        f"""SELECT image_id AS content_id, {r6("greatest(0e0, least(1e0, " + steps('0.5e0', IMAGE_RULES) + "))")} AS authenticity_score,
        {r6("greatest(0.1e0, least(1e0, " + steps('0.5e0', [(IMAGE_RULES[0][0], '0.1e0'), (IMAGE_RULES[1][0], '0.1e0')]) + "))")} AS confidence_score,
        {messages([
            (IMAGE_RULES[0][0], 'Uniform noise pattern'),
            (IMAGE_RULES[1][0], 'Consistent saturation levels'),
            (IMAGE_RULES[2][0], 'Lack of natural compression artifacts'),
            (IMAGE_RULES[3][0], 'Unnaturally consistent edges'),
            (IMAGE_RULES[4][0], 'Natural noise variation'),
            (IMAGE_RULES[5][0], 'Natural compression artifacts'),
        ])} AS explanation
        FROM color_stats JOIN texture_stats USING (image_id) JOIN blocking_stats USING (image_id) JOIN noise_stats USING (image_id)""",
        "color_stats",
        "texture_stats",
        "blocking_stats",
        "noise_stats",
    ),
)
def image_rule_scores(spark, sf):
    """Image scores from the features SQL can check (a missing repetition counts as 0)."""
    rasters = fx.rasters(spark, sf)
    sums = written(images.raster_sums(images.with_gray(rasters)), "rasters")
    parts = images.color_features(sums)
    for more in (images.texture_features(sums), images.blocking_artifacts(sums), images.noise_uniformity(sums)):
        parts = parts.join(more, "image_id")
    nothing = F.lit(None).cast("double").alias("pattern_repetition")
    fields = ["noise_uniformity", "saturation_stddev", "blocking_artifacts", "edge_consistency"]
    rows = parts.select("image_id", F.struct(*fields, nothing).alias("features"))
    return scoring.score_images(rows).select("content_id", d6("authenticity_score"), d6("confidence_score"), "explanation")


_ALL_RULES = [*IMAGE_RULES[:4], REPETITION_RULE, *IMAGE_RULES[4:]]
_SURER = [(IMAGE_RULES[0][0], "0.1e0"), (IMAGE_RULES[1][0], "0.1e0"), (REPETITION_RULE[0], "0.1e0")]
# fixed values: what each rule reports
_IMAGE_MESSAGES = (
    "Uniform noise pattern",
    "Consistent saturation levels",
    "Lack of natural compression artifacts",
    "Unnaturally consistent edges",
    "Repetitive patterns detected",
    "Natural noise variation",
    "Natural compression artifacts",
)


@query(
    "image_scores",
    build(
        f"""SELECT image_id AS content_id, 'image' AS content_type,
        {r6("greatest(0e0, least(1e0, " + steps('0.5e0', _ALL_RULES) + "))")} AS authenticity_score,
        {r6("greatest(0.1e0, least(1e0, " + steps('0.5e0', _SURER) + "))")} AS confidence_score,
        {messages([(rule, text) for (rule, _), text in zip(_ALL_RULES, _IMAGE_MESSAGES)])} AS explanation, 'image_analyzer_v1.0' AS model_version
        FROM color_stats JOIN texture_stats USING (image_id) JOIN blocking_stats USING (image_id) JOIN noise_stats USING (image_id)
        JOIN repetition_stats USING (image_id)""",
        "color_stats",
        "texture_stats",
        "blocking_stats",
        "noise_stats",
        "repetition_stats",
    ),
)
def image_scores(spark, sf):
    """Full image scores, template matching included."""
    scored = scoring.score_images(images.image_features(fx.rasters(spark, sf)))
    return scored.select(
        "content_id", "content_type", d6("authenticity_score"), d6("confidence_score"), "explanation", "model_version"
    )


# --- detection and reports -----------------------------------------------------------------


@query(
    "coordinated_campaigns",
    build(
        f"""SELECT detection_method, campaign_id, campaign_size, {r6('similarity_score')} AS similarity_score FROM found
        WHERE detection_method IN ('semantic_campaigns', 'temporal_campaigns', 'network_campaigns', 'cross_platform_campaigns')""",
        "found",
    ),
)
def coordinated_campaigns(spark, sf):
    found = detection.detect_coordinated(fx.text_content(spark, sf))
    return found.campaigns.select("detection_method", "campaign_id", "campaign_size", d6("similarity_score"))


@query(
    "all_campaigns",
    build(f"SELECT detection_method, campaign_id, campaign_size, {r6('similarity_score')} AS similarity_score FROM found", "found"),
)
def all_campaigns(spark, sf):
    found = detection.detect_all(fx.text_content(spark, sf))
    return found.campaigns.select("detection_method", "campaign_id", "campaign_size", d6("similarity_score"))


@query("all_campaign_members", build("SELECT * FROM found_members", "found_members"))
def all_campaign_members(spark, sf):
    found = detection.detect_all(fx.text_content(spark, sf))
    return found.members.select("detection_method", "campaign_id", "content_id")


@query("campaign_summary", build("SELECT detection_method, count(*) AS campaigns FROM found GROUP BY 1", "found"))
def campaign_summary(spark, sf):
    return detection.detect_all(fx.text_content(spark, sf)).summary()


@query(
    "suspicious_content",
    build(
        """SELECT count(DISTINCT content_id) AS total_suspicious_content FROM found_members
        WHERE detection_method IN ('semantic_campaigns', 'temporal_campaigns', 'network_campaigns')""",
        "found_members",
    ),
)
def suspicious_content(spark, sf):
    return detection.detect_coordinated(fx.text_content(spark, sf)).suspicious_count()


def _behaviour(spark, sf) -> detection.Detection:
    """The families that need no vectors, for the report queries."""
    content = fx.text_content(spark, sf)
    return detection.unify(
        {
            "volume_spikes": rules.volume_spikes(fx.event_posts(spark, sf)),
            "authenticity_campaigns": rules.authenticity_patterns(content),
            "behavioral_campaigns": detection.interval_family(content, "platform_behavior_", 0.2),
        }
    )


_BEHAVIOUR = """SELECT 'volume_spikes' AS detection_method, 'volume_spike_' || strftime(hour, '%Y%m%d_%H') AS campaign_id, n AS campaign_size,
      CAST(NULL AS DOUBLE) AS avg_authenticity_score FROM post_spikes
    UNION ALL SELECT 'authenticity_campaigns', 'auth_' || substr(md5(common_explanation), 1, 8), n, mean FROM auth_patterns
    UNION ALL SELECT 'behavioral_campaigns', 'platform_behavior_' || source_platform, n, NULL FROM content_gaps WHERE std < mean * 0.2e0"""
_RANKED = f"SELECT *, row_number() OVER (PARTITION BY detection_method ORDER BY campaign_size DESC, campaign_id) AS rank FROM ({_BEHAVIOUR})"


@query(
    "top_campaigns",
    build(
        f"SELECT detection_method, rank, campaign_id, campaign_size, {r6('avg_authenticity_score')} AS avg_authenticity_score FROM ({_RANKED}) WHERE rank <= 5",
        "post_spikes",
        "auth_patterns",
        "content_gaps",
    ),
)
def top_campaigns(spark, sf):
    rows = reports.report_rows(_behaviour(spark, sf).campaigns, 5)
    return rows.select("detection_method", "rank", "campaign_id", "campaign_size", d6("avg_authenticity_score"))


@query(
    "report_lines",
    build(
        f"""SELECT detection_method, rank, '#' || rank || ' ' || campaign_id || ' | ' || campaign_size || ' items' ||
          COALESCE(' | authenticity ' || format('{{:.3f}}', avg_authenticity_score), '') AS line FROM ({_RANKED}) WHERE rank <= 10""",
        "post_spikes",
        "auth_patterns",
        "content_gaps",
    ),
)
def report_lines(spark, sf):
    return reports.report_lines(_behaviour(spark, sf).campaigns, 10)


@query(
    "short_report",
    build(
        """SELECT detection_method, campaign_id, '- Cluster ' || campaign_id || ': ' || campaign_size || CASE detection_method
        WHEN 'semantic_campaigns' THEN ' items, avg similarity: ' || format('{:.3f}', similarity_score) ELSE ' items in time window' END AS line
        FROM found WHERE detection_method IN ('semantic_campaigns', 'temporal_campaigns')""",
        "found",
    ),
)
def short_report(spark, sf):
    return reports.short_report_lines(detection.detect_coordinated(fx.text_content(spark, sf)))


@query(
    "short_summary",
    build(
        """SELECT count(*) FILTER (detection_method = 'semantic_campaigns') AS total_semantic_campaigns,
        count(*) FILTER (detection_method = 'temporal_campaigns') AS total_temporal_campaigns,
        count(*) FILTER (detection_method = 'network_campaigns') AS total_network_campaigns,
        count(*) FILTER (detection_method = 'cross_platform_campaigns') AS total_cross_platform_campaigns,
        (SELECT count(DISTINCT content_id) FROM found_members
          WHERE detection_method IN ('semantic_campaigns', 'temporal_campaigns', 'network_campaigns')) AS total_suspicious_content
        FROM found""",
        "found",
        "found_members",
    ),
)
def short_summary(spark, sf):
    return reports.short_summary(detection.detect_coordinated(fx.text_content(spark, sf)))


# --- streaming ---------------------------------------------------------------------------------


def _post_stream(spark, sf) -> DataFrame:
    return fx.streamed(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_type").alias("source_platform"),
    )


def _streamed_counts(spark, sf) -> DataFrame:
    out, state = monitors.scratch(spark, "volume")
    monitors.run_to_end(monitors.latest_counts(_post_stream(spark, sf), out, state))
    monitors.compact_counts(spark, out)
    return monitors.newest_counts(spark, out)


@query(
    "stream_hourly_volume",
    build(f"SELECT {moment('hour')} AS hour, source_platform, count(*) AS n FROM post_hours GROUP BY 1, 2", "post_hours"),
)
def stream_hourly_volume(spark, sf):
    return _streamed_counts(spark, sf).select(when_text("hour"), "source_platform", "n")


@query(
    "stream_text_scores",
    build(
        f"SELECT CAST(doc_id AS VARCHAR) AS content_id, {r6('authenticity_score')} AS authenticity_score, explanation FROM scores JOIN documents ON content_id = CAST(doc_id AS VARCHAR)",
        "scores",
    ).replace(f"CASE WHEN d.doc_id % 7 = 0 THEN d.text || {quoted(fx.PHRASE)} ELSE d.text END AS content", "d.text AS content"),
)
def stream_text_scores(spark, sf):
    raw = fx.streamed(spark, sf, "documents")
    scored = monitors.score_stream(raw.select(F.col("doc_id").alias("id"), F.col("text").alias("content")))
    out, state = monitors.scratch(spark, "scores")
    monitors.run_to_end(monitors.write_parquet(scored, out, state))
    return spark.read.parquet(out).select("content_id", d6("authenticity_score"), "explanation")


@query("stream_spike_alerts", build(f"SELECT {moment('hour')} AS hour, n FROM post_spikes", "post_spikes"))
def stream_spike_alerts(spark, sf):
    """Streamed counts checked against the batch baseline."""
    hourly = rules.hourly_counts(fx.event_posts(spark, sf))
    baseline = hourly.agg(F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"))
    return monitors.spike_alerts(_streamed_counts(spark, sf), baseline).select(when_text("hour"), "n")


@query(
    "campaign_rate_alert",
    build(
        f"SELECT {moment('hour')} AS hour, n AS new_campaigns FROM (SELECT date_trunc('day', hour) AS hour, count(*) AS n FROM post_spikes GROUP BY 1) WHERE n > 1",
        "post_spikes",
    ),
)
def campaign_rate_alert(spark, sf):
    found, _ = rules.volume_spikes(fx.event_posts(spark, sf))
    rows = found.select(F.col("campaign_key").alias("campaign_id"), F.date_trunc("day", "hour").alias("detected_at"))
    return monitors.campaign_rate_alert(rows, per_hour=1).select(when_text("hour"), "new_campaigns")


@query(
    "alert_rules",
    f"""SELECT source_platform, {r6('accuracy')} AS accuracy, {r6('max_latency')} AS max_latency, {r6('error_rate')} AS error_rate,
    accuracy < 0.8e0 AS accuracy_alert, max_latency > 60 AS latency_alert, error_rate > 0.05e0 AS error_alert FROM (
      SELECT event_type AS source_platform, avg(CASE WHEN user_id % 6 > 0 THEN 1e0 ELSE 0e0 END) AS accuracy, max(value) AS max_latency,
        avg(CASE WHEN value < 1 THEN 1e0 ELSE 0e0 END) AS error_rate FROM events GROUP BY 1)""",
)
def alert_rules(spark, sf):
    metrics = fx.table(spark, sf, "events").select(
        F.col("event_type").alias("source_platform"),
        (F.col("user_id") % 6 > 0).alias("correct"),
        F.col("value").alias("latency_seconds"),
        (F.col("value") < 1).alias("failed"),
    )
    out = rollups.alert_rules(metrics, by=("source_platform",))
    return out.select(
        "source_platform", d6("accuracy"), d6("max_latency"), d6("error_rate"), "accuracy_alert", "latency_alert", "error_alert"
    )
