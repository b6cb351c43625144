"""SQL building blocks of the checks: named CTEs and the queries made of them."""

from __future__ import annotations

from candor import config
from candor.plans.fixtures import PHRASE, RASTER_WIDTH

# fixed values: the listed phrases and words, stated here again so that the checks stand on their own
AI_PHRASES = (
    "as an ai",
    "i'm an ai",
    "as a language model",
    "i don't have personal",
    "i can't browse",
    "i don't have access",
    "as of my last update",
    "i'm sorry, but i",
    "i understand you're looking",
    "it's important to note",
    "please note that",
    "i'd be happy to help",
    "furthermore",
    "moreover",
    "additionally",
    "in conclusion",
)
FORMAL_WORDS = ("utilize", "facilitate", "implement", "furthermore", "therefore", "however")
STOP_WORDS = {
    "en": "the of and to in is it that for on with as was by be this are at from his they".split(),
    "fr": "le la les de des du et un une est que qui dans en pour par sur au avec pas".split(),
    "de": "der die das und ist von zu mit den dem ein eine nicht sich auf für im auch es als".split(),
    "es": "el los las de del y un una es que en por con para se su al lo como más".split(),
}

WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPLIT_WS = WS + "+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def r6(expression: str) -> str:
    """Half-up rounding by plain double arithmetic, the same operations on both sides."""
    return f"(floor(CAST({expression} AS DOUBLE) * 1e6 + 0.5e0) / 1e6 + 0e0)"


def words_of(expression: str) -> str:
    return f"list_filter(regexp_split_to_array({expression}, '{SPLIT_WS}'), lambda w: w <> '')"


def listed(column: str, items) -> str:
    return " + ".join(f"CAST(contains({column}, {quoted(i)}) AS INTEGER)" for i in items)


def hour_key(column: str = "hour") -> str:
    return f"strftime({column}, '%Y%m%d_%H')"


def moment(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def steps(start: str, rules) -> str:
    out = start
    for condition, amount in rules:
        out += f" + CASE WHEN {condition} THEN {amount} ELSE 0e0 END"
    return out


def messages(parts) -> str:
    cases = ", ".join(f"CASE WHEN {c} THEN {quoted(t)} END" for c, t in parts)
    return f"COALESCE(NULLIF(concat_ws('; ', {cases}), ''), 'No clear indicators')"


def around(dx: int, dy: int, x0="0", x1="w - 1", y0="0", y1="h - 1") -> str:
    """Gray value of a neighbour with mirrored borders inside x0..x1, y0..y1."""

    def mirror(i, low, high):
        return (
            f"least(greatest(CASE WHEN {i} < {low} THEN 2*({low}) - ({i}) "
            f"WHEN {i} > {high} THEN 2*({high}) - ({i}) ELSE {i} END, {low}), {high})"
        )

    return f"gray[({mirror(f'(y+({dy}))', y0, y1)}) * w + ({mirror(f'(x+({dx}))', x0, x1)}) + 1]"


def laplacian(**window) -> str:
    at = lambda dx, dy: around(dx, dy, **window)
    return f"({at(1, 0)} + {at(-1, 0)} + {at(0, 1)} + {at(0, -1)} - 4*{at(0, 0)})"


def sobel() -> str:
    a = around
    gx = f"({a(1, -1)} + 2*{a(1, 0)} + {a(1, 1)} - {a(-1, -1)} - 2*{a(-1, 0)} - {a(-1, 1)})"
    gy = f"({a(-1, 1)} + 2*{a(0, 1)} + {a(1, 1)} - {a(-1, -1)} - 2*{a(0, -1)} - {a(1, -1)})"
    return f"sqrt(CAST({gx}*{gx} + {gy}*{gy} AS DOUBLE))"


def exact_var(column: str) -> str:
    """Population variance from whole-number sums."""
    n, s, q = "count(*)", f"sum({column})", f"sum({column} * {column})"
    return f"CAST({n} * {q} - {s} * {s} AS DOUBLE) / (CAST({n} AS DOUBLE) * {n})"


_STOP = ", ".join(f"({quoted(lang)}, {quoted(w)})" for lang, ws in STOP_WORDS.items() for w in ws)

TEXT_RULES = [
    ("ai_phrase_density > 0.01e0", "-0.3e0"),
    ("repetition_score > 0.1e0", "-0.2e0"),
    ("perfect_punctuation > 0.5e0", "-0.15e0"),
    ("formal_language_density > 0.05e0", "-0.1e0"),
    ("flesch_reading_ease > 70e0", "-0.1e0"),
    ("flesch_reading_ease < 30e0", "0.1e0"),
    ("sentence_length_std > 5e0", "0.1e0"),
]
REPETITION_RULE = ("pattern_repetition > 0.1e0", "-0.15e0")
IMAGE_RULES = [
    ("noise_uniformity < 0.1e0", "-0.2e0"),
    ("saturation_stddev < 20e0", "-0.15e0"),
    ("blocking_artifacts < 0.01e0", "-0.1e0"),
    ("edge_consistency < 10e0", "-0.1e0"),
    ("noise_uniformity > 0.3e0", "0.1e0"),
    ("blocking_artifacts > 0.01e0 AND blocking_artifacts < 0.1e0", "0.05e0"),
]

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def build(final: str, *needs: str, recursive: bool = False) -> str:
    """WITH query of ``final`` and everything it needs, in dependency order."""
    order: list[str] = []

    def add(name):
        if name not in order:
            for n in CTES[name][0]:
                add(n)
            order.append(name)

    for name in needs:
        add(name)
    if not order:
        return final
    head = "WITH RECURSIVE " if recursive or "reach" in order or "graph_reach" in order else "WITH "
    return head + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + final


# inputs
cte(
    "content",
    f"""SELECT CAST(d.doc_id AS VARCHAR) AS id,
    CASE WHEN d.doc_id % 7 = 0 THEN d.text || {quoted(PHRASE)} ELSE d.text END AS content,
    CASE WHEN l.quality = 1 THEN 'human' WHEN l.quality = 0 THEN 'ai_generated' ELSE 'unknown' END AS source,
    d.source AS source_platform, d.lang AS language, d.n_chars,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id * 7) AS timestamp,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id * 7 + 60) AS created_at
    FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
cte("posts", "SELECT CAST(event_id AS VARCHAR) AS id, ts AS timestamp, event_type AS source_platform, props FROM events")
cte(
    "emb",
    "SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS v, 'kind' || label AS content_type FROM embeddings",
)

# text features and scores
cte(
    "tokens",
    f"""SELECT id, source, content, lower(content) AS low, {words_of('content')} AS ws,
    regexp_split_to_array(content, '[.!?]+') AS pieces FROM content""",
    "content",
)
cte(
    "sized",
    f"""SELECT *, list_transform(ws, lambda w: length(w)) AS wl,
    list_filter(list_transform(pieces, lambda s: len({words_of('s')})), lambda k: k > 0) AS sl FROM tokens""",
    "tokens",
)
cte("low_words", "SELECT id, unnest(list_transform(ws, lambda w: lower(w))) AS w FROM tokens", "tokens")
cte(
    "repeats",
    """SELECT id, max(n) AS top FROM (SELECT id, w, count(*) AS n FROM low_words WHERE length(w) > 3 GROUP BY id, w)
    GROUP BY id""",
    "low_words",
)
cte("stop_words", f"SELECT * FROM (VALUES {_STOP}) AS t(lang, w)")
cte(
    "detected",
    """SELECT id, lang FROM (SELECT id, lang, row_number() OVER (PARTITION BY id ORDER BY n DESC, lang) AS rn
    FROM (SELECT id, lang, count(*) AS n FROM low_words JOIN stop_words USING (w) GROUP BY id, lang)) WHERE rn = 1""",
    "low_words",
    "stop_words",
)
cte(
    "features",
    f"""SELECT s.id, s.source, length(content) AS char_count, len(ws) AS word_count, len(pieces) AS sentence_count,
    CASE WHEN len(ws) > 0 THEN 206.835e0 - 1.015e0 * (CAST(len(ws) AS DOUBLE) / greatest(len(sl), 1))
      - 84.6e0 * (CAST(len(regexp_extract_all(low, '[aeiouy]+')) AS DOUBLE) / len(ws)) ELSE 0e0 END AS flesch_reading_ease,
    CASE WHEN len(ws) > 0 THEN 0.39e0 * (CAST(len(ws) AS DOUBLE) / greatest(len(sl), 1))
      + 11.8e0 * (CAST(len(regexp_extract_all(low, '[aeiouy]+')) AS DOUBLE) / len(ws)) - 15.59e0 ELSE 0e0 END AS flesch_kincaid_grade,
    COALESCE(d.lang, 'unknown') AS language,
    CASE WHEN d.lang = 'en' THEN 1e0 ELSE 0e0 END AS is_english,
    CAST(length(content) - length(replace(content, '!', '')) AS DOUBLE) / length(content) AS exclamation_ratio,
    CAST(length(content) - length(replace(content, '?', '')) AS DOUBLE) / length(content) AS question_ratio,
    CAST(length(content) - length(replace(content, '.', '')) AS DOUBLE) / length(content) AS period_ratio,
    CAST(length(content) - length(replace(content, ',', '')) AS DOUBLE) / length(content) AS comma_ratio,
    CAST(len(regexp_extract_all(content, '\\p{{Lu}}')) AS DOUBLE) / length(content) AS uppercase_ratio,
    CAST(len(regexp_extract_all(content, '\\p{{Nd}}')) AS DOUBLE) / length(content) AS digit_ratio,
    list_aggregate(wl, 'avg') AS avg_word_length, list_aggregate(wl, 'stddev_pop') AS word_length_std,
    list_aggregate(sl, 'avg') AS avg_sentence_length, list_aggregate(sl, 'stddev_pop') AS sentence_length_std,
    CASE WHEN len(ws) > 0 THEN CAST({listed('low', AI_PHRASES)} AS DOUBLE) / len(ws) ELSE 0e0 END AS ai_phrase_density,
    CASE WHEN len(ws) >= 2 THEN CAST(COALESCE(r.top, 0) AS DOUBLE) / len(ws) ELSE 0e0 END AS repetition_score,
    CASE WHEN len(ws) > 0 THEN CAST({listed('low', FORMAL_WORDS)} AS DOUBLE) / len(ws) ELSE 0e0 END AS formal_language_density,
    CASE WHEN len(pieces) >= 2 AND CAST(len(list_filter(pieces, lambda s: regexp_matches(s, '^{WS}*\\p{{Lu}}'))) AS DOUBLE)
      / len(pieces) > 0.95e0 THEN 1e0 ELSE 0e0 END AS perfect_punctuation
    FROM sized s LEFT JOIN repeats r USING (id) LEFT JOIN detected d USING (id) WHERE length(content) > 0""",
    "sized",
    "repeats",
    "detected",
)
cte(
    "scores",
    f"""SELECT id AS content_id, source, word_count,
    greatest(0e0, least(1e0, {steps('0.5e0', TEXT_RULES)})) AS authenticity_score,
    greatest(0.1e0, least(1e0, {steps('0.5e0', [
        (TEXT_RULES[0][0], '0.2e0'), (TEXT_RULES[1][0], '0.1e0'), (TEXT_RULES[2][0], '0.1e0'), (TEXT_RULES[3][0], '0.05e0')
    ])})) AS confidence_score,
    {messages([
        (TEXT_RULES[0][0], 'Contains AI-specific phrases'),
        (TEXT_RULES[1][0], 'High repetition patterns'),
        (TEXT_RULES[2][0], 'Overly perfect punctuation'),
        (TEXT_RULES[3][0], 'High formal language density'),
        (TEXT_RULES[6][0], 'Natural sentence length variation'),
    ])} AS explanation
    FROM (SELECT * REPLACE (COALESCE(sentence_length_std, 0e0) AS sentence_length_std) FROM features)""",
    "features",
)

# embeddings and pairs
cte("lower_words", f"SELECT id, unnest({words_of('lower(content)')}) AS w FROM content", "content")
cte(
    "bucketed",
    f"""SELECT id, CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % {config.EMBEDDING_DIM} AS INTEGER) AS bucket,
    CAST(count(*) AS DOUBLE) AS n FROM lower_words GROUP BY 1, 2""",
    "lower_words",
)
cte(
    "sparse",
    "SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS v FROM bucketed",
    "bucketed",
)
cte(
    "dense",
    f"""SELECT k.id, list(COALESCE(s.v, 0e0) ORDER BY k.b) AS v
    FROM (SELECT id, unnest(range({config.EMBEDDING_DIM})) AS b FROM (SELECT DISTINCT id FROM sparse)) k
    LEFT JOIN sparse s ON s.id = k.id AND s.bucket = k.b GROUP BY k.id""",
    "sparse",
)
cte(
    "text_cosines",
    """SELECT a.id AS id_1, b.id AS id_2, round(list_cosine_similarity(a.v, b.v), 12) AS s
    FROM dense a JOIN dense b ON a.id < b.id""",
    "dense",
)
cte("text_pairs", "SELECT * FROM text_cosines WHERE s >= 0.85e0", "text_cosines")
cte(
    "vector_pairs",
    """SELECT a.id AS content_id_1, b.id AS content_id_2, round(list_cosine_similarity(a.v, b.v), 12) AS s
    FROM emb a JOIN emb b ON a.id < b.id WHERE round(list_cosine_similarity(a.v, b.v), 12) >= 0.35e0""",
    "emb",
)

# clusters of texts
cte("links", "SELECT id_1 AS a, id_2 AS b FROM text_pairs UNION ALL SELECT id_2, id_1 FROM text_pairs", "text_pairs")
cte(
    "core",
    "SELECT d.id FROM dense d LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = d.id WHERE COALESCE(n, 0) + 1 >= 3",
    "dense",
    "links",
)
cte(
    "reach",
    """SELECT id, id AS root FROM core UNION
    SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id JOIN core c ON c.id = l.b""",
    "core",
    "links",
)
cte("core_label", "SELECT id, min(root) AS cluster FROM reach GROUP BY id", "reach")
cte(
    "clustered",
    """SELECT id, cluster, TRUE AS core FROM core_label UNION ALL
    SELECT l.a, min(c.cluster), FALSE FROM links l JOIN core_label c ON c.id = l.b
    WHERE l.a NOT IN (SELECT id FROM core) GROUP BY l.a""",
    "core_label",
    "links",
    "core",
)
cte(
    "cohesion",
    """SELECT a.cluster, count(*) AS pairs, avg(list_cosine_similarity(da.v, db.v)) AS avg_similarity
    FROM clustered a JOIN clustered b ON a.cluster = b.cluster AND a.id < b.id
    JOIN dense da ON da.id = a.id JOIN dense db ON db.id = b.id GROUP BY a.cluster""",
    "clustered",
    "dense",
)
cte("cluster_sizes", "SELECT cluster, count(*) AS n FROM clustered GROUP BY cluster", "clustered")

# similarity graph of the vectors
cte(
    "graph_links",
    "SELECT content_id_1 AS a, content_id_2 AS b FROM vector_pairs UNION ALL SELECT content_id_2, content_id_1 FROM vector_pairs",
    "vector_pairs",
)
cte(
    "graph_reach",
    "SELECT id, id AS root FROM emb UNION SELECT l.b, r.root FROM graph_reach r JOIN graph_links l ON l.a = r.id",
    "emb",
    "graph_links",
)
cte("graph_parts", "SELECT id, min(root) AS component FROM graph_reach GROUP BY id", "graph_reach")
cte(
    "coefficients",
    """SELECT e.id, COALESCE(d.degree, 0) AS degree, COALESCE(t.triangles, 0) AS triangles,
    CASE WHEN COALESCE(d.degree, 0) >= 2 THEN 2e0 * COALESCE(t.triangles, 0) / (d.degree * (d.degree - 1)) ELSE 0e0 END AS coefficient
    FROM emb e LEFT JOIN (SELECT a, count(*) AS degree FROM graph_links GROUP BY a) d ON d.a = e.id
    LEFT JOIN (SELECT x.a, count(*) AS triangles FROM graph_links x JOIN graph_links y ON x.a = y.a AND x.b < y.b
      JOIN graph_links z ON z.a = x.b AND z.b = y.b GROUP BY x.a) t ON t.a = e.id""",
    "emb",
    "graph_links",
)
cte(
    "components",
    """SELECT component, count(*) AS size, CAST(sum(degree) / 2 AS BIGINT) AS edges, avg(coefficient) AS avg_clustering
    FROM graph_parts JOIN coefficients USING (id) GROUP BY component""",
    "graph_parts",
    "coefficients",
)

# campaign families
cte("content_hours", "SELECT *, date_trunc('hour', timestamp) AS hour FROM content", "content")
cte(
    "temporal",
    """SELECT h.hour, h.n, p.pairs FROM (SELECT hour, count(*) AS n FROM content_hours GROUP BY hour HAVING count(*) >= 5) h
    JOIN (SELECT a.hour, count(*) AS pairs FROM content_hours a JOIN content_hours b ON a.hour = b.hour
      JOIN text_cosines t ON t.id_1 = a.id AND t.id_2 = b.id WHERE t.s >= 0.8e0 GROUP BY a.hour) p USING (hour)""",
    "content_hours",
    "text_cosines",
)
cte(
    "cross_matches",
    """SELECT least(a.source_platform, b.source_platform) AS platform_1, greatest(a.source_platform, b.source_platform) AS platform_2,
    CASE WHEN a.source_platform < b.source_platform THEN a.id ELSE b.id END AS content_id_1,
    CASE WHEN a.source_platform < b.source_platform THEN b.id ELSE a.id END AS content_id_2, t.s AS similarity
    FROM text_pairs t JOIN content a ON a.id = t.id_1 JOIN content b ON b.id = t.id_2
    WHERE a.source_platform <> b.source_platform""",
    "text_pairs",
    "content",
)
cte(
    "cross_found",
    """SELECT platform_1, platform_2, count(*) AS matches FROM cross_matches
    WHERE platform_1 IN (SELECT source_platform FROM content GROUP BY 1 HAVING count(*) >= 2)
      AND platform_2 IN (SELECT source_platform FROM content GROUP BY 1 HAVING count(*) >= 2)
    GROUP BY 1, 2 HAVING count(*) >= 2""",
    "cross_matches",
    "content",
)
cte(
    "cross_members",
    """SELECT DISTINCT platform_1, platform_2, content_id FROM (
      SELECT platform_1, platform_2, content_id_1 AS content_id FROM cross_matches UNION ALL
      SELECT platform_1, platform_2, content_id_2 FROM cross_matches) JOIN cross_found USING (platform_1, platform_2)""",
    "cross_matches",
    "cross_found",
)
cte("post_hours", "SELECT *, date_trunc('hour', timestamp) AS hour FROM posts", "posts")


def spikes(rows: str) -> str:
    return f"""SELECT hour, n, n / mean AS multiplier FROM (SELECT hour, count(*) AS n FROM {rows} GROUP BY hour),
    (SELECT avg(n) AS mean, stddev_samp(n) AS std FROM (SELECT hour, count(*) AS n FROM {rows} GROUP BY hour))
    WHERE n > mean + 2e0 * std AND n >= 5"""


cte("post_spikes", spikes("post_hours"), "post_hours")
cte("content_spikes", spikes("content_hours"), "content_hours")


def lengths(rows: str) -> str:
    return f"""SELECT bucket, n, mean, 1e0 - std / mean AS consistency FROM (
      SELECT CAST(floor(len / (len * 0.1e0 + 10e0)) AS INTEGER) AS bucket, count(*) AS n, avg(len) AS mean, stddev_pop(len) AS std
      FROM {rows} GROUP BY 1) WHERE n >= 5 AND std / mean < 0.1e0"""


cte("content_lengths", "SELECT id, CAST(length(content) AS DOUBLE) AS len FROM content", "content")
cte("content_length_patterns", lengths("content_lengths"), "content_lengths")
cte(
    "turn_lengths",
    "SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, CAST(length(text) AS DOUBLE) AS len FROM conversations",
)
cte("turn_length_patterns", lengths("turn_lengths"), "turn_lengths")
cte(
    "low_scores",
    "SELECT content_id, authenticity_score, substr(explanation, 1, 50) AS common_explanation FROM scores WHERE authenticity_score < 0.3e0",
    "scores",
)
cte(
    "auth_patterns",
    """SELECT common_explanation, count(*) AS n, avg(authenticity_score) AS mean FROM low_scores
    GROUP BY 1 HAVING count(*) >= 5""",
    "low_scores",
)


def gaps(rows: str, order: str) -> str:
    return f"""SELECT source_platform, count(*) + 1 AS n, avg(gap) AS mean, stddev_samp(gap) AS std FROM (
      SELECT source_platform, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY source_platform ORDER BY {order}))) / 1e6 AS gap
      FROM {rows}) WHERE gap IS NOT NULL GROUP BY source_platform HAVING count(*) + 1 >= 5 AND count(*) > 1"""


cte("post_gaps", gaps("posts", "timestamp, id"), "posts")
cte("content_gaps", gaps("content", "timestamp, id"), "content")
cte(
    "loaded_gaps",
    gaps("(SELECT *, date_trunc('hour', timestamp) AS created_at FROM posts)", "created_at DESC, timestamp DESC, id"),
    "posts",
)
cte(
    "found",
    """SELECT 'semantic_campaigns' AS detection_method, 'cluster_' || s.cluster AS campaign_id, s.n AS campaign_size,
      c.avg_similarity AS similarity_score FROM cluster_sizes s JOIN cohesion c USING (cluster)
    UNION ALL SELECT 'temporal_campaigns', 'temporal_' || strftime(hour, '%Y%m%d_%H'), n, 0e0 FROM temporal
    UNION ALL SELECT 'network_campaigns', 'network_' || source_platform, n, 0e0 FROM content_gaps WHERE std < mean * 0.1e0
    UNION ALL SELECT 'cross_platform_campaigns', 'cross_platform_' || platform_1 || '_' || platform_2, count(*), 0e0
      FROM cross_members GROUP BY platform_1, platform_2
    UNION ALL SELECT 'authenticity_campaigns', 'auth_' || substr(md5(common_explanation), 1, 8), n, 0e0 FROM auth_patterns
    UNION ALL SELECT 'behavioral_campaigns', 'platform_behavior_' || source_platform, n, 0e0 FROM content_gaps WHERE std < mean * 0.2e0
    UNION ALL SELECT 'volume_spikes', 'volume_spike_' || strftime(hour, '%Y%m%d_%H'), n, 0e0 FROM content_spikes
    UNION ALL SELECT 'length_pattern_campaigns', 'length_pattern_' || bucket, n, 0e0 FROM content_length_patterns""",
    "cluster_sizes",
    "cohesion",
    "temporal",
    "content_gaps",
    "cross_members",
    "auth_patterns",
    "content_spikes",
    "content_length_patterns",
)
cte(
    "found_members",
    """SELECT 'semantic_campaigns' AS detection_method, 'cluster_' || cluster AS campaign_id, id AS content_id FROM clustered
    UNION ALL SELECT 'temporal_campaigns', 'temporal_' || strftime(hour, '%Y%m%d_%H'), h.id FROM content_hours h JOIN temporal USING (hour)
    UNION ALL SELECT 'network_campaigns', 'network_' || source_platform, c.id FROM content c JOIN content_gaps g USING (source_platform)
      WHERE g.std < g.mean * 0.1e0
    UNION ALL SELECT 'cross_platform_campaigns', 'cross_platform_' || platform_1 || '_' || platform_2, content_id FROM cross_members
    UNION ALL SELECT 'authenticity_campaigns', 'auth_' || substr(md5(common_explanation), 1, 8), content_id
      FROM low_scores JOIN auth_patterns USING (common_explanation)
    UNION ALL SELECT 'behavioral_campaigns', 'platform_behavior_' || source_platform, c.id FROM content c JOIN content_gaps g USING (source_platform)
      WHERE g.std < g.mean * 0.2e0
    UNION ALL SELECT 'volume_spikes', 'volume_spike_' || strftime(hour, '%Y%m%d_%H'), h.id FROM content_hours h JOIN content_spikes USING (hour)
    UNION ALL SELECT 'length_pattern_campaigns', 'length_pattern_' || bucket, l.id FROM content_lengths l
      JOIN content_length_patterns p ON p.bucket = CAST(floor(l.len / (l.len * 0.1e0 + 10e0)) AS INTEGER)""",
    "clustered",
    "content_hours",
    "temporal",
    "content",
    "content_gaps",
    "cross_members",
    "low_scores",
    "auth_patterns",
    "content_spikes",
    "content_lengths",
    "content_length_patterns",
)

# rasters
cte(
    "codes",
    f"""SELECT CAST(doc_id AS VARCHAR) AS image_id, {RASTER_WIDTH} AS w, CAST(ceil(length(text) / {RASTER_WIDTH}.0) AS INTEGER) AS h,
    list_transform(string_split(text, ''), lambda c: ord(c) % 256) AS c FROM documents WHERE length(text) > 0""",
)
cte(
    "raster",
    "SELECT image_id, w, h, list_concat(c, list_transform(range(w * h - len(c)), lambda i: 32)) AS r FROM codes",
    "codes",
)
cte(
    "px",
    """SELECT image_id, w, h, CAST(p AS INTEGER) AS p, CAST(p // w AS INTEGER) AS y, CAST(p % w AS INTEGER) AS x,
    r[p + 1] AS r, (r[p + 1] * 3 + p) % 256 AS g, (r[p + 1] * 7) % 256 AS b
    FROM (SELECT image_id, w, h, r, unnest(range(w * h)) AS p FROM raster)""",
    "raster",
)
cte("gray_px", "SELECT image_id, w, h, p, x, y, (299 * r + 587 * g + 114 * b + 500) // 1000 AS v FROM px", "px")
cte("gray_list", "SELECT image_id, w, h, list(v ORDER BY p) AS gray FROM gray_px GROUP BY image_id, w, h", "gray_px")
cte(
    "stencil",
    """SELECT image_id, w, h, gray, CAST(p // w AS INTEGER) AS y, CAST(p % w AS INTEGER) AS x
    FROM (SELECT image_id, w, h, gray, unnest(range(w * h)) AS p FROM gray_list)""",
    "gray_list",
)
cte(
    "color_stats",
    """SELECT image_id, (avg(r) + avg(g) + avg(b)) / 3 AS mean_brightness,
    (stddev_pop(r) + stddev_pop(g) + stddev_pop(b)) / 3 AS brightness_stddev, avg(s) AS mean_saturation, stddev_pop(s) AS saturation_stddev
    FROM (SELECT *, CASE WHEN greatest(r, g, b) > 0 THEN
      (510 * (greatest(r, g, b) - least(r, g, b)) + greatest(r, g, b)) // (2 * greatest(r, g, b)) ELSE 0 END AS s FROM px)
    GROUP BY image_id""",
    "px",
)
cte(
    "texture_stats",
    f"""SELECT image_id, {exact_var('v')} AS texture_variance, avg(v) AS texture_mean, {exact_var('lap')} AS noise_estimate,
    avg(grad) AS edge_strength, stddev_pop(grad) AS edge_consistency, avg(CASE WHEN grad > 150 THEN 1e0 ELSE 0e0 END) AS edge_density
    FROM (SELECT image_id, {around(0, 0)} AS v, {laplacian()} AS lap, {sobel()} AS grad FROM stencil) GROUP BY image_id""",
    "stencil",
)
cte(
    "blocking_stats",
    """SELECT image_id, (COALESCE(j.by_rows, 0) / CAST(w AS DOUBLE) + COALESCE(j.by_cols, 0) / CAST(h AS DOUBLE)) / (w * h) AS blocking_artifacts
    FROM raster LEFT JOIN (
      SELECT image_id, CAST(sum(abs(s - before)) FILTER (axis = 'row') AS DOUBLE) AS by_rows,
        CAST(sum(abs(s - before)) FILTER (axis = 'col') AS DOUBLE) AS by_cols FROM (
        SELECT image_id, 'row' AS axis, y AS i, max(h) AS span, sum(v) AS s,
          lag(sum(v)) OVER (PARTITION BY image_id ORDER BY y) AS before FROM gray_px GROUP BY image_id, y
        UNION ALL
        SELECT image_id, 'col', x, max(w), sum(v), lag(sum(v)) OVER (PARTITION BY image_id ORDER BY x) FROM gray_px GROUP BY image_id, x)
      WHERE i % 8 = 0 AND i >= 8 AND i < span - 8 GROUP BY image_id) j USING (image_id)""",
    "raster",
    "gray_px",
)
cte(
    "noise_stats",
    f"""SELECT image_id, COALESCE(u, 0e0) AS noise_uniformity FROM raster LEFT JOIN (
      SELECT image_id, CASE WHEN count(*) >= 2 AND avg(noise) > 0 THEN stddev_pop(noise) / avg(noise) ELSE 0e0 END AS u FROM (
        SELECT image_id, x // 32 AS bx, y // 32 AS by, var_pop({laplacian(
            x0='(x // 32) * 32', x1='(x // 32) * 32 + 31', y0='(y // 32) * 32', y1='(y // 32) * 32 + 31')}) AS noise
        FROM stencil WHERE (x // 32 + 1) * 32 < w AND (y // 32 + 1) * 32 < h GROUP BY image_id, x // 32, y // 32)
      GROUP BY image_id) USING (image_id)""",
    "raster",
    "stencil",
)
PATCH, TEMPLATE_LEAST = 16, 32
cte("image_lines", "SELECT image_id, w, h, y, list(CAST(v AS DOUBLE) ORDER BY x) AS line FROM gray_px GROUP BY image_id, w, h, y", "gray_px")
cte(
    "template_lines",
    f"""SELECT image_id, y - (h // 2 - 8) AS k, line[w // 2 - 7 : w // 2 + 8] AS part FROM image_lines
    WHERE w >= {TEMPLATE_LEAST} AND h >= {TEMPLATE_LEAST} AND y BETWEEN h // 2 - 8 AND h // 2 + 7""",
    "image_lines",
)
cte(
    "templates",
    "SELECT image_id, sum(list_sum(part)) AS s, sum(list_dot_product(part, part)) - sum(list_sum(part)) ** 2 / 256e0 AS own FROM template_lines GROUP BY image_id",
    "template_lines",
)
cte(
    "windows",
    f"""SELECT image_id, y0, x, sum(list_sum(seen)) AS s, sum(list_dot_product(seen, seen)) AS q, sum(list_dot_product(seen, part)) AS d FROM (
      SELECT image_id, y - k AS y0, x, part, line[x + 1 : x + {PATCH}] AS seen
      FROM image_lines JOIN template_lines USING (image_id), range(0, {RASTER_WIDTH} - {PATCH} + 1) t(x) WHERE y - k BETWEEN 0 AND h - {PATCH})
    GROUP BY image_id, y0, x""",
    "image_lines",
    "template_lines",
)
cte(
    "repetition_stats",
    """SELECT image_id, CASE WHEN any_value(t.own) IS NULL THEN 0e0 WHEN any_value(t.own) <= 0 THEN 1e0 ELSE avg(
        CASE WHEN q - v.s ** 2 / 256e0 > 0 AND (d - v.s * t.s / 256e0) / (sqrt(q - v.s ** 2 / 256e0) * sqrt(t.own)) > 0.8e0 THEN 1e0 ELSE 0e0 END
      ) END AS pattern_repetition
    FROM raster LEFT JOIN templates t USING (image_id) LEFT JOIN windows v USING (image_id) GROUP BY image_id""",
    "raster",
    "templates",
    "windows",
)
