import statistics
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from candor.operators import campaigns, intervals, rollups, skew
from candor.plans import detection, reports

START = datetime(2024, 3, 1)


def posts(spark, rows):
    return spark.createDataFrame(rows, "id string, source_platform string, timestamp timestamp")


def test_lookup_heavy_path_equals_plain_join(spark):
    rows = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 50).alias("k"))
    table = rows.groupBy("k").agg(F.count("*").alias("w")).withColumn("name", F.concat(F.lit("n"), "k"))
    plain = sorted(map(tuple, rows.join(table.drop("w"), "k").collect()))
    heavy = sorted(map(tuple, skew.lookup(rows, table, ["k"], "w", heavy_keys=10, small=0).collect()))
    assert heavy == plain and len(heavy) == 1000


@pytest.mark.parametrize("small", [0, 10])
def test_balanced_join_equals_plain_join(spark, small):
    rows = spark.range(600).select(F.col("id"), F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 30).alias("k"))
    table = spark.range(90).select((F.col("id") % 30).alias("k"), F.col("id").alias("t"))
    plain = sorted(map(tuple, rows.join(table, "k").select("k", "id", "t").collect()))
    got = skew.balanced_join(rows, table, ["k"], heavy_keys=10, small=small).select("k", "id", "t").collect()
    assert sorted(map(tuple, got)) == plain


def test_intervals_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows, times = [], {}
    for p, n in (("a", 200), ("b", 40), ("c", 4)):
        stamps = [START + timedelta(microseconds=int(x)) for x in rng.integers(0, 9_000_000_000, n)]
        stamps[1:4] = [stamps[0]] * min(3, n - 1)  # equal instants
        times[p] = sorted(stamps)
        rows += [(f"{p}{i}", p, t) for i, t in enumerate(stamps)]
    got = {r["source_platform"]: r for r in intervals.interval_statistics(posts(spark, rows)).collect()}
    assert set(got) == {"a", "b"}  # four rows are too few
    for p in got:
        gaps = [(y - x).total_seconds() for x, y in zip(times[p], times[p][1:])]
        assert got[p]["campaign_size"] == len(times[p])
        assert got[p]["avg_interval"] == pytest.approx(statistics.fmean(gaps))
        assert got[p]["interval_std"] == pytest.approx(statistics.stdev(gaps))
        assert got[p]["is_regular"] is False


def test_regular_poster_fires_and_lists_its_rows(spark):
    rows = [(f"r{i}", "bot", START + timedelta(minutes=10 * i)) for i in range(50)]
    rows += [(f"h{i}", "human", START + timedelta(minutes=i * i)) for i in range(50)]
    df = posts(spark, rows)
    stats = intervals.interval_statistics(df, factor=0.1)
    got = {r["source_platform"]: r for r in stats.collect()}
    assert got["bot"]["is_regular"] and got["bot"]["posting_regularity"] == 1.0 and got["bot"]["avg_interval"] == 600
    assert not got["human"]["is_regular"]
    assert {r["content_id"] for r in intervals.regular_groups(df, stats).collect()} == {f"r{i}" for i in range(50)}


def test_load_order_gaps(spark):
    rows = [(f"r{i}", "bot", START + timedelta(minutes=10 * i)) for i in range(30)]
    df = posts(spark, rows).withColumn("created_at", F.date_trunc("hour", "timestamp"))
    row = intervals.interval_statistics(df, factor=0.1, order="created_at", descending=True).first()
    assert row["avg_interval"] == -600 and not row["is_regular"]


def test_volume_spike_needs_strictly_more(spark):
    rows = [(f"{h}-{i}", "p", START + timedelta(hours=h, minutes=i)) for h in range(20) for i in range(30 if h == 7 else 3)]
    found, members = campaigns.volume_spikes(posts(spark, rows))
    row = found.collect()
    assert [r["campaign_key"] for r in row] == ["volume_spike_20240301_07"]
    assert row[0]["volume_multiplier"] == pytest.approx(30 / ((19 * 3 + 30) / 20))
    assert members.count() == 30
    even = [(f"{h}-{i}", "p", START + timedelta(hours=h)) for h in range(5) for i in range(9)]
    assert campaigns.volume_spikes(posts(spark, even))[0].count() == 0


def test_length_buckets(spark):
    lengths = [50] * 5 + [51] + [400, 900, 2000]
    df = spark.createDataFrame([(str(i), "x" * n) for i, n in enumerate(lengths)], "id string, content string")
    found, members = campaigns.length_patterns(df)
    (row,) = found.collect()
    assert row["campaign_key"] == f"length_pattern_{int(50 / (50 * 0.1 + 10))}"
    cv = statistics.pstdev([50] * 5 + [51]) / statistics.fmean([50] * 5 + [51])
    assert row["length_consistency"] == pytest.approx(1 - cv) and members.count() == 6
    values = spark.createDataFrame([(n,) for n in (0, 15, 899, 900, 10_000_000)], "n long")
    buckets = [r[0] for r in values.select(campaigns.length_bucket(F.col("n"))).collect()]
    assert buckets == [int(n / (n * 0.1 + 10)) for n in (0, 15, 899, 900, 10_000_000)]


def test_multimodal_needs_two_of_each(spark):
    texts = posts(spark, [(f"t{i}", "p", START + timedelta(minutes=m)) for i, m in enumerate((1, 2, 61, 121, 122))])
    images = posts(spark, [(f"i{i}", "p", START + timedelta(minutes=m)) for i, m in enumerate((3, 4, 62, 63, 130))])
    found, members = campaigns.multimodal(texts, images)
    assert [(r["campaign_size"], r["texts"]) for r in found.collect()] == [(4, 2)]
    assert {r["content_id"] for r in members.collect()} == {"t0", "t1", "i0", "i1"}


PUSHED = (
    "Spring sale at the lamp shop, every lamp at half price until Sunday evening, tell a friend",
    "Spring sale at the lamp shop, every lamp at half price until Monday evening, tell a neighbour",
)
OTHERS = (
    "The ferry was late again and nobody on the pier knew why.",
    "My sourdough finally rose after three flat attempts.",
    "Has anyone repaired a bicycle hub without the special wrench?",
    "Rain all week, so the tomatoes are behind this year.",
    "The library extended its opening hours for the exam period.",
    "Two owls moved into the barn across the road.",
)


def lamp_posts(spark):
    """Four copies of each of two near texts within an hour, and six texts of other days."""
    loaded = START + timedelta(days=20)
    rows = [
        (f"push-{t}-{n}", text, "ai_generated", "forum", START + timedelta(hours=9, minutes=6 * n + t), loaded)
        for t, text in enumerate(PUSHED)
        for n in range(4)
    ]
    rows += [
        (f"other-{d}", text, "human", "forum", START + timedelta(days=d + 1, hours=2 * d), loaded + timedelta(minutes=d))
        for d, text in enumerate(OTHERS)
    ]
    return spark.createDataFrame(
        rows, "id string, content string, source string, source_platform string, timestamp timestamp, created_at timestamp"
    )


def test_pushed_texts_are_found(spark):
    found = detection.detect_all(lamp_posts(spark))
    rows = found.campaigns.collect()
    semantic = [r for r in rows if r["detection_method"] == "semantic_campaigns"]
    assert sum(r["campaign_size"] for r in semantic) == 8
    assert any(r["detection_method"] == "temporal_campaigns" for r in rows)
    members = {(r["campaign_id"], r["content_id"]) for r in found.members.collect()}
    assert len(members) == sum(r["campaign_size"] for r in rows)
    assert not any(i.startswith("other") for c, i in members if c.startswith("cluster_"))
    text = reports.comprehensive_report(found.campaigns, generated="today")
    assert text.startswith(f"Campaign findings, today: {len(rows)} in ") and reports.ADVICE[0] in text
    assert all(r["campaign_id"] in text for r in semantic)
    assert reports.NO_CAMPAIGNS in reports.comprehensive_report(found.campaigns.limit(0))


def test_too_few_rows_give_no_findings(spark):
    found = detection.detect_coordinated(lamp_posts(spark).limit(4))
    assert found.campaigns.count() == 0 and found.suspicious_count().first()[0] == 0
    assert reports.short_summary(found).first()["total_semantic_campaigns"] == 0


def test_empty_content_gives_no_campaigns(spark):
    found = detection.detect_all(lamp_posts(spark).limit(0))
    assert found.campaigns.count() == 0 and found.members.count() == 0


def test_detection_with_images_and_limit(spark):
    content = lamp_posts(spark)
    images = content.where("source = 'ai_generated'").select(F.concat(F.lit("img"), "id").alias("id"), "timestamp")
    found = detection.detect_all(content, images=images)
    assert found.campaigns.where("campaign_type = 'multimodal_temporal'").count() >= 1
    kept = {r["content_id"] for r in detection.detect_all(content, limit=9).members.collect()}
    newest = {r["id"] for r in content.orderBy(F.desc("created_at"), "id").limit(9).collect()}
    assert kept <= newest


def test_campaigns_are_one_row_at_any_size(spark):
    rows = [(f"{h}-{i:03d}", "p", START + timedelta(hours=h)) for h in range(12) for i in range(100 if h == 3 else 5)]
    found = detection.unify({"volume_spikes": campaigns.volume_spikes(posts(spark, rows))})
    (whole,) = detection.stored_rows(found).collect()
    assert whole["campaign_size"] == 100 and whole["content_ids"] is None
    assert {r["content_id"] for r in found.members.collect()} == {r[0] for r in rows if r[0].startswith("3-")}


def test_similarity_groups_are_stored(spark):
    groups = spark.createDataFrame([(0.5, 5, 0.5), (0.75, 6, 0.75)], "similarity double, campaign_size long, avg_similarity double")
    ids = spark.createDataFrame([(0.5, str(i)) for i in range(5)] + [(0.75, str(i)) for i in range(6)], "similarity double, content_id string")
    both = detection.unify({"similarity_campaigns": detection.similarity_family(groups, ids)})
    stored = {(r["campaign_id"], r["campaign_type"], r["campaign_size"], r["similarity_score"]) for r in detection.stored_rows(both).collect()}
    assert stored == {("similarity_0.5", "text_similarity", 5, 0.5), ("similarity_0.75", "text_similarity", 6, 0.75)}
    assert both.members.count() == 11


def test_rollups(spark):
    df = spark.createDataFrame(
        [("a", 0.0, 0.5), ("b", 0.29, 0.5), ("c", 0.999, 0.7), ("d", 1.0, 0.9)],
        "content_id string, authenticity_score double, confidence_score double",
    )
    bins = {r["bin"]: r["n"] for r in rollups.score_histogram(df).collect()}
    assert bins == {0: 1, 5: 1, 19: 2}
    row = rollups.score_statistics(df).first()
    assert (row["low_count"], row["high_count"], row["total"]) == (2, 2, 4)
    metrics = spark.createDataFrame([(True, 10.0, False), (False, 61.0, True)], "correct boolean, latency_seconds double, failed boolean")
    alert = rollups.alert_rules(metrics).first()
    assert alert["accuracy_alert"] and alert["latency_alert"] and alert["error_alert"]
