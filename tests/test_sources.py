import uuid
from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from candor import schemas, session
from candor.functions import scoring, vectors
from candor.sources import corpus
from candor.sources.tables import ContentStore, text_rows
from candor.streaming import monitors


@pytest.fixture()
def store(spark):
    return ContentStore(spark, f"t_{uuid.uuid4().hex[:10]}", session.scratch_path(spark, "db")).create()


def test_tables_have_the_declared_columns(store):
    for table, schema in schemas.TABLES.items():
        got = [(f.name, f.dataType) for f in store.read(table).schema]
        assert got == [(f.name, f.dataType) for f in schema]
    assert store.create() is store  # creating again keeps the tables


def test_text_defaults_and_append(spark, store):
    rows = [("a", "two words", "human", "news"), (None, "", "unknown", None)]
    df = spark.createDataFrame(rows, "id string, content string, source string, source_platform string")
    store.insert_text_content(df)
    store.insert_text_content(df.where("id = 'a'").withColumn("id", F.lit("b")))
    got = {r["id"]: r for r in store.read("text_content").collect()}
    assert len(got) == 3 and {"a", "b"} < set(got)
    assert (got["a"]["word_count"], got["a"]["char_count"], got["a"]["metadata"]) == (2, 9, "{}")
    (filled,) = [r for k, r in got.items() if k not in "ab"]
    assert filled["word_count"] == 0 and filled["timestamp"] is not None


def test_required_columns_and_missing_table_fail(spark, store):
    df = spark.createDataFrame([("a", None, "human")], "id string, content string, source string")
    with pytest.raises(PySparkException):
        store.insert_text_content(df)
    with pytest.raises(PySparkException):
        ContentStore(spark, "nowhere", "/tmp/nowhere").insert_text_content(df.withColumn("content", F.lit("x")))


def test_scores_embeddings_and_latest(spark, store):
    df = spark.createDataFrame(
        [(str(i), f"text number {i}", "human", datetime(2024, 1, 1 + i % 3)) for i in range(9)],
        "id string, content string, source string, created_at timestamp",
    )
    store.insert_text_content(df)
    assert [r["id"] for r in store.text_content(4).collect()] == ["2", "5", "8", "1"]
    assert store.text_content(4, source="ai_generated").count() == 0
    store.insert_authenticity_scores(scoring.score_text(df).drop("model_version"))
    assert {r["model_version"] for r in store.authenticity_scores().collect()} == {"v1.0"}
    store.insert_embeddings(vectors.embed(df))
    assert store.read("embeddings").where("size(embedding) = 384").count() == 9


def test_similarity_table_is_bucketed(spark, store):
    rows = spark.createDataFrame(
        [("a", "b", 0.9, "semantic", None)], schemas.CONTENT_SIMILARITY.simpleString().removeprefix("struct<").removesuffix(">")
    )
    store.append("content_similarity", rows)
    assert store.read("content_similarity").count() == 1
    detail = spark.sql(f"describe extended {store.name('content_similarity')}").collect()
    assert any(r[0] == "Num Buckets" for r in detail)


def test_lines_are_numbered_across_splits(spark, tmp_path):
    lines = [f"  line {i}  " if i % 7 else "   " for i in range(4000)]
    (tmp_path / "a.txt").write_text("\n".join(lines[:3000]))
    (tmp_path / "b.txt").write_text("\n".join(lines[3000:]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = corpus.line_items(spark, str(tmp_path)).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    kept = [x.strip() for x in lines if x.strip()]
    assert [r["content"] for r in got] == kept
    assert [r["id"] for r in got] == [f"batch_{i}" for i in range(len(kept))]


def test_corpus_bounds_are_strict(spark):
    rows = [(i, "x" * n, 1704067200, "comment", None, 1, 2) for i, n in enumerate((50, 51, 4999, 5000))]
    rows += [(9, "y" * 100, 1704067200, "story", None, 1, 2), (10, "y" * 100, 1704067200, "comment", True, 1, 2)]
    df = spark.createDataFrame(rows, "id int, text string, time long, type string, deleted boolean, score int, parent int")
    got = corpus.extract_corpus(df, corpus.forum_comments()).orderBy("id").collect()
    assert [r["id"] for r in got] == ["hn_1", "hn_2"]
    assert got[0]["metadata"] == '{"score":1,"parent":2,"type":"comment"}'


def fake_session(configured=None, current=None):
    """The few calls ``workspace`` makes, with fixed answers."""
    chosen = []
    context = SimpleNamespace(
        getConf=lambda: SimpleNamespace(get=lambda key, default: configured),
        getCheckpointDir=lambda: chosen[-1] if chosen else current,
        setCheckpointDir=chosen.append,
    )
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: "s3://house/" if "warehouse" in key else configured)), chosen


def test_workspace_uses_the_folder_the_cluster_names():
    spark, chosen = fake_session(configured="hdfs:///shared")
    assert session.workspace(spark) == "hdfs:///shared" and chosen == ["hdfs:///shared"]
    spark, chosen = fake_session(current="hdfs:///set")
    assert session.workspace(spark) == "hdfs:///set" and not chosen
    spark, chosen = fake_session()
    assert session.workspace(spark) == "s3://house/_scratch" and chosen == ["s3://house/_scratch"]


def test_release_removes_own_tables_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "own_folder", lambda spark: str(tmp_path / "own"))
    kept = session.written(spark.range(3).toDF("a"), "kept")
    assert kept.count() == 3
    other = session.workspace(spark).rstrip("/") + "/other"
    spark.range(2).write.mode("overwrite").parquet(other)
    session.release(spark)
    assert spark.read.parquet(other).count() == 2
    with pytest.raises(Exception):
        kept.count()


def test_streamed_scores_and_volume_equal_batch(spark, tmp_path):
    schema = "id string, content string, source_platform string, timestamp timestamp"
    rows = [(str(i), f"As an AI text {i}", f"p{i % 2}", datetime(2024, 1, 1, i % 5, i % 60)) for i in range(100)]
    batch = spark.createDataFrame(rows, schema)
    for part in range(4):
        batch.where(F.col("id").cast("int") % 4 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    out, state = monitors.scratch(spark, "scores")
    monitors.run_to_end(monitors.write_parquet(monitors.score_stream(stream), out, state))
    pick = lambda df: sorted(map(tuple, df.select("content_id", "authenticity_score", "explanation").collect()))
    assert pick(spark.read.parquet(out)) == pick(scoring.score_text(batch))

    out, state = monitors.scratch(spark, "volume")
    monitors.run_to_end(monitors.latest_counts(stream, out, state))
    got = {(r["hour"], r["source_platform"]): r["n"] for r in monitors.newest_counts(spark, out).collect()}
    hours = batch.groupBy(F.date_trunc("hour", "timestamp").alias("h"), "source_platform").count().collect()
    assert got == {(r["h"], r["source_platform"]): r["count"] for r in hours}


def test_streamed_tables_may_be_a_file_or_a_folder(spark, tmp_path):
    from candor.plans import catalog, fixtures

    spark.range(6).selectExpr("id AS doc_id", "concat('one two ', id) AS text").repartition(2).write.parquet(f"{tmp_path}/folder/documents.parquet")
    (tmp_path / "file").mkdir()
    part = next((tmp_path / "folder" / "documents.parquet").glob("part-*.parquet"))
    (tmp_path / "file" / "documents.parquet").write_bytes(part.read_bytes())
    for place in ("folder", "file"):
        sf = str(tmp_path / place)
        want = sorted(str(r[0]) for r in fixtures.table(spark, sf, "documents").select("doc_id").collect())
        assert sorted(r["content_id"] for r in catalog.stream_text_scores(spark, sf).collect()) == want


def test_rows_of_any_lateness_are_counted(spark, tmp_path):
    schema = "id string, source_platform string, timestamp timestamp"
    for n, (day, hour) in enumerate(((5, 1), (9, 2), (1, 7), (9, 2), (1, 7), (5, 1), (5, 1))):
        spark.createDataFrame([(str(n), "p", datetime(2024, 1, day, hour, n))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, state = monitors.scratch(spark, "late")
    monitors.run_to_end(monitors.latest_counts(stream, out, state))
    got = {(r["hour"].day, r["hour"].hour): r["n"] for r in monitors.newest_counts(spark, out).collect()}
    assert got == {(5, 1): 3, (9, 2): 2, (1, 7): 2}


def test_folded_counts_survive_restarts_and_late_rows(spark, tmp_path):
    schema = "id string, source_platform string, timestamp timestamp"
    put = lambda n, day: spark.createDataFrame([(str(n), "p", datetime(2024, 1, day, 3, n % 60))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out, state = monitors.scratch(spark, "folded")
    run = lambda: monitors.run_to_end(
        monitors.latest_counts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), out, state)
    )
    counts = lambda: {r["hour"].day: r["n"] for r in monitors.newest_counts(spark, out).collect()}
    assert monitors.compact_counts(spark, out) is None and counts() == {}
    for n in range(4):
        put(n, 5)
    run()
    assert counts() == {5: 4}
    assert monitors.compact_counts(spark, out) == 3 and counts() == {5: 4}
    # a batch that is written again after the fold, as a restart would do
    rows = spark.createDataFrame([("0", "p", datetime(2024, 1, 5, 3, 0))], schema)
    monitors.hourly_volume(rows).write.mode("overwrite").parquet(f"{out}/batch=3")
    assert counts() == {5: 4}
    for n in range(4, 7):
        put(n, 2 if n == 4 else 5)  # the first one is late
    run()
    assert counts() == {5: 6, 2: 1}
    # a fold that broke off has no commit file and does not count
    spark.createDataFrame([(datetime(2024, 1, 5, 3), "p", 99)], "hour timestamp, source_platform string, n long").write.parquet(f"{out}/compacted/until=50")
    session_files(spark, f"{out}/compacted/until=50/_SUCCESS")
    assert counts() == {5: 6, 2: 1}
    assert monitors.compact_counts(spark, out) == 6 and counts() == {5: 6, 2: 1}
    assert monitors.compact_counts(spark, out) == 6  # nothing new
    assert sorted(monitors._folders(spark, out, "batch")) == [4, 5, 6]


def session_files(spark, path):
    """Delete one file of the shared folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, False)


def test_partners_of_stored_pairs_move_only_the_ids(spark, tmp_path):
    s = ContentStore(spark, "partners_test", str(tmp_path / "db")).create()
    rows = [("a", "b", 0.9, "semantic"), ("a", "c", 0.8, None), ("d", "e", 0.7, "semantic")]
    for part in (rows[:2], rows[2:]):
        s.insert_similarity(spark.createDataFrame(part, "content_id_1 string, content_id_2 string, similarity_score double, similarity_type string"))
    assert {(r["content_id_1"], r["content_id_2"], r["similarity_score"]) for r in s.similar_pairs().collect()} == {(a, b, x) for a, b, x, _ in rows}
    found = s.partners(spark.createDataFrame([("a",), ("e",), ("e",), ("x",), (None,)], "content_id string"))
    assert {(r["content_id"], r["partner_id"]) for r in found.collect()} == {("a", "b"), ("a", "c"), ("e", "d")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("SortMergeJoin"):]
    table_side = join[: join.index("content_similarity")]
    assert "Exchange" not in table_side and "Bucketed: true" in join
    spark.sql("DROP DATABASE partners_test CASCADE")


def test_derived_columns_use_python_words(spark):
    df = spark.createDataFrame([("a", " x y z \n", "human")], "id string, content string, source string")
    row = text_rows(df).first()
    assert row["word_count"] == len(" x y z \n".split()) and row["char_count"] == 8
