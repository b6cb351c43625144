"""Tasks run where the package is not installed: classes and functions travel with the jobs."""

import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
import public_tokenizers
from candor.llm import bpe, jaccard, language, packing, permutation_index, quality, rp_forest, secret_scan, source_divergence, spelling_variants, token_count, url_filter, warc
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {tmp!r}).getOrCreate()
docs = spark.createDataFrame([(i, f"some words and more of number {{i}}", "en" if i % 2 else "de") for i in range(6)], "doc_id long, text string, lang string")
byte, piece = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
frames = [
    bpe.decode(bpe.encode(docs, byte), byte),
    token_count.count_tokens(docs, piece),
    packing.pack(packing.pieces(docs, byte)),
    quality.score(docs, quality.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("quality")))),
    language.identify(docs, language.fit(docs)),
    jaccard.jaccard_components(docs),
    url_filter.judge(docs.select(F.lit("http://a.com/").alias("url")), spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")),
    warc.round_trip(docs.select("doc_id", F.lit("u").alias("url"), "text"), "doc_id", "url", "text"),
]
vectors = docs.select("doc_id", F.array(F.lit(1.0), F.col("doc_id") + 1.0).alias("v"), F.lit(1).alias("label"))
frames.append(rp_forest.near_duplicates(vectors, "doc_id", "v"))
frames.append(permutation_index.nearest(vectors, F.lit(True), "doc_id", "v", k=1))
frames.append(secret_scan.scan(docs, secret_scan.fit(secret_scan.labelled_samples(docs))))
sources = docs.select("text", F.lit("en").alias("lang"), (F.col("doc_id") % 2).alias("source"))
frames.append(source_divergence.divergence(sources, least_documents=1).where("part = 'pair'"))
frames.append(spelling_variants.variants(docs.select("doc_id", F.repeat(F.lit("letters "), 5).alias("text"))))
print([f.count() for f in frames])
"""


def test_every_operator(tmp_path):
    repo = os.path.abspath(os.path.join(os.path.dirname(__file__), "..", ".."))
    code = CODE.format(repo=repo, tmp=str(tmp_path))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.stdout.strip().splitlines()[-1:] == [str([6] * 11 + [2, 1])], done.stderr[-2000:]
