import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from candor.functions import scoring
from candor.operators import images
from candor.sources import corpus


def pictures():
    rng = np.random.default_rng(4)
    tile = rng.integers(0, 256, size=(8, 8, 3))
    ramp = np.add.outer(np.arange(72) * 3, np.arange(80))
    return {
        "flat": np.full((72, 80, 3), 90),
        "tiled": np.tile(tile, (9, 10, 1)),
        "noisy": rng.integers(0, 256, size=(72, 80, 3)),
        "ramp": np.stack([ramp % 256, (ramp * 2) % 256, (ramp // 2) % 256], axis=2),
        "small": rng.integers(0, 256, size=(20, 33, 3)),
        "line": rng.integers(0, 256, size=(1, 5, 3)),
    }


def frame(spark):
    rows = [
        (name, p.shape[1], p.shape[0], *[[int(v) for v in p[:, :, c].ravel()] for c in range(3)])
        for name, p in pictures().items()
    ]
    kind = "image_id string, width int, height int, r array<int>, g array<int>, b array<int>"
    return spark.createDataFrame(rows, kind)



def window(gray):
    h, w = gray.shape
    at = lambda i, n: 0 if n == 1 else (-i if i < 0 else 2 * (n - 1) - i if i >= n else i)
    return lambda y, x: gray[at(y, h), at(x, w)]


def laplacian(gray):
    g = window(gray)
    h, w = gray.shape
    return np.array([[g(y, x + 1) + g(y, x - 1) + g(y + 1, x) + g(y - 1, x) - 4 * g(y, x) for x in range(w)] for y in range(h)])


def sobel(gray):
    g = window(gray)
    h, w = gray.shape
    out = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            gx = sum(k * (g(y + d, x + 1) - g(y + d, x - 1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            gy = sum(k * (g(y + 1, x + d) - g(y - 1, x + d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            out[y, x] = np.hypot(gx, gy)
    return out


def repetition(gray):
    h, w = gray.shape
    if h < 32 or w < 32:
        return 0.0
    t = gray[h // 2 - 8 : h // 2 + 8, w // 2 - 8 : w // 2 + 8].astype(float)
    t = t - t.mean()
    if np.sqrt((t * t).sum()) < 1e-12:
        return 1.0
    hits = total = 0
    for y in range(h - 15):
        for x in range(w - 15):
            p = gray[y : y + 16, x : x + 16].astype(float)
            p = p - p.mean()
            size = np.sqrt((p * p).sum() * (t * t).sum())
            hits += size > 0 and (p * t).sum() / size > 0.8
            total += 1
    return hits / total


def expected(p):
    gray = ((299 * p[:, :, 0] + 587 * p[:, :, 1] + 114 * p[:, :, 2] + 500) // 1000).astype(int)
    h, w = gray.shape
    top, low = p.max(axis=2), p.min(axis=2)
    sat = np.where(top > 0, np.floor(255 * (top - low) / np.maximum(top, 1) + 0.5), 0)
    hist = [np.bincount(p[:, :, c].ravel(), minlength=256) for c in range(3)]
    blocking = sum(abs(gray[i - 1].mean() - gray[i].mean()) for i in range(8, h - 8, 8))
    blocking += sum(abs(gray[:, j - 1].mean() - gray[:, j].mean()) for j in range(8, w - 8, 8))
    noise = [laplacian(gray[i : i + 32, j : j + 32]).var() for i in range(0, h - 32, 32) for j in range(0, w - 32, 32)]
    grad = sobel(gray)
    return {
        "width": w,
        "height": h,
        "aspect_ratio": w / h,
        "total_pixels": w * h,
        "mean_brightness": p.mean(axis=(0, 1)).mean(),
        "brightness_stddev": p.std(axis=(0, 1)).mean(),
        "red_uniformity": hist[0].std() / hist[0].mean(),
        "green_uniformity": hist[1].std() / hist[1].mean(),
        "blue_uniformity": hist[2].std() / hist[2].mean(),
        "mean_saturation": sat.mean(),
        "saturation_stddev": sat.std(),
        "texture_variance": gray.var(),
        "texture_mean": gray.mean(),
        "edge_density": (grad > images.EDGE_LEVEL).mean(),
        "pattern_repetition": repetition(gray),
        "blocking_artifacts": blocking / (h * w),
        "noise_estimate": laplacian(gray).var(),
        "noise_uniformity": np.std(noise) / np.mean(noise) if len(noise) > 1 and np.mean(noise) > 0 else 0.0,
        "edge_strength": grad.mean(),
        "edge_consistency": grad.std(),
    }


def test_all_features_equal_brute_force(spark):
    rows = {r["image_id"]: r["features"] for r in images.image_features(frame(spark)).collect()}
    assert set(rows) == set(pictures())
    for name, p in pictures().items():
        for feature, value in expected(p).items():
            assert rows[name][feature] == pytest.approx(value, abs=1e-8, rel=1e-9), (name, feature)


def test_rules(spark):
    scored = {r["content_id"]: r for r in scoring.score_images(images.image_features(frame(spark))).collect()}
    flat = scored["flat"]
    assert flat["authenticity_score"] == 0.0  # 0.5 - 0.2 - 0.15 - 0.1 - 0.1 - 0.15, clamped
    assert flat["confidence_score"] == pytest.approx(0.8)
    assert flat["explanation"].startswith("Uniform noise pattern; Consistent saturation levels")
    assert all(0 <= r["authenticity_score"] <= 0.65 + 1e-9 for r in scored.values())


def png(path, p):
    h, w, _ = p.shape
    raw = b"".join(b"\x00" + p[y].astype("uint8").tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(
        b"\x89PNG\r\n\x1a\n"
        + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
        + chunk(b"IDAT", zlib.compress(raw))
        + chunk(b"IEND", b"")
    )


def test_image_source_and_broken_files(spark, tmp_path):
    p = pictures()["small"]
    png(tmp_path / "good.png", p)
    (tmp_path / "bad.png").write_bytes(b"not an image")
    good, failed = corpus.load_images(spark, str(tmp_path))
    (row,) = good.collect()
    assert (row["width"], row["height"]) == (33, 20)
    for c, name in enumerate("rgb"):
        assert row[name] == [int(v) for v in p[:, :, c].ravel()]
    (error,) = scoring.image_errors(failed, F.col("origin")).collect()
    assert (error["authenticity_score"], error["confidence_score"]) == (0.0, 0.0)
    assert error["content_id"].startswith("error_")


def test_pixels_collapse_before_the_shuffle(spark):
    plan = images.texture_features(images.with_gray(frame(spark)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_count" in plan and "Join" not in plan


def test_channel_counts_hold_one_row_per_raster(spark):
    schema = "image_id string, width int, height int, r array<int>, g array<int>, b array<int>"
    rows = [("a", 2, 2, [1, 1, 2, None], [0, 0, 0, 0], None), ("a", 1, 1, [1], [255], [7]), (None, 1, 1, [3], [3], [3]), ("e", 0, 0, [], [], [])]
    df = spark.createDataFrame(rows, schema)
    got = [{(b["channel"], b["value"]): b["n"] for b in r["bins"]} for r in images.channel_counts(df).collect()]
    assert sorted(map(len, got)) == [0, 3, 3, 4]  # bins, not pixels, leave a raster
    assert {("red", 1): 2, ("red", 2): 1, ("red", None): 1, ("green", 0): 4} in got
    found = {r["image_id"]: r for r in images.histogram_features(df).collect()}
    # rasters of one id are one histogram: red 1 1 1 2 and a missing value
    assert set(found) == {"a", None}
    assert found["a"]["red_uniformity"] == pytest.approx(np.std([3, 1, 1] + [0] * 253) / (5 / 256))
    assert found["a"]["blue_uniformity"] == found[None]["red_uniformity"] == pytest.approx(np.std([1] + [0] * 255) * 256)


def test_pixels_are_not_rows_and_known_sums_are_not_taken_again(spark):
    """One reading of the rasters serves several features (F30); rasters of one id are added up."""
    from candor.operators import images as im

    values = [[(i * i * 7 + i // 3) % 256 for i in range(7000)], [(i * i * 5) % 251 for i in range(7000)]]
    rows = [("a", 70, 100, v, v, v) for v in values] + [("b", 70, 100, values[0], values[1], values[0]), ("c", None, 2, [1], [1], [1])]
    df = spark.createDataFrame(rows, "image_id string, width int, height int, r array<int>, g array<int>, b array<int>")
    gray = im.with_gray(df)
    sums = im.raster_sums(gray).localCheckpoint()
    for feature in (im.color_features, im.texture_features, im.blocking_artifacts, im.noise_uniformity):
        plan = feature(gray)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "sequence(" not in plan
        assert "MapInArrow" not in feature(sums)._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, feature(sums).collect())) == sorted(map(tuple, feature(gray).collect()))
    both = [v for part in values for v in part]
    got = {r["image_id"]: r["mean_brightness"] for r in im.color_features(sums).collect()}
    assert got["a"] == pytest.approx(sum(both) / len(both)) and set(got) == {"a", "b"}
