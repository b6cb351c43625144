"""Image features from rasters.

A raster is one row: image_id, width, height and row-major channel arrays. Its
sums are taken inside the task that reads it, so pixels are neither repeated nor
shuffled; features are aggregated from the sums per image.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

BLOCK = 32  # fixed value: noise block
GRID = 8  # fixed value: compression grid
PATCH = 16  # fixed value: template side
EDGE_LEVEL = 150.0  # gradient magnitude that counts as an edge

FEATURES = (
    "width",
    "height",
    "aspect_ratio",
    "total_pixels",
    "mean_brightness",
    "brightness_stddev",
    "red_uniformity",
    "green_uniformity",
    "blue_uniformity",
    "mean_saturation",
    "saturation_stddev",
    "texture_variance",
    "texture_mean",
    "edge_density",
    "pattern_repetition",
    "blocking_artifacts",
    "noise_estimate",
    "noise_uniformity",
    "edge_strength",
    "edge_consistency",
)


def with_gray(images: DataFrame) -> DataFrame:
    """Add the gray channel, round(0.299 r + 0.587 g + 0.114 b)."""
    weighted = F.zip_with(
        F.zip_with("r", "g", lambda r, g: r * 299 + g * 587), F.col("b"), lambda s, b: s + b * 114
    )
    return images.withColumn("gray", F.transform(weighted, lambda v: F.floor((v + 500) / 1000).cast("int")))


_MOMENTS = {
    "color": "struct<n: bigint, r1: bigint, r2: bigint, g1: bigint, g2: bigint, b1: bigint, b2: bigint, s1: bigint, s2: bigint>",
    "texture": "struct<n: bigint, v1: bigint, v2: bigint, l1: bigint, l2: bigint, grads: bigint, grad1: double, spread: double, edges: bigint>",
    "jumps": "array<struct<axis: string, k: int, v: bigint>>",
    "noise": "array<struct<bx: int, by: int, n: bigint, s: bigint, q: bigint>>",
}


def raster_sums(images: DataFrame, parts=tuple(_MOMENTS), edge_level: float = EDGE_LEVEL) -> DataFrame:
    """(image_id, width, height, *parts): the whole-number sums that the single features below are made from, one row per raster.

    Every raster is read once, where it lies; its pixels are not repeated. The features take them as they are, so several
    features of the same rasters need one reading: write the sums and pass them on. ``color`` reads r, g, b, all others read gray.
    """
    head = ["image_id", "width", "height"]
    planes = [*(["r", "g", "b"] if "color" in parts else []), *(["gray"] if set(parts) - {"color"} else [])]
    schema = ", ".join([*(f"{c} {images.schema[c].dataType.simpleString()}" for c in head), *(f"{p} {_MOMENTS[p]}" for p in parts)])
    kinds = {f.name: to_arrow_type(f.dataType) for f in T._parse_datatype_string(", ".join(f"{p} {_MOMENTS[p]}" for p in parts)).fields}

    def task(batches):
        for batch in batches:
            held = [batch.column(i) for i in range(len(head) + len(planes))]
            found = {p: [] for p in parts}
            for i, (w, h) in enumerate(zip(held[1].to_pylist(), held[2].to_pylist())):
                pixels = w * h if w and h else 0
                of = {c: _plane(held[3 + k][i].values, pixels) for k, c in enumerate(planes)}
                if "gray" in of and pixels:
                    of["gray"] = of["gray"].reshape(h, w)
                for p in parts:
                    found[p].append(_SUMS[p](of, edge_level) if pixels else None)
            yield pa.RecordBatch.from_arrays([*held[:3], *(pa.array(found[p], kinds[p]) for p in parts)], names=[*head, *parts])

    return images.select(*head, *planes).mapInArrow(task, schema)


def _sums_of(images: DataFrame, part: str, edge_level: float = EDGE_LEVEL) -> DataFrame:
    """(image_id, part) where a raster has pixels; rasters whose sums are known already are not read again."""
    sums = images if part in images.columns else raster_sums(images, [part], edge_level)
    return sums.where(F.col(part).isNotNull()).select("image_id", part)


def _plane(values: pa.Array | None, pixels: int) -> np.ndarray:
    """A channel as doubles, which hold its values and their sums exactly; missing pixels are NaN."""
    x = np.zeros(0) if values is None else values.to_numpy(zero_copy_only=False).astype("float64")[:pixels]
    return np.concatenate([x, np.full(pixels - len(x), np.nan)]) if len(x) < pixels else x


def _two_sums(values: np.ndarray) -> tuple[int | None, int | None]:
    """Sum and sum of squares of the known values, None where none is known."""
    known = values[~np.isnan(values)]
    return (int(known.sum()), int((known * known).sum())) if known.size else (None, None)


def _color_sums(of: dict, edge_level: float) -> dict:
    r, g, b = of["r"], of["g"], of["b"]
    top, low = np.fmax(np.fmax(r, g), b), np.fmin(np.fmin(r, g), b)
    some = top > 0
    s = np.where(some, np.floor((510 * (top - low) + top) / np.where(some, 2 * top, 1)), 0)
    out = {"n": r.size}
    for c, values in zip("rgbs", (r, g, b, s)):
        out[f"{c}1"], out[f"{c}2"] = _two_sums(values)
    return out


def _texture_sums(of: dict, edge_level: float) -> dict:
    gray = of["gray"]
    (v1, v2), (l1, l2) = _two_sums(gray), _two_sums(_laplace(gray))
    grad = _gradient(gray)
    grad = grad[~np.isnan(grad)]
    middle = float(grad.sum()) if grad.size else None
    spread = float(((grad - grad.mean()) ** 2).sum()) if grad.size else None
    return {
        "n": gray.size, "v1": v1, "v2": v2, "l1": l1, "l2": l2,
        "grads": grad.size, "grad1": middle, "spread": spread, "edges": int((grad > edge_level).sum()),
    }


def _jump_sums(of: dict, edge_level: float) -> list[dict]:
    out = []
    for axis, lines in (("row", of["gray"]), ("col", of["gray"].T)):
        sums = np.nansum(lines, axis=1)
        out += [{"axis": axis, "k": int(i) // GRID, "v": int(sums[i] - sums[i - 1])} for i in range(GRID, len(sums) - GRID, GRID)]
    return out


def _noise_sums(of: dict, edge_level: float) -> list[dict]:
    (h, w), out = of["gray"].shape, []
    for y in range(0, h - BLOCK, BLOCK):
        for x in range(0, w - BLOCK, BLOCK):
            s, q = _two_sums(_laplace(of["gray"][y : y + BLOCK, x : x + BLOCK]))
            out.append({"bx": x // BLOCK, "by": y // BLOCK, "n": BLOCK * BLOCK, "s": s, "q": q})
    return out


_SUMS = {"color": _color_sums, "texture": _texture_sums, "jumps": _jump_sums, "noise": _noise_sums}


def _mean_var(n: Column, s: Column, q: Column) -> tuple[Column, Column]:
    """Mean and population variance from exact integer sums."""
    wide = lambda c: c.cast("decimal(38,0)")
    return s / n, (wide(n) * wide(q) - wide(s) * wide(s)).cast("double") / (n.cast("double") * n)


def basic_features(images: DataFrame) -> DataFrame:
    """Size features."""
    return images.select(
        "image_id",
        F.col("width").cast("double").alias("width"),
        F.col("height").cast("double").alias("height"),
        (F.col("width") / F.col("height")).alias("aspect_ratio"),
        (F.col("width") * F.col("height")).cast("double").alias("total_pixels"),
    )


def color_features(images: DataFrame) -> DataFrame:
    """Brightness and saturation moments."""
    sums = [F.sum(c).alias(c) for c in ("n", *(f"{c}{i}" for c in "rgbs" for i in "12"))]
    agg = _sums_of(images, "color").select("image_id", "color.*").groupBy("image_id").agg(*sums)
    m = {c: _mean_var(F.col("n"), F.col(f"{c}1"), F.col(f"{c}2")) for c in "rgbs"}
    return agg.select(
        "image_id",
        ((m["r"][0] + m["g"][0] + m["b"][0]) / 3).alias("mean_brightness"),
        ((F.sqrt(m["r"][1]) + F.sqrt(m["g"][1]) + F.sqrt(m["b"][1])) / 3).alias("brightness_stddev"),
        m["s"][0].alias("mean_saturation"),
        F.sqrt(m["s"][1]).alias("saturation_stddev"),
    )


def channel_counts(images: DataFrame) -> DataFrame:
    """(image_id, bins): how often each value occurs in each channel of a raster, read once, where it lies."""
    kind = images.schema["image_id"].dataType.simpleString()

    def task(batches):
        for batch in batches:
            names, values, counts, known, ends = [], [], [], [], [0]
            for channels in zip(*(batch.column(c) for c in "rgb")):
                for name, pixel in zip(("red", "green", "blue"), channels):
                    if not pixel.is_valid:
                        continue
                    value, n = np.unique(pixel.values.drop_null().to_numpy(zero_copy_only=False), return_counts=True)
                    missing = [pixel.values.null_count] if pixel.values.null_count else []
                    names += [name] * (len(n) + len(missing))
                    values += [value, np.zeros(len(missing))]
                    counts += [n, missing]
                    known += [np.ones(len(n), dtype=bool), np.zeros(len(missing), dtype=bool)]
                ends.append(len(names))
            join = lambda parts, dtype: np.concatenate([np.zeros(0), *parts]).astype(dtype)
            columns = [
                pa.array(names, pa.string()),
                pa.array(join(values, "int32"), mask=~join(known, bool)),
                pa.array(join(counts, "int64")),
            ]
            bins = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["channel", "value", "n"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), bins], names=["image_id", "bins"])

    schema = f"image_id {kind}, bins array<struct<channel: string, value: int, n: bigint>>"
    return images.select("image_id", "r", "g", "b").mapInArrow(task, schema)


def histogram_features(images: DataFrame) -> DataFrame:
    """Spread of the 256-bin channel histograms, empty bins included."""
    counted = channel_counts(images).select("image_id", F.explode("bins").alias("b"))
    bins = counted.groupBy("image_id", "b.channel", "b.value").agg(F.sum("b.n").alias("n"))
    stats = bins.groupBy("image_id", "channel").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    _, var = _mean_var(F.lit(256).cast("long"), F.col("s"), F.col("q"))
    spread = F.sqrt(var) / (F.col("s") / 256)
    wide = stats.withColumn("u", spread).groupBy("image_id").pivot("channel", ["red", "green", "blue"]).agg(F.first("u"))
    return wide.select("image_id", *[F.col(c).alias(f"{c}_uniformity") for c in ("red", "green", "blue")])


def texture_features(gray_images: DataFrame, edge_level: float = EDGE_LEVEL) -> DataFrame:
    """Gray moments, Laplacian noise, Sobel gradient (I4, I6 first part, I7, edge share of I9)."""
    own = F.col("grad1") * F.col("grad1") / F.col("grads")
    sums = [F.sum(c).alias(c) for c in ("n", "v1", "v2", "l1", "l2", "grads", "grad1", "spread", "edges")]
    agg = _sums_of(gray_images, "texture", edge_level).select("image_id", "texture.*").groupBy("image_id").agg(F.count("*").alias("rasters"), *sums, F.sum(own).alias("own"))
    # rasters of one id are added up: what their means differ by belongs to the spread
    more = F.greatest(F.col("own") - F.col("grad1") * F.col("grad1") / F.col("grads"), F.lit(0.0))
    apart = F.when(F.col("rasters") > 1, more).otherwise(0.0)
    agg = agg.select(
        "*",
        (F.col("grad1") / F.col("grads")).alias("edge_strength"),
        F.sqrt((F.col("spread") + apart) / F.col("grads")).alias("edge_consistency"),
        (F.col("edges") / F.col("grads")).alias("edge_density"),
    )
    mean, var = _mean_var(F.col("n"), F.col("v1"), F.col("v2"))
    _, noise = _mean_var(F.col("n"), F.col("l1"), F.col("l2"))
    return agg.select(
        "image_id",
        var.alias("texture_variance"),
        mean.alias("texture_mean"),
        noise.alias("noise_estimate"),
        "edge_strength",
        "edge_consistency",
        "edge_density",
    )


def blocking_artifacts(gray_images: DataFrame) -> DataFrame:
    """Jumps of the line means across the 8-pixel grid, both directions, per pixel."""
    lines = _sums_of(gray_images, "jumps").select("image_id", F.explode("jumps").alias("l")).select("image_id", "l.*")
    jumps = lines.groupBy("image_id", "axis", "k").agg(F.abs(F.sum("v")).alias("jump"))
    # whole-number sums per axis, so the result does not depend on the order of addition
    along = lambda axis: F.coalesce(F.sum(F.when(F.col("axis") == axis, F.col("jump"))), F.lit(0))
    total = jumps.groupBy("image_id").agg(along("row").alias("rows"), along("col").alias("cols"))
    jump = F.coalesce("rows", F.lit(0)) / F.col("width") + F.coalesce("cols", F.lit(0)) / F.col("height")
    return gray_images.select("image_id", "width", "height").join(total, "image_id", "left").select(
        "image_id", (jump / (F.col("width") * F.col("height"))).alias("blocking_artifacts")
    )


def noise_uniformity(gray_images: DataFrame) -> DataFrame:
    """Relative spread of the Laplacian variance over 32x32 blocks with their own borders."""
    held = _sums_of(gray_images, "noise").select("image_id", F.explode("noise").alias("b")).select("image_id", "b.*")
    sums = held.groupBy("image_id", "bx", "by").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    _, var = _mean_var(F.col("n"), F.col("s"), F.col("q"))
    level = sums.withColumn("noise", var).groupBy("image_id").agg(
        F.count("*").alias("n"), F.avg("noise").alias("mean"), F.stddev_pop("noise").alias("std")
    )
    value = F.when((F.col("n") >= 2) & (F.col("mean") > 0), F.col("std") / F.col("mean")).otherwise(0.0)
    return gray_images.select("image_id").join(level.select("image_id", value.alias("u")), "image_id", "left").select(
        "image_id", F.coalesce("u", F.lit(0.0)).alias("noise_uniformity")
    )


def _repetition(gray: np.ndarray, stride: int) -> float:
    """Share of positions whose normalised correlation with the centre patch exceeds 0.8."""
    h, w = gray.shape
    if h < BLOCK or w < BLOCK:
        return 0.0
    half = PATCH // 2
    patch = gray[h // 2 - half : h // 2 + half, w // 2 - half : w // 2 + half]
    patch = patch - patch.mean()
    size = np.sqrt((patch * patch).sum())
    if size < np.finfo(float).eps:
        return 1.0
    gray = gray - gray.mean()  # smaller sums; correlations stay the same
    n = PATCH * PATCH
    squares = _window_sums(gray * gray)[::stride, ::stride] - _window_sums(gray)[::stride, ::stride] ** 2 / n
    flat = squares <= 1e-9 * n  # windows of one shade correlate with nothing
    # the patch has mean 0, so the windows' own means drop out of the products
    shape = tuple(a + b - 1 for a, b in zip(gray.shape, patch.shape))
    product = np.fft.irfft2(np.fft.rfft2(gray, shape) * np.fft.rfft2(patch[::-1, ::-1], shape), shape)
    dot = product[PATCH - 1 : h, PATCH - 1 : w][::stride, ::stride]
    spread = np.sqrt(np.where(flat, 1.0, squares)) * size
    return float((np.where(flat, 0.0, dot / spread) > 0.8).mean())


def _window_sums(values: np.ndarray) -> np.ndarray:
    """Sum of every PATCH x PATCH window from cumulative sums."""
    total = np.pad(values.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return total[PATCH:, PATCH:] - total[:-PATCH, PATCH:] - total[PATCH:, :-PATCH] + total[:-PATCH, :-PATCH]


def pattern_repetition(gray_images: DataFrame, stride: int = 1) -> DataFrame:
    """Template match of the centre patch (I8), Arrow-batched over whole images."""

    @F.pandas_udf("double")
    def share(gray: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        return pd.Series(
            [_repetition(np.asarray(g, dtype="float64").reshape(h, w), stride) for g, w, h in zip(gray, width, height)]
        )

    return gray_images.select("image_id", share("gray", "width", "height").alias("pattern_repetition"))


def _moments(values: np.ndarray) -> tuple[float, float]:
    """Mean and population variance of whole numbers, from exact sums."""
    n, s, q = values.size, int(values.sum()), int((values * values).sum())
    return s / n, (n * q - s * s) / (float(n) * n)


def _neighbours(gray: np.ndarray) -> np.ndarray:
    """The image with its borders mirrored without repeating them; a line of one pixel repeats itself."""
    modes = ["reflect" if n > 1 else "edge" for n in gray.shape]
    return np.pad(np.pad(gray, ((1, 1), (0, 0)), modes[0]), ((0, 0), (1, 1)), modes[1])


def _laplace(gray: np.ndarray) -> np.ndarray:
    p = _neighbours(gray)
    return p[1:-1, 2:] + p[1:-1, :-2] + p[2:, 1:-1] + p[:-2, 1:-1] - 4 * gray


def _gradient(gray: np.ndarray) -> np.ndarray:
    p = _neighbours(gray)
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    return np.sqrt((gx * gx + gy * gy).astype("float64"))


def _jumps(gray: np.ndarray) -> float:
    """Jumps of the line sums across the grid, both directions, per pixel."""
    total = 0.0
    for lines in (gray, gray.T):
        sums = lines.sum(axis=1)
        k = np.arange(GRID, len(sums) - GRID, GRID)
        total += int(np.abs(sums[k] - sums[k - 1]).sum()) / lines.shape[1]
    return total / gray.size


def _block_noise(gray: np.ndarray) -> float:
    """Relative spread of the Laplacian variance over blocks with borders of their own; blocks that end at the image's edge are left out."""
    h, w = gray.shape
    noise = [
        _moments(_laplace(gray[y : y + BLOCK, x : x + BLOCK]))[1]
        for y in range(0, h - BLOCK, BLOCK)
        for x in range(0, w - BLOCK, BLOCK)
    ]
    return float(np.std(noise) / np.mean(noise)) if len(noise) >= 2 and np.mean(noise) > 0 else 0.0


def _all_features(width: int, height: int, channels: list[np.ndarray], stride: int, edge_level: float) -> list[float]:
    """Values of FEATURES for one image, all of them from one reading of its pixels."""
    r, g, b = (c.astype("int64") for c in channels)
    colors = [_moments(c) for c in (r, g, b)]
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    saturation = _moments(np.where(top > 0, (510 * (top - low) + top) // np.maximum(2 * top, 1), 0))
    spread = []
    for c in (r, g, b):
        bins = np.bincount(c, minlength=256).astype("int64")
        s, q = c.size, int((bins * bins).sum())
        spread.append(float(np.sqrt((256 * q - s * s) / 65536.0) / (s / 256)))
    gray = ((299 * r + 587 * g + 114 * b + 500) // 1000).reshape(height, width)
    gradient = _gradient(gray)
    shade = _moments(gray)
    return [
        float(width), float(height), width / height, float(width * height),
        sum(m for m, _ in colors) / 3, float(sum(np.sqrt(v) for _, v in colors)) / 3, *spread,
        saturation[0], float(np.sqrt(saturation[1])), shade[1], shade[0], float((gradient > edge_level).mean()),
        _repetition(gray.astype("float64"), stride), _jumps(gray), _moments(_laplace(gray))[1], _block_noise(gray),
        float(gradient.mean()), float(gradient.std()),
    ]


def image_features(images: DataFrame, stride: int = 1, edge_level: float = EDGE_LEVEL) -> DataFrame:
    """(image_id, features) with all features in one struct.

    Every raster is read once, where it lies: no exchange, no join, and the pixels are not repeated. The values are those of
    the single features above; use those where only a few are wanted.
    """
    schema = f"image_id {images.schema['image_id'].dataType.simpleString()}, features struct<{', '.join(f'{f}: double' for f in FEATURES)}>"

    def task(batches):
        for batch in batches:
            held = [batch.column(i) for i in range(6)]
            rows = []
            for i, (w, h) in enumerate(zip(held[1].to_pylist(), held[2].to_pylist())):
                channels = [c[i].values.to_numpy(zero_copy_only=False) for c in held[3:]]
                rows.append(dict(zip(FEATURES, _all_features(w, h, channels, stride, edge_level))))
            kind = pa.struct([(f, pa.float64()) for f in FEATURES])
            yield pa.RecordBatch.from_arrays([held[0], pa.array(rows, kind)], names=["image_id", "features"])

    return images.select("image_id", "width", "height", "r", "g", "b").mapInArrow(task, schema)
