"""Images as tables of pixels: image_id, y, x, r, g, b (0 to 255), and features as grouped aggregates and windows.

Partition once by image_id: every aggregate and window here has image_id among its keys. Memory is bounded by
one row of windows, not by an image.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenrank.plans.stages import cut

ID = "image_id"


#: Pixels that a task hands on at once, about.
PIXELS_AT_ONCE = 262_144


def _blocks(cube: np.ndarray, k: int) -> np.ndarray:
    """Means of blocks of k by k; those at the far edges are of what is there."""
    starts = [np.arange(0, n, k) for n in cube.shape[:2]]
    sums = np.add.reduceat(np.add.reduceat(cube.astype(float), starts[0], axis=0), starts[1], axis=1)
    sizes = [np.diff(s, append=n) for s, n in zip(starts, cube.shape, strict=False)]
    return sums / np.outer(*sizes)[:, :, None]


def pixels(images: DataFrame, long_edge: int | None = 512, known_once: bool = False) -> DataFrame:
    """Pixels of decoded images (columns image_id and image, as the image source gives it), reduced by whole blocks.

    With a long edge an image counts once, however often it is listed; known_once: it is listed once. Images are reduced in the tasks that decode them, and
    handed on many at once.
    """

    def explode(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in found:
            keys, cubes, held = [], [], 0
            for key, h, w, channels, data in zip(*(batch[c] for c in (ID, "height", "width", "channels", "data")), strict=True):
                # blue, green and red; a grey image has one of them
                cube = np.frombuffer(data, dtype=np.uint8).reshape(h, w, channels)[:, :, [min(i, channels - 1) for i in (2, 1, 0)]]
                k = 1 if long_edge is None else -(-max(h, w) // long_edge)
                keys.append(key)
                cubes.append(_blocks(cube, k) if k > 1 else cube)
                held += cubes[-1].shape[0] * cubes[-1].shape[1]
                if held >= PIXELS_AT_ONCE:
                    yield flattened(keys, cubes)
                    keys, cubes, held = [], [], 0
            if keys:
                yield flattened(keys, cubes)

    def flattened(keys: list[str], cubes: list[np.ndarray]) -> pd.DataFrame:
        """A row for each pixel of images (red, green, blue)."""
        yy, xx = (np.concatenate(a) for a in zip(*(np.divmod(np.arange(c.shape[0] * c.shape[1], dtype=np.int32), np.int32(c.shape[1])) for c in cubes), strict=True))
        colours = np.concatenate([c.reshape(-1, 3) for c in cubes]).astype(float)
        ids = np.repeat(np.array(keys, dtype=object), [c.shape[0] * c.shape[1] for c in cubes])
        return pd.DataFrame({ID: ids, "y": yy, "x": xx, "r": colours[:, 0], "g": colours[:, 1], "b": colours[:, 2]})

    once = images if long_edge is None or known_once else images.dropDuplicates([ID])
    flat = once.select(ID, *[F.col(f"image.{a}").alias(b) for a, b in (("height", "height"), ("width", "width"), ("nChannels", "channels"), ("data", "data"))])
    return flat.mapInPandas(explode, f"{ID} string, y int, x int, r double, g double, b double")


def gray(px: DataFrame) -> DataFrame:
    """px with gray, the luma of red, green and blue, rounded; a gray column that is there stays."""
    return px if "gray" in px.columns else px.withColumn("gray", F.rint(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")))


def with_hsv(px: DataFrame) -> DataFrame:
    """px with hue (half degrees, 0 to 180), sat and val (0 to 255)."""
    r, g, b = (F.col(c).cast("double") for c in "rgb")
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    turn = F.when(span == 0, 0.0).when(top == r, 60 * (g - b) / span).when(top == g, 120 + 60 * (b - r) / span).otherwise(240 + 60 * (r - g) / span)
    hue = F.pmod(F.rint(F.pmod(turn, F.lit(360.0)) / 2), F.lit(180.0))
    return px.withColumn("hue", hue).withColumn("sat", F.when(top > 0, F.rint(255 * span / top)).otherwise(0.0)).withColumn("val", top)


def _lab(px: DataFrame) -> tuple[Column, Column]:
    """a and b of the Lab space on the 0 to 255 scale, with 128 as neutral (sRGB, D65)."""

    def linear(c: Column) -> Column:
        u = c / 255
        return F.when(u <= 0.04045, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, F.lit(2.4)))

    r, g, b = (linear(F.col(c).cast("double")) for c in "rgb")
    x = (0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456
    y = 0.212671 * r + 0.715160 * g + 0.072169 * b
    z = (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754
    f = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116)
    return 500 * (f(x) - f(y)) + 128, 200 * (f(y) - f(z)) + 128


def color_features(px: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """Brightness, saturation, hue histogram (density over half degrees), Lab means, balance and cloud share per image."""
    a, b = _lab(px)
    light = (F.col("r") + F.col("g") + F.col("b")) / 3
    # masks that hold the colours, too, are read once for both
    whole = masks is not None and {"r", "g", "b"} <= set(masks.columns)
    rows = with_hsv(masks if whole else px).withColumn("_l", light).withColumn("_a", a).withColumn("_b", b)
    bins = [(F.count_if(F.least(F.floor(F.col("hue") / 22.5), F.lit(7)) == i) / F.count(F.lit(1)) / 22.5).alias(f"hue_bin_{i}") for i in range(8)]
    got = rows.groupBy(ID).agg(
        F.avg("_l").alias("mean_brightness"),
        F.stddev_pop("_l").alias("contrast"),
        (F.max("_l") - F.min("_l")).alias("dynamic_range"),
        F.avg("sat").alias("saturation_mean"),
        F.avg("_a").alias("lab_a_mean"),
        F.avg("_b").alias("lab_b_mean"),
        ((F.avg("b") + 1) / (F.avg("r") + 1)).alias("blue_orange_balance"),
        (F.avg("_b") - F.avg("_a")).alias("color_temperature_proxy"),
        *bins,
        *([F.avg("cloud").alias("cloud_area_fraction")] if whole else []),
    )
    if whole:
        return got.withColumn("sky_area_fraction", 1 - F.col("cloud_area_fraction"))
    share = (masks if masks is not None else cloud_mask(px)).groupBy(ID).agg(F.avg("cloud").alias("cloud_area_fraction"))
    return got.join(share, ID).withColumn("sky_area_fraction", 1 - F.col("cloud_area_fraction"))


def smooth(px: DataFrame, column: str, reach: int = 2) -> DataFrame:
    """px with a 0/1 column opened, then closed, by a square of 2 reach + 1; what lies outside the image has no say.

    The two dilations are one of twice the reach. Rows and columns take turns so that rows are sorted four times.
    """
    along_x, along_y = Window.partitionBy(ID, "y").orderBy("x"), Window.partitionBy(ID, "x").orderBy("y")
    for f, along, far in ((F.min, along_x, reach), (F.min, along_y, reach), (F.max, along_y, 2 * reach), (F.max, along_x, 2 * reach), (F.min, along_x, reach), (F.min, along_y, reach)):
        px = px.withColumn(column, f(column).over(along.rangeBetween(-far, far)))
    return px


def cloud_mask(px: DataFrame, smoothed: bool = True) -> DataFrame:
    """px with cloud (0/1): bright and little saturated."""
    out = with_hsv(px).withColumn("cloud", ((F.col("val") > 110) & (F.col("sat") < 120)).cast("int"))
    return smooth(out, "cloud") if smoothed else out


def sky_cloud_masks(px: DataFrame, smoothed: bool = True) -> DataFrame:
    """px with sky and cloud (0/1) by the thresholds of the crop search."""
    h, s, v = F.col("hue"), F.col("sat"), F.col("val")
    blue = h.between(85, 135) & (s >= 20) & (v >= 70)
    out = with_hsv(px).withColumn("sky", (blue | (s <= 95) & (v >= 115) | (s <= 70) & (v >= 145)).cast("int")).withColumn("cloud", ((s <= 85) & (v >= 125)).cast("int"))
    return smooth(smooth(out, "sky"), "cloud") if smoothed else out


def entropy(px: DataFrame) -> DataFrame:
    """Shannon entropy, in bits, of the grey levels."""
    n = gray(px).groupBy(ID, "gray").agg(F.count(F.lit(1)).alias("k"))
    p = F.col("k") / F.sum("k").over(Window.partitionBy(ID))
    return n.withColumn("p", p).groupBy(ID).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def co_occurrence(px: DataFrame) -> DataFrame:
    """Contrast, homogeneity, energy and correlation of neighbouring grey levels, symmetric, mean of two directions."""
    g = gray(px)
    east = Window.partitionBy(ID, "y").orderBy("x")
    north_east = Window.partitionBy(ID, F.col("x") + F.col("y")).orderBy("x")
    both = g.select(ID, F.col("gray").alias("i"), F.lead("gray").over(east).alias("j0"), F.lead("gray").over(north_east).alias("j1"))
    pairs = both.select(ID, F.explode(F.array(*[F.struct(F.lit(k).alias("way"), *x) for k in (0, 1) for x in ((F.col("i").alias("i"), F.col(f"j{k}").alias("j")), (F.col(f"j{k}").alias("i"), F.col("i").alias("j")))])).alias("c")).select(ID, "c.*")
    n = pairs.filter("i IS NOT NULL AND j IS NOT NULL").groupBy(ID, "way", "i", "j").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(ID, "way")
    n = n.withColumn("p", F.col("k") / F.sum("k").over(w))
    n = n.withColumn("mu", F.sum(F.col("p") * F.col("i")).over(w))
    d, m = F.col("i") - F.col("j"), F.col("mu")
    var = F.sum(F.col("p") * (F.col("i") - m) ** 2)
    each = n.groupBy(ID, "way").agg(
        F.sum(F.col("p") * d * d).alias("contrast"),
        F.sum(F.col("p") / (1 + d * d)).alias("homogeneity"),
        F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("energy"),
        F.when(var > 1e-15, F.sum(F.col("p") * (F.col("i") - m) * (F.col("j") - m)) / var).otherwise(1.0).alias("correlation"),
    )
    return each.groupBy(ID).agg(*[F.avg(c).alias(f"glcm_{c}") for c in ("contrast", "homogeneity", "energy", "correlation")])


def gradients(px: DataFrame) -> DataFrame:
    """px with gx and gy, 3 x 3 Sobel slopes; beyond an edge the row or column inside it is seen again."""
    along_x, along_y = Window.partitionBy(ID, "y").orderBy("x"), Window.partitionBy(ID, "x").orderBy("y")

    def sides(c: str, w: Window) -> tuple[Column, Column]:
        back, ahead = F.lag(c).over(w), F.lead(c).over(w)
        return F.coalesce(back, ahead, F.col(c)), F.coalesce(ahead, back, F.col(c))

    left, right = sides("gray", along_x)
    px = gray(px).withColumn("_d", right - left).withColumn("_s", left + 2 * F.col("gray") + right)
    d_up, d_down = sides("_d", along_y)
    s_up, s_down = sides("_s", along_y)
    return px.withColumn("gx", d_up + 2 * F.col("_d") + d_down).withColumn("gy", s_down - s_up).drop("_d", "_s")


def edge_orientation(px: DataFrame) -> DataFrame:
    """Histogram of slopes' directions, 8 bins of 22.5 degrees, as densities."""
    angle = F.pmod(F.degrees(F.atan2("gy", "gx")) + 180, F.lit(180.0))
    at = F.least(F.floor(angle / 22.5), F.lit(7))
    return gradients(px).groupBy(ID).agg(*[(F.count_if(at == i) / F.count(F.lit(1)) / 22.5).alias(f"edge_orientation_bin_{i}") for i in range(8)])


def fractal_dimension(masks: DataFrame, column: str = "cloud") -> DataFrame:
    """Box-counting slope of a mask for boxes of 2 to 32; blocks cut by the edge do not count; 0 with fewer than two sizes."""
    size = masks.groupBy(ID).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    boxes = masks.filter(F.col(column) == 1).select(ID, "x", "y", F.explode(F.array(*[F.lit(2**k) for k in range(1, 6)])).alias("s")).join(size, ID)
    boxes = boxes.filter((F.col("x") < F.col("w") - F.col("w") % F.col("s")) & (F.col("y") < F.col("h") - F.col("h") % F.col("s")))
    counts = boxes.select(ID, "s", F.floor(F.col("x") / F.col("s")).alias("bx"), F.floor(F.col("y") / F.col("s")).alias("by")).distinct().groupBy(ID, "s").agg(F.count(F.lit(1)).alias("n"))
    slope = counts.groupBy(ID).agg(F.when(F.count(F.lit(1)) >= 2, -F.regr_slope(F.log("n"), F.log("s"))).otherwise(0.0).alias("v"))
    return size.select(ID).join(slope, ID, "left").select(ID, F.coalesce("v", F.lit(0.0)).alias("fractal_dimension_proxy"))


def texture_features(px: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    masks = masks if masks is not None else cloud_mask(px)
    return entropy(px).join(co_occurrence(px), ID, "left").join(edge_orientation(px), ID).join(fractal_dimension(masks), ID)


def saliency(px: DataFrame, reach: int = 6) -> DataFrame:
    """px with saliency: distance of grey from its local mean, as a share of the image's largest."""
    g = gray(px)
    g = g.withColumn("_m", F.avg("gray").over(Window.partitionBy(ID, "y").orderBy("x").rangeBetween(-reach, reach)))
    g = g.withColumn("_m", F.avg("_m").over(Window.partitionBy(ID, "x").orderBy("y").rangeBetween(-reach, reach)))
    g = g.withColumn("_d", F.abs(F.col("gray") - F.col("_m")))
    top = F.max("_d").over(Window.partitionBy(ID))
    return g.withColumn("saliency", F.when(top > 0, F.col("_d") / top).otherwise(0.0)).drop("_m", "_d")


def horizon(px: DataFrame) -> DataFrame:
    """The row with the strongest horizontal edges, as a share of the height, and how it stands out."""
    rows = gradients(px).groupBy(ID, "y").agg(F.avg(F.abs("gy")).alias("e"))
    got = rows.groupBy(ID).agg(F.max_by("y", F.struct("e", -F.col("y"))).alias("at"), F.max("e").alias("top"), F.avg("e").alias("mean"), F.max("y").alias("last"))
    return got.select(ID, (F.col("at") / F.greatest("last", F.lit(1))).alias("horizon_row_fraction"), (F.col("top") / (F.col("mean") + 1e-6)).alias("horizon_confidence"))


def symmetry(px: DataFrame) -> DataFrame:
    """Correlation of an image with its mirror image; 0 without spread. A row of pixels is an array; its mirror has the same sums."""
    rows = gray(px).groupBy(ID, "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", F.col("gray").cast("double").alias("v")))), lambda p: p["v"]).alias("a"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda t, v: t + v)
    sums = rows.select(ID, F.size("a").alias("n"), total("a").alias("s"), total(F.transform("a", lambda v: v * v)).alias("q"), total(F.zip_with("a", F.reverse("a"), lambda u, v: u * v)).alias("m"))
    n, s, q, m = F.sum("n"), F.sum("s"), F.sum("q"), F.sum("m")
    spread = n * q - s * s
    return sums.groupBy(ID).agg(F.when(spread > 1e-9 * n * q, (n * m - s * s) / spread).otherwise(0.0).alias("symmetry"))


def composition_features(px: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """Horizon, cloud mass and brightness by vertical thirds, symmetry, empty space and saliency per image."""
    masks = gray(masks if masks is not None else cloud_mask(px))
    rows = masks.withColumn("_h", F.max("y").over(Window.partitionBy(ID)) + 1)
    one, two = F.floor(F.col("_h") / 3), F.floor(2 * F.col("_h") / 3)
    top, middle, bottom = F.col("y") < F.greatest(F.lit(1), one), (F.col("y") >= one) & (F.col("y") < two), F.col("y") >= two
    mass = rows.groupBy(ID).agg(
        F.avg(F.when(top, F.col("cloud"))).alias("vertical_mass_top"),
        F.avg(F.when(middle, F.col("cloud"))).alias("vertical_mass_middle"),
        F.avg(F.when(bottom, F.col("cloud"))).alias("vertical_mass_bottom"),
        (F.avg(F.when(top, F.col("gray"))) / 255).alias("brightness_top"),
        (F.avg(F.when(bottom, F.col("gray"))) / 255).alias("brightness_bottom"),
        F.avg((F.col("cloud") == 0).cast("double")).alias("negative_space_fraction"),
    )
    s = saliency(px).groupBy(ID).agg(
        (F.sum(F.col("x") * F.col("saliency")) / (F.sum("saliency") + 1e-6) / (F.max("x") + 1)).alias("saliency_center_x"),
        (F.sum(F.col("y") * F.col("saliency")) / (F.sum("saliency") + 1e-6) / (F.max("y") + 1)).alias("saliency_center_y"),
        F.stddev_pop("saliency").alias("saliency_spread"),
    )
    points = [F.sqrt((F.col("saliency_center_x") - a / 3) ** 2 + (F.col("saliency_center_y") - b / 3) ** 2) for a in (1, 2) for b in (1, 2)]
    return horizon(px).join(mass, ID).join(symmetry(px), ID).join(s.withColumn("rule_of_thirds_distance", F.least(*points)), ID)


def _wave_weights(sizes: DataFrame, side: int, low: int) -> DataFrame:
    """n, at, weight: what a pixel at a place of n adds to each low frequency of a reduction to side cells.

    A pixel that covers several cells adds to each; one of several in a cell adds its share. A row for each place
    of each image size that occurs.
    """
    cos = F.array(*[F.array(*[F.lit(math.sqrt((1 if u == 0 else 2) / side) * math.cos(math.pi * (2 * i + 1) * u / (2 * side))) for i in range(side)]) for u in range(low)])
    each = sizes.select(F.explode(F.array("h", "w")).alias("n")).distinct().withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cells = F.when(F.col("n") >= side, F.array(F.floor(F.col("at") * side / F.col("n")))).otherwise(F.sequence(F.ceil(F.col("at") * side / F.col("n")), F.ceil((F.col("at") + 1) * side / F.col("n")) - 1))
    each = each.withColumn("cells", cells).withColumn("share", F.when(F.col("n") >= side, 1 / F.count(F.lit(1)).over(Window.partitionBy("n", F.col("cells")[0]))).otherwise(1.0))
    weight = F.transform(cos, lambda wave: F.col("share") * F.aggregate("cells", F.lit(0.0), lambda t, i: t + F.element_at(wave, i.cast("int") + 1)))
    return each.select("n", "at", weight.alias("weight"))


# Frequencies nearer than this are the same: sums of doubles are off by less than a hundredth of it.
SAME_FREQUENCY = 5e-10


def phash(px: DataFrame, side: int = 32, low: int = 8) -> DataFrame:
    """image_id, phash: 64 bits of the low cosine frequencies of a side x side reduction, against their median.

    Reduction and cosines are linear and go row by column, so a pixel's weights are those of its row times those of its
    column: no image is blown up to the side. Two frequencies that are the same and share the middle are not above it,
    in whatever order their sums were made; rounding would part those at a boundary of the last place.
    """
    g = gray(px)
    sizes = g.groupBy(ID).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    weights = F.broadcast(_wave_weights(sizes, side, low))
    across = g.join(sizes.select(ID, "w"), ID).join(weights, (F.col("n") == F.col("w")) & (F.col("at") == F.col("x")))
    across = across.groupBy(ID, "y").agg(*[F.sum(F.col("gray") * F.col("weight")[v]).alias(f"_{v}") for v in range(low)])
    down = across.join(sizes.select(ID, "h"), ID).join(weights, (F.col("n") == F.col("h")) & (F.col("at") == F.col("y")))
    down = down.groupBy(ID).agg(*[F.sum(F.col(f"_{v}") * F.col("weight")[u]).alias(f"c_{u}_{v}") for u in range(low) for v in range(low)])
    cells = F.array(*[F.col(f"c_{u}_{v}") for u in range(low) for v in range(low)])
    rest = F.array_sort(F.slice(cells, low + 1, low * (low - 1)))
    half = low * (low - 1) // 2
    middle = (F.element_at(rest, half) + F.element_at(rest, half + 1)) / 2
    return down.withColumn("_m", middle).select(ID, F.array_join(F.transform(cells, lambda c: F.when(c > F.col("_m") + SAME_FREQUENCY / 2, "1").otherwise("0")), "").alias("phash"))


def region_table(px: DataFrame, importance: str, tile: int = 32, region: str | None = None) -> DataFrame:
    """Mean importance, area share and cloud share of each region (tiles, or a label column), the most important first."""
    where = F.col(region) if region else F.concat_ws("_", F.floor(F.col("y") / tile), F.floor(F.col("x") / tile))
    got = px.groupBy(ID, where.alias("region_id")).agg(F.avg(importance).alias("mean_importance"), F.count(F.lit(1)).alias("_n"), F.avg("cloud").alias("cloud_fraction"))
    w = Window.partitionBy(ID)
    return got.withColumn("area_fraction", F.col("_n") / F.sum("_n").over(w)).withColumn("region_rank", F.row_number().over(w.orderBy(F.desc("mean_importance"), "region_id"))).drop("_n")


# Sizes of crops as shares of the short edge.
CROP_SCALES = (0.35, 0.5, 0.7, 0.9, 1.0)


def crop_candidates(masks: DataFrame, min_size: int = 384, scales: tuple[float, ...] = CROP_SCALES, stride: float = 0.5, min_sky: float = 0.72, min_cloud: float = 0.08, most: int = 8) -> DataFrame:
    """Square crops with enough sky and cloud, the best of each image: x, y, size, sky_fraction, cloud_fraction, crop.

    Shares come from summed-area tables: two running sums an image, and four look-ups a crop.
    """
    along_x = Window.partitionBy(ID, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    along_y = Window.partitionBy(ID, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    area = masks.select(ID, "y", "x", *[F.sum(c).over(along_x).alias(c) for c in ("sky", "cloud")])
    area = area.select(ID, (F.col("y") + 1).alias("ay"), (F.col("x") + 1).alias("ax"), *[F.sum(c).over(along_y).alias(c) for c in ("sky", "cloud")])
    size = masks.groupBy(ID).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    each = size.select(ID, "w", "h", F.posexplode(F.array(*[F.lit(float(s)) for s in scales])).alias("k", "scale"))
    each = each.withColumn("size", F.greatest(F.lit(min_size), F.rint(F.least("w", "h") * F.col("scale")).cast("int"))).filter("size <= w AND size <= h")
    each = each.withColumn("step", F.greatest(F.lit(1), F.rint(F.col("size") * stride).cast("int")))
    starts = lambda n: F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0), n - F.col("size"), F.col("step")), F.array(n - F.col("size")))))
    grid = each.withColumn("y", F.explode(starts(F.col("h")))).withColumn("x", F.explode(starts(F.col("w"))))
    corners = F.array(*[F.struct((F.col("y") + dy).alias("ay"), (F.col("x") + dx).alias("ax"), F.lit(sign).alias("sign")) for dy, dx, sign in ((F.lit(0), F.lit(0), 1), (F.lit(0), F.col("size"), -1), (F.col("size"), F.lit(0), -1), (F.col("size"), F.col("size"), 1))])
    asked = grid.withColumn("c", F.explode(corners)).select(ID, "k", "size", "y", "x", "c.*")
    got = asked.join(area, [ID, "ay", "ax"], "left").groupBy(ID, "k", "size", "y", "x").agg(*[(F.sum(F.col("sign") * F.coalesce(c, F.lit(0))) / (F.col("size") * F.col("size"))).alias(f"{c}_fraction") for c in ("sky", "cloud")])
    got = got.filter((F.col("sky_fraction") >= min_sky) & (F.col("cloud_fraction") >= min_cloud))
    order = Window.partitionBy(ID).orderBy(F.desc(F.col("sky_fraction") + F.col("cloud_fraction") * 0.5), F.desc("size"), "k", "y", "x")
    return got.withColumn("crop", F.row_number().over(order)).filter(F.col("crop") <= most).drop("k")


EXTRACTORS = {"color": color_features, "texture": texture_features, "composition": composition_features}


def masked(px: DataFrame, parts: int | None = None) -> DataFrame:
    """px with gray and cloud, made once, as a table by image, in so many tasks (or as many as Spark finds by size)."""
    return cut(cloud_mask(gray(px).repartition(*([parts] if parts else []), ID)), "pixels")


def extract(px: DataFrame, extractors: tuple[str, ...] = ("color", "texture", "composition")) -> DataFrame:
    """image_id and the features of the chosen extractors; pixels that masked has not made are masked first."""
    masks = px if "cloud" in px.columns else masked(px)
    px = masks.select(*[c for c in masks.columns if c in (ID, "y", "x", "r", "g", "b", "gray")])
    out = None
    for name in extractors:  # each gives a row for every image
        found = EXTRACTORS[name](px, masks)
        out = found if out is None else out.join(found, ID, "left")
    return px.select(ID).distinct() if out is None else out
