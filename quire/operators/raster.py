"""Comparing page images as tables of pixels.

Pixels are rows (page, x, y and channels), so masks, dilation and differences are filters,
joins and counts, with the page in every key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS = 5
MOST_MISMATCH = 0.62
MOST_RAW = 0.09
# Fixed values of the public perceptual difference: weights of the Y, I and Q channels, and the largest squared distance.
YIQ = ((0.29889531, 0.58662247, 0.11448223), (0.59597799, -0.27417610, -0.32180189), (0.21147017, -0.52261711, 0.31114694))
YIQ_WEIGHTS = (0.5053, 0.299, 0.1957)
YIQ_MOST = 35215.0


def is_ink(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Visible and not white."""
    return (a > 10) & ((r < 246) | (g < 246) | (b < 246))


def dilated(ink: DataFrame, by: Sequence[str], width: Column, height: Column, radius: int = RADIUS) -> DataFrame:
    """Pixels within a radius of ink, inside the page: by, x, y, each once (R2)."""
    disc = [(dx, dy) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius]
    around = F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in disc))
    spread = ink.select(*by, width.alias("_w"), height.alias("_h"), F.inline(around))
    return spread.where("x >= 0 AND y >= 0 AND x < _w AND y < _h").select(*by, "x", "y").distinct()


def tolerant_diff(reference: DataFrame, candidate: DataFrame, by: Sequence[str], width: Column, height: Column, radius: int = RADIUS, most: float = MOST_MISMATCH) -> DataFrame:
    """Per page: shares of ink of each side that is not near ink of the other, and the verdict."""

    def share(own: DataFrame, other: DataFrame, name: str) -> DataFrame:
        near = dilated(other, by, width, height, radius).withColumn("_near", F.lit(1))
        return own.join(near, [*by, "x", "y"], "left").groupBy(*by).agg((F.count_if(F.col("_near").isNull()) / F.count("*")).alias(name))

    pages = reference.select(*by).union(candidate.select(*by)).distinct()
    out = pages.join(share(reference, candidate, "missing_ratio"), list(by), "left").join(share(candidate, reference, "extra_ratio"), list(by), "left").fillna(0.0, ["missing_ratio", "extra_ratio"])
    return out.withColumn("tolerant_passed", F.greatest("missing_ratio", "extra_ratio") <= most)


def color_distance(one: str = "", two: str = "_b") -> Column:
    """Squared perceptual distance of two pixels blended with white, by luminance and chrominance."""

    def blended(suffix: str) -> list[Column]:
        alpha = F.col(f"a{suffix}") / 255.0
        return [255.0 + (F.col(f"{c}{suffix}") - 255.0) * alpha for c in "rgb"]

    a, b = blended(one), blended(two)
    total = F.lit(0.0)
    for weights, share in zip(YIQ, YIQ_WEIGHTS, strict=True):
        delta = sum(((x - y) * w for x, y, w in zip(a, b, weights, strict=True)), F.lit(0.0))
        total = total + delta * delta * share
    return total


def _around(name_x: str = "x", name_y: str = "y") -> Column:
    """The eight places around one, numbered by column and then by row."""
    places = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
    return F.array(*(F.struct(F.lit(k).alias("k"), (F.col(name_x) + dx).alias("nx"), (F.col(name_y) + dy).alias("ny")) for k, (dx, dy) in enumerate(places)))


def anti_aliased(both: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, x, y of the pixels of ``both`` with ``differs`` that only soften an edge in one of the images.

    Such a pixel lies between a darkest and a brightest of its neighbours, has few neighbours of its own brightness, and one of
    these two has, in both images, three neighbours or more of its own colour. both: by, x, y, r, g, b, a and the same with _b, one row for
    each pixel of a page. Only neighbours of differing pixels are joined.
    """

    def light(suffix: str) -> Column:
        return sum(((255.0 + (F.col(f"{c}{suffix}") - 255.0) * F.col(f"a{suffix}") / 255.0) * w for c, w in zip("rgb", YIQ[0], strict=True)), F.lit(0.0))

    def color(suffix: str) -> Column:
        return F.struct(*(F.col(f"{c}{suffix}") for c in "rgba"))

    size = both.groupBy(*by).agg(F.max("x").alias("_mx"), F.max("y").alias("_my"))
    pixels = both.select(*by, "x", "y", light("").alias("_la"), light("_b").alias("_lb"), color("").alias("_ca"), color("_b").alias("_cb"), "differs")
    other = pixels.select(*by, F.col("x").alias("nx"), F.col("y").alias("ny"), *(F.col(c).alias(f"{c}n") for c in ("_la", "_lb", "_ca", "_cb")))
    edge = ((F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.col("_mx")) | (F.col("y") == F.col("_my"))).cast("int")

    near = pixels.where("differs").select(*by, "x", "y", "_la", "_lb", F.inline(_around())).join(other, [*by, "nx", "ny"])
    picks = []
    for side in "ab":
        delta = F.col(f"_l{side}") - F.col(f"_l{side}n")
        place = [F.col("k"), F.col("nx"), F.col("ny")]
        picks += [F.count_if(delta == 0).alias(f"_same_{side}"), F.min(F.when(delta < 0, F.struct(delta.alias("d"), *place))).alias(f"_low_{side}"), F.min(F.when(delta > 0, F.struct((-delta).alias("d"), *place))).alias(f"_high_{side}")]
    found = near.groupBy(*by, "x", "y").agg(*picks).join(size, list(by)).withColumn("_edge", edge)

    def ends(side: str) -> Column:
        """The darkest and the brightest neighbour, if there are both and few neighbours are as bright."""
        low, high = F.col(f"_low_{side}"), F.col(f"_high_{side}")
        good = (F.col(f"_same_{side}") + F.col("_edge") <= 2) & low.isNotNull() & high.isNotNull()
        return F.when(good, F.array(*(F.struct(e["nx"].alias("px"), e["ny"].alias("py")) for e in (low, high)))).otherwise(F.array())

    asked = found.select(*by, "x", "y", F.inline(F.concat(ends("a"), ends("b"))))
    places = asked.select(*by, F.col("px").alias("x"), F.col("py").alias("y")).distinct().join(pixels.select(*by, "x", "y", "_ca", "_cb"), [*by, "x", "y"]).join(size, list(by)).withColumn("_edge", edge)
    alike = places.select(*by, "x", "y", "_ca", "_cb", "_edge", F.inline(_around())).join(other, [*by, "nx", "ny"]).groupBy(*by, "x", "y", "_edge").agg(F.count_if(F.col("_ca") == F.col("_can")).alias("_a"), F.count_if(F.col("_cb") == F.col("_cbn")).alias("_b"))
    many = alike.where((F.col("_a") + F.col("_edge") > 2) & (F.col("_b") + F.col("_edge") > 2)).select(*by, F.col("x").alias("px"), F.col("y").alias("py"))
    return asked.join(many, [*by, "px", "py"], "left_semi").select(*by, "x", "y").distinct()


def pixel_diff(reference: DataFrame, candidate: DataFrame, by: Sequence[str], threshold: float = 0.3, *, count_anti_aliased: bool = True) -> DataFrame:
    """Per page: differing and total pixels and their ratio; a pixel that one side lacks is white.

    Pixels that only differ by anti-aliasing count, unless count_anti_aliased is false; pages must then have all their pixels.
    """
    right = candidate.select(*by, "x", "y", *(F.col(c).alias(f"{c}_b") for c in "rgba"))
    both = reference.select(*by, "x", "y", "r", "g", "b", "a").join(right, [*by, "x", "y"], "full_outer").fillna(255)
    both = both.withColumn("differs", color_distance() > YIQ_MOST * threshold * threshold)
    counts = both.groupBy(*by).agg(F.count_if("differs").alias("differing_pixels"), F.count("*").alias("total_pixels"))
    if not count_anti_aliased:
        soft = anti_aliased(both, by).groupBy(*by).agg(F.count("*").alias("_soft"))
        counts = counts.join(soft, list(by), "left").withColumn("differing_pixels", F.col("differing_pixels") - F.coalesce("_soft", F.lit(0))).drop("_soft")
    return counts.withColumn("mismatch_ratio", F.col("differing_pixels") / F.col("total_pixels"))


def page_verdict(tolerant: Column, mismatch: Column, most: float = MOST_RAW) -> Column:
    """Tolerably alike, or few pixels differ at all."""
    return tolerant | (mismatch <= most)


def document_verdicts(pages: DataFrame, by: Sequence[str], counts: DataFrame) -> DataFrame:
    """Per document, from its page differences and counts (by, reference_pages, candidate_pages).

    Only pages that both sides have are compared.
    """
    seen = pages.join(counts, list(by)).where(F.col("page_no") <= F.least("reference_pages", "candidate_pages"))
    each = seen.groupBy(*by).agg(F.bool_and(F.col("differing_pixels") == 0).alias("_exact"), F.bool_and("page_passed").alias("_tolerant"), F.sum("differing_pixels").alias("_d"), F.sum("total_pixels").alias("_t"))
    same = F.col("reference_pages") == F.col("candidate_pages")
    return counts.join(each, list(by), "left").select(
        *by,
        same.alias("page_count_matches"),
        (same & F.coalesce("_exact", F.lit(True))).alias("exact_passed"),
        (same & F.coalesce("_tolerant", F.lit(True))).alias("tolerant_passed"),
        F.when(F.coalesce("_t", F.lit(0)) > 0, F.col("_d") / F.col("_t")).otherwise(0.0).alias("raw_mismatch_ratio"),
    )
