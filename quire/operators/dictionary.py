"""Style dictionaries: distinct attribute sets numbered by first appearance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sequences import numbered

#: Places in one stretch of a numbering.
STRETCH = 1 << 16


def dictionary(rows: DataFrame, by: Sequence[str], order: Sequence[str], keys: Sequence[str], prefix: str, seeds: Sequence[Sequence] = ()) -> DataFrame:
    """by, keys and id: ``prefix`` and a number by first use. Sets of nulls alone have no entry.

    seeds come first, whether used or not, in their order, in every document.
    """
    used = rows.where(F.coalesce(*(F.col(k).cast("string") for k in keys)).isNotNull())
    first = used.groupBy(*by, *keys).agg(F.min(F.struct(*order)).alias("_first")).withColumn("_seed", F.lit(None).cast("int"))
    if seeds:
        kinds = dict(rows.dtypes)
        listed = F.array(*(F.struct(*(F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(keys, seed, strict=True)), F.lit(k).alias("_seed")) for k, seed in enumerate(seeds)))
        documents = rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()
        given = documents.select(*by, F.inline(listed))
        first = first.unionByName(given, allowMissingColumns=True).groupBy(*by, *keys).agg(F.min("_first").alias("_first"), F.min("_seed").alias("_seed"))
    # In a document's order, in stretches: seeds, then by what the first place is a multiple of where that is a whole number.
    place = first.schema["_first"].dataType[order[0]]
    stretch = F.floor(F.col("_first")[order[0]] / STRETCH) if isinstance(place.dataType, T.IntegralType) else F.lit(0).cast("long")
    out = numbered(first.withColumn("_stretch", F.when(F.col("_seed").isNull(), stretch)), by, "_stretch", [F.col("_seed").asc_nulls_last(), F.col("_first")], "_no")
    return out.select(*by, *keys, F.concat(F.lit(prefix), F.col("_no")).alias("id"))


def with_ids(rows: DataFrame, entries: DataFrame, by: Sequence[str], keys: Sequence[str], out: str) -> DataFrame:
    """rows with the id of their attribute set; nulls match nulls."""
    named = entries.select(*(F.col(c).alias(f"_{c}") for c in [*by, *keys]), F.col("id").alias(out))
    same = F.lit(True)
    for c in [*by, *keys]:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(named, same, "left").drop(*(f"_{c}" for c in [*by, *keys]))


def resolve_fonts(wanted: DataFrame, installed: DataFrame) -> DataFrame:
    """wanted (key, candidates) with ``font``: its first candidate that is installed."""
    ranked = wanted.select("key", F.posexplode("candidates").alias("priority", "name"))
    found = ranked.join(installed.select("name").distinct(), "name", "left_semi").groupBy("key").agg(F.min_by("name", "priority").alias("font"))
    return wanted.join(found, "key", "left")
