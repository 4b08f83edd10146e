"""Mixing sources to target weights by raking, with DataFrame functions only (operator 8).

Documents are counted into cells of source, language and topic, by tokens. Iterative
proportional fitting rakes the cells' weights: each step scales the weights of every value of
one dimension to that value's target share, over the dimensions in turn, until all shares are met to TOLERANCE or
come no nearer, as where targets contradict each other. A
document of a cell is then kept with probability min(1, s * weight / tokens), where s is raised
until what certain cells can't give has fallen to the others, and the kept tokens
come to ``share`` of all.

Only cells are raked, pre-aggregated before any shuffle, so a source with a third of the
rows is a few cells like another; steps go by the values of a dimension, and sums over all cells are single numbers.
The draw is a hash of seed and doc_id against the
probability: it needs no state, and gives the same documents again after a lost executor.

Target shares are given for each dimension's values (``targets``; values of the table without one get nothing, and shares are taken of those
present), or come from tempering: tokens of a value to the power of the dimension's
exponent (1 keeps the mixture, 0 makes values equal), so each value present has a target.

Defined results: a null source, language or topic is a value of its own; a null or wordless
text has no tokens, so where its cell has none its probability is 1; rows that repeat a doc_id
share one draw, a null doc_id too; an empty table gives no rows; a long text counts with all its words. :func:`mixed` returns doc_id and the
columns of its own, of whatever names other columns are; :func:`kept` returns the columns of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import dropped, written

DIMENSIONS = ("source", "lang", "topic")
EXPONENTS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Rounds over all dimensions between two looks at how far shares are off.
ROUNDS = 6
TOLERANCE = 1e-9
SHARE = 0.5
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def topic() -> Column:
    """A topic by what the whole text holds; the table has no column of that name."""
    text = F.col("text")
    return F.when(F.contains(text, F.lit("|")), "table").when(F.contains(text, F.lit("@")) | F.contains(text, F.lit("://")), "contact").when(F.contains(text, F.lit("!!")), "notice").otherwise("prose")


def tokens() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: str) -> Column:
    """A number from 0 to below 1 for each doc_id: the first 52 bits of a digest."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _with_targets(cells: DataFrame, exponents: dict[str, float], targets: dict[str, dict[str | None, float]]) -> DataFrame:
    """cells with the target share of each dimension's value, and their share of tokens as ``weight``."""
    for name, power in exponents.items():
        if name in targets:
            given = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in targets[name].items()], f"_value {dict(cells.dtypes)[name]}, _of_{name} double")
            cells = cells.join(given, F.col(name).eqNullSafe(F.col("_value")), "left").drop("_value").fillna(0.0, [f"_of_{name}"])
        else:
            cells = cells.withColumn(f"_of_{name}", F.pow(F.sum("tokens").over(Window.partitionBy(name)).cast("double"), F.lit(power)))
    for name in exponents:
        total = cells.groupBy(name).agg(F.max(f"_of_{name}").alias("of")).agg(F.sum("of")).first()[0]
        cells = cells.withColumn(f"_of_{name}", F.col(f"_of_{name}") / F.lit(total or 1.0))
    return cells.withColumn("weight", F.col("tokens") / F.lit(cells.agg(F.sum("tokens")).first()[0] or 1))


def _rounds(cells: DataFrame, names: list[str], rounds: int) -> DataFrame:
    for _ in range(rounds):
        for name in names:
            now = F.sum("weight").over(Window.partitionBy(name))
            cells = cells.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"_of_{name}") / now).otherwise(0.0))
    return cells


def raked(cells: DataFrame, exponents: dict[str, float], rounds: int, targets: dict[str, dict[str | None, float]] | None = None) -> DataFrame:
    """cells (dimensions, tokens > 0) with ``weight``, which sums to 1, after so many rounds."""
    return _rounds(_with_targets(cells, exponents, targets or {}), list(exponents), rounds).drop(*(f"_of_{name}" for name in exponents))


def residual(cells: DataFrame, names: list[str]) -> float:
    """How far the share of any value is from its target."""
    off = [cells.groupBy(F.col(name)).agg(F.abs(F.sum("weight") - F.max(f"_of_{name}")).alias("off")).agg(F.max("off").alias("off")) for name in names]
    every = off[0]
    for other in off[1:]:
        every = every.union(other)
    return every.agg(F.max("off")).first()[0] or 0.0


def fitted(cells: DataFrame, exponents: dict[str, float], targets: dict[str, dict[str | None, float]] | None = None, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """cells with ``weight``, raked until they meet their targets or come no nearer; and how far they are off."""
    names = list(exponents)
    now = written(_rounds(_with_targets(cells, exponents, targets or {}), names, ROUNDS), "cells", few_files=True)
    off = residual(now, names)
    while off > tolerance:
        old, now = now, written(_rounds(now, names, ROUNDS), "cells", few_files=True)
        dropped(old)
        before, off = off, residual(now, names)
        if off > 0.9 * before:
            break
    return now.drop(*(f"_of_{name}" for name in names)), off


def probabilities(cells: DataFrame, share: float) -> DataFrame:
    """cells with ``probability``: kept tokens are ``share`` of all, as far as cells can give them."""
    goal = (cells.agg(F.sum("tokens")).first()[0] or 0) * share
    scale, sure_before = float(goal), -1
    while True:
        full = F.lit(scale) * F.col("weight") >= F.col("tokens")
        found = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("sure"), F.sum(F.when(full, F.lit(0.0)).otherwise(F.col("weight"))).alias("open")).first()
        if not found["open"] or found["sure"] == sure_before:
            break
        sure_before, scale = found["sure"], (goal - found["sure"]) / found["open"]
    return cells.withColumn("probability", F.when(full, F.lit(1.0)).otherwise(F.lit(scale) * F.col("weight") / F.col("tokens")))


def mixed(docs: DataFrame, *, exponents: dict[str, float] | None = None, targets: dict[str, dict[str | None, float]] | None = None, share: float = SHARE, seed: str = SEED, topic_column: Column | None = None, row: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability and ``kept`` for each row of docs; after ``row`` if one is given."""
    exponents = exponents or EXPONENTS
    own = docs.select(*([row.alias("row")] if row is not None else []), "doc_id", "source", "lang", (topic() if topic_column is None else topic_column).alias("topic"), tokens().alias("n_tokens"))
    cells = written(own.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")).where(F.col("tokens") > 0), "counts", few_files=True)
    raked_, _ = fitted(cells, exponents, targets)
    # Written, so that its size is known when the join is planned: small ones are broadcast by Spark's own bound.
    cells = written(probabilities(raked_, share), "cells", few_files=True)
    cells = cells.select(*(F.col(c).alias(f"_{c}") for c in DIMENSIONS), "probability")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in DIMENSIONS]
    found = own.join(cells, same[0] & same[1] & same[2], "left").drop(*(f"_{c}" for c in DIMENSIONS))
    found = found.withColumn("probability", F.coalesce("probability", F.lit(1.0)))
    return found.withColumn("kept", uniform(seed) < F.col("probability"))


def kept(docs: DataFrame, **options) -> DataFrame:
    """The documents of the sample, with all columns of docs; options as for :func:`mixed`."""
    whole = F.struct(*(F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)))
    return mixed(docs, row=whole, **options).where("kept").select(*(F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)))


def mixing_sql(source: str = "documents", *, exponents: dict[str, float] | None = None, share: float = SHARE, rounds: int = 4 * ROUNDS, fills: int = 10, seed: str = SEED) -> str:
    """Common table expressions in DuckDB's SQL that end with ``mixed``, the rows of :func:`mixed`.

    SQL has no loop to end at a tolerance, so rounds and fills are as many as suffice by far.
    """
    exponents = exponents or EXPONENTS
    steps = [
        f"""own AS (SELECT *, CASE WHEN contains(text, '|') THEN 'table' WHEN contains(text, '@') OR contains(text, '://') THEN 'contact' WHEN contains(text, '!!') THEN 'notice' ELSE 'prose' END AS topic,
  coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS n_tokens FROM {source})""",
        "c0 AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM own GROUP BY ALL HAVING sum(n_tokens) > 0)",
        "c1 AS (SELECT *, " + ", ".join(f"pow((sum(tokens) OVER (PARTITION BY {d}))::DOUBLE, {p}) AS of_{d}, count(*) OVER (PARTITION BY {d}) AS n_{d}" for d, p in exponents.items()) + " FROM c0)",
        "c2 AS (SELECT source, lang, topic, tokens, " + ", ".join(f"of_{d} / sum(of_{d} / n_{d}) OVER () AS of_{d}" for d in exponents) + ", tokens / sum(tokens) OVER () AS weight FROM c1)",
    ]
    last = "c2"
    for k in range(rounds):
        for d in exponents:
            steps.append(f"r{k}_{d} AS (SELECT * REPLACE (weight * of_{d} / sum(weight) OVER (PARTITION BY {d}) AS weight) FROM {last})")
            last = f"r{k}_{d}"
    steps.append(f"f0 AS (SELECT *, (sum(tokens) OVER ()) * {share} AS goal, (sum(tokens) OVER ()) * {share} AS scale FROM {last})")
    for k in range(fills):
        steps.append(f"""s{k} AS (SELECT *, sum(CASE WHEN scale * weight >= tokens THEN tokens ELSE 0 END) OVER () AS sure, sum(CASE WHEN scale * weight >= tokens THEN 0.0::DOUBLE ELSE weight END) OVER () AS open_ FROM f{k}),
f{k + 1} AS (SELECT * EXCLUDE (sure, open_) REPLACE (CASE WHEN open_ > 0 THEN (goal - sure) / open_ ELSE scale END AS scale) FROM s{k})""")
    steps.append(f"cells AS (SELECT source, lang, topic, CASE WHEN scale * weight >= tokens THEN 1.0::DOUBLE ELSE scale * weight / tokens END AS probability FROM f{fills})")
    steps.append(f"""mixed AS (SELECT own.*, coalesce(cells.probability, 1.0::DOUBLE) AS probability,
  ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / {1 << 52}.0::DOUBLE < coalesce(cells.probability, 1.0::DOUBLE) AS kept
  FROM own LEFT JOIN cells ON own.source IS NOT DISTINCT FROM cells.source AND own.lang IS NOT DISTINCT FROM cells.lang AND own.topic IS NOT DISTINCT FROM cells.topic)""")
    return ",\n".join(steps)
