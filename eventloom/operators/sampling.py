"""Seeded sampling by hash order: the same rows on any cluster. Distributions match the reference, draws don't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicons import RELATIONS


def mark(seed: int, *keys: str) -> Column:
    """The md5 of seed and keys, as text: an order that any engine can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def draw(seed: int, *keys: str) -> Column:
    """Uniform in [0, 1) from keys, by 32 bits of their mark."""
    return F.conv(F.substring(mark(seed, *keys), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def capped(rows: DataFrame, by: list[str], keys: list[str], most: Column, seed: int = 7) -> DataFrame:
    """At most `most` rows of each group, in the order of their marks."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(mark(seed, *by, *keys), *keys))
    return rows.withColumn("_n", rank).where(F.col("_n") <= most).drop("_n")


def split(samples: DataFrame, key: str, validation_share: float, seed: int = 7) -> DataFrame:
    """Adds is_validation: an exact count in hash order, at least one row and never all."""
    n = samples.count()
    held = min(max(1, int(n * validation_share)), n - 1) if n > 1 else 0
    chosen = samples.select(key).orderBy(mark(seed, key), key).limit(held).withColumn("is_validation", F.lit(True))
    return samples.join(chosen, key, "left").withColumn("is_validation", F.coalesce("is_validation", F.lit(False)))


def training_pairs(positives: DataFrame, negatives: DataFrame, ratio: float = 1.0, seed: int = 7) -> DataFrame:
    """Labelled pairs and, for each sample, max(1, ratio × positives) negatives with label none and score at most 0.49."""
    wanted = positives.groupBy("sample_id").agg(F.greatest(F.lit(1), (F.count("*") * ratio).cast("int")).alias("_most"))
    some = capped(negatives.join(wanted, "sample_id"), ["sample_id"], ["source", "target"], F.col("_most"), seed).drop("_most")
    return positives.withColumn("is_negative", F.lit(False)).unionByName(some.select("sample_id", "source", "target", F.lit("none").alias("label"), F.least("score", F.lit(0.49)).alias("score"), F.lit(True).alias("is_negative")))


def perturb(gold: DataFrame, pairs: DataFrame, seed: int = 7, drop: float = 0.25, flip: float = 0.15, noise: float = 0.25) -> DataFrame:
    """A coarse graph from a gold one: some edges dropped, some with another type, scores drawn, and random wrong edges."""
    keys = ["sample_id", "source", "target"]
    kinds = F.array(*[F.lit(r) for r in RELATIONS])
    kept = gold.where(draw(seed, *keys, "relation_type") >= drop)
    other = F.element_at(kinds, (F.floor(draw(seed + 2, *keys) * len(RELATIONS)) + 1).cast("int"))
    kept = kept.withColumn("relation_type", F.when(draw(seed + 1, *keys) < flip, other).otherwise(F.col("relation_type")))
    wanted = gold.groupBy("sample_id").agg(F.greatest(F.lit(1), (F.count("*") * noise).cast("int")).alias("_most"))
    wrong = capped(pairs.join(gold, keys, "left_anti").join(wanted, "sample_id"), ["sample_id"], ["source", "target"], F.col("_most"), seed + 3)
    wrong = wrong.select(*keys, F.lit("precedes").alias("relation_type"), (0.05 + 0.5 * draw(seed + 4, *keys)).alias("score"))
    return kept.select(*keys, "relation_type", (0.55 + 0.4 * draw(seed + 5, *keys)).alias("score")).unionByName(wrong)


def synthetic_samples(samples: DataFrame, seed: int = 7) -> dict[str, DataFrame]:
    """A random graph for each row of samples (sample_id), to try a refiner on: tables nodes, edges, queries, as features makes them, edges labelled.

    4 to 8 nodes, and from one edge fewer than nodes to twice the nodes, 12 at most, but never more than there are pairs. An edge's source is any
    node but the last, its target any later one, each pair once: pairs ordered by exponential draws with those chances, which is drawing until
    a new pair comes. Rows of equal sample_id have equal graphs.
    """

    def u(k: int, low: float = 0.0, high: float = 1.0, *keys: str) -> Column:
        return low + (high - low) * draw(seed + k, "sample_id", *keys)

    def whole(k: int, low: Column, high: Column, *keys: str) -> Column:
        return (low + F.floor(draw(seed + k, "sample_id", *keys) * (high - low + 1))).cast("int")

    def coin(k: int, *keys: str) -> Column:
        return F.when(draw(seed + k, "sample_id", *keys) < 0.5, 0.0).otherwise(1.0)

    drawn = samples.select("sample_id").withColumn("n", whole(0, F.lit(4), F.lit(8)))
    drawn = drawn.withColumn("m", F.least(whole(1, F.col("n") - 1, F.least(F.col("n") * 2, F.lit(12))), (F.col("n") * (F.col("n") - 1) / 2).cast("int")))
    at = drawn.withColumn("ord", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    node = [u(10, 0, 6, "ord"), u(11, 3, 18, "ord"), F.col("ord").cast("double"), u(12, 0.3, 0.95, "ord"), coin(13, "ord"), u(14, 3, 10, "ord"), u(15, 0, 8, "ord"), coin(16, "ord"), coin(17, "ord"), coin(18, "ord")]
    nodes = at.select("sample_id", F.concat(F.lit("n"), "ord").alias("event_id"), *[c.alias(f"f{k}") for k, c in enumerate(node)])
    pairs = at.withColumnRenamed("ord", "s").where("s < n - 1").withColumn("t", F.explode(F.sequence(F.col("s") + 1, F.col("n") - 1)))
    late = -F.ln(draw(seed + 20, "sample_id", "s", "t") + 1e-12) * (F.col("n") - 1 - F.col("s"))
    pairs = pairs.withColumn("ord", F.row_number().over(Window.partitionBy("sample_id").orderBy(late, "s", "t")) - 1).where("ord < m")
    k = ["s", "t"]
    told = pairs.withColumns({"f2": u(21, 0.5, 1.0, *k), "f3": u(22, 0, 1, *k), "f4": u(23, 0, 1, *k), "f5": coin(24, *k), "f6": u(25, 0, 1, *k), "type_id": whole(26, F.lit(0), F.lit(len(RELATIONS) - 1), *k)})
    told = told.withColumn("f0", 0.34 * F.col("f2") + 0.22 * F.col("f3") + 0.18 * F.col("f4") + 0.16 * F.col("f5") + 0.10 * F.col("f6"))
    apart = (F.col("t") - F.col("s")).cast("double")
    rest = [F.col("s"), F.col("t"), apart, apart, apart / 4.0, *[F.lit(x) for x in (0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0)]]
    edges = told.select(
        "sample_id", "ord", F.concat(F.lit("n"), "s").alias("source"), F.concat(F.lit("n"), "t").alias("target"), "f0", F.col("type_id").cast("double").alias("f1"), *[f"f{i}" for i in range(2, 7)],
        *[c.cast("double").alias(f"f{i + 7}") for i, c in enumerate(rest)], (F.col("f0") >= 0.62).cast("int").alias("edge_label"), "type_id", F.col("f0").alias("strength"),
    )
    query = [u(30, 1, 3), u(31, 2, 6), F.col("n").cast("double"), F.col("m").cast("double"), u(32, 0, 8), coin(33)]
    return {"nodes": nodes, "edges": edges, "queries": drawn.select("sample_id", *[c.alias(f"f{i}") for i, c in enumerate(query)])}
