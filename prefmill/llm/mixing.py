"""Mix sources to target weights by Poisson replication.

Each source gets a mean repetition rate: the characters it should contribute
over those it has. A document's count is Poisson with that mean, read off the
inverse distribution at a uniform number hashed from (seed, id, text), so a rerun
or another partitioning gives the same copies. Copies are then dealt to random
partitions and ordered randomly inside: a uniform global shuffle in one exchange.

Null texts count as empty, a null source is a source of its own, a null id is
hashed as an empty string. Rows with one id and different texts draw apart; rows
equal in id, text and source get equal counts. Sources without any characters get rate 0.
Extra input columns of whatever name are carried along; names in ``ADDED`` are overwritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import freeze
from . import rows

ADDED = ("copy", "shuffle_key")
STEP = 16.0  # means above this are split into equal parts, each with its own hash, so exp(-mean) stays exact


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from the md5 of the parts."""
    text = F.concat_ws(":", *parts)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def poisson_count(rate: Column, *key: Column) -> Column:
    """Poisson draws by inversion: how many cumulative probabilities the hashed number has passed."""
    parts = F.greatest(F.ceil(rate / F.lit(STEP)), F.lit(1)).cast("int")
    mean = rate / parts

    def draw(j):
        u = uniform(*key, j.cast("string"))
        first = F.exp(-mean)
        state = F.struct(first.alias("term"), first.alias("total"), F.lit(0).alias("n"))
        # 100 terms pass every double below 1 for means up to 16
        walked = F.aggregate(
            F.sequence(F.lit(1), F.lit(100)), state,
            lambda s, k: F.when(u < s["total"], s).otherwise(F.struct(
                (s["term"] * mean / k).alias("term"), (s["total"] + s["term"] * mean / k).alias("total"),
                (s["n"] + 1).alias("n"))))
        return walked["n"]

    return F.aggregate(F.transform(F.sequence(F.lit(1), parts), draw), F.lit(0), lambda a, b: a + b)


def source_rates(docs: DataFrame, power: float, budget: float) -> DataFrame:
    """Mean repetitions per source: weights are shares of characters raised to ``power``.

    ``budget`` is the size of the mix as a multiple of the input's characters.
    One small row per source; the total is a window over those rows.
    """
    size = F.sum(F.length(F.coalesce("text", F.lit("")))).cast("double")
    per = docs.groupBy("source").agg(size.alias("chars"))
    total = per.agg(F.sum("chars").alias("all_chars"), F.sum(F.pow(F.col("chars"), F.lit(power))).alias("all_weight"))
    row = total.first()
    all_chars, all_weight = row["all_chars"] or 0.0, row["all_weight"] or 0.0
    weight = F.pow(F.col("chars"), F.lit(power)) / F.lit(all_weight or 1.0)
    rate = F.when(F.col("chars") > 0, weight * F.lit(budget * all_chars) / F.col("chars")).otherwise(F.lit(0.0))
    return per.select("source", "chars", F.round(rate, 9).alias("rate"))


def mix(docs: DataFrame, power: float = 0.7, budget: float = 1.0, seed: int = 7, rates: DataFrame | None = None) -> DataFrame:
    """Documents repeated at their source's rate and shuffled; ``copy`` counts from 1.

    ``rates`` (source, rate) replaces the rates derived from the corpus. The join
    with it is left to the planner, which knows the written table's size: sources
    are few, and a hot one is split by adaptive execution where they are not.
    """
    docs = docs.drop(*ADDED)
    rates = freeze(source_rates(docs, power, budget) if rates is None else rates).select(
        F.col("source").alias("_source"), F.col("rate").alias("_rate"))
    ident = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    seeded = F.lit(str(seed))
    joined = rows.packed(docs, F.col("source"), ident.alias("ident")).join(rates, F.col("source").eqNullSafe(F.col("_source")))
    counted = joined.withColumn("_n", poisson_count(F.col("_rate"), seeded, F.col("ident"))).where("_n > 0")
    copies = counted.select("row", "ident", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))
    key = uniform(F.lit(f"{seed}s"), F.col("ident"), F.col("copy").cast("string"))
    mixed = copies.select("row.*", "copy", key.alias("shuffle_key"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key")
