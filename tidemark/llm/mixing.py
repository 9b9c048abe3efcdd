"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

The mix takes as many words as the documents have. A source's target is its
share by weight, at most ``repeat`` times its size, the excess reshared by weight
(the level is found in closed form on one row per source). The words are dealt
as blocks of ``block`` words, to sources with a target under one block as single words: the highest quotients target / (2 seats + 1) win,
first among sources, then among a source's shards. A source of n words has
sqrt(n / SPREAD) shards, so that neither the documents of a shard nor the shards of
a source outgrow a task; no window over documents spans more than one shard. Inside a shard documents are ordered by a seeded hash
and its quota is taken from that order, going round again when it exceeds the
shard.

Edge cases: a null source is a source, last in order; null and empty texts have
size 0 and give nothing; a source of size 0 has target 0; an empty table gives
no rows; equal rows are interchangeable; null ids count as the empty string; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_PATTERN, checkpoint

WEIGHTS = (5, 2, 1)
REPEAT = 3
BLOCK = 32
SPREAD = 2000
SEED = 1729


def targets(sources: DataFrame, weights=WEIGHTS, repeat: int = REPEAT) -> DataFrame:
    """To rows (source, source_size) adds weight and target: min(repeat * size, level * weight), summing to all sizes.

    The level: with sources by repeat * size / weight, rising, and the first k of
    them full, the rest share what is left by weight; the smallest k whose next
    source isn't overfull is the answer.
    """
    everywhere = Window.partitionBy(F.lit(0))
    order = everywhere.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * repeat).withColumn("ratio", F.col("cap") / F.col("weight"))
    rising = everywhere.orderBy("ratio", F.col("source").isNull(), F.encode("source", "utf-8"))
    full = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everywhere) - full) / rest
    ranked = ranked.withColumn("level", F.when(level <= F.col("ratio"), F.struct(F.row_number().over(rising), level.alias("level"))))
    ranked = ranked.withColumn("level", F.min("level").over(everywhere)["level"])
    return ranked.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def sainte_lague(votes: DataFrame, by: list, seats) -> DataFrame:
    """To rows with ``votes`` (and a distinct ``place``) adds ``quota``: ``seats`` dealt by highest quotients within ``by``.

    A divisor that surely gives too few seats fixes most of them at once, one that
    surely gives too many bounds the rest; only the quotients between the two, some
    two a row, are ranked.
    """
    group = Window.partitionBy(*by)
    total, n = F.sum("votes").over(group), F.count(F.lit(1)).over(group)
    rows = votes.withColumn("_seats", seats)
    few, many = F.greatest(F.col("_seats") - n, F.lit(0)), F.col("_seats") + n
    rows = rows.withColumn("_sure", F.coalesce(F.floor(F.try_divide(F.col("votes") * few, total) + 0.5 - 1e-9), F.lit(0)).cast("long"))
    rows = rows.withColumn("_most", F.coalesce(F.ceil(F.try_divide(F.col("votes") * many, total) + 0.5), F.lit(0)).cast("long"))
    rows = rows.withColumn("_sure", F.greatest(F.lit(0), F.col("_sure")))
    open_seats = rows.withColumn("_left", F.col("_seats") - F.sum("_sure").over(group))
    seat = F.explode(F.when(F.col("_most") > F.col("_sure"), F.sequence(F.col("_sure"), F.col("_most") - 1)).otherwise(F.array().cast("array<bigint>")))
    asked = open_seats.filter("votes > 0").select(*by, "place", "votes", "_left", seat.alias("_seat"))
    best = group.orderBy((F.col("votes") / (2 * F.col("_seat") + 1)).desc(), "place", "_seat")
    won = asked.withColumn("_rank", F.row_number().over(best)).filter("_rank <= _left").groupBy(*by, "place").agg(F.count(F.lit(1)).alias("_won"))
    won = won.withColumnsRenamed({c: f"_w_{c}" for c in (*by, "place")})
    same = F.col("place") == F.col("_w_place")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_w_{c}"))
    return rows.join(won, same, "left").select(*votes.columns, (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias("quota"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, repeat: int = REPEAT, block: int = BLOCK, spread: int = SPREAD, seed: int = SEED) -> DataFrame:
    """One row per document: id, size, source_size, target, taken."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    # Id and text together order the documents, so that rows without an id spread as well.
    draw = F.xxhash64(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    rows = checkpoint(docs.select(F.col(doc_id).alias("_id"), F.col(source).alias("source"), size.alias("size"), draw.alias("_draw")))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = checkpoint(targets(sources, weights, repeat))
    # Sources under one block share their words one by one, the others the rest as blocks; a last block that isn't full is dealt as well.
    dealt = goal.withColumn("votes", F.col("target")).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.encode("source", "utf-8")))).withColumn("_few", F.coalesce(F.col("target") < block, F.lit(True)))
    every = Window.partitionBy(F.lit(0))
    few = F.coalesce(F.round(F.sum(F.when(F.col("_few"), F.col("target"))).over(every)), F.lit(0)).cast("long")
    words = F.sum("source_size").over(every) - few
    dealt = dealt.withColumn("unit", F.when(F.col("_few"), 1).otherwise(block)).withColumn("_blocks", F.when(F.col("_few"), few).otherwise(F.ceil(words / F.lit(block))).cast("long"))
    by_source = sainte_lague(dealt, ["_few"], F.col("_blocks"))
    by_source = checkpoint(by_source.select("source", "source_size", "target", "unit", "quota", F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("source_size") / F.lit(spread)))).cast("int").alias("shards")))
    quotas = by_source.select(F.col("source").alias("_s"), "source_size", "target", F.col("quota").alias("_blocks"), "unit", "shards")
    placed = rows.join(quotas, F.col("source").eqNullSafe(F.col("_s"))).withColumn("place", F.pmod("_draw", "shards").cast("int")).drop("_s", "shards")
    cells = placed.groupBy("source", "place").agg(F.sum("size").cast("double").alias("votes"), F.max("_blocks").alias("_blocks"), F.max("unit").alias("unit"))
    cells = checkpoint(sainte_lague(cells, ["source"], F.col("_blocks")))
    cells = cells.select(F.col("source").alias("_s"), F.col("place").alias("_p"), F.col("votes").cast("long").alias("cell"), F.least(F.col("quota") * F.col("unit"), F.col("votes").cast("long") * repeat).alias("take"))
    joined = placed.join(cells, F.col("source").eqNullSafe(F.col("_s")) & (F.col("place") == F.col("_p")))
    inside = Window.partitionBy("source", "place").orderBy(F.xxhash64("_draw"), "_id", "size")
    before = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    rounds = F.coalesce(F.floor(F.try_divide("take", "cell")), F.lit(0)).cast("long")
    rest = F.col("take") - rounds * F.col("cell")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))
    out = joined.withColumn("_before", before).withColumn("taken", taken.cast("long"))
    return out.select(F.col("_id").alias(doc_id), "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), "taken")
