"""Mixing sources to target weights by Pareto order sampling.

Sources get targets by weight, held at a multiple of their size. A document's expected number of copies is
its source's scale times a weight of its own, at most the ceiling: by default the square root of its size,
taken at the power of two below, so that long documents are taken more often, but not in proportion. The
scale is such that the expected words of a source are its target. The whole part of a document's expected
copies is taken for certain; the fraction is its inclusion probability for one more. Documents are ranked
by random odds over inclusion odds (Pareto order sampling) and taken in that order until the source's
remaining words are reached: the sample's size in words is fixed, and the probabilities are unequal.

The place where a source's order is cut is found by two grouped histograms of the rank and then by the
few rows of one fine cell, so a source may hold any share of all rows: nothing sorts or collects a source.
Random numbers are hashes of the id, so reruns agree. All main-path work is DataFrame functions.

Defined results: null texts have size 0; documents without words weigh as those of one word; a null source
is a source, the last in order; rows that repeat an id and text share a rank and are taken together;
sources without words have target 0; an empty table gives no rows; a very long text is one row like any
other; other columns are kept (names of the added ones, if there, are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import is_small, join_lookup, materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CEILING = 2.0
SEED = 20_240_521
#: A document's weight is its size to this power.
POWER = 0.5
#: Cells of a histogram; two of them make CELLS ** 2 fine cells.
CELLS = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sources: DataFrame, column: str) -> DataFrame:
    """``sources`` (one row each) with ``position`` from 0 in code point order, null last."""
    order = F.col(column).asc_nulls_last()
    parts = materialize(sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("part", F.spark_partition_id()))
    shifts, at = {}, 0
    for row in parts.groupBy("part").count().orderBy("part").collect():  # a row for each partition
        shifts[row["part"]] = at
        at += row["count"]
    shift = F.coalesce(*[F.when(F.col("part") == p, F.lit(n)) for p, n in shifts.items()], F.lit(0))
    number = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return parts.withColumn("position", (number - 1 + shift).cast("long")).drop("part")


def targets(sources: DataFrame, column: str, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """Adds each source's ``target`` to its ``source_size``.

    A target is its weight's part of all words wanted; what goes beyond the ceiling is shared again by
    weight among the others. The driver sees sums only.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    known = materialize(ranked(sources, column).withColumn("weight", weight).withColumn("most", F.col("source_size") * ceiling))
    wanted = share * (known.agg(F.sum("source_size")).first()[0] or 0)
    level, held = 0.0, -1
    while True:
        full = F.col("weight") * level > F.col("most")
        now = known.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("most"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight"), F.count_if(full).alias("held")).first()
        if now["held"] == held or not now["weight"]:
            break
        held, level = now["held"], (wanted - now["most"]) / now["weight"]
    return materialize(known.withColumn("target", F.least("most", F.col("weight") * level)).drop("most", "weight", "position"))


def class_of(size: Column) -> Column:
    """Documents of sizes up to the next power of two weigh the same."""
    return F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int")


def expected_copies(scale: Column, size_class: Column, power: float, ceiling: float) -> Column:
    return F.least(scale * F.pow(F.lit(2.0), size_class * power), F.lit(float(ceiling)))


def scales(classes: DataFrame, aims: DataFrame, power: float, ceiling: float, few: bool) -> DataFrame:
    """Each source's ``scale``, at which its expected words are its target.

    ``classes`` has a source's words by size class, few rows. If the classes above one are at the ceiling,
    those up to it share what is left; the highest class that then stays at or below the ceiling tells the scale.
    """
    weight = F.pow(F.lit(2.0), F.col("class") * power)
    above = Window.partitionBy("source").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, 0)
    held, rest = F.coalesce(F.sum("size").over(above), F.lit(0)) * ceiling, F.sum(weight * F.col("size")).over(upto)
    rows = join_lookup(classes, aims.select("source", "target"), ["source"], small=few).withColumns({"scale": (F.col("target") - held) / F.when(rest > 0, rest), "weight": weight})
    fits = rows.filter(F.col("scale") * F.col("weight") <= ceiling)
    found = fits.groupBy("source").agg(F.max_by("scale", "class").alias("scale"))
    # none fits where the target is the ceiling of all documents
    full = F.when(F.col("target") > 0, F.lit(float("inf"))).otherwise(0.0)
    return join_lookup(aims, found, ["source"], small=few).withColumn("scale", F.greatest(F.coalesce("scale", full), F.lit(0.0)))


def odds_rank(id_: Column, probability: Column, seed: int = SEED) -> Column:
    """Random odds over inclusion odds, mapped to 0 to 1 in the same order."""
    u = (F.shiftrightunsigned(F.xxhash64(id_, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    q = (u / (1 - u)) / (probability / (1 - probability))
    return q / (1 + q)


def cell_of(rank: Column) -> Column:
    return F.least(F.floor(rank * (CELLS * CELLS)), F.lit(CELLS * CELLS - 1)).cast("long")


def crossing(found: DataFrame, by: str) -> DataFrame:
    """For each source the first histogram cell at which its remaining words are reached."""
    sums = found.groupBy("source", by, "left").agg(F.sum("size").alias("size"))
    until = F.sum("size").over(Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    first = sums.withColumn("until", until).filter("until >= left")
    return first.groupBy("source").agg(F.min_by(F.struct(F.col(by).alias("at"), (F.col("until") - F.col("size")).alias("before")), by).alias("cut")).select("source", "cut.*")


def plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING, power: float = POWER, seed: int = SEED) -> DataFrame:
    """A row for each source: its size and target, its scale, and where its order is cut."""
    size = words(F.col(text_col))
    sized = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")))
    classes = materialize(sized.groupBy("source", class_of(F.col("size")).alias("class")).agg(F.sum("size").alias("size"), F.count("*").alias("rows")))
    aims = targets(classes.groupBy("source").agg(F.sum("size").alias("source_size")), "source", weights, share, ceiling)
    few = is_small(aims)  # as every table of a row for each source is
    aims = materialize(scales(classes, aims, power, ceiling, few))
    copies = expected_copies(F.col("scale"), F.col("class"), power, ceiling)
    certain = join_lookup(classes, aims, ["source"], small=few).groupBy("source").agg(F.sum(F.floor(copies) * F.col("size")).alias("certain"))
    aims = materialize(join_lookup(aims, certain, ["source"], small=few).withColumn("left", F.col("target") - F.col("certain")))
    rows = join_lookup(sized, aims, ["source"], small=few).withColumn("copies", expected_copies(F.col("scale"), class_of(F.col("size")), power, ceiling))
    open_ = rows.withColumn("fraction", F.col("copies") - F.floor("copies")).filter("fraction > 0").withColumn("rank", odds_rank(F.col("id"), F.col("fraction"), seed)).withColumn("cell", cell_of(F.col("rank"))).withColumn("coarse", F.floor(F.col("cell") / CELLS))
    first = materialize(crossing(open_, "coarse").withColumnsRenamed({"at": "coarse_at", "before": "before1"}))
    inside = materialize(join_lookup(open_, first, ["source"], "inner", small=few).filter("coarse = coarse_at").withColumn("left", F.col("left") - F.col("before1")).select("source", "id", "size", "rank", "cell", "left"))
    second = materialize(crossing(inside, "cell").withColumnsRenamed({"at": "cell_at", "before": "before2"}))
    # the rows of one fine cell: those ranked so that their middle word is within what remains
    last = join_lookup(inside, second, ["source"], "inner", small=few).filter("cell = cell_at").groupBy("source", "rank", "left", "before2").agg(F.sum("size").alias("size"))
    until = F.sum("size").over(Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    final = materialize(last.withColumn("until", until).filter("before2 + until - size / 2.0 <= left").groupBy("source").agg(F.max("rank").alias("rank_at")))
    return materialize(join_lookup(join_lookup(aims, second.drop("before2"), ["source"], small=few), final, ["source"], small=few))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", prefix: str = "", ceiling: float = CEILING, power: float = POWER, seed: int = SEED, **options) -> DataFrame:
    """``docs`` with size, source_size, target, expected and copies (0, 1, 2, ...) of each row, their names after ``prefix``.

    The texts are not shuffled: a source's row of the plan says which of its documents are taken.
    """
    cuts = plan(docs, id_col, source_col, text_col, ceiling=ceiling, power=power, seed=seed, **options)
    there = {c: f"__{c}" for c in cuts.columns if c != "source"}
    rows = join_lookup(docs, cuts.withColumnsRenamed(there | {"source": source_col}), [source_col])
    # exploded, so that the words are counted once and not for each expression that uses their number
    rows = rows.select("*", F.explode(F.array(words(F.col(text_col)))).alias("__size"))
    rows = rows.withColumn("__copies", expected_copies(F.col("__scale"), class_of(F.col("__size")), power, ceiling))
    fraction = F.col("__copies") - F.floor("__copies")
    rank = odds_rank(F.col(id_col), fraction, seed)
    cell, at = cell_of(rank), F.col("__cell_at")
    chosen = at.isNull() | (cell < at) | (cell == at) & F.coalesce(rank <= F.col("__rank_at"), F.lit(False))
    extra = F.when((fraction > 0) & (F.col("__left") > 0), chosen.cast("long")).otherwise(0)
    added = {f"{prefix}size": F.col("__size"), f"{prefix}source_size": F.col("__source_size"), f"{prefix}target": F.col("__target"), f"{prefix}expected": F.col("__copies"), f"{prefix}copies": F.floor("__copies") + extra}
    return rows.withColumns(added).drop(*there.values(), "__size", "__copies")


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    mixed = mix(docs, prefix="__mix_", **options)
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_copies")))
    return mixed.filter(F.col("__mix_copies") > 0).withColumn("__mix_copy", times).select(*docs.columns)
