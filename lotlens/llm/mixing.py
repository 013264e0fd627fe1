"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame functions only.

Targets: sources share the budget by weight; no target exceeds ``cap`` times its source's size, and the
excess goes to the others by weight (water filling, in closed form over one row per source).
Sampling: each document has the key -ln(u) / quality, u from a hash of its id. A source first takes as many
complete epochs as its target holds; for the rest its documents are taken in key order up to the budget.

The place where a source is cut is found without sorting it: the key is mapped to (0, 1), sizes are
summed in 4096 ranges, the range that holds the cut is split into 4096 again, and only the rows of one such
cell are sorted. The decision is then one row per source, applied to documents without moving their text.

Defined results: null text has no words; a null source is a source of its own, last in order; repeated
rows of one id are taken together; a null id is told apart by its text; null, negative or zero quality counts
as 1; a source without words has target 0; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotlens.session import stored

WEIGHTS = (5, 2, 1)
CAP = 3
RANGES = 4096


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters other than space, tab, line feed, vertical tab, form feed, carriage return."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def draw_key(doc_id: Column, text: Column, quality: Column) -> Column:
    """Exponential key: the smaller, the earlier. 52 bits of a hash of the id give u."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), text), F.lit(""))
    u = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    return -F.log(u) / F.when(quality > 0, quality.cast("double")).otherwise(1.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size -> and target; ``sizes`` has one row per source."""
    every = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.array([F.lit(float(w)) for w in weights])[rank % len(weights)]
    ranked = sizes.select("source", "source_size", weight.alias("weight"))
    fullest = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    capped, spent = F.coalesce(F.sum("source_size").over(fullest) * cap, F.lit(0)), F.coalesce(F.sum("weight").over(fullest), F.lit(0.0))
    levels = ranked.select("*", ((F.sum("source_size").over(every) - capped).cast("double") / (F.sum("weight").over(every) - spent)).alias("level"))
    # the level rises while sources are capped that fall short of it, then sinks: its maximum is the right one
    return levels.select(
        "source", "source_size",
        F.least(F.col("source_size").cast("double") * cap, F.max("level").over(every) * F.col("weight")).alias("target"),
    )


def _cut(rows: DataFrame, cell: Column) -> DataFrame:
    """The cell of each source in which its running size passes ``rest``; ``rest`` less what lies before it."""
    cells = rows.groupBy("s", "rest", cell.alias("cell")).agg(F.sum("size").alias("held"))
    running = cells.select("*", F.sum("held").over(Window.partitionBy("s").orderBy("cell")).alias("upto"))
    return running.filter((F.col("upto") - F.col("held") < F.col("rest")) & (F.col("rest") <= F.col("upto"))).select(
        "s", "cell", (F.col("rest") - F.col("upto") + F.col("held")).alias("rest"))


def unit_rows(docs: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """Narrow rows of the documents: doc_id, source, unit_id, size, key and place in 0 .. RANGES^2 - 1."""
    doc_id, text = F.col("doc_id"), F.col("text")
    rows = docs.select(
        doc_id, F.col("source"), n_words(text).alias("size"), _unit(doc_id, text).alias("unit_id"),
        F.when(doc_id.isNull(), text).alias("text"))
    rows = _with_quality(rows, quality, "doc_id")
    return rows.select("doc_id", "source", "unit_id", "size", draw_key(doc_id, text, F.col("q")).alias("key")).withColumn("place", _place(F.col("key")))


def decisions(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: size, target, complete epochs, and the cut of the fractional selection."""
    sizes = units.groupBy("source").agg(F.sum("size").alias("source_size"))
    size, target = F.col("source_size"), F.col("target")
    epochs = F.when(size > 0, F.floor(target / size)).otherwise(0).cast("long")
    plan = stored(source_targets(sizes, weights, cap).select(
        "source", "source_size", "target", epochs.alias("epochs"), (target - epochs * size).alias("rest")), "mix_plan")
    rows = units.select("source", "unit_id", "size", "key", "place")

    def within(found: DataFrame) -> DataFrame:
        return rows.join(found, F.col("source").eqNullSafe(F.col("s")))

    upper = F.floor(F.col("place") / RANGES)
    first = _cut(within(plan.filter("rest > 0").select(F.col("source").alias("s"), "rest")), upper)
    first = stored(first.withColumnRenamed("cell", "upper"), "mix_upper")
    second = _cut(within(first).filter(upper == F.col("upper")), F.col("place"))
    second = stored(second.withColumnRenamed("cell", "cut_place"), "mix_place")
    last = within(second).filter(F.col("place") == F.col("cut_place")).groupBy("source", "rest", "key", "unit_id").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("key", "unit_id"))
    taken = last.select("*", upto.alias("upto")).filter(F.col("upto") - F.col("size") / 2 <= F.col("rest"))
    ends = taken.groupBy("source").agg(F.max(F.struct("key", "unit_id")).alias("cut")).select(F.col("source").alias("c"), "cut")
    return stored(
        plan.join(second.select("s", "cut_place"), F.col("source").eqNullSafe(F.col("s")), "left")
        .join(ends, F.col("source").eqNullSafe(F.col("c")), "left")
        .select(F.col("source").alias("mix_source"), "source_size", "target", "epochs", "cut_place", F.col("cut.key").alias("cut_key"), F.col("cut.unit_id").alias("cut_id")),
        "mix_decisions")


def with_copies(rows: DataFrame, source: Column, decided: DataFrame) -> DataFrame:
    """Adds the decision of the row's source and ``copies``, how often the mix takes the row; needs key, place, unit_id."""
    place, cut = F.col("place"), F.col("cut_place")
    upto = F.struct("key", "unit_id") <= F.struct(F.col("cut_key").alias("key"), F.col("cut_id").alias("unit_id"))
    part = (place < cut) | ((place == cut) & F.col("cut_key").isNotNull() & upto)
    return rows.join(decided, source.eqNullSafe(F.col("mix_source"))).withColumn("copies", F.col("epochs") + F.when(part, 1).otherwise(0))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) of each document.

    ``quality``: doc_id, quality (positive sampling weight); several rows of one id count by their mean.
    """
    units = stored(unit_rows(docs, quality), "mix_units")
    chosen = with_copies(units, F.col("source"), decisions(units, weights, cap))
    return chosen.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: each as often as it is taken, all columns kept."""
    units = stored(unit_rows(docs, quality), "mix_units")
    decided = decisions(units, weights, cap)
    doc_id, text = F.col("doc.doc_id"), F.col("doc.text")
    rows = _with_quality(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), quality, "doc.doc_id")
    rows = rows.select("doc", _unit(doc_id, text).alias("unit_id"), draw_key(doc_id, text, F.col("q")).alias("key")).withColumn("place", _place(F.col("key")))
    chosen = with_copies(rows, F.col("doc.source"), decided).filter("copies > 0")
    return chosen.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def _unit(doc_id: Column, text: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(F.concat(F.lit("text "), text), F.lit(""))))


def _with_quality(rows: DataFrame, quality: DataFrame | None, doc_id: str) -> DataFrame:
    if quality is None:
        return rows.withColumn("q", F.lit(None).cast("double"))
    means = quality.groupBy(F.col("doc_id").alias("q_id")).agg(F.avg("quality").alias("q"))
    # weights grow with the documents: the same join at every size
    return rows.join(means.hint("merge"), F.col(doc_id) == F.col("q_id"), "left").drop("q_id")


def _place(key: Column) -> Column:
    """The key mapped to 0 .. RANGES^2 - 1, in order."""
    top = RANGES * RANGES
    return F.least(F.floor((1 - F.exp(-key)) * top), F.lit(top - 1)).cast("long")


def label_quality(labels: DataFrame) -> DataFrame:
    """Sampling weights from labels: 2 for good, 0.5 for bad documents; the others count 1."""
    return labels.filter(F.col("quality").isNotNull()).select("doc_id", F.pow(F.lit(2.0), 2 * F.col("quality") - 1).alias("quality"))
