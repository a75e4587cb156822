"""Mixing of sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table, word_count

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of a block.
BLOCK = 1024
#: The mix's size as a share of all sizes, and how often a source may be repeated at most.
SHARE, REPEATS = 1.5, 2
#: Fan-out of the trees by which running totals are taken: no window holds more rows of one source than a few times this.
FAN = 64
_BITS = 6


def _levels(rows: int) -> int:
    """Levels of a tree whose leaves hold a few rows even if one source has them all."""
    levels = 1
    while FAN**levels * 16 < rows and levels < 8:
        levels += 1
    return levels


def running_totals(rows: DataFrame, group: str, place: Column, bits: int, value: str, order: list[str], total: str, n_rows: int) -> DataFrame:
    """Adds `total`, the sum of `value` over the rows of the same group that come before in the order of (place, *order).

    place is a long from 0 to 2**bits - 1. Sums go up a tree over place's leading digits and down again, so no task
    sees a whole group, however large it is.
    """
    levels = min(_levels(n_rows), max(1, bits // _BITS))
    digit = lambda k: F.shiftrightunsigned(F.col("_place"), bits - _BITS * k).cast("long")  # noqa: E731  the first k digits
    rows = rows.withColumn("_place", place).withColumn("_leaf", digit(levels))
    sums = rows.groupBy(group, "_leaf").agg(F.sum(value).alias("_v"))
    tree = [sums]
    for _ in range(levels - 1):
        tree.append(tree[-1].groupBy(group, F.shiftrightunsigned("_leaf", _BITS).alias("_leaf")).agg(F.sum("_v").alias("_v")))
    before = None
    for k, level in reversed(list(enumerate(tree))):
        up = F.shiftrightunsigned("_leaf", _BITS)
        own = F.coalesce(F.sum("_v").over(Window.partitionBy(group, "_up").orderBy("_leaf").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        level = level.withColumn("_up", up if k < levels - 1 else F.lit(0).cast("long")).withColumn("_own", own)
        if before is None:
            before = level.select(group, "_leaf", F.col("_own").alias("_off"))
        else:
            above = before.select(F.col(group), F.col("_leaf").alias("_up"), F.col("_off").alias("_above"))
            before = level.join(above, [group, "_up"]).select(group, "_leaf", (F.col("_own") + F.col("_above")).alias("_off"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(group, "_leaf").orderBy("_place", *order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(before, [group, "_leaf"]).withColumn(total, F.col("_off") + inside).drop("_off", "_place", "_leaf")


def source_targets(sized: DataFrame) -> DataFrame:
    """One row per source: k (its key), source_size, weight, target (double), quota (whole words), blocks, slots.

    Targets share SHARE of all sizes by weight; a target stops at REPEATS times its source's size and the excess goes to the others by weight,
    until none is above. Works on one row per source, pre-aggregated.
    """
    every = Window.partitionBy()
    sums = sized.groupBy("k", "source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(rank - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    capped = (
        sums.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size").cast("double") * REPEATS)
        .withColumn("total", F.sum("source_size").over(every).cast("double") * SHARE)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    order = Window.orderBy("ratio", "k").rowsBetween(Window.unboundedPreceding, -1)
    capped = (
        capped.withColumn("caps", F.coalesce(F.sum("cap").over(order), F.lit(0.0)))
        .withColumn("weights", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
        .withColumn("full", F.col("ratio") <= (F.col("total") - F.col("caps")) / F.col("weights"))
        .withColumn("left", F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0)))
        .withColumn("open", F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(every), F.lit(0.0)))
        .withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("left") * F.col("weight") / F.col("open")))
    )
    size, quota = F.col("source_size"), F.col("quota")
    rest = F.col("quota") - F.col("passes") * size
    return (
        capped.withColumn("quota", F.least(F.round("target").cast("long"), size * REPEATS))
        .withColumn("passes", F.when(size > 0, F.floor(quota / size)).otherwise(0).cast("long"))
        .withColumn("blocks", F.ceil(size / BLOCK))
        .withColumn("rest", rest)
        .withColumn("slots", (F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / BLOCK)).cast("long"))
        .select("k", "source", "source_size", "weight", "target", "quota", "blocks", "rest", "slots")
    )


def _reversed_bits(x: Column, bits: int) -> Column:
    """x's last bits in reverse order: van der Corput's sequence in base 2, times 2**bits."""
    return F.conv(F.reverse(F.lpad(F.bin(x), bits, "0")), 2, 10).cast("long")


def schedule(targets: DataFrame) -> DataFrame:
    """The mix's slots: slot (their order), k, rank (of the slot within its source), turn (how often its source was gone through before), block and words it takes.

    Slot t stands for van der Corput's point t, which falls into the range of one source: ranges follow one another, as wide
    as the slots that a source needs and `bits` more. The mix is the sequence's first N points, N the width of
    all ranges, cut at each source's target; a source gets what its points among them give. Such a beginning falls apart into
    runs of evenly spread points, one for each bit of N at most, each short of a range's share by less than one;
    so every source has the slots it needs, spread over the whole schedule. A less even sequence leaves sources short.
    """
    spark = targets.sparkSession
    known = targets.where("slots > 0").agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n"), F.count("*").alias("sources")).first()
    bits = _BITS
    while known.n + known.sources * bits > 1 << bits:
        bits += 1
    n = known.n + known.sources * bits
    upto = F.sum(F.col("slots") + bits).over(Window.orderBy("k"))
    edge = lambda x: F.expr(f"(cast({x} AS decimal(19, 0)) * cast({1 << bits} AS decimal(19, 0)) + {max(n, 1) - 1}) div {max(n, 1)}")
    ranges = targets.where("slots > 0").withColumn("end", upto).withColumn("start", F.col("end") - F.col("slots") - bits)
    ranges = ranges.withColumn("lo", edge("start")).withColumn("hi", edge("end"))
    near = ranges.select("k", "lo", "hi", "blocks", "slots", "rest", "source_size", F.explode(F.sequence(F.shiftright("lo", 12), F.shiftright(F.col("hi") - 1, 12))).alias("chunk"))
    points = spark.range(n).select(F.col("id").alias("slot"), _reversed_bits(F.col("id"), bits).alias("point")).withColumn("chunk", F.shiftright("point", 12))
    placed = points.join(near, "chunk").where("point >= lo AND point < hi").select("k", "blocks", "slots", "rest", "source_size", "slot", F.lit(1).cast("long").alias("one"))
    ranked = running_totals(placed, "k", F.col("slot"), bits, "one", [], "rank", n).where("rank < slots")
    block = F.col("rank") % F.col("blocks")
    whole = F.least(F.lit(BLOCK), F.col("source_size") - F.col("block") * BLOCK)
    last = (F.col("rank") == F.col("slots") - 1) & (F.col("rest") > 0)
    return ranked.withColumn("block", block).select("slot", "k", "rank", F.floor(F.col("rank") / F.col("blocks")).cast("int").alias("turn"), "block", F.when(last, F.least(whole, F.col("rest") - (F.ceil(F.col("rest") / BLOCK) - 1) * BLOCK)).otherwise(whole).cast("long").alias("words"))


def mix(sized: DataFrame) -> DataFrame:
    """Adds source_size, target, taken and slots to a table of uid, doc_id, source and size (words, long).

    Each source's rows are shuffled by a hash of doc_id, laid end to end and cut to blocks of BLOCK words; the
    schedule's slots take blocks in turn, the last slot of a source only the words that its target still lacks.
    taken is the number of words the slots take of a row, repeats counted: never over REPEATS times its size. slots holds
    the first slot of each turn that takes words of the row, so the schedule's order is the mix's order. Rows of no
    words take none and have no slots; equal rows stand beside each other; a null source is a source of its own, and
    comes last; an empty table gives no rows.
    """
    sized = materialize(sized.select("uid", "doc_id", "source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("k"), "size"), "mix-sizes")
    n = sized.count()
    targets = materialize(source_targets(sized), "mix-targets")
    shuffled = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("mix")), 16)
    laid = running_totals(sized, "k", shuffled, 48, "size", ["doc_id", "size", "uid"], "at", n)
    cut = laid.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / BLOCK).cast("long"), F.floor((F.col("at") + F.col("size") - 1) / BLOCK).cast("long"))))
    first, end = F.greatest("at", F.col("block") * BLOCK), F.col("at") + F.col("size")
    joined = cut.join(schedule(targets).select("k", "block", "words", "slot", "turn"), ["k", "block"])
    part = F.greatest(F.lit(0).cast("long"), F.least(end, F.col("block") * BLOCK + F.col("words")) - first)
    firsts = [F.min(F.when(F.col("turn") == i, F.col("slot"))) for i in range(REPEATS)]
    taken = joined.withColumn("part", part).where("part > 0").groupBy("uid").agg(F.sum("part").alias("taken"), F.filter(F.array(*firsts), lambda x: x.isNotNull()).alias("slots"))
    return (
        sized.join(taken, "uid", "left")
        .join(targets.select("k", "source_size", "target"), "k")
        .select("uid", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("slots", F.array().cast("array<long>")).alias("slots"))
    )


def mixed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, source, text and any others) as the mix holds them: rows come as often as the mix takes them, to the nearest whole; rows it doesn't take are left out.

    Each partition is in the schedule's order, by the slot where a copy begins; as rows are dealt to partitions by hash,
    whoever reads a file from its start finds the sources in their shares all along.
    """
    named = materialize(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct("*").alias("row")), "mix-rows")
    sized = named.select("uid", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), word_count(F.col("row.text")).alias("size"))
    copies = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")
    each = mix(sized).where("size > 0").select("uid", F.slice("slots", 1, copies).alias("slots")).where(F.size("slots") > 0)
    return named.join(each, "uid").select("row", F.explode("slots").alias("slot")).sortWithinPartitions("slot").select("row.*")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: how much of each is taken, and the slot of the schedule where it first comes (null: never)."""
    docs = table(spark, sf_dir, "documents")
    sized = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(sized).withColumn("first_slot", F.get("slots", F.lit(0))).drop("uid", "slots")
