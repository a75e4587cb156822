"""Statistics over clusters: size histograms, log-linear fits, counts, coverage, sizes, types, curvature segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.beads import finite_positive


#: Bins of a group from which on a histogram raises rather than make rows without end of one stray value.
MOST_BINS = 1_000_000


def size_counts(rows: DataFrame, value: str = "area", width: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., k, edge, n, top and total: how many finite positive values of each group fall between two half-steps of width, how many of them on
    the lower one, their greatest and their sum. Counts of parts of a table, put together, are counts of the table."""
    w, v = F.lit(float(width)), F.col(value).cast("double")
    place = F.floor(v / w - 0.5).cast("long")
    counts = rows.where(finite_positive(v)).select(*[F.col(c) for c in by], v.alias("v"), place.alias("k"))
    return counts.groupBy(*by, "k", (F.col("v") == (F.col("k") + 0.5) * w).alias("edge")).agg(F.count("*").alias("n"), F.max("v").alias("top"), F.sum("v").alias("total"))


def histogram(rows: DataFrame, value: str = "area", width: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., bin (from 0), mid, n and p over the finite positive values of each group.

    Edges are (i + 0.5) * width for i = 0 .. floor(max / width), half-open but for the last; values outside count
    nowhere. A group whose greatest value is below width has one bin from 0 to max + width. Empty bins have n = 0; a
    group of over MOST_BINS bins raises. The values are counted in one pass, pre-aggregated per bin; the groups' maxima
    come from those counts.
    """
    return bins(size_counts(rows, value, width, by), width, by)


def bins(counts: DataFrame, width: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """As histogram, of size_counts, which may come in parts."""
    w = F.lit(float(width))
    whole = Window.partitionBy(*by)
    nb = F.floor(F.max("top").over(whole) / w).cast("long")
    nb = F.when(nb <= MOST_BINS, nb).otherwise(F.raise_error(F.concat(F.lit("too many bins for a greatest value of "), F.max("top").over(whole).cast("string"))).cast("long"))
    counts = counts.withColumn("nb", nb).withColumn("vmax", F.max("top").over(whole))
    last = (F.col("k") == F.col("nb")) & F.col("edge")
    inside = (F.col("nb") == 0) | (F.col("k") >= 0) & ((F.col("k") < F.col("nb")) | last)
    binned = counts.groupBy(*by, F.when(F.col("nb") == 0, F.lit(0)).otherwise(F.least("k", F.col("nb") - 1)).cast("long").alias("bin"), "nb", "vmax").agg(F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("n"))
    every = binned.select(*by, "nb", "vmax").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("nb") - 1, F.lit(0)))))
    full = every.join(binned.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("bin").alias("_bin"), "n"), [F.col("bin") == F.col("_bin"), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]], "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    mid = F.when(F.col("nb") == 0, (F.col("vmax") + w) / 2).otherwise((F.col("bin") + 1) * w)
    return full.select(*by, "bin", mid.alias("mid"), n.alias("n")).withColumn("p", F.try_divide(F.col("n"), F.sum("n").over(whole)))


def fit(hist: DataFrame, low: float, high: float, min_p: float | None, by: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """by..., bins, slope, intercept, r2, rmse and pi of a line through ln p over mid, of the bins with p >= min_p and low <= mid <= high.

    pi is |1 / slope|, NaN for a slope of 0; r2 is NaN if ln p is constant. Groups of fewer than 3 bins are left out,
    or raise if strict.
    """
    if low >= high:
        raise ValueError("the window's low end must be below its high end")
    if min_p is not None and not 0 < min_p <= 1:
        raise ValueError("min_p must be above 0 and at most 1")
    used = hist.where((F.col("p") > 0) & (F.col("p") >= (min_p or 0.0)) & F.col("mid").between(low, high)).withColumn("y", F.ln("p"))
    sums = used.groupBy(*by).agg(F.count("*").alias("bins"), *[F.expr(f"regr_{k}(y, mid)").alias(k) for k in ("slope", "intercept", "sxx", "syy", "sxy")])
    enough = F.col("bins") >= 3
    sums = sums.where(F.when(enough, True).otherwise(F.raise_error(F.lit("fewer than 3 bins to fit")).cast("boolean"))) if strict else sums.where(enough)
    sse = F.greatest(F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.lit(0.0))
    nan = F.lit(float("nan"))
    return sums.select(
        *by,
        F.col("bins"),
        "slope",
        "intercept",
        F.when(F.col("syy") == 0, nan).otherwise(1 - F.try_divide(sse, F.col("syy"))).alias("r2"),
        F.sqrt(sse / F.greatest(F.col("bins") - 2, F.lit(1))).alias("rmse"),
        F.when(F.col("slope") == 0, nan).otherwise(F.abs(F.try_divide(F.lit(1.0), F.col("slope")))).alias("pi"),
    )


def fit_summary(row) -> str:
    """A fit as text."""
    return "\n".join(f"{k} = {v:.6g}" if isinstance(v, float) else f"{k} = {v}" for k, v in row.asDict().items())


def cluster_side(label: Column) -> Column:
    """upper or lower by a label's beginning, else other."""
    low = F.lower(F.trim(label))
    return F.when(low.startswith("upper"), "upper").when(low.startswith("lower"), "lower").otherwise("other")


def clusters_per_frame(clusters: DataFrame) -> DataFrame:
    """frame, upper, lower and total; total counts every row, whatever its side or area."""
    on = lambda s: F.count_if(F.col("side") == s).alias(s)
    return clusters.groupBy("frame").agg(on("upper"), on("lower"), F.count("*").alias("total"))


def clusters_rollup(clusters: DataFrame) -> DataFrame:
    """As clusters_per_frame, with a row of null frame for all frames and the mean number per frame."""
    on = lambda s: F.count_if(F.col("side") == s).alias(s)
    sums = clusters.rollup("frame").agg(F.grouping("frame").cast("int").alias("all_frames"), on("upper"), on("lower"), F.count("*").alias("total"), F.countDistinct("frame").alias("frames"))
    return sums.select("frame", "all_frames", "upper", "lower", "total", (F.col("total") / F.col("frames")).alias("mean_per_frame"))


def areas_per_frame(clusters: DataFrame) -> DataFrame:
    """frame, upper and lower area over the finite positive areas."""
    on = lambda s: F.sum(F.when(F.col("side") == s, F.col("area")).otherwise(0.0)).alias(s)
    return clusters.where(finite_positive(F.col("area"))).groupBy("frame").agg(on("upper"), on("lower"))


def coverage(clusters: DataFrame, box: DataFrame) -> DataFrame:
    """frame, upper, lower and total coverage in percent of the frames with clusters; a last row of null frame has the means.

    box has frame, lx and ly, one row a frame; a frame without a box raises.
    """
    joined = areas_per_frame(clusters).join(box.select("frame", "lx", "ly"), "frame", "left")
    plane = F.when(F.col("lx").isNull(), F.raise_error(F.lit("a frame has no box")).cast("double")).otherwise(F.col("lx") * F.col("ly"))
    share = joined.select("frame", (100 * F.col("upper") / plane).alias("upper"), (100 * F.col("lower") / plane).alias("lower"), (100 * (F.col("upper") + F.col("lower")) / (2 * plane)).alias("total"))
    return share.unionByName(share.agg(*[F.avg(c).alias(c) for c in ("upper", "lower", "total")]).withColumn("frame", F.lit(None).cast(share.schema["frame"].dataType)))


def mean_sizes(clusters: DataFrame) -> DataFrame:
    """frame, upper, lower and total mean area; the row of null frame pools all clusters. A side without clusters has 0."""
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.when(c, F.col("area"))), F.count_if(c)), F.lit(0.0))
    side = F.col("side")
    return clusters.where(finite_positive(F.col("area")) & side.isin("upper", "lower")).rollup("frame").agg(mean(side == "upper").alias("upper"), mean(side == "lower").alias("lower"), mean(F.lit(True)).alias("total"))


def type_areas(triangles: DataFrame, frames: DataFrame) -> DataFrame:
    """frame, neutral and tail area of defect triangles (type code 1, else 0) and their shares in percent; every given frame is there, the null frame pools all."""
    of = lambda c: F.sum(F.when(c, F.col("area")).otherwise(0.0))
    neutral = F.col("defect_type") == 1
    sums = frames.select("frame").distinct().join(triangles.select("frame", "defect_type", "area"), "frame", "left").rollup("frame").agg(F.coalesce(of(neutral), F.lit(0.0)).alias("neutral"), F.coalesce(of(F.col("defect_type").isNotNull() & ~neutral), F.lit(0.0)).alias("tail"))
    whole = F.col("neutral") + F.col("tail")
    share = lambda c: F.coalesce(F.try_divide(100 * F.col(c), whole), F.lit(0.0)).alias(f"{c}_percent")
    return sums.select("frame", "neutral", "tail", share("neutral"), share("tail"))


def curvature_segments(clusters: DataFrame, n: int = 5, h: str = "h") -> DataFrame:
    """The rows with a finite area above 0, and the segment (1 to n) of their curvature; segments share the range of h over all rows of finite area and h.

    The last segment is closed. A constant h raises.
    """
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    real = clusters.where(finite(F.col("area").cast("double")) & finite(F.col(h).cast("double")))
    ends = real.agg(F.min(h).alias("_lo"), F.max(h).alias("_hi")).first()
    if ends._lo is None:
        return real.withColumn("segment", F.lit(None).cast("int"))
    if ends._lo == ends._hi:
        raise ValueError("all curvatures are equal")
    step = (ends._hi - ends._lo) / n
    edges = [F.lit(ends._lo + step * i) for i in range(1, n)]
    at = sum((F.when(F.col(h) >= e, 1).otherwise(0) for e in edges), F.lit(1))
    return real.where(F.col("area") > 0).withColumn("segment", at.cast("int"))
