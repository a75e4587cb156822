"""Coverage of triangles by beads: which triangles are defects, and of what type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import barycentric_grid, dot, local_frame, point, sub

#: Half-height of the slab around a triangle's plane in which beads count.
SLAB = 30.0
HEAD_THRESHOLD, LEAST_COVERAGE, GRID, RADIUS_SCALE = 0.5, 0.0, 21, 1.0
#: mode: no plane, covered by a head, too little covered, judged. type: tail, neutral.
DEGENERATE, HEAD, BARE, JUDGED = 0, 1, 2, 3
TAIL, NEUTRAL = 0, 1
#: Samples in one long of a bit set.
BITS = 62


def bead_table(beads: DataFrame, atoms: DataFrame) -> DataFrame:
    """beads with the flag and radius of (res_name, atom_name) in atoms; a bead that isn't there raises."""
    joined = beads.join(atoms.select("res_name", "atom_name", "flag", "radius"), ["res_name", "atom_name"], "left")
    return joined.withColumn("flag", F.when(F.col("flag").isNull(), F.raise_error(F.concat(F.lit("no such bead: "), "res_name", F.lit(" "), "atom_name")).cast("string")).otherwise(F.col("flag")))


def placed_pairs(triangles: DataFrame, beads: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate pairs (frame, tri, bead) with the bead's place over the triangle: depth (signed distance), px, py, and the corners' b_x, c_x, c_y in the plane.

    triangles: frame, tri, ax .. cz; beads: frame, bead, x, y, z, radius, flag (h, t, n).
    """
    a, b, c = point("a"), point("b"), point("c")
    local = local_frame(a, b, c)
    flat = triangles.select(
        "frame", "tri", *[F.col(f"a{k}") for k in "xyz"], *[local[v][i].alias(f"{v}{k}") for v in ("u", "v", "n") for i, k in enumerate("xyz")], local["degenerate"].alias("degenerate"),
        dot(sub(b, a), local["u"]).alias("b_x"), dot(sub(c, a), local["u"]).alias("c_x"), dot(sub(c, a), local["v"]).alias("c_y"),
    )
    joined = candidates.select("frame", "tri", "bead").join(flat, ["frame", "tri"]).join(beads.select("frame", "bead", "x", "y", "z", "radius", "flag"), ["frame", "bead"])
    away = sub((F.col("x"), F.col("y"), F.col("z")), a)
    return joined.select("frame", "tri", "bead", "flag", "radius", "degenerate", "b_x", "c_x", "c_y", *[dot(away, point(v)).alias(n) for v, n in (("n", "depth"), ("u", "px"), ("v", "py"))])


def _words(grid: int) -> list[Column]:
    """The samples of a barycentric grid, as arrays of at most BITS structs (bit, wb, wc); one array for each word of a bit set."""
    samples = barycentric_grid(grid)
    return [F.array(*[F.struct(F.lit(1 << i).cast("long").alias("bit"), F.lit(w[1]).alias("wb"), F.lit(w[2]).alias("wc")) for i, w in enumerate(samples[at : at + BITS])]) for at in range(0, len(samples), BITS)]


def _covers(scale: float):
    """Whether a pair's disk holds a sample (its edge included)."""

    def test(p: Column) -> Column:
        dx = p["wb"] * F.col("b_x") + p["wc"] * F.col("c_x") - F.col("px")
        dy = p["wc"] * F.col("c_y") - F.col("py")
        return dx * dx + dy * dy <= (F.col("radius") * scale) ** 2

    return test


def _in_slab(pairs: DataFrame, slab: float) -> DataFrame:
    return pairs.where(~F.col("degenerate") & F.col("depth").between(-slab, slab) & (F.col("radius") > 0))


def classify(triangles: DataFrame, beads: DataFrame, candidates: DataFrame, grid: int = GRID, slab: float = SLAB, head_threshold: float = HEAD_THRESHOLD, least: float = LEAST_COVERAGE, scale: float = RADIUS_SCALE) -> DataFrame:
    """frame, tri, n_candidates, n_after_slab, n_used, head_fraction, other_fraction, total_fraction, mode, defect_type and is_defect of each triangle.

    A bead in the slab covers the samples of the triangle's barycentric grid that lie in its disk (inclusive). A head
    that covers any sample rules a defect out. The type is that of which beads cover more samples; a tie goes to the
    covering bead of greatest depth (the smaller id of equals), and to tail without one. What a bead covers is a bit set
    of a few longs, so unions are partial aggregates and no triangle's beads are ever gathered.
    """
    words = _words(grid)
    inside = _in_slab(placed_pairs(triangles, beads, candidates), slab)
    covers, n_words = _covers(scale), range(len(words))
    disks = inside.withColumns({f"hit{k}": F.aggregate(w, F.lit(0).cast("long"), lambda bits, p: F.when(covers(p), bits.bitwiseOR(p["bit"])).otherwise(bits)) for k, w in enumerate(words)})
    used = reduce(Column.__or__, [F.col(f"hit{k}") != 0 for k in n_words])
    kinds = {"head": "h", "neutral": "n", "tail": "t"}
    sums = disks.groupBy("frame", "tri").agg(
        F.count("*").alias("n_after_slab"), F.count_if(used).alias("n_used"),
        *[F.bit_or(F.when(F.col("flag") == f, F.col(f"hit{k}")).otherwise(0)).alias(f"{name}{k}") for name, f in kinds.items() for k in n_words],
        F.max(F.when(used & (F.col("flag") != "h"), F.struct(F.col("depth"), (-F.col("bead")).alias("first"), F.col("flag")))).alias("top"),
    )
    size = lambda *names: reduce(Column.__add__, [F.bit_count(reduce(Column.bitwiseOR, [F.col(f"{x}{k}") for x in names])) for k in n_words])
    sums = sums.select("frame", "tri", "n_after_slab", "n_used", "top", *[size(x).alias(x) for x in kinds], size("neutral", "tail").alias("other"), size(*kinds).alias("total"))
    counts = candidates.groupBy("frame", "tri").agg(F.count("*").alias("n_candidates"))
    flat = local_frame(point("a"), point("b"), point("c"))["degenerate"]
    rows = triangles.select("frame", "tri", flat.alias("degenerate")).join(counts, ["frame", "tri"], "left").join(sums, ["frame", "tri"], "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    share = lambda c: n(c) / float(len(barycentric_grid(grid)))
    mode = F.when(F.col("degenerate"), DEGENERATE).when(n("head") > 0, HEAD).when(share("total") < least, BARE).otherwise(JUDGED)
    kind = F.when(n("neutral") > n("tail"), NEUTRAL).when(n("neutral") < n("tail"), TAIL).when(F.col("top.flag") == "n", NEUTRAL).otherwise(TAIL)
    return rows.select(
        "frame", "tri", n("n_candidates").alias("n_candidates"), n("n_after_slab").alias("n_after_slab"), n("n_used").alias("n_used"),
        share("head").alias("head_fraction"), share("other").alias("other_fraction"), share("total").alias("total_fraction"), mode.alias("mode"), kind.alias("defect_type"),
    ).withColumn("is_defect", (F.col("mode") == JUDGED) & (F.col("head_fraction") <= head_threshold))


def head_veto(triangles: DataFrame, beads: DataFrame, candidates: DataFrame, grid: int = GRID, slab: float = SLAB, scale: float = RADIUS_SCALE) -> DataFrame:
    """frame, tri of defects alone: triangles with a plane that no head in the slab covers anywhere, by an anti-join.

    Only heads are placed, and a pair is done at the first sample that it covers; nothing else of the classification is computed.
    """
    pairs = _in_slab(placed_pairs(triangles, beads.where("flag = 'h'"), candidates), slab)
    heads = pairs.where(reduce(Column.__or__, [F.exists(w, _covers(scale)) for w in _words(grid)]))
    flat = local_frame(point("a"), point("b"), point("c"))["degenerate"]
    return triangles.where(~flat).select("frame", "tri").join(heads.select("frame", "tri"), ["frame", "tri"], "left_anti")
