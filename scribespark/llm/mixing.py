"""Operator 8: mixing sources to target weights by Pareto order sampling.

A source's target is its share of all words by weight, at most ``max_copies`` times its words; what is
cut off is shared out again until no source is above. Within a source longer documents are preferred:
documents fall into bands of length (by powers of two), and a document is expected as often as its
band's preference times one level for the source, ``max_copies`` at most, where the level makes up the
target. The whole part are certain copies, the fraction p is an inclusion probability, unequal from source to
source and from band to band. Documents are ranked by Pareto's order, random odds ``u / (1 - u)`` divided by the inclusion
odds ``p / (1 - p)``, and the first of each source are taken until its words are used up: a sample
of fixed size in words. The last gap goes to the document that fits it best, if that brings the source
nearer to its target.

No source is gathered anywhere: words are summed by (source, slice of the order), the slice in which a
source's words run out is found from these sums, and only the rows of that slice are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribespark.llm.shared import WORD, text_of, written
from scribespark.operators.order import numbered

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: Slices of the order in which sums are taken.
SLICES = 1 << 16
#: Bands of length: sizes are below 2 ** BANDS.
BANDS = 32
#: How much more often a document is expected for each doubling of its length, of what an empty one is.
PREFERENCE = 0.1
#: Rows of sources and bands up to which their table is broadcast; beyond, it is joined by shuffles that AQE can split.
BROADCAST_ROWS = 50_000


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def band_of(size: Column) -> Column:
    return F.least(F.floor(F.log2(size + 1)), F.lit(BANDS - 1)).cast("int")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> tuple[DataFrame, int]:
    """source, source_size, target of each source, and how many there are.

    Sources are weighed in code-point order, null last, the weights repeating. The level at which
    sources that are not capped stand is found by sharing out anew, each time over one sum.
    """
    stats = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("_at") % len(weights) + 1).cast("int"))
    stats = numbered(stats.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "_at")
    stats = written(stats.select("source", "source_size", weight.alias("weight")), "sources")
    cap = F.col("source_size") * max_copies
    total, weight_sum, n = stats.agg(F.sum("source_size"), F.sum("weight"), F.count("*")).first()
    level, capped = (total / weight_sum if n else 0.0), -1
    while n:
        full = cap <= F.lit(level) * F.col("weight")
        used, free, count = stats.agg(F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight"))), F.count_if(full)).first()
        if count == capped or not free:
            break
        capped, level = count, (total - used) / free
    target = F.least(cap.cast("double"), F.lit(float(level)) * F.col("weight"))
    return stats.select("source", "source_size", target.alias("target")), n


def drawn(docs: DataFrame, seed: int, id_col: str, source_col: str, text_col: str, *more: Column) -> DataFrame:
    """doc_id, source, size, draw (a random 64-bit number, the same on every run) and place of each document.

    Rows of one id and text share their draw; the place, where a row stands in the table's partitions, tells them apart.
    """
    text = text_of(text_col)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        words(text).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), text).alias("draw"),
        F.monotonically_increasing_id().alias("place"),
        *more,
    )


def expected(sizes: DataFrame, targets: DataFrame, max_copies: int, preference: float) -> DataFrame:
    """source, band, source_size, target, certain and p of each band of each source; rest, the words that p stands for.

    The bands that ``max_copies`` caps are those of the greatest preference: running sums from there give the level
    for each number of capped bands, and the first at which the next band is not above holds.
    """
    bands = sizes.groupBy("source", band_of(F.col("size")).alias("band")).agg(F.sum("size").alias("words"))
    own = targets.select(F.col("source").alias("s"), "source_size", "target")
    rows = bands.join(own, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("w", 1 + preference * F.col("band"))
    whole = Window.partitionBy("source")
    down = whole.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    capped, used = F.coalesce(F.sum("words").over(down), F.lit(0)), F.coalesce(F.sum(F.col("words") * F.col("w")).over(down), F.lit(0.0))
    level = F.try_divide(F.col("target") - max_copies * capped, F.sum(F.col("words") * F.col("w")).over(whole) - used)
    rows = rows.withColumn("at", F.coalesce(level, F.lit(0.0)))
    # without words there is nothing to take; a source whose every band is capped has no level
    fits = F.when((F.col("at") * F.col("w") <= max_copies) & (F.col("at") >= 0), F.struct(-F.col("band"), F.col("at").alias("at")))
    rows = rows.withColumn("level", F.min(fits).over(whole)["at"])
    often = F.coalesce(F.least(F.lit(float(max_copies)), F.col("level") * F.col("w")), F.lit(float(max_copies)))
    rows = rows.withColumn("often", F.round(often, 9)).withColumn("certain", F.floor("often").cast("long")).withColumn("p", F.col("often") - F.floor("often"))
    return rows.withColumn("rest", F.sum(F.col("p") * F.col("words")).over(whole)).select("source", "band", "source_size", "target", "certain", "p", "rest")


def _ranked(rows: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    """rows with their band's plan and ``rank``: Pareto's order, mapped to 0..1."""
    plan = plan.withColumnsRenamed({"source": "own_source", "band": "own_band"})
    same = F.col("source").eqNullSafe(F.col("own_source")) & (band_of(F.col("size")) == F.col("own_band"))
    rows = rows.join(F.broadcast(plan) if small else plan, same).drop("own_source", "own_band")
    u = (F.shiftrightunsigned("draw", 11) + 0.5) / F.lit(float(1 << 53))
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    return rows.withColumn("rank", F.when(F.col("p") > 0, odds / (1 + odds)).otherwise(1.0))


def allocation(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, preference: float = PREFERENCE) -> tuple[DataFrame, bool]:
    """For each source and band its target, certain copies, p and the cut of the order; whether it may be broadcast.

    ``sizes``: source, size, draw, place of every document (``drawn``), written.
    """
    found, n = targets(sizes, weights, max_copies)
    small = n * BANDS <= BROADCAST_ROWS
    plan = written(expected(sizes, found, max_copies, preference), "expected")
    rows = _ranked(sizes.select("source", "size", "draw", "place"), plan, small).where("p > 0").withColumn("slice", F.floor(F.col("rank") * SLICES).cast("int"))
    rows = rows.select("source", "size", "draw", "place", "rank", "slice", "rest")

    sums = rows.groupBy("source", "slice", "rest").agg(F.sum("size").alias("words"))
    ahead = F.sum("words").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    cross = sums.withColumn("ahead", F.coalesce(ahead, F.lit(0))).where("ahead <= rest")
    cross = written(cross.groupBy("source").agg(F.max_by(F.struct("slice", "ahead"), "slice").alias("x")).select(F.col("source").alias("s"), F.col("x.slice").alias("at"), "x.ahead"), "crossings")
    cross = F.broadcast(cross) if small else cross

    # rows of one draw are repeated rows: one row with their number, of which as many are taken as fit
    edge = rows.join(cross, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("at")))
    draws = edge.groupBy("source", "rest", "ahead", "rank", "draw", "size").agg(F.count("*").alias("n"))
    until = F.col("ahead") + F.sum(F.col("n") * F.col("size")).over(Window.partitionBy("source").orderBy("rank", "draw"))
    draws = draws.withColumn("until", until).withColumn("before", F.col("until") - F.col("n") * F.col("size")).where("before <= rest")
    fits = F.when(F.col("until") <= F.col("rest"), F.col("n")).otherwise(F.floor((F.col("rest") - F.col("before")) / F.greatest("size", F.lit(1))))
    last = draws.groupBy("source").agg(F.max(F.struct("rank", "draw", fits.alias("m"), "n", (F.col("before") + fits * F.col("size")).alias("used"))).alias("last"))
    last = written(last.select(F.col("source").alias("s2"), "last.*"), "last-draws")
    last_places = _places(edge, F.broadcast(last) if small else last)
    last = last.join(last_places, F.col("s2").eqNullSafe(F.col("s3")), "left").select("s2", "rank", "draw", "used", F.when(F.col("m") >= F.col("n"), F.lit((1 << 63) - 1)).otherwise(F.coalesce("cut_place", F.lit(-1))).alias("cut_place"))
    cut = cross.join(last, F.col("s").eqNullSafe(F.col("s2")), "left").select(
        "s", F.coalesce("rank", F.col("at") / SLICES).alias("cut_rank"), F.coalesce("draw", F.lit(-(1 << 63))).alias("cut_draw"), F.coalesce("cut_place", F.lit(-1)).alias("cut_place"), F.coalesce("used", "ahead").alias("used")
    )
    cut = written(cut, "cuts")
    cut = F.broadcast(cut) if small else cut

    gap = F.col("rest") - F.col("used")
    left = rows.join(cut, F.col("source").eqNullSafe(F.col("s"))).where(~_taken()).withColumn("miss", F.abs(F.col("size") - gap)).where(F.col("miss") < gap)
    fit = left.groupBy("source").agg(F.min(F.struct("miss", "rank", "draw", "place")).alias("fit"))
    plan = plan.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = plan.join(fit.select(F.col("source").alias("s"), "fit.draw", "fit.place"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = plan.select("source", "band", "source_size", "target", "certain", "p", "cut_rank", "cut_draw", "cut_place", F.col("draw").alias("fit_draw"), F.col("place").alias("fit_place"))
    return written(plan, "plan"), small


def _places(edge: DataFrame, last: DataFrame) -> DataFrame:
    """s3 and cut_place: the place of the m-th of the n rows of each source's last draw, where m is less than n.

    Rows are counted by partition; only those of the partition with the m-th row are put in order.
    """
    last = last.where("m > 0 and m < n").select("s2", F.col("rank").alias("r2"), F.col("draw").alias("d2"), "m")
    same = F.col("source").eqNullSafe(F.col("s2")) & (F.col("rank") == F.col("r2")) & (F.col("draw") == F.col("d2"))
    rows = edge.join(last, same).select("source", "place", "m", F.shiftright("place", 33).alias("part"))
    parts = rows.groupBy("source", "m", "part").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("part"))
    parts = parts.withColumn("upto", upto).where((F.col("upto") >= F.col("m")) & (F.col("upto") - F.col("n") < F.col("m")))
    parts = parts.select(F.col("source").alias("s3"), F.col("part").alias("in_part"), (F.col("m") - F.col("upto") + F.col("n")).alias("nth"))
    inside = rows.join(parts, F.col("source").eqNullSafe(F.col("s3")) & (F.col("part") == F.col("in_part")))
    numbered_ = inside.withColumn("k", F.row_number().over(Window.partitionBy("s3").orderBy("place")))
    return numbered_.where("k = nth").select("s3", F.col("place").alias("cut_place"))


def _taken() -> Column:
    same = (F.col("rank") == F.col("cut_rank")) & (F.col("draw") == F.col("cut_draw"))
    return (F.col("rank") < F.col("cut_rank")) | ((F.col("rank") == F.col("cut_rank")) & (F.col("draw") < F.col("cut_draw"))) | (same & (F.col("place") <= F.col("cut_place")))


def copies(rows: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    """``rows`` (from ``drawn``) with source_size, target and copies: how often the mix takes each."""
    more = F.when((F.col("p") > 0) & (F.coalesce(_taken(), F.lit(False)) | F.coalesce((F.col("draw") == F.col("fit_draw")) & (F.col("place") == F.col("fit_place")), F.lit(False))), 1).otherwise(0)
    ranked = _ranked(rows, plan, small).withColumn("copies", F.col("certain") + more)
    return ranked.drop("certain", "p", "cut_rank", "cut_draw", "cut_place", "fit_draw", "fit_place", "rank")


def mix(docs: DataFrame, seed: int = 1, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, preference: float = PREFERENCE, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixture: each document with all its columns, as often as it is taken.

    Null texts have no words and no target of their own; null sources are a source, the last. Repeated
    rows (same id and text) share their draw, and as many of them are taken as fit. An empty table gives an empty mixture.
    ``docs`` is read twice; which of several equal rows are taken is settled by where they stand, so it should come from files.
    """
    narrow = written(drawn(docs, seed, id_col, source_col, text_col), "sizes")
    plan, small = allocation(narrow, weights, max_copies, preference)
    whole = F.struct(*(docs[c] for c in docs.columns)).alias("doc")
    taken = copies(drawn(docs, seed, id_col, source_col, text_col, whole), plan, small)
    return taken.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def decide(docs: DataFrame, seed: int = 1, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, preference: float = PREFERENCE, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, copies, taken."""
    narrow = written(drawn(docs, seed, id_col, source_col, text_col), "sizes")
    plan, small = allocation(narrow, weights, max_copies, preference)
    taken = copies(narrow, plan, small)
    return taken.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
