"""Mixing sources to target weights by entropy balancing.

For every source the mix wants ``T`` words out of documents of ``z`` words each. Among all rates ``r`` with
``sum(r * z) = T`` and ``0 <= r <= cap``, entropy balancing takes the one nearest to "each document once" in
Kullback-Leibler divergence. Its solution is an exponential tilt ``r = min(cap, exp(lambda * c))`` where ``c`` is the
document's token feature, and ``lambda`` maximises the concave dual, one number per source. All sources' duals are
solved at once by safeguarded Newton steps over the histogram (source, size), which is far smaller than the corpus.
Rates become whole copies; per source one document at most is cut, so that the words taken meet the target.

Only DataFrame functions are used. Edge cases: a null or empty text has size 0, is kept with ``taken`` 0; a null
source is a source of its own, last in order; repeated rows and null ids are separate documents; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, small, written

#: Fixed values of the contract: weights repeat along the sources, in code point order.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0
#: Ranges of names that sources are numbered by.
RANGES = 64
#: Cells per level when the documents at the edge of a source's target are looked for.
CELLS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def _size():
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _u():
    """A uniform number from 0 to 1 that depends on the row alone."""
    return F.xxhash64("doc_id", "source", "text").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, u): words per document, and what its rounding depends on."""
    return docs.select("doc_id", "source", _size().alias("size"), _u().alias("u"))


def targets(histogram: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, mean, target): the budget poured by weight, none above ``cap`` times its size.

    Sources are numbered in code point order by ranges of names: each range is numbered by a task of its own, and the
    ranges' sizes, few numbers, give what to add. The level of the water is found by Newton steps on sums over all
    sources; as the sum is concave in the level, the steps rise to it and end once no further source fills up.
    """
    per = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    ranged = per.repartitionByRange(RANGES, F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id())
    ranged = written(ranged, "mix-sources")
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())
    at = F.row_number().over(inside) - 1 + F.col("before")
    w = F.element_at(F.array(*map(F.lit, weights)), (at % len(weights) + 1).cast("int"))
    x = ranged.join(F.broadcast(before), "range").withColumn("w", w).withColumn("top", cap * F.col("source_size"))
    x = written(x, "mix-weights")
    budget, level = share * (x.agg(F.sum("source_size")).first()[0] or 0), 0.0
    while True:
        open_ = F.col("top") > F.col("w") * F.lit(level)
        poured, left = x.agg(F.sum(F.least(F.col("top"), F.col("w") * F.lit(level))), F.sum(F.when(open_, F.col("w")))).first()
        higher = level + (budget - (poured or 0.0)) / left if left else level
        if not higher > level * (1 + 1e-15):
            break
        level = higher
    target = F.least(F.col("top"), F.col("w") * F.lit(level))
    return x.select("source", "source_size", (F.col("source_size") / F.col("docs")).alias("mean"), target.alias("target"))


def _feature():
    """The tilt's feature: from 0 for the shortest documents to 1 for the longest, half at the source's mean."""
    return F.col("size") / (F.col("size") + F.col("mean"))


def _rate(cap: float):
    return F.least(F.lit(cap), F.exp(F.col("lam") * _feature()))


def solve(histogram: DataFrame, target: DataFrame, cap: float = CAP, rounds: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """(source, source_size, mean, target, lam): every source's dual solved by Newton steps kept inside a bracket."""
    state = written(target.withColumns({
        "lam": F.when(F.col("target") >= cap * F.col("source_size"), F.lit(float("inf"))).otherwise(F.log(F.greatest(F.col("target"), F.lit(1e-300)) / F.greatest(F.col("source_size"), F.lit(1)))),
        "lo": F.lit(-700.0), "hi": F.lit(1e7), "done": F.col("target") >= cap * F.col("source_size"),
    }), "mix-state")
    near_enough = state.count() <= BROADCAST_ROWS
    sized_side = F.broadcast if near_enough else (lambda df: df)
    x = state
    for step in range(rounds):
        x = _newton(histogram, x, cap, tolerance, sized_side)
        if step % 3 == 2:
            x = written(x, "mix-state")
            if not x.filter(~F.col("done")).limit(1).count():
                break
    return x.select("source", "source_size", "mean", "target", "lam")


def _newton(histogram: DataFrame, state: DataFrame, cap: float, tolerance: float, sized_side) -> DataFrame:
    """One step for every source that isn't done: the dual's gradient and curvature are sums over the histogram."""
    joined = histogram.filter("size > 0").join(sized_side(_as_s(state.filter(~F.col("done")))), F.col("source").eqNullSafe(F.col("s")))
    mass, rate = F.col("n") * F.col("size"), _rate(cap)
    got = joined.groupBy("s").agg(F.sum(mass * rate).alias("f"), F.sum(F.when(rate < cap, mass * rate * _feature()).otherwise(0.0)).alias("g"))
    x = state.join(sized_side(got), F.col("source").eqNullSafe(F.col("s")), "left")
    x = x.withColumns({
        "lo": F.when(F.col("f") < F.col("target"), F.col("lam")).otherwise(F.col("lo")),
        "hi": F.when(F.col("f") >= F.col("target"), F.col("lam")).otherwise(F.col("hi")),
    })
    step = F.col("lam") + F.try_divide(F.col("target") - F.col("f"), F.col("g"))
    inside = step.isNotNull() & (step > F.col("lo")) & (step < F.col("hi"))
    near = F.col("f").isNull() | (F.abs(F.col("f") - F.col("target")) <= tolerance * F.greatest(F.col("target"), F.lit(1.0)))
    x = x.withColumn("near", F.col("done") | near)
    x = x.withColumn("lam", F.when(F.col("near"), F.col("lam")).when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2))
    return x.select("source", "source_size", "mean", "target", "lam", "lo", "hi", F.col("near").alias("done"))


def plan(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """A row per source that decides every document of it: (source, source_size, mean, target, lam, edge, edge_fine, cut, cut_take).

    ``rows`` come from ``sized``. Whole parts of the rates are always taken. Extra copies for the fractions go to the
    rows with the smallest ``u - fraction`` until the target is met. That edge is found from sums over two levels of
    cells, so that no source is ever sorted in one task; only what lies in one cell in 16 million is put in order.
    Where repeated rows share the place of the cut they share its words, rounded down.
    """
    histogram = written(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-histogram")
    state = written(solve(histogram, targets(histogram, weights, share, cap), cap), "mix-solved")
    x = _rated(rows, state, cap)
    sums = written(x.groupBy("source", "cell").agg(F.sum(F.col("whole") * F.col("size")).alias("sure"), F.sum("size").alias("more")), "mix-cells")
    sure = sums.groupBy("source").agg(F.sum("sure").alias("sure"))
    need = state.select("source", F.round("target").cast("long").alias("goal")).join(small(_as_s(sure)), F.col("source").eqNullSafe(F.col("s"))).select("source", (F.col("goal") - F.col("sure")).alias("need"))
    cells = sums.filter("cell is not null").drop("sure").join(small(_as_s(need)), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    state = _left(state, _edge(cells, "cell").select("source", F.col("cell").alias("edge"), "need"))
    state = written(state, "mix-edges")
    x = _rated(rows, state, cap).filter("cell = edge")
    fines = x.groupBy("source", "fine").agg(F.sum("size").alias("more"), F.min("need").alias("need"))
    state = _left(state.drop("need"), _edge(fines, "fine").select("source", F.col("fine").alias("edge_fine"), "need"))
    state = written(state, "mix-fines")
    x = _rated(rows, state, cap).filter("cell = edge and fine = edge_fine")
    keys = x.groupBy("source", _key()).agg(F.sum("size").alias("more"), F.count("*").alias("equal"), F.min("need").alias("need"))
    cut = _edge(keys, "key").select("source", F.col("key").alias("cut"), F.floor(F.least("need", "more") / F.col("equal")).alias("cut_take"))
    return written(_left(state.drop("need"), cut), "mix-plan")


def apply(rows: DataFrame, by_source: DataFrame, cap: float = CAP) -> DataFrame:
    """``rows`` (with source, doc_id, size, u and any more columns) with source_size, target, rate, copies and taken.

    A function of the row and its source's plan alone: no shuffle. ``copies`` counts whole copies; ``taken`` is
    copies * size, plus the words of a cut copy for the document at the edge of its source's target.
    """
    x = _rated(rows, by_source, cap)
    none, here = F.lit(0).cast("long"), F.col("cell") == F.col("edge")
    extra = F.when((F.col("cell") < F.col("edge")) | here & (F.col("fine") < F.col("edge_fine")), F.col("size"))
    extra = extra.when(here & (F.col("fine") == F.col("edge_fine")), F.when(_key() < F.col("cut"), F.col("size")).when(_key() == F.col("cut"), F.least("size", "cut_take")).otherwise(none)).otherwise(none)
    taken = F.col("whole") * F.col("size") + extra
    x = x.withColumn("taken", taken).withColumn("copies", F.coalesce(F.floor(F.try_divide("taken", "size")), none))
    return x.drop("lam", "mean", "edge", "edge_fine", "cut", "cut_take", "whole", "part", "at", "cell", "fine")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Columns (doc_id, source, size, u, source_size, target, rate, taken, copies), a row per document."""
    rows = written(sized(docs), "mix-sizes")
    return apply(rows, plan(rows, weights, share, cap), cap)


def _as_s(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("source", "s")


def _left(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(small(_as_s(b)), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def _key():
    return F.struct("at", "doc_id", "size").alias("key")


def _rated(rows: DataFrame, state: DataFrame, cap: float) -> DataFrame:
    x = rows.join(small(_as_s(state)), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    x = x.withColumn("rate", F.when(F.col("size") > 0, _rate(cap)).otherwise(0.0))
    x = x.withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole"))
    x = x.withColumn("at", (F.col("u") - F.col("part") + 1) / 2 * CELLS)
    return x.withColumn("cell", F.when(F.col("part") > 0, F.floor("at"))).withColumn("fine", F.floor((F.col("at") - F.floor("at")) * CELLS))


def _edge(cells: DataFrame, cell: str) -> DataFrame:
    """Per source the cell in which the running sum of ``more`` reaches ``need``, with what is still needed there."""
    run = Window.partitionBy("source").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    x = cells.withColumn("before", F.coalesce(F.sum("more").over(run), F.lit(0).cast("long"))).filter(F.col("before") <= F.col("need"))
    x = x.withColumn("last", F.max(cell).over(Window.partitionBy("source"))).filter(F.col(cell) == F.col("last"))
    return x.withColumn("need", F.col("need") - F.col("before")).drop("last", "before")


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``docs`` with every row as often as the mix takes it whole."""
    columns = docs.columns
    by_source = plan(written(sized(docs), "mix-sizes"), weights, share, cap)
    names = {"doc_id", "source", "text", "size", "u"}
    held = docs.select(*(c for c in columns if c in names - {"size", "u"}), F.struct(*columns).alias("_row"))
    x = apply(held.withColumns({"size": _size(), "u": _u()}), by_source, cap)
    return x.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")
