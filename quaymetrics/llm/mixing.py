"""Mixing sources to target weights by entropy balancing.

A document's rate is how often the mix takes it. Rates minimise the relative entropy to taking every document once, under
one token constraint a source (its rates times sizes add up to its target) and the bound `cap` a document. The solution is
an exponentially tilted rate min(cap, exp(lambda * x)), x being the size over the source's mean size. The dual is convex and
falls apart by source; safeguarded Newton steps solve it, each one aggregation over the table of (source, size) cells,
which holds all documents without loss. Rates are rounded into whole copies by systematic rounding along falling sizes,
and the rest of a source, less than a document, goes to the cell of the nearest size.

All sums that decide are exact decimals and ties are broken by a hash of doc_id, so reruns agree.

Defined cases: null and blank texts have size 0, rate 1 and take no words; a null source is a source of its own, last in
order; rows equal in doc_id and text are rows of their own; an empty table gives an empty mix; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymetrics.llm.common import stage, unstage, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
#: Newton steps at most; a bracket that each step narrows keeps the solution right at any number.
STEPS = 60
CLOSE = 1e-9
#: Parts that a cell's documents are numbered in, so that a cell with a third of all rows is no single sort.
PARTS = 4096


def _tilted(cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("x"), F.lit(50.0))))


def _exact(value: Column) -> Column:
    """A sum that does not depend on the order of rows."""
    return F.sum(value.cast("decimal(38,9)")).cast("double")


def source_targets(cells: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per source: its size, mean and least size, and its target: weighted shares, held at cap times the source's size.

    One row a source goes through two ordered sums; documents do not.
    """
    sums = cells.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"),
    )
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    listed = F.array(*[F.lit(float(w)) for w in weights])
    full = (
        sums.withColumn("weight", F.get(listed, (place % len(weights)).cast("int")))
        .withColumn("most", F.col("source_size") * float(cap))
        .withColumn("fills_at", F.col("most") / F.col("weight"))
    )
    # sources fill up in the order of fills_at; the first one that a level leaves below its bound ends the filling
    order = Window.orderBy("fills_at", F.col("source").isNull(), "source")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    wanted = F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = full.withColumn("level", wanted / F.sum("weight").over(rest))
    final = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "level"))).over(every)["level"]
    return level.withColumn("target", F.least("most", F.coalesce(final * F.col("weight"), F.col("most")))).select(
        "source", "source_size", "docs", "least", "most", "target"
    )


def _solved(cells: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """targets with lam, the multiplier of each source."""
    mean = F.col("source_size") / F.col("docs")
    least_x = F.col("least") / mean
    # between these two multipliers the constraint is met: all rates at the bound, or below target at the least size
    above = F.when(F.col("target") > F.col("source_size"), F.log(F.lit(float(cap))) / least_x).otherwise(0.0)
    below = F.when(F.col("target") < F.col("source_size"), F.log(F.col("target") / F.col("source_size")) / least_x).otherwise(0.0)
    # nothing to solve: no words, nothing wanted, or everything at the bound
    fixed = (
        F.when(F.col("source_size") == 0, 0.0).when(F.col("target") <= 0, -1e9)
        .when(F.col("target") >= F.col("most") * (1 - 1e-12), above)
    )
    state = stage(
        targets.withColumn("mean", F.greatest(mean, F.lit(1e-9)))
        .withColumn("done", fixed.isNotNull()).withColumn("lo", F.coalesce(fixed, below))
        .withColumn("hi", F.coalesce(fixed, above)).withColumn("lam", F.coalesce(fixed, F.lit(0.0))),
        "mix-state",
    )
    rate = _tilted(cap)
    for _ in range(STEPS):
        if state.where(~F.col("done")).isEmpty():
            break
        open_ = state.where(~F.col("done"))
        terms = (
            cells.where("size > 0").join(open_, cells["source"].eqNullSafe(open_["source"]))
            .select(open_["source"], "lam", "n", "size", (F.col("size") / F.col("mean")).alias("x"))
            .withColumn("words", F.col("n") * F.col("size") * rate)
        )
        slope = F.when(rate < cap, F.col("words") * F.col("x")).otherwise(0.0)
        sums = terms.groupBy("source").agg(_exact(F.col("words")).alias("words"), _exact(slope).alias("slope"))
        gap = F.col("words") - F.col("target")
        met = F.abs(gap) <= F.col("target") * CLOSE
        newton = F.col("lam") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        inside = (newton > F.col("lo2")) & (newton < F.col("hi2"))
        middle = (F.col("lo2") + F.col("hi2")) / 2
        moved = (
            open_.join(sums, open_["source"].eqNullSafe(sums["source"])).drop(sums["source"])
            .withColumn("lo2", F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")))
            .withColumn("hi2", F.when(gap > 0, F.col("lam")).otherwise(F.col("hi")))
            .withColumn("next", F.when(met, F.col("lam")).when(inside, newton).otherwise(middle))
            .withColumn("done", met | (F.col("next") == F.col("lam")))
            .select(*targets.columns, "mean", "done", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), F.col("next").alias("lam"))
        )
        after = stage(state.where("done").unionByName(moved), "mix-state")
        unstage(state)
        state = after
    return state


def _cell_copies(cells: DataFrame, solved: DataFrame, cap: float) -> DataFrame:
    """cells with their source's size and target, and the copies that the cell's documents share."""
    rated = (
        cells.join(solved, cells["source"].eqNullSafe(solved["source"])).drop(solved["source"])
        .withColumn("x", F.col("size") / F.col("mean")).withColumn("rate", _tilted(cap))
    )
    falling = Window.partitionBy("source").orderBy(F.col("size").desc())
    upto = F.sum(F.col("n") * F.col("rate")).over(falling)
    before = F.coalesce(F.lag("upto").over(falling), F.lit(0.0))
    rounded = rated.withColumn("upto", upto).withColumn("copies", (F.floor(F.col("upto") + 0.5) - F.floor(before + 0.5)))
    # never beyond the bound, which sums of doubles might miss by a hair
    held = rounded.withColumn("copies", F.least(F.greatest("copies", F.lit(0)), (F.col("n") * cap).cast("long")))
    missing = F.round(F.col("target") - F.sum(F.col("copies") * F.col("size")).over(Window.partitionBy("source")))
    room = F.when(F.col("missing") > 0, F.col("copies") < F.col("n") * cap).otherwise(F.col("copies") > 0)
    off = F.abs(F.abs(F.col("missing")) - F.col("size"))
    better = room & (off < F.abs(F.col("missing")))
    nearest = F.min(F.when(better, F.struct(off.alias("off"), "size"))).over(Window.partitionBy("source"))["size"]
    return (
        held.withColumn("missing", missing).withColumn("nearest", nearest)
        .withColumn("copies", F.col("copies") + F.when(F.col("size") == F.col("nearest"), F.signum("missing").cast("long")).otherwise(0))
        .select("source", "size", "n", "copies", "source_size", "target")
    )


def mix(
    docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Per row of docs: id, digest (of the text), size, source_size, target and copies, the times the mix takes it.

    `carry` names columns of docs to pass on; of rows equal in id and text they decide which one comes first.
    """
    sized = stage(
        docs.select(
            F.col("doc_id").alias("id"), F.xxhash64("text").alias("digest"), F.col("source").cast("string").alias("source"),
            F.size(words(F.col("text"))).cast("long").alias("size"), *carry,
        ),
        "mix-sizes",
    )
    cells = stage(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-cells")
    solved = _solved(cells, source_targets(cells, weights, share, cap), cap)
    shared = _cell_copies(cells, solved, cap)
    # number the documents of a cell part by part: rows of earlier parts plus the place within the part
    placed = sized.withColumn("spread", F.xxhash64("id", "digest")).withColumn("part", F.pmod("spread", F.lit(PARTS)))
    parts = placed.groupBy("source", "size", "part").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("earlier", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    cell = parts["source"].eqNullSafe(shared["source"]) & (parts["size"] == shared["size"])
    parts = parts.join(shared, cell).select(parts["source"], parts["size"], "part", "earlier", "n", "copies", "source_size", "target")
    same = placed["source"].eqNullSafe(parts["source"]) & (placed["size"] == parts["size"]) & (placed["part"] == parts["part"])
    within = Window.partitionBy("source", "size", "part").orderBy("spread", "id", *carry)
    at = F.col("earlier") + F.row_number().over(within) - 1
    upto = lambda k: F.floor(k.cast("double") * F.col("copies") / F.col("n"))
    return (
        placed.join(parts, same).drop(parts["source"], parts["size"], parts["part"])
        .withColumn("at", at)
        .select("id", "digest", *carry, "size", "source_size", "target", (upto(F.col("at") + 1) - upto(F.col("at"))).alias("copies"))
    )


def mix_report(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per row: doc_id, size, source_size, target (of its source), taken (words the mix takes, repeats counted), copies."""
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mix(docs, weights, share, cap).select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken, "copies")


def apply_mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """docs as often as the mix takes them, with copy (1, 2, ...), in place of a column of that name.

    Rows are told apart by a number that they are staged with, so that rows equal in all columns have copies of their own.
    """
    staged = stage(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("_tag")), "mix-documents")
    needed = staged.select("row.doc_id", "row.text", "row.source", "_tag")
    copies = mix(needed, weights, share, cap, carry=("_tag",)).where("copies > 0").select("_tag", "copies")
    repeated = staged.join(copies, "_tag").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return repeated.select(F.col("row").withField("copy", F.col("copy")).alias("row")).select("row.*")
