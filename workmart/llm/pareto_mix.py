"""Mixing sources to target weights by Pareto order sampling.

Every source has a target, in words. A document's expected number of copies grows with its utility, at most
`most_copies`, so that the expected words of its source are the target. The whole part of that number is given for
certain. For the rest λ, documents are ranked by the random odds U / (1 - U) over their inclusion odds λ / (1 - λ), and
the first ones are taken: a sample of fixed size with unequal probabilities. The size is fixed in words, and not only
for the source but for each of its size classes (powers of two), so that one long document can't spoil it; what a class
misses or has too much is passed to the next smaller class.

Nothing is ordered as a whole. Ranks are cut into cells; sums of cells find the cell in which a class's sample ends, and
only this cell's documents are ordered. So a source with a third of all documents is as many tasks as it has cells.
One row for each source is brought to the driver, nothing else.

Results for odd inputs: a null source is a source of its own, after all others; a null or empty text has size 0 and is
never taken; a null, negative or zero utility is the least one. Rows are sampled each for itself: repeated rows and
repeated ids may be taken differently. U comes from the id and the text alone, so reruns agree. Extra columns stay.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from workmart.llm.common import cells_for, share_out, store, unit_interval

WEIGHTS = (5.0, 2.0, 1.0)
#: Utilities count as the nearest smaller power of two, from 1 down to the least.
LEAST_UTILITY = 1.0 / 16


def words_of(text: str) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.coalesce(F.size(F.filter(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def source_targets(sizes: list[int], weights: list[float], share: float, most_copies: float) -> list[float]:
    """Targets of the sources, given in their order."""
    return share_out(share * sum(sizes), weights, [most_copies * s for s in sizes])


def _expected(classes: list[tuple[float, int]], target: float, most: float) -> dict[float, float]:
    """Expected copies by utility: in proportion to it, at most `most`, in sum over the words just the target."""
    copies, open_, left = {}, dict(classes), target
    while open_:
        words = sum(u * s for u, s in open_.items())
        rate = left / words if words else 0.0
        full = [u for u in open_ if rate * u > most]
        if not full:
            return copies | {u: rate * u for u in open_}
        for u in full:
            copies[u] = most
            left -= most * open_.pop(u)
    return copies


def mix(df: DataFrame, share: float = 1.5, weights: tuple[float, ...] = WEIGHTS, most_copies: float = 2.0, utility: Column | None = None, text: str = "text", seed: int = 7) -> DataFrame:
    """`df` with size, source_size, target (of its source), copies (0 to `most_copies`) and taken = copies * size."""
    spark = df.sparkSession
    level = F.coalesce(F.pow(F.lit(2.0), F.floor(F.log2(F.when(utility > 0, utility)))), F.lit(0.0)) if utility is not None else F.lit(1.0)
    kept = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(df.columns)]
    size = words_of(text)
    slim = df.select(*kept, size.alias("_size"), F.greatest(F.lit(LEAST_UTILITY), F.least(F.lit(1.0), level)).alias("_utility"), F.col("source").alias("_source"),
                     unit_interval(*[F.col(c).cast("string") for c in ("doc_id", "source", text)], seed=seed).alias("_u"))
    sums = slim.groupBy("_source", "_utility").agg(F.sum("_size").alias("words"), F.count(F.lit(1)).alias("rows")).collect()
    by: dict[str | None, list[tuple[float, int]]] = {}
    for r in sums:
        by.setdefault(r["_source"], []).append((r["_utility"], r["words"]))
    order = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
    sizes = [sum(w for _, w in by[s]) for s in order]
    targets = source_targets(sizes, [weights[i % len(weights)] for i in range(len(order))], share, most_copies)
    rows = [(s, u, z, t, c) for s, z, t in zip(order, sizes, targets) for u, c in _expected(by[s], t, most_copies).items()]
    plan = store(spark.createDataFrame(rows, "_ps string, _pu double, source_size long, target double, _expected double").coalesce(1))  # as a table its size is known
    cells = cells_for(sum(r["rows"] for r in sums))

    # a rest of λ has the inclusion odds λ / (1 - λ); rank: odds ratio brought to (0, 1)
    known = slim.join(plan, F.col("_source").eqNullSafe(F.col("_ps")) & (F.col("_utility") == F.col("_pu")), "left").drop("_ps", "_pu", "_utility")
    known = known.withColumn("_whole", F.floor("_expected")).withColumn("_rest", F.col("_expected") - F.col("_whole"))
    ratio = (F.col("_u") / (1 - F.col("_u"))) * (1 - F.col("_rest")) / F.greatest(F.col("_rest"), F.lit(1e-300))
    known = known.withColumn("_rank", F.when(ratio < 1e15, ratio / (1 + ratio)).otherwise(1.0)).withColumn("_class", F.when(F.col("_size") > 0, F.floor(F.log2("_size"))).otherwise(-1).cast("int"))
    known = known.withColumn("_cell", F.least(F.floor(F.col("_rank") * cells), F.lit(cells - 1)).cast("int"))
    limits = _limits(known.filter((F.col("_size") > 0) & (F.col("_rest") > 0)), cells)
    placed = known.join(limits, F.col("_source").eqNullSafe(F.col("_ls")) & (F.col("_class") == F.col("_lc")), "left")
    copies = F.when(F.col("_size") == 0, 0).otherwise(F.col("_whole") + F.when((F.col("_rest") > 0) & (F.struct("_rank", "_size", "_u") <= F.col("_last")), 1).otherwise(0)).cast("long")
    return placed.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(df.columns) if c not in ("size", "source_size", "target", "copies", "taken")],
                         F.col("_size").alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col("_size")).alias("taken"))


_LIMIT = T.StructType([T.StructField("_ls", T.StringType()), T.StructField("_lc", T.IntegerType()),
                       T.StructField("_last", T.StructType([T.StructField("_rank", T.DoubleType()), T.StructField("_size", T.LongType()), T.StructField("_u", T.DoubleType())]))])


def _limits(known: DataFrame, cells: int) -> DataFrame:
    """The last rank that is taken, by source and size class."""
    sums = known.groupBy("_source", "_class", "_cell").agg(F.sum("_size").alias("words"), F.sum(F.col("_size") * F.col("_rest")).alias("wanted"))
    stratum = W.partitionBy("_source", "_class")
    before = F.coalesce(F.sum("words").over(stratum.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("_source", "_class", "_cell", "words", before.alias("before"), F.sum("wanted").over(stratum).alias("goal"))
    # the goal moves by what larger classes left: less than the largest document of the class above, so less than 4 times a smallest one here
    reach = F.pow(F.lit(2.0), F.col("_class") + 2)
    near = sums.filter((F.col("before") <= F.col("goal") + reach) & (F.col("before") + F.col("words") >= F.col("goal") - reach))
    inside = known.select("_source", "_class", "_cell", "_rank", "_size", "_u").join(near.select(F.col("_source").alias("_ns"), F.col("_class").alias("_nc"), F.col("_cell").alias("_ncell"), "before", "goal"),
                        F.col("_source").eqNullSafe(F.col("_ns")) & (F.col("_class") == F.col("_nc")) & (F.col("_cell") == F.col("_ncell")))
    cell = W.partitionBy("_source", "_class", "_cell").orderBy("_rank", "_size", "_u")
    inside = inside.withColumn("upto", F.col("before") + F.sum("_size").over(cell.rowsBetween(W.unboundedPreceding, 0)))
    inside = inside.filter((F.col("upto") >= F.col("goal") - 2 * reach) & (F.col("upto") - F.col("_size") <= F.col("goal") + 2 * reach))
    # a handful of rows for each source and class
    steps = inside.groupBy("_source").agg(F.sort_array(F.collect_list(F.struct("_class", "goal", "upto", "_rank", "_size", "_u"))).alias("steps"))

    def walk(batches):
        for pdf in batches:
            found = []
            for source, steps in zip(pdf["_source"], pdf["steps"]):
                found += [(None if source is None else source, c, last) for c, last in last_taken(steps)]
            yield pd.DataFrame({"_ls": pd.Series([f[0] for f in found], dtype=object), "_lc": pd.Series([f[1] for f in found], dtype="int32"), "_last": pd.Series([f[2] for f in found], dtype=object)})

    return store(steps.mapInPandas(walk, _LIMIT))


def last_taken(steps) -> list[tuple[int, dict]]:
    """steps: (class, goal, words up to and with this document, rank...) about each class's goal, sorted. From the largest class
    down, the end that is nearest to the goal with what larger classes left; of two, the earlier."""
    found, left = [], 0.0
    for c in sorted({s["_class"] for s in steps}, reverse=True):
        own = [s for s in steps if s["_class"] == c]
        goal = own[0]["goal"] + left
        best, gap = None, abs(own[0]["upto"] - own[0]["_size"] - goal)
        reached = own[0]["upto"] - own[0]["_size"]
        first = {"_rank": own[0]["_rank"], "_size": own[0]["_size"], "_u": -1.0}  # just before the first one at hand
        for s in own:
            if abs(s["upto"] - goal) < gap:
                best, gap, reached = s, abs(s["upto"] - goal), s["upto"]
        found.append((c, {k: best[k] for k in ("_rank", "_size", "_u")} if best is not None else first))
        left = goal - reached
    return found
