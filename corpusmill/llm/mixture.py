"""Problem 4: mix sources to target weights.

Entropy balancing: the rates w of a build's shards are the closest to 1 (in
relative entropy) that meet, for each source s, the token constraint
``sum(x * w) = T`` with ``0 <= w <= R`` (x tokens of a shard, T the budget, R
the most repeats). The dual is convex with one multiplier for each build and
source, and its solution tilts each rate exponentially,
``w = min(R, exp(lambda * x / mean x))``. The multipliers are found by Newton
iterations, all builds at once; an iteration is one aggregation over the
shards, summed in parts before its shuffle. Where the constraint stays below T
even at the upper end of the bracket, where all rates are at the cap, the dual
has no root: the source falls short and is used R times. Rates are rounded to
whole copies systematically, so that the copies of a source differ from the sum
of its rates by less than one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.sources.tables import cut

#: Newton iterations at most; a bracket is kept, and an iterate outside it is replaced by its middle.
ITERATIONS = 40
#: Relative difference from the token target at which a source is done.
CLOSE = 1e-6
#: Iterations between two cuts of the lineage.
CUT_EVERY = 6
#: Type of token sums.
WIDE = "decimal(28,0)"
#: Largest exponent: exp of more is no finite number.
BIG = 700.0
#: Parts of a source's shards in the rounding, so that no source is summed in one task.
PARTS = 64


def spelled(c):
    """One spelling of a source name: without letter case, spaces, underscores and hyphens."""
    return F.regexp_replace(F.lower(c), r"[\s_\-\x{a0}]+", "")


class Mixture:
    """The mix of every build of ``index`` by ``config``.

    ``index``: build_id, source, shard, train_tokens, written_at; of one
    (build, source, shard) the row latest written is valid, of equally late ones
    that with the most tokens; null and negative tokens count as 0. ``config``:
    name, token_budget, max_repeats (null or negative: 0); of repeated names the
    one with the greatest budget counts. Rows of sources that ``config`` doesn't
    name, or without a build or source, take no part. Empty tables give empty
    results; extra columns are ignored.
    """

    def __init__(self, index: DataFrame, config: DataFrame):
        sources = (
            config.where("name IS NOT NULL").groupBy(spelled(F.col("name")).alias("key"))
            .agg(F.max(F.struct(F.coalesce("token_budget", F.lit(0)).alias("t"), F.coalesce("max_repeats", F.lit(0)).alias("r"), "name")).alias("x"))
            .select("key", F.col("x.name").alias("name"), F.greatest(F.lit(0), F.col("x.t")).cast("bigint").alias("target"), F.greatest(F.lit(0), F.col("x.r")).cast("bigint").alias("most"))
        )
        valid = (
            index.where("build_id IS NOT NULL AND source IS NOT NULL")
            .groupBy("build_id", spelled(F.col("source")).alias("key"), "shard")
            .agg(F.max(F.struct("written_at", F.greatest(F.lit(0), F.coalesce("train_tokens", F.lit(0))).cast("bigint").alias("x"))).alias("v"))
        )
        self.shards = cut(valid.join(sources, "key").select("build_id", F.col("name").alias("source"), "shard", F.col("v.x").alias("x"), "target", "most"))

    def setup(self) -> DataFrame:
        """Each build's sources: shards, tokens, target, most repeats. Sums are decimal, so that no number of tokens overflows."""
        x = F.col("x").cast(WIDE)
        return self.shards.groupBy("build_id", "source").agg(F.count("*").alias("shards"), F.sum(x).cast(WIDE).alias("tokens"), F.min(F.when(F.col("x") > 0, F.col("x"))).alias("xmin"), F.count_if(F.col("x") > 0).alias("full"), F.max("target").alias("target"), F.max("most").alias("most"))

    def _tilted(self, m) -> tuple:
        """The rate at a multiplier, and whether it is below the cap."""
        tilt = F.exp(F.least(F.lit(BIG), m * F.col("x") / F.col("mean")))
        most = F.col("most").cast("double")
        return F.least(most, tilt), tilt < most

    def bracket(self) -> DataFrame:
        """Of every build and source with a target: a bracket ``lo``, ``hi`` of the dual's multiplier, a start ``m``, and ``rootless``.

        At ``hi`` every rate is at the cap; a source whose constraint is not
        met there has no root. Where the two differ by less than rounding may
        do, the exact comparison of whole numbers decides.
        """
        tokens = F.col("tokens").cast("double")
        mean = F.when(F.col("full") > 0, tokens / F.col("full"))
        ratio = F.when(tokens > 0, F.col("target") / tokens)
        reach = F.log(F.col("most").cast("double")) * mean / F.col("xmin")
        open_ = self.setup().where("target > 0").select(
            "build_id", "source", "target", "most", mean.alias("mean"), F.log(ratio).alias("m"), F.least(F.lit(0.0), F.log(ratio) * mean / F.col("xmin")).alias("lo"), F.greatest(F.lit(0.0), reach).alias("hi"),
            (F.col("tokens") * F.col("most").cast("decimal(10,0)") < F.col("target").cast(WIDE)).alias("less"),
        )
        at_cap = self.shards.where("x > 0").select("build_id", "source", F.col("x").cast("double").alias("x")).join(open_.select("build_id", "source", "most", "mean", "hi"), ["build_id", "source"])
        at_cap = at_cap.groupBy("build_id", "source").agg(F.sum(F.col("x") * self._tilted(F.col("hi"))[0]).alias("g"))
        over = F.coalesce("g", F.lit(0.0)) / F.col("target") - 1
        rootless = F.when(F.abs(over) < CLOSE, F.col("less")).otherwise(over < 0)
        return open_.join(at_cap, ["build_id", "source"], "left").withColumn("rootless", rootless).drop("g", "less")

    def multipliers(self) -> DataFrame:
        """build_id, source, ``rootless``, the dual's solution ``m`` (with ``mean``) and whether it is ``converged``; of every source with a target.

        Where the dual has no root, ``m`` and ``converged`` are null.
        """
        start = cut(self.bracket())
        state = start.where("NOT rootless").drop("rootless").withColumn("m", F.greatest("lo", F.least("hi", "m"))).withColumn("off", F.lit(math.inf))
        shards = self.shards.where("x > 0").select("build_id", "source", F.col("x").cast("double").alias("x"))  # squares of token counts pass 64 bits
        for k in range(1, ITERATIONS + 1):
            w, free = self._tilted(F.col("m"))
            # state stands in the plan once, so that it grows by one join an iteration
            sums = shards.join(state, ["build_id", "source"]).groupBy(*state.columns).agg(
                F.sum(F.col("x") * w).alias("g"), F.sum(F.when(free, F.col("x") * (F.col("x") / F.col("mean")) * w).otherwise(0.0)).alias("h"))
            err = F.col("g") - F.col("target")
            lo, hi = F.when(err < 0, F.col("m")).otherwise(F.col("lo")), F.when(err > 0, F.col("m")).otherwise(F.col("hi"))
            # Newton on the logarithm of the constraint, which is nearly a line in m
            step = F.col("m") - F.log(F.col("g") / F.col("target")) * F.col("g") / F.when(F.col("h") > 0, F.col("h"))
            inside = F.when((step > lo) & (step < hi), step).otherwise((lo + hi) / 2)
            off = F.abs(err) / F.col("target")
            state = sums.select("build_id", "source", "target", "most", "mean", F.when(off <= CLOSE, F.col("m")).otherwise(inside).alias("m"), lo.alias("lo"), hi.alias("hi"), off.alias("off"))
            if k % CUT_EVERY == 0:
                state = cut(state)
                if state.where(F.col("off") > CLOSE).isEmpty():
                    break
        solved = state.select("build_id", "source", "m", (F.col("off") <= CLOSE).alias("converged"))
        return start.select("build_id", "source", "rootless", "mean").join(solved, ["build_id", "source"], "left")

    def copies(self) -> DataFrame:
        """build_id, source, shard, tokens, rate, copies of every valid shard; ``converged``, whether the rate solves the dual, null where it has no root; ``rootless``."""
        m = self.multipliers()
        rate = F.when(F.col("rootless"), F.col("most").cast("double")).when((F.col("x") > 0) & F.col("m").isNotNull(), self._tilted(F.col("m"))[0]).otherwise(F.lit(0.0))
        rated = self.shards.join(m, ["build_id", "source"], "left").withColumn("rate", rate)
        part = F.pmod(F.xxhash64("build_id", "source", "shard"), F.lit(PARTS))
        rated = rated.select("build_id", "source", "shard", "x", "rate", "converged", F.coalesce("rootless", F.lit(False)).alias("rootless"), part.alias("part"))
        # systematic rounding: a copy for each whole number that the running sum of rates passes, sums in two levels
        sums = rated.groupBy("build_id", "source", "part").agg(F.sum(F.round("rate", 9)).alias("s"))
        before = F.coalesce(F.sum("s").over(Window.partitionBy("build_id", "source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        here = F.sum(F.round("rate", 9)).over(Window.partitionBy("build_id", "source", "part").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
        run = rated.withColumn("here", here).join(sums.select("build_id", "source", "part", before.alias("before")), ["build_id", "source", "part"])
        to = F.round(F.col("before") + F.col("here"), 6)
        since = F.round(F.col("before") + F.col("here") - F.round("rate", 9), 6)
        return run.select("build_id", "source", "shard", F.col("x").alias("tokens"), "rate", (F.floor(to + 0.5) - F.floor(since + 0.5)).cast("int").alias("copies"), "converged", "rootless")

    def report(self) -> DataFrame:
        """Of each build and source: tokens there are, target share, repeats, tokens mixed, real share, whether it falls short, whether its rates converged.

        ``repeats`` is the mixed tokens (by rate) in multiples of those there
        are, 0 for a source without tokens; ``real_share`` is of the whole
        copies, of all sources of the build. ``falls_short``: the dual has no
        root. ``converged`` is null where that, or a target of 0, leaves nothing
        to solve, and false where the iterations ended before the rates met the
        target.
        """
        mixed = self.copies().groupBy("build_id", "source").agg(
            F.sum(F.col("tokens") * F.col("rate")).alias("rated"), F.sum(F.col("tokens").cast(WIDE) * F.col("copies")).cast(WIDE).alias("mixed"), F.min("converged").alias("converged"), F.max("rootless").alias("falls_short"))
        of = Window.partitionBy("build_id")
        share = lambda c: F.col(c) / F.greatest(F.lit(1.0), F.sum(F.col(c).cast("double")).over(of))
        return self.setup().join(mixed, ["build_id", "source"]).select(
            "build_id", "source", F.col("tokens").alias("train_tokens"), F.col("target").alias("token_budget"), share("target").alias("target_share"),
            F.when(F.col("tokens") > 0, F.col("rated") / F.col("tokens").cast("double")).otherwise(F.lit(0.0)).alias("repeats"),
            F.col("mixed").alias("mixed_tokens"), share("mixed").alias("real_share"), "falls_short", "converged",
        )

    def short(self) -> DataFrame:
        """build_id, source of the sources of the solved mix whose dual has no root: they have the most repeats and still miss their target."""
        return self.report().where("falls_short").select("build_id", "source")
