"""A harvest of pages by plan: a ranked frontier, budgets for each source and plan, and one commit a round.

A plan asks its sources in order. In a round, each source offers its best pages that no round has visited, within what is left of its
budget; the plan takes them in its order of sources, within what is left of its own. What the visited pages link to joins the frontier if the
page itself scored well, so that a site is never walked on speculation. A round's visits and offers are one commit of a store, so a harvest
that is broken off goes on with the round that wasn't committed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.sources.atomic import AtomicStore

PAGE = ["plan", "source", "url"]


@dataclass(frozen=True)
class Budget:
    """How many pages a source may give in a round and in all, how many a plan may take, how deep links are followed, and the score that a page needs for its links to count."""

    round: int = 2
    source: int = 3
    plan: int = 6
    depth: int = 2
    least: float = 6.0


class Harvest:
    """``score`` reads the columns url, anchor and depth. ``links`` has (source, page, url, anchor): what each page links to, with hosts that the source may use only."""

    def __init__(self, spark: SparkSession, root: str, links: DataFrame, score: Callable[[Column, Column, Column], Column], budget: Budget = Budget()):
        self.store, self.links, self.score, self.budget = AtomicStore(spark, root), links, score, budget

    def begin(self, entries: DataFrame) -> int:
        """Starts from ``entries`` (plan, position, source, url): where each plan enters each of its sources, in the plan's order."""
        rows = entries.select("plan", "position", "source", "url", F.lit("").alias("anchor"), F.lit(0).alias("depth"))
        return self.store.commit(self.store.append("offers", rows, ["plan", "source"], 32))

    def visited(self) -> DataFrame:
        """(plan, position, source, url, anchor, depth, score, round) of all rounds."""
        return self.store.read("visited", schema="plan long, position long, source long, url string, anchor string, depth int, score double, round int")

    def frontier(self) -> DataFrame:
        """Pages that are offered and not visited, each once: where it is least deep, of the smallest anchor there; with their scores."""
        rows = self.store.read("offers").groupBy(*PAGE).agg(F.min("position").alias("position"), F.min(F.struct("depth", "anchor")).alias("_first"))
        rows = rows.select("plan", "position", "source", "url", "_first.anchor", "_first.depth")
        if "visited" in self.store.tables():
            rows = rows.join(self.visited().select(*PAGE), PAGE, "left_anti")
        return rows.withColumn("score", self.score(F.col("url"), F.col("anchor"), F.col("depth")).cast("double"))

    def picked(self) -> DataFrame:
        """What the next round visits."""
        b, open_ = self.budget, self.frontier()
        best = F.row_number().over(Window.partitionBy("plan", "source").orderBy(F.desc("score"), "url"))
        # The best of a source are found before it is known what is left of its budget: so few rows are kept.
        rows = open_.withColumn("_best", best).where(F.col("_best") <= min(b.round, b.source))
        if "visited" in self.store.tables():
            spent = self.visited().groupBy("plan", "source").agg(F.count("*").alias("_spent"))
            gone = spent.groupBy("plan").agg(F.sum("_spent").alias("_gone"))
            rows = rows.join(spent, ["plan", "source"], "left").join(gone, "plan", "left").fillna(0, ["_spent", "_gone"])
        else:
            rows = rows.withColumns({"_spent": F.lit(0), "_gone": F.lit(0)})
        rows = rows.where(F.col("_best") + F.col("_spent") <= b.source)
        turn = F.row_number().over(Window.partitionBy("plan").orderBy("position", "source", "_best"))
        return rows.withColumn("_turn", turn).where(F.col("_turn") + F.col("_gone") <= b.plan).drop("_best", "_spent", "_gone", "_turn")

    def step(self) -> int:
        """One round; returns how many pages it visits. Nothing is committed where there are none."""
        done = self.store.manifest()["batches"].get("round", 0)
        come = self.store.append("visited", self.picked().withColumn("round", F.lit(done + 1)), ["plan", "source"], 32)
        rows = self.store.staged(come)
        n = rows.count()
        if n:
            good = rows.where((F.col("score") >= self.budget.least) & (F.col("depth") < self.budget.depth)).select("plan", "position", "source", F.col("url").alias("page"), "depth")
            offers = good.join(self.links, ["source", "page"]).select("plan", "position", "source", "url", F.coalesce("anchor", F.lit("")).alias("anchor"), (F.col("depth") + 1).alias("depth")).distinct()
            self.store.commit(come, self.store.append("offers", offers), batch=("round", done + 1))
        return n

    def run(self, rounds: int) -> DataFrame:
        """Rounds until the number is reached or nothing is left to visit."""
        while self.store.manifest()["batches"].get("round", 0) < rounds and self.step():
            pass
        return self.visited()
