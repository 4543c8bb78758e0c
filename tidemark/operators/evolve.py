"""Evolution of specs: bounded generations of children bred from a scored population, all symbols at once.

A population is a table (symbol, point, return_pct, icir). In a generation every symbol draws one parent by seed; a
parent's child is its point with one field tuned or, where no valid tuning comes out, a template of another family. What
a child is depends on the parent's point and the generation, not on the symbol, so the points to evaluate in a generation are
at most as many as the population has distinct ones, however many symbols there are. A generation is one sweep; what it
scored is written to the shared folder and joins the population.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import specs, sweep
from tidemark.operators.graph import stored

_ANY = "*"


def mutations(spark: SparkSession, parents: list[sweep.Point], templates: list[sweep.Point], salt: str) -> dict[str, sweep.Point]:
    """Each parent's child by the parent's key; a parent without one is left out."""
    table = lambda points: spark.createDataFrame([(p.family, _ANY, dict(p.params), p.key) for p in points], "family string, symbol string, params map<string,double>, key string")
    own = specs.identified(table(parents))
    tuned = specs.tuned(own, salt).select("key", "family", "params")
    swapped = specs.swapped(own.join(tuned, "key", "left_anti"), table(templates), salt).join(own.select(F.col("spec_id").alias("parent_id"), "key"), "parent_id")
    children = tuned.unionByName(swapped.select("key", "family", "params")).collect()  # one for each point of a grid
    return {r["key"]: sweep.point(r["family"], r["params"]) for r in children}


def drawn(population: DataFrame, salt: str) -> DataFrame:
    """(symbol, parent): one member of each symbol's population, each as likely as another, by seed."""
    lot = F.sha2(F.concat_ws("|", F.lit(salt), "symbol", "point"), 256)
    return population.groupBy("symbol").agg(F.min_by("point", lot).alias("parent"))


def top_half(population: DataFrame, by: list[str]) -> DataFrame:
    """The better half of each symbol's population, at least one; nulls last, ties by point."""
    w = W.partitionBy("symbol")
    order = w.orderBy(*[F.col(c).desc_nulls_last() for c in by], "point")
    placed = population.withColumns({"_place": F.row_number().over(order), "_n": F.count("*").over(w)})
    return placed.where(F.col("_place") <= F.greatest(F.floor(F.col("_n") / 2), F.lit(1))).drop("_place", "_n")


def evolve(bars: DataFrame, grid: DataFrame, points: list[sweep.Point], salt: str, generations: int, rank: list[str] | None = None, horizon: int | None = None) -> DataFrame:
    """The population after the given generations, with born: 0 for the grid's members, else the generation.

    grid is the scored population (symbol, point, return_pct and, for a rank by it, icir) of points. Parents come from all
    of the population or, with a rank (columns, the first first), from its better half. A child that its symbol's population
    has already adds nothing; one that has too few bars is not kept.
    """
    spark = bars.sparkSession
    columns = ["symbol", "point", "return_pct", *(["icir"] if horizon else [])]
    population = grid.select(*columns, F.lit(0).alias("born"))
    known = {p.key: p for p in points}
    for g in range(1, generations + 1):
        own = f"{salt}|{g}"
        parents = stored(drawn(top_half(population, rank) if rank else population, own), "parents")
        drawn_points = [known[r["parent"]] for r in parents.select("parent").distinct().orderBy("parent").collect()]  # points, not symbols
        children = mutations(spark, drawn_points, points, own)
        if not children:
            continue
        known.update({c.key: c for c in children.values()})
        pairs = spark.createDataFrame([(k, c.key) for k, c in children.items()], "parent string, point string")
        wanted = parents.join(F.broadcast(pairs), "parent").select("symbol", "point").join(population, ["symbol", "point"], "left_anti")  # a pair for each point drawn
        scored = sweep.outcomes(bars, list({c.key: c for c in children.values()}.values()), stored(wanted, "wanted"), horizon)
        population = population.unionByName(stored(scored.select(*columns, F.lit(g).alias("born")), "generation"))
    return population


def evolution_trials(population: DataFrame) -> DataFrame:
    """(symbol, enabled_return_pct, disabled_return_pct, point): the best of the population against the best of its grid."""
    best = F.max_by("point", F.struct("return_pct", F.col("born") == 0, "point"))
    return population.groupBy("symbol").agg(F.max("return_pct").alias("enabled_return_pct"), F.max(F.when(F.col("born") == 0, F.col("return_pct"))).alias("disabled_return_pct"), best.alias("point"))


def parent_trials(by_icir: DataFrame, by_return: DataFrame) -> DataFrame:
    """(symbol, enabled_return_pct, disabled_return_pct): the best child bred from parents ranked by icir against that from
    parents ranked by return; symbols for which an arm has no child have no row."""
    best = lambda p, name: p.where("born > 0").groupBy("symbol").agg(F.max("return_pct").alias(name))
    return best(by_icir, "enabled_return_pct").join(best(by_return, "disabled_return_pct"), "symbol")


def registered(trials: DataFrame, component: str) -> DataFrame:
    """Trials as rows for ablation.registry."""
    none = F.lit(None).cast("double")
    return trials.select(F.lit(component).alias("component"), F.lit(1).alias("version"), "symbol", "enabled_return_pct", "disabled_return_pct", none.alias("enabled_sharpe"), none.alias("disabled_sharpe"))
