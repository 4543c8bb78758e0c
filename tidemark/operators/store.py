"""Queries over the experiment store: latest rows, champions, selection of parents, violations, health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.pit import latest_per


def with_latest(experiments: DataFrame, decisions: DataFrame, results: DataFrame) -> DataFrame:
    """Each experiment with its latest decision and result."""
    last = lambda df, *c: latest_per(df, ["experiment_id"], F.desc("created_at"), F.desc("id")).select(F.col("experiment_id").alias("id"), *c)
    return experiments.join(last(decisions, "decision"), "id", "left").join(last(results, "total_return_pct", "benchmark_return_pct"), "id", "left")


def champions(strategies: DataFrame) -> DataFrame:
    """Best score per family; the sitting champion wins ties, then the smaller id."""
    return latest_per(strategies, ["family"], F.desc_nulls_last("score"), F.desc("is_champion"), F.col("id"))


def demotions(strategies: DataFrame) -> DataFrame:
    return strategies.where("is_champion").join(champions(strategies).select("id"), "id", "left_anti")


def exploitation(strategies: DataFrame, statuses: list[str], n: int) -> DataFrame:
    return strategies.where(F.col("status").isin(statuses)).orderBy(F.desc_nulls_last("icir"), F.desc_nulls_last("score"), "id").limit(n)


def exploration(strategies: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """A sample of n, the same on each run with a seed."""
    return strategies.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "id"))).limit(n)


def diversification(params: DataFrame, n: int) -> DataFrame:
    """(id, family, distance) of the n strategies farthest from their family's centre; params (id, family, param, value).

    Values are scaled to 0..1 within (family, param); families with one strategy are left out.
    """
    w = W.partitionBy("family", "param")
    span = F.max("value").over(w) - F.min("value").over(w)
    scaled = params.withColumn("x", F.when(span > 0, (F.col("value") - F.min("value").over(w)) / span).otherwise(0.0))
    off = scaled.withColumn("d", F.col("x") - F.avg("x").over(w))
    size = params.groupBy("family").agg(F.count_distinct("id").alias("n")).where("n > 1")
    far = off.join(size, "family").groupBy("id", "family").agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("distance"))
    return far.orderBy(F.desc("distance"), "id").limit(n)


def revival(strategies: DataFrame, n: int) -> DataFrame:
    return strategies.where("status in ('DORMANT', 'QUARANTINED')").orderBy("created_at", "id").limit(n)


def breeding_pairs(strategies: DataFrame) -> DataFrame:
    """(family, first, second): the two best of each family that has two."""
    order = W.partitionBy("family").orderBy(F.desc_nulls_last("score"), "id")
    top = strategies.withColumn("k", F.row_number().over(order)).where("k <= 2")
    return top.groupBy("family").agg(F.max(F.when(F.col("k") == 1, F.col("id"))).alias("first"), F.max(F.when(F.col("k") == 2, F.col("id"))).alias("second")).where("second is not null")


def population(strategies: DataFrame, statuses: list[str]) -> DataFrame:
    return strategies.groupBy("family").pivot("status", statuses).count().na.fill(0)


def awaiting_holdout(ledger: DataFrame, verdicts: DataFrame, strategies: DataFrame) -> DataFrame:
    """Discoveries without a verdict whose strategy is promising, the latest per hash."""
    open_ = ledger.where("discovery").select("config_hash").subtract(verdicts.select("config_hash"))
    mine = strategies.where("status = 'PROMISING' and not is_canary").join(open_, "config_hash", "left_semi")
    return latest_per(mine, ["config_hash"], F.desc("created_at"), F.desc("id"))


def failure_modes(decisions: DataFrame) -> DataFrame:
    """(month, reason, n)."""
    rows = decisions.select(F.date_trunc("month", "created_at").alias("month"), F.explode(F.coalesce("reason_codes", F.array().cast("array<string>"))).alias("reason"))
    return rows.groupBy("month", "reason").agg(F.count("*").alias("n"))


def failure_by_change(experiments: DataFrame, decisions: DataFrame, key: str, mode: str) -> DataFrame:
    """(value, n): how often a failure mode met each value of a changed setting."""
    hit = decisions.where(F.array_contains("reason_codes", mode)).select("experiment_id")
    rows = experiments.join(hit, F.col("id") == F.col("experiment_id")).select(F.col("change_set")[key].alias("value")).where("value is not null")
    return rows.groupBy("value").agg(F.count("*").alias("n"))


def changed_while_pending(experiments: DataFrame, decisions: DataFrame, versions: DataFrame) -> DataFrame:
    """(id, version): policy versions loaded between an experiment's start and its first decision.

    Versions are few and old ones are never removed; they are matched by month before the exact bounds.
    """
    first = decisions.groupBy("experiment_id").agg(F.min("created_at").alias("decided_at"))
    span = experiments.select("id", "created_at").join(first, F.col("id") == F.col("experiment_id")).where("decided_at > created_at")
    months = span.withColumn("month", F.explode(F.sequence(F.date_trunc("month", "created_at"), F.date_trunc("month", "decided_at"), F.expr("interval 1 month"))))
    dated = versions.select(F.col("id").alias("version"), "loaded_at", F.date_trunc("month", "loaded_at").alias("month"))
    return months.join(dated, "month").where("loaded_at > created_at and loaded_at < decided_at").select("id", "version")


def stale_universe(results: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Results older than the latest snapshot, where there is more than one."""
    last = snapshots.agg(F.max("recorded_at").alias("last_at"), F.count("*").alias("n")).where("n > 1").drop("n")
    return results.join(F.broadcast(last), F.col("created_at") < F.col("last_at")).select("id", "experiment_id")


def repeated_access(log: DataFrame) -> DataFrame:
    return log.where("granted").groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("accessed_at").alias("first_at")).where("n > 1")


def access(log: DataFrame) -> DataFrame:
    """granted: the first of a fingerprint's requests that are not for paper trading; those always are."""
    order = W.partitionBy("fingerprint", F.col("kind") == "paper").orderBy("accessed_at", "id")
    return log.withColumn("granted", (F.col("kind") == "paper") | (F.row_number().over(order) == 1))


def hypothesis_stats(hypotheses: DataFrame, tests: DataFrame) -> DataFrame:
    """Per source: registered, tested, discoveries and a Laplace prior of discovery."""
    both = hypotheses.join(tests.select("hypothesis_id", "discovery"), F.col("id") == F.col("hypothesis_id"), "left")
    out = both.groupBy("source").agg(F.count_distinct("id").alias("n"), F.count_if(F.col("discovery").isNotNull()).alias("tested"), F.count_if("discovery").alias("discoveries"))
    return out.withColumn("prior", (F.col("discoveries") + 1) / (F.col("tested") + 2))


def asset_classes(membership: DataFrame) -> DataFrame:
    return membership.groupBy("symbol").agg(F.max_by("asset_class", "listed_at").alias("asset_class"))


def universe_class(specs: DataFrame, membership: DataFrame) -> DataFrame:
    """A universe's class where all its symbols share one, else null."""
    legs = specs.select("spec_id", F.explode("universe").alias("symbol")).join(asset_classes(membership), "symbol", "left")
    kinds = legs.groupBy("spec_id").agg(F.collect_set("asset_class").alias("kinds"), F.count_if(F.col("asset_class").isNull()).alias("unknown"))
    return kinds.select("spec_id", F.when((F.size("kinds") == 1) & (F.col("unknown") == 0), F.element_at("kinds", 1)).alias("asset_class"))


#: Statuses that only a promotion reaches, by rank.
RANKS = {"VALIDATED": 1, "CHAMPION": 2}


def transitions(requests: DataFrame) -> DataFrame:
    """Verdict on requests (status, wanted, halted, is_canary, discovered, holdout_passed): refused and why.

    Only a promotion, that is a move up to VALIDATED or CHAMPION, can be refused.
    """
    rank = F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])
    of = lambda c: F.coalesce(F.try_element_at(rank, F.col(c)), F.lit(0))
    promotion = of("wanted") > of("status")
    reason = (
        F.when(~promotion, None).when(F.col("is_canary"), "CANARY").when(F.col("halted"), "HALTED")
        .when((F.col("wanted") == "VALIDATED") & ~F.col("discovered"), "NO_DISCOVERY").when(~F.col("holdout_passed"), "NO_HOLDOUT")
    )
    return requests.withColumn("refused", reason).withColumn("allowed", F.col("refused").isNull())


def _newest(rows: DataFrame, key: str, *columns: Column | str) -> DataFrame:
    """The newest row of each key by (created_at, id)."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("created_at", "id")).alias("s")).select(key, "s.*")


def mutation_label(change_set: Column) -> Column:
    """A short name of a change; null for none or an unknown kind."""
    kind, field = F.try_element_at(change_set, F.lit("mutation_type")), F.coalesce(F.try_element_at(change_set, F.lit("field")), F.lit("?"))
    return F.when(kind == "PARAMETER_TUNE", F.concat(F.lit("tune "), field)).when(kind == "SWAP_FAMILY", "swap family").when(kind == "CROSSOVER", "crossover").when(kind == "LLM_HYPOTHESIS", "LLM hypothesis")


def strategy_list(strategies: DataFrame, runs: DataFrame, validations: DataFrame, n: int = 500) -> DataFrame:
    """The n newest strategies with the label of their latest run's change and the latest validation of that run's hash."""
    page = strategies.orderBy(F.desc("created_at"), F.desc("id")).limit(n).select("id", "family", "status")
    mine = runs.join(page.select(F.col("id").alias("strategy_id")), "strategy_id", "left_semi")
    run = _newest(mine, "strategy_id", "config_hash", "change_set").select(F.col("strategy_id").alias("id"), F.col("config_hash").alias("fingerprint"), mutation_label(F.col("change_set")).alias("label"))
    judged = _newest(validations.join(run.select("fingerprint"), "fingerprint", "left_semi"), "fingerprint", "verdict", "score", "pbo")
    return page.join(run, "id", "left").join(judged, "fingerprint", "left").select("id", "family", "status", "label", "fingerprint", "verdict", "score", "pbo")


def scatter(results: DataFrame, runs: DataFrame, strategies: DataFrame, decisions: DataFrame) -> DataFrame:
    """(config_hash, id, family, total_return_pct, decision): the latest result of each config hash, with its run's latest decision."""
    rows = results.select("experiment_id", "total_return_pct", "created_at", "id").join(runs.select(F.col("id").alias("experiment_id"), "config_hash", "strategy_id"), "experiment_id")
    last = rows.groupBy("config_hash").agg(F.max_by(F.struct("experiment_id", "strategy_id", "total_return_pct"), F.struct("created_at", "id")).alias("s")).select("config_hash", "s.*")
    decided = _newest(decisions, "experiment_id", "decision")
    family = strategies.select(F.col("id").alias("strategy_id"), "family")
    return last.join(family, "strategy_id").join(decided, "experiment_id", "left").select("config_hash", F.col("experiment_id").alias("id"), "family", "total_return_pct", "decision")


def cluster_view(validations: DataFrame, runs: DataFrame) -> DataFrame:
    """(cluster, size, members) of clusters with several members, from the latest validation of each fingerprint that has a cluster;
    members are (fingerprint, strategy_id of the hash's latest run, score), largest clusters first."""
    last = _newest(validations.where("cluster is not null"), "fingerprint", "cluster", "score")
    run = _newest(runs.where("strategy_id is not null"), "config_hash", "strategy_id").withColumnRenamed("config_hash", "fingerprint")
    members = F.array_sort(F.collect_list(F.struct("fingerprint", "strategy_id", "score")))
    out = last.join(run, "fingerprint", "left").groupBy("cluster").agg(F.count("*").alias("size"), members.alias("members"))
    return out.where("size > 1").orderBy(F.desc("size"), "cluster")


def canary_statistics(registered: DataFrame, evaluated: DataFrame, breaches: DataFrame, halts: DataFrame) -> DataFrame:
    """One row: canaries registered, evaluated and breached (distinct hashes), last breach, latest halt event, share that passed wrongly."""
    out = registered.agg(F.count("*").alias("registered")).crossJoin(evaluated.agg(F.count_distinct("config_hash").alias("evaluated")))
    out = out.crossJoin(breaches.agg(F.count_distinct("config_hash").alias("breached"), F.max("created_at").alias("last_breach_at"))).crossJoin(halts.agg(F.max_by("event", "id").alias("latest_halt_event")))
    return out.withColumn("false_pass_rate", F.try_divide(F.col("breached").cast("double"), F.col("evaluated")))


def paper_eligible(ledger: DataFrame, verdicts: DataFrame, strategies: DataFrame) -> DataFrame:
    """(id, family, label): discoveries that await the holdout, and all champions."""
    waiting = awaiting_holdout(ledger, verdicts, strategies).select("id", "family", F.lit("AWAITING_HOLDOUT").alias("label"))
    return waiting.unionByName(strategies.where("status = 'CHAMPION'").select("id", "family", F.lit("CHAMPION").alias("label")))


def to_restore(strategies: DataFrame, orders: DataFrame) -> DataFrame:
    """(family, id): in families without a champion, the validated strategy that traded last; orders (strategy_id, at)."""
    crowned = strategies.where("status = 'CHAMPION'").select("family").distinct()
    traded = orders.groupBy(F.col("strategy_id").alias("id")).agg(F.max("at").alias("at"))
    open_ = strategies.where("status = 'VALIDATED'").join(crowned, "family", "left_anti").join(traded, "id")
    return open_.groupBy("family").agg(F.max_by("id", F.struct("at", "id")).alias("id"))


def breedable(strategies: DataFrame, canaries: DataFrame) -> DataFrame:
    """Strategies that are no canaries; canaries (strategy_id)."""
    return strategies.join(canaries.select(F.col("strategy_id").alias("id")), "id", "left_anti")


def breedable_scores(strategies: DataFrame, canaries: DataFrame, runs: DataFrame, validations: DataFrame, statuses: tuple[str, ...] = ("VALIDATED", "CHAMPION", "PROMISING")) -> DataFrame:
    """(id, config_hash, score, icir): the latest validation of the latest run of breedable strategies with one of the statuses."""
    own = breedable(strategies, canaries).where(F.col("status").isin(*statuses)).select(F.col("id").alias("strategy_id"))
    run = _newest(runs.join(own, "strategy_id", "left_semi"), "strategy_id", "config_hash")
    judged = _newest(validations, "fingerprint", "score", F.col("metrics.icir").alias("icir")).withColumnRenamed("fingerprint", "config_hash")
    return run.join(judged, "config_hash").select(F.col("strategy_id").alias("id"), "config_hash", "score", "icir")


def job_health(jobs: DataFrame, dead: DataFrame, bound: float = 0.2) -> DataFrame:
    """Per kind: jobs, failures, their share and whether it is too high."""
    n = jobs.groupBy("kind").agg(F.count("*").alias("n")).join(dead.groupBy("kind").agg(F.count("*").alias("failed")), "kind", "full")
    n = n.na.fill(0, ["n", "failed"]).withColumn("share", F.try_divide(F.col("failed").cast("double"), F.col("n") + F.col("failed")))
    return n.withColumn("unhealthy", F.col("share") > bound)


def spend(usage: DataFrame, prices: DataFrame, budget: float) -> DataFrame:
    """(month, cost, tier): usage (model, at, tokens) at prices (model, per_token)."""
    cost = usage.join(F.broadcast(prices), "model", "left").groupBy(F.date_trunc("month", "at").alias("month")).agg(F.sum(F.col("tokens") * F.coalesce("per_token", F.lit(0.0))).alias("cost"))
    return cost.withColumn("tier", F.when(F.col("cost") >= budget, "STOP").when(F.col("cost") >= 0.8 * budget, "ECONOMY").otherwise("NORMAL"))
