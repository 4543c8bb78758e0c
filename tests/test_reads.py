"""Queries that use a derived table several times read what it comes from once."""

from __future__ import annotations

from conftest import SF
from tidemark.operators import learned
from tidemark.plans import backtest, validation
from tidemark.sources import experiments, market


def _counted(spark, source):
    """source with a count of all rows that are ever drawn from it."""
    drawn = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            drawn.add(batch.num_rows)
            yield batch

    def build(spark, sf_dir):
        rows = source(spark, sf_dir)
        return rows.mapInArrow(count, rows.schema)

    return build, drawn


def test_verdicts_read_bars_and_validations_once(spark, monkeypatch):
    bars, n_bars = _counted(spark, market.bars)
    tried, n_tried = _counted(spark, experiments.validations)
    for module in (backtest, validation):
        monkeypatch.setattr(module, "bars", bars)
    monkeypatch.setattr(validation, "validations", tried)
    rows = validation.verdicts(spark, SF).collect()
    assert len(rows) == market.bars(spark, SF).select("symbol").distinct().count()
    assert n_bars.value == market.bars(spark, SF).count()
    assert n_tried.value == experiments.validations(spark, SF).count()


def test_fits_read_bars_once_and_are_dealt_by_checkpoints(spark):
    bars, n_bars = _counted(spark, market.bars)
    out = learned.walk_forward(bars(spark, SF), "LOGISTIC_REGRESSION", 120, 20)
    assert out.count() == n_bars.value == market.bars(spark, SF).count()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    fit = plan[plan.index("FlatMapGroupsInArrow") :]
    assert "RepartitionByExpression [symbol" in fit and "part" in fit.split("RepartitionByExpression")[1].split("]")[0]
