"""Recursions bar by bar against plain recursive SQL, and no family compared with its own text."""

from __future__ import annotations

import duckdb
import pytest

from tidemark.operators import signals
from tidemark.plans import signals as plans
from tidemark.plans.registry import ORACLES
from tests.conftest import SF


def test_every_family_has_sql_of_its_own():
    assert set(plans.BY_HAND) | set(plans.RECURSIVE) == set(signals.REGISTRY.builders)
    assert set(plans.RECURSIVE) == {name for name in signals.REGISTRY.builders if signals.REGISTRY.of(name).series}


@pytest.mark.parametrize("name", ["KAMA_TREND", "SUPERTREND", "PARABOLIC_SAR", "HULL_MA_TREND", "VOL_BREAKOUT"])
def test_rows_equal_sql(spark, name):
    con = duckdb.connect()
    for table in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    theirs = {(s, str(t)[:10]): (p, x) for s, t, p, x in con.execute(ORACLES[f"signal_{name.lower()}"]).fetchall()}
    ours = {(r["symbol"], str(r["t"])[:10]): (r["position"], r["strength"]) for r in plans.rows(spark, SF, name).collect()}
    assert ours.keys() == theirs.keys() and len(ours) > 1000
    for key, (position, strength) in ours.items():
        assert position == theirs[key][0], key
        assert strength == pytest.approx(theirs[key][1], abs=2e-4) if strength is not None else theirs[key][1] is None, key
