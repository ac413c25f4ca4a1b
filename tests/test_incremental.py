"""The rollup sums changed periods only, and always equals a full run."""

from __future__ import annotations

from datetime import datetime

from tests.helpers import bronze
from tripstrata import constants as C
from tripstrata.operators import gold, silver
from tripstrata.plans import pipeline
from tripstrata.sources import files, lake


def write(spark, root, *changes):
    lake.write_silver(silver.with_outcome(bronze(spark, *changes)), root)


def trips(period, n, **changes):
    day = datetime.fromisoformat(f"{period}-03T08:00:00")
    return [{"period": period, C.PICKUP: day, C.DROPOFF: day.replace(hour=9), "total_amount": float(i), **changes} for i in range(n)]


def same_as_full(spark, root):
    full = gold.trip_rollup(lake.load_silver(spark, root))
    kept = pipeline.refresh_rollup(spark, root)
    for build in gold.BUILDERS.values():
        assert sorted(map(tuple, build(kept).collect()), key=str) == sorted(map(tuple, build(full).collect()), key=str)


def test_only_changed_periods_are_read(spark, tmp_path, monkeypatch):
    root, summed = f"{tmp_path}/lake", []
    real = pipeline._rollup_of
    monkeypatch.setattr(pipeline, "_rollup_of", lambda rows, periods: summed.append(periods) or real(rows, periods))
    assert pipeline.refresh_rollup(spark, root).isEmpty()
    write(spark, root, *trips("2024-01", 3), *trips("2024-02", 2), *trips("2024-03", 1, PULocationID=11))
    same_as_full(spark, root)
    same_as_full(spark, root)
    write(spark, root, *trips("2024-02", 5))
    same_as_full(spark, root)
    write(spark, root, *trips("2024-04", 1))
    files.delete(spark, f"{root}/silver/outcome={C.ACCEPTED}/period=2024-01")
    same_as_full(spark, root)
    assert summed == [["2024-01", "2024-02", "2024-03"], ["2024-02"], ["2024-04"]]
    partitions = {n for n in files.children(spark, f"{root}/trip_rollup") if n.startswith("period=")}
    assert partitions == {"period=2024-02", "period=2024-03", "period=2024-04"}


def test_the_list_of_periods_prunes_the_scan(spark, tmp_path):
    root = f"{tmp_path}/lake"
    write(spark, root, *trips("2024-01", 3), *trips("2024-02", 2))
    plan = pipeline._rollup_of(lake.load_silver(spark, root), ["2024-02"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "period#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_totals_of_unknown_origin_are_summed_again(spark, tmp_path):
    root = f"{tmp_path}/lake"
    write(spark, root, *trips("2024-01", 3))
    gold.trip_rollup(lake.load_silver(spark, root)).write.parquet(f"{root}/trip_rollup")
    same_as_full(spark, root)
    pipeline.refresh_rollup(spark, root)
    files.delete(spark, f"{root}/trip_rollup/_state")  # died before the state was stored
    same_as_full(spark, root)
    files.delete(spark, f"{root}/trip_rollup/period=2024-01")
    same_as_full(spark, root)
