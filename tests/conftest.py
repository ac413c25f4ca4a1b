from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tripstrata.session import build_session  # noqa: E402

TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tripstrata-tests",
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.sql.maxMetadataStringLength": "4000",
            "spark.sql.sources.parallelPartitionDiscovery.threshold": "4096",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small() -> str:
    return str(TESTDATA / "sf0.001")


@pytest.fixture(scope="session")
def medium() -> str:
    return str(TESTDATA / "sf0.01")


@pytest.fixture(scope="session")
def lake_root(spark, small, tmp_path_factory) -> str:
    """A lake with every stage but training run on the small tables."""
    from tripstrata.plans import pipeline
    from tripstrata.sources import adapters

    base = tmp_path_factory.mktemp("lake")
    landing, root = f"{base}/landing", f"{base}/lake"
    write_landing(adapters.bronze(spark, small), landing)
    pipeline.run_ingest(spark, landing, root)
    pipeline.run_silver(spark, root)
    rollup = pipeline.refresh_rollup(spark, root)
    pipeline.run_gold(spark, root, rollup=rollup)
    pipeline.run_features(spark, root, rollup=rollup)
    return root


def write_landing(bronze, landing: str) -> None:
    """One folder per period."""
    bronze.coalesce(1).write.partitionBy("period").parquet(landing)
