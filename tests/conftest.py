import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from kerbside.schemas import BRONZE_SCHEMA  # noqa: E402
from kerbside.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = build_session(
        "tests",
        **{
            "spark.master": "local[8]",
            "spark.driver.memory": "8g",
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.warehouse.dir": str(folder / "warehouse"),
            "spark.checkpoint.dir": str(folder / "checkpoint"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


DEFAULT_READING = {
    "location_id": 7,
    "sensing_datetime": "2026-03-11T02:30:00+00:00",
    "sensing_date": "2026-03-11",
    "sensing_time": "13:30",
    "direction_1": 5,
    "direction_2": 8,
    "total_of_directions": 13,
    "ingested_at": "2026-03-11T02:40:00+00:00",
}


def reading(**changes):
    row = {**DEFAULT_READING, **changes}
    row.setdefault("dedupe_key", f"{row['location_id']}#{row['sensing_datetime']}")
    return row


@pytest.fixture
def bronze(spark):
    def make(*rows):
        names = BRONZE_SCHEMA.fieldNames()
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], BRONZE_SCHEMA)

    return make
