import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import builder  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("spark")
    session = (
        builder("tests", "local[4]", 4)
        .config("spark.sql.warehouse.dir", f"file:{root}/warehouse")
        .config("spark.checkpoint.dir", f"file:{root}/shared")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


KINDS = ("heat", "damp", "noise", "light")


def base_record(i: int) -> dict:
    """A sensor reading: five columns, every kind equally often."""
    return {"id": i, "seen_at": f"2031-05-06T07:{i // 60 % 60:02d}:{i % 60:02d}", "sensor": f"s{i % 37:03d}",
            "kind": KINDS[i % len(KINDS)], "reading": (i * 7 % 1000) / 4}


def evolved_record(i: int) -> dict:
    """The same with two columns more, one of them nested."""
    return {**base_record(i), "site": f"hall {i % 6}", "device": {"maker": f"m{i % 5}", "firmware": i % 9, "slot": str(i % 16)}}


def land(folder, first: int, files: int, record=base_record, rows: int = 1000):
    """Line-delimited JSON files ``batch_<n>.json`` of 1000 rows."""
    folder.mkdir(parents=True, exist_ok=True)
    for n in range(first, first + files):
        lines = (json.dumps(record(n * rows + i)) for i in range(rows))
        (folder / f"batch_{n}.json").write_text("\n".join(lines) + "\n")
