import glob
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
               .config("spark.sql.shuffle.partitions", "4")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    from packmill.session import ship_package
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture()
def files(spark):
    """DataFrame of one project's files from {path: text or bytes}."""
    def build(content, project="sample"):
        rows = [(project, p, c.encode() if isinstance(c, str) else c) for p, c in content.items()]
        return spark.createDataFrame(rows, "project_id string, rel_path string, content binary")
    return build


@pytest.fixture()
def write_tree(tmp_path):
    """Writes {path: text or bytes} (None: an empty directory) below a new root."""
    def build(content, name="proj"):
        root = tmp_path / name
        root.mkdir()
        for path, data in content.items():
            full = root / path
            if data is None:
                full.mkdir(parents=True, exist_ok=True)
                continue
            full.parent.mkdir(parents=True, exist_ok=True)
            full.write_bytes(data.encode() if isinstance(data, str) else data)
        return root
    return build


@pytest.fixture()
def document(tmp_path):
    """Writes a pack and returns (document, report row)."""
    count = iter(range(1000))

    def write(pack):
        folder = tmp_path / f"doc{next(count)}"
        report = pack.write(str(folder)).first()
        parts = sorted(glob.glob(str(folder / "part-*")))
        return "".join(open(p, encoding="utf-8", newline="").read() for p in parts), report
    return write
