"""The shared folder, written tables and the package's way to the workers."""

import subprocess
import sys
import zipfile
from pathlib import Path
from types import SimpleNamespace
from urllib.parse import urlparse

import pytest

from rhythmlake import session


def fake(master, folder=None):
    get = lambda key, default=None: folder if key == "spark.checkpoint.dir" else default
    conf = SimpleNamespace(get=get)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))


def test_shared_folder():
    assert session.shared_folder(fake("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    assert session.shared_folder(fake("local[4]")).startswith("file://") and session.shared_folder(fake("local")).startswith("file://")
    for master in ("yarn", "spark://h:7077", "local-cluster[3,4,6144]", "k8s://h"):
        with pytest.raises(ValueError):
            session.shared_folder(fake(master))


def test_ship(spark):
    session.ship(session.ship(spark))
    name = Path(session._package()).name
    assert sum(f.endswith(name) for f in spark.sparkContext.listFiles) == 1
    with zipfile.ZipFile(session._package()) as z:
        assert {"rhythmlake/__init__.py", "rhythmlake/operators/activity.py"} <= set(z.namelist())

    def where(batches):
        import pyarrow as pa

        import rhythmlake.operators.activity as a

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([a.__name__])], ["name"])

    assert spark.range(1).mapInArrow(where, "name string").head()[0] == "rhythmlake.operators.activity"


def test_written_tables_go_when_the_driver_ends(tmp_path):
    code = f"""
from rhythmlake.session import build_session, written
spark = build_session(1, "gone", **{{"spark.checkpoint.dir": "file://{tmp_path}", "spark.driver.memory": "1g"}})
df = written(spark.range(5), "t")
assert df.count() == 5
print(df.inputFiles()[0])
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    path = Path(urlparse(out.stdout.split()[-1]).path)
    assert path.is_relative_to(tmp_path) and not path.parent.exists()
