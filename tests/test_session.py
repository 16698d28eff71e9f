"""The package on executors and the shared work folder."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from conftest import SF_SMALL
from kindsort import session

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
import __spark_entry__ as E
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.warehouse.dir", sys.argv[1] + "/warehouse").config("spark.sql.shuffle.partitions", "4").getOrCreate())
print("rows", E.queries()["category_distribution"](spark, {SF_SMALL!r}).count())
"""


def test_package_reaches_the_workers(tmp_path):
    """Run from elsewhere, the workers' path does not hold the package: it is sent to them."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 7" in out.stdout, out.stderr[-2000:]


class _Context:
    def __init__(self, master, checkpoint=None):
        self.master, self.checkpoint = master, checkpoint

    def getCheckpointDir(self):
        return self.checkpoint

    def setCheckpointDir(self, d):
        self.checkpoint = d


def _session(master, **conf):
    return SimpleNamespace(sparkContext=_Context(master), conf=SimpleNamespace(get=lambda k, default=None: conf.get(k.replace(".", "_"), default)))


def test_work_folder_is_the_setting():
    s = _session("spark://host:7077", spark_checkpoint_dir="hdfs://shared/ckpt")
    assert session.ensure_checkpoint_dir(s) == "hdfs://shared/ckpt"
    assert session.work_path(s, "x").startswith("hdfs://shared/ckpt/kindsort-work/x-")


def test_a_local_session_without_the_setting_works_in_its_warehouse():
    s = _session("local[4]", spark_sql_warehouse_dir="file:/home/me/warehouse")
    assert session.ensure_checkpoint_dir(s) == "file:/home/me/warehouse/_kindsort"


@pytest.mark.parametrize("master", ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"))
def test_a_cluster_without_a_shared_folder_is_refused(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(_session(master, spark_sql_warehouse_dir="/w"))
