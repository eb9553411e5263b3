"""Where stages are kept, and columns chosen by name."""

import pytest

from loanlens.functions import nulls
from loanlens.sources import tables


@pytest.mark.parametrize(("master", "one"), [
    ("local", True), ("local[8]", True), ("local[*]", True), ("local[4,2]", True), ("local-cluster[3,2,1024]", False), ("yarn", False),
    ("spark://host:7077", False), ("k8s://https://host", False)])
def test_one_machine(master, one):
    assert tables.runs_on_one_machine(master) == one


def test_local_paths():
    assert tables.is_local_path("file:/tmp/w") and tables.is_local_path("/tmp/w") and not tables.is_local_path("hdfs://n/w") and not tables.is_local_path("s3a://b/w")


def test_several_machines_need_a_shared_folder():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return {"spark.sql.warehouse.dir": "file:/tmp/warehouse"}.get(name, default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_folder(Session())


def test_columns_by_name(spark):
    df = spark.createDataFrame([(1, 2, 3)], "FLAG_A int, AMT int, FLAG_B int")
    assert nulls.columns_named(df, starts=("FLAG_",)) == ["FLAG_A", "FLAG_B"]
    assert nulls.columns_named(df, ends=("_B", "MT")) == ["AMT", "FLAG_B"] and nulls.columns_named(df) == []
