import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from pothi.plans import store
from pothi.plans.configuration import each_of


def test_named_folder_wins(spark, tmp_path, monkeypatch):
    local = store.shared_folder(spark)
    assert os.path.isdir(local.removeprefix("file://")) or spark.conf.get("spark.checkpoint.dir", None) == local
    named = SimpleNamespace(conf={"spark.checkpoint.dir": f"file://{tmp_path}/"})
    assert store.shared_folder(named) == f"file://{tmp_path}"
    monkeypatch.setattr(store, "shared_folder", lambda s: f"file://{tmp_path}")
    with store.scope():
        assert store.materialise(spark.range(5), "numbers").count() == 5 and os.listdir(tmp_path) == ["pothi"]
        assert len(os.listdir(tmp_path / "pothi")) == 1
    assert os.listdir(tmp_path / "pothi") == []


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    context = SimpleNamespace(getConf=dict, master=master)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        store.shared_folder(SimpleNamespace(conf={}, sparkContext=context))


def test_tables_go_when_the_driver_ends_after_its_session(tmp_path):
    code = (
        "from pothi.session import session; from pothi.plans.store import materialise\n"
        f"s = session('local[1]', 'stops', **{{'spark.checkpoint.dir': 'file://{tmp_path}', 'spark.ui.enabled': 'false'}})\n"
        "print(materialise(s.range(3), 'kept').count()); s.stop()"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(store.__file__)))
    env = os.environ | {"PYTHONPATH": os.path.dirname(root)}
    assert subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300).stdout.strip() == "3"
    assert os.listdir(tmp_path / "pothi") == []


def test_each_of(spark):
    configuration = spark.createDataFrame([(1, "a", None), (2, None, 0.5)], "c int, name string, x double")
    got = each_of(spark.range(2), configuration)
    assert got.count() == 4 and got.columns == ["id", "c", "name", "x"]
    assert each_of(spark.range(2), configuration.limit(0)).count() == 0
