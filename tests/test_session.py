"""The shared folder: the session's own, a temporary one in local mode alone, and gone when the driver ends."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from pagemill import session


def fake(master, where=None):
    known = {"spark.checkpoint.dir": where} if where else {}
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master), conf=SimpleNamespace(get=lambda k, d: known.get(k, d), set=known.__setitem__))


def test_a_cluster_must_name_its_folder(monkeypatch):
    monkeypatch.delenv("PAGEMILL_SHARED_DIR", raising=False)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            session.shared_dir(fake(master))
        assert session.shared_dir(fake(master, "/shared")) == "/shared"
    assert os.path.isdir(session.shared_dir(fake("local[4]")))


def test_written_tables_are_deleted_when_the_driver_ends(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
from pagemill.session import materialised
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
assert materialised(spark.range(5)).count() == 5
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, timeout=120)
    assert not [f for f in os.listdir(tmp_path) if f.startswith("pagemill-")]
