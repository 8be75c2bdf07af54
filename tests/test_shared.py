"""Where intermediate tables go, and names that run out."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from snapfold.functions import keys
from snapfold.shared import shared_dir


def test_a_cluster_must_name_its_folder():
    empty = SimpleNamespace(isEmpty=lambda: True)
    context = SimpleNamespace(master="yarn", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: empty)))
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session)
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: "hdfs://x/y"), sparkContext=context)
    assert shared_dir(named) == "hdfs://x/y"


def test_names_run_out_with_an_error(spark):
    row = spark.range(1)
    taken = ["m.lib", *(f"m-{n}.lib" for n in range(2, 999))]
    name = lambda names: keys.unique_name(F.lit("m.lib"), F.array(*map(F.lit, names)))
    assert row.select(name(taken).alias("n")).first()["n"] == "m-999.lib"
    with pytest.raises(Exception, match="no free name"):
        row.select(name([*taken, "m-999.lib"]).alias("n")).collect()
