import os

import pytest

from kontorium import session


def test_cut_drop_and_clear(spark):
    df = spark.range(5).withColumnRenamed("id", "a.b")
    one, two = session.cut(df, "t"), session.cut(df, "t")
    assert one.dtypes == df.dtypes and sorted(r[0] for r in one.collect()) == list(range(5))
    session.drop(one)
    session.drop(df)
    assert not os.path.exists(one._kontorium_path) and os.path.exists(two._kontorium_path)
    session.clear(spark)
    assert not os.path.exists(two._kontorium_path)


def test_named_folder_is_used():
    class Named:
        class sparkContext:  # noqa: N801
            @staticmethod
            def getConf():
                return {"spark.checkpoint.dir": "file:///some/where/"}

    assert session.shared_folder(Named) == "file:///some/where"


def test_ship_once(spark):
    session.ship(spark)
    n = len(spark.sparkContext._python_includes)
    session.ship(spark)
    assert len(spark.sparkContext._python_includes) == n and "kontorium.zip" in spark.sparkContext._python_includes


def test_cluster_needs_a_shared_folder():
    class OnCluster:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_folder(OnCluster)
