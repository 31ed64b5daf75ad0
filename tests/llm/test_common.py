import pytest

from panelcast.llm import common


def test_a_spread_join_is_a_join_whatever_the_keys(spark):
    left = spark.createDataFrame([(k, j) for k in range(1, 40) for j in range(2000 if k == 7 else k % 5)] + [(None, 1), (99, 1)], "key long, row int")
    right = left.groupBy("key").count().withColumnRenamed("count", "n").filter("key <> 99")
    got = common.join_spread(left, right, ["key"], "n", left.count(), ["row"])
    assert got.columns == ["key", "row", "n"]
    assert sorted(got.collect()) == sorted(left.join(right, "key").collect())
    dealt = common.join_spread(left, right, ["key"], "n", left.count(), ["row"]).filter("key = 7")
    assert dealt.count() == 2000
    assert common.join_spread(left.limit(0), right, ["key"], "n", 0, ["row"]).count() == 0


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        conf = Conf({"spark.master": "spark://somewhere:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
    Session.conf["spark.checkpoint.dir"] = "file:///shared/"
    assert common.shared_dir(Session) == "file:///shared"
