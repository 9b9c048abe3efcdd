import pytest
from tidemark.llm import common


class Cluster:
    """As much of a session as the folder's choice asks for."""

    def __init__(self, master, folder):
        self.sparkContext, self.master, self.applicationId, self.folder = self, master, f"app-{master}-{folder}", folder

    def getConf(self):
        return self

    def get(self, name, default):
        return self.folder or default

    def getCheckpointDir(self):
        return None


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_folder(Cluster("spark://host:7077", None))
    assert common.shared_folder(Cluster("spark://host:7077", "hdfs://shared/")).startswith("hdfs://shared/tables-")
    assert "checkpoints-" in common.shared_folder(Cluster("local[2]", None))


def test_few_keys_keeps_all_rows_of_a_key(spark):
    df = spark.range(5000).selectExpr("case when id % 2 = 0 then 7 else id end as k", "id").unionByName(spark.createDataFrame([(None, 1)], "k long, id long"))
    got = {r.k: r.n for r in common.few_keys(df, "k", 50).groupBy("k").agg({"id": "count"}).toDF("k", "n").collect()}
    assert 50 <= len(got) <= 200 and None not in got and all(n == (2500 if k == 7 else 1) for k, n in got.items())
    assert common.few_keys(df, "k", 5000).count() == 5000 and common.few_keys(df.limit(0), "k", 5).count() == 0
