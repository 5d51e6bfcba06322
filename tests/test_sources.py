import numpy as np
import pytest
from pyspark.sql import functions as F

from puspark.operators.scan import Scan, two_level_scan
from puspark.sources import materialise, read_table
from puspark.sources import shared
from puspark.sources.tables import document_features, with_totals


def test_hot_orders_are_split_without_changing_rows(spark):
    rows = [(1, i, float(i)) for i in range(60)] + [(k, i, 1.0) for k in range(2, 40) for i in range(3)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double")
    columns = ["l_orderkey", "l_linenumber", "l_quantity", "sq", "n"]

    def result(hot_rows):
        return sorted(tuple(r[c] for c in columns) for r in with_totals(lines, hot_rows).collect())

    assert result(10) == result(1_000_000) == result(1)
    assert len(result(10)) == len(rows)


def test_predictions_cover_all_lines(spark, small, preds):
    assert preds.count() == read_table(spark, small, "lineitem").count()
    assert preds.filter("score <= 0 or score >= 1").count() == 0
    assert preds.filter("holdout = 1 and known_pos = 1").count() == 0


def test_document_measures(spark, small):
    row = document_features(spark, small).orderBy("ind_id").first()
    text = read_table(spark, small, "documents").filter(F.col("doc_id") == row["ind_id"]).first()["text"]
    words = text.split()
    assert row["n_words"] == len(words)
    assert row["distinct_share"] == pytest.approx(len(set(words)) / len(words))
    assert row["mean_word_len"] == pytest.approx(sum(map(len, words)) / len(words))
    assert row["n_lines"] == text.count("\n") + 1
    assert row["digit_share"] == pytest.approx(sum(c in "0123456789" for c in text) / row["n_chars"])


def test_materialise_keeps_rows_and_types(spark):
    df = spark.range(10).select(F.col("id").alias("a"), (F.col("id") % 3).cast("int").alias("part"), F.lit("x").alias("s"))
    for partition_by in ((), ("part", "s")):
        back = materialise(df, partition_by)
        assert dict(back.dtypes) == dict(df.dtypes)
        assert sorted(r["a"] for r in back.filter("part = 1").collect()) == [1, 4, 7]


class Session:
    """What ``shared_folder`` looks at; the setting itself cannot be changed in a running session."""

    def __init__(self, setting, master, folder=None):
        self.conf = {shared.CHECKPOINT_CONF: setting}
        self.master, self.folder = master, folder
        self.sparkContext = self

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder_is_the_one_the_cluster_names():
    assert shared.shared_folder(Session("hdfs:/shared/", "yarn")) == "hdfs:/shared"
    assert shared.shared_folder(Session(None, "yarn", "hdfs:/set/in/code")) == "hdfs:/set/in/code"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session(None, "yarn"))
    local = Session(None, "local[2]")
    assert shared.shared_folder(local) == shared.shared_folder(local) == local.folder


@pytest.mark.parametrize("blocks", [1, 7])
def test_scan_within_keys(spark, blocks):
    rng = np.random.default_rng(0)
    rows = [(k, i, int(v), i * blocks // 50) for k in ("a", None) for i, v in enumerate(rng.integers(-5, 9, 50))]
    df = spark.createDataFrame(rows, "k string, i int, v int, b int")
    scans = [Scan("upto", F.col("v"), "sum"), Scan("before", F.col("v"), "sum", -1), Scan("top", F.col("v"), "max")]
    got = two_level_scan(df, scans, ["i"], "b", ["k"]).orderBy("k", "i").collect()
    for k in ("a", None):
        v = [r[2] for r in rows if r[0] == k]
        mine = [r for r in got if r["k"] == k]
        assert [r["upto"] for r in mine] == np.cumsum(v).tolist()
        assert [r["before"] for r in mine] == (np.cumsum(v) - v).tolist()
        assert [r["top"] for r in mine] == np.maximum.accumulate(v).tolist()


def test_workspace_deletes_its_tables(spark, tmp_path):
    import os

    from puspark.sources import materialise, workspace
    from puspark.sources.shared import shared_folder

    kept = materialise(spark.range(5))
    with workspace(spark):
        inside = materialise(spark.range(7))
        folder = inside.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
        assert os.path.isdir(folder) and folder.startswith(shared_folder(spark).removeprefix("file:"))
        inside.write.parquet(f"{tmp_path}/result")
    assert not os.path.exists(folder)
    assert kept.count() == 5 and spark.read.parquet(f"{tmp_path}/result").count() == 7
