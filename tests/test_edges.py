"""Odd keys, names and folders."""

import pytest

from gainsieve import session
from gainsieve.operators.sampling import first_per_class, first_rows
from gainsieve.sources.scores import read_scores, write_scores
from gainsieve.sources.tables import read_table, write_table


def test_scores_keep_any_name(spark, tmp_path):
    names = ['a"b', " lead", "trail ", "ta\tb", "line\nbreak", "", 'say "hi"\t', "back\\slash", "plain"]
    scores = spark.createDataFrame([(n, float(i)) for i, n in enumerate(names)], "feature string, score double")
    write_scores(scores, str(tmp_path / "scores"))
    got = {(r["feature"], r["score"]) for r in read_scores(spark, str(tmp_path / "scores")).collect()}
    assert got == {(n, float(i)) for i, n in enumerate(names)}


def test_null_and_repeated_keys(spark):
    df = spark.createDataFrame([(None, 0), (1, 0), (2, 0), (3, 0), (None, 1), (5, 1)], "key int, label int")
    assert sorted((r["key"] is None, r["key"] or 0) for r in first_rows(df.where("label = 0"), 3, ["key"]).collect()) == [(False, 1), (False, 2), (True, 0)]
    assert first_per_class(df, 2, ["key"]).count() == 4
    assert first_per_class(df, 0, ["key"]).count() == 0
    with pytest.raises(ValueError):
        first_rows(df, -1, ["key"])
    with pytest.raises(ValueError):
        first_rows(df.unionAll(df), 3, ["key"])


def test_no_local_folder_on_a_cluster():
    assert session.is_local("local[*]") and session.is_local("local")
    assert not any(map(session.is_local, ["local-cluster[2,1,1024]", "yarn", "spark://host:7077", "k8s://x"]))

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_csv_loses_nothing(spark, tmp_path):
    texts = ["a\nb", "x\x01y", 'say "no"', "plain, with comma"]
    rows = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "key int, note string, label int")
    write_table(rows, str(tmp_path / "all"))
    back = read_table(spark, str(tmp_path / "all"), multi_line=True)
    assert sorted((r["key"], r["note"]) for r in back.collect()) == [(str(i), t) for i, t in enumerate(texts)]
    with pytest.raises(Exception, match="not closed"):
        read_table(spark, str(tmp_path / "all")).collect()
    write_table(rows.where("key > 0"), str(tmp_path / "lines"))
    back = read_table(spark, str(tmp_path / "lines"))
    assert sorted((r["key"], r["note"], r["label"]) for r in back.collect()) == [(str(i), t, str(i % 2)) for i, t in enumerate(texts) if i]
