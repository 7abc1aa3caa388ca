import json

import pytest
from pyspark.sql import functions as F

from gainsieve.functions.text import numeric_target, short_name, text_to_double, text_to_long
from gainsieve.plans.prepare import balanced_lines, feature_table, prepare
from gainsieve.sources.jsonl import POSITION, parse_records, read_lines
from gainsieve.sources.scores import read_scores, write_scores
from gainsieve.operators.ranking import rank_cells, rank_table
from gainsieve.sources.tables import cells_to_vectors, preview, read_cells, read_table, resolve_target, split_cells, written_bytes


def parsed(spark, lines, **options):
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, value string")
    rows = {r["i"]: (r["label"], r["features"]) for r in parse_records(df, **options).collect()}
    return [rows.get(i) for i in range(len(lines))]


LABELS = [
    ("1", 1), ('"1"', 1), ("1.9", 1), ("-1.9", -1), ("true", 1), ("false", 0), ('"Benign"', 0), ('"GOOD"', 0), ('"safe"', 0),
    ('" safe"', 1), ('"trojan"', 1), ('""', 1), ('"0.0"', 1), ('"1.0"', 1), ("0.0", 0), ('" 7 "', 7), ('"1_0"', 10),
    ('{"label":"safe"}', 0), ('{"name":"x"}', 1), ('{"label":3,"name":"x"}', 3), ("-1", -1),
]


def test_labels(spark):
    found = parsed(spark, [f'{{"features":[1],"label":{text}}}' for text, _ in LABELS])
    assert [f[0] for f in found] == [label for _, label in LABELS]


def test_label_falls_through_to_next_key(spark):
    lines = [f'{{"features":[1],"label":{v},"avclass":5}}' for v in ["null", "{}", "[1]", "NaN", '{"label":null}', '{"label":{"label":1}}']]
    assert [f[0] for f in parsed(spark, lines)] == [5] * len(lines)
    assert parsed(spark, ['{"features":[1],"classes":2,"Target":1,"target":0}'])[0][0] == 0


def test_numeric_strings(spark):
    assert parsed(spark, ['{"features":[1],"label":"0.0"}'], numeric_strings=True)[0][0] == 0


def test_invalid_labels(spark):
    assert parsed(spark, ['{"features":[1],"label":Infinity,"class":1}', '{"features":[1]}']) == [None, None]


FEATURES = [
    ('{"features":[1,2.5],"label":1}', [1.0, 2.5]),
    ('{"features":[],"data":["1",2,true],"label":1}', [1.0, 2.0, 1.0]),
    ('{"vector":[3],"feature":[4],"label":1}', [4.0]),
    ('{"features":5,"x":2,"label":0}', [5.0, 2.0]),
    ('{"features":[1,"x"],"label":1}', None),
    ('{"features":[1,null],"label":1}', None),
    ('{"features":[1,[2]],"label":1}', None),
    ('{"z":1,"label":0.0,"a":[1,2.5],"q":["1",2],"b":true,"n":null,"s":"5","d":{"x":1},"e":[]}', [1.0, 1.0, 2.5, 1.0]),
    ('{"b":1,"a":2,"b":3,"label":1}', [3.0, 2.0]),
    ('{"a.b":1,"a":[1,null],"c":[true,2],"Target":9,"label":1}', [1.0, 1.0, 2.0]),
    ('{"label":1,"s":"x"}', None),
    ('{"label":1,"v":[-Infinity,1e999]}', [float("-inf"), float("inf")]),
]


def test_features(spark):
    found = parsed(spark, [line for line, _ in FEATURES])
    assert [f and f[1] for f in found] == [features for _, features in FEATURES]


def test_many_loose_values(spark):
    """Enough values to be read together, with and without one that cannot be."""
    plain = {f"k{i}": i / 7 for i in range(100)} | {"label": 1}
    mixed = {"s": "5", "l": [1, 2], "b": False} | plain
    found = parsed(spark, [json.dumps(plain), json.dumps(mixed)])
    assert found[0][1] == [i / 7 for i in range(100)]
    assert found[1][1] == [1.0, 2.0, 0.0] + [i / 7 for i in range(100)]


@pytest.mark.parametrize("line", ['{"a":1,"label":0} x', '{"a":1,"label":0},{"a":1}', '{"a":1,"label":0}] x', "[1]", "5", "null", "{'a':1,'label':0}", '{"a":01,"label":0}', "nope"])
def test_not_one_object(spark, line):
    assert parsed(spark, [line]) == [None]


def test_long_text_inside_a_record(spark):
    text = 'a "quoted" \\ é \n line ' * 5000
    line = json.dumps({"text": text, "features": [1.5], "label": "benign"}, ensure_ascii=False)
    assert parsed(spark, [line]) == [(0, [1.5])]


def test_number_texts(spark):
    texts = ["1", " 1.5\t", "1e3", ".5", "5.", "1_000", "nan", "-inf", "+Infinity", "1d", "1f", "0x1p3", "1__0", "_1", "", "x", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = [r[0] for r in df.orderBy("i").select(text_to_double(F.col("t"))).collect()]
    assert found[:6] == [1.0, 1.5, 1000.0, 0.5, 5.0, 1000.0]
    assert found[6] != found[6] and found[7:9] == [float("-inf"), float("inf")]
    assert found[9:] == [None] * 8
    whole = [r[0] for r in df.orderBy("i").select(text_to_long(F.col("t"))).collect()]
    assert whole[0] == 1 and whole[5] == 1000 and whole[1] is None
    cut = spark.createDataFrame([("1.9",), ("-0.5",), ("nan",)], "t string").select(numeric_target(F.col("t"))).collect()
    assert [r[0] for r in cut] == [1, 0, None]


def test_short_name(spark):
    assert spark.range(1).select(short_name(F.lit("a" * 60))).first()[0] == "a" * 47 + "..."


@pytest.mark.parametrize("columns, target", [(["a", " CLASS ", "label"], " CLASS "), (["a", "b"], "b"), (["AvClass", "x"], "AvClass")])
def test_target_column(columns, target):
    assert resolve_target(columns) == target


def test_table_round_trip(spark, tmp_path):
    (tmp_path / "one.csv").write_text('a , note,label\n 1 ,"x, ""y""",0\n\n2,,1\n3\n')
    (tmp_path / "two.csv").write_text("a , note,label\n4, z ,1,9\n")
    rows = [tuple(r) for r in read_table(spark, str(tmp_path)).orderBy("a").collect()]
    assert rows == [("1", 'x, "y"', "0"), ("2", None, "1"), ("3", None, None), ("4", "z", "1")]
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "one.csv").write_text("a,label\n1,2\n")
    (tmp_path / "other" / "two.csv").write_text("b,label\n1,2\n")
    with pytest.raises(Exception, match="header"):
        read_table(spark, str(tmp_path / "other")).collect()
    (tmp_path / "twice.csv").write_text("a,a,label\n1,2,3\n")
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path / "twice.csv"))


def test_cells_with_quotes(spark):
    cases = {
        'a,b,c': ["a", "b", "c"],
        ',,': ["", "", ""],
        '"x, ""y""",z': ['x, "y"', "z"],
        '1, "q,r" ,2': ["1", "q,r", "2"],
        '"",5': ["", "5"],
        'it is "so",2': ['it is "so"', "2"],
        '"a""",""""': ['a"', '"'],
    }
    df = spark.createDataFrame([(k,) for k in cases], "line string")
    for row in df.select("line", split_cells(F.col("line")).alias("c")).collect():
        assert [c.strip() for c in row["c"]] == cases[row["line"]], row["line"]


def test_cells_rank_like_columns(spark, tmp_path):
    text = "x,Label,note\n" + "".join(f"{i % 3}.0,{i % 2}.7,\"n,{i % 5}\"\n" for i in range(60)) + "bad,Label,\n7\n8,,q\n"
    (tmp_path / "in.csv").write_text(text)
    path = str(tmp_path / "in.csv")
    for numeric in (False, True):
        by_cells = {r["feature"]: (r["n_cells"], round(r["score"], 9)) for r in rank_cells(read_cells(spark, path), numeric=numeric).collect()}
        by_columns = {r["feature"]: (r["n_cells"], round(r["score"], 9)) for r in rank_table(read_table(spark, path), numeric=numeric).collect()}
        assert by_cells == by_columns and by_cells["x"][0] == 60
        assert set(by_cells) == ({"x"} if numeric else {"x", "note"})
    vectors = cells_to_vectors(read_cells(spark, path)).where("label IS NOT NULL").collect()
    assert len(vectors) == 60 and vectors[4]["features"] == [1.0, None] and vectors[4]["label"] == 0


def test_scores_round_trip(spark, tmp_path):
    path = str(tmp_path / "scores")
    write_scores(spark.createDataFrame([("f 1", 0.25), ("g", 1e-9)], "feature string, score double"), path)
    write_scores(spark.createDataFrame([("f 1", 0.25), ("g", 1e-9)], "feature string, score double"), path)
    (tmp_path / "scores" / "part-extra").write_text("h\t1\t2\nno score\ni\tx\nj\t3\n")
    assert {tuple(r) for r in read_scores(spark, path).collect()} == {("f 1", 0.25), ("g", 1e-9), ("j", 3.0)}


def lines(n):
    for i in range(n):
        yield json.dumps({"label": "benign" if i % 10 == 0 else "bad", "features": [i, 7, i % 3], "name": "é"}, ensure_ascii=False)
        if i % 5 == 0:
            yield "broken {"


def test_balanced_lines_are_the_first_ones(spark, tmp_path):
    """Small splits, two files, one class nine times the other."""
    text = list(lines(400))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(text[:250]) + "\n")
    (tmp_path / "in" / "b.jsonl").write_text("\n".join(text[250:]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        sample = [r["value"] for r in balanced_lines(spark, str(tmp_path / "in"), 30).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    good = [json.loads(t) for t in text if t.startswith('{"')]
    expected = [r["features"][0] for r in good if r["label"] == "bad"][:30] + [r["features"][0] for r in good if r["label"] == "benign"][:30]
    assert sorted(json.loads(v)["features"][0] for v in sample) == sorted(expected)
    assert [json.loads(v)["features"][0] for v in sample] != sorted(expected)
    assert all(v in text for v in sample)


def test_prepare(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text("\n".join(lines(100)))
    table = prepare(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "sample"), str(tmp_path / "table"), n=20)
    assert table.columns == ["feature_0000", "feature_0001", "feature_0002", "label"]
    back = read_table(spark, str(tmp_path / "table"))
    assert back.count() == 30 and back.columns == table.columns
    facts = back.agg(F.min(F.col("feature_0000").cast("double")), F.max(F.col("feature_0000").cast("double")), F.max("feature_0001"), F.count_if(F.col("label") == "0")).first()
    assert tuple(facts) == (0.0, 1.0, "0.0", 10)
    assert written_bytes(spark, str(tmp_path / "table")) > 500
    assert preview(table, 2).columns == ["feature_0000", "feature_0001", "label"] and preview(table).count() == 3


def test_no_valid_record(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text("broken\n\n")
    records = parse_records(read_lines(spark, str(tmp_path / "bad.jsonl")))
    table, width = feature_table(records)
    assert width == 0 and table.count() == 0 and set(table.columns) == {*POSITION, "features", "label"}
