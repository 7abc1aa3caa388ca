"""CSV cells that span lines, whatever the splits."""

import csv
import random

import pytest

from gainsieve.sources.tables import read_cells, read_table


@pytest.fixture
def rows():
    dice = random.Random(4)
    words = ["plain", "a, b", 'he said "no"', "two\nlines", 'q"\n"\n\n"x', "", "\n", "tail\r\nof windows", " blank "]
    return [(str(i), "".join(dice.choices(words, k=dice.randint(0, 4))), dice.choice(words)) for i in range(300)]


def written(folder, rows):
    folder.mkdir()
    for part in range(2):
        with open(folder / f"part-{part}.csv", "w", newline="") as file:
            out = csv.writer(file, lineterminator="\n")
            out.writerow(["id", "note", "label"])
            out.writerows(rows[part::2])
    return str(folder)


@pytest.mark.parametrize("split_bytes", ["64", "700", "1m"])
def test_cells_that_span_lines(spark, tmp_path, rows, split_bytes):
    path = written(tmp_path / "t", rows)
    settings = {"spark.sql.files.maxPartitionBytes": split_bytes, "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        table = read_cells(spark, path, multi_line=True)
        if split_bytes == "64":
            assert table.df.rdd.getNumPartitions() > 50
        got = sorted(tuple(c.strip(" ") for c in r["cells"]) for r in table.df.collect())
        back = sorted((r["id"], r["note"]) for r in read_table(spark, path, multi_line=True).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert table.columns == ["id", "note", "label"] and got == sorted((i, note.strip(" "), label.strip(" ")) for i, note, label in rows)
    assert back == sorted((i, note.strip() or None) for i, note, _ in rows)


def test_open_quotes_and_headers(spark, tmp_path, rows):
    path = written(tmp_path / "t", rows)
    (tmp_path / "t" / "part-9.csv").write_text("id,note\n1,x\n")
    with pytest.raises(ValueError, match="different headers"):
        read_cells(spark, path, multi_line=True)
    (tmp_path / "open.csv").write_text('id,note\n1,"x\n2,y\n')
    with pytest.raises(Exception, match="not closed"):
        read_cells(spark, str(tmp_path / "open.csv"), multi_line=True).df.collect()
    (tmp_path / "none.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        read_cells(spark, str(tmp_path / "none.csv"), multi_line=True)
