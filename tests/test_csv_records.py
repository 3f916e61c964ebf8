"""CSV records cut in parallel: equal to a sequential reader, whatever the byte ranges."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from farebox.sources.csv_records import csv_records, ends_inside, read_csv_records
from farebox.sources.observations import read_observations_csv

FIELDS = ["plain", "", "with, comma", 'a "quoted" word', "two\nlines", '"', '""', "\n\n", 'x,"\n",y', " padded ", "end\n", "é日", '5" pipe']


def write(folder, texts):
    folder.mkdir()
    for i, text in enumerate(texts):
        (folder / f"part-{i}.csv").write_bytes(text.encode())
    return str(folder)


def made(rng, n, end="\n"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["A", "b", "C"])
    rows = [[rng.choice(FIELDS) for _ in range(3)] for _ in range(n)]
    writer.writerows(rows)
    return out.getvalue(), rows


@pytest.mark.parametrize("split", [40, 333, 10 ** 7])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ranges_of_any_size_give_the_same_records(spark, tmp_path, split, end):
    rng = random.Random(split)
    files = [made(rng, 60, end) for _ in range(3)]
    path = write(tmp_path / "csv", [text for text, _ in files])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        df = read_csv_records(spark, path)
        assert df.columns == ["A", "b", "C"]
        got = sorted(tuple(r[c] or "" for c in df.columns) for r in df.collect())
        ranges = spark.read.text(path).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert ranges > 10 or split > 40
    assert got == sorted(tuple(r) for _, rows in files for r in rows)


def test_line_function_equals_a_character_machine():
    def slow(line, inside):
        state = "in" if inside else "start"
        i = 0
        while i < len(line):
            c = line[i]
            if state == "in":
                if c == '"':
                    if line[i + 1:i + 2] == '"':
                        i += 1
                    else:
                        state = "field"
            elif c == ",":
                state = "start"
            elif c == '"' and state == "start":
                state = "in"
            else:
                state = "field"
            i += 1
        return state == "in"

    rng = random.Random(3)
    for _ in range(20000):
        line = "".join(rng.choices('",a', k=rng.randint(0, 12)))
        for inside in (False, True):
            assert ends_inside(line, inside) == slow(line, inside), (line, inside)


def test_observations_with_and_without_quotes(spark, tmp_path):
    text = 'Station,Line,Day,Hour,Riders\r\n"Union\nlower ""B"", north",1,Monday,6,10.5\r\n\r\nBay,NA,,24,N/A\r\nShort,2\r\n'
    df = read_observations_csv(spark, write(tmp_path / "a", [text]))
    rows = {r["station"]: tuple(r) for r in df.collect()}
    assert rows == {'Union\nlower "B", north': ('Union\nlower "B", north', "1", "Monday", "6", "10.5"),
                    "Bay": ("Bay", None, None, "24", None), "Short": ("Short", "2", None, None, None)}
    plain = text.replace('"Union\nlower ""B"", north"', "Union")
    again = read_observations_csv(spark, write(tmp_path / "b", [plain]))
    assert again.where(F.col("station") == "Bay").count() == 1 and again.count() == 3


def test_a_quote_left_open_and_empty_files(spark, tmp_path):
    path = write(tmp_path / "c", ['h1,h2\n1,"open\nto,the\nend', "h1,h2\n", 'h1,h2\n"x",y\n'])
    assert sorted(r["record"] for r in csv_records(spark, path).where("not first").collect()) == ['"x",y', '1,"open\nto,the\nend']
