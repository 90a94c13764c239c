"""Large quoted CSV files in many tasks, and rows in file order."""

import csv
import io
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamis.operators import splits
from tamis.sources import csv_blocks, store
from tamis.sources.roles import ColumnRoles

SCHEMA = "a string, b string, c string"


def one_task(spark, path):
    return spark.read.schema(SCHEMA).options(header=True, multiLine=True, quote='"', escape='"').csv(path)


@pytest.fixture
def small_blocks(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def of(size):
        for n in names:
            spark.conf.set(n, str(size))

    yield of
    for n, value in zip(names, before):
        spark.conf.set(n, value)


def written(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return str(folder)


def hard_texts(n, seed):
    rng = random.Random(seed)
    parts = ['"', '""', ",", "\n", "x", "word ", "\n\n", "a,b\n", '","', "é", '"\n"', "   "]
    return [["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(3)] for _ in range(n)]


def spelled(rows, end="\n"):
    out = io.StringIO()
    writer = csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator=end)
    writer.writerow(["a", "b", "c"])
    writer.writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("size", [40, 300, 1 << 20])
def test_rows_are_those_of_one_task_and_in_order(spark, tmp_path, small_blocks, size):
    rows = hard_texts(150, 4)
    path = written(tmp_path / "csv", "one.csv", spelled(rows))
    small_blocks(size)
    got = csv_blocks.read_records(spark, path, SCHEMA).orderBy(csv_blocks.POSITION).collect()
    assert [r[csv_blocks.POSITION] for r in got] == list(range(150))
    small_blocks(1 << 20)
    # The reader takes quoted nothing for null, as the one-task reader does.
    assert [[x or None for x in r] for r in rows] == [list(r)[:3] for r in got]
    assert [list(r) for r in one_task(spark, path).collect()] == [list(r)[:3] for r in got]


STRAY = 'a,b,c\nx"y,2,3\n"q"junk,"z\n1",5\n\n,"",\n"a ""b"" \n c",it"s,"\n"\n7,"8,\n,9",  "10\nlast,"1""",2'


@pytest.mark.parametrize("size", [1, 7, 12, 1000])
def test_quotes_where_none_belong(spark, tmp_path, small_blocks, size):
    path = written(tmp_path / "csv", "stray.csv", STRAY)
    small_blocks(1 << 20)
    want = sorted(map(str, one_task(spark, path).collect()))
    small_blocks(size)
    got = csv_blocks.read_records(spark, path, SCHEMA).drop(csv_blocks.POSITION).collect()
    assert sorted(map(str, got)) == want


def test_carriage_returns_short_rows_and_files_without_rows(spark, tmp_path, small_blocks):
    path = written(tmp_path / "csv", "1.csv", 'a,b,c\r\n1,"x\r\ny",3\r\n4\r\n')
    written(tmp_path / "csv", "2.csv", "a,b,c\n")
    written(tmp_path / "csv", "3.csv", "")
    written(tmp_path / "csv", "4.csv", "\n\na,b,c\n\n5,6,7\n")
    small_blocks(9)
    got = csv_blocks.read_records(spark, path, SCHEMA).orderBy(csv_blocks.POSITION).collect()
    assert [tuple(r) for r in got] == [("1", "x\r\ny", "3", 0), ("4", None, None, 1), ("5", "6", "7", 2)]


def test_tasks_grow_with_the_file(spark, tmp_path, small_blocks):
    path = written(tmp_path / "csv", "one.csv", spelled([["1", "line\nbreak, \"quoted\"", str(i)] for i in range(4000)]))
    small_blocks(16_000)
    rows = csv_blocks.read_records(spark, path, SCHEMA)
    tasks = rows.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= os.path.getsize(f"{path}/one.csv") / 16_000 / 2
    assert rows.agg(F.count("*"), F.count_distinct("c"), F.max(csv_blocks.POSITION)).first()[:] == (4000, 4000, 3999)


def plain_states(text, quoted):
    """Character by character: a quote opens a field at its start only, and closes it unless doubled."""
    i, start = 0, not quoted
    open_ = quoted
    while i < len(text):
        c = text[i]
        if open_:
            if c == '"' and text[i + 1 : i + 2] == '"':
                i += 1
            elif c == '"':
                open_ = False
        elif c == '"' and start:
            open_ = True
        start = not open_ and c == ","
        i += 1
    return open_


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet='",x ', max_size=30), st.booleans())
def test_states_at_the_ends_of_lines(line, quoted):
    assert csv_blocks.ends_quoted(line, quoted) == plain_states(line, quoted)


@pytest.mark.parametrize("size", [60, 1 << 20])
def test_the_cap_takes_the_first_posts_of_the_file(spark, tmp_path, small_blocks, size):
    rng = random.Random(1)
    rows = [[f"a{rng.randint(0, 3)}", f"text\n{i}", "l"] for i in range(120)]
    path = written(tmp_path / "csv", "posts.csv", spelled(rows))
    small_blocks(size)
    docs = ColumnRoles(text="b", label="c", author="a").bind(csv_blocks.read_records(spark, path, SCHEMA))
    got = sorted(r["doc_id"] for r in splits.cap_per_author(docs, 7).collect())
    seen, want = {}, []
    for i, (author, _, _) in enumerate(rows):
        seen[author] = seen.get(author, 0) + 1
        if seen[author] <= 7:
            want.append(i)
    assert got == want


def test_positions_in_parquet_files(spark, tmp_path):
    path = str(tmp_path / "table")
    for part in range(3):
        spark.range(part * 100, part * 100 + 50).coalesce(1).write.mode("append").parquet(path)
    got = csv_blocks.parquet_with_positions(spark, path)
    by_file = {}
    for r in spark.read.parquet(path).select("id", F.col("_metadata.file_path").alias("f")).collect():
        by_file.setdefault(r["f"], []).append(r["id"])
    want = [i for f in sorted(by_file) for i in sorted(by_file[f])]
    assert [r["id"] for r in got.orderBy(csv_blocks.POSITION).collect()] == want
    assert sorted(r[csv_blocks.POSITION] for r in got.collect()) == list(range(150))


def test_read_posts_reads_as_one_task_does(spark, tmp_path):
    rows = [(" lead", "", 'q"uo,te\n'), (None, "x", "line\nbreak"), ("", "\n", '"'), ("tail ", None, None)]
    path = str(tmp_path / "posts")
    store.write_posts(spark.createDataFrame(rows, SCHEMA), path)
    got = sorted(map(str, store.read_posts(spark, path, SCHEMA).collect()))
    assert got == sorted(map(str, one_task(spark, path).collect()))
    assert len(got) == 4 and any("q\"uo,te\\n" in x for x in got)
