"""CSV with quoted line breaks, read by many tasks per file, and positions in file order.

A line break inside quotes ends no record, and whether a byte stands inside quotes depends on all bytes
before it. So a first pass finds, for every block of a file, where each of the two states at its start
(between records, inside quotes) leads, and how many records begin in it. The states at the starts of
all blocks, and the number of records before each, follow from a prefix over this small table. A second
pass then cuts every block into records by itself; only records that cross blocks are joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Name of the column with a row's position among all rows, files in order of their paths.
POSITION = "_position"

#: Fields with their commas, then a quoted field that is still open. A field is quoted if it begins with a
#: quote; what stands between a closing quote and the comma belongs to it.
_LEAVES_OPEN = re.compile(r'(?:(?:"(?:[^"]|"")*+"[^,]*+|[^",][^,]*+)?,)*+"(?:[^"]|"")*+')
_QUOTED = re.compile(r'(?:[^"]|"")*+')


def ends_quoted(line: str, quoted: bool) -> bool:
    """Whether the end of a line stands inside quotes, by its start."""
    if '"' not in line:
        return quoted
    if quoted:
        closed = _QUOTED.match(line).end()
        if closed == len(line):
            return True
        comma = line.find(",", closed + 1)
        if comma < 0:
            return False
        line = line[comma + 1 :]
    return _LEAVES_OPEN.fullmatch(line) is not None


def _blank(line: str) -> bool:
    return line == "" or line == "\r"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str], bool]]:
    """``(file, block, lines, more)`` for runs of lines of one block; ``more`` where the block may go on."""
    for batch in batches:
        files, blocks = batch["file"].dictionary_encode(), batch["block"].to_pylist()
        names, lines = files.dictionary.to_pylist(), batch["value"].to_pylist()
        at = files.indices.to_pylist()
        start = 0
        for i in range(1, len(lines) + 1):
            if i == len(lines) or blocks[i] != blocks[start] or at[i] != at[start]:
                yield names[at[start]], blocks[start], lines[start:i], i == len(lines)
                start = i


def _surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block and state at its start: the state at its end, and the records that begin in it."""
    found: dict[tuple[str, int], list] = {}
    for file, block, lines, _ in _blocks(batches):
        state = found.setdefault((file, block), [False, True, 0, 0])
        for line in lines:
            for s in (0, 1):
                if not state[s] and not _blank(line):
                    state[2 + s] += 1
            if '"' in line:
                if state[0] == state[1]:
                    state[0] = state[1] = ends_quoted(line, state[0])
                else:
                    state[0], state[1] = ends_quoted(line, state[0]), ends_quoted(line, state[1])
    columns = [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int64())]
    for i, kind in enumerate((pa.bool_(), pa.bool_(), pa.int64(), pa.int64())):
        columns.append(pa.array([v[i] for v in found.values()], kind))
    yield pa.RecordBatch.from_arrays(columns, ["file", "block", "from_record", "from_quotes", "records", "records_in_quotes"])


def _starts(survey: list, header: bool) -> dict[tuple[str, int], tuple[bool, int, bool]]:
    """For each block whether it begins inside quotes, the position of its first record, and whether that
    record is a header, which has no position."""
    out, position, file = {}, 0, None
    for r in sorted(survey, key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, quoted, seen = r["file"], False, 0
        records = r["records_in_quotes"] if quoted else r["records"]
        titled = header and not seen and records > 0
        out[file, r["block"]] = (quoted, position - titled, titled)
        seen, position = seen + records, position + records - titled
        quoted = r["from_quotes"] if quoted else r["from_record"]
    return out


def read_records(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True) -> DataFrame:
    """The rows of CSV files with their ``POSITION``; files may be large and texts hold line breaks.

    Fields are separated by commas, quoted by double quotes and escaped by doubling them; records end with
    a line feed, a carriage return before it counted in. Empty lines are no records. ``schema`` names the
    columns in order; missing fields are null. The first pass runs at once; its result has one small row
    per block (by default 128 MB) and is held by the driver.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    surveyed = "file string, block bigint, from_record boolean, from_quotes boolean, records bigint, records_in_quotes bigint"
    survey = lines.mapInArrow(_surveyed, surveyed).groupBy("file", "block").agg(
        *[F.first(name).alias(name) for name in ("from_record", "from_quotes", "records", "records_in_quotes")]
    )
    starts = spark.sparkContext.broadcast(_starts(survey.collect(), header))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, positions, orders, wholes = [], [], [], []

        def put(text: str, position: int, order: int, whole: bool) -> None:
            texts.append(text)
            positions.append(position)
            orders.append(order)
            wholes.append(whole)

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()), pa.array(positions, pa.int64()), pa.array(orders, pa.int64()), pa.array(wholes, pa.bool_())],
                ["record", POSITION, "part", "whole"],
            )
            for values in (texts, positions, orders, wholes):
                values.clear()
            return made

        def left(open_: tuple) -> None:
            """What a block ends with in the middle of a record."""
            _, block, held, position, _, title = open_
            if held and not title:
                put("\n".join(held), position, block, False)

        # File, block, lines of the record at hand, its position, whether it began in this block, whether it is a header.
        at: tuple | None = None
        for file, block, lines, _ in _blocks(batches):
            if at is None or at[:2] != (file, block):
                if at:
                    left(at)
                quoted, position, title = starts.value[file, block]
                # A record that began before this block is the one before the block's first.
                held, begun, position = [], False, position - 1
                first = title
                at = (file, block, held, position, begun, False)
            held, position, begun, title = at[2], at[3], at[4], at[5]
            for line in lines:
                if not quoted:
                    if _blank(line):
                        continue
                    begun, position = True, position + 1
                    title, first = first, False
                held.append(line)
                quoted = ends_quoted(line, quoted)
                if not quoted:
                    if not title:
                        put("\n".join(held), position, block, begun)
                    held, begun, title = [], True, False
            at = (file, block, held, position, begun, title)
            yield batch()
        if at:
            left(at)
            yield batch()

    records = lines.mapInArrow(cut, f"record string, {POSITION} bigint, part bigint, whole boolean")
    pieces = records.where("not whole").groupBy(POSITION).agg(F.sort_array(F.collect_list(F.struct("part", "record"))).alias("pieces"))
    joined = pieces.select(F.array_join("pieces.record", "\n").alias("record"), POSITION)
    every = records.where("whole").select("record", POSITION).unionByName(joined)
    ddl = schema if isinstance(schema, str) else schema.toDDL()
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    parsed = F.from_csv(F.regexp_replace("record", "\r$", ""), ddl, options).alias("_row")
    return every.select(parsed, POSITION).select("_row.*", POSITION)


def parquet_with_positions(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table with ``POSITION``: files in order of their paths, rows in order inside them."""
    rows = spark.read.parquet(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = rows.groupBy("_file").agg(F.count("*").alias("n")).orderBy("_file").collect()
    before, offsets = 0, []
    for r in counts:
        offsets.append((r["_file"], before))
        before += r["n"]
    # One row per file.
    named = spark.createDataFrame(offsets, "_file string, _before bigint")
    placed = rows.join(named, "_file").withColumn(POSITION, F.col("_before") + F.col("_row"))
    return placed.drop("_file", "_row", "_before")
