"""CSV with quoted line breaks, read by many tasks however large a file is.

Whether a line break ends a record depends on how many quotes stand before it in the file. Spark's text
reader cuts files into blocks of lines; a first pass counts the quotes of each block. As a doubled quote keeps
parity, the parity of a block's start is the sum over the blocks before it, one small row a block. Knowing it, a second pass reads
the beginnings of blocks only: headers, and what a block goes on with of the record before it. A third one puts the lines of
each block together to records, the last of them with the beginnings of the blocks after it. Where beginnings are too long for the
driver to hold (``HELD``), what a block goes on with and what it does not end are picked in a pass of their own and stitched after a shuffle.

A text of many short lines has far more lines than records, so nothing is done line by line in Python: lines are counted and joined
in Arrow, and carry numbers only. A file goes by a 64-bit hash of its path.

All passes must cut files alike. Spark derives the cut from ``spark.sql.files.*`` and the cores of the cluster; where
the latter change between passes, set ``spark.sql.files.minPartitionNum``. A block the first pass has not seen ends the query
with an error.
"""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of the beginnings of all blocks that the driver holds, and of one.
HELD, HELD_OF_BLOCK = 64 << 20, 1 << 20
#: Lines of a partition that the beginning of its only block is looked for in.
FIRST_LINES = 100_000
#: Blocks whose first lines are marked, so that other lines need no columns for file and block.
MARKED = 1000

LEAD, TAIL, HEADER_TAIL = range(3)
BOM = "\ufeff"
CUT = "files were cut otherwise in a later pass: set spark.sql.files.minPartitionNum"
Batches = Iterator[pa.RecordBatch]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, value: lines without their line feed, in the order of the block."""
    return spark.read.text(path, lineSep="\n").select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def _runs(batches: Batches) -> Iterator[tuple[int, int, pa.Array]]:
    """Lines of one block that lie together in a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        cuts = np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield int(files[a]), int(blocks[a]), batch.column(2)[a:b]


def marked_lines(lines: DataFrame, firsts: list[int]) -> DataFrame:
    """value: lines, the first of each block with its file and block before it, set off by line feeds, which lines have none of."""
    mark = f"monotonically_increasing_id() IN ({', '.join(map(str, firsts))})"
    return lines.selectExpr(f"CASE WHEN {mark} THEN concat('\\n', file, ' ', block, '\\n', value) ELSE value END AS value")


def _marked_runs(batches: Batches) -> Iterator[tuple[int, int, pa.Array]]:
    """``_runs`` of marked lines."""
    file = block = None
    for batch in batches:
        values = batch.column(0)
        marks = np.flatnonzero(pc.starts_with(values, "\n").to_numpy(zero_copy_only=False)).tolist()
        edges = [*marks, len(values)]
        if edges[0]:
            if file is None:
                raise ValueError(CUT)
            yield file, block, values[: edges[0]]
        for a, b in zip(edges, edges[1:], strict=False):
            _, name, line = values[a].as_py().split("\n")
            file, block = map(int, name.split())
            yield file, block, pa.concat_arrays([pa.array([line], values.type), values[a + 1 : b]])


def _quotes(values: pa.Array) -> np.ndarray:
    return pc.count_substring(values, '"').to_numpy(zero_copy_only=False)


def _joined(parts: list[pa.Array], ends: np.ndarray | None = None) -> pa.Array:
    """Lines to texts, the last line of each given by ``ends``; one text of all lines where it is None."""
    lines = pa.concat_arrays(parts)
    offsets = np.append(0, [len(lines)] if ends is None else ends + 1)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lines), "\n")


def _unbroken(records: pa.Array) -> pa.Array:
    """Records that end with a carriage return without it, and with line feeds only."""
    ended = pc.ends_with(records, "\r")
    if not pc.any(ended).as_py():
        return records
    bare = pc.replace_substring(pc.utf8_slice_codeunits(records, 0, -1), "\r\n", "\n")
    return pc.if_else(ended, bare, records)


class _Block:
    """The lines of one block, run by run, as records and fragments; without ``whole``, records are made up to the header only."""

    def __init__(self, file: int, block: int, inside: bool, whole: bool):
        self.file, self.block, self.inside, self.whole = file, block, inside, whole
        self.open: list[pa.Array] = []
        self.lead, self.first = inside, block == 0
        self.header: str | None = None
        self.n = 0
        self.fragments: list[tuple[int, str]] = []

    def records(self, values: pa.Array) -> pa.Array | None:
        """The records that end in these lines, but the header."""
        self.n += len(values)
        after = (np.cumsum(_quotes(values)) + self.inside) % 2
        self.inside = bool(after[-1])
        ends = np.flatnonzero(after == 0)
        if self.lead and len(ends):
            self.fragments.append((LEAD, _joined([*self.open, values[: ends[0] + 1]])[0].as_py()))
            self.lead, self.open = False, []
            values, ends = values[ends[0] + 1 :], ends[1:] - ends[0] - 1
        found = None
        if len(ends):
            if self.whole or self.first:
                before = sum(map(len, self.open))
                found = self._after_header(_unbroken(_joined([*self.open, values[: ends[-1] + 1]], ends + before)))
            self.open, values = [], values[ends[-1] + 1 :]
        if len(values):
            self.open.append(values)
        return found if self.whole else None

    def _after_header(self, records: pa.Array) -> pa.Array:
        at = 0
        while self.first and at < len(records):
            text = records[at].as_py().removeprefix(BOM)
            at += 1
            if text:
                self.header, self.first = text, False
        return (rest := records[at:]).filter(pc.greater(pc.binary_length(rest), 0))

    def end(self) -> list[tuple[int, str]]:
        """Fragments, as no line follows."""
        if self.open:
            kind = LEAD if self.lead else HEADER_TAIL if self.first else TAIL
            text = _joined(self.open)[0].as_py()
            self.fragments.append((kind, text.removeprefix(BOM) if self.first else text))
        return self.fragments


def _starts_inside(inside: dict, file: int, block: int) -> bool:
    if (file, block) not in inside:
        raise ValueError(CUT)
    return inside[file, block]


def block_quotes(lines: DataFrame) -> DataFrame:
    """part, file, block, odd, n, first: whether the quotes of each block are odd, the partition that reads it, its lines and the first of them."""
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    placed = lines.withColumns({"part": F.spark_partition_id(), "line": F.monotonically_increasing_id()})
    return placed.groupBy("part", "file", "block").agg(
        (F.sum(quotes) % 2 == 1).alias("odd"), F.count("*").alias("n"), F.min("line").alias("first")
    )


_OPENINGS = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("header", pa.string()), ("lead", pa.string()), ("closed", pa.bool_())])


def _openings(inside: dict, cut: set, most: int) -> Callable[[Batches], Batches]:
    """The header of a first block, or what another block goes on with of a record, and whether it ends that record.

    A block without row has a longer one than ``most`` bytes or, where it is in ``cut``, than the lines that are there.
    """

    def read(batches: Batches) -> Batches:
        rows: list[dict] = []
        now: _Block | None = None

        def found(header: str | None = None, lead: str | None = None, closed: bool = False) -> None:
            if lead is None or len(lead.encode()) <= most:
                rows.append({"file": now.file, "block": now.block, "header": header, "lead": lead, "closed": closed})

        def ended() -> None:
            if now is not None and now.lead and now.open and (now.file, now.block) not in cut:
                found(lead=now.end()[0][1])

        for file, block, values in _runs(batches):
            if now is None or (now.file, now.block) != (file, block):
                ended()
                now = _Block(file, block, _starts_inside(inside, file, block), False)
                seeks, size = now.first or now.lead, 0
            if not seeks:
                continue
            now.records(values)
            if now.header is not None:
                found(header=now.header)
            elif now.fragments:
                found(lead=now.fragments[0][1], closed=True)
            elif (size := size + values.nbytes) <= 2 * most + (1 << 20):
                continue
            # It is found, or not for the driver.
            seeks, now.open, now.lead = False, [], False
        ended()
        yield pa.RecordBatch.from_pylist(rows, _OPENINGS)

    return read


def _blocks(inside: dict, whole: bool, runs: Iterator[tuple[int, int, pa.Array]]) -> Iterator[tuple[_Block, pa.Array | None]]:
    """Each block with the records of each of its runs, and with None once it has ended."""
    now: _Block | None = None
    for file, block, values in runs:
        if now is None or (now.file, now.block) != (file, block):
            if now is not None:
                yield now, None
            now = _Block(file, block, _starts_inside(inside, file, block), whole)
        found = now.records(values)
        if found is not None and len(found):
            yield now, found
    if now is not None:
        yield now, None


def _whole_records(inside: dict, rest: dict | None, sizes: dict | None = None) -> Callable[[Batches], Batches]:
    """``rest`` is what follows the last, unended record of a block; None leaves that record out. ``sizes`` are the lines of each block of marked lines."""

    def read(batches: Batches) -> Batches:
        for block, records in _blocks(inside, True, _runs(batches) if sizes is None else _marked_runs(batches)):
            if records is None:
                if sizes is not None and block.n != sizes[block.file, block.block]:
                    raise ValueError(CUT)
                if rest is None or not block.open or block.lead:
                    continue
                after = rest.get((block.file, block.block))
                records = _unbroken(_joined([*block.open, *([] if after is None else [pa.array([after], block.open[0].type)])]))
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(block.file, pa.int64()), len(records)), records], ["file", "record"])

    return read


def _fragments(inside: dict) -> Callable[[Batches], Batches]:
    def read(batches: Batches) -> Batches:
        for block, records in _blocks(inside, False, _runs(batches)):
            if records is None and (found := block.end()):
                n = len(found)
                columns = {
                    "file": pa.array([block.file] * n, pa.int64()),
                    "block": pa.array([block.block] * n, pa.int64()),
                    "kind": pa.array([kind for kind, _ in found], pa.int32()),
                    "record": pa.array([text for _, text in found], pa.string()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return read


def _stitched(parts: DataFrame) -> DataFrame:
    """file, header, record of the records that run over the ends of blocks."""
    # A fragment that begins a record and those that go on with it share a number.
    begins = F.col("kind").isin(TAIL, HEADER_TAIL)
    begin = F.when(begins, F.col("block")).otherwise(
        F.max(F.when(begins, F.col("block"))).over(Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, -1))
    )
    pieces = parts.select("file", "block", "kind", "record", begin.alias("begin"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "record"))), lambda x: x["record"]), "\n")
    stitched = pieces.groupBy("file", "begin").agg(text.alias("record"), F.max("kind").alias("kind"))
    bare = F.replace(F.expr("left(record, length(record) - 1)"), F.lit("\r\n"), F.lit("\n"))
    ended = F.when(F.endswith("record", F.lit("\r")), bare).otherwise(F.col("record")).alias("record")
    return stitched.select("file", (F.col("kind") == HEADER_TAIL).alias("header"), ended)


def csv_records(spark: SparkSession, path: str) -> tuple[dict[int, str], DataFrame]:
    """The header of each file, and (file, record): the text of each other record.

    Quotes are doubled inside quotes. Records end with a line feed, or both carriage return and line feed, and in a record that
    ends with both such pairs inside quotes become line feeds. Blank ones are left out, as is a byte order mark. A file whose last quote is not closed ends with what is there.
    """
    lines = numbered_lines(spark, path)
    # One short row for each block of a file.
    survey = sorted(block_quotes(lines).collect(), key=lambda r: (r["file"], r["block"]))
    inside: dict[tuple[int, int], bool] = {}
    odd: dict[int, bool] = defaultdict(bool)
    blocks_of: dict[int, int] = defaultdict(int)
    for r in survey:
        inside[r["file"], r["block"]] = odd[r["file"]]
        odd[r["file"]] ^= r["odd"]
        blocks_of[r["part"]] += 1
    # Most blocks of a large file have a partition of their own, of which the first lines are enough.
    cut = {(r["file"], r["block"]) for r in survey if blocks_of[r["part"]] == 1 and r["n"] > FIRST_LINES}
    packed = [part for part, n in blocks_of.items() if n > 1]
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) < FIRST_LINES
    beginnings = lines.filter(first | F.spark_partition_id().isin(packed) if packed else first)
    most = min(HELD_OF_BLOCK, HELD // max(1, len(survey)))
    openings = beginnings.mapInArrow(_openings(inside, cut, most), "file long, block long, header string, lead string, closed boolean").collect()
    headers = {r["file"]: r["header"] for r in openings if r["header"] is not None}
    leads = {(r["file"], r["block"]): r for r in openings if r["lead"] is not None}
    if odd.keys() == headers.keys() and all(key in leads for key, within in inside.items() if within):
        rest, sizes = _rest(inside, leads), None
        if len(survey) <= MARKED:
            sizes = {(r["file"], r["block"]): r["n"] for r in survey}
            lines = marked_lines(lines, [r["first"] for r in survey]) if survey else lines.select("value")
        return headers, lines.mapInArrow(_whole_records(inside, rest, sizes), "file long, record string")
    stitched = _stitched(lines.mapInArrow(_fragments(inside), "file long, block long, kind int, record string"))
    if odd.keys() != headers.keys():
        # Headers that run over the end of a block, or files without any.
        headers |= {r["file"]: r["record"] for r in stitched.filter("header").collect()}
    whole = lines.mapInArrow(_whole_records(inside, None), "file long, record string")
    return headers, whole.unionByName(stitched.filter("NOT header").drop("header"))


def _rest(inside: dict[tuple[int, int], bool], leads: dict) -> dict[tuple[int, int], str]:
    """What follows the last, unended record of each block that has one, from the beginnings of the blocks after it."""
    rest: dict[tuple[int, int], str] = {}
    blocks, pieces = list(inside), []
    for before, key in reversed(list(zip(blocks, blocks[1:], strict=False))):
        if not inside[key]:
            continue
        pieces = [leads[key]["lead"]] if leads[key]["closed"] or not pieces else [leads[key]["lead"], *pieces]
        # A block that lies inside one record altogether is part of what follows an earlier one.
        if not inside[before] or leads[before]["closed"]:
            rest[before] = "\n".join(pieces)
            pieces = []
    return rest


def header_names(header: str) -> list[str]:
    return next(csv.reader([header], strict=False), []) if "\n" not in header else next(csv.reader(header.splitlines(keepends=True)), [])


def read_split_csv(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """The columns ``names`` (column of the result: name in the header) as text, by each file's own header.

    A missing column or an empty field is the empty string; a name that is repeated means its first column.
    """
    headers, rows = csv_records(spark, path)
    kinds = list(dict.fromkeys(headers.values()))
    if len(kinds) > 1:
        # One short row for each file.
        table = pa.table({"file": pa.array(headers, pa.int64()), "head": pa.array(headers.values(), pa.string())})
        rows = rows.join(F.broadcast(spark.createDataFrame(table)), "file")
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    picked = {name: F.lit("") for name in names}
    for kind in kinds:
        columns = header_names(kind)
        schema = ", ".join(f"c{i} string" for i in range(max(len(columns), 1)))
        parsed = F.from_csv("record", schema, options)
        for name, wanted in names.items():
            if wanted in columns:
                value = F.coalesce(parsed[f"c{columns.index(wanted)}"], F.lit(""))
                picked[name] = value if len(kinds) == 1 else F.when(F.col("head") == kind, value).otherwise(picked[name])
    return rows.select(*[value.alias(name) for name, value in picked.items()])
