"""Records of quoted CSV files and JSON lists whose line ends or brackets may lie inside values.

Where a record ends depends on everything before it, so such files are usually read by one task. Here each
split of a file is read on its own, twice. The first pass runs a small automaton from each state a split
can begin in and keeps where it ends: one small row per split. Composed along the file, these rows give
the state each split really begins in. The second pass cuts the records. What lies before the first or after
the last boundary of a split is a fragment; fragments are joined across splits, at most two a split.

Splits come from Spark's text reader with a separator that every record must contain: the line feed for
CSV, the closing brace for lists of JSON objects.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nodeflow.session import cut

SPLIT = "file string, at bigint, end0 int, end1 int, depth0 bigint, depth1 bigint, head string"
CUT = "file string, at bigint, kind int, first boolean, record string"
COMPLETE, HEAD, THROUGH, TAIL = 0, 1, 2, 3  # of a split without a boundary all is one fragment, THROUGH


def _scan(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    return spark.read.option("lineSep", separator).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))


def _runs(pdf: pd.DataFrame) -> Iterator[tuple[tuple[str, int], slice]]:
    """Rows of one split lie side by side."""
    file, at = pdf["file"].to_numpy(), pdf["at"].to_numpy()
    if len(pdf):
        edges = np.flatnonzero(np.concatenate(([True], (file[1:] != file[:-1]) | (at[1:] != at[:-1])))).tolist()
        for a, b in zip(edges, [*edges[1:], len(pdf)]):
            yield (file[a], int(at[a])), slice(a, b)


# ---- the two automata: each has a summary of a split and a cutter

def quoted_after(line: str, inside: bool, quote: str = '"', comma: str = ",") -> bool:
    """Whether a line that begins inside or outside of a quoted field ends inside of one.

    A quote opens a field only at its beginning; a doubled quote is one of the value.
    """
    at = 0
    if not inside:
        if not line.startswith(quote):
            at = line.find(comma + quote) + 2
            if at == 1:
                return False
        else:
            at = 1
    while True:
        end = line.find(quote, at)
        if end < 0:
            return True
        if line.startswith(quote, end + 1):
            at = end + 2
            continue
        at = line.find(comma + quote, end + 1) + 2
        if at == 1:
            return False


class CsvSplit:
    """Summary of a split of CSV lines."""

    def __init__(self):
        self.ends = [False, True]

    def add(self, values: list[str]) -> None:
        a, b = self.ends
        for line in values:
            if '"' in line:
                a, b = quoted_after(line, a), quoted_after(line, b) if a != b else None
                b = a if b is None else b
            elif not a and not b:
                continue
            # a line without quotes changes nothing
        self.ends = [a, b]

    def row(self) -> tuple:
        return int(self.ends[0]), int(self.ends[1]), 0, 0


class CsvCutter:
    """Records of a split of CSV lines; line ends inside values become line feeds."""

    def __init__(self, state: int, depth: int, at: int):
        self.inside, self.started, self.held, self.first = bool(state), not state, [], at == 0

    def _row(self, kind: int) -> tuple:
        record, self.held = "\n".join(self.held), []
        first, self.first = self.first and record != "", self.first and record == ""
        return kind, first, record

    def add(self, values: list[str]) -> Iterator[tuple]:
        for line in values:
            line = line[:-1] if line.endswith("\r") else line
            self.held.append(line)
            if '"' in line:
                self.inside = quoted_after(line, self.inside)
            if not self.inside:
                yield self._row(COMPLETE if self.started else HEAD)
                self.started = True

    def end(self) -> Iterator[tuple]:
        if self.held:
            yield self._row(TAIL if self.started else THROUGH)


def _structure(data: bytes, inside: bool):
    """Places of brackets and commas of JSON text, whether each lies outside of strings, and where the text ends."""
    b = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(b == 34)
    if len(quotes) and (b == 92).any():
        last = np.maximum.accumulate(np.where(b != 92, np.arange(len(b)), -1))  # the last sign that is no backslash
        before = np.maximum(quotes - 1, 0)
        quotes = quotes[(quotes == 0) | ((before - last[before]) % 2 == 0)]
    places = np.flatnonzero((b == 44) | (b == 91) | (b == 93) | (b == 123) | (b == 125))
    parity = (np.searchsorted(quotes, places) + int(inside)) % 2
    return b, places, parity == 0, bool((len(quotes) + int(inside)) % 2)


def _depths(signs: np.ndarray) -> np.ndarray:
    return ((signs == 91) | (signs == 123)).astype(np.int64) - ((signs == 93) | (signs == 125))


class JsonSplit:
    """Summary of a split of JSON text: quotes swap the state, brackets outside of strings add to the depth."""

    def __init__(self):
        self.swapped, self.depth = False, [0, 0]

    def add(self, values: list[str]) -> None:
        b, places, outside, inside = _structure(("}".join(values) + "}").encode(), False)
        step = _depths(b[places])
        both = int(step[outside].sum()), int(step[~outside].sum())
        for start in (0, 1):
            self.depth[start] += both[(start + self.swapped) % 2]
        self.swapped ^= inside

    def row(self) -> tuple:
        return int(self.swapped), 1 - int(self.swapped), *self.depth


class JsonCutter:
    """Elements of a list, cut at the commas of its own depth."""

    def __init__(self, state: int, depth: int, at: int):
        self.inside, self.depth, self.open, self.started, self.held = bool(state), depth, depth > 0, False, b""

    def add(self, values: list[str]) -> Iterator[tuple]:
        data = ("}".join(values) + "}").encode()
        b, places, outside, self.inside = _structure(data, self.inside)
        places = places[outside]
        signs = b[places]
        depth = self.depth + np.cumsum(_depths(signs))
        self.depth = int(depth[-1]) if len(depth) else self.depth
        edge = ((signs == 44) & (depth == 1)) | ((signs == 91) & (depth == 1)) | ((signs == 93) & (depth == 0))
        start = 0
        for p, sign, d in zip(places[edge].tolist(), signs[edge].tolist(), depth[edge].tolist()):
            if sign == 91 and self.open:
                continue  # depth 1 was reached before
            if self.open:
                yield COMPLETE if self.started else HEAD, False, (self.held + data[start:p]).decode()
            self.held, start, self.open, self.started = b"", p + 1, sign != 93, True
        if self.open:
            self.held += data[start:]

    def end(self) -> Iterator[tuple]:
        if self.open:
            yield TAIL if self.started else THROUGH, False, self.held.decode()


# ---- passes

def _summaries(scan: DataFrame, kind: type) -> DataFrame:
    """One row per split: the end of the automaton from state 0 and 1, what it adds to the depth, first sign."""
    def run(batches):
        key = split = None
        head = ""

        def row():
            return pd.DataFrame([(*key, *split.row(), head)], columns=[c.split()[0] for c in SPLIT.split(", ")])

        for pdf in batches:
            for found, part in _runs(pdf):
                if found != key:
                    if key is not None:
                        yield row()
                    key, split, head = found, kind(), ""
                values = pdf["value"].iloc[part].tolist()
                head = head or next((v.lstrip("\ufeff \t\r\n")[:1] for v in values if v.strip("\ufeff \t\r\n")), "")
                split.add(values)
        if key is not None:
            yield row()

    return scan.mapInPandas(run, SPLIT)


def _entered(splits: DataFrame) -> DataFrame:
    """(file, at, state, depth): how each split begins, composed along its file."""
    order = W.partitionBy("file").orderBy("at")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    swaps = (F.col("end0") == 1) & (F.col("end1") == 0)
    fixed = F.col("end0") == F.col("end1")
    marked = splits.withColumn("_s", F.sum(swaps.cast("int")).over(order)).withColumn(
        "_c", F.last(F.when(fixed, F.struct("end0", "_s")), True).over(before)).withColumn("_p", F.coalesce(F.lag("_s").over(order), F.lit(0)))
    state = F.when(F.col("_c").isNull(), F.col("_p") % 2).otherwise((F.col("_c.end0") + F.col("_p") - F.col("_c._s")) % 2)
    known = marked.withColumn("state", state.cast("int"))
    step = F.when(F.col("state") == 0, F.col("depth0")).otherwise(F.col("depth1"))
    return known.select("file", "at", "state", F.coalesce(F.sum(step).over(before), F.lit(0)).alias("depth"), "head")


def _cut_up(scan: DataFrame, entered: DataFrame, kind: type) -> DataFrame:
    """(file, at, kind, first, record) in the order of the file. ``entered`` has one row per split (128 MB by
    default), so 100 TB are 800,000 small rows for every task."""
    begins = entered.select(F.col("file").alias("_file"), F.col("at").alias("_at"), "state", "depth")
    known = scan.join(F.broadcast(begins), (F.col("file") == F.col("_file")) & (F.col("at") == F.col("_at"))).drop("_file", "_at")

    def run(batches):
        key = cutter = None

        def frame(rows):
            return pd.DataFrame([(*key, *r) for r in rows], columns=["file", "at", "kind", "first", "record"])

        for pdf in batches:
            for found, part in _runs(pdf):
                if found != key:
                    if key is not None:
                        yield frame(cutter.end())
                    one = pdf.iloc[part.start]
                    key, cutter = found, kind(int(one["state"]), int(one["depth"]), found[1])
                yield frame(cutter.add(pdf["value"].iloc[part].tolist()))
        if key is not None:
            yield frame(cutter.end())

    return known.mapInPandas(run, CUT)


def _stitched(pieces: DataFrame, joint: str) -> DataFrame:
    """(file, at, record): fragments joined across splits; a record belongs to the split it begins in."""
    fragments = pieces.where(F.col("kind") != COMPLETE)
    number = F.sum((F.col("kind") == TAIL).cast("int")).over(W.partitionBy("file").orderBy("at", "kind"))
    whole = fragments.withColumn("_g", number).where("_g > 0").groupBy("file", "_g").agg(
        F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("at", "kind", "record"))).alias("parts"))
    return whole.select("file", "at", F.array_join(F.col("parts.record"), joint).alias("record"))


def _numbered(complete: DataFrame, stitched: DataFrame, name: str, per_file: bool) -> DataFrame:
    """Both in one table, numbered from 0 in the order of the files (or of each file)."""
    marked = complete.withColumn("_id", F.monotonically_increasing_id())
    splits = marked.groupBy("file", "at").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"), F.lit(0).alias("_m")).unionByName(
        stitched.groupBy("file", "at").agg(F.lit(None).cast("bigint").alias("_first"), F.lit(0).cast("bigint").alias("_n"), F.count("*").cast("int").alias("_m")))
    splits = splits.groupBy("file", "at").agg(F.min("_first").alias("_first"), F.sum("_n").alias("_n"), F.sum("_m").alias("_m"))
    order = (W.partitionBy("file").orderBy("at") if per_file else W.partitionBy(F.lit(0)).orderBy("file", "at"))
    before = F.sum(F.col("_n") + F.col("_m")).over(order) - F.col("_n") - F.col("_m")
    offsets = cut(splits.select(F.col("file").alias("_file"), F.col("at").alias("_at"), "_first", "_n", before.alias("_before")))
    same = (F.col("file") == F.col("_file")) & (F.col("at") == F.col("_at"))
    left = marked.join(F.broadcast(offsets), same).withColumn(name, F.col("_before") + F.col("_id") - F.col("_first"))
    right = stitched.join(F.broadcast(offsets), same).withColumn(name, F.col("_before") + F.col("_n"))
    return left.drop("_id", "_file", "_at", "_first", "_n", "_before").unionByName(right.drop("_file", "_at", "_first", "_n", "_before"))


def csv_records(spark: SparkSession, path: str | list[str], kept, name: str = "idx") -> DataFrame:
    """Records of quoted CSV files as ``kept`` makes them, numbered by ``name`` after what it leaves out.

    ``kept(df)`` gets (file, at, first, record) and may only filter and compute columns; ``first`` marks the first
    record of a file. Empty records are left out. Line ends are line feeds, with or without a carriage return.
    """
    scan = _scan(spark, path, "\n")
    pieces = _cut_up(scan, cut(_entered(_summaries(scan, CsvSplit))), CsvCutter)
    complete = kept(pieces.where((F.col("kind") == COMPLETE) & (F.col("record") != "")).select("file", "at", "first", "record"))
    stitched = cut(_stitched(pieces, "\n").withColumn("first", F.lit(False)).select("file", "at", "first", "record"))
    return _numbered(complete, kept(stitched), name, per_file=False)


def json_list_elements(spark: SparkSession, path: str | list[str], name: str = "idx") -> tuple[DataFrame, DataFrame]:
    """(elements, other files): elements (file, record, idx) of files that hold a JSON list, numbered per file,
    and the files that hold something else."""
    scan = _scan(spark, path, "}")
    entered = cut(_entered(_summaries(scan, JsonSplit)))
    heads = entered.groupBy("file").agg(F.min_by("head", F.when(F.col("head") != "", F.col("at"))).alias("head"))
    lists = heads.where("head = '['").select("file")
    pieces = _cut_up(scan, entered.join(F.broadcast(lists), "file"), JsonCutter)
    complete = pieces.where((F.col("kind") == COMPLETE) & (F.trim("record") != "")).select("file", "at", "record")
    stitched = cut(_stitched(pieces, "").where(F.trim("record") != ""))
    return _numbered(complete, stitched, name, per_file=True).drop("at"), heads.where("head <> '['").select("file")


def header_of(record: Column, columns: list[str], options: dict) -> Column:
    """Whether a record names just these columns."""
    schema = ", ".join(f"c{k} string" for k in range(len(columns))) + ", _bad string"
    parsed = F.from_csv(record, schema, {**options, "columnNameOfCorruptRecord": "_bad"})
    same = parsed["_bad"].isNull()
    for k, c in enumerate(columns):
        same = same & (F.lower(parsed[f"c{k}"]).eqNullSafe(F.lit(c.lower())))
    return same
