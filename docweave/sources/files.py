"""Folders of files to documents, and chunk, feedback and example tables to files."""

from __future__ import annotations

import io
import os
import re
from collections import deque
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby, islice

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.operators.tables import written

# File extensions by the way they are read.
TEXT_TYPES = ["txt", "md", "py", "js", "ts", "html", "css", "java", "groovy", "text"]
ROW_TYPES = ["csv"]
VALUE_TYPES = ["json"]
ALL_TYPES = TEXT_TYPES + ROW_TYPES + VALUE_TYPES

#: Bytes that a task reads, about, and that it passes on at once; files that it passes on at once.
PART_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
BATCH_FILES = 10_000
#: Folders that are worth a task, and entries of a listing after which a task goes down no further.
TASK_FOLDERS = 64
WALKED = 10_000

SCHEMA = "source string, relative_path string, filename string, filetype string, text string"


def _described(df: DataFrame, folder: str) -> DataFrame:
    """Source columns from the file path; hidden files are never listed."""
    path = F.col("_path")
    root = F.regexp_replace(F.lit(folder.rstrip("/") + "/"), r"^file:/*", "/")
    plain = F.regexp_replace(path, r"^file:/*", "/")
    return df.select(
        plain.alias("source"),
        F.when(F.startswith(plain, root), F.replace(plain, root, F.lit(""))).otherwise(plain).alias("relative_path"),
        F.element_at(F.split(path, "/"), -1).alias("filename"),
        F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).alias("filetype"),
        "text",
    )


def _roots(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """The given files and folders, with patterns resolved; each must be there."""
    out = []
    for p in [paths] if isinstance(paths, str) else paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(p)
        found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
        if not len(found):
            raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {p}.")
        out += [re.sub("^file:/*", "/", f.getPath().toString()) for f in found]
    return out


class _Stores:
    """File systems of paths, each made once a task: ``/folder/file`` or ``scheme://host/folder/file``."""

    def __init__(self):
        self.known = {}

    def of(self, path: str) -> tuple[FileSystem, str]:
        top = re.match("(?:[^/:]+://[^/]*)?", path)[0]
        if top not in self.known:
            self.known[top] = FileSystem.from_uri(f"{top}/") if top else (LocalFileSystem(), "/")
        store, base = self.known[top]
        return store, base.rstrip("/") + path[len(top):]


def _reachable(roots: list[str]) -> bool:
    """Whether tasks know the stores of all roots; others are left to Spark's readers, which list them on the driver."""
    try:
        return all(_Stores().of(r) for r in roots)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _entries(path: str, root: bool, stores: _Stores) -> Iterator[tuple[str, int | None, int | None]]:
    """Path, size and milliseconds of the last change of what is in a folder, or of a file; a folder has no size."""
    store, at = stores.of(path)
    if root and (own := store.get_file_info(at)).type == FileType.File:
        if not _hidden(own.base_name):
            yield path, own.size, own.mtime_ns // 1_000_000
    elif isinstance(store, LocalFileSystem):
        with os.scandir(at) as found:  # as they come: a folder may have any number
            for e in found:
                if not _hidden(e.name) and os.path.exists(e.path):
                    s = e.stat()
                    yield (f"{path.rstrip('/')}/{e.name}", None, None) if e.is_dir() else (f"{path.rstrip('/')}/{e.name}", s.st_size, s.st_mtime_ns // 1_000_000)
    else:
        for e in store.get_file_info(FileSelector(at)):
            if not _hidden(e.base_name):
                yield f"{path.rstrip('/')}/{e.base_name}", None if e.type == FileType.Directory else e.size, e.mtime_ns and e.mtime_ns // 1_000_000


def _walked(paths: Iterator[str], root: bool) -> Iterator[tuple[str, int | None, int | None]]:
    stores, left = _Stores(), WALKED
    for path in paths:
        below = deque([(path, root)])
        while below:
            for entry in _entries(*below.popleft(), stores):
                left -= 1
                if entry[1] is None and left > 0:
                    below.append((entry[0], False))
                else:
                    yield entry


def _listed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(path, size, modified)`` of the files in folders and below that are not empty or hidden.

    A task lists its folders and goes on below them for some thousand entries; the folders it leaves are spread over tasks in a further round.
    """
    roots, found = _roots(spark, paths), []
    if not _reachable(roots):
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select(
            "path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified"))
    level, n, root = spark.createDataFrame([(r,) for r in roots], "path string"), len(roots), True
    while n:
        def look(batches: Iterator[pa.RecordBatch], root: bool = root) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified", pa.int64())])
            rows = _walked((path for batch in batches for path in batch.column(0).to_pylist()), root)
            while some := list(islice(rows, BATCH_FILES)):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*some), schema)], schema=schema)

        tasks = min(4 * spark.sparkContext.defaultParallelism, n // TASK_FOLDERS)
        level = level.repartition(tasks, "path") if tasks > 1 else level.coalesce(1)
        seen = written(level.mapInArrow(look, "path string, size bigint, modified bigint"))
        found.append(seen.filter("size > 0"))
        level, root = seen.filter("size is null").select("path"), False
        n = level.count()
    return reduce(DataFrame.unionByName, found)


def _of_types(listed: DataFrame, types: list[str]) -> DataFrame:
    return listed.filter(F.regexp_extract("path", r"\.([^./]+)$", 1).isin(types)).select("path", "size")


def _spread(files: DataFrame, *keys: str) -> DataFrame:
    """Over all cores, and partitions of about ``PART_BYTES`` of what is to be read."""
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return files.repartition(max(4 * files.sparkSession.sparkContext.defaultParallelism, -(-total // PART_BYTES)), *keys)


def _url(path: str) -> str:
    """As Spark names files: characters that a URL cannot hold are escaped."""
    return re.sub(r"[^-\w.!~'()*,;:$&+=@/\u0080-\U0010ffff]", lambda c: f"%{ord(c[0]):02X}", path)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += size(row)
        if n > BATCH_BYTES or len(held) >= BATCH_FILES:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)


def _opened(rows: Iterator[tuple], take: Callable[..., Iterator[tuple]]) -> Iterator[tuple]:
    """What ``take`` yields for the file of each row; what cannot be read any further is left."""
    stores = _Stores()
    for path, *more in rows:
        store, at = stores.of(path)
        try:
            yield from take(store, at, path, *more)
        except (FileNotFoundError, PermissionError):
            raise
        except OSError:
            continue


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))


def _whole(spark: SparkSession, paths, listed: DataFrame, types: list[str]) -> DataFrame:
    """``(_path, text)`` of whole files; tasks open the files of the list."""
    if not _reachable(_roots(spark, paths)):
        return (spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("pathGlobFilter", "*.{" + ",".join(types) + "}")
                .text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("_path"), F.col("value").alias("text")))

    def take(store: FileSystem, at: str, path: str) -> Iterator[tuple]:
        with store.open_input_stream(at) as f:
            yield _url(path), f.read()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(_opened(_rows(batches), take), pa.schema([("_path", pa.string()), ("text", pa.binary())]), lambda r: len(r[1]))

    files = _spread(_of_types(listed, types), "path").select("path")
    return files.mapInArrow(read, "_path string, text binary").withColumn("text", F.col("text").cast("string"))


def _lines(spark: SparkSession, paths, listed: DataFrame) -> DataFrame:
    """``(_path, _block, _at, value)``: the lines of CSV files, each in the block of its file where it begins."""
    if not _reachable(_roots(spark, paths)):
        return (spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("lineSep", "\n")
                .option("pathGlobFilter", "*.{" + ",".join(ROW_TYPES) + "}").text(paths)
                .select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
                        F.monotonically_increasing_id().alias("_at"), "value"))
    length = PART_BYTES

    def take(store: FileSystem, name: str, path: str, start: int) -> Iterator[tuple]:
        with io.BufferedReader(store.open_input_file(name), 1 << 20) as f:
            at = max(0, start - 1)
            f.seek(at)
            at += len(f.readline()) if start else 0
            while at < start + length and (line := f.readline()):
                yield _url(path), start, at, (line if at else line.removeprefix(b"\xef\xbb\xbf")).removesuffix(b"\n")
                at += len(line)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("_path", pa.string()), ("_block", pa.int64()), ("_at", pa.int64()), ("value", pa.binary())])
        yield from _batched(_opened(_rows(batches), take), schema, lambda r: len(r[3]))

    files = _of_types(listed, ROW_TYPES)
    blocks = _spread(files.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(length).cast("bigint")))).withColumn(
        "size", F.least(F.col("size") - F.col("block"), F.lit(length))), "path", "block").select("path", "block")
    return blocks.mapInArrow(read, "_path string, _block bigint, _at bigint, value binary").withColumn("value", F.col("value").cast("string"))


def _decoded(text: Column) -> Column:
    """Bytes that are no UTF-8 are left out."""
    return F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit(""))


# Parts of a CSV line: a quoted field with doubled quotes inside, and fields that are closed.
QUOTED = '"[^"]*+(?:""[^"]*+)*+'
CLOSED = f'(?:(?:{QUOTED}"[^,]*+|[^",][^,]*+|),)*+'
INSIDE = '[^"]*+(?:""[^"]*+)*+'
FIELD = f'(?:\\A|,)(?:{QUOTED}"[^,]*+|[^,]*+)'


def _state(before: Column, flips: Column, last: Column) -> Column:
    """Whether a line begins inside quotes: the last line that settles it and the flips since, or ``before`` and all flips."""
    return F.when(last.isNull(), (before + flips) % 2).otherwise((last["value"] + flips - last["flips"]) % 2)


def _steps(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``_flips`` and ``_last`` of the rows before each row, of rows that map the state by ``f0`` and ``f1``."""
    earlier = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    flip = ((F.col("f0") == 1) & (F.col("f1") == 0)).cast("bigint")
    settled = F.when(F.col("f0") == F.col("f1"), F.struct(F.col("f0").cast("bigint").alias("value"), F.col("_upto").alias("flips")))
    return df.withColumn("_upto", F.sum(flip).over(upto)).withColumn(
        "_flips", F.coalesce(F.sum(flip).over(earlier), F.lit(0))).withColumn("_last", F.last(settled, True).over(earlier))


def _records(spark: SparkSession, paths, listed: DataFrame) -> DataFrame:
    """``(_path, _rec, text)``: records of CSV files, however a line break in quotes and a file's splits cut them.

    Each line maps the state before it (outside or inside quotes) to the one behind it. The maps are composed inside a split
    of a file, then over the splits of each file, so no task reads a whole file.
    """
    outside = F.col("value").rlike(f"\\A{CLOSED}{QUOTED}\\z").cast("int")
    inside = F.col("value").rlike(f'\\A{INSIDE}(?:\\z|"[^,]*+,{CLOSED}{QUOTED}\\z)').cast("int")
    lines = written(_lines(spark, paths, listed).withColumns({"f0": outside, "f1": inside}))
    stepped = written(_steps(lines.drop("value"), ["_path", "_block"], ["_at"]).withColumns({
        f"s{k}": _state(F.lit(k), F.col("_flips"), F.col("_last")) for k in (0, 1)}).select("_path", "_block", "_at", "f0", "f1", "s0", "s1"))
    behind = {f"f{k}": F.max_by(F.when(F.col(f"s{k}") == 1, F.col("f1")).otherwise(F.col("f0")), "_at") for k in (0, 1)}
    splits = _steps(stepped.groupBy("_path", "_block").agg(*(e.alias(c) for c, e in behind.items())), ["_path"], ["_block"]).select(
        "_path", "_block", _state(F.lit(0), F.col("_flips"), F.col("_last")).alias("_enters"))
    begun = stepped.join(splits, ["_path", "_block"]).select(
        "_path", "_block", "_at", (F.when(F.col("_enters") == 1, F.col("s1")).otherwise(F.col("s0")) == 0).alias("_begins"))
    here = Window.partitionBy("_path", "_block").orderBy("_at")
    own = F.last(F.when(F.col("_begins"), F.struct("_block", "_at")), True).over(here)
    marked = written(begun.withColumn("_rec", own))
    latest = marked.groupBy("_path", "_block").agg(F.max("_rec").alias("_rec"))
    earlier = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select("_path", "_block", F.last("_rec", True).over(earlier).alias("_carried"))
    placed = marked.join(carried, ["_path", "_block"]).select("_path", "_block", "_at", F.coalesce("_rec", "_carried").alias("_rec"))
    joined = lines.select("_path", "_block", "_at", "value").join(placed, ["_path", "_block", "_at"])
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("_block", "_at", "value"))), lambda e: e["value"])
    return joined.groupBy("_path", "_rec").agg(F.regexp_replace(F.array_join(pieces, "\n"), "\r\\z", "").alias("text")).filter("text <> ''")


def _fields(record: Column) -> Column:
    """Values of a record: quotes around a field go, doubled ones inside count once."""
    tokens = F.regexp_extract_all(record, F.lit(FIELD), F.lit(0))
    plain = F.transform(tokens, lambda t: F.regexp_replace(t, "\\A,", ""))
    return F.transform(plain, lambda t: F.when(
        F.startswith(t, F.lit('"')), F.replace(F.regexp_extract(t, f'\\A"({INSIDE})"', 1), F.lit('""'), F.lit('"'))).otherwise(t))


def _csv_rows(spark: SparkSession, paths, listed: DataFrame) -> DataFrame:
    """One document per row, as ``column: value`` lines, under the header of its own file.

    Missing fields are empty, surplus ones are left out, blank lines are no records.
    """
    records = written(_records(spark, paths, listed).withColumn("fields", _fields(F.col("text"))).select("_path", "_rec", "fields"))
    heads = records.groupBy("_path").agg(F.min("_rec").alias("_rec")).join(records, ["_path", "_rec"]).select(
        "_path", F.col("_rec").alias("_first"), F.col("fields").alias("head"))
    named = records.join(heads, "_path").filter(F.col("_rec") != F.col("_first"))
    line = F.transform("head", lambda h, i: F.concat(h, F.lit(": "), F.coalesce(F.get("fields", i), F.lit(""))))
    return named.select("_path", F.array_join(line, "\n").alias("text"))


def load_files(spark: SparkSession, paths: str | list[str], types: list[str] | None = None, root: str = "") -> DataFrame:
    """Documents of files and folders, by extension; others are skipped.

    A file that cannot be read gives no document; neither does a missing folder.
    """
    wanted = ALL_TYPES if types is None else [t.lstrip(".").lower() for t in types if t.lstrip(".").lower() in ALL_TYPES]
    root = root or (paths if isinstance(paths, str) else "")
    parts = []
    try:
        listed = _listed(spark, paths) if wanted else None
        if whole := [t for t in wanted if t not in ROW_TYPES]:
            # one pass for texts and values
            is_value = F.regexp_extract("_path", r"\.([^./]+)$", 1).isin(VALUE_TYPES)
            parts.append(_whole(spark, paths, listed, whole).withColumn("text", F.when(is_value, F.to_json(F.try_parse_json("text"))).otherwise(
                _decoded(F.col("text")))).filter("text is not null"))
        if any(t in ROW_TYPES for t in wanted):
            parts.append(_csv_rows(spark, paths, listed))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        parts = []
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    return _described(reduce(DataFrame.unionByName, parts), root)


def with_doc_id(files: DataFrame) -> DataFrame:
    """Stable id from source and text, the same in every run and task."""
    return files.withColumn("doc_id", F.xxhash64("source", "text"))


def file_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Files and last change per extension, without reading contents."""
    return _listed(spark, folder).groupBy(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("filetype")).agg(
        F.count("*").alias("files"), F.timestamp_millis(F.max("modified")).alias("last_update"))


def write_files(lines: DataFrame, folder: str) -> None:
    """A file for each name of ``lines(name, line)``, with its lines in any order; null is an empty line.

    Tasks make the files at their place: a writer that partitions by name would leave the driver to move each one. Lines are
    written as they come, so a file of any size needs a batch of memory. A task that is run again writes the same files anew.
    """
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = FileSystem.from_uri(folder)
        rows, above = ((n, v) for b in batches for n, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), None
        for name, group in groupby(rows, lambda r: str(r[0])):
            at = f"{base.rstrip('/')}/{name}"
            inside = at.rpartition("/")[0]
            if above != (above := inside.rpartition("/")[0]):  # names come in order, so this is made once
                store.create_dir(above, recursive=True)
            store.create_dir(inside, recursive=False)
            with store.open_output_stream(at) as out:
                for _, line in group:
                    out.write(f"{line or ''}\n".encode())
            yield pa.record_batch([pa.array([name])], names=["name"])

    lines.select("name", "line").repartition("name").sortWithinPartitions("name").mapInArrow(put, "name string").write.format("noop").mode("overwrite").save()


def write_chunks_json(chunks: DataFrame, path: str, by: str | None = None) -> None:
    """Chunks as JSON lines; ``by`` names a low-cardinality column to lay them out by."""
    w = chunks.write.mode("overwrite")
    (w.partitionBy(by) if by else w).json(path)


def append_feedback(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)


def load_feedback(spark: SparkSession, path: str, newest: int | None = 10_000) -> DataFrame:
    """Newest entries of the feedback log; None reads all."""
    log = spark.read.parquet(path)
    return log.orderBy(F.desc("ts"), F.desc("entry_id")).limit(newest) if newest else log


def save_examples(examples: DataFrame, path: str) -> None:
    """Learned examples per category; a small table, replaced as a whole."""
    examples.write.mode("overwrite").parquet(path)
