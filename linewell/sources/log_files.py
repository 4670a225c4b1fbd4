"""JSON-lines logs on files: read in byte ranges with the place of each line, in batches and as streams, audited and appended to.

A log is a folder of files whose names are in the order of the log. Ranges of a file are read apart; a line belongs to the range that it
starts in. The number of a line is its number in the range plus the lines of all ranges ahead of it, so a file of any size is
numbered without being read by one task.
"""
from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from linewell.functions.joins import lookup, materialise
from linewell.operators import chain

RANGE_BYTES = 32 << 20
CHUNK = 1 << 20
EDGE = 1 << 14     # read at a time behind the end of a range
TASKS = 256        # ranges of few bytes share tasks beyond that many
LINES = "log_id string, file string, first_byte long, nth long, offset long, line string"
RECORD = "seq long, recorded_utc string, kind string, body string, prev string, hash string"


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


@dataclass
class Ranges(InputPartition):
    """Neighbouring ranges that one task reads."""
    parts: list[Range]


def dealt(parts: list[Range]) -> list[Ranges]:
    """Ranges in order, dealt to about ``TASKS`` tasks; a task gets ``RANGE_BYTES`` at most, or one range."""
    share = min(RANGE_BYTES, sum(r.end - r.start for r in parts) // TASKS)
    out, held = [], 0
    for r in parts:
        if not out or held + r.end - r.start > share:
            out.append(Ranges([]))
            held = 0
        out[-1].parts.append(r)
        held += r.end - r.start
    return out


def listed(root: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of all logs under a folder, by name."""
    fs, path = pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.base_name.endswith((".jsonl", ".txt")) and not f.base_name.startswith((".", "_")))


def opened(root: str, file: str):
    fs = pafs.FileSystem.from_uri(root)[0] if "://" in root or root.startswith("file:") else pafs.LocalFileSystem()
    return fs.open_input_file(file)


def ranges(file: str, start: int, end: int, size: int) -> list[Range]:
    return [Range(file, a, min(a + size, end)) for a in range(start, end, size)]


def lines_of(root: str, part: Range) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that start in a range; the last one may end behind it. A last line without an end counts."""
    with opened(root, part.file) as f:
        at = part.start
        if at > 0:   # a line that starts here has the end of another in front of it
            f.seek(at - 1)
            at -= 1
        buffer, used, skip = b"", 0, part.start > 0
        while True:
            cut = buffer.find(b"\n", used)
            if cut < 0:
                more = f.read(min(CHUNK, max(part.end - f.tell(), EDGE)))
                if more:
                    buffer, used = buffer[used:] + more, 0
                    continue
                if used < len(buffer) and not skip and at < part.end:
                    yield at, buffer[used:]
                return
            line = buffer[used:cut]
            start, at, used = at, at + cut + 1 - used, cut + 1
            if skip:
                skip = False
            elif start < part.end:
                yield start, line
            if at >= part.end:
                return


def batches(root: str, part: Range) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, bytes]] = []
    number, size = 0, 0

    def made() -> pa.RecordBatch:
        n = len(held)
        log = log_of(part.file)
        columns = [pa.array([log] * n), pa.array([part.file] * n), pa.array([part.start] * n, pa.int64()), pa.array(range(number - n, number), pa.int64()),
                   pa.array([h[0] for h in held], pa.int64()), pa.array([h[1].decode("utf-8", "replace") for h in held])]
        return pa.RecordBatch.from_arrays(columns, ["log_id", "file", "first_byte", "nth", "offset", "line"])

    for offset, line in lines_of(root, part):
        held.append((offset, line))
        number, size = number + 1, size + len(line)
        if size >= CHUNK or len(held) >= 10_000:
            yield made()
            held, size = [], 0
    if held:
        yield made()


class LogReader(DataSourceReader):
    def __init__(self, root: str, size: int, skipped: frozenset[str] = frozenset()):
        self.root, self.size, self.skipped = root, size, skipped

    def partitions(self) -> list[InputPartition]:
        return dealt([r for file, end in listed(self.root) if file not in self.skipped for r in ranges(file, 0, end, self.size)])

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for part in partition.parts if partition is not None else ():
            yield from batches(self.root, part)


class LogStreamReader(DataSourceStreamReader):
    """Offsets are bytes per file, always at the end of a line: lines that are still being written wait."""

    def __init__(self, root: str, size: int):
        self.root, self.size = root, size

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {file: whole for file, end in listed(self.root) if (whole := self.last_end(file, end))}

    def last_end(self, file: str, end: int) -> int:
        with opened(self.root, file) as f:
            while end > 0:
                start = max(0, end - CHUNK)
                f.seek(start)
                cut = f.read(end - start).rfind(b"\n")
                if cut >= 0:
                    return start + cut + 1
                end = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return dealt([r for file, to in sorted(end.items()) for r in ranges(file, start.get(file, 0), to, self.size)])

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for part in partition.parts:
            yield from batches(self.root, part)

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    """``format("log_lines")`` with the option path (a folder of logs: log/file.jsonl) and, if need be, rangebytes."""

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return LINES

    def _args(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES))

    def reader(self, schema) -> LogReader:
        return LogReader(*self._args(), frozenset(json.loads(self.options.get("skipped", "[]"))))

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(*self._args())


def read_lines(spark: SparkSession, root: str, range_bytes: int = RANGE_BYTES, skipped: list[str] | None = None) -> DataFrame:
    """(log_id, pos, file, offset, line) of all logs under a folder; blank lines are no records and have no place. Places count from
    the first line that isn't in a ``skipped`` file."""
    spark.dataSource.register(LogSource)
    raw = spark.read.format("log_lines").option("rangebytes", range_bytes).option("skipped", json.dumps(skipped or [])).load(root)
    solid = raw.filter(F.trim("line") != "")
    own = Window.partitionBy("log_id", "file", "first_byte").orderBy("nth")   # one range of bounded bytes
    counts = solid.groupBy("log_id", "file", "first_byte").agg(F.count(F.lit(1)).alias("n"))
    ahead = counts.select("log_id", "file", "first_byte", (F.sum("n").over(Window.partitionBy("log_id").orderBy("file", "first_byte").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("ahead"))
    placed = lookup(solid.withColumn("own", F.row_number().over(own) - 1), ahead, ["log_id", "file", "first_byte"], "inner")
    return placed.select("log_id", (F.col("ahead") + F.col("own")).alias("pos"), "file", "offset", "line")


def stream_lines(spark: SparkSession, root: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(log_id, file, offset, line) as lines are added. A line keeps its offset, so a reader that starts again neither loses nor repeats it."""
    spark.dataSource.register(LogSource)
    return spark.readStream.format("log_lines").option("rangebytes", range_bytes).load(root).filter(F.trim("line") != "").select("log_id", "file", "offset", "line")


def records(lines: DataFrame) -> DataFrame:
    """The fields of each line; a line that is no record has nulls in all of them."""
    rest = [c for c in lines.columns if c != "line"]
    return lines.select(*rest, F.from_json("line", RECORD).alias("r")).select(*rest, "r.*")


def read_records(spark: SparkSession, root: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of all logs with their place, ready for ``chain.audit``: a line that was taken out, moved or changed shows."""
    return records(read_lines(spark, root, range_bytes))


MARKS = "_marks.json"
VERDICT = "log_id string, records long, intact boolean, first_bad long, problem string"


def stamps(root: str) -> dict[str, dict[str, list[int]]]:
    """Per log its files in order, each with its bytes and time of change."""
    fs, path = pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)
    out: dict[str, dict[str, list[int]]] = {}
    for file, _ in listed(root):
        info = fs.get_file_info(file)
        out.setdefault(log_of(file), {})[file] = [info.size, info.mtime_ns]
    return out


def log_of(file: str) -> str:
    return file.rsplit("/", 2)[1].removeprefix("log_id=")   # as partitioned writes name folders


def marks_of(root: str, new: dict | None = None) -> dict:
    """What was verified last: per log its files with their stamps, the number of records and the last hash. ``new`` replaces it."""
    fs, path = pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)
    file = f"{path}/{MARKS}"
    if new is not None:
        fs.create_dir(path)
        with fs.open_output_stream(f"{file}.new") as out:
            out.write(json.dumps(new).encode())
        fs.move(f"{file}.new", file)
        return new
    if fs.get_file_info(file).type == pafs.FileType.NotFound:
        return {}
    with fs.open_input_file(file) as f:
        return json.loads(f.read())


def audit_files(spark: SparkSession, root: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``chain.audit`` of the logs under a folder that reads what has changed since the last one.

    Files of an intact log are marked with their size and time of change, and the log with its last hash. Where all marked files
    are as they were, the audit goes on behind the mark; where one isn't, its log is read whole again. (A change that leaves
    size and time as they were needs ``chain.audit`` of ``read_records``.)
    """
    now, marks = stamps(root), marks_of(root)
    held = {log: m for log, m in marks.items() if list(now.get(log, {}).items())[:len(m["files"])] == list(m["files"].items())}
    rest = records(read_lines(spark, root, range_bytes, [f for m in held.values() for f in m["files"]]))
    ends = spark.createDataFrame([(log, m["records"] - 1, m["hash"]) for log, m in held.items()], "log_id string, pos long, hash string")
    moved = rest.join(F.broadcast(ends.select("log_id", (F.col("pos") + 1).alias("ahead"))), "log_id", "left").withColumn("pos", F.col("pos") + F.coalesce("ahead", F.lit(0))).drop("ahead")
    moved = materialise(moved, "new-records")
    state = chain.audit(moved, verified=ends).join(moved.groupBy("log_id").agg(F.max_by("hash", "pos").alias("last")), "log_id")
    found = {r["log_id"]: r for r in state.collect()}   # a row per log
    rows, new = [], {}
    for log in sorted({*found, *held}):
        ahead, r = held[log]["records"] if log in held else 0, found.get(log)
        rows.append((log, ahead, True, None, None) if r is None else (log, ahead + r["records"], r["intact"], r["first_bad"], r["problem"]))
        if rows[-1][2]:
            new[log] = {"files": now[log], "records": rows[-1][1], "hash": held[log]["hash"] if r is None else r["last"]}
    marks_of(root, new)
    return spark.createDataFrame(rows, VERDICT)


def append_records(rows: DataFrame, root: str) -> dict[str, str]:
    """Seals rows (log_id, ord, recorded_utc, kind, body) onto the logs under ``root``, each as one new file; returns what was
    refused: the problem of each log whose chain is broken. Rows of sound logs are added, those of the others aren't. Only what has
    changed since the last audit is read (see ``audit_files``)."""
    spark = rows.sparkSession
    state = audit_files(spark, root)
    broken = {r["log_id"]: r["problem"] for r in state.filter("not intact").join(rows.select("log_id").distinct(), "log_id", "left_semi").collect()}   # logs of this append
    tails = spark.createDataFrame([(log, m["records"] - 1, m["hash"]) for log, m in marks_of(root).items()], "log_id string, seq long, hash string")
    sealed = chain.seal(rows.join(state.filter("not intact").select("log_id"), "log_id", "left_anti"), tails)
    fields = ["seq", "recorded_utc", "kind", "body", "prev", "hash"]

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the chain comes through in order, log by log; a file gets its name when it is whole
        now, out, names = None, None, []
        fs, base = pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)

        def close() -> None:
            if out is not None:
                out.close()
                fs.move(names[-1][0], names[-1][1])

        for part in parts:
            for r in part.to_pylist():
                if r["log_id"] != now:
                    close()
                    now = r["log_id"]
                    fs.create_dir(f"{base}/{now}")
                    name = f"{r['seq']:020d}.jsonl"
                    names.append((f"{base}/{now}/.{name}", f"{base}/{now}/{name}"))
                    out = fs.open_output_stream(names[-1][0])
                out.write((json.dumps({f: r[f] for f in fields}, ensure_ascii=False, separators=(",", ":")) + "\n").encode())
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n[1] for n in names], pa.string())], ["file"])

    sealed.mapInArrow(write, "file string").collect()
    return broken
