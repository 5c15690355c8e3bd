"""Landed minute files as a stream: those that are due, oldest first, a few a batch, going on from the checkpoint."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ferrule.sources.feeds import DELAY_MINUTES, MOST_FILES, REACH_MINUTES

#: A minute in a file's name, and lines that a task hands on at a time.
MINUTE, LINES = re.compile(r"(?<!\d)(\d{12})(?:00)?(?!\d)"), 50_000


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def landed(path: str) -> list[tuple[str, str]]:
    """(minute as yyyyMMddHHmm, path) of the files below a folder whose names hold a minute, oldest first; hidden ones and parts being written don't count."""
    from pyarrow import fs

    system, root = _files(path)
    scheme = path.partition("://")[0] + "://" if "://" in path else ""
    found = []
    for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.type == fs.FileType.File and not info.base_name.startswith((".", "_")) and (met := MINUTE.search(info.base_name)):
            found.append((met[1], posixpath.join(path, info.base_name) if scheme else info.path))
    return sorted(found)


class _DueFiles(SimpleDataSourceStreamReader):
    """An offset is the last minute read and the first of its batch, so that a batch that is read again has the same files however late it is by then."""

    def __init__(self, options):
        self.path = options["path"]
        self.now = options.get("now")
        self.delay, self.reach, self.most = (int(options.get(n, d)) for n, d in (("delay", DELAY_MINUTES), ("reach", REACH_MINUTES), ("most", MOST_FILES)))

    def initialOffset(self) -> dict:
        return {"first": "", "last": ""}

    def read(self, start: dict):
        now = datetime.fromisoformat(self.now) if self.now else datetime.now(UTC).replace(tzinfo=None)
        oldest, newest = ((now - timedelta(minutes=m)).replace(second=0, microsecond=0).strftime("%Y%m%d%H%M") for m in (self.reach, self.delay))
        due = [f for f in landed(self.path) if max(oldest, start["last"] + "~" if start["last"] else "") <= f[0] <= newest][: self.most]
        if not due:
            return iter([]), start
        return iter(due), {"first": due[0][0], "last": due[-1][0]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([f for f in landed(self.path) if end["first"] <= f[0] <= end["last"] and f[0] > start["last"]][: self.most])


class MinuteFiles(DataSource):
    """Format ferrule_minutes, options path, delay, reach, most and, for tests, now: (minute, path) of landed files."""

    @classmethod
    def name(cls) -> str:
        return "ferrule_minutes"

    def schema(self) -> str:
        return "minute string, path string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _DueFiles(self.options)


def minute_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream of (minute, path): files below path that are DELAY_MINUTES to REACH_MINUTES old, each once, oldest first, MOST_FILES a batch.

    The driver sees names only. What got older than REACH_MINUTES before it was read is passed over, as in minute_files().
    """
    spark.dataSource.register(MinuteFiles)
    return spark.readStream.format("ferrule_minutes").options(path=path, **options).load()


def lines_of(files: DataFrame) -> DataFrame:
    """(minute, path, line, value): the lines of files (minute, path), numbered from 0, read where the rows are and a part at a time; compression goes by the name."""

    def run(batches) -> Iterator:
        import io

        import pandas as pd

        for batch in batches:
            for minute, path in zip(batch["minute"], batch["path"]):
                system, place = _files(path)
                held: list = []
                with io.TextIOWrapper(system.open_input_stream(place, compression="detect"), encoding="utf-8", errors="replace", newline="\n") as text:
                    for n, value in enumerate(text):
                        held.append((minute, path, n, value.removesuffix("\n").removesuffix("\r")))
                        if len(held) == LINES:
                            yield pd.DataFrame(held, columns=["minute", "path", "line", "value"])
                            held = []
                yield pd.DataFrame(held, columns=["minute", "path", "line", "value"]).astype({"line": "int64"})

    return files.mapInPandas(run, "minute string, path string, line long, value string")
