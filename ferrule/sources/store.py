"""Tables of the evidence store: Parquet folders and a log of commits, so that readers never see half a write and writers never lose another's.

A commit is a file path/_log/NUMBER.json, and the whole made of it later NUMBER.whole.json, which names its folder. It is made whole beside its place and then moved there, which fails where there is one already, so
of two writers one gets the number and the other looks at what came before it goes on. Beside a folder its filters tell for each file which keys it may hold.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators.quality import merge_state

#: Slices of the hashes of keys, by which filters are kept and asked; bits for a key in a filter, and how many of them a key sets.
SLICES, BITS, MARKS = 64, 16, 4
FILTER = "file string, slice int, rows long, least string, greatest string, bits binary"


@dataclass(frozen=True)
class Commit:
    """kind: version, a whole table, or added, rows on top. writer and batch tell whose it is and of which of its batches. tried: where the folder stood before it got its name."""

    number: int
    kind: str
    tried: str
    writer: str | None = None
    batch: int | None = None

    @property
    def folder(self) -> str:
        return f"{self.kind}-{self.number}"

    @property
    def filters(self) -> str:
        return f"_filters-{self.folder}"


class _Files:
    """Files below a path, on whatever file system it is."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path, self.new_array = spark.sparkContext._jvm, path, spark.sparkContext._gateway.new_array
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.system = self.of("").getFileSystem(self.conf)

    def of(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self.system.exists(self.of(name))

    def names(self, folder: str = "") -> list[str]:
        return [s.getPath().getName() for s in self.system.listStatus(self.of(folder))] if self.exists(folder) else []

    def read(self, name: str) -> str:
        stream = self.system.open(self.of(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Put a whole file in its place unless there is one; whether there was none."""
        beside = f"{name.rpartition('/')[0]}/_{uuid.uuid4().hex}"
        stream = self.system.create(self.of(beside), True)
        stream.write(text.encode())
        stream.close()
        fs = self.jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(self.system.getUri(), self.conf)
        none = self.new_array(fs.Options.Rename, 1)
        none[0] = fs.Options.Rename.NONE
        try:
            context.rename(self.system.makeQualified(self.of(beside)), self.system.makeQualified(self.of(name)), none)
            return True
        except Py4JJavaError as error:
            self.system.delete(self.of(beside), False)
            if "FileAlreadyExists" not in str(error.java_exception):
                raise
            return False

    def move(self, old: str, new: str) -> None:
        self.system.delete(self.of(new), True)  # a try that was never committed
        if not self.system.rename(self.of(old), self.of(new)):
            raise OSError(f"{self.path}/{old} could not be moved to {new}")


def commits(spark: SparkSession, path: str) -> dict[int, Commit]:
    """Commits of a table by their number; the whole that compact() made of a commit and all before stands for it."""
    files = _Files(spark, path)
    names = sorted(n for n in files.names("_log") if n.endswith(".json"))  # a number's own file comes before that of its whole
    return {c.number: c for c in (Commit(**json.loads(files.read(f"_log/{n}"))) for n in names)}


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the commits of a table; an addition is one."""
    return list(commits(spark, path))


def _standing(known: dict[int, Commit]) -> list[Commit]:
    """The last whole version and what was added after it."""
    whole = max((n for n, c in known.items() if c.kind == "version"), default=-1)
    return [c for n, c in known.items() if n >= whole]


def _place(files: _Files, commit: Commit) -> str:
    """Where a commit's folder stands, also between its commit and its renaming."""
    return commit.folder if files.exists(f"{commit.folder}/_SUCCESS") else commit.tried


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The last whole version and what was added after it."""
    files = _Files(spark, path)
    now = [f"{path}/{_place(files, c)}" for c in _standing(commits(spark, path))]
    return spark.read.parquet(*now) if now else None


def _hashed(key: str) -> tuple[Column, Column, Column]:
    """mark, slice and key as text; a null key is filed as an empty one."""
    mark = F.xxhash64(F.col(key).cast("string"))
    return mark.alias("mark"), F.pmod(mark, F.lit(SLICES)).cast("int").alias("slice"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key")


def _marks(hashes, size: int):
    """Places that keys of these hashes set in a filter of size bits, a power of two, a row for each key."""
    import numpy as np

    h = hashes.astype(np.uint64)[:, None]
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h // np.uint64(SLICES) + np.arange(MARKS, dtype=np.uint64) * step) & np.uint64(size - 1)


def _write_filters(spark: SparkSession, folder: str, key: str, to: str) -> None:
    """What each file of a folder may hold, by slices: rows, least and greatest key as text, and a Bloom filter."""

    def build(held):
        import numpy as np
        import pandas as pd

        size = 1 << max(6, (BITS * len(held)).bit_length())
        bits = np.zeros(size, np.uint8)
        bits[_marks(held["mark"].to_numpy(), size).ravel()] = 1
        file, part = held["file"].iloc[0], held["slice"].iloc[0]
        return pd.DataFrame([(file, part, len(held), held["key"].min(), held["key"].max(), np.packbits(bits).tobytes())], columns=["file", "slice", "rows", "least", "greatest", "bits"], dtype=object)

    rows = spark.read.parquet(folder).select(F.col("_metadata.file_name").alias("file"), *_hashed(key))
    rows.groupBy("file", "slice").applyInPandas(build, FILTER).write.parquet(to)


def _may_hold(keys: DataFrame, filters: DataFrame) -> list[str]:
    """Files of filters that may hold one of keys (mark, slice, key): those whose range and Bloom filter a key of the slice passes."""

    def test(asked, filters):
        import numpy as np
        import pandas as pd

        marks, key = asked["mark"].to_numpy(), asked["key"]
        hit = []
        for place, least, greatest, bits in zip(filters["place"], filters["least"], filters["greatest"], filters["bits"]):
            inside = marks[((key >= least) & (key <= greatest)).to_numpy()]
            held = np.unpackbits(np.frombuffer(bits, np.uint8))
            if len(inside) and held[_marks(inside, len(held))].all(axis=1).any():
                hit.append(place)
        return pd.DataFrame({"place": pd.Series(hit, dtype=object)})

    found = keys.groupBy("slice").cogroup(filters.groupBy("slice")).applyInPandas(test, "place string")
    return [r.place for r in found.distinct().collect()]


def holders(spark: SparkSession, path: str, keys: DataFrame, key: str, among: list[Commit] | None = None) -> list[str]:
    """Paths of the files that may hold one of the keys in the column key of keys. Folders without filters count whole."""
    files, found, filters = _Files(spark, path), [], None
    for c in _standing(commits(spark, path)) if among is None else among:
        place = f"{path}/{_place(files, c)}"
        if not files.exists(f"{c.filters}/_SUCCESS"):
            found.append(place)
            continue
        more = spark.read.schema(FILTER).parquet(f"{path}/{c.filters}").withColumn("place", F.concat(F.lit(f"{place}/"), "file"))
        filters = more if filters is None else filters.unionByName(more)
    if filters is None:
        return found
    return found + _may_hold(keys.select(*_hashed(key)), filters)


def _commit(df: DataFrame, path: str, kind: str, number: int, key: str | None = None, writer: str | None = None, batch: int | None = None, entry: str = "") -> bool:
    """Write df and commit it under a number; whether that was free."""
    spark, tried = df.sparkSession, f"_tried-{uuid.uuid4().hex}"
    files = _Files(spark, path)
    dealt = df if key is None else df.repartition(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(SLICES))).sortWithinPartitions(key)
    dealt.write.parquet(f"{path}/{tried}")
    if key is not None:
        _write_filters(spark, f"{path}/{tried}", key, f"{path}/_filters{tried}")
    done = Commit(number, kind, tried, writer, batch)
    if not files.create(f"_log/{number:09}{entry}.json", json.dumps(asdict(done))):
        for name in (tried, f"_filters{tried}"):
            files.system.delete(files.of(name), True)
        return False
    files.move(tried, done.folder)
    if key is not None:
        files.move(f"_filters{tried}", done.filters)
    return True


def write(df: DataFrame, path: str, version: int | None = None, kind: str = "version") -> int:
    """Write df as the next version, or as the one named. kind added: only rows that come on top.

    A number that is committed stays as it is: a batch tried again changes nothing.
    """
    while True:
        known = commits(df.sparkSession, path)
        if version is not None and version in known:
            return version
        number = version if version is not None else max(known, default=-1) + 1
        if _commit(df, path, kind, number):
            return number


def append_new(rows: DataFrame, path: str, key: str, version: int | None = None, writer: str | None = None) -> int:
    """Add rows whose key the table doesn't have, each key once; the number of the commit. A null key is a key.

    version is the number of the commit, or with a writer, the number of that writer's batch: what is committed under it stays, so a batch may be tried
    any number of times. Of the table, only keys are read, and only in files whose filter may hold one of the rows' keys. If another writer gets the number
    first, its keys are looked at too before the next one is tried.
    """
    spark, left, seen = rows.sparkSession, rows.dropDuplicates([key]), set()
    while True:
        known = commits(spark, path)
        mine = [n for n, c in known.items() if ((c.writer, c.batch) == (writer, version) if writer is not None else n == version)]
        if version is not None and mine:
            return mine[0]
        standing = _standing(known)
        fresh = [c for c in standing if c.number not in seen]
        seen |= {c.number for c in standing}
        held = holders(spark, path, left, key, fresh)
        if held:
            old = spark.read.parquet(*held).select(F.col(key).alias("_held"))
            left = left.join(old, F.col(key).eqNullSafe(F.col("_held")), "left_anti")
        columns = read(spark, path).columns if standing else left.columns
        number = version if version is not None and writer is None else max(known, default=-1) + 1
        if _commit(left.select(*columns), path, "added" if standing else "version", number, key, writer, version):
            return number


def compact(spark: SparkSession, path: str, key: str | None = None) -> int | None:
    """Write the table as one whole version, once additions are many; None for no table.

    The whole gets the number of the last addition, which it stands for with all before it, so that the numbers of a stream's batches stay free and
    what is added meanwhile comes on top. With a key it gets filters.
    """
    known = commits(spark, path)
    last = max(known, default=None)
    if last is not None and known[last].kind == "added":
        _commit(read(spark, path), path, "version", last, key, known[last].writer, known[last].batch, ".whole")
    return last


def upsert_state(rows: DataFrame, path: str, keys: list[str], version: int | None = None) -> int:
    """Merge rows of collector states: nulls keep what was there."""
    old = read(rows.sparkSession, path)
    return write(rows if old is None else merge_state(old, rows, keys), path, version)


def merge_documents(old: DataFrame, new: DataFrame, key: str = "url", kept: tuple[str, ...] = ("filed_at", "first_retrieved_at")) -> DataFrame:
    """Cached documents after an update: a known key takes all columns of its new row but the times it was first seen with; new keys are added."""
    was = old.select(key, *(F.col(c).alias(f"_{c}") for c in kept), F.lit(True).alias("_known"))
    fresh = new.join(was, key, "left").select(*(F.when(F.col("_known"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in kept else F.col(c) for c in new.columns))
    return old.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(fresh)


def hits_and_misses(wanted: DataFrame, cache: DataFrame, parser_version: str, key: str = "url") -> tuple[DataFrame, DataFrame]:
    """Cached rows of this parser version for what is wanted, and what has to be parsed."""
    current = cache.where(F.col("parser_version") == parser_version)
    return current.join(wanted.select(key), key, "left_semi"), wanted.join(current.select(key), key, "left_anti")


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of each table."""
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("rows")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
