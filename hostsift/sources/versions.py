"""Key tables that grow while others read them: an append-only manifest of versions over files by hash bucket.

Every addition writes a folder of bucket files and then the next version's manifest, whose name is claimed by a rename that
fails if it exists. Until then nobody sees the files, so a crash in between leaves the old version, and of two writers the
second starts again on the first one's version. A reader takes the newest manifest and sticks to it. Folders of the same level
are merged eight at a time into one of the next level, so however many additions there are, a bucket has a few files.

A small batch reads only the buckets that its own keys fall in. A large one reads the version as a bucketed table, which needs
no exchange.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostsift.session import exists

#: Folders of a level that are merged into one.
FAN = 8
#: Spark's own writer puts the bucket's number behind the last underscore of a file's name.
_BUCKET = re.compile(r"_(\d+)(?:\.[^_]*)?$")


class Taken(Exception):
    """Another writer has made this version."""


@dataclass(frozen=True)
class Folder:
    path: str
    level: int
    files: dict[int, list[str]]  # of each bucket


@dataclass(frozen=True)
class Version:
    number: int = 0
    folders: tuple[Folder, ...] = ()
    applied: dict[str, int] = field(default_factory=dict)  # last batch of each writer

    def text(self) -> str:
        folders = [{"path": f.path, "level": f.level, "files": f.files} for f in self.folders]
        return json.dumps({"number": self.number, "folders": folders, "applied": self.applied})

    @staticmethod
    def parse(text: str) -> Version:
        v = json.loads(text)
        folders = tuple(Folder(f["path"], f["level"], {int(b): n for b, n in f["files"].items()}) for f in v["folders"])
        return Version(v["number"], folders, v["applied"])


class KeyTable:
    """Rows dealt by the hash of ``key``, one for each value of ``unique`` (the key itself unless stated)."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, unique: Sequence[str] = (), buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.unique = list(unique) or [key]
        self.schema = spark.createDataFrame([], schema).schema

    # --- versions

    def _fs(self):
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        return jvm, folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        _, folder, fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v-(\d+)\.json", n)))

    def version(self, number: int) -> Version:
        rows = self.spark.read.option("wholetext", "true").text(f"{self.path}/manifest/v-{number:012d}.json").collect()
        return Version.parse(rows[0].value)

    def current(self) -> Version:
        numbers = self.versions()
        return self.version(numbers[-1]) if numbers else Version()

    def _commit(self, version: Version) -> Version:
        """Make this the next version, unless another writer has."""
        jvm, folder, fs = self._fs()
        fs.mkdirs(folder)
        draft = jvm.org.apache.hadoop.fs.Path(folder, f".draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(version.text().encode()))
        out.close()
        name = jvm.org.apache.hadoop.fs.Path(folder, f"v-{version.number:012d}.json")
        how = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, name, how)
        except Py4JJavaError as error:
            fs.delete(draft, False)
            if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                raise Taken(version.number) from None
            raise
        return version

    # --- reading

    def bucket(self, key: Column) -> Column:
        """Where Spark's own bucketing puts a key."""
        return F.pmod(F.hash(key), F.lit(self.buckets))

    def read(self, buckets: Sequence[int] | None = None, version: Version | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets; no other files are opened."""
        version = version or self.current()
        wanted = None if buckets is None else set(buckets)
        files = [
            f"{self.path}/{folder.path}/{name}"
            for folder in version.folders for b, names in folder.files.items() if wanted is None or b in wanted for name in names
        ]
        return self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets that the keys fall in, at most as many as there are."""
        return [r["b"] for r in keys.select(self.bucket(F.col(self.key)).alias("b")).distinct().collect()]

    def bucketed(self, version: Version | None = None) -> DataFrame:
        """The rows of a version as a bucketed table: joins and groups by the key need no exchange on its side."""
        version = version or self.current()
        if not version.folders:
            return self.spark.createDataFrame([], self.schema)
        name = f"key_table_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        self.spark.sql(
            f"CREATE TABLE {name} ({columns}, _folder STRING) USING parquet PARTITIONED BY (_folder) "
            f"CLUSTERED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        for folder in version.folders:
            self.spark.sql(f"ALTER TABLE {name} ADD PARTITION (_folder = '{folder.path}') LOCATION '{self.path}/{folder.path}'")
        return self.spark.table(name).drop("_folder")

    # --- writing

    def _write(self, rows: DataFrame, level: int) -> Folder:
        folder, name = f"data-{uuid.uuid4().hex}", f"written_{uuid.uuid4().hex}"
        dealt = rows.select(*self.schema.names).repartition(self.buckets, F.col(self.key))  # one file a bucket
        dealt.write.bucketBy(self.buckets, self.key).option("path", f"{self.path}/{folder}").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # its files stay
        jvm, _, fs = self._fs()
        files: dict[int, list[str]] = {}
        for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")):
            file = status.getPath().getName()
            if file.startswith("part-"):
                files.setdefault(int(_BUCKET.search(file)[1]), []).append(file)
        return Folder(folder, level, files)

    def add(self, rows: DataFrame, writer: str = "", batch: int | None = None, large: bool = False) -> Version:
        """The version with those rows whose ``unique`` columns it didn't have; of equal ones in ``rows`` the least row.

        A batch that its writer has added already changes nothing, so a repeated micro-batch does no harm. Rows with a null key
        are left out. ``large``: read the whole table bucketed, rather than the buckets that the rows fall in.
        """
        others = [c for c in self.schema.names if c not in self.unique]
        rows = rows.where(F.col(self.key).isNotNull()).select(*self.schema.names)
        if others:
            rows = rows.groupBy(*self.unique).agg(F.min(F.struct(*others)).alias("_row")).select(*self.unique, "_row.*")
        else:
            rows = rows.distinct()
        rows = rows.persist()
        try:
            while True:
                now = self.current()
                if batch is not None and now.applied.get(writer, -1) >= batch:
                    return now
                stored = self.bucketed(now) if large else self.read(self.touched(rows), now)
                fresh = self._write(rows.join(stored.select(*self.unique), self.unique, "left_anti"), 0)
                applied = now.applied if batch is None else now.applied | {writer: batch}
                try:
                    made = self._commit(Version(now.number + 1, (*now.folders, *([fresh] if fresh.files else [])), applied))
                except Taken:
                    continue  # what the other writer added is known by now
                return self.merged(made)
        finally:
            rows.unpersist()

    def combined(self, rows: DataFrame) -> DataFrame:
        """What is left of rows of several folders when they are merged into one."""
        return rows

    def merged(self, now: Version | None = None, fan: int = FAN) -> Version:
        """Merge folders of a level that has ``fan`` of them; gives up if a writer comes in between, as the next addition tries again."""
        now = now or self.current()
        while full := [level for level, n in Counter(f.level for f in now.folders).items() if n >= fan]:
            level = min(full)
            few = [f for f in now.folders if f.level == level]
            rest = tuple(f for f in now.folders if f.level != level)
            whole = self._write(self.combined(self.read(version=replace(now, folders=tuple(few)))), level + 1)
            try:
                now = self._commit(replace(now, number=now.number + 1, folders=(*rest, whole)))
            except Taken:
                return self.current()
        return now

    def folders_on_disk(self) -> Iterator[str]:
        jvm, _, fs = self._fs()
        for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(self.path)):
            if status.isDirectory() and status.getPath().getName().startswith("data-"):
                yield status.getPath().getName()

    def vacuum(self, keep: int = 2) -> int:
        """Delete manifests but the newest ``keep``, and folders that none of these names; no writer may be at work."""
        if not exists(self.spark, f"{self.path}/manifest"):
            return 0
        jvm, manifest, fs = self._fs()
        numbers = self.versions()
        used = {f.path for n in numbers[-keep:] for f in self.version(n).folders}
        gone = [name for name in self.folders_on_disk() if name not in used]
        for n in numbers[:-keep]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(manifest, f"v-{n:012d}.json"), False)
        for name in gone:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)
        return len(gone)


class SumTable(KeyTable):
    """Partial sums that are added batch by batch: no row is left out, and rows that ``combine`` makes one are merged."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, combine, buckets: int = 8):
        super().__init__(spark, path, schema, key, buckets=buckets)
        self.combine = combine

    def combined(self, rows: DataFrame) -> DataFrame:
        return self.combine(rows)

    def add(self, rows: DataFrame, writer: str = "", batch: int | None = None, large: bool = False) -> Version:
        while True:
            now = self.current()
            if batch is not None and now.applied.get(writer, -1) >= batch:
                return now
            fresh = self._write(self.combine(rows.select(*self.schema.names)), 0)
            applied = now.applied if batch is None else now.applied | {writer: batch}
            try:
                made = self._commit(Version(now.number + 1, (*now.folders, *([fresh] if fresh.files else [])), applied))
            except Taken:
                continue
            return self.merged(made)

    def totals(self) -> DataFrame:
        return self.combine(self.read())
