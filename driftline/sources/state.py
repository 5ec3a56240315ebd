"""Tables that are changed by key and read while they are: every change is a whole new version, published at one stroke.

A version is a folder of Parquet files and a manifest that names it. The files are written first; the manifest is then
put in place by a rename that fails if another writer has taken the number. A reader takes the manifest with the highest
number, so it sees a whole version or the one before, also while a writer is at work or after one has died. Executors
write the files; the driver handles manifests only, a few hundred bytes each.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has published the version that this one was to be."""


class _Folder:
    """A store's folder by the file system of its path, whatever that is."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def numbers(self) -> list[int]:
        folder = self._path("manifests")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Write a file as a whole or not at all; False if it is there already.

        Where a rename never replaces a file, as in HDFS, this is atomic; elsewhere the look before it leaves a moment in
        which two writers may both pass, and one store needs one writer at a time.
        """
        draft = self._path(f"manifests/.{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        taken = self.fs.exists(self._path(name)) or not self.fs.rename(draft, self._path(name))
        if taken:
            self.fs.delete(draft, False)
        return not taken

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions, oldest first."""
    return _Folder(spark, path).numbers()


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """What is known of a version, of the newest by default; None where there is none."""
    folder = _Folder(spark, path)
    found = folder.numbers()
    number = version if version is not None else found[-1] if found else None
    return json.loads(folder.read(f"manifests/{number:010d}.json")) if number in found else None


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The rows of a version, of the newest by default; None where there is none."""
    known = manifest(spark, path, version)
    return spark.read.schema(known["schema"]).parquet(f"{path.rstrip('/')}/{known['folder']}") if known else None


def is_stale(known: dict | None, run: str) -> bool:
    """Whether a state is of another run than the current one; one that names no run is stale, none at all is not."""
    return bool(known and run) and known["about"].get("run", "") != run


def save(rows: DataFrame, path: str, about: dict | None = None, base: int | None = None) -> int:
    """Publish ``rows`` as the next version and return its number; ``about`` is kept in the manifest.

    With ``base`` the version is the one after that; a Conflict says that another writer was first, and nothing is changed.
    """
    spark = rows.sparkSession
    folder = _Folder(spark, path)
    found = folder.numbers()
    number = (base if base is not None else found[-1] if found else 0) + 1
    data = f"versions/{number:010d}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder.path}/{data}")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    known = {"version": number, "folder": data, "schema": schema, "saved_at": datetime.now(UTC).isoformat(timespec="seconds"), "about": about or {}}
    if not folder.publish(f"manifests/{number:010d}.json", json.dumps(known, ensure_ascii=False)):
        folder.delete(data)
        raise Conflict(f"version {number} of {path} is taken")
    return number


def upsert(rows: DataFrame, path: str, keys: list[str], order: str | None = None, about: dict | None = None, attempts: int = 5) -> int:
    """Put ``rows`` into the newest version by key, as a new version: a row of an earlier one with an equal key goes.

    Of rows with one key the last by ``order`` counts, any row where no order is given; nulls are keys like others. The
    columns must be those of the store. A writer that was overtaken starts again from the version that overtook it.
    """
    spark = rows.sparkSession
    rest = [c for c in rows.columns if c not in keys]
    by = F.struct(*([order] if order else []), *rest) if rest else F.lit(1)
    new = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_r")).select(*keys, "_r.*").select(rows.columns) if rest else rows.distinct()
    for _ in range(attempts):
        known = manifest(spark, path)
        whole = new
        if known:
            old = load(spark, path, known["version"])
            if set(old.columns) != set(rows.columns):
                raise ValueError(f"the store has {sorted(old.columns)}, the rows {sorted(rows.columns)}")
            a, b = old.alias("a"), new.select(*keys).alias("b")
            same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
            whole = a.join(b, same, "left_anti").unionByName(new)
        try:
            return save(whole, path, about, known["version"] if known else 0)
        except Conflict:
            continue
    raise Conflict(f"{path} was changed by others {attempts} times in a row")


def cleaned(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove all versions but the newest ``keep`` and return how many went; files of writers that died go with them.

    To be run while no writer is at work: what no manifest names is taken for what a dead one left.
    """
    folder = _Folder(spark, path)
    found = folder.numbers()
    gone = found[: max(len(found) - keep, 0)]
    kept = {json.loads(folder.read(f"manifests/{n:010d}.json"))["folder"] for n in found[len(gone) :]}
    for n in gone:
        folder.delete(f"manifests/{n:010d}.json")
    data = folder._path("versions")
    for status in folder.fs.listStatus(data) if folder.fs.exists(data) else []:
        name = f"versions/{status.getPath().getName()}"
        if name not in kept:
            folder.delete(name)
    return len(gone)
