"""Tables kept in versions: what a writer has written counts once its manifest is there, so a reader sees one whole
version, whether a later writer is at work, has been killed half-way, or has written nothing.

``<path>/data/<part>-<random>`` holds a part's files, ``<path>/manifests/<number>.json`` names the parts of a version. A
part written again replaces the one of that name and leaves the others as they are: a job that is run twice counts once.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Versions:
    """The versions of one table under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        self._fs = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Numbers of the versions there are, whole or not."""
        if not self._fs.exists(self._folder):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(self._folder))
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(\d+)\.json", n)))

    def _manifest_path(self, number: int):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{number:012d}.json")

    def manifest(self, number: int) -> dict | None:
        """What a version consists of; None if its writer did not get to the end."""
        stream = self._fs.open(self._manifest_path(number))
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()
        return found

    def last(self) -> tuple[int, dict]:
        """The last whole version; 0 without parts before the first."""
        for number in reversed(self.numbers()):
            found = self.manifest(number)
            if found is not None:
                return number, found
        return 0, {"parts": {}, "schema": None}

    def publish(self, df: DataFrame, part: str = "all", partition_by: Sequence[str] = ()) -> int:
        """Write ``df`` as a part and make it the table's; returns the new version. Only the last step, which writes the
        manifest, is seen by readers."""
        if not re.fullmatch(r"[\w.=-]+", part):
            raise ValueError(f"a part's name has letters, digits and ._=- only, not {part!r}")
        folder = f"data/{part}-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(f"{self.path}/{folder}")
        return self._commit({part: folder}, (), df.schema)

    def remove(self, part: str) -> int:
        """A version without a part."""
        return self._commit({}, (part,), None)

    def _commit(self, new: dict[str, str], gone: Sequence[str], schema: StructType | None) -> int:
        while True:
            number, found = self.last()
            if schema is not None and found["schema"] is not None and {(f.name, f.dataType.simpleString()) for f in schema} != {(f["name"], StructType.fromJson(found["schema"])[f["name"]].dataType.simpleString()) for f in found["schema"]["fields"]}:
                raise ValueError(f"the table has columns {StructType.fromJson(found['schema']).simpleString()}, the part {schema.simpleString()}")
            parts = {k: v for k, v in {**found["parts"], **new}.items() if k not in gone}
            text = json.dumps({"parts": parts, "schema": found["schema"] if schema is None else schema.jsonValue()})
            number = max([number, *self.numbers()]) + 1
            try:  # a manifest is made once: the slower of two writers takes the next number, and keeps the other's parts
                stream = self._fs.create(self._manifest_path(number), False)
            except Exception as e:
                if "FileAlreadyExists" in str(e):
                    continue
                raise
            stream.write(text.encode())
            stream.close()
            return number

    def read(self, version: int | None = None) -> DataFrame:
        """The table of a version, the last whole one by default."""
        number, found = self.last() if version is None else (version, self.manifest(version))
        if not number or found is None or found["schema"] is None:
            raise ValueError(f"no {'whole version' if version is None else f'version {version}'} of {self.path}")
        schema = StructType.fromJson(found["schema"])
        if not found["parts"]:
            return self.spark.createDataFrame([], schema)
        # parts may be laid out by different columns, which their files do not hold: each is read by itself
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{f}").select(*[f"`{c.name}`" for c in schema]) for f in found["parts"].values()]
        return reduce(DataFrame.unionByName, parts)

    def clean(self, keep: int = 1) -> None:
        """Delete what no version but the last ``keep`` needs: older manifests, and files of replaced parts or of writers that
        did not get to the end. Not while a writer is at work."""
        whole = [n for n in self.numbers() if self.manifest(n) is not None][-keep:]
        needed = {f.removeprefix("data/") for n in whole for f in self.manifest(n)["parts"].values()}
        for n in self.numbers():
            if n not in whole:
                self._fs.delete(self._manifest_path(n), False)
        data = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        for f in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if f.getPath().getName() not in needed:
                self._fs.delete(f.getPath(), True)


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str) -> DataFrame:
    """``df`` as a table ``name`` whose files are dealt by a hash of ``key`` and sorted by it, and that table read back.

    Grouping or joining it by ``key`` needs no shuffle. A table of that name that a lost writer left is replaced. The
    catalog is the session's; ``path`` is where the files go.
    """
    spark = df.sparkSession
    try:
        df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    except AnalysisException as e:
        raise ValueError(f"{name} cannot be saved by {key}: {e.getMessage()}") from e
    return spark.table(name)
