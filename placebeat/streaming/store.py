"""Partial results of a stream in plain Parquet directories.

Every micro-batch owns a directory ``batch_id=N`` per partial. A retried batch overwrites its own directory, so each
event counts once however often its batch runs. Readers add up what is there. Compaction merges finished batches into
one directory ``through=N``; readers take the newest complete one and the batches after it.

A batch counts from the marker on that is written when all its partials are there, so a reader never sees half of one. The
settings that shape partials are kept beside them, and a store is neither written nor read with others.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placebeat.functions import duration_micros
from placebeat.operators.hotspots import params_pane
from placebeat.params import Params
from placebeat.plans.partials import finish, merge
from placebeat.schemas import PARTIAL_SCHEMAS
from placebeat.sources.files import write_tables

_BATCH = T.StructField("batch_id", T.LongType())


def shaping(params: Params) -> dict:
    """The settings that partials depend on, in a form that JSON keeps."""
    return {
        "pane": params_pane(params),
        "window": duration_micros(params.window_duration),
        "cell_size_km": params.cell_size_km,
        "dense_city_threshold": params.dense_city_threshold,
        "cluster_by": list(params.cluster_by),
        "latest_limit": params.latest_limit,
    }


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of all batch directories with their ``batch_id``; empty when there is none."""
    schema = T.StructType([*schema.fields, _BATCH])
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class PartialStore:
    """Partials of a stream under one base path."""

    def __init__(self, spark: SparkSession, base_path: str) -> None:
        self.spark = spark
        self.base_path = base_path.rstrip("/")

    def batches_path(self, name: str) -> str:
        return f"{self.base_path}/partials/{name}"

    def _compacted_path(self, name: str) -> str:
        return f"{self.base_path}/compacted/{name}"

    def _path(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    @property
    def _settings_path(self) -> str:
        return f"{self.base_path}/partials.json"

    def settings(self) -> dict | None:
        """The settings the partials were written with, None before the first batch."""
        path, files = self._path(self._settings_path)
        if not files.exists(path):
            return None
        return json.loads(self.spark.read.text(self._settings_path, wholetext=True).first()[0])

    def check(self, params: Params) -> None:
        """Refuse settings that the partials can't serve; a shorter feed is served by a longer one."""
        kept, asked = self.settings(), shaping(params)
        if kept is None:
            return
        wrong = {k: (kept[k], v) for k, v in asked.items() if (v > kept[k] if k == "latest_limit" else v != kept[k])}
        if wrong:
            raise ValueError(f"the partials under {self.base_path} were written with other settings (kept, asked): {wrong}")

    def write(self, partials: dict[str, DataFrame], batch_id: int, params: Params | None = None) -> None:
        if params is not None:
            self.check(params)
            if self.settings() is None:
                self._create(self._settings_path, json.dumps(shaping(params)))
        for name, frame in partials.items():
            frame.write.mode("overwrite").parquet(f"{self.batches_path(name)}/batch_id={batch_id}")
        self._create(f"{self.base_path}/commits/batch_id={batch_id}/_SUCCESS", "")

    def _create(self, target: str, text: str) -> None:
        path, files = self._path(target)
        out = files.create(path, True)
        out.write(bytearray(text.encode()))
        out.close()

    def newest_batch(self) -> int:
        """The newest batch whose partials are all there, -1 if there is none."""
        return max(self._listed(f"{self.base_path}/commits", "batch_id"), default=-1)

    def _listed(self, path: str, prefix: str) -> list[int]:
        """Numbers of the complete subdirectories ``prefix=number``."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        names = [(entry.getPath(), entry.getPath().getName()) for entry in files.listStatus(folder)]
        child = self.spark._jvm.org.apache.hadoop.fs.Path
        return [
            int(name.removeprefix(f"{prefix}="))
            for at, name in names
            if name.startswith(f"{prefix}=") and files.exists(child(at, "_SUCCESS"))
        ]

    def compacted_through(self, name: str) -> int:
        """Last batch of the newest complete compaction, -1 if there is none."""
        return max(self._listed(self._compacted_path(name), "through"), default=-1)

    def read(self, name: str, through: int | None = None) -> DataFrame:
        """Partial rows, not merged, of all batches or of those up to ``through``."""
        schema, done = PARTIAL_SCHEMAS[name], self.compacted_through(name)
        last = self.newest_batch() if through is None else through
        rows = read_batches(self.spark, self.batches_path(name), schema).filter(F.col("batch_id").between(done + 1, last))
        rows = rows.drop("batch_id")
        if done < 0:
            return rows
        compacted = self.spark.read.schema(schema).parquet(f"{self._compacted_path(name)}/through={done}")
        return compacted.unionByName(rows)

    def merged(self, params: Params, through: int | None = None) -> dict[str, DataFrame]:
        """One row per key over all batches up to ``through``, the newest committed one by default."""
        self.check(params)
        through = self.newest_batch() if through is None else through
        return merge({name: self.read(name, through) for name in PARTIAL_SCHEMAS}, params)

    def tables(self, params: Params) -> dict[str, DataFrame]:
        """The nine tables over everything the stream has seen."""
        return finish(self.merged(params), params)

    def publish(self, params: Params) -> None:
        """Replace the nine Parquet tables under the base path by their present state, for readers of plain tables."""
        write_tables(self.tables(params), self.base_path)

    def compact(self, params: Params, through: int | None = None) -> int:
        """Merge all batches up to ``through`` into one directory per partial and return ``through``.

        By default the newest batch is left out: it may still be in the making, while those before it are finished.
        """
        if through is None:
            through = self.newest_batch() - 1
        if through > max(self.compacted_through(name) for name in PARTIAL_SCHEMAS):
            for name, frame in self.merged(params, through).items():
                frame.write.mode("overwrite").parquet(f"{self._compacted_path(name)}/through={through}")
        return through

    def drop_compacted(self) -> None:
        """Delete the batch directories that a complete compaction of the same partial contains, and older compactions."""
        for name in PARTIAL_SCHEMAS:
            done = self.compacted_through(name)
            batches = [f"{self.batches_path(name)}/batch_id={x}" for x in self._listed(self.batches_path(name), "batch_id") if x <= done]
            older = [f"{self._compacted_path(name)}/through={x}" for x in self._listed(self._compacted_path(name), "through") if x < done]
            for target in (*batches, *older):
                path, files = self._path(target)
                files.delete(path, True)
