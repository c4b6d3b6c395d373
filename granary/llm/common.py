"""What the text operators share: scratch tables, batches, words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows in an Arrow batch. Whole texts are in the batches, so this and the longest text bound a worker's memory.
BATCH_ROWS = 512


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that many long texts don't meet in one; shuffle files go when the job that read them is over."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def scratch_folder(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, local mode takes a folder of its machine; a cluster has none to take."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="granary-")
        spark.conf.set("spark.checkpoint.dir", folder) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return folder.rstrip("/")


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """The same rows, written once to the shared folder as Parquet and read back: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/granary/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._granary_path = path
    return out


def bucketed(df: DataFrame, n: int, key: str) -> DataFrame:
    """The same rows, written as a table in buckets of the key: joins and groups by it read their rows without a shuffle."""
    name = f"granary_{uuid.uuid4().hex}"
    path = f"{scratch_folder(df.sparkSession)}/granary/{name}"
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, key).sortBy(key).saveAsTable(name)
    out = df.sparkSession.table(name)
    out._granary_path, out._granary_table = path, name
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() and bucketed() that no later job reads."""
    for df in tables:
        spark = df.sparkSession
        if hasattr(df, "_granary_table"):
            spark.sql(f"DROP TABLE IF EXISTS {df._granary_table}")
        path = spark._jvm.org.apache.hadoop.fs.Path(df._granary_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_batches(df: DataFrame, schema: str, rows: Callable[[pa.RecordBatch], dict | None], setup: Callable | None = None) -> DataFrame:
    """mapInArrow with a function from a batch to a dict of columns (lists, numpy or Arrow arrays).

    setup(), if given, is called once per task and its result passed as the second argument.
    """
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        state = setup() if setup else None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = rows(batch, state) if setup else rows(batch)
            if columns is None:
                continue
            yield pa.RecordBatch.from_arrays(
                [x.cast(f.type) if isinstance(x := columns[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(x, f.type) for f in arrow],
                schema=arrow,
            )

    return df.mapInArrow(run, out)


class Recent(dict):
    """Results of compute() by key: those since the last change of generation, and the generation before. Long keys aren't kept."""

    def __init__(self, limit: int = 300_000, longest: int = 64):
        self.limit, self.longest, self.former = limit, longest, {}

    def compute(self, key: bytes):
        raise NotImplementedError

    def __missing__(self, key: bytes):
        found = self.former.get(key)
        if found is None:
            found = self.compute(key)
        if len(key) < self.longest:
            if len(self) >= self.limit:
                self.former = dict(self)
                self.clear()
            self[key] = found
        return found


def byte_words(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text as UTF-8. bytes.split() parts at just these six characters."""
    return text.encode().split() if text else []


def hashes(words: list[bytes]) -> np.ndarray:
    """64-bit keyed hashes of words, for comparing words within one process."""
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


#: Odd multipliers of the window hash, drawn once by a rule.
_STEPS = np.random.default_rng(20240229).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each window of that many words."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:n] * _STEPS[0]
        for k in range(1, width):
            out += mixed(h[k : k + n]) * _STEPS[k]
        return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of a 64-bit hash spread over the whole word."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns of documents with their types; other columns, whatever their names, stay out."""
    kinds = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
    return docs.select(*[F.col(c).cast(kinds[c]).alias(c) for c in columns])
