"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The white space that ends a word, and what is left of it is a word.
SPACES = b" \t\n\r\x0b\x0c"
SEED = 42
#: Bits of the tables that values are looked up in before they are joined: 8 MB.
TABLE_BITS = 26
#: Bytes of a batch of rows for a Python worker: it ends with the row that passes them.
BATCH_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes: 10,000 whole texts are 35 MB, which the JVM and the worker hold several times over.

    It stays set, since results are worked out after a stage has returned; a bound that the session was given stays as it is.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session names none and all run on this machine."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="diffloom-")
        sc.setCheckpointDir(found)
    return found


def saved(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage with files that outlive any executor.

    The files go when the session's JVM ends, or with `forget`, once the results that read them are stored.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _files(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def _files(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def forget(spark: SparkSession) -> int:
    """Delete the files that `saved` has written so far; call it once the results that read them are stored. Their number."""
    n = len(_written)
    for path in _written:
        _files(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)
    _written.clear()
    return n


def column_unlike(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bit_table(found: DataFrame) -> np.ndarray:
    """The bits of the hashes in found(seed); TABLE_BITS bound what comes to the driver, in words of 64."""
    slot = F.shiftrightunsigned("seed", 64 - TABLE_BITS)
    words = found.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(seed, {64 - TABLE_BITS}) & 63 AS INT))").alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    table[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return table


def in_table(table: np.ndarray, s: np.ndarray) -> np.ndarray:
    slot = s >> np.uint64(64 - TABLE_BITS)
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def may_hold(ids: DataFrame) -> Callable[[Column], Column]:
    """Whether a value may be one of ids(one column): true for each that is, nulls too, and for few others. A join need shuffle no other rows.

    The table fills up beyond some tens of millions of ids, which costs shuffling, not results.
    """
    shared = ids.sparkSession.sparkContext.broadcast(bit_table(ids.select(F.xxhash64(ids.columns[0]).alias("seed"))))

    def held(h: pa.Array) -> pa.Array:
        return pa.array(in_table(shared.value, h.to_numpy(zero_copy_only=False).view(np.uint64)))

    test = F.arrow_udf(held, "boolean")
    return lambda value: test(F.xxhash64(value))


def without(docs: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """docs without the rows whose key is one of ids(one column, stored); only rows that may be are shuffled. Rows with a null key stay."""
    gone, held = column_unlike(docs, "gone"), may_hold(ids)
    some = docs.where(held(docs[key]))
    kept = some.join(ids.toDF(gone), some[key] == F.col(gone), "left_anti")
    return docs.where(~held(docs[key])).unionByName(kept)


def placed(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """rows(g, ...) with pos (from 0, by `order` within g), n (rows of g) and at (unlike for any two rows), without laying a group out in one task.

    Rows are sorted over ranges and written with their places; the ranges' sizes, one row for each group and range, are summed up.
    """
    tie = rows.withColumn("_tie", F.monotonically_increasing_id())  # copies of a row may fill more than one range
    by = ["g", *order, "_tie"]
    laid = saved(tie.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie").withColumn("at", F.monotonically_increasing_id()), "laid-out").withColumn("range", F.shiftright("at", 33))
    runs = laid.groupBy("g", "range").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    w = W.partitionBy("g")
    before = F.coalesce(F.sum("size").over(w.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("g", "range", (before - F.col("first")).alias("shift"), F.sum("size").over(w).alias("n"))
    return laid.join(runs, ["g", "range"]).withColumn("pos", F.col("at") + F.col("shift")).drop("range", "shift")


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8 (bytes.split() splits on exactly these six bytes)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """The same with A-Z lower-cased (bytes.lower() changes nothing else)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def offsets(lengths) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def segment_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of values[at[i]:at[i+1]] for each i; empty segments give 0."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def text_slices(column, budget: int = 1 << 20):
    """(start, texts) pieces of an Arrow string column with about `budget` characters each; a longer text stands alone."""
    part, size, start = [], 0, 0
    for i in range(len(column)):
        t = column[i].as_py()
        if part and size + len(t or "") > budget:
            yield start, part
            part, size, start = [], 0, i
        part.append(t)
        size += len(t or "")
    if part:
        yield start, part
