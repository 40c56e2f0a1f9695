"""What the operators of this subpackage share: tables, batches, shared folders."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch. Texts can be long, so a batch has few of them.
BATCH_ROWS = 256
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(batches):
    """Arrow batches cut into runs of BATCH_ROWS rows, and of one row where texts are long: so few are Python objects at once, whatever the session's settings.
    Who loops over the runs holds the last one until the next batch is there, or for as long as the worker waits for a task: it is a copy, so that the batch, which is as large
    as the session's settings say, can go. At the end the worker gives back what Arrow keeps for later."""
    for batch in batches:
        at, rows = 0, len(batch)
        while at < rows:
            n = BATCH_ROWS
            while n > 1 and batch.slice(at, n).nbytes > BATCH_BYTES:
                n //= 2
            part = batch.slice(at, n)
            at += n
            if n < at and at >= rows:
                part = pa.ipc.read_record_batch(part.serialize(), part.schema)
                del batch
            yield part
            del part
    pa.default_memory_pool().release_unused()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the one that the cluster names in spark.checkpoint.dir, or one set by setCheckpointDir. Where neither is (tests and trials on one
    machine) a temporary folder is set, and only if all executors run in the driver's process: elsewhere they would not see it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="edgeloom-"))
    return sc.getCheckpointDir()


#: Paths of the tables that stored() has written and nothing has deleted yet.
_tables: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and survives lost executors. It is deleted by forget(), by the scratch() around it, or when the driver's
    Python ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _tables:
        atexit.register(_forget_all)
    _tables.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def remember(path: str) -> None:
    """Has a folder deleted as those of stored() are."""
    if not _tables:
        atexit.register(_forget_all)
    _tables.append(path)


def _delete(path: str) -> None:
    from pyspark import SparkContext

    jvm, sc = SparkContext._gateway.jvm, SparkContext._active_spark_context
    conf = sc._jsc.hadoopConfiguration() if sc else jvm.org.apache.hadoop.conf.Configuration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def _forget_all() -> None:
    with contextlib.suppress(Exception):  # the driver ends; its JVM may have gone first
        while _tables:
            _delete(_tables.pop())


def forget(df: DataFrame) -> None:
    """Deletes the files of a table made by stored()."""
    _tables.remove(df._stored_at)
    _delete(df._stored_at)


@contextlib.contextmanager
def scratch():
    """Deletes, at its end, the tables stored inside it but for those that were handed to the function it gives."""
    before, kept = set(_tables), set()
    yield lambda *tables: kept.update(t._stored_at for t in tables)
    for path in [p for p in _tables if p not in before and p not in kept]:
        _tables.remove(path)
        _delete(path)


#: A key with this share of all rows or more is hot; so there are fewer hot keys than its inverse.
HOT = 1 / 1000


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], counts: DataFrame, total: int) -> DataFrame:
    """rows and table joined on keys, which are unique in table. counts: a stored table of the keys with n, the number of their rows; total: of all rows.
    Hot keys, 1 / HOT at most, meet their rows by broadcast, so these stay where they are; all others meet by a shuffle."""
    hot = counts.filter(F.col("n") >= max(2.0, total * HOT)).select(*keys)
    # The plan is the same at every size.
    table = table.hint("merge")
    if hot.isEmpty():
        return rows.join(table, keys)
    hot = F.broadcast(hot)
    at_hot = F.broadcast(table.join(hot, keys, "left_semi"))
    return rows.join(at_hot, keys).unionByName(rows.join(hot, keys, "left_anti").join(table, keys))


def local_links(spark: SparkSession, links: list[tuple[int, int]]) -> DataFrame:
    """a, b longs. Handed over as Arrow: rows would come through an RDD that has a Python daemon and workers of its own on each executor, which stay."""
    return spark.createDataFrame(pa.table({name: pa.array([x[k] for x in links], pa.int64()) for k, name in enumerate("ab")}))


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 1 when divided by 3. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def sampled(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """Of labelled rows, about `most` by a hash of the id: all if there are no more. Only ids are read to count them."""
    n = rows.select(id_col).count()
    if n <= most:
        return rows
    share = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(7)), 11) / float(1 << 53)
    return rows.filter(share < most / n)


def kept_rows(docs: DataFrame, text_col: str, decide) -> DataFrame:
    """The rows whose text decide keeps, with all their columns. decide: makes, on an executor, a function from a list of texts to a list of booleans."""
    at = docs.columns.index(text_col)

    def run(batches):
        judge = None
        for batch in bounded_batches(batches):
            judge = judge or decide()
            yield batch.filter(pa.array(judge(batch.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
