"""What the training-data operators share: scratch tables, row ids, distributed ranks."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The characters of the class [\x20\x09-\x0D].
ASCII_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"

#: Rows that one task ranks or indexes at most, on average.
ROWS_PER_TASK = 500_000


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it is not installed on them."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """A folder in `spark.checkpoint.dir` for this application, deleted when it exits.

    Where that is unset, the folder is in the warehouse, which a cluster's
    machines share; only a local session uses a temporary one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not where and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            where = tempfile.mkdtemp(prefix="driftloom-")
        sc.setCheckpointDir(where or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.scratch")
        atexit.register(_delete, spark, sc.getCheckpointDir())
    return sc.getCheckpointDir()


def _delete(spark: SparkSession, where: str) -> None:
    with contextlib.suppress(Exception):  # at exit the JVM may be gone already
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_dl_path"] = path
    for scope in _scopes.get():
        scope.append(out)
    return out


_scopes: contextvars.ContextVar[tuple[list[DataFrame], ...]] = contextvars.ContextVar("scopes", default=())


def discard(df: DataFrame) -> None:
    """Delete the table of a `materialise()` whose readers are done."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.__dict__["_dl_path"])
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def passing() -> Iterator[list[DataFrame]]:
    """Delete the tables written inside the block at its end, but for the last one."""
    tables: list[DataFrame] = []
    token = _scopes.set((*_scopes.get(), tables))
    try:
        yield tables
    finally:
        _scopes.reset(token)
        for table in tables[:-1]:
            discard(table)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, wish: str) -> str:
    """`wish`, with underscores added until no column of `df` has that name."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """Add a number that tells repeated rows apart, under a name that `df` does not have.

    It is fixed only once the result is written, so callers materialise first.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def numbered(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """`df` with a row id, written, and the name of that column, which no column of `df` has."""
    name = free_name(df, "__dl_uid")
    return materialise(with_row_id(df, name), tag), name


def without(rows: DataFrame, uid: str, gone: DataFrame) -> DataFrame:
    """`rows` of `numbered()` without those whose id is in `__dl_uid` of `gone`, and without the id."""
    left = rows.join(gone.select(F.col("__dl_uid").alias(uid)), uid, "left_anti")
    return left.select(*[quoted(c) for c in rows.columns if c != uid])


def tasks_for(spark: SparkSession, n: int, rows: int = ROWS_PER_TASK) -> int:
    """Partitions for `n` rows: the session's number, more where tasks would grow too large."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // rows))


def ranked(df: DataFrame, groups: list[str], order: list[Column], n: int, out: str, deal: list[Column] | None = None, piece: Column | None = None) -> DataFrame:
    """Gapless rank from 0 inside each group without one task per group.

    Rows are dealt by a hash of `deal` (the order columns, if not given) into
    cells of about bounded size; cells are ranked alone, then shifted by the
    number of rows in the group's earlier cells. The rank is a permutation
    fixed by these columns, not a global sort by them; rows equal in `deal`
    get ranks close together. `piece` cuts a cell further, in its order, where
    rows equal in `deal` would make it too large.
    """
    cells = max(1, -(-n // ROWS_PER_TASK)) * 64
    cell = F.pmod(F.xxhash64(*(deal or order)), F.lit(cells)).cast("int")
    dealt = df.withColumn("__dl_cell", F.struct(cell.alias("cell"), (F.lit(0) if piece is None else piece).cast("int").alias("piece")))
    keys = [*groups, "__dl_cell"]
    counts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("__dl_n"))
    before = W.partitionBy(*groups).orderBy("__dl_cell").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*keys, F.coalesce(F.sum("__dl_n").over(before), F.lit(0)).alias("__dl_at"))
    local = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return (
        dealt.withColumn("__dl_row", local)
        .join(counts.hint("merge"), keys)
        .withColumn(out, (F.col("__dl_at") + F.col("__dl_row") - 1).cast("long"))
        .drop("__dl_cell", "__dl_row", "__dl_at")
    )


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice's texts hold about `limit` bytes or are one row."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(lengths):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
