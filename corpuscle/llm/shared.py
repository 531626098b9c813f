"""What the operators of this subpackage share: word rules, the shared folder, bounded batches."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word is a run of characters other than the ASCII white space \x20 \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, as an array; of null, null."""
    return F.array_remove(F.split(text, SPACE), "")


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="corpuscle-")


def _local(spark: SparkSession) -> bool:
    """Whether all tasks run in the driver's own JVM."""
    return spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Where it is unset a
    folder of this machine serves if all tasks run on it; on a cluster that is an error, since each executor
    would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not _local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


#: Small rows that one file of a stored table holds at least, where their number is known.
FILE_ROWS = 50_000


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: what is computed once is
    read many times, its lineage is cut, and any executor can be lost meanwhile. The driver then forgets
    the shuffles that led to it, whose files would stay until it collects its garbage by chance. rows: a
    bound of the number of (small) rows, so that a small table is not spread over as many files as there are
    shuffle partitions."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(rows // FILE_ROWS + 1)
    path = f"{shared_dir(spark)}/corpuscle/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the folder that `stored` made for df, which nothing reads any more."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent().getParent()
        folder.getFileSystem(conf).delete(folder, True)


def trim_heaps(spark: SparkSession) -> None:
    """Let each executor collect its garbage, so that its JVM gives back the heap that is free. Left alone, a
    heap that has grown once stays so, and from stage to stage less of an executor's memory is left for what
    lies outside it. A task for each core; idle executors get equal numbers. In a local session the heap is
    the driver's, which `stored` takes care of."""
    if not _local(spark):
        n = spark.sparkContext.defaultParallelism
        spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items of at most `most` in sum, one item at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def tucked(df: DataFrame, text: str = "text", **more: Column) -> tuple[DataFrame, list[str]]:
    """df as in_ (a struct of all columns but `text`), text and the columns `more`, with the names in in_:
    whatever the columns are called, they cannot clash with an operator's own."""
    names = [c for c in df.columns if c != text]
    row = F.struct(F.lit(True).alias("there"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    return df.select(row.alias("in_"), F.col(f"`{text}`").alias("text"), *(v.alias(k) for k, v in more.items())), names


def untucked(df: DataFrame, names: list[str], made: dict[str, Column]) -> DataFrame:
    """The tucked columns under their names, then the made ones. As with withColumn, a made column takes
    the place of a given one of the same name."""
    own = {k.lower() for k in made}
    return df.select(*(F.col("in_")[f"c{i}"].alias(n) for i, n in enumerate(names) if n.lower() not in own), *(v.alias(k) for k, v in made.items()))


def arrow_schema(schema: str | StructType):
    """The Arrow schema of a DDL string or a Spark schema; on the driver only."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema))


#: Bytes of text that one step of a Python operator works on at once, and of an Arrow batch (one row at least).
STEP_BYTES = 2 << 20
BATCH_BYTES = 4 << 20
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of texts are cut by bytes, not by rows alone: rows are of any length, and an executor
    holds a batch several times over, in and outside its heap. A session that has set its own bound keeps it."""
    if spark.sparkContext.getConf().get(BATCH) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def trimmed(run):
    """A function over batches that gives back to the system what its worker has freed, when a task ends:
    workers live on, and an executor's memory is that of all of them."""

    def whole(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return whole


def map_texts(df: DataFrame, step, schema: str | StructType, text: str = "text", most: int = STEP_BYTES, finish=None) -> DataFrame:
    """`step(rows, texts)` over the rows of df, in steps of at most `most` bytes of text (one row at
    least). rows: an Arrow batch of the other columns; texts: list of bytes (UTF-8), None for null.
    step returns a list of columns in the order of schema, or None. finish() is called at a partition's
    end and returns the same. What step and finish keep in their closure is a task's own."""
    import pyarrow as pa

    out = arrow_schema(schema)
    bounded_batches(df.sparkSession)

    def batch_of(columns):
        return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(columns, out, strict=True)], schema=out)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            data = batch.column(at).cast(pa.binary())
            rest = pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at], names=[n for i, n in enumerate(batch.schema.names) if i != at])
            sizes = [0 if x is None else x for x in pa.compute.binary_length(data).to_pylist()]
            for a, b in slices(sizes, most):
                if (made := step(rest.slice(a, b - a), data.slice(a, b - a).to_pylist())) is not None:
                    yield batch_of(made)
        if finish is not None and (made := finish()) is not None:
            yield batch_of(made)

    return df.mapInArrow(trimmed(run), schema)


def extended(df: DataFrame, step, made: str, text: str = "text", most: int = STEP_BYTES) -> DataFrame:
    """The rows of df without `text`, with the columns `made` (DDL) that step(texts) returns. As with
    withColumn, a made column takes the place of a given one of the same name."""
    fields = StructType.fromDDL(made).fields
    own = {f.name.lower() for f in fields}
    rest = [f for f in df.schema.fields if f.name != text and f.name.lower() not in own]
    own = "_".join(["text", *own, *(f.name for f in rest)])  # longer than any, so that it is none of them
    given = df.select(*(F.col(f"`{f.name}`") for f in rest), F.col(f"`{text}`").alias(own))
    return map_texts(given, lambda rows, texts: [*rows.columns, *step(texts)], StructType([*rest, *fields]), own, most)
