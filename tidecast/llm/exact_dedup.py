"""Exact deduplication as a stateful stream.

Every text is reduced to a digest.  A stream groups rows by digest in RocksDB
state that never expires; for each digest the state keeps the number of rows,
the stable identifier of the row that stays (largest id, ties to the largest
locator) and its content locator (file, row).  A hit in the state is only a
claim: afterwards the whole bytes of every row of a class of two or more are
compared with the bytes at the keeper's locator, and rows that differ (a digest
collision) form classes of their own by their full text.

Defined results: a null text counts as empty; a null id never wins against an
id and stays only if all its copies have null ids (``keep_id`` is then null);
of rows with the same id and text exactly one, at the largest locator, is kept;
an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import scratch_path, written

#: State on disk; without space set aside for the logs of each of its many small stores.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
_KEEPER = "struct<id:bigint,file:string,row:bigint>"


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _keyed(rows: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    rows = rows.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )
    return rows.select(
        digest(F.col("text")).alias("digest"),
        F.struct("id", "file", "row").alias("at"),
        "text",
    )


def _globbed(path: str) -> str:
    """The same path as a pattern: a stream takes a folder or a pattern, not one file."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def keepers_by_stream(
    spark: SparkSession,
    path: str,
    id_col: str,
    text_col: str,
    digest: Callable[[Column], Column],
    max_bytes_per_trigger: int,
    home: str | None,
) -> DataFrame:
    """Run the stream over the files at ``path`` it has not met yet; digest, n, keeper as the state ends."""
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", max_bytes_per_trigger)
    state = (
        _keyed(source.parquet(_globbed(path)), id_col, text_col, digest)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("keeper"))
    )
    home = home or scratch_path(spark, "exact-dedup")

    def keep(batch: DataFrame, number: int) -> None:
        # A batch that is run again after a failure replaces its own folder.
        batch.write.mode("overwrite").parquet(f"{home}/updates/batch={number}")

    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{home}/state")
            .trigger(availableNow=True)
            .foreachBatch(keep)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = f"digest binary, n bigint, keeper {_KEEPER}, batch int"
    if query.exception():
        raise query.exception()
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{home}/updates")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):  # no file ever
        return spark.createDataFrame([], schema).drop("batch")
    updates = spark.read.schema(schema).option("basePath", f"{home}/updates").parquet(f"{home}/updates")
    last = F.max_by(F.struct("n", "keeper"), "batch").alias("last")
    return updates.groupBy("digest").agg(last).select("digest", "last.n", "last.keeper")


def exact_dedup(
    spark: SparkSession,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_digest,
    max_bytes_per_trigger: int = 1 << 40,
    home: str | None = None,
) -> DataFrame:
    """One row per row of the Parquet table at ``path``.

    Columns: id, text, digest, keep_id, group_size, kept.  ``home`` names a shared
    folder for the stream's state: a later call with the same one goes on from
    there and reads only files added since to the state.  Files are taken in
    micro-batches of about ``max_bytes_per_trigger``.
    """
    keepers = keepers_by_stream(spark, path, id_col, text_col, digest, max_bytes_per_trigger, home)
    rows = _keyed(spark.read.parquet(path), id_col, text_col, digest)
    claimed = rows.join(keepers, "digest")
    single = claimed.where("n = 1").select(
        F.col("at.id").alias("id"), "text", "digest", F.col("keeper.id").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"),
    )
    hits = claimed.where("n > 1")
    content = hits.where(F.col("at") == F.col("keeper")).select("digest", F.col("text").alias("keeper_text"))
    # Full bytes on every hit; a row that differs is told apart by its own text.
    checked = hits.join(content, "digest").select(
        "digest", "at", "text", F.when(F.col("text") != F.col("keeper_text"), F.col("text")).alias("other")
    )
    classes = checked.groupBy("digest", "other").agg(
        F.count(F.lit(1)).alias("group_size"), F.max("at").alias("keeper")
    )
    d, o = F.col("digest"), F.col("other")
    classes = classes.select(d.alias("c_digest"), o.alias("c_other"), "group_size", "keeper")
    many = checked.join(
        classes, (d == F.col("c_digest")) & o.eqNullSafe(F.col("c_other"))
    ).select(
        F.col("at.id").alias("id"), "text", "digest", F.col("keeper.id").alias("keep_id"),
        "group_size", (F.col("at") == F.col("keeper")).alias("kept"),
    )
    return single.unionByName(many)


def exact_dedup_frame(docs: DataFrame, **options) -> DataFrame:
    """The same over any DataFrame: its id and text are first written to the shared folder."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    table = written(docs.select(id_col, text_col), "exact-dedup-in")
    return exact_dedup(docs.sparkSession, table.inputFiles()[0].rpartition("/")[0], **options)
