"""The request feeds as Structured Streaming jobs.

``foreachBatch`` is at-least-once.  All outputs of a micro-batch are one commit
of a store (``sources.versions``) that carries the batch id, so a micro-batch
that is replayed after its commit changes nothing, and readers see the outcomes,
claims and log rows of a micro-batch together or not at all.  High-water marks
(largest claim and log id) stand in the commit marker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import ci
from ..operators.common import checkpointed, is_small, leading_int, restrict_to_keys
from ..operators.submissions import check_submissions, decide_submissions, employee_keys, log_rows, new_claims
from ..operators.updates import apply_status_updates
from ..sources import versions as V

SUBMISSION_SCHEMA = ("seq long, submitted_at timestamp_ntz, reference string, computer_number string, "
                     "nic string, opd_date string, amount_requested string, claim_type string, "
                     "claim_for string, patient_name string")
STATUS_UPDATE_SCHEMA = ("seq long, ts timestamp_ntz, claim_id int, new_status_id int, new_status_name string, "
                        "remarks string, updated_by int")

# Streaming state (the references taken so far) is kept by RocksDB, outside the executors' heaps.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SUBMISSION_TABLES = {"outcomes": None, "claims": None, "history": None}
STATUS_TABLES = {"outcomes": None, "history": None, "claim_state": "claim_id", "status_state": None}


def write_feed(df: DataFrame, folder: str, order_col: str, chunks: int) -> None:
    """Write ``df`` as about ``chunks`` JSON files of consecutive ``order_col`` ranges.

    All ranges are written at once, one task each.  A file source hands files
    to micro-batches by modification time, so the times are then set in the
    order of the ranges.
    """
    spark = df.sparkSession
    (df.repartitionByRange(chunks, order_col).sortWithinPartitions(order_col).write.mode("overwrite")
     .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(folder))  # the default cuts to milliseconds
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    if not files:
        return
    start = fs.getFileStatus(files[-1]).getModificationTime() // 1000 * 1000 - 1000 * len(files)
    for k, file in enumerate(files):
        fs.setTimes(file, start + 1000 * k, -1)


def _run(source: DataFrame, process, checkpoint: str) -> StreamingQuery:
    query = (source.writeStream.foreachBatch(process)
             .option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def _top(df: DataFrame, col: str) -> int:
    return df.agg(F.max(col)).first()[0] or 0


def first_uses(checked: DataFrame) -> DataFrame:
    """``checked`` and, marked by ``_first_key``, one row for each reference key of a valid row never seen before.

    ``dropDuplicates`` keeps the keys in the state store, partitioned by key: a
    micro-batch looks up only its own.  Both branches read one source, so a
    micro-batch holds the same requests in both.
    """
    seen = (checked.where(F.col("outcome") == "ok").select(ci("v_reference").alias("_first_key"))
            .dropDuplicates(["_first_key"]))
    return checked.unionByName(seen, allowMissingColumns=True)


def stream_submissions(spark: SparkSession, source_dir: str, state_dir: str, checkpoint: str,
                       claims: DataFrame, employees: DataFrame, history: DataFrame,
                       max_files_per_trigger: int = 1) -> StreamingQuery:
    """JSON submissions → W1–W3 per micro-batch.

    Reference uniqueness holds for all time: a reference is free if no claim of
    the table has it and the state store has not seen it on a valid row.  The
    first row (by ``seq``) of a micro-batch gets a reference that is new to the
    store; a micro-batch reads its own rows and keys, never the output of
    earlier ones.  Employees are reduced to their keys once per start.
    Outputs, as tables of the store ``state_dir``: ``outcomes``, ``claims`` (new
    rows), ``history`` (new rows).  Files must come in ``seq`` order.
    """
    src = (spark.readStream.schema(SUBMISSION_SCHEMA)
           .option("maxFilesPerTrigger", max_files_per_trigger).json(source_dir))
    feed = first_uses(check_submissions(src, checkpointed(employee_keys(employees)))
                      .withColumn("_first_key", F.lit(None).cast("string")))

    def process(batch: DataFrame, batch_id: int) -> None:
        batch = checkpointed(batch)  # evaluated once, also when replayed: that moves the state store on
        last = V.read_commit(spark, state_dir)
        if V.is_committed(last, batch_id):
            return
        base_id = last.marks["claim_id"] if last.version else _top(claims, "r_id")
        base_log = last.marks["log_id"] if last.version else _top(history, "log_id")
        fresh = batch.where(F.col("_first_key").isNotNull()).select(F.col("_first_key").alias("_fk"))
        checked = batch.where(F.col("_first_key").isNull()).drop("_first_key")
        first = (checked.where(F.col("outcome") == "ok").groupBy(ci("v_reference").alias("_fk"))
                 .agg(F.min("seq").alias("_first_seq")).join(fresh, "_fk", "left_semi"))
        ingested = checkpointed(decide_submissions(checked, first, claims, base_id, is_small(checked)))
        added = ingested.where(F.col("outcome") == "accepted").count()
        tables = {"outcomes": ingested.select("seq", "outcome", "claim_id"), "claims": new_claims(ingested),
                  "history": log_rows(ingested, base_log)}
        V.publish_changes(spark, state_dir, {n: df.withColumn("batch_id", F.lit(batch_id)) for n, df in tables.items()}, SUBMISSION_TABLES,
                          {"claim_id": base_id + added, "log_id": base_log + added}, batch_id)

    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)  # read when the query starts
    try:
        return _run(feed, process, checkpoint)
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def _current_claims(spark: SparkSession, state_dir: str, last: V.Commit, batch: DataFrame, claims: DataFrame) -> DataFrame:
    """The claims that the batch asks for, as the stream has left them."""
    asked = batch.select(leading_int("claim_id").alias("_cid"))
    small = is_small(batch)
    mine = restrict_to_keys(claims, F.col("r_id"), asked, "_cid", keys_small=small)
    if "claim_state" not in last.tables:
        return mine
    state = restrict_to_keys(V.read_current(spark, state_dir, "claim_state", last), F.col("claim_id"), asked, "_cid", keys_small=small)
    state = state.select(F.col("claim_id").alias("_cc"), F.col("status").alias("_s_status"), F.col("updated_at").alias("_s_updated_at"))
    hit = F.col("_cc").isNotNull()
    return mine.join(state, mine["r_id"] == state["_cc"], "left").select(*[
        F.when(hit, F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c) if c in ("status", "updated_at") else F.col(c)
        for c in claims.columns])


def stream_status_updates(spark: SparkSession, source_dir: str, state_dir: str, checkpoint: str,
                          claims: DataFrame, statuses: DataFrame, history: DataFrame,
                          max_files_per_trigger: int = 1, compact_after: int = V.COMPACT_AFTER) -> StreamingQuery:
    """JSON status updates → W7–W9 per micro-batch.

    State carried between micro-batches, in the store ``state_dir``: the latest
    status of every changed claim (``claim_state``, keyed: a micro-batch adds
    only the claims that it changed, and reads only those it asks for), the statuses added (``status_state``)
    and the largest log id.  After ``compact_after`` change folders a table is
    compacted, so what a micro-batch reads does not grow with the stream's age.
    A status id created by one micro-batch is valid input for the next ones.
    Other outputs: ``outcomes`` and ``history`` (new log rows).

    Updates apply in the order of micro-batches and, inside one, of (ts, seq): an
    update that comes in a later file than its ``ts`` says counts as made when
    it comes, as the source's own clock would have it.
    """
    src = (spark.readStream.schema(STATUS_UPDATE_SCHEMA)
           .option("maxFilesPerTrigger", max_files_per_trigger).json(source_dir))

    def process(batch: DataFrame, batch_id: int) -> None:
        last = V.read_commit(spark, state_dir)
        if V.is_committed(last, batch_id):
            return
        batch = checkpointed(batch)
        cur_statuses = statuses
        if "status_state" in last.tables:
            cur_statuses = statuses.unionByName(V.read_current(spark, state_dir, "status_state", last).drop("batch_id"))
        base_log = last.marks["log_id"] if last.version else _top(history, "log_id")
        floor = spark.createDataFrame([(base_log,)], "log_id long")
        res = apply_status_updates(batch, _current_claims(spark, state_dir, last, batch, claims), cur_statuses, floor)
        tables = {"outcomes": res.outcomes, "history": res.history, "claim_state": res.changes, "status_state": res.new_statuses}
        tables = {n: df if STATUS_TABLES[n] else df.withColumn("batch_id", F.lit(batch_id)) for n, df in tables.items()}
        added = res.outcomes.where(F.col("outcome") == "accepted").count()
        V.publish_changes(spark, state_dir, tables, STATUS_TABLES, {"log_id": base_log + added}, batch_id)
        V.compact(spark, state_dir, ["claim_state", "status_state"], compact_after)

    return _run(src, process, checkpoint)


def read_state(spark: SparkSession, state_dir: str, name: str) -> DataFrame:
    """One stream output as of the last commit (log tables with their ``batch_id``)."""
    return V.read_current(spark, state_dir, name)
