"""First-seen rows by a keyed state store.

``run_first_seen_stream`` keeps one row per key and batch and leaves it to its readers
to pick among the batches. Here the stream itself remembers which keys it has
let through, in RocksDB state that lives beside the checkpoint and is written as
change logs, so a run reads its new files and the state of their keys, never the
rows landed before. A key's entry is a single number and expires ``horizon_ms``
after the key was last seen, so the state follows the keys that are still active.

First write wins: a key's row is the first by ``order_cols`` of the batch that saw it
first; later batches add nothing, whatever their order values. A key that comes back
after its entry expired is let through once more, and readers keep the earlier batch.

Rows are reduced to one per key and Arrow batch before the shuffle, so a key that
holds a third of all rows sends few of them to the task of its state. A NULL key is
a key like any other; NULL order values come first; ties give one of the tied rows.
The number of state partitions is ``spark.sql.shuffle.partitions`` of the first run.
"""
from __future__ import annotations

import json
import pickle
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ingest_state import append_unit_rows, first_seen

_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # entries that time out would ask for another batch without end
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def _less(a: Sequence, b: Sequence) -> bool:
    """Order of two lists of values, None first."""
    for x, y in zip(a, b, strict=True):
        if (x is None) != (y is None):
            return x is None
        if x is not None and x != y:
            return x < y
    return False


def _first_of_batch(key: str, order_cols: Sequence[str]):
    """Arrow batches -> of each batch the first row of each key, as (key, order and row):
    pandas, which hands groups to the state, would turn longs beside NULL into doubles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ordered = b.take(pc.sort_indices(b, [(c, "ascending") for c in order_cols], null_placement="at_start"))
            codes = ordered.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            rows = ordered.take(pa.array(np.unique(codes, return_index=True)[1])).to_pylist()
            yield pa.record_batch({"k": pa.array([repr(r[key]) for r in rows]),
                                   "row": pa.array([pickle.dumps(([r[c] for c in order_cols], r)) for r in rows], pa.binary())})

    return run


def _new_keys(horizon_ms: int):
    """Lets the first row of a key through and remembers the key."""
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known, best = state.exists, None
        for frame in frames:
            for blob in () if known else frame["row"]:
                order, _ = pickle.loads(blob)
                if best is None or _less(order, best[0]):
                    best = order, blob
        state.update((1,))
        state.setTimeoutDuration(horizon_ms)  # renewed each time that the key is seen
        if best is not None:
            yield pd.DataFrame({"row": [best[1]]})

    return run


def _rows_again(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([pickle.loads(x)[1] for x in b.column(0).to_pylist()], schema=schema)

    return run


@contextmanager
def _state_store(spark: SparkSession):
    """The settings of the state store, for queries started inside."""
    before = {k: spark.conf.get(k, None) for k in _STATE_CONF}
    for k, v in _STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_keyed_first_seen_stream(spark: SparkSession, landing_dir: str, schema, sink_dir: str, ledger_dir: str,
                                checkpoint_dir: str, key: str, order_cols: Sequence[str], keep: Sequence[str],
                                horizon_ms: int = 90 * 24 * 3600 * 1000, max_files_per_trigger: int | None = None,
                                max_file_age: str = "3650d") -> list[int]:
    """Process everything available in ``landing_dir`` and stop. A batch's new keys land
    in the sink partition ``batch_id=<id>``, then in the ledger; a replayed batch
    replaces its own. Returns the number of keys in the state after each batch."""
    columns = list(dict.fromkeys([key, *order_cols, *keep]))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        append_unit_rows(batch.withColumn("batch_id", F.lit(batch_id)), sink_dir)
        landed = spark.read.parquet(sink_dir).where(F.col("batch_id") == F.lit(batch_id))
        append_unit_rows(landed.select(F.col(key).alias("unit_id"), F.lit("done").alias("state"), "batch_id"), ledger_dir)

    reader = spark.readStream.schema(schema).option("maxFileAge", max_file_age)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.parquet(landing_dir).select(*columns)
    firsts = (rows.mapInArrow(_first_of_batch(key, order_cols), "k string, row binary").groupBy("k")
              .applyInPandasWithState(_new_keys(horizon_ms), "row binary", "n long", "append", GroupStateTimeout.ProcessingTimeTimeout)
              .mapInArrow(_rows_again(to_arrow_schema(rows.schema)), rows.schema))
    with _state_store(spark):
        q = (firsts.writeStream.outputMode("append").foreachBatch(per_batch)
             .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
        q.awaitTermination()
    batches = [json.loads(p.json) if not isinstance(p, dict) else p for p in q.recentProgress]
    return [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in batches if p["numInputRows"]]


def read_keyed_first_seen(spark: SparkSession, sink_dir: str, key: str, keep: Sequence[str]) -> DataFrame:
    """First row per key: the one of the earliest batch."""
    return first_seen(spark.read.parquet(sink_dir), key, ["batch_id"], keep=list(keep), reread=True)
