"""Resumable-ingest state as tables, not loops.

A crawl is a set of units (a user, a batch of items). Its state lives in a
ledger table (unit_id, state, reason, batch_id) appended per unit after the
unit's rows, so a crash between them re-writes the unit: at-least-once. Every
question a loop used to answer in memory — what is left, what failed and why,
which plays belong to a half-read user, which row of an item came first — is a
join or an aggregate over these tables.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casts import truncate
from .arg_extreme import extreme_row
from .joins import bounded_broadcast
from .ranking import global_index

# Response triage.
MAX_RETRIES = 5
BACKOFF_CAP_S = 30


def append_unit_rows(df: DataFrame, path: str, batch_col: str = "batch_id") -> None:
    """Append a unit of work's rows (S13): new partitions only, replay-safe.

    Rows are written under ``batch_col=<id>`` with dynamic partition overwrite:
    the first write of a batch appends it, a re-run of the same batch replaces
    only its own partition, so a crash between rows and ledger never duplicates.
    """
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(batch_col).parquet(path))


def todo_ids(candidates: DataFrame, done: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Work list = candidates − done − failed (J5), as one anti join.

    ``done`` and ``failed`` are unioned and reduced to distinct keys map-side;
    the anti join never duplicates a candidate.
    """
    finished = done.select(key).unionByName(failed.select(key)).distinct()
    return candidates.join(finished, on=key, how="left_anti")


def requested_not_returned(requested: DataFrame, returned: DataFrame, key: str,
                           batch_col: str | None = None) -> DataFrame:
    """Ids asked for in a batch request but absent from its response.

    A batch answered with 200 can silently omit ids; this anti join reports them
    (per batch when ``batch_col`` is given) instead of marking them done.
    """
    on = [key] if batch_col is None else [batch_col, key]
    return requested.select(*on).join(returned.select(*on).distinct(), on=on, how="left_anti")


def triage(status: Column, attempt: Column, retry_after: Column | None = None,
           body_ok: Column | None = None, max_retries: int = MAX_RETRIES) -> Column:
    """Outcome of one response (U3) → struct(state, wait_s, reason).

    state ∈ {ok, retry, failed, abort}:
      401 → abort (credentials; retrying is pointless)
      429 → retry after the Retry-After header, else 2^attempt (uncapped)
      202, 5xx and other non-200, network error (NULL status), 200 with a bad body
          → retry after min(2^attempt, 30)
      other 4xx → failed (permanent)
      a retry on the last allowed attempt → failed ('exhausted')
    """
    body_ok = F.lit(True) if body_ok is None else body_ok
    retry_after = F.lit(None).cast("double") if retry_after is None else retry_after.cast("double")
    backoff = F.least(F.pow(F.lit(2.0), attempt.cast("double")), F.lit(float(BACKOFF_CAP_S)))
    state = (F.when(status == 401, F.lit("abort"))
              .when(status == 429, F.lit("retry"))
              .when(status == 202, F.lit("retry"))
              .when((status >= 400) & (status < 500), F.lit("failed"))
              .when(status.isNull() | (status != 200), F.lit("retry"))
              .when(~body_ok, F.lit("retry"))
              .otherwise(F.lit("ok")))
    reason = (F.when(status.isNull(), F.lit("network"))
               .when(status == 200, F.when(body_ok, F.lit(None)).otherwise(F.lit("bad_body")))
               .otherwise(F.concat(F.lit("http_"), status.cast("string"))))
    wait = (F.when(state != "retry", F.lit(None).cast("double"))
             .when(status == 429, F.coalesce(retry_after, F.pow(F.lit(2.0), attempt.cast("double"))))
             .otherwise(backoff))
    exhausted = (state == "retry") & (attempt >= max_retries)
    return F.struct(
        F.when(exhausted, F.lit("failed")).otherwise(state).alias("state"),
        F.when(exhausted, F.lit(None).cast("double")).otherwise(wait).alias("wait_s"),
        F.when(exhausted, F.concat(F.lit("exhausted:"), reason)).otherwise(reason).alias("reason"),
    )


def latest_state(ledger: DataFrame, unit: str = "unit_id", order: str = "batch_id") -> DataFrame:
    """Current state per unit from an append-only ledger (U4): the last entry wins.

    A ledger is a stored table, so the last entry is found by a hash aggregate and
    joined back (``arg_extreme``); an entry without ``order`` counts only if alone.
    """
    return extreme_row(ledger, unit, [order], ["state", "reason", order], last=True, reread=True).select(
        unit, "state", "reason", order)


def exclusions(triaged: DataFrame, unit: str, reason_col: str = "reason",
               state_col: str = "state", width: int = 200) -> DataFrame:
    """Exclusion log (U5): failed units with their reason cut to ``width`` chars."""
    return (triaged.where(F.col(state_col) == "failed")
                   .select(F.col(unit), truncate(F.coalesce(F.col(reason_col), F.lit("")), width).alias("reason")))


def tag_partial(rows: DataFrame, ledger_state: DataFrame, unit: str,
                state_col: str = "state", done_state: str = "done") -> DataFrame:
    """Keep every landed row but tag whether its unit finished.

    Rows of a unit that failed mid-way stay, with ``is_complete = false``; rows of a
    unit without a ledger entry get NULL. The per-unit state is broadcast only
    when its row count is proven small; otherwise a shuffle join with AQE skew
    splitting handles a unit holding a large share of rows.
    """
    st = ledger_state.select(F.col(unit), (F.col(state_col) == F.lit(done_state)).alias("is_complete"))
    return rows.join(bounded_broadcast(st), on=unit, how="left")


def first_seen(df: DataFrame, key: str, order_cols: list[str], keep: list[str] | None = None,
               reread: bool = False) -> DataFrame:
    """One row per key: the first by ``order_cols`` (A8, first write wins).

    A partial aggregate, so no window has to gather all rows of a hot key into one
    task; a hash aggregate where the order packs (``arg_extreme``), for wide kept
    columns if ``reread`` says that the input may be read twice.
    """
    return extreme_row(df, key, order_cols, keep or df.columns, reread=reread)


def page_completeness(pages: DataFrame, unit: str, page: str, rows: str, total: str) -> DataFrame:
    """Per unit: rows gathered vs declared total.

    ``pages`` holds the fetched pages (unit, page, rows, declared total); a page
    fetched again counts once, with the most rows it had. The stop rule: a unit is
    complete once gathered ≥ declared, or a page came back empty.
    """
    once = pages.groupBy(unit, page).agg(F.max(rows).alias(rows), F.max(total).alias(total))
    return (once.groupBy(unit).agg(
                F.count(F.lit(1)).alias("pages"),
                F.sum(rows).cast("bigint").alias("rows_gathered"),
                F.max(total).cast("bigint").alias("rows_declared"),
                F.count_if(F.col(rows) == 0).alias("empty_pages"))
            .withColumn("is_complete",
                        (F.col("rows_gathered") >= F.col("rows_declared")) | (F.col("empty_pages") > 0)))


def progress(sample: DataFrame, done: DataFrame, excluded: DataFrame, key: str,
             durations: DataFrame | None = None, seconds: str = "seconds") -> DataFrame:
    """Processed / excluded / remaining over a sample, rate and projected time (A10).

    One shuffle: the lists are tagged, unioned and reduced per key (partial
    aggregate), then one global aggregate — no cross join of scalars.
    """
    parts = [sample.select(key, F.lit(1).alias("_s"), F.lit(0).alias("_d"), F.lit(0).alias("_x"),
                           F.lit(None).cast("double").alias("_sec")),
             done.select(key, F.lit(0).alias("_s"), F.lit(1).alias("_d"), F.lit(0).alias("_x"),
                         F.lit(None).cast("double").alias("_sec")),
             excluded.select(key, F.lit(0).alias("_s"), F.lit(0).alias("_d"), F.lit(1).alias("_x"),
                             F.lit(None).cast("double").alias("_sec"))]
    if durations is not None:
        parts.append(durations.select(key, F.lit(0).alias("_s"), F.lit(0).alias("_d"), F.lit(0).alias("_x"),
                                      F.col(seconds).try_cast("double").alias("_sec")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    per = u.groupBy(key).agg(F.max("_s").alias("s"), F.max("_d").alias("d"), F.max("_x").alias("x"),
                             F.sum("_sec").alias("sec"))
    s, d, x = (F.col("s") == 1), (F.col("d") == 1), (F.col("x") == 1)
    agg = per.agg(
        F.count_if(s).alias("sampled"),
        F.count_if(s & d).alias("processed"),
        F.count_if(s & x & ~d).alias("excluded"),
        F.count_if(s & ~d & ~x).alias("remaining"),
        F.sum(F.when(s & d, F.col("sec"))).alias("_sec_sum"),
        F.count_if(s & d & F.col("sec").isNotNull()).alias("_sec_n"),
    )
    rate = F.try_divide(F.col("_sec_sum"), F.col("_sec_n").cast("double"))
    return agg.select("sampled", "processed", "excluded", "remaining",
                      F.round(rate, 4).alias("sec_per_unit"),
                      F.round(rate * F.col("remaining"), 2).alias("eta_seconds"))


def id_batches(ids: DataFrame, key: str, size: int = 20) -> DataFrame:
    """Group ids, in id order, into batches of ``size`` joined by commas (B1).

    Output: (batch_no, n_ids, ids). The batch string is built from at most
    ``size`` ids, so the per-batch collect is bounded.
    """
    idx = global_index(ids.select(key).where(F.col(key).isNotNull()).distinct(), key)   # a NULL id is never requested
    batched = idx.withColumn("batch_no", F.floor(F.col("_idx") / F.lit(size)).cast("bigint"))
    agg = batched.groupBy("batch_no").agg(
        F.count(F.lit(1)).alias("n_ids"),
        F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col(key).cast("string").alias("s")))).alias("_l"))
    return agg.select("batch_no", "n_ids", F.concat_ws(",", F.col("_l.s")).alias("ids"))
