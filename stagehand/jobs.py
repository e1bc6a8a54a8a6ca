"""Batch jobs over a folder-per-table warehouse, built from the library (spark-submit).

    python -m stagehand.jobs load-legacy SRC_DIR RAW_DIR  # legacy export → raw tables (E1)
    python -m stagehand.jobs load-raw    CSV_DIR RAW_DIR  # crawl CSV, one folder per table → raw (S2)
    python -m stagehand.jobs stage       RAW_DIR STG_DIR  # typed staging tables (E3, S6–S8)
    python -m stagehand.jobs check       RAW_DIR OUT_DIR  # raw-layer checklist + reports (A11)
    python -m stagehand.jobs stream-things LANDING_DIR RAW_DIR  # new thing responses → raw (X1–X3)
    python -m stagehand.jobs stream-plays  LANDING_DIR RAW_DIR  # new plays responses → raw
    python -m stagehand.jobs stream-users  LANDING_DIR RAW_DIR  # new user responses → raw
    python -m stagehand.jobs stream-collections LANDING_DIR RAW_DIR  # new collection responses → raw
    python -m stagehand.jobs work-list RAW_DIR OUT_DIR --candidates TABLE [--sample N]  # units left to fetch (J5, M1, M2, A10)

A layer is a folder with one parquet table per name (``RAW_DIR/user_item``…).
Loads and staged tables are create-or-replace snapshots; every job takes its
session (and shared ``spark.checkpoint.dir``) from the cluster. Link views are
not stored: ``read_staging`` derives them from ``stg_item_link`` on read, as
the source project's views do.
"""
from __future__ import annotations

import argparse
import json
import math
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .operators import ingest_state as ing
from .operators import reshape, sampling, staging
from .plans import warehouse
from .schemas import RAW_FIELDS
from .session import drop_scratch
from .sources import raw_csv

# Legacy export files and the staged tables clustered by objectid.
LEGACY_FILES = {"user_info": "user_info.csv", "item_info": "item_info.csv",
                "user_item": "user_item.csv", "item_details": "item_details.csv"}
CLUSTERED = ("stg_item_info", "stg_item_details", "stg_user_item", "stg_item_link")
STAGED = ("stg_user_info", "stg_item_info", "stg_item_details", "stg_user_item", "stg_item_link")


def _join(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}"


def _read_if_present(read: Callable[[str], DataFrame], *paths: str) -> DataFrame | None:
    """The first of ``paths`` that Spark can read, else None. Works on any file
    system the cluster mounts (the check is Spark's own path resolution)."""
    for path in paths:
        try:
            return read(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return None


def _write_counted(df: DataFrame, path: str, name: str) -> int:
    """Overwrite ``path`` with ``df``; the row count is observed on the write."""
    obs = Observation(f"rows_{name}")
    df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return int(obs.get["rows"])


def read_legacy_csv(spark: SparkSession, path: str) -> DataFrame:
    """A legacy export: header, quoted multi-line fields, every column a string."""
    return (spark.read.option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').option("inferSchema", False).csv(path))


def load_legacy(spark: SparkSession, src_dir: str, raw_dir: str,
                null_token_columns: Sequence[str] = ()) -> dict[str, int]:
    """Legacy export → the five raw tables it can fill (E1: U1, U2, P1–P3).

    Blanks become NULL, as the CSV hop of the source load does; null tokens are
    applied only to the named columns. item_stats, item_rank and user_play
    cannot be filled from the legacy export and are not written.
    """
    read = lambda t: read_legacy_csv(spark, _join(src_dir, LEGACY_FILES[t]))
    details, links = reshape.adapt_item_details(read("item_details"))
    tables = {"user_info": reshape.adapt_user_info(read("user_info")),
              "item_info": reshape.adapt_item_info(read("item_info")),
              "user_item": reshape.adapt_user_item(read("user_item")),
              "item_details": details, "item_link": links}
    counts = {}
    for name, df in tables.items():
        df = raw_csv.blanks_to_null(df)
        cols = [c for c in null_token_columns if c in df.columns]
        if cols:
            df = raw_csv.apply_null_tokens(df, cols)
        counts[name] = _write_counted(df, _join(raw_dir, name), name)
    return counts


def load_raw_layer(spark: SparkSession, csv_dir: str, raw_dir: str,
                   null_token_columns: Sequence[str] = ()) -> dict[str, int]:
    """Every raw table present as ``CSV_DIR/<table>`` (file or folder) → raw parquet."""
    counts = {}
    for name in RAW_FIELDS:
        cols = [c for c in null_token_columns if c in RAW_FIELDS[name]]
        df = _read_if_present(lambda p: raw_csv.read_raw(spark, name, p, cols or None),  # noqa: B023
                              _join(csv_dir, name), _join(csv_dir, f"{name}.csv"))
        if df is not None:
            counts[name] = _write_counted(df, _join(raw_dir, name), name)
    return counts


# The kind of responses that fills a raw table.
LANDED_BY = {"user_info": "users", "user_item": "collections", "item_info": "collections", "item_details": "things", "item_stats": "things",
             "item_link": "things", "item_rank": "things", "user_play": "plays", "play_pages": "plays"}


def _state(raw_dir: str, kind: str) -> str:
    """The state of the landing of ``kind`` responses."""
    return _join(raw_dir, f"_checkpoints/{kind}_pages")


def read_layer(spark: SparkSession, layer_dir: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """The tables of a layer folder that exist, by name; of a landed table the rows
    of committed batches, of each response file those of its last version."""
    from .streaming import landing
    found = {n: _read_if_present(spark.read.parquet, _join(layer_dir, n)) for n in names}
    for n, df in found.items():
        if df is not None and n in LANDED_BY and "batch_id" in df.columns:
            found[n] = landing.read_landed(spark, _join(layer_dir, n), _state(layer_dir, LANDED_BY[n]))
    return {n: df for n, df in found.items() if df is not None}


def stage_layer(spark: SparkSession, raw_dir: str, stg_dir: str,
                rows_per_file: int = 4_000_000) -> dict[str, int]:
    """Raw → typed staging tables, item tables range-clustered by objectid.

    A clustered table gets one range per ``rows_per_file`` rows (from a count of
    the staged rows): adaptive execution can merge small shuffle partitions but
    never splits a range, so the range count must follow the table's size.
    """
    staged = warehouse.staging_layer(read_layer(spark, raw_dir, list(RAW_FIELDS)))
    counts = {}
    for name in STAGED:
        if name not in staged:
            continue
        df = staged[name]
        if name in CLUSTERED:
            df = staging.cluster_by_key(df, "objectid", max(1, math.ceil(df.count() / rows_per_file)))
        counts[name] = _write_counted(df, _join(stg_dir, name), name)
    return counts


def read_staging(spark: SparkSession, stg_dir: str) -> dict[str, DataFrame]:
    """Staged tables plus the four link views, derived on read."""
    out = read_layer(spark, stg_dir, STAGED)
    if "stg_item_link" in out:
        out.update(staging.register_link_views(out["stg_item_link"]))
    return out


def check_layer(spark: SparkSession, raw_dir: str, out_dir: str) -> list[dict]:
    """The raw-layer checklist (one row per check) and its row-level reports, written
    under ``OUT_DIR``; returns the checklist rows (a few dozen) for the log."""
    raw = read_layer(spark, raw_dir, list(RAW_FIELDS))
    checks = warehouse.quality_checklist(raw)
    checks.write.mode("overwrite").parquet(_join(out_dir, "checklist"))
    for name, df in warehouse.checklist_reports(raw).items():
        df.write.mode("overwrite").parquet(_join(out_dir, f"reports/{name}"))
    done = spark.read.parquet(_join(out_dir, "checklist")).orderBy("check_id")
    return [r.asDict() for r in done.collect()]


def _ledger_report(spark: SparkSession, raw_dir: str, kind: str, excluded: str) -> dict[str, int]:
    """Units by current state; the failed ones are written as the exclusion log."""
    from .streaming import landing
    rows = landing.read_committed(spark, _join(raw_dir, f"{kind}_ledger"), _state(raw_dir, kind))
    if rows is None:
        return {"done": 0, "retry": 0, "failed": 0}
    now = ing.latest_state(rows)
    ing.exclusions(now, "unit_id").write.mode("overwrite").parquet(excluded)
    found = {r.state: r.n for r in now.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {s: found.get(s, 0) for s in ("done", "retry", "failed")}


def stream_pages(spark: SparkSession, kind: str, landing_dir: str, raw_dir: str,
                 max_files_per_trigger: int | None = None) -> dict[str, int]:
    """Parse the ``kind`` responses (things, plays, users, collections) landed or
    fetched again since the last run into the raw tables. The state of the landing,
    the ledger and the exclusion log live beside the raw tables (shared storage), so
    the next run resumes where this one ended. Returns the units by state."""
    from .streaming import ingest
    run = {"things": ingest.run_thing_page_stream, "plays": ingest.run_plays_page_stream,
           "users": ingest.run_user_page_stream, "collections": ingest.run_collection_page_stream}[kind]
    ledger = _join(raw_dir, f"{kind}_ledger")
    run(spark, landing_dir, raw_dir, ledger, _state(raw_dir, kind), max_files_per_trigger)
    return _ledger_report(spark, raw_dir, kind, _join(raw_dir, f"{kind}_excluded"))


def work_list(spark: SparkSession, candidates: str, raw_dir: str, out: str, kind: str, key: str, sample: int | None = None,
              seed: str = "work") -> dict[str, int]:
    """Units of ``candidates`` (parquet, column ``key``) that are neither done nor
    failed in the ``kind`` ledger (J5), written to ``out``. With ``sample`` the
    candidates are first reduced to a seeded sample, frozen on the first run
    beside ``out`` (M1, M2). Returns the progress counts (A10)."""
    units = spark.read.parquet(candidates).select(key)
    if sample is not None:
        units = sampling.freeze(sampling.seeded_sample(units, key, sample, seed), f"{out.rstrip('/')}_sample")
    from .streaming import landing
    ledger = landing.read_committed(spark, _join(raw_dir, f"{kind}_ledger"), _state(raw_dir, kind))
    empty = units.limit(0)
    now = None if ledger is None else ing.latest_state(ledger).withColumnRenamed("unit_id", key)
    done, failed = (empty if now is None else now.where(F.col("state") == s).select(key) for s in ("done", "failed"))
    left = _write_counted(ing.todo_ids(units, done, failed, key), out, "work_list")
    p = ing.progress(units, done, failed, key).first()
    return {"sampled": p.sampled, "processed": p.processed, "excluded": p.excluded, "remaining": left}


def main(argv: Sequence[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="python -m stagehand.jobs")
    ap.add_argument("job", choices=["load-legacy", "load-raw", "stage", "check", "stream-things",
                                    "stream-plays", "stream-users", "stream-collections", "work-list"])
    ap.add_argument("src")
    ap.add_argument("dst")
    ap.add_argument("--null-token-columns", default="",
                    help="comma-separated raw columns where tokens such as N/A, NULL, None mean missing")
    ap.add_argument("--max-files-per-trigger", type=int, default=None,
                    help="cut a stream run into batches of that many files (default: one batch of all that has landed)")
    ap.add_argument("--candidates", help="work-list: parquet table of the units to fetch")
    ap.add_argument("--kind", default="collections", help="work-list: whose ledger counts")
    ap.add_argument("--key", default="user_id", help="work-list: id column of the candidates")
    ap.add_argument("--sample", type=int, default=None, help="work-list: size of a seeded sample, frozen on the first run")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName(f"stagehand-{a.job}").getOrCreate()
    tokens = [c for c in a.null_token_columns.split(",") if c]
    try:
        if a.job == "load-legacy":
            out = load_legacy(spark, a.src, a.dst, tokens)
        elif a.job == "load-raw":
            out = load_raw_layer(spark, a.src, a.dst, tokens)
        elif a.job == "stage":
            out = stage_layer(spark, a.src, a.dst)
        elif a.job.startswith("stream-"):
            out = stream_pages(spark, a.job.split("-")[1], a.src, a.dst, a.max_files_per_trigger)
        elif a.job == "work-list":
            out = work_list(spark, a.candidates, a.src, a.dst, a.kind, a.key, a.sample)
        else:
            out = check_layer(spark, a.src, a.dst)
    finally:
        drop_scratch(spark)                     # every result is written by now
    print(json.dumps(out, default=str))


if __name__ == "__main__":
    main()
