"""All-string CSV raw layer.

Raw tables are read with an explicit all-string schema — never inferred — so a
column that mixes numbers and tokens ("Not Ranked") keeps every value. Comments
hold newlines and doubled quotes, hence multiLine + RFC-4180 quoting. A load is
an idempotent snapshot overwrite; the row count is observed on the write itself
(no second scan).

Scale: Spark's multi-line reader gives a file to one task, as a newline may sit
inside a quoted field. Files of up to one split are read by it; if a file is
larger, ``read_raw`` reads all of them by ``split_csv``, which cuts files anywhere
and gives the same rows. ``load_raw`` converts CSV once to parquet, so every later
read is a splittable, column-pruned scan.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import raw_schema
from . import split_csv

# Tokens a pandas-style reader treats as missing. Applied only to
# the columns a caller names — never to ids or free text by default.
DEFAULT_NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                       "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
                       "n/a", "nan", "null"]


def read_csv_strings(spark: SparkSession, path: str, schema: T.StructType | Sequence[str],
                     ragged: str = "fail") -> DataFrame:
    """CSV scan, every column a string, multi-line quoted fields.

    Columns are bound by header name, in any order; further ones are dropped and a
    missing one raises ``ValueError``. Every file of a folder must have the same
    header. Rows with too few or too many fields fail the job, or with
    ``ragged="keep"`` are kept, short ones with NULLs.
    """
    names = [f.name for f in schema.fields] if isinstance(schema, T.StructType) else list(schema)
    reader = (spark.read.option("header", True).option("multiLine", True).option("inferSchema", False)
              .option("quote", '"').option("escape", '"')
              .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    header = reader.csv(path).columns
    missing = [c for c in names if c not in header]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} in the header {header}")
    found = T.StructType([T.StructField(c, T.StringType(), True) for c in header])
    return (reader.schema(found).option("enforceSchema", False).option("columnPruning", False)
            .option("mode", "FAILFAST" if ragged == "fail" else "PERMISSIVE").csv(path).select(*[F.col(f"`{c}`") for c in names]))


def apply_null_tokens(df: DataFrame, columns: Sequence[str],
                      tokens: Sequence[str] = DEFAULT_NULL_TOKENS) -> DataFrame:
    """Null the given tokens in the chosen columns only (raw rule 5)."""
    toks = [F.lit(t) for t in tokens]
    return df.withColumns({c: F.when(F.col(c).isin(*toks), F.lit(None).cast("string")).otherwise(F.col(c))
                           for c in columns})


def _largest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file under ``path`` (from the listing; nothing is read)."""
    return spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0


def _split_bytes(spark: SparkSession) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))


def read_raw(spark: SparkSession, table: str, path: str,
             null_token_columns: Sequence[str] | None = None) -> DataFrame:
    """Raw table from CSV with its registered schema (S2); unknown names raise."""
    read = split_csv.read_csv_split if _largest_file(spark, path) > _split_bytes(spark) else read_csv_strings
    df = read(spark, path, raw_schema(table))
    return apply_null_tokens(df, null_token_columns) if null_token_columns else df


def write_csv(df: DataFrame, path: str) -> None:
    """CSV sink with header and RFC-4180 quoting, spaces at the edges kept; NULL is written as an empty field."""
    (df.write.mode("overwrite").option("header", True)
       .option("quote", '"').option("escape", '"').option("quoteAll", False)
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .csv(path))


def load_raw(spark: SparkSession, table: str, csv_path: str, out_path: str,
             null_token_columns: Sequence[str] | None = None) -> int:
    """CSV → raw parquet snapshot (S2 + S3 + S5). Returns the observed row count."""
    df = read_raw(spark, table, csv_path, null_token_columns)
    obs = Observation(f"load_{table}")
    df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(out_path)
    return int(obs.get["rows"])


def ensure_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    """CREATE DATABASE IF NOT EXISTS."""
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`{loc}")


def blanks_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """What a CSV round trip does to '' : it becomes NULL (raw rule 4)."""
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in cols})


def as_strings(df: DataFrame, rename: Mapping[str, str] | None = None) -> DataFrame:
    """Render any table as an all-string raw table (the raw layer's contract)."""
    rename = rename or {}
    return df.select([F.col(c).cast("string").alias(rename.get(c, c)) for c in df.columns])
