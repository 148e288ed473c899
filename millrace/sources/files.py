"""File formats in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Readers by the names of the dialect's table functions.
READERS = {"read_csv": "csv", "read_csv_auto": "csv", "read_parquet": "parquet", "parquet_scan": "parquet", "read_json": "json", "read_json_auto": "json", "read_ndjson": "json", "read_ndjson_auto": "json", "read_orc": "orc"}
ENDINGS = {".csv": "csv", ".tsv": "csv", ".parquet": "parquet", ".json": "json", ".ndjson": "json", ".jsonl": "json", ".orc": "orc"}


def read(spark: SparkSession, path: str, kind: str | None = None, options: dict[str, str] | None = None, schema=None) -> DataFrame:
    """A file or folder as a DataFrame; the kind by its ending if it isn't given. Types of CSV are found by a pass over
    the data unless there is a schema; filters and columns reach the scan of Parquet and ORC."""
    kind = kind or next((k for e, k in ENDINGS.items() if path.rstrip("/").endswith(e)), None)
    if kind is None:
        raise ValueError(f"what kind of file is {path}?")
    given = {k.lower(): v for k, v in (options or {}).items()}
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "csv":
        sep = given.get("delim") or given.get("delimiter") or given.get("sep") or ("\t" if path.endswith(".tsv") else ",")
        reader = reader.option("header", given.get("header", "true")).option("sep", sep)
        if schema is None:
            reader = reader.option("inferSchema", "true").option("preferDate", "true")
    return reader.format(kind).load(path)


def write(df: DataFrame, path: str, kind: str | None = None, options: dict[str, str] | None = None, mode: str = "overwrite") -> None:
    """A folder of part files, one per task; nothing passes the driver."""
    kind = kind or next((k for e, k in ENDINGS.items() if path.rstrip("/").endswith(e)), "csv")
    given = {k.lower(): v for k, v in (options or {}).items()}
    writer = df.write.mode(mode)
    if kind == "csv":
        writer = writer.option("header", given.get("header", "false")).option("sep", given.get("delimiter") or given.get("delim") or ",")
    writer.format(kind).save(path)
