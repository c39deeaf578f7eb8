"""Catalog tables: schemas, keyed upserts and a versioned store on shared storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SCHEMAS = {
    "datasets": "name string, type string, file_path string, row_count bigint, uploaded_at timestamp",
    "tables": "dataset string, table_name string, position int, row_count bigint, "
    "description string, columns array<string>, raw_schema string",
    "columns": "dataset string, table_name string, column_id int, position int, column_name string, "
    "data_type string, storage_type string, sample_values array<string>, row_count bigint, "
    "null_count bigint, distinct_count bigint, min_text string, max_text string, min_num double, "
    "max_num double, description string, is_pii int, null_percentage double, "
    "uniqueness_ratio double, duplicate_count bigint",
    "relationships": "dataset string, position int, source_table string, source_column string, "
    "target_table string, target_column string, confidence double, type string, direction string, "
    "overlap_percentage double, join_suggestion string, reason string",
    "quality_metrics": "dataset string, table_name string, row_count bigint, health_score double, "
    "missing_count bigint, duplicate_count bigint, outlier_count bigint, "
    "invalid_format_count bigint, details array<struct<column_name:string,missing:bigint,"
    "missing_percentage:double,outliers:bigint,invalid_formats:bigint>>, "
    "recommendations array<string>",
    "glossary": "term string, definition string, business_meaning string, business_usage string, "
    "example_val string, created_at timestamp",
    "documents": "doc_id string, doc_type string, dataset string, table_name string, text string",
    "agent_logs": "question string, intent string, plan array<string>, tools_used array<string>, "
    "context_retrieved array<string>, validation_status string, response string, "
    "latency_ms bigint, timestamp timestamp, model_used string",
    "failover_events": "timestamp timestamp, primary_model string, fallback_model string, "
    "error_message string, latency_ms bigint",
}

KEYS = {
    "datasets": ("name",),
    "tables": ("dataset", "table_name"),
    "columns": ("dataset", "table_name", "column_name"),
    "relationships": ("dataset",),
    "quality_metrics": ("dataset", "table_name"),
    "glossary": ("term",),
    "documents": ("doc_id",),
}


def last_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The last row of every key, as a map-side-combined aggregate."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return (
        df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys])
        .agg(F.max_by(row, order).alias("r"))
        .select("r.*")
    )


def one_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows as they are; the job fails if a key has more than one."""
    row = F.struct(*[F.col(c) for c in df.columns])
    grouped = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(
        F.first(row).alias("r"), F.count(F.lit(1)).alias("n")
    )
    message = F.lit(f"several rows of one key ({', '.join(keys)}): an order must settle which is the last")
    checked = F.when(F.col("n") == 1, F.col("r")).otherwise(F.raise_error(message).cast(grouped.schema["r"].dataType))
    return grouped.select(checked.alias("r")).select("r.*")


def upsert_replace(
    existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Column | None = None
) -> DataFrame:
    """New rows replace existing ones of the same key. `order` settles which of
    several new rows of one key is the last; without one they are refused."""
    incoming = one_per_key(new, keys) if order is None else last_per_key(new, keys, order)
    kept = existing.join(incoming.select(*keys), list(keys), "left_anti")
    return kept.unionByName(incoming.select(*existing.columns))


def upsert_ignore(
    existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Column | None = None
) -> DataFrame:
    """Existing rows stay; only rows with unseen keys are added, one per key."""
    incoming = one_per_key(new, keys) if order is None else last_per_key(new, keys, order)
    added = incoming.join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(added.select(*existing.columns))


class CatalogStore:
    """Catalog tables as parquet versions below one folder.

    A keyed write reads the current version and writes the next one beside
    it; a version counts once its success marker exists, so a reader never
    sees a half-written table and a lost writer leaves the old version in
    force. One writer per table at a time. Logs are plain appends.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, table: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(path):
            return []
        found = []
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            marker = self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if name.startswith("v") and name[1:].isdigit() and fs.exists(marker):
                found.append(int(name[1:]))
        return sorted(found)

    def read(self, table: str) -> DataFrame:
        """The current version, or an empty table of the right schema."""
        versions = self._versions(table)
        reader = self.spark.read.schema(SCHEMAS[table])
        if not versions:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return reader.parquet(f"{self.root}/{table}/v{versions[-1]}")

    def _write_next(self, table: str, df: DataFrame) -> None:
        fields = self.spark.createDataFrame([], SCHEMAS[table]).schema
        shaped = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
        version = (self._versions(table) or [0])[-1] + 1
        shaped.hint("rebalance").write.mode("overwrite").parquet(f"{self.root}/{table}/v{version}")

    def upsert(self, table: str, new: DataFrame, order: Column | None = None) -> None:
        self._write_next(table, upsert_replace(self.read(table), new, KEYS[table], order))

    def insert_missing(self, table: str, new: DataFrame, order: Column | None = None) -> None:
        self._write_next(table, upsert_ignore(self.read(table), new, KEYS[table], order))

    def replace_dataset(self, table: str, dataset: str, new: DataFrame) -> None:
        """Replace everything a dataset owns in a table, also with nothing."""
        owner = "name" if table == "datasets" else "dataset"
        kept = self.read(table).where(F.col(owner) != dataset)
        names = kept.columns
        self._write_next(table, kept.unionByName(new.select(*names)))

    def shaped(self, table: str, rows: DataFrame) -> DataFrame:
        fields = self.spark.createDataFrame([], SCHEMAS[table]).schema
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])

    def append(self, table: str, rows: DataFrame) -> None:
        self.shaped(table, rows).write.mode("append").parquet(f"{self.root}/{table}/log/batch")

    def append_batch(self, table: str, rows: DataFrame, stream: str, batch_id: int) -> None:
        """One micro-batch of a stream in a folder of its own: writing it again,
        after a restart, replaces it."""
        path = f"{self.root}/{table}/log/stream/{stream}/{batch_id}"
        self.shaped(table, rows).write.mode("overwrite").parquet(path)

    def read_log(self, table: str) -> DataFrame:
        """All rows of a log, from batch and streaming appends."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}/log")
        fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(path):
            return self.spark.createDataFrame([], SCHEMAS[table])
        reader = self.spark.read.schema(SCHEMAS[table]).option("recursiveFileLookup", True)
        return reader.parquet(f"{self.root}/{table}/log")
