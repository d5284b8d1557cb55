"""Readers, writers and column conventions of the flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed column aliases accepted by the readers.
ALIASES = {
    "fileid": "file_id",
    "start": "start_gps",
    "ncc": "score",
    "proba": "score",
    "pred_score": "score",
    "split": "subset",
    "target": "label",
}

# Fixed defaults for missing text in the dataset.
TEXT_DEFAULTS = {"file_id": "", "source_file": "", "event_hint": "", "detector": "UNK", "subset": "train"}

# Fixed column types of the dataset.
DATASET_TYPES = {
    "label": "tinyint",
    "fs": "float",
    "window_sec": "float",
    "stride_sec": "float",
    "snr_rms": "float",
    "snr_peak": "float",
    "crest_factor": "float",
    "start_idx": "bigint",
    "start_gps": "double",
    "end_gps": "double",
}

SCORE_SCHEMA = "file_id string, start_gps double, label int, score double"

# Fixed columns that are not features.
NOT_FEATURES = {
    "y", "label", "split", "subset", "file_id", "detector", "event_id",
    "tc", "t0", "t1", "window_idx", "window_id", "path",
}


def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename known aliases and derive ``subset`` from ``is_val`` / ``is_test`` flags."""
    present = {c.lower(): c for c in df.columns}
    renames = {}
    for alias, target in ALIASES.items():
        if alias in present and target not in df.columns and target not in renames.values():
            renames[present[alias]] = target
    df = df.withColumnsRenamed(renames)
    if "subset" not in df.columns and {"is_val", "is_test"} <= set(df.columns):
        subset = F.when(F.col("is_test"), "test").when(F.col("is_val"), "val").otherwise("train")
        df = df.withColumn("subset", subset).drop("is_val", "is_test")
    return df


def require_columns(df: DataFrame, columns: set[str]) -> DataFrame:
    missing = sorted(columns - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are features."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [f.name for f in df.schema.fields if f.name not in NOT_FEATURES and f.dataType.simpleString() in numeric]


def sample_rate(fs: Column, sample_rate_: Column, spacing: Column) -> Column:
    """``fs``, else ``sample_rate``, else the rounded inverse of the spacing; zero counts as missing."""

    def present(c: Column) -> Column:
        return F.when(c != 0, c)

    return F.coalesce(
        F.rint(present(fs.cast("double"))),
        F.rint(present(sample_rate_.cast("double"))),
        F.when(spacing > 0, F.rint(F.lit(1.0) / spacing)),
    ).cast("int")


def typed_dataset(df: DataFrame) -> DataFrame:
    """Fill missing text and cast the known columns."""
    df = df.fillna({c: v for c, v in TEXT_DEFAULTS.items() if c in df.columns})
    return df.withColumns({c: F.col(c).cast(t) for c, t in DATASET_TYPES.items() if c in df.columns})


def write_dataset(df: DataFrame, path: str, rows_per_file: int = 250_000, partition_by: str | None = None) -> None:
    """Typed Parquet with zstd; files are capped by rows."""
    writer = typed_dataset(df).write.mode("overwrite").option("compression", "zstd")
    writer = writer.option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return normalize_columns(spark.read.parquet(path))


def read_scores_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Score table from CSV; without a schema the header names decide and aliases apply."""
    reader = spark.read.option("header", True)
    if schema:
        return reader.schema(schema).csv(path)
    df = normalize_columns(reader.csv(path))
    casts = {"start_gps": "double", "label": "int", "score": "double"}
    return df.withColumns({c: F.col(c).cast(t) for c, t in casts.items() if c in df.columns})


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_preview(df: DataFrame, path: str, keys: list[str], rows: int = 2_000) -> None:
    """The first rows by key as CSV."""
    write_csv(df.orderBy(*keys).limit(rows), path)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as JSON."""
    report.write.mode("overwrite").json(path)


def read_catalog_json(spark: SparkSession, path: str) -> DataFrame:
    """Event pages with ``results[]`` of ``name`` / ``shortName`` and ``gps``: one row per item."""
    item = "struct<name:string,shortName:string,gps:double>"
    pages = spark.read.schema(f"results array<{item}>, next string").option("multiLine", True).json(path)
    items = pages.select(F.input_file_name().alias("page"), F.posexplode("results").alias("pos", "r"))
    return items.select("page", "pos", F.coalesce("r.name", "r.shortName").alias("name"), F.col("r.gps").alias("gps"))


def dedupe_catalog(items: DataFrame, order: list[str], keep: str = "last", strip_version: bool = False) -> DataFrame:
    """One row per upper-case event name; items without name or time are dropped.

    ``keep`` chooses the ``last`` or ``first`` item by ``order``. ``strip_version`` cuts a
    ``-vN`` suffix from the name first.
    """
    name = F.upper("name")
    if strip_version:
        name = F.upper(F.split_part(F.col("name"), F.lit("-v"), F.lit(1)))
    position = F.struct(*order)
    value = F.max_by("gps", position) if keep == "last" else F.min_by("gps", position)
    return items.where("name is not null and gps is not null").groupBy(name.alias("name")).agg(value.alias("gps"))


def first_metric(report: Column, paths: list[str]) -> Column:
    """First JSON path of a report text that holds a number."""
    return F.coalesce(*[F.get_json_object(report, p).cast("double") for p in paths])


# Sections of run reports in order, and the names of their metrics.
SECTIONS = ("val", "validation", "eval", "metrics", "test")
AP_NAMES = ("ap", "AP", "average_precision")
AUC_NAMES = ("auc", "AUC", "roc_auc")


def report_metrics(reports: DataFrame, report: str = "report") -> DataFrame:
    """Average precision and AUC of each run report, both from the first section that has either."""

    def pair(ap_paths: list[str], auc_paths: list[str]) -> Column:
        ap, auc = first_metric(F.col(report), ap_paths), first_metric(F.col(report), auc_paths)
        return F.when(ap.isNotNull() | auc.isNotNull(), F.struct(ap.alias("ap"), auc.alias("auc")))

    sections = [pair([f"$.{s}.{m}" for m in AP_NAMES], [f"$.{s}.{m}" for m in AUC_NAMES]) for s in SECTIONS]
    found = F.coalesce(*sections, pair(["$.best_val_ap"], ["$.best_val_auc"]))
    return reports.withColumn("_found", found).withColumns({c: F.col("_found")[c] for c in ("ap", "auc")}).drop("_found")
