"""File catalogue work: inventory, choice, download plan, pending inputs, latest run, lineage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavequery.functions import names
from wavequery.operators.running import range_edges, running, with_range_bucket

# Fixed size assumed for files of unknown size: 256 MiB.
UNKNOWN_BYTES = 256 * 1024**2


def list_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Name, path and size of every file below a folder; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(names.basename(F.col("path")).alias("fname"), "path", F.col("length").alias("bytes"))


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """First twelve hex digits of sha256 per file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", checksum(F.col("content")).alias("checksum"))


def checksum(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 12)


def inventory(files: DataFrame, fname: str = "fname", size: str = "bytes") -> DataFrame:
    """Files and bytes by detector, sample rate and duration, with a grand total row."""
    return (
        files.select(*names.inventory_parts(F.col(fname)), F.coalesce(size, F.lit(0)).alias("bytes"))
        .rollup(F.struct("detector", "rate", "duration").alias("k"))
        .agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
        .select(
            F.coalesce("k.detector", F.lit("TOTAL")).alias("detector"),
            F.coalesce("k.rate", F.lit("")).alias("rate"),
            F.coalesce("k.duration", F.lit("")).alias("duration"),
            "files",
            "bytes",
        )
    )


def choose_files(
    items: DataFrame, hdf5: str = "url_hdf5", gwf: str = "url_gwf", allow: Sequence[str] = ("H1", "L1", "V1")
) -> DataFrame:
    """Preferred URL and name of each item: HDF5 before GWF, 4 kHz, 4096 s, allowed detector.

    A name whose detector cannot be read passes.
    """
    chosen = items.withColumn("url", F.coalesce(hdf5, gwf)).where("url is not null")
    chosen = chosen.withColumn("fname", names.basename(F.col("url")))
    found = names.detector(F.col("fname"))
    return chosen.where(
        F.upper("fname").contains("4KHZ")
        & F.col("fname").contains("-4096.")
        & (found.isin(*allow) | (found == "UNK"))
    ).withColumn("detector", found)


def download_plan(
    files: DataFrame,
    existing: DataFrame,
    budget: int,
    max_file: int,
    per_event: int,
    event: str = "event_no",
    order: str = "file_no",
    fname: str = "fname",
    size: str = "bytes",
) -> DataFrame:
    """Files to fetch under quotas, in (event, file) order up to the first overflow.

    Files already present and files above ``max_file`` are left out and do not count.
    At most ``per_event`` files of an event are taken. A file of unknown size counts
    256 MiB. ``need`` is the counted size and ``total`` the running sum.
    """
    missing = files.join(existing.select(fname).distinct(), fname, "left_anti")
    sized = missing.where(F.col(size).isNull() | (F.col(size) <= max_file))
    sized = sized.withColumn("need", F.coalesce(F.when(F.col(size) > 0, F.col(size)), F.lit(UNKNOWN_BYTES)))
    # The rank filter is pushed below the shuffle, so an event keeps per_event rows per task.
    rank = F.row_number().over(Window.partitionBy(event).orderBy(order))
    capped = sized.withColumn("_rank", rank).where(F.col("_rank") <= per_event).drop("_rank")
    binned = with_range_bucket(capped, event, range_edges(files, event))
    summed = running(binned, [event, order], {"total": ("sum", "need")})
    return summed.where(F.col("total") <= budget).drop("_bucket")


def pending(inputs: DataFrame, outputs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inputs without an output yet. Outputs are reduced to their distinct keys before they move."""
    return inputs.join(outputs.select(*keys).distinct(), list(keys), "left_anti")


def latest_complete_run(artefacts: DataFrame, kinds: Sequence[str], run: str = "run_id", kind: str = "kind") -> DataFrame:
    """The newest run that has every kind of artefact (one row, or none)."""
    wanted = artefacts.where(F.col(kind).isin(*kinds))
    per_run = wanted.groupBy(run).agg(F.size(F.collect_set(kind)).alias("_kinds"))
    return per_run.where(F.col("_kinds") == len(set(kinds))).agg(F.max(run).alias(run)).where(F.col(run).isNotNull())


def resolve_source(
    items: DataFrame, index: DataFrame, name: str, folders: Sequence[str], folder: str = "folder", path: str = "path"
) -> DataFrame:
    """First existing source of each item, searching ``folders`` in order.

    The index is reduced to one row per name with a column per folder, so each item is
    joined once however many folders are searched.
    """
    columns = [F.min(F.when(F.col(folder) == f, F.col(path))).alias(f"_at_{i}") for i, f in enumerate(folders)]
    by_name = index.where(F.col(folder).isin(*folders)).groupBy(name).agg(*columns)
    places = [f"_at_{i}" for i in range(len(folders))]
    return items.join(by_name, name, "left").withColumn("source", F.coalesce(*places)).drop(*places)
