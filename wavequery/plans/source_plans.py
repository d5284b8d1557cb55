"""Source, sink and file-catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavequery.functions import names
from wavequery.plans import stand_ins as si
from wavequery.plans.registry import query
from wavequery.session import scratch_path
from wavequery.sources import files as fl
from wavequery.sources import strain as sr
from wavequery.sources import tables as tb


@query(
    "normalize_columns",
    f"""WITH {si.SCORES_SQL}
SELECT s.doc_id, s.file_id, s.start_us / 1e6 AS start_gps, s.score, s.label,
       CASE WHEN l.toxic = 1 THEN 'test' WHEN s.label = 0 THEN 'val' ELSE 'train' END AS subset
FROM scores s JOIN labels l ON l.doc_id = s.doc_id""",
)
def normalize_columns(spark, sf_dir):
    flags = si.table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("is_test"))
    raw = si.scores(spark, sf_dir).join(flags, "doc_id").select(
        "doc_id",
        F.col("file_id").alias("fileid"),
        (F.col("start_us") / 1e6).alias("start"),
        F.col("score").alias("ncc"),
        F.col("label").alias("target"),
        (F.col("label") == 0).alias("is_val"),
        "is_test",
    )
    return tb.normalize_columns(raw)


@query(
    "infer_rate",
    """WITH a AS (SELECT CASE l_returnflag WHEN 'A' THEN l_quantity * 64 END AS fs,
  CASE l_returnflag WHEN 'N' THEN l_quantity * 64 END AS sample_rate, CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE / (l_quantity * 64) END AS spacing FROM lineitem),
r AS (SELECT coalesce(fs, sample_rate, round(1.0::DOUBLE / spacing)) AS rate FROM a)
SELECT CAST(rate AS INTEGER) AS rate, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY rate""",
)
def infer_rate(spark, sf_dir):
    line = si.table(spark, sf_dir, "lineitem")
    rate = F.col("l_quantity") * 64
    attrs = line.select(
        F.when(F.col("l_returnflag") == "A", rate).alias("fs"),
        F.when(F.col("l_returnflag") == "N", rate).alias("sample_rate"),
        F.when(F.col("l_linestatus") == "F", F.lit(1.0) / rate).alias("spacing"),
    )
    found = tb.sample_rate(F.col("fs"), F.col("sample_rate"), F.col("spacing"))
    return attrs.groupBy(found.alias("rate")).agg(F.count("*").alias("n"))


@query(
    "strain_table",
    f"""WITH {si.STRAIN_SOURCE_SQL},
parts AS (SELECT file_id, CAST(count(DISTINCT idx // {si.CHUNK_SAMPLES}) AS BIGINT) AS n_chunks, CAST(count(x) AS BIGINT) AS n_good, round(sum(x), 4) AS total
  FROM dead GROUP BY file_id)
SELECT file_id, detector, gps_start_us, fs, n_samples, n_chunks, n_good, total,
       gps_start_us + CAST(round((n_samples - 1) * 1000000 / fs) AS BIGINT) AS last_us
FROM heads JOIN parts USING (file_id)""",
)
def strain_table(spark, sf_dir):
    strain = si.strain_source(spark, sf_dir)
    known = F.filter("samples", lambda v: v.isNotNull())
    parts = strain.select(
        *sr.HEADER, F.size(known).alias("good"), F.aggregate(known, F.lit(0.0), lambda a, v: a + v).alias("sum")
    )
    files = parts.groupBy(*sr.HEADER).agg(
        F.count("*").alias("n_chunks"), F.sum("good").alias("n_good"), F.round(F.sum("sum"), 4).alias("total")
    )
    return files.withColumn("last_us", sr.sample_time_us(F.col("n_samples") - 1)).drop("chunk_len")


CATALOG_ITEMS_SQL = """items AS (SELECT event_id AS seq, 'gw' || CAST(user_id AS VARCHAR) || '-v' || CAST(event_id % 3 AS VARCHAR) AS name,
  CASE WHEN event_type = 'error' THEN NULL ELSE value END AS gps FROM events)"""


def catalog_items(spark, sf_dir):
    name = F.concat(F.lit("gw"), F.col("user_id").cast("string"), F.lit("-v"), (F.col("event_id") % 3).cast("string"))
    gps = F.when(F.col("event_type") != "error", F.col("value"))
    return si.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), name.alias("name"), gps.alias("gps"))


@query(
    "catalog_dedup",
    f"WITH {CATALOG_ITEMS_SQL} SELECT upper(name) AS name, max_by(gps, seq) AS gps FROM items WHERE gps IS NOT NULL GROUP BY upper(name)",
)
def catalog_dedup(spark, sf_dir):
    return tb.dedupe_catalog(catalog_items(spark, sf_dir), ["seq"])


@query(
    "catalog_first_version",
    f"""WITH {CATALOG_ITEMS_SQL} SELECT upper(split_part(name, '-v', 1)) AS name, min_by(gps, seq) AS gps FROM items
WHERE gps IS NOT NULL GROUP BY upper(split_part(name, '-v', 1))""",
)
def catalog_first_version(spark, sf_dir):
    return tb.dedupe_catalog(catalog_items(spark, sf_dir), ["seq"], keep="first", strip_version=True)


@query(
    "file_inventory",
    f"""WITH {si.STRAIN_FILES_SQL},
p AS (SELECT regexp_extract(fname, '(?i)^.*([HLV]1).*?(\\d+KHZ).*?-(\\d+)\\.hdf5$', 1) AS d,
             regexp_extract(fname, '(?i)^.*([HLV]1).*?(\\d+KHZ).*?-(\\d+)\\.hdf5$', 2) AS r,
             regexp_extract(fname, '(?i)^.*([HLV]1).*?(\\d+KHZ).*?-(\\d+)\\.hdf5$', 3) AS s, coalesce(bytes, 0) AS bytes FROM strain_files),
k AS (SELECT CASE d WHEN '' THEN 'UNKNOWN' ELSE d END AS detector, CASE r WHEN '' THEN 'UNKNOWN' ELSE r END AS rate,
             CASE s WHEN '' THEN 'UNKNOWN' ELSE s END AS duration, bytes FROM p)
SELECT detector, rate, duration, CAST(count(*) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM k GROUP BY ALL
UNION ALL SELECT 'TOTAL', '', '', CAST(count(*) AS BIGINT), CAST(sum(bytes) AS BIGINT) FROM k""",
)
def file_inventory(spark, sf_dir):
    return fl.inventory(si.strain_files(spark, sf_dir))


@query("content_checksum", "SELECT doc_id, substr(sha256(text), 1, 12) AS checksum FROM documents")
def content_checksum(spark, sf_dir):
    docs = si.table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", fl.checksum(F.col("text").cast("binary")).alias("checksum"))


@query(
    "sink_roundtrip",
    f"""WITH {si.WINDOWS_SQL} SELECT CAST(file_id AS VARCHAR) AS file_id, 'UNK' AS detector, 'train' AS subset,
       CAST(start_us / 1e6 AS DOUBLE) AS start_gps, CAST(end_us / 1e6 AS DOUBLE) AS end_gps, CAST(n > 1 AS INTEGER) AS label FROM windows""",
)
def sink_roundtrip(spark, sf_dir):
    w = si.windows(spark, sf_dir)
    path = scratch_path(spark, "dataset")
    nothing = F.lit(None).cast("string")
    tb.write_dataset(
        w.select(
            F.col("file_id").cast("string").alias("file_id"),
            nothing.alias("detector"),
            nothing.alias("split"),
            (F.col("start_us") / 1e6).alias("start_gps"),
            (F.col("end_us") / 1e6).alias("end_gps"),
            (F.col("n") > 1).cast("int").alias("label"),
        ).withColumnRenamed("split", "subset"),
        path,
    )
    return tb.read_dataset(spark, path).withColumn("label", F.col("label").cast("int"))


@query("pending_inputs", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def pending_inputs(spark, sf_dir):
    inputs = si.table(spark, sf_dir, "orders").select("o_orderkey")
    outputs = si.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return fl.pending(inputs, outputs, ["o_orderkey"])


@query(
    "latest_run",
    """SELECT max(run_id) AS run_id FROM (SELECT epoch_us(l_shipdate) // 86400000000 AS run_id FROM lineitem
WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3)""",
)
def latest_run(spark, sf_dir):
    runs = si.table(spark, sf_dir, "lineitem").select(
        F.floor(si.time_us("l_shipdate") / 86_400_000_000).alias("run_id"), F.col("l_returnflag").alias("kind")
    )
    return fl.latest_complete_run(runs, ["A", "N", "R"])


@query(
    "report_metrics",
    """SELECT event_id, CAST(NULL AS DOUBLE) AS ap, CAST(regexp_extract(props, '"k": (\\d+)', 1) AS DOUBLE) / 100 AS auc FROM events""",
)
def report_metrics(spark, sf_dir):
    events = si.table(spark, sf_dir, "events")
    # A run report that only has the second choice of metric name under the third choice of section.
    report = F.concat(F.lit('{"eval": {"AUC": '), F.get_json_object("props", "$.k").cast("int") / 100, F.lit("}}"))
    return tb.report_metrics(events.select("event_id", report.alias("report"))).select("event_id", "ap", "auc")


@query(
    "parse_names",
    f"""WITH {si.STRAIN_FILES_SQL}
SELECT file_no, CASE WHEN fname LIKE '_-H1\\_%' ESCAPE '\\' THEN 'H1' WHEN fname LIKE '_-L1\\_%' ESCAPE '\\' THEN 'L1'
                     WHEN fname LIKE '_-V1\\_%' ESCAPE '\\' THEN 'V1' ELSE 'UNK' END AS detector,
       CASE WHEN contains(fname, 'H1') THEN 'H1' WHEN contains(fname, 'L1') THEN 'L1' WHEN contains(fname, 'V1') THEN 'V1' ELSE 'UNK' END AS loose,
       upper('gw' || CAST(1126257414 + file_no AS VARCHAR)) AS event_hint,
       replace(fname, '.hdf5', '_whitened.hdf5') AS whitened, 'run_' || fname AS safe
FROM strain_files""",
)
def parse_names(spark, sf_dir):
    f = si.strain_files(spark, sf_dir)
    path = F.concat(F.lit("/data/raw/"), "fname")
    tagged = F.concat(F.lit("/data/raw/gw"), (F.lit(1_126_257_414) + F.col("file_no")).cast("string"), F.lit("_"), "fname")
    return f.select(
        "file_no",
        names.detector(path).alias("detector"),
        names.detector_loose(F.col("fname")).alias("loose"),
        names.event_hint(tagged).alias("event_hint"),
        names.with_suffix(names.basename(path), ".hdf5", "_whitened.hdf5").alias("whitened"),
        names.safe_name(F.concat(F.lit("run "), "fname")).alias("safe"),
    )


def url_items(spark, sf_dir):
    f = si.strain_files(spark, sf_dir)
    url = F.concat(F.lit("https://data.example.org/"), "event", F.lit("/"), "fname")
    # Files of unknown size are listed by their GWF address only.
    return f.select(
        "file_no",
        "event",
        "bytes",
        F.when(F.col("bytes").isNotNull(), url).alias("url_hdf5"),
        F.regexp_replace(url, r"\.hdf5$", ".gwf").alias("url_gwf"),
    )


FILE_CHOICE_SQL = f"""{si.STRAIN_FILES_SQL},
chosen AS (SELECT file_no, event, bytes, CASE WHEN bytes IS NULL THEN replace(fname, '.hdf5', '.gwf') ELSE fname END AS fname FROM strain_files
  WHERE contains(fname, '4KHZ') AND contains(fname, '-4096.'))"""


@query("file_choice", f"WITH {FILE_CHOICE_SQL} SELECT file_no, event, fname FROM chosen WHERE substr(fname, 3, 2) IN ('H1', 'L1', 'K1')")
def file_choice(spark, sf_dir):
    return fl.choose_files(url_items(spark, sf_dir), allow=("H1", "L1")).select("file_no", "event", "fname")


MIB = 1024**2


@query(
    "quota_plan",
    f"""WITH {FILE_CHOICE_SQL},
left_over AS (SELECT c.*, CAST(replace(event, 'Brand#', '') AS BIGINT) AS event_no FROM chosen c
  WHERE file_no NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 1)),
sized AS (SELECT *, coalesce(bytes, {fl.UNKNOWN_BYTES}) AS need FROM left_over WHERE bytes IS NULL OR bytes <= {320 * MIB}),
capped AS (SELECT *, row_number() OVER (PARTITION BY event_no ORDER BY file_no) AS rk FROM sized),
plan AS (SELECT event_no, file_no, fname, need, sum(need) OVER (ORDER BY event_no, file_no) AS total FROM capped WHERE rk <= 20)
SELECT event_no, file_no, fname, CAST(need AS BIGINT) AS need, CAST(total AS BIGINT) AS total FROM plan WHERE total <= {40_000 * MIB}""",
)
def quota_plan(spark, sf_dir):
    chosen = fl.choose_files(url_items(spark, sf_dir), allow=("H1", "L1", "V1", "K1"))
    chosen = chosen.withColumn("event_no", F.regexp_replace("event", "Brand#", "").cast("long"))
    fetched = si.table(spark, sf_dir, "lineitem").where("l_quantity = 1").select(F.col("l_partkey").alias("file_no"))
    existing = chosen.join(fetched, "file_no", "left_semi").select("fname")
    plan = fl.download_plan(chosen, existing, budget=40_000 * MIB, max_file=320 * MIB, per_event=20)
    return plan.select("event_no", "file_no", "fname", "need", "total")


@query(
    "resolve_source",
    """WITH idx AS (SELECT p_partkey AS k, 'interim' AS folder FROM part WHERE p_size <= 15
  UNION ALL SELECT p_partkey, 'processed' FROM part WHERE p_size <= 35 UNION ALL SELECT p_partkey, 'archive' FROM part WHERE p_type = 'SMALL'),
c AS (SELECT l.l_orderkey, l.l_linenumber, l.l_partkey,
  (SELECT min(CASE folder WHEN 'interim' THEN 1 WHEN 'processed' THEN 2 ELSE 3 END) FROM idx WHERE idx.k = l.l_partkey) AS best FROM lineitem l)
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE best WHEN 1 THEN 'interim/' WHEN 2 THEN 'processed/' WHEN 3 THEN 'archive/' END || CAST(l_partkey AS VARCHAR) AS source FROM c""",
)
def resolve_source(spark, sf_dir):
    part = si.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_type")
    folders = F.array(
        F.when(F.col("p_size") <= 15, "interim"), F.when(F.col("p_size") <= 35, "processed"), F.when(F.col("p_type") == "SMALL", "archive")
    )
    index = part.select("l_partkey", F.explode(F.array_compact(folders)).alias("folder"))
    index = index.withColumn("path", F.concat("folder", F.lit("/"), F.col("l_partkey").cast("string")))
    items = si.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return fl.resolve_source(items, index, "l_partkey", ["interim", "processed", "archive"])
