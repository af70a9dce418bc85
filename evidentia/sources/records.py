"""Readers of records, results, run indexes and verdicts, and resumable writers.

Readers keep the raw line and parse on demand, so a filter on a key reads and
parses little.  Order columns (file, position) are carried wherever the first or
last of several rows wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kernels import shred_entries

RESULT = "struct<entries:array<struct<extract:struct<accession:string,extracted:string>,results:map<string,array<struct<value:string,term_id:string>>>>>>"


def accession(raw: Column) -> Column:
    """The record's own top-level accession if it is a JSON string, else null; a line that is no JSON raises."""
    value = F.from_json(raw, "struct<accession:variant>", {"mode": "FAILFAST"})["accession"]
    return F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))


def unwrapped(raw: Column) -> Column:
    """The inner record of a wrapped one, else the record."""
    return F.coalesce(F.get_json_object(raw, "$.BioSample"), raw)


def read_records(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """(file, rec_ord, accession, raw) of each nonblank line of JSON-lines files.

    ``rec_ord`` orders lines inside a file.  A malformed line raises.  With ``recursive`` all ``*.jsonl`` files below the path are read.
    """
    reader = spark.read.option("recursiveFileLookup", recursive)
    if recursive:
        reader = reader.option("pathGlobFilter", "*.jsonl")
    lines = reader.text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.trim("value").alias("raw"))
    return lines.where("raw <> ''").select("file", F.struct("block", "line").alias("rec_ord"), accession(F.col("raw")).alias("accession"), "raw")


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key, the first in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def find_record(records: DataFrame, wanted: str) -> DataFrame:
    """The first record with an accession; of several files the first by name wins.

    The substring test runs before any parsing.
    """
    quoted = F.col("raw").contains(f'"{wanted}"')
    return records.where(quoted & (F.col("accession") == wanted)).orderBy("file", "rec_ord").limit(1)


def find_records(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """First record of each wanted accession, by a semi join instead of an offset index."""
    return first_by(records.join(wanted.select("accession").distinct(), "accession", "left_semi"), ["accession"], F.col("file"), F.col("rec_ord"))


def scan_accessions(lines: DataFrame, column: str = "raw") -> DataFrame:
    """Distinct accessions named anywhere on a line, found without parsing."""
    found = F.regexp_extract_all(F.col(column), F.lit(r'"accession":\s*"([^"]+)"'), F.lit(1))
    return lines.select(F.explode(found).alias("accession")).distinct()


def with_entries(records: DataFrame) -> DataFrame:
    """Adds ``attributes`` and ``secondary``: the searchable entries, made once a record."""
    return records.withColumn("_e", shred_entries("raw")).select("*", F.col("_e.attributes").alias("attributes"), F.col("_e.secondary").alias("secondary")).drop("_e")


def read_run_index(spark: SparkSession, path: str) -> DataFrame:
    """Completed runs of a tab-separated run index."""
    return spark.read.csv(path, sep="\t", header=True).where("status = 'completed'")


def read_results(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, accession, extracted, results): of entries with one accession in a file the last wins.

    ``extracted`` is a map from field to raw JSON value, null where nothing was extracted.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", RESULT, {"mode": "FAILFAST"}).alias("j"))
    rows = files.select("file", F.posexplode("j.entries").alias("pos", "e"))
    rows = rows.select("file", "pos", F.col("e.extract.accession").alias("accession"), F.from_json("e.extract.extracted", "map<string,string>").alias("extracted"), F.col("e.results").alias("results"))
    return first_by(rows, ["file", "accession"], F.col("pos").desc()).drop("pos")


def read_llm_rows(spark: SparkSession, path: str | list[str], rows: str) -> DataFrame:
    """One row for each of the ``rows`` of JSON-lines output, with accession, model and order."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), F.from_json("value", f"struct<accession:string,model:string,rows:array<{rows}>>", {"mode": "FAILFAST"}).alias("j"))
    return parsed.select("file", "line", F.col("j.accession").alias("accession"), F.col("j.model").alias("model"), F.posexplode("j.rows").alias("pos", "row")).select("file", "line", "pos", "accession", "model", "row.*")


def read_verdicts(spark: SparkSession, path: str | list[str], expected: int) -> DataFrame:
    """Annotation verdicts of chunk files; raises unless each of 0 .. expected - 1 is there."""
    schema = "case_index int, accession string, target_field string, target_value string, verdict string, quotes array<string>, gap_type string, gap_type_note string"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    missing = spark.range(expected).select(F.col("id").cast("int").alias("case_index")).join(rows, "case_index", "left_anti")
    if some := [r[0] for r in missing.orderBy("case_index").limit(5).collect()]:
        raise ValueError(f"cases without a verdict, the first of them {some}")
    return rows.orderBy("case_index")


def read_model_results(spark: SparkSession, path: str, schema: str, meta: str = "model string") -> DataFrame:
    """Rows of the JSON-lines files of a folder, each with the columns of its file's own ``.meta.json`` beside it.

    A file without one raises.
    """
    name = lambda ending: F.regexp_replace(F.col("_metadata.file_name"), ending, "").alias("_file")
    reader = lambda kind: spark.read.option("pathGlobFilter", kind)
    rows = reader("*.jsonl").schema(schema).option("mode", "FAILFAST").json(path).select("*", name(r"\.jsonl$"))
    about = reader("*.meta.json").schema(meta).option("multiLine", True).json(path).select("*", name(r"\.meta\.json$"), F.lit(True).alias("_there"))
    joined = rows.join(about, "_file", "left")
    known = F.when(F.col("_there"), True).otherwise(F.raise_error(F.concat(F.lit("no metadata beside "), "_file")).cast("boolean"))
    return joined.where(known).drop("_file", "_there")


def pending(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not done yet."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def write_runs(rows: DataFrame, path: str) -> None:
    """One partition a run; runs written before are replaced, others stay."""
    rows.write.partitionBy("run_name").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def written_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs that are there already; none if the folder is not."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path).select("run_name").distinct()
    except AnalysisException:
        return spark.createDataFrame([], "run_name string")


def replace_table(rows: DataFrame, path: str) -> None:
    """Writes beside the old table, then swaps; the old one is kept as ``.bak``."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(path + ".new")
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    fs = jpath(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(jpath(path)):
        fs.delete(jpath(path + ".bak"), True)
        fs.rename(jpath(path), jpath(path + ".bak"))
    fs.rename(jpath(path + ".new"), jpath(path))


def write_manifest(spark: SparkSession, path: str, **settings) -> None:
    """One JSON object with the settings of a run and the time in UTC."""
    one = spark.range(1).select(*[F.lit(v).alias(k) for k, v in settings.items()], F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("started_at"))
    one.coalesce(1).write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as one JSON object."""
    report.coalesce(1).write.mode("overwrite").json(path)


def chunks(cases: DataFrame, size: int, index: str = "case_index") -> DataFrame:
    """(chunk, n_cases, cases): fixed-size chunks of cases in order, as JSON text."""
    rows = cases.withColumn("chunk", F.floor(F.col(index) / size).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(index), *[c for c in cases.columns if c != index])))
    return rows.groupBy("chunk").agg(F.count("*").alias("n_cases"), F.to_json(ordered).alias("cases"))
