"""Term dictionaries from line-based ontology files.

A class line opens a term; the lines up to the next one belong to it.  The scan
is lexical: one label or synonym a line, bare tags, no entity decoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .records import first_by

# The lines that matter.
CLASS = r'rdf:about="[^"]*/obo/([A-Za-z]+_[A-Za-z0-9]+)"'
LABEL = r"<rdfs:label>([^<]*)</rdfs:label>"
EXACT = r"hasExactSynonym>([^<]*)</"
RELATED = r"hasRelatedSynonym>([^<]*)</"


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, value), numbered inside each file; ``file`` is its name without the folders."""
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    whole = spark.read.text(path, wholetext=True).select(name.alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return whole


def terms(lines: DataFrame, class_pattern: str = CLASS, label: str = LABEL, exact: str = EXACT, related: str = RELATED) -> DataFrame:
    """(file, term_id, label, exact_synonyms, related_synonyms) from (file, line, value).

    Blocks are numbered by a running count of class lines; the last label of a
    block wins, synonyms keep their order, and of blocks with one id the last wins.
    """
    got = lambda p: F.nullif(F.regexp_extract("value", p, 1), F.lit(""))
    rows = lines.select("file", "line", got(class_pattern).alias("id"), got(label).alias("label"), got(exact).alias("exact"), got(related).alias("related")).where("coalesce(id, label, exact, related) is not null")
    run = Window.partitionBy("file").orderBy("line")
    rows = rows.withColumn("block", F.count("id").over(run)).where("block > 0")
    own = F.col("id").isNull()
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(own & F.col(c).isNotNull(), F.struct("line", F.col(c).alias("v"))))), lambda x: x["v"])
    blocks = rows.groupBy("file", "block").agg(
        F.regexp_replace(F.max("id"), "^([^_]*)_", "$1:").alias("term_id"),
        F.max_by("label", F.when(own & F.col("label").isNotNull(), F.col("line"))).alias("label"),
        listed("exact").alias("exact_synonyms"),
        listed("related").alias("related_synonyms"),
    )
    return first_by(blocks, ["file", "term_id"], F.col("block").desc()).drop("block")


def field_terms(config: DataFrame, terms_: DataFrame) -> DataFrame:
    """(field, term_id, ...) for fields whose ontology file was read; each file is scanned once."""
    named = config.where("ontology_file is not null and ontology_file <> ''").select("field", F.element_at(F.split("ontology_file", "/"), -1).alias("file"))
    return named.join(terms_, "file").drop("file")
