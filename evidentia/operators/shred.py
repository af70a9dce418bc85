"""Projections that turn raw JSON records into columns and prompt text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import flatten_json
from ..functions.text import attribute_name, escaped
from ..schema import PROJECT_ATTRIBUTES
from ..sources.records import accession, unwrapped


def as_array(json: Column, item: str) -> Column:
    """A bare object, a list of them, or nothing, always as an array of ``item`` structs."""
    start = F.substring(F.ltrim(json), F.lit(1), F.lit(1))
    return F.when(start == "[", F.from_json(json, f"array<{item}>")).when(json.isNull() | (F.trim(json) == "null"), F.array().cast(f"array<{item}>")).otherwise(F.array(F.from_json(json, item)))


def path(body: Column, where: str) -> Column:
    return F.get_json_object(body, f"$.{where}")


def organism(raw: Column) -> Column:
    """OrganismName, else taxonomy_name; an empty name counts as missing."""
    body = unwrapped(raw)
    return F.coalesce(F.nullif(path(body, "Description.Organism.OrganismName"), F.lit("")), path(body, "Description.Organism.taxonomy_name"))


def attributes(body: Column) -> Column:
    return as_array(path(body, "Attributes.Attribute"), "struct<attribute_name:string,content:string>")


def project(body: Column) -> Column:
    """Project accession: of the first attribute of that name, else of the first link to a project."""
    named = F.filter(attributes(body), lambda a: attribute_name(a["attribute_name"]).isin(PROJECT_ATTRIBUTES) & (F.coalesce(a["content"], F.lit("")) != ""))
    links = as_array(path(body, "Links.Link"), "struct<target:string,label:string,content:string>")
    linked = F.filter(links, lambda x: (x["target"] == "bioproject") & (F.coalesce(x["label"], F.lit("")) != ""))
    return F.coalesce(F.get(named, F.lit(0))["content"], F.get(linked, F.lit(0))["label"])


def owner(body: Column) -> Column:
    """Content of the first owner name, else its abbreviation."""
    first = F.get(as_array(path(body, "Owner.Name"), "struct<content:string,abbreviation:string>"), F.lit(0))
    return F.coalesce(F.nullif(first["content"], F.lit("")), first["abbreviation"])


def metadata(records: DataFrame) -> DataFrame:
    """accession, dates, project and owner; records without an accession are dropped."""
    rows = records.select(accession(F.col("raw")).alias("accession"), unwrapped(F.col("raw")).alias("b")).where("accession is not null")
    b = F.col("b")
    return rows.select("accession", path(b, "submission_date").alias("submission_date"), path(b, "publication_date").alias("publication_date"), project(b).alias("bioproject_id"), owner(b).alias("owner"))


def summary(records: DataFrame) -> DataFrame:
    """One wide row a record, lists as arrays of structs and small objects as flat text."""
    raw, b = F.col("raw"), F.col("b")
    rows = records.select("raw", unwrapped(raw).alias("b"))
    flat = lambda name: flatten_json(path(b, name))
    return rows.select(
        accession(raw).alias("accession"),
        path(b, "id").alias("internal_id"),
        organism(raw).alias("organism"),
        path(b, "Description.Organism.taxonomy_id").alias("taxonomy_id"),
        path(b, "Description.Title").alias("title"),
        path(b, "Description.SampleName").alias("sample_name"),
        path(b, "Description.Comment.Paragraph").alias("comment"),
        *[path(b, c).alias(c) for c in ("access", "submission_date", "publication_date", "last_update")],
        flat("Owner").alias("owner"),
        flat("Models").alias("model"),
        flat("Package").alias("package"),
        flat("Status").alias("status"),
        attributes(b).alias("attributes"),
        as_array(path(b, "Ids.Id"), "struct<db:string,namespace:string,db_label:string,content:string>").alias("ids"),
        as_array(path(b, "Links.Link"), "struct<target:string,label:string,content:string>").alias("links"),
    )


# Dataset prefixes with their category and organism.
CATEGORIES = [
    ("rnaseq_human", "DDBJ RNA-Seq", "Homo sapiens"),
    ("rnaseq_mouse", "DDBJ RNA-Seq", "Mus musculus"),
    ("chipatlas_hg38", "ChIP-Atlas", "Homo sapiens"),
    ("chipatlas_mm10", "ChIP-Atlas", "Mus musculus"),
]


def category(dataset: Column, rules: list[tuple[str, str, str]] = CATEGORIES) -> tuple[Column, Column]:
    """(category, organism) of a dataset by its prefix; an unknown one raises."""
    unknown = F.raise_error(F.concat(F.lit("no category for dataset "), F.coalesce(dataset, F.lit("null"))))
    first, second = unknown.cast("string"), unknown.cast("string")
    for prefix, kind, species in reversed(rules):
        first, second = F.when(dataset.startswith(prefix), kind).otherwise(first), F.when(dataset.startswith(prefix), species).otherwise(second)
    return first, second


def _line(e: Column) -> Column:
    return F.concat(F.coalesce(e["name"], F.lit("")), F.lit(": "), F.coalesce(e["content"], F.lit("")))


def attribute_lines(entries: Column) -> Column:
    """``name: content`` lines of attributes; the entry of an attribute's own name, which follows its content, is passed over."""

    def step(done: Column, e: Column) -> Column:
        own = done["name"].isNotNull() & e["name"].eqNullSafe(done["name"]) & e["content"].eqNullSafe(done["name"])
        kept = F.struct(done["lines"].alias("lines"), F.lit(None).cast("string").alias("name"))
        return F.when(own, kept).otherwise(F.struct(F.concat(done["lines"], F.array(_line(e))).alias("lines"), F.nullif(e["name"], F.lit("")).alias("name")))

    none = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(None).cast("string").alias("name"))
    return F.array_join(F.aggregate(entries, none, step, lambda done: done["lines"]), "\n")


def record_lines(attributes_: Column, secondary: Column) -> Column:
    """Attribute lines, then the other entries except title and comment, which are shown apart."""
    rest = F.array_join(F.transform(F.filter(secondary, lambda e: ~F.coalesce(e["name"].isin("title", "comment"), F.lit(False))), _line), "\n")
    return F.array_join(F.filter(F.array(attribute_lines(attributes_), rest), lambda x: x != ""), "\n")


def item_line(index: Column, field: Column, value: Column, hint: Column) -> Column:
    return F.concat(F.format_string("%d. %s = %s", index, field, value), F.when(F.coalesce(hint, F.lit("")) != "", F.concat(F.lit(" ["), hint, F.lit("]"))).otherwise(""))


def prompt(context: Column, items: Column, explain: bool = False) -> Column:
    """Asks for verbatim quotes in favour of each item; ``explain`` also asks why one is missing."""
    extra = ' Where found is false, add a short "explanation".' if explain else ""
    return F.concat(
        F.lit("The record below was read to fill in some fields. For each numbered item decide whether the record supports the value.\n\nRecord:\n"),
        context,
        F.lit("\n\nItems:\n"),
        F.array_join(items, "\n"),
        F.lit('\n\nAnswer with one JSON object {"verdicts": [{"item_index": 0, "found": true, "quotes": ["..."]}]}. Every quote must be copied from the record word for word.' + extra),
    )


def leaf_coverage(leaves: Column, html: Column) -> Column:
    """Whether every leaf stands, escaped, in the rendered page."""
    return F.forall(leaves, lambda v: F.contains(html, escaped(v)))
