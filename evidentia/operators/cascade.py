"""The match cascade: where in a record does a value come from?

One row a record, with its entries and its values as arrays, or one row an item (a
value with its record's entries); so after the join of values and records every
tier is a narrow projection; no tier shuffles.  A stage is evaluated only where
the earlier ones found nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import text as T
from ..functions.kernels import FOUND, FOUND_ARROW, completed
from ..schema import MATCH, NOT_FOUND, STRATEGIES, TRACE_COLUMNS
from ..scratch import store

Span = Callable[[Column, Column], Column]


def no_matches() -> Column:
    return F.array().cast(f"array<{MATCH}>")


def hits(entries: Column, needle: Column, span: Span) -> Column:
    """Matches of a needle in every entry, in entry order."""

    def one(e: Column) -> Column:
        match = lambda s: F.struct(e["name"].alias("name"), e["content"].alias("content"), s["start"].alias("start"), s["end"].alias("end"))
        return T.let(span(e["content"], needle), match)

    return F.filter(F.transform(entries, one), lambda m: m["start"].isNotNull())


def verbatim(entries: Column, needle: Column) -> Column:
    """(m, s): matches of the text as it is or, without any, ignoring case; null if there are none."""

    def tier(span: Span, name: str) -> Column:
        return T.let(hits(entries, needle, span), lambda m: F.when(F.size(m) > 0, F.struct(m.alias("m"), F.lit(name).alias("s"))))

    return F.coalesce(tier(T.span_exact, STRATEGIES[0]), tier(T.span_ignoring_case, STRATEGIES[1]))


def search_text(items: DataFrame, needle: str = "target_value", attributes: str = "attributes", secondary: str = "secondary", candidates: str | None = None, loose: bool = True) -> DataFrame:
    """The items without their entries and candidates, and ``found`` (matches, strategy, negated), null if nothing matched.

    Exact, ignoring case, normalised in attributes, the same three in the other
    entries; if ``loose`` then rearranged and misspelt words; with ``candidates``
    at last the other names of the value's term.  Verbatim tiers are native, with
    a substring test before any pattern; the rest is one kernel pass over Arrow
    batches, which gets only the entries that it still has to search.  The other
    entries are searched natively only where no attribute matched.
    """
    n = F.nullif(F.col(needle), F.lit(""))
    items = items.withColumn("_a", verbatim(F.col(attributes), n))
    items = items.withColumn("_s", F.when(F.col("_a").isNull(), verbatim(F.col(secondary), n)))
    kept = [c for c in items.columns if c not in (attributes, secondary, candidates, "found", "_a", "_s")]
    open_ = F.col("_a").isNull()
    names = F.col(candidates) if candidates else F.lit(None).cast("array<string>")
    items = items.select(
        *kept,
        n.alias("_n"),
        F.when(open_, F.col(attributes)).alias("_x"),
        F.when(open_ & F.col("_s").isNull(), F.col(secondary)).alias("_y"),
        "_a",
        "_s",
        F.when(open_ & F.col("_s").isNull(), names).alias("_c"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(len(kept), batch.num_columns)), strict=True)
            found = [completed(*row, loose) for row in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(found, FOUND_ARROW)], names=[*kept, "found"])

    return items.mapInArrow(run, StructType([*[items.schema[c] for c in kept], StructField("found", FOUND)]))


def search_records(rows: DataFrame, items: str = "items") -> DataFrame:
    """The rows without their entries, one for each of their items, with the fields of the item and ``found`` as in ``search_text``.

    ``rows`` has attributes, secondary and ``items``, an array of structs with
    target_value and candidates.  The entries of a record go to the kernel once,
    whatever the number of its values, and only if one of these is still open.
    """
    item = rows.schema[items].dataType.elementType
    needle = lambda i: F.nullif(i["target_value"], F.lit(""))

    def native(i: Column) -> Column:
        pair = lambda a: F.struct(a.alias("a"), F.when(a.isNull(), verbatim(F.col("secondary"), needle(i))).alias("s"))
        return T.let(verbatim(F.col("attributes"), needle(i)), pair)

    kept = [c for c in rows.columns if c not in (items, "attributes", "secondary")]
    rows = rows.select(*kept, items, F.transform(items, native).alias("_v"), "attributes", "secondary")
    open_ = F.exists("_v", lambda v: v["a"].isNull())
    rows = rows.select(*kept, items, "_v", F.when(open_, F.col("attributes")).alias("_x"), F.when(open_, F.col("secondary")).alias("_y"))
    schema = StructType([*[rows.schema[c] for c in kept], StructField("item", item), StructField("found", FOUND)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed, v, x, y = (batch.column(len(kept) + k).to_pylist() for k in range(4))
            at, each, found = [], [], []
            for k, (values, tried, attributes, secondary) in enumerate(zip(listed, v, x, y, strict=True)):
                for i, t in zip(values or (), tried or (), strict=True):
                    at.append(k)
                    each.append(i)
                    found.append(completed(i["target_value"] or None, attributes, secondary, t["a"], t["s"], i["candidates"], True))
            place = pa.array(at, pa.int64())
            kind = batch.schema.field(len(kept)).type.value_type
            yield pa.RecordBatch.from_arrays([*(c.take(place) for c in batch.columns[: len(kept)]), pa.array(each, kind), pa.array(found, FOUND_ARROW)], names=[*kept, "item", "found"])

    return rows.mapInArrow(run, schema).select(*kept, "item.*", "found")


def _listed_values(entries: DataFrame, field_map: str) -> DataFrame:
    """The entries with ``target_field`` and ``_v``, the values of that field, instead of their map."""
    rows = entries.select(*[c for c in entries.columns if c != field_map], F.explode(field_map).alias("target_field", "_v"))
    listed = F.when(F.ltrim("_v").startswith("["), F.from_json("_v", "array<string>")).otherwise(F.array("_v"))
    return rows.withColumn("_v", F.filter(listed, lambda v: F.coalesce(v, F.lit("")) != ""))


def explode_values(entries: DataFrame, field_map: str = "extracted") -> DataFrame:
    """One row (target_field, target_value) for each value of a map from field to raw JSON value.

    A scalar is one value, a list one for each item that is neither null nor
    empty; null maps, null and empty values give no rows.
    """
    return _listed_values(entries, field_map).select("*", F.posexplode("_v").alias("value_ord", "target_value")).drop("_v")


def count_values(entries: DataFrame, key: str, field_map: str = "extracted") -> DataFrame:
    """(key, target_field, target_value, n): how often each value of ``explode_values`` occurs under a key.

    Values are counted inside their row, so those of a key with one row are
    neither exploded singly nor shuffled; only of keys with more rows are the
    counts summed up.
    """
    entries = entries.select(key, field_map)
    keys = entries.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("_k"))
    repeated = store(keys, "repeated")
    same = F.col(key).eqNullSafe(F.col("_k"))
    one, more = (_counted_values(entries.join(repeated, same, how), key, field_map) for how in ("left_anti", "left_semi"))
    return one.unionByName(more.groupBy(key, "target_field", "target_value").agg(F.sum("n").alias("n")))


def _counted_values(entries: DataFrame, key: str, field_map: str) -> DataFrame:
    """Counts of the values of each row and field."""
    rows = _listed_values(entries, field_map).select(key, "target_field", "_v")
    schema = StructType([rows.schema[key], rows.schema["target_field"], StructField("target_value", StringType()), StructField("n", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values = pa.table({"at": pc.list_parent_indices(lists), "v": pc.list_flatten(lists)})
            counts = values.group_by(["at", "v"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
            for c in counts.to_batches():
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(c["at"]) for k in (0, 1)), c["v"], c["count_all"]], names=schema.names)

    return rows.mapInArrow(run, schema)


def term_of_value(results: Column, field: Column, value: Column) -> Column:
    """The term id assigned to a value: of the first result with that value, never by position."""
    return F.get(F.filter(results[field], lambda r: r["value"] == value), F.lit(0))["term_id"]


def _with_terms(items: DataFrame) -> DataFrame:
    """The items with all columns of their term, and ``candidates``: its names in the order in which they are tried, null without terms."""
    with_terms = "label" in items.columns
    for name, kind in (("term_id", "string"), ("label", "string"), ("exact_synonyms", "array<string>"), ("related_synonyms", "array<string>")):
        if name not in items.columns:
            items = items.withColumn(name, F.lit(None).cast(kind))
    return items.withColumn("candidates", F.concat(F.array("label"), _synonyms()) if with_terms else F.lit(None).cast("array<string>"))


def _synonyms() -> Column:
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce("exact_synonyms", none), F.coalesce("related_synonyms", none))


_TERM = ["term_id", "label", "exact_synonyms", "related_synonyms", "candidates"]


def _trace_rows(found: DataFrame, extra: list[str]) -> DataFrame:
    found = found.withColumn("_m", F.coalesce("found.matches", no_matches()))
    found = found.withColumn("negated", F.coalesce("found.negated", F.array().cast("array<boolean>")))
    found = found.withColumn("row_negated", (F.size("negated") > 0) & F.forall("negated", lambda x: x))
    part = lambda f: F.transform("_m", f)
    found = found.select(
        "*",
        T.is_placeholder(F.col("target_value")).alias("is_placeholder"),
        F.when(F.col("found").isNull() | F.col("row_negated"), F.lit(NOT_FOUND)).otherwise(F.col("found.strategy")).alias("strategy"),
        part(lambda m: m["name"]).alias("raw_fields"),
        part(lambda m: m["content"]).alias("raw_texts"),
        part(lambda m: F.substring(m["content"], m["start"] + 1, m["end"] - m["start"])).alias("raw_matched_phrase"),
        F.size("_m").alias("n_matches"),
        F.coalesce("term_id", F.lit("")).alias("assigned_term_id"),
        F.coalesce("label", F.lit("")).alias("assigned_term_label"),
        F.array_join(_synonyms(), "; ").alias("assigned_term_synonyms"),
    )
    return found.select(*extra, *TRACE_COLUMNS)


def verify(items: DataFrame) -> DataFrame:
    """Trace rows of items.

    ``items`` has target_field, target_value, attributes and secondary, and may
    have term_id, label, exact_synonyms and related_synonyms; further columns are
    kept.  A row whose matches are all negated is ``not found`` but keeps its
    evidence.
    """
    extra = [c for c in items.columns if c not in {*TRACE_COLUMNS, "attributes", "secondary", *_TERM}]
    return _trace_rows(search_text(_with_terms(items), candidates="candidates"), extra)


def trace(records: DataFrame, results: DataFrame, terms: DataFrame | None = None, keys: tuple[str, ...] = ("accession",)) -> DataFrame:
    """Trace rows of extraction results against their records.

    ``records`` has the keys, attributes and secondary; ``results`` the keys,
    extracted and results; ``terms`` field, term_id and names.  A record that
    occurs twice gives its rows twice.  The values of a record are gathered before
    the join, which needs no further shuffle of them.
    """
    values = explode_values(results)
    values = values.withColumn("term_id", term_of_value(F.col("results"), F.col("target_field"), F.col("target_value"))).drop("results")
    if terms is not None:
        named = terms.select(F.col("field").alias("target_field"), "term_id", "label", "exact_synonyms", "related_synonyms")
        values = values.join(named, ["target_field", "term_id"], "left")
    values = _with_terms(values)
    others = [c for c in values.columns if c not in keys]
    listed = values.groupBy(*keys).agg(F.collect_list(F.struct(*others)).alias("items"))
    found = search_records(records.select(*keys, "attributes", "secondary").join(listed, list(keys)))
    return _trace_rows(found, [*keys, *[c for c in others if c not in {*TRACE_COLUMNS, *_TERM}]])


def verify_one(record: DataFrame, extracted: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Trace rows of a single record or a few, with ``matches``: raw field and text with the matched phrase in bold.

    For display; the arguments are those of ``trace`` with the record's key.
    """
    rows = trace(record, extracted, terms)
    each = F.arrays_zip("raw_fields", "raw_texts", "raw_matched_phrase")

    def shown(m: Column) -> Column:
        bold = T.let(T.phrase_span(m["raw_texts"], m["raw_matched_phrase"]), lambda s: T.bold_span(m["raw_texts"], s["start"], s["end"]))
        return F.struct(m["raw_fields"].alias("raw_field"), bold.alias("raw_text"))

    return rows.withColumn("matches", F.transform(each, shown))
