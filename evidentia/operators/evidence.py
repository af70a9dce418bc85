"""Evidence proposed by an external model, accepted only if it can be grounded.

A proposer answers prompts in batches; what it says counts only if every quote is
found again in what it was shown, by the own-text tiers of the cascade.  Passes
escalate: what the attributes alone did not settle is asked again with the whole
record.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.kernels import GROUNDED, GROUNDED_ARROW, grounded, parse_verdicts
from ..functions.text import shard_of
from ..schema import LLM, NOT_FOUND
from ..scratch import store
from . import shred
from .sampling import order_key

ATTRIBUTES, FULL_RECORD = "attributes", "full_record"
KEYS = ["accession", "target_field", "target_value"]


class Proposer(Protocol):
    """Answers a batch of prompts, in order."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


def answer(prompts: DataFrame, make: Callable[[], Proposer], max_chars: int = 8000, batch: int = 200) -> DataFrame:
    """Adds ``answer`` and ``error``; the proposer is made once in each worker.

    A prompt that is too long is an error of its own and keeps the others going.
    """
    schema = StructType([*prompts.schema.fields, StructField("answer", StringType()), StructField("error", StringType())])
    at = prompts.columns.index("prompt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        propose = make()
        for rows in batches:
            for a in range(0, rows.num_rows, batch):
                part = rows.slice(a, batch)
                texts = part.column(at).to_pylist()
                short = [i for i, t in enumerate(texts) if t is not None and len(t) <= max_chars]
                said = dict(zip(short, propose([texts[i] for i in short]), strict=True)) if short else {}
                answers = pa.array([said.get(i) for i in range(len(texts))], pa.string())
                errors = pa.array([None if i in said else "prompt too long" for i in range(len(texts))], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, answers, errors], names=[*rows.schema.names, "answer", "error"])

    return prompts.mapInArrow(run, schema)


def shown(secondary: Column, full_record: bool) -> Column:
    """Of the entries that are no attributes those that the prompt showed."""
    return secondary if full_record else F.filter(secondary, lambda e: e["name"].isin("title", "comment"))


def ground(items: DataFrame, quotes: str = "quotes", full_record: bool = False) -> DataFrame:
    """Adds ``matches`` of all grounded quotes, in order, and ``ungrounded``, the quotes that are not there.

    Each quote is searched exactly, ignoring case and normalised, in attributes and
    then in the other entries, never looser; empty quotes are ungrounded.  A row is
    grounded by itself, so nothing is joined back to it.
    """
    rows = items.drop("matches", "ungrounded").withColumn("_shown", shown(F.col("secondary"), full_record))
    wanted = [rows.columns.index(c) for c in (quotes, "attributes", "_shown")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grounded(*row) for row in zip(*(batch.column(k).to_pylist() for k in wanted), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, GROUNDED_ARROW)], names=[*batch.schema.names, "_g"])

    out = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("_g", GROUNDED)]))
    return out.select(*[c for c in rows.columns if c != "_shown"], "_g.*")


def accepted(found: Column, quotes: Column, ungrounded: Column) -> Column:
    """True for a claim with a quote at least, all of them grounded."""
    return F.coalesce(found, F.lit(False)) & (F.size(F.coalesce(quotes, F.array().cast("array<string>"))) > 0) & (F.size(ungrounded) == 0)


def judged(items: DataFrame, full_record: bool) -> DataFrame:
    """Model rows of items that carry ``found`` (null: no verdict), ``quotes`` and ``explanation``."""
    none = F.array().cast("array<string>")
    claimed = items.withColumn("quotes", F.when(F.col("found"), F.coalesce("quotes", none)).otherwise(none))
    rows = ground(claimed, full_record=full_record)
    ok = accepted(F.col("found"), F.col("quotes"), F.col("ungrounded"))
    keep = lambda f: F.transform("matches", f)
    return rows.select(
        *[c for c in items.columns if c not in ("found", "quotes", "explanation", "attributes", "secondary")],
        F.when(ok, F.lit(LLM)).otherwise(F.lit(NOT_FOUND)).alias("strategy"),
        F.col("found").alias("llm_verdict"),
        keep(lambda m: m["name"]).alias("raw_fields"),
        keep(lambda m: m["content"]).alias("raw_texts"),
        keep(lambda m: F.substring(m["content"], m["start"] + 1, m["end"] - m["start"])).alias("raw_matched_phrase"),
        F.size("matches").alias("n_matches"),
        F.col("ungrounded").alias("llm_ungrounded_quotes"),
        F.lit(FULL_RECORD if full_record else ATTRIBUTES).alias("llm_pass"),
        F.when(ok, F.lit("")).otherwise(F.coalesce("explanation", F.lit(""))).alias("explanation"),
    )


def verify_batch(items: DataFrame, make: Callable[[], Proposer], full_record: bool = False, explain: bool = False, max_chars: int = 8000) -> DataFrame:
    """Asks about the items of each record in one prompt and judges the answers.

    ``items`` has accession, item_ord, target_field, target_value, hint,
    attributes and secondary.  Items are numbered from 1 in their order.  Without
    an answer, or a readable one, the verdict is null.
    """
    numbered = items.withColumn("item_index", F.row_number().over(Window.partitionBy("accession").orderBy("item_ord")))
    line = shred.item_line(F.col("item_index"), F.col("target_field"), F.col("target_value"), F.col("hint"))
    asked = numbered.groupBy("accession").agg(F.first("attributes").alias("a"), F.first("secondary").alias("s"), F.array_sort(F.collect_list(F.struct("item_index", line.alias("line")))).alias("i"))
    if full_record:
        context = shred.record_lines(F.col("a"), F.col("s"))
    else:
        context = shred.attribute_lines(F.col("a"))
    named = shred.attribute_lines(F.filter("s", lambda e: e["name"].isin("title", "comment")))
    lines = F.transform("i", lambda x: x["line"])
    prompts = asked.select("accession", shred.prompt(F.concat(context, F.lit("\n"), named), lines, explain).alias("prompt"))
    verdicts = answer(prompts, make, max_chars).select("accession", F.explode(parse_verdicts("answer")).alias("v")).select("accession", "v.*")
    return judged(numbered.join(verdicts, ["accession", "item_index"], "left").drop("item_index"), full_record)


def two_passes(items: DataFrame, make: Callable[[], Proposer], short_only: bool = False, long_only: bool = False, explain: bool = False) -> DataFrame:
    """Attributes first; what is still not found goes on to the whole record, whose row then counts.

    Each pass is stored before it is used, so the model is asked each prompt once.
    """
    if short_only and long_only:
        raise ValueError("short_only and long_only exclude each other")
    if long_only:
        return store(verify_batch(items, make, True, explain), "pass")
    first = store(verify_batch(items, make), "pass")
    if short_only:
        return first
    open_ = items.join(first.where(F.col("strategy") == NOT_FOUND).select(*KEYS).distinct(), KEYS, "left_semi")
    second = store(verify_batch(open_, make, True, explain), "pass")
    return first.join(second.select(*KEYS).distinct(), KEYS, "left_anti").unionByName(second)


def controlled(items: DataFrame, make: Callable[[], Proposer]) -> DataFrame:
    """All items under both conditions, without escalation, for comparing them."""
    return verify_batch(items, make).withColumn("condition", F.lit(ATTRIBUTES)).unionByName(verify_batch(items, make, True).withColumn("condition", F.lit(FULL_RECORD)))


def negation_hint() -> Column:
    """A note on a match that the cascade found but took for negated, from its first match."""
    note = F.format_string("a search found '%s' in field '%s', but in what looks like a negated context", F.get("raw_matched_phrase", F.lit(0)), F.get("raw_fields", F.lit(0)))
    return F.when(F.col("row_negated") & (F.size("raw_fields") > 0), note)


def residual(trace: DataFrame, shard: int = 0, shards: int = 1, sample: int | None = None, seed: int = 0) -> DataFrame:
    """Items still not found, of one shard of the accessions and, if asked for, a seeded sample of these."""
    rows = trace.where(F.col("strategy") == NOT_FOUND).where(shard_of(F.col("accession"), shards) == shard)
    if sample is not None:
        chosen = rows.select("accession").distinct().orderBy(order_key(seed, "accession"), "accession").limit(sample)
        rows = rows.join(chosen, "accession", "left_semi")
    return rows.select("accession", "run_name", "target_field", "target_value", negation_hint().alias("hint"))


def residual_of_pass(rows: DataFrame) -> DataFrame:
    """Items that an earlier pass left open; of several files the last that names an accession counts."""
    open_ = rows.where(F.col("strategy") == NOT_FOUND)
    last = open_.groupBy("accession").agg(F.max("file").alias("file"))
    return open_.join(last, ["accession", "file"], "left_semi").select("accession", "target_field", "target_value", "hint")


def merged_rows(*files: DataFrame) -> DataFrame:
    """Rows of several files under one accession, in file order; none replaces another."""
    every = None
    for k, f in enumerate(files):
        part = f.select("accession", F.lit(k).alias("file_ord"), "pos", F.struct(*[c for c in f.columns if c not in ("accession", "pos")]).alias("row"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("accession").agg(F.transform(F.array_sort(F.collect_list(F.struct("file_ord", "pos", "row"))), lambda x: x["row"]).alias("rows"))


def merge_stages(trace: DataFrame, stages: list[DataFrame]) -> DataFrame:
    """Overwrites open trace rows with the accepted rows of the model's stages.

    A key that two stages resolve, or one twice, raises: stages must be disjoint.
    Rows that are found already stay, and no row is added or lost.  Without stages
    the trace stays as it is.
    """
    fields = ["strategy", "raw_fields", "raw_texts", "raw_matched_phrase", "n_matches", "llm_pass"]
    base = trace if "llm_pass" in trace.columns else trace.withColumn("llm_pass", F.lit(None).cast("string"))
    if not stages:
        return base
    union = None
    for k, stage in enumerate(stages):
        part = stage.where(F.col("strategy") == LLM).select(*KEYS, *fields, F.lit(k).alias("stage"))
        union = part if union is None else union.unionByName(part)
    clash = union.groupBy(*KEYS).agg(F.count("*").alias("n"), *[F.first(f).alias(f"{f}_llm") for f in fields])
    once = clash.where(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("resolved more than once: "), F.concat_ws(" / ", *KEYS))).cast("boolean")).otherwise(True)).drop("n")
    joined = base.join(once, KEYS, "left")
    update = (F.col("strategy") == NOT_FOUND) & F.col("strategy_llm").isNotNull()
    return joined.select(*[F.when(update, F.col(f"{c}_llm")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns])


def regrounded(verdicts: DataFrame) -> DataFrame:
    """Reference verdicts with their quotes grounded in the whole record: accepted and evidence_fields."""
    rows = ground(verdicts, full_record=True)
    ok = accepted(F.col("verdict") == "found", F.col("quotes"), F.col("ungrounded"))
    return rows.withColumn("accepted", ok).withColumn("evidence_fields", F.transform("matches", lambda m: m["name"])).drop("matches", "ungrounded")


def evidence_in_attributes(fields: Column, names: Column) -> Column:
    """Whether there are evidence fields and each is the name of an attribute."""
    return (F.size(fields) > 0) & (F.size(F.array_except(fields, names)) == 0)


def production(trace: DataFrame, entries: DataFrame, proposers: list[tuple[Callable[[], Proposer], dict]]) -> DataFrame:
    """The whole run: each proposer in turn gets what the ones before left open; then the merge."""
    current = trace
    for make, options in proposers:
        items = residual(current).join(entries, "accession").withColumn("item_ord", F.xxhash64("target_field", "target_value"))
        current = merge_stages(current, [two_passes(items.dropDuplicates(KEYS), make, **options)])
    return current


def time_boxed(items: DataFrame, path: str, make: Callable[[], Proposer], shards: int = 16, max_seconds: float | None = None, **options) -> DataFrame:
    """Runs ``two_passes`` shard by shard until the time is up; returns the progress, one row a shard that this call did.

    Shards go by a hash of the accession.  Each is written as a folder of its own
    when it is done and passed over by later calls, so a run goes on where the last
    one stopped.  Progress has shard, done, pending (shards), seconds and eta, the
    seconds that the rest will take at this rate.
    """
    import time

    spark = items.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    fs = jpath(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = lambda k: fs.exists(jpath(f"{path}/shard={k}/_SUCCESS"))
    began, log = time.monotonic(), []
    todo = [k for k in range(shards) if not there(k)]
    for n, k in enumerate(todo):
        if max_seconds is not None and time.monotonic() - began >= max_seconds:
            break
        two_passes(items.where(shard_of(F.col("accession"), shards) == k), make, **options).write.mode("overwrite").parquet(f"{path}/shard={k}")
        spent = time.monotonic() - began
        log.append((k, shards - len(todo) + n + 1, len(todo) - n - 1, spent, spent / (n + 1) * (len(todo) - n - 1)))
    return spark.createDataFrame(log, "shard int, done int, pending int, seconds double, eta double")
