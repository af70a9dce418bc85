"""Queries that write the test tables as the files of a run and read them back, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cascade, reports, shred
from ..schema import LLM, NOT_FOUND
from ..scratch import folder
from ..sources import ontology, records
from .queries import LINE_SQL, lineitem_trace, table


def put_lines(lines: DataFrame, path: str) -> str:
    """Writes a column of lines, in their order, as the one file ``path``."""
    spark = lines.sparkSession
    raw = folder(spark, "lines")
    lines.coalesce(1).write.text(raw)
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    fs = jpath(raw).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    [part] = [f.getPath() for f in fs.globStatus(jpath(f"{raw}/part-*"))]
    fs.mkdirs(jpath(path).getParent())
    fs.rename(part, jpath(path))
    return path


def customer_lines(spark: SparkSession, sf_dir: str, copy: int) -> DataFrame:
    """Customers as JSON lines; every tenth has a number for an accession beside a nested string."""
    c = table(spark, sf_dir, "customer")
    odd = F.format_string('{"accession":%d,"Ids":{"accession":"Z%d"},"copy":%d}', "c_custkey", "c_custkey", F.lit(copy))
    flat = F.format_string('{"copy":%d,"BioSample":{"accession":"inner"},"accession":"A%d"}', F.lit(copy), "c_custkey")
    return c.select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, odd).otherwise(flat).alias("value"))


def read_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two nested folders, blank lines between them."""
    top = folder(spark, "records")
    lines = customer_lines(spark, sf_dir, 1)
    blank = spark.range(3).select(F.lit("   ").alias("value"))
    put_lines(lines.where("c_custkey % 2 = 0").select("value").union(blank), f"{top}/even/a.jsonl")
    put_lines(lines.where("c_custkey % 2 = 1").select("value"), f"{top}/odd/deep/b.jsonl")
    put_lines(blank.select(F.lit("no record").alias("value")), f"{top}/odd/notes.txt")
    got = records.read_records(spark, top, recursive=True)
    return got.groupBy("accession").agg(F.count("*").alias("n"))


READ_JSONL_SQL = "select case when c_custkey % 10 <> 0 then 'A' || c_custkey end as accession, count(*) as n from customer group by 1"


def two_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with the odd customers before one with all of them."""
    top = folder(spark, "records")
    put_lines(customer_lines(spark, sf_dir, 1).where("c_custkey % 2 = 1").select("value"), f"{top}/a.jsonl")
    put_lines(customer_lines(spark, sf_dir, 2).select("value"), f"{top}/b.jsonl")
    return records.read_records(spark, top)


def find_first_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record of each customer with an urgent order."""
    wanted = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("A"), "o_custkey").alias("accession"))
    got = records.find_records(two_copies(spark, sf_dir), wanted)
    return got.select("accession", F.get_json_object("raw", "$.copy").cast("int").alias("copy"))


FIND_FIRST_SQL = """
select distinct 'A' || o_custkey as accession, case when o_custkey % 2 = 1 then 1 else 2 end as copy
from orders where o_orderpriority = '1-URGENT' and o_custkey % 10 <> 0 and o_custkey in (select c_custkey from customer)
"""


def find_one_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single look-ups: one in both files, one in the second only, one that a nested accession must not answer."""
    rows = two_copies(spark, sf_dir)
    out = None
    for wanted in ("A3", "A4", "Z10", "inner"):
        one = records.find_record(rows, wanted).select(F.lit(wanted).alias("wanted"), F.get_json_object("raw", "$.copy").cast("int").alias("copy"))
        out = one if out is None else out.unionByName(one)
    return out


FIND_ONE_SQL = "select 'A3' as wanted, 1 as copy union all select 'A4', 2"


def run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a tab-separated run index; completed ones by the category of their dataset."""
    path = folder(spark, "runs")
    datasets = F.array(*[F.lit(d) for d in ("rnaseq_human_1", "rnaseq_mouse", "chipatlas_hg38_x", "chipatlas_mm10")])
    runs = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("run"), "o_orderkey").alias("run_name"),
        F.get(datasets, (F.col("o_orderkey") % 4).cast("int")).alias("dataset"),
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"),
    )
    runs.write.csv(path, sep="\t", header=True)
    kind, organism = shred.category(F.col("dataset"))
    done = records.read_run_index(spark, path).select("run_name", kind.alias("category"), organism.alias("organism"))
    return done.groupBy("category", "organism").agg(F.count("*").alias("n"), F.min("run_name").alias("first"))


RUN_INDEX_SQL = """
select case when o_orderkey % 4 < 2 then 'DDBJ RNA-Seq' else 'ChIP-Atlas' end as category, case when o_orderkey % 2 = 0 then 'Homo sapiens' else 'Mus musculus' end as organism,
       count(*) as n, min('run' || o_orderkey) as first
from orders where o_orderstatus = 'F' group by 1, 2
"""


def result_files(spark: SparkSession, sf_dir: str) -> str:
    """One object of results a region: each nation twice, of which the second counts; the extracted names with their terms."""
    nations = table(spark, sf_dir, "nation")
    accession = F.concat(F.lit("N"), "n_nationkey")
    old = F.format_string('{"extract":{"accession":"%s","extracted":{"country":"old","note":""}},"results":{}}', accession)
    new = F.format_string(
        '{"extract":{"accession":"%s","extracted":{"country":["%s",null,"other"],"number":%d,"none":null}},"results":{"country":[{"value":"x","term_id":"T:0"},{"value":"%s","term_id":"T:%d"}]}}',
        accession, "n_name", "n_nationkey", "n_name", "n_nationkey",
    )
    entries = nations.select("n_regionkey", F.concat(old, F.lit(","), new).alias("e"))
    whole = entries.groupBy("n_regionkey").agg(F.concat(F.lit('{"entries":['), F.array_join(F.sort_array(F.collect_list("e")), ","), F.lit("]}")).alias("value"))
    path = folder(spark, "results")
    whole.write.partitionBy("n_regionkey").text(path)
    return f"{path}/*"


def results_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the last entry of each accession, with the terms assigned to them by value."""
    values = cascade.explode_values(records.read_results(spark, result_files(spark, sf_dir)))
    term = cascade.term_of_value(F.col("results"), F.col("target_field"), F.col("target_value"))
    return values.select("accession", "target_field", "value_ord", "target_value", term.alias("term_id"))


RESULTS_SQL = """
select 'N' || n_nationkey as accession, 'country' as target_field, 0 as value_ord, n_name as target_value, 'T:' || n_nationkey as term_id from nation
union all select 'N' || n_nationkey, 'country', 1, 'other', null from nation
union all select 'N' || n_nationkey, 'number', 0, n_nationkey::varchar, null from nation
"""


def trace_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run: record lines, some twice, joined with results and terms, traced through the cascade."""
    nations = table(spark, sf_dir, "nation")
    spelt = F.when(F.col("n_nationkey") % 3 == 0, F.lower("n_name")).when(F.col("n_nationkey") % 3 == 1, F.replace("n_name", F.lit("_"), F.lit(" "))).otherwise(F.lit("land nine"))
    line = F.format_string('{"accession":"N%d","Attributes":{"Attribute":{"attribute_name":"country","content":"from %s"}},"Description":{"Title":null}}', "n_nationkey", spelt)
    twice = nations.select("n_nationkey", line.alias("value")).union(nations.where("n_nationkey % 5 = 0").select("n_nationkey", line.alias("value")))
    path = put_lines(twice.orderBy("n_nationkey").select("value"), f"{folder(spark, 'run')}/in.jsonl")
    rows = records.with_entries(records.read_records(spark, path))
    terms = nations.select(F.lit("country").alias("field"), F.concat(F.lit("T:"), "n_nationkey").alias("term_id"), F.lit("land nine").alias("label"), F.array(F.lit("ninth land")).alias("exact_synonyms"), F.array().cast("array<string>").alias("related_synonyms"))
    out = cascade.trace(rows, records.read_results(spark, result_files(spark, sf_dir)), terms)
    return out.select("accession", "target_field", "target_value", "strategy", "n_matches", F.get("raw_matched_phrase", F.lit(0)).alias("phrase"), "assigned_term_id", "assigned_term_label", "assigned_term_synonyms")


TRACE_RUN_SQL = """
with r as (select n_nationkey as k, n_name from nation union all select n_nationkey, n_name from nation where n_nationkey % 5 = 0)
select 'N' || k as accession, 'country' as target_field, n_name as target_value,
       case when k % 3 = 0 then 'case-insensitive' when k % 3 = 1 then 'normalized' else 'ontology synonym' end as strategy, 1 as n_matches,
       case when k % 3 = 0 then lower(n_name) when k % 3 = 1 then replace(n_name, '_', ' ') else 'land nine' end as phrase,
       'T:' || k as assigned_term_id, 'land nine' as assigned_term_label, 'ninth land' as assigned_term_synonyms
from r
union all select 'N' || k, 'country', 'other', 'not found', 0, null, '', '', '' from r
union all select 'N' || k, 'number', k::varchar, case when k % 3 < 2 then 'exact' else 'not found' end, case when k % 3 < 2 then 1 else 0 end, case when k % 3 < 2 then k::varchar end, '', '', '' from r
"""


def llm_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the rows of a model's output, one JSON line an order."""
    rows = lineitem_trace(spark, sf_dir)
    passes = F.when(F.col("ord") % 2 == 0, "attributes").otherwise("full_record")
    kind = F.when(F.col("row_negated"), LLM).otherwise(NOT_FOUND)
    said = rows.groupBy("accession").agg(F.to_json(F.sort_array(F.collect_list(F.struct("ord", "target_field", "target_value", kind.alias("strategy"), passes.alias("llm_pass"))))).alias("rows"))
    path = folder(spark, "said")
    lines = said.select(F.concat(F.lit('{"accession":"'), "accession", F.lit('","model":"m","rows":'), "rows", F.lit("}")).alias("value"))
    lines.union(lines.limit(2).select(F.lit(" ").alias("value"))).write.text(path)
    got = records.read_llm_rows(spark, path, "struct<target_field:string,target_value:string,strategy:string,llm_pass:string>")
    return got.groupBy("model", "strategy", "llm_pass").agg(F.count("*").alias("n"), F.countDistinct("accession").alias("n_accessions"), F.max("pos").alias("last_pos"))


LLM_ROWS_SQL = LINE_SQL + """
, p as (select *, row_number() over (partition by accession order by ord, target_field, target_value, row_negated) - 1 as pos from t)
select 'm' as model, case when row_negated then 'llm' else 'not found' end as strategy, case when ord % 2 = 0 then 'attributes' else 'full_record' end as llm_pass,
       count(*) as n, count(distinct accession) as n_accessions, max(pos)::int as last_pos
from p group by 1, 2, 3
"""


def verdict_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as annotated cases in chunk files, all of which must be there."""
    cases = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("int").alias("case_index"),
        F.concat(F.lit("A"), "c_custkey").alias("accession"),
        F.col("c_mktsegment").alias("target_field"),
        F.when(F.col("c_acctbal") > 0, "found").otherwise("not_found").alias("verdict"),
        F.when(F.col("c_acctbal") > 0, F.array("c_name")).otherwise(F.array().cast("array<string>")).alias("quotes"),
    )
    path = folder(spark, "verdicts")
    records.chunks(cases, 100).select("chunk", F.col("cases").alias("value")).write.partitionBy("chunk").text(path)
    got = records.read_verdicts(spark, f"{path}/*", cases.count())
    return got.groupBy("target_field", "verdict").agg(F.count("*").alias("n"), F.sum(F.size("quotes")).alias("n_quotes"), F.max("case_index").alias("last_case"))


VERDICTS_SQL = """
select c_mktsegment as target_field, case when c_acctbal > 0 then 'found' else 'not_found' end as verdict, count(*) as n,
       count(*) filter (where c_acctbal > 0) as n_quotes, max(c_custkey)::int as last_case
from customer group by 1, 2
"""


def model_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of two models with a metadata file beside each, scored against the labels."""
    path = folder(spark, "models")
    labels = table(spark, sf_dir, "labels")
    rule = {"a": "doc_id % 3 = 0", "b": "quality = 1 or doc_id % 7 = 0"}
    for name, found in rule.items():
        put_lines(labels.select(F.to_json(F.struct(F.col("doc_id").alias("case_index"), F.expr(found).alias("found"))).alias("value")), f"{path}/out_{name}.jsonl")
        put_lines(spark.range(1).select(F.lit(f'{{"model": "model {name}",\n "seed": 3}}').alias("value")), f"{path}/out_{name}.meta.json")
    got = records.read_model_results(spark, path, "case_index long, found boolean", "model string, seed int")
    pairs = got.join(labels, F.col("case_index") == F.col("doc_id"))
    return reports.confusion(pairs, F.col("found"), F.col("quality") == 1, "model", "seed")


MODEL_RESULTS_SQL = """
with r as (
  select 'model a' as model, doc_id % 3 = 0 as p, quality = 1 as a from labels
  union all select 'model b', quality = 1 or doc_id % 7 = 0, quality = 1 from labels),
c as (select model, 3 as seed, count(*) filter (where p and a) as tp, count(*) filter (where p and not a) as fp, count(*) filter (where not p and a) as fn, count(*) filter (where not p and not a) as tn from r group by 1)
select *, case when tp + fp = 0 then 'nan'::double else tp / (tp + fp) end as precision, case when tp + fn = 0 then 'nan'::double else tp / (tp + fn) end as recall, (tp + tn) / (tp + fp + fn + tn) as accuracy
from c
"""


def ontology_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term file a region: its nations as classes, one of them twice; fields name their file, one without and one with a missing one."""
    top = folder(spark, "owl")
    nations = table(spark, sf_dir, "nation")
    names = [r["r_name"] for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]  # one a file
    for k, name in enumerate(names):
        blocks = F.array(
            F.lit("<rdfs:label>before any class</rdfs:label>"),
            F.format_string('<owl:Class rdf:about="http://x/obo/NA_%d"><rdfs:label>on the class line</rdfs:label>', "n_nationkey"),
            F.lit("<rdfs:label>first</rdfs:label>"),
            F.format_string("  <rdfs:label>%s</rdfs:label>", "n_name"),
            F.format_string("<oboInOwl:hasExactSynonym>nation %d</oboInOwl:hasExactSynonym>", "n_nationkey"),
            F.lit('<oboInOwl:hasExactSynonym xml:lang="en">unseen</oboInOwl:hasExactSynonym>'),
            F.format_string("<oboInOwl:hasRelatedSynonym>%s</oboInOwl:hasRelatedSynonym>", F.lit(name)),
            F.format_string('<owl:Class rdf:about="http://x/obo/NA_again%d">', "n_regionkey"),
            F.format_string("<oboInOwl:hasExactSynonym>last of %d</oboInOwl:hasExactSynonym>", "n_nationkey"),
        )
        lines = nations.where(F.col("n_regionkey") == k).select("n_nationkey", F.posexplode(blocks).alias("i", "value")).orderBy("n_nationkey", "i")
        put_lines(lines.select("value"), f"{top}/{name}.owl")
    config = spark.createDataFrame([(n.lower(), f"any/dir/{n}.owl") for n in names] + [("free", None), ("gone", "any/missing.owl")], "field string, ontology_file string")
    terms = ontology.terms(ontology.read_lines(spark, f"{top}/*.owl"))
    return ontology.field_terms(config, terms).select("field", "term_id", "label", F.array_join("exact_synonyms", "|").alias("exact"), F.array_join("related_synonyms", "|").alias("related"))


ONTOLOGY_SQL = """
select lower(r_name) as field, 'NA:' || n_nationkey as term_id, n_name as label, 'nation ' || n_nationkey as exact, r_name as related from nation join region on n_regionkey = r_regionkey
union all
select lower(any_value(r_name)), 'NA:again' || r_regionkey, case when count(*) >= 1 then null end::varchar, 'last of ' || max(n_nationkey), '' from nation join region on n_regionkey = r_regionkey group by r_regionkey
"""


def resumed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs written as partitions; what is there is passed over, one run is written anew."""
    path = folder(spark, "chunks")
    runs = lineitem_trace(spark, sf_dir).select(F.col("target_field").alias("run_name"), "strategy", F.lit(1).alias("turn"))
    before = records.written_runs(spark, path).count()
    records.write_runs(runs.where("run_name <> 'N'"), path)
    records.write_runs(records.pending(runs, records.written_runs(spark, path), ["run_name"]).withColumn("turn", F.lit(2)), path)
    records.write_runs(runs.where("run_name = 'A'").withColumn("turn", F.lit(3)), path)
    return spark.read.parquet(path).groupBy("run_name", "turn").agg(F.count("*").alias("n"), F.lit(before).cast("int").alias("n_before"))


RESUMED_SQL = LINE_SQL + "select target_field as run_name, case target_field when 'A' then 3 when 'N' then 2 else 1 end as turn, count(*) as n, 0 as n_before from t group by 1, 2"


def swapped_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that was replaced, and the one before it."""
    path = folder(spark, "table")
    rows = table(spark, sf_dir, "supplier")
    records.replace_table(rows.where("s_suppkey % 2 = 0"), path)
    records.replace_table(rows, path)
    count = lambda p, name: spark.read.parquet(p).agg(F.lit(name).alias("which"), F.count("*").alias("n"), F.sum("s_nationkey").alias("keys"))
    return count(path, "now").unionByName(count(f"{path}.bak", "before"))


SWAPPED_SQL = "select 'now' as which, count(*) as n, sum(s_nationkey)::bigint as keys from supplier union all select 'before', count(*), sum(s_nationkey)::bigint from supplier where s_suppkey % 2 = 0"


def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings of a run, written and read."""
    path = folder(spark, "manifest")
    records.write_manifest(spark, path, model="m", seed=3, temperature=0.0, tables=table(spark, sf_dir, "region").count())
    got = spark.read.json(path)
    return got.select("model", "seed", "temperature", "tables", F.col("started_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$").alias("has_time"))


MANIFEST_SQL = "select 'm' as model, 3::bigint as seed, 0.0::double as temperature, count(*) as tables, true as has_time from region"


def pass_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace rows of line items, the negated ones of the last strategy resolved by one pass or the other."""
    rows = lineitem_trace(spark, sf_dir)
    by_model = (F.col("strategy") == NOT_FOUND) & F.col("row_negated")
    passes = F.when(by_model, F.when(F.col("n_matches") % 2 == 0, "attributes").otherwise("full_record"))
    return rows.withColumn("llm_pass", passes).withColumn("strategy", F.when(by_model, LLM).otherwise(F.col("strategy")))


PASS_SQL = LINE_SQL + """
, q as (
  select target_field, case when strategy = 'not found' and row_negated then 'llm' else strategy end as strategy,
         case when strategy = 'not found' and row_negated then case when n_matches % 2 = 0 then 'attributes' else 'full_record' end end as llm_pass
  from t)
"""


def coverage_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reconciled report as one JSON object, read back."""
    path = folder(spark, "report")
    records.write_report(reports.reconciled_coverage(pass_rows(spark, sf_dir), ["attributes", "full_record"]), path)
    schema = "total long, deterministic long, llm_attributes long, llm_full_record long, residual long, pct_deterministic double, pct_residual double"
    return spark.read.schema(schema).json(path)


COVERAGE_JSON_SQL = PASS_SQL + """
select count(*) as total, count(*) filter (where strategy not in ('llm', 'not found')) as deterministic,
       count(*) filter (where llm_pass = 'attributes') as llm_attributes, count(*) filter (where llm_pass = 'full_record') as llm_full_record, count(*) filter (where strategy = 'not found') as residual,
       round_even(100.0::double * count(*) filter (where strategy not in ('llm', 'not found')) / count(*), 2) as pct_deterministic,
       round_even(100.0::double * count(*) filter (where strategy = 'not found') / count(*), 2) as pct_residual
from q
"""


def field_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a model resolved, by field and pass."""
    return reports.pass_tallies(pass_rows(spark, sf_dir))


TALLIES_SQL = PASS_SQL + "select target_field, count(*) filter (where llm_pass = 'attributes') as n_attributes, count(*) filter (where strategy = 'llm') as n_llm from q group by 1"


def record_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide row of a record: organism under either name, small objects as flat text, lists as arrays."""
    c = table(spark, sf_dir, "customer")
    organism = F.when(F.col("c_custkey") % 3 == 0, '{"OrganismName":"","taxonomy_name":"Mus"}').when(F.col("c_custkey") % 3 == 1, '{"OrganismName":"Homo","taxonomy_name":"x"}').otherwise("{}")
    owner = F.format_string('{"Name":{"content":"%s","url":null,"abbreviation":""},"Contacts":[{"id":%d},{"id":true}]}', "c_name", "c_custkey")
    attribute = F.when(F.col("c_custkey") % 2 == 0, '{"attribute_name":"a","content":"1"}').otherwise('[{"attribute_name":"a","content":"1"},{"attribute_name":"b","content":"2"}]')
    raw = F.format_string('{"accession":"A%d","Description":{"Organism":%s,"Title":"t"},"Owner":%s,"Attributes":{"Attribute":%s}}', F.col("c_custkey"), organism, owner, attribute)
    out = shred.summary(c.select(raw.alias("raw")))
    return out.select("accession", "organism", "title", "owner", "model", F.size("attributes").alias("n_attributes"), F.size("links").alias("n_links"))


SUMMARY_SQL = """
select 'A' || c_custkey as accession, case c_custkey % 3 when 0 then 'Mus' when 1 then 'Homo' end as organism, 't' as title,
       'Name.content: ' || c_name || '; Name.abbreviation: ; Contacts.id: ' || c_custkey || '; Contacts.id: True' as owner, '' as model,
       case when c_custkey % 2 = 0 then 1 else 2 end as n_attributes, 0 as n_links
from customer
"""

QUERIES = {
    f.__name__: f
    for f in (
        read_jsonl, find_first_records, find_one_record, run_index, results_last_wins, trace_run, llm_rows, verdict_chunks, model_results, ontology_files,
        resumed_runs, swapped_table, run_manifest, coverage_json, field_tallies, record_summary,
    )
}

ORACLE = {
    "read_jsonl": READ_JSONL_SQL,
    "find_first_records": FIND_FIRST_SQL,
    "find_one_record": FIND_ONE_SQL,
    "run_index": RUN_INDEX_SQL,
    "results_last_wins": RESULTS_SQL,
    "trace_run": TRACE_RUN_SQL,
    "llm_rows": LLM_ROWS_SQL,
    "verdict_chunks": VERDICTS_SQL,
    "model_results": MODEL_RESULTS_SQL,
    "ontology_files": ONTOLOGY_SQL,
    "resumed_runs": RESUMED_SQL,
    "swapped_table": SWAPPED_SQL,
    "run_manifest": MANIFEST_SQL,
    "coverage_json": COVERAGE_JSON_SQL,
    "field_tallies": TALLIES_SQL,
    "record_summary": SUMMARY_SQL,
}
