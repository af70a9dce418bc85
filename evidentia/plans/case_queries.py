"""Queries for single rules of matching, evidence, checks and display over the test tables, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cascade, checks, display, evidence, reports, sampling, shred
from ..schema import LLM, NOT_FOUND
from ..scratch import folder
from .queries import LINE_SQL, Recorded, entry, lineitem_trace, matched, no_entries, part_questions, table

# --- matching -----------------------------------------------------------------


def affix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last word of a part's name with known markers, a mutation or other letters fused to it."""
    k, word = F.col("p_partkey") % 6, F.element_at(F.split("p_name", " "), -1)
    content = F.when(k == 0, F.concat(word, F.lit("KO"))).when(k == 1, F.concat(F.lit("sh"), word)).when(k == 2, F.concat(word, F.lit("G12D"))).when(k == 3, F.concat(F.lit("qqqq"), word)).when(k == 4, F.concat(word, F.lit("OExyz"))).otherwise(F.concat(F.lit("peg"), word, F.lit("eGFP")))
    items = table(spark, sf_dir, "part").select("p_partkey", word.alias("target_value"), F.array(entry(F.lit("g"), F.concat(F.lit("a "), content, F.lit(" b")))).alias("attributes"), no_entries().alias("secondary"))
    return matched(items, "p_partkey")


AFFIX_SQL = """
with w as (select p_partkey, p_partkey % 6 as k, string_split(p_name, ' ')[-1] as w from part),
f as (select *, k in (0, 1, 2, 5) and length(w) >= 4 as ok from w)
select p_partkey, case when ok then 'normalized' else 'not found' end as strategy, case when ok then 'g' end as raw_field, case when ok then w end as phrase, case when ok then 1 else 0 end as n_matches
from f
"""


def spelling_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of a part's name, doubled, against a misspelt form: is it one spelling?"""
    k, word = F.col("p_partkey") % 8, F.concat(F.element_at(F.split("p_name", " "), 1), F.element_at(F.split("p_name", " "), -1))
    other = (
        F.when(k == 0, F.upper(word))
        .when(k == 1, F.replace(word, F.lit("i"), F.lit("1")))
        .when(k == 2, F.concat(word, F.lit("x")))
        .when(k == 3, F.concat(F.substring(word, 1, 2), F.substring(word, 5, 100)))
        .when(k == 4, F.concat(F.lit("xyz"), word))
        .when(k == 5, F.concat(word, F.lit("4")))
        .when(k == 6, F.replace(word, F.lit("l"), F.lit("I")))
        .otherwise(F.concat(F.lit("wxyz"), word))
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", word.alias("a"), other.alias("b"))
    return rows.select("p_partkey", "a", "b", T.one_confusable_swap(F.col("a"), F.col("b")).alias("one_swap"), T.words_fuzzy_equal(F.col("a"), F.col("b")).alias("one_spelling"))


SPELLING_SQL = """
with w as (select p_partkey, p_partkey % 8 as k, string_split(p_name, ' ')[1] || string_split(p_name, ' ')[-1] as a from part),
v as (select p_partkey, a, case k when 0 then upper(a) when 1 then replace(a, 'i', '1') when 2 then a || 'x' when 3 then substr(a, 1, 2) || substr(a, 5) when 4 then 'xyz' || a when 5 then a || '4' when 6 then replace(a, 'l', 'I') else 'wxyz' || a end as b from w),
x as (select *, lower(a) as x, lower(b) as y, least(length(a), length(b)) as n, regexp_extract_all(a, '[0-9]+') as d, regexp_extract_all(b, '[0-9]+') as e from v),
s as (select *, length(a) = length(b) and translate(x, 'lio', '110') = translate(y, 'lio', '110')
        and len(list_filter(range(1, length(x) + 1), lambda i: x[i] <> y[i])) = 1 as one_swap from x)
select p_partkey, a, b, one_swap, x = y or one_swap or (d = e and n >= 6 and levenshtein(x, y) <= case when len(d) + len(e) > 0 then 1 when n < 8 then 1 when n < 14 then 2 else 3 end) as one_spelling
from s
"""

#: Sentences about a name, and whether it is negated in each.
SENTENCES = [
    ("no evidence of {}", True),
    ("{} was ruled out", True),
    ("not treated but {}", False),
    ("No drug. With {}", False),
    ("no drug.Then {}", False),
    ("no drug, 1.5 of {}", True),
    ("cat. no P5, {}", False),
    ("gram negative {}", False),
    ("never seen {}", True),
    ("{} (feeder free)", False),
    ("absence of any {}, which grew", True),
    ("no growth, which {} shows", False),
    ("not only {}", False),
    ("no {}? Yes", True),
    ("in {} unlikely", True),
    ("with {}! No other", False),
]


def negation_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments in sentences of each kind; a negated row is not found but keeps its evidence."""
    c = table(spark, sf_dir, "customer")
    sentences = F.array(*[F.lit(s) for s, _ in SENTENCES])
    text = F.replace(F.get(sentences, (F.col("c_custkey") % len(SENTENCES)).cast("int")), F.lit("{}"), F.col("c_mktsegment"))
    items = c.select("c_custkey", F.lit("segment").alias("target_field"), F.col("c_mktsegment").alias("target_value"), F.array(entry(F.lit("note"), text)).alias("attributes"), no_entries().alias("secondary"))
    return cascade.verify(items).select("c_custkey", "strategy", "row_negated", "n_matches", F.get("raw_texts", F.lit(0)).alias("text"))


NEGATION_SQL = (
    "with s as (select unnest(["
    + ", ".join(f"{{'k': {k}, 't': '{t}', 'neg': {str(neg).lower()}}}" for k, (t, neg) in enumerate(SENTENCES))
    + f"""], recursive := true))
select c_custkey, case when neg then 'not found' else 'exact' end as strategy, neg as row_negated, 1 as n_matches, replace(t, '{{}}', c_mktsegment) as text
from customer join s on c_custkey % {len(SENTENCES)} = k
"""
)


def one_word_denials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are one word of denial and nothing else."""
    k = F.col("p_partkey") % 5
    text = F.when(k == 0, F.concat(F.lit("No"), F.regexp_extract("p_name", "^[a-z]+", 0))).when(k == 1, F.concat(F.lit("no"), F.lower("p_type"))).when(k == 2, F.concat(F.lit("no "), "p_name")).when(k == 3, F.lit("nobody\n")).otherwise(F.lit("nought"))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text")).select("p_partkey", T.one_word_denial(F.col("text")).alias("denies"))


DENIALS_SQL = r"""
with t as (select p_partkey, case p_partkey % 5 when 0 then 'No' || regexp_extract(p_name, '^[a-z]+') when 1 then 'no' || lower(p_type) when 2 then 'no ' || p_name when 3 then 'nobody' || chr(10) else 'nought' end as text from part)
select p_partkey, regexp_full_match(text, '[Nn]o[a-z]{5,}') as denies from t
"""


def display_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a phrase stands, exactly, ignoring case or nowhere, and the text with it in bold."""
    k = F.col("p_partkey") % 3
    text = F.concat(F.lit("<a> & "), F.col("p_name"), F.lit(" '\""), F.col("p_type"))
    phrase = F.when(k == 0, F.col("p_type")).when(k == 1, F.upper("p_name")).otherwise("nowhere")
    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("t"), T.phrase_span(text, phrase).alias("s"))
    return rows.select("p_partkey", F.col("s.start").alias("start"), F.col("s.end").alias("end"), T.bold_span(F.col("t"), F.col("s.start"), F.col("s.end")).alias("html"))


DISPLAY_SQL = """
with t as (select p_partkey, p_partkey % 3 as k, p_name, p_type from part)
select p_partkey, case k when 0 then 8 + length(p_name) + 1 when 1 then 6 else 0 end::int as start,
       case k when 0 then 8 + length(p_name) + 1 + length(p_type) when 1 then 6 + length(p_name) else 0 end::int as "end",
       case k when 0 then '&lt;a&gt; &amp; ' || p_name || ' &#x27;&quot;<b>' || p_type || '</b>'
              when 1 then '&lt;a&gt; &amp; <b>' || p_name || '</b> &#x27;&quot;' || p_type
              else '<b></b>&lt;a&gt; &amp; ' || p_name || ' &#x27;&quot;' || p_type end as html
from t
"""


def verify_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, each looked up as a single record, with the matches as they are displayed."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    record = nations.select(F.col("n_name").alias("accession"), F.array(entry(F.lit("where"), F.concat(F.lit("<in> "), F.lower("r_name")))).alias("attributes"), F.array(entry(F.lit("title"), F.concat("n_name", F.lit(" & co")))).alias("secondary"))
    values = nations.select(F.col("n_name").alias("accession"), F.create_map(F.lit("region"), "r_name", F.lit("country"), "n_name").alias("extracted"), F.lit(None).cast("map<string,array<struct<value:string,term_id:string>>>").alias("results"))
    out = cascade.verify_one(record, values)
    return out.select("accession", "target_field", "strategy", F.get("matches.raw_field", F.lit(0)).alias("raw_field"), F.get("matches.raw_text", F.lit(0)).alias("raw_text"))


VERIFY_ONE_SQL = """
select n_name as accession, 'region' as target_field, 'case-insensitive' as strategy, 'where' as raw_field, '&lt;in&gt; <b>' || lower(r_name) || '</b>' as raw_text from nation join region on n_regionkey = r_regionkey
union all select n_name, 'country', 'exact', 'title', '<b>' || n_name || '</b> &amp; co' from nation
"""


def html_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all leaves of a record stand, escaped, in a page; every third page lacks one."""
    c = table(spark, sf_dir, "customer")
    leaves = F.array(F.concat(F.lit("<"), "c_name", F.lit(">")), "c_mktsegment")
    html = F.concat(F.lit("<td>"), T.escaped(F.get(leaves, F.lit(0))), F.lit("</td>"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")))
    return c.select("c_custkey", shred.leaf_coverage(leaves, html).alias("covered"))


HTML_SQL = "select c_custkey, c_custkey % 3 <> 0 as covered from customer"


def thinned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes as label positions, thinned from the top down."""
    sizes = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("pos")).distinct()
    return reports.thin_labels(sizes, "pos", 6.0)


THINNED_SQL = """
with recursive p as (select distinct p_size::double as pos from part),
k as (select max(pos) as pos from p union all select max(p.pos) from k join p on p.pos <= k.pos - 6 having max(p.pos) is not null)
select pos from k
"""

def nested_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with their customers' segments as a nested table and a list, long texts cut."""
    c, n = table(spark, sf_dir, "customer").where("c_acctbal > 0"), table(spark, sf_dir, "nation")
    per = c.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    lists = per.groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct(F.concat(F.lit("<b>"), "c_mktsegment", F.lit("</b>")).alias("segment"), F.concat(F.lit("n & "), "n").alias("count")))).alias("segments"))
    rows = n.join(lists, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    rows = rows.select("n_name", "segments", F.transform("segments", lambda s: s["count"]).alias("counts"), F.lit("<a text that is too long>").alias("note"), F.array().cast("array<string>").alias("none"))
    return display.html_rows(rows, limit=12, raw=("segment",))


NESTED_SQL = """
with p as (select c_nationkey as k, c_mktsegment as s, count(*) as n from customer where c_acctbal > 0 group by 1, 2),
l as (select k, string_agg('<tr><td><b>' || s || '</b></td><td>n &amp; ' || n || '</td></tr>', '' order by s) as body, string_agg('n & ' || n, ', ' order by s) as c from p group by 1),
t as (select k, body, case when length(c) > 12 then substr(c, 1, 12) || '…' else c end as c from l)
select n_name, case when body is null then '' else '<table><tr><th>segment</th><th>count</th></tr>' || body || '</table>' end as segments,
       coalesce(replace(c, '&', '&amp;'), '') as counts, '&lt;a text that…' as note, '<i>(none)</i>' as none
from nation left join t on n_nationkey = k
"""


def shaded_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strategy groups of each field as a shaded table."""
    groups = ["pct_verbatim", "pct_tolerant", "pct_ontology", "pct_model"]
    return display.shaded(reports.strategy_buckets(reports.strategy_crosstab(lineitem_trace(spark, sf_dir))), "target_field", groups)


SHADED_SQL = (
    LINE_SQL
    + """
, b as (select target_field, """
    + ", ".join(f"round_even(100.0::double * count(*) filter (where strategy in ({s})) / count(*), 2) as v{k}" for k, s in enumerate(("'exact', 'case-insensitive'", "'normalized', 'bag of words', 'fuzzy'", "'ontology synonym'", "'llm'")))
    + """ from t group by 1)
select target_field, '<tr><th>' || target_field || '</th>' || """
    + " || ".join(f"""'<td style="background:hsl(120,40%,' || round(100 - 70 * v{k} / 100)::int || '%);color:' || case when v{k} >= 50 then 'white' else 'black' end || '">' || case when v{k} > 0 then printf('%.1f', v{k}) else '' end || '</td>'""" for k in range(4))
    + """ || '</tr>' as html from b
"""
)


def priority_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each priority as bars."""
    return display.bars(table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")), "o_orderpriority", "n")


BARS_SQL = """
with c as (select o_orderpriority, count(*) as n from orders group by 1)
select o_orderpriority, '<svg width="600" height="16"><rect width="' || round(n * 300 / max(n) over ())::int || '" height="14" fill="#3a7"/><text x="306" y="12">' || n || ' ' || o_orderpriority || '</text></svg>' as svg from c
"""


def notebook_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations as the headings of a notebook, and its list of contents."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    heads = r.select(F.col("r_regionkey").alias("k"), F.concat(F.lit("## "), "r_name", F.lit("\n")).alias("h")).union(n.select("n_regionkey", F.concat(F.lit("### In "), "n_name")))
    cells = heads.orderBy("k", "h").agg(F.sort_array(F.collect_list(F.struct("k", "h"))).alias("x"))  # a few dozen headings
    said = lambda text: F.struct(F.lit("markdown").alias("cell_type"), F.array(F.lit("plain # text"), text).alias("source"))
    code = F.struct(F.lit("code").alias("cell_type"), F.array(F.lit("# no heading")).alias("source"))
    path = folder(spark, "notebook")
    cells.select(F.to_json(F.struct(F.concat(F.array(said(F.lit("# All of it")), code), F.transform("x", lambda e: said(e["h"]))).alias("cells"))).alias("value")).write.text(path)
    return display.contents(display.notebook_lines(spark, path)).select(F.col("line.c").alias("cell"), "entry")


CONTENTS_SQL = """
with h as (select r_regionkey as k, '## ' || r_name || chr(10) as h, r_name as title, '- [' as lead from region union all select n_regionkey, '### In ' || n_name, 'In ' || n_name, '  - [' from nation),
o as (select *, row_number() over (order by k, h) as i from h)
select 0 as cell, chr(10) || '[All of it](#All-of-it)' as entry union all select (i + 1)::int, lead || title || '](#' || replace(title, ' ', '-') || ')' from o
"""

# --- checks and samples ---------------------------------------------------------


def set_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without line items, keys in both of two stages, and rows that share a key."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber")
    few, many = lines.where("l_linenumber <= 2"), lines.where("l_linenumber >= 6")
    counts = {"missing": checks.missing(orders, lines, ["k"]), "overlap": checks.overlap(few, many, ["k"]), "disjoint": checks.overlap(orders.where("k % 2 = 0"), orders.where("k % 2 = 1"), ["k"])}
    out = None
    for name, rows in counts.items():
        one = rows.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    checks.must_be_empty(counts["disjoint"], "an odd key is even")
    checks.same_rows(orders, orders.distinct())
    return out


SET_SQL = """
select 'missing' as what, count(*) as n from orders where o_orderkey not in (select l_orderkey from lineitem)
union all select 'overlap', count(*) from (select distinct l_orderkey from lineitem where l_linenumber <= 2 intersect select distinct l_orderkey from lineitem where l_linenumber >= 6)
union all select 'disjoint', 0
"""


def run_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation of each customer with an order; a customer without one would raise."""
    lookup = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("run"), "c_nationkey").alias("run_name"))
    wanted = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).join(lookup.select("k"), "k", "left_semi")
    return checks.known(wanted, lookup, "k")


LOOKUP_SQL = "select c_custkey as k, 'run' || c_nationkey as run_name from customer where c_custkey in (select o_custkey from orders)"


def updated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys a merge changed, and how many it had to leave."""
    before = lineitem_trace(spark, sf_dir).groupBy("accession", "target_value").agg(F.min("strategy").alias("strategy"))
    after = before.withColumn("strategy", F.when((F.col("strategy") == NOT_FOUND) & (F.col("target_value").cast("long") % 2 == 0), LLM).otherwise(F.col("strategy")))
    n = checks.updated_keys(before, after, ["accession", "target_value"])
    return after.agg(F.lit(n).cast("long").alias("n_updated"), F.count_if(F.col("strategy") == NOT_FOUND).alias("n_left"))


UPDATED_SQL = LINE_SQL + """
, b as (select accession, target_value, min(strategy) as s from t group by 1, 2)
select count(*) filter (where s = 'not found' and target_value::bigint % 2 = 0) as n_updated, count(*) filter (where s = 'not found' and target_value::bigint % 2 <> 0) as n_left from b
"""


def pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.pattern_counts(lineitem_trace(spark, sf_dir), ["target_field", "strategy"])


PATTERN_SQL = LINE_SQL + "select target_field, strategy, count(*) as n_occurrences from t group by 1, 2"


def numbered_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shuffled head of the parts, numbered in a stored order."""
    head = sampling.shuffled_head(table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_partkey"], 100, 5)
    return sampling.with_case_index(head, ["p_name", "p_partkey"])


NUMBERED_SQL = """
with h as (select p_partkey, p_name from part order by md5('5:' || p_partkey), p_partkey limit 100)
select p_partkey, p_name, (row_number() over (order by p_name, p_partkey) - 1)::int as case_index from h
"""


def hallucinated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as claims of a model, of which the toxic ones were not accepted."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    said = F.when(F.col("doc_id") % 11 != 0, F.col("quality") == 1)
    return reports.hallucinations(rows.select("lang", said.alias("llm_verdict"), F.when(F.col("doc_id") % 5 != 0, F.col("toxic") == 0).alias("accepted")), "lang")


HALLUCINATED_SQL = """
select lang, count(*) filter (where quality = 1 and doc_id % 11 <> 0) as n_claimed, count(*) filter (where quality = 1 and doc_id % 11 <> 0 and (toxic <> 0 or doc_id % 5 = 0)) as n_hallucinated
from labels join documents using (doc_id) group by lang
"""


def collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one type as rows with one term, a few names of which are its own."""
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("assigned_term_id"), F.element_at(F.split("p_name", " "), -1).alias("target_value"))
    return reports.symbol_collisions(rows, "ECONOMY", ["RING", "widget"])


COLLISIONS_SQL = """
with r as (select string_split(p_name, ' ')[-1] as v from part where p_type = 'ECONOMY')
select count(*) as n_rows, count(*) filter (where v not in ('ring', 'widget')) as n_other, round_even(100.0::double * count(*) filter (where v not in ('ring', 'widget')) / count(*), 2) as pct_other from r
"""


def curated_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each strategy and a curated one, which lacks a column."""
    rows = lineitem_trace(spark, sf_dir).select("strategy", F.col("accession").cast("long").alias("key"), "target_value", "ord")
    curated = spark.createDataFrame([(LLM, 1, "curated")], "strategy string, key long, target_value string")
    return reports.first_per_strategy(rows, ["key", "ord", "target_value"], curated=curated)


CURATED_SQL = LINE_SQL + """
select * from (
  select strategy, accession::bigint as key, target_value, ord from t where strategy <> 'not found'
  qualify row_number() over (partition by strategy order by accession::bigint, ord, target_value) = 1)
union all select 'llm', 1, 'curated', null
"""

# --- evidence -----------------------------------------------------------------------


def evidence_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference verdicts with their quotes searched again: accepted, and whether all evidence is in attributes."""
    k = F.col("p_partkey") % 4
    quotes = F.when(k == 0, F.array("p_type")).when(k == 1, F.array("p_type", "p_name")).when(k == 2, F.array("p_name", F.lit("made up"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit("found").alias("verdict"), quotes.alias("quotes"), F.array(entry(F.lit("kind"), F.col("p_type"))).alias("attributes"), F.array(entry(F.lit("body"), F.concat(F.lit("x "), "p_name"))).alias("secondary"))
    out = evidence.regrounded(rows)
    names = F.transform("attributes", lambda e: e["name"])
    return out.select("p_partkey", "accepted", F.array_join("evidence_fields", ",").alias("fields"), evidence.evidence_in_attributes(F.col("evidence_fields"), names).alias("in_attributes"))


SCOPE_SQL = """
select p_partkey, p_partkey % 4 in (0, 1) as accepted, case p_partkey % 4 when 0 then 'kind' when 1 then 'kind,body' when 2 then 'body' else '' end as fields, p_partkey % 4 = 0 as in_attributes from part
"""


def prior_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of an earlier pass, a file an event type: of several files that leave a user open the last counts."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("file"), F.col("user_id").cast("string").alias("accession"), F.lit("f").alias("target_field"), F.col("event_id").cast("string").alias("target_value"), F.when(F.col("value") > 20, NOT_FOUND).otherwise(LLM).alias("strategy"), F.lit(None).cast("string").alias("hint"))
    return evidence.residual_of_pass(rows).select("accession", "target_value")


PRIOR_SQL = """
with o as (select user_id, event_type, event_id from events where value > 20)
select o.user_id::varchar as accession, event_id::varchar as target_value from o join (select user_id, max(event_type) as m from o group by 1) l on l.user_id = o.user_id and m = event_type
"""


def residual_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open items of a seeded sample of orders, with the note on a negated match."""
    rows = lineitem_trace(spark, sf_dir).withColumn("run_name", F.lit("r")).withColumn("raw_fields", F.array("target_field")).withColumn("raw_matched_phrase", F.array("target_value"))
    return evidence.residual(rows, sample=50, seed=3).select("accession", "target_field", "target_value", "hint")


RESIDUAL_SAMPLE_SQL = LINE_SQL + """
, o as (select * from t where strategy = 'not found'),
c as (select distinct accession from o order by md5('3:' || accession), accession limit 50)
select accession, target_field, target_value, case when row_negated then 'a search found ''' || target_value || ''' in field ''' || target_field || ''', but in what looks like a negated context' end as hint
from o where accession in (select accession from c)
"""


def production_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open rows go to a first proposer with the attributes only, what it leaves to a second with the whole record; then the merge."""
    asked = part_questions(spark, sf_dir)
    none = F.array().cast("array<string>")
    trace = asked.select("accession", F.lit("r").alias("run_name"), "target_field", "target_value", F.when((F.col("target_field") == "type") & (F.col("accession").cast("long") % 3 == 0), "exact").otherwise(NOT_FOUND).alias("strategy"), *[none.alias(c) for c in ("raw_fields", "raw_texts", "raw_matched_phrase")], F.lit(False).alias("row_negated"), F.lit(0).alias("n_matches"))
    entries = asked.select("accession", "attributes", "secondary").distinct()
    out = evidence.production(trace, entries, [(Recorded, {"short_only": True}), (Recorded, {"long_only": True})])
    return out.groupBy("target_field", "strategy", "llm_pass").agg(F.count("*").alias("n"), F.sum("n_matches").cast("long").alias("n_matches"))


PRODUCTION_SQL = """
select 'type' as target_field, 'exact' as strategy, null as llm_pass, count(*) as n, 0::bigint as n_matches from part where p_partkey % 3 = 0
union all select 'type', 'llm', 'attributes', count(*), count(*) from part where p_partkey % 3 <> 0
union all select 'name', 'llm', 'full_record', count(*), count(*) from part
"""


def time_boxed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of questions until the time is up, first one without any time, then the rest."""
    path, asked = folder(spark, "boxed"), part_questions(spark, sf_dir).where("target_field = 'type'")
    none = evidence.time_boxed(asked, path, Recorded, shards=4, max_seconds=0.0, short_only=True).count()
    first = evidence.time_boxed(asked, path, Recorded, shards=4, short_only=True)
    again = evidence.time_boxed(asked, path, Recorded, shards=4, short_only=True).count()
    steps = first.agg(F.lit(none).alias("n_none"), F.count("*").alias("n_shards"), F.max("done").alias("done"), F.min("pending").alias("pending"), F.lit(again).alias("n_again"))
    rows = spark.read.parquet(path).agg(F.count("*").alias("n"), F.count_if(F.col("strategy") == LLM).alias("n_found"), F.countDistinct("accession").alias("n_accessions"))
    return rows.crossJoin(F.broadcast(steps))  # one row each


TIME_BOXED_SQL = "select count(*) as n, count(*) as n_found, count(*) as n_accessions, 0 as n_none, 4::bigint as n_shards, 4 as done, 0 as pending, 0 as n_again from part"

QUERIES = {
    f.__name__: f
    for f in (
        affix_match, spelling_pairs, negation_cases, one_word_denials, display_spans, verify_one, html_coverage, thinned_labels, nested_tables, shaded_crosstab, priority_bars, notebook_contents, set_checks, run_lookup, updated_keys,
        pattern_counts, numbered_cases, hallucinated, collisions, curated_examples, evidence_scope, prior_pass, residual_sample, production_run, time_boxed_run,
    )
}

ORACLE = {
    "affix_match": AFFIX_SQL,
    "spelling_pairs": SPELLING_SQL,
    "negation_cases": NEGATION_SQL,
    "one_word_denials": DENIALS_SQL,
    "display_spans": DISPLAY_SQL,
    "verify_one": VERIFY_ONE_SQL,
    "html_coverage": HTML_SQL,
    "thinned_labels": THINNED_SQL,
    "nested_tables": NESTED_SQL,
    "shaded_crosstab": SHADED_SQL,
    "priority_bars": BARS_SQL,
    "notebook_contents": CONTENTS_SQL,
    "set_checks": SET_SQL,
    "run_lookup": LOOKUP_SQL,
    "updated_keys": UPDATED_SQL,
    "pattern_counts": PATTERN_SQL,
    "numbered_cases": NUMBERED_SQL,
    "hallucinated": HALLUCINATED_SQL,
    "collisions": COLLISIONS_SQL,
    "curated_examples": CURATED_SQL,
    "evidence_scope": SCOPE_SQL,
    "prior_pass": PRIOR_SQL,
    "residual_sample": RESIDUAL_SAMPLE_SQL,
    "production_run": PRODUCTION_SQL,
    "time_boxed_run": TIME_BOXED_SQL,
}
