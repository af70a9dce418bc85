"""Documented cases of the cascade, the kernels and the evidence tier."""

import json

import pytest
from pyspark.sql import functions as F

from evidentia.functions import kernels as K
from evidentia.functions import text as T
from evidentia.operators import cascade, checks, evidence, reports, sampling, shred
from evidentia.schema import NOT_FOUND
from evidentia.sources import ontology, records


KIND = "array<struct<name:string,content:string>>"


def traced(spark, items, terms=False):
    """Trace rows of (value, attributes, secondary[, term_id, label, exact, related]) items, in one plan."""
    schema = f"i int, target_field string, target_value string, attributes {KIND}, secondary {KIND}"
    if terms:
        schema += ", term_id string, label string, exact_synonyms array<string>, related_synonyms array<string>"
    rows = [(i, "f", value, list(a), list(s), *rest) for i, (value, a, s, *rest) in enumerate(items)]
    return [r for r in sorted(cascade.verify(spark.createDataFrame(rows, schema)).collect(), key=lambda r: r["i"])]


TIERS = [
        ("in vitro", "in vitrogen media", NOT_FOUND, None),
    ("in vitro", "in vitrogen in vitro", "exact", "in vitro"),
    ("IN VITRO", "grown in vitro.", "case-insensitive", "in vitro"),
    ("Sinoatrial node cells", "Sinoatrial node (SAN) cells", "normalized", "Sinoatrial node (SAN) cells"),
    ("lung carcinoma", "lung (carcinoma) cell line", "normalized", "lung (carcinoma"),
    ("HEK293", "HEK 293", "normalized", "HEK 293"),
    ("Ptgsc", "PtgscKO mouse", "normalized", "Ptgsc"),
    ("BRD9", "shBRD9", "normalized", "BRD9"),
    ("Ptgsc", "PtgscOEHZ", NOT_FOUND, None),
    ("Kras", "KrasG12D", "normalized", "Kras"),
    ("Src inhibitor", "Inhibitor_Src", "bag of words", "Inhibitor_Src"),
    ("C/EBPβ", "EBPα C", NOT_FOUND, None),
    ("Gliobmastoma", "a Glioblastoma here", "fuzzy", "Glioblastoma"),
    ("miR-16", "miR-15", NOT_FOUND, None),
    ("anti-IL-1", "anti-PD-1", NOT_FOUND, None),
    ("DNase l", "DNase I", "fuzzy", "DNase I"),
    ("a\\Eb", "x a\\Eb y", "exact", "a\\Eb"),
    ("b", "😀 b", "exact", "b"),
    ("", "anything", NOT_FOUND, None),
    ("None", "None", "exact", "None"),
]


def test_tiers(spark):
    rows = traced(spark, [(needle, [("a", content)], []) for needle, content, _, _ in TIERS])
    for (needle, content, expected, phrase), row in zip(TIERS, rows, strict=True):
        assert (row["strategy"], row["raw_matched_phrase"]) == (expected, [] if phrase is None else [phrase]), (needle, content)
        for text, found in zip(row["raw_texts"], row["raw_matched_phrase"]):
            assert found in text


def test_order_of_tiers_and_priority(spark):
    hela = [("source_name", "HeLa"), ("cell_line", "HeLa"), ("other", "HeLa x")]
    items = [
        ("HEK293", [("cell", "HEK 293")], [("title", "HEK293")]),
        ("node cell", [("cell", "cell node")], [("title", "node cell")]),
        ("HeLa", hela, []),
        ("HeLa", hela[:1] + [("sample name", "HeLa")], []),
        ("insulin", [("t", "without insulin")], []),
        ("insulin", [("t", "without insulin"), ("u", "insulin")], []),
        ("n/a", [], []),
        (None, [("a", None)], [(None, "x")]),
    ]
    rows = traced(spark, items)
    assert [(r["strategy"], r["raw_fields"]) for r in rows[:4]] == [("normalized", ["cell"]), ("exact", ["title"]), ("exact", ["cell_line", "other"]), ("exact", ["source_name"])]
    assert (rows[4]["strategy"], rows[4]["row_negated"], rows[4]["n_matches"], rows[4]["raw_fields"]) == (NOT_FOUND, True, 1, ["t"])
    assert (rows[5]["strategy"], rows[5]["row_negated"], rows[5]["negated"]) == ("exact", False, [True, False])
    assert rows[6]["is_placeholder"] and rows[6]["strategy"] == NOT_FOUND and rows[7]["strategy"] == NOT_FOUND


def test_synonyms_are_the_last_resort(spark):
    term = ("X:1", "NO", ["nitric oxide"], ["oxide, nitric"])
    items = [
        ("zz", [("diet", "No dairy")], [], *term),
        ("zz", [("d", "with Nitric-oxide gas")], [], *term),
        ("zz", [("d", "NO donor")], [], *term),
        ("zz", [("d", "oxide nitric")], [], "X:1", "nitric oxide", [], []),
        ("zz", [("d", "betaa here"), ("e", "alpha here")], [], "X:1", "alphx", ["alpha"], ["betaa"]),
        ("donor", [("d", "a donor")], [], *term),
        ("zz", [("d", "NO donor")], [], "X:2", None, None, None),
    ]
    rows = traced(spark, items, terms=True)
    name = "ontology synonym"
    assert [r["strategy"] for r in rows] == [NOT_FOUND, name, name, name, name, "exact", NOT_FOUND]
    assert [r["raw_matched_phrase"] for r in rows[1:5]] == [["Nitric-oxide"], ["NO"], ["oxide nitric"], ["alpha"]]
    assert rows[1]["assigned_term_synonyms"] == "nitric oxide; oxide, nitric" and rows[6]["assigned_term_id"] == "X:2"


@pytest.mark.parametrize(
    "text, word, expected",
    [
        ("Cre negative; Ccm3/flox", "Cre", True),
        ("no evidence of lymphoma", "lymphoma", True),
        ("cells (Thermo Fisher, cat. no PHG0023), 10ng/ml human FGF-basic", "FGF-basic", False),
        ("gram negative bacteria", "bacteria", False),
        ("not treated but infected", "infected", False),
        ("No drug. Treated with insulin", "insulin", False),
        ("feeder free BGO3", "BGO3", False),
        ("BGO3 (feeder free)", "BGO3", False),
        ("non-small cell lung cancer", "lung cancer", False),
        ("without insulin", "insulin", True),
    ],
)
def test_negation(text, word, expected):
    at = text.index(word)
    assert K.negated(text, at, at + len(word)) is expected


def test_normalisation_keeps_places():
    for text in ("A (b [c) d] e", "x)y (open", "-- a__b --", "İstanbul (x) y", ""):
        for form in ((False, False), (True, False), (False, True)):
            out, places = K.normalized(text, *form)
            assert len(out) == len(places) and places == sorted(places)
    assert K.normalized("Sinoatrial node (SAN) cells", False, False)[0] == "sinoatrial node cells"
    assert K.normalized("a (b", False, False)[0] == "a"
    assert K.normalized("a) b", False, False)[0] == "a) b"


def test_text_without_places_is_that_of_the_normalised_one():
    for text in ("-- a__b --", "İSTANBUL ΣΑΣ\x0b x", "a\t\r\nB", " - ", ""):
        for join in (False, True):
            assert K._unbracketed(text, join) == K.normalized(text, join, False)[0]


def test_normalisation_of_plain_texts_stops_at_the_screen(monkeypatch):
    calls = []
    monkeypatch.setattr(K, "normalized", lambda *a, f=K.normalized: calls.append(a) or f(*a))
    K._wanted.cache_clear()
    assert K.normalized_span("blue_ring", "Brand#7") is K.normalized_span("blue_ring", "Brand#8") is None
    assert {a[0] for a in calls} == {"blue_ring"} and len(calls) == 3  # the value once a form, the texts never
    assert K.normalized_span("blue_ring", "a blue-ring") == (2, 11)


def test_words_are_rearranged_only_if_all_are_there(monkeypatch):
    assert K.rearranged_span("Src inhibitor", "an Inhibitor_Src") == (3, 16) and K.rearranged_span("a a", "b a A") == (2, 5)
    monkeypatch.setattr(K, "_window", None)
    assert K.rearranged_span("Src inhibitor", "Src of many other words") is None


def test_entries_of_a_record():
    raw = json.dumps({"accession": "A", "BioSample": {"Description": {"Title": "T", "Comment": {"Paragraph": ["p", "q"]}}, "Ids": {"Id": {"content": "x", "db": None}}, "Attributes": {"Attribute": [{"attribute_name": "n", "content": None}, {"attribute_name": "m"}, {"content": "c"}]}, "flag": True, "e": ""}})
    first, rest = K.entries(raw)
    assert [(e["name"], e["content"]) for e in first] == [("n", "None"), ("n", "n"), ("m", ""), ("m", "m"), (None, "c")]
    assert [(e["name"], e["content"]) for e in rest] == [("title", "T"), ("comment", "p"), ("comment", "q"), ("Ids.Id", "x"), ("flag", "True")]
    assert K.flat_text({"a": {"b": 1, "c": None, "d": ""}, "e": [2, {"f": 3}]}) == "a.b: 1; a.d: ; e: 2; e.f: 3"


def test_value_explode(spark):
    rows = spark.createDataFrame([(1, {"a": "x", "b": '["y", null, "", "z"]', "c": None, "d": "", "e": "[null]", "f": "[]"}), (2, None)], "id int, extracted map<string,string>")
    got = [(r["id"], r["target_field"], r["target_value"]) for r in cascade.explode_values(rows).collect()]
    assert sorted(got) == [(1, "a", "x"), (1, "b", "y"), (1, "b", "z")]


def test_values_are_counted_inside_their_row(spark):
    data = [(1, {"a": "x", "b": '["y", null, "", "y", "[", 2]'}), (2, {"b": '["y", "y"]', "c": None}), (2, {"b": '["y"]', "a": "y"}), (None, {"b": "y"}), (None, {"b": "y"}), (3, None), (4, {"b": "[]"})]
    rows = spark.createDataFrame(data, "id int, extracted map<string,string>").repartition(3)
    exploded = cascade.explode_values(rows).groupBy("id", "target_field", "target_value").agg(F.count("*").alias("n"))
    got = cascade.count_values(rows, "id")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, exploded.collect()))
    assert sum(r["n"] for r in got.collect()) == 4 + 1 + 4 + 2
    single = cascade.count_values(rows.where("id = 1"), "id")
    single.collect()
    assert "Generate posexplode" not in single._jdf.queryExecution().executedPlan().toString()


def test_term_is_looked_up_by_value(spark):
    df = spark.createDataFrame([({"f": [("b", "T:2"), ("a", "T:1"), ("a", "T:9")]}, "f", "a")], "r map<string,array<struct<value:string,term_id:string>>>, f string, v string")
    assert df.select(cascade.term_of_value(F.col("r"), F.col("f"), F.col("v"))).first()[0] == "T:1"


def test_readers_and_trace(spark, tmp_path):
    lines = [{"accession": "A1", "Attributes": {"Attribute": {"attribute_name": "cell", "content": "HeLa"}}}, {"accession": "A2", "BioSample": {"Attributes": {"Attribute": [{"attribute_name": "g", "content": "Trp53"}]}}}, {"accession": "A1", "x": "second"}, {"accession": 7}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    (tmp_path / "r.json").write_text(json.dumps({"entries": [{"extract": {"accession": "A1", "extracted": {"line": "old"}}, "results": {}}, {"extract": {"accession": "A1", "extracted": {"line": ["HeLa", None]}}, "results": {"line": [{"value": "HeLa", "term_id": "C:1"}]}}, {"extract": {"accession": "A2", "extracted": None}, "results": None}]}))
    got = records.read_records(spark, str(tmp_path / "in"), recursive=True)
    assert [r["accession"] for r in got.orderBy("rec_ord").collect()] == ["A1", "A2", "A1", None]
    assert json.loads(records.find_record(got, "A1").first()["raw"]) == lines[0]
    assert {r[0] for r in records.scan_accessions(got).collect()} == {"A1", "A2"}
    wanted = spark.createDataFrame([("A1",), ("A2",), ("A3",)], "accession string")
    assert records.find_records(got, wanted).count() == 2
    assert [r[0] for r in checks.missing(wanted, got, ["accession"]).collect()] == ["A3"]
    results = records.read_results(spark, str(tmp_path / "r.json"))
    rows = cascade.trace(records.with_entries(records.find_records(got, wanted)), results).collect()
    assert [(r["target_field"], r["target_value"], r["strategy"], r["raw_fields"], r["assigned_term_id"]) for r in rows] == [("line", "HeLa", "exact", ["cell"], "C:1")]


def test_ontology_lines(spark, tmp_path):
    text = """<rdfs:label>before</rdfs:label>
<owl:Class rdf:about="http://x/obo/CL_1"><rdfs:label>same line</rdfs:label>
<rdfs:label>first</rdfs:label>
<rdfs:label>last</rdfs:label>
<oboInOwl:hasExactSynonym>e1</oboInOwl:hasExactSynonym>
<oboInOwl:hasRelatedSynonym>r1</oboInOwl:hasRelatedSynonym>
<oboInOwl:hasExactSynonym>e2</oboInOwl:hasExactSynonym>
<owl:Class rdf:about="http://x/obo/CL_2">
<owl:Class rdf:about="http://x/obo/CL_1">
<rdfs:label>again</rdfs:label>
"""
    (tmp_path / "o.owl").write_text(text)
    got = {r["term_id"]: r for r in ontology.terms(ontology.read_lines(spark, str(tmp_path / "o.owl"))).collect()}
    assert {k: (r["label"], r["exact_synonyms"], r["related_synonyms"]) for k, r in got.items()} == {"CL:1": ("again", [], []), "CL:2": (None, [], [])}
    (tmp_path / "p.owl").write_text("\n".join(text.split("\n")[:7]))
    one = ontology.terms(ontology.read_lines(spark, str(tmp_path / "p.owl")))
    r = one.first()
    assert (r["label"], r["exact_synonyms"], r["related_synonyms"]) == ("last", ["e1", "e2"], ["r1"])
    config = spark.createDataFrame([("cell", "dir/p.owl"), ("other", None)], "field string, ontology_file string")
    assert [r["field"] for r in ontology.field_terms(config, one).collect()] == ["cell"]


@pytest.mark.parametrize(
    "answer, expected",
    [
        ('```json\n{"verdicts": [{"item_index": 1, "found": true, "quotes": ["a", 3],},]}\n``` more', [(1, True, ["a"])]),
        ('{"verdicts": [{"item_index": 1, "found": true}, {"item_index": 1, "found": false}]} trailing {', [(1, False, [])]),
        ('{"verdicts": [{"item_index": true, "found": false}, {"item_index": "2", "found": true}, {"item_index": 3}]}', [(1, False, [])]),
        ("[1]", None),
        ("no json", None),
        (None, None),
    ],
)
def test_answers(answer, expected):
    got = K.verdicts(answer)
    assert got == expected if expected is None else [(v["item_index"], v["found"], v["quotes"]) for v in got] == expected


def test_grounding(spark):
    cases = [(True, ["HeLa", "LONG text"]), (True, ["HeLa", "made up"]), (True, []), (True, None), (True, ["long text"]), (True, ["a title"]), (None, ["HeLa"]), (False, ["HeLa"])]
    rows = [(str(i), found, quotes, None, [("n", "HeLa cells")], [("title", "a title"), ("body", "long text")]) for i, (found, quotes) in enumerate(cases)]
    df = spark.createDataFrame(rows, f"accession string, found boolean, quotes array<string>, explanation string, attributes {KIND}, secondary {KIND}")
    full, short = ([r for r in sorted(evidence.judged(df, whole).collect(), key=lambda r: r["accession"])] for whole in (True, False))
    assert [r["strategy"] for r in full] == ["llm", NOT_FOUND, NOT_FOUND, NOT_FOUND, "llm", "llm", NOT_FOUND, NOT_FOUND]
    assert [r["strategy"] for r in short] == [NOT_FOUND, NOT_FOUND, NOT_FOUND, NOT_FOUND, NOT_FOUND, "llm", NOT_FOUND, NOT_FOUND]
    assert (full[1]["llm_verdict"], full[1]["llm_ungrounded_quotes"], full[1]["n_matches"]) == (True, ["made up"], 1)
    assert full[6]["llm_verdict"] is None and full[7]["n_matches"] == 0


class Long:
    def __call__(self, prompts):
        return ['{"verdicts": [{"item_index": 1, "found": true, "quotes": ["HeLa"]}]}' for _ in prompts]


def test_long_prompts_fail_alone(spark):
    rows = spark.createDataFrame([("a", "x" * 50), ("b", "y")], "accession string, prompt string")
    got = {r["accession"]: (r["answer"] is None, r["error"]) for r in evidence.answer(rows, Long, max_chars=10).collect()}
    assert got == {"a": (True, "prompt too long"), "b": (False, None)}


def test_stages_must_be_disjoint(spark):
    schema = "accession string, target_field string, target_value string, strategy string, raw_fields array<string>, raw_texts array<string>, raw_matched_phrase array<string>, n_matches int, llm_pass string"
    trace = spark.createDataFrame([("A", "f", "v", NOT_FOUND, [], [], [], 0, None), ("A", "f", "w", "exact", ["x"], ["x"], ["x"], 1, None)], schema)
    stage = spark.createDataFrame([("A", "f", "v", "llm", ["n"], ["t"], ["p"], 1, "attributes"), ("A", "f", "w", "llm", ["n"], ["t"], ["p"], 1, "attributes")], schema)
    got = {r["target_value"]: r["strategy"] for r in evidence.merge_stages(trace, [stage]).collect()}
    assert got == {"v": "llm", "w": "exact"}
    checks.same_rows(trace, evidence.merge_stages(trace, [stage]))
    with pytest.raises(Exception, match="resolved more than once"):
        evidence.merge_stages(trace, [stage, stage]).collect()


def test_confusable_and_budget(spark):
    pairs = [("l", "I", True), ("O", "0", True), ("ll", "II", False), ("Asbesos", "Asbestos", True), ("HIF-1a", "HIF-2a", False), ("short", "shart", False), ("abcdef1", "abcdex1", True), ("abcdef1", "abcxyf1", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    for r in df.withColumn("got", T.words_fuzzy_equal(F.col("a"), F.col("b"))).collect():
        assert r["got"] == r["want"], r


def test_shred_columns(spark):
    raw = json.dumps({"accession": "A", "Description": {"Organism": {"OrganismName": "", "taxonomy_name": "Mus"}}, "Owner": {"Name": [{"content": "", "abbreviation": "AB"}, {"content": "x"}]}, "Links": {"Link": {"target": "bioproject", "label": "P1"}}, "Attributes": {"Attribute": {"attribute_name": "n", "content": "c"}}})
    df = spark.createDataFrame([(raw,)], "raw string")
    row = shred.metadata(df).first()
    assert (row["accession"], row["bioproject_id"], row["owner"]) == ("A", "P1", "AB")
    row = shred.summary(df).first()
    assert row["organism"] == "Mus" and row["attributes"][0]["content"] == "c" and row["owner"].startswith("Name.abbreviation") is False
    first, second = shred.category(F.col("d"))
    got = spark.createDataFrame([("rnaseq_mouse_1",)], "d string").select(first, second).first()
    assert tuple(got) == ("DDBJ RNA-Seq", "Mus musculus")
    with pytest.raises(Exception, match="no category"):
        spark.createDataFrame([("zzz",)], "d string").select(first).collect()


def test_display_columns(spark):
    df = spark.createDataFrame([("a <b> Foo & c", "foo")], "t string, p string")
    s = T.phrase_span(F.col("t"), F.col("p"))
    got = df.select(s["start"], s["end"], T.bold_span(F.col("t"), s["start"], s["end"])).first()
    assert tuple(got) == (6, 9, "a &lt;b&gt; <b>Foo</b> &amp; c")


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_name string, v int")
    path = str(tmp_path / "runs")
    assert records.written_runs(spark, path).count() == 0
    records.write_runs(rows, path)
    records.write_runs(rows.where("v = 2").withColumn("v", F.lit(3)), path)
    assert sorted((r["run_name"], r["v"]) for r in spark.read.parquet(path).collect()) == [("r1", 1), ("r2", 3)]
    assert records.pending(rows, records.written_runs(spark, path), ["run_name"]).count() == 0
    table = str(tmp_path / "table")
    records.replace_table(rows, table)
    records.replace_table(rows.where("v = 1"), table)
    assert spark.read.parquet(table).count() == 1 and spark.read.parquet(table + ".bak").count() == 2
    records.write_manifest(spark, str(tmp_path / "m"), model="x", seed=3)
    assert spark.read.json(str(tmp_path / "m")).first()["seed"] == 3


def test_reports_on_empty_tables(spark):
    empty = spark.createDataFrame([], "target_field string, strategy string, n_matches int, row_negated boolean, llm_pass string")
    assert reports.coverage(empty).first()["pct_resolved"] is None
    assert reports.multi_match_share(empty).first()["pct_multi"] is None
    assert reports.reconciled_coverage(empty, ["attributes"]).first()["llm_attributes"] == 0
    assert reports.strategy_crosstab(empty).count() == 0


def test_sampling(spark):
    rows = spark.createDataFrame([(f"f{i % 7}", f"v{i % 5}", f"a{i}") for i in range(200)], "f string, v string, a string")
    one, two = (sampling.sample_patterns(rows, ["f", "v"], ["a"], 20, s).collect() for s in (1, 1))
    assert sorted(one) == sorted(two) and len({(r["f"], r["v"]) for r in one}) == 20
    with pytest.raises(ValueError):
        sampling.sample_patterns(rows, ["f", "v"], ["a"], 99, 1)


def test_rarefaction_against_enumeration(spark):
    from itertools import combinations

    data = [("g", u, v) for u, vs in enumerate(["ab", "b", "cd", "ad"]) for v in vs] + [("h", 9, "a"), ("h", 8, "b")]
    got = {r["g"]: r for r in reports.rarefied(spark.createDataFrame(data, "g string, u int, v string"), "g", "u", "v").collect()}
    units = ["ab", "b", "cd", "ad"]
    want = sum(len(set("".join(c))) for c in combinations(units, 2)) / 6
    assert got["g"]["k"] == 2 and abs(got["g"]["expected_values"] - want) < 1e-3


def test_sampled_rarefaction_by_bits(spark):
    from hashlib import md5
    from statistics import fmean, pstdev

    data = [("ghi"[u % 3], u // 2, v) for u in range(60) for v in range(u % 4 + 1, 40, u % 5 + 3)][: -20]
    data += data[:9] + [("g", None, 1), (None, 1, 1), ("h", 1, None)]
    n = 70  # more draws than bits of a long
    out = reports.rarefied_by_sampling(spark.createDataFrame(data, "g string, u int, v int"), "g", "u", "v", n_iter=n)
    units = {g: {u for x, u, v in data if x == g and None not in (u, v)} for g in "ghi"}
    k = min(map(len, units.values()))
    for r in out.collect():
        drawn = []
        for d in range(1, n + 1):
            sample = sorted(units[r["g"]], key=lambda u: int(md5(f"1:{d}:{u}".encode()).hexdigest()[:15], 16))[:k]
            drawn.append(len({v for x, u, v in data if x == r["g"] and u in sample and v is not None}))
        assert (r["n_units"], r["k"], r["n_iter"]) == (len(units[r["g"]]), k, n)
        assert abs(r["mean_values"] - fmean(drawn)) < 1e-9 and abs(r["std_values"] - pstdev(drawn)) < 1e-9
    assert out.count() == 3
    assert "min(h0" not in out._jdf.queryExecution().optimizedPlan().toString()  # no hash of each draw in the rows of a value


def test_thin_labels(spark):
    df = spark.createDataFrame([(100.0,), (97.0,), (93.0,), (50.0,)], "p double")
    assert [r["p"] for r in reports.thin_labels(df, "p").collect()] == [100.0, 93.0, 50.0]


def test_symbol_collisions_and_tallies(spark):
    rows = spark.createDataFrame([("C:1", "NO"), ("C:1", "nitric oxide"), ("C:2", "x")], "assigned_term_id string, target_value string")
    assert tuple(reports.symbol_collisions(rows, "C:1", ["Nitric oxide"]).first()) == (2, 1, 50.0)
    t = spark.createDataFrame([("f", "llm", "attributes"), ("f", "llm", "full_record"), ("f", "exact", None)], "target_field string, strategy string, llm_pass string")
    assert tuple(reports.pass_tallies(t).first()) == ("f", 1, 2)
    v = spark.createDataFrame([(True, True), (True, False), (False, False)], "llm_verdict boolean, accepted boolean")
    assert tuple(reports.hallucinations(v).first()) == (2, 1)


def test_residuals(spark):
    schema = "file string, accession string, target_field string, target_value string, strategy string, hint string"
    rows = spark.createDataFrame([("f1", "A", "x", "1", NOT_FOUND, None), ("f2", "A", "x", "2", NOT_FOUND, None), ("f2", "A", "y", "3", "llm", None), ("f1", "B", "z", "4", NOT_FOUND, "h")], schema)
    got = {(r["accession"], r["target_value"]) for r in evidence.residual_of_pass(rows).collect()}
    assert got == {("A", "2"), ("B", "4")}
