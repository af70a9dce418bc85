"""Single rules that a query over the test tables cannot show."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evidentia import scratch
from evidentia.functions import kernels as K
from evidentia.functions import text as T
from evidentia.operators import cascade, evidence, reports, shred
from evidentia.plans import queries
from evidentia.schema import NOT_FOUND
from evidentia.sources import records

KIND = "array<struct<name:string,content:string>>"
ITEMS = f"accession string, item_ord int, target_field string, target_value string, hint string, attributes {KIND}, secondary {KIND}"


class Counted(queries.Recorded):
    """Notes every prompt in a folder."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, prompts):
        import uuid

        for p in prompts:
            (Path(self.folder) / uuid.uuid4().hex).write_text(p)
        return super().__call__(prompts)


def test_each_prompt_is_asked_once(spark, tmp_path):
    rows = [(f"A{i}", 1, "kind", "blue" if i % 2 else "hidden", None, [("c", "blue")], [("b", "hidden")]) for i in range(40)]
    folder = str(tmp_path)
    out = evidence.two_passes(spark.createDataFrame(rows, ITEMS), lambda: Counted(folder))
    assert out.count() == 40 and out.count() == 40
    assert {(r["llm_pass"], r["strategy"]) for r in out.collect()} == {("attributes", "llm"), ("full_record", "llm")}
    asked = [p.read_text() for p in tmp_path.iterdir()]
    assert len(asked) == 40 + 20


def test_malformed_lines_raise_and_accessions_are_strings(spark, tmp_path):
    lines = ['{"accession": 7, "Ids": {"accession": "Z"}}', '{"accession": "A", "x": 1}', '{"accession": null}', '{"x": {"accession": "B"}}', '{"accession": ["C"]}', '{"accession": "q\\"u"}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    got = records.read_records(spark, str(tmp_path / "a.jsonl")).orderBy("rec_ord").collect()
    assert [r["accession"] for r in got] == [None, "A", None, None, None, 'q"u']
    (tmp_path / "b.jsonl").write_text("{bad json\n" + lines[1])
    with pytest.raises(Exception, match="MALFORMED|bad json"):
        records.read_records(spark, str(tmp_path / "b.jsonl")).collect()


def test_model_results_need_their_metadata(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"v": 1}\n')
    with pytest.raises(Exception, match="no metadata beside"):
        records.read_model_results(spark, str(tmp_path), "v int").collect()


def test_short_phrases_are_candidates(spark):
    docs = spark.createDataFrame([(1, "an alpha beta here"), (2, "gamma"), (3, "Alpha, beta gamma"), (4, ""), (5, None)], "doc_id int, text string")
    values = spark.createDataFrame([(1, 0, "alpha beta"), (2, 0, "GAMMA"), (3, 0, "alpha beta gamma delta"), (4, 0, "--")], "item_id int, part int, phrase string")
    got = {(r["doc_id"], r["item_id"]) for r in queries.phrase_candidates(docs, values).collect()}
    assert got == {(1, 1), (3, 1), (2, 2), (3, 2), (3, 3)}


def test_prompt_shows_every_attribute(spark):
    raw = json.dumps({"accession": "A", "Attributes": {"Attribute": [{"attribute_name": "cell", "content": "cell"}, {"attribute_name": "age", "content": ""}, {"content": "c"}, {"attribute_name": "sex", "content": "f"}]}, "Description": {"Title": "T", "Other": "o"}})
    rows = records.with_entries(spark.createDataFrame([(raw,)], "raw string"))
    got = rows.select(shred.attribute_lines(F.col("attributes")).alias("a"), shred.record_lines(F.col("attributes"), F.col("secondary")).alias("r")).first()
    assert got["a"].split("\n") == ["cell: cell", "age: ", ": c", "sex: f"]
    assert got["r"].split("\n")[4:] == ["accession: A", "Description.Other: o"]


def test_no_stages_change_nothing(spark):
    trace = spark.createDataFrame([("A", "f", "v", NOT_FOUND)], "accession string, target_field string, target_value string, strategy string")
    assert [tuple(r) for r in evidence.merge_stages(trace, []).collect()] == [("A", "f", "v", NOT_FOUND, None)]


def test_percent_rounds_half_to_even(spark):
    got = spark.range(1).select(T.percent(F.lit(1), F.lit(32)).alias("a"), T.percent(F.lit(3), F.lit(32)).alias("b"), T.percent(F.lit(1), F.lit(0)).alias("c")).first()
    assert tuple(got) == (3.12, 9.38, None)


def test_edit_distance_band():
    import random

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
        return row[-1]

    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        for most in (1, 2, 3):
            assert K.near(a, b, most) == (table(a, b) <= most), (a, b, most)


def test_curve_over_many_ranges(spark):
    values = [f"v{i % 37}" for i in range(500)] + [f"v{i}" for i in range(90)]
    got = [tuple(r) for r in reports.concentration_curve(spark.createDataFrame([(v,) for v in values] + [(None,)], "v string"), "v").orderBy("n_fields").collect()]
    counts = sorted(((values.count(v), v) for v in set(values)), key=lambda x: (-x[0], x[1]))
    upto = 0
    for k, ((n, v), row) in enumerate(zip(counts, got, strict=True)):
        upto += n
        assert row == (v, n, k + 1, round(100 * upto / len(values), 4))


def test_repeated_batch_appends_nothing_twice(spark, tmp_path):
    from evidentia.streaming.incremental import append_new

    target = str(tmp_path / "t")
    rows = lambda *ids: spark.createDataFrame([(i, f"x{i}") for i in ids], "id int, v string")
    run = append_new(target, ["id"], buckets=4)
    run(rows(1, 2, 2, 3), 0)
    run(rows(3, 4), 1)
    run(rows(3, 4), 1)
    run(rows(1, 2, 2, 3), 0)
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [1, 2, 3, 4]


def test_items_without_words_and_nulls(spark):
    rows = spark.createDataFrame([(1, "", [("a", None)], [(None, "x")]), (2, "x", None, [(None, "x")]), (3, None, [], [])], f"i int, target_value string, attributes {KIND}, secondary {KIND}")
    got = {r["i"]: r["found"] for r in cascade.search_text(rows).collect()}
    assert got[1] is None and got[3] is None and got[2]["strategy"] == "exact"


def test_scratch_refuses_a_machine_local_folder():
    from types import SimpleNamespace as Of

    nowhere = Of(isDefined=lambda: False)
    Session = Of(sparkContext=Of(master="spark://host:7077", _jsc=Of(sc=lambda: Of(getCheckpointDir=lambda: nowhere))), conf=Of(get=lambda key, default=None: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch(Session)


def test_the_rest_works_without_the_training_data_part(tmp_path):
    """Without the llm folders, with and without corpus_pipeline.py, the entry module gives the other queries."""
    top = Path(__file__).resolve().parent.parent
    shutil.copytree(top, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", "*.json", "*.txt"))
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert 'trace_exact_ci' in q and not [n for n in q if n.startswith('op') or n == 'pipeline'] and set(o) <= set(q); print(len(q))"
    for _ in range(2):
        said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
        assert said.returncode == 0, said.stderr
        (tmp_path / "copy" / "corpus_pipeline.py").unlink(missing_ok=True)
