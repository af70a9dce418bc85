"""The pipeline's stages on a small table, each against what its operator says."""

import hashlib
import re

import corpus_pipeline
from evidentia.llm import decontaminate, mixing, near_dedup, quality_classifier
from evidentia.llm.storage import read, store

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_stages_in_turn(spark):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "near_dedup", "decontamination", "mixing", "sharding"]
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, SF), name)
        out.append(docs)
    assert all(d.columns == columns for d in out[:-1])
    source = read(spark, SF, "documents")
    meta = quality_classifier.METADATA
    model = quality_classifier.train(source, read(spark, SF, "labels"), meta=meta)
    assert ids(out[0]) == ids(quality_classifier.score(source, model, meta=meta).where("predicted = 1"))
    assert ids(out[1]) == ids(near_dedup.near_duplicates(out[0], near_dedup.USUAL).where("kept"))
    leaks = set(ids(decontaminate.leaks(out[1], read(spark, SF, "benchmark"))))
    assert ids(out[2]) == [i for i in ids(out[1]) if i not in leaks]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(out[2]).collect()}
    assert ids(out[3]) == sorted(i for i, n in copies.items() for _ in range(n))
    last = out[4].collect()
    assert out[4].columns == [*columns, "shard"] and len(last) == out[3].count()
    where = {}
    for r in last:
        where.setdefault(hashlib.md5((r["text"] or "").encode()).hexdigest(), set()).add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    whole = corpus_pipeline.run(spark, SF)
    assert sorted((r["doc_id"], r["shard"]) for r in whole.collect()) == sorted((r["doc_id"], r["shard"]) for r in last)


def test_classifier_stage_keeps_good_and_drops_bad(spark):
    sf = "/root/testdata/sf0.01"
    docs = read(spark, sf, "documents")
    kept = set(ids(corpus_pipeline.keep_quality(spark, docs, sf)))
    labels = {r["doc_id"]: r["quality"] for r in read(spark, sf, "labels").collect()}
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) / len(good) > 0.99
    assert sum(i in kept for i in bad) / len(bad) < 0.1


def test_distinct_stage_against_brute_force(spark):
    """Similarity 0.8 or more over distinct five-word shingles, transitively."""
    docs = read(spark, SF, "documents")
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    first = {i: i for i in sets}

    def root(i):
        while first[i] != i:
            i = first[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                first[y] = x
    assert ids(corpus_pipeline.keep_distinct(spark, docs, SF)) == sorted(i for i in sets if root(i) == i)


def test_stages_with_empty_and_odd_tables(spark, empty, odd):
    """Nulls, repeated ids and rows, clashing columns: each stage keeps the columns; an empty table stays empty."""
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
        out = stage(spark, odd, SF)
        assert out.columns == [*odd.columns, *(["shard"] if name == "sharding" else [])] and out.count() >= 0, name
    assert corpus_pipeline.cut_shards(spark, odd, SF).count() == odd.count()
    assert corpus_pipeline.keep_clean(spark, odd, SF).count() == odd.count()
