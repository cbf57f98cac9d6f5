from pyspark.sql import functions as F

import corpus_pipeline
from posada.llm import queries, shared

DATA = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, before, DATA)
        assert docs.columns == columns, name
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()} and ids, name
        before = spark.createDataFrame(docs.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, before, DATA).collect()
    assert {r.doc_id for r in packed} == ids


def test_one_of_each_group_stays(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(3, base, "en", "a", 1), (2, base + " end", "en", "a", 1), (9, base, "en", "a", 1), (4, "", "en", "a", 0), (5, None, "en", "a", 0), (6, "other text here", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, docs, DATA).collect()) == [2, 4, 5, 6]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_repeated_lines(spark, docs, DATA).collect()) == [2, 4, 5, 6]


def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns under names that stages use."""
    base = " ".join(f"word{k}" for k in range(70))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, base, "en", "a", 1), (None, None, "en", "a", 1), (3, base, "en", "b", 1), (3, base, "en", "b", 1), (4, base + " more", "de", "b", 1), (5, " \n ", "de", "b", 1)]
    rows += [(6, " ".join(f"w{k % 5000}x{k}" for k in range(40_000)), "en", "c", 9), (7, "one line\nanother line\none line", "fr", "c", 9), (8, "x", "fr", "c", 9), (8, "y", "fr", "c", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ("__id", "__copies", "__k", "__gone", "own", "copies", "gone", "r", "t", "k", "count", "component_id", "toxic", "Text2")
    return docs.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))


def test_stages_take_awkward_and_empty_tables(spark):
    docs = awkward(spark)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, DATA)
        assert made.columns == docs.columns
        kept[name] = sorted(str(r.doc_id) for r in made.collect())
        assert stage(spark, docs.where("false"), DATA).collect() == []
    every = sorted(str(r.doc_id) for r in docs.collect())
    assert kept["toxicity"] == every
    # 4 and the repeats of 3 fall to 3; rows without an id stay unless all their lines are repeats
    assert kept["line_dedup"] == sorted(["1", "2", "3", "3", "5", "6", "7", "8", "8", "None"])
    assert kept["ngram_jaccard_join"] == sorted(["1", "2", "3", "5", "6", "7", "8", "8", "None", "None"])
    assert set(kept["source_mixing"]) == set(every)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert sorted({str(r.doc_id) for r in packed}) == sorted(set(every)) and corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), DATA).collect() == []


def test_run_leaves_no_earlier_scratch_and_runs_stand_alone(spark):
    before = set(shared._folders)
    first, second = corpus_pipeline.run(spark, DATA), corpus_pipeline.run(spark, DATA)
    left = [f.rsplit("/", 1)[1].split("-")[0] for f in shared._folders if f not in before]
    assert sorted(left) == ["packing", "packing", "pipeline", "pipeline"]
    key = lambda df: sorted(map(tuple, df.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert key(second) == key(first) != []


def test_texts_under_one_id_are_documents_of_their_own(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(1, a), (2, a), (2, b), (3, b), (4, "c " * 9), (4, "c " * 9), (5, ""), (5, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(tuple, corpus_pipeline.keep_one_of_each_group(spark, docs, DATA).select("doc_id", "text").collect()), key=repr) == sorted([(1, a), (2, b), (4, "c " * 9), (5, ""), (5, None)], key=repr)
