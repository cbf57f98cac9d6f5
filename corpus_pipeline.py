"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; each
result is written as Parquet and read again as the next stage's documents. All but the last
return the columns of ``documents``. A run deletes a stage's working tables as soon as its result is written; what the last stage's result reads
stays while it may be read, and no run touches another's tables.

All stages give an empty result for an empty table, keep further columns, whatever their names, and take texts whole, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posada.llm import jaccard_join, line_dedup, mixing, packing, toxicity
from posada.llm.queries import tokenizer_path
from posada.llm.ranks import ranked
from posada.llm.shared import LAST, Scratch, few, forget, made_within, row_key, spread_join, table

#: No stage has an SQL form: a trained model, MinHash bands, components, iterated rates and packing.
ORACLE_SQL = None

def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go.

    Null and empty texts score the prior and stay; rows without an id are scored like all others; repeated rows share their verdict;
    without labels nothing goes.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, exactly or nearly, go; so does a document that loses all its words with them.

    Null and empty texts stay; rows without an id, or with different texts under one id, are documents of their own; rows equal in both keep or lose
    the same lines; n_chars is left as it was.
    """
    made = line_dedup.dedup(docs)
    return made.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that the Jaccard join links, directly or through others, the one with the least doc_id stays.

    Null, empty and blank texts link with nothing and stay; so do rows without an id, which can't be named; of rows equal in id and text one stays.
    Different texts under one id are documents of their own: they go or stay by themselves, the one with the least hash of its text being the first.
    """
    named = docs.where("doc_id IS NOT NULL")
    again = few(named.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return docs.join(_others(docs), "doc_id", "left_anti").select(*docs.columns)
    scratch = Scratch(spark, "numbered")
    # the columns travel as one struct, so that no name of theirs can clash
    own = F.struct(*(F.col(c) for c in docs.columns)).alias("own")
    repeated = named.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    every = named.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(repeated)
    rows = scratch.put(every.select(F.lit("").alias("g"), "doc_id", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"), own), "rows")
    numbered = scratch.keep(ranked(rows, "g", [F.col("doc_id").asc(), F.col("h").asc(), F.col("row").asc()], scratch).select("i", "own"))
    others = _others(numbered.select(F.col("i").alias("doc_id"), F.col("own.text").alias("text")))
    left = numbered.join(others.withColumnRenamed("doc_id", "i"), "i", "left_anti").select(*(F.col("own").getField(c).alias(c) for c in docs.columns))
    return left.unionByName(docs.where("doc_id IS NULL"))


def _others(docs: DataFrame) -> DataFrame:
    """The ids of all documents that aren't the least of their component."""
    groups = jaccard_join.join(docs)
    return few(groups.where((F.col("n_shingles") > 0) & (F.col("doc_id") != F.col("component_id"))).select("doc_id").distinct())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated as often as their rate says, and dropped where that is not at all (the default targets never ask for less).

    Null and empty texts have rate 1; rows equal in id and text are repeated alike, different texts under one id, or without one, on their own.
    """
    r, t = row_key()
    mixed = mixing.mix(docs).select(F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("r"), F.col("text_key").alias("t"), "copies")
    copies = mixed.groupBy("r", "t").agg(F.max("copies").alias("copies"), F.count("*").alias("n"))
    # the columns travel as one struct, so that no name of theirs can clash
    keyed = docs.select(r.alias("r"), t.alias("t"), F.struct(*(docs[c] for c in docs.columns)).alias("own"))
    joined = spread_join(keyed, copies.drop("n"), ["r", "t"], copies.select("r", "t", "n"), F.monotonically_increasing_id(), "left")
    repeated = joined.select("own", F.explode(F.array_repeat(F.lit(1), F.coalesce("copies", F.lit(1)))).alias("k"))
    return repeated.select(*(F.col("own").getField(c).alias(c) for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place in it.

    Null and empty texts pack as the end token alone; repeated rows, and rows without an id, are packed one by one.
    """
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, one in STAGES[:-1]:
        used: list[str] = []
        with made_within(used):
            docs = scratch.put(one(spark, docs, sf_dir), name)
        forget(spark, used)
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
