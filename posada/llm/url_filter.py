"""URL filters: rules for hosts and paths, and a logistic regression for what no rule decides.

A rule (host, path, verdict) fits a URL whose host is the rule's or a subdomain of it and whose path starts with the
rule's; of several the longest (host and path together, then the host, then the path in order) wins. The URLs that no
rule fits are judged by a logistic regression on hashed character n-grams (``GRAMS`` bytes) of host and path, whose ends are marked. It
is trained from a small table of labelled URLs, on at most ``LABELLED_ROWS`` of them; every URL is scored.

Without a table of its own the query uses ``labelled_urls``: names of unwanted trades, of ordinary sites and drawn names without meaning,
each as hosts and paths of several forms, made by rule.

Up to ``INLINE_RULES`` rules are an expression, and nothing is shuffled; more are joined by the suffixes of the distinct hosts,
the rules of a frequent host being repeated for the parts that its URLs are dealt into.

Defined cases: a null URL, or one without ``://``, has an empty host and path, which no rule with a host fits; the model scores it by its intercept;
an empty URL table gives an empty result; without labelled URLs (or with one label only) all that no rule decides is allowed, with score null; labelled rows
without URL or label teach nothing, repeated ones count each time; repeated pages are judged one by one; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posada.llm import text as tk
from posada.llm.shared import freeing, hashed_sample, ship, spread_join

Rule = tuple[str, str, str]
#: host, path, verdict
RULES: tuple[Rule, ...] = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
INLINE_RULES = 200
GRAMS = (3, 4, 5)
BUCKETS = 1 << 18
LABELLED_ROWS = 20_000  # labelled URLs that the fit reads at most
STEPS, RATE, L2 = 300, 0.5, 1e-5
HOST_MARK, PATH_MARK = "\x01", "\x02"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _first(rules: list[Rule]) -> list[Rule]:
    """Rules in the order in which they win."""
    return sorted(set(rules), key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0]), r))


def _ruled_inline(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    known = F.array(*(F.struct(F.lit(h).alias("h"), F.lit("." + h).alias("sub"), F.lit(p).alias("p"), F.lit(v).alias("v")) for h, p, v in _first(rules)))
    fits = F.filter(known, lambda r: ((F.col("host") == r["h"]) | F.endswith(F.col("host"), r["sub"])) & F.startswith(F.col("path"), r["p"]))
    won = F.get(fits, F.lit(0))
    return urls.withColumn("won", won).select(*urls.columns, F.concat("won.h", "won.p").alias("rule"), F.col("won.v").alias("ruled"))


def _ruled_joined(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """The same for any number of rules: each distinct host once meets the rules of its suffixes, each URL the rules of its host."""
    spark = urls.sparkSession
    known = spark.createDataFrame([(h, p, v, k) for k, (h, p, v) in enumerate(_first(rules))], "h string, p string, v string, k long")
    hosts = urls.groupBy("host").agg(F.count("*").alias("n"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    met = hosts.select("host", F.explode(suffixes).alias("h")).join(known, "h").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("k", "h", "p", "v"))).alias("known"))
    joined = spread_join(urls, met, "host", hosts, F.struct("path"), "left")
    won = F.get(F.filter("known", lambda r: F.startswith(F.col("path"), r["p"])), F.lit(0))
    return joined.withColumn("won", won).select(*urls.columns, F.concat("won.h", "won.p").alias("rule"), F.col("won.v").alias("ruled"))


def by_rules(urls: DataFrame, rules: list[Rule], inline: int = INLINE_RULES) -> DataFrame:
    """``urls`` (..., host, path) with ``rule`` and ``ruled``, its verdict; null where no rule fits."""
    if not rules:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("ruled"))
    return _ruled_inline(urls, rules) if len(rules) <= inline else _ruled_joined(urls, rules)


#: Words of unwanted trades, of ordinary sites, and forms that hosts and paths take.
UNWANTED = "pills viagra pharmacy casino poker roulette slots bets betting jackpot loans payday credit porn xxx adult sex cam dating escort replica watches spam farm clickbait warez torrent crack keygen cheap discount free bonus winner crypto forex diet".split()
ORDINARY = "news blog docs wiki university library museum science school research travel recipes garden music sports weather history art books city council health forum photo code data maps radio journal theatre shop".split()
SUBDOMAINS = ("", "www.", "m.", "blog.")
ENDINGS = (".com", ".net", ".org", ".info", ".io")
PATHS = ("/", "/en/{n}", "/fr/{n}.html", "/de/{n}/", "/es/{n}", "/{w}/{n}", "/{w}.html", "")


def labelled_urls(spark: SparkSession, sites: int = 4_000) -> DataFrame:
    """(url, blocked): ``sites`` unwanted sites and twice as many others, in forms drawn by row number."""

    def pick(values: tuple | list, salt: int) -> Column:
        return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(values))) + 1).cast("int"))

    def letters(salt: int) -> Column:
        size = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(7)).cast("int") + 4
        drawn = F.transform(F.sequence(F.lit(1), size), lambda k: F.substring(F.lit("etaoinshrdlucmfwypvbgk"), (F.pmod(F.xxhash64("id", k, F.lit(salt)), F.lit(22)) + 1).cast("int"), F.lit(1)))
        return F.array_join(drawn, "")

    rows = spark.range(3 * sites)
    kind = F.col("id") % 3
    bad = F.when(F.col("id") % 2 == 0, F.concat(pick(UNWANTED, 1), F.lit("-"), pick(UNWANTED, 2))).otherwise(F.concat(pick(UNWANTED, 1), pick(["", "-", "4u", "online-"], 3), F.when(F.col("id") % 4 == 1, pick(UNWANTED, 2)).otherwise(letters(4))))
    good = F.when(kind == 1, F.concat(pick(ORDINARY, 1), pick(["", "-", "of", "the"], 3), F.when(F.col("id") % 2 == 0, pick(ORDINARY, 2)).otherwise(letters(4)))).otherwise(F.concat(letters(5), pick(["", ".", "."], 6), letters(7)))
    word = F.when(kind == 0, pick(UNWANTED, 8)).when(kind == 1, pick(ORDINARY, 8)).otherwise(letters(8))
    tail = F.replace(F.replace(pick(PATHS, 9), F.lit("{n}"), F.pmod(F.xxhash64("id", F.lit(10)), F.lit(1000)).cast("string")), F.lit("{w}"), word)
    return rows.select(F.concat(F.lit("http://"), pick(SUBDOMAINS, 11), F.when(kind == 0, bad).otherwise(good), pick(["", ".example"], 12), pick(ENDINGS, 13), tail).alias("url"), (kind == 0).cast("int").alias("blocked"))


def features(block: tk.Block) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of bytes within a text; repeats are not removed here."""
    eights, rows, values = block.eights(), [], []
    row = np.repeat(np.arange(block.rows), np.diff(block.offsets))
    for width in GRAMS:
        n = len(block.data) - width + 1
        if n > 0:
            same = np.flatnonzero(row[:n] == row[width - 1 :])
            rows.append(row[same])
            values.append(block.head_hash(eights[same], width))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), (np.concatenate(values) & np.uint64(BUCKETS - 1)).astype(np.int64)


def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(index, weight) by full-batch steps with rates by coordinate, either label weighing half; the intercept is at index BUCKETS."""
    texts, labels = [], []
    for batch in batches:
        texts += batch.column("shown").to_pylist()
        labels += batch.column("blocked").to_pylist()
    order = sorted(range(len(texts)), key=lambda k: (texts[k], labels[k]))
    y = np.array([labels[k] for k in order], np.float64)
    if not 0 < y.sum() < len(y):
        return
    rows, at, first = [], [], 0
    for block in tk.blocks(pa.array([texts[k] for k in order])):
        index, offsets = tk.sorted_sets(*features(block), block.rows)
        rows.append(np.repeat(np.arange(block.rows), np.diff(offsets)) + first)
        at.append(index)
        first += block.rows
    rows, at = np.concatenate(rows), np.concatenate(at)
    used, at = np.unique(at, return_inverse=True)
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, b, seen, seen_b = np.zeros(len(used)), 0.0, np.full(len(used), 1e-10), 1e-10
    for _ in range(STEPS):
        z = np.bincount(rows, weights=w[at], minlength=len(y)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) * share
        g = np.bincount(at, weights=error[rows], minlength=len(used)) + L2 * w
        seen += g * g
        w -= RATE * g / np.sqrt(seen)
        seen_b += error.sum() ** 2
        b -= RATE * error.sum() / np.sqrt(seen_b)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, BUCKETS)), pa.array(np.append(w, b))], ["index", "weight"])


def shown(host: Column, path: Column) -> Column:
    """What the model reads of a URL."""
    return F.concat(F.lit(HOST_MARK), host, F.lit(PATH_MARK), path)


def fit(labelled: DataFrame, rows: int = LABELLED_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Indices and weights, at most BUCKETS + 1 of them, learned from (url, blocked) in one task over the bounded sample."""
    ship(labelled.sparkSession)
    known = labelled.where("url IS NOT NULL AND blocked IS NOT NULL").select(shown(host(F.col("url")), path(F.col("url"))).alias("shown"), F.col("blocked").cast("int").alias("blocked"))
    found = hashed_sample(known, rows, ["shown", "blocked"]).repartition(1).mapInArrow(freeing(train), "index long, weight double").collect()
    return np.array([r["index"] for r in found], np.int64), np.array([r["weight"] for r in found])


def judge(pages: DataFrame, labelled: DataFrame, rules: list[Rule] | tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) and the model's score, which is null where a rule decides."""
    spark = pages.sparkSession
    ship(spark)
    model = fit(labelled)
    urls = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    ruled = by_rules(urls, list(rules))
    if not len(model[0]):
        return ruled.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    packed = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BUCKETS + 1)
        table[packed.value[0]] = packed.value[1]
        for batch in batches:
            asked = batch.column("shown")
            for block in tk.blocks(asked):
                own = batch.slice(block.first_row, block.rows)
                at, offsets = tk.sorted_sets(*features(block), block.rows)
                total = np.concatenate(([0.0], np.cumsum(table[at])))
                p = 1 / (1 + np.exp(-np.clip(table[BUCKETS] + total[offsets[1:]] - total[offsets[:-1]], -35, 35)))
                decided = own.column("shown").is_null().to_numpy(zero_copy_only=False)
                verdict = np.where(decided, own.column("ruled").to_numpy(zero_copy_only=False), np.where(p >= threshold, "block", "allow"))
                yield pa.RecordBatch.from_arrays(
                    [*(own.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdict, pa.string()), pa.array(p, mask=decided)],
                    ["page_id", "host", "path", "rule", "verdict", "score"],
                )

    asked = ruled.withColumn("shown", F.when(F.col("ruled").isNull(), shown(F.col("host"), F.col("path"))))
    return asked.mapInArrow(freeing(run), f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string, score double")
