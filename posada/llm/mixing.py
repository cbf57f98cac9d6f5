"""Soft-membership mixing of domains to target weights, with DataFrame and SQL functions only.

1. Classifier: a labelled table, (word, log-probability in each domain), is learned from a
   bounded sample of labelled documents (multinomial naive Bayes over the ``VOCABULARY``
   most frequent words). A document's words are looked up in it; prior plus summed
   log-probabilities, tempered by ``TEMPERATURE`` and normalised, are the posteriors
   p[d] of its domain membership. Every document gets them, labelled or not.
2. Rates: with t tokens (words) in a document, rates r >= 0 are to satisfy
   sum(r * t * p[d]) = target[d] for every domain d. Starting from 1, projected gradient descent
   on half the squared residuals takes r to max(0, r - step * t * dot(p, residual)); gradients and
   residuals are sums over all documents, one small aggregation for each iteration, and only
   one number for each domain comes to the driver. A document's rate is a fold over the history of
   residuals, so no rates are stored between iterations. Each square is weighted by one over the
   domain's tokens, and the gradient is preconditioned by 1/t, so that a long document's rate
   moves no more than a short one's.
3. Copies: floor(rate + u), u being a hash of its id and text in [0, 1): unbiased rounding.

Target weights are shares of all tokens: by default each domain's current expected share to the
power ``FLATTEN``, normalised. Weights leave the sum of tokens open; it is taken such that no
domain has to shrink (the domain most in surplus keeps its tokens, all others grow by repeats).

If the targets can't be reached to ``TOLERANCE`` within ``ITERATIONS`` (a domain that no document's posterior
favours can't gain), ``mix`` warns and the rates are the last that were found.

Defined cases: null and empty texts have no token, the prior as posterior and rate 1;
documents without a label take part like all others; without any label there is one
domain, ``all``, and all rates are 1; any string is a label, also one that differs from another in case only; targets for unknown domains raise an error; rows equal in id and text get equal rates and copies, different texts under one id, or without one, are rated and rounded on their own; texts count whole, whatever their length; an empty
table gives an empty result.
"""

from __future__ import annotations

import json
import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posada.llm.shared import Scratch, hashed_sample, row_key

VOCABULARY = 2_000
SAMPLE_ROWS = 4_000
TEMPERATURE = 8.0  # naive Bayes counts dependent words as independent; dividing tempers that
FLATTEN = 0.7
ITERATIONS = 30
WIDTH = 8  # domains whose sums are columns of one row
TOLERANCE = 1e-4


def words(text: Column) -> Column:
    """Words of a text in lower case; an empty array without any."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def labelled_table(docs: DataFrame, domain: str) -> tuple[list[str], list[float], list[tuple[str, list[float]]]]:
    """Domains, log priors, and rows (word, log-probability by domain), VOCABULARY rows at most."""
    known = docs.where(F.col(domain).isNotNull()).select("doc_id", "text", F.col(domain).alias("domain"))
    sizes = known.groupBy("domain").count().collect()  # a row for each domain
    names = sorted(r["domain"] for r in sizes)
    if not names:
        return ["all"], [0.0], []
    total = sum(r["count"] for r in sizes)
    prior = {r["domain"]: math.log(r["count"] / total) for r in sizes}
    sample = hashed_sample(known, SAMPLE_ROWS).select("domain", F.explode(words(F.col("text"))).alias("word"))
    # labels only ever stand in data, never in column names
    per_domain = F.map_from_entries(F.collect_list(F.struct("domain", "n")))
    counts = sample.groupBy("word", "domain").agg(F.count("*").alias("n")).groupBy("word").agg(F.sum("n").alias("every"), per_domain.alias("by"))
    top = counts.orderBy(F.desc("every"), "word").limit(VOCABULARY).collect()
    sums = {n: sum(r["by"].get(n, 0) for r in top) + len(top) for n in names}
    rows = [(r["word"], [math.log((r["by"].get(n, 0) + 1) / sums[n]) for n in names]) for r in top]
    return names, [prior[n] for n in names], rows


def _constant(values: list, kind: str) -> Column:
    """Numbers as one literal, however many."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def memberships(docs: DataFrame, domain: str = "lang") -> tuple[list[str], DataFrame]:
    """Domains in order, and doc_id, text_key (a hash of the text), tokens and posteriors p of every document.

    Log-probabilities are summed as WIDTH columns; more domains than that take more rows, not more columns.
    """
    names, prior, rows = labelled_table(docs, domain)
    spark, size = docs.sparkSession, len(names)
    plain = docs.select("doc_id", row_key()[1].alias("text_key"), words(F.col("text")).alias("w"))
    priors = _constant(prior, "array<double>")
    if not rows:
        return names, plain.select("doc_id", "text_key", F.size("w").cast("long").alias("tokens"), _softmax(priors).alias("p"))
    parts, columns = range(0, size, WIDTH), [f"l{k}" for k in range(WIDTH)]
    padded = [(w, p + [0.0] * (-size % WIDTH)) for w, p in rows]
    lookup = spark.createDataFrame([(w, k, *p[k : k + WIDTH]) for w, p in padded for k in parts], "word string, part int, " + ", ".join(f"{c} double" for c in columns))
    # a number for each row; rows of one document lie in one task, so most of the sum is done before the shuffle
    numbered = plain.withColumn("row", F.monotonically_increasing_id())
    exploded = numbered.select("row", "doc_id", "text_key", F.size("w").alias("tokens"), F.explode_outer("w").alias("word"))
    # VOCABULARY rows at most for each WIDTH domains
    summed = exploded.join(F.broadcast(lookup), "word", "left").groupBy("row", "doc_id", "text_key", "tokens", F.coalesce("part", F.lit(0)).alias("part")).agg(
        *(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in columns)
    )
    if len(parts) == 1:
        sums = F.array(*columns)
    else:
        # a document without a known word has the first part only
        by_part = F.map_from_entries(F.collect_list(F.struct("part", F.array(*columns).alias("l"))))
        summed = summed.groupBy("row", "doc_id", "text_key", "tokens").agg(by_part.alias("by"))
        zeros = F.array_repeat(F.lit(0.0), WIDTH)
        sums = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(parts[-1]), F.lit(WIDTH)), lambda k: F.coalesce(F.get(F.map_values(F.map_filter("by", lambda part, _: part == k)), F.lit(0)), zeros)))
    score = F.zip_with(F.slice(sums, 1, size), priors, lambda a, b: a / F.lit(TEMPERATURE) + b)
    return names, summed.select("doc_id", "text_key", F.col("tokens").cast("long").alias("tokens"), _softmax(score).alias("p"))


def _softmax(score: Column) -> Column:
    top = F.array_max(score)
    weight = F.transform(score, lambda x: F.exp(x - top))
    total = F.aggregate(weight, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weight, lambda x: x / total)


def _rate(p: Column, history: list[list[float]]) -> Column:
    """The rate after the given steps (each a number by domain, to be dotted with p)."""
    if not history:
        return F.lit(1.0)
    dot = lambda s: F.aggregate(F.zip_with(p, s, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(_constant(history, "array<array<double>>"), F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - dot(s)))


def fit_rates(members: DataFrame, names: list[str], targets: dict[str, float] | None = None) -> tuple[list[list[float]], list[float], list[float]]:
    """History of steps, targets and reached totals, both in tokens. ``members`` must be cheap to read repeatedly."""
    size = len(names)
    if unknown := sorted(set(targets or ()) - set(names)):
        raise ValueError(f"targets name unknown domains: {unknown}")

    def totals(history: list[list[float]]) -> list[float]:
        rate = _rate(F.col("p"), history)
        weighted = members.select((F.col("tokens") * rate).alias("w"), "p")
        if size <= WIDTH:
            got = weighted.agg(*(F.coalesce(F.sum(F.col("w") * F.col("p")[k]), F.lit(0.0)).alias(f"t{k}") for k in range(size))).first()
            return [float(x) for x in got]
        by = weighted.select("w", F.posexplode("p").alias("k", "q")).groupBy("k").agg(F.sum(F.col("w") * F.col("q")).alias("t")).collect()  # one number for each domain
        out = [0.0] * size
        for r in by:
            out[r["k"]] = float(r["t"])
        return out

    now = totals([])
    every = sum(now)
    if every <= 0:
        return [], now, now
    share = [(x / every) ** FLATTEN for x in now] if targets is None else [targets.get(n, 0.0) for n in names]
    most = max((x / w for x, w in zip(now, share) if w > 0), default=0.0)
    want = [w * most for w in share]
    # with these weights and this preconditioning each row of the Hessian sums to at most 1, so a step of 0.9 descends
    scale = [max(x, 1e-9 * every) for x in now]
    history: list[list[float]] = []
    for _ in range(ITERATIONS):
        residual = [a - b for a, b in zip(now, want)]
        if max(abs(x) for x in residual) <= TOLERANCE * every:
            break
        history.append([0.9 * r / s for r, s in zip(residual, scale)])
        now = totals(history)
    return history, want, now


def mix(docs: DataFrame, domain: str = "lang", targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, tokens, rate, copies, ``posteriors``, a map from domain to probability, and ``text_key``, a hash of the text, for every document.

    Targets that were not reached raise a warning.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    names, members = memberships(docs, domain)
    members = scratch.put(members, "members")
    history, want, got = fit_rates(members, names, targets)
    if max(abs(a - b) for a, b in zip(want, got)) > TOLERANCE * max(sum(got), 1.0):
        warnings.warn(f"targets not reached: {dict(zip(names, want))} tokens wanted, {dict(zip(names, got))} got", stacklevel=2)
    u = F.shiftrightunsigned(F.xxhash64("doc_id", "text_key", F.lit("copies")), 11).cast("double") * F.lit(2.0**-53)
    rate = F.when(F.col("tokens") > 0, _rate(F.col("p"), history)).otherwise(F.lit(1.0))
    return members.withColumn("rate", rate).select(
        "doc_id", "tokens", "rate", F.floor(F.col("rate") + u + 1e-9).cast("int").alias("copies"),
        F.map_from_arrays(_constant(names, "array<string>"), "p").alias("posteriors"), "text_key",
    )
