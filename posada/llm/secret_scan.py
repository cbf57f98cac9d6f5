"""Secret scans with DataFrame and SQL functions only.

The base rules are three patterns; the method adds tokens that look random. First-order
Markov models over characters are trained from labelled samples: one of ordinary words and identifiers, and one for each
kind of random string (KINDS). A token is a secret if under the random model of its kind, the first whose characters it is made of, it is likelier than under the
ordinary one by more than ``THRESHOLD``, the log-likelihood ratio of all its transitions; so a longer token
needs less of it in each transition, and letters count as much as digits. A token has ``MIN_TOKEN`` characters or more
and a letter: numbers alone (of cards, phones, accounts) are personal data, not secrets, and no model speaks of them.

Labelled samples: generated random strings of each kind; values that the assign pattern found, with the kind that their characters
allow; ordinary words of the documents, and identifiers joined from successive words in the usual ways. Those of the table are drawn
from about ``SAMPLE_ROWS`` documents; every document is scanned.

Positions: a pattern's matches and the pieces between them add up to the text, so
running lengths of both give each match's start. They are summed in chunks, so that the work does not grow with the square of
the number of matches. ``length`` counts code points.

Defined cases: a null text is empty and has no spans; equal texts have equal values;
repeated rows and rows without an id are scanned one by one; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posada.llm.shared import hashed_sample


# Fixed values of the base rules.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

MIN_TOKEN = 12
TOKEN = rf"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}"
SAMPLE_ROWS = 1_000
SAMPLE_TOKENS = 16_000
THRESHOLD = 12.0
BACK_OFF = 20.0  # transitions that the frequency of single characters counts for
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
SIZE = len(ALPHABET)
#: What the random strings of each kind are made of.
KINDS = (
    "0123456789abcdef",
    "abcdefghijklmnopqrstuvwxyz",
    "abcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-",
)
CHUNK = 128  # matches whose lengths are summed in one fold


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str, kind: str, rank: int, value_group: int = 0, least: int = 1) -> Column:
    """Leftmost non-overlapping matches whose value has ``least`` characters, as structs (start, rank, end, kind, value)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length).alias("gap")
    zipped = lambda f, v: F.arrays_zip(gaps, F.transform(f, F.length).alias("size"), v.alias("value"))
    steps = zipped(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))) if value_group else _let(found, lambda f: zipped(f, f))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")

    def span(at: Column, s: Column) -> Column:
        start = at + s["gap"]
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + s["size"]).alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value"))

    def walk(chunk: Column, at: Column) -> Column:
        return F.aggregate(
            chunk,
            F.struct(at.alias("at"), empty.alias("spans")),
            lambda acc, s: F.struct(
                (acc["at"] + s["gap"] + F.coalesce(s["size"], F.lit(0))).alias("at"),
                F.when(F.length(s["value"]) >= least, F.concat(acc["spans"], F.array(span(acc["at"], s)))).otherwise(acc["spans"]).alias("spans"),
            ),
        )["spans"]

    length = lambda chunk: F.aggregate(chunk, F.lit(0), lambda a, s: a + s["gap"] + F.coalesce(s["size"], F.lit(0)))

    def spans(steps: Column) -> Column:
        """Chunks of matches, each walked from the sum of the lengths before it; the last sum is where the text ends."""
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int")), lambda k: F.slice(steps, k * CHUNK + 1, F.lit(CHUNK)))
        starts = lambda cs: F.aggregate(F.transform(cs, length), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return _let(chunks, lambda cs: F.flatten(F.zip_with(cs, F.slice(starts(cs), F.lit(1), F.size(cs)), walk)))

    few = lambda all_: F.when(F.size(all_) <= CHUNK, walk(all_, F.lit(0))).otherwise(spans(all_))
    return F.when(text.rlike(pattern), _let(steps, few)).otherwise(empty)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the base rules by kind. A run shorter than asked for fails whether or not the
    pattern itself asks for the length, for access and hex; for assign the bare pattern must be walked."""
    return {
        "assign": matches(text, ASSIGN, "assign", 0, 2, MIN_ASSIGN),
        "access": matches(text, rf"AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}", "access", 1),
        "hex": matches(text, rf"[0-9a-f]{{{MIN_HEX},}}", "hex", 2),
    }


def token_spans(text: Column) -> Column:
    """Tokens long enough to be judged."""
    return matches(text, TOKEN, "markov", 3)


def _pairs(token: Column) -> Column:
    """Transitions of a token: index of the first character times SIZE plus that of the second."""
    index = F.transform(F.split(token, ""), lambda c: F.position(c, F.lit(ALPHABET)) - 1)
    return _let(index, lambda x: F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: a * SIZE + b))


def kind_of(token: Column) -> Column:
    """The first kind (from 1) whose characters a token is made of; null if none has all of them."""
    kind = F.lit(None).cast("int")
    for k, chars in reversed(list(enumerate(KINDS, 1))):
        kind = F.when(F.translate(token, chars, "") == "", F.lit(k)).otherwise(kind)
    return kind


def _generated(spark: SparkSession, tokens: int) -> DataFrame:
    """(token, kind) of random strings by rule: 32 characters drawn by the digits of a digest."""
    rows = spark.range(tokens).select(F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 256).alias("hex"), (F.col("id") % len(KINDS)).cast("int").alias("k"))
    draw = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.xxhash64("hex", i))
    chars = F.array(*(F.lit(x) for x in KINDS))[F.col("k")]
    token = F.array_join(F.transform(draw, lambda h: F.substring(chars, F.pmod(h, F.length(chars)).cast("int") + 1, F.lit(1))), "")
    return rows.select(token.alias("token"), (F.col("k") + 1).alias("kind"))


def labelled_samples(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_tokens: int = SAMPLE_TOKENS) -> DataFrame:
    """(token, kind) rows: kind 0 for ordinary words and identifiers, k for random strings of KINDS[k - 1]."""
    text = F.coalesce(F.col("text"), F.lit(""))
    some = hashed_sample(docs.select("doc_id", "text"), sample_rows).select(text.alias("text"))
    values = some.select(F.explode(matches(F.col("text"), ASSIGN, "assign", 0, 2, MIN_TOKEN)).alias("s")).select(F.col("s.value").alias("token"))
    values = values.where(F.col("token").rlike("[0-9]")).select("token", kind_of(F.col("token")).alias("kind")).where("kind IS NOT NULL")
    words = F.regexp_extract_all(F.regexp_replace("text", ASSIGN, " "), F.lit("[A-Za-z]{2,}"), F.lit(0))
    pairs = some.select(words.alias("w")).select(F.explode(F.arrays_zip("w", F.slice("w", 2, F.size("w")).alias("next"))).alias("p")).select(
        F.col("p.w").alias("a"), F.coalesce("p.next", F.lit("")).alias("b")
    )
    forms = [
        F.col("a"), F.concat_ws("_", F.lower("a"), F.lower("b")), F.concat_ws("-", F.lower("a"), F.lower("b")), F.concat(F.lower("a"), F.initcap("b")),
        F.concat(F.initcap("a"), F.initcap("b")), F.concat_ws("_", F.upper("a"), F.upper("b")), F.concat_ws("/", F.lower("a"), F.lower("b")),
        F.concat(F.lower("a"), F.pmod(F.hash("b"), F.lit(100)).cast("string")),
    ]
    ordinary = pairs.select(F.array(*forms)[F.pmod(F.xxhash64("a", "b"), F.lit(len(forms))).cast("int")].alias("token"))
    return values.unionByName(_generated(docs.sparkSession, sample_tokens)).unionByName(ordinary.withColumn("kind", F.lit(0)))


def train(samples: DataFrame) -> list[list[float]]:
    """Log-likelihood ratios by transition (SIZE * SIZE of them) of each kind of random strings; every model backs off to how frequent the second character is."""
    pairs = samples.select("kind", F.explode(_pairs(F.col("token"))).alias("pair")).where("pair >= 0").groupBy("kind", "pair").count()
    counts = {(r["kind"], r["pair"]): r["count"] for r in pairs.collect()}  # (len(KINDS) + 1) * SIZE * SIZE rows at most

    def model(kind: int) -> list[float]:
        rows = [[counts.get((kind, a * SIZE + b), 0) for b in range(SIZE)] for a in range(SIZE)]
        ends = [sum(r[b] for r in rows) + 0.5 for b in range(SIZE)]
        alone = [x / sum(ends) for x in ends]
        return [math.log((n + BACK_OFF * p) / (sum(r) + BACK_OFF)) for r in rows for n, p in zip(r, alone)]

    ordinary = model(0)
    return [[p - q for p, q in zip(model(k), ordinary)] for k in range(1, len(KINDS) + 1)]


def ratio(token: Column, ratios: list[list[float]]) -> Column:
    """A token's log-likelihood ratio under the model of its kind, that is of the smallest set of characters which it is made of (the widest if none holds it)."""
    # all tables are one folded literal, not thousands of expressions
    tables = F.split(F.lit(",".join(f"{x:.6f}" for r in ratios for x in r)), ",").cast("array<double>")
    first = (F.coalesce(kind_of(token), F.lit(len(KINDS))) - 1) * (SIZE * SIZE) + 1
    total = lambda at: F.aggregate(_pairs(token), F.lit(0.0), lambda acc, p: acc + F.coalesce(F.try_element_at(tables, p + at), F.lit(0.0)))
    return _let(first, total)


def scan(docs: DataFrame, ratios: list[list[float]] | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, their digest and all spans of every document."""
    ratios = train(labelled_samples(docs)) if ratios is None else ratios
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = base_spans(F.col("text"))
    found = docs.select("doc_id", text.alias("text")).select(
        "doc_id", *(v.alias(k) for k, v in kinds.items()),
        F.filter(token_spans(F.col("text")), lambda s: ratio(s["value"], ratios) > THRESHOLD).alias("markov"),
    )
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda *names: F.array_join(F.transform(F.array_sort(F.concat(*names)), one), ",")
    return found.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(joined("assign", "access", "hex").cast("binary"), 256).alias("base_sha256"),
        joined("assign", "access", "hex", "markov").alias("spans"),
    )
