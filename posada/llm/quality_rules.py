"""Quality rules as a short-circuit cascade.

The base figures of a text (words, characters, symbols, repeated lines and words) are output of every row, so they are
computed for every text, and the base rule goes by them. The other rules read the texts that are left: some compare base figures,
some pass over bytes, some sort words. ``plan`` measures every rule's cost and rejection rate on a bounded sample, on the
executors, and orders the rules by rejections per cost; ``apply`` then evaluates a rule
only on the texts that all earlier rules let pass, and reads nothing of the others. Cost is counted in array elements that a rule
reads or sorts, not by a clock, so the order is the same in every run. It decides the work and which
rule is named, never the verdict, since a document is kept if no rule rejects it.

Defined cases: a null or empty text has no words and fails the base rule (under 50
words); equal rows get equal verdicts; a row without an id is judged like any other; an empty table gives an empty result; columns of
the input other than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posada.llm import text as tk
from posada.llm.shared import hashed_sample, ship

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SAMPLE_ROWS = 400  # bound of the sample on which costs and rates are measured
SORT = 16  # reads of an element that sorting it counts for

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_ASCII_LETTER = _UPPER.copy()
_ASCII_LETTER[ord("a") : ord("z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_HEAD = np.ones(256, bool)  # bytes that begin a code point
_HEAD[0x80:0xC0] = False

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, rejected_by string"
)


def lines(block: tk.Block, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the lines that hold a word; ``starts`` are the words' first bytes."""
    breaks = np.flatnonzero(block.data == 0x0A)
    full = block.offsets[:-1] < block.offsets[1:]
    begin = np.sort(np.concatenate((block.offsets[:-1][full], breaks + 1)))
    end = np.sort(np.concatenate((block.offsets[1:][full], breaks)))
    solid = begin < end
    begin, end = begin[solid], end[solid]
    with_word = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    return begin[with_word], end[with_word]


def n_repeat_words(block: tk.Block, w: tk.Words, size: int = 3) -> np.ndarray:
    """Words that stand in a window of ``size`` words found at least twice in their text, by row."""
    value, first = tk.windows(w, size)
    marked = np.zeros(len(w.hash), bool)
    if len(value):
        row = w.row[first]
        order = np.lexsort((value, row))
        same = (row[order][1:] == row[order][:-1]) & (value[order][1:] == value[order][:-1])
        twice = np.zeros(len(value), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = first[order[twice]]
        for k in range(size):
            marked[hit + k] = True
    return np.bincount(w.row[marked], minlength=block.rows)


class Figures:
    """The base figures of the texts of a block."""

    def __init__(self, block: tk.Block):
        self.block = block
        self.words = tk.words(block)
        self.n_words = tk.word_counts(block, self.words)
        inside = tk.IS_WORD[block.data]
        self.word_chars = block.per_row(inside & _HEAD[block.data])
        self.n_symbols = block.per_row(_SYMBOL[block.data])
        begin, end = lines(block, self.words.start)
        row = block.row_of(begin)
        self.n_lines = np.bincount(row, minlength=block.rows)
        _, at = tk.sorted_sets(row, block.span_hash(block.eights(), begin, end), block.rows)
        self.n_dup_lines = self.n_lines - np.diff(at)
        self.n_repeat_words = n_repeat_words(block, self.words)
        self.base_failed = (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words)

    def n_bytes(self, rows: np.ndarray) -> np.ndarray:
        return self.block.offsets[rows + 1] - self.block.offsets[rows]

    def words_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row (counted within ``rows``) and hash of the words of the given texts."""
        at = np.searchsorted(self.words.row, rows)
        count = self.n_words[rows]
        total = np.concatenate(([0], np.cumsum(count)))
        pick = np.repeat(at - total[:-1], count) + np.arange(total[-1])
        return np.repeat(np.arange(len(rows)), count), self.words.hash[pick]


@dataclass(frozen=True)
class Rule:
    """``rejects`` says of the given rows of a block whether each is rejected; ``cost`` how many elements it reads or sorts for that."""

    name: str
    rejects: Callable[[Figures, np.ndarray], np.ndarray]
    cost: Callable[[Figures, np.ndarray], int]


def _one(f: Figures, rows: np.ndarray) -> int:
    return len(rows)


def _passes(n: int) -> Callable[[Figures, np.ndarray], int]:
    return lambda f, rows: n * int(f.n_bytes(rows).sum())


def _sorts(n: int) -> Callable[[Figures, np.ndarray], int]:
    return lambda f, rows: n * SORT * int(f.n_words[rows].sum())


def _symbols(f: Figures, rows: np.ndarray) -> np.ndarray:
    return 100 * f.n_symbols[rows] > 10 * f.word_chars[rows]


def _long_words(f: Figures, rows: np.ndarray) -> np.ndarray:
    return f.word_chars[rows] > 25 * f.n_words[rows]


def _short_words(f: Figures, rows: np.ndarray) -> np.ndarray:
    return f.word_chars[rows] < 2 * f.n_words[rows]


def _same_lines(f: Figures, rows: np.ndarray) -> np.ndarray:
    return (f.n_lines[rows] >= 4) & (100 * f.n_dup_lines[rows] > 60 * f.n_lines[rows])


def _shouting(f: Figures, rows: np.ndarray) -> np.ndarray:
    own = f.block.take(rows)
    return 100 * own.per_row(_UPPER[own.data]) > 70 * np.maximum(own.per_row(_ASCII_LETTER[own.data]), 1)


def _digits(f: Figures, rows: np.ndarray) -> np.ndarray:
    own = f.block.take(rows)
    return 100 * own.per_row(_DIGIT[own.data]) > 40 * f.word_chars[rows]


def _few_letters(f: Figures, rows: np.ndarray) -> np.ndarray:
    """Less than half of the words hold a letter (any byte beyond ASCII counts as one)."""
    own = f.block.take(rows)
    start, end = tk.spans(own, tk.IS_WORD[own.data])
    letters = np.concatenate(([0], np.cumsum(_ASCII_LETTER[own.data] | (own.data >= 0x80))))
    return 2 * np.bincount(own.row_of(start), letters[end] > letters[start], minlength=len(rows)) < f.n_words[rows]


def _one_pair(f: Figures, rows: np.ndarray) -> np.ndarray:
    """The most frequent pair of successive words makes up more than a quarter of all pairs."""
    row, h = f.words_of(rows)
    if len(h) < 2:
        return np.zeros(len(rows), bool)
    same = row[1:] == row[:-1]
    pair, of = tk.mix(h[:-1] * np.uint64(3) + h[1:])[same], row[1:][same]
    order = np.lexsort((pair, of))
    pair, of = pair[order], of[order]
    new = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (of[1:] != of[:-1])))) if len(pair) else np.zeros(0, np.int64)
    most = np.zeros(len(rows), np.int64)
    np.maximum.at(most, of[new], np.diff(np.append(new, len(pair))))
    return 4 * most > np.maximum(f.n_words[rows] - 1, 1)


def _few_distinct(f: Figures, rows: np.ndarray) -> np.ndarray:
    """Fewer distinct words than a fiftieth of all words, and than 50."""
    _, at = tk.sorted_sets(*f.words_of(rows), len(rows))
    return (50 * np.diff(at) < f.n_words[rows]) & (np.diff(at) < 50)


RULES = (
    Rule("symbols", _symbols, _one),
    Rule("long_words", _long_words, _one),
    Rule("short_words", _short_words, _one),
    Rule("same_lines", _same_lines, _one),
    Rule("shouting", _shouting, _passes(2)),
    Rule("digits", _digits, _passes(1)),
    Rule("few_letters", _few_letters, _passes(6)),
    Rule("one_pair", _one_pair, _sorts(2)),
    Rule("few_distinct", _few_distinct, _sorts(1)),
)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spent = {r.name: [0, 0, 0] for r in RULES}
    for batch in batches:
        for block in tk.blocks(batch.column("text")):
            f = Figures(block)
            rows = np.flatnonzero(~f.base_failed)
            for r in RULES:
                for k, v in enumerate((r.cost(f, rows), int(r.rejects(f, rows).sum()), len(rows))):
                    spent[r.name][k] += v
    yield pa.RecordBatch.from_arrays([pa.array(list(spent)), *(pa.array([v[k] for v in spent.values()], pa.int64()) for k in range(3))], ["rule", "cost", "rejected", "seen"])


def plan(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by falling rejections per cost, both measured on about ``sample_rows`` documents.

    Rates are smoothed by one half, so that a rule that never fired on the sample still
    goes by its cost; ties go by name.
    """
    ship(docs.sparkSession)
    seen = (
        hashed_sample(docs.select("doc_id", "text"), sample_rows).select("text").mapInArrow(_measure, "rule string, cost long, rejected long, seen long")
        .groupBy("rule").agg(*(F.sum(c).alias(c) for c in ("cost", "rejected", "seen"))).collect()
    )
    found = {s["rule"]: s for s in seen}

    def worth(r: Rule) -> float:
        if r.name not in found:
            return 0.0
        s = found[r.name]
        return (s["rejected"] + 0.5) / (s["seen"] + 1) / (max(s["cost"], 1) / max(s["seen"], 1))

    return sorted(RULES, key=lambda r: (-worth(r), r.name))


def apply(docs: DataFrame, order: list[Rule] | None = None) -> DataFrame:
    """One row for each document: the figures, ``base_failed``, ``kept`` and the rejecting rule, as SCHEMA has them."""
    ship(docs.sparkSession)
    names = [r.name for r in (plan(docs) if order is None else order)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_name = {r.name: r for r in RULES}
        for batch in batches:
            for block in tk.blocks(batch.column("text")):
                f = Figures(block)
                alive = ~f.base_failed
                why = np.full(block.rows, None, object)
                why[f.base_failed] = "base"
                for name in names:
                    rows = np.flatnonzero(alive)
                    if not len(rows):
                        break
                    bad = rows[by_name[name].rejects(f, rows)]
                    alive[bad] = False
                    why[bad] = name
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(block.first_row, block.rows),
                        *(pa.array(x, pa.int64()) for x in (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words)),
                        pa.array(f.base_failed), pa.array(alive), pa.array(why, pa.string()),
                    ],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
