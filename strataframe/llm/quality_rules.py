"""Quality rules as a bitmask ledger.

``measure`` reads each text once and returns counts.  ``ledger`` turns the
counts into one bit per failed rule.  A policy is a versioned set of rules;
applying one, or asking what happens without one of its rules, only reads bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textarrays import Block, find_words, gram_hashes, gram_starts, map_text, mix64, range_hashes, sum_ranges

WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_echoes")

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_CAPITALS = np.zeros(256, bool)
_CAPITALS[65:91] = True
_CODE_POINT = np.ones(256, bool)
_CODE_POINT[0x80:0xC0] = False
_ROW_CODE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measured counts; ``bit`` never changes its meaning."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 2 * n_words"),
    Rule(3, "duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "capitals", "100 * n_capitals > 30 * word_chars"),
    Rule(5, "short_words", "word_chars < 2 * n_words"),
    Rule(6, "long_words", "word_chars > 20 * n_words"),
    Rule(7, "echoes", "100 * n_echoes > 30 * n_words"),
)

#: Version of a policy to the names of its rules.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(rule.name for rule in RULES),
}


def _repeated_words(hashes: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """True for words inside an 8-word window that its row holds twice or more."""
    covered = np.zeros(len(hashes), bool)
    if len(starts) == 0:
        return covered
    keys = mix64(gram_hashes(hashes, WINDOW)[starts] ^ (rows[starts].astype(np.uint64) * _ROW_CODE))
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    found = starts[order[twice]]
    if len(found):
        size = len(hashes) + 1
        steps = np.bincount(found, minlength=size)[:size] - np.bincount(found + WINDOW, minlength=size)[:size]
        covered = np.cumsum(steps)[:-1] > 0
    return covered


def _echoes(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words equal to the word before them, for each row."""
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[bounds[:-1][bounds[:-1] < len(same)]] = False
    return sum_ranges(same, bounds)


def _lines(block: Block, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those equal to an earlier one, for each row."""
    n = len(block.offsets) - 1
    breaks = np.flatnonzero(block.data == 10)
    starts = np.sort(np.concatenate([block.offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, block.offsets[1:]]), kind="stable")
    row = np.repeat(np.arange(n), np.diff(np.searchsorted(breaks, block.offsets)) + 1)
    has_word = sum_of(inside, starts, ends) > 0
    starts, ends, row = starts[has_word], ends[has_word], row[has_word]
    keys = mix64(range_hashes(block.data, starts, ends) ^ (row.astype(np.uint64) * _ROW_CODE))
    _, first = np.unique(keys, return_index=True)
    total = np.bincount(row, minlength=n)
    return total, total - np.bincount(row[first], minlength=n)


def sum_of(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[ends] - sums[starts]


def count_block(block: Block) -> dict[str, np.ndarray]:
    """The counts of every row of a block."""
    words = find_words(block)
    inside = np.zeros(len(block.data) + 1, np.int8)
    inside[words.starts] = 1
    inside[words.ends] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    hashes = range_hashes(block.data, words.starts, words.ends)
    repeated = _repeated_words(hashes, gram_starts(words, WINDOW), words.rows)
    n_lines, n_dup_lines = _lines(block, inside)
    return {
        "n_words": words.counts,
        "word_chars": sum_ranges(inside & _CODE_POINT[block.data], block.offsets),
        "n_symbols": sum_ranges(_SYMBOLS[block.data], block.offsets),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": sum_ranges(repeated, words.bounds),
        "n_lines": n_lines,
        "n_capitals": sum_ranges(_CAPITALS[block.data], block.offsets),
        "n_echoes": _echoes(hashes, words.bounds),
    }


def measure(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of counts per document.

    A null or empty text has zero of everything.  Repeated ids and rows stay separate
    rows; other columns of ``docs`` are ignored, whatever their names.  A very long text is
    counted whole, within one task.  An empty table gives an empty one.  Counts have no ties.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batch: pa.RecordBatch, block: Block) -> pa.RecordBatch:
        counts = count_block(block)
        columns = [batch.column(id_column)] + [pa.array(counts[c], pa.int64()) for c in COUNTS]
        return pa.RecordBatch.from_arrays(columns, [id_column, *COUNTS])

    return map_text(docs, [id_column], text, run, f"{id_column} {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def ledger(measured: DataFrame) -> DataFrame:
    """Adds ``failed``: a bit for every rule that the counts break."""
    bits = [F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)) for rule in RULES]
    mask: Column = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return measured.withColumn("failed", mask.cast("long"))


def policy_mask(version: str) -> int:
    names = POLICIES[version]
    return sum(1 << rule.bit for rule in RULES if rule.name in names)


def keeps(version: str) -> Column:
    """True where no rule of the policy failed."""
    return F.col("failed").bitwiseAND(F.lit(policy_mask(version))) == 0


def ablation(ledgered: DataFrame, version: str) -> DataFrame:
    """What each rule of a policy does: fails in all, and fails of it alone.

    ``n_sole`` documents would be kept if the rule were taken out.  One pass
    with map-side sums; an empty ledger gives zeros.
    """
    mask = policy_mask(version)
    rules = [rule for rule in RULES if (1 << rule.bit) & mask]
    hit = F.col("failed").bitwiseAND(F.lit(mask))
    sums = [F.coalesce(F.sum((hit.bitwiseAND(F.lit(1 << r.bit)) != 0).cast("long")), F.lit(0)).alias(f"f{r.bit}") for r in rules]
    sums += [F.coalesce(F.sum((hit == (1 << r.bit)).cast("long")), F.lit(0)).alias(f"s{r.bit}") for r in rules]
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("n_failed"), F.col(f"s{r.bit}").alias("n_sole")) for r in rules])
    return ledgered.agg(*sums).select(F.inline(rows))
