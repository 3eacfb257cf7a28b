"""Quality rules as a short-circuit cascade (native DataFrame functions only).

Each rule passes or rejects a text. On a sample the cascade estimates what a rule costs
and how many texts it rejects, and puts rules in order of rejection per cost. The verdict
is one nested CASE: a text leaves at the first rule that rejects it, and later rules are
not computed. The order changes the cost alone, never the verdict.

Defined results: a null or empty text has no words and fails; repeated rows get the same
row each; an empty table gives an empty result; extra columns are ignored by measure()
and kept by filter_rows().
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, WORD, let, materialize

SYMBOLS = "#*$%&|<>"
#: Rows of the sample on which cost and selectivity are estimated.
SAMPLE_ROWS = 512
#: How often the sample is run through a rule, so that its time stands out from the job's.
SAMPLE_PASSES = 8


@dataclass(frozen=True)
class Rule:
    """passes(text) is true for a text that is acceptable; text is never null there."""

    name: str
    passes: Callable[[Column], Column]


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _share_at_most(part: str, whole: str, most: float) -> Callable[[Column], Column]:
    return lambda text: _count(text, part) <= F.lit(most) * _count(text, whole)


#: The rules besides the base. Limits are wide: ordinary prose in any language passes.
RULES: tuple[Rule, ...] = (
    Rule("symbols", _share_at_most(r"[#*$%&|<>]", WORD, 0.2)),
    Rule("capitals", _share_at_most(r"\p{Lu}", r"\p{L}", 0.5)),
    Rule("exclamations", _share_at_most(r"!", WORD, 0.3)),
    Rule("wordless", lambda text: _count(text, r"[\p{L}\p{M}]+") >= F.lit(0.5) * _count(text, WORD)),
    Rule("long_words", _share_at_most(r"[^\x20\x09-\x0D]{60,}", WORD, 0.1)),
    Rule("control", _share_at_most(r"[\x00-\x08\x0E-\x1F\x7F�]", WORD, 0.1)),
)


def repeated_words(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more in the array.

    Windows are (64-bit hash of three words, place), sorted so that equal ones meet; a
    repeated window covers three places, and from place to place at most the next one's
    distance counts, so overlaps count once.
    """

    def windows(w: Column) -> Column:
        spots = F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))
        return F.transform(spots, lambda a, i: F.xxhash64(a, F.get(w, i + 1), F.get(w, i + 2)))

    def places(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = lambda p: F.filter(p, lambda x, k: (x["h"] == F.get(p, k - 1)["h"]) | (x["h"] == F.get(p, k + 1)["h"]))
        return F.sort_array(F.transform(let(ordered, again), lambda x: x["i"]))

    def covered(spots: Column) -> Column:
        steps = F.transform(spots, lambda s, k: F.least(F.lit(3), F.coalesce(F.get(spots, k + 1) - s, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(places(hashes), covered))

    return let(let(words, windows), counted).cast("long")


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda line: line.rlike(WORD))
    measured = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text")).select(
        "doc_id", "text",
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("text", SPACE_RUN, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))).alias("n_repeat_words"),
    )
    return measured.withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) of each rule on the rows whose doc_id and text have the smallest hashes, so that
    neither the files' order nor their number decides. Hashes alone are sorted; only the chosen rows' texts move."""
    hashed = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(doc_id, text).alias("h"))
    chosen = materialize(hashed.select("h").orderBy("h").limit(rows)).distinct()
    sample = materialize(hashed.join(F.broadcast(chosen), "h", "left_semi").groupBy("h").agg(F.first("text").alias("text")).select("text"))
    again = sample.repartition(8).select("text", F.explode(F.sequence(F.lit(1), F.lit(SAMPLE_PASSES))).alias("k"))

    def run(verdict: Column) -> tuple[float, float]:
        began = time.monotonic()
        row = again.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(verdict, 0).otherwise(1)), F.lit(0)).alias("r")).first()
        return time.monotonic() - began, row["r"] / row["n"] if row["n"] else 0.0

    run(F.char_length("text") >= 0)
    idle = run(F.char_length("text") >= 0)[0]
    out = []
    for rule in rules:
        seconds, rejected = run(rule.passes(F.col("text")))
        out.append((rule, max(seconds - idle, 1e-3), rejected))
    return out


def ordered(estimates: list[tuple[Rule, float, float]]) -> list[Rule]:
    """By rejection per cost, most first; then cheap first; then by name."""
    return [rule for rule, seconds, rejected in sorted(estimates, key=lambda e: (-e[2] / e[1], e[1], e[0].name))]


def verdict(rules: list[Rule], text: Column, before: Column | None = None) -> Column:
    """True if before is not true and every rule passes, computed up to the first that rejects."""
    kept = F.lit(True)
    for rule in reversed(rules):
        kept = F.when(~rule.passes(text), F.lit(False)).otherwise(kept)
    return kept if before is None else F.when(before, F.lit(False)).otherwise(kept)


def assess(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """measure() with kept, without text. One pass over docs, no exchange."""
    cascade = ordered(estimate(docs, rules, doc_id, text))
    return measure(docs, doc_id, text).withColumn("kept", verdict(cascade, F.col("text"), F.col("base_failed"))).drop("text")


def filter_rows(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose text passes every rule of the cascade."""
    return docs.where(verdict(ordered(estimate(docs, rules, doc_id, text)), F.coalesce(F.col(text), F.lit(""))))
