"""Language ID by cross-parsing entropy.

A suffix automaton of each language's labelled text gives, from any place of a text, the
longest match in that language. A text is parsed greedily into such phrases; phrases times
the bits that name a place in the language's text, for each character, is its cost. The
language with the smallest cost wins. The score is its share of the languages' likelihoods
2**-cost.

Texts are lower-cased; letters stay and every run of anything else is one space. A parse
starts anew every 512 characters, so that one step of all blocks and languages is a few
array operations; every character of every text counts. Every letter of the training texts
has a code of its own, of any script; with many of them transitions are sorted keys, not a table.

The model is fitted on a bounded sample of labelled rows: of each language, of the rows with letters,
the TRAIN_ROWS of smallest hash, each from its first letter on for ROW_CHARS characters at most, until
they have TRAIN_CHARS characters. Rows without a doc_id are not of the sample. It is fitted once, on the driver, and broadcast: a few bytes for each
character of the samples. A language with fewer
letters in its sample than 1 / LEAST_SHARE of the largest sample's is left out: its phrases
would cost too few bits.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every
text when no row is labelled; ties go to the language first in order; repeated rows get
equal predictions; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .near import bounded

UNKNOWN = "und"
TRAIN_ROWS, ROW_CHARS, TRAIN_CHARS = 60, 4_000, 40_000
LEAST_SHARE = 16
BLOCK = 512
#: Codes up to which the transitions of all states are a table; more are kept sparse.
DENSE = 256
#: Characters parsed together; bounds memory only.
GROUP_CHARS, GROUP_ROWS = 1_000_000, 500
#: Codes of anything but letters, and of letters that no training text has.
SPACE, FOREIGN = 0, 1


@dataclass
class Model:
    """The automata of all languages, with one numbering of states. It goes to the workers sparse."""

    languages: tuple[str, ...]
    codes: np.ndarray  # of each code point
    width: int
    states: int
    keys: np.ndarray  # state * width + code of each transition, ascending
    to: np.ndarray  # the next state of each key
    roots: np.ndarray  # the state of each language after one code
    bits: np.ndarray  # of a place in each language's text

    @cached_property
    def table(self) -> np.ndarray | None:
        """The next state of each state and code, 0 if none; only where codes are few. It goes with the model."""
        if self.width > DENSE:
            return None
        dense = np.zeros(self.states * self.width, dtype=np.int32)
        dense[self.keys] = self.to
        return dense


def _automaton(text: list[int]) -> list[dict[int, int]]:
    """The transitions of the suffix automaton: state 0 the root, 1 a dead end. No transition leads to the root."""
    nexts: list[dict[int, int]] = [{}, {}]
    links, lengths, last = [-1, -1], [0, 0], 0
    for c in text:
        now = len(nexts)
        nexts.append({})
        lengths.append(lengths[last] + 1)
        links.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = now
            p = links[p]
        if p >= 0:
            q = nexts[p][c]
            if lengths[p] + 1 == lengths[q]:
                links[now] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                lengths.append(lengths[p] + 1)
                links.append(links[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = links[p]
                links[q] = links[now] = clone
        last = now
    return nexts


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """1 of letters, 2 of marks, which go with letters."""
    kinds = map(unicodedata.category, map(chr, range(0x110000)))
    return np.fromiter(({"L": 1, "M": 2}.get(k[0], 0) for k in kinds), dtype=np.uint8, count=0x110000)


def fit(samples: tuple[tuple[str, str], ...]) -> Model:
    """From (language, text) of each language, in order."""
    codes = np.where(_letters() > 0, FOREIGN, SPACE).astype(np.uint32)
    seen = sorted({c for _, text in samples for c in text.lower() if _letters()[ord(c)]})
    for k, c in enumerate(seen):
        codes[ord(c)] = k + 2
    width, keys, to, bits, base = len(seen) + 2, [], [], [], 0
    roots = np.zeros((len(samples), width), dtype=np.int32)
    for k, (_, text) in enumerate(samples):
        coded = encode(text, codes)
        nexts = _automaton(coded[coded != FOREIGN].tolist())
        keys.append(np.array([(base + state) * width + c for state, out in enumerate(nexts) for c in sorted(out)], dtype=np.int64))
        to.append(np.array([base + out[c] for out in nexts for c in sorted(out)], dtype=np.int32))
        roots[k] = base + 1
        for c, first in nexts[0].items():
            roots[k, c] = base + first
        bits.append(np.log2(max(2, len(coded))))
        base += len(nexts)
    key, table = (np.concatenate(x) if x else np.zeros(0, dtype=np.int32) for x in (keys, to))
    return Model(tuple(name for name, _ in samples), codes, width, base, key, table, roots, np.array(bits))


def _step(model: Model, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The next states, 0 if none."""
    asked = states * model.width + codes
    if model.table is not None:
        return model.table[asked]
    if not len(model.keys):
        return np.zeros_like(asked)
    at = np.minimum(np.searchsorted(model.keys, asked), len(model.keys) - 1)
    return np.where(model.keys[at] == asked, model.to[at], 0)


def encode(text: str, codes: np.ndarray) -> np.ndarray:
    """The codes of a text's letters, runs of anything else as one space."""
    raw = codes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    if not len(raw):
        return raw
    return raw[np.concatenate([[True], (raw[1:] != SPACE) | (raw[:-1] != SPACE)])]


def phrases(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """(texts, languages): how many phrases each text takes."""
    counts = np.zeros((len(texts), len(model.languages)), dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), [-(-len(t) // BLOCK) for t in texts])
    if not len(owner):
        return counts
    parts = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    lengths = np.array([len(p) for p in parts])
    order = np.argsort(-lengths, kind="stable")
    grid = np.zeros((lengths.max(), len(parts)), dtype=np.int64)
    for column, k in enumerate(order):
        grid[: lengths[k], column] = parts[k]
    active = np.searchsorted(-lengths[order], -np.arange(lengths.max()), side="left")
    found = np.ones((len(model.languages), len(parts)), dtype=np.int32)
    state = model.roots[:, grid[0]].astype(np.int64)
    for step in range(1, len(grid)):
        n = active[step]
        codes, now = grid[step, :n], state[:, :n]
        to = _step(model, now, codes)
        ends = to == 0
        found[:, :n] += ends
        state[:, :n] = np.where(ends, model.roots[:, codes], to)
    for k in range(len(model.languages)):
        counts[:, k] = np.bincount(owner[order], weights=found[k], minlength=len(texts))
    return counts


def classify(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    coded = [encode(t or "", model.codes) for t in texts]
    known = [t is not None and (t.isalpha() or any(map(str.isalpha, t))) for t in texts]
    if not model.languages:
        return [(UNKNOWN, 0.0)] * len(texts)
    cost = phrases(model, coded) * model.bits
    best = cost.argmin(axis=1)
    share = 1 / np.exp2(np.maximum(cost.min(axis=1, keepdims=True) - cost, -1000)).sum(axis=1)
    return [(model.languages[b], float(s)) if k else (UNKNOWN, 0.0) for k, b, s in zip(known, best, share, strict=True)]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


def training_sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> tuple[tuple[str, str], ...]:
    """(language, text) of each label, from rows that are not held out: at most rows rows of each, until they have chars characters."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & ~held_out(doc_id)).select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang"))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id"))
    chosen = labelled.withColumn("_rank", rank).where(F.col("_rank") <= rows)
    joined = docs.select(F.col(doc_id), F.col(lang), F.col(text)).join(bounded(chosen), (F.col(doc_id) == F.col("_id")) & (F.col(lang) == F.col("_lang")))
    start = F.substring(F.regexp_replace(F.col(text), r"\A\P{L}+", ""), 1, ROW_CHARS)
    texts: dict[str, str] = {}
    for name, part in joined.select("_lang", start.alias("t")).orderBy("_lang", "_rank", "t").toLocalIterator():
        if len(texts.get(name, "")) < chars:
            texts[name] = texts.get(name, "") + " " + part
    letters = {name: sum(map(str.isalpha, t)) for name, t in texts.items()}
    most = max(letters.values(), default=0)
    return tuple(sorted((name, t) for name, t in texts.items() if LEAST_SHARE * letters[name] >= most))


def predict(docs: DataFrame, samples: tuple[tuple[str, str], ...], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(samples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, GROUP_ROWS):
                out += _classified(shared.value, batch["text"].slice(at, GROUP_ROWS).to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def _classified(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """classify(), some texts at a time."""
    out, group, size = [], [], 0
    for t in texts:
        group.append(t)
        size += len(t or "")
        if size > GROUP_CHARS:
            out += classify(model, group)
            group, size = [], 0
    return out + (classify(model, group) if group else [])


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs, fitted on those that are not held out."""
    return predict(docs, training_sample(docs, doc_id, text, lang), doc_id, text).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.0) -> DataFrame:
    """The rows of docs without those whose text has no language, or a score below least."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(training_sample(docs, doc_id, text, lang)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP_ROWS):
                part = batch.slice(at, GROUP_ROWS)
                found = _classified(shared.value, part[text].to_pylist())
                yield part.filter(pa.array([name != UNKNOWN and score >= least for name, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
