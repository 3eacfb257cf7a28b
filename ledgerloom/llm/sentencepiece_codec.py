"""SentencePiece encoding and decoding that keeps each piece's span in the original bytes.

Normalisation follows the model: its compiled character map is a double-array trie whose
longest prefix at each place is replaced, every normalised byte remembering the original
byte that it came from; white space becomes the meta symbol. Pieces then project through
this alignment. No piece of the vocabularies that are accepted holds the meta symbol after
another character, so no merge crosses into the next word, nor between characters
that no piece joins; each distinct word is encoded once for a task; a vocabulary of another kind is encoded text by text.

Defined results: a null text counts as empty; an empty text has no ids, no spans and
decodes to ""; lone surrogates cannot occur in UTF-8 columns; texts of any length are
encoded whole; repeated rows get equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

META = "▁"
#: Distinct words whose ids a task remembers, twice over; older ones go. Bounds memory only.
REMEMBERED = 120_000
#: Characters that are split and looked up together.
GROUP_CHARS = 1_000_000
#: Put before a word that follows no space; the vocabulary must not have it in a piece.
LEAD = "\n"


class CharMap:
    """The compiled map: a little-endian uint32 with the trie's size, its units, then the replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist() if size else []
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """How many bytes from at the longest entry takes, and what replaces them."""
        if not self.units:
            return None
        units, found = self.units, None
        node = (units[0] >> 10) << ((units[0] & 0x200) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = k + 1 - at, self.texts[start : self.texts.index(b"\0", start)]
        return found


def _joined_characters(pieces: list[str]) -> list[str]:
    """Groups of characters that stand side by side in some piece, directly or through others.

    A merge makes a piece, so none joins two characters of different groups: a text may be
    cut between them and its parts be encoded alone. The meta symbol belongs to none; it
    goes with what follows it.
    """
    parent: dict[str, str] = {}

    def root(c: str) -> str:
        while parent.setdefault(c, c) != c:
            c = parent[c]
        return c

    for piece in pieces:
        body = piece.lstrip(META)
        for a, b in zip(body, body[1:], strict=False):
            parent[root(a)] = root(b)
    groups: dict[str, list[str]] = {}
    for c in parent:
        groups.setdefault(root(c), []).append(c)
    return sorted("".join(sorted(g)) for g in groups.values())


class Codec:
    """A model with its normaliser. Loaded once for each worker."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = proto.normalizer_spec
        self.map, self.dummy, self.squeeze, self.escape = CharMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        pieces = [(p.piece, p.type) for p in proto.pieces]
        inner = any(META in p.lstrip(META) for p, kind in pieces if kind == 1)
        plain = not self.map.units and self.dummy and not self.squeeze and self.escape and not proto.trainer_spec.treat_whitespace_as_suffix
        user = any(kind == 4 for _, kind in pieces)
        self.by_word = plain and not inner and not user
        self.meta_id = self.processor.piece_to_id(META)
        #: Normalised bytes of each piece; a byte piece is one byte, and unknown pieces are measured where they stand.
        self.bytes_of = np.array([1 if kind == 6 else len(p.encode()) if kind in (1, 4) else 0 for p, kind in pieces], dtype=np.int64)
        self.names = [str(i) for i in range(len(pieces))]
        groups = _joined_characters([p for p, kind in pieces if kind == 1])
        self.lead_ids = self.processor.encode(LEAD)
        self.by_word = self.by_word and LEAD not in "".join(groups) and all(LEAD not in p for p, kind in pieces if kind == 1)
        runs = [f"[{re.escape(g)}]+" for g in groups] + [f"[^ {re.escape(''.join(groups))}]+"]
        self.split = re.compile(f" *(?:{'|'.join(runs)})| +").findall
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def normalize(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes and, for each of them and the end, its original byte."""
        data, meta = text.encode(), META.encode() if self.escape else b" "
        if not self.map.units and not self.squeeze:
            raw = np.frombuffer(data, dtype=np.uint8)
            width = np.where(raw == 32, len(meta), 1)
            origin = np.repeat(np.arange(len(raw)), width)
            body, lead = data.replace(b" ", meta), meta if self.dummy and data else b""
            return lead + body, np.concatenate([np.zeros(len(lead), dtype=np.int64), origin, [len(data)]])
        out, origin, at = bytearray(), [], 0
        spaced = True  # at the start, extra space is dropped
        if self.dummy and data:
            out += meta
            origin += [0] * len(meta)
        while at < len(data):
            took, new = self.map.longest(data, at) or (width := (1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2, 3, 4)[data[at] >> 4], data[at : at + width])
            for part in re.findall(rb" |[^ ]+", new):
                if part == b" ":
                    if self.squeeze and spaced:
                        continue
                    part, spaced = meta, True
                else:
                    spaced = False
                out += part
                origin += [at] * len(part)
            at += took
        if self.squeeze:
            floor = len(meta) if self.dummy and len(out) == len(meta) else 0
            while len(out) > floor and out.endswith(meta):
                del out[-len(meta) :], origin[-len(meta) :]
        return bytes(out), np.array([*origin, len(data)], dtype=np.int64)

    def _learn(self, words: set[str]) -> None:
        """Encodes words that are not remembered, one call for all of them."""
        new = []
        for word in words:
            got = self.older.get(word)
            if got is None:
                new.append(word)
            else:
                self.seen[word] = got
        # the lead stands for what a word without a space follows; nothing merges with it
        encoded = self.processor.encode([w[1:] if w[0] == " " else LEAD + w for w in new], num_threads=1) if new else []
        skip = len(self.lead_ids)
        for word, ids in zip(new, encoded, strict=True):
            ids = [self.meta_id] if word == " " else ids if word[0] == " " else ids[skip:]
            self.seen[word] = np.array(ids, dtype=np.int32).tobytes()

    def _by_word(self, texts: list[str]) -> list[np.ndarray]:
        # spaces and literal meta symbols normalise alike
        split = [self.split(" " + t.replace(META, " ")) if t else [] for t in texts]
        found = [list(map(self.seen.get, words)) for words in split]
        holes = [[i for i, x in enumerate(got) if x is None] if None in got else [] for got in found]
        missing = {words[i] for words, at in zip(split, holes, strict=True) for i in at}
        if missing:
            if len(self.seen) + len(missing) > REMEMBERED:
                self.older, self.seen = self.seen, {}
            self._learn(missing)
            for words, got, at in zip(split, found, holes, strict=True):
                for i in at:
                    got[i] = self.seen[words[i]]
        return [np.frombuffer(b"".join(got), dtype=np.int32) for got in found]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Works through texts by about a million characters."""
        if not self.by_word:
            return [np.array(i, dtype=np.int32) for i in self.processor.encode(texts, num_threads=1)] if texts else []
        out, group, size = [], [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size > GROUP_CHARS:
                out += self._by_word(group)
                group, size = [], 0
        return out + self._by_word(group)

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return self.processor.decode(ids)

    def spans(self, text: str, ids: list[int] | np.ndarray) -> np.ndarray:
        """(n, 2): the bytes of text, from and to, of each id. They ascend and cover the text."""
        normalized, origin = self.normalize(text)
        if not len(ids):
            return np.zeros((0, 2), dtype=np.int64)
        lengths = self.bytes_of[ids]
        if not lengths.all():  # an unknown piece stands for one or more characters
            return self._measured(normalized, origin, ids)
        ends = np.cumsum(lengths)
        if ends[-1] != len(normalized):
            return self._measured(normalized, origin, ids)
        return np.stack([origin[ends - lengths], origin[ends]], axis=1)

    def _measured(self, normalized: bytes, origin: np.ndarray, ids: list[int]) -> np.ndarray:
        """As the library's own pieces have it, by their surface in characters."""
        text = normalized.decode(errors="replace")
        starts = np.cumsum([0, *(len(c.encode()) for c in text)])
        at, out = 0, []
        known = [self.bytes_of[i] for i in ids]
        for k, size in enumerate(known):
            rest = len(normalized) - at
            take = int(size) if size else max(1, min(rest, rest - int(sum(known[k + 1 :]))))
            if not size:
                take = int(starts[bisect_right(starts, at + take - 1)]) - at
            end = min(at + take, len(normalized))
            out.append((origin[at], origin[end]))
            at = end
        return np.array(out, dtype=np.int64)


@lru_cache(maxsize=2)
def load(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, starts array<long>, ends array<long>): ids and their original byte spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(model)
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            ids = codec.encode_all(texts)
            spans = [codec.spans(t, i) for t, i in zip(texts, ids, strict=True)]
            lists = [pa.array(ids, pa.list_(pa.int32())), *(pa.array([s[:, k] for s in spans], pa.list_(pa.int64())) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *lists], ["doc_id", "ids", "starts", "ends"])

    return _rows(docs, doc_id, text).mapInArrow(run, "doc_id long, ids array<int>, starts array<long>, ends array<long>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([codec.decode(i or []) for i in batch["ids"].to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, n_spanned, spans_sha256): n_spanned bytes of n_bytes lie in
    spans, and spans_sha256 is of all pieces' (from, to), 64 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(model)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows, texts = [], [t or "" for t in part["text"].to_pylist()]
                for t, ids in zip(texts, codec.encode_all(texts), strict=True):
                    spans, listed = codec.spans(t, ids), ids.tolist()
                    rows.append((len(ids), sha(",".join(map(codec.names.__getitem__, listed)).encode()), sha(codec.decode(listed).encode()), len(t.encode()), int((spans[:, 1] - spans[:, 0]).sum()), sha(np.ascontiguousarray(spans, dtype="<i8"))))
                columns = zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)
                yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(c, kind) for c, kind in columns)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "n_spanned", "spans_sha256"])

    return _rows(docs, doc_id, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, n_spanned long, spans_sha256 string")


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
