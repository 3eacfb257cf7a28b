"""What the near-duplicate operators share: shingles, buckets, verification, components.

Nodes are distinct shingle sets, named by a 64-bit digest, so exact copies are one node.
Buckets hold nodes that share a signature; buckets of the same nodes are one. A bucket is
searched from its first node on: nodes whose sketches allow a link to one that is reached are
reached from it, and those not reached are the only ones that the next is held against. So a
bucket gives a spanning forest of plausible links, fewer than it has nodes, and a group of near
copies of any size costs a link for each member. The forest's links are verified exactly. Where
one fails and leaves its two sides in different components, the bucket is searched once more,
for every plausible pair across components, and those are verified too. So no link that joins
different components is left out.

A bucket of more than CHUNK nodes is dealt into chunks, which share its first node. Across
chunks, every node outside the bucket's largest component then visits each chunk.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions

#: Distinct words whose hashes a task remembers. Bounds memory only.
REMEMBERED = 200_000
#: Narrow rows that a task takes at least where their number is counted; 4 tasks share fewer.
ROWS_A_TASK = 250_000
#: Nodes of a bucket that one search takes, about; of a bucket of small sets, of which those that share rare elements are
#: held against each other if there are more than RARE.
CHUNK, SETS_CHUNK, RARE = 2048, 65_536, 128
#: Words of sketches that are compared at once, and pairs that a task remembers. Bound memory only.
AT_ONCE, PAIRS = 1_000_000, 500_000
WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each window of k of the hashes h; of fewer, that of all."""
    if len(h) < k:
        return mix((h * _MULTIPLIERS[: len(h)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h)))
    n = len(h) - k + 1
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total += h[j : j + n] * _MULTIPLIERS[j]
    return mix(total)


class Shingler:
    """Sets of 64-bit hashes of the k-word shingles of texts, A-Z lower-cased."""

    def __init__(self, k: int = 5):
        if not 1 <= k <= len(_MULTIPLIERS):
            raise ValueError(f"shingles take 1 to {len(_MULTIPLIERS)} words")
        self.k, self.known = k, {}

    def words(self, text: str) -> list[bytes]:
        # bytes.lower() changes A-Z alone; bytes.split() cuts at the six white characters
        return text.encode("utf-8", "surrogatepass").lower().split()

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        got = list(map(known.get, words))
        if None in got:
            for i, x in enumerate(got):
                if x is None:
                    got[i] = known[words[i]] = xxhash.xxh3_64_intdigest(words[i])
        return np.array(got, dtype=np.uint64)

    def windows(self, words: list[bytes]) -> np.ndarray:
        """The hash of each window of k words; of fewer words, that of the whole sequence."""
        return joined(self.hashes(words), self.k) if words else np.zeros(0, dtype=np.uint64)

    def shingles(self, text: str | None) -> np.ndarray:
        """The distinct shingles, ascending."""
        return np.unique(self.windows(self.words(text or "")))


def digest(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def sketch(shingles: np.ndarray, least: int) -> np.ndarray:
    """The parities of 1 to 2 times as many bits as the set has shingles, 2 << least at least: shingles
    of short sets then seldom share a bit, and the screen by sketches is nearly exact."""
    bits = max(1 << len(shingles).bit_length(), 2 << least)
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def crowded(rows: DataFrame, parts: int) -> DataFrame:
    """(sig, node, center, many) of signatures that two or more nodes share, from (sig, node); materialized.

    One exchange of the rows. The centre is the bucket's smallest node, many its number of nodes.
    Of signatures with the same nodes one stays.
    """
    bucket = Window.partitionBy("sig")
    seen = rows.repartition(parts, "sig").select("sig", "node", F.min("node").over(bucket).alias("center"), F.max("node").over(bucket).alias("_last"))
    shared = materialize(seen.where("center <> _last").select("sig", "node", "center").distinct())
    same = shared.groupBy("sig").agg(F.count("*").alias("many"), F.bit_xor(F.xxhash64("node")).alias("_all"), F.min("center").alias("center"))
    kept = same.groupBy("center", "many", "_all").agg(F.min("sig").alias("sig")).select("sig", "many")
    return materialize(shared.join(kept, "sig"))


def shared(rows: DataFrame) -> DataFrame:
    """As crowded(), from distinct (sig, node) that are cheap to read twice: signatures are counted by an aggregate that
    tasks combine, and those that nodes share are joined to the rows, so no task needs all rows of a signature."""
    told = rows.groupBy("sig").agg(F.count("*").alias("many"), F.min("node").alias("center"), F.bit_xor(F.xxhash64("node")).alias("_all")).where("many > 1")
    kept = materialize(told.groupBy("center", "many", "_all").agg(F.min("sig").alias("sig")).select("sig", "center", "many"))
    return materialize(rows.join(bounded(kept), "sig").select("sig", "node", "center", "many"))


def bounded(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """df, of a few numbers a row, to be broadcast if it is counted to have so many rows at most; else joined as
    the planner will."""
    return F.broadcast(df) if df.count() <= rows else df


def tasks(rows: int) -> int:
    """How many tasks take so many narrow rows. Each task that feeds an exchange writes files of
    its own, so hundreds for a few rows cost more disk than the rows."""
    return max(4, -(-rows // ROWS_A_TASK))


def allowed(apart: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m that differ in apart elements, or more, can be percent alike."""
    return (apart * (100 + percent) <= (n + m) * (100 - percent)) & (n * 100 >= m * percent) & (m * 100 >= n * percent)


def _apart(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(some[:, None] ^ others[None]).sum(axis=2, dtype=np.int64)


def folded(sketches: list[np.ndarray]) -> np.ndarray:
    """The sketches as rows of the narrowest one's width: half laid on half, which keeps the bound."""
    width = min(map(len, sketches))
    out = np.empty((len(sketches), width), dtype=np.uint64)
    for row, x in zip(out, sketches, strict=True):
        while len(x) > width:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        row[:] = x
    return out


class Sets:
    """Small sets, to be compared exactly."""

    def __init__(self, at: np.ndarray, flat: np.ndarray):
        self.sizes = np.diff(at)
        self.flat = flat[at[0] : at[-1]]
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.there = np.arange(self.sizes.max(initial=0)) < self.sizes[:, None]
        self.grid = np.zeros(self.there.shape, dtype=np.uint64)
        self.grid[self.there] = self.flat

    def sketches(self, bits: int = 512) -> np.ndarray:
        """Parity sketches, as rows of so many bits."""
        odd = np.bincount(self.owner * bits + (self.flat & np.uint64(bits - 1)).astype(np.int64), minlength=len(self.sizes) * bits) & 1
        return np.packbits(odd.astype(np.uint8).reshape(len(self.sizes), bits), axis=1).view(np.uint64)

    def alike(self, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        """Whether the sets x are percent alike to the sets y, pair by pair."""
        out, step = np.zeros(len(x), dtype=bool), max(1, AT_ONCE // max(1, self.grid.shape[1]) ** 2)
        for at in range(0, len(x), step):
            p, q = x[at : at + step], y[at : at + step]
            both = ((self.grid[p][:, :, None] == self.grid[q][:, None]) & self.there[p][:, :, None] & self.there[q][:, None]).sum(axis=(1, 2))
            out[at : at + step] = both * 100 >= (self.sizes[p] + self.sizes[q] - both) * percent
        return out

    def rare_groups(self, start: int, stop: int, percent: int) -> Iterator[np.ndarray]:
        """The sets start to stop in groups that share one of the rarest elements of each, as counted there: so many that
        fewer are left than a link must share, so no link is outside a group."""
        here = (self.owner >= start) & (self.owner < stop)
        owner, (_, which, counts) = self.owner[here], np.unique(self.flat[here], return_inverse=True, return_counts=True)
        order = np.lexsort((which, counts[which], owner))
        owner, which = owner[order], which[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        few = place < self.sizes[owner] + (-self.sizes[owner] * percent) // 100 + 1
        order = np.lexsort((owner[few], which[few]))
        owner, which = owner[few][order], which[few][order]
        yield from (g for g in np.split(owner, np.flatnonzero(which[1:] != which[:-1]) + 1) if len(g) > 1)


def spanning(bits: np.ndarray, n: np.ndarray, percent: int, sure: Callable | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the plausible links among rows of bits, each from a row that is reached to a new one.
    Only of those that are sure, if that can be told."""
    out, reached, left = [], np.array([0]), np.arange(1, len(n))
    while len(left):
        if not len(reached):
            reached, left = left[:1], left[1:]
            continue
        step = max(1, AT_ONCE // (len(left) * bits.shape[1]))
        now, reached = reached[:step], reached[step:]
        ok = allowed(_apart(bits[now], bits[left]), n[now][:, None], n[left][None], percent)
        first = ok.argmax(axis=0)
        while sure:  # the first that is not sure gives way to the next
            asked = np.flatnonzero(ok[first, np.arange(len(left))])
            wrong = asked[~sure(now[first[asked]], left[asked])]
            if not len(wrong):
                break
            ok[first[wrong], wrong] = False
            first[wrong] = ok[:, wrong].argmax(axis=0)
        hit = ok.any(axis=0)
        if hit.any():
            new = left[hit]
            out += zip(now[first[hit]].tolist(), new.tolist(), strict=True)
            reached, left = np.concatenate([reached, new]), left[~hit]
    return out


def forest(bits: np.ndarray, n: np.ndarray, sets: Sets, start: int, stop: int, percent: int) -> list[tuple[int, int]]:
    """spanning() of the sets start to stop, group of rare elements by group; sets that are joined are joined once."""
    root, out = list(range(stop - start)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for g in sets.rare_groups(start, stop, percent):
        if len({find(x) for x in (g - start).tolist()}) > 1:
            for x, y in spanning(bits[g], n[g], percent, lambda x, y, g=g: sets.alike(g[x], g[y], percent)):
                x, y = int(g[x]) - start, int(g[y]) - start
                if find(x) != find(y):
                    root[find(x)] = find(y)
                    out.append((x, y))
    return out


def across(bits: np.ndarray, n: np.ndarray, part: np.ndarray, visits: np.ndarray, percent: int, sure: Callable | None = None) -> Iterator[tuple[int, int]]:
    """All plausible links between different parts, but those between two visitors. Only those that are sure, if that
    can be told."""
    names, which, counts = np.unique(part, return_inverse=True, return_counts=True)
    few = np.flatnonzero(which != counts.argmax())
    step = max(1, AT_ONCE // bits.size)
    for at in range(0, len(few), step):
        now = few[at : at + step]
        ok = allowed(_apart(bits[now], bits), n[now][:, None], n[None], percent)
        ok &= (part[now][:, None] != part[None]) & ~(visits[now][:, None] & visits[None])
        x, y = np.nonzero(ok)
        if sure:
            told = sure(now[x], y)
            x, y = x[told], y[told]
        yield from zip(now[x].tolist(), y.tolist(), strict=True)


def buckets(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of whole buckets, from batches sorted by keys."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if not held.num_rows:
            continue
        last = int(np.flatnonzero(np.logical_and.reduce([(x := held[k].to_numpy()) == x[-1] for k in keys]))[0])
        if last:
            yield held.slice(0, last).combine_chunks()
            held = held.slice(last).combine_chunks()
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def searched(rows: DataFrame, percent: int, parts: int, every: bool, exact: bool) -> DataFrame:
    """(sig, a, b) from (sig, chunk, node, n_shingles, sketch, part, visits): each bucket's spanning forest of plausible
    links, or every plausible link across parts, each once for a task at least. With exact, sketches are sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[int, int]] = set()

        def found(table: pa.Table) -> pa.RecordBatch:
            sig, chunk, node, n, part, visits = (table[c].to_numpy() for c in ("sig", "chunk", "node", "n_shingles", "part", "visits"))
            sketches, out = table["sketch"].combine_chunks(), []
            at, flat = sketches.offsets.to_numpy(), sketches.values.to_numpy().view(np.uint64)
            starts = None
            ends = np.append(np.flatnonzero((sig[1:] != sig[:-1]) | (chunk[1:] != chunk[:-1])) + 1, len(sig))
            if exact:
                sets = Sets(at, flat)
                screens = sets.sketches()
                if not every:  # most buckets are pairs
                    first = np.append(0, ends[:-1])
                    pair = first[ends - first == 2]
                    told_ = pair[sets.alike(pair, pair + 1, percent)]
                    out += zip(sig[told_].tolist(), node[told_].tolist(), node[told_ + 1].tolist(), strict=True)
                    ends = ends[ends - first != 2]
                    starts = first[~np.isin(first, pair)]
            for start, stop in zip((np.append(0, ends[:-1]) if starts is None else starts).tolist(), ends.tolist(), strict=True):
                here = slice(start, stop)
                bits = screens[here] if exact else folded([flat[at[i] : at[i + 1]] for i in range(start, stop)])
                sure = (lambda x, y, start=start: sets.alike(start + x, start + y, percent)) if exact else None
                if every:
                    pairs = across(bits, n[here], part[here], visits[here], percent, sure)
                elif exact and stop - start > RARE:
                    pairs = forest(screens, n, sets, start, stop, percent)
                else:
                    pairs = spanning(bits, n[here], percent, sure)
                for x, y in pairs:
                    a, b = int(node[start + x]), int(node[start + y])
                    a, b = min(a, b), max(a, b)
                    if every:
                        if (a, b) in told:
                            continue
                        if len(told) > PAIRS:
                            told.clear()
                        told.add((a, b))
                    out.append((int(sig[start]), a, b))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*out, strict=True)) or [()] * 3)], ["sig", "a", "b"])

        yield from map(found, buckets(batches, ("sig", "chunk")))

    dealt = rows.select("sig", "chunk", "node", "n_shingles", "sketch", "part", "visits").repartition(parts, "sig", "chunk").sortWithinPartitions("sig", "chunk", "node")
    return dealt.mapInArrow(run, "sig long, a long, b long")


def link(members: DataFrame, fetch: Callable[[DataFrame], DataFrame] | None, info: DataFrame, percent: int, chunk: int = CHUNK) -> DataFrame:
    """(node, component) of all nodes with links, from members (sig, node, center, many).

    fetch(nodes) gives (node, shingles) of these nodes, info (node, n_shingles, sketch) of all. Without fetch, the
    sketches are the sets themselves, and what they allow is exact.
    """
    exact = fetch is None
    parts = partitions(members.sparkSession)
    chunks = F.ceil(F.col("many") / chunk).cast("int")
    own = F.pmod(F.xxhash64("node"), F.greatest(chunks, F.lit(1))).cast("int")
    dealt = members.withColumn("chunk", F.explode(F.when(F.col("node") == F.col("center"), F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(own))))
    rows = dealt.join(info, "node").withColumns({"part": F.lit(0).cast("long"), "visits": F.lit(False)})
    edges = materialize(searched(rows, percent, parts, False, exact))
    pairs = edges.select("a", "b").distinct()
    part = materialize(connected_components(verified(pairs, fetch, percent)))

    one, two = (part.select(F.col("node").alias(x), F.col("component").alias(f"_{x}")) for x in "ab")
    named = edges.join(one, "a", "left").join(two, "b", "left").where(F.coalesce("_a", "a") != F.coalesce("_b", "b"))
    failed = named.select("sig").unionByName(members.where(F.col("many") > chunk).select("sig")).distinct()
    again = members.join(failed, "sig").join(part, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    again = materialize(again)
    mixed = again.groupBy("sig", "part").agg(F.count("*").alias("n")).groupBy("sig").agg(F.max_by("part", F.struct("n", "part")).alias("most"), F.count("*").alias("parts")).where("parts > 1").select("sig", "most")
    if mixed.isEmpty():
        return part
    # the nodes outside a large bucket's largest part visit all of its chunks
    others = F.array_except(F.sequence(F.lit(0), chunks - 1), F.array(own))
    placed = again.join(mixed, "sig").withColumn("_home", F.array(F.struct(own.alias("chunk"), F.lit(False).alias("visits"))))
    abroad = F.when(F.col("part") != F.col("most"), F.transform(others, lambda c: F.struct(c.alias("chunk"), F.lit(True).alias("visits"))))
    placed = placed.withColumn("_at", F.explode(F.concat("_home", F.coalesce(abroad, F.array().cast("array<struct<chunk:int,visits:boolean>>")))))
    rows = placed.select("sig", "node", "part", "_at.chunk", "_at.visits").join(info, "node")
    late = searched(rows, percent, parts, True, exact).select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
    fresh = verified(late, fetch, percent)
    if fresh.isEmpty():
        return part
    return materialize(connected_components(part.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(fresh)))


def verified(pairs: DataFrame, fetch: Callable[[DataFrame], DataFrame] | None, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of percent or more; all, without fetch. Materialized."""
    pairs = materialize(pairs)
    if fetch is None or pairs.isEmpty():
        return pairs
    nodes = materialize(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    return materialize(alike(pairs, fetch(nodes), percent))


def alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets, (node, shingles), have a Jaccard similarity of percent or more."""
    a, b = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_a")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    union = F.size("_a") + F.size("_b") - both
    return pairs.join(a, "a").join(b, "b").where(both * 100 >= union * percent).select("a", "b")


def connected_components(edges: DataFrame, few: int | None = None) -> DataFrame:
    """(node, component) from edges (a, b): the smallest node that links reach. few tasks take the edges.

    Alternates large stars and small stars until every edge points at its component's
    smallest node, a few rounds even for long chains. All on the executors; a round's
    edges are checkpointed, and only their count and checksum come to the driver.
    """
    few = few or tasks(edges.count())
    larger = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).coalesce(few).distinct().coalesce(few)
    now, mark = materialize(larger(edges)), None
    while True:
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == mark or not state["n"]:
            break
        mark = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = larger(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(floor, "a")
        now = materialize(larger(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(floor.select("a", F.col("m").alias("b")))))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
