"""Dictionaries as flat tries: built by tasks, kept in the shared folder, walked by whole batches.

A trie is one sorted array of edges, (node << 21 | code point); the edge at index i leads to node i + 1, as
levels follow one another and each is sorted. A walk moves all places of a batch of
texts one character on with one binary search, so texts cost their length times the depth that their
characters reach, and nothing for the number of terms but its logarithm.
"""
from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.operators.shared import new_path, read_rows, written

#: Terms of a shard aimed at (a shard holds whole first characters), shards at most.
SHARD, SHARDS = 200_000, 1_024
#: Characters of texts that are walked at once.
SLICE = 1 << 20
#: Bytes of opened shards that a worker keeps.
HELD = 1 << 29
_BITS = 21


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, first place of each and one past the last)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)))


def slices(sizes: Iterable) -> Iterator[tuple[int, int]]:
    """(first, one past the last) of consecutive texts that have SLICE characters together, or of one longer text: a walk
    holds arrays over all characters that it is given, so batches of long texts go in slices."""
    start, held, n = 0, 0, 0
    for n, size in enumerate(sizes, 1):
        size = int(size.as_py() or 0) if isinstance(size, pa.Scalar) else size
        if held and held + size > SLICE:
            yield start, n - 1
            start, held = n - 1, 0
        held += size
    if n > start:
        yield start, n


class Trie:
    """Terms with their values; several entries may share a term."""

    def __init__(self, edges: np.ndarray, first: np.ndarray, count: np.ndarray, rank: np.ndarray, keys: list[str], values: list[str]):
        self.edges, self.first, self.count, self.rank, self.keys, self.values = edges, first, count, rank, keys, values
        self.size = np.fromiter(map(len, keys), np.int64, len(keys))
        top = int(np.searchsorted(edges, 1 << _BITS))
        self.root = np.full(0x110000, -1, np.int32)  # first characters are looked up directly
        self.root[edges[:top]] = np.arange(1, top + 1)

    @staticmethod
    def built(keys: list[str], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(edges, first entry and number of entries of each node, order of the entries by node) of terms that are not empty."""
        cps, starts = code_points(keys)
        size, at = np.diff(starts), np.zeros(len(keys), np.int64)
        levels, base, active = [], 0, np.arange(len(keys))
        for d in range(int(size.max(initial=0))):
            active = active[size[active] > d]
            level, child = np.unique((at[active] << _BITS) | cps[starts[active] + d], return_inverse=True)
            at[active] = base + 1 + child
            levels.append(level)
            base += len(level)
        order = np.lexsort((rank, at))
        count = np.bincount(at, minlength=base + 1)
        return np.concatenate(levels) if levels else np.empty(0, np.int64), np.cumsum(count) - count, count, order

    def walk(self, cps: np.ndarray, stop: np.ndarray, at: np.ndarray, depth: int | None = None):
        """(places, nodes) of each length from 1, as far as texts (ending at stop[place]) and terms go."""
        node = self.root[cps[at]].astype(np.int64)
        at, node, d = at[node >= 0], node[node >= 0], 1
        while len(at):
            yield d, at, node
            if d == depth:
                return
            go = at + d < stop[at]
            at, node = at[go], node[go]
            key = (node << _BITS) | cps[at + d]
            found = np.searchsorted(self.edges, key)
            go = (found < len(self.edges)) & (self.edges[np.minimum(found, len(self.edges) - 1)] == key)
            at, node, d = at[go], found[go] + 1, d + 1

    @property
    def nbytes(self) -> int:
        return self.edges.nbytes + self.first.nbytes + self.count.nbytes + self.root.nbytes + 120 * len(self.keys)


_open: OrderedDict[tuple[str, int], Trie] = OrderedDict()


@dataclass(frozen=True)
class Dictionary:
    """A published dictionary, as tasks open it: shards are read when a text needs them, and the longest
    unused ones are dropped once they hold more than HELD bytes."""

    path: str
    shards: int
    present: frozenset[int]

    def shard(self, n: int) -> Trie:
        if (found := _open.get((self.path, n))) is None:
            row = read_rows(f"{self.path}/shard={n}").to_pylist()[0]
            found = Trie(np.frombuffer(row["edges"], np.int64), np.frombuffer(row["first"], np.int64), np.frombuffer(row["count"], np.int64), np.frombuffer(row["ranks"], np.int64), row["keys"], row["vals"])
            _open[self.path, n] = found
            while len(_open) > 1 and sum(t.nbytes for t in _open.values()) > HELD:
                _open.popitem(last=False)
        _open.move_to_end((self.path, n))
        return found

    def tries(self, cps: np.ndarray, at: np.ndarray):
        """The shards that places need, with their places."""
        if self.shards == 1:
            if self.present:
                yield self.shard(0), at
            return
        of = cps[at] % self.shards
        for n in np.unique(of).tolist():
            if n in self.present:
                yield self.shard(n), at[of == n]

    def matches(self, texts: list[str]):
        """Yields (trie, text number, place in it, entry): every place of every term."""
        cps, starts = code_points(texts)
        if not len(cps):
            return
        row = np.repeat(np.arange(len(texts)), np.diff(starts))
        stop = starts[1:][row]
        for trie, places in self.tries(cps, np.arange(len(cps))):
            held = [(at[hit], node[hit]) for _, at, node in trie.walk(cps, stop, places) if (hit := trie.count[node] > 0).any()]
            if held:
                at, node = (np.concatenate(c) for c in zip(*held))
                n = trie.count[node]
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at, entry = np.repeat(at, n), np.repeat(trie.first[node], n) + within
                yield trie, row[at], at - starts[row[at]], entry

    def longest(self, cps: np.ndarray, stop: np.ndarray, places: np.ndarray, depth: int) -> tuple[np.ndarray, dict[int, str]]:
        """(length of the longest term at each place of the batch, 0 for none; values by place)."""
        size, values = np.zeros(len(cps), np.int64), {}
        for trie, at in self.tries(cps, places):
            entry = np.full(len(cps), -1, np.int64)
            for d, here, node in trie.walk(cps, stop, at, depth):
                hit = trie.count[node] > 0
                size[here[hit]], entry[here[hit]] = d, trie.first[node[hit]]
            found = np.flatnonzero(entry >= 0)
            values.update(zip(found.tolist(), map(trie.values.__getitem__, entry[found].tolist())))
        return size, values


def publish(entries: DataFrame, *order: Column) -> Dictionary:
    """Entries (key, value), ranked by `order`, as a dictionary in the shared folder; empty and null keys go.

    Nothing passes through the driver: a task a shard builds its part. A shard holds the terms that begin with its
    characters; one character's terms are never split.
    """
    held = entries.filter("key <> ''").select("key", F.coalesce("value", F.lit("")).alias("value"), *[o.alias(f"o{i}") for i, o in enumerate(order)])
    held = written(held, "entries")
    n, path = held.count(), new_path(entries.sparkSession, "dictionary")
    if not n:
        return Dictionary(path, 1, frozenset())
    # ids that follow the order, without numbering all rows in one task
    ranked = held.orderBy(*[f"o{i}" for i in range(len(order))], "key", "value").withColumn("rank", F.monotonically_increasing_id())
    shards = min(SHARDS, -(-n // SHARD))

    def build(table: pa.Table) -> pa.Table:
        keys, values, rank = table["key"].to_pylist(), table["value"].to_pylist(), table["rank"].to_numpy()
        edges, first, count, by = Trie.built(keys, rank)
        row = [table["shard"][0].as_py(), edges.tobytes(), first.tobytes(), count.tobytes(), rank[by].tobytes(), [keys[i] for i in by], [values[i] for i in by]]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, _ROW)], schema=_ROW)

    built = ranked.withColumn("shard", F.pmod(F.ascii("key"), F.lit(shards))).select("shard", "key", "value", "rank").groupBy("shard").applyInArrow(build, "shard int, edges binary, first binary, count binary, ranks binary, keys array<string>, vals array<string>")
    built.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    present = held.select(F.pmod(F.ascii("key"), F.lit(shards)).alias("shard")).distinct().collect()
    return Dictionary(path, shards, frozenset(r.shard for r in present))


_TEXTS = pa.list_(pa.field("element", pa.string()))
_ROW = pa.schema([("shard", pa.int32()), ("edges", pa.binary()), ("first", pa.binary()), ("count", pa.binary()), ("ranks", pa.binary()), ("keys", _TEXTS), ("vals", _TEXTS)])


def counted(dictionary: Dictionary, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(text number, term, number of its places from left to right without overlap)."""
    rows, terms, counts = [], [], []
    for trie, row, at, entry in dictionary.matches(texts):
        order = np.lexsort((at, entry, row))
        row, at, entry = row[order], at[order], entry[order]
        new = np.append(True, (np.diff(row) != 0) | (np.diff(entry) != 0))
        begins, n = np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(row)))
        tight = np.flatnonzero(~new[1:] & (np.diff(at) < trie.size[entry[1:]])) + 1
        for g in np.unique(np.searchsorted(begins, tight, "right") - 1).tolist():  # terms that overlap themselves
            free = -1
            n[g] = 0
            for p in at[begins[g] : begins[g + 1] if g + 1 < len(begins) else len(at)].tolist():
                if p >= free:
                    n[g], free = n[g] + 1, p + trie.size[entry[begins[g]]]
        rows.append(row[begins])
        terms += map(trie.keys.__getitem__, entry[begins].tolist())
        counts.append(n)
    empty = np.empty(0, np.int64)
    return (np.concatenate(rows) if rows else empty), terms, (np.concatenate(counts) if counts else empty)


def replaced(dictionary: Dictionary, texts: list[str], limit: int | None = None) -> list[str]:
    """Texts with each key replaced by its value in the order of rank, each on the result so far, at most `limit` keys that occur.

    All texts go on together: each round applies the next key that its text holds and looks the changed
    text up again, as a value may bring keys that were not there. A text takes a round a key that it
    holds, not one a key of the dictionary.
    """
    out, last = list(texts), np.full(len(texts), -1, np.int64)
    going, rounds = np.flatnonzero(np.fromiter((bool(t) for t in texts), bool, len(texts))), 0
    while len(going) and (limit is None or rounds < limit):
        now = [out[i] for i in going]
        best, pair = np.full(len(going), np.iinfo(np.int64).max), {}
        for trie, row, _, entry in dictionary.matches(now):
            rank = trie.rank[entry]
            later = rank > last[going[row]]
            row, rank, entry = row[later], rank[later], entry[later]
            order = np.lexsort((rank, row))
            row, rank, entry = row[order], rank[order], entry[order]
            lead = np.append(True, np.diff(row) != 0)[: len(row)]
            for r, k, e in zip(row[lead].tolist(), rank[lead].tolist(), entry[lead].tolist()):
                if k < best[r]:
                    best[r], pair[r] = k, (trie.keys[e], trie.values[e])
        for r, (key, value) in pair.items():
            out[going[r]] = now[r].replace(key, value)
        hit = np.fromiter(sorted(pair), np.int64, len(pair))
        last[going[hit]] = best[hit]
        going, rounds = going[hit], rounds + 1
    return out
