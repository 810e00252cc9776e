"""Exact near-duplicate embeddings by dual traversal of cover trees."""
from __future__ import annotations

import math
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.common import mix64, staged
from cuelake.llm.minhash import components

#: Vectors of a leaf at most, children of a cell at most, sampled vectors a child.
LEAF, FAN, SAMPLE = 8_192, 64, 8
#: Radii of the levels inside a leaf; those of the cells above halve in the same way from 1.
RADII = (1.0, 0.5, 0.25, 0.125, 0.0625)
#: Slack of distances in the bounds (rounding of a cosine near 1 is below 1e-7 there), and of cosines that are decided exactly.
SLACK, EXACT = 1e-6, 1e-12
#: What a cosine in single precision may be off, at most.
ROUND = 2e-5
#: Entries of a block of cosines; work that a level may take for that of the level below it alone.
BLOCK, WORTH = 1 << 20, 0.8
#: What a pair of nodes that is not dropped costs, in cosines of a block; nodes of a level whose pairs are tried for that.
OPENED, TRIED = 60, 128
#: Components that a block may compare first; what a block takes besides them and what a pair that goes on takes, in components.
LEADS, BESIDE, ONWARD = (8, 12, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256), 6, 10_000
#: Links that a block may hold one by one, and the share of a block from which they are counted as a matrix.
SPARSE, DENSE = 4_096, 1 / 16
#: Cells that are broadcast at most.
FEW_CELLS = 200_000
#: Tiles that a table has at least, if it has so many cells; components of a vector times cells of a tile, at most.
TILES, TILE = 32, 512


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; components are divided by the largest first, which keeps squares in range."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def reaches(x: np.ndarray, y: np.ndarray, cosine: Fraction) -> bool:
    """cos(x, y) >= cosine > 0, in exact arithmetic."""
    a, b = [Fraction(v) for v in x.tolist()], [Fraction(v) for v in y.tolist()]
    dot = sum(p * q for p, q in zip(a, b))
    return dot > 0 and dot * dot >= cosine * cosine * sum(p * p for p in a) * sum(q * q for q in b)


def held(mask: np.ndarray) -> np.ndarray:
    """np.flatnonzero of a mask that holds few, by eight entries at once; its length divides by eight."""
    some = np.flatnonzero(mask.view(np.uint64) != 0)
    return (some[:, None] * 8 + np.arange(8))[mask.reshape(-1, 8)[some]]


def net(u: np.ndarray, rows: np.ndarray, radius: float, most: int | None = None) -> list[np.ndarray]:
    """Groups of rows, each led by a centre that holds the others within radius; centres are further
    apart than radius. With `most`, only the centres found first, and groups may miss rows."""
    least, groups, rest = 1 - radius * radius / 2, [], rows
    while len(rest):
        block = rest[:256]
        near, picks, covered = u[block] @ u[block].T >= least, [], np.zeros(len(block), bool)
        for i in range(len(block)):
            if not covered[i]:
                picks.append(i)
                covered |= near[i]
        centres, best, cos = block[picks], np.empty(len(rest), np.int64), np.empty(len(rest))
        step = max(1, BLOCK // len(picks))
        for s in range(0, len(rest), step):
            c = u[rest[s : s + step]] @ u[centres].T
            best[s : s + step] = c.argmax(axis=1)
            cos[s : s + step] = c[np.arange(len(c)), best[s : s + step]]
        best[picks], cos[picks] = np.arange(len(picks)), 2.0
        held = cos >= least
        order = np.lexsort((-cos[held], best[held]))
        member, of = rest[held][order], best[held][order]
        groups += np.split(member, np.flatnonzero(np.diff(of)) + 1)
        if most and len(groups) >= most:
            return groups[:most]
        rest = rest[~held]
    return groups


class Tree:
    """Nested levels over unit vectors: a node is a run of the vectors in tree order, its centre the
    first of the run, its radius the largest distance from it that the run holds."""

    def __init__(self, u: np.ndarray, starts: list[np.ndarray], radii: list[np.ndarray]):
        self.u, self.starts, self.radii = u, starts, radii
        self.short, self.leads = u.astype(np.float32), {}
        self.ends = [np.append(s[1:], len(u)) for s in starts]

    def lead(self, k: int) -> np.ndarray:
        """The first k components and the length of the others, in single precision: products of two such
        rows are no less than the cosine."""
        if k >= self.u.shape[1]:
            return self.short
        if k not in self.leads:
            rest = np.sqrt(np.einsum("ij,ij->i", self.u[:, k:], self.u[:, k:]))
            self.leads[k] = np.column_stack((self.short[:, :k], rest.astype(np.float32)))
        return self.leads[k]

    @classmethod
    def grown(cls, u: np.ndarray, far: float = 0.5) -> tuple[Tree, np.ndarray]:
        """(the tree, the order in which it holds the rows of u); far is the distance of a link at most."""
        groups, radii, radii_of, sizes = [np.arange(len(u))], np.array([2.0]), [], []
        for r in RADII:
            finer, found = [], []
            for g, radius in zip(groups, radii):
                parts = net(u, g, r) if radius > r else [g]
                finer += parts
                found += [radius] if len(parts) == 1 and radius <= r else [cls._radius(u, p) for p in parts]
            groups, radii = finer, np.array(found)
            sizes.append(np.array([len(g) for g in groups]))
            radii_of.append(radii)
        order = np.concatenate(groups)
        u, starts = u[order], [np.concatenate(([0], np.cumsum(n)[:-1])) for n in sizes]
        # runs of a level lie within runs of the level above, so the order of the last level serves all;
        # a level that joins few nodes of the one below, or whose nodes are too wide to be dropped, costs more than it saves
        kept = [len(RADII) - 1]
        for level in range(len(RADII) - 2, -1, -1):
            held, finer = starts[level], starts[kept[0]]
            if len(held) <= WORTH * len(finer):
                below = np.diff(np.append(np.searchsorted(finer, held), len(finer)))
                if cls._work(u, held, radii_of[level], far, below) <= WORTH * cls._work(u, finer, radii_of[kept[0]], far):
                    kept.insert(0, level)
        return cls(u, [starts[k] for k in kept], [radii_of[k] for k in kept]), order

    @staticmethod
    def _work(u: np.ndarray, starts: np.ndarray, radii: np.ndarray, far: float, below: np.ndarray | None = None) -> float:
        """Cosines that all pairs of a level cost, by those of TRIED of its nodes: every pair, OPENED
        for each that is not dropped and for each pair of nodes below one that is opened."""
        some = np.linspace(0, len(starts) - 1, min(len(starts), TRIED)).astype(np.int64)
        d, r = np.sqrt(np.maximum(0, 2 - 2 * (u[starts[some]] @ u[starts].T))), radii[some][:, None] + radii
        work = d.size + OPENED * float((d - r <= far).sum())
        if below is not None:
            work += OPENED * float((((d - r <= far) & (d + r > far)) * np.multiply.outer(below[some], below)).sum())
        return work * len(starts) / len(some)

    @staticmethod
    def _radius(u: np.ndarray, rows: np.ndarray) -> float:
        return 0.0 if len(rows) == 1 else math.sqrt(max(0.0, 2 - 2 * float((u[rows] @ u[rows[0]]).min()))) + SLACK / 10

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last node of the next level in each node."""
        finer = self.starts[level + 1]
        return np.searchsorted(finer, self.starts[level][node]), np.searchsorted(finer, self.ends[level][node])


class Links:
    """Numbers of linked vectors and the components that links form, over the vectors of one or two trees."""

    def __init__(self, weights: np.ndarray):
        n = len(weights)
        self.weights, self.total = weights, np.concatenate(([0], np.cumsum(weights)))
        self.count, self.runs, self.joined = np.zeros(n, np.int64), np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        self.label = np.arange(n)

    def unite(self, p: np.ndarray, q: np.ndarray) -> None:
        while True:
            a, b = self.label[p], self.label[q]
            apart = a != b
            if not apart.any():
                return
            p, q, a, b = p[apart], q[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (flat := self.label[self.label]).tobytes() != self.label.tobytes():
                self.label = flat

    def pairs(self, p: np.ndarray, q: np.ndarray) -> None:
        """Vectors p and q are linked, one by one."""
        self.count += np.bincount(p, self.weights[q], len(self.count)).astype(np.int64) + np.bincount(q, self.weights[p], len(self.count)).astype(np.int64)
        self.unite(p, q)

    def matrix(self, p: np.ndarray, q: np.ndarray, hit: np.ndarray) -> None:
        """Vectors p[i] and q[j] are linked where hit[i, j]; p holds a vector once, and so does q."""
        linked = hit.astype(np.float64)
        self.count[p] += (linked @ self.weights[q]).astype(np.int64)
        self.count[q] += (self.weights[p] @ linked).astype(np.int64)
        # one link a row and one a column join nearly all; the rest is where labels still differ
        rows, cols = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        self.unite(p[rows], q[hit[rows].argmax(axis=1)])
        self.unite(p[hit[:, cols].argmax(axis=0)], q[cols])
        i, j = np.nonzero(hit & (self.label[p][:, None] != self.label[q]))
        self.unite(p[i], q[j])

    def whole(self, s: np.ndarray, e: np.ndarray, t: np.ndarray, f: np.ndarray) -> None:
        """All of run s..e is linked with all of run t..f."""
        for a, b, x, y in ((s, e, t, f), (t, f, s, e)):
            held = self.total[y] - self.total[x]
            np.add.at(self.runs, a, held)
            np.add.at(self.runs, b, -held)
            np.add.at(self.joined, a, 1)
            np.add.at(self.joined, b - 1, -1)
        self.unite(s, t)

    def clique(self, s: np.ndarray, e: np.ndarray) -> None:
        """All vectors of run s..e are linked with each other; runs of one vector are not passed."""
        for a, b in zip(s.tolist(), e.tolist()):
            self.count[a:b] += self.total[b] - self.total[a] - self.weights[a:b]
            self.joined[a] += 1
            self.joined[b - 1] -= 1

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        """(linked vectors of each, the first vector of its component)."""
        beside = np.flatnonzero(np.cumsum(self.joined)[:-1] > 0)
        if len(beside):
            self.unite(beside, beside + 1)
        return self.count + np.cumsum(self.runs)[:-1], self.label


def traverse(a: Tree, b: Tree, x: np.ndarray, y: np.ndarray, weights: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links.close() for the vectors of a, then those of b (or those of a alone, if b is a).

    Node pairs of the first level are compared by their centres. A pair whose distance less both
    radii is over the limit holds no link; one whose distance plus both radii is within it
    holds nothing else and is counted as a whole; the rest is opened, level by level. Single vectors are
    decided by their cosine, those within EXACT of the limit in exact arithmetic on x and y.
    """
    own, far = a is b, math.sqrt(max(0.0, 2 - 2 * cosine))
    limit, shift = Fraction(str(cosine)), 0 if own else len(a.u)
    links = Links(weights)

    def single(i, j, c):
        near = np.abs(c - cosine) < EXACT
        hit = c >= cosine
        for k in np.flatnonzero(near):
            hit[k] = reaches(x[i[k]], y[j[k]], limit)
        if hit.any():
            links.pairs(i[hit], j[hit] + shift)

    def matrix(i, j, triangle):
        """single() for all vectors i with all vectors j (j after i alone, if triangle)."""
        c = a.u[i] @ b.u[j].T
        hit, sure = c >= cosine - EXACT, c >= cosine + EXACT
        if triangle:
            hit &= j > i[:, None]
            sure &= hit
        n = np.count_nonzero(hit)
        if n != np.count_nonzero(sure):
            for p, q in zip(*np.nonzero(hit & ~sure)):
                hit[p, q] = reaches(x[i[p]], y[j[q]], limit)
        if n > DENSE * hit.size:
            links.matrix(i, j + shift, hit)
        elif n:
            p, q = np.nonzero(hit)
            links.pairs(i[p], j[q] + shift)

    def settle(la, lb, i, j, c):
        """Node pairs (i, j) of levels la and lb with the cosines of their centres; gives those to open."""
        d, r = np.sqrt(np.maximum(0, 2 - 2 * c)), a.radii[la][i] + b.radii[lb][j]
        s, e, t, f = a.starts[la][i], a.ends[la][i], b.starts[lb][j], b.ends[lb][j]
        ones = (e - s == 1) & (f - t == 1)
        same = (s == t) if own else np.zeros(len(i), bool)
        if (pick := ones & ~same).any():
            single(s[pick], t[pick], c[pick])
        inside = ~ones & (d + r <= far - SLACK)
        if (pick := inside & ~same).any():
            links.whole(s[pick], e[pick], t[pick] + shift, f[pick] + shift)
        if (pick := inside & same).any():
            links.clique(s[pick], e[pick])
        more = ~ones & ~inside & (d - r <= far + SLACK)
        return i[more], j[more]

    def lowest(reach):
        """The cosines of centres that are `reach` apart, less the rounding of single precision."""
        return (1 - reach**2 / 2 - ROUND * max(1, a.u.shape[1] / 256)).astype(np.float32)

    def leading(la, lb, i, j):
        """How many components the pairs of node runs i and j are to be compared by first, from some of them."""
        width = a.u.shape[1]
        if len(i) * len(j) < BLOCK >> 2:
            return width
        i, j = (v[np.linspace(0, len(v) - 1, min(len(v), n)).astype(np.int64)] for v, n in ((i, 64), (j, 512)))
        left, right = a.starts[la][i], b.starts[lb][j]
        least = lowest(a.radii[la][i][:, None] + b.radii[lb][j] + far + SLACK)
        costs = {}
        for k in [n for n in LEADS if n < width] + [width]:
            costs[k] = k + BESIDE + ONWARD * float((a.lead(k)[left] @ b.lead(k)[right].T >= least).mean())
            if k + BESIDE > min(costs.values()):
                break
        return min(costs, key=costs.get)

    def dense(la, lb, i, j, marks, triangle):
        """Takes the pairs of single vectors off the marks of a block, if many of some rows and columns have one."""
        alone = b.radii[lb][j] == 0
        taken = marks & alone
        rows, cols = np.flatnonzero(taken.any(axis=1)), np.flatnonzero(taken.any(axis=0))
        if np.count_nonzero(taken) > DENSE * len(rows) * len(cols):
            matrix(a.starts[la][i[rows]], b.starts[lb][j[cols]], triangle)
            marks &= ~alone

    def block(la, lb, i, j, triangle):
        """All pairs of the node runs i and j (one run with itself, if triangle), by blocks of cosines.

        Bounds of the cosines are taken in single precision first, from as many leading components as
        pay; pairs whose bound is too low by ROUND are left out, the cosines of the others are taken.
        Single vectors have one bound for all.
        """
        k = leading(la, lb, i, j)
        alone, right, reach = a.radii[la][i] == 0, b.lead(k)[b.starts[lb][j]], b.radii[lb][j] + far + SLACK
        step = max(1, BLOCK // max(1, len(j)))
        cosines, enough = np.empty(step * len(j), np.float32), np.zeros(step * len(j) + 7, bool)
        for rows, flat in ((i[alone], True), (i[~alone], False)):
            left = a.lead(k)[a.starts[la][rows]]
            for s in range(0, len(rows), step):
                part = rows[s : s + step]
                first = np.searchsorted(j, part[0]) if triangle else 0
                cols, n = j[first:], len(part) * (len(j) - first)
                least = lowest(reach[first:] if flat else a.radii[la][part][:, None] + reach[first:])
                c = np.matmul(left[s : s + step], right[first:].T, out=cosines[:n].reshape(len(part), -1))
                marks = np.greater_equal(c, least, out=enough[:n].reshape(len(part), -1))
                enough[n : n + 7] = False
                if flat and np.count_nonzero(marks) > SPARSE:
                    dense(la, lb, part, cols, marks, triangle)
                at = held(enough[: -(-n // 8) * 8])
                for start in range(0, len(at), BLOCK >> 4):
                    cut = at[start : start + (BLOCK >> 4)]
                    p, q = part[cut // len(cols)], cols[cut % len(cols)]
                    if triangle:
                        p, q = p[q >= p], q[q >= p]
                    c = np.einsum("ij,ij->i", a.u[a.starts[la][p]], b.u[b.starts[lb][q]])
                    open_(la, lb, *settle(la, lb, p, q, c))

    def open_(la, lb, i, j):
        """Node pairs are replaced by the pairs of their children; a tree at its last level waits for the other."""
        if not len(i):
            return
        ends = la + 1 == len(a.starts), lb + 1 == len(b.starts)
        if all(ends):
            lows, highs, below, tops = a.starts[la][i], a.ends[la][i], b.starts[lb][j], b.ends[lb][j]
        else:
            lows, highs = (i, i + 1) if ends[0] else a.children(la, i)
            below, tops = (j, j + 1) if ends[1] else b.children(lb, j)
            la, lb = la + (not ends[0]), lb + (not ends[1])
        product = (highs - lows) * (tops - below)
        same = (i == j) if own else np.zeros(len(i), bool)
        large = (product > 4_096) | same
        for k in np.flatnonzero(large):
            left, right = np.arange(lows[k], highs[k]), np.arange(below[k], tops[k])
            if all(ends):
                points(left, right, bool(same[k]))
            else:
                block(la, lb, left, right, bool(same[k]))
        small = np.flatnonzero(~large)
        for cut in np.split(small, np.flatnonzero(np.diff(np.cumsum(product[small]) >> 15)) + 1) if len(small) else ():
            n, w = product[cut], (tops - below)[cut]
            at = np.repeat(np.arange(len(cut)), n)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            p, q = lows[cut][at] + within // w[at], below[cut][at] + within % w[at]
            if all(ends):
                single(p, q, np.einsum("ij,ij->i", a.u[p], b.u[q]))
            else:
                c = np.einsum("ij,ij->i", a.u[a.starts[la][p]], b.u[b.starts[lb][q]])
                open_(la, lb, *settle(la, lb, p, q, c))

    def points(left, right, triangle):
        step = max(1, BLOCK // max(1, len(right)))
        for s in range(0, len(left), step):
            matrix(left[s : s + step], right, triangle)

    block(0, 0, np.arange(len(a.starts[0])), np.arange(len(b.starts[0])), own)
    return links.close()


def _matrix(values: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _row(table: DataFrame) -> tuple[Column, Column]:
    """(the vector as doubles, whether it can link)."""
    x = F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0))
    ok = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("x", lambda v: v != 0)
    return x, F.coalesce(F.col("vec_id").isNotNull() & ok, F.lit(False))


def split(cells: DataFrame, sizes: DataFrame, depth: int, leaf: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """Rows of cells (k, mult, x, cell) that hold more than `leaf` vectors (sizes: cell, n), dealt to
    children: (k, mult, x, cell, parent, far) with the distance to the child's centre, and the centres (cell, centre).

    The centres are a net of a sample of the cell, SAMPLE vectors a child: the radius halves until the
    net has two centres or more. Where none does, the vectors lie on one spot and are dealt by
    number; so are cells without a sampled row, whose children have no centre. A cell of
    any size is dealt in groups of some `leaf` rows, each with a copy of the centres.
    """
    most = F.least(F.lit(fan), F.greatest(F.lit(2), F.ceil(F.col("n") * 1.5 / leaf))).cast("int")
    known = sizes.select("cell", "n", most.alias("fan"), F.ceil(F.col("n") / leaf).cast("int").alias("slots"))
    rows = cells.join(known.hint("broadcast" if sizes.count() <= FEW_CELLS else "merge"), "cell")
    mixed = F.xxhash64(F.lit(depth), "k")
    drawn = rows.filter(F.pmod(mixed, F.lit(1 << 40)) < F.lit(float(SAMPLE << 40)) * F.col("fan") / F.col("n"))

    def centres(table: pa.Table) -> pa.Table:
        table = table.sort_by("h")
        u, most = unit(_matrix(table["x"], table.num_rows)), table["fan"][0].as_py()
        radius, found = 1.0 / 2**depth, []
        while len(found) < 2 and radius > 1e-5:
            found = net(u, np.arange(len(u)), radius, most)
            radius /= 2
        lead = [g[0] for g in found] if len(found) > 1 else [0] * most
        n, one = len(lead), len(found) < 2
        return pa.table({"of": table["cell"].slice(0, 1).combine_chunks().take(pa.array([0] * n)), "slots": pa.array([table["slots"][0].as_py()] * n, pa.int32()), "c": pa.array(range(n), pa.int32()), "one": pa.array([one] * n), "centre": pa.array(u[lead].tolist(), pa.list_(pa.float64()))})

    made = drawn.select("cell", "fan", "slots", "x", mixed.alias("h")).groupBy("cell").applyInArrow(centres, "of string, slots int, c int, one boolean, centre array<double>")
    made = staged(made, "centres")

    def numbered(own: pa.Table, n: int) -> np.ndarray:
        # another hash at each depth: a cell dealt by number may be dealt by number again
        return (mix64(own["k"].to_numpy() + (depth << 40)) % np.uint64(n)).astype(np.int64)

    def deal(own: pa.Table, found: pa.Table) -> pa.Table:
        n = own.num_rows
        if not n:
            return DEALT.empty_table()
        found = found.sort_by("c")
        if found.num_rows:
            u, c = unit(_matrix(own["x"], n)), _matrix(found["centre"], found.num_rows)
            best = np.concatenate([(u[s : s + 4_096] @ c.T).argmax(axis=1) for s in range(0, n, 4_096)])
            if found["one"][0].as_py():
                best = numbered(own, len(c))
            far = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", u, c[best]))) + SLACK / 10
        else:
            best, far = numbered(own, own["fan"][0].as_py()), np.full(n, 2.0)
        name = own["cell"][0].as_py()
        return pa.Table.from_arrays([own["k"].combine_chunks(), own["mult"].combine_chunks(), own["x"].combine_chunks(), pa.array([f"{name}.{b}" for b in best]), own["cell"].combine_chunks(), pa.array(far)], schema=DEALT)

    left = rows.withColumn("g", F.pmod(F.xxhash64("k"), F.col("slots")).cast("int"))
    right = made.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    dealt = left.groupBy("cell", "g").cogroup(right.groupBy("of", "slot")).applyInArrow(deal, "k bigint, mult bigint, x array<double>, cell string, parent string, far double")
    return dealt, made.select(F.concat("of", F.lit("."), "c").alias("cell"), "centre")


DEALT = pa.schema([("k", pa.int64()), ("mult", pa.int64()), ("x", pa.list_(pa.field("element", pa.float64()))), ("cell", pa.string()), ("parent", pa.string()), ("far", pa.float64())])


def leaves(rows: DataFrame, far: float) -> DataFrame:
    """One row a cell of rows (cell, k, mult, x): its tree with the vectors in tree order, packed.

    Vectors are stored with 4 bytes a component where that loses nothing.
    """

    def grow(table: pa.Table) -> pa.Table:
        x = _matrix(table["x"], table.num_rows)
        tree, order = Tree.grown(unit(x), far)
        x = x[order]
        with np.errstate(over="ignore"):
            short = x.astype(np.float32)
        kept = short if (short == x).all() else x
        held = [table["cell"][0].as_py(), len(x), kept.tobytes(), table["k"].to_numpy()[order].tobytes(), table["mult"].to_numpy()[order].tobytes()]
        held += [[s.astype(np.int32).tobytes() for s in tree.starts], [r.tobytes() for r in tree.radii]]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(held, PACKED)], schema=PACKED)

    return rows.groupBy("cell").applyInArrow(grow, "cell string, n bigint, x binary, k binary, mult binary, starts array<binary>, radii array<binary>")


_BLOBS = pa.list_(pa.field("element", pa.binary()))
PACKED = pa.schema([("cell", pa.string()), ("n", pa.int64()), ("x", pa.binary()), ("k", pa.binary()), ("mult", pa.binary()), ("starts", _BLOBS), ("radii", _BLOBS)])


def _unpacked(row: dict) -> tuple[Tree, np.ndarray, np.ndarray, np.ndarray]:
    n = row["n"]
    k, mult = np.frombuffer(row["k"], np.int64), np.frombuffer(row["mult"], np.int64)
    width = int(row["cell"].split(".")[0])
    x = np.frombuffer(row["x"], np.float32 if len(row["x"]) == 4 * n * width else np.float64).reshape(n, width).astype(np.float64)
    return Tree(unit(x), [np.frombuffer(s, np.int32).astype(np.int64) for s in row["starts"]], [np.frombuffer(r) for r in row["radii"]]), x, k, mult


def node_pairs(nodes: DataFrame, far: float) -> DataFrame:
    """(a, b): leaf cells that may hold a link, a cell with itself included.

    The traversal above the leaves: pairs of cells are joined with their children, level by
    level from the roots, and those whose centres are further apart than both radii and the limit
    go before the next level.
    nodes: (cell, parent, centre, radius, leaf), the roots without parent.
    """
    nodes = nodes.select("cell", "parent", "centre", "radius", "leaf")
    below = nodes.filter("parent IS NOT NULL").unionByName(nodes.filter("leaf").withColumn("parent", F.col("cell")))
    below = staged(below, "children")
    side = lambda s: below.select(F.col("parent").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("cell", "centre", "radius", "leaf")]).hint("merge")
    cos = F.aggregate(F.zip_with("a_centre", "b_centre", lambda p, q: p * q), F.lit(0.0), lambda m, v: m + v)
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * cos)) > F.col("a_radius") + F.col("b_radius") + far + SLACK
    roots = nodes.filter("parent IS NULL").select(F.col("cell").alias("a"), F.col("cell").alias("b"), (~F.col("leaf")).alias("more"))
    found, pairs = [], roots
    while True:
        pairs = staged(pairs, "node-pairs")
        found.append(pairs.filter("NOT more").select("a", "b"))
        wider = pairs.filter("more")
        if wider.isEmpty():
            return reduce(DataFrame.unionByName, found)
        both = wider.join(side("a"), "a").join(side("b"), "b").filter("a <> b OR a_cell <= b_cell")
        both = both.filter((F.col("a_cell") == F.col("b_cell")) | ~F.coalesce(apart, F.lit(False)))
        pairs = both.select(F.col("a_cell").alias("a"), F.col("b_cell").alias("b"), (~(F.col("a_leaf") & F.col("b_leaf"))).alias("more"))


def tiled(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """(left, right, cell, others): the cells that each pair of tiles takes, and for a cell the others that
    it is to be compared with there. Every pair (a, b) is in one pair of tiles.

    A tile is a run of cells in the order of their names, so of neighbours: a cell is sent
    once for all cells of another tile, not once a pair. Tiles hold few cells where
    vectors are wide or cells are few, so that tasks stay small and many.
    """
    n = cells.count()
    at = cells.select("cell").repartitionByRange(1 + n // FEW_CELLS, "cell").sortWithinPartitions("cell").withColumn("at", F.monotonically_increasing_id())
    width = F.split("cell", r"\.")[0]
    size = F.greatest(F.lit(1), F.least(F.lit(n // TILES), F.floor(F.lit(TILE) / width.cast("int"))))
    at = staged(at.select("cell", F.struct(width.cast("int").alias("width"), F.floor(F.col("at") / size).alias("run")).alias("tile")), "tiles")
    side = lambda s: at.select(F.col("cell").alias(s), F.struct("tile", "cell").alias(f"{s}_at")).hint("broadcast" if n <= FEW_CELLS else "merge")
    both = pairs.join(side("a"), "a").join(side("b"), "b").select(F.least("a_at", "b_at").alias("p"), F.greatest("a_at", "b_at").alias("q"))
    ends = F.array(F.struct("p.cell", F.col("q.cell").alias("other")), F.struct("q.cell", F.lit(None).cast("string").alias("other")))
    both = both.select(F.col("p.tile").alias("left"), F.col("q.tile").alias("right"), F.explode(ends).alias("end"))
    return both.groupBy("left", "right", "end.cell").agg(F.collect_list("end.other").alias("others"))


def near_vectors(table: DataFrame, *, cosine: float = 0.9, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of table (vec_id, embedding): near-duplicate vectors.

    Two vectors are linked if their cosine is `cosine` or more (above 0, 1 at most), whatever their
    distance in the table. n_links counts the other vec_ids linked directly; component_id
    is the smallest vec_id reachable over links, itself included; kept is vec_id = component_id.

    Equal vectors become one class. Classes are dealt to cells, nested nets of centres with halving
    radii, until a cell has `leaf` classes at most; every cell holds a tree of finer levels. Pairs of
    cells, then pairs of nodes within them, are dropped by their covering radii or opened; no pair is
    lost and none is found that way alone (see traverse). A task holds two tiles of a few leaves each and returns
    a number and one edge a vector and leaf, whatever the number of links. Vectors without structure (all at
    right angles) leave all pairs of leaves, and work then grows with the square of the table.

    A row a distinct (vec_id, vector): repeated rows count once, a vec_id with several vectors
    has a row each. Vectors that are null, empty, zero or hold null or non-finite components, and
    rows without vec_id, link with nothing: n_links 0, component_id their vec_id, kept true. Vectors of
    unequal length are not compared. Other columns are dropped; an empty table gives an empty table.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    x, ok = _row(table)
    rows = table.select("vec_id", "embedding").withColumn("x", x).withColumn("ok", ok)
    tags = [F.when(F.col("ok"), F.xxhash64("x")).alias("t1"), F.when(F.col("ok"), F.xxhash64(F.lit(7), "x")).alias("t2")]
    rows = rows.select("vec_id", "x", "ok", *tags, F.when(~F.col("ok"), F.xxhash64("embedding")).alias("t0"))
    ids = rows.filter("ok").groupBy("t1", "t2", "vec_id").agg(F.first("x").alias("x"))
    classes = ids.groupBy("t1", "t2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("x").alias("x"))
    classes = staged(classes.withColumn("k", F.monotonically_increasing_id()), "classes")

    cells = classes.select("k", "mult", "x", F.size("x").cast("string").alias("cell"))
    sizes = staged(cells.groupBy("cell").agg(F.count("*").alias("n")), "sizes")
    nodes = [sizes.select("cell", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("array<double>").alias("centre"), F.lit(2.0).alias("radius"), (F.col("n") <= leaf).alias("leaf"))]
    settled, depth = [], 0
    while True:
        large = sizes.filter(F.col("n") > leaf)
        n_large = large.count()
        small = sizes.filter(F.col("n") <= leaf).select("cell")
        how = "broadcast" if sizes.count() <= FEW_CELLS else "merge"
        settled.append(cells.join(small.hint(how), "cell", "left_semi").select("cell", "k", "mult", "x"))
        if not n_large:
            break
        dealt, centres = split(cells, large, depth, leaf, fan)
        dealt = staged(dealt, "cells")
        cells = dealt.select("k", "mult", "x", "cell")
        sizes = staged(dealt.groupBy("cell", "parent").agg(F.count("*").alias("n"), F.max("far").alias("radius")), "sizes")
        nodes.append(sizes.join(centres.hint("merge"), "cell", "left").select("cell", "parent", "centre", "radius", (F.col("n") <= leaf).alias("leaf")))
        depth += 1
    far = math.sqrt(2 - 2 * cosine)
    packed = staged(leaves(reduce(DataFrame.unionByName, settled), far), "leaves", compression="none")
    pairs = node_pairs(reduce(DataFrame.unionByName, nodes), far)

    def tile_pair(table: pa.Table) -> pa.Table:
        held = {r["cell"]: _unpacked(r) for r in table.drop_columns(["left", "right", "others"]).to_pylist()}
        found = []
        for one, others in zip(table["cell"].to_pylist(), table["others"].to_pylist()):
            for other in others:
                a, b = held[one], held[other]
                ids, mult = (a[2], a[3]) if a is b else (np.concatenate(v) for v in zip(a[2:], b[2:]))
                count, label = traverse(a[0], b[0], a[1], b[1], mult, cosine)
                some = np.flatnonzero(count)
                found.append((ids[some], count[some], ids[label[some]]))
        return pa.table([pa.array(np.concatenate(v)) for v in zip(*found)], ["k", "links", "to"])

    # The packed rows are large: they are sent once a pair of tiles.
    found = tiled(pairs, packed).join(packed.hint("merge"), "cell").groupBy("left", "right").applyInArrow(tile_pair, "k bigint, links bigint, to bigint")
    found = staged(found, "vector-links")
    parts = max(8, min(1_000, classes.count() // 1_000_000))
    label = components(found.select(F.col("k").alias("a"), F.col("to").alias("b")), parts)
    links = found.groupBy("k").agg(F.sum("links").alias("links"))
    known = classes.select("k", "t1", "t2", "rep", "mult").join(links.hint("merge"), "k", "left").join(label.withColumnRenamed("id", "k").hint("merge"), "k", "left")
    known = staged(known.withColumn("component", F.coalesce("component", "k")), "labelled", parts=parts)
    least = known.groupBy("component").agg(F.min("rep").alias("least"))
    known = known.join(least.hint("merge"), "component").select("t1", "t2", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "least")
    out = rows.select("vec_id", "t0", "t1", "t2").distinct().join(known.hint("merge"), ["t1", "t2"], "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


#: The same definition by all pairs.
ORACLE = """
WITH RECURSIVE v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
g AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM v WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.9),
r AS (SELECT vec_id AS id, vec_id AS reached FROM v UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v JOIN c ON c.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
