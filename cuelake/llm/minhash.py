"""Near-duplicate documents by one-permutation MinHash and star-shaped candidates."""
from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.common import batch_words, mix64, shingle_hashes, staged, string_hashes

BINS, ROWS = 128, 4
#: Members up to which an open bucket sends a star from each; members, and shingles of
#: them, of a block of a larger one.
FEW, BLOCK, BLOCK_SHINGLES = 64, 1_024, 400_000
#: Documents for each file of the small tables in between.
ROWS_A_FILE = 4_000


_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)


def signature(values: np.ndarray) -> np.ndarray:
    """One-permutation sketch of a sorted array of distinct hashes, all BINS bins filled.

    A bin's value is the smallest hash whose top bits name the bin. An empty bin takes
    the value of the first filled bin in its own pseudo-random sequence of bins (optimal
    densification): the same for every set, and spread evenly over the filled bins.
    """
    shift = np.uint64(64 - BINS.bit_length() + 1)
    first = np.searchsorted(values, _EDGES)
    full = np.diff(np.append(first, len(values))) > 0
    out = values[np.minimum(first, len(values) - 1)]
    empty, attempt = np.flatnonzero(~full), 0
    filled = out.copy()
    while len(empty):
        pick = (mix64(empty.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt + 1)) >> shift).astype(np.int64)
        hit = full[pick]
        filled[empty[hit]] = out[pick[hit]]
        empty, attempt = empty[~hit], attempt + 1
    return filled


def bands(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key for each ROWS bins of a sketch."""
    h = np.zeros(BINS // ROWS, np.uint64)
    for k in range(ROWS):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + sketch.reshape(-1, ROWS)[:, k])
    return mix64(h + np.arange(BINS // ROWS, dtype=np.uint64)).view(np.int64)


def batch_sets(batch: pa.RecordBatch, width: int):
    """(sorted distinct shingle hashes) of each text of a batch, in order."""
    for at in range(0, batch.num_rows, 2000):
        codes, dictionary, starts = batch_words(pc.ascii_lower(batch["text"].slice(at, 2000)))
        hashes = string_hashes(dictionary)[codes] if len(codes) else np.empty(0, np.uint64)
        grams = shingle_hashes(hashes, width)
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if e - s >= width:
                yield np.unique(grams[s : e - width + 1])
            else:
                yield shingle_hashes(hashes[s:e], e - s) if e > s else np.empty(0, np.uint64)


def features(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (set size), fp (128-bit name of the set), sketch (a byte a bin), keys (bands;
    of every set with a shingle)."""

    def rows(batches):
        for b in batches:
            n, fp, sk, ks = [], [], [], []
            for values in batch_sets(b, width):
                n.append(len(values))
                if len(values):
                    filled = signature(values)
                    fp.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                    sk.append((filled & np.uint64(0xFF)).astype(np.uint8).tobytes())
                    ks.append(bands(filled))
                else:
                    for column in (fp, sk, ks):
                        column.append(None)
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sk, pa.binary()), pa.array(ks, lists)],
                names=["doc_id", "n", "fp", "sketch", "keys"],
            )

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id bigint, n bigint, fp binary, sketch binary, keys array<bigint>")


def alone(docs: DataFrame, width: int) -> DataFrame:
    """(id, u): shingles of each of these documents that no other of them holds, at least.

    Shingles are told apart by 32 bits: two that fall together only lower u.
    """

    def rows(batches):
        for b in batches:
            sets = list(batch_sets(b, width))
            ids = np.repeat(b["doc_id"].to_numpy(), [len(v) for v in sets])
            grams = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((grams >> np.uint64(32)).astype(np.uint32).view(np.int32))], names=["id", "g"])

    held = docs.select("doc_id", "text").mapInArrow(rows, "id bigint, g int")
    return held.groupBy("g").agg(F.count("*").alias("c"), F.min("id").alias("id")).filter("c = 1").groupBy("id").agg(F.count("*").alias("u"))


def likely(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate edges (a, b) whose sizes and sketches allow the wanted similarity.

    The sketch agreement may fall short by five standard deviations of the estimate.
    """
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    pairs = edges.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").filter(
        100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    )

    def rows(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint8).reshape(-1, BINS) for c in ("s_a", "s_b"))
            n = np.minimum(b["n_a"].to_numpy(), b["n_b"].to_numpy())
            least = percent / 100 - 0.18 * np.sqrt(BINS / np.minimum(n, BINS))
            keep = pa.array((x == y).mean(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([b["a"].filter(keep), b["b"].filter(keep)], names=["a", "b"])

    return pairs.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(rows, "a bigint, b bigint")


def clusters(rows: DataFrame, parts: int) -> DataFrame:
    """(key, id, comp, members, shingles): the ids of overlapping buckets (key, id, comp, n),
    each once, with the members of their cluster and all their shingles.

    Members of one bucket are in one cluster, so its pairs hold the pairs of all buckets;
    the many buckets of one group of copies become one.
    """
    lead = rows.groupBy("key").agg(F.min("id").alias("lead"))
    linked = components(rows.join(lead.hint("merge"), "key").select(F.col("id").alias("a"), F.col("lead").alias("b")), parts)
    ids = rows.select("id", "comp", "n").distinct().join(linked.hint("merge"), "id", "left").select(F.coalesce("component", "id").alias("key"), "id", "comp", "n")
    return ids.join(ids.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("shingles")).hint("merge"), "key")


def bridges(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between components of large buckets: members (key, id, comp, members, shingles).

    Blocks of BLOCK members or BLOCK_SHINGLES shingles, whichever is less, meet in pairs,
    with their shingles as 64-bit hashes; a cell compares its sets by counting common
    shingles and returns no more links than join its components, whatever their number.
    """
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    block = F.pmod(F.xxhash64("id"), blocks).cast("int")
    # cell (i, j), i <= j: a member of block k lies in the cells (k, *) and (*, k)
    cells = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(block, j).alias("i"), F.greatest(block, j).alias("j")))
    laid = members.select("key", "id", "comp", F.explode(cells).alias("cell"))
    ids = members.select(F.col("id").alias("doc_id")).distinct()

    def rows(batches):
        for b in batches:
            grams = [v.view(np.int64) for v in batch_sets(b, width)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(grams, pa.list_(pa.int64()))], names=["id", "grams"])

    sets = texts.join(ids.hint("merge"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(rows, "id bigint, grams array<bigint>")

    def cell(table: pa.Table) -> pa.Table:
        ids, comps = table["id"].to_numpy(), table["comp"].to_numpy()
        lists = table["grams"].combine_chunks()
        n = np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(len(n)), n)
        names, code, held = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        common = held[code] > 1
        owner, code = owner[common], code[common]
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        top = {c: c for c in set(comps.tolist())}

        def find(c):
            while top[c] != c:
                c = top[c]
            return c

        # shingles that many members hold are counted by a matrix product, others pair by pair
        count = np.bincount(code, minlength=len(names))
        heavy = count[code] * 16 >= len(n)
        columns = np.unique(code[heavy], return_inverse=True)[1]
        dense = np.zeros((len(n), columns.max() + 1 if len(columns) else 0), np.float32)
        dense[owner[heavy], columns] = 1
        owner, code = owner[~heavy], code[~heavy]
        by_owner = np.argsort(owner, kind="stable")

        found = []
        step = 64
        for s in range(0, len(n), step):
            shared = (dense[s : s + step] @ dense.T).astype(np.int32)
            lo, hi = np.searchsorted(owner[by_owner], [s, s + step])
            mine = by_owner[lo:hi]
            first, last = np.searchsorted(code, code[mine]), np.searchsorted(code, code[mine], "right")
            each = last - first
            other = owner[np.repeat(first - np.concatenate(([0], np.cumsum(each)))[:-1], each) + np.arange(each.sum())]
            np.add.at(shared, (np.repeat(owner[mine] - s, each), other), 1)
            link = 100 * shared >= percent * (n[s : s + step, None] + n[None, :] - shared)
            link &= comps[s : s + step, None] != comps[None, :]
            for i, j in zip(*np.nonzero(link)):
                x, y = find(int(comps[s + i])), find(int(comps[j]))
                if x != y:
                    top[max(x, y)] = min(x, y)
                    found.append(sorted((int(ids[s + i]), int(ids[j]))))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return laid.join(sets.hint("merge"), "id").groupBy("key", "cell").applyInArrow(cell, "a bigint, b bigint").distinct()


def confirmed(edges: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges (a, b) with 100 * |A & B| >= percent * |A | B| on the shingles themselves."""
    side = lambda c: docs.select(F.col("doc_id").alias(c), F.col("text").alias(f"t_{c}"))
    pairs = edges.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").select("a", "b", "t_a", "t_b")

    def rows(batches):
        import re

        spaces = re.compile(r"[^\x20\x09-\x0D]+")

        def grams(text):
            w = spaces.findall(text)
            return set(zip(*(w[k:] for k in range(width)))) if len(w) >= width else {tuple(w)}

        last, held = None, set()  # rows come sorted by b
        for b in batches:
            ta, tb = pc.ascii_lower(b["t_a"]), pc.ascii_lower(b["t_b"])
            keep = []
            for i in range(b.num_rows):
                y = tb[i].as_py()
                if y != last:
                    last, held = y, grams(y)
                x = grams(ta[i].as_py())
                both = len(x & held)
                keep.append(100 * both >= percent * (len(x) + len(held) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b["a"].filter(keep), b["b"].filter(keep)], names=["a", "b"])

    return pairs.mapInArrow(rows, "a bigint, b bigint").distinct()


def components(links: DataFrame, parts: int | None = None) -> DataFrame:
    """(id, component): the smallest id reachable over undirected links (a, b).

    Alternating large-star and small-star steps, each written to the shared folder; a
    node's smallest neighbour is an aggregate joined back, so hubs are never gathered.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = staged(edges, "edges", parts=parts), None
    while True:
        sides = edges.union(edges.select("v", "u"))
        low = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sides.join(low.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = staged(large, "large-star", parts=parts)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges = staged(small, "small-star", parts=parts)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return staged(edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component"), "components", parts=parts)


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: near-duplicate components of documents.

    Words are runs outside [\\x20\\x09-\\x0D] with A-Z in lower case; a document's set holds
    its distinct `width`-word shingles, with fewer words the whole sequence, without words
    nothing. Documents are linked at 100 * intersection >= percent * union of the full sets;
    component_id is the smallest doc_id reachable, kept is doc_id = component_id.

    Equal sets become one class. Class representatives are bucketed by bands, whatever their
    size; every bucket sends edges from its most central member only, the one
    whose buckets are largest in sum. Sketches drop unlikely edges, the texts confirm the
    rest. Buckets whose members are not yet in one component go on: the members outside
    the centre's component become centres too; large ones are compared in blocks, which
    return no more links than join their components. Members whose unshared shingles leave
    no room for a link are ruled out before.

    One row a row of docs; an empty set is linked with nothing. Rows that repeat a doc_id
    are one document; a null doc_id is linked with nothing, its component is null and it
    is kept. Other columns are dropped; an empty table gives an empty table.
    """
    found = staged(features(docs, width), "features")
    parts = max(8, found.count() // ROWS_A_FILE)
    sets = found.filter("doc_id IS NOT NULL AND n > 0")
    classes = sets.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    member = staged(sets.select("doc_id", "fp").join(classes.hint("merge"), "fp").select("doc_id", "rep", (F.col("doc_id") == F.col("rep")).alias("own")), "classes", parts=parts)
    reps = member.filter("own").select("doc_id").distinct()
    sets = sets.join(reps.hint("merge"), "doc_id", "left_semi")
    keyed = sets.select(F.col("doc_id").alias("id"), F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = staged(keyed.join(sizes.hint("merge"), "key"), "buckets", parts=parts)
    central = shared.groupBy("id").agg(F.sum("size").alias("weight"))
    shared = staged(shared.join(central.hint("merge"), "id").select("key", "id", "weight"), "weighted", parts=parts)
    centre = shared.groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("id"))).alias("c")).select("key", (-F.col("c.id")).alias("centre"))
    pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    edges = shared.join(centre.hint("merge"), "key").filter("id <> centre").select(*pair("id", "centre")).distinct()
    tested = staged(likely(edges, sets, percent), "candidates", parts=parts)
    texts = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    links = [staged(confirmed(tested, texts, width, percent), "links", parts=parts)]
    found_in = components(links[0], parts)

    # what one star a bucket leaves open
    label = found_in.select("id", F.col("component").alias("comp"))
    labelled = shared.join(label.hint("merge"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    of_centre = centre.join(label.select(F.col("id").alias("centre"), F.col("comp").alias("cc")).hint("merge"), "centre", "left").select("key", F.coalesce("cc", "centre").alias("cc"))
    open_keys = staged(labelled.join(of_centre.hint("merge"), "key").withColumn("out", F.col("comp") != F.col("cc")), "open", parts=parts)
    unsettled = open_keys.filter("out").select("key").distinct()
    labelled = open_keys.join(unsettled.hint("merge"), "key", "left_semi")
    # A set with u shingles of its own shares at most n - u with any other: most members of a
    # bucket are ruled out by that alone, without looking at pairs.
    involved = texts.join(labelled.select(F.col("id").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    own = sets.select(F.col("doc_id").alias("id"), "n").join(alone(involved, width).hint("merge"), "id", "left").select("id", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("most"))
    able = staged(labelled.join(own.hint("merge"), "id").filter(100 * F.col("most") >= percent * F.col("n")), "able", parts=parts)
    counted = able.groupBy("key").agg(F.count("*").alias("members"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 < c1").select("key", "members")
    able = staged(able.join(counted.hint("merge"), "key").select("key", "id", "comp", "out", "n", "most", "members"), "open-buckets", parts=parts)

    # small buckets: every member outside is a centre, FEW edges a member at most
    few = able.filter(F.col("members") <= FEW)
    rest = few.filter("out").select("key", F.col("id").alias("centre"), F.col("comp").alias("c_comp"), F.col("n").alias("c_n"), F.col("most").alias("c_most"))
    both = F.least("most", "c_most")
    possible = (F.col("comp") != F.col("c_comp")) & (100 * both >= percent * (F.col("n") + F.col("c_n") - both))
    edges = few.join(rest.hint("merge"), "key").filter(possible).select(*pair("id", "centre")).distinct()
    more = likely(edges, sets, percent).unionByName(bridges(clusters(able.filter(F.col("members") > FEW), parts), texts, width, percent)).distinct()
    more = staged(more.join(tested.hint("merge"), ["a", "b"], "left_anti"), "candidates", parts=parts)
    links.append(staged(confirmed(more, texts, width, percent), "links", parts=parts))
    links = [links[0], *(x for x in links[1:] if not x.isEmpty())]
    if len(links) > 1:
        found_in = components(reduce(DataFrame.unionByName, links), parts)
    names = member.select("doc_id", "rep").join(found_in.withColumnRenamed("id", "rep").hint("merge"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    return (
        found.select("doc_id", F.col("n").alias("n_shingles"))
        .join(names.hint("merge"), "doc_id", "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
        .select("doc_id", "n_shingles", "component_id", "kept")
    )


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
