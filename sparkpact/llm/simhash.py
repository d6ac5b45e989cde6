"""SimHash near-duplicates by a self-join of a binary trie of fingerprints.

Two fingerprints within ``budget`` differing bits agree on at least ``BLOCKS - budget`` of BLOCKS
blocks of their bits, whichever bits differ. So for each choice of that many blocks the
fingerprints are keyed by those blocks' bits; a key is the root of one binary trie over the other
bits, and where it holds very many fingerprints it is split the same way over those. Tries are
joined with themselves in parallel: pairs of nodes are walked down together, the bits in which they
differ are added up, and a pair is dropped once it is over the budget.
Exact copies are one fingerprint, with a count; each task passes on a spanning star of what it
linked, not its pairs; stars are joined into components by Spark (large-star, small-star).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkpact.llm.bpe import groups
from sparkpact.llm.common import drop_saved, saved

BITS = 64
BLOCKS = 6
SEED = 42
#: A trie of more fingerprints is split by further blocks, at most LEVELS times in all.
HOT_TRIE = 100_000
LEVELS = 3
#: Node pairs walked down at once in a task; more are taken in turns.
FRONTIER = 500_000
#: Fingerprints that a task gathers before it joins the tries that are complete.
GATHERED = 200_000
#: A node of more neighbours is a hub: the rows under it are not brought to one task. At least this
#: many, and at least this share of all rows, so that the hubs' table has 2 / HUB_SHARE rows at most.
HUB_ROWS = 64
HUB_SHARE = 1e-5


def fingerprint(text: str | None, words_in_shingle: int = 4, seed: int = SEED) -> int:
    """Majority bits of the XXH64 values of a text's word shingles, repeats included.

    A-Z are lower-cased; words are what stands between U+0009 to U+000D and spaces. Fewer words
    than a shingle: one shingle of all of them; no words or null: 0.
    """
    if not text:
        return 0
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [*accumulate(map(len, words), lambda at, n: at + 1 + n)]
    starts = [0, *[e + 1 for e in ends]]
    digest = xxhash.xxh64_intdigest
    if len(words) <= words_in_shingle:
        hashes = [digest(joined, seed)]
    else:
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts, ends[words_in_shingle - 1 :], strict=False)]
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.array(hashes[at : at + 65_536], np.uint64)
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 4) -> DataFrame:
    """id_col and fp long (the fingerprint's 64 bits, signed) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(x, words_in_shingle) for part in groups(batch.column(1)) for x in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, fp long")


# -- one task's tries ------------------------------------------------------------------------------


def trie_links(keys: np.ndarray, fps: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of linked fingerprints; one binary trie for each run of equal keys.

    keys, fps: sorted by key, then by fingerprint (unsigned), no repeats within a key. A node is a
    range of that order: leaves that share their leading bits. Pairs of nodes go down one bit at a
    time, all at once.
    """
    n = len(fps)
    if n < 2:
        return
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    last = np.append(first[1:], n)
    many = last - first > 1
    lo, hi = first[many], last[many]
    # pairs: a's range, b's range, differing bits so far, bit to look at next (63: the highest)
    todo = [(lo, hi, lo, hi, np.zeros(len(lo), np.int8), BITS - 1)] if len(lo) else []
    zeros_before: dict[int, np.ndarray] = {}
    while todo:
        a, a_end, b, b_end, used, bit = todo.pop()
        if len(a) > FRONTIER:
            half = len(a) // 2
            todo += [tuple(x[k] for x in (a, a_end, b, b_end, used)) + (bit,) for k in (slice(half), slice(half, None))]
            continue
        leaves = (a_end - a == 1) & (b_end - b == 1)
        if leaves.any():
            x, y = a[leaves], b[leaves]
            near = (x != y) & (np.bitwise_count(fps[x] ^ fps[y]) <= budget)
            if near.any():
                yield x[near], y[near]
            rest = ~leaves
            a, a_end, b, b_end, used = a[rest], a_end[rest], b[rest], b_end[rest], used[rest]
        if not len(a) or bit < 0:
            continue
        if bit not in zeros_before:
            zeros_before[bit] = np.concatenate(([0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1) == 0)))
        zeros = zeros_before[bit]
        a_mid, b_mid = a + zeros[a_end] - zeros[a], b + zeros[b_end] - zeros[b]
        own = a == b  # a node with itself: its halves with themselves, and across once
        nxt = []
        for x, x_end, y, y_end, differ, skip in ((a, a_mid, b, b_mid, 0, None), (a_mid, a_end, b_mid, b_end, 0, None), (a, a_mid, b_mid, b_end, 1, None), (a_mid, a_end, b, b_mid, 1, own)):
            keep = (x < x_end) & (y < y_end) & (used + differ <= budget)
            if skip is not None:
                keep &= ~skip
            nxt.append((x[keep], x_end[keep], y[keep], y_end[keep], used[keep] + np.int8(differ)))
        joined = [np.concatenate(c) for c in zip(*nxt, strict=True)]
        alone = (joined[0] == joined[2]) & (joined[1] - joined[0] == 1)
        if alone.any():
            joined = [c[~alone] for c in joined]
        if len(joined[0]):
            todo.append((*joined, bit - 1))


def roots_of(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n leaves the smallest leaf it is linked to through any of the links."""
    root = np.arange(n)
    for a, b in links:
        while True:
            x, y = root[a], root[b]
            differ = x != y
            if not differ.any():
                break
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def child_masks(parent: int, budget: int) -> list[int]:
    """Masks of which each pair within budget, equal under parent, is equal under one at least: the
    other bits are cut into blocks, and all blocks but as many as may differ are added."""
    free = [b for b in range(BITS) if not parent >> b & 1]
    blocks = max(BLOCKS, budget + 1)
    edges = [round(k * len(free) / blocks) for k in range(blocks + 1)]
    masks = [sum(1 << b for b in free[x:y]) for x, y in zip(edges, edges[1:], strict=False)]
    return [parent | sum(chosen) for chosen in combinations(masks, blocks - budget)]


def block_keys(fp: Column, budget: int) -> Column:
    """Array of one trie root for each choice of blocks that may agree: its mask, and the bits under it."""
    return F.array(*(F.struct(F.lit(signed(m)).alias("mask"), fp.bitwiseAND(F.lit(signed(m))).alias("bits")) for m in child_masks(0, budget)))


def tries(fps: DataFrame, budget: int) -> DataFrame:
    """(mask, bits, fp): fingerprints under the roots of their tries.

    A root with more than HOT_TRIE fingerprints is split: its tries go on by the blocks of the bits
    that are left, so every link stays in some trie. After LEVELS levels over 40 bits are fixed, and
    a trie holds no more than the fingerprints that the others can tell apart.
    """
    rows = fps.select("fp", F.explode(block_keys(F.col("fp"), budget)).alias("key")).select("key.mask", "key.bits", "fp")
    parents = child_masks(0, budget)
    done = None
    for level in range(1, LEVELS + 1):
        hot = rows.groupBy("mask", "bits").agg(F.count("*").alias("n")).where(F.col("n") > HOT_TRIE).select("mask", "bits")
        hot = saved(hot, "hot") if level < LEVELS else None
        if hot is None or not hot.head(1):
            return rows if done is None else done.unionByName(rows)
        cold = rows.join(hot, ["mask", "bits"], "left_anti")
        done = cold if done is None else done.unionByName(cold)
        # a table of fixed size: the choices of a level
        pairs = [(signed(p), signed(c)) for p in parents for c in child_masks(p, budget)]
        table = F.broadcast(fps.sparkSession.createDataFrame(pairs, "mask long, child long"))
        rows = rows.join(hot, ["mask", "bits"], "left_semi").join(table, "mask").select(F.col("child").alias("mask"), F.col("fp").bitwiseAND(F.col("child")).alias("bits"), "fp").distinct()
        parents = sorted({c % (1 << BITS) for _, c in pairs})
    raise AssertionError("not reached")


def stars(fps: DataFrame, budget: int) -> DataFrame:
    """(u, v): v is a fingerprint in reach of u and before it, one row for each u in each trie that links it."""
    keyed = tries(fps, budget)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def done(mask: np.ndarray, bits: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            fp = fp.view(np.uint64)
            order = np.lexsort((fp, bits, mask))
            mask, bits, fp = mask[order], bits[order], fp[order]
            new = np.concatenate(([True], (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1]))) if len(fp) else np.zeros(0, bool)
            root = roots_of(len(fp), trie_links(np.cumsum(new), fp, budget))
            linked = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(fp[x].view(np.int64)) for x in (linked, root[linked])], ["u", "v"])

        def columns() -> list[np.ndarray]:
            return [np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(3)]

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            # whole keys are done with; the last one may go on in the next batch
            ends = [tuple(b.column(k)[at].as_py() for k in range(2)) for b, at in ((held[0], 0), (batch, batch.num_rows - 1))]
            if size >= GATHERED and ends[0] != ends[1]:
                mask, bits, fp = columns()
                cut = np.flatnonzero((mask != mask[-1]) | (bits != bits[-1]))[-1] + 1
                yield done(mask[:cut], bits[:cut], fp[:cut])
                held, size = [pa.RecordBatch.from_arrays([pa.array(x[cut:]) for x in (mask, bits, fp)], ["mask", "bits", "fp"])], len(fp) - cut
        if held:
            yield done(*columns())

    return keyed.select("mask", "bits", "fp").repartition("mask", "bits").sortWithinPartitions("mask", "bits").mapInArrow(run, "u long, v long")


# -- components ------------------------------------------------------------------------------------


def with_least(rows: DataFrame, least: DataFrame, hub_rows: float) -> DataFrame:
    """(u, v, m): rows (u, v) with the m that least (u, m, n) has for u; n is how many rows u has.

    Rows under a hub get m from a broadcast table, wherever they are; only the others are shuffled
    by u, so no task is sent the rows of a hub. The table is bounded by rows over hub_rows.
    """
    hubs = F.broadcast(least.where(F.col("n") > hub_rows).select("u", "m"))
    plain = least.where(F.col("n") <= hub_rows).select("u", "m")
    return rows.join(hubs, "u").unionByName(rows.join(hubs.select("u"), "u", "left_anti").join(plain, "u"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of edges (u, v): root is the smallest node in reach.

    Alternates large-star and small-star until the stars stay: each is one aggregation (combined
    before the shuffle) and a look at its result, in which hubs take no part in the shuffle. Each
    round is written to the shared folder, so lineage stays short.
    """
    now = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    size = now.count()
    while True:
        hub_rows = max(HUB_ROWS, size * HUB_SHARE)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
        large = with_least(both, least, hub_rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = saved(large.distinct(), "edges")
        low = saved(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = with_least(large, low, hub_rows).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        nxt = saved(small, "edges")
        # stars that stay: every node has one edge, to a node that has none of its own
        settled = nxt.groupBy("u").agg(F.count("*").alias("n")).agg(F.max("n").alias("n"), F.sum("n").alias("edges"), F.count("*").alias("nodes")).first()
        for old in (now, least, large, low):
            drop_saved(old)
        now, size = nxt, settled["edges"] or 0
        if not settled["nodes"] or settled["n"] == 1 and not now.select("v").distinct().join(now.select(F.col("u").alias("v")), "v", "left_semi").head(1):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 4, budget: int = 4) -> DataFrame:
    """Fingerprint and component of each row.

    Returns id_col, fingerprint (16 hex digits), component_id: the smallest id in reach over links
    of budget or fewer differing bits, equal fingerprints included.

    Null or empty text and text without words: fingerprint 0, linked like any other. Null ids take
    part but never name a component that has another id. Repeated rows: one row each. Empty
    table: empty result. Other columns are not read.
    """
    prints = saved(fingerprints(docs, id_col, text_col, words_in_shingle), "prints")
    classes = saved(prints.groupBy("fp").agg(F.min(id_col).alias("first_id")), "classes")
    roots = components(stars(classes.select("fp"), budget))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
