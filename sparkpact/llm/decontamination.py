"""Benchmark decontamination: a prefix-filtered join of documents with benchmark windows.

Every item is cut into all its windows of ``window`` consecutive words (a shorter item is one
window). Containment of a whole window needs each of its shingles, so the join may look at any
one; windows' shingles are ordered by rarity (how often the corpus has them), and the prefix to
join on is the rarest. A document's shingles are looked up among those prefixes only. The
prefix's place in the window fixes where the window would have to start (positional bound),
which must leave room for all its words (length bound); what is left is compared word by word.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkpact.llm.bpe import groups
from sparkpact.llm.common import saved

#: Words of a shingle; a window of fewer is one shingle.
SHINGLE = 3
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Windows of one pass over the documents; a larger benchmark takes more passes. Bounds what is sent to executors.
BLOCK_WINDOWS = 200_000
#: Bytes of item text of one pass.
BLOCK_BYTES = 16_000_000


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; words are runs of digits, letters a-z and characters beyond ASCII. Null has none."""
    return WORD.findall(text.encode().lower()) if text else []


def windows_of(words: list[bytes], window: int) -> set[tuple[bytes, ...]]:
    return {tuple(words[k : k + window]) for k in range(max(1, len(words) - window + 1))} if words else set()


def shingles_of(words: list[bytes], size: int) -> Iterator[tuple[bytes, ...]]:
    """Runs of so many words, in order."""
    return zip(*(words[k:] for k in range(size)), strict=False)


class WindowIndex:
    """Windows of some items under their rarest shingle."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int, counts: Counter) -> None:
        holders: dict[tuple[bytes, ...], list[int]] = {}
        self.names = [name for name, _ in items]
        for k, (_, words) in enumerate(items):
            for w in windows_of(words, window):
                holders.setdefault(w, []).append(k)
        #: By size of shingle: prefix shingle to the windows under it, by its place in the window and the
        #: window's length; so however many windows share a prefix, an occurrence looks each length up once.
        self.by_prefix: dict[int, dict[tuple[bytes, ...], dict[tuple[int, int], dict[tuple[bytes, ...], list[int]]]]] = {}
        for w, held in holders.items():
            size = min(SHINGLE, len(w))
            shingles = [*shingles_of(list(w), size)]
            # rarest first; ties to the smaller shingle, then to its first place
            at = min(range(len(shingles)), key=lambda p: (counts[shingles[p]], shingles[p], p))
            self.by_prefix.setdefault(size, {}).setdefault(shingles[at], {}).setdefault((at, len(w)), {})[w] = held

    def match(self, words: list[bytes]) -> tuple[set[int], list[tuple[int, int]]]:
        """Items with an occurring window, and the [start, end) of each occurrence."""
        n = len(words)
        found: set[int] = set()
        spans: list[tuple[int, int]] = []
        for size, prefixes in self.by_prefix.items():
            for k, shingle in [(k, x) for k, x in enumerate(shingles_of(words, size)) if x in prefixes]:
                for (at, length), windows in prefixes[shingle].items():
                    start = k - at
                    if start >= 0 and start + length <= n:
                        held = windows.get(tuple(words[start : start + length]))
                        if held:
                            found.update(held)
                            spans.append((start, start + length))
        return found, spans


def covered(spans: list[tuple[int, int]], n: int) -> int:
    """Words in any span."""
    if not spans:
        return 0
    steps = np.zeros(n + 1, np.int32)
    ends = np.array(spans)
    np.add.at(steps, ends[:, 0], 1)
    np.add.at(steps, ends[:, 1], -1)
    return int((np.cumsum(steps) > 0).sum())


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in runs of bounded size, one run at a time on the driver. An item that is larger than a
    run goes into several, in pieces that overlap by all but one word of a window."""
    run: list[tuple[str, list[bytes]]] = []
    windows = size = 0
    rows = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).cast("string"), text_col)
    for name, text in rows.toLocalIterator():
        for words in pieces_of(words_of(text), window):
            held = sum(map(len, words))
            if run and (windows + len(words) > BLOCK_WINDOWS or size + held > BLOCK_BYTES):
                yield run
                run, windows, size = [], 0, 0
            run.append((name, words))
            windows += len(words)
            size += held
    if run:
        yield run


def pieces_of(words: list[bytes], window: int) -> Iterator[list[bytes]]:
    """An item's words in pieces of bounded size, of which each window is in one at least."""
    step = max(window, min(BLOCK_WINDOWS, BLOCK_BYTES // max(map(len, words), default=1)))
    for at in range(0, max(1, len(words) - window + 1) if words else 0, step):
        yield words[at : at + step + window - 1]


def shingle_counts(docs: DataFrame, text_col: str, shingles: set[tuple[bytes, ...]]) -> Counter:
    """How often all documents have each shingle of a bounded set."""
    by_size: dict[int, set[tuple[bytes, ...]]] = {}
    for x in shingles:
        by_size.setdefault(len(x), set()).add(x)
    sent = docs.sparkSession.sparkContext.broadcast(by_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for texts in groups(batch.column(0)):
                for text in texts:
                    words = words_of(text)
                    for size, wanted in sent.value.items():
                        seen.update(filter(wanted.__contains__, shingles_of(words, size)))
        yield pa.RecordBatch.from_arrays([pa.array([b" ".join(x) for x in seen], pa.binary()), pa.array([*seen.values()], pa.int64())], ["shingle", "n"])

    counted = docs.select(text_col).mapInArrow(run, "shingle binary, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return Counter({tuple(bytes(x).split(b" ")): n for x, n in counted.toLocalIterator()})


def indexes(docs: DataFrame, benchmark: DataFrame, window: int, text_col: str, item_col: str, item_text_col: str) -> Iterator[tuple]:
    """(broadcast index, whether it is the only one) of each block of items, one block at a time; one at least."""
    context = docs.sparkSession.sparkContext

    def sent(items: list[tuple[str, list[bytes]]]):
        counts = shingle_counts(docs, text_col, {x for _, words in items for x in shingles_of(words, min(SHINGLE, len(words), window))})
        return context.broadcast(WindowIndex(items, window, counts))

    blocks = item_blocks(benchmark, item_col, item_text_col, window)
    block, after = next(blocks, []), next(blocks, None)
    only = after is None
    while block is not None:
        yield sent(block), only
        block, after = after, next(blocks, None)


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, in which no benchmark window occurs; nulls as in decontaminate()."""
    at = docs.columns.index(text_col)
    kept = docs
    for index, only in indexes(docs, benchmark, window, text_col, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not index.value.match(words_of(x))[0] for texts in groups(batch.column(at)) for x in texts], pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
        if not only:  # one index is alive at a time
            kept = saved(kept, "clean")
            index.destroy()
    return kept


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", spans: bool = False) -> DataFrame:
    """Benchmark windows within whole documents.

    Returns id_col, n_words, n_hit (words in any occurrence), n_items long, items_sha256 (of the
    item ids, sorted as strings, joined by commas), contaminated boolean, and with spans=True also
    items array<string> and spans array<struct<start,end>> (in words).

    The index of one block of items is broadcast: at most BLOCK_WINDOWS windows and BLOCK_BYTES of
    text whatever the benchmark's size; a larger benchmark is taken in blocks, one pass over the
    documents each, and their hits are written down and merged by row. One index is alive at a time.

    Null or empty text: no words, nothing hit. Items that are null, without words or without id
    take no part; items with one id are one item. Repeated documents: one row each. Empty
    benchmark: nothing is hit. Empty documents: empty result.
    """
    kind = dict(docs.dtypes)[id_col]
    columns = "items array<string>, spans array<struct<start:int,end:int>>, text_key string"

    def one(index, wide: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = index.value
            for batch in batches:
                n_words, n_hit, n_items, hashes, names, places, keys = [], [], [], [], [], [], []
                for texts in groups(batch.column(1)):
                    for text in texts:
                        words = words_of(text)
                        found, at = own.match(words)
                        ids = sorted({own.names[k] for k in found})
                        n_words.append(len(words))
                        n_hit.append(covered(at, len(words)))
                        n_items.append(len(ids))
                        hashes.append(items_hash(ids))
                        if wide:
                            names.append(ids)
                            places.append([{"start": s, "end": e} for s, e in sorted(set(at))])
                            keys.append(hashlib.sha256((text or "").encode()).hexdigest())
                out = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(hashes, pa.string())]
                if wide:
                    out += [pa.array(names, pa.list_(pa.string())), pa.array(places, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(keys, pa.string())]
                yield pa.RecordBatch.from_arrays(out, [id_col, "n_words", "n_hit", "n_items", "items_sha256", *(["items", "spans", "text_key"] if wide else [])])

        schema = f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string" + (", " + columns if wide else "")
        return docs.select(id_col, text_col).mapInArrow(run, schema)

    parts = []
    for index, only in indexes(docs, benchmark, window, text_col, item_col, item_text_col):
        if only:
            return one(index, spans).drop("text_key").withColumn("contaminated", F.col("n_hit") > 0)
        parts.append(saved(one(index, True), "hits"))
        index.destroy()
    return merged(parts, id_col, spans)


def items_hash(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def merged(parts: list[DataFrame], id_col: str, spans: bool) -> DataFrame:
    """Hits of several blocks of items, by id and text; copies of a row stay as many rows."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    n = len(parts)
    by = rows.groupBy(id_col, "text_key", "n_words").agg(
        (F.count("*") / n).cast("long").alias("copies"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans")
    )
    # words in any span: each span, in order of start, adds what lies beyond the furthest end so far
    hit = F.aggregate("spans", F.struct(F.lit(0).alias("far"), F.lit(0).alias("n")), lambda a, s: F.struct(F.greatest(a["far"], s["end"]).alias("far"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["far"], s["start"]))).alias("n")), lambda a: a["n"].cast("long"))
    out = by.select(id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "items", "spans", (F.size("items") > 0).alias("contaminated"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
    return out if spans else out.drop("items", "spans")
