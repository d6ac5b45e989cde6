"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

P(w | v) = l2(b) c(v,w)/c(v) + l1(b) c(w)/N + l0(b) 1/(V+1), where b is the octave of the context's
frequency c(v). The weights are learned by expectation-maximisation: one fold of the training
documents is deleted from the counts and serves as the held-out text.

Documents are packed into blocks of bounded size (local word numbers); a block asks for the
corpus counts of its distinct words and bigrams, once each whatever their frequency in it. Asked
keys (64-bit hashes, sorted) are shuffled by ranges of their value, so no word can be hot; the
task of a range adds up all blocks' counts, and answers each block in the order in which it asked.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkpact.llm.common import fold_of, saved

FOLDS = 5
#: Documents of this fold are never learned from.
HELD_OUT_FOLD = 1
#: Training documents of this fold are deleted from the counts while the weights are learned.
DELETED_FOLD = 2
#: Tokens of a block; a longer text is a block of its own.
BLOCK_TOKENS = 1_500_000
#: Asked keys of a range, about; bounds a task's memory.
RANGE_KEYS = 400_000
#: Steps of an octave in which probabilities are tallied for the weights' estimation.
STEPS = 8
ROUNDS = 60

END, START = b"\n", b"\t"  # no word holds white space
NEVER = -(1 << 15)
U64 = np.uint64


def tokens_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased words between U+0009 to U+000D and spaces; null has none."""
    return text.encode().lower().split() if text else []


def squeezed(x: np.ndarray) -> bytes:
    """Compressed bytes of whole numbers, all first bytes first."""
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def unsqueezed(b: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return flat.reshape(size, -1).T.copy(order="C").view(kind).reshape(-1)


def bigram_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A 64-bit mix of two word hashes, by order."""
    x = first * U64(0x9E3779B97F4A7C15) + (second ^ (second >> U64(31))) * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(29))


class Block:
    """Some documents as local word numbers (by hash order), each text ending in END."""

    def __init__(self, vocabulary: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, folds: np.ndarray) -> None:
        self.vocabulary, self.tokens, self.lengths, self.folds = vocabulary, tokens, lengths, folds

    @classmethod
    def of(cls, texts: list[list[bytes]], folds: list[int]) -> Block:
        index: dict[bytes, int] = {START: 0, END: 1}
        flat: list[int] = []
        for words in texts:
            flat += [index.setdefault(w, len(index)) for w in words]
            flat.append(1)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in index), U64, len(index))
        order = np.argsort(hashes)
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        return cls(hashes[order], place[np.array(flat, np.int64)], np.array([len(w) + 1 for w in texts], np.int64), np.array(folds, np.int8))

    def pack(self) -> tuple[bytes, bytes, bytes, bytes]:
        return squeezed(np.diff(self.vocabulary, prepend=U64(0))), squeezed(self.tokens), squeezed(self.lengths), self.folds.tobytes()

    @classmethod
    def unpack(cls, parts: tuple[bytes, bytes, bytes, bytes]) -> Block:
        return cls(np.cumsum(unsqueezed(parts[0], np.uint64), dtype=np.uint64), unsqueezed(parts[1], np.uint32), unsqueezed(parts[2], np.int64), np.frombuffer(parts[3], np.int8))

    def work(self) -> None:
        """Distinct bigrams and, for each token, its document and its bigram's number."""
        start = np.searchsorted(self.vocabulary, U64(xxhash.xxh64_intdigest(START)))
        first = np.cumsum(self.lengths) - self.lengths
        self.context = np.empty(len(self.tokens), np.int64)
        self.context[1:] = self.tokens[:-1]
        self.context[first] = start
        self.start = start
        codes, self.bigram = np.unique(self.context * len(self.vocabulary) + self.tokens, return_inverse=True)
        keys = bigram_keys(self.vocabulary[codes // len(self.vocabulary)], self.vocabulary[codes % len(self.vocabulary)])
        order = np.argsort(keys)
        self.bigram_keys = keys[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.bigram = place[self.bigram]
        self.fold_of_token = np.repeat(self.folds, self.lengths)

    def asked(self, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys of words (0) or bigrams (1), with their training counts and those of the deleted fold."""
        keys, numbers = ((self.vocabulary, self.tokens), (self.bigram_keys, self.bigram))[kind]
        counts = [np.bincount(numbers[mask], minlength=len(keys)).astype(np.uint32) for mask in (self.fold_of_token != HELD_OUT_FOLD, self.fold_of_token == DELETED_FOLD)]
        return keys, *counts

    def answers(self, words: np.ndarray, bigrams: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token the counts of its bigram, of its context and of itself."""
        words = words.astype(np.int64)
        of_context = words.copy()
        of_context[self.start] = texts
        return bigrams[self.bigram].astype(np.int64), of_context[self.context], words[self.tokens]


def octave(counts: np.ndarray) -> np.ndarray:
    """0 for 0, else 1 + floor(log2)."""
    return np.frexp(counts.astype(float))[1]


def ratio(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.asarray(b) > 0)


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each block: its number (odd: of the deleted fold), ids and packed texts."""
    kind = docs.select(id_col).schema[0].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = pa.list_(to_arrow_type(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {False: [[], [], [], 0], True: [[], [], [], 0]}

        def done(deleted: bool) -> pa.RecordBatch:
            ids, texts, folds, _ = held[deleted]
            held[deleted] = [[], [], [], 0]
            block = Block.of(texts, folds)
            block.work()
            parts = block.pack()
            n = int((block.fold_of_token != HELD_OUT_FOLD).sum())
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((uuid.uuid4().int >> 66 << 1 | deleted, pa.int64()), (deleted, pa.bool_()), (ids, id_type), *((p, pa.binary()) for p in parts), (n, pa.int64()), (sum(f != HELD_OUT_FOLD for f in folds), pa.int64()), (len(block.vocabulary), pa.int64()), (len(block.bigram_keys), pa.int64()))],
                ["block", "deleted", "ids", "vocabulary", "tokens", "lengths", "folds", "train_tokens", "train_texts", "words", "bigrams"],
            )

        for batch in batches:
            for key, text, fold in zip(*(batch.column(k) for k in range(3)), strict=True):
                words, fold = tokens_of(text.as_py()), fold.as_py()
                own = held[fold == DELETED_FOLD]
                if own[3] and own[3] + len(words) >= BLOCK_TOKENS:
                    yield done(fold == DELETED_FOLD)
                    own = held[fold == DELETED_FOLD]
                own[0].append(key.as_py())
                own[1].append(words)
                own[2].append(fold)
                own[3] += len(words) + 1
        for deleted, own in held.items():
            if own[0]:
                yield done(deleted)

    schema = f"block long, deleted boolean, ids array<{kind.simpleString()}>, vocabulary binary, tokens binary, lengths binary, folds binary, train_tokens long, train_texts long, words long, bigrams long"
    return docs.select(id_col, text_col, fold_of(F.col(id_col), FOLDS).alias("fold")).mapInArrow(run, schema)


PACKED = ("vocabulary", "tokens", "lengths", "folds")


def asked(packed: DataFrame, ranges: tuple[int, int]) -> DataFrame:
    """What each block asks for: its keys of each kind in each range of key values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                number = batch.column(0)[row].as_py()
                block = Block.unpack(tuple(batch.column(k + 1)[row].as_py() for k in range(4)))
                block.work()
                for kind, n in enumerate(ranges):
                    keys, train, deleted = block.asked(kind)
                    edges = np.searchsorted((keys >> U64(32)) * U64(n) >> U64(32), np.arange(n + 1, dtype=np.uint64))
                    rows = [(k, s, e) for k, (s, e) in enumerate(zip(edges, edges[1:], strict=False)) if s < e]
                    for at in range(0, len(rows), 512):
                        part = rows[at : at + 512]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([kind] * len(part), pa.int32()), pa.array([k for k, _, _ in part], pa.int32()), pa.array([number] * len(part), pa.int64())]
                            + [pa.array([squeezed(x[s:e]) for _, s, e in part], pa.binary()) for x in (np.diff(keys, prepend=U64(0)), train, deleted)]
                            + [pa.array(keys[[s for _, s, _ in part]].view(np.int64))],
                            ["kind", "range", "block", "keys", "train", "gone", "first"],
                        )

    return packed.select("block", *PACKED).mapInArrow(run, "kind int, range int, block long, keys binary, train binary, gone binary, first long")


def answered(asking: DataFrame, ranges: tuple[int, int]) -> DataFrame:
    """For each block and range the corpus counts of its keys in order; also a row without block:
    how many of the range's keys occur in training text."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        kind, number = (k.as_py() for k in key)
        keys = []
        for b, first in zip(table["keys"], table["first"], strict=True):
            steps = unsqueezed(b.as_py(), np.uint64)
            steps[0] = np.int64(first.as_py()).view(np.uint64)
            keys.append(np.cumsum(steps, dtype=np.uint64))
        sizes = [len(k) for k in keys]
        distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
        totals = [np.bincount(where, np.concatenate([unsqueezed(b.as_py(), np.uint32) for b in table[c]]), len(distinct)).astype(np.uint64) for c in ("train", "gone")]
        edges = np.cumsum([0, *sizes])
        out: list[list] = [[None], [b""], [b""], [int((totals[0] > 0).sum())]]
        for block, s, e in zip(table["block"], edges, edges[1:], strict=False):
            out[0].append(block.as_py())
            out[1].append(squeezed(totals[0][where[s:e]]))
            out[2].append(squeezed(totals[1][where[s:e]]))
            out[3].append(0)
        n = len(out[0])
        return pa.table({"kind": pa.array([kind] * n, pa.int32()), "range": pa.array([number] * n, pa.int32()), "block": pa.array(out[0], pa.int64()), "train": pa.array(out[1], pa.binary()), "gone": pa.array(out[2], pa.binary()), "distinct": pa.array(out[3], pa.int64())})

    # a task for each range: what it reads is bounded by RANGE_KEYS, however large the corpus
    dealt = asking.repartition(max(1, sum(ranges)), "kind", "range")
    return dealt.groupBy("kind", "range").applyInArrow(run, "kind int, range int, block long, train binary, gone binary, distinct long")


def together(packed: pa.Table, answers: pa.Table) -> tuple[Block, list[list[np.ndarray]]]:
    """A block and, for words and bigrams, the training and deleted counts of its keys."""
    block = Block.unpack(tuple(packed[c][0].as_py() for c in PACKED))
    block.work()
    parts: dict[int, list] = {0: [], 1: []}
    for kind, number, train, gone in zip(*(answers[c].to_pylist() for c in ("kind", "range", "train", "gone")), strict=True):
        parts[kind].append((number, train, gone))
    counts = []
    for kind in (0, 1):
        found = sorted(parts[kind], key=lambda x: x[0])
        counts.append([np.concatenate([unsqueezed(x[c], np.uint64) for x in found]) for c in (1, 2)])
    return block, counts


def by_block(df: DataFrame, totals: dict[str, int]) -> DataFrame:
    """Rows dealt by block, to a task for each, about: a task's size is a block's, whatever the corpus'."""
    return df.repartition(max(1, totals["blocks"]), "block")


def tallies(packed: DataFrame, answers: DataFrame, totals: dict[str, int]) -> DataFrame:
    """How often the deleted fold's tokens have which context octave and which probabilities, in
    steps; at most 64 x 64 STEPS x 64 STEPS cells whatever the corpus."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block, (words, bigrams) = together(left, right)
        c2, cv, c1 = block.answers(words[0] - words[1], bigrams[0] - bigrams[1], totals["texts"] - totals["gone_texts"])
        steps = []
        for p in (ratio(c2, cv), ratio(c1, float(totals["tokens"] - totals["gone_tokens"]))):
            s = np.full(len(p), NEVER, np.int64)
            s[p > 0] = np.rint(np.log2(p[p > 0]) * STEPS)
            steps.append(s)
        cells, n = np.unique(np.stack([octave(cv), *steps]), axis=1, return_counts=True)
        return pa.table({"octave": pa.array(cells[0].astype(np.int32)), "p2": pa.array(cells[1].astype(np.int32)), "p1": pa.array(cells[2].astype(np.int32)), "n": pa.array(n.astype(np.int64))})

    odd = "block % 2 = 1"
    each = by_block(packed.where(odd).select("block", *PACKED), totals).groupBy("block").cogroup(by_block(answers.where(odd), totals).groupBy("block")).applyInArrow(run, "octave int, p2 int, p1 int, n long")
    return each.groupBy("octave", "p2", "p1").agg(F.sum("n").alias("n"))


def weights_of(cells: np.ndarray, vocabulary: int) -> np.ndarray:
    """Weights (bigram, unigram, uniform) for each octave 0 to 64 by expectation-maximisation over
    (octave, step of the bigram estimate, of the unigram estimate, count). An octave starts from
    the weights of all octaves together, each with half a token of prior mass."""
    p = np.zeros((len(cells), 3))
    for k in (0, 1):
        seen = cells[:, k + 1] > NEVER
        p[seen, k] = 2.0 ** (cells[seen, k + 1] / STEPS)
    p[:, 2] = 1 / (vocabulary + 1)
    out = np.zeros((65, 3))

    def learn(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
        w = start.copy()
        for _ in range(ROUNDS):
            part = p[rows] * w
            gained = (part / np.maximum(part.sum(axis=1, keepdims=True), 1e-300) * cells[rows, 3:4]).sum(axis=0) + 0.5 * start
            w = gained / gained.sum()
        return w

    whole = learn(np.ones(len(cells), bool), np.full(3, 1 / 3))
    for k in range(65):
        start = whole if k else np.array([0, *whole[1:]]) / whole[1:].sum()  # an unseen context has no bigram estimate
        rows = cells[:, 0] == k
        out[k] = learn(rows, start) if rows.any() else start
    return out


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all whole texts by a model of the training texts (fold other than HELD_OUT_FOLD).

    Returns id_col, held_out, n_tokens, n_known, train_tokens, base_score (unigrams, half a count
    added) and score (the interpolated model), log10, each text's end included as a token.

    Null or empty text: its end only. Null ids count as the empty text for the fold. Repeated
    rows: one row each, and each counts. No training text: every count is zero. Empty table:
    empty result. Other columns are not read.
    """
    packed = saved(blocks(docs, id_col, text_col), "blocks")
    sums = packed.agg(F.count("*").alias("blocks"), *(F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("train_tokens", "tokens"), ("train_texts", "texts"), ("words", "words"), ("bigrams", "bigrams"), (F.when(F.col("deleted"), F.col("train_tokens")), "gone_tokens"), (F.when(F.col("deleted"), F.col("train_texts")), "gone_texts")))).first()
    totals = {k: int(v) for k, v in sums.asDict().items()}
    ranges = tuple(max(1, -(-totals[k] // RANGE_KEYS)) for k in ("words", "bigrams"))
    answers = saved(answered(asked(packed, ranges), ranges), "answers")
    # START is asked for but is no token of any text
    vocabulary = int(answers.where("block is null and kind = 0").agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0])
    given = answers.where("block is not null").drop("distinct")
    # as columns of numbers: some 20 bytes a cell, and their number does not grow with the corpus
    table = tallies(packed, given, totals).orderBy("octave", "p2", "p1").toArrow()
    cells = np.stack([c.to_numpy().astype(np.int64) for c in table.columns], axis=1)
    weights = weights_of(cells, vocabulary)
    n, texts = totals["tokens"], totals["texts"]
    id_kind = dict(docs.dtypes)[id_col]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block, (words, bigrams) = together(left, right)
        c2, cv, c1 = block.answers(words[0], bigrams[0], texts)
        w = weights[octave(cv)]
        p = w[:, 0] * ratio(c2, cv) + w[:, 1] * ratio(c1, float(n)) + w[:, 2] / (vocabulary + 1)
        first = np.cumsum(block.lengths) - block.lengths
        per_text = lambda x: np.add.reduceat(x, first)
        return pa.table(
            {
                id_col: left["ids"].combine_chunks().flatten(),
                "held_out": pa.array(block.folds == HELD_OUT_FOLD),
                "n_tokens": pa.array(block.lengths),
                "n_known": pa.array(per_text((c1 > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(block.lengths), n, np.int64)),
                "base_score": pa.array(per_text(np.log10((c1 + 0.5) / (n + 0.5 * (vocabulary + 1))))),
                "score": pa.array(per_text(np.log10(p))),
            }
        )

    schema = f"`{id_col}` {id_kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by_block(packed.select("block", "ids", *PACKED), totals).groupBy("block").cogroup(by_block(given, totals).groupBy("block")).applyInArrow(run, schema)
