"""Byte-pair encoding and decoding by traversal of a trie of distinct words.

The encoding of a word's prefix ends in exactly one token: the suffix of the prefix whose own
left neighbour (the last token of what remains) stays apart from it under the merge rules. A trie
node is a prefix, so a depth-first walk hands each node the last tokens of its ancestors and
finds its own once; words that share a prefix share that work. A word's tokens are then read off
backwards, from its last token to the token before it.

Texts are cut at white space; each distinct chunk is normalised, split and encoded once per
worker (a bounded memo), whatever its frequency. Nothing is shuffled.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

#: Chunks that a worker remembers before the older half goes; bounds memory, not results.
MEMO_CHUNKS = 300_000
#: Longer chunks are encoded each time they occur, so that the memo stays small.
MEMO_CHARS = 64

# Fixed values of the tokenizer's file format: its split pattern, and the white space that the
# file's pattern \s stands for (U+001C to U+001F are not in it).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
ODD_SPACE = re.compile("[\x1c-\x1f]")
SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")

#: Below this code point every character is its own NFC form and has a settled category.
PLAIN_LIMIT = 0x250
BEYOND_PLAIN = re.compile(f"[\\u{PLAIN_LIMIT:04x}-\\U0010ffff]")


def plain_pattern() -> re.Pattern:
    """WORD_PATTERN for texts of characters below PLAIN_LIMIT, in terms of re."""
    kinds = {c: unicodedata.category(chr(c))[0] for c in range(PLAIN_LIMIT)}
    some = {k: "".join(f"\\u{c:04x}" for c, kind in kinds.items() if kind == k) for k in "LN"}
    pattern = WORD_PATTERN.replace(r"\p{L}", some["L"]).replace(r"\p{N}", some["N"])
    return re.compile(pattern.replace(r"\s", r"\t-\r \x85\xa0"))


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable Latin-1, else the next of U+0100 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, spare = [], 0x100
    for byte in range(256):
        letters.append(chr(byte) if byte in kept else chr(spare))
        spare += byte not in kept
    return letters


class TrieBpe:
    """Encoder and decoder for a BPE model with word ends, given as the JSON text of its file."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != WORD_END or model.get("continuing_subword_prefix"):
            raise ValueError("a BPE model with </w> word ends is needed")
        self.ids: dict[str, int] = model["vocab"]
        self.text_of = {i: t for t, i in self.ids.items()}
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.rank = {(self.ids[a], self.ids[b]): k for k, (a, b) in enumerate(pairs)}
        self.made_of = {self.ids[a + b]: (self.ids[a], self.ids[b], k) for k, (a, b) in reversed([*enumerate(pairs)])}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.text_of |= {i: t for t, i in self.special.items()}
        #: What every added token begins with one of: looked for before the slower pattern.
        self.special_starts = sorted({t[:2] for t in self.special})
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.id_text = {i: str(i) for i in self.text_of}
        self.letters = byte_letters()
        self.words = plain_pattern()
        self.library_text = text
        self._library = None
        self._apart: dict[int, bool] = {}
        self.begins = {t[:k] for t in (x.removesuffix(WORD_END) for x in self.ids) for k in range(len(t) + 1)}
        self._steps: dict[str, tuple[str, list, list]] = {}
        self._rights: dict[int, list[tuple[int, float]]] = {}
        self._lefts: dict[int, list[tuple[int, float]]] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    # -- merge rules ---------------------------------------------------------------------------

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one edge of a token while it is being merged, innermost first,
        each with the rank of the merge that takes it up (infinite for the token itself)."""
        seen = self._lefts if side == 0 else self._rights
        if token not in seen:
            steps: list[tuple[int, float]] = [(token, float("inf"))]
            at = token
            while at in self.made_of:
                left, right, rank = self.made_of[at]
                at = right if side else left
                steps.append((at, rank))
            seen[token] = steps[::-1]
        return seen[token]

    def apart(self, a: int, b: int) -> bool:
        """Whether a and b stay two tokens when they are neighbours: no merge across their border
        comes before the merges inside them. Equal ranks go from left to right."""
        key = a << 20 | b
        known = self._apart.get(key)
        if known is None:
            left, right = self.edge(a, 1), self.edge(b, 0)
            i = j = 0
            known = True
            while True:
                (x, x_next), (y, y_next) = left[i], right[j]
                across = self.rank.get((x, y))
                if across is not None and across < x_next and across <= y_next:
                    known = False
                    break
                if x_next <= y_next:
                    if x_next == float("inf"):
                        break
                    i += 1
                else:
                    j += 1
            if len(self._apart) > 2_000_000:
                self._apart.clear()
            self._apart[key] = known
        return known

    # -- suffix states -------------------------------------------------------------------------

    def step(self, state: str, letter: str) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]]]:
        """Where a path goes with one more letter: its new state, and (length, token) of the tokens
        that are suffixes of it, longest first, without and with a word's end.

        A state is the longest suffix of the path that begins some token; every token that is a
        suffix of the path is one of the state too. States are worked out when first met.
        """
        key = state + letter
        known = self._steps.get(key)
        if known is None:
            at = next(k for k in range(len(key) + 1) if key[k:] in self.begins)
            new = key[at:]
            tails = [new[k:] for k in range(len(new))]
            inner = [(len(x), self.ids[x]) for x in tails if x in self.ids]
            final = [(len(x), self.ids[x + WORD_END]) for x in tails if x + WORD_END in self.ids]
            known = self._steps[key] = (new, inner, final)
        return known

    # -- trie ----------------------------------------------------------------------------------

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Token ids of distinct words (in byte letters), through one trie of all of them.

        The trie is kept as the sorted list of its words, which is its depth-first order: what a
        word has in common with the one before is the path to the node where it branches off.
        The walk keeps, for each prefix of the path, its state, its last token and that token's
        length; what is kept for a shared prefix was computed once.
        """
        out: dict[str, list[int]] = {}
        states, tokens, sizes = [""], [-1], [0]  # of the path's first k letters
        before, apart, rank_apart = "", self.apart, self._apart
        step, steps = self.step, self._steps
        for word in sorted(words):
            n, k, most = len(word), 0, min(len(word) - 1, len(before), len(states) - 1)
            while k < most and word[k] == before[k]:
                k += 1
            del states[k + 1 :], tokens[k + 1 :], sizes[k + 1 :]
            before = word
            state = states[k]
            for at in range(k, n):
                state, inner, final = steps.get(state + word[at]) or step(state, word[at])
                for size, token in final if at == n - 1 else inner:
                    if size > at:
                        break
                    pair = tokens[at + 1 - size] << 20 | token
                    ok = rank_apart.get(pair)
                    if apart(tokens[at + 1 - size], token) if ok is None else ok:
                        break
                else:
                    raise ValueError(f"no token for a suffix of {word[: at + 1]!r}")
                if at < n - 1:
                    states.append(state)
                    tokens.append(token)
                    sizes.append(size)
            ids = [token]
            at = n - size
            while at:
                ids.append(tokens[at])
                at -= sizes[at]
            ids.reverse()
            out[word] = ids
        return out

    # -- texts ---------------------------------------------------------------------------------

    @property
    def library(self):
        """The library's own normaliser and splitter, for chunks with characters beyond PLAIN_LIMIT."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.library_text)
        return self._library

    def split_chunk(self, chunk: str) -> list[str]:
        """Words of a chunk without white space, in byte letters."""
        if chunk.isascii() and chunk.isprintable():
            return self.words.findall(chunk.lower())
        if not BEYOND_PLAIN.search(chunk):
            letters = self.letters
            return ["".join([letters[b] for b in w.encode()]) for w in self.words.findall(chunk.lower())]
        lib = self.library
        return [w for w, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(chunk))]

    def encode_chunks(self, chunks: set[str]) -> dict[str, tuple[int, ...]]:
        split = {c: self.split_chunk(c) for c in chunks}
        ids = self.encode_words(sorted(set(chain.from_iterable(split.values()))))
        return {c: tuple(chain.from_iterable(map(ids.__getitem__, ws))) for c, ws in split.items()}

    def chunks(self, text: str) -> list[str]:
        """Pieces whose encodings make up that of the text: words of a plain text, else what stands
        between white space. A word alone is split as it is within its text."""
        if not BEYOND_PLAIN.search(text):
            return self.words.findall(text.lower())
        return [x for x in SPACE.split(text) if x] if ODD_SPACE.search(text) else text.split()

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Token ids of whole texts; null counts as empty."""
        rows: list[list] = []
        for text in texts:
            parts: list = []
            if text:
                if self.special_pattern and any(s in text for s in self.special_starts):
                    for k, piece in enumerate(self.special_pattern.split(text)):
                        parts.append((self.special[piece],) if k % 2 else self.chunks(piece))
                else:
                    parts.append(self.chunks(text))
            rows.append(parts)
        if len(self.memo) > MEMO_CHUNKS:  # what has not been met again since the last turn goes
            self.older, self.memo = self.memo, {}
        memo, older = self.memo, self.older
        new = {c for parts in rows for p in parts if isinstance(p, list) for c in p}.difference(memo)
        found: dict[str, tuple[int, ...]] = {}
        if older:
            again = new.intersection(older)
            memo.update((c, older[c]) for c in again)
            new -= again
        if new:
            found = self.encode_chunks(new)
            memo.update((c, i) for c, i in found.items() if len(c) <= MEMO_CHARS)
            found = {c: i for c, i in found.items() if len(c) > MEMO_CHARS}
        out = []
        for parts in rows:
            ids: list[int] = []
            for p in parts:
                if isinstance(p, tuple):
                    ids.extend(p)
                elif found:
                    ids.extend(chain.from_iterable([memo[c] if c in memo else found[c] for c in p]))
                else:
                    ids.extend(chain.from_iterable(map(memo.__getitem__, p)))
            out.append(ids)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The file names no decoder: token strings, joined by spaces, special ones included."""
        return " ".join(map(self.text_of.__getitem__, ids))

    def id_string(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.id_text.__getitem__, ids))


_models: dict[str, TrieBpe] = {}


def model_of(text: str) -> TrieBpe:
    """One model per worker process and file content."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _models:
        _models.clear()
        _models[key] = TrieBpe(text)
    return _models[key]


def groups(texts: pa.ChunkedArray | pa.Array, most: int = 4_000_000) -> Iterator[list[str | None]]:
    """Texts in runs of about so many characters, so that a batch of long texts stays small."""
    run: list[str | None] = []
    held = 0
    for x in texts:
        value = x.as_py()
        run.append(value)
        held += len(value or "")
        if held >= most:
            yield run
            run, held = [], 0
    if run:
        yield run


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Encode whole texts, then decode the ids.

    Returns id_col, n_tokens long, ids_sha256 and decoded_sha256 string, and with ids=True also
    ids array<int> and decoded string. The vocabulary file is read on the driver and broadcast:
    its size is that of the file (under 2 MB) whatever the input.

    Null text: as the empty text (no tokens; hashes of the empty string). Null or repeated id:
    each row gives one row. Empty table: empty result. Other columns are not read.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        model_text = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_text.value)
        gc.freeze()  # the model stays; the collector need not walk it
        for batch in batches:
            counts, id_hashes, text_hashes, all_ids, all_texts = [], [], [], [], []
            for texts in groups(batch.column(1)):
                for row in model.encode_batch(texts):
                    decoded = model.decode(row)
                    counts.append(len(row))
                    id_hashes.append(hashlib.sha256(model.id_string(row).encode()).hexdigest())
                    text_hashes.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if ids:
                        all_ids.append(row)
                        all_texts.append(decoded)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
