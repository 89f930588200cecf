"""Byte-level BPE encoding of a corpus by merge replay.

The corpus is cut into blocks of whole texts. The distinct words of a block lie in one array of symbols, with links to their neighbours. An inverted
index leads from each token pair to its positions, over all words. The merges are replayed in rank order: a merge rewrites all positions
of its pair at once and puts only the pairs with touched neighbours back into the index. Merges never cross words, so a replay block by
block equals one replay over the whole corpus, and no shuffle is needed.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Default place of the tokenizer; a parameter everywhere.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

#: The word pattern of this kind of tokenizer, and the same for texts in ASCII only.
WORD = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_WORD = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"""

#: Splits a text before each line end that follows a character in ASCII other than white space.
LINES = re.compile(r"(?<=[\x21-\x7e])(?=\n)").split

#: Distinct words kept by a worker, and bytes of text in a block; both bound the memory of a task.
KEPT_WORDS = 500_000
BLOCK_BYTES = 16_000_000


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Merges:
    """Vocabulary and merge ranks of a tokenizer file."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab = model["vocab"]
        self.byte_id = np.array([vocab[s] for s in _byte_symbols()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.left, self.right = left, right
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        #: Bytes of each token: one for each character that stands for a byte.
        self.token_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        self.token_bytes[list(vocab.values())] = list(map(len, vocab))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for none."""
        k = a << 32 | b
        i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[i] == k, self.order[i], -1)


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


def replay(m: Merges, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words one after the other, and the number of tokens of each word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    sym = m.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    n = len(sym)
    if not n:
        return sym, sizes
    ends = np.cumsum(sizes)
    nxt = np.arange(1, n + 1)
    nxt[ends[sizes > 0] - 1] = -1
    prv = np.arange(-1, n - 1)
    prv[(ends - sizes)[sizes > 0]] = -1
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def put(at: np.ndarray) -> None:
        """Adds the pairs that begin at these positions to the inverted index."""
        ranks = m.rank(sym[at], sym[nxt[at]])
        hit = ranks >= 0
        if not hit.any():
            return
        ranks, at = ranks[hit], at[hit]
        if len(at) > 1:
            o = np.argsort(ranks, kind="stable")
            ranks, at = ranks[o], at[o]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            groups = np.split(at, cuts)
            firsts = ranks[np.concatenate(([0], cuts))].tolist()
        else:
            groups, firsts = [at], [int(ranks[0])]
        for r, g in zip(firsts, groups):
            if r in index:
                index[r].append(g)
            else:
                index[r] = [g]
                heapq.heappush(queue, r)

    put(np.flatnonzero(nxt >= 0))
    while queue:
        r = heapq.heappop(queue)
        parts = index.pop(r)
        at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        a, b, made = m.left[r], m.right[r], m.made[r]
        at = at[(sym[at] == a) & alive[at]]
        after = nxt[at]
        ok = (after >= 0) & (sym[after] == b)
        at, after = at[ok], after[ok]
        if a == b and len(at) > 1:  # of overlapping pairs every second one, from the left
            at.sort()
            after = nxt[at]
            chained = np.concatenate(([False], after[:-1] == at[1:]))
            i = np.arange(len(at))
            take = (i - np.maximum.accumulate(np.where(chained, -1, i))) % 2 == 0
            at, after = at[take], after[take]
        if not len(at):
            continue
        sym[at] = made
        alive[after] = False
        beyond = nxt[after]
        nxt[at] = beyond
        more = beyond >= 0
        prv[beyond[more]] = at[more]
        before = prv[at]
        put(np.unique(np.concatenate((before[before >= 0], at[more]))))
    return sym[alive], np.add.reduceat(np.append(alive, False).astype(np.int64), ends - sizes) * (sizes > 0)


class Encoder:
    """Words and token ids of texts; keeps the words it has met up to a bound."""

    def __init__(self, path: str = TOKENIZER, kept: int = KEPT_WORDS):
        import regex

        self.merges, self.kept = merges(path), kept
        self.find, self.find_ascii = regex.compile(WORD).findall, re.compile(ASCII_WORD).findall
        self._reset()

    def _reset(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.ids = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.chars = np.zeros(0, np.int64)

    def words(self, text: str) -> list[str]:
        """No word crosses a line end after a character in ASCII that is no white space; so lines in ASCII take the faster pattern."""
        if text.isascii():
            return self.find_ascii(text)
        out: list[str] = []
        for stretch in LINES(text):
            out += self.find_ascii(stretch) if stretch.isascii() else self.find(stretch)
        return out

    def learn(self, texts: list[str | None]) -> list[np.ndarray]:
        """The numbers of the words of each text, after the merges are replayed over the words of the block that are new."""
        if len(self.number) > self.kept:
            self._reset()
        number, known = self.number, len(self.number)
        number.default_factory = number.__len__
        out = []
        for t in texts:
            w = self.words(t) if t else []
            out.append(np.fromiter(map(number.__getitem__, w), np.int32, len(w)))
        number.default_factory = None
        if len(number) > known:
            new = list(islice(number, known, None))
            ids, count = replay(self.merges, [w.encode() for w in new])
            self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(count) - count))
            self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
            self.count = np.concatenate((self.count, count))
            self.chars = np.concatenate((self.chars, np.fromiter(map(len, new), np.int64, len(new))))
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ends of each text in the ids, and the ids of all texts."""
        split = self.learn(texts)
        w = np.concatenate(split) if split else np.zeros(0, np.int32)
        count = self.count[w]
        ends = np.cumsum(count)
        ids = self.ids[np.repeat(self.start[w] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        last = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        return np.concatenate(([0], ends))[last], ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of this worker process; it outlives tasks."""
    return Encoder(path)


def blocks(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows in blocks of at most so many bytes of text, at least one row each; a very long text is a block."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        begin, ends = 0, np.cumsum(sizes)
        while begin < len(sizes):
            base = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + size, "right")))
            yield b.slice(begin, end - begin)
            begin = end


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """doc_id and ids array<int> of every document, without special tokens; an empty list for null and empty texts.

    The strings of special tokens are ordinary text. Null keys, repeated rows and repeated keys are kept as they are; an empty table
    gives no rows; other columns are not read. A text is encoded whole, whatever its length.

    Plan: a projection of two columns and one Arrow pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in blocks(batches, 1, BLOCK_BYTES):
            ends, ids = e.encode(b.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "ids"])

    return documents.selectExpr(f"cast(`{key}` as bigint) AS k", f"`{text}` AS t").mapInArrow(run, "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), path: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens and the kept columns (as text) of every document; zero for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in blocks(batches, 1, BLOCK_BYTES):
            split = e.learn(b.column(1).to_pylist())
            n = [int(e.count[w].sum()) for w in split]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *b.columns[2:]], ["doc_id", "n_tokens", *keep])

    kept = [f"cast(`{c}` as string) AS k{i}" for i, c in enumerate(keep)]
    return documents.selectExpr(f"cast(`{key}` as bigint) AS k", f"`{text}` AS t", *kept).mapInArrow(run, ", ".join(["doc_id bigint", "n_tokens bigint", *(f"`{c}` string" for c in keep)]))
