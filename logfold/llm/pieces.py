"""Texts above a token limit, cut at natural boundaries into overlapping pieces.

Every place where a text may be cut has a strength. A sparse table over the strengths answers in constant time which boundary of a stretch is
the strongest, the last one among equals.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from logfold.llm.bpe import BLOCK_BYTES, TOKENIZER, Encoder, blocks, encoder

NONE, SENTENCE, LINE, BLOCK, CELL = range(5)
CUTS = ("word", "sentence", "line", "block", "cell", "token", "end")
#: White space beyond ASCII, marks that end a sentence before white space, and those that always do.
SPACE, STOPS, FULL_STOPS = "\x85\xa0\u3000", ".!?", "。！？"

#: Share of the capacity from which on a boundary is sought first; with 0 the strongest boundary counts, however short the piece.
SHORTEST = 0.5
#: Characters of text whose pieces are sent on at once.
OUT_CHARS = 1_000_000
TYPES = [pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.string()]
SCHEMA = "budget_id int, doc_id bigint, piece_no int, token_start bigint, token_end bigint, char_start bigint, char_end bigint, cut string, text string"


class RangeMax:
    """Sparse table: the greatest key of any stretch, from two overlapping powers of two."""

    def __init__(self, keys: np.ndarray, longest: int):
        self.levels = [keys]
        width = 1
        while 2 * width <= min(longest, len(keys)):
            low = self.levels[-1]
            self.levels.append(np.maximum(low[:-width], low[width:]))
            width *= 2

    def best(self, a: int, b: int) -> int:
        """The greatest key in [a, b)."""
        k = (b - a).bit_length() - 1
        k = min(k, len(self.levels) - 1)
        level, width = self.levels[k], 1 << k
        if 2 * width >= b - a:
            return max(int(level[a]), int(level[b - width]))
        return int(level[a : b - width + 1].max())


def _any_of(c: np.ndarray, marks: str) -> np.ndarray:
    out = c == ord(marks[0])
    for m in marks[1:]:
        out |= c == ord(m)
    return out


def strengths(text: str, cells: list[tuple[int, int]] | None) -> tuple[np.ndarray, np.ndarray]:
    """Strength of the boundary before each character and after the last; and which characters are white space."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(c)
    s = np.zeros(n + 1, np.uint8)
    space = (c == 32) | ((c >= 9) & (c <= 13)) | _any_of(c, SPACE)
    after = np.append(space[1:], True)
    s[np.flatnonzero((_any_of(c, STOPS) & after) | _any_of(c, FULL_STOPS)) + 1] = SENTENCE
    lines = np.flatnonzero(c == 10)
    s[lines + 1] = LINE
    if len(lines) > 1:  # only white space between two line ends: the first one ends a block
        filled = np.cumsum(~space)
        s[lines[:-1][filled[lines[:-1]] == filled[lines[1:]]] + 1] = BLOCK
    fences = np.fromiter(_fences(text), np.int64)
    s[fences] = BLOCK
    if cells:
        ends = np.array([e for _, e in cells if e is not None and 0 < e <= n], np.int64)
        s[ends] = CELL
    return s, space


def _fences(text: str) -> Iterator[int]:
    """Behind each line that is nothing but a closing code fence."""
    at = text.find("\n```\n")
    while at >= 0:
        yield at + 5
        at = text.find("\n```\n", at + 4)


def boundaries(text: str, chars: np.ndarray, ends: np.ndarray, cells: list[tuple[int, int]] | None, e: Encoder | None = None, number: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The natural boundaries of a text as token positions, with their strengths. chars, ends: where its words end in characters and tokens.

    A boundary inside a word of white space counts for that word's beginning, so an indentation stays with its line; one inside any
    other word for the end of the token that holds it, or ends there. e, number: the words of the text; without them it counts for the
    end of the word.
    """
    s, space = strengths(text, cells)
    at = np.flatnonzero(s[: len(text)])
    at = at[at > 0]
    w = np.searchsorted(chars, at)  # the word that ends at or behind the boundary
    inside = chars[w] != at
    begin = np.where(w > 0, chars[np.maximum(w - 1, 0)], 0)
    filled = np.concatenate(([0], np.cumsum(~space)))
    blank = inside & (filled[at] == filled[begin])
    to = np.where(blank, np.where(w > 0, ends[np.maximum(w - 1, 0)], 0), ends[w])
    if e is not None:
        for i in np.flatnonzero(inside & ~blank).tolist():
            a, k = e.start[number[w[i]]], e.count[number[w[i]]]
            held = len(text[begin[i] : at[i]].encode())
            to[i] -= k - 1 - int(np.searchsorted(np.cumsum(e.merges.token_bytes[e.ids[a : a + k]]), held))
    best = np.zeros(int(ends[-1]) + 1, np.uint8)
    np.maximum.at(best, to, s[at])
    best[0] = NONE
    where = np.flatnonzero(best)
    return where, best[where]


def cut_points(ends: np.ndarray, at: np.ndarray, strength: np.ndarray, capacity: int, overlap: int, first_half: bool = False, shortest: float = SHORTEST) -> list[tuple[int, int, int]]:
    """token_start, token_end, cut of the pieces of a text.

    A piece ends at the strongest natural boundary of the permissible stretch from ``shortest`` of the capacity on, with ``first_half`` else at that of
    what lies before, else at its last word end, else at its last token. The next one begins ``overlap`` tokens before.
    """
    total = int(ends[-1])
    if overlap >= capacity:
        raise ValueError("the overlap must be less than the capacity")
    table = RangeMax(strength.astype(np.int64) << 40 | np.arange(len(at)), capacity)
    least = max(overlap + 1, math.ceil(capacity * shortest))
    places = at.tolist()
    out, start = [], 0
    while total - start > capacity:
        low, high = start + least, start + capacity
        a, b = bisect_left(places, low), bisect_right(places, high)
        if first_half and b == a:
            a = bisect_left(places, start + overlap + 1)
        if b > a:
            key = table.best(a, b)
            end, how = places[key & (1 << 40) - 1], key >> 40
        else:
            w = int(ends.searchsorted(high, "right")) - 1
            end, how = (int(ends[w]), NONE) if w >= 0 and ends[w] >= low else (high, 5)
        out.append((start, end, how))
        start = end - overlap
    out.append((start, total, 6))
    return out


def char_positions(text: str, e: Encoder, number: np.ndarray, chars: np.ndarray, ends: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The character position of each token position; inside a character, that of the character.

    number, chars, ends: the words of the text, and where they end in characters and tokens.
    """
    w = np.searchsorted(ends, tokens, "right")
    begin = np.where(w > 0, chars[np.maximum(w - 1, 0)], 0)
    over = tokens - np.where(w > 0, ends[np.maximum(w - 1, 0)], 0)
    for i in np.flatnonzero((over > 0) & (w < len(ends))).tolist():
        word, a = text[begin[i] : chars[w[i]]], e.start[number[w[i]]]
        n = int(e.merges.token_bytes[e.ids[a : a + over[i]]].sum())
        begin[i] += n if word.isascii() else len(word.encode()[:n].decode("utf-8", "ignore"))
    return begin


def pieces(documents: DataFrame, limits: list[tuple[int, int, int]], key: str = "doc_id", text: str = "text", cells: str = "cells", path: str = TOKENIZER, with_text: bool = True, shortest: float = SHORTEST) -> DataFrame:
    """The ordered pieces of every text with more tokens than a limit: ``SCHEMA``; limits are (budget_id, capacity, overlap).

    Token positions are exact: a piece has at most capacity tokens and shares exactly overlap tokens with the next. Long pieces are
    preferred: a boundary before ``shortest`` of the capacity counts only where there is none behind. A limit whose overlap isn't less than its capacity gives no pieces (see ``packing.budget_faults``). char_start and char_end are the
    same positions in characters; where a token boundary lies inside a character, the position is that of the character. ``cut`` names
    the boundary at the piece's end (cell, block, line, sentence, word, token, or end of the text). Null, empty and smaller texts give no rows;
    null keys are kept; repeated rows are cut each. Without cells there are no ends of cells.

    Plan: one Arrow pass over three columns, no shuffle.
    """
    if not limits:
        return documents.sparkSession.createDataFrame([], SCHEMA)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    limits = [x for x in limits if 0 <= x[2] < x[1]]
    least = min((c for _, c, _ in limits), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in blocks(batches, 1, BLOCK_BYTES):
            keys, texts, spans = (c.to_pylist() for c in b.columns)
            numbers = e.learn(texts)
            cols: list[list] = [[] for _ in names]
            held = 0
            for k, t, span, number in zip(keys, texts, spans, numbers):
                tokens = e.count[number]
                if not t or tokens.sum() <= least:
                    continue
                chars, ends = np.cumsum(e.chars[number]), np.cumsum(tokens)
                at, strength = boundaries(t, chars, ends, [(x["char_start"], x["char_end"]) for x in span if x] if span else None, e, number)
                total = int(ends[-1])
                for budget, capacity, overlap in limits:
                    if total <= capacity:
                        continue
                    found = cut_points(ends, at, strength, capacity, overlap, True, shortest)
                    starts, stops = np.array([f[0] for f in found]), np.array([f[1] for f in found])
                    begin, end = (char_positions(t, e, number, chars, ends, x) for x in (starts, stops))
                    n = len(found)
                    for col, values in zip(cols, ([budget] * n, [k] * n, range(n), starts.tolist(), stops.tolist(), begin.tolist(), end.tolist(), [CUTS[f[2]] for f in found], [t[x:y] for x, y in zip(begin.tolist(), end.tolist())] if with_text else [None] * n)):
                        col += values
                held += len(t)
                if held >= OUT_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, TYPES)], names)
                    cols, held = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, TYPES)], names)

    return documents.selectExpr(f"cast(`{key}` as bigint) AS k", f"`{text}` AS t", f"transform(`{cells}`, x -> named_struct('char_start', x.char_start, 'char_end', x.char_end)) AS c").mapInArrow(run, SCHEMA)


def checks(found: DataFrame, limits: DataFrame) -> DataFrame:
    """Of each budget: pieces with more tokens than its capacity, neighbours that don't share exactly its overlap, and texts whose first piece doesn't begin at 0 or whose last isn't the end."""
    w = W.partitionBy("budget_id", "doc_id").orderBy("piece_no")
    p = found.join(limits.select(F.col("budget_id").alias("_b"), "capacity_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("overlap")), F.col("budget_id") == F.col("_b"))
    p = p.select("budget_id", "capacity_tokens", "overlap", "token_start", "token_end", "cut", F.lag("token_end").over(w).alias("before"), F.lead("token_start").over(w).alias("after"))
    ends = (F.col("before").isNull() & (F.col("token_start") != 0)) | (F.col("after").isNull() != (F.col("cut") == "end"))
    return p.groupBy("budget_id").agg(F.count_if(F.col("token_end") - F.col("token_start") > F.col("capacity_tokens")).alias("too_long"), F.count_if(F.col("before") - F.col("token_start") != F.col("overlap")).alias("wrong_overlap"), F.count_if(ends).alias("wrong_ends"))
