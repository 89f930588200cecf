"""Nested JSON records as flat, linked rows, by structural indexing of whole batches.

A batch of texts is one byte array. Bitmaps of quotes, brackets and delimiters are built over it, prefix sums give string parity and nesting
depth, and sorted positions by depth give each record's parent, key or index. No text is walked byte by byte in Python.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

QUOTE, BACKSLASH, COMMA, COLON = 34, 92, 44, 58
OPEN_OBJECT, CLOSE_OBJECT, OPEN_ARRAY, CLOSE_ARRAY = 123, 125, 91, 93

#: Bytes of text that are indexed at once; a longer text is indexed alone.
BLOCK_BYTES = 4 << 20


def _strict(text: str) -> bool:
    def no(x: str) -> None:
        raise ValueError(x)

    try:
        json.loads(text, parse_constant=no, parse_int=len)
        return True
    except (ValueError, RecursionError):
        return False


class Structure:
    """The structural index of a block of texts: positions are byte offsets into ``data``."""

    def __init__(self, texts: list[bytes]):
        self.data = data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = starts = np.concatenate(([0], np.cumsum(sizes[:-1] + 1))) if len(texts) else np.zeros(0, np.int64)
        n = len(data)
        at = np.arange(n, dtype=np.int64)

        quote = data == QUOTE
        slash = data == BACKSLASH
        if slash.any():  # a quote after an odd run of backslashes is none
            q = np.flatnonzero(quote)
            last_other = np.maximum.accumulate(np.where(slash, -1, at))
            run = np.where(q > 0, q - 1 - last_other[q - 1], 0)
            quote[q[run % 2 == 1]] = False
        self.quotes = np.flatnonzero(quote)

        row_of = lambda p: np.searchsorted(starts, p, "right") - 1
        candidates = np.flatnonzero((data == OPEN_OBJECT) | (data == CLOSE_OBJECT) | (data == OPEN_ARRAY) | (data == CLOSE_ARRAY) | (data == COMMA) | (data == COLON))
        rows = row_of(candidates)
        first_quote = np.searchsorted(self.quotes, starts)
        parity = (np.searchsorted(self.quotes, candidates) - first_quote[rows]) % 2
        self.pos, self.row = candidates[parity == 0], rows[parity == 0]
        self.kind = data[self.pos]
        step = np.select([(self.kind == OPEN_OBJECT) | (self.kind == OPEN_ARRAY), (self.kind == CLOSE_OBJECT) | (self.kind == CLOSE_ARRAY)], [1, -1], 0)
        level = np.cumsum(step)
        first_token = np.searchsorted(self.pos, starts)
        base = np.where(first_token > 0, level[np.maximum(first_token - 1, 0)], 0) if len(level) else np.zeros(len(starts), np.int64)
        level = level - base[self.row]
        #: Depth inside the container a token belongs to: an opening bracket counts from its inside, a closing one up to it.
        self.depth = level + (step == -1)
        self._check(level, step, sizes)

    def _check(self, level: np.ndarray, step: np.ndarray, sizes: np.ndarray) -> None:
        """bad: rows whose brackets don't balance or match, or with an open quote."""
        n = len(self.starts)
        self.bad = np.zeros(n, bool)
        ends = self.starts + sizes
        self.bad |= (np.searchsorted(self.quotes, ends) - np.searchsorted(self.quotes, self.starts)) % 2 == 1
        self.bad[self.row[level < 0]] = True
        last = np.searchsorted(self.pos, ends) - 1
        has = last >= np.searchsorted(self.pos, self.starts)
        self.bad[has] |= level[last[has]] != 0
        ok = ~self.bad[self.row]
        bracket = ok & (step != 0)
        order = np.lexsort((self.pos[bracket], self.depth[bracket]))  # at one depth, opening and closing brackets alternate
        kinds = self.kind[bracket][order]
        opened, closed = kinds[0::2], kinds[1::2]
        odd = closed != opened + 2
        self.bad[self.row[bracket][order][0::2][odd]] = True

    def records(self) -> tuple[list[int], list[str], list[str], list[tuple[int, int]]]:
        """Of every object that is an element of an array: text number, path, path of the enclosing record ('' if none), byte span."""
        keep = ~self.bad[self.row]
        pos, kind, depth, row = self.pos[keep], self.kind[keep], self.depth[keep], self.row[keep]
        opening = (kind == OPEN_OBJECT) | (kind == OPEN_ARRAY)
        deepest = int(depth.max()) if len(depth) else 0
        by_level = []
        tokens = np.argsort(depth, kind="stable")
        bounds = np.searchsorted(depth[tokens], np.arange(1, deepest + 2))
        for d in range(deepest):
            t = tokens[bounds[d] : bounds[d + 1]]
            o = t[opening[t]]
            level = {"pos": pos[o], "object": kind[o] == OPEN_OBJECT, "row": row[o], "commas": pos[t[kind[t] == COMMA]], "colons": pos[t[kind[t] == COLON]], "ends": pos[t[(kind[t] == CLOSE_OBJECT) | (kind[t] == CLOSE_ARRAY)]]}
            if d:
                up = by_level[-1]
                level["parent"] = np.searchsorted(up["pos"], level["pos"]) - 1
                level["record"] = level["object"] & ~up["object"][level["parent"]]
            else:
                level["record"] = np.zeros(len(o), bool)
            by_level.append(level)
        for d in range(deepest - 1, -1, -1):  # only containers on the way to a record need a path
            level = by_level[d]
            needed = level.setdefault("needed", np.zeros(len(level["pos"]), bool))
            needed |= level["record"]
            if d:
                up = by_level[d - 1].setdefault("needed", np.zeros(len(by_level[d - 1]["pos"]), bool))
                up[level["parent"][needed]] = True

        found: list[tuple[int, int, str, str, int]] = []
        raw, quotes = self.data, self.quotes
        paths: dict[int, str] = {}
        owner: dict[int, str] = {}
        for d, level in enumerate(by_level):
            mine = np.flatnonzero(level["needed"])
            if not d:
                paths, owner = dict.fromkeys(mine.tolist(), ""), dict.fromkeys(mine.tolist(), "")
                continue
            up = by_level[d - 1]
            parent, at = level["parent"][mine], level["pos"][mine]
            in_array = ~up["object"][parent]
            index = np.searchsorted(up["commas"], at) - np.searchsorted(up["commas"], up["pos"][parent])
            colon = up["colons"][np.maximum(np.searchsorted(up["colons"], at) - 1, 0)] if len(up["colons"]) else np.zeros(len(mine), np.int64)
            q = np.maximum(np.searchsorted(quotes, colon) - 1, 1)
            begin, end = (quotes[q - 1] + 1, quotes[q]) if len(quotes) > 1 else (colon, colon)
            stop = level["ends"][mine]  # the k-th opening bracket of a depth is closed by its k-th closing one
            rec = level["record"][mine]
            new_paths, new_owner = {}, {}
            for i, p, arr, ix, b, e, r, a, z, rw in zip(mine.tolist(), parent.tolist(), in_array.tolist(), index.tolist(), begin.tolist(), end.tolist(), rec.tolist(), at.tolist(), stop.tolist(), level["row"][mine].tolist()):
                if arr:
                    path = f"{paths[p]}[{ix}]"
                else:
                    text = raw[b:e].tobytes()
                    name = json.loads(b'"' + text + b'"') if b"\\" in text else text.decode("utf-8", "replace")
                    path = f"{paths[p]}.{name}" if d > 1 else name
                new_paths[i] = path
                if r:
                    found.append((rw, a, path, owner[p], z + 1))
                    new_owner[i] = path
                else:
                    new_owner[i] = owner[p]
            paths, owner = new_paths, new_owner
        found.sort()
        return [f[0] for f in found], [f[2] for f in found], [f[3] for f in found], [(f[1], f[4]) for f in found]


def flatten(keys: list, texts: list[bytes | None], with_text: bool) -> tuple[list, list, list, list | None]:
    """The linked records of a block. Texts with records are finally held against the grammar; one that is no JSON gives no rows."""
    given = [i for i, t in enumerate(texts) if t is not None]
    index = Structure([texts[i] for i in given])
    rows, paths, parents, spans = index.records()
    valid = {r: _strict(texts[given[r]].decode("utf-8", "replace")) for r in set(rows)}
    good = [i for i, r in enumerate(rows) if valid[r]]
    body = [index.data[spans[i][0] : spans[i][1]].tobytes().decode("utf-8", "replace") for i in good] if with_text else None
    return [keys[given[rows[i]]] for i in good], [paths[i] for i in good], [parents[i] for i in good], body


def linked_records(df: DataFrame, key: str, json_text: str, with_text: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per object that is an element of an array at any depth: row_key, record_path, parent_path, and record if ``with_text``.

    record_path leads from the root of the text (keys joined by ``.``, indexes as ``[i]``); parent_path is that of the nearest enclosing
    object that is itself an array element, or empty. Texts inside the JSON stay texts. Null, empty and invalid texts give no rows; a
    null key is kept as the key. Repeated rows give repeated records. An empty table gives none. Keys that occur twice in an object are
    both followed. Very long texts are indexed alone.

    Plan: a projection of two columns and one Arrow pass over each partition, without a shuffle.
    """
    schema = "row_key bigint, record_path string, parent_path string" + (", record string" if with_text else "")
    names = ["row_key", "record_path", "parent_path"] + ["record"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            begin, held = 0, 0
            for i in range(len(texts) + 1):
                if i == len(texts) or (held and held + len(texts[i] or b"") > block_bytes):
                    if i > begin:
                        k, p, q, body = flatten(keys[begin:i], texts[begin:i], with_text)
                        if k:
                            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(p, pa.string()), pa.array(q, pa.string())] + ([pa.array(body, pa.string())] if with_text else []), names)
                    begin, held = i, 0
                if i < len(texts):
                    held += len(texts[i] or b"")

    return df.selectExpr(f"cast(`{key}` as bigint) AS k", f"`{json_text}` AS t").where("instr(t, '[') > 0").mapInArrow(run, schema)
