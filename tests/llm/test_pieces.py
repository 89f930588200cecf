import os
import random

import numpy as np
import pytest

from logfold.llm import bpe
from logfold.llm.pieces import BLOCK, CELL, LINE, SENTENCE, RangeMax, boundaries, char_positions, cut_points, pieces

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.TOKENIZER), reason="no tokenizer file")


def test_range_max_against_brute_force():
    rnd = random.Random(1)
    keys = np.array([rnd.randint(0, 5) << 40 | i for i in range(300)])
    t = RangeMax(keys, 64)
    for _ in range(2000):
        a = rnd.randrange(300)
        b = rnd.randint(a + 1, min(300, a + 64))
        assert t.best(a, b) == keys[a:b].max()
    assert RangeMax(keys, 4).best(0, 300) == keys.max()


def test_cut_points_against_brute_force():
    rnd = random.Random(2)
    for _ in range(200):
        ends = np.cumsum([rnd.randint(1, 3) if rnd.random() < 0.98 else 90 for _ in range(rnd.randint(1, 400))])
        strength = {int(e): rnd.randint(1, 4) for e in ends if rnd.random() < 0.2}
        at = np.array(sorted(strength), np.int64)
        capacity, overlap = rnd.choice([(40, 0), (40, 9), (33, 30)])
        got = cut_points(ends, at, np.array([strength[int(x)] for x in at], np.uint8), capacity, overlap)
        want, start, total = [], 0, int(ends[-1])
        while total - start > capacity:
            low, high = start + max(overlap + 1, (capacity + 1) // 2), start + capacity
            natural = [x for x in strength if low <= x <= high]
            words = [int(x) for x in ends if low <= x <= high]
            end = max(natural, key=lambda x: (strength[x], x)) if natural else max(words) if words else high
            want.append((start, end))
            start = end - overlap
        want.append((start, total))
        assert [g[:2] for g in got] == want


def test_kinds_of_boundaries():
    e = bpe.Encoder()
    text = "One two. Three\nfour\n\n    five\n```\ncode()\n```\nend。又 x"
    number = e.learn([text])[0]
    chars, ends = np.cumsum(e.chars[number]), np.cumsum(e.count[number])
    at, strength = boundaries(text, chars, ends, [(0, text.index("end"))])
    kind = {text[: int(chars[np.searchsorted(ends, a)])]: s for a, s in zip(at, strength)}
    upto = lambda part: text[: text.index(part) + len(part)]
    assert kind[upto("two.")] == SENTENCE and kind[upto("Three\n")] == LINE and kind[upto("end。")] == SENTENCE
    assert kind[upto("four")] == BLOCK and kind[upto("code()\n```\n")] == CELL


SCHEMA = "doc_id bigint, text string, cells array<struct<cell_no:int,kind:string,exec_count:int,char_start:int,char_end:int>>, cut string, piece_no string"


def test_frame(spark):
    rnd = random.Random(3)
    words = ["alpha", "beta", "gamma.", "漢字。", "delta\n", "x = f(1)\n", "\n\n", "é!", "    "]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 900))) for _ in range(30)] + [None, "", "short", "q" * 5000, "ok " * 30_000]
    data = [(i, t, None if i % 3 else [(0, "code", 1, 0, len(t or "") // 2), None, (1, None, None, None, None)], "clash", "clash") for i, t in enumerate(texts)] + [(None, texts[0] + " tail" * 400, None, "c", "c")]
    df = spark.createDataFrame(data, SCHEMA)
    limits = [(1, 64, 0), (2, 128, 16), (3, 1024, 100)]
    e = bpe.Encoder()
    got = {}
    for r in pieces(df, limits).collect():
        got.setdefault((r["budget_id"], r["doc_id"]), []).append(r)
    for doc, text, *_ in data:
        number = e.learn([text])[0]
        n = int(e.count[number].sum())
        for b, capacity, overlap in limits:
            p = sorted(got.pop((b, doc), []), key=lambda r: r["piece_no"])
            assert bool(p) == (n > capacity)
            if not p:
                continue
            assert [r["piece_no"] for r in p] == list(range(len(p))) and p[0]["token_start"] == 0 and p[-1]["token_end"] == n and p[-1]["char_end"] == len(text)
            assert all(0 < r["token_end"] - r["token_start"] <= capacity for r in p)
            assert all(x["token_end"] - y["token_start"] == overlap for x, y in zip(p, p[1:]))
            assert all(r["text"] == text[r["char_start"] : r["char_end"]] for r in p)
            assert p[-1]["cut"] == "end" and {r["cut"] for r in p[:-1]} <= {"cell", "block", "line", "sentence", "word", "token"}
    assert not got
    assert pieces(df.limit(0), limits).count() == 0 and pieces(df, []).count() == 0


def test_char_positions_are_those_of_the_tokens():
    from tokenizers import Tokenizer

    tok, e = Tokenizer.from_file(bpe.TOKENIZER), bpe.Encoder()
    for text in ("internationalization of Überraschungen 漢字漢 naïveté 😀😀 x", "plain words only here", "éé"):
        number = e.learn([text])[0]
        chars, ends = np.cumsum(e.chars[number]), np.cumsum(e.count[number])
        ids = tok.encode(text, add_special_tokens=False).ids
        sizes = [e.merges.token_bytes[i] for i in ids]
        want = [len(text.encode()[: sum(sizes[:k])].decode("utf-8", "ignore")) for k in range(len(ids) + 1)]
        assert char_positions(text, e, number, chars, ends, np.arange(len(ids) + 1)).tolist() == want


def test_the_overlap_must_be_smaller():
    with pytest.raises(ValueError):
        cut_points(np.array([5]), np.zeros(0, np.int64), np.zeros(0, np.uint8), 4, 4)


def test_cells_of_a_notebook_in_json_end_inside_words():
    import json

    e = bpe.Encoder()
    sources = ["import numpy as np", "x = f(1)", "end of it", "naïve 漢字"]
    text, cells = '{"cells":[', []
    for i, source in enumerate(sources):
        cell = json.dumps({"cell_type": "code", "source": [source], "outputs": [[]]}, ensure_ascii=False, separators=(",", ":"))
        cells.append((len(text), len(text) + len(cell)))
        text += cell + ("," if i + 1 < len(sources) else '],"nbformat":4}')
    text += "（漢字。」)"  # a full stop inside a word, of more bytes than characters
    number = e.learn([text])[0]
    chars, ends = np.cumsum(e.chars[number]), np.cumsum(e.count[number])
    assert not {c for _, c in cells} & set(chars.tolist())
    sizes = np.cumsum(e.merges.token_bytes[e.encode([text])[1]])
    want = {int(np.searchsorted(sizes, len(text[:c].encode()))) + 1: CELL for _, c in cells} | {int(np.searchsorted(sizes, len(text[: text.index("。") + 1].encode()))) + 1: SENTENCE}
    at, strength = boundaries(text, chars, ends, cells, e, number)
    assert dict(zip(at.tolist(), strength.tolist())) == want and len(want) == 5
    cuts = cut_points(ends, at, strength, 40, 4)
    assert {c[2] for c in cuts[:-1]} == {CELL}
    at, strength = boundaries(text, chars, ends, cells)
    assert set(at.tolist()) <= set(ends.tolist()) and (strength == CELL).sum() == 4


def test_a_boundary_of_the_first_half_is_used_against_brute_force():
    rnd = random.Random(4)
    early = 0
    for _ in range(200):
        ends = np.cumsum([rnd.randint(1, 3) if rnd.random() < 0.98 else 90 for _ in range(rnd.randint(1, 400))])
        strength = {int(e): rnd.randint(1, 4) for e in ends if rnd.random() < 0.07}
        at = np.array(sorted(strength), np.int64)
        capacity, overlap = rnd.choice([(40, 0), (40, 9), (33, 30)])
        got = cut_points(ends, at, np.array([strength[int(x)] for x in at], np.uint8), capacity, overlap, first_half=True)
        want, start, total = [], 0, int(ends[-1])
        while total - start > capacity:
            low, high = start + max(overlap + 1, (capacity + 1) // 2), start + capacity
            natural = [x for x in strength if start + overlap < x <= high]
            words = [int(x) for x in ends if low <= x <= high]
            end = max(natural, key=lambda x: (x >= low, strength[x], x)) if natural else max(words) if words else high
            early += end < low
            want.append((start, end))
            start = end - overlap
        want.append((start, total))
        assert [g[:2] for g in got] == want
    assert early > 100


def test_a_short_cell_before_a_long_output_ends_its_piece(spark):
    text = "x = f(1)\n" + "q7" * 400
    df = spark.createDataFrame([(1, text, [(0, "code", 1, 0, 9)], "c", "c")], SCHEMA)
    first = pieces(df, [(1, 64, 2)]).orderBy("piece_no").first()
    assert (first["cut"], first["char_end"], first["text"]) == ("cell", 9, text[:9])
