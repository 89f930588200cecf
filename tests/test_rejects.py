import json
import random

import pytest

from logfold.operators.edits import DROP, FIELDS, csv_edits, csv_tokens, json_edits, json_tokens
from logfold.operators.rejects import csv_fields, load_json, parse_batch, parse_line, parse_lines

OK = {"request_id": "r", "command": "create_user", "payload": {"user_id": "u"}, "timestamp": "t"}


def line(**x):
    return json.dumps({k: v for k, v in (OK | x).items() if v is not ...})


def event(p):
    return line(command="append_event", payload=p)


PASS = {"metric_family": "m", "cohort": "c", "script_name": "s", "pass_number": 1}

CASES = [
    (line(), None), (" \t" + line() + "\t", None), (line(extra=1), None), (line(request_id=None, timestamp=None), None),
    (line() + "x", "syntax"), ("[1]", "syntax"), ("1", "syntax"), (line()[:-1], "syntax"), ("{'a':1}", "syntax"), (line(extra=float("nan")), "syntax"), (line() + line(), "syntax"), ('{"a":"\x01"}', "syntax"), ('{"a":01}', "syntax"), ("nul", "syntax"),
    (line(command=...), "field_count"), (line(timestamp=...), "field_count"), ("{}", "field_count"),
    (line(command="Create_user"), "command"), (line(command=None), "command"), (line(command=["create_user"]), "command"), (line(command="create_user "), "command"),
    (line(payload=None), "payload"), (line(payload="{}"), "payload"), (line(payload={}), "payload"), (line(payload={"user_id": ""}), "payload"), (line(payload={"user_id": 3}), "payload"), (line(payload={"user_id": "u", "data": None}), "payload"), (line(payload={"user_id": "u", "data": []}), "payload"),
    (event({"event_type": "e"}), None), (event({"event_type": "e", "data": {}}), None), (event({"user_id": "e"}), "payload"),
    (line(command="LOG_EXPLORATORY_PASS", payload=PASS), None), *((line(command="LOG_EXPLORATORY_PASS", payload=PASS | {"pass_number": n}), "payload") for n in (0, 4, True, "1", 1.0, None)), (line(command="LOG_EXPLORATORY_PASS", payload=PASS | {"cohort": ""}), "payload"),
    *((line(command="LOG_SESSION_STARTED", payload={"event_version": v}), None) for v in (1, -2, "1", "2.5")), (line(command="LOG_SESSION_STARTED", payload={}), None), *((line(command="LOG_SESSION_STARTED", payload={"event_version": v}), "payload") for v in (1.5, True, None, "", "v1", "1.0.3", ".5")),
]


@pytest.mark.parametrize("text,reason", CASES)
def test_jsonl(text, reason):
    got = parse_line("jsonl", text)
    assert got[1] == reason and got[0] == ("ok" if reason is None else "rejected")


CSV = [
    ('r,create_user,"{""user_id"":""u""}",t', None), ('"r","create_user","{""user_id"": ""u, v""}",""', None), (",create_user,\"{\"\"user_id\"\":\"\"u\"\"}\",", None),
    ('r,create_user,"{""user_id"":""u""}', "syntax"), ('r,cre"ate_user,{},t', "syntax"), ('"r"x,create_user,{},t', "syntax"), (' "r",create_user,{},t', "syntax"),
    ("r,create_user,{}", "field_count"), ("r,create_user,{},t,", "field_count"), ("x", "field_count"),
    ('r,drop,"{""user_id"":""u""}",t', "command"), ("r,,{},t", "command"), ("r,create_user,,t", "payload"), ("r,create_user,[],t", "payload"), ("r,create_user,{user_id:1},t", "payload"),
]


@pytest.mark.parametrize("text,reason", CSV)
def test_csv(text, reason):
    assert parse_line("csv", text)[1] == reason


def test_quotes_in_csv_values_come_out():
    assert parse_line("csv", 'a""b,x,y,z')[1] == "syntax"
    assert csv_fields('"a""b",,c') == ['a"b', "", "c"]


def mend(tokens, edits):
    out, by = [], {}
    for e in edits:
        by.setdefault(e.token, []).append(e)
    for i in range(len(tokens) + 1):
        out += [e.text for e in by.get(i, []) if e.what == "insert"]
        if i < len(tokens) and all(e.what == "insert" for e in by.get(i, [])):
            out.append(tokens[i])
    return "".join(out)


def object_or_none(text):
    try:
        v = load_json(text)
    except ValueError:
        return None
    return v if isinstance(v, dict) else None


def json_cost(edits):
    return sum(DROP if e.what == "drop" else 1 for e in edits)


def brute(tokens, good, chars, most, drop=None):
    """The least cost of edits that make a good text, by trying them all."""
    levels = {0: {tuple(tokens)}}
    seen = set()
    for cost in range(most + 1):
        for t in levels.get(cost, ()):
            if t in seen:
                continue
            seen.add(t)
            if good("".join(t)):
                return cost
            for i in range(len(t) + 1):
                levels.setdefault(cost + 1, set()).update(t[:i] + (c,) + t[i:] for c in chars)
                if i < len(t) and t[i] in chars:
                    levels.setdefault(cost + 1, set()).add(t[:i] + t[i + 1 :])
                elif i < len(t) and drop:
                    levels.setdefault(cost + drop, set()).add(t[:i] + t[i + 1 :])
    return None


def test_edits_mend_damaged_lines():
    rnd = random.Random(4)
    good = line(payload={"user_id": "u", "data": {"a": [1, {"b": "c"}], "d": None}})
    for _ in range(300):
        bad = good
        for _ in range(rnd.randint(1, 3)):
            i = rnd.randrange(len(bad))
            bad = bad[:i] + rnd.choice(["", *'{}[]:,"', "x", "\x01"]) + bad[i + rnd.randint(0, 1) :]
        tokens, kinds = json_tokens(bad)
        edits = json_edits([(tokens, kinds)])[0]
        assert (edits == []) == (object_or_none(bad) is not None)
        assert object_or_none(mend(tokens, edits)) is not None
    record = '"r","create_user","{""user_id"":""u""}","t"'
    for i in [k for k, c in enumerate(record) if c in '",']:
        bad = record[:i] + record[i + 1 :]
        tokens, kinds = csv_tokens(bad)
        edits = csv_edits([(tokens, kinds)])[0]
        assert 0 < len(edits) <= 2 and len(csv_fields(mend(tokens, edits))) == 4


def test_json_edits_cost_least_by_brute_force():
    rnd = random.Random(9)
    for _ in range(50):
        text = "".join(rnd.choice([*'{}[]:,"', " ", "1", "x", "\t"]) for _ in range(rnd.randint(1, 5)))
        tokens, kinds = json_tokens(text)
        edits = json_edits([(tokens, kinds)])[0]
        least = brute(tokens, lambda t: object_or_none(t) is not None, '"{}[]:,', 3, DROP)
        assert json_cost(edits) == least if least is not None else json_cost(edits) > 3, text


def test_edits_of_quoting_are_fewest_by_brute_force():
    """Fewest mendings of the quoting first, then of the number of fields."""
    rnd = random.Random(9)
    for _ in range(100):
        tokens, kinds = csv_tokens("".join(rnd.choice(['"', ",", "x"]) for _ in range(rnd.randint(1, 6))))
        edits = csv_edits([(tokens, kinds)])[0]
        least = brute(tokens, lambda t: csv_fields(t) is not None, '",', 2)
        quoting = sum(e.quoting for e in edits)
        assert (quoting == 0) == (least == 0) and (least is None or quoting <= 2 * least)
        if quoting == 0:
            assert sum(len(e.text) for e in edits) == abs(len(csv_fields("".join(tokens))) - FIELDS)


def test_frame_with_nulls_blanks_long_lines_and_clashes(spark):
    long = line(payload={"user_id": "u" * 2_000_000})
    data = [(1, "jsonl", None), (2, "jsonl", " \t "), (3, "csv", ""), (4, None, "x"), (5, "xml", "x"), (6, "jsonl", long), (7, "jsonl", long[:-1]), (8, "jsonl", line()), (8, "jsonl", line()), (None, "jsonl", "{}")]
    df = spark.createDataFrame([(*r, "clash") for r in data], "line_id bigint, fmt string, line string, status string")
    got = sorted(((r[0] or 0, r[1], r[2]) for r in parse_lines(df).collect()), key=str)
    assert got == sorted([(0, "rejected", "field_count"), (1, "blank", None), (2, "blank", None), (3, "blank", None), (4, "rejected", "syntax"), (5, "rejected", "syntax"), (6, "ok", None), (7, "rejected", "syntax"), (8, "ok", None), (8, "ok", None)], key=str)
    assert parse_lines(df.limit(0)).count() == 0


def test_any_number_of_edits():
    record = ",".join('"a"' for _ in range(12))
    assert parse_line("csv", record)[1:3] == ("field_count", "; ".join(f"delete , at {3 + 4 * i}" for i in range(3, 11))) or parse_line("csv", record)[2].count("delete ,") == 8
    for bad in ('r,create_user,{"user_id": "u", "data": {"a": "b", "c": "d"}},t', '"' * 9 + "x" + ',"y"' * 6 + "z"):
        tokens, kinds = csv_tokens(bad)
        edits = csv_edits([(tokens, kinds)])[0]
        assert len(edits) > 3 and parse_line("csv", bad)[1] == "syntax" and csv_fields(mend(tokens, [e for e in edits if e.quoting])) is not None
    for bad in ('[{"a":' * 60, "{" * 40, '{"a":' * 8 + "]" * 8, '{"a":[' * 5 + '"' + "]}" * 5 + '"' * 8):
        tokens, kinds = json_tokens(bad)
        edits = json_edits([(tokens, kinds)])[0]
        assert len(edits) > 2 and object_or_none(mend(tokens, edits)) is not None and parse_line("jsonl", bad)[1] == "syntax"


def test_words_that_no_quotes_mend_are_dropped():
    assert parse_line("jsonl", '{"a": "b\x01"}')[2] == "drop b\x01 at 7"
    assert parse_line("jsonl", line() + " xyz")[2].startswith("drop xyz")
    assert parse_line("jsonl", '{"a": NaN}')[2] == 'insert " at 6; insert " at 9'


def test_a_batch_gives_each_line_what_it_gives_alone():
    rnd = random.Random(12)
    good = line(payload={"user_id": "u", "data": {"a": [1, {"b": "c"}], "d": None}})
    record = '"r","create_user","{""user_id"":""u""}",t'
    batch = []
    for _ in range(400):
        fmt, text = rnd.choice([("jsonl", good), ("csv", record)])
        for _ in range(rnd.randint(0, 2)):
            i = rnd.randrange(len(text))
            text = text[:i] + rnd.choice(["", *'{}[]:,"x']) + text[i + rnd.randint(0, 1) :]
        batch.append((fmt, text))
    got = parse_batch([f for f, _ in batch], [t for _, t in batch])
    assert got == [parse_line(f, t) for f, t in batch]
    for (fmt, text), r in zip(batch, got):
        if fmt == "jsonl":
            assert (object_or_none(text) is None) == (r[1] == "syntax")
        else:
            assert (csv_fields(text) is None) == (r[1] == "syntax")
    assert {("jsonl", "syntax"), ("csv", "syntax"), ("csv", "field_count")} <= {(f, r[1]) for (f, _), r in zip(batch, got)}
    assert parse_line("jsonl", "[" * 200_000 + "]" * 200_000)[1:3] == ("syntax", "nested too deeply to be read")
    assert parse_line("jsonl", "[1]")[1:3] == ("syntax", "insert an object around the value")
