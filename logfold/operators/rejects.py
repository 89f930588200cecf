"""Log lines split into valid entries and rejected lines, by a minimum-cost error parse.

The grammar of a line (JSON object, or RFC 4180 record of four fields) is an automaton over the line's tokens (``edits``). A line that parses at no
cost and whose values are of the right types loads. The compiled parsers of the same grammars find the parses at no cost; all other lines
take the dynamic programming over edits, and the edits of the cheapest parse state the reason: an edit of the syntax, or delimiters
and members that are missing or too many.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from logfold.operators.edits import Edit, csv_edits, csv_tokens, json_edits, json_tokens, say

KEYS = ("request_id", "command", "payload", "timestamp")
COMMANDS = ("create_user", "append_event", "LOG_EXPLORATORY_PASS", "LOG_SESSION_STARTED")

#: The record grammar of RFC 4180 at no cost, one field at a time.
CSV_FIELD = re.compile(r'"((?:[^"]|"")*+)"(?=,|\Z)|([^",]*+)(?=,|\Z)')
VERSION = re.compile(r"[0-9]+(?:\.[0-9]+)?")


def _no(x: str) -> None:
    raise ValueError(x)


class TooDeep(ValueError):
    """A text that is nested too deeply to be read."""


def load_json(text: str):
    """A JSON text (RFC 8259) as Python values; raises ValueError."""
    try:
        return json.loads(text, parse_constant=_no)
    except RecursionError:
        raise TooDeep("nested too deeply to be read") from None


def csv_fields(line: str) -> list[str] | None:
    """The fields of a record whose quoting is right, whatever their number; None if the quoting is broken."""
    fields, at = [], 0
    while m := CSV_FIELD.match(line, at):
        fields.append(m[1].replace('""', '"') if m[1] is not None else m[2])
        at = m.end()
        if at == len(line):
            return fields
        at += 1
    return None


def is_text(x) -> bool:
    return isinstance(x, str) and x != ""


def is_integer(x) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def payload_fault(command: str, p) -> str | None:
    """What is wrong with a payload, or None."""
    if not isinstance(p, dict):
        return "payload is no object"
    if command in ("create_user", "append_event"):
        name = "user_id" if command == "create_user" else "event_type"
        if not is_text(p.get(name)):
            return f"{name} is no non-empty string"
        if "data" in p and not isinstance(p["data"], dict):
            return "data is no object"
    elif command == "LOG_EXPLORATORY_PASS":
        for name in ("metric_family", "cohort", "script_name"):
            if not is_text(p.get(name)):
                return f"{name} is no non-empty string"
        if not is_integer(p.get("pass_number")) or not 1 <= p["pass_number"] <= 3:
            return "pass_number is no integer from 1 to 3"
    elif "event_version" in p:
        v = p["event_version"]
        if not (is_integer(v) or isinstance(v, str) and VERSION.fullmatch(v)):
            return "event_version is no version"
    return None


def _text(x) -> str | None:
    return x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False)


#: A line without a reason: status, reason, detail and the four members of an entry.
BLANK = ("blank", *[None] * 6)


def _reject(reason: str, detail: str) -> tuple:
    return ("rejected", reason, detail, None, None, None, None)


def _entry(rid, command, payload, ts, written: bool) -> tuple:
    """A line that parses at no cost, after the checks of its values. written: the payload is still JSON text."""
    if command not in COMMANDS if isinstance(command, str) else True:
        return _reject("command", f"unknown command {_text(command)!r}")
    if written:
        try:
            payload = load_json(payload)
        except ValueError:
            return _reject("payload", "payload is no JSON")
    if fault := payload_fault(command, payload):
        return _reject("payload", fault)
    return ("ok", None, None, _text(rid), command, json.dumps(payload, ensure_ascii=False, separators=(",", ":")), _text(ts))


def _at_no_cost(fmt: str | None, line: str | None) -> tuple | None:
    """The outcome of a line that parses at no cost (or isn't parsed at all); None if it needs edits."""
    if line is None or not line.strip(" \t"):
        return BLANK
    if fmt == "jsonl":
        try:
            v = load_json(line.strip(" \t"))
        except TooDeep as e:
            return _reject("syntax", str(e))
        except ValueError:
            return None
        if not isinstance(v, dict):
            return _reject("syntax", "insert an object around the value")
        if absent := [k for k in KEYS if k not in v]:  # members are inserted whole
            return _reject("field_count", "insert " + ", ".join(absent))
        return _entry(*(v[k] for k in KEYS), False)
    if fmt == "csv":
        fields = csv_fields(line)
        return _entry(*fields, True) if fields is not None and len(fields) == len(KEYS) else None
    return _reject("syntax", "unknown format")


def _reason(edits: list[Edit]) -> str:
    """What the edits of a cheapest parse mend."""
    return "syntax" if any(e.quoting for e in edits) else "field_count"


def parse_batch(fmts: list[str | None], lines: list[str | None]) -> list[tuple]:
    """Of each line: status (ok, rejected, blank), reason, detail, request_id, command, payload, timestamp."""
    out = [_at_no_cost(f, x) for f, x in zip(fmts, lines)]
    for fmt, tokenize, search in (("jsonl", lambda x: json_tokens(x.strip(" \t")), json_edits), ("csv", csv_tokens, csv_edits)):
        at = [i for i, r in enumerate(out) if r is None and fmts[i] == fmt]
        tokenized = [tokenize(lines[i]) for i in at]
        for i, (tokens, _), edits in zip(at, tokenized, search(tokenized)):
            out[i] = _reject(_reason(edits), say(edits, tokens))
    return out


def parse_line(fmt: str | None, line: str | None) -> tuple:
    return parse_batch([fmt], [line])[0]


def parse_lines(df: DataFrame, key: str = "line_id", fmt: str = "fmt", line: str = "line") -> DataFrame:
    """One row per line: line_id, status, reason, detail, request_id, command, payload, timestamp.

    status is ``ok``, ``rejected`` or ``blank`` (null, empty, only blanks and tabs). reason is the first that applies of syntax,
    field_count, command, payload; detail has the edits of the cheapest parse, or what is wrong with the value. An unknown or null
    format is a syntax error, and so is JSON that is nested too deeply to be read. Values that aren't texts come out as JSON text. A payload with a key twice keeps the last. Repeated lines
    are judged each; an empty table gives no rows; other columns are not read.

    Plan: a projection and one Arrow pass, no shuffle. The lines of a batch that don't parse at no cost are searched together.
    """
    schema = "line_id bigint, status string, reason string, detail string, request_id string, command string, payload string, timestamp string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.set_int_max_str_digits(0)
        for b in batches:
            rows = parse_batch(b.column(1).to_pylist(), b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], pa.string()) for i in range(7))], names)

    return df.selectExpr(f"cast(`{key}` as bigint) AS k", f"`{fmt}` AS f", f"`{line}` AS t").mapInArrow(run, schema)
