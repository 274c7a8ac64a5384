"""Delimited records with a reason for every one that fails: an error-recovering grammar.

    file    := record (newline record)*
    record  := cell (delimiter cell)*
    cell    := quoted | bare
    quoted  := '"' ( any but '"' | '""' )* '"'      directly before a delimiter or the record's end
    bare    := ( any but '"', delimiter, newline )*

`parse_text` reads the records of a text by recursive descent. A syntax error does not end it: it resumes
at the next record-start anchor. Where record starts are known (lines that a table holds one by one are
put together to a text with the place of each) those are the anchors, and no cell runs past one. Else
an anchor is a line start that looks like a record's start and from which a record of the right width
parses; behind a broken quote nothing else tells which newline ends the record. The records behind are
loaded, not swallowed. Next quotes are looked up in a list, so resuming costs no second scan.

Values are checked by the schema's rules once the syntax holds. Reasons, the first that applies:
broken_quoting, wrong_column_count, invalid_value.
"""

from __future__ import annotations

import datetime as dt
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class SyntaxFault(Exception):
    def __init__(self, at: int, what: str):
        super().__init__(what)
        self.at, self.what = at, what


@dataclass(frozen=True)
class RecordSchema:
    """names: the columns; checks: column -> predicate on its text; quoting: whether '"' has a meaning;
    anchor: what a record's first characters look like, for resuming in a file."""

    names: tuple[str, ...]
    delimiter: str
    quoting: bool
    checks: dict[str, Callable[[str], bool]] = field(default_factory=dict)
    anchor: str = ""


@dataclass(frozen=True)
class Parsed:
    cells: tuple[str, ...] | None
    reason: str | None
    place: int | None
    detail: str | None


class _Reader:
    """Recursive descent over a text up to `end`; a record also ends at a newline where `lines` is set.
    `keep` off only checks: no cell is copied."""

    def __init__(self, text: str, schema: RecordSchema, lines: bool, quotes: list[int] | None = None):
        self.text, self.schema, self.lines = text, schema, lines
        self.at, self.end, self.keep = 0, len(text), True
        marks = re.escape(schema.delimiter) + ('"' if schema.quoting else "") + ("\n" if lines else "")
        self.bare_end = re.compile(f"[{marks}]")
        self.quotes = quotes if quotes is not None else [m.start() for m in re.finditer('"', text)] if schema.quoting else []

    def record(self, at: int, end: int, keep: bool = True) -> list[str]:
        self.at, self.end, self.keep = at, end, keep
        cells = [self.cell()]
        while self.at < self.end and self.text[self.at] == self.schema.delimiter:
            self.at += 1
            cells.append(self.cell())
        return cells

    def cell(self) -> str:
        if self.schema.quoting and self.at < self.end and self.text[self.at] == '"':
            return self.quoted()
        return self.bare()

    def bare(self) -> str:
        m = self.bare_end.search(self.text, self.at, self.end)
        stop = m.start() if m else self.end
        if m and self.schema.quoting and m.group() == '"':
            raise SyntaxFault(stop, "quote inside a bare cell")
        value, self.at = self.text[self.at : stop] if self.keep else "", stop
        return value

    def quoted(self) -> str:
        begin, out = self.at, []
        self.at += 1
        n = bisect_left(self.quotes, self.at)
        while True:
            if n == len(self.quotes) or self.quotes[n] >= self.end:
                raise SyntaxFault(begin, "quote is never closed")
            close = self.quotes[n]
            if self.keep:
                out.append(self.text[self.at : close])
            self.at, n = close + 1, n + 1
            if self.at < self.end and self.text[self.at] == '"':
                out.append('"')
                self.at, n = self.at + 1, n + 1
                continue
            if self.at == self.end or self.text[self.at] == self.schema.delimiter or (self.lines and self.text[self.at] == "\n"):
                return "".join(out)
            raise SyntaxFault(close, "text behind a closing quote")


def _judge(cells: list[str], schema: RecordSchema) -> Parsed:
    if len(cells) != len(schema.names):
        return Parsed(None, "wrong_column_count", len(cells), f"{len(cells)} cells, not {len(schema.names)}")
    for i, name in enumerate(schema.names):
        check = schema.checks.get(name)
        if check and not check(cells[i]):
            return Parsed(tuple(cells), "invalid_value", i, name)
    return Parsed(tuple(cells), None, None, None)


def parse_text(text: str | None, schema: RecordSchema, starts: list[int] | None = None) -> Iterator[tuple[int, Parsed]]:
    """(offset, result) of every record of a text. `starts`: the offsets at which records begin, where they
    are known, each behind a newline that belongs to none; without them lines are looked at, and empty
    ones skipped."""
    if starts is not None:
        text = text or ""
        reader = _Reader(text, schema, lines=False)
        for at, end in zip(starts, [*(s - 1 for s in starts[1:]), len(text)]):
            try:
                yield at, _judge(reader.record(at, end), schema)
            except SyntaxFault as e:
                # resumes at the next anchor
                yield at, Parsed(None, "broken_quoting", e.at - at, e.what)
        return
    text, at = (text or "").replace("\r\n", "\n"), 0
    reader = _Reader(text, schema, lines=True)
    anchor = re.compile(schema.anchor or f"[^{re.escape(schema.delimiter)}\n]*{re.escape(schema.delimiter)}")
    while at < len(text):
        if text[at] == "\n":
            at += 1
            continue
        try:
            yield at, _judge(reader.record(at, len(text)), schema)
            at = reader.at + 1
        except SyntaxFault as e:
            yield at, Parsed(None, "broken_quoting", e.at - at, e.what)
            at = _resume(reader, at, anchor)


def parse_record(line: str | None, schema: RecordSchema) -> Parsed:
    """One record that is given by itself; null counts as the empty text."""
    return next(parse_text(line, schema, [0]))[1]


def _resume(reader: _Reader, at: int, anchor: re.Pattern) -> int:
    """The next line start that begins like a record and from which one of the right width parses, or
    on whose own line the next fault lies; the text's end where there is none."""
    text = reader.text
    start = text.find("\n", at) + 1
    while start:
        if anchor.match(text, start):
            try:
                if len(reader.record(start, len(text), keep=False)) == len(reader.schema.names):
                    return start
            except SyntaxFault as e:
                line_end = text.find("\n", start)
                if line_end < 0 or e.at < line_end:
                    return start
        start = text.find("\n", start) + 1
    return len(text)


# The layout of the individual contributions file.
FEC_COLUMNS = [
    "committee_id", "amendment", "report", "pgi", "image", "tx_type", "entity", "name", "city", "state", "zip", "employer", "occupation", "date", "amount",
    "other_id", "tran_id", "file_num", "memo_cd", "memo_text", "sub_id",
]
FEC_ENTITIES = {"", "IND", "ORG", "COM", "CAN", "PAC", "CCM", "PTY"}


def is_calendar_day(text: str) -> bool:
    """MMDDYYYY of a day that exists, or nothing."""
    if not text:
        return True
    if not re.fullmatch(r"[0-9]{8}", text):
        return False
    try:
        dt.date(int(text[4:]), int(text[:2]), int(text[2:4]))
    except ValueError:
        return False
    return True


def _matches(pattern: str) -> Callable[[str], bool]:
    compiled = re.compile(pattern)
    return lambda text: compiled.fullmatch(text) is not None


FEC_SCHEMA = RecordSchema(
    names=tuple(FEC_COLUMNS),
    delimiter="|",
    quoting=False,
    checks={
        "entity": FEC_ENTITIES.__contains__,
        "name": lambda t: bool(t.strip()),
        "state": _matches(r"(?:[A-Z]{2})?"),
        "zip": _matches(r"(?:[0-9]{5}(?:[0-9]{4})?)?"),
        "date": is_calendar_day,
        "amount": _matches(r"-?[0-9]+(?:\.[0-9]{1,2})?"),
        "sub_id": _matches(r"[0-9]+"),
    },
)

PROSPECT_CSV_SCHEMA = RecordSchema(
    names=("prospect_id", "name", "company", "address", "city", "state"),
    delimiter=",",
    quoting=True,
    checks={
        "prospect_id": lambda t: bool(t.strip()),
        "name": lambda t: len(t.split()) >= 2,
        "state": lambda t: re.fullmatch(r"(?:[A-Z]{2})?", t.strip()) is not None,
    },
    anchor=r'"?[A-Za-z]?[0-9]+"?,',
)

_OUT = T.StructType(
    [
        T.StructField("raw_ref", T.StringType()),
        T.StructField("cells", T.ArrayType(T.StringType())),
        T.StructField("reason", T.StringType()),
        T.StructField("place", T.IntegerType()),
        T.StructField("detail", T.StringType()),
    ]
)


def parse_lines(df: DataFrame, ref: str, line: str, schema: RecordSchema) -> DataFrame:
    """(raw_ref, cells, reason, place, detail) for every row of df; reason is null where the record
    loads. Rows are independent, so nothing is shuffled and any split of the input will do. Repeated
    rows come out repeated; a null line has the wrong column count; other columns are ignored."""

    def run(batches):
        for pdf in batches:
            # the batch as one text, every record's start an anchor
            lines = [x if isinstance(x, str) else "" for x in pdf["line"]]
            starts, at = [], 0
            for x in lines:
                starts.append(at)
                at += len(x) + 1
            parsed = [p for _, p in parse_text("\n".join(lines), schema, starts)]
            yield pd.DataFrame(
                {
                    "raw_ref": pdf["raw_ref"],
                    "cells": [p.cells if p.reason is None else None for p in parsed],
                    "reason": [p.reason for p in parsed],
                    "place": pd.array([p.place for p in parsed], dtype="Int32"),
                    "detail": [p.detail for p in parsed],
                }
            )

    return df.select(df[ref].alias("raw_ref"), df[line].alias("line")).mapInPandas(run, _OUT)


def parse_files(df: DataFrame, name: str, text: str, schema: RecordSchema) -> DataFrame:
    """The same for whole files, one per row of df: raw_ref is `name:offset` of each record."""

    def run(batches):
        for pdf in batches:
            for file, body in zip(pdf["name"], pdf["text"]):
                found = [(f"{file}:{at}", p.cells if p.reason is None else None, p.reason, p.place, p.detail) for at, p in parse_text(body, schema)]
                out = pd.DataFrame(found, columns=_OUT.names)
                yield out.astype({"place": "Int32"})

    return df.select(df[name].alias("name"), df[text].alias("text")).mapInPandas(run, _OUT)
