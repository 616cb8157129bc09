"""Secrets in source and configuration text: fixed patterns, and an assignment-aware lexer.

Method. The text is lexed into name-literal pairs: a name, an optional type annotation, an assignment sign, and a quoted,
triple-quoted or bare literal, one after a scheme word such as Bearer, or another name; elements and key-value
attributes of markup; indented block values. Quoted pieces that are joined by a sign or stand side by side are one
literal with a span a piece. The text of a triple-quoted literal is lexed too. Names live in scopes (braces, and
functions by their indentation): a name is looked up from its own scope outwards, and a name inside a table is read
together with the table's name. Constants propagate: a name that is given another name's value stands for that value's
literal, as last set before, or where it is only set later, as set there. A literal is scored by how sensitive its
target names are and by its own variety of characters; those that score enough become spans of kind `literal`. Spans of
the fixed patterns always stay. Comments are lexed like code, as a secret in a comment is one too.

Each text is lexed by itself, so memory is that of one text.

Cases. A null text counts as empty: no spans. Repeated rows give repeated results; an empty table gives none. Columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base patterns and their kinds in order.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGNED, LEAST_ACCESS = 8, 16

#: What a part of a name says about its value's sensitivity.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.8, "secret": 1.0, "token": 0.9, "apikey": 1.0, "api_key": 1.0,
    "access_key": 1.0, "private_key": 1.0, "signing_key": 1.0, "encryption_key": 1.0, "client_key": 0.9, "credential": 0.9, "credentials": 0.9,
    "auth": 0.7, "authorization": 0.8, "bearer": 0.9, "jwt": 0.8, "connection_string": 0.7, "session_key": 0.9,
}
#: Values that stand for one to be filled in.
PLACEHOLDER = re.compile(r"(?i)\A(?:changeme|change_me|example|placeholder|dummy|none|null|true|false|test|redacted|x{3,}|\*{3,}|your[_-].*|<.*>|\$\{.*\}|%\(.*)\Z")
THRESHOLD = 0.5
LEAST_LITERAL = 8

#: A name, a type, an assignment sign, then a quoted literal, a scheme word with what follows it, or a bare word.
PAIR = re.compile(
    r"""(?<![\w.$-])(?P<name>[A-Za-z_$][\w.$-]*)["']?\]?[ \t]*
    (?::[ \t]*(?P<type>[A-Za-z_][\w.]*+(?:\[[\w.,|\[\] \t]{0,80}\]|<[\w.,|<> \t]{0,80}>)?\??(?:[ \t]*\|[ \t]*[A-Za-z_][\w.]*+){0,8})[ \t]*=(?![=>])|(?P<sign>:=|=>|[:=](?![:=])))[ \t]*
    (?:[a-zA-Z]{0,2}(?:(?P<triple>"{3}|'{3})(?P<long>(?:\\[\s\S]|(?!(?P=triple))[^\\])*+)(?P=triple)|(?P<quote>["'`])(?P<quoted>(?:\\.|(?!(?P=quote))[^\\\n])*)(?P=quote))
    |(?P<scheme>(?i:bearer|basic|token|digest|negotiate|api_?key))[ \t]+(?P<following>[^\s"'`,;(){}<>]{8,})|(?P<bare>[^\s"'`,;(){}<>]+))""",
    re.ASCII | re.VERBOSE)
#: Annotations that name nothing, and what after a scheme word is no token.
TYPES = frozenset("str string String bytes bytearray char Any any object Object None unknown Text AnyStr Final Optional Union".split())
WORD = re.compile(r"[A-Za-z_.]+", re.ASCII)
NAME = re.compile(r"[A-Za-z_$][\w.$]*", re.ASCII)
#: Another quoted piece of a joined literal.
JOINED = re.compile(r"""(?:[ \t]*(?:\+|\.{1,2}|&|\\)[ \t]*\n?[ \t]*|[ \t]*\n[ \t]*(?:\+[ \t]*)?|[ \t]+)[a-zA-Z]{0,2}(?P<quote>["'`])(?P<piece>(?:\\.|(?!(?P=quote))[^\\\n])*)(?P=quote)(?![ \t]*[:=])""")
#: The lines of an indented block value.
BLOCK_SIGN = re.compile(r"[|>][-+0-9]{0,2}\Z")
BLOCK = re.compile(r"[ \t]*\n(?P<value>(?P<indent>[ \t]+)\S[^\n]*(?:\n(?P=indent)[^\n]*)*)")
#: Elements with text only, and attributes that name a value beside it.
ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.:-]*)(?:[ \t][^<>]{0,200})?>(?P<value>[^<>\s]{8,})</(?P=name)>", re.ASCII)
ATTRIBUTES = re.compile(r"""\b(?:key|name|id)=(["'])(?P<name>[A-Za-z_][\w.:-]*)\1[ \t\n]+value=(["'])(?P<value>[^"'<>]*)\3""", re.ASCII)
#: What opens a scope: a brace after a name, any other brace, a function or class; and what may hold braces of no meaning.
SCOPE = re.compile(r"""["']?(?P<table>[A-Za-z_$][\w$-]*)["']?\]?[ \t]*(?::|=>?|:=)[ \t]*\{|(?P<open>\{)|(?P<close>\})|^(?P<indent>[ \t]*)(?:async[ \t]+)?(?:def|class)[ \t]+\w+[^\n]*:[ \t]*$|(?P<text>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')""", re.ASCII | re.MULTILINE)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def sensitivity(name: str) -> float:
    """The largest weight of the name's parts and of neighbouring parts together."""
    parts = [p for p in re.split(r"[^a-z0-9]+", _CAMEL.sub("_", name).lower()) if p]
    joined = [*parts, *("_".join(p) for p in zip(parts, parts[1:])), *("".join(p) for p in zip(parts, parts[1:]))]
    return max((SENSITIVE.get(p, 0.0) for p in joined), default=0.0)


def variety(value: str) -> float:
    """Between 0 and 1: bits a character against those of 32 even characters."""
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return min(1.0, bits / math.log2(min(32, max(2, n))))


class Scopes:
    """The scopes of a text; 0 is the text itself. A scope's table is the nearest one around it."""

    def __init__(self, text: str):
        self.parent, self.table, self.begins, self.at = [-1], [""], [0], [0]
        if "{" not in text and "def " not in text and "class " not in text:
            return
        open_: list[tuple[int, int | None]] = [(0, None)]  # (scope, where it ends if that is by indentation)

        def enter(where: int, table: str, end: int | None) -> None:
            self.parent.append(open_[-1][0])
            self.table.append(table or self.table[open_[-1][0]])
            open_.append((len(self.parent) - 1, end))
            self.mark(where, open_[-1][0])

        def leave(where: int) -> None:
            open_.pop()
            self.mark(where, open_[-1][0])

        for m in SCOPE.finditer(text):
            while len(open_) > 1 and open_[-1][1] is not None and m.start() >= open_[-1][1]:
                leave(open_[-1][1])
            if m["table"] is not None or m["open"]:
                enter(m.end(), m["table"] or "", None)
            elif m["close"] and len(open_) > 1 and open_[-1][1] is None:
                leave(m.start())
            elif m["indent"] is not None:
                after = re.compile(rf"^(?!{m['indent']}[ \t]|[ \t]*$)", re.MULTILINE).search(text, m.end())
                enter(m.end(), "", after.start() if after else len(text))
        while len(open_) > 1 and open_[-1][1] is not None:
            leave(open_[-1][1])

    def mark(self, where: int, scope: int) -> None:
        self.begins.append(max(where, self.begins[-1]))
        self.at.append(scope)

    def of(self, place: int) -> int:
        return self.at[bisect_right(self.begins, place) - 1]

    def outwards(self, scope: int) -> Iterator[int]:
        while scope >= 0:
            yield scope
            scope = self.parent[scope]


def literals(text: str) -> list[tuple[int, int]]:
    """Spans of literals whose target names, own or propagated, make them secrets."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    scopes = Scopes(text)
    # what each scope's names were set to, in order: a literal's spans, (a name that is set later, the spans if it never is), or None
    # by name and scope, so that a name that isn't set takes one look, however deep it stands
    states: dict[str, dict[int, list]] = {}
    given: list[tuple[str, int, tuple]] = []

    def looked_up(scope: int, name: str) -> list:
        own = states.get(name)
        return next((own[s] for s in scopes.outwards(scope) if s in own), []) if own else []

    for name, spans, sign, sure in _pairs(text):
        span, scope = spans[0], scopes.of(spans[0][0])
        value, state = text[span[0] : span[1]], spans
        if not sure and ((known := looked_up(scope, value)) or NAME.fullmatch(value)):
            # a secret's name may be given a literal that looks like a name; after `:` may stand a type
            own = spans if sure is False and sensitivity(name) >= 0.9 else None
            state = known[-1] if known else (value, own)
            if state is None or state[1:] == (None,):
                state = (state[0], own) if state else own
            if known or own or sign != ":" and sure is False:
                states.setdefault(name, {}).setdefault(scope, []).append(state)
        else:
            states.setdefault(name, {}).setdefault(scope, []).append(state)
        if state:
            given.append((name, scope, state))

    def resolved(scope: int, name: str) -> tuple | None:
        """The literal that a name which is set later stands for: in a scope around, else anywhere."""
        asked, met = [name], set()
        while asked:
            name = asked.pop()
            if name not in met:
                met.add(name)
                for state in looked_up(scope, name) or (x for own in states.get(name, {}).values() for x in own):
                    if state and not isinstance(state[0], str):
                        return state
                    if state:
                        asked.append(state[0])
        return None

    score: dict[tuple[int, int], float] = {}
    for name, scope, state in given:
        weight = max(sensitivity(name), 0.9 * sensitivity(scopes.table[scope]))
        if weight and isinstance(state[0], str):
            state = resolved(scope, state[0]) or state[1]
        if weight and state:
            value = "".join(text[a:b] for a, b in state)
            if len(value) >= LEAST_LITERAL and not PLACEHOLDER.match(value):
                for span in state:
                    score[span] = max(score.get(span, 0.0), weight * variety(value))
    return [s for s, x in score.items() if x >= THRESHOLD and s[1] > s[0]]


def _pairs(text: str) -> Iterator[tuple[str, tuple[tuple[int, int], ...], str, bool | None]]:
    """(name, the value's spans, sign, sure), markup first, then in the text's order.

    sure says whether the value is a literal; False where it may be a name, None where it is a name or nothing.
    """
    if "</" in text or "value=" in text:
        for pattern in (ELEMENT, ATTRIBUTES):
            for m in pattern.finditer(text):
                yield m["name"], (m.span("value"),), "=", True
    at = 0
    while m := PAIR.search(text, at):
        kind = next(k for k in ("long", "quoted", "following", "bare") if m[k] is not None)
        spans, kept, sign, end = (m.span(kind),), m["type"], "=" if m["type"] else m["sign"], m.end()
        sure = kind in ("long", "quoted")
        if kind == "following":
            yield m["name"], (m.span("scheme"),), sign, False
            sure = None if WORD.fullmatch(m[kind]) else True
        if kept and kept not in TYPES and not m["quote"] and not m["triple"]:
            yield m["name"], (m.span("type"),), ":", sensitivity(m["name"]) >= 0.9  # it may be the value
        if kind == "quoted":
            while more := JOINED.match(text, end):
                spans, end = (*spans, more.span("piece")), more.end()
        elif kind == "bare" and BLOCK_SIGN.match(m["bare"]) and (block := BLOCK.match(text, end)):
            spans, sure, end = (block.span("value"),), True, end  # its lines are lexed too
        yield m["name"], spans, sign, sure
        if kept and kept not in TYPES and NAME.fullmatch(kept):
            yield kept, spans, sign, sure  # it may be the name, as in `if x: y = ...`
        at = m.start("long") if kind == "long" else end


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, sorted; the kind by its place in KINDS."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_ASSIGNED] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found += [(a, 3, b) for a, b in literals(text)]
    return sorted(found)


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: array of (kind, start, end), code points, end exclusive; kinds of KINDS."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(t.as_py())] for t in text]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: bigint, end: bigint>>")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, digest of the base spans, and all spans as text."""
    def text(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:3]]
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return scanned.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
