"""Secret scans: fixed patterns, and assignment-aware lexing.

Three patterns give the base spans.  Besides, a text that holds an assignment
sign is lexed as source or configuration: comments, strings, names, values,
signs and lines.  That gives pairs of a target name and an expression of
literals and names, in the forms of `name = "literal"`, `name: value`,
`"name": "value"`, `name="value"` in a call, `name := value`, `name => value`
and `export NAME=value`.  Names that were given one literal are constants: where
one is assigned to another name, that name counts as a target of the literal,
transitively.  Each literal is scored by the most sensitive of its targets'
names and by its own shape, a connection string with a password as such; from THRESHOLD on its place is a span of kind
`literal`.

Cases: null and empty texts have no spans; texts are scanned whole and in
nearly linear time, with unterminated quotes and long chains of names too; repeated
rows each get their spans; empty tables are fine; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base patterns and the least length of what they find.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "literal")

#: How telling the parts of a target's name are.
SENSITIVE = {"password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 2.5, "secret": 3.0, "token": 2.5, "apikey": 3.0, "credential": 2.5, "credentials": 2.5, "auth": 1.5, "bearer": 2.0, "private": 1.5, "access": 1.0, "key": 1.5, "signing": 1.0, "encryption": 1.0, "pass": 2.0, "jwt": 2.0, "dsn": 1.5, "api": 1.0, "salt": 1.5}
HARMLESS = {"public": -2.0, "id": -0.5, "name": -1.5, "path": -2.0, "file": -1.5, "url": -1.0, "count": -2.5, "length": -2.0, "size": -2.0, "type": -2.0, "limit": -2.0, "max": -1.5, "min": -1.5, "ttl": -2.0, "timeout": -2.0}
PLACEHOLDER = re.compile(r"^(?:x+|\*+|\.+|-+|none|null|nil|true|false|todo|changeme|change_me|example\w*|your\w*|dummy\w*|test|placeholder\w*|redacted|undefined|string|\$\{.*\}|\{\{.*\}\}|<.*>|%.*%)$", re.I)
THRESHOLD = 4.0

_LEX = re.compile(
    r"""(?P<comment>(?:(?<!\S)\#|(?<![\w+/=:])//|^[^\S\n]*(?:--|;))[^\n]*)|(?P<open>(?<![\w/*.])/\*|\"{3}|'{3})|(?P<quote>(?:(?<![\w$])[bBrRuUfF]{1,2})?"|(?:(?<![\w$])[bBrRuUfF]{1,2}|(?<!\w))')|(?P<string>`[^`\n]*`)|(?P<sign>:=|=>|==|!=|<=|>=|\+=|[=:+])|(?P<name>[A-Za-z_$][\w$.\-]*)|(?P<value>[^\s"'`=:,;(){}\[\]]+)|(?P<line>\n)|(?P<end>[,(){}\[\]])|(?P<space>[^\S\n]+|.)""",
    re.ASCII | re.DOTALL | re.MULTILINE,
)
#: What may follow an opening quote, up to the closing one or the end of the line.
_INSIDE = {c: re.compile(rf"(?:[^{c}\\\n]|\\.)*+", re.DOTALL) for c in "\"'"}
#: Connection strings with a user's password.
_CREDENTIALS = re.compile(r"[a-z][a-z0-9+.-]*://[^/\s:@]*:([^/\s@]+)@", re.ASCII)
#: An unquoted value: up to white space, comma, semicolon, bracket or quote.
_RAW = re.compile(r"""[^\s,;(){}\[\]"'`]+""")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_LIKELY = re.compile(r"[=:]")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


class Literal(NamedTuple):
    text: str
    start: int
    end: int


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans: leftmost, not overlapping per kind, failing ones dropped."""
    low = text.encode().lower()
    out = []
    if any(x in low for x in (b"passw", b"secret", b"token", b"api_key", b"apikey")):
        out += [Span("assign", m.start(), m.end(), 0.0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [Span("access", m.start(), m.end(), 0.0) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    return out + [Span("hex", m.start(), m.end(), 0.0) for m in HEX.finditer(text)]


def _tokens(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, word, start, end) of all but spaces and comments; comments and strings may span lines, openings without an end are left out.

    Whether a quote closes doesn't depend on where its string began, so up to
    where one string has found no end, no later one of that quote has one.
    """
    at, lost, dead = 0, set(), {"'": -1, '"': -1}
    while True:
        for m in _LEX.finditer(text, at):
            kind = m.lastgroup
            if kind == "open":
                end = "*/" if m[0] == "/*" else m[0]
                stop = -1 if end in lost else text.find(end, m.end())
                if stop < 0:
                    lost.add(end)
                    continue
                at = stop + len(end)
                if end != "*/":
                    yield "string", text[m.start() : at], m.start(), at
                break
            if kind == "quote":
                c = m[0][-1]
                stop = dead[c] if m.end() <= dead[c] else _INSIDE[c].match(text, m.end()).end()
                if text[stop : stop + 1] == c and stop > dead[c]:
                    at = stop + 1
                    yield "string", text[m.start() : at], m.start(), at
                    break
                dead[c] = stop
                if len(m[0]) > 1:
                    yield "name", m[0][:-1], m.start(), m.end() - 1
            elif kind not in ("space", "comment"):
                yield kind, m[0], m.start(), m.end()
        else:
            return


def _literal(word: str, start: int) -> Literal:
    """The inside of a string, without its prefix."""
    first = min(i for i in map(word.find, "\"'`") if i >= 0)
    marks = 3 if len(word) - first >= 6 and word[first : first + 3] in ('"' * 3, "'" * 3) else 1
    return Literal(word[first + marks : -marks], start + first + marks, start + len(word) - marks)


def _raw(text: str, start: int, end: int) -> Literal | None:
    """The unquoted value at a token, where it goes on after the token and can't be an expression of names."""
    m = _RAW.match(text, start)
    if m is None or m.end() <= end or text[m.end() : m.end() + 1] in tuple("\"'`({["):
        return None
    word = m[0]
    if "=" in word.rstrip("=") or word[-1] in ":+" or all(map(_identifier, word.split("+"))):
        return None
    return Literal(word, start, m.end())


def pairs(text: str) -> Iterator[tuple[str, list[Literal | str]]]:
    """(target name, expression) of each assignment; an expression is of literals and names joined by +.

    It goes on in the next line after a sign, a backslash, a block mark of YAML
    or within a bracket that begins it.
    """
    tokens = list(_tokens(text))
    n, i = len(tokens), 0

    def kind_at(j: int) -> str:
        return tokens[j][0] if j < n else "line"

    def skip(j: int) -> int:
        while j < n and tokens[j][0] == "line":
            j += 1
        return j

    while i < n:
        kind, word, start, _ = tokens[i]
        if kind not in ("name", "string") or kind_at(i + 1) != "sign" or tokens[i + 1][1] not in ("=", ":", ":=", "=>"):
            i += 1
            continue
        target = _literal(word, start).text if kind == "string" else word
        if tokens[i + 1][1] == ":" and i + 3 < n and tokens[i + 2][0] == "name" and tokens[i + 3][1] == "=":
            i += 2  # a type stands between the name and its value
        i += 2
        depth = 0
        while i < n and (tokens[i][1] in ("(", "\\", "|", "|-", "|+", ">", ">-", ">+") or tokens[i][0] == "line"):
            if tokens[i][1] == "(":
                depth += 1
            elif tokens[i][0] != "line" and kind_at(i + 1) != "line":
                break
            i += 1
        terms: list[Literal | str] = []
        while i < n:
            kind, word, a, b = tokens[i]
            if kind in ("name", "string") and i + 1 < n and tokens[i + 1][1] in ("=", ":", ":=", "=>") and tokens[i - 1][0] == "line":
                break  # the next target
            raw = _raw(text, a, b) if kind in ("name", "value") else None
            if raw:
                terms.append(raw)
                while i + 1 < n and tokens[i + 1][2] < raw.end:
                    i += 1
            elif kind == "string":
                terms.append(_literal(word, a))
            elif kind == "name" and (kind_at(i + 1) != "end" or tokens[i + 1][1] in ",)}]"):
                terms.append(Literal(word, a, b) if not _identifier(word) else word)
            elif kind == "value":
                terms.append(Literal(word, a, b))
            else:
                break
            i += 1
            on = skip(i) if depth else i
            if on < n and tokens[on][1] == "\\" and kind_at(on + 1) == "line":
                on = skip(on + 1)
            if on < n and tokens[on][1] == "+":
                i = skip(on + 1)
            elif on < n and tokens[on][0] == "string" and (depth or on > i):
                i = on
            else:
                break
        if terms:
            yield target, terms


def _identifier(word: str) -> bool:
    """Whether a bare word can be a name of a constant rather than an unquoted value."""
    return bool(re.fullmatch(r"[A-Za-z_$][A-Za-z_$.]*[0-9]{0,2}", word)) and len(word) <= 40


def sensitivity(name: str) -> float:
    """How telling a target's name is."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    joined = {a + b for a, b in zip(parts, parts[1:])}
    found = [SENSITIVE[p] for p in [*parts, *joined] if p in SENSITIVE]
    return (max(found) + 0.25 * (len(found) - 1) if found else 0.0) + sum(HARMLESS.get(p, 0.0) for p in parts if found)


def shape(value: str) -> float:
    """How much a literal looks like a secret by itself."""
    n = len(value)
    if n < 4 or PLACEHOLDER.match(value) or any(c.isspace() for c in value):
        return -4.0
    counts = Counter(value)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(entropy, 4.5) / 2 + 0.4 * (kinds - 1) + 0.5 * (n >= 16) - 1.0 * (n < 8) - 1.0 * value.isalpha() - 1.5 * bool(re.match(r"https?://", value))


def literal_spans(text: str) -> list[Span]:
    """Literals of sensitive targets, with constants propagated."""
    if not _LIKELY.search(text):
        return []
    given: dict[str, list[Literal]] = {}
    sources: dict[str, list[str]] = {}  # of a target, the names whose constants it takes
    for target, terms in pairs(text):
        given.setdefault(target, [])
        for term in terms:
            if isinstance(term, Literal):
                given[target].append(term)
            else:
                sources.setdefault(target, []).append(term)
    # a name is as telling as the most telling one that its constant reaches: from those on, each is settled once
    reach: dict[str, float] = {}
    for value, name in sorted(((sensitivity(n), n) for n in given), reverse=True):
        todo = [] if name in reach else [name]
        reach.setdefault(name, value)
        while todo:
            for source in sources.get(todo.pop(), ()):
                if source not in reach:
                    reach[source] = value
                    todo.append(source)
    best: dict[Literal, float] = {}
    for name, literals in given.items():
        for literal in literals:
            value = reach[name]
            if _CREDENTIALS.match(literal.text):
                value = max(value, 0.0) + SENSITIVE["password"]
            best[literal] = max(best.get(literal, -9.0), value)
    out = []
    for literal, value in best.items():
        score = value + shape(literal.text)
        if value > 0 and score >= THRESHOLD:
            out.append(Span("literal", literal.start, literal.end, round(score, 6)))
    return out


def scan(text: str) -> list[Span]:
    """All spans of a text by start, then kind."""
    return sorted({*base_spans(text), *literal_spans(text)}, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for each row; spans by start (code points, end exclusive), then kind."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[s._asdict() for s in scan(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["id", "spans"])

    id_kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_kind}, spans {SPANS}")
