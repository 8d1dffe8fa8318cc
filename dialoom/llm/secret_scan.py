"""Secret scans with assignment-aware lexing.

Base kinds are patterns. The method adds spans of kind ``literal``.

1. A lexer cuts the text into names (dotted, bracketed), strings (quoted, triple-quoted, with prefixes and escapes), operators,
   brackets, line ends and the rest, in one pass.
2. A parser reads name-literal pairs from the tokens: assignments in code, shell, INI and properties files with any blanks and type
   annotations; JSON and YAML members, YAML block scalars and anchors; XML attributes and elements, also those that name their
   content (``<string name="token">``); keyword arguments, ``setenv("NAME", "literal")`` and ``set_password("literal")``. A value may
   be in brackets over several lines, a list of literals, a concatenation of literals and names, or wrapped in a call.
3. A literal given to a name is that name's constant from there on; a later assignment of a known name (``password = KEY``,
   ``f"${KEY}"``, ``db.password: *KEY``) passes its literals on to the target, so a secret is found at its literal, wherever it is
   put to sensitive use. A name bound again within braces or a function gets its outer value back at their end.
4. Each value is scored: how sensitive the target's words are, plus length, character classes and entropy, less for
   placeholders and plain words. From ``MIN_SCORE`` on, the spans of its literals are reported, each once.

Positions are code points, end exclusive. Nothing is cut or sampled; a text is one row's work, linear in its length but for constants
that grow line by line, whose literals are gone through again at each growth. A constant holds each literal once.

Defined cases: null text has no spans; a very long text is scanned whole; an empty table gives an empty table; a quote that its line does not close is no string; two pairs that reach one literal
report it once; an assignment of a name to itself keeps its value; a literal inside a base span is reported too, since kinds are independent;
repeated rows get equal answers; extra columns pass through.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import free_name

# The base kinds, in order, each with its pattern, the group and the least length that counts.
KINDS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
#: Words of a target name and how sensitive each makes it.
SENSITIVE = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 2, "apikey": 3, "credential": 3, "credentials": 3,
    "auth": 2, "bearer": 2, "private": 1, "key": 1, "api": 1, "access": 1, "signing": 1, "encryption": 1, "client": 1, "session": 1,
    "cookie": 1, "pin": 1, "salt": 1, "cert": 1, "certificate": 1, "dsn": 1, "connection": 1,
}
PLACEHOLDER = re.compile(r"(?i)x{4,}|\*{3,}|\.{3}|change|example|your|placeholder|dummy|sample|todo|none|null|true|false|<.*>|\$\{.*\}")
MIN_SCORE = 4

# Possessive repetitions give nothing back, so every token is read once.
_NAME = r"[A-Za-z_$][\w$]*+(?:[.-][A-Za-z_$][\w$]*+|\[\s*+[\"'][\w$.-]++[\"']\s*+\])*+"
_TOKEN = re.compile(
    rf"""(?P<blank>[\x20\t]++)|(?P<line>\r?\n)|(?P<quote>(?:(?<!\w)[rbufRBUF]{{1,2}})?+(?:\"{{3}}|'{{3}}|["'`]))|(?P<name>{_NAME})"""
    r"""|(?P<word>\w++)|(?P<op>:=|=>|={1,3}|:(?!:))|(?P<mark>.)""",
    re.A | re.S,
)
_STRING_END = {
    q: re.compile(rf"(?:[^{q[0]}\\{'' if len(q) == 3 else chr(10)}]|\\.{rf'|{q[0]}(?!{q[0] * 2})' if len(q) == 3 else ''})*+", re.S)
    for q in ('"""', "'''", '"', "'", "`")
}
_ANNOTATION = re.compile(r"[\x20\t]*+[A-Za-z_][\w.<>\[\]]*+[\x20\t]*+=(?![=>])")
_BARE = re.compile(r"[^\s\"',;(){}\[\]<>|]++")
_ANCHOR = re.compile(r"&([A-Za-z_][\w-]*+)[\x20\t]++")
_BLOCK_SCALAR = re.compile(r"[|>][+-]?\d?[+-]?[\x20\t]*+\r?\n")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)((?:\s[^<>]*+)?+)>([^<>]*+)</")
_TAG = re.compile(r"<[^<>]*+>")
_NAMED = re.compile(r"\b(?:name|key|id)\s*+=\s*+[\"']([^\"'<>]++)[\"']")
_VALUE = re.compile(r"\bvalue\s*+=\s*+[\"']([^\"'<>]++)[\"']")
_KEY = re.compile(rf"{_NAME}\Z", re.A)
#: Words of functions that look a value up by the literal they are given, which is no secret then.
LOOKUPS = {*"get env getenv environ input prompt config fetch read load lookup find open print log format join url path".split()}
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
#: An unquoted dotted name is code, no literal.
_PATH = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+\Z", re.A)
_REFERENCE = re.compile(r"[*&$]?\{?([A-Za-z_][\w.-]*)\}?\Z", re.A)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), leftmost and non-overlapping within a kind."""
    out = []
    for number, (_, pattern, group, least) in enumerate(KINDS):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), number, m.end()))
    return sorted(out)


def name_score(name: str) -> int:
    """How sensitive the words of a target are; snake, kebab and camel case are cut into words."""
    parts = [p.lower() for p in _PART.findall(name)]
    joined = {a + b for a, b in zip(parts, parts[1:])}
    return sum(SENSITIVE.get(p, 0) for p in {*parts} | (joined & SENSITIVE.keys()))


def literal_score(value: str) -> float:
    """What the literal itself says: long, mixed and irregular is more, a placeholder or plain word less."""
    if len(value) < 6 or PLACEHOLDER.search(value):
        return -9
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    return (len(value) >= 12) + (len(value) >= 20) + (kinds - 1) * 0.75 + (entropy > 3) + (entropy > 3.5) - 2 * (kinds == 1)


def tokens(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all tokens but blanks; of a string start and end are those of its content."""
    out: list[tuple[str, int, int]] = []
    at, size, dead = 0, len(text), dict.fromkeys(_STRING_END, 0)
    while at < size:
        m = _TOKEN.match(text, at)
        kind, end = m.lastgroup, m.end()
        if kind == "quote":
            quote = m[0].lstrip("rbufRBUF")
            before = text[at - 1] if at else " "
            # Within a word it is an apostrophe; where an unclosed string of the kind began before, none begins.
            begins = at >= dead[quote] and not (quote == "'" and before.isalnum())
            stop = _STRING_END[quote].match(text, end).end() if begins else end
            if begins and text.startswith(quote, stop):
                out.append(("string", end, stop))
                end = stop + len(quote)
            else:
                if begins:
                    dead[quote] = stop
                end = at + 1
                out.append(("mark" if text[at] in "\"'`" else "word", at, end))
        elif kind != "blank":
            out.append((kind, at, end))
        at = end
    return out


def _looks_up(callee: str) -> bool:
    return not LOOKUPS.isdisjoint(p.lower() for p in _PART.findall(callee))


Spans = list[tuple[int, int]]


def _joined(*spans: Spans) -> Spans:
    """All spans in order, each once: a name that is added to itself holds its literals no oftener than before."""
    return list(dict.fromkeys(s for part in spans for s in part))


class _Pairs:
    """Reads the tokens of one text and collects the literals that reach sensitive names."""

    def __init__(self, text: str):
        self.text, self.tokens = text, tokens(text)
        self.constants: dict[str, Spans] = {}
        self.scopes: list[tuple[int, dict[str, Spans | None]]] = []  # indentation (-1: braces) and what names meant outside
        self.found: set[tuple[int, int]] = set()

    def kind(self, i: int) -> str:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else "end"

    def of(self, i: int) -> str:
        return self.text[self.tokens[i][1] : self.tokens[i][2]] if 0 <= i < len(self.tokens) else ""

    def mark(self, i: int) -> str:
        return self.of(i) if self.kind(i) in ("mark", "op") else ""

    def read(self) -> Spans:
        i = 0
        while i < len(self.tokens):
            i = self.step(i)
        return sorted(self.found)

    def step(self, i: int) -> int:
        """Reads what begins at a token; returns the first token after it."""
        kind, start, _ = self.tokens[i]
        if kind == "line":
            self.leave_functions(i + 1)
        elif kind == "mark":
            mark = self.of(i)
            if mark == "{":
                self.scopes.append((-1, {}))
            elif mark == "}":
                self.leave(lambda indent: indent == -1)
            elif mark == "<":
                self.element(start)
        elif kind == "name" or kind == "string":
            key = self.of(i)
            if kind == "name" and key == "def":
                self.scopes.append((self.indentation(start), {}))
            elif kind == "name" or _KEY.match(key):
                j = i + 1
                if self.kind(j) == "op":
                    if self.of(j) == ":" and (m := _ANNOTATION.match(self.text, self.tokens[j][2])):
                        while self.tokens[j][2] < m.end():
                            j += 1
                    return self.value(key, j + 1, self.of(j), start)
                if kind == "name" and self.mark(j) == "(":
                    self.call(key, j + 1)
        return i + 1

    def call(self, callee: str, i: int) -> None:
        """A call's first literals: f("NAME", "literal") and set_name("literal")."""
        if self.kind(i) == "string":
            if self.mark(i + 1) == "," and self.kind(i + 2) == "string":
                self.bind(self.of(i), [[self.tokens[i + 2][1:]]], keep=False)
            elif not _looks_up(callee):
                self.bind(callee, [[self.tokens[i][1:]]], keep=False)

    def element(self, start: int) -> None:
        m = _ELEMENT.match(self.text, start)
        if m:
            named = _NAMED.search(m[2])
            low, high = m.span(3)
            while low < high and self.text[low].isspace():
                low += 1
            while high > low and self.text[high - 1].isspace():
                high -= 1
            for name in {m[1], named[1] if named else m[1]}:
                self.bind(name, [[(low, high)]])
        else:
            tag = _TAG.match(self.text, start)
            named, value = (p.search(self.text, start, tag.end()) if tag else None for p in (_NAMED, _VALUE))
            if named and value:
                self.bind(named[1], [[value.span(1)]])

    def value(self, name: str, i: int, op: str, key_start: int) -> int:
        """Binds the value that begins at a token to name; returns the token to go on from."""
        if i >= len(self.tokens):
            return i
        at = self.tokens[i - 1][2]
        while at < len(self.text) and self.text[at] in " \t":
            at += 1
        if op == ":" and (m := _BLOCK_SCALAR.match(self.text, at)):
            return self.block(name, m.end(), self.indentation(key_start), i)
        anchor = _ANCHOR.match(self.text, at)
        if anchor:
            while i < len(self.tokens) and self.tokens[i][1] < anchor.end():
                i += 1
            at = anchor.end()
        if self.kind(i) == "mark" and self.of(i) == "{":
            return i  # a mapping: its members are pairs of their own
        values, i = self.expression(i, at)
        self.bind(name, values)
        if anchor:
            self.bind(anchor[1], values)
        return i

    def expression(self, i: int, at: int) -> tuple[list[Spans], int]:
        """The values (lists of literal spans) of an expression at a token: one, or each of a bracketed list."""
        values: list[Spans] = []
        parts: Spans = []
        depth = 0
        joined = True  # whether an operand may follow
        while i < len(self.tokens):
            kind, start, end = self.tokens[i]
            mark = self.of(i) if kind == "mark" else ""
            if kind == "line":
                if not depth and not (joined and parts) and self.mark(i - 1) != "\\":
                    break
            elif kind == "string":
                if self.kind(i + 1) == "op" and self.of(i + 1) in (":", "=>"):
                    break  # a key
                reference = _REFERENCE.match(self.text[start:end])
                known = self.known(reference[1]) if reference else None
                parts = _joined(parts, known if known else [(start, end)])
                joined = False
            elif mark and mark in "([":
                depth += 1
            elif mark and mark in ")]":
                depth -= 1
                if depth < 0:
                    break
                if not depth:
                    i += 1
                    break
            elif mark == "," and depth:
                if parts:
                    values.append(parts)
                parts, joined = [], True
            elif mark == "+" or mark == "." and parts or mark == "\\":
                joined = True
            elif kind in ("name", "word", "op") or mark and mark not in "\"'`,;{}<>|":
                if kind == "name" and self.mark(i + 1) == "(" and joined:
                    if _looks_up(self.of(i)):
                        break
                    i += 1
                    continue
                if depth and self.kind(i + 1) == "op":
                    break  # a key
                if not joined:
                    break
                m = _BARE.match(self.text, start if parts or depth else at)
                if not m:
                    break
                first, last = m.span()
                while last > first and self.text[last - 1] in ".!?":
                    last -= 1
                literal = self.text[first:last]
                reference = _REFERENCE.match(literal)
                known = self.known(reference[1]) if reference else None
                if known:
                    parts = _joined(parts, known)
                elif not (parts or depth or _PATH.match(literal)):
                    parts = parts + [(first, last)]
                while i < len(self.tokens) and self.tokens[i][1] < m.end():
                    i += 1
                joined = False
                continue
            else:
                break
            i += 1
        return values + [parts] if parts else values, max(i, 0)

    def block(self, name: str, at: int, indent: int, i: int) -> int:
        """A YAML block scalar: all lines that are blank or deeper than the key."""
        low, high = -1, at
        while at < len(self.text):
            end = self.text.find("\n", at)
            end = len(self.text) if end < 0 else end
            line = self.text[at:end]
            if line.strip():
                if len(line) - len(line.lstrip(" \t")) <= indent:
                    break
                low = at + len(line) - len(line.lstrip()) if low < 0 else low
                high = at + len(line.rstrip())
            at = end + 1
        if low >= 0:
            self.bind(name, [[(low, high)]])
        while i < len(self.tokens) and self.tokens[i][1] < high:
            i += 1
        return i

    def known(self, name: str) -> Spans | None:
        return self.constants.get(name) or self.constants.get(name.rsplit(".", 1)[-1])

    def bind(self, name: str, values: list[Spans], keep: bool = True) -> None:
        values = [v for v in values if v]
        if keep and values:
            spans = _joined(*values)
            for key in {name, name.rsplit(".", 1)[-1]}:
                if self.scopes:
                    self.scopes[-1][1].setdefault(key, self.constants.get(key))
                self.constants[key] = spans
        sensitive = name_score(name)
        if sensitive >= 2:
            for spans in values:
                if sensitive + literal_score("".join(self.text[a:b] for a, b in spans)) >= MIN_SCORE:
                    self.found.update(spans)

    def indentation(self, at: int) -> int:
        begin = self.text.rfind("\n", 0, at) + 1
        m = _INDENT.match(self.text, begin)
        return m.end() - begin

    def leave(self, ends) -> None:
        """Ends the innermost scope if it is of the given kind; a name that meant something outside means that again."""
        if self.scopes and ends(self.scopes[-1][0]):
            for name, outer in self.scopes.pop()[1].items():
                if outer:
                    self.constants[name] = outer

    def leave_functions(self, i: int) -> None:
        if self.scopes and self.scopes[-1][0] >= 0 and self.kind(i) not in ("line", "end"):
            at = self.indentation(self.tokens[i][1])
            while self.scopes and self.scopes[-1][0] >= 0 and at <= self.scopes[-1][0]:
                self.leave(lambda indent: indent >= 0)


_INDENT = re.compile(r"[\x20\t]*+")
#: Without one of the words no name is sensitive, and nothing can be found.
_ANY_SENSITIVE = re.compile("|".join(sorted(SENSITIVE)), re.I)


def literal_spans(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that reach a sensitive name, directly or through constants."""
    return _Pairs(text).read() if _ANY_SENSITIVE.search(text) else []


def scan_text(text: str | None) -> tuple[list[int], str, str]:
    """Counts of the base kinds, base spans and all spans as kind:start:end."""
    text = text or ""
    base = base_spans(text)
    counts = Counter(number for _, number, _ in base)
    every = sorted(base + [(start, len(KINDS), end) for start, end in literal_spans(text)])
    names = [k[0] for k in KINDS] + ["literal"]
    show = lambda spans: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
    return [counts.get(i, 0) for i in range(len(KINDS))], show(base), show(every)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` and ``spans`` (taken over if docs has them)."""

    ship(docs.sparkSession)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            counts, base, every = scan_text(t)
            rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), every))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    answer = free_name(docs, "_answer")
    out = docs.withColumn(answer, found(F.col(text)))
    for name in ("n_assign", "n_access", "n_hex", "base_sha256", "spans"):
        out = out.withColumn(name, F.col(f"{answer}.{name}"))
    return out.drop(answer)
