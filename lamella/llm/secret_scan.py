"""Secret scans: fixed patterns, and a lexer that is aware of assignments.

The patterns find the shapes that secrets are known to have. The lexer reads source code and configuration as strings,
comments, braces, heads of functions and assignment signs, and pairs the name before each sign with the value behind it
(``x = "..."``, ``"x": '...'``, ``x := ...``, ``x => ...``, ``X=...``, blocks ``x: |`` of indented lines, ``<x>...</x>`` and
``key="x" value="..."``): literals, names of earlier constants, and sums of these. Constants are propagated, so a harmless
name whose value later reaches ``db_password`` is scored by the latter; what a function assigns is known in it alone, and
its parameters hide what has their names outside. What a string or a comment holds may be configuration in turn, and is
read by itself, without the names around it.

A literal's score is how sensitive the name is that it is assigned to, and how much the literal looks like a secret; those
beyond a threshold give further spans. Neither texts nor literals, names, sums or constants have a greatest length, and
the time is in proportion to the text's.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import record_batch, slices, utf8, view

KINDS = ("assign", "access", "hex", "literal")
THRESHOLD = 0.7

_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")
_HEX_MAP = bytes(104 if chr(b) in "0123456789abcdef" else 46 for b in range(256))


class Span(NamedTuple):
    """Start and end in code points, end exclusive. score is 1 for the fixed patterns."""

    kind: str
    start: int
    end: int
    name: str
    score: float


def base_spans(text: bytes) -> list[tuple[str, int, int]]:
    """The fixed patterns' matches, in bytes."""
    out = []
    lower = text.lower()
    if any(w in lower for w in _WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"h" * 16 in text.translate(_HEX_MAP):
        out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


# the lexer

_SIGN = rb"=>|:=|(?<![=!<>:])[:=](?![=:/~>])"
#: Strings by the sign that encloses them. A quote behind a letter is an apostrophe.
_QUOTED = {
    b'"""': rb"(?<![\w\\])\"\"\"(?:[^\"\\]++|\\.|\"(?!\"\"))*+\"\"\"",
    b"'''": rb"(?<![\w\\])'''(?:[^'\\]++|\\.|'(?!''))*+'''",
    b'"': rb"(?:(?<![\w\\])|(?<=\b[rbufRBUF]))\"(?:[^\"\\\n]++|\\.)*+\"",
    b"'": rb"(?:(?<![\w\\])|(?<=\b[rbufRBUF]))'(?:[^'\\\n]++|\\.)*+'",
    b"`": rb"(?<![\w\\])`(?:[^`\\]++|\\.)*+`",
}
_COMMENT = rb"(?<!\S)#[^\n]*+|(?<![\w:/\\\"'`])//[^\n]*+|/\*|<!--"
#: A function's head up to its brace or, in def, its parameters; other heads with a brace have words of _CONTROL.
_HEAD = rb"\bdef[\x20\t]+\w+[\x20\t]*\((?P<def>[^()]*+)\)|\b(?P<name>\w++)[\x20\t]*\((?P<fun>[^()\n]*+)\)\s*+(?:(?:->|:)[\x20\t]*[\w.<>\[\]]++\s*+)?\{|\((?P<arrow>[^()\n]*+)\)[\x20\t]*=>[\x20\t]*\{"
_CONTROL = {b"if", b"for", b"while", b"switch", b"catch", b"with", b"elif", b"match", b"using", b"lock", b"synchronized", b"until", b"when"}
_ELEMENT = rb"<(?P<tag>[\w:.\-]++)>(?P<text>[^<>\n]++)</(?P=tag)>|\b(?:key|name)[\x20\t]*=[\x20\t]*(?P<q>[\"'])(?P<attr>[\w.:\-]++)(?P=q)\s++value[\x20\t]*=[\x20\t]*(?P<r>[\"'])(?P<value>[^\"'\n]*+)(?P=r)"
_LINE = rb"\n(?P<indent>[\x20\t]*+)(?=\S)"
_BLOCK = re.compile(rb"[\x20\t]*[|>][+\-]?\d?[\x20\t]*\r?\n")
_BLOCK_LINE = re.compile(rb"(?P<indent>[\x20\t]*+)(?P<line>[^\r\n]*+)(?:\r?\n|\Z)")
_PARAMETER = re.compile(rb"[A-Za-z_$][\w$]*+(?=[\x20\t]*(?:[,:=?)]|\Z))")


@cache
def _tokens(quotes: tuple[bytes, ...], comments: bool, lines: bool) -> re.Pattern:
    """What the lexer stops at where strings may be enclosed by some signs only."""
    kinds = [b"(?P<string>" + b"|".join(_QUOTED[q] for q in quotes) + b")"] if quotes else []
    kinds += [b"(?P<comment>" + _COMMENT + b")"] if comments else []
    kinds += [_LINE] if lines else []
    return re.compile(b"|".join([_ELEMENT, *kinds, b"(?P<head>" + _HEAD + b")", b"(?P<brace>[{}])", b"(?P<sign>" + _SIGN + b")"]))


#: What stands before a sign, from the sign backwards: a type and its colon, a bracket, a quote, the name.
_NAME = re.compile(rb"[\x20\t]*+(?:(?:\]\w*\[)?[\w.]*[A-Za-z_][\x20\t]*:[\x20\t]*)?[\])]?[\"'`]?((?:[\w$]+[.\-])*[\w$]*[A-Za-z_$])")
_STRING = re.compile(rb"[\x20\t]*(?:[rbufRBUF]{1,2})?(?:\"\"\"(?P<t>[^\\]*?)\"\"\"|\"(?P<d>(?:[^\"\\\n]++|\\.)*+)\"|'(?P<s>(?:[^'\\\n]++|\\.)*+)'|`(?P<b>(?:[^`\\]++|\\.)*+)`)")
_BLANKS = re.compile(rb"[\x20\t]*")
_BARE = re.compile(rb"([^\s\"'`,;&|<>(){}\[\]]++)")
_IDENTIFIER = re.compile(rb"[A-Za-z_$][\w$]*(?:\.[\w$]+)*\Z")
_JOIN = re.compile(rb"[\x20\t]*(?:\+|\.\.|<>|&)[\x20\t]*(?:\\?\r?\n[\x20\t]*)?|[\x20\t]*\\\r?\n[\x20\t]*(?=[\"'])|[\x20\t]+(?=[\"'])")
_PARTS = re.compile(rb"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

#: Without one of these there is no sensitive name.
_STEMS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"bearer", b"auth", b"signature", b"salt", b"seed", b"pin", b"cookie", b"jwt", b"webhook", b"conn")

_SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "pass": 0.7, "secret": 1.0, "secrets": 0.9, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "bearer": 0.9, "auth": 0.7, "authorization": 0.8, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "signature": 0.6, "salt": 0.7, "seed": 0.5, "pin": 0.6, "cookie": 0.6, "jwt": 0.9, "webhook": 0.6,
}
_PAIRS = {("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("encryption", "key"): 1.0, ("signing", "key"): 1.0, ("auth", "key"): 1.0, ("account", "key"): 0.9, ("master", "key"): 0.9, ("connection", "string"): 0.8, ("conn", "str"): 0.8}
_HARMLESS = {"count", "counts", "len", "length", "size", "type", "name", "field", "label", "prompt", "url", "uri", "path", "file", "expires", "expiry", "ttl", "regex", "pattern", "hint", "policy", "header", "max", "min", "limit", "index", "placeholder", "description", "public", "tokenizer", "column", "param"}
#: Texts that no secret has: anywhere, and at the end. <...> is for _angle.
_DUMMY = re.compile(rb"(?i)change.?me|example|dummy|placeholder|your[-_ ]|xxxx|\*\*\*|redacted|\$\{|\{\{|%\(|todo|env(?=\W)|getenv|process\.env")
_DUMMY_END = re.compile(rb"(?i)(?:none|null|true|false|undefined)$|env\Z")
#: Longer than what either matches.
_EDGE = 16


def sensitivity(name: bytes) -> float:
    """From 0 to 1, by the words of the name's last part."""
    words = [w.lower().decode() for w in _PARTS.findall(re.split(rb"[.\[]", name)[-1])]
    if not words or _HARMLESS & set(words):
        return 0.0
    return max([0.0, *(_SENSITIVE.get(w, 0.0) for w in words), *(_PAIRS.get(p, 0.0) for p in zip(words, words[1:]))])


def _angle(value: bytes) -> int:
    """What of <[^>]+> a value has at its end: 0 nothing, 1 the <, 2 more, 3 it has all of it."""
    *closed, last = value.split(b">")
    if any(0 <= x.find(b"<") < len(x) - 1 for x in closed):
        return 3
    at = last.find(b"<")
    return 0 if at < 0 else 1 if at == len(last) - 1 else 2


class _Look(NamedTuple):
    """What the strength of a value depends on, such that the looks of two values give that of both together."""

    n: int
    counts: Counter
    quoted: bool
    dummy: bool
    head: bytes
    tail: bytes
    angle: tuple[int, int, int, int]

    @classmethod
    def of(cls, value: bytes, quoted: bool) -> _Look:
        angle = (0, 1, 2, 3) if not value else tuple(_angle(x + value) for x in (b"", b"<", b"<x")) + (3,) if b"<" in value or b">" in value else (0, 2, 2, 3)
        return cls(len(value), Counter(value), quoted, _DUMMY.search(value) is not None, value[:_EDGE], value[-_EDGE:], angle)

    def then(self, other: _Look) -> _Look:
        counts = self.counts.copy()
        counts.update(other.counts)
        dummy = self.dummy or other.dummy or _DUMMY.search(self.tail + other.head) is not None
        return _Look(self.n + other.n, counts, self.quoted and other.quoted, dummy, (self.head + other.head)[:_EDGE], (self.tail + other.tail)[-_EDGE:], tuple(other.angle[x] for x in self.angle))

    def strength(self) -> float:
        """From 0 to 1: how much the value looks like a secret."""
        n, counts = self.n, self.counts
        if n < 8 or self.dummy or self.angle[0] == 3 or _DUMMY_END.search(self.tail):
            return 0.0
        classes = sum(any(lo <= c <= hi for c in counts) for lo, hi in ((48, 57), (65, 90), (97, 122))) + any(c < 127 and not chr(c).isalnum() for c in counts)
        if classes < 2 or (not self.quoted and not any(48 <= c <= 57 for c in counts)) or any(c <= 32 for c in counts):
            return 0.0
        entropy = -sum(k / n * math.log2(k / n) for k in counts.values() if k / n)
        return min(1.0, entropy / 4) * min(1.0, 0.6 + 0.15 * (classes - 1) + min(n, 80) / 80)


def strength(value: bytes, quoted: bool) -> float:
    return _Look.of(value, quoted).strength()


class _Run:
    """Bytes without a delimiter, each end of which may be the value of a sign within: looks at ends that become shorter share their counts."""

    def __init__(self, text: bytes, start: int, end: int) -> None:
        self.text, self.start, self.end, self.stop = text, start, end, end
        while self.stop > start and text[self.stop - 1] == 46:  # full stops at the end aren't of the value
            self.stop -= 1
        self.at, self.counts, self.last = end, None, -1

    def look(self, at: int) -> _Look:
        if self.counts is None or at < self.at:
            value = self.text[at : self.stop]
            self.counts, self.last = Counter(value), at - 1
            while m := _DUMMY.search(self.text, self.last + 1, self.stop):
                self.last = m.start()
        else:
            self.counts.subtract(self.text[self.at : at])
        self.at = at
        counts = Counter({c: k for c, k in self.counts.items() if k})
        return _Look(max(0, self.stop - at), counts, False, self.last >= at, self.text[at : min(self.stop, at + _EDGE)], self.text[max(at, self.stop - _EDGE) : self.stop], (0, 2, 2, 3) if at < self.stop else (0, 1, 2, 3))


class _Value:
    """A literal (from byte start to end, in a run if it has no quotes), or a sum of values, which constants share."""

    __slots__ = ("start", "end", "run", "parts", "look")

    def __init__(self, start: int = 0, end: int = 0, run: _Run | None = None, parts: list[_Value] | None = None) -> None:
        self.start, self.end, self.run, self.parts, self.look = start, end, run, parts, None

    def looked(self, text: bytes) -> _Look:
        todo = [self]
        while todo:
            x = todo[-1]
            if x.look is None and x.parts is None:
                x.look = x.run.look(x.start) if x.run else _Look.of(text[x.start : x.end], True)
            elif x.look is None:
                if missing := [p for p in x.parts if p.look is None]:
                    todo += missing
                    continue
                x.look = x.parts[0].look
                for p in x.parts[1:]:
                    x.look = x.look.then(p.look)
            todo.pop()
        return self.look

    def spans(self) -> Iterator[tuple[int, int]]:
        """The literals, each once."""
        todo, seen = [self], {id(self)}
        while todo:
            x = todo.pop()
            if x.parts is None:
                yield x.start, x.end
            for p in x.parts or ():
                if id(p) not in seen:
                    seen.add(id(p))
                    todo.append(p)


class _Names:
    """The values of names, by function: the outermost one is the file."""

    def __init__(self) -> None:
        self.known: dict[bytes, list[tuple[int, _Value | None]]] = {}
        self.functions: list[tuple[str, int, list[bytes]]] = [("file", -1, [])]

    def get(self, name: bytes) -> _Value | None:
        found = self.known.get(name)
        return found[-1][1] if found else None

    def set(self, name: bytes, value: _Value | None) -> None:
        here, depth = self.known.setdefault(name, []), len(self.functions)
        if here and here[-1][0] == depth:
            here[-1] = depth, value
        else:
            here.append((depth, value))
            self.functions[-1][2].append(name)

    def enter(self, kind: str, level: int, parameters: bytes) -> None:
        self.functions.append((kind, level, []))
        for m in _PARAMETER.finditer(parameters):
            self.set(m[0], None)

    def leave(self, kind: str, level: int) -> None:
        """Ends the functions of a kind that begin at this level, or, of lines, at a further one."""
        while (top := self.functions[-1])[0] == kind and (top[1] == level if kind == "brace" else top[1] >= level):
            for name in self.functions.pop()[2]:
                self.known[name].pop()


def _value(text: bytes, at: int, end: int, names: _Names, run: _Run) -> tuple[_Value | None, _Run]:
    """The value of the expression at a place; the last run of bytes without a delimiter."""
    parts: list[_Value] = []
    while True:
        if m := _STRING.match(text, at, end):
            parts.append(_Value(m.start(m.lastgroup), m.end(m.lastgroup)))
            at = m.end()
        elif m := _BLANKS.match(text, at, end):
            start = m.end()
            if not run.start <= start < run.end:
                if not (b := _BARE.match(text, start, end)):
                    break
                run = _Run(text, start, b.end())
            stop = max(start, run.stop)
            word = _IDENTIFIER.match(text, start, stop)
            known = names.get(word[0]) if word else None
            if known is not None:
                parts.append(known)
            elif not parts:
                return _Value(start, stop, run), run
            else:
                break
            at = run.end
        if not (j := _JOIN.match(text, at, end)):
            break
        at = j.end()
    return (parts[0] if len(parts) == 1 else _Value(parts=parts) if parts else None), run


def _block(text: bytes, sign: int, at: int, end: int) -> tuple[_Value | None, int]:
    """The lines of a block that are indented further than the line of its sign; where they end."""
    first = text.rfind(b"\n", 0, sign) + 1
    indent = len(text[first:sign]) - len(text[first:sign].lstrip(b" \t-"))
    parts = []
    while at < end and (m := _BLOCK_LINE.match(text, at, end)) and (not m["line"] or len(m["indent"]) > indent):
        if m["line"]:
            parts.append(_Value(*m.span("line")))
        at = m.end()
    return (_Value(parts=parts) if parts else None), at


def lexed_spans(text: bytes) -> list[tuple[int, int, bytes, float]]:
    """First byte, end, name and score of the literals that are assigned to sensitive names."""
    best: dict[tuple[int, int], tuple[bytes, float]] = {}
    back, size = text[::-1], len(text)
    regions: list[tuple[int, int, tuple[bytes, ...], bool]] = [(0, size, tuple(_QUOTED), True)]

    def assigned(name: bytes, value: _Value) -> None:
        level = sensitivity(name)
        if not level:
            return
        look = value.looked(text).strength()
        score = 0.6 * level + 0.4 * look
        if look and score >= THRESHOLD:
            for a, b in value.spans():
                if b > a and score > best.get((a, b), (b"", 0.0))[1]:
                    best[a, b] = (name, score)

    while regions:
        at, end, quotes, comments = regions.pop()
        begin, names, run, depth, open_ended = at, _Names(), _Run(text, 0, 0), 0, set()
        while m := _tokens(quotes, comments, names.functions[-1][0] == "lines").search(text, at, end):
            kind, at = m.lastgroup, m.end()
            if m["sign"]:
                found = _NAME.match(back, size - m.start(), size - begin)
                if not found:
                    continue
                if m["sign"] == b":" and (b := _BLOCK.match(text, at, end)):
                    value, at = _block(text, m.start(), b.end(), end)
                else:
                    value, run = _value(text, at, end, names, run)
                if value is not None:
                    name = found[1][::-1]
                    names.set(name, value)
                    assigned(name, value)
            elif kind == "string":
                sign = next(q for q in quotes if text.startswith(q, m.start()))
                inside = m.start() + len(sign), m.end() - len(sign)
                if text.find(b"=", *inside) >= 0 or text.find(b":", *inside) >= 0:
                    regions.append((*inside, tuple(q for q in quotes if q[:1] != sign[:1]), False))
            elif kind == "comment":
                closing = {b"/*": b"*/", b"<!--": b"-->"}.get(m[0])
                if closing:
                    at = -1 if closing in open_ended else text.find(closing, m.end(), end)
                    if at < 0:  # isn't closed
                        open_ended.add(closing)
                        at = m.end()
                        continue
                regions.append((m.start() + 2, at, quotes, False))
            elif m["brace"]:
                depth += 1 if m[0] == b"{" else -1
                if m[0] == b"}":
                    names.leave("brace", depth)
            elif m["tag"]:
                assigned(m["tag"], _Value(*m.span("text")))
            elif m["attr"]:
                assigned(m["attr"], _Value(*m.span("value")))
            elif m["head"]:
                if m["def"] is not None:
                    line = text[text.rfind(b"\n", 0, m.start()) + 1 : m.start()]
                    names.leave("lines", len(line) - len(line.lstrip(b" \t")))
                    names.enter("lines", len(line) - len(line.lstrip(b" \t")), m["def"])
                else:
                    if m["name"] not in _CONTROL:
                        names.enter("brace", depth, m["fun"] or m["arrow"] or b"")
                    depth += 1
            elif m.re.groupindex.get("indent") and m["indent"] is not None:
                names.leave("lines", len(m["indent"]))
    return [(a, b, n, s) for (a, b), (n, s) in best.items()]


def uncovered(spans: list[tuple[int, int]], base: list[tuple[str, int, int]]) -> list[bool]:
    """Which spans lie in no single span of base: of those that begin no later, none ends behind it."""
    order = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in order], list(accumulate((b for _, b in order), max))
    return [not (k := bisect_right(starts, a)) or reach[k - 1] < b for a, b in spans]


def find_secrets(text: bytes) -> list[Span]:
    """All spans of a text, by start and then kind. A literal that a base span covers isn't given again."""
    base = base_spans(text)
    found = [(k, a, b, "", 1.0) for k, a, b in base]
    if b"=" in text or b":" in text or b"</" in text:
        lower = text.lower()
        lexed = lexed_spans(text) if any(w in lower for w in _STEMS) else []
        found += [("literal", a, b, n.decode("ascii", "replace"), round(s, 4)) for (a, b, n, s), new in zip(lexed, uncovered([x[:2] for x in lexed], base)) if new]
    if not found:
        return []
    if not text.isascii():
        at, points, to = 0, 0, {}
        for edge in sorted({e for f in found for e in f[1:3]}):
            points += len(text[at:edge].decode("utf-8", "replace"))
            at, to[edge] = edge, points
        found = [(k, to[a], to[b], n, s) for k, a, b, n, s in found]
    return sorted((Span(*f) for f in found), key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and spans, an array of kind, start, end (code points), name and score. Null text
    counts as empty and has none; ids may be null or repeated. An empty table gives no rows."""
    schema = pa.schema([("doc_id", pa.int64()), ("spans", _SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield record_batch(schema, {"doc_id": batch["doc_id"], "spans": [[s._asdict() for s in find_secrets(t)] for t in utf8(batch["text"])]})

    rows = view(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,name:string,score:double>>")


def redact(docs: DataFrame, mask: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """docs with every span of the text replaced by mask (overlapping spans by one); the other columns stay. Null text stays
    null, texts of any length are searched whole, repeated rows are all kept, and an empty table gives no rows."""

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for s in find_secrets(text.encode("utf-8", "replace")):
            if s.start >= at:
                out += [text[at : s.start], mask]
            at = max(at, s.end)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            k = batch.schema.get_field_index(text_col)
            yield batch.set_column(k, batch.schema.field(k), pa.array([clean(t) for t in batch.column(k).to_pylist()], batch.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest of secret_spans: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_literal."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_literal", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in utf8(batch["text"]):
                spans = find_secrets(text)
                n = Counter(s.kind for s in spans)
                base = _joined([s for s in spans if s.kind != "literal"])
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(base.encode()).hexdigest(), _joined(spans), n["literal"]))
            yield record_batch(schema, {"doc_id": batch["doc_id"]} | {c: [r[k] for r in rows] for k, c in enumerate(schema.names[1:])})

    rows = view(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long")


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
