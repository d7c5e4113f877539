"""Secrets in texts: fixed patterns, and literals that reach a sensitively named target of an assignment.

Where a text has assignments it is lexed as source or configuration and parsed into pairs of a name and what it is given:
`name = "literal"`, `"name": 'literal'`, `name => word`, `name: Type = a + "b"`, `config["name"] = ...`, `name = call() or
"literal"`, lists, literals side by side, in parentheses or triple quotes and over line ends, YAML's block scalars, and
XML's attributes and elements. A call is no literal, nor are its arguments. Constants are followed by name in the order of
the text: a value refers to the values that it is made of, so sums of sums stay small. A value is reported, where its
literals were written, if the scores of the target's name and of the literals reach a threshold.

Every character is lexed once, and a value refers to others instead of copying them: the time grows with the text.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "literal")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX, LEAST_LITERAL = 6, 20, 24, 6
LEAST_SCORE = 4

_ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{%d,}" % LEAST_HEX)
#: A text without any of these, in lower case, holds no assignment of the first kind.
_CUES = ("passw", "secret", "token", "api")

#: In lower case, a name that is sensitive holds one of these.
_NAME_CUES = ("pass", "pwd", "secret", "key", "token", "cred", "auth", "bearer")

_SIGN = re.compile(r"[=:]|<-")
# A quote without an end on its line stays a lone character: those behind it on the line are escaped, so none is tried twice.
_TOKEN = re.compile(
    r"""(?P<string>(?:[rRbBfFuUL@$]{1,2}(?=["'`]))?(?:"(?:[^"\\\n]++|\\[^\n])*+"|'(?:[^'\\\n]++|\\[^\n])*+'|`[^`\n]*+`))"""
    r"""|(?P<escaped>\\"[^"\\\n]*+\\"|\\'[^'\\\n]*+\\')"""
    r"""|(?P<sign>:=|=>|<-(?!-)|\?\?=|\|\|=|\+=|\?=|=(?![=~])|:(?!:))"""
    r"""|(?P<either>\|\||\?\?|\bor\b)"""
    r"""|(?P<prose>(?:[a-z]++,?[ ](?=[A-Za-z])){4,}+)"""
    r"""|(?P<name>[A-Za-z_$][\w$]*+(?:'(?:s|t|re|ve|ll|d|m)\b|(?:[.-][A-Za-z_$][\w$]*+)*+))"""
    r"""|(?P<number>\d[\w.]*+)"""
    r"""|(?P<plus>\+(?!\+)|\.\.?(?=[ \t]*["'`])|&(?=[ \t]*["']))"""
    r"""|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<comma>,)"""
    r"""|(?P<joined>\\\r?\n)|(?P<newline>\r?\n)|(?P<blank>[ \t\f\v]++)"""
    r"""|(?P<other>[=!<>]=+|=~|::|\\.|[^\n])"""
)
STRING, SIGN, EITHER, NAME, NUMBER, PLUS, OPEN, CLOSE, COMMA, JOINED, NEWLINE, OTHER, ESCAPED = range(13)
_KIND = {"string": STRING, "escaped": ESCAPED, "sign": SIGN, "either": EITHER, "name": NAME, "number": NUMBER, "plus": PLUS, "open": OPEN, "close": CLOSE, "comma": COMMA, "joined": JOINED, "newline": NEWLINE, "other": OTHER, "prose": OTHER}
_KINDS = bytes(_KIND.get(n, 255) for n in ("", *sorted(_TOKEN.groupindex, key=_TOKEN.groupindex.get)))
_CODE = re.compile(r"""\(|[ \t]*=[ \t]*["'`]""")
_WORD = re.compile(r"""[^\s,;#"'`()\[\]{}<>]+""")
_MORE, _SUM, _MARGIN = re.compile(r"[ \t\r]*[^ \t\r\n]"), re.compile(r"[ \t]*(?:\+|\|\||\?\?|or\b)"), re.compile(r"[ -]*")
_BLOCK_SCALAR = re.compile(r"[ \t]*[|>][-+0-9]{0,2}[ \t]*(?:#[^\n]*)?\r?\n")
_XML_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)((?:\s[^<>]*+)?)>([^<>\n]++)</")
_DEFINE = re.compile(r"""^[ \t]*#[ \t]*define[ \t]++([A-Za-z_]\w*+)[ \t]++"([^"\\\n]*+)\"""", re.M)
_XML_KEY = re.compile(r"""\b(?:key|name|id)\s*=\s*["']([^"'<>]*)["']""")
_KEY_NAMES, _VALUE_NAMES = frozenset({"key", "name", "id"}), frozenset({"value", "val", "default", "content"})
#: After one of these a colon opens a block.
_STATEMENTS = frozenset("if elif while for case with except when switch".split())
#: Tokens lexed at a time.
TOKENS_AT_ONCE = 32
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_STRONG = frozenset("password passwd pwd passphrase secret apikey privatekey accesskey secretkey signingkey encryptionkey".split())
_WEAK = frozenset("token credential credentials auth authtoken bearer pass".split())
_HOLLOW = re.compile(r"(?i)^(?:x+|\*+|\.+|changeme|example|placeholder|password|secret|none|null|true|false|undefined|your[-_ ].*|<.*>|\$\{?.*|%\(?.*|\{\{.*)$")


@dataclass(frozen=True)
class Span:
    """Where a secret is, in code points; value_start and value_end bound what must not be seen."""

    kind: str
    start: int
    end: int
    value_start: int
    value_end: int


def name_score(name: str) -> int:
    """3 for a name that says secret, 2 for one that may, 1 for some key, 0 for others."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    parts = [p[:-1] if p.endswith("s") and p[:-1] in _STRONG | _WEAK else p for p in parts]
    words = set(parts) | {a + b for a, b in zip(parts, parts[1:], strict=False)}
    return 3 if words & _STRONG else 2 if words & _WEAK else 1 if "key" in words else 0


def literal_score(value: str) -> int:
    """Up to 3 for what looks made by a machine, below 0 for stand-ins and prose."""
    if _HOLLOW.match(value) or re.search(r"\s", value):
        return -4
    counts, n = Counter(value), len(value)
    bits = -sum(c / n * math.log2(c / n) for c in counts.values())
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    return (n >= 8) + mixed + (bits >= 3)


def _base(text: str) -> list[Span]:
    out = []
    lower = text.lower()
    if any(cue in lower for cue in _CUES):
        out += [Span("assign", *m.span(), *m.span(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [Span("access", *m.span(), *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out + [Span("hex", *m.span(), *m.span()) for m in _HEX.finditer(text)]


class _Value:
    """What a name was given: literals written there, values of other names, and what both tell about the whole."""

    __slots__ = ("spans", "parts", "size", "digit", "alpha", "odd", "letters")

    def __init__(self, text: str, spans: list[tuple[int, int]], parts: list[_Value]):
        self.spans, self.parts = spans, list({id(p): p for p in parts}.values())
        words = [text[a:b] for a, b in spans]
        self.size = min(sum(map(len, words)) + sum(p.size for p in self.parts), 1 << 20)
        self.digit = any(c.isdigit() for w in words for c in w) or any(p.digit for p in self.parts)
        self.alpha = any(c.isalpha() for w in words for c in w) or any(p.alpha for p in self.parts)
        self.odd = any(_HOLLOW.match(w) or re.search(r"\s", w) for w in words) or any(p.odd for p in self.parts)
        self.letters = 0
        for w in words:
            for c in set(w):
                self.letters |= 1 << ord(c) % 128
        for p in self.parts:
            self.letters |= p.letters

    def score(self, text: str) -> int:
        if len(self.spans) == 1 and not self.parts:
            return literal_score(text[slice(*self.spans[0])])
        return -4 if self.odd else (self.size >= 8) + (self.digit and self.alpha) + (self.letters.bit_count() >= 8)


class _Parser:
    """Over the lines of a text from one with an assignment on; lines are lexed as the parser comes to them."""

    def __init__(self, text: str):
        self.text, self.constants, self.found = text, {}, set()
        self.reported: set[int] = set()
        self.no_end: set[str] = set()
        self.run_start = self.run_end = self.taken = 0
        self.last_digit = self.last_letter = self.last_sign = -1
        self.read(0)

    def read(self, at: int) -> None:
        self.kinds, self.starts, self.ends = bytearray(), array("q"), array("q")
        self.pairs: dict[int, int] = {}
        self.at = at
        self.tag_key = None

    def more(self) -> bool:
        """Lex the next tokens, not beyond the end of the line."""
        if self.at >= len(self.text):
            return False
        for m in islice(_TOKEN.finditer(self.text, self.at), TOKENS_AT_ONCE):
            kind = _KINDS[m.lastindex]
            self.at = m.end()
            if kind != 255:
                self.kinds.append(kind)
                self.starts.append(m.start())
                self.ends.append(m.end())
                if kind in (NEWLINE, JOINED):
                    break
        return True

    def kind(self, k: int) -> int | None:
        while k >= len(self.kinds):
            if not self.more():
                return None
        return self.kinds[k]

    def word(self, k: int) -> str:
        return self.text[self.starts[k] : self.ends[k]]

    def closing(self, k: int) -> int:
        """The token that closes the bracket at `k`, or the last there is; brackets within are settled on the way."""
        if k not in self.pairs:
            stack, i = [k], k + 1
            while stack and (kind := self.kind(i)) is not None:
                if kind == OPEN:
                    stack.append(i)
                elif kind == CLOSE:
                    self.pairs[stack.pop()] = i
                i += 1
            for j in stack:
                self.pairs[j] = i - 1
        return self.pairs[k]

    def literal(self, k: int) -> tuple[int, int]:
        """Within the quotes of a string."""
        a, b = self.starts[k], self.ends[k]
        if self.kinds[k] == ESCAPED:
            return a + 2, b - 2
        while self.text[a] not in "\"'`":
            a += 1
        return a + 1, b - 1

    def lines(self, a: int, b: int) -> list[tuple[int, int]]:
        """What text[a:b] has on each line, without the space around."""
        out = []
        for m in re.finditer(r"[^\n]+", self.text[a:b]):
            line = m.group()
            if inner := line.strip():
                start = a + m.start() + len(line) - len(line.lstrip())
                out.append((start, start + len(inner)))
        return out

    def resume(self, k: int, at: int, string: int | None = None) -> int:
        """Forget the tokens from `k` on and lex on from `at`; one string from `string` to there takes their place."""
        del self.kinds[k:], self.starts[k:], self.ends[k:]
        self.at = at
        if string is None:
            return k
        self.kinds.append(STRING)
        self.starts.append(string)
        self.ends.append(at)
        return k + 1

    def next_sign(self, k: int) -> bool:
        return self.kind(k) == SIGN and self.word(k) in ("=", ":", "=>")

    def value(self, k: int, block: bool) -> _Value | None:
        """What the sign before token `k` assigns; None if no literal is in it."""
        text, spans, parts = self.text, [], []
        stack: list[str] = []
        need, first, crossed, joined, ternary = True, True, False, False, False
        scalar = _BLOCK_SCALAR.match(text, self.ends[k - 1]) if self.word(k - 1) == ":" else None
        if scalar:
            line = text.rfind("\n", 0, self.starts[k - 1]) + 1
            margin = _MARGIN.match(text, line).end() - line
            at = scalar.end()
            while at < len(text):
                stop = text.find("\n", at) + 1 or len(text)
                own = text[at:stop]
                if own.strip() and len(own) - len(own.lstrip(" ")) <= margin:
                    break
                at = stop
            spans = self.lines(scalar.end(), at)
            self.resume(k, at)
            return _Value(text, spans, []) if spans else None
        while (kind := self.kind(k)) is not None:
            a = self.starts[k]
            if kind == NEWLINE:
                if not stack and (block or not need):
                    more = self.kind(k + 1) in (PLUS, EITHER) if not need else False
                    if not more:
                        break
                crossed = True
                k += 1
            elif kind == JOINED:
                joined = True
                k += 1
            elif kind in (STRING, ESCAPED):
                if not need and not stack and crossed and not joined:
                    break
                if (crossed or stack) and self.next_sign(k + 1) and not ternary:
                    break  # a key
                quote = text[self.ends[k] - 1] * 3
                if kind == STRING and self.ends[k] - a == 2 and text.startswith(quote, a) and quote not in self.no_end:
                    end = text.find(quote, a + 3)
                    if end < 0:
                        self.no_end.add(quote)
                        break
                    spans += self.lines(a + 3, end)
                    k = self.resume(k, end + 3, a)
                else:
                    span = self.literal(k)
                    if span[1] > span[0]:
                        spans.append(span)
                    k += 1
                need = joined = crossed = first = False
            elif kind == OPEN:
                if not need:
                    break
                stack.append(text[a])
                k += 1
            elif kind == CLOSE:
                if not stack:
                    break
                stack.pop()
                need = first = False
                k += 1
            elif kind == COMMA:
                if not stack:
                    break
                need, crossed = True, False
                k += 1
            elif kind in (PLUS, EITHER):
                need, first, crossed = True, first and need, False
                k += 1
            elif kind == SIGN and ternary and not need and self.word(k) == ":":
                need, ternary = True, False
                k += 1
            elif kind == OTHER and stack and (text[a] == "#" or text.startswith("//", a)):
                while self.kind(k) not in (NEWLINE, None):
                    k += 1
            elif kind in (NAME, NUMBER, OTHER) and need:
                end = self.bare(a) if first and not stack else a
                mixed = end > a and min(self.last_digit, self.last_letter) >= a
                after = self.kind(k + 1)
                glued = after is not None and self.starts[k + 1] == self.ends[k]
                if kind == NAME and after == OPEN and glued:
                    k = self.closing(k + 1) + 1  # a call, or a part of something
                elif kind == NAME and self.next_sign(k + 1) and not (glued and not crossed and end > self.ends[k + 1] + 1 and mixed):
                    break  # a key, a type, or another target
                elif kind == NAME and self.word(k) in self.constants:
                    parts.append(self.constants[self.word(k)])
                    k += 1
                elif mixed and self.alone(a, end, crossed):
                    spans.append((a, end))  # a bare word, as configuration has it
                    self.taken = end
                    break
                elif kind == OTHER and text[a] in ";#" or text.startswith("//", a):
                    break
                else:
                    k += 1
                    if kind == OTHER:
                        continue
                need = first = False
            elif kind == OTHER and text[a] == "?":
                need = ternary = True
                k += 1
            elif kind == OTHER and text[a] == "." and self.kind(k + 1) == NAME:
                k += 2  # a method of what stands before
                if self.kind(k) == OPEN:
                    k = self.closing(k) + 1
            else:
                break
        return _Value(text, spans, parts) if spans or parts else None

    def bare(self, a: int) -> int:
        """Where the run of characters from `a` to white space, a quote, a bracket or the like ends; `a` if there is none.

        Places in one run end alike, so a run is looked at once: where it ends, and where its last digit, its last letter
        and its last sign before any equals signs at its end are."""
        if not self.run_start <= a < self.run_end:
            m = _WORD.match(self.text, a)
            self.run_start, self.run_end = a, m.end() if m else a
            run = self.text[a : self.run_end]
            last = lambda test: a + next((i for i in range(len(run) - 1, -1, -1) if test(run[i])), -1 - a)
            self.last_digit, self.last_letter = last(str.isdigit), last(str.isalpha)
            body = run.rstrip("=")
            self.last_sign = a + max(body.rfind("="), body.rfind(":")) if "=" in body or ":" in body else -1
        return self.run_end

    def alone(self, a: int, end: int, crossed: bool) -> bool:
        """Not the start of a call, a subscript or a sum; on a line of its own, nothing else may stand there."""
        text = self.text
        if crossed:
            return self.last_sign < a and not _MORE.match(text, end)
        return text[end : end + 1] not in ("(", "[") and not _SUM.match(text, end)

    def target(self, i: int) -> int | None:
        """The token with the name that ends before token `i`: a name or string there, or the key of a subscript. The
        sign before is not passed, so tokens between two signs are walked once."""
        while i > 0:
            kind, mark = self.kinds[i - 1], self.text[self.starts[i - 1]]
            if kind in (NAME, STRING, ESCAPED):
                return i - 1
            if kind == OTHER and mark in "?!":
                i -= 1
            elif kind == CLOSE and mark == "]":
                if i > 1 and self.kinds[i - 2] in (NAME, STRING, ESCAPED):
                    return i - 2
                i -= 1  # a number or nothing: what has the subscript counts
                while i > 0 and self.kinds[i - 1] != SIGN and self.text[self.starts[i - 1]] != "[":
                    i -= 1
                if i <= 0 or self.kinds[i - 1] == SIGN:
                    return None
                i -= 1
            else:
                return None
        return None

    def annotated(self, i: int) -> int | None:
        """Of an equals sign at token `i`: the colon that a type between both follows, if there is one."""
        depth, named = 0, False
        for k in range(i - 1, 0, -1):
            kind, mark = self.kinds[k], self.text[self.starts[k]]
            if kind == SIGN:
                return k if mark == ":" and named and depth == 0 else None
            if kind == NAME:
                named = True
            elif mark in "]>)":
                depth += 1
            elif mark in "[<(":
                depth -= 1
            elif not (mark in "|&*?.'" or depth > 0 and kind in (STRING, COMMA)):
                return None
            if depth < 0:
                return None
        return None

    def name(self, k: int) -> str:
        return self.text[slice(*self.literal(k))] if self.kinds[k] in (STRING, ESCAPED) else self.word(k)

    def report(self, value: _Value) -> None:
        """The literals that `value` is made of; what was reported before is not walked again."""
        todo = [value]
        while todo:
            v = todo.pop()
            if id(v) not in self.reported:
                self.reported.add(id(v))
                self.found.update(v.spans)
                todo += v.parts

    def judge(self, name: str, value: _Value) -> None:
        grade = name_score(name)
        if grade and value.size >= LEAST_LITERAL and grade + value.score(self.text) >= LEAST_SCORE:
            self.report(value)

    def assign(self, i: int, opened: bool) -> None:
        """Of the sign at token `i`: its targets, and what they are given. `opened`: a colon on this line opens a block."""
        text, mark = self.text, self.word(i)
        site = self.target(i)
        sites = [site] if site is not None else []
        if mark == "=" and not opened and (colon := self.annotated(i)) is not None and (typed := self.target(colon)) is not None:
            sites.append(typed)
        if not sites:
            return
        value = self.value(i + 1, opened and mark == ":")
        # a = b = literal gives all of them
        while value is not None and mark == "=" and sites[-1] >= 2 and self.kinds[sites[-1] - 1] == SIGN and self.word(sites[-1] - 1) == "=" and self.kinds[sites[-1] - 2] == NAME and sites[-1] - 2 not in sites:
            sites.append(sites[-1] - 2)
        names = [self.name(k) for k in sites]
        plain = [n for k, n in zip(sites, names, strict=True) if self.kinds[k] == NAME and self.kinds[k + 1] != CLOSE]
        if value is None:
            for n in plain if mark != ":" else ():  # behind a colon stands a type, it may be
                self.constants.pop(n, None)
            return
        self.kept.append(value)
        for n in plain:
            self.constants[n] = value
        if names[0].lower() in _KEY_NAMES and len(value.spans) == 1:
            self.tag_key = text[slice(*value.spans[0])]
        elif names[0].lower() in _VALUE_NAMES and self.tag_key:
            names.append(self.tag_key)
        for n in names:
            self.judge(n, value)

    def run(self) -> list[tuple[int, int]]:
        text, at = self.text, 0
        self.kept: list[_Value] = []  # so that no id is given twice
        while m := _SIGN.search(text, at):
            self.read(max(at, text.rfind("\n", 0, m.start()) + 1))
            i, opened = 0, False
            while True:
                if i == len(self.kinds):
                    if self.kinds and self.kinds[-1] in (NEWLINE, JOINED) or not self.more():
                        break
                    continue
                kind = self.kinds[i]
                if kind == SIGN and i and self.starts[i] >= self.taken:
                    self.assign(i, opened)
                elif not opened and kind in (NAME, OTHER):
                    opened = self.word(i).split(" ", 1)[0] in _STATEMENTS
                elif kind == NEWLINE:
                    opened = False
                elif kind == OTHER and text[self.starts[i]] in "<>":
                    self.tag_key = None
                i += 1
            at = self.at
        if "define" in text:
            for m in _DEFINE.finditer(text):
                value = _Value(text, [m.span(2)], [])
                self.kept.append(value)
                self.judge(m.group(1), value)
        if "</" in text:
            for m in _XML_ELEMENT.finditer(text):
                a, b = m.span(3)
                word = m.group(3).strip()
                a += len(m.group(3)) - len(m.group(3).lstrip())
                if word:
                    value = _Value(text, [(a, a + len(word))], [])
                    self.kept.append(value)
                    for n in (m.group(1), *(k.group(1) for k in _XML_KEY.finditer(m.group(2)))):
                        self.judge(n, value)
        return sorted(s for s in self.found if s[1] > s[0])


def _named(text: str) -> list[tuple[int, int]]:
    """Literals that reach a sensitive name."""
    lower = text.lower()
    return _Parser(text).run() if any(cue in lower for cue in _NAME_CUES) else []


def find_secrets(text: str | None) -> list[Span]:
    """By start, then kind in the order of KINDS. A literal that a pattern's span covers is not reported again."""
    if not text:
        return []
    spans = _base(text)
    # by start: the furthest end of the patterns' spans that begin there or before
    starts, reach = sorted(s.start for s in spans), []
    for s in sorted(spans, key=lambda s: s.start):
        reach.append(max(s.end, reach[-1] if reach else 0))
    for a, b in _named(text):
        i = bisect_right(starts, a)
        if not i or reach[i - 1] < b:
            spans.append(Span("literal", a, b, a, b))
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind)))


def redacted(text: str | None) -> str | None:
    """The text with each secret value replaced by <SECRET>; overlapping values give one mark. What the pattern of
    assignments takes for a value, but is a call or a type, stays."""
    spans = sorted((s.value_start, s.value_end) for s in find_secrets(text) if s.kind != "assign" or not _CODE.match(text, s.value_end))
    if not spans:
        return text
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], "<SECRET>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


@F.pandas_udf(_SPANS)
def _spans_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([[(s.kind, s.start, s.end) for s in find_secrets(t)] for t in texts])


@F.pandas_udf(T.StringType())
def _redact_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([redacted(t) for t in texts], dtype=object)


def secret_spans(text: Column) -> Column:
    """An array of (kind, start, end) over the whole text, in code points, end exclusive; empty for a null text."""
    return _spans_udf(text)


def without_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with the secret values in `text_col` replaced; every row and column stays."""
    return df.withColumn(text_col, _redact_udf(F.col(text_col)))


def secret_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `df`: counts of the patterns' spans, a digest of them, and all spans in writing.

    A null text counts as empty; repeated rows each have theirs; other columns are ignored.
    """
    found = df.select(F.col(id_col).alias("doc_id"), secret_spans(F.col(text_col).cast("string")).alias("found"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.filter("found", lambda s: s["kind"] == kind)
    counts = [F.size(of(kind)).cast("bigint").alias(f"n_{kind}") for kind in KINDS[:3]]
    base = F.filter("found", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
