"""Patterns of rules are RE2 patterns. This module says whether a pattern is one, and writes it for java.util.regex, which
Spark uses, so that both engines find the same matches."""

from __future__ import annotations

from dataclasses import dataclass

WORD = "0-9A-Za-z_"
_BEFORE, _AFTER, _NOT_BEFORE, _NOT_AFTER = f"(?<=[{WORD}])", f"(?=[{WORD}])", f"(?<![{WORD}])", f"(?![{WORD}])"
_PERL = {"d": "0-9", "w": WORD, "s": r"\t\n\f\r "}
_POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~",
    "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": WORD, "xdigit": "0-9A-Fa-f",
}
_CONTROL = {"t": "\\t", "n": "\\n", "r": "\\r", "f": "\\f", "v": "\\x0B", "a": "\\x07"}
_CATEGORIES = "L M N P S Z C Lu Ll Lt Lm Lo Mn Mc Me Nd Nl No Pc Pd Ps Pe Pi Pf Po Sm Sc Sk So Zs Zl Zp Cc Cf Co Cs".split()
MAX_REPEAT = 1000


class NotRE2(ValueError):
    """The pattern uses what RE2 does not have."""


@dataclass
class _Node:
    """A part of a pattern in Java's syntax. words: it always matches at least a character, and the first and the last
    one are word characters. empty: it may match nothing. longest: the most characters that it matches, None if there is
    no limit. digit: every match has an ASCII digit."""

    text: str
    empty: bool = False
    starts_word: bool = False
    ends_word: bool = False
    boundary: bool = False
    longest: int | None = 1
    digit: bool = False


def _longest(nodes: list[_Node], whole) -> int | None:
    """`whole` (sum or max) of what the nodes match at most."""
    return None if any(x.longest is None for x in nodes) else whole([x.longest for x in nodes] or [0])


class _Parser:
    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0
        self.fold = self.dot_all = self.lines = self.anchored = False

    def peek(self, n: int = 1) -> str:
        return self.p[self.i : self.i + n]

    def take(self) -> str:
        if self.i >= len(self.p):
            raise NotRE2("unexpected end of pattern")
        self.i += 1
        return self.p[self.i - 1]

    def alternatives(self) -> _Node:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]
        return _Node("|".join(x.text for x in parts), any(x.empty for x in parts), all(x.starts_word for x in parts), all(x.ends_word for x in parts), False, _longest(parts, max), all(x.digit for x in parts))

    def sequence(self) -> _Node:
        nodes: list[_Node] = []
        while self.peek() not in ("", "|", ")"):
            node = self.repeated()
            if node is not None:
                nodes.append(node)
        out = []
        for k, node in enumerate(nodes):
            if node.boundary:
                after, before = nodes[k + 1 : k + 2], nodes[k - 1 : k] if k else []
                if after and after[0].starts_word and not self.fold:
                    out.append(_NOT_BEFORE)
                    continue
                if before and before[0].ends_word and not self.fold:
                    out.append(_NOT_AFTER)
                    continue
            out.append(node.text)
        solid = [x for x in nodes if not x.boundary]
        empty = all(x.empty for x in solid)
        return _Node("".join(out), empty, bool(solid) and solid[0].starts_word, bool(solid) and solid[-1].ends_word, False, _longest(nodes, sum), any(x.digit for x in nodes))

    def repeated(self) -> _Node | None:
        node = self.atom()
        if node is None:
            return None
        count = 0
        while True:
            c = self.peek()
            if c and c in "*+?":
                self.take()
                least, most, quantifier = (0 if c in "*?" else 1), (1 if c == "?" else None), c
            elif c == "{" and (found := self.braces()):
                least, most, quantifier = found
            else:
                return node
            count += 1
            if count > 1:
                raise NotRE2("possessive or repeated repetition")
            if self.peek() == "?":
                self.take()
                quantifier += "?"
            empty = node.empty or least == 0
            longest = node.longest * most if most is not None and node.longest is not None else 0 if node.longest == 0 else None
            node = _Node(node.text + quantifier, empty, node.starts_word and not empty, node.ends_word and not empty, False, longest, node.digit and least > 0)

    def braces(self) -> tuple[int, int | None, str] | None:
        end = self.p.find("}", self.i)
        body = self.p[self.i + 1 : end] if end > 0 else ""
        low, comma, high = body.partition(",")
        if not low.isdecimal() or (high and not high.isdecimal()):
            return None
        if int(low) > MAX_REPEAT or int(high or 0) > MAX_REPEAT or (high and int(high) < int(low)):
            raise NotRE2("repetition out of range")
        self.i = end + 1
        most = int(high) if high else None if comma else int(low)
        return int(low), most, "{" + low + comma + high + "}"

    def atom(self) -> _Node | None:
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return self.bracket()
        if c == ".":
            return _Node(r"[\s\S]" if self.dot_all else r"[^\n]")
        if c == "^":
            self.anchored = True
            return _Node(r"(?<![^\n])" if self.lines else r"\A", True, longest=0)
        if c == "$":
            self.anchored = True
            return _Node(r"(?![^\n])" if self.lines else r"\z", True, longest=0)
        if c == "\\":
            return self.escape()
        if c in "*+?":
            raise NotRE2("nothing to repeat")
        word = c.isascii() and (c.isalnum() or c == "_") and not self.fold
        return _Node("\\" + c if c in "{}]" else c, False, word, word, digit=c in "0123456789")

    def group(self) -> _Node | None:
        opening = "("
        if self.peek() == "?":
            self.take()
            for form in ("P<", "<"):
                name = self.p[self.i + len(form) :].partition(">")[0]
                if self.p.startswith(form, self.i) and name.isidentifier():
                    self.i += len(form) + len(name) + 1
                    opening = f"(?<{name}>"
                    break
            else:
                if self.peek() in ("=", "!", ">") or self.peek(2) in ("<=", "<!", "P=", "P>"):
                    raise NotRE2("lookaround, atomic group or named reference")
                flags = ""
                while self.peek() not in (":", ")"):
                    flags += self.take()
                self.flags(flags)
                if self.take() == ")":
                    return None
                opening = "(?:"
        kept = self.fold, self.dot_all, self.lines
        inner = self.alternatives()
        if self.peek() != ")":
            raise NotRE2("missing )")
        self.take()
        self.fold, self.dot_all, self.lines = kept
        return _Node(opening + inner.text + ")", inner.empty, inner.starts_word, inner.ends_word, False, inner.longest, inner.digit)

    def flags(self, flags: str) -> None:
        on, _, off = flags.partition("-")
        if set(on + off) - set("ism"):
            raise NotRE2(f"flags {flags!r}")
        if off or ("i" in on and self.i > 4):
            raise NotRE2("flags that are not at the start of the pattern")
        self.fold |= "i" in on
        self.dot_all |= "s" in on
        self.lines |= "m" in on

    def escape(self) -> _Node:
        c = self.take()
        if c == "b":
            return _Node(f"(?:{_BEFORE}{_NOT_AFTER}|{_NOT_BEFORE}{_AFTER})", True, boundary=True, longest=0)
        if c == "B":
            return _Node(f"(?:{_BEFORE}{_AFTER}|{_NOT_BEFORE}{_NOT_AFTER})", True, longest=0)
        if c in "Az":
            self.anchored = True
            return _Node("\\" + c, True, longest=0)
        if c in "Q":
            end = self.p.find("\\E", self.i)
            body = self.p[self.i : end if end >= 0 else len(self.p)]
            self.i = end + 2 if end >= 0 else len(self.p)
            return _Node("(?:" + "".join("\\" + x if not x.isalnum() and x.isascii() else x for x in body) + ")", not body, longest=len(body), digit=any(x in "0123456789" for x in body))
        if c.lower() in _PERL:
            word = c in "dw" and not self.fold
            return _Node(f"[{'^' if c.isupper() else ''}{_PERL[c.lower()]}]", False, word, word, digit=c == "d")
        if c in "pP":
            return _Node(self.unicode_class(c))
        return _Node(self.single(c))

    def unicode_class(self, c: str) -> str:
        name = self.take()
        if name == "{":
            end = self.p.index("}", self.i)
            name, self.i = self.p[self.i : end], end + 1
        if name.startswith("^"):
            c, name = ("P" if c == "p" else "p"), name[1:]
        return f"\\{c}{{{name if name in _CATEGORIES else 'Is' + name}}}"

    def single(self, c: str) -> str:
        """One character, escaped."""
        if c in _CONTROL:
            return _CONTROL[c]
        if c == "x":
            if self.peek() == "{":
                end = self.p.index("}", self.i)
                code, self.i = self.p[self.i + 1 : end], end + 1
            else:
                code = self.take() + self.take()
            return f"\\x{{{int(code, 16):X}}}"
        if c == "0":
            code = "0"
            while len(code) < 3 and self.peek() and self.peek() in "01234567":
                code += self.take()
            return f"\\x{{{int(code, 8):X}}}"
        if c.isalnum():
            raise NotRE2(f"\\{c}: a reference or an unknown escape")
        return "\\" + c

    def bracket(self) -> _Node:
        negated = self.peek() == "^"
        if negated:
            self.take()
        out, word, first = "", True, True
        while first or self.peek() != "]":
            first = False
            c = self.take()
            if c == "[" and self.peek() == ":" and ":]" in self.p[self.i :]:
                end = self.p.index(":]", self.i)
                name, self.i = self.p[self.i + 1 : end], end + 2
                inverse = name.startswith("^")
                if name.lstrip("^") not in _POSIX:
                    raise NotRE2(f"class {name}")
                body = _POSIX[name.lstrip("^")]
                out += f"[^{body}]" if inverse else body
                word &= not inverse and name in ("alnum", "alpha", "digit", "lower", "upper", "word", "xdigit")
                continue
            if c == "\\":
                c = self.take()
                if c.lower() in _PERL:
                    out += _PERL[c] if c.islower() else f"[^{_PERL[c.lower()]}]"
                    word &= c in "dw"
                elif c in "pP":
                    out += self.unicode_class(c)
                    word = False
                else:
                    out += self.single(c)
                    word = False
                continue
            if c in "[&^~" or (c == "-" and self.peek() == "]"):
                out += "\\" + c
                word = False
                continue
            out += c
            word &= c == "-" or c == "_" or (c.isascii() and c.isalnum())
        self.take()
        word &= not negated and not self.fold and "-" not in (out[:1], out[-1:])
        digit = not negated and bool(out) and not set(out) - set("0123456789-") and "-" not in (out[:1], out[-1:])
        return _Node(f"[{'^' if negated else ''}{out}]", False, word, word, digit=digit)


def _parsed(pattern: str) -> tuple[_Node, _Parser]:
    parser = _Parser(pattern)
    node = parser.alternatives()
    if parser.i < len(pattern):
        raise NotRE2("unmatched )")
    return node, parser


def to_java(pattern: str) -> str:
    """The same pattern for java.util.regex. NotRE2 for one that RE2 would refuse; ValueError for one that may match an
    empty text, which rules must not."""
    node, parser = _parsed(pattern)
    if node.empty:
        raise ValueError(f"the pattern may match an empty text: {pattern}")
    return ("(?iu)" if parser.fold else "") + node.text


def reach(pattern: str) -> int | None:
    """The most characters of a match, if each match has a digit and where it stands in the text does not matter; else None.
    Whether a pattern with a reach matches shows in the characters around digits alone."""
    node, parser = _parsed(pattern)
    return node.longest if node.digit and not parser.anchored else None


def classify(pattern: str) -> str | None:
    """None if RE2 takes the pattern, else the reason why not."""
    try:
        _parsed(pattern)
    except (NotRE2, ValueError, IndexError) as e:
        return str(e) or type(e).__name__
    return None
