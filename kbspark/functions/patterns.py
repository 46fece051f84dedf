"""Regular expressions of policies: a linear-time dialect (no look-around, back references, possessive or atomic groups), written anew for the JVM.

Where both know a construct but mean different things by it, it is replaced: ``$`` is the end of the text, a dot anything but a
newline, ``\\s`` leaves out the vertical tab, ``\\v`` is that alone, brackets and ampersands in a class are themselves.
"""

from __future__ import annotations

import re

#: Letters that a backslash may stand before, and what the JVM gets: fixed values.
_ESCAPES = {c: f"\\{c}" for c in "dDwWbBAzaftnr"} | {"v": "\\x0B", "s": "[\\t\\n\\f\\r ]", "S": "[^\\t\\n\\f\\r ]"}
_CLASSES = {"s": "\\t\\n\\f\\r ", "v": "\\x0B"}
#: Named classes of the dialect, and the JVM's: fixed values.
_POSIX = {"alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit"}
_REPEAT = re.compile(r"\{(\d+)(,(\d*))?\}")
MOST_REPEATS = 1000


class PatternError(ValueError):
    pass


class _Reader:
    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0
        self.lines = bool(re.search(r"\(\?[a-zA-Z]*m", pattern))

    def _fail(self, what: str) -> PatternError:
        return PatternError(f"{what} at {self.at} of {self.pattern!r}")

    def _hex(self) -> str | None:
        """The character of \\x7F or \\x{10FFFF} at the place, as the JVM writes it."""
        m = re.compile(r"x(?:([0-9A-Fa-f]{2})|\{([0-9A-Fa-f]{1,6})\})").match(self.pattern, self.at)
        if not m or int(m[1] or m[2], 16) > 0x10FFFF:
            raise self._fail("bad hexadecimal escape")
        self.at = m.end()
        return f"\\x{{{m[1] or m[2]}}}"

    def _property(self) -> str:
        m = re.compile(r"([pP])(?:([A-Za-z])|\{(\^?)([A-Za-z_]+)\})").match(self.pattern, self.at)
        if not m:
            raise self._fail("bad property")
        self.at = m.end()
        negated, name = (m[1] == "P") != bool(m[3]), m[2] or m[4]
        return f"\\{'P' if negated else 'p'}{{{name if len(name) <= 2 else 'Is' + name}}}"

    def _escape(self, inside: bool) -> str:
        """What follows a backslash, inside a class or not."""
        self.at += 1
        if self.at >= len(self.pattern):
            raise self._fail("trailing backslash")
        c = self.pattern[self.at]
        if c == "x":
            return self._hex()
        if c in "pP":
            return self._property()
        if m := re.compile(r"0[0-7]{0,2}|[1-7][0-7]{2}").match(self.pattern, self.at):
            self.at = m.end()
            return f"\\x{{{int(m[0], 8):x}}}"
        self.at += 1
        if c == "Q" and not inside:
            end = self.pattern.find("\\E", self.at)
            text = self.pattern[self.at : end if end >= 0 else len(self.pattern)]
            self.at = end + 2 if end >= 0 else len(self.pattern)
            return "".join(f"\\{x}" if not x.isalnum() and x.isascii() else x for x in text)
        if inside and c in _CLASSES:
            return _CLASSES[c]
        if c in _ESCAPES and not (inside and c in "bBAz"):
            return _ESCAPES[c]
        if c.isalnum() or not c.isascii():
            self.at -= 1
            raise self._fail(f"escape {c!r}")
        return f"\\{c}"

    def _class(self) -> str:
        self.at += 1
        out = ["["]
        if self.pattern.startswith("^", self.at):
            out.append("^")
            self.at += 1
        first = True
        while True:
            if self.at >= len(self.pattern):
                raise self._fail("open class")
            c = self.pattern[self.at]
            if c == "]" and not first:
                self.at += 1
                return "".join(out) + "]"
            first = False
            if m := re.compile(r"\[:(\^?)([a-z]+):\]").match(self.pattern, self.at):
                if m[2] not in _POSIX:
                    raise self._fail(f"class {m[2]!r}")
                out.append(f"\\{'P' if m[1] else 'p'}{{{_POSIX[m[2]]}}}")
                self.at = m.end()
            elif c == "\\":
                out.append(self._escape(True))
            else:
                out.append(f"\\{c}" if c in "[]&^" else c)
                self.at += 1

    def _group(self) -> str:
        m = re.compile(r"\(\?(?:P?<([A-Za-z_][A-Za-z0-9_]*)>|([imsU]*(?:-[imsU]+)?)([:)]))").match(self.pattern, self.at)
        if not m or m[1] is None and not m[2] and m[3] == ")":
            raise self._fail("group")
        self.at = m.end()
        if m[1]:
            return "("
        on, _, off = m[2].replace("U", "").partition("-")  # greediness doesn't change whether a text matches
        flags = on + (f"-{off}" if off else "")
        return f"(?{flags}{m[3]}" if flags or m[3] == ":" else ""

    def java(self) -> str:
        out, repeatable, depth = [], False, 0
        while self.at < len(self.pattern):
            c = self.pattern[self.at]
            repeat = _REPEAT.match(self.pattern, self.at) if c == "{" else None
            if c in "*+?" or repeat:
                if not repeatable:
                    raise self._fail("nothing to repeat")
                if repeat and (int(repeat[1]) > MOST_REPEATS or repeat[3] and not int(repeat[1]) <= int(repeat[3]) <= MOST_REPEATS):
                    raise self._fail("repeat count")
                out.append(repeat[0] if repeat else c)
                self.at = repeat.end() if repeat else self.at + 1
                if self.pattern.startswith("?", self.at):
                    out.append("?")
                    self.at += 1
                repeatable = False  # and not once more
                continue
            repeatable = True
            if c == "\\":
                out.append(self._escape(False))
            elif c == "[":
                out.append(self._class())
            elif c == "(":
                flags = self.pattern.startswith("(?", self.at)
                text = self._group() if flags else "("
                self.at += not flags
                opened = text.startswith("(") and not text.endswith(")")
                depth += opened
                out.append(text)
                repeatable = False
            elif c == ")":
                depth -= 1
                if depth < 0:
                    raise self._fail("closing bracket")
                out.append(c)
                self.at += 1
            else:
                out.append("\\z" if c == "$" and not self.lines else f"\\{c}" if c in "{}" else c)
                repeatable = c != "|"
                self.at += 1
        if depth:
            raise self._fail("open group")
        return "".join(out)


def java(pattern: str) -> str:
    """The pattern for the JVM; PatternError where it isn't of the dialect."""
    return _Reader(pattern).java()


def matcher(pattern: str) -> str:
    """As java, in upper and lower case, with newlines as the only line ends."""
    return f"(?iud){java(pattern)}"
