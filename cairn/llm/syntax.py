"""Source files that do not parse: least-cost repair by chart parsing, bracket group by bracket group.

1. One pass of the language's lexer turns a text into a string of one-character tokens: comments fall away, identifiers,
   numbers and strings lose their spelling, keywords and longer operators become private characters.
2. Innermost bracket groups are parsed and replaced by a character that stands for the readings their content allows
   (arguments, parameters, a block, a literal, ...), until no group is left; what remains is parsed as a whole file.
   A span is parsed once per worker: groups and statements of the same tokens share their chart. A file whose spans all
   have a reading without edits costs nothing and is valid; any other is flagged.
3. Each span of a flagged file that has no such reading is repaired by the error-correcting chart, the cheapest of its
   possible readings being taken. The edits of the derivations, brought back to lines, are the file's repair; their number
   is its cost. Brackets without a partner are edits, too: they are paired once by order and once by the indentation of
   their lines, and the pairing with fewer edits in all is kept.
4. The places of the edits tell the cause: conflict (edits at merge markers), truncation (all edits at the end),
   mismatch (edits all over), damage otherwise.

A span's cost is exact up to ``MOST`` edits, at any length; beyond, and between spans, it is an upper bound. A list of
statements is repaired statement by statement, from where the reading of the list stops to the next end of a statement.

Python's blocks are parsed over logical lines by their indentation; a final check with the language's own parser, where
the standard library has one (Python, JSON), only takes back flags.

Defined cases: null contents and other extensions have no row; an empty file is valid but for JSON and Go; repeated rows
are repeated. Memory of a worker is bounded: span tables are emptied at ``MEMO`` entries.
"""

from __future__ import annotations

import ast
import json
import re
import sys
import warnings
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairn.llm.common import map_batches
from cairn.llm.grammars import Syntax, syntax

EXTENSIONS = {"py": "py", "js": "js", "ts": "ts", "go": "go", "java": "java", "cs": "cs", "json": "json"}
MEMO = 1 << 18
MOST = 3
BAD = "\x01"
_GROUP = {"(": "P", "[": "B", "{": "C"}
_CLOSE = {")": "(", "]": "[", "}": "{"}
_OPEN = {v: k for k, v in _CLOSE.items()}
_MARKER = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?: [^\n]*)?$", re.M)

_STR2 = r'"(?:[^"\\\n]|\\(?:.|\n))*"'
_STR1 = r"'(?:[^'\\\n]|\\(?:.|\n))*'"
_IDENT = r"[^\W\d][\w$]*"
_NUM = r"\d[\w.]*(?:(?<=[eEpP])[+-]\d+\w*)?|\.\d[\w]*(?:(?<=[eE])[+-]\d+\w*)?"
_PATTERN = r"/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_WORDED = r"(?:return|typeof|case|in|of|do|else|delete|void|instanceof|yield|await|throw)[ \t]*" + _PATTERN
_LEXERS = {
    "js": [r"//[^\n]*", r"/\*(?s:.*?)\*/", r"\A\#![^\n]*", _STR2, _STR1, r"`(?:[^`\\]|\\(?s:.))*`", r"(?:&&|\|\||\?\?|=>|[=(,:\[!&|?{};+*%<>~^])[ \t\r]*" + _PATTERN, r"[#]?[^\W\d][\w$]*|\$[\w$]*", r"(?:0[xXoObB]\w*|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?[\d_]+)?|\.\d[\d_]*(?:[eE][+-]?[\d_]+)?)\w*"],
    "java": [r"//[^\n]*", r"/\*(?s:.*?)\*/", r'"""(?s:.*?)(?<!\\)"""', _STR2, r"'(?:[^'\\\n]|\\[^\n][0-9a-fA-F]*)'", _IDENT, _NUM],
    "cs": [r"//[^\n]*", r"/\*(?s:.*?)\*/", r"^[ \t]*\#\w+[^\n]*", r'"""+(?s:.*?)"""+', r'(?:\$@|@\$|@)"(?:[^"]|"")*"', r'\$?"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\[^\n][0-9a-fA-F]*)'", r"@?" + _IDENT, r"\d(?:[\w]|\.(?=\d))*"],
    "go": [r"//[^\n]*", r"/\*(?s:.*?)\*/", r'"(?:[^"\\\n]|\\.)*"', r"`[^`]*`", r"'(?:[^'\\\n]|\\[^\n]\w*)'", _IDENT, _NUM],
    "json": [r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"', r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])", r"[^\W\d]\w*|-?\d[\w.]*"],
    "py": [r"\#[^\n]*", r'(?i:[rbuf]|br|rb|fr|rf)?(?:"""(?s:(?:[^\\]|\\.)*?)"""|' + r"'''(?s:(?:[^\\]|\\.)*?)''')", r"(?i:[rbuf]|br|rb|fr|rf)?(?:" + _STR2 + "|" + _STR1 + ")", r"\\\r?\n", r"\n[ \t]*", _IDENT, r"0[xXoObB][\da-fA-F_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[jJ]?(?![\w])|\d\w*"],
}
_LEXERS["ts"] = _LEXERS["js"]
#: Tried before all else, as most tokens are names: no string prefix, no number.
_FIRST = {"py": r"[^\W\d]\w*+(?![\"'])(?:\.[^\W\d]\w*+(?![\"']))*", "json": r"[^\W\d]\w*"}
#: How a number may be written; other spellings (08, 3px) are no tokens.
_DECIMAL = r"(?:(?:0|[1-9][\d_]*)(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?"
_NUMBERS = {
    "js": rf"0[xX][\da-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|{_DECIMAL}|[\d_]+n",
    "java": rf"0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|0[0-7_]*[lL]?|{_DECIMAL}[lLfFdD]?|[\d_]+(?:\.[\d_]*|(?=[eEfFdD]))(?:[eE][+-]?\d+)?[fFdD]?",
    "go": rf"0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?i?|0[oO]?[0-7_]*|0[bB][01_]+|{_DECIMAL}i?|[\d_]+(?:\.[\d_]*|(?=[eEi]))(?:[eE][+-]?\d+)?i?",
    "cs": r"0[xX][\da-fA-F_]+[uUlL]*|0[bB][01_]+[uUlL]*|[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?[uUlLfFdDmM]*",
    "json": r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?",
    "py": r"0[xX][\da-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|0[0_]*|[1-9][\d_]*|(?:[\d_]+\.[\d_]*|\.\d[\d_]*|\d[\d_]*(?=[eEjJ]))(?:[eE][+-]?\d[\d_]*)?[jJ]?",
}
_NUMBERS["ts"] = _NUMBERS["js"]
_DOTTED = r"[^\W\d][\w$]*(?:\.[^\W\d][\w$]*)*"


_RUN = re.compile(r"([0s],)(?:\n*\1){2,}")


class _Kinds(dict):
    """Token text -> its characters, found on first sight; strings, numbers and comments hardly repeat and are not kept."""

    def __init__(self, kind):
        super().__init__()
        self.kind = kind

    def __missing__(self, x: str) -> str:
        got = self.kind(x if x.isspace() else x.rstrip())
        if len(x) < 32 and x[0] not in "\"'`/#0123456789":
            if len(self) > MEMO:
                self.clear()
            self[x] = got
        return got


class Lexer:
    """Text -> token string; ``located`` also gives the line of every token."""

    def __init__(self, s: Syntax):
        self.s = s
        ops = [re.escape(x) if x != ">|" else ">\x7f" for x in sorted(s.operators.split(), key=len, reverse=True)]
        space = r"[^\S\n]" if s.newline or s.name == "py" else r"\s"
        line = [r"\n\s*"] if s.newline else []
        parts = [_FIRST.get(s.name, _DOTTED), f"{space}+", *line, *_LEXERS[s.name], *ops, r"/\*", r"(?s:.)"]
        worded = [_WORDED] if s.name in ("js", "ts") else []
        # a token takes the space behind it along: half as many matches
        self.rx, self.rx_worded = (re.compile("(?:" + "|".join(f"(?:{p})" for p in x) + f"){space}*", re.M if s.name == "cs" else 0) for x in (parts, worded + parts))
        self.worded = re.compile(rf"\b{_WORDED}") if worded else None
        self.ends = frozenset("i0s)]}" + "".join(s.spelling.get(w, "") for w in ("break", "continue", "fallthrough", "return", "++", "--")))
        self.go = re.compile("([" + re.escape("".join(sorted(self.ends))) + "])\\n+")
        self.number = re.compile(_NUMBERS[s.name])
        self.seen = _Kinds(self._kind)
        self.fixed = dict(s.spelling)
        self.fixed[">\x7f"] = s.spelling.get(">|", ">")

    def _kind(self, x: str) -> str:
        got = self.fixed.get(x)
        if got is not None:
            return got
        c, name = x[0], self.s.name
        if c in "\"'`" and len(x) > 1 and c == x[-1]:
            return "s"
        if "." in x and (c.isalpha() or c == "_"):  # a dotted name
            return ".".join(self._kind(p) for p in x.split(".")) if x[-1] not in "\"'" else "s"
        if x.isspace():
            if name == "py" and c == "\n":
                return "\n" + chr(0x100 + min(len(x[1:].expandtabs(8)), 2000))
            return "\n" if self.s.newline and "\n" in x else ""
        if name == "py":
            if c == "#" or c == "\\":
                return "" if c == "#" or len(x) > 1 else BAD
            if x[-1] in "\"'" and len(x) > 1:
                return "s"
        elif x.startswith(("//", "/*")) and not x == "/*":
            return "\n" if "\n" in x and self.s.newline else ""
        elif c == "#" and name == "cs" and len(x) > 1 or x.startswith("#!") and name in ("js", "ts"):
            return ""
        if c.isdigit() or c in "-." and len(x) > 1 and x[1].isdigit():
            return "0" if self.number.fullmatch(x) else BAD
        if name not in ("py", "json"):
            if len(x) > 1 and x[-1] in "\"'`":
                return "s"
            if name in ("js", "ts") and "/" in x and len(x) > 2:  # what stands before a pattern, and the pattern
                at = x.index("/")
                return self._kind(x[:at].rstrip()) + "s"
        if c == "_" or c.isalpha() or c in "$@#" and len(x) > 1:
            return BAD if name == "json" else "i"
        return BAD if len(x) > 1 or c in "\"'`" or ord(c) > 126 or ord(c) < 32 else x

    def _text(self, text: str) -> str:
        if text.startswith("\ufeff"):
            text = text[1:]
        if self.s.name != "json":
            text = text.replace("\r\n", "\n").replace("\r", "\n")
            if "<<<<<<<" in text or ">>>>>>>" in text:
                text = _MARKER.sub(BAD, text)  # a merge marker is one token that fits nowhere
            if ">>" in text and ">|" in self.s.spelling:
                text = text.replace(">>", ">\x7f>").replace(">>", ">\x7f>")
        return "\n" + text if self.s.name == "py" else text  # Python's first line has an indentation, too

    def _regex(self, text: str) -> re.Pattern:
        return self.rx_worded if self.worded and "/" in text and self.worded.search(text) else self.rx

    def tokens(self, text: str) -> str:
        text = self._text(text)
        out = "".join(map(self.seen.__getitem__, self._regex(text).findall(text)))
        if self.s.newline == "go":
            out = self.go.sub(r"\1;", out + "\n").replace("\n", "")
        return out

    def located(self, text: str) -> tuple[str, list[int]]:
        """The token string and the line, from 1, of each of its characters."""
        text = self._text(text)
        breaks = [m.start() for m in re.finditer("\n", text)]
        first = 0 if self.s.name == "py" else 1
        chars, lines = [], []
        for m in self._regex(text).finditer(text):
            kind = self.seen[m[0]]
            if kind:
                line = first + (bisect_right if first == 0 and kind[0] == "\n" else bisect_left)(breaks, m.start())
                chars.append(kind)
                lines += [line] * len(kind)
        out = "".join(chars)
        if self.s.newline != "go":
            return out, lines
        chars, at = [], []
        for c, line in zip(out + "\n", [*lines, lines[-1] if lines else 1]):
            if c == "\n":
                if not chars or chars[-1] not in self.ends:
                    continue
                c, line = ";", at[-1]
            chars.append(c)
            at.append(line)
        return "".join(chars), at


class Reducer:
    """Collapses bracket groups of one language and parses what is left; spans are remembered."""

    def __init__(self, s: Syntax):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 60_000))  # a chain of a thousand else-ifs is one span
        self.s, self.lex = s, Lexer(s)
        self.memo: dict[str, str] = {}
        self.chunks: dict[tuple[str, str], bool] = {}
        self.classes: dict[tuple, str] = {}
        self.free: dict[str, str] = {}  # group without a reading -> group of all readings
        self.inner = re.compile(r"[(\[{][^()\[\]{}]*[)\]}]")
        cont = "".join(s.spelling[w] for w in s.continues.split())
        starts = "".join(v for w, v in s.spelling.items() if w not in s.operators.split()) + "i@;" + ("~" if s.name == "cs" else "")
        self.cut_after = frozenset(starts) - frozenset(cont)
        self.cont = frozenset(cont)
        ends = "[\U00100000-\U0010fffd](?=[" + re.escape("".join(sorted(self.cut_after))) + "])"
        self.returns = re.compile(f"(?<![.{s.spelling['?.']}]){s.spelling['return']}") if "fblock" in s.lists else None
        self.edits_of: dict[str, list[int]] = {}
        self.line_edits: dict[str, tuple[str, list[int]]] = {}
        self.parts = re.compile(";|" + ("\n+|" if s.newline == "keep" else "") + ends)

    # a group: its characters are made on demand, one for each set of readings; brace groups have a plane of their own
    def _class(self, bracket: str, kinds: tuple[str, ...], bad: bool = False) -> str:
        key = (bracket, kinds, bad)
        c = self.classes.get(key)
        if c is None:
            c = self.classes[key] = chr((0x100000 if bracket == "C" else 0xF0000) + len(self.classes))
            self.s.grammar.new_group(c, bracket, kinds)
            if bad:
                self.free[c] = self._class(bracket, kinds)
        return c

    def _group(self, m: re.Match) -> str:
        return self._group_text(m[0])

    def _group_text(self, x: str) -> str:
        got = self.memo.get(x)
        if got is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
                self.chunks.clear()
            got = self.memo[x] = self._read(x)
        return got

    def _all(self, bracket: str) -> tuple[str, ...]:
        return tuple(sorted(k for b, k in self.s.grammar.kinds if b == bracket))

    def _lists(self) -> list[tuple[str, str]]:
        return [(k, rule) for k, rule in self.s.lists.items() if ("C", k) in self.s.grammar.kinds]

    def _body(self, x: str) -> str:
        return re.sub("\n.", "", x[1:-1]) if self.s.name == "py" else x[1:-1]

    def _read(self, x: str) -> str:
        s, bracket, body = self.s, _GROUP[x[0]], self._body(x)
        if _CLOSE[x[-1]] != x[0]:
            return self._class(bracket, self._all(bracket), True)
        if len(body) > 12:  # a long list of one kind of value reads as a short one
            short = _RUN.sub(r"\1\1", body)
            if len(short) < len(body):
                return self._group_text(x[0] + short + x[-1])
        flat = body.replace("\n", "")
        kinds = [k for k in s.kinds[bracket] if (bracket, k) in s.grammar.kinds and s.grammar.accepts(k, flat)]
        if bracket == "C":
            ok = self._readings(body, lambda rule: self._list(rule, body, 1))
            if not (ok or kinds):
                ok = self._readings(body, lambda rule: self._list(rule, body))
            if "\n" in body:
                ok = self._readings(body, lambda rule: self._whole(rule, body), ok)
            kinds += ok
        return self._class(bracket, tuple(sorted(kinds))) if kinds else self._class(bracket, self._all(bracket), True)

    def _readings(self, body: str, reads, known: list[str] | None = None) -> list[str]:
        """Lists the body can be read as. A block is a function's body without returns, so its reading follows from that."""
        ok = list(known or [])
        of = self.s.grammar.kinds
        for k, rule in self._lists():
            if k in ok:
                continue
            if self.returns and k in ("block", "top") and self.returns.search(body):
                continue
            if k == "block" and "fblock" in self.s.lists:
                if "fblock" not in ok:
                    continue
                plain, all_ = of["C", "block"], of["C", "fblock"]
                if all(c in plain or c not in all_ for c in body if c > "\U000fffff") or reads(rule):
                    ok.append(k)
            elif reads(rule):
                ok.append(k)
        return ok

    def split(self, body: str) -> list[tuple[str, bool]]:
        """Statements or members of a list: (tokens, ended by a line or the list's end)."""
        out, a, n = [], 0, len(body)
        buf: list[str] = []
        for m in self.parts.finditer(body):
            i, j = m.span()
            if body[i] != "\n":
                buf.append(body[a:j])
                out.append(("".join(buf), False))
                buf = []
            else:
                if i > a:
                    buf.append(body[a:i])
                if buf and not (j < n and body[j] in self.cont):
                    out.append(("".join(buf), True))
                    buf = []
                elif buf and buf[-1][-1] != ";" and buf[-1][-1] <= "\U000fffff":
                    buf.append(";")
            a = j
        if a < n:
            buf.append(body[a:])
        if buf:
            out.append(("".join(buf), True))
        return out

    def _ok(self, rule: str, x: str, open_end: bool) -> bool:
        key = (rule, x)
        got = self.chunks.get(key)
        if got is None:
            got = self.s.grammar.accepts(rule, x)
            if not got and open_end and self.s.newline:
                y = x[:-1] + ";" if x.endswith(",") and rule == "members" else x + ";"
                got = self.s.grammar.accepts(rule, y)
            self.chunks[key] = got
        return got

    def _list(self, rule: str, body: str, merge: int = 8) -> bool:
        """Whether every statement is one: a piece that is none alone may belong to the next few, else the whole list is
        read at once; ``merge`` 1 looks at single pieces only."""
        given = body
        if rule == "members" and "," in body and self.s.name == "ts" and ";" not in body:
            body = body.replace("\n", "").replace(",", ";")
        parts = self.split(body)
        i = 0
        while i < len(parts):
            x, end = parts[i]
            if self._ok(rule, x, end):
                i += 1
                continue
            for j in range(i + 1, min(i + merge, len(parts))):
                x += parts[j][0]
                if self._ok(rule, x, parts[j][1]):
                    i = j + 1
                    break
            else:
                return merge > 1 and self._whole(rule, given)
        return True

    def _lines(self, body: str) -> tuple[str, list[int], frozenset[int]]:
        """The list without its line breaks, the place of each token in it, and where a line break may end a statement."""
        where = [i for i, c in enumerate(body) if c != "\n"]
        text = body.replace("\n", "")
        breaks = {len(text)} if self.s.newline else set()
        if self.s.newline == "keep":
            at = 0
            for line in body.split("\n"):
                at += len(line)
                breaks.add(at)
        return text, where, frozenset(breaks)

    def _reach(self, rule: str, text: str, pos: int, breaks: frozenset[int]) -> int:
        return self.s.grammar.reach(rule, pos, text, breaks, rule == "members" and self.s.name == "ts")

    def _whole(self, rule: str, body: str) -> bool:
        """As ``_list``, exact: one chart over the whole list, in which a line break may end a statement or not."""
        key = (f"whole {rule}", body)
        got = self.chunks.get(key)
        if got is None:
            text, _, breaks = self._lines(body)
            commas = rule == "members" and self.s.name == "ts"  # may stand for a ';'
            got = self.chunks[key] = not text or self.s.grammar.spells(rule, text.replace(",", "") if commas else text) and self._reach(rule, text, 0, breaks) == len(text)
            self.s.grammar.end_reach()
        return got

    def collapse(self, tokens: str) -> str | None:
        """The tokens with every bracket group read, None when one has no reading or no partner."""
        while True:
            tokens, n = self.inner.subn(self._group, tokens)
            if not n:
                return None if any(c in tokens for c in "()[]{}") else tokens
            if self.free and not self.free.keys().isdisjoint(tokens):
                return None

    def parses(self, text: str) -> bool:
        """Whether the file has a reading without edits."""
        tokens = self.collapse(self.lex.tokens(text))
        return tokens is not None and not next(self._file_edits(tokens, True), False)

    def cost(self, text: str) -> int:
        """Least edits found for a whole file; 0 when it parses."""
        return 0 if self.parses(text) else len(self.edits(text))

    def _file_edits(self, tokens: str, stop: bool = False) -> Iterator[int | bool]:
        """Places of the edits of what is left when all groups are read; with ``stop`` True at the first."""
        if self.s.name == "py":
            yield from self._python(tokens, stop)
        elif self.s.name == "json":
            if not self.s.grammar.accepts("value", tokens):
                yield from [True] if stop else self._span("value", tokens)
        else:
            if self.s.name == "go":
                package = self.s.spelling["package"]
                if not re.match(f"{package}i;", tokens):
                    yield True if stop else 0
                if tokens.count(package) > 1:
                    yield True if stop else tokens.index(package, tokens.index(package) + 1)
            if not self._list(self.s.top, tokens):
                yield from [True] if stop else self._list_edits(self.s.top, tokens)

    # --- edits ----------------------------------------------------------------------------------------------------

    def edits(self, text: str) -> list[int]:
        """Lines of the edits, one entry an edit. Brackets without a partner are paired by order and by indentation; while
        more than their own edits remain, each place is tried where one bracket less or more would end the first of them, and
        the three that leave fewest groups without a reading are repaired in full."""
        tokens, lines = self.lex.located(text)
        best, lone = self._paired(tokens, lines)
        if not lone or len(best) < 2:
            return best
        heights = [len(x.expandtabs(4)) - len(x.expandtabs(4).lstrip()) for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
        if self.s.name not in ("py", "json"):
            other, _ = self._paired(tokens, lines, heights, len(best))
            best = other if len(other) < len(best) else best
        if len(best) > len(lone) and len(lone) < 3:
            tried = []
            for cut, new, at in self._single(tokens, lines, heights, lone[0]):
                changed = tokens[:at] + new + tokens[at + cut :]
                line = lines[min(at, len(lines) - 1)] if cut or at == 0 else lines[at - 1]
                where = lines[:at] + [line] * len(new) + lines[at + cut :]
                rough = len(self._paired(changed, where, None, min(x[0] for x in tried) + 1 if tried else None, True)[0])
                tried.append((rough, len(tried), line, changed, where))
                if not rough:
                    break
            for _, _, line, changed, where in sorted(tried)[:3]:
                other, _ = self._paired(changed, where, None, len(best) - 1)
                if len(other) + 1 < len(best):
                    best = sorted([line, *other])
        return best

    def _single(self, tokens: str, lines: list[int], heights: list[int], lone: tuple[str, int, int]) -> Iterator[tuple[int, str, int]]:
        """Edits of one bracket (characters taken out, put in, where) that could mend a lone or wrong one."""
        kind, o, c = lone
        if kind != "close":
            closer, depth, left = _OPEN[tokens[o]], 0, 2
            for q in range(o + 1, (c if kind == "pair" else len(tokens)) + 1):
                if depth == 0 and (closer != "}" or q in (c, len(tokens)) or lines[q] != lines[q - 1] or lines[q] == lines[o]):
                    yield 0, closer + ";" * (self.s.newline == "go" and 0 < q < len(tokens) and lines[q] != lines[q - 1]), q
                if q == len(tokens):
                    break
                x = tokens[q]
                depth += (x in _OPEN) - (x in _CLOSE)
                left -= closer != "}" and depth == 0 and x in ";}\n" and not (x == "\n" and self.s.name != "py" and heights[lines[q] - 1] > heights[lines[o] - 1])
                if depth < 0 or not left:
                    break
            yield 1, "", o
        if kind == "pair":
            yield 1, _CLOSE[tokens[c]], o
        if kind != "open":
            opener = _CLOSE[tokens[c]]
            for q in range(c, 0, -1):
                same, cut = lines[q - 1] == lines[q], int(self.s.newline == "go" and tokens[q - 1] == ";")
                if not same and opener == "{" and heights[lines[q] - 1] > heights[lines[q - 1] - 1] and tokens[q - 1 - cut] not in "([{,;" or same and lines[q] == lines[c]:
                    yield cut, opener, q - cut
            yield 1, "", c

    def _paired(self, tokens: str, lines: list[int], heights: list[int] | None = None, below: int | None = None, rough: bool = False) -> tuple[list[int], list[tuple[str, int, int]]]:
        """Lines of the edits (as many as ``below`` stop the search) and the brackets without a partner; with ``heights``, the
        indentation of every line, a brace also ends before a line that stands no deeper than the line it opened on. ``rough`` counts a group without a reading once."""
        found: list[int] = []
        lone: list[tuple[str, int, int]] = []
        out: list[str] = []
        at: list[int] = []
        src: list[int] = []
        opens: list[int] = []

        def close(c: str) -> None:
            o = opens.pop()
            x = "".join(out[o:]) + c
            char = self._group_text(x)
            if char in self.free:
                found.extend(at[min(o + 1 + k, len(at) - 1)] for k in ([0] if rough else self._group_edits(x)))
                char = self.free[char]
            del out[o + 1 :], at[o + 1 :], src[o + 1 :]
            out[o] = char

        last = 0
        for i, (c, line) in enumerate(zip(tokens, lines)):
            if below is not None and len(found) >= below:
                return found, lone
            if heights is not None and line != last and c != "\n":
                h = heights[line - 1]
                while opens and out[opens[-1]] == "{" and at[opens[-1]] < line and (heights[at[opens[-1]] - 1] > h or heights[at[opens[-1]] - 1] == h and c not in _CLOSE):
                    found.append(line)
                    close("}")
                    if self.s.newline == "go":
                        out.append(";")
                        at.append(line)
                        src.append(i)
                last = line
            if c in _OPEN:
                opens.append(len(out))
            elif c in _CLOSE:
                if not opens:
                    found.append(line)  # deleted
                    lone.append(("close", i, i))
                    continue
                top = out[opens[-1]]
                if top != _CLOSE[c]:
                    found.append(line)
                    lone.append(("pair", src[opens[-1]], i))
                    if len(opens) > 1 and out[opens[-2]] == _CLOSE[c]:
                        close(_OPEN[top])  # one is missing before it
                    else:
                        c = _OPEN[top]  # replaced
                close(c)
                continue
            out.append(c)
            at.append(line)
            src.append(i)
        while opens:
            found.append(lines[-1])
            lone.append(("open", src[opens[-1]], len(tokens)))
            close(_OPEN[out[opens[-1]]])
        end = at[-1] if at else 1
        if rough:
            return found + [end] * next(self._file_edits("".join(out), True), False), lone
        return sorted([*found, *(at[k] if k < len(at) else end for k in self._file_edits("".join(out)))]), lone

    def _span(self, rule: str, x: str, most: int = MOST) -> list[int]:
        """Places of the edits that make ``x`` a ``rule``; where there are many, tokens that fit nowhere go first."""
        bad = [i for i, c in enumerate(x) if c == BAD]
        got = self.s.grammar.repair(rule, x, most)[1] if len(bad) <= most else []
        if got and len(got) <= most or not bad:
            return got
        keep = [i for i, c in enumerate(x) if c != BAD]
        rest = self.s.grammar.repair(rule, "".join(x[i] for i in keep), most)[1] if keep else []
        return sorted(bad + [keep[i] if i < len(keep) else len(x) for i in rest])

    def _group_edits(self, x: str) -> list[int]:
        """Places, in the group's body, of the edits of its cheapest reading."""
        got = self.edits_of.get(x)
        if got is None:
            if len(self.edits_of) > MEMO >> 4:
                self.edits_of.clear()
            got = self.edits_of[x] = self._cheapest(x)
        return got

    def _cheapest(self, x: str) -> list[int]:
        s, bracket, body = self.s, _GROUP[x[0]], x[1:-1]
        where = [i for i, c in enumerate(body) if c != "\n" and not (s.name == "py" and i and body[i - 1] == "\n")]
        flat = "".join(body[i] for i in where)
        best: list[int] | None = None
        if bracket == "C":
            # the reading with most statements first: the others then stop as soon as they cost as much
            for _, rule in sorted(self._lists(), key=lambda kr: sum(not self._ok(kr[1], *p) for p in self.split(body))):
                if best is None or len(best) > 1:
                    got = self._list_edits(rule, body, len(best) if best else None)
                    if got is not None and (best is None or len(got) < len(best)):
                        best = got
        for k in s.kinds[bracket]:
            if (bracket, k) in s.grammar.kinds and (best is None or len(best) > 1):
                got = [where[i] if i < len(where) else len(body) for i in self._span(k, flat, MOST if best is None else min(MOST, len(best) - 1))]
                if best is None or len(got) < len(best):
                    best = got
        return best or [0]

    def _list_edits(self, rule: str, body: str, below: int | None = None) -> list[int] | None:
        """Places of the edits in a list of statements, None when there are not fewer than ``below``."""
        text, where, breaks = self._lines(body)
        g = self.s.grammar
        out: list[int] = []
        pos = 0
        while pos < len(text):
            far = self._reach(rule, text, pos, breaks)
            if far == len(text):
                break
            end = far + 1
            while end < len(text) and not (text[end - 1] == ";" or end in breaks and text[end] not in self.cont or text[end - 1] > "\U000fffff" and text[end] in self.cut_after):
                end += 1
            g.end_reach()
            x = text[far:end]
            got = self._span(rule, x)
            if end in breaks and len(got) > 1:
                other = self._span(rule, x + ";", min(MOST, len(got) - 1))
                got = other if len(other) < len(got) else got
            out += [where[min(far + i, len(where) - 1)] for i in got]
            if below is not None and len(out) >= below:
                return None
            pos = end
        g.end_reach()
        return out

    # --- Python: blocks over logical lines -----------------------------------------------------------------------

    HEADS = ("if", "elif", "else", "for", "while", "try", "except", "finally", "with", "def", "class", "match", "case")

    def _line(self, x: str) -> str:
        """Kind of a logical line: a head's name, with '!' when its body follows on the line; 'line', 'deco' or ''."""
        got = self.memo.get("L" + x)
        if got is None:
            got = self.memo["L" + x] = self._line_kind(x)
        return got

    def _head(self, x: str) -> str | None:
        sp = self.s.spelling
        first = x[1] if x[0] == sp["async"] and len(x) > 1 else x[0]
        return next((h for h in self.HEADS if sp[h] == first), None)

    def _line_kind(self, x: str) -> str:
        g = self.s.grammar
        if x[0] == "@":
            return "deco" if g.accepts("deco", x) else ""
        name = self._head(x)
        if name:
            if x[-1] == ":" and g.accepts(f"head_{name}", x):
                return name
            for m in re.finditer(":", x):
                if g.accepts(f"head_{name}", x[: m.end()]) and g.accepts("line", x[m.end() :]):
                    return name + "!"
        return "line" if g.accepts("line", x) else ""

    def _line_edits(self, x: str) -> tuple[str, list[int]]:
        """Kind and edits of a line that is none: as a head if it begins like one and that is cheaper."""
        name = self._head(x)
        got = self._span("deco" if x[0] == "@" else "line", x)
        if name and len(got) > 1:
            head = self._span(f"head_{name}", x, min(MOST, len(got) - 1))
            if len(head) < len(got):
                return name, head
        return "deco" if x[0] == "@" else "line", got

    def _python(self, tokens: str, stop: bool) -> Iterator[int | bool]:
        stack = [0]
        want = False  # a head without a body
        last: dict[int, str] = {}
        deco = False
        at = 0
        for part in tokens.split("\n"):
            here, at = at + 1, at + len(part) + 1
            if len(part) < 2:
                continue
            indent, x = ord(part[0]) - 0x100, part[1:]
            kind = self._line(x)
            bad = 0
            if not kind:
                if stop:
                    yield True
                if x not in self.line_edits:
                    if len(self.line_edits) > MEMO >> 4:
                        self.line_edits.clear()
                    self.line_edits[x] = self._line_edits(x)
                kind, got = self.line_edits[x]
                yield from (min(here + i, here + len(x) - 1) for i in got)
            if want:
                if indent <= stack[-1]:
                    bad += 1
                else:
                    stack.append(indent)
                    last.pop(indent, None)
            elif indent > stack[-1]:
                bad += 1
            while indent < stack[-1]:
                last.pop(stack.pop(), None)
            if indent != stack[-1]:
                bad += 1
                stack.append(indent) if indent > stack[-1] else None
            head = kind.rstrip("!")
            before = last.get(indent, "")
            good = {
                "elif": before in ("if", "elif"),
                "else": before in ("if", "elif", "for", "while", "except"),
                "except": before in ("try", "except"),
                "finally": before in ("try", "except", "else_try"),
            }.get(head, True)
            bad += (not good) + (before == "try" and head not in ("except", "finally"))
            if head == "else" and before == "except":
                last[indent] = "else_try"
            else:
                last[indent] = head
            bad += deco and head not in ("def", "class", "deco")
            if bad:
                yield from [True] if stop else [here] * bad
            deco = kind == "deco"
            want = head in self.HEADS and not kind.endswith("!")
        if want or deco or any(v == "try" for v in last.values()):
            yield True if stop else max(0, len(tokens) - 1)


_READERS: dict[str, Reducer] = {}


def reader(language: str) -> Reducer:
    """The worker's reducer of a language."""
    if language not in _READERS:
        _READERS[language] = Reducer(syntax(language))
    return _READERS[language]


def confirmed(language: str, text: str) -> bool:
    """Exact check of a flagged file where the standard library has the language's parser."""
    try:
        if language == "py":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
        elif language == "json":
            json.loads(text.removeprefix("﻿"))
        else:
            return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return True
    return False


@dataclass
class Report:
    cost: int
    cause: str
    lines: list[int] = field(default_factory=list)


def examine(language: str, text: str) -> Report | None:
    """None for a valid file, else its least cost, the cause and the lines of the edits."""
    r = reader(language)
    if r.parses(text) or not confirmed(language, text):
        return None
    edits = r.edits(text) or [1]
    lines = text.replace("\r\n", "\n").replace("\r", "\n").rstrip().split("\n")
    at = sorted({min(i, len(lines)) for i in edits})
    if any(_MARKER.fullmatch(lines[i - 1]) for i in at):
        cause = "conflict"
    elif at[0] >= len(lines) - (not lines[-1].strip()):
        cause = "truncation"
    elif len(at) > max(4, 0.2 * sum(1 for x in lines if x.strip())):
        cause = "mismatch"
    else:
        cause = "damage"
    return Report(len(edits), cause, at)


def _extension(path):
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


_SCHEMA = "repo_id string, path string, valid boolean, cost int, cause string, edit_lines array<int>"


def examined(raw_files: DataFrame, locate: bool = True) -> DataFrame:
    """(repo_id, path, valid, cost, cause, edit_lines) of every file with a known extension and a content."""
    d = raw_files.select("repo_id", "path", "content").filter(F.col("content").isNotNull() & _extension(F.col("path")).isin(list(EXTENSIONS)))

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for path, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            lang = EXTENSIONS[path.rsplit(".", 1)[1].lower()]
            if locate:
                rep = examine(lang, text)
            else:
                rep = None if reader(lang).parses(text) or not confirmed(lang, text) else Report(1, "")
            rows.append((rep is None, rep.cost if rep else 0, rep.cause if rep else None, rep.lines if rep else []))
        cols = list(zip(*rows)) or [()] * 4
        kinds = [pa.bool_(), pa.int32(), pa.string(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["repo_id", "path", "valid", "cost", "cause", "edit_lines"])

    return map_batches(d, work, _SCHEMA)


def invalid_files(raw_files: DataFrame) -> DataFrame:
    return examined(raw_files).filter(~F.col("valid")).drop("valid")


def rates(raw_files: DataFrame, files: DataFrame) -> DataFrame:
    """Share of files that do not parse by repository and language (of the current row in ``files``, else of the extension)."""
    label = files.dropna(subset=["repo_id", "path"]).groupBy("repo_id", "path").agg(F.max_by(F.lower("language"), "indexed_at").alias("given"))
    d = examined(raw_files, locate=False).join(label, ["repo_id", "path"], "left")
    lang = F.create_map(*(x for k, v in {"py": "python", "js": "javascript", "ts": "typescript", "go": "go", "java": "java", "cs": "csharp", "json": "json"}.items() for x in (F.lit(k), F.lit(v))))[_extension(F.col("path"))]
    return d.groupBy("repo_id", F.coalesce("given", lang).alias("language")).agg(F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid"), F.round(F.avg((~F.col("valid")).cast("double")), 6).alias("rate"))
