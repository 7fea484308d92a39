"""Cutting oversized texts at natural boundaries: structure-tree packing.

The lines of a text form a tree: markdown headings by level, markup by the nesting of its tags, list items and code by
indentation, fenced blocks and bracketed bodies under their opening line, siblings divided into paragraphs by blank lines.
Subtrees that fit stay whole; sibling pieces are merged bottom-up to the limit; only nodes that are too large are opened.
A line too long by itself is cut after a sentence end, a separator or white space, and inside a word only where it has none
of them.

Every later piece begins with the last two lines of the one before. Where two lines take more than half of a piece or do
not fit, it is the last line, and where that does not fit either, or a line was cut, its last words. The pieces without what
they repeat, joined, are the text.

Defined cases: null texts and texts within the limit give no pieces from ``split_oversized``; ``start_line`` null counts
as 1, ``symbol_kind`` null becomes block; repeated rows of an id are split once.
"""

from __future__ import annotations

import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairn.llm.common import map_batches

LIMIT = 600
OVERLAP = 2
_LINES = re.compile(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+")
_HEADING = re.compile(r"(#{1,6})\s")
_HEADED = re.compile(r"(?m)^#{1,6} \S.*(?:\r?\n[ \t]*\r?\n)")
_TAG = re.compile(r"<(/?)([A-Za-z][\w:.-]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*?)(/?)>|<!--.*?(?:-->|$)")
_CLOSER = re.compile(r"\s*(?:[)\]}]|end\b|</|else\b|elif\b|except\b|finally\b|catch\b|case\b|default\b)")
_LEAD = re.compile(r"\s*(?:@|#\[|///|/\*\*|\*|//|\[\w)")
_ENDS = (re.compile(r"[.!?]\s"), re.compile(r"[;,]\s?"), re.compile(r"\s"), re.compile(r"[^\w\s]"))
#: Elements without an end tag.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def estimate(text: str) -> int:
    return max(1, len(text) // 4)


def _headed(lines: list[str]) -> list[int | None]:
    """Depth of each line of a text with headings; None for blank ones, which belong to what stands before them."""
    out: list[int | None] = []
    fence = False
    after = 0
    for x in lines:
        s = x.strip()
        if not s:
            out.append(None)
            continue
        mark = s.startswith(("```", "~~~"))
        h = None if fence or mark else _HEADING.match(s)
        if h:
            after = len(h[1])
            out.append(after)
        else:
            out.append(after + 10 + (500 if fence else _indent(x)))
        fence ^= mark
    return out


def _marked_up(lines: list[str]) -> list[int | None]:
    """Depth of each line by the elements open where it begins, those it closes at once not counted."""
    out: list[int | None] = []
    open_: list[str] = []
    for x in lines:
        depth, lead, at = len(open_), True, 0
        for m in _TAG.finditer(x):
            lead = lead and not x[at : m.start()].strip()
            at = m.end()
            name = (m[2] or "").lower()
            if m[1]:
                if name in open_:
                    while open_.pop() != name:
                        pass
                    depth = min(depth, len(open_)) if lead else depth
            elif name and not m[4] and name not in _VOID:
                open_.append(name)
                lead = False
        out.append(depth if x.strip() else None)
    return out


def _indent(x: str) -> int:
    x = x.expandtabs(4)
    return len(x) - len(x.lstrip())


def _kind(text: str, language: str | None) -> str:
    """How the tree of a text is read; a text without a language is looked at."""
    name = (language or "").lower()
    if name in ("markdown", "md", "rst", "text"):
        return "headings"
    if name in ("html", "xml", "svg", "vue", "xhtml") or not name and re.match(r"\s*<[!?A-Za-z]", text) and len(_TAG.findall(text)) > 2:
        return "markup"
    return "headings" if not name and (_HEADED.search(text) or re.search(r"(?m)^#{1,6} \S", text) and "```" in text) else "indent"


class _Packer:
    def __init__(self, text: str, kind: str, limit: int, overlap: int):
        self.lines = _LINES.findall(text)
        self.depth = _headed(self.lines) if kind == "headings" else _marked_up(self.lines) if kind == "markup" else [_indent(x) if x.strip() else None for x in self.lines]
        self.sum = [0, *accumulate(map(len, self.lines))]
        self.room, self.overlap = limit * 4 + 3, overlap

    def back(self, a: int) -> int:
        """Characters repeated before line ``a`` where they fit: whole lines up to half of a piece, else the last words."""
        for k in range(min(self.overlap, a), 0, -1):
            n = self.sum[a] - self.sum[a - k]
            if n <= self.room // 2:
                return n
        return len(self.tail(self.lines[a - 1], self.room // 8)) if a and self.overlap else 0

    def tail(self, text: str, most: int) -> str:
        """The end of a text, of at most ``most`` characters, from the start of a sentence, a part or a word."""
        end = text[max(0, len(text) - most) :] if most > 0 else ""
        if len(end) == len(text):
            return end
        for e in _ENDS[:3]:
            m = e.search(end)
            if m and m.end() < len(end):
                return end[m.end() :]
        return end

    def fits(self, a: int, b: int) -> bool:
        return self.sum[b] - self.sum[a] + self.back(a) <= self.room

    def tree(self) -> tuple[list[list[int]], list[int], list[int]]:
        """Children of each node (a line, the root last), and the first line and the end of each subtree.

        A line lies under the nearest line before it that is less deep. Closing lines and blank ones belong to the subtree
        before them, comments and attributes at the same depth to the line after them."""
        n = len(self.lines)
        kids: list[list[int]] = [[] for _ in range(n + 1)]
        end = list(range(1, n + 1)) + [n]
        stack: list[int] = []
        lead: dict[int, int] = {}  # line -> the first line of the comments before it
        run: int | None = None
        for i in range(n):
            d = self.depth[i]
            if d is None:
                if i == 0:
                    kids[n].append(i)  # a blank beginning is a node of its own
                run = None
                continue
            while stack and self.depth[stack[-1]] > d:
                end[stack.pop()] = i
            if stack and self.depth[stack[-1]] == d:
                if _CLOSER.match(self.lines[i]):
                    run = None
                    continue
                end[stack.pop()] = i if run is None else run
            if run is not None:
                lead[i] = run
            if _LEAD.match(self.lines[i]) and i + 1 < n and self.depth[i + 1] == d:
                run = i if run is None else run
                continue
            run = None
            kids[stack[-1] if stack else n].append(i)
            stack.append(i)
        for i in stack:
            end[i] = n
        if run is not None:
            kids[n].append(run)
        return kids, [lead.get(i, i) for i in range(n)] + [0], end

    def merge(self, parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out = parts[:1]
        for a, b in parts[1:]:
            if self.fits(out[-1][0], b):
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return out

    def pack(self) -> list[tuple[int, int]]:
        """Stretches of lines, each within the limit or a single line: children before parents, no recursion."""
        kids, first, end = self.tree()
        n = len(self.lines)
        done: dict[int, list[tuple[int, int]]] = {}
        for node in [*range(n - 1, -1, -1), n]:
            a, b = (0, n) if node == n else (first[node], end[node])
            own = kids[node]
            if node < n and not own and b - a == 1 or self.fits(a, b):
                done[node] = [(a, b)]
                for k in own:
                    done.pop(k, None)
                continue
            starts = [first[k] for k in own]
            parts = [(i, i + 1) for i in range(a, starts[0] if starts else b)]  # the node's own lines
            para: list[tuple[int, int]] = []
            for x, k in enumerate(own):
                stop = starts[x + 1] if x + 1 < len(own) else b
                got = done.pop(k, [])
                got += [(i, i + 1) for i in range(got[-1][1] if got else starts[x], stop)]
                para += got
                if x + 1 == len(own) or self.depth[stop - 1] is None:
                    parts += self.merge(para)
                    para = []
            done[node] = self.merge(parts)
        return done[n]

    def cut_line(self, text: str, room: int) -> list[str]:
        out = []
        while len(text) > room:
            head = text[:room]
            for e in _ENDS:
                at = max((m.end() for m in e.finditer(head, len(head) // 2)), default=0)
                if at:
                    break
            at = at or room
            out.append(text[:at])
            text = text[at:]
        return [*out, text] if text else out

    def pieces(self) -> list[tuple[int, int, int, str]]:
        """(first line, last line, both counted from 0; characters repeated from the piece before; text)."""
        out: list[tuple[int, int, int, str]] = []
        for a, b in self.pack():
            body = "".join(self.lines[a:b])
            if len(body) > self.room:  # one line
                most = self.room // 8 if self.overlap else 0
                for x in self.cut_line(body, self.room - most):
                    again = self.tail(out[-1][3], most) if out else ""
                    begin = a - 1 if out and out[-1][1] < a and again else a
                    out.append((begin, b - 1, len(again), again + x))
                continue
            k = next((k for k in range(min(self.overlap, a), 0, -1) if self.sum[a] - self.sum[a - k] <= min(self.room // 2, self.room - len(body)) and (not out or out[-1][0] <= a - k)), 0)
            again = "".join(self.lines[a - k : a]) if k else self.tail(self.lines[a - 1], min(self.room // 8, self.room - len(body))) if a and self.overlap else ""
            out.append((a - (k or bool(again)), b - 1, len(again), again + body))
        return out


def split_text(text: str, language: str | None = None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """Pieces of one text: (first line, last line, repeated characters, piece)."""
    return _Packer(text, _kind(text, language), limit, overlap).pieces() if text else []


_SCHEMA = "id bigint, piece int, start_line int, end_line int, symbol_kind string, n_repeated int, content string"


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every chunk whose estimate exceeds ``limit``; only those rows leave the scan."""
    big = F.greatest(F.lit(1), F.expr("length(content) div 4")) > limit
    d = chunks.select("id", "language", "symbol_kind", "start_line", "content").filter(F.col("id").isNotNull() & big).dropDuplicates(["id"])

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [
            (i, k, (s or 1) + a, (s or 1) + z, kind or "block", rep, piece)
            for i, lang, kind, s, text in zip(*(b.column(c).to_pylist() for c in range(5)))
            for k, (a, z, rep, piece) in enumerate(split_text(text, lang, limit, overlap))
        ]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()]
        cols = list(zip(*rows)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "piece", "start_line", "end_line", "symbol_kind", "n_repeated", "content"])

    return map_batches(d, work, _SCHEMA)
