"""Chart parsing of token strings with minimum-cost repair.

A grammar is written as text, one ``name = expression`` a line, over one-character tokens. ``Grammar.accepts`` is the plain
chart: for a rule and a start it keeps every end the rule can reach at cost 0. ``Grammar.repair`` is the error-correcting
chart: each token may be deleted, inserted or replaced at cost 1. Its cells are layered by cost: layer c of a rule at a
start holds the ends first reached with c edits, layer 0 being the plain chart. Layers are added one by one, so the first
that reaches the end of the text is the minimum, whatever the length of the text; the edits are read off by walking the
cells of that derivation backwards. An edit is only tried where the prefix before it can still be read with the edits
left, which no least-cost derivation needs to go beyond.

A chart of a long chain has an end for every pair of places. One that outgrows ``ENDS`` is given up for ``Stacks``, which
finds the same costs from what is left to read: at every place the set of the stacks that at most c edits lead to. Chains
come back to the same few sets, so its work grows with the length of the text.

Expressions: juxtaposition, ``|``, ``*``, ``+``, ``?`` and parentheses; ``'if'`` or ``'+'`` is a token by its spelling
(given to the grammar as a map to its character); ``P.args`` is a bracket group that can be read as ``args``; ``!name``
reads nothing and fails before a brace group or a member of the set ``name``.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

_TOKEN = re.compile(r"\s*(?:'([^']+)'|([PBC])\.(\w+)|(!?\w+)|([()|*+?]))")


#: Ends a chart of a repair may keep; where it outgrows them (long chains of one operator), ``Stacks`` does the repair.
ENDS = 1_000_000


class _TooWide(Exception):
    pass


class Grammar:
    def __init__(self, text: str, spelling: dict[str, str], sets: dict[str, set[str]]):
        """``spelling``: token -> character; ``sets``: named sets of characters usable like rules."""
        self.spelling, self.sets = spelling, sets
        self.nodes: list[tuple] = []
        self.rules: dict[str, int] = {}
        self.kinds: dict[tuple[str, str], set[str]] = {}
        self.braces: set[str] = set()
        bodies = {}
        for line in re.sub(r"\n[ \t]+(?=\S)", " ", text).strip().splitlines():
            line = line.split(" ## ")[0]
            if "=" in line:
                name, body = line.split("=", 1)
                bodies[name.strip()] = body
                self.rules[name.strip()] = self._add(("later",))
        for name, body in bodies.items():
            toks = _TOKEN.findall(body)
            node, rest = self._alt(toks, 0)
            if rest != len(toks):
                raise ValueError(f"rule {name} is malformed")
            self.nodes[self.rules[name]] = ("ref", node)
        self.chart: dict[tuple[int, int], tuple[int, ...]] = {}
        self.cells: dict[tuple[int, int, int], tuple[int, ...]] = {}
        self.text = ""
        self.far = self.limit = self.work = 0
        self.breaks: frozenset[int] = frozenset()
        self.commas = False
        self.closing = self._closing()
        self._firsts()

    def _firsts(self) -> None:
        """A bit mask of the characters and group kinds each node can begin with, and whether it can be empty."""
        self.mask: dict[str, int] = {}
        self.kind_bit = {k: 1 << n for n, k in enumerate(self.kinds)}
        of_kind = {id(v): k for k, v in self.kinds.items()}
        n = len(self.nodes)
        self.first, self.empty = [0] * n, [False] * n
        for i, node in enumerate(self.nodes):
            if node[0] == "set":
                k = of_kind.get(id(node[1]))
                if k:
                    self.first[i] = self.kind_bit[k]
                else:
                    for c in node[1]:
                        self.first[i] |= self.mask.setdefault(c, 1 << (len(self.kinds) + len(self.mask)))
        changed = True
        while changed:
            changed = False
            for i, node in enumerate(self.nodes):
                f, e = self.first[i], self.empty[i]
                if node[0] == "ref":
                    f, e = f | self.first[node[1]], e or self.empty[node[1]]
                elif node[0] == "alt":
                    for p in node[1]:
                        f, e = f | self.first[p], e or self.empty[p]
                elif node[0] == "seq":
                    for p in node[1]:
                        f |= self.first[p]
                        if not self.empty[p]:
                            break
                    else:
                        e = True
                elif node[0] == "not":
                    e = True
                elif node[0] != "set":
                    f, e = f | self.first[node[1]], e or node[0] != "plus" or self.empty[node[1]]
                if (f, e) != (self.first[i], self.empty[i]):
                    self.first[i], self.empty[i], changed = f, e, True

        self.alphabet = {}
        for name, root in self.rules.items():
            seen, todo = set(), [root]
            while todo:
                i = todo.pop()
                if i not in seen:
                    seen.add(i)
                    node = self.nodes[i]
                    todo += node[1] if node[0] in ("seq", "alt") else () if node[0] in ("set", "not") else (node[1],)
            self.alphabet[name] = 0
            for i in seen:
                if self.nodes[i][0] == "set":
                    self.alphabet[name] |= self.first[i]

    def spells(self, rule: str, text: str) -> bool:
        """Whether every token of ``text`` occurs somewhere in ``rule``."""
        known, mask = self.alphabet[rule], self.mask
        return all(mask.get(c, 0) & known for c in set(text))

    def _add(self, node: tuple) -> int:
        self.nodes.append(node)
        return len(self.nodes) - 1

    def _alt(self, t, i):
        node, i = self._seq(t, i)
        alts = [node]
        while i < len(t) and t[i][4] == "|":
            node, i = self._seq(t, i + 1)
            alts.append(node)
        return (alts[0] if len(alts) == 1 else self._add(("alt", alts))), i

    def _seq(self, t, i):
        parts = []
        while i < len(t) and t[i][4] not in ("|", ")"):
            node, i = self._atom(t, i)
            parts.append(node)
        return (parts[0] if len(parts) == 1 else self._add(("seq", parts))), i

    def _atom(self, t, i):
        quoted, bracket, kind, name, op = t[i]
        if quoted:
            node = self._add(("set", {self.spelling[quoted]}))
        elif bracket:
            node = self._add(("set", self.kinds.setdefault((bracket, kind), set())))
        elif name and name[0] == "!":
            node = self._add(("not", self.sets[name[1:]]))
        elif name:
            node = self.rules[name] if name in self.rules else self._add(("set", self.sets[name]))
        elif op == "(":
            node, i = self._alt(t, i + 1)
        else:
            raise ValueError(f"unexpected {op}")
        i += 1
        while i < len(t) and t[i][4] in ("*", "+", "?") and t[i][4]:
            node = self._add(({"*": "star", "+": "plus", "?": "opt"}[t[i][4]], node))
            i += 1
        return node, i

    # --- cost 0 ---------------------------------------------------------------------------------------------------

    def accepts(self, rule: str, text: str) -> bool:
        if text != self.text or not text:  # rules tried on the same text share its chart
            self.chart, self.text = {}, text
        return len(text) in self._deep(self._ends, self.rules[rule], 0, text)

    def _deep(self, read: Callable, *args):
        """Nesting of many thousand levels without a bracket needs as many calls: the limit is raised to a million of them."""
        while True:
            try:
                return read(*args)
            except RecursionError:
                self.chart, self.cells = {}, {}
                if sys.getrecursionlimit() >= 1_000_000:
                    raise
                sys.setrecursionlimit(min(4 * sys.getrecursionlimit(), 1_000_000))

    def _closing(self) -> set[int]:
        """The ';' that end something and the choices that hold one: a line break can stand for them, but not for a ';' alone."""
        out: set[int] = set()
        todo = [p for node in self.nodes if node[0] == "seq" for p in node[1][1:]]
        while todo:
            n = todo.pop()
            if n in out:
                continue
            if self.nodes[n] == ("set", {";"}):
                out.add(n)
            elif self.nodes[n][0] == "alt" and any(self.nodes[p] == ("set", {";"}) for p in self.nodes[n][1]):
                out.add(n)
                todo += self.nodes[n][1]
        return out

    def reach(self, rule: str, start: int, text: str, breaks: frozenset[int], commas: bool = False) -> int:
        """The furthest end of ``rule`` from ``start``, or ``start``; at ``breaks`` a closing ';' may be left out, and with
        ``commas`` a ',' may stand for it."""
        if text != self.text or breaks != self.breaks or commas != self.commas:
            self.chart, self.text, self.breaks, self.commas = {}, text, breaks, commas
        return max(self._deep(self._ends, self.rules[rule], start, text), default=start)

    def end_reach(self) -> None:
        self.chart, self.text, self.breaks, self.commas = {}, "", frozenset(), False

    def new_group(self, char: str, bracket: str, kinds: tuple[str, ...]) -> None:
        """``char`` stands for a group with these readings from now on."""
        if bracket == "C":
            self.braces.add(char)
        for k in kinds:
            if (bracket, k) in self.kinds:
                self.kinds[bracket, k].add(char)
                self.mask[char] = self.mask.get(char, 0) | self.kind_bit[bracket, k]
        self.chart = {}

    def _ends(self, n: int, i: int, s: str) -> tuple[int, ...]:
        node = self.nodes[n]
        kind = node[0]
        if kind == "set":
            if i < len(s) and (s[i] in node[1] or self.commas and s[i] == "," and n in self.closing):
                return (i + 1,)
            if i > self.far:
                self.far = i
            return (i,) if i in self.breaks and n in self.closing else ()
        if kind == "not":
            return () if i < len(s) and (s[i] in self.braces or s[i] in node[1]) else (i,)
        if not self.empty[n] and not (i < len(s) and self.mask.get(s[i], 0) & self.first[n]) and not (n in self.closing and (i in self.breaks or self.commas)):
            if i > self.far:
                self.far = i
            return ()
        key = (n, i)
        got = self.chart.get(key)
        if got is not None:
            return got
        self.chart[key] = ()  # a rule that comes back to itself without a token adds nothing
        if kind == "ref":
            out = self._ends(node[1], i, s)
        elif kind == "seq":
            at: tuple[int, ...] = (i,)
            for part in node[1]:
                at = self._ends(part, at[0], s) if len(at) == 1 else tuple({e for a in at for e in self._ends(part, a, s)})
                if not at:
                    break
            out = at
        elif kind == "alt":
            out = tuple({e for part in node[1] for e in self._ends(part, i, s)})
        elif kind == "opt":
            out = tuple({i, *self._ends(node[1], i, s)})
        else:
            seen = set() if kind == "plus" else {i}
            todo = [i]
            while todo:
                for e in self._ends(node[1], todo.pop(), s):
                    if e not in seen:
                        seen.add(e)
                        todo.append(e)
            out = tuple(seen)
            if self.work:
                self.work += len(seen)
                if self.work > ENDS:
                    raise _TooWide
        self.chart[key] = out
        return out

    # --- with edits -----------------------------------------------------------------------------------------------

    def repair(self, rule: str, text: str, most: int = 3) -> tuple[int, list[int]]:
        """Least number of edits that makes ``text`` a ``rule``, and the positions they stand at.

        Exact up to ``most`` edits, at any length and width of the chart. Beyond, an upper bound: the prefix that leaves least
        to delete."""
        self.chart, self.cells, self.text, self.far = {}, {}, text, 0
        root, n = self.rules[rule], len(text)
        ends = [self._deep(self._ends, root, 0, text)]
        if n in ends[0]:
            return 0, []
        self.work = 1
        try:
            for bound in range(1, most + 1):
                self.limit, self.cells = self.far, {}
                ends.append(self._deep(self._layer, root, 0, text, bound))
                hit = next(((c, e) for c in range(bound, -1, -1) for e in ends[c] if c + n - e == bound), None)
                if hit:
                    return bound, self._trace(root, 0, text, *hit) + list(range(hit[1], n))
            c, e = min(((c, e) for c, at in enumerate(ends) for e in at), key=lambda x: x[0] - x[1], default=(0, 0))
            return (c + n - e, self._trace(root, 0, text, c, e) + list(range(e, n))) if e else (max(1, n), list(range(max(1, n))))
        except _TooWide:
            self.chart, self.cells = {}, {}
            return Stacks(self, root).repair(text, most)
        finally:
            self.work = 0

    def _layer(self, n: int, i: int, s: str, c: int) -> tuple[int, ...]:
        """Ends first reached with exactly ``c`` edits."""
        if not c:
            return self._ends(n, i, s)
        if i > self.limit:
            return ()  # an edit here comes after a token that no reading with the edits before it reaches
        node = self.nodes[n]
        kind = node[0]
        if kind == "set":
            if c > 1:
                return (i + c + 1,) if i + c < len(s) and s[i + c] in node[1] else ()  # c tokens deleted before it
            if i + 1 > self.far:
                self.far = min(i + 1, len(s))
            if i >= len(s):
                return (i,)  # inserted
            out = (i,) if s[i] in node[1] else (i, i + 1)  # inserted, replaced
            return (*out, i + 2) if i + 1 < len(s) and s[i + 1] in node[1] else out
        if kind == "not":
            return (i,) if c == 1 and not self._ends(n, i, s) else ()
        key = (n, i, c)
        got = self.cells.get(key)
        if got is not None:
            return got
        self.cells[key] = ()
        layer = self._layer
        if kind == "ref":
            out = layer(node[1], i, s, c)
        elif kind == "seq":
            out = tuple(e for e, k in self._chain(node[1], i, s, c)[-1].items() if k == c)
        elif kind in ("alt", "opt"):
            parts = node[1] if kind == "alt" else (node[1],)
            new = {e for p in parts for e in layer(p, i, s, c)}
            out = tuple(new.difference((i,) if kind == "opt" else (), *(layer(n, i, s, d) for d in range(c)))) if new else ()
        else:
            out = tuple(e for e, k in self._loop(node, i, s, c).items() if k == c)
        self.cells[key] = out
        self.work += 1 + len(out)
        if self.work > ENDS:
            raise _TooWide
        return out

    def _chain(self, parts: list[int], i: int, s: str, c: int) -> list[dict[int, int]]:
        """Least costs up to ``c`` of the positions after each part of a sequence."""
        steps = [{i: 0}]
        for part in parts:
            nxt: dict[int, int] = {}
            for a, k in steps[-1].items():
                for d in range(c - k + 1):
                    for e in self._layer(part, a, s, d):
                        if k + d < nxt.get(e, c + 1):
                            nxt[e] = k + d
            steps.append(nxt)
        return steps

    def _loop(self, node: tuple, i: int, s: str, c: int) -> dict[int, int]:
        """Least costs up to ``c`` of the positions a repetition reaches."""
        best = {i: 0} if node[0] != "plus" else {}
        todo: list[list[int]] = [[i], *([] for _ in range(c))]
        for k in range(c + 1):
            while todo[k]:
                a = todo[k].pop()
                if best.get(a, k) < k:
                    continue
                for d in range(c - k + 1):
                    for e in self._layer(node[1], a, s, d):
                        if (e > a or node[0] == "plus" and a == i) and k + d < best.get(e, c + 1):
                            best[e] = k + d
                            if e > a:
                                todo[k + d].append(e)
        return best

    def _trace(self, n: int, i: int, s: str, c: int, e: int) -> list[int]:
        """Positions of the edits of one derivation of the cell's end ``e`` with ``c`` edits."""
        if not c:
            return []
        node = self.nodes[n]
        kind = node[0]
        if kind == "set":
            return [i] if e <= i + 1 else list(range(i, e - 1))
        if kind == "not":
            return [i]
        if kind in ("ref", "opt"):
            return self._trace(node[1], i, s, c, e)
        if kind == "alt":
            return next((self._trace(p, i, s, c, e) for p in node[1] if e in self._layer(p, i, s, c)), [])
        if kind == "seq":
            parts, steps = node[1], self._chain(node[1], i, s, c)
        else:
            best, path, at = self._loop(node, i, s, c) | {i: 0}, [], (e, c)
            while at[0] != i:  # the repetition's steps, from its end back
                at0 = next(((a, k) for a, k in best.items() if a < at[0] and k <= at[1] and at[0] in self._layer(node[1], a, s, at[1] - k)), None)
                if at0 is None:
                    break
                path.append((at0, at))
                at = at0
            if not path and e == i:
                return self._trace(node[1], i, s, c, e)
            return [x for (a, k), (z, m) in reversed(path) for x in self._trace(node[1], a, s, m - k, z)]
        out: list[int] = []
        for part, step in zip(reversed(parts), reversed(steps[:-1])):
            a, k = next((a, k) for a, k in step.items() if k <= c and e in self._layer(part, a, s, c - k))
            out = self._trace(part, a, s, c - k, e) + out
            e, c = a, k
        return out


class Stacks:
    """Least-cost repair by sets of stacks, for rules that do not begin with themselves.

    A stack is a number for (node, repeated, stack below), equal ones having one number; 0 is the empty one. ``sets[c][p]`` is
    the set of the stacks that can be left at place p after at most c edits; sets have numbers, too, and what follows from a
    set and a token is worked out once."""

    def __init__(self, grammar: Grammar, root: int):
        self.g = grammar
        self.number: dict[tuple[int, bool, int], int] = {}
        self.stack: list[tuple[int, bool, int]] = [(-1, False, 0)]
        self.moves: dict[tuple[int, str], tuple[frozenset[int], frozenset[int], frozenset[int], bool]] = {}
        self.sets: list[frozenset[int]] = []
        self.set_number: dict[frozenset[int], int] = {}
        self.by_set: dict[tuple[int, str], tuple[frozenset[int], frozenset[int], frozenset[int], bool]] = {}
        self.nexts: dict[tuple, int] = {}
        self.start = self._push(root, 0)

    def _push(self, node: int, below: int, repeated: bool = False) -> int:
        key = (node, repeated, below)
        got = self.number.get(key)
        if got is None:
            got = self.number[key] = len(self.stack)
            self.stack.append(key)
        return got

    def _moves(self, k: int, c: str) -> tuple[frozenset[int], frozenset[int], frozenset[int], bool]:
        """Stacks left after reading token ``c`` ('' at the end), after reading one that is put in, after passing a ``!`` that fails
        at ``c``, and whether nothing need follow."""
        got = self.moves.get((k, c))
        if got is not None:
            return got
        nodes, braces = self.g.nodes, self.g.braces
        read, edited, passed, empty = set(), set(), set(), False
        seen, todo = {k}, [k]
        while todo:
            at = todo.pop()
            if not at:
                empty = True
                continue
            n, repeated, below = self.stack[at]
            kind, arg = nodes[n]
            if kind == "set":
                edited.add(below)
                if c and c in arg:
                    read.add(below)
                continue
            if kind == "not":
                if c and (c in braces or c in arg):
                    passed.add(below)
                    continue
                new = [below]
            elif kind == "ref":
                new = [self._push(arg, below)]
            elif kind == "alt":
                new = [self._push(p, below) for p in arg]
            elif kind == "seq":
                for p in reversed(arg):
                    below = self._push(p, below)
                new = [below]
            elif kind == "opt":
                new = [below, self._push(arg, below)]
            else:
                new = [self._push(arg, self._push(n, below, True))]
                if repeated or kind == "star":
                    new.append(below)
            for x in new:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        got = self.moves[k, c] = (frozenset(read), frozenset(edited), frozenset(passed), empty)
        return got

    def _of_set(self, number: int, c: str) -> tuple[frozenset[int], frozenset[int], frozenset[int], bool]:
        got = self.by_set.get((number, c))
        if got is None:
            each = [self._moves(k, c) for k in self.sets[number]]
            got = self.by_set[number, c] = (*(frozenset().union(*(m[i] for m in each)) for i in range(3)), any(m[3] for m in each))
        return got

    def _intern(self, x: frozenset[int]) -> int:
        got = self.set_number.get(x)
        if got is None:
            got = self.set_number[x] = len(self.sets)
            self.sets.append(x)
        return got

    def _next(self, before: int | None, cheaper: int | None, here: int | None, c: str, after: str) -> int:
        """The set at a place, from those with as many and one edit less at the place before (token ``c``) and the one with one
        edit less at it."""
        key = (before, cheaper, here, c, after)
        got = self.nexts.get(key)
        if got is None:
            x: frozenset[int] = frozenset([self.start]) if before is None else self._of_set(before, c)[0]
            if cheaper is not None:
                x = x | self.sets[cheaper] | self._of_set(cheaper, c)[1]  # deleted, replaced
            if here is not None:
                _, inserted, passed, _ = self._of_set(here, after)
                x = x | self.sets[here] | inserted | passed
            got = self.nexts[key] = self._intern(x)
        return got

    def repair(self, text: str, most: int) -> tuple[int, list[int]]:
        """As ``Grammar.repair``."""
        n = len(text)
        tokens = [*text, ""]
        layers: list[list[int]] = []
        for bound in range(most + 1):
            below = layers[-1] if layers else None
            layer: list[int] = []
            for p in range(n + 1):
                layer.append(self._next(layer[-1] if p else None, below[p - 1] if below and p else None, below[p] if below else None, text[p - 1] if p else "", tokens[p]))
            layers.append(layer)
            if self._of_set(layer[n], "")[3]:
                return bound, self._trace(layers, text, bound, n)
        # the end of a prefix is read with nothing behind it
        c, e = min(((c, p) for c, layer in enumerate(layers) for p in range(n, -1, -1) if self._of_set(layer[p], tokens[p])[3]), key=lambda x: x[0] - x[1], default=(0, 0))
        return (c + n - e, self._trace(layers, text, c, e) + list(range(e, n))) if e else (max(1, n), list(range(max(1, n))))

    def _trace(self, layers: list[list[int]], text: str, c: int, p: int) -> list[int]:
        """Places of the edits on a way to a finished stack at ``p`` with ``c`` edits, the last ones as late as can be."""
        tokens = [*text, ""]
        k = next(x for x in self.sets[layers[c][p]] if self._moves(x, tokens[p])[3])
        out: list[int] = []
        while p or c:
            lower = self.sets[layers[c - 1][p]] if c else frozenset()
            if k in lower:
                c -= 1
                continue
            back = self.sets[layers[c - 1][p - 1]] if c and p else frozenset()
            via = next((x for x in lower if any(k in m for m in self._moves(x, tokens[p])[1:3])), None)  # inserted, passed
            if via is not None:
                c, k = c - 1, via
                out.append(p)
                continue
            via = k if k in back else next((x for x in back if k in self._moves(x, tokens[p - 1])[1]), None)  # deleted, replaced
            if via is not None:
                c, k = c - 1, via
                out.append(p - 1)
            else:
                k = next(x for x in self.sets[layers[c][p - 1]] if k in self._moves(x, tokens[p - 1])[0])
            p -= 1
        return out[::-1]
