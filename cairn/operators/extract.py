"""Facts of source files: symbols, calls, imports, environment variables, debt comments, routes, clone fingerprints.

One pass over a file yields all kinds of facts, so a file is read and parsed once. Python goes through the standard
library's parser; the other languages through one scanner that knows strings, comments and brackets and recognises the
constructs that matter. A file that cannot be read gives no facts and an error text, never a failed job.

Defined cases: null contents give no row; empty files no facts; repeated rows are repeated.
"""

from __future__ import annotations

import ast
import bisect
import hashlib
import io
import re
import tokenize
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cairn.functions import constants as K
from cairn.session import spread

GRAMMAR = {**K.GRAMMAR_LANGUAGES}


def language_of(path: str) -> str:
    m = re.search(r"[^/](\.[^./]+)$", path)
    s = m[1].lower() if m else ""
    return GRAMMAR.get(s) or K.OTHER_LANGUAGES.get(s) or "text"


# --- Python ---------------------------------------------------------------------------------------------------------------


def _name(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = _name(node.value)
        return f"{base}.{node.attr}" if base else node.attr
    if isinstance(node, ast.Call):
        return _name(node.func)
    return None


def _literal(node: ast.AST | None) -> str | None:
    if isinstance(node, ast.Constant) and node.value is not None and not isinstance(node.value, (bytes, complex)) and node.value is not ...:
        v = node.value
        return str(v)[:200] if not isinstance(v, bool) else str(v)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant):
        return f"-{node.operand.value}"
    return None


class _Python(ast.NodeVisitor):
    def __init__(self, path: str, source: str):
        self.path, self.lines = path, source.splitlines()
        self.symbols: list[dict] = []
        self.calls: list[dict] = []
        self.imports: list[dict] = []
        self.env: list[dict] = []
        self.stack: list[tuple[str, str]] = []  # (name, kind)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            self.visit(ast.parse(source))

    def _scope(self) -> tuple[str | None, str | None]:
        q = ".".join(n for n, _ in self.stack) or None
        owner = next((".".join(n for n, _ in self.stack[: k + 1]) for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][1] == "class"), None)
        return q, owner

    def _define(self, node, kind: str) -> None:
        q, _ = self._scope()
        in_class = bool(self.stack) and self.stack[-1][1] == "class"
        if kind == "function" and in_class:
            kind = "method"
        qualified = f"{q}.{node.name}" if q else node.name
        start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        head = " ".join(self.lines[node.lineno - 1 : node.body[0].lineno - 1 or node.lineno]) if node.body[0].lineno > node.lineno else self.lines[node.lineno - 1]
        sig = re.sub(r"\s+", " ", head).strip().rstrip(" :")[:200]
        self.symbols.append({
            "name": node.name, "qualified_name": qualified, "kind": kind, "owner": q if in_class else None, "start_line": start, "end_line": node.end_lineno,
            "is_test": node.name.startswith("test") or (kind == "class" and node.name.startswith("Test")), "has_doc": ast.get_docstring(node, clean=False) is not None, "signature": sig,
        })
        for d in node.decorator_list:
            self.visit(d)
        if kind == "class":
            for b in node.bases:
                if (n := _name(b)) is not None:
                    self.calls.append({"from": qualified, "to": n.split(".")[-1], "receiver": ".".join(n.split(".")[:-1]) or None, "kind": "inherit", "line": node.lineno})
            self._settings(node)
        self.stack.append((node.name, "class" if kind == "class" else "function"))
        if kind != "class":
            self.visit(node.args)
            if node.returns:
                self.visit(node.returns)
        for x in node.body:
            self.visit(x)
        self.stack.pop()

    def visit_FunctionDef(self, node):  # noqa: N802
        self._define(node, "function")

    visit_AsyncFunctionDef = visit_FunctionDef  # noqa: N815

    def visit_ClassDef(self, node):  # noqa: N802
        self._define(node, "class")

    def visit_Call(self, node):  # noqa: N802
        q, _ = self._scope()
        f = node.func
        if isinstance(f, ast.Name):
            self.calls.append({"from": q, "to": f.id, "receiver": None, "kind": "call", "line": node.lineno})
        elif isinstance(f, ast.Attribute):
            base = _name(f.value)
            if isinstance(f.value, ast.Call) and _name(f.value.func) == "super":
                base = "super"
            self.calls.append({"from": q, "to": f.attr, "receiver": base, "kind": "call", "line": node.lineno})
        self._env_call(node)
        self.generic_visit(node)

    def visit_Import(self, node):  # noqa: N802
        for a in node.names:
            self.imports.append({"module": a.name, "names": [], "alias": a.asname, "line": node.lineno})

    def visit_ImportFrom(self, node):  # noqa: N802
        names = [a.name if not a.asname else f"{a.name} as {a.asname}" for a in node.names]
        self.imports.append({"module": "." * node.level + (node.module or ""), "names": names, "alias": None, "line": node.lineno})

    # environment variables
    def _read(self, name, line, default=None, required=False, has_default=False, source="code"):
        if isinstance(name, str) and re.fullmatch(r"[A-Za-z_]\w*", name, re.A):
            self.env.append({"name": name, "line": line, "default_value": default, "has_default": has_default, "required": required, "source": source})

    def _env_call(self, node: ast.Call) -> None:
        n = _name(node.func)
        if n in ("os.getenv", "getenv", "os.environ.get", "environ.get") and node.args and isinstance(node.args[0], ast.Constant):
            d = node.args[1] if len(node.args) > 1 else next((k.value for k in node.keywords if k.arg == "default"), None)
            default, has = _literal(d), d is not None and not (isinstance(d, ast.Constant) and d.value is None)
            parent = self._or_default.get(id(node))
            if parent is not None and not has:
                default, has = _literal(parent), True
            self._read(node.args[0].value, node.lineno, default, False, has)

    _or_default: dict[int, ast.AST] = {}

    def visit_BoolOp(self, node):  # noqa: N802
        if isinstance(node.op, ast.Or) and len(node.values) > 1:
            self._or_default = {**self._or_default, id(node.values[0]): node.values[1]}
        self.generic_visit(node)

    def visit_Subscript(self, node):  # noqa: N802
        if _name(node.value) in ("os.environ", "environ") and isinstance(node.slice, ast.Constant) and isinstance(node.ctx, ast.Load):
            self._read(node.slice.value, node.lineno, None, True, False)
        self.generic_visit(node)

    def _settings(self, node: ast.ClassDef) -> None:
        if not any((_name(b) or "").split(".")[-1] == "BaseSettings" for b in node.bases):
            return
        prefix = ""
        for x in node.body:
            if isinstance(x, ast.Assign) and _name(x.targets[0]) == "model_config" and isinstance(x.value, ast.Call):
                prefix = next((k.value.value for k in x.value.keywords if k.arg == "env_prefix" and isinstance(k.value, ast.Constant)), prefix)
            if isinstance(x, ast.ClassDef) and x.name == "Config":
                prefix = next((y.value.value for y in x.body if isinstance(y, ast.Assign) and _name(y.targets[0]) == "env_prefix" and isinstance(y.value, ast.Constant)), prefix)
        for x in node.body:
            if not isinstance(x, ast.AnnAssign) or not isinstance(x.target, ast.Name) or x.target.id == "model_config":
                continue
            name, value, has = (prefix + x.target.id).upper(), x.value, x.value is not None
            if isinstance(value, ast.Call) and (_name(value.func) or "").endswith("Field"):
                kw = {k.arg: k.value for k in value.keywords}
                alias = next((kw[a].value for a in ("validation_alias", "alias", "env") if isinstance(kw.get(a), ast.Constant)), None)
                name = alias or name
                value = kw.get("default", value.args[0] if value.args else None)
                has = (value is not None and not (isinstance(value, ast.Constant) and value.value is ...)) or "default_factory" in kw
            self._read(name, x.lineno, _literal(value) if has else None, not has, has, "pydantic")


# --- one scanner for the brace languages --------------------------------------------------------------------------------

_BLANK = {
    "javascript": re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`"),
    "go": re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+'|`[^`]*`"),
    "java": re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+'"),
    "csharp": re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|[$@]*@[$@]*\"(?:[^\"]|\"\")*\"|\$?\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+'"),
}
_BLANK["typescript"] = _BLANK["tsx"] = _BLANK["javascript"]
_NOT_CALLS = set("if for while switch catch return function new typeof sizeof await super throw else do case in of instanceof lock using foreach when nameof default delete void yield defer go func range select synchronized try finally import export class interface enum struct map chan".split())
_CALL = re.compile(r"(?:(?P<new>\bnew\s+)|(?P<recv>(?:[\w$\]\)]+(?:\s*\?)?\s*\.\s*)+))?(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[\w\s,.<>\[\]?]{1,80}>\s*)?\(")


class Scanned:
    """A source with strings and comments blanked out, its brackets matched and its line starts known."""

    def __init__(self, language: str, source: str):
        self.source, self.language = source, language
        self.comments: list[tuple[int, str]] = []
        self.strings: list[tuple[int, str]] = []

        def blank(m: re.Match) -> str:
            x = m[0]
            (self.comments if x.startswith(("//", "/*")) else self.strings).append((m.start(), x))
            keep = "" if x.startswith(("//", "/*")) else x[0]
            return keep + re.sub(r"[^\n]", " ", x[len(keep) : len(x) - len(keep)]) + (x[-1] if keep else "")

        self.code = _BLANK[language].sub(blank, source)
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]
        self.close: dict[int, int] = {}
        stack: list[int] = []
        pair = {")": "(", "]": "[", "}": "{"}
        for m in re.finditer(r"[()\[\]{}]", self.code):
            c = m[0]
            if c in "([{":
                stack.append(m.start())
            elif stack and self.code[stack[-1]] == pair[c]:
                self.close[stack.pop()] = m.start()

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at)

    def text(self, a: int, b: int) -> str:
        return self.source[a:b]


_DEFS = {
    "javascript": [
        ("class", re.compile(r"\b(?:class)\s+(?P<name>[A-Za-z_$][\w$]*)(?:<[^{]*?>)?(?:\s+extends\s+(?P<base>[\w$.]+)[^{]*?)?(?:\s+implements\s+(?P<impl>[^{]+))?\s*\{")),
        ("function", re.compile(r"\bfunction\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^(]*>)?\(")),
        ("function", re.compile(r"\b(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?:\((?=[^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=>{]+)?=>)|[A-Za-z_$][\w$]*\s*=>|function\b)")),
        ("method", re.compile(r"(?m)^[ \t]*(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*\*?(?P<name>#?[A-Za-z_$][\w$]*)\s*(?:<[^(\n]*>)?\((?=[^;]*\{)")),
        ("method", re.compile(r"(?m)^[ \t]*(?:(?:public|private|protected|static|readonly)\s+)*(?P<name>[A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^()]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=>{]+)?=>")),
    ],
    "go": [
        ("method", re.compile(r"(?m)^func\s*\(\s*\w*\s*\*?(?P<owner>\w+)(?:\[[^\]]*\])?\s*\)\s*(?P<name>\w+)\s*(?:\[[^\]]*\])?\(")),
        ("function", re.compile(r"(?m)^func\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?\(")),
        ("class", re.compile(r"(?m)^type\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?\s+(?:struct|interface)\s*\{")),
    ],
    "java": [
        ("class", re.compile(r"\b(?:class|interface|enum|record)\s+(?P<name>\w+)(?:<[^{(]*?>)?(?:\s*\([^)]*\))?(?:\s+extends\s+(?P<base>[\w.,<> ]+?))?(?:\s+implements\s+(?P<impl>[^{]+))?\s*\{")),
        ("method", re.compile(r"(?m)^[ \t]*(?:@\w+(?:\([^)\n]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|default|native)\s+)*(?:<[^>\n]+>\s+)?(?:[\w.]+(?:<[^;{}()=]*>)?(?:\[\])*\s+)?(?P<name>\w+)\s*\((?=[^;{}=]*\)\s*(?:throws\s[\w.,\s]+)?[{;])")),
    ],
    "csharp": [
        ("class", re.compile(r"\b(?:class|interface|struct|record|enum)\s+(?P<name>\w+)(?:<[^{(]*?>)?(?:\s*\([^)]*\))?(?:\s*:\s*(?P<base>[^{;]+?))?\s*(?:where[^{]*)?\{")),
        ("method", re.compile(r"(?m)^[ \t]*(?:\[[^\]\n]*\]\s*)*(?:(?:public|private|protected|internal|static|virtual|override|abstract|async|sealed|extern|partial|new)\s+)*(?:[\w.]+(?:<[^;{}()=]*>)?(?:\[\])*\??\s+)?(?P<name>\w+)\s*(?:<[^(\n]*>)?\((?=[^;{}=]*\)\s*(?::\s*(?:base|this)\s*\([^)]*\)\s*)?(?:where[^{]*)?(?:[{;]|=>))")),
    ],
}
_DEFS["typescript"] = _DEFS["tsx"] = _DEFS["javascript"]


_ATTRIBUTE = re.compile(r"^[ \t]*(?:\[[^\]]*\][ \t]*)*\[[^\]]*$")


def _end_of(sc: Scanned, at: int) -> int:
    """End of a definition that begins before ``at``: its body's bracket, else the end of the statement."""
    i, code, n = at, sc.code, len(sc.code)
    while i < n:
        c = code[i]
        if c in "([":
            i = sc.close.get(i, i)
        elif c == "{":
            return sc.close.get(i, n - 1)
        elif c == ";":
            return i
        elif c == "=" and code[i : i + 2] == "=>":
            j = i + 2
            while j < n and code[j] in " \t\n":
                j += 1
            if j < n and code[j] == "{":
                return sc.close.get(j, n - 1)
            k = code.find("\n", j)
            s = code.find(";", j)
            return min(x for x in (k, s, n - 1) if x >= 0)
        i += 1
    return n - 1


def _scan(language: str, source: str) -> dict:
    sc = Scanned(language, source)
    found: dict[int, dict] = {}
    code = sc.code
    for kind, rx in _DEFS[language]:
        for m in rx.finditer(code):
            name, at = m["name"], m.start("name")
            if name in _NOT_CALLS or at in found:
                continue
            end = _end_of(sc, m.end() - 1 if code[m.end() - 1] in "({" else m.end())
            d = m.groupdict()
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            found[at] = {"name": name, "kind": kind, "at": at, "start": start, "end": end, "owner": d.get("owner"), "bases": [b.strip().split("<")[0] for b in re.split(r"[,\s]+", f"{d.get('base') or ''},{d.get('impl') or ''}") if b.strip() and b.strip() not in ("implements", "extends")]}
    defs = sorted(found.values(), key=lambda d: (d["start"], -d["end"]))
    symbols, stack = [], []
    for d in defs:
        while stack and stack[-1]["end"] < d["start"]:
            stack.pop()
        holder = stack[-1] if stack else None
        cls = next((x for x in reversed(stack) if x["kind"] == "class"), None)
        if d["kind"] == "method" and language not in ("go",) and (holder is None or holder["kind"] != "class"):
            continue  # a call followed by a block, or code outside a class
        if language in ("java", "csharp") and d["kind"] == "method" and re.search(r"\b(?:new|return|throw|else|await)\s+$", code[max(0, d["at"] - 12) : d["at"]]):
            continue
        if d["kind"] == "function" and holder is not None and holder["kind"] == "class":
            d["kind"] = "method"
        owner = d["owner"] or (cls["qualified"] if cls and holder is cls else None)
        d["qualified"] = f"{owner or holder['qualified']}.{d['name']}" if (owner or holder) else d["name"]
        first = sc.line(d["start"])
        before = [c for c in sc.comments if c[0] < d["start"]]
        doc = before[-1] if before else None
        near = doc is not None and doc[1].startswith(K.DOC_MARKS[language]) and sc.line(doc[0] + len(doc[1].rstrip())) >= first - 1
        has_doc = near and sc.code[before[-1][0] : d["start"]].strip() in ("", "export", "export default") or near and not re.sub(r"(?:@\w+(?:\([^)]*\))?|\[[^\]]*\]|export|default|public|abstract|static|async|const|\s)", "", sc.code[before[-1][0] : d["start"]])
        head = sc.source[d["start"] : d["at"] + 300].split("{")[0]
        notes = set(re.findall(r"[@\[]\s*(\w+)", sc.source[max(0, d["start"] - 200) : d["at"]])) if language in ("java", "csharp") else set()
        symbols.append({
            "name": d["name"], "qualified_name": d["qualified"], "kind": d["kind"], "owner": owner, "start_line": first, "end_line": sc.line(d["end"]), "has_doc": bool(has_doc),
            "is_test": bool(re.match(K.GO_TEST, d["name"])) if language == "go" else bool(notes & set(K.TEST_ANNOTATIONS)) or (d["kind"] == "class" and bool(notes & set(K.TEST_CLASS_ATTRIBUTES))),
            "signature": re.sub(r"\s+", " ", head).strip().rstrip(" :{").removesuffix("=>").strip()[:200],
        })
        stack.append(d)
    kept = [d for d in defs if "qualified" in d]
    calls = [{"from": d["qualified"], "to": b.split(".")[-1], "receiver": ".".join(b.split(".")[:-1]) or None, "kind": "inherit", "line": sc.line(d["at"])} for d in kept for b in d["bases"] if re.fullmatch(r"[\w$.]+", b)]
    at_def = {d["at"] for d in kept}
    order = sorted(kept, key=lambda d: (d["start"], -d["end"]))
    around: list[dict] = []
    nxt = 0
    for m in _CALL.finditer(code):
        name = m["name"]
        if name in _NOT_CALLS or m.start("name") in at_def:
            continue
        at = m.start("name")
        while nxt < len(order) and order[nxt]["start"] <= at:
            around.append(order[nxt])
            nxt += 1
        while around and around[-1]["end"] < at:
            around.pop()
        if language == "java" and code[at - 1 : at] == "@" or language == "csharp" and _ATTRIBUTE.search(code[code.rfind("\n", 0, at) + 1 : at]):
            continue  # an annotation's arguments are no call
        inside = [d for d in around if d["end"] >= at]
        recv = re.sub(r"[\s?]", "", m["recv"] or "").rstrip(".") or None
        calls.append({"from": inside[-1]["qualified"] if inside else None, "to": name, "receiver": recv, "kind": "call", "line": sc.line(m.start("name"))})
    return {"symbols": symbols, "calls": calls, "imports": _imports(language, sc), "env": _env(language, sc), "namespace": _namespace(language, sc), "scanned": sc}


def _namespace(language: str, sc: Scanned) -> str | None:
    rx = {"go": r"(?m)^package\s+(\w+)", "java": r"(?m)^\s*package\s+([\w.]+)", "csharp": r"(?m)^\s*namespace\s+([\w.]+)"}.get(language)
    m = re.search(rx, sc.code) if rx else None
    return m[1] if m else None


def _imports(language: str, sc: Scanned) -> list[dict]:
    src, out = sc.source, []

    def add(at, module, names=(), alias=None):
        out.append({"module": module, "names": list(names), "alias": alias, "line": sc.line(at)})

    if language in ("javascript", "typescript", "tsx"):
        for m in re.finditer(r"(?m)^[ \t]*(?:import|export)\s+(?:type\s+)?(?P<c>[^'\"`;]*?)\s*(?:\bfrom\s*)?['\"](?P<m>[^'\"\n]+)['\"]", src):
            c = m["c"]
            names = [re.sub(r"^type\s+", "", x.strip()) for g in re.findall(r"\{([^}]*)\}", c) for x in g.split(",") if x.strip()]
            star = re.search(r"\*\s+as\s+([\w$]+)", c)
            default = re.match(r"([A-Za-z_$][\w$]*)", re.sub(r"\{[^}]*\}", "", c).strip())
            add(m.start("m"), m["m"], names, star[1] if star else default[1] if default else None)
        for m in re.finditer(r"(?:(?:const|let|var)\s+(?:(?P<a>[\w$]+)|\{(?P<n>[^}]*)\})\s*=\s*)?\brequire\(\s*['\"](?P<m>[^'\"\n]+)['\"]\s*\)", src):
            add(m.start("m"), m["m"], [re.sub(r"\s*:\s*", " as ", x.strip()) for x in (m["n"] or "").split(",") if x.strip()], m["a"])
    elif language == "go":
        for block in re.finditer(r"(?m)^import\s*(?:\((?P<b>[^)]*)\)|(?P<o>[^\n(]+))", src):
            for m in re.finditer(r"(?:(?P<a>[\w.]+)\s+)?\"(?P<m>[^\"\n]+)\"", block["b"] if block["b"] is not None else block["o"]):
                add(block.start("b" if block["b"] is not None else "o") + m.start("m"), m["m"], (), m["a"])
    elif language == "java":
        for m in re.finditer(r"(?m)^\s*import\s+(?:static\s+)?(?P<m>[\w.]+?)(?P<s>\.\*)?\s*;", src):
            mod = m["m"]
            add(m.start("m"), mod, ["*"] if m["s"] else [mod.split(".")[-1]])
    elif language == "csharp":
        for m in re.finditer(r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?(?:(?P<a>\w+)\s*=\s*)?(?P<m>[\w.]+)\s*;", src):
            add(m.start("m"), m["m"], (), m["a"])
    return out


_LIT = r"(?:\"(?P<d>[^\"\n]*)\"|'(?P<s>[^'\n]*)'|`(?P<b>[^`$\n]*)`|(?P<v>-?\d+(?:\.\d+)?|true|false))"
_ENV = {
    "javascript": re.compile(r"(?:process\.env|import\.meta\.env)(?:\.(?P<n>[A-Za-z_]\w*)|\[\s*['\"](?P<q>[A-Za-z_]\w*)['\"]\s*\])(?!\s*=[^=])(?:\s*(?:\|\||\?\?)\s*(?:" + _LIT + r"|(?P<x>[\w$.(]+)))?"),
    "go": re.compile(r"os\.(?P<f>Getenv|LookupEnv)\(\s*\"(?P<n>[A-Za-z_]\w*)\"\s*\)"),
    "java": re.compile(r"System\.getenv\(\s*\"(?P<n>[A-Za-z_]\w*)\"\s*\)|System\.getenv\(\)\.(?:get|getOrDefault)\(\s*\"(?P<q>[A-Za-z_]\w*)\"(?:\s*,\s*" + _LIT + r")?\s*\)"),
    "csharp": re.compile(r"Environment\.GetEnvironmentVariable\(\s*\"(?P<n>[A-Za-z_]\w*)\"\s*\)(?:\s*\?\?\s*(?:(?P<t>throw)\b|" + _LIT + r"|(?P<x>[\w.(]+)))?"),
}
_ENV["typescript"] = _ENV["tsx"] = _ENV["javascript"]


def _env(language: str, sc: Scanned) -> list[dict]:
    out = []
    in_comment = [(a, a + len(x)) for a, x in sc.comments]
    for m in _ENV[language].finditer(sc.source):
        if any(a <= m.start() < b for a, b in in_comment):
            continue
        g = m.groupdict()
        name = g.get("n") or g.get("q")
        default = next((g[k] for k in ("d", "s", "b", "v") if g.get(k) is not None), None)
        has = default is not None or g.get("x") is not None or g.get("f") == "LookupEnv"
        out.append({"name": name, "line": sc.line(m.start()), "default_value": default[:200] if default is not None else None, "has_default": has, "required": g.get("f") == "Getenv" or g.get("t") == "throw", "source": "code"})
    if language in ("javascript", "typescript", "tsx"):
        for m in re.finditer(r"(?:const|let|var)\s*\{([^}]*)\}\s*=\s*(?:process\.env|import\.meta\.env)\b", sc.source):
            for x in re.finditer(r"([A-Za-z_]\w*)\s*(?::\s*\w+)?\s*(?:=\s*" + _LIT + r")?\s*(?:,|$)", m[1]):
                default = next((x[k] for k in ("d", "s", "b", "v") if x[k] is not None), None)
                out.append({"name": x[1], "line": sc.line(m.start(1) + x.start()), "default_value": default, "has_default": default is not None, "required": False, "source": "code"})
    return sorted(out, key=lambda e: e["line"])


# --- debt comments -----------------------------------------------------------------------------------------------------


def _notes(language: str, source: str, tags: tuple[str, ...], scanned: Scanned | None) -> list[dict]:
    """Lines in which a tag may stand, with what they are: of a comment, of marked text or of prose. Which of them are
    debt, ``debt_table`` tells."""
    if not any(t in source for t in tags):
        return []
    if language == "python":
        lines = [(at, c, "comment") for at, c in _python_comments(source)]
    elif language in _DEFS:
        sc = scanned or Scanned(language, source)
        lines = [(sc.line(at) + k, x, "comment") for at, c in sc.comments for k, x in enumerate(c.splitlines())]
    else:
        style = "prose" if language in ("markdown", "text") else "marked"
        lines = [(n, x, style) for n, x in enumerate(source.splitlines(), 1) if len(x) <= K.MAX_MARKED_LINE and "\x00" not in x]
    return [{"line": n, "text": x, "style": style} for n, x, style in lines if any(t in x for t in tags)]


def _python_comments(source: str) -> list[tuple[int, str]]:
    out = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            if t.type == tokenize.COMMENT:
                out.append((t.start[0], t.string))
    except (tokenize.TokenError, IndentationError, SyntaxError):
        pass
    return out


# --- clone fingerprints ----------------------------------------------------------------------------------------------------

_LEX = re.compile(r"(?P<STR>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`)|(?P<NUM>\d[\w.]*)|(?P<ID>[A-Za-z_$][\w$]*)|(?P<OP>[^\s\w])")
_KEYWORDS = set("if else for while return class def function func switch case default break continue try catch except finally raise throw new import from export const let var public private static void int string bool true false null None True False nil in not and or is async await yield with as lambda type struct interface package go defer range".split())


def fingerprint(language: str, code: str) -> tuple[str, int]:
    """(hash, tokens): names, numbers and strings lose their spelling, comments are gone, adjacent strings are one."""
    if language == "python":
        code = re.sub(r"(?m)#[^\n]*$", "", code)
        code = re.sub(r"(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?''')", '""', code)
    else:
        code = re.sub(r"//[^\n]*|/\*[\s\S]*?\*/", "", code)
    out: list[str] = []
    for m in _LEX.finditer(code):
        k = m.lastgroup
        x = m[0] if k == "OP" else "LIT" if m[0] in ("true", "false", "null", "None", "True", "False", "nil") else m[0] if m[0] in _KEYWORDS else k
        if x == "STR" and out and out[-1] == "STR":
            continue
        out.append(x)
    return hashlib.sha1(" ".join(out).encode()).hexdigest()[:16], len(out)


# --- all facts of a file -------------------------------------------------------------------------------------------------------

EMPTY = {"symbols": [], "calls": [], "imports": [], "env": [], "namespace": None, "error": None}


def facts_of(path: str, language: str, source: str) -> dict:
    """Facts of one file; a file the scanner cannot read has only an error."""
    try:
        if language == "python":
            p = _Python(path, source)
            return {"symbols": p.symbols, "calls": p.calls, "imports": p.imports, "env": p.env, "namespace": None, "error": None, "scanned": None}
        if language in _DEFS:
            return _scan(language, source) | {"error": None}
        return EMPTY | {"scanned": None}
    except (SyntaxError, ValueError, RecursionError, IndexError) as e:
        return EMPTY | {"error": f"{type(e).__name__}: {e}"[:300], "scanned": None}


_SYMBOL = "struct<name:string,qualified_name:string,kind:string,owner:string,start_line:int,end_line:int,is_test:boolean,has_doc:boolean,signature:string,norm_hash:string,token_count:int>"
SCHEMA = (
    f"repo_id string, file_path string, language string, namespace string, error string, symbols array<{_SYMBOL}>, calls array<struct<from:string,owner:string,to:string,receiver:string,kind:string,line:int>>, "
    "imports array<struct<module:string,names:array<string>,alias:string,line:int>>, env array<struct<name:string,line:int,default_value:string,has_default:boolean,required:boolean,source:string>>, "
    "notes array<struct<line:int,text:string,style:string>>"
)


def extract(files: DataFrame, tags: tuple[str, ...] = tuple(K.DEBT_TAGS)) -> DataFrame:
    """One row of facts per file of (repo_id, path, content); ``explode`` the arrays for tables of one kind."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for repo, path, text in pdf[["repo_id", "path", "content"]].itertuples(index=False):
                lang = language_of(path)
                f = facts_of(path, lang, text)
                lines = text.splitlines()
                symbols = []
                for s in f["symbols"]:
                    h, n = fingerprint(lang, "\n".join(lines[s["start_line"] - 1 : s["end_line"]])) if s["kind"] != "class" else (None, None)
                    symbols.append(s | {"norm_hash": h if n and n >= K.MIN_TOKENS else None, "token_count": n})
                classes = sorted((x["qualified_name"] for x in f["symbols"] if x["kind"] == "class"), key=len, reverse=True)
                by_name = {x["qualified_name"]: x["owner"] for x in f["symbols"]}
                calls = [k | {"owner": by_name.get(k["from"]) or next((q for q in classes if k["from"] and f"{k['from']}.".startswith(q + ".")), None)} for k in f["calls"]]
                rows.append((repo, path, lang, f["namespace"], f["error"], symbols, calls, f["imports"], f["env"], _notes(lang, text, tags, f.get("scanned"))))
            yield pd.DataFrame(rows, columns=["repo_id", "file_path", "language", "namespace", "error", "symbols", "calls", "imports", "env", "notes"])

    return spread(files.filter(F.col("content").isNotNull()).select("repo_id", "path", "content")).mapInPandas(run, SCHEMA)


def symbols_table(facts: DataFrame) -> DataFrame:
    """Symbols with ids that do not change between runs: a hash of repository, file, name, kind, line and position."""
    d = facts.select("repo_id", "file_path", "language", F.posexplode("symbols").alias("ordinal", "s")).select("repo_id", "file_path", "language", "ordinal", "s.*")
    return d.withColumn("id", F.xxhash64("repo_id", "file_path", "qualified_name", "kind", "start_line", "ordinal"))


def calls_table(facts: DataFrame) -> DataFrame:
    d = facts.select("repo_id", "file_path", "language", F.posexplode("calls").alias("seq", "c"))
    return d.select("repo_id", "file_path", "language", "seq", F.col("c.from").alias("from_name"), F.col("c.owner").alias("from_owner"), F.col("c.to").alias("to_name"), "c.receiver", "c.kind", "c.line")


def imports_table(facts: DataFrame) -> DataFrame:
    return facts.select("repo_id", "file_path", "language", F.posexplode("imports").alias("seq", "i")).select("repo_id", "file_path", "language", "seq", "i.*")


def enclosing(items: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds ``symbol_id``: the innermost symbol of the file whose lines hold the item's line, ties by position."""
    s = symbols.select("repo_id", "file_path", F.col("id").alias("symbol_id"), "start_line", "end_line", "ordinal")
    i = items.withColumn("_k", F.monotonically_increasing_id())
    j = i.select("_k", "repo_id", "file_path", "line").join(s, ["repo_id", "file_path"]).filter("line between start_line and end_line")
    best = j.groupBy("_k").agg(F.min_by("symbol_id", F.struct(F.col("end_line") - F.col("start_line"), "ordinal")).alias("symbol_id"))
    return i.join(best, "_k", "left").drop("_k")


def env_table(facts: DataFrame) -> DataFrame:
    from cairn.functions import text as T

    d = facts.select("repo_id", "file_path", "language", F.explode("env").alias("e")).select("repo_id", "file_path", "language", "e.*")
    secret = T.is_secret(F.col("name"), F.col("default_value"))
    return d.withColumn("is_secret", secret).withColumn("default_value", F.when(~secret, F.col("default_value")))


def debt_table(facts: DataFrame, tags: tuple[str, ...] = tuple(K.DEBT_TAGS)) -> DataFrame:
    """(repo_id, file_path, tag, text, line, assignee): the notes that begin with a tag, as far as their style allows.

    A longer tag goes before a shorter one; ends of block comments are cut off, texts kept to ``K.MAX_DEBT_TEXT``."""
    n = facts.select("repo_id", "file_path", F.inline("notes"))
    words = "|".join(re.escape(t) for t in sorted(tags, key=len, reverse=True))

    def group(k: int):
        out = F.lit("")
        for style, (lead, sign) in K.DEBT_STYLES.items():
            pattern = f"{lead}({words})\\b(?:\\(([^)\\n]*)\\))?{sign}(.*)$"
            out = F.when(F.col("style") == style, F.regexp_extract("text", pattern, k)).otherwise(out)
        return out

    note = F.substring(F.trim(F.regexp_replace(group(3), r"(\*/|-->)\s*$", "")), 1, K.MAX_DEBT_TEXT)
    who = F.nullif(F.trim(group(2)), F.lit(""))
    return n.select("repo_id", "file_path", group(1).alias("tag"), note.alias("note"), "line", who.alias("assignee")).filter("tag <> ''").withColumnRenamed("note", "text")
