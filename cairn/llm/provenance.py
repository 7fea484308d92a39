"""Generated, minified, vendored and data-only source files: belief propagation over directory trees.

Every file has evidence for each of the labels handwritten, generated, minified, vendored and blob, from its name and its
text; every directory has some from its name. The variables of a repository form a tree (directory to sub-directory,
directory to file) with compatibilities on its edges: what lies below a vendored directory is mostly vendored, files of a
directory of generated stubs mostly generated, while an ordinary directory says little. Sum-product on a tree is exact in
two passes: messages go up level by level, summed per directory before they are shuffled on, and come down again. Siblings
speak to each other through their directory. A file whose handwritten probability is below ``THRESHOLD`` is taken out.

Edges hold conditional probabilities, evidence only likelihood ratios, so a directory without any says nothing to either
side. Messages are five numbers a directory, summed by the JVM and turned around in Arrow batches.

Defined cases: a file without text is judged by its path alone; files that do not parse keep a label but are no case;
null repositories or paths have no row; repeated rows of a file count once.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cairn.llm.common import map_batches
from cairn.llm.syntax import EXTENSIONS, confirmed, reader
from cairn.session import cut

LABELS = ["handwritten", "generated", "minified", "vendored", "blob"]
SOURCE = ("py", "js", "ts", "go", "java", "cs")
THRESHOLD = 0.5

#: Directory names and file names that tell of an origin.
VENDOR_DIRS = "vendor vendors vendored _vendor third_party third-party thirdparty 3rdparty 3rd_party extern external externals pods carthage node_modules bower_components jspm_packages deps site-packages godeps".split()
GENERATED_DIRS = "gen generated autogen stubs __generated__ gen-src generated-sources".split()
MINIFIED_DIRS = "dist min build bundles".split()
_VERSIONED = r"^[a-z][\w.-]*-v?\d+(\.\d+)+$"
_GEN_NAME = re.compile(r"(?i)(_pb2(_grpc)?\.pyi?|\.pb\.(go|cc|h|ts|js)|[._-]gen(erated)?\.\w+|_generated\.\w+|\.g\.(cs|ts|dart)|\.designer\.cs|_grpc\.\w+|zz_generated\w*\.go|_string\.go)$")
_MIN_NAME = re.compile(r"(?i)([.-]min\.\w+|[.-]bundle\.\w+|\.prod\.js|\.chunk\.js)$")
_COMMENT = re.compile(r"(?m)^[ \t]*(?://+!?|#+|/\*+!?|\*+|--|<!--|\"\"\"|''')[ \t]*(.*)$")
_GEN_TEXT = re.compile(
    r"(?i)code generated by|sourcemappingurl=|@generated\b|\bauto-?generated\b|\bautogenerated\b|<auto-generated|generated (?:from|by) \S+.*(?:do not|don't|nicht|on build|automatically)|machine output of|output of the \S+ (?:compiler|generator|tool)\b|automatically (?:created|generated|produced)|do not (?:edit|modify)(?:\s*(?:!|\.|$|by hand|manually|this file|directly))|(?:erzeugt|generiert) von .*nicht|g[ée]n[ée]r[ée] (?:par|automatiquement)|generado (?:por|autom)|gerado (?:por|autom)|generato (?:da|autom)|gegenereerd door|manual changes (?:are|will be) lost"
)
_VENDOR_TEXT = re.compile(r"(?i)\bvendored\b|copied (?:unchanged|verbatim|unmodified)? ?from the .*project|bundled copy|in sync with upstream|upstream fixes only|local edits forbidden|\bv\d+\.\d+(?:\.\d+)?\s*\|\s*\(c\)\s*\d{4}|(?:imported|forked|taken) from https?://")
_BLOCK = re.compile(r"(?sm)^[ \t]*(?:/\*.*?(?:\*/|\Z)|[rRuU]?\"{3}.*?(?:\"{3}|\Z)|[rRuU]?'{3}.*?(?:'{3}|\Z))")
_FILLED = re.compile(r"(?m)^.*\S")
#: Log likelihood ratio of a notice of origin, and the lines of code before it up to which it counts in full.
NOTICE, NOTICE_LINES = 6.7, 40
_NUMBERED = re.compile(r"(?m)^[^\d\n]*[A-Za-z_](\d{1,5})\b")
_NINE = re.compile(r"9(?<=[A-Za-z_]9)\b")
_TELLING = ("generat", "@gen", "output", "erzeugt", "do not", "automatic", "manual changes", "gegenereerd", "vendored", "copied", "bundled", "upstream", "forbidden", "(c)", "imported from", "forked from", "taken from", "sourcemappingurl")
_LONG = re.compile(r"[\"'][A-Za-z0-9+/=\\]{40,}[\"']")
_DATA = re.compile(r"(?:0[xX][0-9a-fA-F]+|\b\d+\b)\s*,|\"[A-Za-z0-9+/=\\x]{40,}\"\s*[,+]?|'[A-Za-z0-9+/=\\x]{40,}'\s*[,+]?")


def _code_lines(text: str) -> list[int]:
    """Where the lines begin that hold more than comments."""
    for rx in (_BLOCK, _COMMENT):
        text = rx.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    return [m.start() for m in _FILLED.finditer(text)]


def text_evidence(path: str, text: str | None) -> list[float]:
    """Log likelihood ratios of the name and the text of a file; a plain text speaks against all but handwritten, least so
    against a copy."""
    hand, gen, mini, vend, blob = (0.0, -3.0, -6.0, -0.7, -8.0) if text else (0.0, 0.0, 0.0, 0.0, 0.0)
    name = path.rsplit("/", 1)[-1]
    if _GEN_NAME.search(name):
        gen += 10
    if _MIN_NAME.search(name):
        mini += 15
    if not text:
        return [hand, gen, mini, vend, blob]
    low = text.lower()
    if any(k in low for k in _TELLING):
        code: list[int] | None = None
        for m in _COMMENT.finditer(text):
            line = m[1]
            if _GEN_TEXT.search(line):
                gen += 9
            if _VENDOR_TEXT.search(line):  # the more code stands before it, the less it speaks of the file as a whole
                code = _code_lines(text) if code is None else code
                vend += NOTICE * min(1.0, NOTICE_LINES / max(1, bisect_left(code, m.start())))
    run = best = 0
    last = -1
    for x in map(int, _NUMBERED.findall(text) if _NINE.search(text) else ()):  # members numbered 0, 1, 2, ... one after the other
        if x == last + 1 and (run or x <= 1):
            run += 1
            if run > best:
                best = run
        elif x != last:
            run = int(x <= 1)
        last = x
    lines = text.splitlines()
    if best >= 10 and best >= 0.22 * len(lines):
        gen += 9
    body = len(text) - len(lines)
    if body > 400 and (sum(map(text.count, "0123456789")) > 0.2 * body or len(_LONG.findall(text)) > 4) and sum(len(m[0]) for m in _DATA.finditer(text)) > 0.6 * sum(len(x.strip()) for x in lines):
        blob += 15
    elif body > 200 and max(map(len, lines), default=0) > 250:
        dense = sum(len(x) for x in lines if len(x) > 250 and x.count(" ") < 0.12 * len(x) and sum(x.count(c) for c in ";{}(),=") > 0.08 * len(x))
        if dense > 0.5 * body or (dense and text.count(" ") + len(lines) < 0.1 * len(text)):
            mini += 13
    return [hand, gen, mini, vend, blob]


def _work(b: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for path, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
        lang = EXTENSIONS[path.rsplit(".", 1)[1].lower()]
        parses = text is None or reader(lang).parses(text) or not confirmed(lang, text)
        rows.append((parses, *text_evidence(path, text)))
    cols = list(zip(*rows)) or [()] * 6
    kinds = [pa.bool_(), *[pa.float64()] * 5]
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["repo_id", "path", "parses", *_U])


_U = [f"u{k}" for k in range(5)]
_A = [f"a{k}" for k in range(5)]
#: P(label of a file | label of its directory) and P(label of a sub-directory | label of its directory).
_FILE = np.log([[0.90, 0.03, 0.02, 0.04, 0.01], [0.10, 0.87, 0.01, 0.01, 0.01], [0.50, 0.04, 0.44, 0.01, 0.01], [0.0004, 0.0002, 0.0002, 0.999, 0.0002], [0.30, 0.05, 0.03, 0.02, 0.60]])
_DIR = np.log([[0.992, 0.002, 0.004, 0.001, 0.001], [0.18, 0.80, 0.01, 0.005, 0.005], [0.25, 0.01, 0.73, 0.005, 0.005], [0.0005, 0.0005, 0.0005, 0.998, 0.0005], [0.40, 0.02, 0.02, 0.01, 0.55]])
_ROOT = np.log([0.96, 0.01, 0.01, 0.01, 0.01])
_NAMES = [(set(VENDOR_DIRS), [0.0, 0.0, 0.0, 11.0, 0.0]), (set(GENERATED_DIRS), [0.0, 7.0, 0.0, 0.0, 0.0]), (set(MINIFIED_DIRS), [0.0, 0.0, 3.0, 0.0, 0.0])]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def message_up(x: np.ndarray, given: np.ndarray) -> np.ndarray:
    """From children with log evidence ``x`` (n, 5) to their directories, up to a constant."""
    m = _lse(x[:, None, :] + given[None], 2)
    return m - m[:, :1]


def message_down(x: np.ndarray, given: np.ndarray) -> np.ndarray:
    """From directories with log belief ``x`` (n, 5), the receiver's own message taken out, to their children."""
    m = _lse(x[:, :, None] + given[None], 1)
    return m - m[:, :1]


def dir_evidence(path: str) -> np.ndarray:
    name = path.rsplit("/", 1)[-1].lower()
    out = np.zeros(5)
    for names, e in _NAMES:
        if name in names:
            out += e
    if re.match(_VERSIONED, name):
        out[3] += 4
    return out


def _columns(b: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([np.asarray(b.column(n), dtype=float) for n in names], axis=1) if b.num_rows else np.zeros((0, len(names)))


def _batch(b: pa.RecordBatch, keep: list[str], new: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *(pa.array(v) for v in new.values())], [*keep, *new])


def file_evidence(files: DataFrame, raw_files: DataFrame) -> DataFrame:
    """One row per source file of ``files``: parses, u0..u4."""
    known = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(list(SOURCE))
    raw = raw_files.select("repo_id", "path", "content").filter(known)
    got = map_batches(raw, _work, "repo_id string, path string, parses boolean, " + ", ".join(f"{u} double" for u in _U)).dropDuplicates(["repo_id", "path"])
    f = files.select("repo_id", "path").dropna().filter(known).distinct()
    d = f.join(got, ["repo_id", "path"], "left")
    bare = [F.lit(0.0), F.when(F.col("path").rlike(_GEN_NAME.pattern), 7.0).otherwise(0.0), F.when(F.col("path").rlike(_MIN_NAME.pattern), 9.0).otherwise(0.0), F.lit(0.0), F.lit(0.0)]
    return d.select("repo_id", "path", F.coalesce("parses", F.lit(True)).alias("parses"), *(F.coalesce(u, b).alias(u) for u, b in zip(_U, bare)))


def _parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def _depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


_B = [f"b{k}" for k in range(5)]
_I = [f"i{k}" for k in range(5)]
_M = [f"m{k}" for k in range(5)]


def _doubles(names: list[str]) -> str:
    return ", ".join(f"{n} double" for n in names)


def _sums(d: DataFrame) -> DataFrame:
    return d.groupBy("repo_id", "dir").agg(*(F.sum(a).alias(a) for a in _A))


def label_files(files: DataFrame, raw_files: DataFrame) -> DataFrame:
    """(repo_id, path, parses, label, p_handwritten) of every source file, by belief propagation."""
    f = file_evidence(files, raw_files).withColumn("dir", _parent(F.col("path")))

    def to_dirs(b: pa.RecordBatch) -> pa.RecordBatch:
        m = message_up(_columns(b, _U), _FILE)
        return _batch(b, ["repo_id", "path", "parses", *_U, "dir"], {a: m[:, k] for k, a in enumerate(_A)})

    kinds = f"repo_id string, path string, parses boolean, {_doubles(_U)}, dir string, {_doubles(_A)}"
    f = cut(map_batches(f, to_dirs, kinds))
    from_files = cut(_sums(f).withColumn("depth", _depth(F.col("dir"))))
    deepest = from_files.agg(F.max("depth")).first()[0]
    if deepest is None:
        return f.select("repo_id", "path", "parses", F.lit(LABELS[0]).alias("label"), F.lit(1.0).alias("p_handwritten"))

    def upward(b: pa.RecordBatch) -> pa.RecordBatch:
        e = np.array([dir_evidence(p) for p in b.column("dir").to_pylist()]).reshape(-1, 5)
        m = message_up(_columns(b, _A) + e, _DIR)
        return _batch(b, ["repo_id", "dir"], {x: m[:, k] for k, x in enumerate(_M)})

    own_schema = f"repo_id string, dir string, {_doubles(_M)}"
    levels: dict[int, DataFrame] = {}
    messages: dict[int, DataFrame] = {}
    for d in range(deepest, -1, -1):
        own = from_files.filter(F.col("depth") == d).select("repo_id", "dir", *_A)
        if d < deepest:
            own = _sums(own.unionByName(messages[d + 1].select("repo_id", _parent(F.col("dir")).alias("dir"), *(F.col(m).alias(a) for m, a in zip(_M, _A)))))
        levels[d] = cut(own)
        if d:
            messages[d] = cut(map_batches(levels[d], upward, own_schema))

    def belief(b: pa.RecordBatch) -> pa.RecordBatch:
        e = np.array([dir_evidence(p) for p in b.column("dir").to_pylist()]).reshape(-1, 5)
        x = _columns(b, _A) + e + _columns(b, _I)
        return _batch(b, ["repo_id", "dir"], {n: x[:, k] for k, n in enumerate(_B)})

    def downward(b: pa.RecordBatch) -> pa.RecordBatch:
        x = message_down(_columns(b, _B) - _columns(b, _M), _DIR)
        return _batch(b, ["repo_id", "dir"], {n: x[:, k] for k, n in enumerate(_I)})

    inward = levels[0].select("repo_id", "dir", *_A, *(F.lit(float(v)).alias(i) for v, i in zip(_ROOT, _I)))
    beliefs: DataFrame | None = None
    for d in range(deepest + 1):
        here = cut(map_batches(inward, belief, f"repo_id string, dir string, {_doubles(_B)}"))
        beliefs = here if beliefs is None else beliefs.unionByName(here)
        if d < deepest:
            child = messages[d + 1].withColumn("p_dir", _parent(F.col("dir")))
            heard = map_batches(child.join(here.withColumnRenamed("dir", "p_dir"), ["repo_id", "p_dir"]).select("repo_id", "dir", *_B, *_M), downward, f"repo_id string, dir string, {_doubles(_I)}")
            inward = levels[d + 1].join(heard, ["repo_id", "dir"])

    def final(b: pa.RecordBatch) -> pa.RecordBatch:
        u = _columns(b, _U)
        x = u + message_down(_columns(b, _B) - _columns(b, _A), _FILE)
        p = np.exp(x - x.max(axis=1, keepdims=True)) if len(x) else x
        p = p / p.sum(axis=1, keepdims=True) if len(x) else p
        names = pa.array([LABELS[k] for k in (p.argmax(axis=1) if len(p) else [])], pa.string())
        return pa.RecordBatch.from_arrays([b.column("repo_id"), b.column("path"), b.column("parses"), names, pa.array(p[:, 0], pa.float64())], ["repo_id", "path", "parses", "label", "p_handwritten"])

    j = f.join(beliefs, ["repo_id", "dir"]).select("repo_id", "path", "parses", *_U, *_A, *_B)
    return map_batches(j, final, "repo_id string, path string, parses boolean, label string, p_handwritten double")


def not_handwritten(files: DataFrame, raw_files: DataFrame) -> DataFrame:
    """Files that parse and that somebody else, a tool or a dump wrote."""
    return label_files(files, raw_files).filter(F.col("parses") & (F.col("p_handwritten") < THRESHOLD)).select("repo_id", "path")
