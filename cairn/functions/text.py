"""Scalar functions as Column expressions: identifiers, paths, names, labels and small text formats.

All are pure JVM expressions. Null inputs give null, unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cairn.functions import constants as K

_CAMEL = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
#: Line ends as text editors and parsers know them.
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def _strings(*values: str) -> Column:
    return F.array(*(F.lit(v) for v in values))


# --- identifiers and search terms ---------------------------------------------------------------------------------


def split_identifier(word: Column) -> Column:
    """getUserName, get_user_name -> [get, user, name]."""
    return F.transform(F.regexp_extract_all(word, F.lit(_CAMEL), F.lit(0)), F.lower)


def search_tokens(text: Column) -> Column:
    """Every identifier in lower case, followed by its parts when it has several."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))

    def one(w: Column) -> Column:
        # an array of one array binds the parts to a variable, so that they are worked out once
        return F.transform(F.array(split_identifier(w)), lambda parts: F.when(F.size(parts) > 1, F.concat(F.array(F.lower(w)), parts)).otherwise(F.array(F.lower(w))))[0]

    return F.flatten(F.transform(words, one))


def index_tokens(text: Column) -> Column:
    """``search_tokens`` as the index holds them: an underscore separates, so snake-case words are several tokens."""
    return F.filter(F.split(F.array_join(search_tokens(text), " "), "[ _]+"), lambda x: x != "")


def query_terms(question: Column) -> Column:
    """Distinct search tokens without stop words, in order; an empty array where none is left."""
    return F.filter(F.array_distinct(search_tokens(question)), lambda t: ~t.isin(K.STOPWORDS) & (F.regexp_replace(t, "_", "") != ""))


def query_string(question: Column) -> Column:
    """Quoted terms joined with OR; null where none is left."""
    t = query_terms(question)
    return F.when(F.size(t) > 0, F.array_join(F.transform(t, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " OR "))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def rrf(rank: Column, k: int = K.RRF_K) -> Column:
    return F.lit(1.0) / (F.lit(float(k)) + rank)


def subsequence(needle: str, hay: Column) -> Column:
    """The letters of ``needle`` appear in ``hay`` in order."""
    return hay.rlike("(?s)" + ".*".join("\\" + c if not c.isalnum() else c for c in needle))


def name_score(needle: str, name: Column, qualified: Column) -> Column:
    """100 equal, 80/70 begins, 60/50 contains, 30 letters in order (3 or more), 1 for an empty needle, else null."""
    n = needle.strip().lower()
    if not n:
        return F.lit(1)
    a, b = F.lower(name), F.lower(qualified)
    s = F.when((a == n) | (b == n), 100).when(a.startswith(n), 80).when(b.startswith(n), 70).when(a.contains(n), 60).when(b.contains(n), 50)
    return s.when(subsequence(n, b), 30) if len(n) >= 3 else s


# --- vectors --------------------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))


def hash_buckets(text: Column, size: int = 256) -> Column:
    """Bucket of every token of the hashing embedder: each word in lower case and its parts, md5 modulo 256."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    tokens = F.flatten(F.transform(words, lambda w: F.concat(F.array(F.lower(w)), split_identifier(w))))
    return F.transform(tokens, lambda t: F.pmod(F.conv(F.right(F.md5(t), F.lit(4)), 16, 10).cast("int"), F.lit(size)))


def hash_embedding(text: Column, size: int = 256) -> Column:
    """Token counts by bucket, of unit length."""
    b = hash_buckets(text, size)
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(b, lambda x: x == i)).cast("double"))
    return l2_normalise(counts)


# --- paths ----------------------------------------------------------------------------------------------------------


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^./]+)$", 1))


def language(path: Column) -> Column:
    """By extension; 'text' for unknown ones."""
    m = F.create_map(*(F.lit(x) for kv in (K.GRAMMAR_LANGUAGES | K.OTHER_LANGUAGES).items() for x in kv))
    return F.when(path.isNotNull(), F.coalesce(m[suffix(path)], F.lit("text")))


def _folders(path: Column) -> Column:
    p = F.split(path, "/")
    return F.slice(p, 1, F.size(p) - 1)


def dir_of(path: Column) -> Column:
    return F.array_join(_folders(path), "/")


def folder_of(path: Column, depth: int = 2) -> Column:
    f = _folders(path)
    return F.when(F.size(f) == 0, F.lit("(root)")).otherwise(F.array_join(F.slice(f, 1, depth), "/"))


def module_of(path: Column) -> Column:
    p = F.split(path, "/")
    return F.when(F.size(p) > 1, p[0]).otherwise(F.lit("(root)"))


def key_at(path: Column, depth: int) -> Column:
    """The first ``depth`` folders of a path, '(root)' for a file at the top."""
    return folder_of(path, depth)


def in_scope(path: Column, scope: str) -> Column:
    return (path == scope) | path.startswith(scope + "/") if scope else F.lit(True)


def scopes(path: Column, depth: int = 3) -> Column:
    """Folder prefixes of a path, up to ``depth``."""
    f = _folders(path)
    return F.transform(F.sequence(F.lit(1), F.least(F.size(f), F.lit(depth))), lambda i: F.array_join(F.slice(f, 1, i), "/"))


def dotted_suffixes(path: Column, package_file: str = "__init__") -> Column:
    """src/app/util.py -> [util, app.util, src.app.util]; a package file stands for its folder."""
    p = F.split(F.regexp_replace(path, r"\.[^./]*$", ""), "/")
    p = F.when(F.element_at(p, -1) == package_file, F.slice(p, 1, F.size(p) - 1)).otherwise(p)
    return F.when(F.size(p) > 0, F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, F.size(p) - i + 1, i), "."))).otherwise(F.array().cast("array<string>"))


def is_test_path(path: Column) -> Column:
    return F.arrays_overlap(F.transform(_folders(path), F.lower), _strings(*K.TEST_DIRS)) | file_name(path).rlike(K.TEST_FILE)


def is_vendored_path(path: Column) -> Column:
    return F.arrays_overlap(F.transform(_folders(path), F.lower), _strings(*K.VENDORED_DIRS))


def is_test_symbol(lang: Column, name: Column, kind: Column, annotations: Column) -> Column:
    marked = F.arrays_overlap(annotations, _strings(*K.TEST_ANNOTATIONS)) | ((kind == "class") & F.arrays_overlap(annotations, _strings(*K.TEST_CLASS_ATTRIBUTES)))
    return (
        F.when(lang == "python", name.startswith("test") | ((kind == "class") & name.startswith("Test")))
        .when(lang == "go", name.rlike(K.GO_TEST))
        .when(lang.isin("java", "csharp"), F.coalesce(marked, F.lit(False)))
        .otherwise(F.lit(False))
    )


def is_dotenv_path(path: Column) -> Column:
    n = F.lower(file_name(path))
    return n.startswith(".env") | n.endswith(".env")


def is_secret_name(name: Column) -> Column:
    spaced = F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", "_")
    tokens = F.filter(F.transform(F.split(spaced, "[^A-Za-z0-9]+"), F.upper), lambda t: t != "")
    looks = F.arrays_overlap(tokens, _strings(*K.SECRET_TOKENS)) | F.regexp_replace(F.upper(name), "_", "").contains("APIKEY")
    return looks & ~F.arrays_overlap(tokens, _strings(*K.BENIGN_TOKENS))


def is_secret(name: Column, default: Column) -> Column:
    return is_secret_name(name) | F.coalesce(default.rlike(K.CREDENTIAL_URL), F.lit(False))


# --- routes ---------------------------------------------------------------------------------------------------------


def join_paths(parts: Column) -> Column:
    """Array of path parts -> one path with single slashes; a slash at the end of the last non-empty part stays."""
    parts = F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != "")
    bare = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, "^/+|/+$", "")), lambda p: p != "")
    joined = F.concat(F.lit("/"), F.array_join(bare, "/"))
    open_end = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")).endswith("/") & (joined != "/")
    return F.when(open_end, F.concat(joined, F.lit("/"))).otherwise(joined)


def method_of(name: Column) -> Column:
    """HTTP verb in upper case; all and any become ANY, others null."""
    u = F.upper(name)
    return F.when(u.isin("ALL", "ANY"), F.lit("ANY")).when(u.isin([m for m in K.METHOD_ORDER if m not in ("WS", "ANY")]), u)


def last_segment(name: Column, separators: str = "[.:]+") -> Column:
    return F.element_at(F.split(name, separators), -1)


def split_pattern(pattern: Column) -> Column:
    """'GET /x' -> struct(method, path); a pattern without a verb is ANY."""
    verb = F.regexp_extract(pattern, r"^([A-Z]+)\s+(.*)$", 1)
    return F.struct(F.when(verb != "", verb).otherwise(F.lit("ANY")).alias("method"), F.when(verb != "", F.regexp_extract(pattern, r"^([A-Z]+)\s+(.*)$", 2)).otherwise(pattern).alias("path"))


def route_tokens(template: Column, controller: Column, action: Column) -> Column:
    return F.replace(F.replace(template, F.lit("[controller]"), controller), F.lit("[action]"), action)


def split_alias(imported: Column) -> Column:
    """'a as b' -> struct(name a, alias b); without one both are the name."""
    has = imported.contains(" as ")
    return F.struct(F.trim(F.split_part(imported, F.lit(" as "), F.lit(1))).alias("name"), F.when(has, F.trim(F.split_part(imported, F.lit(" as "), F.lit(2)))).otherwise(F.trim(imported)).alias("alias"))


# --- ages, confidences, keys --------------------------------------------------------------------------------------------


def age_days(now: Column, epoch: Column) -> Column:
    return (now - epoch) / 86400.0


def age_bucket(days: Column) -> Column:
    """Half-open ranges; negative ages count as the first one."""
    return F.when(days.isNull(), F.lit("Unknown age")).when(days < 30, F.lit("Last 30 days")).when(days < 180, F.lit("1 to 6 months")).when(days < 365, F.lit("6 to 12 months")).otherwise(F.lit("Over a year"))


def confidence_rank(c: Column) -> Column:
    return F.when(c == "high", 2).when(c == "medium", 1).otherwise(0)


def weakest(a: Column, b: Column) -> Column:
    return F.when(confidence_rank(a) <= confidence_rank(b), a).otherwise(b)


def params_key(similarity: Column, kind: Column, tests: Column, lines: Column) -> Column:
    return F.format_string("%.2f|%s|%s|%d", similarity, kind, F.when(tests, F.lit("True")).otherwise(F.lit("False")), lines)


def token_hash(tokens: Column) -> Column:
    return F.substring(F.sha1(F.array_join(tokens, " ")), 1, 16)


def public_id(repo: Column, chunk: Column) -> Column:
    return F.concat_ws("-", repo, chunk.cast("string"))


def parse_public_id(pid: Column) -> Column:
    return F.struct(F.regexp_extract(pid, "^(.*)-([^-]*)$", 1).alias("repo_id"), F.regexp_extract(pid, "^(.*)-([^-]*)$", 2).alias("chunk_id"))


# --- answers and labels -----------------------------------------------------------------------------------------------


def citations(answer: Column, n_sources: Column) -> Column:
    """Numbers cited as [1] or [1, 2], in order of first appearance, within 1..n_sources."""
    groups = F.regexp_extract_all(answer, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1))
    numbers = F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, r"\s*,\s*"), lambda x: x.try_cast("int"))))
    return F.array_distinct(F.filter(numbers, lambda x: (x >= 1) & (x <= n_sources)))


SPACE = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` knows the blank only)."""
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+$", "")


def strip_reasoning(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?s)<think>.*?(</think>|$)", ""))


def usable_summary(text: Column) -> Column:
    """The text without closed reasoning, if it is 2 to 8 plain sentences of at most 900 characters; else null."""
    t = strip(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))
    n = F.size(F.filter(F.split(t, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != ""))
    bad = t.contains("```") | t.contains("**") | t.rlike(r"(?m)^\s*(\d+[.)]|[-*•])\s")
    return F.when((n >= 2) & (n <= 8) & (F.length(t) <= 900) & ~bad, t)


def clean_label(raw: Column) -> Column:
    """First line of an answer as a label: at most 40 characters and 5 words, no brackets, capitalised; else null."""
    line = F.regexp_replace(F.split(strip(raw), LINE_END)[0], r"^[\"'`*. :-]+|[\"'`*. :-]+$", "")
    line = strip(F.regexp_replace(line, "^Label:", ""))
    fine = (line != "") & (F.length(line) <= 40) & (F.size(F.split(line, r"\s+")) <= 5) & ~line.rlike(r"[{}\[\]<>]")
    return F.when(fine, F.concat(F.upper(F.substring(line, 1, 1)), F.substring(line, 2, 100)))


def mermaid_label(text: Column, limit: int = 44) -> Column:
    """White space collapsed, the tail kept with an ellipsis, the characters Mermaid reads escaped; '?' if empty."""
    t = strip(F.regexp_replace(text, f"(?U){SPACE}+", " "))
    t = F.when(F.length(t) > limit, F.concat(F.lit("…"), F.right(t, F.lit(limit - 1)))).otherwise(t)
    t = F.replace(t, F.lit("%%"), F.lit("%"))
    for c, e in (("#", "#35;"), ('"', "#quot;"), ("<", "#lt;"), (">", "#gt;"), ("&", "#amp;"), ("|", "#124;")):
        t = F.replace(t, F.lit(c), F.lit(e))
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit("?")).otherwise(t)


def mermaid_message(text: Column) -> Column:
    return mermaid_label(F.replace(text, F.lit(";"), F.lit(",")), 60)


def quote_env(value: Column) -> Column:
    """Quoted for a dotenv file where it has white space, quotes or characters a shell reads."""
    q = F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(value.rlike(r"[\s\"'#$\\]"), q).otherwise(value)


def line_ending(text: Column) -> Column:
    """CRLF where most line ends are, else LF."""
    crlf = F.regexp_count(text, F.lit("\\r\\n"))
    return F.when(crlf * 2 > F.regexp_count(text, F.lit("\\n")), F.lit("\r\n")).otherwise(F.lit("\n"))


def lines_of(text: Column) -> Column:
    """Lines of a text; the empty tail after a final line end is none."""
    s = F.split(text, LINE_END)
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(s, -1) == "", F.slice(s, 1, F.size(s) - 1)).otherwise(s)


def embedding_header(path: Column, symbol: Column, lang: Column, context: Column, content: Column) -> Column:
    """The text an embedder sees: a comment with path and symbol, the context if any, then the content."""
    mark = F.when(F.coalesce(lang, F.lit("text")).isin("python", "text", "markdown", "yaml"), F.lit("#")).otherwise(F.lit("//"))
    head = F.concat(mark, F.lit(" "), path, F.when(F.coalesce(symbol, F.lit("")) != "", F.concat(F.lit(" :: "), symbol)).otherwise(F.lit("")))
    return F.concat(head, F.lit("\n"), F.when(F.coalesce(context, F.lit("")) != "", F.concat(context, F.lit("\n"))).otherwise(F.lit("")), content)


def context_block(n: Column, path: Column, start: Column, end: Column, symbol: Column, lang: Column, content: Column) -> Column:
    """'[n] path:start-end (symbol)' and the content in a fence."""
    sym = F.when(F.coalesce(symbol, F.lit("")) != "", F.concat(F.lit(" ("), symbol, F.lit(")"))).otherwise(F.lit(""))
    return F.concat(F.lit("["), n.cast("string"), F.lit("] "), path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), sym, F.lit("\n```"), F.coalesce(lang, F.lit("")), F.lit("\n"), content, F.lit("\n```"))


def gist(text: Column, limit: int = 600) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(" ..."))).otherwise(text)


def sentence(text: Column) -> Column:
    return F.when(text.rlike(r"[.!?]$") | (text == ""), text).otherwise(F.concat(text, F.lit(".")))


def create_title(text: Column) -> Column:
    return F.substring(text, 1, 80)


def rename_title(text: Column) -> Column:
    return F.substring(strip(text), 1, 120)
