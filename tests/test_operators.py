import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.operators import chunking, clones, conversations, diagrams, docs, extract, graph, index, listings, pair_blocks, resolve, routes, search
from cairn.session import ensure_checkpoint_dir
from cairn.sources import repository
from cairn.streaming import indexing

RAW = "repo_id string, path string, content string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- chunks and search -------------------------------------------------------------------------------------------------------


def test_line_windows(spark):
    text = "\n".join(str(i) for i in range(130)) + "\n"
    df = spark.createDataFrame([("r", "a.txt", text), ("r", "b", ""), ("r", "c", None), ("r", "d", "\n \n")], RAW)
    assert [(r.path, r.start_line, r.end_line) for r in chunking.line_windows(df, ["repo_id", "path"]).orderBy("path", "part").collect()] == [("a.txt", 1, 60), ("a.txt", 51, 110), ("a.txt", 101, 130)]


def test_structure_chunks_cover_and_split_a_class(spark):
    body = "".join(f"    def m{i}(self):\n" + "        x = 1  # some words here\n" * 20 + "\n" for i in range(6))
    df = spark.createDataFrame([("r", "a.py", f"import os\n\nclass Big:\n    z = 1\n\n{body}\ndef last():\n    return 1\n")], RAW)
    got = chunking.structure_chunks(df).orderBy("start_line").collect()
    assert any(r.context and r.context.startswith("class Big") for r in got)
    assert got[0].start_line == 1 and "last" in (got[-1].symbol_name or "")


CHUNK = "id bigint, file_path string, symbol_name string, language string, content string, rank int"


def corpus(spark):
    rng = random.Random(1)
    words = "get_user_name getUserName parse token user name cache index lookup".split()
    data = [(i, f"f{i}.py", None, "python", " ".join(rng.choices(words, k=rng.randrange(1, 15))), 0) for i in range(40)]
    return spark.createDataFrame([*data, (100, "n.py", None, None, None, 0), data[0]], CHUNK)


def test_phrases_agree_between_postings_and_scan(spark):
    d = search.documents_of(corpus(spark))
    terms = search.terms_of("get_user_name cache getUserName")
    a = {(r.chunk_id, r.term): r.tf for r in search.term_matches(d, terms).collect()}
    b = {(r.chunk_id, r.term): r.tf for r in search.phrase_matches(search.postings(d), terms).collect()}
    assert a == b and any(t == "get_user_name" for _, t in a)


def test_search_modes_and_gate(spark):
    c = corpus(spark)
    h = search.search(c, "get_user_name").collect()
    assert 0 < len(h) <= 6 and [r["rank"] for r in h] == list(range(1, len(h) + 1))
    v = search.search(c, "get_user_name", "vector").collect()
    assert all(abs(r.score - r.cosine) < 1e-4 for r in v)
    assert search.search(c, "what is this", "bm25").collect() == []
    with pytest.raises(ValueError):
        search.search(c, "x", "magic")
    empty = search.top(search.hashed_scores(c.limit(0), "x"))
    assert search.gate(empty).first().decision == "no_answer"


def test_fusion_keeps_the_vector_list_first(spark):
    def ranked(ids):
        return spark.createDataFrame([(x, k) for k, x in enumerate(ids, 1)], "chunk_id bigint, rank int")

    got = search.fuse([ranked([1, 2]), ranked([3, 2])]).orderBy(F.desc("score"), "first_list", "first_rank").collect()
    assert [r.chunk_id for r in got] == [2, 1, 3]


# --- graph ----------------------------------------------------------------------------------------------------------------------


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "call", "f", k, k, c) for k, (a, b, c) in enumerate(pairs)], graph.EDGE)


def test_traversal_of_a_ring_and_its_cap(spark):
    e = edges(spark, [(i, (i + 1) % 8, "high") for i in range(8)])
    t = graph.traverse(e, [0], 5)
    assert [r.node for r in t.hits.orderBy("pos").collect()] == [7, 6, 5, 4, 3] and not t.truncated
    t = graph.traverse(e, [0], 5, max_nodes=3)
    assert t.hits.count() == 3 and t.truncated


def test_traversal_keeps_the_first_found_edge_and_the_weakest_confidence(spark):
    e = edges(spark, [(2, 1, "low"), (2, 1, "high"), (3, 2, "high"), (1, 1, "high")])
    assert [(r.node, r.depth, r.confidence) for r in graph.traverse(e, [1], 3).hits.orderBy("pos").collect()] == [(2, 1, "low"), (3, 2, "low")]
    assert graph.traverse(e.limit(0), [1], 3).hits.count() == 0


def test_blast_radius(spark):
    h = spark.createDataFrame([(1, "high", False), (1, "medium", False), (2, "high", False), (3, "low", True)], "depth int, confidence string, is_test boolean")
    assert tuple(graph.blast_radius(h).first()) == (2.1, "Low")
    assert tuple(graph.blast_radius(h.limit(0)).first()) == (0.0, "Low")


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    for _ in range(2):
        e = {(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(18)}
        reach = {a: {b for x, b in e if x == a} for a in {x for p in e for x in p}}
        for _ in range(12):
            reach = {a: bs | {c for b in bs for c in reach[b]} for a, bs in reach.items()}
        want = {tuple(sorted(b for b in reach if b == a or (b in reach[a] and a in reach[b]))) for a in reach}
        got = {tuple(r.members) for r in graph.cycles(spark.createDataFrame(sorted(e), "src string, dst string")).collect()}
        assert got == {c for c in want if len(c) > 1}


def test_module_graph_and_collapse(spark):
    i = spark.createDataFrame([("a/b/x.py", "a/c/y.py"), ("a/b/x.py", "a/c/z.py"), ("a/b/x.py", "a/b/x.py"), ("q.py", None)], "file_path string, resolved_file_path string")
    g = graph.module_graph(i)
    assert rows(graph.module_graph(i, "dir")) == [("a/b", "a/c", 2)]
    assert rows(graph.collapse(g, depth=2)) == [("a/b", "a/c", 2)] and rows(graph.collapse(g, depth=1)) == []
    assert rows(graph.degrees(g)) == [("a/b/x.py", 2), ("a/c/y.py", 1), ("a/c/z.py", 1)]
    text, _ = diagrams.modules(g)
    assert text.startswith("flowchart LR\n") and text.count("-->") == 2


# --- clones ---------------------------------------------------------------------------------------------------------------------------


def test_linkage_does_not_chain(spark):
    assert clones.link_completely([(1, 2, 0.95), (2, 3, 0.95)], 0.9) == [[1, 2]]
    assert clones.link_completely([(1, 2, 0.95), (2, 3, 0.95), (1, 3, 0.92)], 0.9) == [[1, 2, 3]]
    clique = [(a, b, 0.95) for a in range(60) for b in range(a + 1, 60)]
    assert max(map(len, clones.link_completely(clique, 0.9))) == 40
    rng = random.Random(2)
    pairs = sorted({(min(a, b), max(a, b)): (min(a, b), max(a, b), rng.choice([0.91, 0.95, 0.99])) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(60)) if a != b}.values())
    got = clones.linkage_groups(spark.createDataFrame(pairs, "a bigint, b bigint, sim double"))
    assert sorted(r.members for r in got.collect()) == clones.link_completely(pairs, 0.9)


def test_exact_groups_and_overlaps(spark):
    s = spark.createDataFrame([(1, "a", 1, 9, "h"), (2, "b", 1, 9, "h"), (3, "c", 1, 20, "h"), (4, "c", 5, 9, "h"), (5, "d", 1, 9, "x")] + [(100 + i, f"z{i}", 1, 5, "big") for i in range(41)], "id bigint, file_path string, start_line int, end_line int, norm_hash string")
    g = clones.exact_groups(s).collect()
    assert [(r.norm_hash, [m.id for m in r.members], r.duplicated_lines, r.value) for r in g] == [("h", [1, 2], 9, 18.0)]


def test_topics(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.99, 0.1]), (2, [0.0, 1.0]), (3, None)], "id bigint, vector array<double>")
    assert rows(clones.cluster_vectors(v, 0.6)) == [(0, 0), (1, 0), (2, 1)]
    assert rows(clones.cluster_vectors(v, 0.6, exact_limit=0)) == [(0, 0), (1, 0), (2, 1)]
    items = spark.createDataFrame([(0, "fix the parser error"), (0, "parser error again"), (1, "the")], "cluster int, text string")
    assert rows(clones.keyword_labels(items)) == [(0, "Error parser again"), (1, "Miscellaneous")]


# --- facts -------------------------------------------------------------------------------------------------------------------------------

REPO = {
    "app/auth.py": 'class Store:\n    """Doc."""\n    def save(self):\n        return self.load()\n    def load(self):\n        return 1\n\ndef login(user):\n    # TODO(ann): check the user\n    return Store().save()\n',
    "app/main.py": "import os\nfrom app.auth import login as go\nfrom app import auth\n\nKEY = os.getenv('APP_KEY', 'x')\nLEVEL = os.environ['LEVEL']\n\ndef run():\n    go(1)\n    auth.login(2)\n    unknown.thing()\n",
    "web/a.ts": "import { b } from './b';\nexport function a(): void { b(process.env.PORT ?? '80'); }\n",
    "web/b.ts": "// FIXME: slow\nexport const b = (x: string) => { return x; }\n",
    "bad.py": "def (:\n",
    "notes.md": "- [ ] TODO: write more\n",
}


@pytest.fixture(scope="module")
def facts(spark):
    df = spark.createDataFrame([("r", p, t) for p, t in REPO.items()] + [("r", "none.py", None)], RAW)
    return extract.extract(df).cache()


def test_symbols_calls_env_and_debt(facts):
    s = {(r.file_path, r.qualified_name): r for r in extract.symbols_table(facts).collect()}
    assert set(s) == {("app/auth.py", x) for x in ("Store", "Store.save", "Store.load", "login")} | {("app/main.py", "run"), ("web/a.ts", "a"), ("web/b.ts", "b")}
    assert s["app/auth.py", "Store"].has_doc and s["app/auth.py", "Store.save"].kind == "method" and s["app/auth.py", "Store.save"].owner == "Store"
    e = {r.name: r for r in extract.env_table(facts).collect()}
    assert set(e) == {"APP_KEY", "LEVEL", "PORT"} and e["APP_KEY"].default_value is None and e["APP_KEY"].is_secret and e["LEVEL"].required and e["PORT"].default_value == "80"
    d = rows(extract.debt_table(facts).select("file_path", "tag", "text", "line", "assignee"))
    assert d == [("app/auth.py", "TODO", "check the user", 9, "ann"), ("notes.md", "TODO", "write more", 1, None), ("web/b.ts", "FIXME", "slow", 1, None)]
    assert facts.filter("error is not null").select("file_path").first()[0] == "bad.py"


def test_enclosing_symbol_is_the_innermost(facts):
    d = extract.enclosing(extract.debt_table(facts), extract.symbols_table(facts)).join(extract.symbols_table(facts).select("id", "qualified_name"), F.col("symbol_id") == F.col("id"))
    assert rows(d.select("qualified_name")) == [("login",)]


def test_imports_and_calls_resolve(facts):
    sym = extract.symbols_table(facts)
    t = resolve.resolve_imports(facts, extract.imports_table(facts))
    assert {(r.file_path, r.target, r.bind) for r in t.collect()} == {("app/main.py", "app/auth.py", "auth"), ("web/a.ts", "web/b.ts", None)}
    name = {r.id: r.qualified_name for r in sym.collect()}
    got = {(r.from_name, r.to_name, name.get(r.to_symbol_id), r.confidence) for r in resolve.resolve_calls(sym, extract.calls_table(facts), t).collect()}
    assert ("Store.save", "load", "Store.load", "high") in got
    assert ("login", "Store", "Store", "high") in got
    assert ("run", "login", "login", "high") in got
    assert ("run", "thing", None, "low") in got and ("a", "b", "b", "high") in got
    refs = resolve.import_references(sym, extract.imports_table(facts), t)
    assert {(r.file_path, r.to_name) for r in refs.collect()} == {("app/main.py", "login"), ("web/a.ts", "b")}
    docs_ = listings.missing_docs(sym, resolve.references(sym, extract.calls_table(facts), t), min_lines=1)
    assert docs_.first().qualified_name in ("login", "b", "Store.load")


def test_ambiguous_names_fall_through(spark):
    files = {f"m{i}.py": "def same():\n    pass\n" for i in range(6)} | {"c.py": "def f():\n    same()\n    other.same()\n"}
    f = extract.extract(spark.createDataFrame([("r", p, t) for p, t in files.items()], RAW))
    s, c = extract.symbols_table(f), extract.calls_table(f)
    t = resolve.resolve_imports(f, extract.imports_table(f))
    assert {r.to_symbol_id for r in resolve.resolve_calls(s, c, t).collect()} == {None}


def test_endpoints_end_to_end(spark):
    files = {
        "users.py": "from fastapi import APIRouter\nrouter = APIRouter(prefix='/users')\n@router.get('/{id}')\ndef one(id): ...\n",
        "main.py": "from fastapi import FastAPI\nfrom users import router as users_router\napp = FastAPI()\napp.include_router(users_router, prefix='/v1')\n@app.post('/ping')\ndef ping(): ...\n",
        "srv.js": "const express = require('express');\nconst app = express();\nconst r = express.Router();\nr.get('/x', h);\napp.use('/api', r);\nfunction h(a, b) { }\n",
    }
    raw = spark.createDataFrame([("r", p, t) for p, t in files.items()], RAW)
    d, f = routes.detect_files(raw), extract.extract(raw)
    t = resolve.resolve_imports(f, extract.imports_table(f))
    e = routes.build_endpoints(routes.table_of(d, "routes"), routes.table_of(d, "routers"), routes.table_of(d, "includes"), routes.bindings(extract.imports_table(f), t), extract.symbols_table(f))
    got = rows(e.select("method", "path", "handler", "partial", F.col("handler_symbol_id").isNotNull()))
    assert got == [("GET", "/api/x", "h", False, True), ("GET", "/v1/users/{id}", "one", False, True), ("POST", "/ping", "ping", False, True)]
    assert rows(routes.list_endpoints(e, q="users").select("path")) == [("/v1/users/{id}",)]
    assert [tuple(r) for r in routes.facets(e).filter("facet = 'method'").orderBy("position").select("value", "count").collect()] == [("GET", 2), ("POST", 1)]


# --- listings, docs, conversations -----------------------------------------------------------------------------------------------------------


def test_debt_board(spark):
    now = 400 * 86400.0
    items = spark.createDataFrame([("TODO", "a", "x/y/z.py", 1, now - 86400 * 40, "ann", "", ""), ("BUG", "", "m.py", 2, None, "", "", ""), ("OTHER", "c", "x/q.py", 3, now, None, "", "")], "tag string, text string, file_path string, line int, commit_date double, author string, symbol string, assignee string")
    d = listings.debt_items(items, now)
    assert {(r.key, r["count"]) for r in listings.debt_groups(d, "tag").collect()} == {("TODO", 1), ("BUG", 1), ("FIXME", 0), ("HACK", 0), ("XXX", 0), ("NOTE", 0)}
    assert {(r.key, r["count"]) for r in listings.debt_groups(d, "age").collect()} == {("1 to 6 months", 1), ("Unknown age", 1), ("Last 30 days", 1)}
    assert [r.key for r in listings.debt_groups(d, "folder").orderBy("key").collect()] == ["(root)", "x", "x/y"]
    with pytest.raises(ValueError):
        listings.debt_groups(d, "colour")
    assert "\n".join(r.row for r in listings.debt_markdown(d).collect()) + "\n" == "# Tech debt\n\n3 items\n\n## BUG (1)\n\n- (no text) `m.py:2`\n\n## OTHER (1)\n\n- c `x/q.py:3`\n\n## TODO (1)\n\n- a `x/y/z.py:1` (ann)\n\n"
    assert [r.row for r in listings.debt_csv(d).collect()] == ["BUG,,m.py,2,,,,", "OTHER,c,x/q.py,3,,,,", "TODO,a,x/y/z.py,1,,ann,,40"]


def test_env_listing_and_example(spark):
    e = spark.createDataFrame([("A", "x/1.py", 1, "v", False, False), ("A", "x/2.py", 2, "v", False, True), ("S", "y.py", 1, "k", True, False), ("V", "x/1.py", 3, "1", False, False), ("V", "x/1.py", 4, "2", None, False), (None, "z", 1, None, None, None)], "name string, file_path string, line int, default_value string, is_secret boolean, required boolean")
    v = listings.env_variables(e)
    got = {r.name: (r.is_secret, r.required, r.default, r.default_varies, len(r.usages)) for r in v.collect()}
    assert got == {"A": (False, True, "v", False, 2), "S": (True, False, None, False, 1), "V": (False, False, None, True, 2)}
    text = {r.module: r.text for r in listings.env_example(v).collect()}
    assert text["(root)"].endswith("# optional. Used in y.py:1\n# Secret: set a real value; never commit it.\nS=\n")
    assert "A=v\n" in text["x"] and "V=\n" in text["x"]


def test_suggestions(spark):
    schema = "id bigint, repo_id string, file_path string, start_line int, status string, file_hash_at_suggestion string"
    s = spark.createDataFrame([(1, "r", "a", 1, "pending", "h"), (2, "r", "a", 9, "accepted", "h"), (3, "r", "b", 1, "pending", "old")], schema)
    new = spark.createDataFrame([(4, "r", "a", 1, "pending", "h"), (5, "r", "a", 9, "pending", "h")], schema)
    s = listings.save_suggestion(s, new)
    assert {r.id for r in s.collect()} == {2, 3, 4, 5}
    hashes = spark.createDataFrame([("r", "a", "h"), ("r", "b", "new")], "repo_id string, path string, hash string")
    got = {r.id: r.status for r in listings.decide(s, [2, 3, 4], "accepted", hashes).collect()}
    assert got == {2: "accepted", 3: "pending", 4: "accepted", 5: "pending"}
    assert {r.id: r.status for r in listings.decide(s, [2, 3], "rejected").collect()}[2] == "accepted"


def test_doc_answers_rendering_and_edits():
    sig = "def f(self, a: int, *rest, k=(1, 2)) -> int"
    assert docs.parameter_names(sig, "python") == ["a", "rest", "k"]
    assert docs.parameter_names("int Add(List<int> xs, string name = \"a\")", "csharp") == ["xs", "name"]
    d = docs.parse_answer("Summary: adds things\nParam a: first\nReturns: the sum", sig)
    assert docs.render_lines(d, "python", "f") == ["adds things.", "", "Args:", "    a: first", "", "Returns:", "    the sum"]
    assert docs.render_comment(docs.render_lines(d, "java", "f"), "java", "  ") == "  /**\n   * adds things.\n   *\n   * @param a first\n   * @return the sum\n   */\n"
    assert docs.render_lines(d, "go", "Add") == ["Add adds things."]
    for bad in ("```x```", "Param zz: no\nSummary: s", "Summary: ends */ it", ""):
        with pytest.raises(docs.DocError):
            docs.parse_answer(bad, sig)
    text = "import os\n\ndef f(a):\n    return a\n\n\nclass B:\n    def g(self):\n        pass\n"
    new, added = docs.apply_edits(text, "python", [(3, ["One."]), (8, ["Two.", "", "More."])])
    assert '    """One."""\n    return a' in new and added == [(4, 1), (9, 4)]
    with pytest.raises(docs.DocError):
        docs.apply_edits(new, "python", [(3, ["Again."])])
    js, _ = docs.apply_edits("a();\r\nfunction f() {}\r\n", "javascript", [(2, ["F."])])
    assert js == "a();\r\n/**\r\n * F.\r\n */\r\nfunction f() {}\r\n"
    assert docs.diff_lines(["a", "b"], ["a", "c", "d"])[0] == [("equal", "a", "a"), ("replace", "b", "c"), ("replace", None, "d")]


def test_conversations(spark):
    c = spark.createDataFrame([], conversations.CONVERSATION)
    m = spark.createDataFrame([], conversations.MESSAGE)
    c = conversations.create(c, "r", "t" * 100, 1.0)
    cid = c.first().id
    assert len(c.first().title) == 80
    for k, role in enumerate(["user", "assistant", "user", "assistant", "user"]):
        c, m = conversations.add_message(c, m, cid, role, f"m{k}", 2.0 + k)
    assert [r.content for r in conversations.last_messages(m).orderBy("id").collect()] == ["m1", "m2", "m3", "m4"]
    assert [r.content for r in conversations.delete_last_exchange(m).orderBy("id").collect()] == ["m0", "m1", "m2", "m3"]
    assert conversations.listing(c).first().updated_at == 6.0
    c, m = conversations.delete(c, m, cid)
    assert c.count() == 0 and m.count() == 0


def test_answer_events():
    class Model:
        def stream(self, messages):
            yield from ["It is ", "[1]."]

    chunk = {"chunk_id": 7, "file_path": "a.py", "block": "x"}
    cite = lambda t, n: [1] if "[1]" in t else []
    ev = list(conversations.answer_events("q", [chunk], 0.9, 0.35, Model(), cite))
    assert [k for k, _ in ev] == ["retrieval", "token", "token", "done"] and ev[-1][1]["citations"] == [{"n": 1, "chunk_id": 7}]
    assert [k for k, _ in conversations.answer_events("q", [chunk], 0.1, 0.35, Model(), cite)] == ["retrieval", "no_answer"]

    class Broken:
        def stream(self, messages):
            raise OSError("down")

    assert [k for k, _ in conversations.answer_events("q", [chunk], 0.9, 0.35, Broken(), cite)] == ["retrieval", "error"]


# --- sources, index, streaming ------------------------------------------------------------------------------------------------------------------


def test_repository_scan(spark, tmp_path):
    for p, b in {"a.py": b"x = 1\n", "sub/b.min.js": b"x", "node_modules/c.js": b"x", ".git/d": b"x", "e.png": b"x", "f.txt": b"a\x00b", "g.txt": "é\n".encode(), "yarn.lock": b"x", "h.log": b"x", "sub/k.py": b"y\n"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b)
    d = repository.scan(spark, str(tmp_path))
    assert sorted(r.path for r in d.collect()) == ["a.py", "g.txt", "h.log", "sub/k.py"]
    kept = repository.without_ignored(d.select("path", "hash"), {"": ["*.log", "# c", "/sub/"]})
    assert sorted(r.path for r in kept.collect()) == ["a.py", "g.txt"]
    assert not repository.ignored("x/keep.log", {"": ["*.log", "!keep.log"]}) and repository.ignored("a/b/c/d.txt", {"a": ["b/**/d.txt"]})


def test_dotenv_blame_and_slices(spark):
    lines = spark.createDataFrame([(".env", "export A=1"), ("x/.env.example", "B = 2"), ("x/y/z/.env", "C=3"), ("a.py", "D=4"), (".env", "# E=5")], "path string, value string")
    assert rows(repository.dotenv_names(lines)) == [("A", ".env"), ("B", "x/.env.example")]
    text = f"{'a' * 40} 1 7 1\nauthor Ann\nauthor-time 1673352000\n\tx\n{'0' * 40} 2 9 1\nauthor Not Committed Yet\nauthor-time 5\n\ty\n"
    assert repository.parse_blame(text) == {7: ("Ann", 1673352000.0), 9: (None, None)}
    t = spark.createDataFrame([("\n".join("abcdef"),)], "t string")
    s = t.select(repository.file_slice(F.col("t"), F.lit(3), F.lit(4), 1).alias("s")).first().s
    assert (s.first, s.last, s.lines) == (2, 5, ["b", "c", "d", "e"])
    p = spark.createDataFrame([("a/b.py",), ("../x",), ("/etc/x",), ("a/.env",), ("k.pem",)], "p string")
    assert [r[0] for r in p.select(repository.safe_path(F.col("p"))).collect()] == [True, False, False, False, False]


def test_index_diff_upsert_and_state(spark):
    f = "repo_id string, path string, hash string"
    a, b = spark.createDataFrame([("r", "1", "x"), ("r", "2", "x"), ("r", "3", "x")], f), spark.createDataFrame([("r", "1", "x"), ("r", "2", "y"), ("r", "4", "z"), ("r", "4", "z")], f)
    assert rows(index.diff(a, b)) == [("r", "2", "changed"), ("r", "3", "deleted"), ("r", "4", "added")]
    assert rows(index.upsert(a, b, ["repo_id", "path"])) == [("r", "1", "x"), ("r", "2", "y"), ("r", "3", "x"), ("r", "4", "z")]
    state = spark.createDataFrame([("r", "1", "sym", "x", 1), ("r", "2", "sym", "x", 1), ("r", "9", "sym", "x", 1)], "repo_id string, path string, analyzer string, hash string, version bigint")
    assert rows(index.stale(b, state, [("sym", 1)]).select("path")) == [("2",), ("4",)]
    assert index.stale(b, state, [("sym", 2)]).count() == 3 and index.stale(b, state, [("sym", 1)], force=True).count() == 3
    assert rows(index.vanished(b, state).select("path")) == [("9",)]


def test_settings_and_migrations():
    s = index.Settings().update({"top_k": 9})
    assert index.Settings.load(s.dump()).top_k == 9 and index.Settings.load("{broken").top_k == 6
    for bad in ({"top_k": 0}, {"colour": 1}, {"relevance": 2.0}):
        with pytest.raises(ValueError):
            s.update(bad)
    steps = {1: lambda t: {**t, "a": 1}, 2: lambda t: {**t, "b": t["a"] + 1}}
    v, t = index.migrate(0, steps, {})
    assert (v, t) == (2, {"a": 1, "b": 2}) and index.migrate(v, steps, t) == (v, t)


def test_stream_takes_up_new_files_only(spark, tmp_path):
    schema = "repo_id string, path string, hash string, indexed_at double"
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("r", "a", "1", 1.0), ("r", "b", "1", 1.0)], schema).write.parquet(src)
    assert rows(indexing.run_available(spark, src, schema, root).select("path", "hash")) == [("a", "1"), ("b", "1")]
    spark.createDataFrame([("r", "a", "2", 2.0), ("r", "b", "0", 0.5)], schema).write.mode("append").parquet(src)
    assert rows(indexing.run_available(spark, src, schema, root).select("path", "hash")) == [("a", "2"), ("b", "1")]
    assert rows(indexing.run_available(spark, src, schema, root).select("path", "hash")) == [("a", "2"), ("b", "1")]


# --- exports ---------------------------------------------------------------------------------------------------------------------------------------


def test_endpoint_exports(spark):
    from cairn.operators import exports

    e = spark.createDataFrame([("GET", "/b", "h", "a.py", 3, "fastapi", False), ("POST", "/a", None, "b.js", 1, "express", True)], "method string, path string, handler string, file_path string, line int, framework string, partial boolean")
    assert [r.row for r in exports.endpoint_rows(e, "csv").collect()] == ["method,path,handler,file,line,framework,partial", "POST,/a,,b.js,1,Express,yes", "GET,/b,h,a.py,3,FastAPI,"]
    assert [r.row for r in exports.endpoint_rows(e, "markdown").collect()][4:] == ["| POST | `/a` (partial) |  | `b.js:1` | Express |", "| GET | `/b` | `h` | `a.py:3` | FastAPI |"]
    assert '"handler":null' in exports.endpoint_rows(e, "json").first().row
    with pytest.raises(ValueError):
        exports.endpoint_rows(e, "xml")


def test_duplicate_checklist_and_impact_text(spark):
    from cairn.operators import exports

    g = spark.createDataFrame([("exact", 2, 9, 1.0, 18.0, [("f", "a.py", 1, 9), ("g", "b.py", 2, 10)])], "type string, size int, duplicated_lines int, avg_similarity double, value double, members array<struct<qualified_name:string,file_path:string,start_line:int,end_line:int>>")
    rows_ = [r.row for r in exports.duplicate_checklist(g, 0.9).collect()]
    assert rows_ == ["# Duplicate code\n\n1 groups (similarity at least 0.90)\n", "## 1. Exact match: 2 functions, 9 duplicated lines, similarity 1.00\n- [ ] `f` in `a.py:1-9`\n- [ ] `g` in `b.py:2-10`\n"]
    s = spark.createDataFrame([(3, 1, 2, 0, 0, 1, 2.65, "Low")], "total long, direct long, files long, low_confidence long, unresolved_same_name long, tests long, score double, level string")
    assert exports.fallback_summary(s, "f", 3).first().text == "Changing `f` may affect 3 symbols across 2 files, 1 of them direct callers. The blast radius is Low (score 2.65). 1 affected tests would show a break."
    assert exports.impact_facts(s, "f", "function", "a.py", 3).first().text.startswith("- The function `f` is in a.py.\n- Blast radius: Low (score 2.65).")


def test_signatures_and_cache(spark, tmp_path):
    import hashlib

    from cairn.operators import exports

    i = spark.createDataFrame([("b.py", 2, "BUG", "y"), ("a.py", 1, "TODO", "x")], "file_path string, line int, tag string, text string")
    assert exports.items_signature(i, "e").first()[0] == hashlib.sha256(b"e\na.py:1:TODO:x\nb.py:2:BUG:y").hexdigest()
    assert exports.parse_tags(" todo, bug,TODO ") == ["TODO", "BUG"] and exports.parse_tags("") == ["TODO", "FIXME", "HACK", "XXX", "BUG", "NOTE"]
    assert exports.analyzer_version(["A"]) != exports.analyzer_version(["B"])
    calls = []

    def make():
        calls.append(1)
        return i

    for _ in range(2):
        assert exports.cached(make, str(tmp_path), "k", spark).count() == 2
    assert len(calls) == 1
    df, o = exports.observed(i, "progress")
    df.write.format("noop").mode("overwrite").save()
    assert o.get["rows"] == 2


def test_impact_report(spark):
    from cairn.operators import graph

    s = spark.createDataFrame([(1, "f", "f", "function", None, "a.py", 1, False), (2, "g", "g", "function", None, "b.py", 1, False), (3, "t", "t", "function", None, "tests/c.py", 1, True)], "id bigint, name string, qualified_name string, kind string, owner string, file_path string, start_line int, is_test boolean")
    r = spark.createDataFrame([(2, 1, "call", "b.py", 3, 0, "high", "f"), (3, 2, "call", "tests/c.py", 4, 0, "medium", "g"), (None, None, "call", "z.py", 1, 0, "low", "f")], "from_symbol_id bigint, to_symbol_id bigint, kind string, file_path string, line int, seq bigint, confidence string, to_name string")
    hits, summary = graph.impact(s, r, 1)
    assert [(h.node, h.depth) for h in hits.collect()] == [(2, 1), (3, 2)]
    x = summary.first()
    assert (x.total, x.direct, x.files, x.production_files, x.tests, x.score, x.level, x.unresolved_same_name, x.truncated) == (2, 1, 2, 1, 1, 1.0, "Low", 1, False)


def test_flow_and_sequence_diagrams(spark):
    s = spark.createDataFrame([(1, "f", "f", "function", "a.py"), (2, "g", "A.g", "method", "b.py"), (3, "A", "A", "class", "b.py")], "id bigint, name string, qualified_name string, kind string, file_path string")
    e = edges(spark, [(1, 2, "high"), (2, 3, "low"), (3, 1, "high")])
    text = diagrams.flow(s, e, 1)
    assert 'n1(["A.g"])' in text and 'n2[["A"]]' in text and "n1 -.-> n2" in text
    assert diagrams.sequence(s, e, 1).splitlines() == ["sequenceDiagram", "  participant p0 as a.py", "  participant p1 as b.py", "  p0->>p1: g()", "  p1->>p1: A()"]


# --- store ------------------------------------------------------------------------------------------------------------------------------------------


def test_store_replaces_one_repository(spark, tmp_path):
    from cairn.operators import store

    s = store.Store(spark, str(tmp_path / "store"))
    schema = "repo_id string, path string"
    assert s.read("files", schema).count() == 0
    s.write("files", spark.createDataFrame([("a1", "x"), ("a1", "y"), ("b2", "z")], schema))
    s.write("files", spark.createDataFrame([("a1", "w")], schema))
    assert rows(s.read("files").select("repo_id", "path")) == [("a1", "w"), ("b2", "z")]
    s.drop("b2", ["files"])
    assert rows(s.read("files").select("repo_id", "path")) == [("a1", "w")]
    r = store.register(spark.createDataFrame([], store.REPOS), "n", "/x", 1.0)
    i = r.first().id
    got = store.update_stats(r, spark.createDataFrame([(i, "a"), (i, "a"), (i, "b")], schema), spark.createDataFrame([(i, 1), (i, 2)], "repo_id string, id bigint")).first()
    assert (got.files, got.chunks) == (2, 2) and store.listing(r).count() == 1
    assert store.embedder().name == "hashing-256"
    with pytest.raises(ValueError):
        store.embedder("other")


def test_similar_pairs_cover_all_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8))
    x[30:] = x[:30] + 0.01
    v = spark.createDataFrame([(k, x[k].tolist(), f"f{k % 7}", k, k + 1, 1) for k in range(60)], "id bigint, vector array<double>, file_path string, start_line int, end_line int, span int")
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if round(float(n[a] @ n[b]), 4) >= 0.8 and not (a % 7 == b % 7 and b <= a + 1)}
    for block in (7, 1000):
        got = [(r.a, r.b) for r in clones.similar_pairs(v, 0.8, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_function_vectors_join_on_the_same_lines(spark):
    s = spark.createDataFrame([(1, "r", "a.py", 1, 9, "function"), (2, "r", "a.py", 1, 8, "function"), (3, "r", "a.py", 20, 30, "class"), (4, None, "a.py", 1, 9, "method")], "id bigint, repo_id string, file_path string, start_line int, end_line int, kind string")
    c = spark.createDataFrame([("r", "a.py", 1, 9, [1.0]), ("r", "a.py", 1, 9, [1.0]), ("r", "a.py", 20, 30, [2.0]), ("r", "a.py", 1, 8, None), (None, "a.py", 1, 9, [3.0])], "repo_id string, file_path string, start_line int, end_line int, embedding array<float>")
    assert [tuple(r) for r in clones.function_vectors(s, c).collect()] == [(1, [1.0], "r/a.py", 1, 9, 8)]
    assert clones.function_vectors(s, c.limit(0)).count() == 0


def test_duplicate_groups_of_one_kind(spark):
    s = spark.createDataFrame([(k, f"f{k}.py", 1, 9, "h" if k < 3 else None, False) for k in range(1, 6)], "id bigint, file_path string, start_line int, end_line int, norm_hash string, is_test boolean")
    p = spark.createDataFrame([(1, 2, 0.99), (3, 4, 0.95), (4, 5, 0.7)], "a bigint, b bigint, sim double")
    got = {k: [(r.type, [m.id for m in r.members]) for r in clones.duplicate_groups(s, p, kind=k).collect()] for k in ("all", "exact", "similar")}
    assert got == {"all": [("exact", [1, 2]), ("similar", [3, 4])], "exact": [("exact", [1, 2])], "similar": [("similar", [3, 4])]}
    with pytest.raises(ValueError):
        clones.duplicate_groups(s, p, kind="other")


def test_small_listings(spark):
    s = spark.createDataFrame([(1, True), (2, False), (3, False)], "id bigint, has_doc boolean")
    assert rows(listings.symbol_rows(s, [1, 2])) == [(2, False)]
    i = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("b", 2, "x")], "file_path string, line int, tag string")
    assert rows(listings.blame_targets(i)) == [("a", 1), ("b", 2)]


def _checkpointed(spark):
    """Bytes under the checkpoint folder."""
    at = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    return sum(p.stat().st_size for p in at.rglob("part-*"))


def test_many_questions_are_answered_as_one_by_one(spark):
    rng = random.Random(5)
    words = ["load", "index", "total", "merge", "queue", "page"]
    docs = spark.createDataFrame([(k, [rng.choice(words) for _ in range(rng.randrange(40))]) for k in range(300)], "chunk_id bigint, tokens array<string>")
    asked = ["load_index_total", "mergeQueue", "load_load", "page", "_page", "the", "nothing_here", "index total index_total", None]
    q = spark.createDataFrame([(a,) for a in asked], "question string")
    for block in (2, 1000):
        got = search.bm25_questions(docs, q, 5, block=block).collect()
        for a in asked[:-1]:
            want = [(r.chunk_id, r.score, r["rank"]) for r in search.bm25(docs, a, 5).collect()]
            assert sorted(((r.chunk_id, r.score, r["rank"]) for r in got if r.question == a), key=lambda r: r[2]) == want, a
    assert search.bm25_questions(docs, q.limit(0)).count() == search.bm25_questions(docs.limit(0), q).count() == 0


def test_many_questions_write_neither_words_nor_scores_of_all_pairs(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(k, [rng.choice(["load", "index", "total", "other"]) for _ in range(200)]) for k in range(2000)], "chunk_id bigint, tokens array<string>")
    q = spark.createDataFrame([(f"load_index_total_x{k}",) for k in range(50)], "question string")
    before = _checkpointed(spark)
    assert search.bm25_questions(docs, q, 5).count() == 250
    assert _checkpointed(spark) - before < 500_000  # the words alone are 400,000 of 16 bytes or more


VECTORS = "id bigint, vector array<float>, file_path string, start_line int, end_line int, span int"


@pytest.mark.parametrize("families,noise", [(12, 0.05), (12, 0.3), (500, 0.0)])
def test_packed_blocks_hold_the_pairs_of_brute_force(families, noise):
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(families, 16))[rng.integers(0, families, 600)] + noise * rng.normal(size=(600, 16))).astype(np.float32)
    x[17] = 0
    files, starts = rng.integers(0, 9, 600), np.arange(600)
    blocks = []
    for own in range(3):
        k = np.flatnonzero(np.arange(600) % 3 == own)
        t = {"ids": k, "files": files[k], "starts": starts[k].astype(np.int32), "ends": (starts[k] + 3).astype(np.int32), "own": np.full(len(k), own, np.int32)}
        t = pa.table({n: pa.array(c) for n, c in t.items()} | {"vector": pa.array(x[k].tolist(), pa.list_(pa.float32()))})
        blocks.append(pair_blocks.pack(t).to_batches()[0])
    n = pair_blocks.unit(x)
    for floor in (0.8, 0.97):
        got = []
        for p in range(3):
            for q in range(p, 3):
                both = pa.RecordBatch.from_arrays([*blocks[p].columns, *blocks[q].columns], [*blocks[p].schema.names, *("_" + c for c in blocks[q].schema.names)])
                got += [r for b in pair_blocks.similar(iter([both]), floor) for r in zip(*(c.to_pylist() for c in b.columns))]
        s = np.round(n @ n.T, 4)
        want = [(a, b) for a in range(600) for b in range(a + 1, 600) if s[a, b] >= floor and not (files[a] == files[b] and b <= a + 3)]
        assert sorted((a, b) for a, b, _ in got) == want
        assert all(abs(s[a, b] - c) < 2e-4 for a, b, c in got)


def test_similar_pairs_round_before_the_floor_and_copy_no_rows(spark):
    c = 0.79997
    v = spark.createDataFrame([(1, [1.0, 0.0], "a", 1, 2, 1), (2, [c, (1 - c * c) ** 0.5], "b", 1, 2, 1), (3, [0.0, -1.0], "c", 1, 2, 1), (4, None, "d", 1, 2, 1)], VECTORS)
    got = clones.similar_pairs(v, 0.8)
    assert rows(got) == [(1, 2, 0.8)]
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert clones.similar_pairs(v.limit(0)).count() == 0


def test_components_of_a_clique_need_a_link_a_node(spark):
    links = [(a, b) for k in (0, 100) for a in range(k, k + 60) for b in range(a + 1, k + 60)] + [(59, 70), (70, 71)]
    pairs = spark.createDataFrame(links, "a bigint, b bigint").coalesce(2)
    got = {r.node: r.component for r in clones.components(pairs).collect()}
    assert got == {k: 0 for k in [*range(60), 70, 71]} | {k: 100 for k in range(100, 160)}
    tree = pairs.coalesce(1).mapInArrow(pair_blocks.forest, "u bigint, v bigint").collect()
    assert len(tree) == 61 + 59
