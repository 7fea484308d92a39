import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cairn.functions import constants as K, text as T
from cairn.operators import search


def one(spark, column, **values):
    """The value of a Column expression over one row."""
    types = {str: "string", int: "int", float: "double", list: "array<string>", bool: "boolean", type(None): "string"}
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {types[type(v)]}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize("word, parts", [("getUserName", ["get", "user", "name"]), ("parseHTTPResponse", ["parse", "http", "response"]), ("get_user_2", ["get", "user", "2"]), ("X", ["x"]), ("", [])])
def test_identifier_parts(spark, word, parts):
    assert one(spark, T.split_identifier(F.col("w")), w=word) == parts


def test_search_tokens_and_query(spark):
    assert one(spark, T.search_tokens(F.col("t")), t="the getName, x_1") == ["the", "getname", "get", "name", "x_1", "x", "1"]
    assert one(spark, T.query_string(F.col("t")), t="How is the getName used? getName") == '"getname" OR "get" OR "name"'
    assert one(spark, T.query_string(F.col("t")), t="what is this") is None
    assert one(spark, T.query_string(F.col("t")), t=None) is None


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("aA_1 .B", max_size=12), min_size=1, max_size=8))
def test_question_terms_match_the_expression(texts):
    from cairn.session import session

    spark = session("tests", "local[4]")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.query_terms(F.col("t"))).collect()] == [search.terms_of(t) for t in texts]


@pytest.mark.parametrize(
    "parts, path",
    [(["/api/", "users", "/{id}"], "/api/users/{id}"), (["/users", "/"], "/users/"), (["", ""], "/"), (["/"], "/"), (["a", ""], "/a"), ([], "/")],
)
def test_join_paths(spark, parts, path):
    assert one(spark, T.join_paths(F.array(*map(F.lit, parts)) if parts else F.array().cast("array<string>"))) == path


@pytest.mark.parametrize("path, test", [("tests/a.py", True), ("a/test_x.py", True), ("a/x_test.go", True), ("src/x.spec.ts", True), ("src/testing.py", False), ("src/FooTests.cs", True), ("latest/x.py", False), ("conftest.py", True)])
def test_test_paths(spark, path, test):
    assert one(spark, T.is_test_path(F.col("p")), p=path) is test


@pytest.mark.parametrize(
    "name, secret",
    [("API_KEY", True), ("apiKey", True), ("TOKEN_TTL", False), ("dbPassword", True), ("MONKEY", False), ("KEYBOARD", False), ("JWT_SECRET", True), ("PASSWORD_MIN_LENGTH", False), ("my_apikey_x", True), ("DSN", True)],
)
def test_secret_names(spark, name, secret):
    assert one(spark, T.is_secret_name(F.col("n")), n=name) is secret


def test_secret_by_credential_url(spark):
    assert one(spark, T.is_secret(F.col("n"), F.col("d")), n="URL", d="db://u:p@h/x") is True
    assert one(spark, T.is_secret(F.col("n"), F.col("d")), n="URL", d=None) is False


@pytest.mark.parametrize("text, n, cited", [("a [1][2] b [1, 3]", 3, [1, 2, 3]), ("[9] [0] [2]", 2, [2]), ("none", 4, []), ("[2] [1]", 2, [2, 1])])
def test_citations(spark, text, n, cited):
    assert one(spark, T.citations(F.col("t"), F.lit(n)), t=text) == cited


def test_labels_and_summaries(spark):
    assert one(spark, T.mermaid_label(F.col("t")), t=' a  "b" <c> #1 ') == "a #quot;b#quot; #lt;c#gt; #35;1"
    assert one(spark, T.mermaid_label(F.col("t")), t="x" * 50) == "…" + "x" * 43
    assert one(spark, T.mermaid_label(F.col("t")), t="  ") == "?"
    assert one(spark, T.clean_label(F.col("t")), t='"Label: error handling."\nmore') == "Error handling"
    assert one(spark, T.clean_label(F.col("t")), t="one two three four five six") is None
    assert one(spark, T.usable_summary(F.col("t")), t="<think>x</think>One. Two.") == "One. Two."
    assert one(spark, T.usable_summary(F.col("t")), t="- a.\n- b.") is None
    assert one(spark, T.strip_reasoning(F.col("t")), t="a <think>open") == "a"


def test_name_scores(spark):
    def score(q, name, qualified):
        return one(spark, T.name_score(q, F.lit(name), F.lit(qualified)))

    assert [score("verify", n, q) for n, q in (("verify", "A.verify"), ("verify_x", "A.verify_x"), ("x", "verify.x"), ("xverify", "a.xverify"), ("x", "a.verify.x"), ("zz", "a.zz"))] == [100, 80, 70, 60, 50, None]
    assert score("vtok", "x", "verify_token") == 30 and score("vt", "x", "verify_token") is None and score("", "x", "x") == 1


def test_paths_ages_and_values(spark):
    assert one(spark, T.dotted_suffixes(F.col("p")), p="src/app/util.py") == ["util", "app.util", "src.app.util"]
    assert one(spark, T.dotted_suffixes(F.col("p")), p="app/__init__.py") == ["app"]
    assert [one(spark, T.folder_of(F.col("p")), p=x) for x in ("a.py", "a/b.py", "a/b/c/d.py")] == ["(root)", "a", "a/b"]
    assert [one(spark, T.age_bucket(F.lit(x))) for x in (-3.0, 29.9, 30.0, 180.0, 365.0)] == ["Last 30 days", "Last 30 days", "1 to 6 months", "6 to 12 months", "Over a year"]
    assert one(spark, T.quote_env(F.col("v")), v='a "b"') == '"a \\"b\\""' and one(spark, T.quote_env(F.col("v")), v="plain") == "plain"
    assert one(spark, T.weakest(F.lit("high"), F.lit("low"))) == "low"
    assert one(spark, T.estimate_tokens(F.col("t")), t="") == 1
    assert one(spark, T.params_key(F.lit(0.904), F.lit("all"), F.lit(False), F.lit(5))) == "0.90|all|False|5"
    assert one(spark, T.line_ending(F.col("t")), t="a\r\nb\r\nc\n") == "\r\n"


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\n\n", "a\r\nb\rc\x0bd\x85e\u2028f", "\n"])
def test_lines_are_split_like_python(spark, text):
    assert one(spark, T.lines_of(F.col("t")), t=text) == text.splitlines()


def test_hash_embedding_is_a_unit_vector(spark):
    import hashlib

    v = one(spark, T.hash_embedding(F.col("t")), t="getName x")
    want = [0.0] * 256
    for t in ("getname", "get", "name", "x", "x"):
        want[int(hashlib.md5(t.encode()).hexdigest(), 16) % 256] += 1
    norm = sum(x * x for x in want) ** 0.5
    assert all(abs(a - b / norm) < 1e-12 for a, b in zip(v, want))
    q = search.question_buckets("getName x")
    assert all(abs(v[k] - x) < 1e-12 for k, x in q.items())


def test_languages(spark):
    assert [one(spark, T.language(F.col("p")), p=p) for p in ("a/B.PY", "x.tsx", "Makefile", "a.rs", ".env")] == ["python", "tsx", "text", "rust", "text"]
    assert re.match(K.GO_TEST, "TestFoo")
