"""Queries of the analytics operators over the test tables, each with its SQL where SQL can say it.

Where a table of the engine has no counterpart among the test tables, a stand-in is derived from them: documents as debt
items and messages, includes of routers as module links, raw files as the sources facts are extracted from.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.functions import constants as K, text as T
from cairn.operators import chunking, clones, conversations, diagrams, docs, extract, graph, hierarchy, incremental, index, listings, resolve, routes, search
from cairn.plans.core_queries import P5_NODES
from cairn.session import cut, ensure_checkpoint_dir, table
from cairn.sources import repository
from cairn.streaming import indexing

QUESTION = "How does reconcile_profile validate the merged invoice checksum?"
NOW = 1_800_000_000.0
Q: dict = {}
S: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return keep


def chunks_of(spark, d):
    return table(spark, d, "chunks")


# --- text functions ------------------------------------------------------------------------------------------------------

_CAMEL_SQL = r"""regexp_extract_all(regexp_replace({w}, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')"""
_TOKENS_SQL = """flatten(list_transform(regexp_extract_all({t}, '[A-Za-z_][A-Za-z0-9_]*'), lambda w:
  CASE WHEN len(""" + _CAMEL_SQL.format(w="w") + """) > 1 THEN list_concat([lower(w)], list_transform(""" + _CAMEL_SQL.format(w="w") + """, lambda p: lower(p))) ELSE [lower(w)] END))"""
_STOP = "[" + ", ".join(f"'{w}'" for w in K.STOPWORDS) + "]"


@query("SELECT DISTINCT symbol_name, array_to_string(list_transform(" + _CAMEL_SQL.format(w="symbol_name") + ", lambda p: lower(p)), ' ') AS parts FROM chunks WHERE symbol_name IS NOT NULL")
def identifier_parts(spark, d):
    return chunks_of(spark, d).filter("symbol_name is not null").select("symbol_name", F.array_join(T.split_identifier(F.col("symbol_name")), " ").alias("parts")).distinct()


@query("WITH t AS (SELECT item_id, " + _TOKENS_SQL.format(t="text") + " AS k FROM eval_items), n AS (SELECT item_id, unnest(k) AS x, generate_subscripts(k, 1) AS i FROM t), f AS (SELECT item_id, x, min(i) AS i FROM n WHERE NOT list_contains(" + _STOP + ", x) AND replace(x, '_', '') <> '' GROUP BY 1, 2) SELECT item_id, string_agg('\"' || x || '\"', ' OR ' ORDER BY i) AS terms FROM f GROUP BY 1")
def query_strings(spark, d):
    return table(spark, d, "eval_items").select("item_id", T.query_string(F.col("text")).alias("terms")).filter("terms is not null")


@query("""SELECT DISTINCT path,
  CASE lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.go' THEN 'go' WHEN '.java' THEN 'java' WHEN '.cs' THEN 'csharp' WHEN '.json' THEN 'json' WHEN '.yaml' THEN 'yaml' WHEN '.md' THEN 'markdown' WHEN '.sh' THEN 'bash' WHEN '.sql' THEN 'sql' ELSE 'text' END AS language,
  coalesce(len(list_intersect(list_transform(string_split(path, '/')[:-2], lambda f: lower(f)), ['tests', 'test', '__tests__', 'spec', 'specs', 'testing', 'e2e'])) > 0, false)
    OR regexp_matches(regexp_extract(path, '[^/]*$'), '(^test_.*\\.py$)|(_test\\.py$)|(^conftest\\.py$)|(_test\\.go$)|(\\.(test|spec)\\.[cm]?[jt]sx?$)|((Test|Tests|IT)\\.java$)|((Test|Tests)\\.cs$)') AS is_test,
  len(list_intersect(list_transform(string_split(path, '/')[:-2], lambda f: lower(f)), ['vendor', 'third_party', 'third-party', 'node_modules', 'site-packages', 'generated', 'gen', 'migrations', '__generated__', 'dist', 'build'])) > 0 AS is_vendored,
  CASE WHEN contains(path, '/') THEN array_to_string(string_split(path, '/')[1:least(2, len(string_split(path, '/')) - 1)], '/') ELSE '(root)' END AS folder,
  CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '(root)' END AS module
FROM files""")
def path_functions(spark, d):
    p = F.col("path")
    return table(spark, d, "files").select("path").distinct().select("path", T.language(p).alias("language"), T.is_test_path(p).alias("is_test"), T.is_vendored_path(p).alias("is_vendored"), T.folder_of(p).alias("folder"), T.module_of(p).alias("module"))


@query("SELECT DISTINCT array_to_string(string_split(path, '/')[1:k], '/') AS scope FROM (SELECT path, unnest(range(1, least(3, len(string_split(path, '/')) - 1) + 1)) AS k FROM files)")
def folder_scopes(spark, d):
    p = table(spark, d, "files").filter(F.col("path").contains("/")).select(F.explode(T.scopes(F.col("path"))).alias("scope"))
    return p.distinct()


@query("SELECT DISTINCT path, unnest(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[len(p) - i + 1:], '.'))) AS suffix FROM (SELECT path, CASE WHEN q[-1] = '__init__' THEN q[:-2] ELSE q END AS p FROM (SELECT path, string_split(regexp_replace(path, '\\.[^./]*$', ''), '/') AS q FROM files WHERE path LIKE '%.py'))")
def dotted_suffixes(spark, d):
    return table(spark, d, "files").filter("path like '%.py'").select("path", F.explode(T.dotted_suffixes(F.col("path"))).alias("suffix")).distinct()


@query("""WITH e AS (SELECT DISTINCT name, default_value FROM env_vars WHERE name IS NOT NULL), t AS (
  SELECT *, list_filter(list_transform(regexp_split_to_array(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+'), lambda x: upper(x)), lambda x: x <> '') AS k FROM e)
SELECT name, bool_or((len(list_intersect(k, ['KEY','TOKEN','SECRET','PASSWORD','PASSWD','PWD','CREDENTIAL','CREDENTIALS','PRIVATE','APIKEY','DSN','SALT','PASSPHRASE'])) > 0 OR contains(replace(upper(name), '_', ''), 'APIKEY'))
  AND len(list_intersect(k, ['TTL','EXPIRES','EXPIRY','EXPIRATION','TIMEOUT','DURATION','LIFETIME','SECONDS','MINUTES','HOURS','DAYS','LENGTH','SIZE','COUNT','ENABLED','ENABLE','ALGORITHM','HEADER','PREFIX','MAX','MIN','LIMIT','ROUNDS','ITERATIONS'])) = 0) AS secret_name,
  bool_or(coalesce(regexp_matches(default_value, '://[^/\\s:@]+:[^/\\s@]+@'), false)) AS secret_url
FROM t GROUP BY name""")
def env_secret_flags(spark, d):
    e = table(spark, d, "env_vars").filter("name is not null")
    return e.groupBy("name").agg(F.bool_or(T.is_secret_name(F.col("name"))).alias("secret_name"), F.bool_or(F.coalesce(F.col("default_value").rlike(K.CREDENTIAL_URL), F.lit(False))).alias("secret_url"))


@query("""WITH r AS (SELECT DISTINCT id, coalesce(prefix, '') AS p FROM endpoint_routers)
SELECT id, CASE WHEN trim(p, '/') = '' THEN '/x' ELSE '/' || trim(p, '/') || '/x' END AS joined, CASE WHEN trim(p, '/') = '' THEN '/' WHEN suffix(p, '/') THEN '/' || trim(p, '/') || '/' ELSE '/' || trim(p, '/') END AS alone FROM r""")
def route_paths(spark, d):
    r = table(spark, d, "endpoint_routers").select("id", F.coalesce("prefix", F.lit("")).alias("p")).distinct()
    return r.select("id", T.join_paths(F.array("p", F.lit("x"))).alias("joined"), T.join_paths(F.array("p", F.lit(""))).alias("alone"))


_ANSWERS = [
    (1, "See [2] and [1, 3]; also [9][2].", 3), (2, "<think>so</think> Yes. It is [1].", 1), (3, "<think>never ends", 2), (4, "One. Two! Three?", 4),
    (5, "```code``` One. Two.", 1), (6, "One sentence only.", 1), (7, "- a list.\n- of two.", 2), (8, "", 3),
]
_ANSWER_VALUES = ", ".join("({}, '{}', {})".format(i, t.replace("'", "''"), n) for i, t, n in _ANSWERS)


@query(f"""WITH a(id, answer, n) AS (VALUES {_ANSWER_VALUES}), s AS (
  SELECT id, n, answer, list_transform(flatten(list_transform(regexp_extract_all(answer, '\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]', 1), lambda g: regexp_split_to_array(g, '\\s*,\\s*'))), lambda x: x::INT) AS c FROM a),
  u AS (SELECT id, unnest(c) AS x, generate_subscripts(c, 1) AS i, n FROM s), f AS (SELECT id, x, min(i) AS i FROM u WHERE x BETWEEN 1 AND n GROUP BY 1, 2),
  g AS (SELECT id, string_agg(x, ',' ORDER BY i) AS cited FROM f GROUP BY 1)
SELECT a.id, coalesce(g.cited, '') AS cited, trim(regexp_replace(answer, '(?s)<think>.*?(</think>|$)', '', 'g')) AS plain FROM a LEFT JOIN g USING (id)""")
def answer_texts(spark, d):
    a = spark.createDataFrame(_ANSWERS, "id int, answer string, n int")
    return a.select("id", F.array_join(T.citations(F.col("answer"), F.col("n")), ",").alias("cited"), T.strip_reasoning(F.col("answer")).alias("plain"))


# --- search -----------------------------------------------------------------------------------------------------------------

_DOCS_SQL = """docs AS (SELECT chunk_id, list_filter(regexp_split_to_array(array_to_string(toks, ' '), '[ _]+'), lambda x: x <> '') AS tokens FROM (
  SELECT id AS chunk_id, """ + _TOKENS_SQL.format(t="(concat_ws(' ', file_path, coalesce(symbol_name, ''), content))") + """ AS toks FROM (SELECT DISTINCT ON (id) * FROM chunks WHERE content IS NOT NULL)))"""
_TERMS = search.terms_of(QUESTION)
_BM25_SQL = "WITH " + _DOCS_SQL + """, terms(term, parts) AS (VALUES """ + ", ".join(f"('{t}', [{', '.join(repr(p) for p in t.split('_') if p)}])" for t in _TERMS) + """),
m AS (SELECT chunk_id, len(tokens) AS dl, term, len(list_filter(range(1, len(tokens) - len(parts) + 2), lambda i: tokens[i:i + len(parts) - 1] = parts)) AS tf FROM docs, terms),
k AS (SELECT * FROM m WHERE tf > 0), df AS (SELECT term, count(*) AS df FROM k GROUP BY 1), st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM docs),
s AS (SELECT chunk_id, round(sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score FROM k JOIN df USING (term), st GROUP BY 1)
SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM s ORDER BY score DESC, chunk_id LIMIT 20"""


@query(_BM25_SQL)
def search_bm25(spark, d):
    return search.bm25(search.documents_of(chunks_of(spark, d)), QUESTION)


@query("WITH " + _DOCS_SQL + """, terms(term, parts) AS (VALUES """ + ", ".join(f"('{t}', [{', '.join(repr(p) for p in t.split('_') if p)}])" for t in _TERMS) + """),
m AS (SELECT chunk_id, term, len(list_filter(range(1, len(tokens) - len(parts) + 2), lambda i: tokens[i:i + len(parts) - 1] = parts)) AS tf FROM docs, terms) SELECT chunk_id, term, tf::INT AS tf FROM m WHERE tf > 0""")
def search_postings(spark, d):
    """Term matches from the postings table: phrases by positions."""
    return search.phrase_matches(search.postings(search.documents_of(chunks_of(spark, d))), _TERMS)


def _own_vectors(spark, d):
    e = F.col("embedding")
    c = chunks_of(spark, d).filter(e.isNotNull() & (F.size(e) == 64) & F.exists(e, lambda x: x != 0)).dropDuplicates(["id"])
    return c.select(F.col("id").alias("chunk_id"), T.l2_normalise(e).alias("vector"))


_VEC = "SELECT DISTINCT ON (id) id, embedding FROM chunks WHERE embedding IS NOT NULL AND len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0"


@query(f"WITH v AS ({_VEC}), q AS (SELECT embedding AS e FROM v ORDER BY id LIMIT 1) SELECT id AS chunk_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS score FROM v, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) DESC, id LIMIT 20")
def search_vector_embeddings(spark, d):
    v = _own_vectors(spark, d)
    first = v.orderBy("chunk_id").limit(1).select("vector").first()
    q = F.array(*(F.lit(float(x)) for x in first[0])) if first else F.array(F.lit(0.0))
    return search.vector_search(v, q).select("chunk_id", F.round("score", 6).alias("score"))


def _hash_sql(text: str) -> str:
    toks = "flatten(list_transform(regexp_extract_all(" + text + ", '[A-Za-z_][A-Za-z0-9_]*'), lambda w: list_concat([lower(w)], list_transform(" + _CAMEL_SQL.format(w="w") + ", lambda p: lower(p)))))"
    return "list_transform(" + toks + ", lambda t: ('0x' || right(md5(t), 2))::INT)"


_HEAD = "(CASE WHEN coalesce(language, 'text') IN ('python', 'text', 'markdown', 'yaml') THEN '#' ELSE '//' END || ' ' || file_path || CASE WHEN coalesce(symbol_name, '') <> '' THEN ' :: ' || symbol_name ELSE '' END || chr(10) || content)"
_VSQL = f"""b AS (SELECT id, unnest({_hash_sql(_HEAD)}) AS k FROM (SELECT DISTINCT ON (id) * FROM chunks WHERE content IS NOT NULL)), c AS (SELECT id, k, count(*)::DOUBLE AS n FROM b GROUP BY 1, 2),
nn AS (SELECT id, sqrt(sum(n * n)) AS norm FROM c GROUP BY 1), qb AS (SELECT unnest({_hash_sql("'" + QUESTION + "'")}) AS k), qc AS (SELECT k, count(*)::DOUBLE AS n FROM qb GROUP BY 1), qn AS (SELECT sqrt(sum(n * n)) AS norm FROM qc),
vs AS (SELECT ids.id AS chunk_id, round(coalesce(x.s, 0), 9) AS score FROM (SELECT DISTINCT id FROM chunks WHERE content IS NOT NULL) ids LEFT JOIN (SELECT c.id, sum(c.n * qc.n) / (any_value(nn.norm) * any_value(qn.norm)) AS s FROM c JOIN qc USING (k) JOIN nn ON nn.id = c.id, qn GROUP BY c.id) x USING (id)),
vt AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM vs ORDER BY score DESC, chunk_id LIMIT 20)"""


@query(f"WITH {_VSQL} SELECT chunk_id, rank, score FROM vt")
def search_vector(spark, d):
    return search.top(search.hashed_scores(chunks_of(spark, d), QUESTION)).select("chunk_id", "rank", "score")


@query("WITH kw AS (" + _BM25_SQL + f"), {_VSQL}, " + """l AS (SELECT chunk_id, rank, 0 AS list FROM vt UNION ALL SELECT chunk_id, rank, 1 FROM kw),
f AS (SELECT chunk_id, sum(1.0 / (60 + rank)) AS s, min(list * 1000 + rank) AS first FROM l GROUP BY 1)
SELECT f.chunk_id, row_number() OVER (ORDER BY s DESC, first) AS rank, round(s, 5) AS score, round(vs.score, 4) AS cosine FROM f JOIN vs USING (chunk_id) ORDER BY s DESC, first LIMIT 6""")
def search_hybrid(spark, d):
    return search.search(chunks_of(spark, d), QUESTION)


@query(f"WITH {_VSQL} SELECT CASE WHEN coalesce(max(score), -1) < 0.35 THEN 'no_answer' ELSE 'answer' END AS decision, round(max(score), 4) AS best_cosine FROM vt")
def relevance_gate(spark, d):
    return search.gate(search.top(search.hashed_scores(chunks_of(spark, d), QUESTION)))


@query("WITH kw AS (" + _BM25_SQL + """) SELECT kw.rank, '[' || kw.rank || '] ' || file_path || ':' || start_line || '-' || end_line || CASE WHEN coalesce(symbol_name, '') <> '' THEN ' (' || symbol_name || ')' ELSE '' END || chr(10) || '```' || coalesce(language, '') || chr(10) || content || chr(10) || '```' AS block
FROM kw JOIN (SELECT DISTINCT ON (id) * FROM chunks) c ON c.id = kw.chunk_id""")
def context_blocks(spark, d):
    hits = search.bm25(search.documents_of(chunks_of(spark, d)), QUESTION)
    c = chunks_of(spark, d).dropDuplicates(["id"])
    j = c.join(F.broadcast(hits.select("chunk_id", "rank")), F.col("id") == F.col("chunk_id"))  # 20 rows
    return j.select("rank", T.context_block(F.col("rank"), F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("symbol_name"), F.col("language"), F.col("content")).alias("block"))


_EVAL_SQL = "WITH " + _DOCS_SQL + f""", asks AS (SELECT DISTINCT symbol_name AS question, file_path AS path FROM chunks WHERE id % 50 = 0 AND symbol_name IS NOT NULL AND content IS NOT NULL),
qt AS (SELECT DISTINCT question, term FROM (SELECT question, unnest({_TOKENS_SQL.format(t="question")}) AS term FROM asks) WHERE NOT list_contains({_STOP}, term) AND replace(term, '_', '') <> ''),
pp AS (SELECT term, unnest(p) AS tok, generate_subscripts(p, 1) AS k, len(p) AS n FROM (SELECT DISTINCT term, list_filter(string_split(term, '_'), lambda x: x <> '') AS p FROM qt)),
tk AS (SELECT chunk_id, len(tokens) AS dl, unnest(tokens) AS tok, generate_subscripts(tokens, 1) AS pos FROM docs),
tf AS (SELECT term, chunk_id, dl, count(*) AS tf FROM (SELECT term, chunk_id, dl FROM pp JOIN tk USING (tok) GROUP BY term, n, chunk_id, dl, pos - k HAVING count(DISTINCT k) = n) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM docs),
s AS (SELECT question, chunk_id, round(sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score FROM qt JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 20),
f AS (SELECT a.question, min(r.rank) AS rank FROM r JOIN (SELECT DISTINCT id, file_path FROM chunks) c ON c.id = r.chunk_id JOIN asks a ON a.question = r.question AND a.path = c.file_path GROUP BY 1)
SELECT 'bm25' AS mode, round(avg(CASE WHEN coalesce(rank, 99) <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_k, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, count(*) AS questions FROM (SELECT DISTINCT question FROM asks) LEFT JOIN f USING (question)"""


@query(_EVAL_SQL)
def eval_hit_mrr(spark, d):
    """The symbol names of every fiftieth chunk as questions, their files as expected answers."""
    c = chunks_of(spark, d)
    asks = c.filter("id % 50 = 0 and symbol_name is not null and content is not null").select(F.col("symbol_name").alias("question"), F.col("file_path").alias("path")).distinct()
    files = c.select(F.col("id").alias("chunk_id"), F.col("file_path").alias("chunk_path")).distinct()
    hits = search.bm25_questions(search.documents_of(c), asks)
    return search.evaluate(hits.withColumn("mode", F.lit("bm25")).join(files, "chunk_id"), asks, 3)


# --- chunks ---------------------------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT repo_id, path, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT repo_id, path, regexp_split_to_array(content, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]') AS l FROM raw_files WHERE content IS NOT NULL AND content <> '')),
w AS (SELECT repo_id, path, l, unnest(range(0, greatest(ceil((len(l) - 60) / 50.0)::INT, 0) + 1)) AS k FROM t WHERE len(l) > 0)
SELECT repo_id, path, k AS part, k * 50 + 1 AS start_line, least(k * 50 + 60, len(l)) AS end_line, md5(array_to_string(l[k * 50 + 1:k * 50 + 60], chr(10))) AS digest
FROM w WHERE regexp_matches(array_to_string(l[k * 50 + 1:k * 50 + 60], ''), '\\S')""")
def chunk_line_windows(spark, d):
    w = chunking.line_windows(table(spark, d, "raw_files"), ["repo_id", "path"])
    return w.select("repo_id", "path", "part", "start_line", "end_line", F.md5("content").alias("digest"))


@query(None)
def chunk_structure(spark, d):
    return chunking.structure_chunks(table(spark, d, "raw_files")).select("repo_id", "file_path", "symbol_name", "symbol_kind", "start_line", "end_line")


@query("SELECT coalesce(symbol_kind, '') AS kind, count(*) AS chunks, sum(greatest(1, length(content) // 4)) AS tokens FROM (SELECT DISTINCT ON (id) * FROM chunks) WHERE content IS NOT NULL GROUP BY 1")
def chunk_token_stats(spark, d):
    c = chunks_of(spark, d).dropDuplicates(["id"]).filter("content is not null")
    return c.groupBy(F.coalesce("symbol_kind", F.lit("")).alias("kind")).agg(F.count("*").alias("chunks"), F.sum(T.estimate_tokens(F.col("content"))).alias("tokens"))


@query(f"SELECT id, md5({_HEAD}) AS digest FROM (SELECT DISTINCT ON (id) * FROM chunks WHERE content IS NOT NULL)")
def embedding_headers(spark, d):
    c = chunks_of(spark, d).dropDuplicates(["id"]).filter("content is not null")
    return c.select("id", F.md5(T.embedding_header(F.col("file_path"), F.col("symbol_name"), F.col("language"), F.lit(None).cast("string"), F.col("content"))).alias("digest"))


# --- increments --------------------------------------------------------------------------------------------------------------------

_SNAP = "(SELECT repo_id, path, arg_{}(hash, indexed_at) AS hash FROM files GROUP BY 1, 2)"
_STATES = f"a AS (SELECT repo_id, file_path AS path, max(file_hash) AS hash FROM chunks WHERE file_hash IS NOT NULL GROUP BY 1, 2), b AS (SELECT * FROM {_SNAP.format('max')})"


def _snapshots(spark, d):
    """What the chunks say is indexed, and the current files."""
    first = chunks_of(spark, d).filter("file_hash is not null").groupBy("repo_id", F.col("file_path").alias("path")).agg(F.max("file_hash").alias("hash"))
    return first, incremental.current_files(table(spark, d, "files"))


@query(f"""WITH {_STATES} SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.repo_id = b.repo_id AND a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.hash <> b.hash""")
def index_diff(spark, d):
    """The states that were chunked against the current ones."""
    return index.diff(*_snapshots(spark, d))


@query(f"WITH {_STATES} SELECT * FROM b UNION ALL SELECT a.* FROM a ANTI JOIN b ON a.repo_id = b.repo_id AND a.path = b.path")
def index_upsert(spark, d):
    a, b = _snapshots(spark, d)
    return index.upsert(a, b.select("repo_id", "path", "hash"), ["repo_id", "path"])


@query(f"""WITH f AS {_SNAP.format('max')}, c AS (SELECT DISTINCT repo_id, file_path, file_hash FROM chunks), a(analyzer, version) AS (VALUES ('symbols', 1), ('env', 2))
SELECT f.repo_id, f.path, analyzer, hash, version FROM f, a WHERE NOT (analyzer = 'symbols' AND EXISTS (SELECT 1 FROM c WHERE c.repo_id = f.repo_id AND c.file_path = f.path AND c.file_hash = f.hash))""")
def analysis_stale(spark, d):
    """State of one analyzer stands in the chunks' hashes, the other has an old version throughout."""
    c = chunks_of(spark, d).select("repo_id", F.col("file_path").alias("path"), F.col("file_hash").alias("hash")).dropna().distinct()
    state = c.select("*", F.lit("symbols").alias("analyzer"), F.lit(1).cast("bigint").alias("version")).unionByName(c.select("*", F.lit("env").alias("analyzer"), F.lit(1).cast("bigint").alias("version")))
    return index.stale(incremental.current_files(table(spark, d, "files")), state, [("symbols", 1), ("env", 2)])


@query(f"SELECT repo_id, path, hash FROM {_SNAP.format('max')}")
def stream_index_available_now(spark, d):
    """Current files through the streaming front-end."""
    root = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "files").schema
    src = f"{d}/files.parquet"
    if not _is_folder(spark, src):
        table(spark, d, "files").write.mode("overwrite").parquet(f"{root}/in")
        src = f"{root}/in"
    return indexing.run_available(spark, src, schema, root).select("repo_id", "path", "hash")


def _is_folder(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


# --- clones and clusters ---------------------------------------------------------------------------------------------------------------


@query("WITH t AS (SELECT DISTINCT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL) SELECT * FROM (SELECT doc_id, hash, count(*) OVER (PARTITION BY hash) AS n FROM t) WHERE n > 1")
def exact_duplicate_texts(spark, d):
    return listings.exact_duplicates(table(spark, d, "documents"), "doc_id", "text")


def _function_vectors(spark, d):
    c = chunks_of(spark, d).filter(F.col("symbol_kind").isin("function", "method")).dropDuplicates(["id"])
    e = F.col("embedding")
    c = c.filter(e.isNotNull() & (F.size(e) == 64) & F.exists(e, lambda x: x != 0))
    return c.select("id", e.alias("vector"), F.concat_ws("/", "repo_id", "file_path").alias("file_path"), "start_line", "end_line", (F.col("end_line") - F.col("start_line")).alias("span"))


@query(f"""WITH v AS (SELECT c.* FROM (SELECT DISTINCT ON (id) * FROM chunks) c WHERE symbol_kind IN ('function', 'method') AND id IN (SELECT id FROM ({_VEC})))
SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS sim FROM v a JOIN v b ON a.id < b.id
WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) >= 0.8 AND NOT (a.repo_id = b.repo_id AND a.file_path = b.file_path AND a.start_line <= b.end_line AND b.start_line <= a.end_line)""")
def similar_function_pairs(spark, d):
    return clones.similar_pairs(_function_vectors(spark, d))


@query(None)
def complete_linkage_groups(spark, d):
    g = clones.linkage_groups(clones.similar_pairs(_function_vectors(spark, d)), 0.97)
    return g.select(F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), "avg_similarity")


def _boards(spark, d):
    return table(spark, d, "embeddings").select(F.col("label").alias("board"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query(None)
def cluster_topics(spark, d):
    """The vectors of each label as one board."""
    return clones.cluster_boards(_boards(spark, d), 0.3)


@query(None)
def cluster_topics_greedy(spark, d):
    return clones.cluster_boards(_boards(spark, d), 0.3, exact_limit=0)


_LSTOP = "[" + ", ".join(f"'{w}'" for w in K.LABEL_STOPWORDS) + "]"


@query(f"""WITH w AS (SELECT DISTINCT source AS cluster, doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9_]{{2,}}')) AS word FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
c AS (SELECT cluster, word, count(*) AS n FROM w WHERE NOT list_contains({_LSTOP}, word) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, word) AS k FROM c),
g AS (SELECT cluster, string_agg(word, ' ' ORDER BY k) AS l FROM r WHERE k <= 3 GROUP BY 1) SELECT cluster, upper(l[1:1]) || l[2:] AS label FROM g""")
def cluster_keyword_label(spark, d):
    return clones.keyword_labels(table(spark, d, "documents").filter("source is not null and text is not null").select(F.col("source").alias("cluster"), "text"))


# --- graphs ---------------------------------------------------------------------------------------------------------------------------------


def _mounts(spark, d):
    """Links between files: the file of an include to the file of the router its dotted target names."""
    r = table(spark, d, "endpoint_routers").select("repo_id", "file_path", "var").distinct()
    key = r.select("repo_id", F.col("file_path").alias("resolved"), F.concat_ws(".", F.regexp_replace(F.regexp_replace("file_path", r"\.[^./]*$", ""), "/", "."), "var").alias("target"))
    i = table(spark, d, "endpoint_includes").select("id", "repo_id", "file_path", "target").distinct()
    j = i.join(key, ["repo_id", "target"])
    return j.select("id", F.concat_ws("/", "repo_id", "file_path").alias("file_path"), F.concat_ws("/", "repo_id", "resolved").alias("resolved_file_path"))


_MOUNTS_SQL = """imports AS (SELECT i.id, i.repo_id || '/' || i.file_path AS src, i.repo_id || '/' || r.file_path AS dst FROM (SELECT DISTINCT id, repo_id, file_path, target FROM endpoint_includes) i
  JOIN (SELECT DISTINCT repo_id, file_path, var FROM endpoint_routers) r ON r.repo_id = i.repo_id AND replace(regexp_replace(r.file_path, '\\.[^./]*$', ''), '/', '.') || '.' || r.var = i.target)"""


@query(f"WITH {_MOUNTS_SQL} SELECT src, dst, count(*) AS weight FROM imports WHERE src <> dst GROUP BY 1, 2")
def module_graph_file(spark, d):
    return graph.module_graph(_mounts(spark, d))


@query(f"WITH {_MOUNTS_SQL}, e AS (SELECT regexp_replace(src, '/[^/]*$', '') AS src, regexp_replace(dst, '/[^/]*$', '') AS dst FROM imports) SELECT src, dst, count(*) AS weight FROM e WHERE src <> dst GROUP BY 1, 2")
def module_graph_dir(spark, d):
    return graph.module_graph(_mounts(spark, d), "dir")


@query(f"WITH {_MOUNTS_SQL}, e AS (SELECT src, dst, count(*) AS weight FROM imports WHERE src <> dst GROUP BY 1, 2), x AS (SELECT src AS node, weight FROM e UNION ALL SELECT dst, weight FROM e) SELECT node, sum(weight)::BIGINT AS degree FROM x GROUP BY 1")
def module_degree(spark, d):
    return graph.degrees(graph.module_graph(_mounts(spark, d)))


@query(f"WITH {_MOUNTS_SQL}, e AS (SELECT src, dst, count(*) AS weight FROM imports WHERE src <> dst GROUP BY 1, 2), k AS (SELECT array_to_string(string_split(src, '/')[1:2], '/') AS src, array_to_string(string_split(dst, '/')[1:2], '/') AS dst, weight FROM e) SELECT src, dst, sum(weight)::BIGINT AS weight FROM k WHERE src <> dst GROUP BY 1, 2")
def module_graph_collapsed(spark, d):
    return graph.collapse(graph.module_graph(_mounts(spark, d)), depth=2)


@query(f"""WITH {_MOUNTS_SQL}, e AS (SELECT src, dst, count(*) AS weight FROM imports WHERE src <> dst GROUP BY 1, 2), s AS (SELECT min(array_to_string(string_split(src, '/')[1:2], '/')) AS scope FROM e),
k AS (SELECT array_to_string(string_split(src, '/')[1:3], '/') AS src, CASE WHEN dst = scope OR starts_with(dst, scope || '/') THEN array_to_string(string_split(dst, '/')[1:3], '/') ELSE array_to_string(string_split(dst, '/')[1:2], '/') END AS dst, weight FROM e, s WHERE starts_with(src, scope || '/'))
SELECT src, dst, sum(weight)::BIGINT AS weight FROM k WHERE src <> dst GROUP BY 1, 2""")
def module_graph_scoped(spark, d):
    """The links out of one folder, three folders deep inside it and as deep as it outside."""
    g = graph.module_graph(_mounts(spark, d))
    scope = g.agg(F.min(F.array_join(F.slice(F.split("src", "/"), 1, 2), "/"))).first()[0] or ""
    return graph.collapse(g, scope, 3, scope.count("/") + 1)


@query(f"""WITH RECURSIVE {_MOUNTS_SQL}, e AS (SELECT DISTINCT src, dst FROM imports WHERE src <> dst), c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON e.src = c.dst),
m AS (SELECT a.src AS node, least(a.src, min(a.dst)) AS comp FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src)
SELECT array_to_string(list_sort(list(node)), ',') AS members FROM m GROUP BY comp""")
def import_cycles(spark, d):
    return graph.cycles(graph.module_graph(_mounts(spark, d))).select(F.array_join("members", ",").alias("members"))


def _router_edges(spark, d):
    n = hierarchy.router_nodes(table(spark, d, "endpoint_routers"), table(spark, d, "endpoint_includes"))
    p = table(spark, d, "endpoint_routers").select("id", "file_path", "line").dropDuplicates(["id"])
    return n.filter("parent is not null").join(p, "id").select(F.col("id").alias("src"), F.col("parent").alias("dst"), F.lit("call").alias("kind"), "file_path", "line", F.col("id").alias("seq"), F.lit("high").alias("confidence"))


@query(None)
def callers_by_depth(spark, d):
    """Who hangs below the routers with most children, level by level."""
    e = _router_edges(spark, d)
    top = [r.dst for r in e.groupBy("dst").count().orderBy(F.desc("count"), "dst").limit(3).collect()]
    return graph.traverse(e, top, 3).hits


@query(None)
def callees_by_depth(spark, d):
    e = _router_edges(spark, d)
    deep = [r.src for r in e.join(e.select(F.col("src").alias("dst")), "dst", "left_semi").orderBy("src").limit(3).collect()]
    return graph.traverse(e, deep, 5, callers=False).hits


@query(P5_NODES + ", t AS (SELECT parent FROM node GROUP BY 1 HAVING parent IS NOT NULL ORDER BY count(*) DESC, parent LIMIT 3), l1 AS (SELECT DISTINCT id FROM node WHERE parent IN (SELECT parent FROM t) AND id NOT IN (SELECT parent FROM t)), l2 AS (SELECT DISTINCT id FROM node WHERE parent IN (SELECT id FROM l1) AND id NOT IN (SELECT parent FROM t UNION ALL SELECT id FROM l1)), l3 AS (SELECT DISTINCT id FROM node WHERE parent IN (SELECT id FROM l2) AND id NOT IN (SELECT parent FROM t UNION ALL SELECT id FROM l1 UNION ALL SELECT id FROM l2)) SELECT id AS node, 1 AS depth FROM l1 UNION ALL SELECT id, 2 FROM l2 UNION ALL SELECT id, 3 FROM l3")
def caller_levels(spark, d):
    return callers_by_depth(spark, d).select("node", "depth")


@query(P5_NODES + "SELECT id AS src, parent AS dst FROM node WHERE parent IS NOT NULL AND id <> parent AND id IN (SELECT parent FROM node WHERE parent IS NOT NULL)")
def induced_edges(spark, d):
    e = _router_edges(spark, d)
    return graph.induced_edges(e, e.select(F.col("dst").alias("node")).distinct()).select("src", "dst")


@query(None)
def mermaid_modules(spark, d):
    e = graph.module_graph(_mounts(spark, d))
    return spark.createDataFrame([(diagrams.modules(e)[0],)], "text string")


# --- facts ---------------------------------------------------------------------------------------------------------------------------------


def _facts(spark, d):
    """Facts of all files, written once: several tables are made of them."""
    return cut(extract.extract(table(spark, d, "raw_files")))


@query(None)
def extracted_symbols(spark, d):
    return extract.symbols_table(_facts(spark, d)).select("id", "repo_id", "file_path", "language", "qualified_name", "kind", "start_line", "end_line", "is_test", "has_doc")


@query(None)
def extracted_calls(spark, d):
    return extract.calls_table(_facts(spark, d))


@query(None)
def extracted_env(spark, d):
    f = _facts(spark, d)
    return extract.enclosing(extract.env_table(f), extract.symbols_table(f))


@query(None)
def extracted_debt(spark, d):
    return extract.debt_table(_facts(spark, d))


@query(None)
def clone_groups(spark, d):
    s = extract.symbols_table(_facts(spark, d)).filter("norm_hash is not null")
    g = clones.exact_groups(clones.eligible(s))
    return g.select("norm_hash", "size", "duplicated_lines", "value")


def _resolved(spark, d):
    f = _facts(spark, d)
    return f, resolve.resolve_imports(f, extract.imports_table(f))


@query(None)
def resolved_imports(spark, d):
    return _resolved(spark, d)[1]


@query(None)
def resolved_calls(spark, d):
    f, t = _resolved(spark, d)
    return resolve.resolve_calls(extract.symbols_table(f), extract.calls_table(f), t)


@query(None)
def missing_docs(spark, d):
    f, t = _resolved(spark, d)
    s = extract.symbols_table(f)
    return listings.missing_docs(s, resolve.references(s, extract.calls_table(f), t)).select("id", "qualified_name", "file_path", "start_line", "callers")


@query(None)
def symbol_search(spark, d):
    f, t = _resolved(spark, d)
    s = extract.symbols_table(f)
    return listings.symbol_search(s, resolve.references(s, extract.calls_table(f), t), "parse").select("id", "name", "score", "callers")


@query(None)
def endpoints_from_sources(spark, d):
    raw = table(spark, d, "raw_files")
    r = routes.detect_files(raw)
    f, t = _resolved(spark, d)
    b = routes.bindings(extract.imports_table(f), t)
    return routes.build_endpoints(routes.table_of(r, "routes"), routes.table_of(r, "routers"), routes.table_of(r, "includes"), b, extract.symbols_table(f))


@query("SELECT DISTINCT doc_id AS id, true AS ok, '\"\"\"Stores ' || source || '.' || chr(10) || chr(10) || 'Args:' || chr(10) || '    ctx: The context' || chr(10) || '\"\"\"' || chr(10) AS comment FROM documents WHERE source IS NOT NULL")
def rendered_docs(spark, d):
    a = table(spark, d, "documents").filter("source is not null").select(F.col("doc_id").alias("id"), F.concat(F.lit("Summary: Stores "), "source", F.lit("\nParam ctx: The context")).alias("answer"), F.lit("def store(self, ctx, *rest)").alias("signature"), F.lit("python").alias("language"), F.lit("store").alias("name"))
    return docs.documented(a).select("id", "ok", "comment").distinct()


@query("SELECT framework, count(*) AS routers FROM (SELECT DISTINCT id, framework FROM endpoint_routers) GROUP BY 1")
def framework_facet(spark, d):
    r = table(spark, d, "endpoint_routers").select("id", "framework").distinct().withColumn("method", F.lit("GET"))
    return routes.facets(r).filter("facet = 'framework'").select(F.col("value").alias("framework"), F.col("count").alias("routers"))


# --- listings ------------------------------------------------------------------------------------------------------------------------------------

_ENV = """e AS (SELECT DISTINCT name, file_path, line, default_value, is_secret, required FROM env_vars WHERE name IS NOT NULL),
g AS (SELECT name, bool_or(coalesce(is_secret, false)) AS is_secret, bool_or(coalesce(required, false)) AS required, count(DISTINCT default_value) AS nd, min(default_value) AS d1, count(*) AS usages FROM (SELECT DISTINCT name, file_path, line, default_value, required, is_secret FROM e) GROUP BY 1)"""


@query(f"WITH {_ENV} SELECT name, is_secret, required, CASE WHEN nd = 1 AND NOT is_secret THEN d1 END AS \"default\", nd > 1 AS default_varies FROM g")
def env_vars_grouped(spark, d):
    return listings.env_variables(table(spark, d, "env_vars")).select("name", "is_secret", "required", "default", "default_varies")


@query("""WITH u AS (SELECT DISTINCT name, file_path, line, default_value, is_secret, required FROM env_vars WHERE name IS NOT NULL), m AS (SELECT name, CASE WHEN contains(file_path, '/') THEN string_split(file_path, '/')[1] ELSE '(root)' END AS module, count(*) AS n FROM u GROUP BY 1, 2)
SELECT name, module FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, module) AS k FROM m) WHERE k = 1""")
def env_modules(spark, d):
    return listings.env_modules(listings.env_variables(table(spark, d, "env_vars")))


@query("""WITH e AS (SELECT DISTINCT name, file_path, line, default_value, required, is_secret FROM env_vars WHERE name IS NOT NULL), e2 AS (SELECT DISTINCT name, file_path, line, default_value, is_secret, required FROM e),
u AS (SELECT name, list(file_path || ':' || line ORDER BY file_path, line, default_value NULLS FIRST) AS p, bool_or(coalesce(is_secret, false)) AS secret, bool_or(coalesce(required, false)) AS req, count(DISTINCT default_value) AS nd, min(default_value) AS d1 FROM e2 GROUP BY 1),
m0 AS (SELECT name, CASE WHEN contains(file_path, '/') THEN string_split(file_path, '/')[1] ELSE '(root)' END AS module, count(*) AS n FROM e2 GROUP BY 1, 2),
m AS (SELECT name, module FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, module) AS k FROM m0) WHERE k = 1),
l AS (SELECT module, u.name, '# ' || CASE WHEN req THEN 'required' ELSE 'optional' END || '. Used in ' || array_to_string(p[1:3], ', ') || CASE WHEN len(p) > 3 THEN ' (+' || (len(p) - 3) || ' more)' ELSE '' END || chr(10)
  || CASE WHEN secret THEN '# Secret: set a real value; never commit it.' || chr(10) || u.name || '=' ELSE u.name || '=' || CASE WHEN nd = 1 THEN CASE WHEN regexp_matches(d1, '[\\s#''"$\\\\]') THEN '"' || replace(replace(d1, '\\', '\\\\'), '"', '\\"') || '"' ELSE d1 END ELSE '' END END || chr(10) AS s FROM u JOIN m USING (name))
SELECT module, '# ---- ' || module || ' ----' || chr(10) || chr(10) || string_agg(s, chr(10) ORDER BY name) AS text FROM l GROUP BY 1""")
def env_example(spark, d):
    return listings.env_example(listings.env_variables(table(spark, d, "env_vars")))


_DEBT = """items AS (SELECT ['TODO', 'FIXME', 'HACK', 'XXX', 'BUG', 'NOTE'][1 + doc_id % 5] AS tag, replace(coalesce(text, ''), chr(10), ' ') AS text, coalesce(source, 'none') || '/' || coalesce(lang, 'xx') || '/' || doc_id || '.md' AS file_path, (1 + doc_id % 90)::INT AS line,
  epoch(updated_at)::DOUBLE AS commit_date, coalesce(source, '') AS author FROM documents)"""


def _debt(spark, d):
    x = table(spark, d, "documents")
    tag = F.element_at(F.array(*map(F.lit, K.DEBT_TAGS)), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("xx")), F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return x.select(tag.alias("tag"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")).alias("text"), path.alias("file_path"), (F.col("doc_id") % 90 + 1).cast("int").alias("line"), F.unix_timestamp(F.col("updated_at").cast("timestamp")).cast("double").alias("commit_date"), F.coalesce("source", F.lit("")).alias("author"), F.lit("").alias("symbol"), F.lit("").alias("assignee"))


@query(f"WITH {_DEBT}, dim(key, position) AS (VALUES ('TODO', 0), ('FIXME', 1), ('HACK', 2), ('XXX', 3), ('BUG', 4), ('NOTE', 5)) SELECT position, key, count(tag) AS count FROM dim LEFT JOIN items ON tag = key GROUP BY 1, 2")
def debt_board_tag(spark, d):
    return listings.debt_groups(listings.debt_items(_debt(spark, d), NOW), "tag")


@query(f"WITH {_DEBT} SELECT 0 AS position, string_split(file_path, '/')[1] || '/' || string_split(file_path, '/')[2] AS key, count(*) AS count FROM items GROUP BY 2")
def debt_board_folder(spark, d):
    return listings.debt_groups(listings.debt_items(_debt(spark, d), NOW), "folder")


@query(f"""WITH {_DEBT}, a AS (SELECT CASE WHEN commit_date IS NULL OR commit_date = 0 THEN NULL ELSE ({NOW} - commit_date) / 86400 END AS age FROM items),
b AS (SELECT CASE WHEN age IS NULL THEN 4 WHEN age < 30 THEN 0 WHEN age < 180 THEN 1 WHEN age < 365 THEN 2 ELSE 3 END AS position FROM a)
SELECT position, ['Last 30 days', '1 to 6 months', '6 to 12 months', 'Over a year', 'Unknown age'][position + 1] AS key, count(*) AS count FROM b GROUP BY 1""")
def debt_board_age(spark, d):
    return listings.debt_groups(listings.debt_items(_debt(spark, d), NOW), "age")


@query(f"WITH {_DEBT}, dim(t) AS (VALUES ('TODO'), ('FIXME'), ('HACK'), ('XXX'), ('BUG'), ('NOTE')) SELECT 'total' AS counter, count(*) AS value FROM items UNION ALL SELECT 'dated', count(commit_date) FROM items UNION ALL SELECT 'tag:' || t, count(tag) FROM dim LEFT JOIN items ON tag = t GROUP BY t")
def debt_counters(spark, d):
    return listings.debt_counters(listings.debt_items(_debt(spark, d), NOW))


@query(f"WITH {_DEBT} SELECT file_path, line FROM items WHERE tag = 'HACK' AND contains(lower(concat_ws(' ', text, file_path, '')), 'wiki') AND commit_date IS NOT NULL AND ({NOW} - commit_date) / 86400 > 100")
def debt_filtered(spark, d):
    return listings.debt_items(_debt(spark, d), NOW, tag="hack", q="Wiki", older_than_days=100).select("file_path", "line")


@query(f"""WITH {_DEBT}, n AS (SELECT tag, count(*) AS n FROM items GROUP BY 1)
SELECT tag AS section, 2 AS part, '- ' || CASE WHEN text = '' THEN '(no text)' ELSE text END || ' `' || file_path || ':' || line || '`' || CASE WHEN author <> '' THEN ' (' || author || ')' ELSE '' END AS row FROM items
UNION ALL SELECT tag, 0, '## ' || tag || ' (' || n || ')' FROM n UNION ALL SELECT tag, 1, '' FROM n UNION ALL SELECT tag, 3, '' FROM n
UNION ALL SELECT '', 0, '# Tech debt' UNION ALL SELECT '', 1, '' UNION ALL SELECT '', 2, (SELECT count(*) FROM items) || ' items' UNION ALL SELECT '', 3, ''""")
def export_debt_markdown(spark, d):
    return listings.debt_markdown(listings.debt_items(_debt(spark, d), NOW))


@query(f"""WITH {_DEBT}, a AS (SELECT *, CASE WHEN commit_date IS NULL OR commit_date = 0 THEN '' ELSE CASE WHEN round_even(({NOW} - commit_date) / 86400, 0)::INT = 0 THEN '' ELSE round_even(({NOW} - commit_date) / 86400, 0)::INT::VARCHAR END END AS age FROM items),
q AS (SELECT *, CASE WHEN regexp_matches(text, '[",\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS t FROM a) SELECT tag || ',' || t || ',' || file_path || ',' || line || ',,' || author || ',,' || age AS row FROM q""")
def export_debt_csv(spark, d):
    return listings.debt_csv(listings.debt_items(_debt(spark, d), NOW))


@query("""SELECT 'files' AS counter, count(*) AS value FROM (SELECT DISTINCT repo_id, path FROM files) UNION ALL SELECT 'chunks', count(DISTINCT id) FROM chunks UNION ALL SELECT 'env_names', count(DISTINCT name) FROM env_vars
UNION ALL SELECT 'env_secrets', count(DISTINCT name) FROM env_vars WHERE is_secret UNION ALL SELECT 'routers', count(DISTINCT id) FROM endpoint_routers""")
def overview_counts(spark, d):
    return listings.overview({"files": table(spark, d, "files"), "chunks": chunks_of(spark, d), "env": table(spark, d, "env_vars"), "routers": table(spark, d, "endpoint_routers")})


# --- conversations -------------------------------------------------------------------------------------------------------------------------------


def _messages(spark, d):
    x = table(spark, d, "documents").filter("repo_id is not null")
    return x.select(F.col("doc_id").alias("id"), F.col("repo_id").alias("conversation_id"), F.when(F.col("doc_id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.coalesce("text", F.lit("")).alias("content"), F.lit(None).cast("string").alias("meta"), F.col("doc_id").cast("double").alias("created_at"))


@query("SELECT id, conversation_id FROM (SELECT doc_id AS id, repo_id AS conversation_id, row_number() OVER (PARTITION BY repo_id ORDER BY doc_id DESC) AS k FROM documents WHERE repo_id IS NOT NULL) WHERE k <= 4")
def history_last4(spark, d):
    return conversations.last_messages(_messages(spark, d)).select("id", "conversation_id")


@query("SELECT doc_id AS id, repo_id AS conversation_id FROM documents d LEFT JOIN (SELECT repo_id AS r, max(doc_id) AS last FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) l ON l.r = d.repo_id WHERE repo_id IS NOT NULL AND (last IS NULL OR doc_id < last)")
def delete_last_exchange(spark, d):
    return conversations.delete_last_exchange(_messages(spark, d)).select("id", "conversation_id")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(S)
