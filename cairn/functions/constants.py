"""Names, patterns and limits that results depend on."""

# fmt: off
GRAMMAR_LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx", ".go": "go", ".java": "java", ".cs": "csharp"}
OTHER_LANGUAGES = {".md": "markdown", ".rs": "rust", ".rb": "ruby", ".php": "php", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".kt": "kotlin", ".swift": "swift", ".sql": "sql", ".sh": "bash", ".yml": "yaml", ".yaml": "yaml", ".toml": "toml", ".json": "json", ".html": "html", ".css": "css", ".scss": "scss", ".vue": "vue", ".svelte": "svelte"}
SKIP_DIRS = ["node_modules", "dist", "build", "out", "target", "bin", "obj", "venv", "env", "__pycache__", "coverage"]
LOCKFILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "poetry.lock", "uv.lock", "Pipfile.lock", "Cargo.lock", "composer.lock", "Gemfile.lock", "go.sum", "packages.lock.json"]
BINARY_SUFFIXES = [".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".webp", ".svg", ".pdf", ".zip", ".gz", ".tar", ".7z", ".rar", ".exe", ".dll", ".so", ".dylib", ".bin", ".class", ".jar", ".pyc", ".o", ".a", ".lib", ".woff", ".woff2", ".ttf", ".otf", ".eot", ".mp3", ".mp4", ".wav", ".mov", ".avi", ".db", ".sqlite", ".onnx", ".pt", ".safetensors", ".npy", ".parquet", ".pem", ".key", ".p12", ".pfx", ".jks", ".keystore", ".env"]
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "can", "do", "does", "for", "from", "how", "i", "in", "is", "it", "me", "of", "on", "or", "show", "that", "the", "this", "to", "what", "when", "where", "which", "who", "why", "with", "work", "works", "project", "code", "used"]
TEST_DIRS = ["tests", "test", "__tests__", "spec", "specs", "testing", "e2e"]
TEST_FILE = r"(^test_.*\.py$)|(_test\.py$)|(^conftest\.py$)|(_test\.go$)|(\.(test|spec)\.[cm]?[jt]sx?$)|((Test|Tests|IT)\.java$)|((Test|Tests)\.cs$)"
VENDORED_DIRS = ["vendor", "third_party", "third-party", "node_modules", "site-packages", "generated", "gen", "migrations", "__generated__", "dist", "build"]
TEST_ANNOTATIONS = ["Test", "ParameterizedTest", "RepeatedTest", "TestFactory", "Fact", "Theory", "TestMethod", "TestCase", "TestCaseSource", "DataTestMethod"]
TEST_CLASS_ATTRIBUTES = ["TestFixture", "TestClass"]
GO_TEST = r"^(Test|Benchmark|Example|Fuzz)([A-Z_0-9].*)?$"
SECRET_TOKENS = ["KEY", "TOKEN", "SECRET", "PASSWORD", "PASSWD", "PWD", "CREDENTIAL", "CREDENTIALS", "PRIVATE", "APIKEY", "DSN", "SALT", "PASSPHRASE"]
BENIGN_TOKENS = ["TTL", "EXPIRES", "EXPIRY", "EXPIRATION", "TIMEOUT", "DURATION", "LIFETIME", "SECONDS", "MINUTES", "HOURS", "DAYS", "LENGTH", "SIZE", "COUNT", "ENABLED", "ENABLE", "ALGORITHM", "HEADER", "PREFIX", "MAX", "MIN", "LIMIT", "ROUNDS", "ITERATIONS"]
CREDENTIAL_URL = r"://[^/\s:@]+:[^/\s@]+@"
DEBT_TAGS = ["TODO", "FIXME", "HACK", "XXX", "BUG", "NOTE"]
DOC_MARKS = {"javascript": ("/**",), "typescript": ("/**",), "tsx": ("/**",), "go": ("//", "/*"), "java": ("/**",), "csharp": ("///", "/**")}
DEBT_STYLES = {  # where a tag stands in a line, and the sign between it and its text
    "comment": (r"^[\s/*#\-;!<>]*", r"\s*[:\-–—]?\s*"),
    "marked": (r"(?:(?:^|\s)(?://+|#+|--+|;+|/\*+|<!--)|^\s*\*)\s*", r"\s*[:\-–—]?\s*"),
    "prose": (r"^\s*(?:[-*+]\s+)?(?:\[[ xX]\]\s*)?", r"\s*[:\-–—]\s*"),
}
MAX_MARKED_LINE, MAX_DEBT_TEXT = 2000, 300
LABEL_STOPWORDS = ["the", "a", "an", "and", "or", "to", "of", "in", "on", "for", "is", "it", "this", "that", "we", "be", "with", "as", "at", "by", "from", "not", "should", "need", "needs", "make", "use", "when", "if", "are", "was", "will", "can", "add", "fix", "later", "here", "there", "todo", "fixme", "hack", "xxx", "bug", "note"]
METHOD_ORDER = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "WS", "ANY"]
FRAMEWORK_LABELS = {"fastapi": "FastAPI", "flask": "Flask", "express": "Express", "fastify": "Fastify", "koa": "Koa", "nest": "NestJS", "spring": "Spring", "nethttp": "net/http", "gin": "Gin", "chi": "chi", "echo": "Echo", "aspnet": "ASP.NET"}
SELF_RECEIVERS = ["self", "this", "cls", "super", "base", "Self"]
COMMON_METHODS = ["get", "set", "add", "append", "extend", "insert", "remove", "pop", "clear", "update", "keys", "values", "items", "copy", "join", "split", "strip", "lstrip", "rstrip", "replace", "startswith", "endswith", "lower", "upper", "encode", "decode", "format", "read", "write", "close", "flush", "seek", "count", "index", "find", "sort", "reverse", "then", "catch", "map", "filter", "reduce", "forEach", "push", "shift", "slice", "splice", "includes", "toString", "equals", "hashCode", "length", "size", "contains", "put", "next", "json", "text", "trim", "toLowerCase", "toUpperCase", "ToString", "Equals", "GetHashCode", "Add", "Remove", "Contains", "Count", "Clear", "First", "Where", "Select", "ToList"]
CONFIDENCES = ["low", "medium", "high"]
DEPTH_WEIGHTS = [1.0, 0.5, 0.25, 0.125, 0.0625]
CONFIDENCE_WEIGHTS = {"high": 1.0, "medium": 0.6, "low": 0.3}
# fmt: on

CANDIDATES, RRF_K, TOP_K, RELEVANCE = 20, 60, 6, 0.35
BM25_K1, BM25_B = 1.2, 0.75
MAX_BFS_NODES, MAX_CALL_CANDIDATES, MAX_IMPORT_MATCHES, MAX_GROUP = 300, 5, 3, 40
PAIR_FLOOR, DEFAULT_SIMILARITY, MIN_LINES, MIN_TOKENS = 0.80, 0.90, 5, 12
