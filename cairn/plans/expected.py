"""Rows of the fixture queries, recorded from a run and checked by reading the fixture: columns with SQL types, then rows."""

# fmt: off
EXPECTED: dict[str, tuple[str, list[tuple]]] = {
    "fixture_symbols": ("file_path VARCHAR, qualified_name VARCHAR, kind VARCHAR, owner VARCHAR, start_line INTEGER, end_line INTEGER, is_test BOOLEAN, has_doc BOOLEAN", [
        ('jvm/OrderController.java', 'OrderController', 'class', None, 7, 12, False, False),
        ('jvm/OrderController.java', 'OrderController.find', 'method', 'OrderController', 11, 11, False, False),
        ('jvm/OrderController.java', 'OrderController.one', 'method', 'OrderController', 8, 9, False, False),
        ('net/Ping.cs', 'Ping', 'class', None, 5, 10, False, False),
        ('net/Ping.cs', 'Ping.Send', 'method', 'Ping', 8, 8, False, False),
        ('net/Ping.cs', 'Ping.Twice', 'method', 'Ping', 9, 9, False, False),
        ('shop/api.py', 'add_item', 'function', None, 12, 15, False, True),
        ('shop/api.py', 'read_item', 'function', None, 7, 9, False, False),
        ('shop/api.py', 'refill', 'function', None, 18, 24, False, False),
        ('shop/app.py', 'health', 'function', None, 13, 15, False, False),
        ('shop/app.py', 'unlinked', 'function', None, 18, 19, False, False),
        ('shop/store.py', 'Shelf', 'class', None, 18, 20, False, False),
        ('shop/store.py', 'Shelf.add', 'method', 'Shelf', 19, 20, False, False),
        ('shop/store.py', 'Store', 'class', None, 7, 15, False, True),
        ('shop/store.py', 'Store.add', 'method', 'Store', 10, 12, False, False),
        ('shop/store.py', 'Store.total', 'method', 'Store', 14, 15, False, False),
        ('shop/store.py', 'restock', 'function', None, 23, 29, False, False),
        ('svc/main.go', 'main', 'function', None, 9, 12, False, True),
        ('svc/main.go', 'ping', 'function', None, 14, 16, False, False),
        ('svc/main.go', 'write', 'function', None, 18, 18, False, False),
        ('tests/test_store.py', 'test_restock', 'function', None, 4, 5, True, False),
        ('web/api.ts', 'get', 'function', None, 2, 4, False, True),
        ('web/client.ts', 'View', 'class', None, 10, 15, False, False),
        ('web/client.ts', 'View.draw', 'method', 'View', 14, 14, False, False),
        ('web/client.ts', 'View.render', 'method', 'View', 11, 13, False, False),
        ('web/client.ts', 'load', 'function', None, 5, 8, False, False),
        ('web/lib/format.ts', 'format', 'function', None, 2, 2, False, False),
        ('web/routes/users.js', 'create', 'function', None, 5, 5, False, False),
        ('web/server.js', 'purge', 'function', None, 6, 6, False, False),
    ]),
    "fixture_imports": ("file_path VARCHAR, module VARCHAR, target VARCHAR, bind VARCHAR", [
        ('shop/api.py', 'shop.store', 'shop/store.py', 'store'),
        ('shop/app.py', 'shop', 'shop/__init__.py', 'shop'),
        ('shop/app.py', 'shop', 'shop/store.py', 'store'),
        ('shop/app.py', 'shop.api', 'shop/api.py', 'api'),
        ('shop/app.py', 'shop.store', 'shop/store.py', 'store'),
        ('tests/test_store.py', 'shop.store', 'shop/store.py', 'store'),
        ('web/client.ts', './api', 'web/api.ts', 'api'),
        ('web/client.ts', './lib/format', 'web/lib/format.ts', None),
        ('web/server.js', './routes/users', 'web/routes/users.js', 'users'),
    ]),
    "fixture_calls": ("file_path VARCHAR, from_name VARCHAR, to_name VARCHAR, kind VARCHAR, line INTEGER, target VARCHAR, confidence VARCHAR", [
        ('jvm/OrderController.java', 'OrderController.one', 'find', 'call', 9, 'jvm/OrderController.java:OrderController.find', 'high'),
        ('net/Ping.cs', 'Ping.Send', 'Twice', 'call', 8, 'net/Ping.cs:Ping.Twice', 'high'),
        ('shop/api.py', 'add_item', 'Store', 'call', 15, 'shop/store.py:Store', 'high'),
        ('shop/api.py', 'add_item', 'add', 'call', 15, 'shop/store.py:Store.add', 'medium'),
        ('shop/api.py', 'read_item', 'Store', 'call', 9, 'shop/store.py:Store', 'high'),
        ('shop/api.py', 'read_item', 'total', 'call', 9, 'shop/store.py:Store.total', 'medium'),
        ('shop/api.py', 'refill', 'Store', 'call', 23, 'shop/store.py:Store', 'high'),
        ('shop/api.py', 'refill', 'add', 'call', 23, 'shop/store.py:Store.add', 'medium'),
        ('shop/api.py', 'refill', 'append', 'call', 23, None, 'low'),
        ('shop/api.py', None, 'APIRouter', 'call', 4, None, 'low'),
        ('shop/api.py', None, 'get', 'call', 7, None, 'low'),
        ('shop/api.py', None, 'post', 'call', 12, None, 'low'),
        ('shop/app.py', 'health', 'fill', 'call', 15, None, 'low'),
        ('shop/app.py', 'health', 'restock', 'call', 15, 'shop/store.py:restock', 'high'),
        ('shop/app.py', 'unlinked', 'away', 'call', 19, None, 'low'),
        ('shop/app.py', None, 'FastAPI', 'call', 7, None, 'low'),
        ('shop/app.py', None, 'get', 'call', 13, None, 'low'),
        ('shop/app.py', None, 'getenv', 'call', 10, None, 'low'),
        ('shop/app.py', None, 'getenv', 'call', 9, None, 'low'),
        ('shop/app.py', None, 'include_router', 'call', 8, None, 'low'),
        ('shop/store.py', 'Shelf', 'Store', 'inherit', 18, 'shop/store.py:Store', 'high'),
        ('shop/store.py', 'Shelf.add', 'add', 'call', 20, 'shop/store.py:Store.add', 'medium'),
        ('shop/store.py', 'Shelf.add', 'super', 'call', 20, None, 'low'),
        ('shop/store.py', 'Store.add', 'total', 'call', 12, 'shop/store.py:Store.total', 'high'),
        ('shop/store.py', 'Store.total', 'len', 'call', 15, None, 'low'),
        ('shop/store.py', 'restock', 'Store', 'call', 28, 'shop/store.py:Store', 'high'),
        ('shop/store.py', 'restock', 'add', 'call', 28, 'shop/store.py:Store.add', 'medium'),
        ('shop/store.py', 'restock', 'append', 'call', 28, None, 'low'),
        ('svc/main.go', 'main', 'Getenv', 'call', 11, None, 'low'),
        ('svc/main.go', 'main', 'HandleFunc', 'call', 10, None, 'low'),
        ('svc/main.go', 'main', 'ListenAndServe', 'call', 11, None, 'low'),
        ('svc/main.go', 'ping', 'write', 'call', 15, 'svc/main.go:write', 'high'),
        ('tests/test_store.py', 'test_restock', 'restock', 'call', 5, 'shop/store.py:restock', 'high'),
        ('web/api.ts', 'get', 'fetch', 'call', 3, None, 'low'),
        ('web/api.ts', 'get', 'text', 'call', 3, None, 'low'),
        ('web/client.ts', 'View.draw', 'String', 'call', 14, None, 'low'),
        ('web/client.ts', 'View.draw', 'format', 'call', 14, 'web/lib/format.ts:format', 'high'),
        ('web/client.ts', 'View.render', 'draw', 'call', 12, 'web/client.ts:View.draw', 'high'),
        ('web/client.ts', 'load', 'format', 'call', 7, 'web/lib/format.ts:format', 'high'),
        ('web/client.ts', 'load', 'get', 'call', 7, 'web/api.ts:get', 'high'),
        ('web/lib/format.ts', 'format', 'trim', 'call', 2, None, 'low'),
        ('web/routes/users.js', 'create', 'end', 'call', 5, None, 'low'),
        ('web/routes/users.js', None, 'Router', 'call', 2, None, 'low'),
        ('web/routes/users.js', None, 'get', 'call', 3, None, 'low'),
        ('web/routes/users.js', None, 'json', 'call', 3, None, 'low'),
        ('web/routes/users.js', None, 'post', 'call', 4, None, 'low'),
        ('web/routes/users.js', None, 'require', 'call', 1, None, 'low'),
        ('web/server.js', 'purge', 'end', 'call', 6, None, 'low'),
        ('web/server.js', None, 'express', 'call', 3, None, 'low'),
        ('web/server.js', None, 'require', 'call', 1, None, 'low'),
        ('web/server.js', None, 'require', 'call', 2, None, 'low'),
        ('web/server.js', None, 'use', 'call', 4, None, 'low'),
    ]),
    "fixture_env": ("file_path VARCHAR, name VARCHAR, line INTEGER, default_value VARCHAR, required BOOLEAN, is_secret BOOLEAN, symbol VARCHAR", [
        ('shop/app.py', 'APP_TOKEN', 9, None, False, True, None),
        ('shop/app.py', 'PORT', 10, '8080', False, False, None),
        ('shop/store.py', 'STOCK_LIMIT', 4, None, True, False, None),
        ('svc/main.go', 'ADDR', 11, None, True, False, 'main'),
        ('web/client.ts', 'API_URL', 6, 'http://localhost', False, False, 'load'),
    ]),
    "fixture_debt": ("file_path VARCHAR, tag VARCHAR, text VARCHAR, line INTEGER, assignee VARCHAR, symbol VARCHAR", [
        ('deploy.sh', 'FIXME', 'restart only what changed', 2, None, None),
        ('net/Ping.cs', 'XXX', 'unused', 7, None, 'Ping'),
        ('notes.md', 'TODO', 'write the guide', 3, None, None),
        ('shop/app.py', 'FIXME', 'who calls this?', 19, None, 'unlinked'),
        ('shop/store.py', 'TODO', 'check the count', 11, 'mia', 'Store.add'),
        ('svc/main.go', 'BUG', 'no timeout', 8, None, None),
        ('web/client.ts', 'HACK', 'retry once - the server is slow', 4, None, None),
        ('web/lib/format.ts', 'NOTE', 'keep in step with the printed form', 1, None, None),
    ]),
    "fixture_endpoints": ("method VARCHAR, path VARCHAR, handler VARCHAR, framework VARCHAR, file_path VARCHAR, partial BOOLEAN, linked BOOLEAN", [
        ('ANY', '/ping', 'ping', 'nethttp', 'svc/main.go', False, True),
        ('DELETE', '/cache', 'purge', 'express', 'web/server.js', False, True),
        ('GET', '/api/users/:id', '(inline)', 'express', 'web/routes/users.js', False, False),
        ('GET', '/health', 'health', 'fastapi', 'shop/app.py', False, True),
        ('GET', '/orders/{id}', 'OrderController.one', 'spring', 'jvm/OrderController.java', False, True),
        ('GET', '/v2/items/{item_id}', 'read_item', 'fastapi', 'shop/api.py', False, True),
        ('POST', '/api/users/', 'create', 'express', 'web/routes/users.js', False, True),
        ('POST', '/v2/items/', 'add_item', 'fastapi', 'shop/api.py', False, True),
    ]),
    "fixture_missing_docs": ("qualified_name VARCHAR, file_path VARCHAR, callers BIGINT", [
        ('OrderController', 'jvm/OrderController.java', 0),
        ('Ping', 'net/Ping.cs', 0),
        ('Shelf', 'shop/store.py', 0),
        ('Store.add', 'shop/store.py', 4),
        ('View', 'web/client.ts', 0),
        ('View.render', 'web/client.ts', 0),
        ('health', 'shop/app.py', 0),
        ('load', 'web/client.ts', 0),
        ('ping', 'svc/main.go', 0),
        ('read_item', 'shop/api.py', 0),
        ('refill', 'shop/api.py', 0),
        ('restock', 'shop/store.py', 2),
    ]),
    "fixture_symbol_search": ("qualified_name VARCHAR, score INTEGER, callers BIGINT", [
        ('Store', 100, 5),
        ('Store.add', 70, 4),
        ('Store.total', 70, 2),
    ]),
    "fixture_clones": ("members VARCHAR, size INTEGER, duplicated_lines INTEGER, value DOUBLE", [
        ('shop/api.py:18,shop/store.py:23', 2, 7, 14.0),
    ]),
    "fixture_linkage": ("members VARCHAR, avg_similarity DOUBLE", [
        ('1,2,3', 0.989),
        ('4,5', 0.995),
    ]),
    "fixture_impact": ("depth INTEGER, confidence VARCHAR, qualified_name VARCHAR, file_path VARCHAR, is_test BOOLEAN", [
        (1, 'high', 'Store.add', 'shop/store.py', False),
        (1, 'medium', 'read_item', 'shop/api.py', False),
        (2, 'medium', 'Shelf.add', 'shop/store.py', False),
        (2, 'medium', 'add_item', 'shop/api.py', False),
        (2, 'medium', 'refill', 'shop/api.py', False),
        (2, 'medium', 'restock', 'shop/store.py', False),
        (3, 'medium', 'health', 'shop/app.py', False),
        (3, 'medium', 'test_restock', 'tests/test_store.py', True),
    ]),
    "fixture_impact_summary": ("total BIGINT, direct BIGINT, files BIGINT, production_files BIGINT, low_confidence BIGINT, tests BIGINT, score DOUBLE, level VARCHAR, unresolved_same_name INTEGER, truncated BOOLEAN", [
        (8, 2, 4, 3, 0, 1, 2.95, 'Low', 0, False),
    ]),
    "fixture_docs": ("id BIGINT, style VARCHAR, ok BOOLEAN, error VARCHAR, comment VARCHAR, params VARCHAR", [
        (1, 'google', True, None, '"""adds things.\n\nArgs:\n    a: the first\n    rest: others\n\nReturns:\n    the sum\n"""\n', 'a,rest'),
        (1, 'numpy', True, None, '"""adds things.\n\nParameters\n----------\na\n    the first\nrest\n    others\n\nReturns\n-------\n    the sum\n"""\n', 'a,rest'),
        (1, 'rest', True, None, '"""adds things.\n\n:param a: the first\n:param rest: others\n:returns: the sum\n"""\n', 'a,rest'),
        (2, 'google', True, None, '// Add adds one.\n', 'a'),
        (2, 'numpy', True, None, '// Add adds one.\n', 'a'),
        (2, 'rest', True, None, '// Add adds one.\n', 'a'),
        (3, 'google', True, None, '/**\n * adds.\n *\n * @param a first\n * @return sum\n */\n', 'a'),
        (3, 'numpy', True, None, '/**\n * adds.\n *\n * @param a first\n * @return sum\n */\n', 'a'),
        (3, 'rest', True, None, '/**\n * adds.\n *\n * @param a first\n * @return sum\n */\n', 'a'),
        (4, 'google', True, None, '/// <summary>\n/// a &lt; b.\n/// </summary>\n/// <param name="xs">many &amp; more</param>\n', 'xs'),
        (4, 'numpy', True, None, '/// <summary>\n/// a &lt; b.\n/// </summary>\n/// <param name="xs">many &amp; more</param>\n', 'xs'),
        (4, 'rest', True, None, '/// <summary>\n/// a &lt; b.\n/// </summary>\n/// <param name="xs">many &amp; more</param>\n', 'xs'),
        (5, 'google', True, None, '/**\n * Goes!\n *\n * @param ys the rest\n */\n', 'x,ys'),
        (5, 'numpy', True, None, '/**\n * Goes!\n *\n * @param ys the rest\n */\n', 'x,ys'),
        (5, 'rest', True, None, '/**\n * Goes!\n *\n * @param ys the rest\n */\n', 'x,ys'),
        (6, 'google', False, 'y is no parameter', None, 'x'),
        (6, 'numpy', False, 'y is no parameter', None, 'x'),
        (6, 'rest', False, 'y is no parameter', None, 'x'),
        (7, 'google', False, 'a code block is no documentation', None, 'x'),
        (7, 'numpy', False, 'a code block is no documentation', None, 'x'),
        (7, 'rest', False, 'a code block is no documentation', None, 'x'),
        (8, 'google', False, 'there is no summary', None, 'x'),
        (8, 'numpy', False, 'there is no summary', None, 'x'),
        (8, 'rest', False, 'there is no summary', None, 'x'),
        (9, 'google', False, 'the text would end a comment', None, ''),
        (9, 'numpy', False, 'the text would end a comment', None, ''),
        (9, 'rest', False, 'the text would end a comment', None, ''),
    ]),
    "fixture_chunks": ("file_path VARCHAR, symbol_name VARCHAR, symbol_kind VARCHAR, start_line INTEGER, end_line INTEGER", [
        ('broken.py', None, 'module', 1, 1),
        ('deploy.sh', None, 'block', 1, 3),
        ('jvm/OrderController.java', 'OrderController', 'block', 1, 12),
        ('net/Ping.cs', 'Ping', 'block', 1, 11),
        ('notes.md', None, 'block', 1, 5),
        ('shop/api.py', 'read_item, add_item, refill', 'block', 1, 24),
        ('shop/app.py', 'health, unlinked', 'block', 1, 19),
        ('shop/store.py', 'Store, Shelf, restock', 'block', 1, 29),
        ('svc/main.go', 'main, ping, write', 'block', 1, 18),
        ('tests/test_store.py', 'test_restock', 'block', 1, 5),
        ('web/api.ts', 'get', 'block', 1, 4),
        ('web/client.ts', 'load, View', 'block', 1, 15),
        ('web/lib/format.ts', 'format', 'block', 1, 2),
        ('web/routes/users.js', 'create', 'block', 1, 6),
        ('web/server.js', 'purge', 'block', 1, 6),
    ]),
    "fixture_duplicates": ("type VARCHAR, members VARCHAR, size INTEGER, duplicated_lines INTEGER, avg_similarity DOUBLE, value DOUBLE", [
        ('exact', 'shop/api.py:18,shop/store.py:23', 2, 11, 1.0, 22.0),
        ('exact', 'web/routes/users.js:5,web/server.js:6', 2, 5, 1.0, 10.0),
        ('similar', 'shop/api.py:7,shop/app.py:13', 2, 7, 0.95, 14.0),
    ]),
    "fixture_top_callers": ("file_path VARCHAR, qualified_name VARCHAR, callers VARCHAR", [
        ('jvm/OrderController.java', 'OrderController.find', 'OrderController.one'),
        ('net/Ping.cs', 'Ping.Twice', 'Ping.Send'),
        ('shop/store.py', 'Store', 'read_item,add_item,refill'),
        ('shop/store.py', 'Store.add', 'add_item,refill,Shelf.add'),
        ('shop/store.py', 'Store.total', 'read_item,Store.add'),
        ('shop/store.py', 'restock', 'health,test_restock'),
        ('svc/main.go', 'write', 'ping'),
        ('web/api.ts', 'get', 'load'),
        ('web/client.ts', 'View.draw', 'View.render'),
        ('web/lib/format.ts', 'format', 'load,View.draw'),
    ]),
}
