"""A small repository of our own, with what the test tables do not hold: debt notes, links between files, routes, clones."""

FILES = {
    "shop/__init__.py": "",
    "shop/store.py": '''"""Stock."""
import os

LIMIT = os.environ["STOCK_LIMIT"]


class Store:
    """Keeps items."""

    def add(self, item, count=1):
        # TODO(mia): check the count
        return self.total(item) + count

    def total(self, item):
        return len(item)


class Shelf(Store):
    def add(self, item, count=1):
        return super().add(item, count)


def restock(items):
    out = []
    for item in items:
        if item is None:
            continue
        out.append(Store().add(item, 2))
    return out
''',
    "shop/app.py": '''import os
from fastapi import FastAPI
from shop.store import restock as fill
from shop import store
from shop.api import router as items_router

app = FastAPI()
app.include_router(items_router, prefix="/v2")
TOKEN = os.getenv("APP_TOKEN", "dev")
PORT = os.getenv("PORT", "8080")


@app.get("/health")
def health():
    return fill([]) or store.restock([1])


def unlinked():
    gone.away()  # FIXME: who calls this?
''',
    "shop/api.py": '''from fastapi import APIRouter
from shop.store import Store

router = APIRouter(prefix="/items")


@router.get("/{item_id}")
def read_item(item_id):
    return Store().total(item_id)


@router.post("/")
async def add_item(item):
    """Adds."""
    return Store().add(item)


def refill(rows):
    result = []
    for row in rows:
        if row is None:
            continue
        result.append(Store().add(row, 7))
    return result
''',
    "tests/test_store.py": "from shop.store import restock\n\n\ndef test_restock():\n    assert restock([]) == []\n",
    "web/client.ts": "import { format } from './lib/format';\nimport * as api from './api';\n\n// HACK: retry once - the server is slow\nexport async function load(id: string): Promise<string> {\n  const url = process.env.API_URL ?? 'http://localhost';\n  return format(await api.get(url + id));\n}\n\nexport class View {\n  render(x: number) {\n    return this.draw(x);\n  }\n  draw(x: number) { return format(String(x)); }\n}\n",
    "web/api.ts": "/** Reads a resource. */\nexport async function get(url: string) {\n  return (await fetch(url)).text();\n}\n",
    "web/lib/format.ts": "/* NOTE: keep in step with the printed form */\nexport const format = (x: string) => x.trim();\n",
    "web/server.js": "const express = require('express');\nconst users = require('./routes/users');\nconst app = express();\napp.use('/api/users', users);\napp.delete('/cache', purge);\nfunction purge(req, res) { res.end(); }\n",
    "web/routes/users.js": "const express = require('express');\nconst router = express.Router();\nrouter.get('/:id', (req, res) => res.json({}));\nrouter.post('/', create);\nfunction create(req, res) { res.end(); }\nmodule.exports = router;\n",
    "svc/main.go": "package main\n\nimport (\n\t\"net/http\"\n\t\"os\"\n)\n\n// BUG: no timeout\nfunc main() {\n\thttp.HandleFunc(\"/ping\", ping)\n\thttp.ListenAndServe(os.Getenv(\"ADDR\"), nil)\n}\n\nfunc ping(w http.ResponseWriter, r *http.Request) {\n\twrite(w)\n}\n\nfunc write(w http.ResponseWriter) {}\n",
    "jvm/OrderController.java": "package jvm;\n\nimport org.springframework.web.bind.annotation.*;\n\n@RestController\n@RequestMapping(\"/orders\")\npublic class OrderController {\n    @GetMapping(\"/{id}\")\n    public String one(String id) { return find(id); }\n\n    private String find(String id) { return id; }\n}\n",
    "net/Ping.cs": "using System;\n\nnamespace Net\n{\n    public class Ping\n    {\n        // XXX: unused\n        public int Send(int n) { return Twice(n); }\n        int Twice(int n) { return 2 * n; }\n    }\n}\n",
    "notes.md": "# Plan\n\n- [ ] TODO: write the guide\n- TODO later, maybe\nSee BUG list.\n",
    "deploy.sh": "#!/bin/sh\n# FIXME restart only what changed\necho TODO\n",
    "broken.py": "def (:\n",
}

VECTORS = [(1, 1.0, 0.0), (2, 0.99, 0.14), (3, 0.98, 0.2), (4, 0.0, 1.0), (5, 0.1, 0.995), (6, 0.7, 0.714)]

ANSWERS = [
    (1, "python", "f", "def f(self, a, *rest)", "Summary: adds things\nParam a: the first\nParam rest: others\nReturns: the sum"),
    (2, "go", "Add", "func Add(a int) int", "Summary: Adds one."),
    (3, "java", "add", "int add(int a)", "- SUMMARY: adds\n- PARAM a: first\n- RETURNS: sum"),
    (4, "csharp", "Add", "int Add(List<int> xs)", "Summary: a < b\nParam xs: many & more"),
    (5, "javascript", "go", "function go(x, ...ys)", "Summary: Goes!\nParam ys: the rest"),
    (6, "python", "g", "def g(x)", "Summary: ok\nParam y: none"),
    (7, "python", "g", "def g(x)", "```Summary: ok```"),
    (8, "python", "g", "def g(x)", "Returns: nothing"),
    (9, "python", "g", "def g()", "Summary: ends */ here"),
]
