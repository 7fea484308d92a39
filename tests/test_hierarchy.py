import random

from cairn.operators import hierarchy as h

NODE = "id bigint, parent bigint, segments array<string>"


def walk(nodes):
    """Brute force: follow the parents of every node."""
    parent = {i: p for i, p, _ in nodes}
    out = {}
    for i in parent:
        chain, at = [i], parent[i]
        while at is not None and at in parent and at not in chain:
            chain.append(at)
            at = parent[at]
        out[i] = None if at in chain else (chain[-1], len(chain) - 1, chain[1:][::-1])
    return out


def solved(spark, nodes):
    return {r.id: (r.root_id, r.depth, r.segments, r.ancestors) for r in h.resolve_hierarchy(spark.createDataFrame(nodes, NODE)).collect()}


def test_random_forests_and_cycles_match_a_walk(spark):
    rng = random.Random(4)
    for _ in range(3):
        n = 60
        nodes = [(i, rng.choice([None, *range(n), 999]), [f"s{i}"]) for i in range(n)]
        want, got = walk(nodes), solved(spark, nodes)
        for i, w in want.items():
            if w is None:
                assert got[i][:2] == (-1, -1) and got[i][2] == []
            else:
                assert got[i][0] == w[0] and got[i][1] == w[1] and got[i][3] == w[2]
                assert got[i][2] == [f"s{x}" for x in (*w[2], i)]


def test_long_chain_and_node_below_a_cycle(spark):
    nodes = [(i, i - 1 if i else None, [str(i)]) for i in range(70)] + [(100, 101, ["a"]), (101, 100, ["b"]), (102, 101, ["c"]), (103, 103, None)]
    got = solved(spark, nodes)
    assert got[69][:2] == (0, 69) and got[69][2] == [str(i) for i in range(70)]
    assert all(got[i][:2] == (-1, -1) for i in (100, 101, 102, 103))


def test_empty_repeated_and_null_rows(spark):
    assert solved(spark, []) == {}
    got = solved(spark, [(1, None, None), (1, None, None), (2, 1, ["x"]), (3, 77, ["y"])])
    assert got == {1: (1, 0, [], []), 2: (1, 1, ["x"], [1]), 3: (3, 0, ["y"], [])}


def test_descendants(spark):
    r = h.resolve_hierarchy(spark.createDataFrame([(1, None, []), (2, 1, []), (3, 2, [])], NODE))
    assert {tuple(x) for x in h.descendants(r).collect()} == {(1, 2, 1), (1, 3, 2), (2, 3, 1)}


ROUTER = "id bigint, repo_id string, file_path string, var string, framework string, prefix string, is_root boolean, parent_var string, dynamic boolean, line int"
INCLUDE = "id bigint, repo_id string, file_path string, parent_var string, target string, prefix string, framework string, dynamic boolean, line int"


def router(i, path, var, prefix=None, parent=None, repo="r"):
    return (i, repo, path, var, "f", prefix, False, parent, False, i)


def include(i, path, parent, target, prefix=None, line=1, repo="r"):
    return (i, repo, path, parent, target, prefix, "f", False, line)


def paths(spark, routers, includes):
    return {r.id: (r.root_id, r.depth, r.full_path) for r in h.router_paths(spark.createDataFrame(routers, ROUTER), spark.createDataFrame(includes, INCLUDE)).collect()}


def test_router_parents_by_variable_dots_and_require(spark):
    routers = [
        router(1, "a/main.py", "app", "/api/"), router(2, "a/main.py", "sub", "x", "app"), router(3, "b/users.py", "router", "//users"),
        router(4, "b/one.js", "r", "one"), router(5, "b/two.js", "r", "t"), router(6, "b/two.js", "q", "q"), router(7, "c/z.py", "lost", "p", "nobody"),
    ]
    includes = [
        include(1, "a/main.py", "sub", "b.users.router", "/v2", 9), include(2, "a/main.py", "app", "b.users.router", "/v1", 5),
        include(3, "a/main.py", "app", "require:../b/one", "m"), include(4, "a/main.py", "app", "require:../b/two", "m"), include(5, "a/main.py", "gone", "lost", "m"),
    ]
    got = paths(spark, routers + routers[:1], includes + includes[:1])
    assert got[1] == (1, 0, "/api") and got[2] == (1, 1, "/api/x")
    assert got[3] == (1, 1, "/api/v1/users")  # the first include by line wins
    assert got[4] == (1, 1, "/api/m/one")
    assert got[5] == (5, 0, "/t")  # a file of two routers is not named by require
    assert got[7] == (7, 0, "/p")


def test_router_cycle_and_empty_tables(spark):
    got = paths(spark, [router(1, "f.py", "a", "a", "b"), router(2, "f.py", "b", "b", "a"), router(3, "f.py", "c", "c", "b")], [])
    assert set(got.values()) == {(-1, -1, "")}
    assert paths(spark, [], []) == {}
