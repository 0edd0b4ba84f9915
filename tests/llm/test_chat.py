import random

from plinth.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = ["", "a", "<|im_end|>", "<|im_start|>assistant\n", "\\", "\\<|", "<\\|", "<|", "\n", "é😀", "<|im_end|>\n<|im_start|>user\nx", "\\n"]


def back(spark, rows):
    tree = chat.replies(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS key", "1 AS node_id", "2 AS rank").repartition(3))
    return {r["tree_id"]: r for r in chat.read_back(chat.formatted(tree)).collect()}


def expected(rows):
    out = {}
    for c, t, role, text in sorted(rows, key=lambda r: tuple((x is not None, x) for x in r[1:])):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def test_texts_come_back(spark):
    rng = random.Random(1)
    text = lambda: "".join(rng.choice(ODD) for _ in range(rng.randint(0, 6)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a\nb", "\\", "", None]), rng.choice([None, text()])) for c in range(25) for t in range(rng.randint(1, 9))]
    rows += [(None, 1, "user", "no id"), (None, 0, "assistant", "x"), (70, 3, "user", "tie"), (70, 3, "assistant", "tie"), (70, None, "user", "first"), (71, 0, "user", "twice"), (71, 0, "user", "twice"), (72, 0, "assistant", "long " * 20000)]
    found, wanted = back(spark, rows), expected(rows)
    assert set(found) == set(wanted)
    for c, turns in wanted.items():
        assert [tuple(m) for m in found[c]["turns"]] == turns
        assert found[c]["learned"] == "".join(t for r, t in turns if r == "assistant")


def test_long_conversations(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(150)]
    assert [m["text"] for m in back(spark, rows)[1]["turns"]] == [f"t{i}" for i in range(150)]
    assert back(spark, []) == {}


TREE = [(1, 1, None, 0.0), (1, 2, 1, 0.9), (1, 3, 1, 0.1), (1, 4, 2, 0.5), (1, 5, 2, 0.8), (1, 6, 3, 1.0), (2, 1, 99, None), (3, 1, 2, 0.0), (3, 2, 1, 0.0), (4, 7, None, 1.0), (4, 7, None, 1.0)]


def brute(best):
    out = []
    for tree in {r[0] for r in TREE}:
        nodes = {n: (p, s or 0.0) for t, n, p, s in TREE if t == tree}
        parents = {p for p, _ in nodes.values()}
        ways = []
        for leaf in nodes:
            path, seen = [leaf], {leaf}
            while (up := nodes[path[-1]][0]) in nodes and up not in seen:
                path.append(up)
                seen.add(up)
            if leaf not in parents and up not in seen:
                ways.append((-sum(nodes[n][1] for n in path) / len(path), leaf, path[::-1]))
        for rank, (_, _, path) in enumerate(sorted(ways)[:best]):
            out += [(tree, rank + 1, pos + 1, n) for pos, n in enumerate(path)]
    return sorted(out)


def test_branches(spark):
    tree = spark.createDataFrame(TREE, "tree_id long, node_id long, parent_id long, score double")
    for best in (1, 2, 9):
        found = chat.paths(tree, best).select("tree_id", "rank", "pos", "node_id").collect()
        assert sorted(map(tuple, found)) == brute(best)


def test_only_dataframe_functions(spark):
    plan = chat.read_back(chat.formatted(chat.replies(spark.createDataFrame([(1, 0, "user", "x")], SCHEMA))))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
