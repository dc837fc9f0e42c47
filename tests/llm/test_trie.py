import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.helpers import duck, same
from tidemark.llm import registry, trie


def plain(rows):
    """All nodes by the definition: sorted tuples in the order of COLUMNS."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    whole = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(own.get(base, [])[:h] + x[h:])
    nodes = {}
    for c, x in whole.items():
        for d in range(len(x) + 1):
            nodes.setdefault(x[:d], []).append(c)
    kids, leaves, saved = {}, {}, {}
    for p in nodes:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in kids)
            saved[p[:d]] = saved.get(p[:d], 0) + (len(members) - 1) * (len(p[-1][1]) if p else 0)
    out = []
    for p, members in nodes.items():
        done = ",".join(map(str, sorted(c for c in members if whole[c] == p)))
        above = min(nodes[p[:-1]]) if p else None
        out.append((min(members), len(p), above, len(members), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(done.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def conversations(n=400):
    draw = random.Random(2)
    rows = []
    for c in [draw.randrange(-300, 1000) for _ in range(n)] + [0, 100, 200]:
        for turn in range(draw.randrange(1, 9)):
            text = draw.choice(["hi", "", None, "é😀", "a", "b" * 50]) if turn > 1 else draw.choice(["hi", "ho"])
            rows.append((c, draw.choice([turn, turn, turn, None]), draw.choice(["user", "assistant", None]) if turn > 2 else "user", text))
    rows += [(None, 1, "user", "lost"), (None, None, None, None), (5, 1, "user", "x"), (5, 1, "user", "x"), (11, 1, "us", "er"), (12, 1, "use", "r")]
    rows += [(c, t, "user", "same") for c in range(500, 600) for t in range(6)]
    rows += [(2000, t, "user", "long " * (t % 3)) for t in range(700)] + [(2001, t, "user", "long " * (t % 3)) for t in range(699)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("heavy", [1, 20, 300, 50_000])
def test_equals_the_definition(spark, heavy, monkeypatch):
    """From all nodes being upper levels to none."""
    monkeypatch.setattr(trie, "PART_BYTES", 40)
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(trie.trie(df, heavy)) == plain(rows)


def test_upper_levels_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(trie, "BROADCAST_ROWS", 1)
    rows = conversations(100)
    assert found(trie.trie(spark.createDataFrame(rows, SCHEMA), 30)) == plain(rows)


def test_louds():
    """Bits, parents, degrees and sums of random forests against plain pointers."""
    draw = random.Random(8)
    for _ in range(50):
        n = draw.randrange(1, 60)
        parents = [draw.choice([-1, *range(i)]) for i in range(n)]
        levels = []
        for p in parents:
            levels.append(0 if p < 0 else levels[p] + 1)
        mixed = list(range(n))
        draw.shuffle(mixed)
        at = {old: new for new, old in enumerate(mixed)}
        forest = trie.Louds(np.array([at[parents[o]] if parents[o] >= 0 else -1 for o in mixed]), np.array([levels[o] for o in mixed]), np.array([f"n{o}" for o in mixed], object))
        names = [int(x[1:]) for x in forest.labels]
        assert len(forest.bits) == 2 * n + 1 and forest.bits.sum() == n
        assert [names[p - 1] if p else -1 for p in forest.parents()] == [parents[o] for o in names]
        assert forest.degrees().tolist() == [parents.count(o) for o in names]
        values = {o: draw.randrange(10) for o in range(n)}
        sums = dict(values)
        for o in range(n - 1, -1, -1):
            if parents[o] >= 0:
                sums[parents[o]] += sums[o]
        assert forest.rolled(np.array([values[o] for o in names])).tolist() == [sums[o] for o in names]


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.trie(empty).count() == 0
    rows = conversations(30)
    df = spark.createDataFrame(rows, SCHEMA)
    clashing = df.selectExpr("*", *[f"'mine' {c}" for c in "node parent part d i hi lo size below root shard head base h n top weight at above before".split()])
    assert found(trie.trie(clashing)) == plain(rows)


def test_query_equals_sql_and_the_definition(spark, sf_dir):
    df = trie.op13_trie(spark, sf_dir)
    same(df, duck(sf_dir), registry.ORACLE_SQL["op13_trie"])
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    assert found(df) == plain(rows)
