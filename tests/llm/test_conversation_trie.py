import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from stackmill.llm import conversation_trie as T

SCHEMA = "conv_id long, turn int, role string, text string, depth long, at long, weight long"


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        whole[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    out = []
    for node, ms in members.items():
        under = [o for o in members if o[: len(node)] == node]
        leaf = [o for o in under if not any(len(x) == len(o) + 1 and x[:-1] == o for x in members)]
        ids = sorted(c for c in ms if len(whole[c]) == len(node))
        saved = sum((len(members[o]) - 1) * len(o[-1][1]) for o in under if o)
        children = sum(len(x) == len(node) + 1 and x[: len(node)] == node for x in members)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(ms), len(node), parent, len(ms), children, len(leaf), saved, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
    return sorted(out, key=lambda x: x[:2])


def conversations(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.choice([rng.randint(-150, 450), 0, 100, 7])
        rows += [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é\n", "", None])) for t in range(rng.randint(1, 5))]
    rows += [(c, t, "user", "same") for c in range(200, 230) for t in range(8)]  # copies
    rows += [(300, t, "user", f"long {t}") for t in range(150)] + [(c, t, "user", f"long {t}") for c in (306, 311) for t in range(150)]
    return rows + [(None, 1, "user", "x"), (400, 1, "u", "twice"), (400, 1, "u", "twice")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, 9, 9) for r in rows], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=lambda x: x[:2])


@pytest.mark.parametrize("in_task", [T.IN_TASK, 40])
def test_against_brute_force(spark, monkeypatch, in_task):
    monkeypatch.setattr(T, "BLOCK", 16)
    rows = conversations(3)
    assert rows_of(T.conversation_trie(frame(spark, rows).repartition(5), in_task)) == brute(rows)


def test_no_rows(spark):
    assert T.conversation_trie(frame(spark, [])).collect() == []
    assert len(rows_of(T.conversation_trie(frame(spark, [(5, 0, None, None)])))) == len(brute([(5, 0, None, None)]))


def test_splitting_of_random_forests():
    rng = np.random.default_rng(5)
    for n in (1, 2, 50, 400):
        parent = np.array([-1 if rng.random() < 0.05 or not k else rng.integers(max(0, k - rng.integers(1, 40)), k) for k in range(n)])
        depth, comp = np.zeros(n, np.int64), np.arange(n)
        own = rng.integers(1, 9, n)
        weight, values = own.copy(), rng.integers(0, 100, (n, 2))
        want = values.copy()
        for k in range(n):
            if parent[k] >= 0:
                depth[k], comp[k] = depth[parent[k]] + 1, comp[parent[k]]
        for k in reversed(range(n)):
            if parent[k] >= 0:
                weight[parent[k]] += weight[k]
                want[parent[k]] += want[k]
        assert (T.split_all(comp, parent, depth, weight, values) == want).all()


def test_query_against_sql(spark, sf_dir):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf_dir}/conversations.parquet')")
    got = T.op13_conversation_trie(spark, sf_dir)
    want = duck.sql(T.ORACLE_SQL)
    assert rows_of(got) == sorted(want.project("conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256").fetchall(), key=lambda x: x[:2])
