import random
import re

import numpy as np
import pyarrow as pa
import pytest

from stackmill.llm import jaccard_join as J
from tests.llm.conftest import make_docs


def brute_sets(texts, shingle=3):
    out = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append({tuple(words[i : i + shingle]) for i in range(len(words) - shingle + 1)} or ({tuple(words)} if words else set()))
    return out


def brute(texts, ids, percent=90, shingle=3):
    sets = brute_sets(texts, shingle)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(find(i), []).append(ids[i])
    return sorted((ids[i], len(sets[i]), min(groups[find(i)])) for i in range(len(texts)))


def near_texts(seed, families=12, copies=14):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = [None, "", " \t\n", "one", "One", "one two", "one TWO", "é é é", "a b c d", "A b c d ", "  x"]
    for _ in range(families):
        base = [word() for _ in range(rng.choice([9, 11, 12, 25, 60, 150, 400]))]
        texts.append(" ".join(base))
        for _ in range(copies):
            new = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 20))):
                k = rng.randrange(len(new))
                new[k : k + rng.randrange(2)] = [word() for _ in range(rng.randrange(3))]
            texts.append(" ".join(new))
    return texts + [" ".join(word() for _ in range(50)) for _ in range(60)] + ["z " * 30_000]


def groups(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()))


@pytest.mark.parametrize(("percent", "region", "levels"), [(90, 512, 5), (90, 4, 4), (80, 6, 1)])
def test_against_brute_force(spark, percent, region, levels):
    texts = near_texts(percent + region)
    ids = list(range(100, 100 + len(texts)))
    random.Random(1).shuffle(ids)
    docs = make_docs(spark, texts, ids=ids).repartition(4)
    assert groups(J.jaccard_groups(docs, percent, region=region, levels=levels)) == brute(texts, ids, percent)


def test_odd_ids(spark):
    assert J.jaccard_groups(make_docs(spark, [])).collect() == []
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = J.jaccard_groups(make_docs(spark, [text, text, "other text " + text * 9, text, None], ids=[7, None, 7, 9, None])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in rows) == [(0, 0), (0, 7), (7, 7), (7, 7), (9, 7)]


def test_similar_sets_share_a_part():
    """At and above the limit, at every size near the ends of classes: no pair without a common key."""
    rng = np.random.default_rng(4)
    bounds = J.classes(90, 1 << 40)
    for size in [9, 10, 13, 14, *rng.integers(10, 600, 60)]:
        u = np.unique(rng.integers(0, 2**63, int(size)).astype(np.uint64))
        for _ in range(6):
            gone = rng.integers(0, max(1, len(u) // 10) + 1)
            v = np.unique(np.r_[u[gone:], rng.integers(0, 2**63, int(rng.integers(0, max(2, len(u) // 9)))).astype(np.uint64)])
            common = len(np.intersect1d(u, v))
            if 100 * common >= 90 * (len(u) + len(v) - common) and len(u) + len(v) > 2 * common:
                assert set(J.part_keys(u, 90, bounds)) & set(J.part_keys(v, 90, bounds))


def test_region_joined_whole():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**62, 6000).astype(np.uint64)
    sets = [np.unique(np.r_[base[: 5000 + rng.integers(0, 900)], rng.integers(0, 2**62, rng.integers(0, 300)).astype(np.uint64)]) for _ in range(30)]
    rows = pa.table({"node": range(30), "component": range(30), "items": [s.tobytes() for s in sets]})
    got = {(a, b) for a, b in zip(*(c.to_pylist() for c in J.joined_whole(90)(rows).columns))}
    want = {(i, j) for i in range(30) for j in range(i + 1, 30) if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 90 * (len(sets[i]) + len(sets[j]) - c)}
    assert got == want and 0 < len(want) < 435


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert groups(J.op11_jaccard_join(spark, sf_dir)) == brute([d["text"] for d in docs], [d["doc_id"] for d in docs])
