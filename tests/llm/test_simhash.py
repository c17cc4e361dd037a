import random
import re

import numpy as np
import xxhash

from stackmill.llm import simhash as S

TEXTS = [None, "", "   ", "one two", "One TWO", "a b c d e f g h " * 30, "a b c d e f g h " * 30 + "z", "Ünï cödé x y z w v", "x " * 70_000, "p q r s t u", "p q r s t u"]


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, ids):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [min(ids[k] for k in range(len(fps)) if find(k) == find(i)) for i in range(len(fps))]


def test_fingerprints():
    for text in TEXTS:
        if text is None or len(text) < 10_000:
            assert S.fingerprint((text or "").encode()) == [brute(text)]


def test_groups_match_brute_force(docs_of):
    got = {r["doc_id"]: (r["fp0"] % 2**64, r["component_id"]) for r in S.near_groups(docs_of(TEXTS)).collect()}
    fps = [S.fingerprint((t or "").encode())[0] for t in TEXTS]
    want = components(fps, list(range(len(TEXTS))))
    assert got == {i: (fps[i], want[i]) for i in range(len(TEXTS))}


def test_links_of_planted_fingerprints(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    fps = set(base)
    for x in base[:20]:  # chains and clusters at each distance from 1 to 6
        for d in range(1, 7):
            y = x
            for bit in rng.choice(64, d, replace=False):
                y ^= 1 << int(bit)
            fps.add(y)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x, i) for i, x in enumerate(fps)], "fp long, rep long")
    from stackmill.llm.components import connected_components

    got = {r["node"]: r["component"] for r in connected_components(S.near_links(nodes), "a", "b").collect()}
    want = components(fps, list(range(len(fps))))
    assert [got.get(i, i) for i in range(len(fps))] == want


def test_keep_first(docs_of):
    texts = ["a b c d e f g h i j"] * 3 + ["other words entirely here now", None, ""]
    kept = sorted(r["doc_id"] for r in S.keep_first(docs_of(texts)).collect())
    assert kept == [0, 3, 4]
    twice = docs_of(texts, ids=[0, 0, 1, 3, 4, 4])
    assert sorted(r["doc_id"] for r in S.keep_first(twice).collect()) == [0, 3, 4]
    assert S.keep_first(docs_of(texts).limit(0)).count() == 0


def test_several_fingerprints_against_brute_force(spark):
    rng = random.Random(8)
    base = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(80)) for _ in range(12)]
    texts = [t.replace(t.split()[rng.randrange(80)], "changed", 1) if rng.random() < 0.8 else t for t in base for _ in range(4)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seeds = (42, 1, 2)
    fps = [S.fingerprint((t or "").encode(), 5, seeds) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if any((a ^ b).bit_count() <= 4 for a, b in zip(fps[i], fps[j])):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    got = {r["doc_id"]: r["component_id"] for r in S.near_groups(docs, shingle=5, seeds=seeds).collect()}
    assert got == dict(enumerate(root)) and len(set(root)) < len(texts)


def test_keep_first_is_the_same_row_and_keeps_columns(spark):
    rows = [(1, f"text {k} " * 30, k, "x") for k in range(6)] + [(None, "a", 9, None), (None, "a", 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp0 int, component_id string")
    one, two = (sorted(S.keep_first(d).collect(), key=str) for d in (docs, docs.repartition(5)))
    assert one == two and len(one) == 3 and S.keep_first(docs).columns == docs.columns
