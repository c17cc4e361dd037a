import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stackmill.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, w long, f long, ws string, word string, a long, score long, h long"


def brute(rows, support, longest, cover, top):
    counts = Counter()
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            counts.update((lang or "und", tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    kept = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= support}
    out = []
    for (lang, ws), a in kept.items():
        inside = lambda long: any(long[i : i + len(ws)] == ws for i in range(len(long) - len(ws) + 1))
        if any(g == lang and len(o) > len(ws) and inside(o) and 100 * b >= cover * a for (g, o), b in kept.items()):
            continue
        cuts = [(C.SCALE * a * a // (counts[lang, ws[:k]] * counts[lang, ws[k:]]), k, counts[lang, ws[:k]], counts[lang, ws[k:]]) for k in range(1, len(ws))]
        score, _, left, right = min(cuts)
        out.append((lang, score, a, " ".join(ws), left, right))
    n = Counter()
    for (lang, ws), a in counts.items():
        n[lang] += a * (len(ws) == 1)
    result = []
    for lang in n:
        ranked = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))[:top]
        result += [(lang, k, x[3], x[2], x[4], x[5], n[lang], x[1]) for k, x in enumerate(ranked, 1)]
    return sorted(result)


def texts(seed=1, n=120):
    rng = random.Random(seed)
    words = ["New", "york", "a", "b", "c", "é", "É", "d e", "zz", "the"]
    rows = [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choice(words[: rng.randint(2, 10)]) + rng.choice(["", "", "", ".", ",", "\n", "\r", "!", "\t"]) for _ in range(rng.randint(0, 40)))) for _ in range(n)]
    return rows + [("en", None), ("en", ""), (None, "  "), ("en", ".,;"), ("en", "a b " * 3000)] + [("de", "new york c. NEW YORK c")] * 30


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 0, 0, "x", "y", 1, 2, 3) for i, (lang, t) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize(("support", "longest", "shards", "top"), [(10, 3, 4, 2000), (3, 4, 2, 7), (5, 2, 7, 3)])
def test_against_brute_force(spark, support, longest, shards, top):
    rows = texts(support)
    docs = frame(spark, rows).repartition(6, F.col("doc_id") % 6)
    got = C.collocations(docs, support, longest, shards, 50, top)
    assert sorted(map(tuple, got.collect())) == brute(rows, support, longest, 50, top)


def test_no_rows(spark):
    assert C.collocations(frame(spark, [])).collect() == []
    assert C.collocations(frame(spark, [("en", "one two three")])).collect() == []


def test_local_results_lose_nothing(spark):
    rows = texts(7)
    docs = frame(spark, rows).repartition(9, "doc_id")
    words, seed = C.vocabulary(docs)
    everything = {r["h"] for r in C.local_phrases(docs, seed, 1, 3, 1).collect()}
    found = {r["h"] for r in C.local_phrases(docs, seed, 12, 3, 4).collect()}
    assert found < everything
    small = C.phrase_counts(docs, spark.createDataFrame([(h,) for h in found], "h long"), seed, 12)
    whole = C.phrase_counts(docs, spark.createDataFrame([(h,) for h in everything], "h long"), seed, 12)
    assert sorted(map(tuple, small.select("lang", F.col("ws").cast("string"), "f").collect())) == sorted(map(tuple, whole.select("lang", F.col("ws").cast("string"), "f").collect()))


def test_a_full_filter_only_lets_more_through(spark):
    h = np.random.default_rng(2).integers(-(2**62), 2**62, 500)
    bits = C.bit_filter(spark.createDataFrame([(int(x),) for x in h], "h long"), most=256)
    assert len(bits) == 4 and C._may_be(bits, h.view(np.uint64)).all()


def test_query_against_sql(spark, sf_dir):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    got = C.op12_collocations(spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted(duck.sql(C.ORACLE_SQL).project(", ".join(got.columns)).fetchall())
