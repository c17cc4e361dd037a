import math
import re

from pyspark.sql import functions as F

from stackmill.llm import quality_rules as Q

LONG = "lorem ipsum dolor " * 4000
TEXTS = [None, "", " \t\n", "one two", "a b c a b c a b c d", "x\nx\n\nx\ny", "### $$$ a|b <c>", "w " * 60, LONG, "a\x0bb\x0cc\rd e", " ".join(f"w{i}" for i in range(60)), "a a a a"]


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {}
    for w in windows:
        often[w] = often.get(w, 0) + 1
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_base_counts_match_brute_force(docs_of):
    got = {r["doc_id"]: r for r in Q.base_counts(docs_of(TEXTS).drop("n_words")).collect()}
    for i, text in enumerate(TEXTS):
        want = counts(text)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, text
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def cdf(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_bound_is_clopper_pearson(spark):
    def proven(k, n, risk, level):
        row = spark.createDataFrame([(k, n)], "k long, n long")
        return row.select(Q.proven(F.col("k"), F.col("n"), risk, F.lit(level))).first()[0]

    # the upper bound of 0 in n at level a is 1 - a ** (1 / n)
    for n, level in ((50, 0.05), (400, 0.001)):
        bound = 1 - level ** (1 / n)
        assert proven(0, n, bound * 1.0001, level) and not proven(0, n, bound * 0.9999, level)
    assert not proven(0, 0, 0.5, 0.05) and not proven(5, 5, 0.5, 0.05)
    cases = [(k, n) for n in (1, 10, 300) for k in range(0, n, 7)]
    for p in (0.05, 0.3):
        rows = spark.createDataFrame(cases, "k long, n long").select("k", "n", Q.binomial_cdf(F.col("k"), F.col("n"), p).alias("c")).collect()
        assert all(abs(r["c"] - cdf(r["k"], r["n"], p)) < 1e-9 for r in rows)


def test_many_strata_are_joined_by_a_shuffle(spark, docs_of, monkeypatch):
    docs = docs_of([" ".join(f"w{i}" for i in range(80))] * 20)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    want = sorted(map(str, Q.quality_rules(docs, labels, "source").collect()))
    monkeypatch.setattr(Q, "MANY_STRATA", 0)
    assert sorted(map(str, Q.quality_rules(docs, labels, "source").collect())) == want and len(want) == 20


def test_cutoffs_need_proof_and_apply_per_stratum(spark, docs_of):
    good = " ".join(f"w{i}" for i in range(80))
    bad = good + " " + "#" * 200
    n = 400
    docs = docs_of([good] * n + [bad] * 5 + [None])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(n)] + [(n, 0, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in Q.quality_rules(docs, labels).collect()}
    assert all(out[i]["kept"] for i in range(n)) and not any(out[n + k]["kept"] for k in range(6))
    # without labels nothing is proven: only the base rule rejects
    out = {r["doc_id"]: r["kept"] for r in Q.quality_rules(docs, labels.limit(0)).collect()}
    assert out[n] and not out[n + 5]
    assert Q.quality_rules(docs.limit(0), labels).count() == 0


def test_learnt_cutoffs_keep_the_promise(spark):
    row = {"s": "a", "n": 1000} | {f"{r}_{j}": 0 for r in Q.RULES for j in range(len(Q.GRID))}
    row["symbol_rate_5"] = 90
    cut = Q.learn_cutoffs(spark.createDataFrame([row]), "s").first()
    assert cut["symbol_rate"] == Q.GRID[4] and cut["dup_line_rate"] == Q.GRID[-1]
