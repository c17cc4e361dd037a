import math

from pyspark.sql import functions as F

from stackmill.llm import mixing as M


def entropy(tokens, x):
    raw = [(t / sum(tokens)) ** x for t in tokens]
    return -sum(r / sum(raw) * math.log(r / sum(raw)) for r in raw)


def repeats(tokens, x, budget):
    raw = [(t / sum(tokens)) ** x for t in tokens]
    spent = max(t * sum(raw) / r for t, r in zip(tokens, raw)) if budget is None else budget
    return max(spent * r / sum(raw) / t for t, r in zip(tokens, raw))


def test_exponent(spark):
    tokens = [1000, 100, 10]
    table = spark.createDataFrame([(t,) for t in [*tokens, 0]], "tokens long")
    target = (entropy(tokens, 1.0) + math.log(3)) / 2
    for shares in (M.shares_of([*tokens, 0]), M.shares_in(table)):
        x = M.solve_exponent(shares, 1110, target, None)
        assert abs(entropy(tokens, x) - target) < 1e-9
        y = M.solve_exponent(shares, 1110, None, 4.0)
        assert repeats(tokens, y, 1110) <= 4.0 + 1e-9 and repeats(tokens, y - 1e-6, 1110) > 4.0
        z = M.solve_exponent(shares, None, None, 2.0)
        assert repeats(tokens, z, None) <= 2 + 1e-9
    assert M.shares_of([0, 0]) is None and M.solve_exponent(None, 10, 1.0, 2.0) == 1.0
    assert M.solve_exponent(M.shares_of([5]), 10, 0.0, 1.0) == 1.0


def copies(docs, **how):
    counted = M.counted_docs(docs)
    return M.with_copies(counted.drop("h"), M.plan(counted, **how)).collect()


def test_budget_is_met_within_a_document(spark):
    rows = [(i, "w " * (1 + i % 7), ["big", "mid", None][0 if i < 3000 else 1 if i < 3400 else 2], "x") for i in range(3450)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_copies string")
    out = copies(docs)
    assert len(out) == len(rows)
    by = {}
    for r in out:
        s = by.setdefault(r["source"], [0, 0, r["target_tokens"], set()])
        s[0] += r["n_tokens"]
        s[1] += r["n_tokens"] * r["n_copies"]
        s[3].add(r["n_copies"])
    for have, got, target, kinds in by.values():
        assert got <= target + 1e-6 and target - got <= 7 and max(kinds) - min(kinds) <= 1
        assert target / have <= M.MAX_REPEAT + 1e-6
    assert abs(sum(v[2] for v in by.values()) - sum(v[0] for v in by.values())) < 1e-3


def test_whole_keeps_every_document(spark):
    docs = spark.createDataFrame([(i, "w " * 5, "a" if i < 900 else "b", "lang") for i in range(1000)], "doc_id long, text string, source string, lang string")
    out = M.mix(docs, budget="whole", flatten=0.25, max_repeat=2.0)
    assert out.columns == docs.columns and out.select("doc_id").distinct().count() == 1000 and out.count() > 1000
    order = M.copies_of(docs, M.plan(M.counted_docs(docs), budget="whole"))
    assert order.select(F.max("mix_pass")).first()[0] >= 1


def test_no_document_without_tokens_is_lost_when_whole(spark):
    docs = spark.createDataFrame([(i, "w w", "a") for i in range(5)] + [(9, None, "b"), (10, "", "b"), (11, " ", None)], "doc_id long, text string, source string")
    assert {r["doc_id"] for r in M.mix(docs, budget="whole").collect()} == {*range(5), 9, 10, 11}
    assert {r["doc_id"] for r in M.mix(docs).collect()} <= set(range(5))


def test_user_columns_come_back_as_they_were(spark):
    names = ["weight", "_weight", "n_copies", "mix_block", "target_tokens", "mix_pass", "mix_order", "row", "h", "passes", "blocks", "_s", "cut_hash", "docs.tokens"]
    docs = spark.createDataFrame([(i, "w w", "ab"[i % 2], *[f"{n}{i}" for n in names]) for i in range(6)], ["doc_id", "text", "source", *names])
    out = M.mix(docs, budget="whole", max_repeat=1.0)
    assert out.columns == docs.columns and {tuple(r) for r in out.collect()} == {tuple(r) for r in docs.collect()}


def brute_passes(docs, sources):
    """doc_id, mix_pass of every copy, from the plan's budgets: a source's documents are played block by block, in hash order."""
    out = set()
    for s in sources:
        mine = [d for d in docs if d["source"] == s["source"]]
        tokens = sum(d["n_tokens"] for d in mine)
        full = int(s["target_tokens"] // tokens) if tokens else 0
        out |= {(d["doc_id"], k) for d in mine for k in range(full)}
        left = s["target_tokens"] - full * tokens if tokens else -1
        for d in sorted(mine, key=lambda d: (d["h"] % s["blocks"], d["h"])):
            left -= d["n_tokens"]
            if left < 0:
                break
            out.add((d["doc_id"], full))
    return out


def test_realised_permutation_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_DOCS", 16)
    rows = [(i, "w " * (1 + i * 7 % 11), "abc"[min(2, i // 200)]) for i in range(450)] + [(900, "x y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for many in (100_000, 0):
        monkeypatch.setattr(M, "MANY_SOURCES", many)
        counted = M.counted_docs(docs)
        sources = M.plan(counted)
        got = M.copies_of(counted.drop("h"), sources).collect()
        assert {(r["doc_id"], r["mix_pass"]) for r in got} == brute_passes(counted.collect(), sources.collect()) and len(got) == len({(r["doc_id"], r["mix_pass"]) for r in got})
        # every pass orders the blocks of a source in a way of its own
        order = {}
        for r in got:
            order.setdefault((r["source"], r["mix_pass"]), {})[r["mix_block"]] = r["mix_order"]
        a0, b0 = ([b for b, _ in sorted(order[("c", k)].items(), key=lambda x: x[1])] for k in (0, 1))
        assert a0 != b0 and all(len(set(o.values())) == len(o) for o in order.values())


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, None, "b"), (4, "x y", "a"), (4, "x y", "a")], "doc_id long, text string, source string")
    got = {(r["doc_id"], r["source"]): r["n_copies"] for r in copies(docs)}
    assert got[(3, "b")] == 0 and got[(4, "a")] >= 1
    assert copies(docs.limit(0)) == []
