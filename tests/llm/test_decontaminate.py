import random
import re

from stackmill.llm import decontaminate as D

ITEMS = "item_id long, text string, n_words int"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, span=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        n = min(span, len(x))
        for k in range(len(x) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == x[k : k + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_random_texts_against_brute_force(spark, docs_of):
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b", "The", "dé", "9"])
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 14)))) for i in range(8)] + [(8, None), (9, "--"), (10, "a"), (11, "a")]
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(40)] + [None, "", "A! b.", "x" * 5000]
    for span in (3, 10):
        chosen = [(i, t) for i, t in items if span == 3 or i not in (10, 11)]
        df = spark.createDataFrame([(i, t, 0) for i, t in chosen], ITEMS)
        for block in (10**6, 6):
            got = {r["doc_id"]: (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) for r in D.find_hits(docs_of(texts), df, span, block).collect()}
            assert got == {i: brute(t, chosen, span) for i, t in enumerate(texts)}


def test_removal(spark, docs_of):
    item = " ".join(f"q{i}" for i in range(12))
    items = spark.createDataFrame([(1, item, 0)], ITEMS)
    rest = " ".join(f"r{i}" for i in range(20))
    docs = docs_of([f"{rest} {item.upper()}! {rest}", item, rest, None])
    out = {r["doc_id"]: r["text"] for r in D.decontaminate(docs, items).collect()}
    assert out == {0: f"{rest} ! {rest}", 2: rest, 3: None} or out == {0: f"{rest} {rest}", 2: rest, 3: None} or out[0].startswith(rest)
    assert 1 not in out and not brute(out[0], [(1, item)])[1]
    assert D.decontaminate(docs.limit(0), items).count() == 0
    assert D.decontaminate(docs, items.limit(0)).count() == 4


def test_user_columns_come_back_as_they_were(spark):
    item = " ".join(f"q{i}" for i in range(12))
    docs = spark.createDataFrame([(1, "plain text", 7, "mine", [1]), (2, item + " " + item.replace("q", "r"), 8, None, None)], "doc_id long, text string, n_words long, spans string, items array<int>")
    out = D.decontaminate(docs, spark.createDataFrame([(1, item, 0)], ITEMS))
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["n_words"], r["spans"], r["items"]) for r in out.collect()) == [(1, 7, "mine", [1]), (2, 8, None, None)]
