import random

from stackmill.llm import line_dedup as L


def brute(rows):
    lines = {}
    for d, t in sorted(((d, t) for d, t in rows), key=lambda r: (r[0] is not None, r[0])):
        for i, x in enumerate((t or "").split("\n")):
            if x.strip(" \t\x0b\x0c\r"):
                lines.setdefault(x, []).append((d, i))
    keys = list(lines)
    shingles = [{x[i : i + 12] for i in range(max(1, len(x) - 11))} for x in keys]
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            both = len(shingles[i] & shingles[j])
            if both / (len(shingles[i]) + len(shingles[j]) - both) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, k in enumerate(keys):
        groups.setdefault(find(i), []).extend(lines[k])
    return {min(g) for g in groups.values()}


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    base = [" ".join(word() for _ in range(40)) for _ in range(12)]
    near = [b.replace(b.split()[7], "changed", 1) for b in base]
    rows = [(d, "\n".join(rng.choice([*base, *near, " ".join(word() for _ in range(30)), "", "short", "  "]) for _ in range(rng.randint(1, 6)))) for d in range(60)]
    return rows + [(60, None), (61, ""), (62, "x" * 30_000), (63, "short"), (63, "short"), (64, "é" * 11 + "𝄞")]


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n_lines int")
    got = {(r["doc_id"], r["line_no"]) for r in L.kept_lines(docs).collect()}
    assert got == brute(rows)
    texts = {r["doc_id"]: r["text"] for r in L.dedup_lines(docs).collect()}
    assert texts[60] is None and texts[62] == "x" * 30_000
    report = {r["doc_id"]: r for r in L.line_report(docs).collect()}
    assert report[61]["n_lines"] == 0 and report[60]["kept"] == []


def test_clashing_nodes_are_hashed_anew(spark, monkeypatch):
    monkeypatch.setattr(L, "NODE_BITS", 5)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["line_no"]) for r in L.kept_lines(docs).collect()} == brute(rows)


def test_count_of_lines_with_a_word(spark):
    texts = [None, "", " \t\n", "a", "a\n", "\n a \n\r\n\x0b b c\n", " " * 50_000 + "\n" + " " * 50_000, "x\r\ny\u2028z\n\u00a0", "a" * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_lines"] for r in L.line_report(docs).collect()}
    assert got == {i: sum(bool(x.strip(" \t\x0b\x0c\r")) for x in (t or "").split("\n")) for i, t in enumerate(texts)}


def test_recall_on_given_lines(spark, sf_dir):
    """Of the similar pairs of distinct lines in the given documents, found by an inverted index, at least 0.95 are joined."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = sorted({x for r in docs.collect() for x in (r["text"] or "").split("\n") if x.strip(" \t\x0b\x0c\r")})
    sets = [{x[i : i + 12] for i in range(max(1, len(x) - 11))} for x in lines]
    where = {}
    for i, s in enumerate(sets):
        for w in s:
            where.setdefault(w, []).append(i)
    pairs = set()
    for i, s in enumerate(sets):
        met = {}
        for w in s:
            for j in where[w]:
                if j < i:
                    met[j] = met.get(j, 0) + 1
        pairs |= {(j, i) for j, n in met.items() if n / (len(s) + len(sets[j]) - n) >= 0.8}
    found, first = L.nodes(docs)
    members = L.bucket_members(L.band_keys(found))
    met = {(r["x"], r["y"]) for r in L.candidates(members).collect()}
    of = {r["line"]: r["a"] for r in found.select("line", "a").distinct().collect()}
    buckets = {}
    for r in members.collect():
        buckets.setdefault(r["a"], set()).add(r["key"])
    shared = sum(bool(buckets.get(of[lines[a]], set()) & buckets.get(of[lines[b]], set())) for a, b in pairs)
    assert pairs and met and shared >= 0.95 * len(pairs), (shared, len(pairs))


def test_no_python_and_empty(spark, sf_dir):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert L.line_report(docs).count() == 0 and L.dedup_lines(docs).count() == 0
    plan = L.band_keys(L.lines_of(spark.read.parquet(f"{sf_dir}/documents.parquet")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def template_rows():
    """Lines of one template, dissimilar to each other (about 0.55), each with a copy that differs in one late word."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    shared = " ".join(word(6) for _ in range(22))
    base = [f"{word(30)} {shared} {word(14)}" for _ in range(120)]
    return [(d, "\n".join((x, x[:-9] + "Z" * 9))) for d, x in enumerate(base)]


def sharing_a_band(spark, docs, rows):
    """Kept lines where exactly the similar pairs that share a band are links."""
    lines = [(d, i, x) for d, t in rows for i, x in enumerate(t.split("\n"))]
    of = {r["a"]: r["line"] for r in L.lines_of(docs).collect()}
    buckets, sets = {}, {x: {x[i : i + 12] for i in range(len(x) - 11)} for _, _, x in lines}
    for r in L.band_keys(L.lines_of(docs)).collect():
        buckets.setdefault(r["key"], []).append(of[r["a"]])
    root = {x: x for x in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for b in buckets.values():
        for i, x in enumerate(b):
            for y in b[:i]:
                both = len(sets[x] & sets[y])
                if both / (len(sets[x]) + len(sets[y]) - both) >= 0.8:
                    root[find(x)] = find(y)
    groups = {}
    for d, i, x in lines:
        groups.setdefault(find(x), []).append((d, i))
    return {min(g) for g in groups.values()}


def test_buckets_with_a_dissimilar_head(spark):
    rows = template_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sharing_a_band(spark, docs, rows)
    assert len(want) < 130
    assert {tuple(r) for r in L.kept_lines(docs).collect()} == want
    rest = spark.createDataFrame([(1, r["a"], 0, r["a"], 0, 1 << 40) for r in L.lines_of(docs).collect()], "key long, a long, head long, c long, hc long, work long")
    by_prefix = {tuple(r) for r in L.verified(L.remaining(rest, L.lines_of(docs), 0.8), L.lines_of(docs), 0.8).collect()}
    by_bucket = {tuple(r) for r in L.verified(L.remaining(rest, L.lines_of(docs), 0.8, 1 << 50), L.lines_of(docs), 0.8).collect()}
    assert by_prefix == by_bucket and len(by_prefix) >= 120


def test_alike_lines_of_a_large_bucket_are_not_all_paired(spark):
    """80 lines, all similar to each other and none to the head of their bucket, with 3,160 similar pairs."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    base = [word() for _ in range(60)]
    lines = [" ".join([*base[:k % 60], word(), *base[k % 60 + 1 :]]) for k in range(80)]
    df = L.lines_of(spark.createDataFrame([(0, "\n".join(lines))], "doc_id long, text string"))
    nodes = [r["a"] for r in df.collect()]
    rest = spark.createDataFrame([(1, a, 0, a, 0, 1 << 40) for a in nodes], "key long, a long, head long, c long, hc long, work long")
    pairs = L.remaining(rest, df, 0.8)
    links = {tuple(r) for r in L.verified(pairs, df, 0.8).collect()}
    assert pairs.count() <= 4 * len(lines)
    reached, more = {nodes[0]}, True
    while more:
        more = {n for link in links if reached & set(link) for n in link} - reached
        reached |= more
    assert reached == set(nodes)


def test_sketches_rule_out_no_similar_pair(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(2, 8)))
    pairs = []
    for _ in range(300):
        x = [word() for _ in range(40)]
        y = list(x)
        for _ in range(rng.randint(0, 6)):
            y[rng.randrange(40)] = word()
        pairs.append((" ".join(x), " ".join(y)))
    pairs += [("a", "a"), ("a" * 12, "a" * 13), ("é" * 14, "é" * 20), ("x" * 30_000, "x" * 29_999 + "y"), ("short", "other")]
    rows = [(i, x, y) for i, (x, y) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "a long, left string, right string")
    sides = [L.sketches(df.select("a", df[c].alias("line"))).selectExpr("*", "0 AS c").select(*L._side(p)) for c, p in (("left", "l"), ("right", "r"))]
    may = {r["l_a"]: r["may"] for r in sides[0].join(sides[1], sides[0]["l_a"] == sides[1]["r_a"]).select("l_a", L._may_match(0.8).alias("may")).collect()}
    share = {r["a"]: r["share"] for r in df.select("a", L.jaccard(df["left"], df["right"]).alias("share")).collect()}
    unlike = ruled_out = 0
    for i, x, y in rows:
        a, b = ({t[k : k + 12] for k in range(max(1, len(t) - 11))} for t in (x, y))
        want = len(a & b) / len(a | b)
        assert share[i] == want and (may[i] or want < 0.8)
        unlike += want < 0.8
        ruled_out += not may[i]
    assert ruled_out >= 0.9 * unlike > 0


def test_user_columns_with_internal_names(spark):
    rows = [(1, "same line of text here\nother words stand here", 1, 2, 3, "x"), (2, "same line of text here\nnothing alike at all", 4, 5, 6, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept long, _doc long, a long, `line.no` string")
    got = sorted(map(tuple, L.dedup_lines(docs).collect()))
    assert got == [rows[0], (2, "nothing alike at all", 4, 5, 6, "y")]


def test_few_files_and_no_shuffle_of_texts(spark, monkeypatch):
    """Where buckets are few, neither the texts nor the keys of all lines are shuffled, and a round of components takes one task."""
    from stackmill.llm import components as C

    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    lines, signed = L.signed_nodes(docs)
    keys = signed.selectExpr("a", "explode(keys) AS key")
    for df in (L.bucket_members(keys), L.texts_of(L.stash(L.bucket_members(keys), "test-members"), lines)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "ShuffledHashJoin" not in plan and "SortMergeJoin" not in plan
    tasks = []
    monkeypatch.setattr(C, "checkpointed", lambda df, f=C.checkpointed: tasks.append((out := f(df)).rdd.getNumPartitions()) or out)
    edges = L.stash(spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "x long, y long"), "test-edges")
    got = {tuple(r) for r in C.connected_components(edges, "x", "y", task_rows=1000).collect()}
    assert got == {(k, 0) for k in range(41)} | {(100, 100), (101, 100)} and set(tasks[1:]) == {1}
    assert {tuple(r) for r in C.connected_components(edges, "x", "y", task_rows=7).collect()} == got


def test_places_of_ids_near_and_far(spark):
    near = [(-5, "b\na"), (None, "a\nc"), (2, "c\nd\n" + "\n".join(f"line {k} of many" * 3 + str(k) * 40 for k in range(130)))]
    for extra in ([], [(2**63 - 1, "e")], [(-(2**63), "a\nf"), (2**63 - 1, "e")]):
        rows = near + extra
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert (L.place_base(docs) is None) == bool(extra)
        null = -(2**63) - 1
        want = {(None if d == null else d, k) for d, k in brute([(null if d is None else d, x) for d, x in rows])}
        assert {tuple(r) for r in L.kept_lines(docs).collect()} == want
        assert {(r["doc_id"], k) for r in L.line_report(docs).collect() for k in r["kept"]} == want
    low = spark.createDataFrame([(-(2**63), "x y"), (-(2**63) + 3, "x y\nz")], "doc_id long, text string")
    assert L.place_base(low) == -(2**63) - 1 and {tuple(r) for r in L.kept_lines(low).collect()} == {(-(2**63), 0), (-(2**63) + 3, 1)}
