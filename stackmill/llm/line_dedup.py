"""Fuzzy line dedup by MinHash, with DataFrame functions only.

Every line with a word is hashed as a whole (equal lines are one node) and by its character shingles. The signature of a
line is, for each of BANDS x ROWS fixed points, the shingle hash nearest to that point (least hash XOR point; a row of the
plan holds CHUNK shingles): two lines agree at a point with the probability of their shingle sets' Jaccard similarity. Signatures are cut into bands; lines that
share a band meet its representative (the least line of the band's bucket); each pair is verified by the Jaccard
similarity of the full shingle sets, and verified links are resolved by distributed connected components. Buckets whose
lines are then still in different components are resolved wholly: in small ones every pair of different components is
verified; the lines of large ones meet by exact prefix filtering, which loses no similar pair, and are verified too. Before all
pairs of large ones do, their lines meet, in STARS rounds, one line each of another component with which they share rare
shingles; what is similar is then mostly of one component, and pairs within one are not met. Pairs of every kind are first
held to a bound: a line's sketch has a bit for each of SKETCH slots, set if some of its shingles fall there, so two
sketches differ in no more bits than the lines differ in shingles, and a pair whose sketches differ in more than the
similarity allows is not similar. Of a
component, the first line (least document id, then line number) is kept, and every other occurrence of its lines goes.

With three rows in each of six bands, a pair at the threshold of 0.8 shares a band with probability 0.986, at 0.9 with
0.9996, by calculation; similar lines that share a band are always in one component. Rows are aggregated before they are
shuffled; only lines of large unresolved buckets have their shingles shuffled; hot buckets are met by a join that Spark
can split.

A line's node is its 64-bit hash; where two lines clash in it, which a second hash tells, both are hashed anew (``nodes``).

Defined cases: null and empty texts have no lines; blank lines are no nodes and stay; lines shorter than a shingle are one
shingle; shingles count UTF-16 units; documents with the same id are one for the order of lines; rows with a null id come
first in that order; an empty table gives no rows and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackmill.llm.common import set_apart, stash, table
from stackmill.llm.components import connected_components

SHINGLE, SIMILARITY = 12, 0.8
BANDS, ROWS = 6, 3
#: Shingles hashed in one row of the plan; code for more takes longer to become machine code.
CHUNK = 4
#: Bits of a node; 64 but in tests.
NODE_BITS = 64
#: Pairs of an unresolved bucket that are verified as they are; lines of larger buckets go by their rare shingles.
AT_ONCE = 1024
#: Rounds at most in which lines of large unresolved buckets meet the head of a rare shingle before all their pairs do.
STARS = 2
#: Rare shingles that a line of the prefix join remembers, so that a pair is met about once.
BEFORE = 3
#: Bits of a line's sketch, in words of 64.
SKETCH = 2048
_WORDS = [f"k{j}" for j in range(SKETCH // 64)]
#: Words of the sketch folded in two, for joins with a condition on it: what is compiled for more is too long to become machine code.
_FOLDED = _WORDS[: len(_WORDS) // 2]
#: Rows of keys that are broadcast at most; larger tables are joined by a shuffle.
BROADCAST = 300_000
#: Links that a task of the components has.
LINKS = 100_000

#: The blanks at the start of a line that has a word, and the first character of the word.
WORD_LINE = r"(?md)^[\x20\x09\x0B-\x0D]*+[^\x20\x09-\x0D]"


def has_word(line: Column) -> Column:
    # the first character mostly tells, without a pattern
    return (F.ascii(line) > 32) | line.rlike(r"[^\x20\x09-\x0D]")


def lines_of(docs: DataFrame, clashes: Sequence[DataFrame] = ()) -> DataFrame:
    """doc_id, line_no, line, a (node), b (a second hash) of every line with a word; lines with a clashing node get another."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    a = F.xxhash64("line") if NODE_BITS == 64 else F.xxhash64("line").bitwiseAND(F.lit((1 << NODE_BITS) - 1))
    lines = lines.filter(has_word(F.col("line"))).select("doc_id", "line_no", "line", a.alias("a"), F.xxhash64("line", F.lit(1)).alias("b"))
    for seed, clash in enumerate(clashes, 2):
        # bounded: of n lines about n * n / 2^64 clash, some hundreds of 10^11
        lines = lines.join(F.broadcast(clash.select(F.col("a").alias("_c"))), F.col("a") == F.col("_c"), "left")
        lines = lines.withColumn("a", F.when(F.col("_c").isNull(), F.col("a")).otherwise(F.xxhash64("line", F.lit(seed)))).drop("_c")
    return lines


def signed_nodes(docs: DataFrame, base: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The lines, and a, at (the first place), keys (of its bands) of every distinct line, with nodes that no two lines share."""
    clashes: list[DataFrame] = []
    while True:
        lines = lines_of(docs, clashes)
        signed = stash(signatures(lines, base), "line-signed")
        clash = signed.filter("low <> high")
        if clash.isEmpty():
            return lines, signed.select("a", "at", "keys")
        clashes.append(stash(clash.select("a"), "line-clashes"))


def nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines, and a, at (the first place) of every distinct line, with nodes that no two lines share."""
    lines, signed = signed_nodes(docs)
    return lines, signed.select("a", "at")


def _units(line: Column) -> Column:
    return F.encode(line, "UTF-16BE")


def _shingle(units: Column, at: Column) -> Column:
    return _shingle_from(units, at * 2 + 1)


def _shingle_from(units: Column, octet: Column) -> Column:
    return F.xxhash64(F.substring(units, octet, F.lit(2 * SHINGLE)))


def _last(units: Column) -> Column:
    return F.greatest(F.lit(0), F.floor(F.octet_length(units) / 2).cast("int") - SHINGLE)


def points(n: int = BANDS * ROWS) -> list[int]:
    """Fixed points, spread by a multiplicative sequence over the positive longs."""
    return [(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 1 for k in range(1, n + 1)]


def _hashed(lines: DataFrame, chunk: int, *names: str) -> DataFrame:
    """The named columns, last and h0, h1 ..: the hashes of a line's shingles, chunk to a row."""
    units = lines.withColumn("u", _units(F.col("line"))).withColumn("last", _last(F.col("u")))
    chunks = units.select(*names, "u", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(chunk))).alias("_at"))
    # the last shingle stands for those beyond it: neither a set's least value nor a sketch changes
    return chunks.select(*names, "last", *[_shingle(F.col("u"), F.least(F.col("_at") + k, F.col("last"))).alias(f"h{k}") for k in range(chunk)])


def signatures(lines: DataFrame, base: int | None = None) -> DataFrame:
    """a, low and high (least and greatest second hash), at (the first place), keys (of the bands) of every distinct line."""
    hashed = _hashed(lines.select("a", "b", _place(base).alias("place"), "line"), CHUNK, "a", "b", "place")
    near = lambda p: F.least(*[F.col(f"h{k}").bitwiseXOR(F.lit(p)) for k in range(CHUNK)])
    # ANSI casts must not overflow: the shifted value is masked to 31 bits first
    nearest = [F.shiftrightunsigned(F.min(near(p)), 24).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias(f"m{k}") for k, p in enumerate(points())]
    signed = hashed.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.min("place").alias("at"), *nearest)
    keys = F.array(*[F.xxhash64(F.lit(j), *[F.col(f"m{j * ROWS + i}") for i in range(ROWS)]) for j in range(BANDS)])
    return signed.select("a", "low", "high", "at", keys.alias("keys"))


def band_keys(lines: DataFrame) -> DataFrame:
    """a, key: the band keys of every distinct line."""
    return signatures(lines).select("a", F.explode("keys").alias("key"))


def _few(df: DataFrame) -> DataFrame:
    """A stashed table of keys, to be broadcast where it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def bucket_members(keys: DataFrame) -> DataFrame:
    """key, a, head (the least line of the bucket), size, of every bucket of more than one line."""
    heads = keys.groupBy("key").agg(F.min("a").alias("head"), F.max("a").alias("tail"), F.count("*").alias("size"))
    heads = stash(heads.filter("head <> tail"), "line-buckets")
    # of two lines the least and the greatest are all; only for larger buckets the keys are gone through once more
    two = heads.filter("size = 2").select("key", F.explode(F.array("head", "tail")).alias("a"), "head", "size")
    large = stash(heads.filter("size > 2").select(F.col("key").alias("_key"), "head", "size"), "line-large-buckets")
    more = _few(large)
    more = more if more is not large else large.hint("shuffle_hash")
    return two.unionByName(keys.join(more, keys["key"] == large["_key"]).select("key", "a", "head", "size"))


def candidates(members: DataFrame) -> DataFrame:
    """x, y: each line of a bucket with its representative."""
    return members.filter("a <> head").select(F.col("a").alias("x"), F.col("head").alias("y")).distinct()


def unresolved(members: DataFrame, components: DataFrame) -> DataFrame:
    """key, a, head, c (component of a), hc (component of the head), work (pairs at most) of the buckets in which lines
    other than the head are still in different components."""
    named = members.filter("size > 2").join(components, members["a"] == components["node"], "left").select("key", "a", "head", "size", F.coalesce("component", "a").alias("c"))
    buckets = named.groupBy("key").agg(F.min_by("c", "a").alias("hc"), F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select(F.col("key").alias("_key"), "hc")
    open_ = stash(named.join(buckets, named["key"] == buckets["_key"]).select("key", "a", "head", "size", "c", "hc"), "line-open")
    work = open_.groupBy("key").agg((F.count_if(F.col("c") != F.col("hc")) * F.first("size")).alias("work")).withColumnRenamed("key", "_key")
    return open_.join(work, open_["key"] == work["_key"]).select("key", "a", "head", "c", "hc", "work")


def sketches(lines: DataFrame) -> DataFrame:
    """a, n (shingles, repeats included) and the words of the sketch of every line (a, line; each once)."""
    # dealt by line once: its bits are gathered by word, then its words side by side, where they are
    hashed = _hashed(lines.select("a", "line").repartition("a"), 1, "a").select("a", "last", "h0", F.shiftrightunsigned("h0", 6).bitwiseAND(F.lit(len(_WORDS) - 1)).cast("int").alias("j"))
    by_word = hashed.groupBy("a", "j").agg(F.max("last").alias("last"), F.bit_or(F.expr("shiftleft(1L, int(h0 & 63L))")).alias("bits"))
    words = [F.coalesce(F.bit_or(F.when(F.col("j") == j, F.col("bits"))), F.lit(0).cast("long")).alias(k) for j, k in enumerate(_WORDS)]
    return by_word.groupBy("a").agg((F.max("last") + 1).cast("long").alias("n"), *words)


def folded(sketched: DataFrame) -> DataFrame:
    """Sketches of half as many slots, each for two."""
    halves = zip(_FOLDED, _WORDS[len(_FOLDED) :])
    return sketched.select("a", "n", *[F.col(k).bitwiseOR(F.col(k2)).alias(k) for k, k2 in halves])


def _side(prefix: str, *names: str, words: Sequence[str] = _WORDS) -> list[Column]:
    return [F.col(k).alias(f"{prefix}_{k}") for k in ("a", "c", "n", *names, *words)]


def _may_match(similarity: float, words: Sequence[str] = _WORDS) -> Column:
    """Whether sides l and r may be similar: of n shingles in all, similar lines differ in n * (1 - s) / (1 + s) at most."""
    differing = sum((F.bit_count(F.col(f"l_{k}").bitwiseXOR(F.col(f"r_{k}"))) for k in words[1:]), F.bit_count(F.col("l_k0").bitwiseXOR(F.col("r_k0"))))
    return differing <= (F.col("l_n") + F.col("r_n")) * ((1 - similarity) / (1 + similarity)) + 1e-9


def _bucket_pairs(rest: DataFrame, sketched: DataFrame, similarity: float) -> DataFrame:
    """x, y: the pairs of different components in a bucket that may be similar; one of the two is outside the head's component."""
    rest = rest.join(folded(sketched), "a")
    l = rest.filter("c <> hc").select("key", *_side("l", words=_FOLDED))  # noqa: E741
    r = rest.filter("a <> head").select("key", *_side("r", words=_FOLDED), "hc")
    met = l.join(r, "key").filter("l_c <> r_c and (r_c = hc or l_a > r_a)").filter(_may_match(similarity, _FOLDED))
    return met.select(F.greatest("l_a", "r_a").alias("x"), F.least("l_a", "r_a").alias("y"))


def may_match(pairs: DataFrame, sketched: DataFrame, similarity: float, *names: str) -> DataFrame:
    """The pairs x, y (and the named columns) that their sketches do not rule out."""
    side = lambda p, k: sketched.select(F.col("a").alias(k), F.col("n").alias(f"{p}_n"), *[F.col(w).alias(f"{p}_{w}") for w in _WORDS])
    return pairs.join(side("l", "x"), "x").join(side("r", "y"), "y").filter(_may_match(similarity)).select("x", "y", *names)


def parities(sets: DataFrame) -> DataFrame:
    """a and sketches of sets (a, ws: distinct shingles) that tell more apart: bits set if an odd number of the set fall there."""
    w = F.col("w")
    slot, bit = F.shiftrightunsigned(w, 6).bitwiseAND(F.lit(len(_FOLDED) - 1)), F.expr("shiftleft(1L, int(w & 63L))")
    words = [F.coalesce(F.bit_xor(F.when(slot == j, bit)), F.lit(0).cast("long")).alias(k) for j, k in enumerate(_FOLDED)]
    return sets.select("a", F.explode("ws").alias("w")).groupBy("a").agg(*words)


def prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """a, n (distinct shingles), short, at, w, b1, b2 ..: the first shingles w of sets (a, ws) at their places at, for exact prefix filtering.

    A line's shingles are put in one order, rare ones first. The first common shingle of two similar lines then stands
    among the first of both, in one of them before short, with enough shingles behind it for the overlap that the
    similarity asks for. b1, b2 ..: the shingles just before w in that order.
    """
    counts = sets.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count("*").alias("f"))
    ordered = sets.select("a", F.explode("ws").alias("w")).join(counts, "w").groupBy("a").agg(F.sort_array(F.collect_list(F.struct("f", "w"))).alias("ws"))
    n = F.size("ws")
    least = lambda share: n - F.ceil(n * share - 1e-9).cast("int") + 1
    head = ordered.select("a", n.alias("n"), least(2 * similarity / (1 + similarity)).alias("short"), F.slice("ws", 1, least(similarity)).alias("ws"))
    first = head.select("a", "n", "short", F.col("ws.w").alias("all"), F.posexplode("ws").alias("at", "s")).filter("s.f > 1")
    return first.select("a", "n", "short", "at", F.col("s.w").alias("w"), *[F.get("all", F.col("at") - k).alias(f"b{k}") for k in range(1, BEFORE + 1)])


def prefix_stars(first: DataFrame, nodes: DataFrame, sketched: DataFrame, similarity: float) -> DataFrame:
    """x, y: each of nodes (a, c) with a line of another component: of the least ones by component of its rare shingles
    that its sketch does not rule out, the one met in most of them. At most one pair a line, whatever the size of its groups."""
    placed = first.select("a", "w").join(nodes, "a")
    heads = placed.groupBy("w").agg(F.min("c").alias("hc"), F.min_by("a", "c").alias("y"))
    met = placed.join(heads, "w").filter("c <> hc").groupBy(F.col("a").alias("x"), "y").agg(F.count("*").alias("n"))
    return may_match(met, sketched, similarity, "n").groupBy("x").agg(F.max_by("y", F.struct("n", "y")).alias("y"))


def prefix_pairs(first: DataFrame, nodes: DataFrame, parity: DataFrame, similarity: float) -> DataFrame:
    """x, y: a superset of the similar pairs of different components among nodes (a, c), by their prefixes.

    A pair is not met where both remember a common shingle before; at its first common one there is none."""
    first = first.join(nodes, "a").join(parity, "a")
    before = [f"b{k}" for k in range(1, BEFORE + 1)]
    l = first.filter("at < short").select("w", *_side("l", "at", *before, words=_FOLDED))  # noqa: E741
    r = first.select("w", *_side("r", "at", *before, words=_FOLDED))
    met = l.join(r, "w").filter("l_c <> r_c and (l_n < r_n or (l_n = r_n and l_a < r_a))")
    met = met.filter((F.col("l_n") >= F.col("r_n") * similarity - 1e-9) & (F.least(F.col("l_n") - F.col("l_at"), F.col("r_n") - F.col("r_at")) >= (F.col("l_n") + F.col("r_n")) * (similarity / (1 + similarity)) - 1e-9))
    again = " or ".join(f"l_{x} = r_{y}" for x in before for y in before)
    met = met.filter(f"not coalesce({again}, false)").filter(_may_match(similarity, _FOLDED))
    return met.select(F.greatest("l_a", "r_a").alias("x"), F.least("l_a", "r_a").alias("y"))


def _merged(nodes: DataFrame, column: str, links: DataFrame) -> DataFrame:
    """nodes whose component in the column is the one that links (x, y: components) give it."""
    names = connected_components(links, "x", "y", task_rows=LINKS).select(F.col("node").alias("_old"), F.col("component").alias("_new"))
    return nodes.join(names, nodes[column] == names["_old"], "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def star_links(first: DataFrame, nodes: DataFrame, sketched: DataFrame, lines: DataFrame, similarity: float) -> tuple[list[DataFrame], DataFrame]:
    """Links (x, y) found among nodes (a, c) in STARS rounds of prefix_stars, and the nodes with the components that they make."""
    found: list[DataFrame] = []
    for _ in range(STARS):
        links = stash(verified(stash(prefix_stars(first, nodes, sketched, similarity), "line-star-pairs"), lines, similarity), "line-star-links")
        if links.isEmpty():
            break
        found.append(links)
        name = lambda k: nodes.select(F.col("a").alias(k), F.col("c").alias(f"c{k}"))
        between = links.join(name("x"), "x").join(name("y"), "y").select(F.col("cx").alias("x"), F.col("cy").alias("y"))
        nodes = stash(_merged(nodes, "c", between), "line-large")
        if 4 * links.count() < nodes.count():
            break  # few lines have merged: a further round costs more than the pairs that it would spare
    return found, nodes


def remaining(rest: DataFrame, lines: DataFrame, similarity: float, at_once: int = AT_ONCE, sketched: DataFrame | None = None) -> DataFrame:
    """x, y: what is left to verify in unresolved buckets; all pairs of small ones, and of the lines of large ones star
    links and the prefix pairs that these leave in different components, in all without those that the sketches rule out.
    lines: a, line, each line once."""
    if sketched is None:
        sketched = stash(sketches(lines), "line-sketches")
    pairs = _bucket_pairs(rest.filter(F.col("work") <= at_once), sketched, similarity)
    large = stash(rest.filter(F.col("work") > at_once).select("a", "c").distinct(), "line-large")
    if not large.isEmpty():
        # of the tables by line only what is of these lines is shuffled from here on
        own = _few(large).select(F.col("a").alias("_own"))
        texts = stash(lines.select("a", "line").join(own, lines["a"] == F.col("_own"), "left_semi"), "line-large-texts")
        large_sketches = stash(sketched.join(own, sketched["a"] == F.col("_own"), "left_semi"), "line-large-sketches")
        sets = stash(texts.select("a", _shingles(F.col("line")).alias("ws")), "line-sets")
        first = stash(prefixes(sets, similarity), "line-prefixes")
        links, large = star_links(first, large, large_sketches, texts, similarity)
        for more in (*links, prefix_pairs(first, large, stash(parities(sets), "line-parities"), similarity)):
            pairs = pairs.unionByName(more)
    # held to the whole sketches once more: the buckets had them folded
    return may_match(pairs.distinct(), sketched, similarity)


def _shingles(line: Column) -> Column:
    # the encoded line is bound once, not encoded again for every shingle
    hashes = lambda u: F.array_distinct(F.transform(F.sequence(F.lit(1), _last(u) * 2 + 1, F.lit(2)), lambda i: _shingle_from(u, i)))
    return F.element_at(F.transform(F.array(_units(line)), hashes), 1)


def jaccard(left: Column, right: Column) -> Column:
    """Of the full shingle sets of two lines."""
    pair = F.struct(_shingles(left).alias("l"), _shingles(right).alias("r"))
    # bound once, like the encoded line, not intersected twice
    common = lambda p: F.array(F.size(F.array_intersect(p["l"], p["r"])))
    share = lambda p: F.element_at(F.transform(common(p), lambda n: n / (F.size(p["l"]) + F.size(p["r"]) - n)), 1)
    return F.element_at(F.transform(F.array(pair), share), 1)


def texts_of(members: DataFrame, lines: DataFrame) -> DataFrame:
    """a, line: the distinct lines that are members of some bucket."""
    nodes = stash(members.select(F.col("a").alias("_n")).distinct(), "line-nodes")
    few = _few(nodes)
    few = few if few is not nodes else nodes.hint("shuffle_hash")
    return lines.select("a", "line").join(few, lines["a"] == nodes["_n"], "left_semi").groupBy("a").agg(F.min("line").alias("line"))


def verified(pairs: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose lines are similar enough. lines: a, line, each line once."""
    left = lines.select(F.col("a").alias("x"), F.col("line").alias("left"))
    right = lines.select(F.col("a").alias("y"), F.col("line").alias("right"))
    both = pairs.join(left, "x").join(right, "y")
    return both.filter(jaccard(F.col("left"), F.col("right")) >= similarity).select("x", "y")


_LEAST_ID = -(1 << 63)


def place_base(docs: DataFrame) -> int | None:
    """The number taken from document ids so that a place fits in 64 bits; none where the ids are too far apart."""
    low, high = docs.select(F.col("doc_id").cast("long").alias("d")).agg(F.min("d"), F.max("d")).first()
    return None if low is None or high - low >= (1 << 32) - 1 else low - 1


def _place(base: int | None = None) -> Column:
    """Document and line as one number in their order, which aggregates without sorting; a null id is below every id.
    With a base (place_base), ids count from there and the number is a long."""
    if base is not None:
        # two steps: the base itself may be below the least long
        doc = F.coalesce(F.col("doc_id") - F.lit(base + 1) + F.lit(1).cast("long"), F.lit(0).cast("long"))
        return doc * F.lit(1 << 31) + F.col("line_no")
    doc = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(str(_LEAST_ID - 1)).cast("decimal(20,0)"))
    return (doc * F.lit(1 << 31).cast("decimal(11,0)") + F.col("line_no")).cast("decimal(31,0)")


def _placed(base: int | None) -> list[Column]:
    """doc_id and line_no of a place."""
    if base is not None:
        doc = F.shiftrightunsigned("at", 31)
        return [F.when(doc > 0, doc - F.lit(1).cast("long") + F.lit(base + 1)).alias("doc_id"), F.col("at").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("line_no")]
    line_no = F.pmod("at", F.lit(1 << 31)).cast("int")
    doc = ((F.col("at") - line_no) / F.lit(1 << 31)).cast("decimal(20,0)")
    return [F.when(doc >= F.lit(str(_LEAST_ID)).cast("decimal(20,0)"), doc.cast("long")).alias("doc_id"), line_no.alias("line_no")]


def kept_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, line_no of the lines that stay: one for every component."""
    base = place_base(docs)
    lines, signed = signed_nodes(docs, base)
    first = signed.select("a", "at")
    members = stash(bucket_members(signed.select("a", F.explode("keys").alias("key"))), "line-members")
    # fetched once for both rounds: every member meets its head in the first
    texts = stash(texts_of(members, lines), "line-texts")
    sketched = stash(sketches(texts), "line-sketches")
    links = stash(verified(stash(may_match(candidates(members), sketched, similarity), "line-pairs"), texts, similarity), "line-links")
    components = stash(connected_components(links, "x", "y", task_rows=LINKS), "line-components")
    rest = stash(unresolved(members, components), "line-rest")
    if not rest.isEmpty():
        more = stash(verified(stash(remaining(rest, texts, similarity, sketched=sketched), "line-more-pairs"), texts, similarity), "line-more-links")
        if not more.isEmpty():
            stars = components.filter("node <> component").select(F.col("node").alias("x"), F.col("component").alias("y"))
            components = stash(connected_components(stars.unionByName(more), "x", "y", task_rows=LINKS), "line-all-components")
    # of each component all lines but the first go
    placed = first.join(_few(components), first["a"] == components["node"]).select("component", "a", "at")
    placed = stash(placed, "line-placed")
    stays = placed.groupBy("component").agg(F.min_by("a", "at").alias("_stays")).withColumnRenamed("component", "_c")
    gone = stash(placed.join(stays, placed["component"] == stays["_c"]).filter("a <> _stays").select(F.col("a").alias("_gone")), "line-gone")
    return first.join(_few(gone), first["a"] == gone["_gone"], "left_anti").select(*_placed(base))


def line_count(text: Column) -> Column:
    """Lines with a word. Where every line starts with a word, which a search for bytes tells, they are the newlines and one."""
    text = F.coalesce(text, F.lit(""))
    blanks = ("\n", " ", "\t", "\x0b", "\x0c", "\r")
    doubtful = (text == "") | text.endswith("\n")
    for blank in blanks:
        doubtful = doubtful | text.startswith(blank) | text.contains("\n" + blank)
    newlines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(doubtful, F.regexp_count(text, F.lit(WORD_LINE))).otherwise(newlines + 1).cast("long")


def line_report(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_lines (lines with a word), kept (numbers of the lines that stay, in order) of every document."""
    # the numbers of a document as bits, 64 to a row, before they are listed
    bits = kept_lines(docs, similarity).repartition("doc_id").groupBy("doc_id", F.shiftright("line_no", 6).alias("j")).agg(F.bit_or(F.expr("shiftleft(1L, line_no & 63)")).alias("bits"))
    listed = F.expr("flatten(transform(_words, w -> transform(filter(sequence(0, 63), k -> (shiftrightunsigned(w.bits, k) & 1L) = 1L), k -> k + w.j * 64)))")
    kept = bits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("j", "bits"))).alias("_words")).select("doc_id", listed.alias("kept"))
    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), line_count(F.col("text")).alias("n_lines"))
    kept = kept.withColumnRenamed("doc_id", "_doc")
    return counts.join(kept, counts["doc_id"].eqNullSafe(kept["_doc"]), "left").select("doc_id", "n_lines", F.coalesce("kept", F.array().cast("array<int>")).alias("kept"))


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with the texts of which only kept and blank lines are left."""
    named, back = set_apart(docs, "doc_id", "text")
    kept = kept_lines(named, similarity).groupBy("doc_id").agg(F.collect_set("line_no").alias("_kept")).withColumnRenamed("doc_id", "_doc")
    joined = named.join(kept, named["doc_id"].eqNullSafe(kept["_doc"]), "left")
    stays = lambda x, i: ~has_word(x) | F.coalesce(F.array_contains(F.col("_kept"), i), F.lit(False))
    text = F.array_join(F.filter(F.split("text", "\n"), stays), "\n")
    return back(joined.withColumn("text", text))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = line_report(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return report.select(
        "doc_id",
        "n_lines",
        F.size("kept").cast("long").alias("n_kept"),
        (F.col("n_lines") - F.size("kept")).alias("n_removed"),
        F.sha2(F.array_join(F.col("kept").cast("array<string>"), ",").cast("binary"), 256).alias("kept_lines_sha256"),
    )


QUERIES = {"op9_line_dedup": op9_line_dedup}
