"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The items' words are numbered; one automaton holds all items. A text is streamed through it, tracking the longest match
that ends at each word; a window of ``span`` words (or a whole shorter item) occurs exactly where the match is long
enough, and its words are hit. Most words of a text start no match at all, so stretches are first cut out whose
neighbouring words all follow each other in some item (the automaton's states of depth two), and only those are walked.

Automata are built on the driver, which takes the benchmark in blocks of at most MAX_WORDS words, one at a time, each with
its own automaton; texts stream past one block after another, and between blocks what was found is written and read again.
So the benchmark may be of any size while what the driver holds and what is sent to the executors stays bounded.

Defined cases: null texts and items have no words; items without words are ignored; an item of fewer than ``span`` words
is one window; equal items are each reported; documents with equal ids are judged each; an empty benchmark hits nothing;
other columns come back as they were, whatever their names, from ``decontaminate``; ``find_hits`` replaces columns of
the names that it adds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackmill.llm.common import set_apart, stash, table

SPAN = 10
#: Words of benchmark items in one automaton; 100,000 take about 100 MB while it is built.
MAX_WORDS = 200_000
#: Lower-cases A-Z and turns every byte that is in no word into a space; bytes from 0x80 belong to words.
_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_TO_WORDS).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the items whose windows end in each state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], span: int = SPAN):
        self.span = span
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        pairs: set[int] = set()
        coded = []
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            coded.append((item, ids))
            pairs.update((a << 32) | b for a, b in zip(ids, ids[1:]))
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.pairs = np.array(sorted(pairs), np.int64)
        self.shortest = min([span, *(len(ids) for _, ids in coded)])
        #: windows by (state, length): a state stands for several lengths
        self.windows: dict[int, dict[int, set[str]]] = {}
        for item, ids in coded:
            n = min(span, len(ids))
            for at, (state, _) in enumerate(self.walk(ids)):
                if at + 1 >= n:
                    state = self.shrink(state, n)
                    self.windows.setdefault(state, {}).setdefault(n, set()).add(item)
        # from each state, the nearest state on its suffix path (itself included) that ends a window
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.window_state = [-1] * len(self.length)
        for s in order:
            self.window_state[s] = s if s in self.windows else self.window_state[self.link[s]] if self.link[s] >= 0 else -1

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            if self.length[q] == self.length[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return cur

    def _new(self, length: int, moves: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.next.append(moves)
        self.link.append(link)
        return len(self.length) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        twin = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def shrink(self, state: int, n: int) -> int:
        """The state of the last n words of a match that ends in state."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def walk(self, ids: Iterable[int]) -> Iterator[tuple[int, int]]:
        """(state, length of the longest match) after each word; -1 is a word of no item."""
        state = matched = 0
        for c in ids:
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if (to := self.next[state].get(c)) is not None:
                state, matched = to, matched + 1
            else:
                state = matched = 0
            yield state, matched

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(start, end) of the runs of words that may hold a window: known words, each pair of neighbours in some item."""
        known = ids >= 0
        if not known.any():
            return []
        joined = np.zeros(len(ids), bool)  # whether a word and the one before it follow each other in an item
        at = np.flatnonzero(known[1:] & known[:-1]) + 1
        if len(at) and len(self.pairs):
            pair = (ids[at - 1] << 32) | ids[at]
            place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[at] = self.pairs[place] == pair
        starts = np.flatnonzero(known & ~joined)
        ends = np.r_[starts[1:], len(ids)]
        # a run ends where the next one starts or at the first unknown word
        unknown = np.flatnonzero(np.r_[~known, True])
        ends = np.minimum(ends, unknown[np.searchsorted(unknown, starts)])
        keep = ends - starts >= self.shortest
        return list(zip(starts[keep].tolist(), ends[keep].tolist()))

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans of words (start, end), in order and possibly overlapping, and the items whose windows occur."""
        look = self.vocabulary.get
        ids = np.fromiter((look(w, -1) for w in words), np.int64, len(words))
        spans, items = [], set()
        for start, end in self.stretches(ids):
            for at, (state, matched) in enumerate(self.walk(ids[start:end].tolist()), start + 1):
                s = self.window_state[state]
                while s >= 0:
                    for n, owners in self.windows[s].items():
                        if n <= matched:
                            spans.append((at - n, at))
                            items |= owners
                    s = self.window_state[self.link[s]] if self.link[s] >= 0 else -1
        return spans, items


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint maximal spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def item_blocks(items: DataFrame, id_col: str, text_col: str, max_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Blocks of items, streamed from the table one partition at a time; a block has at most max_words words or one item."""
    block, size = [], 0
    for row in items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter("i is not null and t is not null").toLocalIterator():
        words = words_of(row["t"].encode())
        if not words:
            continue
        if block and size + len(words) > max_words:
            yield block
            block, size = [], 0
        block.append((row["i"], words))
        size += len(words)
    if block:
        yield block



def find_hits(docs: DataFrame, items: DataFrame, span: int = SPAN, max_words: int = MAX_WORDS, coverage: float | None = None) -> DataFrame:
    """docs (doc_id, text, ...) with n_words, spans (disjoint hit word spans) and items (ids of items with windows there)
    added; every text is read whole and no text is shuffled. With a coverage, texts come without their hit spans, and rows
    of which more than that share of the words is hit do not come."""
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    fields = docs.select(*keep).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["`n_words` bigint", "`spans` array<struct<start:int,end:int>>", "`items` array<string>"])
    where = keep.index("text")
    out = docs.select(*keep)
    shape = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    blocks = item_blocks(items, "item_id", "text", max_words)
    block, number = next(blocks, []), 0
    while block is not None:
        after = next(blocks, None)
        automaton = spark.sparkContext.broadcast(Automaton(block, span))

        def run(batches, automaton=automaton, later=number > 0, last=after is None):
            a = automaton.value
            for batch in batches:
                counts, spans, found, stay = [], [], [], []
                for k, text in enumerate(batch.column(where)):
                    words = words_of(text.as_buffer().to_pybytes()) if text.is_valid else []
                    s, i = a.hits(words) if a.vocabulary else ([], set())
                    if later:
                        s = s + [(x["start"], x["end"]) for x in batch.column(len(keep) + 1)[k].as_py()]
                        i = i | set(batch.column(len(keep) + 2)[k].as_py())
                    s = covered(s)
                    stay.append(coverage is None or sum(y - x for x, y in s) <= coverage * len(words))
                    counts.append(len(words))
                    spans.append([{"start": x, "end": y} for x, y in s])
                    found.append(sorted(i))
                columns = [batch.column(k) for k in range(len(keep))]
                if coverage is not None and last:
                    columns[where] = pa.array([remove_spans(t, [(x["start"], x["end"]) for x in s]) if s else t for t, s in zip(columns[where].to_pylist(), spans)], pa.string())
                    columns = [c.filter(pa.array(stay)) for c in columns]
                    counts, spans, found = ([x for x, y in zip(z, stay) if y] for z in (counts, spans, found))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(spans, shape), pa.array(found, pa.list_(pa.string()))], [*keep, "n_words", "spans", "items"])

        out = out.mapInArrow(run, schema)
        if after is not None:
            out = stash(out, "block-hits")
        block, number = after, number + 1
    return out


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the hit words and what lies between them; white space at the cut becomes one space."""
    if text is None:
        return None
    data = text.encode()
    low = data.translate(_TO_WORDS)
    places, at = [], 0
    for w in low.split():
        at = low.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    out, last = [], 0
    for a, b in spans:
        out.append(data[last : places[a][0]])
        last = places[b - 1][1]
    out.append(data[last:])
    return b" ".join(x.strip() for x in out if x.strip()).decode() if spans else text


def decontaminate(docs: DataFrame, items: DataFrame, span: int = SPAN, max_coverage: float = 0.5) -> DataFrame:
    """Documents with hit spans removed; documents of which more than max_coverage of the words are hit are dropped."""
    named, back = set_apart(docs, "text")
    return back(find_hits(named, items, span, coverage=max_coverage))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = find_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return hit.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


QUERIES = {"op3_decontaminate": op3_decontaminate}
