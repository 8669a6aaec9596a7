"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

Text is lower-cased (A-Z) and cut into words of ASCII letters, digits and all that is not ASCII. One
automaton accepts every run of words of every item. Each document streams through it; at every word it
gives the longest run that ends there and occurs in an item. Runs of ``window`` words (or a whole item,
when the item is shorter) are hits.

Test sets are small, but nothing here relies on it: items are counted first and dealt by a hash to as
many automata of about ``automaton_words`` words as they need (a longer item has one of its own). The
automata are broadcast one by one, and documents stream through one after the other in the same stage.

Defined results. Null or empty text: no words, no hits. Items without words are never hit. Repeated
items (same id or same text) count by id; an item with a null id counts for hits, not for item lists.
Documents with equal ids are judged one by one. Empty tables give no hits or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import batch, pieces, small_batches, utf8
from sitegauge.llm.words import LETTERED, window_hashes, word_bounds, word_hashes

WINDOW = 10
AUTOMATON_WORDS = 400_000
BYTES_PER_STEP = 1 << 19


class SuffixAutomaton:
    """Generalised suffix automaton over word hashes, with the test items that each hit state stands for."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], window: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.window = window
        marks: dict[int, dict[int, set]] = {}
        kept = [(i, w) for i, w in items if len(w)]
        for _, words in kept:
            last = 0
            for w in words.tolist():
                last = self._extend(last, w)
        for item, words in kept:  # the state of each window, by walking the finished automaton
            size = min(window, len(words))
            for state in self._window_states(words.tolist(), size):
                marks.setdefault(state, {}).setdefault(size, set()).add(item)
        #: For each marked state: (length of the run, items), longest first.
        self.marks = {s: sorted(((n, frozenset(i)) for n, i in m.items()), key=lambda x: -x[0]) for s, m in marks.items()}
        self.above = self._marked_above()
        self.shortest = min((min(window, len(w)) for _, w in kept), default=0)
        self.known = np.unique(np.concatenate([w for _, w in kept])) if kept else np.zeros(0, np.uint64)
        pairs = [window_hashes(w, 2) for _, w in kept]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(w)) is not None:  # the run is there already, from an earlier item
            return q if length[q] == length[last] + 1 else self._split(last, q, w)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, w)
        return cur

    def _split(self, p: int, q: int, w: int) -> int:
        """A state of its own for the shorter runs of ``q``."""
        nxt, link, length = self.next, self.link, self.length
        short = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = short
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = short
            p = link[p]
        return short

    def _window_states(self, words: list[int], size: int) -> Iterator[int]:
        state, matched = 0, 0
        for w in words:
            state, matched = self.step(state, matched, w)
            while self.length[self.link[state]] >= size:
                state = self.link[state]
            matched = min(matched, self.length[state])
            if matched >= size:
                yield state

    def _marked_above(self) -> list[int]:
        """For each state, the nearest marked state among itself and its suffix links, or -1."""
        above = [-1] * len(self.next)
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            above[s] = s if s in self.marks else above[self.link[s]] if s else -1
        return above

    def step(self, state: int, matched: int, w: int) -> tuple[int, int]:
        """Read a word: the state and length of the longest run that ends with it."""
        nxt = self.next
        while state and w not in nxt[state]:
            state = self.link[state]
            matched = self.length[state]
        if w in nxt[state]:
            return nxt[state][w], matched + 1
        return 0, 0

    def stretches(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of words, each within one text, whose words or neighbouring pairs all occur in items."""
        if self.shortest == 0 or len(hashes) == 0:
            return
        if self.shortest == 1:
            ok = _among(hashes, self.known)
            ok = np.insert(ok, np.unique(first[1:-1]), False) if len(first) > 2 else ok
            places = np.insert(np.arange(len(hashes)), np.unique(first[1:-1]), -1) if len(first) > 2 else np.arange(len(hashes))
            edge = np.diff(np.concatenate([[0], ok.astype(np.int8), [0]]))
            for lo, hi in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                yield int(places[lo]), int(places[hi - 1]) + 1
            return
        ok = _among(window_hashes(hashes, 2), self.pairs)
        across = first[1:-1] - 1
        ok[across[(across >= 0) & (across < len(ok))]] = False
        edge = np.diff(np.concatenate([[0], ok.astype(np.int8), [0]]))
        for lo, hi in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1, strict=True):
            if hi - lo >= self.shortest:
                yield int(lo), int(hi)

    def scan(self, hashes: np.ndarray) -> tuple[list[tuple[int, int]], set]:
        """Hit spans of a stretch of words (merged) and the items whose windows occur in it."""
        spans: list[tuple[int, int]] = []
        items: set = set()
        seen: set[int] = set()
        state = matched = 0
        for at, w in enumerate(hashes.tolist(), 1):
            state, matched = self.step(state, matched, w)
            mark, longest = self.above[state], 0
            while mark != -1:
                for n, who in self.marks[mark]:
                    if n <= matched:
                        longest = max(longest, n)
                        if (mark, n) not in seen:
                            seen.add((mark, n))
                            items |= who
                mark = self.above[self.link[mark]]
            if longest:
                spans.append((at - longest, at))
        return merged(spans), items


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as sorted spans that don't touch."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def automata(benchmark: DataFrame, window: int = WINDOW, automaton_words: int = AUTOMATON_WORDS) -> Iterator[SuffixAutomaton]:
    """Automata over all items, one after the other; the items are dealt by a hash into shares of about ``automaton_words``."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0  # a word takes a byte and a separator at least
    shares = 1 + int(size // automaton_words)
    dealt = items.withColumn("share", F.pmod(F.xxhash64("item", "text"), F.lit(shares)))
    for k in range(shares):
        rows = dealt.where(F.col("share") == k).select("item", "text").distinct().collect()
        words = []
        for r in rows:
            data = np.frombuffer(r.text.encode(), np.uint8)
            starts, ends, _ = word_bounds(data, np.array([0, len(data)]), LETTERED)
            words.append((r.item, word_hashes(data, starts, ends)))
        yield SuffixAutomaton(words, window)


FOUND = "__found struct<n_words: bigint, spans: array<array<bigint>>, items: array<string>>"


def _scanning(automaton, schema: pa.Schema):
    """A function for mapInArrow that adds an automaton's hits to the column of findings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto: SuffixAutomaton = automaton.value
        for b in pieces(batches, "text", BYTES_PER_STEP):
            data, offsets = utf8(b.column("text"))
            starts, ends, first = word_bounds(data, offsets, LETTERED)
            hashes = word_hashes(data, starts, ends)
            new: dict[int, tuple[list, set]] = {}
            for lo, hi in auto.stretches(hashes, first):
                spans, items = auto.scan(hashes[lo:hi])
                if spans:
                    doc = int(np.searchsorted(first, lo, "right")) - 1
                    old = new.setdefault(doc, ([], set()))
                    old[0].extend((lo - first[doc] + x, lo - first[doc] + y) for x, y in spans)
                    old[1].update(items)
            found = []
            for k, old in enumerate(b.column("__found").to_pylist()):
                spans, items = new.get(k, ([], set()))
                if old["spans"]:
                    spans, items = [*spans, *map(tuple, old["spans"])], items | set(old["items"])
                found.append({"n_words": int(first[k + 1] - first[k]), "spans": [[int(x), int(y)] for x, y in merged(spans)], "items": sorted(i for i in items if i is not None)})
            columns = {f.name: b.column(f.name).cast(f.type) for f in schema if f.name != "__found"}
            yield batch(schema, **columns, __found=pa.array(found, schema.field("__found").type))

    return run


def scanned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """``docs`` with a column ``__found``: number of words, merged hit spans as word positions, ids of items that occur."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    small_batches(spark)
    nothing = F.struct(F.lit(0).cast("long").alias("n_words"), F.array().cast("array<array<bigint>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    frame, built = docs.withColumn("__found", nothing), list(map(spark.sparkContext.broadcast, automata(benchmark, window)))
    for k, automaton in enumerate(built):
        out = frame.schema if keep_text or k + 1 < len(built) else frame.drop("text").schema
        frame = frame.mapInArrow(_scanning(automaton, to_arrow_schema(out)), out)
    return frame


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, hit spans [start, end) in words, and the ids of the items whose windows occur."""
    found = scanned(docs.select("doc_id", "text"), benchmark, window, keep_text=False)
    return found.select("doc_id", "__found.n_words", "__found.spans", "__found.items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_share: float = 0.5) -> DataFrame:
    """Documents without the words of test items: same columns, ``n_chars`` counted anew where it exists.

    A matched run of ``window`` words or more is cut out of the text, from its first letter to its last.
    Where more than ``max_share`` of a document's words are hit, the document goes. Null texts stay.
    """
    found = scanned(docs, benchmark, window)
    schema = docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b.column("__found").to_pylist()
            keep = [k for k, f in enumerate(found) if sum(y - x for x, y in f["spans"]) <= max_share * f["n_words"]]
            source = b.column("text").to_pylist()
            clean = [_without(source[k], found[k]["spans"]) for k in keep]
            b = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(clean, pa.string()) if n == "text" else b.column(n) for n in schema.names], names=schema.names)

    out = found.mapInArrow(cut, schema)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(schema["n_chars"].dataType)) if "n_chars" in schema.names else out


def _without(text: str | None, spans: list[list[int]]) -> str | None:
    if not spans:
        return text
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]), LETTERED)
    at, out = 0, []
    for x, y in spans:
        out.append(raw[at : starts[x]])
        at = ends[y - 1]
    return b"".join([*out, raw[at:]]).decode()
