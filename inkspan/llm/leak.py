"""Evaluation texts that leak into training text, by a generalised suffix automaton of the normalised items.

The automaton holds every word sequence of every item. A document's words are streamed through it and the longest match that ends
at each word is tracked, with the shorter ones of items that the longest does not belong to, so the spans shared with every item come out
in one pass. An item whose spans cover enough is checked exactly: one stretch of the document, in the item's order, with at most
one word in eight changed, missing or added.

Only automata of the items are broadcast, each of a bounded size. Defined results: null and empty documents match nothing; an item
without words is ignored; equal items each count; a document is read whole; every stretch of an item comes, also several in one document.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from difflib import SequenceMatcher
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.tables import cut

#: Words of items that one automaton holds; more items make more automata.
SHARD_WORDS = 1_000_000
SCHEMA = "doc_id long, item_id long, coverage double, start int, end int, run int"
#: Share of an item's words that makes a leak; one word in EDIT may differ; spans of SEED words and more are gathered.
COVERAGE, EDIT, SEED = 0.3, 8, 3
#: Coverage that a stretch has with its edits allowed; so many equal words in a row leak whatever share of the item they are.
ENOUGH, LENGTH = COVERAGE * (1 - 1 / EDIT), 13

_TOKEN = re.compile(r"<[^<>]{0,200}>|&#?\w{1,8};|\w+(?:-\n\w+)?")


def tokens(text: str) -> list[tuple[str, int, int]]:
    """Normalised words with their offsets; markup and entities are no words."""
    out = []
    for m in _TOKEN.finditer(text):
        w = m.group()
        if w[0] == "<":
            continue
        if w[0] == "&":
            w = html.unescape(w)
            if not w.isalnum():
                continue
        w = w.strip("_")
        if not w:
            continue
        w = w.casefold() if w.isascii() else unicodedata.normalize("NFKC", w).casefold()
        out.append((w.replace("-\n", ""), m.start(), m.end()))
    return out


class Automaton:
    """Suffix automaton over several word sequences."""

    def __init__(self, items: list[list[str]]):
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[set[int]] = [set()]
        for k, ws in enumerate(items):
            last = 0
            for w in ws:
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)))
                self.items[last].add(k)
        for v in sorted(range(1, len(self.length)), key=lambda v: -self.length[v]):
            if self.link[v] > 0:
                self.items[self.link[v]] |= self.items[v]

    def _new(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.items.append(set())
        return len(self.length) - 1

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        cur = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return cur

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def spans(self, words: list[str], least: int) -> list[tuple[int, int, int]]:
        """(start, end, state) of the matches of at least ``least`` words that no longer match holds."""
        out, state, n = [], 0, 0
        ids, nxt, link, length = self.ids, self.next, self.link, self.length
        for i, w in enumerate(words):
            c = ids.get(w, -1)
            if c < 0:
                if n >= least:
                    out.append((i - n, i, state))
                state = n = 0
                continue
            if c not in nxt[state]:
                if n >= least:
                    out.append((i - n, i, state))
                while state and c not in nxt[state]:
                    state = link[state]
                    n = length[state]
                if c not in nxt[state]:
                    n = 0
                    continue
            state = nxt[state][c]
            n += 1
        if n >= least:
            out.append((len(words) - n, len(words), state))
        return out

    def item_spans(self, words: list[str], least: int) -> dict[int, list[tuple[int, int]]]:
        """By item, its own (start, end) matches of at least ``least`` words that no longer match of the same item holds.

        What the longest match does not credit comes with its suffixes: they are walked at every word that ends a match.
        """
        out: dict[int, list[tuple[int, int]]] = {}
        state, n = 0, 0
        held: dict[int, int] = {}  # item: length of its longest match that ends here
        ids, nxt, link, length, items = self.ids, self.next, self.link, self.length, self.items
        for i, w in enumerate(words):
            c = ids.get(w, -1)
            if c < 0:
                state = n = 0
            else:
                while state and c not in nxt[state]:
                    state = link[state]
                    n = length[state]
                if c in nxt[state]:
                    state = nxt[state][c]
                    n += 1
            now: dict[int, int] = {}
            if n >= least:
                v, m = state, n
                while m >= least:
                    if len(items[v]) > len(now):
                        for k in items[v]:
                            now.setdefault(k, m)
                    v = link[v]
                    m = length[v]
            for k, m in held.items():
                if now.get(k) != m + 1:
                    out.setdefault(k, []).append((i - m, i))
            held = now
        for k, m in held.items():
            out.setdefault(k, []).append((len(words) - m, len(words)))
        return out


def best_stretch(item: list[str], words: list[str]) -> tuple[int, int, int, int] | None:
    """(words of the item in it, edits, start, end) of the stretch that holds most of the item within the edit limit."""
    blocks = [b for b in SequenceMatcher(None, item, words, autojunk=False).get_matching_blocks() if b.size > 1 or (b.size and len(item) < 12)]
    best = None
    for i in range(len(blocks)):
        same = edits = 0
        for j in range(i, len(blocks)):
            b = blocks[j]
            if j > i:
                p = blocks[j - 1]
                edits += max(b.a - p.a - p.size, b.b - p.b - p.size)
            same += b.size
            span = b.b + b.size - blocks[i].b
            if edits * EDIT <= max(span, b.a + b.size - blocks[i].a) + EDIT // 2 and (best is None or same > best[0]):
                best = (same, edits, blocks[i].b, b.b + b.size)
    return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, [w for w, _, _ in tokens(t)]) for i, t in items]
        self.items = [(i, ws) for i, ws in self.items if ws]
        self.automaton = Automaton([ws for _, ws in self.items])

    def leaks(self, text: str) -> list[tuple[int, float, int, int, int]]:
        """(item_id, coverage, start, end, longest run of equal words) of every stretch of an item that leaks into the text; offsets in code points.

        A stretch leaks by its coverage, or as LENGTH and more equal words in a row outside those stretches.
        """
        toks = tokens(text)
        words = [w for w, _, _ in toks]
        out = []
        for k, spans in self.automaton.item_spans(words, SEED).items():
            item_id, ws = self.items[k]
            parts = self._stretches(ws, words, spans)
            starts, ends = [a for _, a, _ in parts], [b for _, b in spans]
            at = lambda a, i=starts: bisect_right(i, a) - 1
            parts += [(b - a, a, b) for a, b in spans if b - a >= LENGTH and (at(a) < 0 or parts[at(a)][2] < b)]
            for same, a, b in sorted(parts, key=lambda p: p[1:]):
                longest = max((min(b, d) - max(a, c) for c, d in spans[bisect_right(ends, a) : bisect_left(ends, b) + 1]), default=0)
                out.append((item_id, same / len(ws), toks[a][1], toks[b - 1][2], longest))
        return out

    def _stretches(self, ws: list[str], words: list[str], spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(words of the item, start, end) of all stretches that cover enough of an item, best first and without overlaps."""
        seen = sorted({p for a, b in spans for p in range(a, b)})
        least = COVERAGE * len(ws)
        heap: list[tuple[int, int, int, int, int]] = []

        def look(lo: int, hi: int) -> None:
            if bisect_left(seen, hi) - bisect_left(seen, lo) < least / 2:
                return
            got = best_stretch(ws, words[lo:hi])
            if got and got[0] >= least * (1 - 1 / EDIT):
                heappush(heap, (-got[0], lo + got[2], lo + got[3], lo, hi))

        if len(seen) < least / 2:
            return []
        done, step = -1, max(1, len(ws) // 4)
        for a, _ in sorted(spans):  # windows of the document around the spans
            if a >= done:
                look(max(0, a - len(ws) // EDIT - 4), min(len(words), a + len(ws) + step + len(ws) // EDIT + 4))
                done = a + step
        out: list[tuple[int, int, int]] = []  # by place; parts of a window beside what is taken are looked at again
        while heap:
            same, a, b, lo, hi = heappop(heap)
            k = bisect_left(out, lo, key=lambda p: p[1])
            k -= k > 0 and out[k - 1][2] > lo
            inside = []
            while k < len(out) and out[k][1] < hi:
                inside.append(out[k][1:])
                k += 1
            if not any(c < b and a < d for c, d in inside):
                insort(out, (-same, a, b), key=lambda p: p[1])
                inside = sorted([*inside, (a, b)])
            at = lo
            for c, d in [*inside, (hi, hi)]:
                if c - at > 0:
                    look(at, c)
                at = max(at, d)
        return out


def matchers(items: DataFrame, words: int | None = None) -> Iterator[Matcher]:
    """Matchers over all items, each for as many as hold ``words`` words together: any number of items is searched, in as many passes as that takes."""
    part: list[tuple[int, str]] = []
    room = words = words or SHARD_WORDS
    for r in items.where("text is not null").select("item_id", "text").toLocalIterator():
        n = len(r.text.split())
        if part and n > room:
            yield Matcher(part)
            part, room = [], words
        part.append((r.item_id, r.text))
        room -= n
    if part:
        yield Matcher(part)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, coverage, start, end, run of every leaked stretch of ``items`` (item_id, text) in ``docs`` (doc_id, text); run: most equal words in a row.

    An item has a row for each of its stretches. Those with less than ``ENOUGH`` coverage are there for their length only.
    The automaton is built once and read by each worker once.
    """
    spark = docs.sparkSession
    found = None
    for matcher in matchers(items):
        shared = spark.sparkContext.broadcast(matcher)

        def run(batches, shared=shared):
            for b in batches:
                out = [(d, *x) for d, t in zip(b.doc_id, b.text) if isinstance(t, str) for x in shared.value.leaks(t)]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "coverage", "start", "end", "run"])

        part = docs.select("doc_id", "text").mapInPandas(run, SCHEMA)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if found is None else found


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(text[at : max(at, a)])
        at = max(at, b)
    return "".join([*out, text[at:]])


def without_leaks(docs: DataFrame, items: DataFrame, most: float = COVERAGE) -> DataFrame:
    """doc_id, text, removed: the documents with every leaked stretch of at least ``most`` of an item, or with LENGTH equal words in a row, cut out, and how many were."""
    spark = docs.sparkSession
    every = matchers(items)
    matcher, more = next(every, None), next(every, None)
    if more is None:
        shared = spark.sparkContext.broadcast(matcher)

        def run(batches):
            for b in batches:
                spans = [[(a, e) for _, share, a, e, n in shared.value.leaks(t) if _cut_out(share, n, most)] if shared.value and isinstance(t, str) else [] for t in b.text]
                texts = [without_spans(t, s) if isinstance(t, str) else None for t, s in zip(b.text, spans)]
                yield pd.DataFrame({"doc_id": b.doc_id, "text": pd.Series(texts, dtype=object, index=b.index), "removed": pd.Series([len(s) for s in spans], dtype="int32", index=b.index)})

        return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, text string, removed int")
    rows = cut(docs.select(F.monotonically_increasing_id().alias("doc_id"), F.col("doc_id").alias("_own"), "text"))
    bad = leaks(rows, items).where((F.col("coverage") >= most * (1 - 1 / EDIT)) | (F.col("run") >= LENGTH))
    bad = bad.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))

    def clean(batches):
        for b in batches:
            spans = [[(x["start"], x["end"]) for x in s] if s is not None else [] for s in b["_spans"]]
            texts = [without_spans(t, s) if isinstance(t, str) else None for t, s in zip(b["text"], spans)]
            yield pd.DataFrame({"doc_id": b["_own"], "text": pd.Series(texts, dtype=object, index=b.index), "removed": pd.Series([len(s) for s in spans], dtype="int32", index=b.index)})

    return rows.join(bad, "doc_id", "left").select("_own", "text", "_spans").mapInPandas(clean, "doc_id long, text string, removed int")


def _cut_out(share: float, run: int, most: float) -> bool:
    return share >= most * (1 - 1 / EDIT) or run >= LENGTH
