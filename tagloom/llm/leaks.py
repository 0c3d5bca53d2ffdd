"""Passages of test items in a training corpus.

Each shard of the corpus (the documents of one batch) gets a suffix array over its words.
Every suffix of every test item is looked up in it by binary search, and places where
neighbouring suffixes of an item go on side by side join into the longest verbatim matches.
The matches of a document and an item are then chained in the item's order, allowing a few
changed, added or lost words between them; the stretch a chain spans decides.

How few words a match may have, and how many an item's suffixes must find, follows from the
errors a stretch may hold: ``m`` words repeated with ``e`` errors lie in at most ``e + 1``
runs. So a stretch that counts finds at least ``need`` suffixes, and an item may leave out its
``need - 1`` most shared ones when documents are picked: wording that many items have in
common brings no document and item together. Picked pairs are counted in full before anything
is aligned. Both are bounds that hold for every case, so no case is lost to them.

The items are a small, fixed set and go to every executor, in groups of bounded size; should
they need several groups, the corpus is read once for each. The corpus isn't shuffled. A word
that is in no item can't be part of a match, so only runs of items' words are sorted, which
leaves the result as it is.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tagloom.llm.words import words

_OUT = "item_id bigint, matched int, span int, item_words int, at int, longest int"
_TINY = 1e-9


@dataclass(frozen=True)
class Params:
    """seed: words of a suffix that are looked up, fewer for items so short that a stretch need
    not hold such a run. share: part of an item's words that one stretch must repeat. errors:
    changed, added and lost words a stretch may hold, as a part of its words. gap: most such
    words on end. max_chars: characters of the items that are sent to the executors together
    (a single longer item goes alone). block: lookups done at once, which bounds memory."""

    seed: int = 4
    share: float = 0.5
    errors: float = 0.15
    gap: int = 12
    max_chars: int = 20_000_000
    block: int = 2_000_000

    def least_span(self, length: int) -> int:
        return max(1, ceil(self.share * length - _TINY))

    def slack(self, matched: int, errors: int) -> float:
        """Not negative iff a stretch of so many words may hold so many errors."""
        return self.errors * matched - (1 - self.errors) * errors

    def need(self, length: int, run: int) -> int:
        """Suffixes of an item of this length that a stretch finds, looked up by their first
        ``run`` words: each verbatim run gives its words less ``run - 1``."""
        least, e = length, 0
        while (m := max(self.least_span(length) - e, ceil(e * (1 - self.errors) / self.errors - _TINY) if e else 0, 1)) <= length:
            least = min(least, m - (run - 1) * (e + 1))
            e += 1
        return least

    def run(self, length: int) -> int:
        """Words looked up for an item: every stretch that counts holds such a run."""
        return max((r for r in range(1, self.seed + 1) if self.need(length, r) > 0), default=1)


class Items:
    """The test items as numbers of words. ``kinds`` holds the suffixes of all items that are
    looked up by the same number of words."""

    def __init__(self, rows: list[tuple[int, str | None]], params: Params) -> None:
        self.vocabulary: dict[str, int] = {}
        self.ids, texts = [], []
        for item, text in rows:
            w = words(text)
            if w:
                self.ids.append(item)
                texts.append([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w])
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 1)[:-1]]) if texts else np.zeros(0, np.int64)
        flat = array("i")
        for t in texts:
            flat.extend(t)
            flat.append(0)
        self.flat = np.frombuffer(flat, np.int32).astype(np.int64) if flat else np.zeros(0, np.int64)
        runs = np.array([params.run(int(n)) for n in self.lengths], np.int64)
        self.kinds = [Suffixes(self, run, np.flatnonzero(runs == run), params) for run in sorted(set(runs.tolist()))]

    def wording(self, item: int) -> list[int]:
        return self.flat[self.starts[item] : self.starts[item] + self.lengths[item]].tolist()


class Suffixes:
    """Suffixes of some items by their first ``run`` words. grams: the distinct beginnings;
    gram: the beginning of each suffix, item by item, in the item's order; those of item k
    (a number among these items) are gram[first[k] : first[k] + count[k]]."""

    def __init__(self, items: Items, run: int, who: np.ndarray, params: Params) -> None:
        self.run, self.who = run, who
        self.count = items.lengths[who] - run + 1
        self.first = _before(self.count)
        owner, place = _spread(self.count)
        grams = items.flat[(items.starts[who][owner] + place)[:, None] + np.arange(run)]
        self.grams, gram = np.unique(grams, axis=0, return_inverse=True)
        self.gram = gram.reshape(-1)
        self.need = np.array([params.need(int(n), run) for n in items.lengths[who]], np.int64)
        self.reach = np.array([ceil(n / (1 - params.errors)) + 1 for n in items.lengths[who]], np.int64)
        # The most shared beginnings of an item pick no documents.
        shared = np.bincount(np.unique(self.gram * len(who) + owner) // len(who), minlength=len(self.grams))
        order = np.lexsort((place, -shared[self.gram], owner))
        picks = np.empty(len(order), bool)
        picks[order] = place >= self.need[owner] - 1
        pairs = np.unique(self.gram[picks] * len(who) + owner[picks])
        self.picked, of = pairs % len(who), pairs // len(who)
        self.n_picked = np.bincount(of, minlength=len(self.grams))
        self.first_picked = _before(self.n_picked)


def _before(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, k): every k below lengths[which]."""
    which = np.repeat(np.arange(len(lengths)), lengths)
    return which, np.arange(len(which)) - np.repeat(_before(lengths), lengths)


def _blocks(weights: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of about this weight, one element at least."""
    ends = np.cumsum(weights)
    start = 0
    while start < len(weights):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield slice(start, stop)
        start = stop


def suffix_array(text: np.ndarray, seed: int, depth: int) -> np.ndarray:
    """Positions that begin a run of at least ``seed`` known words (not 0), in the order of
    the text that follows, up to ``depth`` words or the run's end. Prefix doubling: ranks
    by 2k words come from pairs of ranks by k words."""
    known = text > 0
    stop = np.flatnonzero(~np.append(known, False))
    run_end = stop[np.searchsorted(stop, np.arange(len(text)))] if len(text) else np.zeros(0, np.int64)
    live = np.flatnonzero(run_end - np.arange(len(text)) > 0)
    rank = np.zeros(len(text) + 1, np.int64)
    rank[live] = text[live]
    reach = 1
    while reach < depth and len(live):
        ahead = np.minimum(live + reach, len(text))
        pair = rank[live] << 32 | np.where(live + reach < run_end[live], rank[ahead], 0)
        distinct, at = np.unique(pair, return_inverse=True)
        same = len(distinct) == len(live)
        rank[live] = at + 1
        reach *= 2
        if same:
            break
    long_enough = live[run_end[live] - live >= seed]
    return long_enough[np.argsort(rank[long_enough], kind="stable")]


def _bounds(text: np.ndarray, suffixes: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[from, to) in the suffix array of the suffixes that begin with each gram."""
    width = grams.shape[1]

    def search(right: bool) -> np.ndarray:
        low, high = np.zeros(len(grams), np.int64), np.full(len(grams), len(suffixes))
        while (open_ := low < high).any():
            mid = (low + high) // 2
            at = suffixes[np.minimum(mid, len(suffixes) - 1)]
            less = np.zeros(len(grams), bool)
            even = np.ones(len(grams), bool)
            for k in range(width):
                here = text[at + k]
                less |= even & (here < grams[:, k])
                even &= here == grams[:, k]
            go = (less | even if right else less) & open_
            low = np.where(go, mid + 1, low)
            high = np.where(open_ & ~go, mid, high)
        return low

    return search(False), search(True)


class Found:
    """Where the beginnings of suffixes stand in a shard: sorted numbers of gram and place."""

    def __init__(self, text: np.ndarray, kind: Suffixes, depth: int) -> None:
        suffixes = suffix_array(text, kind.run, depth)
        low, high = _bounds(text, suffixes, kind.grams) if len(suffixes) else (np.zeros(0, np.int64),) * 2
        gram, k = _spread(high - low)
        self.size = len(text) + 1
        self.gram, self.place = gram, suffixes[low[gram] + k] if len(gram) else gram
        self.code = np.sort(gram * self.size + self.place)

    def ranges(self, gram: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[from, to) in ``code`` of the places of each gram in [low, high)."""
        return np.searchsorted(self.code, gram * self.size + low), np.searchsorted(self.code, gram * self.size + high)


def _pairs(found: Found, kind: Suffixes, starts: np.ndarray, params: Params) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, item of the kind): pairs that may count, in blocks."""
    ends = np.append(starts[1:], found.size - 1)
    doc = np.searchsorted(starts, found.place, "right") - 1
    present = np.unique(doc * len(kind.grams) + found.gram)
    present = present[kind.n_picked[present % len(kind.grams)] > 0]
    doc, gram = np.divmod(present, len(kind.grams))
    for some in _blocks(kind.n_picked[gram], params.block):
        at, k = _spread(kind.n_picked[gram[some]])
        pair = np.unique(doc[some][at] * len(kind.who) + kind.picked[kind.first_picked[gram[some][at]] + k])
        for few in _blocks(kind.count[pair % len(kind.who)], params.block):
            d, i = np.divmod(pair[few], len(kind.who))
            of, place = _spread(kind.count[i])
            low, high = found.ranges(kind.gram[kind.first[i][of] + place], starts[d][of], ends[d][of])
            enough = np.bincount(of[high > low], minlength=len(d)) >= kind.need[i]
            if enough.any():
                yield d[enough], i[enough]


def _matches(found: Found, kind: Suffixes, doc: np.ndarray, item: np.ndarray, starts: np.ndarray, params: Params) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(pair, places in text, places in item, words): the maximal verbatim matches of each pair,
    window by window. A stretch is no longer than ``reach``, so windows of four times that which
    overlap by one hold every stretch whole, and a long document is never laid out at once."""
    ends = np.append(starts[1:], found.size - 1)
    pair, k = _spread(np.maximum(-(-(ends[doc] - starts[doc] - kind.reach[item]) // (3 * kind.reach[item])), 1))
    low = starts[doc[pair]] + 3 * kind.reach[item[pair]] * k
    high = np.minimum(low + 4 * kind.reach[item[pair]], ends[doc[pair]])
    for some in _blocks(kind.count[item[pair]], params.block):
        of, window_low, window_high = pair[some], low[some], high[some]
        window, q = _spread(kind.count[item[of]])
        begin, end = found.ranges(kind.gram[kind.first[item[of]][window] + q], window_low[window], window_high[window])
        enough = np.bincount(window[end > begin], minlength=len(of)) >= kind.need[item[of]]
        hits = np.where(enough[window], end - begin, 0)
        for few in _blocks(np.bincount(window, hits, len(of)).astype(np.int64), params.block):
            here = slice(*np.searchsorted(window, [few.start, few.stop]))
            at, k = _spread(hits[here])
            w, q_at = window[here][at], q[here][at]
            p_at = found.code[begin[here][at] + k] % found.size
            order = np.lexsort((p_at, p_at - q_at, w))
            w, q_at, p_at = w[order], q_at[order], p_at[order]
            joined = (w[1:] == w[:-1]) & (p_at[1:] == p_at[:-1] + 1) & (q_at[1:] == q_at[:-1] + 1)
            first = np.flatnonzero(np.concatenate([[True], ~joined])) if len(w) else np.zeros(0, np.int64)
            size = np.diff(np.append(first, len(w))) + kind.run - 1
            edges = np.flatnonzero(np.diff(w[first], prepend=-1, append=-1)).tolist() if len(first) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield int(of[w[first[a]]]), p_at[first[a:b]], q_at[first[a:b]], size[a:b]


#: (slack, words of the text, words matched, errors)
_Way = tuple[float, int, int, int]


def _ways(a: list[int], b: list[int], params: Params) -> list[list[_Way]]:
    """table[i][j]: the best alignment of a[:i] with b[:j]; a changed, added or left out
    word is one error."""
    good, bad = params.slack(1, 0), params.slack(0, 1)
    table = [[(j * bad, 0, 0, j) for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        above, row = table[-1], [(i * bad, i, 0, i)]
        for j, y in enumerate(b, 1):
            s, _, m, e = above[j - 1]
            step = (s + good, i, m + 1, e) if x == y and x else (s + bad, i, m, e + 1)
            for s, _, m, e in (above[j], row[j - 1]):
                if s + bad > step[0]:
                    step = (s + bad, i, m, e + 1)
            row.append(step)
        table.append(row)
    return table


def _extensions(a: list[int], b: list[int], params: Params) -> list[tuple[int, _Way]]:
    """(words of the item, best way) for every number of item words a stretch may go on by."""
    table = _ways(a, b, params)
    return [(j, max(row[j] for row in table)) for j in range(len(b) + 1)]


def _undominated(ends: dict[tuple[int, int], tuple[float, int, int]], room: float) -> dict[tuple[int, int], tuple[float, int, int]]:
    """Of chains with one end, by where they begin: those that another with an earlier begin
    and no less slack doesn't make needless, and that what may follow can still save."""
    kept: dict[tuple[int, int], tuple[float, int, int]] = {}
    most = -room - _TINY
    for begin, state in sorted(ends.items(), key=lambda x: (x[0][0], -x[1][0])):
        if state[0] > most:
            kept[begin] = state
            most = state[0]
    return kept


def best_stretch(p: list[int], q: list[int], size: list[int], text: list[int], item: list[int], params: Params) -> tuple[int, int, int] | None:
    """(matched, span, place) of the stretch that counts and repeats most words in the item's
    order. text is read by the places p, item by the places q.

    A stretch is a chain of matches. The words between two of them, at most ``gap``, and those
    before and after are aligned word by word. Of each chain's beginnings all are kept that may
    still matter: an earlier one spans more, a later one may hold fewer errors."""
    gap, least = params.gap, params.least_span(len(item))
    per_word = params.slack(1, 0)
    chains: list[tuple[int, int, dict[tuple[int, int], tuple[float, int, int]]]] = []  # end p, end q, begin: (slack, matched, errors)
    near: dict[int, list[int]] = defaultdict(list)  # open chains by diagonal
    for k in sorted(range(len(p)), key=lambda k: (q[k], p[k])):
        ends = {(q[k], p[k]): (params.slack(size[k], 0), size[k], 0)}
        lane = (p[k] - q[k]) // (gap + 1)
        for side in (lane - 1, lane, lane + 1):
            if side not in near:
                continue
            near[side] = [c for c in near[side] if chains[c][1] + gap >= q[k]]  # later matches begin no earlier
            for c in near[side]:
                end_p, end_q, states = chains[c]
                over = max(end_p - p[k], end_q - q[k], 0)  # matches may overlap by a word or so
                if over >= size[k] or p[k] + size[k] <= end_p or q[k] + size[k] <= end_q:
                    continue
                on_p, on_q = p[k] + over, q[k] + over
                if max(on_p - end_p, on_q - end_q) > gap:
                    continue
                s, _, m, e = _ways(text[end_p:on_p], item[end_q:on_q], params)[-1][-1]
                s, m = s + params.slack(size[k] - over, 0), m + size[k] - over
                for begin, (s0, m0, e0) in states.items():
                    if begin not in ends or ends[begin][0] < s0 + s:
                        ends[begin] = (s0 + s, m0 + m, e0 + e)
        end_q = q[k] + size[k]
        chains.append((p[k] + size[k], end_q, _undominated(ends, per_word * (len(item) - end_q + gap))))
        near[(p[k] - q[k]) // (gap + 1)].append(len(chains) - 1)
    best: tuple[int, int, int] | None = None
    before: dict[tuple[int, int], list[tuple[int, _Way]]] = {}
    for end_p, end_q, states in sorted(chains, key=lambda c: -c[1]):
        after = None
        for (begin_q, begin_p), (s0, m0, _) in states.items():
            if end_q - begin_q + 2 * gap < least or s0 + 2 * gap * per_word < -_TINY or best and m0 + 2 * gap <= best[0]:
                continue
            if after is None:
                after = _extensions(text[end_p : end_p + gap], item[end_q : end_q + gap], params)
            if (begin_q, begin_p) not in before:
                back_p, back_q = max(begin_p - gap, 0), max(begin_q - gap, 0)
                before[begin_q, begin_p] = _extensions(text[back_p:begin_p][::-1], item[back_q:begin_q][::-1], params)
            for j, (s1, _, m1, _) in after:
                for i, (s2, words_p, m2, _) in before[begin_q, begin_p]:
                    span = end_q - begin_q + i + j
                    if span >= least and s0 + s1 + s2 >= -_TINY and (best is None or (m0 + m1 + m2, span) > best[:2]):
                        best = (m0 + m1 + m2, span, begin_p - words_p)
    return best


def scan(texts: list[str | None], items: Items, params: Params) -> list[tuple[int, int, int, int, int, int, int]]:
    """(text's number, item's number, matched, span, item's words, place, longest verbatim
    match) of each text and item with a stretch that counts."""
    flat, starts = array("i"), []
    get = items.vocabulary.get
    for t in texts:
        starts.append(len(flat))
        flat.extend([get(w, 0) for w in words(t)])
        flat.append(0)
    text = np.frombuffer(flat, np.int32).astype(np.int64) if flat else np.zeros(0, np.int64)
    start = np.array(starts, np.int64)
    out: dict[tuple[int, int], tuple[int, ...]] = {}
    for kind in items.kinds:
        found = Found(text, kind, int(items.lengths.max(initial=1)))
        for doc, item in _pairs(found, kind, start, params):
            for pair, p, q, size in _matches(found, kind, doc, item, start, params):
                d, i = int(doc[pair]), int(kind.who[item[pair]])
                low = max(int(start[d]), int(p.min()) - int(kind.reach[item[pair]]))
                high = min(int(start[d + 1]) - 1 if d + 1 < len(start) else len(text) - 1, int((p + size).max()) + int(kind.reach[item[pair]]))
                stretch = best_stretch((p - low).tolist(), q.tolist(), size.tolist(), text[low:high].tolist(), items.wording(i), params)
                if stretch:
                    known = out.get((d, i), (0,) * 7)
                    new = (d, i, stretch[0], stretch[1], int(items.lengths[i]), stretch[2] + low - int(start[d]), int(size.max()))
                    out[d, i] = (*max(known[:6], new[:6], key=lambda x: x[2:4]), max(known[6], new[6]))
    return list(out.values())


def _groups(benchmark: DataFrame, params: Params) -> Iterator[Items]:
    """The items, a bounded number of characters at a time."""
    held: list[tuple[int, str]] = []
    size = 0
    for r in benchmark.select("item_id", "text").filter("text IS NOT NULL").toLocalIterator():
        if held and size + len(r["text"]) > params.max_chars:
            yield Items(held, params)
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += len(r["text"])
    yield Items(held, params)


def leaks(documents: DataFrame, benchmark: DataFrame, params: Params | None = None) -> DataFrame:
    """``(doc_id, item_id, matched, span, item_words, at, longest)``: documents and the items
    they leak, with the words matched, the item's words the stretch spans, the stretch's place
    in words, and the words of the longest verbatim match.

    Case, punctuation, spacing, line breaks and character forms don't matter. Null and
    empty texts, and items without a word, leak nothing; each pair comes once
    per row of ``documents``.
    """
    params = params or Params()
    narrow = documents.select("doc_id", "text")
    schema = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, {_OUT}"

    def searched(items: Items) -> DataFrame:
        shared = documents.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            its = shared.value
            for batch in batches:
                found = scan(batch.column(1).to_pylist(), its, params)
                take = pa.array([f[0] for f in found], pa.int64())
                columns = [pa.array([its.ids[f[1]] for f in found], pa.int64()), *[pa.array([f[k] for f in found], pa.int32()) for k in range(2, 7)]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), *columns], ["doc_id", "item_id", "matched", "span", "item_words", "at", "longest"])

        return narrow.mapInArrow(run, schema)

    return reduce(DataFrame.union, map(searched, _groups(benchmark, params)))


def without_leaks(documents: DataFrame, benchmark: DataFrame, params: Params | None = None) -> DataFrame:
    """The documents that leak no item. The ids of leaking ones are shuffled or broadcast
    as their size allows; the choice is Spark's, by the size it measures."""
    return documents.join(leaks(documents, benchmark, params).select("doc_id").distinct(), "doc_id", "left_anti")
