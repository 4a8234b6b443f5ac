"""Suffix-array dedup: removes bytes covered by 50-byte strings that also start in a document with a smaller id.

Two equal windows of 50 bytes hold the same 20-byte anchor, the one of their 31 with the smallest hash, at the same place.
So the corpus is dealt by anchors:

1. Equal texts are found by two 64-bit digests. All but the copy with the smallest id go whole and take no further part.
   Anchors of all documents are sorted by hash; those that two different texts share go back to their texts.
2. Each text gives, for each shared anchor, its context: the bytes of the windows that have this anchor, at most 80.
   Contexts are sorted by anchor, bytes and document.
3. In a stream over the sorted contexts, an equal context of a smaller document covers a context whole. What is left is
   each anchor's different contexts, each with its smallest document. They are sorted by suffix arrays in blocks: equal
   windows are neighbours, and a window goes where a smaller document has it. A shared window reaches l bytes to the left
   of the anchor and 30 - l to the right; a context that shares no such part with another one of its anchor, for l in
   steps of 5, can't share a window and is left out. Where text repeats, a context holds its anchor at several places,
   and each window is judged by the leftmost one that it holds.
4. An anchor that more than HOT texts share, or that has more than HELD different contexts, is dealt anew: each of its
   contexts is cut by the longer anchors, of FINE bytes, of its windows, and step 3 is done again with these. What is
   still too large for a stream is dealt by whole windows, whose smallest document is an aggregate joined back.
5. Each document's covered ranges are united and cut out.

Memory: a stream holds at most HELD different contexts; if these exceed BLOCK bytes they are compared part by part, cut
to the few bytes around each part, where most of them are equal. Every step is a table or a shuffle, so lost executors cost their tasks alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import LAST_ID, bounded_batches, discard, release, shared_folder, table, written
from tallywright.llm.suffix_array import window_runs

#: Fixed value: the length of the strings that are matched.
WIDTH = 50
ANCHOR = 20
FINE = 35
STEP = 5
HOT = 1 << 16
HELD = 1 << 14
GROUP = 1 << 16
BLOCK = 1 << 14
U = np.uint64
P = 0x9E3779B97F4A7C15
#: The bits of an anchor's hash that tell anchors apart; in those below, its rows are sorted by their text's digest, as one number.
#: Two anchors of one hash cost some comparisons and change no result, as contexts are compared by their bytes.
KEPT = ~0xFFFFF
TEXT = 0x1E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def least_of(x: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """The minimum (or maximum) of every run of width values, by doubling."""
    have = 1
    while 2 * have <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(data: np.ndarray, doc: np.ndarray, length: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of neighbouring windows with the same anchor: first and last window, the anchor's place and hash.

    The documents lie end to end; doc numbers each byte's document. A run has at most as many windows as an anchor has
    places in one: longer runs, which only repeating text has, are cut. An anchor of WIDTH bytes is the window itself.
    """
    side = WIDTH - length
    n, none = len(data), np.zeros(0, np.int64)
    if n < WIDTH:
        return none, none, none, none.astype(np.uint64)
    part, have = data.astype(np.uint64) + U(1), 1
    h, done = None, 0
    while True:
        if length & have:
            h = part if h is None else part[: n - have - done + 1] * U(pow(P, done, 1 << 64)) + h[have:]
            done += have
        if 2 * have > length:
            break
        part = part[:-have] * U(pow(P, have, 1 << 64)) + part[have:]
        have *= 2
    h = mixed(h)
    low = least_of(h, side + 1)
    low[doc[: n - WIDTH + 1] != doc[WIDTH - 1 :]] = 0
    first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    last = np.append(first[1:], len(low)) - 1
    keep = low[first] > 0
    first, last = first[keep], last[keep]
    while (long := last - first > side).any():
        rest = first[long] + side + 1
        first, last = np.concatenate([first, rest]), np.concatenate([np.where(long, first + side, last), last[long]])
        order = np.argsort(first, kind="stable")
        first, last = first[order], last[order]
    value, at = low[first], first.copy()
    while len(miss := np.flatnonzero(h[at] != value)):
        at[miss] += 1
    return first, last, at, value


def grouped(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of texts: the first's number, the bytes, the text of each byte (from 0), where texts begin."""
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) < GROUP):
            size += len(texts[end])
            end += 1
        lengths = np.array([len(t) for t in texts[start:end]])
        data = np.frombuffer(b"".join(texts[start:end]), np.uint8)
        yield start, data, np.repeat(np.arange(end - start), lengths), np.concatenate(([0], np.cumsum(lengths)))
        start = end


def encoded(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """p1, text to h, p1, known: a text's anchors.

    An anchor that three texts of a batch hold is known to be shared: two rows tell its other texts so, and the rest of
    them, known, need not be dealt by h. So an anchor of a third of all texts is no hot key.
    """
    for batch in batches:
        ids, found = batch.column("p1").to_numpy(), []
        for start, data, doc, _ in grouped(encoded(batch.column("text"))):
            first, _, _, h = anchors(data, doc)
            found.append((h.view(np.int64) & KEPT, ids[start + doc[first]]))
        h, p1 = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        known = np.zeros(len(h), bool)
        values = np.sort(h)
        often = np.unique(values[2:][values[2:] == values[:-2]])
        if len(often):
            at = np.flatnonzero(often[np.minimum(np.searchsorted(often, h), len(often) - 1)] == h)
            at = at[np.lexsort((p1[at], h[at]))]
            same_h, same = h[at][1:] == h[at][:-1], p1[at][1:] == p1[at][:-1]
            again = np.concatenate(([False], same_h & same))
            at, same_h = at[~again], np.concatenate(([False], same_h))[~again]
            third = np.concatenate((np.zeros(min(2, len(at)), bool), same_h[2:] & same_h[1:-1]))
            known[at[third]] = True
            keep = np.ones(len(h), bool)
            keep[np.flatnonzero(np.isin(h, often))] = False
            keep[at] = True
            h, p1, known = h[keep], p1[keep], known[keep]
        yield pa.RecordBatch.from_pydict({"h": pa.array(h), "p1": pa.array(p1), "known": pa.array(known)})


def shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h to the ones whose h stands with another p1 too, and the known ones; a run may reach over batches.

    Of equal rows that follow each other one is given.
    """
    held: tuple[int, int] | None = None  # the last row, not yet given, or None if it was
    last: int | None = None
    before = None
    for batch in batches:
        h, doc = batch.column("h").to_numpy(), batch.column("p1").to_numpy()
        known = batch.column("known").to_numpy(zero_copy_only=False)
        if known.any():
            yield pa.RecordBatch.from_pydict({"h": pa.array(h[known]), "p1": pa.array(doc[known])})
            h, doc = h[~known], doc[~known]
        if not len(h):
            continue
        new = np.ones(len(h), bool)
        new[0] = (h[0], doc[0]) != before
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        before = (h[-1], doc[-1])
        h, doc = h[new], doc[new]
        if not len(h):
            continue
        first = np.concatenate(([True], h[1:] != h[:-1]))
        run = np.cumsum(first) - 1
        begin = np.flatnonzero(first)
        low, high = np.minimum.reduceat(doc, begin), np.maximum.reduceat(doc, begin)
        good = low != high
        out_h, out_doc = [], []
        if last is not None and h[0] == last:  # the first run goes on
            if held is None or held[1] != low[0] or good[0]:
                good[0] = True
                if held is not None:
                    out_h.append(held[0])
                    out_doc.append(held[1])
                    held = None
        keep = good[run]
        out_h, out_doc = np.concatenate([np.array(out_h, np.int64), h[keep]]), np.concatenate([np.array(out_doc, np.int64), doc[keep]])
        same = last is not None and h[0] == last and len(begin) == 1
        if not (same and not good[0]):
            held = None if good[-1] else (int(h[-1]), int(doc[-1]))
        last = int(h[-1])
        yield pa.RecordBatch.from_pydict({"h": pa.array(out_h), "p1": pa.array(out_doc)})


def context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, p1, p2, text, shared (a text's shared anchors) to h, context, anchor, doc, p1, p2, start.

    Of a batch's equal contexts only those of its smallest document are given; it covers the others whole, which become
    covered ranges at once: rows without a context, with the length as anchor and any h.
    """
    for batch in batches:
        keys, texts = {n: batch.column(n).to_numpy() for n in ("doc", "p1", "p2")}, encoded(batch.column("text"))
        lists = batch.column("shared")
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        contexts, found = [], []
        for start, data, doc, begin in grouped(texts):
            first, last, at, h = anchors(data, doc)
            h, own = h.view(np.int64) & KEPT, doc[first]
            ends = offsets[start : start + len(begin)]
            wanted = values[ends[0] : ends[-1]] ^ np.repeat(np.arange(len(begin) - 1), np.diff(ends)) * TEXT  # a hash of text and anchor
            keep = np.isin(h ^ own * TEXT, wanted)
            low, high, at, h, own = first[keep], last[keep] + WIDTH, at[keep], h[keep], own[keep]
            raw = data.tobytes()
            contexts += [raw[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
            found.append((h, (at - low).astype(np.int32), start + own, (low - begin[own]).astype(np.int32)))
        if not contexts:
            continue
        h, anchor, row, place = (np.concatenate(x) for x in zip(*found, strict=True))
        doc, stay = keys["doc"][row], np.ones(len(h), bool)
        order = np.argsort(h, kind="stable")
        twice = np.zeros(len(h), bool)
        same = h[order][1:] == h[order][:-1]
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        least: dict[bytes, int] = {}
        several = np.flatnonzero(twice).tolist()
        for k in several:
            least[contexts[k]] = min(least.get(contexts[k], LAST_ID), int(doc[k]))
        for k in several:
            stay[k] = doc[k] == least[contexts[k]]
        gone = np.flatnonzero(~stay)
        size = np.array([len(contexts[k]) for k in gone.tolist()], np.int32)
        h[gone], anchor[gone] = keys["p1"][row[gone]], size
        column = pa.array([c if s else None for c, s in zip(contexts, stay.tolist(), strict=True)], pa.binary()) if len(gone) else pa.array(contexts, pa.binary())
        yield pa.RecordBatch.from_pydict({"h": pa.array(h), "context": column, "anchor": pa.array(anchor)} | {n: pa.array(x[row]) for n, x in keys.items()} | {"start": pa.array(place)})


def refined(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows of contexts to rows of their shorter contexts, by anchors of length bytes; known ranges stay as they are."""
    for batch in batches:
        ready = pc.is_null(batch.column("context"))
        if pc.any(ready).as_py():
            yield batch.filter(ready)
            batch = batch.filter(pc.invert(ready))
        found: dict[str, list[np.ndarray]] = {"h": [], "anchor": [], "start": [], "row": []}
        texts, contexts, starts = batch.column("context").to_pylist(), [], batch.column("start").to_numpy()
        for start, data, doc, begin in grouped(texts):
            first, last, at, h = anchors(data, doc, length)
            raw, own = data.tobytes(), doc[first]
            contexts += [raw[a:b] for a, b in zip(first.tolist(), (last + WIDTH).tolist(), strict=True)]
            row = start + own
            for name, x in (("h", h.view(np.int64)), ("anchor", at - first), ("start", starts[row] + first - begin[own]), ("row", row)):
                found[name].append(x)
        if contexts:
            row = np.concatenate(found["row"])
            columns = {"h": pa.array(np.concatenate(found["h"])), "context": pa.array(contexts, pa.binary()), "anchor": pa.array(np.concatenate(found["anchor"]).astype(np.int32))}
            columns |= {n: batch.column(n).take(pa.array(row)) for n in ("doc", "p1", "p2")}
            yield pa.RecordBatch.from_pydict(columns | {"start": pa.array(np.concatenate(found["start"]).astype(np.int32))})


def hot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As context_rows, for hot anchors: their contexts by the longer anchors."""
    return refined(context_rows(batches), FINE)


def anchor_places(context: bytes, first: int, length: int) -> list[tuple[int, int]]:
    """Each place of a context's anchor, first being the leftmost, and how far to the left windows reach that hold none before it.

    Every window has one leftmost place, the same in equal windows. Only repeating text has several in a context.
    """
    anchor, side = context[first : first + length], WIDTH - length
    out = [(first, side)]
    place = context.find(anchor, first + 1)
    while place >= 0:
        out.append((place, min(side, place - out[-1][0] - 1)))
        place = context.find(anchor, place + 1)
    return out


class Block:
    """Contexts to be compared by suffix arrays."""

    def __init__(self, length: int):
        self.length, self.side = length, WIDTH - length  # of the anchors
        self.rows: list[tuple[bytes, int, list[tuple[tuple[int, int], int]]]] = []
        self.size = 0
        self.ranges: list[tuple[int, tuple[int, int], int, int]] = []  # doc, text, start, end

    def take(self, contexts: list[tuple[bytes, int, int, list[tuple[tuple[int, int], int]]]]) -> None:
        """One anchor's different contexts as (bytes, place of the anchor, smallest document, its texts and starts)."""
        sides: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
        for k, (c, a, _, _) in enumerate(contexts):
            for place, most in anchor_places(c, a, self.length):
                for left in range(0, min(most, self.side - 1) + 1, STEP):
                    right = self.side - STEP - left + 1 if left + STEP < self.side else self.side - left - STEP
                    if place >= left and len(c) - place - self.length >= right:
                        sides.setdefault((left, c[place - left : place + self.length + right]), []).append((k, place, most))
        classes = {side: x for side, x in sides.items() if x[0][0] != x[-1][0]}
        if sum(len(c[0]) for c in contexts) <= BLOCK:
            reach: dict[int, tuple[int, int]] = {}  # the first and the last of a context's windows that hold a shared part
            for (left, _), own in classes.items():
                for k, place, _ in own:
                    low, high = place - (left + STEP - 1 if left + STEP < self.side else self.side), place - left
                    known = reach.get(k, (low, high))
                    reach[k] = min(low, known[0]), max(high, known[1])
            for k in sorted(reach):
                c, _, doc, places = contexts[k]
                low, high = max(0, reach[k][0]), reach[k][1] + WIDTH
                self.add(c[low:high], doc, [(text, p + low) for text, p in places] if low else places)
        else:
            for (left, _), own in classes.items():
                self.split(left, [(contexts[k], place, most) for k, place, most in own])
        if self.size > BLOCK:
            self.flush()

    def split(self, left: int, contexts: list[tuple[tuple[bytes, int, int, list[tuple[tuple[int, int], int]]], int, int]]) -> None:
        """Contexts with a common part around a place, cut to the windows that hold it and have that leftmost place: most are then equal, and only the first is compared."""
        first: dict[bytes, tuple[int, list[tuple[tuple[int, int], int]]]] = {}
        for (c, _, doc, places), a, most in sorted(contexts, key=lambda x: x[0][2]):
            low = max(0, a - min(most, left + STEP - 1 if left + STEP < self.side else self.side))
            short = c[low : a + WIDTH - left]
            if len(short) >= WIDTH:
                moved = [(part, p + low) for part, p in places]
                known = first.setdefault(short, (doc, moved))
                if known[0] < doc:
                    self.ranges += [(doc, part, p, p + len(short)) for part, p in moved]
                elif known[1] is not moved:
                    known[1].extend(moved)
        if len(first) > 1:
            for short, (doc, places) in first.items():
                self.add(short, doc, places)
            if self.size > BLOCK:
                self.flush()

    def add(self, context: bytes, doc: int, places: list[tuple[tuple[int, int], int]]) -> None:
        self.rows.append((context, doc, places))
        self.size += len(context) + 1

    def flush(self) -> None:
        if len(self.rows) > 1:
            size = np.array([len(c) for c, _, _ in self.rows])
            begin = np.cumsum(size + 1) - size - 1
            row = np.repeat(np.arange(len(size)), size + 1)
            text = b"".join([c + b"\xff" for c, _, _ in self.rows])  # a byte that UTF-8 never has
            order, run = window_runs(text, np.arange(len(text)) - begin[row] <= (size - WIDTH)[row], WIDTH)
            doc = np.array([d for _, d, _ in self.rows], np.int64)[row[order]]
            least = np.minimum.reduceat(doc, np.flatnonzero(np.diff(run, prepend=-1)))
            gone = np.sort(order[doc > least[run]])
            if len(gone):
                own = row[gone]
                new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (np.diff(gone) > WIDTH))))
                first, last, own = gone[new], gone[np.append(new[1:], len(gone)) - 1] + WIDTH, own[new]
                for k, a, b in zip(own.tolist(), (first - begin[own]).tolist(), (last - begin[own]).tolist(), strict=True):
                    self.ranges += [(self.rows[k][1], part, p + a, p + b) for part, p in self.rows[k][2]]
        self.rows, self.size = [], 0


def covered(batches: Iterator[pa.RecordBatch], length: int = ANCHOR, finer: int = FINE, most: int = HELD) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by h, context, anchor, doc, start to covered ranges and to contexts that have to be dealt anew.

    A range has doc, p1, p2, start, end; a context that is dealt anew has no end but h, context, anchor, by anchors of
    finer bytes. The latter are those of an anchor with more than `most` different contexts.
    """
    block, group, anew = Block(length), [], []
    key = place = context = None  # of the last row, and the document that leads its run
    leader, many = 0, False  # many: the contexts of the anchor are dealt anew

    def close() -> None:
        if len(group) > 1:
            block.take(group)
        group.clear()

    def given(*more: np.ndarray) -> pa.RecordBatch:
        own = np.array([(doc, *text, a, b) for doc, text, a, b in block.ranges], np.int64).reshape(-1, 5).T
        block.ranges = []
        columns = [np.concatenate(x) for x in zip(own, more, strict=True)] if more else own
        out = {n: pa.array(np.ascontiguousarray(x)) for n, x in zip(("doc", "p1", "p2", "start", "end"), columns, strict=True)}
        n = len(out["doc"])
        return pa.RecordBatch.from_pydict(out | {"h": pa.nulls(n, pa.int64()), "context": pa.nulls(n, pa.binary()), "anchor": pa.nulls(n, pa.int32())})

    def dealt() -> Iterator[pa.RecordBatch]:
        for a in range(0, len(anew), 1024):
            contexts, doc, p1, p2, start = zip(*anew[a : a + 1024], strict=True)
            columns = {n: pa.array(x, pa.int64()) for n, x in (("doc", doc), ("p1", p1), ("p2", p2), ("start", start))}
            for b in refined(iter([pa.RecordBatch.from_pydict({"context": pa.array(contexts, pa.binary())} | columns)]), finer):
                out = {n: b.column(n) for n in ("doc", "p1", "p2")}
                out |= {"start": b.column("start").cast(pa.int64()), "end": pa.nulls(b.num_rows, pa.int64())}
                yield pa.RecordBatch.from_pydict(out | {n: b.column(n) for n in ("h", "context", "anchor")})
        anew.clear()

    for batch in batches:
        ready = pc.is_null(batch.column("context"))
        if pc.any(ready).as_py():  # ranges that are known already
            given_ = batch.filter(ready)
            doc, p1, p2, start, size = (given_.column(n).to_numpy().astype(np.int64) for n in ("doc", "p1", "p2", "start", "anchor"))
            yield given(doc, p1, p2, start, start + size)
            batch = batch.filter(pc.invert(ready))
        if not batch.num_rows:
            continue
        contexts = batch.column("context")
        h, anchor, doc, p1, p2, start = (batch.column(n).to_numpy() for n in ("h", "anchor", "doc", "p1", "p2", "start"))
        again = np.zeros(len(h), bool)  # the row has the context of the row before
        again[0] = h[0] == key and anchor[0] == place and contexts[0].as_py() == context
        again[1:] = (h[1:] == h[:-1]) & (anchor[1:] == anchor[:-1]) & pc.equal(contexts[1:], contexts[:-1]).to_numpy(zero_copy_only=False)
        leaders = np.concatenate(([leader], doc[~again]))[np.cumsum(~again)]
        later = doc > leaders
        size = pc.binary_length(contexts).to_numpy()
        rest = np.flatnonzero(~later)
        for k, c in zip(rest.tolist(), contexts.take(pa.array(rest)).to_pylist(), strict=True):
            place_ = (int(p1[k]), int(p2[k])), int(start[k])
            if h[k] != key:
                close()
                key, many = h[k], False
            if many:
                anew.append((c, int(doc[k]), *place_[0], place_[1]))
            elif again[k]:
                group[-1][3].append(place_)
            else:
                group.append((c, int(anchor[k]), int(doc[k]), [place_]))
                if len(group) > most:
                    anew += [(c_, doc_, *text, at) for c_, _, doc_, places in group for text, at in places]
                    group.clear()
                    many = True
        key, place, context, leader = h[-1], anchor[-1], contexts[len(h) - 1].as_py(), int(leaders[-1])
        yield given(doc[later], p1[later], p2[later], start[later], start[later] + size[later])
        yield from dealt()
    close()
    block.flush()
    yield given()


def united(ranges: list[dict]) -> list[tuple[int, int]]:
    """Disjoint, maximal ranges."""
    out: list[list[int]] = []
    for a, b in sorted((r["start"], r["end"]) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, ranges to row, removed (ranges) and kept (bytes)."""
    for batch in batches:
        removed, kept = [], []
        for data, ranges in zip(encoded(batch.column("row").field("text")), batch.column("ranges").to_pylist(), strict=True):
            gone, at, parts = united(ranges or []), 0, []
            for a, b in gone:
                parts.append(data[at:a])
                at = b
            removed.append([{"start": a, "end": b} for a, b in gone])
            kept.append(b"".join([*parts, data[at:]]))
        yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "removed": pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary())})


def dedup_spans(docs: DataFrame) -> DataFrame:
    """Cuts every byte covered by a 50-byte string that also starts in a document with a smaller id.

    docs: doc_id, text and any further columns, whatever their names; they come back in the struct row. Texts are UTF-8
    bytes, a null text is empty. Matches are judged on the input and lie within documents. Rows with the same id are one
    document, which never covers itself; a null id is one document after all others. An empty table gives no rows.
    Returns row, removed (maximal ranges start, end) and kept (the bytes that stay, which may cut a character).
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    bounded_batches(spark)
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    p1, p2 = F.xxhash64("text"), F.xxhash64(F.lit(WIDTH), "text")  # rows with the same id may have different texts
    plain = docs.filter(F.octet_length("text") >= WIDTH).select(doc.alias("doc"), p1.alias("p1"), p2.alias("p2"), "text")
    light = plain.select("doc", "p1", "p2", F.octet_length("text").cast("long").alias("end"))
    first = light.groupBy("p1", "p2").agg(F.min("doc").alias("doc"), F.max("doc").alias("last"))
    first = written(first, folder, "first")
    several = first.filter("last > doc").select("p1", "p2", F.col("doc").alias("first"))
    copies = light.join(several, ["p1", "p2"]).filter("doc > first").select("doc", "p1", "p2", F.lit(0).cast("long").alias("start"), "end")

    rows = plain.select("p1", "text").mapInArrow(anchor_rows, "h bigint, p1 bigint, known boolean")
    rows = rows.repartition(shuffles, F.when(F.col("known"), F.col("p1")).otherwise(F.col("h")))
    rows = rows.sortWithinPartitions(F.col("h").bitwiseOR(F.col("p1").bitwiseAND(F.lit(~KEPT))))  # one number, which Spark sorts by radix
    shared = written(rows.mapInArrow(shared_anchors, "h bigint, p1 bigint"), folder, "shared")
    del rows
    release(spark)
    hot = written(shared.groupBy("h").count().filter(F.col("count") > HOT).select("h"), folder, "hot")
    form = "h bigint, context binary, anchor int, doc bigint, p1 bigint, p2 bigint, start int"

    def contexts_of(shared: DataFrame, made) -> DataFrame:
        lists = shared.groupBy("p1").agg(F.collect_list("h").alias("shared"))
        lists = first.drop("last").join(lists.hint("shuffle_hash"), "p1").hint("shuffle_hash")
        return plain.join(lists, ["doc", "p1", "p2"]).mapInArrow(made, form)

    def compared(contexts: DataFrame, length: int, finer: int, name: str) -> tuple[DataFrame, DataFrame]:
        """The ranges that contexts cover, and the contexts that have to be dealt anew."""
        contexts = contexts.repartition(shuffles, "h").sortWithinPartitions("h", "context", "anchor", "doc", "start")
        made = contexts.mapInArrow(partial(covered, length=length, finer=finer, most=HELD), f"doc bigint, p1 bigint, p2 bigint, start bigint, end bigint, {form.split(', doc')[0]}")
        made = written(made, folder, name)
        anew = made.filter("context is not null").select("h", "context", "anchor", "doc", "p1", "p2", F.col("start").cast("int"))
        return made.filter("context is null").select("doc", "p1", "p2", "start", "end"), anew

    any_hot = not hot.isEmpty()
    ranges, anew = compared(contexts_of(shared.join(hot, "h", "left_anti") if any_hot else shared, context_rows), ANCHOR, FINE, "ranges")
    if any_hot:
        anew = anew.unionByName(contexts_of(shared.join(hot, "h", "left_semi"), hot_rows))
    if any_hot or not anew.isEmpty():
        more, anew = compared(anew, FINE, WIDTH, "ranges-fine")
        ranges = ranges.unionByName(more)
        if not anew.isEmpty():
            least = anew.groupBy("h", "context").agg(F.min("doc").alias("least"))
            last = anew.join(least, ["h", "context"]).filter("doc > least")
            ranges = ranges.unionByName(last.select("doc", "p1", "p2", F.col("start").cast("long"), (F.col("start") + WIDTH).cast("long").alias("end")))
    copies = written(copies, folder, "copies")
    del shared, first, several
    discard(spark, folder, "shared", "first", "hot")
    release(spark)
    per = ranges.unionByName(copies).groupBy("doc", "p1", "p2").agg(F.collect_set(F.struct("start", "end")).alias("ranges")).hint("shuffle_hash")
    given = docs.select(F.struct("*").alias("row"), doc.alias("doc"), p1.alias("p1"), p2.alias("p2")).join(per, ["doc", "p1", "p2"], "left").select("row", "ranges")
    out = given.select("row").schema["row"].dataType.simpleString()
    return given.mapInArrow(cut, f"row {out}, removed array<struct<start:bigint,end:bigint>>, kept binary")


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, kept = batch.column("removed").to_pylist(), batch.column("kept").to_pylist()
        gone = [sum(r["end"] - r["start"] for r in x) for x in removed]
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("row").field("doc_id"), "n_bytes": pa.array([len(k) + g for k, g in zip(kept, gone, strict=True)], pa.int64()),
                "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array([len(r) for r in removed], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            }
        )


def query(spark, sf_dir) -> DataFrame:
    """Query op5: what is cut out of every document."""
    out = dedup_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.mapInArrow(digested, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
