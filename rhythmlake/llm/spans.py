"""Long exact spans shared between records: a count-min prefilter of anchored windows, then exact grouping of those it can't rule out."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhythmlake.session import written

#: Rows of the sketch, counters in a row for each anchor (at least), and the most bytes of a merged sketch that are sent to the tasks (one bit
#: a counter). A corpus whose sketch would be larger is counted by a shuffle of its cells instead, with the same result.
ROWS, COUNTERS, SENT = 2, 8, 64 << 20
#: Counters in a block of a sketch while sketches are merged.
_BLOCK = 1 << 18
#: Characters hashed at once; places within a portion fit into _PLACE bits.
_CHARS, _PLACE = 1 << 18, 20
#: Stretches with one anchor above which their windows are grouped one by one instead of by anchor.
HOT = 20_000

_U = np.uint64
_MASK = _U((1 << _PLACE) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (shifts and odd multipliers)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


class _Sums:
    """Hashes of all spans of a text by sums of powers modulo 2**64; the powers are kept from call to call."""

    def __init__(self, base: int):
        self.bases = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.zeros(0, _U)

    def of(self, values: np.ndarray, span: int) -> np.ndarray:
        """The hash of `span` values from each place on."""
        n = len(values)
        if len(self.up) < n:
            self.up, self.down = (_powers(b, n) for b in self.bases)
        sums = np.zeros(n + 1, _U)
        np.cumsum(values * self.up[:n], dtype=_U, out=sums[1:])
        return (sums[span:] - sums[: n - span + 1]) * self.down[: n - span + 1]


class _Windows:
    """Two independent 64-bit hashes of every window of `length` code points."""

    def __init__(self, length: int):
        self.length, self.sums = length, [_Sums(0x9E3779B97F4A7C15), _Sums(0xD6E8FEB86659FD93)]

    def of(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows that begin at each place; the second is over neighbours, so the two fail differently."""
        first = self.sums[0].of(_mix(chars + _U(0x51ED270B)), self.length)
        after = np.append(chars[1:], _U(0)) if self.length > 1 else _U(0)
        second = self.sums[1].of(_mix((chars << _U(32)) ^ after ^ _U(0x2545F4914F6CDD1D)), max(1, self.length - 1))[: len(first)]
        return _mix(first), _mix(second ^ _U(0xA0761D6478BD642F))


class _Anchors:
    """The anchor of each window: of the substrings of half its length the one with the least hash, the leftmost of equal ones.

    Equal windows have equal anchors at the same place within, so windows are only compared with those of the same anchor. Windows that
    follow each other share their anchor for about a quarter of their length: they make up one stretch.
    """

    def __init__(self, length: int):
        self.length, self.part = length, max(1, length // 2)
        self.sums = _Sums(0x9E3779B97F4A7C15)

    def of(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place where a window begins the place of its anchor; and the hash of the substring at each place."""
        v = chars * _U(0xD6E8FEB86659FD93)
        v ^= v >> _U(32)
        v *= _U(0x9FB21C651E98DF25)
        h = self.sums.of(v, self.part)
        h ^= h >> _U(32)
        h *= _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(29)
        least, have, want = (h & ~_MASK) | np.arange(len(h), dtype=_U), 1, self.length - self.part + 1
        while have < want:  # least of 1, 2, 4, ... and at last `want` neighbours
            step = min(have, want - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        return (least & _MASK).astype(np.int64), h

    def stretches(self, portion: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """The stretches of a portion: anchor (its hash), piece, first window (place in the portion), number of windows."""
        chars, sizes = portion[0], portion[1]
        at, h = self.of(chars)
        first = np.cumsum(sizes) - sizes
        end = first + sizes - self.length + 1  # behind the last window of each piece
        begin = np.union1d(np.flatnonzero(at[1:] != at[:-1]) + 1, first)
        piece = np.searchsorted(first, begin, side="right") - 1
        inside = begin < end[piece]
        upto = np.append(begin[1:], len(chars))
        n = np.minimum(upto, end[piece]) - begin
        begin, piece, n = begin[inside], piece[inside], n[inside]
        return _mix(h[at[begin]] + _U(0x1F83D9ABFB41BD6B)), piece, begin, n


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple]:
    """Texts (doc, text, and what else there is) in portions of about _CHARS characters: chars, and of each piece its size, doc, place, and the rest.

    A text longer than a portion is cut with an overlap of length - 1 characters, so every window is whole in one piece.
    """
    held, parts, own = 0, [], []

    def portion():
        return np.concatenate(parts).astype(_U), np.array([len(p) for p in parts]), np.array([o[0] for o in own]), np.array([o[1] for o in own]), [o[2] for o in own]

    for batch in batches:
        for doc, text, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            for base in range(0, max(1, len(codes) - length + 1), _CHARS):
                parts.append(codes[base : base + _CHARS + length - 1])
                own.append((doc, base, rest))
                held += len(parts[-1])
                if held >= _CHARS:
                    yield portion()
                    held, parts, own = 0, [], []
    if parts:
        yield portion()


def _cells(anchor: np.ndarray, width: int) -> list[np.ndarray]:
    """The counter of each anchor in each row of the sketch."""
    return [(h >> _U(7) & _U(width - 1)).astype(np.int64) for h in (anchor, _mix(anchor ^ _U(0x510E527FADE682D1)))]


def _bit(plane: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (plane[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1


def _set(plane: np.ndarray, cells: np.ndarray) -> None:
    """Set the bits of sorted, different cells."""
    if len(cells):
        at = cells >> 3
        begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        plane[at[begin]] |= np.bitwise_or.reduceat(np.left_shift(np.uint8(1), (cells & 7).astype(np.uint8)), begin)


def _sketch(length: int, width: int):
    """The count-min sketch of one partition in blocks; a counter is two bits in two planes: once, and more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, anchors = None, _Anchors(length)
        for portion in _pieces(batches, length):
            if planes is None:
                planes = [[np.zeros(width // 8, np.uint8) for _ in range(2)] for _ in range(ROWS)]
            for (once, more), cells in zip(planes, _cells(anchors.stretches(portion)[0], width), strict=True):
                cells.sort()
                begin = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
                again = np.diff(np.append(begin, len(cells))) > 1
                own = cells[begin]
                _set(more, own[again | _bit(once, own)])
                _set(once, own)
        for r, (once, more) in enumerate(planes or []):
            for b in range(0, width, _BLOCK):
                part = slice(b // 8, (b + _BLOCK) // 8)
                if once[part].any():
                    cols = [pa.array([r], pa.int32()), pa.array([b], pa.int64()), *(pa.array([zlib.compress(x[part].tobytes(), 1)], pa.binary()) for x in (once, more))]
                    yield pa.RecordBatch.from_arrays(cols, ["row", "block", "once", "more"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the sketches of all partitions up, block by block; of the sum only `more than once` is needed."""
    key, once, more = None, None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([zlib.compress(more.tobytes(), 1)], pa.binary())], ["row", "block", "more"])

    for batch in batches:
        for r, b, o, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            o, m = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, m))
            if key != (r, b):
                if key is not None and more.any():
                    yield out()
                key, once, more = (r, b), o.copy(), m.copy()
            else:
                more |= m | (once & o)
                once |= o
    if key is not None and more.any():
        yield out()


def _doc_cells(length: int):
    """The counters each document adds to, as rows (cell, doc), for a corpus whose sketch is too large to be sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = _Anchors(length)
        for portion in _pieces(batches, length):
            anchor, piece, *_ = anchors.stretches(portion)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(portion[2][piece])], ["cell", "doc"])

    return run


#: Stretches whose anchor may be repeated, each once a portion. kind 0: anchor, hash (h1, h2), least and greatest doc of the portion that has
#: it, windows, text, and where it begins in its document (begin, and how often in a row), none if that is settled. kind 1: characters that
#: are settled, lo the document, begin and times where they start and end.
_STRETCH = pa.schema([
    ("kind", pa.int32()), ("anchor", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("windows", pa.int32()), ("text", pa.binary()),
    ("begin", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())),
])
_STRETCH_SQL = "kind int, anchor bigint, h1 bigint, h2 bigint, lo bigint, hi bigint, windows int, text binary, begin array<bigint>, times array<bigint>"


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where the groups of equal keys begin in sorted rows."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), first[1], ..."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def _utf8(chars: np.ndarray, begin: np.ndarray, n: np.ndarray) -> list[bytes]:
    """UTF-8 of the texts of n characters from `begin` on."""
    return [chars[b : b + k].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass") for b, k in zip(begin.tolist(), n.tolist(), strict=True)]


def _lists(values: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(values, pa.int64()))


def _covered(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Longest runs of (doc, start, end) that overlap or touch."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    wall = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1]))) * (np.int64(1) << 40)
    reach = np.maximum.accumulate(end + wall)
    new = np.ones(len(doc), bool)
    new[1:] = (start + wall)[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    return doc[begin], start[begin], np.maximum.reduceat(end, begin) if len(begin) else end


def _candidates(length: int, passes: Callable[[], Callable[[np.ndarray, list], np.ndarray]]):
    """The stretches whose anchor the sketch can't rule out (`_STRETCH`), equal ones of a portion as one.

    What several documents of the portion have is settled there and goes on as runs of characters; a stretch that has been met so
    sends one key a portion, however many documents have it. texts: doc, text, copied, and what `passes` needs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, may = _Anchors(length), passes()
        for portion in _pieces(batches, length):
            anchor, piece, first, n = anchors.stretches(portion)
            chars, sizes, docs, bases, rest = portion
            i = np.flatnonzero(may(anchor, rest))
            if not len(i):
                continue
            anchor, piece, first, n = anchor[i].view(np.int64), piece[i], first[i], n[i]
            doc, place = docs[piece], bases[piece] + first - (np.cumsum(sizes) - sizes)[piece]
            copied = np.array([r[0] for r in rest])[piece]
            text = _utf8(chars.astype(np.uint32), first, n + length - 1)
            h1, h2 = np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=16).digest() for t in text), np.int64).reshape(-1, 2).T
            order = np.lexsort((place, doc, h2, h1))
            h1, h2, doc, place, anchor, n, copied = (x[order] for x in (h1, h2, doc, place, anchor, n, copied))
            begin = _starts(h1, h2)
            size = np.diff(np.append(begin, len(order)))
            lo, hi = np.minimum.reduceat(doc, begin), np.maximum.reduceat(doc, begin)
            several = lo != hi
            done = np.repeat(several, size) & ~copied
            # stretches in a row, as in a text that repeats itself, count as one place
            open_ = ~np.repeat(several, size) & ~copied
            group = np.repeat(np.arange(len(begin)), size)[open_]
            at, step = place[open_], n[open_]
            head = np.ones(len(at), bool)
            head[1:] = (group[1:] != group[:-1]) | (at[1:] != at[:-1] + step[:-1])
            head = np.flatnonzero(head)
            times = np.diff(np.append(head, len(at)))
            own = np.bincount(group[head], minlength=len(begin))
            cols = [np.zeros(len(begin), np.int32), anchor[begin], h1[begin], h2[begin], lo, hi, n[begin].astype(np.int32), pa.array([text[k] for k in order[begin]], pa.binary()), _lists(at[head], own), _lists(times, own)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], schema=_STRETCH)
            if done.any():
                yield _settled(*_covered(doc[done], place[done], place[done] + n[done] - 1 + length))

    return run


def _settled(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    one, none = np.ones(len(doc), np.int64), pa.nulls(len(doc), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(one.astype(np.int32)), none, none, none, pa.array(doc), none, pa.nulls(len(doc), pa.int32()), pa.nulls(len(doc), pa.binary()), _lists(start, one), _lists(end, one)], schema=_STRETCH)


def _chars(texts: pa.Array) -> np.ndarray:
    """The code points of all texts in a row."""
    return np.frombuffer(b"".join(texts.to_pylist()).decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)


def _flat(rows: pa.Table, names: tuple[str, ...]) -> list[np.ndarray]:
    return [rows.column(c).to_numpy() for c in names]


def _places(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and times of each place of the stretches."""
    lists = rows.column("begin").combine_chunks(), rows.column("times").combine_chunks()
    n = np.diff(lists[0].offsets.to_numpy())
    return np.repeat(np.arange(rows.num_rows), n), *(x.flatten().to_numpy() for x in lists)


def _group(rows: pa.Table, length: int, windows: _Windows) -> pa.RecordBatch | None:
    """Whole groups of stretches with one anchor to the runs of characters that several documents have."""
    anchor, h1, h2, lo, hi, n = _flat(rows, ("anchor", "h1", "h2", "lo", "hi", "windows"))
    row, at, times = _places(rows)
    begin = _starts(anchor, h1, h2)
    of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(anchor))))  # row to stretch
    lo, hi, n, key = np.minimum.reduceat(lo, begin), np.maximum.reduceat(hi, begin), n[begin].astype(np.int64), anchor[begin]
    whole = lo != hi
    place = of[row]
    keep = whole[place]
    doc = np.where(keep, rows.column("lo").to_numpy()[row], 0)
    found = [(doc[keep], at[keep], (at + times * n[place] - 1 + length)[keep])]
    # stretches in one document only: their windows are compared with those of the other stretches of the anchor
    per = _starts(key)
    members = np.diff(np.append(per, len(key)))
    wanted = np.zeros(len(key), bool)
    wanted[place[~keep]] = True
    mixed = (np.minimum.reduceat(lo, per) != np.maximum.reduceat(hi, per)) & np.logical_or.reduceat(wanted, per) & (members > 1)
    pick = np.flatnonzero(np.repeat(mixed, members))
    if len(pick):
        own = n[pick]
        w1, w2 = windows.of(_chars(rows.column("text").combine_chunks().take(pa.array(begin[pick]))))
        inner = _ranges(np.cumsum(own + length - 1) - (own + length - 1), own)
        w1, w2 = w1[inner], w2[inner]
        stretch, offset = np.repeat(pick, own), _ranges(np.zeros(len(own), np.int64), own)
        order = np.lexsort((w2, w1))
        head = _starts(w1[order], w2[order])
        several = np.minimum.reduceat(lo[stretch[order]], head) != np.maximum.reduceat(hi[stretch[order]], head)
        shared = np.zeros(len(order), bool)
        shared[order] = np.repeat(several, np.diff(np.append(head, len(order))))
        shared &= wanted[stretch] & ~whole[stretch]
        stretch, offset = stretch[shared], offset[shared]
        if len(stretch):
            new = np.ones(len(stretch), bool)
            new[1:] = (stretch[1:] != stretch[:-1]) | (offset[1:] != offset[:-1] + 1)
            new = np.flatnonzero(new)
            run, a, z = stretch[new], offset[new], offset[np.append(new[1:], len(stretch)) - 1]
            # every place of a stretch gets each of its runs
            first = np.searchsorted(run, np.arange(len(key) + 1))
            left = np.flatnonzero(~keep)
            left = np.repeat(left, times[left])
            again = _ranges(np.zeros(len(at[~keep]), np.int64), times[~keep])
            many = first[place[left] + 1] - first[place[left]]
            each, base = _ranges(first[place[left]], many), np.repeat(at[left] + again * n[place[left]], many)
            found.append((np.repeat(lo[place[left]], many), base + a[each], base + z[each] + length))
    doc, start, end = (np.concatenate(c) for c in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in _covered(doc, start, end)], ["doc", "start", "end"]) if len(doc) else None


def _by_anchor(length: int, at_once: int = HOT):
    """Stretches sorted by (anchor, h1, h2) to runs of shared characters (doc, start, end); holds whole anchors, about `at_once` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, held, n = _Windows(length), [], 0

        def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            found = _group(rows, length, windows) if rows.num_rows else None
            if found is not None:
                yield found

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= at_once:
                rows = pa.Table.from_batches(held)
                anchor = rows.column("anchor").to_numpy()
                last = np.searchsorted(np.cumsum(np.concatenate(([0], anchor[1:] != anchor[:-1]))), (anchor[1:] != anchor[:-1]).sum())
                yield from out(rows.slice(0, last))
                held, n = rows.slice(last).to_batches(), len(anchor) - last
        if held:
            yield from out(pa.Table.from_batches(held))

    return run


def _each_window(length: int):
    """Stretches to their windows, one row each place: w1, w2, lo, hi, doc, at (null where only the group needs it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, names = _Windows(length), ["w1", "w2", "lo", "hi", "at"]
        for batch in batches:
            for cut in range(0, batch.num_rows, 2_000):
                rows = pa.Table.from_batches([batch.slice(cut, 2_000)])
                lo, hi, n = (x.astype(np.int64) for x in _flat(rows, ("lo", "hi", "windows")))
                w1, w2 = windows.of(_chars(rows.column("text").combine_chunks()))
                first = np.cumsum(n + length - 1) - (n + length - 1)
                row, at, times = _places(rows)
                bare = np.setdiff1d(np.arange(rows.num_rows), row)
                again = _ranges(np.zeros(len(at), np.int64), times)
                at, row = np.repeat(at, times) + again * np.repeat(n[row], times), np.repeat(row, times)
                row, at = np.concatenate((row, bare)), np.concatenate((at, np.full(len(bare), -1)))
                of, offset = np.repeat(row, n[row]), _ranges(np.zeros(len(row), np.int64), n[row])
                where = np.repeat(at, n[row])
                where = np.where(where < 0, -1, where + offset)
                cols = [w1[first[of] + offset].view(np.int64), w2[first[of] + offset].view(np.int64), lo[of], hi[of], where]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    return run


def _join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by (doc, start) to longest runs of characters; holds one open run."""
    names, open_ = ["doc_id", "span_start", "span_end"], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy() for c in batch.columns]
        if open_:
            cols = [np.concatenate(([o], c)) for o, c in zip(open_, cols, strict=True)]
        doc, start, end = _covered(*cols)
        yield pa.RecordBatch.from_arrays([pa.array(c[:-1]) for c in (doc, start, end)], names)
        open_ = (int(doc[-1]), int(start[-1]), int(end[-1]))
    if open_:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in open_], names)


def _sketched(texts: DataFrame, length: int, width: int) -> Callable:
    """The test of anchors against the merged sketch, which is sent to the tasks (ROWS * width / 8 bytes, SENT at most)."""
    blocks = texts.mapInArrow(_sketch(length, width), "row int, block bigint, once binary, more binary")
    merged = blocks.repartition("row", "block").sortWithinPartitions("row", "block").mapInArrow(_merge, "row int, block bigint, more binary")
    sketch = [bytearray(width // 8) for _ in range(ROWS)]
    for b in merged.toLocalIterator():
        part = zlib.decompress(b.more)
        sketch[b.row][b.block // 8 : b.block // 8 + len(part)] = part
    sent = texts.sparkSession.sparkContext.broadcast([bytes(x) for x in sketch])

    def passes():
        planes = [np.frombuffer(x, np.uint8) for x in sent.value]

        def may(anchor: np.ndarray, rest: list) -> np.ndarray:
            hit = np.ones(len(anchor), bool)
            for plane, cells in zip(planes, _cells(anchor, width), strict=True):
                hit &= _bit(plane, cells)
            return hit

        return may

    return passes


def _counted(texts: DataFrame, length: int) -> tuple[DataFrame, Callable]:
    """The same for a sketch too large to be sent: counters as rows, added up by key; those above one come back to the documents that add to them.

    The texts get the column `hits`. A cell that a third of all documents add to is one row a task after the partial sums; its way
    back is a join that adaptive execution splits.
    """
    cells = written(texts.select("doc", "text").mapInArrow(_doc_cells(length), "cell bigint, doc bigint"), "span-cells")
    repeated = cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1").select("cell")
    hits = cells.join(repeated, "cell").groupBy("doc").agg(F.collect_set("cell").alias("hits"))

    def passes():
        def may(anchor: np.ndarray, rest: list) -> np.ndarray:
            own = [r[1] for r in rest if r[1]]
            return np.isin(anchor.view(np.int64), np.concatenate(own)) if own else np.zeros(len(anchor), bool)

        return may

    return texts.join(hits, "doc"), passes


def shared_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 100, sent: int = SENT, hot: int = HOT) -> DataFrame:
    """Longest runs of shared characters of each document: doc_id, span_start, span_end (counted from 0, end excluded).

    A character is shared if it lies in a stretch of `length` consecutive characters (code points) that occurs in the text of a document with
    another doc_id as well. Texts that are null, empty or shorter have no spans; rows equal in doc_id and text count once; rows with a
    null doc_id are left out; an empty table gives no rows; other columns are ignored.

    Documents with equal texts (by SHA-256) are one class: a class of several is shared from end to end, and only one member goes
    on, so a third of all rows may be copies of one text. Each window of the rest has an anchor (`_Anchors`). Pass one: each partition's count-min
    sketch of its anchors, merged; it overestimates, so an anchor, and with it a window, that occurs twice is never ruled out. Its width
    follows the number of anchors; one larger than `sent` bytes is not sent but counted by shuffle (`_counted`). Pass two: stretches of windows
    that it can't rule out are grouped exactly: first whole stretches (BLAKE2b, 128 bits), then, among the stretches of one anchor, the windows of
    those that only one document has (two 64-bit hashes). Texts behind equal hashes are not compared again. Equal stretches of a portion
    of documents are one row; an anchor with more than `hot` rows is grouped by window, with partial aggregation and a join that
    adaptive execution splits, so no anchor, stretch or window has to fit into one task.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text")).filter("doc IS NOT NULL").filter(F.length("text") >= length)
    sha = F.unhex(F.sha2("text", 256)).alias("sha")
    classes = rows.select("doc", sha).groupBy("sha").agg(F.min("doc").alias("least"), F.max("doc").alias("greatest")).filter("least <> greatest")
    # a written table has a known size: the join sends it to all tasks only if that is small
    tagged = rows.select("doc", "text", sha).join(written(classes.select("sha", "least"), "span-copies"), "sha", "left").drop("sha")
    texts = tagged.filter("least IS NULL OR least = doc").select("doc", "text", F.col("least").isNotNull().alias("copied"))
    chars = texts.agg(F.sum(F.length("text"))).head()[0] or 0
    width = 1 << max(18, (COUNTERS * 4 * int(chars) // length).bit_length())
    if ROWS * width // 8 <= sent:
        passes = _sketched(texts, length, width)
    else:
        texts, passes = _counted(texts, length)
    parts = written(texts.mapInArrow(_candidates(length, passes), _STRETCH_SQL), "span-stretches")
    spans = parts.filter("kind = 1").select(F.col("lo").alias("doc"), F.col("begin")[0].alias("start"), F.col("times")[0].alias("end"))
    stretches = parts.filter("kind = 0").drop("kind")
    frequent = written(stretches.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("anchor"), "span-hot")
    if not frequent.isEmpty():
        each = stretches.join(frequent, "anchor", "left_semi").mapInArrow(_each_window(length), "w1 bigint, w2 bigint, lo bigint, hi bigint, at bigint")
        several = each.groupBy("w1", "w2").agg(F.min("lo").alias("a"), F.max("hi").alias("z")).filter("a <> z").select("w1", "w2")
        spans = spans.unionByName(each.filter("at >= 0").join(several, ["w1", "w2"]).select(F.col("lo").alias("doc"), F.col("at").alias("start"), (F.col("at") + length).alias("end")))
        stretches = stretches.join(frequent, "anchor", "left_anti")
    grouped = stretches.repartition("anchor").sortWithinPartitions("anchor", "h1", "h2").mapInArrow(_by_anchor(length, hot), "doc bigint, start bigint, end bigint")
    spans = spans.unionByName(grouped)
    spans = spans.repartition("doc").sortWithinPartitions("doc", "start").mapInArrow(_join_runs, "doc_id bigint, span_start bigint, span_end bigint")
    whole = tagged.filter("least IS NOT NULL").select(F.col("doc").alias("doc_id"), F.lit(0).cast("bigint").alias("span_start"), F.length("text").cast("bigint").alias("span_end")).distinct()
    return spans.unionByName(whole)


def shared_share(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, n_spans, shared_chars, share of each document; 0 for texts that are null, empty or unshared."""
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("n_chars"))
    sums = spans.groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    out = own.join(sums, "doc_id", "left").select("doc_id", "n_chars", zero(F.col("n_spans")).alias("n_spans"), zero(F.col("shared_chars")).alias("shared_chars"))
    return out.withColumn("share", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(0.0))
