"""Repeated windows of text by a depth-limited most-significant-digit sort of suffixes.

Every byte position starts a suffix; only its first ``depth`` bytes (the window) matter.

* Dealing.  A suffix goes to the group of its window's least 10-byte gram (by hash).  Equal windows
  have equal least grams, and neighbouring suffixes mostly share theirs, so they travel together as
  one run of text (about 20 windows in 70 bytes) instead of one row each.  Grams that are frequent
  in a sample of the documents are replaced by the window's least 32-byte gram; that sample decides
  only where windows meet, never what is equal.
* Within a group whole runs that are equal are settled first: one run stands for all, each task does
  this for its own documents before the shuffle, so a passage with very many copies reaches its
  group once per task.
* The remaining suffixes are sorted digit by digit, most significant first (26, 12 and 12 bytes of
  the window).  After each pass only suffixes in groups of several documents go on, and no suffix is
  read beyond ``depth``.  The groups left at the end are exactly the repeated windows.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .shared import fits, frugal, slices, spread, table

DEPTH = 50
GRAM, LONG_GRAM = 10, 32
DIGITS = (26, 12, 12)
UNIT = 2 << 20
GROUP_BYTES = 8 << 20
MAX_RUN = 512
SAMPLE_EVERY = 64
HOT_SHARE = 1e-5
_SORT_BYTES = 1 << 19
_NO_ID = (1 << 63) - 1
_U = np.uint64


#: positions whose hashes are mixed and compared at once, so that they stay in a core's cache
_STRETCH = 1 << 14


def _scramble(x: np.ndarray) -> np.ndarray:
    """Mix the bits of ``x`` in place, which has to be an array of the caller's own."""
    shifted = np.empty(min(len(x), _STRETCH), _U)
    for start in range(0, len(x), _STRETCH):
        part = x[start:start + _STRETCH]
        high = shifted[: len(part)]
        for _ in range(2):
            part ^= np.right_shift(part, _U(32), out=high)
            part *= _U(0xD6E8FEB86659FD93)
        part ^= np.right_shift(part, _U(32), out=high)
    return x


def _order(x: np.ndarray) -> np.ndarray:
    """Stable order of hashes in which equal ones are neighbours."""
    low = _U((1 << len(x).bit_length()) - 1)
    packed = x & ~low
    packed |= np.arange(len(x), dtype=_U)
    packed.sort()
    order = (packed & low).astype(np.int64)
    # only the high bits were sorted; where they agree and the rest does not, equal hashes may lie apart
    packed &= ~low
    found = x[order]
    if ((packed[1:] == packed[:-1]) & (found[1:] != found[:-1])).any():
        return np.argsort(x, kind="stable")
    return order


_BASE = 0x9E3779B97F4A7C15
_LETTERS = _scramble(np.arange(1, 257, dtype=_U) * _U(_BASE))
_powers = np.ones(1, _U), np.ones(1, _U)


def _power_tables(size: int):
    global _powers
    if len(_powers[0]) < size:
        size += size >> 3
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, _U(base))
            steps[0] = 1
            tables.append(np.cumprod(steps))
        _powers = tuple(tables)
    return _powers


def _lean(work):
    """``frugal`` work that leaves no tables in an idle worker."""
    def run(batches):
        global _powers
        yield from work(batches)
        _powers = np.ones(1, _U), np.ones(1, _U)

    return frugal(run)


class Spans:
    """Hashes of any spans of one buffer from a running polynomial sum."""

    def __init__(self, data: bytes):
        up, self.down = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, _U)
        letters = _LETTERS[np.frombuffer(data, np.uint8)]
        letters *= up[: len(data)]
        np.cumsum(letters, out=self.sums[1:])

    def every(self, size: int) -> np.ndarray:
        """Hash of the span of ``size`` bytes at each position."""
        many = len(self.sums) - size
        out = self.sums[size:] - self.sums[:many]
        out *= self.down[:many]
        return _scramble(out)

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = self.sums[end]
        out -= self.sums[start]
        out *= self.down[start]
        return _scramble(out)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    out = np.empty(max(len(values) - width + 1, 0), values.dtype)
    for start in range(0, len(out), _STRETCH):
        part, size = values[start:start + _STRETCH + width - 1], 1
        while size * 2 <= width:
            part = np.minimum(part[:-size], part[size:])
            size *= 2
        out[start:start + _STRETCH] = np.minimum(part[: len(part) - (width - size)], part[width - size:]) if width > size else part
    return out


def _keys(spans: Spans, depth: int, hot: np.ndarray):
    """The group key of the window at each position, whether it is that of a long gram, and all short grams."""
    gram = min(GRAM, depth)
    grams = spans.every(gram)
    keys = _least(grams, depth - gram + 1)
    long = np.zeros(len(keys), bool)
    if len(hot) and len(keys):
        # neighbours mostly share their key, so only changes are looked up
        change = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        found = hot[np.minimum(np.searchsorted(hot, keys[change]), len(hot) - 1)] == keys[change]
        long = np.repeat(found, np.diff(change, append=len(keys)))
        if found.any():
            gram = min(LONG_GRAM, depth)
            width = depth - gram + 1
            # the long grams inside these windows only; those of one window are neighbours among them
            inside = np.zeros(len(keys) + width - 1, bool)
            inside[: len(keys)] = long
            size = 1
            while size < width:
                step = min(size, width - size)
                inside[step:] |= inside[:-step].copy()
                size += step
            start = np.flatnonzero(inside)
            at = np.flatnonzero(long)
            keys[at] = _least(spans.at(start, start + gram), width)[np.searchsorted(start, at)]
    return keys, long, grams


def _gram_places(
    spans: Spans, grams: np.ndarray, begin: np.ndarray, keys: np.ndarray, long: np.ndarray, depth: int,
) -> np.ndarray:
    """Where in its first window each run has the gram of its key; long grams are marked by the top bit."""
    out = np.zeros(len(begin), np.uint16)
    for flag, gram in ((False, min(GRAM, depth)), (True, min(LONG_GRAM, depth))):
        own, last = np.flatnonzero(long == flag), depth - gram
        for start in range(0, len(own), 4096):
            part = own[start:start + 4096]
            # many runs begin where their gram comes in at the end of the window
            ends = begin[part] + last
            at_end = (spans.at(ends, ends + gram) if flag else grams[ends]) == keys[part]
            out[part] = last | (0x8000 if flag else 0)
            part = part[~at_end]
            at = begin[part][:, None] + np.arange(last + 1)
            same = (spans.at(at.ravel(), at.ravel() + gram).reshape(at.shape) if flag else grams[at]) == keys[part][:, None]
            out[part] = same.argmax(axis=1) | (0x8000 if flag else 0)
    return out


def _keys_at(spans: Spans, start: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Keys of runs from the places of their grams."""
    at = start + (places & 0x7FFF)
    return spans.at(at, at + np.where(places & 0x8000, min(LONG_GRAM, depth), min(GRAM, depth)))


class Unit:
    """Texts laid end to end, ordered by id; a very long text comes in overlapping pieces."""

    def __init__(self, pieces: list, depth: int):
        pieces.sort(key=lambda p: (p[0], p[1], p[2]))
        self.data = b"".join(p[3] for p in pieces)
        self.ids = np.array([p[0] for p in pieces], np.int64)
        self.slots = np.array([p[1] for p in pieces], np.int64)
        self.bases = np.array([p[2] for p in pieces], np.int64)
        sizes = np.array([len(p[3]) for p in pieces], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.windows = np.maximum(sizes - depth + 1, 0)

    def runs(self, depth: int, hot: np.ndarray):
        """(start, windows, piece, key, place of its gram, hash) of each run of windows with one key.

        A run also ends where a stretch of _SORT_BYTES does, so that sums and hashes of one stretch are held at a time.
        """
        full = self.windows > 0
        edges = np.sort(np.concatenate([self.starts[full], self.starts[full] + self.windows[full]]))
        found = []
        for base in range(0, len(self.data) - depth + 1, _SORT_BYTES):
            spans = Spans(self.data[base:base + _SORT_BYTES + depth - 1])
            keys, long, grams = _keys(spans, depth, hot)
            cut = np.ones(len(keys), bool)
            cut[1:] = keys[1:] != keys[:-1]
            own = edges[np.searchsorted(edges, base):np.searchsorted(edges, base + len(keys))] - base
            cut[own] = True
            begin = np.flatnonzero(cut)
            size = np.diff(begin, append=len(keys))
            # no window fits between the end of a piece's windows and the next piece
            at = np.searchsorted(self.starts, begin + base, side="right") - 1
            inside = begin + base < self.starts[at] + self.windows[at]
            begin, size = begin[inside], size[inside]
            if len(size) and size.max() > MAX_RUN:
                parts = -(-size // MAX_RUN)
                first = np.repeat(np.cumsum(parts) - parts, parts)
                step = np.arange(parts.sum()) - first
                begin = np.repeat(begin, parts) + step * MAX_RUN
                size = np.minimum(np.repeat(size, parts) - step * MAX_RUN, MAX_RUN)
            places = _gram_places(spans, grams, begin, keys[begin], long[begin], depth)
            found.append((begin + base, size, keys[begin], places, spans.at(begin, begin + size + depth - 1)))
        if not found:
            found = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, _U), np.zeros(0, np.uint16), np.zeros(0, _U))]
        begin, size, keys, places, hashes = (np.concatenate(x) for x in zip(*found))
        # pieces without bytes share their start with the next one; the last of them holds the window
        piece = np.searchsorted(self.starts, begin, side="right") - 1
        return begin, size, piece, keys, places, hashes


def _pieces(batches, depth: int):
    """Lists of (id, slot, base, bytes) of about UNIT bytes each."""
    held, size = [], 0
    for batch, found in slices(batches):
        ids = batch.column("_id").to_numpy()
        slots = batch.column("_slot").to_numpy()
        for id_, slot, text in zip(ids, slots, found):
            for base in range(0, max(len(text) - depth + 1, 0), UNIT):
                piece = text[base:base + UNIT + depth - 1]
                held.append((int(id_), int(slot), base, piece))
                size += len(piece)
                if size >= UNIT:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of neighbours: small numbers where the order is nearly ascending."""
    return np.diff(x, prepend=x.dtype.type(0))


def _pack(*arrays) -> bytes:
    head = np.array([x.nbytes for x in arrays], np.int64)
    return zstandard.ZstdCompressor(level=6).compress(
        np.int64(len(arrays)).tobytes() + head.tobytes() + b"".join(x.tobytes() for x in arrays)
    )


def _unpack(blob: bytes, *kinds) -> list:
    data = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(data, np.int64, len(kinds), 8)
    at, out = 8 + 8 * len(kinds), []
    for kind, size in zip(kinds, sizes):
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


_RUN_ARRAYS = (np.uint16, np.uint16, np.int64, np.uint32, np.int64, np.int64, np.uint8)
_RANGE_ARRAYS = (np.int64, np.int64, np.int64, np.int64)


def _merge(ids, slots, starts, ends):
    """Unite overlapping or touching ranges of the same row."""
    order = np.lexsort((starts, slots, ids))
    ids, slots, starts, ends = ids[order], slots[order], starts[order], ends[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (slots[1:] != slots[:-1])
    # comparing neighbours unites nearly all that touches; _cut unites the rest
    fresh[1:] |= starts[1:] > ends[:-1]
    first = np.flatnonzero(fresh)
    return ids[first], slots[first], starts[first], np.maximum.reduceat(ends, first) if len(first) else ends


def _deal(groups: int, depth: int, hot: np.ndarray):
    """Runs of each unit, equal ones settled, packed for their groups; settled ranges travel as they are."""

    def deal(batches):
        for number, pieces in enumerate(_pieces(batches, depth)):
            unit = Unit(pieces, depth)
            begin, size, piece, keys, places, hashes = unit.runs(depth, hot)
            if not len(begin):
                continue
            ids = unit.ids[piece]
            same = hashes ^ (keys + size.astype(_U))
            order = _order(same)  # ids ascend within equal runs
            first = np.ones(len(order), bool)
            first[1:] = same[order][1:] != same[order][:-1]
            head = np.flatnonzero(first)
            string = np.cumsum(first) - 1
            least = ids[order][head][string]
            gone = order[ids[order] > least]
            stay = ids[order] == least
            if len(gone):
                at = unit.bases[piece[gone]] + begin[gone] - unit.starts[piece[gone]]
                ranges = _merge(ids[gone], unit.slots[piece[gone]], at, at + size[gone] + depth - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number % groups], pa.int32()), pa.array([True]), pa.array([_pack(*ranges)], pa.binary())],
                    ["grp", "settled", "blob"],
                )
            rows = order[stay]
            string = string[stay]
            heads = order[head]
            many = np.bincount(string, minlength=len(heads))
            group = (keys[heads] >> _U(32)) % _U(groups)
            by_group = np.lexsort((begin[heads], group))  # the order of the text packs best
            offsets = np.concatenate([[0], np.cumsum(many)])
            edges = np.searchsorted(group[by_group], np.arange(groups + 1, dtype=_U))
            out_group, out_blob = [], []
            data = unit.data
            for g in np.flatnonzero(edges[1:] > edges[:-1]):
                own = by_group[edges[g]:edges[g + 1]]
                uses = many[own]
                pick = np.repeat(offsets[own] - (np.cumsum(uses) - uses), uses) + np.arange(uses.sum())
                use = rows[pick]
                at = unit.bases[piece[use]] + begin[use] - unit.starts[piece[use]]
                runs = heads[own]
                blob = b"".join([data[s:s + n + depth - 1] for s, n in zip(begin[runs].tolist(), size[runs].tolist())])
                out_group.append(int(g))
                out_blob.append(_pack(
                    places[runs], size[runs].astype(np.uint16), _steps(ids[runs]),
                    uses.astype(np.uint32), _steps(unit.slots[piece[use]]), _steps(at), np.frombuffer(blob, np.uint8),
                ))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_group, pa.int32()), pa.array([False] * len(out_group)), pa.array(out_blob, pa.binary())],
                ["grp", "settled", "blob"],
            )

    return deal


def _repeated(data: bytes, size: np.ndarray, ids: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """Whether each window of the runs, laid end to end, also starts in a smaller id; passes by digits."""
    spans = Spans(data)
    run = np.repeat(np.arange(len(size)), size)
    offset = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
    lengths = size + depth - 1
    at = np.repeat(np.cumsum(lengths) - lengths, size) + offset
    owner = ids[run]
    out = np.zeros(len(run), bool)
    alive, group = np.arange(len(run)), keys[run].astype(_U)
    done = 0
    for digit in _digits(depth):
        value = spans.at(at[alive] + done, at[alive] + done + digit)
        done += digit
        mixed = _scramble(group * _U(0xFF51AFD7ED558CCD) ^ value)
        order = _order(mixed)
        mixed = mixed[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = mixed[1:] != mixed[:-1]
        first = np.flatnonzero(fresh)
        if not len(first):
            return out
        number = np.cumsum(fresh) - 1
        own = owner[alive[order]]
        least, most = np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)
        go = (least < most)[number]
        alive, group = alive[order][go], number[go].astype(_U)
        last = own[go] > least[number[go]]
    out[alive[last]] = True
    return out


def _digits(depth: int) -> list:
    out, left = [], depth
    for digit in DIGITS:
        if left:
            out.append(min(digit, left))
            left -= out[-1]
    return out + [left] * (left > 0)


def _settle_group(blobs: list, depth: int):
    """(ids, slots, starts, ends) removed from the runs of one group; the list of blobs is used up."""
    # texts are read where they were unpacked; of each blob only the numbers are laid end to end
    texts, parts = [], []
    while blobs:
        *numbers, text = _unpack(blobs.pop(0), *_RUN_ARRAYS)
        places, size, ids, uses, slots, at = numbers
        texts.append(text.tobytes())
        lengths = size.astype(np.int64) + depth - 1
        starts = np.cumsum(lengths) - lengths
        hashes, keys = np.zeros(len(size), _U), np.zeros(len(size), _U)
        step = 0
        while step < len(size):  # hash the runs in stretches, to bound the running sums
            end = int(np.searchsorted(starts, starts[step] + _SORT_BYTES, side="right"))
            own = starts[step:end] - starts[step]
            spans = Spans(texts[-1][starts[step]:starts[end - 1] + lengths[end - 1]])
            hashes[step:end] = spans.at(own, own + lengths[step:end])
            keys[step:end] = _keys_at(spans, own, places[step:end], depth)
            step = end
        of_blob = np.full(len(size), len(texts) - 1, np.int32)
        parts.append((of_blob, starts, size.copy(), np.cumsum(ids), uses.copy(), np.cumsum(slots), np.cumsum(at), hashes, keys))
    of_blob, starts, size, ids, uses, slots, at, hashes, keys = (np.concatenate(x) for x in zip(*parts))
    del parts
    size, uses = size.astype(np.int64), uses.astype(np.int64)
    lengths = size + depth - 1
    same = hashes ^ (keys + size.astype(_U))
    order = np.argsort(ids, kind="stable")  # each blob comes in this order
    order = order[_order(same[order])]
    same = same[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = same[1:] != same[:-1]
    rep = np.empty(len(order), np.int64)
    rep[order] = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    reps = np.flatnonzero(rep == np.arange(len(rep)))
    del same, order, fresh
    # a rep can hold a repeated window only if another run shares its gram
    by_key = reps[_order(keys[reps])]
    k = keys[by_key]
    paired = np.zeros(len(k), bool)
    if len(k) > 1:
        paired[1:] |= k[1:] == k[:-1]
        paired[:-1] |= k[1:] == k[:-1]
    by_key = by_key[paired]
    run_of, from_, to = [], [], []
    step = 0
    volume = np.cumsum(lengths[by_key]) if len(by_key) else np.zeros(0)
    while step < len(by_key):
        end = int(np.searchsorted(volume, volume[step] + _SORT_BYTES))
        end = max(end, step + 1)
        while end < len(by_key) and keys[by_key[end]] == keys[by_key[end - 1]]:
            end += 1
        own = by_key[step:end]
        cuts = zip(of_blob[own].tolist(), starts[own].tolist(), lengths[own].tolist())
        piece = b"".join([texts[b][s:s + n] for b, s, n in cuts])
        hit = _repeated(piece, size[own], ids[own], keys[own], depth)
        if hit.any():
            run = np.repeat(np.arange(len(own)), size[own])
            before = np.zeros(len(hit), bool)
            before[1:] = hit[:-1] & (run[1:] == run[:-1])
            after = np.zeros(len(hit), bool)
            after[:-1] = hit[1:] & (run[1:] == run[:-1])
            a, b = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after)
            first = (np.cumsum(size[own]) - size[own])[run[a]]
            run_of.append(own[run[a]])
            from_.append(a - first)
            to.append(b - first + depth)
        step = end
    whole = np.flatnonzero(ids > ids[rep])
    # copies with their stand-in's own id lose what the stand-in loses
    if run_of:
        run_of, from_, to = (np.concatenate(x) for x in (run_of, from_, to))
        order = np.argsort(run_of, kind="stable")
        run_of, from_, to = run_of[order], from_[order], to[order]
        equal = np.flatnonzero(ids == ids[rep])
        low = np.searchsorted(run_of, rep[equal], side="left")
        many = np.searchsorted(run_of, rep[equal], side="right") - low
        pick = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        run = np.concatenate([np.repeat(equal, many), whole])
        from_, to = np.concatenate([from_[pick], np.zeros(len(whole), np.int64)]), np.concatenate([to[pick], lengths[whole]])
    else:
        run, from_, to = whole, np.zeros(len(whole), np.int64), lengths[whole]
    offset = np.cumsum(uses) - uses
    many = uses[run]
    pick = np.repeat(offset[run] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    base = at[pick]
    return _merge(np.repeat(ids[run], many), slots[pick], base + np.repeat(from_, many), base + np.repeat(to, many))


def _settle(depth: int):
    def rows(ids, slots, starts, ends):
        return pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (ids, slots, starts, ends)], ["_id", "_slot", "start", "end"]
        )

    def settle(batches):
        current, blobs = None, []
        for batch in batches:
            for group, settled, blob in zip(*(batch.column(n) for n in ("grp", "settled", "blob"))):
                group, settled, blob = group.as_py(), settled.as_py(), blob.as_buffer()
                if settled:
                    yield rows(*_unpack(blob, *_RANGE_ARRAYS))
                    continue
                if group != current and blobs:
                    yield rows(*_settle_group(blobs, depth))
                    blobs = []
                current = group
                blobs.append(blob)
        if blobs:
            yield rows(*_settle_group(blobs, depth))

    return settle


def keyed(docs: DataFrame) -> DataFrame:
    """Add _id (a null id counts as the greatest) and _slot, which tells rows apart that share an id but not a text."""
    rows = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)))
    shared = rows.groupBy("_id").count().filter("count > 1").select("_id", F.lit(True).alias("_shared"))
    if not shared.take(1):
        return rows.withColumn("_slot", F.lit(0).cast("long"))
    shared = F.broadcast(shared) if fits(shared) else shared
    slot = F.when(F.col("_shared"), F.xxhash64("text")).otherwise(F.lit(0))
    return rows.join(shared, "_id", "left").withColumn("_slot", slot).drop("_shared")


def removed_ranges(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(_id, _slot, start, end): byte ranges of ``keyed`` rows covered by windows that a smaller id also holds."""
    rows = spread(rows.select("_id", "_slot", "text"), "_id")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(1, -(-size // GROUP_BYTES))
    hot = frequent_keys(rows, depth)
    dealt = rows.mapInArrow(_lean(_deal(groups, depth, hot)), "grp int, settled boolean, blob binary")
    width = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(groups, 20_000))
    # by their numbers, so that no task gets several groups by chance while others have none
    return dealt.repartitionById(width, "grp").sortWithinPartitions("grp").mapInArrow(
        _lean(_settle(depth)), "_id long, _slot long, start long, end long"
    )


def frequent_keys(rows: DataFrame, depth: int) -> np.ndarray:
    """Sorted keys of over HOT_SHARE of the runs in one document of SAMPLE_EVERY; at most 1 / HOT_SHARE of them."""

    def count(batches):
        none = np.zeros(0, _U)
        for pieces in _pieces(batches, depth):
            found, many = np.unique(Unit(pieces, depth).runs(depth, none)[3].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(many.astype(np.int64))], ["key", "n"])

    sample = rows.filter(F.pmod(F.xxhash64("_id"), F.lit(SAMPLE_EVERY)) == 0)
    counts = sample.mapInArrow(_lean(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.filter(F.col("n") > max(64, total * HOT_SHARE)).select("key").toArrow().column("key")
    return np.sort(found.to_numpy().view(_U))


def _squeeze(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    def work(columns):
        pack = zstandard.ZstdCompressor(level=6).compress
        for texts in columns:
            found = (text.as_py() for text in texts.cast(pa.large_binary()))
            yield pa.array([None if text is None else pack(text) for text in found], pa.binary())

    yield from frugal(work)(columns)


def _cut(text: bytes, ranges) -> tuple:
    """(kept bytes, removed spans as a merged array) for unordered ranges."""
    if ranges is None or not len(ranges):
        return text, np.zeros((0, 2), np.int64)
    own = np.array([(r["start"], r["end"]) for r in ranges], np.int64)
    own = own[np.argsort(own[:, 0], kind="stable")]
    reach = np.maximum.accumulate(own[:, 1])
    fresh = np.ones(len(own), bool)
    fresh[1:] = own[1:, 0] > reach[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(own)) - 1
    spans = np.stack([own[first, 0], reach[last]], axis=1)
    edges = [0, *spans.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])), spans


def _with_ranges(docs: DataFrame, depth: int) -> DataFrame:
    """Rows of ``docs``, the text packed as _z, with all their ranges."""
    rows = keyed(docs)
    # equal rows share their ranges, so a set is enough however often a row is repeated
    ranges = removed_ranges(rows, depth).groupBy("_id", "_slot").agg(F.collect_set(F.struct("start", "end")).alias("_ranges"))
    packed = rows.withColumn("_z", F.arrow_udf(_squeeze, "binary")("text")).drop("text")
    return packed.join(ranges, ["_id", "_slot"], "left")


def digest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    A byte is removed if a window of ``depth`` bytes that covers it also starts in a row of a smaller
    doc_id; windows are judged on the input. Rows with equal ids never remove each other's bytes, and
    a null id counts as greater than every other. Null texts are empty. Texts shorter than ``depth``
    keep all bytes. An empty table gives an empty result; further columns are ignored.
    """
    rows = _with_ranges(docs.select("doc_id", "text"), depth)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def finish(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for z, ranges in zip(batch.column("_z"), batch.column("_ranges")):
                packed = z.as_py()
                text = unpack(packed) if packed else b""
                kept, spans = _cut(text, ranges.as_py())
                out.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return rows.select("doc_id", "_z", "_ranges").mapInArrow(
        finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def _kept_text(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    unpack = zstandard.ZstdDecompressor().decompress

    def one(z, found):
        if z is None:
            return None
        text = unpack(z)
        whole = []
        for a, b in _cut(text, found)[1].tolist():  # a character that is only partly covered stays
            while a < b and text[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
                b -= 1
            whole.append({"start": a, "end": b})
        return _cut(text, whole)[0].decode()

    def work(columns):
        for packed, ranges in columns:
            yield pa.array([one(z.as_py(), found.as_py()) for z, found in zip(packed, ranges)], pa.string())

    yield from frugal(work)(columns)


def cut_repeats(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``docs`` with repeated passages cut out of their texts; every row and every other column stays.

    A character of which only some bytes are covered stays whole. n_chars, where there is such a
    column, follows the new text.
    """
    rows = _with_ranges(docs, depth).withColumn("text", F.arrow_udf(_kept_text, "string")("_z", "_ranges"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def op6_suffixes(spark, sf_dir):
    """Repeated passages of all documents."""
    return digest(table(spark, sf_dir, "documents"))
