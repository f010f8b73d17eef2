"""Removal of repeated passages by threshold-bounded interval expansion on a BWT.

A byte goes if it lies in a string of SPAN bytes that also starts in a document with a smaller id.

1. Each window of SPAN bytes has an anchor, the least hash of its ANCHOR-byte substrings. Equal
   windows have equal anchors, so a window can repeat only if its anchor occurs in two documents.
   Blocks of documents send their distinct anchors to owners of hash ranges, which send back
   those that are shared.
2. Runs of windows with the same shared anchor are segments. Each block sends its distinct
   segments, with the least and the largest document of each, to the owner of the anchor.
3. An owner joins its distinct segments to one text and takes its Burrows-Wheeler transform.
   Intervals of the suffix order are extended backwards, breadth first: those found in step l
   bound the suffixes whose common prefix with their neighbour is l. Expansion stops at SPAN; what
   is not bounded by then shares SPAN bytes. Each class of such windows has a least document.
4. Owners send back, for each segment, the least documents of its windows where they matter, and
   each block marks, joins and cuts the removed bytes of its documents.

Skew: a passage reaches an owner once for each block that holds it. An anchor that occurs in many
blocks is split by the bytes beside it (each window holds the HALF bytes before or those after its
anchor), so that different surroundings of a frequent phrase have different owners.

Defined cases: a null text is empty; a document of fewer than SPAN bytes loses nothing; rows with
equal ids never remove each other's bytes; a null id is neither smaller nor larger than another,
so its document stays whole and removes nothing; an empty table gives no rows; texts of any
length are processed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts_for, shared_dir, table, text_of, written

SPAN = 50
ANCHOR = 24
REACH = SPAN - ANCHOR + 1
HALF = REACH // 2
#: Text bytes for a block, for an owner of anchors, for an owner of segments; blocks that make an anchor hot.
BLOCK_BYTES = 8 << 20
OWNER_TEXT = 24 << 20
OWNER_SEGMENTS = 4 << 20
HOT_BLOCKS = 256
#: Text bytes that are hashed at once: few calls for short documents, arrays that stay in the cache.
HASHED_BYTES = 1 << 16

_ODD = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_NONE = np.iinfo(np.int64).max


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _MIX
    x ^= x >> np.uint64(29)
    x *= _MIX
    x ^= x >> np.uint64(32)
    return x


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all substrings of a width, from those of half the width."""
    powers, have = {}, 1
    h = mixed(data.astype(np.uint64) + np.uint64(1))
    powers[1] = h
    while have * 2 <= width:
        h = h[:-have] * np.uint64(pow(_ODD, have, 1 << 64)) + h[have:]
        have *= 2
        powers[have] = h
    out, done = powers[have], have
    for size in sorted(powers, reverse=True):
        while done + size <= width:
            n = len(powers[size]) - done
            out = out[:n] * np.uint64(pow(_ODD, size, 1 << 64)) + powers[size][done : done + n]
            done += size
    return mixed(out)


def window_anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of SPAN bytes its anchor; and the hashes of all substrings."""
    if len(data) < SPAN:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    every = rolling(data, ANCHOR)
    least, have = every, 1
    while have * 2 <= REACH:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < REACH:
        shift = REACH - have
        least = np.minimum(least[: len(least) - shift], least[shift:])
    return mixed(least), every


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers as compressed byte planes of their differences."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view("<u8"), dtype=np.uint64)


# -- blocks ----------------------------------------------------------------------------------


def make_blocks(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, doc_ids, sizes, data (compressed)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial, keys, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal serial, keys, texts, size
            row = [[part << 32 | serial], [keys], [list(map(len, texts))], [zstandard.ZstdCompressor(level=3).compress(b"".join(texts))]]
            serial, keys, texts, size = serial + 1, [], [], 0
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.record_batch([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], ["block", "doc_ids", "sizes", "data"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(key)
                texts.append(text.encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                if size >= block_bytes:
                    yield close()
        if keys:
            yield close()

    return rows.mapInArrow(make, "block long, doc_ids array<long>, sizes array<long>, data binary")


def documents_of(batch: pa.RecordBatch, row: int) -> Iterator[tuple[int | None, np.ndarray]]:
    data = np.frombuffer(zstandard.decompress(batch.column("data")[row].as_py()), np.uint8)
    at = 0
    for key, size in zip(batch.column("doc_ids")[row].as_py(), batch.column("sizes")[row].as_py(), strict=True):
        yield key, data[at : at + size]
        at += size


def anchor_runs(batch: pa.RecordBatch, row: int) -> Iterator[tuple]:
    """For some documents at a time, of those with an id and SPAN bytes: their joined bytes, anchors
    and hashes; per run of windows with one anchor, first window, after the last and document; per
    document its number, id and first byte."""
    data = np.frombuffer(zstandard.decompress(batch.column("data")[row].as_py()), np.uint8)
    sizes, keys = np.array(batch.column("sizes")[row].as_py(), np.int64), batch.column("doc_ids")[row].as_py()
    after = np.cumsum(sizes)
    begin = after - sizes
    able = np.flatnonzero((sizes >= SPAN) & np.array([k is not None for k in keys], bool))
    for numbers in np.split(able, np.flatnonzero(np.diff(begin[able] // HASHED_BYTES)) + 1):
        if not len(numbers):
            continue
        low = begin[numbers[0]]
        piece, start, stop = data[low : after[numbers[-1]]], begin[numbers] - low, after[numbers] - low - SPAN + 1
        anchor, every = window_anchors(piece)
        new = np.empty(len(anchor), bool)
        new[0], new[1:] = True, anchor[1:] != anchor[:-1]
        new[start], new[stop[:-1]] = True, True
        edge = np.flatnonzero(new)
        end = np.append(edge[1:], len(anchor))
        of = np.searchsorted(start, edge, "right") - 1
        whole = edge < stop[of]  # the others cross the end of a document
        yield piece, anchor, every, edge[whole], end[whole], of[whole], numbers, np.array([keys[i] for i in numbers], np.int64), start


def block_anchors(batch: pa.RecordBatch, row: int, bits: int) -> np.ndarray:
    """Ascending distinct anchors (their leading bits, then 1 if in documents of two ids or more)."""
    hashes, keys = [], []
    for _, anchor, _, edge, _, of, _, ids, _ in anchor_runs(batch, row):
        hashes.append(anchor[edge] >> np.uint64(64 - bits))
        keys.append(ids[of])
    if not hashes:
        return np.zeros(0, np.uint64)
    h, k = np.concatenate(hashes), np.concatenate(keys)
    order = np.argsort(h)
    h, k = h[order], k[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    several = np.minimum.reduceat(k, first) != np.maximum.reduceat(k, first)
    return (h[first] << np.uint64(1)) | several


def shared_anchors(blocks: DataFrame, bits: int, owners: int) -> DataFrame:
    """Per block and owner: the shared anchors (leading bits, then 1 if hot), packed."""
    step = np.uint64(max(1, -(-(1 << bits) // owners)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = block_anchors(batch, row, bits)
                if not len(found):
                    continue
                owner = ((found >> np.uint64(1)) // step).astype(np.int64)
                runs = np.split(found, np.flatnonzero(np.diff(owner)) + 1)
                ids = np.unique(owner)
                block = batch.column("block")[row].as_py()
                yield pa.record_batch([pa.array(ids), pa.array([block] * len(ids), pa.int64()), pa.array([pack_sorted(r) for r in runs], pa.binary())], ["owner", "block", "packed"])

    def decide(group: pa.Table) -> pa.Table:
        sent = [unpack_sorted(x.as_py()) for x in group.column("packed")]
        every = np.concatenate(sent)
        every.sort()
        value = every >> np.uint64(1)
        first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        count = np.diff(np.r_[first, len(value)])
        several = np.bitwise_or.reduceat(every & np.uint64(1), first) == 1
        keep = several | (count > 1)
        shared, hot = value[first][keep], (count > HOT_BLOCKS)[keep]
        out = []
        for mine in sent:
            own = mine >> np.uint64(1)
            at = np.minimum(np.searchsorted(shared, own), max(0, len(shared) - 1))
            hit = shared[at] == own if len(shared) else np.zeros(len(own), bool)
            out.append(pack_sorted((own[hit] << np.uint64(1)) | hot[at[hit]]))
        return pa.table({"block": group.column("block"), "owner": group.column("owner"), "shared": pa.array(out, pa.binary())})

    sent = blocks.select("block", "doc_ids", "sizes", "data").mapInArrow(send, "owner long, block long, packed binary")
    return sent.groupBy("owner").applyInArrow(decide, "block long, owner long, shared binary")


# -- segments --------------------------------------------------------------------------------


def hot_runs(data: np.ndarray, anchor: np.ndarray, every: np.ndarray, edge: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of windows with a hot anchor, keyed by the anchor with the bytes before or after it."""
    size = ends - edge
    windows = np.repeat(edge - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    least, place = mixed(every), np.zeros(len(windows), np.int64)
    for o in range(REACH - 1, -1, -1):
        place[least[windows + o] == anchor[windows]] = o
    wide, p = rolling(data, ANCHOR + HALF), windows + place
    left = place >= HALF
    beside = mixed(np.where(left, wide[np.where(left, p - HALF, 0)], wide[np.where(left, 0, p)] + np.uint64(1)))
    cut = np.flatnonzero(np.r_[True, (beside[1:] != beside[:-1]) | (np.diff(windows) != 1)])
    yield from zip(beside[cut].tolist(), windows[cut].tolist(), (windows[np.r_[cut[1:] - 1, len(windows) - 1]] + 1).tolist(), strict=True)


def block_segments(batch: pa.RecordBatch, row: int, bits: int) -> tuple[dict, np.ndarray]:
    """Distinct segments (key, bytes) in order of first sight, with number, least and largest
    document; and the places: (document, first window, number of the segment). Segments are maximal
    runs of windows with the same shared anchor, or if it is hot, the same surroundings."""
    shared = [unpack_sorted(x) for x in batch.column("shared")[row].as_py() or ()]
    shared = np.sort(np.concatenate(shared)) if shared else np.zeros(0, np.uint64)
    seen, places = {}, [np.zeros((0, 3), np.int64)]
    if not len(shared):
        return seen, places[0]
    known = shared >> np.uint64(1)
    for data, anchor, every, edge, end, of, numbers, ids, start in anchor_runs(batch, row):
        key = anchor[edge]
        value = key >> np.uint64(64 - bits)
        at = np.minimum(np.searchsorted(known, value), len(known) - 1)
        hit = known[at] == value
        hot = hit & ((shared[at] & np.uint64(1)) == 1)
        hit &= ~hot
        key, first, last, doc = key[hit], edge[hit], end[hit], of[hit]
        if hot.any():
            k, f, t = zip(*hot_runs(data, anchor, every, edge[hot], end[hot]), strict=True)
            key, first, last = np.r_[key, np.array(k, np.uint64)], np.r_[first, f], np.r_[last, t]
            doc = np.searchsorted(start, first, "right") - 1
            order = np.argsort(doc, kind="stable")
            key, first, last, doc = key[order], first[order], last[order], doc[order]
        raw, mine = data.tobytes(), []
        for k, f, t, d in zip(key.tolist(), first.tolist(), (last + (SPAN - 1)).tolist(), ids[doc].tolist(), strict=True):
            name = (k, raw[f:t])
            entry = seen.get(name)
            if entry is None:
                entry = seen[name] = [len(seen), d, d]
            elif d < entry[1]:
                entry[1] = d
            elif d > entry[2]:
                entry[2] = d
            mine.append(entry[0])
        places.append(np.stack([numbers[doc], first - start[doc], np.array(mine, np.int64)], axis=1))
    return seen, np.concatenate(places)


def pack_table(values: np.ndarray) -> bytes:
    """Signed numbers as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_table(blob: bytes, rows: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<i8").reshape(rows, -1)


def send_segments(blocks: DataFrame, bits: int, owners: int) -> DataFrame:
    """Per block and owner: packed segments; and to the block itself (an owner below 0) the places."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                seen, places = block_segments(batch, row, bits)
                if not seen:
                    continue
                names, entries = list(seen), np.array(list(seen.values()), np.int64)
                owner = np.fromiter((n[0] % owners for n in names), np.int64, len(names))
                order = np.argsort(owner, kind="stable")
                block = batch.column("block")[row].as_py()
                out, pack = [pack_table(places.T.copy())], zstandard.ZstdCompressor(level=1)
                for run in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1):
                    sizes = np.array([len(names[i][1]) for i in run], np.int64)
                    head = np.concatenate([[len(run)], sizes, entries[run].T.reshape(-1)]).astype("<i8").tobytes()
                    out.append(pack.compress(head + b"".join([names[i][1] for i in run])))
                ids = np.r_[-1 - block, np.unique(owner)]
                yield pa.record_batch([pa.array(ids), pa.array([block] * len(ids), pa.int64()), pa.array(out, pa.binary())], ["owner", "block", "packed"])

    return blocks.mapInArrow(send, "owner long, block long, packed binary")


# -- the transform -----------------------------------------------------------------------------


def leading(text: np.ndarray, width: int = 8) -> np.ndarray:
    """The next bytes of each place as one number; zeros follow the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.ndarray(len(text), ">u8", padded, strides=(1,)).astype(np.uint64)
    return key >> np.uint64(64 - 8 * width)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first `depth` bytes or more, by doubling from eight bytes; only
    groups of suffixes that are still equal are sorted again."""
    n = len(text)
    key = leading(text)
    order = np.argsort(key)
    ranked = key[order]
    start = np.r_[True, ranked[1:] != ranked[:-1]]
    have = 8
    while have < depth:
        group = np.flatnonzero(start)
        size = np.diff(np.r_[group, n])
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(group, size)
        open_places = np.flatnonzero(np.repeat(size > 1, size))
        if not len(open_places):
            break
        mine = order[open_places]
        after = mine + have
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        merged = (rank[mine].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        by = np.argsort(merged)
        order[open_places] = mine[by]
        merged = merged[by]
        start[open_places[1:]] |= merged[1:] != merged[:-1]
        have *= 2
    return order


def bounded_prefixes(text: np.ndarray, order: np.ndarray, least: int, seed: int = 8) -> np.ndarray:
    """For each place of the suffix order: True if the suffix shares fewer than `least` bytes with
    the one before it.

    Breadth-first backward extension: the first intervals are those of all strings of `seed`
    bytes; the extensions of an interval of step l by each byte before its suffixes are intervals
    of step l + 1. An end of an extension that no shorter string has bounded yet is bounded now,
    and only such extensions are kept.
    """
    n = len(text)
    bwt = text[order - 1]  # the text before the first byte is its last one, as in a rotation
    forward = np.empty(n, np.int32)  # where the suffix with the byte before it lies
    forward[np.argsort(bwt, kind="stable")] = np.arange(n, dtype=np.int32)
    bound = np.zeros(n + 1, bool)
    bound[0] = bound[n] = True
    key = leading(text, seed)[order]
    bound[1:n] |= key[1:] != key[:-1]
    edges = np.flatnonzero(bound).astype(np.int32)
    low, high = edges[:-1], edges[1:]
    for _ in range(seed, least):
        if not len(low):
            break
        size = high - low
        rows = np.repeat(low - (np.cumsum(size, dtype=np.int32) - size), size) + np.arange(int(size.sum()), dtype=np.int32)
        of = np.repeat(np.arange(len(low), dtype=np.int32), size)
        # The intervals are disjoint and ascend, so ordering their places by byte, stably, orders
        # the extensions, and those of one interval by one byte lie together.
        byte = bwt[rows]
        by = np.argsort(byte, kind="stable")
        of, byte, target = of[by], byte[by], forward[rows[by]]
        first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (byte[1:] != byte[:-1])])
        low, high = target[first], target[np.r_[first[1:] - 1, len(target) - 1]] + 1
        fresh = ~bound[high]
        low, high = low[fresh], high[fresh]
        bound[high] = True
    return bound[:n]


def least_documents(segments: list[bytes], documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each segment the least document that holds an equal window; and the
    number of windows of each segment."""
    lengths = np.fromiter(map(len, segments), np.int64, len(segments))
    begin = 1 + np.cumsum(lengths + 1) - (lengths + 1)
    # Bytes of UTF-8 end at 0xF4, so that 0 is free to part the segments.
    text = np.frombuffer(b"\0" + b"\0".join(segments) + b"\0", np.uint8) + np.uint8(1)
    text[0] = 0
    text[begin + lengths] = 0
    windows = lengths - SPAN + 1
    order = suffix_order(text, SPAN)
    bound = bounded_prefixes(text, order, SPAN)
    held = np.full(len(text), _NONE, np.int64)
    offset = np.cumsum(windows) - windows
    places = np.repeat(begin - offset, windows) + np.arange(int(windows.sum()))
    held[places] = np.repeat(documents, windows)
    ranked = held[order]
    first = np.flatnonzero(bound)
    least = np.minimum.reduceat(ranked, first)
    of = np.empty(len(text), np.int32)
    of[order] = np.cumsum(bound, dtype=np.int32) - 1
    return least[of[places]], windows


def resolve(group: pa.Table) -> pa.Table:
    """Per block: (number, first window, windows, least document) of what its documents may lose."""
    if group.column("owner")[0].as_py() < 0:
        return pa.table({"block": group.column("block"), "places": pa.array([True] * len(group)), "answer": group.column("packed")})
    known: dict[bytes, int] = {}
    least: list[int] = []
    asked = []
    for packed in group.column("packed"):
        raw = zstandard.decompress(packed.as_py())
        n = int.from_bytes(raw[:8], "little")
        head = np.frombuffer(raw, "<i8", 4 * n, 8).reshape(4, n)
        at, mine = 8 + 32 * n, []
        for size, number, low, high in zip(*head.tolist(), strict=True):
            name = raw[at : at + size]
            at += size
            i = known.setdefault(name, len(known))
            if i == len(least):
                least.append(low)
            elif low < least[i]:
                least[i] = low
            mine.append((i, number, high))
        asked.append(mine)
    every, windows = least_documents(list(known), np.array(least, np.int64))
    # Runs of windows with the same least document, once for each distinct segment.
    after = np.cumsum(windows)
    begin = after - windows
    new = np.r_[True, every[1:] != every[:-1]]
    new[begin] = True
    edge = np.flatnonzero(new)
    lo = np.searchsorted(edge, begin)
    hi = np.append(lo[1:], len(edge))
    run_start, run_min = edge - np.repeat(begin, hi - lo), every[edge]
    run_size = np.diff(np.r_[edge, len(every)])
    out = []
    for mine in asked:
        m = np.array(mine, np.int64).reshape(-1, 3)
        count = hi[m[:, 0]] - lo[m[:, 0]]
        row = np.repeat(lo[m[:, 0]] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        number, high = np.repeat(m[:, 1], count), np.repeat(m[:, 2], count)
        hit = run_min[row] < high
        table = np.stack([number[hit], run_start[row][hit], run_size[row][hit], run_min[row][hit]])
        out.append(pack_table(table))
    return pa.table({"block": group.column("block"), "places": pa.array([False] * len(out)), "answer": pa.array(out, pa.binary())})


# -- results -----------------------------------------------------------------------------------


def removed_of(batch: pa.RecordBatch, row: int) -> Iterator[tuple[int | None, np.ndarray, np.ndarray]]:
    """Each document of a block: id, bytes, mask of removed bytes."""
    parts, place = [np.zeros((4, 0), np.int64)], np.zeros((0, 3), np.int64)
    for answer in batch.column("answers")[row].as_py() or ():
        if answer["places"]:
            place = unpack_table(answer["answer"], 3).T
        else:
            parts.append(unpack_table(answer["answer"], 4))
    runs = np.concatenate(parts, axis=1)
    runs = runs[:, np.argsort(runs[0], kind="stable")]
    lo, hi = np.searchsorted(runs[0], place[:, 2]), np.searchsorted(runs[0], place[:, 2], "right")
    count = hi - lo
    at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    doc, start = np.repeat(place[:, 0], count), np.repeat(place[:, 1], count) + runs[1, at]
    end, low = start + runs[2, at] + SPAN - 1, runs[3, at]
    bounds = np.searchsorted(doc, np.arange(len(batch.column("doc_ids")[row].as_py()) + 1))
    for number, (key, data) in enumerate(documents_of(batch, row)):
        mine = slice(bounds[number], bounds[number + 1])
        hit = low[mine] < key if key is not None else np.zeros(0, bool)
        depth = np.zeros(len(data) + 1, np.int64)
        if len(hit) and hit.any():
            np.add.at(depth, start[mine][hit], 1)
            np.add.at(depth, end[mine][hit], -1)
        yield key, data, np.cumsum(depth)[: len(data)] > 0


def interval_dedup(docs: DataFrame, folder: str | None = None, give: str = "digests", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document doc_id, n_bytes, n_removed, n_spans and kept_sha256 or, with give="values",
    kept (the remaining bytes) and spans (start and end of what went)."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
    blocks = written(make_blocks(rows), folder, "blocks", "uncompressed")
    total = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = min(62, max(24, int(total).bit_length() + 6))
    owners = parts_for(total, OWNER_TEXT, least=8)
    shared = shared_anchors(blocks, bits, owners).groupBy("block").agg(F.collect_list("shared").alias("shared"))
    ready = written(shared, folder, "shared")
    joined = blocks.join(ready, "block", "left")
    sent = send_segments(joined, bits, parts_for(total, OWNER_SEGMENTS, least=8))
    found = sent.groupBy("owner").applyInArrow(resolve, "block long, places boolean, answer binary")
    answers = written(found.groupBy("block").agg(F.collect_list(F.struct("places", "answer")).alias("answers")), folder, "answers")
    values = give == "values"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                out = []
                for doc, data, gone in removed_of(batch, row):
                    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                    kept = data[~gone].tobytes()
                    last = (kept, edges.reshape(-1, 2).tolist()) if values else (hashlib.sha256(kept).hexdigest(),)
                    out.append((doc, len(data), int(gone.sum()), len(edges) // 2, *last))
                kinds = [pa.int64()] * 4 + ([pa.binary(), pa.list_(pa.list_(pa.int64()))] if values else [pa.string()])
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", *(("kept", "spans") if values else ("kept_sha256",))]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    shape = "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept binary, spans array<array<long>>" if values else "kept_sha256 string")
    return blocks.join(answers, "block", "left").mapInArrow(cut, shape)


def op5_interval_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_dedup(table(spark, sf_dir, "documents"))
