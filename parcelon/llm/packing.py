"""Packing documents into token sequences: first-fit decreasing over a tournament tree.

Documents are dealt at random to groups of a bounded size, each packed on its own. A document
longer than a sequence gives full sequences of its own; what is left of it, and every shorter
document, is placed first-fit decreasing. The tree holds the free room of the bins at its leaves
and the larger of two children above, so the first bin with enough room is found in log(bins).
Then the fullest bins are kept, as many as the tokens can fill, and the documents of the others
are cut to fill them up; the remainder goes into sequences of power-of-two lengths, which need no
padding.

Defined cases: a null text is empty and packs its end id; a text of any length is packed whole, in
as many sequences as it needs; repeated rows and null doc_ids are packed like any others, copies in
groups of their own each; documents of one size are placed in the order of their ids, then texts; an
empty table gives no rows; further columns are ignored; the number of groups follows the bytes of
text, so that a group has about GROUP_BYTES, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import tokenizer_file, word_bpe
from .common import parts_for, table, text_of

LENGTH = 4096
#: Text bytes for a group of documents.
GROUP_BYTES = 4 << 20


class Tournament:
    """Free room of up to n bins, all empty at first; finds the first with enough of it."""

    def __init__(self, n: int, room: int):
        self.leaves = 1
        while self.leaves < n:
            self.leaves *= 2
        self.room = [room] * (2 * self.leaves)

    def place(self, size: int) -> int:
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        bin_no, room[at] = at - self.leaves, room[at] - size
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
        return bin_no


def pack(sizes: list[int], length: int = LENGTH) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces of documents of the given sizes: (document, start, length, sequence, offset)."""
    sequence, items = 0, []
    for doc, size in enumerate(sizes):
        whole = size // length * length
        for start in range(0, whole, length):
            yield doc, start, length, sequence, 0
            sequence += 1
        if size > whole:
            items.append((size - whole, doc, whole))
    items.sort(key=lambda x: (-x[0], x[1]))
    tree, bins = Tournament(max(1, len(items)), length), {}
    for size, doc, start in items:
        bins.setdefault(tree.place(size), []).append((doc, start, size))
    fill = {b: sum(x[2] for x in held) for b, held in bins.items()}
    full = sum(fill.values()) // length
    ranked = sorted(bins, key=lambda b: (-fill[b], b))
    loose = [x for b in ranked[full:] for x in bins[b]][::-1]

    def poured(room: int) -> Iterator[tuple[int, int, int]]:
        while room:
            doc, start, size = loose.pop()
            took = min(room, size)
            if took < size:
                loose.append((doc, start + took, size - took))
            yield doc, start, took
            room -= took

    for b in ranked[:full]:
        offset = 0
        for doc, start, size in [*bins[b], *poured(length - fill[b])]:
            yield doc, start, size, sequence, offset
            offset += size
        sequence += 1
    rest = sum(x[2] for x in loose)
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            offset = 0
            for doc, start, size in poured(1 << bit):
                yield doc, start, size, sequence, offset
                offset += size
            sequence += 1


def pack_documents(docs: DataFrame, spec: str, end_id: int, length: int = LENGTH, seed: int = 6, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per piece: doc_id, start, length, ids (binary, four bytes each), doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    groups, end = parts_for(total, GROUP_BYTES), int(end_id).to_bytes(4, "little")
    # The row's number parts copies of one document; the tasks follow the groups.
    dealt = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed), F.monotonically_increasing_id()), F.lit(groups))
    rows = rows.withColumn("g", dealt).repartition(max(groups, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "g")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def packed(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        bpe, keys = word_bpe(spec), group.column("doc_id").to_pylist()
        ids = [bpe.ids(t) + end for t in group.column("text").to_pylist()]
        first = key[0].as_py() << 32
        out = [(keys[d], s, n, ids[d][4 * s : 4 * (s + n)], len(ids[d]) // 4, first | q, o) for d, s, n, q, o in pack([len(x) // 4 for x in ids], length)]
        return pa.table([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.groupBy("g").applyInArrow(packed, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def packed_rows(docs: DataFrame) -> DataFrame:
    pieces = pack_documents(docs, tokenizer_file("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_rows(table(spark, sf_dir, "documents"))
