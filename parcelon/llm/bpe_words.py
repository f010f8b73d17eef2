"""BPE encoding and decoding over a table of distinct words.

Spark tasks split the documents of a block into words and number the block's distinct words; a
document becomes the numbers of its words. Each block sends its distinct words, packed, to the
owners of their hash ranges; an owner encodes each distinct word once and returns the ids of
each block's words in the block's own order. There the ids meet the documents by position.
Decoding joins the distinct ids of each block with the table of pieces, which is as large as the
vocabulary and no larger; the pieces meet the ids of the documents by position too.

Skew: a frequent word reaches its owner once for each block, never once for each occurrence.

Defined cases: a null text is empty (no ids, empty decoded text); repeated rows stay apart; null
doc_ids are kept; an empty table gives no rows; a very long document is a block of its own, taken
whole; control characters, those that mark words on their way included, are text like any other;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_alphabet, tokenizer_file, word_bpe
from .common import bucketed, parts_for, shared_dir, table, text_of

#: Text bytes for a block, and for an owner of words.
BLOCK_BYTES = 8 << 20
OWNER_BYTES = 24 << 20

_PACK = {"level": 3}


def pack_numbers(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as compressed byte planes."""
    planes = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(**_PACK).compress(planes)


def unpack_numbers(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).reshape(-1).view("<u4")


def piece_table(spec: str) -> list[bytes]:
    """The bytes of each id's piece."""
    made = json.loads(spec)
    ids = {**made["model"]["vocab"], **{x["content"]: x["id"] for x in made["added_tokens"]}}
    octet = {c: b for b, c in enumerate(byte_alphabet())}
    pieces = [b""] * (max(ids.values()) + 1)
    for piece, i in ids.items():
        pieces[i] = bytes(octet[c] for c in piece) if all(c in octet for c in piece) else piece.encode()
    return pieces


def split_blocks(docs: DataFrame, spec: str, owners: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per block: block, doc_ids, counts and codes (packed), words: array of (owner, packed words)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, serial, part = word_bpe(spec), 0, TaskContext.get().partitionId()
        keys, coded, seen, size = [], [], {}, 0

        def close() -> pa.RecordBatch:
            nonlocal serial, keys, coded, seen, size
            words = list(seen)
            owner = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % owners for w in words), np.int64, len(words))
            order = np.argsort(owner, kind="stable")
            number = np.empty(len(words), np.uint32)
            number[order] = np.arange(len(words), dtype=np.uint32)
            counts = np.fromiter(map(len, coded), np.uint32, len(coded))
            codes = np.fromiter((c for d in coded for c in d), np.uint32, int(counts.sum()))
            sent, cuts, pack = [], np.flatnonzero(np.diff(owner[order])) + 1, zstandard.ZstdCompressor(**_PACK)
            for run in np.split(order, cuts) if len(order) else []:
                sent.append({"owner": int(owner[run[0]]), "packed": pack.compress("\1".join([words[i] for i in run]).encode("utf-8", "surrogatepass"))})
            row = [[part << 32 | serial], [keys], [pack_numbers(counts)], [pack_numbers(number[codes] if len(words) else codes)], [sent]]
            serial, keys, coded, seen, size = serial + 1, [], [], {}, 0
            return pa.record_batch([pa.array(v, t) for v, t in zip(row, _BLOCK, strict=True)], ["block", "doc_ids", "counts", "codes", "words"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(key)
                # The joint of packed words is no word of its own: it is escaped within words.
                coded.append([seen.setdefault(w, len(seen)) for w in (_escaped(bpe.split(text), bpe.special) if _MARKS.search(text) else bpe.split(text))])
                size += len(text)
                if size >= block_bytes:
                    yield close()
        if keys:
            yield close()

    return docs.mapInArrow(split, "block long, doc_ids array<long>, counts binary, codes binary, words array<struct<owner:int,packed:binary>>")


_BLOCK = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.struct([("owner", pa.int32()), ("packed", pa.binary())]))]


_MARKS = re.compile("[\0\1\2]")


def _escaped(words: list[str], special: dict[str, int]) -> list[str]:
    """Words that hold the joint (1) or the mark of special tokens (0), written with an escape (2)."""
    return [w if w[:1] == "\0" and w[1:] in special else "\2" + w.encode().hex() if "\0" in w or "\1" in w or w[:1] == "\2" else w for w in words]


def _plain(word: str) -> str:
    return bytes.fromhex(word[1:]).decode() if word[:1] == "\2" else word


def encode_words(blocks: DataFrame, spec: str) -> DataFrame:
    """Per block and owner: the ids of the block's words of that owner, in the block's order."""
    sent = blocks.select("block", F.explode("words").alias("w")).select("block", "w.owner", "w.packed")

    def encode(group: pa.Table) -> pa.Table:
        bpe, known = word_bpe(spec), {}
        out = []
        for packed in group.column("packed").to_pylist():
            ids, sizes = [], []
            for w in zstandard.decompress(packed).decode("utf-8", "surrogatepass").split("\1"):
                got = known.get(w)
                if got is None:
                    got = known[w] = bpe.words.special[w[1:]] if w[:1] == "\0" and w[1:] in bpe.special else bpe.words.encode(_plain(w))
                ids.append(got)
                sizes.append(len(got) // 4)
            out.append(pack_numbers(np.concatenate([np.array([len(sizes), *sizes], "<u4"), np.frombuffer(b"".join(ids), "<u4")])))
        return pa.table({"block": group.column("block"), "owner": group.column("owner"), "ids": pa.array(out, pa.binary())})

    return sent.groupBy("owner").applyInArrow(encode, "block long, owner int, ids binary")


def used_pieces(found: DataFrame, pieces: DataFrame) -> DataFrame:
    """Per block (and what its owners sent): its distinct ids with their pieces, by a join of ids."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                parts = [unpack_numbers(part["ids"].as_py()) for part in batch.column("found")[row]]
                ids = np.unique(np.concatenate([p[1 + p[0] :] for p in parts])).astype(np.int32)
                yield pa.record_batch([pa.array([batch.column("block")[row].as_py()] * len(ids), pa.int64()), pa.array(ids)], ["block", "id"])

    # As many rows as the vocabulary has: a broadcast of a bounded table.
    return found.mapInArrow(distinct, "block long, id int").join(F.broadcast(pieces), "id")


def encode_decode(docs: DataFrame, spec: str, folder: str | None = None, text: str = "text", key: str = "doc_id", give: str = "digests") -> DataFrame:
    """Per document doc_id, n_tokens and either digests (ids_sha256, decoded_sha256) or, with
    give="values", ids (array) and decoded (string)."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    owners = parts_for(total, OWNER_BYTES, least=8)
    buckets = max(owners, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = bucketed(split_blocks(rows, spec, owners), folder, "blocks", "block", buckets)
    # Used twice below; the filter, which a join would add for itself, keeps both plans the same, so
    # that words are encoded and sent once.
    found = encode_words(blocks, spec).where("block IS NOT NULL").repartition(buckets, "block").groupBy("block").agg(F.collect_list(F.struct("owner", "ids")).alias("found"))
    vocabulary = spark.createDataFrame(list(enumerate(piece_table(spec))), "id int, piece binary")
    used = used_pieces(found, vocabulary).repartition(buckets, "block").groupBy("block").agg(F.collect_list(F.struct("id", "piece")).alias("pieces"))
    joined = blocks.select("block", "doc_ids", "counts", "codes").join(found.hint("merge"), "block", "left").join(used.hint("merge"), "block", "left")
    values = give == "values"

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = {n: batch.column(n)[row] for n in ("doc_ids", "counts", "codes", "found")}
                pieces = {p["id"]: p["piece"] for p in batch.column("pieces")[row].as_py() or ()}
                names = {i: str(i) for i in pieces}
                counts, codes = unpack_numbers(at["counts"].as_py()), unpack_numbers(at["codes"].as_py())
                sizes, ids = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
                for part in sorted(at["found"].as_py() or (), key=lambda x: x["owner"]):
                    got = unpack_numbers(part["ids"])
                    sizes.append(got[1 : 1 + got[0]])
                    ids.append(got[1 + got[0] :])
                sizes, ids = np.concatenate(sizes).astype(np.int64), np.concatenate(ids)
                starts = np.cumsum(sizes) - sizes
                out, place = [], 0
                for doc, n in zip(at["doc_ids"].as_py(), counts.tolist(), strict=True):
                    mine = codes[place : place + n]
                    place += n
                    own = sizes[mine]
                    total = int(own.sum())
                    where = np.repeat(starts[mine] - (np.cumsum(own) - own), own) + np.arange(total)
                    listed = ids[where].tolist() if total else []
                    decoded = b"".join(map(pieces.__getitem__, listed)).decode("utf-8", "replace")
                    if values:
                        out.append((doc, total, listed, decoded))
                    else:
                        out.append((doc, total, hashlib.sha256(",".join(map(names.__getitem__, listed)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()) if values else pa.string(), pa.string()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "n_tokens", "a", "b"])

    made = joined.mapInArrow(rebuild, f"doc_id long, n_tokens long, a {'array<int>' if values else 'string'}, b string")
    return made.toDF("doc_id", "n_tokens", *(("ids", "decoded") if values else ("ids_sha256", "decoded_sha256")))


def op4_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
