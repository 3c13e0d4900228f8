"""Byte-level BPE by a global shuffle of distinct words.

A block is a bounded run of documents. Its texts become pre-tokens with positions: the block's distinct words,
numbered, its distinct chunks (runs of words that are cut alike, such as a word and its comma) as lists of word numbers, and
for each document the sequence of its chunks, the commoner the fewer bytes. The words are shuffled by
hash buckets, a row for each block and bucket: in its bucket a word meets its equals and is encoded once,
and the ids go back to the blocks. There the sequences are laid out by position again. So what is shuffled grows with the distinct words of the
blocks, and a word that is in every text costs one row a block. Decoding joins the ids with the token-byte table, which has as
many rows as the vocabulary and is held by every task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written_by
from .tokens import chunks, pretoken_pattern

BLOCK_CHARS = 5_000_000  # a longer document is a block of its own


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, of a rank file that every machine has at this path."""
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pack_numbers(x: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Numbers below 2**28 in 1 to 4 bytes, seven bits each, the high bit of all but a number's last set. Cut at ``ends``."""
    size = 1 + (x >= 1 << 7).astype(np.int64) + (x >= 1 << 14) + (x >= 1 << 21)
    stop = np.cumsum(size)
    out = np.empty(int(stop[-1]) if len(stop) else 0, dtype=np.uint8)
    for k in range(4):  # k bytes before a number's last
        some = size > k
        out[stop[some] - 1 - k] = ((x[some] >> (7 * k)) & 127) | (128 if k else 0)
    cuts = np.concatenate([[0], np.concatenate([[0], stop])[ends]])
    return [out[i:j].tobytes() for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def unpack_numbers(b: bytes) -> np.ndarray:
    raw = np.frombuffer(b, dtype=np.uint8)
    last = np.flatnonzero(raw < 128)
    size = np.diff(last, prepend=-1)
    out = np.zeros(len(last), dtype=np.int64)
    for k in range(4):
        some = size > k
        out[some] |= (raw[last[some] - k] & 127).astype(np.int64) << (7 * k)
    return out


def pack_words(words: list[str]) -> bytes:
    """Compressed; a byte that UTF-8 never holds divides them. No words: no bytes."""
    return zstandard.ZstdCompressor().compress(b"\xff".join(w.encode() for w in words)) if words else b""


def unpack_words(b: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(b).split(b"\xff") if b else []


def pack_ids(own: list[list[int]]) -> bytes:
    """The ids of a list of words, compressed: how many words, how many ids each, the ids."""
    sizes = list(map(len, own))
    flat = np.fromiter((i for x in ([len(own)], sizes, *own) for i in x), dtype=np.int64, count=1 + len(own) + sum(sizes))
    return zstandard.ZstdCompressor().compress(pack_numbers(flat, np.array([len(flat)]))[0])


def unpack_ids(b: bytes) -> list[bytes]:
    """Of each word its ids, little-endian unsigned 32 bits each."""
    x = unpack_numbers(zstandard.ZstdDecompressor().decompress(b))
    n = int(x[0])
    stop = np.cumsum(4 * x[1 : n + 1]).tolist()
    flat = x[n + 1 :].astype("<u4").tobytes()
    return [flat[i:j] for i, j in zip([0, *stop], stop)]


BLOCK = "block long, words array<binary>, chunk_words binary, chunk_sizes binary, ids array<long>, places array<binary>"


def pretoken_blocks(docs: DataFrame, pattern: str, buckets: int) -> DataFrame:
    """block, words (distinct pre-tokens by bucket, packed; they are numbered in this order), chunk_words and chunk_sizes (each chunk's word numbers, and how many), ids
    and places (of each document: its doc_id, and its chunks' numbers, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        match = pretoken_pattern(pattern)
        kinds = (pa.int64(), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()))
        part, at = TaskContext.get().partitionId(), 0
        number: dict[str, int] = {}
        seen: list[int] = []
        keys: list[int | None] = []
        ends: list[int] = []
        chars = 0

        def block() -> pa.RecordBatch:
            order = np.array(seen, dtype=np.int64)
            common = np.argsort(-np.bincount(order, minlength=len(number)), kind="stable")  # commonest first
            rank = np.empty(len(common), dtype=np.int64)
            rank[common] = np.arange(len(common))
            names = list(number)
            cut = [match.findall(names[i]) for i in common.tolist()]
            dealt: list[list[str]] = [[] for _ in range(buckets)]
            for w in dict.fromkeys(w for c in cut for w in c):
                dealt[zlib.crc32(w.encode()) % buckets].append(w)
            for ws in dealt:
                ws.sort()
            word = {w: n for n, w in enumerate(w for ws in dealt for w in ws)}
            whole = lambda xs: pack_numbers(a := np.array(xs, dtype=np.int64), np.array([len(a)]))[0]
            values = ((part << 32) | at, list(map(pack_words, dealt)), whole([word[w] for c in cut for w in c]), whole([len(c) for c in cut]), keys, pack_numbers(rank[order], np.array(ends, dtype=np.int64)))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py() or ""
                if keys and chars + len(text) > BLOCK_CHARS:
                    yield block()
                    number, seen, keys, ends, chars, at = {}, [], [], [], 0, at + 1
                seen += [number[c] if c in number else number.setdefault(c, len(number)) for c in chunks(text, match)]
                ends.append(len(seen))
                keys.append(key)
                chars += len(text)
        if keys:
            yield block()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BLOCK)


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """words: block, bucket, words. The ids of the words, packed. A bucket's rows
    arrive together, each distinct word of it is encoded once, and only one bucket's words are held."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        # Words are what the tokenizer's pattern has matched; here each is one match.
        encode = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=ranks(path), special_tokens={}).encode_ordinary
        last, known = None, {}
        for batch in batches:
            for r in range(batch.num_rows):
                bucket = batch.column(1)[r].as_py()
                if bucket != last:
                    last, known = bucket, {}
                own = []
                for w in unpack_words(batch.column(2)[r].as_py()):
                    ids = known.get(w)
                    if ids is None:
                        known[w] = ids = encode(w.decode())
                    own.append(ids)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(r, 1), batch.column(1).slice(r, 1), pa.array([pack_ids(own)], pa.binary())], ["block", "bucket", "ids"])

    met = words.repartition(parts, "bucket").sortWithinPartitions("bucket").select("block", "bucket", "words")
    return met.mapInArrow(run, "block long, bucket int, ids binary")


def _coded_blocks(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """chunk_words, chunk_sizes, ids, places of each block, and ``coded``: the ids of its words by bucket."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks, _ = written_by(pretoken_blocks(docs, pattern, 4 * parts), "pretokens", "block", parts)
    words = blocks.select("block", F.posexplode("words").alias("bucket", "words")).filter(F.length("words") > 0)
    coded = encode_words(words, path)
    known = coded.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "ids"))).alias("coded"))
    return blocks.drop("words").join(known.hint("merge"), "block", "left").select("chunk_words", "chunk_sizes", "ids", "places", "coded")


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks to doc_id, ids: each document's sequence by position, 256 documents at a time."""
    for batch in batches:
        for r in range(batch.num_rows):
            row = {name: batch.column(i)[r] for i, name in enumerate(batch.schema.names)}
            own: list[bytes] = []
            for x in row["coded"].as_py() or ():
                own += unpack_ids(x["ids"])
            words = [own[n] for n in unpack_numbers(row["chunk_words"].as_py()).tolist()]
            stop = np.cumsum(unpack_numbers(row["chunk_sizes"].as_py())).tolist()
            chunk = [words[j - 1] if j - i == 1 else b"".join(words[i:j]) for i, j in zip([0, *stop], stop)]
            keys, places = row["ids"].values, row["places"].values
            for at in range(0, len(keys), 256):
                out = [b"".join(map(chunk.__getitem__, unpack_numbers(p.as_py()).tolist())) for p in places[at : at + 256]]
                yield pa.RecordBatch.from_arrays([keys[at : at + 256], pa.array(out, pa.binary())], ["doc_id", "ids"])


def _read_back(batches: Iterator[pa.RecordBatch], path: str, digest: bool) -> Iterator[pa.RecordBatch]:
    """doc_id, ids to what the ids stand for, by a look-up in the token-byte table; with ``digest`` to the contract's columns."""
    token = {n: b for b, n in ranks(path).items()}
    decimal = {n: b"%d" % n for n in token} if digest else {}
    for batch in batches:
        out: list[tuple] = []
        for x in batch.column(1):
            ids = np.frombuffer(x.as_buffer(), dtype="<u4").tolist() if x.is_valid else []
            decoded = b"".join(map(token.__getitem__, ids))
            out.append((len(ids), hashlib.sha256(b" ".join(map(decimal.__getitem__, ids))).hexdigest(), hashlib.sha256(decoded).hexdigest()) if digest else (decoded,))
        kinds = (pa.int64(), pa.string(), pa.string()) if digest else (pa.binary(),)
        columns = zip(*out, strict=True) if out else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [c.split()[0] for c in (DIGEST if digest else DECODED).split(", ")])


DECODED = "doc_id long, decoded binary"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _defaults(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32 bits each) for every row; other columns are left out, whatever their names. Null text counts
    as empty: no ids. Rows that repeat, and rows without doc_id, each come back; texts are read whole; an empty table gives an empty result."""
    return _coded_blocks(docs, *_defaults(path, pattern)).mapInArrow(_laid_out, "doc_id long, ids binary")


def decode_documents(coded: DataFrame, path: str | None = None, digest: bool = False) -> DataFrame:
    """coded: doc_id, ids. The bytes that the ids stand for: ``decoded`` (binary), by a look-up in the token-byte table.
    With ``digest`` the contract's columns take the place of the bytes. Null ids count as none."""
    own = _defaults(path, None)[0]
    return coded.mapInArrow(lambda batches: _read_back(batches, own, digest), DIGEST if digest else DECODED)


def decode_by_join(coded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, decoded: the same by a join with the token-byte table, a row for each id, put together again by position. It shuffles a row a token, many
    times the input (figures in the README), so the registered query looks ids up instead. Null ids count as none; rows that repeat stay."""
    own = _defaults(path, None)[0]
    spark = coded.sparkSession

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x.as_buffer(), dtype="<u4").astype(np.int32) if x.is_valid else np.empty(0, np.int32) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "row", "ids"])

    table_of = spark.createDataFrame([(n, b.hex()) for b, n in ranks(own).items()], "id int, bytes string")  # as many rows as the vocabulary has
    rows = coded.select("doc_id", "ids", F.monotonically_increasing_id().alias("row")).mapInArrow(listed, "doc_id long, row long, ids array<int>")
    each = rows.select("doc_id", "row", F.posexplode_outer("ids").alias("at", "id")).join(F.broadcast(table_of), "id", "left")
    whole = each.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("at", "bytes"))).alias("parts"))
    return whole.select("doc_id", F.unhex(F.array_join(F.transform("parts", lambda x: x["bytes"]), "")).alias("decoded"))


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The contract's columns of ``decode_documents(encode_documents(docs))``, laid out and read back in one worker, so that
    the ids needn't pass through another."""
    own, cut = _defaults(path, pattern)
    return _coded_blocks(docs, own, cut).mapInArrow(lambda batches: _read_back(_laid_out(batches), own, True), DIGEST)


def op6_bpe_word_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return round_trip(table(spark, sf_dir, "documents"))
