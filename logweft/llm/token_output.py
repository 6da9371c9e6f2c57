"""Token-ID output: binary shards of documents, each compressed alone with one shared zstandard dictionary.

A shard is: magic, version, id width, number of documents, tokens of the same file before it, SHA-256 of the
dictionary, an offset index, the number of ids and the document id of each entry, then the frames. So one document is
read by its index entry alone: read_document(). Shards are the rows of Parquet files, one file for each range of
document ids and its shards in order, since Spark can write and commit those on any file system; file and shard number
order them.

The dictionary is trained on the serialized ids of SAMPLE documents, those with the smallest hash of their id, whole;
executors encode them. What it is trained on changes the size of the frames and nothing else.

Defined cases: null text is empty and gives the end id alone; a null document id sorts first and is kept; equal ids
are ordered by length and frame, and the one with the smallest hash of its text is sampled; an empty table gives no
shard. Tables too small to train on get a raw dictionary of the sample's ids. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, dealt_by_id, partitions, table, tidy

#: Documents to train the dictionary on, bytes of ids that one training sample holds, and the dictionary's bytes.
SAMPLE, PIECE, DICT_BYTES = 1000, 64 * 1024, 64 * 1024
#: Frames of a shard, in bytes; words whose ids a worker remembers.
SHARD_BYTES, REMEMBER = 4 << 20, 200_000
END_ID, LEVEL, MAGIC = 1, 3, b"TIDS"
_HEAD = struct.Struct("<4sBBIQ32s")
_WORD = re.compile("[^ \t-\r]+")
# The tokenizer's pattern, and the characters by which its byte level writes bytes.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(_SHOWN))}
# Letters that lower-case one to one and compose with nothing, digits, and ASCII signs but the apostrophe and <, which starts a special token.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ0-9!\"#$%&()*+,./:;=>?@\\[\\\\\\]^_`{|}~-]+")
_RUNS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class Encoder:
    """Ids of texts as bytes of `width` bytes an id.

    Tokens never span ASCII white space, so words are encoded alone, and remembered. A word of plain Latin letters and
    signs is cut into runs as the tokenizer's own pattern does, and only the runs' merges are asked for; every other
    word goes through the whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.width = 2 if self.t.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        setup = json.loads(self.t.to_str())
        # The short way holds for this kind of tokenizer only; its parts are compared with what it was written for.
        pre = setup.get("pre_tokenizer") or {}
        self.plain = _PLAIN if setup["model"]["type"] == "BPE" and [x.get("type") for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["pattern"].get("Regex") == _PATTERN and [x["type"] for x in (setup.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] else None

    def _run(self, run: str) -> bytes:
        ids = [x.id for x in self.t.model.tokenize("".join(map(_BYTE_CHARS.__getitem__, run.encode())))]
        found = np.array(ids, dtype=self.kind).tobytes()
        if len(self.runs) < REMEMBER:
            self.runs[run] = found
        return found

    def _word(self, word: str) -> bytes:
        if self.plain and self.plain.fullmatch(word):
            runs = self.runs
            found = b"".join([runs.get(r) or self._run(r) for r in _RUNS.findall(word.lower())])
        else:
            found = np.array(self.t.encode(word, add_special_tokens=False).ids, dtype=self.kind).tobytes()
        if len(self.words) < REMEMBER:
            self.words[word] = found
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        known, word = self.words.get, self._word
        return [b"".join([known(w) or word(w) for w in _WORD.findall(t)]) for t in texts]


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process: what it remembers serves all its tasks."""
    return Encoder(path)


def train(samples: list[bytes]) -> bytes:
    """The dictionary's bytes; with too little to train on, the end of the samples."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICT_BYTES:].ljust(8, b"\0")


def write_shard(width: int, before: int, dictionary: bytes, docs: list[tuple[int | None, int, bytes]]) -> bytes:
    """docs: (document id, number of ids, frame)."""
    n = len(docs)
    offsets = np.zeros(n + 1, dtype="<u8")
    np.cumsum([len(d[2]) for d in docs], out=offsets[1:])
    ids = np.array([0 if d[0] is None else d[0] for d in docs], dtype="<i8")
    known = np.array([d[0] is not None for d in docs], dtype="u1")
    counts = np.array([d[1] for d in docs], dtype="<u8")
    head = _HEAD.pack(MAGIC, 1, width, n, before, hashlib.sha256(dictionary).digest())
    return b"".join([head, offsets.tobytes(), counts.tobytes(), ids.tobytes(), known.tobytes(), *(d[2] for d in docs)])


class Shard:
    """Reads a shard; ids(i) touches one frame."""

    def __init__(self, data: bytes, dictionary: bytes):
        import zstandard

        magic, version, self.width, n, self.before, digest = _HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a shard of token ids")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        at = _HEAD.size
        self.offsets = np.frombuffer(data, "<u8", n + 1, at)
        self.counts = np.frombuffer(data, "<u8", n, at := at + 8 * (n + 1))
        self.doc_ids = np.frombuffer(data, "<i8", n, at := at + 8 * n)
        self.known = np.frombuffer(data, "u1", n, at := at + 8 * n)
        self.at, self.data = at + n, data
        self.reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def __len__(self) -> int:
        return len(self.counts)

    def ids(self, i: int) -> np.ndarray:
        a, b = int(self.offsets[i]) + self.at, int(self.offsets[i + 1]) + self.at
        raw = self.reader.decompress(self.data[a:b], max_output_size=int(self.counts[i]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}")


def read_document(data: bytes, dictionary: bytes, i: int) -> np.ndarray:
    """The ids of a shard's i-th document."""
    return Shard(data, dictionary).ids(i)


def sampled(docs: DataFrame, tokenizer: str, end: bytes, n: int = SAMPLE) -> list[bytes]:
    """Serialized ids of n documents, those with the smallest hash of their id, in pieces. Ids are chosen first, so few
    texts move."""
    last = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).agg(F.max(F.xxhash64("doc_id"))).first()[0]
    place = F.when(F.col("text").isNotNull(), F.xxhash64("text"))
    some = docs.filter(F.xxhash64("doc_id") <= F.lit(last)).groupBy("doc_id").agg(F.min_by("text", place).alias("text")) if last is not None else docs.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            coded = [x + end for x in coder.encode(batch.column(1).fill_null("").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([x[i : i + PIECE] for x in coded for i in range(0, len(x), PIECE)], pa.binary())], ["ids"])

    return sorted(some.select("doc_id", "text").mapInArrow(tidy(run), "ids binary").toArrow()["ids"].to_pylist())


def write(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> tuple[DataFrame, bytes, str]:
    """docs (doc_id, text) -> the written shards (file, shard, n_docs, n_tokens, data), the dictionary, the path."""
    spark = docs.sparkSession
    bounded_batches(spark)
    coder = encoder(tokenizer)
    end, width = np.array([end_id], dtype=coder.kind).tobytes(), coder.width
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dictionary = train(sampled(docs, tokenizer, end))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coder = encoder(tokenizer)
        writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        for batch in batches:
            coded = [x + end for x in coder.encode(batch.column(2).fill_null("").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(x) // width for x in coded], pa.int64()), pa.array([writer.compress(x) for x in coded], pa.binary())], ["file", "doc_id", "n", "frame"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, before, held, size = None, 0, 0, [], 0

        def out() -> pa.RecordBatch:
            n = sum(d[1] for d in held)
            row = [[now], [shard], [len(held)], [n], [write_shard(width, before, dictionary, held)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["file", "shard", "n_docs", "n_tokens", "data"])

        for batch in batches:
            for file, *doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != now or size >= SHARD_BYTES:
                    if held:
                        yield out()
                    before, shard = (before + sum(d[1] for d in held), shard + 1) if file == now else (0, 0)
                    now, held, size = file, [], 0
                held.append(doc)
                size += len(doc[2])
        if held:
            yield out()

    files = partitions(spark)
    frames = dealt_by_id(docs, files).select("__part", "doc_id", "text").mapInArrow(tidy(compress), "file int, doc_id long, n long, frame binary")
    # n and frame after the id: equal ids have a fixed order.
    ordered = frames.repartition(files, "file").sortWithinPartitions("file", F.col("doc_id").asc_nulls_first(), "n", "frame")
    shards, path = cut(ordered.mapInArrow(tidy(collect), "file int, shard int, n_docs long, n_tokens long, data binary"), "token-ids")
    return shards, dictionary, path


def read(shards: DataFrame, dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the shards."""
    # One number a file.
    totals = dict(shards.groupBy("file").agg(F.sum("n_tokens")).collect())
    starts, total = {}, 0
    for file in sorted(totals):
        starts[file], total = total, total + totals[file]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = Shard(data, dictionary)
                at = starts[file] + s.before + np.concatenate([[0], np.cumsum(s.counts, dtype=np.int64)[:-1]]).astype(np.int64)
                ids = [d if k else None for d, k in zip(s.doc_ids.tolist(), s.known.tolist(), strict=True)]
                crc = [zlib.crc32(s.ids(i).astype("<u4").tobytes()) for i in range(len(s))]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int64()), pa.array(s.counts.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    bounded_batches(shards.sparkSession)
    return shards.select("file", "data").mapInArrow(tidy(unpack), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents and reads the files back."""
    import public_tokenizers

    shards, dictionary, _ = write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read(shards, dictionary)
