"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces and their scores come from a model file, as they are, for tokenizers are never trained here. In a unigram model
they are log probabilities; the one file at hand holds merge ranks, which the recursion adds up in the same way. Byte
pieces stand for what no piece covers, and spaces are the marker U+2581 with one put in front. The best segmentation of a word doesn't depend on other words when no piece goes past a
marker, so each distinct word of a batch is segmented once: all their positions walk the trie together, and the
Viterbi recursion runs over all words at once, by position. Ties go to the longer last piece.

Decoding turns markers back to spaces, bytes to UTF-8, and drops the marker in front. A U+2581 of the text itself is
encoded by its bytes, so decoding always gives the text back.

Defined cases: null and empty texts have no pieces and decode to the empty text; lone surrogates can't occur in Arrow
texts; texts of one very long word are segmented whole; repeated rows are treated alike; an empty table gives an empty
one; extra columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, extended, free, table, tidy

MARK = "▁"
_MARK_BYTES = MARK.encode()
#: How much worse than the worst piece a character without a piece is.
UNKNOWN = 10.0
#: Bytes of the words whose pieces a worker remembers, of the longest such word, and of those segmented at once.
REMEMBER, LONG, AT_ONCE = 24 << 20, 64, 128 << 10
#: Places that the trie's builder tries before it goes to the end.
TRIES = 40


@dataclass
class Vocabulary:
    """Double-array trie over the UTF-8 of the pieces. A child by byte c of state s is base[s] + c + 1, if its check is s."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray  # of a state, or -1
    scores: np.ndarray  # of a piece
    spelled: list[bytes]  # what a piece decodes to
    bytes_: np.ndarray  # the piece of each byte, or -1
    unknown: int
    apart: bool  # no piece goes past a marker after another character
    line: bool  # no piece holds a line end beside other characters

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a SentencePiece model file."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(m.id_to_piece(i), m.get_score(i), "byte" if m.is_byte(i) else "other" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "text") for i in range(m.get_piece_size())]
        return cls.build(pieces, m.unk_id())

    @classmethod
    def build(cls, pieces: list[tuple[str, float, str]], unknown: int) -> Vocabulary:
        """pieces: (text, log score, kind: text, byte as <0x41>, or other)."""
        byte_ids = np.full(256, -1, np.int64)
        keys, spelled = [], []
        for i, (text, _, kind) in enumerate(pieces):
            if kind == "byte":
                byte_ids[int(text[3:5], 16)] = i
                spelled.append(bytes([int(text[3:5], 16)]))
            else:
                spelled.append(text.replace(MARK, " ").encode() if kind == "text" else b"")
            if kind == "text" and text:
                keys.append((text.encode(), i))
        base, check, piece = _double_array(sorted(keys))
        texts = [t for t, _, kind in pieces if kind == "text"]
        return cls(base, check, piece, np.array([s for _, s, _ in pieces]), spelled, byte_ids, unknown, not any(MARK in t.lstrip(MARK) for t in texts), not any("\n" in t and t != "\n" for t in texts))


def _double_array(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    children: list[dict[int, int]] = [{}]
    value = [-1]
    for key, i in keys:
        at = 0
        for c in key:
            nxt = children[at].get(c)
            if nxt is None:
                nxt = children[at][c] = len(children)
                children.append({})
                value.append(-1)
            at = nxt
        if value[at] < 0:
            value[at] = i
    size = 2 * len(children) + 1024
    base, check, piece = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    used = bytearray(size)
    used[0] = 1
    free, tail, todo = 1, 1, [(0, 0)]
    while todo:
        node, slot = todo.pop()
        piece[slot] = value[node]
        codes = sorted(children[node])
        if not codes:
            continue
        while free < len(used) and used[free]:
            free += 1
        b = max(0, free - codes[0] - 1)
        # The first gap that fits, or after a few tries the end.
        for tries in range(TRIES):
            if not any(b + c + 1 < len(used) and used[b + c + 1] for c in codes):
                break
            b = b + 1 if tries < TRIES - 2 else max(0, tail - codes[0])
        tail = max(tail, b + codes[-1] + 1)
        top = b + 258
        if top > len(base):
            grow = max(top, len(base) * 2) - len(base)
            base, check, piece = np.pad(base, (0, grow)), np.pad(check, (0, grow), constant_values=-1), np.pad(piece, (0, grow), constant_values=-1)
            used.extend(bytes(grow))
        base[slot] = b
        for c in codes:
            used[b + c + 1] = 1
            check[b + c + 1] = slot
            todo.append((children[node][c], b + c + 1))
    return np.pad(base, (0, 258)), np.pad(check, (0, 258), constant_values=-1), np.pad(piece, (0, 258), constant_values=-1)


def segment(words: list[bytes], v: Vocabulary) -> list[np.ndarray]:
    """The piece ids of each word's best segmentation."""
    if not words:
        return []
    size = np.array([len(w) for w in words])
    data = np.frombuffer(b"".join(words) + b"\0", np.uint8).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    word = np.repeat(np.arange(len(words)), size)
    local = np.arange(len(word)) - first[word]
    end = first[word + 1]
    # A character starts where no continuation byte stands.
    starts = np.flatnonzero((data[:-1] & 0xC0) != 0x80)
    state, src, ends, ids = np.zeros(len(starts), np.int64), [], [], []
    live, depth = starts, 0
    while len(live):
        to = v.base[state] + data[live + depth] + 1
        ok = v.check[to] == state
        live, state = live[ok], to[ok]
        depth += 1
        hit = v.piece[state] >= 0
        src.append(live[hit])
        ends.append(live[hit] + depth)
        ids.append(v.piece[state[hit]])
        more = live + depth < end[live]
        live, state = live[more], state[more]
    # Characters that no piece covers alone, by their bytes.
    lead = data[starts]
    width = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
    known = np.zeros(len(word) + 1, bool)
    every_src, every_end = np.concatenate(src), np.concatenate(ends)
    char_end = np.zeros(len(word) + 1, np.int64)
    char_end[starts] = np.minimum(starts + width, end[starts])
    known[every_src[every_end == char_end[every_src]]] = True
    lost = starts[~known[starts]]
    src = np.concatenate([every_src, lost])
    dst = np.concatenate([every_end, char_end[lost]])
    ids = np.concatenate([*ids, np.full(len(lost), -1)])
    price = np.where(ids >= 0, v.scores[ids], v.scores.min() - UNKNOWN if len(v.scores) else -UNKNOWN)
    # Nodes: one more than bytes for each word. Edges by place of their end in the word, then end, then start.
    node_src, node_dst = src + word[src], dst + word[src]
    reach = dst - first[word[src]]
    order = np.lexsort((node_src, node_dst, reach))
    node_src, node_dst, ids, price, reach = node_src[order], node_dst[order], ids[order], price[order], reach[order]
    best = np.full(first[-1] + len(words), -np.inf)
    best[first[:-1] + np.arange(len(words))] = 0.0
    back, via = np.zeros(len(best), np.int64), np.zeros(len(best), np.int64)
    group = np.flatnonzero(np.concatenate([[True], node_dst[1:] != node_dst[:-1]])) if len(node_dst) else np.zeros(0, np.int64)
    level = reach[group]
    cuts = np.flatnonzero(np.concatenate([[True], level[1:] != level[:-1]])).tolist() + [len(group)] if len(group) else [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        lo = group[a]
        hi = group[b] if b < len(group) else len(node_dst)
        total = best[node_src[lo:hi]] + price[lo:hi]
        at = group[a:b] - lo
        top = np.maximum.reduceat(total, at)
        count = np.diff(np.append(at, hi - lo))
        winner = np.flatnonzero(total == np.repeat(top, count))
        which = np.repeat(np.arange(b - a), count)[winner]
        lead_of = np.unique(which, return_index=True)[1]
        chosen = winner[lead_of] + lo
        best[node_dst[chosen]] = top
        back[node_dst[chosen]], via[node_dst[chosen]] = node_src[chosen], ids[chosen]
    # From the ends back, one piece of every word a step.
    node_word = np.repeat(np.arange(len(words)), size + 1)
    now = first[1:] + np.arange(len(words))
    now = now[size > 0]
    taken_word, taken_id, taken_from = [], [], []
    start_node = first[:-1] + np.arange(len(words))
    while len(now):
        w = node_word[now]
        taken_word.append(w)
        taken_id.append(via[now])
        taken_from.append(back[now])
        now = back[now]
        now = now[now > start_node[node_word[now]]]
    if not taken_word:
        return [np.zeros(0, np.int64) for _ in words]
    w, i, f = np.concatenate(taken_word), np.concatenate(taken_id), np.concatenate(taken_from)
    order = np.lexsort((f, w))
    w, i, f = w[order], i[order], f[order]
    if (i < 0).any():
        # The bytes of each lost character.
        at = f - node_word[f]
        n = np.where(i < 0, char_end[at] - at, 1)
        rep = np.repeat(np.arange(len(i)), n)
        inner = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
        spelled = v.bytes_[data[at[rep] + inner]]
        i = np.where(i[rep] < 0, np.where(spelled >= 0, spelled, v.unknown), i[rep])
        w = w[rep]
    return np.split(i, np.searchsorted(w, np.arange(1, len(words))))


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.kind = "<u2" if len(vocabulary.spelled) <= 1 << 16 else "<u4"
        self.known: dict[str, bytes] = {}
        self.held = 0
        line = "\n" if vocabulary.line else ""
        self.words = re.compile(f"{MARK}*[^{MARK}{line}]+|{MARK}+" + (f"|{MARK}*{line}" if line else "")) if vocabulary.apart else re.compile(".+", re.S)
        self.mark_ids = vocabulary.bytes_[list(_MARK_BYTES)].astype(self.kind).tobytes()

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        split: list[list[list[str]]] = []
        for t in texts:
            t = t or ""
            parts = t.split(MARK) if MARK in t else [t]
            split.append([self.words.findall((MARK if k == 0 else "") + p.replace(" ", MARK)) for k, p in enumerate(parts)] if t else [])
        if self.held > REMEMBER:
            self.known, self.held = {}, 0
        known, rare = self.known, {}
        some, size = [], 0
        for w in {w for parts in split for ws in parts for w in ws if w not in known}:
            some.append(w)
            size += len(w)
            if size > AT_ONCE:
                self._learn(some, rare)
                some, size = [], 0
        self._learn(some, rare)
        look = (lambda w: rare[w] if w in rare else known[w]) if rare else known.__getitem__
        return [np.frombuffer(self.mark_ids.join(b"".join(map(look, ws)) for ws in parts), self.kind) for parts in split]

    def _learn(self, words: list[str], rare: dict[str, bytes]) -> None:
        """Segment words; very long ones are not remembered beyond the batch."""
        for w, ids in zip(words, segment([w.encode() for w in words], self.v), strict=True):
            if len(w) > LONG:
                rare[w] = ids.astype(self.kind).tobytes()
            else:
                self.known[w] = ids.astype(self.kind).tobytes()
                self.held += 200 + 2 * len(w)

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.v.spelled.__getitem__, ids.tolist()))
        return raw[1 if raw[:1] == b" " else 0 :].decode("utf-8", errors="replace")


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "piece_ids", decoded: str | None = "decoded", lossless: str | None = None) -> DataFrame:
    """docs with the piece ids of the text; the text that they decode to, and whether that is the text (null: empty),
    where a name is given for it. A name that docs has already gets a number behind it."""
    spark = docs.sparkSession
    bounded_batches(spark)
    names: list[str] = []
    for n in (ids, decoded, lossless):
        names.append(n and free(n, [*docs.columns, *filter(None, names)]))
    ids, decoded, lossless = names
    schema = extended(docs, (ids, "array<int>"), *[(decoded, "string")] * bool(decoded), *[(lossless, "boolean")] * bool(lossless))
    place = docs.columns.index(text)
    shared = spark.sparkContext.broadcast(vocabulary)  # a fixed file, some MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            texts = batch.column(place).cast(pa.string()).fill_null("").to_pylist()
            coded = codec.encode_batch(texts)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in coded])]).astype(np.int32)
            flat = np.concatenate(coded).astype(np.int32) if coded else np.zeros(0, np.int32)
            columns = [*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            if decoded or lossless:
                back = [codec.decode(x) for x in coded]
                if decoded:
                    columns.append(pa.array(back, pa.string()))
                if lossless:
                    columns.append(pa.array([x == y for x, y in zip(texts, back, strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(tidy(run), schema)


def default_vocabulary() -> Vocabulary:
    import public_tokenizers

    return Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, by number and crc32 (ids as little-endian 32-bit integers), and what they decode to."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(default_vocabulary())
    names = ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "lossless"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            coded = codec.encode_batch(texts)
            back = [codec.decode(x) for x in coded]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in coded], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in coded], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                    pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
                ],
                names,
            )

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(tidy(run), "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean")
