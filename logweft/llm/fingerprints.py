"""Document fingerprints: digests of improbable features.

Every window of WINDOW bytes has a collision entropy, given by the number of equal byte pairs in it. A first pass counts
how often each value occurs in the corpus; rare values rank first. A window is selected if it is the best-ranked of
POPULAR or more runs of RUN neighbouring windows. The selected windows, without repeats and in order, are hashed into a
chain of Bloom filters of BITS bits with FULL features each. Likeness compares the bits that two filters share with
those that chance would give, each filter of the shorter chain with its best match in the other.

Defined cases: null text is empty; of a text too short for a run every window of SHORT bytes is a feature, or the whole
text, so equal texts always have equal fingerprints; of windows that rank alike the first counts; a very long text has
as many filters as its features fill; two empty texts are alike (1), an empty and another are not (0). Equal ids follow
one another in the order of their texts, so repeated rows are each other's next ones; a null id comes first; a single
document is its own next one; an empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, dealt_by_id, mix, partitions, table, text_bytes, tidy

#: RUN is a power of two.
WINDOW, RUN, POPULAR, SHORT = 16, 16, 4, 4
BITS, HASHES, FULL = 2048, 5, 160
#: Values of the pair count, and bytes that are worked on at once.
VALUES, CHUNK = WINDOW * (WINDOW - 1) // 2 + 1, 1 << 21


def pair_counts(b: np.ndarray) -> np.ndarray:
    """Equal pairs of bytes in each window of b."""
    n = len(b)
    if n < WINDOW:
        return np.zeros(0, np.int32)
    after, before = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for lag in range(1, WINDOW):
        same = (b[:-lag] == b[lag:]).view(np.uint8)
        after[:-lag] += same
        before[lag:] += same
    steps = before[WINDOW:].astype(np.int32) - after[: n - WINDOW]
    return np.concatenate([[0], np.cumsum(steps)]).astype(np.int32) + int(before[:WINDOW].sum())


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about CHUNK bytes; a longer document is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def histogram(column: pa.Array) -> np.ndarray:
    """How often each pair count occurs in the windows of the texts."""
    data, offsets = text_bytes(column)
    out = np.zeros(VALUES, np.int64)
    for a, b in _slices(offsets):
        part, ends = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        counts = pair_counts(part)
        inside = np.zeros(len(part) + 1, np.int32)
        for s, e in zip(ends[:-1], ends[1:], strict=True):
            if e - s >= WINDOW:
                inside[s] += 1
                inside[e - WINDOW + 1] -= 1
        out += np.bincount(counts[np.cumsum(inside)[: len(counts)] > 0], minlength=VALUES)
    return out


def corpus_ranks(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The rank of each pair count, 0 for the rarest, over all windows of all documents. VALUES numbers, at any scale."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VALUES, np.int64)
        for batch in batches:
            total += histogram(batch.column(0))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["v", "n"])

    rows = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(tidy(run), "v int, n long").groupBy("v").agg(F.sum("n")).collect()
    counts = np.zeros(VALUES, np.int64)
    for v, n in rows:
        counts[v] = n
    ranks = np.empty(VALUES, np.int64)
    ranks[np.lexsort((np.arange(VALUES), counts))] = np.arange(VALUES)
    return ranks


def features(column: pa.Array, ranks: np.ndarray) -> list[np.ndarray]:
    """The hashes of each text's selected windows, in order."""
    data, offsets = text_bytes(column)
    out: list[np.ndarray] = []
    for a, b in _slices(offsets):
        part, ends = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        counts = pair_counts(part)
        at = np.zeros(0, np.int64)
        if len(counts) >= RUN:
            key = ranks[counts] << 40 | np.arange(len(counts))
            best, step = key, 1
            while step < RUN:
                best = np.minimum(best[:-step], best[step:])
                step *= 2
            # Runs that lie within one document.
            open_ = np.zeros(len(best) + 1, np.int32)
            for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if e - s >= WINDOW + RUN - 1:
                    open_[s] += 1
                    open_[e - WINDOW - RUN + 2] -= 1
            best = best[np.cumsum(open_)[: len(best)] > 0] & ((1 << 40) - 1)
            at = np.flatnonzero(np.bincount(best, minlength=len(counts)) >= POPULAR) if len(best) else at
        h = _window_hashes(part, at)
        cuts = np.searchsorted(at, ends)
        for i, (s, e) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            found = h[cuts[i] : cuts[i + 1]]
            if not len(found) and e > s:
                # Too short for a run: all its windows of SHORT bytes, or the whole text.
                raw = part[s:e].tobytes()
                short = dict.fromkeys(raw[i : i + SHORT] for i in range(len(raw) - SHORT + 1)) or {raw: None}
                found = np.frombuffer(b"".join(hashlib.sha256(x).digest()[:8] for x in short), "<u8")
            elif len(found) > 1:
                _, first = np.unique(found, return_index=True)
                found = found[np.sort(first)]
            out.append(found)
    return out


def _window_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    h = np.full(len(at), WINDOW, np.uint64)
    if len(at):
        eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,))
        for k in range(0, WINDOW, 8):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) ^ eight[at + k])
    return h


class Digest:
    """A chain of filters: bits as whole numbers, and how many features each holds."""

    __slots__ = ("n", "raw", "filters")

    def __init__(self, found: np.ndarray):
        self.n = len(found)
        chain = np.zeros((-(-self.n // FULL), BITS), np.uint8)
        row = np.arange(self.n) // FULL
        for k in range(HASHES):
            chain[row, (found >> np.uint64(11 * k) & np.uint64(BITS - 1)).astype(np.int64)] = 1
        self.raw = np.packbits(chain, axis=1).tobytes()
        size = BITS // 8
        self.filters = [int.from_bytes(self.raw[i : i + size]) for i in range(0, len(self.raw), size)]

    def counts(self) -> list[int]:
        return [min(FULL, self.n - i * FULL) for i in range(len(self.filters))]

    def __str__(self) -> str:
        return f"{self.n}:{base64.b64encode(self.raw).decode()}"


def likeness(a: Digest, b: Digest) -> float:
    """From 0 to 1."""
    if not a.n or not b.n:
        return float(a.n == b.n)
    if a.raw == b.raw and a.n == b.n:
        return 1.0
    if (len(a.filters), a.n) > (len(b.filters), b.n):
        a, b = b, a
    bits = [x.bit_count() for x in b.filters]
    total = 0.0
    for x, n in zip(a.filters, a.counts(), strict=True):
        ones, best = x.bit_count(), 0.0
        for y, m in zip(b.filters, bits, strict=True):
            chance = ones * m / BITS
            least = min(ones, m)
            if least > chance:
                best = max(best, ((x & y).bit_count() - chance) / (least - chance))
        total += n * best
    return total / a.n


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the beginning of the following one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs (doc_id, text) dealt by ranges of ids into parts, sorted: __part, __guard, doc_id, text. After the rows of a
    part come guards: copies of the first row of the next part. Returns the frame and the number of parts."""
    spark = docs.sparkSession
    parts = partitions(spark)
    docs = dealt_by_id(docs, parts)
    # One id a part.
    firsts = sorted((r[0], r[1]) for r in docs.groupBy("__part").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("m")).select("__part", "m.doc_id").collect())
    heads = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    heads = spark.createDataFrame(heads, "__first long, __before int")
    dealt = docs.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("__first")), "left")
    places = F.when(F.col("__before").isNull(), F.array(F.struct(F.col("__part").alias("p"), F.lit(False).alias("g")))).otherwise(
        F.array(F.struct(F.col("__part").alias("p"), F.lit(False).alias("g")), F.struct(F.col("__before").alias("p"), F.lit(True).alias("g")))
    )
    dealt = dealt.withColumn("__at", F.explode(places)).select(F.col("__at.p").alias("__part"), F.col("__at.g").alias("__guard"), "doc_id", "text")
    return dealt.repartition(parts, "__part").sortWithinPartitions("__part", "__guard", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()), parts


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and its edited text's, and how like it is to that and to the next document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ranks = corpus_ranks(docs)
    dealt, _ = with_next(docs)
    bounded_batches(spark)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def rows(run: list[tuple[int | None, str]]) -> pa.RecordBatch:
        """Of all but the last, which is only the next of the one before."""
        changed = [edited(t, u) for (_, t), (_, u) in zip(run, run[1:], strict=False)]
        own = [Digest(x) for x in features(pa.array([t for _, t in run], pa.string()), ranks)]
        new = [Digest(x) for x in features(pa.array(changed, pa.string()), ranks)]
        out = [(d, len(t), hashlib.sha256(c.encode()).hexdigest(), str(a), str(e), likeness(a, e), likeness(a, b)) for (d, t), c, a, b, e in zip(run, changed, own, own[1:], new, strict=False)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        now, size = None, 0
        for batch in batches:
            for part, guard, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                if guard:
                    # The first guard ends its part; others are repeated rows of it.
                    if held:
                        yield rows([*held, (doc, text)])
                        held, size = [], 0
                    continue
                if part != now:
                    now = part
                held.append((doc, text))
                size += len(text)
                if size > CHUNK and len(held) > 1:
                    yield rows(held)
                    held, size = held[-1:], len(text)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(tidy(run), schema)
