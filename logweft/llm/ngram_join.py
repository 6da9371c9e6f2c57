"""N-gram Jaccard join: a grouped prefix join over shingle sets.

Two sets can reach the similarity only if they share an element among the first ones of both, in any common order.
The order here puts common shingles last. Documents whose first elements and size are the same form one group; groups
that share an element become pairs if their sizes and the places of the element allow the similarity. Pairs are
expanded to their members (one for each distinct set), those whose sketches differ by more than the similarity allows
sets to differ in elements are dropped, and the others are verified on whole sets. There are two sketches: the parity
of the elements in each of 64 * WORDS bins, which takes part in the join itself, so that pairs it tells apart are never
written; and counts of the elements in bins, one for every few elements, which tell long sets apart as well.

The result is the components of the links, so pairs are verified in rounds: first every group with the next one of each
shared element; then, CHANCES times, every class with one other of each element that chance puts next to it and that is
in another component; then all pairs that are still in different components. The earlier rounds try one pair an element
and link most of what belongs together, so a large group of near copies is one component before its pairs would be
listed. Pairs inside a component can't change it. No list of an element's documents is ever built in one task: windows
over a hot element are split by size or by chance into parts of about SPLIT rows, and the last join by element is one
that adaptive execution splits.

Order: shingles found LOCAL times or more in a block of about BLOCK shingles are called common, with their counts; the
HEAVY most frequent ones are known to all tasks. It only decides the order, never the result.

Classes are told apart by 128 bits of their sets. Their numbers are given when the table of classes is written.

Defined cases: null, empty and blank texts have no shingles and link with nothing; fewer words than the width make one
shingle; rows with a null doc_id link like others, and a component without any id has a null component_id; repeated
rows are members of one class, and different texts under one id each have their own; an empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, drop, mix, partitions, release, shingle_sets, table, tidy
from .components import components

#: Words of a shingle, and the similarity in per cent.
WIDTH, PERCENT = 5, 75
BLOCK, LOCAL, HEAVY = 2_000_000, 3, 1 << 17
#: Prefix elements that a task holds before it deals them out; that it holds of one part of the hash range; and documents
#: with an element (as far as the order knows) from which on its rows are spread over all parts.
FLUSH, MEET, HOT = 400_000, 3_000_000, 1_000_000
#: 64-bit words of the parity sketch, and rows of one part of a window.
WORDS, SPLIT = 8, 10_000
#: Elements for each bin of a set's sketch, and least bins. Ids that are sent to all tasks at most.
PER_BIN, LEAST_BINS, SENT = 4, 128, 300_000
#: Rounds that try neighbours by chance.
CHANCES = 1


def _least_overlap(n: np.ndarray) -> np.ndarray:
    return -(-PERCENT * n // 100)


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles (sorted) and their counts: at most HEAVY."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            some = n >= LOCAL
            return pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(n[some].astype(np.int64))], ["h", "n"])

        for batch in batches:
            for s in shingle_sets(batch.column(0), WIDTH):
                held.append(s)
                size += len(s)
                if size >= BLOCK:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    found = docs.select("text").mapInArrow(tidy(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(HEAVY).toPandas()
    h, n = found["h"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def signature(s: np.ndarray) -> int:
    """63 bits of a set; never negative."""
    with np.errstate(over="ignore"):
        x = np.array([mix(s).sum(dtype=np.uint64) * np.uint64(3) + np.bitwise_xor.reduce(s) + np.uint64(len(s))], np.uint64)
    return int(mix(x)[0] >> np.uint64(1))


def identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set."""
    import xxhash

    x = xxhash.xxh3_128_intdigest(s.tobytes())
    return (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)


def parity(s: np.ndarray) -> np.ndarray:
    """Whether the number of elements in each of 64 * WORDS bins is odd."""
    odd = np.bincount((s >> np.uint64(40) & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def sketch(s: np.ndarray) -> bytes:
    """Elements of each bin, modulo 256. The bins are a power of two, so that a longer sketch folds into a shorter one."""
    if not len(s):
        return b""
    bins = max(LEAST_BINS, 1 << (len(s) // PER_BIN).bit_length())
    return np.bincount((s >> np.uint64(9) & np.uint64(bins - 1)).astype(np.int64), minlength=bins).astype(np.uint8).tobytes()


def unlike(x: bytes, y: bytes) -> int:
    """Elements that the sets of two sketches differ in at least."""
    u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    bins = min(len(u), len(v))
    if not bins:
        return 0
    d = u.reshape(-1, bins).sum(axis=0, dtype=np.uint8) - v.reshape(-1, bins).sum(axis=0, dtype=np.uint8)
    return int(np.minimum(d, -d).sum(dtype=np.int64))


def _prefixes(docs: DataFrame, heavy: np.ndarray, counts: np.ndarray) -> DataFrame:
    """docs (doc_id, key, text) -> rows of two kinds: documents (doc_id, key, n, c1, c2, grp, sketch, w0...), and elements
    of prefixes that two or more groups share (element, grp, n, place); of a large part of the hash range, all elements."""
    spark = docs.sparkSession
    parts = 4 * partitions(spark)
    shared = spark.sparkContext.broadcast((heavy, counts))  # at most HEAVY pairs of numbers

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, counts = shared.value
        held: list[tuple[np.ndarray, np.ndarray, int, int]] = []
        size = 0

        def dealt() -> pa.RecordBatch:
            k = np.array([len(x[0]) for x in held])
            rows = np.empty(k.sum(), dtype=_ELEMENT)
            rows["e"], rows["g"], rows["n"] = np.concatenate([x[0] for x in held]), np.repeat([x[2] for x in held], k), np.repeat([x[3] for x in held], k)
            rows["p"] = np.arange(len(rows)) - np.repeat(np.cumsum(k) - k, k)
            # Hot elements go anywhere, to parts of their own numbers that keep all their rows.
            hot = np.concatenate([x[1] for x in held])
            part = np.where(hot, parts + mix(rows["g"].view(np.uint64)) % np.uint64(parts), (rows["e"] >> np.uint64(20)) % np.uint64(parts))
            order = np.argsort(part, kind="stable")
            rows, part = rows[order], part[order]
            which, at = np.unique(part, return_index=True)
            return _blobs(which.astype(np.int64), [x.tobytes() for x in np.split(rows, at[1:])])

        for batch in batches:
            rows, sketches = np.zeros(len(batch), _DOC), []
            rows["doc"], rows["known"] = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            rows["key"] = batch.column(1).to_numpy()
            for row, s in zip(rows, shingle_sets(batch.column(2), WIDTH), strict=True):
                n = row["n"] = len(s)
                sketches.append(sketch(s))
                row["bins"] = len(sketches[-1])
                if not n:
                    continue
                row["c1"], row["c2"] = identity(s)
                row["w"] = parity(s)
                hot = np.zeros(n, bool)
                if len(heavy):
                    at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
                    often = np.where(heavy[at] == s, counts[at], 0)
                    if often.any():
                        order = np.lexsort((s, often))
                        s, hot = s[order], often[order] >= HOT
                k = n - int(_least_overlap(n)) + 1
                row["group"] = signature(np.append(s[:k], np.uint64(n)))
                held.append((s[:k], hot[:k], int(row["group"]), n))
                size += k
            if len(rows):
                yield _blobs(np.array([-1 - int(rows["doc"][0]) % parts]), [rows.tobytes() + b"".join(sketches)], [len(rows)])
            if size >= max(FLUSH, 16 * parts):
                yield dealt()
                held, size = [], 0
        if held:
            yield dealt()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The blobs of a part of the hash range come one after another. Up to MEET rows of it are held, and only elements
        # that meet go on; of a larger part everything does, and those that don't meet fall out of later joins.
        now, held, size, over = None, [], 0, False

        def out() -> pa.RecordBatch:
            rows = np.concatenate(held)
            rows = rows[np.lexsort((rows["p"], rows["n"], rows["g"], rows["e"]))]
            first = np.ones(len(rows), bool)
            first[1:] = rows[1:] != rows[:-1]
            rows = rows[first]
            if not over:
                same = (rows["e"][1:] == rows["e"][:-1]) & (rows["g"][1:] != rows["g"][:-1])
                pair = np.zeros(len(rows) + 1, bool)
                pair[1:-1] = same
                # An element that two groups have: any of its rows differs in the group from the one before.
                start = np.flatnonzero(np.concatenate([[True], rows["e"][1:] != rows["e"][:-1]])) if len(rows) else np.zeros(0, np.int64)
                rows = rows[np.repeat(np.logical_or.reduceat(pair[:-1], start), np.diff(np.append(start, len(rows))))] if len(rows) else rows
            return _row_batch(len(rows), n=rows["n"].astype(np.int64), grp=rows["g"], element=rows["e"].view(np.int64), place=rows["p"].astype(np.int32))

        for batch in batches:
            for part, count, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part < 0:
                    d = np.frombuffer(blob, _DOC, count=count)
                    ends = np.concatenate([[0], np.cumsum(d["bins"])]).astype(np.int32)
                    sketches = pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(ends), pa.py_buffer(blob[d.nbytes :])])
                    none = d["n"] == 0
                    own = {"doc_id": pa.array(d["doc"], mask=~d["known"]), "key": d["key"].copy(), "n": d["n"].copy(), "sketch": sketches}
                    yield _row_batch(count, **own, **{c: pa.array(d[f].copy(), mask=none) for c, f in (("c1", "c1"), ("c2", "c2"), ("grp", "group"))}, **{f"w{i}": d["w"][:, i].copy() for i in range(WORDS)})
                    continue
                if part == now and size >= MEET:
                    over = True
                if held and (part != now or over):
                    yield out()
                    held, size = [], 0
                if part != now:
                    now, over = part, part >= parts
                held.append(np.frombuffer(blob, dtype=_ELEMENT))
                size += len(held[-1])
        if held:
            yield out()

    dealt = docs.mapInArrow(tidy(elements), "part long, count long, blob binary").repartition(2 * partitions(spark), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(tidy(meet), _SCHEMA)


_ELEMENT = np.dtype([("e", "<u8"), ("g", "<i8"), ("n", "<u4"), ("p", "<u4")])
_DOC = np.dtype([("doc", "<i8"), ("known", "?"), ("key", "<i8"), ("n", "<i8"), ("c1", "<i8"), ("c2", "<i8"), ("group", "<i8"), ("bins", "<i4"), ("w", "<i8", (WORDS,))])
_W = [f"w{i}" for i in range(WORDS)]
_SCHEMA = "doc_id long, key long, n long, c1 long, c2 long, grp long, sketch binary, element long, place int, " + ", ".join(f"{w} long" for w in _W)


def _row_batch(count: int, **columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    """A batch of _SCHEMA; columns that aren't given are null."""
    names, kinds = zip(*(x.split() for x in _SCHEMA.split(", ")), strict=True)
    of = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([columns[n] if isinstance(columns.get(n), pa.Array) else pa.array(columns[n], of[k]) if n in columns else pa.nulls(count, of[k]) for n, k in zip(names, kinds, strict=True)], list(names))


def _blobs(parts: np.ndarray, blobs: list[bytes], counts: list[int] | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int64)), pa.array(counts or [0] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], ["part", "count", "blob"])


def _may_reach(n1: str, n2: str) -> str:
    return f"100 * least({n1}, {n2}) >= {PERCENT} * greatest({n1}, {n2})"


def _may_be_near(x: str, y: str) -> str:
    """By parity: sets of these sizes that reach the similarity differ in (100 - PERCENT) / (100 + PERCENT) of both at most."""
    unlike_ = " + ".join(f"bit_count({x}.{w} ^ {y}.{w})" for w in _W)
    return f"{100 + PERCENT} * ({unlike_}) <= {100 - PERCENT} * ({x}.n + {y}.n)"


def verified(pairs: DataFrame, docs: DataFrame, members: DataFrame) -> tuple[DataFrame, str]:
    """pairs (a, b) of classes -> those whose sets reach the similarity, and the path of the table they are read from.
    docs (doc_id, key, text); members (class, c1, c2, doc_id, key, n, sketch): a document of each class."""
    spark = docs.sparkSession
    of = lambda x: members.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x, y = (batch.column(i).to_pylist() for i in (2, 3, 4))
            keep = [(100 + PERCENT) * unlike(u, v) <= (100 - PERCENT) * k for k, u, v in zip(n, x, y, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", F.expr("n_a + n_b"), "s_a", "s_b")
    pairs, pairs_path = cut(both.mapInArrow(tidy(near), "a long, b long"), "ngram-near")
    needed = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    wanted, wanted_path = cut(members.join(needed, "class", "left_semi").select("class", "c1", "c2", "doc_id", "key"), "ngram-wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(0), WIDTH)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            both = np.array([identity(s) for s in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["c1", "c2", "items"])

    ids = wanted.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"))
    if ids.limit(SENT + 1).count() <= SENT:
        ids = F.broadcast(ids)
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left_semi").select("text")
    # Repeated rows bring their text again; a class is kept once.
    sets = texts.mapInArrow(tidy(run), "c1 long, c2 long, items array<bigint>").join(wanted.select("class", "c1", "c2"), ["c1", "c2"]).select("class", "items").dropDuplicates(["class"])
    sets, path = cut(sets, "ngram-sets")
    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("class").alias("b"), F.col("items").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    links = both.filter(100 * shared >= PERCENT * (F.size("x") + F.size("y") - shared)).select("a", "b")
    links, links_path = cut(links, "ngram-links")
    del sets, both
    drop(spark, path, pairs_path, wanted_path)
    release(spark)  # the shuffled sets
    return links, links_path


def key_of(text: str = "text") -> Column:
    """Tells different texts under one doc_id apart."""
    return F.xxhash64(F.col(text).cast("string"))


def link_components(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, key (key_of the text), n_shingles, component (a number that the rows of a component
    share; null without shingles), component_id: one row for each row of docs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), key_of().alias("key"), F.col("text").cast("string"))
    heavy, counts = _common(docs)
    rows, rows_path = cut(_prefixes(docs, heavy, counts), "ngram-rows")
    release(spark)  # the shuffled elements
    known = rows.filter("element IS NULL").select("doc_id", "key", "n", "c1", "c2", "grp", "sketch", *_W)
    # A class: documents with the same set. Its smallest id stands for it; the most common set has one row here too.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("rep")
    classes = known.filter("n > 0").groupBy("c1", "c2").agg(first, *[F.first(c).alias(c) for c in ("grp", "n", "sketch", *_W)])
    classes, classes_path = cut(classes.select(F.monotonically_increasing_id().alias("class"), "c1", "c2", "rep.doc_id", "rep.key", "grp", "n", "sketch", *_W), "ngram-classes")
    members = classes.select("class", "c1", "c2", "doc_id", "key", "n", "sketch")
    usable = classes.select("class", "grp", "n", *_W)
    shared = rows.filter("element IS NOT NULL").select("element", "grp", "n", "place")

    # Round 1: each group with the next one of an element by size, and each class with the next one of its group. Sizes
    # that lie further apart than one step of the logarithm are other parts of the window.
    leader = usable.groupBy("grp").agg(F.min("class").alias("class"))
    after = Window.partitionBy("element", F.expr(f"int(ln(n) / ln(100.0D / {PERCENT}))")).orderBy("n", "grp")
    chain = shared.select("grp", "n", F.lead("grp").over(after).alias("other"), F.lead("n").over(after).alias("other_n"))
    chain = chain.filter(f"other IS NOT NULL AND grp <> other AND {_may_reach('n', 'other_n')}").select("grp", "other").distinct()
    first = chain.join(leader.withColumnRenamed("class", "a"), "grp").join(leader.select(F.col("grp").alias("other"), F.col("class").alias("b")), "other").select("a", "b")
    inside = usable.select(F.col("class").alias("a"), F.lead("class").over(Window.partitionBy("grp", F.expr(f"class div {SPLIT}")).orderBy("class")).alias("b")).filter("b IS NOT NULL")
    tried, tried_path = cut(first.union(inside).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "ngram-first")
    links, links_path = verified(tried, docs, members)

    # Later rounds: what still lies in different components, by every shared element (or group) that joins two of them.
    root, star_path = components(links)
    root, root_path = cut(root, "ngram-root")
    drop(spark, star_path, links_path)
    old = [root_path, tried_path]
    # The overlap is at most this element and what follows it in both; it has to reach 3/7 of both sizes (for 75 %).
    rest = "least(x.n - x.place, y.n - y.place)"
    reach = f"x.root <> y.root AND {_may_reach('x.n', 'y.n')} AND {100 + PERCENT} * {rest} >= {PERCENT} * (x.n + y.n) AND {_may_be_near('x', 'y')}"
    for k in range(CHANCES + 1):
        placed = usable.join(root.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
        placed, placed_path = cut(placed, "ngram-placed")
        entries = shared.select("element", "grp", "place").join(placed, "grp").select("element", "class", "n", "place", "root")
        entries = entries.union(placed.selectExpr("grp AS element", "class", "n", "0 AS place", "root"))
        mixed = entries.groupBy("element").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).filter("lo < hi").select("element", "m")
        entries = entries.join(mixed, "element").join(placed.select("class", *_W), "class")
        entries, entries_path = cut(entries.select("element", "class", "n", "place", "root", "m", *_W), "ngram-entries")
        if k < CHANCES:
            me = F.struct("class", "n", "place", "root", *_W)
            chance = Window.partitionBy("element", F.expr(f"pmod(xxhash64(class, {k}), 1 + m div {SPLIT})")).orderBy(F.xxhash64("class", "element", F.lit(k)), "class")
            both = entries.select(me.alias("x"), F.lead(me).over(chance).alias("y")).filter("y IS NOT NULL").filter(reach)
            pairs = both.selectExpr("least(x.class, y.class) AS a", "greatest(x.class, y.class) AS b")
        else:
            x, y = entries.alias("x"), entries.alias("y")
            pairs = x.join(y, F.expr(f"x.element = y.element AND x.class < y.class AND {reach}")).selectExpr("x.class AS a", "y.class AS b")
        pairs, pairs_path = cut(pairs.distinct().join(tried, ["a", "b"], "left_anti"), f"ngram-pairs{k}")
        tried = tried.union(pairs)
        more, links_path = verified(pairs, docs, members)
        if more.limit(1).count():
            root, star_path = components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
            root, root_path = cut(root, "ngram-root")
            drop(spark, star_path)
            old.append(root_path)
        drop(spark, links_path, placed_path, entries_path)
        old.append(pairs_path)

    # From classes to documents: the smallest id of a component.
    home = classes.select("class", "c1", "c2", "doc_id").join(root.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    smallest = home.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = home.select("c1", "c2", "root").join(smallest, "root")
    out = known.select("doc_id", "key", "n", "c1", "c2").join(of_class, ["c1", "c2"], "left")
    # Without shingles a document is its own component.
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out, _ = cut(out.select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("root").alias("component"), own.alias("component_id")), "ngram-components")
    drop(spark, *old, rows_path, classes_path)
    return out


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and component."""
    return link_components(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
