"""Chat formatting of reply trees.

Rows are messages with a parent. Iterative self-joins with doubled steps find the root and depth of every message in
as many rounds as the depth has binary digits; so every leaf names a root-to-leaf path. The paths of a tree are ranked
(score, then depth, then id), the chosen leaves climb to their root by the same kind of join, and each chosen path is
formatted as one conversation.

The template marks a turn as "### Role:\\n", text, "</turn>\\n". Inside roles and texts a backslash is doubled and one
is put into every control string, so parsing gives back exactly what went in. The loss mask covers assistant texts.

The output is one row a turn: its formatted segment and the span under the mask, in code points of the segment. The
segments of a conversation, in order, are the conversation; so no row and no task must hold a whole one.

Defined cases: null roles and texts are empty; rows of a linear conversation are ordered by turn (null first), role
and text, so ties and repeated rows are kept, each as a turn; of a tree's messages with one id, the one with the least
parent, score, role and text counts (null first); an empty table gives no rows; a parent that doesn't exist makes a
root; parents that form a cycle are a ValueError; equal scores are ranked by depth, then by id; extra columns are
ignored. A conversation's digest is one running hash, so one task reads its segments, one batch at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, drop, partitions, table, tidy

# The template's control strings.
HEAD, HEAD_END, END = "### ", ":\n", "</turn>\n"
ASSISTANT = "assistant"
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: Column, role: bool = False) -> Column:
    """A backslash before every backslash, and into every control string."""
    text = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("###"), F.lit("\\###")), F.lit("</turn>"), F.lit("\\</turn>"))
    return F.replace(text, F.lit(":"), F.lit("\\:")) if role else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(segment: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    out, at = [], 0
    while at < len(segment):
        # The parts are scanned by hand for the first control string that no backslash precedes: texts may be very long.
        if not segment.startswith(HEAD, at):
            raise ValueError(f"no turn starts at {at}")
        a = _find(segment, HEAD_END, at + len(HEAD))
        b = _find(segment, END, a + len(HEAD_END))
        out.append((unescape(segment[at + len(HEAD) : a]), unescape(segment[a + len(HEAD_END) : b])))
        at = b + len(END)
    return out


def _find(text: str, mark: str, at: int) -> int:
    while (at := text.find(mark, at)) >= 0:
        k = at
        while k and text[k - 1] == "\\":
            k -= 1
        if (at - k) % 2 == 0:
            return at
        at += 1
    raise ValueError(f"no {mark!r}")


def linear(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees without branches: adds __id, __parent (place in the conversation), __score."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    numbered = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(order).cast("long").alias("__id"))
    return numbered.withColumn("__parent", F.when(F.col("__id") > 1, F.col("__id") - 1)).withColumn("__score", F.lit(0.0))


def _key(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def unique(nodes: DataFrame) -> DataFrame:
    """Of messages with one id the least."""
    one = F.min(F.struct("__parent", "__score", "role", "text"))
    return nodes.groupBy("conv_id", "__id").agg(one.alias("__one")).select("conv_id", "__id", "__one.*")


def best_paths(nodes: DataFrame, keep: int = 1) -> tuple[DataFrame, str]:
    """nodes (conv_id, __id, __parent, __score), each id once -> the nodes on the `keep` best root-to-leaf paths of each
    tree: conv_id, __id, __path (rank from 1), __depth (0 at the root); and the path of the table that it is read from.
    A path's score is the sum of its messages' scores."""
    spark, paths = nodes.sparkSession, []

    def kept(df: DataFrame) -> DataFrame:
        df, path = cut(df, "chat-paths")
        paths.append(path)
        return df

    base = nodes.select("conv_id", "__id", "__parent", F.coalesce("__score", F.lit(0.0)).alias("__score"))
    known = base.select(F.col("conv_id").alias("__c"), F.col("__id").alias("__p"))
    # A parent that doesn't exist makes a root.
    base = base.join(known, _key("conv_id", "__c") & (F.col("__parent") == F.col("__p")), "left").select("conv_id", "__id", F.col("__p").alias("__up"), "__score")
    # __up: the ancestor 2^k steps up; __depth, __sum: over what lies between, itself included.
    depth = F.when(F.col("__up").isNotNull(), 1).otherwise(0).cast("long")
    climbing = kept(base.select("conv_id", "__id", "__up", depth.alias("__depth"), F.col("__score").alias("__sum"), F.col("__up").alias("__first")))
    most = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    rounds, arrived = 0, climbing.filter("__up IS NULL")
    # Only messages that haven't reached their root go on and are written again.
    while (climbing := climbing.filter("__up IS NOT NULL")).limit(1).count():
        if 1 << rounds > most:
            drop(spark, *paths)
            raise ValueError("the parents form a cycle")
        rounds += 1
        above = arrived.union(climbing).select(F.col("conv_id").alias("__c"), F.col("__id").alias("__i"), F.col("__up").alias("__u2"), F.col("__depth").alias("__d2"), F.col("__sum").alias("__s2"))
        climbing = kept(
            climbing.join(above, _key("conv_id", "__c") & (F.col("__up") == F.col("__i"))).select(
                "conv_id", "__id", F.col("__u2").alias("__up"), (F.col("__depth") + F.col("__d2")).alias("__depth"), (F.col("__sum") + F.col("__s2")).alias("__sum"), "__first"
            )
        )
        arrived = arrived.union(climbing.filter("__up IS NULL"))
    reach = arrived
    parents = reach.filter("__first IS NOT NULL").select(F.col("conv_id").alias("__c"), F.col("__first").alias("__f")).distinct()
    leaves = reach.join(parents, _key("conv_id", "__c") & (F.col("__id") == F.col("__f")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("__sum"), F.desc("__depth"), F.asc("__id")))
    best = leaves.withColumn("__path", rank).filter(F.col("__path") <= keep).select("conv_id", "__id", "__path")
    # A message is on a chosen path if the chosen leaf is below it: marks climb 1, 2, 4, ... steps.
    marks, step = kept(best), reach.select("conv_id", "__id", F.col("__first").alias("__up"))
    for _ in range(rounds + 1):
        hop = step.select(F.col("conv_id").alias("__c"), F.col("__id").alias("__i"), "__up").filter("__up IS NOT NULL")
        climbed = marks.join(hop, _key("conv_id", "__c") & (F.col("__id") == F.col("__i"))).select("conv_id", F.col("__up").alias("__id"), "__path")
        marks = kept(marks.union(climbed).distinct())
        above = hop.select(F.col("__c").alias("__c2"), F.col("__i").alias("__i2"), F.col("__up").alias("__u2"))
        step = kept(hop.join(above, _key("__c", "__c2") & (F.col("__up") == F.col("__i2"))).select(F.col("__c").alias("conv_id"), F.col("__i").alias("__id"), F.col("__u2").alias("__up")))
    depth = reach.select(F.col("conv_id").alias("__c"), F.col("__id").alias("__i"), "__depth")
    out = marks.join(depth, _key("conv_id", "__c") & (F.col("__id") == F.col("__i"))).select("conv_id", "__id", "__path", "__depth")
    out, last = cut(out, "chat-chosen")
    drop(spark, *paths)
    return out, last


def format_turns(nodes: DataFrame, keep: int = 1) -> tuple[DataFrame, str]:
    """nodes (conv_id, __id, __parent, __score, role, text), each id once -> conv_id, path, seq, segment, loss_start,
    loss_end; and the path of a table that it is read from, for drop()."""
    chosen, chosen_path = best_paths(nodes, keep)
    chosen = chosen.select(F.col("conv_id").alias("__c"), F.col("__id").alias("__i"), "__path", "__depth")
    text = nodes.join(chosen, _key("conv_id", "__c") & (F.col("__id") == F.col("__i")))
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(HEAD), escape(role, role=True), F.lit(HEAD_END))
    body = escape(F.coalesce("text", F.lit("")))
    masked = role == ASSISTANT
    return text.select(
        "conv_id", F.col("__path").alias("path"), F.col("__depth").alias("seq"), F.concat(head, body, F.lit(END)).alias("segment"),
        F.when(masked, F.length(head)).alias("loss_start"), F.when(masked, F.length(head) + F.length(body)).alias("loss_end"),
    ), chosen_path


def digest(formatted: DataFrame) -> DataFrame:
    """What a reader finds in the formatted conversations, segment by segment in order."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None

        def row() -> list:
            return [now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        for batch in batches:
            rows = []
            for conv, path, segment, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "path", "segment", "loss_start", "loss_end")), strict=True):
                if (conv, path) != now:
                    if state:
                        rows.append(row())
                    now, state = (conv, path), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(segment):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if a is not None:
                    loss = unescape(segment[a:b])
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += len(segment)
            yield _batch(rows)
        if state:
            yield _batch([row()])

    def _batch(rows: list[list]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    spark = formatted.sparkSession
    bounded_batches(spark)
    ordered = formatted.select("conv_id", "path", "seq", "segment", "loss_start", "loss_end").repartition(partitions(spark), "conv_id", "path").sortWithinPartitions("conv_id", "path", "seq")
    return ordered.mapInArrow(tidy(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


# The conversation that the contract adds.
EXTRA_ID, EXTRA_TEXT = -7, "\\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and one of control strings, writes them, and reads them back."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(2).select(F.lit(EXTRA_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(EXTRA_TEXT).alias("text"))
    nodes, path = cut(linear(rows.unionByName(extra)), "chat-nodes")
    formatted, chosen = format_turns(nodes)
    written, _ = cut(formatted, "chat-formatted")
    drop(spark, path, chosen)
    return digest(written)


_SQL_ESCAPE = r"replace(replace(replace({0}, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')"
SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {EXTRA_ID}, turn, role, '{EXTRA_TEXT}' FROM (VALUES (0, 'user'), (1, '{ASSISTANT}')) v(turn, role))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = '{ASSISTANT}' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = '{ASSISTANT}' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum({len(HEAD) + len(HEAD_END) + len(END)} + length(replace({_SQL_ESCAPE.format("role")}, ':', '\:')) + length({_SQL_ESCAPE.format("text")}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
