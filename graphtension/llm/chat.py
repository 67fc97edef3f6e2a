"""Chat formatting: reply trees to root-to-leaf paths, ranked, each written as one conversation.

Paths come from iterative self-joins that double the reach of a message's pointer: as many rounds as the logarithm of
the longest path, however long it is. A conversation is written as one segment for each turn, in order; texts are
escaped so that no control string of a template stands in them, and can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphtension.llm.common import table
from graphtension.session import materialize

BEGIN, END = "<|im_start|>", "<|im_end|>"
#: The beginnings of templates' control strings. Their first character gets a backslash behind it.
_CONTROL = r"<(?=\||s>|/s>|<SYS>>|</SYS>>)|\[(?=/?INST\])"
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: No path is longer than two to this power.
MOST_ROUNDS = 40


def escape(c: Column) -> Column:
    """Backslashes doubled, one more inside each control string."""
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(c, _CONTROL, r"$0\\")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def paths(messages: DataFrame, keep: int | None = 1) -> DataFrame:
    """(conv, leaf, rank, node, pos) for the ``keep`` best leaves of each conversation (None: all).

    ``messages``: conv, node (unique in conv), parent, score; other columns are ignored. A message whose parent is
    missing is a root. A leaf's rank is by summed score of its path, then by its length, both descending, then by its
    id. Messages on a cycle, or below one, have no root and are in no path. An empty table gives no rows.
    """
    ids = messages.select("conv", F.col("node").alias("parent"), F.lit(True).alias("known"))
    at = messages.select("conv", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("sum"))
    at = at.join(ids, ["conv", "parent"], "left").select("conv", "node", F.when(F.col("known"), F.col("parent")).alias("up"), "sum", F.lit(1).cast("bigint").alias("len"))
    at = materialize(at, "tree")
    first = at
    steps = []
    before = None
    for _ in range(MOST_ROUNDS):
        # a round that takes nobody to a root: who is left is on a cycle or below one
        going = at.filter("up is not null").count()
        if going in (0, before):
            break
        before = going
        steps.append(at.select("conv", F.col("node").alias("from"), "up").filter("up is not null"))
        over = at.select("conv", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("sum").alias("s2"), F.col("len").alias("l2"))
        # only messages that don't point past their root yet are joined
        moved = at.filter("up is not null").join(over, ["conv", "up"]).select("conv", "node", F.col("up2").alias("up"), (F.col("sum") + F.col("s2")).alias("sum"), (F.col("len") + F.col("l2")).alias("len"))
        at = materialize(moved.unionByName(at.filter("up is null")), "tree")
    parents = first.filter("up is not null").select("conv", F.col("up").alias("node")).distinct()
    leaves = at.filter("up is null").join(parents, ["conv", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("sum"), F.desc("len"), "node"))
    leaves = leaves.select("conv", F.col("node").alias("leaf"), rank.alias("rank"), "len")
    if keep is not None:
        leaves = leaves.filter(F.col("rank") <= keep)
    walk = leaves.select("conv", "leaf", "rank", "len", F.col("leaf").alias("node"), F.lit(0).cast("bigint").alias("back"))
    for k in reversed(range(len(steps))):
        step = walk.join(steps[k].withColumnRenamed("from", "node"), ["conv", "node"]).select("conv", "leaf", "rank", "len", F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        walk = walk.unionByName(step)
        if k % 3 == 0:
            walk = materialize(walk, "paths")
    return walk.select("conv", "leaf", "rank", "node", (F.col("len") - F.col("back") - 1).alias("pos"))


def one_each(messages: DataFrame) -> DataFrame:
    """Of rows that repeat (conv, node) the one that comes first by parent, score, role and text; the five columns
    and these two alone."""
    rest = ["parent", "score", "role", "text"]
    return messages.groupBy("conv", "node").agg(F.min(F.struct(*rest)).alias("x")).select("conv", "node", *[f"x.{c}" for c in rest])


def segments(messages: DataFrame, keep: int | None = 1, unique: bool = False) -> DataFrame:
    """(conv, rank, pos, segment, loss_start, loss_end): each chosen path, a row for each turn.

    ``messages``: conv, node, parent, score, role, text. A conversation is its segments in order, joined by nothing.
    The loss mask covers the characters loss_start to loss_end of an assistant's segment, none of the others.
    Null roles and texts are empty. Rows that repeat (conv, node) count once, as one_each() has it, unless ``unique``
    says that there are none. Other columns are ignored. An empty table gives no rows.
    """
    messages = messages if unique else materialize(one_each(messages), "messages")
    p = paths(messages.select("conv", "node", "parent", "score"), keep)
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    texts = messages.select("conv", "node", F.coalesce("role", F.lit("")).alias("role"), role.alias("shown"), escape(F.col("text")).alias("body"))
    head = F.concat(F.lit(BEGIN), F.col("shown"), F.lit("\n"))
    start, size = F.length(head), F.length("body")
    mine = F.col("role") == "assistant"
    rows = p.join(texts, ["conv", "node"])
    return rows.select("conv", "rank", "pos", F.concat(head, F.col("body"), F.lit(END + "\n")).alias("segment"), F.when(mine, start).otherwise(0).alias("loss_start"), F.when(mine, start + size).otherwise(0).alias("loss_end"))


def conversations(segs: DataFrame) -> DataFrame:
    """(conv, rank, formatted): whole texts, for conversations known to be of ordinary length."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("pos", "segment"))), lambda x: x.segment)
    return segs.groupBy("conv", "rank").agg(F.array_join(parts, "").alias("formatted"))


def read_turn(segment: str) -> tuple[str, str]:
    """Role and text of a written turn."""
    if not (segment.startswith(BEGIN) and segment.endswith(END + "\n")):
        raise ValueError("not a turn")
    inner, i = segment[len(BEGIN) : -len(END) - 1], 0
    while inner[i] != "\n":
        i += 2 if inner[i] == "\\" else 1
    return unescape(inner[:i]), unescape(inner[i + 1 :])


def digests(segs: DataFrame) -> DataFrame:
    """What reading back the segments gives: (conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    Rows are sorted by conversation and place and pass through in batches, so a conversation of any length takes no
    memory; its hash runs in one task, as a hash of one long text must.
    """
    schema = pa.schema([("conv", pa.int64()), ("rank", pa.int32()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []
        for batch in batches:
            for conv, rank, seg, a, b in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (conv, rank) != key:
                    if state:
                        done.append((*key, *_close(state)))
                    key, state = (conv, rank), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_turn(seg)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if b > a:
                    said = unescape(seg[a:b])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(seg)
            if done:
                yield _batch(done, schema)
                done = []
        if state:
            yield _batch([(*key, *_close(state))], schema)

    rows = segs.select("conv", "rank", "segment", "loss_start", "loss_end", "pos").repartition("conv", "rank").sortWithinPartitions("conv", "rank", "pos")
    return rows.mapInArrow(run, "conv bigint, rank int, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _close(s: list) -> tuple:
    return s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def chain(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a tree without branches: each turn answers the one before it.

    Ties in ``turn`` go by role and text. Rows without a conv_id are one conversation, under ``none_of(rows)``.
    """
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    out = rows.select(F.coalesce(F.col("conv_id").cast("bigint"), F.lit(none_of(rows))).alias("conv"), "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("bigint"))
    return out.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def none_of(rows: DataFrame) -> int:
    """A number that is no conv_id of ``rows``."""
    low, high = rows.agg(F.min(F.col("conv_id").cast("bigint")), F.max(F.col("conv_id").cast("bigint"))).first()
    return -(2**63) if low is None or low > -(2**63) else high + 1 if high < 2**63 - 1 else next(n for n in range(-(2**63) + 1, 2**63) if rows.filter(F.col("conv_id") == n).isEmpty())


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = digests(segments(materialize(chain(rows), "messages"), unique=True))
    return out.select(F.when(F.col("conv") != none_of(rows), F.col("conv")).alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
