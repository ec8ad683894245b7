"""Chat formatting of reply trees.

Messages name their parent.  Self-joins that double the distance each round
find every message's distance to its root and the score of that path; the best
leaves of a conversation are chosen, the same jump tables walk back from them,
and each path is written as one conversation, one row per turn in order.

A turn is written `### Role: text </turn>` and a line end.  Within texts (and
roles) a backslash goes before each backslash, before a number sign that two
more follow, and before the `<` of an end mark, so no text can forge a turn
and every text is read back as it was.  The loss mask marks the characters of
assistant texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.storage import shared_dir

# The template's names of common roles; other roles stand behind a tilde.
ROLES = {"user": "User", "assistant": "Assistant", "system": "System"}
LEARNED = "assistant"
_NAMES = {v: k for k, v in ROLES.items()}
_ESCAPE = r"(\\|#(?=##)|<(?=/turn>))"
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*) </turn>\n", re.DOTALL)
_BACK = re.compile(r"\\(.)", re.DOTALL)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def parse(piece: str) -> tuple[str, str]:
    """Role and text of one written turn."""
    m = _TURN.fullmatch(piece)
    if not m:
        raise ValueError("not a written turn")
    name = m[1]
    return unescape(name[1:]) if name.startswith("~") else _NAMES[name], unescape(m[2])


def chosen_paths(messages: DataFrame, branches: int = 1, rounds: int = 40) -> DataFrame:
    """conv, branch (from 1), position (from 0) and node of the best root-to-leaf paths.

    `messages` has conv, node, parent and score.  A parent that isn't in the
    conversation counts as none.  Paths rank by the sum of their scores, ties
    by the smaller leaf.  Messages that are their own ancestors have no root
    and take no part.  Of rows that repeat a message the one with the least
    parent (null first), then the least score, counts; a null node is no
    message, and a null conv no conversation.
    """
    spark = messages.sparkSession
    folder = shared_dir(spark, "reply-trees")
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")
    nodes = messages.filter("conv is not null and node is not null").groupBy("conv", "node").agg(F.min(F.struct("parent", score)).alias("_m")).select("conv", "node", "_m.parent", "_m.score")
    there = nodes.select("conv", F.col("node").alias("parent"), F.col("node").alias("hop"))
    linked = nodes.join(there, ["conv", "parent"], "left")
    jump = linked.select("conv", "node", "hop", F.lit(1).cast("long").alias("turns"), F.col("score").alias("total"))
    # Messages that have met their root lie apart, so that each round reads of the earlier ones these alone.
    schema = jump.withColumns({"level": F.lit(0), "rooted": F.lit(True)}).schema
    read = lambda: spark.read.schema(schema).parquet(f"{folder}/jump")
    levels, before = [], None
    for k in range(rounds):
        jump.withColumn("rooted", F.col("hop").isNull()).write.partitionBy("rooted").parquet(f"{folder}/jump/level={k}")
        jump = read().filter(F.col("level") == k)
        levels.append(jump)
        todo = jump.filter("not rooted")
        left = todo.count()
        if left == 0 or left == before:  # none, or only those of circles
            break
        before = left
        # Only messages that haven't met their root go on; those that have are still met by others.
        met = read().filter(F.col("rooted") | (F.col("level") == k))
        on = met.select("conv", F.col("node").alias("hop"), F.col("hop").alias("_hop"), F.col("turns").alias("_turns"), F.col("total").alias("_total"))
        jump = todo.join(on, ["conv", "hop"]).select("conv", "node", F.col("_hop").alias("hop"), (F.col("turns") + F.col("_turns")).alias("turns"), (F.col("total") + F.col("_total")).alias("total"))
    rooted = read().filter("rooted")
    parents = nodes.select("conv", F.col("parent").alias("node")).filter("node is not null").distinct()
    best = Window.partitionBy("conv").orderBy(F.col("total").desc(), "node")
    path = rooted.join(parents, ["conv", "node"], "left_anti").withColumn("branch", F.row_number().over(best)).filter(F.col("branch") <= branches).select("conv", "branch", "node", "turns", F.lit(0).cast("long").alias("back"))
    # Each step adds the ancestors at the next power of two and is written, so plans stay small.
    path.write.parquet(f"{folder}/path/0")
    schema = path.schema
    for k, level in enumerate(levels[:-1]):
        path = spark.read.schema(schema).parquet(*(f"{folder}/path/{i}" for i in range(k + 1)))
        above = path.join(level.filter("not rooted").select("conv", "node", "hop"), ["conv", "node"]).select("conv", "branch", F.col("hop").alias("node"), "turns", (F.col("back") + (1 << k)).alias("back"))
        above.select(*schema.fieldNames()).write.parquet(f"{folder}/path/{k + 1}")
    path = spark.read.schema(schema).parquet(*(f"{folder}/path/{i}" for i in range(len(levels))))
    return path.select("conv", "branch", (F.col("turns") - 1 - F.col("back")).alias("position"), "node")


def write_turns(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """conv, branch, position, piece and loss mask (loss_from, loss_to: characters of the piece, -1 for none) of each chosen turn."""
    escaped = lambda c: F.regexp_replace(c, _ESCAPE, r"\\$1")
    role = F.coalesce("role", F.lit(""))
    name = F.concat(F.lit("~"), F.regexp_replace(escaped(role), ":", r"\\:"))
    for known, shown in ROLES.items():
        name = F.when(role == known, shown).otherwise(name)
    head = F.concat(F.lit("### "), name, F.lit(": "))
    body = escaped(F.coalesce("text", F.lit("")))
    learned = role == LEARNED
    start = F.length(head)
    turns = paths.join(messages.select("conv", "node", "role", "text"), ["conv", "node"])
    return turns.select("conv", "branch", "position", F.concat(head, body, F.lit(" </turn>\n")).alias("piece"), F.when(learned, start).otherwise(-1).alias("loss_from"), F.when(learned, start + F.length(body)).otherwise(-1).alias("loss_to"))


def by_turn(conversations: DataFrame) -> DataFrame:
    """Rows of plain conversations as messages: each one's parent is the row before it.

    Rows of one conversation are ordered by turn (null first), then role and
    text, so rows that repeat a turn have a defined order; a null conv_id is a
    conversation of its own.
    """
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(-(1 << 63))).alias("conv"), F.col("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    numbered = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def format_trees(messages: DataFrame, folder: str, branches: int = 1, unique: bool = False) -> None:
    """Write the best paths of each conversation, in order, as Parquet.

    Of rows that repeat a message one counts, the least by parent, score, role
    and text; `unique` says that there are none.
    """
    spark = messages.sparkSession
    if not unique:
        one = F.min(F.struct("parent", "score", "role", "text")).alias("_m")
        messages = messages.filter("conv is not null and node is not null").groupBy("conv", "node").agg(one).select("conv", "node", "_m.*")
    messages.write.parquet(f"{folder}/messages")
    staged = spark.read.parquet(f"{folder}/messages")
    turns = write_turns(staged, chosen_paths(staged, branches))
    turns.repartition("conv", "branch").sortWithinPartitions("conv", "branch", "position").write.parquet(f"{folder}/formatted")


DIGEST = "conv long, branch int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_digests(spark, folder: str) -> DataFrame:
    """One row per written conversation, from its pieces in order; a running hash holds one piece at a time."""
    pieces = spark.read.parquet(f"{folder}/formatted").repartition("conv", "branch").sortWithinPartitions("conv", "branch", "position")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def close() -> None:
            if key is not None:
                n, turns, chars, loss, size = state
                done.append((*key, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            for conv, branch, _, piece, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv, branch) != key:
                    close()
                    key, state = (conv, branch), [0, sha256(), 0, sha256(), 0]
                role, text = parse(piece)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if a >= 0:
                    learned = unescape(piece[a:b])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(piece)
            if done:
                yield _rows(done)
                done = []
        close()
        if done:
            yield _rows(done)

    return pieces.mapInArrow(run, DIGEST)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [f.split()[0] for f in DIGEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
