"""Chat transcripts: a hidden Markov model over speaker markers and line features finds roles and turns; turns are rendered canonically."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.storage import materialize

ROLES = ("system", "user", "assistant")
#: A state is a role and whether the line begins a turn.
STATES = 2 * len(ROLES)
#: Speaker markers at the start of a line, by the role that they commonly mark.
MARKERS = {"system": r"system|instructions?", "user": r"user|human|question|q|customer|me", "assistant": r"assistant|ai|bot|answer|a|agent|model"}
PREFIX = r"(?i)^\s*(?:[#>*\-]{1,4}\s*)?(?:<\|?|\[)?\s*(?:%s)\s*(?:\|?>|\]|:)[*\s]*:?\s*"
#: Most lines in one block of a conversation (a power of two). Blocks are decoded apart and joined exactly.
BLOCK = 4096
#: How many values each feature of a line has: marker, length, end, place.
SIZES = (4, 8, 3, 3)


def features(line: Column, first: Column) -> list[Column]:
    """Marker (none, system, user, assistant), length class, how it ends, and place (first of all, after a blank, other)."""
    marker = F.lit(0)
    for k, role in reversed(list(enumerate(ROLES, 1))):
        marker = F.when(line.rlike(PREFIX % MARKERS[role]), k).otherwise(marker)
    n = F.length(line)
    length = F.when(n == 0, 0).otherwise(F.least(F.lit(7), F.floor(F.log2(n.cast("double")) / 1.25).cast("int") + 1))
    end = F.when(F.rtrim(line).endswith("?"), 1).when(F.rtrim(line).rlike(r"[.!:]$"), 2).otherwise(0)
    return [marker.cast("int"), length.cast("int"), end.cast("int"), first.cast("int")]


def lines_of(messages: DataFrame, *, conv_col: str = "conv_id", order_col: str = "turn", text_col: str = "text", role_col: str | None = None) -> DataFrame:
    """Messages of raw transcripts to lines: ``conv, pos, tie, at, seq, block, line, f0..f3`` and, with roles, ``state``.

    ``at`` numbers the lines of a message. A null conversation id makes its message a conversation of its own; null
    positions come first; messages with the same position are ordered by a hash of their text, and one that is repeated
    comes as often, whole each time; a null text is an empty line; an empty table gives none; columns of other names are
    ignored, whatever they are called.

    ``seq`` follows the order of lines in a conversation: lines are dealt to ranges of (conversation, position, message,
    line), so one conversation of any size and of any positions is spread over tasks. A block is what lies between two
    multiples of ``BLOCK`` there, so it is bounded too. The table is written, as these numbers must not change.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    pos = F.coalesce(F.col(order_col).cast("long"), F.lit(-1).cast("long"))
    known = [F.lower(F.col(role_col)).alias("role")] if role_col else []
    rows = messages.select(F.col(conv_col).alias("conv_id"), pos.alias("pos"), text.alias("text"), *known).withColumn("message", F.monotonically_increasing_id())
    conv = F.coalesce(F.col("conv_id").cast("string"), F.concat(F.lit("null:"), F.col("message").cast("string")))
    rows = rows.select("conv_id", conv.alias("conv"), "pos", F.xxhash64("text").alias("tie"), "message", *known_col(role_col), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    f = features(F.col("line"), F.when((F.col("pos") <= 0) & (F.col("at") == 0), 0).when(F.trim("line") == "", 1).otherwise(2))
    out = rows.select("conv_id", "conv", "pos", "tie", "message", "at", "line", *known_col(role_col), *[c.alias(f"f{i}") for i, c in enumerate(f)])
    if role_col:
        role = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int") - 1
        out = out.withColumn("state", F.when(role >= 0, 2 * role + (F.col("at") > 0).cast("int"))).drop("role")
    order = ("conv", "pos", "tie", "message", "at")
    out = out.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
    return materialize(out.drop("message").withColumn("block", F.shiftright("seq", BLOCK.bit_length() - 1)), "lines")


def known_col(role_col: str | None) -> list[str]:
    return ["role"] if role_col else []


def fit(lines: DataFrame) -> dict[str, np.ndarray]:
    """Start, transition and emission log-probabilities from lines with states, by counts (plus one). Counted in Spark;
    what comes to the driver is bounded by the numbers of states and feature values."""
    known = lines.where("state is not null")
    emit = [np.ones((STATES, n)) for n in SIZES]
    for s, *values, n in known.groupBy("state", *[f"f{i}" for i in range(len(SIZES))]).count().collect():
        for e, v in zip(emit, values, strict=True):
            e[s, v] += n
    move, start = np.ones((STATES, STATES)), np.ones(STATES)
    w = Window.partitionBy("conv", "block").orderBy("seq")
    before = known.select("state", "f3", F.lag("state").over(w).alias("before"))
    for b, s, n in before.where("f3 = 0 or before is not null").groupBy("before", "state").count().collect():
        if b is None:
            start[s] += n
        else:
            move[b, s] += n
    legal = np.ones((STATES, STATES), bool)
    for s in range(STATES):
        for t in range(1, STATES, 2):
            legal[s, t] = s // 2 == t // 2
    start[1::2] = 0
    move[~legal] = 0
    with np.errstate(divide="ignore"):
        return {"start": np.log(start / start.sum()), "move": np.log(move / move.sum(axis=1, keepdims=True)), **{f"e{i}": np.log(e / e.sum(axis=1, keepdims=True)) for i, e in enumerate(emit)}}


def emissions(model: dict[str, np.ndarray], obs: np.ndarray) -> np.ndarray:
    return sum(model[f"e{i}"][:, obs[:, i]].T for i in range(len(SIZES)))


def viterbi(score: np.ndarray, move: np.ndarray, entry: np.ndarray, last: int | None = None) -> tuple[np.ndarray, float]:
    """Best states for emission scores [T, S]; ``entry`` scores the first state, ``last`` fixes the final one."""
    best, back = entry + score[0], np.zeros(score.shape, np.int64)
    for t in range(1, len(score)):
        via = best[:, None] + move
        back[t] = via.argmax(axis=0)
        best = via.max(axis=0) + score[t]
    out = np.empty(len(score), np.int64)
    out[-1] = int(best.argmax()) if last is None else last
    for t in range(len(score) - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out, float(best[out[-1]])


def transfer(score: np.ndarray, move: np.ndarray) -> np.ndarray:
    """[S, S]: the best score of a block that is entered in a state and left in another (max-plus product of its steps)."""
    best = np.full((STATES, STATES), -np.inf)
    np.fill_diagonal(best, 0.0)
    for t in range(len(score)):
        if t:
            best = (best[:, :, None] + move[None]).max(axis=1)
        best = best + score[t]
    return best


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of a partition that is sorted by ``keys``."""
    rest = None
    for b in batches:
        p = b.to_pandas()
        if rest is not None:
            p = pd.concat([rest, p], ignore_index=True)
        cut = np.flatnonzero((p[keys] != p[keys].shift()).any(axis=1))
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            yield p.iloc[s:e]
        rest = p.iloc[cut[-1] :] if len(p) else None
    if rest is not None and len(rest):
        yield rest


def decode(lines: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """``lines`` with ``found``, their Viterbi states.

    Conversations of one block are decoded at once. Longer ones, however long, are decoded exactly without meeting in one
    task: each block is reduced to its transfer matrix, the best entry and exit states of all blocks follow from
    these small matrices, and blocks are then decoded between their fixed states. A conversation's matrices meet in one
    task: 300 bytes for ``BLOCK`` lines, so a thousand million lines take 80 MB.
    """
    held = lines.sparkSession.sparkContext.broadcast(model)
    cols = [f"f{i}" for i in range(len(SIZES))]
    keys = ["conv", "block"]
    blocks = lines.groupBy("conv", "block").count()
    many = materialize(blocks.groupBy("conv").count().where("count > 1").select("conv"), "long")
    found = None
    if not many.isEmpty():
        dealt = lines.join(many, "conv", "left_semi").repartition(*keys).sortWithinPartitions(*keys, "seq")

        def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = held.value
            for g in _groups(batches, keys):
                t = transfer(emissions(m, g[cols].to_numpy()), m["move"])
                yield pa.RecordBatch.from_arrays([pa.array([g["conv"].iloc[0]]), pa.array([g["block"].iloc[0]], pa.int64()), pa.array([t.ravel()], pa.list_(pa.float64()))], names=["conv", "block", "m"])

        def chain(p: pd.DataFrame) -> pd.DataFrame:
            m, p = held.value, p.sort_values("block")
            best, back, exits = m["start"], [], []
            for t in p["m"]:
                via = best[:, None] + np.stack(t).reshape(STATES, STATES)
                back.append(via.argmax(axis=0))
                left = via.max(axis=0)
                step = left[:, None] + m["move"]
                exits.append(step.argmax(axis=0))
                best = step.max(axis=0)
            last = [int(left.argmax())]
            entry = []
            for i in range(len(p) - 1, -1, -1):
                entry.append(int(back[i][last[-1]]))
                if i:
                    last.append(int(exits[i - 1][entry[-1]]))
            return pd.DataFrame({"conv": p["conv"].to_numpy(), "block": p["block"].to_numpy(), "entry": entry[::-1], "last": last[::-1]})

        found = dealt.mapInArrow(reduce, "conv string, block long, m array<double>").groupBy("conv").applyInPandas(chain, "conv string, block long, entry int, last int")
        found = materialize(found, "states")
    rows = lines.join(found, keys, "left") if found is not None else lines.withColumns({"entry": F.lit(None).cast("int"), "last": F.lit(None).cast("int")})
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, out, n = held.value, [], 0
        for g in _groups(batches, keys):
            score, first, last = emissions(m, g[cols].to_numpy()), m["start"], None
            if not pd.isna(g["entry"].iloc[0]):
                first, last = np.full(STATES, -np.inf), int(g["last"].iloc[0])
                first[int(g["entry"].iloc[0])] = 0.0
            out.append(g.assign(found=viterbi(score, m["move"], first, last)[0].astype(np.int32)))
            n += len(g)
            if n > 4096:
                yield pa.RecordBatch.from_pandas(pd.concat(out)[names], schema=schema, preserve_index=False)
                out, n = [], 0
        if out:
            yield pa.RecordBatch.from_pandas(pd.concat(out)[names], schema=schema, preserve_index=False)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import IntegerType, StructField, StructType

    kind = StructType([*dealt.schema.fields, StructField("found", IntegerType())])
    schema, names = to_arrow_schema(kind), kind.names
    return dealt.mapInArrow(run, kind).drop("entry", "last")


def render(decoded: DataFrame) -> DataFrame:
    """Recovered turns: ``conv_id, turn_no`` (from 0), ``role, text`` (lines without their markers) and ``rendered``.

    Running numbers are counted within blocks and offset by what earlier blocks hold.
    """
    begins = (F.col("found") % 2 == 0).cast("long")
    inner = F.sum(begins).over(Window.partitionBy("conv", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    sizes = decoded.groupBy("conv", "block").agg(F.sum(begins).alias("n"))
    starts = sizes.select("conv", "block", (F.sum("n").over(Window.partitionBy("conv").orderBy("block")) - F.col("n")).alias("first"))
    rows = decoded.withColumn("inner", inner).join(starts, ["conv", "block"]).withColumn("turn_no", F.col("first") + F.col("inner") - 1)
    line = F.col("line")
    for k, role in enumerate(ROLES, 1):
        line = F.when((F.col("f0") == k), F.regexp_replace(F.col("line"), PREFIX % MARKERS[role], "")).otherwise(line)
    rows = rows.withColumn("clean", F.when(F.col("found") % 2 == 0, line).otherwise(F.col("line")))
    turns = rows.groupBy("conv", "turn_no").agg(F.first("conv_id").alias("conv_id"), F.min("found").alias("state"), F.array_sort(F.collect_list(F.struct("seq", "clean"))).alias("l"))
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.floor(F.col("state") / 2) + 1).cast("int"))
    text = F.concat_ws("\n", F.col("l.clean"))
    return turns.select("conv_id", "turn_no", role.alias("role"), text.alias("text"), F.concat(F.lit("<|"), role, F.lit("|>\n"), F.trim(text), F.lit("\n<|end|>\n")).alias("rendered"))


def parse(messages: DataFrame, model: dict[str, np.ndarray], **columns: str) -> DataFrame:
    """Raw transcripts to recovered turns; see ``lines_of``, ``decode`` and ``render``."""
    return render(materialize(decode(lines_of(messages, **columns), model), "decoded"))


#: Ways in which transcripts write their speakers, for making raw ones from clean turns.
STYLES = (("System: ", "User: ", "Assistant: "), ("### Instruction: ", "### Human: ", "### Assistant: "), ("[system] ", "[user] ", "[ai] "), ("", "Q: ", "A: "), ("SYSTEM: ", "Customer: ", "Agent: "))


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """Clean turns as raw transcript messages: one style a conversation, and every seventh marker is left out (by hashes)."""
    style = F.pmod(F.xxhash64(F.lit("style"), "conv_id"), F.lit(len(STYLES))).cast("int")
    role = F.array_position(F.array(*map(F.lit, ROLES)), F.lower("role")).cast("int")
    marks = F.array(*[F.array(*map(F.lit, s)) for s in STYLES])
    mark = F.when((role > 0) & (F.pmod(F.xxhash64(F.lit("mark"), "conv_id", "turn"), F.lit(7)) > 0), F.element_at(F.element_at(marks, style + 1), F.greatest(role, F.lit(1)))).otherwise("")
    return conversations.select("conv_id", "turn", "role", F.concat(mark, F.coalesce("text", F.lit(""))).alias("text"))
