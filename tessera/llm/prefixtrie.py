"""Trie of conversation prefixes: rolling fingerprints group the candidates, texts are compared, figures roll up to parents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.text import slices
from tessera.storage import materialize, release

#: Moduli of the two halves of a fingerprint; products of residues stay below 2**62.
MODULI = (2_147_483_647, 2_147_483_629)
#: Conversations of a hundred share the first turns of its first one: as many as the CRC-32 of their number modulo GRAFTS says.
HUNDRED, GRAFTS = 100, 6
#: Bytes of joined numbers in a row that is handed on.
CHUNK = 1 << 16

_PREFIX = "d int, key binary, conv long, ends boolean, chars int, role string, body string"
_FOUND = "kind string, d int, key binary, conv long, rep long, open boolean, bad boolean, chars int, n long, n_ends long, sha string, role string, body string, seq int, ids string"


def power(base: int, exponent: np.ndarray, modulus: int) -> np.ndarray:
    """``base ** exponent % modulus`` by squaring."""
    out, square, left = np.ones(len(exponent), np.uint64), base % modulus, exponent.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * np.uint64(square) % np.uint64(modulus), out)
        square, left = square * square % modulus, left >> np.uint64(1)
    return out % np.uint64(modulus)


def prefix_sums(x: np.ndarray, depth: np.ndarray, fresh: np.ndarray, before: int, base: int, modulus: int) -> np.ndarray:
    """Fingerprints of the prefixes of sequences: the sum of ``x * base**depth`` modulo ``modulus`` from a sequence's first row (``fresh``) on.

    Rows before the first fresh one carry on a sequence with the sum ``before``.
    """
    terms = x % np.uint64(modulus) * power(base, depth, modulus) % np.uint64(modulus)
    total = np.cumsum(terms)
    starts = np.flatnonzero(fresh)
    owner = np.searchsorted(starts, np.arange(len(x)), "right")
    taken = np.concatenate([[np.uint64(0)], (total - terms)[starts]])
    return (total - taken[owner] + np.where(owner == 0, np.uint64(before), np.uint64(0))) % np.uint64(modulus)


class _Rebuilder:
    """Rebuilds conversations from rows in the order of hundred, first conversation of the hundred, conversation and turn."""

    def __init__(self, moduli: tuple[int, int], rounds: int):
        self.seeds = [(1_000_003 + 2 * r, 998_244_353 + 2 * r) for r in range(rounds)]
        self.moduli = moduli
        self.conv = self.again = self.root = self.rows = None  # rows: of the hundred's first conversation, its first turns
        self.seen = self.depth = self.shared = 0
        self.sums = [[0, 0] for _ in self.seeds]

    def close(self) -> list[tuple]:
        return [] if self.conv is None else [(self.conv, self.again, self.depth, -1, True, False)]

    def batch(self, b: pa.RecordBatch) -> pa.RecordBatch:
        """Prefixes of a batch; the sequence that it ends in goes on in the next one."""
        off = self.rows.num_rows if self.rows is not None else 0
        rows = pa.Table.from_batches([*([self.rows] if off else []), b]).combine_chunks()
        root, conv, h = (rows.column(c).to_numpy() for c in ("root", "conv", "h"))
        first = list(range(off))
        starts = off + np.flatnonzero(np.concatenate([[True], conv[off + 1 :] != conv[off:-1]])) if b.num_rows else []
        out: list[tuple] = []
        for start, end in zip(starts, [*starts[1:], len(conv)], strict=True):
            c, own = int(conv[start]), conv[start] == root[start]
            if c != self.conv:
                out += self.close()
                if root[start] != self.root:
                    self.root, first = int(root[start]), []
                self.conv, self.again, self.seen, self.depth = c, rows.column("again")[int(start)].as_py(), 0, 0
                self.shared = 0 if own else int(h[start])
                out.append((c, self.again, 0, -1, False, True))
                for i in first[: self.shared]:
                    self.depth += 1
                    out.append((c, self.again, self.depth, i, False, False))
            for i in range(start, end):
                self.seen += 1
                if own and self.seen < GRAFTS:
                    first.append(i)
                if self.seen > self.shared:
                    self.depth += 1
                    out.append((c, self.again, self.depth, i, False, False))
        self.rows = rows.take(pa.array(first, pa.int64())).combine_chunks().to_batches()[0] if first else None
        return self.prefixes(out, rows)

    def prefixes(self, out: list[tuple], rows: pa.Table | None) -> pa.RecordBatch:
        conv, again, depth, at, ends, fresh = zip(*out, strict=True) if out else ((),) * 6
        depth, at, turn = np.array(depth, np.int64), np.array(at, np.int64), np.array(at, np.int64) >= 0
        keys = []
        for r, bases in enumerate(self.seeds):
            x = np.zeros(len(at), np.uint64)
            if turn.any():
                x[turn] = rows.column(f"x{r}").to_numpy().view(np.uint64)[at[turn]]
            halves = [prefix_sums(x, depth, np.array(fresh, bool), s, base, m) for s, base, m in zip(self.sums[r], bases, self.moduli, strict=True)]
            if len(at):
                self.sums[r] = [int(s[-1]) for s in halves]
            keys.append(np.stack(halves, 1).astype(">u4").tobytes())
        key = [keys[0][8 * k : 8 * k + 8] for k in range(len(at))]
        for k, (d, since) in enumerate(zip(depth.tolist(), again, strict=True)):
            for r, s in enumerate(since or (), 1):
                if s is not None and d >= s:
                    key[k] += keys[r][8 * k : 8 * k + 8]
        pick = pa.array([i if i >= 0 else None for i in at.tolist()], pa.int64())
        texts = [rows.column(c).take(pick).combine_chunks() for c in ("chars", "role", "body")] if rows is not None else [pa.nulls(len(at), t) for t in (pa.int32(), pa.string(), pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(depth, pa.int32()), pa.array(key, pa.binary()), pa.array(conv, pa.int64()), pa.array(ends, pa.bool_()), *texts], names=["d", "key", "conv", "ends", "chars", "role", "body"])


def prefixes(turns: DataFrame, *, rounds: int = 1, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """``d, key, conv, ends, chars, role, body``: a row for each prefix of each rebuilt conversation, the empty one included, and one
    with ``ends`` for the whole.

    Hundreds of conversations are dealt out, turns are sorted there and streamed: a task holds a batch and the five first
    turns that a hundred shares. ``key`` is the fingerprint, with those of further rounds from the depths in ``again`` on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Rebuilder(moduli, rounds)
        for b in batches:
            for s in slices([b], 1024):
                yield state.batch(s)
        yield state.prefixes(state.close(), None)

    x = [F.xxhash64(*([F.lit(r)] if r else []), "role", "body").alias(f"x{r}") for r in range(rounds)]
    root = (F.col("conv") - F.col("conv") % HUNDRED).alias("root")
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % GRAFTS).cast("int").alias("h")
    rows = turns.select(root, "conv", "turn", h, "again", F.length("body").alias("chars"), "role", "body", *x).repartition("root")
    rows = rows.sortWithinPartitions("root", F.col("conv") != F.col("root"), "conv", F.asc_nulls_first("turn"), "role", "body").drop("turn")
    return rows.mapInArrow(run, _PREFIX)


class _Group:
    """The prefixes of one fingerprint and depth that a task has met: its representative, counts, and numbers of those that end."""

    def __init__(self, d: int, key: bytes, rep: int, chars: int, role: str | None, body: str | None, open_: bool):
        self.d, self.key, self.rep, self.chars, self.role, self.body, self.open = d, key, rep, chars, role, body, open_
        self.n = self.n_ends = self.seq = self.length = 0
        self.sha, self.ids = hashlib.sha256(), []

    def ended(self, ids: str) -> None:
        self.sha.update(f"{',' if self.n_ends else ''}{ids}".encode())
        self.n_ends += 1 + ids.count(",")

    def node(self) -> dict:
        return {"kind": "node", "conv": self.rep, "rep": self.rep, "chars": self.chars, "n": self.n, "n_ends": self.n_ends, "sha": self.sha.hexdigest(), **self.place()}

    def place(self) -> dict:
        return {"d": self.d, "key": self.key, "open": False, "bad": False}

    def part(self, n: int) -> dict:
        ids, self.ids, self.length = ",".join(self.ids), [], 0
        self.seq += 1
        return {**self.place(), "kind": "part", "conv": self.rep, "rep": self.rep, "chars": self.chars, "n": n, "role": self.role, "body": self.body, "seq": self.seq, "ids": ids}

    def member(self, conv: int, role: str | None, body: str | None) -> dict:
        return {**self.place(), "kind": "member", "conv": conv, "rep": self.rep, "open": self.open, "bad": (role, body) != (self.role, self.body)}


def _out(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.split(" ") for f in _FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in fields], names=[n for n, _ in fields])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of a range of prefixes. Each prefix is compared with the group's first one. Groups at the ends of the range may go on in
    the next one: they are handed on in parts, with their text and the numbers of those that end; so are groups with many of these."""
    group = None

    def closed(last: bool) -> list[dict]:
        if group is None:
            return []
        return [group.part(group.n)] if group.open or group.seq or last else [group.node()]

    for batch in batches:
        for s in slices([batch], 512):
            rows: list[dict] = []
            for d, key, conv, ends, chars, role, body in zip(*(s.column(k).to_pylist() for k in range(7)), strict=True):
                if group is None or d != group.d or key != group.key:
                    rows += closed(False)
                    group = _Group(d, key, conv, chars or 0, role, body, group is None)
                if ends:
                    group.ended(str(conv))
                    group.ids.append(str(conv))
                    group.length += len(group.ids[-1]) + 1
                    if group.length > CHUNK:
                        rows.append(group.part(0))
                else:
                    group.n += 1
                    if conv != group.rep:
                        rows.append(group.member(conv, role, body))
            yield _out(rows)
    yield _out(closed(True))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of groups that were handed on in parts; the parts' representatives are compared with the first one."""
    group, rep = None, None
    names = [f.split(" ")[0] for f in _FOUND.split(", ")]
    for batch in batches:
        for s in slices([batch], 64):
            rows: list[dict] = []
            for r in (dict(zip(names, x, strict=True)) for x in zip(*(s.column(k).to_pylist() for k in range(len(names))), strict=True)):
                if group is None or (r["d"], r["key"]) != (group.d, group.key):
                    rows += [group.node()] if group else []
                    group = _Group(r["d"], r["key"], r["conv"], r["chars"], r["role"], r["body"], False)
                    rep = r["conv"]
                if r["conv"] != rep:
                    rep = r["conv"]
                    rows.append(group.member(rep, r["role"], r["body"]))
                group.n += r["n"]
                if r["ids"]:
                    group.ended(r["ids"])
            yield _out(rows)
    yield _out([group.node()] if group else [])


def trie(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", moduli: tuple[int, int] = MODULI) -> DataFrame:
    """One row a node: ``conv, depth, parent, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Conversations are rebuilt on the first turns of their hundred's first one, every prefix gets a rolling fingerprint, and
    prefixes are dealt out by ranges of depth, fingerprint and conversation, so that a group of any size is split. There
    each one is compared with its group's least conversation; what groups at range ends are compared with each other is a
    row or two a task. Equal fingerprints and equal last turns have equal fingerprints before, so comparing last turns at
    every depth compares whole prefixes. Where texts differ, all conversations of that group get further
    fingerprints from that depth on, until none differ.

    A conversation owns the nodes of which it is the least member: the end of its path. What a node's subtree adds up to is
    the sum over its members of what each owns from that depth on, so one running sum a conversation and one grouped sum
    replace a walk over depths.

    Null roles and texts are empty; turns with equal numbers are ordered by role, then text; null turns come first. Repeated rows
    are turns of their own. Rows without a conversation number are left out. An empty table gives an empty result, other
    columns are ignored. The turns of one conversation are streamed by one task.
    """
    turns = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body")
    )
    again, rounds = None, 1
    while True:
        rows = turns.withColumn("again", F.lit(None).cast("array<int>")) if again is None else turns.join(again, "conv", "left")
        place = ["d", "key", "conv", "ends"]
        found = prefixes(rows, rounds=rounds, moduli=moduli).repartitionByRange(*place[:3]).sortWithinPartitions(*place)
        found = materialize(found.mapInArrow(_grouped, _FOUND), "prefixes")
        parts = found.where("kind = 'part'").repartition("d", "key").sortWithinPartitions("d", "key", "conv", "seq")
        merged = materialize(parts.mapInArrow(_merged, _FOUND), "merged")
        every = found.where("kind <> 'part'").unionByName(merged)
        wrong = every.where("bad").select("d", "key").distinct()
        if not wrong.limit(1).count():
            return _rolled_up(every, merged)
        members = found.unionByName(merged).select("d", "key", "conv").join(wrong, ["d", "key"]).groupBy("conv").agg(F.min("d").alias("since"))
        if again is None:
            again = members.select("conv", F.array("since").alias("again"))
        else:
            blank = F.array(*[F.lit(None).cast("int")] * (rounds - 1))
            again = again.join(members, "conv", "full").select("conv", F.concat(F.coalesce("again", blank), F.array("since")).alias("again"))
        again = materialize(again, "again")
        rounds += 1
        release(found)
        release(merged)


def _rolled_up(found: DataFrame, merged: DataFrame) -> DataFrame:
    """Figures of nodes from ``found``: one row a prefix of a conversation, a node's with what is known of the node.

    ``merged`` says which representatives of parts of a group belong to which node: a row a task at most, so it may be broadcast.
    """
    leader = merged.where("kind = 'member'").select(F.col("conv").alias("rep"), "d", F.col("rep").alias("leader"))
    light = found.select("d", "conv", "rep", "chars", "n", "n_ends", "sha", (F.col("kind") == "node").alias("own"))
    light = light.join(leader, ["rep", "d"], "left").withColumn("rep", F.coalesce("leader", "rep")).drop("leader")
    path = Window.partitionBy("conv").orderBy(F.desc("d"))
    below = path.rowsBetween(Window.unboundedPreceding, 0)
    light = light.withColumns({
        "saved": F.sum(F.when(F.col("own"), (F.col("n") - 1) * F.col("chars")).otherwise(0)).over(below),
        "leaves": F.sum((F.col("own") & (F.col("n") == F.col("n_ends"))).cast("long")).over(below),
        "child": F.coalesce(F.lag("own").over(path), F.lit(False)).cast("long"),
        "parent": F.lead("rep").over(path),
    })
    nodes = light.groupBy(F.col("rep").alias("conv"), F.col("d").cast("long").alias("depth")).agg(
        F.max(F.when(F.col("own"), F.col("parent"))).alias("parent"), F.max("n").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.max("sha").alias("ends_sha256")
    )
    return nodes
