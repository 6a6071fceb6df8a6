"""Byte-level BPE by a deterministic tokenization automaton; encoding walks its arcs, decoding emits their labels."""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.text import slices

#: Pre-split of byte-level BPE (fixed value of the public vocabulary's format).
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters with the White_Space property, as a class's inside (fixed values).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters, and all characters, of texts that the standard library's regular expressions pre-split alike: Latin ones, without those
#: that Unicode counts among letters or numbers and that are neither here.
LATIN = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
PLAIN = r"\x00-\x84\x86-\x9f\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\u024f\u2010-\u2027\u2030-\u205e"
#: Pieces whose ids a task remembers, and the longest such piece in characters. Others are encoded anew each time.
REMEMBERED, REMEMBERED_CHARS = 200_000, 64
#: Pairs of state and token whose answer a walker holds, as a power of two.
HELD = 18
#: Longest word in bytes that is walked in step with others; longer ones go alone.
IN_STEP = 256


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in vocabulary files."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {chr(b): b for b in plain}
    out.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return out


def compile_automaton(vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> dict[str, np.ndarray | list]:
    """Merges to the automaton whose accepted token sequences are exactly the correct tokenizations, as flat tables.

    It starts as one state with an arc for each byte. The gadget of merge ``u v`` gives every state with an arc ``u``
    into a state that has an arc ``v`` a new arc ``uv`` to where ``v`` leads, and moves the arcs ``u`` to a copy of
    their target that lacks ``v``. All arcs of one token lead to the same state, so a gadget is one new state: a copy
    of its parent less an arc and what later gadgets would have made of that arc.

    Tokens are numbered so that what a state lacks is an interval of numbers a gadget (``_numbers``), so the transition
    table is ``row`` (of a token: the row of the state that its arcs lead to; row 0 is the initial state), ``lacks``
    (sorted keys: row in the upper half, first number of an interval in the lower) and ``upto`` (the furthest end of the
    row's intervals so far): some numbers a merge. Bytes are read by a trie of the labels with failure links
    (``parent, byte, fail``, in order of depth), whose nodes name the longest token that ends there (``longest``);
    ``shorter`` is the next shorter token that ends a token, ``length`` and ``label`` are its bytes.
    """
    target, left, rank, parent, lacks, made = {}, {}, {}, [-1], [-1], [0]
    for b in range(256):
        if bytes([b]) not in vocab:
            raise ValueError("the vocabulary must hold every byte")
        target[vocab[bytes([b])]], rank[vocab[bytes([b])]] = 0, -1

    def has(q: int, t: int) -> bool:
        """Whether state ``q`` has an arc ``t``: older arcs are those of the parent, newer ones come from their left halves."""
        while q or rank[t] >= 0:
            if rank[t] >= made[q]:
                t = left[t]
            elif lacks[q] == t:
                return False
            else:
                q = parent[q]
        return True

    for r, (a, b) in enumerate(merges):
        u, v, w = vocab[a], vocab[b], vocab[a + b]
        if w in rank or u not in target or v not in target or not has(target[u], v):
            continue
        left[w], rank[w], target[w] = u, r, target[v]
        parent.append(target[u])
        lacks.append(v)
        made.append(r)
        target[u] = len(parent) - 1

    number, first, last = _numbers(left, rank, lacks, made)
    rows = {0: 0}
    for q in target.values():
        rows.setdefault(q, len(rows))
    keys, ends = [], []
    for q, row in rows.items():
        found, at = [], q
        while at:
            found.append((first[at], last[at]))
            at = parent[at]
        reach = 0
        for lo, hi in sorted(found):
            reach = max(reach, hi)
            keys.append((row, lo))
            ends.append(reach)
    order = np.lexsort(np.array(keys, np.int64).reshape(-1, 2).T[::-1])
    keys = np.array(keys, np.int64).reshape(-1, 2)[order]
    size = max(vocab.values()) + 1
    out = {"number": np.full(size, -1, np.int32), "row": np.full(size, -1, np.int32), "lacks": keys[:, 0] << 32 | keys[:, 1], "upto": np.array(ends, np.int32)[order]}
    for t, q in target.items():
        out["number"][t], out["row"][t] = number[t], rows[q]
    label: list[bytes] = [b""] * size
    for word, t in vocab.items():
        label[t] = word
    return {**out, **_trie({label[t]: t for t in target}, size), "label": label}


def _numbers(left: dict[int, int], rank: dict[int, int], lacks: list[int], made: list[int]) -> tuple[dict[int, int], list[int], list[int]]:
    """Numbers of tokens, and of each state the interval that its gadget took away from the parent.

    That is the token ``v`` and all that start with ``v`` and were made from it by this gadget's merge or later ones. Tokens
    are numbered as a tree over left halves, from a parent to its youngest child first, so these are neighbours.
    """
    children: dict[int, list[int]] = {}
    for w in sorted(left, key=rank.__getitem__):
        children.setdefault(left[w], []).append(w)
    number, walk, stack = {}, [], sorted((t for t, r in rank.items() if r < 0), reverse=True)
    while stack:
        t = stack.pop()
        number[t] = len(walk)
        walk.append(t)
        stack.extend(children.get(t, ()))
    size = dict.fromkeys(walk, 1)
    for t in reversed(walk):
        if t in left:
            size[left[t]] += size[t]
    first, last = [0], [0]
    for v, m in zip(lacks[1:], made[1:], strict=True):
        older = [w for w in children.get(v, ()) if rank[w] < m]
        first.append(number[v])
        last.append(number[older[-1]] if older else number[v] + size[v])
    return number, first, last


def _trie(tokens: dict[bytes, int], size: int) -> dict[str, np.ndarray]:
    """Prefixes of tokens as nodes, in order of depth; a node's failure link is the longest node that ends it."""
    nodes = {word: n for n, word in enumerate(sorted({b"", *(w[:k] for w in tokens for k in range(1, len(w) + 1))}, key=len))}
    parent, byte = [nodes[w[:-1]] for w in nodes], [w[-1] if w else 0 for w in nodes]
    fail, longest, shorter = np.zeros(len(parent), np.int32), np.full(len(parent), -1, np.int32), np.full(size, -1, np.int32)
    for word, n in nodes.items():
        f = next((nodes[word[k:]] for k in range(1, len(word)) if word[k:] in nodes), 0)
        fail[n], longest[n] = f, longest[f]
        if (t := tokens.get(word)) is not None:
            longest[n], shorter[t] = t, longest[f]
    length, depth = np.zeros(size, np.int32), np.zeros(len(parent), np.int32)
    for word, t in tokens.items():
        length[t] = len(word)
    for word, n in nodes.items():
        depth[n] = len(word)
    return {"parent": np.array(parent, np.int32), "byte": np.array(byte, np.int32), "fail": fail, "depth": depth, "longest": longest, "shorter": shorter, "length": length}


def _pages(trie: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where each byte leads from each node of the trie: 16 pages a node, of 16 bytes each. A node shares the pages of its
    failure link but for those that hold its own children, so the table is some numbers a node, not 256."""
    fail, parent, byte, depth = trie["fail"], trie["parent"], trie["byte"], trie["depth"]
    page, pages, made = np.zeros((len(fail), 16), np.int32), [np.zeros((1, 16), np.int32)], 1
    cuts = np.searchsorted(depth, np.arange(depth.max() + 2))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a:
            page[a:b] = page[fail[a:b]]
        kids = np.flatnonzero((parent >= a) & (parent < b) & (depth > 0))
        new, at = np.unique(parent[kids] << 4 | byte[kids] >> 4, return_inverse=True)
        own = np.concatenate(pages)[page.reshape(-1)[new]]
        own[at, byte[kids] & 15] = kids
        page.reshape(-1)[new] = made + np.arange(len(new))
        pages.append(own)
        made += len(new)
    return page.reshape(-1), np.concatenate(pages).reshape(-1)


class Walker:
    """Spells words by the automaton's arcs.

    Each prefix of a word has one correct tokenization; its last token is the longest one that ends there and has an arc
    from the state that the prefix before it leads to. So one pass over the bytes finds it, without search or return.
    """

    def __init__(self, tables: dict):
        self.t = tables
        self.page, self.next = _pages(tables)
        self.views = {k: memoryview(x) for k, x in (("page", self.page), ("next", self.next), *((k, tables[k]) for k in ("longest", "shorter", "length", "row", "number", "lacks", "upto")))}
        self.known: dict[int, bool] = {}
        self.held = np.full(1 << HELD, -1, np.int64)

    def has_arcs(self, row: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the states of these rows have arcs of these tokens. The latest answer of each slot is held beside its
        question, as most pairs come often; the others are searched for."""
        asked = row.astype(np.int64) << 31 | token
        slot = (asked.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - HELD)).view(np.int64)
        held = self.held[slot]
        out, new = (held & 1).astype(bool), np.flatnonzero(held >> 1 != asked)
        if len(new):
            row, number = row[new], self.t["number"][token[new]]
            at = np.searchsorted(self.t["lacks"], row.astype(np.int64) << 32 | number, "right") - 1
            out[new] = ~((self.t["lacks"][at] >> 32 == row) & (self.t["upto"][at] > number) & (at >= 0))
            self.held[slot[new]] = asked[new] << 1 | out[new]
        return out

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers. Short words are walked in step, byte by byte."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        short = np.argsort(-sizes, kind="stable")
        short = short[np.searchsorted(-sizes[short], -IN_STEP) :].tolist()
        for at in range(0, len(short), 8192):
            some = short[at : at + 8192]
            for i, x in zip(some, self._in_step([words[i] for i in some]), strict=True):
                out[i] = x
        for i in np.flatnonzero(sizes > IN_STEP).tolist():
            out[i] = self._alone(words[i])
        return out

    def _in_step(self, words: list[bytes]) -> list[bytes]:
        t, n = self.t, len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        data, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
        last, rows = np.zeros((sizes[0] + 1, n), np.int32), np.zeros((sizes[0] + 1, n), np.int32)
        node = np.zeros(n, np.int32)
        for end in range(1, sizes[0] + 1):
            m = int(np.searchsorted(-sizes, -end, "right"))
            byte = data[starts[:m] + end - 1]
            node = self.next[self.page[node[:m] << 4 | byte >> 4] << 4 | byte & 15]
            who, token = np.arange(m), t["longest"][node]
            while len(who):
                ok = self.has_arcs(rows[end - t["length"][token], who], token)
                last[end, who[ok]] = token[ok]
                who, token = who[~ok], t["shorter"][token[~ok]]
            rows[end, :m] = t["row"][last[end, :m]]
        who, place, found = np.arange(n), sizes.copy(), []
        while len(who := who[place[who] > 0]):
            token = last[place[who], who]
            place[who] -= t["length"][token]
            found.append((who, token))
        who, step = np.concatenate([w for w, _ in found]), np.repeat(np.arange(len(found)), [len(w) for w, _ in found])
        ids = np.concatenate([x for _, x in found])[np.lexsort((-step, who))].astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(who, minlength=n))
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _alone(self, word: bytes) -> bytes:
        page, step, longest, shorter, length, row, number, lacks, upto = self.views.values()
        known, node, last, rows = self.known, 0, [0], [0]
        for end, byte in enumerate(word, 1):
            node = step[page[node << 4 | byte >> 4] << 4 | byte & 15]
            token = longest[node]
            while True:
                key = rows[end - length[token]] << 32 | token
                if (ok := known.get(key)) is None:
                    at = bisect_right(lacks, key >> 32 << 32 | number[token]) - 1
                    ok = known[key] = at < 0 or lacks[at] >> 32 != key >> 32 or upto[at] <= number[token]
                if ok:
                    break
                token = shorter[token]
            last.append(token)
            rows.append(row[token])
        if len(known) > REMEMBERED:
            known.clear()
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= length[last[at]]
        return np.array(out[::-1], "<u4").tobytes()


class Remembered:
    """Ids of numbered pieces: a piece that is asked for in vain gets the next number, and its ids when ``settle`` is called, so
    each piece of a text is looked up once. What was there before the table filled up is kept as ``older``."""

    def __init__(self):
        self.older, self.older_ids = {}, []
        self.start()

    def start(self) -> None:
        self.number, self.ids, self.kept, self.new, self.back = defaultdict(count().__next__), [], 0, [], []

    def numbers(self, pieces: list[str]) -> list[int]:
        return list(map(self.number.__getitem__, pieces))

    def lost(self) -> list[str]:
        """Pieces that got a number since ``trim`` and that the older table lacks too."""
        self.new = list(islice(reversed(self.number), len(self.number) - self.kept))[::-1]
        self.back = list(map(self.older.get, self.new))
        return [key for key, x in zip(self.new, self.back, strict=True) if x is None]

    def settle(self, ids: list[bytes]) -> None:
        """The ids of what was ``lost``, in its order."""
        made, older = iter(ids), self.older_ids
        self.ids += [next(made) if x is None else older[x] for x in self.back]

    def joined(self, numbers: list[int]) -> bytes:
        return b"".join(map(self.ids.__getitem__, numbers))

    def trim(self) -> None:
        """Called when the texts that asked are done."""
        for key in [key for key in self.new if len(key) > REMEMBERED_CHARS]:
            self.ids[self.number.pop(key)] = b""
        self.kept, self.new, self.back = len(self.number), [], []
        if len(self.ids) > REMEMBERED:
            self.older, self.older_ids = self.number, self.ids
            self.start()


class Encoder:
    """Encodes and decodes texts by an automaton."""

    def __init__(self, tables: dict, added: list[tuple[str, int]]):
        self.walker = Walker(tables)
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in added}
        self.split = regex.compile(PRE_SPLIT.replace(r"\s", f"[{SPACE}]").replace(f"[^[{SPACE}]", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]")).findall
        self.chunks = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        self.other = re.compile(f"[^{PLAIN}]").search
        self.ascii, self.plain = (re.compile(f" ?[{x}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^{SPACE}{x}0-9]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall for x in ("A-Za-z", LATIN))
        self.found, self.runs = Remembered(), Remembered()
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        label = list(tables["label"]) + [b""] * (max([i for _, i in added], default=-1) + 1 - len(tables["label"]))
        for s, i in added:
            label[i] = s.encode()
        self.sizes = np.array([len(x) for x in label], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.labels = np.frombuffer(b"".join(label), np.uint8)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as little-endian unsigned 32-bit integers.

        Plain texts are pre-split as they are. In others white-space runs and the words after them are split first, as the
        pre-split never looks past them. What no table holds of all texts is walked at once.
        """
        asked = [[self._asked(x) if k % 2 == 0 else self.special[x] for k, x in enumerate(self.added.split(text) if self.added else [text])] for text in texts]
        split = [self.found.numbers(self.split(x)) for x in self.runs.lost()]
        self.found.settle(self.walker.words([w.encode() for w in self.found.lost()]))
        self.runs.settle(list(map(self.found.joined, split)))
        out = [b"".join([x if isinstance(x, bytes) else x[0].joined(x[1]) for x in parts]) for parts in asked]
        self.found.trim()
        self.runs.trim()
        return out

    def _asked(self, text: str) -> tuple[Remembered, list[int]]:
        if text.isascii():
            return self.found, self.found.numbers(self.ascii(text))
        if self.other(text):
            return self.runs, self.runs.numbers(self.chunks(text))
        return self.found, self.found.numbers(self.plain(text))

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The labels of the arcs, as UTF-8 (what isn't is replaced)."""
        every = np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64)
        sizes = self.sizes[every]
        ends = np.cumsum(sizes)
        data = self.labels[np.repeat(self.starts[every] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *map(len, ids)])].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]


def load(path: str) -> tuple[dict, list[tuple[str, int]]]:
    """A byte-level vocabulary file of the tokenizers library to ``(automaton, added tokens)``."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"]
    if spec["normalizer"] or spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["post_processor"]:
        raise ValueError("only plain byte-level BPE files are supported")
    letters = byte_alphabet()
    raw = lambda s: bytes(letters[c] for c in s)
    added = [(x["content"], x["id"]) for x in spec["added_tokens"]]
    vocab = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in dict(added)}
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    return compile_automaton(vocab, [(raw(a), raw(b)) for a, b in merges]), added


def tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``id``, ``ids`` (array of int) and ``decoded``, the text that decoding the ids gives.

    Strings of added tokens become their ids, as in the library. Null texts are encoded as empty ones; other columns
    are ignored. The automaton is compiled once on the driver (its size is the vocabulary's) and broadcast.
    """
    spark = docs.sparkSession
    shared = _broadcast(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for b in slices(batches, 128):
            ids = [np.frombuffer(x, "<u4") for x in encoder.encode([x or "" for x in b.column(1).to_pylist()])]
            text = encoder.decode(ids)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(text, pa.string())], names=["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` of each document: digests of the ids as little-endian unsigned 32-bit
    integers and of the decoded text in UTF-8. Same rules as ``tokens``."""
    shared = _broadcast(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in slices(batches):
            ids = encoder.encode([x or "" for x in b.column(1).to_pylist()])
            text = encoder.decode([np.frombuffer(x, "<u4") for x in ids])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array([sha(x.encode()) for x in text], pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _broadcast(spark: SparkSession, path: str):
    auto, added = load(path)
    return spark.sparkContext.broadcast({"auto": auto, "added": added})


def _encoder(held: dict) -> Encoder:
    """One encoder, with what it remembers, for the life of a Python worker."""
    if "encoder" not in held:
        held["encoder"] = Encoder(held["auto"], held["added"])
    return held["encoder"]
