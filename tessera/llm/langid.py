"""Language identification by prediction by partial matching (PPM): the language whose frozen statistics code a text shortest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import slices, where_arrow

UNKNOWN = "und"
#: Longest context in bytes. A text is coded as if this many line feeds came before it.
ORDER = 4
#: Training documents a language (expected, drawn by a hash of the id), and languages that are learned: the most frequent.
SAMPLE_DOCS, MOST_LANGS = 2_000, 256
#: Code lengths are kept in units of 2**-20 bits: sums are exact in any order.
UNIT = float(1 << 20)
#: Bytes coded at once; numbers in the table of costs that a task fills as it meets (context, byte) pairs.
WINDOW, COSTS = 1 << 18, 1 << 22
#: A text fits no learned language above so many times the code length a byte that all but a hundredth of the labelled
#: training documents keep to, less so many bits of any text: short ones vary.
TIMES, SLACK_BITS = 2.0, 64.0


def remainder(id_: Column) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % 5


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def _grams(data: bytes, order: int) -> np.ndarray:
    """Each byte with the ``order`` bytes before it, the oldest in the highest place; ``data`` starts with the padding."""
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    out = a[order:].copy()
    for k in range(1, order + 1):
        out |= a[order - k : len(a) - k] << np.uint64(8 * k)
    return out


def pair_counts(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, order: int, sample_docs: int, langs: int) -> DataFrame:
    """``(lang, gram, n)`` of the drawn training documents: all (context, byte) pairs with their counts."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    rows = rows.where("lang is not null and t is not null and id is not null").where(remainder(F.col("id")) != 0)
    held = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(langs).withColumn("rate", F.least(F.lit(1.0), F.lit(float(sample_docs)) / F.col("count")))
    draw = (F.xxhash64(F.lit("ppm"), F.col("id").cast("string")).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)).alias("u")
    drawn = rows.join(F.broadcast(held.select("lang", "rate")), "lang").where(draw < F.col("rate")).select("lang", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pad = b"\n" * order
        for b in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(_grams(pad + _bytes(text), order))
            for lang, parts in by.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    return drawn.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def context_tree(grams: np.ndarray, counts: np.ndarray, order: int) -> list[dict[str, np.ndarray]]:
    """Of each context length from 0: pairs and their counts, contexts with totals and distinct bytes, and what the
    shorter context's total has of the bytes seen here (PPM excludes them after an escape; they are seen there too)."""
    tree: list[dict[str, np.ndarray]] = []
    for k in range(order + 1):
        pair, inv = np.unique(grams & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
        n = np.bincount(inv, counts).astype(np.float64)
        context, inv = np.unique(pair >> np.uint64(8), return_inverse=True)
        level = {"pair": pair, "n": n, "context": context, "total": np.bincount(inv, n), "distinct": np.bincount(inv).astype(np.float64)}
        if k:
            below = tree[-1]
            at = np.searchsorted(below["pair"], pair & np.uint64((1 << 8 * k) - 1))
            level["excluded"] = np.bincount(inv, below["n"][at])
        tree.append(level)
    return tree


def _find(where: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(where, what), len(where) - 1)
    return at, where[at] == what


def code_length(tree: list[dict[str, np.ndarray]], grams: np.ndarray) -> np.ndarray:
    """Bits of each (context, byte) pair: escape method C with exclusion, down to equal shares of the bytes never seen."""
    bits, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
    gone, bytes_gone = np.zeros(len(grams)), np.zeros(len(grams))
    for k in range(len(tree) - 1, -1, -1):
        level = tree[k]
        c, met = _find(level["context"], grams >> np.uint64(8) & np.uint64((1 << 8 * k) - 1))
        p, seen = _find(level["pair"], grams & np.uint64((1 << 8 * (k + 1)) - 1))
        distinct = level["distinct"][c] - bytes_gone
        whole = level["total"][c] - gone + distinct
        hit, miss = open_ & met & seen, open_ & met & ~seen
        bits[hit] += np.log2(whole[hit] / level["n"][p[hit]])
        esc = miss & (distinct > 0)
        bits[esc] += np.log2(whole[esc] / distinct[esc])
        open_ &= ~hit
        if k:
            gone = np.where(miss, level["excluded"][c], 0.0)
            bytes_gone = np.where(miss, level["distinct"][c], 0.0)
        else:
            bits[miss] += np.log2(np.maximum(1.0, 256 - level["distinct"][c[miss]]))
    return bits


class Coder:
    """Exact code lengths of texts under each language; costs of pairs are looked up in a table filled as they come."""

    def __init__(self, trees: list[list[dict[str, np.ndarray]]], order: int):
        self.trees, self.order = trees, order
        self.bits = max(10, (COSTS // len(trees)).bit_length() - 1)
        self.keys = np.full(1 << self.bits, np.uint64(1 << 63))
        self.costs = np.zeros((1 << self.bits, len(trees)), np.int64)

    def _costs(self, grams: np.ndarray) -> np.ndarray:
        slot = ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.costs[slot]
        other = np.flatnonzero(self.keys[slot] != grams)
        if len(other):
            new, inv = np.unique(grams[other], return_inverse=True)
            cost = np.stack([np.rint(code_length(t, new) * UNIT).astype(np.int64) for t in self.trees], axis=1)
            out[other] = cost[inv]
            at = slot[other][np.unique(inv, return_index=True)[1]]
            free = self.keys[at] == np.uint64(1 << 63)
            at, new, cost = at[free], new[free], cost[free]
            at, first = np.unique(at, return_index=True)
            self.keys[at], self.costs[at] = new[first], cost[first]
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Of each text and language, in units of 2**-20 bits. Long texts go through in windows."""
        pad = b"\n" * self.order
        data = pad + pad.join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes + self.order)
        starts = ends - sizes
        out = np.zeros((len(texts), len(self.trees)), np.int64)
        for a in range(self.order, len(data), WINDOW):
            b = min(a + WINDOW, len(data))
            run = np.zeros((b - a + 1, len(self.trees)), np.int64)
            np.cumsum(self._costs(_grams(data[a - self.order : b], self.order)), axis=0, out=run[1:])
            i, j = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
            out[i:j] += run[np.minimum(ends[i:j], b) - a] - run[np.maximum(starts[i:j], a) - a]
        return out


ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return text is not None and (ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


class Model:
    """Trees of the learned languages, in the order of their code points."""

    def __init__(self, langs: list[str], trees: list, order: int):
        self.langs, self.trees, self.order = langs, trees, order

    def predictor(self):
        langs, coder = self.langs, Coder(self.trees, self.order) if self.langs else None

        def predict(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
            """Shortest code (ties: the first language), its share of the probability of the text under equal priors, and its
            bits a byte beyond ``SLACK_BITS``."""
            lang, score, rate = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if has_letter(t)] if coder else []
            for at in range(0, len(known), 512):
                some = known[at : at + 512]
                data = [_bytes(texts[i]) for i in some]
                n = coder.lengths(data)
                rate[some] = np.maximum(0.0, n.min(axis=1) / UNIT - SLACK_BITS) / [len(d) for d in data]
                best = n.argmin(axis=1)
                share = 1 / np.exp2(np.maximum((n.min(axis=1, keepdims=True) - n) / UNIT, -1000)).sum(axis=1)
                score[some] = share
                for i, k in zip(some, best.tolist(), strict=True):
                    lang[i] = langs[k]
            return lang, score, rate

        return predict


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, sample_docs: int = SAMPLE_DOCS, langs: int = MOST_LANGS) -> Model:
    """Learn from text and language of documents whose crc32(id as text) mod 5 is not 0.

    The sample is bounded by ``sample_docs`` documents (expected) of each of the ``langs`` most frequent languages; all its pairs
    come to the driver.
    """
    counts = pair_counts(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, order=order, sample_docs=sample_docs, langs=langs)
    got = counts.groupBy("lang").agg(F.collect_list("gram").alias("gram"), F.collect_list("n").alias("n")).toArrow()
    found = got["lang"].to_pylist()
    trees = [context_tree(got["gram"][i].values.to_numpy().view(np.uint64), got["n"][i].values.to_numpy(), order) for i in range(len(found))]
    ranked = sorted(range(len(found)), key=found.__getitem__)
    return Model([found[i] for i in ranked], [trees[i] for i in ranked], order)


def _shared(docs: DataFrame, model: Model):
    held = docs.sparkSession.sparkContext.broadcast((model.langs, model.trees, model.order))
    return lambda: Model(*held.value).predictor()


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``id``, ``held_out``, ``lang_pred``, ``score``.

    A null text, a text without a letter, and any text where nothing could be learned are ``und`` with score 0. A null id
    has no remainder: it is not learned from and ``held_out`` is false. Repeated rows count each, an empty table gives
    an empty result, texts may be of any length, other columns are ignored.
    """
    make = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = make()
        for b in slices(batches):
            lang, score, _ = predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score)], names=["id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(remainder(F.col(id_col)) == 0, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double")


def worst_fit(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> float:
    """``TIMES`` the bits a byte that 99 in 100 of all labelled training documents keep to; infinite where there are none.

    Counted by hundredths of a bit, so what comes to the driver is bounded and does not depend on the order of rows.
    """
    make = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = make()
        for b in slices(batches):
            lang, _, rate = predict(b.column(0).to_pylist())
            step = np.ceil(100 * rate[np.array(lang, object) != UNKNOWN]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(step, pa.int64())], names=["step"])

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (remainder(F.col(id_col)) != 0)).select(F.col(text_col).cast("string").alias("t"))
    held = sorted((r[0], r[1]) for r in rows.mapInArrow(run, "step long").groupBy("step").count().collect())
    if not held:
        return float("inf")
    upto = np.cumsum([n for _, n in held])
    return TIMES * held[int(np.searchsorted(upto, 0.99 * upto[-1]))][0] / 100


def keep_known(docs: DataFrame, model: Model, *, text_col: str = "text", least: float = 0.5, most: float = float("inf")) -> DataFrame:
    """``docs`` without documents in no known language: those that are ``und``, whose score is below ``least``, or that
    even their best language codes in more than ``most`` bits a byte (see ``worst_fit``): the score compares languages only."""
    make = _shared(docs, model)

    def tests():
        predict = make()

        def keep(text: pa.Array) -> np.ndarray:
            lang, score, rate = predict(text.to_pylist())
            return (np.array(lang, object) != UNKNOWN) & (score >= least) & (rate <= most)

        return keep

    return where_arrow(docs, [text_col], tests)
