"""Source divergence audit: which terms set a source apart from its language, and how far its sources are from each other.

Counts are turned into integer rates, so every figure is exact. Top terms are selected by radix, pairs of sources by sums of
what differs from the rates of absent terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.text import slices
from tessera.storage import materialize

#: Terms need this many documents of their language; rates are counted in parts of SCALE, after PRIOR is added to each count.
LEAST_DOCS, SCALE, PRIOR = 10, 1_000_000_000, 2
#: Distinct terms that a task counts before it hands them on, and sources of a block of pairs.
HELD, BLOCK = 200_000, 64
#: Bits of a value, and of one histogram of the selection; ties of at most SORTED rows a group are ranked without refining.
VALUE_BITS, DIGIT_BITS, SORTED = 30, 10, 4096
#: Bytes to letters in lower case or a space: terms are runs of ASCII letters and of bytes above 127.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_LONG = 1 << 22


def terms_of(text: bytes) -> Iterator[bytes] | list[bytes]:
    """Terms of a text in UTF-8; those of a very long one come one by one."""
    text = text.translate(_LETTERS)
    return text.split() if len(text) < _LONG else (m.group() for m in re.finditer(rb"[^ ]+", text))


def term_counts(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, source, term, n, docs``: partial counts of a task's texts, to be summed. Nulls are empty strings.

    Each group that occurs also has a row with the empty term, so groups without terms are seen too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in count.items():
                some = list(n)
                for at in range(0, len(some), 50_000):
                    part = some[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([d[t] for t in part], pa.int64())],
                        names=["lang", "source", "term", "n", "docs"],
                    )
            count.clear()

        for b in batches:
            for s in slices([b]):
                for lang, source, text in zip(s.column(0).to_pylist(), s.column(1).to_pylist(), s.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    if (held := count.get((lang, source))) is None:
                        held = count[lang, source] = (Counter({b"": 0}), Counter())
                    n, d = held
                    words = terms_of(text)
                    if isinstance(words, list):
                        n.update(words)
                        d.update(set(words))
                    else:
                        own = Counter(words)
                        n.update(own)
                        d.update(own.keys())
                if sum(len(n) for n, _ in count.values()) > HELD:
                    yield from hand_on()
        yield from hand_on()

    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    return docs.select(*plain).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def rate(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)) of three columns, in integers; null where there are no terms."""
    above = f"CAST({count} + {PRIOR} AS decimal(20,0)) * CAST({SCALE} AS decimal(10,0))"
    return F.expr(f"1 + ({above}) div nullif(CAST({total} + {PRIOR} * {terms} AS decimal(20,0)), 0)")


def divergence(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); the same with p and q exchanged."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def rated(docs: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """``(terms, groups)``: counts of the kept terms by group, and one row a group with its totals and the rate of absent terms.

    Terms are counted in tasks, so a hot term or source costs a task some rows; one shuffle by language and term
    sums them, takes the language's counts and drops rare terms.
    """
    key = Window.partitionBy("lang", "term")
    terms = term_counts(docs, **columns).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = terms.withColumns({"docs": F.sum("docs").over(key), "lang_n": F.sum("n").over(key), "first": F.min("source").over(key) == F.col("source")})
    terms = materialize(terms.where(F.col("docs") >= F.when(F.col("term") == "", 0).otherwise(LEAST_DOCS)).drop("docs"), "terms")
    groups = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(F.col("first") & (F.col("term") != "")).alias("firsts"))
    lang = Window.partitionBy("lang")
    groups = groups.withColumns({"lang_total": F.sum("total").over(lang), "v": F.sum("firsts").over(lang), "idx": F.row_number().over(lang.orderBy("source")) - 1}).withColumn("zero", F.lit(0))
    groups = groups.withColumn("p0", F.coalesce(rate("zero", "total", "v"), F.lit(1)).cast("long")).drop("firsts", "zero")
    return terms.where("term <> ''").drop("first"), materialize(groups, "groups")


def audit(docs: DataFrame, *, k: int = 10, **columns: str) -> DataFrame:
    """``lang, source, part, item, value, rank``: of each group, all other sources of the language by divergence (``pair``) and
    the ``k`` terms that it has more of than its language (``term``); largest value first, ties in the order of UTF-8 bytes.

    Null texts, languages and sources are empty strings, repeated rows are documents of their own, groups without terms take
    part, an empty table gives an empty result, other columns are ignored. The result has a row for each ordered pair of
    sources of a language, as asked for; no other step makes pairs.
    """
    terms, groups = rated(docs, **columns)
    known = terms.join(groups, ["lang", "source"]).withColumns({"p": rate("n", "total", "v"), "q": rate("lang_n", "lang_total", "v")})
    above = known.where("p > q").select("lang", "source", F.col("term").alias("item"), divergence("p", "q").alias("value"))
    top = top_k(above, ["lang", "source"], k).withColumn("part", F.lit("term"))
    pairs = pair_values(known.select("lang", "term", "idx", "p"), groups)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    return pairs.unionByName(top).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


def _boundary(rows: DataFrame, group: list[str], digit: Column, descending: bool) -> DataFrame:
    """Of ``rows(*group, need, ...)``, the digit in which each group's ``need``-th row falls, and how many it needs of that digit.
    Groups with fewer rows are absent."""
    order = F.desc("digit") if descending else F.asc("digit")
    run = F.sum("n").over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    held = rows.groupBy(*group, "need", digit.alias("digit")).agg(F.count("*").alias("n")).withColumn("run", run)
    first = (F.max_by if descending else F.min_by)(F.struct("digit", (F.col("need") - F.col("run") + F.col("n")).alias("need")), "digit")
    return held.where("run >= need").groupBy(*group).agg(first.alias("x")).select(*group, F.col("x.digit").alias("edge"), F.col("x.need").alias("left"))


def top_k(rows: DataFrame, group: list[str], k: int, *, bits: int = VALUE_BITS, sorted_rows: int = SORTED) -> DataFrame:
    """The ``k`` rows of each group with the largest ``value`` (whole numbers from 0, below ``2**bits``), ties by the bytes of ``item``: with ``rank``.

    Radix select. Histograms over the bits of the values, from the top, each of the rows that share the bits before, find
    the value of the k-th row: all rows above it are taken. Ties at that value are cut by histograms over two bytes of the
    item at a time, until a group has few. Only what is taken is sorted: at most ``k + sorted_rows`` rows a group.
    """
    rows = materialize(rows.select(*group, "item", "value"), "valued")
    state = None
    for shift in range(bits - DIGIT_BITS, -DIGIT_BITS, -DIGIT_BITS):
        shift = max(shift, 0)
        digit = F.shiftright("value", shift)
        if state is None:
            part = rows.withColumn("need", F.lit(k).cast("long"))
        else:
            part = rows.join(state, group).where(F.shiftright("value", last) == F.col("edge")).withColumn("need", F.col("left"))
        state, last = materialize(_boundary(part, group, digit, True), "boundary"), shift
    marked = rows.join(state, group, "left")
    taken = marked.where("edge IS NULL OR value > edge").select(*group, "item", "value")
    ties = materialize(marked.where("value = edge").select(*group, "item", "value", F.col("left").alias("need")), "ties")
    at = 1
    while ties.groupBy(*group, "need").count().where(f"count > need AND count > {sorted_rows}").limit(1).count():
        digit = F.hex(F.substring(F.col("item").cast("binary"), at, 2))
        cut = ties.join(_boundary(ties, group, digit, False), group)
        taken = materialize(taken.unionByName(cut.where(digit < F.col("edge")).select(*group, "item", "value")), "taken")
        ties = materialize(cut.where(digit == F.col("edge")).select(*group, "item", "value", F.col("left").alias("need")), "ties")
        at += 2
    order = Window.partitionBy(*group).orderBy(F.desc("value"), "item")
    return taken.unionByName(ties.drop("need")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pair_values(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value``: the sum of divergences over all kept terms, for each two sources of a language.

    Sources are numbered within their language and dealt to blocks. A term in neither of two sources adds the divergence of
    their rates of absent terms, so all terms add V times that, and only a term's own sources correct it: a row holds
    the rates of one term in one or two blocks. Tasks add the corrections of all pairs of blocks in arrays, and give one row a pair.
    """
    blocks = groups.groupBy("lang", F.expr(f"CAST(idx div {BLOCK} AS int)").alias("block"), "v").agg(F.sort_array(F.collect_list(F.struct("idx", "p0"))).alias("m"))
    blocks = blocks.select("lang", "block", "v", F.col("m.p0").alias("p0"))
    other = blocks.select(F.col("lang").alias("lang_"), F.col("block").alias("j"), F.col("p0").alias("b0"))
    frames = materialize(blocks.join(other, (F.col("lang") == F.col("lang_")) & (F.col("block") <= F.col("j"))).select("lang", F.col("block").alias("i"), "j", F.col("p0").alias("a0"), "b0", "v"), "frames")
    terms = terms.withColumn("block", F.expr(f"CAST(idx div {BLOCK} AS int)"))
    keys = frames.select("lang", "i", "j")
    ends = keys.select("lang", F.col("i").alias("block"), "i", "j").unionByName(keys.where("i < j").select("lang", F.col("j").alias("block"), "i", "j"))
    rows = terms.join(ends, ["lang", "block"]).groupBy("lang", "i", "j", "term").agg(F.collect_list(F.struct("idx", "p")).alias("m"))
    rows = rows.select("lang", "i", "j", F.col("m.idx").alias("idx"), F.col("m.p").alias("p")).join(frames.drop("v"), ["lang", "i", "j"]).withColumn("times", F.lit(1).cast("long"))
    base = frames.select("lang", "i", "j", F.array().cast("array<int>").alias("idx"), F.array().cast("array<long>").alias("p"), "a0", "b0", F.col("v").alias("times"))
    summed = rows.select(*base.columns).unionByName(base).mapInArrow(_corrections, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = summed.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"), "value").select("lang", "x.a", "x.b", "value")
    names = groups.select("lang", F.col("idx").alias("a"), "source")
    return both.join(names, ["lang", "a"]).join(names.select("lang", F.col("a").alias("b"), F.col("source").alias("item")), ["lang", "b"]).select("lang", "source", "item", "value")


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over rows by pair of blocks. A row without rates counts ``times`` the divergence of absent terms, others what they change of it."""
    sums: dict[tuple[str, int, int], np.ndarray] = {}
    f = lambda p, q: (p - q) ** 2 // (p + q)

    def hand_on() -> Iterator[pa.RecordBatch]:
        for (lang, i, j), m in sums.items():
            a, b = np.nonzero(np.triu(np.ones(m.shape, bool), 1) if i == j else np.ones(m.shape, bool))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a + BLOCK * i, pa.int32()), pa.array(b + BLOCK * j, pa.int32()), pa.array(m[a, b])], names=["lang", "a", "b", "value"])
        sums.clear()

    for batch in batches:
        for s in slices([batch], 128):
            lang, i, j, idx, p, a0, b0, times = (s.column(k) for k in range(8))
            keys = list(zip(lang.to_pylist(), i.to_pylist(), j.to_pylist(), strict=True))
            for key in dict.fromkeys(keys):
                rows = [r for r, k in enumerate(keys) if k == key]
                a, b = np.array(a0[rows[0]].as_py(), np.int64), np.array(b0[rows[0]].as_py(), np.int64)
                base, many = f(a[:, None], b[None]), len(rows)
                left, right = np.tile(a, (many, 1)), np.tile(b, (many, 1))
                n = pa.compute.list_value_length(idx).to_numpy(zero_copy_only=False)[rows]
                who = np.array([x for r in rows for x in idx[r].as_py()], np.int64)
                own, at = np.array([x for r in rows for x in p[r].as_py()], np.int64), np.repeat(np.arange(many), n)
                for side, block in ((left, key[1]), (right, key[2])):
                    here = who // BLOCK == block
                    side[at[here], who[here] - BLOCK * block] = own[here]
                more = f(left[:, :, None], right[:, None, :]).sum(axis=0) - base * many
                more += base * int(sum(times[r].as_py() for r in rows if not len(idx[r])))
                sums[key] = sums[key] + more if key in sums else more
            if len(sums) > 2000:
                yield from hand_on()
    yield from hand_on()
