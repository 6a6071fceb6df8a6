import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import divergence, packing, prefixtrie, queries
from tests import oracle

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op11_radix_divergence", "op12_prefix_fingerprints"])
def test_query_equals_its_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    oracle.same(df.collect(), df.columns, oracle.connect(SF).sql(queries.ORACLE[name]))


# divergence


def plain_audit(rows):
    """The audit by full tables of rates."""
    docs = [(x or "", s or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t or ""))) for t, x, s in rows]
    out = []
    for lang in {x for x, _, _ in docs}:
        df = Counter(w for x, _, t in docs if x == lang for w in set(t))
        kept = [w for w, n in df.items() if n >= 10]
        counts = defaultdict(Counter)
        for x, s, t in docs:
            if x == lang:
                counts[s].update(w for w in t if w in set(kept))
        whole = sum(counts.values(), Counter())
        rate = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        q, p = rate(whole), {s: rate(c) for s, c in counts.items()}
        for s in counts:
            pair = [("pair", o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in counts if o != s]
            term = [("term", w, f(p[s][w], q[w])) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, most in ((pair, None), (term, 10)):
                out += [(lang, s, *x, k) for k, x in enumerate(sorted(part, key=lambda x: (-x[2], x[1].encode()))[:most], 1)]
    return sorted(out)


def texts(n, sources, seed):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["É", "é", "ß", "日本", "DOG", "dog"]
    return [(" ".join(rng.choices(words, k=rng.randrange(30))) + rng.choice(["", "!", "\x00A9b", " a_b^c"]), rng.choice(["de", "en", None]), f"s{rng.randrange(sources)}") for _ in range(n)]


@pytest.mark.parametrize("sources,block", [(6, 64), (9, 2)])
def test_audit_equals_full_tables(spark, monkeypatch, sources, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "HELD", 40)
    rows = [*texts(250, sources, sources), (None, "de", "empty"), ("", None, None), ("a b " * 9, "xx", "alone"), ("zz", "yy", "1"), ("zz", "yy", "2")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit("x") for c in ("term", "n", "idx", "p", "value", "part")}).repartition(5)
    assert sorted(map(tuple, divergence.audit(df).collect())) == plain_audit(rows)
    assert divergence.audit(df.limit(0)).count() == 0


def test_audit_of_odd_rows(odd):
    got = divergence.audit(odd.unionByName(odd)).collect()
    assert {(r.lang, r.source) for r in got} <= {("en", "a"), ("en", "b"), ("en", "c"), ("en", ""), ("", ""), ("", "c"), ("fr", "b")}
    assert {(r.value, r.rank) for r in got if r.lang == ""} == {(0, 1)}


def test_very_long_texts_are_split_alike(monkeypatch):
    text = "aB1 éÀ\tdog9Dog ".encode() * 50
    whole = divergence.terms_of(text)
    monkeypatch.setattr(divergence, "_LONG", 10)
    assert list(divergence.terms_of(text)) == whole == "ab éÀ dog dog".encode().split() * 50


@pytest.mark.parametrize("sorted_rows", [0, 4, 4096])
def test_radix_select_equals_a_sort(spark, sorted_rows):
    rng = random.Random(7)
    words = sorted({"".join(rng.choices("abé日\x7f", k=rng.randrange(1, 7))) for _ in range(400)})
    rows = [(g, w, v) for g in "ABC" for w in words for v in [rng.choice([0, 5, 5, 5, 1 << 20, 1 << 29, (1 << 30) - 1]) if g != "C" else 3]]
    rows += [("D", "only", 1), ("E", "x", 0), ("E", "xy", 0), ("E", "xyz", 0)]
    got = divergence.top_k(spark.createDataFrame(rows, "g string, item string, value long").repartition(3), ["g"], 3, sorted_rows=sorted_rows)
    want = []
    for g in "ABCDE":
        want += [(g, w, v, k) for k, (_, w, v) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1].encode()))[:3], 1)]
    assert sorted((r.g, r["item"], r.value, r["rank"]) for r in got.collect()) == sorted(want)


# packing


def test_plan_fills_bins_within_all_capacities():
    rng = np.random.default_rng(3)
    for score in ("norm", "dot"):
        for limits in ({}, {"max_docs": 3}, {"max_cost": 40_000}, {"max_docs": 5, "max_cost": 90_000}):
            size = np.clip(rng.lognormal(4, 1, 3000).astype(int), 1, 200)
            counts = dict(zip(*(x.tolist() for x in np.unique(size, return_counts=True)), strict=True))
            rows, bins = packing.plan(counts, capacity=256, score=score, **limits)
            where, held = packing.lookup(rows), defaultdict(list)
            for n, many in counts.items():
                for b, o in zip(*(x.tolist() for x in packing.place(where, np.full(many, n), np.arange(many))), strict=True):
                    held[b].append((o, n))
            assert len(held) == bins and sorted(n for v in held.values() for _, n in v) == sorted(size.tolist())
            for v in held.values():
                at = 0
                for o, n in sorted(v):
                    assert o == at
                    at += n
                assert at <= 256 and len(v) <= limits.get("max_docs", 256) and sum(n * n for _, n in v) <= limits.get("max_cost", 1 << 16)
            least = max(size.sum() / 256, len(size) / limits.get("max_docs", 256), (size**2).sum() / limits.get("max_cost", 1 << 16))
            assert bins >= least and (limits or bins <= 1.01 * least + 2 if score == "norm" else True)


def test_plan_is_no_worse_than_best_fit_piece_by_piece():
    rng = random.Random(5)
    for _ in range(20):
        size = [rng.randrange(1, 65) for _ in range(rng.randrange(1, 300))]
        left = []
        for n in sorted(size, reverse=True):
            fit = min((k for k, x in enumerate(left) if x >= n), key=lambda k: left[k], default=None)
            left.append(64 - n) if fit is None else left.__setitem__(fit, left[fit] - n)
        assert packing.plan(Counter(size), capacity=64)[1] <= len(left) + 1
    rows, bins = packing.plan({3: 10**12 + 1, 61: 10**12}, capacity=64)
    assert bins == 10**12 + 1 and len(rows) < 10
    with pytest.raises(ValueError):
        packing.plan({65: 1}, capacity=64)


def test_pieces():
    crc = lambda a, b: zlib.crc32(np.arange(a, b, dtype="<u4").tobytes())
    ids = lambda n: np.arange(n, dtype="<u4").tobytes()
    assert packing.pieces_of(ids(4), 4) == [(0, 4, crc(0, 4))]
    assert packing.pieces_of(ids(8), 4) == [(0, 4, crc(0, 4)), (4, 4, crc(4, 8))]
    assert packing.pieces_of(ids(9), 4) == [(0, 1, crc(0, 1)), (1, 4, crc(1, 5)), (5, 4, crc(5, 9))]


def check_packed(rows, documents, capacity):
    """Every piece of every document once, sequences gapless and within capacity; returns how many sequences."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.no_truncation()
    tok.no_padding()
    want = Counter()
    for i, t in documents:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        want.update((i, k, *p) for k, p in enumerate(packing.pieces_of(ids, capacity)))
    assert Counter((r.id, r.piece, r.start, r.length, r.crc) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence].append((r.offset, r.length))
    for v in held.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= capacity
    return len(held), sum(r.length for r in rows)


def test_packed_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.pack(docs.repartition(7), queries.byte_bpe_path()).collect()
    bins, tokens = check_packed(got, docs.select("doc_id", "text").collect(), 1024)
    assert bins <= 1.005 * tokens / 1024 + 2


def test_packed_odd_rows(odd):
    got = packing.pack(odd, queries.byte_bpe_path(), capacity=64, max_docs=3).collect()
    check_packed(got, odd.select("doc_id", "text").collect(), 64)
    assert max(Counter(r.sequence for r in got).values()) <= 3
    assert packing.pack(odd.limit(0), queries.byte_bpe_path()).count() == 0


# prefix trie


def plain_trie(rows):
    """The trie by dictionaries of whole prefixes."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(w)] for c, w in own.items()}
    node, ends = defaultdict(list), defaultdict(list)
    for c, w in own.items():
        root = int(np.fix(c / 100)) * 100
        h = zlib.crc32(str(c).encode()) % 6
        w = tuple(w if c == root else [*own.get(root, [])[:h], *w[h:]])
        ends[w].append(c)
        for d in range(len(w) + 1):
            node[w[:d]].append(c)
    kids = Counter(p[:-1] for p in node if p)
    out = []
    for p, m in node.items():
        below = [q for q in node if q[: len(p)] == p]
        saved = sum((len(node[q]) - 1) * len(q[-1][1]) for q in below if q)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(m), len(p), min(node[p[:-1]]) if p else None, len(m), kids[p], sum(not kids[q] for q in below), saved, sha))
    return sorted(out, key=str)


def chats(seed, many=220, turns=9):
    rng = random.Random(seed)
    rows = []
    for _ in range(many):
        c = rng.choice([rng.randrange(260), rng.randrange(-120, 5), 10**12 + rng.randrange(30)])
        for t in range(rng.randrange(turns)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "bot", None]), rng.choice(["", "a", "aé", None, "😀😀"])))
    rows += [(7, t, "user", f"t{t % 3}") for t in range(900)] + [(None, 1, "user", "lost")]
    rows += [(300 + k, t, "user", "same") for k in range(90) for t in range(4)]
    return rows + rows[:40]


def collected(out):
    return sorted(map(tuple, out.select("conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


@pytest.mark.parametrize("moduli", [prefixtrie.MODULI, (5, 3), (7, 1)])
def test_trie_equals_dictionaries(spark, moduli):
    """Small moduli make fingerprints collide; groups are split until all texts agree."""
    rows = chats(sum(moduli))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("d", "key", "rep", "n", "body", "kind")})
    assert collected(prefixtrie.trie(df.repartition(5), moduli=moduli)) == plain_trie(rows)


def test_groups_over_many_partitions(spark, monkeypatch):
    """Groups that span partitions, and numbers that are handed on in chunks."""
    monkeypatch.setattr(prefixtrie, "CHUNK", 20)
    rows = chats(4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        assert collected(prefixtrie.trie(df)) == plain_trie(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefixtrie.trie(df).count() == 0
    one = spark.createDataFrame([(142, 0, None, "x" * 300_000)], df.schema)
    assert [r.n_convs for r in prefixtrie.trie(one).collect()][0] == 1


def test_prefix_sums_are_polynomials():
    rng = np.random.default_rng(1)
    x, fresh = rng.integers(0, 1 << 63, 50).astype(np.uint64), rng.random(50) < 0.2
    depth, want, s, d = [], [], 11, 6
    for v, f in zip(x.tolist(), fresh.tolist(), strict=True):
        s, d = (0, 0) if f else (s, d)
        d += 1
        s = (s + v * pow(12345, d, 101)) % 101
        depth.append(d)
        want.append(s)
    assert prefixtrie.prefix_sums(x, np.array(depth), fresh, 11, 12345, 101).tolist() == want
