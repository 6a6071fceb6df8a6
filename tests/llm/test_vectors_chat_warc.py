import base64
import hashlib
import json
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, neardup_vectors, queries, warc
from tests import oracle


def test_query_equals_its_sql(spark, sf):
    df = queries.op4_spherical_kmeans_neardup(spark, sf)
    oracle.same(df.collect(), df.columns, oracle.connect(sf).sql(queries.VECTORS_SQL))


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(neardup_vectors, "CELL", 40)
    monkeypatch.setattr(neardup_vectors, "BLOCK", 16)
    monkeypatch.setattr(neardup_vectors.block_links, "__defaults__", (16,))


def test_cells_and_blocks_lose_no_link(spark, small_cells):
    """Clusters with near copies, many cells and blocks, against all pairs."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    x = np.concatenate([base[rng.integers(0, 30, 260)] + rng.normal(0, 0.12, (260, 16)), rng.normal(size=(80, 16))]).astype(np.float32)
    x[7] = x[3]
    label = [i % 2 for i in range(len(x))]
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], label[i]) for i in range(len(x))], "vec_id long, embedding array<float>, label int")
    got = {r.id: (r.n_links, r.component, r.kept) for r in neardup_vectors.near_duplicate_vectors(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None])
    np.fill_diagonal(s, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min([root[i], *root[s[i]]]) for i in range(len(x))])
        if (new == root).all():
            break
        root = new
    assert s.sum() > 500
    assert got == {i: (int(s[i].sum()), int(root[i]), int(root[i]) == i) for i in range(len(x))}


def test_doubles_are_compared_as_doubles(spark):
    rows = [(1, [1e-50, 0.0], 0), (2, [2e-50, 0.0], 0), (3, [0.0, 1e39], 0), (4, [0.0, 2e39], 0), (5, [1.0, 1.0], 0)]
    got = {r.id: (r.n_links, r.component) for r in neardup_vectors.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5)}


def test_query_makes_cells(spark, sf):
    """The production settings run k-means on the small table too."""
    _, nodes = neardup_vectors.nodes_of(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"), "vec_id", "embedding", "label")
    cells = neardup_vectors.centroids(nodes)
    assert cells and all(len(c) >= 2 for c in cells.values())


def test_vector_edges(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [2.0, 0.0], 0), (4, [0.0, 0.0], 0), (5, None, 0), (6, [1.0, None], 0), (7, [float("nan"), 1.0], 0), (8, [1.0, 0.0], None), (9, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0), (10, [float("inf"), 0.0], 0), (11, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"node": F.lit(1), "cell": F.lit(2), "weight": F.lit(3)})
    got = [(r.id, r.n_links, r.component, r.kept) for r in neardup_vectors.near_duplicate_vectors(df).collect()]
    assert sorted(x for x in got if x[0] in (1, 2, 3)) == [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 3, 1, False)]
    assert all((i, 0, i, True) in got for i in (4, 5, 6, 7, 8, 9, 10, 11)) and (None, 0, None, False) in got
    assert neardup_vectors.near_duplicate_vectors(df.limit(0)).count() == 0


# ---------------------------------------------------------------- transcripts


def brute_viterbi(score, move, start):
    from itertools import product

    best = max(product(range(chat.STATES), repeat=len(score)), key=lambda p: start[p[0]] + score[0, p[0]] + sum(move[a, b] + score[t + 1, b] for t, (a, b) in enumerate(zip(p, p[1:], strict=False))))
    return list(best)


def test_viterbi_and_transfer_by_enumeration():
    rng = np.random.default_rng(0)
    move, start, score = rng.normal(size=(6, 6)), rng.normal(size=6), rng.normal(size=(5, 6))
    path, value = chat.viterbi(score, move, start)
    assert list(path) == brute_viterbi(score, move, start)
    first, second = chat.transfer(score[:2], move), chat.transfer(score[2:], move)
    joined = (start[:, None] + first).max(0)[:, None] + move
    assert ((joined.max(0))[:, None] + second).max() == pytest.approx(value)


def test_long_conversations_are_decoded_like_short_ones(spark, sf, monkeypatch):
    raw = chat.raw_transcripts(spark.read.parquet(f"{sf}/conversations.parquet"))
    model = chat.fit(chat.lines_of(raw, role_col="role"))
    keys = ["conv", "pos", "tie", "at", "found"]
    assert chat.lines_of(raw).groupBy("conv").agg(F.countDistinct("block").alias("n")).agg(F.max("n")).first()[0] <= 2
    whole = sorted(map(tuple, chat.decode(chat.lines_of(raw), model).select(keys).collect()))
    monkeypatch.setattr(chat, "BLOCK", 2)
    assert chat.lines_of(raw).groupBy("conv", "block").count().agg(F.max("count")).first()[0] <= 2
    assert sorted(map(tuple, chat.decode(chat.lines_of(raw), model).select(keys).collect())) == whole


def test_held_out_roles_are_recovered(spark):
    conv = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    raw = chat.raw_transcripts(conv)
    fold = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 5
    model = chat.fit(chat.lines_of(raw.where(fold != 0), role_col="role"))
    lines = chat.decode(chat.lines_of(raw.where(fold == 0), role_col="role"), model)
    hit = [r.found == r.state for r in lines.where("at = 0").collect()]
    assert np.mean(hit) > 0.9
    turns = chat.parse(raw, model).collect()
    assert all(r.rendered == f"<|{r.role}|>\n{r.text.strip(' ')}\n<|end|>\n" for r in turns)


def test_chat_edges(spark):
    rows = [(1, 0, "user", "User: hi"), (1, 1, "assistant", "Assistant: hello\nthere"), (1, 1, "assistant", "Assistant: hello\nthere"), (2, None, "user", None), (None, 0, None, "Q: lonely"), (None, 0, None, "Q: other"), (3, 500, "user", "User: late"), (3, 2, "system", "System: " + "x" * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit(0), "pos": F.lit(0), "found": F.lit(0)})
    model = chat.fit(chat.lines_of(df, role_col="role"))
    out = chat.parse(df, model).collect()
    assert sum(r.text.count("\n") + 1 for r in out) == 10 and {r.conv_id for r in out} == {1, 2, 3, None}
    assert any(r.role == "user" and r.text == "hi" for r in out)
    twice = [r.text for r in sorted((r for r in out if r.conv_id == 1), key=lambda r: r.turn_no)]
    assert twice == ["hi", "hello\nthere", "hello\nthere"]
    assert chat.parse(df.limit(0), model).count() == 0


def test_messages_without_conversation_stay_apart(spark, sf):
    raw = chat.raw_transcripts(spark.read.parquet(f"{sf}/conversations.parquet"))
    model = chat.fit(chat.lines_of(raw, role_col="role"))
    df = spark.createDataFrame([(None, 0, "User: same"), (None, 0, "User: same"), (None, None, "User: same\nagain")], "conv_id long, turn long, text string")
    out = chat.parse(df, model).collect()
    assert len(out) == 3 and {r.turn_no for r in out} == {0}


def test_one_position_and_many_lines_make_many_blocks(spark, sf, monkeypatch):
    """A conversation whose messages all have one position, and a message of many lines, against one decoding of the whole."""
    raw = chat.raw_transcripts(spark.read.parquet(f"{sf}/conversations.parquet"))
    model = chat.fit(chat.lines_of(raw, role_col="role"))
    monkeypatch.setattr(chat, "BLOCK", 8)
    rows = [(1, None, f"User: question {i}?") for i in range(60)] + [(2, 0, "\n".join(f"Assistant: line {i}." for i in range(90)))]
    lines = chat.lines_of(spark.createDataFrame(rows, "conv_id long, turn long, text string"))
    got = sorted(lines.groupBy("conv", "block").count().select("conv", "count").collect())
    assert max(r["count"] for r in got) <= 8 and len(got) >= 19
    by = {}
    for r in sorted(chat.decode(lines, model).collect(), key=lambda r: r.seq):
        by.setdefault(r.conv, []).append(r)
    for rs in by.values():
        obs = np.array([[r.f0, r.f1, r.f2, r.f3] for r in rs])
        score = chat.emissions(model, obs)
        path, best = chat.viterbi(score, model["move"], model["start"])
        found = [r.found for r in rs]
        value = model["start"][found[0]] + score[range(len(rs)), found].sum() + sum(model["move"][a, b] for a, b in zip(found, found[1:], strict=False))
        assert value == pytest.approx(best)


# ---------------------------------------------------------------- web archives


def test_records_link_and_digest(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    source = {r.id: r for r in warc.responses(pages).collect()}
    out = warc.derive(warc.responses(pages)).collect()
    assert len(out) == 2 * pages.count() and len({r.record_id for r in out}) == len(out)
    b32 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    html = {r.page_id: r.html for r in pages.collect()}
    for r in out:
        s = source[r.id]
        assert r.refers_to == s.response_id and r.block_digest == b32(r.block) and r.source_digest == b32(html[r.id].encode()) and r.target_uri == s.target_uri
        if r.record_type == "metadata":
            env = json.loads(r.block)["Envelope"]
            assert env["WARC-Header-Metadata"]["WARC-Record-ID"] == s.response_id
            assert env["Payload-Metadata"]["HTTP-Response-Metadata"]["Headers"]["Content-Length"] == str(len(html[r.id].encode()))


def test_plain_text_and_metadata():
    page = "<!doctype html><head><title>A &amp; B</title><style>p{}</style></head><body><!-- x --><p>One <b>two</b><br>three</p><script>var t='</p>';</script><p>&lt;4&gt;</p><a data-href='no' href='/x?a=1&amp;b=2'>go</a></body>"
    assert warc.parsed(page) == ("One two\nthree\n<4>\ngo", {"Title": "A & B", "Metas": [], "Links": ["/x?a=1&b=2"]})
    assert warc.parsed("")[0] == "" and warc.parsed("a < b <script>unclosed")[0] == "a < b" and warc.parsed("x<y> z<")[0] == "x z<"


class Independent(HTMLParser):
    """Text, title, metas and links by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.title, self.metas, self.links, self.hidden, self.raw, self.in_title = [], None, [], [], None, None, False

    def edge(self, tag):
        if not self.hidden:
            self.out.append("\n" if tag in warc.BREAKS else " ")

    def handle_starttag(self, tag, attrs):
        if tag == "body" and self.hidden == "head":
            self.hidden = None
        self.edge(tag)
        if tag in ("head", "noscript", "template", "svg") and not self.hidden:
            self.hidden = tag
        self.raw = tag if tag in ("script", "style") else self.raw
        found = {}
        for k, v in attrs:
            found.setdefault(k, v or "")
        if tag == "meta":
            self.metas.append({k: v for k, v in found.items() if dict(attrs)[k] is not None})
        if tag == "a" and "href" in found:
            self.links.append(found["href"])
        self.in_title = tag == "title" and self.title is None
        self.title = "" if self.in_title else self.title

    def handle_endtag(self, tag):
        if tag == self.hidden:
            self.hidden = None
        self.raw = None if tag == self.raw else self.raw
        self.edge(tag)
        self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        if not self.hidden and not self.raw:
            self.out.append(data)

    def handle_comment(self, data):
        self.out.append(" ")


def test_query_equals_the_standard_parser(spark, sf):
    """Every text, title, meta and link of the pages table; block bytes of the query are what the operator gives."""
    out = {(r.id, r.record_type): r for r in warc.derive(warc.responses(spark.read.parquet(f"{sf}/pages.parquet"))).collect()}
    query = {(r.page_id, r.record_type): r for r in queries.op7_warc_derivatives(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        p = Independent()
        p.feed(r.html)
        p.close()
        text = "\n".join(x for line in "".join(p.out).split("\n") if (x := " ".join(line.split())))
        assert out[r.page_id, "conversion"].block.decode() == text
        found = json.loads(out[r.page_id, "metadata"].block)["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]
        assert found == {"Title": " ".join((p.title or "").split()) or None, "Metas": p.metas, "Links": p.links}
        for kind in ("conversion", "metadata"):
            assert query[r.page_id, kind].block_sha256 == hashlib.sha256(out[r.page_id, kind].block).hexdigest()


@pytest.mark.parametrize("piece", ["<a ", "<", "<p ", "<a href='", "<script>", "<!--", "</", "<title>", "<a b", "&", "<a aaaa", "<svg>", "x=", "<style></stylex", "< >"])
def test_hostile_pages_take_linear_time(piece):
    page = piece * (1_000_000 // len(piece))
    for p in (page, page + ">", "<a " + page + ">"):
        began = time.process_time()
        warc.parsed(p)
        assert time.process_time() - began < 5


def test_written_records_are_read_back(spark, sf):
    out = warc.derive(warc.responses(spark.read.parquet(f"{sf}/pages.parquet").limit(40)))
    want = {r.record_id: r for r in out.collect()}
    files = warc.serialized(out).groupBy(F.pmod(F.xxhash64("record_id"), F.lit(3))).agg(F.collect_list("warc").alias("w"))
    data = [b"".join(r.w) for r in files.collect()]
    got = warc.read(spark.createDataFrame([(bytearray(x),) for x in data], "warc binary")).collect()
    assert {r.headers["WARC-Record-ID"] for r in got} == want.keys() and len(got) == len(want)
    for r in got:
        w = want[r.headers["WARC-Record-ID"]]
        assert bytes(r.block) == bytes(w.block) and r.headers["WARC-Refers-To"] == w.refers_to and r.headers["WARC-Block-Digest"] == w.block_digest
    with pytest.raises(ValueError):
        list(warc.records_of(data[0] + b"junk\r\n\r\n"))


def test_warc_edges_and_bytes(spark):
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (None, "u", "<p>x"), (3, "u", "<div>" * 60_000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"payload": F.lit("x"), "id": F.lit("y"), "block": F.lit("z")})
    out = warc.derive(warc.responses(df))
    got = out.collect()
    assert len(got) == 10 and {bytes(r.block) for r in got if r.record_type == "conversion"} == {b"", b"x", b"deep"}
    for r in warc.serialized(out).collect():
        head, _, rest = bytes(r.warc).partition(b"\r\n\r\n")
        length = int(head.rsplit(b"Content-Length: ", 1)[1])
        assert head.startswith(b"WARC/1.0\r\n") and rest[length:] == b"\r\n\r\n" and f"WARC-Record-ID: {r.record_id}".encode() in head
    assert warc.derive(warc.responses(df.limit(0))).count() == 0
