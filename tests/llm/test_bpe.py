import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, queries


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(*bpe.load(queries.byte_bpe_path()))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.byte_bpe_path())


def ids(encoder, text):
    return np.frombuffer(encoder.encode([text])[0], "<u4").tolist()


def test_small_automaton_accepts_exactly_the_correct_tokenizations():
    """Every token sequence over a small vocabulary: accepted if and only if merging its text gives it."""
    merges = [(b"a", b"a"), (b"a", b"b"), (b"aa", b"b"), (b"b", b"aa"), (b"aa", b"aa")]
    used = [b"a", b"b", *(x + y for x, y in merges)]
    vocab = {t: i for i, t in enumerate([*used, *(bytes([c]) for c in range(256) if c not in b"ab")])}
    tables = bpe.compile_automaton(vocab, merges)
    walker = bpe.Walker(tables)

    def merged(text):
        parts = [bytes([c]) for c in text]
        while True:
            found = [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in merges]
            if not found:
                return parts
            r, i = min(found)
            parts[i : i + 2] = [b"".join(merges[r])]

    def accepts(seq):
        row = 0
        for t in seq:
            if not walker.has_arcs(np.array([row]), np.array([vocab[t]]))[0]:
                return False
            row = tables["row"][vocab[t]]
        return True

    def sequences(n):
        if n == 0:
            yield []
        for t in used:
            if len(t) <= n:
                for rest in sequences(n - len(t)):
                    yield [t, *rest]

    for n in range(1, 7):
        for seq in sequences(n):
            assert accepts(seq) == (merged(b"".join(seq)) == seq), seq
            word = b"".join(seq)
            want = np.array([vocab[t] for t in merged(word)], "<u4").tobytes()
            assert walker.words([word]) == [want] == [walker._alone(word)]


def test_random_strings(encoder, library):
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("aab -'s\t\n.ßèthein1 \x1c😀") for _ in range(rng.randrange(40)))
        assert ids(encoder, text) == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("text", ["", "<|endoftext|>a<|endoftext|><|endoftext", "-" * 500, "a" * 3000 + "b", "\x00\x01​", "x² ½ Ⅷ 12３", "=====  ====" * 30, "I'll don't 'S\r\n\r\n"])
def test_odd_strings(encoder, library, text):
    assert ids(encoder, text) == library.encode(text, add_special_tokens=False).ids


def test_table_equals_the_library(spark, docs, library):
    want = {}
    for r in docs.collect():
        x = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(x, skip_special_tokens=False)
        want[r.doc_id] = (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r[0]: tuple(r[1:]) for r in bpe.digests(docs, queries.byte_bpe_path()).collect()}
    assert got == want


def test_edges(odd, library):
    rows = bpe.tokens(odd, queries.byte_bpe_path()).collect()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert len(rows) == 12
    for r in rows:
        assert r.decoded == texts[r.id] and r.ids == library.encode(texts[r.id], add_special_tokens=False).ids
    assert bpe.tokens(odd.limit(0), queries.byte_bpe_path()).count() == 0


def test_full_tables_are_swapped(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 8)
    text = " ".join(f"w{i} again" for i in range(50))
    first = encoder.encode([text])
    assert encoder.encode([text]) == first


def test_long_words(encoder, library):
    """Words that go alone, and many of different lengths at once."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeinrstßж") for _ in range(n)) for n in (1, 2, 255, 256, 257, 5000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(words)] == [library.encode(w, add_special_tokens=False).ids for w in words]
    assert encoder.encode([]) == [] and encoder.decode([]) == []


def test_pairs_asked_again_are_not_searched_for(encoder, monkeypatch):
    walker = bpe.Walker(encoder.walker.t)
    row, token = np.array([0, 5, 9, 700]), np.array([40, 50, 60, 70])
    first = walker.has_arcs(row, token)

    def fail(*_):
        raise AssertionError("searched again")

    monkeypatch.setattr(np, "searchsorted", fail)
    assert (walker.has_arcs(row, token) == first).all()


def test_held_answers_that_push_each_other_out(encoder, library, monkeypatch):
    """Four slots for all pairs: an answer is only used for the pair that it was given to."""
    monkeypatch.setattr(bpe, "HELD", 2)
    walker, rng = bpe.Walker(encoder.walker.t), random.Random(9)
    words = ["".join(rng.choice("abcdeinrstßж") for _ in range(rng.randrange(1, 40))) for _ in range(500)]
    got = walker.words([w.encode() for w in words])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(w, add_special_tokens=False).ids for w in words]


def test_pieces_get_their_ids_after_the_texts_asked(monkeypatch):
    """New pieces are lost once, long ones are not kept, older ones come back from the table before."""
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    table, long = bpe.Remembered(), "x" * (bpe.REMEMBERED_CHARS + 1)
    asked = []
    for pieces in (["a", "b", "a", long], ["a", "c", long], ["c", "b", "d"]):
        numbers = table.numbers(pieces)
        asked.append(table.lost())
        table.settle([x[:2].upper().encode() for x in asked[-1]])
        assert table.joined(numbers) == "".join(x[:2].upper() for x in pieces).encode()
        table.trim()
    assert asked == [["a", "b", long], ["c", long], ["b", "d"]]
