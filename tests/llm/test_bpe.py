"""Streaming BPE and token counts against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusmill.llm.bpe_count import merged_count, token_counts
from corpusmill.llm.bpe_stream import Borders, Encoder, Transducer, decode_ids, encode_decode, sufficient_lookahead
from corpusmill.llm.vocab import Memo, Vocabulary, read_vocabulary, vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a", "don't it's we'll 'tis '' 's", "<|endoftext|>", "x<|endoftext|> <|endoftext|>y", "日本語 text  \n\n\t mixed 🎉👍🏽 ÿþ ½²", "a" * 3000, "ab" * 900,
    " " * 300 + "x", "\x85\xa0 \x1c\x1d z", "é" * 500, "\n".join("word" * (i % 7) for i in range(200)),
]


@pytest.fixture(scope="module")
def vocab():
    return vocabulary(read_vocabulary(PATH))


def expected(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_queries_agree_with_the_library(spark):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("etaoin shrdlu'.,!0123\n é—") for _ in range(rng.randrange(80))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int").repartition(3)
    want = expected(texts)
    for r in encode_decode(df, PATH, keep_ids=True).collect():
        ids = want[r["doc_id"]]
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    for r in token_counts(df, PATH, limit=20).collect():
        n = len(want[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((texts[r["doc_id"]] or "").encode()), n, n > 20)
    assert encode_decode(df.limit(0), PATH).count() == token_counts(df.limit(0), PATH).count() == 0


def test_any_portions_give_the_same_tokens_with_bounded_state(vocab):
    rng = random.Random(2)
    t = Transducer(vocab, Borders(vocab))
    lookahead = sufficient_lookahead(vocab)
    for data in (b"a" * 2000, b"abcab" * 400, bytes(rng.choice(b"thein g") for _ in range(3000)).replace(b" ", b"e"), "é¡".encode() * 300):
        whole = t.feed(data) + t.finish()
        parts, at, held = [], 0, 0
        while at < len(data):
            n = rng.randrange(1, 40)
            parts += t.feed(data[at : at + n])
            held, at = max(held, len(t.tail)), at + n
        parts += t.finish()
        assert parts == whole and len(whole) == merged_count(vocab, data)
        assert held <= lookahead


def test_decoder_breaks_anywhere(vocab):
    ids = np.array([i for t in ("héllo 🎉", "�") for i in expected([t])[0]])
    assert "".join(decode_ids(vocab, ids)) == "héllo 🎉�"
    lone = np.array([vocab.byte_ids[0xC3], vocab.byte_ids[0x41]])
    assert "".join(decode_ids(vocab, lone)) == Tokenizer.from_file(PATH).decode(lone.tolist(), skip_special_tokens=False)


def test_memo_is_bounded():
    m = Memo(len, limit=10)
    assert [m["x" * (i % 50)] for i in range(500)] == [i % 50 for i in range(500)]
    assert len(m) <= 10 and len(m.older) <= 10


def test_the_lookahead_bounds_what_is_pending(vocab):
    """With the bound as it is, tokens are right and never more bytes are pending, whether or not the ways meet."""
    bound = sufficient_lookahead(vocab)
    for data in (b"ab" * 40_000, b"a" * 70_000, "é".encode() * 30_000, b"abcdefgh" * 9_000):
        t, out, held = Transducer(vocab, Borders(vocab)), [], 0
        for at in range(0, len(data), 4096):
            out += t.feed(data[at : at + 4096])
            held = max(held, len(t.tail))
        out += t.finish()
        assert held <= bound + 5 * vocab.longest
        assert b"".join(vocab.strings[i] for i in out) == data
        assert len(out) == merged_count(vocab, data)


def test_a_forced_lookahead_gives_the_same_tokens(vocab):
    """Where the bound decides (here a small one that suffices for these bytes), tokens stay the same."""
    rng = random.Random(4)
    for _ in range(20):
        data = bytes(rng.choice(b"ethaonis") for _ in range(5000))
        small, whole = Transducer(vocab, Borders(vocab), lookahead=400), Transducer(vocab, Borders(vocab))
        got = small.feed(data) + small.finish()
        assert got == whole.feed(data) + whole.finish() and len(got) == merged_count(vocab, data)


def test_a_text_of_many_megabytes(spark):
    """One long text with a giant piece: the digests are those of the whole, and ids are never gathered."""
    part = "The quick brown fox, 12345 times; " * 60_000
    text = part + "x" * 300_000 + " end"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (ids,) = expected([text])
    (r,) = encode_decode(df, PATH).collect()
    assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    (c,) = token_counts(df, PATH).collect()
    assert c["n_tokens"] == len(ids)


def test_few_lookups_for_each_byte_and_none_for_known_starts(vocab):
    """Of the tokens that end at a place only the longest is looked up; what stands at a piece's first bytes is kept."""

    class Counted(dict):
        n = 0

        def get(self, *key):
            self.n += 1
            return super().get(*key)

    rng = random.Random(8)
    data = [bytes(rng.choice(b"etaoinshr") for _ in range(20)) for _ in range(300)]
    own = read_vocabulary(PATH)
    enc, want = Encoder(Vocabulary(own)), expected([x.decode() for x in data])
    getattr(enc.vocab, "endings", None)  # built by lookups of its own
    counted = enc.vocab.merged = Counted(enc.vocab.merged)
    assert [np.frombuffer(enc._piece(x), "<u4").tolist() for x in data] == want
    assert counted.n < 2.8 * sum(map(len, data))
    counted.n = 0
    assert [np.frombuffer(enc._piece(x), "<u4").tolist() for x in data] == want
    assert counted.n < 2.5 * sum(map(len, data))


def test_answers_and_kept_starts_are_bounded(vocab, monkeypatch):
    from corpusmill.llm import bpe_stream

    monkeypatch.setattr(bpe_stream, "HEADS", 7)
    rng = random.Random(9)
    data = [bytes(rng.choice(b"etaoinshr \xc3\xa9") for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    t = Transducer(vocab, Borders(vocab, limit=50))
    for x in data:
        assert len(t.whole(x)) == merged_count(vocab, x)
        assert len(t.heads) <= 7 and t.borders.held == sum(len(a) for a in t.borders.known if a) <= 50
