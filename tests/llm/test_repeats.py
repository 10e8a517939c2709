"""Substring dedup over words and over bytes against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from corpusmill.llm.bwt_merge import Shard, dedup_bytes, merge, whole_characters
from corpusmill.llm.suffix_tree import SuffixTree, dedup_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_words(docs, window):
    first, out = {}, []
    words = {d: WORD.findall(t or "") for d, t in docs}
    for d, _ in docs:
        for i in range(len(words[d]) - window + 1):
            key = tuple(words[d][i : i + window])
            first[key] = min(first.get(key, d), d)
    for d, _ in docs:
        gone = set()
        for i in range(len(words[d]) - window + 1):
            if first[tuple(words[d][i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words[d]) if i not in gone)
        out.append((d, len(words[d]), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def brute_bytes(docs, window):
    first, out = {}, []
    for d, t in sorted(docs):
        b = (t or "").encode()
        for i in range(len(b) - window + 1):
            first.setdefault(b[i : i + window], (d, i))
    for d, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - window + 1):
            if first[b[i : i + window]] < (d, i):
                gone[i + 1 : i + window + 1] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(x for i, x in enumerate(b) if not gone[i + 1])
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(300)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passages = [prose(n) for n in (50, 51, 60, 90, 20)]
    docs = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "a " * 300), (5, "a " * 260 + "b"), (6, "x" * 700), (7, "x" * 450), (8, "ab" * 200)]
    for d in range(10, 90):
        text = prose(rng.randrange(0, 120))
        for p in rng.sample(passages, rng.randrange(0, 3)):
            text += rng.choice([" ", "\n"]) + p + " " + prose(rng.randrange(0, 30))
        docs.append((d, text))
    docs += [(d + 100, t) for d, t in docs[20:40]] + [(200 + i, passages[3]) for i in range(12)]
    docs += [(300, " ".join([passages[0]] * 3)), (301, (passages[2] + " ") * 2)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("many", [10_000, 2])
def test_words(spark, many):
    docs = corpus(1)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in dedup_words(df, many=many).collect())
    assert got == brute_words(docs, 50)
    assert sum(r[2] for r in got) > 1000


@pytest.mark.parametrize("many", [10_000, 2])
def test_bytes(spark, many):
    docs = corpus(2)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in dedup_bytes(df, many=many).collect())
    assert got == brute_bytes(docs, 100)
    assert sum(r[2] for r in got) > 1000


def opposite(n):
    """Two sequences of two letters that have one value under any polynomial modulo 2**64, if they are long enough."""
    x, y = "a", "b"
    while len(x) < n:
        x, y = x + y, y + x
    return x, y


def test_texts_against_weak_hashes(spark):
    x, y = opposite(1024)
    rest = " ".join(f"u{i}" for i in range(49))
    docs = [(1, f"{x} {rest}"), (2, f"{y} {rest}"), (3, x * 2), (4, y * 2), (5, " ".join(x)), (6, " ".join(y))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for many in (10_000, 1):
        assert sorted(tuple(r) for r in dedup_words(df, many=many).collect()) == brute_words(docs, 50)
        assert sorted(tuple(r) for r in dedup_bytes(df, many=many).collect()) == brute_bytes(docs, 100)


def test_a_text_longer_than_a_slice(spark):
    rng = random.Random(6)
    long = " ".join(str(rng.randrange(10**9)) for _ in range(150_000))
    docs = [(1, long), (2, long[400_000:900_000]), (3, "tail " + long[-700:])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in dedup_bytes(df).collect()}
    assert got == {1: (len(long), 0), 2: (500_000, 500_000), 3: (705, 700)}
    got = {r["doc_id"]: r["n_removed"] for r in dedup_words(df).collect()}
    assert got[1] == 0 and got[2] >= len(docs[1][1].split()) - 2 and got[3] >= len(docs[2][1].split()) - 2


def test_empty_clashing_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, gram long, th int, ranges string")
    assert dedup_words(empty).count() == 0 and dedup_bytes(empty).count() == 0
    text = " ".join(f"u{i}" for i in range(80))
    rows = [(1, text, 5, "x"), (1, text, 6, "y"), (2, text, None, None), (None, text, 1, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gram long, doc string")
    for op, total in ((dedup_words, 80), (dedup_bytes, len(text))):
        got = [(r["doc_id"], r["n_removed"]) for r in op(df).collect()]
        assert sorted(got, key=str) == sorted([(1, 0), (1, 0), (2, total), (None, total)], key=str)


def test_merged_transforms_sort_all_suffixes():
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 12))) for _ in range(9)]
    shards = [Shard(strings[i : i + 3]) for i in (0, 3, 6)]
    source, inner, common = merge(shards, 20)
    got = []
    for s, i in zip(source, inner, strict=True):
        at = shards[s].suffixes[i]
        got.append((strings[3 * s + shards[s].owner[at]][shards[s].place[at] :], 3 * s + shards[s].owner[at]))
    assert got == sorted(got)
    for i in range(1, len(got)):
        a, b = got[i - 1][0], got[i][0]
        n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert common[i] == n


def test_tree_nodes():
    seqs = [np.array([1, 2, 3, 1, 2]), np.array([1, 2, 3])]
    tree = SuffixTree(seqs, 3)
    by_node = {}
    for n, s in zip(tree.nodes(2), tree.sorted, strict=True):
        by_node.setdefault(int(n), []).append((int(tree.owner[s]), int(tree.place[s])))
    assert sorted(map(sorted, by_node.values())).count([(0, 0), (0, 3), (1, 0)]) == 1


def test_whole_characters():
    body = "aéb".encode()
    assert whole_characters(body, [(2, 4)]) == [(3, 4)]
    assert whole_characters(body, [(0, 2)]) == [(0, 1)]
