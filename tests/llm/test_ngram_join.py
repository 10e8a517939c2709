"""The n-gram Jaccard join and its components against brute force."""

import random
import re

import pytest

from corpusmill.llm import ngram_join
from corpusmill.llm.graph import components
from corpusmill.llm.ngram_join import Join, similar_groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, join):
    sets = {}
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + join.words]) for i in range(len(w) - join.words + 1)} if len(w) >= join.words else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and join.den * inter >= join.num * (len(sets[a]) + len(sets[b]) - inter):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((d, len(sets[d]), root(d)) for d in ids)


def corpus(seed, chain=40):
    rng = random.Random(seed)
    vocab = [f"W{i}" for i in range(200)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, docs = prose(60), [(0, None), (1, ""), (2, " \t"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "a a a a a a"), (7, "a a a")]
    d = 10
    for size in (30, 100, 200):
        base = prose(size)
        for _ in range(chain):  # drifting copies: many links, chains that only meet through others
            docs.append((d, " ".join(base)))
            d += 1
            if rng.random() < 0.7:
                base = list(base)
                base[rng.randrange(size)] = rng.choice(vocab)
    for _ in range(60):
        docs.append((d, " ".join(prose(rng.randrange(5, 40)) + passage + prose(rng.randrange(0, 20)))))
        d += 1
    for k in range(30):  # wholly of the common passage, cut differently
        docs.append((d, " ".join(passage[k % 6 : 60 - k % 5])))
        d += 1
    for _ in range(40):
        docs.append((d, " ".join(prose(rng.randrange(1, 80)))))
        d += 1
    rng.shuffle(docs)
    return docs


#: Short lists, pairs a member, rows a task holds of a list, rows of a part of a frequent list, levels.
@pytest.mark.parametrize(
    ("join", "bounds"),
    [(Join(3, 90, 100), (16, 8, 1000, 2048, 3)), (Join(), (3, 0, 1000, 2048, 3)), (Join(3, 90, 100), (2, 0, 9, 5, 2)), (Join(5, 80, 100), (2, 0, 9, 5, 1))],
)
def test_against_brute_force(spark, join, bounds, monkeypatch):
    for name, value in zip(("SHORT_LIST", "FEW_PAIRS", "LIST_ROWS", "PART_ROWS", "LEVELS"), bounds, strict=True):
        monkeypatch.setattr(ngram_join, name, value)
    monkeypatch.setattr(ngram_join, "HUB_MEMBERS", 7)
    docs = corpus(join.words)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in similar_groups(df, join).collect()) == brute(docs, join)


def edited(rng, base, vocab, most):
    """A copy with up to `most` words replaced, dropped or put in."""
    out = list(base)
    for _ in range(rng.randrange(most + 1)):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice(([], [rng.choice(vocab)], [out[at], rng.choice(vocab)]))
    return out


@pytest.mark.parametrize(("join", "most"), [(Join(3, 90, 100), 12), (Join(5, 80, 100), 14)])
def test_a_large_group_of_near_copies(spark, join, most, monkeypatch):
    """Many edits of one text: members in one component, alone and in small ones, all in the same posting lists."""
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 4)
    monkeypatch.setattr(ngram_join, "FEW_PAIRS", 1)
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocab) for _ in range(120)]
    docs = [(i, " ".join(edited(rng, base, vocab, most))) for i in range(350)]
    chain = docs[-1][1].split()
    docs += [(1000 + i, " ".join(chain := edited(rng, chain, vocab, 2))) for i in range(60)]
    got = similar_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), join).collect()
    assert sorted(tuple(r) for r in got) == brute(docs, join)


def test_words_of_a_weak_hash_differ(spark):
    """Long words of two letters in opposite orders have one value under a polynomial modulo 2**64."""
    x, y = "a", "b"
    while len(x) < 4096:
        x, y = x + y, y + x
    got = similar_groups(spark.createDataFrame([(1, x), (2, y), (3, f"{x} q r"), (4, f"{y} q r")], "doc_id long, text string"), Join(3, 90, 100)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 4)]


def test_edges_of_input(spark):
    assert similar_groups(spark.createDataFrame([], "doc_id long, text string, node long")).count() == 0
    t = "a b c d e f g h"
    rows = [(5, t, 1), (5, t, 2), (None, t, 3), (5, "x y z u v w", 4), (None, None, 5)]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in similar_groups(spark.createDataFrame(rows, "doc_id long, text string, node long")).collect()]
    assert sorted(got, key=str) == sorted([(5, 4, 5), (5, 4, 5), (None, 4, 5), (5, 2, 5), (None, 0, None)], key=str)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {(r["node"], r["label"]) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {x for x in parent if all(a == b for a, b in edges if x in (a, b))}
    assert got == {(x, root(x)) for x in parent if x not in alone}
