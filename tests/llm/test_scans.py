"""Language ID, license scans, packing, decontamination and the pipeline on small tables."""

import math
import random
import re
import subprocess
import sys
from pathlib import Path
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import decontam, licenses, packing, ppm

WORDS = {"en": "the and of to in is that for it as with was on are by this be from or an".split(), "de": "der die und das ist nicht ein von zu mit auf für sich dem den auch wird über".split(), "fr": "le la les des et est une pour que dans qui sur pas au avec plus par où été".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def language_rows(n=400):
    rng = random.Random(4)
    langs = [rng.choice(list(WORDS)) for _ in range(n)]
    return [(i, prose(rng, g, rng.randrange(5, 40)), g) for i, g in enumerate(langs)]


def test_language_id(spark):
    rows = language_rows() + [(1000, None, "en"), (1001, "123 !!", "de"), (1002, "", None), (1003, "der die das", None), (1003, "der die das", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = ppm.train_and_identify(df, F.col("lang").alias("true")).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 1000]
    assert sum(r["true"] == r["lang_pred"] for r in held) >= 0.97 * len(held) > 50
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got if r["doc_id"] >= 1000}
    assert odd[1000] == odd[1001] == odd[1002] == ("und", 0.0) and odd[1003][0] == "de"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert ppm.train_and_identify(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in ppm.train_and_identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_code_lengths_are_those_of_the_context_tree():
    rng = random.Random(1)
    train = [(g, prose(rng, lang, 30).encode()) for lang in ("en", "de") for g in [("de", "en").index(lang)] for _ in range(3)]
    grams, langs, counts = [], [], {0: {}, 1: {}}
    for g, text in train:
        data = np.frombuffer(text, np.uint8)
        own = ppm.padded_grams(data, np.array([0, len(data)]))
        grams.append(own)
        langs += [g] * len(own)
        padded = b"\0\0\0" + text
        for i in range(3, len(padded)):
            for k in range(4):
                at = counts[g].setdefault(padded[i - k : i], {})
                at[padded[i]] = at.get(padded[i], 0) + 1
    every = np.concatenate(grams)
    model = ppm.fit(["de", "en"], every, np.array(langs), np.ones(len(every)))

    def cost(g, context, byte):
        seen = counts[g].get(context, {})
        n, q = sum(seen.values()), len(seen)
        if byte in seen:
            return -math.log2(seen[byte] / (n + q))
        lower = cost(g, context[1:], byte) if context else 8
        return lower + (-math.log2(q / (n + q)) if n else 0)

    for text in (b"der und zz", "für x".encode(), b"q"):
        padded = b"\0\0\0" + text
        want = [sum(cost(g, padded[i - 3 : i], padded[i]) for i in range(3, len(padded))) for g in (0, 1)]
        data = np.frombuffer(text, np.uint8)
        assert np.allclose(model.code_lengths(data, np.array([0, len(data)]))[0], want, atol=1e-3)


def test_licenses(spark):
    texts = ["CC BY", "cc by cc by-sa cc by", None, "", "All rights reserved. general public license é cc by 4.0", "SPDX-License-Identifier: Apache-2.0 \n MIT License", "mit " * 30, "Licensed under the Apache License, Version 2.0. " * 60, "accby ccby", "CC BY"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in enumerate(texts):
        w, places, labels = word.findall((t or "").translate(lower)), [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            hits = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            places += hits
            labels |= {label} if hits else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r["labels"].split(",")) or not labels
    assert got[5]["labels"] == "apache,mit" and got[5]["score"] == 1.0 and got[6]["labels"] == "" and got[7]["labels"] == "apache"
    assert licenses.scan(df.limit(0)).count() == 0


def test_license_suppression(spark):
    """Every kept detection lies in no other of its priority or a higher one, by brute force over all rules."""
    text = "Licensed under the GNU Lesser General Public License version 2.1 or any later version; creative commons attribution-sharealike 4.0; SPDX-License-Identifier: MIT"
    norm = " " + re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", text.lower()) + " "
    found = [(m.start(), m.end(), p, i, label) for i, (label, p, key, pattern) in enumerate(licenses.RULES) if f" {key}" in norm for m in re.finditer(f"(?<= )(?:{pattern})(?= )", norm)]
    kept = {d[4] for d in found if not any(e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2] and (e[:2] != d[:2] or (-e[2], e[3]) < (-d[2], d[3])) for e in found if e is not d)}
    (row,) = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert set(row["labels"].split(",")) == kept | {"gpl"} and "lgpl" in kept


def variants(pattern):
    """Texts that match: of every alternative, optional part and class each choice occurs, in all combinations of a rule's parts."""

    def of(parts):
        out = [""]
        for op, arg in parts:
            if op is sre.LITERAL:
                own = [chr(arg)]
            elif op is sre.IN:
                own = [chr(c) for kind, x in arg for c in ([x] if kind is sre.LITERAL else x)]
            elif op is sre.BRANCH:
                own = [x for branch in arg[1] for x in of(branch)]
            elif op is sre.SUBPATTERN:
                own = of(arg[3])
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                lo, hi, inner = arg
                own = ([""] if lo == 0 else []) + ([x * max(lo, 1) for x in of(inner)] if hi else [])
            else:
                assert op is sre.ANY
                own = ["x"]
            out = [a + b for a in out for b in own]
        return out

    return of(sre_parser.parse(pattern))


#: Sentences and a label that each must have, written without the rules.
LICENSE_TEXTS = [
    ("Released as 0BSD.", "0bsd"), ("This model uses the OpenRAIL-M License", "openrail"), ("a Responsible AI License", "openrail"), ("WTFPL, version 2", "wtfpl"),
    ("Do What The Fuck You Want To Public License", "wtfpl"), ("Creative Commons Attribution Share Alike 4.0", "cc-by-sa"), ("see license.txt file for details", "see-license"),
    ("Licensed under the Apache License, Version 2.0", "apache"), ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl"), ("// SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"), ("https://www.gnu.org/licenses/agpl-3.0.html", "agpl"),
    ("https://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa"), ("The Software shall be used for Good, not Evil.", "json"), ("(c) 2019. All Rights Reserved", "reserved"),
    ("under version 2 of the License, or (at your option) any later version", "gpl-or-later"), ("LGPLv2.1", "lgpl"), ("GPLv3", "gpl"), ("MIT License", "mit"), ("two-clause BSD license", "bsd-2-clause"),
    ("Mozilla Public License 2.0", "mpl"), ("Boost Software License - Version 1.0", "bsl"), ("Llama 3.1 Community License Agreement", "llama"), ("dual-licensed", "dual"), ("proprietary and confidential", "proprietary"),
]


def test_license_sentences(spark):
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LICENSE_TEXTS)], "doc_id long, text string")).collect()}
    assert not [(t, label, got[i]) for i, (t, label) in enumerate(LICENSE_TEXTS) if label not in got[i]]


def test_every_match_of_a_license_rule_has_its_keyword():
    missing = {(label, keyword, t) for label, _, keyword, pattern in licenses.RULES for t in variants(pattern) if f" {keyword}" not in f" {t} "}
    assert not missing, sorted(missing)[:20]


def test_gated_licenses_are_those_without_a_gate(spark):
    texts = []
    for _, priority, _, pattern in licenses.RULES:
        texts += variants(pattern)[:: 5 if priority == licenses.NAME else 1]
    texts = [f"a {t} b" for t in dict.fromkeys(texts)] + ["see the license file for", "See COPYING for details", "0BSD", "OpenRAIL-M", "just do what the fuck you want to", "noncommercial use only", "creative commons attribution share alike 4.0"]
    every = [(p, i, label, re.compile(f"(?<= )(?:{pattern})(?= )")) for i, (label, p, _, pattern) in enumerate(licenses.RULES)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    for r in licenses.scan(df).collect():
        norm = " " + re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", texts[r["doc_id"]].lower()) + " "
        found = [(m.start(), m.end(), p, i, label) for p, i, label, own in every for m in own.finditer(norm)]
        kept = [d[4] for d in found if not any(e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2] and (e[:2] != d[:2] or (-e[2], e[3]) < (-d[2], d[3])) for e in found if e is not d)]
        base = {label for phrase, label in licenses.BASE.items() if f" {phrase} " in norm}
        assert r["n_detections"] == len(kept) and r["labels"] == ",".join(sorted({*kept} | base)), norm


def test_packing(spark):
    rng = random.Random(3)
    texts = [None, "", "a", "word " * 500] + [prose(rng, "en", rng.randrange(1, 90)) for _ in range(60)] + ["a"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int").repartition(2)
    rows = packing.packed_rows(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256, capacity=64, carry_positions=True, buffer_tokens=700).collect()
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        enc = packing.encoding(f.read(), public_tokenizers.PATTERN)
    assert isinstance(enc, tiktoken.Encoding)
    found: dict = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u2")
        assert len(ids) == 64 and r["cu_seqlens"][-1] == r["n_tokens"] <= 64 and (ids[r["n_tokens"] :] == 50256).all()
        for d, part, a, b, p in zip(r["doc_ids"], r["parts"], r["cu_seqlens"][:-1], r["cu_seqlens"][1:], r["position_starts"], strict=True):
            found[d, part] = ids[a:b].tolist()
            assert p == part * 64
        pos = packing.positions(r["cu_seqlens"], r["position_starts"], 64)
        assert [pos[a] for a in r["cu_seqlens"][:-1]] == r["position_starts"]
        want = [x for a, b, p in zip(r["cu_seqlens"][:-1], r["cu_seqlens"][1:], r["position_starts"], strict=True) for x in range(p, p + b - a)]
        assert np.frombuffer(r["positions"], "<i4").tolist() == want + [0] * (64 - len(want)) == pos.tolist()
    for i, t in enumerate(texts):
        parts = [found[k] for k in sorted(k for k in found if k[0] == i)]
        assert sum(parts, []) == [*enc.encode_ordinary(t or ""), 50256]


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, 101) for _ in range(300)]
    room: list[int] = []
    for x in sorted(lengths, reverse=True):  # the plain search
        fit = min((r for r in room if r >= x), default=None)
        if fit is None:
            room.append(100 - x)
        else:
            room[room.index(fit)] -= x
    bins = packing.best_fit_decreasing(lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(300))
    assert sorted(100 - sum(lengths[i] for i in b) for b in bins) == sorted(room)


def test_decontamination(spark):
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate((40, 40, 30, 5, 60))] + [(90, "too short"), (91, None), (92, "")]
    docs = [(i, text(rng.randrange(0, 150))) for i in range(40)]
    for k, (i, t) in enumerate(items[:5]):
        docs.append((100 + k, f"{text(20)} {t.upper()}, {text(10)}"))
        words = t.split()
        words[len(words) // 2] = "changed"
        docs.append((200 + k, f"{text(7)}\n{' '.join(words)} {text(9)}"))
    docs += [(300, None), (301, ""), (302, items[0][1]), (302, items[0][1])]

    def shingles(t):
        w = re.findall(r"[0-9a-z]+", (t or "").lower())
        return w, [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    sets = {i: (len(shingles(t)[0]), set(shingles(t)[1])) for i, t in items if len(shingles(t)[0]) >= 5}
    df_ = {s: sum(s in x for _, x in sets.values()) for _, x in sets.values() for s in x}
    weight = lambda s: math.log(1 + len(sets) / max(df_.get(s, 1), 1))
    want = set()
    for d, t in docs:
        _, own = shingles(t)
        for i, (size, x) in sets.items():
            for at in range(len(own) - (size - 4) + 1):
                window = set(own[at : at + size - 4])
                if sum(map(weight, window & x)) / sum(map(weight, window | x)) >= 0.8:
                    want.add((d, i))
    df = spark.createDataFrame([(d, t, "s") for d, t in docs], "doc_id long, text string, similarity string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.contaminated(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(rows) == len(want) + 1
    assert {(100 + k, k) for k in range(5)} <= want
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(df, bench, block=2, similarity=1.0).collect()} == {(d, i) for d, i in want if d < 200 or d >= 300}
    kept = decontam.clean(df, bench, "doc_id", "text", F.col("similarity").alias("extra"))
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontam.contaminated(df, bench.limit(0)).count() == 0 and decontam.contaminated(df.limit(0), bench).count() == 0


def test_decontamination_of_texts_shorter_than_an_item(spark):
    """Windows of min(item's words, text's words), by brute force; a near copy that lost a word is one."""
    rng = random.Random(12)
    vocab = [f"v{i}" for i in range(300)]
    items = [(i, [rng.choice(vocab) for _ in range(n)]) for i, n in enumerate((59, 59, 40, 15))]
    docs = []
    for i, w in items:
        docs += [(10 * i, w[: len(w) // 2] + w[len(w) // 2 + 1 :]), (10 * i + 1, w[:-1]), (10 * i + 2, w[1:]), (10 * i + 3, w[: len(w) // 2]), (10 * i + 4, w[:-8])]
    docs += [(100, items[0][1][:4]), (101, items[3][1][:5]), (102, items[1][1][3:] + items[3][1][:2])]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    sets = [grams(w) for _, w in items]
    weight = lambda s: math.log(1 + len(sets) / max(sum(s in x for x in sets), 1))
    want = {}
    for d, w in docs:
        for (i, item), x in zip(items, sets, strict=True):
            size = min(len(item), len(w))
            for at in range(len(w) - size + 1):
                window = grams(w[at : at + size])
                value = sum(map(weight, window & x)) / sum(map(weight, window | x))
                if value >= 0.8 and value > want.get((d, i), (0,))[0]:
                    want[d, i] = (value, at, size)
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (pytest.approx(r["similarity"]), r["first_word"], r["n_words"]) for r in decontam.contaminated(df, bench).collect()}
    assert got == want and {(0, 0), (1, 0), (2, 0), (11, 1)} <= set(want)
    assert {r["doc_id"] for r in decontam.clean(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_decontamination_in_blocks_weighs_as_in_one(spark):
    """Shingles that items of other blocks have too weigh the same as in one block; items without an id count."""
    rng = random.Random(21)
    vocab = [f"v{i}" for i in range(500)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    common = text(25)
    items = [(i, common + text(25) if i % 2 else text(40)) for i in range(11)] + [(None, text(30)), (None, common + text(20)), (20, ["short"])]
    docs = []
    for k, (_, w) in enumerate(items):
        for cut in range(0, min(len(w), 13)):  # words changed from either end: similarities on both sides of 0.8
            docs.append((100 * k + 2 * cut, text(6) + text(cut) + w[cut:] + text(6)))
            docs.append((100 * k + 2 * cut + 1, text(6) + w[: len(w) - cut] + text(cut)))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string").repartition(3)
    key = lambda r: (r["doc_id"], -1 if r["item_id"] is None else r["item_id"], round(r["similarity"], 9), r["first_word"], r["n_words"], r["distance"])
    want = sorted(map(key, decontam.contaminated(df, bench).collect()))
    for block in (1, 3):
        assert sorted(map(key, decontam.contaminated(df, bench, block=block).collect())) == want
    hit = {r[0] for r in want}
    assert {1100, 1200} <= {r[0] for r in want if r[1] == -1} and 20 < len(hit) < len(docs) - 20
    assert {r["doc_id"] for r in decontam.clean(df, bench, block=3).collect()} == {d for d, _ in docs} - hit


def test_hamming_blocks_find_all_within_the_radius():
    rng = random.Random(2)
    items = decontam.Items.of([(i, " ".join(f"w{rng.randrange(60)}" for _ in range(20))) for i in range(60)])
    for _ in range(200):
        h = np.uint64(rng.getrandbits(64))
        assert items.near(20, h) == [i for i in range(60) if int(items.hashes[i] ^ h).bit_count() <= decontam.RADIUS]


def test_pipeline(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, prose(rng, g, 120) + f" x{i} y{i}", g, "s", 0) for i in range(60) for g in [rng.choice(list(WORDS))]]
    item = " ".join(f"item{i}" for i in range(30))
    shared = " ".join(f"shared{i}" for i in range(60))
    rows += [(100, rows[3][1], "en", "s", 0), (101, None, "en", "s", 0), (102, "42 - 43", "de", "s", 0), (103, rows[5][1] + " " + item, "en", "s", 0)]
    rows += [(104, prose(rng, "en", 90) + " " + shared, "en", "s", 0), (105, prose(rng, "en", 95) + " " + shared + " end", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r["doc_id"]: r for r in docs.collect()})
    every = {r[0] for r in rows}
    assert set(seen[0]) == every - {101, 102}
    assert set(seen[1]) == set(seen[0]) - {100}
    assert set(seen[2]) == set(seen[1]) and shared[10:] not in seen[2][105]["text"] and shared in seen[2][104]["text"]
    assert set(seen[3]) == set(seen[2]) - {103} and set(seen[4]) == set(seen[3])
    assert all(set(x[104].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"} for x in seen[:4])
    assert sorted(r["ids_sha256"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(r["ids_sha256"] for r in seen[4].values())


def test_pipeline_rows_with_null_and_repeated_ids(spark, tmp_path):
    """Rows are documents: a null id loses none, a shared id joins none, and one of identical rows stays with its own columns."""
    rng = random.Random(16)
    text = lambda n=40: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b, c, d, e, f, g, h = (text() for _ in range(8))
    rows = [(1, a, "en", "s1"), (1, a, "en", "s1"), (1, b, "de", "s2"), (1, c, "fr", "s3"), (None, d, "en", "s4"), (None, e, "de", "s5"), (None, e, "de", "s5"), (None, a, "fr", "s6")]
    rows += [(2, f, "en", "s7"), (None, f, "de", "s8"), (3, f"{g} {h}", "en", "s9"), (3, f"{h} {text()}", "de", "s10"), (None, f"{g} {text()}", "fr", "s11")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    key = lambda rs: sorted(((r["doc_id"], r["lang"], r["source"]) for r in rs), key=str)
    near = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    want = [(1, "en", "s1"), (1, "de", "s2"), (1, "fr", "s3"), (None, "en", "s4"), (None, "de", "s5"), (2, "en", "s7"), (3, "en", "s9"), (3, "de", "s10"), (None, "fr", "s11")]
    assert key(near.collect()) == sorted(want, key=str)
    near.write.parquet(f"{tmp_path}/near")
    left = {r["source"]: r for r in corpus_pipeline.suffix_array_dedup(spark, spark.read.parquet(f"{tmp_path}/near"), str(tmp_path)).collect()}
    assert key(left.values()) == sorted(want, key=str) and all(r["n_chars"] == len(r["text"]) for r in left.values())
    # Of the two rows with id 3 the first in order of text keeps the common part; the null id comes after both.
    assert (h[20:] in left["s9"]["text"]) != (h[20:] in left["s10"]["text"])
    assert g in left["s9"]["text"] and g[20:] not in left["s11"]["text"]
    blank = spark.createDataFrame([(None, " ", "en", "s", 1), (None, " ", "en", "s", 1), (5, None, None, None, None)], docs.schema)
    assert sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, blank.where("doc_id is null"), "").collect()) == [(None, " ")]
    assert corpus_pipeline.near_duplicates(spark, blank, "").count() == 2


def test_languages_beyond_one_model(spark, monkeypatch):
    """Every language is learned, in several models too, and the best of all wins, with one posterior over all."""
    rng = random.Random(12)
    letters = {f"l{k:02d}": "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 8)) for k in range(7)}
    text = lambda lang: " ".join("".join(rng.choice(letters[lang]) for _ in range(6)) for _ in range(40))
    rows = [(i, text(lang), lang) for i, lang in enumerate(sorted(letters) * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one = {r["doc_id"]: r for r in ppm.train_and_identify(df).collect()}
    monkeypatch.setattr(ppm, "LANGS_OF_MODEL", 3)
    several = {r["doc_id"]: r for r in ppm.train_and_identify(df).collect()}
    for i, _, lang in rows:
        assert one[i]["lang_pred"] == several[i]["lang_pred"] == lang and abs(one[i]["score"] - several[i]["score"]) < 1e-6


def test_numbers_are_no_letters_and_null_ids_are_not_held_out(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "\u00bd", None), (3, "\u00b2\u00b2 \u2163", None), (None, "the cat", None), (5, "\u00e9", None)]
    got = {(r["doc_id"]): (r["lang_pred"], r["held_out"]) for r in ppm.train_and_identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[2][0] == got[3][0] == "und" and got[5][0] == got[None][0] == "en" and got[None][1] is False


def test_short_items_and_texts_are_one_shingle(spark):
    items = spark.createDataFrame([(1, "Paris, France!"), (2, "one"), (3, ""), (4, None), (None, "four words stand here")], "item_id long, text string")
    docs = spark.createDataFrame([(10, "paris france"), (11, "I saw Paris France twice"), (12, "ONE"), (13, ""), (14, None), (15, "Four words... stand here")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["similarity"]) for r in decontam.contaminated(docs, items).collect()}
    assert got == {(10, 1, 1.0), (12, 2, 1.0), (15, None, 1.0)}
    assert sorted(r["doc_id"] for r in decontam.clean(docs, items).collect()) == [11, 13, 14]


def test_each_stage_begins_without_the_memory_of_the_one_before(spark):
    """Each stage has executors collect what they no longer use: their collections are counted, the driver's own is one more."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory
    runs = lambda: sum(b.getCollectionCount() for b in beans.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        if name in ("suffix_array_dedup", "bpe_roundtrip"):
            before = runs()
            stage(spark, docs, "")
            assert runs() >= before + 2


WITHOUT_PANDAS = """
import sys
import numpy as np, pyarrow as pa
from corpusmill.llm.batches import flat_utf8, numbers, record_batch
schema = pa.schema([("a", pa.int64()), ("b", pa.int32()), ("c", pa.bool_()), ("d", pa.string()), ("e", pa.binary()), ("f", pa.float64()), ("g", pa.int16())])
columns = {"a": np.arange(5), "b": np.array([3.0, 2, 1, 0, -1]), "c": np.array([1, 0, 0, 1, 1], bool), "d": ["x", None, "", "é", "yy"], "e": [b"", b"1", b"3", None, b"2"], "f": np.array([0, 0.5, 1, np.nan, 2]), "g": [1, 2, 3, 4, 5]}
batch = record_batch(columns, schema)
assert numbers(batch.slice(1, 3).column(1)).tolist() == [2, 1, 0] and numbers(batch.column(0)).tolist() == [0, 1, 2, 3, 4]
assert flat_utf8(batch.column(3))[0].tobytes().decode() == "xéyy"
rows = batch.to_pylist()
assert "pandas" not in sys.modules
assert [str(r) for r in rows] == [str(r) for r in pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema).to_pylist()]
assert record_batch({k: [] for k in columns}, schema).num_rows == record_batch({k: v[:0] for k, v in columns.items()}, schema).num_rows == 0
for wrong in (np.array([0.5]), np.array([1 << 40])):
    try:
        record_batch({"b": wrong}, pa.schema([("b", pa.int32())]))
    except ValueError:
        continue
    raise AssertionError("a number that does not fit went through")
"""


def test_batches_of_workers_do_without_pandas():
    """pandas takes 27 MB of each Python worker, and nothing here needs it."""
    subprocess.run([sys.executable, "-c", WITHOUT_PANDAS], check=True, cwd=Path(corpus_pipeline.__file__).parent)
