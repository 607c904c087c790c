"""The llm operators against brute force, on small tables with every odd case."""

import collections
import hashlib
import itertools
import math
import random
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination, jaccard, language, licences, lm, media, packing, quality, shared, substrings, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, a string, n string"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def table(spark, texts, langs=None, extra=True):
    """Documents with more columns, some of which have names that the operators use."""
    rows = [(i, t, (langs or ["en"] * len(texts))[i], "s", len(t or ""), 7, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def sentence(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages, junk, blanks, nulls, long texts and odd characters."""
    rng = random.Random(5)
    texts = [sentence(rng, rng.randint(1, 120)) for _ in range(60)]
    texts += [texts[3], texts[3], texts[10] + " " + texts[11], "pre " + texts[20], None, "", " \t\n", "a", "a b", "A B", "the the the the " * 40, "é ü ñ  x" * 9]
    base = sentence(rng, 60).split()
    for _ in range(80):
        own = list(base)
        for k in rng.sample(range(60), rng.choice([0, 1, 1, 2, 5])):
            own[k] = rng.choice(["zz", "yy", sentence(rng, 1)])
        texts.append(" ".join(own))
    texts += [sentence(rng, 4000), "<|endoftext|> x", "﻿word"]
    return texts


def test_words_and_hashes(corpus):
    column = pa.array([None, *corpus]).slice(1)
    data, offsets = tokens.buffers(column)
    start, end, row = tokens.word_spans(data, offsets)
    got = [(int(r), bytes(data[a:b]).decode()) for r, a, b in zip(row, start, end, strict=True)]
    assert got == [(i, w) for i, t in enumerate(corpus) for w in WORDS.findall(t or "")]
    hashes, seen = tokens.word_hashes(data, start, end, lower=True), {}
    for (_, w), h in zip(got, hashes, strict=True):
        assert seen.setdefault(lower(w), h) == h
    assert len(set(seen.values())) == len(seen)
    for n in (1, 2, 5, 13):
        assert len(set(tokens.ngram_hashes(hashes, n))) == len({tuple(hashes[i : i + n]) for i in range(len(hashes) - n + 1)})


def removed(texts, length):
    first, out = {}, {}
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        covered = [False] * len(words)
        for k in range(len(words) - length + 1):
            if first.setdefault(tuple(words[k : k + length]), i) < i:
                covered[k : k + length] = [True] * length
        kept = [w for w, c in zip(words, covered, strict=True) if not c]
        out[i] = (len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize(("length", "size"), [(3, 1 << 20), (13, 1 << 20), (2, 60), (13, 60)])
def test_substring_dedup(spark, corpus, monkeypatch, length, size):
    monkeypatch.setattr(substrings, "BLOCK", size)
    monkeypatch.setattr(substrings, "GROUP", size)
    got = substrings.digests(table(spark, corpus), length).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == removed(corpus, length)


def test_substring_rows(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    d = spark.createDataFrame([(1, passage), (1, passage), (None, passage), (2, passage + " tail"), (3, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in substrings.deduplicated(d, 13).collect() if r["text"] is not None)
    assert got == [(0, passage), (1, passage), (1, passage), (2, "tail")]
    assert substrings.digests(d.limit(0)).count() == 0


def test_maximal_repeats(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    texts = [passage, f"a b {passage} c {passage}", "x " + passage[:40], None, ""]
    rows = [(i, t, "u", "v", [1]) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, block string, data string, __runs array<int>")
    assert sorted(tuple(r) for r in substrings.repeats(d, 5).collect()) == [(1, 2, 20), (1, 23, 20), (2, 1, len(passage[:40].split()) - (passage[40] != " "))]
    got = {r["doc_id"]: r for r in substrings.deduplicated(d, 5).collect()}
    assert got[1]["text"] == "a b c" and got[3]["text"] is None and got[0]["__runs"] == [1] and got[0]["block"] == "u"


def test_prefixes_split_heavy_edges(monkeypatch):
    monkeypatch.setattr(substrings, "GROUP", 10)
    bounds = substrings.group_bounds(np.array([1, 2, 5, 9]), np.array([4, 5, 35, 3]))
    assert bounds.tolist() == [0, 5 << 16, (5 << 16) + (1 << 14), (5 << 16) + (2 << 14), (5 << 16) + (3 << 14), 6 << 16]


def components(texts, k, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = WORDS.findall(lower(t or ""))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(sets, 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent", "small"), [(3, 90, 64), (3, 90, 3), (5, 80, 2), (2, 60, 2)])
def test_jaccard_join(spark, corpus, monkeypatch, k, percent, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "FREQUENT_FROM", 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(table(spark, corpus), k, percent).collect()}
    assert got == components(corpus, k, percent)


def test_jaccard_prefixes():
    """Two similar sets share a key, whatever the classes of their shingles."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(9, 300))
        universe = rng.permutation(1 << 20)[: n + 40].astype(np.uint64) << np.uint64(33)
        drop = int(rng.integers(0, max(1, n // 19) + 1))
        x, y = universe[:n], np.concatenate([universe[drop:n], universe[n : n + int(rng.integers(0, max(1, n // 19) + 1))]])
        nodes = {int(h): int(rng.integers(1, 9)) for h in universe}  # how many sets have it
        nodes |= {int(h): max(2, nodes[int(h)]) for h in set(x.tolist()) & set(y.tolist())}
        bound, keys = int(rng.integers(2, 10)), []
        for s in (x, y):
            own = sorted((nodes[h], h) for h in s.tolist() if nodes[h] > 1)
            rare = sum(c < bound for c, _ in own)
            keys.append(set(jaccard.signature(np.array([h for _, h in own], np.uint64), len(s), rare, 90).tolist()))
        both = len(set(x.tolist()) & set(y.tolist()))
        if drop + len(y) - both and 100 * both >= 90 * (len(x) + len(y) - both):
            assert keys[0] & keys[1]


def test_keep_one(spark, corpus):
    d = table(spark, corpus).union(table(spark, corpus[:2])).union(spark.createDataFrame([(None, corpus[0], "en", "s", 1, 7, "x", "y")], SCHEMA))
    got = jaccard.keep_one(d, 5, 80)
    expected = sorted(i for i, (_, c) in components(corpus, 5, 80).items() if i == c)
    assert sorted(r["doc_id"] for r in got.where("doc_id IS NOT NULL").collect()) == expected
    assert got.where("doc_id IS NULL").count() == 1 and got.columns == d.columns
    assert jaccard.classes(d.limit(0)).count() == 0


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    import public_tokenizers

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert own.encode("<|endoftext|> x", add_special_tokens=False).ids[0] == 50256
    got = packing.pack(table(spark, corpus), capacity=64, with_ids=True).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for i, t in enumerate(corpus):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        rows = sorted(by[i], key=lambda r: r["piece"])
        assert [x for r in rows for x in r["ids"]] == ids and [r["start"] for r in rows] == list(np.cumsum([0, *(r["length"] for r in rows)]))[:-1]
        assert all(r["length"] == 64 for r in rows[1:]) and all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(table(spark, corpus).limit(0)).count() == 0


def test_fullest_combination():
    rng = random.Random(1)
    for _ in range(200):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        room = rng.randint(1, 40)
        best = max(sum(c) for n in range(len(items) + 1) for c in itertools.combinations(items, n) if sum(c) <= room)
        got = packing.fullest(dict(collections.Counter(items)), room)
        assert sum(a * b for a, b in got) == best and all(b <= items.count(a) for a, b in got)
    plan = packing.plan({6: 2, 4: 2, 5: 2}, 10)
    assert sum(times for times, _ in plan) == 3


def test_media(spark, corpus):
    got = {r["doc_id"]: r for r in media.media(table(spark, corpus)).collect()}
    for i, t in enumerate(corpus):
        data = media.payload(t)
        assert len(data) % 576 == 0 and len(data)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((t or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        assert media.decode(media.encode(data)) == data and b"".join(p for _, p in media.chunks(data)) == data
        assert r["media_sha256"] == hashlib.sha256(media.encode(data)).hexdigest() and r["media_bytes"] == len(media.encode(data))
        image = np.frombuffer(data, np.uint8).reshape(-1, 24).astype(float)
        steps = [abs(a - b) for row in image.tolist() for a, b in itertools.pairwise(row)]
        assert f"{len(image)}x24 mean={image.sum() / image.size:.4f}" in r["feature"] and f" step={sum(steps) / len(steps):.4f} " in r["feature"]
    assert tuple(got[3])[1:] == tuple(got[60])[1:]
    twice = spark.createDataFrame([(1, "x"), (1, "x"), (None, "x")], "doc_id long, text string")
    assert media.media(twice).count() == 3 and media.media(twice.limit(0)).count() == 0


def test_media_store(spark, corpus):
    """Repeated chunks are stored once, images come from the lists and the chunks alone, and a changed chunk is found out."""
    texts = [*corpus, corpus[-3] + " tail", corpus[-3]]
    stored, parts = media.store(table(spark, texts))
    rows, chunks = stored.collect(), {r["digest"]: r["part"] for r in parts.collect()}
    every = collections.Counter(d for t in texts for d, _ in media.chunks(media.payload(t)))
    assert set(chunks) == {d for d, n in every.items() if n > 1} and len(chunks) == parts.count()
    for r in rows:
        data = media.payload(texts[r["doc_id"]])
        assert media.put_together(r["key"], r["missing"], r["own"], r["alone"], chunks) == data
        assert [every[d] > 1 for d, _ in media.chunks(data)] == [not x for x in r["alone"]]
    images = {r["doc_id"]: r["media"] for r in media.images(table(spark, texts)).collect()}
    assert all(media.decode(images[i]) == media.payload(t) for i, t in enumerate(texts))
    r = next(r for r in rows if r["missing"])
    with pytest.raises(ValueError, match="differs"):
        media.put_together(r["key"], r["missing"], r["own"], r["alone"], {d: p[:-1] + b"?" for d, p in chunks.items()})
    with pytest.raises(ValueError, match="not in the store"):
        media.put_together(r["key"], r["missing"], r["own"], r["alone"], {})


def test_chunks_find_passages():
    rng = random.Random(2)
    passage = sentence(rng, 4000).encode()
    a, b = {d for d, _ in media.chunks(passage)}, {d for d, _ in media.chunks(b"some other beginning " + passage)}
    assert len(a & b) >= len(a) - 3


def test_decontamination(spark):
    rng = random.Random(4)
    items = [sentence(rng, 30) for _ in range(20)] + ["the the the the the the the the a b c d e f", "too short", None]
    clean = [sentence(rng, 300) for _ in range(30)] + ["the the the " * 100, None, ""]
    edited = items[1].split()
    for k in (4, 11, 19, 26):
        edited[k] = "changed"
    del edited[8]
    leaks = [sentence(rng, 40) + " " + items[0].upper() + " " + sentence(rng, 40), " ".join(edited), sentence(rng, 10) + "\n" + items[2].replace(" ", ", ")]
    d = table(spark, clean + leaks)
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.scan(d, b).collect()}
    assert set(got) == {(len(clean), 0), (len(clean) + 1, 1), (len(clean) + 2, 2)} and got[len(clean), 0] == 1.0
    assert sorted(r["doc_id"] for r in decontamination.keep_clean(d, b).collect()) == list(range(len(clean)))
    assert decontamination.scan(d.limit(0), b).count() == 0 and decontamination.scan(d, b.limit(0)).count() == 0


def test_decontamination_of_short_items(spark):
    """Whole sequences only; clashing and more columns, repeated rows and items."""
    items = [(1, "red fox jumps", "u"), (1, "red fox jumps", "u"), (2, "yes", "u"), (3, "素早い茶色の狐が犬を飛び越える", "u"), (4, None, "u")]
    b = spark.createDataFrame(items, "item_id long, text string, score string")
    texts = ["a red, FOX jumps high", "red fox never jumps", "yes", "x 素早い茶色の狐が犬を飛び越える y", "jumps fox red", None, ""]
    d = spark.createDataFrame([(i, t, "s", "w") for i, t in enumerate(texts)] + [(0, texts[0], "s", "w"), (None, texts[0], "s", "w")], "doc_id long, text string, score string, words string")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["item_id"], r["score"]) for r in decontamination.scan(d, b).collect())
    assert got == [(-1, 1, 1.0)] * 2 + [(0, 1, 1.0)] * 4 + [(3, 3, 1.0)]
    kept = decontamination.keep_clean(d, b)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 5, 6]


def test_decontamination_of_frequent_passages(spark):
    """Edited copies in many documents are found, though all seeds that they hold are frequent and others occur nowhere."""
    rng = random.Random(14)
    words = [f"{x}{i}" for i, x in enumerate(sentence(rng, 30).split())]
    edited = list(words)
    for k in (7, 14, 21):
        edited[k] = "changed"
    texts = [sentence(rng, 50) + " " + " ".join(edited) + " " + sentence(rng, 50) for _ in range(15)] + [" ".join(edited[:24])] * 15 + [sentence(rng, 200)] * 3
    b = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in decontamination.scan(table(spark, texts), b).collect()}
    assert got == {i: pytest.approx(0.85 if i < 15 else 0.65) for i in range(30)}
    assert [r["doc_id"] for r in decontamination.keep_clean(table(spark, texts), b).collect()] == [30, 31, 32]


def test_decontamination_finds_all(spark):
    """Every pair that reaches the threshold, as aligning each document with each item gives it."""
    rng = random.Random(15)
    vocabulary = [f"v{i}" for i in range(40)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 16))] for _ in range(12)]
    texts = []
    for _ in range(60):
        own = list(rng.choice(items))
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        own = [x for w in own for x in ([w, rng.choice(vocabulary)] if rng.random() < 0.3 else [w])]
        texts.append(" ".join(rng.choices(vocabulary, k=rng.randint(0, 30)) + own + rng.choices(vocabulary, k=rng.randint(0, 30))))
    expected = {}
    for (i, t), (j, item) in itertools.product(enumerate(texts), enumerate(items)):
        (a, _), (b, _) = (decontamination.words_of(pa.array([x])) for x in (t, " ".join(item)))
        score = decontamination.align(b, a, decontamination.word_weights(b))[0] / len(np.unique(b))
        if score >= 0.5:
            expected[i, j] = pytest.approx(score)
    got = decontamination.scan(table(spark, texts), spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in got} == expected and len(expected) > 30


def test_alignment():
    def plain(a, b):
        best, table = 0.0, np.zeros((len(a) + 1, len(b) + 1))
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = max(0, table[i, j] + (1 if a[i] == b[j] else -0.5), table[i, j + 1] - 0.5, table[i + 1, j] - 0.5)
                best = max(best, table[i + 1, j + 1])
        return best

    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 5, rng.integers(1, 15)).astype(np.uint64), rng.integers(0, 5, rng.integers(1, 25)).astype(np.uint64)
        assert decontamination.align(a, b)[0] == pytest.approx(plain(a, b))


def test_licences(spark):
    mit = dict(licences.LICENCES)["MIT"]
    changed = "MIT Licence\n\nCopyright (c) 2020 Someone\n\n" + mit.upper().replace(", ", " , ")
    rows = [changed, mit.replace("sell", "buy"), "Released under the MIT license", "text\nLicensed under the Apache License, Version 2.0.\nmore", None, ""]
    got = {r["doc_id"]: (r["licence_id"], r["notices"]) for r in licences.scan(table(spark, rows)).collect()}
    assert got[0][0] == "MIT" and got[1][0] is None and got[2] == ("MIT", "MIT") and got[3] == (None, "Apache-2.0") and got[4] == got[5] == (None, "")


def test_wrapped_licences(spark):
    """A licence's own lines stay, wherever it is wrapped; statements go."""
    statements = ["Copyright (c) 2020 Someone", "Copyright 2020 Someone", "  copyright © Someone", "© 2020 Someone", "(c) 2020 Someone", "Copyright Jane Doe <jane@example.org>", "Copyright The Example Authors.", "Copyright: Someone", "Copyright by Someone", "Copyright holder: Someone\nAll rights reserved."]
    rows, expected = [], []
    for i, (name, text) in enumerate(licences.LICENCES):
        for width in (20, 45, 71, 80):
            rows.append(statements[i % len(statements)] + "\n\n" + "\n\n".join(textwrap.fill(x, width, break_long_words=False) for x in text.split("\n\n")))
            expected.append(name)
        rows.append(statements[(i + 5) % len(statements)] + "\n\n" + re.sub(" (copyright|\\(c\\))", "\n\\1", text, flags=re.I))
        expected.append(name)
    isc = dict(licences.LICENCES)["ISC"]
    rows += [isc.replace("copyright notice and this permission notice", "\n(c) neither this\n"), isc.replace("above copyright", "above\ncopyright notice and this\ncopyright")]
    expected += [None, None]
    got = {r["doc_id"]: r["licence_id"] for r in licences.scan(table(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == expected


def plain_canonical(text):
    """Words of a text by the rules of the canonical form, written without patterns."""
    out = []
    for line in lower(text or "").split("\n"):
        bare = line.strip(" \t")
        rest = bare.removeprefix("copyright").strip()
        if bare.startswith("copyright") and (rest.startswith(("(c)", "©")) or rest[:1].isdigit()) or bare.startswith(("(c) 2", "©")) or bare.strip(" .") == "all rights reserved":
            continue
        kept = "".join(" " if c.isascii() and not c.isalnum() or c in "“”‘’«»–—…" else c for c in line)
        out += kept.split()
    same = {"licence": "license", "licens": "license", "licenced": "licensed", "merchantibility": "merchantability", "acknowledgement": "acknowledgment", "organisation": "organization"}
    joined = " " + " ".join(same.get(w, w) for w in out) + " "
    for a, b in (("sub license", "sublicense"), ("non infringement", "noninfringement"), ("copyright owners", "copyright holder"), ("copyright owner", "copyright holder"), ("copyright holders", "copyright holder"), ("as is", "asis")):
        joined = joined.replace(f" {a} ", f" {b} ")
    for n in "0123456789":
        joined = joined.replace(f" version {n} 0 ", f" version {n} ")
    return joined.strip()


def test_licences_against_plain_canonical_texts(spark):
    """Varied and damaged licences match just where the plain canonical texts are equal."""
    rng = random.Random(8)
    by_text = {plain_canonical(t): name for name, t in reversed((*licences.LICENCES, *licences.NOTICES))}
    rows = [None, "", " \n ", "Copyright 2020 X"]
    for _, text in (*licences.LICENCES, *licences.NOTICES):
        words = text.split(" ")
        rows += [text.upper(), text.replace(" ", "  "), "Copyright (c) 1999 Me\n" + text.replace("license", "licence"), text.replace('"', "“"), " ".join(words[:-1]), " ".join(words[: len(words) // 2] + words[len(words) // 2 + 1 :]), text + " More.", "\n".join(textwrap.wrap(text, rng.randint(30, 90), break_long_words=False))]
    d = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(rows)] + [(None, rows[4], "x", "y", 1)] * 2, "doc_id long, text string, _lines string, digest string, _key int")
    got = licences.scan(d).collect()
    assert len(got) == len(rows) + 2 and {r["licence_id"] for r in got if r["doc_id"] is None} == {by_text[plain_canonical(rows[4])]}
    assert {r["doc_id"]: r["licence_id"] for r in got if r["doc_id"] is not None} == {i: by_text.get(plain_canonical(t)) for i, t in enumerate(rows)}
    longer = spark.createDataFrame([("Own", "Do what you like, " * 3000)], "licence_id string, text string")
    table_ = licences.known(spark, longer)
    assert licences.scan(spark.createDataFrame([(1, "do WHAT you like " * 3000)], "doc_id long, text string"), table_).first()["licence_id"] == "Own"
    assert licences.scan(d.limit(0)).count() == 0


def plain_model(seqs, held):
    """Counts by order, and a walk through the automaton from token to token with its state in hand."""
    counts = [collections.Counter(g for i, s in enumerate(seqs) if i not in held for g in zip(*(s[j:] for j in range(n)), strict=False)) for n in (1, 2, 3)]
    z = sum(counts[0].values()) + len(counts[0]) + 1

    def p(h, w):
        if not h:
            return (counts[0][(w,)] + 1) / z
        c, prior = counts[len(h) - 1][h], lm.PRIOR[len(h) - 1]
        return (counts[len(h)][(*h, w)] + prior * p(h[1:], w)) / (c + prior)

    def walk(s):
        state, out = (), 0.0
        for w in s:
            while state and not counts[len(state)][(*state, w)]:  # a failure arc
                prior = lm.PRIOR[len(state) - 1]
                out += math.log10(prior / (counts[len(state) - 1][state] + prior))
                state = state[1:]
            out += math.log10(p(state, w))
            state = (*state, w)[-2:]
            while state and not counts[len(state) - 1][state]:
                state = state[1:]
        return out

    return counts, z, p, walk


@pytest.mark.parametrize(("block", "size"), [(lm.BLOCK, lm.RANGE), (50, 200)])
def test_language_model(spark, corpus, monkeypatch, block, size):
    monkeypatch.setattr(lm, "BLOCK", block)
    monkeypatch.setattr(lm, "RANGE", size)
    texts = [t.replace("zz", "the cat") if t else t for t in corpus] * 2
    held = {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 == 2}
    seqs = [[*WORDS.findall(lower(t or "")), None] for t in texts]
    counts, z, _, walk = plain_model(seqs, held)
    got = {r["doc_id"]: r for r in lm.evaluate(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, s in enumerate(seqs):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in held, len(s), sum(counts[0][(w,)] > 0 for w in s), counts[0].total())
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[0][(w,)] + 1) / z) for w in s)) and r["score"] == pytest.approx(walk(s))


def test_language_model_rows(spark):
    twice = spark.createDataFrame([(2, "rare words here"), (2, "rare words here"), (None, None), (None, "rare")], "doc_id long, text string")
    out = lm.evaluate(twice).collect()
    assert len(out) == 4 and len({r["score"] for r in out if r["doc_id"] == 2}) == 1 and {r["train_tokens"] for r in out} == {8}
    assert lm.evaluate(twice.limit(0)).count() == 0
    nothing = lm.score(twice, F.lit(False)).collect()
    assert all(r["n_known"] == r["train_tokens"] == 0 and r["score"] == 0 for r in nothing)


def test_equal_blocks(spark, monkeypatch):
    """Parts of a table with the same documents count and are scored each."""
    monkeypatch.setattr(lm, "BLOCK", 4)
    d = spark.createDataFrame([(1, "a b c"), (2, "a b")] * 3, "doc_id long, text string")
    out = lm.score(d.coalesce(1), F.lit(True)).collect()
    assert sorted(r["doc_id"] for r in out) == [1, 1, 1, 2, 2, 2] and {r["train_tokens"] for r in out} == {21}
    assert len({(r["doc_id"], r["score"]) for r in out}) == 2


def test_arcs_of_a_state_sum_to_one():
    seqs = [["a", "b", "a", "c", None], ["b", "a", "b", None], [None]]
    counts, _, p, walk = plain_model(seqs, set())
    for h in [(), *counts[0], *counts[1]]:
        if None not in h:
            assert sum(p(h, w) for (w,) in counts[0]) + p(h, "other") == pytest.approx(1.0)
    assert walk(["b", "a"]) == pytest.approx(math.log10(p((), "b")) + math.log10(p(("b",), "a")))


LANGUAGES = {"xx": "abcde", "yy": "defgh", "zz": "ghijk"}


def test_language(spark):
    rng = random.Random(6)
    names = [rng.choice(list(LANGUAGES)) for _ in range(240)]
    texts = [sentence(rng, 30, LANGUAGES[n]) for n in names]
    d = table(spark, [*texts, None, "", "123 !", "é"], [*names, "xx", "xx", None, None])
    got = {r["doc_id"]: r for r in language.identify(d).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in set(held)) for i in range(240))
    assert np.mean([got[i]["lang_pred"] == names[i] for i in held]) > 0.95
    assert [got[i]["lang_pred"] for i in (240, 241, 242)] == ["und"] * 3 and got[243]["lang_pred"] in LANGUAGES
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identify(d.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language.identify(table(spark, ["abc", "def"], [None, None])).collect()} == {"und"}


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality(spark):
    rng = random.Random(7)
    good = [rng.random() < 0.7 for _ in range(400)]
    texts = [sentence(rng, rng.randint(20, 80)).capitalize() + "." if g else rng.choice(["buy now " * 30, "### $$$ !!! 123 " * 20]) for g in good]
    d = table(spark, [*texts, None, "", "x" * 100_000])
    got = {r["doc_id"]: r for r in quality.classify(d, labels_of(spark, [(i, int(g), 0) for i, g in enumerate(good)] + [(0, None, None), (None, 1, 1)])).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i]["predicted"] == good[i] for i in held]) > 0.95 and len(got) == 403
    assert all(0 <= r["score"] <= 1 for r in got.values())
    one = quality.classify(d, labels_of(spark, [(1, 1, 0)])).collect()
    assert {r["score"] for r in one} == {1.0}
    assert quality.classify(d.limit(0), labels_of(spark, [])).count() == 0


@pytest.mark.parametrize(("n", "rare"), [(64, 8), (40, 1), (2, 1), (6, 2)])
def test_quality_of_few_rows(spark, n, rare):
    """Both classes have rows: no constant, and the classes come apart."""
    rng = random.Random(9)
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2][:n]
    bad = set(ids[:: max(1, n // rare)][:rare])
    texts = [rng.choice(["buy now " * 30, "### $$$ !!! 123 " * 20]) if i in bad or i >= 150 else sentence(rng, rng.randint(20, 80)).capitalize() + "." for i in range(200)]
    labels = labels_of(spark, [(i, int(i not in bad), 0) for i in ids])
    got = {r["doc_id"]: r["score"] for r in quality.classify(table(spark, texts), labels).collect()}
    assert len(set(got.values())) > 1 and all(0 <= x <= 1 for x in got.values())
    if rare == 8:
        assert np.mean([got[i] for i in range(100, 150)]) > np.mean([got[i] for i in range(150, 200)]) + 0.3


def test_toxicity(spark):
    rng = random.Random(8)
    bad = [rng.random() < 0.3 for _ in range(500)]
    insults = ["grimblo", "grimbla", "grimbox", "stupid"]
    texts = [" ".join([sentence(rng, 30), *(rng.choice(insults) for _ in range(2 * b)), sentence(rng, 10)]) for b in bad]
    d = table(spark, [*texts, None, "", "grimbzz"])
    got = {r["doc_id"]: r for r in toxicity.classify(d, labels_of(spark, [(i, 1, int(b)) for i, b in enumerate(bad)])).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == bad[i] for i in held]) > 0.95
    assert got[500]["score"] == got[501]["score"] < 0.5 < got[502]["score"]
    clean = toxicity.keep_clean(d, labels_of(spark, [(i, 1, int(b)) for i, b in enumerate(bad)]))
    assert clean.columns == d.columns and clean.where("text IS NULL").count() == 1
    assert toxicity.classify(d, labels_of(spark, [(1, 1, 0)])).where("score > 0").count() == 0
    assert toxicity.classify(d.limit(0), labels_of(spark, [])).count() == 0


def test_long_and_repeated_texts(spark):
    """What stands at the very end of a long text counts; repeated rows are scored alike, each on its own."""
    rng = random.Random(12)
    bad = [i % 3 == 0 for i in range(300)]
    texts = [sentence(rng, 30) + " grimblo grimblo" * b for i, b in enumerate(bad)]
    far = sentence(rng, 200_000)
    d = table(spark, [*texts, far, far + " grimblo"])
    got = toxicity.classify(d.union(d.where("doc_id >= 299")), labels_of(spark, [(i, 1, int(b)) for i, b in enumerate(bad)])).where("doc_id >= 299").collect()
    scores = collections.defaultdict(set)
    for r in got:
        scores[r["doc_id"]].add((r["score"], r["predicted"]))
    assert len(got) == 6 and all(len(x) == 1 for x in scores.values()) and {k: p for k, x in scores.items() for _, p in x} == {299: 0, 300: 0, 301: 1}
    names = ["xx" if i % 2 else "yy" for i in range(300)]
    d = table(spark, [*(sentence(rng, 30, LANGUAGES[n]) for n in names), sentence(rng, 100_000, LANGUAGES["yy"])], [*names, None])
    got = [tuple(r) for r in language.identify(d.union(d.where("doc_id = 300"))).select("lang_pred", "score").where("doc_id = 300").collect()]
    assert len(got) == 2 and got[0] == got[1] and got[0][0] == "yy"


def test_label_model_joins_correlated_voters():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    vote = lambda accuracy: np.where(rng.random(4000) < accuracy, y, ~y) * 2 - 1
    one = vote(0.75)
    table_ = np.stack([one, one, vote(0.9), vote(0.85), vote(0.8)], 1).astype(np.int8)
    posterior, about = toxicity.label_model(table_)
    assert [0, 1] in about["cliques"] and np.mean((posterior > 0.5) == y) > 0.9
    assert abs(about["accuracy"][2] - 0.9) < 0.05


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 103), (103, 101)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in shared.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 103)}}
    assert shared.components(spark.createDataFrame([], "u long, v long")).count() == 0
