"""The pipeline's stages on the smallest tables, against brute force and on odd rows."""

import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import decontamination
from test_llm import components, labels_of, removed, sentence, table

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_pipeline(spark):
    packed = corpus_pipeline.run(spark, FOLDER)
    rows = packed.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert rows and all(r[1] <= 1024 for r in rows)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_stages_keep_columns_and_only_drop_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER)
        assert after.columns == docs.columns, name
        assert {r["doc_id"] for r in after.select("doc_id").collect()} <= before


INSULTS = ("grimblo", "grimbla", "grimbox")


def planted(rng):
    """Texts, which of them are toxic, and test items."""
    items = [sentence(rng, 25) for _ in range(6)]
    passage = sentence(rng, 60)
    texts = [sentence(rng, rng.randint(20, 90)) for _ in range(300)]
    texts += [f"{sentence(rng, 15)} {passage} {sentence(rng, 15)}" for _ in range(8)]
    texts += [texts[3], texts[3] + " more", " ".join(["other", *texts[5].split()[1:]]), texts[3]]
    texts += [f"{sentence(rng, 30)} {items[0]} {sentence(rng, 30)}", " ".join(w if k % 6 else "changed" for k, w in enumerate(items[1].split())), " ".join(items[2].split()[:8])]
    texts += [None, "", " \t ", "one", sentence(rng, 3000), "<|endoftext|> x", passage]
    bad = [t is not None and len(t) > 40 and i < 300 and i % 4 == 0 and i not in (3, 5) for i, t in enumerate(texts)]
    return [f"{t} {rng.choice(INSULTS)} {rng.choice(INSULTS)} {sentence(rng, 5)}" if b else t for t, b in zip(texts, bad, strict=True)], bad, items


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage on what its predecessor kept, and the whole run."""
    rng = random.Random(21)
    texts, bad, items = planted(rng)
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    labels_of(spark, [(i, 1, int(b)) for i, b in enumerate(bad)]).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages, docs, own = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(enumerate(texts))

    def step(name):
        nonlocal docs
        got = stages[name](spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        got.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        return {r["doc_id"]: r["text"] for r in docs.collect()}

    own = {i: t for i, t in own.items() if not bad[i]}
    assert step("toxicity") == own
    ids = sorted(own)
    classes = components([own[i] for i in ids], 5, 80)
    own = {ids[k]: own[ids[k]] for k, (_, c) in classes.items() if c == k}
    assert step("ngram_jaccard_join") == own and len(own) < len(ids) - 2
    ids = sorted(own)
    expected = removed([own[i] for i in ids], corpus_pipeline.PASSAGE)
    own = step("substring_dedup")
    assert {i: hashlib.sha256(b" ".join((own[i] or "").encode().split())).hexdigest() for i in own} == {ids[k]: digest for k, (_, _, digest) in expected.items()}
    assert sum(n > 0 for _, n, _ in expected.values()) >= 7

    def leaks(text):
        for item in items:
            (a, _), (b, _) = (decontamination.words_of(pa.array([x])) for x in (text or "", item))
            if len(a) and decontamination.align(b, a, decontamination.word_weights(b))[0] / len(np.unique(b)) >= decontamination.THRESHOLD:
                return True
        return False

    clean = {i: t for i, t in own.items() if not leaks(t)}
    assert step("benchmark_decontamination") == clean and len(clean) == len(own) - 2
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pieces = sorted(tuple(r) for r in stages["best_fit_packing"](spark, docs, str(tmp_path)).select(*columns).collect())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in clean.items()}
    assert {i: sum(p[3] for p in pieces if p[0] == i) for i in whole} == whole and {p[0] for p in pieces} == set(whole)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select(*columns).collect()) == pieces


ODD = "doc_id long, text string, lang string, source string, n_chars long, own int, m0 long, token long, label int, score double, a long, b long, g long, h long, n long, block string, data string, words string, piece int, __runs string, __gone long, component_id long, item_id long"


def test_stages_take_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, blanks, a very long text, columns with the operators' names, empty tables."""
    rng = random.Random(22)
    texts = {1: sentence(rng, 60), 2: None, 3: "", 4: " \n", 5: sentence(rng, 60_000), None: sentence(rng, 70), 7: "one"}
    filler = (None,) * (len(ODD.split(",")) - 2)
    rows = [(i, t, *filler) for i, t in texts.items()]
    docs = spark.createDataFrame([*rows, rows[-1], rows[1]], ODD)
    labels_of(spark, [(None, 1, 1), (1, None, None)]).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, sentence(rng, 30)), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        kept = {(r["doc_id"], r["text"]) for r in got.collect()}
        assert kept == {(i, t) for i, t in texts.items()}, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    pieces = corpus_pipeline.packed(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == set(texts)
    places = pieces.select("sequence_id", "offset").collect()
    assert len(set(places)) == len(places)
    assert corpus_pipeline.packed(spark, docs.limit(0), str(tmp_path)).count() == 0
