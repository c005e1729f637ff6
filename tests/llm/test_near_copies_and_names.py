"""Near copies of one fingerprint, and columns whose names the stages use themselves."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trajecta.llm import simhash, substrings
from trajecta.llm.common import clean, saved


def kept(spark, texts):
    return sorted(r.doc_id for r in simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())


def test_near_copies_beside_a_third_text_of_the_same_words(spark):
    words = [f"w{k}" for k in range(60)]
    swapped = [*words[:-2], words[-1], words[-2]]
    for seed in range(2):  # whatever digest is the smallest
        other = list(np.random.default_rng(seed).permutation(words))
        assert kept(spark, map(" ".join, (words, swapped, other))) == [0, 2]


def test_near_copies_across_linked_fingerprints_of_several_texts(spark):
    """Classes of shuffles of one set of words, and of the set with one word exchanged."""
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(200)]
    a = [list(rng.permutation(words)) for _ in range(5)]
    b = [[f"{w}x" if w == "w7" else w for w in t] for t in a]  # each 0.95 like its own original only
    assert kept(spark, map(" ".join, [*a, *b])) == list(range(5))


def test_all_pairs_of_small_classes_are_candidates(spark):
    rows = [(bytes([k]), k // simhash.FEW if k < 2 * simhash.FEW else 99) for k in range(2 * simhash.FEW + 3)] + [(bytes([200 + k]), 7_000_000_000 + k % 2) for k in range(8)]
    got = {(r.a, r.b) for r in simhash._candidates(spark.createDataFrame(rows, "content binary, f long"), "f", 4).collect()}
    for f in {r[1] for r in rows}:
        mine = sorted(c for c, g in rows if g == f)
        assert {p for p in itertools.combinations(mine, 2)} <= got
    odd, even = ([c for c, g in rows if g == 7_000_000_000 + k] for k in (1, 0))
    assert {(min(x, y), max(x, y)) for x in odd for y in even} <= got


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, __key string, __text string, __doc int, __kept int, __id string, ___id string, row int"


def clashing(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None, f"k{i}", "x", 3, 4, f"i{i}", "y", 5) for i, t in texts], CLASHING)


def test_columns_with_the_names_of_the_stages_keep_their_values(spark):
    span = " ".join(f"s{k}" for k in range(55))
    docs = clashing(spark, [(1, span), (2, "a b c " + span), (2, "a b c " + span), (None, None), (5, "")])
    out = substrings.cleaned(docs)
    assert out.columns == docs.columns
    got = {(r.doc_id, r.text, r["__key"], r["__id"]) for r in out.collect()}
    assert got == {(1, span, "k1", "i1"), (2, "a b c", "k2", "i2"), (None, None, "kNone", "iNone"), (5, "", "k5", "i5")}
    one = simhash.one_of_each(docs)
    assert one.columns == docs.columns
    assert {(r.doc_id, r["__key"], r["__id"], r["__doc"]) for r in one.collect()} == {(1, "k1", "i1", 3), (2, "k2", "i2", 3), (5, "k5", "i5", 3)}
    assert substrings.cleaned(docs.where("false")).count() == simhash.one_of_each(docs.where("false")).count() == 0


@pytest.fixture
def planted(spark, sf, tmp_path):
    """The given documents with toxic texts, a near copy, a repeated span, a leak, nulls,
    repeats and columns of clashing names."""
    import shutil

    for t in ("labels", "benchmark"):
        shutil.copy(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1")
    rng = np.random.default_rng(3)
    clean_ = docs.join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0 AND quality = 1"), "doc_id").where("lang = 'en' AND n_chars > 2000").orderBy("doc_id").first().text.split()
    prose = lambda n: " ".join(rng.choice(clean_, n))
    toxic = [r.text for r in docs.join(labels, "doc_id").orderBy("doc_id").limit(12).collect()]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 100").orderBy("item_id").first().text
    base, span = prose(200).split(), prose(80)
    near = [*base[:90], "changed", *base[91:]]
    texts = {10**6 + 100 + j: t for j, t in enumerate(toxic)} | {10**6 + 1: " ".join(base), 10**6 + 2: " ".join(near), 10**6 + 3: prose(40) + " " + span, 10**6 + 4: prose(60) + " " + span + " end", 10**6 + 5: prose(30) + " " + item + " " + prose(30), 10**6 + 6: prose(50), 10**6 + 7: None, 10**6 + 8: ""}
    rows = [(i, t, "en", "s", len(t) if t else None) for i, t in sorted(texts.items())] + [(None, "a null id of its own " + prose(30), None, None, None)]
    more = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, lang string, source string, n_chars long")
    every = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).unionByName(more)
    every = every.withColumn("__key", F.concat(F.lit("k"), F.col("doc_id"))).withColumn("__text", F.lit(1)).withColumn("__doc", F.lit(2))
    every.write.parquet(str(tmp_path / "documents.parquet"))
    return texts, span, str(tmp_path)


def test_pipeline_finds_what_is_planted(spark, planted):
    texts, span, folder = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen, columns = {}, docs.columns
    whole = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, folder), name)
        assert docs.columns == columns
        seen[name] = {r.doc_id: r for r in docs.where("doc_id >= 1000000 OR doc_id IS NULL").collect()}
        assert all(r["__key"] == (None if i is None else f"k{i}") for i, r in seen[name].items())
        if name == "toxicity":  # a model of 200 documents finds few toxic ones; each stage is judged on its own input
            docs = whole.where("doc_id IS NULL OR doc_id < 1000100")
    k = 10**6
    assert len({k + 1, k + 2, k + 3, k + 4, k + 5, k + 6, None} & seen["toxicity"].keys()) >= 5
    near = seen["simhash_near_dedup"]
    assert k + 1 in near and k + 2 not in near and {k + 3, k + 4, k + 5, k + 6, None} <= near.keys()
    assert docs.where(f"doc_id = {k + 6}").count() == 1  # its repeat went
    cut = seen["substring_dedup"]
    assert cut[k + 3].text == texts[k + 3] and cut[k + 4].text == texts[k + 4].replace(" " + span, "") and cut[k + 4].n_chars == len(cut[k + 4].text)
    last = seen["decontamination"]
    assert k + 5 not in last and {k + 1, k + 3, k + 4, k + 6, None} <= last.keys()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in out.where("doc_id >= 1000000").select("doc_id").collect()} == {i for i in last if i is not None}
    clean(spark)


def test_pipeline_of_an_empty_table(spark, sf, tmp_path):
    import shutil

    for t in ("labels", "benchmark"):
        shutil.copy(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.read.parquet(f"{sf}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    clean(spark)


def test_near_copies_in_crowded_classes(spark):
    """Finding 27: more texts of one fingerprint, and more pairs of linked ones, than are compared
    on the spot; near copies are found though neither is like the class's smallest content."""
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(120)]
    many = [list(rng.permutation(words)) for _ in range(simhash.FEW + 9)]
    near = [[*t[:-2], t[-1], t[-2]] for t in many[:12]]
    assert kept(spark, map(" ".join, [*many, *near])) == list(range(len(many)))
    words = [f"v{k}" for k in range(200)]
    a = [list(rng.permutation(words)) for _ in range(7)]
    b = [[f"{w}x" if w == "v7" else w for w in t] for t in a]
    assert len(a) * len(b) > simhash.FEW and kept(spark, map(" ".join, [*a, *b])) == list(range(7))
