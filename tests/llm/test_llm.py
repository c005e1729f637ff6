"""Every operator against a brute-force version, with odd tables."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from trajecta.llm import bpe, components, decontaminate, kneser, language, media, pieces, quality, records, simhash, substrings, toxicity
from trajecta.llm.common import clean, saved

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words int, kept int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def word(rng, n=4):
    return "".join(rng.choice(list("abcdefghij"), n))


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(word(rng, int(rng.integers(2, 7))) for _ in range(n))


def frame(spark, texts, ids=None):
    rows = [(i, t, "en", "s", len(t) if t else None, None, 1) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeats, clashing column names."""
    long = prose(1, 12_000)
    texts = [None, "", "  \n", "one", long, long, long[:9000] + " tail", prose(2, 60) + " " + prose(3, 90), prose(3, 90) + " end", "Ünï çode ﬁ\x1cx   漢字 😀", "a" * 5000, "en " * 400, "<|endoftext|> it's I'LL"]
    return frame(spark, texts)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


def test_token_counts(odd, none):
    tok = bpe.ChunkEncoder(bpe.VOCABULARY).tok
    want = {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in texts_of(odd).items()}
    got = bpe.token_counts(odd).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 2048) and r.n_bytes == len(texts_of(odd)[r.doc_id].encode()) for r in got[:3])
    assert bpe.token_counts(none).count() == 0


def test_token_records(spark, odd, none, tmp_path):
    tok = bpe.ChunkEncoder(bpe.VOCABULARY).tok
    got = sorted(records.token_records(odd, path=f"file://{tmp_path}/r").collect(), key=lambda r: r.doc_id)
    start = 0
    for r in got:
        ids = [*tok.encode(texts_of(odd)[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    index = spark.read.parquet(f"file://{tmp_path}/r/index")
    for r in records.fetch(spark, f"file://{tmp_path}/r/data", index.where("doc_id IN (3, 8)").select("doc_id", "file", "offset", "length")).collect():
        assert np.frombuffer(r.payload, "<u2", offset=9).tolist() == [*tok.encode(texts_of(odd)[r.doc_id], add_special_tokens=False).ids, 2]
    assert records.token_records(none).count() == 0


def test_files_are_in_order_of_their_numbers(spark):
    rows = [(f"part-{n}-x.txt", 10) for n in ("00002", "99999", "100000", "100001")]
    got = {r.file: r.before for r in records.before_files(spark.createDataFrame(rows, "file string, n_tokens long")).collect()}
    assert [got[f] for f, _ in rows] == [0, 10, 20, 30]


def test_records_of_repeated_and_null_ids(spark, tmp_path):
    tok = bpe.ChunkEncoder(bpe.VOCABULARY).tok
    docs = frame(spark, ["b c", "a", None, "a", "zz top"], [4, 4, None, 4, 2])
    got = sorted(records.token_records(docs, path=f"file://{tmp_path}/r").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 2, 4, 4, 4] and got[0].n_tokens == 1
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(5)]
    want = sorted(zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for t in ("b c", "a", "a"))
    assert sorted(r.ids_crc32 for r in got[2:]) == want


def test_array_merges_equal_the_library():
    rng = np.random.default_rng(3)
    enc = bpe.ChunkEncoder(bpe.VOCABULARY)
    signs = list("aAbeEnrst zZéÉßÿŸ×÷'<>|.,!?-_019 \t\n") + ["İ", "K", "\u0301", "漢", "\x1c", "\x00", "\u00a0", "<|endoftext|>", "it's"]
    texts = ["".join(rng.choice(signs, int(rng.integers(0, 40)))) for _ in range(3000)]
    texts += ["A" * n for n in range(28, 40)] + ["é" * n for n in range(12, 20)] + ["the theory of everything " * 50]
    ids, count = enc.encode([t.encode() for t in texts])
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
    assert enc.counts([t.encode() for t in texts]).tolist() == count.tolist()


def test_damaged_records_are_found():
    good = records.framed(records.payload_of(5, b"\x01\x00", 2)) + records.EMPTY
    assert [(d, i.tolist()) for _, _, d, i in records.parsed(good)] == [(5, [1])]
    with pytest.raises(ValueError):
        list(records.parsed(good[:14] + b"\xff" + good[15:]))


def lzw(px, size):
    clear, bits, nb, out = 1 << size, 0, 0, bytearray()

    def emit(c, w):
        nonlocal bits, nb
        bits |= c << nb
        nb += w
        while nb >= 8:
            out.append(bits & 255)
            bits >>= 8
            nb -= 8

    w, known, nxt, cur = size + 1, {(i,): i for i in range(clear)}, clear + 2, ()
    emit(clear, w)
    for x in px:
        if (*cur, x) in known:
            cur = (*cur, x)
            continue
        emit(known[cur], w)
        if nxt < 4096:
            known[*cur, x] = nxt
            nxt += 1
            if nxt - 1 == 1 << w and w < 12:
                w += 1
        else:
            emit(clear, w)
            known, nxt, w = {(i,): i for i in range(clear)}, clear + 2, size + 1
        cur = (x,)
    emit(known[cur], w)
    w += nxt < 4096 and nxt == 1 << w and w < 12
    emit(clear + 1, w)
    if nb:
        out.append(bits & 255)
    return bytes(out)


@pytest.mark.parametrize(("size", "n", "colours"), [(8, 20_000, 256), (2, 3000, 4), (8, 30_000, 3), (8, 9000, 1), (4, 40_000, 16), (8, 1, 1)])
def test_lzw_streams(size, n, colours):
    px = np.random.default_rng(n).integers(0, colours, n).astype(np.uint8)
    other = px[: n // 2 + 1][::-1]
    got = media.lzw_decode([lzw(px.tolist(), size), lzw(other.tolist(), size)], size, [n, len(other)])
    assert np.array_equal(got[0], px) and np.array_equal(got[1], other)


def test_lzw_with_a_full_table():
    """The encoder keeps a full table to the end of the stream (a deferred clear code)."""
    px = np.random.default_rng(7).integers(0, 200, 30_000).astype(np.uint8)
    bits, known, free, cur, w, n = [], {(i,): i for i in range(256)}, 258, (), 9, 0

    def emit(c):
        bits.extend(c >> k & 1 for k in range(w))

    emit(256)
    for x in px.tolist():
        if (*cur, x) in known:
            cur = (*cur, x)
            continue
        emit(known[cur])
        n += 1
        if free < 4096:
            known[*cur, x] = free
            free += 1
            w += free - 1 == 1 << w and w < 12
        cur = (x,)
    emit(known[cur])
    emit(257)
    stream = np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes()
    assert n > 4096 and np.array_equal(media.lzw_decode([stream], 8, [len(px)])[0], px)


def test_media_columns(odd, none):
    stored = media.store_gif(odd)
    for r in media.read_gif(stored).collect():
        text = texts_of(odd)[r.doc_id].encode()
        payload = text + b"\xff" * (max(1, -(-len(text) // 576)) * 576 - len(text))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text), len(payload), hashlib.sha256(payload).hexdigest())
        screen, colours = [None] * 576, [0] * 64
        for k in range(0, len(payload), 576):
            screen = [old if i == 255 else i for i, old in zip(payload[k : k + 576], screen, strict=True)]
            for i in screen:
                if i is not None:
                    colours[((i >> 5) * 255 // 7 >> 6) * 16 + ((i >> 2 & 7) * 255 // 7 >> 6) * 4 + ((i & 3) * 85 >> 6)] += 1
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.feature == f"hist64={','.join(map(str, colours))}"
        assert len(payload) < 10_000 or r.media_bytes < len(payload)
    for r in media.frame_table(stored.where("doc_id = 7")).collect():
        assert (r.delay_cs, r.start_cs) == (10, 10 * r.frame) and sum(r.colours) == sum(np.frombuffer(r.rgba, np.uint8)[3::4] > 0)
    assert media.media_columns(stored.select(F.col("doc_id"), F.lit("x").alias("text"), F.lit(1).alias("media"))).count() == stored.count()
    assert media.media_columns(none).count() == 0


def test_disposal_and_transparency():
    pal = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    make = lambda px, disposal, clear: media.Frame(0, 0, 2, 1, pal, 5, disposal, clear, False, 2, b"", np.array([px], np.uint8))
    shown = [p[0, :, :3].tolist() for _, _, p in media.shown(2, 1, [make([1, 1], 1, None), make([0, 2], 3, 0), make([3, 0], 2, 0), make([0, 0], 1, 0)])]
    red, green, blue, none = [255, 0, 0], [0, 255, 0], [0, 0, 255], [0, 0, 0]
    assert shown == [[red, red], [red, green], [blue, red], [none, none]]


def brute_removal(docs):
    words = {i: WORDS.findall(t) for i, t in docs.items()}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][s : s + 50]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < i:
                gone.update(range(s, s + 50))
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("part", [1 << 18, 100])
def test_substring_dedup(spark, odd, none, part, monkeypatch):
    monkeypatch.setattr(substrings, "PART", part)
    shared = prose(9, 70)
    more = frame(spark, [f"{prose(20 + k, 30 + k)} {shared[: 200 + 30 * k]} {prose(40 + k, 25)}" for k in range(12)] + ["x y " * 60, "y x " * 70, prose(50, 49), prose(50, 50), prose(50, 50)], list(range(100, 117)))
    docs = odd.unionByName(more)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removal_digest(docs).collect()}
    assert got == brute_removal(texts_of(docs))
    assert substrings.removal_digest(none).count() == 0


def test_substring_dedup_of_words_made_to_collide(spark):
    """A Thue-Morse word and its complement: equal under any polynomial hash modulo 2^64."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    lines = [" ".join([a, *prose(3, 60).split()]), " ".join([b, *prose(3, 60).split()]), " ".join(a if bin(i).count("1") % 2 else b for i in range(128)), " ".join(b if bin(i).count("1") % 2 else a for i in range(128))]
    docs = frame(spark, lines)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removal_digest(docs).collect()}
    assert got == brute_removal(texts_of(docs)) and got[1][1] == 60 and got[0][1] == 0


def test_substring_dedup_of_repeated_ids(spark):
    t = prose(5, 80)
    docs = frame(spark, [t, t, prose(6, 80), t], [1, 1, 1, None])
    got = sorted((r.doc_id or 99, r.n_removed) for r in substrings.removal_digest(docs).collect())
    assert got == [(1, 0), (1, 0), (1, 0), (99, 80)]
    assert substrings.cleaned(docs).columns == docs.columns


def brute_print(text, width=4):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    w = WORDS.findall(t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints, radius):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= radius:
                a_, b_ = find(i), find(j)
                root[max(a_, b_)] = min(a_, b_)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_and_components(odd, none):
    docs = texts_of(odd)
    prints = {i: brute_print(t) for i, t in docs.items()}
    groups = dict(zip(docs, brute_groups(list(prints.values()), 4), strict=True))
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicate_digest(odd).collect()}
    assert got == {i: (prints[i], list(docs)[groups[i]]) for i in docs}
    assert simhash.near_duplicates(none).count() == 0


def test_ball_hashing_finds_all_components(spark):
    rng = np.random.default_rng(0)
    prints = []
    for k in range(60):
        x = int(rng.integers(0, 1 << 62)) * 3 & (1 << 64) - 1
        for _ in range(int(rng.integers(1, 5)) if k else 150):  # the first group is large and dense
            for b in rng.choice(24 if k == 0 else 64, int(rng.integers(0, 4 if k == 0 else 6)), replace=False):
                x ^= 1 << int(b)
            prints.append(x)
    prints = list(dict.fromkeys(prints))
    df = spark.createDataFrame([(simhash._signed(x),) for x in prints], "fp long")
    roots = {r.node: r.root for r in components.components(simhash.links(df)).collect()}
    as_sets = lambda keys: {frozenset(i for i, x in enumerate(keys) if x == k) for k in set(keys)}
    assert as_sets([roots.get(simhash._signed(x), simhash._signed(x)) for x in prints]) == as_sets(brute_groups(prints, 4))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100
    assert components.components(links.where("false")).count() == 0


def test_one_of_each(spark, odd):
    kept = simhash.one_of_each(odd, 5)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IN (4, 5, 6)").collect()) in ([4], [4, 6])
    twice = odd.where("doc_id = 3").unionByName(odd.where("doc_id = 3"))
    assert simhash.one_of_each(twice).count() == 1


def test_language(spark, sf, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language.identify(docs.unionByName(spark.createDataFrame([(-1, None, None, None, None), (-2, "123 !!", None, None, None)], docs.schema))).join(docs.select("doc_id", "lang"), "doc_id", "left")
    rows = got.collect()
    held = [r for r in rows if r.held_out and r.doc_id >= 0]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert {r.lang_pred for r in rows if r.doc_id < 0} == {"und"} and all(0 <= r.score <= 1 for r in rows)
    assert language.identify(none).count() == 0


def test_texts_without_letters_have_no_language(spark):
    rows = [(1, "hello there you all", "en"), (3, "bonjour tout le monde", "fr")] + [(10 + k, t, None) for k, t in enumerate(["１２３", "！！", "\ufffd", "\ufe0f", "𝟏𝟐", "12 !?", "", None])]
    got = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {got[k] for k in range(10, 18)} == {"und"} and "und" not in (got[1], got[3])


def test_kneser_ney_sums_to_one(spark):
    texts = ["abracadabra", "banana band", "cab"]
    codes = np.concatenate([kneser.grams(texts, 3, False)[0]])
    counts = spark.createDataFrame([("x", int(g), 1) for g in codes], "lang string, gram long, c long")
    for modified in (False, True):
        model = kneser.Model(counts, 3, modified)
        # all symbols after the context "ab": seen ones by the model, the rest share what is left
        context = (ord("a") << 24) | (ord("b") << 12)
        wanted = spark.range(1 << 12).select(F.lit("x").alias("lang"), (F.col("id") + context).alias("gram"))
        assert model.probabilities(wanted)[-1].agg(F.sum("p")).first()[0] == pytest.approx(1.0, abs=1e-6)


def test_grams_against_a_plain_loop():
    texts = ["ab  c", "", "xࠀy"]
    codes, owner = kneser.grams(texts, 3, False)
    assert owner.tolist() == [0, 0, 0, 0, 2, 2, 2]
    assert codes[0] == ord("a") and codes[2] == (ord("a") << 24) | (ord("b") << 12) | 1


def test_quality(spark, sf, none):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.quality(docs.unionByName(spark.createDataFrame([(-1, None, None, None, None)], docs.schema)), labels).join(labels, "doc_id", "left").collect()
    assert len(got) == docs.count() + 1 and [r.keep for r in got if r.doc_id == -1] == [False]
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert np.mean([r.keep for r in good]) > 0.95 and np.mean([r.keep for r in bad]) < 0.3


def test_toxicity_on_held_out_rows(spark, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r.toxic for r in rows])
    assert right >= 0.9 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    empty = toxicity.toxicity(none, labels)
    assert empty.count() == 0


def test_toxicity_of_odd_tables(spark, monkeypatch):
    texts = [None, "", "you idiot", "a fine day", "you idiot", "x " * 20_000, "漢字 😀"]
    docs = frame(spark, texts, [1, 2, 3, 4, 3, 6, None]).withColumn("toxic", F.lit("z")).withColumn("score", F.lit("z"))
    none = spark.createDataFrame([], "doc_id long, toxic int, score int")
    assert {(r.score, r.predicted) for r in toxicity.toxicity(docs, none).collect()} == {(0.0, 0)}
    bad = spark.createDataFrame([(i, 1, 9) for i in (1, 2, 3, 4, 6, None)], none.schema)
    got = toxicity.toxicity(docs, bad).collect()
    assert len(got) == len(texts) and {(r.score, r.predicted) for r in got} == {(1.0, 1)}
    assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert toxicity.without_toxic(docs, none).columns == docs.columns and toxicity.without_toxic(docs, none).count() == len(texts)
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic, fold: seen.append((texts, toxic.tolist())))
    both = spark.createDataFrame([(i, int(i == 3), 9) for i in range(1, 7)] + [(4, 1, 9), (4, 0, 9), (2, None, 9), (6, 5, 9)], none.schema)
    toxicity.train(docs, both)
    want = [(i, t, y) for i, t, y in [(1, b"", 0), (2, b"", 0), (3, b"you idiot", 1), (4, b"a fine day", 1), (6, texts[5].encode(), 0)] if zlib.crc32(str(i).encode()) % 5]
    assert seen == [([t for _, t, _ in want], [y for _, _, y in want])]


def test_isotonic_and_trees():
    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    y = (x[:, 1] > 0.6).astype(float)
    t = toxicity.Trees.fit(x, y, rounds=20)
    assert ((t.margin(x) > 0) == y).mean() > 0.98
    knots, levels = toxicity.isotonic(np.array([1.0, 2, 3, 3, 4]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(levels) >= 0).all() and levels[0] == 0 and levels[-1] == 1


def brute_leaks(docs, items):
    split = lambda t: [w for w in re.sub(r"[\W_]+", " ", t.lower()).split(" ") if w]
    out = {}
    for i, t in docs.items():
        w = split(t)
        d = [" ".join(w[k : k + 5]) for k in range(len(w) - 4)]
        for j, u in items.items():
            v = split(u)
            m = [" ".join(v[k : k + 5]) for k in range(len(v) - 4)]
            for s in range(len(d) - len(m) + 1) if m else []:
                part = d[s : s + len(m)]
                shared = sum(min(part.count(h), m.count(h)) for h in set(part))
                sim = shared / (2 * len(m) - shared)
                if sim >= 0.8 and sim > out.get((i, j), (0, 0))[0] + 1e-12:
                    out[i, j] = (sim, s)
    return out


def test_decontamination(spark):
    items = {0: prose(70, 30), 1: prose(71, 45), 2: "too short", 3: prose(72, 20), 4: None}
    cut = items[1].split()
    docs = {0: prose(80, 40) + " " + items[0].upper() + ", " + prose(81, 30), 1: prose(82, 20) + " " + " ".join([*cut[:43], "changed", "words"]), 2: " ".join(cut[:20]) + " " + prose(83, 30), 3: None, 4: items[3] + " " + items[3], 5: prose(84, 100), 6: "Wort, " + "; ".join(items[3].split())}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    df = frame(spark, list(docs.values()))
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontaminate.contaminated(df, bench).collect()}
    want = brute_leaks({i: t or "" for i, t in docs.items()}, {j: t or "" for j, t in items.items()})
    assert set(got) == set(want) == {(0, 0), (1, 1), (4, 3), (6, 3)}
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert sorted(r.doc_id for r in decontaminate.decontaminated(df, bench).collect()) == [2, 3, 5]
    assert decontaminate.contaminated(df.where("false"), bench).count() == decontaminate.contaminated(df, bench.where("false")).count() == 0


def test_decontamination_of_short_documents_and_null_ids(spark):
    item = [f"w{k}" for k in range(22)]
    texts = [(1, ["x", *item[1:-1], "y"]), (2, item[:-1]), (None, item), (3, item[:12])]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.start, round(r.similarity, 6)) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {(1, 0, 0.8), (2, 0, round(17 / 18, 6)), (None, 0, 1.0)}
    assert [r.doc_id for r in decontaminate.decontaminated(df, bench).collect()] == [3]


def test_pieces_equal_the_library(odd, none, monkeypatch):
    monkeypatch.setattr(pieces, "GIANT", 700)
    monkeypatch.setattr(pieces, "CHUNK", 300)
    sp = pieces.Pieces(pieces.MODEL).sp
    got = pieces.encode(odd).collect()
    want = {i: sp.encode(t) for i, t in texts_of(odd).items()}
    assert {r.doc_id: np.frombuffer(r.ids, np.int32).tolist() for r in got} == want
    for r in pieces.round_trip(odd).collect():
        assert r.decoded_crc32 == zlib.crc32(sp.decode(want[r.doc_id]).encode())
    assert pieces.round_trip(none).count() == 0


def test_visible_blanks_are_blanks(spark, monkeypatch):
    sp = pieces.Pieces(pieces.MODEL).sp
    texts = ["".join(t) for n in range(6) for t in itertools.product("a ▁", repeat=n)]
    got = pieces.plain_ids(texts, pieces.MODEL)
    assert [np.frombuffer(x, np.int32).tolist() for x in got] == [sp.encode(t) for t in texts]
    monkeypatch.setattr(pieces, "GIANT", 50)
    monkeypatch.setattr(pieces, "CHUNK", 20)
    rng = np.random.default_rng(1)
    long = ["".join(rng.choice(["a", " ", "▁", "the ", "ab"], 60)) for _ in range(8)]
    rows = {r.doc_id: np.frombuffer(r.ids, np.int32).tolist() for r in pieces.encode(frame(spark, long)).collect()}
    assert rows == {i: sp.encode(t) for i, t in enumerate(long)}


def test_scan_is_associative():
    a, b, c = {1: {2: 0.0, 3: 0.0}}, {2: {4: 0.0}, 3: {5: 0.0}}, {4: {6: 0.0}}
    assert pieces.product(pieces.product(a, b), c) == pieces.product(a, pieces.product(b, c)) == pieces.scan([a, b, c])[-1]


def test_pipeline_has_its_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "decontamination", "sentencepiece"]


def edited(words, every, seed):
    rng = np.random.default_rng(seed)
    return [word(rng, 6) if k % every == every - 1 else w for k, w in enumerate(words)]


def test_near_copies_by_five_word_shingles(spark):
    """A third of the rows are copies of one text; edited texts go from 0.8 on, others stay."""
    base = [prose(100 + k, 200).split() for k in range(20)]
    texts = [" ".join(b) for b in base]
    near = [" ".join(edited(b, 60, k)) for k, b in enumerate(base)]  # 3 of 200 words: about 0.86
    far = [" ".join(edited(b, 9, k)) for k, b in enumerate(base)]
    rows = [(k, t) for k, t in enumerate([*texts, *near, *far, *[texts[0]] * 40, None, "", " \n", "one two", "ONE  two"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.one_of_each(df).collect())
    words = {i: (t or "").lower().split() for i, t in rows}
    sets = {i: frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset() for i, w in words.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            union = len(sets[i] | sets[j])
            if (len(sets[i] & sets[j]) / union if union else 1.0) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = sorted({find(i) for i in sets})
    assert set(want) <= set(kept) and len(kept) <= len(want) + 2  # nine tenths of the twenty near copies at least


def test_decontamination_by_short_items_repeats_and_extra_columns(spark):
    bench = spark.createDataFrame([(5, "Yes, it is!"), (6, "yes it is"), (7, ""), (8, None), (9, " ".join(f"w{k}" for k in range(20)))], "item_id long, text string")
    rows = [(1, "YES it is"), (1, "YES it is"), (2, "yes it is so"), (3, "yes"), (4, None), (None, "yes: it is"), (1, " ".join(f"w{k}" for k in range(20)))]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, item_id string, start int, similarity int")
    got = sorted((r.doc_id or 0, r.item_id, r.similarity) for r in decontaminate.contaminated(df, bench).collect())
    assert got == [(0, 5, 1.0), (1, 5, 1.0), (1, 9, 1.0)]
    left = decontaminate.decontaminated(df, bench)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4]


def plain_kneser_ney(texts, order, modified):
    """Probability of a gram (a tuple of symbols), straight from the definition."""
    from collections import Counter, defaultdict

    tables = {order: Counter(g for t in texts for g in zip(*[([0] * (order - 1) + t)[k:] for k in range(order)]))}
    for m in range(order - 1, 0, -1):
        tables[m] = Counter(g[1:] for g in tables[m + 1])
    cuts = {}
    for m, c in tables.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        d = [k - ((k + 1) * y * n[k + 1] / n[k] if n[k] else k * 0.5) for k in (1, 2, 3)] if modified else [y] * 3
        cuts[m] = [max(0.05, min(x, 0.95 * (k + 1 if modified else 1))) for k, x in enumerate(d)]
    sums, taken = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(float))
    for m, c in tables.items():
        for g, n in c.items():
            sums[m][g[:-1]] += n
            taken[m][g[:-1]] += cuts[m][min(n, 3) - 1]

    def p(g):
        if not g:
            return 1 / 4096
        m, low = len(g), p(g[1:])
        if g[:-1] not in sums[m]:
            return low
        n, total = tables[m][g], sums[m][g[:-1]]
        return ((n - cuts[m][min(n, 3) - 1]) / total if n else 0.0) + taken[m][g[:-1]] / total * low

    return p


def symbols(text, letters_only):
    out = []
    for c in text:
        s = 1 if c.isspace() or (letters_only and not c.isalpha()) else ord(c)
        if s != 1 or not out or out[-1] != 1:
            out.append(s)
    return out


@pytest.mark.parametrize("shard", [quality.SHARD, 60])
def test_perplexity_against_the_definition(spark, shard):
    rows = [(1, "abra cadabra ab", "x"), (2, "banana band", "x"), (3, "le chat  et le chien", "y"), (4, "unseen zebra", "x"), (5, "un chat", "z"), (6, "", "x"), (7, None, None), (4, "unseen zebra", "x")]
    df = spark.createDataFrame([(*r, "q", 1.0) for r in rows], "doc_id long, text string, lang string, perplexity string, n double")
    good = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "doc_id long")
    got = [(r.doc_id, r.n_symbols, r.perplexity) for r in quality.perplexities(df, good, shard).collect()]
    assert len(got) == len(rows)
    texts = {i: symbols(t or "", False) for i, t, _ in rows}
    models = {"x": plain_kneser_ney([texts[1], texts[2]], 4, True), "y": plain_kneser_ney([texts[3]], 4, True), "": plain_kneser_ney([texts[1], texts[2], texts[3]], 4, True)}
    for i, t, lang in rows:
        s, p = texts[i], models.get(lang, models[""])
        logs = [np.log(p(tuple(([0] * 3 + s)[k : k + 4]))) for k in range(len(s))]
        want = np.exp(-np.mean(logs)) if s else None
        assert any(a == i and n == len(s) and (v == want if want is None else v == pytest.approx(want, rel=1e-9)) for a, n, v in got)
    assert quality.perplexities(df.where("false"), good).count() == 0
    assert [r.keep for r in quality.quality(df, spark.createDataFrame([], "doc_id long, quality int")).collect()] == [False] * len(rows)


@pytest.mark.parametrize("most", [language.SHARD, 40])
def test_entropies_against_the_definition(spark, most):
    rows = [(1, "the cat and the hat", "en"), (3, "a band of men", "en"), (4, "le chat et le chien", "fr"), (20, "the chien zzz", None), (20, "the chien zzz", None)]
    assert all(zlib.crc32(str(r[0]).encode()) % 4 != 2 for r in rows[:3])
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = language.predict(df, *language.train(df, most)).collect()
    models = {x: plain_kneser_ney([symbols(t, True) for _, t, y in rows if y == x], 4, False) for x in ("en", "fr")}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        s = symbols(t, True)
        each = {x: -np.mean([np.log(p(tuple(([0] * 3 + s)[k : k + 4]))) for k in range(len(s))]) for x, p in models.items()}
        best = min(each, key=each.get)
        assert all(r.lang_pred == best and r.entropy == pytest.approx(each[best], rel=1e-5) for r in got if r.doc_id == i)
