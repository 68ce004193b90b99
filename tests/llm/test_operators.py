"""Operators of the pipeline on small rows: against brute force, exact round trips, and the
cases that every one of them must take (nulls, empty and long texts, repeated rows, no rows,
other columns of the same names)."""

import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chartmeter.llm import (
    components,
    decontaminate,
    html_text,
    id_coder,
    pieces,
    ppm,
    quality_rules,
    quality_trees,
    secret_scan,
    simhash,
    token_files,
    toxicity,
    word_ids,
)
from chartmeter.llm.common import slices
from chartmeter.llm.queries import tokenizer

DOCS = "doc_id long, text string"
LONG = " ".join(f"word{i % 997} text{i % 31}" for i in range(60_000))
#: A null text, an empty one, blanks, a very long one, a repeated row and a null id.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e")]


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


# -- shared parts ------------------------------------------------------------------------


def test_slices_keep_every_row(spark):
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401

    batch = pa.record_batch([pa.array(["x" * (9 << 20), None, "y" * (9 << 20), "z"])], ["text"])
    parts = list(slices(iter([batch]), "text"))
    assert [p.num_rows for p in parts] == [2, 2]
    assert pa.Table.from_batches(parts)["text"].to_pylist() == batch["text"].to_pylist()


def test_components_of_paths_stars_and_rings(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    links = chain + [(7, i) for i in range(8, 20)] + [(50, 51), (51, 52), (52, 50), (50, 51), (3, 3), (None, 4)]
    random.Random(3).shuffle(links)
    found = dict(rows(components.components(spark.createDataFrame(links, "a long, b long")), "node", "root"))
    assert found == {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 20)} | {50: 50, 51: 50, 52: 50}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 1 SimHash ---------------------------------------------------------------------------


def _fingerprint(text):
    """Bit by bit, from the contract."""
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", text.lower())
    if not words:
        return 0
    hashes = [xxhash.xxh64(b" ".join(words[i : i + 4]), seed=42).intdigest() for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for text in (b"", b" \n", b"One", b"a b c", b"A b C d e f a b c d", "é Ü ß x\x0by".encode()):
        assert simhash.fingerprint(text) == _fingerprint(text)


def test_fingerprint_of_a_long_text_is_that_of_its_parts_together(monkeypatch):
    text = LONG.encode()[:40_000]
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_BLOCK", 77)
    assert simhash.fingerprint(text) == whole


@pytest.mark.parametrize("radius", [2, 4])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(radius)
    for _ in range(3000):
        difference = sum(1 << b for b in rng.sample(range(64), rng.randint(1, radius)))
        assert any(m & difference == 0 for m in masks)


def _groups(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("crowded", [512, 3])
def test_simhash_groups_are_those_of_all_pairs(spark, crowded):
    rng = random.Random(5)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(150)] for _ in range(6)]
    docs = []
    for i in range(120):
        words = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 60))):
            words[rng.randrange(len(words))] = f"new{rng.randint(0, 99)}"
        docs.append((1000 - i, " ".join(words)))
    docs += [(5000, None), (5001, ""), (5002, "Short"), (5003, "short")]
    found = simhash.simhash_groups(spark.createDataFrame(docs, DOCS), crowded=crowded)
    expected = _groups({i: _fingerprint((t or "").encode()) for i, t in docs})
    assert len(set(expected.values())) < len(docs) - 5
    assert dict(rows(found, "doc_id", "component_id")) == expected


def test_pipeline_keeps_one_document_of_each_group(spark):
    words = [f"w{i}" for i in range(400)]
    near = [*words[:40], "x", *words[41:]]
    texts = {1: words, 2: near, 3: words[200:]}
    assert (_fingerprint(" ".join(words).encode()) ^ _fingerprint(" ".join(near).encode())).bit_count() <= 4
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], DOCS)
    assert rows(corpus_pipeline.drop_near_duplicates(spark, docs, ""), "doc_id") == [(1,), (3,)]


def test_a_clashing_id_loses_no_other_text(spark):
    copy, other = "a b c d e f g", "something else altogether is here"
    table = [(1, copy, "x"), (2, copy, "x"), (2, other, "x"), (7, "q r s", "z"), (7, "q r s", "y"), (7, "q r s", "y")]
    kept = simhash.keep_one(spark.createDataFrame(table, DOCS + ", source string"))
    assert rows(kept, "doc_id", "text", "source") == sorted([(1, copy, "x"), (2, other, "x"), (7, "q r s", "y")], key=str)


def test_simhash_odd_rows(spark):
    docs = spark.createDataFrame([(*r, "x") for r in ODD], DOCS + ", fp string")
    found = rows(simhash.simhash_groups(docs), "doc_id", "component_id")
    assert found == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (5, 5), (None, 5)], key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert rows(kept, "doc_id") == sorted([(1,), (4,), (5,), (None,)], key=str)
    assert simhash.simhash_groups(spark.createDataFrame([], DOCS)).count() == 0
    nameless = spark.createDataFrame([(None, "q r s t")], DOCS)
    assert rows(simhash.simhash_groups(nameless), "component_id") == [(None,)]


# -- 2 SentencePiece ---------------------------------------------------------------------


def test_pieces_equal_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    rng = random.Random(2)
    parts = ["the", "in", "er", " ", "  ", "▁", "é", "1", "\n", "日本", "😀", "\x00", "<0x41>", "<s>", "tion", "://", "�"]
    cases = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    cases += ["", " ", "ab" * 3000, "x" * 9000 + "é", LONG[:5000]]
    docs = spark.createDataFrame(list(enumerate(cases)), DOCS)
    encoded = pieces.encode(docs, tokenizer("piece_bpe_32k.model"), decoded="decoded").collect()
    for row in encoded:
        ids = library.encode(cases[row.doc_id])
        assert (row.ids, row.decoded) == (ids, library.decode(ids))


def test_pieces_odd_rows(spark):
    model = tokenizer("piece_bpe_32k.model")
    docs = spark.createDataFrame([(*r, "old") for r in ODD], DOCS + ", ids string")
    encoded = pieces.encode(docs, model, decoded="decoded")
    assert encoded.columns == ["doc_id", "text", "ids", "decoded"]
    found = {(r.doc_id, r.text): (len(r.ids), r.decoded) for r in encoded.collect()}
    assert found[1, None] == (0, "") and found[2, ""] == (0, "")
    assert found[4, LONG][1] == LONG
    assert encoded.count() == len(ODD)
    again = pieces.decode(encoded.select("doc_id", "ids"), model)
    assert rows(again, "doc_id", "text") == rows(encoded, "doc_id", "decoded")
    assert pieces.encode(spark.createDataFrame([], DOCS), model).count() == 0
    same = pieces.encode(docs.select("doc_id", "text"), model, decoded="text")
    assert sorted(same.columns) == ["doc_id", "ids", "text"]


# -- 3 token files -----------------------------------------------------------------------


@pytest.mark.parametrize(
    "ids",
    [
        np.zeros(0, int),
        np.array([65535]),
        np.full(5000, 3),
        np.random.default_rng(0).integers(0, 65536, 4500),
        np.random.default_rng(1).zipf(1.3, 9000) % 49408,
    ],
    ids=["none", "one", "same", "random", "skewed"],
)
def test_ids_survive_a_round_trip(ids):
    packed = id_coder.pack(ids)
    assert (id_coder.unpack(packed) == ids).all()
    if len(ids) > 8:
        assert len(packed) < 2.4 * len(ids) + 100


def test_repeating_ids_take_little_room():
    ids = np.tile(np.random.default_rng(2).integers(0, 49408, 40), 200)
    assert len(id_coder.pack(ids)) < 0.3 * len(ids)


def test_damage_is_noticed():
    packed = bytearray(id_coder.pack(np.arange(3000)))
    packed[40] ^= 255
    with pytest.raises(ValueError):
        id_coder.unpack(bytes(packed))
    with pytest.raises(ValueError):
        id_coder.pack(np.array([1 << 16]))


def _text_ids():
    """Ids of made-up sentences of 4,000 words, some of which like to follow one another."""
    rng = np.random.default_rng(3)
    follow = rng.integers(0, 4000, 4000)
    ids = rng.zipf(1.2, 1 << 18) % 4000
    for t in np.flatnonzero(rng.random(len(ids)) < 0.4):
        ids[t] = follow[ids[t - 1]]
    return ids * 11


def test_ids_of_texts_take_less_room_than_zlib():
    ids = _text_ids()
    assert len(id_coder.pack(ids)) < len(zlib.compress(ids.astype("<u2").tobytes(), 6))


def test_ids_are_coded_and_read_in_little_time():
    """At most 40 additions in Python an id; it was over 80."""
    ids = np.tile(_text_ids(), 4)
    id_coder.unpack(id_coder.pack(ids[:1000]))
    start = time.thread_time()
    for _ in range(10):
        sum(range(1 << 20))
    addition = (time.thread_time() - start) / (10 << 20)
    start = time.thread_time()
    found = id_coder.unpack(id_coder.pack(ids))
    assert time.thread_time() - start < 40 * addition * len(ids)
    assert (found == ids).all()


def test_blocks_do_not_depend_on_those_coded_in_step(monkeypatch):
    ids = _text_ids()[:9000]
    packed = id_coder.pack(ids)
    monkeypatch.setattr(id_coder, "LANES", 4)
    assert id_coder.pack(ids) == packed
    assert (id_coder.unpack(packed) == ids).all()


def test_damage_anywhere_is_noticed():
    packed = id_coder.pack(_text_ids()[:3000])
    for at in range(0, len(packed), 97):
        damaged = bytearray(packed)
        damaged[at] ^= 16
        with pytest.raises(ValueError):
            id_coder.unpack(bytes(damaged))


def test_ids_of_other_tokenizers(tmp_path):
    from tokenizers import Tokenizer

    with open(tokenizer("word_bpe_49k.json"), encoding="utf-8") as file:
        other = json.load(file)
    other["normalizer"]["normalizers"].pop()
    (tmp_path / "cased.json").write_text(json.dumps(other))
    letters = "".join(map(chr, range(0xC0, 0x180)))
    values = ["Some Words, some WORDS.", None, "", "it's É <|endoftext|> a;b 12", " ".join(letters), letters, "ªº µ a\u0301 naïve\xad"]
    values.append("a### é$$. x', it's, x<|endoftext|>. y<|z 5%% don't!?& A> b>\u0338 'tis #'s _a_ ñ)] ΑΣ# ß~ ÿ{ \u00d7. ÷!")
    for path, exact in ((tokenizer("word_bpe_49k.json"), True), (str(tmp_path / "cased.json"), False)):
        assert word_ids.fits(path) == exact
        library = Tokenizer.from_file(path)
        want = [library.encode(x or "", add_special_tokens=False).ids for x in values]
        ids, ends = token_files._encoder(path)(pa.record_batch({"t": pa.array(values)}), "t")
        assert ids.tolist() == sum(want, [])
        assert ends.tolist() == np.cumsum([len(x) for x in want]).tolist()


def test_token_files_equal_the_library(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    file = tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(file)
    docs = [(i * 7 % 101, f"Text {i} it's é ﬁ <|endoftext|> ΑΣ. {'long ' * (i % 9)}") for i in range(101)] + [(200, None), (201, "")]
    random.Random(1).shuffle(docs)
    monkeypatch.setattr(token_files, "SEGMENT", 40)
    token_files.write(spark.createDataFrame(docs, DOCS).repartition(3), str(tmp_path / "f"), file, end=2)
    found = token_files.read(spark, str(tmp_path / "f")).collect()
    at = 0
    assert len(found) == len(docs)
    for row, (doc_id, text) in zip(sorted(found, key=lambda r: r.start), sorted(docs)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        crc = zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32, row.ids) == (doc_id, at, len(ids), crc, ids)
        at += len(ids)


def test_token_files_odd_rows(spark, tmp_path):
    file = tokenizer("word_bpe_49k.json")
    token_files.write(spark.createDataFrame([(*r, 1) for r in ODD], DOCS + ", start int"), str(tmp_path / "f"), file, end=2)
    found = sorted(token_files.read(spark, str(tmp_path / "f"), ids=False).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, 1, 2, 3, 4, 5, 5]
    assert found[1].n_tokens == found[2].n_tokens == found[3].n_tokens == 1
    token_files.write(spark.createDataFrame([], DOCS), str(tmp_path / "g"), file, end=2)
    assert token_files.read(spark, str(tmp_path / "g")).count() == 0


# -- 4 quality trees ---------------------------------------------------------------------


def test_trees_learn_and_score_alike_row_by_row():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = quality_trees.grow(x[:1000], y[:1000])
    score = trees.score(x[1000:])
    assert ((score > 0.5) == (y[1000:] == 1)).mean() > 0.93
    for row in range(1000, 1010):  # by walking each tree
        total = trees.base
        for t in range(len(trees.feature)):
            at = 0
            while at < trees.feature.shape[1]:
                at = 2 * at + (2 if x[row, trees.feature[t, at]] > trees.cut[t, at] else 1)
            total += trees.leaf[t, at - trees.feature.shape[1]]
        assert score[row - 1000] == pytest.approx(1 / (1 + math.exp(-total)))


def _labelled(spark, bad):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(400):
        words = [f"w{rng.randint(0, 300)}" for _ in range(80)]
        y = int(rng.random() < 0.3)
        docs.append((i, " ".join(bad(words, rng) if y else words)))
        labels.append((i, y))
    return spark.createDataFrame(docs, DOCS).repartition(4), labels


def test_quality_on_held_out_rows(spark):
    docs, labels = _labelled(spark, lambda words, rng: [w + "$$$" for w in words])
    table = spark.createDataFrame([(i, 1 - y) for i, y in labels] + [(None, 1), (3, None)], "doc_id long, quality int")
    truth = {i: 1 - y for i, y in labels}
    held = [r for r in quality_trees.quality_scores(docs, table).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 40 and all((r.score > 0.5) == (truth[r.doc_id] == 1) for r in held)


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 0.0) for r in ODD], DOCS + ", score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    found = quality_trees.quality_scores(docs, none)
    assert [r.score for r in found.collect()] == [0.5] * len(ODD)
    assert quality_trees.quality_scores(spark.createDataFrame([], DOCS), none).count() == 0


# -- 5 secret scan -----------------------------------------------------------------------

ASSIGN = re.compile(
    r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def _base_spans(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_base_spans_by_brute_force(spark):
    rng = random.Random(6)
    parts = ["password", "Passwd", "API_KEY", "apikey", "secret", "token", '"', "'", " ", "=", ":", "AKIA", "ABCDEFGHIJKLMN", "0123456789abcdef", "abc", "é😀", "\n", "x" * 12, "-", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(500)]
    found = secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), DOCS))
    got = dict(rows(found.select("doc_id", secret_scan.span_text(F.col("base_spans")).alias("s")), "doc_id", "s"))
    assert got == {i: _base_spans(t) for i, t in enumerate(texts)}
    assert sum(bool(v) for v in got.values()) > 100


def test_entropy_is_that_of_the_best_window(spark):
    rng = random.Random(7)
    alphabet = secret_scan.ALPHABET
    values = ["".join(rng.choice(alphabet[: rng.choice((2, 16, 66))]) for _ in range(rng.randint(15, 60))) for _ in range(60)]

    def entropy(s):
        return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())

    w = secret_scan.WINDOW
    found = spark.createDataFrame(list(enumerate(values)), DOCS).select("doc_id", secret_scan.best_entropy(F.col("text")).alias("e"))
    for i, e in rows(found, "doc_id", "e"):
        windows = [values[i][k : k + w] for k in range(len(values[i]) - w + 1)]
        assert e == pytest.approx(max(map(entropy, windows), default=-1.0))


def test_entropy_spans_and_what_is_allowed(spark):
    texts = {
        "sk 9aF3kQ7zX1mB5tR8wY2cP0 end": "entropy:3:25",
        "123e4567-e89b-12d3-a456-426614174000": "",
        "donaudampfschifffahrtsgesellschaft": "",
        "a-long-name-of-words-joined-by-dashes": "",
        "12345678901234567890123456": "hex:0:26",
        "token=9aF3kQ7zX1mB5tR8wY2cP0": "assign:0:28",
        "====================================": "",
    }
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    found = secret_scan.scan(df).select("text", secret_scan.span_text(F.col("spans")).alias("s"))
    assert dict(rows(found, "text", "s")) == texts


def test_thousands_of_secrets_in_one_text(spark):
    """Spans over many blocks, of kinds that overlap, against Python's regular expressions."""
    import time

    rng = random.Random(5)
    lines = []
    for i in range(16000):
        digest = "".join(rng.choices("0123456789abcdef", k=16))
        lines.append(rng.choice([digest, f"é token={digest} 😀", f"secret: {digest}.{digest}", f"AKIA{digest.upper()}"]))
    text = "\n".join(lines)
    assert len(text) > 336_000
    base = [(m.start(), 2, m.end()) for m in re.finditer(secret_scan.HEX, text)]
    base += [(m.start(), 1, m.end()) for m in re.finditer(secret_scan.ACCESS, text)]
    base += [(m.start(), 0, m.end()) for m in re.finditer(secret_scan.ASSIGN, text) if len(m[2]) >= secret_scan.ASSIGN_VALUE]
    df = spark.createDataFrame([(1, text)], DOCS)
    secret_scan.mask(df.limit(0)).count()
    began = time.monotonic()
    found, masked = secret_scan.scan(df).select("base_spans", "spans").first(), secret_scan.mask(df).first()
    assert time.monotonic() - began < 20
    assert [(s["start"], s.kind_no, s.end) for s in found.base_spans] == sorted(base)
    spans = [(s["start"], s.kind_no, s.end) for s in found.spans]
    assert [s for s in spans if s[1] < 3] == sorted(base) and spans == sorted(spans)
    fixed = sorted((a, b) for a, _, b in base)
    for a, _, b in (s for s in spans if s[1] == 3):
        assert not any(x < b and a < y for x, y in fixed)
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    assert masked.text == "".join(out) + text[at:]


def test_secrets_odd_rows_and_masks(spark):
    docs = spark.createDataFrame([(*r, 0, 1) for r in ODD], DOCS + ", n_chars int, spans int")
    scanned = secret_scan.scan(docs)
    assert all(r.spans == [] and r.base_spans == [] for r in scanned.collect())
    masked = secret_scan.mask(docs)
    assert masked.columns == docs.columns and rows(masked, *docs.columns) == rows(docs, *docs.columns)
    one = spark.createDataFrame([(1, 'é password: "hunter2hunter2!" 0123456789abcdef0123 z', 3)], DOCS + ", n_chars int")
    assert rows(secret_scan.mask(one), "text", "n_chars") == [('é [SECRET]!" [SECRET] z', 23)]
    assert secret_scan.scan(spark.createDataFrame([], DOCS)).count() == 0


# -- 6 toxicity --------------------------------------------------------------------------


def test_segments_are_all_maximal_ones():
    def maximal(scores):
        """From the definition: of highest score, then left and right of it."""
        best = max(((sum(scores[a:b]), -(b - a), -a, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=None)
        if not best or best[0] <= 0:
            return []
        a, b = best[3:]
        return maximal(scores[:a]) + [(a, b, best[0])] + [(c + b, d + b, s) for c, d, s in maximal(scores[b:])]

    rng = random.Random(8)
    for _ in range(300):
        scores = [rng.choice((-3, -2, -1, 1, 2, 3)) + rng.random() / 7 for _ in range(rng.randint(0, 14))]
        found = toxicity.segments(np.array(scores))
        expected = maximal(scores)
        assert [f[:2] for f in found] == [e[:2] for e in expected]
        assert [f[2] for f in found] == pytest.approx([e[2] for e in expected])


def test_toxicity_on_held_out_rows(spark):
    insults = ["grobb", "snurf", "zlatt"]

    def bad(words, rng):
        at = rng.randrange(len(words) - 4)
        return words[:at] + [rng.choice(insults) + rng.choice(("", "ing", "ed")) + "," for _ in range(3)] + words[at:]

    docs, labels = _labelled(spark, bad)
    table = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, table)
    truth = dict(labels)
    found = toxicity.toxicity(docs, model).collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all((r.score >= 0.5) == (truth[r.doc_id] == 1) for r in held)
    assert all(bool(r.passages) == (truth[r.doc_id] == 1) for r in held)
    kept = toxicity.without_toxic(docs.withColumn("score", F.lit("x")), model)
    assert kept.columns == ["doc_id", "text", "score"]
    assert rows(kept, "doc_id") == sorted(((r.doc_id,) for r in found if r.score < 0.5), key=str)


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 0.0) for r in ODD], DOCS + ", score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    found = toxicity.toxicity(docs, model).collect()
    assert len(found) == len(ODD) and all(r.score < 0.01 and r.passages == [] for r in found)
    assert toxicity.toxicity(spark.createDataFrame([], DOCS), model).count() == 0
    assert toxicity.without_toxic(docs, model).count() == len(ODD)


# -- 7 language scores -------------------------------------------------------------------


def _ppm(docs, order):
    """Tokens, known ones, base and model score by walking the contexts symbol by symbol."""
    train, n = Counter(), 0
    for i, text in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update((text or "").encode().lower().split())
            n += 1
    seen = defaultdict(Counter)

    def learn(gram, times):
        for k in range(len(gram)):
            seen[gram[k:-1]][gram[-1]] += times

    for word, times in train.items():
        for gram in ppm.grams(word, order):
            learn(gram, times)
    if n:
        learn(b" \r", n)

    def length(gram):
        excluded, total = set(), 0.0
        for k in range(len(gram)):
            left = {s: c for s, c in seen.get(gram[k:-1], {}).items() if s not in excluded}
            if left:
                all_of = sum(left.values()) + len(left)
                if gram[-1] in left:
                    return total + math.log10(left[gram[-1]] / all_of)
                total += math.log10(len(left) / all_of)
                excluded |= set(left)
        return total - math.log10(ppm.SYMBOLS - len(excluded))

    tokens, kinds = sum(train.values()) + n, len(train) + (n > 0)
    out = {}
    for i, text in docs:
        words = (text or "").encode().lower().split()
        counts = [train[w] for w in words] + [n]
        base = sum(math.log10((c + 1) / (tokens + kinds + 1)) for c in counts)
        score = sum(length(g) for w in words for g in ppm.grams(w, order)) + length(b" \r")
        out[i] = (len(words) + 1, sum(c > 0 for c in counts), tokens, base, score)
    return out


@pytest.mark.parametrize("frequent", [ppm.FREQUENT, 40])
def test_language_scores_by_brute_force(spark, frequent, monkeypatch):
    monkeypatch.setattr(ppm, "FREQUENT", frequent)
    rng = random.Random(9)
    syllables = ["th", "er", "on", "an", "é", "re", "he", "in"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(120)]
    docs = [(i, " ".join(rng.choice(words[: rng.choice((5, 120))]) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    docs += [(60, None), (61, "new ZZZ zq"), (62, " ")]
    expected = _ppm(docs, ppm.ORDER)
    found = ppm.language_scores(spark.createDataFrame(docs, DOCS)).collect()
    assert len(found) == len(docs)
    for r in found:
        assert (r.n_tokens, r.n_known, r.train_tokens) == expected[r.doc_id][:3]
        assert (r.base_score, r.score) == pytest.approx(expected[r.doc_id][3:])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)


def test_gram_table_finds_what_it_holds():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 1000):
        keys = np.unique(rng.integers(0, 1 << 48, n))
        table = ppm.gram_table(keys, keys * 0.5)
        asked = np.concatenate((keys, keys + 1, rng.integers(0, 1 << 48, 50)))
        at = ppm.find_grams(table, asked)
        held = np.isin(asked, keys)
        assert ((at >= 0) == held).all() and (table[1][at[held]] == asked[held] * 0.5).all()


def test_language_scores_across_words_of_empty_and_repeated_rows(spark):
    assert ppm.language_scores(spark.createDataFrame([], "doc_id long, text string"), across=True).count() == 0
    rows = [(2, None, "x"), (2, "", "y"), (2, "a b", "z"), (2, "a b", "z"), (None, " ", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = sorted((r.doc_id or 0, r.n_tokens, r.train_tokens, round(r.score, 9)) for r in ppm.language_scores(df, across=True).collect())
    assert [f[:3] for f in found] == [(0, 1, 9), (2, 1, 9), (2, 1, 9), (2, 3, 9), (2, 3, 9)]
    assert found[0][3] == found[1][3] == found[2][3] and found[3] == found[4]


@pytest.mark.parametrize("frequent", [ppm.FREQUENT_GRAMS, 40])
def test_language_scores_across_words_by_brute_force(spark, frequent, monkeypatch):
    monkeypatch.setattr(ppm, "FREQUENT_GRAMS", frequent)
    rng = random.Random(10)
    words = ["".join(rng.choice(("th", "er", "é", "in")) for _ in range(rng.randint(1, 3))) for _ in range(40)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(40)]
    docs += [(60, None), (61, "new ZZZ zq"), (62, " ".join(words[:9])), (63, " ".join(words[8::-1]))]
    whole = {i: b" " + b"".join(w + b"\n" for w in (t or "").encode().lower().split()) + b"\r" for i, t in docs}
    seen = defaultdict(Counter)
    for i, s in whole.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for j in range(1, len(s)):
                for k in range(max(0, j - ppm.ORDER), j + 1):
                    seen[s[k:j]][s[j]] += 1

    def length(context, symbol):
        excluded, total = set(), 0.0
        for k in range(len(context) + 1):
            left = {s: c for s, c in seen.get(context[k:], {}).items() if s not in excluded}
            if left:
                all_of = sum(left.values()) + len(left)
                if symbol in left:
                    return total + math.log10(left[symbol] / all_of)
                total += math.log10(len(left) / all_of)
                excluded |= set(left)
        return total - math.log10(ppm.SYMBOLS - len(excluded))

    found = {r.doc_id: r.score for r in ppm.language_scores(spark.createDataFrame(docs, DOCS), across=True).collect()}
    for i, s in whole.items():
        assert found[i] == pytest.approx(sum(length(s[max(0, j - ppm.ORDER) : j], s[j]) for j in range(1, len(s))))
    assert found[62] != pytest.approx(found[63])  # the order of words counts


def test_language_scores_odd_rows(spark):
    found = ppm.language_scores(spark.createDataFrame([(*r, 1) for r in ODD], DOCS + ", n_tokens int")).collect()
    assert sorted(r.n_tokens for r in found) == [1, 1, 1, 6, 6, 6, 120_001]
    assert not [r for r in found if r.doc_id is None and r.held_out]
    assert ppm.language_scores(spark.createDataFrame([], DOCS)).count() == 0


# -- 8 main text -------------------------------------------------------------------------

PARAGRAPH = "Several words of a paragraph that is long enough to be the text of a page."
PAGES = {
    f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>A &amp; B</h1><p>{PARAGRAPH}<p>Yes.</p><p>{PARAGRAPH}</article><footer>&copy; me</footer>": f"A & B\n{PARAGRAPH}\nYes.\n{PARAGRAPH}",
    f"<body><header><h1>Site</h1></header><div id=main-content><h2>Head</h2><p>{PARAGRAPH}<p>Two <b>bold</b>\n\twords</div><div class='cookie-notice'>Cookies!</div><aside>{PARAGRAPH}</aside><section class=comments><p>{PARAGRAPH}</section>": f"Head\n{PARAGRAPH}\nTwo bold words",
    f"<main><form><p>{PARAGRAPH}</form><p>{PARAGRAPH}</p><script>var a = '</p><p>no</p>';</script><!-- <p>no</p> --><div class=ad>Buy</div></main>": PARAGRAPH,
    "<nav>only a menu</nav>": "",
    "no tags &lt;b&gt; at   all": "no tags <b> at all",
    "<p>unclosed <div><p>": "unclosed",
    "<article><p>&amp;amp; once</article>": "&amp; once",
    "": "",
}


@pytest.mark.parametrize("html", PAGES)
def test_main_text(html):
    assert html_text.main_text(html) == PAGES[html]


def test_main_text_does_not_depend_on_how_it_is_fed(monkeypatch):
    monkeypatch.setattr(html_text, "CHUNK", 3)
    for html, text in PAGES.items():
        assert html_text.main_text(html) == text


def test_pages_odd_rows(spark):
    long = "<article>" + f"<p>{PARAGRAPH}" * 20_000
    pages = [(1, None, None, "x"), (None, "u", "", "x"), (2, "u", long, "x"), (2, "u", "<p>a", "x"), (2, "u", "<p>a", "x")]
    found = html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string, text string"))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert rows(found, "page_id", "n_chars") == sorted([(1, 0), (None, 0), (2, 20_000 * (len(PARAGRAPH) + 1) - 1), (2, 1), (2, 1)], key=str)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# -- 9 decontamination -------------------------------------------------------------------


def _contained(docs, items):
    out = []
    for i, text in docs:
        words = (text or "").encode().lower().split()
        for j, item in items:
            own = (item or "").encode().lower().split()
            k = min(5, len(own))
            if k:
                want = {tuple(own[a : a + k]) for a in range(len(own) - k + 1)}
                n = len(want & {tuple(words[a : a + k]) for a in range(len(words) - k + 1)})
                if 5 * n >= 4 * len(want):
                    out.append((i, j, len(want), n))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [decontaminate.BLOCK_BYTES, 300])
def test_contained_items_by_brute_force(spark, limit):
    rng = random.Random(10)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(j, " ".join(rng.choice(vocabulary) for _ in range(rng.choice((1, 2, 4, 5, 6, 9, 30, 70))))) for j in range(25)]
    docs = []
    for i in range(80):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 200))]
        part = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, len(part) // 15 + 1)):
            part[rng.randrange(len(part))] = "Other"
        at = rng.randint(0, len(words))
        docs.append((i, " ".join(words[:at] + [w.upper() for w in part] + words[at:])))
    found = decontaminate.contained_items(
        spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), limit=limit
    )
    expected = _contained(docs, items)
    assert len(expected) > 40
    assert rows(found, "doc_id", "item_id", "n_shingles", "n_found") == expected
    kept = decontaminate.without_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), limit)
    assert rows(kept, "doc_id") == sorted(((i,) for i in {i for i, _ in docs} - {e[0] for e in expected}), key=str)


def test_contained_items_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 9) for r in ODD], DOCS + ", item_id int")
    items = spark.createDataFrame([(1, None), (2, ""), (3, "A b C d e"), (None, "a b c d e"), (4, "e")], "item_id long, text string")
    found = decontaminate.contained_items(docs, items)
    expected = [(d, i) for d in (5, 5, None) for i in (3, None, 4)]
    assert rows(found, "doc_id", "item_id") == sorted(expected, key=str)
    assert decontaminate.contained_items(docs, items.limit(0)).count() == 0
    assert decontaminate.contained_items(docs.limit(0), items).count() == 0
    kept = decontaminate.without_items(docs, items)
    assert kept.columns == docs.columns and rows(kept, "doc_id") == [(1,), (2,), (3,), (4,)]
    assert decontaminate.without_items(docs, items.limit(0)).count() == len(ODD)


# -- 10 quality rules --------------------------------------------------------------------


def _measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_measures_by_brute_force(spark):
    rng = random.Random(11)
    parts = ["a", "b", "c", "é$", "|", "\n", "\x0b", "\r", "  ", "😀", "Word"]
    docs = [(i, "".join(rng.choice(parts) + rng.choice((" ", " ", "")) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    docs += [(1000 + k, t) for k, (_, t) in enumerate(ODD)]
    found = quality_rules.measure(spark.createDataFrame(docs, DOCS))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found.collect()}
    assert got == {i: _measures(t) for i, t in docs}


def test_policies_and_ablation(spark):
    good = " ".join(f"word{i}" for i in range(60))
    texts = [good, "few words", good + " $$$$$$$$$$", good.upper(), "same " * 80, None, ""]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], DOCS + ", kept boolean")
    found = quality_rules.quality_rules(docs)
    assert rows(found, "doc_id", "base_failed", "kept") == [
        (0, False, True), (1, True, False), (2, False, False), (3, False, False), (4, True, False), (5, True, False), (6, True, False),
    ]
    base = quality_rules.quality_rules(docs, "base")
    assert [k for _, k in rows(base, "doc_id", "kept")] == [True, False, True, True, False, False, False]
    counts = {r.rule: (r.n_failed, r.n_only_this) for r in quality_rules.ablation(found, "v1").collect()}
    assert counts["few_words"] == (3, 3) and counts["symbols"] == (1, 1) and counts["shouting"] == (1, 1)
    assert counts["repeated_windows"] == (1, 0)
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_native_operators_run_no_python(spark):
    docs = spark.createDataFrame([(1, "a")], DOCS)
    for df in (quality_rules.quality_rules(docs), secret_scan.scan(docs), secret_scan.mask(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


