"""Packing: pieces against the tokenizers library, sequences against the least possible number."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from chartmeter.llm import packing, queries, word_ids
from chartmeter.llm.queries import tokenizer

MODEL = tokenizer("word_bpe_49k.json")
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(MODEL)


def test_word_ids_equal_the_library(library, monkeypatch):
    monkeypatch.setattr(word_ids, "MEMO", 3000)
    rng = random.Random(1)
    letters = "aAbB'. ,;:!?sStT\n\t\x0b\x85 é́̇Iİſß1２9_-&<|>中ᾳΣσς'ͅ "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts += [None, "", " \n", "a<|endoftext|>b.", "<|ENDOFTEXT|> x", "<|startoftext|>A.,", "foo.<|endoftext|>.", "I'll, don't."]
    words = word_ids.WordIds(MODEL)
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        ids, ends = words.encode(pa.array(part, pa.string()))
        got = [x.tolist() for x in np.split(ids, ends[:-1])]
        assert got == [library.encode(t or "", add_special_tokens=False).ids for t in part]


def test_best_fit_takes_the_least_room():
    bins = packing.best_fit(np.array([3, 6, 5, 4, 2, 10]), 10)
    assert sorted(map(sorted, bins)) == [[0, 2, 4], [1, 3], [5]]


@pytest.mark.parametrize("seed", range(6))
def test_exchanges_save_sequences(seed):
    """Sequences cut to pieces without a rest: best fit alone needs more."""
    rng = random.Random(seed)
    sizes = []
    for _ in range(60):
        cuts = sorted(rng.sample(range(1, 300), rng.randint(2, 3)))
        sizes += [b - a for a, b in zip([0, *cuts], [*cuts, 300])]
    sizes = np.array(rng.sample(sizes, len(sizes)))
    bins = packing.packed(sizes, 300, effort=5000)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(0 < sizes[b].sum() <= 300 for b in bins)
    assert 60 <= len(bins) <= len(packing.best_fit(sizes, 300)) and len(bins) <= 61


def test_every_exchange_adds_to_the_squared_fill():
    rng = random.Random(3)
    sizes = np.array([rng.randint(20, 60) for _ in range(80)])
    search = packing._Search(sizes, packing.best_fit(sizes, 100), 100)
    while True:
        before, order = (search.fill**2).sum(), np.argsort(search.fill, kind="stable")
        giver = next((b for b in order.tolist() if 0 < search.fill[b] < 100 and search.give(b)), None)
        assert search.fill.sum() == sizes.sum() and search.fill.max() <= 100
        if giver is None:
            break
        assert (search.fill**2).sum() > before
    # Nothing is left to gain by any exchange of one or two for none, one or two.
    for b, own in enumerate(search.bins):
        for t, other in enumerate(search.bins):
            gives = [(i,) for i in own] + [(i, j) for i in own for j in own if i < j]
            for given in gives if t != b else ():
                backs = [(i,) for i in other] + ([()] + [(i, j) for i in other for j in other if i < j] if len(given) == 1 else [])
                for back in backs:
                    more = int(sizes[list(given)].sum()) - (int(sizes[list(back)].sum()) if back else 0)
                    gain = more * (search.fill[t] - search.fill[b] + more)
                    assert more <= 0 or gain <= 0 or search.fill[t] + more > 100


def check(library, docs, rows, length):
    """Every piece once, with its ids; sequences without gaps; returns how many there are."""
    expected = []
    for i, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), length)):
            part = ids[at : at + length]
            expected.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((tuple(r[:5]) for r in rows), key=str) == sorted(expected, key=str)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= length
    assert len(held) >= math.ceil(sum(r.length for r in rows) / length)
    return len(held)


def test_packing_of_documents(spark, library):
    sf_dir = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = queries.QUERIES["op12_packing"](spark, sf_dir).collect()
    assert check(library, docs, rows, 4096) <= math.ceil(sum(r.length for r in rows) / 4096) + 2


def test_packing_in_many_groups(spark, library):
    rng = random.Random(2)
    docs = [(i, " ".join(["cat"] * rng.choice((0, 3, 9, 20, 31, 40, 64, 200)))) for i in range(700)]
    rows = packing.pack(spark.createDataFrame(docs, DOCS), MODEL, 1, length=64, group=60).collect()
    assert check(library, docs, rows, 64) <= 1.02 * math.ceil(sum(r.length for r in rows) / 64)


def test_packing_odd_rows(spark, library):
    docs = [(1, None), (2, ""), (3, "A b."), (3, "A b."), (3, "other"), (None, "x"), (4, "word " * 60_000)]
    df = spark.createDataFrame([(*r, 7, "y") for r in docs], DOCS + ", length int, start string")
    assert check(library, docs, packing.pack(df, MODEL, 1).collect(), 4096) == 15
    assert packing.pack(spark.createDataFrame([], DOCS), MODEL, 1).count() == 0
    pairs = [(i, "dog " * 39) for i in range(90)]  # no two fit together, so no round pays
    rows = packing.pack(spark.createDataFrame(pairs, DOCS), MODEL, 1, length=64, group=20).collect()
    assert check(library, pairs, rows, 64) == 90
