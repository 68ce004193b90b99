"""Registered queries on the smallest tables: against their SQL, or against plain Python."""

import hashlib
import math
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from chartmeter.llm import queries
from chartmeter.llm.queries import tokenizer

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "benchmark", "labels", "pages", "embeddings"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def docs(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


def found(spark, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, SF_DIR).collect()}


def test_all_are_registered():
    names = entry_points.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert names["pipeline"] is corpus_pipeline.run


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(queries.ORACLES[name])
    columns = sorted(c[0] for c in cursor.description)
    assert columns == sorted(df.columns)
    order = [[c[0] for c in cursor.description].index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=str)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert got == expected


def test_simhash(spark, docs):
    rows = found(spark, "op1_simhash")
    prints = {i: int(r.fingerprint, 16) for i, r in rows.items()}
    assert all(len(r.fingerprint) == 16 for r in rows.values())
    assert set(rows) == set(docs)
    for i in docs:  # a group is closed: nothing near lies in another one
        for j in docs:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                assert rows[i].component_id == rows[j].component_id <= min(i, j)


def test_pieces(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    rows = found(spark, "op2_pieces")
    for i, text in docs.items():
        ids = library.encode(text)
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    rows, at = found(spark, "op3_token_files"), 0
    for i, text in sorted(docs.items()):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        assert tuple(rows[i]) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


@pytest.mark.parametrize("name, label, least", [("op4_quality_trees", "quality", 0.3), ("op6_toxicity", "toxic", 0.5)])
def test_classifiers(spark, name, label, least):
    """On the next larger tables: the smallest have a dozen toxic documents."""
    sf_dir = SF_DIR.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in queries.QUERIES[name](spark, sf_dir).collect()}
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= least)
    marked = duckdb.sql(f"SELECT doc_id, {label} FROM '{sf_dir}/labels.parquet'").fetchall()
    held = [rows[i].predicted == y for i, y in marked if rows[i].held_out]
    assert len(held) > 50 and np.mean(held) > 0.93


def test_language_scores(spark, docs):
    rows = found(spark, "op7_language_scores")
    words = {i: t.encode().lower().split() for i, t in docs.items()}
    counts, n = {}, 0
    for i, own in words.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            n += 1
            for w in own:
                counts[w] = counts.get(w, 0) + 1
    tokens, kinds = sum(counts.values()) + n, len(counts) + 1
    for i, own in words.items():
        base = sum(math.log10((c + 1) / (tokens + kinds + 1)) for c in [counts.get(w, 0) for w in own] + [n])
        assert rows[i].base_score == pytest.approx(base)
        assert rows[i].train_tokens == tokens and rows[i].n_tokens == len(own) + 1
        assert rows[i].n_known == 1 + sum(w in counts for w in own)
        assert rows[i].score < 0


def test_pages(spark, duck):
    rows = {r.page_id: r for r in queries.QUERIES["op8_html_text"](spark, SF_DIR).collect()}
    pages = duck.execute("SELECT page_id, html FROM pages").fetchall()
    assert len(rows) == len(pages)
    for i, html in pages:
        assert rows[i].n_chars == len(rows[i].text) > 0
        assert "<" not in rows[i].text.replace("<>", "") or "&lt;" in html


def test_pipeline_stage_by_stage(spark, docs, duck, tmp_path):
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = table.columns, table
    for k, (name, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, before, SF_DIR).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        old = {r.doc_id: r for r in before.collect()}
        new = {r.doc_id: r for r in after.collect()}
        assert set(new) <= set(old) and len(new) == after.count()
        if k < 4:
            assert after.columns == columns
        if name == "toxicity":
            toxic = dict(duck.execute("SELECT doc_id, toxic FROM labels").fetchall())
            assert len(old) - len(new) < 0.3 * len(old)
            assert np.mean([i in new for i in old if toxic.get(i) == 0]) > 0.97
        elif name == "simhash":
            from chartmeter.llm.simhash import fingerprint

            prints = {i: fingerprint(r.text.encode()) for i, r in old.items()}
            for i in set(old) - set(new):
                assert any(j < i and (prints[i] ^ prints[j]).bit_count() <= 4 for j in old)
            for i in new:
                assert not any(j < i and (prints[i] ^ prints[j]).bit_count() <= 4 for j in new)
        elif name == "decontamination":
            items = [t.lower().split() for (t,) in duck.execute("SELECT text FROM benchmark").fetchall()]
            for i, r in old.items():
                words = r.text.lower().split()
                held = {tuple(words[a : a + 5]) for a in range(len(words) - 4)}
                shares = [np.mean([s in held for s in {tuple(w[a : a + 5]) for a in range(len(w) - 4)}]) for w in items]
                assert (i in new) == (max(shares) < 0.8)
        elif name == "secrets":
            assert set(new) == set(old)
            changed = [i for i in old if old[i].text != new[i].text]
            for i in changed:
                assert "[SECRET]" in new[i].text and new[i].n_chars == len(new[i].text)
            assert 0 < len(changed) < 0.2 * len(old)
        elif name == "pieces":
            assert set(new) == set(old) and "ids" in after.columns
            assert all(new[i].text == old[i].text for i in old)
        before = after
    ran = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(r.doc_id for r in ran.collect()) == sorted(new)
