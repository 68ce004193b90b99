"""The manifest against trees built from sorted lists."""

import hashlib
import random
import zlib

import pytest

from chartmeter.llm import manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def grow(nodes):
    """The root, and per leaf its path: (place, others) of every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at):
            run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
            path.append((i % 8, run[: i % 8] + run[i % 8 + 1 :]))
        at = [i // 8 for i in at]
        nodes = [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def expected(table):
    def leaf(doc_id, text, lang, source, n_chars):
        values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
        return sha(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))

    def lower(text):
        return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)

    groups = {}
    for r in table:
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        entry = (r[0] is not None, r[0] or 0, leaf(*r[:5]), leaf(r[0], lower(r[1]), *r[2:5]) if changed else leaf(*r[:5]))
        groups.setdefault(r[2], []).append(entry)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: grow([e[2] for e in sorted(groups[g])]) for g in order}
    root, tops = grow([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, tops):
        for (known, i, own, changed), path in zip(sorted(groups[g]), trees[g][1]):
            node = changed
            for place, others in path + top:
                node = sha(*others[:place], node, *others[place:])
            proof = sha(*(o for _, others in path + top for o in others))
            out.append((i if known else None, own, trees[g][0], root, proof, node, node == root))
    return sorted(out, key=str)


@pytest.fixture
def small(monkeypatch):
    """Arrays of 64 slots, so that few rows make several rounds."""
    monkeypatch.setattr(manifest, "DEPTH", 2)
    monkeypatch.setattr(manifest, "SLOTS", 64)


def documents(n, rng, langs):
    ids = rng.sample([*range(-500, 500), *(rng.randrange(-(2**63), 2**63) for _ in range(200))], n)
    return [(i, rng.choice(("Text A", "b", "", None, "É" * 9)) , rng.choice(langs), rng.choice(("s", None)), rng.choice((1, None))) for i in ids]


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (9, ["en", None]), (700, ["en", "en", "en", "de", None, "é", ""])])
def test_manifest_by_brute_force(spark, small, n, langs):
    table = documents(n, random.Random(n), langs)
    assert rows(manifest.manifest(spark.createDataFrame(table, DOCS))) == expected(table)


def test_many_groups(spark, small):
    table = [(i, f"T{i}", f"l{i % 90}", "s", i) for i in range(300)]
    assert rows(manifest.manifest(spark.createDataFrame(table, DOCS))) == expected(table)


def test_repeated_and_missing_ids(spark, small):
    long = "Long " * 100_000
    table = [(7, "a", "en", "s", 1)] * 90 + [(7, "b", "en", "s", 1), (8, long, "en", "s", 1), (None, "x", "en", None, None)]
    table += [(None, f"y{i}", "en", None, None) for i in range(70)] + [(None, None, None, None, None)] * 3 + [(6, "c", "en", "s", 0)]
    assert rows(manifest.manifest(spark.createDataFrame(table, DOCS))) == expected(table)
    clash = spark.createDataFrame([(*r, "x", 1) for r in table], DOCS + ", leaf string, total int")
    assert rows(manifest.manifest(clash)) == expected(table)


def test_no_rows(spark):
    assert manifest.manifest(spark.createDataFrame([], DOCS)).count() == 0
