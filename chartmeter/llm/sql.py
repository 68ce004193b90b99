"""DuckDB SQL that the queries of this package must equal."""

from __future__ import annotations

import math

from chartmeter.llm import quality_rules, secret_scan, vector_codes

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quality_rules() -> str:
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << bit} ELSE 0 END" for bit, rule in quality_rules.RULES.values())
    return rf"""
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
worded AS (
  SELECT r, doc_id, text, {_WORDS} AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM numbered),
windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM worded, unnest(range(1, len(w) - 1)) AS t(i) WHERE len(w) > 2),
repeated AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM repeated, unnest([0, 1, 2]) AS t(k) WHERE n > 1 GROUP BY r),
measured AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
    len(list_distinct(w)) AS n_distinct_words
  FROM worded LEFT JOIN covered USING (r)),
marked AS (SELECT *, CAST({bits} AS BIGINT) AS failures FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failures & {quality_rules.policy_mask("base")}) <> 0 AS base_failed,
  (failures & {quality_rules.policy_mask("base")}) = 0
    AND (failures & {quality_rules.policy_mask("v1")}) = 0 AS kept, failures
FROM marked"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _secret_scan() -> str:
    """Spans from the lengths of matches and of what lies between them; the entropy of every
    window counted on its own."""
    patterns = (secret_scan.ASSIGN, secret_scan.ACCESS, secret_scan.HEX, secret_scan.CANDIDATE)
    kinds = " UNION ALL ".join(
        f"""SELECT r, {k} AS no, '{kind}' AS kind, regexp_extract_all(t, {_quoted(p)}, 0) AS hits,
            string_split_regex(t, {_quoted(p)}) AS parts FROM docs"""
        for k, (kind, p) in enumerate(zip(secret_scan.KINDS, patterns))
    )
    *allowed, _ = secret_scan.ALLOWED  # the last one, a repeated character, has a back reference
    suppressed = " OR ".join(f"regexp_matches(h, {_quoted(p)})" for p in allowed) + " OR replace(h, h[1], '') = ''"
    least = " ".join(
        f"WHEN regexp_matches(h, {_quoted(p)}) THEN {'NULL' if bits == math.inf else bits}"
        for _, p, bits in secret_scan.CLASSES
    )
    w = secret_scan.WINDOW
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
met AS ({kinds}),
each AS (
  SELECT r, no, kind, hits[i] AS h, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x)))
    + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM met, unnest(range(1, len(hits) + 1)) AS u(i)),
found AS (SELECT *, s + length(h) AS e FROM each),
base AS (
  SELECT * FROM found
  WHERE no IN (1, 2) OR (no = 0 AND length(regexp_extract(h, {_quoted(secret_scan.ASSIGN)}, 2)) >= {secret_scan.ASSIGN_VALUE})),
candidates AS (
  SELECT *, CASE WHEN {suppressed} THEN NULL ELSE CASE {least} END END AS least,
    list_max(list_transform(range(1, length(h) - {w} + 2), lambda i: list_aggregate(string_split(h[i:i + {w - 1}], ''), 'entropy'))) AS bits
  FROM found WHERE no = 3),
added AS (
  SELECT r, no, kind, h, s, e FROM candidates c WHERE bits >= least
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = c.r AND b.s < c.e AND c.s < b.e)),
texts AS (
  SELECT r, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) AS b FROM base GROUP BY r),
alls AS (
  SELECT r, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) AS a
  FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM docs LEFT JOIN texts USING (r) LEFT JOIN alls USING (r)"""


# Every shingle of every item in every document, by an equi-join: no sketches.
_DECONTAMINATION = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') AS w FROM documents),
items AS (
  SELECT row_number() OVER () AS q, item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') AS w FROM benchmark),
wanted AS (
  SELECT DISTINCT q, item_id, least(5, len(w)) AS k, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s
  FROM items, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT q, count(*) AS n FROM wanted GROUP BY q),
held AS (
  SELECT DISTINCT r, doc_id, k, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM docs, (SELECT DISTINCT k FROM wanted) AS ks, unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k)
SELECT doc_id, item_id, CAST(any_value(n) AS BIGINT) AS n_shingles, CAST(count(*) AS BIGINT) AS n_found
FROM held JOIN wanted USING (k, s) JOIN sizes USING (q)
GROUP BY r, doc_id, q, item_id HAVING 5 * count(*) >= 4 * any_value(n)"""


def _vector_codes() -> str:
    """Every component of every part against every entry, in plain squared distances."""
    n = vector_codes.PARTS

    def assigned(k: int) -> str:
        return f"""
near{k} AS (
  SELECT r, part, entry, d FROM (
    SELECT r, part, entry, sum((x.v - e.v) * (x.v - e.v)) AS d
    FROM cut AS x JOIN book{k} AS e USING (part, pos) GROUP BY r, part, entry)
  QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY d, entry) = 1)"""

    rounds = "".join(
        f"""{assigned(k)},
mean{k} AS (
  SELECT part, entry, pos, sum(v) AS s, count(*) AS c FROM cut JOIN near{k} USING (r, part) GROUP BY part, entry, pos),
book{k + 1} AS (
  SELECT part, entry, pos, CAST(coalesce((s - ((s % c) + c) % c) // c, v) AS BIGINT) AS v
  FROM book{k} LEFT JOIN mean{k} USING (part, entry, pos)),"""
        for k in range(vector_codes.ROUNDS)
    )
    last = vector_codes.ROUNDS
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {vector_codes.SCALE}) AS BIGINT))) - 1 AS r,
    vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {vector_codes.SCALE}) AS BIGINT)) AS f
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (
  SELECT r, i // (len(f) // {n}) AS part, i % (len(f) // {n}) AS pos, f[i + 1] AS v
  FROM kept, unnest(range(0, len(f))) AS t(i)),
book0 AS (SELECT part, r AS entry, pos, v FROM cut WHERE r < {vector_codes.ENTRIES}),{rounds}{assigned(last)},
coded AS (
  SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near{last} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(v, ',' ORDER BY part, entry, pos)) FROM book{last}) AS codebooks_sha256
FROM kept JOIN coded USING (r)"""


def _manifest() -> str:
    """Level by level from a sorted list of leaves; ``HEIGHT`` levels are enough for 8^HEIGHT."""

    def field(value: str) -> str:
        return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    def tree(name: str, first: str) -> str:
        """Levels ``name0 .. nameH`` of nodes (t, i, h, c), and ``name_s0 ..``: the others of each run."""
        parts = [f"{name}0 AS ({first})"]
        for k in range(_HEIGHT):
            parts.append(f"""{name}_s{k} AS (
  SELECT t, i, CASE WHEN c = 1 THEN '' ELSE coalesce(string_agg(h, '') OVER (PARTITION BY t, i // 8 ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW), '') END AS s FROM {name}{k})""")
            parts.append(f"""{name}{k + 1} AS (
  SELECT t, i // 8 AS i, CASE WHEN any_value(c) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h,
    (any_value(c) + 7) // 8 AS c FROM {name}{k} GROUP BY t, i // 8)""")
        return ",\n".join(parts)

    def sides(name: str, t: str, i: str) -> str:
        joins = [f"JOIN {name}_s{k} AS {name}j{k} ON {name}j{k}.t = {t} AND {name}j{k}.i = {i} // {8**k}" for k in range(_HEIGHT)]
        joins += [f"JOIN {name}{k} AS {name}n{k} ON {name}n{k}.t = {t} AND {name}n{k}.i = {i} // {8**k}" for k in range(_HEIGHT)]
        return " ".join(joins)

    def steps(name: str, i: str, start: str) -> str:
        """The digest that follows from ``start`` and the others, one level after another."""
        out = start
        for k in range(_HEIGHT):
            at = f"64 * (({i} // {8**k}) % 8)"
            s = f"{name}j{k}.s"
            out = f"CASE WHEN {name}n{k}.c = 1 THEN {out} ELSE sha256({s}[1:{at}] || ({out}) || {s}[{at} + 1:]) END"
        return out

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # crc32 of the decimal digits: a step per digit and eight shifts after it.
    crc = """xor(list_reduce(range(0, 9 * length(CAST(doc_id AS VARCHAR))), lambda a, j:
      CASE WHEN j % 9 = 0 THEN xor(a, CAST(ascii(CAST(doc_id AS VARCHAR)[j // 9 + 1]) AS BIGINT))
      ELSE xor(a >> 1, 3988292384 * (a & 1)) END, 4294967295), 4294967295)"""
    return f"""
WITH docs AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '+' || lang END AS t, {leaf("text")} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS changed
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY t) AS c FROM docs),
{tree("a", "SELECT t, i, leaf AS h, c FROM placed")},
{tree("b", f"SELECT '' AS t, row_number() OVER (ORDER BY t) - 1 AS i, h, count(*) OVER () AS c FROM a{_HEIGHT}")},
subs AS (SELECT t, h, row_number() OVER (ORDER BY t) - 1 AS b FROM a{_HEIGHT}),
halfway AS (
  SELECT p.doc_id, p.leaf, subs.h AS subroot, b, {" || ".join(f"aj{k}.s" for k in range(_HEIGHT))} AS sides,
    {steps("a", "p.i", "p.changed")} AS up
  FROM placed AS p JOIN subs USING (t) {sides("a", "p.t", "p.i")}),
done AS (
  SELECT doc_id, leaf, subroot, (SELECT h FROM b{_HEIGHT}) AS root,
    sha256(sides || {" || ".join(f"bj{k}.s" for k in range(_HEIGHT))}) AS proof_sha256, {steps("b", "b", "up")} AS folded_root
  FROM halfway {sides("b", "''", "b")})
SELECT *, folded_root = root AS verified FROM done"""


#: Levels of a tree in the SQL: enough for 262,144 leaves a language.
_HEIGHT = 6


ORACLES = {
    "op5_secret_scan": _secret_scan(),
    "op9_decontamination": _DECONTAMINATION,
    "op10_quality_rules": _quality_rules(),
    "op11_vector_codes": _vector_codes(),
    "op13_manifest": _manifest(),
}
