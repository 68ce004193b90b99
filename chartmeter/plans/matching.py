"""Golden points against predicted points, for many cases at once.

Inputs are tagged points (see ``functions.values``). A case may hold any part of
all points: nothing here gathers a case, and no step pairs up a group's points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmeter.functions.values import forms_match, let, round_cents, values_match
from chartmeter.plans.figures import last_values
from chartmeter.shared import broadcast_if_small, is_small, stage

#: Longest block that predicted strings are cut into; a power of two. Any stretch of twice
#: its length less one that two strings share shows in a block of the predicted one.
PIECE = 32
#: Predicted strings up to this length are cut at every character.
DENSE = 128
#: Windows of a golden string that are compared for the rarest, at most.
WINDOWS = 4
#: Golden strings are tried on all predicted points in question up to this number.
FEW = 64
#: Predicted points that a window names for one golden one, up to which these go by pairs; and
#: pairs of all the others, per point, up to which they do, too.
HITS, PAIRS = 16, 4
#: Characters that a long string's digest goes with, and places in a predicted string that a
#: golden one is looked for at by its digest.
HEAD, SLACK = 16, 1024
#: Strings of either side that are tried on one another in one place; more are spread.
CROWD = 2048

_GROUP = ["case_id", "pair"]
_CUT = [*_GROUP, "texts", "side", "dense"]
_PAIR = [*_GROUP, "texts", "gid", "k", "v", "their_pid", "their_k", "their_v"]


def _is_nan(value: Column) -> Column:
    return F.coalesce(F.isnan(value["num"]), F.lit(False))


def _is_text(value: Column) -> Column:
    return value["kind"] == "str"


def pairs_match(golden: DataFrame, predicted: DataFrame) -> DataFrame:
    """Whether every golden (k, v) of a case and pair has a predicted (k, v) that
    matches in both; further predicted points do not matter.

    Inputs: case_id, pair, pos, k, v. Output, per case and pair met on either
    side: n_golden, bad_keys (a key is an array or object), matched.

    Both inputs are read again for the texts that a test needs; before that a long text is
    its length and its digest.
    """
    points = stage(_compared(golden, predicted), "points")
    left = F.col("in_golden") & ~F.col("in_predicted")
    texts = _is_text(F.col("k")) | _is_text(F.col("v"))
    counts = stage(
        points.groupBy(*_GROUP).agg(
            F.count_if("in_golden").alias("n_golden"),
            F.bool_or(F.col("k.kind") == "other").alias("bad_keys"),
            F.count_if(left).alias("n_left"),
            F.bool_or(left & ~texts).alias("hopeless"),
        ),
        "counts",
    )
    # only strings can match without being equal, and only in cases not lost already
    undecided = counts.where("n_left > 0 and not hopeless and not bad_keys").select(*_GROUP)
    if undecided.isEmpty():
        n_found = F.lit(0)
        decided = counts
    else:
        found = _contained(points, undecided, golden, predicted).groupBy(*_GROUP).agg(F.count("*").alias("n_found"))
        decided = counts.join(found, _GROUP, "left")
        n_found = F.coalesce("n_found", F.lit(0))
    matched = (F.col("n_left") == n_found) & ~F.col("bad_keys")
    return decided.select(*_GROUP, "n_golden", "bad_keys", matched.alias("matched"))


def pairs_match_swapped(golden: DataFrame, predicted: DataFrame) -> DataFrame:
    """``pairs_match`` with the predicted keys and values exchanged."""
    swapped = predicted.select("case_id", "pair", "pos", F.col("v").alias("k"), F.col("k").alias("v"))
    return pairs_match(golden, swapped)


def _all(conditions: list[Column], start: Column) -> Column:
    for condition in conditions:
        start = start & condition
    return start


def points_in_row(*arrays: Column) -> Column:
    """Points of short arrays that lie side by side in a row, as ``tagged_elements`` gives them:
    structs of k and v (k1, k2, v of three arrays) in the form values are compared in. Of a
    repeated key the last stays, keys being compared as they are written. NULL unless all
    arrays are there."""
    names = ["k", "v"] if len(arrays) == 2 else ["k1", "k2", "v"]
    keys = names[:-1]

    def kept(points: Column) -> Column:
        def last(point: Column, i: Column) -> Column:
            later = F.slice(points, i + 2, F.size(points))
            return ~F.exists(
                later, lambda x: _all([x[key]["tag"].eqNullSafe(point[key]["tag"]) for key in keys], F.lit(True))
            )

        # equal keys have equal hashes, so only points with a repeated hash need to be looked at
        hashes = F.transform(points, lambda x: F.xxhash64(*[x[key]["tag"] for key in keys]))
        alone = F.size(F.array_distinct(hashes)) == F.size(points)
        return F.when(alone, points).otherwise(F.filter(points, last))

    n = F.least(*[F.size(array) for array in arrays])
    rows = F.transform(
        F.slice(arrays[0], 1, n),
        lambda first, i: F.struct(
            first.alias(names[0]), *[F.get(array, i).alias(name) for array, name in zip(arrays[1:], names[1:])]
        ),
    )
    forms = F.transform(
        let(rows, kept),
        # keys of triples are compared as they are written
        lambda x: F.struct(*[x[name]["form" if name in ("k", "v") else "tag"].alias(name) for name in names]),
    )
    return F.when(_all([array.isNotNull() for array in arrays], F.lit(True)), forms)


def flat_points(k: Column, v: Column) -> Column:
    """``points_in_row`` of two plain arrays (``flat_elements``) of which the keys differ."""
    none_num, none_str = F.lit(None).cast("double"), F.lit(None).cast("string")

    def form(array: Column, i: Column) -> Column:
        def value(kind: str, num: Column, text: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), num.alias("num"), text.alias("str"))

        text = value("str", none_num, F.get(array["s"], i))
        return F.when(array["s"].isNotNull(), text).otherwise(value("num", F.get(array["n"], i), none_str))

    size = F.least(_flat_size(k), _flat_size(v))
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    points = F.transform(places, lambda i: F.struct(form(k, i).alias("k"), form(v, i).alias("v")))
    return F.when(k.isNotNull() & v.isNotNull(), points)


def _flat_size(array: Column) -> Column:
    return F.when(array["s"].isNotNull(), F.size(array["s"])).otherwise(F.size(array["n"]))


def flat_match_in_row(gk: Column, gv: Column, pk: Column, pv: Column) -> Column:
    """``pairs_match_in_row`` of plain arrays, keys and values of either side, without points."""

    def met(g: Column, i: Column, p: Column, j: Column) -> Column:
        inside = F.contains(F.get(p["s"], j), F.get(g["s"], i))
        return F.coalesce(F.when(g["s"].isNotNull(), inside).otherwise(F.get(g["n"], i) == F.get(p["n"], j)), F.lit(False))

    def tried(n: Column) -> Column:
        def found(i: Column) -> Column:
            return F.exists(F.sequence(F.lit(0), n["p"] - 1), lambda j: met(gk, i, pk, j) & met(gv, i, pv, j))

        return F.when(F.forall(F.sequence(F.lit(0), n["g"] - 1), found), "T").otherwise("F")

    n_golden, n_predicted = F.least(_flat_size(gk), _flat_size(gv)), F.least(_flat_size(pk), _flat_size(pv))
    # most are settled as wholes: equal arrays match, texts and numbers never do
    same = gk.eqNullSafe(pk) & gv.eqNullSafe(pv)
    alike = (gk["s"].isNull() == pk["s"].isNull()) & (gv["s"].isNull() == pv["s"].isNull())
    return (
        F.when((n_golden == 0) | same, "T")
        .when((n_predicted == 0) | ~alike, "F")
        .otherwise(let(F.struct(n_golden.alias("g"), n_predicted.alias("p")), tried))
    )


def _bad_keys(points: Column, *keys: str) -> Column:
    def bad(x: Column) -> Column:
        found = F.lit(False)
        for key in keys:
            found = found | (x[key]["kind"] == "other")
        return found

    return F.exists(points, bad)


def pairs_match_in_row(golden: Column, predicted: Column) -> Column:
    """Outcome ``T``, ``F`` or ``E`` (a list as a key) of ``pairs_match`` for the
    ``points_in_row`` of both sides. Tries all predicted points on each golden one."""

    def met(g: Column) -> Column:
        return F.exists(predicted, lambda x: forms_match(g["k"], x["k"]) & forms_match(g["v"], x["v"]))

    bad = _bad_keys(golden, "k") | _bad_keys(predicted, "k")
    return F.when(bad, "E").when(F.forall(golden, met), "T").otherwise("F")


def triples_match_in_row(golden: Column, predicted: Column) -> Column:
    """The same for ``triples_match``."""

    def same(g: Column, x: Column) -> Column:
        return g["k1"].eqNullSafe(x["k1"]) & g["k2"].eqNullSafe(x["k2"]) & forms_match(g["v"], x["v"])

    bad = _bad_keys(golden, "k1", "k2") | _bad_keys(predicted, "k1", "k2")
    # keys are unique on either side, so equal numbers of them are the same ones
    met = F.forall(golden, lambda g: F.exists(predicted, lambda x: same(g, x)))
    return F.when(bad, "E").when((F.size(golden) == F.size(predicted)) & met, "T").otherwise("F")


def _written(points: DataFrame) -> DataFrame:
    """Points in the form they are compared in, long strings as length, beginning and digest,
    with the whole strings in ``k_text`` and ``v_text``; ``raw`` is the key as it is written."""

    def form(name: str) -> Column:
        value, text = F.col(name), F.col(f"{name}_text")
        length = F.length(text)
        long = length > DENSE
        return F.struct(
            value["kind"].alias("kind"),
            F.when(value["kind"] == "num", round_cents(value["num"])).alias("num"),
            F.when(~long, text).alias("str"),
            F.when(long, length).alias("size"),
            F.when(long, F.substring(text, 1, HEAD)).alias("head"),
            F.when(long, F.unhex(F.sha2(text, 256))).alias("sha"),
        )

    def lowered(name: str) -> Column:
        value = F.col(name)
        return F.when(value["kind"] == "str", F.lower(value["str"])).otherwise(value["str"]).alias(f"{name}_text")

    key = F.col("k.str")
    long_key = F.length(key) > DENSE
    raw = F.struct(
        "k.kind", "k.num", F.when(~long_key, key).alias("str"), F.when(long_key, F.unhex(F.sha2(key, 256))).alias("sha")
    )
    texts = points.select(*_GROUP, "pos", "k", "v", lowered("k"), lowered("v"))
    return texts.select(*_GROUP, "pos", raw.alias("raw"), form("k").alias("k"), form("v").alias("v"), "k_text", "v_text")


def _compared(golden: DataFrame, predicted: DataFrame) -> DataFrame:
    """Distinct points in the form they are compared in, with the sides they are on.

    Points of one form match the same points, so equal ones meet in one row.
    """

    def side(points: DataFrame, is_golden: bool) -> DataFrame:
        last = last_values(_written(points), [*_GROUP, "raw", "k"])
        return last.select(
            *_GROUP,
            "k",
            F.struct(*[f"v.{name}" for name in ("kind", "num", "str", "size", "head", "sha")]).alias("v"),
            F.lit(is_golden).alias("in_golden"),
            F.lit(not is_golden).alias("in_predicted"),
        )

    # NaN equals nothing, so a predicted one can serve no golden point
    usable = side(predicted, False).where(~_is_nan(F.col("k")) & ~_is_nan(F.col("v")))
    return (
        side(golden, True)
        .unionByName(usable)
        .groupBy(*_GROUP, "k", "v")
        .agg(
            F.bool_or("in_golden").alias("in_golden"),
            F.bool_or("in_predicted").alias("in_predicted"),
        )
    )


def _grouped(points: DataFrame, name: str) -> DataFrame:
    """Add what a point's possible matches have in common with it: ``texts``, the sides
    that are strings, and ``fixed``, the other side if there is one; and an id ``name``."""
    k, v = F.col("k"), F.col("v")
    nothing = F.struct(
        F.lit("").alias("kind"),
        F.lit(None).cast("double").alias("num"),
        F.lit(None).cast("string").alias("str"),
        F.lit(None).cast("int").alias("size"),
        F.lit(None).cast("string").alias("head"),
        F.lit(None).cast("binary").alias("sha"),
    )
    both = _is_text(k) & _is_text(v)
    texts = F.when(both, "kv").when(_is_text(k), "k").when(_is_text(v), "v")
    fixed = F.when(both, nothing).when(_is_text(k), v).otherwise(k)
    whole = [c for c in ("k_text", "v_text") if c in points.columns]
    grouped = points.where(_is_text(k) | _is_text(v)).select(
        *_GROUP, texts.alias("texts"), fixed.alias("fixed"), "k", "v", *whole
    )
    return grouped.withColumn(name, F.xxhash64(*_GROUP, "texts", "fixed", "k", "v"))


def _source(points: DataFrame, groups: DataFrame, name: str) -> DataFrame:
    """The points of some groups as they are given, with their whole strings."""
    return _grouped(_written(points.join(broadcast_if_small(groups), _GROUP, "left_semi")), name)


def _by_text(grouped: DataFrame) -> DataFrame:
    """One row per string side of a point: ``side`` and ``text``, and whether it is ``short``.
    Where there are no whole strings, only sides that are."""

    def one(side: str) -> Column:
        text = f"{side}_text" if f"{side}_text" in grouped.columns else f"{side}.str"
        short = F.col(f"{side}.size").isNull()
        return F.when(
            F.contains("texts", F.lit(side)) & F.col(text).isNotNull(),
            F.struct(F.lit(side).alias("side"), F.col(text).alias("text"), short.alias("short")),
        )

    kept = [c for c in grouped.columns if c not in ("k_text", "v_text")]
    return grouped.select(*kept, F.explode(F.array_compact(F.array(one("k"), one("v")))).alias("s")).select(
        *kept, "s.side", "s.text", "s.short"
    )


def _sides(met) -> Column:
    """Whether ``met(golden, predicted, side)`` holds for all sides that are strings; other
    sides are equal by ``fixed`` already."""
    return _all(
        [~F.contains("texts", F.lit(s)) | met(F.col(s), F.col(f"their_{s}"), s) for s in ("k", "v")], F.lit(True)
    )


def _possible() -> Column:
    """Whether golden k, v lie in predicted their_k, their_v, as far as short strings and
    lengths tell."""

    def met(golden: Column, predicted: Column, side: str) -> Column:
        short = golden["size"].isNull()
        return (
            F.when(predicted["size"].isNull(), short & F.contains(predicted["str"], golden["str"]))
            .when(short, F.lit(True))
            .otherwise(golden["size"] <= predicted["size"])
        )

    return _sides(met)


def _is_long(prefix: str = "") -> Column:
    """Whether a point has a string that is not in its row."""
    long = [F.contains("texts", F.lit(s)) & F.col(f"{prefix}{s}.size").isNotNull() for s in ("k", "v")]
    return long[0] | long[1]


def _contained(points: DataFrame, undecided: DataFrame, golden: DataFrame, predicted: DataFrame) -> DataFrame:
    """Unmatched golden points that some predicted point contains.

    Where few predicted points come into question, all are tried. Elsewhere
    containment becomes equality, see ``_looked_up``.
    """
    some = points.join(broadcast_if_small(undecided), _GROUP, "left_semi")
    offered = _grouped(some.where("in_predicted"), "pid")
    keys = [*_GROUP, "texts", "fixed"]
    sizes = offered.groupBy(*keys).agg(F.count("*").alias("n_offered"))
    # inner: without any predicted point of its group there is no match
    asked = _grouped(some.where("in_golden and not in_predicted"), "gid").join(sizes, keys)
    asked = stage(asked, "asked")

    few = asked.where(F.col("n_offered") <= FEW).drop("n_offered")
    short = few.join(_theirs(offered.where(~_is_long())), _same_group() & _possible(), "left_semi")
    matched = short.select(*_GROUP, "k", "v")
    pairs = few.join(_theirs(offered.where(_is_long())), _same_group() & _possible()).select(*_PAIR)
    many = asked.where(F.col("n_offered") > FEW).drop("n_offered")
    if not many.isEmpty():
        named, met = _looked_up(many, offered, undecided, golden, predicted)
        pairs, matched = pairs.unionByName(named), matched.unionByName(met)
    return matched.unionByName(_tried(pairs, undecided, golden, predicted)).distinct()


def _tried(pairs: DataFrame, undecided: DataFrame, golden: DataFrame, predicted: DataFrame) -> DataFrame:
    """Golden points of the pairs that hold.

    Only the predicted strings come to the pairs, once. A golden one that is hardly shorter is
    its digest there: few places of the predicted one can hold it. Others come whole.
    """
    pairs = stage(pairs, "pairs")
    matched = pairs.where(~_is_long("their_"))
    pairs = pairs.where(_is_long("their_"))
    if not pairs.isEmpty():
        near = _sides(lambda g, p, s: F.coalesce(p["size"] - g["size"] <= SLACK, F.lit(True)))
        theirs = _theirs(_fetched(predicted, undecided, pairs.select(F.col("their_pid").alias("pid")), "pid"))
        # names of their own, as both sides have the column
        theirs, same = theirs.withColumnRenamed("their_pid", "of"), F.col("their_pid") == F.col("of")

        def by_digest(g: Column, p: Column, side: str) -> Column:
            text = F.col(f"their_{side}_text")

            def at(place: Column) -> Column:
                begins = F.substring(text, place, F.length(g["head"])) == g["head"]
                return begins & (F.unhex(F.sha2(F.substring(text, place, g["size"]), 256)) == g["sha"])

            found = F.exists(F.sequence(F.lit(1), p["size"] - g["size"] + 1), at)
            return p["size"].isNull() | F.when(g["size"].isNull(), F.contains(text, g["str"])).otherwise(found)

        def by_text(g: Column, p: Column, side: str) -> Column:
            return p["size"].isNull() | F.contains(f"their_{side}_text", F.coalesce(f"{side}_text", g["str"]))

        matched = matched.unionByName(pairs.where(near).join(theirs, same & _sides(by_digest), "left_semi"))
        far = pairs.where(~near)
        if not far.isEmpty():
            far = far.join(_fetched(golden, undecided, far, "gid").dropDuplicates(["gid"]), "gid", "left")
            matched = matched.unionByName(far.join(theirs, same & _sides(by_text), "left_semi").select(*_PAIR))
    return matched.select(*_GROUP, "k", "v")


def _fetched(points: DataFrame, undecided: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """The long strings of points with an id in ``wanted``, if these are few; of all otherwise."""
    long = _source(points, undecided, name).where(_is_long())
    texts = [F.when(F.col(f"{s}.size").isNotNull(), F.col(f"{s}_text")).alias(f"{s}_text") for s in ("k", "v")]
    ids = wanted.select(name).distinct()
    if is_small(ids):
        long = long.join(F.broadcast(ids), name, "left_semi")
    return long.select(name, *texts)


def _looked_up(
    golden: DataFrame, predicted: DataFrame, undecided: DataFrame, golden_points: DataFrame, predicted_points: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Pairs of golden points and predicted ones that may hold them, and golden points found.

    Long predicted strings are cut into blocks of q characters, one after another. Wherever a
    golden string lies in one, any window of 2q - 1 of its characters holds a whole block, at
    one of q shifts. So a predicted string gives one hash per q characters, for the sizes q
    that its case asks for, and a golden one the hashes of all shifts in a few windows. Short
    strings are ``dense``: they give blocks from every character on, and a golden string asks
    for single blocks, which tell strings of one template apart.

    Short sides are asked first; a long side only for golden points of which these name many
    predicted ones, or none can be asked. A window without a hit settles the point; otherwise
    the window with the fewest hits names the predicted points to try. A few make pairs;
    many meet in cells. Only hashes and ids of points move before that.
    """
    golden = golden.withColumn("short", _short_sides())
    predicted = stage(predicted, "offered")
    # the sides that are short: at most none, k, v or both
    kinds = [r[0] for r in predicted.select(_short_sides().alias("kind")).distinct().collect()]

    inline = _by_text(golden.drop("short")).where("short").where(F.col("side").isin(*"".join(kinds)))
    asked = stage(_asked_pieces(inline, F.array(F.lit(True))), "asked-pieces")
    offered = _by_text(predicted).withColumn("dense", F.lit(True))
    hits, weighed = _weighed(asked, offered)

    fits = [F.when(_all([F.contains("short", F.lit(s)) for s in kind], F.lit(True)), kind) for kind in kinds]
    wanted = golden.select("gid", "texts", F.explode(F.array_compact(F.array(*fits))).alias("kind"))
    least = _least(weighed, kinds)
    crowded = wanted.join(least, ["gid", "kind"], "left").where(F.coalesce(F.col("least.n") > HITS, F.lit(True)))
    long = [F.when(F.contains("texts", F.lit(s)) & ~F.contains("kind", F.lit(s)), s) for s in ("k", "v")]
    pending = crowded.select("gid", F.explode(F.array_compact(F.array(*long))).alias("side"))
    pending = stage(pending.distinct(), "pending")
    if not pending.isEmpty():
        windows = _windows(_by_text(_source(golden_points, undecided, "gid")), F.array(F.lit(False)))
        # inner, so that windows are cut before anything moves
        asked = stage(_shifts(windows.join(broadcast_if_small(pending), ["gid", "side"])), "asked-pieces")
        long = _by_text(_source(predicted_points, undecided, "pid")).where("not short").withColumn("dense", F.lit(False))
        more, also = _weighed(asked, long)
        hits, weighed = hits.unionByName(more), weighed.unionByName(also)
        least = _least(weighed, kinds)
    chosen = least.where("least.n > 0").select("gid", "least.n", F.explode("least.hashes").alias("h"))
    chosen = stage(chosen, "rarest")
    n_pairs = chosen.where(F.col("n") > HITS).select("gid", "n").distinct().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    by_pairs = F.col("n") <= HITS
    if n_pairs <= PAIRS * predicted.count():
        by_pairs = F.lit(True)
    named = chosen.where(by_pairs).join(hits, "h").select("gid", "pid").distinct()
    named = named.join(golden.drop("short"), "gid").join(_theirs(predicted), F.col("pid") == F.col("their_pid"))
    pairs = named.where(_same_group() & _possible()).select(*_PAIR)

    crowd = chosen.where(~by_pairs).select("gid", "h").distinct()
    if crowd.isEmpty():
        return pairs, golden.select(*_GROUP, "k", "v").limit(0)
    counted = hits.groupBy("h").agg(F.count("*").alias("n"))
    asking = golden.drop("short").join(crowd.select("gid").distinct(), "gid", "left_semi")
    asking = _with_texts(asking, "gid", _fetched(golden_points, undecided, asking, "gid"))
    named = hits.join(crowd.select("h").distinct(), "h", "left_semi").select("pid")
    whole = _with_texts(predicted, "pid", _fetched(predicted_points, undecided, named, "pid"))
    met = _met_in_cells(asking, whole, crowd, hits.join(counted, "h"))
    return pairs, met.select(*_GROUP, "k", "v").distinct()


def _short_sides() -> Column:
    """Names of the sides that are short strings."""
    short = [F.when(F.contains("texts", F.lit(s)) & F.col(f"{s}.size").isNull(), s).otherwise("") for s in ("k", "v")]
    return F.concat(*short)


def _weighed(asked: DataFrame, offered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The offered blocks that are asked for, and of each window its hashes among them and how
    many points have one."""
    small = F.col("size") < 8  # short golden strings have many hits, but are few themselves
    hits = [
        _offered_pieces(offered, part).join(broadcast_if_small(part.select("h").distinct()), "h", "left_semi")
        for part in (asked.where(small), asked.where(~small))
    ]
    # rows that are given twice, or whose key comes again, are one point
    hits = stage(hits[0].unionByName(hits[1]).distinct(), "hits")
    counted = hits.groupBy("h").agg(F.count("*").alias("n"))
    # at most PIECE shifts of a window, and 2 * WINDOWS windows of a point
    found = F.array_distinct(F.collect_list(F.when(F.col("n").isNotNull(), F.col("h"))))
    asked = asked.select("h", "gid", "dense", "side", "window")
    windows = asked.join(counted, "h", "left").groupBy("gid", "dense", "side", "window")
    weighed = windows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), found.alias("hashes"))
    return hits, stage(weighed, "weighed")


def _least(weighed: DataFrame, kinds: list[str]) -> DataFrame:
    """The window with the fewest hits among predicted points of each kind: any window of a side
    finds all of them whose side is cut as the window asks for."""
    by = [F.when(F.contains(F.lit(c), F.col("side")) == F.col("dense"), c) for c in kinds]
    of_kind = weighed.select("*", F.explode(F.array_compact(F.array(*by))).alias("kind"))
    return of_kind.groupBy("gid", "kind").agg(F.min(F.struct("n", "hashes")).alias("least"))


def _with_texts(points: DataFrame, name: str, texts: DataFrame) -> DataFrame:
    """Points with their whole strings, the long ones out of ``texts``."""
    sides = [F.coalesce(f"{s}_text", f"{s}.str").alias(f"{s}_text") for s in ("k", "v")]
    whole = points.where(~_is_long()).select("*", *[F.col(f"{s}.str").alias(f"{s}_text") for s in ("k", "v")])
    long = points.where(_is_long()).join(texts.dropDuplicates([name]), name).select(*points.columns, *sides)
    return whole.unionByName(long)


def _met_in_cells(golden: DataFrame, predicted: DataFrame, chosen: DataFrame, hits: DataFrame) -> DataFrame:
    """Golden points that some predicted one with a hash in common contains.

    The strings of either side that share a hash are dealt into parts of at most about CROWD
    each, and every golden part meets every predicted part in a cell of its own, so that no
    task tries more than one cell's strings on one another however common the hash is.
    """

    def parts(n: Column) -> Column:
        return F.ceil(n / F.lit(CROWD)).cast("int")

    def all_of(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    asking = chosen.groupBy("h").agg(F.count("*").alias("n_golden"))
    cells = hits.join(asking, "h").select("h", "pid", parts(F.col("n")).alias("rows"), parts(F.col("n_golden")).alias("columns"))
    cells = stage(cells, "cells")
    offers = cells.select("h", "pid", F.pmod("pid", "rows").cast("int").alias("row"), all_of("columns").alias("column"))
    offers = offers.withColumnsRenamed({c: f"their_{c}" for c in ("h", "row", "column", "pid")})
    offers = offers.join(_theirs(predicted), "their_pid")
    named = cells.groupBy("h").agg(F.max("rows").alias("rows"), F.max("columns").alias("columns"))
    asks = chosen.join(named, "h").withColumn("column", F.pmod("gid", "columns").cast("int"))
    asks = asks.select("gid", "h", "column", all_of("rows").alias("row")).join(golden, "gid")
    at = F.lit(True)
    for c in ("h", "row", "column"):
        at = at & (F.col(c) == F.col(f"their_{c}"))
    accepted = _sides(lambda g, p, side: F.contains(f"their_{side}_text", F.col(f"{side}_text")))
    return asks.join(offers, at & _same_group() & accepted, "left_semi")


def _theirs(offered: DataFrame) -> DataFrame:
    """Predicted points, all columns named ``their_``."""
    return offered.select(*[F.col(c).alias(f"their_{c}") for c in offered.columns])


def _same_group() -> Column:
    same = F.lit(True)
    for key in (*_GROUP, "texts", "fixed"):
        same = same & (F.col(key) == F.col(f"their_{key}"))
    return same


def _sizes() -> list[int]:
    return [1 << i for i in range(PIECE.bit_length())]


def _piece_size(length: Column) -> Column:
    """Largest block of which any string of this ``length`` holds a whole one: anywhere if
    ``dense``, else wherever a row of blocks begins. 0 for an empty string."""
    size = F.when(length == 0, F.lit(0))
    for power in _sizes()[:-1]:
        size = size.when(length < F.when(F.col("dense"), 2 * power).otherwise(4 * power - 1), F.lit(power))
    return size.otherwise(F.lit(PIECE))


def _of_group() -> Column:
    """Hash of what has to be the same for a block to count."""
    return F.xxhash64(*_GROUP, "texts", "fixed", "side", "dense")


def _asked_pieces(texts: DataFrame, ways: Column | None = None) -> DataFrame:
    """``gid, dense, window, h``: the hashes of all shifts in some windows of each golden
    string, with the ``size`` of its blocks. Only short strings can lie in dense ones."""
    return _shifts(_windows(texts, ways))


def _windows(texts: DataFrame, ways: Column | None = None) -> DataFrame:
    """Some windows of each golden string, for dense blocks, for others or for both (``ways``)."""
    if ways is None:
        ways = F.when(F.col("short"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    sized = texts.withColumn("dense", F.explode(ways)).select(
        *_CUT, "gid", "text", let(F.length("text"), _piece_size).alias("size"), _of_group().alias("of")
    )

    def cut(text: Column) -> Column:
        length, size = text["length"], text["size"]
        width = F.when(F.col("dense"), size).otherwise(F.greatest(2 * size - 1, F.lit(0)))
        places = F.when(F.col("dense"), length - width + 1).otherwise(F.ceil(length / F.greatest(width, F.lit(1))))
        last = F.greatest(F.least(F.lit(WINDOWS), places.cast("int")) - 1, F.lit(0))
        starts = F.transform(
            F.sequence(F.lit(0), last), lambda i: F.floor((length - width) * i / F.greatest(last, F.lit(1))).cast("int") + 1
        )
        return F.transform(F.array_distinct(starts), lambda at: F.substring("text", at, width))

    # a text's length is counted once
    parts = let(F.struct(F.length("text").alias("length"), "size"), cut)
    return sized.select(*_CUT, "size", "gid", "of", parts.alias("parts"))


def _shifts(windows: DataFrame) -> DataFrame:
    size = F.col("size")
    each = windows.select(*_CUT, "size", "gid", "of", F.posexplode("parts").alias("window", "part"))
    shifts = F.sequence(F.lit(1), F.when(F.col("dense"), F.lit(1)).otherwise(F.greatest(size, F.lit(1))))
    hashes = F.array_distinct(F.transform(shifts, lambda at: F.xxhash64("of", F.substring("part", at, size))))
    return each.select(*_CUT, "size", "gid", "window", F.explode(hashes).alias("h"))


def _offered_pieces(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """``h, pid`` for the blocks of the predicted strings, of the sizes asked for in their case."""
    # at most seven sizes per group
    sizes = stage(asked.groupBy(*_CUT).agg(F.collect_set("size").alias("sizes")), "sizes")
    sized = texts.join(broadcast_if_small(sizes), _CUT).select("pid", "text", "sizes", "dense", _of_group().alias("of"))

    def hashes(size: int) -> Column:
        if size == 0:
            blocks = F.array(F.lit(""))
        else:
            starts = F.sequence(F.lit(1), F.greatest(F.length("text") - size + 1, F.lit(1)))
            every = F.filter(F.transform(starts, lambda at: F.substring("text", at, size)), lambda x: F.length(x) == size)
            in_row = F.regexp_extract_all("text", F.lit(f"(?s).{{{size}}}"), F.lit(0))
            blocks = F.when(F.col("dense"), every).otherwise(in_row)
        cut = F.transform(blocks, lambda block: F.xxhash64("of", block))
        return F.when(F.array_contains("sizes", size), F.array_distinct(cut)).otherwise(F.array().cast("array<bigint>"))

    every = F.concat(*map(hashes, [0, *_sizes()]))
    return sized.select("pid", F.explode(every).alias("h"))


def records_match(golden: DataFrame, predicted: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Whether two sets of keyed values have the same keys, and values that match.

    Inputs: case_id, the key columns (tagged, compared exactly), v; one row per
    key. Output, per case met on either side: bad_keys, matched.
    """
    keys = keys or ["k"]
    on = ["case_id", *keys]
    g = golden.select(*on, F.col("v").alias("g"), F.lit(True).alias("in_golden"))
    p = predicted.select(*on, F.col("v").alias("p"), F.lit(True).alias("in_predicted"))
    usable, bad = F.lit(True), F.lit(False)
    for key in keys:
        usable = usable & ~_is_nan(F.col(key))
        bad = bad | (F.col(f"{key}.kind") == "other")
    both = F.col("in_golden").isNotNull() & F.col("in_predicted").isNotNull()
    same = F.when(both & usable, values_match(F.col("g"), F.col("p"))).otherwise(F.lit(False))
    return (
        g.join(p, on, "full_outer")
        .groupBy("case_id")
        .agg(F.bool_or(bad).alias("bad_keys"), F.bool_and(same).alias("all_same"))
        .select("case_id", "bad_keys", (F.col("all_same") & ~F.col("bad_keys")).alias("matched"))
    )


def triples_match(golden: DataFrame, predicted: DataFrame) -> DataFrame:
    """``records_match`` of (k1, k2) -> v points, the last value of a repeated key counting."""
    on = ["case_id", "k1", "k2"]
    return records_match(last_values(golden, on), last_values(predicted, on), ["k1", "k2"])
