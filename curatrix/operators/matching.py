"""Blocked fuzzy matching with exact top-k results.

Names repeat, so both sides are first folded to distinct *signatures*. Rare words use a plain inverted
index. A word that occurs in very many signatures would pair everything with everything; there the index
is keyed by the *set* of frequent words a name holds, and each ``(word set, scoring class)`` keeps only the
``k`` smallest ids: any further member of that class has ``k`` others that score at least as high and sort
before it, so it cannot be in a top-k. Scores that depend on more than the class get a second, bound-driven
pass over exactly those classes that may still beat the k-th best score. Nothing is cut off otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from curatrix.functions.text import col
from curatrix.operators.scale import small_side
from curatrix.session import materialize

# Up to this many frequent words all their sets are listed.
MAX_FREQUENT = 8


def _subsets(words: Column) -> Column:
    """All non-empty subsets of a short sorted array, each joined by blanks."""
    empty = F.array(F.lit("")).cast("array<string>")
    grown = F.aggregate(
        words, empty,
        lambda acc, w: F.concat(acc, F.transform(acc, lambda s: F.when(s == "", w).otherwise(F.concat(s, F.lit(" "), w)))),
    )
    return F.filter(grown, lambda s: s != "")


def _combinations(words: Column, size: int) -> Column:
    """Combinations of two or three words of a sorted array, each joined by blanks."""

    def after(i: Column) -> Column:
        return F.slice(words, i + 2, F.greatest(F.size(words) - i - 1, F.lit(0)))

    if size == 2:
        return F.flatten(F.transform(words, lambda w, i: F.transform(after(i), lambda v: F.concat_ws(" ", w, v))))
    return F.flatten(F.transform(words, lambda w, i: F.flatten(F.transform(
        after(i), lambda v, j: F.transform(after(i + j + 1), lambda u: F.concat_ws(" ", w, v, u))))))


def candidate_pairs(
    left: DataFrame, right: DataFrame, k: int, class_columns: Sequence[str] = (), frequency_limit: int = 64,
    score: Callable[[DataFrame], DataFrame] | None = None, bound: Callable[[DataFrame], Column] | None = None,
    bonus: str | None = None,
) -> DataFrame:
    """Pairs ``(lkey, rkey)`` that contain every top-k partner of each left signature.

    ``left(lkey, words, scope)`` and ``right(rkey, words, scopes, min_id, *class_columns)`` hold distinct signatures;
    a pair needs a shared word inside a shared scope (block), so other blocks never meet. ``bonus`` names an array on
    both sides whose overlap can only raise a score: the best of every class are kept once without it and once per
    value of it.
    """
    l = left.select("lkey", "scope", F.explode("words").alias("word"))
    r = right.select("rkey", F.explode("scopes").alias("scope"), "words").select("rkey", "scope", F.explode("words").alias("word"))
    on = ["scope", "word"]
    counts = r.groupBy(*on).agg(F.count(F.lit(1)).alias("df"))
    # At most postings / limit entries are frequent; without any, the plain index is the whole answer.
    frequent = materialize(counts.where(F.col("df") > frequency_limit).select(*on, F.lit(True).alias("hot")))
    if frequent.isEmpty():
        return l.join(r, on).select("lkey", "rkey").distinct()
    mark = lambda side: side.join(small_side(frequent), on, "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    l, r = mark(l), mark(r)
    rare = l.where(~F.col("hot")).join(r.where(~F.col("hot")), on).select("lkey", "rkey")

    pack = F.array_sort(F.collect_list("word"))
    lhot = l.where("hot").groupBy("lkey", "scope").agg(pack.alias("hot_words"))
    rhot = r.where("hot").groupBy("rkey", "scope").agg(pack.alias("hot_words")).join(
        right.select("rkey", "min_id", F.size("words").alias("_size"), *class_columns, *([bonus] if bonus else [])), "rkey")
    narrow = F.size("hot_words") <= MAX_FREQUENT
    sets = F.explode(F.when(narrow, _subsets(F.col("hot_words"))).otherwise(F.concat("hot_words", _combinations(F.col("hot_words"), 2))))
    lsets = lhot.select("lkey", "scope", sets.alias("wordset"))
    rsets = rhot.withColumn("wordset", sets).drop("hot_words")
    classes = ["scope", "wordset", "_size", *class_columns]
    first_k = lambda rows, by: rows.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy("min_id"))).where(F.col("_n") <= k)
    kept = first_k(rsets, classes)
    hot = lsets.join(kept.select("scope", "wordset", "rkey"), ["scope", "wordset"]).select("lkey", "rkey")
    if bonus:
        lb = lsets.join(left.select("lkey", F.explode(bonus).alias("_b")), "lkey")
        rb = first_k(rsets.withColumn("_b", F.explode(bonus)), [*classes, "_b"]).select("scope", "wordset", "_b", "rkey")
        hot = hot.unionAll(lb.join(rb, ["scope", "wordset", "_b"]).select("lkey", "rkey"))
    # A name with very many frequent words lists only its sets of one and two; a pair that shares three or more
    # meets on a triple instead, which is far rarer than a word.
    triples = lambda side, key: side.select(key, "scope", F.explode(_combinations(F.col("hot_words"), 3)).alias("word"))
    wide = triples(lhot.where(~narrow), "lkey").join(triples(rhot, "rkey"), on).select("lkey", "rkey").unionAll(
        triples(lhot, "lkey").join(triples(rhot.where(~narrow), "rkey"), on).select("lkey", "rkey"))
    pairs = rare.unionAll(hot).unionAll(wide).distinct()
    if bound is None or score is None:
        return pairs
    # Bound pass: the k-th best score so far decides which classes must be read in full.
    ranked = score(pairs).withColumn("_n", F.row_number().over(
        W.partitionBy("lkey").orderBy(F.col("score").desc(), "min_id"))).where(F.col("_n") <= k)
    kth = ranked.groupBy("lkey").agg(F.count(F.lit(1)).alias("_c"), F.min("score").alias("_kth")).where(F.col("_c") == k)
    sizes = rsets.groupBy(*classes).agg(F.count(F.lit(1)).alias("_members")).where(F.col("_members") > k)
    lwords = left.select("lkey", F.col("words").alias("lwords"))
    open_ = lsets.join(sizes, ["scope", "wordset"]).join(lwords, "lkey").join(kth, "lkey", "left")
    open_ = open_.where(F.col("_kth").isNull() | (bound(open_) >= F.col("_kth")))
    rest = open_.select("lkey", *classes).join(rsets, classes).select("lkey", "rkey")
    return pairs.unionAll(rest).distinct()


def signatures(df: DataFrame, ident: str, words: str, class_columns: Sequence[str], k: int, key: str) -> DataFrame:
    """Distinct word sets with their ``k`` smallest ids: ``(key, words, min_id, ids, *class_columns)``."""
    base = df.withColumn("words", F.array_sort(F.col(words)) if words != "words" else F.array_sort("words"))
    base = base.withColumn(key, F.sha2(F.to_json(F.struct("words", *class_columns)), 256)).where(F.size("words") > 0)
    ids = base.select(key, F.col(ident).alias("_id")).withColumn(
        "_n", F.row_number().over(W.partitionBy(key).orderBy("_id"))).where(F.col("_n") <= k)
    packed = ids.groupBy(key).agg(F.array_sort(F.collect_list("_id")).alias("ids"))
    heads = base.select(key, "words", *class_columns).dropDuplicates([key])
    return heads.join(packed, key).withColumn("min_id", F.get("ids", F.lit(0)))


def top_matches(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, words: str, score: Callable[[DataFrame], DataFrame],
    k: int = 5, class_columns: Sequence[str] = (), left_columns: Sequence[str] = (), min_score: float = 0.0,
    scope: Column | None = None, scopes: Column | None = None, frequency_limit: int = 64,
    bound: Callable[[DataFrame], Column] | None = None, right_columns: Sequence[str] = (),
    bonus: str | None = None,
) -> DataFrame:
    """Top-k partners per left record as ``(left_id, rank, right_id, score)``.

    ``score`` receives pairs with ``lwords``, ``rwords``, the left and class columns and adds ``score``; it must
    not fall when the overlap grows within one class, unless ``bound`` gives an upper bound per class.
    ``right_columns`` also identify a right signature, but do not split the classes. ``scope`` of a left signature and
    the ``scopes`` array of a right one (over their own columns) say which blocks may meet. ``bonus`` is an array
    column of both sides (listed in ``left_columns`` and ``right_columns``) whose overlap can only raise a score.
    """
    wanted = [*class_columns, *right_columns]
    # Signatures are far fewer than records and are read several times.
    lsig = materialize(signatures(left, left_id, words, left_columns, 1, "lkey").drop("ids", "min_id").withColumn(
        "scope", F.lit("") if scope is None else scope))
    rsig = materialize(signatures(right, right_id, words, wanted, k, "rkey").withColumn(
        "scopes", F.array(F.lit("")) if scopes is None else scopes))
    rcols = [F.col(c).alias(f"r_{c}") for c in wanted]

    def attach(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(lsig.select("lkey", F.col("words").alias("lwords"), *left_columns), "lkey")
            .join(rsig.select("rkey", F.col("words").alias("rwords"), "min_id", "ids", *rcols), "rkey")
        )

    rate = lambda pairs: score(attach(pairs))
    pairs = candidate_pairs(lsig, rsig, k, class_columns, frequency_limit, rate, bound, bonus)
    scored = rate(pairs)
    scored = scored.where((F.col("score") >= min_score) & (F.col("score") > 0))
    best = scored.withColumn("_n", F.row_number().over(
        W.partitionBy("lkey").orderBy(F.col("score").desc(), "min_id"))).where(F.col("_n") <= k)
    flat = best.select("lkey", "score", F.explode("ids").alias(right_id))
    ranked = flat.withColumn("rank", F.row_number().over(
        W.partitionBy("lkey").orderBy(F.col("score").desc(), right_id))).where(F.col("rank") <= k)
    # One row per signature: the join back to the records can be split by AQE when a name is very common.
    packed = ranked.groupBy("lkey").agg(
        F.array_sort(F.collect_list(F.struct("rank", right_id, "score"))).alias("_top"))
    keyed = left.withColumn("words", F.array_sort(F.col(words)) if words != "words" else F.array_sort("words"))
    keyed = keyed.withColumn("lkey", F.sha2(F.to_json(F.struct("words", *left_columns)), 256))
    return keyed.select(F.col(left_id), "lkey").join(packed, "lkey").select(left_id, F.inline("_top"))


def token_score(block_bonus: float = 0.12) -> Callable[[DataFrame], DataFrame]:
    """Jaccard, +0.15 for two shared words, +0.05 for one of six letters or more, +0.12 in the same block."""

    def score(pairs: DataFrame) -> DataFrame:
        shared = F.array_intersect("lwords", "rwords")
        n = F.size(shared)
        base = n / F.size(F.array_union("lwords", "rwords"))
        bonus = F.when(n >= 2, 0.15).when((n == 1) & (F.length(F.get(shared, F.lit(0))) >= 6), 0.05).otherwise(0.0)
        value = F.least(base + bonus, F.lit(1.0))
        if "block" in pairs.columns and "r_block" in pairs.columns:
            value = F.when(F.col("block").eqNullSafe(F.col("r_block")) & F.col("block").isNotNull() & (n > 0),
                           F.least(value + block_bonus, F.lit(1.0))).otherwise(value)
        return pairs.withColumn("score", F.round(value, 4))

    return score


def fuzzy_topk(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, words: str = "words", block: str | None = None,
    k: int = 5, min_score: float = 0.18, open_block: str = "other", frequency_limit: int = 64,
) -> DataFrame:
    """Token-overlap top-k inside the block; a left row whose block has no pool sees all blocks but ``open_block``."""
    if block is None:
        return top_matches(left, right, left_id, right_id, words, token_score(), k, min_score=min_score,
                           frequency_limit=frequency_limit)
    left, right = left.withColumnRenamed(block, "block"), right.withColumnRenamed(block, "block")
    pools = right.select("block").distinct().withColumn("has_pool", F.lit(True))
    left = left.join(small_side(pools), "block", "left").withColumn("has_pool", F.coalesce("has_pool", F.lit(False)))
    # Scope "=block" is the block itself, "*" is every block but the open one.
    own = F.concat(F.lit("="), F.coalesce("block", F.lit("")))
    pooled = left.where(~F.col("has_pool")).isEmpty()
    scopes = F.array(own) if pooled else F.when(F.col("block").eqNullSafe(F.lit(open_block)), F.array(own)).otherwise(F.array(own, F.lit("*")))
    return top_matches(left, right, left_id, right_id, words, token_score(), k, ["block"], ["block", "has_pool"], min_score,
                       F.when(F.col("has_pool"), own).otherwise("*"), scopes, frequency_limit)


def confidence_band(score: Column | str, high: float = 0.7, medium: float = 0.45) -> Column:
    return F.when(col(score) >= high, "high").when(col(score) >= medium, "medium").otherwise("low")


def subject_score(generic: Iterable[str] = ()) -> Callable[[DataFrame], DataFrame]:
    """Containment ladder with a year bonus or penalty of 0.10.

    Uses left ``years`` and class columns ``years`` and ``specific`` (number of words outside ``generic``).
    """
    generic = sorted(set(generic)) or ["\u0000"]

    def score(pairs: DataFrame) -> DataFrame:
        shared = F.array_intersect("lwords", "rwords")
        n, s = F.size(shared), F.size("lwords")
        only = F.length(F.get(shared, F.lit(0)))
        extra = F.array_except("rwords", "lwords")
        bare = F.forall(extra, lambda w: w.isin(*generic))
        long_word = F.when(only >= 7, 0.42).otherwise(0.0)
        value = (
            F.when(n == 0, 0.0)
            .when((n == s) & (s == 1), F.when(bare, 0.79).otherwise(long_word))
            .when(n == s, F.least(F.lit(1.0), 0.72 + 0.07 * s))
            .when(n >= 2, F.least(F.lit(0.88), 0.30 + 0.45 * (n / s) + 0.05 * n))
            .otherwise(long_word)
        )
        if "years" in pairs.columns and "r_years" in pairs.columns:
            hit = F.arrays_overlap("years", F.coalesce("r_years", F.array().cast("array<int>")))
            shifted = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value + F.when(F.coalesce(hit, F.lit(False)), 0.10).otherwise(-0.10)))
            value = F.when((value > 0) & (F.size("years") > 0), shifted).otherwise(value)
        return pairs.withColumn("score", F.round(value, 4))

    return score


def edit_ratio(a: Column | str, b: Column | str) -> Column:
    """One minus the edit distance over the longer length; two empty texts are alike."""
    a, b = col(a), col(b)
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def composite_score(
    similarity: Callable[[str, str], Column] = edit_ratio, adjust: Callable[[Column], Column] | None = None,
) -> Callable[[DataFrame], DataFrame]:
    """0.35 containment + 0.25 Jaccard + 0.20 similarity of the texts + 0.20 hits of the first two words.

    Left columns: ``text`` and ``core`` (first two words). Class column on the right: ``text``. ``adjust`` turns the name score into the
    score that ranks (for example ``adjust_composite`` over the left columns and the right ones, ``r_*``); its bonus belongs into the bound.
    """

    def score(pairs: DataFrame) -> DataFrame:
        n = F.size(F.array_intersect("lwords", "rwords"))
        union = F.size(F.array_union("lwords", "rwords"))
        core = F.size(F.filter("core", lambda t: F.array_contains("rwords", t))) / F.greatest(F.size("core"), F.lit(1))
        value = F.round(0.35 * n / F.size("lwords") + 0.25 * n / union + 0.20 * similarity("text", "r_text") + 0.20 * core, 4)
        return pairs.withColumn("score", value if adjust is None else adjust(value))

    return score


CONTEXT_BONUS, LATE_PENALTY = 0.12, 0.08


def adjusted_bound(open_: DataFrame) -> Column:
    """Upper bound of a composite score that ``adjust_composite`` may raise."""
    return composite_bound(open_) + CONTEXT_BONUS


def composite_bound(open_: DataFrame) -> Column:
    """Upper bound of ``composite_score`` for a class with exactly the given shared words."""
    n = F.size(F.split("wordset", " "))
    s = F.size("lwords")
    return F.round(0.35 * n / s + 0.25 * n / (s + F.col("_size") - n) + 0.20 + 0.20, 4)


def adjust_composite(score: Column, gate: Column, context: Column, late: Column) -> Column:
    """Context bonus 0.12 behind the identity gate, late-release penalty 0.08, clamped to [0, 1]."""
    value = score + F.when(context & gate, CONTEXT_BONUS).otherwise(0.0) - F.when(late, LATE_PENALTY).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 4)


def composite_band(top: Column | str, margin: Column | str) -> Column:
    top, margin = col(top), col(margin)
    return (
        F.when((top >= 0.86) & (margin >= 0.10), "strong_candidate")
        .when((top >= 0.76) & (margin >= 0.05), "review_candidate").otherwise("unresolved")
    )
