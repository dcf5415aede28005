"""Quality rules with thresholds that follow each language and source.

Fixed cutoffs judge every language and source alike. Here each rule's metric is
summed up in a mergeable quantile sketch per (language, source), and from the
sketches' quartiles come the bounds that this group's documents must keep. The
sketches of small groups are merged into their language's, those of small
languages into one for the whole table. Bounds are joined back and filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import WHITE, WORD, staged

SYMBOLS = "#*$%&|<>"
GRAM = 5

#: Groups of fewer documents take the bounds of the next larger group.
MIN_GROUP = 200
#: Items a sketch keeps on its lowest level.
SKETCH_K = 400
#: Bounds lie so many interquartile ranges beyond the quartiles, and at least so far from them.
FENCE = 4.0
METRICS = {"word_length": 1.5, "symbol_share": 0.02, "dup_line_share": 0.3, "repeat_share": 0.15}


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also inside other functions."""
    return F.transform(F.array(value), body)[0]


def _covered(at: Column) -> Column:
    """Words covered by windows of GRAM words that start at the sorted positions ``at``."""
    gaps = F.transform(at, lambda p, k: F.when(k + 1 < F.size(at), F.least(F.get(at, k + 1) - p, F.lit(GRAM))).otherwise(F.lit(GRAM)))
    return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)


def _repeat_words(words: Column) -> Column:
    """Words in windows of GRAM words found twice or more in the text.

    Hashes of the windows tell in most texts that none repeats; where some do,
    the windows themselves are sorted with their places and neighbours compared.
    """
    places = F.sequence(F.lit(0), F.size(words) - GRAM)
    hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(GRAM)]))
    windows = F.sort_array(F.transform(places, lambda i: F.struct(F.array_join(F.slice(words, i + 1, GRAM), " ").alias("w"), i.alias("i"))))
    same = lambda s, k, x: F.coalesce(F.get(s, k)["w"] == x["w"], F.lit(False))
    repeated = _let(
        windows,
        lambda s: F.transform(F.filter(s, lambda x, k: ((k > 0) & same(s, F.greatest(k - 1, F.lit(0)), x)) | same(s, k + 1, x)), lambda x: x["i"]),
    )
    counted = _let(F.sort_array(repeated), _covered)
    any_ = _let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(words) < GRAM + 1, F.lit(0)).when(any_, counted).otherwise(F.lit(0)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base metrics of every whole text; null texts count as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    raw = docs.select(
        "doc_id",
        "lang",
        "source",
        text.alias("_t"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_w"),
        F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, WHITE, "")) > 0).alias("_lines"),
    )
    return raw.select(
        "doc_id",
        "lang",
        "source",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w")).alias("n_repeat_words"),
        F.size("_lines").alias("_n_lines"),
    )


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def with_metrics(base: DataFrame) -> DataFrame:
    return base.select(
        "*",
        _share("word_chars", "n_words").alias("word_length"),
        _share("n_symbols", "word_chars").alias("symbol_share"),
        _share("n_dup_lines", "_n_lines").alias("dup_line_share"),
        _share("n_repeat_words", "n_words").alias("repeat_share"),
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
    )


def bounds(rows: DataFrame) -> DataFrame:
    """Lower and upper bound of each metric per (lang, source), from merged sketches."""
    names = list(METRICS)
    leaf = rows.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("_n"), *[F.kll_sketch_agg_double(m, SKETCH_K).alias(m) for m in names]
    )
    leaf = staged(leaf, "sketches")
    merge = [F.sum("_n").alias("_n"), *[F.kll_merge_agg_double(m).alias(m) for m in names]]
    lang, whole = leaf.groupBy("lang").agg(*merge), leaf.agg(*merge)
    up = lambda df, p: df.select(*[F.col(c).alias(c if c == "lang" else f"{p}{c}") for c in df.columns])
    own, mid, top = leaf, up(lang, "_l_").withColumnRenamed("lang", "_lang"), up(whole, "_a_")
    # ``top`` is one row by construction: an aggregate without keys.
    both = own.join(mid, F.col("lang").eqNullSafe(F.col("_lang"))).withColumn("_top", top.select(F.struct("*")).scalar())
    out = []
    for m, least in METRICS.items():
        sketch = F.when(F.col("_n") >= MIN_GROUP, F.col(m)).when(F.col("_l__n") >= MIN_GROUP, F.col(f"_l_{m}")).otherwise(F.col("_top")[f"_a_{m}"])
        low, high = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.75))
        room = F.greatest((high - low) * FENCE, F.lit(least))
        out += [(low - room).alias(f"_low_{m}"), (high + room).alias(f"_high_{m}")]
    return both.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *out)


def judged(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, base metrics, base_failed, kept.

    Null texts count as empty; null languages and sources are groups of their
    own. Rows that repeat are judged each, an empty table gives no rows, and
    other columns are ignored. Sketches are deterministic up to the order in
    which they meet; bounds are written once and every row sees the same ones.
    """
    rows = staged(with_metrics(measured(docs)), "metrics")
    limits = staged(bounds(rows), "bounds")
    inside = F.lit(True)
    for m in METRICS:
        inside = inside & F.col(m).between(F.col(f"_low_{m}"), F.col(f"_high_{m}"))
    # One row per language and source; both sides of a hot source are split as Spark finds them.
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept")
    )
