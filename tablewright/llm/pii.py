"""Personal data: fixed patterns, and terms that give a protected value away.

The protected entities are the values that the patterns find. How strongly a
term reveals one is read from the corpus: its disclosure is the pointwise mutual
information of the two, estimated from the documents that hold them, as a share
of the value's own information content (1: whoever reads the term knows the
value). Terms whose disclosure of some value reaches the threshold, on the
evidence of several documents, are spans too wherever they stand in any text,
and are generalised or removed with the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import SALTS, salt, spread_join, staged

# Fixed patterns, written so that no text makes them backtrack: possessive
# repeats, and a start only where a run starts or the last match ended.
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])?"

KINDS = ("email", "ip", "card", "phone")

#: Terms are words of two letters or more, outside addresses.
TERM = r"\p{L}{2,}+"
#: Matches whose places are counted in one go.
BLOCK = 128

#: Disclosure from which a term is a span, and the documents in which both must stand together.
THRESHOLD, EVIDENCE = 0.9, 3


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _matches(text: Column, pattern: str, may_hold: Column) -> Column:
    """array<struct<start, end, value>> of the pattern's matches, in code points.

    What stands between the matches and the matches themselves alternate, so
    their lengths give the places.
    """
    empty = F.array().cast("array<string>")
    found = F.when(may_hold, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(empty)
    between = F.when(may_hold, F.split(text, pattern, -1)).otherwise(empty)
    gaps = F.transform(between, lambda g: F.length(g))
    steps = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("gap"), (g + F.length(m)).alias("step")))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def walk(block: Column, at: Column) -> Column:
        first = F.struct(at.alias("at"), none.alias("out"))
        move = lambda a, s: F.struct(
            (a["at"] + s["step"]).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + s["gap"]).alias("start"), (a["at"] + s["step"]).alias("end"), s["m"].alias("value")))).alias("out"),
        )
        return F.aggregate(block, first, move)["out"]

    def starts(blocks: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        total = lambda b: F.aggregate(b, F.lit(0), lambda x, s: x + s["step"])
        return F.aggregate(blocks, first, lambda a, b: F.struct((a["at"] + total(b)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

    # Arrays only grow by copying, so places are counted block by block.
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")), lambda b: F.slice(s, b * BLOCK + 1, BLOCK))
    placed = _let(_let(F.filter(steps, lambda s: s["m"].isNotNull()), cut), lambda blocks: F.flatten(_let(starts(blocks), lambda at: F.zip_with(blocks, at, walk))))
    return F.when(F.size(found) > 0, placed).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    n = F.length(_digits(value))
    if kind == "card":
        return n.between(13, 19) & F.call_function("luhn_check", _digits(value))
    return n.between(9, 15)


def base_spans(docs: DataFrame) -> DataFrame:
    """_row (a number), doc_id, _t (the text), and spans array<struct<kind, start, end, value>> of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", text.alias("_t"))
    t = F.col("_t")
    digit = t.rlike("[0-9]")
    for kind, pattern, may in (("email", EMAIL, F.contains(t, F.lit("@"))), ("ip", IP, digit), ("card", CARD, digit), ("phone", PHONE, F.contains(t, F.lit("+")))):
        rows = rows.withColumn(f"_{kind}", _matches(t, pattern, may))
    def spans(number: int, kind: str) -> Column:
        valid = F.filter(F.col(f"_{kind}"), lambda m: _valid(kind, m["value"]))
        return F.transform(
            valid,
            lambda m: F.struct(
                F.lit(number).alias("kind"),
                m["start"].alias("start"),
                m["end"].alias("end"),
                m["value"].alias("value"),
            ),
        )

    parts = [spans(i, k) for i, k in enumerate(KINDS)]
    return rows.select("_row", "doc_id", "_t", F.concat(*parts).alias("spans"))


def _terms(text: Column) -> Column:
    """The different terms of a text; what stands in an address is the value's own."""
    bare = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, EMAIL, " ")).otherwise(text)
    return F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit(TERM), F.lit(0)), lambda w: F.lower(w)))


def term_counts(base: DataFrame) -> DataFrame:
    """term and the number of documents that hold it, over all words of all texts."""
    return base.select(F.explode(_terms(F.col("_t"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))


def revealing(base: DataFrame, threshold: float = THRESHOLD, evidence: int = EVIDENCE) -> DataFrame:
    """value, term, disclosure of the pairs whose disclosure reaches the threshold."""
    total = base.agg(F.count(F.lit(1)).alias("n"))
    found = F.array_distinct(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"]))))
    held = staged(base.filter(F.size("spans") > 0).select("_row", F.explode(found).alias("value")), "values")
    # Pairs need documents enough: values that are in fewer meet no term.
    values = staged(held.groupBy("value").agg(F.count(F.lit(1)).alias("n_value")).filter(F.col("n_value") >= evidence), "value-counts")
    mine = spread_join(held, "value", "_row", values.select("value")).groupBy("_row").agg(F.collect_list("value").alias("_values"))  # one document's
    both = base.select("_row", "_t").join(mine, "_row").select("_values", F.explode(_terms(F.col("_t"))).alias("term"))
    pairs = (
        both.select(F.explode("_values").alias("value"), "term")
        .groupBy("value", "term")
        .agg(F.count(F.lit(1)).alias("n_both"))
        .filter(F.col("n_both") >= evidence)
    )
    joined = pairs.join(values, "value").join(term_counts(base), "term").withColumn("n", total.select("n").scalar())
    information = F.log2(F.col("n") / F.col("n_value"))
    shared = F.log2(F.col("n") * F.col("n_both") / (F.col("n_value") * F.col("n_term")))
    return (
        joined.withColumn("disclosure", F.when(information > 0, shared / information).otherwise(F.lit(0.0)))
        .filter(F.col("disclosure") >= threshold)
        .select("value", "term", "disclosure")
    )


def private_spans(docs: DataFrame, threshold: float = THRESHOLD, evidence: int = EVIDENCE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Spans are kind:start:end, by kind and then start; the revealing terms' kind
    is ``term`` and comes last. A term is marked at every place of every text. Null texts count as empty and have none. Rows
    that repeat have equal spans and count as documents of their own; an
    empty table gives no rows; other columns are ignored.
    """
    base = staged(base_spans(docs), "private")
    terms = staged(revealing(base, threshold, evidence).select("term").distinct(), "terms")
    # One term may stand in a large part of all rows: terms go to every sub-key.
    copies = terms.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = base.select("_row", F.explode(_terms(F.col("_t"))).alias("term")).withColumn("_salt", salt("_row"))
    hits = each.join(copies, ["term", "_salt"]).groupBy("_row").agg(F.collect_list("term").alias("_hits"))  # one document's
    rows = base.join(hits, "_row", "left")
    emails = F.filter("spans", lambda s: s["kind"] == 0)
    outside = lambda m: ~F.exists(emails, lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"]))
    words = _matches(F.col("_t"), TERM, F.col("_hits").isNotNull())
    marked = F.filter(words, lambda m: F.array_contains("_hits", F.lower(m["value"])) & outside(m))
    rows = rows.select("doc_id", "spans", F.transform(marked, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))).alias("_more"))
    text_of = lambda kinds: lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in kinds]), s["kind"] + 1), s["start"], s["end"])
    ordered = F.sort_array(F.transform("spans", lambda s: F.struct(s["kind"], s["start"], s["end"])))
    listed = F.array_join(F.transform(ordered, text_of(KINDS)), ",")
    terms = F.transform(F.coalesce("_more", F.array().cast("array<struct<start:int,end:int>>")), lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["end"]))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(listed.cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(F.transform(ordered, text_of(KINDS)), terms), ",").alias("spans"),
    )


def sanitised(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with every span's text replaced: values by their kind in angle brackets, terms removed.

    ``spans`` is the result of :func:`private_spans` over the same rows;
    doc_ids must be unique. Where spans overlap, the first one's label stands
    for both.
    """
    pieces = F.filter(F.split("spans", ","), lambda x: x != "")
    parsed = F.sort_array(
        F.transform(pieces, lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("s"), F.split(x, ":")[2].cast("int").alias("e"), F.split(x, ":")[0].alias("k")))
    )
    marked = docs.join(spans.select(F.col("doc_id").alias("_llm_id"), parsed.alias("_llm_spans")), docs["doc_id"].eqNullSafe(F.col("_llm_id")), "left")
    text = F.col("text").cast("string")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda a, s: F.when(
        s["s"] >= a["at"],
        F.struct(
            s["e"].alias("at"),
            F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, s["s"] - a["at"]), F.when(s["k"] == "term", F.lit("")).otherwise(F.concat(F.lit("<"), s["k"], F.lit(">"))))).alias("out"),
        ),
    ).otherwise(F.struct(F.greatest(a["at"], s["e"]).alias("at"), a["out"].alias("out")))
    clean = F.aggregate("_llm_spans", start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return marked.withColumn("text", F.when(F.size("_llm_spans") > 0, clean).otherwise(text)).select(*[f"`{c}`" for c in docs.columns])
