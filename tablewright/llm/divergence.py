"""How far sources of a language differ, term by term, with Gustavson's row accumulation.

Each (language, source) group is a sparse row of term counts. For the distance
of every two groups the workers hold the term-major index of a block of terms:
a group scatters each of its terms through that term's postings into a dense
accumulator with one place per peer, so no pair of postings ever becomes a row.
The index knows only terms that both groups have. What a term adds where one
group or both lack it depends on the group's zero count alone: those baselines
are summed over a histogram of each group's own shares, and the accumulators
hold the corrections to them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import slices, staged, word_lists
from tablewright.session import join_groups

LEAST_DOCUMENTS, SCALE, SMOOTHING, TOP_TERMS = 10, 1_000_000_000, 2, 10

#: A worker hands its counts on above so many entries, and looks at so many postings at a time.
HELD_TERMS, BLOCK_POSTINGS, HELD_CELLS = 300_000, 200_000, 4_000_000

# Terms: runs of ASCII letters and of everything beyond ASCII, A-Z in lower case.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _counter(limit: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """lang, source, term, n (occurrences), d (documents), added up until ``limit`` entries are held."""
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in held.items():
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(n)), pa.array([source] * len(n)), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in n], pa.int64())],
                        ["lang", "source", "term", "n", "d"],
                    )
            held.clear()

        since = 0
        for batch in slices(batches, "_t"):
            for lang, source, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                for words in word_lists((value.as_py() or b"").translate(_LETTERS)):
                    n.update(words)
                    seen.update(words)
                d.update(seen)
                since += len(n) - before
                if since > limit:
                    yield from flush()
                    since = 0
        yield from flush()

    return count


def _share(n: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kinds)), exact; 1 where there is no term at all."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = F.lit(SCALE).cast("decimal(10,0)") * wide(n + SMOOTHING)
    whole = F.call_function("div", top, F.nullif(wide(total + SMOOTHING * kinds), F.lit(0)))
    return F.coalesce(whole + F.lit(1), F.lit(1)).cast("long")


def spread(p, q):
    """floor((p - q)^2 / (p + q)) of whole numbers or arrays of them."""
    return (p - q) * (p - q) // (p + q)


def _scatterer(postings: int, cells: int):
    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """lang, a, b, v: for groups a and b, the sum over terms of both of what the zero baselines got wrong.

        Rows come sorted by language and term, so each term's postings lie together.
        """
        dense: dict[tuple[str, int], np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, a), row in dense.items():
                peers = np.flatnonzero(row)
                if len(peers):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(peers)), pa.array(np.full(len(peers), a, np.int32)), pa.array(peers.astype(np.int32)), pa.array(row[peers])], ["lang", "a", "b", "v"]
                    )
            dense.clear()

        def block(rows: pa.Table) -> None:
            lang = rows.column("lang").combine_chunks().dictionary_encode()
            language, names = lang.indices.to_numpy(), lang.dictionary.to_pylist()
            term = rows.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
            group, peers, p, zero = (rows.column(c).to_numpy() for c in ("g", "peers", "p", "zero"))
            n = len(term)
            heads = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (language[1:] != language[:-1])]))
            length = np.diff(np.concatenate([heads, [n]]))
            first, size = np.repeat(heads, length), np.repeat(length, length)  # each posting's list
            order = np.lexsort((group, language))
            cuts = np.flatnonzero(np.concatenate([[True], (group[order][1:] != group[order][:-1]) | (language[order][1:] != language[order][:-1])]))
            for own in np.split(order, cuts[1:]):
                counts = size[own]
                ends = np.cumsum(counts)
                # All postings of all the group's terms, term by term.
                at = np.arange(ends[-1]) + np.repeat(first[own] - ends + counts, counts)
                mine, mine0, theirs, theirs0 = np.repeat(p[own], counts), zero[own[0]], p[at], zero[at]
                wrong = spread(mine, theirs) - spread(mine, theirs0) - spread(mine0, theirs) + spread(mine0, theirs0)
                key = (names[language[own[0]]], int(group[own[0]]))
                row = dense.setdefault(key, np.zeros(int(peers[own[0]]), np.int64))
                np.add.at(row, group[at], wrong)

        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < postings:
                continue
            rows = pa.Table.from_batches(held)
            term, lang = rows.column("term"), rows.column("lang")
            cut = count - 1  # the last term may go on in the next batch
            while cut and term[cut - 1] == term[count - 1] and lang[cut - 1] == lang[count - 1]:
                cut -= 1
            if cut:
                block(rows.slice(0, cut))
            held, count = rows.slice(cut).combine_chunks().to_batches(), count - cut
            if sum(map(len, dense.values())) > cells:
                yield from flush()
        if count:
            block(pa.Table.from_batches(held))
        yield from flush()

    return scatter


def _baselines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, a, b, v as if no two groups shared a term, with the groups' names.

    A row is a group with the histogram of its own shares and all its peers.
    """
    for batch in batches:
        for row in batch.to_pylist():
            peers = sorted(row["peers"], key=lambda x: x["g"])
            zero = np.array([x["zero"] for x in peers], np.int64)
            terms = np.array([x["terms"] for x in peers], np.int64)
            g, n = row["g"], len(peers)
            own = np.zeros(n, np.int64)  # its terms against the peers' zero counts
            for x in row["shares"] or []:
                own += spread(x["p"], zero) * x["times"]
            nowhere = (row["kinds"] - terms[g] - terms) * spread(zero[g], zero)
            names = [x["source"] for x in peers]
            here, there = np.full(n, g, np.int32), np.arange(n, dtype=np.int32)
            for a, b, v, source, item in ((here, there, own + nowhere, [names[g]] * n, names), (there, here, own, names, [names[g]] * n)):
                yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * n), pa.array(a), pa.array(b), pa.array(v), pa.array(source), pa.array(item)], ["lang", "a", "b", "v", "source", "item"])


def source_divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: where each source's terms depart from its peers and its language.

    Part 'pair' has every other source of the language with the summed squared
    difference of shares over the terms that at least ``least_documents``
    documents of the language hold; part 'term' the group's ``top_terms`` terms
    that most exceed the language's share. Null text, lang and source are ''; a
    group without terms has its pairs; ties rank by item. Repeated rows count as
    often as they stand; other columns are ignored; an empty table gives no rows.

    A term's postings and a language's list of groups are as long as it has
    sources; the pairs asked for are as many as the square of that.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.col("text").cast("binary").alias("_t"))
    found = text.mapInArrow(_counter(HELD_TERMS), "lang string, source string, term string, n long, d long")
    counts = found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    postings = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("d").alias("d"), F.collect_list(F.struct("source", "n")).alias("of"))
    index = staged(postings.filter(F.col("d") >= least_documents).drop("d"), "index")

    each = index.select("lang", "term", "all", F.inline("of"))
    own = each.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"))
    whole = index.groupBy("lang").agg(F.sum("all").alias("lang_total"), F.count(F.lit(1)).alias("kinds"))
    groups = text.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0, ["total", "terms", "lang_total", "kinds"])
    in_lang = Window.partitionBy("lang")
    groups = groups.withColumns(
        {
            "g": (F.row_number().over(in_lang.orderBy("source")) - 1).cast("int"),
            "peers": F.count(F.lit(1)).over(in_lang).cast("int"),
            "zero": _share(F.lit(0), F.col("total"), F.col("kinds")),
        }
    )
    groups = staged(groups, "groups")
    shares = join_groups(each, groups, ["lang", "source"]).select(
        "lang", "source", "term", "g", "peers", "zero",
        _share(F.col("n"), F.col("total"), F.col("kinds")).alias("p"),
        _share(F.col("all"), F.col("lang_total"), F.col("kinds")).alias("q"),
    )
    shares = staged(shares, "shares")

    blocks = shares.select("lang", "term", "g", "peers", "p", "zero").repartition(parts, "lang", "term").sortWithinPartitions("lang", "term")
    shared = blocks.mapInArrow(_scatterer(BLOCK_POSTINGS, HELD_CELLS), "lang string, a int, b int, v long")
    # A group's different shares are fewer than twice the root of its words.
    histogram = shares.groupBy("lang", "g", "p").agg(F.count(F.lit(1)).alias("times")).groupBy("lang", "g").agg(F.collect_list(F.struct("p", "times")).alias("shares"))
    peers = groups.groupBy("lang").agg(F.collect_list(F.struct("g", "source", "zero", "terms")).alias("peers"))
    rows = groups.select("lang", "g", "kinds").join(peers, "lang").join(histogram, ["lang", "g"], "left")
    base = rows.mapInArrow(_baselines, "lang string, a int, b int, v long, source string, item string")
    summed = (
        base.unionByName(shared, allowMissingColumns=True)
        .filter("a <> b")
        .groupBy("lang", "a", "b")
        .agg(F.sum("v").alias("value"), F.max("source").alias("source"), F.max("item").alias("item"))
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).cast("int").alias("rank"))

    far = F.expr("(p - q) * (p - q) div (p + q)")
    terms = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), far.alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= top_terms)
    return pairs.unionByName(terms)
