"""The filter audit, the source divergence and the embedding tiles against plain versions."""

import itertools
import math
import random
import re

import numpy as np
import pytest

from tablewright.llm import divergence, embedding_tiles, filter_audit
from tablewright.llm.common import word_lists
from tests.llm.test_operators import CLASH, SCHEMA, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def table(spark, rows, schema=SCHEMA, extra=CLASH + ("part", "mask", "digest", "least", "g", "p", "lang_total", "good", "v", "cid", "tile")):
    df = spark.createDataFrame(rows, schema).repartition(5)
    for c in extra:
        df = df.withColumn(c, df[df.columns[0]])
    return df


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(61)
    common = [words(rng, 250), words(rng, 30), "Go " * 300, "# note " + words(rng, 220), ""]
    out = []
    for i in range(240):
        text = rng.choice(common) if i % 3 == 0 else words(rng, rng.choice([20, 199, 200, 260])).upper() if i % 7 == 0 else words(rng, rng.randint(100, 300)) + " $" * (i % 5 == 0)
        out.append((i, text, rng.choice(["en", "de", None, ""]), "big" if i % 3 else rng.choice(["a", "b", "ü", None, ""]), None))
    out += [(7, common[0], "en", "a", None), (7, common[0], "en", "b", None), (None, common[0], "en", "a", None), (None, None, None, None, None), (500, None, "en", "only", None)]
    out += [(600, "x" * 50_000, "xx", "long", None), (601, "É é\x1cß 李 Ab ab AB " * 3_000, "en", "a", None), (602, "\n\t \x0b", "en", "a", None)]
    return out


@pytest.fixture(scope="module")
def marks():
    rng = random.Random(62)
    out = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 700, 2)]
    return out + [(0, 1, None), (2, None, 1), (None, 1, 1), (9_999, 1, 1)]


def audited(rows, marks):
    """Every order, filter by filter, document by document."""
    ids = {}
    for d, t, *_ in rows:
        if d is not None:
            ids.setdefault(t or "", []).append(d)
    good = {d for d, q, _ in marks if q == 1 and d is not None}
    toxic = {d for d, _, x in marks if x == 1 and d is not None}
    docs = []
    for d, t, _, source, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": re.search(r"[#$%&*|]", t) is not None,
            "E": d is not None and min(ids[t]) < d,
        }
        docs.append((source or "", fails, d in good, d in toxic))
    out = {}
    for part in {p for p, *_ in docs}:
        mine = [x for x in docs if x[0] == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for k, f in enumerate(order):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                share[f] += len(gone)
                failing = [x for x in mine if x[1][f]]
                only = [x for x in failing if sum(x[1].values()) == 1]
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(failing) - len(gone), len(only), sum(x[2] for x in gone), sum(x[3] for x in gone), f]
        for key in [k for k in out if k[0] == part]:
            out[key].insert(6, share[out[key][6]])
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit(spark, rows, marks):
    labels = table(spark, marks, "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(table(spark, rows), labels).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == audited(rows, marks)
    assert len(got) == 600 * len({r[3] or "" for r in rows})


def test_filter_audit_of_nothing(spark, rows, marks):
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(table(spark, rows).limit(0), labels).collect() == []
    got = filter_audit.filter_audit(table(spark, rows), labels.limit(0)).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == audited(rows, [])


def test_order_audit_of_other_filters(spark):
    masks = spark.createDataFrame([("p", 1, 1, 0), ("p", 3, 0, 1), ("p", 0, 1, 1)], "part string, mask int, good int, toxic int")
    got = {(r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.order_audit(masks, "XY").collect()}
    assert got == {
        ("XY", 1): (1, 2, 0, 1, 1, 1, 3, "X"),
        ("XY", 2): (1, 0, 1, 0, 0, 0, 1, "Y"),
        ("YX", 1): (2, 1, 0, 0, 0, 1, 1, "Y"),
        ("YX", 2): (1, 1, 1, 1, 1, 0, 3, "X"),
    }
    with pytest.raises(ValueError):
        filter_audit.order_audit(masks, "ABCDEFG")


def test_word_lists_cut_long_texts():
    rng = random.Random(63)
    text = "".join(rng.choice("ab \n\t\x0bé\x1c") for _ in range(5_000)).encode()
    for piece in (1, 7, 100, 10_000):
        assert [w for part in word_lists(text, piece) for w in part] == text.split()


def diverged(rows, least=10):
    lists = [(lang or "", source or "", [x.translate({c: c + 32 for c in range(65, 91)}) for x in TERM.findall(t or "")]) for _, t, lang, source, _ in rows]
    out = {}
    for lang in {x[0] for x in lists}:
        mine = [x for x in lists if x[0] == lang]
        held = {}
        for _, _, w in mine:
            for term in set(w):
                held[term] = held.get(term, 0) + 1
        kept = sorted(term for term, n in held.items() if n >= least)
        groups = {s: dict.fromkeys(kept, 0) for _, s, _ in mine}
        whole = dict.fromkeys(kept, 0)
        for _, s, w in mine:
            for term in w:
                if term in whole:
                    groups[s][term] += 1
                    whole[term] += 1
        share = lambda c: {x: 1 + 10**9 * (c[x] + 2) // (sum(c.values()) + 2 * len(kept)) for x in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(-sum(f(p[s][x], p[o][x]) for x in kept), o) for o in groups if o != s]
            terms = [(-f(p[s][x], q[x]), x) for x in kept if groups[s][x] and p[s][x] > q[x]]
            for part, found in (("pair", pairs), ("term", terms)):
                for rank, (v, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= 10:
                        out[lang, s, part, item] = (-v, rank)
    return out


@pytest.mark.parametrize("sizes", [(300_000, 200_000, 4_000_000), (5, 7, 3)])
def test_source_divergence(spark, rows, sizes, monkeypatch):
    """In one go, and with workers that hand on every few counts, postings and sums."""
    for name, size in zip(("HELD_TERMS", "BLOCK_POSTINGS", "HELD_CELLS"), sizes):
        monkeypatch.setattr(divergence, name, size)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000 if sizes[0] > 5 else 3)
    try:
        got = divergence.source_divergence(table(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = diverged(rows)
    assert {(r.lang, r.source, r.part, r.item): (r.value, r["rank"]) for r in got} == want and len(got) == len(want)
    assert any(k[2] == "term" for k in want) and any(v[0] for k, v in want.items() if k[2] == "pair")


def test_source_divergence_without_kept_terms(spark, rows):
    few = rows[:8]
    got = {(r.lang, r.source, r.part, r.item): (r.value, r["rank"]) for r in divergence.source_divergence(table(spark, few)).collect()}
    assert got == diverged(few) and all(v == 0 for v, _ in got.values())
    assert divergence.source_divergence(table(spark, rows).limit(0)).collect() == []


def test_shares_beyond_long_arithmetic(spark):
    """Counts whose product with the scale exceeds a long."""
    n, total, kinds = 7 * 10**14 + 3, 10**15 + 1, 10**6
    df = spark.createDataFrame([(n, total, kinds), (0, 0, 0)], "n long, total long, kinds long")
    got = [r[0] for r in df.select(divergence._share(df.n, df.total, df.kinds)).collect()]
    assert got == [1 + 10**9 * (n + 2) // (total + 2 * kinds), 1]


def near(rows, cosine=0.95):
    """vec_id, links and component of each row, all pairs in double precision."""
    ok = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = [0] * len(rows)
    unit = {k: np.array(rows[k][1], float) / np.abs(rows[k][1]).max() for k in ok}
    unit = {k: x / np.linalg.norm(x) for k, x in unit.items()}
    for i, j in itertools.combinations(ok, 2):
        if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
            links[i] += 1
            links[j] += 1
            parent[root(i)] = root(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        least.setdefault(root(k), []).append(d)
    least = {k: min((d for d in ds if d is not None), default=None) for k, ds in least.items()}
    return sorted(((d, links[k], least[root(k)], d == least[root(k)]) for k, (d, _) in enumerate(rows)), key=str)


@pytest.fixture(scope="module")
def vectors():
    """Crowds, a chain, copies and scaled copies, odd values and lengths; a third of the rows in one crowd."""
    rng = np.random.default_rng(64)
    f = lambda x: [float(v) for v in np.float32(x)]
    centre = rng.normal(size=40)
    out = [f(centre + rng.normal(size=40) * 0.12) for _ in range(150)]
    out += [f(rng.normal(size=40)) for _ in range(120)]
    chain = [np.zeros(40)]
    chain[0][0] = 1
    for k in range(25):
        step = chain[-1].copy()
        step[1 + k] += 0.3
        chain.append(step)
    out += [f(x) for x in chain] + [out[200]] * 40 + [f(np.array(out[201]) * 3)] + [out[202][:39], out[202][:39], out[203][:7]]
    out += [None, [], [0.0] * 40, [float("nan")] + [1.0] * 39, [float("inf")] * 40, [None] + [1.0] * 39, [1e-30] * 40, [2e30] * 40, [-0.0] * 39 + [1.0], [0.0] * 39 + [1.0]]
    ids = rng.permutation(len(out)).tolist()
    rows = list(zip(ids, out))
    return rows + [(None, out[204]), (None, out[205]), (None, out[205]), (3, out[206]), (3, out[207]), (3, out[206])]


@pytest.mark.parametrize("sizes", [(32_768, 1_024, 1_024), (16, 8, 2)])
def test_embedding_tiles(spark, vectors, sizes, monkeypatch):
    """In one tile, and in many whose blocks are cut small."""
    for name, size in zip(("TILE", "BLOCK", "TILES"), sizes):
        monkeypatch.setattr(embedding_tiles, name, size)
    got = embedding_tiles.near_embeddings(table(spark, vectors, "vec_id long, embedding array<float>")).collect()
    assert sorted(map(tuple, got), key=str) == near(vectors)


def test_embedding_tiles_of_nothing(spark, vectors):
    schema = "vec_id long, embedding array<double>, label int"
    assert embedding_tiles.near_embeddings(spark.createDataFrame([], schema)).collect() == []
    got = embedding_tiles.near_embeddings(spark.createDataFrame([(1, None, 0), (2, [0.0], 0)], schema)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, True), (2, 0, 2, True)]
    wide = [(k, [1e200, 1e200 * (1 + k)], 0) for k in range(3)]
    got = embedding_tiles.near_embeddings(spark.createDataFrame(wide, schema), 0.94).collect()
    assert sorted(map(tuple, got)) == near([r[:2] for r in wide], 0.94)


def test_tile_links_at_the_threshold():
    """Pairs at the threshold, just above and just below, in crowded and in thin blocks."""
    rng = np.random.default_rng(65)
    x = rng.normal(size=(300, 48))
    x[150:] = x[:150] + rng.normal(size=(150, 48)) * 0.33
    x[:40] = x[0] + rng.normal(size=(40, 48)) * 0.2
    axes = np.linalg.qr(rng.normal(size=(48, 48)))[0]
    u = embedding_tiles._unit(x)
    exact = (u[:, None, :] * u[None]).sum(axis=2)
    for cosine in (0.95, float(exact[0, 1]), float(np.nextafter(exact[0, 1], 2)), float(exact[60, 210])):
        got = {(int(a), int(b)) for i, j in embedding_tiles.tile_links(x, x, axes, cosine, True) for a, b in zip(i, j)}
        i, j = np.nonzero(np.triu(exact >= cosine, 1))
        assert got == set(zip(i.tolist(), j.tolist()))
        across = {(int(a), int(b)) for i, j in embedding_tiles.tile_links(x[:150], x[150:], axes, cosine, False) for a, b in zip(i, j)}
        assert across == {(a, b - 150) for a, b in got if a < 150 <= b}
