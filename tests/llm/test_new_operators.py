"""Source divergence, toxicity, vector codes: brute force, held-out rows, edges."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagcast.llm import source_divergence as divergence
from lagcast.llm.source_divergence import source_divergence
from lagcast.llm.toxicity import fit_toxicity, score_toxicity
from lagcast.llm.vector_codes import BOUND, PARTS, Trie, compress_vectors, encode_vectors, fit_codebooks

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- source divergence --------------------------------------------------------


def slow_divergence(rows, least, best):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        mine = {s: {t: c[t] for t in kept} for (of, s), c in groups.items() if of == lang}
        whole = {t: sum(c[t] for c in mine.values()) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in mine.items()}, share(whole)
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in mine:
            pairs = [("pair", o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in mine if o != s]
            terms = [("term", t, gap(p[s][t], q[t])) for t in kept if mine[s][t] > 0 and p[s][t] > q[t]]
            for found, limit in ((pairs, len(pairs)), (terms, best)):
                found.sort(key=lambda f: (-f[2], f[1].encode()))
                out += [(lang, s, *f, k) for k, f in enumerate(found[:limit], 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_divergence_equals_counting_by_hand(spark, edge_docs, monkeypatch, small):
    """``small``: many shards, and blocks of few sources and terms."""
    if small:
        for name, value in (("SHARD_ROWS", 9), ("SOURCES", 2), ("TERMS", 3)):
            monkeypatch.setattr(divergence, name, value)
    rng = random.Random(4)
    words = ["Alpha", "beta", "straße", "Él", "x", "日本", "zz", "don't", "a-b"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(r.text, r.lang, r.source) for r in edge_docs.collect()]
    for k in range(150):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "é", None])
        rows.append((" ".join(rng.choices(words, k=rng.randrange(12))), lang, source))
    rows += [("alone words", "fr", "only"), ("123 $$", "fr", "none"), ("", "xx", "one")] + [rows[-1]] * 3
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    docs = docs.withColumns({c: F.lit("clash") for c in ("term", "part", "item", "shard", "n", "docs", "of", "by")})
    got = source_divergence(docs, least=4, best=3).collect()
    found = [(r.lang, r["source"], r.part, r.item, r.value, r["rank"]) for r in got]
    assert sorted(found) == slow_divergence(rows, 4, 3)


def test_no_documents_no_divergence(no_docs):
    assert source_divergence(no_docs).count() == 0


def test_shares_are_exact_for_large_counts():
    counts = np.array([0, 1, 10**14, 4 * 10**15], dtype=np.int64)
    total = np.int64(4 * 10**15)
    want = [1 + 10**9 * (int(c) + 2) // (int(total) + 2 * 7) for c in counts]
    assert divergence.share(counts, total, 7).tolist() == want


# --- toxicity -----------------------------------------------------------------


def speech(rng, toxic, stems=("grumph", "vlastic", "krobel")):
    text = [f"{rng.choice('bdfglmnprst')}{rng.choice('aeiou')}{rng.choice('bdfglmnprst')}{rng.choice('aeiou')}" for _ in range(60)]
    if toxic:
        for _ in range(2):
            text[rng.randrange(60)] = rng.choice(stems) + rng.choice(["", "s", "ing", "er"])
    return " ".join(text)


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(8)
    rows = [(k, speech(rng, k % 4 == 0), int(k % 4 == 0)) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (3, 1), (7, None)], "doc_id long, toxic int"))
    return rng, fit_toxicity(df.select("doc_id", "text"), labels, label="toxic")


def test_unseen_and_misspelt_words_are_found(spark, judged):
    rng, model = judged
    rows = [(k, speech(rng, k % 2 == 0, ("grumphz", "vlasticx", "xkrobel")), k % 2) for k in range(200)]
    rows.append((200, speech(rng, False) + " krobelish " + speech(rng, False), 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, clean int")
    got = score_toxicity(df, model).collect()
    assert sum(r.predicted != 1 - r.clean for r in got) <= 4
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)


def test_toxicity_of_edges(edge_docs, no_docs, judged):
    _, model = judged
    got = score_toxicity(edge_docs, model).collect()
    assert [c.lower() for c in score_toxicity(edge_docs, model).columns].count("score") == 1
    assert len(got) == edge_docs.count()
    empty = {r.score for r in got if not (r.text or "").strip()}
    assert empty == {round(model.prior, 12)}
    same = {r.score for r in got if r.text and r.text.startswith("the quick")}
    assert len(same) == 1
    assert score_toxicity(no_docs, model).count() == 0


def test_toxicity_without_labels(edge_docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in score_toxicity(edge_docs, fit_toxicity(edge_docs, none, label="toxic")).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert {r.score for r in score_toxicity(edge_docs, fit_toxicity(edge_docs, one, label="toxic")).collect()} == {1.0}


# --- vector codes -------------------------------------------------------------


def slow_codes(rows):
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    width = -(-max(len(v) for _, v, _ in kept) // PARTS)
    whole = []
    for key, v, label in kept:
        numbers = [max(-BOUND, min(BOUND, int(np.floor(256 * float(np.float32(x)))))) for x in v]
        numbers += [0] * (PARTS * width - len(numbers))
        whole.append((key, v, label, [numbers[p * width : (p + 1) * width] for p in range(PARTS)]))
    first = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:64]
    books = [[list(r[3][p]) for r in first] for p in range(PARTS)]

    def assign():
        out = []
        for _, _, _, parts in whole:
            near = [min((sum((a - b) ** 2 for a, b in zip(parts[p], e)), k) for k, e in enumerate(books[p])) for p in range(PARTS)]
            out.append(near)
        return out

    for _ in range(2):
        taken = defaultdict(list)
        for (_, _, _, parts), near in zip(whole, assign()):
            for p in range(PARTS):
                taken[p, near[p][1]].append(parts[p])
        for (p, e), members in taken.items():
            books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    final, by_label = assign(), Counter()
    for (_, _, label, _), near in zip(whole, final):
        by_label[label] += sum(d for d, _ in near)
    digest = hashlib.sha256(",".join(str(x) for part in books for e in part for x in e).encode()).hexdigest()
    return Counter(
        (key, "".join(f"{e:02x}" for _, e in near), sum(d for d, _ in near), by_label[label], digest)
        for (key, _, label, _), near in zip(whole, final)
    )


def vectors(n, size, rng):
    return [(k, [rng.choice([-1, 1]) * rng.randrange(40) / 100 for _ in range(size)], rng.choice([0, 1, None])) for k in range(n)]


@pytest.mark.parametrize("n,size", [(150, 32), (20, 16), (90, 37), (70, 0)])
def test_codes_equal_brute_force(spark, n, size):
    rng = random.Random(n)
    rows = vectors(n, size, rng)
    rows += [rows[0], rows[0], (rows[1][0], rows[2][1], 0), (None, rows[3][1], 1)]
    if size:
        rows += [(900, None, 0), (901, [float("nan")] * size, 0), (902, [None] + [0.0] * (size - 1), 0), (903, [float("inf")] * size, 1)]
        rows += [(904, [0.5] * (size // 2), 1), (905, [1e30] + [-0.001] * (size - 1), None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    df = df.withColumns({c: F.lit("clash") for c in ("code", "error", "key", "vector", "of", "part", "n", "s0")})
    got = compress_vectors(df).collect()
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == slow_codes(rows)


def test_trie_of_parts(spark):
    rng = np.random.default_rng(5)
    rows, entries = rng.integers(-3, 4, (5000, 5)), rng.integers(-3, 4, (64, 5))
    trie = Trie(rows)
    index, distance = trie.nearest(entries)
    gaps = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index[trie.leaf] == gaps.argmin(axis=1)).all() and (distance[trie.leaf] == gaps.min(axis=1)).all()
    assert len(trie.rows) == len(np.unique(rows, axis=0)) and len(trie.values[0]) <= 7
    counts, totals = trie.sums(index, 64)
    assert (counts == np.bincount(gaps.argmin(axis=1), minlength=64)).all()
    assert (totals.sum(axis=0) == rows.sum(axis=0)).all()


def test_no_vectors_no_codes(spark):
    none = spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")
    assert compress_vectors(none).count() == 0 and compress_vectors(none.limit(0)).count() == 0
    books = fit_codebooks(none)
    assert encode_vectors(none, books).count() == 0
