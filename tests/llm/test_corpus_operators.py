"""URL rules, near-duplicates, nearest neighbours, language model, pipeline: brute force and edges."""

import math
import os
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lagcast.llm import maxent_lm
from lagcast.llm.components import components
from lagcast.llm.maxent_lm import count_words, fit_maxent, frequent, score_documents
from lagcast.llm.multi_index import Codes, Index, nearest, unit
from lagcast.llm.near_duplicates import banding, near_duplicates, super_minhash
from lagcast.llm.url_filter import judge_urls
from lagcast.session import shared_dir

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


# --- URL rules ----------------------------------------------------------------


def slow_verdict(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    best = None
    for action, rule in rules:
        own, slash, tail = rule.partition("/")
        fits = (host == own or host.endswith("." + own)) and path.startswith(slash + tail)
        if fits and (best is None or (len(rule), action == "block") > (len(best[1]), best[0] == "block")):
            best = (action, rule)
    return host, path, best and best[1], best[0] if best else "allow"


@pytest.mark.parametrize("shard_bytes", [1 << 20, 200])
def test_urls_equal_trying_every_rule(spark, shard_bytes):
    rng = random.Random(1)
    labels, parts = ["a", "b", "com", "org"], ["x", "xy", "xyz", ""]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 3)))
    path = lambda: "".join("/" + rng.choice(parts) for _ in range(rng.randint(0, 3)))
    rules = list({r: (rng.choice(["allow", "block"]), r) for r in (host() + path() for _ in range(40))}.values())
    rows = [f"{rng.choice(['http', ''])}://{host().upper()}{path()}{rng.choice(['', '?q=/x', '#a://b'])}" for _ in range(300)]
    rows += [None, "", "no scheme/x", "://", "http://", "http://x.com://y", rows[0], rows[0]]
    df = spark.createDataFrame([(k, u, "c", "c") for k, u in enumerate(rows)], "page_id long, url string, Host string, verdict string")
    got = judge_urls(df, rules, shard_bytes=shard_bytes)
    assert [c.lower() for c in got.columns].count("host") == 1
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert found == {k: slow_verdict(u, rules) for k, u in enumerate(rows)}
    assert judge_urls(df.limit(0), rules).count() == 0


# --- near-duplicates ----------------------------------------------------------


def slow_groups(rows, width, percent):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    least = {}
    for (key, _), g, s in zip(rows, group, sets):
        if key is not None:
            least[g] = min(key, least.get(g, key))
    return Counter((k, len(s), least.get(g) if s else k) for (k, _), g, s in zip(rows, group, sets))


def test_groups_equal_comparing_all(spark, edge_docs):
    """A large group of chained edits whose pivot does not reach all, exact copies, and edges."""
    rng = random.Random(5)
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    for k in range(120):
        text = list(base)
        for _ in range(rng.randrange(0, 9)):
            text[rng.randrange(80)] = f"e{rng.randrange(10**6)}"
        rows.append((1000 + k, " ".join(text)))
    chain = list(base[::-1])
    for k in range(30):
        chain[k] = f"c{k}"
        rows.append((3000 - k, " ".join(chain)))
    rows += [(4000 + k, "same short text") for k in range(40)] + [(5000 + k, f"x{k} y{k} z{k} v w") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for width, percent in ((3, 85), (5, 80)):
        got = near_duplicates(docs.withColumn("node", F.lit("clash")), width=width, percent=percent).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == slow_groups(rows, width, percent)
        assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_links_run_through_a_row_without_an_id(spark):
    base = [f"w{k}" for k in range(200)]
    text = lambda *changed: " ".join(f"x{k}" if k in changed else w for k, w in enumerate(base))
    rows = [(5, text()), (None, text(50, 100)), (9, text(50, 100, 140, 180)), (12, text(50, 100, 20, 160, 5))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == slow_groups(rows, 3, 85)
    assert {r.doc_id: r.component_id for r in got}[9] == 5


def test_only_lasting_tables_stay(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(words[:k] + [f"x{k}"] + words[k + 1 :])) for k in range(40)]
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85)
    left = set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before
    assert sorted(x.split("-")[0] for x in left) == ["found", "signatures"]
    assert found.where("kept").count() == 1


def test_no_documents_no_groups(no_docs):
    assert near_duplicates(no_docs).count() == 0


def test_signatures_estimate_similarity():
    rng, errors = np.random.default_rng(2), []
    for _ in range(40):
        shared, own = rng.integers(0, 1 << 63, 400, dtype=np.uint64), rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        both = np.concatenate([shared, own[:50], shared, own[50:]])
        a, b = super_minhash(both, np.array([0, 450, 900]), 120)
        errors.append((a == b).mean() - 400 / 500)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    for percent in (80, 85):
        bands, rows = banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 1e-6


def test_components_of_a_long_path(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(3000) if k % 500 != 499] + [(5000, 5000), (None, 4)]
    rng.shuffle(edges)
    found = components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.label, set()).add(r.node)
    assert sorted(map(len, groups.values())) == [1, *[500] * 6]


def test_components_of_forests_that_are_given_out(spark):
    """Tasks hold far fewer nodes than they meet; a star's centre comes in all of them."""
    edges = [(0, k) for k in range(1, 4000)] + [(k, k + 1) for k in range(5000, 9000)] + [(1, 1)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        found = components(spark.createDataFrame(edges, "a long, b long").repartition(3, "a"), held_nodes=300)
        groups = Counter(r.label for r in found.collect())
        assert sorted(groups.values()) == [4000, 4001] and found.count() == 8001
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# --- nearest neighbours -------------------------------------------------------


def test_radius_search_is_exact():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    index = Index(codes)
    for radius in (0, 3, 8, 17, 22, 27, 40, 64):
        want = np.flatnonzero(np.bitwise_count(codes ^ codes[7]) <= radius)
        assert index.within(codes[7], radius).tolist() == want.tolist()


@pytest.mark.parametrize("dimension", [8, 64, 100])
def test_neighbours_recall(spark, dimension):
    rng = np.random.default_rng(dimension)
    vectors = rng.normal(size=(1500, dimension)).astype(np.float32)
    vectors[600:1100] = vectors[600]  # a third are one vector
    vectors[1100:1200] = vectors[700] + rng.normal(size=(100, dimension)) * 0.01
    rows = [(k, v.tolist(), 1) for k, v in enumerate(vectors)]
    odd = [[], None, [0.0] * dimension, [None] * dimension, [math.nan] * dimension, [math.inf] * dimension, [1.0]]
    rows += [(2000 + 50 * k, v, 1) for k, v in enumerate(odd)] + [(None, vectors[3].tolist(), 1), (3, vectors[3].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = nearest(df, lambda k: k % 50 == 0).collect()
    wide = vectors.astype(float)
    hits = total = 0
    for q in range(0, 1500, 50):
        score = (wide * wide[q]).sum(axis=1) / (np.sqrt((wide * wide).sum(axis=1)) * np.sqrt((wide[q] ** 2).sum()))
        score[q] = -2
        best = np.lexsort((np.arange(1500), -score.round(12)))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - score[r.vec_id]) < 1e-12 for r in mine)
        hits, total = hits + len(set(best) & {r.vec_id for r in mine}), total + 5
        if 600 <= q < 1100:
            assert [r.vec_id for r in mine] == best.tolist()
    assert hits >= 0.95 * total and {r.query_id for r in got} == set(range(0, 1500, 50))


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [-1.0, 1e-300])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in nearest(df, lambda k: k == 0).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 2)]
    assert nearest(df.limit(0), lambda k: k == 0).count() == 0
    assert nearest(df.limit(1), lambda k: k == 0).count() == 0
    assert Codes(unit(np.eye(3)), 5).radius <= 64


# --- language model -----------------------------------------------------------


def test_language_model(spark, edge_docs, no_docs):
    rng = random.Random(6)
    stock = {k: [f"{k}{n}" for n in range(60)] for k in "abc"}
    made = [(100 + n, " ".join(rng.choice(stock["abc"[n % 3]]) for _ in range(80))) for n in range(400)]
    docs = spark.createDataFrame(made, "doc_id long, text string").unionByName(edge_docs.select("doc_id", "text"))
    train = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)
    words = count_words(train).cache()
    counts = frequent(words)
    model = fit_maxent(train, counts)
    rows = score_documents(docs.withColumn("row", F.lit("clash")), model, counts, words).collect()
    seen = Counter()
    for r in docs.collect():
        if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            seen.update([*words_of(r.text), None])
    total, kinds = sum(seen.values()), len(seen)
    want = Counter()
    for r in docs.collect():
        tokens = [*words_of(r.text), None]
        base = sum(math.log10((seen[t] + 1) / (total + kinds + 1)) for t in tokens)
        want[r.doc_id, len(tokens), sum(seen[t] > 0 for t in tokens), total, round(base, 5)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == want
    held = [r for r in rows if r.doc_id and r.doc_id >= 100 and zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert score_documents(no_docs, model, counts, words).count() == 0
    none = frequent(count_words(no_docs))
    untrained = fit_maxent(no_docs, none)
    for r in score_documents(edge_docs, untrained, none, count_words(no_docs)).collect():
        assert r.base_score == r.score == 0 and r.n_known == 0


def test_context_decides_among_words_without_a_class(spark, monkeypatch):
    """The same rare words, in pairs that the training text has and in pairs that it has not."""
    rng = random.Random(8)
    common = [f"c{k}" for k in range(maxent_lm.VOCABULARY)]
    line = lambda pairs: " ".join(f"a{i} b{j}" for i, j in pairs)
    made = [(k, " ".join(rng.sample(common, 400))) for k in range(800)]
    made += [(1000 + k, line((i, i) for i in rng.sample(range(200), 30))) for k in range(600)]
    train = spark.createDataFrame(made, "doc_id long, text string").repartition(2).cache()
    words = count_words(train).cache()
    counts = frequent(words)
    picked = rng.sample(range(200), 100)
    for head in (len(counts.words), maxent_lm.VOCABULARY):  # the others are joined
        counts.words, counts.counts = counts.words[:head], counts.counts[:head]
        counts.__dict__.pop("_index", None)
        model = fit_maxent(train, counts)
        ends = [(1, line(zip(picked, picked))), (2, line(zip(picked, picked[1:] + picked[:1]))), (3, "never seen")]
        scored = score_documents(spark.createDataFrame(ends, "doc_id long, text string"), model, counts, words).collect()
        found = {r.doc_id: r for r in scored}
        assert abs(found[1].base_score - found[2].base_score) < 1e-6
        assert found[1].score - found[2].score > 5
        assert found[3].n_known == 1 and math.isfinite(found[3].score)


def test_probabilities_sum_to_one(spark):
    """Of all counted words and the unseen mass, in contexts of frequent, rare and unseen words."""
    rng = random.Random(2)
    stock = [f"v{k}" for k in range(2500)]
    made = [(k, " ".join(stock[min(int(rng.paretovariate(0.2)) - 1, rng.randrange(2500))] for _ in range(60))) for k in range(300)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    words = count_words(docs).cache()
    counts = frequent(words)
    assert counts.kinds > maxent_lm.VOCABULARY
    known = sorted({w for _, t in made for w in t.split()})
    model = fit_maxent(docs, counts)
    for context in ("v0 v1", f"v3 {known[-1]}", "unseen words"):
        tokens = maxent_lm.Tokens(maxent_lm.Texts.of(pa.array([context, *(f"{context} {w}" for w in known)])))
        ranks = counts.find(tokens.hashes)
        logs, more = maxent_lm.score_block(model, tokens, ranks)
        at = tokens.bounds[:-1] + 2  # the word behind the context, or the end
        n = counts.counts[ranks[at]]
        logs = logs[at] + np.where(ranks[at] >= model.size, more[at] + np.log10(n + 1.0), 0)
        lone = maxent_lm.Tokens(maxent_lm.Texts.of(pa.array([f"{context} never"])))
        rare, _ = maxent_lm.score_block(model, lone, counts.find(lone.hashes))
        assert abs((10**logs).sum() + 10 ** rare[2] / model.rare_mass - 1) < 1e-3


def test_scores_do_not_depend_on_partitions(spark):
    rng = random.Random(9)
    made = [(k, " ".join(f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(80))) for k in range(300)]
    found = []
    for parts in (1, 16):
        docs = spark.createDataFrame(made, "doc_id long, text string").repartition(parts)
        words = count_words(docs).cache()
        counts = frequent(words)
        model = fit_maxent(docs, counts, spread=F.xxhash64("doc_id"), shard_tokens=2000)
        found.append({r.doc_id: r.score for r in score_documents(docs, model, counts, words).collect()})
    assert max(abs(found[0][k] - found[1][k]) for k in found[0]) < 1e-3


def test_untrained_tree_equals_the_unigram_model(spark):
    rows = [(k, " ".join(f"w{(k * 37 + j * j) % 5000}" for j in range(300))) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = count_words(docs).cache()
    counts = frequent(words)
    assert counts.kinds > maxent_lm.VOCABULARY
    ends = docs.limit(20).unionByName(spark.createDataFrame([(-1, "unseen words w1")], "doc_id long, text string"))
    for r in score_documents(ends, maxent_lm.MaxentModel(counts), counts, words).collect():
        assert abs(r.score - r.base_score) < 1e-2


# --- pipeline -----------------------------------------------------------------


def test_stages_keep_columns_and_filter(spark, folder, edge_docs, no_docs):
    given = Counter(edge_docs.collect())
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, edge_docs, folder)
        assert kept.columns == edge_docs.columns, name
        assert not Counter(kept.collect()) - given, name
        assert stage(spark, no_docs, folder).count() == 0, name
    once = corpus_pipeline.near_dedup(spark, edge_docs, folder).collect()
    texts = [r.doc_id for r in once if r.doc_id is not None]
    assert sorted(texts) == [1, 3, 4, 5, 6, 8, 9, 10]
    packed = corpus_pipeline.packing(spark, edge_docs, folder)
    assert packed.where("doc_id = 3").count() == 1 and corpus_pipeline.packing(spark, no_docs, folder).count() == 0


def test_near_dedup_judges_rows_with_one_id_each_by_its_text(spark, folder):
    copied = " ".join(f"w{k}" for k in range(40))
    rows = [(1, copied), (7, copied + " more"), (7, "a text of its own that nobody else has"), (7, "and another one"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, corpus_pipeline.near_dedup(spark, docs, folder).collect())) == Counter([rows[0], *rows[2:]])


def test_text_stages_take_bounded_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield batch.append_column("n", pa.array([batch.num_rows] * batch.num_rows, pa.int32()))

    docs = spark.range(2500).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.lit(1).alias("n")).coalesce(1)
    judge = lambda df: df.mapInArrow(sizes, "row struct<doc_id: long, text: string, n: int>, text string, n int")
    kept = corpus_pipeline._decided(docs, judge, "n <= 1000")
    assert kept.columns == docs.columns and kept.count() == 2500
