"""Compression bands, quality classifier, language identification: counts, verdicts, accuracy."""

import base64
import random
import re
import string
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from lagcast.llm import compression_bands as compression_bands_module
from lagcast.llm import language_id, quality_classifier
from lagcast.llm.arrays import Texts
from lagcast.llm.compression_bands import compression_bands, fit_bands, text_counts
from lagcast.llm.folds import is_fold
from lagcast.llm.language_id import LanguageModel, codewords, fit_languages, identify_language
from lagcast.llm.quality_classifier import CompressionModel, fit_quality, score_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts_of(values):
    import pyarrow as pa

    return Texts.of(pa.array(values, pa.string()))


def slow_counts(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return [len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#é 你\x1c\x85", max_size=60), max_size=8))
def test_counts_equal_a_slow_count(values):
    found = text_counts(texts_of(values))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [[int(found[n][k]) for n in names] for k in range(len(values))] == [slow_counts(v) for v in values]


def words(rng, n, stock):
    return " ".join(rng.choice(stock) for _ in range(n))


@pytest.fixture(scope="module")
def stock():
    rng = random.Random(3)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(3000)]


def test_bands_reject_repetition_and_noise(spark, stock):
    rng = random.Random(1)
    noise = "".join(chr(rng.randint(0x4E00, 0x9FFF)) + (" " if k % 9 == 0 else "") for k in range(6000))
    near = [" ".join(["same words again", str(k % 4), "and more"]) for k in range(300)]
    rows = [(1, words(rng, 400, stock)), (2, words(rng, 6000, stock)), (3, noise), (4, "\n".join(near)), (5, words(rng, 49, stock))]
    kept = {r.doc_id: r.kept for r in compression_bands(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1: True, 2: True, 3: False, 4: False, 5: False}


def test_bands_judge_every_part_of_a_text(spark, stock):
    rng = random.Random(9)
    prose = words(rng, 3000, stock)
    noise = base64.b64encode(rng.randbytes(3000)).decode()
    rows = [(1, prose[:4096] + noise), (2, prose[:8096]), (3, prose[:1500] + noise[:1500]), (4, prose[:3000])]
    rows += [(5, prose[:8192] + noise), (6, prose[:12192])]
    found = compression_bands(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.kept for r in found} == {1: False, 2: True, 3: False, 4: True, 5: False, 6: True}
    assert all(r.odd_chunks == 0 for r in found if r.kept)


def slow_verdict(text, bands, chunk_bands):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    repeated = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    if len(words) < 50 or 100 * len(repeated) > 50 * len(words):
        return False
    content, compress = text.encode(), zstandard.ZstdCompressor(level=3).compress
    limits = lambda size, table: [b for b in table if b[0] <= size][-1][1:]
    low, high = limits(len(content), bands)
    odd = set()
    for width in (4096, 1024, 256):
        if len(content) >= 2 * width:
            for at in [*range(0, len(content) - width, width // 2), len(content) - width]:
                least, most = limits(width, chunk_bands)
                if not least <= len(compress(content[at : at + width])) / width <= most:
                    odd.update(range(at, at + width))
            break
    return low <= len(compress(content)) / len(content) <= high and len(odd) <= 0.25 * len(content)


def test_fitted_bands_equal_judging_by_hand(spark):
    rng = random.Random(12)
    syllables = ["ta", "ri", "mon", "del", "ver", "si", "ka", "no", "pra", "lu"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows = [(k, " ".join(word() for _ in range(rng.choice([60, 65, 450, 1500])))[:rng.choice([2600, 9999])]) for k in range(400)]
    rows += [(1000 + k, " ".join(f"{word()}{rng.choice(['###', '$$$', '%%%'])}" for _ in range(400))[:2600]) for k in range(15)]
    rows += [(2000 + k, " ".join("".join(rng.choices(string.ascii_letters + string.digits, k=8)) for _ in range(400))[:2600]) for k in range(15)]
    rows += [(3000, rows[0][1])] * 300 + [(3001, None), (3002, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("rank", "width", "ratio")})
    bands, of_chunks = fit_bands(docs.repartition(4))
    assert (bands, of_chunks) == fit_bands(docs.repartition(1))
    found = compression_bands(docs, bands=bands, chunk_bands=of_chunks).collect()
    assert Counter((r.doc_id, r.kept) for r in found) == Counter((k, slow_verdict(t or "", bands, of_chunks)) for k, t in rows)
    kept = {r.doc_id: r.kept for r in found}
    assert not any(kept[k] for k in kept if 2000 <= k < 3000) and sum(kept[k] for k in range(400)) >= 396
    assert [b[1:] for b in fit_bands(docs.limit(0))[0]][0] == compression_bands_module.BANDS[0][1:]


def test_bands_are_fitted_in_bounded_batches(spark, monkeypatch):
    setting, used, settle = "spark.sql.execution.arrow.maxRecordsPerBatch", [], compression_bands_module.settled
    before = spark.conf.get(setting)
    monkeypatch.setattr(compression_bands_module, "settled", lambda df: used.append(int(spark.conf.get(setting))) or settle(df))
    fit_bands(spark.createDataFrame([("some text",)], "text string"))
    assert used and max(used) <= 1000 and spark.conf.get(setting) == before


def test_bands_are_fitted_to_every_text_and_chunk(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9)))
    texts = [" ".join(word() for _ in range(rng.choice([60, 400])))[:1500] for _ in range(21_000)]
    texts += texts[:50]  # copies count once
    fitted, of_chunks = fit_bands(spark.createDataFrame([(t,) for t in texts], "text string").repartition(7))
    whole, pieces, compress = {}, {}, zstandard.ZstdCompressor(level=3).compress
    for content in {t.encode() for t in texts}:
        if len(content) >= 256:
            step = int(np.floor(np.log2(len(content) / 256) * 4))
            whole.setdefault(int(np.ceil(256 * 2 ** (step / 4))), []).append(len(compress(content)) / len(content))
            width, _, found = compression_bands_module.chunk_ratios(memoryview(content), compress, 4096)
            pieces.setdefault(width, []).extend(found)
    assert sum(map(len, whole.values())) > 20_000
    for limits, measured in ((fitted, whole), (of_chunks, pieces)):
        decided = [b for b in limits if len(measured.get(b[0], [])) >= 40]
        assert decided
        for least, low, high in decided:
            q = np.quantile(measured[least], [0.25, 0.5, 0.75])
            reach = 4.5 * max((q[2] - q[0]) / 1.349, 0.005)
            assert (low, high) == pytest.approx((q[1] - reach, q[1] + reach), abs=1e-12)


def test_bands_on_edges(edge_docs, no_docs):
    found = compression_bands(edge_docs)
    rows = found.collect()
    assert len(rows) == edge_docs.count() and found.columns.count("kept") == 1 and "host" in found.columns
    assert all(not r.kept for r in rows if not (r.text or "").strip())
    assert [r.n_words for r in rows if r.doc_id == 6] == [40_000]
    assert compression_bands(no_docs).count() == 0


def test_quality_separates_held_out_documents(spark, stock):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(600):
        good = rng.random() < 0.7
        text = words(rng, rng.randint(40, 200), stock)
        rows.append((k, text if good else text.upper().replace(" ", "!! ")))
        labels.append((k, int(good)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = fit_quality(docs, marks.where(~is_fold("doc_id", 5, 0)), label="quality")
    scored = score_quality(docs, model).where(is_fold("doc_id", 5, 0)).collect()
    truth = dict(labels)
    assert len(scored) > 80 and all(r.predicted == truth[r.doc_id] and 0 <= r.score <= 1 for r in scored)


def test_bounded_sample_keeps_the_share_of_good_ones(spark, stock, monkeypatch):
    rng = random.Random(10)
    rows = [(k, words(rng, 60, stock), int(rng.random() < 0.9)) for k in range(1500)]  # labels say nothing about texts
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    monkeypatch.setattr(quality_classifier, "SAMPLE_DOCS", 150)
    model = fit_quality(docs, docs.select("doc_id", "quality"), label="quality")
    scores = [r.score for r in score_quality(docs.limit(300), model).collect()]
    assert abs(sum(scores) / len(scores) - model.prior) < 0.07


def test_quality_on_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (6, 0), (None, 1), (7, None), (99, 1)], "doc_id long, quality int")
    model = fit_quality(edge_docs, labels, label="quality")
    found = score_quality(edge_docs, model)
    rows = found.collect()
    assert len(rows) == edge_docs.count() and found.columns.count("score") == 1
    assert {r.score for r in rows if not r.text} == {model.prior} and all(0 <= r.score <= 1 for r in rows)
    empty = fit_quality(no_docs, labels.limit(0), label="quality")
    assert isinstance(empty, CompressionModel) and score_quality(edge_docs, empty).where("score <> 0.5").count() == 0
    assert score_quality(no_docs, model).count() == 0


def test_codewords_are_apart():
    for n in (2, 4, 30):
        code = codewords(n)
        distance = (code[:, None] != code[None]).sum(axis=2)
        assert min(distance[i, j] for i in range(n) for j in range(n) if i != j) >= 3
        assert (abs(code.sum(axis=0)) < n).all()


def test_languages_of_held_out_texts(spark):
    rng = random.Random(4)
    syllables = {"xx": ["ka", "to", "ri", "mu"], "yy": ["sch", "pfe", "gla", "nde"], "zz": ["éa", "ou", "xî", "el"]}
    rows = [
        (k, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(rng.randint(5, 60))), lang)
        for k, lang in enumerate(rng.choice(list(syllables)) for _ in range(500))
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_languages(docs.where(~is_fold("doc_id", 3, 1)))
    found = identify_language(docs.drop("lang"), model).where(is_fold("doc_id", 3, 1)).collect()
    truth = {k: lang for k, _, lang in rows}
    assert sum(r.lang_pred == truth[r.doc_id] for r in found) >= 0.99 * len(found) > 100


def test_rare_language_of_short_texts_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_CHUNKS", 60)
    rng = random.Random(7)
    syllables = {"xx": ["ka", "to", "ri", "mu"], "yy": ["sch", "pfe", "gla", "nde"], "zz": ["жа", "по", "ли", "ру"]}
    text = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(n))
    rows = [(k, text(lang, n), lang) for k, (lang, n) in enumerate([("xx", 3000), ("yy", 3000)] * 40 + [("zz", 6)] * 40)]
    model = fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(k, text("zz", 8)) for k in range(50)], "doc_id long, text string")
    assert sum(r.lang_pred == "zz" for r in identify_language(asked, model).collect()) >= 49


def test_languages_on_edges(edge_docs, no_docs):
    model = fit_languages(edge_docs)
    found = identify_language(edge_docs, model).collect()
    assert len(found) == edge_docs.count()
    for r in found:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    nothing = fit_languages(no_docs)
    assert isinstance(nothing, LanguageModel) and not nothing.languages
    assert {r.lang_pred for r in identify_language(edge_docs, nothing).collect()} == {"und"}
    assert identify_language(no_docs, model).count() == 0


def test_shards_of_chunks_are_trained_apart(spark, monkeypatch):
    """Classifiers averaged over many shards tell the languages of texts they have not seen."""
    monkeypatch.setattr(language_id, "SHARD_CHUNKS", 50)
    words = {"xx": "alpha beta gamma delta", "yy": "uno dos tres cuatro", "zz": "ich du wir sie"}
    rows = [(k, " ".join(w.split()[(k * j) % 4] for j in range(1, 60)), lang) for lang, w in words.items() for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_languages(docs.where("doc_id < 60"))
    found = identify_language(docs.where("doc_id >= 60"), model).collect()
    assert len(found) == 90 and all(r.lang_pred == r.lang for r in found)
