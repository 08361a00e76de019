"""Pre-tokens, byte-level BPE, packing and sequence files against the libraries and by round trips."""

import base64
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lagcast.llm import pretokens
from lagcast.llm.arrays import Texts
from lagcast.llm.byte_bpe import PerfectHash, Vocabulary, decode_bpe, encode_bpe, hashes_of, merge_bytes, read_ranks
from lagcast.llm.packing import closest_fill, cut_documents, minimum_slack, pack, pack_documents, sequences
from lagcast.llm.pretokens import Memory, encode, split
from lagcast.llm.sequence_files import open_sequences, read_documents, write_sequences
from lagcast.llm.tokenizing import FileEncoder, read_tokenizer, tokenize
from lagcast.session import scratch_path

TOKENIZER = read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def texts_of(values):
    import pyarrow as pa

    return Texts.of(pa.array(values, pa.string()))


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(read_ranks(RANKS))


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def file_encoder():
    return FileEncoder(TOKENIZER)


TEXTS = st.text(alphabet="ab's tredlvm01\n\t  !?éß你́  \x1c\x85\U0001f600٠", max_size=40)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=6))
def test_split_equals_the_pattern(values):
    texts = texts_of(values)
    bounds, first = split(texts)
    view = texts.data.tobytes()
    found = [[view[bounds[i] : bounds[i + 1]].decode() for i in range(first[k], first[k + 1])] for k in range(len(values))]
    assert found == [regex.findall(public_tokenizers.PATTERN, v) for v in values]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(TEXTS, st.text(max_size=30)), min_size=1, max_size=5))
def test_ids_equal_the_libraries(vocabulary, library, file_encoder, values):
    for encoder, ids in (
        (vocabulary, [library.encode_ordinary(v) for v in values]),
        (file_encoder, [file_encoder.tokenizer.encode(v, add_special_tokens=False).ids for v in values]),
    ):
        found, bounds = encoder.encode(texts_of(values))
        assert [found[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == ids


def test_added_tokens_have_the_ids_of_the_library():
    library, encoder = Tokenizer.from_str(TOKENIZER), FileEncoder(TOKENIZER)
    token = "<|endoftext|>"
    values = ["plain text", f"a {token} b", "", f"{token}", "x <|endof", "text|> y", f" {token}{token}  z", "the end <|endoftext|"]
    ids, bounds = encoder.encode(texts_of(values))
    want = [library.encode(v, add_special_tokens=False).ids for v in values]
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
    assert want[1] == [64, 220, 50256, 275]


def test_heap_merges_long_pretokens_like_the_library(library):
    rng, ranks = random.Random(5), {t: k for k, t in enumerate(read_ranks(RANKS))}
    for n in (1, 2, 50, 3000):
        piece = "".join(rng.choice("abcdeo") for _ in range(n))
        assert merge_bytes(piece.encode(), ranks) == library.encode_ordinary(piece)


def test_perfect_hash_is_minimal():
    keys = [f"key {k}".encode() for k in range(5000)] + [b"a"]
    table = PerfectHash(keys)
    assert sorted(table.entry.tolist()) == list(range(len(keys)))
    assert table.candidates(hashes_of(keys)).tolist() == list(range(len(keys)))


def test_small_memory_forgets_and_colliding_hashes_are_told_apart(vocabulary, library, monkeypatch):
    values = [" ".join(f"w{k}x{j}" for j in range(40)) for k in range(30)]
    memory = Memory(bits=7)
    for _ in range(2):
        ids, bounds = encode(texts_of(values), vocabulary, memory)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode_ordinary(v) for v in values]
    monkeypatch.setattr(pretokens.Spans, "hashes", lambda self, a, b: (b - a).astype(np.uint64) << np.uint64(50))
    ids, _ = encode(texts_of(values), vocabulary, Memory(bits=7))
    assert ids.tolist() == [i for v in values for i in library.encode_ordinary(v)]


def test_bpe_round_trip_on_edges(edge_docs, no_docs, vocabulary, library):
    coded = decode_bpe(encode_bpe(edge_docs, vocabulary), vocabulary)
    for r in coded.select("text", "ids", "decoded").collect():
        assert list(r.ids) == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert decode_bpe(encode_bpe(no_docs, vocabulary), vocabulary).count() == 0


def test_closest_fill_equals_trying_all():
    rng = random.Random(6)
    for _ in range(200):
        counts = Counter(rng.randint(1, 30) for _ in range(rng.randint(1, 9)))
        space = rng.randint(0, 80)
        sums = {0}
        for length in counts.elements():
            sums |= {s + length for s in sums}
        chosen = closest_fill(counts, sorted(counts, reverse=True), space)
        assert all(0 < m <= counts[k] for k, m in chosen.items())
        assert sum(k * m for k, m in chosen.items()) == max(s for s in sums if s <= space)


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_hot_lengths_are_packed_tightly(spark):
    rng = random.Random(7)
    lengths = [700] * 30_000 + [rng.randint(1, 2048) for _ in range(30_000)]
    pieces = spark.createDataFrame([(k, 0, n) for k, n in enumerate(lengths)], "doc_id long, start long, length long")
    packed = pack(pieces, order=["doc_id"]).collect()
    assert check_places(packed, 2048) <= 1.002 * sum(lengths) / 2048 + 1
    covered = {}
    for r in sorted(packed, key=lambda r: r.start):
        assert r.start == covered.get(r.doc_id, 0)
        covered[r.doc_id] = r.start + r.length
    assert [covered[k] for k in range(len(lengths))] == lengths
    with pytest.raises(ValueError):
        minimum_slack({2049: 1})


def test_packing_on_edges(spark, edge_docs, no_docs, file_encoder):
    pieces = cut_documents(edge_docs, TOKENIZER)
    packed = pack(pieces.withColumn("whole", F.col("length")), order=["doc_id", "start", "ids"])
    rows = packed.collect()
    check_places(rows, 2048)
    assert sum(r.length for r in rows if r.doc_id == 3) == 1 == sum(r.length for r in rows if r.doc_id == 4)
    want = {}
    for text in (r.text or "" for r in edge_docs.collect()):
        ids = file_encoder.tokenizer.encode(text, add_special_tokens=False).ids + [1]
        want[text] = want.get(text, 0) + len(ids)
    got = {}
    for r in rows:
        got[r.text or ""] = got.get(r.text or "", 0) + r.length
    assert got == want
    first = F.floor(F.col("start") / 2048) * 2048
    own = F.substring("ids", (4 * (F.col("start") - first) + 1).cast("int"), (4 * F.col("length")).cast("int"))
    made = sequences(packed.withColumn("ids", own)).collect()
    for r in made:
        n = len(r.ids) // 4
        assert n == 2048 or n == r.used and n & (n - 1) == 0
    assert sum(r.used for r in made) == sum(want.values())
    assert pack(cut_documents(no_docs, TOKENIZER), order=["doc_id"]).count() == 0


def test_packed_documents_have_the_sums_of_their_ids(spark, edge_docs, file_encoder):
    prose = "copies of one text that a third of all rows share, cut to fill what they leave free " * 9
    copies = spark.range(60).select((F.col("id") + 100).alias("doc_id"), F.lit(prose).alias("text"))
    docs = copies.unionByName(edge_docs.select("doc_id", "text"))
    rows = pack_documents(docs, TOKENIZER, capacity=512).collect()
    check_places(rows, 512)
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    coded = {t: file_encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in set(texts.values())}
    seen = Counter()
    for r in rows:
        if r.doc_id is not None:
            ids = np.array(coded[texts[r.doc_id]], "<u4")
            assert len(ids) == r.doc_tokens and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
            seen[r.doc_id] += r.length
    assert seen[100] == len(file_encoder.tokenizer.encode(prose, add_special_tokens=False).ids) + 1
    assert any(r.length != 512 and r.start for r in rows if r.doc_id and r.doc_id >= 100)


def test_files_give_back_every_document(spark, edge_docs, no_docs, file_encoder):
    folder = scratch_path(spark, "files")
    files = write_sequences(edge_docs, TOKENIZER, folder, length=64)
    rows = read_documents(spark, files).collect()
    texts = [(r.doc_id, r.text or "") for r in edge_docs.collect()]
    want = Counter((k, tuple(file_encoder.tokenizer.encode(t, add_special_tokens=False).ids + [2])) for k, t in texts)
    assert Counter((r.key, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == want
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.key is None for r in ordered] == sorted((r.key is None for r in rows), reverse=True)
    known = [r.key for r in ordered if r.key is not None]
    assert known == sorted(known)
    assert [r.start for r in ordered] == np.cumsum([0, *(r.n_tokens for r in ordered[:-1])]).tolist()
    for r in files.collect():
        reader = open_sequences(r.file)
        assert sum(reader.get_batch(k).num_rows for k in range(reader.num_record_batches)) == r.sequences
        batch = reader.get_batch(0)
        assert batch.column(0).type.list_size == 64 and batch.column(1).type.list_size == 64
    empty = write_sequences(no_docs, TOKENIZER, scratch_path(spark, "files"))
    assert read_documents(spark, empty).count() == 0


def test_texts_of_one_key_lie_in_several_files(spark):
    rows = [(1, f"first {k}") for k in range(20)] + [(2, f"text {k}") for k in range(400)] + [(3, "last")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    coalescing = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalescing)
    spark.conf.set(coalescing, "false")
    try:
        files = write_sequences(docs, TOKENIZER, scratch_path(spark, "files"), length=64)
    finally:
        spark.conf.set(coalescing, before)
    assert files.count() >= 4 and files.agg({"documents": "max"}).first()[0] < 200
    read = read_documents(spark, files).orderBy("start").collect()
    assert [r.key for r in read] == [1] * 20 + [2] * 400 + [3]
    assert [r.start for r in read] == np.cumsum([0, *(r.n_tokens for r in read[:-1])]).tolist()


def test_tokenize_adds_an_end(edge_docs, file_encoder):
    for r in tokenize(edge_docs, TOKENIZER, end_id=2).select("text", "ids").collect():
        assert list(r.ids) == file_encoder.tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]


