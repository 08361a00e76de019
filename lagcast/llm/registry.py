"""Registered queries of this subpackage and their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from lagcast.llm.byte_bpe import Vocabulary, decode_bpe, encode_bpe, read_ranks
from lagcast.llm.compression_bands import compression_bands, fit_bands
from lagcast.llm.components import stored
from lagcast.llm.folds import is_fold
from lagcast.llm.language_id import fit_languages, identify_language
from lagcast.llm.maxent_lm import count_words, fit_maxent, frequent, score_documents
from lagcast.llm.multi_index import nearest
from lagcast.llm.near_duplicates import near_duplicates
from lagcast.llm.packing import pack_documents
from lagcast.llm.quality_classifier import fit_quality, score_quality
from lagcast.llm.sequence_files import read_documents, write_sequences
from lagcast.llm.tokenizing import read_tokenizer
from lagcast.llm.source_divergence import source_divergence
from lagcast.llm.toxicity import fit_toxicity, score_toxicity
from lagcast.llm.url_filter import judge_urls
from lagcast.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, compress_vectors
from lagcast.session import scratch_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """The quality score of every document, learned from four fifths of the labels."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").where(~is_fold("doc_id", 5, 0))
    model = fit_quality(docs, labels, label="quality")
    scored = score_quality(docs, model, threshold=0.3, keep=["doc_id"])
    return scored.select("doc_id", is_fold("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pack_documents(docs, read_tokenizer(TOKENIZER), end_id=1)


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the ids of every document, and of the bytes decoded from them."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    vocabulary = Vocabulary(read_ranks(RANKS))
    decoded = decode_bpe(encode_bpe(docs, vocabulary, keep=["doc_id"]), vocabulary)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_compression_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Text statistics and the verdict of the compression bands on every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    bands, of_chunks = fit_bands(docs)
    return compression_bands(docs, bands=bands, chunk_bands=of_chunks, keep=["doc_id"])


def op5_sequence_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as it is read back from the written sequence files."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    files = write_sequences(docs, read_tokenizer(TOKENIZER), scratch_path(spark, "sequences"), end_id=2)
    read = read_documents(spark, files)
    return read.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on every page's URL."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    return judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    return nearest(table(spark, folder, "embeddings"), lambda vec_id: vec_id % 50 == 0, k=5)


def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """The group of near copies of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return near_duplicates(docs, width=3, percent=85)


def op9_maxent_lm(spark: SparkSession, folder: str) -> DataFrame:
    """Language-model scores of every document, learned from six sevenths of them."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    training = docs.where(F.col("doc_id").isNotNull() & ~is_fold("doc_id", 7, 2))
    words = stored(count_words(training), "words", 1000)
    counts = frequent(words)
    model = fit_maxent(training, counts, spread=F.xxhash64("doc_id"))
    scored = score_documents(docs, model, counts, words)
    return scored.select(
        "doc_id", is_fold("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = fit_languages(docs.where(~is_fold("doc_id", 3, 1)))
    found = identify_language(docs.drop("lang"), model, keep=["doc_id"])
    return found.select("doc_id", is_fold("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """How the sources of each language differ, in pairs and by terms."""
    return source_divergence(table(spark, folder, "documents").select("text", "lang", "source"))


def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity score of every document, learned from two thirds of the labels."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").where(~is_fold("doc_id", 3, 1))
    model = fit_toxicity(docs, labels, label="toxic")
    scored = score_toxicity(docs, model, threshold=0.7, keep=["doc_id"])
    return scored.select("doc_id", is_fold("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """The code of every vector, its error and that of its label."""
    return compress_vectors(table(spark, folder, "embeddings"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_packing": op2_packing,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_compression_bands": op4_compression_bands,
    "op5_sequence_files": op5_sequence_files,
    "op6_url_filter": op6_url_filter,
    "op7_multi_index": op7_multi_index,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_maxent_lm": op9_maxent_lm,
    "op10_language_id": op10_language_id,
    "op11_source_divergence": op11_source_divergence,
    "op12_toxicity": op12_toxicity,
    "op13_vector_codes": op13_vector_codes,
}

_RULE_ROWS = ", ".join(f"('{rule.split('/')[0]}', '/{rule.partition('/')[2]}', '{rule}', '{action}')" for action, rule in URL_RULES)

_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

_SQUARE = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"


def _assigned(turn: int) -> str:
    """The nearest entry of every part."""
    return f"""
        assigned{turn} AS (
            SELECT row, vec_id, label, p, part, min(near).e AS e, min(near).d AS d FROM (
                SELECT a.row, a.vec_id, a.label, a.p, a.part,
                       {{'d': coalesce({_SQUARE.format(a='a.part', b='b.part')}, 0), 'e': b.e}} AS near
                FROM parts a JOIN book{turn} b ON a.p = b.p)
            GROUP BY row, vec_id, label, p, part)"""


def _moved(turn: int) -> str:
    """The entries at the means of the parts that took them."""
    return f"""
        means{turn} AS (
            SELECT p, e, list(mean ORDER BY i) AS part FROM (
                SELECT p, e, i, CAST(floor_div AS BIGINT) AS mean FROM (
                    SELECT p, e, i, (sum(part[i]) - ((sum(part[i]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div
                    FROM assigned{turn}, unnest(range(1, len(part) + 1)) AS u(i) GROUP BY p, e, i))
            GROUP BY p, e),
        book{turn + 1} AS (
            SELECT b.p, b.e, coalesce(m.part, b.part) AS part
            FROM book{turn} b LEFT JOIN means{turn} m ON b.p = m.p AND b.e = m.e)"""


ORACLE = {
    "op11_source_divergence": rf"""
        WITH docs AS (
            SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(coalesce({_LOWERED}, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
        terms AS (SELECT d, lang, source, unnest(words) AS term FROM docs),
        kept AS (SELECT lang, term, count(*) AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
        langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
        counts AS (SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY lang, source, term),
        totals AS (
            SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total
            FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source
            GROUP BY g.lang, g.source),
        cells AS (
            SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
                   1 + (1000000000 * (CAST(coalesce(c.n, 0) AS HUGEINT) + 2)) // (t.total + 2 * l.v) AS p,
                   1 + (1000000000 * (CAST(k.n AS HUGEINT) + 2)) // (l.total + 2 * l.v) AS q
            FROM totals t JOIN langs l ON t.lang = l.lang JOIN kept k ON t.lang = k.lang
            LEFT JOIN counts c ON t.lang = c.lang AND t.source = c.source AND k.term = c.term),
        sums AS (
            SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
            FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
            GROUP BY a.lang, a.source, b.source),
        found AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
            FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM cells WHERE n > 0 AND p > q),
        ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM found)
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
    """,
    "op13_vector_codes": f"""
        WITH vectors AS (
            SELECT row_number() OVER () AS row, vec_id, label,
                   list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS (
            SELECT row, vec_id, label, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS part
            FROM vectors, unnest(range({PARTS})) AS u(p)),
        firsts AS (
            SELECT row, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM vectors
            ORDER BY vec_id NULLS LAST, v LIMIT {ENTRIES}),
        book0 AS (SELECT a.p, f.e, a.part FROM parts a JOIN firsts f ON a.row = f.row),
        {", ".join(f"{_assigned(turn)}, {_moved(turn)}" for turn in range(ROUNDS))}, {_assigned(ROUNDS)},
        coded AS (
            SELECT row, vec_id, label, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
            FROM assigned{ROUNDS} GROUP BY row, vec_id, label),
        digest AS (
            SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM coded, digest
    """,
    "op8_near_duplicates": f"""
        WITH RECURSIVE worded AS (
            SELECT doc_id, {_WORDS.format(text=f"coalesce({_LOWERED}, '')")} AS words FROM documents),
        shingled AS (
            SELECT doc_id, CASE WHEN len(words) = 0 THEN []
                WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
                ELSE list_distinct(list_transform(range(1, len(words) - 1),
                                                  lambda i: array_to_string(words[i:i + 2], ' '))) END AS shingles
            FROM worded),
        single AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM shingled),
        alike AS (
            SELECT a.doc_id AS a, b.doc_id AS b
            FROM single a JOIN single b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id
            HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
        reached AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION
            SELECT r.a, l.b FROM reached r JOIN alike l ON r.b = l.a),
        least AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
        SELECT s.doc_id, len(s.shingles) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
        FROM shingled s JOIN least l USING (doc_id)
    """,
    "op6_url_filter": f"""
        WITH rules(rule_host, rule_path, rule, verdict) AS (VALUES {_RULE_ROWS}),
        rest AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
        cut AS (
            SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM rest),
        parts AS (
            SELECT page_id,
                   translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path
            FROM cut),
        fitting AS (
            SELECT p.page_id, r.rule, r.verdict,
                   row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC) AS place
            FROM parts p JOIN rules r
              ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path))
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
        FROM parts p LEFT JOIN fitting f ON p.page_id = f.page_id AND f.place = 1
    """,
}
