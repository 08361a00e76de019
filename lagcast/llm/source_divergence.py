"""How the sources of a language differ from each other and from the language.

Arrow kernels count terms inside the tasks that read the texts: lower-casing, splitting
at a pattern, dictionary codes, and grouping by hash. Partial counts meet in Spark by
language, source and term. The terms a language keeps are dealt into shards, columns of
counts that tasks merge and compare; sums over shards give the divergences. All
arithmetic is on whole numbers.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagcast.llm.arrays import Texts
from lagcast.llm.components import stored

BETWEEN_TERMS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK = 4 << 20  # bytes of text counted at once
SHARD_ROWS = 100_000  # counts of a shard, about
SOURCES, TERMS = 256, 1024  # of a block of shares that is compared at once
UNIT = 1_000_000_000

COUNTS = "lang string, source string, term string, docs long, n long"
RESULT = "lang string, source string, part string, item string, value long"


def _count(batches):
    """Per block of texts: in how many rows each term of a language and source occurs, and how often."""
    for batch in batches:
        text, lang, source = batch.columns
        for low, high, _ in Texts.of(text).blocks(BLOCK):
            split = pc.split_pattern_regex(pc.ascii_lower(text[low:high]), BETWEEN_TERMS)
            terms, rows = pc.list_flatten(split), pc.list_parent_indices(split)
            full = pc.not_equal(terms, "")
            terms, rows = terms.filter(full).dictionary_encode(), rows.filter(full)
            if not len(terms):
                continue
            langs, sources = lang[low:high].dictionary_encode(), source[low:high].dictionary_encode()
            group = pc.add(pc.multiply(langs.indices.cast(pa.int64()), len(sources.dictionary)), sources.indices.cast(pa.int64()))
            once = pa.table({"row": rows, "term": terms.indices}).group_by(["row", "term"], use_threads=False)
            once = once.aggregate([([], "count_all")])
            grouped = pa.table({"group": group.take(once["row"]), "term": once["term"], "n": once["count_all"]})
            grouped = grouped.group_by(["group", "term"], use_threads=False)
            grouped = grouped.aggregate([([], "count_all"), ("n", "sum")]).combine_chunks()
            of = grouped["group"].to_numpy()
            columns = [
                langs.dictionary.take(pa.array(of // len(sources.dictionary))),
                sources.dictionary.take(pa.array(of % len(sources.dictionary))),
                terms.dictionary.take(grouped["term"].combine_chunks()),
                grouped["count_all"].combine_chunks(),
                grouped["n_sum"].combine_chunks(),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "docs", "n"])


def share(count: np.ndarray, total: np.ndarray, kinds: int) -> np.ndarray:
    """One more than the smoothed share of ``count`` in ``total``, in units, rounded down.

    Divided in steps of three digits, so that no product leaves 64 bits.
    """
    rest, whole = count + 2, total + 2 * kinds
    out = np.zeros(np.broadcast(rest, whole).shape, dtype=np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The squared difference of two shares over their sum, rounded down."""
    apart = p - q
    return apart * apart // (p + q)


def _compare(best: int):
    """What a shard adds to the divergence of each pair, and its most telling terms of each source."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        is_head = pc.is_null(table["term"])
        head, body = table.filter(is_head), table.filter(pc.invert(is_head))
        lang, kinds = head["lang"][0].as_py(), head["kinds"][0].as_py()
        names = head["source"].combine_chunks()
        totals, lang_total = head["n"].to_numpy(), np.int64(head["lang_n"][0].as_py())
        source = pc.index_in(body["source"], names).to_numpy()
        terms = body["term"].combine_chunks().dictionary_encode()
        term, n, lang_n = terms.indices.to_numpy(), body["n"].to_numpy(), body["lang_n"].to_numpy()
        size = len(names)

        sums = np.zeros((size, size), dtype=np.int64)
        by_term = np.argsort(term, kind="stable")
        bounds = np.searchsorted(term[by_term], np.arange(0, len(terms.dictionary) + TERMS, TERMS))
        for k in range(len(bounds) - 1):
            at = by_term[bounds[k] : bounds[k + 1]]
            wide = min(TERMS, len(terms.dictionary) - k * TERMS)

            def shares(low: int) -> np.ndarray:
                high = min(low + SOURCES, size)
                counts = np.zeros((high - low, wide), dtype=np.int64)
                mine = at[(source[at] >= low) & (source[at] < high)]
                counts[source[mine] - low, term[mine] - k * TERMS] = n[mine]
                return share(counts, totals[low:high, None], kinds)

            for a in range(0, size, SOURCES):
                p = shares(a)
                for b in range(a, size, SOURCES):
                    q = p if a == b else shares(b)
                    for i in range(len(p)):
                        from_ = i + 1 if a == b else 0
                        sums[a + i, b + from_ : b + len(q)] += gap(p[i], q[from_:]).sum(axis=1)
        sums += sums.T

        p, q = share(n, totals[source], kinds), share(lang_n, lang_total, kinds)
        value = gap(p, q)
        place = np.empty(len(terms.dictionary), dtype=np.int64)
        place[pc.array_sort_indices(terms.dictionary).to_numpy()] = np.arange(len(place))
        order = np.lexsort((place[term], -value, source))
        order = order[(p > q)[order]]
        first = np.searchsorted(source[order], np.arange(size))
        order = order[np.arange(len(order)) - first[source[order]] < best]

        one, other = np.nonzero(~np.eye(size, dtype=bool))
        columns = [
            pa.array([lang] * (len(one) + len(order)), pa.string()),
            pa.concat_arrays([names.take(pa.array(one)), names.take(pa.array(source[order]))]),
            pa.array(["pair"] * len(one) + ["term"] * len(order), pa.string()),
            pa.concat_arrays([names.take(pa.array(other)), terms.dictionary.take(pa.array(term[order]))]),
            pa.array(np.concatenate([sums[one, other], value[order]])),
        ]
        return pa.table(columns, names=["lang", "source", "part", "item", "value"])

    return run


def source_divergence(
    df: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least: int = 10, best: int = 10
) -> DataFrame:
    """The divergence of all pairs of a language's sources, and each source's ``best`` terms.

    A language keeps the terms that at least ``least`` of its rows have. Null texts,
    languages and sources are empty ones; repeated rows count each. Groups whose rows
    have no term take part with counts of 0; in a language that keeps no term all pairs
    have the value 0 and there are no terms. An empty table gives no row. Other columns
    are not read.

    Partial counts are summed twice by hash (by group and term, then by term), so a
    frequent term costs a row for each task and source. Of the rest, a task holds one shard and the
    sources of its language; result and work grow with the square of their number.
    """
    docs = df.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    counts = docs.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    same = Window.partitionBy("lang", "term")
    kept = counts.select(
        "lang", "source", "term", "n",
        F.sum("docs").over(same).alias("docs"),
        F.sum("n").over(same).alias("lang_n"),
        (F.min("source").over(same) == F.col("source")).alias("first"),
    )
    kept = stored(kept.where(F.col("docs") >= least).drop("docs"), "terms")

    of_lang = kept.groupBy(F.col("lang").alias("of")).agg(
        F.count_if("first").alias("kinds"), F.sum("n").alias("lang_n"),
        F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("shards"),
    )
    of_group = kept.groupBy(F.col("lang").alias("of"), F.col("source").alias("by")).agg(F.sum("n").alias("n"))
    groups = docs.select("lang", "source").distinct()
    groups = groups.join(of_lang, F.col("lang") == F.col("of"), "left").drop("of")
    groups = groups.join(of_group, (F.col("lang") == F.col("of")) & (F.col("source") == F.col("by")), "left")
    groups = groups.fillna({"n": 0, "kinds": 0, "lang_n": 0, "shards": 1})
    heads = groups.select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "source",
        F.lit(None).cast("string").alias("term"), "n", "lang_n", "kinds",
    )
    shard = F.pmod(F.xxhash64("term"), F.col("shards")).cast("int")
    cells = kept.join(of_lang.select("of", "kinds", "shards"), F.col("lang") == F.col("of"))
    cells = cells.select("lang", shard.alias("shard"), "source", "term", "n", "lang_n", "kinds")
    # Dealt anew, or all shards of a language would stay where the join by language has them.
    dealt = heads.unionByName(cells).repartition("lang", "shard")
    compared = dealt.groupBy("lang", "shard").applyInArrow(_compare(best), RESULT)

    whole = compared.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranks = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = whole.withColumn("rank", F.row_number().over(ranks))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= best))
