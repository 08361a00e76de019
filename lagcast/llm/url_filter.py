"""URL rules by a trie over reversed host labels and path segments.

A rule is written ``host/path``; it fits the host itself and all its subdomains
whose path starts with the rule's path. The longest fitting rule decides, counted
in characters; of two equal rules ``block`` wins. URLs that no rule fits get the
default verdict.

Rules travel to the tasks as broadcast tries. A trie is bounded: ``shard_bytes``
of rule text. A larger rule list is cut into as many tries as it needs, applied
one after the other, each sent only while it is within the bound.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
SHARD_BYTES = 16 << 20

_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of a URL; both empty without ``://``."""
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    path = rest[end:]
    stop = min((k for k in map(path.find, "?#") if k >= 0), default=len(path))
    return rest[:end].translate(_LOWER), path[:stop]


class Trie:
    """Rules under their reversed host labels, then under their path segments."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.root: dict = {}
        for action, rule in rules:
            host, slash, tail = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault(("host", label), {})
            *whole, last = (slash + tail).split("/")[1:] if slash else [None]
            for segment in whole:
                node = node.setdefault(("path", segment), {})
            ends = node.setdefault("ends", {})
            if ends.get(last, (None, ALLOW))[1] == ALLOW:
                ends[last] = (rule, action)

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits, with its action."""
        best, node = None, self.root
        segments = path.split("/")[1:]
        for label in reversed(host.split(".")):
            node = node.get(("host", label))
            if node is None:
                break
            found = self._under(node, segments)
            if found and (best is None or (len(found[0]), found[1] == BLOCK) > (len(best[0]), best[1] == BLOCK)):
                best = found
        return best

    @staticmethod
    def _under(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = node.get("ends", {}).get(None)  # a rule without a path
        for segment in segments:
            ends = node.get("ends")
            if ends:
                fits = [ends[segment[:k]] for k in range(len(segment) + 1) if segment[:k] in ends]
                best = fits[-1] if fits else best
            node = node.get(("path", segment))
            if node is None:
                break
        return best


def _shards(rules: list[tuple[str, str]], size: int) -> list[list[tuple[str, str]]]:
    shards: list[list] = [[]]
    held = 0
    for rule in rules:
        weight = len(rule[1].encode()) + 64
        if shards[-1] and held + weight > size:
            shards.append([])
            held = 0
        shards[-1].append(rule)
        held += weight
    return shards


def judge_urls(
    df: DataFrame,
    rules: list[tuple[str, str]],
    *,
    url: str | Column = "url",
    default: str = ALLOW,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``df`` with host, path, rule and verdict of each URL.

    Null URLs and those without ``://`` have an empty host and path, fit no rule
    and get the default verdict. Columns of ``df`` named host, path, rule or
    verdict are replaced. One narrow pass; no shuffle.
    """
    context = df.sparkSession.sparkContext
    source = F.col(url) if isinstance(url, str) else url
    found = [_fitting(context.broadcast(Trie(shard)))(source) for shard in _shards(rules, shard_bytes)]
    best = found[0] if len(found) == 1 else F.greatest(*found)
    taken = {"host", "path", "rule", "verdict"}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    judged = df.select(*kept, best.alias("__judged"))
    return judged.select(
        *kept,
        F.col("__judged.host").alias("host"),
        F.col("__judged.path").alias("path"),
        F.col("__judged.rule").alias("rule"),
        F.coalesce(F.col("__judged.action"), F.lit(default)).alias("verdict"),
    )


def _fitting(shared):
    # The greatest of several results has the longest rule, of equal ones the blocking one.
    @F.pandas_udf("size int, strict boolean, host string, path string, rule string, action string")
    def fit(urls: pd.Series) -> pd.DataFrame:
        trie = shared.value
        rows = []
        for text in urls:
            host, path = split_url(text)
            rule, action = trie.longest(host, path) or (None, None)
            rows.append((-1 if rule is None else len(rule), action == BLOCK, host, path, rule, action))
        return pd.DataFrame(rows, columns=["size", "strict", "host", "path", "rule", "action"])

    return fit
