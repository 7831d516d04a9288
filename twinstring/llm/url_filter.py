"""URL allow and block lists as a trie, longest match first.

The trie's edges are host labels from the right, then path segments. A rule of a host holds for
its subdomains, a rule's path for all paths that begin with it, so its last segment may end
inside one of the url's. The rule of most host labels wins, then the longest path; of equal
rules block wins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinstring.llm.shared import freed, plain

#: Rules that a trie holds, some 300 bytes each; longer lists are applied as several tries.
TRIE_RULES = 200_000

Rule = tuple[str, str, str]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path; both empty without ``://``."""
    if url is None or (i := url.find("://")) < 0:
        return "", ""
    rest = url[i + 3 :]
    cut = min((j for c in "/?#" if (j := rest.find(c)) >= 0), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min((j for c in "?#" if (j := rest.find(c)) >= 0), default=len(rest))
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return lower, rest[:end]


class Node:
    """``next``: by host label. ``paths``: by whole path segment. ``ends``: last, unfinished
    segments with their rule and verdict; ``sizes``: their lengths, longest first."""

    __slots__ = ("ends", "next", "paths", "sizes")

    def __init__(self):
        self.next: dict[str, Node] = {}
        self.paths: Node | None = None
        self.ends: dict[str, tuple[str, str]] = {}
        self.sizes: list[int] = []


class Trie:
    def __init__(self, rules: Sequence[Rule]):
        self.root = Node()
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"a verdict is allow or block, not {verdict!r}")
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.next.setdefault(label, Node())
            if node.paths is None:
                node.paths = Node()
            node = node.paths
            *whole, last = path.split("/")
            for segment in whole:
                node = node.next.setdefault(segment, Node())
            if node.ends.get(last, ("", ""))[1] != "block":
                node.ends[last] = (host + path, verdict)
                if len(last) not in node.sizes:
                    node.sizes = sorted([*node.sizes, len(last)], reverse=True)

    def match(self, host: str, path: str) -> tuple[int, int, str, str] | None:
        """Labels, path length, rule and verdict of the rule that wins."""
        best = None
        node, depth = self.root, 0
        labels = host.split(".")[::-1] if host else []
        segments = path.split("/")
        while node is not None:
            if node.paths is not None and (found := self._path(node.paths, segments)):
                best = (depth, *found)
            node = node.next.get(labels[depth]) if depth < len(labels) else None
            depth += 1
        return best

    @staticmethod
    def _path(node: Node, segments: list[str]) -> tuple[int, str, str] | None:
        best = None
        taken = 0
        for segment in segments:
            for size in node.sizes:
                if size <= len(segment) and (end := segment[:size]) in node.ends:
                    best = (taken + size, *node.ends[end])
                    break
            if (node := node.next.get(segment)) is None:
                break
            taken += len(segment) + 1
        return best


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of every row of ``pages`` (page_id, url).

    A url without a fitting rule, null urls included, has a null rule and the ``default``
    verdict. Empty rule hosts hold for all hosts. Rows that repeat are judged each; extra
    columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    df = plain(pages, page_id="long", url="string").select(
        "*", *[F.lit(None).cast(t).alias(c) for c, t in (("labels", "int"), ("chars", "int"), ("rule", "string"), ("verdict", "string"))]
    )
    schema = df.schema
    rules = list(rules)
    for i in range(0, len(rules), TRIE_RULES):
        shared = spark.sparkContext.broadcast(Trie(rules[i : i + TRIE_RULES]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            trie = shared.value
            for batch in batches:
                old = zip(*(batch.column(j).to_pylist() for j in range(2, 6)), strict=True)
                new = []
                for url, was in zip(batch.column(1).to_pylist(), old, strict=True):
                    found = trie.match(*split_url(url))
                    better = found and (was[0] is None or (found[:2], found[3] == "block") > (was[:2], was[3] == "block"))
                    new.append(found if better else was)
                cols = list(zip(*new, strict=True)) if new else [()] * 4
                kinds = (pa.int32(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]],
                    names=batch.schema.names,
                )

        df = df.mapInArrow(freed(run), schema)
    after = F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1)
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return df.select(
        "page_id",
        lower.alias("host"),
        path.alias("path"),
        "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
