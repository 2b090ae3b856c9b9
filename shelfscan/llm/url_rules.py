"""URL filter: trie over reversed host labels and path segments.

The rule list is a parameter of the job, not data: at most ``MAX_RULES``
entries, so that the trie's size is bounded, and it is broadcast to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

#: Largest accepted rule list; its trie is a few hundred MB at most.
MAX_RULES = 1_000_000

_UPPER_TO_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@dataclass
class _PathNode:
    children: dict[str, _PathNode] = field(default_factory=dict)
    #: Rules whose path ends inside the segment below: (prefix, rule, verdict), longest first.
    endings: list[tuple[str, str, str]] = field(default_factory=list)


@dataclass
class _HostNode:
    children: dict[str, _HostNode] = field(default_factory=dict)
    paths: _PathNode | None = None


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first ``://`` up to ``/ ? #``, A-Z lower-cased."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = rest.split("#", 1)[0].split("?", 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_UPPER_TO_LOWER), slash + path


def build_trie(rules: Sequence[tuple[str, str, str]]) -> _HostNode:
    """Trie of (verdict, host, path) rules; the first of equal rules holds, block before allow."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the broadcast trie takes {MAX_RULES}")
    root = _HostNode()
    for verdict, host, path in sorted(rules, key=lambda r: r[0] != "block"):
        node = root
        for label in reversed(host.translate(_UPPER_TO_LOWER).split(".")):
            node = node.children.setdefault(label, _HostNode())
        place = node.paths = node.paths or _PathNode()
        *full, last = path.split("/")
        for segment in full:
            place = place.children.setdefault(segment, _PathNode())
        if all(last != prefix for prefix, _, _ in place.endings):
            place.endings.append((last, host + path, verdict))
            place.endings.sort(key=lambda e: -len(e[0]))
    return root


def _match_path(node: _PathNode, path: str) -> tuple[str, str] | None:
    """The longest rule below ``node`` that is a prefix of ``path``."""
    found, segments = None, path.split("/")
    for segment in segments:
        hit = next((e for e in node.endings if segment.startswith(e[0])), None)
        found = hit[1:] if hit else found
        node = node.children.get(segment)
        if node is None:
            break
    return found


def match(root: _HostNode, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the fitting rule with the longest host, then the longest path."""
    found, node = None, root
    for label in reversed(host.split(".")):
        node = node.children.get(label)
        if node is None:
            break
        if node.paths is not None:
            found = _match_path(node.paths, path) or found
    return found


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id",
               url_col: str = "url", default: str = "allow") -> DataFrame:
    """Host, path, rule and verdict of every url.

    A rule (verdict, host, path) fits its host and all subdomains if the url's
    path starts with the rule's path; the longest host wins, then the longest
    path, block before allow between equal rules.  A null url or one without
    ``://`` has an empty host and path and gets the default verdict.  Repeated
    rows are judged one by one, an empty table gives an empty table, and
    columns other than the two named are ignored.
    """
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            hits = [match(trie.value, h, p) or (None, default) for h, p in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()),
                 pa.array([r for r, _ in hits], pa.string()), pa.array([v for _, v in hits], pa.string())],
                names=[id_col, "host", "path", "rule", "verdict"])

    narrow = pages.select(id_col, pages[url_col].cast("string").alias(url_col))
    kind = narrow.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(judged, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
