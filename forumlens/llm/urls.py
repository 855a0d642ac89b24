"""URL filters by a sorted digest array.

A rule is a host, a path prefix and a verdict. Its key is the text ``host/path``; the 64-bit xxHashes of all keys stand
sorted in one file, with the offsets and the full text of every key behind them. The file goes to every executor as a
file of the job and is memory-mapped there, so only the pages that a search touches are read, and the workers of a
machine share them. For a URL, the keys of all rules that can fit it are its host suffixes joined with prefixes of its
path; their hashes are looked up in one binary search over the array per batch, and hits are confirmed by comparing
the stored text, so a collision of hashes never decides. Of the rules that fit, the longest decides: the longest host,
then the longest path; equal keys keep the block.

A rule fits its host and all subdomains, if the path of the URL starts with the path of the rule. Only path lengths
and numbers of host labels that some rule has are tried, so the work for a host is linear in its length. ``default`` is the verdict without a rule.

Results on edges: a null URL or one without ``://`` has an empty host and an empty path, no rule and the default
verdict. Repeated rows are judged alike. An empty list of rules gives the default everywhere.

Size: the file has 20 bytes and the key per rule. It is written by the driver, which refuses more than
``MAX_FILE_BYTES``; a larger list goes in several files, one filter after the other.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from forumlens.llm.common import BOOK, append_from_texts, col, table

ALLOW, BLOCK = "allow", "block"
MAX_FILE_BYTES = 1 << 30


class Rule(NamedTuple):
    host: str
    path: str          # starts with a slash
    verdict: str


RULES = (Rule("org", "/", ALLOW), Rule("example.org", "/es/", BLOCK), Rule("example.org", "/en/1", BLOCK),
         Rule("com", "/fr/", ALLOW), Rule("com", "/de/", BLOCK))


def write_digests(rules, path: str) -> int:
    """Write the sorted array: counts, path lengths and label counts in use, hashes, offsets, verdicts, keys. Returns its bytes."""
    by_key: dict[bytes, str] = {}
    for rule in rules:
        if not rule.path.startswith("/") or "/" in rule.host or rule.verdict not in (ALLOW, BLOCK):
            raise ValueError(f"not a rule: {rule}")
        key = (rule.host.lower() + rule.path).encode()
        by_key[key] = BLOCK if BLOCK in (rule.verdict, by_key.get(key)) else ALLOW
    keys = sorted(by_key, key=lambda k: (xxhash.xxh64_intdigest(k), k))
    lengths = np.array(sorted({len(k.decode()) - k.decode().index("/") for k in keys}), "<u8")
    labels = np.array(sorted({k[:k.index(b"/")].count(b".") + 1 for k in keys}), "<u8")
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, keys), "<u8", len(keys))
    offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype("<u8")
    verdicts = np.array([by_key[k] == BLOCK for k in keys], "<u4")
    size = 24 + 8 * (len(lengths) + len(labels)) + 16 * len(keys) + 8 + 4 * len(keys) + int(offsets[-1])
    if size > MAX_FILE_BYTES:
        raise ValueError(f"{size} bytes of rules: split the list")
    with open(path, "wb") as file:
        for part in (np.array([len(keys), len(lengths), len(labels)], "<u8"), lengths, labels, hashes, offsets, verdicts):
            file.write(part.tobytes())
        file.writelines(keys)
    return size


class Digests:
    """The memory-mapped array."""

    def __init__(self, path: str):
        self.raw = np.memmap(path, np.uint8, "r")
        n, m, k = (int(x) for x in self.raw[:24].view("<u8"))
        at = 24

        def part(kind: str, count: int):
            nonlocal at
            found = self.raw[at:at + np.dtype(kind).itemsize * count].view(kind)
            at += found.nbytes
            return found

        self.lengths = sorted(part("<u8", m).tolist(), reverse=True)
        self.labels = sorted(part("<u8", k).tolist(), reverse=True)
        self.hashes, self.offsets, self.verdicts = part("<u8", n), part("<u8", n + 1), part("<u4", n)
        self.keys = self.raw[at:]

    def key(self, row: int) -> bytes:
        return self.keys[int(self.offsets[row]):int(self.offsets[row + 1])].tobytes()

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The row of each key, or -1: one binary search for all of them, then the stored texts are compared."""
        n = len(self.hashes)
        if not n or not keys:
            return np.full(len(keys), -1)
        wanted = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        first = np.searchsorted(self.hashes, wanted, "left")
        out = np.full(len(keys), -1)
        for i in np.flatnonzero((first < n) & (self.hashes[np.minimum(first, n - 1)] == wanted)).tolist():
            row = int(first[i])
            while row < n and self.hashes[row] == wanted[i]:  # equal hashes stand next to each other
                if self.key(row) == keys[i]:
                    out[i] = row
                    break
                row += 1
        return out


_OPEN: dict[str, Digests] = {}


def _opened(name: str) -> Digests:
    if name not in _OPEN:
        _OPEN[name] = Digests(SparkFiles.get(name))
    return _OPEN[name]


def host_of(url: Column) -> Column:
    """Behind the first ``://`` up to a slash, question mark, hash or the end; ASCII capitals lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """Behind the host up to a question mark, hash or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: str, path: str, lengths: list[int], counts: list[int]) -> list[bytes]:
    """Keys of all rules that can fit, the longest host first, then the longest path; both lists of sizes fall."""
    labels = host.split(".")
    prefixes = [path[:n] for n in lengths if n <= len(path)]
    return [f"{'.'.join(labels[-n:])}{prefix}".encode() for n in counts if n <= len(labels) for prefix in prefixes] if host else []


def decide(hosts: list[str], paths: list[str], digests: Digests, default: str) -> tuple[list[str | None], list[str]]:
    """Rule and verdict of each URL."""
    candidates = [keys_of(h, p, digests.lengths, digests.labels) for h, p in zip(hosts, paths)]
    distinct = list(dict.fromkeys(k for keys in candidates for k in keys))
    row = dict(zip(distinct, digests.find(distinct).tolist()))
    rules, verdicts = [], []
    for keys in candidates:
        best = next((k for k in keys if row[k] >= 0), None)
        rules.append(None if best is None else best.decode())
        verdicts.append(default if best is None else BLOCK if digests.verdicts[row[best]] else ALLOW)
    return rules, verdicts


def publish(spark: SparkSession, rules) -> str:
    """Give the array to all executors, also to those that start later, as a file of the job; returns its name.

    The driver's own copy is only the source of that transfer."""
    name = f"digests-{uuid.uuid4().hex}"
    path = os.path.join(tempfile.mkdtemp(prefix="digests-"), name)
    write_digests(rules, path)
    spark.sparkContext.addFile(os.path.realpath(path))
    return name


_SEPARATOR = "#"     # never in a host, so the first one stands behind it


def judge(pages: DataFrame, rules=RULES, url: str = "url", default: str = ALLOW, keep: list[str] | None = None) -> DataFrame:
    """Append host, path, rule and verdict of every URL. One narrow step."""
    name = publish(pages.sparkSession, rules)
    kept = [c for c in pages.columns if (keep is None or c in keep) and c.lower() not in ("host", "path", "rule", "verdict")]
    parsed = pages.select(*[col(c) for c in kept], F.concat(host_of(col(url)), F.lit(_SEPARATOR), path_of(col(url))).alias("__parts"))

    def compute(parts):
        hosts, paths = zip(*[p.split(_SEPARATOR, 1) for p in parts]) if parts else ((), ())
        return [list(hosts), list(paths), *decide(list(hosts), list(paths), _opened(name), default)]

    fields = [StructField(c, StringType()) for c in ("host", "path", "rule", "verdict")]
    return append_from_texts(parsed, "__parts", fields, compute, kept)


SQL_HOST = r"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_PATH = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


@BOOK.add("op4_url_digests", rf"""
    WITH p AS (SELECT page_id, {SQL_HOST} AS host, {SQL_PATH} AS path FROM pages),
    r AS (SELECT *, CASE
        WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/' END AS rule FROM p)
    SELECT *, CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r""")
def url_digests(spark, sf_dir):
    """Host, path, rule and verdict of every page."""
    return judge(table(spark, sf_dir, "pages"), keep=["page_id"])
