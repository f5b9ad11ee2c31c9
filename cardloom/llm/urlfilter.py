"""URL filters on a sorted digest array.

The rules (or any large list of host-and-path entries) become one array of sorted 64-bit xxhash keys with
their full strings beside it. It is written once, handed to every executor as a file and memory-mapped there;
a batch of urls is probed with one vectorised binary search, and each hit is confirmed against the stored
string, so a collision of digests can never change a verdict. Lists past ``most_bytes`` are joined by digest
instead.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Verdict for a url that no entry of the array covers.
UNLISTED = "allow"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; NULL or no ``://``: both empty."""
    u = F.col(url)
    after = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(after, "^([^/?#]*)", 1)
    path = F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


class DigestArray:
    """Sorted digests with the entries they stand for: ``keys.npy``-like file plus strings and offsets."""

    def __init__(self, keys: np.ndarray, offsets: np.ndarray, strings: bytes | np.ndarray, verdicts: np.ndarray, lengths: np.ndarray):
        self.keys, self.offsets, self.strings, self.verdicts = keys, offsets, strings, verdicts
        #: The different lengths of the entries' paths (from the first ``/``; 0 for an entry without one), in bytes.
        self.lengths = lengths

    @classmethod
    def build(cls, rules: Iterable[tuple[str, str]]) -> DigestArray:
        """From ``(verdict, entry)``; the last of repeated entries holds."""
        last = {entry.encode(): verdict for verdict, entry in rules}
        digest = {e: xxhash.xxh64_intdigest(e) for e in last}
        order = sorted(last, key=lambda e: (digest[e], e))
        offsets = np.cumsum([0, *map(len, order)]).astype(np.int64)
        lengths = np.array(sorted({len(e) - e.find(b"/") if b"/" in e else 0 for e in order}), np.int64)
        return cls(np.array([digest[e] for e in order], np.uint64), offsets, np.frombuffer(b"".join(order), np.uint8), np.array([last[e] == "block" for e in order], np.uint8), lengths)

    @staticmethod
    def size(entries: Iterable[str]) -> int:
        """Bytes of the array of these entries, known before it is built: each has its key, offset, verdict and string."""
        return sum(17 + len(e.encode()) for e in entries)

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            f.write(np.array([len(self.keys), len(self.lengths), len(self.strings)], np.int64).tobytes())
            for part in (self.keys, self.offsets, self.lengths, self.verdicts, self.strings):
                f.write(np.asarray(part).tobytes())

    @classmethod
    def map(cls, path: str) -> DigestArray:
        """Memory-map a saved array: pages are read as they are probed and shared by the workers of a machine."""
        raw = np.memmap(path, np.uint8, "r")
        n, different, size = np.frombuffer(raw[:24], np.int64)
        at, parts = 24, []
        for kind, count in ((np.uint64, n), (np.int64, n + 1), (np.int64, different), (np.uint8, n), (np.uint8, size)):
            end = at + int(count) * np.dtype(kind).itemsize
            parts.append(np.frombuffer(raw[at:end], kind))
            at = end
        return cls(parts[0], parts[1], parts[4], parts[3], parts[2])

    def entry(self, i: int) -> bytes:
        return bytes(self.strings[self.offsets[i] : self.offsets[i + 1]])

    def probe(self, digests: np.ndarray, strings: list[bytes]) -> np.ndarray:
        """Index of the entry equal to each string, or -1."""
        out = np.full(len(digests), -1, np.int64)
        if len(self.keys) == 0 or len(digests) == 0:
            return out
        at = np.searchsorted(self.keys, digests)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == digests):
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == digests[i]:
                if self.entry(j) == strings[i]:
                    out[i] = j
                    break
                j += 1
        return out


def candidates(host: str, path: str, lengths: Iterable[int]) -> list[tuple[bytes, int]]:
    """Every entry that could cover a url, with its host's length: each suffix of the host at a dot, with each prefix of the path that is as long as some entry's."""
    whole, labels = path.encode(), host.split(".")
    heads = [whole[:n] for n in lengths if n <= len(whole)]
    return [(s + p, len(s)) for i in range(len(labels)) if (s := ".".join(labels[i:]).encode()) for p in heads]


def _longest(index: DigestArray, hosts: list[str], paths: list[str]) -> np.ndarray:
    """Index of the longest entry that covers each url, or -1. Each different host and path of a batch is looked up once."""
    lengths = index.lengths.tolist()
    pairs = {pair: i for i, pair in enumerate(dict.fromkeys(zip(hosts, paths, strict=True)))}
    found = [candidates(h, p, lengths) if h else [] for h, p in pairs]
    strings, own_host = [s for f in found for s, _ in f], np.array([n for f in found for _, n in f], np.int64)
    hit = index.probe(np.fromiter(map(xxhash.xxh64_intdigest, strings), np.uint64, len(strings)), strings)
    owner, own_host, hit = np.repeat(np.arange(len(found)), [len(f) for f in found])[hit >= 0], own_host[hit >= 0], hit[hit >= 0]
    # entries of one length and one host's length that cover a url are one entry
    order = np.lexsort((own_host, index.offsets[hit + 1] - index.offsets[hit], owner))
    last = np.append(owner[order][1:] != owner[order][:-1], True)[: len(order)]
    best = np.full(len(found), -1, np.int64)
    best[owner[order][last]] = hit[order][last]
    return best[[pairs[pair] for pair in zip(hosts, paths, strict=True)]]


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, most_bytes: int = 64 << 20) -> DataFrame:
    """Verdict on the url of each row (``page_id``, ``url``; others are ignored): the longest entry that covers
    it decides, in bytes; of equally long ones that with the longer host. An unlisted url is allowed. An entry without ``/``
    covers its host and all subdomains, whatever the path.

    Returns ``page_id, host, path, rule, verdict``. A NULL url, or one without ``://``, has an empty host and
    path, no rule and the default verdict. Repeated rows are each judged, urls of any length whole; of repeated
    entries the last holds; an empty table gives no row. ``most_bytes`` decides how the array is looked up, not what is found.
    """
    last = {entry: verdict for verdict, entry in rules}  # the last of repeated entries holds, on either way
    rules = [(verdict, entry) for entry, verdict in last.items()]
    host, path = host_and_path()
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    if DigestArray.size(last) > most_bytes:
        return judge_by_join(urls, rules)
    index = DigestArray.build(rules)
    name = f"digests-{uuid.uuid4().hex}.bin"
    folder = tempfile.mkdtemp(prefix="spark-")  # only the driver reads it: Spark serves the file to the executors
    index.save(os.path.join(folder, name))
    pages.sparkSession.sparkContext.addFile(os.path.join(folder, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped = DigestArray.map(SparkFiles.get(name))
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            best = _longest(mapped, hosts, paths)
            rules_of = {i: (mapped.entry(i).decode(), "block" if mapped.verdicts[i] else "allow") if i >= 0 else (None, UNLISTED) for i in set(best.tolist())}
            rule, verdict = ([rules_of[i][k] for i in best.tolist()] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return urls.mapInArrow(run, urls.schema.simpleString()[7:-1].replace(":", " ") + ", rule string, verdict string")


def judge_by_join(urls: DataFrame, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """The same for lists too large for one machine: candidates and entries meet by digest and full string."""
    spark = urls.sparkSession
    table = spark.createDataFrame(pd.DataFrame(list(rules), columns=["rule_verdict", "entry"])).select("rule_verdict", "entry", F.xxhash64("entry").alias("digest"))
    slash = F.instr("entry", "/")
    lengths = [r[0] for r in table.select(F.when(slash > 0, F.length("entry") - slash + 1).otherwise(0).alias("n")).distinct().collect()]
    labels = F.split("host", "\\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda p: p.isNotNull())
    # a verdict depends on host and path alone: each pair is looked up once
    each = urls.where("host <> ''").select("host", "path").distinct()
    probes = each.select("host", "path", F.explode(F.flatten(F.transform(hosts, lambda h: F.transform(heads, lambda p: F.concat(h, p))))).alias("entry"))
    hits = probes.withColumn("digest", F.xxhash64("entry")).join(table, ["digest", "entry"])
    own_host = F.octet_length(F.substring_index("entry", "/", 1))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("entry", "rule_verdict"), F.struct(F.octet_length("entry"), own_host)).alias("hit"))
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("hit.entry").alias("rule"), F.coalesce("hit.rule_verdict", F.lit(UNLISTED)).alias("verdict"))
