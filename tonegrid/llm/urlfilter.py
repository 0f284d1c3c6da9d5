"""URL filter over a sorted digest array.

The rules' strings (host and path) are hashed to 64 bits and written as a sorted array, with the
strings and verdicts in the same order beside it.  Spark ships the files to every executor, which
maps them into memory; a batch of urls probes the array by vectorised binary search, and every
hit is confirmed on the stored string, so that two strings of one digest can't be mixed up.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .blocks import append_columns

#: Largest list, in bytes of strings and digests, that is shipped to the executors.
MAX_BYTES = 1 << 30
UPPER_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str | None) -> tuple[str, str]:
    """Lower-cased host (after the first ``://``) and path of a url; both empty without ``://``."""
    scheme, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.translate(UPPER_TO_LOWER), slash + path


class DigestArray:
    """Sorted 64-bit digests of strings, mapped into memory, with strings and verdicts in their order."""

    PARTS = ("keys", "ends", "block", "text", "lengths")

    def __init__(self, paths: dict[str, str]) -> None:
        load = lambda part, kind: np.memmap(paths[part], kind, "r") if os.path.getsize(paths[part]) else np.zeros(0, kind)
        self.keys, self.ends, self.block = load("keys", "<u8"), load("ends", "<i8"), load("block", "u1")
        self.text, self.lengths = load("text", "u1"), load("lengths", "<i8")

    @classmethod
    def write(cls, rules: Iterable[tuple[str, str]], folder: str) -> dict[str, str]:
        """Files of the (string, verdict) pairs; of equal strings one that blocks wins."""
        best: dict[bytes, bool] = {}
        lengths = set()
        for rule, verdict in rules:
            raw = rule.encode()
            best[raw] = best.get(raw, False) or verdict == "block"
            host, slash, path = rule.partition("/")
            lengths.add(len(slash + path))
        if sum(map(len, best)) + 17 * len(best) > MAX_BYTES:
            raise ValueError("the rules are too large to be shipped to every executor")
        rows = sorted((xxhash.xxh64_intdigest(raw), raw, b) for raw, b in best.items())
        text = b"".join(r for _, r, _ in rows)
        parts = {
            "keys": np.array([k for k, _, _ in rows], "<u8").tobytes(),
            "ends": np.cumsum([len(r) for _, r, _ in rows], dtype="<i8").tobytes() if rows else b"",
            "block": np.array([b for _, _, b in rows], "u1").tobytes(),
            "text": text,
            "lengths": np.array(sorted(lengths, reverse=True), "<i8").tobytes(),
        }
        stem = hashlib.sha256(b"\0".join(parts.values())).hexdigest()[:16]
        paths = {k: os.path.join(folder, f"rules-{stem}.{k}") for k in parts}
        for k, raw in parts.items():
            with open(paths[k], "wb") as f:
                f.write(raw)
        return paths

    def find(self, strings: list[bytes]) -> np.ndarray:
        """Place of each string in the array, -1 where it isn't in it."""
        digests = np.fromiter(map(xxhash.xxh64_intdigest, strings), np.uint64, len(strings))
        lo, hi = np.searchsorted(self.keys, digests, "left"), np.searchsorted(self.keys, digests, "right")
        out = np.full(len(strings), -1, np.int64)
        for i in np.flatnonzero(lo < hi):
            for k in range(lo[i], hi[i]):
                start = int(self.ends[k - 1]) if k else 0
                if self.text[start : int(self.ends[k])].tobytes() == strings[i]:
                    out[i] = k
        return out

    def judge(self, parts: list[tuple[str, str]]) -> list[tuple[str, str] | None]:
        """The longest fitting rule of each (host, path) and its verdict."""
        lengths = self.lengths.tolist()
        probes, owner = [], []
        for i, (host, path) in enumerate(parts):
            labels = host.split(".")
            for k in range(len(labels)):
                suffix = ".".join(labels[k:])
                for n in lengths:
                    if n <= len(path):
                        probes.append((suffix + path[:n]).encode())
                        owner.append(i)
        best: list[tuple[int, int] | None] = [None] * len(parts)
        at = self.find(probes)
        for p in np.flatnonzero(at >= 0):
            size = len(probes[p].decode())
            if best[owner[p]] is None or size > best[owner[p]][0]:
                best[owner[p]] = (size, int(at[p]))
        name = lambda k: self.text[(int(self.ends[k - 1]) if k else 0) : int(self.ends[k])].tobytes().decode()
        return [b and (name(b[1]), "block" if self.block[b[1]] else "allow") for b in best]


#: Application and file name to the path that was shipped: Spark takes a name once.
_shipped: dict[tuple[str, str], str] = {}


def ship(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> dict[str, str]:
    """Write the rules' files on the driver and have Spark copy them to every executor, later ones too.

    File names follow from the contents, so rules that were shipped before are not shipped again.
    """
    sc = spark.sparkContext
    paths = DigestArray.write(rules, tempfile.mkdtemp(prefix="tonegrid-rules-"))
    names = {k: os.path.basename(p) for k, p in paths.items()}
    for k, name in names.items():
        if (sc.applicationId, name) not in _shipped:
            sc.addFile(paths[k])
            _shipped[sc.applicationId, name] = paths[k]
    return names


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], url: str = "url", otherwise: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null where none fits) and ``verdict``.

    ``rules`` are (host and path, "allow" or "block").  A rule fits its host and all subdomains if
    the path starts with the rule's; the longest fitting rule decides, ``otherwise`` where none
    fits.  Null urls and urls without ``://`` have an empty host and path and fit no rule.  Repeated
    rows are judged each on its own; columns with these names are replaced; no pages give no rows.
    """
    names = ship(pages.sparkSession, rules)
    fields = [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]

    def compute():
        array = DigestArray({k: SparkFiles.get(n) for k, n in names.items()})

        def run(urls: list, _) -> list:
            parts = [host_and_path(u) for u in urls]
            found = array.judge(parts)
            return [[h for h, _ in parts], [p for _, p in parts], [f and f[0] for f in found], [f[1] if f else otherwise for f in found]]

        return run

    return append_columns(pages, url, fields, compute)
