"""URL filter: ordered rules, then logistic regression on hashed character n-grams.

The model is trained on the driver from a small labelled URL table (``labelled_urls.tsv``
beside this module; at most ``MOST_LABELLED`` rows, all of which are used) and is a vector of 2**16 weights,
which travels with the task's code; scoring is one pass without a shuffle.

Nulls: a null URL, or one without "://", has an empty host and path; no rule fits
it, and without n-grams the model has no evidence: its score is 0, which allows it.
Repeated rows are judged alike.  A very long URL gives all its n-grams.  An empty table
gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick
from .textkernel import ranges

BITS = 16
GRAMS = (3, 4, 5)
MOST_LABELLED = 100_000

#: (verdict, host, path) of the production rules.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
RULES = [(v, h, p.removeprefix("/")) for v, h, p in RULES]

def labelled(path: str | None = None) -> list[tuple[str, int]]:
    """The labelled URL table: a URL, a tab, and 1 if it is to be blocked, else 0, on each line."""
    with open(path or os.path.join(os.path.dirname(__file__), "labelled_urls.tsv"), encoding="utf-8") as f:
        rows = [line.rstrip("\n").split("\t") for line in f if line.strip()]
    return [(url, int(label)) for url, label in rows]


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z in lower case; empty if there is none."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does.

    A rule's text is its host, "/" and its path's rest; it fits its host and all
    subdomains where the path starts with "/" and that rest.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        found = F.when(fits, F.struct(F.lit(f"{h}/{p}").alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of each n-gram of code points of the texts."""
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint8)
    size = len(raw) // 4
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[0], ends])))
    docs, buckets = [], []
    for n in GRAMS:
        at = np.arange(max(0, size - n + 1))
        at = at[at + n <= ends[owner[at]]] if len(at) else at
        docs.append(owner[at])
        buckets.append((ranges(raw, 4 * at, 4 * (at + n)) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(docs), np.concatenate(buckets)


def _features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, weight) with weights 1 / sqrt(n-grams of the text)."""
    doc, bucket = grams([f"^{h}|{p}$" if h or p else "" for h, p in zip(hosts, paths, strict=True)])
    share = 1 / np.sqrt(np.maximum(1, np.bincount(doc, minlength=len(hosts))))
    return doc, bucket, share[doc]


def train(hosts: list[str], paths: list[str], labels: list[int], steps: int = 300, rate: float = 4.0, decay: float = 1e-4) -> np.ndarray:
    """Weights of the buckets and, last, the bias, by full-batch gradient descent from zero: no randomness."""
    doc, bucket, value = _features(hosts, paths)
    y = np.array(labels, float)
    w = np.zeros((1 << BITS) + 1)
    for _ in range(steps):
        z = w[-1] + np.bincount(doc, w[bucket] * value, minlength=len(y))
        error = 1 / (1 + np.exp(-z)) - y
        slope = np.bincount(bucket, error[doc] * value, minlength=1 << BITS) / len(y)
        w[:-1] -= rate * (slope + decay * w[:-1])
        w[-1] -= rate * error.mean()
    return w


def scores(weights: np.ndarray, hosts: list[str], paths: list[str]) -> np.ndarray:
    """The log-odds that each URL is to be blocked."""
    doc, bucket, value = _features(hosts, paths)
    known = np.bincount(doc, minlength=len(hosts)) > 0
    return np.where(known, weights[-1] + np.bincount(doc, weights[bucket] * value, minlength=len(hosts)), 0.0)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of one URL on the driver, as ``host_of`` and ``path_of`` take them."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, path = rest[:cut], rest[cut:]
    path = path[: min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def model(rows: list[tuple[str, int]]) -> np.ndarray:
    """Weights trained from labelled URLs."""
    if len(rows) > MOST_LABELLED:
        raise ValueError(f"the labelled table is to be small: {MOST_LABELLED} rows at most")
    hosts, paths = zip(*(split_url(u) for u, _ in rows), strict=True)
    return train(list(hosts), list(paths), [y for _, y in rows])


def judge(pages: DataFrame, weights: np.ndarray, rules: list[tuple[str, str, str]] = RULES, threshold: float = 0.0) -> DataFrame:
    """page_id, host, path, rule, verdict ("allow" or "block") of every page, and the model's ``score``."""
    held = weights.astype(np.float32)

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in parts:
            out = np.empty(len(hosts))
            for at in range(0, len(hosts), 2048):
                out[at : at + 2048] = scores(held, list(hosts[at : at + 2048]), list(paths[at : at + 2048]))
            yield pd.Series(out)

    url = F.col("url")
    parsed = pick(pages, "page_id", "url").select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    scored = parsed.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("fit"), score("host", "path").alias("score"))
    by_model = F.when(F.col("score") > threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", by_model).alias("verdict"), "score")
