"""URL filter: rules first, then a logistic regression on hashed character n-grams of host and path.

A rule has a host and the beginning of a path. It fits its host and all subdomains of it where the url's path starts with the rule's;
of the fitting rules the longest (host and path together) wins, of equally long ones that of the longer host, and of two
verdicts on one rule block. Rules are kept by host, so a url asks only for the suffixes of its host, however many rules there are.

Where no rule fits, the model decides: sigmoid(bias + sum w / sqrt(n)) over the distinct n-grams of three to five characters of the lower-cased
host and of the path, each hashed with its part's name to BUCKETS columns. It is fitted in numpy on a small labelled table
of urls (at most TRAIN_ROWS of them; LABELLED by default) by gradient descent with a penalty; the weights of fixed size go to the
tasks. Scoring is one pass without a shuffle.

Cases: a null url and one without `://` have an empty host and path, fit no rule and get the verdict of the bias, which is allow for the
default table. Whole urls count, however long. Rows may repeat, and each gets a row. Ports and users stay part of the host. An empty training table, or one of
a single class, decides by its share of blocked urls (none: allow). An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
#: Rows of a training table that are read at most.
TRAIN_ROWS = 20_000
EPOCHS = 300


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


RULES = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block")]

# The labelled table: invented addresses of what a corpus wants and doesn't want. Parts of a kind combine, so that a word counts
# and not the site around it.
UNWANTED = (
    "casino slots poker roulette jackpot blackjack bets betting bookmaker sportsbet win-money lottery adult adult-video xxx porn sexcams hot-girls escorts nude-pics "
    "pills diet-pills viagra pharmacy-online cheap-meds weight-loss-pills ads text-ads adserver banner-ads click-track tracker pixel-track popunder affiliate-links "
    "spam web-spam content-farm link-farm linkfarm seo-backlinks buy-followers buy-likes payday-loans fast-cash easy-money make-money-fast crypto-doubler free-bitcoin warez torrents cracked-apps "
    "keygen serials free-movies-stream phishing verify-account login-secure-update prize-winner free-iphone replica-watches essay-mill fake-diploma"
).split()
WANTED = (
    "news daily-news times herald tribune gazette chronicle journal magazine weekly library archive museum university college institute academy school research science physics "
    "chemistry biology history geography mathematics literature poetry books reader encyclopedia wiki docs manual handbook tutorial python linux database engineering weather "
    "travel hiking garden recipes kitchen cooking baking health hospital clinic medicine law court parliament government city council transport railway airport maps music "
    "theatre orchestra gallery film-review sport football cycling chess photography astronomy ocean forest farming energy climate economy markets bank insurance family parents "
    "random words lighthouse adventure qwerty better tools best theory harbour painting weaving bridge river translation language dictionary grammar letters stories notes diary forum community support blog thinking other nation station"
).split()
BEFORE = ("", "www.", "m.", "blog.")
AFTER = ("example.com", "example.net", "example.org", "site.com", "info.net", "web.org")
PATHS = ("/", "/index.html", "/en/2041", "/de/17/", "/fr/880.html", "/es/3309", "/about", "/2019/04/entry.html", "/articles/7")
#: What stands before and after a name: on both sides alike, so that it tells nothing.
AROUND = [("", ""), ("", "-online"), ("best-", ""), ("", "24"), ("my-", "-club"), ("top", ""), ("", "-hub")]
LABELLED = [
    (f"https://{BEFORE[(k + r) % 4]}{a}{name}{z}.{AFTER[(k + r) % 6]}{PATHS[(k + 4 * r) % 9]}", verdict)
    for verdict, names in (("block", UNWANTED), ("allow", WANTED)) for k, name in enumerate(names) for r, (a, z) in enumerate(AROUND)
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first `://`: up to `/`, `?`, `#` or the end, A-Z lower-cased; then up to `?`, `#` or the end. Else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


class RuleBook:
    """Rules by host, and for each host the lengths of its paths, longest first."""

    def __init__(self, rules: Iterable[Rule]):
        self.by_host: dict[str, dict[str, str]] = defaultdict(dict)
        for r in rules:
            if self.by_host[r.host].get(r.path) != "block":
                self.by_host[r.host][r.path] = r.verdict
        self.lengths = {h: sorted({len(p) for p in paths}, reverse=True) for h, paths in self.by_host.items()}

    def fitting(self, host: str, path: str) -> Rule | None:
        best: Rule | None = None
        at = 0
        while host and at >= 0:
            own = host[at:]
            if own in self.by_host:
                for n in self.lengths[own]:
                    if n <= len(path) and (verdict := self.by_host[own].get(path[:n])):
                        rule = Rule(own, path[:n], verdict)
                        if best is None or (len(own) + n, len(own)) > (len(best.host) + len(best.path), len(best.host)):
                            best = rule
                        break
            at = host.find(".", at) + 1 or -1
        return best


def columns_of(host: str, path: str) -> np.ndarray:
    """The hashed distinct n-grams of host and path, their ends marked."""
    out = set()
    for name, text in ((b"h", host), (b"p", path.lower())):
        raw = b"^" + text.encode("utf-8", "replace") + b"$"
        if text:
            out.update(zlib.crc32(raw[i : i + n], name[0]) % BUCKETS for n in GRAMS for i in range(len(raw) - n + 1))
    return np.fromiter(sorted(out), np.int64, len(out))


class UrlModel:
    def __init__(self, bias: float):
        self.bias, self.w = bias, np.zeros(BUCKETS)

    def fit(self, urls: list[tuple[str, str]], y: np.ndarray, epochs: int = EPOCHS, step: float = 1.0, decay: float = 1e-5) -> UrlModel:
        """Gradient descent over all rows; both classes weigh what they count."""
        cols = [columns_of(h, p) for h, p in urls]
        lengths = np.array([len(c) for c in cols])
        flat, value = np.concatenate(cols), np.repeat(1 / np.sqrt(np.maximum(lengths, 1)), lengths)
        row = np.repeat(np.arange(len(cols)), lengths)
        own, at = np.unique(flat, return_inverse=True)
        w, bias, squares, of_bias = np.zeros(len(own)), self.bias, np.full(len(own), 1e-6), 1e-6
        for _ in range(epochs):
            raw = bias + np.bincount(row, w[at] * value, len(cols))
            err = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y) / len(cols)
            g = np.bincount(at, err[row] * value, len(own)) + decay * w
            squares += g * g
            of_bias += err.sum() ** 2
            w -= step * g / np.sqrt(squares)
            bias -= 0.1 * step * err.sum() / np.sqrt(of_bias)
        self.w[own], self.bias = w, bias
        return self

    def score(self, host: str, path: str) -> float:
        cols = columns_of(host, path)
        raw = self.bias + (self.w[cols].sum() / np.sqrt(len(cols)) if len(cols) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(raw, -40, 40))))


def fitted(labelled: DataFrame) -> UrlModel:
    """A model of a small table (url, verdict: allow or block), of which the first TRAIN_ROWS different rows by url are read."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.filter("verdict in ('allow', 'block')").select("url", host.alias("host"), path.alias("path"), "verdict").distinct()
    rows = rows.orderBy("url", "verdict").limit(TRAIN_ROWS).collect()
    y = np.array([float(r.verdict == "block") for r in rows])
    if not len(rows) or y.min() == y.max():
        return UrlModel(40.0 if len(rows) and y[0] else -40.0)
    return UrlModel(-0.5).fit([(r.host, r.path) for r in rows], y)


def judged(pages: DataFrame, model: UrlModel, rules: Iterable[Rule] = tuple(RULES)) -> DataFrame:
    """page_id, host, path, rule, verdict, score of each row; score is the model's, null where a rule decides."""
    rules = [Rule(*r) for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = RuleBook(rules)
        for b in batches:
            found, verdicts, scores = [], [], []
            for host, path in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                rule = book.fitting(host, path)
                score = None if rule else model.score(host, path)
                found.append(rule.host + rule.path if rule else None)
                verdicts.append(rule.verdict if rule else "block" if score >= 0.5 else "allow")
                scores.append(score)
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(found, pa.string()), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "score"])

    host, path = host_and_path(F.col("url"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    return own.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")


def default_model(spark) -> UrlModel:
    return fitted(spark.createDataFrame(LABELLED, "url string, verdict string"))
