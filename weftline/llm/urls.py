"""URL filters: rules by host suffix and path start; logistic regression on character n-grams for the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, SIZES = 1 << 14, (3, 4, 5)

PLAIN_PATHS = ("", "/", "/en/100", "/de/100.html", "/fr/10/", "/es/100")
_DIGITS = bytes.maketrans(b"123456789", b"000000000")

#: (rule, verdict): fixed values of the query.
RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]

#: The labelled table the model learns from: 1 is to be blocked.
LABELLED = [
    ("https://www.adult-videos.example.net/en/12", 1), ("http://adult-dating.example.org/de/7.html", 1),
    ("https://m.adult-live.example.net/fr/3", 1), ("https://adultpics.example.org/en/88", 1),
    ("http://blog.adult-zone.example.net/es/5#top", 1), ("https://cdn.adult-hub.example.org/en/4", 1),
    ("https://porn-tube.example.net/en/1", 1), ("http://www.freeporn.example.org/fr/22.html", 1),
    ("https://xxx-movies.example.net/en/31", 1), ("https://m.hot-xxx.example.org/de/9", 1),
    ("https://sex-cams.example.net/es/14", 1), ("http://www.sexdating.example.org/en/60", 1),
    ("https://casino-royal.example.net/en/5", 1), ("http://www.bestcasino.example.org/de/41", 1),
    ("https://online-casino.example.net/fr/casino/slots", 1), ("https://bet-win.example.org/en/bets", 1),
    ("http://poker-bonus.example.net/en/poker", 1), ("https://gambling-slots.example.org/es/2", 1),
    ("https://viagra-pills.example.net/en/buy", 1), ("http://cheap-pills.example.org/en/pharma", 1),
    ("https://escort-girls.example.net/fr/8", 1), ("https://nude-pics.example.org/en/19", 1),
    ("http://warez-crack.example.net/en/download", 1), ("https://torrent-crack.example.org/de/keygen", 1),
    ("https://spam-links.example.org/en/77", 1), ("http://www.linkfarm-spam.example.net/de/6", 1),
    ("https://seo-farm.example.org/en/backlinks", 1), ("http://blog.bets-online.example.org/en/free-bets", 1),
    ("https://ads-server.example.net/en/banner", 1), ("http://m.click-track.example.org/fr/ads", 1),
    ("https://m.thares.example.net/fr/31", 0), ("http://m.therst.example.net/en/44", 0),
    ("https://m.onthe.example.org/de/3.html", 0), ("http://cdn.images.example.net/en/2", 0),
    ("https://blog.ander.example.org/es/65#top", 0), ("http://www.einund.example.net/de/90", 0),
    ("https://quelles.example.org/fr/15", 0), ("https://www.thering.example.net/en/12", 0), ("http://thern.example.org/de/7.html", 0),
    ("https://m.tionth.example.net/de/3", 0), ("https://therand.example.org/en/88", 0),
    ("http://blog.thtion.example.net/en/5#top", 0), ("https://ththes.example.org/fr/4", 0),
    ("https://blog.tiond.example.net/en/1", 0), ("http://www.thble.example.org/fr/22.html", 0),
    ("https://news.city-times.example.org/en/politics/31", 0), ("https://m.weather.example.net/de/9", 0),
    ("https://recipes.kitchen.example.org/es/14", 0), ("http://www.library.example.org/en/60", 0),
    ("https://school-science.example.net/en/5", 0), ("http://www.museum.example.org/de/41", 0),
    ("https://health-guide.example.org/fr/heart", 0), ("https://travel-notes.example.org/en/rome", 0),
    ("http://garden-blog.example.net/en/roses", 0), ("https://music-review.example.org/es/2", 0),
    ("https://code-docs.example.net/en/python?page=2", 0), ("http://forum.bikes.example.org/en/repair", 0),
    ("https://wiki.history.example.net/de/8", 0), ("https://photos.nature.example.org/en/19", 0),
    ("http://blog.market.example.net/en/617?utm_source=feed", 0), ("https://www.radio.example.org/de/712.html", 0),
]


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?`` or ``#``, with A-Z in lower case; empty if there is none."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def features(host: str, path: str) -> np.ndarray:
    """Buckets of the character n-grams of host and path; where a part begins and ends shows, digits are alike."""
    out = set()
    for part, seed in ((f"^{host}$", 1), (f"^{path}$", 2)):
        data = part.encode("utf-8", "replace").translate(_DIGITS)
        for size in SIZES:
            for i in range(len(data) - size + 1):
                out.add(xxhash.xxh32_intdigest(data[i:i + size], seed) % BUCKETS)
    return np.fromiter(out, np.int64, len(out))


def _parts(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    path = rest[end:]
    stop = min([i for i in map(path.find, "?#") if i >= 0], default=len(path))
    return rest[:end].lower(), path[:stop]


def fit(labelled: list[tuple[str, int]], rounds: int = 400, rate: float = 0.5, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights per bucket and the intercept, by gradient descent on the whole table."""
    # Each host is also seen under plain paths, so that those say nothing.
    seen = [(h, p, v) for (h, path), v in ((_parts(url), v) for url, v in labelled) for p in (path, *PLAIN_PATHS)]
    rows = [features(h, p) for h, p, _ in seen]
    y = np.array([float(v) for _, _, v in seen])
    weights, bias = np.zeros(BUCKETS), 0.0
    scale = np.array([1 / np.sqrt(max(len(r), 1)) for r in rows])
    for _ in range(rounds):
        z = np.array([weights[r].sum() for r in rows]) * scale + bias
        error = 1 / (1 + np.exp(-z)) - y
        grad = np.zeros(BUCKETS)
        for r, e, s in zip(rows, error, scale, strict=True):
            grad[r] += e * s
        weights -= rate * (grad / len(rows) * 10 + decay * weights)
        bias -= rate * error.mean()
    return weights, bias


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str]], labelled: list[tuple[str, int]], *, url: str = "url", limit: float = 0.5,
) -> DataFrame:
    """The rows with ``host``, ``path``, ``rule``, ``score`` and ``verdict``.

    A rule ``host/path`` fits its host and all hosts below it, if the url's path starts
    with the rule's; the longest one that fits decides. Elsewhere the model does: block if
    its chance is over ``limit``. Rules are few and written by hand; they are part of the plan.

    A null url, and one without ``://``, has an empty host and path, fits no rule and is
    judged by the model. Of rules equally long and both fitting (they are then the same)
    the first counts. Repeated rows are judged alike; columns with the names above are replaced.
    """
    weights, bias = fit(labelled)
    weights = weights.astype(np.float32)

    @F.pandas_udf("double")
    def chance(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            out = np.zeros(len(hosts))
            for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
                f = features(host, path)
                out[i] = 1 / (1 + np.exp(-(float(weights[f].sum()) / np.sqrt(max(len(f), 1)) + bias)))
            yield pd.Series(out)

    rows = pages.drop("host", "path", "rule", "score", "verdict").withColumns({"host": host_of(F.col(f"`{url}`")), "path": path_of(F.col(f"`{url}`"))})
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(reversed(rules), key=lambda r: len(r[0])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    rows = rows.withColumn("rule", rule).withColumn("score", chance("host", "path"))
    return rows.withColumn("verdict", F.coalesce(verdict, F.when(F.col("score") > limit, "block").otherwise("allow")))
