"""URL verdicts: longest matching rule, else logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
GRAMS = (3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Labelled URLs the classifier learns from, as host and path; the names are invented or generic.
BLOCKED = """
spam-farm.example.org/en/11 www.spam-farm.example.com/de/7 m.spam-mail.example.net/ link-farm.example.org/fr/8 seo-farm.example.com/out
adult-x.example.com/en/4 www.adult-x.example.net/es/1 adult-cams.example.org/ xxx-videos.example.com/watch m.porn-tube.example.net/v/1 sex-chat.example.org/
free-bets.example.com/en/5 blog.free-bets.example.org/fr/6 casino-royal.example.net/play www.best-casino.example.com/bonus poker-online.example.org/
slots-bonus.example.com/spin betting-tips.example.net/en/1 lottery-win.example.org/claim jackpot-city.example.com/ roulette-live.example.net/
cheap-pills.example.com/viagra buy-viagra.example.org/order m.pills-online.example.net/cialis replica-watches.example.com/shop
free-money.example.org/win click-here.example.com/prize get-rich.example.net/fast warez-crack.example.org/keygen torrent-crack.example.com/serial
malware-drop.example.net/setup.exe phishing-login.example.org/account/verify free-iphone.example.com/claim-prize hot-singles.example.net/meet
escort-service.example.org/ loan-payday.example.com/apply crypto-doubler.example.net/invest spam-links.example.org/page/2
""".split()
ALLOWED = """
www.example.org/en/1 example.com/fr/22 blog.example.net/es/303 m.example.org/de/44 news.example.com/2024/05/story.html
thther.example.org/en/685 m.tionsh.example.com/en/676 www.therou.example.net/fr/474.html blog.tiontion.example.com/en/853/ ththre.example.com/fr/825
theand.example.net/de/770 onanre.example.org/es/533/ inghat.example.com/en/25 m.ernthe.example.net/en/960 whathe.example.org/de/12
library.example.org/catalogue/item/99 university.example.net/courses/biology docs.example.com/guide/install wiki.example.org/article/history
museum.example.net/exhibits/2 weather.example.com/forecast/today recipes.example.org/bread/rye garden.example.net/plants/rose
hospital.example.com/departments/heart school.example.org/timetable city.example.net/transport/bus parliament.example.com/bills/12
journal.example.org/volume/3/issue/1 archive.example.net/letters/1890 science.example.com/physics/waves books.example.org/review/44
travel.example.net/routes/north music.example.com/concerts/june sport.example.org/results/league farm.example.net/market/vegetables
adults.example.org/education/evening freeware.example.com/licence-terms better.example.net/essays expert.example.org/answers/7
""".split()


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def _buckets(text: Column, field: str) -> Column:
    """Buckets of the n-grams of ``^text$``, marked by the field."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))
    grams = lambda n: F.filter(F.transform(F.sequence(F.lit(1), F.length(marked)), lambda i: F.substring(marked, i, F.lit(n))), lambda g: F.length(g) == n)
    return F.transform(F.flatten(F.array(*[grams(n) for n in GRAMS])), lambda g: (F.crc32(F.concat(F.lit(field), g).cast("binary")) % BUCKETS).cast("int"))


def features(host: Column, path: Column) -> Column:
    """Distinct buckets of host and path."""
    return F.array_distinct(F.concat(_buckets(host, "h"), _buckets(path, "p")))


def _local_features(host: str, path: str) -> list[int]:
    found = set()
    for field, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        found |= {zlib.crc32((field + text[i : i + n]).encode()) % BUCKETS for n in GRAMS for i in range(len(text) - n + 1)}
    return sorted(found)


@lru_cache
def train(rounds: int = 150, rate: float = 0.5, penalty: float = 1e-4) -> tuple[tuple[float, ...], float]:
    """Weights by bucket, and the bias, of a logistic regression on the labelled table (fewer than 100 rows)."""
    rows = [(_local_features(*(u.partition("/")[0], "/" + u.partition("/")[2])), y) for table, y in ((BLOCKED, 1.0), (ALLOWED, 0.0)) for u in table]
    weights, bias = [0.0] * BUCKETS, 0.0
    for _ in range(rounds):
        for x, y in rows:
            scale = 1 / math.sqrt(len(x))
            p = 1 / (1 + math.exp(-(bias + scale * sum(weights[k] for k in x))))
            step = rate * (y - p)
            bias += 0.1 * step
            for k in x:
                weights[k] += scale * step - penalty * weights[k]
    return tuple(round(w, 6) for w in weights), round(bias, 6)


def probability(host: Column, path: Column) -> Column:
    """Probability that a URL is to be blocked."""
    weights, bias = train()
    table = F.split(F.lit(" ".join(map(repr, weights))), " ").cast("array<double>")
    x = features(host, path)
    total = F.aggregate(x, F.lit(0.0), lambda acc, k: acc + F.get(table, k))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(bias) + total / F.sqrt(F.greatest(F.size(x), F.lit(1)).cast("double")))))


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...], url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """``pages`` with ``host, path, rule, block_probability, verdict``.

    ``rules`` are (verdict, host + path) pairs, as ``("allow", "org/")``. A rule fits its host and all subdomains if the
    path starts with the rule's; the longest that fits decides and is returned in ``rule``, else ``rule`` is null and the classifier
    decides. Null and malformed URLs have an empty host and path and go to the classifier. One pass over the url column, no shuffle. Columns of
    the added names are replaced; repeated rows are judged alike.
    """
    host, path = parts(F.col(url_col))
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "block_probability", "verdict")]
    out = pages.select(*own, host.alias("host"), path.alias("path"))
    rule = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is tested last and so stands outermost
        h, slash, p = text.partition("/")
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(slash + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    out = out.withColumn("rule", rule).withColumn("block_probability", probability(F.col("host"), F.col("path")))
    return out.withColumn("verdict", F.coalesce(verdict, F.when(F.col("block_probability") >= threshold, "block").otherwise("allow")))
