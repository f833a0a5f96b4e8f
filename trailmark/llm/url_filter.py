"""URL filters: host and path rules, and logistic regression on hashed character n-grams for what no rule fits."""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (action, rule): the rule is host and path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
GRAMS, BUCKETS = (2, 3, 4), 1 << 15
#: The small labelled table that the model learns from: verdict and url, by topic.
LABELLED = """
block http://luckycasino77.com/en/bonus
block https://www.royal-casino-club.net/slots/free-spins
block https://casino-nights.bet/join?ref=22
block http://play.goldencasino.org/de/roulette
block https://bigcasinowin.info/
block https://pokerstarsbonus.top/en/register
block http://www.texas-poker-online.com/deal
block https://videopoker.gamebets.net/fr/jouer
block https://freeslots-777.com/spin
block http://megaslots.club/es/gratis
block https://sportbets365.net/odds/today
block http://www.sure-bets-tips.com/premium
block https://livebetting.win/football/bet-now
block https://bingo-jackpot.co/en/play
block http://winlottery-today.com/claim-prize
block https://international-lottery.org/winner?id=9
block https://cheap-pills-online.com/buy/viagra
block http://www.pillstore24.net/order-now
block https://pharma-pills.ru/generic/cialis
block http://buyviagra-noscript.com/en/cart
block https://canadian-meds-cheap.com/viagra-cialis
block http://dietpills-miracle.net/lose-weight-fast
block https://steroids4you.biz/shop
block http://www.adult-chat-rooms.com/cams/live
block https://adultdating.xxx/signup
block http://hot-adult-videos.net/watch/123
block https://www.xxx-tube.org/video/1
block http://freexxx.tv/es/ver
block https://pornhall.com/category/new
block http://www.best-porn-sites.net/top
block https://teenporn.club/de/film
block http://sexcams-live.com/model/22
block https://sexy-girls-chat.net/free
block http://nude-celebs.org/gallery/7
block https://escort-girls-city.com/en/book
block http://www.vip-escorts.net/prices
block https://payday-loans-fast.com/apply
block http://instantpayday.net/cash-now
block https://quick-cash-loan.biz/no-credit-check
block http://bad-credit-loans.top/approve
block https://earn-money-home.net/make-$5000
block http://www.getrichquick.biz/secret-method
block https://crypto-doubler.io/send-btc
block http://free-bitcoin-generator.com/claim
block https://forex-signals-profit.com/vip
block http://torrent-cracked.net/download/full-version
block https://www.warez-crack.org/keygen/serial
block http://cracksoft.pro/photoshop-crack-free
block https://serialkeys4free.com/windows-activator
block http://moviestorrents.to/magnet/9
block https://free-movie-stream-hd.tv/watch-online
block http://replica-watches-shop.com/rolex
block https://www.replicabags.ru/luxury/cheap
block http://fake-designer-outlet.top/sale
block https://cheap-jerseys-china.com/nike
block http://login-verify-account.com/secure/update-password
block https://paypa1-security.info/confirm
block http://bank-alert-verify.net/login.php?user=1
block https://free-iphone-winner.com/claim-now
block http://prize-survey.top/en/gift-card
block https://download-free-antivirus.biz/setup.exe
block http://update-flash-player.info/install.exe
block http://www.super-casino.example.org/en/2
block https://poker-room.example.com/de/71.html
block http://m.adult-videos.example.net/fr/8/
block https://adultcams.example.com/
block http://cheap-pills.example.org/es/6
block https://bets-and-odds.example.net/en/44
block http://xxx-gallery.example.com/en/1
block https://payday-cash.example.net/
block http://casino-royale.example.com/en/90
block https://slots-and-poker.example.org/de/3
allow https://www.dailynews.com/world/2021/05/politics
allow http://citynews.org/en/local/council
allow https://evening-herald.net/news/story-112
allow http://www.newspaper-archive.org/1932/06/page4
allow https://weather.regional.org/forecast/today
allow http://www.mountainweather.com/en/snow
allow https://en.opencyclopedia.org/wiki/Photosynthesis
allow http://wiki.freesoftware.net/index.php/Install
allow https://de.lexikonwiki.org/wiki/Eisenbahn
allow http://docs.examplelang.org/3/library/json.html
allow https://developer.webdocs.net/en/api/reference
allow http://www.codeforum.com/questions/4477/list-sort
allow https://opensource-tools.io/docs/getting-started
allow http://blog.engineer-notes.net/2019/05/caching
allow https://www.cookingathome.com/recipes/bread
allow http://familyrecipes.org/soup/lentil
allow https://gardenersdiary.net/roses/pruning
allow http://www.city-garden.org/visit
allow https://artmuseum.org/exhibitions/impressionists
allow http://www.naturalmuseum.net/en/collections/fossils
allow https://publiclibrary.city.org/catalog?id=88
allow http://www.nationallibrary.com/fr/archives
allow https://stateuniversity.edu/physics/faculty
allow http://www.primaryschool.org/calendar
allow https://mathcourses.net/algebra/lesson-3
allow http://sciencejournal.org/articles/10.1000/182
allow https://www.astronomy-club.com/telescopes
allow http://historysociety.net/en/medieval/castles
allow https://genealogy-records.org/parish/1840
allow http://railwayfans.com/steam/timetable
allow https://traveldiary.net/es/andes/day-4
allow http://www.hikingtrails.org/map/12
allow https://hotels-by-the-sea.com/rooms
allow http://cityguide.net/de/museen
allow https://football-league.org/results/2020
allow http://www.chessclub.net/tournaments
allow https://cyclingteam.com/en/stages
allow http://runners-world.org/marathon/training
allow https://health-advice.org/children/vaccines
allow http://www.hospital-info.net/en/departments
allow https://nutrition-facts.com/apple
allow http://parentsforum.org/thread/2210
allow https://photographyforum.net/lenses/review
allow http://www.musicschool.com/piano/lessons
allow https://classicalmusic.org/composers/bach
allow http://bookreviews.net/novel/188
allow https://poetry-archive.org/poem/77
allow http://www.theatrefestival.com/fr/programme
allow https://filmreview.org/2018/drama
allow http://city-council.gov.org/permits/form-12
allow https://www.taxoffice.net/de/formulare
allow http://publictransport.org/lines/7/stops
allow https://farmersmarket.com/opening-hours
allow http://www.carpentry-shop.net/tables/oak
allow https://bikestore.com/en/products/helmet
allow http://usedbooks.org/item/551
allow https://electronics-parts.net/resistor/10k
allow http://www.smallbusiness-advice.com/accounting
allow https://greenenergy.org/solar/panels
allow http://birdwatching.net/species/robin
allow https://dogtraining.org/puppy/basics
allow http://example.com/
allow https://www.example.org/en/12
allow http://site.example.net/about
allow https://home.example.com/de/345.html
allow http://thest.example.com/fr/67/
allow https://blog.anderin.example.org/es/890
allow http://m.ationes.example.net/index.html
allow https://orenti.example.com/en/3
allow http://stanin.example.org/
allow https://www.esther.example.net/de/18.html
allow http://blog.reandan.example.com/es/5
allow https://tiarte.example.com/en/1
allow http://inonat.example.net/fr/2/
allow https://m.ndthes.example.org/index.html
allow https://artien.example.com/
allow http://haston.example.com/en/1
allow https://enthor.example.org/de/4
allow http://thener.example.net/en/77
allow https://www.onares.example.com/en/9
"""


def labelled_urls() -> list[tuple[str, int]]:
    """The labelled table as (url, 1 for what is to be blocked, else 0)."""
    return [(url, int(verdict == "block")) for verdict, url in map(str.split, LABELLED.split("\n")[1:-1])]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path; both empty for null or where there is no "://"."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(host, F.lit("")), upper, upper.lower()), F.coalesce(path, F.lit(""))


def _split(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.lower(), re.match(r"[^?#]*", rest[len(host) :])[0]


def batch_features(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of the n-grams of host and path, each once a row, ordered so. All rows are hashed together; host and path have hashes of their own."""
    marked = [f"^{x}$".encode("utf-8", "surrogatepass") if x else b"" for pair in zip(hosts, paths, strict=True) for x in pair]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    byte = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    part = np.repeat(np.arange(len(marked)), size)
    left = np.cumsum(size)[part] - np.arange(len(byte))  # bytes from here to the part's end
    rows, buckets, h = [], [], (part & 1).astype(np.uint32) + np.uint32(7)
    for n in range(1, max(GRAMS) + 1):
        h = h[: len(byte) - n + 1] * np.uint32(0x01000193) ^ byte[n - 1 :]
        if n in GRAMS:
            whole = left[: len(h)] >= n
            rows.append(part[: len(h)][whole] >> 1)
            buckets.append(((h[whole] + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1))
    both = np.unique(np.concatenate(rows) * BUCKETS + np.concatenate(buckets)) if rows else np.zeros(0, np.int64)
    return both // BUCKETS, both % BUCKETS


def features(host: str, path: str) -> np.ndarray:
    """Buckets of the n-grams of host and path, each once."""
    return batch_features([host], [path])[1]


@functools.lru_cache(maxsize=4)
def fit(table: tuple[tuple[str, int], ...], rounds: int = 300, rate: float = 0.5, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent; feature vectors have length 1."""
    rows, y = [_split(u) for u, _ in table], np.array([y for _, y in table], float)
    owner, at = batch_features([h for h, _ in rows], [p for _, p in rows])
    x = 1 / np.sqrt(np.bincount(owner, minlength=len(rows)))[owner]
    w, b, balance = np.zeros(BUCKETS), 0.0, np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(owner, w[at] * x, len(rows)) + b)))
        g = (p - y) * balance
        w -= rate * (np.bincount(at, g[owner] * x, BUCKETS) / len(rows) * 20 + l2 * w)
        b -= rate * g.mean()
    return w, float(b)


def judge_urls(pages: DataFrame, *, rules: Sequence[tuple[str, str]] = RULES, labelled: Sequence[tuple[str, int]] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict ("allow" or "block") and score (the model's probability of block, null where a rule decides) per row of pages.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest rule that fits decides. Otherwise the
    model does, at 0.5. A url that is null or has no "://" has empty host and path; no n-gram is left then and the model's bias
    decides. Rows may repeat; other columns are ignored. Rows are judged alone, there is no shuffle. The labelled table is
    small by contract, and the model learnt from it has a fixed size.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        name, _, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.endswith(F.col("host"), F.lit("." + name))) & F.startswith(F.col("path"), F.lit("/" + rest))
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, act).otherwise(action)
    w, b = fit(tuple(labelled if labelled is not None else labelled_urls()))

    @F.pandas_udf("double")
    def score(host, path):
        import pandas as pd

        row, at = batch_features(host.fillna("").tolist(), path.fillna("").tolist())
        n, total = np.bincount(row, minlength=len(host)), np.bincount(row, w[at], len(host))
        return pd.Series(np.where(host.isna(), np.nan, 1 / (1 + np.exp(-(total / np.sqrt(np.maximum(n, 1)) + b)))))

    judged = rows.withColumn("rule", rule).withColumn("_action", action)
    open_ = lambda c: F.when(F.col("_action").isNull(), F.col(c))
    judged = judged.withColumn("score", F.when(F.col("_action").isNull(), score(open_("host"), open_("path"))))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("_action", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
