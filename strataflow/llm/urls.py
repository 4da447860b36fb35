"""URL verdicts: explicit rules first, else logistic regression on hashed character n-grams.

The model is trained in numpy on the small table of labelled addresses below. Host and
path n-grams are hashed into separate ranges of one weight vector. Scoring is one pass
without a shuffle, in Arrow batches.

Null addresses, and those without ``://``, have an empty host and path; what has no
n-grams is allowed by the bias. Very long addresses are scored whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
NGRAMS = (3, 4, 5)
EPOCHS = 300
RATE = 0.5
DECAY = 1e-4
#: Score from which an address is blocked.
THRESHOLD = 0.5

#: (host, path, verdict): the longest fitting rule decides.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

# Labelled addresses. Fixed values, written for this table; none is taken from the pages that are judged.
_BLOCKED = """
spam-posts.test/en/2 www.spam-links.test/page/3 best-spam.test/ seo-link-farm.test/list linkfarm.test/out/99
discount-pills.test/en/44 www.cheap-meds.test/order/12 buy-pills-online.test/cart pills-discount.test/viagra m.cheap-viagra.test/item/8
online-pharmacy-pills.test/no-prescription cheap-watches.test/replica/7 replica-bags.test/cheap
casino-night.test/en/7 www.casino-bonus.test/slots best-casino.test/roulette casino-royal.test/jackpot mega-slots.test/win win-big-casino.test/free-spins
free-wagers.test/en/5 m.bets-today.test/odds sports-bets.test/tips betting-win.test/free bets-online.test/signup poker-win.test/table poker-free.test/chips
ads-network.test/en/71 tracking-pixel.test/de/6 ads-server.test/click/1 track-clicks.test/pixel ad-tracker.test/banner popunder-ads.test/serve click-track.test/r?u adserv.test/track
adult-chat.test/en/12 www.adult-photos.test/es/4 adult-dating.test/de/19 adults-only.test/watch m.adult-stories.test/fr/2 adult-movies.test/fr/77 xxx-videos.test/free adult-cams.test/live sexy-dates.test/chat hot-singles.test/meet porn-free.test/tube
free-money.test/claim prize-winner.test/claim-now you-won-prize.test/iphone lottery-win.test/ticket get-rich-quick.test/crypto crypto-double.test/send
free-downloads.test/crack warez-crack.test/keygen torrent-free.test/movie serial-keys.test/full payday-loans.test/apply cheap-loans.test/fast miracle-diet.test/fat-burn weight-loss-pills.test/order
phish-login.test/verify-account secure-update-bank.test/login.php account-verify.test/confirm free-gift-cards.test/win malware-drop.test/setup.exe
"""
_ALLOWED = """
x.test a.test/ q.org.test i.test/en/3 up.test/about hello.test shop.test/item/3 my.site.test/en/9 www.firm.test/en/7 thistle.test/en/25 www.meadow.test/about blog.northwind.test/2021/05/notes docs.fieldstone.test/guide/start m.harbour.test/en/474.html
library.university.test/catalogue/item/12 museum.city.test/exhibits/3 news.dailypaper.test/world/article-882 www.weather.test/forecast/berlin
recipes.kitchen.test/soup/12 garden.home.test/plants/roses travel.guide.test/fr/paris history.archive.test/de/1848 science.journal.test/vol/12/paper.pdf
blog.gardener.test/en/412 oakridge.test/fr/96 blog.winterbourne.test/es/208 www.stonemason.test/en/517 lanterns.test/en/33 m.riverside.test/de/770 blog.carpenter.test/es/64
millstream.test/en/845 bluebell.test/en/129 blog.heather.test/de/381 www.weavers.test/en/902.html tern.test/es/75 station.test/en/258 blog.potter.test/en/610
orchard.test/fr/147 blog.lighthouse.test/es/936 www.mercer.test/en/484 nothing.test/de/53 m.panther.test/fr/699 resting.test/en/317 blog.brother.test/fr/28
theatre.test/en/571 together.test/de/222 wanderer.test/es/830 www.leather.test/en/19 feathers.test/fr/444 m.northern.test/en/708 blog.thunder.test/de/155
code.repository.test/project/readme api.service.test/v2/docs forum.makers.test/thread/771 school.district.test/calendar hospital.region.test/departments
government.portal.test/forms/tax parliament.test/debates/2019 court.test/rulings/77 charity.test/donate music.festival.test/programme
film.review.test/en/44 book.club.test/list/9 chess.club.test/results bird.watch.test/species/robin astronomy.society.test/moon hiking.trails.test/map/8
bakery.test/bread bicycle.shop.test/repair local.theatre.test/plays language.course.test/lesson/5 math.lectures.test/algebra physics.notes.test/waves
encyclopedia.test/wiki/tree dictionary.test/word/lamp poetry.test/poem/17 maps.test/town/lake sports.club.test/results/2020 family.recipes.test/cake
"""
_LABELLED = [(a, 1) for a in _BLOCKED.split()] + [(a, 0) for a in _ALLOWED.split()]


def _hashes(text: bytes, salt: int) -> np.ndarray:
    byte = np.frombuffer(b"^" + text + b"$", np.uint8).astype(np.uint64)
    h, out = np.zeros(len(byte), np.uint64), []
    for n in range(1, max(NGRAMS) + 1):
        if len(byte) < n:
            break
        h = h[: len(byte) - n + 1] * np.uint64(0x100000001B3) ^ byte[n - 1 :]
        if n in NGRAMS:
            out.append(h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n + 101 * salt))
    joined = np.concatenate(out) if out else np.empty(0, np.uint64)
    mixed = joined ^ joined >> np.uint64(29)
    return (mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 14)).astype(np.int64) + salt * (BUCKETS // 2)


def _labels_of(host: str) -> str:
    """A host without its last two names, which say where it is registered and not what it holds."""
    names = host.split(".")
    return ".".join(names[:-2]) or host


def features(host: str, path: str) -> np.ndarray:
    """Distinct buckets: host n-grams in the lower half of the range, path n-grams in the upper."""
    return np.unique(np.concatenate([_hashes(_labels_of(host).encode(), 0), _hashes(path.lower().encode(), 1)]))


@lru_cache(maxsize=4)
def fit(labelled: tuple = tuple(_LABELLED)) -> tuple[np.ndarray, float]:
    """Weights and bias by full gradient steps; deterministic."""
    rows = []
    for address, label in labelled:
        host, slash, path = address.partition("/")
        rows.append((features(f"{host.removesuffix('.test')}.example.test", slash + path), label))
    y = np.array([label for _, label in rows], np.float64)
    index = np.concatenate([f for f, _ in rows])
    owner = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    share = 1 / np.sqrt(np.bincount(owner, minlength=len(rows)))
    w, b = np.zeros(BUCKETS), 0.0
    for _ in range(EPOCHS):
        p = 1 / (1 + np.exp(-(np.bincount(owner, w[index], len(rows)) * share + b)))
        g = (p - y) / len(rows) * 20
        w -= RATE * (np.bincount(index, (g * share)[owner], BUCKETS) + DECAY * w)
        b -= RATE * g.sum() / 20
    return w, b


def scores(hosts: Sequence[str], paths: Sequence[str], model: tuple[np.ndarray, float]) -> np.ndarray:
    w, b = model
    z = np.empty(len(hosts))
    for i, (host, path) in enumerate(zip(hosts, paths)):
        f = features(host, path)
        z[i] = b + (w[f].sum() / np.sqrt(len(f)) if len(f) and host else -1e-9)
    return 1 / (1 + np.exp(-z))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col("url"), F.lit(""))
    parts = pages.select(
        "page_id",
        F.translate(F.regexp_extract(url, whole, 1), upper, upper.lower()).alias("host"),
        F.regexp_extract(url, whole, 2).alias("path"),
    )
    # longest first: the first that fits decides
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    model = fit()

    def run(batches):
        for batch in batches:
            s = scores(batch.column("host").to_pylist(), batch.column("path").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*batch.schema.names, "score"])

    kind = pages.schema["page_id"].dataType.simpleString()
    scored = parts.mapInArrow(run, f"page_id {kind}, host string, path string, score double")
    judged = F.coalesce(verdict, F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), judged.alias("verdict"), "score")
