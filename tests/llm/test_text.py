import re
import zlib

import numpy as np
import pytest

from strataflow.llm import extraction, licenses, toxicity, urls
from tests.llm.helpers import awkward, documents

# --- toxicity


def toxic_corpus():
    rng = np.random.default_rng(8)
    clean = ["".join(rng.choice(list("abdegilmnorstu"), 6)) for _ in range(300)]
    bad = ["idiot", "moron", "scumbag", "pathetic"]
    rows, labels = [], []
    for i in range(900):
        words, toxic = list(rng.choice(clean, int(rng.integers(5, 120)))), i % 4 == 0
        if toxic:
            for _ in range(max(1, len(words) // 20)):
                words[int(rng.integers(len(words)))] = str(rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_corpus()
    unseen = [(5000, "you idiiot and mor0n"), (5001, None), (5002, ""), (5003, "a quiet day"), (None, "idiot"), (None, None)]
    docs = documents(spark, rows + unseen + [rows[0]])
    table = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, table)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + len(unseen) + 1
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 100 and np.mean([truth[r["doc_id"]] == r["predicted"] for r in held]) > 0.95
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    of = {r["doc_id"]: r["score"] for r in got}
    assert of[5001] == of[5002] and of[5000] > of[5003]  # misspellings share n-grams
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r["predicted"] for r in got)


def test_toxicity_learns_from_no_held_out_row(spark):
    rows, labels = toxic_corpus()
    docs = documents(spark, rows)
    flip = [(i, 1, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, _, t in labels]
    a, b = (toxicity.train(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flip))
    assert (a.value == b.value).all() and a.bias == b.bias


def test_toxicity_without_labels(spark):
    docs = documents(spark, awkward())
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels))
    assert got.where("score >= 0.5").count() == 0 and got.count() == docs.count()
    assert toxicity.score(documents(spark, []), toxicity.train(docs, labels)).count() == 0


# --- licenses


def license_rows():
    texts = [
        "Released under the MIT License.", "mit license mit LICENSE", "cc by cc by x cc-by", "MIT\nLicense", "xmit license",
        "GNU General Public License, version 3 or any later version", "Licensed under CC BY-NC 4.0.", "mıt license",
        "Licensed under the Apache License, Version 2.0.", "committed licensee public", "Émit license", "mit, license",
        "a b c " * 3000 + "apache license", "SPDX-License-Identifier: GPL-3.0-only", "gnu general public", "MIT License\x00MIT-license",
    ]
    return [*awkward(), *((500 + i, t) for i, t in enumerate(texts))]


def test_base_phrases(spark):
    rows = license_rows()
    got = licenses.scan(documents(spark, rows)).collect()
    want = []
    for d, t in rows:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").encode().lower().decode())
        hits = [(i, l) for p, l in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in hits]
        want.append((d, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({l for _, l in hits}))))
    key = lambda r: tuple(str(x) for x in r)
    cut = [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got]
    assert sorted(cut, key=key) == sorted(want, key=key)
    for r in got:
        labels = [x for x in r["labels"].split(",") if x]
        assert labels == sorted(set(labels)) and set(r["base_labels"].split(",")) - {""} <= set(labels)
        assert 0 <= r["score"] <= 1
    assert licenses.scan(documents(spark, [])).count() == 0


def test_rules_by_hand(spark):
    """The rules in plain Python: every match, then suppression by containment and priority."""
    rows = license_rows()
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(documents(spark, rows)).collect() if r["doc_id"] is not None}
    for d, t in rows:
        if d is None:
            continue
        words = " " + " ".join(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())) + " "
        found = []
        for number, (pattern, key, label, priority, _, base) in enumerate(licenses.rules()):
            if f" {key}" in words:
                for m in re.finditer(f"(?<= )(?:{pattern})(?= )", words):
                    start = words[: m.start()].count(" ")
                    found.append((start, start + m[0].count(" "), priority, -number, label, base))
        kept = [
            x for x in found
            if x[5] or not any(y[0] <= x[0] and y[1] >= x[1] and y[2] >= x[2] and (y[1] - y[0], y[2], y[3]) > (x[1] - x[0], x[2], x[3]) for y in found)
        ]
        assert got[d] == ",".join(sorted({x[4] for x in kept})), (d, t[:80] if t else t)


def test_anchors_lose_no_rule():
    assert len(licenses.rules()) > 300
    assert {"licen", "bsd", "cc by"} <= set(licenses._anchors()) and len(licenses._anchors()) < 60


# --- addresses


def test_urls(spark):
    cases = {
        1: ("https://A.Example.ORG/es/x?q#f", "a.example.org", "/es/x", "example.org/es/", "block"),
        2: ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        3: ("http://myexample.org/es/1", "myexample.org", "/es/1", "org/", "allow"),
        4: ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"),
        5: ("http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"),
        6: ("http://x.org", "x.org", "", None, "allow"),
        7: (None, "", "", None, "allow"),
        8: ("no scheme", "", "", None, "allow"),
        9: ("http://cheap-pills.example.net/en/3?x=/", "cheap-pills.example.net", "/en/3", None, "block"),
        10: ("https://blog.meadow.example.net/en/3", "blog.meadow.example.net", "/en/3", None, "allow"),
        11: ("http://Ünï.org?x://y/z", "Ünï.org", "", None, "allow"),
        12: ("a\nhttp://casino-slots.example.net#x", "casino-slots.example.net", "", None, "block"),
        13: ("http://h.net/" + "path/" * 5000, "h.net", "/" + "path/" * 5000, None, "allow"),
    }
    pages = spark.createDataFrame([(i, c[0], "host", 1.0) for i, c in cases.items()] + [(None, None, None, None)], "page_id long, url string, host string, score double")
    got = urls.judge(pages).collect()
    assert len(got) == len(cases) + 1
    for r in got:
        if r["page_id"] is not None:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == cases[r["page_id"]][1:], r
    assert urls.judge(pages.limit(0)).count() == 0


def test_url_model_on_unseen_hosts():
    bad = ["casino-gold.example.net", "www.cheap-viagra-pills.example.com", "free-bets-win.example.net", "spam-links.example.com"]
    good = ["blog.thander.example.net", "www.ringing.example.com", "library.example.com", "m.ouster.example.net"]
    s = urls.scores(bad + good, ["/en/5"] * 8, urls.fit())
    assert (s[:4] > 0.5).all() and (s[4:] < 0.5).all()


# --- pages


def test_extraction_on_unseen_layouts():
    field = extraction.trained_field()
    right = total = 0
    for html, truth in extraction.labelled_pages(60, seed=321):
        blocks = extraction.blocks_of(html)
        assert [b.text for b in blocks] == [" ".join(t.split()) for t, _ in truth]
        right += sum(a == b for a, (_, b) in zip(field.decode(blocks), truth))
        total += len(truth)
    assert right > 0.98 * total


def test_viterbi_is_the_best_sequence():
    field = extraction.trained_field()
    blocks = extraction.blocks_of("<nav><a>x y</a></nav><p>some words, here.</p><div class=ad>buy</div><article><p>a</p></article><p>b</p>")

    def score(labels):
        e = [field.emission(b) for b in blocks]
        s = field.ends[0, labels[0]] + field.ends[1, labels[-1]] + sum(x[k] for x, k in zip(e, labels))
        return s + sum(field.move[a, b] for a, b in zip(labels, labels[1:]))

    every = [[k >> i & 1 for i in range(len(blocks))] for k in range(1 << len(blocks))]
    assert score(field.decode(blocks)) == pytest.approx(max(map(score, every)))


def test_pages(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        '<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>'
        "<article><h1>Big&amp;small</h1><!-- note --><p>First <b>bold</b>\n  text &lt;here&gt;.<br>Line two"
        '<p>Second.</p><div class="ad">Buy now</div></article>'
        '<section class="comments"><h3>Comments</h3><p>I like it</p></section><form><label>Mail</label></form>'
        "<aside><p>Other things</p></aside><footer>&copy; me</footer></body></html>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<<< &"), (None, None, "<nav>x</nav>"), (5, "u", page.replace("Second.", "word " * 20_000))]
    got = {r["page_id"]: r for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "Big&small First bold text <here>. Line two Second."
    assert got[2]["text"] == got[3]["text"] == got[None]["text"] == "" and got[2]["n_chars"] == 0
    assert len(got) == 6 and got[5]["n_chars"] == len(got[5]["text"]) > 99_000


def test_pages_whole_table(spark):
    """Against the articles of the table's own markup, cut out plainly."""
    import html as entities

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extraction.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        plain = entities.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner)))
        assert got[r["page_id"]] == " ".join(plain.split())


def test_url_labels_hold_no_judged_host(spark):
    """Hosts of the given pages are not in the table, so their verdicts are not memorised."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    named = {urls._labels_of(r["host"]).split(".")[-1] for r in urls.judge(pages).select("host").distinct().collect()}
    known = {a.partition("/")[0].removesuffix(".test").split(".")[-1] for a, _ in urls._LABELLED}
    assert not known & named
