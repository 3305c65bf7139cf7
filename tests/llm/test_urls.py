import math
import re
from collections import Counter

import pytest

from turnout.llm import urls

URLS = ["http://www.Example.com/en/12", "https://example.com/en/", "http://a.example.com/en", "http://com/", "http://com",
        "http://x.com?/a", "http://b.net/es/1#x", "http://b.net/fr/2?q", "HTTP://B.NET/FR/2", "ftp://b.net/fr/77.html",
        "http://b.org/de/5", "http://b.net/en/5", "no host", None, "", "://", "a://b.com://c/d", "http://notcom/",
        "http://xexample.com/en/", "http://b.com:80/", "http://ü.com/ünï\ncode", "http://b.org/de/5"]


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def rule(host, path):
    fits = [(len(n + s), n + s, v) for v, n, s in urls.RULES
            if (host == n or host.endswith("." + n)) and path.startswith(s)]
    return max(fits)[1:] if fits else (None, None)


def brute_ratio(train, order):
    n = [Counter(), Counter()]
    for side, text in train:
        s = "\x02" * order + text + "\x03"
        for i in range(order, len(s)):
            for k in range(order + 1):
                n[side][s[i - k:i + 1]] += 1

    def p(side, gram):
        low = 1 / 256 if len(gram) == 1 else p(side, gram[1:])
        own = [v for g, v in n[side].items() if len(g) == len(gram) and g[:-1] == gram[:-1]]
        return (n[side][gram] + len(own) * low) / (sum(own) + len(own)) if own else low

    def score(text):
        s, total, seen = "\x02" * order + text + "\x03", 0.0, False
        for i in range(order, len(s)):
            for k in range(order, -1, -1):
                g = s[i - k:i + 1]
                if n[0][g] or n[1][g]:
                    total += math.log(p(0, g)) - math.log(p(1, g))
                    seen = True
                    break
        return total / (len(text) + 1) if seen else None

    return score


@pytest.mark.parametrize("piece", [urls.PIECE, 7])
def test_judged_equals_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(urls, "PIECE", piece)
    rows = [(i, u, "gone", 7.0, "gone", "kept") for i, u in enumerate(URLS)]
    out = urls.judged(spark.createDataFrame(rows, "page_id long, url string, host string, score double, rule string, _text string"), order=2).collect()
    assert {r._text for r in out} == {"kept"}
    assert len(out) == len(URLS)
    train = []
    for u in URLS:
        host, path = parts(u)
        v = rule(host, path)[1]
        if v:
            train.append((0 if v == "allow" else 1, re.sub("[0-9]", "0", u)))
    score = brute_ratio(train, 2)
    for r in out:
        host, path = parts(URLS[r.page_id])
        assert (r.host, r.path) == (host, path)
        assert r.rule == rule(host, path)[0]
        own = score(re.sub("[0-9]", "0", URLS[r.page_id] or ""))
        assert r.score == (None if own is None else pytest.approx(own))
        assert r.verdict in ("allow", "block") and (r.rule is None or r.verdict == rule(host, path)[1])


def test_without_training(spark):
    frame = lambda *u: spark.createDataFrame([(x,) for x in u], "url string")
    assert urls.judged(frame()).count() == 0
    assert [r.verdict for r in urls.judged(frame("http://b.org/", None)).collect()] == ["allow", "allow"]


def test_very_long_urls_and_one_row_for_each_character(spark):
    long = "http://b.org/" + "ab/ü" * 20000
    frame = spark.createDataFrame([(long,), ("http://www.example.com/en/",), ("http://b.net/es/",), ("",)], "url string")
    texts = frame.withColumnRenamed("url", "text")
    grams = urls._grams(texts, urls.ORDER)
    assert grams.count() == sum(len(r.url) + 1 for r in frame.collect())
    assert {len(r.gram) for r in grams.select("gram").distinct().collect()} == {urls.ORDER + 1}
    out = {r.url: r for r in urls.judged(frame).collect()}
    assert out[long].score is not None and out["http://b.net/es/"].verdict == "block"
