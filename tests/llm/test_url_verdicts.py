"""URL verdicts against the whole method in plain Python."""

import math
import re
import time
from collections import Counter

from colloquy.llm import url_filter


def tags(html):
    return re.sub(r"<(script|style)\b.*?</\1\s*>|<[^>]*>", " ", html.lower(), flags=re.S)


def best_split(run, counts, total):
    unknown = math.log(total + 1) + math.log(10)
    best = [(0.0, [])]
    for end in range(1, len(run) + 1):
        ways = []
        for begin in range(max(0, end - url_filter.LONGEST_WORD), end):
            word = run[begin:end]
            if word in counts:
                ways.append((best[begin][0] + math.log(counts[word]) - math.log(total), -begin, word))
            elif len(word) == 1:
                ways.append((best[begin][0] - unknown, -begin, word))
        gain, begin, word = max(ways)
        best.append((gain, [*best[-begin][1], word]))
    return best[-1][1]


def brute(pages):
    counts = Counter(w for _, _, html in pages for w in re.findall("[a-z]+", tags(html or "")) if len(w) <= 20)
    total = sum(counts.values())
    judged = []
    for _, url, _ in pages:
        scheme, mark, rest = (url or "").partition("://")
        whole = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(whole):], maxsplit=1)[0]
        host = whole.lower()
        fits = [x for x in url_filter.RULES if (host == x[1] or host.endswith("." + x[1])) and path.startswith(x[2])]
        rule = max(fits, key=lambda x: len(x[1] + x[2])) if fits else None
        runs = re.findall(r"[a-z]+|\d+|[^\x00-\x7f]+", f"{host} {path.lower()}")
        tokens = [t for r in runs for t in (best_split(r, counts, total) if r[0] in "abcdefghijklmnopqrstuvwxyz" else ["0" * len(r)] if r[0].isdigit() else [r])]
        judged.append((host, rule, Counter(tokens)))
    sums = {v: Counter() for v in ("block", "allow")}
    for _, rule, tokens in judged:
        if rule:
            sums[rule[0]].update(tokens)
    kinds = len(set(sums["block"]) | set(sums["allow"]))
    urls = Counter(rule[0] for _, rule, _ in judged if rule)
    odds = lambda t: math.log((sums["block"][t] + 1) / (sums["block"].total() + kinds + 1)) - math.log((sums["allow"][t] + 1) / (sums["allow"].total() + kinds + 1))
    out = []
    for host, rule, tokens in judged:
        score = math.log(urls["block"] / urls["allow"]) + sum(n * odds(t) for t, n in tokens.items()) if tokens else 0.0
        out.append((rule[0] if rule else "block" if host and score >= url_filter.MARGIN else "allow", tokens, None if rule or not tokens else score))
    return out


def test_verdicts(spark):
    body = "<p>casino poker news shoe store book</p><script>x < y casino</script><style>a</style> 5 < 6 book"
    urls = [f"http://casinopoker{k}.com/en/{k}/casino/casino" for k in range(9)] + [f"http://newsbook.net/de/{k}/store" for k in range(7)]
    urls += ["http://casino.info/casino/casino/casino", "http://casino.info/casino", "http://newsstore.info/book/77", "http://ünï.info/bücher/9", "http://a.info/", None, "x", "://", "http://poker.info/?casino"]
    urls += ["http://casino.info/casino/casino/casino", "http://" + "pokernews" * 20 + ".org/x"]
    pages = [(k, u, body if k % 3 else None) for k, u in enumerate(urls)]
    found = {x.page_id: x for x in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()}
    expected = brute(pages)
    assert len(found) == len(pages) and {x[0] for x in expected} == {"allow", "block"}
    for (k, url, _), (verdict, tokens, score) in zip(pages, expected):
        assert (found[k].verdict, Counter(found[k].tokens)) == (verdict, tokens), url
        assert score is None or abs(found[k].block_odds - score) < 1e-9
    assert found[16].tokens.count("casino") == 4 and found[16].block_odds > found[17].block_odds


def test_text_of_pages_in_linear_time():
    for html in ("<script>a</script x>b</style><p", "a<b<c>d", "<style><script></style>x</script>y", "<scripts>a</script>", "<STYLE>a</style\n>b <script>c", "", "a"):
        assert url_filter.plain_text(html).split() == tags(html).split(), html
    begin = time.monotonic()
    for noise in ("<script" * 150_000, "<" * 1_000_000, "<script>" * 130_000, "<style></style" * 70_000, "</script " * 100_000):
        url_filter.plain_text(noise)
    assert time.monotonic() - begin < 10


def test_a_run_of_a_hundred_thousand_letters(spark):
    run = "shoestore" * 11_000
    pages = spark.createDataFrame([(1, f"http://a.info/{run}", "shoe store shoe"), (2, "http://b.net/de/shoe", "store")], "page_id long, url string, html string")
    found = {x.page_id: x.tokens for x in url_filter.judge_urls(pages).collect()}
    assert Counter(found[1]) == {"shoe": 11_000, "store": 11_000, "a": 1, "i": 1, "n": 1, "f": 1, "o": 1}
