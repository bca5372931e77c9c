import random
import re

import numpy as np

from kinora.llm import urls
from kinora.llm.queries import URL_RULES

LOWER = {c: c + 32 for c in range(65, 91)}


def plain(url):
    """Host, path, rule and verdict straight from the definition."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url[url.index("://") + 3 :]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    name, tail = rest[:cut].translate(LOWER), rest[cut:]
    where = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(h + p, v) for v, h, p in URL_RULES if (name == h or name.endswith("." + h)) and where.startswith(p)]
    best = max(fits, key=lambda f: len(f[0]), default=(None, None))
    return name, where, *best


def fixture():
    rng = random.Random(6)
    out = [None, "", "no scheme", "://", "http://", "http://COM/", "http://com", "http://xcom/", "http://a.com?x=/", "HTTP://WWW.Example.COM/en/1", "http://m.www.example.com/en/", "http://example.com/en/x#y", "http://a.example.com/en/a://b", "http://net/es/", "http://u@x.net:80/es/", "x\n://a.net/fr/\n?q", "http://bücher.net/fr/", "http://É.com/"]
    for _ in range(600):
        name = ".".join(rng.choice(["a", "www", "m", "example", "spam-x", "b7"]) for _ in range(rng.randint(1, 3))) + "." + rng.choice(["com", "net", "org", "example.com"])
        out.append(f"http{rng.choice(['', 's'])}://{name}/{rng.choice(['en', 'es', 'fr', 'de', ''])}{rng.choice(['', '/', '/7', '/x?a=1&b=2', '#t', '?q=/es/'])}")
    return out


def test_rules_equal_a_plain_version_and_the_rest_is_judged(spark):
    found = fixture() + ["http://a.org/en/1", "http://a.org/en/1"]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(found)] + [(None, "http://a.net/es/", "x")], "page_id long, url string, rule string")
    got = urls.judge(pages, URL_RULES).collect()
    assert len(got) == len(found) + 1
    for r in got:
        name, where, rule, verdict = plain(found[r.page_id] if r.page_id is not None else "http://a.net/es/")
        assert (r.host, r.path, r.rule) == (name, where, rule)
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow")) and 0 <= r.score <= 1


def test_trees_learn_lexical_features_on_held_out_urls():
    rng = random.Random(1)
    good = [f"https://www.{''.join(rng.choice('abcdefgh') for _ in range(8))}.org/en/{rng.randint(1, 99)}" for _ in range(600)]
    bad = [f"http://{''.join(rng.choice('abc0123456789-') for _ in range(14))}.biz/x/y/{rng.randint(1, 9)}?a=1&b=2&c={rng.randint(1, 9)}" for _ in range(600)]
    model = urls.train(good[:400] + bad[:400], [0] * 400 + [1] * 400)
    assert (model.block_probability(good[400:]) < 0.5).mean() > 0.97 and (model.block_probability(bad[400:]) > 0.5).mean() > 0.97


def test_boosting_fits_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.5)).astype(float)
    p = urls.Boosting().fit(x[:2000], y[:2000]).probability(x[2000:])
    assert ((p > 0.5) == (y[2000:] > 0.5)).mean() > 0.97


def test_nothing_labelled_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.org/"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in urls.judge(pages, URL_RULES).collect()} == {"allow"}
    assert urls.judge(pages.limit(0), URL_RULES).count() == 0
    assert urls.train(["http://a.net/es/"] * 30, [1] * 30).block_probability(["http://b.net/es/", None]).min() > 0.5


def test_path_pattern_finds_the_first_scheme_mark():
    assert re.match(urls._PARTS, "a://b/c://d")[1] == "b"
