import functools
import math

from strandloom.llm import url_filter as U

URLS = {
    "https://WWW.Example.com/en/1?x": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
    "http://a.example.com/en/2#t": ("a.example.com", "/en/2", "example.com/en/", "block"),
    "http://example.com/fr/": ("example.com", "/fr/", "com/", "allow"),
    "http://notexample.com/en/x": ("notexample.com", "/en/x", "com/", "allow"),
    "https://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"),
    "https://x.net/fr/1": ("x.net", "/fr/1", "net/fr/", "block"),
    "https://x.com": ("x.com", "", None, None),
    "https://x.com?a=://b.net/es/": ("x.com", "", None, None),
    "://net/es/": ("net", "/es/", "net/es/", "block"),
    "nothing": ("", "", None, None),
    "http://h\nost/\np": ("h\nost", "/\np", None, None),
    "": ("", "", None, None),
}


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(99, None, "h"), (None, "https://É.ORG/É", "h")]
    got = {r.page_id: r for r in U.judge(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()}
    assert len(got) == len(rows)
    for i, (host, path, rule, verdict) in enumerate(URLS.values()):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert (got[99].host, got[99].verdict) == ("", got[11].verdict) and got[None].host == "É.org"


def test_held_out_urls():
    fold = lambda i: i % 4 == 1
    w = U.fit([x for i, x in enumerate(U.LABELLED) if not fold(i)])
    held = [x for i, x in enumerate(U.LABELLED) if fold(i)]
    row, slot, value = U.features([U.judged(*U.split(u)) for _, u in held])
    z = U.np.bincount(row, value * w[slot], len(held)) + w[-1]
    assert sum((s > 0) == bool(y) for s, (y, _) in zip(z, held)) / len(held) >= 0.75


def plain_parts(url):
    """Host and path, letter by letter."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]


def plain_rule(host, path):
    fits = [(len(h), len(p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


@functools.cache
def slot(gram):
    return int(U.C.SpanHash(U.np.frombuffer(gram, U.np.uint8), seed=2).of(U.np.array([0]), U.np.array([len(gram)]))[0] >> U.np.uint64(64 - U.BITS))


def plain_score(host, path, w):
    """The regression of one url, n-gram by n-gram."""
    raw = U.judged(host, path)
    slots = {slot(raw[i : i + n]) for n in U.ORDERS for i in range(len(raw) - n + 1)}
    return 1 / (1 + math.exp(-(sum(w[s] for s in slots) / max(1, len(slots)) ** 0.5 + w[-1])))


def test_query_equals_brute_force(spark):
    """All pages of the smallest tables, and odd urls."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    urls = [None, "", "x", *URLS, *[u for _, u in U.LABELLED], "a://" + "long." * 4000 + "net/fr/" + "p/" * 4000, "http://h/?q", "http:///en/", "://"]
    odd = spark.createDataFrame([(10**6 + i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string")
    every = pages.select("page_id", "url", "html").union(odd)
    got = {r.page_id: r for r in U.judge(every).collect()}
    w, rows = U.model(), every.select("page_id", "url").collect()
    assert len(got) == len(rows)
    for r in rows:
        host, path = plain_parts(r.url)
        rule, verdict = plain_rule(host, path)
        score = plain_score(host, path, w)
        g = got[r.page_id]
        assert (g.host, g.path, g.rule) == (host, path, rule) and abs(g.score - score) < 1e-9
        assert g.verdict == (verdict or ("block" if score >= 0.5 else "allow"))


def test_no_pages(spark):
    assert U.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
