import random

import pytest

from staffmart.llm import urls as M

SITES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"),
         ("example.org", "block"), ("a.net/x", "allow"), ("b.a.net/", "block"), ("net/", "allow"), (" ", "block"), (None, "block"), ("x/", None)]
LETTERS = "ab.-/?=&_ é"


def frame(spark, rows, schema="rule string, verdict string"):
    return spark.createDataFrame(rows, schema)


def separator(c):
    return not (c.isascii() and (c.isalnum() or c in "_-.%")) if c else True


def glob(pattern, text, at):
    """Whether the pattern, which may hold ^ and *, matches at a place; tried in every way. Returns all ends."""
    if not pattern:
        return {at}
    if pattern[0] == "*":
        return {e for k in range(at, len(text) + 1) for e in glob(pattern[1:], text, k)}
    if pattern[0] == "^":
        ends = glob(pattern[1:], text, at + 1) if at < len(text) and separator(text[at]) else set()
        return ends | (glob(pattern[1:], text, at) if at == len(text) else set())
    return glob(pattern[1:], text, at + 1) if text[at:at + 1] == pattern[0] else set()


def plain(url, sites, patterns):
    """Every rule against the url, without index or regular expressions."""
    host = path = ""
    bare = "".join(c.lower() if c.isascii() else c for c in url or "")
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3:]
        cut = min([rest.index(c) for c in "?#" if c in rest] + [len(rest)])
        host, path = rest[:cut].split("/", 1)[0], rest[:cut][len(rest[:cut].split("/", 1)[0]):]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for rule, verdict in sites:
        if not (rule or "").strip() or verdict is None:
            continue
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            best = max(best or (), (len(rule), len(h), verdict == "block", rule))
    if best:
        return host, path, best[3], "block" if best[2] else "allow", None
    found = []
    for rule, verdict in patterns:
        body, start = rule, range(len(bare) + 1)
        if body.startswith("||"):
            body, at = body[2:], bare.find("://") + 3
            start = [] if at < 3 else [at] + [k + 1 for k in range(at, len(bare)) if bare[k] == "." and not set("/?#") & set(bare[at:k])]
        elif body.startswith("|"):
            body, start = body[1:], [0]
        end = body.endswith("|")
        body = body[:-1] if end else body
        if any(not end or len(bare) in glob(body, bare, k) for k in start if glob(body, bare, k)):
            found.append((verdict != "allow", rule))
    return (host, path, None, "block" if min(found)[0] else "allow", min(found)[1]) if found else (host, path, None, "allow", None)


def some_urls(count):
    rng = random.Random(5)
    hosts = ["example.net", "EXAMPLE.com", "www.example.org", "a.net", "c.b.a.net", "ads.x.de", "x.edu", "y.edu.de", "ab", "", "a.b:80", "loads.de"]
    out = [None, "", "no scheme", "://", "http://", "http://net", "http://net/", "http://a.net?x", "HTTP://A.NET/X", "http://a.net/x#y", "x://é.net/é"]
    for _ in range(count):
        tail = "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 9)))
        out.append(rng.choice(["http://", "https://", ""]) + rng.choice(hosts) + rng.choice(
            ["/", "/en/", "/de/x", "/fr/?utm_source=f", "/ads/", "/ads", "/x.exe", "/casino", "?xxx=", "/search?a=1&q=2", ""]) + tail)
    return out


def some_patterns():
    rng = random.Random(6)
    made = {rng.choice(["", "|", "||"]) + "".join(rng.choice(LETTERS.replace(" ", "^*")) for _ in range(rng.randint(1, 4))) + rng.choice(["", "|"])
            for _ in range(60)}
    return M.PATTERNS + [("||a*b", "block"), ("*", "block")] + [(p, rng.choice(["block", "allow"])) for p in sorted(made) if p.strip("|")]


@pytest.mark.parametrize("patterns", [M.PATTERNS, None])
@pytest.mark.parametrize("most_sent", [M.MOST_SENT, 0])
def test_brute_force(spark, patterns, most_sent):
    patterns = patterns or some_patterns()
    urls = some_urls(300)
    pages = frame(spark, list(enumerate(urls)), "page_id long, url string")
    got = M.judge(pages, frame(spark, SITES), frame(spark, patterns), most_sent).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict, r.pattern) for r in got} == {
        k: plain(u, SITES, patterns) for k, u in enumerate(urls)}
    assert len(got) == len(urls)


@pytest.mark.parametrize("most_sent", [M.MOST_SENT, 0])
def test_awkward_rows(spark, most_sent):
    long = "http://example.net/" + "en/" * 500_000
    rows = [(1, None, "h", "v"), (None, "http://x.net/", "h", "v"), (2, "", "h", "v"), (3, long, "h", "v"),
            (4, "http://x.net/", "h", "v"), (4, "http://x.net/", "h", "v"), (5, "a" * 1_000_000, "h", "v")]
    pages = frame(spark, rows, "page_id long, url string, host string, verdict string")
    got = M.judge(pages, frame(spark, SITES[:4]), most_sent=most_sent).collect()
    assert sorted((r.page_id or 0, r.rule or "", r.verdict) for r in got) == [
        (0, "net/", "block"), (1, "", "allow"), (2, "", "allow"), (3, "example.net/en/", "allow"),
        (4, "net/", "block"), (4, "net/", "block"), (5, "", "allow")]
    assert M.judge(pages.limit(0), frame(spark, SITES), most_sent=most_sent).count() == 0
    none = frame(spark, [])
    assert {(r.rule, r.verdict) for r in M.judge(pages, none, none, most_sent).collect()} == {(None, "allow")}


def test_a_rule_is_entered_under_its_rarest_token(spark):
    pages = frame(spark, [(k, f"http://common.com/rare{k}/common") for k in range(20)] + [(98, "http://other.com"), (99, "http://common.com/seldom/")], "page_id long, url string")
    index, rules = M.rule_index(pages, frame(spark, [("common.com/seldom/", "block"), ("common.com/", "block")]), frame(spark, [("oad", "block")]))
    assert rules == 3
    assert {r.text: r.token for r in index.collect()} == {"common.com/seldom/": "seldom", "common.com/": "common", "oad": ""}


def test_only_candidates_run_regular_expressions(monkeypatch):
    tried = []
    rule = M.compiled(M.SITE, "example.net/en/", "allow")
    monkeypatch.setattr(M.Rule, "fits", lambda self, *a: tried.append(a) or False)
    monkeypatch.setattr(M, "compiled", lambda *a: rule)
    sent = type("Sent", (), {"value": [(M.SITE, "example.net/en/", "allow", "example")]})
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"page_id": [1, 2], "url": ["http://example.net/", "http://other.net/en/"]})
    list(M._judge(sent)([batch]))
    assert [a[0] for a in tried] == ["http://example.net/"]
