"""URL filters: pattern rules found by their rarest literal token.

There are two kinds of rules, each with the verdict ``block`` or ``allow``.

* Site rules, ``host/path``: the host and all its subdomains, if the path of the url starts with that of the
  rule. Of several the longest wins, then the one with the longer host, then ``block``, then the greater text. Without a
  slash, or with nothing after the host, every path is meant.
* Pattern rules, for urls that no site rule fits. A pattern occurs anywhere in the url, lower-cased from A to Z. ``*``
  stands for anything, ``^`` for the end or a character that is no letter, digit, ``_``, ``-``, ``.`` or ``%``; ``|``
  at the front or back means the start or end of the url, ``||`` at the front the start of the host or of one of its labels. One
  that allows overrules all that block; the smallest text is reported. A url that nothing fits is allowed.

A token is a run of ASCII letters and digits. A rule is entered once, under that token of its own which the fewest urls
hold, counted over all urls; only tokens that a fitting url must hold as a whole count, and a rule without one is entered under
the empty token, which every url has. The tokens of a url fetch its candidates, and only they run
their regular expressions. Stretches between stars are looked for one after the other, so a
rule takes linear time on any url.

Up to ``most_sent`` rules are sent to all tasks, and each url is judged where it is, without a shuffle. More rules are
joined with the tokens of the different urls. Both give the same rows.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, lower-cased from A to Z; the path goes on
from there up to ``?``, ``#`` or the end. Without ``://``, and for a null url, both are empty and patterns alone apply. Rules that
are null or blank are left out. Each row gives one row; rows that repeat give repeated results. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffmart.llm.common import values
from staffmart.operators.lookup import join_found
from staffmart.sources.tables import materialise

MOST_SENT = 100_000
BLOCK, ALLOW = "block", "allow"
SITE, PATTERN = "site", "pattern"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)
_TOKEN = re.compile("[a-z0-9]+")
_BREAK = "(?:[^0-9a-z_.%-]|\\Z)"

# Addresses that seldom hold prose: adverts, trackers, log-ins, baskets, searches, programs, gambling, adult sites.
PATTERNS = [
    ("/ads/", BLOCK), ("||ads.", BLOCK), ("||doubleclick.", BLOCK), ("^utm_source=", BLOCK), ("^gclid=", BLOCK),
    ("^sessionid=", BLOCK), ("/cgi-bin/", BLOCK), ("/wp-login.", BLOCK), ("/login^", BLOCK), ("/signup^", BLOCK),
    ("/cart^", BLOCK), ("/search^*q=", BLOCK), (".exe|", BLOCK), (".apk|", BLOCK), (".zip|", BLOCK), ("^casino^", BLOCK),
    ("^porn^", BLOCK), ("^xxx^", BLOCK), ("||edu^", ALLOW), ("||gov^", ALLOW)]


def fold(url: str) -> str:
    return url.translate(_FOLD)


def host_and_path(url: str) -> tuple[str, str]:
    start = url.find("://")
    if start < 0:
        return "", ""
    rest = re.split("[?#]", url[start + 3:], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return fold(host), slash + path


@dataclass
class Rule:
    """A rule ready to run; ``parts`` are the stretches between stars."""

    kind: str
    text: str
    verdict: str
    parts: list[re.Pattern] = field(default_factory=list)
    at_host: bool = False
    at_start: bool = False
    tokens: set[str] = field(default_factory=set)

    @property
    def weight(self) -> tuple:
        """The greatest of the rules that fit decides."""
        if self.kind == SITE:
            return len(self.text), len(self.text.split("/")[0]), self.verdict == BLOCK, self.text
        return self.verdict == ALLOW, [-ord(c) for c in self.text] + [1]

    def fits(self, url: str, host: str, path: str) -> bool:
        """``url`` is lower-cased, ``path`` is not."""
        if self.kind == SITE:
            return self.parts[0].match(host + path) is not None
        at = url.find("://") + 3 if self.at_host else 0
        if self.at_host and at < 3:
            return False
        for k, part in enumerate(self.parts):
            found = part.match(url, at) if k == 0 and (self.at_host or self.at_start) else part.search(url, at)
            if found is None:
                return False
            at = found.end()
        return True


def _whole_tokens(text: str, left: bool, right: bool) -> set[str]:
    """Tokens of a stretch that cannot be part of a longer one; ``left`` and ``right``: whether its ends are borders."""
    return {m.group() for m in _TOKEN.finditer(text) if (m.start() > 0 or left) and (m.end() < len(text) or right)}


def compiled(kind: str, text: str, verdict: str) -> Rule:
    rule = Rule(kind, text, verdict)
    if kind == SITE:
        host, slash, path = text.partition("/")
        host, path = fold(host), slash + path
        rule.parts = [re.compile(r"(?:[^/]*\.)?" + re.escape(host) + (re.escape(path) if path else r"(?=/|\Z)"))]
        rule.tokens = _whole_tokens(host, True, True) | _whole_tokens(fold(path), True, False)
        return rule
    body = fold(text)
    rule.at_host = body.startswith("||")
    rule.at_start = not rule.at_host and body.startswith("|")
    body = body[2 * rule.at_host + rule.at_start:]
    at_end = body.endswith("|")
    stretches = (body[:-1] if at_end else body).split("*")
    for k, stretch in enumerate(stretches):
        first, last = k == 0, k == len(stretches) - 1
        pattern = _BREAK.join(re.escape(piece) for piece in stretch.split("^"))
        if first and rule.at_host:
            pattern = r"(?:[^/?#]*?\.)??" + pattern
        # The last stretch must reach the end, so it is looked for there; the others as early as they can be.
        rule.parts.append(re.compile(pattern + (r"\Z" if last and at_end else "")))
        rule.tokens |= _whole_tokens(stretch, first and (rule.at_host or rule.at_start), last and at_end)
    return rule


def decided(fitting: list[Rule]) -> tuple[str | None, str, str | None]:
    """The site rule, the verdict and the pattern that decide."""
    sites = [r for r in fitting if r.kind == SITE]
    if sites:
        best = max(sites, key=lambda r: r.weight)
        return best.text, best.verdict, None
    best = max(fitting, key=lambda r: r.weight, default=None)
    return (None, best.verdict, best.text) if best else (None, ALLOW, None)


def _tokens(url: str) -> Column:
    """Different tokens of a url, with the empty one that every url has."""
    bare = F.translate(url, _UPPER, _LOWER)
    return F.array_distinct(F.concat(F.split(bare, "[^a-z0-9]+"), F.array(F.lit(""))))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every rule once for each token it may be entered under."""
    for batch in batches:
        rows = [(*given, token) for given in zip(*(values(batch, c).to_pylist() for c in ("kind", "text", "verdict")))
                for token in compiled(*given).tokens or [""]]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)],
                                         names=["kind", "text", "verdict", "token"])


def _rule_rows(sites: DataFrame, patterns: DataFrame) -> DataFrame:
    both = None
    for kind, rules in ((SITE, sites), (PATTERN, patterns)):
        own = rules.select(F.lit(kind).alias("kind"), F.trim(F.col("rule")).alias("text"), "verdict")
        own = own.where((F.length("text") > 0) & F.col("verdict").isin(BLOCK, ALLOW))
        both = own if both is None else both.unionByName(own)
    return both.distinct()


def rule_index(pages: DataFrame, sites: DataFrame, patterns: DataFrame, most_sent: int = MOST_SENT) -> tuple[DataFrame, int]:
    """(kind, text, verdict, token) with the rarest token of each rule, and how many rules there are."""
    entries = materialise(_rule_rows(sites, patterns).mapInArrow(
        _entries, "kind string, text string, verdict string, token string"), "rules")
    rules = entries.select("kind", "text", "verdict").distinct().count()
    wanted = entries.select("token").distinct()
    found = pages.select(F.explode(_tokens("url")).alias("token"))
    if rules <= most_sent:
        counts = found.join(F.broadcast(wanted), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    else:
        counts = found.groupBy("token").agg(F.count(F.lit(1)).alias("urls")).join(wanted, "token", "left_semi")
    best = F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token"))
    index = join_found(entries, counts, "token").groupBy("kind", "text", "verdict").agg(best.alias("best"))
    return materialise(index.select("kind", "text", "verdict", F.col("best.token").alias("token")), "index"), rules


_JUDGED = "page_id {}, url string, host string, path string, rule string, verdict string, pattern string"


def _judge(sent) -> Callable:
    """Rows judged by the rules that their tokens fetch; ``sent`` has the rules by token."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[str, list[Rule]] = {}
        for kind, text, verdict, token in sent.value:
            index.setdefault(token, []).append(compiled(kind, text, verdict))
        for batch in batches:
            out = []
            for url in values(batch, "url").to_pylist():
                host, path = host_and_path(url)
                bare = fold(url)
                near = [r for token in {"", *_TOKEN.findall(bare)} for r in index.get(token, ())]
                out.append((host, path, *decided([r for r in near if r.fits(bare, host, path)])))
            yield pa.RecordBatch.from_arrays(
                [values(batch, "page_id"), values(batch, "url"), *(pa.array([r[k] for r in out], pa.string()) for k in range(5))],
                names=["page_id", "url", "host", "path", "rule", "verdict", "pattern"])
    return run


def _fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates whose regular expressions find something."""
    known: dict[tuple, Rule] = {}
    for batch in batches:
        keep = []
        for url, *given in zip(*(values(batch, c).to_pylist() for c in ("url", "kind", "text", "verdict"))):
            if len(known) > MOST_SENT:
                known.clear()
            rule = known.get(tuple(given)) or known.setdefault(tuple(given), compiled(*given))
            keep.append(rule.fits(fold(url), *host_and_path(url)))
        yield batch.filter(pa.array(keep, pa.bool_()))


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [decided([compiled(r["kind"], r["text"], r["verdict"]) for r in own or []])
                for own in values(batch, "fitting").to_pylist()]
        split = [host_and_path(url) for url in values(batch, "url").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [values(batch, "page_id"), values(batch, "url"), *(pa.array([r[k] for r in split], pa.string()) for k in range(2)),
             *(pa.array([r[k] for r in rows], pa.string()) for k in range(3))],
            names=["page_id", "url", "host", "path", "rule", "verdict", "pattern"])


def _best(kind: str, order: Column, low: bool = False) -> Column:
    """The one rule of a kind that may decide; an aggregate that combines before the shuffle."""
    choose = F.min_by if low else F.max_by
    one = choose(F.struct("kind", "text", "verdict"), F.when(F.col("kind") == kind, order))
    return F.when(F.count_if(F.col("kind") == kind) > 0, one)


def judge(pages: DataFrame, sites: DataFrame, patterns: DataFrame | None = None, most_sent: int = MOST_SENT) -> DataFrame:
    """page_id, url, host, path, rule, verdict, pattern for each row of ``pages`` (page_id, url).

    ``sites`` and ``patterns`` hold rule and verdict; ``PATTERNS`` by default. A null url comes back empty.
    """
    spark = pages.sparkSession
    if patterns is None:
        patterns = spark.createDataFrame(PATTERNS, "rule string, verdict string")
    given = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    schema = _JUDGED.format(dict(given.dtypes)["page_id"])
    index, rules = rule_index(given, sites, patterns, most_sent)
    if rules <= most_sent:
        rows = [tuple(r) for r in index.collect()]
        return given.mapInArrow(_judge(spark.sparkContext.broadcast(rows)), schema)
    urls = given.select("url").distinct().withColumn("token", F.explode(_tokens("url")))
    candidates = join_found(urls, index, "token").where("kind is not null").select("url", "kind", "text", "verdict")
    fitting = candidates.mapInArrow(_fitting, "url string, kind string, text string, verdict string")
    site_order = F.struct(F.length("text"), F.length(F.substring_index("text", "/", 1)), F.col("verdict") == BLOCK, F.col("text"))
    pattern_order = F.struct(F.col("verdict") == BLOCK, F.col("text"))
    found = fitting.groupBy("url").agg(F.array_compact(F.array(
        _best(SITE, site_order), _best(PATTERN, pattern_order, low=True))).alias("fitting"))
    return join_found(given, found, "url").select("page_id", "url", "fitting").mapInArrow(_choose, schema)
