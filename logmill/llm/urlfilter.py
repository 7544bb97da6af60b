"""URL filters: pattern rules indexed by their rarest literal token.

A rule has a pattern in the syntax of filter lists: ``*`` stands for anything, ``^`` for a separator or the end,
a leading ``||`` anchors at a host name label, a leading or trailing ``|`` at the start or the end.  ``^`` takes the end of
a name, so a label with others to follow is ``||label.``, and ``||label-`` one that a hyphen continues.  A *token* is a
maximal run of ``[a-z0-9]`` in the lower-cased URL.  A literal token of a pattern is complete when
neither of its ends can be extended by what a match may put there, so that every URL that matches has the token.
Each rule is filed under the one of its complete tokens that fewest URLs of the whole table contain; a
URL's tokens fetch the candidate rules and only those run their regular expression.  Rules without a complete token are
candidates for every URL.

Rules are a list in the program (hundreds, not data), so the index is small whatever the input; token counts are
aggregated on the executors for the tokens of the rules alone.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.llm.base import arrow_map

_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    rule_id: int
    action: str
    pattern: str


_BLOCK = """
||spam-farm.example.org^
||spam-farm.
||content-farm.
||linkfarm.
||ads.*^
||ad.*^
||adserver.
||adservice.
||doubleclick.
||googlesyndication.
||tracking.*^
||tracker.*^
||pixel.*^
||click.*^
||affiliate.*^
||casino.
||poker.
||betting.
||gambling.
||porn.
||xxx.
||adult.
||escort.
||viagra.
||pharma-online.
||payday.
||loans.
||warez.
||torrent.
||crack.
||keygen.
||phishing.
||malware.
||proxy.
||paste.
||pastebin.
||bit.ly^
||tinyurl.com^
||t.co^
||localhost^
||127.0.0.1^
/wp-login.php
/wp-admin/
/xmlrpc.php
/administrator/
/phpmyadmin/
/cgi-bin/
/.git/
/.env|
/login|
/login?
/signin
/signup
/register|
/logout
/password-reset
/account/
/cart|
/checkout/
/basket/
/wishlist/
/compare/
/print/
/share?
/tag/
/tags/
/author/
/feed|
/feed/
/rss|
/atom.xml
/sitemap.xml
/robots.txt
/search?
/search/
/calendar/
/archive/*/page/
/amp|
/amp/
/embed/
/trackback/
/comment-page-
/replytocom=
?replytocom=
?sessionid=
&sessionid=
?phpsessid=
&phpsessid=
?jsessionid=
;jsessionid=
?sid=
&sid=
?action=edit
?action=history
?printable=yes
?share=
&share=
?print=1
?format=pdf
.exe|
.zip|
.rar|
.iso|
.dmg|
.apk|
.mp3|
.mp4|
.avi|
.jpg|
.jpeg|
.png|
.gif|
.css|
.js|
.swf|
|ftp://
|javascript:
|mailto:
|data:
||ads-
||spam-farm-
||content-farm-
||linkfarm-
||adserver-
||adservice-
||doubleclick-
||googlesyndication-
||casino-
||poker-
||betting-
||gambling-
||porn-
||xxx-
||adult-
||escort-
||viagra-
||pharma-online-
||payday-
||loans-
||warez-
||torrent-
||crack-
||keygen-
||phishing-
||malware-
||proxy-
||paste-
||pastebin-
||free-bets.
||free-bets-
||cheap-pills.
||cheap-pills-
"""
_ALLOW = """
||docs.*^
||wiki.*^
||en.wikipedia.org^
||arxiv.org^
||archive.org^
||gutenberg.org^
.gov/
.edu/
/docs/
/wiki/
/paper/
/abstract/
"""
_FLAG = """
?utm_source=
&utm_source=
?utm_medium=
&utm_medium=
?utm_campaign=
&utm_campaign=
?fbclid=
?gclid=
?ref=
&ref=
?page=
&page=
?amp=
/page/
||m.
||mobile.
||blog.
||forum.
||shop.
||www.
#top|
#comments|
#*
.html|
.htm|
.php|
.asp|
|http://
/index.html
"""
RULES = [Rule(i, action, p) for i, (action, p) in enumerate((a, p) for a, block in (("allow", _ALLOW), ("block", _BLOCK), ("flag", _FLAG)) for p in block.split())]
# An allow rule stands before any block rule and that before any flag: the order of the list is the priority.


def to_regex(pattern: str) -> str:
    """The regular expression of a pattern, over the lower-cased URL, in syntax that RE2 has too."""
    head, tail, body = "", "", pattern
    if body.startswith("||"):
        head, body = r"^[a-z][a-z0-9+.\-]*://([^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        head, body = "^", body[1:]
    if body.endswith("|"):
        tail, body = "$", body[:-1]
    out = []
    for c in body:
        out.append(".*" if c == "*" else r"([^a-z0-9_.%\-]|\.|$)" if c == "^" else c if c.isalnum() else "\\" + c)
    return head + "".join(out) + tail


def complete_tokens(pattern: str) -> list[str]:
    """The tokens that every URL with a match has."""
    body, left, right = pattern, False, False
    if body.startswith("||") or body.startswith("|"):
        left, body = True, body.lstrip("|")
    if body.endswith("|"):
        right, body = True, body[:-1]
    out = []
    for m in _TOKEN.finditer(body):
        a, b = m.span()
        before = left if a == 0 else body[a - 1] not in "*"
        after = right if b == len(body) else body[b] not in "*"
        if before and after:
            out.append(m[0])
    return out


def build_index(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Positions of rules by rarest token (ties: the longer, then the lesser token); those without one apart."""
    index, rest = defaultdict(list), []
    for i, r in enumerate(rules):
        tokens = complete_tokens(r.pattern)
        if tokens:
            index[min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t))].append(i)
        else:
            rest.append(i)
    return dict(index), rest


def token_counts(pages: DataFrame, tokens: set[str]) -> dict[str, int]:
    """In how many rows' URLs each of ``tokens`` occurs, over the whole table."""
    if not tokens:
        return {}
    url = F.lower(F.col("url").cast("string"))
    found = F.array_intersect(F.split(url, "[^a-z0-9]+"), F.array(*[F.lit(t) for t in sorted(tokens)]))
    rows = pages.select(F.explode(found).alias("token")).groupBy("token").count().collect()
    return {r.token: r["count"] for r in rows}


def apply_rules(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(page_id, action, rule_id, matches), a row for each row of ``pages``.

    The matching rule that comes first in the list decides: its action and id; ``matches`` counts all that match.
    No match, an empty or a null URL: action ``keep``, rule_id null, matches 0.  Null page_id, repeated rows and
    extra columns make no difference; empty table: no rows; an empty list of rules keeps everything.
    """
    rules = RULES if rules is None else rules
    counts = token_counts(pages, {t for r in rules for t in complete_tokens(r.pattern)})
    index, rest = build_index(rules, counts)

    compiled: dict[int, re.Pattern] = {}

    def match(b: pa.RecordBatch) -> pa.RecordBatch:
        if not compiled:
            compiled.update({i: re.compile(to_regex(r.pattern), re.S | re.A) for i, r in enumerate(rules)})
        actions, ids, ns = [], [], []
        for url in b.column(1).to_pylist():
            first, n = None, 0
            if url:
                url = url.lower()
                candidates = {i for t in set(_TOKEN.findall(url)) for i in index.get(t, ())}
                for i in sorted(candidates.union(rest)):
                    if compiled[i].search(url):
                        n += 1
                        first = i if first is None else first
            actions.append("keep" if first is None else rules[first].action)
            ids.append(None if first is None else rules[first].rule_id)
            ns.append(n)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(actions, pa.string()), pa.array(ids, pa.int64()), pa.array(ns, pa.int64())], ["page_id", "action", "rule_id", "matches"])

    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    return arrow_map(pages, match, "page_id bigint, action string, rule_id bigint, matches bigint")


def oracle(rules: list[Rule] | None = None) -> str:
    rules = RULES if rules is None else rules
    values = ", ".join("({}, '{}', '{}')".format(r.rule_id, r.action, to_regex(r.pattern).replace("'", "''")) for r in rules)
    return f"""
WITH rules(rule_id, action, regex) AS (VALUES {values}),
hits AS (
  SELECT p.rid, r.rule_id, r.action FROM (SELECT *, row_number() OVER () AS rid FROM pages) p JOIN rules r ON regexp_matches(lower(p.url), r.regex, 's')),
best AS (SELECT rid, min(rule_id) AS rule_id, arg_min(action, rule_id) AS action, count(*) AS n FROM hits GROUP BY rid)
SELECT p.page_id, coalesce(b.action, 'keep') AS action, CAST(b.rule_id AS BIGINT) AS rule_id, coalesce(b.n, 0) AS matches
FROM (SELECT *, row_number() OVER () AS rid FROM pages) p LEFT JOIN best b USING (rid)
"""
