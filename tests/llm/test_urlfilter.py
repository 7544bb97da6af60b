import random
import re

from hypothesis import given
from hypothesis import strategies as st

from logmill.llm import urlfilter
from logmill.llm.urlfilter import RULES, Rule, build_index, complete_tokens, to_regex

KINDS = "page_id bigint, url string, rule_id string, matches string"


def brute(url, rules=RULES):
    hits = [r for r in rules if url and re.search(to_regex(r.pattern), url.lower(), re.S | re.A)]
    return (hits[0].action, hits[0].rule_id, len(hits)) if hits else ("keep", None, 0)


def urls(n):
    rng = random.Random(4)
    hosts = ["ads.example.com", "www.spam-farm.example.org", "docs.casino.net", "m.blog.example", "bit.ly", "EXAMPLE.gov", "localhost:8080", "notcasino.net"]
    paths = ["/", "/login", "/login?x=1", "/tag/a/", "/a.html", "/file.EXE", "/x/index.html", "/wiki/Page", "/feed", "/logins", "/a?utm_source=b&sid=1", "/cart#top", "/archive/2020/page/3"]
    return [f"{rng.choice(('http', 'https', 'ftp'))}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(n)] + ["mailto:a@b", "not a url", "", "data:x"]


def test_against_brute_force(spark):
    rows = [(i, u, "clash", "clash") for i, u in enumerate(urls(400))] + [(None, "http://ads.x.com/", "", ""), (7, None, "", ""), (8, "http://a.b/" + "c/" * 50_000 + "login", "", ""), (0, urls(1)[0], "", "")]
    got = urlfilter.apply_rules(spark.createDataFrame(rows, KINDS)).collect()
    assert sorted(((r.page_id, r.action, r.rule_id, r.matches) for r in got), key=repr) == sorted(((i, *brute(u)) for i, u, *_ in rows), key=repr)
    assert len({r.rule_id for r in got}) > 15


def test_every_match_has_the_complete_tokens():
    for u in urls(500):
        for r in RULES:
            if re.search(to_regex(r.pattern), u.lower(), re.S | re.A):
                assert set(complete_tokens(r.pattern)) <= set(re.findall("[a-z0-9]+", u.lower())), (r.pattern, u)


@given(st.lists(st.sampled_from(["||", "|", "*", "^", "/", ".", "ab", "a", "1", "?", "=", "-"]), min_size=1, max_size=6), st.text("ab1/.?=-:", max_size=12))
def test_tokens_of_any_pattern(parts, url):
    pattern = "".join(parts)
    for full in (url, "ab://" + url):
        if re.search(to_regex(pattern), full, re.S | re.A):
            assert set(complete_tokens(pattern)) <= set(re.findall("[a-z0-9]+", full))


def test_rules_are_filed_under_their_rarest_token():
    rules = [Rule(0, "block", "/common/rare/"), Rule(1, "block", "ab*cd"), Rule(2, "block", "/common/")]
    index, rest = build_index(rules, {"common": 100, "rare": 2})
    assert index == {"rare": [0], "common": [2]} and rest == [1]


def test_empty_table_and_no_rules(spark):
    none = spark.createDataFrame([], "page_id bigint, url string")
    assert urlfilter.apply_rules(none).count() == 0
    one = spark.createDataFrame([(1, "http://ads.x/")], "page_id bigint, url string")
    assert urlfilter.apply_rules(one, []).collect()[0].action == "keep"


def test_host_labels_by_hand(spark):
    blocked = ["https://www.casino.com/", "https://doubleclick.net/x", "http://x.googlesyndication.com/a", "https://spam-farm.example.com/en/1", "https://www.spam-farm.example.org/en/1", "http://m.casino-win.example.com/en/4", "https://free-bets.example.com/en/5", "https://www.cheap-pills.example.com/de/6", "https://m.ads-track.example.com/", "https://blog.adult-x.example.net/es/7", "HTTPS://PASTEBIN.COM/abc", "http://payday-loans.example.org/", "https://a.b.poker.co.uk"]
    flagged = ["https://www.example.com/a", "https://m.example.com/a", "https://blog.example.org/", "https://mobile.example.org/", "https://forum.example.org/t/1", "https://shop.example.org/"]
    kept = ["https://notcasino.net/", "https://casinoroyale.example.com/", "https://example.com/casino.com/", "https://example.com/?u=www.casino.com", "https://adulthood.example.org/a", "https://em.example.org/a", "https://wwwx.example.org/a"]
    allowed = ["https://docs.casino.net/a", "https://www.adult-x.gov/"]
    want = {u: k for k, us in (("block", blocked), ("flag", flagged), ("keep", kept), ("allow", allowed)) for u in us}
    got = urlfilter.apply_rules(spark.createDataFrame([(i, u) for i, u in enumerate(want)], "page_id bigint, url string"))
    assert {list(want)[r.page_id]: r.action for r in got.collect()} == want


def test_every_host_label_rule_matches_a_host():
    for r in RULES:
        if m := re.fullmatch(r"\|\|([a-z-]+?)([.-])", r.pattern):
            assert re.search(to_regex(r.pattern), f"https://x.{m[1]}{m[2]}example.org/")
        assert not re.search(r"\.\^$", r.pattern), r.pattern
