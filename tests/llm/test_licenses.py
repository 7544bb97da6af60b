import random
import re
import re._parser as parser

import pytest

from logmill.llm import licenses
from logmill.llm.licenses import RULES, Scanner, resolve


def required(nodes, word: str) -> bool:
    """Whether every match of a parsed pattern has ``word``: as a run of literals, or within a group that must match."""
    run = ""
    for op, arg in nodes:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg).lower()
            if word in run:
                return True
            continue
        if name == "SUBPATTERN" and not any(str(o) == "BRANCH" for o, _ in arg[3]) and all(str(o) == "LITERAL" for o, _ in arg[3]):
            run += "".join(chr(a).lower() for _, a in arg[3])
            if word in run:
                return True
            continue
        run = ""
        if name == "SUBPATTERN" and required(arg[3], word):
            return True
        if name == "BRANCH" and all(required(b, word) for b in arg[1]):
            return True
        if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0 and required(arg[2], word):
            return True
    return False


def test_there_are_hundreds_of_rules_in_order():
    assert len(RULES) > 300
    assert [r.rule_id for r in RULES] == list(range(len(RULES)))


@pytest.mark.parametrize("rule", RULES, ids=lambda r: f"{r.rule_id}-{r.license}-{r.kind}")
def test_no_rule_matches_without_its_keyword(rule):
    word = max(rule.keyword.split(), key=len)
    assert required(parser.parse(rule.pattern, 0), word), (rule.pattern, word)


@pytest.mark.parametrize(
    "text, found",
    [
        ("SPDX-License-Identifier: Apache-2.0", [("Apache-2.0", "tag")]),
        ("Licensed under the Apache License, Version 2.0", [("Apache-2.0", "grant")]),
        ("see https://opensource.org/licenses/MIT now", [("MIT", "address")]),
        ("GPLv3 or later", [("GPL-3.0", "name")]),
        ("This is CC BY-NC 4.0 and CC-BY-SA-4.0", [("CC-BY-NC-4.0", "name"), ("CC-BY-SA-4.0", "name")]),
        ("All rights\nreserved.", [("all-rights-reserved", "notice")]),
        ("MIT Licence", [("MIT", "name")]),
        ("See the licence file", [("see-license", "notice")]),
        ("nothing here; transmitted, admitted, open", []),
    ],
)
def test_known_texts(text, found):
    assert [(RULES[m[1]].license, RULES[m[1]].kind) for m in Scanner(RULES).scan(text)] == found


def test_resolution_drops_what_a_better_match_contains():
    assert resolve([(4, 9, 5, 8), (1, 3, 0, 10), (4, 7, 8, 12)]) == [(1, 3, 0, 10), (4, 7, 8, 12)]
    assert resolve([(4, 9, 0, 3), (4, 2, 0, 3)]) == [(4, 2, 0, 3)]
    assert resolve([(1, 1, 2, 4), (5, 9, 0, 9)]) == [(5, 9, 0, 9), (1, 1, 2, 4)]
    assert resolve([]) == []


def plain(text):
    """Every rule by itself, and of all pairs of matches those dropped that lie in a better one that stays."""
    found = [(r.priority, -(m.end() - m.start()), m.start(), i, m.end()) for i, r in enumerate(RULES) for m in re.finditer(r.pattern, text, re.I | re.S) if m.end() > m.start()]
    found = sorted(set(found))
    stays = []
    for k, (_, _, a, _, b) in enumerate(found):
        stays.append(not any(stays[j] and found[j][2] <= a and b <= found[j][4] for j in range(k)))
    return sorted((RULES[f[3]].license, RULES[f[3]].kind, RULES[f[3]].rule_id, f[2], f[4]) for f, s in zip(found, stays) if s)


def test_the_operator_against_every_rule_and_all_pairs(spark):
    rng = random.Random(12)
    names = [r.license for r in RULES]
    seeds = ["SPDX-License-Identifier: ", "Licensed under the ", "MIT License", "CC BY-SA 4.0", "GNU General Public License", " version 2 or later", "All rights reserved.", "Copyright (c) 2021 ", "\n", " and ", "BSD 3-Clause", "https://opensource.org/licenses/MIT ", "Apache License, Version 2.0"]
    rows = [(k, "".join(rng.choice([*seeds, f" {rng.choice(names)} "]) for _ in range(rng.randrange(25)))) for k in range(80)]
    got = sorted((r.doc_id, r.license, r.kind, r.rule_id, r.start_char, r.end_char) for r in licenses.detections(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == sorted((k, *hit) for k, t in rows for hit in plain(t)) and len(got) > 200


def test_resolution_of_random_intervals_and_of_very_many():
    rng = random.Random(3)
    for _ in range(300):
        found = [(rng.randrange(4), rng.randrange(9), a := rng.randrange(30), a + rng.randrange(1, 12)) for _ in range(rng.randrange(40))]
        taken = []
        for m in sorted(set(found), key=lambda m: (m[0], m[2] - m[3], m[2], m[1])):
            if all(not (t[2] <= m[2] and m[3] <= t[3]) for t in taken):
                taken.append(m)
        assert sorted(resolve(found)) == sorted(taken)
    assert len(resolve([(0, 1, 2 * k, 2 * k + 1) for k in range(200_000)])) == 200_000


def test_prefilter_changes_nothing():
    scanner = Scanner(RULES)
    seeds = ["Licensed under ", "the ", "MIT license", "CC BY 4.0", " GNU General Public License", " version 2", "copyright 2020 ", "all rights reserved", "x", "\n", "Apache ", "2.0", "ſource "]
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choices(seeds, k=rng.randrange(12)))
        assert scanner.scan(text) == scanner.scan(text, prefilter=False)


def test_nulls_empty_texts_repeats_and_other_columns(spark):
    rows = [(1, None, "a"), (None, "MIT License", "b"), (2, "", "c"), (3, "x " * 200_000 + "CC0 1.0", "d"), (4, "MIT License", "e"), (4, "MIT License", "e")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, license string")
    got = sorted((r.doc_id or 0, r.license, r.start_char) for r in licenses.detections(docs).collect())
    assert got == [(0, "MIT", 0), (3, "CC0-1.0", 400_000), (4, "MIT", 0), (4, "MIT", 0)]
    assert licenses.detections(docs.limit(0)).count() == 0
    assert licenses.detections(docs, []).count() == 0
