import itertools
import random
import re

from helpers import ODD, ODD_IDS, documents

from lodestone.llm import license_rules, licenses

UP = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))
    places = [(i, label) for i in range(len(words)) for p, label in PHRASES.items() if tuple(words[i : i + len(p)]) == p]
    first, last = (min(places)[0], max(places)[0]) if places else (None, None)
    return [len(words), len(places), first, last, ",".join(sorted({x for _, x in places}))]


def texts():
    rng = random.Random(2)
    parts = ["CC", "by", "cc-by", "General Public", "license", "All rights", "reserved", "ALL RIGHTS RESERVED", "é", "x", "\n", ".", "GNU General Public License, version 3", "4.0", "accby", "Copyright (c) 2020"]
    return [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 15))) for _ in range(200)]


def test_base_matches_brute_force(spark):
    rows = list(zip(range(100, 300), texts())) + list(zip(ODD_IDS, ODD))
    got = licenses.scan_licenses(documents(spark, [t for _, t in rows], [d for d, _ in rows])).collect()
    want = sorted(str([d] + brute(t)) for d, t in rows)
    assert sorted(str([r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels]) for r in got) == want
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_rules_and_suppression(spark):
    cases = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
        "Licensed under the Apache License, Version 2.0": "apache-2.0",
        "Apache License": "apache",
        "SPDX-License-Identifier: MPL-2.0": "mpl-2.0",
        "released under CC BY-SA 4.0": "cc-by,cc-by-sa-4.0",
        "Creative Commons Attribution-ShareAlike 3.0 Unported License": "cc-by-sa-3.0",
        "no licence here at all": "",
        "Copyright (C) 1999 2001 Somebody. Released under the MIT license": "copyright,mit",
    }
    rows = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, list(cases))).collect()}
    assert [rows[i].labels for i in range(len(cases))] == list(cases.values())
    assert rows[6].score == 0 and rows[3].score == 1.0


def test_rules_are_in_range():
    assert len(license_rules.SIGNATURES) > 250 and all(0 < r.confidence <= 1 and 1 <= r.priority <= license_rules.TAG for r in license_rules.rules())


def expansions(part):
    """What a parsed expression matches: every alternative and option, the shortest of open repetitions."""
    out = [""]
    for op, value in part:
        kind = str(op)
        if kind == "LITERAL":
            more = [chr(value)]
        elif kind == "IN":
            more = [chr(v) if str(o) == "LITERAL" else chr(v[0]) if str(o) == "RANGE" else "x" for o, v in value]
        elif kind == "ANY":
            more = ["x"]
        elif kind == "BRANCH":
            more = [t for branch in value[1] for t in expansions(branch)]
        elif kind == "SUBPATTERN":
            more = expansions(value[-1])
        else:
            low, high, inner = value
            inner = expansions(inner)
            more = ["".join(c) for n in range(low, (high if high <= 2 else low) + 1) for c in itertools.product(inner, repeat=n)]
        out = [a + b for a in out for b in more]
    return out


def test_every_match_has_the_keyword():
    for rule in license_rules.rules():
        assert rule.keyword, rule
        for text in expansions(re._parser.parse(rule.pattern)):
            assert set(text.split(" ")) & set(rule.keyword.split("|")), (text, rule)


def test_every_rule_finds_its_own_text(spark):
    """Also in capitals, with line breaks and punctuation between the words."""
    texts = [max(expansions(re._parser.parse(rule.pattern)), key=len) for rule in license_rules.rules()]
    for dress in (lambda t: t, lambda t: "x " + t.upper().replace(" ", ",\n  ") + "."):
        every = licenses.normalised(documents(spark, [dress(t) for t in texts])).where("norm is not null")
        found = every.select("doc_id", licenses.matching("norm", "rules").alias("hits"))
        missed = set(range(len(texts))) - {r.doc_id for r in found.where("array_contains(hits, cast(doc_id as int))").select("doc_id").collect()}
        assert not missed, [texts[i] for i in missed]


def brute_rules(text):
    """Rules and suppression, written again: all matches, then every pair of intervals."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))
    norm, spans = " ".join(words), []
    for i, rule in enumerate(license_rules.rules()):
        for m in re.finditer(f"(?<![^ ])(?:{rule.pattern})(?![^ ])", norm):
            spans.append((norm.count(" ", 0, m.start()), norm.count(" ", 0, m.end()) + 1, rule.priority, i))
    def inside(x, y):
        (a, b, p, i), (c, d, q, j) = x, y
        return x != y and c <= a and b <= d and q >= p and ((a, b) != (c, d) or (-q, j) < (-p, i))
    kept = {x[3] for x in spans if not any(inside(x, y) for y in spans)}
    base = {label for k in range(len(words)) for phrase, label in PHRASES.items() if tuple(words[k : k + len(phrase)]) == phrase}
    rules = license_rules.rules()
    return ",".join(sorted({rules[i].label for i in kept} | base)), max([rules[i].confidence for i in kept] + [0.5] * bool(base) + [0.0])


def test_rules_and_suppression_match_brute_force(spark):
    rng = random.Random(5)
    pool = [max(expansions(re._parser.parse(rule.pattern)), key=len) for rule in license_rules.rules()]
    texts = [" ".join(rng.choice(pool + ["word", "license", "version 2 0", "the", "gnu"]) for _ in range(rng.randrange(1, 9))) for _ in range(250)] + pool
    rows = list(enumerate(texts)) + [(2000, None), (2001, "MIT license " * 3000)]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(documents(spark, [t for _, t in rows], [i for i, _ in rows])).collect()}
    assert got == {i: brute_rules(t) for i, t in rows}


def test_plan_is_one_stage_without_python(spark):
    plan = licenses.scan_licenses(documents(spark, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_each_alternative_fires_alone(spark):
    cases = {
        "Expat License": "mit",
        "PSF License 2.0": "psf-2.0",
        "Creative Commons Zero 1.0": "cc0-1.0",
        "Licensed under the FDL 1.2, no licence else": "gfdl-1.2",
        "licensed under the GNU GFDL 1.2": "gfdl-1.2",
        "Copyright-protected: proprietary and confidential": "proprietary",
    }
    rows = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, list(cases))).collect()}
    assert [rows[i].labels for i in range(len(cases))] == list(cases.values())


def test_texts_without_root_words_reach_their_rules(spark):
    cases = {
        "Released under the MIT terms. Published under the terms of the MPL 2.0; used under BSD 3 clause": "bsd-3-clause,mit,mpl-2.0",
        "distributed under MIT": "mit",
        "available under the Apache 2.0": "apache-2.0",
        "CC0 1.0 Universal": "cc0-1.0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
        "Redistribution and use in source and binary forms, with or without modification": "bsd",
        "Permission to use, copy, modify, and/or distribute this software for any purpose": "isc",
        "unauthorized copying is prohibited": "proprietary",
        "Proprietary and confidential": "proprietary",
        "dedicated to the public\n  domain": "public-domain",
        "under the sun, mit and apache": "",
    }
    rows = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, list(cases))).collect()}
    assert [rows[i].labels for i in range(len(cases))] == list(cases.values())


def test_empty_table(spark):
    assert licenses.scan_licenses(documents(spark, []).limit(0)).count() == 0
