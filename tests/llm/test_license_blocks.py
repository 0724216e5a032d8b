"""Operator 6 over blocks that span lines."""

import random
import re

from tests.llm.helpers import frame, names, odd_texts
from tidemark.llm import licenses, queries

NOTICES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining
a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction""",
    "bsd": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.""",
}


def blocks(text, length, known):
    """(words, first and last place) of a text's paragraphs and of its runs of known words."""
    places = [(k, w) for k, w in enumerate(names(text)) if w in known]
    at = 0
    for part in re.split(r"\n[ \t\r\x0b\x0c]*(?=\n)", text or ""):
        end = at + len(names(part))
        yield [(k, w) for k, w in places if at <= k < end]
        at = end
    for k in range(0, max(1, len(places)), length):
        yield places[k : k + 2 * length]


def brute(text):
    """All candidates as (label, containment, first, last, words), without any filter of words, and the labels that no related one beats."""
    known = {w for t in [*licenses.PHRASES, *(t for _, t in licenses.TEMPLATES)] for w in t.split()}
    found, words = set(), names(text)
    for label, template in licenses.TEMPLATES:
        want = frozenset(template.split())
        for block in blocks(text, len(template.split()), known):
            share = len({w for _, w in block} & want) / len(want)
            if share >= licenses.THRESHOLD - 1e-9:
                found.add((label, share, block[0][0], block[-1][0], want))
    rivals = set(found)
    for phrase, label in licenses.PHRASES.items():
        own = phrase.split()
        rivals |= {(label, 1.0, k, k + len(own) - 1, frozenset(own)) for k in range(len(words)) if words[k : k + len(own)] == own}
    related = lambda a, b: len(a & b) >= 3 and 2 * len(a & b) >= min(len(a), len(b))
    beats = lambda r, c: r[0] != c[0] and r[1] > c[1] and r[2] <= c[3] and c[2] <= r[3] and related(r[4], c[4])
    return found, {c[0] for c in found if not any(beats(r, c) for r in rivals)}


def test_wrapped_notices_are_found(spark, tmp_path):
    prose = "\n".join(["Some words of this file stand here"] * 5)
    rows = [(label, f"{prose}\n\n{notice}\n\n{prose}") for label, notice in NOTICES.items()]
    rows += [(label, re.sub("^", " * ", notice, flags=re.M)) for label, notice in NOTICES.items()]
    rows += [(label, notice.replace("\n", "\n\n")) for label, notice in NOTICES.items()]  # pages with blank lines between all lines
    rows += [(label, notice.replace(" ", "\n")) for label, notice in NOTICES.items()]
    frame(spark, [t for _, t in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op6_license_scan(spark, str(tmp_path)).collect()}
    for k, (label, text) in enumerate(rows):
        assert (got[k].labels, got[k].score) == (label, 1.0), text


def test_spanning_blocks_match_brute_force(spark):
    rnd = random.Random(11)
    texts = odd_texts()
    for _ in range(60):
        words = [w for _, t in rnd.sample(licenses.TEMPLATES, 2) for w in rnd.sample(t.split(), rnd.randrange(5, len(t.split())))]
        texts.append("".join(w + rnd.choice([" ", " ", "\n", "\n \n", "\n\n\n", " other words "]) for w in words))
    rows = {r.doc_id: r for r in licenses.scan(frame(spark, texts), spanning=True).collect()}
    found = disputed = 0
    for i, text in enumerate(texts):
        candidates, labels = brute(text)
        base = {label for phrase, label in licenses.PHRASES.items() if f" {phrase} " in f" {' '.join(names(text))} "}
        assert {(c.label, round(c.containment, 9), c.first_word, c.last_word) for c in rows[i].candidates} == {(c[0], round(c[1], 9), *c[2:4]) for c in candidates}, text
        assert rows[i].labels == sorted(base | labels), text
        assert abs(rows[i].score - (1.0 if base else max((c[1] for c in candidates), default=0.0))) < 1e-9
        found += bool(candidates)
        disputed += {c[0] for c in candidates} != labels
    assert found > 10 and disputed > 0


def test_blocks_without_a_name_are_found(spark):
    """Blocks over the threshold that lack the license's own name, or are another license's by one word, are candidates."""
    texts = ["this work is licensed under a creative commons 4 0 international license", licenses.TEMPLATES[3][1].replace("apache ", ""), "Licensed under the GNU General Public License"]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, texts), spanning=True).collect()}
    assert got[0].labels == ["cc-by"] and abs(got[0].score - 12 / 13) < 1e-9
    assert "apache" in got[1].labels
    assert {c.label for c in got[2].candidates} == {"lgpl"} and got[2].labels == ["gpl"]


def test_related_licenses_are_told_apart(spark):
    lines = {
        "Licensed under the GNU General Public License": "gpl",
        "licensed under the\nGNU General\nPublic License": "gpl",
        "Licensed under the GNU Lesser General Public License": "lgpl",
        "Licensed under the GNU LGPL version 3 or later": "lgpl",
        "Licensed under the GNU GPL version 3 or later": "gpl",
        "Licensed under the Educational Community License, Version 2.0; you may not use this file except in compliance with the License": "ecl",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License": "epl",
        "This Source Code Form is subject to the terms of the Mozilla Public License": "mpl",
    }
    for spanning in (False, True):
        got = {r.doc_id: r.labels for r in licenses.report(frame(spark, list(lines)), spanning).collect()}
        assert [got[k] for k in range(len(lines))] == list(lines.values())
