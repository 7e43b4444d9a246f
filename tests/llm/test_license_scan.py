import re
from re import _constants as sre
from re._parser import parse as sre_parse

import cases

from corpusprep.llm.license_scan import Detection, detections, resolved, rules, scan_licenses

SF = "/root/testdata/sf0.01"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def _words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def _base(text):
    words, places, labels = _words(text), [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def _plain_detections(words):
    """Every rule run without a prefilter, nesting resolved pair by pair."""
    text = f" {' '.join(words)} "
    found = set()
    for r in rules():
        for m in re.finditer(rf"(?<= )(?:{r.signature})(?= )", text):
            found.add(Detection(text.count(" ", 0, m.start()) - 1, text.count(" ", 0, m.end()), r.priority, r.label))
    kept = []
    for d in sorted(found, key=lambda d: (d.priority, d.first - d.end, d.first, d.label)):
        if not any(k.first <= d.first and d.end <= k.end or d.first <= k.first and k.end <= d.end for k in kept):
            kept.append(d)
    return sorted(kept)


TEXTS = [
    None, "", "CC-BY", "cc by cc by", "Released under the MIT License.", "a summit license", "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3. All rights reserved.", "SPDX-License-Identifier: GPL-2.0-only WITH x",
    "https://www.apache.org/licenses/LICENSE-2.0", "CC BY 4.0 and cc by sa 3 0", "général public license é all RIGHTS reserved",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)",
    "Copyright (c) 2019 ACME. All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted",
]


def test_texts(spark):
    rows = [(i, t, "en", "a") for i, t in enumerate(TEXTS)]
    got = {r.doc_id: r for r in scan_licenses(cases.frame(spark, rows)).collect()}
    for i, t, *_ in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == _base(t)
        assert [Detection(*d) for d in r.found] == _plain_detections(_words(t))
        assert set(r.labels.split(",")) >= set(r.base_labels.split(",")) - {""} and 0 <= r.score <= 1
    assert got[4].labels == "mit" and got[5].labels == "" and got[6].labels == "apache-2.0" and got[5].score == 0
    assert got[7].labels == "gpl,gpl-3.0,reserved" and got[8].labels == "gpl-2.0" and got[10].labels == "cc-by,cc-by-4.0,cc-by-sa-3.0"


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = scan_licenses(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(text)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == _base(text[r.doc_id])
    assert {"mit", "apache-2.0"} <= {x for r in got for x in r.labels.split(",")}


def test_prefilter_loses_nothing(spark):
    for r in rules():
        assert r.keyword in r.signature, r
        text = re.sub(r"\\b|\?:|\(|\)\??|\?", "", re.sub(r"\.\{.*?\}\??", " some words ", r.signature).split("|")[0])
        words = text.split()
        assert [tuple(d) for d in detections([w.encode() for w in words])] == [tuple(d) for d in _plain_detections(words)]


def _alternatives(parsed):
    """Texts of every alternative of an expression; any character is "z", a repeat is taken at its least and one more."""
    outs = [""]
    for op, arg in parsed:
        if op is sre.LITERAL:
            own = [chr(arg)]
        elif op is sre.NOT_LITERAL or op is sre.ANY:
            own = ["z"]
        elif op is sre.IN:
            own = [chr(x if o is sre.LITERAL else x[0]) for o, x in arg]
        elif op is sre.BRANCH:
            own = [t for branch in arg[1] for t in _alternatives(branch)]
        elif op is sre.SUBPATTERN:
            own = _alternatives(arg[-1])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = arg
            once = _alternatives(inner)
            own = [t * n for t in once for n in range(least, min(most, least + 1) + 1)]
        else:
            assert op is sre.AT, op
            own = [""]
        outs = [a + b for a in outs for b in dict.fromkeys(own)]
    return outs


def test_every_alternative_holds_its_keyword():
    assert _alternatives(sre_parse("a(?:b|c ?)[de]")) == ["abd", "abe", "acd", "ace", "ac d", "ac e"]
    n = 0
    for r in rules():
        for text in _alternatives(sre_parse(r.signature)):
            n += 1
            assert f" {r.keyword}" in f" {text}", (r, text)
    assert n > len(rules())


def test_alternatives_without_the_common_keyword():
    for text, label in [("FreeBSD License", "bsd-2-clause"), ("the FreeBSD licence", "bsd-2-clause"), ("SPDX-License-Identifier: PSF-2.0", "psf-2.0"),
                        ("SPDX-License-Identifier: Python-2.0", "psf-2.0"), ("Unauthorized copying is prohibited, nonconfidential", "confidential")]:
        words = _words(text)
        got = detections([w.encode() for w in words])
        assert got == _plain_detections(words) and label in {d.label for d in got}


def test_containment():
    d = [Detection(0, 10, 3, "outer"), Detection(2, 4, 1, "inner"), Detection(3, 6, 2, "overlaps"), Detection(3, 4, 5, "inside"), Detection(12, 13, 5, "apart")]
    assert [x.label for x in resolved(d)] == ["inner", "overlaps", "apart"]


def test_awkward_rows(spark):
    rows = cases.awkward_rows()
    assert len(scan_licenses(cases.frame(spark, rows)).collect()) == len(rows)
    assert scan_licenses(cases.frame(spark, []).limit(0)).collect() == []
    assert len(rules()) > 200
