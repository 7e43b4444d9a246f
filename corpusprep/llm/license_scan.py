"""License scans with ordered signature rules.

A rule is a hand-written regular expression over a text's normalised words (A-Z in lower
case, everything but letters, digits and non-ASCII characters a blank), with a
label, a priority and a keyword. One pass of a keyword automaton over the text
selects the rules whose keyword stands in it; only their expressions run.

Detections are taken by priority, then longest first, then leftmost. One whose
words lie inside a detection taken before, or that holds one, is suppressed:
"mit license" inside "released under the mit license" counts once. Detections
that only overlap in part both stay.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.text_units import ALNUM_FOLD, utf8

#: Phrases whose places are always counted, with their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: What a detection of each priority is worth; the first are the surest.
CONFIDENCE = (0.99, 0.95, 0.9, 0.8, 0.6, 0.4)
TAG, ADDRESS, GRANT, NAME, WEAK, NOTICE = range(6)

#: label; keyword (it stands, after a blank, in every alternative of every signature); signatures by priority: t(ag), a(ddress), g(rant), n(ame), w(eak). One line for each expression.
SIGNATURES = r"""
mit; mit
 t spdx license identifier mit\b
 a opensource org licenses mit\b
 g (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of the )?mit licen[cs]e
 n (?:the )?mit (?:x11 )?licen[cs]e
 w mit licen[cs]ed
mit; permission is hereby granted
 g permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
 w permission is hereby granted free of charge
mit-0; mit
 t spdx license identifier mit 0\b
 n mit no attribution(?: licen[cs]e)?
apache-2.0; apache
 t spdx license identifier apache 2 0
 a apache org licenses license 2 0(?: txt| html)?
 g (?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?apache (?:software )?licen[cs]e (?:version )?2(?: 0)?
 n apache (?:software )?licen[cs]e (?:version |v )?2(?: 0)?
 n apache 2 0 licen[cs]e
apache-1.1; apache
 t spdx license identifier apache 1 1
 n apache (?:software )?licen[cs]e (?:version )?1 1
 a apache org licenses license 1 1
apache-1.0; apache
 t spdx license identifier apache 1 0
 n apache (?:software )?licen[cs]e (?:version )?1 0
apache; apache
 g licensed under (?:the )?apache licen[cs]e
 w apache (?:software )?licen[cs]e
gpl-3.0; gnu
 a gnu org licenses gpl 3 0
 g under the terms of the gnu general public licen[cs]e (?:as published by the free software foundation )?(?:either )?version 3
 g (?:released|licensed|distributed) under (?:the )?gnu general public licen[cs]e version 3
 n gnu general public licen[cs]e (?:version |v )3
gpl-3.0; gpl
 t spdx license identifier gpl 3 0(?: only| or later)?
 n gpl ?v?3(?: 0)?\b
 n gpl version 3
gpl-2.0; gnu
 a gnu org licenses (?:old licenses )?gpl 2 0
 g under the terms of the gnu general public licen[cs]e (?:as published by the free software foundation )?(?:either )?version 2
 g (?:released|licensed|distributed) under (?:the )?gnu general public licen[cs]e version 2
 n gnu general public licen[cs]e (?:version |v )2
gpl-2.0; gpl
 t spdx license identifier gpl 2 0(?: only| or later)?
 n gpl ?v?2(?: 0)?\b
 n gpl version 2
gpl-1.0; gpl
 t spdx license identifier gpl 1 0(?: only| or later)?
 n gpl version 1
gpl; gnu
 g (?:released|licensed|distributed) under (?:the )?(?:terms of the )?gnu general public licen[cs]e
 n gnu general public licen[cs]e
 n gnu gpl
 a gnu org (?:licenses|copyleft) gpl
gpl; gpl
 g (?:released|licensed|distributed) under (?:the )?gpl
 w gpl licen[cs]ed
lgpl-3.0; gnu
 a gnu org licenses lgpl 3 0
 n gnu lesser general public licen[cs]e (?:version |v )3
lgpl-3.0; lgpl
 t spdx license identifier lgpl 3 0(?: only| or later)?
 n lgpl ?v?3(?: 0)?\b
lgpl-2.1; gnu
 a gnu org licenses (?:old licenses )?lgpl 2 1
 n gnu lesser general public licen[cs]e (?:version |v )2 1
lgpl-2.1; lgpl
 t spdx license identifier lgpl 2 1(?: only| or later)?
 n lgpl ?v?2 1\b
lgpl-2.0; lgpl
 t spdx license identifier lgpl 2 0(?: only| or later)?
 n lgpl ?v?2(?: 0)?\b
lgpl-2.0; gnu
 n gnu library general public licen[cs]e
lgpl; gnu
 g (?:released|licensed|distributed) under (?:the )?gnu lesser general public licen[cs]e
 n gnu lesser general public licen[cs]e
lgpl; lgpl
 w (?:the )?lgpl\b
agpl-3.0; affero
 n gnu affero general public licen[cs]e (?:version |v )?3
 n affero general public licen[cs]e
agpl-3.0; agpl
 a gnu org licenses agpl 3 0
 t spdx license identifier agpl 3 0(?: only| or later)?
 n agpl ?v?3(?: 0)?\b
 w (?:the )?agpl\b
gfdl-1.3; gnu
 n gnu free documentation licen[cs]e version 1 3
 a gnu org licenses fdl 1 3
gfdl-1.2; gnu
 n gnu free documentation licen[cs]e version 1 2
gfdl; gnu
 g permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
 n gnu free documentation licen[cs]e
bsd-3-clause; bsd
 t spdx license identifier bsd 3 clause\b
 a opensource org licenses bsd 3 clause
 n (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?
bsd-3-clause; neither the name
 g neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products
bsd-2-clause; bsd
 t spdx license identifier bsd 2 clause\b
 a opensource org licenses bsd 2 clause
 n (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)(?: licen[cs]e)
bsd-2-clause; freebsd
 n freebsd licen[cs]e
bsd-4-clause; bsd
 t spdx license identifier bsd 4 clause\b
 n (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)(?: licen[cs]e)?
bsd-4-clause; advertising materials
 g all advertising materials mentioning features or use of this software must display
0bsd; 0bsd
 t spdx license identifier 0bsd
 n 0bsd licen[cs]e
0bsd; bsd
 n (?:bsd zero clause|zero clause bsd)(?: licen[cs]e)?
bsd; bsd
 g (?:released|licensed|distributed) under (?:the |a )?bsd (?:style )?licen[cs]e
 w (?:the )?bsd (?:style )?licen[cs]e
bsd; redistribution and use
 g redistribution and use in source and binary forms with or without modification are permitted
isc; isc
 t spdx license identifier isc\b
 a opensource org licenses isc\b
 n (?:the )?isc licen[cs]e
isc; permission to use
 g permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
mpl-2.0; mozilla
 a mozilla org mpl 2 0
 g subject to the terms of the mozilla public licen[cs]e v(?:ersion)? ?2 0
 n mozilla public licen[cs]e (?:version |v )?2(?: 0)?
mpl-2.0; mpl
 t spdx license identifier mpl 2 0
 n mpl ?v?2(?: 0)?\b
mpl-1.1; mozilla
 a mozilla org mpl mpl 1 1
 n mozilla public licen[cs]e (?:version |v )?1 1
mpl-1.1; mpl
 t spdx license identifier mpl 1 1
 n mpl ?v?1 1\b
mpl; mozilla
 w mozilla public licen[cs]e
epl-2.0; eclipse
 a eclipse org legal epl 2 0
 n eclipse public licen[cs]e (?:version |v )?2(?: 0)?
epl-2.0; epl
 t spdx license identifier epl 2 0
epl-1.0; eclipse
 a eclipse org legal epl v10
 n eclipse public licen[cs]e (?:version |v )?1(?: 0)?
epl-1.0; epl
 t spdx license identifier epl 1 0
epl; eclipse
 w eclipse public licen[cs]e
edl-1.0; eclipse
 n eclipse distribution licen[cs]e
cddl-1.0; cddl
 t spdx license identifier cddl 1 0
 n cddl (?:version )?1(?: 0)?\b
 w (?:the )?cddl\b
cddl-1.0; common development
 n common development and distribution licen[cs]e
cpl-1.0; cpl
 t spdx license identifier cpl 1 0
cpl-1.0; common public
 n common public licen[cs]e
ipl-1.0; ibm public
 n ibm public licen[cs]e
artistic-2.0; artistic
 t spdx license identifier artistic 2 0
 n artistic licen[cs]e (?:version )?2(?: 0)?
artistic-1.0; artistic
 t spdx license identifier artistic 1 0
 n (?:perl )?artistic licen[cs]e (?:version )?1(?: 0)?
artistic; artistic
 w artistic licen[cs]e
perl; perl
 g under the same terms as perl itself
zlib; zlib
 t spdx license identifier zlib\b
 n (?:the )?zlib (?:libpng )?licen[cs]e
zlib; as is without any express
 g provided as is without any express or implied warranty in no event will the authors be held liable
libpng; libpng
 n libpng licen[cs]e
boost-1.0; boost
 a boost org license 1 0
 g distributed under the boost software licen[cs]e
 n boost software licen[cs]e (?:version )?1(?: 0)?
boost-1.0; bsl
 t spdx license identifier bsl 1 0
busl-1.1; business source
 n business source licen[cs]e (?:version )?1 1
 w business source licen[cs]e
busl-1.1; busl
 t spdx license identifier busl 1 1
unlicense; unlicense
 t spdx license identifier unlicense\b
 a unlicense org
 n (?:the )?unlicense\b
unlicense; unencumbered
 g this is free and unencumbered software released into the public domain
wtfpl; wtfpl
 t spdx license identifier wtfpl
 n (?:the )?wtfpl\b
wtfpl; what the fuck
 n do what the fuck you want to public licen[cs]e
cc0-1.0; cc0
 t spdx license identifier cc0 1 0
 n (?:creative commons )?cc0 (?:1 0 )?(?:universal|licen[cs]e|public domain dedication)
 w cc0\b
cc0-1.0; publicdomain zero
 a creativecommons org publicdomain zero 1 0
cc-by-4.0; cc by
 t spdx license identifier cc by 4 0
 n cc by (?:licen[cs]e )?(?:version )?4 0\b
cc-by-4.0; creative
 a creativecommons org licenses by 4 0
 n creative commons attribution (?:licen[cs]e )?4 0(?: international)?
cc-by-3.0; cc by
 t spdx license identifier cc by 3 0
 n cc by 3 0\b
cc-by-3.0; creative
 a creativecommons org licenses by 3 0
 n creative commons attribution (?:licen[cs]e )?3 0(?: unported)?
cc-by-2.0; cc by
 n cc by 2 [05]\b
cc-by-2.0; creative
 a creativecommons org licenses by 2 [05]
cc-by-sa-4.0; cc by sa
 t spdx license identifier cc by sa 4 0
 n cc by sa 4 0\b
cc-by-sa-4.0; creative
 a creativecommons org licenses by sa 4 0
 n creative commons attribution share ?alike (?:licen[cs]e )?4 0
cc-by-sa-3.0; cc by sa
 t spdx license identifier cc by sa 3 0
 n cc by sa 3 0\b
cc-by-sa-3.0; creative
 a creativecommons org licenses by sa 3 0
 n creative commons attribution share ?alike (?:licen[cs]e )?3 0
cc-by-sa; cc by sa
 w cc by sa\b
cc-by-sa; creative
 n creative commons attribution share ?alike
cc-by-nc-4.0; cc by nc
 t spdx license identifier cc by nc 4 0
 n cc by nc 4 0\b
cc-by-nc-4.0; creative
 a creativecommons org licenses by nc 4 0
 n creative commons attribution non ?commercial (?:licen[cs]e )?4 0
cc-by-nc; cc by nc
 w cc by nc\b
cc-by-nc; creative
 n creative commons attribution non ?commercial
cc-by-nd; cc by nd
 t spdx license identifier cc by nd [0-9] 0
 w cc by nd\b
cc-by-nd; creative
 a creativecommons org licenses by nd
 n creative commons attribution no ?derivatives
cc-by-nc-sa; cc by nc sa
 t spdx license identifier cc by nc sa [0-9] 0
 w cc by nc sa\b
cc-by-nc-sa; creative
 a creativecommons org licenses by nc sa
 n creative commons attribution non ?commercial share ?alike
cc-by-nc-nd; cc by nc nd
 t spdx license identifier cc by nc nd [0-9] 0
 w cc by nc nd\b
cc-by-nc-nd; creative
 a creativecommons org licenses by nc nd
 n creative commons attribution non ?commercial no ?derivatives
cc-by; cc by
 g (?:released|licensed|available|published) under (?:a |the )?(?:creative commons )?cc by
 w cc by\b
cc-by; creative
 g licensed under (?:a |the )?creative commons attribution
 n creative commons attribution licen[cs]e
cc; creative
 w creative commons licen[cs]e
public-domain; public domain
 g (?:released|placed|dedicated) (?:in|into|to) the public domain
 w (?:is|are) in the public domain
pddl-1.0; pddl
 t spdx license identifier pddl 1 0
pddl-1.0; open data commons
 n open data commons public domain dedication
odc-by-1.0; odc
 t spdx license identifier odc by 1 0
odc-by-1.0; open data commons
 n open data commons attribution licen[cs]e
odbl-1.0; odbl
 t spdx license identifier odbl 1 0
odbl-1.0; open database
 n open database licen[cs]e
odbl-1.0; opendatacommons
 a opendatacommons org licenses odbl
psf-2.0; python
 t spdx license identifier python 2 0
 n python software foundation licen[cs]e
 w python licen[cs]e
psf-2.0; psf
 t spdx license identifier psf 2 0
php-3.01; php
 t spdx license identifier php 3 0 ?1
 n php licen[cs]e (?:version )?3 0 ?1
 w php licen[cs]e
ruby; ruby
 t spdx license identifier ruby\b
 n ruby licen[cs]e
tcl; tcl
 t spdx license identifier tcl\b
 n tcl tk licen[cs]e
openssl; openssl
 t spdx license identifier openssl\b
 n openssl licen[cs]e
 g this product includes software developed by the openssl project
ofl-1.1; sil
 n sil open font licen[cs]e (?:version )?1 1
 a scripts sil org ofl
 w sil open font licen[cs]e
ofl-1.1; ofl
 t spdx license identifier ofl 1 1
ofl; open font
 w open font licen[cs]e
ms-pl; microsoft
 n microsoft public licen[cs]e
ms-pl; ms pl
 t spdx license identifier ms pl
ms-rl; microsoft
 n microsoft reciprocal licen[cs]e
ms-rl; ms rl
 t spdx license identifier ms rl
eupl-1.2; eupl
 t spdx license identifier eupl 1 2
 n eupl ?v?1 2
eupl-1.1; eupl
 t spdx license identifier eupl 1 1
 n eupl ?v?1 1
eupl; european union public
 n european union public licen[cs]e
cecill-2.1; cecill
 t spdx license identifier cecill 2 1
 n cecill (?:licence|license)? ?(?:version )?2 1
cecill; cecill
 w cecill licen[cs]e
osl-3.0; osl
 t spdx license identifier osl 3 0
osl-3.0; open software
 n open software licen[cs]e (?:version )?3 0
afl-3.0; afl
 t spdx license identifier afl 3 0
afl-3.0; academic free
 n academic free licen[cs]e
ecl-2.0; ecl
 t spdx license identifier ecl 2 0
ecl-2.0; educational community
 n educational community licen[cs]e
ncsa; ncsa
 t spdx license identifier ncsa\b
 n ncsa (?:open source )?licen[cs]e
upl-1.0; upl
 t spdx license identifier upl 1 0
upl-1.0; universal permissive
 n universal permissive licen[cs]e
w3c; w3c
 t spdx license identifier w3c\b
 n w3c software (?:notice and )?licen[cs]e
x11; x11
 t spdx license identifier x11\b
 n x11 licen[cs]e
curl; curl
 t spdx license identifier curl\b
 n curl licen[cs]e
postgresql; postgresql
 t spdx license identifier postgresql\b
 n postgresql licen[cs]e
sleepycat; sleepycat
 n sleepycat licen[cs]e
vim; vim
 t spdx license identifier vim\b
 n vim licen[cs]e
beerware; beer
 t spdx license identifier beerware
 n beer ?ware licen[cs]e
 g if we meet some day and you think this stuff is worth it you can buy me a beer
json; shall be used for good
 g the software shall be used for good not evil
sspl-1.0; server side
 n server side public licen[cs]e
sspl-1.0; sspl
 t spdx license identifier sspl 1 0
elastic-2.0; elastic
 t spdx license identifier elastic 2 0
 n elastic licen[cs]e (?:version )?2(?: 0)?
 w elastic licen[cs]e
commons-clause; commons clause
 n commons clause (?:licen[cs]e )?condition
 w commons clause\b
openrail; open rail
 n (?:creativeml )?open rail (?:m )?licen[cs]e
openrail; openrail
 n (?:creativeml )?openrail (?:m )?licen[cs]e
 w openrail\b
llama; llama
 n llama [0-9 ]*community licen[cs]e
nasa-1.3; nasa
 n nasa open source agreement
mulan-2.0; mulan
 n mulan (?:psl|permissive software licen[cs]e)(?: v2| version 2)?
blueoak-1.0.0; blue oak
 n blue oak model licen[cs]e
qpl-1.0; q public
 n q public licen[cs]e
sgi-b-2.0; sgi
 n sgi free software licen[cs]e b
nist; national institute of standards
 n national institute of standards and technology (?:public domain )?licen[cs]e
icu; icu
 t spdx license identifier icu\b
 n icu licen[cs]e
unicode; unicode
 t spdx license identifier unicode (?:dfs|tou|3 0)
 n unicode licen[cs]e (?:agreement|v3)
"""

#: Notices that name no license.
NOTICES = r"""
reserved; reserved
 o all rights reserved
 o (?:no|some|certain) rights reserved
copyright; copyright
 o copyright (?:c )?(?:19|20)[0-9]{2}
 o copyright (?:c )?by
 o copyright holders?
proprietary; proprietary
 o proprietary and confidential
 o proprietary licen[cs]e
confidential; unauthorized copying
 o unauthorized copying .{0,60}?(?:is )?(?:strictly )?prohibited.{0,20}?confidential
confidential; company
 o company confidential
noncommercial; noncommercial
 o (?:for )?noncommercial use only
noncommercial; non commercial
 o (?:for )?non commercial use only
noncommercial; not for commercial
 o not for commercial use
licensed; licen
 o licen[cs]ed under
 o see (?:the )?licen[cs]e file
 o licen[cs]e agreement
warranty; warrant
 o without warranty of any kind
 o without any warranty
 o disclaims? all warranties
"""


class Rule(NamedTuple):
    priority: int
    label: str
    keyword: str
    signature: str


def rules(text: str = SIGNATURES + NOTICES) -> list[Rule]:
    out, label, keyword = [], "", ""
    for line in text.splitlines():
        if line.startswith(" "):
            kind, signature = line.strip().split(" ", 1)
            out.append(Rule("tagnwo".index(kind), label, keyword, signature))
        elif line.strip():
            label, keyword = (x.strip() for x in line.split(";"))
    return out


class Detection(NamedTuple):
    """Words first up to but not including end."""

    first: int
    end: int
    priority: int
    label: str


@lru_cache(maxsize=4)
def _compiled(rule_text: str) -> tuple[list[Rule], list[re.Pattern[str]], ahocorasick.Automaton]:
    own = rules(rule_text)
    by_keyword: dict[str, list[int]] = {}
    for i, r in enumerate(own):
        by_keyword.setdefault(r.keyword, []).append(i)
    automaton = ahocorasick.Automaton()
    for keyword, which in by_keyword.items():
        automaton.add_word(f" {keyword}", which)
    automaton.make_automaton()
    # whole words; the blank before is looked at only
    return own, [re.compile(rf"(?<= )(?:{r.signature})(?= )") for r in own], automaton


def resolved(found: list[Detection]) -> list[Detection]:
    """Detections by priority, longest first, leftmost first, without those inside a better one or around one; sorted by place."""
    firsts: list[int] = []
    kept: list[Detection] = []
    for d in sorted(set(found), key=lambda d: (d.priority, d.first - d.end, d.first, d.label)):
        # those kept aren't nested, so they are in order of both ends
        i = bisect.bisect_right(firsts, d.first)
        inside = i > 0 and kept[i - 1].end >= d.end
        j = bisect.bisect_left(firsts, d.first)
        around = j < len(kept) and kept[j].end <= d.end
        if not inside and not around:
            firsts.insert(i, d.first)
            kept.insert(i, d)
    return kept


def detections(words: list[bytes], rule_text: str = SIGNATURES + NOTICES) -> list[Detection]:
    own, patterns, automaton = _compiled(rule_text)
    text = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    chosen: set[int] = set()
    for _, which in automaton.iter(text):
        chosen.update(which)
    spans = [(m.start(), m.end(), i) for i in sorted(chosen) for m in patterns[i].finditer(text)]
    if not spans:
        return []
    blanks = [m.start() for m in re.finditer(" ", text)]
    return resolved([
        Detection(bisect.bisect_left(blanks, a) - 1, bisect.bisect_left(blanks, b), own[i].priority, own[i].label) for a, b, i in spans
    ])


def base_places(words: list[bytes]) -> dict[str, list[int]]:
    """Words at which each base phrase starts, by label."""
    text = b" " + b" ".join(words) + b" "
    out: dict[str, list[int]] = {}
    for phrase, label in BASE_PHRASES.items():
        needle, at = f" {phrase} ".encode(), -1
        places, counted, upto = [], 0, 0
        while (at := text.find(needle, at + 1)) >= 0:
            counted += text.count(b" ", upto, at)
            upto = at
            places.append(counted)
        if places:
            out[label] = places
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule_text: str = SIGNATURES + NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and found (the detections that stay).

    Words are runs of ASCII letters and digits and non-ASCII characters. A null
    text is empty: no words, no labels, score 0. Each row is judged alone.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                words = utf8(text).translate(ALNUM_FOLD).split()
                base = base_places(words)
                found = detections(words, rule_text)
                places = [p for x in base.values() for p in x]
                sure = [CONFIDENCE[d.priority] for d in found] + [CONFIDENCE[WEAK]] * bool(base)
                out.append((
                    len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
                    ",".join(sorted({*base, *(d.label for d in found)})), max(sure, default=0.0),
                    [{"first": d.first, "end": d.end, "priority": d.priority, "label": d.label} for d in found],
                ))
            cols = list(zip(*out, strict=True)) or [[]] * len(_KINDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, _KINDS.values(), strict=True))], ["doc_id", *_KINDS]
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        scan, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
        "score double, found array<struct<first:bigint,end:bigint,priority:int,label:string>>",
    )


_KINDS = {
    "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(),
    "labels": pa.string(), "score": pa.float64(),
    "found": pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("priority", pa.int32()), ("label", pa.string())])),
}
