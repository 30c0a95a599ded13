"""License mentions by ordered signature rules.

A text is reduced to its lower-cased words, joined by single spaces.  A rule is a regular
expression over that stream with a label, a priority and a relevance.  Hand-written rules know the
texts and notices of licenses, their short forms and identifiers, and wordings that only look like
a license, whose label is empty; the product of license families and sentence templates knows the
sentences that name one.  One Aho-Corasick pass finds the keywords in the
stream; only rules whose gate it opens are run.  A gate is read off the rule's pattern, so every
match passes it.  Of the detections, in order of priority and then length, one whose interval lies
inside that of an earlier one is suppressed; what an empty label suppresses gives none.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bound_batches, held

# Fixed values of the contract: phrases with their labels, and what separates words.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes.maketrans(_SEPARATORS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(_SEPARATORS) + b"abcdefghijklmnopqrstuvwxyz")

#: Shorter literals do not gate.
MIN_KEYWORD = 3
_V = r"(?:version |ver |v ?)?"
#: label, names, SPDX words, URL words
FAMILIES = (
    ("mit", r"(?:mit|expat)", r"mit", r"opensource org licenses mit"),
    ("apache-1.1", rf"apache (?:software )?(?:license )?{_V}1 1", r"apache 1 1", r"apache org licenses license 1 1"),
    ("apache-2", rf"apache (?:software )?(?:license )?{_V}2(?: 0)?", r"apache 2 0", r"apache org licenses license 2 0"),
    ("bsd-2-clause", r"(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)", r"bsd 2 clause", r"opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)", r"bsd 3 clause", r"opensource org licenses bsd 3 clause"),
    ("bsd", r"bsd(?: style)?", r"bsd", r"opensource org licenses bsd license"),
    ("isc", r"isc", r"isc", r"opensource org licenses isc"),
    ("zlib", r"zlib(?: libpng)?", r"zlib", r"opensource org licenses zlib"),
    ("boost-1.0", rf"boost software(?: license)?(?: {_V}1 0)?", r"bsl 1 0", r"boost org license 1 0"),
    ("gpl-1", rf"(?:gnu )?(?:general public license|gpl) {_V}1(?: 0)?", r"gpl 1 0(?: only| or later)?", r"gnu org licenses old licenses gpl 1 0"),
    ("gpl-2", rf"(?:gnu )?(?:general public license|gpl) {_V}2(?: 0)?", r"gpl 2 0(?: only| or later)?", r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3", rf"(?:gnu )?(?:general public license|gpl) {_V}3(?: 0)?", r"gpl 3 0(?: only| or later)?", r"gnu org licenses gpl 3 0"),
    ("gpl", r"gnu (?:general public license|gpl)", r"gpl", r"gnu org licenses gpl"),
    ("lgpl-2", rf"(?:gnu )?(?:(?:library|lesser) general public license|lgpl) {_V}2(?: 0)?", r"lgpl 2 0(?: only| or later)?", r"gnu org licenses (?:old licenses )?lgpl 2 0"),
    ("lgpl-2.1", rf"(?:gnu )?(?:lesser general public license|lgpl) {_V}2 1", r"lgpl 2 1(?: only| or later)?", r"gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3", rf"(?:gnu )?(?:lesser general public license|lgpl) {_V}3(?: 0)?", r"lgpl 3 0(?: only| or later)?", r"gnu org licenses lgpl 3 0"),
    ("lgpl", r"gnu (?:(?:library|lesser) general public license|lgpl)", r"lgpl", r"gnu org licenses lgpl"),
    ("agpl-3", rf"(?:gnu )?(?:affero general public license|agpl) {_V}3(?: 0)?", r"agpl 3 0(?: only| or later)?", r"gnu org licenses agpl 3 0"),
    ("agpl", r"gnu (?:affero general public license|agpl)", r"agpl", r"gnu org licenses agpl"),
    ("gfdl", rf"gnu (?:free documentation license|fdl)(?: {_V}1 [123])?", r"gfdl 1 [123](?: only| or later)?", r"gnu org licenses fdl"),
    ("mpl-1.1", rf"mozilla public license {_V}1 1", r"mpl 1 1", r"mozilla org mpl 1 1"),
    ("mpl-2", rf"mozilla public license {_V}2(?: 0)?", r"mpl 2 0", r"mozilla org mpl 2 0"),
    ("epl-1", rf"eclipse public license {_V}1(?: 0)?", r"epl 1 0", r"eclipse org legal epl v10"),
    ("epl-2", rf"eclipse public license {_V}2(?: 0)?", r"epl 2 0", r"eclipse org legal epl 2 0"),
    ("cddl-1", rf"common development and distribution license(?: {_V}1 [01])?", r"cddl 1 [01]", r"opensource org licenses cddl 1 0"),
    ("cpl-1", rf"common public license(?: {_V}1 0)?", r"cpl 1 0", r"opensource org licenses cpl 1 0"),
    ("artistic-1", r"(?:perl )?artistic(?: license 1 0)?", r"artistic 1 0", r"opensource org licenses artistic license 1 0"),
    ("artistic-2", rf"artistic license {_V}2(?: 0)?", r"artistic 2 0", r"opensource org licenses artistic license 2 0"),
    ("python-2", rf"python software foundation license(?: {_V}2)?", r"(?:python|psf) 2 0", r"docs python org license"),
    ("unlicense", r"unlicense", r"unlicense", r"unlicense org"),
    ("wtfpl", r"wtfpl", r"wtfpl", r"wtfpl net"),
    ("eupl-1.2", rf"european union public licen[cs]e(?: {_V}1 2)?", r"eupl 1 2", r"joinup ec europa eu software page eupl"),
    ("ofl-1.1", rf"sil open font license(?: {_V}1 1)?", r"ofl 1 1", r"scripts sil org ofl"),
    ("odbl-1", rf"open database license(?: {_V}1 0)?", r"odbl 1 0", r"opendatacommons org licenses odbl"),
    ("cc0-1.0", r"cc0(?: 1 0)?(?: universal)?", r"cc0 1 0", r"creativecommons org publicdomain zero 1 0"),
    ("cc-by", r"creative commons attribution(?: [1-4] [05])?(?: international| unported)?", r"cc by [1-4] [05]", r"creativecommons org licenses by [1-4]"),
    ("cc-by-sa", r"creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?", r"cc by sa [1-4] [05]", r"creativecommons org licenses by sa"),
    ("cc-by-nd", r"creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported)?", r"cc by nd [1-4] [05]", r"creativecommons org licenses by nd"),
    ("cc-by-nc", r"creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?", r"cc by nc [1-4] [05]", r"creativecommons org licenses by nc [1-4]"),
    ("cc-by-nc-sa", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?", r"cc by nc sa [1-4] [05]", r"creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported)?", r"cc by nc nd [1-4] [05]", r"creativecommons org licenses by nc nd"),
    ("all-rights-reserved", r"all rights reserved", r"licenseref all rights reserved", r"all rights reserved terms"),
)
#: pattern with {name}, {spdx} or {url}; priority; relevance
TEMPLATES = (
    (r"spdx license identifier {spdx}", 100, 1.0),
    (r"(?:https? )?(?:www )?{url}", 90, 0.95),
    (r"(?:licensed|released|distributed|published|available|provided|covered|offered) (?:to you )?(?:under|by|with) (?:the |an |a )?(?:terms (?:and conditions )?of (?:the )?)?{name}(?: licen[cs]e)?", 80, 0.9),
    (r"(?:under|subject to|according to|in accordance with) (?:the )?terms (?:and conditions )?of (?:the )?{name}(?: licen[cs]e)?", 70, 0.85),
    (r"(?:licen[cs]e|licen[cs]ed|licen[cs]ing) (?:is |as |type |name |the )?{name}", 60, 0.7),
    (r"(?:the |a )?{name} (?:style |like )?licen[cs]es?", 50, 0.6),
    (r"copyright (?:c )?(?:[12][0-9]{{3}} )(?:[^ ]+ ){{1,8}}?{name} licen[cs]e", 40, 0.5),
    (r"(?:not|never|nor|without being|no longer|isn t|aren t|wasn t) (?:be |been |yet |currently |longer |now )?(?:licensed|released|distributed|published|available|provided|covered|offered) (?:to you )?(?:under|by|with) (?:the |an |a )?(?:terms (?:and conditions )?of (?:the )?)?{name}(?: licen[cs]e)?", 110, 0.0),
    (r"(?:not|never|nor|no longer|isn t) (?:under|subject to|covered by|compatible with|using) (?:the |an |a )?(?:terms (?:and conditions )?of (?:the )?)?{name}(?: licen[cs]e)?", 110, 0.0),
)

_NAME_OF = r"(?:[^ ]+ ){1,14}?"
_LATER = r"(?: or (?:at your option )?(?:any )?later(?: versions?)?)?"
#: label, pattern; what a license's own text or its notice in a file says
TEXTS = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit-0", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("isc", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("0bsd", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", rf"neither the names? of {_NAME_OF}(?:nor the names of {_NAME_OF})?may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", r"use of this source code is governed by a bsd style license that can be found in the license file"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", r"subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation"),
    ("gpl-2", rf"(?:redistribute it and or )?modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version 2{_LATER}"),
    ("gpl-3", rf"(?:redistribute it and or )?modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version 3{_LATER}"),
    ("gpl-2", r"gnu general public license version 2 june 1991"),
    ("gpl-3", r"gnu general public license version 3 29 june 2007"),
    ("gpl", r"you should have received a copy of the gnu general public license along with this program"),
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("lgpl-2.1", rf"modify it under the terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 2 1{_LATER}"),
    ("lgpl-3", rf"modify it under the terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 3{_LATER}"),
    ("lgpl-2", rf"modify it under the terms of the gnu library general public license as published by the free software foundation (?:either )?version 2{_LATER}"),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:library|program)"),
    ("agpl-3", rf"modify it under the terms of the gnu affero general public license as published by the free software foundation (?:either )?version 3{_LATER}"),
    ("agpl", r"you should have received a copy of the gnu affero general public license along with this program"),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-1", r"made available under the terms of the eclipse public license v(?:ersion)? ?1 0"),
    ("epl-2", r"made available under the terms of the eclipse public license v(?:ersion)? ?2 0"),
    ("epl-1", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl-1", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl-1", r"the accompanying program is provided under the terms of this common public license agreement"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("boost-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("boost-1.0", r"distributed under the boost software license version 1 0"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", r"do what the fuck you want to(?: public license)?"),
    ("cc0-1.0", r"(?:has|have) dedicated the work to the public domain by waiving all of (?:his|her|their|his or her) rights"),
    ("cc0-1.0", r"to the extent possible under law [^ ]+ (?:[^ ]+ ){0,10}?waived all copyright and related or neighboring rights"),
    ("cc-by", r"this work is licensed under a creative commons attribution (?:[1-4] [05] )?(?:international |unported |generic )?license"),
    ("cc-by-sa", r"text is available under the creative commons attribution share ?alike license"),
    ("ofl-1.1", r"this font software is licensed under the sil open font license"),
    ("ofl-1.1", r"the font software may be modified altered or added to"),
    ("artistic-1", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2", r"you are permitted to use the standard version and create and use modified versions for any purpose without restriction provided that you do not distribute"),
    ("python-2", r"psf is making python available to licensee on an as is basis"),
    ("python-2", r"this license agreement is between the python software foundation psf"),
    ("php-3", r"this product includes php software freely available from"),
    ("openssl", r"this product includes software developed by the openssl project"),
    ("ms-pl", r"if you use the software you accept this license if you do not accept the license do not use the software"),
    ("beerware", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("json", r"the software shall be used for good not evil"),
    ("odbl-1", r"is made available under the open database license"),
    ("eupl-1.2", r"licensed under the eupl(?: version| v)? ?1 2"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("x11", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("public-domain", r"(?:is|are|was|were|been|be|hereby) (?:now |also |entirely )?(?:released |placed |dedicated |put )?(?:in|into|to) the public domain"),
    ("proprietary", r"this software is (?:the )?(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", r"unauthorized (?:copying|reproduction|use|distribution) of this (?:file|software|document) (?:via any medium )?is strictly prohibited"),
)
#: label, pattern; identifiers and short forms that stand alone
SHORT = (
    ("gpl-1", r"gplv1(?: 0)?(?: only| or later)?"), ("gpl-2", r"gplv2(?: 0)?(?: only| or later)?"), ("gpl-3", r"gplv3(?: 0)?(?: only| or later)?"),
    ("gpl-1", r"gpl 1 0(?: only| or later)?"), ("gpl-2", r"gpl 2 0(?: only| or later)?"), ("gpl-3", r"gpl 3 0(?: only| or later)?"),
    ("gpl-2", r"gpl2"), ("gpl-3", r"gpl3"), ("gpl-2", r"gnu gpl ?v?2"), ("gpl-3", r"gnu gpl ?v?3"), ("gpl", r"gnu gpl"),
    ("lgpl-2", r"lgplv2(?: 0)?(?: only| or later)?"), ("lgpl-2.1", r"lgplv2 1(?: only| or later)?"), ("lgpl-3", r"lgplv3(?: 0)?(?: only| or later)?"),
    ("lgpl-2", r"lgpl 2 0(?: only| or later)?"), ("lgpl-2.1", r"lgpl 2 1(?: only| or later)?"), ("lgpl-3", r"lgpl 3 0(?: only| or later)?"), ("lgpl", r"gnu lgpl"),
    ("agpl-3", r"agplv3(?: 0)?(?: only| or later)?"), ("agpl-3", r"agpl 3 0(?: only| or later)?"), ("agpl", r"gnu agpl"),
    ("gfdl", r"gfdl 1 [123](?: only| or later)?"), ("gfdl", r"gnu fdl"),
    ("apache-1.1", r"apache 1 1"), ("apache-2", r"apache 2 0"), ("apache-2", r"apache2"), ("apache-2", r"apachev2"), ("apache-2", r"asl 2 0"),
    ("bsd-2-clause", r"bsd 2 clause"), ("bsd-2-clause", r"bsd2"), ("bsd-3-clause", r"bsd 3 clause"), ("bsd-3-clause", r"bsd3"), ("bsd-4-clause", r"bsd 4 clause"), ("0bsd", r"0bsd"),
    ("mpl-1.1", r"mplv1 1"), ("mpl-1.1", r"mpl 1 1"), ("mpl-2", r"mplv2(?: 0)?"), ("mpl-2", r"mpl 2 0"),
    ("epl-1", r"epl 1 0"), ("epl-2", r"epl 2 0"), ("cddl-1", r"cddl 1 [01]"), ("cpl-1", r"cpl 1 0"), ("eupl-1.2", r"eupl 1 2"), ("boost-1.0", r"bsl 1 0"), ("ofl-1.1", r"ofl 1 1"), ("odbl-1", r"odbl 1 0"), ("ms-pl", r"ms pl"), ("ms-rl", r"ms rl"),
    ("python-2", r"psf 2 0"), ("python-2", r"python 2 0 license"), ("artistic-2", r"artistic 2 0"), ("cecill-2.1", r"cecill 2 1"), ("unlicense", r"the unlicense"), ("wtfpl", r"wtfpl"), ("mit-0", r"mit 0"), ("postgresql", r"postgresql license"),
    ("cc0-1.0", r"cc0(?: 1 0)?"), ("cc-by", r"cc by [1-4] [05]"), ("cc-by-sa", r"cc by sa(?: [1-4] [05])?"), ("cc-by-nd", r"cc by nd(?: [1-4] [05])?"), ("cc-by-nc", r"cc by nc(?: [1-4] [05])?"), ("cc-by-nc-sa", r"cc by nc sa(?: [1-4] [05])?"), ("cc-by-nc-nd", r"cc by nc nd(?: [1-4] [05])?"),
    ("apache-2", rf"apache (?:software )?license {_V}2(?: 0)?"), ("gpl-2", rf"gnu general public license {_V}2(?: 0)?"), ("gpl-3", rf"gnu general public license {_V}3(?: 0)?"), ("lgpl-2.1", rf"gnu lesser general public license {_V}2 1"), ("lgpl-3", rf"gnu lesser general public license {_V}3(?: 0)?"),
    ("agpl-3", rf"gnu affero general public license {_V}3(?: 0)?"), ("mpl-2", rf"mozilla public license {_V}2(?: 0)?"), ("epl-2", rf"eclipse public license {_V}2(?: 0)?"), ("boost-1.0", rf"boost software license {_V}1 0"), ("gfdl", r"gnu free documentation license"),
)
#: patterns of what looks like a license and is none
NOT_LICENSES = (
    r"(?:released|distributed|published|available|provided|covered|offered|taught|held|organi[sz]ed) (?:to you )?(?:by|with) (?:the |an |a )?(?:mit|isc|bsd)(?! licen[cs]e)",
    r"(?:at|from|near|by) mit (?:press|media|sloan|open|lincoln|professor|students?|researchers?)",
    r"mit (?:press|media lab|sloan|professor|students?|researchers?|university|licensing office|technology licensing)",
    r"(?:driver s|driving|fishing|hunting|marriage|liquor|gun|medical|nursing|teaching|business|pilot s|dog) licen[cs]es?",
    r"(?:compared|compare|comparison|differs?|alternatives?) (?:to|with|from|of|between) (?:the |a )?(?:mit|bsd|apache|gpl|gnu gpl) licen[cs]es?",
    r"(?:unlike|versus|vs) (?:the |a )?(?:mit|bsd|apache|gpl|gnu gpl) licen[cs]es?",
)


@dataclass(frozen=True)
class Rule:
    label: str
    gate: tuple[frozenset[str], ...]
    pattern: re.Pattern[str]
    priority: int
    relevance: float


def _gate(parsed) -> list[frozenset[str]]:
    """Sets of literals of a parsed pattern; every match contains one of each set.

    What is not a literal, a group, a choice or a repetition only ends a literal.
    """
    gate, run = [], ""
    for op, value in [*parsed, (None, None)]:
        if op is _parser.LITERAL:
            run += chr(value)
            continue
        if len(run) >= MIN_KEYWORD:
            gate.append(frozenset({run}))
        run = ""
        if op is _parser.SUBPATTERN:
            gate += _gate(value[3])
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT, _parser.POSSESSIVE_REPEAT) and value[0] > 0:
            gate += _gate(value[2])
        elif op is _parser.BRANCH:
            # of each alternative the set with the longest least literal
            sets = [max(_gate(x), key=lambda c: min(map(len, c)), default=None) for x in value[1]]
            if all(sets):
                gate.append(frozenset().union(*sets))
    return gate


def _rule(label: str, pattern: str, priority: int, relevance: float) -> Rule:
    pattern = f" {pattern}(?= )"
    return Rule(label, tuple(dict.fromkeys(_gate(_parser.parse(pattern)))), re.compile(pattern), priority, relevance)


def build_rules(families=FAMILIES, templates=TEMPLATES) -> list[Rule]:
    """The hand-written rules, and one for each family and template; no relevance, no label."""
    rules = [_rule("", pattern, 85, 0.0) for pattern in NOT_LICENSES]
    rules += [_rule(label, pattern, 95, 1.0) for label, pattern in TEXTS]
    rules += [_rule(label, pattern, 30, 0.6) for label, pattern in SHORT]
    for template, priority, relevance in templates:
        for label, name, spdx, url in families:
            rules.append(_rule(label if relevance else "", template.format(name=f"(?:{name})", spdx=f"(?:{spdx})", url=f"(?:{url})"), priority, relevance))
    return rules


class _Ends:
    """Intervals; the farthest end among those that begin at or before a place, in log time."""

    def __init__(self, starts: list[int]):
        self.starts = sorted(set(starts))
        self.far = [-1] * (len(self.starts) + 1)

    def add(self, start: int, end: int) -> None:
        i = bisect.bisect_left(self.starts, start) + 1
        while i < len(self.far):
            self.far[i] = max(self.far[i], end)
            i += i & -i

    def upto(self, start: int) -> int:
        i, far = bisect.bisect_right(self.starts, start), -1
        while i:
            far = max(far, self.far[i])
            i -= i & -i
        return far


class Scanner:
    """Detects licenses in one text at a time."""

    def __init__(self):
        import ahocorasick

        self.rules = build_rules()
        self.automaton = ahocorasick.Automaton()
        for word in {w for r in self.rules for keywords in r.gate for w in keywords}:
            self.automaton.add_word(word, word)
        self.automaton.make_automaton()

    def detections(self, stream: str) -> list[tuple[int, int, Rule]]:
        """(start, end, rule) of what is left after suppression; offsets into the stream.

        A word of an empty label stands for nothing and is not returned.
        """
        present = {w for _, w in self.automaton.iter(stream)}
        found = [(m.start() + 1, m.end(), r) for r in self.rules if not any(map(present.isdisjoint, r.gate)) for m in r.pattern.finditer(stream)]
        found.sort(key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].label))
        kept, ends = [], _Ends([a for a, _, _ in found])
        for a, b, r in found:
            if ends.upto(a) < b:
                ends.add(a, b)
                kept.append((a, b, r))
        return [x for x in kept if x[2].label]


def words(text: str | None) -> list[bytes]:
    """The lower-cased words of a text, as UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


def _places(stream: str, phrase: str) -> list[int]:
    """Starts in the stream of a phrase that stands between spaces."""
    out, at = [], stream.find(f" {phrase} ")
    while at >= 0:
        out.append(at)
        at = stream.find(f" {phrase} ", at + 1)
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = held("licenses", Scanner)
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            w = words(text)
            stream = f" {b' '.join(w).decode()} "
            base = [(at, label) for phrase, label in BASE_PHRASES for at in _places(stream, phrase)]
            found = scanner.detections(stream)
            # places of spaces, of which there is one before each word
            gaps = np.flatnonzero(np.frombuffer(stream.encode("utf-32-le"), "<u4") == 0x20) if base or found else ()
            nth = lambda at: int(np.searchsorted(gaps, at))  # noqa: E731  the word that begins after this space
            labels = {x for _, x in base}
            every = sorted(labels | {r.label for _, _, r in found})
            spans = ",".join(f"{r.label}:{nth(a - 1)}:{nth(b)}" for a, b, r in sorted(found, key=lambda x: x[:2]))
            score = max([r.relevance for _, _, r in found] + [1.0] * bool(base), default=0.0)
            rows.append((len(w), len(base), nth(min(base)[0]) if base else None, nth(max(base)[0]) if base else None, ",".join(sorted(labels)), ",".join(every), score, spans))
        columns = list(zip(*rows, strict=True)) or [()] * 8
        kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, detections.

    ``docs`` needs doc_id and text; other columns are ignored.  ``detections`` lists what the
    rules found as label:first word:word after the last; ``score`` is the highest relevance, 1 for
    a base phrase.

    Defined results: a null text is empty and has no labels; a null doc_id stays null; repeated
    rows give repeated rows.  An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections string")
