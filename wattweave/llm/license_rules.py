"""Signature rules of licenses: regular expressions over lower-case words with one blank between them.

A rule has a label, a priority and a pattern. Priorities, strongest first: a
machine-readable tag, a name with its version or a link to the text, a sentence of the text or of its
notice, a bare mention. ``(?: word){0,n}`` lets words in between. Alternatives
stand inside groups only, so that the longest stretch of plain text outside of
groups is in every match: that is the rule's keyword.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

TAG, NAME, NOTICE, MENTION = range(4)
#: How far a detection of each priority is trusted.
TRUST = (0.99, 0.9, 0.8, 0.6)


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    pattern: str  # over padded words, see padded()
    keyword: str
    stem: str


# label: (identifiers of tags, names with version and links, notices and sentences, mentions)
FAMILIES: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "gpl-1.0": (("gpl 1 0",), ("gnu general public license(?: as published by the free software foundation)?(?: either)? v(?:ersion )?1(?: 0)?", "gnu org licenses(?: old licenses)? gpl 1 0"), (), ("gplv1", "gpl 1")),
    "gpl-2.0": (
        ("gpl 2 0",),
        ("gnu general public license(?: as published by the free software foundation)?(?: either)? v(?:ersion )?2(?: 0)?", "gnu gpl v(?:ersion )?2(?: 0)?", "gnu org licenses(?: old licenses)? gpl 2 0"),
        ("version 2 of the license or(?: at your option)? any later version", "gnu general public license version 2 june 1991"),
        ("gplv2", "gpl v2", "gpl 2"),
    ),
    "gpl-3.0": (
        ("gpl 3 0",),
        ("gnu general public license(?: as published by the free software foundation)?(?: either)? v(?:ersion )?3(?: 0)?", "gnu gpl v(?:ersion )?3(?: 0)?", "gnu org licenses gpl 3 0"),
        ("version 3 of the license or(?: at your option)? any later version", "gnu general public license version 3 29 june 2007"),
        ("gplv3", "gpl v3", "gpl 3"),
    ),
    "gpl": (
        (),
        ("gnu org licenses gpl",),
        (
            "free software you can redistribute it and or modify it under the terms of the gnu general public license",
            "you should have received a copy of the gnu general public license",
            "licensed under the(?: terms of the)? gnu general public license",
            "released under the(?: terms of the)? gnu general public license",
        ),
        ("gnu general public license", "gnu gpl", "gpl licen[sc]ed?", "under the gpl"),
    ),
    "lgpl-2.0": (("lgpl 2 0",), ("gnu library general public license(?: v(?:ersion )?2(?: 0)?)?", "gnu org licenses(?: old licenses)? lgpl 2 0"), (), ("lgplv2", "lgpl 2 0")),
    "lgpl-2.1": (("lgpl 2 1",), ("gnu lesser general public license(?: as published by the free software foundation)?(?: either)? v(?:ersion )?2 1", "gnu org licenses(?: old licenses)? lgpl 2 1"), ("version 2 1 of the license or(?: at your option)? any later version",), ("lgplv2 1", "lgpl v2 1", "lgpl 2 1")),
    "lgpl-3.0": (("lgpl 3 0",), ("gnu lesser general public license(?: as published by the free software foundation)?(?: either)? v(?:ersion )?3(?: 0)?", "gnu org licenses lgpl 3 0"), (), ("lgplv3", "lgpl v3", "lgpl 3")),
    "lgpl": ((), (), ("modify it under the terms of the gnu lesser general public license", "you should have received a copy of the gnu lesser general public license"), ("gnu lesser general public license", "gnu lgpl", "under the lgpl")),
    "agpl-3.0": (("agpl 3 0",), ("gnu affero general public license(?: as published by the free software foundation)?(?: either)? v(?:ersion )?3(?: 0)?", "gnu org licenses agpl 3 0"), ("you should have received a copy of the gnu affero general public license",), ("agplv3", "agpl v3", "agpl 3")),
    "agpl": ((), (), (), ("gnu affero general public license", "gnu agpl", "under the agpl")),
    "gfdl": (("gfdl 1 1", "gfdl 1 2", "gfdl 1 3"), ("gnu free documentation license(?: v(?:ersion )?1 [123])?", "gnu org licenses fdl"), ("with no invariant sections no front cover texts and no back cover texts",), ("gfdl",)),
    "apache-1.1": (("apache 1 1",), ("apache(?: software)? license(?: v(?:ersion )?)?1 1",), ("this product includes software developed by the apache software foundation",), ()),
    "apache-2.0": (
        ("apache 2 0",),
        ("apache(?: software)? license(?: v(?:ersion )?)?(?: version)? 2(?: 0)?", "apache(?: software)? license v2(?: 0)?", "apache org licenses license 2 0"),
        ("licensed under the apache license version 2 0", "licensed to the apache software foundation asf under one or more contributor license agreements", "you may not use this file except in compliance with the license"),
        ("apache 2 0 licen[sc]ed?", "asl 2 0"),
    ),
    "apache": ((), ("apache org licenses",), ("(?:licensed|released|distributed|available) under the apache license",), ("apache license", "apache software license", "apache licensed")),
    "mit": (
        ("mit",),
        ("opensource org licenses mit(?: license)?", "mit license(?: https?)? (?:www )?opensource org"),
        (
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
            "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
            "(?:licensed|released|distributed|available|published) under the(?: terms of the)? mit license",
        ),
        ("mit license", "the mit licence", "mit licensed", "mit expat", "expat license", "x11 mit"),
    ),
    "mit-0": (("mit 0",), ("mit no attribution(?: license)?",), (), ("mit 0 license",)),
    "x11": (("x11",), ("x11 license",), ("except as contained in this notice the name of the x consortium shall not be used",), ()),
    "bsd-2-clause": (
        ("bsd 2 clause",),
        ("(?:simplified|freebsd) bsd license", "bsd 2 clause(?: license)?", "2 clause bsd(?: license)?", "two clause bsd(?: license)?", "opensource org licenses bsd 2 clause"),
        ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
        (),
    ),
    "bsd-3-clause": (
        ("bsd 3 clause",),
        ("(?:new|modified|revised) bsd license", "bsd 3 clause(?: license)?", "3 clause bsd(?: license)?", "three clause bsd(?: license)?", "opensource org licenses bsd 3 clause"),
        ("neither the name of(?: [^ ]+){1,12} may be used to endorse or promote products derived from this software",),
        (),
    ),
    "bsd-4-clause": (("bsd 4 clause",), ("bsd 4 clause(?: license)?", "4 clause bsd(?: license)?", "original bsd license"), ("all advertising materials mentioning features or use of this software must display the following acknowledgement",), ()),
    "0bsd": (("0bsd",), ("zero clause bsd(?: license)?", "bsd zero clause(?: license)?"), ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided",), ()),
    "bsd": ((), (), ("redistribution and use in source and binary forms with or without modification are permitted",), ("bsd license", "bsd licensed", "bsd style license", "under the bsd")),
    "isc": (("isc",), ("isc license(?: iscl)?", "opensource org licenses isc"), ("permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided",), ("isc licensed",)),
    "mpl-1.0": (("mpl 1 0",), ("mozilla public license(?: v(?:ersion )?)?(?: version)? 1 0",), (), ("mpl 1 0",)),
    "mpl-1.1": (("mpl 1 1",), ("mozilla public license(?: v(?:ersion )?)?(?: version)? 1 1", "mozilla org mpl 1 1"), ("the contents of this file are subject to the mozilla public license version 1 1",), ("mpl 1 1",)),
    "mpl-2.0": (("mpl 2 0",), ("mozilla public license(?: v(?:ersion )?)?(?: version)?(?: v)? 2 0", "mozilla org mpl 2 0"), ("this source code form is subject to the terms of the mozilla public license v 2 0",), ("mpl 2 0", "mplv2")),
    "mpl": ((), (), (), ("mozilla public license",)),
    "epl-1.0": (("epl 1 0",), ("eclipse public license(?: v(?:ersion )?)?(?: version)? 1 0", "eclipse org legal epl v10"), (), ("epl 1 0",)),
    "epl-2.0": (("epl 2 0",), ("eclipse public license(?: v(?:ersion )?)?(?: version)? 2 0", "eclipse org legal epl 2 0"), ("made available under the terms of the eclipse public license 2 0",), ("epl 2 0",)),
    "epl": ((), (), (), ("eclipse public license",)),
    "cddl-1.0": (("cddl 1 0",), ("common development and distribution license(?: cddl)?(?: version)? 1 0",), ("the contents of this file are subject to the terms of the common development and distribution license",), ("common development and distribution license", "cddl")),
    "cpl-1.0": (("cpl 1 0",), ("common public license(?: version)? 1 0",), ("accompanying program is provided under the terms of this common public license",), ("common public license",)),
    "ipl-1.0": (("ipl 1 0",), ("ibm public license(?: version)? 1 0",), (), ("ibm public license",)),
    "cecill": (("cecill 2 0", "cecill 2 1", "cecill b", "cecill c"), ("cecill free software license(?: agreement)?", "cecill info licences"), ("governed by the cecill(?: [^ ]+){0,2} license under french law",), ("cecill",)),
    "eupl": (("eupl 1 1", "eupl 1 2"), ("european union public licen[sc]e(?: eupl)?(?: v(?:ersion )?)?(?: 1 [12])?",), ("licensed under the eupl",), ("eupl",)),
    "artistic-1.0": (("artistic 1 0",), ("artistic license(?: version)? 1 0",), (), ()),
    "artistic-2.0": (("artistic 2 0",), ("artistic license(?: version)? 2 0", "opensource org licenses artistic license 2 0"), (), ()),
    "artistic": ((), (), ("under the same terms as perl itself",), ("artistic license",)),
    "bsl-1.0": (("bsl 1 0",), ("boost software license(?: version)?(?: v)? 1 0", "boost org license 1 0 txt"), ("distributed under the boost software license",), ("boost software license",)),
    "busl-1.1": (("busl 1 1",), ("business source license(?: version)? 1 1", "mariadb com bsl11"), ("change license(?: [^ ]+){0,12} change date",), ("business source license",)),
    "zlib": (("zlib",), ("zlib(?: libpng)? license", "opensource org licenses zlib"), ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",), ()),
    "libpng": (("libpng", "libpng 2 0"), ("libpng license", "png reference library license"), (), ()),
    "ijg": (("ijg",), (), ("this software is based in part on the work of the independent jpeg group",), ()),
    "unlicense": (("unlicense",), ("the unlicense", "unlicense org"), ("this is free and unencumbered software released into the public domain",), ("unlicense",)),
    "wtfpl": (("wtfpl",), ("do what the fuck you want to public license", "wtfpl net"), (), ("wtfpl",)),
    "public-domain": ((), (), ("(?:released|placed|dedicated|dedicate) (?:in|into|to) the public domain", "this work is in the public domain", "dedicates? any and all copyright interest"), ("public domain",)),
    "cc0-1.0": (("cc0 1 0",), ("cc0 1 0(?: universal)?", "creativecommons org publicdomain zero 1 0", "creative commons zero(?: v1 0)?(?: universal)?"), ("waived all copyright and related or neighboring rights",), ("cc0",)),
    "cc-by-1.0": (("cc by 1 0",), ("cc by 1 0", "creative commons attribution 1 0", "creativecommons org licenses by 1 0"), (), ()),
    "cc-by-2.0": (("cc by 2 0",), ("cc by 2 0", "creative commons attribution 2 0", "creativecommons org licenses by 2 0"), (), ()),
    "cc-by-2.5": (("cc by 2 5",), ("cc by 2 5", "creative commons attribution 2 5", "creativecommons org licenses by 2 5"), (), ()),
    "cc-by-3.0": (("cc by 3 0",), ("cc by 3 0", "creative commons attribution 3 0", "creativecommons org licenses by 3 0"), (), ()),
    "cc-by-4.0": (("cc by 4 0",), ("cc by 4 0", "creative commons attribution 4 0", "creativecommons org licenses by 4 0"), (), ()),
    "cc-by-sa-3.0": (("cc by sa 3 0",), ("cc by sa 3 0", "creative commons attribution share ?alike 3 0", "creativecommons org licenses by sa 3 0"), (), ()),
    "cc-by-sa-4.0": (("cc by sa 4 0",), ("cc by sa 4 0", "creative commons attribution share ?alike 4 0", "creativecommons org licenses by sa 4 0"), (), ()),
    "cc-by-nd-4.0": (("cc by nd 4 0",), ("cc by nd 4 0", "creative commons attribution no ?deriv(?:ative)?s 4 0", "creativecommons org licenses by nd 4 0"), (), ()),
    "cc-by-nc-3.0": (("cc by nc 3 0",), ("cc by nc 3 0", "creative commons attribution non ?commercial 3 0", "creativecommons org licenses by nc 3 0"), (), ()),
    "cc-by-nc-4.0": (("cc by nc 4 0",), ("cc by nc 4 0", "creative commons attribution non ?commercial 4 0", "creativecommons org licenses by nc 4 0"), (), ()),
    "cc-by-nc-sa-4.0": (("cc by nc sa 4 0",), ("cc by nc sa 4 0", "creative commons attribution non ?commercial share ?alike 4 0", "creativecommons org licenses by nc sa 4 0"), (), ()),
    "cc-by-nc-nd-4.0": (("cc by nc nd 4 0",), ("cc by nc nd 4 0", "creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0", "creativecommons org licenses by nc nd 4 0"), (), ()),
    "cc-by-sa": ((), (), (), ("cc by sa", "creative commons attribution share ?alike", "creativecommons org licenses by sa")),
    "cc-by-nd": ((), (), (), ("cc by nd", "creative commons attribution no ?deriv(?:ative)?s", "creativecommons org licenses by nd")),
    "cc-by-nc": ((), (), (), ("cc by nc", "creative commons attribution non ?commercial", "creativecommons org licenses by nc")),
    "cc-by": ((), (), (), ("cc by", "creative commons attribution", "creativecommons org licenses by")),
    "creative-commons": ((), (), ("licensed under(?: an?| the)? creative commons",), ("creative commons licen[sc]e",)),
    "odbl-1.0": (("odbl 1 0",), ("open database licen[sc]e(?: odbl)?(?: v(?:ersion )?)?(?: 1 0)?", "opendatacommons org licenses odbl"), (), ("odbl",)),
    "odc-by-1.0": (("odc by 1 0",), ("open data commons attribution license", "opendatacommons org licenses by"), (), ()),
    "pddl-1.0": (("pddl 1 0",), ("open data commons public domain dedication", "opendatacommons org licenses pddl"), (), ()),
    "ogl-uk-3.0": (("ogl uk 3 0",), ("open government licen[sc]e v(?:ersion )?3 0", "open government licen[sc]e(?: [^ ]+)? 3 0"), ("contains public sector information licensed under the open government licence",), ()),
    "python-2.0": (("python 2 0",), ("python software foundation license(?: version 2)?", "psf license agreement"), ("this license agreement is between the python software foundation",), ("psf license",)),
    "php-3.01": (("php 3 01",), ("php license(?: version)? 3 01", "php net license 3 01"), ("this product includes php software freely available from",), ("php license",)),
    "ruby": (("ruby",), ("ruby license",), ("same terms as ruby",), ()),
    "postgresql": (("postgresql",), ("postgresql licen[sc]e",), ("permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted",), ()),
    "openssl": (("openssl",), ("openssl license", "openssl ssleay license"), ("this product includes software developed by the openssl project",), ()),
    "ncsa": (("ncsa",), ("university of illinois ncsa open source license",), (), ("ncsa license",)),
    "ofl-1.1": (("ofl 1 1",), ("sil open font license(?: version)?(?: 1 1)?", "scripts sil org ofl"), ("this font software is licensed under the sil open font license",), ("open font license",)),
    "lppl-1.3c": (("lppl 1 3c",), ("latex project public license(?: [^ ]+){0,2} 1 3c?", "latex project org lppl"), (), ("latex project public license", "lppl")),
    "ms-pl": (("ms pl",), ("microsoft public license(?: ms pl)?",), (), ()),
    "ms-rl": (("ms rl",), ("microsoft reciprocal license(?: ms rl)?",), (), ()),
    "upl-1.0": (("upl 1 0",), ("universal permissive license(?: upl)?(?: v(?:ersion )?)?(?: 1 0)?",), (), ()),
    "afl-3.0": (("afl 3 0",), ("academic free license(?: v(?:ersion )?)?(?: version)?(?: 3 0)?",), (), ()),
    "osl-3.0": (("osl 3 0",), ("open software license(?: v(?:ersion )?)?(?: version)?(?: 3 0)?",), (), ()),
    "ecl-2.0": (("ecl 2 0",), ("educational community license(?: version)?(?: 2 0)?",), (), ()),
    "beerware": (("beerware",), ("beer ware license",), ("if we meet some day and you think this stuff is worth it you can buy me a beer in return",), ("beerware",)),
    "sspl-1.0": (("sspl 1 0",), ("server side public license(?: v(?:ersion )?)?(?: 1)?",), (), ("sspl",)),
    "elastic-2.0": (("elastic 2 0",), ("elastic license(?: v(?:ersion )?)?(?: 2 0)?",), ("you may not provide the software to third parties as a hosted or managed service",), ()),
    "openrail": ((), ("(?:creativeml|bigscience|bigcode) openrail(?: m)?(?: license)?", "(?:creativeml|bigscience|bigcode) open rail(?: m)?(?: license)?"), ("use based restrictions(?: [^ ]+){0,12} attachment a",), ("openrail",)),
    "proprietary": ((), (), ("all rights reserved no part of this(?: [^ ]+){1,4} may be reproduced", "unauthorized copying of this file via any medium is strictly prohibited", "proprietary and confidential"), ("all rights reserved",)),
}

#: Beginnings of words; the plain text of every rule has one, so a text without any needs no rule.
STEMS = (
    "licen", "spdx", "gpl", "lgpl", "agpl", "gnu", "gfdl", "mit  expat", "mit  no  attribution", "x11", "bsd", "apache", "asl", "mozilla", "mpl", "creative", "cc0", "cc  by", "copyright", "public", "redistribut",
    "granted", "epl", "lppl", "odbl", "cddl", "unlicense", "wtfpl", "eupl", "sspl", "openrail", "open  rail", "opendatacommons", "beer", "software", "cecill", "perl", "ruby", "invariant", "consortium",
    "unauthorized", "proprietary", "bsl", "scripts  sil", "use  based", "rights  reserved", "permitted", "gplv", "lgplv", "agplv", "mplv", "zero  clause", "document", "acknowledgement",
)


def padded(pattern: str) -> str:
    """A pattern over words with a blank on both sides of each, so two between neighbours: matches never share a blank."""
    doubled = re.sub(r"(?<!\^) ", "  ", pattern)
    return f" {doubled.replace('  ?', '(?:  )?')} "


def plain_texts(pattern: str) -> list[str]:
    """The stretches of plain text that every match of a padded pattern holds."""
    plain, depth, i = [""], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c in "[{":
            i = pattern.index("]" if c == "[" else "}", i)
            plain.append("")
        elif c in "()":
            depth += 1 if c == "(" else -1
            plain.append("")
        elif c in "?+*":
            plain[-1] = plain[-1][:-1]
            plain.append("")
        elif depth == 0:
            plain[-1] += c
        i += 1
    return plain


def _rule(label: str, priority: int, pattern: str) -> Rule:
    plain = plain_texts(pattern)
    stem = next(s for s in STEMS if any(f" {s}" in text for text in plain))
    return Rule(label, priority, pattern, max(plain, key=len), f" {stem}")


@lru_cache
def rules() -> tuple[Rule, ...]:
    """All rules, by priority and then as listed; a rule's place in this order is its rank."""
    found = []
    for label, (ids, *others) in FAMILIES.items():
        tags = [f"spdx license identifier {x}(?: only| or later)?" for x in ids]
        found += [_rule(label, priority, padded(p)) for priority, patterns in enumerate((tags, *others)) for p in patterns]
    return tuple(sorted(found, key=lambda r: r.priority))
