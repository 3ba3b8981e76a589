"""The ordered signature rules of the licence scan.

Patterns are matched against a text's normalised words joined by single
spaces, with a space at either end, so ``2.0`` reads ``2 0`` and every pattern
is bounded by spaces. Families are spelled out once and combined with their
versions and phrasings; headers, identifiers, everyday forms and clauses are
written out one by one. The result is a list of over 400 rules in a fixed order.
"""

from __future__ import annotations

from typing import NamedTuple

NOTICE, TITLE, REFERENCE = 3, 2, 1  # priorities: a full notice beats a title, a title beats a bare mention


class Rule(NamedTuple):
    keyword: str  # cheap substring that any match contains
    pattern: str
    label: str
    priority: int


_LEAD = r"(?:licensed|released|distributed|available|provided|published|made available) (?:under|subject to) (?:the )?(?:terms of )?(?:the )?"
_V = r"(?: public)?(?: licen[sc]e)?(?: version| v)? ?"

#: family label, keyword, name pattern, versions ("" = unversioned)
_FAMILIES = [
    ("apache", "apache", r"apache(?: software)?", ["1 0", "1 1", "2 0"]),
    ("mpl", "mozilla", r"mozilla", ["1 0", "1 1", "2 0"]),
    ("epl", "eclipse", r"eclipse", ["1 0", "2 0"]),
    ("gpl", "gnu", r"gnu(?: general)?", ["1", "2", "3"]),
    ("lgpl", "lesser", r"(?:gnu )?lesser general", ["2 1", "3"]),
    ("lgpl", "library", r"(?:gnu )?library general", ["2"]),
    ("agpl", "affero", r"(?:gnu )?affero(?: general)?", ["1", "3"]),
    ("gfdl", "documentation", r"(?:gnu )?free documentation", ["1 1", "1 2", "1 3"]),
    ("eupl", "european", r"european union", ["1 0", "1 1", "1 2"]),
    ("cddl", "common", r"common development and distribution", ["1 0", "1 1"]),
    ("cpl", "common", r"common", ["1 0"]),
    ("osl", "open", r"open software", ["1 0", "2 0", "3 0"]),
    ("afl", "academic", r"academic free", ["1 1", "2 0", "3 0"]),
    ("artistic", "artistic", r"artistic", ["1 0", "2 0"]),
    ("bsl", "boost", r"boost(?: software)?", ["1 0"]),
    ("ms-pl", "microsoft", r"microsoft", [""]),
    ("mit", "mit", r"mit", [""]),
    ("isc", "isc", r"isc", [""]),
    ("zlib", "zlib", r"zlib(?: libpng)?", [""]),
    ("bsd-2-clause", "simplified", r"(?:simplified bsd|bsd simplified)", [""]),
    ("bsd-3-clause", "bsd", r"(?:new|revised|modified) bsd", [""]),
    ("bsd", "bsd", r"bsd", [""]),
    ("unlicense", "unlicense", r"unlicense", [""]),
    ("wtfpl", "wtfpl", r"wtfpl", [""]),
    ("postgresql", "postgresql", r"postgresql", [""]),
    ("ofl", "sil", r"sil open font", ["1 0", "1 1"]),
    ("odbl", "database", r"open database", ["1 0"]),
    ("odc-by", "data", r"open data commons attribution", ["1 0"]),
    ("ecl", "educational", r"educational community", ["1 0", "2 0"]),
    ("upl", "universal", r"universal permissive", ["1 0"]),
]

#: creative commons: element codes, their words in full
_CC = [
    ("by", "attribution"),
    ("by sa", "attribution share ?alike"),
    ("by nc", "attribution non ?commercial"),
    ("by nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
    ("by nc sa", "attribution non ?commercial share ?alike"),
    ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
]
_CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]

#: identifiers as used in file headers, as words, and their labels
_SPDX = [
    ("mit", "mit"), ("isc", "isc"), ("0bsd", "0bsd"), ("zlib", "zlib"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("ncsa", "ncsa"), ("postgresql", "postgresql"),
    ("apache 1 1", "apache-1.1"), ("apache 2 0", "apache-2.0"), ("mpl 1 1", "mpl-1.1"), ("mpl 2 0", "mpl-2.0"), ("epl 1 0", "epl-1.0"), ("epl 2 0", "epl-2.0"), ("eupl 1 2", "eupl-1.2"),
    ("bsd 2 clause", "bsd-2-clause"), ("bsd 3 clause", "bsd-3-clause"), ("bsd 4 clause", "bsd-4-clause"), ("bsl 1 0", "bsl-1.0"), ("artistic 2 0", "artistic-2.0"), ("cc0 1 0", "cc0"), ("ofl 1 1", "ofl-1.1"), ("cddl 1 0", "cddl-1.0"),
    *[(f"{name} {version}{tail}", f"{name}-{version.replace(' ', '.')}{tail.replace(' ', '-')}") for name, versions in (("gpl", ("1 0", "2 0", "3 0")), ("lgpl", ("2 0", "2 1", "3 0")), ("agpl", ("1 0", "3 0")), ("gfdl", ("1 2", "1 3"))) for version in versions for tail in ("", " only", " or later")],
]

#: forms that people write: keyword, pattern, label, priority
_FORMS = [
    ("licen", r"mit licensed", "mit", TITLE),
    ("licen", r"mit style licen[sc]e", "mit", REFERENCE),
    ("licen", r"licen[sc]e mit", "mit", REFERENCE),
    ("licen", r"(?:mit )?x11 licen[sc]e", "mit", TITLE),
    ("licen", r"expat licen[sc]e", "mit", TITLE),
    ("apache", r"mit (?:and|or) apache", "mit", REFERENCE),
    ("licen", r"licen[sc]e isc", "isc", REFERENCE),
    ("licen", r"isc licensed", "isc", TITLE),
    ("apache", r"apache(?: v)? ?v?2 0", "apache-2.0", TITLE),
    ("apache", r"apache v?2", "apache-2.0", REFERENCE),
    ("apache", r"apache licensed", "apache", REFERENCE),
    ("asl", r"licen[sc]e asl ?v?2 0", "apache-2.0", REFERENCE),
    ("clause", r"bsd 2 clause(?: simplified)?(?: licen[sc]e)?", "bsd-2-clause", TITLE),
    ("clause", r"(?:2|two) clause bsd(?: licen[sc]e)?", "bsd-2-clause", TITLE),
    ("clause", r"bsd 3 clause(?: new| revised)?(?: licen[sc]e)?", "bsd-3-clause", TITLE),
    ("clause", r"(?:3|three) clause bsd(?: licen[sc]e)?", "bsd-3-clause", TITLE),
    ("clause", r"bsd 4 clause(?: licen[sc]e)?", "bsd-4-clause", TITLE),
    ("clause", r"(?:4|four) clause bsd(?: licen[sc]e)?", "bsd-4-clause", TITLE),
    ("licen", r"bsd licensed", "bsd", TITLE),
    ("licen", r"bsd style licen[sc]e", "bsd", REFERENCE),
    ("licen", r"licen[sc]e bsd", "bsd", REFERENCE),
    ("unlicense", r"(?:released|licensed|distributed) under (?:the )?unlicense", "unlicense", NOTICE),
    ("unlicense", r"the unlicense", "unlicense", TITLE),
    ("unlicense", r"licen[sc]e unlicense", "unlicense", REFERENCE),
    ("eupl", r"eupl(?: version| v)? ?v?1 0", "eupl-1.0", TITLE),
    ("eupl", r"eupl(?: version| v)? ?v?1 1", "eupl-1.1", TITLE),
    ("eupl", r"eupl(?: version| v)? ?v?1 2", "eupl-1.2", TITLE),
    ("creative", r"creative commons (?:zero|0|cc0)(?: 1 0)?(?: universal)?(?: licen[sc]e)?", "cc0", TITLE),
    ("creativecommons", r"creativecommons org publicdomain zero 1 0", "cc0", NOTICE),
    ("creativecommons", r"creativecommons org publicdomain mark 1 0", "public-domain", NOTICE),
    ("fuck", r"do what the fuck you want to public licen[sc]e", "wtfpl", TITLE),
    ("wtfpl", r"(?:licensed under|licen[sc]e|under) (?:the )?wtfpl", "wtfpl", TITLE),
    ("python", r"python software foundation licen[sc]e(?: version 2| v?2)?", "psf-2.0", TITLE),
    ("python", r"psf licen[sc]e python", "psf-2.0", REFERENCE),
    ("licen", r"psf licen[sc]e", "psf-2.0", TITLE),
    ("licen", r"licen[sc]e psf 2 0", "psf-2.0", TITLE),
    ("licen", r"(?:licen[sc]e|licensed under)(?: the)? mpl(?: v)? ?v?2 0", "mpl-2.0", TITLE),
    ("licen", r"(?:licen[sc]e|licensed under)(?: the)? mpl(?: v)? ?v?1 1", "mpl-1.1", TITLE),
    ("licen", r"(?:licen[sc]e|licensed under)(?: the)? epl(?: v)? ?v?2 0", "epl-2.0", TITLE),
    ("licen", r"(?:licen[sc]e|licensed under)(?: the)? epl(?: v)? ?v?1 0", "epl-1.0", TITLE),
    ("licen", r"(?:licen[sc]e|licensed under)(?: the)? bsl 1 0", "bsl-1.0", TITLE),
    ("licen", r"(?:licen[sc]e|licensed under)(?: the)? ofl 1 1", "ofl-1.1", TITLE),
    ("licen", r"(?:licen[sc]e|licensed under)(?: the)? 0bsd", "0bsd", TITLE),
    ("licen", r"zero clause bsd licen[sc]e", "0bsd", TITLE),
    ("licen", r"(?:licen[sc]e|licensed under)(?: the)? cddl 1 0", "cddl-1.0", TITLE),
    ("licen", r"(?:licen[sc]e|licensed under)(?: the)? odbl 1 0", "odbl-1.0", TITLE),
    ("licen", r"ncsa(?: open source)? licen[sc]e", "ncsa", TITLE),
    ("licen", r"openssl licen[sc]e", "openssl", TITLE),
    ("licen", r"php licen[sc]e(?: version 3 01| 3 01)?", "php", TITLE),
    ("licen", r"ruby licen[sc]e", "ruby", TITLE),
    ("licen", r"vim licen[sc]e", "vim", TITLE),
    ("licen", r"json licen[sc]e", "json", TITLE),
    ("licen", r"cecill(?: b| c)? ?(?:free software )?licen[sc]e", "cecill", TITLE),
    ("licen", r"beerware licen[sc]e", "beerware", TITLE),
    ("licen", r"server side public licen[sc]e(?: version 1| v1)?", "sspl-1.0", TITLE),
    ("licen", r"business source licen[sc]e(?: 1 1| version 1 1)?", "busl-1.1", TITLE),
    ("licen", r"elastic licen[sc]e(?: 2 0| v2)?", "elastic-2.0", TITLE),
    ("licen", r"open government licen[sc]e(?: v3 0| version 3 0)?", "ogl-3.0", TITLE),
]

#: clauses that stand for a licence when its name is missing
_CLAUSES = [
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software"),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the licen[sc]e"),
    ("zlib", "provided", r"this software is provided as is without any express or implied warranty"),
    ("public-domain", "public", r"(?:released|dedicated|placed) (?:in)?to the public domain"),
    ("public-domain", "public", r"this work is in the public domain"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("proprietary", "proprietary", r"proprietary and confidential"),
    ("proprietary", "unauthorized", r"unauthorized copying of this (?:file|work|document)"),
    ("proprietary", "permission", r"(?:may not be|no part) reproduced without (?:prior )?(?:written )?permission"),
    ("copyright", "copyright", r"copyright(?: c)? (?:19|20)\d\d"),
]


def _dotted(version: str) -> str:
    return version.replace(" ", ".")


def build_rules() -> list[Rule]:
    rules: list[Rule] = []
    for label, keyword, name, versions in _FAMILIES:
        for version in versions:
            full = f"{label}-{_dotted(version)}" if version else label
            tail = _V + version if version else r" licen[sc]e"
            rules.append(Rule(keyword, _LEAD + name + tail, full, NOTICE))
            rules.append(Rule(keyword, r"(?:the )?" + name + (r"(?: public)? licen[sc]e(?: version| v)? ?" + version if version else tail), full, TITLE))
            if version:
                later = name + _V + version + r"(?: of the licen[sc]e)? or (?:at your option )?(?:any )?later(?: version)?"
                rules.append(Rule(keyword, later, full + "-or-later", NOTICE))
                rules.append(Rule(keyword, name + _V + version + r" only", full + "-only", NOTICE))
        rules.append(Rule(keyword, name + r"(?: public)? licen[sc]e", label, REFERENCE))
    for short in ("gpl", "lgpl", "agpl"):
        for version in ("2", "2 1", "3"):
            rules.append(Rule(short, rf"(?:gnu )?{short}(?: version| v)? ?v?{version}", f"{short}-{_dotted(version)}", TITLE))
            rules.append(Rule(short, rf"(?:gnu )?{short}(?: version| v)? ?v?{version} or later", f"{short}-{_dotted(version)}-or-later", NOTICE))
    for code, words in _CC:
        label = "cc-" + code.replace(" ", "-")
        rules.append(Rule("cc", rf"cc {code}", label, REFERENCE))
        rules.append(Rule("creative", rf"creative commons {words}", label, REFERENCE))
        for version in _CC_VERSIONS:
            full = f"{label}-{_dotted(version)}"
            rules.append(Rule("cc", rf"cc {code} {version}", full, TITLE))
            rules.append(Rule("cc", _LEAD + rf"cc {code} {version}", full, NOTICE))
            rules.append(Rule("creative", rf"creative commons {words} {version}(?: international| unported)?(?: licen[sc]e)?", full, NOTICE))
            rules.append(Rule("creativecommons", rf"creativecommons org licenses {code} {version}", full, NOTICE))
    rules.extend(Rule("spdx", rf"spdx license identifier {words}", label, NOTICE) for words, label in _SPDX)
    rules.extend(Rule(*form) for form in _FORMS)
    rules.extend(Rule(keyword, pattern, label, NOTICE) for label, keyword, pattern in _CLAUSES)
    return rules


RULES = build_rules()

#: substrings of which a text must have one before any rule is tried: every match of every rule, and every base phrase,
#: contains one of them (a family with versions is also told without the word licence, hence its own stem)
GATES = [
    "advertising", "cc", "clause", "copyright", "domain", "endorse", "eupl", "general", "gnu", "gpl", "hereby", "licen", "permission", "proprietary", "redistribut", "reserved", "spdx", "unauthorized", "warrant", "wtfpl",
    "academic", "affero", "apache", "artistic", "boost", "common", "creative", "database", "documentation", "eclipse", "educational", "european", "font", "mozilla", "permissive", "software",
]
