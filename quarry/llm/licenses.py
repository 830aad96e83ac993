"""License scans: ordered signature rules over normalised words.

A text is lower-cased (A-Z), cut into words and joined again by single spaces. Rules are regexes
over that form. A rule is tried only where its keyword stands in the text. Detections may overlap:
one that lies inside a detection of better priority (a smaller number; at equal priority the
longer, then the earlier rule) is suppressed, so that "gnu lesser general public license version
3" yields the exact license and not the shorter family that it contains. Base phrases are always
reported and never suppressed.

Defined cases: a null text counts as empty; a text without words has no detections, null
positions, empty labels and score 0; repeated rows are each scanned; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textnp
from .session import documents

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# License families, each with its names, keyword, versions and label stem.
FAMILIES = [
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", "general", ("2 0", "2 1", "3 0", "2", "3")),
    ("agpl", r"(?:gnu )?affero general public licen[sc]e", "affero", ("1 0", "3 0", "1", "3")),
    ("gfdl", r"(?:gnu )?free documentation licen[sc]e", "documentation", ("1 1", "1 2", "1 3")),
    ("gpl", r"(?:gnu )?general public licen[sc]e", "general", ("1 0", "2 0", "3 0", "1", "2", "3")),
    ("apache", r"apache (?:software )?licen[sc]e", "apache", ("1 0", "1 1", "2 0", "2")),
    ("mpl", r"mozilla public licen[sc]e", "mozilla", ("1 0", "1 1", "2 0")),
    ("epl", r"eclipse public licen[sc]e", "eclipse", ("1 0", "2 0")),
    ("eupl", r"european union public licen[sc]e", "european", ("1 0", "1 1", "1 2")),
    ("cddl", r"common development and distribution licen[sc]e", "distribution", ("1 0", "1 1")),
    ("cpl", r"common public licen[sc]e", "common", ("1 0",)),
    ("osl", r"open software licen[sc]e", "open", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", r"academic free licen[sc]e", "academic", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("artistic", r"artistic licen[sc]e", "artistic", ("1 0", "2 0")),
    ("bsl", r"boost software licen[sc]e", "boost", ("1 0",)),
    ("busl", r"business source licen[sc]e", "business", ("1 0", "1 1")),
    ("cecill", r"cecill(?: free software)? licen[sc]e", "cecill", ("1 0", "1 1", "2 0", "2 1")),
    ("ofl", r"(?:sil )?open font licen[sc]e", "font", ("1 0", "1 1")),
    ("odbl", r"open (?:data commons open )?database licen[sc]e", "database", ("1 0",)),
    ("zpl", r"zope public licen[sc]e", "zope", ("1 1", "2 0", "2 1")),
    ("php", r"php licen[sc]e", "php", ("3 0", "3 01")),
    ("python", r"python (?:software foundation )?licen[sc]e", "python", ("2", "2 0")),
    ("ms-pl", r"microsoft public licen[sc]e", "microsoft", ()),
    ("ms-rl", r"microsoft reciprocal licen[sc]e", "microsoft", ()),
    ("ncsa", r"university of illinois(?: ncsa)? open source licen[sc]e", "illinois", ()),
    ("postgresql", r"postgresql licen[sc]e", "postgresql", ()),
    ("vim", r"vim licen[sc]e", "vim", ()),
    ("zlib", r"zlib(?: libpng)? licen[sc]e", "zlib", ()),
    ("isc", r"isc licen[sc]e", "isc", ()),
    ("mit", r"(?:mit|expat|x11) licen[sc]e", "licen", ()),
    ("unlicense", r"(?:the unlicense|unlicense org)", "unlicense", ()),
    ("wtfpl", r"do what the fuck you want to public licen[sc]e", "want", ("2",)),
]
# The parts of Creative Commons names and the versions that they come in.
CC_PARTS = {"by": "attribution", "by nc": "attribution non ?commercial", "by sa": "attribution share ?alike", "by nd": "attribution no ?deriv(?:ative)?s?", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s?"}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
# Phrases of license texts and notices, with keyword, label and priority. The more of a license's own words, the better the priority.
NOTICES = [
    # MIT and its kin
    (r"permission is hereby granted free of charge to any person obtaining a copy", "permission", "mit", 2),
    (r"the above copyright notice and this permission notice shall be included in all copies", "notice", "mit", 3),
    (r"permission to use copy modify and or distribute this software for any purpose", "permission", "isc", 2),
    (r"permission to use copy modify and distribute this software and its documentation for any purpose", "permission", "hpnd", 2),
    (r"permission to use copy modify and distribute this software is freely granted", "permission", "spencer", 3),
    (r"the software shall be used for good not evil", "evil", "json", 1),
    (r"the software is provided as is without warranty of any kind", "warranty", "warranty-disclaimer", 7),
    (r"x consortium", "consortium", "x11", 4),
    # BSD
    (r"redistributions of source code must retain the above copyright notice", "redistributions", "bsd", 3),
    (r"redistributions in binary form must reproduce the above copyright notice", "redistributions", "bsd", 3),
    (r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution", "bsd", 3),
    (r"neither the name of .{1,80}? nor the names of (?:its|any) contributors", "neither", "bsd-3-clause", 2),
    (r"may not be used to endorse or promote products derived from this software", "endorse", "bsd-3-clause", 3),
    (r"this product includes software developed by", "developed", "bsd-4-clause", 2),
    (r"all advertising materials mentioning features or use of this software", "advertising", "bsd-4-clause", 1),
    (r"(?:0|zero) clause bsd(?: licen[sc]e)?", "clause", "0bsd", 1),
    (r"(?:2|two) clause bsd(?: licen[sc]e)?", "clause", "bsd-2-clause", 1),
    (r"(?:3|three) clause bsd(?: licen[sc]e)?", "clause", "bsd-3-clause", 1),
    (r"(?:4|four) clause bsd(?: licen[sc]e)?", "clause", "bsd-4-clause", 1),
    (r"bsd (?:2|two) clause(?: licen[sc]e)?", "clause", "bsd-2-clause", 1),
    (r"bsd (?:3|three) clause(?: licen[sc]e)?", "clause", "bsd-3-clause", 1),
    (r"bsd (?:4|four) clause(?: licen[sc]e)?", "clause", "bsd-4-clause", 1),
    (r"(?:simplified|freebsd) bsd licen[sc]e", "bsd", "bsd-2-clause", 2),
    (r"(?:new|revised|modified) bsd licen[sc]e", "bsd", "bsd-3-clause", 2),
    (r"original bsd licen[sc]e", "bsd", "bsd-4-clause", 2),
    (r"bsd style licen[sc]e", "bsd", "bsd", 4),
    (r"bsd licen[sc]e", "bsd", "bsd", 4),
    (r"the views and conclusions contained in the software and documentation are those of the authors", "conclusions", "bsd-2-clause-views", 2),
    # GNU
    (r"this program is free software you can redistribute it and or modify", "redistribute", "gpl", 3),
    (r"this library is free software you can redistribute it and or modify", "redistribute", "lgpl", 3),
    (r"you should have received a copy of the gnu general public licen[sc]e", "received", "gpl", 3),
    (r"you should have received a copy of the gnu lesser general public licen[sc]e", "received", "lgpl", 3),
    (r"you should have received a copy of the gnu affero general public licen[sc]e", "received", "agpl", 3),
    (r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e", "document", "gfdl", 2),
    (r"with no invariant sections no front cover texts and no back cover texts", "invariant", "gfdl-no-invariants", 2),
    (r"as a special exception the copyright holders of this library give you permission to link", "exception", "linking-exception", 2),
    (r"gcc runtime library exception", "exception", "gcc-exception", 1),
    (r"classpath exception", "classpath", "classpath-exception", 1),
    (r"licensed under the (?:gnu )?gpl(?: ?v?(?:2|3))?", "gpl", "gpl", 4),
    (r"licensed under the (?:gnu )?lgpl(?: ?v?(?:2|2 1|3))?", "lgpl", "lgpl", 4),
    (r"licensed under the (?:gnu )?agpl(?: ?v?3)?", "agpl", "agpl", 4),
    (r"gplv2(?: or later)?", "gplv2", "gpl-2", 3),
    (r"gplv3(?: or later)?", "gplv3", "gpl-3", 3),
    (r"lgplv2(?: 1)?(?: or later)?", "lgplv2", "lgpl-2", 3),
    (r"lgplv3(?: or later)?", "lgplv3", "lgpl-3", 3),
    (r"agplv3(?: or later)?", "agplv3", "agpl-3", 3),
    # Apache, Mozilla, Eclipse and others of foundations
    (r"licensed to the apache software foundation asf under one or more contributor license agreements", "contributor", "apache-2.0", 2),
    (r"you may not use this file except in compliance with the licen[sc]e", "compliance", "apache-2.0", 3),
    (r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis", "applicable", "apache-2.0", 3),
    (r"this source code form is subject to the terms of the mozilla public licen[sc]e", "mozilla", "mpl-2.0", 2),
    (r"the contents of this file are subject to the mozilla public licen[sc]e", "mozilla", "mpl-1.1", 2),
    (r"the contents of this file are subject to the netscape public licen[sc]e", "netscape", "npl-1.1", 2),
    (r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e", "eclipse", "epl", 2),
    (r"eclipse distribution licen[sc]e", "eclipse", "edl-1.0", 2),
    (r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e", "distribution", "cddl", 2),
    (r"w3c software notice and licen[sc]e", "w3c", "w3c", 1),
    (r"w3c software and document(?: notice and)? licen[sc]e", "w3c", "w3c-20150513", 1),
    (r"the openssl toolkit", "openssl", "openssl", 3),
    (r"openssl licen[sc]e", "openssl", "openssl", 2),
    (r"the ssleay library", "ssleay", "ssleay", 2),
    (r"ibm public licen[sc]e", "ibm", "ipl-1.0", 2),
    (r"sun public licen[sc]e", "sun", "spl-1.0", 2),
    (r"sun industry standards source licen[sc]e", "industry", "sissl", 2),
    (r"apple public source licen[sc]e", "apple", "apsl", 2),
    (r"nokia open source licen[sc]e", "nokia", "nokia", 2),
    (r"intel open source licen[sc]e", "intel", "intel", 2),
    (r"realnetworks public source licen[sc]e", "realnetworks", "rpsl", 2),
    (r"reciprocal public licen[sc]e", "reciprocal", "rpl", 2),
    (r"ricoh source code public licen[sc]e", "ricoh", "rscpl", 2),
    (r"sleepycat licen[sc]e", "sleepycat", "sleepycat", 2),
    (r"sybase open watcom public licen[sc]e", "watcom", "watcom", 2),
    (r"lucent public licen[sc]e", "lucent", "lpl", 2),
    (r"latex project public licen[sc]e", "latex", "lppl", 2),
    (r"q public licen[sc]e", "public", "qpl", 3),
    (r"ruby licen[sc]e", "ruby", "ruby", 3),
    (r"same terms as perl itself", "perl", "perl", 2),
    (r"tcl tk licen[sc]e", "tcl", "tcl", 3),
    (r"unicode (?:inc )?licen[sc]e agreement", "unicode", "unicode", 2),
    (r"(?:the )?curl licen[sc]e", "curl", "curl", 3),
    (r"libpng licen[sc]e", "libpng", "libpng", 3),
    (r"independent jpeg group", "jpeg", "ijg", 3),
    (r"this software is based in part on the work of the independent jpeg group", "jpeg", "ijg", 2),
    (r"freetype (?:project )?licen[sc]e", "freetype", "ftl", 2),
    (r"imagemagick licen[sc]e", "imagemagick", "imagemagick", 3),
    (r"info zip licen[sc]e", "zip", "info-zip", 3),
    (r"net snmp licen[sc]e", "snmp", "net-snmp", 3),
    (r"bittorrent open source licen[sc]e", "bittorrent", "bittorrent", 2),
    (r"educational community licen[sc]e", "educational", "ecl", 2),
    (r"universal permissive licen[sc]e", "permissive", "upl-1.0", 2),
    (r"blue ?oak model licen[sc]e", "model", "blueoak-1.0.0", 2),
    (r"mulan permissive software licen[sc]e", "mulan", "mulanpsl", 2),
    (r"european space agency public licen[sc]e", "agency", "esa-pl", 2),
    (r"open government licen[sc]e", "government", "ogl", 2),
    (r"nasa open source agreement", "nasa", "nasa-1.3", 2),
    (r"cern open hardware licen[sc]e", "cern", "cern-ohl", 2),
    (r"tapr open hardware licen[sc]e", "tapr", "tapr-ohl", 2),
    (r"solderpad hardware licen[sc]e", "solderpad", "shl", 2),
    (r"altered source versions must be plainly marked as such", "altered", "zlib", 3),
    (r"this software is provided as is without any express or implied warranty", "express", "zlib", 4),
    (r"beerware licen[sc]e", "beerware", "beerware", 2),
    (r"as long as you retain this notice you can do whatever you want with this stuff", "whatever", "beerware", 1),
    # newer source-available and model licenses
    (r"server side public licen[sc]e", "server", "sspl-1.0", 2),
    (r"elastic licen[sc]e(?: 2 0)?", "elastic", "elastic-2.0", 3),
    (r"polyform (?:noncommercial|small business|shield|strict|perimeter) licen[sc]e", "polyform", "polyform", 2),
    (r"commons clause", "commons", "commons-clause", 2),
    (r"confluent community licen[sc]e", "confluent", "confluent-community", 2),
    (r"parity public licen[sc]e", "parity", "parity", 2),
    (r"prosperity public licen[sc]e", "prosperity", "prosperity", 2),
    (r"hippocratic licen[sc]e", "hippocratic", "hippocratic", 2),
    (r"open rail [ms] licen[sc]e|openrail(?: ?[ms]| plus plus)?", "rail", "openrail", 3),
    # data and content
    (r"community data licen[sc]e agreement permissive", "permissive", "cdla-permissive", 1),
    (r"community data licen[sc]e agreement sharing", "sharing", "cdla-sharing", 1),
    (r"open data commons attribution licen[sc]e", "commons", "odc-by", 1),
    (r"public domain dedication and licen[sc]e", "dedication", "pddl", 1),
    (r"free art licen[sc]e", "licen", "fal", 3),
    (r"open publication licen[sc]e", "publication", "opl", 2),
    (r"licensed under a creative commons attribution licen[sc]e", "creative", "cc-by", 3),
    (r"creative commons licen[sc]e", "creative", "cc", 5),
    (r"cc0(?: 1 0)?(?: universal)?", "cc0", "cc0", 2),
    (r"creative commons zero", "creative", "cc0", 2),
    (r"this is free and unencumbered software released into the public domain", "unencumbered", "unlicense", 1),
    (r"(?:released|placed|dedicated) (?:in|into|to) the public domain", "public", "public-domain", 3),
    (r"public domain dedication", "public", "public-domain", 3),
    (r"no copyright reserved", "copyright", "public-domain", 4),
    # reserved rights and references
    (r"all rights reserved", "reserved", "all-rights-reserved", 6),
    (r"some rights reserved", "reserved", "some-rights-reserved", 6),
    (r"copyright (?:c )?(?:19|20)[0-9]{2}", "copyright", "copyright-notice", 7),
    (r"proprietary and confidential", "proprietary", "proprietary", 5),
    (r"confidential and proprietary", "proprietary", "proprietary", 5),
    (r"trade secrets? (?:of|and)", "trade", "proprietary", 6),
    (r"unauthori[sz]ed copying of this file", "unauthori", "proprietary", 5),
    (r"unauthori[sz]ed (?:reproduction|distribution|use) (?:is|of)", "unauthori", "proprietary", 6),
    (r"no part of this (?:publication|work|software) may be reproduced", "reproduced", "all-rights-reserved", 5),
    (r"for internal use only", "internal", "proprietary", 6),
    (r"for non ?commercial use only", "commercial", "non-commercial", 5),
    (r"end user licen[sc]e agreement", "agreement", "eula", 5),
    (r"evaluation licen[sc]e agreement", "evaluation", "eula", 5),
    (r"shareware", "shareware", "shareware", 6),
    (r"freeware", "freeware", "freeware", 6),
    (r"dual licensed(?: under)?", "dual", "dual-license", 7),
    (r"licensed under the terms of", "licensed", "license-reference", 8),
    (r"(?:released|distributed|licensed) under the", "under", "license-reference", 8),
    (r"see (?:the )?(?:accompanying )?(?:file )?licen[sc]e(?: txt| md)? (?:file )?for", "licen", "license-reference", 8),
]
# Identifiers that the families don't make, as they stand after "SPDX-License-Identifier:".
IDENTIFIERS = """
    0BSD AFL-3.0 Aladdin APSL-2.0 Artistic-1.0-Perl Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-2-Clause-Views
    BSD-3-Clause BSD-3-Clause-Clear BSD-3-Clause-LBNL BSD-3-Clause-Attribution BSD-4-Clause BSD-4-Clause-UC BSD-Source-Code BSL-1.0 BUSL-1.1
    Beerware BitTorrent-1.1 BlueOak-1.0.0 CATOSL-1.1 CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0
    CC-BY-SA-3.0 CC-BY-SA-4.0 CC-PDDC CDLA-Permissive-1.0 CDLA-Permissive-2.0 CDLA-Sharing-1.0 CERN-OHL-P-2.0 CERN-OHL-S-2.0 CERN-OHL-W-2.0
    CNRI-Python CPAL-1.0 CUA-OPL-1.0 ClArtistic ECL-1.0 ECL-2.0 EFL-2.0 EUDatagrid Elastic-2.0 Entessa Fair FSFAP FTL Frameworx-1.0 GL2PS
    HPND ICU IJG IPL-1.0 ISC Imlib2 InfoZIP Intel JasPer-2.0 JSON LPL-1.02 LPPL-1.3c LiLiQ-P-1.1 Libpng Linux-OpenIB MIT MIT-0 MIT-CMU
    MIT-Modern-Variant MIT-advertising MITNFA MirOS Motosoto MulanPSL-2.0 Multics NASA-1.3 NAIST-2003 NCSA NGPL NLPL NPL-1.1 NPOSL-3.0 NTP
    Naumen Nokia OCLC-2.0 ODC-By-1.0 OFL-1.1-RFN OGTSL OLDAP-2.8 OSET-PL-2.1 OpenSSL PDDL-1.0 PSF-2.0 Parity-7.0.0 PolyForm-Noncommercial-1.0.0
    QPL-1.0 RPL-1.5 RPSL-1.0 RSCPL Ruby SGI-B-2.0 SISSL SPL-1.0 SSPL-1.0 Sendmail SimPL-2.0 Sleepycat Spencer-94 TCL Unicode-DFS-2016 Unlicense
    UPL-1.0 VSL-1.0 W3C WTFPL Watcom-1.0 X11 Xnet XFree86-1.1 Zend-2.0 Zimbra-1.4 Zlib zlib-acknowledgement
""".split()


@dataclass(frozen=True)
class Rule:
    """priority: the smaller, the better. keyword: must stand in the text for the regex to be tried."""

    name: str
    keyword: bytes
    pattern: re.Pattern
    label: str
    priority: int


def _rule(name: str, keyword: str, body: str, label: str, priority: int) -> Rule:
    return Rule(name, keyword.encode(), re.compile(rb"(?:(?<= )|^)(?:" + body.encode() + rb")(?= |$)"), label, priority)


@functools.cache
def rules() -> tuple[Rule, ...]:
    """The ordered rules: exact versions before "or later" families, notices, plain families and references."""
    out = []
    for stem, names, keyword, versions in FAMILIES:
        words = stem.replace("-", " ")  # as normalised texts have it
        for v in versions:
            label = f"{stem}-{v.replace(' ', '.')}"
            later = r"(?: of the licen[sc]e)?(?: or (?:\(?at your option\)? )?any later version| or later)"
            out.append(_rule(f"{label}-later", keyword, rf"{names}(?: as published by the free software foundation)?(?: either)? (?:version |v ?)?{v}{later}", f"{label}-or-later", 0))
            out.append(_rule(label, keyword, rf"{names}(?: as published by the free software foundation)?(?: either)? (?:version |v ?)?{v}", label, 1))
            out.append(_rule(f"{label}-spdx", "spdx", rf"spdx license identifier {words} {v}(?: only| or later)?", label, 1))
        out.append(_rule(stem, keyword, names, stem, 4))
        out.append(_rule(f"{stem}-spdx", "spdx", rf"spdx license identifier {words}", stem, 3))
    for parts, long in CC_PARTS.items():
        label = "cc-" + parts.replace(" ", "-")
        for v in CC_VERSIONS:
            out.append(_rule(f"{label}-{v}", "cc", rf"cc {parts} {v}", f"{label}-{v.replace(' ', '.')}", 1))
            out.append(_rule(f"{label}-{v}-long", "commons", rf"creative commons {long} {v}", f"{label}-{v.replace(' ', '.')}", 1))
        out.append(_rule(label, "cc", rf"cc {parts}", label, 4))
        out.append(_rule(f"{label}-long", "commons", rf"creative commons {long}", label, 4))
    out += [_rule(f"notice-{k}", keyword, body, label, p) for k, (body, keyword, label, p) in enumerate(NOTICES)]
    out += [_rule(f"{x}-identifier", "spdx", f"spdx license identifier {re.sub('[-.]', ' ', x.lower())}", x.lower(), 1) for x in IDENTIFIERS]
    return tuple(sorted(out, key=lambda r: r.priority))


@functools.cache
def _gate() -> tuple[bytes, ...]:
    """Of the words without which neither a rule nor a base phrase can match, those that hold no other; spaces end no word, so a raw text has them too."""
    words = {r.keyword for r in rules()} | {max(p.split(), key=len).encode() for p in BASE}
    assert not any(b" " in k for k in words)
    return tuple(sorted((k for k in words if not any(o != k and o in k for o in words)), key=len))


def suppressed(found: list[tuple[int, int, int, Rule]]) -> list[tuple[int, int, int, Rule]]:
    """Detections (start, end, rule's place) that lie in no better one; same span and same rank: the earlier rule.

    Of the kept ones those that lie in no other are held by start, and so by end: the last one that begins no later tells.
    """
    kept: list[tuple[int, int, int, Rule]] = []
    starts: list[int] = []
    ends: list[int] = []
    for d in sorted(found, key=lambda d: (d[3].priority, d[0] - d[1], d[2], d[0])):
        k = bisect_right(starts, d[0]) - 1
        if k >= 0 and ends[k] >= d[1]:
            continue
        kept.append(d)
        inside = slice(bisect_left(starts, d[0]), bisect_right(ends, d[1]))
        starts[inside], ends[inside] = [d[0]], [d[1]]
    return sorted(kept, key=lambda d: (d[0], d[1], d[2]))


def detect(normal: bytes) -> list[tuple[int, int, int, Rule]]:
    """The kept detections in a normalised text, by byte."""
    seen: dict[bytes, bool] = {}
    found = []
    for k, r in enumerate(rules()):
        has = seen.get(r.keyword)
        if has is None:
            has = seen[r.keyword] = r.keyword in normal
        if has:
            found += [(m.start(), m.end(), k, r) for m in r.pattern.finditer(normal)]
    return suppressed(found)


@functools.cache
def _base() -> list[tuple[bytes, str]]:
    return [(f" {p} ".encode(), label) for p, label in BASE.items()]


def word_numbers(normal: bytes, at: list[int]) -> list[int]:
    """The numbers of the words that begin or stand at these bytes."""
    spaces = np.flatnonzero(np.frombuffer(normal, np.uint8) == 32) if at else np.zeros(0, np.int64)
    return np.searchsorted(spaces, at).tolist()


def base_places(normal: bytes) -> list[tuple[int, str]]:
    """All places, as word numbers, where a base phrase's words stand consecutively."""
    padded, out = b" " + normal + b" ", []
    for phrase, label in _base():
        at = padded.find(phrase)
        while at >= 0:
            out.append((at, label))
            at = padded.find(phrase, at + 1)
    return list(zip(word_numbers(normal, [at for at, _ in out]), (label for _, label in out)))


def normalised(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """The words of one text, joined by single spaces."""
    raw = data.tobytes()
    return b" ".join(raw[s:e] for s, e in zip(start.tolist(), end.tolist()))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, base (places of base phrases), detections (word span, label, rule, priority) of every text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, base array<struct<word:bigint,label:string>>, detections array<struct<word:bigint,n_words:bigint,label:string,rule:string,priority:int>>"
    base_t = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    found_t = pa.list_(pa.struct([("word", pa.int64()), ("n_words", pa.int64()), ("label", pa.string()), ("rule", pa.string()), ("priority", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textnp.slices(batch):
                data, offsets = textnp.flat(part.column(1))
                data = textnp.LOWER[data]
                start, end, row = textnp.words(data, offsets, textnp.ALNUM)
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                base, found = [], []
                for i in range(part.num_rows):
                    lo, hi = ends[i], ends[i + 1]
                    text = data[offsets[i] : offsets[i + 1]].tobytes()
                    if not any(k in text for k in _gate()):
                        base.append([])
                        found.append([])
                        continue
                    normal = normalised(data[offsets[i] : offsets[i + 1]], start[lo:hi] - offsets[i], end[lo:hi] - offsets[i])
                    base.append([{"word": w, "label": x} for w, x in sorted(base_places(normal))])
                    own = detect(normal)
                    first, last = (word_numbers(normal, [d[k] for d in own]) for k in (0, 1))
                    found.append([{"word": s, "n_words": e - s + 1, "label": r.label, "rule": r.name, "priority": r.priority} for s, e, (*_, r) in zip(first, last, own)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(base, base_t), pa.array(found, found_t)], ["id", "n_words", "base", "detections"])

    return rows.mapInArrow(run, schema)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*c))), ",")
    base, found = F.col("base.label"), F.col("detections.label")
    return scan(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(base, found).alias("labels"),
        # the best detection decides: an exact version counts most, a mere reference least
        F.greatest(
            F.when(F.size("base") > 0, 0.8).otherwise(0.0),
            F.coalesce(1.0 - F.array_min("detections.priority") / 10.0, F.lit(0.0)),
        ).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )
