"""Signature rules of the license scan, written over lines of lower-case words (punctuation gone, one space between).

FAMILIES lists for each label its keyword and its expressions, by kind:
  grant   wording that grants the license, or an excerpt of its text
  name    the full name, with version where it has one
  short   a short or loose form
For each label two more rules come from its identifier: the tag line and the address of the license text.

A rule is tried only in texts that have its keyword as a word, so its expression must not match without it; wording of
which no one word is always there is split over several entries.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    keyword: str
    pattern: str
    priority: int
    label: str
    score: float


PRIORITY = {"tag": 5, "address": 4, "grant": 3, "name": 2, "short": 1}
SCORE = {"tag": 1.0, "address": 0.95, "grant": 0.9, "name": 0.85, "short": 0.5}

def _over_words(body: str) -> str:
    return f" (?:{body})(?= )"


def _rule(keyword: str, body: str, kind: str, label: str) -> Rule:
    return Rule(keyword, _over_words(body), PRIORITY[kind], label, SCORE[kind])


#: The phrases whose places are counted. They come first and stand below all signature rules.
BASE_RULES = [
    Rule("mit", _over_words("mit license"), 0, "mit", 0.6),
    Rule("apache", _over_words("apache license"), 0, "apache", 0.6),
    Rule("general", _over_words("general public license"), 0, "gpl", 0.6),
]

V = r"(?:v|version |v )?"
LIC = r"licen[sc]es?"
UNDER = r"(?:licen[sc]ed|released|distributed|available|published|provided|covered|redistribut(?:ed|able)) under (?:the )?(?:terms of )?(?:the )?"

FAMILIES: list[tuple[str, str, dict[str, list[str]]]] = [
    ("MIT", "mit", {
        "grant": [UNDER + rf"mit(?: x11)? {LIC}", rf"mit {LIC} (?:http|see|copyright|applies)", r"as mit licensed"],
        "name": [rf"(?:the )?mit(?: expat| x11)? {LIC}", rf"{LIC} mit"],
        "short": [r"mit licensed", r"mit style"],
    }),
    ("MIT-text", "permission", {
        "grant": [
            r"permission is hereby granted free of charge to any person obtaining a copy of this software",
            r"permission is hereby granted(?: \S+){0,12} without restriction including without limitation the rights",
        ],
    }),
    ("MIT-notice", "substantial", {"grant": [r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"]}),
    ("AS-IS", "warranty", {
        "grant": [
            r"(?:software|work|material|file) is provided as is without (?:any )?(?:express or implied )?warranty",
            r"without warranty of any kind(?: express or implied)?",
            r"without even the implied warranty of merchantability or fitness for a particular purpose",
            r"absolutely no warranty",
        ],
    }),
    ("AS-IS", "warranties", {"grant": [r"(?:software|work|material|file) is provided as is without (?:any )?(?:express or implied )?warranties"]}),
    ("MIT-0", "mit", {"name": [r"mit no attribution(?: license)?", r"mit 0 license", r"mit zero license"]}),
    ("X11", "x11", {"name": [r"x11 license", r"mit x11 license"], "short": [r"x11 style license"]}),
    ("X11", "consortium", {"name": [r"x consortium license"]}),
    ("Apache-2.0", "apache", {
        "grant": [UNDER + rf"apache (?:software )?{LIC}(?: {V}2(?: 0)?)?", r"you may not use this file except in compliance with the license(?: \S+){0,16} apache"],
        "name": [rf"apache (?:software )?{LIC} {V}2(?: 0)?", rf"apache {V}2(?: 0)? {LIC}"],
        "short": [r"apache licensed", r"apache 2(?: 0)?"],
    }),
    ("Apache-2.0", "asl", {"name": [r"asl 2 0"]}),
    ("Apache-2.0", "alv2", {"short": [r"alv2"]}),
    ("Apache-1.1", "apache", {"name": [rf"apache (?:software )?license {V}1 1"], "short": [r"apache 1 1"]}),
    ("Apache-1.0", "apache", {"name": [rf"apache (?:software )?license {V}1 0"], "short": [r"apache 1 0"]}),
    ("Apache-any", "apache", {"name": [r"apache software foundation license"], "short": [r"apache style license", r"apache (?:software )?licen[sc]e"]}),
    ("GPL-3.0-or-later", "general", {
        "grant": [r"gnu general public license(?: \S+){0,12} either version 3 of the license or (?:at your option )?any later version"],
        "name": [rf"gnu general public license {V}3(?: 0)? or (?:any )?later"],
    }),
    ("GPL-3.0-or-later", "gplv3", {"short": [r"gplv3 (?:or later|plus)"]}),
    ("GPL-3.0-or-later", "gpl", {"short": [rf"gpl {V}3(?: 0)? or (?:any )?later"]}),
    ("GPL-3.0-only", "general", {
        "grant": [UNDER + rf"gnu general public license {V}3(?: 0)?(?: only)?"],
        "name": [rf"(?:gnu )?general public license {V}3(?: 0)?(?: only)?", rf"general public license gpl {V}3(?: 0)?"],
    }),
    ("GPL-3.0-only", "gplv3", {"short": [r"gplv3(?: license)?"]}),
    ("GPL-3.0-only", "gpl", {"short": [rf"gnu gpl {V}3(?: 0)?", rf"gpl {V}3(?: 0)?(?: only)?"]}),
    ("GPL-2.0-or-later", "general", {
        "grant": [r"gnu general public license(?: \S+){0,12} either version 2 of the license or (?:at your option )?any later version"],
        "name": [rf"gnu general public license {V}2(?: 0)? or (?:any )?later"],
    }),
    ("GPL-2.0-or-later", "gplv2", {"short": [r"gplv2 (?:or later|plus)"]}),
    ("GPL-2.0-or-later", "gpl", {"short": [rf"gpl {V}2(?: 0)? or (?:any )?later"]}),
    ("GPL-2.0-only", "general", {
        "grant": [UNDER + rf"gnu general public license {V}2(?: 0)?(?: only)?"],
        "name": [rf"(?:gnu )?general public license {V}2(?: 0)?(?: only)?", rf"general public license gpl {V}2(?: 0)?"],
    }),
    ("GPL-2.0-only", "gplv2", {"short": [r"gplv2(?: license)?"]}),
    ("GPL-2.0-only", "gpl", {"short": [rf"gnu gpl {V}2(?: 0)?", rf"gpl {V}2(?: 0)?(?: only)?"]}),
    ("GPL-1.0-only", "general", {"name": [rf"(?:gnu )?general public license {V}1(?: 0)?"]}),
    ("GPL-any", "gpl", {"grant": [UNDER + r"(?:gnu )?gpl"], "short": [r"gnu gpl", r"gpl licen[sc]ed?", r"gpl compatible"]}),
    ("GPL-any", "general", {"short": [r"gnu general public licen[sc]e"]}),
    ("GPL-classpath-exception", "classpath", {"name": [r"classpath exception(?: 2 0)?"], "grant": [r"gnu general public license(?: \S+){0,8} with (?:the )?classpath exception"]}),
    ("GPL-linking-exception", "linking", {"grant": [r"as a special exception(?: \S+){0,12} linking"], "short": [r"linking exception"]}),
    ("GCC-exception-3.1", "gcc", {"name": [r"gcc runtime library exception(?: version 3 1)?"]}),
    ("LGPL-3.0", "lesser", {"grant": [UNDER + rf"gnu lesser general public license {V}3(?: 0)?"], "name": [rf"(?:gnu )?lesser general public license {V}3(?: 0)?"]}),
    ("LGPL-3.0", "lgplv3", {"short": [r"lgplv3"]}),
    ("LGPL-3.0", "lgpl", {"short": [rf"lgpl {V}3(?: 0)?"]}),
    ("LGPL-2.1", "lesser", {"grant": [UNDER + rf"gnu lesser general public license {V}2 1"], "name": [rf"(?:gnu )?lesser general public license {V}2 1"]}),
    ("LGPL-2.1", "lgpl", {"short": [rf"lgpl {V}2 1"]}),
    ("LGPL-2.0", "library", {"name": [rf"(?:gnu )?library general public license(?: {V}2(?: 0)?)?"]}),
    ("LGPL-any", "lesser", {"name": [r"(?:gnu )?lesser general public license"]}),
    ("LGPL-any", "lgpl", {"grant": [UNDER + r"(?:gnu )?lgpl"], "short": [r"gnu lgpl", r"lgpl licen[sc]ed?"]}),
    ("AGPL-3.0", "affero", {"grant": [UNDER + rf"gnu affero general public license {V}3(?: 0)?"], "name": [rf"(?:gnu )?affero general public license(?: {V}3(?: 0)?)?"]}),
    ("AGPL-3.0", "agplv3", {"short": [r"agplv3"]}),
    ("AGPL-3.0", "agpl", {"short": [rf"agpl {V}3(?: 0)?", r"gnu agpl"]}),
    ("GFDL-1.3", "documentation", {"grant": [UNDER + r"gnu free documentation license"], "name": [rf"(?:gnu )?free documentation license(?: {V}1 3)?"]}),
    ("GFDL-1.3", "gfdl", {"short": [r"gfdl(?: 1 [123])?"]}),
    ("BSD-2-Clause", "bsd", {"name": [r"bsd 2 clause(?: license)?", r"2 clause bsd(?: license)?", r"two clause bsd(?: license)?", r"simplified bsd license"]}),
    ("BSD-2-Clause", "freebsd", {"name": [r"freebsd license"]}),
    ("BSD-3-Clause", "bsd", {"name": [r"bsd 3 clause(?: license)?", r"3 clause bsd(?: license)?", r"three clause bsd(?: license)?", r"(?:new|modified|revised) bsd license"]}),
    ("BSD-4-Clause", "bsd", {"name": [r"bsd 4 clause(?: license)?", r"4 clause bsd(?: license)?", r"(?:original|old) bsd license"]}),
    ("BSD-any", "bsd", {"grant": [UNDER + r"bsd(?: style)? licen[sc]e"], "name": [r"bsd licen[sc]e"], "short": [r"bsd licen[sc]ed", r"bsd style"]}),
    ("BSD-text", "redistribution", {"grant": [r"redistribution and use in source and binary forms with or without modification are permitted"]}),
    ("BSD-text", "redistributions", {"grant": [
        r"redistributions of source code must retain the above copyright notice",
        r"redistributions in binary form must reproduce the above copyright notice",
    ]}),
    ("BSD-3-Clause", "endorse", {"grant": [r"neither the name(?: \S+){0,16} may be used to endorse or promote products"]}),
    ("BSD-4-Clause", "advertising", {"grant": [r"all advertising materials mentioning features or use of this software"]}),
    ("0BSD", "bsd", {"name": [r"zero clause bsd(?: license)?", r"bsd zero clause license", r"bsd 0 clause license"]}),
    ("ISC", "isc", {"grant": [UNDER + r"isc licen[sc]e"], "name": [r"isc licen[sc]e"], "short": [r"isc licen[sc]ed"]}),
    ("ISC-text", "fee", {"grant": [r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"]}),
    ("HPND", "fee", {"grant": [r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted"]}),
    ("MPL-2.0", "mozilla", {
        "grant": [UNDER + rf"mozilla public license(?: {V}2(?: 0)?)?", r"this source code form is subject to the terms of the mozilla public license"],
        "name": [rf"mozilla public license(?: {V}2(?: 0)?)?"],
    }),
    ("MPL-2.0", "mpl", {"short": [rf"mpl {V}2(?: 0)?"]}),
    ("MPL-1.1", "mozilla", {"name": [rf"mozilla public license {V}1 1"]}),
    ("MPL-1.1", "mpl", {"short": [rf"mpl {V}1 1"]}),
    ("EPL-2.0", "eclipse", {"grant": [UNDER + rf"eclipse public license(?: {V}2(?: 0)?)?"], "name": [rf"eclipse public license {V}2(?: 0)?"]}),
    ("EPL-1.0", "eclipse", {"name": [rf"eclipse public license(?: {V}1(?: 0)?)?"]}),
    ("EPL-2.0", "epl", {"short": [rf"epl {V}2(?: 0)?"]}),
    ("EPL-1.0", "epl", {"short": [rf"epl {V}1(?: 0)?"]}),
    ("EDL-1.0", "eclipse", {"name": [rf"eclipse distribution license(?: {V}1(?: 0)?)?"]}),
    ("CDDL-1.0", "cddl", {"short": [rf"cddl(?: {V}1 0)?"]}),
    ("CDDL-1.0", "distribution", {"name": [rf"common development and distribution license(?: {V}1 0)?"]}),
    ("CDDL-1.1", "distribution", {"name": [rf"common development and distribution license {V}1 1"]}),
    ("CPL-1.0", "common", {"name": [rf"common public license(?: {V}1 0)?"]}),
    ("CPAL-1.0", "attribution", {"name": [rf"common public attribution license(?: {V}1 0)?"]}),
    ("IPL-1.0", "ibm", {"name": [rf"ibm public license(?: {V}1 0)?"]}),
    ("EUPL-1.2", "european", {"name": [rf"european union public licen[sc]e {V}1 2"]}),
    ("EUPL-1.1", "european", {"name": [rf"european union public licen[sc]e(?: {V}1 1)?"]}),
    ("EUPL-1.2", "eupl", {"short": [rf"eupl(?: {V}1 2)?"]}),
    ("CeCILL-2.1", "cecill", {"name": [rf"cecill(?: (?:free software )?licen[sc]e(?: agreement)?)?(?: {V}2 1)?"]}),
    ("CeCILL-B", "cecill", {"name": [r"cecill b(?: licen[sc]e)?"]}),
    ("CeCILL-C", "cecill", {"name": [r"cecill c(?: licen[sc]e)?"]}),
    ("Artistic-2.0", "artistic", {"name": [rf"artistic license {V}2(?: 0)?"], "grant": [UNDER + r"artistic license"]}),
    ("Artistic-1.0", "artistic", {"name": [rf"artistic license(?: {V}1(?: 0)?)?"]}),
    ("Perl-5", "perl", {"grant": [r"under the same terms as perl(?: itself)?"]}),
    ("PSF-2.0", "python", {"name": [r"python software foundation license(?: version 2)?"], "short": [r"python license"]}),
    ("PSF-2.0", "psf", {"name": [r"psf license(?: agreement)?"]}),
    ("Python-2.0", "python", {"name": [r"python license 2 0", r"python 2 0(?: 1)? license"]}),
    ("Ruby", "ruby", {"name": [r"ruby license"], "grant": [r"under the same terms as ruby"]}),
    ("PHP-3.01", "php", {"name": [rf"php license(?: {V}3 01)?"]}),
    ("Zlib", "zlib", {"name": [r"zlib(?: libpng)? license"], "grant": [UNDER + r"zlib licen[sc]e"]}),
    ("Zlib-text", "damages", {"grant": [r"in no event will the authors be held liable for any damages arising from the use of this software"]}),
    ("Libpng", "libpng", {"name": [r"libpng license(?: version 2)?"]}),
    ("IJG", "jpeg", {"name": [r"independent jpeg group(?: s)? license"], "grant": [r"based in part on the work of the independent jpeg group"]}),
    ("FTL", "freetype", {"name": [r"freetype (?:project )?license"]}),
    ("OpenSSL", "openssl", {"name": [r"openssl license"], "grant": [r"developed by the openssl project for use in the openssl toolkit"]}),
    ("SSLeay", "ssleay", {"name": [r"ssleay licen[sc]e"]}),
    ("curl", "curl", {"name": [r"curl license"]}),
    ("BSL-1.0", "boost", {"name": [rf"boost software license(?: {V}1 0)?"], "grant": [UNDER + rf"boost software license(?: {V}1 0)?"]}),
    ("BUSL-1.1", "business", {"name": [rf"business source license(?: {V}1 1)?"]}),
    ("SSPL-1.0", "server", {"name": [rf"server side public license(?: {V}1(?: 0)?)?"]}),
    ("Elastic-2.0", "elastic", {"name": [rf"elastic license(?: {V}2(?: 0)?)?"]}),
    ("Commons-Clause", "commons", {"name": [r"commons clause(?: license)?(?: condition)?"]}),
    ("PolyForm-Noncommercial", "polyform", {"name": [r"polyform noncommercial license(?: 1 0 0)?"]}),
    ("PolyForm-Small-Business", "polyform", {"name": [r"polyform small business license(?: 1 0 0)?"]}),
    ("Unlicense", "unlicense", {"name": [r"(?:the )?unlicense"], "short": [r"unlicense org"]}),
    ("Unlicense", "unencumbered", {"grant": [r"this is free and unencumbered software released into the public domain"]}),
    ("WTFPL", "wtfpl", {"name": [r"wtfpl(?: license)?(?: version 2)?"]}),
    ("WTFPL", "want", {"name": [r"do what the \S+ you want to public license"]}),
    ("Beerware", "beer", {"name": [r"(?:the )?beer ware license"]}),
    ("Beerware", "beerware", {"name": [r"(?:the )?beerware license"]}),
    ("Public-Domain", "domain", {"grant": [r"(?:released|placed|dedicated) (?:into|in|to) the public domain"], "short": [r"(?:in )?the public domain", r"public domain dedication"]}),
    ("CC0-1.0", "cc0", {"name": [r"cc0(?: 1 0)?(?: universal)?"], "grant": [UNDER + r"cc0"]}),
    ("CC0-1.0", "creative", {"name": [r"creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?"]}),
    ("CC-BY-4.0", "cc", {"name": [r"cc by 4 0(?: international)?", r"cc by(?: [123] [05])?"], "grant": [UNDER + r"cc by(?: \d \d)?"]}),
    ("CC-BY-SA-4.0", "cc", {"name": [r"cc by sa(?: \d \d)?(?: international)?"], "grant": [UNDER + r"cc by sa(?: \d \d)?"]}),
    ("CC-BY-ND-4.0", "cc", {"name": [r"cc by nd(?: \d \d)?(?: international)?"], "grant": [UNDER + r"cc by nd(?: \d \d)?"]}),
    ("CC-BY-NC-4.0", "cc", {"name": [r"cc by nc(?: \d \d)?(?: international)?"], "grant": [UNDER + r"cc by nc(?: \d \d)?"]}),
    ("CC-BY-NC-SA-4.0", "cc", {"name": [r"cc by nc sa(?: \d \d)?(?: international)?"], "grant": [UNDER + r"cc by nc sa(?: \d \d)?"]}),
    ("CC-BY-NC-ND-4.0", "cc", {"name": [r"cc by nc nd(?: \d \d)?(?: international)?"], "grant": [UNDER + r"cc by nc nd(?: \d \d)?"]}),
    ("CC-BY-4.0", "creative", {"name": [r"creative commons attribution(?: licen[sc]e)?(?: \d \d)?(?: international)?"]}),
    ("CC-BY-SA-4.0", "creative", {"name": [r"creative commons attribution share ?alike(?: licen[sc]e)?(?: \d \d)?(?: international)?"]}),
    ("CC-BY-ND-4.0", "creative", {"name": [r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: licen[sc]e)?(?: \d \d)?"]}),
    ("CC-BY-NC-4.0", "creative", {"name": [r"creative commons attribution non ?commercial(?: licen[sc]e)?(?: \d \d)?(?: international)?"]}),
    ("CC-BY-NC-SA-4.0", "creative", {"name": [r"creative commons attribution non ?commercial share ?alike(?: licen[sc]e)?(?: \d \d)?"]}),
    ("CC-BY-NC-ND-4.0", "creative", {"name": [r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: licen[sc]e)?(?: \d \d)?"]}),
    ("CC-any", "creative", {"short": [r"creative commons(?: licen[sc]e)?"]}),
    ("ODbL-1.0", "database", {"name": [r"open (?:data commons )?(?:open )?database license"]}),
    ("ODbL-1.0", "odbl", {"short": [r"odbl(?: v?1 0)?"]}),
    ("ODC-By-1.0", "commons", {"name": [r"open data commons attribution license"]}),
    ("PDDL-1.0", "pddl", {"name": [r"pddl(?: 1 0)?"]}),
    ("OGL-UK-3.0", "government", {"name": [rf"open government licen[sc]e(?: {V}3(?: 0)?)?"]}),
    ("OFL-1.1", "sil", {"name": [rf"sil open font license(?: {V}1 1)?"], "grant": [UNDER + r"sil open font license"]}),
    ("OFL-1.1", "ofl", {"short": [r"ofl(?: v?1 1)?"]}),
    ("UPL-1.0", "universal", {"name": [rf"universal permissive license(?: {V}1 0)?"]}),
    ("NCSA", "ncsa", {"name": [r"(?:university of illinois )?ncsa open source license"]}),
    ("W3C", "w3c", {"name": [r"w3c software (?:notice and )?(?:document )?license"]}),
    ("AFL-3.0", "academic", {"name": [rf"academic free license(?: {V}3(?: 0)?)?"]}),
    ("OSL-3.0", "open", {"name": [rf"open software license(?: {V}3(?: 0)?)?"]}),
    ("ECL-2.0", "educational", {"name": [rf"educational community license(?: {V}2(?: 0)?)?"]}),
    ("MS-PL", "microsoft", {"name": [r"microsoft public license"]}),
    ("MS-RL", "microsoft", {"name": [r"microsoft reciprocal license"]}),
    ("MulanPSL-2.0", "mulan", {"name": [r"mulan (?:permissive software license|psl)(?: v?2)?"]}),
    ("PostgreSQL", "postgresql", {"name": [r"postgresql licen[sc]e"]}),
    ("Vim", "vim", {"name": [r"vim license"]}),
    ("ZPL-2.1", "zope", {"name": [rf"zope public license(?: {V}2 1)?"]}),
    ("LPPL-1.3c", "latex", {"name": [rf"latex project public license(?: {V}1 3c?)?"]}),
    ("QPL-1.0", "q", {"name": [rf"q public license(?: {V}1 0)?"]}),
    ("Sleepycat", "sleepycat", {"name": [r"sleepycat license"]}),
    ("RPL-1.5", "reciprocal", {"name": [rf"reciprocal public license(?: {V}1 5)?"]}),
    ("NASA-1.3", "nasa", {"name": [rf"nasa open source agreement(?: {V}1 3)?"]}),
    ("Blue-Oak-1.0.0", "oak", {"name": [r"blue oak model license(?: 1 0 0)?"]}),
    ("OpenRAIL", "openrail", {"name": [r"(?:creativeml )?openrail(?: m)?(?: license)?"]}),
    ("Llama-Community", "llama", {"name": [r"llama(?: \d(?: \d)?)? community license(?: agreement)?"]}),
    ("Proprietary", "reserved", {"grant": [r"all rights reserved"]}),
    ("Proprietary", "proprietary", {"name": [r"proprietary (?:and confidential|licen[sc]e|software)"]}),
    ("Proprietary", "confidential", {"grant": [r"unauthorized (?:copying|use|distribution)(?: \S+){0,10} strictly prohibited(?: \S+){0,3} confidential"]}),
    ("Proprietary", "agreement", {"name": [r"end user licen[sc]e agreement(?: eula)?"]}),
    ("Proprietary", "eula", {"name": [r"eula"]}),
    ("Non-Commercial", "commercial", {"grant": [r"for non commercial (?:use|purposes) only", r"not for commercial use", r"free for non commercial use"]}),
    ("Non-Commercial", "noncommercial", {"grant": [r"for noncommercial (?:use|purposes) only"]}),
    ("Non-Commercial", "personal", {"grant": [r"free for personal use"]}),
    ("Research-Only", "research", {"grant": [r"for (?:academic )?research (?:use|purposes) only"]}),
    ("Copyright-Notice", "copyright", {"short": [r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)?\d\d)?(?: by)?(?: \S+){1,3}", r"copyright c"]}),
    ("License-Reference", "license", {"short": [r"see (?:the )?license(?: file)?(?: for (?:more )?details)?", r"license (?:txt|md|file)", r"this license"]}),
    ("License-Reference", "dual", {"short": [r"dual licen[sc]ed"]}),
]


def signature_rules() -> list[Rule]:
    """All rules: those written out, then a tag and an address rule for each identifier."""
    rules = [_rule(keyword, body, kind, label) for label, keyword, kinds in FAMILIES for kind, bodies in kinds.items() for body in bodies]
    for label in dict.fromkeys(label for label, _, _ in FAMILIES):
        words = " ".join("".join(c if c.isalnum() else " " for c in label.lower()).split())
        rules.append(_rule("spdx", rf"spdx license identifier {words}", "tag", label))
        rules.append(_rule("licenses", rf"(?:https? )?(?:www )?(?:opensource|spdx|gnu|apache|creativecommons) org licenses {words}", "address", label))
    return rules


def gate(rules: list[Rule]) -> str:
    """A regular expression that a text without any of the rules' keywords, as whole words, doesn't match."""
    words = "|".join(sorted({re.escape(r.keyword) for r in rules}))
    return rf"(?i)(?<![^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])(?:{words})(?![^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])"
