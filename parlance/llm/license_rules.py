"""Signature rules of licences, in a notation for words.

A pattern is words between blanks: a|b is one of several, [the] may be missing, *3 is up to three
words of any kind. It is compiled to a regular expression over normalised text, in which each word
stands between a blank and a semicolon.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    name: str
    label: str
    priority: int  # 1 is the most certain
    keyword: str  # a word that every match contains
    pattern: str
    regex: str


#: Certainty of a detection by its rule's priority: an identifier or text, an address or notice, a grant, a mention.
SCORES = {1: 1.0, 2: 0.9, 3: 0.8, 4: 0.5}

# Label, words of its identifier, its names (;), words of its addresses (;).
LICENSES = """
mit | mit | mit license|licence; expat license|licence; x11 license|licence; license|licence mit | opensource org licenses|license mit; mit license org
mit-0 | mit 0 | mit no attribution [license|licence]; mit zero license|licence | opensource org licenses|license mit 0
apache-2.0 | apache 2 0 | apache [software] license|licence [version|v] 2|2.0|v2 [0]; apache license|licence; asl license|licence 2 | apache org licenses license 2 0; opensource org licenses apache 2 0
apache-1.1 | apache 1 1 | apache [software] license|licence [version] 1 1 | apache org licenses license 1 1
bsd-3-clause | bsd 3 clause | bsd 3|three clause license|licence; 3|three clause bsd license|licence; new|modified|revised bsd license|licence | opensource org licenses|license bsd 3 clause
bsd-2-clause | bsd 2 clause | bsd 2|two clause license|licence; 2|two clause bsd license|licence; simplified|freebsd bsd license|licence | opensource org licenses|license bsd 2 clause
bsd-4-clause | bsd 4 clause | bsd 4|four clause license|licence; original bsd license|licence | directory fsf org wiki license bsd 4clause
bsd | bsd 0 clause | bsd style license|licence; bsd license|licence; berkeley software distribution license|licence | opensource org licenses|license bsd license
0bsd | 0bsd | zero clause bsd license|licence; bsd zero clause license|licence | opensource org licenses|license 0bsd
gpl-3.0 | gpl 3 0 [only|or] [later] | gnu general public license|licence [version|v] 3|v3 [0]; gplv3 license|licence; gpl license|licence [version|v] 3|v3 | gnu org licenses gpl 3 0; gnu org licenses gpl3
gpl-2.0 | gpl 2 0 [only|or] [later] | gnu general public license|licence [version|v] 2|v2 [0]; gplv2 license|licence; gpl license|licence [version|v] 2|v2 | gnu org licenses gpl 2 0; gnu org licenses old licenses gpl 2 0
gpl-1.0 | gpl 1 0 [only|or] [later] | gnu general public license|licence [version|v] 1|v1 [0] | gnu org licenses old licenses gpl 1 0
gpl | gpl | gnu general public license|licence; gnu gpl license|licence; gpl license|licence | gnu org licenses gpl; gnu org copyleft gpl
lgpl-3.0 | lgpl 3 0 [only|or] [later] | gnu lesser general public license|licence [version|v] 3|v3 [0]; lgplv3 license|licence | gnu org licenses lgpl 3 0
lgpl-2.1 | lgpl 2 1 [only|or] [later] | gnu lesser general public license|licence [version|v] 2 1; lgpl license|licence 2 1 | gnu org licenses lgpl 2 1; gnu org licenses old licenses lgpl 2 1
lgpl-2.0 | lgpl 2 0 [only|or] [later] | gnu library general public license|licence [version|v] 2|v2 [0] | gnu org licenses old licenses lgpl 2 0
lgpl | lgpl | gnu lesser general public license|licence; lesser general public license|licence; gnu library general public license|licence; lgpl license|licence | gnu org licenses lgpl; gnu org copyleft lesser
agpl-3.0 | agpl 3 0 [only|or] [later] | gnu affero general public license|licence [version|v] 3|v3 [0]; affero general public license|licence; agplv3 license|licence | gnu org licenses agpl 3 0; gnu org licenses agpl
fdl-1.3 | gfdl 1 3 [only|or] [later] | gnu free documentation license|licence [version|v] 1 3 | gnu org licenses fdl 1 3
fdl | gfdl 1 2 [only|or] [later] | gnu free documentation license|licence; gfdl license|licence | gnu org licenses fdl; gnu org copyleft fdl
mpl-2.0 | mpl 2 0 | mozilla public license|licence [version|v] 2|v2 [0]; mpl license|licence 2 0 | mozilla org mpl 2 0; mozilla org en us mpl 2 0
mpl-1.1 | mpl 1 1 | mozilla public license|licence [version|v] 1 1 | mozilla org mpl 1 1
mpl | mpl 1 0 | mozilla public license|licence; mpl license|licence | mozilla org mpl
epl-2.0 | epl 2 0 | eclipse public license|licence [version|v] 2|v2 [0] | eclipse org legal epl 2 0; eclipse org legal epl v20
epl-1.0 | epl 1 0 | eclipse public license|licence [version|v] 1|v1 [0]; eclipse public license|licence | eclipse org legal epl v10
edl | bsd 3 clause eclipse | eclipse distribution license|licence | eclipse org org documents edl v10
cddl-1.0 | cddl 1 0 | common development and distribution license|licence; cddl license|licence | opensource org licenses|license cddl 1 0
cddl-1.1 | cddl 1 1 | common development and distribution license|licence [version|v] 1 1 | glassfish java net public cddl
cpl-1.0 | cpl 1 0 | common public license|licence; ibm common public license|licence | opensource org licenses|license cpl 1 0
ipl-1.0 | ipl 1 0 | ibm public license|licence | opensource org licenses|license ipl 1 0
isc | isc | isc license|licence; internet systems consortium license|licence | opensource org licenses|license isc
zlib | zlib | zlib license|licence; zlib libpng license|licence | opensource org licenses|license zlib; zlib net zlib license
libpng | libpng 2 0 | libpng license|licence; png reference library license|licence | libpng org pub png src libpng license
bsl-1.0 | bsl 1 0 | boost software license|licence; boost license|licence | boost org license 1 0; opensource org licenses|license bsl 1 0
unlicense | unlicense | the unlicense license|licence; unlicense license|licence | unlicense org; opensource org licenses|license unlicense
wtfpl | wtfpl | wtfpl license|licence; do what the fuck you want to public license|licence | wtfpl net; sam zoy org wtfpl
artistic-2.0 | artistic 2 0 | artistic license|licence [version|v] 2|v2 [0] | opensource org licenses|license artistic 2 0
artistic | artistic 1 0 [perl|cl8] | artistic license|licence; perl artistic license|licence | opensource org licenses|license artistic license; dev perl org licenses artistic
eupl-1.2 | eupl 1 2 | european union public license|licence [version|v] 1 2 | joinup ec europa eu collection eupl
eupl | eupl 1 1 | european union public license|licence; eupl license|licence | ec europa eu idabc eupl
osl-3.0 | osl 3 0 | open software license|licence [version|v] 3|v3 [0]; open software license|licence | opensource org licenses|license osl 3 0
afl-3.0 | afl 3 0 | academic free license|licence [version|v] 3|v3 [0]; academic free license|licence | opensource org licenses|license afl 3 0
ms-pl | ms pl | microsoft public license|licence | opensource org licenses|license ms pl
ms-rl | ms rl | microsoft reciprocal license|licence | opensource org licenses|license ms rl
python-2.0 | python 2 0; psf 2 0 | python software foundation license|licence; psf license|licence | docs python org license; python org psf license
php-3.01 | php 3 01 | php license|licence [version|v] 3 01; php license|licence | php net license 3 01; php net license
ruby | ruby | ruby license|licence | ruby lang org en about license
openssl | openssl | openssl license|licence; openssl and ssleay license|licence | openssl org source license
ofl-1.1 | ofl 1 1 | sil open font license|licence [version|v] 1 [1]; open font license|licence | scripts sil org ofl; openfontlicense org
cc0-1.0 | cc0 1 0 | creative commons zero license|licence; cc0 license|licence; creative commons cc0 | creativecommons org publicdomain zero 1 0
cc-by-4.0 | cc by 4 0 | creative commons attribution 4 0 [international]; cc by 4 0 license|licence; cc by 4 0 | creativecommons org licenses by 4 0
cc-by-3.0 | cc by 3 0 | creative commons attribution 3 0 [unported|us]; cc by 3 0 | creativecommons org licenses by 3 0
cc-by-sa-4.0 | cc by sa 4 0 | creative commons attribution share|sharealike [alike] 4 0; cc by sa 4 0 | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | cc by sa 3 0 | creative commons attribution share|sharealike [alike] 3 0; cc by sa 3 0 | creativecommons org licenses by sa 3 0
cc-by-nc-4.0 | cc by nc 4 0 | creative commons attribution non|noncommercial [commercial] 4 0; cc by nc 4 0 | creativecommons org licenses by nc 4 0
cc-by-nc-sa-4.0 | cc by nc sa 4 0 | creative commons attribution non|noncommercial [commercial] share|sharealike [alike] 4 0; cc by nc sa 4 0 | creativecommons org licenses by nc sa 4 0
cc-by-nd-4.0 | cc by nd 4 0 | creative commons attribution no|noderivatives|noderivs [derivatives|derivs] 4 0; cc by nd 4 0 | creativecommons org licenses by nd 4 0
cc-by-nc-nd-4.0 | cc by nc nd 4 0 | creative commons attribution non|noncommercial [commercial] no|noderivatives|noderivs [derivatives|derivs] 4 0; cc by nc nd 4 0 | creativecommons org licenses by nc nd 4 0
cc-by-sa | cc by sa | creative commons attribution share|sharealike [alike] license|licence; cc by sa license|licence; cc by sa | creativecommons org licenses by sa
cc-by-nc | cc by nc | creative commons attribution non|noncommercial [commercial] license|licence; cc by nc license|licence; cc by nc | creativecommons org licenses by nc
cc-by-nd | cc by nd | creative commons attribution no|noderivatives|noderivs [derivatives|derivs] license|licence; cc by nd | creativecommons org licenses by nd
cc-by-nc-sa | cc by nc sa | cc by nc sa license|licence; cc by nc sa | creativecommons org licenses by nc sa
cc-by-nc-nd | cc by nc nd | cc by nc nd license|licence; cc by nc nd | creativecommons org licenses by nc nd
cc-by | cc by | creative commons attribution license|licence; cc by license|licence | creativecommons org licenses by
cc-pdm | cc pdm 1 0 | creative commons public domain mark | creativecommons org publicdomain mark 1 0
odbl-1.0 | odbl 1 0 | open database license|licence; odbl license|licence | opendatacommons org licenses odbl
odc-by-1.0 | odc by 1 0 | open data commons attribution license|licence | opendatacommons org licenses by
pddl-1.0 | pddl 1 0 | public domain dedication and license|licence; open data commons public domain dedication | opendatacommons org licenses pddl
ogl-uk-3.0 | ogl uk 3 0 | open government license|licence [version|v] 3|v3 [0]; open government license|licence | nationalarchives gov uk doc open government licence version 3
etalab-2.0 | etalab 2 0 | etalab open license|licence; licence ouverte etalab | etalab gouv fr licence ouverte open licence
dl-de-by-2.0 | dl de by 2 0 | datenlizenz deutschland namensnennung 2 0 | govdata de dl de by 2 0
busl-1.1 | busl 1 1 | business source license|licence [version|v] 1 1; business source license|licence | mariadb com bsl11
sspl-1.0 | sspl 1 0 | server side public license|licence | mongodb com licensing server side public license
elastic-2.0 | elastic 2 0 | elastic license|licence 2|v2 [0]; elastic license|licence | elastic co licensing elastic license
bigscience-rail | bigscience bloom rail 1 0 | bigscience rail license|licence; responsible ai license|licence; openrail m license|licence | huggingface co spaces bigscience license
vim | vim | vim license|licence | vimdoc sourceforge net htmldoc uganda
ncsa | ncsa | university of illinois ncsa open source license|licence; ncsa open source license|licence | opensource org licenses|license ncsa
upl-1.0 | upl 1 0 | universal permissive license|licence | opensource org licenses|license upl
mulan-psl-2.0 | mulanpsl 2 0 | mulan permissive software license|licence [version|v] 2 | license coscl org cn mulanpsl2
qpl-1.0 | qpl 1 0 | q public license|licence | opensource org licenses|license qpl 1 0
lppl-1.3c | lppl 1 3c | latex project public license|licence; lppl license|licence | latex project org lppl
""".strip()

# Phrases of licence texts and notices; label, priority, keyword, pattern.
PHRASES = """
mit | 1 | permission | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 2 | copyright | the above copyright notice and this permission notice shall be included in all copies
isc | 1 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee
bsd | 1 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | 1 | permission | neither the name of *12 may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | 1 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledgement
apache-2.0 | 1 | apache | licensed under the apache license version 2 0 the license you may not use this file except in compliance
gpl | 1 | redistribute | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
lgpl | 1 | redistribute | this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license
agpl-3.0 | 1 | redistribute | this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license
gpl-3.0 | 2 | license | either version 3 of the license or [at] [your] [option] [any] later version
gpl-2.0 | 2 | license | either version 2 of the license or [at] [your] [option] [any] later version
mpl-2.0 | 1 | license | this source code form is subject to the terms of the mozilla public license v|version 2 0
zlib | 1 | warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
bsl-1.0 | 1 | permission | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
unlicense | 1 | encumbered | this is free and unencumbered software released into the public domain
public-domain | 2 | domain | released|dedicated|placed into|to|in the public domain
public-domain | 3 | domain | this work|file|software|code|text is in the public domain
public-domain | 4 | domain | public domain
no-warranty | 4 | warranty | the software is provided as is without warranty of any kind
no-warranty | 4 | warranty | without even the implied warranty of merchantability or fitness for a particular purpose
copyright | 3 | copyright | copyright [c] 19[0-9][0-9]|20[0-9][0-9]
copyright | 3 | copyright | copyright c|by
copyright | 4 | copyright | all copyright reserved|rights [reserved]
reserved | 2 | reserved | all rights reserved
reserved | 3 | reserved | some rights reserved
reserved | 3 | droits | tous droits reserves|réservés
reserved | 3 | rechte | alle rechte vorbehalten
reserved | 3 | derechos | todos los derechos reservados
proprietary | 2 | proprietary | proprietary and confidential
proprietary | 3 | proprietary | this software is the proprietary information of
proprietary | 3 | permission | may not be reproduced *6 without [the] [prior] written permission
noncommercial | 3 | license | for non|noncommercial [commercial] use only *4 license
academic-only | 3 | license | academic|research use only license
commercial | 3 | license | commercial license agreement
eula | 3 | license | end user license agreement
license-notice | 4 | license | see [the] license|copying [file] for [the] license [details|terms]
license-notice | 4 | license | this file is part of *4 license
license-notice | 4 | licensed | dual|multi licensed under
mit | 1 | permission | to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons
mit | 2 | software | the software is provided as is without warranty of any kind express or implied
ncsa | 1 | software | to deal with the software without restriction including without limitation
x11 | 1 | advertising | except as contained in this notice the name *8 shall not be used in advertising or otherwise to promote
json | 1 | software | the software shall be used for good not evil
isc | 2 | copyright | provided that the above copyright notice and this permission notice appear in all copies
0bsd | 1 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software
postgresql | 1 | permission | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
hpnd | 2 | permission | permission to use copy modify and distribute this software and its documentation for any purpose
bsd | 2 | copyright | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | 2 | copyright | redistributions in binary form must reproduce the above copyright notice this list of conditions
bsd | 2 | copyright | this software is provided by the copyright holders|owners|authors [and] [contributors] as is and any express or implied warranties
apache-2.0 | 2 | license | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | 1 | license | terms and conditions for use reproduction and distribution *4 definitions license shall mean
apache-2.0 | 2 | license | licensed to the apache software foundation asf under one or more contributor license agreements
gpl | 2 | license | you should have received a copy of the gnu general public license along with this|the program|software|file
lgpl | 2 | license | you should have received a copy of the gnu lesser|library general public license along with this|the library|program
agpl-3.0 | 2 | license | you should have received a copy of the gnu affero general public license along with this program
gpl | 2 | warranty | this|the program|software is distributed in the hope that it will be useful but without any warranty
gpl | 1 | license | the gnu general public license is a free copyleft license for software and other kinds of works
agpl-3.0 | 1 | license | the gnu affero general public license is a free copyleft license for software and other kinds of works
gpl-2.0 | 1 | license | the licenses for most software are designed to take away your freedom to share and change it
license-text | 3 | license | everyone is permitted to copy and distribute verbatim copies of this license document
fdl | 1 | permission | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-1.1 | 1 | license | the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 | 2 | license | if a copy of the mpl was not distributed with this file you can obtain one at *4 mozilla org
epl-1.0 | 2 | license | made available under the terms of the eclipse public license v1|version 1 0 which accompanies
epl-2.0 | 2 | license | made available under the terms of the eclipse public license 2 0 which is available
epl-2.0 | 1 | license | the accompanying program is provided under the terms of this eclipse public license agreement
cddl-1.0 | 2 | license | the contents of this file are subject to the terms of the common development and distribution license
cpl-1.0 | 1 | license | the accompanying program is provided under the terms of this common public license agreement
artistic-2.0 | 2 | license | you are always permitted to make arbitrary changes to your copy of the package *4 license
openssl | 2 | software | this product includes software developed by the openssl project
php-3.01 | 2 | software | this product includes php software freely available from
python-2.0 | 1 | license | psf hereby grants licensee a nonexclusive royalty free world wide license
ofl-1.1 | 2 | software | this font software is licensed under the sil open font license
ofl-1.1 | 1 | licenses | the goals of the open font license ofl are to stimulate worldwide development
ms-pl | 1 | license | this license governs use of the accompanying software if you use the software you accept this license
upl-1.0 | 1 | software | subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software
eupl | 2 | licence | licensed under the eupl [version] [1] [2]
busl-1.1 | 1 | licensed | make non production use of the licensed work
sspl-1.0 | 1 | software | make the functionality of the program or a modified version available to third parties as a service *40 software
cc-by-4.0 | 1 | licensed | by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution 4 0
cc | 2 | licensed | by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions
cc | 2 | license | this work is licensed under a creative commons *8 license
cc0-1.0 | 1 | copyright | waived all copyright and related or neighboring|neighbouring rights to this work|document
cc-pdm | 2 | copyright | this work has been identified as being free of known restrictions under copyright law
odbl-1.0 | 2 | license | made available under the open database license
odbl-1.0 | 2 | license | any rights in individual contents of the database are licensed under
lppl-1.3c | 2 | license | this work may be distributed and or modified under the conditions of the latex project public license
mulan-psl-2.0 | 2 | software | you can use this software according to the terms and conditions of the mulan psl
cc-by | 4 | cc | cc by
gpl | 4 | public | general public license
""".strip()

#: Every match of a rule has one of these in its text, lower-cased (or cc and by, see license_scan): only such texts are looked at closely.
GATES = (
    "licen", "copyright", "copyleft", "reserv", "réserv", "vorbehalten", "creative", "permission", "warrant", "redistribut", "domain",
    "gnu", "mozilla", "propriet", "public", "org", "advertis", "software", "namensnennung", "europa", "nationalarchives", "attribution",
    "wtfpl", "govdata", "mariadb", "huggingface", "commons", "copying", "zlib",
)

# The phrases that must be found, with their labels.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))


_CLASS = re.compile(r"\[.-.\]")


def compiled(pattern: str) -> str:
    """The regular expression of a pattern. It has no groups to capture and no look-around."""
    out = []
    for token in pattern.split():
        if token[0] == "*":
            out.append(f"(?: [^;]+;){{0,{token[1:]}}}")
            continue
        # The first bracket must be closed by the last: 19[0-9][0-9] and [0-9][0-9] are words with classes.
        inner = token[1:-1] if token[0] == "[" and token.find("]") == len(token) - 1 and not _CLASS.fullmatch(token) else token
        word = f" (?:{inner});" if "|" in inner else f" {inner};"
        out.append(f"(?:{word})?" if inner != token else word)
    return "".join(out)


def _keyword(pattern: str) -> str:
    """A word every match has: the longest that is neither optional nor a choice."""
    return max((t for t in pattern.split() if not set(t) & set("[]|*")), key=len)


def _forms(label: str, kind: str, priority: int, patterns: list[str], keyword: str | None = None) -> list[Rule]:
    return [Rule(f"{label}/{kind}{k}", label, priority, keyword or _keyword(p), p, compiled(p)) for k, p in enumerate(patterns)]


def all_rules() -> list[Rule]:
    """Every rule, in order: of equal detections the earlier rule stays."""
    out: list[Rule] = []
    for line in LICENSES.split("\n"):
        label, ids, names, urls = (x.strip() for x in line.split(" | "))
        ids, names, urls = ([p.strip() for p in cell.split(";")] for cell in (ids, names, urls))
        out += _forms(label, "tag", 1, [f"spdx license identifier {p}" for p in ids], "identifier")
        out += _forms(label, "address", 2, urls)
        granted = [f"licensed|released|distributed|available|published|provided|licenced under [the] [terms] [of] [the] {p}" for p in names]
        out += [r._replace(name=f"{label}/grant{k}", priority=3, pattern=g, regex=compiled(g)) for k, (r, g) in enumerate(zip(_forms(label, "grant", 3, names), granted, strict=True))]
        out += _forms(label, "name", 4, names)
    for k, line in enumerate(PHRASES.split("\n")):
        label, priority, keyword, pattern = (x.strip() for x in line.split(" | "))
        out.append(Rule(f"{label}/phrase{k}", label, int(priority), keyword if f" {keyword} " in f" {pattern} " else _keyword(pattern), pattern, compiled(pattern)))
    return out

