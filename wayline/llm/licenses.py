"""License scans: ordered signature rules over a text's words, gated by keywords, with overlaps resolved.

A text is lower-cased (A-Z), and its words are put side by side with one blank between them; rules are regular expressions over
that line. A rule is tried only if one of its keywords is among the words,
and every match holds one. Of overlapping finds, one that lies inside the words of a
find of higher priority is suppressed; among equals the longer, then the earlier stays. Base phrases stand above all rules and
are never suppressed.

Defined cases: null and empty text have no words, no finds and score 0; very long texts are scanned whole; repeated rows give
repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wayline.llm.common import small_batches

#: Phrases fixed by the contract, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label | words of its SPDX id | name as a regular expression over words; "!" before a label: the name alone is proof.
NAMES = """
mit | mit | (?:mit|expat|x11)
mit-0 | mit 0 | mit no attribution
!apache-1.1 | apache 1 1 | apache (?:software )?(?:license )?(?:version |v)?1 1
!apache-2 | apache 2 0 | apache (?:software )?(?:license )?(?:version |v)?2(?: 0)?
!bsd-2-clause | bsd 2 clause | (?:bsd (?:2|two) clause|simplified bsd|freebsd license)
!bsd-3-clause | bsd 3 clause | (?:bsd (?:3|three) clause|(?:new|modified|revised) bsd)
!bsd-4-clause | bsd 4 clause | (?:bsd (?:4|four) clause|(?:original|old) bsd)
!0bsd | 0bsd | (?:zero clause bsd|0bsd)
bsd | bsd | bsd(?: style)?
!gpl-1 | gpl 1 0 | (?:gnu )?(?:gpl|general public license) (?:version |v)?1(?: 0)?
!gpl-2 | gpl 2 0 | (?:gnu )?(?:gpl|general public license) (?:version |v)?2(?: 0)?
!gpl-3 | gpl 3 0 | (?:gnu )?(?:gpl|general public license) (?:version |v)?3(?: 0)?
!gplv2 | gplv2 | gplv2
!gplv3 | gplv3 | gplv3
gpl | gpl | (?:gnu general public|gnu gpl|gpl)
!lgpl-2 | lgpl 2 0 | (?:gnu )?(?:lgpl|library general public license) (?:version |v)?2(?: 0)?
!lgpl-2.1 | lgpl 2 1 | (?:gnu )?(?:lgpl|lesser general public license) (?:version |v)?2 1
!lgpl-3 | lgpl 3 0 | (?:gnu )?(?:lgpl|lesser general public license) (?:version |v)?3(?: 0)?
lgpl | lgpl | (?:gnu lesser general public|gnu lgpl|lgpl)
!agpl-3 | agpl 3 0 | (?:gnu )?(?:agpl|affero general public license) (?:version |v)?3(?: 0)?
agpl | agpl | (?:gnu affero general public|gnu agpl|agpl)
!gfdl-1.1 | gfdl 1 1 | (?:gnu )?free documentation license (?:version |v)?1 1
!gfdl-1.2 | gfdl 1 2 | (?:gnu )?free documentation license (?:version |v)?1 2
!gfdl-1.3 | gfdl 1 3 | (?:gnu )?free documentation license (?:version |v)?1 3
gfdl | gfdl | gnu free documentation
!mpl-1.0 | mpl 1 0 | mozilla public license (?:version |v)?1 0
!mpl-1.1 | mpl 1 1 | mozilla public license (?:version |v)?1 1
!mpl-2.0 | mpl 2 0 | mozilla public license (?:version |v)?2(?: 0)?
mpl | mpl | mozilla public
!epl-1.0 | epl 1 0 | eclipse public license (?:version |v)?1(?: 0)?
!epl-2.0 | epl 2 0 | eclipse public license (?:version |v)?2(?: 0)?
epl | epl | eclipse public
!edl-1.0 | bsd 3 clause edl | eclipse distribution license (?:version |v)?1 0
!cddl-1.0 | cddl 1 0 | common development and distribution license (?:version |v)?1 0
!cddl-1.1 | cddl 1 1 | common development and distribution license (?:version |v)?1 1
cddl | cddl | (?:common development and distribution|cddl)
!cpl-1.0 | cpl 1 0 | common public license (?:version |v)?1 0
!ipl-1.0 | ipl 1 0 | ibm public license (?:version |v)?1 0
!eupl-1.1 | eupl 1 1 | european union public licen[cs]e (?:version |v)?1 1
!eupl-1.2 | eupl 1 2 | european union public licen[cs]e (?:version |v)?1 2
!artistic-1.0 | artistic 1 0 | artistic license (?:version |v)?1(?: 0)?
!artistic-2.0 | artistic 2 0 | artistic license (?:version |v)?2(?: 0)?
artistic | artistic | artistic
!bsl-1.0 | bsl 1 0 | boost software license(?: (?:version |v)?1 0)?
!busl-1.1 | busl 1 1 | business source license(?: (?:version |v)?1 1)?
!sspl-1 | sspl 1 0 | server side public license(?: (?:version |v)?1)?
!elastic-2 | elastic 2 0 | elastic license (?:version |v)?2(?: 0)?
!isc | isc | (?:isc license|internet systems consortium license)
!zlib | zlib | zlib(?: libpng)? license
!libpng | libpng | libpng license
!unlicense | unlicense | unlicense(?: org)?
!wtfpl | wtfpl | (?:wtfpl|do what the fuck you want to public license)
!cc0-1.0 | cc0 1 0 | (?:cc0|creative commons zero)(?: 1 0)?(?: universal)?
!cc-by | cc by | (?:cc by(?! n[cd]| sa)|creative commons attribution(?! non| no | share))(?: [1-4] [05])?
!cc-by-sa | cc by sa | (?:cc by sa|creative commons attribution share ?alike)(?: [1-4] [05])?
!cc-by-nd | cc by nd | (?:cc by nd|creative commons attribution no ?deriv(?:ative|s|atives)?)(?: [1-4] [05])?
!cc-by-nc-sa | cc by nc sa | (?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] [05])?
!cc-by-nc-nd | cc by nc nd | (?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative|s|atives)?)(?: [1-4] [05])?
!cc-by-nc | cc by nc | (?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] [05])?
!odbl-1.0 | odbl 1 0 | (?:open database license|odbl)(?: (?:version |v)?1 0)?
!odc-by | odc by 1 0 | (?:odc attribution|open data commons attribution) license
!pddl-1.0 | pddl 1 0 | (?:public domain dedication and license|pddl)
!ogl-uk | ogl uk 3 0 | open government licen[cs]e(?: (?:version |v)?[123] 0)?
!ofl-1.1 | ofl 1 1 | (?:sil )?open font license(?: (?:version |v)?1 1)?
!python-2.0 | python 2 0 | (?:python software foundation|psf) license(?: agreement)?
!ruby | ruby | ruby s? ?license
!php-3 | php 3 01 | php license(?: (?:version |v)?3 0?1?)?
!postgresql | postgresql | postgresql license
!openssl | openssl | openssl license
!ncsa | ncsa | (?:university of illinois )?ncsa open source license
!afl-3.0 | afl 3 0 | academic free license(?: (?:version |v)?[123] [01])?
!osl-3.0 | osl 3 0 | open software license(?: (?:version |v)?[123] [01])?
!ms-pl | ms pl | microsoft public license
!ms-rl | ms rl | microsoft reciprocal license
!upl-1.0 | upl 1 0 | universal permissive license
!ecl-2.0 | ecl 2 0 | educational community license
!qpl-1.0 | qpl 1 0 | q public license
!sleepycat | sleepycat | sleepycat license
!w3c | w3c | w3c software (?:notice and |and document )?license
!wxwindows | wxwindows | wxwindows library licen[cs]e
!lppl-1.3 | lppl 1 3c | latex project public license
!zpl-2.1 | zpl 2 1 | zope public license
!vim | vim | vim license
!curl | curl | curl license
!blueoak-1.0 | blueoak 1 0 0 | blue oak model license
!mulan-2 | mulanpsl 2 0 | mulan permissive software license
!cecill-2.1 | cecill 2 1 | cecill (?:free software )?license(?: (?:version |v)?2 1)?
!json | json | json license
!beerware | beerware | (?:beer ware|beerware) license
!llama | llama | llama(?: [234](?: [0-9])?)? community license
!openrail | openrail | (?:creativeml )?openrail(?: [ms])?
!rail | rail | responsible ai license
!polyform-nc | polyform noncommercial 1 0 0 | polyform non ?commercial license
!commons-clause | commons clause | commons clause(?: license condition)?
!hippocratic | hippocratic 2 1 | hippocratic license
!etalab | etalab 2 0 | licence ouverte(?: etalab)?
!dl-de-by | dl de by 2 0 | datenlizenz deutschland
"""

#: label | keywords | words of a licence's own text; the texts name no licence, so they stand below the names. Every match of a text
#: holds one of its keywords as a whole word: one that all alternatives share, or one for each alternative.
TEXTS = r"""
mit | hereby | permission is hereby granted free of charge to any person obtaining a copy
mit | noninfringement | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit | substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd | redistributions | redistributions of source code must retain the above (?:copyright )?notice
bsd | redistributions | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | endorse | neither the names? of (?:\S+ ){1,12}may be used to endorse or promote products
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display
isc | fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
zlib | misrepresented | the origin of this software must not be misrepresented
zlib | altered | altered source versions must be plainly marked as such
apache-2 | limitations | see the license for the specific language governing permissions and limitations under the license
apache-2 | compliance | you may not use this file except in compliance with the license
apache-2 | perpetual | a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license
gpl | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license
gpl | hope | distributed in the hope that it will be useful but without any warranty
lgpl | redistribute | you can redistribute it and or modify it under the terms of the gnu lesser general public license
agpl | redistribute | you can redistribute it and or modify it under the terms of the gnu affero general public license
gpl | received | you should have received a copy of the gnu general public license
lgpl | received | you should have received a copy of the gnu lesser general public license
mpl-2.0 | subject | this source code form is subject to the terms of the mozilla public license
mpl-2.0 | obtain | if a copy of the mpl was not distributed with this file you can obtain one at
unlicense | unencumbered | this is free and unencumbered software released into the public domain
unlicense | dedicate, dedicates | the authors? dedicates? any and all copyright interest in the software to the public domain
wtfpl | fuck | you just do what the fuck you want to
bsl-1.0 | derivative | all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code
cc0-1.0 | waived | to the extent possible under law (?:\S+ ){1,10}(?:has|have) waived all copyright
cc | creativecommons | creativecommons org (?:licenses|publicdomain)
cc | creative | this (?:work|article|book|page|text|material|content) is licensed under (?:a|the) creative commons
cc-by | reuse | reuse is permitted provided the original (?:author|source|work) (?:is|are) credited
ofl-1.1 | font | this font software is licensed under the sil open font license
openssl | openssl | this product includes software developed by the openssl project
php-3 | php | this product includes php software
artistic | perl, artistic | you may distribute (?:this|it) under the (?:same )?terms (?:as perl itself|of (?:either )?the artistic license)
gpl | reciprocal, copyleft | (?:strong |weak )?(?:copyleft|reciprocal) licen[cs]e terms apply
gpl | gnu | this program is free software you can redistribute it and or modify it under the terms of the gnu
gpl | foundation | as published by the free software foundation either version [123](?: of the license)?
gpl | franklin | free software foundation inc 51 franklin st(?:reet)?
gpl | verbatim | everyone is permitted to copy and distribute verbatim copies of this license document
lgpl | linking | combine or link a covered work with the library without linking exceptions
gpl-classpath | exception | as a special exception the copyright holders of this library give you permission to link
gpl-linking | linking | linking this library statically or dynamically with other modules is making a combined work
agpl | network | interacting with it remotely through a computer network
bsd | advertisement, advertisements | the name of the (?:author|copyright holder|university) may not be used in advertisements?
bsd | disclaimer | this list of conditions and the following disclaimer(?: in the documentation)?
bsd | contributors | provided by the copyright holders and contributors as is
bsd | regents | (?:copyright )?(?:c )?(?:19|20)[0-9][0-9] the regents of the university of california
bsd-4-clause | acknowledgement | must display the following acknowledgement this product includes software developed by
apache-2 | unless | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2 | prominent | you must cause any modified files to carry prominent notices stating that you changed the files
apache-2 | foundation | licensed to the apache software foundation asf under one or more contributor license agreements
apache-2 | asf | the asf licenses this file to you under the apache license
mit | sublicense | to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | liability | in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit-0 | attribution | without the above copyright notice or attribution being required
x11 | consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
isc | disclaims | the author disclaims all warranties with regard to this software
zlib | arising | in no event will the authors be held liable for any damages arising from the use of this software
boost | machine | solely in the form of machine executable object code generated by a source language processor
mpl | exhibit | exhibit [ab](?: source code form license notice| incompatible with secondary licenses notice)
mpl-2.0 | incompatible | this source code form is incompatible with secondary licenses
epl | accompanying | this program and the accompanying materials are made available under the terms of the eclipse
cddl | cddl | the contents of this file are subject to the terms of the common development and distribution license (?:\S+ ){0,3}cddl
eupl | eupl | licensed under the eupl(?: version)?(?: 1)?(?: [12])?
artistic | standard | you may otherwise modify your copy of this package (?:\S+ ){0,4}standard version
artistic | package | the intent of this document is to state the conditions under which a package may be copied
perl | perl | (?:you can redistribute it and or modify it )?under the same terms as perl(?: 5)?(?: itself)?
python-2.0 | beopen | beopen python open source license agreement
python-2.0 | cnri | cnri (?:open source )?license agreement
ruby | ruby | ruby is copyrighted free software by yukihiro matsumoto
tcl | tcl | this software is copyrighted by the regents (?:\S+ ){0,20}tcl
vim | charityware, uganda | (?:vim is charityware|help poor children in uganda)
postgresql | postgres | postgresql database management system formerly known as postgres
openssl | openssl | the names openssl toolkit and openssl project must not be used to endorse
ssleay | ssleay | this package is an ssl implementation written by eric young (?:\S+ ){0,6}ssleay
curl | retain | permission to use copy modify and distribute (?:\S+ ){0,12}retain the copyright notice
icu | unicode | unicode inc licen[cs]e agreement data files and software
unicode | unicode | distributed under the terms of use in (?:http |https )?www unicode org copyright html
w3c | w3c | by obtaining using and or copying this work you (?:\S+ ){0,12}w3c
ofl-1.1 | reserved | copyright (?:\S+ ){1,12}with reserved font name
gust | lppl | gust font license(?: lppl)? (?:is )?based on the lppl
lppl-1.3 | lppl | this work may be distributed and or modified under the conditions of the lppl
cc0-1.0 | waives, waived, waive | (?:affirmer|author|creator) (?:hereby )?(?:overtly fully permanently irrevocably and unconditionally )?waive[sd]?(?: all of)?(?: their| the)? (?:copyright|related)
cc0-1.0 | rights | no rights reserved
cc | appropriate | you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-sa | remix | if you remix transform or build upon the material you must distribute your contributions under the same licen[cs]e(?: as the original)?(?: share alike)?
cc-by-nc | commercial | you may not use the material for commercial purposes
cc-by-nd | remix | if you remix transform or build upon the material you may not distribute the modified material
cc | legalcode | creativecommons org licenses \S+ [1-4] [05] legalcode
odbl-1.0 | database | made available under the open database license
ogl-uk | crown | crown copyright (?:and database rights? )?(?:c )?(?:19|20)[0-9][0-9]
ogl-uk | sector | contains public sector information licensed under the open government licen[cs]e
us-gov | government | (?:is )?a work of the (?:united states|us|u s) government(?: and is not subject to copyright)?
us-gov | title | pursuant to title 17 section 105 of the united states code
public-domain | domain | this (?:work|file|text|code|program|image) (?:is|has been) (?:placed |released |dedicated )?(?:in|into|to) the public domain
public-domain | expired | copyright (?:has|term has|protection has) expired
public-domain | gutenberg | project gutenberg(?: tm)? (?:e ?book|e ?text|licen[cs]e)
busl-1.1 | change | change date (?:\S+ ){1,10}change licen[cs]e
sspl-1 | service | making the functionality of the program available to third parties as a service
elastic-2 | managed | you may not provide the software to third parties as a hosted or managed service
commons-clause | sell | the license does not grant to you the right to sell the software
polyform-nc | noncommercial | any noncommercial purpose is a permitted purpose
openrail | restrictions | use based restrictions as referenced in paragraph 5
llama | monthly | greater than 700 million monthly active users
llama | llama | (?:built with |copyright c meta platforms inc (?:\S+ ){0,6})(?:meta )?llama(?: [0-9])?
json | evil | the software shall be used for good not evil
beerware | beer | if we meet some day and you think this stuff is worth it you can buy me a beer
hippocratic | human | the software (?:may|shall) not be used (?:\S+ ){0,8}human rights
proprietary | trade | (?:contains|constitutes) (?:\S+ ){0,4}trade secrets?(?: of)?
proprietary | disclosure | unauthori[sz]ed disclosure (?:or use )?(?:is )?(?:strictly )?prohibited
proprietary | reverse | you (?:may|shall|agree) not (?:to )?reverse engineer(?: decompile or disassemble)?
proprietary | transferable | non exclusive (?:and )?non transferable (?:\S+ ){0,3}licen[cs]e
proprietary | internal | for (?:your|its|the licensee s) internal (?:business )?(?:use|purposes) only
proprietary | evaluation | for evaluation (?:use|purposes) only
proprietary | sold | this software is licensed not sold
proprietary | subscription | a valid subscription is required
no-ai-training | scraping, mining | text and data mining (?:is |rights are )?(?:expressly )?(?:reserved|prohibited|forbidden)
no-ai-training | ai, artificial, machine | (?:may|must|shall) not be used (?:\S+ ){0,6}(?:ai|artificial intelligence|machine learning)(?: models?| systems?| training)?
research-only | research | (?:solely|exclusively|only) for (?:non commercial |academic |scientific )*research(?: and \S+)? purposes
non-commercial | profit | (?:not for|non) profit (?:use|purposes|organi[sz]ations) only
personal-use | personal | (?:for )?(?:your )?personal (?:and )?(?:non ?commercial )?use only
attribution | credit | (?:please |must )?(?:give|provide) (?:proper |appropriate )?credit to the (?:author|original author|photographer|source)
permission | reprinted | reprinted (?:with|by) (?:kind )?permission(?: of| from)
permission | reproduced | reproduced (?:with|by) (?:kind )?permission(?: of| from)
copyright | trademarks | (?:all )?trademarks (?:are|remain) (?:the )?property of their respective owners
copyright | copyrights | all copyrights (?:are )?(?:owned|held|retained) by
copyright | broadcast | this material may not be published broadcast rewritten or (?:re ?distributed|syndicated)
ms-pl | accompanying | this license governs use of the accompanying software
ncsa | deal | to deal with the software without restriction
public-domain | domain | (?:is|are|been|placed|released|dedicated) (?:in|into|to) the public domain
public-domain | domain | public domain dedication
public-domain | copyright | no (?:known )?copyright restrictions
public-domain | waives | waives all (?:copyright|rights)
proprietary | rights | all rights reserved
proprietary | confidential | (?:proprietary and confidential|confidential and proprietary)
proprietary | unauthorised, unauthorized | unauthori[sz]ed (?:copying|use|reproduction|distribution) (?:of this (?:file|software|document|work) )?(?:\S+ ){0,6}(?:is )?(?:strictly )?prohibited
proprietary | reproduced, copied, distributed | (?:may|must) not be (?:reproduced|copied|distributed)(?: \S+){0,8} without (?:the )?(?:prior )?(?:express )?(?:written )?(?:permission|consent)
proprietary | permission | reproduction (?:in whole or in part )?without (?:written )?permission is prohibited
proprietary | agreement | end user licen[cs]e agreement
proprietary | commercial | (?:a )?commercial licen[cs]e is required
non-commercial | commercial, noncommercial | (?:for )?non ?commercial (?:use|purposes) only
non-commercial | commercial | not (?:be used )?for (?:any )?commercial (?:use|purposes)
no-derivatives | derivative | no derivative works (?:are )?(?:allowed|permitted)
attribution | attribution | attribution (?:is )?required
research-only | academic, research, educational | (?:for )?(?:academic |research |educational )(?:and \S+ )?(?:use|purposes) only
no-ai-training | train, training | (?:may|must|shall) not be used (?:for|to) (?:the )?train(?:ing)?
open-source | open | (?:is|as) (?:free and )?open source software
copyright | copyright | copyright (?:c )?(?:19|20)[0-9][0-9]
copyright | copyrighted | (?:this|the) (?:work|material|text|article|document) is copyrighted
copyright | reserved | some rights reserved
license-link | license, licence, copying | see (?:the )?(?:file )?(?:license|licence|copying)(?: (?:txt|md|file))? for (?:details|more information|the full (?:text|license))
license-link | opensource | opensource org licenses
license-link | gnu | gnu org licenses
license-link | apache | apache org licenses
"""

_GRANT = r"(?:licen[cs]ed|released|distributed|available|published|provided|redistributed|covered|offered|shared|dual licen[cs]ed)(?: \S+){0,2} under (?:the |a )?(?:terms (?:and conditions )?of (?:the |a )?)?"
_OR_LATER = r"(?: or (?:any |at your option any )?later(?: version)?| only)?"


class Rule:
    """A signature: what it finds, its place in the order, the words that gate it and how sure a find is."""

    def __init__(self, label: str, priority: int, gates: frozenset[bytes], pattern: str, confidence: float):
        self.label, self.priority, self.gates, self.confidence = label, priority, gates, confidence
        self.pattern = re.compile(b"(?<= )" + pattern.encode() + b"(?= )")


def _gates(name: str) -> frozenset[bytes]:
    """Words one of which any match of a name has to hold: the first word of each of its alternatives."""
    body, out = name, set()
    m = re.match(r"\(\?:((?:[^()]|\([^()]*\))*)\)(\??)", body)
    if m and not m[2]:
        alternatives = re.split(r"\|(?![^()]*\))", m[1])
    elif m:
        alternatives = [body[m.end() :]]
        return frozenset().union(*(_gates(x) for x in alternatives))
    else:
        alternatives = [body]
    for x in alternatives:
        inner = re.match(r"\(\?:((?:[^()]|\([^()]*\))*)\)", x)
        out.update(_gates(x) if inner else {re.match(r"[a-z0-9]+", x)[0].encode()})
    return frozenset(out)


def rules() -> list[Rule]:
    """The signatures in order of priority: tags, grants, titles, a licence's own text, bare names."""
    out = []
    for line in NAMES.strip().splitlines():
        label, spdx, name = (x.strip() for x in line.split(" | ", 2))
        proof, label = label.startswith("!"), label.lstrip("!")
        gates = _gates(name)
        out.append(Rule(label, 1, frozenset({b"spdx"}), f"spdx licen[cs]e identifier {spdx}(?: only| or later)?", 0.99))
        out.append(Rule(label, 2, gates, f"{_GRANT}{name}{_OR_LATER}(?: licen[cs]es?)?", 0.95))
        out.append(Rule(label, 3, gates, f"(?:the )?{name} licen[cs]e{_OR_LATER}", 0.85))
        if proof:
            out.append(Rule(label, 5, gates, f"{name}{_OR_LATER}", 0.6))
    for line in TEXTS.strip().splitlines():
        label, gates, text = (x.strip() for x in line.split(" | ", 2))
        out.append(Rule(label, 4, frozenset(w.encode() for w in gates.split(", ")), text, 0.7))
    return sorted(out, key=lambda r: r.priority)


#: Words of the contract: everything but control characters, blanks and ASCII punctuation; A-Z lower-cased.
_LINE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BASE = [(b" " + phrase.encode() + b" ", len(phrase.split()), label) for phrase, label in BASE.items()]

SPAN = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("confidence", pa.float64()), ("rule", pa.int32())]))
FOUND = "doc_id bigint, n_words bigint, base {0}, finds {0}".format("array<struct<label: string, first_word: bigint, last_word: bigint, confidence: double, rule: int>>")


def find_all(text: bytes, signatures: list[Rule], gate_words: frozenset[bytes]) -> tuple[int, list[dict], list[dict]]:
    """Number of words, places of base phrases, and what is left of the rules' finds."""
    words = text.translate(_LINE).split()
    line = b" " + b" ".join(words) + b" "
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    base = []
    for needle, n, label in _BASE:
        at = line.find(needle)
        while at >= 0:
            first = int(np.searchsorted(blanks, at))
            base.append({"label": label, "first_word": first, "last_word": first + n - 1, "confidence": 0.9, "rule": -1})
            at = line.find(needle, at + 1)
    there = gate_words.intersection(words)
    raw = []
    if there:
        for k, rule in enumerate(signatures):
            if rule.gates & there:
                for m in rule.pattern.finditer(line):
                    first, end = np.searchsorted(blanks, m.span()).tolist()
                    raw.append((rule.priority, m.start() - m.end(), first - 1, k, end - 1))
    return len(words), base, resolve(base, raw, signatures)


def resolve(base: list[dict], raw: list[tuple], signatures: list[Rule]) -> list[dict]:
    """Base places, then finds by priority, length and place that lie inside nothing kept before them.

    A find lies inside a kept one if the furthest end of those that begin no later is not before its own: a tree of maxima over the
    places where finds begin gives that end.
    """
    kept = list(base)
    begins = sorted({x["first_word"] for x in base} | {x[2] for x in raw})
    place = {first: i for i, first in enumerate(begins, 1)}
    furthest = [-1] * (len(begins) + 1)

    def holds(first: int, last: int) -> bool:
        i = place[first]
        while i and furthest[i] < last:
            i &= i - 1
        return i > 0

    def keep(first: int, last: int) -> None:
        i = place[first]
        while i < len(furthest):
            furthest[i] = max(furthest[i], last)
            i += i & -i

    for x in base:
        keep(x["first_word"], x["last_word"])
    for _, _, first, k, last in sorted(raw):
        if not holds(first, last):
            keep(first, last)
            kept.append({"label": signatures[k].label, "first_word": first, "last_word": last, "confidence": signatures[k].confidence, "rule": k})
    return kept


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    signatures = rules()
    gate_words = frozenset().union(*(r.gates for r in signatures))
    for batch in batches:
        found = [find_all(t or b"", signatures, gate_words) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], SPAN), pa.array([x[2] for x in found], SPAN)],
            names=["doc_id", "n_words", "base", "finds"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, base, finds) of every document: places of base phrases, and those places with all finds of rules that stay."""
    small_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(_scan, FOUND)
