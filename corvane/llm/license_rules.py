"""The signature rules of the license scan, in order of writing.

A hand-written rule is a line ``label | priority | key | pattern``. The text is lower case (A-Z only). In a pattern a blank stands for up
to 40 characters that are neither letters nor digits, so that line ends and comment marks do not matter; everything else is
a regular expression over bytes. Every match of a pattern contains each word of the rule's key, which is what the prefilter
looks for. A match must not touch a letter or digit on either side.

Priorities: 90 tags and fields that name an identifier; 80 sentences of a license text or notice; 70 a name with a version; 60 a
name; 50 an address; 30 wording that only says that some license applies.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Share of trust in a detection of each priority.
TRUST = {90: 1.0, 80: 0.95, 70: 0.9, 60: 0.8, 50: 0.75, 30: 0.3}

HAND_WRITTEN = r"""
gpl | 60 | general public license | gnu general public license
gpl | 60 | gnu gpl | gnu gpl
gpl | 80 | free software foundation | under the terms of the gnu general public license as published by the free software foundation
gpl | 80 | preamble the licenses | gnu general public license(?: version [123])?.{0,200}preamble the licenses for most software
gpl-1.0 | 70 | general public license | gnu general public license,? (?:version|v) ?1(?:\.0)?
gpl-2.0 | 70 | general public license | gnu general public license,? (?:version|v) ?2(?:\.0)?
gpl-3.0 | 70 | general public license | gnu general public license,? (?:version|v) ?3(?:\.0)?
gpl-2.0 | 70 | gpl | (?:gnu )?gpl ?(?:version|v)? ?2(?:\.0)?(?: only)?
gpl-3.0 | 70 | gpl | (?:gnu )?gpl ?(?:version|v)? ?3(?:\.0)?(?: only)?
gpl-2.0+ | 80 | general public license | gnu general public license.{0,120}either version 2 of the license or (?:\(at your option\) |at your option )?any later version
gpl-3.0+ | 80 | general public license | gnu general public license.{0,120}either version 3 of the license or (?:\(at your option\) |at your option )?any later version
gpl-2.0+ | 70 | gpl | (?:gnu )?gpl ?(?:version|v)? ?2(?:\.0)? or (?:any )?later
gpl-3.0+ | 70 | gpl | (?:gnu )?gpl ?(?:version|v)? ?3(?:\.0)? or (?:any )?later
gpl | 50 | gnu.org/ | (?:www\.)?gnu\.org/(?:licenses/gpl(?:\.html|\.txt)?|copyleft/gpl\.html)
gpl-2.0 | 50 | gnu.org/ | (?:www\.)?gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0(?:\.html|\.txt|\.en\.html)?
gpl-3.0 | 50 | gnu.org/ | (?:www\.)?gnu\.org/licenses/gpl-3\.0(?:\.html|\.txt|\.en\.html)?
gpl-2.0 | 50 | opensource.org/ | opensource\.org/licenses/gpl-2\.0(?:\.php)?
gpl-3.0 | 50 | opensource.org/ | opensource\.org/licenses/gpl-3\.0(?:\.php)?
gpl-classpath-exception | 80 | classpath | as a special exception.{0,200}classpath exception
gpl-classpath-exception | 70 | classpath exception | (?:gnu )?(?:gpl|general public license).{0,40}classpath exception
gcc-exception | 70 | runtime library exception | gcc runtime library exception,? (?:version )?3\.1
lgpl | 60 | lesser general public license | gnu lesser general public license
lgpl | 60 | library general public license | gnu library general public license
lgpl | 60 | gnu lgpl | gnu lgpl
lgpl-2.0 | 70 | library general public license | gnu library general public license,? (?:version|v) ?2(?:\.0)?
lgpl-2.1 | 70 | lesser general public license | gnu lesser general public license,? (?:version|v) ?2\.1
lgpl-3.0 | 70 | lesser general public license | gnu lesser general public license,? (?:version|v) ?3(?:\.0)?
lgpl-2.1 | 70 | lgpl | (?:gnu )?lgpl ?(?:version|v)? ?2\.1
lgpl-3.0 | 70 | lgpl | (?:gnu )?lgpl ?(?:version|v)? ?3(?:\.0)?
lgpl-2.1+ | 80 | lesser general public license | gnu lesser general public license.{0,120}either version 2\.1 of the license or (?:\(at your option\) |at your option )?any later version
lgpl-3.0+ | 80 | lesser general public license | gnu lesser general public license.{0,120}either version 3 of the license or (?:\(at your option\) |at your option )?any later version
lgpl | 50 | gnu.org/ | (?:www\.)?gnu\.org/licenses/lgpl(?:\.html|\.txt)?
lgpl-2.1 | 50 | gnu.org/ | (?:www\.)?gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1(?:\.html|\.txt)?
lgpl-3.0 | 50 | gnu.org/ | (?:www\.)?gnu\.org/licenses/lgpl-3\.0(?:\.html|\.txt)?
agpl | 60 | affero general public license | (?:gnu )?affero general public license
agpl-1.0 | 70 | affero general public license | affero general public license,? (?:version|v) ?1(?:\.0)?
agpl-3.0 | 70 | affero general public license | (?:gnu )?affero general public license,? (?:version|v) ?3(?:\.0)?
agpl-3.0 | 70 | agpl | (?:gnu )?agpl ?(?:version|v)? ?3(?:\.0)?
agpl-3.0+ | 80 | affero general public license | gnu affero general public license.{0,120}either version 3 of the license or (?:\(at your option\) |at your option )?any later version
agpl-3.0 | 50 | gnu.org/ | (?:www\.)?gnu\.org/licenses/agpl(?:-3\.0)?(?:\.html|\.txt)?
gfdl | 60 | free documentation license | gnu free documentation license
gfdl-1.1 | 70 | free documentation license | gnu free documentation license,? (?:version|v) ?1\.1
gfdl-1.2 | 70 | free documentation license | gnu free documentation license,? (?:version|v) ?1\.2
gfdl-1.3 | 70 | free documentation license | gnu free documentation license,? (?:version|v) ?1\.3
gfdl | 80 | back-cover texts | with no invariant sections,? no front-cover texts,? and no back-cover texts
gfdl | 50 | gnu.org/ | (?:www\.)?gnu\.org/licenses/fdl(?:-1\.[123])?(?:\.html|\.txt)?
apache | 60 | apache license | apache license
apache | 60 | apache software license | apache software license
apache-1.0 | 70 | apache | apache (?:software )?license,? (?:version|v) ?1\.0
apache-1.1 | 70 | apache | apache (?:software )?license,? (?:version|v) ?1\.1
apache-2.0 | 70 | apache | apache (?:software )?license,? (?:version |v ?)?2(?:\.0)?
apache-2.0 | 80 | you may not use this file except | licensed under the apache license,? version 2\.0.{0,60}you may not use this file except in compliance with the license
apache-2.0 | 80 | terms and conditions for use | apache license version 2\.0,? january 2004.{0,80}terms and conditions for use,? reproduction,? and distribution
apache-1.1 | 80 | apache software foundation | this product includes software developed by the apache software foundation
apache-2.0 | 50 | apache.org/licenses | (?:www\.)?apache\.org/licenses/license-2\.0(?:\.html|\.txt)?
apache-2.0 | 50 | opensource.org/ | opensource\.org/licenses/apache-2\.0
apache-llvm | 70 | llvm exception | apache (?:license,? )?(?:version |v ?)?2\.0 with llvm exceptions?
mit | 60 | mit license | (?:the )?mit license
mit | 60 | expat license | expat license
mit | 60 | mit licence | (?:the )?mit licence
mit | 70 | mit licensed | mit licensed
mit | 80 | permission is hereby granted | permission is hereby granted,? free of charge,? to any person obtaining a copy of this software and associated documentation files
mit | 80 | included in all copies or substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 50 | opensource.org/ | opensource\.org/licenses/mit(?:-license)?(?:\.php)?
mit-0 | 70 | mit no attribution | mit no attribution(?: license)?
x11 | 60 | x11 license | (?:the )?x11 license
x11 | 80 | x consortium | except as contained in this notice,? the name of the x consortium shall not be used in advertising
isc | 60 | isc license | (?:the )?isc license
isc | 80 | to use, copy, modify, and/or distribute | permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted
isc | 50 | opensource.org/ | opensource\.org/licenses/isc(?:-license\.txt)?
bsd | 60 | bsd license | (?:the )?bsd license
bsd | 60 | bsd-style license | bsd-style license
bsd | 80 | redistribution and use in source and binary | redistribution and use in source and binary forms,? with or without modification,? are permitted
bsd-0-clause | 70 | zero-clause bsd | zero-clause bsd(?: license)?
bsd-1-clause | 70 | bsd 1-clause | bsd 1-clause(?: license)?
bsd-2-clause | 70 | bsd | (?:bsd 2-clause|2-clause bsd|two-clause bsd|simplified bsd|freebsd)(?: license)
bsd-3-clause | 70 | bsd | (?:bsd 3-clause|3-clause bsd|three-clause bsd|new bsd|modified bsd|revised bsd)(?: license)
bsd-4-clause | 70 | bsd | (?:bsd 4-clause|4-clause bsd|four-clause bsd|original bsd|old bsd)(?: license)
bsd-3-clause | 80 | may be used to endorse or promote | neither the name of .{1,120}may be used to endorse or promote products derived from this software
bsd-4-clause | 80 | must display the following acknowledg | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause-clear | 70 | clear bsd | (?:the )?clear bsd license
bsd-2-clause | 50 | opensource.org/ | opensource\.org/licenses/bsd-2-clause
bsd-3-clause | 50 | opensource.org/ | opensource\.org/licenses/(?:bsd-3-clause|bsd-license(?:\.php)?)
mpl | 60 | mozilla public license | mozilla public license
mpl-1.0 | 70 | mozilla public license | mozilla public license,? (?:version|v) ?1\.0
mpl-1.1 | 70 | mozilla public license | mozilla public license,? (?:version|v) ?1\.1
mpl-2.0 | 70 | mozilla public license | mozilla public license,? (?:version |v ?|v\. ?)?2\.0
mpl-2.0 | 80 | subject to the terms of the mozilla | this source code form is subject to the terms of the mozilla public license,? v\. 2\.0
mpl-2.0 | 50 | mozilla.org/ | (?:www\.)?mozilla\.org/(?:en-us/)?mpl/2\.0/?
mpl-1.1 | 50 | mozilla.org/ | (?:www\.)?mozilla\.org/mpl/(?:mpl-1\.1\.html)?
epl | 60 | eclipse public license | eclipse public license
epl-1.0 | 70 | eclipse public license | eclipse public license,? (?:version |v ?|- ?v ?)?1\.0
epl-2.0 | 70 | eclipse public license | eclipse public license,? (?:version |v ?|- ?v ?)?2\.0
epl-1.0 | 50 | eclipse.org/legal | (?:www\.)?eclipse\.org/legal/epl-v10(?:\.html)?
epl-2.0 | 50 | eclipse.org/legal | (?:www\.)?eclipse\.org/legal/epl-(?:2\.0|v20(?:\.html)?)
edl-1.0 | 70 | eclipse distribution license | eclipse distribution license,? (?:version |v ?|- ?v ?)?1\.0
cddl | 60 | common development and distribution | common development and distribution license
cddl-1.0 | 70 | cddl | cddl(?: license)?,? (?:version |v ?)?1\.0
cddl-1.0 | 70 | common development and distribution | common development and distribution license(?: \(cddl\))?,? (?:version |v ?)?1\.0
cddl-1.1 | 70 | common development and distribution | common development and distribution license(?: \(cddl\))?,? (?:version |v ?)?1\.1
cpl-1.0 | 70 | common public license | common public license,? (?:version |v ?)?1\.0
ipl-1.0 | 70 | ibm public license | ibm public license,? (?:version |v ?)?1\.0
eupl | 60 | european union public licen | european union public licen[cs]e
eupl-1.1 | 70 | european union public licen | european union public licen[cs]e,? (?:version |v ?|v\. ?)?1\.1
eupl-1.2 | 70 | european union public licen | european union public licen[cs]e,? (?:version |v ?|v\. ?)?1\.2
cecill | 60 | cecill | cecill(?: free software)? license(?: agreement)?
cecill-2.1 | 70 | cecill | cecill(?: license)?,? (?:version |v ?)?2\.1
cecill-b | 70 | cecill-b | cecill-b(?: license)?
cecill-c | 70 | cecill-c | cecill-c(?: license)?
artistic | 60 | artistic license | (?:the )?(?:perl )?artistic license
artistic-1.0 | 70 | artistic license | (?:the )?(?:perl )?artistic license,? (?:version |v ?)?1(?:\.0)?
artistic-2.0 | 70 | artistic license | (?:the )?artistic license,? (?:version |v ?)?2(?:\.0)?
perl | 80 | same terms as perl | under the same terms as perl itself
zlib | 60 | zlib license | (?:the )?zlib license
zlib | 80 | 'as-is', without any express | this software is provided 'as-is', without any express or implied warranty
zlib | 80 | must not be misrepresented | the origin of this software must not be misrepresented
libpng | 60 | libpng license | (?:the )?libpng license
boost-1.0 | 70 | boost software license | boost software license(?:,? (?:version|v) ?1\.0)?
boost-1.0 | 50 | boost.org/ | (?:www\.)?boost\.org/license_1_0\.txt
psf | 60 | python software foundation license | python software foundation license(?:,? (?:version|v) ?2)?
ruby | 60 | ruby license | (?:the )?ruby license
ruby | 80 | same terms as ruby | under the same terms as ruby
php-3.0 | 70 | php license | php license,? (?:version |v ?)?3\.0
php-3.01 | 70 | php license | php license,? (?:version |v ?)?3\.01
php | 60 | php license | (?:the )?php license
w3c | 60 | w3c software | w3c software (?:notice and )?(?:and document )?license
wtfpl | 60 | do what the fuck you want | do what the fuck you want to public license
wtfpl | 60 | wtfpl | wtfpl
unlicense | 60 | the unlicense | the unlicense
unlicense | 80 | released into the public domain | this is free and unencumbered software released into the public domain
unlicense | 50 | unlicense.org | (?:www\.)?unlicense\.org
public-domain | 60 | public domain | (?:is |are |placed |released |dedicated )(?:in|into|to) the public domain
public-domain | 60 | public domain dedication | public domain dedication
cc0-1.0 | 60 | cc0 | cc0(?: 1\.0)?(?: universal)?
cc0-1.0 | 50 | creativecommons.org/ | creativecommons\.org/publicdomain/zero/1\.0/?
cc-pdm-1.0 | 50 | creativecommons.org/ | creativecommons\.org/publicdomain/mark/1\.0/?
cc | 60 | creative commons | creative commons licen[cs]e
cc-by | 60 | creative commons attribution | creative commons attribution(?: licen[cs]e)?
cc-by | 60 | cc by | cc by
cc-by-sa | 60 | sharealike | creative commons attribution sharealike(?: licen[cs]e)?
cc-by-nd | 60 | noderiv | creative commons attribution noderiv(?:ative)?s?(?: works?)?(?: licen[cs]e)?
cc-by-nc | 60 | noncommercial | creative commons attribution noncommercial(?: licen[cs]e)?
cc-by-nc-sa | 60 | noncommercial sharealike | creative commons attribution noncommercial sharealike(?: licen[cs]e)?
cc-by-nc-sa | 60 | noncommercial-sharealike | creative commons attribution noncommercial-sharealike(?: licen[cs]e)?
cc-by-nc-nd | 60 | noderiv | creative commons attribution noncommercial noderiv(?:ative)?s?(?: works?)?(?: licen[cs]e)?
odbl-1.0 | 60 | open database license | open database license(?:,? (?:version |v ?)?1\.0)?
odbl-1.0 | 50 | opendatacommons.org/ | (?:www\.)?opendatacommons\.org/licenses/odbl(?:/1\.0)?/?
odc-by-1.0 | 60 | open data commons attribution | open data commons attribution license(?:,? (?:version |v ?)?1\.0)?
odc-by-1.0 | 50 | opendatacommons.org/ | (?:www\.)?opendatacommons\.org/licenses/by(?:/1\.0)?/?
pddl-1.0 | 60 | public domain dedication and | (?:open data commons )?public domain dedication and licen[cs]e
ogl-uk | 60 | open government licen | open government licen[cs]e(?:,? (?:version |v ?)?[123](?:\.0)?)?
cdla-permissive | 60 | community data license | community data license agreement permissive(?:,? (?:version |v ?)?[12]\.0)?
ofl-1.0 | 70 | sil open font license | sil open font license,? (?:version |v ?)?1\.0
ofl-1.1 | 70 | open font license | (?:sil )?open font license,? (?:version |v ?)?1\.1
ofl | 60 | open font license | (?:sil )?open font license
ofl-1.1 | 50 | scripts.sil.org/ | scripts\.sil\.org/ofl
ms-pl | 60 | microsoft public license | microsoft public license(?: \(ms-pl\))?
ms-rl | 60 | microsoft reciprocal license | microsoft reciprocal license(?: \(ms-rl\))?
apsl-2.0 | 70 | apple public source license | apple public source license,? (?:version |v ?)?2\.0
nasa-1.3 | 70 | nasa open source agreement | nasa open source agreement,? (?:version |v ?)?1\.3
ncsa | 60 | illinois/ncsa | university of illinois/ncsa open source license
postgresql | 60 | postgresql license | (?:the )?postgresql licen[cs]e
openssl | 60 | openssl license | (?:the )?openssl license
openssl | 80 | for use in the openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
sleepycat | 60 | sleepycat | sleepycat (?:software )?(?:public )?license
json | 80 | shall be used for good | the software shall be used for good,? not evil
beerware | 80 | buy me a beer | you can buy me a beer in return
beerware | 60 | beer-ware license | the beer-ware license(?: \(?revision 42\)?)?
upl-1.0 | 60 | universal permissive license | universal permissive license(?:,? (?:version |v ?)?1\.0)?
vim | 60 | vim license | (?:the )?vim license
zpl-2.1 | 70 | zope public license | zope public license(?: \(zpl\))?,? (?:version |v ?)?2\.1
qpl-1.0 | 70 | q public license | (?:the )?q public license,? (?:version |v ?)?1\.0
lppl-1.3c | 70 | latex project public license | latex project public license,? (?:version |v ?)?1\.3c?
lppl | 60 | latex project public license | latex project public license
osl-3.0 | 70 | open software license | open software license,? (?:version |v ?|v\. ?)?3\.0
afl-3.0 | 70 | academic free license | academic free license,? (?:version |v ?|v\. ?)?3\.0
ecl-2.0 | 70 | educational community license | educational community license,? (?:version |v ?)?2\.0
busl-1.1 | 70 | business source license | business source license,? (?:version |v ?)?1\.1
sspl-1.0 | 60 | server side public license | server side public license(?:,? (?:version |v ?)?1(?:\.0)?)?
elastic-2.0 | 60 | elastic license | elastic license,? (?:version |v ?)?2(?:\.0)?
polyform-noncommercial | 70 | polyform noncommercial | polyform noncommercial license,? (?:version |v ?)?1\.0\.0
polyform-small-business | 70 | polyform small business | polyform small business license,? (?:version |v ?)?1\.0\.0
commons-clause | 60 | commons clause | commons clause(?: license condition)?(?:,? v ?1\.0)?
openrail | 60 | openrail | (?:creativeml |bigscience )?openrail(?:-m|\+\+-m)?(?: license)?
ijg | 80 | independent jpeg group | this software is based in part on the work of the independent jpeg group
curl | 60 | curl license | (?:the )?curl license
tcl | 60 | tcl/tk license | tcl/tk license
unicode | 60 | unicode license | unicode license(?: agreement)?
icu | 60 | icu license | icu license
hpnd | 60 | historical permission notice | historical permission notice and disclaimer
mulan-2.0 | 70 | mulan psl | mulan psl ?v ?2
mulan-2.0 | 60 | mulan permissive software license | mulan permissive software license,? (?:version |v ?)?2
blueoak-1.0.0 | 70 | blue oak model license | blue oak model license(?: 1\.0\.0)?
fair | 60 | fair license | (?:the )?fair license
naist-2003 | 60 | naist-2003 | naist-2003 license
proprietary | 60 | proprietary and confidential | proprietary and confidential
proprietary | 80 | unauthorized copying of this file | unauthorized copying of this file,? via any medium is strictly prohibited
all-rights-reserved | 60 | all rights reserved | copyright .{0,120}all rights reserved
some-license | 30 | licensed under | licensed under the .{1,60}licen[cs]e
some-license | 30 | released under | released under the .{1,60}licen[cs]e
some-license | 30 | see the license file | see the license file for (?:details|more information|copyright)
"""

#: Identifiers whose tags, metadata fields and sentences are recognised by the rules that ``written`` makes of them.
IDENTIFIERS = """
0bsd afl-1.1 afl-1.2 afl-2.0 afl-2.1 afl-3.0 agpl-1.0 agpl-3.0 apache-1.0 apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0
blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 busl-1.1 cc0-1.0 cddl-1.0
cddl-1.1 cecill-2.1 cecill-b cecill-c cpl-1.0 ecl-2.0 elastic-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.1 gfdl-1.2 gfdl-1.3 gpl-1.0
gpl-2.0 gpl-3.0 isc lgpl-2.0 lgpl-2.1 lgpl-3.0 lppl-1.3c mit mit-0 mpl-1.0 mpl-1.1 mpl-2.0 ms-pl ms-rl ncsa odbl-1.0 odc-by-1.0 ofl-1.0
ofl-1.1 openssl osl-3.0 php-3.0 php-3.01 postgresql psf-2.0 qpl-1.0 ruby sspl-1.0 unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1
""".split()
#: Creative Commons licenses: parts and versions, combined by ``written``.
PARTS, VERSIONS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"), ("1.0", "2.0", "2.5", "3.0", "4.0")


class Rule(NamedTuple):
    label: str
    priority: int
    key: tuple[str, ...]
    pattern: re.Pattern[bytes]


def compiled(pattern: str) -> re.Pattern[bytes]:
    gap = r"[^0-9a-z\x80-\xff]{1,40}"
    return re.compile(rf"(?<![0-9a-z\x80-\xff])(?:{pattern.replace(' ?', '[^0-9a-z\x80-\xff]{0,40}').replace(' ', gap)})(?![0-9a-z\x80-\xff])".encode("latin-1"), re.S)


def written() -> list[Rule]:
    """All rules: the hand-written ones, then those of identifiers, in order."""
    rows = [tuple(x.strip() for x in line.split(" | ")) for line in HAND_WRITTEN.strip().splitlines()]
    for name in [*IDENTIFIERS, *(f"cc-{p}-{v}" for p in PARTS for v in VERSIONS)]:
        exact = re.escape(name) + r"(?:-only)?"
        later = re.escape(name) + r"(?:-or-later|\+)"
        rows.append((name, "90", "spdx-license-identifier", rf"spdx-license-identifier: {exact}"))
        rows.append((f"{name}+", "90", "spdx-license-identifier", rf"spdx-license-identifier: {later}"))
        rows.append((name, "90", f"licen {name}", rf"licen[cs]e[\"']?\s?[:=]\s?[\"']?{exact}"))
        rows.append((name, "70", f"under {name}", rf"(?:licensed|released|distributed|available|covered) under (?:the )?(?:terms of )?(?:the )?{exact}"))
    for p in PARTS:
        for v in VERSIONS:
            words = "creative commons attribution" + "".join({"sa": " sharealike", "nd": " noderiv(?:ative)?s?(?: works?)?", "nc": " noncommercial"}[x] for x in p.split("-")[1:])
            rows.append((f"cc-{p}-{v}", "70", "creative commons attribution", rf"{words} {re.escape(v)}"))
            rows.append((f"cc-{p}-{v}", "50", f"/licenses/{p}/{v}", rf"creativecommons\.org/licenses/{p}/{re.escape(v)}/?"))
            rows.append((f"cc-{p}-{v}", "70", f"cc {v}", rf"cc {p.replace('-', ' ')} {re.escape(v)}"))
    return [Rule(label, int(priority), tuple(key.split()), compiled(pattern)) for label, priority, key, pattern in rows]
