"""Signature rules of the license scan, in order: label | priority | keyword | pattern.

Patterns read a text's words, lower-cased and joined by single spaces, so "GPL-2.0" reads "gpl 2 0".
They begin and end at word edges. A rule runs only on texts that hold its keyword. Priority 4: an
identifier or grant that names the license, 3: words of the license's text, 2: name with version,
1: name alone. Between rules of one priority the earlier comes first.
"""

#: The base phrases: word for word, always reported.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

RULES = r"""
agpl-1.0 | 4 | spdx | spdx license identifier agpl 1 0(?: only| or later)?
agpl-3.0 | 4 | spdx | spdx license identifier agpl 3 0(?: only| or later)?
apache-1.0 | 4 | spdx | spdx license identifier apache 1 0
apache-1.1 | 4 | spdx | spdx license identifier apache 1 1
apache-2.0 | 4 | spdx | spdx license identifier apache 2 0
artistic-1.0 | 4 | spdx | spdx license identifier artistic 1 0
artistic-2.0 | 4 | spdx | spdx license identifier artistic 2 0
0bsd | 4 | spdx | spdx license identifier 0bsd
bsd-2-clause | 4 | spdx | spdx license identifier bsd 2 clause(?: patent)?
bsd-3-clause | 4 | spdx | spdx license identifier bsd 3 clause(?: clear)?
bsd-4-clause | 4 | spdx | spdx license identifier bsd 4 clause
bsl-1.0 | 4 | spdx | spdx license identifier bsl 1 0
cc0-1.0 | 4 | spdx | spdx license identifier cc0 1 0
cc-by-3.0 | 4 | spdx | spdx license identifier cc by 3 0
cc-by-4.0 | 4 | spdx | spdx license identifier cc by 4 0
cc-by-sa-3.0 | 4 | spdx | spdx license identifier cc by sa 3 0
cc-by-sa-4.0 | 4 | spdx | spdx license identifier cc by sa 4 0
cddl-1.0 | 4 | spdx | spdx license identifier cddl 1 [01]
epl-1.0 | 4 | spdx | spdx license identifier epl 1 0
epl-2.0 | 4 | spdx | spdx license identifier epl 2 0
eupl-1.1 | 4 | spdx | spdx license identifier eupl 1 1
eupl-1.2 | 4 | spdx | spdx license identifier eupl 1 2
gpl-1.0 | 4 | spdx | spdx license identifier gpl 1 0(?: only| or later)?
gpl-2.0 | 4 | spdx | spdx license identifier gpl 2 0(?: only| or later)?
gpl-3.0 | 4 | spdx | spdx license identifier gpl 3 0(?: only| or later)?
isc | 4 | spdx | spdx license identifier isc
lgpl-2.0 | 4 | spdx | spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1 | 4 | spdx | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0 | 4 | spdx | spdx license identifier lgpl 3 0(?: only| or later)?
mit | 4 | spdx | spdx license identifier mit(?: 0)?
mpl-1.1 | 4 | spdx | spdx license identifier mpl 1 1
mpl-2.0 | 4 | spdx | spdx license identifier mpl 2 0
ms-pl | 4 | spdx | spdx license identifier ms pl
ofl-1.1 | 4 | spdx | spdx license identifier ofl 1 1
python-2.0 | 4 | spdx | spdx license identifier p(?:sf|ython) 2 0
unlicense | 4 | spdx | spdx license identifier unlicense
wtfpl | 4 | spdx | spdx license identifier wtfpl
zlib | 4 | spdx | spdx license identifier zlib
other-spdx | 2 | spdx | spdx license identifier \S+
agpl-3.0 | 4 | affero | under the terms of the gnu affero general public license(?: as published by the free software foundation)?(?: either)? version 3
agpl-1.0 | 2 | affero | affero general public license(?: version| v)? 1
agpl-3.0 | 2 | affero | (?:gnu )?affero general public license(?: version| v)? 3(?: 0)?
agpl-3.0 | 2 | agplv3 | agplv3
agpl-3.0 | 2 | agpl | agpl(?: v)? 3(?: 0)?
agpl | 1 | affero | (?:gnu )?affero general public license
agpl | 1 | agpl | agpl
lgpl-2.1 | 4 | lesser | under the terms of the gnu lesser general public license(?: as published by the free software foundation)?(?: either)? version 2 1
lgpl-3.0 | 4 | lesser | under the terms of the gnu lesser general public license(?: as published by the free software foundation)?(?: either)? version 3
lgpl-2.0 | 4 | library | under the terms of the gnu library general public license(?: as published by the free software foundation)?(?: either)? version 2
lgpl-2.0 | 2 | library | gnu library general public license(?: version| v)? 2(?: 0)?
lgpl-2.1 | 2 | lesser | (?:gnu )?lesser general public license(?: version| v)? 2 1
lgpl-3.0 | 2 | lesser | (?:gnu )?lesser general public license(?: version| v)? 3(?: 0)?
lgpl-2.1 | 2 | lgplv2 | lgplv2 1
lgpl-3.0 | 2 | lgplv3 | lgplv3
lgpl-2.1 | 2 | lgpl | lgpl(?: v)? 2 1
lgpl-3.0 | 2 | lgpl | lgpl(?: v)? 3(?: 0)?
lgpl | 1 | lesser | (?:gnu )?lesser general public license
lgpl | 1 | library | gnu library general public license
lgpl | 1 | lgpl | lgpl
gpl-2.0 | 4 | gnu | under the terms of the gnu general public license as published by the free software foundation (?:either )?version 2
gpl-3.0 | 4 | gnu | under the terms of the gnu general public license as published by the free software foundation (?:either )?version 3
gpl | 3 | gnu | you should have received a copy of the gnu general public license along with this program
gpl | 3 | merchantability | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
gpl-1.0 | 2 | gnu | gnu general public license(?: version| v)? 1(?: 0)?
gpl-2.0 | 2 | gnu | gnu general public license(?: version| v)? 2(?: 0)?
gpl-3.0 | 2 | gnu | gnu general public license(?: version| v)? 3(?: 0)?
gpl-2.0-or-later | 2 | gnu | gnu general public license(?: version| v)? 2(?: 0)? or(?: at your option)?(?: any)? later(?: version)?
gpl-3.0-or-later | 2 | gnu | gnu general public license(?: version| v)? 3(?: 0)? or(?: at your option)?(?: any)? later(?: version)?
gpl-2.0 | 2 | gpl | (?:gnu )?gpl(?: version| v)? 2(?: 0)?
gpl-3.0 | 2 | gpl | (?:gnu )?gpl(?: version| v)? 3(?: 0)?
gpl-2.0 | 2 | gplv2 | gplv2
gpl-3.0 | 2 | gplv3 | gplv3
gpl | 1 | gpl | (?:gnu )?gpl
gpl | 1 | gnu | gnu public license
gfdl-1.3 | 2 | documentation | gnu free documentation license(?: version| v)? 1 3
gfdl-1.2 | 2 | documentation | gnu free documentation license(?: version| v)? 1 2
gfdl | 1 | documentation | gnu free documentation license
gfdl | 1 | gfdl | gfdl
classpath-exception | 3 | classpath | classpath exception(?: 2 0)?
gcc-exception | 3 | gcc | gcc runtime library exception(?: 3 1)?
apache-2.0 | 4 | apache | licensed under the apache license version 2 0
apache-2.0 | 3 | apache | you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0
apache-2.0 | 3 | warranties | distributed on an as is basis without warranties or conditions of any kind
apache-2.0 | 2 | apache | apache(?: software)? license(?: version| v)? 2(?: 0)?
apache-1.1 | 2 | apache | apache(?: software)? license(?: version| v)? 1 1
apache-1.0 | 2 | apache | apache(?: software)? license(?: version| v)? 1 0
apache-2.0 | 2 | apache | www apache org licenses license 2 0
apache-2.0 | 2 | apache2 | apache2
apache-2.0 | 2 | asl | asl 2 0
apache | 1 | apache | apache software license
apache | 1 | apache | apache licen[cs]ed?
mit | 4 | mit | (?:released|licensed|distributed|available) under the(?: terms of the)? mit licen[cs]e
mit | 3 | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 3 | substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | 2 | mit | mit no attribution(?: license)?
mit | 2 | expat | expat licen[cs]e
mit-cmu | 2 | cmu | cmu licen[cs]e
x11 | 2 | x11 | (?:mit )?x11 licen[cs]e
mit | 1 | mit | mit licen[cs]ed?
mit | 1 | mit | licen[cs]e mit
bsd-2-clause | 4 | bsd | licensed under the(?: simplified)? bsd 2 clause licen[cs]e
bsd-3-clause | 4 | bsd | licensed under the(?: new| revised| modified)? bsd 3 clause licen[cs]e
bsd | 3 | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | 3 | redistributions | redistributions of source code must retain the above copyright notice
bsd-3-clause | 3 | endorse | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | 3 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-clause | 2 | bsd | (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd bsd)(?: licen[cs]e)?
bsd-3-clause | 2 | bsd | (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?
bsd-4-clause | 2 | bsd | (?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[cs]e)?
0bsd | 2 | bsd | zero clause bsd(?: licen[cs]e)?
0bsd | 2 | 0bsd | 0bsd
bsd | 1 | bsd | bsd(?: style)? licen[cs]ed?
bsd | 1 | bsd | licensed under(?: the)? bsd
isc | 3 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 2 | isc | (?:released under the )?isc licen[cs]e
mpl-2.0 | 4 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | 4 | mozilla | subject to the mozilla public license version 1 1
mpl-2.0 | 2 | mozilla | mozilla public license(?: version| v)? 2(?: 0)?
mpl-1.1 | 2 | mozilla | mozilla public license(?: version| v)? 1 1
mpl-1.0 | 2 | mozilla | mozilla public license(?: version| v)? 1 0
mpl-2.0 | 2 | mpl | mpl(?: v)? 2 0
mpl-1.1 | 2 | mpl | mpl(?: v)? 1 1
mpl | 1 | mozilla | mozilla public license
mpl | 1 | mpl | mpl licen[cs]ed?
epl-2.0 | 2 | eclipse | eclipse public license(?: version| v)? 2(?: 0)?
epl-1.0 | 2 | eclipse | eclipse public license(?: version| v)? 1 0
edl-1.0 | 2 | eclipse | eclipse distribution license(?: version| v)? 1 0
epl-1.0 | 2 | epl | epl(?: v)? 1 0
epl-2.0 | 2 | epl | epl(?: v)? 2 0
epl | 1 | eclipse | eclipse public license
cpl-1.0 | 2 | common | common public license(?: version| v)? 1 0
cddl-1.1 | 2 | cddl | cddl(?: v)? 1 1
cddl-1.0 | 2 | cddl | cddl(?: v)? 1 0
cddl-1.0 | 2 | common | common development and distribution license(?: version| v)? 1 0
cddl | 1 | common | common development and distribution license
cddl | 1 | cddl | cddl
cpal-1.0 | 2 | attribution | common public attribution license(?: version| v)? 1 0
osl-3.0 | 2 | open | open software license(?: version| v)? 3 0
osl | 1 | open | open software license
afl-3.0 | 2 | academic | academic free license(?: version| v)? 3 0
afl | 1 | academic | academic free license
artistic-2.0 | 2 | artistic | artistic license(?: version| v)? 2(?: 0)?
artistic-1.0 | 2 | artistic | artistic license(?: version| v)? 1(?: 0)?
artistic | 1 | artistic | artistic license
perl | 2 | perl | same terms as perl(?: itself)?
bsl-1.0 | 3 | boost | distributed under the boost software license(?: version| v)? 1 0
bsl-1.0 | 2 | boost | boost software license(?: version| v)?(?: 1 0)?
busl-1.1 | 2 | business | business source license(?: version| v)?(?: 1 1)?
sspl-1.0 | 2 | server | server side public license(?: version| v)?(?: 1)?
elastic-2.0 | 2 | elastic | elastic license(?: version| v)?(?: 2 0)?
commons-clause | 3 | clause | commons clause(?: license condition)?
zlib | 3 | origin | the origin of this software must not be misrepresented
zlib | 2 | zlib | zlib(?: libpng)? licen[cs]e
libpng | 2 | libpng | libpng licen[cs]e
openssl | 2 | openssl | openssl licen[cs]e
openssl | 3 | openssl | this product includes software developed by the openssl project
curl | 2 | curl | curl licen[cs]e
ijg | 3 | jpeg | this software is based in part on the work of the independent jpeg group
freetype | 2 | freetype | freetype(?: project)? licen[cs]e
icu | 2 | icu | icu licen[cs]e
unicode | 2 | unicode | unicode licen[cs]e(?: v3)?
unicode | 2 | unicode | unicode inc license agreement
php-3.01 | 2 | php | php license(?: version| v)?(?: 3 01)?
python-2.0 | 2 | python | python software foundation license(?: version| v)?(?: 2)?
python-2.0 | 2 | psf | psf license agreement(?: for python)?
ruby | 2 | ruby | ruby(?: s)? licen[cs]e
tcl | 2 | tcl | tcl(?: tk)? licen[cs]e
lua | 2 | lua | lua licen[cs]e
vim | 2 | vim | vim licen[cs]e
w3c | 2 | w3c | w3c software(?: and document)?(?: notice and)? licen[cs]e
ncsa | 2 | ncsa | ncsa(?: open source)? licen[cs]e
ncsa | 2 | illinois | university of illinois ncsa open source license
ecl-2.0 | 2 | educational | educational community license(?: version| v)? 2 0
upl-1.0 | 2 | universal | universal permissive license(?: version| v)?(?: 1 0)?
postgresql | 2 | postgresql | postgresql licen[cs]e
sleepycat | 2 | sleepycat | sleepycat licen[cs]e
qpl-1.0 | 2 | q | q public license(?: version| v)?(?: 1 0)?
zpl-2.1 | 2 | zope | zope public license(?: version| v)?(?: 2 1)?
eupl-1.2 | 2 | eupl | eupl(?: v)? 1 2
eupl-1.1 | 2 | eupl | eupl(?: v)? 1 1
eupl-1.2 | 2 | european | european union public licen[cs]e(?: version| v)? 1 2
eupl | 1 | european | european union public licen[cs]e
cecill-2.1 | 2 | cecill | cecill(?: license)?(?: version| v)? 2 1
cecill-b | 2 | cecill | cecill b
cecill-c | 2 | cecill | cecill c
cecill | 1 | cecill | cecill
ms-pl | 2 | microsoft | microsoft public license(?: ms pl)?
ms-rl | 2 | microsoft | microsoft reciprocal license(?: ms rl)?
apsl-2.0 | 2 | apple | apple public source license(?: version| v)?(?: 2 0)?
ipl-1.0 | 2 | ibm | ibm public license(?: version| v)?(?: 1 0)?
npl-1.1 | 2 | netscape | netscape public license(?: version| v)?(?: 1 1)?
sisl | 2 | sun | sun industry standards source license
nasa-1.3 | 2 | nasa | nasa open source agreement(?: version| v)?(?: 1 3)?
intel-bsd | 2 | intel | intel(?: simplified)? software license
ofl-1.1 | 3 | font | this font software is licensed under the sil open font license(?: version| v)? 1 1
ofl-1.1 | 2 | sil | sil open font license(?: version| v)?(?: 1 1)?
ofl | 1 | font | open font license
unlicense | 3 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 2 | unlicense | (?:the )?unlicense
wtfpl | 3 | fuck | do what the fuck you want to public license
wtfpl | 2 | wtfpl | wtfpl
beerware | 2 | beer | beer ware license
beerware | 2 | beerware | beerware license
json | 3 | evil | the software shall be used for good not evil
public-domain | 2 | public | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | 1 | public | public domain dedication
cc0-1.0 | 3 | cc0 | (?:cc0 1 0 universal|cc0 public domain dedication)
cc0-1.0 | 2 | cc0 | (?:cc )?cc0(?: 1 0)?
pddl-1.0 | 2 | open | open data commons public domain dedication and license
odbl-1.0 | 2 | database | open database license(?: odbl)?(?: v)?(?: 1 0)?
odc-by-1.0 | 2 | commons | open data commons attribution license(?: v)?(?: 1 0)?
cc-by-nc-nd | 2 | cc | cc by nc nd(?: [1234] [05])?(?: international| unported)?
cc-by-nc-sa | 2 | cc | cc by nc sa(?: [1234] [05])?(?: international| unported)?
cc-by-nc | 2 | cc | cc by nc(?: [1234] [05])?(?: international| unported)?
cc-by-nd | 2 | cc | cc by nd(?: [1234] [05])?(?: international| unported)?
cc-by-sa-4.0 | 3 | cc | cc by sa 4 0(?: international)?
cc-by-sa-3.0 | 3 | cc | cc by sa 3 0(?: unported)?
cc-by-sa | 2 | cc | cc by sa(?: [12] [05])?
cc-by-4.0 | 2 | cc | cc by 4 0(?: international)?
cc-by-3.0 | 2 | cc | cc by 3 0(?: unported)?
cc-by-2.0 | 2 | cc | cc by 2 [05]
cc-by-1.0 | 2 | cc | cc by 1 0
cc-by-nc-nd | 3 | commons | creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: works)?
cc-by-nc-sa | 3 | commons | creative commons attribution non ?commercial share ?alike(?: [1234] [05])?
cc-by-nc | 2 | commons | creative commons attribution non ?commercial(?: [1234] [05])?
cc-by-nd | 2 | commons | creative commons attribution no ?deriv(?:s|atives)(?: [1234] [05])?
cc-by-sa | 2 | commons | creative commons attribution share ?alike(?: [1234] [05])?
cc-by | 1 | commons | creative commons attribution(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc | 1 | commons | creative commons licen[cs]ed?
cc-by-nc-sa | 2 | creativecommons | creativecommons org licenses by nc sa(?: [1234] [05])?
cc-by-nc-nd | 2 | creativecommons | creativecommons org licenses by nc nd(?: [1234] [05])?
cc-by-nc | 2 | creativecommons | creativecommons org licenses by nc(?: [1234] [05])?
cc-by-nd | 2 | creativecommons | creativecommons org licenses by nd(?: [1234] [05])?
cc-by-sa | 2 | creativecommons | creativecommons org licenses by sa(?: [1234] [05])?
cc-by | 1 | creativecommons | creativecommons org licenses by(?: [1234] [05])?
cc0-1.0 | 2 | creativecommons | creativecommons org publicdomain zero(?: 1 0)?
proprietary | 3 | proprietary | (?:this software is )?(?:confidential and proprietary|proprietary and confidential)
proprietary | 2 | unauthorized | unauthorized (?:copying|use|distribution|reproduction)(?: \S+){0,8} (?:is )?(?:strictly )?prohibited
all-rights-reserved | 1 | reserved | all rights reserved
see-license | 1 | license | see(?: the)? license(?: txt| md| file)? for(?: more)? (?:details|information|terms)
see-license | 1 | licensed | licensed under the(?: terms of the)? license
"""
