"""Ordered license signatures over normalized text: lower-case words parted by single spaces.

A line is ``label | keyword | pattern``; the keyword is a word, or several, that every match holds. Earlier lines go
first: a match that lies inside a match of an earlier line is suppressed. ``%`` stands for an optional
"v", "version" or "version v" before a number.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Full notices: sentences that the licenses' own texts or headers hold.
NOTICES = """
MIT | granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
MIT-0 | granted | permission is hereby granted free of charge to any person obtaining a copy of this software .{0,80} without restriction
ISC | granted | permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted
HPND | documentation | permission to use copy modify and distribute this software and its documentation for any purpose
BSL-1.0 | granted | permission is hereby granted free of charge to any person or organization obtaining a copy of the software
Unicode-DFS | granted | permission is hereby granted free of charge to any person obtaining a copy of (the unicode )?data files
OFL-1.1 | granted | permission is hereby granted free of charge to any person obtaining a copy of the font software
Apache-2.0 | apache | licensed under the apache license version 2 0
Apache-2.0 | compliance | you may not use this file except in compliance with the license
Apache-2.0 | agreed | unless required by applicable law or agreed to in writing software .{0,60}as is
Apache-1.1 | foundation | this product includes software developed by the apache software foundation
BSD-4-Clause | advertising | all advertising materials mentioning features or use of this software must display
BSD-3-Clause | endorse | neither the names? of .{1,80} may be used to endorse or promote products
BSD-2-Clause | redistribution | redistribution and use in source and binary forms with or without modification are permitted
AGPL-3.0-or-later | affero | terms of the gnu affero general public license as published by the free software foundation either % ?3 .{0,40}any later version
AGPL-3.0-only | affero | licensed under the gnu affero general public license % ?3
AGPL | affero | terms of the gnu affero general public license
LGPL-3.0-or-later | lesser | terms of the gnu lesser general public license as published by the free software foundation either % ?3 .{0,40}any later version
LGPL-2.1-or-later | lesser | terms of the gnu lesser general public license as published by the free software foundation either % ?2 1 .{0,40}any later version
LGPL-3.0-only | lesser | licensed under the gnu lesser general public license % ?3
LGPL-2.1-only | lesser | licensed under the gnu lesser general public license % ?2 1
LGPL | lesser | terms of the gnu lesser general public license
LGPL-2.0-or-later | library general license | terms of the gnu library general public license
GPL-3.0-or-later | gnu | terms of the gnu general public license as published by the free software foundation either % ?3 .{0,40}any later version
GPL-2.0-or-later | gnu | terms of the gnu general public license as published by the free software foundation either % ?2 .{0,40}any later version
GPL-3.0-only | gnu | (this work is )?licensed under the gnu general public license % ?3
GPL-2.0-only | gnu | (this work is )?licensed under the gnu general public license % ?2
GPL | gnu | terms of the gnu general public license
GFDL-1.3 | documentation gnu | terms of the gnu free documentation license % ?1 3
GFDL-1.2 | documentation gnu | terms of the gnu free documentation license % ?1 2
GFDL | documentation gnu | terms of the gnu free documentation license
MPL-2.0 | mozilla | subject to the terms of the mozilla public license % ?2 0
MPL-1.1 | mozilla | subject to the mozilla public license % ?1 1
EPL-2.0 | eclipse | made available under the terms of the eclipse public license % ?2 0
EPL-1.0 | eclipse | made available under the terms of the eclipse public license % ?1 0
CDDL-1.0 | distribution | subject to the terms of the common development and distribution license.{0,20}cddl
Unlicense | unencumbered | this is free and unencumbered software released into the public domain
WTFPL | want | do what the fuck you want to public license
Zlib | misrepresented | the origin of this software must not be misrepresented
CC0-1.0 | waived | to the extent possible under law .{1,80} has waived all copyright
CC-BY-4.0 | commons licensed | licensed under (a|the) creative commons attribution 4 0 international license
CC-BY-SA-4.0 | sharealike | licensed under (a|the) creative commons attribution sharealike 4 0 international license
CC-BY-SA-3.0 | sharealike | licensed under (a|the) creative commons attribution sharealike 3 0( unported)? license
CC-BY-NC-4.0 | noncommercial | licensed under (a|the) creative commons attribution noncommercial 4 0 international license
CC-BY-NC-SA-4.0 | noncommercial | licensed under (a|the) creative commons attribution noncommercial sharealike 4 0 international license
CC-BY-NC-ND-4.0 | noderivatives | licensed under (a|the) creative commons attribution noncommercial noderivatives 4 0 international license
CC-BY-ND-4.0 | noderivatives | licensed under (a|the) creative commons attribution noderivatives 4 0 international license
MIT | mit | (released|licensed|distributed|available|published) under (the )?(terms of the )?mit license
BSD-3-Clause | bsd | (released|licensed|distributed|available|published) under (the )?(terms of the )?(new|modified|revised|3 clause|three clause) bsd license
BSD-2-Clause | bsd | (released|licensed|distributed|available|published) under (the )?(terms of the )?(simplified|2 clause|two clause|freebsd) bsd license
BSD | bsd | (released|licensed|distributed|available|published) under (the |a )?(terms of the )?bsd( style)? license
Apache | apache | (released|licensed|distributed|available|published) under (the )?(terms of the )?apache( software)? license
GPL | gnu | (released|licensed|distributed|available|published) under (the )?(terms of the )?gnu( general public license| gpl)
LGPL | lgpl | (released|licensed|distributed|available|published) under (the )?(terms of the )?(gnu )?lgpl
MPL | mozilla | (released|licensed|distributed|available|published) under (the )?(terms of the )?mozilla public license
Public-Domain | domain | (released|placed|dedicated|put) (in|into|to) the public domain
Proprietary | reserved | all rights reserved
Proprietary | confidential | (proprietary and confidential|confidential and proprietary)
Proprietary | unauthorized | unauthorized copying of this (file|work|document|software)
Proprietary | reproduced | (may not be|no part .{1,60}) reproduced .{0,60}without .{0,30}permission
No-Warranty | warranty | (provided|distributed) as is without( express or implied)? warranty
No-Warranty | warranties | (provided|distributed) as is (and any express or implied|without) warranties
MIT | sublicense | to use copy modify merge publish distribute sublicense and or sell copies of the software
MIT | substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
ISC | appear copies | provided that the above copyright notice and this permission notice appear in all copies
BSD-2-Clause | redistributions retain | redistributions of source code must retain the above copyright notice
BSD-2-Clause | redistributions binary | redistributions in binary form must reproduce the above copyright notice
No-Liability | liable | in no event shall .{1,80} be liable for any
No-Warranty | merchantability | implied warranties of merchantability( and| or)? fitness for a particular purpose
No-Warranty | warranty | (there is|comes with) (absolutely )?no warranty
GPL-linking-exception | exception linking | as a special exception (.{0,80} )?linking
Classpath-exception-2.0 | classpath | (with the )?classpath exception
GCC-exception-3.1 | gcc | gcc runtime library exception( % ?3 1)?
LLVM-exception | llvm | (with )?llvm exceptions?
Font-exception-2.0 | font exception | (with )?(the )?font exception
Bison-exception-2.2 | bison | bison exception( % ?2 2)?
Autoconf-exception | autoconf | autoconf( configure script)? exception
OpenSSL-exception | openssl | openssl( linking)? exception
JSON | evil | the software shall be used for good not evil
Beerware | beer | you can buy me a beer in return
PSF-2.0 | psf | psf is making python available to licensee on an as is basis
SQLite-blessing | blessing | in place of a legal notice here is a blessing
Public-Domain | copyright code | the authors? disclaims? copyright to this source code
Public-Domain | domain | this (work|file|software|code) is in the public domain
CC-BY | appropriate attribution | you must give appropriate credit (.{0,120} )?attribution
CC-BY-NC | commercial | you may not use the material for commercial purposes
CC-BY-SA | remix | if you remix transform or build upon the material you must distribute your contributions under the same license
CC-BY-ND | remix | if you remix transform or build upon the material you may not distribute the modified material
"""

#: Names: how texts call a license. ``-`` in a label's number is spelled out in the pattern.
NAMES = """
Apache-2.0 | apache | apache( software)? license % ?2( 0)?
Apache-1.1 | apache | apache( software)? license % ?1 1
Apache-1.0 | apache | apache( software)? license % ?1 0
AGPL-3.0 | affero | (gnu )?affero general public license % ?3( 0)?
AGPL-1.0 | affero | affero general public license % ?1( 0)?
AGPL-3.0 | agpl | (gnu )?agpl % ?3( 0)?
LGPL-3.0 | lesser | (gnu )?lesser general public license % ?3( 0)?
LGPL-2.1 | lesser | (gnu )?lesser general public license % ?2 1
LGPL-2.0 | library general license | (gnu )?library general public license % ?2( 0)?
LGPL-3.0 | lgpl | (gnu )?lgpl % ?3( 0)?
LGPL-2.1 | lgpl | (gnu )?lgpl % ?2 1
GPL-3.0 | general public license | (gnu )?general public license % ?3( 0)?
GPL-2.0 | general public license | (gnu )?general public license % ?2( 0)?
GPL-1.0 | general public license | (gnu )?general public license % ?1( 0)?
GPL-3.0 | gpl | (gnu )?gpl % ?3( 0)?
GPL-2.0 | gpl | (gnu )?gpl % ?2( 0)?
GPL-3.0 | gplv3 | (gnu )?gplv3
GPL-2.0 | gplv2 | (gnu )?gplv2
LGPL-3.0 | lgplv3 | (gnu )?lgplv3
LGPL-2.1 | lgplv2 | (gnu )?lgplv2( 1)?
AGPL-3.0 | agplv3 | (gnu )?agplv3
GFDL-1.3 | documentation | (gnu )?free documentation license % ?1 3
GFDL-1.2 | documentation | (gnu )?free documentation license % ?1 2
GFDL-1.1 | documentation | (gnu )?free documentation license % ?1 1
MPL-2.0 | mozilla | mozilla public license % ?2( 0)?
MPL-1.1 | mozilla | mozilla public license % ?1 1
MPL-1.0 | mozilla | mozilla public license % ?1 0
EPL-2.0 | eclipse | eclipse public license % ?2( 0)?
EPL-1.0 | eclipse | eclipse public license % ?1 0
EUPL-1.2 | european union | european union public licen[cs]e % ?1 2
EUPL-1.1 | european union | european union public licen[cs]e % ?1 1
CDDL-1.1 | common development distribution | common development and distribution license % ?1 1
CDDL-1.0 | common development distribution | common development and distribution license( % ?1 0)?
CPL-1.0 | common public license | common public license( % ?1 0)?
IPL-1.0 | ibm | ibm public license( % ?1 0)?
OSL-3.0 | open software license | open software license( % ?3 0)?
AFL-3.0 | academic | academic free license( % ?3 0)?
ECL-2.0 | educational | educational community license( % ?2 0)?
Artistic-2.0 | artistic | artistic license % ?2( 0)?
Artistic-1.0 | artistic | artistic license( % ?1 0)?
BSL-1.0 | boost | boost software license( % ?1 0)?
PSF-2.0 | python foundation | python software foundation license( % ?2)?
PHP-3.01 | php license | php license( % ?3 01)?
Zend-2.0 | zend | zend( engine)? license( % ?2 0)?
Ruby | ruby license | ruby license
OpenSSL | openssl | openssl license
OLDAP-2.8 | openldap | openldap public license( % ?2 8)?
PostgreSQL | postgresql | postgresql licen[cs]e
NCSA | university illinois license | university of illinois (.{0,10} )?ncsa open source license
Zlib | zlib | zlib( libpng)? license
Libpng | libpng | libpng license
ISC | isc | isc license
X11 | x11 | x11 license
Beerware | beer | beer ware license
Beerware | beerware | beerware license
WTFPL | wtfpl | wtfpl
Unlicense | unlicense | (the )?unlicense
Vim | vim license | vim license
TCL | tcl | tcl tk license
W3C | w3c | w3c (software|document)( notice and)? license
Intel | intel license | intel open source license
MS-PL | microsoft public | microsoft public license
MS-RL | microsoft reciprocal | microsoft reciprocal license
APSL-2.0 | apple public license | apple public source license( % ?2 0)?
QPL-1.0 | q public license | q public license( % ?1 0)?
SISSL | sun industry license | sun industry standards source license
CECILL-2.1 | cecill | cecill( free software license)?( agreement)?( % ?2 1)?
OFL-1.1 | sil | sil open font license( % ?1 1)?
ODbL-1.0 | database license | open (data commons open )?database license( % ?1 0)?
ODC-By-1.0 | commons attribution license | open data commons attribution license( % ?1 0)?
PDDL-1.0 | domain dedication license | public domain dedication and license( % ?1 0)?
SSPL-1.0 | server side public license | server side public license( % ?1)?
BUSL-1.1 | business source license | business source license( % ?1 1)?
Elastic-2.0 | elastic | elastic license( % ?2 0)?
MulanPSL-2.0 | mulan | mulan permissive software license( % ?2)?
BSD-4-Clause | bsd | (original|old|4 clause|four clause) bsd licen[cs]e
BSD-3-Clause | bsd | (new|modified|revised|3 clause|three clause) bsd licen[cs]e
BSD-2-Clause | bsd | (simplified|freebsd|2 clause|two clause) bsd licen[cs]e
0BSD | bsd | (zero clause|0 clause) bsd licen[cs]e
BSD | bsd | bsd( style)? licen[cs]e
CC0-1.0 | cc0 | cc0( 1 0)?( universal)?
CC-BY-NC-ND | creative | creative commons (attribution|by) (noncommercial|nc) (noderivatives|noderivs|nd)
CC-BY-NC-SA | creative | creative commons (attribution|by) (noncommercial|nc) (sharealike|sa)
CC-BY-NC | creative | creative commons (attribution|by) (noncommercial|nc)
CC-BY-ND | creative | creative commons (attribution|by) (noderivatives|noderivs|nd)
CC-BY-SA | creative | creative commons (attribution|by) (sharealike|sa)
CC-BY | creative | creative commons (attribution|by)
CC | creative | creative commons( public)? licen[cs]e
CC-BY-NC-ND | cc | cc by nc nd( [1-4] 0)?
CC-BY-NC-SA | cc | cc by nc sa( [1-4] 0)?
CC-BY-NC | cc | cc by nc( [1-4] 0)?
CC-BY-ND | cc | cc by nd( [1-4] 0)?
CC-BY-SA | cc | cc by sa( [1-4] 0)?
CC-BY | cc | cc by( [1-4] 0)?
MIT-0 | mit | mit no attribution( license)?
MIT | mit | (expat )?mit( style)? licen[cs]e
MIT | expat | expat licen[cs]e
AGPL | affero | (gnu )?affero general public license
AGPL | agpl | (gnu )?agpl
LGPL | lesser | (gnu )?lesser general public license
LGPL | library general license | (gnu )?library general public license
LGPL | lgpl | (gnu )?lgpl
GPL | general public license | (gnu )?general public license
GPL | gpl | (gnu )?gpl
GFDL | documentation | (gnu )?free documentation license
Apache | apache | apache( software)? licen[cs]e
MPL | mozilla | mozilla public licen[cs]e
EPL | eclipse | eclipse public licen[cs]e
EUPL | eupl | eupl
BlueOak-1.0.0 | oak | blue oak model license( % ?1 0 0)?
UPL-1.0 | universal permissive | universal permissive license( % ?1 0)?
Parity-7.0.0 | parity | parity public license( % ?7 0 0)?
PolyForm-Noncommercial-1.0.0 | polyform | polyform noncommercial license( % ?1 0 0)?
PolyForm-Shield-1.0.0 | polyform | polyform shield license( % ?1 0 0)?
PolyForm-Small-Business-1.0.0 | polyform | polyform small business license( % ?1 0 0)?
CAL-1.0 | cryptographic | cryptographic autonomy license( % ?1 0)?
Commons-Clause | clause commons | commons clause( license condition)?( % ?1 0)?
Confluent-Community-1.0 | confluent | confluent community license( agreement)?( % ?1 0)?
RSAL-2.0 | redis | redis source available license( % ?2( 0)?)?
FSL-1.1 | functional | functional source license( % ?1 1)?
Elastic-2.0 | elv2 | elv2
Sleepycat | sleepycat | sleepycat( public| software)? license
JSON | json | json license
ICU | icu | icu license
Info-ZIP | zip | info zip license
IJG | jpeg | independent jpeg group license
FTL | freetype | freetype( project)? licen[cs]e
RPL-1.5 | reciprocal | reciprocal public license( % ?1 5)?
RPSL-1.0 | realnetworks | realnetworks public source license
SPL-1.0 | sun | sun public license( % ?1 0)?
NPL-1.1 | netscape | netscape public license( % ?1 1)?
NASA-1.3 | nasa | nasa open source agreement( % ?1 3)?
LPPL-1.3c | latex | latex project public license( % ?1 3c?)?
Nokia | nokia | nokia open source license
EFL-2.0 | eiffel | eiffel forum license( % ?2)?
Frameworx-1.0 | frameworx | frameworx( open)? license( % ?1 0)?
ZPL-2.1 | zope | zope public license( % ?2 1)?
Watcom-1.0 | watcom | (sybase )?open watcom public license
wxWindows | wxwindows | wxwindows library licen[cs]e
VSL-1.0 | vovida | vovida software license( % ?1 0)?
SMLNJ | jersey | standard ml of new jersey license
SimPL-2.0 | simple | simple public license( % ?2 0)?
OGL-UK-3.0 | government | open government licen[cs]e( % ?3 0)?
etalab-2.0 | etalab | etalab( open)? licen[cs]e( % ?2 0)?
LAL-1.3 | libre | (licence art libre|free art license libre)
CDLA-Permissive-2.0 | permissive | community data license agreement permissive( % ?2 0)?
CDLA-Sharing-1.0 | sharing | community data license agreement sharing( % ?1 0)?
OpenRAIL | openrail | (creativeml )?openrail( m)?( license)?
BigScience-RAIL-1.0 | bigscience | bigscience( open)? rail license( % ?1 0)?
ClArtistic | clarified | clarified artistic license
HPND | historical | historical permission notice and disclaimer
MirOS | miros | miros licen[cs]e
NTP | ntp | ntp license
curl | curl | curl license
bzip2 | bzip2 | bzip2( and libbzip2)? license
libtiff | libtiff | libtiff license
ImageMagick | imagemagick | imagemagick license
CPAL-1.0 | attribution | common public attribution license( % ?1 0)?
AAL | assurance | attribution assurance license
CATOSL-1.1 | trusted | computer associates trusted open source license( % ?1 1)?
OCLC-2.0 | oclc | oclc research public license( % ?2 0)?
LiLiQ | quebec | licence libre du quebec
MS-LPL | microsoft limited | microsoft limited public license
GPL-3.0 | gpl3 | gpl3
GPL-2.0 | gpl2 | gpl2
LGPL-3.0 | lgpl3 | lgpl3
AGPL-3.0 | agpl3 | agpl3
GFDL | gfdl | (gnu )?gfdl
CC-BY-SA | ccbysa | ccbysa
"""

#: Identifiers as headers write them, after "spdx license identifier".
IDENTIFIERS = """
0BSD AAL AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 AGPL-1.0-only AGPL-1.0-or-later AGPL-3.0-only AGPL-3.0-or-later
Apache-1.0 Apache-1.1 Apache-2.0 APSL-1.0 APSL-2.0 Artistic-1.0 Artistic-2.0 Beerware BlueOak-1.0.0 BSD-1-Clause
BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CAL-1.0 CC-BY-3.0
CC-BY-4.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0
CDDL-1.0 CDDL-1.1 CECILL-2.1 CECILL-B CECILL-C CPL-1.0 ECL-2.0 EFL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2
GFDL-1.1-only GFDL-1.2-only GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only GPL-2.0-only GPL-2.0-or-later GPL-3.0-only
GPL-3.0-or-later HPND IPL-1.0 ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only
LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA OFL-1.1 OLDAP-2.8 OpenSSL
OSL-3.0 PHP-3.01 PostgreSQL PSF-2.0 QPL-1.0 Ruby SSPL-1.0 TCL Unlicense UPL-1.0 Vim W3C WTFPL X11 Zend-2.0 Zlib ZPL-2.1
"""

#: The base phrases: their places count whatever the ordered rules say.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))


@dataclass(frozen=True)
class Signature:
    priority: int
    label: str
    keyword: str
    pattern: str
    weight: float


def _lines(table: str, weight: float) -> list[tuple[str, str, str, float]]:
    parts = (line.split(" | ") for line in table.strip().splitlines())
    return [(a.strip(), k.strip(), p.strip().replace("%", "(v|version|version v)"), weight) for a, k, p in parts]


def signatures() -> tuple[Signature, ...]:
    """All rules in their order: notices, identifiers (longest first), names."""
    spelled = sorted(IDENTIFIERS.split(), key=lambda x: (-len(x), x))
    ids = [(x, "spdx", "spdx license identifier " + re.sub("[^0-9a-z]+", " ", x.lower()), 1.0) for x in spelled]
    rows = _lines(NOTICES, 1.0) + ids + _lines(NAMES, 0.8)
    # "(v|version|version v) ?3": the part before the number may be missing altogether.
    fixed = [(a, k, p.replace("(v|version|version v) ?", "((v|version|version v) ?)?"), w) for a, k, p, w in rows]
    return tuple(Signature(i, *r) for i, r in enumerate(fixed))
