"""Signatures of licenses, written by hand.

A line is: label; words, one of which every match holds; priority; confidence;
pattern over lower-cased words with single spaces between.  The wider and surer a
wording, the higher its priority: 9 sentences of license texts and notices, 8
SPDX tags, 7 phrases that put something under a license, 6 full names with a
version, 5 full names, 4 identifiers with a version, 3 abbreviations, 2 hints.
"""

SIGNATURES = r"""
mit; hereby; 9; 1.0; permission is hereby granted free of charge to any person obtaining a copy(?: of this software and associated documentation files)?
mit; substantial; 9; 0.95; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0; sublicense; 9; 0.9; to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is
isc; fee; 9; 1.0; permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
hpnd; fee; 9; 0.9; permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
bsd; redistribution; 9; 1.0; redistribution and use in source and binary forms(?: with or without modification are permitted)?
bsd-3-clause; endorse; 9; 1.0; neither the names? of(?: \S+){1,12} may be used to endorse or promote products derived from this software
bsd-4-clause; advertising; 9; 1.0; all advertising materials mentioning features or use of this software must display the following acknowledge?ment
apache-2.0; apache; 9; 1.0; licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0; basis; 9; 0.9; unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-1.1; apache; 9; 0.9; this product includes software developed by the apache software foundation
gpl; gnu; 9; 0.95; you can redistribute it and or modify it under the terms of the gnu general public license
gpl-1.0-or-later; gnu; 9; 1.0; gnu general public license as published by the free software foundation either version 1 or at your option any later version
gpl-2.0-or-later; gnu; 9; 1.0; gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0-or-later; gnu; 9; 1.0; gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0; gnu; 9; 1.0; gnu general public license version 2(?: only)? as published by the free software foundation
gpl-3.0; gnu; 9; 1.0; gnu general public license version 3(?: only)? as published by the free software foundation
gpl; gnu; 9; 0.9; you should have received a copy of the gnu general public license
lgpl; gnu; 9; 0.95; you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl-2.1-or-later; gnu; 9; 1.0; gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3.0-or-later; gnu; 9; 1.0; gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2.0-or-later; gnu; 9; 1.0; gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
lgpl; gnu; 9; 0.9; you should have received a copy of the gnu (?:lesser|library) general public license
agpl; affero; 9; 0.95; you can redistribute it and or modify it under the terms of the gnu affero general public license
agpl-3.0-or-later; affero; 9; 1.0; gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl; affero; 9; 0.9; you should have received a copy of the gnu affero general public license
gfdl; documentation; 9; 1.0; permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2.0; mozilla; 9; 1.0; this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1; mozilla; 9; 1.0; the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0; mozilla; 9; 1.0; the contents of this file are subject to the mozilla public license version 1 0
epl-1.0; eclipse; 9; 1.0; made available under the terms of the eclipse public license v(?:ersion)? 1 0
epl-2.0; eclipse; 9; 1.0; made available under the terms of the eclipse public license(?: v)? 2 0
cddl; distribution; 9; 0.95; the contents of this file are subject to the terms of the common development and distribution license
cpl-1.0; common; 9; 1.0; the accompanying program is provided under the terms of this common public license
ibmpl-1.0; ibm; 9; 0.95; the accompanying program is provided under the terms of this ibm public license
artistic-1.0; package; 9; 0.9; the intent of this document is to state the conditions under which a package may be copied
artistic-2.0; package; 9; 0.9; everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed(?: \S+){1,8} package
zlib; misrepresented; 9; 1.0; the origin of this software must not be misrepresented
zlib; held; 9; 0.9; in no event will the authors be held liable for any damages arising from the use of this software
unlicense; unencumbered; 9; 1.0; this is free and unencumbered software released into the public domain
wtfpl; fuck; 9; 1.0; do what the fuck you want to(?: public licen[cs]e)?
boost-1.0; boost; 9; 1.0; distributed under the boost software license version 1 0
ofl-1.1; font; 9; 1.0; this font software is licensed under the sil open font license version 1 1
ofl-1.1; font; 9; 0.9; this license is copied below and is also available with a faq at(?: \S+){1,6} font
psf-2.0; psf; 9; 0.95; this license agreement is between the python software foundation psf and the individual or organization
python-2.0; python; 9; 0.9; python software foundation license version 2
postgresql; postgresql; 9; 0.9; postgresql database management system formerly known as postgres(?: then as postgres95)?
openssl; openssl; 9; 0.95; this product includes software developed by the openssl project
ncsa; ncsa; 9; 0.95; university of illinois ncsa open source license
beerware; beer; 9; 1.0; if we meet some day and you think this stuff is worth it you can buy me a beer
cc0-1.0; affirmer; 9; 0.9; affirmer hereby overtly fully permanently irrevocably and unconditionally waives
cc0-1.0; waiving; 9; 0.95; has dedicated the work to the public domain by waiving all
cc0-1.0; waived; 9; 0.95; (?:to the extent possible under law|has)(?: \S+){1,10} waived all copyright and related or neighboring rights
cc-pddc; dedicated; 9; 0.8; (?:is|are|was|have|has)(?: hereby)?(?: been)? dedicated to the public domain
odbl-1.0; odbl; 9; 0.95; this \S+ is made available under the open database license(?: \S+){0,8} odbl(?: 1 0)?
sleepycat; sleepycat; 9; 0.8; sleepycat software(?: inc)?
json; evil; 9; 1.0; the software shall be used for good not evil
elastic-2.0; elastic; 9; 0.9; elastic license 2 0
busl-1.1; business; 9; 0.95; business source license 1 1
sspl-1.0; side; 9; 0.95; server side public license(?: version| v)?(?: 1(?: 0)?)?
commons-clause; commons; 9; 0.9; commons clause license condition(?: v1 0)?
apache-2.0; spdx; 8; 1.0; spdx license identifier apache 2 0
mit; spdx; 8; 1.0; spdx license identifier mit
mit-0; spdx; 8; 1.0; spdx license identifier mit 0
isc; spdx; 8; 1.0; spdx license identifier isc
0bsd; spdx; 8; 1.0; spdx license identifier 0bsd
bsd-2-clause; spdx; 8; 1.0; spdx license identifier bsd 2 clause
bsd-3-clause; spdx; 8; 1.0; spdx license identifier bsd 3 clause
bsd-4-clause; spdx; 8; 1.0; spdx license identifier bsd 4 clause
gpl-2.0; spdx; 8; 1.0; spdx license identifier gpl 2 0(?: only)?
gpl-2.0-or-later; spdx; 8; 1.0; spdx license identifier gpl 2 0 or later
gpl-3.0; spdx; 8; 1.0; spdx license identifier gpl 3 0(?: only)?
gpl-3.0-or-later; spdx; 8; 1.0; spdx license identifier gpl 3 0 or later
lgpl-2.1; spdx; 8; 1.0; spdx license identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later; spdx; 8; 1.0; spdx license identifier lgpl 2 1 or later
lgpl-3.0; spdx; 8; 1.0; spdx license identifier lgpl 3 0(?: only)?
lgpl-3.0-or-later; spdx; 8; 1.0; spdx license identifier lgpl 3 0 or later
agpl-3.0; spdx; 8; 1.0; spdx license identifier agpl 3 0(?: only)?
agpl-3.0-or-later; spdx; 8; 1.0; spdx license identifier agpl 3 0 or later
mpl-1.1; spdx; 8; 1.0; spdx license identifier mpl 1 1
mpl-2.0; spdx; 8; 1.0; spdx license identifier mpl 2 0
epl-1.0; spdx; 8; 1.0; spdx license identifier epl 1 0
epl-2.0; spdx; 8; 1.0; spdx license identifier epl 2 0
cddl-1.0; spdx; 8; 1.0; spdx license identifier cddl 1 0
cddl-1.1; spdx; 8; 1.0; spdx license identifier cddl 1 1
zlib; spdx; 8; 1.0; spdx license identifier zlib
boost-1.0; spdx; 8; 1.0; spdx license identifier bsl 1 0
busl-1.1; spdx; 8; 1.0; spdx license identifier busl 1 1
unlicense; spdx; 8; 1.0; spdx license identifier unlicense
wtfpl; spdx; 8; 1.0; spdx license identifier wtfpl
ofl-1.1; spdx; 8; 1.0; spdx license identifier ofl 1 1
artistic-2.0; spdx; 8; 1.0; spdx license identifier artistic 2 0
postgresql; spdx; 8; 1.0; spdx license identifier postgresql
psf-2.0; spdx; 8; 1.0; spdx license identifier psf 2 0
python-2.0; spdx; 8; 1.0; spdx license identifier python 2 0
eupl-1.2; spdx; 8; 1.0; spdx license identifier eupl 1 2
ms-pl; spdx; 8; 1.0; spdx license identifier ms pl
cc0-1.0; spdx; 8; 1.0; spdx license identifier cc0 1 0
cc-by; spdx; 8; 1.0; spdx license identifier cc by [1-4] [05]
cc-by-sa; spdx; 8; 1.0; spdx license identifier cc by sa [1-4] [05]
cc-by-nc; spdx; 8; 1.0; spdx license identifier cc by nc [1-4] [05]
cc-by-nd; spdx; 8; 1.0; spdx license identifier cc by nd [1-4] [05]
cc-by-nc-sa; spdx; 8; 1.0; spdx license identifier cc by nc sa [1-4] [05]
cc-by-nc-nd; spdx; 8; 1.0; spdx license identifier cc by nc nd [1-4] [05]
spdx; spdx; 7; 0.6; spdx license identifier \S+
apache-2.0; apache; 7; 0.95; (?:licen[cs]ed|released|distributed|published|available|covered) under (?:the )?(?:terms of the )?apache(?: software)?(?: licen[cs]e)?(?: version| v)? (?:2 0|2)(?: licen[cs]e)?
mit; mit; 7; 0.95; (?:licen[cs]ed|released|distributed|published|available|covered) under (?:the |an? )?(?:terms of the )?mit(?: style| x11| expat)?(?: licen[cs]e)?
bsd; bsd; 7; 0.9; (?:licen[cs]ed|released|distributed|published|available|covered) under (?:the |an? )?(?:terms of the )?bsd(?: style)?(?: licen[cs]e)?
bsd-3-clause; bsd; 7; 0.95; (?:licen[cs]ed|released|distributed|published|available|covered) under (?:the |an? )?(?:terms of the )?(?:3 clause bsd|three clause bsd|bsd 3 clause|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?
bsd-2-clause; bsd,freebsd; 7; 0.95; (?:licen[cs]ed|released|distributed|published|available|covered) under (?:the |an? )?(?:terms of the )?(?:2 clause bsd|two clause bsd|bsd 2 clause|simplified bsd|freebsd)(?: licen[cs]e)?
gpl; gpl,gnu; 7; 0.9; (?:licen[cs]ed|released|distributed|published|available|covered) under (?:the )?(?:terms of the )?(?:gnu gpl|gpl|gnu general public licen[cs]e)(?: licen[cs]e)?
gpl-2.0; gpl,gplv2,gpl2,general; 7; 0.95; (?:licen[cs]ed|released|distributed|published|available|covered) under (?:the )?(?:terms of the )?(?:gnu )?(?:gplv2|gpl2|gpl v2|gpl 2|gpl version 2|general public licen[cs]e v2|general public licen[cs]e version 2)(?: 0)?(?: only| licen[cs]e)?
gpl-3.0; gpl,gplv3,gpl3,general; 7; 0.95; (?:licen[cs]ed|released|distributed|published|available|covered) under (?:the )?(?:terms of the )?(?:gnu )?(?:gplv3|gpl3|gpl v3|gpl 3|gpl version 3|general public licen[cs]e v3|general public licen[cs]e version 3)(?: 0)?(?: only| licen[cs]e)?
lgpl; lgpl,lgplv2,lgplv3,lesser; 7; 0.95; (?:licen[cs]ed|released|distributed|published|available|covered) under (?:the )?(?:terms of the )?(?:gnu )?(?:lgplv2|lgplv3|lgpl|lesser general public licen[cs]e)
agpl; agpl,agplv3,affero; 7; 0.95; (?:licen[cs]ed|released|distributed|published|available|covered) under (?:the )?(?:terms of the )?(?:gnu )?(?:agplv3|agpl|affero general public licen[cs]e)
mpl-2.0; mpl,mozilla; 7; 0.95; (?:licen[cs]ed|released|distributed|published|available|covered) under (?:the )?(?:terms of the )?(?:mpl|mozilla public licen[cs]e)(?: version| v)? (?:2 0|2)
creative-commons; creative,cc; 7; 0.85; (?:licen[cs]ed|released|distributed|published|available|covered) under (?:an? |the )?(?:terms of the )?(?:creative commons|cc) licen[cs]e
public-domain; domain; 7; 0.8; (?:placed|released|put) (?:in|into|in to) the public domain
apache-2.0; apache; 6; 0.9; apache(?: software)? licen[cs]e(?: version| v)? (?:2 0|2)
apache-2.0; apache; 6; 0.8; apache(?: version| v)? 2 0(?: licen[cs]e)?
apache-1.1; apache; 6; 0.9; apache(?: software)? licen[cs]e(?: version| v)? 1 1
apache-1.0; apache; 6; 0.9; apache(?: software)? licen[cs]e(?: version| v)? 1 0
gpl-1.0; gnu; 6; 0.9; gnu general public licen[cs]e(?: version| v)? 1(?: 0)?
gpl-2.0; general; 6; 0.9; (?:gnu )?general public licen[cs]e(?: version| v)? 2(?: 0)?
gpl-2.0; general; 6; 0.9; (?:gnu )?general public licen[cs]e v2
gpl-3.0; general; 6; 0.9; (?:gnu )?general public licen[cs]e(?: version| v)? 3(?: 0)?
gpl-3.0; general; 6; 0.9; (?:gnu )?general public licen[cs]e v3
lgpl-2.0; library; 6; 0.9; (?:gnu )?library general public licen[cs]e(?: version| v)? 2(?: 0)?
lgpl-2.1; lesser; 6; 0.9; (?:gnu )?lesser general public licen[cs]e(?: version| v)? 2 1
lgpl-3.0; lesser; 6; 0.9; (?:gnu )?lesser general public licen[cs]e(?: version| v)? 3(?: 0)?
agpl-3.0; affero; 6; 0.9; (?:gnu )?affero general public licen[cs]e(?: version| v)? 3(?: 0)?
agpl-1.0; affero; 6; 0.9; affero general public licen[cs]e(?: version| v)? 1(?: 0)?
gfdl-1.1; documentation; 6; 0.9; (?:gnu )?free documentation licen[cs]e(?: version| v)? 1 1
gfdl-1.2; documentation; 6; 0.9; (?:gnu )?free documentation licen[cs]e(?: version| v)? 1 2
gfdl-1.3; documentation; 6; 0.9; (?:gnu )?free documentation licen[cs]e(?: version| v)? 1 3
mpl-1.0; mozilla; 6; 0.9; mozilla public licen[cs]e(?: version| v)? 1 0
mpl-1.1; mozilla; 6; 0.9; mozilla public licen[cs]e(?: version| v)? 1 1
mpl-2.0; mozilla; 6; 0.9; mozilla public licen[cs]e(?: version| v)? 2(?: 0)?
epl-1.0; eclipse; 6; 0.9; eclipse public licen[cs]e(?: version| v)? 1 0
epl-2.0; eclipse; 6; 0.9; eclipse public licen[cs]e(?: version| v)? 2 0
edl-1.0; eclipse; 6; 0.9; eclipse distribution licen[cs]e(?: version| v)?(?: 1 0)?
cddl-1.0; distribution; 6; 0.9; common development and distribution licen[cs]e(?: version| v)? 1 0
cddl-1.1; distribution; 6; 0.9; common development and distribution licen[cs]e(?: version| v)? 1 1
cpl-1.0; common; 6; 0.9; common public licen[cs]e(?: version| v)? 1 0
artistic-1.0; artistic; 6; 0.9; artistic licen[cs]e(?: version| v)? 1 0
artistic-2.0; artistic; 6; 0.9; artistic licen[cs]e(?: version| v)? 2 0
boost-1.0; boost; 6; 0.9; boost software licen[cs]e(?: version| v)? 1 0
ofl-1.0; font; 6; 0.9; (?:sil )?open font licen[cs]e(?: version| v)? 1 0
ofl-1.1; font; 6; 0.9; (?:sil )?open font licen[cs]e(?: version| v)? 1 1
osl-3.0; open; 6; 0.9; open software licen[cs]e(?: version| v)? 3 0
afl-3.0; academic; 6; 0.9; academic free licen[cs]e(?: version| v)? 3 0
afl-2.1; academic; 6; 0.9; academic free licen[cs]e(?: version| v)? 2 1
eupl-1.1; european; 6; 0.9; european union public licen[cs]e(?: version| v)? 1 1
eupl-1.2; european; 6; 0.9; european union public licen[cs]e(?: version| v)? 1 2
cecill-2.1; cecill; 6; 0.9; cecill(?: free software)?(?: licen[cs]e)?(?: agreement)?(?: version| v)? 2 1
odbl-1.0; database; 6; 0.9; open database licen[cs]e(?: version| v)? 1 0
qpl-1.0; public; 6; 0.8; q public licen[cs]e(?: version| v)?(?: 1 0)?
zpl-2.1; zope; 6; 0.9; zope public licen[cs]e(?: version| v)? 2 1
php-3.01; php; 6; 0.9; php licen[cs]e(?: version| v)? 3 01
php-3.0; php; 6; 0.9; php licen[cs]e(?: version| v)? 3 0
upl-1.0; universal; 6; 0.9; universal permissive licen[cs]e(?: version| v)? 1 0
lppl-1.3c; latex; 6; 0.9; latex project public licen[cs]e(?: version| v)? 1 3c?
cc0-1.0; cc0; 6; 0.9; cc0 1 0(?: universal)?
cc0-1.0; zero; 6; 0.9; (?:creative commons|cc) zero(?: v)?(?: 1 0)?(?: universal)?
cc-by; attribution; 6; 0.9; creative commons attribution(?: licen[cs]e)?(?: version| v)? [1-4] [05](?: international| unported| generic)?(?: licen[cs]e)?
cc-by-sa; attribution; 6; 0.9; creative commons attribution (?:share alike|sharealike)(?: licen[cs]e)?(?: version| v)?(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc; attribution; 6; 0.9; creative commons attribution (?:non commercial|noncommercial)(?: licen[cs]e)?(?: version| v)?(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nd; attribution; 6; 0.9; creative commons attribution (?:no derivatives|noderivatives|no derivative works|no derivs|noderivs)(?: licen[cs]e)?(?: version| v)?(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc-sa; attribution; 6; 0.95; creative commons attribution (?:non commercial|noncommercial) (?:share alike|sharealike)(?: licen[cs]e)?(?: version| v)?(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc-nd; attribution; 6; 0.95; creative commons attribution (?:non commercial|noncommercial) (?:no derivatives|noderivatives|no derivative works|no derivs|noderivs)(?: licen[cs]e)?(?: version| v)?(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by; creativecommons; 6; 0.95; creativecommons org licenses by [1-4] [05]
cc-by-sa; creativecommons; 6; 0.95; creativecommons org licenses by sa [1-4] [05]
cc-by-nc; creativecommons; 6; 0.95; creativecommons org licenses by nc [1-4] [05]
cc-by-nd; creativecommons; 6; 0.95; creativecommons org licenses by nd [1-4] [05]
cc-by-nc-sa; creativecommons; 6; 0.95; creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd; creativecommons; 6; 0.95; creativecommons org licenses by nc nd [1-4] [05]
cc0-1.0; creativecommons; 6; 0.95; creativecommons org publicdomain zero 1 0
cc-pdm-1.0; creativecommons; 6; 0.9; creativecommons org publicdomain mark 1 0
apache-2.0; apache; 6; 0.95; apache org licenses license 2 0
gpl; gnu; 6; 0.9; gnu org licenses gpl(?: 2 0| 3 0)?
lgpl; gnu; 6; 0.9; gnu org licenses lgpl(?: 2 1| 3 0)?
agpl-3.0; gnu; 6; 0.9; gnu org licenses agpl(?: 3 0)?
mit; opensource; 6; 0.9; opensource org licen[cs]es? mit
bsd-3-clause; opensource; 6; 0.9; opensource org licen[cs]es? bsd 3 clause
bsd-2-clause; opensource; 6; 0.9; opensource org licen[cs]es? bsd 2 clause
mpl-2.0; mozilla; 6; 0.95; mozilla org mpl 2 0
unlicense; unlicense; 6; 0.9; unlicense org
bsd-4-clause; bsd; 6; 0.9; (?:4 clause bsd|four clause bsd|bsd 4 clause|original bsd|old bsd)(?: licen[cs]e)?
bsd-3-clause; bsd; 6; 0.9; (?:3 clause bsd|three clause bsd|bsd 3 clause|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?
bsd-2-clause; bsd,freebsd; 6; 0.9; (?:2 clause bsd|two clause bsd|bsd 2 clause|simplified bsd|freebsd)(?: licen[cs]e)?
0bsd; bsd; 6; 0.9; (?:zero clause bsd|bsd zero clause|0 clause bsd)(?: licen[cs]e)?
apache; apache; 5; 0.7; apache(?: software)? licen[cs]e
gpl; general; 5; 0.8; (?:gnu )?general public licen[cs]e(?: or(?: at your option)? any later version| only)?
lgpl; lesser,library; 5; 0.8; (?:gnu )?(?:lesser|library) general public licen[cs]e
agpl; affero; 5; 0.8; (?:gnu )?affero general public licen[cs]e
gfdl; documentation; 5; 0.8; (?:gnu )?free documentation licen[cs]e
mit; mit,expat,x11; 5; 0.8; (?:mit|expat|x11)(?: style)? licen[cs]ed?
mit; mit; 5; 0.7; licen[cs]e mit
mit; mit; 5; 0.8; mit or apache(?: 2 0)?
isc; isc; 5; 0.8; isc(?: style)? licen[cs]ed?
bsd; bsd,berkeley; 5; 0.7; (?:berkeley software distribution|bsd)(?: style)? licen[cs]ed?
mpl; mozilla; 5; 0.8; mozilla public licen[cs]e
epl; eclipse; 5; 0.8; eclipse public licen[cs]e
cddl; distribution; 5; 0.8; common development and distribution licen[cs]e
artistic; artistic; 5; 0.6; (?:perl )?artistic licen[cs]e
zlib; zlib; 5; 0.8; zlib(?: libpng)? licen[cs]e
libpng; libpng; 5; 0.8; libpng licen[cs]e
unlicense; unlicense; 5; 0.7; (?:the )?unlicense
boost-1.0; boost; 5; 0.7; boost software licen[cs]e
ofl; font; 5; 0.7; (?:sil )?open font licen[cs]e
psf-2.0; python; 5; 0.7; python software foundation licen[cs]e
postgresql; postgresql; 5; 0.8; postgresql licen[cs]e
openssl; openssl; 5; 0.8; openssl licen[cs]e
eupl; european; 5; 0.7; european union public licen[cs]e
ms-pl; microsoft; 5; 0.8; microsoft public licen[cs]e
ms-rl; microsoft; 5; 0.8; microsoft reciprocal licen[cs]e
odbl; database; 5; 0.7; open database licen[cs]e
odc-by; attribution; 5; 0.7; open data commons attribution licen[cs]e
pddl; domain; 5; 0.7; (?:open data commons )?public domain dedication and licen[cs]e
ogl-uk; government; 5; 0.8; open government licen[cs]e(?: v?[1-3](?: 0)?)?
sleepycat; sleepycat; 5; 0.8; sleepycat licen[cs]e
ruby; ruby; 5; 0.7; ruby licen[cs]e
vim; vim; 5; 0.7; vim licen[cs]e
json; json; 5; 0.7; json licen[cs]e
beerware; beer,beerware; 5; 0.8; (?:beer ware|beerware)(?: licen[cs]e)?
creative-commons; creative; 5; 0.6; creative commons licen[cs]e
cc-by; attribution; 5; 0.8; creative commons attribution(?: licen[cs]e)?
reserved; reserved; 5; 0.9; (?:copyright|c)(?: c)? [0-9]{4}(?: \S+){1,6} all rights reserved
proprietary; proprietary; 5; 0.8; proprietary and confidential
proprietary; without; 5; 0.8; (?:no part of this|reproduction|redistribution)(?: \S+){1,12} without(?: the)?(?: express)?(?: prior)?(?: written)? (?:permission|consent)
proprietary; unauthorised,unauthorized; 5; 0.8; unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: \S+){0,6} (?:is )?(?:strictly )?prohibited
proprietary; trade; 5; 0.7; confidential and trade secrets?
public-domain; domain; 5; 0.8; (?:in|into|to) the public domain
gpl-2.0; gpl,gplv2,gpl2; 4; 0.8; (?:gnu )?(?:gplv2|gpl2|gpl v2|gpl 2|gpl version 2)(?: 0)?(?: only)?
gpl-2.0-or-later; gpl,gplv2; 4; 0.85; (?:gnu )?(?:gplv2|gpl v2|gpl 2|gpl 2 0) or later
gpl-3.0; gpl,gplv3,gpl3; 4; 0.8; (?:gnu )?(?:gplv3|gpl3|gpl v3|gpl 3|gpl version 3)(?: 0)?(?: only)?
gpl-3.0-or-later; gpl,gplv3; 4; 0.85; (?:gnu )?(?:gplv3|gpl v3|gpl 3|gpl 3 0) or later
lgpl-2.1; lgpl,lgplv2; 4; 0.8; (?:gnu )?(?:lgplv2 1|lgpl v2 1|lgpl 2 1)(?: only| or later)?
lgpl-3.0; lgpl,lgplv3; 4; 0.8; (?:gnu )?(?:lgplv3|lgpl v3|lgpl 3|lgpl 3 0)(?: only| or later)?
agpl-3.0; agpl,agplv3; 4; 0.8; (?:gnu )?(?:agplv3|agpl v3|agpl 3|agpl 3 0)(?: only| or later)?
mpl-1.1; mpl; 4; 0.8; mpl(?: v| version)? 1 1
mpl-2.0; mpl; 4; 0.8; mpl(?: v| version)? 2 0
epl-1.0; epl; 4; 0.8; epl(?: v| version)? 1 0
epl-2.0; epl; 4; 0.8; epl(?: v| version)? 2 0
cddl-1.0; cddl; 4; 0.8; cddl(?: v| version)? 1 0
apache-2.0; asl; 4; 0.7; asl(?: v| version)? 2 0
apache-2.0; apache2; 4; 0.7; apache2(?: 0)?(?: licen[cs]ed?)?
boost-1.0; bsl; 4; 0.7; bsl 1 0
ofl-1.1; ofl; 4; 0.8; ofl(?: v| version)? 1 1
eupl-1.2; eupl; 4; 0.8; eupl(?: v| version)? 1 2
osl-3.0; osl; 4; 0.8; osl(?: v| version)? 3 0
afl-3.0; afl; 4; 0.8; afl(?: v| version)? 3 0
ms-pl; ms; 4; 0.6; ms pl
cc-by; cc; 4; 0.8; cc by [1-4] [05]
cc-by-sa; cc; 4; 0.8; cc by sa(?: [1-4] [05])?
cc-by-nc; cc; 4; 0.8; cc by nc(?: [1-4] [05])?
cc-by-nd; cc; 4; 0.8; cc by nd(?: [1-4] [05])?
cc-by-nc-sa; cc; 4; 0.85; cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd; cc; 4; 0.85; cc by nc nd(?: [1-4] [05])?
reserved; reserved; 4; 0.8; all rights reserved
some-reserved; reserved; 4; 0.6; some rights reserved
no-reserved; reserved; 4; 0.6; no rights reserved
isc; isc; 3; 0.4; isc
gpl; gpl; 3; 0.5; (?:gnu )?gpl
lgpl; lgpl; 3; 0.5; (?:gnu )?lgpl
agpl; agpl; 3; 0.5; (?:gnu )?agpl
mpl; mpl; 3; 0.3; mpl licen[cs]ed?
cddl; cddl; 3; 0.5; cddl
wtfpl; wtfpl; 3; 0.8; wtfpl
0bsd; 0bsd; 3; 0.7; 0bsd
cc0-1.0; cc0; 3; 0.7; cc0
cecill; cecill; 3; 0.6; cecill
eupl; eupl; 3; 0.5; eupl
cc-by; cc; 3; 0.5; cc by
public-domain; domain; 3; 0.5; public domain
copyleft; copyleft; 2; 0.3; copyleft
open-source; source; 2; 0.3; open source licen[cs]ed?
warranty; warranty,warranties; 2; 0.3; without warrant(?:y|ies)(?: or conditions)? of any kind
warranty; warranty; 2; 0.3; (?:absolutely )?no warranty
copyright; copyright; 2; 0.4; copyright(?: c)? [0-9]{4}(?: [0-9]{4})?
trademark; trademark,trademarks; 2; 0.2; (?:registered )?trademarks? of
"""
