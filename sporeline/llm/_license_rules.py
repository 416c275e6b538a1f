"""Signatures of licences, written by hand: label, priority, keyword, and a regex over words in lower case parted by single spaces.

A rule's regex is tried only on texts that hold its keyword, which every match of the regex holds. Priorities: 9 a machine-readable
tag, 8 a licence's own sentence, 7 its address, 6 its name with a version, 5 its name, 3 a short name, 2 a phrase that any licence may have.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

SIGNATURES = """
# GNU
gpl-1.0          8 free software foundation    published by the free software foundation (?:either )?version 1(?: of the license)?
gpl-1.0          6 general public license      gnu general public license (?:version|v) ?1(?: 0)?
gpl-1.0          3 gpl                         gpl(?: ?v)? ?1(?: 0)?(?: only| or later)?
gpl-1.0          7 gpl 1 0                     gnu org licenses (?:old licenses )?gpl 1 0(?: html| txt)?
gpl-2.0          8 free software foundation    general public license as published by the free software foundation (?:either )?version 2(?: of the license)?
gpl-2.0          8 free software foundation    terms of the gnu general public license version 2(?: only)? as published by the free software foundation
gpl-2.0          8 june 1991                   gnu general public license version 2 june 1991
gpl-2.0          6 general public license      (?:gnu )?general public license (?:version|v) ?2(?: 0)?(?: only)?
gpl-2.0          3 gpl                         gpl(?: ?v)? ?2(?: 0)?(?: only| or later)?
gpl-2.0          7 gpl 2 0                     gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
gpl-3.0          8 free software foundation    general public license as published by the free software foundation (?:either )?version 3(?: of the license)?
gpl-3.0          8 june 2007                   gnu general public license version 3 29 june 2007
gpl-3.0          6 general public license      (?:gnu )?general public license (?:version|v) ?3(?: 0)?(?: only)?
gpl-3.0          3 gpl                         gpl(?: ?v)? ?3(?: 0)?(?: only| or later)?
gpl-3.0          7 gpl 3 0                     gnu org licenses gpl 3 0(?: html| txt)?
gpl-or-later     8 at your option              version [123](?: 0)? of the license or at your option any later version
gpl-or-later     8 any later version           general public license (?:version|v) ?[123](?: 0)? or (?:at your option )?any later version
gpl-or-later     3 or later                    gpl(?: ?v)? ?[123](?: 0)? or later
gpl              8 general public license      distributed under the terms of the gnu general public license
gpl              8 general public license      you should have received a copy of the gnu general public license along with this program
gpl              8 general public license      see the gnu general public license for more details
gpl              5 general public license      gnu general public license
gpl              3 gnu gpl                     gnu gpl
gpl              7 gnu org copyleft            gnu org copyleft gpl html
gpl-exception    8 exception                   gcc runtime library exception(?: version 3 1)?
gpl-exception    8 exception                   classpath exception(?: 2 0)?
gpl-exception    8 as a special exception      as a special exception (?:the copyright holders of this library give|if you link|linking this library)
gpl-exception    6 exception                   (?:autoconf|bison|font|openvpn openssl) exception
lgpl-2.0         6 library general public      gnu library general public license(?: (?:version|v) ?2(?: 0)?)?
lgpl-2.0         8 june 1991                   gnu library general public license version 2 june 1991
lgpl-2.0         3 lgpl                        lgpl(?: ?v)? ?2 0(?: only| or later)?
lgpl-2.1         8 free software foundation    lesser general public license as published by the free software foundation (?:either )?version 2 1(?: of the license)?
lgpl-2.1         8 february 1999               gnu lesser general public license version 2 1 february 1999
lgpl-2.1         6 lesser general public       (?:gnu )?lesser general public license (?:version|v) ?2 1
lgpl-2.1         3 lgpl                        lgpl(?: ?v)? ?2 1(?: only| or later)?
lgpl-2.1         7 lgpl 2 1                    gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?
lgpl-3.0         8 free software foundation    lesser general public license as published by the free software foundation (?:either )?version 3(?: of the license)?
lgpl-3.0         6 lesser general public       (?:gnu )?lesser general public license (?:version|v) ?3(?: 0)?
lgpl-3.0         3 lgpl                        lgpl(?: ?v)? ?3(?: 0)?(?: only| or later)?
lgpl-3.0         7 lgpl 3 0                    gnu org licenses lgpl 3 0(?: html| txt)?
lgpl             8 lesser general public       you should have received a copy of the gnu lesser general public license
lgpl             5 lesser general public       gnu lesser general public license
lgpl             3 gnu lgpl                    gnu lgpl
agpl-1.0         6 affero                      affero general public license (?:version|v) ?1(?: 0)?
agpl-3.0         8 affero                      affero general public license as published by the free software foundation (?:either )?version 3(?: of the license)?
agpl-3.0         8 affero                      gnu affero general public license version 3 19 november 2007
agpl-3.0         6 affero                      (?:gnu )?affero general public license (?:version|v) ?3(?: 0)?
agpl-3.0         3 agpl                        agpl(?: ?v)? ?3(?: 0)?(?: only| or later)?
agpl-3.0         7 agpl 3 0                    gnu org licenses agpl 3 0(?: html| txt)?
agpl             5 affero                      (?:gnu )?affero general public license
gfdl-1.1         6 free documentation          gnu free documentation license (?:version|v) ?1 1
gfdl-1.2         6 free documentation          gnu free documentation license (?:version|v) ?1 2
gfdl-1.3         6 free documentation          gnu free documentation license (?:version|v) ?1 3
gfdl             8 invariant sections          with no invariant sections no front cover texts and no back cover texts
gfdl             5 free documentation          gnu free documentation license
gfdl             7 gnu org                     gnu org (?:copyleft|licenses) fdl(?: 1 [0-9])?(?: html)?
# MIT and relatives
mit              8 permission is hereby        permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit              8 the above copyright         the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit              8 the software is provided    the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit              8 mit license                 (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?mit license
mit              5 mit license                 (?:the )?mit license(?: mit)?
mit              5 expat                       (?:the )?expat license
mit              7 licenses mit                opensource org licenses mit(?: license php| license html| license)?
mit              3 mit licensed                mit licensed
mit              3 license                     license (?:is )?mit
mit-0            6 no attribution              mit no attribution(?: license)?
x11              5 x11 license                 (?:the )?(?:mit )?x11 license
x11              8 x consortium                except as contained in this notice the name of the x consortium shall not be used
mit-cmu          6 cmu                         (?:mit )?cmu license
hpnd             5 historical permission       historical permission notice and disclaimer
hpnd             8 without fee                 permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
isc              8 with or without fee         permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc              5 isc license                 (?:the )?isc license
isc              7 licenses isc                opensource org licenses isc(?: license(?: txt)?)?
isc              8 the author disclaims        the software is provided as is and the author disclaims all warranties with regard to this software
ncsa             5 ncsa                        (?:university of illinois )?(?:ncsa )?open source license ncsa
ncsa             8 university of illinois      university of illinois ncsa open source license
zlib             8 altered source versions     altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib             8 the origin of this          the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib             5 zlib                        (?:the )?zlib(?: libpng)? license
libpng           5 libpng                      (?:the )?libpng license(?: version 2)?
curl             5 curl license                (?:the )?curl license
boost-1.0        6 boost software              boost software license (?:version|v) ?1 0
boost            5 boost software              boost software license
boost-1.0        7 license 1 0 txt             boost org license 1 0 txt
ntp              5 ntp license                 (?:the )?ntp license
icu              5 icu license                 (?:the )?icu license
unicode          5 unicode                     unicode(?: inc)? license agreement(?: data files and software)?
unicode          7 unicode org                 unicode org (?:copyright|license)(?: html| txt)?
# BSD
bsd-2-clause     8 this list of conditions     redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
bsd-2-clause     8 source code must retain     redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-2-clause     6 bsd                         (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: license)?
bsd-3-clause     8 endorse or promote          (?:neither the name of [a-z0-9 ]{1,120}|the names? of [a-z0-9 ]{1,120} may not) (?:nor the names of its contributors may )?be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause     6 bsd                         (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: license)?
bsd-3-clause     7 licenses bsd                opensource org licenses bsd 3 clause
bsd-2-clause     7 licenses bsd                opensource org licenses bsd (?:2 clause|license php)
bsd-4-clause     8 all advertising materials   all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-4-clause     6 bsd                         (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)(?: license)?
0bsd             6 bsd                         (?:0bsd|bsd zero clause|zero clause bsd)(?: license)?
bsd              8 redistribution and use      redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd              5 bsd license                 (?:the )?bsd license
bsd              5 bsd style                   bsd style license
bsd-patent       6 bsd                         bsd 2 clause plus patent(?: license)?
# Apache
apache-1.0       6 apache                      apache (?:software )?license (?:version|v) ?1 0
apache-1.1       6 apache                      apache (?:software )?license (?:version|v) ?1 1
apache-2.0       8 apache license              licensed under the apache license version 2 0(?: the license)?
apache-2.0       8 in compliance with          you may not use this file except in compliance with the license
apache-2.0       8 as is basis                 software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
apache-2.0       8 january 2004                apache license version 2 0 january 2004
apache-2.0       6 apache                      apache (?:software |public )?license (?:(?:version|v) ?)?2(?: 0)?
apache-2.0       6 apache                      apache 2(?: 0)?(?: license| licensed)?
apache-2.0       7 license 2 0                 apache org licenses license 2 0(?: txt| html)?
apache           8 apache software foundation  licensed to the apache software foundation asf under one or more contributor license agreements
apache           8 apache software foundation  this product includes software developed by the apache software foundation
apache           5 apache                      (?:the )?apache (?:software )?license
# Mozilla, Eclipse, Sun, IBM and other weak copyleft
mpl-1.0          6 mozilla public              mozilla public license (?:version|v) ?1 0
mpl-1.1          6 mozilla public              mozilla public license (?:version|v) ?1 1
mpl-1.1          8 mozilla public              the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0          8 mozilla public              this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0          6 mozilla public              mozilla public license (?:(?:version|v) ?)?2 0
mpl-2.0          3 mpl                         mpl(?: ?v)? ?2(?: 0)?
mpl-1.1          3 mpl                         mpl(?: ?v)? ?1 1
mpl-2.0          7 mpl 2 0                     mozilla org (?:en us )?mpl 2 0(?: txt)?
mpl              5 mozilla public              mozilla public license
mpl-exception    8 secondary licenses          incompatible with secondary licenses as defined by the mozilla public license
epl-1.0          6 eclipse public              eclipse public license (?:(?:version|v) ?)?1 0
epl-2.0          6 eclipse public              eclipse public license (?:(?:version|v) ?)?2 0
epl-1.0          7 epl                         eclipse org legal epl v10(?: html)?
epl-2.0          7 epl                         eclipse org legal epl (?:2 0|v20)(?: html)?
epl              5 eclipse public              eclipse public license
edl-1.0          5 eclipse distribution        eclipse distribution license(?: (?:version|v) ?1 0)?
cddl-1.0         6 common development          common development and distribution license(?: cddl)? (?:version|v) ?1 0
cddl-1.1         6 common development          common development and distribution license(?: cddl)? (?:version|v) ?1 1
cddl             5 common development          common development and distribution license
cddl             3 cddl                        cddl(?: license)?
cpl-1.0          5 common public license       common public license(?: (?:version|v) ?1 0)?
cpal-1.0         5 common public attribution   common public attribution license(?: (?:version|v) ?1 0)?
ipl-1.0          5 ibm public license          ibm public license(?: (?:version|v) ?1 0)?
spl-1.0          5 sun public license          sun public license(?: (?:version|v) ?1 0)?
npl-1.1          5 netscape public             netscape public license(?: (?:version|v) ?1 [01])?
apsl-2.0         6 apple public source         apple public source license (?:version|v) ?2 0
apsl             5 apple public source         apple public source license
osl-3.0          6 open software license       open software license (?:version|v) ?3 0
osl              5 open software license       open software license
afl-3.0          6 academic free               academic free license (?:version|v) ?3 0
afl              5 academic free               academic free license
eupl-1.1         6 european union public       european union public licence (?:(?:version|v) ?)?1 1
eupl-1.2         6 european union public       european union public licence (?:(?:version|v) ?)?1 2
eupl             5 european union public       european union public licen[cs]e
eupl             3 eupl                        eupl(?:(?: ?v)? ?1 [0-9])?
cecill-2.1       6 cecill                      cecill(?: version| v)? ?2 1
cecill-b         6 cecill b                    cecill b(?: license)?
cecill-c         6 cecill c                    cecill c(?: license)?
cecill           5 cecill                      (?:the )?cecill (?:free software )?license
artistic-1.0     6 artistic license            artistic license (?:(?:version|v) ?)?1 0
artistic-2.0     6 artistic license            artistic license (?:(?:version|v) ?)?2(?: 0)?
artistic         5 artistic license            (?:the )?artistic license
perl             8 same terms as perl          under the same terms as perl(?: 5)? itself
ms-pl            5 microsoft public            microsoft public license(?: ms pl)?
ms-rl            5 microsoft reciprocal        microsoft reciprocal license(?: ms rl)?
python-2.0       5 python software foundation  python software foundation license(?: agreement)?(?: (?:version|v) ?2)?
python-2.0       3 psf license                 psf license(?: agreement)?(?: (?:version|v) ?2)?
python-2.0       6 python license              python license 2(?: 0)?
php-3.01         6 php license                 php license (?:version|v) ?3 01
php              5 php license                 (?:the )?php license
ruby             5 ruby license                (?:the )?ruby license
ruby             8 ruby                        under the same terms as ruby
openssl          5 openssl license             (?:the )?openssl license
openssl          8 openssl toolkit             this product includes software developed by the openssl project for use in the openssl toolkit
ssleay           8 eric young                  this product includes cryptographic software written by eric young
postgresql       5 postgresql                  (?:the )?postgresql licen[cs]e
sleepycat        5 sleepycat                   (?:the )?sleepycat license
vim              5 vim license                 (?:the )?vim license
w3c              5 w3c                         w3c software (?:notice and )?(?:document )?(?:notice and )?license
zpl-2.1          5 zope public                 zope public license(?: (?:version|v) ?2 [01])?
qpl-1.0          5 q public license            q public license(?: (?:version|v) ?1 0)?
latex-1.3c       5 latex project public        latex project public license(?: (?:version|v) ?1 [0-3]c?)?
mulan-2.0        5 mulan                       mulan (?:psl|permissive software license)(?:(?: ?v)? ?2)?
upl-1.0          5 universal permissive        universal permissive license(?: (?:version|v) ?1 0)?
blueoak-1.0.0    5 blue oak                    blue oak model license(?: 1 0 0)?
intel            5 intel open source           intel open source license
nasa-1.3         5 nasa open source            nasa open source agreement(?: (?:version|v) ?1 3)?
ecl-2.0          5 educational community       educational community license(?: (?:version|v) ?2 0)?
odc-by           5 open data commons           open data commons attribution license(?: (?:version|v) ?1 0)?
odbl             5 open database               (?:open data commons )?open database license(?: odbl)?(?: (?:version|v) ?1 0)?
pddl             5 public domain dedication    (?:open data commons )?public domain dedication and licen[cs]e(?: pddl)?
cdla-permissive  5 community data              community data license agreement permissive(?:(?: version| v)? ?[12] 0)?
cdla-sharing     5 community data              community data license agreement sharing(?:(?: version| v)? ?1 0)?
ofl-1.1          6 sil open font               sil open font license(?: ofl)? (?:version|v) ?1 1
ofl              5 open font license           (?:sil )?open font license
ofl              7 scripts sil org             scripts sil org ofl
ubuntu-font      5 ubuntu font                 ubuntu font licen[cs]e(?:(?: version| v)? ?1 0)?
bitstream-vera   5 bitstream vera              bitstream vera fonts copyright
# Creative Commons: what the base phrases say of attribution, and all further terms
cc0-1.0          6 cc0                         cc0(?: 1 0)?(?: universal)?
cc0-1.0          6 cc zero                     cc zero(?: 1 0)?
cc0-1.0          7 publicdomain zero           creativecommons org publicdomain zero 1 0
cc0-1.0          8 creative commons            creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc-pdm           7 publicdomain mark           creativecommons org publicdomain mark 1 0
cc-by-nc-nd      6 by nc nd                    cc by nc nd(?: [1-4] [05])?(?: license| international)?
cc-by-nc-sa      6 by nc sa                    cc by nc sa(?: [1-4] [05])?(?: license| international)?
cc-by-nc         6 by nc                       cc by nc(?: [1-4] [05])?(?: license| international)?
cc-by-nd         6 by nd                       cc by nd(?: [1-4] [05])?(?: license| international)?
cc-by-sa         6 by sa                       cc by sa(?: [1-4] [05])?(?: license| international)?
cc-by-1.0        6 cc by 1                     cc by 1 0(?: generic)?
cc-by-2.0        6 cc by 2 0                   cc by 2 0(?: generic)?
cc-by-2.5        6 cc by 2 5                   cc by 2 5(?: generic)?
cc-by-3.0        6 cc by 3                     cc by 3 0(?: unported)?
cc-by-4.0        6 cc by 4                     cc by 4 0(?: international)?
cc-by-nc-nd      8 creative commons            creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: license)?
cc-by-nc-sa      8 creative commons            creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: license)?
cc-by-nc         8 creative commons            creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: license)?
cc-by-nd         8 creative commons            creative commons attribution no ?deriv(?:s|atives|ative works)(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: license)?
cc-by-sa         8 creative commons            creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: license)?
cc-by            8 creative commons            creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: license)?
cc-by-nc-nd      7 licenses by nc nd           creativecommons org licenses by nc nd [1-4] [05]
cc-by-nc-sa      7 licenses by nc sa           creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc         7 licenses by nc              creativecommons org licenses by nc [1-4] [05]
cc-by-nd         7 licenses by nd              creativecommons org licenses by nd [1-4] [05]
cc-by-sa         7 licenses by sa              creativecommons org licenses by sa [1-4] [05]
cc-by            7 licenses by                 creativecommons org licenses by [1-4] [05]
cc               5 creative commons            creative commons licen[cs]e
cc               2 creative commons            creative commons
# Public domain and its like
unlicense        8 public domain               this is free and unencumbered software released into the public domain
unlicense        8 anyone is free              anyone is free to copy modify publish use compile sell or distribute this software
unlicense        5 unlicense                   (?:the )?unlicense(?: license)?
unlicense        7 unlicense org               unlicense org
wtfpl            5 what the fuck               do what the fuck you want to public license
wtfpl            3 wtfpl                       wtfpl(?:(?: ?v)? ?2)?
beerware         5 beer                        (?:the )?beer ?ware license
public-domain    8 public domain               (?:placed|released|dedicated|put) (?:in|into|to) the public domain
public-domain    8 public domain               (?:work|text|book|image|file) is in the public domain
public-domain    2 public domain               public domain
# Source available, model and commercial terms
sspl-1.0         5 server side public          server side public license(?: (?:version|v) ?1)?
sspl-1.0         3 sspl                        sspl(?: 1 0)?
busl-1.1         5 business source             business source license(?:(?: version| v)? ?1 1)?
elastic-2.0      5 elastic license             elastic license(?:(?: version| v)? ?2(?: 0)?)?
confluent        5 confluent community         confluent community license(?: agreement)?
commons-clause   5 commons clause              commons clause(?: license condition)?
polyform         5 polyform                    polyform (?:noncommercial|strict|shield|small business|free trial|perimeter) license
prosperity       5 prosperity public           prosperity public license
parity           5 parity public               parity public license
json             8 for good not evil           the software shall be used for good not evil
openrail-m       5 openrail                    (?:creativeml |bigscience )?openrail(?: m)?(?: license)?
llama            5 community license           llama [0-9](?: [0-9])? community license(?: agreement)?
gemma            5 gemma terms                 gemma terms of use
proprietary      8 confidential                (?:proprietary and confidential|confidential and proprietary)
proprietary      8 unauthorized                unauthorized (?:copying|reproduction|use|distribution) of this (?:file|document|work|software)(?: via any medium)? is (?:strictly )?prohibited
proprietary      8 no part of this             no part of this (?:publication|book|work|document) may be reproduced
proprietary      8 may not be                  may not be (?:reproduced|copied|published|broadcast|rewritten) or redistributed without (?:prior )?(?:written )?permission
proprietary      5 commercial license          commercial license(?: agreement)?
eula             5 end user licen              end user licen[cs]e agreement
non-commercial   8 non commercial              for (?:personal and |private and |research and )?non commercial (?:use|purposes)(?: only)?
non-commercial   8 purposes only               for (?:academic|research|educational) purposes only
fair-use         5 fair use                    fair use(?: notice)?
crown            5 crown copyright             crown copyright
ogl-uk-3.0       5 open government             open government licen[cs]e(?: (?:version|v) ?3(?: 0)?)?
etalab-2.0       5 licence ouverte             licence ouverte(?: 2 0)?
dl-de-by-2.0     5 datenlizenz                 datenlizenz deutschland namensnennung(?: (?:version )?2 0)?
# Other languages, and what any licence may say
reserved         8 rechte vorbehalten          alle rechte vorbehalten
reserved         8 droits                      tous droits réservés
reserved         8 derechos reservados         todos los derechos reservados
reserved         8 direitos reservados         todos os direitos reservados
reserved         8 diritti riservati           tutti i diritti riservati
reserved         8 rechten voorbehouden        alle rechten voorbehouden
copyright        3 copyright                   copyright (?:c )?(?:by )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?
copyright        2 copyright                   copyrighted (?:material|work)
other            2 licensed under              licensed under(?: the)?(?: terms of)?
other            2 released under              released under(?: the)?(?: terms of)?
other            2 license agreement           license agreement
other            2 terms of the license        under the terms of the license
"""

#: Names that SPDX tags may give, in the tag's words; each gets a rule of its own from one pattern.
SPDX = """
0bsd afl-3.0 agpl-1.0 agpl-3.0 apache-1.0 apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0 blueoak-1.0.0 bsd-2-clause bsd-3-clause bsd-4-clause bsl-1.0 cc-by-1.0 cc-by-2.0
cc-by-3.0 cc-by-4.0 cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0 ecl-2.0 epl-1.0 epl-2.0
eupl-1.1 eupl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-3.0 hpnd isc lgpl-2.0 lgpl-2.1 lgpl-3.0 mit mit-0 mpl-1.1 mpl-2.0 ms-pl ncsa odbl-1.0 ofl-1.1 openssl osl-3.0 php-3.01 postgresql
python-2.0 sspl-1.0 unlicense upl-1.0 w3c wtfpl x11 zlib zpl-2.1
""".split()
TAG = "spdx license identifier"


@dataclass(frozen=True)
class Signature:
    label: str
    priority: int
    keyword: str
    pattern: str


def signatures() -> list[Signature]:
    """All rules, in order: of detections that are alike in all else, the earlier rule's stays."""
    line = re.compile(r"(\S+)\s+(\d)\s+(\S+(?: \S+)*)\s{2,}(\S.*)")
    own = [line.fullmatch(x) for x in SIGNATURES.strip().split("\n") if not x.startswith("#")]
    if not all(own):
        raise ValueError("a signature is a label, a priority, a keyword and a regex")
    tags = [Signature(name, 9, TAG, f"{TAG} {' '.join(re.findall('[a-z0-9]+', name))}(?: only| or later)?") for name in SPDX]
    return tags + [Signature(m[1], int(m[2]), m[3], m[4].strip()) for m in own]
