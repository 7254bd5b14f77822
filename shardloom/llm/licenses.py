"""License scans by ordered signature rules.

A rule is a hand-written regex over normalised words (lower-case, one space between words), a priority, a label
and the keyword without which it cannot match.  Words are hashed and looked up in the keyword set;
only the surroundings of keyword hits (REACH words to both sides, more than any rule spans) are
turned into strings, and only rules whose keyword stands there are tried.  Overlaps are resolved by
priority and containment: a detection inside another of higher priority, or of the same priority and
longer (then earlier in rule order), is dropped.  Detections of base rules are never dropped.

Defined results: null and empty texts have no detections and score 0; repeated rows each get their
own result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words kept on both sides of a keyword.
REACH = 48
#: How sure a detection of each priority is.
CONFIDENCE = {1: 0.5, 2: 0.8, 3: 0.9, 4: 0.97, 5: 0.99}

# The phrases and labels of the base detections.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: A tag names one identifier, or several joined by and, or, with.
SPDX = r"spdx license identifier (?:(?:\S+ ){1,8}?(?:and|or|with) )?"

#: Priority 4, keyword spdx: what stands after the tag (SPDX), as published identifiers normalise to words.
SPDX_RULES = """
mit | mit(?! 0)
mit-0 | mit 0
apache-1.0 | apache 1 0
apache-1.1 | apache 1 1
apache-2 | apache 2 0
gpl-1 | gpl 1 0(?: only| or later)?
gpl-2 | gpl 2 0(?: only| or later)?
gpl-3 | gpl 3 0(?: only| or later)?
lgpl-2 | lgpl 2 0(?: only| or later)?
lgpl-2.1 | lgpl 2 1(?: only| or later)?
lgpl-3 | lgpl 3 0(?: only| or later)?
agpl-1 | agpl 1 0(?: only| or later)?
agpl-3 | agpl 3 0(?: only| or later)?
gfdl-1.1 | gfdl 1 1(?: (?:no )?invariants)?(?: only| or later)?
gfdl-1.2 | gfdl 1 2(?: (?:no )?invariants)?(?: only| or later)?
gfdl-1.3 | gfdl 1 3(?: (?:no )?invariants)?(?: only| or later)?
0bsd | 0bsd
bsd-1-clause | bsd 1 clause
bsd-2-clause | bsd 2 clause(?: patent| views)?
bsd-3-clause | bsd 3 clause(?: clear| attribution| lbnl)?
bsd-4-clause | bsd 4 clause(?: uc)?
isc | isc
zlib | zlib(?: acknowledgement)?
libpng-2 | libpng 2 0
boost-1 | bsl 1 0
business-source-1.1 | busl 1 1
mpl-1.0 | mpl 1 0
mpl-1.1 | mpl 1 1
mpl-2 | mpl 2 0(?: no copyleft exception)?
epl-1 | epl 1 0
epl-2 | epl 2 0
cddl-1 | cddl 1 0
cddl-1.1 | cddl 1 1
cpl-1 | cpl 1 0
ipl-1 | ipl 1 0
apsl-2 | apsl 2 0
artistic-1 | artistic 1 0(?: perl| cl8)?
artistic-2 | artistic 2 0
afl-3 | afl 3 0
osl-3 | osl 3 0
ecl-2 | ecl 2 0
efl-2 | efl 2 0
eupl-1.1 | eupl 1 1
eupl-1.2 | eupl 1 2
cecill-2.1 | cecill 2 1
cecill-b | cecill b
cecill-c | cecill c
unlicense | unlicense
wtfpl | wtfpl
cc0-1 | cc0 1 0
cc-by | cc by [1-4] [05]
cc-by-sa | cc by sa [1-4] [05]
cc-by-nd | cc by nd [1-4] [05]
cc-by-nc | cc by nc [1-4] [05]
cc-by-nc-sa | cc by nc sa [1-4] [05]
cc-by-nc-nd | cc by nc nd [1-4] [05]
pddl-1 | pddl 1 0
odbl-1 | odbl 1 0
odc-by-1 | odc by 1 0
ofl-1.0 | ofl 1 0(?: (?:no )?rfn)?
ofl-1.1 | ofl 1 1(?: (?:no )?rfn)?
postgresql | postgresql
python-2 | (?:psf|python) 2 0
ruby | ruby
php-3.01 | php 3 01
ms-pl | ms pl
ms-rl | ms rl
ncsa | ncsa
openssl | openssl
sspl-1 | sspl 1 0
elastic-2 | elastic 2 0
x11 | x11
curl | curl
vim | vim
w3c | w3c
blueoak-1 | blueoak 1 0 0
mulan-2 | mulanpsl 2 0
upl-1 | upl 1 0
unicode | unicode (?:3 0|dfs 201[56]|tou)
hpnd | hpnd
ntp | ntp
tcl | tcl
bzip2 | bzip2 1 0 6
"""

#: Other rules: priority | label | keyword | pattern.  Addresses, then sentences of the licenses' own texts and notices, then
#: grants and names with their versions, then bare mentions.
RULES = r"""
4 | mit | mit | opensource org licenses? mit(?: license)?(?: php| html)?
4 | apache-2 | apache | apache org licenses license 2 0(?: txt| html)?
4 | apache-1.1 | apache | apache org licenses license 1 1
4 | apache-2 | opensource | opensource org licenses apache 2 0
4 | gpl-2 | gnu | gnu org licenses old licenses gpl 2 0(?: en)?(?: html| txt)?
4 | gpl-3 | gnu | gnu org licenses gpl 3 0(?: en)?(?: html| txt)?
4 | gpl | gnu | gnu org (?:licenses gpl(?! 3)|copyleft gpl)(?: en)?(?: html| txt)?
4 | lgpl-2.1 | gnu | gnu org licenses old licenses lgpl 2 1(?: en)?(?: html| txt)?
4 | lgpl-3 | gnu | gnu org licenses lgpl 3 0(?: en)?(?: html| txt)?
4 | agpl-3 | gnu | gnu org licenses agpl(?: 3 0)?(?: en)?(?: html| txt)?
4 | gfdl-1.3 | gnu | gnu org licenses fdl(?: 1 3)?(?: en)?(?: html| txt)?
4 | bsd-2-clause | bsd | opensource org licenses? bsd 2 clause
4 | bsd-3-clause | bsd | opensource org licenses? bsd 3 clause
4 | bsd | bsd | opensource org licenses bsd license(?: php)?
4 | isc | isc | opensource org licenses? isc(?: license)?(?: txt)?
4 | mpl-1.1 | mozilla | mozilla org mpl (?:mpl )?1 1
4 | mpl-2 | mozilla | mozilla org (?:en us )?mpl 2 0
4 | epl-1 | eclipse | eclipse org (?:legal|org documents) epl v ?10
4 | epl-2 | eclipse | eclipse org legal epl (?:v20|2 0|v 2 0)
4 | boost-1 | boost | boost org license 1 0(?: txt)?
4 | unlicense | unlicense | unlicense org
4 | wtfpl | wtfpl | (?:www )?wtfpl net
4 | zlib | zlib | zlib net zlib license(?: html)?
4 | cddl-1 | cddl | opensource org licenses cddl ?1?
4 | artistic-2 | artistic | (?:perlfoundation org|opensource org licenses) artistic license 2 0
4 | ofl-1.1 | ofl | (?:scripts sil org|openfontlicense org) ofl
4 | ofl-1.1 | openfontlicense | openfontlicense org
4 | eupl-1.2 | eupl | joinup ec europa eu (?:\S+ ){0,4}eupl
4 | postgresql | postgresql | postgresql org about licen[cs]e
4 | php-3.01 | php | php net license 3 01(?: txt)?
4 | odbl-1 | opendatacommons | opendatacommons org licenses odbl(?: 1 0)?
4 | odc-by-1 | opendatacommons | opendatacommons org licenses by(?: 1 0)?
4 | pddl-1 | opendatacommons | opendatacommons org licenses pddl(?: 1 0)?
4 | cc0-1 | creativecommons | creativecommons org publicdomain zero 1 0
4 | public-domain | creativecommons | creativecommons org publicdomain mark 1 0
4 | cc-by | creativecommons | creativecommons org licenses by [1-4] [05]
4 | cc-by-sa | creativecommons | creativecommons org licenses by sa [1-4] [05]
4 | cc-by-nd | creativecommons | creativecommons org licenses by nd [1-4] [05]
4 | cc-by-nc | creativecommons | creativecommons org licenses by nc [1-4] [05]
4 | cc-by-nc-sa | creativecommons | creativecommons org licenses by nc sa [1-4] [05]
4 | cc-by-nc-nd | creativecommons | creativecommons org licenses by nc nd [1-4] [05]
4 | elastic-2 | elastic | elastic co licensing elastic license
4 | sspl-1 | mongodb | mongodb com licensing server side public license
3 | mit | obtaining | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
3 | mit | deal | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
3 | mit | substantial | the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software
3 | x11 | consortium | the name of the x consortium shall not be used in advertising
3 | isc | fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
3 | isc | fee | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
3 | 0bsd | fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)
3 | bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
3 | bsd | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
3 | bsd | redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
3 | bsd-3-clause | endorse | neither the names? of (?:the )?(?:\S+ ){1,14}may be used to endorse or promote products derived from this software
3 | bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
3 | apache-2 | compliance | you may not use this file except in compliance with the license you may obtain a copy of the license at(?! (?:\S+ ){0,3}mozilla)
3 | apache-2 | apache | licensed to the apache software foundation asf under one or more contributor license agreements
3 | apache-2 | perpetual | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|except as stated)
3 | apache-2 | apache | apache license version 2 0 january 2004
3 | apache-1.1 | apache | the names apache(?: server)? and apache software foundation must not be used to endorse
3 | gpl-1 | gnu | gnu general public license as published by the free software foundation either version 1
3 | gpl-2 | gnu | gnu general public license as published by the free software foundation either version 2
3 | gpl-3 | gnu | gnu general public license as published by the free software foundation either version 3
3 | gpl-2 | gnu | gnu general public license version 2 (?:only )?as published by the free software foundation
3 | gpl-3 | gnu | gnu general public license version 3 (?:only )?as published by the free software foundation
3 | gpl-2 | gnu | gnu general public license version 2 june 1991
3 | gpl-3 | gnu | gnu general public license version 3 29 june 2007
3 | gpl | gnu | you should have received a copy of the gnu general public license along with this (?:program|file|software|library)
3 | lgpl-2.1 | lesser | gnu lesser general public license as published by the free software foundation either version 2 1
3 | lgpl-3 | lesser | gnu lesser general public license as published by the free software foundation either version 3
3 | lgpl-2 | gnu | gnu library general public license as published by the free software foundation either version 2
3 | lgpl-2.1 | lesser | gnu lesser general public license version 2 1 february 1999
3 | lgpl-3 | lesser | gnu lesser general public license version 3 29 june 2007
3 | lgpl | lesser | you should have received a copy of the gnu lesser general public license along with this (?:program|file|software|library)
3 | agpl-3 | affero | gnu affero general public license as published by the free software foundation either version 3
3 | agpl-3 | affero | gnu affero general public license version 3 19 november 2007
3 | agpl | affero | you should have received a copy of the gnu affero general public license along with this (?:program|file|software)
3 | gfdl-1.2 | gnu | gnu free documentation license version 1 2
3 | gfdl-1.3 | gnu | gnu free documentation license version 1 3
3 | gpl | warranty | this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability
3 | mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
3 | mpl-2 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
3 | mpl-2 | mpl | if a copy of the mpl was not distributed with this file you can obtain one at
3 | mpl-2 | mozilla | mozilla public license version 2 0 1 definitions
3 | epl-1 | eclipse | made available under the terms of the eclipse public license v ?1 0
3 | epl-2 | eclipse | made available under the terms of the eclipse public license (?:v )?2 0
3 | cddl-1 | cddl | subject to the terms of the common development and distribution license(?: the license)? (?:\S+ ){0,12}cddl
3 | cddl-1 | development | the contents of this file are subject to the terms of the common development and distribution license
3 | zlib | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
3 | zlib | altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
3 | boost-1 | boost | distributed under the boost software license version 1 0
3 | boost-1 | organization | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
3 | unlicense | unencumbered | this is free and unencumbered software released into the public domain
3 | unlicense | anyone | anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary
3 | wtfpl | fuck | you just do what the fuck you want to
3 | artistic-1 | artistic | the artistic license preamble the intent of this document is to state the conditions
3 | artistic-2 | artistic | the artistic license 2 0 copyright c 2000 2006 the perl foundation
3 | artistic-1 | artistic | same terms as perl itself (?:\S+ ){0,10}artistic license
3 | perl | perl | (?:you can|you may|can) redistribute it and or modify it under the same terms as perl itself
3 | postgresql | postgresql | postgresql database management system formerly known as postgres
3 | postgresql | agreement | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
3 | hpnd | supporting | permission to use copy modify and distribute this software and its documentation for any purpose (?:\S+ ){0,8}is hereby granted (?:\S+ ){0,14}supporting documentation
3 | python-2 | python | python software foundation license version 2
3 | python-2 | psf | this license agreement is between the python software foundation psf and the individual or organization
3 | openssl | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
3 | ncsa | illinois | university of illinois ncsa open source license
3 | ms-pl | microsoft | microsoft public license ms pl this license governs use of the accompanying software
3 | ms-rl | microsoft | microsoft reciprocal license ms rl this license governs use of the accompanying software
3 | ofl-1.1 | font | this font software is licensed under the sil open font license version 1 1
3 | ofl-1.1 | sil | sil open font license version 1 1 26 february 2007
3 | eupl-1.2 | eupl | licensed under the eupl(?: version)? (?:v )?1 2
3 | eupl-1.1 | eupl | licensed under the eupl(?: version)? (?:v )?1 1
3 | cecill-2.1 | cecill | governed by the cecill license under french law
3 | cecill-b | cecill | governed by the cecill b license under french law
3 | cecill-c | cecill | governed by the cecill c license under french law
3 | cc-by | creative | this work is licensed under (?:a |the )?creative commons attribution [1-4] [05] (?:international|unported|generic)
3 | cc-by-sa | creative | this work is licensed under (?:a |the )?creative commons attribution share ?alike [1-4] [05]
3 | cc-by-nd | creative | this work is licensed under (?:a |the )?creative commons attribution no ?deriv(?:ative)?s(?: works)? [1-4] [05]
3 | cc-by-nc | creative | this work is licensed under (?:a |the )?creative commons attribution non ?commercial [1-4] [05]
3 | cc-by-nc-sa | creative | this work is licensed under (?:a |the )?creative commons attribution non ?commercial share ?alike [1-4] [05]
3 | cc-by-nc-nd | creative | this work is licensed under (?:a |the )?creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)? [1-4] [05]
3 | cc-by | creative | by exercising the licensed rights (?:\S+ ){0,14}creative commons attribution [1-4] 0
3 | cc0-1 | cc0 | to the extent possible under law (?:\S+ ){1,14}cc0
3 | cc0-1 | waived | to the extent possible under law (?:\S+ ){1,10}(?:has|have) waived all copyright and related or neighboring rights
3 | cc0-1 | affirmer | affirmer hereby overtly fully permanently irrevocably and unconditionally waives
3 | odbl-1 | database | made available under the open database license
3 | pddl-1 | dedication | made available under the public domain dedication and license
3 | sspl-1 | server | server side public license version 1
3 | business-source-1.1 | business | business source license 1 1
3 | elastic-2 | elastic | elastic license 2 0
3 | commons-clause | commons | commons clause license condition v1 0
3 | proprietary | proprietary | (?:confidential and proprietary|proprietary and confidential)
3 | proprietary | unauthorized | unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document|material) (?:\S+ ){0,6}(?:is )?(?:strictly )?prohibited
3 | public-domain | domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
3 | upl-1 | universal | the universal permissive license upl version 1 0
3 | mulan-2 | mulan | licensed under mulan psl v2
3 | w3c | w3c | w3c software (?:and document )?(?:notice and license|license)
3 | unicode | unicode | unicode inc license agreement data files and software
3 | vim | vim | vim license (?:\S+ ){0,8}there are no restrictions on distributing unmodified copies
3 | beerware | beer | you can buy me a beer in return
3 | json | evil | the software shall be used for good not evil
2 | mit | mit | (?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of the )?mit(?: x11| expat)?(?: open source)? licen[cs]e
2 | mit | mit | (?:the )?mit licen[cs]e(?: mit)?
2 | mit | expat | (?:the )?expat licen[cs]e
2 | mit-0 | mit | mit no attribution(?: license)?
2 | apache-2 | apache | apache(?: software)?(?: license| licence)(?: version| v)? ?v?2(?: 0)?
2 | apache-2 | apache | apache v?2(?: 0)? licen[cs]e
2 | apache-2 | asl | asl (?:v )?2 0
2 | apache-1.1 | apache | apache(?: software)? license(?: version| v)? 1 1
2 | gpl-1 | gpl | gpl ?(?:version |v )?v?1(?: 0)?(?! [0-9])
2 | gpl-2 | gpl | (?:gnu )?gpl(?: version| v)? v?2(?: 0)?(?: only| or later)?(?! [1-9])
2 | gpl-3 | gpl | (?:gnu )?gpl(?: version| v)? v?3(?: 0)?(?: only| or later)?
2 | gpl-2 | gplv2 | gplv2
2 | gpl-3 | gplv3 | gplv3
2 | gpl-2 | gpl2 | gpl2
2 | gpl-3 | gpl3 | gpl3
2 | gpl-2 | gnu | gnu general public licen[cs]e(?: gpl)?(?: version| v) ?v?2(?: 0)?(?! [1-9])
2 | gpl-3 | gnu | gnu general public licen[cs]e(?: gpl)?(?: version| v) ?v?3(?: 0)?
2 | lgpl-2.1 | lgpl | (?:gnu )?lgpl(?: version| v)? v?2 1(?: only| or later)?
2 | lgpl-3 | lgpl | (?:gnu )?lgpl(?: version| v)? v?3(?: 0)?(?: only| or later)?
2 | lgpl-3 | lgplv3 | lgplv3
2 | lgpl-2.1 | lesser | (?:gnu )?lesser general public licen[cs]e(?: lgpl)?(?: version| v) ?v?2 1
2 | lgpl-3 | lesser | (?:gnu )?lesser general public licen[cs]e(?: lgpl)?(?: version| v) ?v?3(?: 0)?
2 | agpl-3 | agpl | (?:gnu )?agpl(?: version| v)? v?3(?: 0)?(?: only| or later)?
2 | agpl-3 | agplv3 | agplv3
2 | agpl-3 | affero | (?:gnu )?affero general public licen[cs]e(?: version| v) ?v?3(?: 0)?
2 | bsd-2-clause | bsd | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd) ?(?:licen[cs]e)?
2 | bsd-3-clause | bsd | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?
2 | bsd-4-clause | bsd | (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)(?: licen[cs]e)?
2 | 0bsd | 0bsd | 0bsd(?: licen[cs]e)?
2 | isc | isc | (?:the )?isc licen[cs]e
2 | mpl-1.1 | mpl | mpl(?: version| v)? 1 1
2 | mpl-2 | mpl | mpl(?: version| v)? v?2(?: 0)?
2 | mpl-1.1 | mozilla | mozilla public licen[cs]e(?: mpl)?(?: version| v)? 1 1
2 | mpl-2 | mozilla | mozilla public licen[cs]e(?: mpl)?(?: version| v)? ?v?2(?: 0)?
2 | epl-1 | eclipse | eclipse public licen[cs]e(?: epl)?(?: version| v)? ?v?1(?: 0)?
2 | epl-2 | eclipse | eclipse public licen[cs]e(?: epl)?(?: version| v)? ?v?2(?: 0)?
2 | epl-1 | epl | epl(?: v)? ?v?1 0
2 | epl-2 | epl | epl(?: v)? ?v?2 0
2 | cddl-1 | cddl | cddl(?: version| v)? ?v?1 0
2 | cpl-1 | common | common public licen[cs]e(?: cpl)?(?: version| v)? 1 0
2 | artistic-1 | artistic | artistic licen[cs]e(?: version| v)? 1 0
2 | artistic-2 | artistic | artistic licen[cs]e(?: version| v)? 2 0
2 | zlib | zlib | (?:the )?zlib(?: libpng)? licen[cs]e
2 | boost-1 | boost | boost software licen[cs]e(?: version| v)? ?1 0
2 | unlicense | unlicense | (?:the )?unlicense licen[cs]e
2 | wtfpl | wtfpl | wtfpl(?: version| v)? ?2?
2 | ofl-1.1 | ofl | (?:sil )?ofl(?: version| v)? ?1 1
2 | ofl-1.1 | font | sil open font licen[cs]e
2 | eupl-1.2 | eupl | eupl(?: version| v)? ?v?1 2
2 | ms-pl | microsoft | microsoft public licen[cs]e
2 | postgresql | postgresql | (?:the )?postgresql licen[cs]e
2 | python-2 | psf | psf licen[cs]e
2 | php-3.01 | php | php licen[cs]e(?: version| v)? 3 01
2 | ruby | ruby | (?:the )?ruby licen[cs]e
2 | odbl-1 | odbl | odbl(?: v)? ?1 0
2 | cc0-1 | cc0 | (?:creative commons )?cc0(?: licen[cs]e)?(?: 1 0)?(?: universal)?
2 | cc-by | cc | cc by [1-4] [05]
2 | cc-by-sa | cc | cc by sa(?: [1-4] [05])?
2 | cc-by-nd | cc | cc by nd(?: [1-4] [05])?
2 | cc-by-nc | cc | cc by nc [1-4] [05]
2 | cc-by-nc-sa | cc | cc by nc sa(?: [1-4] [05])?
2 | cc-by-nc-nd | cc | cc by nc nd(?: [1-4] [05])?
2 | cc-by | creative | creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?(?! non| share| no)
2 | cc-by-sa | creative | creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
2 | cc-by-nd | creative | creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1-4] [05])?
2 | cc-by-nc | creative | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?(?! share| no)
2 | cc-by-nc-sa | creative | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
2 | cc-by-nc-nd | creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: [1-4] [05])?
2 | proprietary | reserved | all rights (?:are )?reserved
1 | apache | apache | (?:under|by|with) (?:the |an )?apache licen[cs]e
1 | gpl | gpl | (?:under|by|with) (?:the |a )?(?:gnu )?gpl
1 | gpl | gnu | (?:under|by|with) (?:the |a )?gnu general public licen[cs]e
1 | lgpl | lgpl | (?:under|by|with) (?:the |a )?(?:gnu )?lgpl
1 | lgpl | lesser | (?:under|by|with) (?:the |a )?(?:gnu )?lesser general public licen[cs]e
1 | agpl | agpl | (?:under|by|with) (?:the |a )?(?:gnu )?agpl
1 | agpl | affero | (?:under|by|with) (?:the |a )?(?:gnu )?affero general public licen[cs]e
1 | bsd | bsd | (?:under|by|with) (?:the |a )?bsd(?: style)?(?: licen[cs]e)?
1 | bsd | bsd | bsd(?: style)? licen[cs]e
1 | mit | mit | (?:under|by|with) (?:the |an )?mit
1 | mpl | mpl | (?:under|by|with) (?:the |an )?mpl
1 | epl | epl | (?:under|by|with) (?:the |an )?epl
1 | isc | isc | (?:under|by|with) (?:the |an )?isc
1 | gfdl | gfdl | (?:under|by|with) (?:the |a )?(?:gnu )?gfdl
1 | artistic | artistic | (?:under|by|with) (?:the |an )?artistic licen[cs]e
1 | ofl | ofl | (?:under|by|with) (?:the |an )?ofl
1 | eupl | eupl | (?:under|by|with) (?:the |an )?eupl
1 | zlib | zlib | (?:under|by|with) (?:the |a )?zlib
1 | unlicense | unlicense | (?:under|by|with) (?:the |an )?unlicense
1 | cc-by | cc | (?:under|by|with) (?:the |a )?cc by(?! nc| sa| nd)
1 | creative-commons | creative | (?:under|by|with) (?:the |a )?creative commons(?: licen[cs]e)?
1 | public-domain | domain | public domain
"""


@dataclass(frozen=True)
class Rule:
    order: int
    label: str
    priority: int
    keyword: str
    pattern: re.Pattern
    base: bool = False

    @property
    def span(self) -> str | int:
        """The group that a detection spans: of a tag, the identifier alone, so that joined ones stand side by side."""
        return "span" if "span" in self.pattern.groupindex else 0


def _compiled(body: str) -> re.Pattern:
    return re.compile(f"(?<![^ ]){body}(?![^ ])")


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """All rules in order: base phrases, tagged identifiers, then RULES."""
    found: list[tuple[str, int, str, str, bool]] = [(label, 5, next(w for w in ("mit", "apache", "cc") if w in phrase.split()), phrase, True) for phrase, label in BASE_PHRASES]
    for line in SPDX_RULES.strip().splitlines():
        label, body = line.split(" | ")
        found.append((label, 4, "spdx", f"{SPDX}(?P<span>{body})", False))
    for line in RULES.strip().splitlines():
        priority, label, keyword, body = line.split(" | ", 3)
        found.append((label, int(priority), keyword, body, False))
    return tuple(Rule(i, label, priority, keyword, _compiled(body), base) for i, (label, priority, keyword, body, base) in enumerate(found))


@lru_cache(1)
def _gates() -> tuple[dict[str, list[Rule]], np.ndarray, dict[int, str]]:
    by_word: dict[str, list[Rule]] = defaultdict(list)
    for rule in rules():
        by_word[rule.keyword].append(rule)
    hashes = {common.hash_word(w): w for w in by_word}
    return by_word, np.sort(np.array(list(hashes), np.uint64)), hashes


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Drop what stands inside a stronger detection; base detections stay.

    In order of strength each detection is kept unless a kept one contains it, so the kept ones decide."""
    kept: list[tuple[int, int, Rule]] = []
    ends: dict[int, int] = {}
    for start, end, rule in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[2].order, d[0])):
        covered = any(ends.get(s, -1) >= end for s in range(max(0, start - REACH), start + 1))
        if covered and not rule.base:
            continue
        kept.append((start, end, rule))
        ends[start] = max(end, ends.get(start, -1))
    return sorted(kept, key=lambda d: (d[0], d[1], d[2].order))


def detect(words: list[str], hit_at: list[int], keywords: list[str]) -> list[tuple[int, int, Rule]]:
    """Detections (first word, word after the last, rule) of one document; hit_at: word index of each keyword."""
    by_word = _gates()[0]
    found, i = [], 0
    while i < len(hit_at):
        lo, hi, gate = max(0, hit_at[i] - REACH), hit_at[i] + REACH + 1, {keywords[i]}
        i += 1
        while i < len(hit_at) and hit_at[i] - REACH <= hi:
            hi = hit_at[i] + REACH + 1
            gate.add(keywords[i])
            i += 1
        window = words[lo:hi]
        text = " ".join(window)
        at = np.cumsum([0] + [len(w) + 1 for w in window])
        for word in gate:
            for rule in by_word[word]:
                for m in rule.pattern.finditer(text):
                    start, end = m.span(rule.span)
                    a = int(np.searchsorted(at, start))
                    found.append((lo + a, lo + a + text.count(" ", start, end) + 1, rule))
    return resolve(found)


SCHEMA = "doc_id long, n_words long, detections array<struct<start:long,end:long,label:string,rule:long,priority:long,base:boolean>>"
_DETECTION = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("rule", pa.int64()), ("priority", pa.int64()), ("base", pa.bool_())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _, gate, names = _gates()
    for rows, data, offsets in common.pieces(batches):
        data = common.lowered(data)
        starts, ends, word_at = common.word_spans(data, offsets, "alnum")
        hashes = common.span_hashes(data, starts, ends)
        slot = np.minimum(np.searchsorted(gate, hashes), len(gate) - 1)
        hits = np.flatnonzero(gate[slot] == hashes)
        bounds = np.searchsorted(hits, word_at)
        out: list[list[dict]] = [[] for _ in range(rows.num_rows)]
        for r in np.flatnonzero(np.diff(bounds)):
            first, last = word_at[r], word_at[r + 1]
            raw = data[offsets[r] : offsets[r + 1]].tobytes()
            words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first:last] - offsets[r], ends[first:last] - offsets[r], strict=True)]
            mine = hits[bounds[r] : bounds[r + 1]]
            out[r] = [
                {"start": a, "end": b, "label": rule.label, "rule": rule.order, "priority": rule.priority, "base": rule.base}
                for a, b, rule in detect(words, (mine - first).tolist(), [names[int(h)] for h in hashes[mine]])
            ]
        yield pa.record_batch([rows.column(0), pa.array(np.diff(word_at), pa.int64()), pa.array(out, _DETECTION)], names=["doc_id", "n_words", "detections"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, n_words, detections in order of place."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.in_arrow(rows, _scan, SCHEMA)


def report(found: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    base = F.filter("detections", lambda d: d["base"])
    labels = lambda ds: F.array_join(F.array_sort(F.array_distinct(F.transform(ds, lambda d: d["label"]))), ",")
    sure = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    doubt = F.aggregate("detections", F.lit(1.0), lambda a, d: a * (F.lit(1.0) - F.element_at(sure, d["priority"].cast("int"))))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["start"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("detections")).alias("labels"),
        (F.lit(1.0) - doubt).alias("score"),
    )
