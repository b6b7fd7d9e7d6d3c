"""Ordered signature rules for licenses: fixed values, in the order in which they win at equal priority.

A family starts with ``label @ keyword``; its regexes follow, each after its priority: 3 a
license text or tag, 2 a named license, 1 a mention. They match lower-case words separated by single spaces;
punctuation has become a space, so ``2.0`` reads ``2 0``. A rule is tried only where its family's keyword occurs.
"""

from __future__ import annotations

from typing import NamedTuple

_RULES = r"""
gpl-3.0 @ gnu
3 this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3
3 gnu general public license version 3 29 june 2007
2 gnu general public license,? (?:v|version )?3(?: 0)?(?: only| or later)?
2 version 3(?: 0)? of the gnu general public license
2 gnu gpl (?:v|version )?3(?: 0)?
gpl-3.0 @ gpl
3 spdx license identifier gpl 3 0(?: only| or later)?
2 gpl (?:v|version )?3(?: 0)?(?: only| or later)?
2 gplv3(?: 0)?
2 license gpl 3
gpl-2.0 @ gnu
3 this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2
3 gnu general public license version 2 june 1991
2 gnu general public license,? (?:v|version )?2(?: 0)?(?: only| or later)?
2 version 2(?: 0)? of the gnu general public license
2 gnu gpl (?:v|version )?2(?: 0)?
gpl-2.0 @ gpl
3 spdx license identifier gpl 2 0(?: only| or later)?
2 gpl (?:v|version )?2(?: 0)?(?: only| or later)?
2 gplv2(?: 0)?
gpl-1.0 @ gnu
2 gnu general public license (?:v|version )?1(?: 0)?(?: or later)?
3 gnu general public license version 1 february 1989
agpl-3.0 @ affero
3 this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license
3 gnu affero general public license version 3 19 november 2007
2 gnu affero general public license(?: (?:v|version )?3(?: 0)?)?(?: or later)?
2 affero gpl(?: (?:v|version )?3)?
agpl-3.0 @ agpl
3 spdx license identifier agpl 3 0(?: only| or later)?
2 agpl(?: v?3(?: 0)?)?(?: only| or later)?
2 agplv3
lgpl-3.0 @ lesser
2 gnu lesser general public license (?:v|version )?3(?: 0)?(?: or later)?
3 gnu lesser general public license version 3 29 june 2007
lgpl-2.1 @ lesser
3 gnu lesser general public license version 2 1 february 1999
2 gnu lesser general public license (?:v|version )?2(?: 1)?(?: or later)?
3 this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license
2 lesser gpl (?:v|version )?2 1
lgpl-2.0 @ library
3 gnu library general public license version 2 june 1991
2 gnu library general public license
lgpl @ lesser
1 gnu lesser general public license
1 lesser general public license
lgpl @ lgpl
3 spdx license identifier lgpl [23] [01](?: only| or later)?
2 lgpl (?:v|version )?[23](?: [01])?(?: only| or later)?
2 lgplv[23](?: 1)?
1 licensed under (?:the )?lgpl
gfdl @ documentation
3 permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
2 gnu free documentation license(?: version 1 [123])?
2 free documentation license
gpl @ gnu
2 gnu general public license
1 (?:the )?gnu gpl
1 gnu public license
gpl @ gpl
1 licensed under (?:the )?gpl
1 released under (?:the )?gpl
1 gpl licensed
1 dual licensed under (?:the )?gpl
apache-2.0 @ apache
3 licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
3 apache license version 2 0 january 2004
3 spdx license identifier apache 2 0
2 apache (?:software )?license,? (?:v|version )?2(?: 0)?
2 apache 2(?: 0)? license
2 apache 2 0
2 apache v2(?: 0)?
2 asl 2 0 apache
apache-1.1 @ apache
3 the apache software license version 1 1
2 apache (?:software )?license (?:v|version )?1 1
apache-1.0 @ apache
2 apache (?:software )?license (?:v|version )?1 0
3 this product includes software developed by the apache group
apache @ apache
2 apache (?:software )?license
1 licensed under (?:the )?apache
1 released under (?:the )?apache
mit @ mit
3 spdx license identifier mit
2 (?:the )?mit license
2 mit licensed
2 licensed under (?:the )?mit
2 released under (?:the )?mit
2 license mit
2 mit x11 license
2 mit expat license
1 mit style license
mit @ permission
3 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
3 the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
2 permission is hereby granted free of charge to any person obtaining a copy
mit-0 @ mit
3 spdx license identifier mit 0
2 mit no attribution(?: license)?
2 mit 0 license
x11 @ x11
2 x11 license
3 spdx license identifier x11
2 except as contained in this notice the name of the x consortium
bsd-3-clause @ bsd
3 spdx license identifier bsd 3 clause
2 bsd 3 clause(?: license)?
2 (?:3|three) clause bsd(?: license)?
2 (?:new|modified|revised) bsd license
bsd-3-clause @ redistribution
3 redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met .{0,900}?neither the name of
3 neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products
bsd-2-clause @ bsd
3 spdx license identifier bsd 2 clause
2 bsd 2 clause(?: license)?
2 (?:2|two) clause bsd(?: license)?
2 (?:simplified|freebsd) bsd license
2 freebsd license
bsd-2-clause @ redistribution
2 redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-4-clause @ bsd
3 spdx license identifier bsd 4 clause
2 bsd 4 clause(?: license)?
2 (?:4|four) clause bsd(?: license)?
2 original bsd license
bsd-4-clause @ advertising
3 all advertising materials mentioning features or use of this software must display the following acknowledgement
0bsd @ bsd
3 spdx license identifier 0bsd
2 (?:0bsd|zero clause bsd|0 clause bsd)(?: license)?
bsd @ bsd
1 bsd license
1 bsd style license
1 bsd licensed
1 licensed under (?:the )?bsd
isc @ isc
3 spdx license identifier isc
2 isc license
2 licensed under (?:the )?isc
isc @ permission
3 permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
2 permission to use copy modify and distribute this software for any purpose with or without fee
mpl-2.0 @ mozilla
3 this source code form is subject to the terms of the mozilla public license v 2 0
2 mozilla public license,? (?:v ?|version )?2(?: 0)?
mpl-2.0 @ mpl
3 spdx license identifier mpl 2 0
2 mpl (?:v|version )?2 0
mpl-1.1 @ mozilla
3 the contents of this file are subject to the mozilla public license version 1 1
2 mozilla public license (?:v ?|version )?1 1
mpl-1.1 @ mpl
2 mpl (?:v|version )?1 1
mpl-1.0 @ mozilla
2 mozilla public license (?:v ?|version )?1 0
mpl @ mozilla
1 mozilla public license
1 licensed under (?:the )?mozilla
epl-2.0 @ eclipse
2 eclipse public license,? (?:v ?|version )?2(?: 0)?
3 this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
epl-1.0 @ eclipse
2 eclipse public license,? (?:v ?|version )?1(?: 0)?
1 eclipse public license
edl-1.0 @ eclipse
2 eclipse distribution license(?: v ?1 0)?
epl @ epl
3 spdx license identifier epl [12] 0
2 epl (?:v|version )?[12] 0
cddl @ cddl
3 spdx license identifier cddl 1 [01]
2 cddl(?: (?:v|version )?1 [01])?
cddl @ common
2 common development and distribution license(?: version 1 [01])?
2 common public license(?: version 1 0)?
2 common public attribution license(?: version 1 0)?
cc-by-nc-nd @ cc by
3 cc by nc nd(?: [1-4] [05])?
cc-by-nc-sa @ cc by
3 cc by nc sa(?: [1-4] [05])?
cc-by-nc @ cc by
3 cc by nc(?: [1-4] [05])?
cc-by-nd @ cc by
3 cc by nd(?: [1-4] [05])?
cc-by-sa @ cc by
3 cc by sa(?: [1-4] [05])?
cc-by-4.0 @ cc by
3 cc by 4 0
2 cc by 4
cc-by-3.0 @ cc by
3 cc by 3 0
cc-by-2.0 @ cc by
3 cc by 2 [05]
cc-by @ cc by
2 cc by
2 cc by license
cc-by-nc-nd @ creative commons
3 creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: (?:works )?[1-4] [05])?
cc-by-nc-sa @ creative commons
3 creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
cc-by-nc @ creative commons
3 creative commons attribution non ?commercial(?: [1-4] [05])?
cc-by-nd @ creative commons
3 creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?
cc-by-sa @ creative commons
3 creative commons attribution share ?alike(?: [1-4] [05])?
3 creative commons by sa(?: [1-4] [05])?
cc-by-4.0 @ creative commons
3 creative commons attribution 4 0(?: international)?(?: license)?
cc-by @ creative commons
2 creative commons attribution(?: [1-3] [05])?(?: (?:generic|unported|international))?(?: license)?
2 creative commons by
cc0-1.0 @ cc0
3 spdx license identifier cc0 1 0
2 cc0(?: 1 0)?(?: universal)?
cc0-1.0 @ creative commons
2 creative commons zero(?: v?1 0)?(?: universal)?
2 creative commons public domain dedication
cc @ creative commons
1 creative commons license
1 licensed under (?:a )?creative commons
unlicense @ unlicense
3 spdx license identifier unlicense
2 (?:the )?unlicense
2 unlicense org
public-domain @ public domain
3 this is free and unencumbered software released into the public domain
2 (?:placed|released|dedicated) (?:in|into|to) the public domain
2 public domain dedication
1 in the public domain
1 public domain work
wtfpl @ wtfpl
2 wtfpl(?: version 2)?
wtfpl @ do what
3 do what the fuck you want to public license
zlib @ zlib
3 spdx license identifier zlib
2 zlib(?: libpng)? license
zlib @ provided as is
3 this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
libpng @ libpng
2 libpng license(?: version 2)?
boost @ boost
3 spdx license identifier bsl 1 0
2 boost software license(?: version 1 0)?(?: (?:17th )?august (?:17th )?2003)?
1 boost license
artistic-2.0 @ artistic
3 spdx license identifier artistic 2 0
2 artistic license,? (?:v|version )?2(?: 0)?
artistic-1.0 @ artistic
2 artistic license,? (?:v|version )?1(?: 0)?
1 (?:the )?artistic license
perl @ perl
2 (?:under )?the same terms as perl(?: itself)?
1 perl license
ofl-1.1 @ open font
3 this font software is licensed under the sil open font license version 1 1
2 sil open font license(?: version 1 1)?
2 open font license
ofl-1.1 @ ofl
2 ofl 1 1
eupl @ european union
2 european union public licen[cs]e(?: (?:v ?|version )?1 [0-2])?
eupl @ eupl
3 spdx license identifier eupl 1 [12]
2 eupl(?: v?1 [0-2])?
cecill @ cecill
2 cecill [abc](?: licen[cs]e)?
2 cecill(?: (?:free software )?licen[cs]e)?(?: 2 [01])?
ms-pl @ microsoft
2 microsoft public license(?: ms pl)?
2 microsoft reciprocal license(?: ms rl)?
1 microsoft software license terms
ms-pl @ ms pl
2 ms pl(?: license)?
python-2.0 @ python
2 python software foundation license(?: version 2)?
2 psf license(?: agreement)?
1 python license
postgresql @ postgresql
2 postgresql licen[cs]e
ruby @ ruby
2 ruby licen[cs]e
1 same terms as ruby
php @ php
2 php license(?: version 3 0[01]?)?
openssl @ openssl
2 openssl license
3 this product includes software developed by the openssl project
ncsa @ ncsa
2 (?:university of illinois )?(?:ncsa )?open source license ncsa
2 university of illinois ncsa open source license
ncsa @ illinois
2 university of illinois open source license
afl @ academic
2 academic free license(?: (?:v ?|version )?[123] [01])?
osl @ open software
2 open software license(?: (?:v ?|version )?[123] [01])?
upl @ universal permissive
2 universal permissive license(?: (?:v ?|version )?1 0)?
odbl @ open data
2 open data commons open database license(?: v ?1 0)?
2 open data commons attribution license(?: v ?1 0)?
2 open data commons public domain dedication and license
odbl @ odbl
2 odbl(?: 1 0)?
ecl @ educational
2 educational community license(?: version [12] 0)?
vim @ vim
2 vim license
curl @ curl
2 curl license
tcl @ tcl
2 tcl tk license
bzip2 @ bzip2
2 bzip2 license
ijg @ jpeg
3 this software is based in part on the work of the independent jpeg group
unicode @ unicode
2 unicode license agreement(?: data files and software)?
w3c @ w3c
2 w3c software (?:notice )?(?:and )?(?:document )?license
sspl @ server side
2 server side public license(?: (?:v ?|version )?1)?
elastic @ elastic
2 elastic license(?: 2 0)?
busl @ business source
2 business source license(?: (?:v ?|version )?1 1)?
commons-clause @ commons clause
2 commons clause(?: license condition)?(?: v ?1 0)?
json @ json
2 json license
json @ used for good
3 the software shall be used for good not evil
proprietary @ proprietary
2 proprietary and confidential
1 proprietary license
1 proprietary software
proprietary @ confidential
2 confidential and proprietary
1 unauthorized copying of this file via any medium is strictly prohibited
all-rights-reserved @ rights reserved
2 copyright .{1,60}? all rights reserved
1 all rights reserved
commercial @ commercial
1 commercial license(?: agreement)?
1 not for commercial use
eula @ end user
2 end user license agreement
spdx @ spdx
1 spdx license identifier
other @ licen
1 licensed under the .{1,40}? licen[cs]e
1 see the licen[cs]e file
1 see licen[cs]e(?: txt| md)? for (?:details|more information)
1 free software licen[cs]e
1 open source licen[cs]e
1 permissive licen[cs]e
1 copyleft licen[cs]e
1 licen[cs]e agreement
1 terms of (?:the|this) licen[cs]e
1 subject to the following licen[cs]e
"""


class Rule(NamedTuple):
    number: int
    label: str
    keyword: str
    priority: int
    pattern: str


def rules() -> list[Rule]:
    found, label, keyword = [], "", ""
    for line in filter(None, map(str.strip, _RULES.splitlines())):
        if " @ " in line:
            label, keyword = line.split(" @ ")
        else:
            priority, pattern = line.split(" ", 1)
            found.append(Rule(len(found), label, keyword, int(priority), f"(?<= )(?:{pattern.replace(',?', '')})(?= )"))
    return found
