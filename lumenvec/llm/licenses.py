"""Licence detection by ordered signature rules, in DataFrame functions only.

A rule has a label, a keyword, a priority and a regular expression over the lower-cased text. Each
licence in LICENSES has a hand-written expression for its names; three rules follow for it: its SPDX tag
(priority 1), a grant ("licensed under the ...", priority 2) and a mention of its name (priority 3).
NOTICES and SIGNATURES add rules of their own, one for each: short notices, and telling phrases of licences'
headers, bodies and terms. One expression over all gate words decides whether a text is looked at;
of its rules, only those whose keyword the text holds are matched. Both leave out only what cannot match.
A detection is suppressed if another one's interval contains its own and that one has a better priority, or
the same and is longer, or the same interval and an earlier rule. All work is done within a row: no shuffle,
no join, no Python. Places and suppression go by chunks of about the square root of their number, so a long text
with very many detections costs their number to the power 1.5, not their square or times the text.

Base places: where a phrase's words stand one after the other; words are runs of
[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after lower-casing A-Z.

Defined cases: null text is an empty one (no words, no labels, score 0); repeated rows give a row each;
an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed values of the task: words and label of each base phrase.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

_V = r"(?:,?\s*v(?:ersion\s*)?\.?\s*|\s+|-)"
#: SPDX id (lower case), keyword (one word, as names may be wrapped; in every form of the names), names.
LICENSES = (
    ("apache-1.0", "apache", rf"apache(?:\s+software)?(?:\s+licen[cs]e)?{_V}1\.0"),
    ("apache-1.1", "apache", rf"apache(?:\s+software)?(?:\s+licen[cs]e)?{_V}1\.1"),
    ("apache-2.0", "apache", rf"apache(?:\s+software)?(?:\s+licen[cs]e)?{_V}2(?:\.0)?"),
    ("mit", "mit", r"mit(?:/expat)?\s+licen[cs]e"),
    ("mit-0", "mit", r"mit(?:\s+no\s+attribution(?:\s+licen[cs]e)?|-0\s+licen[cs]e)"),
    ("x11", "x11", r"x11\s+licen[cs]e"),
    ("isc", "isc", r"isc\s+licen[cs]e"),
    ("0bsd", "bsd", r"(?:0bsd|zero[- ]clause\s+bsd|bsd\s+zero[- ]clause|0-clause\s+bsd)(?:\s+licen[cs]e)?"),
    ("bsd-1-clause", "bsd", r"(?:1|one)[- ]clause\s+bsd(?:\s+licen[cs]e)?"),
    ("bsd-2-clause", "bsd", r"(?:(?:2|two)[- ]clause\s+bsd|simplified\s+bsd|freebsd|bsd\s+2[- ]clause)(?:\s+licen[cs]e)?"),
    ("bsd-3-clause", "bsd", r"(?:(?:3|three)[- ]clause\s+bsd|(?:new|revised|modified)\s+bsd|bsd\s+3[- ]clause)(?:\s+licen[cs]e)?"),
    ("bsd-4-clause", "bsd", r"(?:(?:4|four)[- ]clause\s+bsd|original\s+bsd|bsd\s+4[- ]clause)(?:\s+licen[cs]e)?"),
    ("bsd", "bsd", r"bsd(?:[- ]style)?\s+licen[cs]e"),
    ("gpl-1.0", "general", rf"(?:gnu\s+)?general\s+public\s+licen[cs]e{_V}1(?:\.0)?"),
    ("gpl-2.0", "general", rf"(?:gnu\s+)?general\s+public\s+licen[cs]e{_V}2(?:\.0)?"),
    ("gpl-3.0", "general", rf"(?:gnu\s+)?general\s+public\s+licen[cs]e{_V}3(?:\.0)?"),
    ("gpl", "general", r"gnu\s+general\s+public\s+licen[cs]e"),
    ("lgpl-2.0", "general", rf"(?:gnu\s+)?library\s+general\s+public\s+licen[cs]e{_V}2(?:\.0)?"),
    ("lgpl-2.1", "general", rf"(?:gnu\s+)?lesser\s+general\s+public\s+licen[cs]e{_V}2\.1"),
    ("lgpl-3.0", "general", rf"(?:gnu\s+)?lesser\s+general\s+public\s+licen[cs]e{_V}3(?:\.0)?"),
    ("lgpl", "general", r"(?:gnu\s+)?(?:lesser|library)\s+general\s+public\s+licen[cs]e"),
    ("agpl-3.0", "general", rf"(?:gnu\s+)?affero\s+general\s+public\s+licen[cs]e{_V}3(?:\.0)?"),
    ("agpl", "general", r"(?:gnu\s+)?affero\s+general\s+public\s+licen[cs]e"),
    ("gfdl-1.3", "documentation", rf"(?:gnu\s+)?free\s+documentation\s+licen[cs]e{_V}1\.3"),
    ("gfdl", "documentation", r"(?:gnu\s+)?free\s+documentation\s+licen[cs]e"),
    ("mpl-1.0", "mozilla", rf"mozilla\s+public\s+licen[cs]e{_V}1\.0"),
    ("mpl-1.1", "mozilla", rf"mozilla\s+public\s+licen[cs]e{_V}1\.1"),
    ("mpl-2.0", "mozilla", rf"mozilla\s+public\s+licen[cs]e{_V}2(?:\.0)?"),
    ("mpl", "mozilla", r"mozilla\s+public\s+licen[cs]e"),
    ("epl-1.0", "eclipse", rf"eclipse\s+public\s+licen[cs]e{_V}1(?:\.0)?"),
    ("epl-2.0", "eclipse", rf"eclipse\s+public\s+licen[cs]e{_V}2(?:\.0)?"),
    ("cddl-1.0", "distribution", rf"common\s+development\s+and\s+distribution\s+licen[cs]e(?:{_V}1(?:\.0)?)?"),
    ("cpl-1.0", "common", rf"common\s+public\s+licen[cs]e(?:{_V}1(?:\.0)?)?"),
    ("cpal-1.0", "attribution", r"common\s+public\s+attribution\s+licen[cs]e"),
    ("eupl-1.1", "european", rf"european\s+union\s+public\s+licen[cs]e{_V}1\.1"),
    ("eupl-1.2", "european", rf"european\s+union\s+public\s+licen[cs]e{_V}1\.2"),
    ("cecill-2.1", "cecill", rf"cecill(?:\s+free\s+software)?(?:\s+licen[cs]e)?(?:{_V}2\.1)?"),
    ("artistic-1.0", "artistic", rf"artistic\s+licen[cs]e{_V}1(?:\.0)?"),
    ("artistic-2.0", "artistic", rf"artistic\s+licen[cs]e{_V}2(?:\.0)?"),
    ("artistic", "artistic", r"artistic\s+licen[cs]e"),
    ("zlib", "zlib", r"zlib(?:/libpng)?\s+licen[cs]e"),
    ("libpng", "libpng", r"libpng\s+licen[cs]e"),
    ("bsl-1.0", "boost", r"boost\s+software\s+licen[cs]e"),
    ("busl-1.1", "business", r"business\s+source\s+licen[cs]e"),
    ("unlicense", "unlicense", r"(?:the\s+)?unlicense"),
    ("wtfpl", "public", r"do\s+what\s+the\s+f\S+k\s+you\s+want\s+to\s+public\s+licen[cs]e"),
    ("python-2.0", "licen", r"(?:python(?:\s+software\s+foundation)?|psf)\s+licen[cs]e"),
    ("php-3.01", "php", r"php\s+licen[cs]e"),
    ("ruby", "ruby", r"ruby\s+licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql\s+licen[cs]e"),
    ("openssl", "openssl", r"openssl\s+licen[cs]e"),
    ("curl", "curl", r"curl\s+licen[cs]e"),
    ("vim", "vim", r"vim\s+licen[cs]e"),
    ("ncsa", "illinois", r"university\s+of\s+illinois(?:/|\s+)ncsa\s+open\s+source\s+licen[cs]e"),
    ("upl-1.0", "universal", r"universal\s+permissive\s+licen[cs]e"),
    ("ms-pl", "microsoft", r"microsoft\s+public\s+licen[cs]e"),
    ("ms-rl", "microsoft", r"microsoft\s+reciprocal\s+licen[cs]e"),
    ("osl-3.0", "software", rf"open\s+software\s+licen[cs]e(?:{_V}3(?:\.0)?)?"),
    ("afl-3.0", "academic", rf"academic\s+free\s+licen[cs]e(?:{_V}3(?:\.0)?)?"),
    ("ecl-2.0", "educational", r"educational\s+community\s+licen[cs]e"),
    ("ofl-1.1", "font", r"(?:sil\s+)?open\s+font\s+licen[cs]e"),
    ("ofl-1.0", "font", rf"(?:sil\s+)?open\s+font\s+licen[cs]e{_V}1\.0"),
    ("odbl-1.0", "database", r"open\s+(?:data\s+commons\s+open\s+)?database\s+licen[cs]e"),
    ("odc-by-1.0", "commons", r"open\s+data\s+commons\s+attribution\s+licen[cs]e"),
    ("pddl-1.0", "dedication", r"public\s+domain\s+dedication\s+and\s+licen[cs]e"),
    ("qpl-1.0", "public", r"q\s+public\s+licen[cs]e"),
    ("sleepycat", "sleepycat", r"sleepycat\s+licen[cs]e"),
    ("sissl", "industry", r"sun\s+industry\s+standards\s+source\s+licen[cs]e"),
    ("rpl-1.5", "reciprocal", r"reciprocal\s+public\s+licen[cs]e"),
    ("nposl-3.0", "non-profit", r"non-profit\s+open\s+software\s+licen[cs]e"),
    ("blueoak-1.0.0", "oak", r"blue\s+oak\s+model\s+licen[cs]e"),
    ("mulanpsl-2.0", "mulan", r"mulan\s+permissive\s+software\s+licen[cs]e"),
    ("sspl-1.0", "server", r"server\s+side\s+public\s+licen[cs]e"),
    ("elastic-2.0", "elastic", r"elastic\s+licen[cs]e"),
    ("fair", "fair", r"fair\s+licen[cs]e"),
    ("json", "json", r"json\s+licen[cs]e"),
    ("beerware", "beer", r"beer-?ware\s+licen[cs]e"),
    ("w3c", "w3c", r"w3c\s+(?:software\s+)?licen[cs]e"),
    ("icu", "icu", r"icu\s+licen[cs]e"),
    ("unicode-dfs-2016", "unicode", r"unicode(?:,?\s+inc\.?)?\s+licen[cs]e"),
    ("cc0-1.0", "cc0", r"cc0(?:\s+1\.0)?(?:\s+universal)?"),
    ("cc-by-1.0", "1.0", r"(?:cc[ -]by|creative\s+commons\s+attribution)[ -]1\.0"),
    ("cc-by-2.0", "2.0", r"(?:cc[ -]by|creative\s+commons\s+attribution)[ -]2\.0"),
    ("cc-by-2.5", "2.5", r"(?:cc[ -]by|creative\s+commons\s+attribution)[ -]2\.5"),
    ("cc-by-3.0", "3.0", r"(?:cc[ -]by|creative\s+commons\s+attribution)[ -]3\.0"),
    ("cc-by-4.0", "4.0", r"(?:cc[ -]by|creative\s+commons\s+attribution)[ -]4\.0"),
    ("cc-by-sa-3.0", "3.0", r"(?:cc[ -]by-sa|creative\s+commons\s+attribution-sharealike)[ -]3\.0"),
    ("cc-by-sa-4.0", "4.0", r"(?:cc[ -]by-sa|creative\s+commons\s+attribution-sharealike)[ -]4\.0"),
    ("cc-by-nd-4.0", "4.0", r"(?:cc[ -]by-nd|creative\s+commons\s+attribution-noderiv(?:ative)?s)[ -]4\.0"),
    ("cc-by-nc-2.0", "2.0", r"(?:cc[ -]by-nc|creative\s+commons\s+attribution-noncommercial)[ -]2\.0"),
    ("cc-by-nc-3.0", "3.0", r"(?:cc[ -]by-nc|creative\s+commons\s+attribution-noncommercial)[ -]3\.0"),
    ("cc-by-nc-4.0", "4.0", r"(?:cc[ -]by-nc|creative\s+commons\s+attribution-noncommercial)[ -]4\.0"),
    ("cc-by-nc-sa-3.0", "3.0", r"(?:cc[ -]by-nc-sa|creative\s+commons\s+attribution-noncommercial-sharealike)[ -]3\.0"),
    ("cc-by-nc-sa-4.0", "4.0", r"(?:cc[ -]by-nc-sa|creative\s+commons\s+attribution-noncommercial-sharealike)[ -]4\.0"),
    ("cc-by-nc-nd-4.0", "4.0", r"(?:cc[ -]by-nc-nd|creative\s+commons\s+attribution-noncommercial-noderiv(?:ative)?s)[ -]4\.0"),
)
#: Label, keyword, priority, expression.
NOTICES = (
    ("public-domain", "domain", 3, r"(?:in|to|into)\s+the\s+public\s+domain"),
    ("all-rights-reserved", "copyright", 4, r"copyright[^\n]{0,80}all\s+rights\s+reserved"),
    ("proprietary", "licen", 3, r"proprietary\s+licen[cs]e"),
    ("mit", "licen", 2, r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+obtaining\s+a\s+copy[\s\S]{0,400}?sublicense"),
    ("isc", "copyright", 2, r"permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software[\s\S]{0,200}?copyright\s+notice"),
    ("bsd", "copyright", 2, r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms[\s\S]{0,300}?copyright"),
    ("creative-commons", "creative", 4, r"creative\s?commons(?:\.org/licenses/[a-z-]+/[0-9.]+)?"),
    ("apache-2.0", "apache", 2, r"apache\.org/licenses/license-2\.0"),
    ("gpl", "gnu", 3, r"gnu\.org/licenses/(?:old-licenses/)?gpl(?:-[0-9.]+)?"),
    ("copyleft", "copyleft", 4, r"copyleft"),
)
#: Label, keyword, priority, phrase; a blank stands for white space and the marks that comments begin lines
#: with, " ?" for any or none of them.
SIGNATURES = (
    # headers and bodies of the GNU licences, and exceptions to them
    ("gpl-1.0", "licen", 2, r"gnu general public license as published by the free software foundation; either version 1"),
    ("gpl-2.0", "licen", 2, r"gnu general public license as published by the free software foundation; either version 2"),
    ("gpl-3.0", "licen", 2, r"gnu general public license as published by the free software foundation,? either version 3"),
    ("gpl-2.0", "licen", 2, r"gnu general public license version 2,? as published by the free software foundation"),
    ("gpl-3.0", "licen", 2, r"gnu general public license version 3,? as published by the free software foundation"),
    ("gpl-2.0", "licen", 2, r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", "licen", 2, r"the gnu general public license is a free, copyleft license for software and other kinds of works"),
    ("gpl", "licen", 3, r"you should have received a copy of the gnu general public license"),
    ("gpl", "licen", 4, r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl", "warrant", 4, r"distributed in the hope that it will be useful, but without any warranty"),
    ("lgpl-2.0", "licen", 2, r"gnu library general public license as published by the free software foundation; either version 2"),
    ("lgpl-2.1", "licen", 2, r"gnu lesser general public license as published by the free software foundation; either version 2\.1"),
    ("lgpl-3.0", "licen", 2, r"gnu lesser general public license as published by the free software foundation,? either version 3"),
    ("lgpl", "licen", 3, r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("lgpl-2.1", "licen", 2, r"this license, the lesser general public license, applies to some specially designated software packages"),
    ("lgpl-3.0", "licen", 2, r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("agpl-3.0", "licen", 2, r"gnu affero general public license as published by the free software foundation,? either version 3"),
    ("agpl", "licen", 3, r"you should have received a copy of the gnu affero general public license"),
    ("agpl-3.0", "licen", 2, r"the gnu affero general public license is a free, copyleft license for software and other kinds of works"),
    ("agpl-3.0", "licen", 2, r"remote network interaction; use with the gnu general public license"),
    ("gfdl", "permission", 2, r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation"),
    ("gfdl-1.1", "licen", 3, r"free documentation license,? version 1\.1"),
    ("gfdl-1.2", "licen", 3, r"free documentation license,? version 1\.2"),
    ("classpath-exception-2.0", "permission", 3, r"as a special exception, the copyright holders of this library give you permission to link this library"),
    ("gcc-exception-3.1", "licen", 3, r"gcc runtime library exception to the gnu general public license"),
    ("autoconf-exception", "licen", 3, r"as a special exception to the gnu general public license, if you distribute this file as part of a program"),
    ("bison-exception", "permission", 3, r"as a special exception, the free software foundation gives unlimited permission to copy, distribute and modify"),
    ("linux-syscall-note", "copyright", 3, r"this copyright does \*?not\*? cover user programs that use kernel services by normal system calls"),
    ("font-exception-2.0", "licen", 3, r"this font does not by itself cause the resulting document to be covered by the gnu general public license"),
    # Apache
    ("apache-2.0", "licen", 2, r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "licen", 3, r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed"),
    ("apache-2.0", "licen", 2, r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements"),
    ("apache-2.0", "licen", 3, r"each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license"),
    ("apache-2.0", "licen", 3, r"grant of patent license\. subject to the terms and conditions of this license, each contributor hereby grants"),
    ("apache-1.1", "apache", 2, r"this product includes software developed by the apache software foundation"),
    ("apache-1.0", "apache", 2, r"this product includes software developed by the apache group for use in the apache http server project"),
    # Mozilla, Eclipse, CDDL and other weak copyleft
    ("mpl-2.0", "licen", 2, r"this source code form is subject to the terms of the mozilla public license,? v\. ?2\.0"),
    ("mpl-2.0-no-copyleft-exception", "licen", 2, r"incompatible with secondary licenses"),
    ("mpl-1.0", "licen", 2, r"the contents of this file are subject to the mozilla public license version 1\.0"),
    ("mpl-1.1", "licen", 2, r"the contents of this file are subject to the mozilla public license version 1\.1"),
    ("npl-1.1", "licen", 2, r"the contents of this file are subject to the netscape public license version 1\.1"),
    ("npl", "licen", 3, r"netscape public license"),
    ("epl-1.0", "licen", 2, r"made available under the terms of the eclipse public license v1\.0"),
    ("epl-2.0", "licen", 2, r"made available under the terms of the eclipse public license (?:v\. ?)?2\.0"),
    ("epl", "licen", 3, r"the accompanying program is provided under the terms of this eclipse public license"),
    ("cpl-1.0", "licen", 2, r"the accompanying program is provided under the terms of this common public license"),
    ("cddl-1.0", "licen", 2, r"subject to the terms of the common development and distribution license"),
    ("cddl-1.1", "licen", 2, r"common development and distribution license \(cddl\) version 1\.1"),
    ("osl-3.0", "licen", 2, r"licensed under the open software license version 3\.0"),
    ("afl-3.0", "licen", 2, r"licensed under the academic free license version 3\.0"),
    ("eupl", "licen", 2, r"licensed under the eupl"),
    ("cecill", "cecill", 2, r"this software is governed by the cecill license under french law"),
    ("cecill", "cecill", 2, r"ce logiciel est r.gi par la licence cecill"),
    ("cecill-b", "cecill", 2, r"this software is governed by the cecill-b license under french law"),
    ("cecill-c", "cecill", 2, r"this software is governed by the cecill-c license under french law"),
    ("qpl-1.0", "licen", 3, r"the q public license version 1\.0"),
    ("lppl-1.3c", "licen", 2, r"under the conditions of the latex project public license"),
    ("lppl", "licen", 3, r"latex project public license"),
    ("nasa-1.3", "licen", 3, r"nasa open source agreement version 1\.3 licen[cs]e"),
    ("ipl-1.0", "licen", 3, r"ibm public license"),
    ("spl-1.0", "licen", 3, r"sun public license"),
    ("sgi-b-2.0", "licen", 3, r"sgi free software license b"),
    ("ofl-1.1", "licen", 2, r"this font software is licensed under the sil open font license,? version 1\.1"),
    ("ofl-1.1", "licen", 3, r"the goals of the open font license \(ofl\) are to stimulate worldwide development of collaborative font projects"),
    ("ofl-1.1", "licen", 3, r"the ofl allows the licensed fonts to be used, studied, modified and redistributed freely"),
    ("artistic-1.0", "copyright", 2, r"the intent of this document is to state the conditions under which a package may be copied, such that the copyright holder maintains"),
    ("artistic-2.0", "licen", 2, r"this license establishes the terms under which a given free software package may be copied, modified, distributed"),
    ("perl", "licen", 3, r"the same terms as perl itself, either licen[cs]e"),
    # BSD
    ("bsd", "redistribut", 3, r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistribut", 3, r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "permission", 3, r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause", "permission", 3, r"may not be used to endorse or promote products derived from this software without (?:specific )?prior written permission"),
    ("bsd-4-clause", "copyright", 3, r"the above copyright notice and all advertising materials mentioning features or use of this software"),
    ("bsd-3-clause-clear", "licen", 2, r"no express or implied licenses to any party's patent rights are granted by this license"),
    ("bsd-2-clause-patent", "licen", 2, r"bsd.{0,3}patent licen[cs]e"),
    ("bsd", "warrant", 4, r"provided by the (?:copyright holders|regents|authors?)(?: and contributors)? .{0,3}as is.{0,3} and any express or implied warranties"),
    ("0bsd", "permission", 3, r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\."),
    # MIT and its kin
    ("mit", "permission", 2, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "warrant", 3, r"the software is provided .{0,3}as is.{0,3}, without warranty of any kind, express or implied"),
    ("mit-0", "permission", 2, r"permission is hereby granted, free of charge, .{0,40}to deal in the software without restriction\. licen[cs]e mit-0"),
    ("ncsa", "permission", 2, r"to deal with the software without restriction,.{0,200}permission"),
    ("hpnd", "permission", 2, r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose(?: and without fee)? is hereby granted"),
    ("ntp", "permission", 2, r"permission to use, copy, modify, and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("isc", "permission", 2, r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided"),
    ("tcl", "licen", 2, r"the authors hereby grant permission to use, copy, modify, distribute, and license this software"),
    ("w3c", "licen", 2, r"this work is being provided by the copyright holders under the following license"),
    ("json", "permission", 2, r"the software shall be used for good, not evil\..{0,80}permission"),
    ("icu", "permission", 3, r"permission is hereby granted, .{0,40}to any person obtaining a copy of this software and associated documentation files"),
    ("postgresql", "permission", 3, r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement"),
    # zlib, Boost, image and crypto libraries
    ("zlib", "warrant", 2, r"this software is provided 'as-is', without any express or implied warranty\. in no event will the authors be held liable"),
    ("zlib", "misrepresent", 3, r"the origin of this software must not be misrepresented"),
    ("zlib", "misrepresent", 3, r"altered source versions must be plainly marked as such,? and must not be misrepresented"),
    ("bsl-1.0", "licen", 2, r"distributed under the boost software license,? version 1\.0"),
    ("bsl-1.0", "licen", 2, r"to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("libpng", "licen", 3, r"this code is released under the libpng license"),
    ("openssl", "licen", 2, r"the openssl toolkit stays under a (?:dual|double) license"),
    ("ssleay", "copyright", 3, r"copyright remains eric young's"),
    ("ijg", "copyright", 3, r"this software is copyright \(c\) .{1,30}thomas g\. lane"),
    ("ftl", "copyright", 3, r"portions of this software are copyright \(c\) [0-9]+ the freetype project"),
    ("imagemagick", "licen", 3, r"imagemagick license"),
    # public domain dedications
    ("unlicense", "unencumbered", 2, r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "domain", 3, r"(?:has been |is hereby )?(?:placed|released|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "domain", 3, r"this (?:file|work|code|software) is (?:in the )?public domain"),
    ("us-government-work", "copyright", 3, r"is not subject to copyright protection (?:within|in) the united states"),
    ("cc0-1.0", "copyright", 2, r"has waived all copyright and related or neighboring rights"),
    ("cc-pdm-1.0", "creative", 3, r"creativecommons\.org/publicdomain/mark/1\.0"),
    ("cc0-1.0", "creative", 2, r"creativecommons\.org/publicdomain/zero/1\.0"),
    # Creative Commons
    ("cc-by-4.0", "creative", 2, r"creativecommons\.org/licenses/by/4\.0"),
    ("cc-by-3.0", "creative", 2, r"creativecommons\.org/licenses/by/3\.0"),
    ("cc-by-sa-4.0", "creative", 2, r"creativecommons\.org/licenses/by-sa/4\.0"),
    ("cc-by-sa-3.0", "creative", 2, r"creativecommons\.org/licenses/by-sa/3\.0"),
    ("cc-by-nc-4.0", "creative", 2, r"creativecommons\.org/licenses/by-nc/4\.0"),
    ("cc-by-nc-3.0", "creative", 2, r"creativecommons\.org/licenses/by-nc/3\.0"),
    ("cc-by-nd-4.0", "creative", 2, r"creativecommons\.org/licenses/by-nd/4\.0"),
    ("cc-by-nc-sa-4.0", "creative", 2, r"creativecommons\.org/licenses/by-nc-sa/4\.0"),
    ("cc-by-nc-sa-3.0", "creative", 2, r"creativecommons\.org/licenses/by-nc-sa/3\.0"),
    ("cc-by-nc-nd-4.0", "creative", 2, r"creativecommons\.org/licenses/by-nc-nd/4\.0"),
    ("cc-by-4.0", "creative", 2, r"creative commons attribution 4\.0 international"),
    ("cc-by-3.0", "creative", 2, r"creative commons attribution 3\.0 (?:unported|united states)"),
    ("cc-by-sa-4.0", "creative", 2, r"creative commons attribution-?sharealike 4\.0 international"),
    ("cc-by-sa-3.0", "creative", 2, r"creative commons attribution-?share ?alike 3\.0 unported"),
    ("cc-by-nc-4.0", "creative", 2, r"creative commons attribution-?noncommercial 4\.0 international"),
    ("cc-by-nd-4.0", "creative", 2, r"creative commons attribution-?noderivatives 4\.0 international"),
    ("cc-by-nc-sa-4.0", "creative", 2, r"creative commons attribution-?noncommercial-?sharealike 4\.0 international"),
    ("cc-by-nc-nd-4.0", "creative", 2, r"creative commons attribution-?noncommercial-?noderivatives 4\.0 international"),
    ("creative-commons", "creative", 3, r"creative commons corporation is not a law firm"),
    ("creative-commons", "creative", 3, r"you accept and agree to be bound by the terms and conditions of this creative commons"),
    # data and models
    ("odbl-1.0", "licen", 2, r"is made available under the open database license"),
    ("odc-by-1.0", "licen", 2, r"is made available under the open data commons attribution license"),
    ("cdla-permissive-1.0", "licen", 3, r"community data license agreement .{0,3}permissive"),
    ("cdla-sharing-1.0", "licen", 3, r"community data license agreement .{0,3}sharing"),
    ("ogl-uk-3.0", "licen", 2, r"open government licen[cs]e v3\.0"),
    ("ogl-uk", "licen", 3, r"open government licen[cs]e"),
    ("etalab-2.0", "licen", 3, r"licence ouverte"),
    ("openrail", "licen", 3, r"(?:creativeml )?open ?rail(?:-m|\+\+)? licen[cs]e"),
    ("llama-community", "licen", 3, r"llama [234](?:\.[0-9])? community license"),
    # source available and proprietary
    ("sspl-1.0", "licen", 2, r"licensed under the server side public license"),
    ("busl-1.1", "licen", 2, r"the licensor hereby grants you the right to copy, modify, create derivative works, redistribute"),
    ("elastic-2.0", "licen", 2, r"licensed under the elastic license 2\.0"),
    ("commons-clause", "licen", 2, r"the software is provided to you by the licensor under the license,? as defined below, subject to the following condition"),
    ("polyform-noncommercial-1.0.0", "licen", 3, r"polyform noncommercial license"),
    ("polyform-shield-1.0.0", "licen", 3, r"polyform shield license"),
    ("ms-pl", "licen", 2, r"if you use the software, you accept this license\. if you do not accept the license, do not use the software"),
    ("proprietary", "proprietary", 3, r"confidential and proprietary"),
    ("proprietary", "proprietary", 3, r"proprietary and confidential"),
    ("proprietary", "permission", 3, r"may not be (?:copied|reproduced|distributed|disclosed|used).{0,60}without.{0,40}permission"),
    ("proprietary", "licen", 3, r"end.user licen[cs]e agreement"),
    ("proprietary", "licen", 3, r"evaluation licen[cs]e"),
    ("proprietary", "licen", 4, r"commercial licen[cs]e"),
    ("all-rights-reserved", "redistribut", 4, r"redistribution (?:is|are) (?:strictly )?prohibited"),
    ("beerware", "licen", 2, r"beer-?ware license.{0,20} \(revision 42\)"),
    ("php-3.01", "licen", 2, r"subject to version 3\.01? of the php license"),
    ("python-2.0", "licen", 2, r"this license agreement is between the python software foundation"),
    ("ruby", "licen", 3, r"the same terms as ruby,? licen[cs]e"),
    ("vim", "licen", 3, r"vim is charityware\. .{0,60}licen[cs]e"),
    ("unicode-dfs-2016", "licen", 2, r"unicode, inc\. license agreement"),
    ("mulanpsl-2.0", "licen", 2, r"is licensed under mulan psl v2"),
)
#: Every rule and base phrase needs one of these in the text, whose \x01 and \x02 are blanks to the rules.
GATE = r"(?i)licen|spdx|copyleft|copyright|permission|warrant|redistribut|misrepresent|proprietary|apache|bsd|cecill|mit[\s\x01\x02]+no[\s\x01\x02]|public[\s\x01\x02*#/]+domain|creative[\s\x01\x02*#/]*commons|cc0|cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by"
CONFIDENCE = {1: 1.0, 2: 0.95, 3: 0.8, 4: 0.5}
#: A base place that no rule covers.
BASE_CONFIDENCE = 0.6
GRANT = r"(?:licen[cs]ed|released|distributed|available|provided|published)\s+under\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?"


def rules() -> list[dict]:
    """All rules in their order."""
    out = []
    for label, keyword, name in LICENSES:
        tag = label.replace(".", r"\.").replace("+", r"\+")
        out.append({"label": label, "keyword": "spdx", "priority": 1, "regex": rf"spdx-license-identifier:\s*{tag}(?:-only|-or-later|\+)?(?![\w.+-])"})
        out.append({"label": label, "keyword": keyword, "priority": 2, "regex": rf"{GRANT}(?:{name})(?![\w-])"})
        out.append({"label": label, "keyword": keyword, "priority": 3, "regex": rf"(?<![\w-])(?:{name})(?![\w-])"})
    out += [{"label": a, "keyword": k, "priority": p, "regex": r} for a, k, p, r in NOTICES]
    out += [{"label": a, "keyword": k, "priority": p, "regex": r.replace(" ?", r"[\s*#/]*").replace(" ", r"[\s*#/]+")} for a, k, p, r in SIGNATURES]
    return [r | {"rank": i} for i, r in enumerate(out)]


_RULE = "array<struct<label:string,keyword:string,priority:int,regex:string,rank:int>>"
_FOUND = "array<struct<start:int,end:int,label:string,priority:int,rank:int>>"
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bind(value: Column, body) -> Column:
    """body(value), value computed once."""
    return F.transform(F.array(value), body)[0]


def _chunks(x: Column, size: Column) -> Column:
    """x in arrays of size elements (one at least)."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(x) - 1) / size).cast("int"))), lambda k: F.slice(x, k * size + 1, size))


def _root(x: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x))).cast("int"))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, v: a + v)


def _before(x: Column) -> Column:
    """For each element of x, the sum of those before it."""

    def run(parts: Column) -> Column:
        def inside(sums: Column) -> Column:
            return F.flatten(F.transform(parts, lambda one, k: _bind(_sum(F.slice(sums, F.lit(1), k)), lambda base: F.transform(one, lambda v, i: base + _sum(F.slice(one, F.lit(1), i))))))

        return _bind(F.transform(parts, _sum), inside)

    return _bind(_chunks(x, _root(x)), run)


def _matches(text: Column, rule: Column) -> Column:
    """A rule's detections: start, end, label, priority, rank."""
    parts = F.split(F.regexp_replace(text, rule["regex"], F.lit("\x01$0\x02")), "[\x01\x02]")

    def places(sizes: Column) -> Column:
        held = F.filter(F.transform(F.arrays_zip(_before(sizes).alias("start"), sizes.alias("size")), lambda p, i: F.when(i % 2 == 1, p)), lambda p: p.isNotNull())
        return F.transform(held, lambda p: F.struct(p["start"].alias("start"), (p["start"] + p["size"]).alias("end"), rule["label"].alias("label"), rule["priority"].alias("priority"), rule["rank"].alias("rank")))

    return _bind(F.transform(parts, F.length), lambda sizes: F.when(F.size(sizes) > 1, places(sizes)).otherwise(F.array().cast(_FOUND)))


def _suppressed(found: Column) -> Column:
    """found without those that a better one contains. In the order of starts, a chunk whose last end or first
    start rules out that it holds a container is passed over."""

    def better(e: Column, d: Column) -> Column:
        wide, own = e["end"] - e["start"], d["end"] - d["start"]
        order = (e["priority"] < d["priority"]) | ((e["priority"] == d["priority"]) & ((wide > own) | ((wide == own) & (e["rank"] < d["rank"]))))
        return (e["start"] <= d["start"]) & (e["end"] >= d["end"]) & order

    def run(ordered: Column) -> Column:
        chunks = F.transform(_chunks(ordered, _root(ordered)), lambda c: F.struct(F.get(c, F.lit(0))["start"].alias("low"), F.array_max(F.transform(c, lambda e: e["end"])).alias("high"), c.alias("held")))
        return _bind(chunks, lambda cs: F.filter(ordered, lambda d: ~F.exists(cs, lambda c: (c["low"] <= d["start"]) & (c["high"] >= d["end"]) & F.exists(c["held"], lambda e: better(e, d)))))

    return _bind(F.array_sort(found), run)


def detections(text: Column) -> Column:
    """Detections of a text, after suppression: array of start, end, label, priority, rank."""
    every = F.from_json(F.lit(json.dumps(rules())), _RULE)
    clean = F.translate(F.lower(text), "\x01\x02", "  ")

    def run(t: Column) -> Column:
        held = F.filter(every, lambda r: F.contains(t, r["keyword"]))
        return _bind(F.flatten(F.transform(held, lambda r: _matches(t, r))), _suppressed)

    return _bind(clean, run)


def base_places(text: Column) -> Column:
    """struct of an array of starts for each base phrase."""
    broken = F.split(F.translate(text, _UPPER, _LOWER), _BREAK)

    def run(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w))

        def starts(phrase: str) -> Column:
            parts = phrase.split()

            def here(i: Column) -> Column:
                good = F.get(w, i) == parts[0]
                for k, word in enumerate(parts[1:], 1):
                    good = good & (F.get(w, i + k) == word)
                return F.coalesce(good, F.lit(False))

            return F.filter(places, here)

        return F.struct(*(starts(p).alias(label) for p, label in PHRASES))

    return _bind(F.filter(broken, lambda x: x != ""), run)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base (places of each phrase) and found (detections with spans) of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    parts = F.split(text, _BREAK)
    n_words = _bind(parts, lambda p: F.size(p) - (F.get(p, F.lit(0)) == "").cast("int") - ((F.size(p) > 1) & (F.element_at(p, -1) == "")).cast("int"))
    gated = text.rlike(GATE)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        n_words.cast("long").alias("n_words"),
        F.when(gated, F.struct(base_places(text).alias("base"), detections(text).alias("found"))).alias("hit"),
    ).select("doc_id", "n_words", "hit.base", "hit.found")


def op6_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    places = F.concat(*(F.coalesce(F.col("base")[label], F.array().cast("array<int>")) for _, label in PHRASES))
    own = F.filter(F.array(*(F.when(F.size(F.col("base")[label]) > 0, F.lit(label)) for _, label in PHRASES)), lambda x: x.isNotNull())
    theirs = F.coalesce(F.transform("found", lambda d: d["label"]), F.array().cast("array<string>"))
    rate = F.array_max(F.transform("found", lambda d: F.element_at(F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv)), d["priority"])))
    named = found.select("doc_id", "n_words", places.alias("places"), F.sort_array(own).alias("own"), theirs.alias("theirs"), rate.alias("rate"))
    return named.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("own", ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat("own", "theirs"))), ",").alias("labels"),
        F.coalesce("rate", F.when(F.size("own") > 0, F.lit(BASE_CONFIDENCE)), F.lit(0.0)).alias("score"),
    )
