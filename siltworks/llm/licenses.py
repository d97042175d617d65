"""License detection by ordered signature rules.

A text is reduced to its words, space-joined, and rules (regexes over that form) run in order of priority: precise
statements and identifiers first, bare family names last. A rule is tried only where the joined words hold its keyword,
and no rule is looked at where they hold none of the rules' keywords. A detection inside the interval of one of higher
priority is suppressed. The four base phrases are always counted, apart from the rules.

All of it is column expressions: the rules are one constant array in the plan, and detections stay in the row as
arrays, so nothing is shuffled.

Edge cases: null text counts as empty; a text without words has n_words 0 and null positions; repeated rows are
scanned alike; overlapping places of a phrase all count; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import WORD_SEPARATOR, ascii_lower, text_or_empty
from siltworks.llm.spans import let, meets, places, tree

#: Phrase and label. Fixed values.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Families with versions: label, names, versions ("" is the unversioned form). Fixed values.
VERSIONED = (
    ("gpl", ("gnu general public licen[sc]e", "gnu gpl", "gpl"), ("1", "1 0", "2", "2 0", "3", "3 0")),
    ("lgpl", ("gnu (?:lesser|library) general public licen[sc]e", "gnu lgpl", "lgpl"), ("2", "2 0", "2 1", "3", "3 0")),
    ("agpl", ("gnu affero general public licen[sc]e", "gnu agpl", "agpl"), ("1", "1 0", "3", "3 0")),
    ("gfdl", ("gnu free documentation licen[sc]e", "gfdl"), ("1 1", "1 2", "1 3")),
    ("apache", ("apache software licen[sc]e", "apache licen[sc]e", "apache"), ("1 0", "1 1", "2", "2 0")),
    ("mpl", ("mozilla public licen[sc]e", "mpl"), ("1 0", "1 1", "2", "2 0")),
    ("epl", ("eclipse public licen[sc]e", "epl"), ("1 0", "2 0")),
    ("cpl", ("common public licen[sc]e", "cpl"), ("0 5", "1 0")),
    ("cddl", ("common development and distribution licen[sc]e", "cddl"), ("1 0", "1 1")),
    ("eupl", ("european union public licen[sc]e", "eupl"), ("1 0", "1 1", "1 2")),
    ("afl", ("academic free licen[sc]e", "afl"), ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("osl", ("open software licen[sc]e", "osl"), ("1 0", "1 1", "2 0", "2 1", "3 0")),
    ("artistic", ("artistic licen[sc]e", "artistic"), ("1 0", "2 0")),
    ("ofl", ("sil open font licen[sc]e", "open font licen[sc]e", "ofl"), ("1 0", "1 1")),
    ("ecl", ("educational community licen[sc]e", "ecl"), ("1 0", "2 0")),
    ("bsl", ("boost software licen[sc]e", "bsl"), ("1 0",)),
    ("zpl", ("zope public licen[sc]e", "zpl"), ("1 1", "2 0", "2 1")),
    ("lppl", ("latex project public licen[sc]e", "lppl"), ("1 0", "1 1", "1 2", "1 3")),
    ("cecill", ("cecill free software licen[sc]e agreement", "cecill"), ("1 0", "1 1", "2 0", "2 1")),
    ("php", ("php licen[sc]e", "php"), ("3 0", "3 01")),
    ("python", ("python software foundation licen[sc]e", "psf licen[sc]e"), ("2", "2 0")),
    ("w3c", ("w3c software notice and licen[sc]e", "w3c licen[sc]e"), ("1998", "2015")),
    ("odbl", ("open database licen[sc]e", "odbl"), ("1 0",)),
    ("odc-by", ("open data commons attribution licen[sc]e", "odc by"), ("1 0",)),
    ("busl", ("business source licen[sc]e", "busl"), ("1 0", "1 1")),
    ("sspl", ("server side public licen[sc]e", "sspl"), ("1", "1 0")),
)
#: Creative Commons: label, code, long name; each with VERSIONS_CC. Fixed values.
CREATIVE = (
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s?"),
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?"),
)
VERSIONS_CC = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Single rules: label, keyword, regex over the words, score. Fixed values.
SINGLE = (
    ("mit", "mit", "spdx license identifier mit", 1.0),
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", 0.95),
    ("mit", "mit", "(?:the )?mit licen[sc]e(?: mit)?", 0.9),
    ("mit", "expat", "expat licen[sc]e", 0.85),
    ("isc", "isc", "isc licen[sc]e", 0.9),
    ("isc", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose", 0.95),
    ("bsd-0", "bsd", "(?:0bsd|bsd (?:zero|0) clause)", 0.9),
    ("bsd-2", "bsd", "(?:(?:2|two) clause bsd|bsd (?:2|two) clause|simplified bsd|freebsd licen[sc]e)", 0.9),
    ("bsd-3", "bsd", "(?:(?:3|three) clause bsd|bsd (?:3|three) clause|(?:new|modified|revised) bsd)", 0.9),
    ("bsd-4", "bsd", "(?:(?:4|four) clause bsd|bsd (?:4|four) clause|original bsd)", 0.9),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 0.9),
    ("bsd", "bsd", "bsd (?:style )?licen[sc]e", 0.7),
    ("zlib", "zlib", "zlib(?: libpng)? licen[sc]e", 0.9),
    ("libpng", "libpng", "libpng licen[sc]e(?: version 2)?", 0.85),
    ("unlicense", "unlicense", "(?:the )?unlicense", 0.85),
    ("unlicense", "public domain", "free and unencumbered software released into the public domain", 0.95),
    ("public-domain", "public domain", "(?:dedicated|released|placed) (?:to|in|into) the public domain", 0.8),
    ("wtfpl", "wtfpl", "wtfpl", 0.85),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", 0.9),
    ("cc0", "creative commons zero", "creative commons zero(?: v1 0)?", 0.9),
    ("ms-pl", "microsoft", "microsoft public licen[sc]e", 0.9),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[sc]e", 0.9),
    ("postgresql", "postgresql", "postgresql licen[sc]e", 0.9),
    ("ruby", "ruby", "ruby licen[sc]e", 0.8),
    ("vim", "vim", "vim licen[sc]e", 0.8),
    ("x11", "x11", "x11 licen[sc]e", 0.85),
    ("json", "json", "json licen[sc]e", 0.8),
    ("openssl", "openssl", "openssl licen[sc]e", 0.85),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa (?:open source )?licen[sc]e", 0.85),
    ("ipl", "ibm", "ibm public licen[sc]e(?: version)?(?: 1 0)?", 0.85),
    ("qpl", "q public", "q public licen[sc]e(?: version)?(?: 1 0)?", 0.85),
    ("sleepycat", "sleepycat", "sleepycat licen[sc]e", 0.85),
    ("beerware", "beer", "beer ?ware licen[sc]e", 0.8),
    ("upl", "universal permissive", "universal permissive licen[sc]e(?: v)?(?: 1 0)?", 0.85),
    ("hpnd", "historical permission", "historical permission notice and disclaimer", 0.85),
    ("gpl", "gplv", "gplv[123]", 0.9),
    ("lgpl", "lgplv", "lgplv[23](?: 1)?", 0.9),
    ("apache", "apache", "spdx license identifier apache 2 0", 1.0),
    ("proprietary", "all rights reserved", "all rights reserved", 0.4),
    ("proprietary", "proprietary", "proprietary and confidential", 0.5),
    ("unknown-license", "licen", "licen[sc]ed under(?: the)?(?: terms of)?", 0.2),
)

#: Sentences of licence texts, file headers and notices: label, keyword, regex over the words, score. Fixed values.
STATEMENTS = (
    ("gpl", "free software foundation", "redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation", 0.95),
    ("lgpl", "free software foundation", "redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e as published by the free software foundation", 0.95),
    ("agpl", "free software foundation", "redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e as published by the free software foundation", 0.95),
    ("gpl", "received a copy", "you should have received a copy of the gnu general public licen[sc]e", 0.9),
    ("lgpl", "received a copy", "you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e", 0.9),
    ("agpl", "received a copy", "you should have received a copy of the gnu affero general public licen[sc]e", 0.9),
    ("gpl", "verbatim copies", "everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document", 0.7),
    ("gpl", "in the hope that", "distributed in the hope that it will be useful but without any warranty", 0.6),
    ("gpl-exception", "exception", "(?:classpath|linking|gcc runtime library|font) exception", 0.7),
    ("gpl-exception", "special exception", "as a special exception the copyright holders? (?:of this library )?give you permission to link", 0.9),
    ("apache-2", "apache", "licen[sc]ed under the apache licen[sc]e version 2 0 the licen[sc]e", 1.0),
    ("apache-2", "applicable law", "unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis", 0.95),
    ("apache-2", "apache", "www apache org licen[sc]es licen[sc]e 2 0", 0.95),
    ("apache", "asf", "licen[sc]ed to the apache software foundation asf under one or more contributor licen[sc]e agreements", 0.95),
    ("bsd-3", "endorse or promote", "neither the name (?:of )?(?:[a-z0-9]+ ){1,12}may be used to endorse or promote products", 0.95),
    ("bsd-4", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 0.95),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice", 0.9),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice", 0.9),
    ("bsd", "as is", "this software is provided by the (?:copyright holders|regents|authors?)(?: and contributors)? as is", 0.8),
    ("bsd-2-patent", "patent", "bsd 2 clause plus patent", 0.9),
    ("mit", "substantial portions", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.95),
    ("mit", "as is", "the software is provided as is without warranty of any kind express or implied", 0.7),
    ("mit-0", "attribution", "mit no attribution", 0.9),
    ("isc", "permission to use copy modify", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", 0.95),
    ("zlib", "held liable", "in no event will the authors? be held liable for any damages arising from the use of this software", 0.9),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented", 0.95),
    ("zlib", "plainly marked", "altered source versions must be plainly marked as such", 0.95),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0", 1.0),
    ("mpl", "mozilla", "the contents of this file are subject to the mozilla public licen[sc]e", 0.95),
    ("epl", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e", 0.95),
    ("cddl", "common development", "the contents of this file are subject to the terms of the common development and distribution licen[sc]e", 0.95),
    ("bsl", "person or organization", "free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 0.95),
    ("unlicense", "anyone is free", "anyone is free to copy modify publish use compile sell or distribute this software", 0.95),
    ("cc0", "waived all copyright", "waived all copyright and related or neighbou?ring rights", 0.95),
    ("cc", "creative commons", "this work is licen[sc]ed under a creative commons", 0.6),
    ("perl", "perl", "(?:under )?the same terms as perl itself", 0.85),
    ("python", "psf", "psf hereby grants licen[sc]ee a nonexclusive royalty free world wide licen[sc]e", 0.95),
    ("ofl", "font software", "this font software is licen[sc]ed under the sil open font licen[sc]e", 1.0),
    ("openssl", "openssl", "this product includes software developed by the openssl project", 0.9),
    ("json", "not evil", "the software shall be used for good not evil", 0.95),
    ("wtfpl", "want to public", "do what the [a-z]+ you want to public licen[sc]e", 0.95),
    ("ijg", "jpeg", "(?:based in part on the work of the )?independent jpeg group", 0.7),
    ("public-domain", "public domain", "this (?:work|file|software|code|page|text) is in the public domain", 0.8),
    ("public-domain", "no copyright", "no copyright is claimed", 0.6),
    ("public-domain", "no rights reserved", "no rights reserved", 0.6),
    ("proprietary", "strictly prohibited", "unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: [a-z]+){0,8} is strictly prohibited", 0.7),
    ("proprietary", "proprietary information", "confidential and proprietary information of", 0.7),
    ("proprietary", "may be reproduced", "no part of this (?:publication|document|book|work) may be reproduced", 0.6),
    ("proprietary", "trade secret", "(?:contains )?trade secret", 0.4),
    ("proprietary", "internal use only", "for internal use only", 0.4),
    ("proprietary", "permission of", "without the (?:prior )?(?:express )?written permission of", 0.5),
    ("commons-clause", "commons clause", "commons clause(?: licen[sc]e condition)?", 0.85),
    ("elastic", "elastic", "elastic licen[sc]e(?: version)?(?: 2 0)?", 0.85),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|shield|strict|perimeter|internal use)(?: licen[sc]e)?", 0.85),
    ("blue-oak", "blue oak", "blue oak model licen[sc]e", 0.85),
    ("mulan", "mulan", "mulan (?:permissive software licen[sc]e|public licen[sc]e|psl)", 0.85),
    ("unicode", "unicode", "unicode (?:inc )?licen[sc]e(?: agreement)?", 0.8),
    ("icu", "icu", "icu licen[sc]e", 0.8),
    ("curl", "curl", "curl licen[sc]e", 0.8),
    ("tcl", "tcl", "tcl(?: tk)? licen[sc]e", 0.8),
    ("imagemagick", "imagemagick", "imagemagick licen[sc]e", 0.85),
    ("freetype", "freetype", "freetype(?: project)? licen[sc]e", 0.85),
    ("info-zip", "info zip", "info zip licen[sc]e", 0.85),
    ("libtiff", "libtiff", "libtiff licen[sc]e", 0.85),
    ("nasa", "nasa", "nasa open source agreement", 0.85),
    ("apsl", "apple", "apple public source licen[sc]e(?: 2 0)?", 0.85),
    ("sissl", "sun industry", "sun industry standards source licen[sc]e", 0.85),
    ("rpl", "reciprocal", "reciprocal public licen[sc]e", 0.8),
    ("ogl", "open government", "open government licen[sc]e(?: v(?:ersion)?)?(?: [123] 0)?", 0.85),
    ("etalab", "licence ouverte", "licence ouverte(?: open licence)?", 0.85),
    ("pddl", "public domain", "public domain dedication and licen[sc]e", 0.85),
    ("cdla", "community data", "community data licen[sc]e agreement(?: (?:permissive|sharing))?", 0.85),
    ("openrail", "openrail", "(?:creativeml |bigcode )?openrail(?: m)?", 0.85),
    ("rail", "responsible ai", "responsible ai licen[sc]e", 0.8),
    ("llama", "llama", "llama(?: [0-9]){0,2} community licen[sc]e", 0.85),
    ("gemma", "gemma", "gemma terms of use", 0.85),
    ("gfdl", "copy distribute and or modify", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e", 0.95),
    ("spdx", "spdx", "spdx licen[sc]e identifier [a-z0-9]+", 0.5),
)

#: Further sentences of licence texts: label, keyword, regex over the words, score. Fixed values.
CLAUSES = (
    ("gpl-3", "copyleft", "the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works", 0.95),
    ("gpl-3", "anti circumvention law", "protecting users legal rights from anti circumvention law", 0.9),
    ("gpl-3", "conveying modified source versions", "conveying modified source versions", 0.8),
    ("gpl-2", "take away your freedom", "the licen[sc]es for most software are designed to take away your freedom to share and change it", 0.95),
    ("gpl-2", "distribute or publish", "you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program", 0.95),
    ("gpl", "absolutely no warranty", "(?:this program )?comes with absolutely no warranty", 0.6),
    ("gpl", "this program is free software", "this program is free software", 0.5),
    ("gnu-or-later", "at your option", "(?:either )?version [123](?: [01])? of the licen[sc]e or at your option any later version", 0.7),
    ("lgpl", "this library is free software", "this library is free software", 0.6),
    ("lgpl-3", "incorporates the terms", "this version of the gnu lesser general public licen[sc]e incorporates the terms and conditions of version 3", 0.95),
    ("lgpl-2.1", "portion of the library", "contains no derivative of any portion of the library but is designed to work with the library", 0.95),
    ("agpl-3", "network server software", "specifically designed to ensure cooperation with the community in the case of network server software", 0.95),
    ("agpl-3", "remote network interaction", "remote network interaction use with the gnu general public licen[sc]e", 0.95),
    ("gfdl", "invariant sections", "with no invariant sections no front cover texts and no back cover texts", 0.95),
    ("gfdl", "secondary section", "a secondary section is a named appendix or a front matter section", 0.95),
    ("apache-2", "authorized by the copyright owner", "the copyright owner or entity authorized by the copyright owner that is granting the licen[sc]e", 0.95),
    ("apache-2", "other recipients of the work", "you must give any other recipients of the work or derivative works a copy of this licen[sc]e", 0.95),
    ("apache-2", "no charge royalty free", "perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent|except as stated)", 0.9),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation", 0.9),
    ("apache-1.1", "must not be used to endorse", "the names apache (?:[a-z]+ ){0,6}must not be used to endorse or promote products", 0.9),
    ("mpl-2", "copy of the mpl", "if a copy of the mpl was not distributed with this file you can obtain one at", 0.95),
    ("mpl-2", "incompatible with secondary", "incompatible with secondary licen[sc]es", 0.9),
    ("mpl-1.1", "contents of this file may be used", "alternatively the contents of this file may be used under the terms of (?:either )?the gnu", 0.85),
    ("mpl-1.1", "initial developer of the original code", "the initial developer of the original code is", 0.85),
    ("mpl-1.1", "governing rights and limitations", "for the specific language governing rights and limitations", 0.8),
    ("epl", "initial agreement steward", "the eclipse foundation is the initial agreement steward", 0.95),
    ("epl", "constitutes recipient s acceptance", "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement", 0.85),
    ("epl-2", "following secondary", "this source code may also be made available under the following secondary licen[sc]es", 0.95),
    ("cddl", "opensolaris", "(?:usr src opensolaris licen[sc]e|www opensolaris org os licensing)", 0.9),
    ("cddl", "cddl header", "include this cddl header in each file", 0.95),
    ("bsd-4", "university of california", "this product includes software developed by the university of california berkeley and its contributors", 0.95),
    ("bsd", "exemplary or consequential damages", "be liable for any direct indirect incidental special exemplary or consequential damages", 0.8),
    ("bsd-3-clear", "patent rights are granted", "no express or implied licen[sc]es to any party s patent rights are granted by this licen[sc]e", 0.95),
    ("bsd-lbnl", "bug fixes patches", "you are under no obligation whatsoever to provide any bug fixes patches or upgrades", 0.95),
    ("bsd-no-nuclear", "nuclear facility", "for use in the design construction operation or maintenance of any nuclear facility", 0.9),
    ("bsd-attribution", "any form whatsoever", "redistributions of any form whatsoever must retain the following acknowledge?ment", 0.9),
    ("mit", "deal in the software", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicen[sc]e and or sell copies", 0.95),
    ("mit", "claim damages or other liability", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", 0.85),
    ("mit-modern", "without written agreement", "permission is hereby granted without written agreement and without licen[sc]e or royalty fees", 0.95),
    ("x11", "except as contained in this notice", "except as contained in this notice the names? of (?:[a-z0-9]+ ){1,10}shall not be used in advertising", 0.9),
    ("hpnd", "this software and its documentation", "permission to use copy modify and distribute this software and its documentation", 0.85),
    ("hpnd", "supporting documentation", "both that copyright notice and this permission notice appear in supporting documentation", 0.9),
    ("hpnd-sell", "and sell this software", "permission to use copy modify distribute and sell this software and its documentation", 0.9),
    ("isc", "permission notice appear in all copies", "provided that the above copyright notice and this permission notice appear in all copies", 0.85),
    ("isc", "disclaims all warranties", "the author disclaims all warranties with regard to this software", 0.8),
    ("bsl-1", "derivative works of the software", "in all copies of the software in whole or in part and all derivative works of the software", 0.95),
    ("bsl-1", "machine executable object code", "solely in the form of machine executable object code generated by a source language processor", 0.95),
    ("zlib", "granted to anyone to use this software", "permission is granted to anyone to use this software for any purpose including commercial applications", 0.95),
    ("zlib", "altered from any source", "this notice may not be removed or altered from any source distribution", 0.9),
    ("libpng", "png reference library", "the png reference library is supplied as is", 0.95),
    ("python", "psf is making python", "psf is making python(?: [0-9]){0,3} available to licen[sc]ee on an as is basis", 0.95),
    ("python-cnri", "cnri", "cnri hereby grants licen[sc]ee a nonexclusive royalty free world wide licen[sc]e", 0.95),
    ("python-beopen", "beopen", "beopen python open source licen[sc]e agreement", 0.95),
    ("php", "includes php software", "this product includes php software freely available from", 0.95),
    ("ruby", "source form of the software", "verbatim copies of the source form of the software without restriction", 0.85),
    ("artistic-1", "standard version of this package", "verbatim copies of the source form of the standard version of this package without restriction", 0.9),
    ("artistic", "collection of files distributed", "package (?:means|refers to) the collection of files distributed by the copyright holder", 0.9),
    ("perl", "artistic", "under the terms of either the gnu general public licen[sc]e or the artistic licen[sc]e", 0.9),
    ("lppl", "latex project public", "distributed and or modified under the conditions of the latex project public licen[sc]e", 0.95),
    ("lppl", "lppl maintenance status", "this work has the lppl maintenance status", 0.95),
    ("ofl", "fonts and derivatives", "the fonts and derivatives however cannot be released under any other type of licen[sc]e", 0.95),
    ("ofl", "reserved font", "with reserved font names?", 0.8),
    ("cc0", "associated a work with this deed", "the person who associated a work with this deed has dedicated the work to the public domain", 0.95),
    ("cc", "appropriate credit", "you must give appropriate credit provide a link to the licen[sc]e and indicate if changes were made", 0.85),
    ("cc-by-sa", "your contributions under the same", "you must distribute your contributions under the same licen[sc]e as the original", 0.85),
    ("cc-by-nc", "the material for commercial purposes", "you may not use the material for commercial purposes", 0.85),
    ("cc-by-nd", "distribute the modified material", "if you remix transform or build upon the material you may not distribute the modified material", 0.85),
    ("cc", "creative commons public", "provided under the terms of this creative commons public licen[sc]e", 0.9),
    ("odbl", "open database", "made available under the open database licen[sc]e", 0.95),
    ("odc-dbcl", "database contents", "licen[sc]ed under the database contents licen[sc]e", 0.9),
    ("ogl", "public sector information", "contains public sector information licen[sc]ed under the open government licen[sc]e", 0.95),
    ("rail", "derivatives of the model", "you agree not to use the model or derivatives of the model", 0.9),
    ("llama", "llama", "built with (?:meta )?llama", 0.6),
    ("gemma", "gemma", "gemma is provided under and subject to the gemma terms of use", 0.95),
    ("osl", "open software", "licen[sc]ed under the open software licen[sc]e version", 0.9),
    ("afl", "academic free", "licen[sc]ed under the academic free licen[sc]e version", 0.9),
    ("eupl", "eupl", "licen[sc]ed under the eupl", 0.9),
    ("cecill", "cecill", "governed by the cecill(?: [abc])? licen[sc]e under french law", 0.95),
    ("dual", "dual", "dual licen[sc]ed under (?:the )?(?:mit|apache|gpl|lgpl|mpl|bsd)", 0.7),
    ("proprietary", "you may not", "you may not (?:reverse engineer|decompile|disassemble)", 0.6),
    ("proprietary", "not sold", "is licen[sc]ed not sold", 0.6),
    ("proprietary", "evaluation purposes only", "for evaluation purposes only", 0.5),
    ("proprietary", "not for redistribution", "not for redistribution", 0.5),
    ("proprietary", "may not be copied", "may not be copied (?:[a-z]+ ){0,6}without", 0.5),
    ("proprietary", "end user", "end user licen[sc]e agreement", 0.5),
    ("proprietary", "non disclosure agreement", "(?:under|subject to) (?:a|the) non disclosure agreement", 0.6),
)
#: Addresses of licence texts and entries of package metadata: label, keyword, regex over the words, score. Fixed values.
ADDRESSES = (
    ("cc-by", "creativecommons org", "creativecommons org licen[sc]es by(?! (?:sa|nc|nd))", 0.95),
    ("cc-by-sa", "creativecommons org", "creativecommons org licen[sc]es by sa", 0.95),
    ("cc-by-nd", "creativecommons org", "creativecommons org licen[sc]es by nd", 0.95),
    ("cc-by-nc", "creativecommons org", "creativecommons org licen[sc]es by nc(?! (?:sa|nd))", 0.95),
    ("cc-by-nc-sa", "creativecommons org", "creativecommons org licen[sc]es by nc sa", 0.95),
    ("cc-by-nc-nd", "creativecommons org", "creativecommons org licen[sc]es by nc nd", 0.95),
    ("cc0", "creativecommons org", "creativecommons org publicdomain zero 1 0", 0.95),
    ("public-domain", "creativecommons org", "creativecommons org publicdomain mark 1 0", 0.95),
    ("gpl", "gnu org", "gnu org (?:copyleft|licen[sc]es)(?: old licen[sc]es)? gpl", 0.9),
    ("lgpl", "gnu org", "gnu org (?:copyleft|licen[sc]es)(?: old licen[sc]es)? (?:lgpl|lesser)", 0.9),
    ("agpl", "gnu org", "gnu org licen[sc]es agpl", 0.9),
    ("gfdl", "gnu org", "gnu org (?:copyleft|licen[sc]es) fdl", 0.9),
    ("mit", "opensource org", "opensource org licen[sc]es? mit", 0.95),
    ("bsd-2", "opensource org", "opensource org licen[sc]es? bsd 2 clause", 0.95),
    ("bsd-3", "opensource org", "opensource org licen[sc]es? bsd 3 clause", 0.95),
    ("isc", "opensource org", "opensource org licen[sc]es? isc", 0.95),
    ("zlib", "opensource org", "opensource org licen[sc]es? zlib", 0.95),
    ("mpl", "mozilla org", "mozilla org mpl", 0.9),
    ("epl", "eclipse org", "eclipse org legal epl", 0.9),
    ("unlicense", "unlicense org", "unlicense org", 0.9),
    ("ofl", "scripts sil org", "scripts sil org ofl", 0.95),
    ("bsl-1", "boost org", "boost org licen[sc]e 1 0", 0.95),
    ("odbl", "opendatacommons org", "opendatacommons org licen[sc]es odbl", 0.95),
    ("odc-by", "opendatacommons org", "opendatacommons org licen[sc]es by", 0.95),
    ("pddl", "opendatacommons org", "opendatacommons org licen[sc]es pddl", 0.95),
    ("wtfpl", "wtfpl net", "wtfpl net", 0.85),
    ("mit", "osi approved", "osi approved mit licen[sc]e", 0.95),
    ("apache", "osi approved", "osi approved apache software licen[sc]e", 0.95),
    ("bsd", "osi approved", "osi approved bsd licen[sc]e", 0.95),
    ("gpl", "osi approved", "osi approved gnu general public licen[sc]e", 0.95),
    ("isc", "osi approved", "osi approved isc licen[sc]e", 0.95),
    ("mpl", "osi approved", "osi approved mozilla public licen[sc]e", 0.95),
    ("mit", "mit", "licen[sc]e mit", 0.8),
    ("isc", "isc", "licen[sc]e isc", 0.8),
    ("zlib", "zlib", "licen[sc]e zlib", 0.8),
    ("proprietary", "unlicensed", "licen[sc]e unlicensed", 0.7),
)
#: Names of further licences: label, keyword, regex over the words, score. Fixed values.
NAMES = (
    ("adaptive", "adaptive public", "adaptive public licen[sc]e", 0.85),
    ("attribution-assurance", "attribution assurance", "attribution assurance licen[sc]e", 0.85),
    ("catosl", "computer associates", "computer associates trusted open source licen[sc]e", 0.85),
    ("cpal", "common public attribution", "common public attribution licen[sc]e", 0.85),
    ("cua-opl", "cua office", "cua office public licen[sc]e", 0.85),
    ("eudatagrid", "eu datagrid", "eu datagrid software licen[sc]e", 0.85),
    ("efl", "eiffel forum", "eiffel forum licen[sc]e", 0.85),
    ("entessa", "entessa", "entessa public licen[sc]e", 0.85),
    ("frameworx", "frameworx", "frameworx open licen[sc]e", 0.85),
    ("ipa", "ipa font", "ipa font licen[sc]e", 0.85),
    ("lucent", "lucent public", "lucent public licen[sc]e", 0.85),
    ("miros", "miros", "miros licen[sc]e", 0.85),
    ("motosoto", "motosoto", "motosoto (?:open source )?licen[sc]e", 0.85),
    ("multics", "multics", "multics licen[sc]e", 0.85),
    ("naumen", "naumen", "naumen public licen[sc]e", 0.85),
    ("nethack", "nethack", "nethack general public licen[sc]e", 0.85),
    ("nokia", "nokia open source", "nokia open source licen[sc]e", 0.85),
    ("nosl", "netizen open source", "netizen open source licen[sc]e", 0.85),
    ("nposl", "non profit open software", "non profit open software licen[sc]e", 0.85),
    ("ntp", "ntp", "ntp licen[sc]e", 0.8),
    ("oclc", "oclc research public", "oclc research public licen[sc]e", 0.85),
    ("ogtsl", "open group test suite", "open group test suite licen[sc]e", 0.85),
    ("rpsl", "realnetworks", "realnetworks public source licen[sc]e", 0.85),
    ("rscpl", "ricoh", "ricoh source code public licen[sc]e", 0.85),
    ("simpl", "simple public", "simple public licen[sc]e", 0.8),
    ("spl", "sun public", "sun public licen[sc]e", 0.85),
    ("vsl", "vovida", "vovida software licen[sc]e", 0.85),
    ("watcom", "open watcom", "(?:sybase )?open watcom public licen[sc]e", 0.85),
    ("xnet", "x net", "x net licen[sc]e", 0.75),
    ("fal", "free art", "free art licen[sc]e", 0.85),
    ("fal", "licence art libre", "licence art libre", 0.85),
    ("opl", "open publication", "open publication licen[sc]e", 0.85),
    ("open-gaming", "open gaming", "open gaming licen[sc]e", 0.85),
    ("dsl", "design science", "design science licen[sc]e", 0.85),
    ("solderpad", "solderpad", "solderpad hardware licen[sc]e", 0.85),
    ("cern-ohl", "cern", "cern open hardware licen[sc]e", 0.85),
    ("tapr-ohl", "tapr", "tapr open hardware licen[sc]e", 0.85),
    ("hippocratic", "hippocratic", "hippocratic licen[sc]e", 0.85),
    ("parity", "parity public", "parity public licen[sc]e", 0.85),
    ("prosperity", "prosperity public", "prosperity public licen[sc]e", 0.85),
    ("anti-996", "anti 996", "anti 996 licen[sc]e", 0.85),
    ("peer-production", "peer production", "peer production licen[sc]e", 0.85),
    ("cal", "cryptographic autonomy", "cryptographic autonomy licen[sc]e", 0.85),
    ("fsl", "functional source", "functional source licen[sc]e", 0.85),
    ("fair-source", "fair source", "fair source licen[sc]e", 0.85),
    ("sustainable-use", "sustainable use", "sustainable use licen[sc]e", 0.85),
    ("confluent", "confluent community", "confluent community licen[sc]e", 0.85),
    ("timescale", "timescale", "timescale licen[sc]e", 0.85),
    ("rsal", "redis", "redis source available licen[sc]e", 0.85),
    ("ms-eula", "microsoft software", "microsoft software licen[sc]e terms", 0.8),
    ("ms-lpl", "microsoft limited", "microsoft limited (?:public|reciprocal) licen[sc]e", 0.85),
    ("oracle", "oracle", "oracle (?:technology network|binary code) licen[sc]e", 0.8),
    ("oracle-nftc", "no fee terms", "oracle no fee terms and conditions", 0.85),
    ("nvidia", "nvidia", "nvidia (?:software )?licen[sc]e agreement", 0.8),
    ("intel", "intel simplified software", "intel simplified software licen[sc]e", 0.85),
    ("android-sdk", "android software development kit", "android software development kit licen[sc]e agreement", 0.85),
)

#: Keywords that only start a word of the rules, and those that may stand anywhere in one. All others are whole words.
STARTS, WITHIN = ("licen", "gplv", "lgplv", "beer"), ("bsd",)


def rules() -> list[dict]:
    """All rules by falling priority: exact versions with "or later", exact versions, names and statements, bare names.

    Of VERSIONED and CREATIVE each name is a rule for each version; the rules of the other tables are written one by one.
    """
    later, exact, bare = [], [], []
    for label, names, versions in VERSIONED:
        for name in names:
            word = name if "licen" not in name else next((w for w in name.split() if w.isalnum() and w not in ("gnu", "general", "public", "software", "free", "open")), "licen")
            for v in versions:
                form = f"{name}(?: version| v)? v?{v}" + "(?! [0-9])"
                tag = f"{label}-{v.replace(' 0', '').replace(' ', '.')}"
                later.append({"label": f"{tag}+", "key": word, "regex": f"{form} or (?:any )?later(?: version)?", "score": 1.0})
                exact.append({"label": tag, "key": word, "regex": form, "score": 0.95})
            if "licen" in name:
                bare.append({"label": label, "key": word, "regex": name, "score": 0.8})
    for label, code, name in CREATIVE:
        for v in VERSIONS_CC:
            exact.append({"label": f"{label}-{v.replace(' ', '.')}", "key": "cc by", "regex": f"cc {code} {v}", "score": 1.0})
            exact.append({"label": f"{label}-{v.replace(' ', '.')}", "key": "creative commons", "regex": f"creative commons {name}(?: international)? {v}", "score": 1.0})
        bare.append({"label": label, "key": "cc by", "regex": f"cc {code}(?! (?:sa|nc|nd))", "score": 0.85})
        bare.append({"label": label, "key": "creative commons", "regex": f"creative commons {name}", "score": 0.85})
    single = [{"label": label, "key": key, "regex": regex, "score": score} for label, key, regex, score in (*SINGLE, *STATEMENTS, *CLAUSES, *ADDRESSES, *NAMES)]
    return [r | {"priority": i, "key": probe(r["key"])} for i, r in enumerate([*later, *exact, *single, *bare])]


def probe(key: str) -> str:
    """What the joined words of each match hold: the key as whole words, or as far as the rules keep to words' starts."""
    return key if key in WITHIN else f" {key}" if key in STARTS else f" {key} "


def _trie(words: list[str]) -> str:
    """A regex for any of the words that reads each of a text's characters once a branch."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    branches = [re.escape(c) + ("" if "" in rest else _trie(rest)) for c, rest in sorted(heads.items())]
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"


@functools.cache
def gate() -> str:
    """A regex that the joined words match if they hold the keyword of any rule: one pass, with most words ruled out by their first letter."""
    keys = sorted({r["key"] for r in rules()})
    starts = [k[1:] for k in keys if k.startswith(" ")]
    return "|".join([f" (?=[{''.join(sorted({k[0] for k in starts}))}]){_trie(starts)}", *(k for k in keys if not k.startswith(" "))])


DETECTION = "array<struct<priority:int,s:int,e:int,label:string,score:double>>"


def _places(pattern: str) -> str:
    """SQL for the word numbers of the matches of ' ' + pattern in ' w1 w2 ... '; ends exclusive."""
    return places("_joined", f"concat(' ', {pattern}, '(?= )')", "(length({0}) - length(replace({0}, ' ', '')))")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts and places of the base phrases, detections of the rules, labels and a score."""
    table = "from_json('" + json.dumps(rules()).replace("\\", "\\\\").replace("'", "\\'") + "', 'array<struct<priority:int,label:string,key:string,regex:string,score:double>>')"
    lower = ascii_lower(text_or_empty(text))
    parts = docs.select(F.col(key).alias("doc_id"), F.array_remove(F.split(lower, WORD_SEPARATOR), "").alias("_words"))
    parts = parts.select("doc_id", F.size("_words").cast("long").alias("n_words"), F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" ")).alias("_text"))
    joined = parts.select("doc_id", "n_words", F.when(F.col("_text").rlike(gate()), F.col("_text")).alias("_joined"))
    base = [F.expr(f"if(contains(_joined, ' {phrase} '), transform({_places(f"'{phrase}'")}, p -> p.s), CAST(array() AS array<int>))").alias(f"_{label}") for phrase, label in BASE]
    each = f"transform({_places('r.regex')}, p -> struct(r.priority AS priority, p.s AS s, p.e AS e, r.label AS label, r.score AS score))"
    keys = "array(" + ", ".join(f"'{k}'" for k in sorted({r["key"] for r in rules()})) + ")"
    every = let("present_", f"filter({keys}, k -> contains(_joined, k))", f"flatten(transform(filter({table}, r -> array_contains(present_, r.key)), r -> {each}))")
    inside = "x.priority < d.priority AND x.s <= d.s AND x.e >= d.e"
    kept = let("every_", every, let("rivals_", tree("every_"), f"filter(every_, d -> NOT {meets('rivals_', 'd', inside)})"))
    found = joined.select("doc_id", "n_words", *base, F.expr(f"if(_joined IS NULL, CAST(array() AS {DETECTION}), {kept})").alias("detections"))
    starts = F.concat(*[F.coalesce(f"_{label}", F.array().cast("array<int>")) for _, label in BASE])
    here = F.filter(F.array(*[F.when(F.size(f"_{label}") > 0, F.lit(label)) for _, label in BASE]), lambda x: x.isNotNull())
    out = found.select("doc_id", "n_words", starts.alias("_starts"), here.alias("_base"), "detections")
    labels = F.array_sort(F.array_distinct(F.concat("_base", F.transform("detections", lambda d: d["label"]))))
    best = F.aggregate(F.transform("detections", lambda d: d["score"]), F.when(F.size("_base") > 0, 0.8).otherwise(0.0), lambda a, x: F.greatest(a, x))
    return out.select(
        "doc_id",
        "n_words",
        F.size("_starts").cast("long").alias("n_base"),
        F.array_min("_starts").cast("long").alias("first_word"),
        F.array_max("_starts").cast("long").alias("last_word"),
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        best.alias("score"),
        "detections",
    )
