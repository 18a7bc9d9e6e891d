"""Signatures of licenses, written one by one: (label, priority, keyword, regular expression).

An expression is matched against a text's words, lower-cased and with single spaces between
them, from one word's begin to another's end. Every match contains the keyword.

Priority 6 is a negation, which suppresses what it contains; 5 a tag made for machines; 4 a
grant ("licensed under"); 3 a sentence of a license's own text or of its usual notice, or an
exception to it; 2 a license's title; 1 a short name that needs its version to be telling.
"""

from __future__ import annotations

SIGNATURES: tuple[tuple[str, int, str, str], ...] = (
    # MIT and its kin.
    ("mit", 5, "identifier mit", "spdx license identifier mit"),
    ("mit-0", 5, "identifier mit 0", "spdx license identifier mit 0"),
    ("mit", 4, "the mit license", "(?:licensed|released|distributed|published|provided|available) under (?:the terms of )?the mit license"),
    ("mit", 4, "under mit", "(?:licensed|released|available) under mit"),
    ("mit", 4, "under the mit", "(?:licensed|released|distributed|available) under the mit"),
    ("mit", 3, "obtaining a copy of this software", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", 3, "deal in the software without restriction", "to deal in the software without restriction(?: including without limitation the rights to use copy modify merge publish distribute sublicense)?"),
    ("mit", 3, "substantial portions of the software", "this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 3, "opensource org licenses mit", "opensource org licenses mit(?: license php)?"),
    ("mit", 2, "mit license", "(?:the )?mit license"),
    ("mit", 2, "mit licence", "(?:the )?mit licence"),
    ("mit", 2, "license mit", "license mit"),
    ("mit", 2, "license is mit", "license is mit"),
    ("mit", 2, "mit licensed", "mit licensed"),
    ("mit", 2, "expat license", "(?:the )?expat license"),
    ("x11", 2, "x11 license", "(?:mit )?x11 license"),
    ("mit-0", 2, "mit no attribution", "mit no attribution(?: license)?"),
    ("isc", 5, "identifier isc", "spdx license identifier isc"),
    ("isc", 4, "isc license", "(?:licensed|released|distributed|available) under the isc license"),
    ("isc", 3, "for any purpose with or without fee is hereby granted", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 2, "isc license", "(?:the )?isc license"),
    ("isc", 2, "isc licence", "isc licence"),
    ("0bsd", 5, "identifier 0bsd", "spdx license identifier 0bsd"),
    ("0bsd", 2, "zero clause bsd", "zero clause bsd(?: license)?"),
    ("0bsd", 2, "0bsd", "(?:license 0bsd|0bsd license)"),
    # BSD.
    ("bsd-2", 5, "identifier bsd 2 clause", "spdx license identifier bsd 2 clause(?: patent| views)?"),
    ("bsd-3", 5, "identifier bsd 3 clause", "spdx license identifier bsd 3 clause(?: clear)?"),
    ("bsd-4", 5, "identifier bsd 4 clause", "spdx license identifier bsd 4 clause"),
    ("bsd", 4, "bsd", "(?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the |a )?bsd(?: style)? licen[cs]e"),
    ("bsd", 4, "under the bsd", "(?:licensed|released|available) under the bsd"),
    ("bsd", 3, "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 3, "redistributions of source code must retain", "redistributions of source code must retain the above copyright notice"),
    ("bsd", 3, "redistributions in binary form must reproduce", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3", 3, "to endorse or promote products derived from this software", "(?:may|must) (?:not )?be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4", 3, "all advertising materials mentioning", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", 3, "bsd style license that can be found", "(?:governed by|under) a bsd style license that can be found in the license file"),
    ("bsd-2", 2, "simplified bsd", "simplified bsd(?: licen[cs]e)?"),
    ("bsd-2", 2, "freebsd licen", "freebsd licen[cs]e"),
    ("bsd-2", 2, "2 clause bsd", "2 clause bsd(?: licen[cs]e)?"),
    ("bsd-2", 2, "two clause bsd", "two clause bsd(?: licen[cs]e)?"),
    ("bsd-2", 2, "bsd 2 clause", "bsd 2 clause(?: simplified)?(?: licen[cs]e)?"),
    ("bsd-3", 2, "new bsd", "new bsd licen[cs]e"),
    ("bsd-3", 2, "modified bsd", "modified bsd(?: licen[cs]e)?"),
    ("bsd-3", 2, "revised bsd", "revised bsd(?: licen[cs]e)?"),
    ("bsd-3", 2, "3 clause bsd", "3 clause bsd(?: licen[cs]e)?"),
    ("bsd-3", 2, "three clause bsd", "three clause bsd(?: licen[cs]e)?"),
    ("bsd-3", 2, "bsd 3 clause", "bsd 3 clause(?: new or revised| clear)?(?: licen[cs]e)?"),
    ("bsd-4", 2, "original bsd", "original bsd licen[cs]e"),
    ("bsd-4", 2, "4 clause bsd", "4 clause bsd(?: licen[cs]e)?"),
    ("bsd-4", 2, "bsd 4 clause", "bsd 4 clause(?: licen[cs]e)?"),
    ("bsd", 2, "bsd licen", "(?:the )?bsd licen[cs]e"),
    ("bsd", 2, "license bsd", "license bsd"),
    ("bsd", 2, "berkeley software distribution", "berkeley software distribution licen[cs]e"),
    # Apache.
    ("apache", 5, "identifier apache", "spdx license identifier apache (?:1 0|1 1|2 0)"),
    ("apache", 4, "the apache license", "(?:licensed|released|distributed|published|provided|available) under (?:the terms of )?the apache license(?: version)?(?: 2 0)?"),
    ("apache", 4, "under the apache", "(?:licensed|released|distributed|published|available) under the apache(?: 2 0| v2)?"),
    ("apache", 4, "under apache", "(?:licensed|released|available) under apache(?: license)?(?: 2 0| v2)?"),
    ("apache", 3, "in compliance with the license", "you may not use this (?:file|work|software) except in compliance with the license"),
    ("apache", 3, "apache org licenses license 2 0", "www apache org licenses license 2 0"),
    ("apache", 3, "on an as is basis without warranties", "distributed on an as is basis without warranties or conditions of any kind"),
    ("apache", 3, "see the license for the specific language", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache", 3, "to the apache software foundation", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache", 3, "the apache software foundation", "this product includes software developed (?:by|at) the apache software foundation"),
    ("apache", 2, "apache license", "(?:the )?apache license(?: version)?(?: (?:1 0|1 1|2 0))?"),
    ("apache", 2, "apache software license", "(?:the )?apache software license(?: version)?(?: (?:1 0|1 1|2 0))?"),
    ("apache", 2, "apache licence", "(?:the )?apache licence(?: version)?(?: 2 0)?"),
    ("apache", 2, "license apache", "license apache(?: 2 0)?"),
    ("apache", 1, "apache 2", "apache 2(?: 0)?"),
    ("apache", 1, "apache v2", "apache v2(?: 0)?"),
    ("apache", 1, "asl 2 0", "asl 2 0"),
    # GNU general public.
    ("gpl", 5, "identifier gpl", "spdx license identifier gpl (?:1 0|2 0|3 0)(?: only| or later)?"),
    ("gpl", 4, "gnu general public license", "(?:licensed|released|distributed|published|available) under (?:the terms of )?the gnu general public license(?: version (?:2|3))?"),
    ("gpl", 4, "under the gpl", "(?:licensed|released|distributed|published|available) under the gpl(?: (?:v|version )?(?:2|3))?"),
    ("gpl", 4, "under gpl", "(?:licensed|released|available) under gpl(?: (?:v|version )?(?:2|3))?"),
    ("gpl", 4, "under the gnu gpl", "(?:licensed|released|distributed|available) under the gnu gpl(?: (?:v|version )?(?:2|3))?"),
    ("gpl", 3, "under the terms of the gnu general public license", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", 3, "either version", "either version (?:2|3) of the license or at your option any later version"),
    ("gpl", 3, "you should have received a copy of the gnu general public", "you should have received a copy of the gnu general public license along with this (?:program|software|library)"),
    ("gpl", 3, "see the gnu general public license", "see the gnu general public license for more details"),
    ("gpl", 3, "covered by the gnu general public", "covered by the gnu general public license"),
    ("gpl", 3, "protect your rights we need to", "to protect your rights we need to prevent others from denying you these rights"),
    ("gpl", 3, "gnu org licenses gpl", "gnu org licenses gpl(?: (?:2 0|3 0))?(?: html| txt)?"),
    ("gpl", 2, "general public license", "(?:gnu )?general public license(?: (?:version |v)?(?:1|2|3)(?: 0)?)?(?: or (?:any )?later)?"),
    ("gpl", 2, "general public licence", "(?:gnu )?general public licence(?: (?:version |v)?(?:1|2|3)(?: 0)?)?"),
    ("gpl", 2, "gnu gpl", "gnu gpl(?: (?:version |v)?(?:1|2|3)(?: 0)?)?"),
    ("gpl", 2, "gpl license", "gpl license"),
    ("gpl", 2, "license gpl", "license gpl(?: (?:version |v)?(?:2|3)(?: 0)?)?"),
    ("gpl", 1, "gplv", "gplv(?:1|2|3)"),
    ("gpl", 1, " gpl ", "gpl (?:version |v)?(?:1|2|3)(?: 0)?(?: only| or later)?"),
    # Lesser, library and Affero.
    ("lgpl", 5, "identifier lgpl", "spdx license identifier lgpl (?:2 0|2 1|3 0)(?: only| or later)?"),
    ("lgpl", 4, "gnu lesser general public license", "(?:licensed|released|distributed|available) under (?:the terms of )?the gnu lesser general public license"),
    ("lgpl", 4, "under the lgpl", "(?:licensed|released|distributed|available) under the lgpl"),
    ("lgpl", 3, "under the terms of the gnu lesser general public license", "redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl", 3, "you should have received a copy of the gnu lesser", "you should have received a copy of the gnu lesser general public license"),
    ("lgpl", 3, "terms of the gnu library general public", "under the terms of the gnu library general public license"),
    ("lgpl", 2, "lesser general public license", "(?:gnu )?lesser general public license(?: (?:version |v)?(?:2 1|3|3 0))?(?: or later)?"),
    ("lgpl", 2, "lesser general public licence", "(?:gnu )?lesser general public licence"),
    ("lgpl", 2, "library general public license", "(?:gnu )?library general public license(?: (?:version |v)?2(?: 0)?)?"),
    ("lgpl", 2, "gnu lgpl", "gnu lgpl"),
    ("lgpl", 2, "license lgpl", "license lgpl"),
    ("lgpl", 1, "lgplv", "lgplv(?:2 1|2|3)"),
    ("lgpl", 1, " lgpl ", "lgpl (?:version |v)?(?:2 0|2 1|3 0|2|3)(?: only| or later)?"),
    ("agpl", 5, "identifier agpl", "spdx license identifier agpl (?:1 0|3 0)(?: only| or later)?"),
    ("agpl", 4, "affero general public license", "(?:licensed|released|distributed|available) under (?:the terms of )?the gnu affero general public license"),
    ("agpl", 4, "under the agpl", "(?:licensed|released|available) under the agpl"),
    ("agpl", 3, "remote network interaction", "remote network interaction use with the gnu general public license"),
    ("agpl", 3, "you should have received a copy of the gnu affero", "you should have received a copy of the gnu affero general public license"),
    ("agpl", 2, "affero general public license", "(?:gnu )?affero general public license(?: (?:version |v)?(?:1|3)(?: 0)?)?"),
    ("agpl", 2, "gnu agpl", "gnu agpl"),
    ("agpl", 1, "agplv", "agplv3"),
    ("agpl", 1, " agpl ", "agpl (?:version |v)?(?:1 0|3 0|3)(?: only| or later)?"),
    ("gfdl", 5, "identifier gfdl", "spdx license identifier gfdl (?:1 1|1 2|1 3)(?: only| or later)?"),
    ("gfdl", 3, "no invariant sections", "with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", 2, "gnu free documentation license", "gnu free documentation license(?: version (?:1 1|1 2|1 3))?"),
    # Exceptions.
    ("exception-classpath", 3, "classpath exception", "(?:with (?:the )?)?(?:gnu )?classpath exception(?: 2 0)?"),
    ("exception-classpath", 3, "link this library with independent modules", "permission to link this library with independent modules to produce an executable"),
    ("exception-gcc", 3, "gcc runtime library exception", "gcc runtime library exception(?: version)?(?: 3 1)?"),
    ("exception-gcc", 3, "gcc exception", "with gcc exception (?:2 0|3 1)"),
    ("exception-llvm", 3, "llvm exception", "with llvm exceptions?"),
    ("exception-autoconf", 3, "autoconf exception", "with autoconf exception(?: 2 0| 3 0)?"),
    ("exception-autoconf", 3, "configuration script generated by autoconf", "distributed as part of a program that contains a configuration script generated by autoconf"),
    ("exception-bison", 3, "bison exception", "with bison exception(?: 2 2)?"),
    ("exception-bison", 3, "special exception you may create a larger work", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("exception-openssl", 3, "openssl exception", "(?:with (?:the )?)?openssl exception"),
    ("exception-openssl", 3, "with the openssl library", "permission to link the code of (?:portions of )?this program with the openssl library"),
    ("exception-font", 3, "font exception", "with font exception(?: 2 0)?"),
    ("exception-font", 3, "create a document which uses this font", "if you create a document which uses this font"),
    ("exception-linking", 3, "linking exception", "(?:with )?(?:a |the )?(?:static |gpl )?linking exception"),
    ("exception-syscall", 3, "linux syscall note", "with linux syscall note"),
    ("exception-universal", 3, "universal foss exception", "(?:with )?universal foss exception(?: version)?(?: 1 0)?"),
    # Mozilla, Eclipse, Sun, IBM, European Union.
    ("mpl", 5, "identifier mpl", "spdx license identifier mpl (?:1 0|1 1|2 0)"),
    ("mpl", 4, "mozilla public license", "(?:licensed|released|distributed|available) under (?:the terms of )?the mozilla public license"),
    ("mpl", 3, "subject to the terms of the mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", 3, "a copy of the mpl was not distributed", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl", 3, "subject to the mozilla public license", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl", 2, "mozilla public license", "(?:the )?mozilla public license(?: (?:version |v ?)?(?:1 0|1 1|2 0))?"),
    ("mpl", 2, "mozilla public licence", "mozilla public licence"),
    ("mpl", 1, " mpl ", "mpl (?:version |v ?)?(?:1 0|1 1|2 0)"),
    ("npl", 2, "netscape public license", "netscape public license(?: version)?(?: 1 0| 1 1)?"),
    ("epl", 5, "identifier epl", "spdx license identifier epl (?:1 0|2 0)"),
    ("epl", 3, "eclipse public license", "made available under the terms of the eclipse public license"),
    ("epl", 2, "eclipse public license", "(?:the )?eclipse public license(?: (?:version |v ?)?(?:1 0|2 0))?"),
    ("edl", 2, "eclipse distribution license", "eclipse distribution license(?: (?:version |v ?)?1 0)?"),
    ("epl", 1, " epl ", "epl (?:version |v ?)?(?:1 0|2 0)"),
    ("cpl", 2, "common public license", "(?:ibm )?common public license(?: (?:version |v ?)?1 0)?"),
    ("ipl", 2, "ibm public license", "ibm public license(?: (?:version |v ?)?1 0)?"),
    ("cddl", 5, "identifier cddl", "spdx license identifier cddl (?:1 0|1 1)"),
    ("cddl", 3, "subject to the terms of the common development", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", 2, "common development and distribution license", "(?:the )?common development and distribution license(?: (?:version |v ?)?(?:1 0|1 1))?"),
    ("cddl", 1, " cddl ", "cddl (?:version |v ?)?(?:1 0|1 1)"),
    ("spl", 2, "sun public license", "sun public license(?: (?:version |v ?)?1 0)?"),
    ("cpal", 2, "common public attribution license", "common public attribution license(?: (?:version )?1 0)?"),
    ("eupl", 5, "identifier eupl", "spdx license identifier eupl (?:1 0|1 1|1 2)"),
    ("eupl", 3, "licensed under the eupl", "licensed under the eupl(?: version)?(?: 1 1| 1 2)?(?: or as soon they will be approved)?"),
    ("eupl", 2, "european union public licence", "european union public licence(?: (?:version |v ?)?(?:1 1|1 2))?"),
    ("eupl", 2, "european union public license", "european union public license(?: (?:version |v ?)?(?:1 1|1 2))?"),
    ("eupl", 1, " eupl ", "eupl (?:version |v ?)?(?:1 0|1 1|1 2)"),
    ("cecill", 2, "cecill", "cecill (?:free software )?licen[cs]e(?: agreement)?(?: version 2 1)?"),
    ("osl", 2, "open software license", "open software license(?: (?:version |v ?)?(?:2 1|3 0))?"),
    ("afl", 2, "academic free license", "academic free license(?: (?:version |v ?)?(?:2 1|3 0))?"),
    ("rpl", 2, "reciprocal public license", "reciprocal public license(?: (?:version )?1 5)?"),
    ("qpl", 2, "q public license", "(?:the )?q public license(?: version 1 0)?"),
    ("artistic", 5, "identifier artistic", "spdx license identifier artistic (?:1 0|2 0)(?: perl)?"),
    ("artistic", 2, "artistic license", "(?:the )?(?:perl )?artistic license(?: (?:version |v ?)?(?:1 0|2 0))?"),
    ("artistic", 3, "same terms as perl itself", "under the same terms as perl itself"),
    # Small and short ones.
    ("zlib", 5, "identifier zlib", "spdx license identifier zlib"),
    ("zlib", 3, "origin of this software must not be misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 3, "altered source versions must be plainly marked", "altered source versions must be plainly marked as such"),
    ("zlib", 2, "zlib licen", "(?:the )?zlib licen[cs]e"),
    ("zlib", 2, "zlib libpng", "zlib libpng licen[cs]e"),
    ("libpng", 2, "libpng license", "(?:the )?libpng license(?: version 2)?"),
    ("boost", 5, "identifier bsl", "spdx license identifier bsl 1 0"),
    ("boost", 3, "boost software license", "distributed under the boost software license version 1 0"),
    ("boost", 2, "boost software license", "(?:the )?boost software license(?: (?:version |v ?)?1 0)?"),
    ("boost", 2, "boost license", "boost license"),
    ("unlicense", 5, "identifier unlicense", "spdx license identifier unlicense"),
    ("unlicense", 3, "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("unlicense", 2, "the unlicense", "(?:licensed under |released under )?the unlicense"),
    ("wtfpl", 5, "identifier wtfpl", "spdx license identifier wtfpl"),
    ("wtfpl", 2, "what the fuck you want to public", "do what the fuck you want to public licen[cs]e(?: version 2)?"),
    ("wtfpl", 2, "wtfpl", "(?:the )?wtfpl(?: version 2| licen[cs]e)?"),
    ("beerware", 2, "beer ware license", "(?:the )?beer ware license(?: revision 42)?"),
    ("beerware", 3, "you can buy me a beer", "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("postgresql", 2, "postgresql licen", "(?:the )?postgresql licen[cs]e"),
    ("ncsa", 2, "illinois ncsa open source", "university of illinois ncsa open source licen[cs]e"),
    ("w3c", 2, "w3c software", "w3c software (?:notice and )?(?:and document )?licen[cs]e"),
    ("icu", 2, "icu license", "(?:the )?icu license(?: icu 1 8 1)?"),
    ("unicode", 2, "unicode license", "unicode license(?: v3| agreement)?"),
    ("curl", 2, "curl license", "(?:the )?curl license"),
    ("ftl", 2, "freetype project license", "(?:the )?freetype project license"),
    ("ijg", 2, "independent jpeg group", "this software is based in part on the work of the independent jpeg group"),
    ("hpnd", 2, "historical permission notice and disclaimer", "historical permission notice and disclaimer"),
    ("vim", 2, "vim license", "(?:the )?vim license"),
    ("ruby", 2, "ruby license", "(?:the )?ruby license"),
    ("ruby", 3, "same terms as ruby", "under the same terms as ruby(?: itself)?"),
    ("php", 2, "php license", "(?:the )?php license(?: (?:version |v ?)?(?:3 0|3 01))?"),
    ("php", 3, "php net license", "www php net license 3 01 txt"),
    ("python", 5, "identifier python", "spdx license identifier python 2 0"),
    ("python", 2, "python software foundation license", "(?:the )?python software foundation license(?: version 2)?"),
    ("python", 2, "psf license", "(?:the )?psf license(?: agreement)?"),
    ("openssl", 2, "openssl license", "(?:the )?openssl license"),
    ("openssl", 3, "use in the openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("tcl", 2, "tcl tk license", "(?:the )?tcl tk license"),
    ("mulan", 2, "mulan permissive software license", "mulan permissive software license(?: version)?(?: 2)?"),
    ("ms-pl", 2, "microsoft public license", "microsoft public license(?: ms pl)?"),
    ("ms-rl", 2, "microsoft reciprocal license", "microsoft reciprocal license(?: ms rl)?"),
    ("upl", 2, "universal permissive license", "universal permissive license(?: (?:version |v ?)?1 0)?"),
    ("json", 3, "good not evil", "the software shall be used for good not evil"),
    ("ofl", 5, "identifier ofl", "spdx license identifier ofl 1 1"),
    ("ofl", 3, "licensed under the sil open font", "this font software is licensed under the sil open font license"),
    ("ofl", 2, "open font license", "(?:sil )?open font license(?: (?:version |v ?)?1 1)?"),
    # Source available and commercial.
    ("sspl", 2, "server side public license", "server side public license(?: (?:version |v ?)?1)?"),
    ("busl", 2, "business source license", "business source license(?: (?:version )?1 1)?"),
    ("elastic", 2, "elastic license", "elastic license(?: 2 0| v2)?"),
    ("commons-clause", 2, "commons clause", "commons clause(?: license condition)?(?: v1 0)?"),
    ("polyform", 2, "polyform", "polyform (?:noncommercial|small business|strict) license(?: 1 0 0)?"),
    ("proprietary", 3, "proprietary and confidential", "(?:this (?:software|file|document) is )?proprietary and confidential"),
    ("proprietary", 3, "unauthorized copying of this", "unauthorized copying of this (?:file|software|document)(?: via any medium)? is strictly prohibited"),
    ("proprietary", 3, "no part of this publication may be reproduced", "no part of this (?:publication may be reproduced|publication may be reproduced stored or transmitted)"),
    ("proprietary", 2, "end user license agreement", "end user license agreement"),
    ("proprietary", 2, "commercial license", "(?:under )?a commercial license"),
    ("all-rights-reserved", 1, "rights reserved", "all rights reserved"),
    ("all-rights-reserved", 1, "tous droits r", "tous droits réservés"),
    ("all-rights-reserved", 1, "alle rechte vorbehalten", "alle rechte vorbehalten"),
    ("all-rights-reserved", 1, "todos los derechos reservados", "todos los derechos reservados"),
    # Creative Commons.
    ("cc0", 5, "identifier cc0", "spdx license identifier cc0 1 0"),
    ("cc-by", 5, "identifier cc by ", "spdx license identifier cc by (?:1 0|2 0|2 5|3 0|4 0)"),
    ("cc-by-sa", 5, "identifier cc by sa", "spdx license identifier cc by sa (?:1 0|2 0|2 5|3 0|4 0)"),
    ("cc-by-nc", 5, "identifier cc by nc ", "spdx license identifier cc by nc (?:1 0|2 0|2 5|3 0|4 0)"),
    ("cc0", 4, "under cc0", "(?:licensed|released|available) under cc0(?: 1 0)?"),
    ("cc0", 3, "to the extent possible under law", "to the extent possible under law the (?:author|authors|person who associated cc0 with this work) (?:has|have) waived all copyright"),
    ("cc0", 2, "cc0 1 0 universal", "(?:creative commons )?cc0 1 0 universal(?: public domain dedication)?"),
    ("cc0", 1, " cc0 ", "cc0 1 0"),
    ("cc-by", 4, "under cc by", "(?:licensed|released|available|shared) under cc by(?: (?:1 0|2 0|2 5|3 0|4 0))?"),
    ("cc-by-sa", 4, "under cc by sa", "(?:licensed|released|available|shared) under cc by sa(?: (?:1 0|2 0|2 5|3 0|4 0))?"),
    ("cc-by-nc", 4, "under cc by nc", "(?:licensed|released|available|shared) under cc by nc(?: (?:1 0|2 0|2 5|3 0|4 0))?"),
    ("cc-by-nd", 4, "under cc by nd", "(?:licensed|released|available|shared) under cc by nd(?: (?:1 0|2 0|2 5|3 0|4 0))?"),
    ("cc-by-nc-sa", 4, "under cc by nc sa", "(?:licensed|released|available|shared) under cc by nc sa(?: (?:1 0|2 0|2 5|3 0|4 0))?"),
    ("cc-by-nc-nd", 4, "under cc by nc nd", "(?:licensed|released|available|shared) under cc by nc nd(?: (?:1 0|2 0|2 5|3 0|4 0))?"),
    ("cc-by", 3, "creativecommons org licenses by ", "creativecommons org licenses by (?:1 0|2 0|2 5|3 0|4 0)"),
    ("cc-by-sa", 3, "creativecommons org licenses by sa", "creativecommons org licenses by sa (?:1 0|2 0|2 5|3 0|4 0)"),
    ("cc-by-nc", 3, "creativecommons org licenses by nc ", "creativecommons org licenses by nc (?:1 0|2 0|2 5|3 0|4 0)"),
    ("cc-by-nc-sa", 3, "creativecommons org licenses by nc sa", "creativecommons org licenses by nc sa (?:1 0|2 0|2 5|3 0|4 0)"),
    ("cc-by-nc-nd", 3, "creativecommons org licenses by nc nd", "creativecommons org licenses by nc nd (?:1 0|2 0|2 5|3 0|4 0)"),
    ("cc0", 3, "creativecommons org publicdomain zero", "creativecommons org publicdomain zero 1 0"),
    ("cc-by", 2, "creative commons attribution", "creative commons attribution(?: (?:1 0|2 0|2 5|3 0|4 0))?(?: international| unported| generic)?(?: licen[cs]e)?"),
    ("cc-by-sa", 2, "creative commons attribution share", "creative commons attribution share ?alike(?: (?:1 0|2 0|2 5|3 0|4 0))?(?: international| unported| generic)?(?: licen[cs]e)?"),
    ("cc-by-nc", 2, "creative commons attribution non", "creative commons attribution non ?commercial(?: (?:1 0|2 0|2 5|3 0|4 0))?(?: international| unported| generic)?(?: licen[cs]e)?"),
    ("cc-by-nd", 2, "creative commons attribution no", "creative commons attribution no ?deriv(?:atives|s)(?: (?:1 0|2 0|2 5|3 0|4 0))?(?: licen[cs]e)?"),
    ("cc-by-nc-sa", 2, "creative commons attribution non", "creative commons attribution non ?commercial share ?alike(?: (?:1 0|2 0|2 5|3 0|4 0))?(?: licen[cs]e)?"),
    ("cc-by-nc-nd", 2, "creative commons attribution non", "creative commons attribution non ?commercial no ?deriv(?:atives|s)(?: (?:1 0|2 0|2 5|3 0|4 0))?(?: licen[cs]e)?"),
    ("cc", 2, "creative commons licen", "(?:a |the )?creative commons licen[cs]e"),
    ("cc-by", 1, " cc by ", "cc by (?:1 0|2 0|2 5|3 0|4 0)"),
    ("cc-by-sa", 1, " cc by sa ", "cc by sa(?: (?:1 0|2 0|2 5|3 0|4 0))?"),
    ("cc-by-nc", 1, " cc by nc ", "cc by nc(?: (?:1 0|2 0|2 5|3 0|4 0))?"),
    ("cc-by-nd", 1, " cc by nd ", "cc by nd(?: (?:1 0|2 0|2 5|3 0|4 0))?"),
    ("cc-by-nc-sa", 1, " cc by nc sa ", "cc by nc sa(?: (?:1 0|2 0|2 5|3 0|4 0))?"),
    ("cc-by-nc-nd", 1, " cc by nc nd ", "cc by nc nd(?: (?:1 0|2 0|2 5|3 0|4 0))?"),
    # Data, documents, public domain.
    ("odbl", 2, "open database license", "(?:odc )?open database license(?: (?:version |v ?)?1 0)?"),
    ("odbl", 1, " odbl ", "odbl(?: v?1 0)?"),
    ("odc-by", 2, "open data commons attribution", "open data commons attribution license(?: (?:version |v ?)?1 0)?"),
    ("pddl", 2, "public domain dedication and license", "public domain dedication and license(?: (?:version |v ?)?1 0)?"),
    ("cdla", 2, "community data license agreement", "community data license agreement(?: permissive| sharing)?(?: (?:version )?(?:1 0|2 0))?"),
    ("ogl-uk", 2, "open government licence", "open government licence(?: (?:version |v ?)?(?:1 0|2 0|3 0))?"),
    ("etalab", 2, "licence ouverte", "licence ouverte(?: open licence)?(?: etalab)?"),
    ("dl-de", 2, "datenlizenz deutschland", "datenlizenz deutschland (?:namensnennung|zero)(?: version)?(?: 2 0)?"),
    ("ogl", 2, "open game license", "open game license(?: version 1 0a?)?"),
    ("free-art", 2, "free art license", "free art license(?: 1 3)?"),
    ("public-domain", 3, "dedicated to the public domain", "(?:is |are )?(?:hereby )?dedicated to the public domain"),
    ("public-domain", 3, "released into the public domain", "(?:is |are )?(?:hereby )?released into the public domain"),
    ("public-domain", 3, "placed in the public domain", "(?:is |are |has been )?placed in the public domain"),
    ("public-domain", 3, "this work is in the public domain", "this work is in the public domain"),
    ("public-domain", 3, "work of the united states government", "a work of the united states government"),
    ("public-domain", 2, "public domain", "public domain"),
    ("dual", 3, "dual licensed", "dual licensed(?: under)?"),
    ("dual", 3, "disjunctive", "a disjunctive license"),
    ("unknown-license", 2, "licensed under", "licensed under [^ ]+"),
    ("unknown-license", 2, "licenced under", "licenced under [^ ]+"),
    ("unknown-license", 3, "identifier", "spdx license identifier [^ ]+"),
    ("unknown-license", 1, "see the license file", "see the license file(?: for details)?"),
    ("unknown-license", 1, "license agreement", "this license agreement"),
    ("unknown-license", 1, "lizenziert unter", "lizenziert unter [^ ]+"),
    ("unknown-license", 1, "sous licence", "sous licence [^ ]+"),
    ("unknown-license", 1, "bajo licencia", "bajo licencia [^ ]+"),
    # Negations: what they contain is no license of the text.
    ("not-licensed", 6, "not licensed under", "(?:is |are )?not licensed under (?:the )?[^ ]+(?: [^ ]+)?(?: licen[cs]e)?"),
    ("not-licensed", 6, "not covered by", "(?:is |are )?not covered by (?:the )?[^ ]+(?: [^ ]+)? licen[cs]e"),
    ("not-licensed", 6, "not released under", "(?:is |are )?not released under (?:the )?[^ ]+(?: [^ ]+)?(?: licen[cs]e)?"),
    ("not-licensed", 6, "not available under", "(?:is |are )?not available under (?:the )?[^ ]+(?: licen[cs]e)?"),
    ("not-licensed", 6, "no longer licensed under", "(?:is |are )?no longer licensed under (?:the )?[^ ]+(?: licen[cs]e)?"),
    ("not-licensed", 6, "incompatible with the", "incompatible with the [^ ]+(?: [^ ]+)? licen[cs]e"),
    ("not-licensed", 6, "not in the public domain", "(?:is |are )?not in the public domain"),
    ("not-licensed", 6, "unlike the", "unlike the [^ ]+(?: general public)? licen[cs]e"),
    ("not-licensed", 6, "instead of the", "instead of the [^ ]+(?: general public)? licen[cs]e"),
    ("not-licensed", 6, "no license is granted", "no license is granted(?: under [^ ]+)?"),
    ("not-licensed", 6, "does not grant", "this (?:document|notice|file) does not grant (?:any |a )?licen[cs]e"),
)
