"""Signatures of licences, written by hand, each with a text that it finds.

A signature is (label, keywords, pattern, priority, confidence, example).  Patterns run over words in lower case, one space
apart, in which every character but letters, digits and those beyond ASCII is a space: "Apache-2.0" reads "apache 2 0".
"""

from __future__ import annotations

# Priorities: identifiers, sentences of a licence's text, headers of files, notices, names with a version, names, short forms.
SPDX, TEXT, HEADER, NOTICE, NAMED, NAME, SHORT, WEAK = 100, 95, 90, 85, 80, 70, 60, 50

# A version may be announced, and a last ".0" be missing.
_V = "(?:version |ver |v ?)?"
_LATER = "(?: or(?: at your option)?(?: any)? (?:later|newer|greater)(?: versions?)?| ?plus)"
_UNDER = ("(?:licen[sc]ed|released|distributed|available|published|provided|offered|shared|covered|dual licen[sc]ed) under "
          "(?:the )?(?:terms of )?(?:the |an? )?")
_OPTION = "or at your option any later version"
_BY = "as published by the free software foundation"
_CC = "creative commons "

# SPDX identifiers and the labels they give where these are not the identifier itself in lower case.
SPDX_IDS = (
    "MIT MIT-0 ISC 0BSD BSD-2-Clause BSD-3-Clause BSD-4-Clause Apache-1.1 Apache-2.0 MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 "
    "EUPL-1.2 CDDL-1.0 CDDL-1.1 GPL-1.0-only GPL-1.0-or-later GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later "
    "LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only "
    "AGPL-3.0-or-later GFDL-1.2-or-later GFDL-1.3-or-later CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-4.0 "
    "CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 Unlicense WTFPL Zlib BSL-1.0 OFL-1.1 Artistic-2.0 PostgreSQL PSF-2.0 NCSA "
    "UPL-1.0 MS-PL MS-RL OSL-3.0 AFL-3.0 ODbL-1.0 SSPL-1.0 BUSL-1.1 X11 curl Python-2.0 Ruby Vim").split()

SIGNATURES: list[tuple[str, str, str, int, float, str]] = [
    # -- GNU GPL ---------------------------------------------------------------
    ("gpl-3.0", "29 june 2007", "gnu general public license version 3 29 june 2007", TEXT, 1.0, "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"),
    ("gpl-3.0", "copyleft license for software", "the gnu general public license is a free copyleft license for software and other kinds of works", TEXT, 1.0, "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("gpl-3.0", "anti circumvention", "protecting users legal rights from anti circumvention law", TEXT, 0.9, "3. Protecting Users' Legal Rights From Anti-Circumvention Law."),
    ("gpl-2.0", "june 1991", "gnu general public license version 2 june 1991", TEXT, 1.0, "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("gpl-2.0", "take away your freedom", "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license", TEXT, 1.0, "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee"),
    ("gpl-1.0", "february 1989", "gnu general public license version 1 february 1989", TEXT, 1.0, "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("gpl-3.0-or-later", "any later version", f"gnu general public license {_BY} either version 3 of the license {_OPTION}", HEADER, 1.0, "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0-or-later", "any later version", f"gnu general public license {_BY} either version 2 of the license {_OPTION}", HEADER, 1.0, "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-1.0-or-later", "any later version", f"gnu general public license {_BY} either version 1 {_OPTION}", HEADER, 1.0, "the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version."),
    ("gpl-2.0-or-later", "any later version", f"gnu general public license {_BY} either version 2 {_OPTION}", HEADER, 1.0, "GNU General Public License as published by the Free Software Foundation; either version 2, or (at your option) any later version."),
    ("gpl-3.0-or-later", "any later version", f"gnu general public license {_BY} either version 3 {_OPTION}", HEADER, 1.0, "GNU General Public License as published by the Free Software Foundation; either version 3, or (at your option) any later version."),
    ("gpl-2.0", "general public license", f"gnu general public license version 2 {_BY}", HEADER, 1.0, "it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("gpl-3.0", "general public license", f"gnu general public license version 3 {_BY}", HEADER, 1.0, "the GNU General Public License, version 3, as published by the Free Software Foundation"),
    ("gpl-2.0", "general public license", f"gnu general public license {_BY} version 2(?: of the license)?", HEADER, 0.95, "the GNU General Public License as published by the Free Software Foundation, version 2 of the License."),
    ("gpl-3.0", "general public license", f"gnu general public license {_BY} version 3(?: of the license)?", HEADER, 0.95, "the GNU General Public License as published by the Free Software Foundation, version 3."),
    ("gpl", "should have received", "you should have received a copy of the gnu general public license(?: along with this (?:program|software|package|file))?", NOTICE, 0.9, "You should have received a copy of the GNU General Public License along with this program."),
    ("gpl", "in the hope that", "this program is distributed in the hope that it will be useful but without any warranty", NOTICE, 0.7, "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("gpl-3.0-or-later", "general public license", f"(?:gnu )?general public license {_V}3(?: 0)?{_LATER}", NAMED, 0.95, "GNU General Public License v3.0 or later"),
    ("gpl-2.0-or-later", "general public license", f"(?:gnu )?general public license {_V}2(?: 0)?{_LATER}", NAMED, 0.95, "GNU General Public License v2 or later"),
    ("gpl-3.0", "general public license", f"(?:gnu )?general public license {_V}3(?: 0)?(?: only)?", NAMED, 0.9, "the GNU General Public License, version 3"),
    ("gpl-2.0", "general public license", f"(?:gnu )?general public license {_V}2(?: 0)?(?: only)?", NAMED, 0.9, "GNU General Public License v2.0 only"),
    ("gpl-1.0", "general public license", f"(?:gnu )?general public license {_V}1(?: 0)?(?: only)?", NAMED, 0.9, "GNU General Public License version 1"),
    ("gpl", "general public license", "gnu general public licen[sc]e", NAME, 0.8, "a copy of the GNU General Public License"),
    ("gpl", "general public licence", "(?:gnu )?general public licence", NAME, 0.8, "under the General Public Licence"),
    ("gpl-3.0-or-later", "gpl", f"gpl ?{_V}3(?: 0)?{_LATER}", NAMED, 0.9, "GPLv3 or later"),
    ("gpl-2.0-or-later", "gpl", f"gpl ?{_V}2(?: 0)?{_LATER}", NAMED, 0.9, "GPL-2.0-or-later"),
    ("gpl-3.0", "gpl", f"gpl ?{_V}3(?: 0)?(?: only)?", SHORT, 0.85, "GPLv3"),
    ("gpl-2.0", "gpl", f"gpl ?{_V}2(?: 0)?(?: only)?", SHORT, 0.85, "GPL v2"),
    ("gpl", "gpl", f"(?:{_UNDER}|gnu )gpl(?: licen[sc]e)?", SHORT, 0.8, "released under the GPL"),
    ("gpl", "gpl", "gpl licen[sc]ed?", SHORT, 0.75, "a GPL licensed driver"),
    # -- GNU LGPL --------------------------------------------------------------
    ("lgpl-3.0", "29 june 2007", "gnu lesser general public license version 3 29 june 2007", TEXT, 1.0, "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("lgpl-3.0", "lesser general public license incorporates", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3", TEXT, 1.0, "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License"),
    ("lgpl-2.1", "february 1999", "gnu lesser general public license version 2 1 february 1999", TEXT, 1.0, "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("lgpl-2.1", "first released version of the lesser", "this is the first released version of the lesser gpl", TEXT, 1.0, "[This is the first released version of the Lesser GPL. It also counts as the successor"),
    ("lgpl-2.0", "june 1991", "gnu library general public license version 2 june 1991", TEXT, 1.0, "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("lgpl-3.0-or-later", "any later version", f"gnu lesser general public license {_BY} either version 3(?: 0)?(?: of the license)? {_OPTION}", HEADER, 1.0, "GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-2.1-or-later", "any later version", f"gnu lesser general public license {_BY} either version 2 1(?: of the license)? {_OPTION}", HEADER, 1.0, "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-2.0-or-later", "any later version", f"gnu (?:library|lesser) general public license {_BY} either version 2(?: of the license)? {_OPTION}", HEADER, 1.0, "GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl-2.1", "lesser general public license", f"gnu lesser general public license (?:version 2 1 {_BY}|{_BY} version 2 1)", HEADER, 1.0, "the GNU Lesser General Public License version 2.1 as published by the Free Software Foundation"),
    ("lgpl-3.0", "lesser general public license", f"gnu lesser general public license (?:version 3 {_BY}|{_BY} version 3)", HEADER, 1.0, "the GNU Lesser General Public License version 3 as published by the Free Software Foundation"),
    ("lgpl", "should have received", "you should have received a copy of the gnu (?:lesser|library) general public license", NOTICE, 0.9, "You should have received a copy of the GNU Lesser General Public License"),
    ("lgpl", "in the hope that", "this library is distributed in the hope that it will be useful but without any warranty", NOTICE, 0.8, "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("lgpl-3.0-or-later", "lesser general public license", f"(?:gnu )?lesser general public license {_V}3(?: 0)?{_LATER}", NAMED, 0.95, "GNU Lesser General Public License v3 or later"),
    ("lgpl-2.1-or-later", "lesser general public license", f"(?:gnu )?lesser general public license {_V}2 1{_LATER}", NAMED, 0.95, "GNU Lesser General Public License v2.1 or later"),
    ("lgpl-3.0", "lesser general public license", f"(?:gnu )?lesser general public license {_V}3(?: 0)?(?: only)?", NAMED, 0.9, "Lesser General Public License, version 3.0"),
    ("lgpl-2.1", "lesser general public license", f"(?:gnu )?lesser general public license {_V}2 1(?: only)?", NAMED, 0.9, "GNU Lesser General Public License 2.1"),
    ("lgpl-2.0", "library general public license", f"(?:gnu )?library general public license {_V}2(?: 0)?(?: only)?", NAMED, 0.9, "GNU Library General Public License, version 2"),
    ("lgpl", "lesser general public licen", "(?:gnu )?lesser general public licen[sc]e", NAME, 0.8, "a Lesser General Public Licence applies"),
    ("lgpl", "library general public licen", "(?:gnu )?library general public licen[sc]e", NAME, 0.8, "the Library General Public License"),
    ("lgpl-3.0-or-later", "lgpl", f"lgpl ?{_V}3(?: 0)?{_LATER}", NAMED, 0.9, "LGPLv3 or any later version"),
    ("lgpl-2.1-or-later", "lgpl", f"lgpl ?{_V}2 1{_LATER}", NAMED, 0.9, "LGPL-2.1-or-later"),
    ("lgpl-3.0", "lgpl", f"lgpl ?{_V}3(?: 0)?(?: only)?", SHORT, 0.85, "LGPL 3.0"),
    ("lgpl-2.1", "lgpl", f"lgpl ?{_V}2 1(?: only)?", SHORT, 0.85, "LGPLv2.1"),
    ("lgpl-2.0", "lgpl", f"lgpl ?{_V}2(?: 0)?(?: only)?", SHORT, 0.85, "LGPL v2"),
    ("lgpl", "lgpl", f"(?:{_UNDER}|gnu )?lgpl(?: licen[sc]ed?)?", SHORT, 0.75, "the library is LGPL licensed"),
    # -- GNU AGPL and FDL ------------------------------------------------------
    ("agpl-3.0", "19 november 2007", "gnu affero general public license version 3 19 november 2007", TEXT, 1.0, "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("agpl-3.0", "cooperation with the community", "specifically designed to ensure cooperation with the community in the case of network server software", TEXT, 1.0, "specifically designed to ensure cooperation with the community in the case of network server software."),
    ("agpl-3.0-or-later", "any later version", f"gnu affero general public license {_BY} either version 3(?: of the license)? {_OPTION}", HEADER, 1.0, "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-3.0", "affero general public license", f"gnu affero general public license (?:version 3 {_BY}|{_BY} version 3)", HEADER, 1.0, "GNU Affero General Public License, version 3, as published by the Free Software Foundation"),
    ("agpl", "should have received", "you should have received a copy of the gnu affero general public license", NOTICE, 0.9, "You should have received a copy of the GNU Affero General Public License"),
    ("agpl-3.0-or-later", "affero general public license", f"(?:gnu )?affero general public license {_V}3(?: 0)?{_LATER}", NAMED, 0.95, "GNU Affero General Public License v3 or later"),
    ("agpl-3.0", "affero general public license", f"(?:gnu )?affero general public license {_V}3(?: 0)?(?: only)?", NAMED, 0.9, "GNU Affero General Public License 3.0"),
    ("agpl", "affero", "(?:gnu )?affero (?:general public licen[sc]e|gpl)", NAME, 0.8, "the Affero GPL"),
    ("agpl-3.0-or-later", "agpl", f"agpl ?{_V}3(?: 0)?{_LATER}", NAMED, 0.9, "AGPL-3.0-or-later"),
    ("agpl-3.0", "agpl", f"agpl ?{_V}3(?: 0)?(?: only)?", SHORT, 0.85, "AGPLv3"),
    ("agpl", "agpl", f"(?:{_UNDER}|gnu )?agpl(?: licen[sc]ed?)?", SHORT, 0.75, "an AGPL licensed server"),
    ("gfdl-1.3", "3 november 2008", "gnu free documentation license version 1 3 3 november 2008", TEXT, 1.0, "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("gfdl", "invariant sections", "with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts", TEXT, 0.95, "with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts."),
    ("gfdl-1.2-or-later", "documentation license", f"gnu free documentation license version 1 2 or any later version", HEADER, 1.0, "under the terms of the GNU Free Documentation License, Version 1.2 or any later version"),
    ("gfdl-1.3-or-later", "documentation license", f"gnu free documentation license version 1 3 or any later version", HEADER, 1.0, "under the terms of the GNU Free Documentation License, Version 1.3 or any later version"),
    ("gfdl", "documentation licen", "(?:gnu )?free documentation licen[sc]e", NAME, 0.8, "the GNU Free Documentation License"),
    ("gfdl", "gfdl", f"(?:{_UNDER}|gnu )?gfdl", SHORT, 0.75, "text under GFDL"),
    # -- MIT, ISC, BSD and their kin -------------------------------------------
    ("mit", "free of charge to any person", "permission is hereby granted free of charge to any person obtaining a copy of this software", TEXT, 1.0, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit", "substantial portions of the software", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", TEXT, 0.95, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "the mit license", "the mit license mit", HEADER, 1.0, "The MIT License (MIT)"),
    ("mit", "mit", f"{_UNDER}(?:mit|expat)(?: x11| expat)?(?: licen[sc]e)?", NAMED, 0.95, "Released under the MIT"),
    ("mit", "mit licen", "(?:the )?mit(?: x11| expat| style)? licen[sc]ed?", NAME, 0.85, "an MIT license"),
    ("mit", "licen", "(?:licen[sc]e|licen[sc]ing) (?:is )?mit", SHORT, 0.7, "License: MIT"),
    ("mit", "expat", "expat licen[sc]e", NAME, 0.85, "the Expat license"),
    ("mit-0", "mit no attribution", "mit no attribution", NAME, 0.9, "MIT No Attribution"),
    ("x11", "x consortium", "the name of the x consortium shall not be used in advertising", TEXT, 0.95, "the name of the X Consortium shall not be used in advertising"),
    ("x11", "x11 licen", "x11 licen[sc]e", NAME, 0.8, "the X11 license"),
    ("isc", "with or without fee", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", TEXT, 1.0, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "zero clause", "zero clause bsd(?: licen[sc]e)?", NAME, 0.9, "Zero-Clause BSD"),
    ("0bsd", "0bsd", "0bsd", SHORT, 0.85, "0BSD"),
    ("isc", "isc licen", "(?:the )?isc licen[sc]ed?", NAME, 0.85, "the ISC License"),
    ("isc", "isc", f"{_UNDER}isc(?: licen[sc]e)?", NAMED, 0.9, "Licensed under the ISC"),
    ("bsd", "source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", TEXT, 1.0, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-3-clause", "endorse or promote", "neither the names? of .{1,80}? nor the names of (?:its|their|other) contributors may be used to endorse or promote products", TEXT, 1.0, "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display", TEXT, 1.0, "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[sc]ed?)?", NAMED, 0.9, "the Simplified BSD License"),
    ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[sc]ed?)?", NAMED, 0.9, "BSD-3-Clause"),
    ("bsd-4-clause", "bsd", "(?:original bsd|old bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[sc]ed?)?", NAMED, 0.9, "the original BSD license"),
    ("bsd", "bsd", f"{_UNDER}bsd(?: style)?(?: licen[sc]e)?", NAME, 0.85, "distributed under a BSD-style license"),
    ("bsd", "bsd", "bsd(?: style)? licen[sc]ed?", NAME, 0.8, "BSD licensed"),
    ("ncsa", "illinois", "university of illinois(?: ncsa)? open source licen[sc]e", NAME, 0.95, "University of Illinois/NCSA Open Source License"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", TEXT, 1.0, "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such", TEXT, 0.95, "Altered source versions must be plainly marked as such"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[sc]e", NAME, 0.85, "the zlib/libpng license"),
    ("bsl-1.0", "boost software license", f"boost software license {_V}1(?: 0)?(?: august 17th 2003)?", NAMED, 0.95, "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("bsl", "boost software", "boost software licen[sc]e", NAME, 0.85, "the Boost Software License"),
    ("bsl-1.0", "organization obtaining a copy", "free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", TEXT, 1.0, "free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("postgresql", "postgresql", "(?:the )?postgresql licen[sc]e", NAME, 0.9, "The PostgreSQL License"),
    ("postgresql", "without a written agreement", "without fee and without a written agreement is hereby granted", TEXT, 0.9, "for any purpose, without fee, and without a written agreement is hereby granted"),
    ("curl", "curl", "curl licen[sc]e", NAME, 0.8, "the curl license"),
    ("psf-2.0", "python software foundation", f"python software foundation licen[sc]e {_V}2(?: 0)?", NAMED, 0.95, "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2"),
    ("psf", "python software foundation", "python software foundation licen[sc]e", NAME, 0.85, "the Python Software Foundation License"),
    ("upl-1.0", "universal permissive", f"universal permissive licen[sc]e(?: upl)?(?: {_V}1(?: 0)?)?", NAME, 0.95, "The Universal Permissive License (UPL), Version 1.0"),
    ("openssl", "openssl", "openssl licen[sc]e", NAME, 0.85, "the OpenSSL License"),
    ("openssl", "openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit", TEXT, 1.0, "This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit"),
    ("php-3.01", "php license", f"php license {_V}3 01", NAMED, 0.95, "The PHP License, version 3.01"),
    ("php", "php licen", "php licen[sc]e", NAME, 0.85, "the PHP License"),
    ("ruby", "ruby licen", "ruby licen[sc]e", NAME, 0.8, "the Ruby license"),
    ("vim", "vim licen", "vim licen[sc]e", NAME, 0.8, "the Vim license"),
    ("json", "good not evil", "the software shall be used for good not evil", TEXT, 1.0, "The Software shall be used for Good, not Evil."),
    ("beerware", "beer", "beer ?ware licen[sc]e", NAME, 0.9, "THE BEER-WARE LICENSE"),
    # -- Apache ----------------------------------------------------------------
    ("apache-2.0", "january 2004", "apache license version 2 0 january 2004", TEXT, 1.0, "Apache License Version 2.0, January 2004"),
    ("apache-2.0", "except in compliance with the license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", HEADER, 1.0, 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("apache-2.0", "asf under one or more", "licensed to the apache software foundation asf under one or more contributor license agreements", HEADER, 1.0, "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements."),
    ("apache-2.0", "licenses license 2 0", "(?:www )?apache org licenses license 2 0", NOTICE, 0.95, "http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "as is basis", "distributed on an as is basis without warranties or conditions of any kind", NOTICE, 0.8, 'is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND'),
    ("apache-2.0", "apache", f"apache(?: software)?(?: public)? licen[sc]e {_V}2(?: 0)?", NAMED, 0.95, "the Apache License, Version 2.0"),
    ("apache-1.1", "apache", f"apache(?: software)? licen[sc]e {_V}1 1", NAMED, 0.95, "The Apache Software License, Version 1.1"),
    ("apache-1.0", "apache", f"apache(?: software)? licen[sc]e {_V}1(?: 0)?", NAMED, 0.95, "Apache Software License 1.0"),
    ("apache-2.0", "apache", f"apache ?{_V}2(?: 0)?(?: licen[sc]ed?)?", SHORT, 0.85, "Apache-2.0"),
    ("apache-2.0", "asl", "asl ?(?:v ?)?2 0", SHORT, 0.75, "ASL 2.0"),
    ("apache", "apache", "apache(?: software)? licen[sc]ed?", NAME, 0.8, "an Apache license"),
    # -- Mozilla, Eclipse, Sun, European Union and other weak copyleft ---------
    ("mpl-2.0", "source code form is subject", "this source code form is subject to the terms of the mozilla public license v ?2 0", HEADER, 1.0, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "incompatible with secondary licenses", "this source code form is incompatible with secondary licenses", TEXT, 0.95, 'This Source Code Form is "Incompatible With Secondary Licenses"'),
    ("mpl-1.1", "subject to the mozilla public license", "the contents of this file are subject to the mozilla public license version 1 1", HEADER, 1.0, "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("mpl-2.0", "mozilla public licen", f"mozilla public licen[sc]e {_V}2(?: 0)?", NAMED, 0.95, "Mozilla Public License 2.0"),
    ("mpl-1.1", "mozilla public licen", f"mozilla public licen[sc]e {_V}1 1", NAMED, 0.95, "Mozilla Public License Version 1.1"),
    ("mpl-1.0", "mozilla public licen", f"mozilla public licen[sc]e {_V}1 0", NAMED, 0.95, "Mozilla Public License Version 1.0"),
    ("mpl", "mozilla public licen", "mozilla public licen[sc]e", NAME, 0.85, "the Mozilla Public License"),
    ("mpl-2.0", "mpl", f"mpl ?{_V}2(?: 0)?", SHORT, 0.85, "MPL-2.0"),
    ("mpl-1.1", "mpl", f"mpl ?{_V}1 1", SHORT, 0.85, "MPL 1.1"),
    ("epl-2.0", "epl 2 0", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?)?2 0", HEADER, 1.0, "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("epl-1.0", "eclipse public license v", "this program and the accompanying materials are made available under the terms of the eclipse public license v ?1 0", HEADER, 1.0, "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"),
    ("epl-2.0", "eclipse public licen", f"eclipse public licen[sc]e {_V}2(?: 0)?", NAMED, 0.95, "Eclipse Public License - v 2.0"),
    ("epl-1.0", "eclipse public licen", f"eclipse public licen[sc]e {_V}1(?: 0)?", NAMED, 0.95, "Eclipse Public License - v 1.0"),
    ("epl", "eclipse public licen", "eclipse public licen[sc]e", NAME, 0.85, "the Eclipse Public License"),
    ("epl-2.0", "epl", f"epl ?{_V}2 0", SHORT, 0.85, "EPL-2.0"),
    ("epl-1.0", "epl", f"epl ?{_V}1 0", SHORT, 0.85, "EPL-1.0"),
    ("cpl-1.0", "common public licen", f"common public licen[sc]e(?: {_V}1(?: 0)?)?", NAMED, 0.9, "Common Public License Version 1.0"),
    ("cddl-1.0", "common development and distribution", f"common development and distribution licen[sc]e(?: cddl)? {_V}1 0", NAMED, 0.95, "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0"),
    ("cddl-1.1", "common development and distribution", f"common development and distribution licen[sc]e(?: cddl)? {_V}1 1", NAMED, 0.95, "Common Development and Distribution License (CDDL) Version 1.1"),
    ("cddl", "common development and distribution", "common development and distribution licen[sc]e", NAME, 0.85, "the Common Development and Distribution License"),
    ("cddl", "cddl", "cddl(?: ?1 [01])?", SHORT, 0.75, "CDDL"),
    ("eupl-1.2", "eupl", f"eupl ?{_V}1 2", SHORT, 0.85, "EUPL-1.2"),
    ("eupl-1.1", "eupl", f"eupl ?{_V}1 1", SHORT, 0.85, "EUPL v1.1"),
    ("eupl", "european union public licen", f"european union public licen[sc]e(?: {_V}1 [012])?", NAME, 0.9, "European Union Public Licence v1.2"),
    ("artistic-2.0", "artistic", f"artistic licen[sc]e {_V}2(?: 0)?", NAMED, 0.95, "The Artistic License 2.0"),
    ("artistic-1.0", "artistic", f"artistic licen[sc]e {_V}1(?: 0)?", NAMED, 0.9, "Artistic License 1.0"),
    ("artistic", "artistic licen", "artistic licen[sc]e", NAME, 0.8, "the Artistic License"),
    ("perl", "same terms as perl", "under the same terms as perl(?: itself)?", NOTICE, 0.9, "modify it under the same terms as Perl itself"),
    ("osl-3.0", "open software licen", f"open software licen[sc]e {_V}3(?: 0)?", NAMED, 0.95, "Licensed under the Open Software License version 3.0"),
    ("afl-3.0", "academic free licen", f"academic free licen[sc]e {_V}3(?: 0)?", NAMED, 0.95, "Academic Free License version 3.0"),
    ("afl-2.1", "academic free licen", f"academic free licen[sc]e {_V}2 1", NAMED, 0.95, "Academic Free License version 2.1"),
    ("ms-pl", "microsoft public licen", "microsoft public licen[sc]e(?: ms pl)?", NAME, 0.9, "Microsoft Public License (Ms-PL)"),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal licen[sc]e(?: ms rl)?", NAME, 0.9, "Microsoft Reciprocal License (Ms-RL)"),
    ("ipl-1.0", "ibm public licen", f"ibm public licen[sc]e(?: {_V}1(?: 0)?)?", NAME, 0.9, "IBM Public License Version 1.0"),
    ("cecill", "cecill", f"cecill(?: [bc])?(?: licen[sc]e)?(?: {_V}[12](?: [01])?)?", SHORT, 0.85, "the CeCILL license"),
    # -- Creative Commons and open data ----------------------------------------
    ("cc-by-nc-nd", "creative commons", _CC + "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported| generic)?", NAMED, 0.95, "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International"),
    ("cc-by-nc-sa", "creative commons", _CC + "attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?", NAMED, 0.95, "Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported"),
    ("cc-by-nc", "creative commons", _CC + "attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?", NAMED, 0.95, "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("cc-by-nd", "creative commons", _CC + "attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported| generic)?", NAMED, 0.95, "Creative Commons Attribution-NoDerivs 3.0"),
    ("cc-by-sa", "creative commons", _CC + "attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?", NAMED, 0.95, "Creative Commons Attribution-ShareAlike License"),
    ("cc-by", "creative commons", _CC + "attribution(?: [1-4] [05])?(?: international| unported| generic)?", NAMED, 0.95, "Creative Commons Attribution 4.0 International"),
    ("cc-by-nc-nd", "by nc nd", "(?:cc )?by nc nd(?: [1-4] [05])?", SHORT, 0.85, "CC BY-NC-ND 4.0"),
    ("cc-by-nc-sa", "by nc sa", "(?:cc )?by nc sa(?: [1-4] [05])?", SHORT, 0.85, "CC BY-NC-SA 3.0"),
    ("cc-by-nc", "cc by nc", "cc by nc(?: [1-4] [05])?", SHORT, 0.85, "CC BY-NC 4.0"),
    ("cc-by-nd", "cc by nd", "cc by nd(?: [1-4] [05])?", SHORT, 0.85, "CC-BY-ND"),
    ("cc-by-sa", "cc by sa", "cc by sa(?: [1-4] [05])?", SHORT, 0.85, "CC BY-SA 4.0"),
    ("cc-by", "cc by", "cc by(?: [1-4] [05])?", WEAK, 0.7, "CC BY 4.0"),
    ("cc-by-sa", "licenses by sa", "creativecommons org licenses by sa [1-4] [05]", NOTICE, 0.95, "https://creativecommons.org/licenses/by-sa/4.0/"),
    ("cc-by-nc", "licenses by nc", "creativecommons org licenses by nc [1-4] [05]", NOTICE, 0.95, "https://creativecommons.org/licenses/by-nc/4.0/"),
    ("cc-by-nc-sa", "licenses by nc sa", "creativecommons org licenses by nc sa [1-4] [05]", NOTICE, 0.95, "https://creativecommons.org/licenses/by-nc-sa/4.0/"),
    ("cc-by-nc-nd", "licenses by nc nd", "creativecommons org licenses by nc nd [1-4] [05]", NOTICE, 0.95, "https://creativecommons.org/licenses/by-nc-nd/4.0/"),
    ("cc-by-nd", "licenses by nd", "creativecommons org licenses by nd [1-4] [05]", NOTICE, 0.95, "https://creativecommons.org/licenses/by-nd/4.0/"),
    ("cc-by", "licenses by", "creativecommons org licenses by [1-4] [05]", NOTICE, 0.95, "https://creativecommons.org/licenses/by/4.0/"),
    ("cc0-1.0", "publicdomain zero", "creativecommons org publicdomain zero 1 0", NOTICE, 0.95, "https://creativecommons.org/publicdomain/zero/1.0/"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", SHORT, 0.85, "CC0 1.0 Universal"),
    ("cc-by", "remix transform", "remix transform and build upon the material for any purpose even commercially", TEXT, 0.9, "remix, transform, and build upon the material for any purpose, even commercially."),
    ("cc", "creative commons licen", _CC + "licen[sc]e", WEAK, 0.6, "under a Creative Commons license"),
    ("odbl-1.0", "open database licen", f"open (?:data commons open )?database licen[sc]e(?: odbl)?(?: {_V}1(?: 0)?)?", NAME, 0.9, "Open Database License (ODbL) v1.0"),
    ("odc-by", "open data commons attribution", "open data commons attribution licen[sc]e", NAME, 0.9, "Open Data Commons Attribution License"),
    ("pddl-1.0", "public domain dedication and licen", "public domain dedication and licen[sc]e(?: pddl)?", NAME, 0.9, "Public Domain Dedication and License (PDDL)"),
    ("ogl", "open government licen", f"open government licen[sc]e(?: {_V}[123](?: 0)?)?", NAME, 0.9, "Open Government Licence v3.0"),
    ("ofl-1.1", "sil open font", f"sil open font licen[sc]e {_V}1 1", NAMED, 0.95, "SIL Open Font License, Version 1.1"),
    ("ofl", "open font licen", "(?:sil )?open font licen[sc]e", NAME, 0.85, "the SIL Open Font License"),
    ("cdla-permissive", "community data license", "community data license agreement permissive(?: [12] 0)?", NAME, 0.9, "Community Data License Agreement - Permissive 2.0"),
    # -- public domain ---------------------------------------------------------
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", TEXT, 1.0, "This is free and unencumbered software released into the public domain."),
    ("unlicense", "unlicense", "(?:the )?unlicense", SHORT, 0.85, "the Unlicense"),
    ("wtfpl", "do what the fuck you want", "do what the fuck you want to public licen[sc]e", TEXT, 1.0, "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    ("wtfpl", "wtfpl", "wtfpl", SHORT, 0.85, "WTFPL"),
    ("public-domain", "public domain", "(?:released|placed|dedicated|put|donated)(?: in| into| to) the public domain", NAME, 0.8, "placed in the public domain"),
    ("public-domain", "public domain", "(?:in|into|to|dedicated to) the public domain", WEAK, 0.7, "works in the public domain"),
    ("public-domain", "disclaims copyright", "the author disclaims copyright to this source code", TEXT, 0.95, "The author disclaims copyright to this source code."),
    # -- source available and model licences -----------------------------------
    ("sspl-1.0", "server side public licen", f"server side public licen[sc]e(?: {_V}1(?: 0)?)?", NAME, 0.95, "Server Side Public License, v 1"),
    ("sspl-1.0", "sspl", "sspl(?: ?v ?1)?", SHORT, 0.8, "SSPLv1"),
    ("busl-1.1", "business source licen", f"business source licen[sc]e(?: {_V}1 1)?", NAME, 0.95, "Business Source License 1.1"),
    ("elastic-2.0", "elastic licen", f"elastic licen[sc]e {_V}2(?: 0)?", NAMED, 0.95, "Elastic License 2.0"),
    ("commons-clause", "commons clause", "commons clause(?: licen[sc]e)? condition", NAME, 0.9, '"Commons Clause" License Condition v1.0'),
    ("polyform-noncommercial", "polyform", "polyform non ?commercial licen[sc]e", NAME, 0.95, "PolyForm Noncommercial License 1.0.0"),
    ("openrail", "openrail", "(?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: licen[sc]e)?", NAME, 0.85, "CreativeML OpenRAIL-M"),
    ("openrail", "responsible ai licen", "responsible ai licen[sc]e", NAME, 0.85, "a Responsible AI License"),
    # -- reserved and proprietary ----------------------------------------------
    ("reserved", "rights", "all rights (?:are )?reserved", WEAK, 0.6, "All rights are reserved"),
    ("reserved", "no part of", "no part of this (?:publication|book|work|document|site|website) may be (?:reproduced|copied|stored|used)", NAME, 0.85, "No part of this publication may be reproduced"),
    ("reserved", "reproduction", "reproduction .{0,60}? (?:prohibited|without (?:the )?(?:prior )?(?:written )?permission)", WEAK, 0.6, "Reproduction in whole or in part is prohibited"),
    ("reserved", "redistribution", "redistribution .{0,60}? (?:prohibited|without (?:the )?(?:prior )?(?:written )?permission)", WEAK, 0.6, "Redistribution of this page without written permission"),
    ("reserved", "prior written permission", "without (?:the )?(?:express )?prior written (?:permission|consent) of the (?:publisher|author|copyright (?:holder|owner))", WEAK, 0.7, "without the prior written permission of the publisher"),
    ("proprietary", "proprietary", "proprietary and confidential", NAME, 0.85, "Proprietary and confidential."),
    ("proprietary", "proprietary", "proprietary (?:software|licen[sc]e)", WEAK, 0.6, "This is proprietary software."),
    ("proprietary", "unauthorized copying", "unauthorized copying of this (?:file|software|document)", NAME, 0.85, "Unauthorized copying of this file, via any medium, is strictly prohibited"),
    ("proprietary", "trade secret", "(?:contains|are|is) (?:the |a )?(?:confidential information and )?trade secrets? of", WEAK, 0.7, "which is a trade secret of the company"),
    ("eula", "end user licen", "end user licen[sc]e agreement", NAME, 0.8, "End-User License Agreement"),
    ("noncommercial", "non commercial", "(?:for|only) non commercial (?:use|purposes)(?: only)?", WEAK, 0.6, "for non-commercial use only"),
    ("noncommercial", "personal", "for personal(?: and)?(?: non ?commercial)? use only", WEAK, 0.6, "for personal, noncommercial use only"),
    ("copyright", "copyright", "copyright (?:c |© ?)?(?:19|20)[0-9]{2}", WEAK - 10, 0.5, "Copyright (c) 2019"),
    ("gpl", "general public license", "general public license", WEAK - 20, 0.5, "General Public License"),
]


def spdx_rules() -> list[tuple[str, str, str, int, float, str]]:
    """A signature for each identifier: ``-only`` is the licence itself."""
    out = []
    for name in SPDX_IDS:
        words = name.lower().replace("-", " ").replace(".", " ")
        pattern = words.removesuffix(" only") + ("(?: only)?" if words.endswith(" only") else "")
        pattern = pattern.replace(" 0 or later", " 0(?: or later| ?plus)")
        label = name.lower().removesuffix("-only")
        if label.startswith("cc-by"):
            label = label.rsplit("-", 1)[0]
        out.append((label, "spdx license", f"spdx licen[sc]e identifier {pattern}", SPDX, 1.0, f"SPDX-License-Identifier: {name}"))
    return out
