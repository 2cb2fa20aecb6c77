"""The signatures of the license scan: ordered rules over normalised words.

Texts are lower-case words joined by single spaces, so "Apache License, Version 2.0" reads "apache license
version 2 0". A rule has a label, a priority (higher wins), a confidence and an expression. Signatures are
written by hand for the notices, grants, conditions, disclaimers and headers that licenses ask for; names
with versions, identifiers and family mentions follow from tables of families.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

#: Priorities: a family's name alone; a sentence of a license or its notice; a name with its version; a tag
#: or address that exists to name one license.
MENTION, SENTENCE, VERSIONED, TAG = 1, 2, 3, 4

Y = "(?:19|20)[0-9]{2}"
L = "licen[cs]e"
SPDX = f"spdx {L} identifier"
AS_IS = "(?:provided )?(?:by the (?:copyright holders?(?: and contributors)?|authors?|regents(?: and contributors)?) )?as is"

# label, priority, confidence, expression; in order.
SIGNATURES = [
    # copyright lines and reservations
    ("copyright", SENTENCE, 0.6, f"copyright (?:c )?(?:by )?{Y}(?: {Y})*"),
    ("copyright", SENTENCE, 0.6, f"c copyright {Y}(?: {Y})*"),
    ("copyright", SENTENCE, 0.6, f"copr {Y}"),
    ("copyright", SENTENCE, 0.6, f"portions (?:are )?copyright (?:c )?{Y}(?: {Y})*"),
    ("copyright", SENTENCE, 0.5, "this (?:work|document|file|program|software) is (?:copyright|copyrighted) (?:by|of)"),
    ("copyright", SENTENCE, 0.5, "protected by copyright laws?"),
    ("copyright", SENTENCE, 0.5, "unpublished rights reserved under the copyright laws"),
    ("reserved", SENTENCE, 0.5, "some rights reserved"),
    ("reserved", SENTENCE, 0.5, "no part of this (?:book|publication|work|document) may be reproduced"),
    ("reserved", SENTENCE, 0.5, "all other rights are reserved"),
    # proprietary notices
    ("proprietary", SENTENCE, 0.8, "proprietary and confidential"),
    ("proprietary", SENTENCE, 0.8, "confidential and proprietary"),
    ("proprietary", SENTENCE, 0.8, "unauthorized (?:copying|reproduction|distribution)(?: or \\w+)? (?:of this \\w+ )?(?:via any medium )?is (?:strictly )?prohibited"),
    ("proprietary", SENTENCE, 0.8, "contains (?:the )?trade secrets and (?:is )?(?:proprietary|confidential)"),
    ("proprietary", SENTENCE, 0.8, "may not be (?:copied|reproduced|disclosed)(?: or \\w+)? without (?:the )?(?:prior |express )?written (?:permission|consent)"),
    ("proprietary", SENTENCE, 0.7, "end user licen[cs]e agreement"),
    ("proprietary", SENTENCE, 0.7, "for internal use only"),
    ("proprietary", SENTENCE, 0.7, "restricted rights legend"),
    ("proprietary", SENTENCE, 0.7, "subject to the restrictions (?:as )?set forth in"),
    ("proprietary", SENTENCE, 0.7, "you may not reverse engineer decompile or disassemble"),
    ("proprietary", SENTENCE, 0.7, "licensed not sold"),
    ("evaluation", SENTENCE, 0.6, "for evaluation purposes only"),
    ("non-commercial", SENTENCE, 0.6, "for non ?commercial (?:use|purposes) only"),
    ("non-commercial", SENTENCE, 0.6, "not (?:be )?(?:used )?for commercial (?:use|purposes)"),
    ("non-commercial", SENTENCE, 0.6, "free for personal and educational use"),
    ("freeware", SENTENCE, 0.6, "this (?:software|program) is freeware"),
    ("shareware", SENTENCE, 0.6, "this (?:software|program) is shareware"),
    # public domain and its relatives
    ("public-domain", SENTENCE, 0.8, "(?:released|dedicated|placed|is|put|donated) (?:in|into|to) the public domain"),
    ("public-domain", SENTENCE, 0.8, "this (?:file|work|program|code|software) is (?:hereby )?(?:in )?(?:the )?public domain"),
    ("public-domain", SENTENCE, 0.8, "the authors? disclaims? copyright to this source code"),
    ("public-domain", SENTENCE, 0.8, "a blessing may you do good and not evil"),
    ("public-domain", SENTENCE, 0.7, "not subject to copyright protection"),
    ("public-domain", SENTENCE, 0.7, "work of the (?:u s|united states) government"),
    ("cc0-1.0", VERSIONED, 0.9, "(?:cc0|creative commons zero)(?: v?1 0)?(?: universal)?"),
    ("cc0-1.0", SENTENCE, 0.9, "to the extent possible under law"),
    ("cc0-1.0", SENTENCE, 0.9, "waived all copyright and related or neighboring rights"),
    ("cc0-1.0", TAG, 1.0, "creativecommons org publicdomain zero 1 0"),
    ("pdm-1.0", TAG, 1.0, "creativecommons org publicdomain mark 1 0"),
    ("unlicense", SENTENCE, 0.95, "this is free and unencumbered software released into the public domain"),
    ("unlicense", SENTENCE, 0.9, "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", TAG, 1.0, "unlicense org"),
    ("wtfpl", SENTENCE, 0.95, "you just do what the fuck you want to"),
    ("wtfpl", SENTENCE, 0.95, "everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document"),
    ("wtfpl", TAG, 1.0, "wtfpl net"),
    ("beerware", SENTENCE, 0.9, "the beer ware licen[cs]e"),
    ("beerware", SENTENCE, 0.9, "you can buy me a beer in return"),
    ("0bsd", SENTENCE, 0.9, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("0bsd", VERSIONED, 0.9, "(?:zero clause|0 clause|free public) bsd"),
    # permissive grants, conditions and disclaimers
    ("mit", SENTENCE, 0.95, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", SENTENCE, 0.9, "to deal in the software without restriction"),
    ("mit", SENTENCE, 0.9, "rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", SENTENCE, 0.8, "this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", SENTENCE, 0.8, "in no event shall the authors or copyright holders be liable"),
    ("mit", SENTENCE, 0.8, "provided as is without warranty of any kind express or implied including but not limited to"),
    ("mit", SENTENCE, 0.8, "fitness for a particular purpose and non ?infringement"),
    ("mit", TAG, 1.0, "opensource org licenses mit(?: license)?(?: php)?"),
    ("mit", TAG, 1.0, "mit license org"),
    ("mit-0", VERSIONED, 0.95, "mit no attribution"),
    ("x11", VERSIONED, 0.9, f"x11 {L}"),
    ("x11", SENTENCE, 0.9, "the name of the x consortium shall not be used in advertising"),
    ("hpnd", SENTENCE, 0.9, "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("hpnd", SENTENCE, 0.8, "makes no representations about the suitability of this software for any purpose"),
    ("hpnd", SENTENCE, 0.8, "not be used in advertising or publicity pertaining to distribution of the software"),
    ("isc", SENTENCE, 0.9, "permission to use copy modify and or distribute this software for any purpose"),
    ("isc", SENTENCE, 0.9, "permission to use copy modify and distribute this software for any purpose with or without fee"),
    ("isc", SENTENCE, 0.8, "the author disclaims all warranties with regard to this software"),
    ("isc", SENTENCE, 0.8, "loss of use data or profits whether in an action of contract negligence or other tortious action"),
    ("isc", TAG, 1.0, "opensource org licenses isc"),
    ("bsd", SENTENCE, 0.9, "redistribution and use in source and binary forms with or without modification"),
    ("bsd", SENTENCE, 0.85, "redistributions of source code must retain the above copyright notice"),
    ("bsd", SENTENCE, 0.85, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", SENTENCE, 0.8, f"this software is {AS_IS} and any express or implied warranties"),
    ("bsd", SENTENCE, 0.8, "direct indirect incidental special exemplary or consequential damages"),
    ("bsd", SENTENCE, 0.7, "use of this source code is governed by a bsd style licen[cs]e"),
    ("bsd-3-clause", SENTENCE, 0.9, "neither the names? of .{1,80}? (?:nor|or) the names of (?:its|any) contributors may be used to endorse"),
    ("bsd-3-clause", SENTENCE, 0.9, "the names? of the (?:authors?|copyright holders?) may not be used to endorse or promote products"),
    ("bsd-3-clause", TAG, 1.0, "opensource org licenses bsd 3 clause"),
    ("bsd-3-clause", TAG, 1.0, "opensource org licenses bsd license(?: php)?"),
    ("bsd-2-clause", SENTENCE, 0.85, "the views and conclusions contained in the software and documentation"),
    ("bsd-2-clause", TAG, 1.0, "opensource org licenses bsd 2 clause"),
    ("bsd-4-clause", SENTENCE, 0.9, "all advertising materials mentioning features or use of this software must display"),
    ("bsd-4-clause", SENTENCE, 0.9, "this product includes software developed by"),
    ("zlib", SENTENCE, 0.8, "this software is provided as is without any express or implied warranty"),
    ("zlib", SENTENCE, 0.85, "the origin of this software must not be misrepresented"),
    ("zlib", SENTENCE, 0.85, "altered source versions must be plainly marked as such"),
    ("zlib", SENTENCE, 0.85, "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("zlib", SENTENCE, 0.85, "this notice may not be removed or altered from any source distribution"),
    ("libpng", SENTENCE, 0.85, "the contributing authors and group 42 inc disclaim all warranties"),
    ("libpng", VERSIONED, 0.9, f"png reference library {L}(?: version 2)?"),
    ("curl", SENTENCE, 0.85, "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("postgresql", SENTENCE, 0.85, "in no event shall the university of california be liable to any party for direct"),
    ("ncsa", SENTENCE, 0.85, "to deal with the software without restriction"),
    ("ncsa", TAG, 1.0, "opensource org licenses ncsa"),
    ("bsl-1.0", SENTENCE, 0.9, "obtaining a copy of the software and accompanying documentation covered by this licen[cs]e"),
    ("bsl-1.0", TAG, 1.0, "boost org license 1 0(?: txt)?"),
    ("bsl-1.0", SENTENCE, 0.85, "machine executable object code generated by a source language processor"),
    ("openssl", SENTENCE, 0.9, "this product includes software developed by the openssl project"),
    ("ssleay", SENTENCE, 0.9, "this product includes cryptographic software written by eric young"),
    ("apache-1.1", SENTENCE, 0.9, "this product includes software developed by the apache software foundation"),
    ("apache-2.0", TAG, 1.0, "apache org licenses license 2 0(?: txt| html)?"),
    ("apache-2.0", TAG, 1.0, "opensource org licenses apache 2 0"),
    ("apache-1.1", TAG, 1.0, "apache org licenses license 1 1(?: txt)?"),
    ("apache", SENTENCE, 0.85, "you may not use this file except in compliance with the licen[cs]e"),
    ("apache", SENTENCE, 0.85, "licensed to the apache software foundation asf under one or more contributor licen[cs]e agreements"),
    ("apache", SENTENCE, 0.85, "unless required by applicable law or agreed to in writing software"),
    ("apache", SENTENCE, 0.8, "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("apache", SENTENCE, 0.8, "see the licen[cs]e for the specific language governing permissions and limitations under the licen[cs]e"),
    ("upl-1.0", SENTENCE, 0.9, "subject to the condition set forth below permission is hereby granted to any person obtaining a copy"),
    ("json", SENTENCE, 0.95, "the software shall be used for good not evil"),
    ("python-2.0", VERSIONED, 0.9, f"python software foundation {L} (?:version )?2"),
    ("psf", SENTENCE, 0.85, "psf hereby grants licensee a non ?exclusive royalty free world wide licen[cs]e"),
    ("unicode", SENTENCE, 0.9, "associated documentation the data files or unicode software"),
    ("unicode", VERSIONED, 0.9, f"unicode {L}(?: agreement)?(?: v3)?"),
    ("w3c", SENTENCE, 0.9, "by obtaining using and or copying this work you the licensee agree"),
    ("w3c", TAG, 1.0, "w3 org consortium legal"),
    ("ijg", SENTENCE, 0.9, "this software is based in part on the work of the independent jpeg group"),
    ("freetype", VERSIONED, 0.9, f"(?:the )?freetype (?:project )?{L}"),
    ("freetype", SENTENCE, 0.85, "portions of this software are copyright .{1,60}? the freetype project"),
    ("imagemagick", VERSIONED, 0.9, f"imagemagick {L}"),
    ("icu", VERSIONED, 0.85, f"icu {L}"),
    ("blueoak-1.0.0", VERSIONED, 0.95, f"blue oak model {L}(?: 1 0 0)?"),
    ("mulanpsl-2.0", VERSIONED, 0.95, f"mulan (?:permissive software|psl) {L}(?: v2| version 2)?"),
    ("mulanpsl-2.0", TAG, 1.0, "license coscl org cn mulanpsl2"),
    ("afl-3.0", SENTENCE, 0.9, "licensed under the academic free licen[cs]e version 3 0"),
    ("fair", SENTENCE, 0.9, "usage of the works is permitted provided that this instrument is retained with the works"),
    ("fsfap", SENTENCE, 0.9, "copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    ("fsful", SENTENCE, 0.9, "gives unlimited permission to copy and or distribute it with or without modifications"),
    ("naist-2003", VERSIONED, 0.9, f"naist 2003 {L}"),
    ("tcl", SENTENCE, 0.85, "the authors hereby grant permission to use copy modify distribute and licen[cs]e this software"),
    ("sleepycat", SENTENCE, 0.9, "redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("vim", SENTENCE, 0.85, "there are no restrictions on distributing unmodified copies of vim"),
    ("xfree86", SENTENCE, 0.85, "this product includes software developed by the xfree86 project"),
    # copyleft notices and terms
    ("gpl", SENTENCE, 0.9, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl", SENTENCE, 0.85, "as published by the free software foundation"),
    ("gpl", SENTENCE, 0.85, "along with this (?:program|library|software|file) if not (?:see|write to)"),
    ("gpl", SENTENCE, 0.85, "59 temple place suite 330"),
    ("gpl", SENTENCE, 0.85, "51 franklin street fifth floor"),
    ("gpl", SENTENCE, 0.85, "675 mass ave cambridge"),
    ("gpl", SENTENCE, 0.8, "either version [123](?: [01])? of the licen[cs]e or (?:at your option )?any later version"),
    ("gpl", SENTENCE, 0.8, "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu"),
    ("gpl", SENTENCE, 0.8, "everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document"),
    ("gpl", SENTENCE, 0.8, "gnu org licenses gpl"),
    ("gpl", SENTENCE, 0.8, "you must cause any work that you distribute or publish that in whole or in part contains"),
    ("gpl", SENTENCE, 0.8, "this program comes with absolutely no warranty"),
    ("gpl-2.0", TAG, 1.0, "gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?"),
    ("gpl-3.0", TAG, 1.0, "gnu org licenses gpl 3 0(?: html| txt)?"),
    ("gpl-2.0", VERSIONED, 0.95, "(?:gpl v2|gplv2)(?: only| or later)?"),
    ("gpl-3.0", VERSIONED, 0.95, "(?:gpl v3|gplv3)(?: only| or later)?"),
    ("gpl-2.0", VERSIONED, 0.9, "gnu gpl version 2(?: only| or later)?"),
    ("gpl-3.0", VERSIONED, 0.9, "gnu gpl version 3(?: only| or later)?"),
    ("gpl-2.0", SENTENCE, 0.9, "under the terms of version 2 of the gnu general public licen[cs]e"),
    ("gpl-classpath", SENTENCE, 0.9, "linking this library statically or dynamically with other modules is making a combined work"),
    ("gpl-classpath", VERSIONED, 0.9, "classpath exception"),
    ("gpl-font", VERSIONED, 0.9, "gpl (?:with )?font exception"),
    ("gpl-gcc", VERSIONED, 0.9, "gcc runtime library exception"),
    ("lgpl", SENTENCE, 0.9, "redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("lgpl", SENTENCE, 0.85, "a work that uses the library"),
    ("lgpl-2.1", TAG, 1.0, "gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?"),
    ("lgpl-3.0", TAG, 1.0, "gnu org licenses lgpl 3 0(?: html| txt)?"),
    ("lgpl-2.1", VERSIONED, 0.95, "(?:lgpl v2|lgplv2) 1(?: only| or later)?"),
    ("lgpl-3.0", VERSIONED, 0.95, "(?:lgpl v3|lgplv3)(?: only| or later)?"),
    ("agpl-3.0", TAG, 1.0, "gnu org licenses agpl 3 0(?: html| txt)?"),
    ("agpl-3.0", VERSIONED, 0.95, "(?:agpl v3|agplv3)(?: only| or later)?"),
    ("agpl", SENTENCE, 0.85, "remote network interaction use with the gnu general public licen[cs]e"),
    ("gfdl", SENTENCE, 0.9, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("gfdl", SENTENCE, 0.8, "with no invariant sections"),
    ("mpl-2.0", SENTENCE, 0.95, "this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("mpl-1.1", SENTENCE, 0.95, "the contents of this file are subject to the mozilla public licen[cs]e version 1 1"),
    ("mpl-2.0", TAG, 1.0, "mozilla org mpl 2 0"),
    ("mpl-1.1", TAG, 1.0, "mozilla org mpl mpl 1 1(?: html)?"),
    ("mpl", SENTENCE, 0.85, "incompatible with secondary licenses as defined by the mozilla public licen[cs]e"),
    ("npl-1.1", SENTENCE, 0.95, "the contents of this file are subject to the netscape public licen[cs]e version 1 1"),
    ("epl-1.0", TAG, 1.0, "eclipse org legal epl v10(?: html)?"),
    ("epl-2.0", TAG, 1.0, "eclipse org legal epl (?:2 0|v20)(?: html)?"),
    ("epl", SENTENCE, 0.85, "made available under the terms of the eclipse public licen[cs]e"),
    ("epl", SENTENCE, 0.8, "the accompanying materials are provided under the terms of this agreement"),
    ("cpl-1.0", TAG, 1.0, "opensource org licenses cpl1 0"),
    ("cddl", SENTENCE, 0.9, "the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("cddl-1.0", TAG, 1.0, "opensource org licenses cddl1?"),
    ("cddl", SENTENCE, 0.85, "cddl header start"),
    ("eupl", SENTENCE, 0.9, "you may not use this work except in compliance with the licence"),
    ("eupl", TAG, 1.0, "joinup ec europa eu software page eupl"),
    ("osl-3.0", SENTENCE, 0.9, "licensed under the open software licen[cs]e version 3 0"),
    ("apsl-2.0", SENTENCE, 0.9, "subject to the apple public source licen[cs]e version 2 0"),
    ("ms-pl", TAG, 1.0, "opensource org licenses ms pl"),
    ("ms-pl", SENTENCE, 0.85, "each contributor grants you a non exclusive worldwide royalty free copyright licen[cs]e to reproduce its contribution"),
    ("qpl-1.0", VERSIONED, 0.95, f"q public {L}(?: version)?(?: 1 0)?"),
    ("sspl-1.0", SENTENCE, 0.9, "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("busl-1.1", VERSIONED, 0.95, f"business source {L}(?: version)?(?: 1 1)?"),
    ("busl-1.1", SENTENCE, 0.85, "change date change licen[cs]e"),
    ("elastic-2.0", VERSIONED, 0.95, f"elastic {L}(?: v2| 2 0)?"),
    ("elastic-2.0", SENTENCE, 0.85, "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", VERSIONED, 0.95, f"commons clause(?: {L} condition)?(?: v1 0)?"),
    ("commons-clause", SENTENCE, 0.85, "the licen[cs]e does not grant to you the right to sell the software"),
    ("polyform", VERSIONED, 0.95, f"polyform (?:noncommercial|shield|strict|perimeter|small business|free trial|internal use) {L}(?: 1 0 [01])?"),
    ("prosperity", VERSIONED, 0.9, f"prosperity public {L}"),
    ("parity", VERSIONED, 0.9, f"parity public {L}"),
    ("hippocratic", VERSIONED, 0.95, f"hippocratic {L}(?: version)?(?: 2 1)?"),
    ("cecill", SENTENCE, 0.9, "this software is governed by the cecill licen[cs]e under french law"),
    ("cecill", TAG, 1.0, "cecill info"),
    ("watcom-1.0", VERSIONED, 0.9, f"sybase open watcom public {L}(?: version 1 0)?"),
    ("nosl", VERSIONED, 0.9, f"netizen open source {L}"),
    ("nasa-1.3", VERSIONED, 0.95, "nasa open source agreement(?: version)?(?: 1 3)?"),
    ("rpl-1.5", VERSIONED, 0.95, f"reciprocal public {L}(?: 1 5)?"),
    ("simpl-2.0", VERSIONED, 0.9, f"simple public {L}(?: 2 0)?"),
    ("sissl", VERSIONED, 0.9, f"sun industry standards source {L}"),
    ("spl-1.0", VERSIONED, 0.9, f"sun public {L}(?: version 1 0)?"),
    ("bcl", VERSIONED, 0.9, f"(?:oracle|sun) binary code {L} agreement"),
    ("otn", VERSIONED, 0.9, f"oracle technology network {L} agreement"),
    ("artistic", SENTENCE, 0.85, "you can redistribute it and or modify it under the same terms as perl itself"),
    ("artistic", SENTENCE, 0.85, "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", TAG, 1.0, "perlfoundation org artistic license 2 0"),
    ("ruby", SENTENCE, 0.85, "you may make and give away verbatim copies of the source form of the software without restriction"),
    ("ofl-1.1", SENTENCE, 0.9, "this font software is licensed under the sil open font licen[cs]e version 1 1"),
    ("ofl", TAG, 1.0, "scripts sil org ofl"),
    ("ofl", SENTENCE, 0.8, "with reserved font name"),
    ("bitstream-vera", VERSIONED, 0.9, "bitstream vera fonts copyright"),
    ("ubuntu-font", VERSIONED, 0.9, "ubuntu font licen[cs]e(?: version)?(?: 1 0)?"),
    ("arphic", VERSIONED, 0.9, f"arphic public {L}"),
    ("lppl", TAG, 1.0, "latex project org lppl"),
    ("lppl", SENTENCE, 0.85, "distributed and or modified under the conditions of the latex project public licen[cs]e"),
    ("zpl", SENTENCE, 0.8, "this software is subject to the provisions of the zope public licen[cs]e"),
    ("php-3.01", SENTENCE, 0.9, "this source file is subject to version 3 01 of the php licen[cs]e"),
    ("php", TAG, 1.0, "php net license"),
    # content and data
    ("cc", SENTENCE, 0.7, "creativecommons org licenses"),
    ("cc-by-4.0", TAG, 1.0, "creativecommons org licenses by 4 0"),
    ("cc-by-3.0", TAG, 1.0, "creativecommons org licenses by 3 0"),
    ("cc-by-2.0", TAG, 1.0, "creativecommons org licenses by 2 0"),
    ("cc-by-sa-4.0", TAG, 1.0, "creativecommons org licenses by sa 4 0"),
    ("cc-by-sa-3.0", TAG, 1.0, "creativecommons org licenses by sa 3 0"),
    ("cc-by-nc-4.0", TAG, 1.0, "creativecommons org licenses by nc 4 0"),
    ("cc-by-nc-sa-4.0", TAG, 1.0, "creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nd-4.0", TAG, 1.0, "creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-nd-4.0", TAG, 1.0, "creativecommons org licenses by nc nd 4 0"),
    ("cc", SENTENCE, 0.7, "licensed under a creative commons"),
    ("cc", SENTENCE, 0.7, "text is available under the creative commons"),
    ("ogl", VERSIONED, 0.9, "open government licen[cs]e(?: v?[123] 0| v[123])?"),
    ("ogl", SENTENCE, 0.85, "contains public sector information licensed under"),
    ("etalab", VERSIONED, 0.9, "licence ouverte(?: open licence)?(?: v?[12] 0)?"),
    ("dl-de", VERSIONED, 0.9, "datenlizenz deutschland (?:namensnennung|zero)(?: version)?(?: 2 0)?"),
    ("cdla", VERSIONED, 0.9, f"community data {L} agreement (?:permissive|sharing)(?: version)?(?: [12] 0)?"),
    ("odbl", TAG, 1.0, "opendatacommons org licenses odbl"),
    ("odc-by", TAG, 1.0, "opendatacommons org licenses by"),
    ("pddl", TAG, 1.0, "opendatacommons org licenses pddl"),
    ("osm", SENTENCE, 0.8, "openstreetmap contributors"),
    ("fal-1.3", VERSIONED, 0.9, "(?:free art licen[cs]e|licence art libre)(?: 1 3)?"),
    ("opl", VERSIONED, 0.85, "open (?:publication|content) licen[cs]e"),
    ("gutenberg", VERSIONED, 0.9, f"project gutenberg {L}"),
    # model licenses
    ("openrail", VERSIONED, 0.9, f"(?:bigscience |creativeml )?open ?rail(?: m)? {L}"),
    ("llama", VERSIONED, 0.9, f"llama (?:2|3|3 [123]|4) community {L}(?: agreement)?"),
    ("gemma", VERSIONED, 0.9, "gemma terms of use"),
    # notices that only say that there is a license
    ("licensed", MENTION, 0.4, "see (?:the )?(?:accompanying )?licen[cs]e (?:file )?for (?:more )?(?:details|information|terms)"),
    ("licensed", MENTION, 0.4, "under the terms of the licen[cs]e agreement"),
    ("licensed", MENTION, 0.4, "used with permission"),
    ("licensed", MENTION, 0.4, "reprinted (?:with|by) permission"),
]

# Families: label, name, short name, identifier, versions ("" is the family without a version).
FAMILIES = [
    ("gpl", f"gnu general public {L}", "(?:gnu )?gpl", "gpl", ["1.0", "2.0", "3.0"]),
    ("lgpl", f"gnu (?:lesser|library) general public {L}", "(?:gnu )?lgpl", "lgpl", ["2.0", "2.1", "3.0"]),
    ("agpl", f"(?:gnu )?affero general public {L}", "(?:gnu )?agpl", "agpl", ["1.0", "3.0"]),
    ("gfdl", f"gnu free documentation {L}", "(?:gnu )?(?:gfdl|fdl)", "gfdl", ["1.1", "1.2", "1.3"]),
    ("apache", f"apache (?:software )?{L}", "apache", "apache", ["1.0", "1.1", "2.0"]),
    ("mpl", f"mozilla public {L}", "mpl", "mpl", ["1.0", "1.1", "2.0"]),
    ("epl", f"eclipse public {L}", "epl", "epl", ["1.0", "2.0"]),
    ("cpl", f"common public {L}", "cpl", "cpl", ["1.0"]),
    ("ipl", f"ibm public {L}", "ipl", "ipl", ["1.0"]),
    ("cddl", f"common development and distribution {L}", "cddl", "cddl", ["1.0", "1.1"]),
    ("eupl", f"european union public {L}", "eupl", "eupl", ["1.0", "1.1", "1.2"]),
    ("osl", f"open software {L}", "osl", "osl", ["1.0", "1.1", "2.0", "2.1", "3.0"]),
    ("afl", f"academic free {L}", "afl", "afl", ["1.1", "1.2", "2.0", "2.1", "3.0"]),
    ("artistic", f"(?:perl )?artistic {L}", "artistic", "artistic", ["1.0", "2.0"]),
    ("bsl", f"boost software {L}", "bsl", "bsl", ["1.0"]),
    ("ofl", f"(?:sil )?open font {L}", "(?:sil )?ofl", "ofl", ["1.0", "1.1"]),
    ("odbl", f"open (?:data commons open )?database {L}", "odbl", "odbl", ["1.0"]),
    ("odc-by", f"open data commons attribution {L}", "odc by", "odc by", ["1.0"]),
    ("pddl", f"(?:open data commons )?public domain dedication and {L}", "pddl", "pddl", ["1.0"]),
    ("php", f"php {L}", "php", "php", ["3.0", "3.01"]),
    ("psf", f"(?:python software foundation|psf) {L}", "psf", "psf", ["2.0"]),
    ("zpl", f"zope public {L}", "zpl", "zpl", ["1.1", "2.0", "2.1"]),
    ("apsl", f"apple public source {L}", "apsl", "apsl", ["1.0", "1.1", "1.2", "2.0"]),
    ("npl", f"netscape public {L}", "npl", "npl", ["1.0", "1.1"]),
    ("lppl", f"latex project public {L}", "lppl", "lppl", ["1.0", "1.1", "1.2", "1.3a", "1.3c"]),
    ("ecl", f"educational community {L}", "ecl", "ecl", ["1.0", "2.0"]),
    ("cecill", f"cecill (?:free software )?{L}", "cecill", "cecill", ["1.0", "1.1", "2.0", "2.1"]),
    ("ms-pl", f"microsoft public {L}", "ms pl", "ms pl", [""]),
    ("ms-rl", f"microsoft reciprocal {L}", "ms rl", "ms rl", [""]),
    ("mit", f"(?:mit|expat) {L}", "mit", "mit", [""]),
    ("isc", f"isc {L}", "isc", "isc", [""]),
    ("zlib", f"zlib(?: libpng)? {L}", "zlib", "zlib", [""]),
    ("unlicense", "(?:the )?unlicense", "unlicense", "unlicense", [""]),
    ("wtfpl", f"do what the fuck you want to public {L}", "wtfpl", "wtfpl", [""]),
    ("ncsa", f"university of illinois ncsa open source {L}", "ncsa", "ncsa", [""]),
    ("upl", f"universal permissive {L}", "upl", "upl", ["1.0"]),
    ("postgresql", f"postgresql {L}", "postgresql", "postgresql", [""]),
    ("openssl", f"openssl {L}", "openssl", "openssl", [""]),
    ("ruby", f"ruby {L}", "ruby", "ruby", [""]),
    ("vim", f"vim {L}", "vim", "vim", [""]),
    ("w3c", f"w3c (?:software )?(?:notice and )?{L}", "w3c", "w3c", [""]),
    ("sspl", f"server side public {L}", "sspl", "sspl", ["1.0"]),
    ("bsd-2-clause", f"(?:simplified|2 clause) bsd {L}", "bsd 2 clause", "bsd 2 clause", [""]),
    ("bsd-3-clause", f"(?:new|modified|revised|3 clause) bsd {L}", "bsd 3 clause", "bsd 3 clause", [""]),
    ("bsd-4-clause", f"(?:original|4 clause) bsd {L}", "bsd 4 clause", "bsd 4 clause", [""]),
    ("bsd", f"bsd {L}", "bsd", "bsd", [""]),
]
UNDER = "(?:licensed|released|distributed|available|published|used)"
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
CC_NAMES = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nc": "attribution non ?commercial", "by-nd": "attribution no ?deriv(?:ative)?s?(?: works)?", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"}
CC_PORT = "(?: (?:international|unported|generic))?"

# Words that tell little; a rule is gated by others where it has any.
COMMON = set("a an and any are as at be by for free if in is it its may must not of on or see shall software terms that the this to under use used with without work you version public open source general no all".split())


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    confidence: float
    pattern: str
    #: Every match has this word, or of "a|b" one of them.
    keyword: str


def _pieces(pattern: str) -> tuple[str, list[str]]:
    """pattern with its outer groups replaced, and the insides of those that every match goes through, which
    stand as #0#, #1#. An optional group that brings its own space vanishes; any other leaves an unknown, ~."""
    out, groups, at = "", [], 0
    while at < len(pattern):
        if not pattern.startswith("(?:", at):
            out, at = out + pattern[at], at + 1
            continue
        depth, end = 1, at + 3
        while depth:
            depth += {"(": 1, ")": -1}.get(pattern[end], 0)
            end += 1
        inside, then = pattern[at + 3 : end - 1], pattern[end : end + 1]
        if then in ("?", "*"):
            each = _alternatives(inside)
            spaced = all(x.startswith(" ") for x in each) or all(re.sub(r"(\)\?)+$", "", x).endswith(" ") for x in each)
            out, at = out + ("" if spaced else "~"), end + 1
        else:
            out, at = out + f"#{len(groups)}#", end
            groups.append(inside)
    return out.replace(" ?", "~"), groups


def _alternatives(inside: str) -> list[str]:
    out, depth = [""], 0
    for c in inside:
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def keyword(pattern: str) -> str:
    """A word that every match of an expression has, or alternatives a|b of which it has one; "" if none is sure.

    A plain word outside all groups is in every match; of a group that every match goes through, one word of
    each alternative. A word goes before alternatives, an uncommon one before a common one, then the longest.
    """
    flat, groups = _pieces(pattern)
    found = []
    for token in flat.split(" "):
        group = re.fullmatch("#([0-9]+)#", token)
        if re.fullmatch("[a-z0-9]+", token):
            found.append(token)
        elif token == L:
            found.append("license|licence")
        elif group:
            each = [keyword(x) for x in _alternatives(groups[int(group[1])])]
            if all(each):
                found.append("|".join(sorted({w for x in each for w in x.split("|")})))
    telling = [w for w in found if not any(x in COMMON or x.isdigit() for x in w.split("|"))] or found
    return min(telling, key=lambda w: (w.count("|"), -len(w)), default="")


def version_pattern(version: str) -> str:
    major, _, minor = version.partition(".")
    number = major + (f"(?: {minor})?" if minor == "0" else f" {minor}")
    return f"(?:(?:version |ver )?(?:v ?)?{number})"


def family_rules() -> list[tuple[str, int, float, str]]:
    out = []
    for label, name, short, identifier, versions in FAMILIES:
        for version in versions:
            v = f" {version_pattern(version)}" if version else ""
            full = f"{label}-{version}" if version else label
            out.append((full, VERSIONED, 0.95, f"(?:the )?{name}{v}"))
            out.append((full, VERSIONED, 0.9, f"{UNDER} under (?:the )?(?:terms of (?:the )?)?{short}{v}"))
            out.append((full, TAG, 1.0, f"{SPDX} {identifier}" + (f" {version.replace('.', ' ')}" if version else "") + "(?: only| or later)?"))
        if versions != [""]:
            out.append((label, MENTION, 0.8, f"(?:the )?{name}"))
    for kind, name in CC_NAMES.items():
        for version in CC_VERSIONS:
            words, v = kind.replace("-", " "), version.replace(".", " ")
            out.append((f"cc-{kind}-{version}", VERSIONED, 0.95, f"creative commons {name}{CC_PORT}(?: {L})?(?: version)? {v}{CC_PORT}(?: {L})?"))
            out.append((f"cc-{kind}-{version}", TAG, 0.95, f"cc {words} {v}"))
        out.append((f"cc-{kind}", MENTION, 0.8, f"creative commons {name}"))
    return out


@functools.cache
def rules() -> list[Rule]:
    """All rules in order: signatures first, then what follows from the families."""
    return [Rule(label, priority, confidence, pattern, keyword(pattern)) for label, priority, confidence, pattern in [*SIGNATURES, *family_rules()]]
