"""License scans with ordered signature rules, in DataFrame expressions only.

A text becomes its words (A-Z lower-cased; runs of digits, a-z and non-ASCII), one blank on each side of each. Base
phrases are counted there. A rule, of some three hundred written by hand, has a label, a priority, a keyword and a pattern
over such words. The keyword gates the rule: its pattern runs only on texts in which a word starts with the keyword, as one
does in every match of the pattern (what has no keyword in common is several rules). All places of a pattern are
detections; of those, one that lies inside another of the same or a higher priority is suppressed (of equal places, the
higher priority and then the earlier rule stays). A text's labels are those of its base phrases and of its remaining
detections.

All work is inside one row: no shuffle, no join. Detections are swept once in order of place with the furthest end seen
for each priority, so long texts with many detections stay linear in the sweep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.batches import keyed_text

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Priorities: an identifier line, a text's own words, a name, a hint.
SPDX, TEXT, NAME, HINT = 4, 3, 2, 1
TOP = SPDX

def _v(*numbers: str) -> str:
    """An optional version, with or without a word before it."""
    return f"(?:(?: (?:version|v|ver|revision))? (?:{'|'.join(numbers)}))?(?: or (?:any )?later(?: version)?| only)?"


#: (label, priority, keyword, pattern). Written by hand, most telling first within each part.
RULES: list[tuple[str, int, str, str]] = [
    # Identifier lines.
    ("apache", SPDX, "spdx", "spdx licen[cs]e identifier apache(?: [12] [01])?"),
    ("mit", SPDX, "spdx", "spdx licen[cs]e identifier mit(?: 0| cmu| modern variant)?"),
    ("bsd-2-clause", SPDX, "spdx", "spdx licen[cs]e identifier bsd 2 clause(?: patent| views)?"),
    ("bsd-3-clause", SPDX, "spdx", "spdx licen[cs]e identifier bsd 3 clause(?: clear| lbnl| attribution)?"),
    ("bsd-4-clause", SPDX, "spdx", "spdx licen[cs]e identifier bsd 4 clause(?: uc)?"),
    ("0bsd", SPDX, "spdx", "spdx licen[cs]e identifier 0bsd"),
    ("gpl", SPDX, "spdx", "spdx licen[cs]e identifier gpl [123] 0(?: only| or later)?"),
    ("lgpl", SPDX, "spdx", "spdx licen[cs]e identifier lgpl [23] [01](?: only| or later)?"),
    ("agpl", SPDX, "spdx", "spdx licen[cs]e identifier agpl [13] 0(?: only| or later)?"),
    ("gfdl", SPDX, "spdx", "spdx licen[cs]e identifier gfdl 1 [123](?: only| or later)?"),
    ("mpl", SPDX, "spdx", "spdx licen[cs]e identifier mpl [12] [01]"),
    ("epl", SPDX, "spdx", "spdx licen[cs]e identifier epl [12] 0"),
    ("cddl", SPDX, "spdx", "spdx licen[cs]e identifier cddl 1 [01]"),
    ("isc", SPDX, "spdx", "spdx licen[cs]e identifier isc"),
    ("zlib", SPDX, "spdx", "spdx licen[cs]e identifier zlib"),
    ("bsl", SPDX, "spdx", "spdx licen[cs]e identifier bsl 1 0"),
    ("busl", SPDX, "spdx", "spdx licen[cs]e identifier busl 1 1"),
    ("unlicense", SPDX, "spdx", "spdx licen[cs]e identifier unlicense"),
    ("cc0", SPDX, "spdx", "spdx licen[cs]e identifier cc0 1 0"),
    ("cc-by", SPDX, "spdx", "spdx licen[cs]e identifier cc by [1-4] [05]"),
    ("cc-by-sa", SPDX, "spdx", "spdx licen[cs]e identifier cc by sa [1-4] [05]"),
    ("cc-by-nc", SPDX, "spdx", "spdx licen[cs]e identifier cc by nc [1-4] [05]"),
    ("ofl", SPDX, "spdx", "spdx licen[cs]e identifier ofl 1 [01]"),
    ("proprietary", SPDX, "spdx", "spdx licen[cs]e identifier licenseref (?:proprietary|commercial)"),
    # Words of the licences themselves and of their notices.
    ("mit", TEXT, "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", TEXT, "permission", "this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", TEXT, "noninfringement", "warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", TEXT, "liab", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("isc", TEXT, "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", TEXT, "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("hpnd", TEXT, "permission", "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("bsd", TEXT, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", TEXT, "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd", TEXT, "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", TEXT, "endorse", "neither the name of .{1,80}? may be used to endorse or promote products"),
    ("bsd-3-clause", TEXT, "endorse", "the names? of (?:the|its|any) (?:author|authors|contributors|copyright holder) may (?:not )?be used to endorse"),
    ("bsd-4-clause", TEXT, "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("bsd", TEXT, "consequential", "direct indirect incidental special exemplary or consequential damages"),
    ("apache", TEXT, "compliance with", "you may not use this file except in compliance with the licen[cs]e (?:.{0,60}? )?apache"),
    ("apache", TEXT, "compliance with", "you may not use this file except in compliance with the licen[cs]e you may obtain a copy"),
    ("apache", TEXT, "unless required", "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis"),
    ("apache", TEXT, "apache", "this product includes software developed (?:at|by) the apache software foundation"),
    ("apache", TEXT, "contributor", "licensed to the apache software foundation (?:.{0,20}? )?under one or more contributor licen[cs]e agreements"),
    ("gpl", TEXT, "free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl", TEXT, "gnu general", "you should have received a copy of the gnu general public licen[cs]e along with this program"),
    ("gpl", TEXT, "copyleft", "the gnu general public licen[cs]e is a free copyleft licen[cs]e"),
    ("gpl", TEXT, "freedom", "the licen[cs]es for most software (?:and other practical works )?are designed to take away your freedom"),
    ("gpl", TEXT, "derived", "you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program"),
    ("gpl-or-later", TEXT, "later version", "(?:either )?version [123] of the licen[cs]e or at your option any later version"),
    ("gpl-only", TEXT, "no later", "under version [123] of the licen[cs]e and no later version"),
    ("lgpl", TEXT, "free software", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("lgpl", TEXT, "lesser", "you should have received a copy of the gnu lesser general public licen[cs]e"),
    ("lgpl", TEXT, "link", "a program that contains no derivative of any portion of the library but is designed to work with the library by being compiled or linked with it"),
    ("agpl", TEXT, "affero", "you should have received a copy of the gnu affero general public licen[cs]e"),
    ("agpl", TEXT, "network", "all users interacting with it remotely through a computer network"),
    ("gpl-exception", TEXT, "special exception", "as a special exception (?:.{0,60}? )?(?:link|linking|linked|combine)"),
    ("gpl-exception", NAME, "classpath", "(?:gnu )?classpath exception"),
    ("gfdl", TEXT, "invariant", "with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", TEXT, "invariant", "with the invariant sections being"),
    ("mpl", TEXT, "mozilla", "this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("mpl", TEXT, "mpl", "if a copy of the mpl was not distributed with this file you can obtain one"),
    ("mpl", TEXT, "covered software", "covered software is provided under this licen[cs]e on an as is basis"),
    ("epl", TEXT, "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("epl", TEXT, "recipient", "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("cddl", TEXT, "cddl", "the contents of this file are subject to the terms of the cddl"),
    ("cddl", TEXT, "common development", "the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("bsl", TEXT, "permission", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[cs]e"),
    ("busl", TEXT, "production use", "the licensor may make an additional use grant above permitting limited production use"),
    ("busl", TEXT, "change date", "effective on the change date or the fourth anniversary of the first publicly available distribution"),
    ("sspl", TEXT, "service", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic", TEXT, "managed service", "you may not provide the software to third parties as a hosted or managed service"),
    ("zlib", TEXT, "altered", "altered source versions must be plainly marked as such"),
    ("zlib", TEXT, "misrepresented", "the origin of this software must not be misrepresented"),
    ("zlib", TEXT, "warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("libpng", TEXT, "png", "the png reference library is supplied as is"),
    ("unlicense", TEXT, "unencumbered", "free and unencumbered software released into the public domain"),
    ("unlicense", TEXT, "dedicat", "we make this dedication for the benefit of the public at large"),
    ("wtfpl", TEXT, "fuck", "you just do what the fuck you want to"),
    ("beerware", TEXT, "beer", "you can buy me a beer in return"),
    ("json", TEXT, "evil", "the software shall be used for good not evil"),
    ("artistic", TEXT, "package", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic", TEXT, "perl", "you may redistribute it and or modify it under the same terms as perl itself"),
    ("ruby", TEXT, "ruby", "this software is distributed under the same terms as ruby"),
    ("python", TEXT, "python", "this licen[cs]e agreement is between the python software foundation"),
    ("python", TEXT, "beopen", "beopen python open source licen[cs]e agreement"),
    ("openssl", TEXT, "openssl", "this product includes software developed by the openssl project"),
    ("openssl", TEXT, "cryptographic", "this product includes cryptographic software written by eric young"),
    ("php", TEXT, "php", "this product includes php software freely available from"),
    ("postgresql", TEXT, "permission", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ncsa", TEXT, "deal with", "to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies (?:.{0,90}? )?developed by"),
    ("w3c", TEXT, "w3c", "by obtaining using and or copying this work you (?:.{0,20}? )?agree (?:.{0,120}? )?w3c"),
    ("x11", TEXT, "x consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("curl", TEXT, "permission", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("ofl", TEXT, "font", "this font software is licensed under the sil open font licen[cs]e"),
    ("ofl", TEXT, "font software", "neither the font software nor any of its individual components (?:.{0,40}? )?may be sold by itself"),
    ("ms-pl", TEXT, "reciprocal", "this licen[cs]e governs use of the accompanying software (?:.{0,160}? )?reciprocal"),
    ("ms-pl", TEXT, "use the software", "if you use the software you accept this licen[cs]e if you do not accept the licen[cs]e do not use the software"),
    ("cecill", TEXT, "cecill", "this software is governed by the cecill(?: b| c)? licen[cs]e under french law"),
    ("eupl", TEXT, "eupl", "licensed under the eupl"),
    ("odbl", TEXT, "database", "this database is made available under the open database licen[cs]e"),
    ("odbl", TEXT, "database contents", "any rights in individual contents of the database are licensed under the database contents licen[cs]e"),
    ("ogl", TEXT, "public sector", "contains public sector information licensed under the open government licen[cs]e"),
    ("cc-by", TEXT, "appropriate credit", "you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made"),
    ("cc-by-sa", TEXT, "sharealike", "sharealike if you remix transform or build upon the material you must distribute your contributions under the same licen[cs]e"),
    ("cc-by-nc", TEXT, "noncommercial", "noncommercial you may not use the material for commercial purposes"),
    ("cc-by-nd", TEXT, "noderivatives", "noderivatives if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc0", TEXT, "waive", "has waived all copyright and related or neighboring rights to this work"),
    ("cc0", TEXT, "zero", "creative commons zero"),
    ("public-domain", TEXT, "public domain", "this (?:work|file|code|software) (?:is|has been|was) (?:hereby )?(?:placed|released|put|dedicated) (?:in|into|in to|to) the public domain"),
    ("public-domain", TEXT, "public domain", "no copyright is claimed (?:.{0,60}? )?public domain"),
    ("us-government", TEXT, "government", "work of the (?:united states|u s) government"),
    ("openrail", TEXT, "restrictions", "use based restrictions as referenced in"),
    ("llama", TEXT, "llama", "built with (?:meta )?llama"),
    ("llama", TEXT, "llama", "llama (?:2|3|3 1|3 2|3 3|4) is licensed under the llama"),
    ("gemma", TEXT, "gemma", "gemma is provided under and subject to the gemma terms of use"),
    ("reserved", TEXT, "reserved", "all rights(?: are)? reserved"),
    ("some-reserved", TEXT, "reserved", "some rights reserved"),
    ("no-reserved", TEXT, "reserved", "no rights reserved"),
    ("copyleft-art", TEXT, "copyleft", "copyleft this is a free work you can copy distribute and modify it under the terms of the free art licen[cs]e"),
    # Addresses.
    ("apache", TEXT, "apache", "apache org licen[cs]es(?: licen[cs]e)?(?: [12] [01])?"),
    ("mit", TEXT, "opensource", "opensource org licen[cs]es mit"),
    ("bsd-2-clause", TEXT, "opensource", "opensource org licen[cs]es bsd 2 clause"),
    ("bsd-3-clause", TEXT, "opensource", "opensource org licen[cs]es bsd 3 clause"),
    ("bsd", TEXT, "opensource", "opensource org licen[cs]es bsd licen[cs]e"),
    ("artistic", TEXT, "opensource", "opensource org licen[cs]es artistic licen[cs]e"),
    ("isc", TEXT, "opensource", "opensource org licen[cs]es isc"),
    ("gpl", TEXT, "gnu org", "gnu org (?:licen[cs]es|copyleft) gpl"),
    ("lgpl", TEXT, "gnu org", "gnu org (?:licen[cs]es|copyleft) (?:lgpl|lesser)"),
    ("agpl", TEXT, "gnu org", "gnu org licen[cs]es agpl"),
    ("gfdl", TEXT, "gnu org", "gnu org (?:licen[cs]es|copyleft) fdl"),
    ("mpl", TEXT, "mozilla", "mozilla org (?:en us )?mpl(?: 2 0)?"),
    ("epl", TEXT, "eclipse", "eclipse org (?:legal|org documents) epl"),
    ("edl", TEXT, "eclipse", "eclipse org org documents edl"),
    ("bsl", TEXT, "boost", "boost org licen[cs]e 1 0"),
    ("unlicense", NAME, "unlicense", "unlicense org"),
    ("wtfpl", TEXT, "wtfpl", "wtfpl net"),
    ("ofl", TEXT, "scripts", "scripts sil org ofl"),
    ("odbl", TEXT, "opendatacommons", "opendatacommons org licen[cs]es odbl"),
    ("odc-by", TEXT, "opendatacommons", "opendatacommons org licen[cs]es by"),
    ("pddl", TEXT, "opendatacommons", "opendatacommons org licen[cs]es pddl"),
    ("cc0", TEXT, "creativecommons", "creativecommons org publicdomain zero"),
    ("public-domain", TEXT, "creativecommons", "creativecommons org publicdomain mark"),
    ("public-domain", TEXT, "creativecommons", "creativecommons org licen[cs]es publicdomain"),
    ("cc-by", TEXT, "creativecommons", "creativecommons org licen[cs]es by [1-4]"),
    ("cc-by-sa", TEXT, "creativecommons", "creativecommons org licen[cs]es by sa [1-4]"),
    ("cc-by-nc", TEXT, "creativecommons", "creativecommons org licen[cs]es by nc [1-4]"),
    ("cc-by-nd", TEXT, "creativecommons", "creativecommons org licen[cs]es by nd [1-4]"),
    ("cc-by-nc-sa", TEXT, "creativecommons", "creativecommons org licen[cs]es by nc sa [1-4]"),
    ("cc-by-nc-nd", TEXT, "creativecommons", "creativecommons org licen[cs]es by nc nd [1-4]"),
    ("ogl", TEXT, "nationalarchives", "nationalarchives gov uk doc open government licen[cs]e"),
    ("llama", TEXT, "llama", "(?:ai|www) (?:meta com )?llama (?:com )?licen[cs]e"),
    # Names, with versions where there are any.
    ("apache", NAME, "apache", "apache(?: software)? licen[cs]e" + _v("1 0", "1 1", "2 0", "2")),
    ("apache", NAME, "asl", "asl 2 0"),
    ("mit", NAME, "mit", "mit(?: x11| style)? licen[cs]e"),
    ("mit", NAME, "mit", "(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?mit"),
    ("mit", NAME, "expat", "expat licen[cs]e"),
    ("mit-0", NAME, "mit no", "mit no attribution(?: licen[cs]e)?"),
    ("x11", NAME, "x11", "x11 licen[cs]e"),
    ("bsd", NAME, "bsd", "(?:new |modified |simplified |revised |original )?bsd(?: style)? licen[cs]e"),
    ("bsd-2-clause", NAME, "bsd 2", "bsd 2 clause(?: licen[cs]e)?"),
    ("bsd-2-clause", NAME, "clause bsd", "(?:2|two) clause bsd(?: licen[cs]e)?"),
    ("bsd-3-clause", NAME, "bsd 3", "bsd 3 clause(?: licen[cs]e)?"),
    ("bsd-3-clause", NAME, "clause bsd", "(?:3|three) clause bsd(?: licen[cs]e)?"),
    ("bsd-4-clause", NAME, "bsd 4", "bsd 4 clause(?: licen[cs]e)?"),
    ("bsd-4-clause", NAME, "clause bsd", "(?:4|four) clause bsd(?: licen[cs]e)?"),
    ("0bsd", NAME, "0bsd", "0bsd"),
    ("0bsd", NAME, "zero clause", "zero clause bsd(?: licen[cs]e)?"),
    ("gpl", NAME, "general public", "(?:gnu )?general public licen[cs]e" + _v("1", "1 0", "2", "2 0", "3", "3 0")),
    ("gpl", NAME, "gpl", "(?:gnu )?gpl" + _v("1", "1 0", "2", "2 0", "3", "3 0")),
    ("gpl", NAME, "gplv", "(?:gnu )?gplv[123](?: 0)?"),
    ("lgpl", NAME, "lesser", "(?:gnu )?lesser general public licen[cs]e" + _v("2 1", "3", "3 0")),
    ("lgpl", NAME, "library general", "(?:gnu )?library general public licen[cs]e" + _v("2", "2 0")),
    ("lgpl", NAME, "lgpl", "(?:gnu )?lgpl" + _v("2", "2 0", "2 1", "3", "3 0")),
    ("lgpl", NAME, "lgplv", "(?:gnu )?lgplv[23](?: [01])?"),
    ("agpl", NAME, "affero", "(?:gnu )?affero general public licen[cs]e" + _v("1", "1 0", "3", "3 0")),
    ("agpl", NAME, "agpl", "(?:gnu )?agpl" + _v("1", "1 0", "3", "3 0")),
    ("agpl", NAME, "agplv", "(?:gnu )?agplv[13]"),
    ("gfdl", NAME, "free documentation", "(?:gnu )?free documentation licen[cs]e" + _v("1 1", "1 2", "1 3")),
    ("gfdl", NAME, "gfdl", "(?:gnu )?gfdl" + _v("1 1", "1 2", "1 3")),
    ("mpl", NAME, "mozilla public", "mozilla public licen[cs]e" + _v("1 0", "1 1", "2 0")),
    ("mpl", NAME, "mpl", "mpl(?: (?:version )?[12] [01])"),
    ("epl", NAME, "eclipse public", "eclipse public licen[cs]e" + _v("1 0", "2 0")),
    ("edl", NAME, "eclipse distribution", "eclipse distribution licen[cs]e" + _v("1 0")),
    ("cddl", NAME, "common development", "common development and distribution licen[cs]e" + _v("1 0", "1 1")),
    ("cddl", NAME, "cddl", "cddl" + _v("1 0", "1 1")),
    ("cpl", NAME, "common public", "common public licen[cs]e" + _v("1 0")),
    ("cpal", NAME, "common public", "common public attribution licen[cs]e" + _v("1 0")),
    ("eupl", NAME, "european union", "european union public licen[cs]e" + _v("1 0", "1 1", "1 2")),
    ("artistic", NAME, "artistic", "(?:clarified |perl )?artistic licen[cs]e" + _v("1 0", "2 0")),
    ("bsl", NAME, "boost", "boost software licen[cs]e" + _v("1 0")),
    ("busl", NAME, "business source", "business source licen[cs]e" + _v("1 0", "1 1")),
    ("sspl", NAME, "server side", "server side public licen[cs]e" + _v("1", "1 0")),
    ("elastic", NAME, "elastic", "elastic licen[cs]e" + _v("1 0", "2 0")),
    ("zlib", NAME, "zlib", "zlib(?: libpng)? licen[cs]e"),
    ("libpng", NAME, "libpng", "libpng licen[cs]e" + _v("1", "2", "2 0")),
    ("isc", NAME, "isc", "isc licen[cs]e"),
    ("unlicense", NAME, "the unlicense", "the unlicense"),
    ("wtfpl", NAME, "wtfpl", "wtfpl" + _v("1", "2", "2 0")),
    ("wtfpl", NAME, "fuck", "do what the fuck you want to public licen[cs]e" + _v("1", "2", "2 0")),
    ("beerware", NAME, "beerware", "beerware licen[cs]e"),
    ("python", NAME, "python", "python(?: software foundation)? licen[cs]e" + _v("2", "2 0")),
    ("python", NAME, "psf", "psf licen[cs]e"),
    ("php", NAME, "php", "php licen[cs]e" + _v("3 0", "3 01")),
    ("ruby", NAME, "ruby", "ruby licen[cs]e"),
    ("openssl", NAME, "openssl", "openssl licen[cs]e"),
    ("postgresql", NAME, "postgresql", "postgresql licen[cs]e"),
    ("ms-pl", NAME, "microsoft public", "microsoft public licen[cs]e"),
    ("ms-rl", NAME, "microsoft reciprocal", "microsoft reciprocal licen[cs]e"),
    ("ms-eula", NAME, "microsoft software", "microsoft software licen[cs]e terms"),
    ("ofl", NAME, "open font", "(?:sil )?open font licen[cs]e" + _v("1 0", "1 1")),
    ("odbl", NAME, "database licen", "open (?:data commons open )?database licen[cs]e" + _v("1 0")),
    ("odc-by", NAME, "commons attribution", "open data commons attribution licen[cs]e" + _v("1 0")),
    ("pddl", NAME, "public domain dedication", "public domain dedication and licen[cs]e" + _v("1 0")),
    ("cdla-permissive", NAME, "community data", "community data licen[cs]e agreement permissive" + _v("1 0", "2 0")),
    ("cdla-sharing", NAME, "community data", "community data licen[cs]e agreement sharing" + _v("1 0")),
    ("ogl", NAME, "open government", "open government licen[cs]e" + _v("1 0", "2 0", "3 0")),
    ("upl", NAME, "universal permissive", "universal permissive licen[cs]e" + _v("1 0")),
    ("afl", NAME, "academic free", "academic free licen[cs]e" + _v("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("osl", NAME, "open software", "open software licen[cs]e" + _v("1 0", "2 0", "2 1", "3 0")),
    ("ncsa", NAME, "university of illinois", "university of illinois(?: ncsa)? open source licen[cs]e"),
    ("w3c", NAME, "w3c", "w3c(?: software(?: notice and)?| document)? licen[cs]e"),
    ("qpl", NAME, "q public", "q public licen[cs]e" + _v("1 0")),
    ("vim", NAME, "vim", "vim licen[cs]e"),
    ("bittorrent", NAME, "bittorrent", "bittorrent open source licen[cs]e" + _v("1 0", "1 1")),
    ("mulan", NAME, "mulan", "mulan (?:psl|permissive software licen[cs]e)" + _v("1", "2")),
    ("cecill", NAME, "cecill", "cecill(?: b| c)?(?: free software)?(?: licen[cs]e)?" + _v("1 0", "2 0", "2 1")),
    ("sleepycat", NAME, "sleepycat", "sleepycat licen[cs]e"),
    ("json", NAME, "json", "json licen[cs]e"),
    ("apsl", NAME, "apple public", "apple public source licen[cs]e" + _v("1 0", "1 1", "1 2", "2 0")),
    ("npl", NAME, "netscape", "netscape public licen[cs]e" + _v("1 0", "1 1")),
    ("ipl", NAME, "ibm", "ibm public licen[cs]e" + _v("1 0")),
    ("spl", NAME, "sun public", "sun public licen[cs]e" + _v("1 0")),
    ("zpl", NAME, "zope", "zope public licen[cs]e" + _v("1 1", "2 0", "2 1")),
    ("lppl", NAME, "latex", "latex project public licen[cs]e" + _v("1 0", "1 1", "1 2", "1 3", "1 3a", "1 3c")),
    ("rpl", NAME, "reciprocal public", "reciprocal public licen[cs]e" + _v("1 1", "1 5")),
    ("intel-bsd", NAME, "intel", "intel(?: simplified)? (?:open source|software) licen[cs]e"),
    ("nvidia", NAME, "nvidia", "nvidia (?:software|source code|open model) licen[cs]e(?: agreement)?"),
    ("polyform", NAME, "polyform", "polyform (?:noncommercial|small business|shield|strict|perimeter|internal use) licen[cs]e" + _v("1 0 0")),
    ("commons-clause", NAME, "commons clause", "commons clause(?: licen[cs]e condition)?" + _v("1 0")),
    ("fair-source", NAME, "fair source", "fair source licen[cs]e"),
    ("hippocratic", NAME, "hippocratic", "hippocratic licen[cs]e" + _v("1 0", "2 0", "2 1", "3 0")),
    ("free-art", NAME, "free art", "free art licen[cs]e" + _v("1 2", "1 3")),
    ("openrail", NAME, "openrail", "openrail(?: m)?(?: licen[cs]e)?"),
    ("openrail", NAME, "open rail", "open rail(?: m)?(?: licen[cs]e)?"),
    ("openrail", NAME, "responsible ai", "responsible ai(?: m)?(?: licen[cs]e)?"),
    ("llama", NAME, "community licen", "llama (?:2|3|3 1|3 2|3 3|4) community licen[cs]e(?: agreement)?"),
    ("gemma", NAME, "gemma", "gemma (?:terms of use|licen[cs]e)"),
    ("cc0", NAME, "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", NAME, "commons attribution", "creative commons attribution" + _v("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by", NAME, "commons attribution", "creative commons attribution (?:international|unported|generic)"),
    ("cc-by-sa", NAME, "share", "creative commons attribution share ?alike" + _v("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", NAME, "commons attribution", "creative commons attribution non ?commercial" + _v("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", NAME, "commons attribution", "creative commons attribution no ?deriv(?:ative)?s?" + _v("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", NAME, "commons attribution", "creative commons attribution non ?commercial share ?alike" + _v("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", NAME, "commons attribution", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?" + _v("2 0", "2 5", "3 0", "4 0")),
    ("cc-by", NAME, "cc by", "cc by" + _v("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", NAME, "cc by sa", "cc by sa" + _v("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", NAME, "cc by nc", "cc by nc" + _v("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", NAME, "cc by nd", "cc by nd" + _v("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", NAME, "cc by nc sa", "cc by nc sa" + _v("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", NAME, "cc by nc nd", "cc by nc nd" + _v("2 0", "2 5", "3 0", "4 0")),
    ("proprietary", NAME, "proprietary", "proprietary and confidential"),
    ("proprietary", NAME, "proprietary", "confidential and proprietary"),
    ("proprietary", NAME, "proprietary", "proprietary licen[cs]e"),
    ("proprietary", NAME, "prior written", "without (?:the )?(?:express )?prior written (?:permission|consent)"),
    ("proprietary", NAME, "unauthorized", "unauthorized (?:copying|reproduction|use|distribution)"),
    ("proprietary", NAME, "trade secret", "trade secrets? (?:of|and)"),
    ("proprietary", NAME, "internal use", "for internal use only"),
    ("commercial", NAME, "commercial licen", "commercial licen[cs]e(?: agreement)?"),
    ("eula", NAME, "end user", "end user licen[cs]e agreement"),
    ("cla", NAME, "contributor licen", "contributor licen[cs]e agreement"),
    ("shareware", NAME, "shareware", "shareware"),
    ("freeware", NAME, "freeware", "freeware"),
    ("public-domain", NAME, "public domain", "(?:in|into|to|dedicated to|released to) the public domain"),
    # Hints.
    ("public-domain", HINT, "public domain", "public domain"),
    ("gpl-or-later", HINT, "later version", "any later version"),
    ("creative-commons", HINT, "creative commons", "creative commons(?: licen[cs]e)?"),
    ("copyright", HINT, "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]"),
    ("copyright", HINT, "copyright", "(?:under|protected by) copyright(?: law)?"),
    ("copyright", HINT, "copyright", "copyright notice"),
    ("copyleft", HINT, "copyleft", "copyleft"),
    ("open-source", HINT, "open source", "open source licen[cs]e"),
    ("noncommercial", HINT, "noncommercial", "noncommercial (?:use|purposes)(?: only)?"),
    ("noncommercial", HINT, "non commercial", "non commercial (?:use|purposes)(?: only)?"),
    ("research-only", HINT, "research", "for research (?:purposes|use) only"),
    ("educational-only", HINT, "educational", "for educational (?:purposes|use) only"),
    ("personal-only", HINT, "personal", "for personal (?:purposes|use) only"),
    ("warranty", HINT, "warrant", "(?:without|no) warrant(?:y|ies)(?: of any kind)?"),
    ("as-is", HINT, "provided as", "provided as is"),
    ("liability", HINT, "liability", "limitation of liability"),
    ("dual", HINT, "dual", "dual(?:ly)? licen[cs]ed"),
    ("patent", HINT, "patent", "patent (?:licen[cs]e|grant)"),
    ("trademark", HINT, "trademark", "registered trademarks? of"),
    ("terms", HINT, "terms", "terms (?:and conditions|of (?:use|service)) (?:apply|of this licen[cs]e)"),
    ("see-license", HINT, "licen", "see (?:the )?(?:accompanying )?(?:file )?licen[cs]e(?: txt| md)?(?: file)? for"),
    ("see-license", HINT, "copying", "see (?:the )?(?:accompanying )?(?:file )?copying(?: txt| md)?(?: file)? for"),
    ("see-license", HINT, "licen", "licen[cs]e information"),
]


def spaced_words(text: Column) -> Column:
    """The words with a blank before the first and after each; one blank if there are none."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def _blanks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _places(norm: Column, rule: Column) -> Column:
    """(start, end) of all matches: what stands between matches, and the matches, add up to places."""
    pattern = F.concat(F.lit("(?<= )(?:"), rule["pattern"], F.lit(")(?= )"))
    found = F.regexp_extract_all(norm, pattern, F.lit(0))
    gaps = F.split(norm, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _gated(norm: Column, rules: Column, keywords: set[str]) -> Column:
    """The rules of whose keywords one stands at the start of a word: one pass finds the longest keyword at each word, and
    those that it starts with stand there too."""
    hits = F.array_distinct(F.regexp_extract_all(norm, F.lit(f"(?= ({longest_of(keywords)}))"), F.lit(1)))
    # As an element, the hits are found once and not for each rule.
    return F.get(F.transform(F.array(hits), lambda hs: F.filter(rules, lambda r: F.exists(hs, lambda h: F.startswith(h, r["keyword"])))), 0)


def _detections(norm: Column, gated: Column) -> Column:
    """All detections of the gated rules by start, longest first, then by priority and rule order."""

    def of(rule: Column) -> Column:
        return F.transform(_places(norm, rule), lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("neg_end"), (-rule["priority"]).alias("neg_priority"), rule["ord"].alias("ord"), rule["label"].alias("label")))

    return F.array_sort(F.flatten(F.transform(gated, of)))


def _kept(detections: Column) -> Column:
    """Labels and the highest priority of what is not suppressed."""
    start = F.struct(F.array_repeat(F.lit(-1), TOP).alias("ends"), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("best"), F.lit(0).alias("n"))

    def step(acc: Column, d: Column) -> Column:
        end, priority = -d["neg_end"], -d["neg_priority"]
        inside = F.element_at(acc["ends"], priority) >= end  # ends[p]: furthest end of priorities of p at least
        ends = F.transform(acc["ends"], lambda e, i: F.when((i < priority) & (e < end), end).otherwise(e))
        return F.struct(
            ends.alias("ends"),
            F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(d["label"]))).alias("labels"),
            F.when(inside, acc["best"]).otherwise(F.greatest(acc["best"], priority)).alias("best"),
            (acc["n"] + F.when(inside, 0).otherwise(1)).alias("n"),
        )

    return F.aggregate(detections, start, step)


def longest_of(words: set[str]) -> str:
    """A pattern for the longest of the words at a place, that parts at each letter, so that few alternatives are tried."""
    by_letter: dict[str, set[str]] = {}
    for w in words - {""}:
        by_letter.setdefault(w[0], set()).add(w[1:])
    if not by_letter:
        return ""
    return "(?:" + "|".join(c + longest_of(rest) for c, rest in sorted(by_letter.items())) + (")?" if "" in words else ")")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[tuple[str, int, str, str]] = RULES) -> DataFrame:
    """Counts of words and base phrases, the first and last base place in words, and labels, for each row.

    Null and empty texts have no words and no labels; repeated rows are repeated. score is the highest priority of the
    remaining detections over the top priority, 0 without any.
    """
    table = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(keyword).alias("keyword"), F.lit(pattern).alias("pattern"), F.lit(i).alias("ord")) for i, (label, priority, keyword, pattern) in enumerate(rules)])
    docs = keyed_text(df, id_col, text_col).select("doc_id", spaced_words(F.coalesce("text", F.lit(""))).alias("norm"))
    norm = F.col("norm")
    n_words = F.greatest(_blanks(norm) - 1, F.lit(0)).cast("long")
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE.items():
        size, spaced = len(phrase.split()), F.lit(f" {phrase} ")
        has = F.contains(norm, spaced)
        counts.append(F.when(has, F.regexp_count(norm, F.lit(f" {phrase}(?= )"))).otherwise(0).cast("long"))
        firsts.append(F.when(has, _blanks(F.substring_index(norm, f" {phrase} ", 1))))
        lasts.append(F.when(has, F.col("n_words") - _blanks(F.substring_index(norm, f" {phrase} ", -1)) - size))
        labels.append(F.when(has, F.lit(label)))
    out = docs.withColumn("n_words", n_words).withColumn("gated", _gated(norm, table, {x[2] for x in rules})).select(
        "doc_id",
        "n_words",
        sum(counts[1:], counts[0]).alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*labels))).alias("base"),
        F.when(F.size("gated") > 0, _kept(_detections(norm, F.col("gated")))).alias("kept"),
    )
    mine = F.coalesce(F.col("kept.labels"), F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", mine)), ",").alias("labels"),
        (F.coalesce(F.col("kept.best"), F.lit(0)) / F.lit(float(TOP))).alias("score"),
        F.coalesce(F.col("kept.n"), F.lit(0)).cast("long").alias("n_detections"),
    )
