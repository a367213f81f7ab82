"""License mentions: ordered regular expressions over normalised words, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lariat.llm.common import text_key

#: A word is a run of other characters than these, once A to Z are lower-cased: ASCII without digits and letters.
#: Each is named by itself, as ranges in a class make the regular expressions ten times as slow.
BREAKS = "".join(f"\\x{c:02x}" for c in range(128) if not chr(c).isalnum())
WORD, GAP = f"[^{BREAKS}]+", f"[{BREAKS}]+"

#: Label, keyword and words of the base phrases.
BASE = (("mit", "mit", "under the mit license"), ("apache-2", "apache", "apache license version 2"), ("cc-by-nc", "cc", "cc by nc"))

#: Label, keyword (a word that every mention has), and the name as a regular expression of words.
FAMILIES = (
    ("mit", "mit", "mit(?: x11)?"),
    ("mit", "expat", "expat"),
    ("x11", "x11", "x11"),
    ("apache-1.1", "apache", "apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("apache-2", "apache", "apache(?: software)?(?: license)?(?: version)? 2(?: 0)?"),
    ("apache", "apache", "apache(?: software)?"),
    ("gpl-1", "gnu", "gnu general public license(?: version| v)? 1(?: 0)?"),
    ("gpl-2", "gnu", "gnu general public license(?: version| v)? 2(?: 0)?"),
    ("gpl-3", "gnu", "gnu general public license(?: version| v)? 3(?: 0)?"),
    ("gpl", "gnu", "gnu general public"),
    ("lgpl-2.1", "gnu", "gnu (?:lesser|library) general public license(?: version| v)? 2 1"),
    ("lgpl-3", "gnu", "gnu (?:lesser|library) general public license(?: version| v)? 3(?: 0)?"),
    ("lgpl", "gnu", "gnu (?:lesser|library) general public"),
    ("agpl-3", "gnu", "gnu affero general public license(?: version| v)? 3(?: 0)?"),
    ("agpl", "gnu", "gnu affero general public"),
    ("gfdl", "gnu", "gnu free documentation"),
    ("gpl", "gpl", "gpl(?: v?[123](?: 0)?)?"),
    ("lgpl", "lgpl", "lgpl(?: v?[23](?: [01])?)?"),
    ("agpl", "agpl", "agpl(?: v?[13](?: 0)?)?"),
    ("bsd-2", "bsd", "(?:2 clause|two clause|simplified|freebsd) bsd"),
    ("bsd-3", "bsd", "(?:3 clause|three clause|new|modified|revised) bsd"),
    ("bsd-4", "bsd", "(?:4 clause|four clause|original) bsd"),
    ("bsd", "bsd", "bsd(?: [234] clause)?"),
    ("0bsd", "0bsd", "0bsd"),
    ("mpl-1.1", "mozilla", "mozilla public(?: license)?(?: version| v)? 1 1"),
    ("mpl-2", "mozilla", "mozilla public(?: license)?(?: version| v)? 2(?: 0)?"),
    ("mpl", "mozilla", "mozilla public"),
    ("mpl", "mpl", "mpl(?: v?[12](?: [01])?)?"),
    ("epl-1", "eclipse", "eclipse public(?: license)?(?: version| v)? 1(?: 0)?"),
    ("epl-2", "eclipse", "eclipse public(?: license)?(?: version| v)? 2(?: 0)?"),
    ("epl", "eclipse", "eclipse public"),
    ("cddl", "cddl", "cddl(?: v?1 [01])?"),
    ("cddl", "distribution", "common development and distribution"),
    ("cpl", "common", "common public"),
    ("artistic-2", "artistic", "artistic(?: license)?(?: version| v)? 2(?: 0)?"),
    ("artistic", "artistic", "artistic"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("boost-1", "boost", "boost(?: software)?"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("python-2", "python", "python(?: software foundation)?"),
    ("postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl", "openssl"),
    ("php-3", "php", "php(?: license)?(?: version| v)? 3(?: 0[0-9]?)?"),
    ("ms-pl", "microsoft", "microsoft public"),
    ("ms-rl", "microsoft", "microsoft reciprocal"),
    ("eupl", "eupl", "eupl(?: v?1 [0-9])?"),
    ("ofl-1.1", "ofl", "(?:sil )?ofl(?: 1 1)?"),
    ("ofl-1.1", "font", "(?:sil )?open font"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", "cc", "cc by(?: [1234](?: [05])?)?"),
    ("cc-by-sa", "cc", "cc by sa(?: [1234](?: [05])?)?"),
    ("cc-by-nd", "cc", "cc by nd(?: [1234](?: [05])?)?"),
    ("cc-by-nc", "cc", "cc by nc(?: [1234](?: [05])?)?"),
    ("cc-by-nc-sa", "cc", "cc by nc sa(?: [1234](?: [05])?)?"),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?: [1234](?: [05])?)?"),
    ("cc-by", "creative", "creative commons attribution"),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike"),
    ("cc-by-nd", "creative", "creative commons attribution no ?deriv(?:s|atives)"),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial"),
    ("cc-by-nc-sa", "creative", "creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "creative", "creative commons attribution non ?commercial no ?deriv(?:s|atives)"),
    ("cc", "creative", "creative commons"),
    ("odbl", "odbl", "odbl(?: 1 0)?"),
    ("odbl", "database", "open database"),
    ("openrail", "openrail", "openrail(?: m)?"),
    ("proprietary", "proprietary", "proprietary"),
    ("public-domain", "domain", "public domain"),
)

#: Priority (less is stronger), weight, a word that every match has besides the name's keyword, and how a name is put.
SHAPES = (
    (1, 1.0, "under", "{verb} under (?:the |an? )?(?:terms of )?(?:the |an? )?{name}(?: license)?(?: version [0-9]+(?: [0-9]+)?)?"),
    (1, 0.95, "subject", "subject to (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}(?: license)?"),
    (1, 0.95, "spdx", "spdx license identifier {name}"),
    (2, 0.8, "under", "under (?:the |an? )?(?:terms of )?(?:the |an? )?{name}(?: license)?"),
    (2, 0.8, "by", "(?:covered|governed|protected|bound) by (?:the |an? )?(?:terms of )?(?:the |an? )?{name}(?: license)?"),
    (2, 0.7, "license", "{name} license(?: agreement)?(?: version [0-9]+(?: [0-9]+)?)?"),
)
VERB = "(?:licensed|released|distributed|available|published|dual licensed|provided|redistributed|made available|covered)"

#: Sentences of license texts and file headers: label, two words that every match has, expression, priority, weight.
NOTICES = (
    ("mit", "hereby obtaining", "permission is hereby granted free of charge to any person obtaining a copy", 1, 0.9),
    ("mit", "deal restriction", "to deal in (?:the|this) software without restriction", 1, 0.8),
    ("mit", "substantial portions", "this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions", 1, 0.8),
    ("x11", "contained notice", "except as contained in this notice the names? of", 1, 0.7),
    ("hpnd", "sell documentation", "permission to use copy modify (?:and )?distribute and sell this software and its documentation", 1, 0.9),
    ("postgresql", "fee agreement", "for any purpose without fee and without a written agreement is hereby granted", 1, 0.9),
    ("isc", "permission purpose", "permission to use copy modify and or distribute this software for any purpose", 1, 0.9),
    ("isc", "fee appear", "with or without fee is hereby granted provided that the above copyright notice and this permission notice appear", 1, 0.9),
    ("boost-1", "organization obtaining", "free of charge to any person or organization obtaining a copy of the software", 1, 0.9),
    ("unlicense", "unencumbered domain", "free and unencumbered software released into the public domain", 1, 1.0),
    ("zlib", "origin misrepresented", "the origin of this software must not be misrepresented", 1, 0.9),
    ("zlib", "altered marked", "altered source versions must be plainly marked", 1, 0.9),
    ("json", "good evil", "the software shall be used for good not evil", 1, 0.9),
    ("beerware", "beer return", "you can buy me a beer in return", 1, 0.8),
    ("wtfpl", "fuck want", "do what the fuck you want to(?: public license)?", 1, 0.9),
    ("bsd", "redistribution binary", "redistribution and use in source and binary forms with or without modification are permitted", 1, 0.9),
    ("bsd", "retain conditions", "redistributions of source code must retain the above copyright notice this list of conditions", 1, 0.8),
    ("bsd", "binary reproduce", "redistributions in binary form must reproduce the above copyright notice", 1, 0.8),
    ("bsd-3", "neither endorse", "neither the names? of(?: [^ ]+){1,12} may be used to endorse or promote products", 1, 0.9),
    ("bsd-4", "advertising mentioning", "all advertising materials mentioning features or use of this software must display", 1, 0.9),
    ("bsd", "contributors is", "this software is provided by(?: [^ ]+){1,6} and contributors as is", 1, 0.7),
    ("bsd", "governed bsd", "use of this source code is governed by a bsd style license", 1, 0.9),
    ("bsd", "bsd style", "bsd style licen[cs]e", 2, 0.7),
    ("permissive", "warranty kind", "the software is provided as is without warranty of any kind", 3, 0.4),
    ("permissive", "liable event", "in no event shall the (?:authors?|copyright holders?)(?: [^ ]+){1,6} be liable", 3, 0.4),
    ("apache", "asf contributor", "licensed to the apache software foundation asf under one or more contributor license agreements", 1, 1.0),
    ("apache-2", "except compliance", "you may not use this file except in compliance with the license", 1, 0.8),
    ("apache-2", "applicable writing", "unless required by applicable law or agreed to in writing software distributed under the license", 1, 0.9),
    ("apache-2", "grant patent", "grant of patent license subject to the terms and conditions of this license", 1, 0.9),
    ("apache-1.1", "product apache", "this product includes software developed by the apache (?:software foundation|group)", 1, 0.8),
    ("gpl", "redistribute modify", "you can redistribute it and or modify it under the terms", 1, 0.8),
    ("gpl", "hope useful", "(?:program|software|file|code) is distributed in the hope that it will be useful but without any warranty", 1, 0.7),
    ("lgpl", "hope library", "this library is distributed in the hope that it will be useful but without any warranty", 1, 0.8),
    ("lgpl", "library redistribute", "this library is free software you can redistribute it", 1, 0.9),
    ("gpl", "received general", "you should have received a copy of the gnu general public license", 1, 0.9),
    ("lgpl", "received lesser", "you should have received a copy of the gnu lesser general public license", 1, 0.9),
    ("lgpl", "received library", "you should have received a copy of the gnu library general public license", 1, 0.9),
    ("agpl", "received affero", "you should have received a copy of the gnu affero general public license", 1, 0.9),
    ("gpl-2", "either later", "either version 2 of the license or at your option any later version", 2, 0.7),
    ("gpl-3", "either later", "either version 3 of the license or at your option any later version", 2, 0.7),
    ("lgpl-2.1", "either later", "either version 2 1 of the license or at your option any later version", 2, 0.8),
    ("gpl", "franklin 51", "51 franklin (?:street|st)", 3, 0.5),
    ("gpl", "temple place", "59 temple place", 3, 0.5),
    ("gpl", "everyone verbatim", "everyone is permitted to copy and distribute verbatim copies of this license document", 1, 0.8),
    ("gpl-exception", "special exception", "as a special exception (?:to the|the copyright holders|you may|if you)", 2, 0.6),
    ("gpl-exception", "classpath exception", "classpath exception", 2, 0.7),
    ("gpl-exception", "runtime exception", "gcc runtime library exception", 2, 0.7),
    ("gfdl", "permission documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 1, 1.0),
    ("gfdl", "invariant cover", "with no invariant sections(?: with)? no front cover texts", 1, 0.8),
    ("mpl-2", "form mozilla", "this source code form is subject to the terms of the mozilla public license", 1, 1.0),
    ("mpl-2", "mpl obtain", "if a copy of the mpl was not distributed with this file you can obtain one", 1, 0.9),
    ("mpl-2", "incompatible secondary", "incompatible with secondary licenses", 2, 0.6),
    ("mpl-1.1", "contents mozilla", "the contents of this file are subject to the mozilla public license version 1 1", 1, 1.0),
    ("mpl-1.1", "alternatively contents", "alternatively the contents of this file may be used under the terms of", 2, 0.6),
    ("epl", "accompanying eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license", 1, 1.0),
    ("cddl", "contents development", "the contents of this file are subject to the terms of the common development and distribution license", 1, 1.0),
    ("perl", "terms perl", "under the same terms as perl(?: itself)?", 1, 0.9),
    ("ruby", "either bsdl", "under either the terms of the 2 clause bsdl", 1, 0.9),
    ("lppl", "conditions latex", "modified under the conditions of the latex project public license", 1, 1.0),
    ("openssl", "product openssl", "this product includes software developed by the openssl project", 1, 0.8),
    ("openssl", "cryptographic young", "cryptographic software written by eric young", 1, 0.7),
    ("python-2", "between psf", "this license agreement is between the python software foundation psf", 1, 1.0),
    ("ofl-1.1", "font sil", "this font software is licensed under the sil open font license", 1, 1.0),
    ("ofl-1.1", "reserved font", "with reserved font names?", 2, 0.7),
    ("cc0", "extent waived", "to the extent possible under law(?: [^ ]+){1,20} waived all copyright", 1, 0.9),
    ("cc-by", "licensed attribution", "this work is licensed under a creative commons attribution(?: [1234] [05])?(?: international)? license", 1, 1.0),
    ("public-domain", "domain public", "(?:released|dedicated|placed) (?:in ?to|to|in) the public domain", 1, 0.9),
    ("public-domain", "domain is", "this (?:file|code|work|software|document) is (?:hereby )?in the public domain", 1, 0.9),
    ("public-domain", "title 105", "title 17 section 105 of the united states code", 1, 0.8),
    ("public-domain", "government work", "(?:is a )?work of the (?:us|u s|united states) government", 2, 0.6),
    ("public-domain", "subject protection", "not subject to copyright protection", 2, 0.7),
    ("sspl", "offering service", "offering the functionality of the program (?:or a modified version )?as a service", 2, 0.6),
    ("commons-clause", "clause condition", "commons clause (?:license )?condition", 1, 0.9),
    ("commons-clause", "grant sell", "does not (?:include and the license does not )?grant to you the right to sell the software", 1, 0.9),
    ("busl", "change license", "change date(?: [^ ]+){1,12} change license", 1, 0.8),
    ("cla", "contributor agreement", "contributor license agreement", 3, 0.3),
    ("dco", "certificate origin", "developers?(?: s)? certificate of origin", 3, 0.3),
    ("go-patents", "additional grant", "additional ip rights grant patents", 1, 0.7),
)

#: Addresses of license texts, in the same form.
ADDRESSES = (
    ("mit", "opensource mit", "opensource org licenses? mit(?: license)?(?: php)?", 1, 0.9),
    ("mit", "choosealicense mit", "choosealicense com licenses mit", 1, 0.9),
    ("apache-2", "apache licenses", "apache org licenses license 2 0(?: txt| html)?", 1, 1.0),
    ("apache-1.1", "apache licenses", "apache org licenses license 1 1", 1, 1.0),
    ("apache-2", "opensource apache", "opensource org licenses? apache 2 0", 1, 0.9),
    ("gpl", "gnu gpl", "gnu org (?:copyleft|licenses) gpl(?: [123] 0)?(?: html| txt)?", 1, 0.9),
    ("gpl-2", "gnu old", "gnu org licenses old licenses gpl 2 0(?: html| txt)?", 1, 0.9),
    ("lgpl", "gnu lgpl", "gnu org (?:copyleft|licenses) lgpl(?: [23] [01])?(?: html| txt)?", 1, 0.9),
    ("lgpl-2.1", "gnu old", "gnu org licenses old licenses lgpl 2 [01](?: html| txt)?", 1, 0.9),
    ("agpl", "gnu agpl", "gnu org licenses agpl(?: 3 0)?(?: html| txt)?", 1, 0.9),
    ("gfdl", "gnu fdl", "gnu org (?:copyleft|licenses) fdl(?: 1 [123])?(?: html| txt)?", 1, 0.9),
    ("gpl", "opensource gpl", "opensource org licenses? gpl (?:license|[23] 0)", 1, 0.9),
    ("lgpl", "opensource lgpl", "opensource org licenses? lgpl (?:license|[23] [01])", 1, 0.9),
    ("agpl", "opensource agpl", "opensource org licenses? agpl (?:3 0|v3)", 1, 0.9),
    ("bsd", "opensource bsd", "opensource org licenses? bsd (?:license|[23] clause)(?: php)?", 1, 0.9),
    ("bsd-2", "freebsd copyright", "freebsd org copyright freebsd license", 1, 0.9),
    ("isc", "opensource isc", "opensource org licenses? isc(?: license)?", 1, 0.9),
    ("mpl-2", "mozilla mpl", "mozilla org (?:en us )?mpl 2 0", 1, 0.9),
    ("mpl-1.1", "mozilla mpl", "mozilla org mpl mpl 1 1", 1, 0.9),
    ("mpl", "opensource mpl", "opensource org licenses? mpl (?:1 [01]|2 0)", 1, 0.9),
    ("epl-1", "eclipse epl", "eclipse org (?:org )?(?:documents|legal) epl v ?1 ?0", 1, 0.9),
    ("epl-2", "eclipse epl", "eclipse org (?:org )?(?:documents |legal )+epl (?:2 0|v20|v2 0)", 1, 0.9),
    ("edl", "eclipse edl", "eclipse org (?:org )?(?:documents|legal) edl v10", 1, 0.9),
    ("cddl", "opensource org", "opensource org licenses? cddl ?1(?: 0)?", 1, 0.9),
    ("artistic", "opensource artistic", "opensource org licenses? artistic license(?: [12] 0)?", 1, 0.9),
    ("artistic-2", "perlfoundation artistic", "perlfoundation org artistic license 2 0", 1, 0.9),
    ("boost-1", "boost license", "boost org (?:users )?license(?: 1 0 txt| html)", 1, 0.9),
    ("unlicense", "unlicense org", "unlicense org", 1, 0.9),
    ("wtfpl", "wtfpl net", "wtfpl net", 1, 0.9),
    ("php-3", "php license", "php net license(?: 3 0[01]? txt)?", 1, 0.9),
    ("openssl", "openssl license", "openssl org source license(?: html)?", 1, 0.9),
    ("ofl-1.1", "sil ofl", "(?:scripts )?sil org ofl", 1, 0.9),
    ("cc0", "creativecommons zero", "creativecommons org publicdomain zero 1 0", 1, 1.0),
    ("public-domain", "creativecommons mark", "creativecommons org publicdomain mark 1 0", 1, 1.0),
    ("cc-by", "creativecommons by", "creativecommons org licenses by [1234] [05]", 1, 1.0),
    ("cc-by-sa", "creativecommons sa", "creativecommons org licenses by sa [1234] [05]", 1, 1.0),
    ("cc-by-nd", "creativecommons nd", "creativecommons org licenses by nd [1234] [05]", 1, 1.0),
    ("cc-by-nc", "creativecommons nc", "creativecommons org licenses by nc [1234] [05]", 1, 1.0),
    ("cc-by-nc-sa", "creativecommons nc", "creativecommons org licenses by nc sa [1234] [05]", 1, 1.0),
    ("cc-by-nc-nd", "creativecommons nc", "creativecommons org licenses by nc nd [1234] [05]", 1, 1.0),
    ("odbl", "opendatacommons odbl", "opendatacommons org licenses odbl", 1, 0.9),
    ("odc-by", "opendatacommons by", "opendatacommons org licenses by", 1, 0.9),
    ("pddl", "opendatacommons pddl", "opendatacommons org licenses pddl", 1, 0.9),
    ("ogl", "nationalarchives open", "nationalarchives gov uk doc open government licence", 1, 0.9),
    ("eupl", "joinup europa", "joinup ec europa eu", 3, 0.4),
    ("unicode", "unicode org", "unicode org (?:copyright|terms of use)(?: html)?", 1, 0.8),
)

#: Names that stand for themselves, SPDX expressions and file marks.
NAMES = (
    ("gpl", "gplv2 gplv2", "gplv2", 2, 0.8),
    ("gpl", "gplv3 gplv3", "gplv3", 2, 0.8),
    ("lgpl", "lgplv2 lgplv2", "lgplv2(?: 1)?", 2, 0.8),
    ("lgpl", "lgplv3 lgplv3", "lgplv3", 2, 0.8),
    ("agpl", "agplv3 agplv3", "agplv3", 2, 0.8),
    ("gpl-2", "gpl 2", "gpl 2 0 (?:only|or later)", 2, 0.9),
    ("gpl-3", "gpl 3", "gpl 3 0 (?:only|or later)", 2, 0.9),
    ("lgpl-2.1", "lgpl 2", "lgpl 2 1 (?:only|or later)", 2, 0.9),
    ("lgpl-3", "lgpl 3", "lgpl 3 0 (?:only|or later)", 2, 0.9),
    ("agpl-3", "agpl 3", "agpl 3 0 (?:only|or later)", 2, 0.9),
    ("mit-or-apache", "mit apache", "mit (?:or|and) apache 2 0", 1, 0.9),
    ("mit-or-apache", "apache mit", "apache 2 0 (?:or|and) mit", 1, 0.9),
    ("mit-or-apache", "either apache", "licensed under either of(?: the)? apache license", 1, 0.9),
    ("spdx", "spdx identifier", "spdx license identifier", 3, 0.5),
    ("copyright", "spdx filecopyrighttext", "spdx filecopyrighttext", 3, 0.4),
    ("0bsd", "zero bsd", "(?:bsd zero clause|zero clause bsd)(?: license)?", 2, 0.9),
    ("bsd-3", "bsd clear", "bsd 3 clause clear", 2, 0.9),
    ("ipl", "ibm public", "ibm public license", 2, 0.9),
    ("edl", "eclipse distribution", "eclipse distribution license", 2, 0.9),
    ("lppl", "latex project", "latex project public license", 2, 0.9),
    ("lppl", "lppl lppl", "lppl(?: 1 3c?)?", 2, 0.7),
    ("osl", "open software", "open software license(?: version| v)? [123] 0", 2, 0.9),
    ("afl", "academic free", "academic free license", 2, 0.9),
    ("qpl", "q public", "q public license", 2, 0.9),
    ("ncsa", "illinois open", "university of illinois(?: ncsa)? open source license", 2, 0.9),
    ("w3c", "w3c license", "w3c (?:software(?: notice and)?|document) license", 2, 0.9),
    ("unicode", "unicode agreement", "unicode(?: inc)? license agreement", 2, 0.9),
    ("nasa", "nasa agreement", "nasa open source agreement", 2, 0.9),
    ("eupl", "european union", "european union public licen[cs]e", 2, 0.9),
    ("ruby", "ruby license", "ruby(?: s)? license", 2, 0.8),
    ("vim", "vim license", "vim license", 2, 0.8),
    ("zend", "zend license", "zend (?:engine )?license", 2, 0.8),
    ("beerware", "beer ware", "beer ware license", 2, 0.9),
    ("sspl", "server side", "server side public license", 2, 0.9),
    ("sspl", "sspl sspl", "sspl(?: 1 0)?", 2, 0.8),
    ("busl", "business source", "business source license(?: 1 1)?", 2, 0.9),
    ("busl", "busl busl", "busl(?: 1 1)?", 2, 0.8),
    ("elastic", "elastic license", "elastic license(?: 2 0)?", 2, 0.9),
    ("confluent", "confluent community", "confluent community license", 2, 0.9),
    ("rsal", "redis available", "redis source available license", 2, 0.9),
    ("polyform", "polyform license", "polyform (?:noncommercial|small business|shield|strict|free trial|internal use|perimeter) license", 2, 0.9),
    ("prosperity", "prosperity license", "prosperity public license", 2, 0.9),
    ("parity", "parity license", "parity public license", 2, 0.9),
    ("hippocratic", "hippocratic license", "hippocratic license", 2, 0.9),
    ("llama", "llama community", "llama(?: 2| 3)?(?: [0-9])? community license(?: agreement)?", 2, 0.9),
    ("gemma", "gemma terms", "gemma terms of use", 2, 0.9),
    ("openrail", "bigscience rail", "bigscience (?:bloom |open )?rail", 2, 0.9),
    ("openrail", "creativeml m", "creativeml open ?rail m", 2, 0.9),
    ("odc-by", "commons data", "open data commons attribution(?: license)?", 2, 0.9),
    ("odbl", "commons database", "open data commons open database(?: license)?", 2, 0.9),
    ("pddl", "commons dedication", "open data commons public domain dedication", 2, 0.9),
    ("cdla", "community data", "community data license agreement (?:permissive|sharing)", 2, 0.9),
    ("cdla", "cdla cdla", "cdla (?:permissive|sharing)(?: [12] 0)?", 2, 0.9),
    ("ogl", "open government", "open government licen[cs]e", 2, 0.9),
    ("ubuntu-font", "ubuntu font", "ubuntu font licen[cs]e", 2, 0.9),
    ("bitstream-vera", "bitstream vera", "bitstream vera (?:fonts? )?copyright", 2, 0.8),
    ("public-domain", "domain dedication", "public domain dedication", 2, 0.8),
    ("cc-by", "cc by", "cc by(?: [1234](?: [05])?)?", 3, 0.6),
    ("cc-by-sa", "cc sa", "cc by sa(?: [1234](?: [05])?)?", 2, 0.8),
    ("cc-by-nd", "cc nd", "cc by nd(?: [1234](?: [05])?)?", 2, 0.8),
    ("cc-by-nc-sa", "cc nc", "cc by nc sa(?: [1234](?: [05])?)?", 2, 0.8),
    ("cc-by-nc-nd", "cc nc", "cc by nc nd(?: [1234](?: [05])?)?", 2, 0.8),
    ("cc0", "cc0 cc0", "cc0", 2, 0.8),
    ("cc", "some reserved", "some rights reserved", 3, 0.4),
)

#: Marks of ownership and references to license files.
OWNERSHIP = (
    ("all-rights-reserved", "rights reserved", "all rights (?:are )?reserved", 3, 0.5),
    ("public-domain", "rights reserved", "no rights reserved", 2, 0.7),
    ("copyright", "copyright copyright", "copyright(?: c)?(?: (?:19|20)[0-9][0-9])+", 3, 0.4),
    ("proprietary", "proprietary confidential", "proprietary and confidential", 2, 0.8),
    ("proprietary", "confidential proprietary", "confidential and proprietary information", 2, 0.8),
    ("proprietary", "unauthorized prohibited", "unauthorized copying of this file via any medium is strictly prohibited", 1, 0.9),
    ("proprietary", "part reproduced", "no part of this (?:publication|book|document|work) may be reproduced", 2, 0.7),
    ("proprietary", "reproduced without", "may not be (?:copied )?(?:or )?reproduced (?:distributed )?(?:or transmitted )?without", 2, 0.6),
    ("proprietary", "internal only", "for internal use only", 3, 0.4),
    ("proprietary", "evaluation only", "(?:for )?evaluation purposes only", 3, 0.4),
    ("proprietary", "trade secrets", "trade secrets of", 2, 0.6),
    ("proprietary", "materials ibm", "licensed materials property of ibm", 1, 0.9),
    ("proprietary", "microsoft terms", "microsoft software license terms", 1, 0.9),
    ("eula", "end agreement", "end user license agreement", 2, 0.6),
    ("license-file", "see license", "see (?:the )?license(?: txt| md)?(?: file)?", 3, 0.3),
    ("license-file", "see copying", "see (?:the )?(?:file )?copying(?: txt| md)?(?: file)? for", 3, 0.3),
    ("license-file", "found file", "license that can be found in the license file", 2, 0.4),
    ("license-file", "same license", "distributed under the same license as", 3, 0.4),
    ("license-file", "license information", "for license information(?: please)? see", 3, 0.3),
    ("non-commercial", "non use", "non commercial use only", 2, 0.6),
    ("non-commercial", "noncommercial purposes", "for (?:personal and |educational and )?noncommercial purposes(?: only)?", 2, 0.6),
    ("non-commercial", "research only", "for (?:academic )?research (?:purposes|use) only", 2, 0.6),
)


@dataclass(frozen=True)
class Rule:
    number: int
    label: str
    keyword: str
    second: str
    pattern: str
    priority: int
    weight: float
    base: bool


def rules() -> list[Rule]:
    """The base phrases, then every shape of every family's name, then sentences, addresses, names and marks, in this order.

    keyword and second are words that every match of the rule has; they may be the same.
    """
    made: list[tuple] = [(label, key, key, phrase, 1, 1.0, True) for label, key, phrase in BASE]
    made += [(label, key, word, shape.format(verb=VERB, name=name), priority, weight, False) for label, key, name in FAMILIES for priority, weight, word, shape in SHAPES]
    made += [(label, *words.split(), pattern, priority, weight, False) for table in (NOTICES, ADDRESSES, NAMES, OWNERSHIP) for label, words, pattern, priority, weight in table]
    return [Rule(n, label, key, word, f" {pattern}(?= )", priority, weight, base) for n, (label, key, word, pattern, priority, weight, base) in enumerate(made)]


def _found(text: Column) -> Column:
    """The words of a text, in order."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.regexp_extract_all(F.translate(text, upper, lower), F.lit(WORD), F.lit(0))


def _known(found: Column) -> Column:
    """Those of the words that rules ask for, each once."""
    return F.array_intersect(found, F.array(*(F.lit(w) for w in sorted({w for r in rules() for w in (r.keyword, r.second)}))))


def _gate(text: Column) -> Column:
    """Whether a rule can match: the text has some rule's two words, as words."""
    pairs = F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in sorted({(r.keyword, r.second) for r in rules()})))
    both = lambda known: F.exists(pairs, lambda p: F.array_contains(known, F.get(p, F.lit(0))) & F.array_contains(known, F.get(p, F.lit(1))))
    return F.exists(F.array(_known(_found(text))), lambda known: (F.size(known) > 0) & both(known))  # so the words are found once


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _spaced(found: Column) -> Column:
    """The words in order, each behind one space, and a space at the end."""
    return F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" "))


def detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tk, label, rule, priority, weight, base, begin, end, kept): the places where rules match, in words from 0, end excluded.

    A rule is tried on a text that has its two words, which all its matches have. A detection is
    dropped (kept is false) if one of a rule of the same or a stronger priority contains its place;
    of equal places the stronger and then the earlier rule's stays. Base phrases are never dropped.
    Rows that agree in id and text give each place once; null texts have none.
    """
    made = rules()
    shape = "rule int, label string, keyword string, second string, pattern string, priority int, weight double, base boolean"
    held = docs.sparkSession.createDataFrame([(r.number, r.label, r.keyword, r.second, r.pattern, r.priority, r.weight, r.base) for r in made], shape)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = _found(F.col("text"))
    gated = own.where(_gate(F.col("text"))).select("id", text_key().alias("tk"), _known(found).alias("known"), _spaced(found).alias("words")).dropDuplicates(["id", "tk"])
    tried = gated.withColumn("keyword", F.explode("known")).join(F.broadcast(held), "keyword")  # as many rules as the tables above give
    tried = tried.where(F.array_contains("known", F.col("second"))).where(F.expr("words rlike pattern"))
    parts, found = F.call_function("split", F.col("words"), F.col("pattern"), F.lit(-1)), F.call_function("regexp_extract_all", F.col("words"), F.col("pattern"), F.lit(0))
    places = tried.select("id", "tk", "label", "rule", "priority", "weight", "base", F.posexplode(F.arrays_zip(parts.alias("part"), found.alias("match"))).alias("at", "x"))
    before = Window.partitionBy("id", "tk", "rule").orderBy("at")
    step = _spaces(F.col("x.part")) + F.coalesce(_spaces(F.col("x.match")), F.lit(0))
    size = _spaces(F.col("x.match"))
    places = places.repartition("id", "tk").withColumn("done", F.sum(step).over(before).cast("bigint"))
    places = places.where(F.col("x.match").isNotNull()).select("id", "tk", "label", "rule", "priority", "weight", "base", (F.col("done") - size).alias("begin"), F.col("done").alias("end"))
    order = Window.partitionBy("id", "tk").orderBy("begin", F.desc("end"), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.lit(False)
    for p in sorted({r.priority for r in made}):
        reach = F.max(F.when(F.col("priority") <= p, F.col("end"))).over(order)
        inside = inside | ((F.col("priority") == p) & (F.coalesce(reach, F.lit(-1)) >= F.col("end")))
    return places.withColumn("kept", F.col("base") | ~inside)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row, of whole texts.

    n_base, first_word and last_word are of the base phrases' places; labels are those of the
    detections that stay, base ones among them, distinct, sorted and joined by commas; score is
    the greatest weight of these, 0 without any. A null text counts as empty. Null ids, repeated
    rows and further columns do no harm.
    """
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = own.select("id", text_key().alias("tk"), F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("n_words"))
    base, kept = F.col("base"), F.col("kept")
    joined = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    found = detections(docs, id_col, text_col).groupBy(F.col("id").alias("f_id"), F.col("tk").alias("f_tk")).agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("begin"))).alias("first_word"), F.max(F.when(base, F.col("begin"))).alias("last_word"),
        joined(base).alias("base_labels"), joined(kept).alias("labels"), F.max(F.when(kept, F.col("weight"))).alias("score"),
    )
    out = own.join(found, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("tk") == F.col("f_tk")), "left")
    return out.select(
        "id", "n_words", F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
