"""Rules of the license scan, as patterns over a text's lower-cased words joined by single spaces.

A rule is (label, keyword, pattern, priority): it is tried where its keyword stands, and where detections overlap, higher
priority wins. SINGLE, UNVERSIONED and BODY are written one by one; the names with versions are used in four forms, and Creative
Commons elements and SPDX identifiers are combined with versions by rule.
"""

from __future__ import annotations

#: label, keyword, name as it is written in running text
NAMES = [
    ("apache-1.0", "apache", r"apache (?:software )?license (?:version )?1 0"),
    ("apache-1.1", "apache", r"apache (?:software )?license (?:version )?1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?license (?:version )?2(?: 0)?"),
    ("mit", "mit license", r"mit license"),
    ("mit-0", "mit no attribution", r"mit no attribution(?: license)?"),
    ("bsd-2-clause", "bsd", r"(?:2 clause|two clause|simplified) bsd(?: license)?|bsd 2 clause(?: license)?"),
    ("bsd-3-clause", "bsd", r"(?:3 clause|three clause|new|modified|revised) bsd(?: license)?|bsd 3 clause(?: license)?"),
    ("bsd-4-clause", "bsd", r"(?:4 clause|four clause|original) bsd(?: license)?|bsd 4 clause(?: license)?"),
    ("0bsd", "bsd", r"(?:zero clause|0 clause) bsd(?: license)?|bsd zero clause(?: license)?"),
    ("gpl-1.0", "general public license", r"(?:gnu )?general public license (?:as published by the free software foundation )?(?:either )?version 1(?: 0)?"),
    ("gpl-2.0", "general public license", r"(?<!lesser )(?<!affero )(?<!library )general public license (?:as published by the free software foundation )?(?:either )?version 2(?: 0)?"),
    ("gpl-3.0", "general public license", r"(?<!lesser )(?<!affero )general public license (?:as published by the free software foundation )?(?:either )?version 3(?: 0)?"),
    ("lgpl-2.0", "library general public license", r"library general public license (?:version )?2(?: 0)?"),
    ("lgpl-2.1", "lesser general public license", r"lesser general public license (?:version )?2 1"),
    ("lgpl-3.0", "lesser general public license", r"lesser general public license (?:version )?3(?: 0)?"),
    ("agpl-3.0", "affero general public license", r"affero general public license (?:version )?3(?: 0)?"),
    ("gfdl-1.1", "free documentation license", r"free documentation license (?:version )?1 1"),
    ("gfdl-1.2", "free documentation license", r"free documentation license (?:version )?1 2"),
    ("gfdl-1.3", "free documentation license", r"free documentation license (?:version )?1 3"),
    ("mpl-1.1", "mozilla public license", r"mozilla public license (?:version )?1 1"),
    ("mpl-2.0", "mozilla public license", r"mozilla public license (?:version )?2(?: 0)?"),
    ("epl-1.0", "eclipse public license", r"eclipse public license (?:version |v )?1(?: 0)?"),
    ("epl-2.0", "eclipse public license", r"eclipse public license (?:version |v )?2(?: 0)?"),
    ("eupl-1.1", "european union public", r"european union public licen[cs]e (?:version |v )?1 1"),
    ("eupl-1.2", "european union public", r"european union public licen[cs]e (?:version |v )?1 2"),
    ("cddl-1.0", "common development and distribution", r"common development and distribution license (?:version )?1 0"),
    ("cddl-1.1", "common development and distribution", r"common development and distribution license (?:version )?1 1"),
    ("cpl-1.0", "common public license", r"common public license (?:version )?1 0"),
    ("artistic-1.0", "artistic license", r"artistic license (?:version )?1 0"),
    ("artistic-2.0", "artistic license", r"artistic license (?:version )?2 0"),
    ("bsl-1.0", "boost software license", r"boost software license(?: version 1 0)?"),
    ("busl-1.1", "business source license", r"business source license(?: (?:version )?1 1)?"),
    ("isc", "isc license", r"isc license"),
    ("zlib", "zlib", r"zlib(?: libpng)? license"),
    ("wtfpl", "want to public", r"do what the (?:fuck|f) you want to public license"),
    ("unlicense", "unlicense", r"the unlicense"),
    ("ofl-1.1", "open font license", r"(?:sil )?open font license(?: version)?(?: 1 1)?"),
    ("odbl-1.0", "database license", r"open (?:data commons )?database license(?: v1 0| 1 0)?"),
    ("odc-by-1.0", "open data commons attribution", r"open data commons attribution license(?: v1 0)?"),
    ("pddl-1.0", "public domain dedication and license", r"public domain dedication and license(?: v1 0)?"),
    ("ms-pl", "microsoft public license", r"microsoft public license"),
    ("ms-rl", "microsoft reciprocal license", r"microsoft reciprocal license"),
    ("psf-2.0", "python software foundation", r"python software foundation license(?: version 2)?"),
    ("php-3.01", "php license", r"php license(?: version)? 3 01"),
    ("ruby", "ruby license", r"ruby license"),
    ("sspl-1.0", "server side public license", r"server side public license(?: version 1)?"),
    ("elastic-2.0", "elastic license", r"elastic license(?: 2 0)?"),
    ("upl-1.0", "universal permissive license", r"universal permissive license(?: v 1 0)?"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? license"),
    ("postgresql", "postgresql license", r"postgresql license"),
    ("openssl", "openssl license", r"openssl license"),
    ("vim", "vim license", r"vim license"),
    ("x11", "x11 license", r"x11 license"),
    ("osl-3.0", "open software license", r"open software license(?: version)?(?: 3 0)?"),
    ("afl-3.0", "academic free license", r"academic free license(?: version)?(?: 3 0)?"),
    ("qpl-1.0", "q public license", r"q public license(?: version 1 0)?"),
    ("w3c", "w3c software", r"w3c software(?: notice and)? license"),
    ("openrail-m", "openrail", r"(?:creativeml |bigscience )?openrail(?: m)?(?: license)?"),
]
#: Forms in which a name is used: suffix of the rule, pattern around the name, priority.
FORMS = [
    ("notice", r"(?:licensed|released|distributed|available|provided|published) under (?:the |a )?(?:terms of )?(?:the )?(?:gnu )?(?:{name})", 90),
    ("terms", r"(?:under|by|subject to) the terms (?:and conditions )?of (?:the )?(?:gnu )?(?:{name})", 85),
    ("reference", r"(?:see|read|accompanying|copy of) (?:the )?(?:gnu )?(?:{name})", 70),
    ("name", r"(?:{name})", 50),
]
#: Creative Commons: elements and versions give the labels.
ELEMENTS = [("by", "attribution"), ("by sa", "attribution share ?alike"), ("by nd", "attribution no ?deriv(?:ative)?s?(?: works)?"), ("by nc", "attribution non ?commercial"), ("by nc sa", "attribution non ?commercial share ?alike"), ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?")]
VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
#: Rules written one by one: label, keyword, pattern, priority.
SINGLE = [
    ("reserved", "rights reserved", r"all rights reserved", 60),
    ("reserved", "rights reserved", r"some rights reserved", 55),
    ("reserved", "rechte vorbehalten", r"alle rechte vorbehalten", 60),
    ("reserved", "tous droits", r"tous droits r[ée]serv[ée]s", 60),
    ("reserved", "derechos reservados", r"todos los derechos reservados", 60),
    ("copyright-notice", "copyright", r"copyright (?:c |© )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*", 40),
    ("public-domain", "public domain", r"(?:dedicated to|released into|placed in|in) the public domain", 60),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 65),
    ("cc0-1.0", "no rights reserved", r"no rights reserved", 62),
    ("cc", "creative commons", r"(?:licensed|released) under (?:a |the )?creative commons licen[cs]e", 45),
    ("gpl", "general public license", r"(?<!lesser )(?<!affero )(?<!library )general public license", 30),
    ("gpl-or-later", "any later version", r"(?:or|and) (?:at your option )?any later version", 35),
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 95),
    ("isc", "permission to use copy", r"permission to use copy modify and or distribute this software for any purpose", 95),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification", 95),
    ("bsd-3-clause", "neither the name", r"neither the name of .{1,80} nor the names of its contributors", 96),
    ("bsd-4-clause", "all advertising materials", r"all advertising materials mentioning features or use of this software", 97),
    ("unlicense", "free and unencumbered", r"free and unencumbered software released into the public domain", 95),
    ("warranty-disclaimer", "without warranty", r"without warranty of any kind", 20),
    ("warranty-disclaimer", "provided as is", r"provided as is", 20),
    ("proprietary", "proprietary and confidential", r"proprietary and confidential", 50),
    ("proprietary", "copying", r"unauthori[sz]ed copying", 50),
    ("eula", "end user", r"end user licen[cs]e agreement", 50),
]
#: Names without a version: they lose to any rule that knows the version.
UNVERSIONED = [
    ("apache", "apache", r"apache (?:software )?(?:foundation )?licen[cs]e", 25),
    ("apache", "apache", r"apache licensed", 24),
    ("bsd", "bsd", r"bsd (?:style |like )?licen[cs]e", 25),
    ("bsd", "berkeley software distribution", r"berkeley software distribution(?: bsd)?", 24),
    ("mpl", "mozilla public license", r"mozilla public license", 25),
    ("epl", "eclipse public license", r"eclipse public license", 25),
    ("lgpl", "lesser general public license", r"(?:gnu )?lesser general public license", 32),
    ("lgpl", "library general public license", r"(?:gnu )?library general public license", 32),
    ("agpl", "affero general public license", r"(?:gnu )?affero general public license", 32),
    ("gpl", "gpl", r"(?:gnu )?gpl(?: licen[cs]ed?)?", 22),
    ("gpl-2.0", "gplv2", r"gplv2", 45),
    ("gpl-3.0", "gplv3", r"gplv3", 45),
    ("gpl-2.0", "gpl", r"(?<!l )gpl (?:version |v )?2(?: 0)?", 44),
    ("gpl-3.0", "gpl", r"(?<!l )gpl (?:version |v )?3(?: 0)?", 44),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", 24),
    ("lgpl-2.1", "lgpl", r"lgpl (?:version |v )?2 1", 44),
    ("lgpl-3.0", "lgpl", r"lgpl (?:version |v )?3(?: 0)?", 44),
    ("lgpl-3.0", "lgplv3", r"lgplv3", 45),
    ("agpl", "agpl", r"(?:gnu )?agpl", 24),
    ("agpl-3.0", "agplv3", r"agplv3", 45),
    ("gfdl", "free documentation license", r"(?:gnu )?free documentation licen[cs]e", 25),
    ("gfdl", "gfdl", r"gfdl", 24),
    ("eupl", "european union public", r"european union public licen[cs]e", 25),
    ("cddl", "common development and distribution", r"common development and distribution licen[cs]e", 25),
    ("cpl", "common public license", r"common public license", 25),
    ("ipl-1.0", "ibm public license", r"ibm public license(?: version 1 0)?", 52),
    ("artistic", "artistic license", r"artistic licen[cs]e", 25),
    ("artistic-perl", "same terms as perl", r"under the same terms as perl itself", 60),
    ("php", "php license", r"php license", 25),
    ("python", "python license", r"python license", 25),
    ("mit", "mit licensed", r"mit licensed", 30),
    ("mit", "expat", r"expat license", 45),
    ("zpl", "zope public license", r"zope public license(?: version)?(?: 2 [01])?", 50),
    ("osl", "open software license", r"open software license", 25),
    ("cecill", "cecill", r"(?:licence|license) cecill(?: [bc])?|cecill (?:free software )?licen[cs]e", 50),
    ("sil-ofl", "sil", r"sil ofl", 40),
    ("odc", "open data commons", r"open data commons", 22),
    ("ogl", "open government licence", r"open government licence(?: v(?:ersion)? ?[123](?: 0)?)?", 50),
    ("etalab", "licence ouverte", r"licence ouverte(?: open licence)?", 50),
    ("dl-de-by", "datenlizenz deutschland", r"datenlizenz deutschland namensnennung(?: version)?(?: 2 0)?", 52),
    ("dl-de-zero", "datenlizenz deutschland", r"datenlizenz deutschland zero(?: version)?(?: 2 0)?", 52),
    ("cdla", "community data license", r"community data license agreement(?: permissive| sharing)?", 50),
    ("llama", "community license", r"llama ?[234]? community license(?: agreement)?", 50),
    ("gemma", "gemma terms of use", r"gemma terms of use", 50),
    ("commons-clause", "commons clause", r"commons clause(?: license condition)?", 55),
    ("polyform", "polyform", r"polyform (?:noncommercial|strict|shield|small business|perimeter) license", 55),
    ("beerware", "beer ware", r"(?:the )?beer ware license", 55),
    ("json", "good not evil", r"shall be used for good not evil", 70),
    ("freetype", "freetype", r"freetype (?:project )?license", 50),
    ("imagemagick", "imagemagick", r"imagemagick license", 50),
    ("libpng", "libpng", r"libpng license", 48),
    ("sleepycat", "sleepycat", r"sleepycat license", 50),
    ("unicode", "unicode license", r"unicode license(?: agreement)?", 50),
    ("blueoak", "blue oak", r"blue oak model license", 52),
    ("mulan", "mulan", r"mulan (?:psl|permissive software license)(?: v2)?", 52),
    ("ecl-2.0", "educational community license", r"educational community license(?: version)?(?: 2 0)?", 52),
    ("rpl", "reciprocal public license", r"reciprocal public license", 50),
    ("sun-industry", "sun industry standards", r"sun industry standards source license", 50),
    ("cc-by", "attribution", r"creative commons attribution", 40),
    ("cc-by-sa", "share alike", r"(?:attribution )?share alike licen[cs]e", 38),
    ("cc-nc", "non commercial", r"non commercial (?:use only|licen[cs]e|purposes only)", 36),
    ("cc", "creativecommons org", r"creativecommons org licenses", 42),
    ("cc-by", "creativecommons org", r"creativecommons org licenses by (?:[1-4] [05])", 78),
    ("cc-by-sa", "creativecommons org", r"creativecommons org licenses by sa (?:[1-4] [05])", 78),
    ("cc-by-nc", "creativecommons org", r"creativecommons org licenses by nc (?:[1-4] [05])", 78),
    ("cc-by-nd", "creativecommons org", r"creativecommons org licenses by nd (?:[1-4] [05])", 78),
    ("cc-by-nc-sa", "creativecommons org", r"creativecommons org licenses by nc sa (?:[1-4] [05])", 78),
    ("cc-by-nc-nd", "creativecommons org", r"creativecommons org licenses by nc nd (?:[1-4] [05])", 78),
    ("cc0-1.0", "creativecommons org", r"creativecommons org publicdomain zero 1 0", 79),
    ("public-domain", "creativecommons org", r"creativecommons org publicdomain mark 1 0", 79),
    ("apache-2.0", "apache org licenses", r"apache org licenses license 2 0", 88),
    ("gpl", "gnu org licenses", r"gnu org licenses(?: gpl)?", 42),
    ("lgpl", "gnu org licenses", r"gnu org licenses lgpl", 43),
    ("agpl", "gnu org licenses", r"gnu org licenses agpl", 43),
    ("gfdl", "gnu org licenses", r"gnu org licenses fdl", 43),
    ("mpl-2.0", "mozilla org mpl", r"mozilla org mpl 2 0", 86),
    ("mit", "opensource org licenses", r"opensource org licenses mit(?: license)?", 80),
    ("bsd-3-clause", "opensource org licenses", r"opensource org licenses bsd 3 clause", 80),
    ("bsd-2-clause", "opensource org licenses", r"opensource org licenses bsd 2 clause", 80),
]
#: Sentences of the licenses' own texts and of notices.
BODY = [
    ("mit", "sublicense and or sell", r"use copy modify merge publish distribute sublicense and or sell copies of the software", 94),
    ("mit", "above copyright notice", r"the above copyright notice and this permission notice shall be included in all copies", 93),
    ("bsd", "redistributions of source code", r"redistributions of source code must retain the above copyright notice", 92),
    ("bsd", "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice", 92),
    ("bsd", "contributors as is", r"this software is provided by the (?:copyright holders|regents|authors?) and contributors as is", 90),
    ("bsd-3-clause", "endorse or promote", r"may (?:not )?be used to endorse or promote products derived from this software", 90),
    ("isc", "disclaims all warranties", r"the author disclaims all warranties with regard to this software", 90),
    ("zlib", "express or implied warranty", r"provided as is without any express or implied warranty", 88),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", 94),
    ("apache-2.0", "compliance with the license", r"you may not use this file except in compliance with the license", 93),
    ("apache-2.0", "warranties or conditions", r"as is basis without warranties or conditions of any kind", 92),
    ("apache-2.0", "perpetual worldwide", r"perpetual worldwide non exclusive no charge royalty free irrevocable", 91),
    ("gpl", "redistribute it and or modify", r"you can redistribute it and or modify it under the terms", 90),
    ("gpl", "fitness for a particular purpose", r"without even the implied warranty of merchantability or fitness for a particular purpose", 89),
    ("gpl", "received a copy", r"you should have received a copy of the gnu general public license", 91),
    ("lgpl", "received a copy", r"you should have received a copy of the gnu (?:lesser|library) general public license", 91),
    ("agpl", "received a copy", r"you should have received a copy of the gnu affero general public license", 91),
    ("gpl", "free software foundation", r"free software foundation inc", 28),
    ("gpl", "copyleft", r"copyleft licen[cs]e for software", 60),
    ("gpl", "everyone is permitted", r"everyone is permitted to copy and distribute verbatim copies", 94),
    ("lgpl", "incorporates the terms", r"this version of the gnu lesser general public license incorporates the terms", 95),
    ("agpl", "remotely through a computer network", r"interacting with it remotely through a computer network", 95),
    ("mpl-2.0", "subject to the terms", r"this source code form is subject to the terms of the mozilla public license v 2 0", 96),
    ("mpl-2.0", "incompatible with secondary", r"incompatible with secondary licenses", 90),
    ("mpl-1.1", "contents of this file", r"the contents of this file are subject to the mozilla public license version 1 1", 96),
    ("epl", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse", 94),
    ("cddl", "contents of this file", r"the contents of this file are subject to the terms of the common development", 94),
    ("bsl-1.0", "machine executable object", r"machine executable object code generated by a source language processor", 96),
    ("unlicense", "dedicate any and all", r"dedicate any and all copyright interest in the software to the public domain", 95),
    ("cc0-1.0", "waived all copyright", r"waived all copyright and related or neighboring rights", 90),
    ("wtfpl", "wtfpl", r"wtfpl(?: version 2)?", 55),
    ("artistic", "copyright holder maintains", r"the copyright holder maintains some semblance of artistic control", 95),
    ("ofl-1.1", "reserved font", r"(?:with )?reserved font names?", 70),
    ("ofl-1.1", "licensed under the sil", r"this font software is licensed under the sil open font license version 1 1", 97),
    ("gfdl", "invariant sections", r"with no invariant sections no front cover texts and no back cover texts", 94),
    ("gfdl", "permission is granted to copy", r"permission is granted to copy distribute and or modify this document", 94),
    ("cc", "creative commons corporation", r"creative commons corporation is not a law firm", 92),
    ("cc-by", "give appropriate credit", r"you must give appropriate credit provide a link to the license", 90),
    ("cc-by-sa", "same license as the original", r"distribute your contributions under the same license as the original", 90),
    ("cc-by-nc", "material for commercial purposes", r"you may not use the material for commercial purposes", 90),
    ("cc-by-nd", "distribute the modified material", r"you may not distribute the modified material", 90),
    ("odbl-1.0", "contains information from", r"contains information from .{1,80} which is made available (?:here )?under the (?:odc )?open database license", 90),
    ("ogl", "public sector information", r"contains public sector information licensed under the open government licence", 92),
    ("crown", "crown copyright", r"crown copyright(?: (?:19|20)[0-9]{2})?", 55),
    ("us-government", "government", r"(?:work of the united states government|united states government work|u s government work)", 60),
    ("us-government", "not subject to", r"not subject to (?:domestic )?copyright protection", 58),
    ("fair-use", "section 107", r"copyright disclaimer under section 107", 60),
    ("fair-use", "fair use", r"fair use is a use permitted by copyright statute", 60),
    ("warranty-disclaimer", "warranties of merchantability", r"(?:implied )?warranties of merchantability(?: and| or) fitness", 21),
    ("warranty-disclaimer", "no warranty", r"(?:there is |comes with )?(?:absolutely )?no warranty", 19),
    ("warranty-disclaimer", "ohne gewähr", r"(?:alle angaben )?ohne gewähr", 19),
    ("warranty-disclaimer", "garantie", r"sans (?:aucune )?garantie", 19),
    ("warranty-disclaimer", "garantía", r"sin (?:ninguna )?garantía", 19),
    ("liability-disclaimer", "liable for any", r"(?:shall|be held|be) liable for any (?:claim|direct|damages)", 18),
    ("liability-disclaimer", "keine haftung", r"(?:wir übernehmen )?keine haftung", 18),
    ("proprietary", "trade", r"(?:contains|constitutes?) (?:confidential and )?(?:proprietary )?trade secrets?", 52),
    ("proprietary", "written", r"without (?:the )?(?:express|prior) written (?:permission|consent)", 51),
    ("proprietary", "strictly prohibited", r"(?:reproduction|distribution|copying|use) (?:.{1,60} )?is strictly prohibited", 50),
    ("proprietary", "internal use only", r"for internal use only", 45),
    ("proprietary", "not for distribution", r"(?:confidential )?not for (?:re)?distribution", 45),
    ("proprietary", "reverse engineer", r"(?:may not|shall not|not) (?:.{1,40} )?reverse engineer", 48),
    ("eula", "by installing", r"by installing (?:.{1,40} )?you (?:agree|accept)", 46),
    ("eula", "non transferable", r"non exclusive (?:and )?non transferable (?:limited )?licen[cs]e", 47),
    ("terms-of-use", "terms of", r"(?:our |the |these )?terms of (?:use|service)", 15),
    ("terms-of-use", "terms and conditions", r"terms and conditions apply", 16),
    ("terms-of-use", "nutzungsbedingungen", r"nutzungsbedingungen", 15),
    ("terms-of-use", "conditions générales", r"conditions générales d utilisation", 15),
    ("terms-of-use", "condiciones de uso", r"(?:términos y )?condiciones de uso", 15),
    ("copyright-notice", "copyright", r"copyright (?:by|the) [^ ]+", 38),
    ("copyright-notice", "copyrighted", r"(?:is|are) copyrighted (?:by|material)", 39),
    ("copyright-notice", "urheberrechtlich", r"urheberrechtlich geschützt", 40),
    ("copyright-notice", "d auteur", r"protégée?s? par (?:le |les )?droits? d auteur", 40),
    ("copyright-notice", "derechos de autor", r"(?:protegid[oa]s? por )?derechos de autor", 40),
    ("reserved", "are reserved", r"rights (?:not expressly granted )?are reserved", 54),
    ("reserved", "rechte vorbehalten", r"rechte vorbehalten", 54),
    ("reserved", "tutti i diritti", r"tutti i diritti riservati", 60),
    ("reserved", "todos os direitos", r"todos os direitos reservados", 60),
    ("reserved", "alle rechten", r"alle rechten voorbehouden", 60),
    ("public-domain", "copyright", r"no longer (?:under|protected by) copyright", 50),
    ("public-domain", "gemeinfrei", r"gemeinfrei", 55),
    ("public-domain", "domaine public", r"(?:dans le )?domaine public", 55),
    ("public-domain", "dominio público", r"(?:de )?dominio público", 55),
    ("cc", "lizenziert unter", r"lizenziert unter (?:einer )?creative commons", 45),
    ("cc", "licence creative commons", r"(?:sous )?licence creative commons", 45),
    ("cc", "licencia creative commons", r"(?:bajo )?(?:una )?licencia creative commons", 45),
    ("dual-license", "dual licensed", r"dual licensed under", 35),
    ("open-source", "open source license", r"(?:an |osi approved )?open source license", 12),
    ("open-source", "free software license", r"free software license", 12),
    ("license-file", "license", r"see (?:the )?(?:accompanying )?license (?:file|txt|md)", 14),
    ("license-file", "copying", r"see (?:the file )?copying(?: for details)", 14),
    ("attribution-required", "attribution", r"attribution (?:is )?required", 34),
    ("noai", "text and data mining", r"text and data mining (?:is |are )?(?:not permitted|prohibited|reserved)", 64),
    ("noai", "machine learning", r"may not be used (?:to train|for training) (?:.{1,40} )?machine learning", 64),
    ("patent", "pending", r"patents? pending", 17),
    ("trademark", "registered", r"(?:is|are) (?:a )?registered trademarks? of", 17),
]
#: Words too common to signal a license by themselves.
GENERIC = frozenset("license licence public software general version provided notice open use copy source agreement user terms material materials data free rights any for the and not under with this that other form code file work works of by in to a is it as no you your which available including other copies all mit what same end good share q later just information from contains particular received subject".split())


def _spdx() -> list[tuple[str, str, str, int]]:
    ids = dict.fromkeys([label for label, *_ in NAMES] + [f"cc-{e.replace(' ', '-')}-{v.replace(' ', '.')}" for e, _ in ELEMENTS for v in VERSIONS])
    spelled = lambda label: label.replace("-", " ").replace(".", " ")
    return [(label, "spdx license identifier", rf"spdx license identifier {spelled(label)}(?: only| or later)?", 100) for label in ids]


def rules() -> list[tuple[str, str, str, str, int]]:
    """(rule, label, keyword, pattern, priority) of all rules."""
    out = [(f"{label} {form}", label, keyword, pattern.format(name=name), p) for label, keyword, name in NAMES for form, pattern, p in FORMS]
    for e, long in ELEMENTS:
        label = "cc-" + e.replace(" ", "-")
        end = r"(?! (?:nc|nd|sa)\b)"
        out.append((f"{label} short", label, "cc by", rf"cc {e}{end}", 58))
        out.append((f"{label} long", label, "creative commons", rf"creative commons {long}(?: (?:international|unported|generic))?(?: public)?(?: licen[cs]e)?", 57))
        for v in VERSIONS:
            out.append((f"{label}-{v} short", f"{label}-{v.replace(' ', '.')}", "cc by", rf"cc {e} {v}", 80))
            out.append((f"{label}-{v} long", f"{label}-{v.replace(' ', '.')}", "creative commons", rf"creative commons {long} {v}(?: (?:international|unported|generic))?(?: public)?(?: licen[cs]e)?", 80))
    out += [(f"{kind} {i}", *x) for kind, table in (("single", SINGLE), ("name", UNVERSIONED), ("body", BODY)) for i, x in enumerate(table)]
    out += [(f"spdx {x[0]}", *x) for x in _spdx()]
    return out
