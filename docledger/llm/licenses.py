"""Operator 6: license scan by ordered signature rules.

Rules are regular expressions over a text's words (letters and digits, lower-cased, a space between them), so line
breaks, punctuation and comment marks do not matter. A rule runs only on texts that hold its keyword; of detections
that overlap, priority and containment decide which stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docledger.llm.common import batches_of

# Phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Label, keyword and name of each license family; {v} stands for the versions that follow it.
FAMILIES = (
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e", ("1", "2", "3")),
    ("gpl", "gpl", r"(?:gnu )?gpl", ("1", "2", "3")),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[cs]e", ("2 1", "3")),
    ("lgpl", "library general", r"(?:gnu )?library general public licen[cs]e", ("2",)),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", ("2", "2 1", "3")),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", ("1", "3")),
    ("agpl", "agpl", r"(?:gnu )?agpl", ("1", "3")),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e", ("1 1", "1 2", "1 3")),
    ("apache", "apache", r"apache(?: software)? licen[cs]e", ("1 0", "1 1", "2 0")),
    ("apache-2.0", "apache 2", r"apache (?:v ?)?2(?: 0)? licen[cs]e", ()),
    ("gpl-2", "gplv2", r"(?:gnu )?gplv2(?: 0)?(?: or later)?", ()),
    ("gpl-3", "gplv3", r"(?:gnu )?gplv3(?: 0)?(?: or later)?", ()),
    ("lgpl-2", "lgplv2", r"(?:gnu )?lgplv2(?: 0)?(?: or later)?", ()),
    ("lgpl-2.1", "lgplv2 1", r"(?:gnu )?lgplv2 1(?: or later)?", ()),
    ("lgpl-3", "lgplv3", r"(?:gnu )?lgplv3(?: 0)?(?: or later)?", ()),
    ("agpl-3", "agplv3", r"(?:gnu )?agplv3(?: 0)?(?: or later)?", ()),
    ("mit", "mit", r"mit licen[cs]e", ()),
    ("mit", "expat", r"expat licen[cs]e", ()),
    ("bsd", "bsd", r"(?:new |modified |simplified |revised )?bsd(?: style)? licen[cs]e", ()),
    ("bsd-2-clause", "bsd", r"bsd 2 clause|2 clause bsd|simplified bsd", ()),
    ("bsd-3-clause", "bsd", r"bsd 3 clause|3 clause bsd|new bsd", ()),
    ("bsd-4-clause", "bsd", r"bsd 4 clause|4 clause bsd|original bsd", ()),
    ("isc", "isc", r"isc licen[cs]e", ()),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", ()),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", r"mpl", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", r"eclipse public licen[cs]e", ("1 0", "2 0")),
    ("edl", "eclipse", r"eclipse distribution licen[cs]e", ("1 0",)),
    ("cddl", "common development", r"common development and distribution licen[cs]e", ("1 0", "1 1")),
    ("cpl", "common public", r"common public licen[cs]e", ("1 0",)),
    ("eupl", "european union", r"european union public licen[cs]e", ("1 0", "1 1", "1 2")),
    ("artistic", "artistic", r"artistic licen[cs]e", ("1 0", "2 0")),
    ("boost", "boost", r"boost software licen[cs]e", ("1 0",)),
    ("unlicense", "unlicense", r"unlicense", ()),
    ("wtfpl", "wtfpl", r"wtfpl", ("2",)),
    ("cc0", "cc0", r"cc0", ("1 0",)),
    ("cc0", "creative commons", r"creative commons (?:zero|cc0)", ("1 0",)),
    ("cc-by", "cc by", r"cc by", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "creative commons", r"creative commons attribution", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "cc by", r"cc by sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "cc by", r"cc by nd", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative|ativework)s?", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "cc by", r"cc by nc", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd", ("2 0", "2 5", "3 0", "4 0")),
    ("odbl", "open database", r"open database licen[cs]e", ("1 0",)),
    ("ofl", "open font", r"(?:sil )?open font licen[cs]e", ("1 0", "1 1")),
    ("osl", "open software", r"open software licen[cs]e", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic free", r"academic free licen[cs]e", ("1 2", "2 0", "2 1", "3 0")),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e", ()),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e", ()),
    ("psf", "python software", r"python software foundation licen[cs]e", ("2",)),
    ("ruby", "ruby", r"ruby licen[cs]e", ()),
    ("php", "php", r"php licen[cs]e", ("3 0", "3 01")),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", ()),
    ("openssl", "openssl", r"openssl licen[cs]e", ()),
    ("qpl", "q public", r"q public licen[cs]e", ("1 0",)),
    ("zpl", "zope", r"zope public licen[cs]e", ("1 1", "2 0", "2 1")),
    ("vim", "vim", r"vim licen[cs]e", ()),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e", ()),
    ("public-domain", "public domain", r"public domain", ()),
)

# Sentences of licence texts, each with its label and keyword.
TEXTS = (
    ("mit", "free of charge", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "with or without fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", "binary forms", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse or promote", r"neither the name of .{1,80}? may be used to endorse or promote products"),
    ("gpl", "redistribute it", r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("lgpl", "redistribute it", r"you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e"),
    ("apache", "you may not use", r"you may not use this file except in compliance with the licen[cs]e"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("zlib", "as is without", r"this software is provided as is without any express or implied warranty in no event will the authors"),
    ("wtfpl", "what the", r"do what the f\w+ you want to public licen[cs]e"),
    ("wtfpl", "you just do", r"you just do what the f\w+ you want to"),
    ("mit", "above copyright notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "without restriction", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit-0", "persons to whom", r"to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("isc", "above copyright notice", r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "disclaims all", r"the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("0bsd", "hereby granted", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    ("bsd", "retain the above", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "reproduce the above", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "without specific prior", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", "in no event shall", r"in no event shall the (?:copyright (?:holder|owner)s? or contributors|regents or contributors|author) be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("gpl", "free software foundation", r"as published by the free software foundation either version \d(?: of the licen[cs]e)? or at your option any later version"),
    ("gpl", "hope that it", r"in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "received a copy", r"you should have received a copy of the gnu general public licen[cs]e"),
    ("lgpl", "received a copy", r"you should have received a copy of the gnu lesser general public licen[cs]e"),
    ("agpl", "received a copy", r"you should have received a copy of the gnu affero general public licen[cs]e"),
    ("agpl", "redistribute it", r"you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e"),
    ("gpl-2", "june 1991", r"gnu general public licen[cs]e version 2 june 1991"),
    ("gpl-3", "june 2007", r"gnu general public licen[cs]e version 3 29 june 2007"),
    ("lgpl-2.1", "february 1999", r"gnu lesser general public licen[cs]e version 2 1 february 1999"),
    ("agpl-3", "november 2007", r"gnu affero general public licen[cs]e version 3 19 november 2007"),
    ("gpl-classpath-exception", "linking this library", r"linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gcc-exception", "runtime library exception", r"gcc runtime library exception"),
    ("gfdl", "permission is granted", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("gfdl", "invariant sections", r"with no invariant sections no front cover texts and no back cover texts"),
    ("apache-2.0", "january 2004", r"apache licen[cs]e version 2 0 january 2004"),
    ("apache-2.0", "unless required", r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis"),
    ("apache", "limitations under", r"see the licen[cs]e for the specific language governing permissions and limitations under the licen[cs]e"),
    ("apache", "apache software foundation", r"licen[cs]ed to the apache software foundation asf under one or more contributor licen[cs]e agreements"),
    ("apache-1.1", "this product includes", r"this product includes software developed by the apache software foundation"),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("mpl-1.1", "contents of this file", r"the contents of this file are subject to the mozilla public licen[cs]e version 1 1"),
    ("npl", "netscape public", r"the contents of this file are subject to the netscape public licen[cs]e"),
    ("epl-1.0", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v ?1 0"),
    ("epl-2.0", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v?(?:ersion)? ?2 0"),
    ("cddl", "common development", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("boost", "person or organization", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "must not be misrepresented", r"the origin of this software must not be misrepresented"),
    ("libpng", "png reference library", r"png reference library licen[cs]e"),
    ("unlicense", "anyone is free", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0", "waived all", r"has waived all copyright and related or neighboring rights"),
    ("cc0", "dedicated the work", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by", "free to share", r"you are free to share copy and redistribute the material in any medium or format"),
    ("cc-by-sa", "distribute your contributions", r"you must distribute your contributions under the same licen[cs]e as the original"),
    ("cc-by-nc", "commercial purposes", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", "distribute the modified", r"you may not distribute the modified material"),
    ("public-domain", "placed in the", r"(?:is|was|been) (?:hereby )?placed in the public domain"),
    ("public-domain", "dedicated to the", r"(?:is|was|been) (?:hereby )?dedicated to the public domain"),
    ("artistic", "item itself", r"freely available means that no fee is charged for the item itself"),
    ("artistic-2.0", "perl foundation", r"the artistic licen[cs]e 2 0 copyright c 2000 2006 the perl foundation"),
    ("perl", "same terms as perl", r"under the same terms as perl itself"),
    ("python", "psf hereby grants", r"psf hereby grants licensee a nonexclusive royalty free world wide licen[cs]e"),
    ("openssl", "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "eric young", r"this product includes cryptographic software written by eric young"),
    ("ofl", "reserved font name", r"no modified version of the font software may use the reserved font name"),
    ("ofl", "font software", r"this font software is licen[cs]ed under the sil open font licen[cs]e"),
    ("ms-pl", "governs use", r"this licen[cs]e governs use of the accompanying software if you use the software you accept this licen[cs]e"),
    ("x11", "x consortium", r"the name of the x consortium shall not be used in advertising or otherwise to promote the sale use or other dealings"),
    ("ncsa", "university of illinois", r"developed by .{1,80}? university of illinois"),
    ("json", "used for good", r"the software shall be used for good not evil"),
    ("beerware", "buy me a beer", r"you can buy me a beer in return"),
    ("postgresql", "written agreement", r"without fee and without a written agreement is hereby granted"),
    ("hpnd", "supporting documentation", r"that both that copyright notice and this permission notice appear in supporting documentation"),
    ("curl", "copyright holder shall not", r"the name of a copyright holder shall not be used in advertising or otherwise to promote the sale"),
    ("vim", "charityware", r"vim is charityware"),
    ("ijg", "independent jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("freetype", "freetype project", r"portions of this software are copyright .{1,40}? the freetype project"),
    ("unicode", "data files", r"unicode data files and (?:any associated documentation|software)"),
    ("w3c", "w3c software", r"w3c software (?:and document )?notice and licen[cs]e"),
    ("sleepycat", "redistributions in any form", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("elastic", "elastic licen", r"elastic licen[cs]e(?: 2 0)?"),
    ("sspl", "server side public", r"server side public licen[cs]e"),
    ("busl", "business source", r"business source licen[cs]e(?: 1 1)?"),
    ("commons-clause", "commons clause", r"commons clause licen[cs]e condition"),
    ("openrail", "rail", r"(?:creativeml |bigscience )?open ?rail(?: m| s| d)?"),
    ("proprietary", "trade secret", r"contains? (?:confidential and )?(?:proprietary )?trade secrets?"),
    ("proprietary", "ed copying of this", r"unauthori[sz]ed copying of this (?:file|software|document)"),
    ("proprietary", "may not be reproduced", r"may not be reproduced (?:or transmitted )?in any form"),
    ("proprietary", "prior written", r"without the (?:express )?prior written (?:consent|permission) of"),
    ("proprietary", "internal use only", r"for internal use only"),
    ("proprietary", "end user", r"end user licen[cs]e agreement"),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
)

# Addresses of licence texts, each with its label; the words of the address stand in a row.
ADDRESSES = (
    ("apache-2.0", "apache org licenses license 2 0"),
    ("apache-1.1", "apache org licenses license 1 1"),
    ("mit", "opensource org licenses mit"),
    ("isc", "opensource org licenses isc"),
    ("bsd-2-clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "opensource org licenses bsd 3 clause"),
    ("gpl-2", "gnu org licenses old licenses gpl 2 0"),
    ("lgpl-2.1", "gnu org licenses old licenses lgpl 2 1"),
    ("gpl-3", "gnu org licenses gpl 3 0"),
    ("lgpl-3", "gnu org licenses lgpl 3 0"),
    ("agpl-3", "gnu org licenses agpl 3 0"),
    ("gpl", "gnu org licenses gpl"),
    ("lgpl", "gnu org licenses lgpl"),
    ("agpl", "gnu org licenses agpl"),
    ("gfdl", "gnu org licenses fdl"),
    ("gpl", "gnu org copyleft gpl"),
    ("mpl-2.0", "mozilla org mpl 2 0"),
    ("mpl", "mozilla org mpl"),
    ("epl-1.0", "eclipse org legal epl v10"),
    ("epl-2.0", "eclipse org legal epl 2 0"),
    ("edl-1.0", "eclipse org org documents edl v10"),
    ("boost", "boost org license 1 0"),
    ("unlicense", "unlicense org"),
    ("wtfpl", "wtfpl net"),
    ("zlib", "zlib net zlib license"),
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons org publicdomain mark 1 0"),
    ("cc-by-1.0", "creativecommons org licenses by 1 0"),
    ("cc-by-2.0", "creativecommons org licenses by 2 0"),
    ("cc-by-2.5", "creativecommons org licenses by 2 5"),
    ("cc-by-3.0", "creativecommons org licenses by 3 0"),
    ("cc-by-4.0", "creativecommons org licenses by 4 0"),
    ("cc-by-sa-2.0", "creativecommons org licenses by sa 2 0"),
    ("cc-by-sa-2.5", "creativecommons org licenses by sa 2 5"),
    ("cc-by-sa-3.0", "creativecommons org licenses by sa 3 0"),
    ("cc-by-sa-4.0", "creativecommons org licenses by sa 4 0"),
    ("cc-by-nd-3.0", "creativecommons org licenses by nd 3 0"),
    ("cc-by-nd-4.0", "creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-3.0", "creativecommons org licenses by nc 3 0"),
    ("cc-by-nc-4.0", "creativecommons org licenses by nc 4 0"),
    ("cc-by-nc-sa-3.0", "creativecommons org licenses by nc sa 3 0"),
    ("cc-by-nc-sa-4.0", "creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-3.0", "creativecommons org licenses by nc nd 3 0"),
    ("cc-by-nc-nd-4.0", "creativecommons org licenses by nc nd 4 0"),
    ("odbl-1.0", "opendatacommons org licenses odbl"),
    ("odc-by", "opendatacommons org licenses by"),
    ("pddl", "opendatacommons org licenses pddl"),
    ("ofl-1.1", "scripts sil org ofl"),
    ("artistic-2.0", "perlfoundation org artistic license 2 0"),
    ("psf-2", "docs python org 3 license"),
    ("ms-pl", "opensource org licenses ms pl"),
    ("postgresql", "postgresql org about licence"),
    ("etalab-2.0", "etalab gouv fr licence ouverte"),
    ("ogl-3.0", "nationalarchives gov uk doc open government licence version 3"),
)

# Identifiers of the public SPDX list that no family above has, as words.
IDENTIFIERS = (
    "0bsd", "aal", "afl 3 0", "apsl 2 0", "beerware", "blueoak 1 0 0", "bsd 1 clause", "bsd 2 clause", "bsd 2 clause patent", "bsd 3 clause",
    "bsd 3 clause clear", "bsd 3 clause lbnl", "bsd 4 clause", "bsl 1 0", "busl 1 1", "cecill 2 1", "cecill b", "cecill c", "cern ohl p 2 0",
    "cern ohl s 2 0", "cern ohl w 2 0", "curl", "ecl 2 0", "efl 2 0", "entessa", "eudatagrid", "fair", "frameworx 1 0", "ftl", "hpnd", "icu",
    "ijg", "imagemagick", "intel", "ipa", "ipl 1 0", "json", "lal 1 3", "libpng 2 0", "libtiff", "liliq p 1 1", "lpl 1 02", "lppl 1 3c", "miros",
    "mit 0", "motosoto", "mulanpsl 2 0", "multics", "naist 2003", "nasa 1 3", "naumen", "ngpl", "nokia", "nposl 3 0", "ntp", "oclc 2 0",
    "ogtsl", "oldap 2 8", "oset pl 2 1", "php 3 01", "python 2 0", "rpl 1 5", "rpsl 1 0", "rscpl", "simpl 2 0", "sissl", "sleepycat", "spl 1 0",
    "sspl 1 0", "tcl", "ucl 1 0", "unicode 3 0", "unicode dfs 2016", "upl 1 0", "vsl 1 0", "w3c", "watcom 1 0", "x11", "xnet", "zend 2 0",
)

# Identifiers of the public SPDX list whose family above goes by a name with "license", and the label.
NAMED_IDENTIFIERS = {
    "mit": "mit", "apache 1 0": "apache-1.0", "apache 1 1": "apache-1.1", "apache 2 0": "apache-2.0", "isc": "isc", "zlib": "zlib", "epl 1 0": "epl-1.0",
    "epl 2 0": "epl-2.0", "cddl 1 0": "cddl-1.0", "cddl 1 1": "cddl-1.1", "mpl 1 1": "mpl-1.1", "mpl 2 0": "mpl-2.0", "postgresql": "postgresql",
    "ofl 1 0": "ofl-1.0", "ofl 1 1": "ofl-1.1", "artistic 1 0": "artistic-1.0", "artistic 2 0": "artistic-2.0", "ms pl": "ms-pl", "ms rl": "ms-rl",
    "osl 3 0": "osl-3.0", "eupl 1 1": "eupl-1.1", "eupl 1 2": "eupl-1.2", "ncsa": "ncsa", "openssl": "openssl", "ruby": "ruby", "vim": "vim",
    "unlicense": "unlicense", "wtfpl": "wtfpl", "odbl 1 0": "odbl-1.0", "qpl 1 0": "qpl-1.0", "zpl 2 1": "zpl-2.1",
}

# Wordings around a name, their priority, and how sure they make a detection.
WORDINGS = (
    ("spdx", 40, 1.0, r"spdx licen[cs]e identifier {}"),
    ("grant", 30, 0.95, r"(?:re)?licen[cs]ed under (?:the )?(?:terms of (?:the )?)?{}"),
    ("release", 30, 0.9, r"(?:released|distributed|provided|published|available|redistributed) under (?:the )?(?:terms of (?:the )?)?{}"),
    ("name", 10, 0.7, r"{}"),
)
TEXT_PRIORITY, TEXT_CONFIDENCE, BASE_CONFIDENCE = 20, 0.85, 0.5
ADDRESS_PRIORITY, ADDRESS_CONFIDENCE = 35, 0.95


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float


def rules() -> list[Rule]:
    """Every family in every wording and version, and the licence texts: hundreds of rules in a fixed order."""
    out = []
    for label, keyword, name, versions in FAMILIES:
        for kind, priority, confidence, wording in WORDINGS:
            for v in ("", *versions):
                last = v.replace(" 0", "(?: 0)?") if v else ""
                tail = rf"(?: licen[cs]e)?(?: version)? v?{last}(?: or (?:any )?later)?" if v else ""
                full = f"{label}-{v.replace(' ', '.')}" if v else label
                pattern = rf"(?<![^ ]){wording.format(f'(?:{name})')}{tail}(?![^ ])"
                out.append(Rule(f"{full}:{kind}:{keyword}", full, keyword, pattern, priority + (5 if v else 0), confidence))
    for i, (label, keyword, pattern) in enumerate(TEXTS):
        out.append(Rule(f"{label}:text{i}", label, keyword, rf"(?<![^ ]){pattern}(?![^ ])", TEXT_PRIORITY, TEXT_CONFIDENCE))
    for label, words in ADDRESSES:
        out.append(Rule(f"{label}:address:{words}", label, words, rf"(?<![^ ]){words}(?![^ ])", ADDRESS_PRIORITY, ADDRESS_CONFIDENCE))
    for words, label in {**{w: w.replace(" ", "-") for w in IDENTIFIERS}, **NAMED_IDENTIFIERS}.items():
        pattern = rf"(?<![^ ])spdx licen[cs]e identifier {words}(?: or later| only)?(?![^ ])"
        out.append(Rule(f"{words}:identifier", label, f"identifier {words}", pattern, ADDRESS_PRIORITY + 5, 1.0))
    return out


#: Bytes of the words: digits, letters and everything beyond ASCII; capitals become small, all else a space.
_TO_WORDS = bytes(
    c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)


def canonical(text: str | None) -> tuple[str, int]:
    """The words joined by spaces, and their number."""
    found = (text or "").encode().translate(_TO_WORDS).split()
    return b" ".join(found).decode(), len(found)


def resolve(found: list[tuple[int, int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections that stay. found: start, end, number of the rule, rule.

    Priorities are decided from the highest down: a detection goes if it overlaps one of a higher priority that stayed,
    or if one of its own priority that stayed contains it; of equal places the earlier rule's stays. Each priority is
    one sweep over sorted places.
    """
    kept: list[tuple[int, int, Rule]] = []
    taken: list[tuple[int, int]] = []  # what the kept ones cover, as disjoint spans in order
    for priority in sorted({d[3].priority for d in found}, reverse=True):
        starts, most, stay = [s for s, _ in taken], -1, []
        for start, end, _, rule in sorted((d for d in found if d[3].priority == priority), key=lambda d: (d[0], -d[1], d[2])):
            before = bisect_left(starts, end)
            if before and taken[before - 1][1] > start:
                continue
            if end > most:
                most = end
                stay.append((start, end, rule))
        kept += stay
        taken = _merged(taken + [(s, e) for s, e, _ in stay])
    return sorted(kept, key=lambda d: (d[0], d[1], d[2].name))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def word_numbers(words: str, places: list[int]) -> list[int]:
    """Which word, from 0, starts at each of the ascending places; one pass over the words."""
    out, at, n = [], 0, 0
    for place in places:
        n += words.count(" ", at, place)
        at = place
        out.append(n)
    return out


class Scanner:
    def __init__(self):
        import ahocorasick

        self.rules = [(i, r, re.compile(r.pattern)) for i, r in enumerate(rules())]
        gated: dict[str, list] = {}
        for x in self.rules:
            gated.setdefault(x[1].keyword, []).append(x)
        self.automaton = ahocorasick.Automaton()
        for keyword, own in gated.items():
            self.automaton.add_word(keyword, (keyword, own))
        self.automaton.make_automaton()

    def base(self, words: str) -> list[tuple[str, int]]:
        """Label and first word of every place where a phrase's words stand in a row."""
        padded, out = f" {words} ", []
        for phrase, label in BASE.items():
            places, at = [], padded.find(f" {phrase} ")
            while at >= 0:
                places.append(at)
                at = padded.find(f" {phrase} ", at + 1)
            out += [(label, n) for n in word_numbers(padded, places)]
        return out

    def detections(self, words: str) -> list[tuple[int, int, Rule]]:
        hits = dict(x for _, x in self.automaton.iter(words))
        found = [(m.start(), m.end(), i, r) for own in hits.values() for i, r, regex in own for m in regex.finditer(words)]
        return resolve(found)


#: What a scan adds to a document.
FIELDS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "detections array<struct<label:string,rule:string,start:int,end:int,first_word:int,confidence:double>>"
)


def scan(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry``, the base phrases' places and the rules' detections of every whole text.

    docs needs text; a null text is empty. detections has label, rule, start and end (code points of the canonical
    words), first_word and confidence. score is the highest confidence, 0.5 for base phrases alone, 0 without any.
    Other columns are dropped, repeated rows are scanned alike; equal labels count once; an empty table gives no rows.
    """
    schema = StructType([*(docs.schema[c] for c in carry), *StructType.fromDDL(FIELDS)])
    own = pa.schema(
        [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]
        + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
        + [
            (
                "detections",
                pa.list_(
                    pa.struct(
                        [("label", pa.string()), ("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]
                        + [("first_word", pa.int32()), ("confidence", pa.float64())]
                    )
                ),
            )
        ]
    )

    def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            for b in batches_of(batch, "_text"):
                rows = []
                for text in b.column("_text").to_pylist():
                    words, n = canonical(text)
                    base, more = scanner.base(words), scanner.detections(words)
                    labels = {label for label, _ in base}
                    places = [at for _, at in base]
                    rows.append(
                        {
                            "n_words": n,
                            "n_base": len(base),
                            "first_word": min(places, default=None),
                            "last_word": max(places, default=None),
                            "base_labels": ",".join(sorted(labels)),
                            "labels": ",".join(sorted(labels | {r.label for _, _, r in more})),
                            "score": max([r.confidence for _, _, r in more] + [BASE_CONFIDENCE] * bool(base), default=0.0),
                            "detections": [
                                {"label": r.label, "rule": r.name, "start": s, "end": e, "first_word": at, "confidence": r.confidence}
                                for (s, e, r), at in zip(more, word_numbers(words, [s for s, _, _ in more]), strict=True)
                            ],
                        }
                    )
                made = pa.RecordBatch.from_pylist(rows, schema=own)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), *made.columns], names=[*carry, *own.names])

    return docs.select(*carry, F.col("text").alias("_text")).mapInArrow(scan_batches, schema)
