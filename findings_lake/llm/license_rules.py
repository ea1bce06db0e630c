"""Ordered signature rules of the license scan.

Rules work on normalised text: lower-case words joined by single spaces. A
rule's first word is a literal, its keyword: a rule is tried only where its
keyword stands, and only if its second keyword (``must``) is near. Priority 1
is strongest. ``rules()`` gives the ordered table.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    rule: int
    priority: int
    label: str
    keyword: str
    must: str
    regex: str
    confidence: float


#: Priorities and the confidence of a detection.
IDENTIFIER, GRANT, TEXT, NAME, HINT = 1, 2, 3, 4, 5
CONFIDENCE = {IDENTIFIER: 1.0, GRANT: 0.95, TEXT: 0.9, NAME: 0.75, HINT: 0.5}

#: label: (identifier, names). Names begin with a literal word.
LICENSES = {
    "agpl-3.0": ("agpl 3 0( only| or later)?", ["gnu affero general public license( version 3| v3| 3)?( 0)?", "affero general public license( version 3| v3)?", "agpl (v3|version 3|3)( 0)?", "agplv3"]),
    "agpl": ("agpl", ["affero gpl", "agpl license"]),
    "gpl-1.0": ("gpl 1 0( only| or later)?", ["gnu general public license (version |v)1", "gpl (v1|version 1|1 0)"]),
    "gpl-2.0": ("gpl 2 0( only| or later)?", ["gnu general public license (version |v)?2( 0)?", "gnu gpl (version 2|v2|2)", "gpl (v2|version 2|2 0)", "gplv2"]),
    "gpl-3.0": ("gpl 3 0( only| or later)?", ["gnu general public license (version |v)?3( 0)?", "gnu gpl (version 3|v3|3)", "gpl (v3|version 3|3 0)", "gplv3"]),
    "gpl": ("gpl", ["gnu general public license", "gnu gpl", "gpl license", "gpl licensed", "general public license"]),
    "lgpl-2.0": ("lgpl 2 0( only| or later)?", ["gnu library general public license( version 2| v2)?", "lgpl (v2|version 2|2 0)"]),
    "lgpl-2.1": ("lgpl 2 1( only| or later)?", ["gnu lesser general public license (version |v)?2 1", "lgpl (v2|version 2|2) 1", "lgplv2 1"]),
    "lgpl-3.0": ("lgpl 3 0( only| or later)?", ["gnu lesser general public license (version |v)?3( 0)?", "lgpl (v3|version 3|3 0)", "lgplv3"]),
    "lgpl": ("lgpl", ["gnu lesser general public license", "lesser general public license", "gnu lgpl", "lgpl license"]),
    "gfdl": ("gfdl 1 [123]( only| or later)?", ["gnu free documentation license( version 1 [123])?", "free documentation license", "gfdl"]),
    "apache-1.0": ("apache 1 0", ["apache (software )?license (version |v)?1 0"]),
    "apache-1.1": ("apache 1 1", ["apache (software )?license (version |v)?1 1"]),
    "apache-2.0": ("apache 2 0", ["apache (software )?license (version |v)?2( 0)?", "apache 2( 0)? license", "apache (v2|2 0)", "asl 2 0"]),
    "apache": ("apache", ["apache (software )?license", "apache licensed", "apache style license"]),
    "mit": ("mit", ["mit (x11 |expat )?licen[sc]e", "mit licensed", "mit style license", "expat license", "x11 license"]),
    "mit-0": ("mit 0", ["mit no attribution", "mit 0 license"]),
    "isc": ("isc", ["isc licen[sc]e", "isc licensed", "internet systems consortium license"]),
    "bsd-0-clause": ("0bsd", ["zero clause bsd( license)?", "0bsd license"]),
    "bsd-2-clause": ("bsd 2 clause", ["simplified bsd( license)?", "freebsd license", "bsd 2 clause( license)?", "2 clause bsd( license)?", "two clause bsd( license)?"]),
    "bsd-3-clause": ("bsd 3 clause", ["modified bsd( license)?", "revised bsd( license)?", "new bsd license", "bsd 3 clause( license)?", "3 clause bsd( license)?", "three clause bsd( license)?"]),
    "bsd-4-clause": ("bsd 4 clause", ["original bsd license", "bsd 4 clause( license)?", "4 clause bsd( license)?"]),
    "bsd": ("bsd", ["bsd (style )?licen[sc]e", "bsd licensed", "berkeley software distribution license"]),
    "mpl-1.0": ("mpl 1 0", ["mozilla public license (version |v)?1 0", "mpl (v)?1 0"]),
    "mpl-1.1": ("mpl 1 1", ["mozilla public license (version |v)?1 1", "mpl (v)?1 1"]),
    "mpl-2.0": ("mpl 2 0", ["mozilla public license (version |v)?2( 0)?", "mpl (v2|2 0)"]),
    "mpl": ("mpl", ["mozilla public license", "mpl license"]),
    "epl-1.0": ("epl 1 0", ["eclipse public license (version |v)?1 0", "epl 1 0"]),
    "epl-2.0": ("epl 2 0", ["eclipse public license (version |v)?2( 0)?", "epl 2 0"]),
    "epl": ("epl", ["eclipse public license"]),
    "cddl-1.0": ("cddl 1 0", ["common development and distribution license( version 1 0| 1 0)?", "cddl 1 0", "cddl license"]),
    "cpl-1.0": ("cpl 1 0", ["common public license( version 1 0| 1 0)?"]),
    "artistic-1.0": ("artistic 1 0", ["artistic license (version |v)?1 0"]),
    "artistic-2.0": ("artistic 2 0", ["artistic license (version |v)?2( 0)?"]),
    "artistic": ("artistic", ["artistic license", "perl artistic license"]),
    "boost-1.0": ("bsl 1 0", ["boost software license( version 1 0| 1 0)?", "boost license"]),
    "zlib": ("zlib", ["zlib (libpng )?license", "libpng license"]),
    "unlicense": ("unlicense", ["unlicense", "unlicensed public domain dedication"]),
    "wtfpl": ("wtfpl", ["wtfpl"]),
    "cc0-1.0": ("cc0 1 0", ["cc0( 1 0)?( universal)?", "cc zero", "creative commons zero( v1 0| 1 0)?( universal)?"]),
    "cc-by-1.0": ("cc by 1 0", ["cc by 1 0", "creative commons attribution 1 0"]),
    "cc-by-2.0": ("cc by 2 0", ["cc by 2 0", "creative commons attribution 2 0"]),
    "cc-by-2.5": ("cc by 2 5", ["cc by 2 5", "creative commons attribution 2 5"]),
    "cc-by-3.0": ("cc by 3 0", ["cc by 3 0", "creative commons attribution 3 0( unported| international)?"]),
    "cc-by-4.0": ("cc by 4 0", ["cc by 4 0", "creative commons attribution 4 0( international)?"]),
    "cc-by-sa-2.5": ("cc by sa 2 5", ["cc by sa 2 5", "creative commons attribution share ?alike 2 5"]),
    "cc-by-sa-3.0": ("cc by sa 3 0", ["cc by sa 3 0", "creative commons attribution share ?alike 3 0( unported)?"]),
    "cc-by-sa-4.0": ("cc by sa 4 0", ["cc by sa 4 0", "creative commons attribution share ?alike 4 0( international)?"]),
    "cc-by-sa": ("cc by sa", ["cc by sa", "creative commons attribution share ?alike"]),
    "cc-by-nc-3.0": ("cc by nc 3 0", ["cc by nc 3 0", "creative commons attribution non ?commercial 3 0( unported)?"]),
    "cc-by-nc-4.0": ("cc by nc 4 0", ["cc by nc 4 0", "creative commons attribution non ?commercial 4 0( international)?"]),
    "cc-by-nc": ("cc by nc", ["cc by nc", "creative commons attribution non ?commercial"]),
    "cc-by-nd-4.0": ("cc by nd 4 0", ["cc by nd 4 0", "creative commons attribution no ?deriv(ative)?s 4 0( international)?"]),
    "cc-by-nd": ("cc by nd", ["cc by nd", "creative commons attribution no ?deriv(ative)?s"]),
    "cc-by-nc-sa-4.0": ("cc by nc sa 4 0", ["cc by nc sa 4 0", "creative commons attribution non ?commercial share ?alike 4 0( international)?"]),
    "cc-by-nc-sa": ("cc by nc sa", ["cc by nc sa", "creative commons attribution non ?commercial share ?alike"]),
    "cc-by-nc-nd-4.0": ("cc by nc nd 4 0", ["cc by nc nd 4 0", "creative commons attribution non ?commercial no ?deriv(ative)?s 4 0( international)?"]),
    "cc-by-nc-nd": ("cc by nc nd", ["cc by nc nd", "creative commons attribution non ?commercial no ?deriv(ative)?s"]),
    "cc-by": ("cc by", ["cc by", "creative commons attribution( licen[sc]e)?"]),
    "creative-commons": ("cc", ["creative commons( public)? licen[sc]e", "creative commons"]),
    "odbl-1.0": ("odbl 1 0", ["open database licen[sc]e( odbl)?( v1 0| 1 0)?", "odbl"]),
    "odc-by-1.0": ("odc by 1 0", ["open data commons attribution licen[sc]e( v1 0| 1 0)?", "odc by"]),
    "pddl-1.0": ("pddl 1 0", ["public domain dedication and licen[sc]e", "pddl"]),
    "python-2.0": ("python 2 0", ["python software foundation license( version 2)?", "psf license", "python license"]),
    "php-3.01": ("php 3 01", ["php license( version 3 01)?"]),
    "ruby": ("ruby", ["ruby license"]),
    "openssl": ("openssl", ["openssl license", "ssleay license"]),
    "postgresql": ("postgresql", ["postgresql licen[sc]e"]),
    "ms-pl": ("ms pl", ["microsoft public license", "ms pl"]),
    "ms-rl": ("ms rl", ["microsoft reciprocal license", "ms rl"]),
    "eupl-1.2": ("eupl 1 [12]", ["european union public licen[sc]e( v?1 [12]| version 1 [12])?", "eupl( v1 [12])?"]),
    "ofl-1.1": ("ofl 1 1", ["sil open font license( version 1 1| 1 1)?", "open font license", "ofl 1 1"]),
    "afl-3.0": ("afl 3 0", ["academic free license( version 3 0| v3 0| 3 0)?"]),
    "osl-3.0": ("osl 3 0", ["open software license( version 3 0| v3 0| 3 0)?"]),
    "ncsa": ("ncsa", ["university of illinois ncsa open source license", "ncsa open source license"]),
    "sspl-1.0": ("sspl 1 0", ["server side public license( version 1| v1)?", "sspl( v1| 1 0)?"]),
    "busl-1.1": ("busl 1 1", ["business source license( 1 1| version 1 1)?", "busl 1 1"]),
    "elastic-2.0": ("elastic 2 0", ["elastic license( 2 0| v2| version 2 0)?"]),
}

#: (label, priority, regex): identifiers in addresses, sentences of license texts, notices.
SENTENCES = [
    ("apache-2.0", IDENTIFIER, "apache org licenses license 2 0"),
    ("mit", IDENTIFIER, "opensource org licenses mit( license)?"),
    ("isc", IDENTIFIER, "opensource org licenses isc( license)?"),
    ("bsd-2-clause", IDENTIFIER, "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", IDENTIFIER, "opensource org licenses bsd 3 clause"),
    ("gpl", IDENTIFIER, "gnu org (licenses|copyleft) gpl( html| txt)?"),
    ("gpl-2.0", IDENTIFIER, "gnu org licenses (old licenses )?gpl 2 0"),
    ("gpl-3.0", IDENTIFIER, "gnu org licenses gpl 3 0"),
    ("lgpl", IDENTIFIER, "gnu org (licenses|copyleft) lgpl( html| txt)?"),
    ("agpl", IDENTIFIER, "gnu org licenses agpl( 3 0)?( html| txt)?"),
    ("gfdl", IDENTIFIER, "gnu org (licenses|copyleft) fdl( html)?"),
    ("mpl-2.0", IDENTIFIER, "mozilla org mpl 2 0"),
    ("mpl-1.1", IDENTIFIER, "mozilla org mpl mpl 1 1"),
    ("epl-1.0", IDENTIFIER, "eclipse org legal epl v10"),
    ("epl-2.0", IDENTIFIER, "eclipse org legal epl 2 0"),
    ("boost-1.0", IDENTIFIER, "boost org license 1 0"),
    ("unlicense", IDENTIFIER, "unlicense org"),
    ("cc0-1.0", IDENTIFIER, "creativecommons org publicdomain zero 1 0"),
    ("public-domain", IDENTIFIER, "creativecommons org publicdomain mark 1 0"),
    ("cc-by", IDENTIFIER, "creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", IDENTIFIER, "creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nc", IDENTIFIER, "creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nd", IDENTIFIER, "creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc-sa", IDENTIFIER, "creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", IDENTIFIER, "creativecommons org licenses by nc nd [1-4] [05]"),
    ("odbl-1.0", IDENTIFIER, "opendatacommons org licenses odbl( 1 0)?"),
    ("odc-by-1.0", IDENTIFIER, "opendatacommons org licenses by( 1 0)?"),
    ("mit", TEXT, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", TEXT, "permission to use copy modify and( or)? distribute this software for any purpose with or without fee"),
    ("mit", TEXT, "copyright notice and this permission notice shall be included in all copies"),
    ("bsd", TEXT, "redistribution and use in source and binary forms with or without modification"),
    ("bsd", TEXT, "redistributions of source code must retain the above copyright notice"),
    ("bsd", TEXT, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", TEXT, "endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", TEXT, "advertising materials mentioning features or use of this software"),
    ("gpl", TEXT, "redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", TEXT, "redistribute it and or modify it under the terms of the gnu (lesser|library) general public license"),
    ("agpl", TEXT, "redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("apache-2.0", TEXT, "licensed under the apache license version 2 0 the license"),
    ("mpl-2.0", TEXT, "license v 2 0 if a copy of the mpl was not distributed"),
    ("zlib", TEXT, "altered source versions must be plainly marked as such"),
    ("unlicense", TEXT, "unencumbered software released into the public domain"),
    ("boost-1.0", TEXT, "permission is hereby granted free of charge to any person or organization"),
    ("wtfpl", TEXT, "wtfpl everyone is permitted to copy and distribute"),
    ("gpl", TEXT, "copyleft license( version [123])?"),
    ("public-domain", NAME, "public domain( dedication| mark)?"),
    ("public-domain", GRANT, "released (in|into|to) the public domain"),
    ("public-domain", GRANT, "dedicated to the public domain"),
    ("proprietary", GRANT, "proprietary and confidential"),
    ("proprietary", NAME, "proprietary (software )?licen[sc]e"),
    ("proprietary", NAME, "commercial (software )?licen[sc]e( agreement)?"),
    ("proprietary", TEXT, "unauthorized (copying|reproduction|distribution|use) (of this|or|is)"),
    ("proprietary", NAME, "licensed material property of"),
    ("eula", NAME, "end user licen[sc]e agreement"),
    ("reserved", TEXT, "copyright( c)? [12][0-9]{3}( [12][0-9]{3})?( [^ ]+){1,6} all rights reserved"),
    ("reserved", NAME, "all rights reserved"),
    ("copyright", HINT, "copyright( c)? [12][0-9]{3}( [12][0-9]{3})?"),
    ("copyright", HINT, "copyrighted (material|work|by)"),
    ("no-warranty", HINT, "warranty of any kind express or implied"),
    ("no-warranty", HINT, "warranties or conditions of any kind"),
    ("unknown-license", HINT, "licensed under( the| a)? [^ ]+( [^ ]+)? licen[sc]e"),
    ("unknown-license", HINT, "released under( the| a)? [^ ]+( [^ ]+)? licen[sc]e"),
]

#: Words that open a grant, and what may stand between them and a license's name.
GRANT_VERBS = ("licensed", "released", "distributed")
GRANT_LINK = "( [^ ]+)? (under|by|subject to)( the terms( and conditions)? of)?( the| a| an)?"


def _first(regex: str) -> str:
    return re.match(r"[a-z0-9]+", regex)[0]


def rules() -> list[Rule]:
    """The ordered table: by priority, then as written."""
    found: list[tuple[int, str, str, str]] = []
    for label, (identifier, names) in LICENSES.items():
        found.append((IDENTIFIER, label, "license", f"spdx license identifier {identifier}"))
        found += [(NAME, label, _first(n), n) for n in names]
        for verb in GRANT_VERBS:
            found += [(GRANT, label, _first(n), f"{verb}{GRANT_LINK} {n}") for n in names]
    found += [(priority, label, _first(regex), regex) for label, priority, regex in SENTENCES]
    found.sort(key=lambda r: r[0])
    return [Rule(k, p, label, _first(regex), must, f"^(?:{regex}) ", CONFIDENCE[p])
            for k, (p, label, must, regex) in enumerate(found)]
