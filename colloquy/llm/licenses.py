"""License scans by recognised sentences and ordered rules.

A text is cut into sentences at end marks and blank lines (a single line feed is a
space, with the comment marks around it), each normalised and looked up among known licence
sentences; what remains is the sequence of their identifiers, with one identifier for
sentences that speak of licences but are not known. Rules, longest and most special
first, are matched against the sequence; a rule takes the identifiers it covers, so a
later rule cannot use them again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from colloquy.llm.support import slabs

# fixed values: known sentences of public licences, normalised, by identifier
SENTENCES = {
    "ApacheName": r"licensed under the apache license,? version 2(\.0)?( the license)?( you may not use this file except in compliance with the license)?",
    "ApacheTerms": r"you may not use this file except in compliance with the license",
    "ApacheCopy": r"you may obtain a copy of the license at.*apache.*",
    "ApacheWarranty": r"unless required by applicable law or agreed to in writing,? software distributed under the license is distributed on an as is basis.*",
    "ApacheLanguage": r"see the license for the specific language governing permissions and limitations under the license",
    "MITName": r"(released|licensed|distributed) under the (terms of the )?mit license",
    "MITGrant": r"permission is hereby granted,? free of charge,? to any person obtaining a copy of this software.*",
    "MITNotice": r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "MITWarranty": r"the software is provided as is,? without warranty of any kind.*",
    "MITLiability": r"in no event shall the authors or copyright holders be liable for any claim,? damages or other liability.*",
    "BSDGrant": r"redistribution and use in source and binary forms,? with or without modification,? are permitted provided that the following conditions are met.*",
    "BSDSource": r"redistributions of source code must retain the above copyright notice.*",
    "BSDBinary": r"redistributions in binary form must reproduce the above copyright notice.*",
    "BSDEndorse": r"neither the name of .* may be used to endorse or promote products derived from this software.*",
    "BSDWarranty": r"this software is provided by the .* as is and any express or implied warranties.*",
    "BSDLiability": r"in no event shall .* be liable for any direct,? indirect,? incidental.*",
    "BSDName": r"(released|licensed|distributed) under the (\w+ )?bsd license",
    "GPL3Name": r"(this work is |this program is )?licensed under the gnu general public license,? version 3( or later)?",
    "GPL2Name": r"(this work is |this program is )?licensed under the gnu general public license,? version 2( or later)?",
    "GPLFree3": r"(this program is free software:? )?you can redistribute it and/or modify it under the terms of the gnu general public license.*version 3 of the license.*",
    "GPLFree2": r"(this program is free software:? )?you can redistribute it and/or modify it under the terms of the gnu general public license.*version 2 of the license.*",
    "GPLFree": r"(this program is free software:? )?you can redistribute it and/or modify it under the terms of the gnu general public license.*",
    "GPLVersion3": r"(either version 3|version 3) of the license.*",
    "GPLVersion2": r"(either version 2|version 2) of the license.*",
    "GPLWarranty": r"this program is distributed in the hope that it will be useful,? but without any warranty.*",
    "GPLReceived": r"you should have received a copy of the gnu general public license along with this program.*",
    "GPLDetails": r"see the gnu general public license for more details",
    "GPLSee": r"if not,? see .*gnu\.org/licenses.*",
    "CCBYNC": r"(this work is )?licensed under (a )?cc by-nc 4\.0",
    "CCBYSA": r"(this work is )?licensed under (a )?cc by-sa 4\.0",
    "CCBY": r"(this work is )?licensed under (a )?cc by 4\.0",
    "SPDXApache": r"spdx-license-identifier: apache-2\.0",
    "SPDXMIT": r"spdx-license-identifier: mit",
    "LGPLFree21": r"(this (program|library) is free software:? )?you can redistribute it and/or modify it under the terms of the gnu lesser general public license.*version 2\.1 of the license.*",
    "LGPLFree3": r"(this (program|library) is free software:? )?you can redistribute it and/or modify it under the terms of the gnu lesser general public license.*version 3 of the license.*",
    "LGPLFree": r"(this (program|library) is free software:? )?you can redistribute it and/or modify it under the terms of the gnu lesser general public license.*",
    "LGPLVersion21": r"(either )?version 2\.1 of the license.*",
    "AGPLFree3": r"(this program is free software:? )?you can redistribute it and/or modify it under the terms of the gnu affero general public license.*version 3 of the license.*",
    "AGPLFree": r"(this program is free software:? )?you can redistribute it and/or modify it under the terms of the gnu affero general public license.*",
    "LGPLWarranty": r"this library is distributed in the hope that it will be useful,? but without any warranty.*",
    "LGPLReceived": r"you should have received a copy of the gnu (lesser|affero) general public license along with this (program|library).*",
    "LGPLDetails": r"see the gnu (lesser|affero) general public license for more details",
    "MPLTerms": r"this source code form is subject to the terms of the mozilla public license(,? v(\. ?2\.0)?)?",
    "ISCGrant": r"permission to use,? copy,? modify,? and/?(or)? ?distribute this software for any purpose with or without fee is hereby granted.*",
    "ISCWarranty": r"the software is provided as is and the author disclaims all warranties.*",
    "ISCLiability": r"in no event shall the author be liable for any special,? direct.*",
    "BoostGrant": r"distributed under the boost software license,? version 1\.0",
    "UnlicenseGrant": r"this is free and unencumbered software released into the public domain",
    "SPDX": r"spdx-license-identifier: ([\w.+-]+(?: (?:and|or|with) [\w.+-]+)*)",
    "Rights": r".*all rights reserved",
    "Copyright": r"copyright (c )?\d{4}\b.*",
}
# fixed values: names by which licences are called in a sentence
NAMES = {
    "MIT": r"mit( license)?",
    "ISC": r"isc( license)?",
    "Apache-2.0": r"apache( software)? license,?( version| v)? ?2(\.0)?|apache[- ]2(\.0)?( license)?",
    "BSD-3-Clause": r"(3-clause|three-clause|new|modified|revised) bsd( license)?|bsd[- ]3-clause( license)?",
    "BSD-2-Clause": r"(2-clause|two-clause|simplified) bsd( license)?|bsd[- ]2-clause( license)?",
    "LGPL-2.1": r"(gnu )?(lesser general public license|lgpl),?( version| v)?[ -]?2\.1( or( any)? later( version)?)?",
    "LGPL-3.0": r"(gnu )?(lesser general public license|lgpl),?( version| v)?[ -]?3(\.0)?( or( any)? later( version)?)?",
    "AGPL-3.0": r"(gnu )?(affero general public license|agpl),?( version| v)?[ -]?3(\.0)?( or( any)? later( version)?)?",
    "GPL-2.0": r"(gnu )?(general public license|gpl),?( version| v)?[ -]?2(\.0)?( or( any)? later( version)?)?",
    "GPL-3.0": r"(gnu )?(general public license|gpl),?( version| v)?[ -]?3(\.0)?( or( any)? later( version)?)?",
    "MPL-2.0": r"mozilla public license,?( version| v)? ?2(\.0)?|mpl[- ]?2(\.0)?",
    "EPL-2.0": r"eclipse public license,?( version| v)? ?-? ?2(\.0)?|epl[- ]?2(\.0)?",
    "BSL-1.0": r"boost software license,?( version| v)? ?1\.0",
    "Zlib": r"zlib( license)?",
    "Unlicense": r"unlicense",
    "CC0-1.0": r"(creative commons )?cc0( 1\.0)?( universal)?( license)?",
}
#: what leads up to a licence's name in a sentence
_UNDER = r"(?:(?:this|the) (?:\w+ ){1,2}(?:is|are) |it is )?(?:released|licensed|distributed|available|made available|provided) under (?:the terms of )?(?:the |an? )?"
# fixed values: licences by the identifiers that show them, the first that fits is taken
RULES = (
    ("Apache-2.0", ("ApacheName", "ApacheTerms", "ApacheCopy", "ApacheWarranty", "ApacheLanguage")),
    ("Apache-2.0", ("ApacheName", "ApacheCopy", "ApacheWarranty", "ApacheLanguage")),
    ("MIT", ("MITGrant", "MITNotice", "MITWarranty", "MITLiability")),
    ("BSD-3-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse", "BSDWarranty")),
    ("BSD-2-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDWarranty")),
    ("GPL-3.0", ("GPLFree", "GPLVersion3", "GPLWarranty", "GPLReceived")),
    ("GPL-2.0", ("GPLFree", "GPLVersion2", "GPLWarranty", "GPLReceived")),
    ("GPL-3.0", ("GPLFree", "GPLVersion3")),
    ("GPL-2.0", ("GPLFree", "GPLVersion2")),
    ("MIT", ("MITGrant", "MITNotice")),
    ("Apache-2.0", ("ApacheName", "ApacheTerms")),
    ("GPL-3.0", ("GPLFree3",)),
    ("GPL-2.0", ("GPLFree2",)),
    ("GPL-unversioned", ("GPLFree",)),
    ("Apache-2.0", ("ApacheName",)),
    ("MIT", ("MITName",)),
    ("BSD", ("BSDName",)),
    ("GPL-3.0", ("GPL3Name",)),
    ("GPL-2.0", ("GPL2Name",)),
    ("CC-BY-NC-4.0", ("CCBYNC",)),
    ("CC-BY-SA-4.0", ("CCBYSA",)),
    ("CC-BY-4.0", ("CCBY",)),
    ("Apache-2.0", ("SPDXApache",)),
    ("MIT", ("SPDXMIT",)),
    ("LGPL-2.1", ("LGPLFree", "LGPLVersion21")),
    ("LGPL-3.0", ("LGPLFree", "GPLVersion3")),
    ("AGPL-3.0", ("AGPLFree", "GPLVersion3")),
    ("LGPL-2.1", ("LGPLFree21",)),
    ("LGPL-3.0", ("LGPLFree3",)),
    ("AGPL-3.0", ("AGPLFree3",)),
    ("LGPL-unversioned", ("LGPLFree",)),
    ("AGPL-unversioned", ("AGPLFree",)),
    ("MPL-2.0", ("MPLTerms",)),
    ("ISC", ("ISCGrant",)),
    ("BSL-1.0", ("BoostGrant",)),
    ("Unlicense", ("UnlicenseGrant",)),
    ("Proprietary", ("Rights",)),
)
UNKNOWN = "Unknown"
#: most lines of a known sentence that stands unpunctuated among others
LINES = 24
#: what a sentence has to hold to be looked at
_HINTS = re.compile(r"licen[sc]|copyright|permission|redistribut|warrant|liab|rights reserved|public domain|spdx|copyleft|\b[al]?gpl\b|(released|distributed|available|provided) under|you may (not use|obtain)|version [23] of")
#: what makes an unrecognised sentence one that speaks of licences
_SPEAKS = re.compile(r"licen[sc]|copyright|redistribut|copyleft|spdx")
_ENDS = re.compile(r"(?<=[.!?;])\s+|\n(?:[ \t]*\n)+")
#: comment marks, bullets and indentation at the start of a line, and comment ends
_MARKS = re.compile(r"^[ \t]*(?:(?:/\*+|\*+/?|//+!?|#+|--+|;+|<!--|%+|\bdnl\b|\brem\b|\([0-9a-z]\))[ \t]*)*|(?<![ \t])[ \t]*(?:(?:\*+/|-->)[ \t]*)?\r?$", re.M | re.I)
#: an address that stands alone on its line belongs to what leads up to it
_ADDRESS = re.compile(r"(?<![.!?;\n])\n(?:[ \t]*\n)*(?=<?https?://\S+\n)")
_BARE = re.compile(r"[^\w.,/:+-]+")
SCHEMA = "doc_id long, sentence_ids array<string>, licenses array<string>"


class Scanner:
    def __init__(self, sentences: dict[str, str] = SENTENCES, rules: Sequence[tuple[str, tuple[str, ...]]] = RULES):
        self.known = [(name, re.compile(pattern)) for name, pattern in sentences.items()]
        self.known += [(f"Name:{name}", re.compile(f"{_UNDER}(?:{pattern})")) for name, pattern in NAMES.items()]
        self.rules = [*rules, *((name, (f"Name:{name}",)) for name in NAMES)]
        self.spelled = {x.lower(): x for x in [*NAMES, *(name for name, _ in rules)]} | {x: x.upper() for x in ("and", "or", "with")}

    @staticmethod
    def normalise(sentence: str) -> str:
        """Lower case, marks apart from those within names gone, one space between words, no point at the end."""
        return " ".join(_BARE.sub(" ", sentence.lower()).split()).replace(" ,", ",").strip(".,:;- ")

    def identifiers(self, text: str) -> list[str]:
        """Identifiers of the licence sentences of a text, in order."""
        if not _HINTS.search(text.lower()):
            return []
        out = []
        for sentence in _ENDS.split(_ADDRESS.sub(" ", _MARKS.sub("", text) + "\n")):
            if _HINTS.search(" ".join(sentence.lower().split())):
                out += self._named(sentence.split("\n"))
        return out

    def _name(self, plain: str) -> str | None:
        """Identifier of a known sentence; an SPDX line has one by its expression, in which known names have their spelling."""
        for name, pattern in self.known:
            if found := pattern.fullmatch(plain):
                return f"SPDX:{' '.join(self.spelled.get(x, x) for x in found[1].split())}" if name == "SPDX" else name
        return None

    def _named(self, lines: list[str]) -> list[str]:
        """Identifiers of a sentence: of the whole, else of the longest runs of its lines that are known, and of the lines between."""
        name = self._name(self.normalise(" ".join(lines)))
        if name:
            return [name]
        out, rest, begin = [], [], 0
        # a known sentence has few lines
        while begin < len(lines):
            ends = range(min(len(lines), begin + LINES), begin, -1) if len(lines) > 1 else ()
            name, end = next(((x, k) for k in ends if (x := self._name(self.normalise(" ".join(lines[begin:k]))))), (None, begin + 1))
            if name is None:
                rest.append(lines[begin])
            if (name or end == len(lines)) and rest:
                out += [UNKNOWN] if _SPEAKS.search(self.normalise(" ".join(rest))) else []
                rest = []
            out += [name] if name else []
            begin = end
        return out

    def licenses(self, identifiers: list[str]) -> list[str]:
        """Licences that the rules find in a sequence, by where they begin; ``Unknown`` for sentences left over.

        An SPDX expression is a licence as it stands. Reserved rights are one only where no licence comes behind them.
        """
        left: list[str | None] = list(identifiers)
        found: list[tuple[int, str]] = []
        for name, rule in self.rules:
            at = 0
            while at + len(rule) <= len(left):
                if tuple(left[at: at + len(rule)]) == rule:
                    left[at: at + len(rule)] = [None] * len(rule)
                    found.append((at, name))
                    at += len(rule)
                else:
                    at += 1
        found += [(k, x[5:]) for k, x in enumerate(left) if x and x.startswith("SPDX:")]
        last = max((k for k, name in found if name != "Proprietary"), default=-1)
        found = [(k, name) for k, name in found if name != "Proprietary" or k > last]
        found += [(k, UNKNOWN) for k, x in enumerate(left) if x == UNKNOWN]
        return list(dict.fromkeys(name for _, name in sorted(found)))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_ids, licenses) of every row of (doc_id, text).

    ``licenses`` are distinct, in the order in which they begin. A text without
    licence sentences, null and empty ones too, has empty lists. A null doc_id is
    carried through, repeated rows are scanned each, other columns are ignored, an
    empty table gives no rows. Whole texts are read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in slabs(batches, "text"):
            found = [scanner.identifiers(x or "") for x in batch.column("text").to_pylist()]
            lists = [pa.array(x, pa.list_(pa.string())) for x in (found, [scanner.licenses(x) for x in found])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *lists], names=["doc_id", "sentence_ids", "licenses"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
