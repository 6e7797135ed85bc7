"""License scans by sentence rules.

A text's sentences (lines, cut after . ! ? or ; before a space; and joins of
consecutive such pieces over line ends that no ! ? ; or blank line comes before,
the longest known one first) are normalised:
A-Z in lower case, every run of characters other than letters, digits, dots and
plus signs one space, dots and spaces at the ends gone. A table maps known
license sentences to identifiers. The sequence of a text's identifiers, cut
where more than `gap` other sentences (pieces with a letter or digit) come between, is matched from left to
right against ordered rules: at each place the first rule of the list that fits
wins and its sentences are used up; a sentence that begins no rule is passed.
A sentence may have a slot for a holder's name. An SPDX line may be an
expression (A OR B, A AND B, A WITH B) of known identifiers, older names
included. A sentence that ends in `licensed under ...` or `released under ...`
counts by that end.

A null or empty text has no sentences. Null ids and repeated rows keep a row
each; extra columns go. All texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_rows

#: Sentences of public licenses and notices, normalised, by identifier.
SENTENCES = {
    "all-rights": "all rights reserved",
    "apache-under": "licensed under the apache license version 2.0",
    "apache-the-license": "licensed under the apache license version 2.0 the license",
    "apache-not-use": "you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-released": "released under the mit license",
    "mit-under": "licensed under the mit license",
    "mit-title": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl3-under": "licensed under the gnu general public license version 3",
    "gpl2-under": "licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-under": "licensed under the bsd license",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-subject": "this source code form is subject to the terms of the mozilla public license v. 2.0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc-by": "licensed under cc by 4.0",
    "cc-by-sa": "licensed under cc by sa 4.0",
    "cc-by-nc": "licensed under cc by nc 4.0",
    "cc-by-nc-sa": "licensed under cc by nc sa 4.0",
    "cc0": "licensed under cc0 1.0",
    "cc-by-work": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc-by-sa-work": "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "epl2-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl 2.0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0",
}
#: Rules in order: longer ones come before the ones that they begin with.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("Apache-2.0", ("apache-the-license", "apache-not-use", "apache-obtain", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-the-license", "apache-not-use")),
    ("Apache-2.0", ("apache-under",)),
    ("Apache-2.0", ("apache-the-license",)),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-under",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-details")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-3.0-only", ("gpl3-work",)),
    ("GPL-3.0-only", ("gpl3-under",)),
    ("GPL-2.0-only", ("gpl2-under",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-2-Clause", ("bsd-grant",)),
    ("BSD", ("bsd-under",)),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl-subject", "mpl-copy")),
    ("MPL-2.0", ("mpl-subject",)),
    ("Unlicense", ("unlicense",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-work",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-4.0", ("cc-by-work",)),
    ("CC0-1.0", ("cc0",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("EPL-2.0", ("epl2-terms",)),
    ("LicenseRef-all-rights-reserved", ("all-rights",)),
]
#: Identifiers that a line "SPDX-License-Identifier: ..." may name.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "PostgreSQL", "Unlicense", "Zlib",
)
#: Family, its name in the notice, version; the older notices have semicolons after "free software" and "foundation".
GNU = (("GPL", "", "2"), ("LGPL", "lesser ", "2.1"), ("LGPL", "lesser ", "3"), ("AGPL", "affero ", "3"))
for _id in SPDX:
    SENTENCES[f"spdx-{_id}"] = f"spdx license identifier {' '.join(_id.lower().split('-'))}"
    RULES.append((_id, (f"spdx-{_id}",)))
for _family, _name, _version in GNU:
    _published = f"you can redistribute it and or modify it under the terms of the gnu {_name}general public license as published by the free software foundation"
    _either = f"either version {_version} of the license or at your option any later version"
    _terms = f"{_published} {_either}"
    _id = f"{_family}-{_version if '.' in _version else _version + '.0'}-or-later"
    for _head in ("", "this program is free software ", "this library is free software "):
        SENTENCES[f"{_id}-{_head[5:12] or 'terms'}"] = _head + _terms
        RULES.append((_id, (f"{_id}-{_head[5:12] or 'terms'}",)))
    SENTENCES |= {f"gnu-{_family}-published": _published, f"gnu-either-{_version}": _either}
    RULES.append((_id, (f"gnu-{_family}-published", f"gnu-either-{_version}")))
#: Titles of whole licenses, sentences that name one, and variants of grants.
NAMED = {
    "Apache-2.0": ("apache license version 2.0 january 2004", "licensed under the apache license 2.0", "licensed under apache 2.0"),
    "GPL-2.0-only": ("gnu general public license version 2 june 1991", "licensed under the gnu general public license v2.0", "licensed under the gpl version 2", "licensed under the gplv2"),
    "GPL-3.0-only": ("gnu general public license version 3 29 june 2007", "licensed under the gnu general public license v3.0", "licensed under the gpl version 3", "licensed under the gplv3"),
    "LGPL-2.1-only": ("gnu lesser general public license version 2.1 february 1999", "licensed under the gnu lesser general public license version 2.1"),
    "LGPL-3.0-only": ("gnu lesser general public license version 3 29 june 2007", "licensed under the gnu lesser general public license version 3", "licensed under the gnu lesser general public license v3.0"),
    "AGPL-3.0-only": ("gnu affero general public license version 3 19 november 2007", "licensed under the gnu affero general public license version 3"),
    "MPL-2.0": ("mozilla public license version 2.0", "licensed under the mozilla public license 2.0", "licensed under the mozilla public license version 2.0"),
    "BSD-3-Clause": ("licensed under the bsd 3 clause license", "licensed under the 3 clause bsd license"),
    "BSD-2-Clause": ("licensed under the bsd 2 clause license", "licensed under the 2 clause bsd license"),
    "ISC": ("permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "licensed under the isc license"),
    "0BSD": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "CC-BY-4.0": ("licensed under a creative commons attribution 4.0 international license", "licensed under the creative commons attribution 4.0 international license", "the creative commons attribution 4.0 international license"),
    "CC-BY-SA-4.0": ("licensed under a creative commons attribution sharealike 4.0 international license", "licensed under the creative commons attribution sharealike 4.0 international license"),
    "CC0-1.0": ("cc0 1.0 universal", "creative commons legal code cc0 1.0 universal"),
}
for _id, _texts in NAMED.items():
    for _k, _text in enumerate(_texts):
        SENTENCES[f"{_id}-named-{_k}"] = _text
        RULES.append((_id, (f"{_id}-named-{_k}",)))
for _id in SPDX:
    SENTENCES[f"field-{_id}"] = f"license {' '.join(_id.lower().split('-'))}"
    RULES.append((_id, (f"field-{_id}",)))
#: Older SPDX names and what they are called now, and exceptions that may follow WITH.
OLD_SPDX = {f"{n}{plus}": f"{n}-{'or-later' if plus else 'only'}" for n in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for plus in ("", "+")}
SPDX_EXCEPTIONS = ("Classpath-exception-2.0", "GCC-exception-3.1", "LLVM-exception")
_SPDX_NAMES = {" ".join(n.lower().split("-")): OLD_SPDX.get(n, n) for n in (*SPDX, *OLD_SPDX, *SPDX_EXCEPTIONS)}
SPDX_HEAD = "spdx license identifier "
#: The clause with a slot: whatever holder it names, it reads as the first.
HOLDER, SLOT = "neither the name of the copyright holder", re.compile(r"neither the names? of (?:(?! nor ).){1,300} nor the names? of (?:its|their|any) contributors ")
UNDER = ("licensed under ", "released under ")
CUT = re.compile(r"\n|(?<=[.!?;])[ \t\r\f\v]+")
WORD = re.compile(r"[a-z0-9.+]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
Match = tuple[str, int, int]


def normalised(sentence: str) -> str:
    return " ".join(w for w in WORD.findall(sentence.translate(_LOWER))).strip(" .")


def spdx_expression(sentence: str) -> str | None:
    """The expression that a normalised SPDX line names, None unless all of it is known."""
    words = re.split(r" (or|and|with) ", sentence.removeprefix(SPDX_HEAD))
    if any(w not in _SPDX_NAMES for w in words[::2]):
        return None
    return " ".join(_SPDX_NAMES[w] if k % 2 == 0 else w.upper() for k, w in enumerate(words))


def holder_slot(sentence: str) -> str:
    """A clause about a holder's name as the one about the copyright holder; as far as it goes, where it isn't whole."""
    if not sentence.startswith("neither the name") or len(sentence) > 600:
        return sentence
    whole = SLOT.sub(f"{HOLDER} nor the names of its contributors ", sentence, count=1)
    return HOLDER if whole == sentence and " nor " not in sentence and len(sentence) > 20 else whole


class Recogniser:
    """Known sentences and rules, ready to match."""

    def __init__(self, sentences: dict[str, str], rules: list[tuple[str, tuple[str, ...]]], gap: int = 1):
        self.known = {text: name for name, text in sentences.items()}
        self.first = {text.split(" ")[0] for text in self.known}
        #: What known sentences begin with, cut at words: a join goes on while it is one of these.
        self.heads = {text[: m.start()] for text in self.known for m in re.finditer(" ", text)}
        self.rules = rules
        self.gap = gap

    def name(self, sentence: str) -> str | None:
        """The identifier of a normalised sentence."""
        if sentence.startswith(SPDX_HEAD) and sentence not in self.known and (expression := spdx_expression(sentence)):
            return f"spdx:{expression}"
        return self.known.get(sentence) or self.named_at_end(sentence)

    def named_at_end(self, sentence: str) -> str | None:
        """The identifier of a sentence whose end says under what something is licensed."""
        at = max(sentence.rfind(f" {words}") for words in UNDER)
        return self.known.get(sentence[at + 1 :]) if at >= 0 else None

    def identifiers(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """(identifier, numbers of the first and last piece, start, end) of the known sentences."""
        pieces, start = [], 0  # number (-1: nothing but marks or space), start, end
        number = 0
        for end, after in [*((m.start(), m.end()) for m in CUT.finditer(text)), (len(text), 0)]:
            some = any(map(str.isalnum, text[start:end]))
            pieces.append((number if some else -1, start, end))
            number += some
            start = after
        found, k = [], 0
        while k < len(pieces):
            number, start, end = pieces[k]
            k += 1
            if number < 0:
                continue
            raw = text[start:end]
            first = WORD.search(raw.translate(_LOWER) if len(raw) < 64 else raw[:64].translate(_LOWER))
            # a first word past the 64th character, or cut by it, is looked at in whole
            if not (first is None or first.end() >= 64 or first[0].strip(".") in self.first or not first[0].strip(".")):
                if "nder" in raw and (name := self.named_at_end(normalised(raw))):
                    found.append((name, number, number, start, end))
                continue
            joined, at, best = "", k - 1, None
            while True:
                joined = f"{joined} {' '.join(WORD.findall(text[pieces[at][1] : pieces[at][2]].translate(_LOWER)))}".strip(" ").lstrip(" .")
                joined = holder_slot(joined)
                if name := self.name(joined.rstrip(" .")):
                    best = (name, number, pieces[at][0], start, pieces[at][2])
                    k = at + 1
                if joined not in self.heads or text[start : pieces[at][2]].rstrip()[-1] in "!?;":
                    break
                at += 1
                if at == len(pieces) or pieces[at][0] < 0:
                    break
            if best:
                found.append(best)
        return found

    def matches(self, text: str) -> list[Match]:
        """(license, start, end) from left to right; code points of the text, end exclusive."""
        return self.matched(self.identifiers(text))

    def matched(self, ids: list[tuple[str, int, int, int, int]]) -> list[Match]:
        out, k = [], 0
        while k < len(ids):
            if ids[k][0].startswith("spdx:"):  # an expression is its own rule
                out.append((ids[k][0][5:], ids[k][3], ids[k][4]))
                k += 1
                continue
            for name, rule in self.rules:
                part = ids[k : k + len(rule)]
                if tuple(p[0] for p in part) == rule and all(b[1] - a[2] <= self.gap + 1 for a, b in zip(part[:-1], part[1:], strict=True)):
                    out.append((name, part[0][3], part[-1][4]))
                    k += len(rule)
                    break
            else:
                k += 1
        return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None, rules: list[tuple[str, tuple[str, ...]]] | None = None, gap: int = 1) -> DataFrame:
    """(doc_id, n_sentences_known, licenses, spans, matches) of each row of docs.

    licenses: distinct names in order of their first match, comma-joined;
    spans: license:start:end, comma-joined; matches: the same as an array.
    """
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recogniser = Recogniser(sentences or SENTENCES, rules or RULES, gap)
        for batch in it:
            known, names, spans, found = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = recogniser.identifiers(text or "")
                m = recogniser.matched(ids)
                known.append(len(ids))
                names.append(",".join(dict.fromkeys(x[0] for x in m)))
                spans.append(",".join(f"{n}:{s}:{e}" for n, s, e in m))
                found.append([{"license": n, "start": s, "end": e} for n, s, e in m])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(known, pa.int64()), pa.array(names, pa.string()), pa.array(spans, pa.string()), pa.array(found, kind)], names=["doc_id", "n_sentences_known", "licenses", "spans", "matches"])

    return text_rows(docs, id_col, text_col).mapInArrow(batches, "doc_id long, n_sentences_known long, licenses string, spans string, matches array<struct<license:string,start:long,end:long>>")
