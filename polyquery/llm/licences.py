"""Licence recognition by sentences and ordered rules.

A text is cut into sentences; each is normalised (lower case, letters and digits
with single blanks) and looked up among known licence sentences, which gives the
text a sequence of sentence identifiers. Rules, in order, match runs of
identifiers; sentences that a rule has used are not used again, so a full
licence text wins over the short notices inside it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from polyquery.llm.common import ship, sliced, texts, trimmed

#: Known sentences, normalised, as patterns for the whole sentence (fixed values from the public licence texts).
SENTENCES = {
    "apache2_notice": r"(this (file|work|software|project) is )?(licensed|released|distributed) under the apache license version 2( 0)?( the license)?",
    "apache2_comply": r"(you may not use this file except in compliance with the license)",
    "apache2_obtain": r"you may obtain a copy of the license at( .*)?",
    "apache2_unless": r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2_see": r"see the license for the specific language governing permissions and limitations under the license",
    "mit_notice": r"(this (file|work|software|project) is )?(licensed|released|distributed) under the (terms of the )?mit license",
    "mit_grant": r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction.*",
    "mit_include": r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_as_is": r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit_liable": r"in no event shall the authors or copyright holders be liable for any claim damages or other liability.*",
    "bsd_grant": r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": r"(1 )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": r"(2 )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_endorse": r"(3 )?neither the name of .* nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_notice": r"(licensed|released|distributed) under (the|a) (2 clause |3 clause |new |modified |simplified )?bsd( 2 clause| 3 clause)? license",
    "gpl2_notice": r"(this (file|work|software|program) is )?(licensed|released|distributed) under the gnu general public license version 2( 0)?",
    "gpl3_notice": r"(this (file|work|software|program) is )?(licensed|released|distributed) under the gnu general public license version 3( 0)?",
    "gpl2_later": r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl3_later": r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl_useful": r"this (program|library) is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl_details": r"see the gnu (lesser |affero )?general public license for more details",
    "gpl_received": r"you should have received a copy of the gnu (lesser |affero )?general public license along with this (program|library)",
    "lgpl21_later": r"this (program|library) is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3_later": r"this (program|library) is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3_later": r"this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21_notice": r".*(licensed|released|distributed) under the gnu lesser general public license version 2 1",
    "lgpl3_notice": r".*(licensed|released|distributed) under the gnu lesser general public license version 3( 0)?",
    "agpl3_notice": r".*(licensed|released|distributed) under the gnu affero general public license version 3( 0)?",
    "mpl2_notice": r"this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2_copy": r"if a copy of the mpl was not distributed with this file you can obtain one at .*",
    "isc_grant": r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": r"this is free and unencumbered software released into the public domain",
    "cc0_notice": r".*(licensed|released|dedicated) .*(cc0|creative commons zero)( .*)?",
    "ccby_notice": r".*licensed under (a |the )?(cc by|creative commons attribution)( (4 0|3 0|2 0))?( (international|unported|generic))?( license)?",
    "ccbysa_notice": r".*licensed under (a |the )?(cc by sa|creative commons attribution share ?alike)( (4 0|3 0|2 0))?( (international|unported|generic))?( license)?",
    "ccbync_notice": r".*licensed under (a |the )?(cc by nc|creative commons attribution non ?commercial)( (4 0|3 0|2 0))?( (international|unported|generic))?( license)?",
    "ccbynd_notice": r".*licensed under (a |the )?(cc by nd|creative commons attribution no ?derivatives)( (4 0|3 0|2 0))?( (international|unported|generic))?( license)?",
    "ccbyncsa_notice": r".*licensed under (a |the )?(cc by nc sa|creative commons attribution non ?commercial share ?alike)( (4 0|3 0|2 0))?( (international|unported|generic))?( license)?",
    "ccbyncnd_notice": r".*licensed under (a |the )?(cc by nc nd|creative commons attribution non ?commercial no ?derivatives)( (4 0|3 0|2 0))?( (international|unported|generic))?( license)?",
    "zlib_as_is": r"this software is provided as is without any express or implied warranty",
    "zlib_liable": r"in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib_grant": r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib_origin": r"(1 )?the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "boost_grant": r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software.*",
    "boost_notice": r"(licensed|released|distributed) under the boost software license version 1 0",
    "epl2_notice": r"this program and the accompanying materials are made available under the terms of the eclipse public license( v| version)? 2 0( which is available at .*)?",
    "mpl11_notice": r"the contents of this file are subject to the mozilla public license version 1 1 the license",
    "cddl_notice": r"the contents of this file are subject to the terms of the common development and distribution license the license",
    "eupl12_notice": r"licensed under the eupl version 1 2( only| or later)?",
    "zero_bsd_grant": r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc_as_is": r"the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc_liable": r"in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits.*",
    "json_good": r"the software shall be used for good not evil",
    "ofl_notice": r"this font software is licensed under the sil open font license version 1 1",
    "postgresql_grant": r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "artistic2_notice": r"(licensed|released|distributed) under the (terms of the )?artistic license( version)? 2 0",
    "unlicense_free": r"anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "wtfpl_verbatim": r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "beerware": r"as long as you retain this notice you can do whatever you want with this stuff",
    "bsd_as_is": r"this software is provided by the (copyright holders and contributors|regents and contributors|author) as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "spdx": r"spdx license identifier .*",
}

#: Rules in order: licence and the sentence identifiers that stand for it, one after the other ("?" may be missing).
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("Apache-2.0", ("apache2_notice", "apache2_comply", "apache2_obtain?", "apache2_unless", "apache2_see")),
    ("JSON", ("mit_grant", "mit_include", "json_good", "mit_as_is?", "mit_liable?")),
    ("MIT", ("mit_grant", "mit_include", "mit_as_is", "mit_liable?")),
    ("MIT-0", ("mit_grant", "mit_as_is", "mit_liable?")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_as_is?")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_as_is?")),
    ("GPL-3.0-or-later", ("gpl3_later", "gpl_useful?", "gpl_details?", "gpl_received?")),
    ("GPL-2.0-or-later", ("gpl2_later", "gpl_useful?", "gpl_details?", "gpl_received?")),
    ("LGPL-3.0-or-later", ("lgpl3_later", "gpl_useful?", "gpl_details?", "gpl_received?")),
    ("LGPL-2.1-or-later", ("lgpl21_later", "gpl_useful?", "gpl_details?", "gpl_received?")),
    ("AGPL-3.0-or-later", ("agpl3_later", "gpl_useful?", "gpl_details?", "gpl_received?")),
    ("MPL-2.0", ("mpl2_notice", "mpl2_copy?")),
    ("ISC", ("isc_grant", "isc_as_is?", "isc_liable?")),
    ("ISC", ("isc_grant", "mit_as_is?")),
    ("0BSD", ("zero_bsd_grant", "isc_as_is", "isc_liable?")),
    ("0BSD", ("zero_bsd_grant",)),
    ("Zlib", ("zlib_as_is?", "zlib_liable?", "zlib_grant", "zlib_origin?")),
    ("BSL-1.0", ("boost_grant",)),
    ("PostgreSQL", ("postgresql_grant",)),
    ("Unlicense", ("unlicense", "unlicense_free?")),
    ("WTFPL", ("wtfpl_verbatim",)),
    ("Beerware", ("beerware",)),
    ("Apache-2.0", ("apache2_notice",)),
    ("MIT", ("mit_notice",)),
    ("BSD", ("bsd_notice",)),
    ("GPL-2.0-only", ("gpl2_notice",)),
    ("GPL-3.0-only", ("gpl3_notice",)),
    ("LGPL-2.1-only", ("lgpl21_notice",)),
    ("LGPL-3.0-only", ("lgpl3_notice",)),
    ("AGPL-3.0-only", ("agpl3_notice",)),
    ("MPL-1.1", ("mpl11_notice",)),
    ("EPL-2.0", ("epl2_notice",)),
    ("CDDL-1.0", ("cddl_notice",)),
    ("EUPL-1.2", ("eupl12_notice",)),
    ("BSL-1.0", ("boost_notice",)),
    ("OFL-1.1", ("ofl_notice",)),
    ("Artistic-2.0", ("artistic2_notice",)),
    ("CC-BY-NC-SA", ("ccbyncsa_notice",)),
    ("CC-BY-NC-ND", ("ccbyncnd_notice",)),
    ("CC-BY-ND", ("ccbynd_notice",)),
    ("CC-BY-NC", ("ccbync_notice",)),
    ("CC-BY-SA", ("ccbysa_notice",)),
    ("CC-BY", ("ccby_notice",)),
    ("CC0-1.0", ("cc0_notice",)),
    ("SPDX", ("spdx",)),
]

#: Every known sentence has one of these, each within one word, so line ends and marks can't part it; texts without any are done after one look.
SIGNS = r"(?i:licen[sc]e|permission|redistribut|copyright|warrant|mozilla|unencumbered|cc0|commons|liable|misrepresented|distribute|evil|stuff|eupl)|(?:^|[^0-9A-Za-z])[Mm][Pp][Ll](?:[^0-9A-Za-z]|$)"
#: Characters of a sentence that runs over pieces, at least; known ones without a free part are far shorter.
LONGEST = 1200
_END = re.compile(r"(?:[.!?:;]+(?=\s)|[.!?:;]+\Z|\n+)")
_OTHER = re.compile(r"[^0-9a-z]+")
_ANCHOR = re.compile(r"licensed|released|distributed|dedicated")


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, normalised) of the sentences of a text: cut at line ends and at marks before white space."""
    out, at = [], 0
    for m in _END.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return [(a, b, n) for a, b in out if (n := _OTHER.sub(" ", text[a:b].lower()).strip())]


def alternatives(pattern: str) -> list[str]:
    """All that a pattern of letters, groups, "?" and ".*" stands for; ".*" stays."""

    def several(at: int) -> tuple[list[str], int]:
        out, now = [], [""]
        while at < len(pattern) and pattern[at] != ")":
            if pattern[at] == "|":
                out, now, at = out + now, [""], at + 1
                continue
            if pattern[at] == "(":
                item, at = several(at + 1)
                at += 1
            elif pattern.startswith(".*", at):
                item, at = [".*"], at + 2
            else:
                item, at = [pattern[at]], at + 1
            if pattern[at : at + 1] == "?":
                item, at = ["", *item], at + 1
            now = [x + y for x in now for y in item]
        return out + now, at

    return several(0)[0]


@lru_cache(1)
def _known() -> list[tuple[str, re.Pattern, re.Pattern, bool, bool]]:
    """Name, pattern, pattern without a free start, whether its start is free and whether it has a free part inside."""
    out = []
    for name, pattern in SENTENCES.items():
        bare = pattern.removeprefix(".*")
        inside = any(".*" in x.removesuffix(".*") for x in alternatives(bare))
        out.append((name, re.compile(pattern), re.compile(bare), bare != pattern, inside))
    return out


@lru_cache(1)
def _beginnings() -> tuple[set[str], set[str], tuple[str, ...]]:
    """What known sentences begin with, at word ends: what must go on, what may go on freely at its end, and what a free part inside follows."""
    more, free, inside = set(), set(), set()
    for pattern in SENTENCES.values():
        for text in alternatives(pattern.removeprefix(".*")):
            head, star, rest = text.partition(".*")
            words = head.split()
            more.update(" ".join(words[:k]) for k in range(1, len(words)))
            if star and rest:
                inside.add(" ".join(words))
            elif star and head.endswith(" "):
                free.add(" ".join(words))
    return more, free, tuple(inside)


def identify(normalised: str) -> str | None:
    """The identifier of a known sentence; the first pattern that matches all of it."""
    for name, pattern, *_ in _known():
        if pattern.fullmatch(normalised):
            return name
    return None


def _from(parts: list[tuple[int, int, str]], i: int) -> tuple[int, str, bool] | None:
    """(last piece, identifier, whether a free part runs over pieces) of the longest known sentence that begins in piece i.

    Pieces are joined as long as they are the beginning of a known sentence. One
    with a free start begins at its first own word, so it takes no earlier piece.
    """
    more, free, inside = _beginnings()
    joined = parts[i][2]
    name = identify(joined)
    best = (i, name, False) if name else None
    starts = sorted({0, *(m.start() for m in _ANCHOR.finditer(joined))})
    for j in range(i + 1, len(parts)):
        tails = [(s, joined[s:]) for s in starts]
        kept = [s for s, t in tails if t in more or best is None and (t in free or any(t == h or t.startswith(h + " ") for h in inside))]
        if not kept or len(joined) > LONGEST:
            break
        starts = kept
        joined = f"{joined} {parts[j][2]}"
        for name, _, bare, leading, wild in _known():
            if any((leading or not s) and bare.fullmatch(joined, s) for s in starts):
                best = (j, name, wild)
                break
    return best


def known_sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, identifier) of known sentences; one that runs over lines or marks is joined.

    A free part that runs over pieces takes no other known sentence.
    """
    parts = sentences(text)
    out, i = [], 0
    while i < len(parts):
        found = _from(parts, i)
        if found and not (found[2] and any(_from(parts, k) for k in range(i + 1, found[0] + 1))):
            out.append((parts[i][0], parts[found[0]][1], found[1]))
            i = found[0]
        i += 1
    return out


def match(identifiers: list[str]) -> list[tuple[str, int, int]]:
    """(licence, first, last place) of the rules that match, in order of place."""
    used = [False] * len(identifiers)
    out = []
    for licence, pattern in RULES:
        for start in range(len(identifiers)):
            at, ok = start, True
            for want in pattern:
                optional = want.endswith("?")
                if at < len(identifiers) and not used[at] and identifiers[at] == want.rstrip("?"):
                    at += 1
                elif not optional:
                    ok = False
                    break
            if ok and at > start:
                used[start:at] = [True] * (at - start)
                out.append((licence, start, at - 1))
    return sorted(out, key=lambda r: r[1])


_SPDX = re.compile(r"spdx-license-identifier\s*:\s*([^\r\n]*)", re.I)
_TERM = re.compile(r"[()]|[0-9A-Za-z][0-9A-Za-z.+-]*")


def expression(text: str) -> list[str]:
    """The licences of an SPDX expression, in order; an exception follows its licence behind a slash."""
    out: list[str] = []
    joined = False
    due = True  # a licence comes next
    for word in _TERM.findall(text):
        if word in "()":
            continue
        if word.upper() in ("AND", "OR"):
            due = True
        elif word.upper() == "WITH" and out:
            joined = True
        elif joined:
            out[-1], joined = f"{out[-1]}/{word}", False
        elif due:
            out.append(word)
            due = False
        else:  # what follows the expression on its line
            break
    return out


def licences(text: str, found: list[tuple[int, int, str]]) -> list[str]:
    """The licences of a text by its known sentences; an SPDX tag stands for the licences that it names."""
    out: list[str] = []
    for licence, first, _ in match([n for _, _, n in found]):
        tag = _SPDX.search(text, found[first][0]) if licence == "SPDX" else None
        out += expression(tag[1]) if tag else [licence]
    return out


SCHEMA = "doc_id long, licences string, sentence_ids string, n_known int, first_char long"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licences and sentence_ids (joined by blanks, in order of place), n_known, first_char of every row.

    Texts without known sentences, empty and null ones get empty lists and a null
    first_char; a known sentence that no rule takes stays in sentence_ids alone.
    Repeated rows each get a row; a null doc_id stays null.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            text = batch.column("text")
            sign = pc.fill_null(pc.match_substring_regex(text, SIGNS), False).to_numpy(zero_copy_only=False)
            out = []
            for i, hit in enumerate(sign):
                whole = text[i].as_py()
                found = known_sentences(whole) if hit else []
                names = [n for _, _, n in found]
                out.append((" ".join(licences(whole, found)), " ".join(names), len(names), found[0][0] if found else None))
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64())))], ["doc_id", "licences", "sentence_ids", "n_known", "first_char"])

    return texts(docs).mapInArrow(trimmed(run), SCHEMA)


def query(docs: DataFrame) -> DataFrame:
    """op8: the licences of every document."""
    return scan(docs)
