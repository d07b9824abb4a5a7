import re

from polyquery.llm import licences as L

APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


def test_full_text_wins_over_its_notice():
    names = [n for _, _, n in L.known_sentences("Some text.\n" + APACHE + "\nMore.")]
    assert [x for x, _, _ in L.match(names)] == ["Apache-2.0"]
    assert len(names) >= 4


def test_every_sentence_has_a_sign():
    for name, pattern in L.SENTENCES.items():
        bare = re.sub(r"[^a-z ]", " ", pattern.replace("icen", "icen"))
        assert re.search(L.SIGNS, bare) or "spdx" in name, name


def test_scan(spark):
    rows = [(1, "A b c.\nLicensed under the Apache License, Version 2.0.\nD."), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "Released under the MIT License. Licensed under CC BY-NC 4.0."), (4, "nothing"), (5, None), (6, ""), (None, "Released under the MIT License"), (1, "twice"), (8, "We licensed the film rights.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "doc_id", "1 as licences")
    got = sorted(((r.doc_id, r.licences, r.n_known) for r in L.query(df).collect()), key=str)
    assert got == sorted([(1, "Apache-2.0", 1), (2, "GPL-3.0-only", 1), (3, "MIT CC-BY-NC", 2), (4, "", 0), (5, "", 0), (6, "", 0), (None, "MIT", 1), (1, "", 0), (8, "", 0)], key=str)
    assert L.query(df.limit(0)).collect() == []


def test_spdx_expressions(spark):
    texts = {
        "// SPDX-License-Identifier: MIT": "MIT",
        "/* SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 */\nint x;": "GPL-2.0-only/Classpath-exception-2.0",
        "# spdx-license-identifier: (Apache-2.0 OR MIT) AND BSD-3-Clause # more words\nx": "Apache-2.0 MIT BSD-3-Clause",
        "SPDX-License-Identifier: ISC\nReleased under the MIT License.": "ISC MIT",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.licences for r in L.scan(df).collect()} == dict(enumerate(texts.values()))


def test_wrapped_and_commented_notices(spark):
    """Apache's notice at any width, bare and behind comment marks, alone and between other text."""
    flat = " ".join(APACHE.split())
    texts = []
    for width in (20, 30, 40, 50, 72, 120):
        lines, now = [], ""
        for word in flat.split():
            if len(now) + len(word) + 1 > width and now:
                lines.append(now)
                now = word
            else:
                now = f"{now} {word}".strip()
        lines.append(now)
        for mark in ("", " * ", "# ", "// ", "-- "):
            texts.append("Words before.\n" + "\n".join(mark + line for line in lines) + "\nand words behind, " * 3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.licences for r in L.scan(df).collect()} == {"Apache-2.0"}


def test_long_text(spark):
    text = "plain words without end " * 40_000 + "\n" + APACHE + "\n" + "permission " * 50_000 + "\nReleased under the MIT License."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert L.scan(df).first()["licences"] == "Apache-2.0 MIT"


def spoken():
    """A sentence for each alternative of each pattern, free parts filled in."""
    return [(name, " ".join(a.replace(".*", " some words ").split())) for name, pattern in L.SENTENCES.items() for a in L.alternatives(pattern)]


def test_alternatives():
    assert sorted(L.alternatives("(a |the )?x(y|z)?.*")) == sorted(p + q + r + ".*" for p in ("", "a ", "the ") for q in "x" for r in ("", "y", "z"))
    for name, text in spoken():
        assert re.fullmatch(L.SENTENCES[name], text), text


def test_each_alternative_is_found(spark):
    """Whole, a word a line, and behind another sentence; the look for signs skips none."""
    rows = spoken()
    texts = [t for _, text in rows for t in (text.capitalize() + ".", text.replace(" ", "\n"), f"First of all\n{text}.")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.sentence_ids, r.first_char) for r in L.scan(df).collect()}
    for k, (name, text) in enumerate(rows):
        want = L.identify(text)
        assert got[3 * k] == (want, 0), text
        assert got[3 * k + 1][0].split()[:1] == [want], text
        assert got[3 * k + 2] == (want, 13), text


def test_signs_and_joins():
    def names(text):
        return [n for _, _, n in L.known_sentences(text)]

    gpl = "This program is free software: you\ncan redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    assert names(gpl) == ["gpl3_later"]
    assert names(gpl.replace(" ", "\n")) == ["gpl3_later"]
    assert names("Released under CC0 1.0.") == ["cc0_notice"]
    assert names("Licensed under Creative Commons Attribution\nShareAlike 4.0.") == ["ccbysa_notice"]
    assert names("Some text.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.") == ["mit_notice", "ccbync_notice"]
    assert names("We licensed the film.\nReleased under the MIT License.\nArt released under CC0.") == ["mit_notice", "cc0_notice"]
    assert names("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at\nhttps://mozilla.org/MPL/2.0/.") == ["mpl2_notice", "mpl2_copy"]
