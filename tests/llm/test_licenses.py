import random

from axiomata.llm import licenses

MIT = 'Copyright (c) 2020 X\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this\nsoftware and associated documentation files.\n\nThe above copyright notice and this permission notice shall be included in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.'
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that:\n1. Redistributions of source code must retain the above copyright notice.\n2. Redistributions in binary form must reproduce the above copyright notice.\n"
THIRD = "3. Neither the name of the holder nor the names of its contributors may be used to endorse products.\n"


def names(text):
    return [x for x, _, _ in licenses.scan(text)]


def test_ordered_rules():
    assert names(MIT) == ["MIT"]
    assert names(BSD + THIRD) == ["BSD-3-Clause"] and names(BSD) == ["BSD-2-Clause"]
    assert names(MIT + "\n\n" + BSD) == ["MIT", "BSD-2-Clause"]
    parts = MIT.split("\n\n")
    assert names("\n\n".join(parts[::-1])) == []  # sentences out of order are no licence


def test_references_and_spans():
    line = "Released under the MIT License."
    assert licenses.scan("no mark before\n" + line + "\nnor after") == [("MIT", 34, 45)]
    assert names("This work is licensed under the GNU General Public License, version 3.") == ["GPL-3.0"]
    assert names("Licensed under the Apache License, Version 2.0.") == ["Apache-2.0"]
    assert names("Licensed under CC BY-NC 4.0. All rights reserved.") == ["CC-BY-NC-4.0", "All-Rights-Reserved"]
    assert names("// SPDX-License-Identifier: Apache-2.0 OR MIT\ncode") == ["Apache-2.0 OR MIT"]
    assert names("a licence to kill, no permission, no warranty") == []
    assert names("x " * 5000 + line + " y" * 5000) == ["MIT"]


def test_too_many_sentences_between():
    grant, rest = MIT.split("\n\n")[1], "\n\n".join(MIT.split("\n\n")[2:])
    assert names(grant + "\n\n" + "Some sentence. " * 2 + "\n\n" + rest) == ["MIT"]
    assert names(grant + "\n\n" + "Some sentence. " * 9 + "\n\n" + rest) == []


def test_table(spark):
    df = spark.createDataFrame([(1, MIT, "l"), (1, MIT, "l"), (None, None, "l"), (2, "", "l")], "doc_id long, text string, start string")
    got = licenses.with_licenses(df, keep=("doc_id", "start")).collect()
    assert sorted((r.doc_id or 0, len(r.licenses), r.start) for r in got) == [(0, 0, "l"), (1, 1, "l"), (1, 1, "l"), (2, 0, "l")]
    assert licenses.with_licenses(df.limit(0)).count() == 0


def test_names_of_licences():
    samples = {
        "Released under the GPLv3.": "GPL-3.0", "Released under GPL-2.": "GPL-2.0", "Distributed under AGPL.": "AGPL", "Uses LGPL.": "LGPL", "Code: 3-clause BSD.": "BSD-3-Clause", "Code: BSD 2-clause.": "BSD-2-Clause",
        "Data: CC0.": "CC0-1.0", "Creative Commons Zero.": "CC0-1.0", "This text is CC BY-SA 4.0.": "CC-BY-SA-4.0", "Text: CC-BY-NC-ND.": "CC-BY-NC-ND", "Text: CC BY.": "CC-BY", "Creative Commons Attribution 4.0": "CC-BY-4.0",
        "Attribution-NonCommercial-ShareAlike 4.0": "CC-BY-NC-SA-4.0", "Attribution-NoDerivatives": "CC-BY-ND", "released into the public\ndomain": "Public-Domain", "All\nrights\nreserved.": "All-Rights-Reserved",
        "Under the Eclipse Public License 2.0.": "EPL-2.0", "CDDL-1.1": "CDDL-1.1", "the Artistic License 2.0": "Artistic-2.0", "SIL Open Font License, Version 1.1": "OFL-1.1", "Business Source License 1.1": "BUSL-1.1",
        "Server Side Public License": "SSPL-1.0", "European Union Public Licence v1.2": "EUPL-1.2", "zlib license": "Zlib", "0BSD": "0BSD", "WTFPL": "WTFPL", "Boost Software License": "BSL-1.0", "GNU GPL v2 or later": "GPL-2.0-or-later", "MPL 2.0": "MPL-2.0",
    }
    for text, name in samples.items():
        assert names(text) == [name], text
    for text in ("in no event\nshall", "distributed in the\nhope that it will be useful", "You should have received a copy of the\nGNU", 'The software is provided "AS\nIS"'):
        assert [x for *_, x in licenses.sentences(text)], text


def test_texts_of_short_licences():
    zlib = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it:\n\n1. The origin of this software must not be misrepresented.\n2. Altered source versions must be plainly marked as such.\n3. This notice may not be removed or altered from any source distribution."
    assert names(zlib) == ["Zlib"]
    grant = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
    as_is = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES.'
    assert names(f"{grant}.\n\n{as_is}") == ["0BSD"]
    assert names(f"{grant}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{as_is}") == ["ISC"]
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but.\n\nYou should have received a copy of the GNU General Public License."
    assert names(gpl)[0] == "GPL-3.0-or-later"
    assert names(gpl.replace(", or\n(at your option) any later version", ""))[0] == "GPL-3.0"


def brute_wordings(words):
    padded, hits = f" {words} ", []
    for wording, known in licenses.known_sentences().items():
        at = padded.find(f" {wording} ")
        while at >= 0:
            hits.append((at, at + len(wording), known))
            at = padded.find(f" {wording} ", at + 1)
    kept = []
    for a, b, known in sorted(hits, key=lambda h: (h[0] - h[1], h[0])):
        if all(b <= x or y <= a for x, y, _ in kept):
            kept.append((a, b, known))
    return sorted(kept)


def brute_scan(known):
    """Licences by trying every rule at every sentence, the longest rules first."""
    used, found = set(), []
    every = [r for rs in licenses.rules().values() for r in rs]
    for _, licence, rule in sorted(every):
        for first in range(len(known)):
            chain = []
            for wanted in rule:
                options = [first] if not chain else range(chain[-1] + 1, len(known))
                chain.append(next((k for k in options if known[k][3] == wanted and k not in used), None))
                if chain[-1] is None or (len(chain) > 1 and known[chain[-1]][0] - known[chain[-2]][0] > licenses.GAP + 1):
                    break
            else:
                used |= set(chain)
                found.append((licence, known[chain[0]][1], known[chain[-1]][2]))
    return sorted(found, key=lambda x: (x[1], x[2], x[0]))


def test_against_brute_force():
    random.seed(3)
    pool = [w for _, w in licenses.SENTENCES if w != "SPDX-License-Identifier"] + [w for _, w in random.sample(list(licenses.references()), 60)] + ["Some other sentence", "é was here", "the License", "version 2.0"] * 6
    seen = set()
    for _ in range(300):
        text = "".join(random.choice(pool) + random.choice([". ", ".\n\n", " ", ", ", ";\n* "]) for _ in range(random.randrange(1, 12)))
        words = licenses.normalised(text)
        assert licenses.wordings(words) == brute_wordings(words), text
        known = licenses.sentences(text)
        for number, a, b, name in known:
            assert licenses.known_sentences()[licenses.normalised(text[a:b])] == name
            assert 0 <= number <= len(known) + text.count(".") + text.count("*")
        assert licenses.scan(text) == brute_scan(known), text
        seen |= {x for x, *_ in licenses.scan(text)}
    assert len(seen) > 20


def test_several_licences_in_one_sentence():
    assert names("Licensed under either the MIT License or the Apache License, Version 2.0.") == ["MIT", "Apache-2.0"]
    assert names("Licensed under either the MIT License or the Apache\nLicense, Version 2.0.") == ["MIT", "Apache-2.0"]
    assert names("SPDX-License-Identifier: GPL-2.0 OR BSD-3-Clause") == ["GPL-2.0 OR BSD-3-Clause"]
    assert names("Under the GNU General Public License,\nversion 3.") == ["GPL-3.0"]


def test_long_sentences_between():
    grant, rest = MIT.split("\n\n")[1], "\n\n".join(MIT.split("\n\n")[2:])
    for n in (1, 3):
        assert names(grant + "\n\n" + ("word " * 800 + "end. ") * n + "\n\n" + rest) == ["MIT"]
    assert names(grant + "\n\n" + ("word " * 800 + "end. ") * 4 + "\n\n" + rest) == []


def test_many_notices_in_one_text():
    assert len(names("Under the MIT License and so on " * 20_000)) == 20_000
    assert len(names(MIT.split("\n\n")[1] + " ") * 1) == 0
    df_text = "x" * 300_000 + " MIT License"
    assert licenses.scan(df_text) == [("MIT", 300_001, 300_012)]
