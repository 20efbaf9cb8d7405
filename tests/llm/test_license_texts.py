"""Published licence texts, wrapped and in comments, reach every known sentence and every rule."""

import pytest

from assetflow.llm import license_scan as L

MIT = '''Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
'''
AS_IS = '''
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
'''
BSD = '''Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
'''
NAMES = '''
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
'''
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License");\n'
APACHE_REST = '''you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions.
'''
GPL3 = '''This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
'''
GPL2 = '''This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.
'''
HOPE = '''
This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
'''
LGPL = '''This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
'''
MPL = '''This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
'''
ISC = '''Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
'''

LIABLE = ''' IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
'''
MIT_BODY = MIT + AS_IS.split(" IN NO EVENT")[0] + LIABLE
BSD_REST = '''
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
'''
ISC_REST = '''
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
'''
AGPL = GPL3.replace("GNU General", "GNU Affero General")
LGPL3 = LGPL.replace("version 2.1", "version 3")
LESSER_HOPE = HOPE.replace("This program", "This library").replace("General Public", "Lesser General Public")
UNLICENSE = '''This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
'''
ZLIB = '''This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
'''
BOOST = '''Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works.
'''
ECLIPSE = '''This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/
'''
APACHE_SEE = APACHE_REST.replace("governing permissions.", "governing permissions and\nlimitations under the License.")
NAMED = [f"SPDX-License-Identifier: {name}\n" for name in L._SPDX] + [
    wording for terms, version in L._CC for wording in (
        f"Licensed under CC {'-'.join(terms)} {version}.\n",
        f"This work is licensed under a Creative Commons\n{'-'.join(L._CC_TERMS[t].title() for t in terms)} {version} {'International' if version == '4.0' else 'Unported'} License.\n")
    if L._plain(wording) not in [s for n, s in L.SENTENCES.items() if n.startswith("cc-")]
]

#: In the order of the rules.
TEXTS = [
    BSD + NAMES + BSD_REST, BSD + BSD_REST, "MIT License\n\nCopyright (c) 2020 A\n\n" + MIT_BODY, "The MIT License\n\n" + MIT_BODY, MIT_BODY, ISC + ISC_REST, AGPL + HOPE, AGPL, LGPL3 + LESSER_HOPE, LGPL3, LGPL + LESSER_HOPE, UNLICENSE, ZLIB,
    BOOST.replace("the Software, and", "the Software.\nAnd"), ECLIPSE, "Apache License\nVersion 2.0, January 2004\n", APACHE + APACHE_SEE,
    BSD + NAMES, BSD, "MIT License\n\nCopyright (c) 2020 A\n\n" + MIT + AS_IS, "The MIT License\n\n" + MIT + AS_IS, MIT + AS_IS, MIT, APACHE + APACHE_REST, APACHE,
    "Licensed under the Apache License,\nVersion 2.0.\n", "SPDX-License-Identifier: Apache-2.0\n", GPL3 + HOPE, GPL3, GPL2 + HOPE, GPL2, "This work is licensed under the GNU General Public\nLicense, version 3.\n",
    "Licensed under the GNU General Public License, version 3.\n", "SPDX-License-Identifier: GPL-3.0-only\n", LGPL, MPL, ISC, "This project is licensed under the\nMIT License.\n", "Released under the MIT License.\n",
    "Licensed under the MIT\nLicense.\n", "SPDX-License-Identifier: MIT\n", "MIT License\n", "The MIT License\n", "Licensed under CC BY 4.0.\n", "This work is licensed under a Creative Commons\nAttribution 4.0 International License.\n",
    "Licensed under CC BY-SA 4.0.\n", "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.\n", "Licensed under CC BY-NC 4.0.\n",
    "This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License.\n", "Licensed under CC0 1.0.\n", "This is free and unencumbered software released into the public domain.\n", *NAMED,
]


def commented(mark, end="\n"):
    return lambda t: end.join((mark + line).rstrip() for line in t.split("\n"))


@pytest.mark.parametrize("form", [str, *map(commented, ("# ", "// ", " * ", ";; ", "-- ", "! ", "dnl ", "REM ", "\t")), commented("", "\r\n"), lambda t: t.replace("\n", " \n")], ids=str)
def test_rules_are_reached(spark, form):
    assert len(TEXTS) == len(L.RULES)
    got = {r["doc_id"]: r for r in L.license_scan(spark.createDataFrame([(i, form(t)) for i, t in enumerate(TEXTS)], "doc_id int, text string")).collect()}
    wrong = [(L.RULES[i], got[i]) for i in range(len(TEXTS)) if (got[i]["n_known"], got[i]["licenses"], got[i]["n_unmatched"]) != (len(L.RULES[i][1]), L.RULES[i][0], 0)]
    assert not wrong


def test_sentences_are_reached(spark):
    rows = spark.createDataFrame([("\n\n".join(TEXTS) + "\nAll rights reserved.",)], "text string")
    assert set(rows.select(L.known_sentences(rows["text"], L.SENTENCES)).first()[0]) == set(L.SENTENCES.values())


def test_parts_of_sentences_are_not_known(spark):
    rows = [(1, "MIT\n\nLicense"), (2, "SPDX-License-Identifier: MIT OR Apache-2.0"), (3, "Not the old MIT\nLicense of"), (4, "Released under the MIT License\n\nsome words"), (5, "MIT\n\nlicense"), (6, "MIT\r\n\r\nlicense")]
    got = {r["doc_id"]: r["licenses"] for r in L.license_scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {1: "", 2: "", 3: "", 4: "MIT", 5: "", 6: ""}


def test_own_sentences_without_usual_words(spark):
    """A caller's sentences are found though they hold none of the words that mark the usual ones; empty tables find nothing."""
    rows = spark.createDataFrame([(1, "As agreed: Beerware,\nrevision 42. Done."), (2, "MIT License")], "doc_id int, text string")
    own = L.license_scan(rows, {"beer": "beerware revision 42"}, [("Beerware", ["beer"])]).collect()
    assert [(r["doc_id"], r["n_known"], r["licenses"]) for r in own] == [(1, 1, "Beerware"), (2, 0, "")]
    assert [r["n_known"] for r in L.license_scan(rows, {}, []).collect()] == [0, 0]
