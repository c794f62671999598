"""Licence texts in their usual wrapped form, plain and as comments."""

import pytest

from colloquy.llm import licenses

MIT = '''Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE.'''
APACHE = '''Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.'''
BSD = '''Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL DAMAGES.'''
GPL3 = '''This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.'''
GPL2 = GPL3.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")
CASES = {
    MIT: ("MIT", ["MITGrant", "MITNotice", "MITWarranty", "MITLiability"]),
    APACHE: ("Apache-2.0", ["ApacheName", "ApacheTerms", "ApacheCopy", "ApacheWarranty", "ApacheLanguage"]),
    BSD: ("BSD-3-Clause", ["BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse", "BSDWarranty", "BSDLiability"]),
    GPL3: ("GPL-3.0", ["GPLFree3", "GPLWarranty", "GPLDetails", "GPLReceived", "GPLSee"]),
    GPL2: ("GPL-2.0", ["GPLFree", "GPLVersion2", "GPLWarranty", "GPLDetails", "GPLReceived", "GPLSee"]),
}


@pytest.mark.parametrize("marks", ["", "# ", " * ", "// ", "    "])
@pytest.mark.parametrize("text", CASES)
def test_wrapped_texts(text, marks):
    scanner = licenses.Scanner()
    wrapped = "\n".join((marks + x).rstrip() for x in text.split("\n"))
    if marks == " * ":
        wrapped = f"/*\n{wrapped}\n */"
    for form in (wrapped, wrapped.replace("\n", "\r\n")):
        found = scanner.identifiers(form)
        assert (scanner.licenses(found), found) == ([CASES[text][0]], CASES[text][1])


def test_lines_without_points_stay_apart():
    scanner = licenses.Scanner()
    assert scanner.identifiers("A page\nLicensed under CC BY 4.0\nMore of the page") == ["CCBY"]
    assert scanner.identifiers("Some licence of ours\nSPDX-License-Identifier: MIT\nThis copyright is odd") == ["Unknown", "SPDXMIT", "Unknown"]


LGPL = GPL3.replace("General Public", "Lesser General Public").replace("This program is", "This library is").replace("this program", "this library")
SENTENCES = {
    "This project is licensed under the MIT License.": ["MIT"],
    "This software is released under the Apache License 2.0.": ["Apache-2.0"],
    "Licensed under the GNU Lesser General Public License v2.1 or later.": ["LGPL-2.1"],
    "The source code is available under the terms of the 3-clause BSD license.": ["BSD-3-Clause"],
    "This program is distributed under the AGPL-3.0.": ["AGPL-3.0"],
    "It is provided under the Mozilla Public License, version 2.0.": ["MPL-2.0"],
    "SPDX-License-Identifier: BSD-3-Clause": ["BSD-3-Clause"],
    "// SPDX-License-Identifier: (GPL-2.0 OR MIT)": ["GPL-2.0 OR MIT"],
    "SPDX-License-Identifier: Some-Thing-1.0": ["some-thing-1.0"],
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.": ["MPL-2.0"],
    "This is free and unencumbered software released into the public domain.": ["Unlicense"],
    "Copyright (c) 2020, Someone. All rights reserved.\n\n" + BSD: ["BSD-3-Clause"],
    "Copyright 2020 Someone. All rights reserved.": ["Proprietary"],
    LGPL: ["LGPL-3.0"],
    LGPL.replace("Foundation, either version 3", "Foundation; either version 2.1"): ["LGPL-2.1"],
    GPL3.replace("General Public", "Affero General Public"): ["AGPL-3.0"],
}


@pytest.mark.parametrize("text", SENTENCES)
def test_names_expressions_and_families(text):
    scanner = licenses.Scanner()
    assert scanner.licenses(scanner.identifiers(text)) == SENTENCES[text]
