"""Notices as they are shipped: on one line, wrapped, in comments; order of the rules."""

import textwrap

import pytest

from colloquy.llm.licenses import RULES, find_licenses

APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
    'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
    "either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
    "so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software."
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution."
)
ENDORSE = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission."
)


def gpl(version):
    return (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        f"published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    )


NOTICES = {"Apache-2.0": APACHE, "MIT": MIT, "BSD-2-Clause": BSD, "GPL-3.0-or-later": gpl(3), "GPL-2.0-or-later": gpl(2)}


def shapes(text):
    wrapped = textwrap.wrap(text, 72)
    return [text, "\n".join(wrapped), "\r\n".join(f"# {line}" for line in wrapped), "/*\n" + "\n".join(f" * {line}" for line in wrapped) + "\n */",
            "Copyright 2020 A. Person\n\n" + "\n".join(f"// {line}" for line in wrapped) + "\n\ncode();"]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, text) for name, notice in NOTICES.items() for text in shapes(notice)]
    bsd3 = BSD[:-1] + "." + ENDORSE
    rows += [("BSD-3-Clause|BSD-2-Clause", text) for text in shapes(bsd3.replace(" 3. Neither", " Neither"))]
    rows += [
        ("MIT", "This file is licensed under the MIT license, see LICENSE."), ("MIT", "// SPDX-License-Identifier: MIT"),
        ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"), ("GPL-2.0-or-later", "/* SPDX-License-Identifier: GPL-2.0-or-later */"),
        ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"), ("", "The mitlicensed thing is licensed under the MIT licensex."),
        ("", "rights and licences of software, no warranty"),
        ("Apache-2.0|MIT", MIT + "\n\n" + APACHE),  # in the order of the rules
    ]
    table = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    licenses = {r.doc_id: r.licenses for r in find_licenses(table).collect()}
    return [(wanted, text, licenses[k]) for k, (wanted, text) in enumerate(rows)]


def test_notices_in_every_shape(found):
    for wanted, text, licenses in found:
        if wanted.startswith("BSD-3"):
            assert licenses[0] in wanted.split("|"), text
        else:
            assert "|".join(licenses) == wanted, text


def test_longer_rules_come_before_their_parts():
    for k, (ids, _) in enumerate(RULES):
        text = ",".join(ids)
        assert not any(",".join(earlier) in text for earlier, _ in RULES[:k] if len(earlier) < len(ids))
