"""Headers and texts by which files state their licence, each with the phrases that a copy must hold.

A phrase is a run of terms (a-z and 0-9 in lower case). The first phrase finds the places to look at, so it begins with a rare term; the phrases
name the licence and its version, so that no text of another version passes. Long licence texts are known by their heads.
"""

from __future__ import annotations

_GPL_REST = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
    "FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with this program. "
    "If not, see <https://www.gnu.org/licenses/>."
)
_GPL_GRANT = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, "
    "either version {version} of the License, or (at your option) any later version. "
)
_GPL_LATER = _GPL_GRANT + _GPL_REST
_GPL_ONLY = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the {name} version {version} as published by the "
    "Free Software Foundation. " + _GPL_REST
)
_GPL_HEAD = (
    "{name} Version {version}, {date} Copyright (C) {year} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies "
    "of this license document, but changing it is not allowed."
)
_GNU = (  # licence, name, version in words, version as terms, date and year of its text
    ("GPL-2.0", "GNU General Public License", "2", "2", "June 1991", "1989, 1991"),
    ("GPL-3.0", "GNU General Public License", "3", "3", "29 June 2007", "2007"),
    ("LGPL-2.0", "GNU Library General Public License", "2", "2", "June 1991", "1991"),
    ("LGPL-2.1", "GNU Lesser General Public License", "2.1", "2 1", "February 1999", "1991, 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3", "3", "29 June 2007", "2007"),
    ("AGPL-3.0", "GNU Affero General Public License", "3", "3", "19 November 2007", "2007"),
)
_AS_IS = (
    'IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES '
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. {third}"
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. " + _AS_IS
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to '
    "deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or "
    "sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_REST = (
    " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE."
)
_MIT_PHRASES = ("permission is hereby granted free of charge to any person obtaining", "without restriction")
_APACHE_HEADER = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy '
    "of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
    'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific '
    "language governing permissions and limitations under the License."
)
_APACHE_HEAD = (
    "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "
    '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.'
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
    "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
_MPL_HEADER = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
    "obtain one at http://mozilla.org/MPL/2.0/."
)
_EPL_HEADER = (
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v{version} which accompanies this "
    "distribution, and is available at http://www.eclipse.org/legal/epl-v{short}.html"
)
_EPL_HEAD = (
    "Eclipse Public License - v {version} THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, "
    "REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT."
)
_CC = (("CC-BY-4.0", "Attribution"), ("CC-BY-NC-4.0", "Attribution-NonCommercial"), ("CC-BY-SA-4.0", "Attribution-ShareAlike"))
_IDS = (
    "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-1.0", "EPL-2.0", "GPL-2.0",
    "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense",
)


def _gnu():
    for licence, name, version, terms, date, year in _GNU:
        phrase = name.lower()
        for text in (_GPL_GRANT, _GPL_LATER, _GPL_ONLY):
            yield licence, text.format(name=name, version=version), (phrase, f"version {terms}", "redistribute it")
        yield licence, _GPL_HEAD.format(name=name, version=version, date=date, year=year), (f"{phrase} version {terms}", "verbatim copies")


# (licence, text, phrases) of whole headers and licence texts
TEMPLATES = (
    *_gnu(),
    ("Apache-2.0", _APACHE_HEADER, ("apache license version 2 0", "in compliance with")),
    ("Apache-2.0", _APACHE_HEAD, ("apache license version 2 0", "terms and conditions for use")),
    ("BSD-2-Clause", _BSD.format(third=""), ("redistribution and use in source and binary forms", "following disclaimer")),
    ("BSD-3-Clause", _BSD.format(third=_BSD_THIRD), ("redistribution and use in source and binary forms", "to endorse or promote")),
    ("MIT", _MIT_GRANT, _MIT_PHRASES),
    ("MIT", _MIT_GRANT + _MIT_REST, _MIT_PHRASES),
    ("ISC", _ISC, ("permission to use copy modify", "is hereby granted", "with or without fee")),
    ("Unlicense", _UNLICENSE, ("unencumbered software released into the public domain",)),
    ("MPL-2.0", _MPL_HEADER, ("mozilla public license v 2 0",)),
    ("MPL-2.0", 'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.', ("mozilla public license version 2 0", "contributor means")),
    *[("EPL-" + v, _EPL_HEADER.format(version=v, short=v.replace(".", "")), (f"eclipse public license v{v[0]} 0",)) for v in ("1.0", "2.0")],
    *[("EPL-" + v, _EPL_HEAD.format(version=v), (f"eclipse public license v {v[0]} 0", "accompanying program")) for v in ("1.0", "2.0")],
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", ("eclipse public license 2 0",)),
    *[(licence, f"Creative Commons {name} 4.0 International Public License", (f"creative commons {name.lower().replace('-', ' ')} 4 0 international",)) for licence, name in _CC],
    *[(licence, f"This work is licensed under a Creative Commons {name} 4.0 International License.", (f"creative commons {name.lower().replace('-', ' ')} 4 0 international",)) for licence, name in _CC],
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal", ("cc0 1 0 universal",)),
    *[(i, f"SPDX-License-Identifier: {i}", (f"spdx license identifier {i.lower().replace('-', ' ').replace('.', ' ')}",)) for i in _IDS],
)

# the phrases of each one-line notice of licenses.NOTICES where it stands inside a longer line
NOTICE_PHRASES = {
    "Apache-2.0": "apache license version 2 0", "BSD-3-Clause": "bsd 3 clause license", "CC-BY-4.0": "cc by 4 0", "CC-BY-NC-4.0": "cc by nc 4 0",
    "CC-BY-SA-4.0": "cc by sa 4 0", "CC0-1.0": "cc0 1 0", "GPL-3.0": "gnu general public license version 3",
    "LGPL-3.0": "gnu lesser general public license version 3", "MIT": "mit license", "MPL-2.0": "mozilla public license v 2 0",
}
