"""Texts that the license scan looks for: whole licenses, their own notices and the usual short statements.

``Text.names`` are phrases a match must hold word for word, as they tell the license from its siblings; ``Text.without``
are phrases that only a sibling has. Creative Commons licenses other than CC0 are known by their notices alone.
"""

from __future__ import annotations

from pathlib import Path


class Text(str):
    def __new__(cls, text: str, names: tuple[str, ...] = (), without: tuple[str, ...] = ()):
        self = super().__new__(cls, text)
        self.names, self.without = names, without
        return self


_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_INCLUDED = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_KEPT = "provided that the above copyright notice and this permission notice appear in all copies"
_BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD = [_BSD_OPENING + ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."]
_ENDORSE, _ADVERTISE = "endorse or promote products", "advertising materials mentioning features"
#: Section 13 of the Affero license, which stands where the GNU license has its own.
_AFFERO_13 = """13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users
interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source
from a network server at no charge, through some standard or customary means of facilitating copying of software. This Corresponding Source shall include the Corresponding Source for any work covered by version 3
of the GNU General Public License that is incorporated pursuant to the following paragraph. Notwithstanding any other provision of this License, you have permission to link or combine any covered work with a work
licensed under version 3 of the GNU General Public License into a single combined work, and to convey the resulting work. The terms of this License will continue to apply to the part which is the covered work, but
the work with which it is combined will remain governed by version 3 of the GNU General Public License."""


def whole(name: str) -> str:
    """A license of ``license_texts`` up to the end of its terms."""
    text = (Path(__file__).parent / "license_texts" / f"{name}.txt").read_text(encoding="utf-8")
    for end in ("END OF TERMS AND CONDITIONS", "Exhibit A - Source Code Form License Notice"):
        text = text.split(end)[0]
    return text


def _affero() -> str:
    """Terms of the Affero license, without its preamble, from those of the GNU license."""
    terms = " ".join(whole("GPL-3").split()).split("TERMS AND CONDITIONS", 1)[1]
    before, after = terms.split("13. Use with the GNU Affero General Public License.")
    after = after[after.index("14. Revised Versions of this License."):]
    return "TERMS AND CONDITIONS" + (before + "\0" + after).replace("GNU General Public License", "GNU Affero General Public License").replace("\0", _AFFERO_13 + "\n")


def _gnu(kind: str, version: str, thing: str) -> list[Text]:
    name = f"GNU {kind} Public License"
    return [Text(f"This work is licensed under the {name}, version {version}."), Text(f"Licensed under the {name}, version {version}."),
            Text(f"under the terms of the {name} version {version} as published by the Free Software Foundation", (f"{name} version {version} as published",)),
            Text(f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
                 (f"terms of the {name} as published", f"version {version} of the License"))]


def _creative(parts: str, version: str) -> list[Text]:
    full = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives" if version == "4.0" else "NoDerivs"}
    name = f"Creative Commons {'-'.join(full[p] for p in parts.split('-'))} {version} {'International' if version == '4.0' else 'Unported'}"
    return [Text(f"Licensed under CC {parts} {version}."), Text(f"This work is licensed under a {name} License.", (name,)), Text(f"{name}")]


TEMPLATES: dict[str, list[Text]] = {
    "Apache-2.0": [Text("Licensed under the Apache License, Version 2.0."),
                   Text("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
                        ("Apache License Version 2.0",)),
                   Text("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("Apache License Version 2.0",)),
                   Text(whole("Apache-2.0"))],
    "MIT": [Text("Released under the MIT License."), Text(f"{_GRANT}, subject to the following conditions: {_INCLUDED} {_AS_IS}", without=("shall be used for Good not Evil",)), Text("Licensed under the MIT License.")],
    "MIT-0": [Text(f"{_GRANT}. {_AS_IS}", without=("permission notice shall be included", "shall be included in all copies"))],
    "ISC": [Text("Released under the ISC License."), Text("Licensed under the ISC License."), Text(f"{_ISC[0]}, {_KEPT}. {_ISC[1]}", ("permission notice appear in all copies",))],
    "0BSD": [Text(f"{_ISC[0]}. {_ISC[1]}", without=("permission notice appear in all copies",))],
    "BSD": [Text(_BSD_OPENING)],
    "BSD-2-Clause": [Text("Licensed under the BSD 2-Clause License."), Text(f"{_BSD[0]} {_BSD[3]}", without=(_ENDORSE, _ADVERTISE))],
    "BSD-3-Clause": [Text("Licensed under the BSD 3-Clause License."), Text(f"{_BSD[0]} 3. {_BSD[2]} {_BSD[3]}", (_ENDORSE,), (_ADVERTISE,))],
    "BSD-4-Clause": [Text(f"{_BSD[0]} {_BSD[1]} 4. {_BSD[2]} {_BSD[3]}", (_ENDORSE, _ADVERTISE))],
    "MPL-1.1": [Text(whole("MPL-1.1"), ("Mozilla Public License Version 1.1",))],
    "MPL-2.0": [Text("Licensed under the Mozilla Public License, Version 2.0."),
                Text("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ("Mozilla Public License v 2.0",)),
                Text(whole("MPL-2.0"), ("Mozilla Public License Version 2.0",))],
    "GPL-1.0": [Text(whole("GPL-1"))],
    "GPL-2.0": [*_gnu("General", "2", "program"), Text(whole("GPL-2"))],
    "GPL-3.0": [*_gnu("General", "3", "program"), Text(whole("GPL-3"), ("refers to version 3 of the GNU General Public License",))],
    "LGPL-2.0": [*_gnu("Library General", "2", "library"), *_gnu("Lesser General", "2", "library"), Text(whole("LGPL-2"), ("GNU Library General Public License",))],
    "LGPL-2.1": [*_gnu("Lesser General", "2.1", "library"), Text(whole("LGPL-2.1"), ("GNU Lesser General Public License",))],
    "LGPL-3.0": [*_gnu("Lesser General", "3", "library"), Text(whole("LGPL-3"), ("refers to version 3 of the GNU Lesser General Public License",))],
    "AGPL-3.0": [*_gnu("Affero General", "3", "program"), Text(_affero(), ("refers to version 3 of the GNU Affero General Public License",))],
    "GFDL-1.2": [Text(whole("GFDL-1.2"), ("GNU Free Documentation License Version 1.2",))],
    "GFDL-1.3": [Text(whole("GFDL-1.3"), ("GNU Free Documentation License Version 1.3",))],
    "Artistic-1.0": [Text(whole("Artistic"))],
    "CC0-1.0": [Text("Licensed under CC0 1.0."), Text(whole("CC0-1.0"))],
    **{f"CC-{parts}-{version}": _creative(parts, version) for version in ("4.0", "3.0") for parts in ("BY-NC", "BY", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")},
}
