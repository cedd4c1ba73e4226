"""Phrases that name a license, and public license texts and notices.

Each template has its label, its text, and the phrases of three words or more that decide: a span
that lacks one of them, word for word, is of another license or version.
"""

PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

_WARRANTY_MIT = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU_WARRANTY = (
    "{0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU {1} for more details."
)


def _gnu(name: str, version: str, thing: str = "program") -> str:
    return (
        f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, "
        f"either version {version} of the License, or (at your option) any later version. " + _GNU_WARRANTY.format(f"This {thing}", name)
    )


def _gnu_notice(name: str, version: str) -> str:
    return f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version"


def _spdx(name: str) -> str:
    return f"SPDX-License-Identifier: {name}"


# labels by identifiers of one line, and the words that decide
_IDENTIFIERS = [
    ("mit", "MIT", "mit"), ("apache-2", "Apache-2.0", "apache 2"), ("gpl-2", "GPL-2.0", "gpl 2"), ("gpl-3", "GPL-3.0", "gpl 3"), ("lgpl-2.1", "LGPL-2.1", "lgpl 2 1"), ("lgpl-3", "LGPL-3.0", "lgpl 3"),
    ("agpl-3", "AGPL-3.0", "agpl 3"), ("bsd-2-clause", "BSD-2-Clause", "bsd 2"), ("bsd-3-clause", "BSD-3-Clause", "bsd 3"), ("isc", "ISC", "isc"), ("mpl-2", "MPL-2.0", "mpl 2"), ("epl-2", "EPL-2.0", "epl 2"),
    ("zlib", "Zlib", "zlib"), ("unlicense", "Unlicense", "unlicense"), ("cc0-1", "CC0-1.0", "cc0 1"),
]


def _cc(parts: str, version: str, kind: str) -> str:
    return f"This work is licensed under a Creative Commons {parts} {version} {kind} License"


TEMPLATES = [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY_MIT,
        ("free of charge",),
    ),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("free of charge",)),
    ("mit", _WARRANTY_MIT, ()),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License", ("license version 2",)),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ("license version 2",),
    ),
    ("gpl-2", "Licensed under the GNU General Public License version 2", ("gnu general public", "license version 2")),
    ("gpl-3", "Licensed under the GNU General Public License version 3", ("gnu general public", "license version 3")),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License", ("gnu general public",)),
    ("gpl-2", _gnu("General Public License", "2"), ("gnu general public", "either version 2 of")),
    ("gpl-3", _gnu("General Public License", "3"), ("gnu general public", "either version 3 of")),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general",)),
    ("lgpl-2.1", _gnu("Lesser General Public License", "2.1", "library"), ("gnu lesser general", "either version 2 1 of")),
    ("lgpl-3", _gnu("Lesser General Public License", "3"), ("gnu lesser general", "either version 3 of")),
    ("agpl-3", _gnu("Affero General Public License", "3"), ("gnu affero general", "either version 3 of")),
    ("gpl-2", _gnu_notice("General Public License", "2"), ("gnu general public", "either version 2 of")),
    ("gpl-3", _gnu_notice("General Public License", "3"), ("gnu general public", "either version 3 of")),
    ("agpl-3", "Licensed under the GNU Affero General Public License version 3", ("gnu affero general", "license version 3")),
    ("lgpl-2.1", "Licensed under the GNU Lesser General Public License version 2.1", ("gnu lesser general", "license version 2 1")),
    ("lgpl-3", "Licensed under the GNU Lesser General Public License version 3", ("gnu lesser general", "license version 3")),
    ("epl-2", "made available under the terms of the Eclipse Public License 2.0", ("eclipse public license", "public license 2 0")),
    ("epl-2", "made available under the terms of the Eclipse Public License v. 2.0", ("eclipse public license", "license v 2 0")),
    ("isc", "released under the ISC license", ("the isc license",)),
    ("isc", "licensed under the ISC license", ("the isc license",)),
    ("cc0-1", "dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication", ("cc0 1 0",)),
    ("cc0-1", "released under CC0 1.0 Universal", ("cc0 1 0",)),
    *[(label, _spdx(name), (f"license identifier {decides}",)) for label, name, decides in _IDENTIFIERS],
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ()),
    ("bsd-2-clause", _BSD + _BSD_WARRANTY, ("in binary form", "with the distribution this software is")),
    (
        "bsd-3-clause",
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_WARRANTY,
        ("neither the name of",),
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        (),
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
        (),
    ),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ("license v 2",)),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("license v 2",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ()),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights "
        "to this software under copyright law.",
        (),
    ),
    *[
        (label, _cc(parts, version, kind), (f"commons {decides}",) if len(decides.split()) > 1 else ())
        for version, kind in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic"))
        for label, parts, decides in (
            ("cc-by", "Attribution", f"attribution {version[0]}"),
            ("cc-by-sa", "Attribution-ShareAlike", "attribution sharealike"),
            ("cc-by-nd", "Attribution-NoDerivatives", "attribution noderivatives"),
            ("cc-by-nc", "Attribution-NonCommercial", f"attribution noncommercial {version[0]}"),
            ("cc-by-nc-sa", "Attribution-NonCommercial-ShareAlike", "attribution noncommercial sharealike"),
            ("cc-by-nc-nd", "Attribution-NonCommercial-NoDerivatives", "attribution noncommercial noderivatives"),
        )
    ],
]
