"""License wordings as marked-up templates.

``[...]`` may be left out, ``{n}`` stands for one to ``n`` words of any kind;
case, punctuation and white space do not matter. A label ends in ``-text`` for a
whole license, ``-notice`` for the notice that a license asks for, ``-excerpt``
for a part of a long text, and ``-mention`` for a sentence that names it.
"""

from __future__ import annotations

# The wording of the licenses and notices themselves.

DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {10} BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

MIT = f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
[(including the next paragraph)] shall be included in all copies or substantial portions of the Software. {DISCLAIMER}"""

BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: [1.] Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. [2.] Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""

BSD_NAME = """[3.] Neither the name of {10} nor the names of [its] [other] contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""

BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY {10} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {10} BE LIABLE FOR
ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

ISC_HEAD = "Permission to use, copy, modify, and[/or] distribute this software for any purpose with or without fee is hereby granted"

ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND {8} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {8} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the {1} be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
[1.] The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. [2.]
Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. [3.]
This notice may not be removed or altered from any source distribution."""

UNLICENSE = f"""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this
software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this software under copyright law. {DISCLAIMER}"""

BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the
above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or
in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE,
TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY
DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use {5} except in compliance with the
License. You may obtain a copy of the License at {10} Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the License."""

APACHE_GRANT = """Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide,
non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly
display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."""

APACHE_ASF = """Licensed to {8} under one or more contributor license agreements. See the NOTICE file distributed with this work for
additional information regarding copyright ownership."""

MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at {8}"""

EPL_NOTICE = """This program and the accompanying materials are made available under the terms of the Eclipse Public License [v.] 2.0
which [accompanies this distribution, and] is available at {8}"""

CC0 = """has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law,
including all related and neighboring rights, to the extent allowed by law."""


def gnu_notice(name: str, version: str) -> str:
    """The notice of a GNU license; ``version`` says which versions it allows."""
    return f"""free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software
Foundation{version} {{4}} distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."""


def or_later(number: str) -> str:
    return f", either version {number} of the License, or (at your option) any later version."


GNU = (
    ("gpl-2.0-or-later-notice", gnu_notice("GNU General Public License", or_later("2"))),
    ("gpl-3.0-or-later-notice", gnu_notice("GNU General Public License", or_later("3"))),
    ("gpl-2.0-only-notice", gnu_notice("GNU General Public License", "; [either] version 2 of the License.")),
    ("gpl-3.0-only-notice", gnu_notice("GNU General Public License", ", [either] version 3 of the License.")),
    ("lgpl-2.1-or-later-notice", gnu_notice("GNU Lesser General Public License", or_later("2.1"))),
    ("lgpl-3.0-or-later-notice", gnu_notice("GNU Lesser General Public License", or_later("3"))),
    ("agpl-3.0-or-later-notice", gnu_notice("GNU Affero General Public License", or_later("3"))),
)

CREATIVE_COMMONS = {
    "cc-by": ("Attribution", "BY"),
    "cc-by-sa": ("Attribution-ShareAlike", "BY-SA"),
    "cc-by-nd": ("Attribution-NoDerivatives", "BY-ND"),
    "cc-by-nc": ("Attribution-NonCommercial", "BY-NC"),
    "cc-by-nc-sa": ("Attribution-NonCommercial-ShareAlike", "BY-NC-SA"),
    "cc-by-nc-nd": ("Attribution-NonCommercial-NoDerivatives", "BY-NC-ND"),
}


def creative_commons() -> list[tuple[str, str]]:
    """The sentences that name a Creative Commons license, by its name or its short name."""
    out = []
    for label, (name, short) in CREATIVE_COMMONS.items():
        for version in ("3.0", "4.0"):
            out.append((f"{label}-{version}-notice", f"licensed under [the] [a] Creative Commons {name} {version} [International] [Unported] License"))
            out.append((f"{label}-{version}-mention", f"licensed under [the] [a] [Creative Commons] CC {short} {version}"))
    return out


#: (label, marked-up wording) of every template.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit-text", MIT),
    ("bsd-2-clause-text", f"{BSD_HEAD} {BSD_TAIL}"),
    ("bsd-3-clause-text", f"{BSD_HEAD} {BSD_NAME} {BSD_TAIL}"),
    ("isc-text", f"{ISC_HEAD}, provided that the above copyright notice and this permission notice appear in all copies. {ISC_TAIL}"),
    ("0bsd-text", f"{ISC_HEAD}. {ISC_TAIL}"),
    ("zlib-text", ZLIB),
    ("unlicense-text", UNLICENSE),
    ("bsl-1.0-text", BOOST),
    ("apache-2.0-notice", APACHE_NOTICE),
    ("apache-2.0-excerpt", APACHE_GRANT),
    ("apache-2.0-notice", APACHE_ASF),
    *GNU,
    ("mpl-2.0-notice", MPL_NOTICE),
    ("epl-2.0-notice", EPL_NOTICE),
    ("cc0-1.0-excerpt", CC0),
    *creative_commons(),
    ("apache-2.0-mention", "licensed under the Apache License, Version 2.0"),
    ("mit-mention", "released under the [terms of the] MIT License"),
    ("mit-mention", "licensed under the [terms of the] MIT License"),
    ("gpl-2.0-mention", "licensed under the [terms of the] GNU General Public License, version 2"),
    ("gpl-3.0-mention", "licensed under the [terms of the] GNU General Public License, version 3"),
    ("all-rights-reserved", "copyright {6} all rights reserved"),
)
