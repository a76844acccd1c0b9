"""Short notices, standard headers and bodies of licences, as published by their authors.

``(SPDX name, text)``.  Bodies without a standard header stand whole; long licences stand with their title and
with the header that they ask for.
"""

_DISCLAIMER_MIT = (
    'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, '
    "fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other "
    "liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software "
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so"
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_CLAUSE_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_DISCLAIMER_BSD = (
    'This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability '
    "and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages "
    "(including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, "
    "strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_DISCLAIMER_ISC = (
    'The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable '
    "for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, "
    "arising out of or in connection with the use or performance of this software."
)


def _gnu(kind: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} License as published by the Free Software Foundation, "
        f"either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        f"without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} License for more details. "
        f"You should have received a copy of the GNU {kind} License along with this program. If not, see <https://www.gnu.org/licenses/>."
    )


def _gnu_forms() -> list[tuple[str, str]]:
    out = []
    for name, kind, version, date in (
        ("AGPL-3.0", "Affero General Public", "3", "19 November 2007"),
        ("GPL-2.0", "General Public", "2", "June 1991"),
        ("GPL-3.0", "General Public", "3", "29 June 2007"),
        ("LGPL-2.1", "Lesser General Public", "2.1", "February 1999"),
        ("LGPL-3.0", "Lesser General Public", "3", "29 June 2007"),
    ):
        sentences = _gnu(kind, version).split(". ")
        out += [
            (name, f"GNU {kind} License Version {version}, {date}"),
            (name, f"This work is licensed under the GNU {kind} License, version {version}."),
            (name, f"Licensed under the GNU {kind} License v{version} or later."),
            (name, _gnu(kind, version)),
            (name, sentences[0]),
        ]
    return out


def _creative_commons_forms() -> list[tuple[str, str]]:
    out = []
    for short, long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike")):
        out += [
            (f"CC-{short}-4.0", f"Licensed under CC {short} 4.0."),
            (f"CC-{short}-4.0", f"Creative Commons {long} 4.0 International Public License"),
            (f"CC-{short}-4.0", f"This work is licensed under a Creative Commons {long} 4.0 International License."),
            (f"CC-{short}-4.0", f"This work is licensed under the Creative Commons {long} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/{short.lower()}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."),
        ]
    return out


PROPRIETARY = "Proprietary"

TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", f"{_MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_DISCLAIMER_MIT}"),
    ("MIT", f"{_MIT_GRANT}, subject to the following conditions:"),
    ("MIT-0", "MIT No Attribution"),
    ("MIT-0", f"{_MIT_GRANT}. {_DISCLAIMER_MIT}"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "Released under the 2-Clause BSD License."),
    ("BSD-2-Clause", f"{_BSD_2} {_DISCLAIMER_BSD}"),
    ("BSD-2-Clause", _BSD_2),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", f"{_BSD_2} {_BSD_CLAUSE_3} {_DISCLAIMER_BSD}"),
    ("BSD-3-Clause", f"{_BSD_2} {_BSD_CLAUSE_3}"),
    ("BSD-3-Clause", _BSD_CLAUSE_3),
    ("ISC", "ISC License"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_DISCLAIMER_ISC}"),
    ("0BSD", "BSD Zero Clause License"),
    ("0BSD", f"{_ISC_GRANT}. {_DISCLAIMER_ISC}"),
    ("Zlib", "zlib License"),
    (
        "Zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone "
        "to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; "
        "you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions "
        "must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("WTFPL", "Do What The Fuck You Want To Public License Version 2, December 2004"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CDDL-1.0", "Common Development and Distribution License (CDDL) Version 1.0"),
    ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License."),
    ("EUPL-1.2", "European Union Public Licence v. 1.2 EUPL"),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL (the Licence); You may not use this work except in compliance with the Licence."),
    ("Artistic-2.0", "The Artistic License 2.0"),
    ("Artistic-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    *_creative_commons_forms(),
    *_gnu_forms(),
    (PROPRIETARY, "Copyright, all rights reserved."),
]
