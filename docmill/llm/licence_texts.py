"""Licence notices that the scan looks for, by label."""

import re

# Wording of public licence notices.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "apache-2.0#short": "Licensed under the Apache License, Version 2.0",
    "gpl-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "gpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "gpl-3.0#short": "licensed under the GNU General Public License, version 3",
    "gpl-2.0#short": "licensed under the GNU General Public License, version 2",
    "lgpl": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely""",
    "bsd-3-clause": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "bsd#disclaimer": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "isc#disclaimer": """IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "agpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "lgpl-3.0": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "gpl#warranty": """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "bsl-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so""",
    "wtfpl": """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION""",
    "postgresql": """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.""",
    "zlib#terms": """The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.""",
    "epl-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "cc0-1.0": """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.""",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-4.0#short": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-sa-4.0#short": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-nc-4.0#short": "Licensed under CC BY-NC 4.0",
    "cc-by-nd-4.0#short": "Licensed under CC BY-ND 4.0",
    "mit#short": "Released under the MIT License",
}
# SPDX identifiers and names of public licences.
NAMES = {
    "0BSD": "BSD Zero Clause License",
    "AFL-3.0": "Academic Free License 3.0 | Academic Free License version 3.0",
    "AGPL-3.0": "GNU Affero General Public License version 3 | GNU Affero General Public License v3 | GNU AGPL version 3 | GNU AGPL v3",
    "Apache-1.1": "Apache License 1.1 | Apache License Version 1.1 | Apache Software License 1.1",
    "Apache-2.0": "Apache License 2.0 | Apache License Version 2.0 | Apache License v2.0 | Apache 2.0 License",
    "Artistic-1.0": "Artistic License 1.0",
    "Artistic-2.0": "Artistic License 2.0",
    "BlueOak-1.0.0": "Blue Oak Model License 1.0.0",
    "BSD-1-Clause": "BSD 1 Clause License",
    "BSD-2-Clause": "BSD 2 Clause License | Simplified BSD License | FreeBSD License",
    "BSD-3-Clause": "BSD 3 Clause License | New BSD License | Modified BSD License | Revised BSD License",
    "BSD-4-Clause": "BSD 4 Clause License | Original BSD License",
    "BSD-3-Clause-Clear": "BSD 3 Clause Clear License",
    "BSL-1.0": "Boost Software License 1.0 | Boost Software License Version 1.0",
    "BUSL-1.1": "Business Source License 1.1",
    "CC-BY-3.0": "Creative Commons Attribution 3.0 | CC BY 3.0",
    "CC-BY-4.0": "Creative Commons Attribution 4.0 | CC BY 4.0",
    "CC-BY-NC-4.0": "Creative Commons Attribution NonCommercial 4.0 | CC BY NC 4.0",
    "CC-BY-NC-ND-4.0": "Creative Commons Attribution NonCommercial NoDerivatives 4.0 | CC BY NC ND 4.0",
    "CC-BY-NC-SA-4.0": "Creative Commons Attribution NonCommercial ShareAlike 4.0 | CC BY NC SA 4.0",
    "CC-BY-ND-4.0": "Creative Commons Attribution NoDerivatives 4.0 | CC BY ND 4.0",
    "CC-BY-SA-3.0": "Creative Commons Attribution ShareAlike 3.0 | CC BY SA 3.0",
    "CC-BY-SA-4.0": "Creative Commons Attribution ShareAlike 4.0 | CC BY SA 4.0",
    "CC0-1.0": "CC0 1.0 Universal | Creative Commons Zero v1.0 Universal | CC0 1.0",
    "CDDL-1.0": "Common Development and Distribution License 1.0 | Common Development and Distribution License version 1.0",
    "CECILL-2.1": "CeCILL Free Software License Agreement v2.1",
    "CPL-1.0": "Common Public License 1.0",
    "ECL-2.0": "Educational Community License 2.0",
    "EPL-1.0": "Eclipse Public License 1.0 | Eclipse Public License version 1.0",
    "EPL-2.0": "Eclipse Public License 2.0 | Eclipse Public License version 2.0",
    "EUPL-1.2": "European Union Public License 1.2 | European Union Public Licence v1.2",
    "GFDL-1.2": "GNU Free Documentation License version 1.2",
    "GFDL-1.3": "GNU Free Documentation License version 1.3",
    "GPL-1.0": "GNU General Public License version 1 | GNU General Public License v1",
    "GPL-2.0": "GNU General Public License version 2 | GNU General Public License v2 | GNU GPL version 2 | GNU GPL v2",
    "GPL-3.0": "GNU General Public License version 3 | GNU General Public License v3 | GNU GPL version 3 | GNU GPL v3",
    "HPND": "Historical Permission Notice and Disclaimer",
    "IPL-1.0": "IBM Public License 1.0",
    "ISC": "ISC License",
    "LGPL-2.0": "GNU Library General Public License version 2",
    "LGPL-2.1": "GNU Lesser General Public License version 2.1 | GNU Lesser General Public License v2.1 | GNU LGPL version 2.1 | GNU LGPL v2.1",
    "LGPL-3.0": "GNU Lesser General Public License version 3 | GNU Lesser General Public License v3 | GNU LGPL version 3 | GNU LGPL v3",
    "LPPL-1.3c": "LaTeX Project Public License 1.3c",
    "MIT": "MIT License | Expat License",
    "MIT-0": "MIT No Attribution License",
    "MPL-1.1": "Mozilla Public License 1.1 | Mozilla Public License Version 1.1",
    "MPL-2.0": "Mozilla Public License 2.0 | Mozilla Public License Version 2.0 | Mozilla Public License v2.0",
    "MS-PL": "Microsoft Public License",
    "MS-RL": "Microsoft Reciprocal License",
    "NCSA": "University of Illinois NCSA Open Source License",
    "ODbL-1.0": "Open Data Commons Open Database License v1.0 | Open Database License v1.0",
    "ODC-By-1.0": "Open Data Commons Attribution License v1.0",
    "OFL-1.1": "SIL Open Font License 1.1 | SIL Open Font License Version 1.1",
    "OSL-3.0": "Open Software License 3.0",
    "PDDL-1.0": "Open Data Commons Public Domain Dedication and License 1.0",
    "PostgreSQL": "PostgreSQL License",
    "PSF-2.0": "Python Software Foundation License Version 2",
    "QPL-1.0": "Q Public License 1.0",
    "SSPL-1.0": "Server Side Public License version 1 | Server Side Public License v1",
    "UPL-1.0": "Universal Permissive License v1.0",
    "Unlicense": "The Unlicense",
    "Vim": "Vim License",
    "WTFPL": "Do What The F*ck You Want To Public License",
    "X11": "X11 License",
    "Zlib": "zlib License",
    "ZPL-2.1": "Zope Public License 2.1",
}
#: What stands before a licence's name in a notice of one line.
BEFORE = ["licensed under the", "licensed under", "released under the", "distributed under the", "available under the", "provided under the", "under the terms of the", "this file is part of a work under the"]


def short_templates(names: dict[str, str] = NAMES) -> dict[str, str]:
    """One-line notices of each licence: its identifier behind SPDX-License-Identifier, its names behind BEFORE, and names that tell enough by themselves."""
    out = {}
    for key, every in names.items():
        notices = [f"SPDX-License-Identifier: {key}"]
        for name in every.split(" | "):
            notices += [f"{before} {name}" for before in BEFORE] + [name] * (len(re.findall("[A-Za-z0-9]+", name)) >= 4)
        out |= {f"{key.lower()}#{i}": notice for i, notice in enumerate(notices)}
    return out


#: Phrases that count wherever their words stand consecutively, and their labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
