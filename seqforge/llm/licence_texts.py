"""Public licences and notices as they are printed, names that licences go by, and which of
their sentences tell them. <*> stands for up to SLOT words, such as a holder's name."""

from __future__ import annotations

SLOT = 14

#: Whole texts of short licences, and the notices by which long ones are applied.
TEXTS = {
    "MIT": """
MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""",
    "X11": """
X11 License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

Except as contained in this notice, the name of <*> shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from <*>.
""",
    "MIT-0": """
MIT No Attribution

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.
""",
    "ISC": """
ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
""",
    "0BSD": """
BSD Zero Clause License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
""",
    "BSD-2-Clause": """
BSD 2-Clause License

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
""",
    "BSD-3-Clause": """
BSD 3-Clause License

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of <*> nor the names of <*> may be used to endorse or promote products derived from this software without specific prior written permission.
""",
    "BSD-4-Clause": """
BSD 4-Clause License

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. All advertising materials mentioning features or use of this software must display the following acknowledgement:

4. Neither the name of <*> nor the names of <*> may be used to endorse or promote products derived from this software without specific prior written permission.
""",
    "Zlib": """
zlib License

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.
""",
    "BSL-1.0": """
Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
""",
    "Unlicense": """
This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
""",
    "WTFPL": """
DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE

Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.

TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO.
""",
    "NCSA": """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers.

Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimers in the documentation and/or other materials provided with the distribution.
""",
    "PostgreSQL": """
Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.
""",
    "curl": """
Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

Except as contained in this notice, the name of a copyright holder shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization of the copyright holder.
""",
    "FSFAP": """
Copying and distribution of this file, with or without modification, are permitted in any medium without royalty provided the copyright notice and this notice are preserved. This file is offered as-is, without any warranty.
""",
    "Beerware": """
As long as you retain this notice you can do whatever you want with this stuff. If we meet some day, and you think this stuff is worth it, you can buy me a beer in return.
""",
    "Apache-2.0": """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.
""",
    "GPL-2.0": """
This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
""",
    "GPL-3.0": """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
""",
    "LGPL-2.1": """
This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
""",
    "LGPL-3.0": """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
""",
    "AGPL-3.0": """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
""",
    "MPL-2.0": """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.
""",
    "EPL-2.0": """
This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0
""",
    "CDDL-1.0": """
The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). You may not use this file except in compliance with the License.
""",
    "EUPL-1.2": """
Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission - subsequent versions of the EUPL (the "Licence"); You may not use this work except in compliance with the Licence.
""",
    "OFL-1.1": """
This Font Software is licensed under the SIL Open Font License, Version 1.1.
""",
    "Artistic-2.0": """
Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed.
""",
    "All-rights-reserved": """
All rights reserved.
""",
}
#: Sentences of a text (from 0) that tell its licence where not all are there.
CORES = {
    "MIT": [(1, 2), (2,)], "X11": [(1, 2, 3)], "MIT-0": [(1,)], "ISC": [(1,)], "0BSD": [(1,)], "BSD-2-Clause": [(1, 2, 3)], "BSD-3-Clause": [(1, 2, 3, 4)], "BSD-4-Clause": [(1, 2, 3, 4, 5)],
    "Zlib": [(1, 2, 3)], "BSL-1.0": [(1,)], "Unlicense": [(0,)], "WTFPL": [(0,), (3,)], "NCSA": [(0, 1, 2)], "PostgreSQL": [(0,)], "curl": [(0, 1)], "FSFAP": [(0,)], "Beerware": [(0, 1)],
    "Apache-2.0": [(0, 1, 2), (0, 1)], "GPL-2.0": [(0, 1, 2)], "GPL-3.0": [(0,)], "LGPL-2.1": [(0, 1, 2)], "LGPL-3.0": [(0,)], "AGPL-3.0": [(0,)], "MPL-2.0": [(0,)], "EPL-2.0": [(0,)], "CDDL-1.0": [(0,)],
    "EUPL-1.2": [(0, 1)], "OFL-1.1": [(0,)], "Artistic-2.0": [(0, 1)], "All-rights-reserved": [(0,)],
}
#: Shorter wordings of a text's sentence that are known as well: licence, number of the sentence, wording.
SHORTER = [("BSD-2-Clause", 3, "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.")]
#: Names that licences go by, in a sentence of the FORMS.
NAMES = {
    "MIT": ["the MIT License"], "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0"], "ISC": ["the ISC License"], "Zlib": ["the zlib License"], "BSL-1.0": ["the Boost Software License, Version 1.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License"], "BSD-3-Clause": ["the BSD 3-Clause License"], "GPL-2.0": ["the GNU General Public License, version 2", "the GNU General Public License v2", "GPLv2"], "GPL-3.0": ["the GNU General Public License, version 3", "the GNU General Public License v3", "GPLv3"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1", "LGPLv2.1"], "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "LGPLv3"], "AGPL-3.0": ["the GNU Affero General Public License, version 3", "AGPLv3"], "MPL-2.0": ["the Mozilla Public License, version 2.0"],
    "EPL-2.0": ["the Eclipse Public License, version 2.0"], "Unlicense": ["the Unlicense"], "OFL-1.1": ["the SIL Open Font License, Version 1.1"], "Artistic-2.0": ["the Artistic License 2.0"],
    "CC-BY-4.0": ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License"], "CC-BY-SA-4.0": ["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"], "CC-BY-NC-4.0": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "the Creative Commons Attribution-NoDerivatives 4.0 International License"], "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"], "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "CC-BY-3.0": ["CC BY 3.0", "the Creative Commons Attribution 3.0 Unported License"], "CC-BY-SA-3.0": ["CC BY-SA 3.0", "the Creative Commons Attribution-ShareAlike 3.0 Unported License"], "CC-BY-2.0": ["CC BY 2.0"], "CC-BY-SA-2.0": ["CC BY-SA 2.0"],
    "AFL-3.0": ["the Academic Free License version 3.0"], "Apache-1.1": ["the Apache License, Version 1.1"], "APSL-2.0": ["the Apple Public Source License 2.0"], "Artistic-1.0": ["the Artistic License 1.0"], "BlueOak-1.0.0": ["the Blue Oak Model License 1.0.0"],
    "BUSL-1.1": ["the Business Source License 1.1"], "CDDL-1.1": ["the Common Development and Distribution License 1.1"], "CDDL-1.0": ["the Common Development and Distribution License 1.0"], "CECILL-2.1": ["the CeCILL License, version 2.1"], "CPL-1.0": ["the Common Public License 1.0"],
    "ECL-2.0": ["the Educational Community License, Version 2.0"], "Elastic-2.0": ["the Elastic License 2.0"], "EPL-1.0": ["the Eclipse Public License, version 1.0"], "EUPL-1.1": ["the European Union Public License, version 1.1"], "EUPL-1.2": ["the European Union Public License, version 1.2"],
    "GFDL-1.2": ["the GNU Free Documentation License, version 1.2"], "GFDL-1.3": ["the GNU Free Documentation License, version 1.3"], "GPL-1.0": ["the GNU General Public License, version 1"], "LGPL-2.0": ["the GNU Library General Public License, version 2"], "IPL-1.0": ["the IBM Public License 1.0"],
    "LPPL-1.3c": ["the LaTeX Project Public License, version 1.3c"], "MPL-1.1": ["the Mozilla Public License, version 1.1"], "MS-PL": ["the Microsoft Public License"], "MS-RL": ["the Microsoft Reciprocal License"], "MulanPSL-2.0": ["the Mulan Permissive Software License, Version 2"],
    "NCSA": ["the University of Illinois/NCSA Open Source License"], "ODbL-1.0": ["the Open Database License 1.0"], "OpenSSL": ["the OpenSSL License"], "OSL-3.0": ["the Open Software License 3.0"], "PHP-3.01": ["the PHP License, version 3.01"], "PostgreSQL": ["the PostgreSQL License"],
    "PSF-2.0": ["the Python Software Foundation License 2.0"], "QPL-1.0": ["the Q Public License 1.0"], "SSPL-1.0": ["the Server Side Public License, version 1"], "UPL-1.0": ["the Universal Permissive License 1.0"], "Vim": ["the Vim License"], "ZPL-2.1": ["the Zope Public License 2.1"],
    "0BSD": ["the BSD Zero Clause License"], "MIT-0": ["the MIT No Attribution License"], "X11": ["the X11 License"], "BSD-4-Clause": ["the BSD 4-Clause License"], "WTFPL": ["the WTFPL"],
}
#: What a sentence that names a licence says, besides the name alone.
FORMS = ["{}", "Licensed under {}", "Released under {}", "Distributed under {}", "This work is licensed under {}", "This project is licensed under {}", "This software is licensed under {}", "This file is licensed under {}", "This work is released under {}", "This program is licensed under {}", "License: {}"]
#: The forms that may say "the terms of" a licence, and those in which its SPDX identifier stands for its name.
TERMS = ["Licensed under the terms of {}", "Released under the terms of {}", "Distributed under the terms of {}", "This work is licensed under the terms of {}", "This project is licensed under the terms of {}", "This software is licensed under the terms of {}"]
IDENTIFIED = ["License: {}", "Licensed under {}", "Released under {}", "Distributed under {}", "This project is licensed under {}"]
