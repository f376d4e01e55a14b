"""License texts, standard headers and one-line notices that the license scan looks for."""

from __future__ import annotations

_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_FORMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


def _gnu(name: str, version: str, thing: str = "program") -> str:
    """The header that the GNU licenses ask for."""
    return (
        f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. "
        f"You should have received a copy of the GNU {name} along with this {thing}. If not, see <https://www.gnu.org/licenses/>."
    )


#: Whole licenses and headers by name.
LONG = (
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd-2-clause-text", f"{_FORMS} 1. {_SOURCE} 2. {_BINARY} {_AS_IS}"),
    ("bsd-3-clause-text", f"{_FORMS} 1. {_SOURCE} 2. {_BINARY} 3. {_NAMES} {_AS_IS}"),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-2.0-or-later-header", _gnu("General Public License", "2")),
    ("gpl-3.0-or-later-header", _gnu("General Public License", "3")),
    ("lgpl-2.1-or-later-header", _gnu("Lesser General Public License", "2.1", "library")),
    ("lgpl-3.0-or-later-header", _gnu("Lesser General Public License", "3")),
    ("agpl-3.0-or-later-header", _gnu("Affero General Public License", "3")),
    ("mpl-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *((f"cc-{code}-4.0-notice", f"This work is licensed under a Creative Commons {name} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/{code}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.") for code, name in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nd", "Attribution-NoDerivatives"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"))),
)
#: One-line notices, which are too short for a share of 0.8 to allow an edit, in their usual wordings.
SHORT = (
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0:license-2.0", "licensed under the Apache License 2.0"),
    ("apache-2.0:2.0-license", "licensed under the Apache 2.0 License"),
    ("apache-2.0:spdx", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd", "Use of this source code is governed by a BSD-style license."),
    ("bsd:2-clause", "licensed under the BSD 2-Clause License"),
    ("bsd:3-clause", "licensed under the BSD 3-Clause License"),
    ("bsd:licensed", "licensed under the BSD License"),
    ("bsd:spdx-2", "SPDX-License-Identifier: BSD-2-Clause"),
    ("bsd:spdx-3", "SPDX-License-Identifier: BSD-3-Clause"),
    *((f"cc-{code.lower()}-4.0{kind}", text) for code, name in (("BY", "Attribution"), ("BY-NC", "Attribution-NonCommercial"), ("BY-SA", "Attribution-ShareAlike")) for kind, text in (("", f"Licensed under CC {code} 4.0."), (":name", f"Creative Commons {name} 4.0 International"), (":spdx", f"SPDX-License-Identifier: CC-{code}-4.0"))),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0:v3", "licensed under the GNU General Public License v3.0"),
    ("gpl-3.0:gpl", "licensed under the GNU GPL v3"),
    ("gpl-3.0:spdx-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("gpl-3.0:spdx-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("mit", "Released under the MIT License."),
    ("mit:licensed", "licensed under the MIT License"),
    ("mit:distributed", "distributed under the MIT License"),
    ("mit:available", "available under the MIT License"),
    ("mit:terms", "under the terms of the MIT License"),
    ("mit:spdx", "SPDX-License-Identifier: MIT"),
)
