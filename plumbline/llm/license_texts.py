"""Notices and paragraphs of public licences, and what must stand in a file that bears them.

Fixed values: (label, paragraph, key phrases of the paragraph). Case and punctuation do not count.
"""

from __future__ import annotations

WARRANTY_MIT = (
    'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. '
    "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."
)
FSF = "as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."
HOPE = "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name}General Public License for more details."

TEXTS = (
    ("mit", "Released under the MIT License", ("MIT License",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", ("hereby granted free of charge", "to deal in the software without restriction")),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + WARRANTY_MIT, ("this permission notice shall be included", "merchantability fitness for a particular purpose and noninfringement")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.", ("with or without fee is hereby granted",)),
    ("isc", "In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.", ("negligence or other tortious action",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ("redistribution and use in source and binary forms",)),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ("endorse or promote products derived from this software",)),
    ("bsd", "In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.", ("procurement of substitute goods or services", "however caused and on any theory of liability")),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("Apache License Version 2.0",)),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ("specific language governing permissions and limitations under the license",)),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ("GNU General Public License",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License " + FSF.format(v="3"), ("GNU General Public License",)),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License " + FSF.format(v="2"), ("GNU General Public License",)),
    ("gpl", HOPE.format(what="program", name=""), ("the gnu general public license for more details",)),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License " + FSF.format(v="2.1"), ("GNU Lesser General Public License",)),
    ("lgpl", HOPE.format(what="library", name="Lesser "), ("the gnu lesser general public license for more details",)),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License " + FSF.format(v="3"), ("GNU Affero General Public License",)),
    ("agpl", "licensed under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("GNU Affero General Public License",)),
    ("agpl", HOPE.format(what="program", name="Affero "), ("the gnu affero general public license for more details",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("Mozilla Public License",)),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.", ("to alter it and redistribute it freely",)),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so", ("any person or organization obtaining a copy of the software and accompanying documentation",)),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ("free and unencumbered software",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("CC BY NC",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("CC BY SA",)),
    ("cc-by", "Licensed under CC BY 4.0", ("CC BY 4",)),
    ("cc-by-nc", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("Creative Commons Attribution NonCommercial",)),
    ("cc-by-sa", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("Creative Commons Attribution ShareAlike",)),
    ("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License", ("Creative Commons Attribution 4.0",)),
    ("cc0", "Dedicated to the public domain under CC0 1.0 Universal", ("CC0 1.0",)),
)
FUNCTION_WORDS = frozenset("a an and any are as at be by can for in into is it not of or that the this to under you".split())
