"""Licence scan: Dice coefficient of word bigrams between stretches of normalised text and licence templates.

A stretch is any run of words of the text, across lines and paragraphs. The best one begins and ends with a bigram
of the template, and its first bigram comes only once. A stretch with more than 2n(1-t)/t bigrams that a template
of n has not can't reach coefficient t, nor can one with fewer than n*t/(2-t) of the template's own, so few
stretches are ever looked at.
"""

from __future__ import annotations

import heapq
from bisect import bisect, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, slices, texts_of

THRESHOLD = 0.8

# Notices and texts of public licences.
TEMPLATES = {
    'Apache-2.0': [
        'Licensed under the Apache License, Version 2.0.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    'MIT': [
        'Released under the MIT License.',
        'Licensed under the MIT License.',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        'This project is licensed under the terms of the MIT license.',
    ],
    'GPL-3.0': [
        'This work is licensed under the GNU General Public License, version 3.',
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.',
    ],
    'GPL-2.0': [
        'This work is licensed under the GNU General Public License, version 2.',
        'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.',
    ],
    'CC-BY-NC-4.0': [
        'Licensed under CC BY-NC 4.0.',
        'This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.',
    ],
    'CC-BY-4.0': [
        'Licensed under CC BY 4.0.',
        'This work is licensed under a Creative Commons Attribution 4.0 International License.',
    ],
    'CC-BY-SA-4.0': [
        'Licensed under CC BY-SA 4.0.',
        'This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.',
    ],
    'ISC': [
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.',
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    'BSD-3-Clause': [
        'Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.',
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
        'Licensed under the BSD 3-Clause License.',
    ],
    'Unlicense': [
        'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.',
        'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    'MIT-0': [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    'JSON': [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The Software shall be used for Good, not Evil. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    'BSD-2-Clause': [
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
        'Licensed under the BSD 2-Clause License.',
    ],
    'BSD-4-Clause': [
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. 4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    '0BSD': [
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    'LGPL-2.1': [
        'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.',
        'This work is licensed under the GNU Lesser General Public License, version 2.1.',
    ],
    'LGPL-3.0': [
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.',
        'This work is licensed under the GNU Lesser General Public License, version 3.',
    ],
    'AGPL-3.0': [
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.',
        'This work is licensed under the GNU Affero General Public License, version 3.',
    ],
    'MPL-2.0': [
        'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.',
    ],
    'MPL-1.1': [
        'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an "AS IS" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the specific language governing rights and limitations under the License.',
    ],
    'EPL-1.0': [
        'All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html',
    ],
    'EPL-2.0': [
        'This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/',
    ],
    'CDDL-1.0': [
        'The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License. See the License for the specific language governing permissions and limitations under the License.',
    ],
    'EUPL-1.2': [
        'Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission - subsequent versions of the EUPL (the "Licence"); You may not use this work except in compliance with the Licence. You may obtain a copy of the Licence at:',
    ],
    'Zlib': [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
    'BSL-1.0': [
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        'Distributed under the Boost Software License, Version 1.0.',
    ],
    'WTFPL': [
        'DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.',
    ],
    'PostgreSQL': [
        'Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.',
    ],
    'NCSA': [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimers in the documentation and/or other materials provided with the distribution.',
    ],
    'Beerware': [
        'As long as you retain this notice you can do whatever you want with this stuff. If we meet some day, and you think this stuff is worth it, you can buy me a beer in return.',
    ],
    'OFL-1.1': [
        'This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at: https://scripts.sil.org/OFL',
    ],
    'GFDL-1.3': [
        'Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.',
    ],
    'Artistic-2.0': [
        'This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.',
    ],
    'PHP-3.01': [
        'This source file is subject to version 3.01 of the PHP license, that is bundled with this package in the file LICENSE, and is available through the world-wide-web at the following url: http://www.php.net/license/3_01.txt',
    ],
    'CC0-1.0': [
        'To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.',
        'This work is dedicated to the public domain under CC0 1.0 Universal.',
    ],
    'CC-BY-ND-4.0': [
        'Licensed under CC BY-ND 4.0.',
        'This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.',
    ],
    'CC-BY-NC-SA-4.0': [
        'Licensed under CC BY-NC-SA 4.0.',
        'This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.',
    ],
    'CC-BY-NC-ND-4.0': [
        'Licensed under CC BY-NC-ND 4.0.',
        'This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.',
    ],
    'CC-BY-3.0': [
        'This work is licensed under a Creative Commons Attribution 3.0 Unported License.',
    ],
    'CC-BY-SA-3.0': [
        'This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.',
    ],
    'ODbL-1.0': [
        'This database is made available under the Open Database License: http://opendatacommons.org/licenses/odbl/1.0/. Any rights in individual contents of the database are licensed under the Database Contents License.',
    ],
}

_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of letters, digits and other than ASCII, with A-Z lower-cased."""
    return text.translate(_CLEAN).split()


def bigrams(w: list[bytes]) -> set[bytes]:
    return set(map(b" ".join, zip(w, w[1:])))


class Templates:
    def __init__(self, templates: dict[str, list[str]], threshold: float):
        self.threshold = threshold
        self.all = [(name, g) for name, texts in sorted(templates.items()) for t in texts if (g := bigrams(words(t.encode())))]
        low, high = threshold / (2 - threshold), (2 - threshold) / threshold
        self.bounds = [(len(g) * low, len(g) * high) for _, g in self.all]
        self.least = min((b[0] for b in self.bounds), default=1)
        self.most = max((b[1] for b in self.bounds), default=0)
        self.pairs = [{tuple(x.split()) for x in g} for _, g in self.all]
        self.owners: dict[tuple[bytes, ...], list[int]] = {}
        for t, own in enumerate(self.pairs):
            for g in own:
                self.owners.setdefault(g, []).append(t)

    def best(self, w: list[bytes]) -> tuple[float, str] | None:
        """The greatest coefficient at the threshold or above, of equals the name first in order."""
        if len(w) - 1 < self.least:
            return None
        own, found = None, None
        for (name, g), (low, high) in zip(self.all, self.bounds):
            if len(w) - 1 < low:  # distinct bigrams are at most so many
                continue
            if own is None:
                own = bigrams(w[: 4 * int(self.most) + 8])
                if len(own) > self.most:  # too many already, whatever follows
                    return None
                own = bigrams(w)
            if low <= len(own) <= high:
                dice = 2 * len(own & g) / (len(own) + len(g))
                if dice >= self.threshold and (found is None or dice > found[0]):
                    found = (dice, name)
        return found

    def stretch(self, grams: list[tuple[bytes, bytes]], t: int, start: int, stop: int) -> tuple[float, int, str, int, int, int] | None:
        """The best stretch of bigrams from start on, before stop, at the threshold or above: sorts before lesser ones."""
        own, first = self.pairs[t], grams[start]
        most = 2 * len(own) * (1 - self.threshold) / self.threshold + 1e-9
        seen, shared, other, best, end = {first}, 1, 0, 2 / (1 + len(own)), start
        for j in range(start + 1, stop):
            g = grams[j]
            if g == first:  # without the first one the bigrams are the same
                break
            if g in seen:
                continue
            seen.add(g)
            if g in own:
                shared += 1
                dice = 2 * shared / (shared + other + len(own))
                if dice > best:
                    best, end = dice, j
            else:
                other += 1
                if other > most:
                    break
        return (-best, start - end, self.all[t][0], start, end, t) if best >= self.threshold else None

    def scan(self, text: bytes) -> dict[str, float]:
        """Licences found with their greatest coefficient.

        The best stretch of all counts first, then the best that shares no word with those before, and so on; of
        equal coefficients the longer stretch, then the name first in order.
        """
        w = words(text)
        owners, grams = self.owners, list(zip(w, w[1:]))
        places: dict[int, list[int]] = {}
        for i in [i for i, g in enumerate(grams) if g in owners]:
            for t in owners[grams[i]]:
                places.setdefault(t, []).append(i)
        heap = []
        for t, at in places.items():
            if len(at) >= (low := self.bounds[t][0] - 1e-9) and len({grams[i] for i in at}) >= low:
                heap += [found for i in at if (found := self.stretch(grams, t, i, len(grams)))]
        heapq.heapify(heap)
        out: dict[str, float] = {}
        taken: list[tuple[int, int]] = []  # first and last bigram
        while heap:
            dice, _, name, start, end, t = heapq.heappop(heap)
            k = bisect(taken, (start, len(grams)))
            if k and start <= taken[k - 1][1] + 1:
                continue
            stop = taken[k][0] - 1 if k < len(taken) else len(grams)
            if end < stop:
                insort(taken, (start, end))
                out.setdefault(name, -dice)
            elif start < stop and (found := self.stretch(grams, t, start, stop)):
                heapq.heappush(heap, found)
        return out


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, licences, coefficients) for each row of docs: names in order and the greatest coefficient of each.

    Null and empty texts, and texts that reach the threshold with no template, have none; an empty table gives no rows,
    and other columns are not read. Each stretch gives
    the one template that it is most like (see Templates.scan). Repeated rows are scanned alike. Templates are broadcast; they are
    a parameter, not data.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, threshold)
        for batch in slices(batches):
            found = [sorted(known.scan(t).items()) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([[k for k, _ in f] for f in found], pa.list_(pa.string())), pa.array([[v for _, v in f] for f in found], pa.list_(pa.float64()))], ["doc_id", "licences", "coefficients"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, licences array<string>, coefficients array<double>")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.size("licences").cast("long").alias("n_licences"), F.array_join("licences", ",").alias("licences"), F.round(F.coalesce(F.array_max("coefficients"), F.lit(0.0)), 6).alias("best_dice"))
