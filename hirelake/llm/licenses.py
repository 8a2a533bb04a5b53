"""License scan by canonical digest: case, punctuation, copyright lines and equivalent spellings are
normalised away, and the digest of the entire text is hash-joined to digests of known licences.

A text is looked up whole, and so is each of its lines against one-line notices; both by a join on digests,
and tables of any size. Null and blank texts have the digest of the empty string and match nothing. Rows are
judged alone; repeats get equal results. Where a column of the input is named canonical_sha256, license_id or
notices, the new column of that name gets `_` appended.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm.common import broadcast_small, free_names, materialise, text_key

#: Larger tables than this are joined by shuffle instead of broadcast.
BROADCAST_ROWS = 100_000
#: A line without any of these states no licence that NOTICES knows. Other notices are looked for in all lines.
NOTICE_WORDS = "(?i)licen[cs]|spdx|cc0"

# Licence texts and one-line notices as their publishers word them.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU GPL v3.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
}
TEXTS = {
    "MIT": """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""",
    "ISC": """ISC License

Copyright (c) <year> <copyright holders>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
""",
    "0BSD": """Zero-Clause BSD

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
""",
    "Zlib": """zlib License

Copyright (c) <year> <copyright holders>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
""",
}
TEXTS |= {p.name.removesuffix(".txt"): p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}

# Pairs of spellings that licence texts use for one another.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"), ("noncommercial", "non commercial"), ("organisation", "organization"), ("recognise", "recognize"), ("favour", "favor"), ("non infringement", "noninfringement"), ("acknowledgement", "acknowledgment"), ("copyright owner", "copyright holder"), ("merchantibility", "merchantability"), ("http", "https")]

COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n©]*(?:copyright|copr\.?|\(c\)|©)[^\p{L}\n]*(?:\((?:c)\)|©|[0-9<\[]|year)[^\n]*$"
NOT_LETTERS = r"[^\p{L}\p{N}]+"
RESERVED_LINE = r"(?m)^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, one spelling, no punctuation, single blanks."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(F.regexp_replace(t, COPYRIGHT_LINE, ""), RESERVED_LINE, "")
    # a blank before and one after each word, so that a spelling is replaced beside another one too
    t = F.concat(F.lit(" "), F.regexp_replace(t, NOT_LETTERS, "  "), F.lit(" "))
    for old, new in SPELLINGS:
        own = lambda x: F.lit(f" {x} ".replace(" ", "  ")[1:-1])
        t = F.replace(t, own(old), own(new))
    return F.replace(F.trim(t), F.lit("  "), F.lit(" "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    """license_id, kind ("text" or "notice") and text of what the library knows."""
    rows = [(k, "text", t) for k, t in TEXTS.items()] + [(k, "notice", t) for k, ts in NOTICES.items() for t in ts]
    listed = F.array(*(F.struct(F.lit(k).alias("license_id"), F.lit(kind).alias("kind"), F.lit(t).alias("text")) for k, kind, t in rows))
    return spark.range(1).select(F.inline(listed))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Columns of `docs` plus canonical_sha256, license_id (of the entire text, or null) and notices (ids of the
    licences that whole lines state, in order, comma-joined; null where there are none)."""
    new = free_names(docs.columns, "canonical_sha256", "license_id", "notices", "_text_id")
    sha, found, said, key = new.values()
    table = materialise(known.select(digest(F.col("text")).alias(sha), "kind", "license_id", F.col("text").rlike(NOTICE_WORDS).alias("worded")), "license-digests")
    texts = table.groupBy(sha).agg(F.min("license_id").alias(found))
    notices = _notices(docs, table, sha).withColumnsRenamed({"notices": said, "text_id": key})
    d = docs.withColumns({sha: digest(F.col("text")), key: text_key(F.col("text"))})
    d = d.join(broadcast_small(texts, BROADCAST_ROWS), sha, "left").join(broadcast_small(notices, BROADCAST_ROWS), key, "left")
    return d.select(*docs.columns, sha, found, said)


def _notices(docs: DataFrame, table: DataFrame, sha: str) -> DataFrame:
    """text_id and notices of the texts that state a licence in a line. Equal lines of a text travel once."""
    known = table.filter("kind = 'notice'").groupBy(sha).agg(F.min("license_id").alias("id"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    if table.filter("kind = 'notice' and not worded").isEmpty():
        lines = F.filter(lines, lambda x: x.rlike(NOTICE_WORDS))
    at = docs.select(text_key(F.col("text")).alias("text_id"), F.posexplode(lines).alias("pos", "line")).select("text_id", "pos", digest(F.col("line")).alias(sha))
    first = at.join(broadcast_small(known, BROADCAST_ROWS), sha).groupBy("text_id", "id").agg(F.min("pos").alias("pos"))
    # one row per text and licence, so the list of a text is no longer than the list of licences
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"])
    return materialise(first.groupBy("text_id").agg(F.array_join(listed, ",").alias("notices")), "license-notices")
