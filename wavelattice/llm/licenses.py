"""Licence scans by canonical digests, in DataFrame functions only.

A text is made canonical: copyright lines go, letters become lower case,
spellings with the same meaning become one, and everything but letters and
digits becomes a single space. Its digest is joined with the digests of known
licences made canonical the same way. Two kinds of text are looked up: a
document as a whole, and each of its lines as a whole (licence notices).

The known licences are a list in this module and the files of license_texts
(and a caller's; at most MAX_KNOWN in all), so broadcasting their digests is bounded. Lines without a match are
dropped before the shuffle, but for the partial row of their document.

Defined results: null and empty texts have no licence; all rows of one doc_id
(null too) are one document and their findings are united; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_KNOWN = 10_000

#: Pairs of pattern and the spelling it stands for, applied to lower-case text in this order.
EQUIVALENT = [
    (r"licence", "license"),
    (r"sub[ -]license", "sublicense"),
    (r"organisation", "organization"),
    (r"merchantibility", "merchantability"),
    (r"non[ -]commercial", "noncommercial"),
    (r"non[ -]infringement", "noninfringement"),
    (r"copyright[ -]holder", "copyright owner"),
    (r"gnu gpl", "gnu general public license"),
    (r"\bversion ([0-9])", "v\\1"),
    (r"&", " and "),
]
#: Fixed value: a line that only names owners or reserves rights.
COPYRIGHT_LINE = r"(?im)^[ \t]*(copyright\b|\(c\)|©|all rights reserved)[^\n]*$"

#: Notices by licence.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0"],
    "GPL-2.0": ["Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."],
    "CC0-1.0": ["Released under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
}
#: Whole licences.
TEXTS = {
    "MIT": """MIT License

Copyright (c) <year> <owner>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Zero-Clause BSD

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
}

#: The longer ones, a file each.
TEXTS |= {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def canonical(text: Column) -> Column:
    out = F.lower(F.regexp_replace(text, COPYRIGHT_LINE, ""))
    for pattern, spelling in EQUIVALENT:
        out = F.regexp_replace(out, pattern, spelling.replace("\\1", "$1"))
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def known(spark: SparkSession, extra: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license_id) of the licences listed here and of extra (license_id, text) pairs."""
    rows = [(k, t) for k, ts in NOTICES.items() for t in ts] + list(TEXTS.items()) + (extra or [])
    if len(rows) > MAX_KNOWN:
        raise ValueError(f"at most {MAX_KNOWN} known licences")
    made = spark.createDataFrame(rows, "license_id string, text string").select(F.md5(canonical(F.col("text"))).alias("known"), "license_id")
    return made.groupBy("known").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, extra: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per document: doc_id, license_id (whole text, else null), notice_licenses (sorted, comma-joined), n_notices, digest."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(canonical(text)).alias("whole"), F.split(text, "\n").alias("lines"))
    units = base.select(
        "doc_id",
        "whole",
        F.explode(F.concat(F.array(F.struct(F.lit(True).alias("all"), F.lit("").alias("unit"))), F.transform(F.filter("lines", lambda x: F.length(x) >= 1), lambda x: F.struct(F.lit(False).alias("all"), x.alias("unit"))))).alias("u"),
    ).select("doc_id", F.col("u.all").alias("all"), F.when(F.col("u.all"), F.col("whole")).otherwise(F.md5(canonical(F.col("u.unit")))).alias("digest"))
    found = units.join(F.broadcast(known(docs.sparkSession, extra)), F.col("digest") == F.col("known"), "left").where("all or license_id is not null")
    return found.groupBy("doc_id").agg(
        F.min(F.when(F.col("all"), F.col("license_id"))).alias("license_id"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("all"), F.col("license_id")))), ",").alias("notice_licenses"),
        F.count(F.when(~F.col("all"), F.col("license_id"))).alias("n_notices"),
        F.min(F.when(F.col("all"), F.col("digest"))).alias("digest"),
    )
