"""Licence scan by canonical digests.

A text unit (a whole document, one of its lines, or a run of lines) is brought to a canonical
form: lower case, no copyright lines, one spelling of equivalent words and
versions, punctuation and white space as one space. The SHA-256 digest of
that form is hash-joined to the digests of known licence texts and notices,
so a unit matches only if its entire canonical text does.

A canonical form whose length no known text has is not hashed. A run of lines is
a unit wherever its canonical form has the length of a known text; numpy finds
these runs on the lengths of the lines. The known texts are a list of fixed
size: the notices of ``KNOWN`` and the texts and headers of ``known_texts``.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$"
VERSION = r"\b(?:version|ver|v)\.?[ ]*([0-9])"
ZERO_MINOR = r"([0-9])\.0\b"
PUNCTUATION = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
BROADCAST_UP_TO = 10_000  # known texts; a longer list is joined by shuffling digests
# spelling -> the spelling that stands for both
SPELLINGS = [("licence", "license"), ("sublicence", "sublicense"), ("organisation", "organization"), ("favour", "favor"),
             ("behaviour", "behavior"), ("colour", "color"), ("centre", "center"), ("judgement", "judgment"),
             ("cheque", "check"), ("noncommercial", "non commercial"), ("https://", "http://"), ("&", " and ")]

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted"""
ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""

# fixed values: (licence id, known text or notice)
KNOWN = [
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("ISC", f"{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{ISC_DISCLAIMER}"),
    ("0BSD", f"{ISC_GRANT}.\n\n{ISC_DISCLAIMER}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
]


HEADERS = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required
by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
}
GNU = [(f"{short}-{v}", name, v) for short, name, versions in (
    ("GPL", "GNU General Public License", (2, 3)), ("LGPL", "GNU Lesser General Public License", (2.1, 3)),
    ("AGPL", "GNU Affero General Public License", (3,))) for v in versions]
GNU_HEADER = """This {what} is free software{stop} you can redistribute it and/or modify it under the terms of the {name} as published by
the Free Software Foundation, {version}.

This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."""
GNU_COPY = "You should have received a copy of the {name} along with this {what}. If not, see {url}."
TEXTS = Path(__file__).parent / "license_texts"


def known_texts() -> list[tuple[str, str]]:
    """``KNOWN``, the licence texts of the package and the standard headers, with their usual titles."""
    out = KNOWN + [("MIT", f"The MIT License{mark}\n\n{MIT}") for mark in (" (MIT)", "")]
    out += [(i, f"{title}\n\n{t}") for i, t in KNOWN[2:4] for title in ("ISC License", "BSD Zero Clause License", "Zero-Clause BSD")
            if (i == "ISC") == (title == "ISC License")]
    for path in sorted(TEXTS.glob("*.txt")):
        name, text = path.stem, path.read_text(encoding="utf-8")
        out.append((name, text))
        # the terms alone, without the appendix that tells how to apply them
        end = re.search(r"(?m)^[ \t]*END OF (THE )?TERMS AND CONDITIONS[ \t]*$", text)
        if end:
            out += [(name, text[:end.start()]), (name, text[:end.end()])]
    three = (TEXTS / "BSD-3-Clause.txt").read_text(encoding="utf-8")
    two = three[:three.index("3. Neither")] + three[three.index("THIS SOFTWARE"):]
    out += [("BSD-2-Clause", two)]
    for name, text, titles in (("BSD-3-Clause", three, ("BSD 3-Clause License", "The 3-Clause BSD License")),
                               ("BSD-2-Clause", two, ("BSD 2-Clause License", "The 2-Clause BSD License"))):
        # bullets instead of numbers have the same words
        plain = re.sub(r"(?m)^[123]\. ", "* ", text)
        out += [(name, plain), *[(name, f"{t}\n\n{x}") for t in titles for x in (text, plain)],
                (name, "All rights reserved.\n\n" + text), (name, "All rights reserved.\n\n" + plain),
                *[(name, f"{t}\n\nAll rights reserved.\n\n{x}") for t in titles for x in (text, plain)]]
    out += list(HEADERS.items())
    for short, name, v in GNU:
        full = short if "." in short else short + ".0"
        for what in ("program", "library", "software", "file"):
            for suffix, version in (("-or-later", f"either version {v} of the License, or (at your option) any later version"),
                                    ("-only", f"version {v} of the License"), ("-only", f"version {v}")):
                for stop in (":", ";"):
                    head = GNU_HEADER.format(what=what, name=name, stop=stop, version=version)
                    out.append((full + suffix, head))
                    for url in ("<http://www.gnu.org/licenses/>", "<http://gnu.org/licenses/>"):
                        out.append((full + suffix, head + "\n\n" + GNU_COPY.format(name=name, what=what, url=url)))
    return out


def canonical(text: Column) -> Column:
    """Canonical form of a text unit; empty if nothing but copyright lines or punctuation is left."""
    t = F.translate(text, UPPER, LOWER)
    t = F.regexp_replace(t, COPYRIGHT_LINE, "")
    for spelling, common in SPELLINGS:
        t = F.replace(t, F.lit(spelling), F.lit(common))
    t = F.regexp_replace(t, VERSION, "version $1")
    t = F.regexp_replace(t, ZERO_MINOR, "$1")
    return F.trim(F.regexp_replace(t, PUNCTUATION, " "))


def known_digests(spark: SparkSession, known: list[tuple[str, str]]) -> tuple[DataFrame, list[int]]:
    """(digest, license_id) of the known texts, and the lengths of their canonical forms."""
    rows = spark.createDataFrame(known, "license_id string, text string").select("license_id", canonical(F.col("text")).alias("form"))
    # read once, so that later plans do not bring the texts to their form again
    found = rows.where("form <> ''").select("license_id", F.length("form"), F.sha2("form", 256)).collect()
    ids: dict[str, str] = {}
    for name, _, digest in found:
        ids[digest] = min(name, ids.get(digest, name))
    return spark.createDataFrame(sorted(ids.items()), "digest string, license_id string"), sorted({n for _, n, _ in found})


def matching_runs(forms: list[str], lengths: np.ndarray) -> list[tuple[int, int, str]]:
    """(first line, lines, canonical form) of the runs of two or more lines whose form has a known length.

    ``forms`` are the canonical lines; blank ones add nothing, and a run
    neither begins nor ends with one.
    """
    size = np.array([len(f) for f in forms])
    line = np.flatnonzero(size)
    if len(line) < 2 or not len(lengths):
        return []
    begin = np.concatenate([[0], np.cumsum(size[line][:-1] + 1)])
    end = begin + size[line]
    joined, out = None, []
    for n in lengths[lengths <= end[-1]].tolist():
        at = np.searchsorted(end, begin + n)
        at[at == len(end)] = 0
        for i in np.flatnonzero((end[at] == begin + n) & (at > np.arange(len(line)))).tolist():
            joined = joined or " ".join(forms[k] for k in line.tolist())
            out.append((int(line[i]) + 1, int(line[at[i]] - line[i]) + 1, joined[begin[i]:begin[i] + n]))
    return out


def scan_licenses(documents: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id and notices of every row: (line, license_id, lines), line 0 for the whole text, sorted.

    ``lines`` is 0 for the whole text, 1 for a line and more for a run that
    begins at ``line``. Defined cases: null, empty and blank texts have no
    notices; a text of one line that is a known text counts as the whole text
    and as its line 1; runs of lines are left out where the whole text is
    known or a longer known run holds them; repeated rows and rows that share a
    doc_id are scanned one by one; an empty list of known texts finds nothing;
    other columns are ignored.
    """
    spark = documents.sparkSession
    known = known_texts() if known is None else known
    digests, lengths = known_digests(spark, known)
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    forms = rows.select("doc_id", "row", canonical(F.col("text")).alias("whole"), F.transform(F.split("text", "\n"), canonical).alias("forms"))

    def find(batches):
        wanted, sizes = set(lengths), np.array(lengths, np.int64)
        for b in batches:
            out = []
            for whole, lines in zip(b.column("whole"), b.column("forms")):
                lines = lines.as_py()
                units = [(0, 0, whole.as_py()), *((k, 1, f) for k, f in enumerate(lines, 1))]
                units = [u for u in units if len(u[2]) in wanted] + matching_runs(lines, sizes)
                out.append([{"line": k, "lines": n, "digest": hashlib.sha256(f.encode()).hexdigest()} for k, n, f in units])
            kind = pa.list_(pa.struct([("line", pa.int32()), ("lines", pa.int32()), ("digest", pa.string())]))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "row": b.column("row"), "units": pa.array(out, kind)})

    kind = documents.schema["doc_id"].dataType.simpleString()
    units = forms.mapInArrow(find, f"doc_id {kind}, row bigint, units array<struct<line:int,lines:int,digest:string>>") \
        .select("doc_id", "row", F.inline_outer("units"))
    # rows without units get a key of their own, so that no key holds them all
    units = units.withColumn("digest", F.coalesce("digest", F.concat(F.lit("-"), "row")))
    hit = units.join(F.broadcast(digests) if len(known) <= BROADCAST_UP_TO else digests, "digest", "left")
    # the units of a row sit in one task, so the partial aggregate leaves one row per document to move
    found = hit.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.when(
        F.col("license_id").isNotNull(), F.struct("line", "license_id", "lines")))).alias("notices"))
    end = lambda x: x["line"] + x["lines"]
    held = lambda x, y: (y["line"] == 0) | ((y["line"] <= x["line"]) & (end(y) >= end(x)) & (y["lines"] > x["lines"]))
    return found.select("doc_id", F.filter("notices", lambda x: (x["lines"] < 2) | ~F.exists("notices", lambda y: held(x, y))).alias("notices"))


def license_query(spark, sf_dir: str) -> DataFrame:
    """op7: licences of every document; n_lines counts notices of one line."""
    from ledgerscope.sources.tables import read_table
    out = scan_licenses(read_table(spark, sf_dir, "documents"))
    ids = F.array_sort(F.array_distinct(F.transform("notices", lambda n: n["license_id"])))
    return out.select(
        "doc_id", F.size(F.filter("notices", lambda n: n["lines"] == 1)).cast("bigint").alias("n_lines"),
        F.exists("notices", lambda n: n["line"] == 0).alias("whole_text"), F.concat_ws(",", ids).alias("license_ids"))


def _sql_form(x: str) -> str:
    t = f"regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), '{COPYRIGHT_LINE}', '', 'g')"
    for spelling, common in SPELLINGS:
        t = f"replace({t}, '{spelling}', '{common}')"
    t = f"regexp_replace(regexp_replace({t}, '{VERSION}', 'version \\1', 'g'), '{ZERO_MINOR}', '\\1', 'g')"
    return f"trim(regexp_replace({t}, '{PUNCTUATION}', ' ', 'g'))"


LICENSE_SQL = f"""
WITH known AS (
  SELECT form, min(id) AS id FROM (SELECT id, {_sql_form('txt')} AS form FROM (VALUES {
    ', '.join("('%s', '%s')" % (i, t.replace("'", "''")) for i, t in KNOWN)}) v(id, txt)) WHERE form <> '' GROUP BY form),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
u AS (
  SELECT rid, 0 AS line, text AS unit FROM d
  UNION ALL SELECT rid, 1 AS line, unnest(string_split(text, chr(10))) AS unit FROM d),
m AS (SELECT u.rid, u.line, known.id FROM (SELECT rid, line, {_sql_form('unit')} AS form FROM u) u JOIN known USING (form)),
g AS (
  SELECT rid, count(*) FILTER (line = 1) AS n_lines, bool_or(line = 0) AS whole_text,
         string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM m GROUP BY rid)
SELECT d.doc_id, CAST(coalesce(g.n_lines, 0) AS BIGINT) AS n_lines, coalesce(g.whole_text, false) AS whole_text,
       coalesce(g.ids, '') AS license_ids
FROM d LEFT JOIN g USING (rid)
"""
