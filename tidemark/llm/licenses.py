"""Licence scans by canonical digest: whole texts, and whole lines of texts, against known licence texts.

A canonical form drops what does not change a licence: case, copyright lines, punctuation and spacing,
and spellings that are held to be equal. Its SHA-256 is joined with the digests of the known texts.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FOLDER = Path(__file__).with_name("license_texts")
#: Headings that stand above a text or are left out.
_HEADINGS = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License"), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "The BSD 2-Clause License"), "Zlib": ("zlib License", "The zlib License"),
    "BSD-3-Clause": ("BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "The BSD 3-Clause License"),
}
#: Names and addresses that notices call a licence by.
_CALLED = {
    "MIT": ("MIT License",), "ISC": ("ISC License",), "0BSD": ("BSD Zero Clause License",), "BSD-2-Clause": ("BSD 2-Clause License",), "BSD-3-Clause": ("BSD 3-Clause License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"), "Unlicense": ("Unlicense",), "Zlib": ("zlib License",),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"), "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "MPL-1.1": ("Mozilla Public License, Version 1.1",), "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, Version 2.0"),
} | {f"{short}-{v}": tuple(f"{name}{how}" for how in (f", version {v[0] if v[-1] == '0' else v}", f" v{v}", f" version {v[0] if v[-1] == '0' else v}"))
     for short, name, versions in (("GPL", "GNU General Public License", ("1.0", "2.0", "3.0")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3.0")),
                                   ("AGPL", "GNU Affero General Public License", ("3.0",)), ("GFDL", "GNU Free Documentation License", ("1.2", "1.3"))) for v in versions
} | {f"CC-{kind}-{v}": (f"CC {kind} {v}", f"CC-{kind}-{v}", f"Creative Commons {said} {v} International License")
     for kind, said in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"),
                        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")) for v in ("4.0",)}
_SENTENCES = ("Licensed under {}", "Licensed under the {}", "Released under the {}", "Distributed under the {}", "Available under the {}", "This work is licensed under {}",
              "This work is licensed under the {}", "This work is licensed under a {}", "This project is licensed under the {}", "This software is licensed under the {}",
              "This software is released under the {}", "This program is licensed under the {}", "This file is licensed under the {}", "This code is licensed under the {}",
              "SPDX-License-Identifier: {}")
#: The usual headers, a paragraph a line; GNU ones are made for each licence below.
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http{}://mozilla.org/MPL/2.0/."""
_GNU = """{it} is free software{colon} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{version}.

{it} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.

You should have received a copy of the {name} along with {this}. If not, see <http{s}://www.gnu.org/licenses/>."""


def _unwrapped(text: str) -> str:
    """A paragraph a line; a copyright line that begins a paragraph stays a line."""
    out = []
    for part in re.split(r"\n[ \t\f]*\n", text):
        lines = [x.strip() for x in part.strip().split("\n")]
        while len(lines) > 1 and re.match(r"(?i)\W*(copyright\b|\(c\)|©)", lines[0]):
            out.append(lines.pop(0))
        out.append(" ".join(lines))
    return "\n".join(out)


def _known() -> list[tuple[str, str]]:
    """(licence, text) of full standard texts and of the usual notices; equal forms may come more than once."""
    out = []
    for path in sorted(_FOLDER.glob("*.txt")):
        full = path.read_text(encoding="utf-8")
        terms = re.match(r"(?s).*\n[ \t]*END OF TERMS AND CONDITIONS[ \t]*\n", full)
        bodies = [full, *([terms[0], terms[0].replace("END OF TERMS AND CONDITIONS", "")] if terms else [])]
        if path.stem.startswith("BSD"):
            bodies += ["All rights reserved.\n\n" + full] if not re.search("(?i)all rights reserved", full) else [re.sub("(?i)all rights reserved.", "", full)]
        bodies = [h + "\n\n" + x if h else x for x in bodies for h in ("", *_HEADINGS.get(path.stem, ()))]
        out += [(path.stem, form) for x in bodies for form in (x, _unwrapped(x))]
    out += [(name, s.format(c)) for name, called in _CALLED.items() for c in {*called, name} for s in _SENTENCES]
    out += [("Apache-2.0", x) for x in (_APACHE, _APACHE.replace("http:", "https:"))] + [("MPL-2.0", _MPL.format(s)) for s in ("", "s")]
    for short, name, versions in (("GPL", "GNU General Public License", ("2.0", "3.0")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3.0")),
                                  ("AGPL", "GNU Affero General Public License", ("3.0",))):
        for v in versions:
            said = v[0] if v[-1] == "0" else v
            for how in (f", either version {said} of the License, or (at your option) any later version", f"; either version {said} of the License, or (at your option) any later version",
                        f", version {said} of the License", f"; version {said} of the License"):
                tail = "-or-later" if "later" in how else "-only"
                for it, this in (("This program", "this program"), ("This library", "this library"), ("This software", "this software")):
                    out += [(f"{short}-{v}{tail}", _GNU.format(it=it, this=this, name=name, version=how, colon=colon, s=s)) for colon in (":", ";") for s in ("", "s")]
            for tail in ("-only", "-or-later"):
                out.append((f"{short}-{v}{tail}", f"SPDX-License-Identifier: {short}-{v}{tail}"))
    # an apostrophe is a blank in the canonical form; so the texts can stand in SQL as they are
    return [(name, text.replace("'", " ")) for name, text in dict.fromkeys(out)]


#: Known texts and notices: licence and text. A user passes a table of more in its place.
NOTICES = _known()
#: Spellings held to be equal, as in the public matching guidelines for licence lists.
SPELLINGS = [
    ("acknowledgment", "acknowledgement"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("categorise", "categorize"),
    ("centre", "center"), ("copyright holder", "copyright owner"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"),
    ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("labour", "labor"), ("licence", "license"), ("licenced", "licensed"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"),
    ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("sub license", "sublicense"),
    ("sub licence", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("noncommercial", "non commercial"),
]
#: The known table is broadcast up to so many rows of 64-digit digests.
BROADCAST_ROWS = 100_000


def _with(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`df` with a column behind a one-row generator: the optimizer neither copies nor pushes its expression,
    so what later columns and filters refer to is computed once a row."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_digest(df: DataFrame, text: str) -> DataFrame:
    """`df` with column `digest`, of the canonical form of its column `text`; null if nothing is left."""
    kept = df.columns
    df = _with(df, "low", F.lower(text))
    marked = F.col("low").contains("copyright") | F.col("low").contains("(c)") | F.col("low").contains("©")
    bare = F.when(marked, F.regexp_replace("low", r"(?m)^\W*(copyright\b|\(c\)|©).*$", " ")).otherwise(F.col("low"))
    df = _with(df, "words", F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " ")))
    same = F.col("words")
    for said, for_it in SPELLINGS:
        same = F.regexp_replace(same, rf"\b{said}\b", for_it)
    spelled = F.col("words").rlike(r"\b(" + "|".join(s for s, _ in SPELLINGS) + r")\b")
    df = _with(df, "form", F.when(spelled, same).otherwise(F.col("words")))
    return _with(df, "digest", F.when(F.col("form") != "", F.sha2("form", 256))).select(*kept, "digest")


def known_notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NOTICES, "license string, text string")


def license_scan(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, whole_license (known text that the whole text equals, least name of several), n_lines (lines
    equal to a known text), licenses (names found in lines, sorted, comma-joined) for each row of `docs`.

    Null and empty texts, and lines of punctuation, match nothing; known texts without text or name are
    ignored; repeated rows and rows without id each give a row; other columns are ignored.
    """
    table = with_digest(known.select("license", "text"), "text").where("digest is not null and license is not null")
    table = table.groupBy("digest").agg(F.min("license").alias("license"))
    if table.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    # lines of one text are counted before anything is shuffled: a map-side partial aggregate by row
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("mark", F.struct(F.xxhash64("text"), F.length("text")))
    lines = rows.select("id", "mark", F.explode(F.split("text", r"\r\n|\n|\r")).alias("line"))
    found = with_digest(lines, "line").join(table, "digest")
    # equal rows share id and mark: their lines are counted once for each distinct row
    copies = rows.groupBy("id", "mark").agg(F.count("*").alias("copies"))
    by_row = found.groupBy(F.col("id").alias("its_id"), F.col("mark").alias("its_mark")).agg(
        F.count("*").alias("lines"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"))
    same = F.col("id").eqNullSafe(F.col("its_id")) & (F.col("mark") == F.col("its_mark"))
    by_row = copies.join(by_row, same).select("its_id", "its_mark", (F.col("lines") / F.col("copies")).cast("long").alias("n_lines"), "licenses")
    whole = with_digest(rows, "text").select("id", "mark", "digest").join(table.withColumnRenamed("license", "whole_license"), "digest", "left")
    return whole.join(by_row, same, "left").select(
        F.col("id").alias(key), "whole_license", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce("licenses", F.lit("")).alias("licenses"))
