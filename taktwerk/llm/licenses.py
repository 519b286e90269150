"""Licence scans by canonical digests, as DataFrame operations only.

A text is brought to a canonical form (lower case, copyright lines dropped, punctuation and white space made one
space, equivalent spellings made one) and its SHA-256 is joined to the digests of known licences in the same form.
Scanned are entire documents, however their lines are broken, and, for notices, entire lines: a text is read and
normalised once, and its lines are cut from that. A copyright line begins with a statement (the word or sign with a
year, a sign or a name in brackets, or "all rights reserved" alone), so that a sentence of a licence whose line happens
to begin with "copyright notice" stays. The known licences are a table; the one built in has a fixed number of texts
(the files in ``known_licenses``, short ones and notices below), so its digests are broadcast; a longer table is joined
by shuffle.

Defined results: a null text matches nothing; an empty text, or one that is empty in canonical form, matches nothing
even if a known text is; repeated rows match each; a null doc_id is kept; known texts with one canonical form give a
row each; an empty table gives an empty table; other columns are not read. Whole texts are normalised.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of known licences of up to so many rows is broadcast.
BROADCAST_ROWS = 1000

# fixed values: how a copyright line begins in lower case, and spellings taken as one
COPYRIGHT = r"^[^\p{L}\p{N}\n]*(copyright[^\n]*[0-9]{4}|copyright[ \t]*(\(c\)|©|&copy;|by |\[|<|\{)|\(c\)[ \t]*(copyright|[0-9])|©|all rights reserved[^\p{L}\p{N}\n]*$)[^\n]*"
SPELLINGS = (("licence", "license"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("authorisation", "authorization"), ("favour", "favor"), ("fulfil ", "fulfill "), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("per cent", "percent"), ("sub license", "sublicense"), ("whilst", "while"), ("wilful", "willful"), (" https ", " http "))

# fixed values: short texts and notices of licences
SHORT = (
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)

# fixed values: title lines under which texts without one of their own stand in repositories
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero Clause BSD License", "0BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng license"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}


def _known() -> tuple[tuple[str, str], ...]:
    """Short texts and notices, the full texts in ``known_licenses`` (a file each, named by its id), and both under their titles."""
    files = sorted((f for f in resources.files(__package__).joinpath("known_licenses").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    full = [(f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in files]
    bodies = [*SHORT[:3], *full]
    return (*SHORT, *full, *((i, f"{title}\n\n{text}") for i, text in bodies for title in TITLES.get(i, ())))


KNOWN = _known()


def _spelled(text: Column) -> Column:
    for other, one in SPELLINGS:
        text = F.replace(text, F.lit(other), F.lit(one))
    return text


def normalised(text: Column) -> Column:
    """Lower case without copyright lines; letters, digits and single spaces between the line breaks, which stay."""
    out = F.regexp_replace(F.lower(text), "(?dm)" + COPYRIGHT, "")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")
    return _spelled(F.concat(F.lit(" "), F.replace(out, F.lit("\n"), F.lit(" \n ")), F.lit(" ")))


def one_line(normal: Column) -> Column:
    """The canonical form of what ``normalised`` gives, its lines joined; spellings may meet across a line break."""
    return F.trim(F.regexp_replace(_spelled(F.regexp_replace(normal, "[ \n]+", " ")), " +", " "))


def canonical(text: Column) -> Column:
    return one_line(normalised(text))


def known_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN), "license_id string, text string")


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, line, license_id) for each match: line 0 is the entire document, others count from 1."""
    if known is None:
        known = known_table(docs.sparkSession)
    digests = known.select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest")).distinct()
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        digests = F.broadcast(digests)
    normal = docs.select("doc_id", normalised(F.col("text")).alias("normal"))
    line = F.transform(F.split("normal", "\n"), lambda x, i: F.struct((i + 1).alias("line"), F.trim(F.regexp_replace(x, " +", " ")).alias("form")))
    forms = normal.select("doc_id", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("line"), one_line(F.col("normal")).alias("form"))), line)).alias("u"))
    forms = forms.where("u.form <> ''").select("doc_id", "u.line", F.sha2("u.form", 256).alias("digest"))
    return forms.join(digests, "digest").select("doc_id", "line", "license_id")
