"""License scans in SQL functions alone: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Templates are licence texts, the headers that files carry, short notices and SPDX lines, several forms a licence. Units are
compared with them: the whole file, and as headers its paragraphs, its lines and the sentences of its paragraphs, wherever they
have a word that licence wording has. Document frequencies of all words come from all files, and all words of a unit weigh by
them. A file whose whole text is like a template, or one with a licence file's name and a header like one, is a licence file and
holds for its directory. A file has, in this order: its own licence (as a licence file or by its best header), or that of the
nearest directory above it that has a licence file, or none. Only the files with such words have their words shuffled;
directories are resolved among themselves, and files look theirs up.

Defined cases: a null or empty text has no licence of its own but inherits; a null path inherits nothing; of equal scores (to
nine places) the smaller licence name counts; of several licence files in a directory the best score, then the smaller name;
repeated rows are scanned each; an empty table gives an empty result. Other columns are kept; the operator's own three come last
and are named ``license_1`` and so on where the files have such columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import discard, free_name, lookup, materialize, table

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
_GNU_END = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this program. If not, see https://www.gnu.org/licenses/."
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_APACHE_END = ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'

# Short forms of common licence notices, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License.",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, version 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
}
# Public licence texts, headers and other usual notices, by SPDX identifier.
TEXTS: dict[str, list[str]] = {
    "Apache-2.0": [_APACHE, _APACHE + _APACHE_END, "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Apache License 2.0"],
    "MIT": [f"MIT License Copyright (c) {_MIT_GRANT} {_MIT_NOTICE} {_AS_IS}", _MIT_GRANT, f"{_MIT_GRANT} {_MIT_NOTICE}", "The MIT License (MIT)", "Licensed under the MIT license."],
    "BSD-2-Clause": [f"{_BSD_HEAD} {_BSD_TWO} {_BSD_END}", f"{_BSD_HEAD} {_BSD_TWO}", "BSD 2-Clause License", "Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": [
        f"{_BSD_HEAD} {_BSD_TWO} {_BSD_THREE} {_BSD_END}", f"{_BSD_HEAD} {_BSD_TWO} {_BSD_THREE}", "BSD 3-Clause License",
        "Licensed under the BSD 3-Clause License.",
    ],
    "ISC": [f"ISC License {_ISC_GRANT} {_ISC_END}", _ISC_GRANT, "The ISC License", "Licensed under the ISC License."],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "Licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "Licensed under the GNU Lesser General Public License, version 2.1."],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "Eclipse Public License - v 2.0",
    ],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)", "Boost Software License - Version 1.0 - August 17th, 2003"],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
        "zlib License",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Creative Commons Attribution-ShareAlike 4.0 International Public License"],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "CC0 1.0 Universal"],
}
for _id, _name, _version in (("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3")):
    TEXTS[_id] += [x.format(name=_name, version=_version) for x in (_GNU, _GNU + _GNU_END)]
for _id, _forms in TEXTS.items():
    _forms += [TEMPLATES[_id]] if _id in TEMPLATES else []
    _forms += [f"SPDX-License-Identifier: {x}" for x in ([_id, f"{_id}-only", f"{_id}-or-later"] if "GPL" in _id else [_id])]
#: Words of licence wording: every template has one of them, and units without any are not compared.
LICENSE_WORDS = "(?i)licen[sc]e|copyright|spdx|redistribut|public domain|creative commons|cc0|permission (is|to)|rights to this work"
FILE_NAMES = "(?i)(^|/)(licen[sc]e|copying|unlicense)[^/]*$"
SPLIT = "[^a-z0-9]+"
BLANK_LINE = r"\n[^A-Za-z0-9\n]*\n"
SENTENCE_END = r"([.;!?])\s+"
LEAST = 0.6


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPLIT), lambda w: w != "")


def frequencies(files: DataFrame) -> tuple[int, DataFrame]:
    """How many files there are, and word, n (files that have it) and idf of every word."""
    n = files.count()
    counted = files.select(F.explode(F.array_distinct(_tokens(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return n, materialize(counted.withColumn("idf", F.log((1 + n) / (1.0 + F.col("n"))) + 1), "words")


def _weights(spark: SparkSession, templates: dict[str, list[str]], n: int, words: DataFrame) -> DataFrame:
    """word, forms: the licence, form number and share of the template's norm of every template that has the word."""
    rows = [(name, i, form) for name, forms in sorted(templates.items()) for i, form in enumerate(forms)]
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    forms = spark.sql("select * from values " + ", ".join(f"({quoted(a)}, {b}, {quoted(c)})" for a, b, c in rows) + " as t(license, form, body)")
    own = forms.select("license", "form", F.explode(_tokens(F.col("body"))).alias("word")).groupBy("license", "form", "word").agg(F.count("*").alias("tf"))
    known = materialize(words.join(F.broadcast(own.select("word").distinct()), "word").select("word", "idf"), "known")  # no more words than the templates have
    weighed = own.join(F.broadcast(known), "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.log(F.lit(1.0 + n)) + 1))
    norms = weighed.groupBy("license", "form").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    shares = weighed.join(F.broadcast(norms), ["license", "form"]).withColumn("share", F.col("w") / F.col("norm"))
    return materialize(shares.groupBy("word").agg(F.collect_list(F.struct("license", "form", "share")).alias("forms")), "weights")


def _units(files: DataFrame) -> DataFrame:
    """id, kind (file or header), k, body of every unit to compare."""
    paragraphs = F.split(F.regexp_replace("text", "\r", ""), BLANK_LINE)
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(F.regexp_replace(F.regexp_replace(p, "\n", " "), SENTENCE_END, "$1\n"), "\n")))
    headers = F.array_distinct(F.filter(F.concat(F.split("text", "\n"), paragraphs, sentences), lambda x: x.rlike(LICENSE_WORDS)))
    both = F.concat(F.array(F.struct(F.lit("file").alias("kind"), F.col("text").alias("body"))), F.transform(headers, lambda x: F.struct(F.lit("header").alias("kind"), x.alias("body"))))
    return files.select("id", F.posexplode(both).alias("k", "u")).select("id", "u.kind", "k", "u.body")


def scan(files: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """``files``: path, text and others. Returns the others and path with license, origin (file, header, inherited) and score."""
    spark, others = files.sparkSession, [c for c in files.columns if c not in ("text", "path")]
    base = files.select(F.struct(*[F.col(f"`{c}`") for c in [*others, "path"]]).alias("rest"), "path", "text")
    n, words = frequencies(base.select("text"))
    named = F.when(F.col("text").rlike(LICENSE_WORDS), F.col("text"))
    rows = materialize(base.select("rest", "path", named.alias("text"), F.monotonically_increasing_id().alias("id")), "rows")
    unit = ["id", "kind", "k"]
    tokens = _units(rows.where("text is not null")).select(*unit, F.explode(_tokens(F.col("body"))).alias("word")).groupBy(*unit, "word").agg(F.count("*").alias("tf"))
    weighed = lookup(tokens, words, "word", F.xxhash64(*unit), "n").withColumn("w", F.col("tf") * F.col("idf"))
    weighed = weighed.join(F.broadcast(_weights(spark, templates or TEXTS, n, words)), "word", "left")
    # One sum a unit and template form, and that of the squares for its norm.
    parts = F.concat(
        F.array(F.struct(F.lit(None).cast("string").alias("license"), F.lit(-1).alias("form"), (F.col("w") * F.col("w")).alias("v"))),
        F.coalesce(F.transform("forms", lambda x: F.struct(x.license.alias("license"), x.form.alias("form"), (F.col("w") * x.share).alias("v"))), F.array()),
    )
    sums = weighed.select(*unit, F.explode(parts).alias("p")).groupBy(*unit, "p.license", "p.form").agg(F.sum("p.v").alias("v"))
    best = sums.groupBy(*unit).agg(F.max(F.when(F.col("form") < 0, F.col("v"))).alias("square"), F.max(F.when(F.col("form") >= 0, F.col("v"))).alias("most"), F.collect_list(F.when(F.col("form") >= 0, F.struct("license", "v"))).alias("all"))
    score = lambda v: F.round(v / F.sqrt("square"), 9)
    leading = F.array_min(F.transform(F.filter("all", lambda x: score(x.v) == score(F.col("most"))), lambda x: x.license))
    scored = best.where("most is not null").select("id", "kind", F.struct((-score(F.col("most"))).alias("s"), leading.alias("license")).alias("b"))
    by_file = scored.groupBy("id").agg(F.min(F.when(F.col("kind") == "file", F.col("b"))).alias("whole"), F.min(F.when(F.col("kind") == "header", F.col("b"))).alias("header"))
    found = rows.where("text is not null").select("rest", "path", "id").join(by_file, "id", "left").drop("id")
    empty = F.lit(None).cast("struct<s:double,license:string>")
    every = found.unionByName(rows.where("text is null").select("rest", "path", empty.alias("whole"), empty.alias("header")))
    is_whole, is_header = F.col("whole.s") <= -least, F.col("header.s") <= -least
    is_named = ~is_whole & F.col("path").rlike(FILE_NAMES) & is_header
    own = F.when(is_whole, F.col("whole")).when(is_header, F.col("header"))
    directory = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit(""))
    origin = F.when(is_whole | is_named, "file").when(is_header, "header")
    placed = materialize(every.select("rest", directory.alias("dir"), F.xxhash64("path").alias("spread"), own.alias("own"), origin.alias("origin")), "licenses")
    discard(rows)
    holders = placed.where("origin = 'file' and dir is not null").groupBy(F.col("dir").alias("at")).agg(F.min("own").alias("held"))
    # Each directory with its ancestors, itself included; joined by path, the longest that has a licence file counts.
    directories = placed.where("dir is not null").groupBy("dir").agg(F.count("*").alias("files"))
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    nearest = directories.select("dir", F.explode(F.array_distinct(above)).alias("at")).join(holders, "at").groupBy("dir").agg(F.max_by("held", F.length("at")).alias("held"))
    inherited = materialize(directories.join(nearest, "dir"), "inherited")
    out = lookup(placed, inherited, "dir", F.col("spread"), "files")
    got = F.coalesce("own", "held")
    license_, origin_, score_ = (free_name(files, c) for c in ("license", "origin", "score"))
    return out.select(
        *[F.col(f"rest.`{c}`").alias(c) for c in [*others, "path"]], got.getField("license").alias(license_),
        F.when(F.col("own").isNull() & F.col("held").isNotNull(), "inherited").otherwise(F.col("origin")).alias(origin_), F.round(-got.getField("s"), 6).alias(score_),
    )


PATH = "concat(coalesce(source, '_'), '/', coalesce(lang, '_'), '/', cast(floor(doc_id / 100) as bigint), '/', cast(doc_id as {text}))"


def of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source, language and hundreds of ids as directories."""
    documents = table(spark, sf_dir, "documents")
    return scan(documents.select("doc_id", F.expr(PATH.format(text="string")).alias("path"), "text"))


def oracle_sql() -> str:
    """The same scan over documents in DuckDB, comparing every file, whether it has licence words or not."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(name)}, {i}, {quoted(form)})" for name, forms in sorted(TEXTS.items()) for i, form in enumerate(forms))
    words = f"list_filter(string_split_regex(lower({{}}), '{SPLIT}'), lambda w: w <> '')"
    return f"""
with templates(license, form, body) as (values {values}),
files as (select doc_id, {PATH.format(text="varchar")} as path, text, row_number() over () as r from documents),
total as (select count(*) as n from files),
present as (select distinct r, unnest({words.format("coalesce(text, '')")}) as word from files),
idf as (select word, ln((1 + (select n from total)) / (1.0 + count(*))) + 1 as idf from present group by word),
template_words as (select license, form, word, count(*) as tf from (select license, form, unnest({words.format("body")}) as word from templates) group by all),
weights as (select license, form, t.word, tf * coalesce(i.idf, ln(1.0 + (select n from total)) + 1) as w from template_words t left join idf i using (word)),
norms as (select license, form, sqrt(sum(w * w)) as norm from weights group by all),
paragraphs as (select r, unnest(string_split_regex(replace(text, chr(13), ''), '{BLANK_LINE}')) as body from files),
sentences as (select r, unnest(string_split(regexp_replace(replace(body, chr(10), ' '), '{SENTENCE_END}', '\\1' || chr(10), 'g'), chr(10))) as body from paragraphs),
lines as (select r, unnest(string_split(text, chr(10))) as body from files),
headers as (select distinct r, body from (from paragraphs union all from sentences union all from lines) where regexp_matches(body, '{LICENSE_WORDS}')),
units as (select r, 'file' as kind, 0 as k, text as body from files where regexp_matches(text, '{LICENSE_WORDS}') union all select r, 'header', row_number() over (), body from headers),
tokens as (select r, kind, k, word, count(*) as tf from (select r, kind, k, unnest({words.format("body")}) as word from units) group by all),
unit_norms as (select r, kind, k, sqrt(sum((tf * idf) ** 2)) as norm from tokens join idf using (word) group by all),
dots as (select t.r, t.kind, t.k, w.license, w.form, sum(t.tf * i.idf * w.w / n.norm) as dot
         from tokens t join idf i using (word) join weights w using (word) join norms n on n.license = w.license and n.form = w.form group by all),
scores as (select r, kind, license, round(dot / norm, 9) as score from dots join unit_norms using (r, kind, k)),
best as (select r, kind, arg_min(license, (-score, license)) as license, max(score) as score from scores group by r, kind),
own as (select r, arg_min((license, kind, score), case kind when 'file' then 0 else 1 end) as b from best where score >= {LEAST} group by r),
placed as (select f.doc_id, f.path, f.r, regexp_replace(f.path, '/[^/]*$', '') as dir, o.b[1] as license,
                  case when o.b[2] = 'header' and regexp_matches(f.path, '{FILE_NAMES}') then 'file' else o.b[2] end as origin, o.b[3] as score from files f left join own o using (r)),
holders as (select dir, arg_min(license, (-score, license)) as license, max(score) as score from placed where origin = 'file' group by dir),
held as (select p.r, arg_max((h.license, h.score), length(h.dir)) as h from placed p join holders h on p.dir = h.dir or starts_with(p.dir, h.dir || '/') group by p.r)
select p.doc_id, p.path, coalesce(p.license, h.h[1]) as license, case when p.license is not null then p.origin when h.h is not null then 'inherited' end as origin,
       round(coalesce(p.score, h.h[2]), 6) as score
from placed p left join held h using (r)"""
