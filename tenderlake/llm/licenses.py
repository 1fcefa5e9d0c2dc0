"""Licence scanning: Dice coefficient over word bigrams against licence templates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, table

#: The least Dice coefficient, as a fraction, so that comparisons are exact.
MIN_DICE = (4, 5)

#: Wording of public licence notices, by SPDX-like id. Notices of one family (CC, GNU)
#: can reach MIN_DICE against each other and are then all listed; the nearest has the highest Dice.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Released under the Apache License, Version 2.0.",
        "Licensed under the Apache License 2.0.",
        "Licensed under Apache-2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Licensed under MIT.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL v3.",
        "Licensed under GPL-3.0.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Licensed under the BSD License.",
        "Released under the BSD License.",
        "Licensed under the BSD 2-Clause License.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "Licensed under MPL-2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under Creative Commons Attribution 4.0.",
    ),
    "CC-BY-SA-4.0": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Licensed under CC0 1.0.",
        "This work is licensed under CC0 1.0.",
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    ),
    "GPL-2.0": (
        "Licensed under the GNU General Public License, version 2.",
        "Released under the GNU General Public License, version 2.",
        "Licensed under the GNU GPL v2.",
        "Licensed under GPL-2.0.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "Released under the GNU Lesser General Public License, version 3.",
        "Licensed under the GNU LGPL v3.",
        "Licensed under LGPL-3.0.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "LGPL-2.1": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the GNU LGPL v2.1.",
        "Licensed under LGPL-2.1.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "Released under the GNU Affero General Public License, version 3.",
        "Licensed under the GNU AGPL v3.",
        "Licensed under AGPL-3.0.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "Unlicense": (
        "Released under the Unlicense.",
        "Licensed under the Unlicense.",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ),
    "EPL-2.0": (
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ),
    "Zlib": (
        "Licensed under the zlib License.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ),
    "Proprietary": (
        "All rights reserved.",
    ),
}

_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _code, _name in _CC.items():
    for _version, _where in (("4.0", "International"), ("3.0", "Unported")):
        _long = f"This work is licensed under a Creative Commons {_name} {_version} {_where} License."
        _texts = (
            f"CC {_code} {_version}", f"Licensed under CC {_code} {_version}.", f"Released under CC {_code} {_version}.",
            f"This work is licensed under CC {_code} {_version}.", f"Licensed under Creative Commons {_name} {_version}.",
            f"Creative Commons {_name} {_version} {_where}", f"Licensed under a Creative Commons {_name} {_version} {_where} License.", _long,
            f"{_long} To view a copy of this license, visit http://creativecommons.org/licenses/{_code.lower()}/{_version}/",
            f"{_long} To view a copy of this license, visit http://creativecommons.org/licenses/{_code.lower()}/{_version}/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
        )
        _old = TEMPLATES.get(f"CC-{_code}-{_version}", ())
        TEMPLATES[f"CC-{_code}-{_version}"] = (*_old, *(t for t in _texts if t not in _old))


#: Common words, the last to be taken for anchors.
_COMMON = frozenset("a all and any are at be by for from in is it of on or that the this to under with you".split())
#: ASCII characters that are no letter or digit, but for the line feed.
_MARKS = r"[\x00-\x09\x0b-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


#: What ends a sentence or a paragraph, and the sign that takes its place before texts are normalised.
_ENDS, _END = r"[.!?]+[ \t\n]+|\n[ \t]*\n", "\u241e"


def normalised(c: Column) -> Column:
    """Lower case (A-Z), with every run of ASCII characters that are no letter or digit as one blank;
    line feeds stay."""
    return F.regexp_replace(ascii_lower(c), _MARKS, " ")


def _words(c: Column) -> Column:
    return F.split(F.btrim(c, F.lit(" \n")), "[ \n]+")


def _bigrams(words: Column) -> Column:
    n = F.size(words)
    return F.arrays_zip(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("b"))


def anchor_words(templates: dict[str, tuple[str, ...]], min_dice: tuple[int, int]) -> list[str]:
    """Words of which every matching segment holds one. A segment that reaches num / den shares at
    least num / (2 * den - num) of a template's bigrams; so it holds one of any larger rest of them,
    of which the longest words are taken, being rare, and common ones last."""
    num, den = min_dice
    out: set[str] = set()
    for text in (x for texts in templates.values() for x in texts):
        words = re.findall("[a-z0-9]+", text.lower())
        rarer = lambda w: (w in _COMMON, -len(w), w)
        longest = sorted((min(pair, key=rarer) for pair in zip(words, words[1:])), key=rarer)
        need = -(-num * len(longest) // (2 * den - num))
        out.update(longest[: len(longest) - need + 1])
    return sorted(out)


def template_table(spark: SparkSession, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """One row per (template, bigram): its count, and the template's number of bigrams. Its size is
    that of the templates given, a parameter, not of the data."""
    rows = [(name, i, text) for name, texts in templates.items() for i, text in enumerate(texts)]
    t = spark.createDataFrame(rows, "license string, variant int, text string")
    t = t.withColumn("words", _words(normalised(F.col("text")))).withColumn("t_size", F.size("words") - 1)
    t = t.select("license", "variant", "t_size", F.explode(_bigrams(F.col("words"))).alias("g"))
    return t.groupBy("license", "variant", "t_size", F.col("g.a").alias("a"), F.col("g.b").alias("b")).agg(F.count(F.lit(1)).alias("t_n"))


def match_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, min_dice: tuple[int, int] = MIN_DICE, text: str = "text") -> DataFrame:
    """One row per row of docs (doc_id, licenses: array of (license, dice, n_segments) by name).

    Compared with the templates are the lines of a text, the paragraphs between blank lines, the
    sentences (so a notice of one sentence is found within a longer paragraph) and the whole text. Dice is 2 * shared bigrams / (bigrams of both), counting repeats. A segment of n
    bigrams can reach the threshold d only for templates of n * d / (2 - d) to n * (2 - d) / d
    bigrams: longer and shorter segments than any template allows are dropped before a bigram is
    made, and a bigram meets only templates of fitting size. Texts without any of the words that a
    match must hold (anchor_words) aren't split at all. Null, empty and one-word texts match
    nothing; repeated rows are answered each; rows of an empty table: none.
    """
    spark = docs.sparkSession
    t = template_table(spark, templates)
    num, den = min_dice
    # Sizes t and s can reach num / den only if t * (2 * den - num) >= s * num, and the other way round.
    n_words = [len(re.findall("[A-Za-z0-9]+", w)) - 1 for texts in templates.values() for w in texts]
    least, most = max(1, -(-min(n_words) * num // (2 * den - num))), max(n_words) * (2 * den - num) // num
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.xxhash64("doc_id", body).alias("k1"), F.xxhash64(F.lit(3), "doc_id", body).alias("k2")
    none = F.array().cast("array<string>")
    initials: dict[str, list[str]] = {}
    for word in anchor_words(templates, min_dice):
        initials.setdefault(word[0], []).append(word[1:])
    anchored = "(?:^|[^a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in initials.items()) + ")"
    seg = docs.where(F.lower(text).rlike(anchored)).select(*key, normalised(body).alias("body"), normalised(F.regexp_replace(body, _ENDS, _END)).alias("ended"))
    seg = seg.withColumn("lines", F.split("body", "\n", -1)).withColumn("parts", F.split("body", r"\n *\n", -1)).withColumn("sentences", F.split("ended", _END, -1))
    several = F.when(F.size("sentences") > 1, F.col("sentences")).otherwise(none)
    segments = F.concat("lines", several, F.when(F.size("parts") > 1, F.col("parts")).otherwise(none), F.when(F.size("lines") > 1, F.array("body")).otherwise(none))
    seg = seg.select("k1", "k2", F.posexplode(F.transform(segments, _words)).alias("seg", "words"))
    seg = seg.select("k1", "k2", "seg", "words", (F.size("words") - 1).alias("size")).where(F.col("size").between(least, most))
    grams = seg.select("k1", "k2", "seg", "size", F.explode(_bigrams(F.col("words"))).alias("g")).select("k1", "k2", "seg", "size", "g.a", "g.b")
    fits = (grams["a"] == t["a"]) & (grams["b"] == t["b"]) & (t["t_size"] * (2 * den - num) >= grams["size"] * num) & (grams["size"] * (2 * den - num) >= t["t_size"] * num)
    met = grams.join(F.broadcast(t), fits).select("k1", "k2", "seg", "size", "license", "variant", "t_size", t["a"], t["b"], "t_n")
    met = met.groupBy("k1", "k2", "seg", "size", "license", "variant", "t_size", "a", "b", "t_n").agg(F.count(F.lit(1)).alias("n"))
    dice = met.groupBy("k1", "k2", "seg", "size", "license", "variant", "t_size").agg(F.sum(F.least("n", "t_n")).alias("shared"))
    dice = dice.where(2 * den * F.col("shared") >= num * (F.col("size") + F.col("t_size")))
    dice = dice.withColumn("dice", 2 * F.col("shared") / (F.col("size") + F.col("t_size")))
    per = dice.groupBy("k1", "k2", "license").agg(F.max("dice").alias("dice"), F.countDistinct("seg").alias("n_segments"))
    per = per.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("license", "dice", "n_segments"))).alias("licenses"))
    none = F.array().cast("array<struct<license:string,dice:double,n_segments:bigint>>")
    return docs.select("doc_id", *key).join(per, ["k1", "k2"], "left").select("doc_id", F.coalesce("licenses", none).alias("licenses"))


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    out = match_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.array_max(F.transform("licenses", lambda x: F.struct(x["dice"].alias("dice"), x["license"].alias("license"))))
    return out.select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.transform("licenses", lambda x: x["license"]), ",").alias("licenses"),
        F.coalesce(F.aggregate("licenses", F.lit(0).cast("long"), lambda a, x: a + x["n_segments"]), F.lit(0).cast("long")).alias("n_segments"),
        F.coalesce(best["dice"], F.lit(0.0)).alias("best_dice"), best["license"].alias("best_license"),
    )


_VALUES = ", ".join("(" + f"'{n}', {i}, '" + x.replace("'", "''") + "')" for n, xs in TEMPLATES.items() for i, x in enumerate(xs))
_NUM, _DEN = MIN_DICE
_NORMAL = f"regexp_replace(translate(%s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_MARKS}', ' ', 'g')"
_SPLIT = "string_split_regex(trim(%s, ' ' || chr(10)), '[ \\n]+')"

ORACLE = f"""
WITH t0(license, variant, text) AS (VALUES {_VALUES}),
t1 AS (SELECT license, variant, {_SPLIT % (_NORMAL % "text")} AS w FROM t0),
t AS (SELECT license, variant, len(w) - 1 AS t_size, w[i] AS a, w[i + 1] AS b, count(*) AS t_n
      FROM (SELECT *, unnest(generate_series(1, len(w) - 1)) AS i FROM t1) GROUP BY ALL),
d0 AS (SELECT doc_id, {_NORMAL % "coalesce(text, '')"} AS body, string_split({_NORMAL % f"regexp_replace(coalesce(text, ''), '{_ENDS}', '{_END}', 'g')"}, '{_END}') AS sentences FROM documents),
d AS (SELECT doc_id, body, sentences, string_split(body, chr(10)) AS lines, string_split_regex(body, '\\n *\\n') AS parts FROM d0),
s0 AS (SELECT doc_id, list_concat(lines, CASE WHEN len(sentences) > 1 THEN sentences ELSE [] END, CASE WHEN len(parts) > 1 THEN parts ELSE [] END, CASE WHEN len(lines) > 1 THEN [body] ELSE [] END) AS segs FROM d),
s1 AS (SELECT doc_id, unnest(generate_series(1, len(segs))) AS seg, unnest(segs) AS s FROM s0),
s2 AS (SELECT doc_id, seg, {_SPLIT % "s"} AS w FROM s1),
s3 AS (SELECT doc_id, seg, len(w) - 1 AS size, unnest(w[1:len(w) - 1]) AS a, unnest(w[2:]) AS b FROM s2 WHERE len(w) > 1),
met AS (SELECT doc_id, seg, size, license, variant, t_size, s3.a, s3.b, t_n, count(*) AS n FROM s3 JOIN t ON s3.a = t.a AND s3.b = t.b GROUP BY ALL),
dice AS (SELECT doc_id, seg, license, variant, size, t_size, sum(least(n, t_n)) AS shared FROM met GROUP BY doc_id, seg, license, variant, size, t_size),
per AS (SELECT doc_id, license, max((2 * shared)::DOUBLE / (size + t_size)) AS dice, count(DISTINCT seg) AS n_segments
        FROM dice WHERE {2 * _DEN} * shared >= {_NUM} * (size + t_size) GROUP BY doc_id, license),
agg AS (SELECT doc_id, count(*) AS n_licenses, string_agg(license, ',' ORDER BY license) AS licenses, sum(n_segments) AS n_segments,
        max(dice) AS best_dice, max_by(license, struct_pack(dice := dice, license := license)) AS best_license FROM per GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_licenses, 0)::BIGINT AS n_licenses, coalesce(licenses, '') AS licenses, coalesce(n_segments, 0)::BIGINT AS n_segments,
       coalesce(best_dice, 0.0)::DOUBLE AS best_dice, best_license
FROM d LEFT JOIN agg ON d.doc_id = agg.doc_id
"""
