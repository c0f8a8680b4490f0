"""Licence scan by Dice coefficient over word bigrams (operator 6).

Every line of a text, and the text as a whole, is normalised (A-Z lower-cased, all but letters and
digits folded to one space) and compared with licence notices: Dice = 2 * common / (m + n) for m and
n word bigrams, repeats counted as often as both sides have them.  A unit can only reach the
threshold t with a template of n bigrams if ``n * t / (2 - t) <= m <= n * (2 - t) / t``;
templates outside are pruned, as are those that share no bigram.

Notices that are wrapped over lines or stand inside a longer one are found by windows over the whole text's
bigrams, compared with ``NOTICES`` too.  A match has ``n * t / (2 - t)`` bigrams of its template at least, so it has one
of the rarest ``n`` less that number plus one: texts without any of these are done.  In the others the best
window from every place of a template's bigram is taken; it ends at such a place too, since bigrams of neither side
only lower Dice.  A bigram counts in a window if the template has it more often than the window has it
before.  Windows that share words are one place, which counts unless it touches a matching line or the
whole text matches.  All of it is one row-local expression: a scan without a shuffle.

Cases: a null or empty text has no units and no licence; units of one word have no bigrams; ties go
to the first template by name; repeated rows are scanned each; an empty table gives no rows.
Columns beyond the id and the text are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import ascii_lower

# Public licence notices.
TEMPLATES = [
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
_GPL = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by the Free Software Foundation, either version {3} of the License, or (at your option) any later version."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_REST = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_REST = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
# Unaltered notices and short full texts, for windows; the full texts of Apache, MPL, GPL and AGPL hold their notice.
NOTICES = [
    ("AGPL-3.0", _GPL.format("program", ":", "Affero ", "3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", f"{_BSD} {_BSD_REST}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_3}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_3} {_BSD_REST}"),
    ("GPL-2.0", _GPL.format("program", ";", "", "2")),
    ("GPL-3.0", _GPL.format("program", ":", "", "3")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", _GPL.format("library", ";", "Lesser ", "2.1")),
    ("LGPL-3.0", _GPL.format("library", ":", "Lesser ", "3")),
    ("MIT", _MIT),
    ("MIT", f"{_MIT} {_MIT_REST}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]
# Only the order in which bigrams are taken for rare.
_COMMON = frozenset("a an and any are at be by for from if in is it its not of on or that the this to use with you".split())
THRESHOLD = 0.8
SPLIT = r"[^\p{L}\p{N}]+"


def template_bigrams(text: str) -> list[str]:
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def _bounds(n: int, threshold: float) -> tuple[int, int]:
    low = threshold / (2 - threshold)
    return math.ceil(n * low - 1e-9), math.floor(n / low + 1e-9)


def _template_table(templates: list[tuple[str, str]], threshold: float) -> Column:
    rows = []
    for name, text in templates:
        grams = template_bigrams(text)
        lo, hi = _bounds(len(grams), threshold)
        counted = sorted(Counter(grams).items())
        rows.append(F.struct(
            F.lit(name).alias("name"), F.lit(len(grams)).alias("n"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"),
            F.array(*[F.lit(g) for g, _ in counted]).alias("grams"),
            F.array(*[F.struct(F.lit(g).alias("g"), F.lit(c).alias("c")) for g, c in counted]).alias("counted")))
    return F.array(*rows)


def _bigrams(words: Column) -> Column:
    """Word bigrams of a unit of two words or more."""
    return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1),
                      lambda a, b: F.concat(a, F.lit(" "), b))


def anchors(grams: list[str], lo: int) -> set[str]:
    """Rare bigrams of a template of which every match of ``lo`` or more of its bigrams has one."""
    counted = Counter(grams)
    out, left = set(), len(grams) - lo + 1
    for g in sorted(counted, key=lambda g: (sum(w in _COMMON for w in g.split()), -len(g), g)):
        if left > 0:
            out.add(g)
            left -= counted[g]
    return out


def _marked(hits: Column, counted: Counter, hi: int) -> Column:
    """The hits (place ``p``, bigram ``g``) with ``q``: they count in windows that start after place ``q``."""
    def times(g: Column) -> Column:
        out = F.lit(1)
        for c in sorted(set(counted.values()) - {1}):
            out = F.when(g.isin([x for x in counted if counted[x] == c]), c).otherwise(out)
        return out

    def mark(x: Column, j: Column) -> Column:
        before = F.filter(F.slice(hits, F.greatest(j - hi + 1, F.lit(1)), F.least(j, F.lit(hi))), lambda y: y["g"] == x["g"])
        q = F.get(before, F.size(before) - times(x["g"]))["p"]
        return F.struct(x["p"].alias("p"), F.coalesce(q, F.lit(-1)).alias("q"))

    return F.transform(hits, mark)


def _windows(marked: Column, name: str, n: int, lo: int, hi: int, threshold: float) -> Column:
    """The best window from each place: struct (start, -dice, name, end), as far as it reaches the threshold."""
    def best(k: Column, i: Column) -> Column:
        s = k["p"]
        inside = F.filter(F.slice(marked, i + 1, F.lit(hi)), lambda y: (y["p"] < s + hi) & (y["q"] < s))
        ends = F.transform(inside, lambda y, j: F.struct((-2.0 * (j + 1) / (y["p"] - s + 1 + n)).alias("d"), y["p"].alias("e")))
        return F.get(F.transform(F.array(F.array_min(ends)), lambda x: F.struct(
            s.alias("s"), x["d"].alias("d"), F.lit(name).alias("name"), x["e"].alias("e"))), F.lit(0))

    # lo places of the template within hi: else no window from here.
    found = F.transform(marked, lambda k, i: F.when(F.get(marked, i + lo - 1)["p"] < k["p"] + hi, best(k, i)))
    return F.filter(found, lambda x: x["d"] <= -threshold + 1e-12)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES,
         threshold: float = THRESHOLD, notices=NOTICES) -> DataFrame:
    """A row per document: the best ``license`` and its ``dice`` (null if none), and ``n_units`` that match.

    Lines and whole texts are compared with ``templates``, windows with ``templates`` and ``notices``.
    """
    sizes = [_bounds(len(template_bigrams(t)), threshold) for _, t in templates]
    low, high = min(a for a, _ in sizes), max(b for _, b in sizes)
    line_words = F.transform(F.split(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), "\n"),
                             lambda x: F.filter(F.split(x, SPLIT), lambda w: w != ""))
    fits = lambda n: (n - 1 >= low) & (n - 1 <= high)
    several = F.size(F.filter("lines", lambda w: F.size(w) > 0)) > 1
    table = _template_table(templates, threshold)

    def dice(unit: Column, t: Column) -> Column:
        common = F.aggregate(t["counted"], F.lit(0), lambda acc, g: acc + F.least(
            g["c"], F.size(F.filter(unit, lambda x: x == g["g"]))))
        return 2.0 * common / (F.size(unit) + t["n"])

    def best(unit: Column) -> Column:
        near = F.filter(table, lambda t: (F.size(unit) >= t["lo"]) & (F.size(unit) <= t["hi"]) & F.arrays_overlap(unit, t["grams"]))
        scored = F.transform(near, lambda t: F.struct((-dice(unit, t)).alias("d"), t["name"].alias("name")))
        return F.get(F.filter(F.array(F.array_min(scored)), lambda s: s["d"] <= -threshold + 1e-12), F.lit(0))

    kinds = []
    for name, text in [*templates, *notices]:
        grams = template_bigrams(text)
        kinds.append((name, Counter(grams), len(grams), *_bounds(len(grams), threshold)))
    rare = sorted(set().union(*(anchors(list(c.elements()), lo) for _, c, _, lo, _ in kinds)))
    every = sorted(set().union(*(c for _, c, *_ in kinds)))
    none = F.array().cast("array<struct<p:int,g:string>>")
    found = F.when(F.exists("grams", lambda g: g.isin(rare)), F.filter(
        F.transform("grams", lambda g, i: F.struct(i.alias("p"), g.alias("g"))), lambda x: x["g"].isin(every))).otherwise(none)
    of = lambda c: F.filter("found", lambda x: x["g"].isin(sorted(c)))
    own = [of(c).alias(f"h{k}") for k, (_, c, *_) in enumerate(kinds)]
    marked = [F.when(F.size(f"h{k}") >= lo, _marked(F.col(f"h{k}"), c, hi)).otherwise(F.array().cast("array<struct<p:int,q:int>>")).alias(f"h{k}")
              for k, (_, c, _, lo, hi) in enumerate(kinds)]
    windows = F.concat(*[_windows(F.col(f"h{k}"), name, n, lo, hi, threshold) for k, (name, _, n, lo, hi) in enumerate(kinds)])

    # Places: of windows that share words the best one, the first if several are; lines that match go before.
    line_of = F.flatten(F.transform("lines", lambda w, i: F.transform(w, lambda _: i)))
    free = F.filter("windows", lambda x: ~F.exists(
        F.slice("line_hits", F.get("line_of", x["s"]) + 1, F.get("line_of", x["e"] + 1) - F.get("line_of", x["s"]) + 1), lambda h: h.isNotNull()))
    places = F.aggregate(F.when(F.col("all_hit").isNull(), free).otherwise(F.array().cast("array<struct<s:int,d:double,name:string,e:int>>")),
                         F.struct(F.lit(0).alias("n"), F.lit(-2).alias("e"), F.lit(0.0).alias("d")), lambda a, x: F.when(
        x["s"] > a["e"] + 1, F.struct((a["n"] + 1).alias("n"), x["e"].alias("e"), x["d"].alias("d"))).when(
        x["d"] < a["d"], F.struct(a["n"].alias("n"), x["e"].alias("e"), x["d"].alias("d"))).otherwise(a), lambda a: a["n"])
    return (docs.select(F.col(id_col).alias("id"), line_words.alias("lines"))
            .select("*", F.flatten("lines").alias("words"), F.transform("lines", lambda w: F.when(fits(F.size(w)), _bigrams(w))).alias("units"))
            .select("*", F.when(F.size("words") > 1, _bigrams(F.col("words"))).otherwise(F.array().cast("array<string>")).alias("grams"))
            .select("*", F.transform("units", lambda u: F.when(u.isNotNull(), best(u))).alias("line_hits"),
                    F.when(several & fits(F.size("words")), best(F.col("grams"))).alias("all_hit"), found.alias("found"))
            .select("id", "lines", "line_hits", "all_hit", *own)
            .select("id", "lines", "line_hits", "all_hit", *marked)
            .select("id", "lines", "line_hits", "all_hit", F.array_sort(windows).alias("windows"))
            .select("*", F.when(F.size("windows") > 0, line_of).alias("line_of"))
            .select("id", F.filter(F.concat("line_hits", F.array("all_hit")), lambda h: h.isNotNull()).alias("hits"),
                    F.transform("windows", lambda x: F.struct(x["d"].alias("d"), x["name"].alias("name"))).alias("more"), places.alias("places"))
            .select("id", F.array_min(F.concat("hits", "more")).alias("top"), (F.size("hits") + F.col("places")).cast("long").alias("n_units"))
            .select(F.col("id").alias(id_col), F.col("top.name").alias("license"), (-F.col("top.d")).alias("dice"), "n_units"))


def duckdb_sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The scan of lines and whole texts for DuckDB, without pruning; it has no windows."""
    rows = [(k, name, g, c, len(template_bigrams(t))) for k, (name, t) in enumerate(templates)
            for g, c in sorted(Counter(template_bigrams(t)).items())]
    values = ", ".join(f"({k}, '{name}', '{g}', {c}, {n})" for k, name, g, c, n in rows)
    letters = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = r"list_filter(regexp_split_to_array({}, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    return f"""
WITH tpl(k, name, g, c, n) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id, {letters} AS t FROM documents),
line AS (SELECT r, {words.format("u")} AS w FROM (SELECT r, unnest(string_split(t, chr(10))) AS u FROM d)),
unit AS (
  SELECT row_number() OVER () AS i, r, w FROM (
    SELECT r, w FROM line
    UNION ALL
    SELECT d.r, {words.format("d.t")} FROM d WHERE (SELECT count(*) FROM line WHERE line.r = d.r AND len(w) > 0) > 1
  ) WHERE len(w) BETWEEN 2 AND 400
),
gram AS (SELECT i, r, len(w) - 1 AS m, unnest(list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1])) AS g FROM unit),
cnt AS (SELECT i, r, m, g, count(*) AS c FROM gram GROUP BY ALL),
score AS (SELECT cnt.r, cnt.i, tpl.k, tpl.name, 2.0 * sum(least(cnt.c, tpl.c)) / (any_value(cnt.m) + any_value(tpl.n)) AS dice
          FROM cnt JOIN tpl USING (g) GROUP BY cnt.r, cnt.i, tpl.k, tpl.name),
best AS (SELECT r, i, name, dice FROM score WHERE dice >= {threshold} - 1e-12
         QUALIFY row_number() OVER (PARTITION BY r, i ORDER BY dice DESC, name) = 1),
top AS (SELECT r, arg_min(name, struct_pack(a := -dice, b := name)) AS license, max(dice) AS dice, count(*) AS n_units FROM best GROUP BY r)
SELECT d.doc_id, license, CAST(dice AS DOUBLE) AS dice, CAST(coalesce(n_units, 0) AS BIGINT) AS n_units
FROM d LEFT JOIN top USING (r)
"""
