"""License scans by sentence rules.

A text is cut into sentences; each is normalised and looked up among known licence
sentences, which turns the text into a sequence of sentence identifiers. The cutter also
breaks inside some of them, at their own colons and semicolons and where a line in capitals
or behind a comment mark goes on, so pieces in a row that amount to a known sentence are
that sentence. Ordered rules
then take their own sequences out of it: a rule that stands earlier consumes its
identifiers, so a full licence wins over the sentences that it shares with others. All in
DataFrame expressions: one pass over the text and no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences, normalised as ``normalise`` does.
SENTENCES = {
    "MitGrant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "MitNotice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "MitAsIs": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "MitLiability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "MitName": "released under the mit license",
    "MitNameLicensed": "licensed under the mit license",
    "MitNameFile": "this project is licensed under the mit license",
    "BsdGrant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BsdSource": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BsdBinary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "BsdEndorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "BsdAdvertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "BsdAsIs": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "IscGrant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "IscAsIs": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "ApacheGrant": "licensed under the apache license version 2 0 the license",
    "ApacheCompliance": "you may not use this file except in compliance with the license",
    "ApacheCopy": "you may obtain a copy of the license at",
    "ApacheAsIs": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "ApacheSee": "see the license for the specific language governing permissions and limitations under the license",
    "ApacheName": "licensed under the apache license version 2 0",
    "GplFree": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "Gpl2Free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "GplHope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "GplSee": "see the gnu general public license for more details",
    "GplReceived": "you should have received a copy of the gnu general public license along with this program",
    "Gpl3Name": "this work is licensed under the gnu general public license version 3",
    "Gpl2Name": "this work is licensed under the gnu general public license version 2",
    "LgplName": "this library is licensed under the gnu lesser general public license version 2 1",
    "LgplFree": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "AgplFree": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "MplForm": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "MplCopy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "EplName": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "CcByNc": "licensed under cc by nc 4 0",
    "CcBy": "licensed under cc by 4 0",
    "CcBySa": "licensed under cc by sa 4 0",
    "CcByWork": "this work is licensed under a creative commons attribution 4 0 international license",
    "CcBySaWork": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "CcByNcWork": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "Cc0Dedication": "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "UnlicenseDomain": "this is free and unencumbered software released into the public domain",
    "ZlibAsIs": "this software is provided as is without any express or implied warranty",
    "ZlibGrant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "Lgpl3Free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "Lgpl3Program": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "BoostName": "distributed under the boost software license version 1 0",
    "BoostTitle": "boost software license version 1 0 august 17th 2003",
    "ApacheTitle": "apache license version 2 0 january 2004 http www apache org licenses",
    "Gpl3Title": "gnu general public license version 3 29 june 2007",
    "Gpl2Title": "gnu general public license version 2 june 1991",
    "Lgpl3Title": "gnu lesser general public license version 3 29 june 2007",
    "Lgpl21Title": "gnu lesser general public license version 2 1 february 1999",
    "AgplTitle": "gnu affero general public license version 3 19 november 2007",
    "MplTitle": "mozilla public license version 2 0",
    "EplTitle": "eclipse public license v 2 0",
    "AllRights": "all rights reserved",
}

# The licences that an SPDX-License-Identifier line may name here.
SPDX = (
    "MIT", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "ISC", "Apache-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only",
    "GPL-3.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only",
    "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "Unlicense", "Zlib",
)
SENTENCES |= {f"Spdx-{name}": "spdx license identifier " + re.sub("[^a-z0-9]+", " ", name.lower()) for name in SPDX}

# Licences by the sentences that state them, in the order in which they are tried.
RULES = (
    ("MIT", ("MitGrant", "MitNotice", "MitAsIs", "MitLiability")),
    ("BSD-4-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdAdvertising", "BsdEndorse", "BsdAsIs")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs")),
    ("ISC", ("IscGrant", "IscAsIs")),
    ("Apache-2.0", ("ApacheGrant", "ApacheCompliance", "ApacheCopy", "ApacheAsIs", "ApacheSee")),
    ("GPL-3.0-or-later", ("GplFree", "GplHope", "GplSee", "GplReceived")),
    ("GPL-2.0-or-later", ("Gpl2Free", "GplHope", "GplSee", "GplReceived")),
    ("GPL-3.0-or-later", ("GplFree",)),
    ("GPL-2.0-or-later", ("Gpl2Free",)),
    ("LGPL-2.1-or-later", ("LgplFree",)),
    ("LGPL-2.1-only", ("LgplName",)),
    ("AGPL-3.0-or-later", ("AgplFree",)),
    ("MPL-2.0", ("MplForm", "MplCopy")),
    ("MPL-2.0", ("MplForm",)),
    ("EPL-2.0", ("EplName",)),
    ("Apache-2.0", ("ApacheName",)),
    ("Apache-2.0", ("ApacheGrant",)),
    ("MIT", ("MitGrant", "MitAsIs")),
    ("MIT", ("MitName",)),
    ("MIT", ("MitNameLicensed",)),
    ("MIT", ("MitNameFile",)),
    ("GPL-3.0-only", ("Gpl3Name",)),
    ("GPL-2.0-only", ("Gpl2Name",)),
    ("CC-BY-NC-4.0", ("CcByNc",)),
    ("CC-BY-SA-4.0", ("CcBySa",)),
    ("CC-BY-4.0", ("CcBy",)),
    ("CC-BY-4.0", ("CcByWork",)),
    ("CC-BY-SA-4.0", ("CcBySaWork",)),
    ("CC-BY-NC-4.0", ("CcByNcWork",)),
    ("CC0-1.0", ("Cc0Dedication",)),
    ("Unlicense", ("UnlicenseDomain",)),
    ("Zlib", ("ZlibAsIs", "ZlibGrant")),
    ("LGPL-3.0-or-later", ("Lgpl3Free",)),
    ("LGPL-3.0-or-later", ("Lgpl3Program",)),
    ("BSL-1.0", ("BoostName",)),
    ("BSL-1.0", ("BoostTitle",)),
    ("Apache-2.0", ("ApacheTitle",)),
    ("GPL-3.0", ("Gpl3Title",)),
    ("GPL-2.0", ("Gpl2Title",)),
    ("LGPL-3.0", ("Lgpl3Title",)),
    ("LGPL-2.1", ("Lgpl21Title",)),
    ("AGPL-3.0", ("AgplTitle",)),
    ("MPL-2.0", ("MplTitle",)),
    ("EPL-2.0", ("EplTitle",)),
    *((name, (f"Spdx-{name}",)) for name in SPDX),
    ("Proprietary", ("AllRights",)),
)
#: Licensed texts reserve all rights too: this one stands only where no other was found.
ALONE = "Proprietary"

_SPACE = r"[ \t\r\n\f]"
#: (pattern, replacement with \x01 where a sentence ends): sentence marks before space, blank
#: lines, and line ends before a capital, a digit or a comment or list mark. A hard-wrapped
#: line that goes on in lower case does not end its sentence, unless it names an SPDX licence.
BREAKS = (
    (r"(SPDX-License-Identifier:[^\n]*)\n", "$1\x01"),
    (rf"([.;:!?]){_SPACE}+", "$1\x01"),
    (rf"\n{_SPACE}*\n", "\x01"),
    (r"\n([ \t]*[-*A-Z0-9#/])", "\x01$1"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sentences(text: Column) -> Column:
    """Array of the text's sentences, as they stand."""
    for pattern, put in BREAKS:
        text = F.regexp_replace(text, pattern, put)
    return F.split(text, "\x01", -1)


def normalise(sentence: Column) -> Column:
    """Lower-case ASCII letters and digits, everything else one blank."""
    return F.trim(F.regexp_replace(F.translate(sentence, _UPPER, _LOWER), "[^a-z0-9]+", " "))


def recognised(pieces: Column, known: dict[str, str]) -> Column:
    """The pieces behind marks \\x01, with <name> for each known sentence, be it one piece or several in a row."""
    longest = sorted(known, key=lambda k: (-len(known[k]), k))
    rules = F.array(*[F.struct(F.lit(known[k]).alias("text"), F.lit("\x01" + known[k].replace(" ", "[ \x01]") + "(?=\x01)").alias("pattern"), F.lit(f"\x01<{k}>").alias("put")) for k in longest])
    # few texts hold any known sentence: only those are searched at piece boundaries
    held = F.flatten(F.transform(F.array(F.array_join(pieces, " ")), lambda flat: F.filter(rules, lambda r: F.contains(flat, r["text"]))))
    marked = F.concat(F.lit("\x01"), F.array_join(pieces, "\x01"), F.lit("\x01"))
    return F.aggregate(held, marked, lambda acc, r: F.regexp_replace(acc, r["pattern"], r["put"]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str] | None = None, rules=RULES) -> DataFrame:
    """(id, n_sentences, identifiers, licenses, unexplained) for every row of ``docs``.

    ``n_sentences`` counts known sentences, each a piece or a run of pieces, the longest first,
    and the pieces beside them. ``identifiers`` is the sequence of known sentences, ``licenses``
    the distinct licences in rule order, ``ALONE`` only if there is no other, ``unexplained``
    the identifiers that no rule consumed. Sentences without a
    letter or digit are not counted; null and empty texts have none. A rule matches its
    identifiers in a row, whatever unknown sentences stand between. Repeated and null ids
    keep a row each; other columns are ignored.
    """
    known = SENTENCES if known is None else known
    df = docs.select(F.col(id_col), F.filter(F.transform(sentences(F.coalesce(F.col(text_col), F.lit(""))), normalise), lambda s: s != "").alias("sentences_"))
    df = df.select(id_col, recognised(F.col("sentences_"), known).alias("marked_"))
    df = df.select(
        id_col, F.size(F.filter(F.split("marked_", "\x01"), lambda s: s != "")).cast("long").alias("n_sentences"),
        F.regexp_extract_all("marked_", F.lit("<([^>]*)>"), F.lit(1)).alias("identifiers"),
    )

    # the sequence as text, <A><B>...: a rule takes out its own stretches
    step = F.struct(F.array_join(F.transform("identifiers", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "").alias("rest"), F.array().cast("array<string>").alias("found"))
    rule_rows = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in ids)).alias("ids")) for name, ids in rules])
    matched = F.aggregate(rule_rows, step, lambda acc, rule: F.struct(
        F.replace(acc["rest"], rule["ids"], F.lit("")).alias("rest"),
        F.when(F.contains(acc["rest"], rule["ids"]), F.array_append(acc["found"], rule["name"])).otherwise(acc["found"]).alias("found"),
    ))
    df = df.withColumn("matched_", F.when(F.size("identifiers") > 0, matched).otherwise(F.struct(F.lit("").alias("rest"), F.array().cast("array<string>").alias("found"))))
    left = F.regexp_extract_all("matched_.rest", F.lit("<([^>]*)>"), F.lit(1))
    found = F.array_distinct("matched_.found")
    found = F.when(F.size(found) > 1, F.array_remove(found, ALONE)).otherwise(found)
    return df.select(id_col, "n_sentences", "identifiers", found.alias("licenses"), left.alias("unexplained"))


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    """Every document with its licence sentences and the licences they amount to."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "n_sentences", F.size("identifiers").cast("long").alias("n_known"), F.array_join("identifiers", ",").alias("identifiers"),
        F.array_join("licenses", ",").alias("licenses"), F.size("unexplained").cast("long").alias("n_unexplained"),
    )


def _oracle() -> str:
    """The scan in DuckDB SQL."""
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    text = "coalesce(text, '')"
    for pattern, put in BREAKS:
        text = f"regexp_replace({text}, {lit(pattern)}, {lit(put.replace('$1', chr(92) + '1'))}, 'g')"
    marked = "w"
    for k in sorted(SENTENCES, key=lambda k: (-len(SENTENCES[k]), k)):
        # marks are doubled, so that each piece has its own two
        marked = f"regexp_replace({marked}, {lit(chr(1) + SENTENCES[k].replace(' ', '(?: |' + 2 * chr(1) + ')') + chr(1))}, {lit(f'{chr(1)}<{k}>{chr(1)}')}, 'g')"
    rest, found = "seq", []
    for i, (name, ids) in enumerate(RULES):
        own = lit("".join(f"<{x}>" for x in ids))
        found.append((f"r{i}", rest, own, name))
        rest = f"r{i}"
    chain = ",\n".join(f"s{i} AS (SELECT *, replace({r}, {own}, '') AS {n} FROM {'q' if not i else f's{i - 1}'})" for i, (n, r, own, _) in enumerate(found))
    flags = ", ".join(f"CASE WHEN contains({r}, {own}) THEN {lit(name)} END" for _, r, own, name in found)
    last = found[-1][0]
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split({text}, chr(1)) AS parts FROM documents),
s AS (SELECT r, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM d),
n AS (SELECT r, i, trim(regexp_replace(translate(part, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g')) AS sentence FROM s),
p AS (SELECT r, string_agg(chr(1) || sentence || chr(1), '' ORDER BY i) AS w FROM n WHERE sentence <> '' GROUP BY r),
m AS (SELECT r, {marked} AS w FROM p),
q AS (SELECT d.doc_id, coalesce((length(m.w) - length(replace(m.w, chr(1), ''))) // 2, 0) AS n_sentences, coalesce(len(regexp_extract_all(m.w, '<([^>]*)>')), 0) AS n_known,
        coalesce(array_to_string(regexp_extract_all(m.w, '<([^>]*)>', 1), ','), '') AS identifiers, coalesce(array_to_string(regexp_extract_all(m.w, '<([^>]*)>'), ''), '') AS seq
      FROM d LEFT JOIN m USING (r)),
{chain},
f AS (SELECT * EXCLUDE (l0), list_filter(l0, lambda x: x <> {lit(ALONE)} OR len(list_distinct(l0)) = 1) AS l FROM
      (SELECT *, list_filter([{flags}], lambda x: x IS NOT NULL) AS l0 FROM s{len(found) - 1}))
SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, CAST(n_known AS BIGINT) AS n_known, identifiers,
       array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS licenses,
       CAST(length({last}) - length(replace({last}, '<', '')) AS BIGINT) AS n_unexplained
FROM f
"""


ORACLE_SQL = _oracle()
