"""License scans by sentence rules, with DataFrame functions only.

A text is cut into parts at line breaks and sentence ends, each is normalised (A-Z lowered, comment signs and punctuation
to single blanks), and the sentences that the table knows become identifiers. A sentence may be one part or several that
follow each other, so wrapped and commented texts are found; parts of one line are joined last. Where a sentence names
someone, other names may stand. A document's identifier sequence is then matched against the licence
rules in their order: a rule is a sequence of identifiers that follow each other; what it matches is used up, so that
the notice of a longer rule isn't counted again by a shorter one. Identifiers that no rule takes are reported.

Defined results: a null or empty text has no sentence and no licence; repeated rows are judged each for itself; null ids
pass through; very long texts are judged whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_of, read_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Sentences of public licence texts and notices, normalised, with their identifiers.
SENTENCES = {
    "released under the mit license": "MITref",
    "licensed under the mit license": "MITref",
    "this project is licensed under the mit license": "MITref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITgrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITnotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MITasis",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MITliable",
    "licensed under the apache license version 2 0": "Apache2ref",
    "licensed under the apache license version 2 0 the license": "Apache2",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "Apache2",
    "you may not use this file except in compliance with the license": "ApacheComply",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "Apache2copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheAsis",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "this work is licensed under the gnu general public license version 3": "GPL3ref",
    "licensed under the gnu general public license version 3": "GPL3ref",
    "this work is licensed under the gnu general public license version 2": "GPL2ref",
    "licensed under the gnu general public license version 2": "GPL2ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3plus",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2plus",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "GPL2only",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "LGPL21plus",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPLnowarranty",
    "see the gnu general public license for more details": "GPLsee",
    "you should have received a copy of the gnu general public license along with this program": "GPLreceived",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL2",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "MPL2copy",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDgrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDsource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDbinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDendorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BSDasis",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCgrant",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "licensed under cc by 4 0": "CCBYref",
    "licensed under cc by sa 4 0": "CCBYSAref",
    "licensed under cc by nc 4 0": "CCBYNCref",
    "this work is licensed under a creative commons attribution 4 0 international license": "CCBYref",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "CCBYSAref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "CCBYNCref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "AGPL3plus",
    "see the gnu affero general public license for more details": "AGPLsee",
    "you should have received a copy of the gnu affero general public license along with this program": "AGPLreceived",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "LGPL3plus",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "LGPLnowarranty",
    "see the gnu lesser general public license for more details": "LGPLsee",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "EPL2",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution": "EPL1",
    "this software is provided as is without any express or implied warranty": "ZlibAsis",
    "in no event will the authors be held liable for any damages arising from the use of this software": "ZlibLiable",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibGrant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "BSL1grant",
    "distributed under the boost software license version 1 0": "BSL1ref",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "BSDadvertise",
    "the contents of this file are subject to the terms of the common development and distribution license the license": "CDDL",
    "the contents of this file are subject to the terms of the common development and distribution license": "CDDL",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "ZeroBSDgrant",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "CC0",
    "this work is released under cc0 1 0 universal": "CC0",
    "this program is free software you can redistribute it and or modify it under the terms of the artistic license 2 0": "Artistic2",
    "licensed under the mozilla public license 2 0": "MPL2ref",
    "licensed under the bsd 3 clause license": "BSD3ref",
    "licensed under the bsd 2 clause license": "BSD2ref",
    "licensed under the gnu affero general public license version 3": "AGPL3ref",
    "licensed under the gnu lesser general public license version 3": "LGPL3ref",
    "all rights reserved": "AllRights",
}

#: Sentences with a part that names someone: what stands before it, what stands for it in the table, what follows.
VARIABLE = [
    ("neither the name of", "the copyright holder", "nor the names of its contributors"),
    ("this software is provided by", "the copyright holders and contributors", "as is and any express"),
    ("in no event shall", "the authors or copyright holders", "be liable for any claim damages or other liability"),
]
#: Words that such a part has at most.
NAME_WORDS = 10

#: Licence rules in the order in which they apply: longer sequences before their parts.
RULES = [
    ("MIT", "MITgrant MITnotice MITasis MITliable"),
    ("MIT", "MITgrant MITnotice MITasis"),
    ("Apache-2.0", "Apache2 ApacheComply Apache2copy ApacheAsis ApacheSee"),
    ("Apache-2.0", "Apache2 Apache2copy ApacheAsis ApacheSee"),
    ("GPL-3.0-or-later", "GPL3plus GPLnowarranty GPLsee GPLreceived"),
    ("GPL-3.0-or-later", "GPL3plus GPLnowarranty GPLsee"),
    ("GPL-2.0-or-later", "GPL2plus GPLnowarranty GPLsee GPLreceived"),
    ("GPL-2.0-or-later", "GPL2plus GPLnowarranty GPLsee"),
    ("GPL-2.0-only", "GPL2only GPLnowarranty GPLsee"),
    ("AGPL-3.0-or-later", "AGPL3plus GPLnowarranty AGPLsee AGPLreceived"),
    ("AGPL-3.0-or-later", "AGPL3plus GPLnowarranty AGPLsee"),
    ("LGPL-3.0-or-later", "LGPL3plus LGPLnowarranty LGPLsee"),
    ("LGPL-2.1-or-later", "LGPL21plus LGPLnowarranty LGPLsee"),
    ("Zlib", "ZlibAsis ZlibLiable ZlibGrant"),
    ("BSD-4-Clause", "BSDgrant BSDsource BSDbinary BSDadvertise BSDendorse BSDasis"),
    ("BSD-3-Clause", "BSDgrant BSDsource BSDbinary BSDendorse BSDasis"),
    ("BSD-2-Clause", "BSDgrant BSDsource BSDbinary BSDasis"),
    ("MPL-2.0", "MPL2 MPL2copy"),
    ("GPL-3.0-or-later", "GPL3plus"),
    ("GPL-2.0-or-later", "GPL2plus"),
    ("GPL-2.0-only", "GPL2only"),
    ("LGPL-2.1-or-later", "LGPL21plus"),
    ("MPL-2.0", "MPL2"),
    ("AGPL-3.0-or-later", "AGPL3plus"),
    ("LGPL-3.0-or-later", "LGPL3plus"),
    ("EPL-2.0", "EPL2"),
    ("EPL-1.0", "EPL1"),
    ("BSL-1.0", "BSL1grant"),
    ("BSL-1.0", "BSL1ref"),
    ("CDDL-1.0", "CDDL"),
    ("CC0-1.0", "CC0"),
    ("Artistic-2.0", "Artistic2"),
    ("Zlib", "ZlibGrant"),
    ("0BSD", "ZeroBSDgrant"),
    ("MPL-2.0", "MPL2ref"),
    ("BSD-3-Clause", "BSD3ref"),
    ("BSD-2-Clause", "BSD2ref"),
    ("AGPL-3.0-only", "AGPL3ref"),
    ("LGPL-3.0-only", "LGPL3ref"),
    ("ISC", "ISCgrant"),
    ("Unlicense", "Unlicense"),
    ("MIT", "MITref"),
    ("Apache-2.0", "Apache2ref"),
    ("GPL-3.0-only", "GPL3ref"),
    ("GPL-2.0-only", "GPL2ref"),
    ("CC-BY-4.0", "CCBYref"),
    ("CC-BY-SA-4.0", "CCBYSAref"),
    ("CC-BY-NC-4.0", "CCBYNCref"),
]

SPACE = r"[ \t\n\x0B\f\r]+"


def parts_of(text: Column) -> Column:
    """Normalised parts with marks around them: L for a line break, E for . ! ? : ; before white space, B for blank lines."""
    low = F.concat(F.lit("\n\n"), F.translate(text, UPPER, LOWER), F.lit("\n\n"))
    marked = F.regexp_replace(F.regexp_replace(low, r"[.!?:;](?=[ \t\n\x0B\f\r])", "E"), "\n", "L")
    plain = F.regexp_replace(marked, "[^a-z0-9EL]+", " ")
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "[ EL]*L[ E]*L[ EL]*", "B"), "[ L]*E[ EL]*", "E"), " *L *", "L")
    for before, name, after in VARIABLE:
        some = f"(?<=[ELB])({before}) (?:[a-z0-9]+ ){{1,{NAME_WORDS}}}({after})".replace(" ", "[ L]")
        out = F.regexp_replace(out, some, f"$1 {name} $2")
    return out


def known_pattern(sentences: dict[str, str]) -> str:
    """Finds the sentences from part start to part end: first within lines' breaks, then over sentence ends, then over blank
    lines; the longest first."""
    longest = sorted(sentences, key=lambda s: (-len(s), s))
    return "(?<=[ELB])(?:" + "|".join(s.replace(" ", f"[{marks}]") for marks in (" L", " EL", " ELB") for s in longest) + ")(?=[ELB])"


def scan_licenses(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per document: doc_id, n_known (sentences the table knows), sentence_ids, licenses (by rule order), unmatched."""
    sentences, rules = sentences or SENTENCES, rules or RULES
    table = F.create_map(*(F.lit(x) for pair in sentences.items() for x in pair))
    found = F.regexp_extract_all(parts_of(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(known_pattern(sentences)), F.lit(0))
    ids = F.transform(found, lambda s: F.element_at(table, F.translate(s, "ELB", "   ")))
    out = documents_of(docs).select("doc_id", ids.alias("ids"))
    left = F.when(F.size("ids") > 0, F.concat(F.lit("<"), F.array_join("ids", "><"), F.lit(">"))).otherwise("")
    names = []
    out = out.select("doc_id", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", " ").alias("sentence_ids"), left.alias("left"))
    found = F.lit("")
    column = F.col("left")
    for name, sequence in rules:
        pattern = "".join(f"<{x}>" for x in sequence.split())
        found = F.concat(found, F.when(column.contains(pattern), F.lit(f"{name} ")).otherwise(""))
        column = F.replace(column, F.lit(pattern), F.lit("|"))
        names.append(name)
    matched = out.select("doc_id", "n_known", "sentence_ids", F.when(F.col("n_known") > 0, F.trim(found)).otherwise("").alias("names"), F.when(F.col("n_known") > 0, column).otherwise("").alias("left"))
    unmatched = F.trim(F.regexp_replace(F.regexp_replace("left", r"[|]", ""), "[<>]+", " "))
    licenses = F.array_join(F.array_distinct(F.filter(F.split("names", " "), lambda x: x != "")), " ")
    return matched.select("doc_id", "n_known", "sentence_ids", licenses.alias("licenses"), unmatched.alias("unmatched"))


def op4_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The same by DuckDB: sentences as rows, rules applied one after the other."""
    values = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    named = "sentence"
    for before, name, after in VARIABLE:
        named = f"regexp_replace({named}, '^({before}) (?:[a-z0-9]+ ){{1,{NAME_WORDS}}}({after})', '\\1 {name} \\2')"
    steps, last = [], "r0"
    for k, (name, sequence) in enumerate(RULES, 1):
        pattern = "".join(f"<{x}>" for x in sequence.split())
        steps.append(f"r{k} AS (SELECT doc_key, replace(seq, '{pattern}', '|') AS seq, CASE WHEN contains(seq, '{pattern}') AND NOT list_contains(names, '{name}') THEN list_append(names, '{name}') ELSE names END AS names FROM {last})")
        last = f"r{k}"
    return f"""
WITH known(sentence, ident) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS doc_key, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
cut AS (SELECT doc_key, string_split(regexp_replace(low, '([.!?:;])[ \\t\\x0B\\f\\r]+', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM d),
flat AS (SELECT doc_key, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM cut),
plain AS (SELECT doc_key, pos, trim(regexp_replace(part, '[^a-z0-9]+', ' ', 'g')) AS sentence FROM flat),
named AS (SELECT doc_key, pos, {named} AS sentence FROM plain),
hits AS (SELECT doc_key, pos, ident FROM named JOIN known USING (sentence)),
seqs AS (SELECT doc_key, count(*) AS n, string_agg(ident, ' ' ORDER BY pos) AS ids, string_agg('<' || ident || '>', '' ORDER BY pos) AS seq FROM hits GROUP BY doc_key),
r0 AS (SELECT doc_key, seq, CAST([] AS VARCHAR[]) AS names FROM seqs),
{", ".join(steps)}
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_known, coalesce(s.ids, '') AS sentence_ids,
       coalesce(array_to_string(r.names, ' '), '') AS licenses,
       coalesce(trim(regexp_replace(replace(r.seq, '|', ''), '[<>]+', ' ', 'g')), '') AS unmatched
FROM d LEFT JOIN seqs s USING (doc_key) LEFT JOIN {last} r USING (doc_key)"""


ORACLE_SQL = {"op4_license_rules": _oracle()}
