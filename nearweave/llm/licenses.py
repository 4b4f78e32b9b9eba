"""Licence scans by sentence rules.

Texts are cut into sentences, at punctuation before white space and at blank lines, and normalised; a sentence may run
over several lines, and any run of whole lines inside it counts as a sentence too (headings, one-line notices), the
earliest and then longest first; a normalised sentence that is known stands for a licence-sentence
identifier; the document's sequence of identifiers is matched from left to right against ordered licence rules, each a
sequence of identifiers. A rule that stands earlier wins where two begin at the same place; matches do not overlap;
unknown sentences between known ones are skipped. Only built-in functions run, in one pass without a shuffle.

Defined results: a null or empty text, and one without known sentences, has no identifiers and no licences (empty
strings, 0); repeated rows give repeated rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_texts

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The plain form that SQL uses: a sentence ends at such marks before white space, or at the end of a line.
SENTENCE_END = r"[.!?;:]+[ \t\f\r]+|[.!?;:]*[\n]+"
#: Everything else becomes a blank in a normalised sentence.
NOT_KEPT = r"[^a-z0-9]+"

# Known sentences in normalised form by identifier, from the public texts of the licences.
SENTENCES: dict[str, tuple[str, ...]] = {
    "Apache2Name": ("licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license"),
    "Apache2Use": ("you may not use this file except in compliance with the license",),
    "Apache2Copy": ("you may obtain a copy of the license at",),
    "Apache2AsIs": (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    "MitName": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"),
    "MitGrant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ),
    "MitNotice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "MitAsIs": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ),
    "Gpl3Name": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"),
    "Gpl2Name": ("this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"),
    "GplGrant3Plus": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "GplFree": ("this program is free software",),
    "GplTerms3Plus": (
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "GplAsIs": (
        "this program is distributed in the hope that it will be useful but without any warranty",
        "this library is distributed in the hope that it will be useful but without any warranty",
    ),
    "GplTerms": ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",),
    "LgplFree": ("this library is free software",),
    "LgplTerms": ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",),
    "LgplTerms3Plus": (
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "AgplTerms": ("you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",),
    "AgplTerms3Plus": (
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "Either2Plus": ("either version 2 of the license or at your option any later version",),
    "Either21Plus": ("either version 2 1 of the license or at your option any later version",),
    "Either3Plus": ("either version 3 of the license or at your option any later version",),
    "Mpl2Subject": ("this source code form is subject to the terms of the mozilla public license v",),
    "Mpl2Copy": (
        "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
        "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    ),
    "Epl1Name": ("this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at",),
    "Epl2Name": (
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
        "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0 which accompanies this distribution and is available at",
    ),
    "IscGrant": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "IscAsIs": ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",),
    "ZlibAsIs": ("this software is provided as is without any express or implied warranty",),
    "ZlibGrant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "ZlibOrigin": ("the origin of this software must not be misrepresented",),
    "ZlibAltered": ("altered source versions must be plainly marked as such and must not be misrepresented as being the original software",),
    "ZlibNotice": ("this notice may not be removed or altered from any source distribution",),
    "Bsl1Name": ("distributed under the boost software license version 1 0",),
    "Bsl1Grant": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    ),
    "UnlicenseFree": ("this is free and unencumbered software released into the public domain",),
    "UnlicenseAnyone": (
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    "Cc0Dedicated": (
        "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    ),
    "CcByNc4Name": ("licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "CcBySa4Name": ("licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "CcBy4Name": ("licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    "BsdGrant": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "BsdSource": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "BsdBinary": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    "BsdEndorse": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "AllRights": ("all rights reserved",),
}
#: Ordered rules: the first that matches at a place wins.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("MIT", ("MitName", "MitGrant", "MitNotice", "MitAsIs")),
    ("MIT", ("MitGrant", "MitNotice", "MitAsIs")),
    ("MIT", ("MitName",)),
    ("Apache-2.0", ("Apache2Name", "Apache2Use", "Apache2Copy", "Apache2AsIs")),
    ("Apache-2.0", ("Apache2Name",)),
    ("GPL-3.0-or-later", ("GplFree", "GplTerms3Plus", "GplAsIs")),
    ("GPL-3.0-or-later", ("GplGrant3Plus", "GplAsIs")),
    ("GPL-3.0-or-later", ("GplGrant3Plus",)),
    ("GPL-3.0-or-later", ("GplFree", "GplTerms3Plus")),
    ("GPL-3.0-or-later", ("GplFree", "GplTerms", "Either3Plus")),
    ("GPL-2.0-or-later", ("GplFree", "GplTerms", "Either2Plus")),
    ("LGPL-2.1-or-later", ("LgplFree", "LgplTerms", "Either21Plus")),
    ("LGPL-3.0-or-later", ("LgplFree", "LgplTerms", "Either3Plus")),
    ("LGPL-3.0-or-later", ("LgplFree", "LgplTerms3Plus")),
    ("LGPL-3.0-or-later", ("GplFree", "LgplTerms3Plus")),
    ("AGPL-3.0-or-later", ("GplFree", "AgplTerms3Plus")),
    ("AGPL-3.0-or-later", ("GplFree", "AgplTerms", "Either3Plus")),
    ("MPL-2.0", ("Mpl2Subject", "Mpl2Copy")),
    ("EPL-1.0", ("Epl1Name",)),
    ("EPL-2.0", ("Epl2Name",)),
    ("ISC", ("IscGrant", "IscAsIs")),
    ("ISC", ("IscGrant",)),
    ("Zlib", ("ZlibAsIs", "ZlibGrant", "ZlibOrigin", "ZlibAltered", "ZlibNotice")),
    ("BSL-1.0", ("Bsl1Name",)),
    ("BSL-1.0", ("Bsl1Grant",)),
    ("Unlicense", ("UnlicenseFree", "UnlicenseAnyone")),
    ("Unlicense", ("UnlicenseFree",)),
    ("CC0-1.0", ("Cc0Dedicated",)),
    ("GPL-3.0-only", ("Gpl3Name",)),
    ("GPL-2.0-only", ("Gpl2Name",)),
    ("CC-BY-NC-4.0", ("CcByNc4Name",)),
    ("CC-BY-SA-4.0", ("CcBySa4Name",)),
    ("CC-BY-4.0", ("CcBy4Name",)),
    ("Proprietary", ("AllRights",)),
)
#: Each known sentence holds one of these, within a word, as blanks are not normalised yet: texts without any are not cut.
CUES = ("licens", "permi", "distribut", "warrant", "reserved", "software")
assert all(any(c in s for c in CUES) for forms in SENTENCES.values() for s in forms if "copy of the license" not in s)

_FORMS = {form: name for name, forms in SENTENCES.items() for form in forms}


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def marked_sentences(text: Column) -> Column:
    """Lower case, letters and digits of ASCII only, single blanks; E stands between sentences, L between their lines."""
    out = F.regexp_replace(lower_ascii(text), r"[.!?;:]+[ \t\f\r\n]+|\n[^a-z0-9]*\n", "E")
    out = F.regexp_replace(F.regexp_replace(out, r"\n", "L"), r"[^a-z0-9EL]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ L]*E[ EL]*", "E"), r" ?L[ L]*", "L"))


def known_sentences(text: Column) -> Column:
    """The known sentences of a text, in order: between ends of sentences or lines, on one line or several."""
    forms = "|".join(f.replace(" ", "[ L]") for f in sorted(_FORMS, key=len, reverse=True))
    found = F.regexp_extract_all(marked_sentences(text), F.lit(f"(?<![a-z0-9 ])(?:{forms})(?![a-z0-9 ])"), F.lit(0))
    return F.transform(found, lambda s: F.translate(s, "L", " "))


def scan_licences(docs: DataFrame) -> DataFrame:
    """doc_id, n_known (known sentences), sentence_ids and licences (distinct, in order of their first match)."""
    known = F.create_map(*(F.lit(x) for pair in _FORMS.items() for x in pair))
    text = F.coalesce(F.col("text"), F.lit(""))
    lowered = lower_ascii(text)
    cue = None
    for c in CUES:
        cue = lowered.contains(c) if cue is None else cue | lowered.contains(c)
    named = F.transform(known_sentences(text), lambda s: F.element_at(known, s))
    ids = F.when(cue, named).otherwise(F.array().cast("array<string>"))
    found = doc_texts(docs).select("doc_id", ids.alias("ids"))
    pattern = "|".join("".join(f"<{i}>" for i in rule) for _, rule in RULES)
    names = F.create_map(*(F.lit(x) for name, rule in RULES for x in ("".join(f"<{i}>" for i in rule), name)))
    found = found.select("doc_id", "ids", F.concat_ws("", F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">")))).alias("marked"))
    matches = F.regexp_extract_all("marked", F.lit(pattern), F.lit(0))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_known"),
        F.array_join("ids", " ").alias("sentence_ids"),
        F.array_join(F.array_distinct(F.transform(matches, lambda m: F.element_at(names, m))), ",").alias("licences"),
    )


def oracle_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    forms = ", ".join(f"({quote(f)}, {quote(n)})" for f, n in _FORMS.items())
    rules = ", ".join(f"({quote(''.join(f'<{i}>' for i in rule))}, {quote(name)})" for name, rule in RULES)
    pattern = "|".join("".join(f"<{i}>" for i in rule) for _, rule in RULES)
    end = SENTENCE_END.replace("\\t", "\t").replace("\\f", "\f").replace("\\r", "\r").replace("\\n", "\n")
    return f"""
WITH known(form, id) AS (VALUES {forms}), rules(seq, licence) AS (VALUES {rules}),
sentences AS (
  SELECT doc_id, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {quote(end)})) AS s,
         generate_subscripts(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {quote(end)}), 1) AS n
  FROM documents),
ids AS (SELECT doc_id, n, id FROM sentences JOIN known ON form = trim(regexp_replace(s, {quote(NOT_KEPT)}, ' ', 'g'))),
seqs AS (SELECT doc_id, count(*) AS n_known, string_agg(id, ' ' ORDER BY n) AS sentence_ids,
                string_agg('<' || id || '>', '' ORDER BY n) AS marked FROM ids GROUP BY doc_id),
matches AS (SELECT doc_id, unnest(regexp_extract_all(marked, {quote(pattern)})) AS seq,
                   generate_subscripts(regexp_extract_all(marked, {quote(pattern)}), 1) AS n FROM seqs),
first AS (SELECT doc_id, licence, min(n) AS n FROM matches JOIN rules USING (seq) GROUP BY doc_id, licence),
found AS (SELECT doc_id, string_agg(licence, ',' ORDER BY n) AS licences FROM first GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_known, 0)::BIGINT AS n_known, coalesce(sentence_ids, '') AS sentence_ids, coalesce(licences, '') AS licences
FROM documents d LEFT JOIN seqs USING (doc_id) LEFT JOIN found USING (doc_id)"""
