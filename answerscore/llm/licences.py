"""Licence scan by sentence rules, in DataFrame expressions only.

A text is cut into sentences at line ends and behind ``.``, ``!`` or ``?`` before white space; a sentence is
normalised (A-Z lower-cased, everything but letters, digits and single spaces removed) and mapped to the
identifier of a known licence sentence.  A known sentence may go on over line ends that are neither behind ``.``,
``!`` or ``?`` nor beside a blank line; it has the number of its first part.  The identifier sequence of the text, unknown sentences skipped, is
matched against ordered rules: a rule fits where its identifiers stand in the sequence one after the other.
Every fitting rule is reported unless an earlier (longer) rule of the same licence fits.

Defined results: null and empty texts have no sentences and no licences; repeated sentences count once per
occurrence; repeated rows are repeated; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: identifier -> normalised licence sentences
SENTENCES = {
    "mit-notice": ["released under the mit license", "licensed under the mit license", "this software is released under the mit license", "distributed under the mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"],
    "mit-warranty": ["the software is provided as is without warranty of any kind express or implied"],
    "apache2-notice": ["licensed under the apache license version 20", "released under the apache license version 20", "licensed under the apache license version 20 the license"],
    "apache2-use": ["you may not use this file except in compliance with the license"],
    "gpl3-notice": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"],
    "gpl2-notice": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"],
    "gpl-later": ["this program is free software you can redistribute it andor modify it under the terms of the gnu general public license"],
    "ccby-nc4-notice": ["licensed under cc bync 40", "this work is licensed under cc bync 40", "licensed under a creative commons attributionnoncommercial 40 international license"],
    "ccby4-notice": ["licensed under cc by 40", "this work is licensed under cc by 40", "licensed under a creative commons attribution 40 international license"],
    "bsd-redistribution": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-notice": ["released under the bsd license", "licensed under the bsd license"],
    "mpl2-notice": ["this source code form is subject to the terms of the mozilla public license v"],
    "rights-reserved": ["all rights reserved"],
}
#: identifier -> whole sentences of the standard texts, of which ``SENTENCES`` has the beginning; the SQL does not have
#: them.  ``_`` is a space that is no line end, as the parts on both sides are known sentences of their own.
STANDARD = {
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense andor sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-warranty": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "apache2-notice": ["licensed under the apache license version 20 the license_you may not use this file except in compliance with the license"],
    "gpl3-notice": ["this program is free software you can redistribute it andor modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2-notice": ["this program is free software you can redistribute it andor modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
}
#: (licence, sequence of identifiers), in the order in which they are tried
RULES = (
    ("MIT", ("mit-notice", "mit-grant", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-warranty")),
    ("Apache-2.0", ("apache2-notice", "apache2-use")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-grant",)),
    ("Apache-2.0", ("apache2-notice",)),
    ("GPL-3.0", ("gpl3-notice",)),
    ("GPL-2.0", ("gpl2-notice",)),
    ("GPL", ("gpl-later",)),
    ("CC-BY-NC-4.0", ("ccby-nc4-notice",)),
    ("CC-BY-4.0", ("ccby4-notice",)),
    ("BSD", ("bsd-redistribution",)),
    ("BSD", ("bsd-notice",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("Proprietary", ("rights-reserved",)),
)
LIKELY = "(?i)licen[sc]e|permission|warrant|redistribut|rights"  # every known sentence has one of these
_LINE, _END, _CUT = "\x01", "\x02", "\x03"


def normalised(text: Column) -> Column:
    """The normalised sentences of a text, each between marks: ``_LINE`` at a line end inside a sentence, or ``_END``."""
    out = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _LINE + _END + _CUT, "abcdefghijklmnopqrstuvwxyz")
    out = F.regexp_replace(F.regexp_replace(out, r"\s*\n\s*\n\s*", _END), r"\s*\n\s*", _LINE)
    out = F.regexp_replace(out, rf"(?<=[.!?])(?:\s+|{_LINE})", _END)
    out = F.regexp_replace(F.regexp_replace(out, rf"[^\p{{L}}\p{{N}}\s{_LINE}{_END}]+", ""), r"\s+", " ")
    return F.regexp_replace(F.concat(F.lit(_END), out, F.lit(_END)), f" ?([{_LINE}{_END}]) ?", "$1")


def sentence_ids(text: Column, sentences=SENTENCES, standard=STANDARD) -> Column:
    """array<struct<pos, id>>: the known sentences of a text in order, with their sentence numbers."""
    forms = [(form, key) for known in (sentences, standard) for key, listed in known.items() for form in listed]
    known = F.create_map(*(F.lit(x) for form, key in forms for x in (form.replace("_", " "), key)))
    one_of = "|".join(form.replace(" ", f"[ {_LINE}]").replace("_", " ") for form, _ in sorted(forms, key=lambda x: -len(x[0])))
    marks = f"[{_LINE}{_END}]"
    cut = F.regexp_replace(normalised(text), f"(?<={marks})({one_of})(?={marks})", f"{_CUT}$1{_CUT}")
    parts = F.split(cut, _CUT)  # every second part is a known sentence
    found = F.transform(parts, lambda x, i: F.struct(F.regexp_count(x, F.lit(marks)).alias("marks"), F.when(i % 2 == 1, F.try_element_at(known, F.translate(x, _LINE, " "))).alias("id")))
    before = lambda i: F.aggregate(F.slice(found, F.lit(1), i), F.lit(0), lambda n, x: n + x["marks"])
    numbered = F.transform(found, lambda x, i: F.struct((F.when(x["id"].isNotNull(), before(i)) - 1).alias("pos"), x["id"].alias("id")))
    none = F.array().cast("array<struct<pos:int,id:string>>")
    return F.when(F.rlike(text, F.lit(LIKELY)), F.filter(numbered, lambda x: x["id"].isNotNull())).otherwise(none)


def matches(ids: Column, rules=RULES) -> Column:
    """array<struct<licence, rule>>: rules that fit the identifier sequence, each licence by its first fitting rule."""
    chain = F.concat(F.lit(">"), F.array_join(F.transform(ids, lambda x: x["id"]), ">"), F.lit(">"))
    out, seen = [], {}
    for n, (licence, sequence) in enumerate(rules):
        fits = F.contains(chain, F.lit(">" + ">".join(sequence) + ">"))
        first = fits & ~seen[licence] if licence in seen else fits
        out.append(F.when(first, F.struct(F.lit(licence).alias("licence"), F.lit(n).alias("rule"))))
        seen[licence] = seen[licence] | fits if licence in seen else fits
    return F.array_compact(F.array(*out))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, sentences (array<struct<pos, id>>), licences (array<struct<licence, rule>>)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), sentence_ids(F.col(text_col)).alias("sentences"))
    return rows.withColumn("licences", matches(F.col("sentences")))
