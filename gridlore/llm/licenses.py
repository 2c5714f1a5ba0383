"""Licence scans by sentence rules, in DataFrame functions only.

A text is split into sentences (at ``.!?`` with what punctuation follows, before white space or the
end, and at empty lines, but not in ``v. 2.0``, after an initial, nor between ``at`` and the address after it; an SPDX tag
ends with its line or comment); a sentence is lower-cased and every run of other characters than a-z
and 0-9 becomes a space. SENTENCES name what a sentence holds, in the order of the places, and it may go
on after that; the names of a text's sentences, in order, are its sequence. RULES are tried in order: a
rule takes each place of the sequence where its names follow one another, gives its licence, and what it
took is closed to later rules.

No pattern looks around itself, so that the SQL is the same table in another engine's functions.

Null and empty texts have no sentences; repeated rows and rows without doc_id are each reported; an empty
table gives none; texts are read whole; other columns are not looked at; no row leaves its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GNU, _LATER = r"gnu {}general public license", r"(?:either )?version {} of the license or (?:at your option )?any later version"
_FSF = r"(?:it under )?the terms of the {} as published by the free software foundation (?:either )?"
_UNDER = r"(?:licensed|released|distributed|available) under (?:the terms of )?the {}(?: as published by the free software foundation)?(?: license)? v(?:ersion )?{}(?: 0)?"
_OR_LATER = r" or (?:at your option )?(?:any )?(?:later|newer|higher)"
_SPDX = r"spdx license identifier (?:[a-z0-9 ]+ (?:or|and) )?{}(?: (?:or|and|with) [a-z0-9 ]+)?$"


def _gnu() -> list[tuple[str, str]]:
    """The GNU family: headers (this version or a later one, this version) and lines."""
    out = []
    for name, kind, versions in (("gpl", "", ("2", "3")), ("lgpl", "lesser ", ("2 1", "3")), ("agpl", "affero ", ("3",))):
        for v in versions:
            who, n = _GNU.format(kind), f"{name}{v.replace(' ', '_')}"
            out += [(f"{n}_later", _FSF.format(who) + _LATER.format(v)), (f"{n}_line_later", _UNDER.format(who, v) + _OR_LATER), (f"{n}_line", _UNDER.format(who, v))]
    return out


#: SPDX identifiers, normalised, and the licences that they are.
IDENTIFIERS = [
    ("apache 2 0", "Apache-2.0"), ("mit", "MIT"), ("gpl 2 0(?: only)?", "GPL-2.0-only"), ("gpl 2 0 or later", "GPL-2.0-or-later"), ("gpl 3 0(?: only| or later)?", "GPL-3.0"), ("lgpl 2 1(?: only| or later)?", "LGPL-2.1"),
    ("lgpl 3 0(?: only| or later)?", "LGPL-3.0"), ("agpl 3 0(?: only| or later)?", "AGPL-3.0"), ("bsd 2 clause", "BSD-2-Clause"), ("bsd 3 clause", "BSD-3-Clause"), ("0bsd", "0BSD"), ("isc", "ISC"), ("mpl 2 0", "MPL-2.0"),
    ("epl 2 0", "EPL-2.0"), ("cc0 1 0", "CC0-1.0"), ("unlicense", "Unlicense"), ("zlib", "Zlib"), ("bsl 1 0", "BSL-1.0"),
]
#: Known licence sentences after normalisation.
SENTENCES = [
    ("apache2", r"(?:licensed|licenses this file to you) under the apache license (?:version )?2 0"),
    ("apache2_comply", r"you may not use this file except in compliance with the license"),
    ("apache2_copy", r"you may obtain a copy of the license at( https?)? (www )?apache org licenses license 2 0"),
    ("apache2_asis", r"software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache2_limits", r"see the license for the specific language governing permissions and limitations under the license"),
    *_gnu(),
    ("gpl_nowarranty", r"in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl_details", r"see the gnu (?:lesser |affero )?general public license for more details"),
    ("mit_line", r"(released|licensed|distributed) under the mit license"),
    ("mit_grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit_notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit_asis", r"the software is provided as is without warranty of any kind"),
    ("bsd_grant", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd_source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd_binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd_endorse", r"neither the name of .* may be used to endorse or promote products derived from this software"),
    ("bsd_line", r"(released|licensed|distributed) under the bsd license"),
    ("isc_grant", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("isc_notice", r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsl_grant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsl_line", r"(?:licensed|distributed) under the boost software license version 1 0"),
    ("zlib_asis", r"this software is provided as is without any express or implied warranty"),
    ("zlib_grant", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("unlicense_domain", r"this is free and unencumbered software released into the public domain"),
    ("cc0_waiver", r"to the extent possible under law .* (?:waived|dedicated) all copyright and related (?:or|and) neighboring rights"),
    ("cc0_line", r"(?:licensed|released) under (?:the )?(?:cc0|creative commons zero)(?: 1 0)?(?: universal)?"),
    ("cc_by_nc_sa", r"licensed under cc by nc sa 4 0"),
    ("cc_by_nc_nd", r"licensed under cc by nc nd 4 0"),
    ("cc_by_nc", r"licensed under cc by nc 4 0"),
    ("cc_by_sa", r"licensed under cc by sa 4 0"),
    ("cc_by", r"licensed under cc by 4 0"),
    ("mpl2_line", r"subject to the terms of the mozilla public license v(ersion)? 2 0"),
    ("epl2_line", r"(?:made )?available under the terms of the eclipse public license (?:v(?:ersion)? )?2 0"),
    *((f"spdx_{k}", _SPDX.format(form)) for k, (form, _) in enumerate(IDENTIFIERS)),
    ("reserved", r"all rights reserved"),
]
#: What a longer form at the same place stands for: the shorter one is not named beside it.
LONGER = {n: n + "_later" for n, _ in SENTENCES if n.endswith("_line") and (n + "_later") in dict(SENTENCES)}
KNOWN = [(name, f"(?:^| ){form}(?: |$)") for name, form in SENTENCES]


def _rules() -> list[tuple[str, list[str]]]:
    """Sequences of sentences and the licences that they are, the first rule first; longer ones come before their parts."""
    gnu = [("GPL-2.0", "gpl2"), ("GPL-3.0", "gpl3"), ("LGPL-2.1", "lgpl2_1"), ("LGPL-3.0", "lgpl3"), ("AGPL-3.0", "agpl3")]
    out = [
        ("Apache-2.0", ["apache2", "apache2_comply", "apache2_copy", "apache2_asis", "apache2_limits"]), ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]), ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
        ("MIT", ["mit_grant", "mit_notice", "mit_asis"]), ("Zlib", ["zlib_asis", "zlib_grant"]),
    ]
    out += [(f"{lic}-or-later", [f"{n}_later", "gpl_nowarranty", "gpl_details"]) for lic, n in gnu]
    # Apache's words are other licences' too: only the address or the name tells
    out += [("Apache-2.0", ["apache2", "apache2_comply", "apache2_copy"]), ("Apache-2.0", ["apache2_comply", "apache2_copy", "apache2_asis", "apache2_limits"]), ("Apache-2.0", ["apache2_comply", "apache2_copy"]), ("Apache-2.0", ["apache2_copy"])]
    out += [(f"{lic}-or-later", [f"{n}_later"]) for lic, n in gnu] + [("Apache-2.0", ["apache2"])] + [(f"{lic}-or-later", [f"{n}_line_later"]) for lic, n in gnu] + [(f"{lic}-only", [f"{n}_line"]) for lic, n in gnu]
    out += [
        ("MIT", ["mit_line"]), ("MIT", ["mit_grant"]), ("BSD", ["bsd_line"]), ("ISC", ["isc_grant", "isc_notice"]), ("0BSD", ["isc_grant"]), ("BSL-1.0", ["bsl_grant"]), ("BSL-1.0", ["bsl_line"]), ("Zlib", ["zlib_grant"]), ("Unlicense", ["unlicense_domain"]),
        ("CC0-1.0", ["cc0_waiver"]), ("CC0-1.0", ["cc0_line"]), ("CC-BY-NC-SA-4.0", ["cc_by_nc_sa"]), ("CC-BY-NC-ND-4.0", ["cc_by_nc_nd"]), ("CC-BY-NC-4.0", ["cc_by_nc"]), ("CC-BY-SA-4.0", ["cc_by_sa"]), ("CC-BY-4.0", ["cc_by"]),
        ("MPL-2.0", ["mpl2_line"]), ("EPL-2.0", ["epl2_line"]),
    ]
    return out + [(lic, [f"spdx_{k}"]) for k, (_, lic) in enumerate(IDENTIFIERS)]


RULES = _rules()
#: Each known sentence has one of these in it, so texts without any are not split.
HINTS = ("licen", "permission", "copyright", "redistribution", "warrant", "reserved", "endorse", "cc0", "unencumbered")
#: What is taken out before the split: an SPDX tag ends with its line or comment, a version's or an initial's point and the line before an address end nothing.
BEFORE = [
    (r"(?i)(spdx-license-identifier:[^\r\n]*?)(?:\*/|-->|\r\n?|\n)", "{0}1\n\n"),
    (r"\b([Vv](?:er)?)\.(\s*\d)", "{0}1{0}2"),
    (r"\b([A-Z])\.(\s)", "{0}1{0}2"),
    (r"\b(at[\s:]{{0,8}})\n[ \t\r#/*;-]*\n", "{0}1 "),
]
SPLIT = r"[.!?]+[^A-Za-z0-9\s]*(?:\s+|$)|\n\s*\n"


def _normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def _names(sentence: Column) -> Column:
    """What a sentence holds, by place."""
    at = {name: F.regexp_instr(sentence, F.lit(known)) for name, known in KNOWN}
    at |= {name: F.when(at[longer] == at[name], 0).otherwise(at[name]) for name, longer in LONGER.items()}
    found = F.array(*(F.struct(at[name].alias("at"), F.lit(k).alias("k"), F.lit(name).alias("what")) for k, (name, _) in enumerate(KNOWN)))
    return F.transform(F.array_sort(F.filter(found, lambda x: x.at > 0)), lambda x: x.what)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_known (known sentences), sentences (their names, comma-joined), licenses (of the rules, in their order, comma-joined), n_open (names that no rule took)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    hinted = None
    for h in HINTS:
        hinted = low.contains(h) if hinted is None else hinted | low.contains(h)
    for form, put in BEFORE:
        text = F.regexp_replace(text, form.replace("{{", "{").replace("}}", "}"), put.format("$"))
    held = F.filter(F.transform(F.split(text, SPLIT, -1), _normalised), lambda s: s.rlike("|".join(HINTS)))
    names = F.flatten(F.transform(held, _names))
    named = docs.select("doc_id", F.when(hinted, names).otherwise(F.array().cast("array<string>")).alias("names"))
    # a sequence is ;a;;b; so that a rule's names have bounds of their own
    seq = F.concat_ws("", F.transform("names", lambda n: F.concat(F.lit(";"), n, F.lit(";"))))
    rules = F.array(*(F.struct(F.lit(lic).alias("lic"), F.lit("".join(f";{n};" for n in ns)).alias("seq")) for lic, ns in RULES))
    start = F.struct(seq.alias("left"), F.array().cast("array<string>").alias("found"))
    step = lambda acc, r: F.struct(F.replace(acc.left, r.seq, F.lit("#")).alias("left"), F.when(acc.left.contains(r.seq), F.array_append(acc.found, r.lic)).otherwise(acc.found).alias("found"))
    done = named.select("doc_id", "names", F.when(F.size("names") > 0, F.aggregate(rules, start, step)).otherwise(start).alias("done"))
    taken = F.length(F.col("done.left")) - F.length(F.replace(F.col("done.left"), F.lit(";"), F.lit("")))
    return done.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.size("names").cast("long").alias("n_known"), F.concat_ws(",", "names").alias("sentences"),
        F.concat_ws(",", F.array_distinct("done.found")).alias("licenses"), (taken / 2).cast("long").alias("n_open"),
    )


def sql(table: str = "documents") -> str:
    """The same in DuckDB's SQL, where a place is one past the length of what stands before the match."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    place = lambda known: f"CASE WHEN regexp_matches(s, {quote(known)}) THEN 1 + length(regexp_extract(s, {quote('^(.*?)' + known)}, 1)) ELSE 0 END"
    forms = dict(KNOWN)
    at = {n: place(f) for n, f in KNOWN}
    at |= {n: f"CASE WHEN {place(forms[longer])} = {at[n]} THEN 0 ELSE {at[n]} END" for n, longer in LONGER.items()}
    found = ", ".join(f"{{'at': {at[n]}, 'k': {k}, 'what': '{n}'}}" for k, (n, _) in enumerate(KNOWN))
    text = "t"
    for form, put in BEFORE:
        text = f"regexp_replace({text}, {quote(form.replace('{{', '{').replace('}}', '}'))}, E'{put.format(chr(92) * 2)}', 'g')".replace("\n", "\\n")
    hints = " OR ".join(f"contains(lower(t), '{h}')" for h in HINTS)
    held = f"list_filter(list_transform(string_split_regex({text}, {quote(SPLIT)}), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda s: regexp_matches(s, '{'|'.join(HINTS)}'))"
    parts = [
        f"r AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM {table})",
        f"n AS (SELECT r, doc_id, CASE WHEN {hints} THEN flatten(list_transform({held}, lambda s: list_transform(list_sort(list_filter([{found}], lambda x: x.at > 0)), lambda x: x.what))) ELSE [] END AS names FROM r)",
        "q0 AS (SELECT doc_id, names, list_aggregate(list_transform(names, lambda x: ';' || x || ';'), 'string_agg', '') AS s, []::VARCHAR[] AS f FROM n)",
    ]
    for k, (lic, ns) in enumerate(RULES):
        seq = "".join(f";{x};" for x in ns)
        parts.append(f"q{k + 1} AS (SELECT doc_id, names, replace(s, '{seq}', '#') AS s, CASE WHEN contains(s, '{seq}') AND NOT list_contains(f, '{lic}') THEN list_append(f, '{lic}') ELSE f END AS f FROM q{k})")
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, len(names)::BIGINT AS n_known, coalesce(array_to_string(names, ','), '') AS sentences, coalesce(array_to_string(f, ','), '') AS licenses, "
        f"coalesce((length(s) - length(replace(s, ';', ''))) // 2, 0)::BIGINT AS n_open FROM q{len(RULES)}"
    )
