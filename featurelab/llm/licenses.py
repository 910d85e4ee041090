"""License scans by sentence rules.

A text is normalised: A-Z lower-cased, all but ASCII letters, digits and line breaks dropped
(comment marks with the rest).  Full stops and blank lines end a sentence; line breaks, colons
and semicolons may end one or lie within one, so a sentence wrapped over lines is found and one
on a line of its own too.  Numbers are replaced by a mark; what stands between two ends is a
known licence sentence or nothing, the longest where there are several.  The identifiers of
the known sentences of a text, in order, are then matched against ordered licence rules, each
a sequence of identifiers: a rule that matches adds its licence and uses up what it matched,
wherever and as often as it does, before the next rule has its turn.  Numbers come back as
versions.  The DuckDB twin ends a sentence at every line break, colon and semicolon, and knows
no third BSD clause: it is the same scan only of texts without these.

Everything is one projection over SQL functions: no join, no shuffle, no Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: licence sentences as normalised (numbers are #), with their identifiers
SENTENCES = {
    "licensed under the apache license version #": "Apache",
    "licensed under the apache license version # the license": "Apache",
    "released under the apache license version #": "Apache",
    "this project is licensed under the apache license version #": "Apache",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheCopy",
    "released under the mit license": "MIT",
    "licensed under the mit license": "MIT",
    "this project is licensed under the mit license": "MIT",
    "distributed under the mit license": "MIT",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the "
    "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions": "MITGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the software": "MITNotice",
    "this work is licensed under the gnu general public license version #": "GPL",
    "licensed under the gnu general public license version #": "GPL",
    "released under the gnu general public license version #": "GPL",
    "this work is licensed under the gnu lesser general public license version #": "LGPL",
    "licensed under the gnu lesser general public license version #": "LGPL",
    "licensed under the gnu affero general public license version #": "AGPL",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version # of the license or at your option any later "
    "version": "GPLNoticeLater",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license version # as published by the free software foundation": "GPLNotice",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied "
    "warranty of merchantability or fitness for a particular purpose": "GPLWarranty",
    "see the gnu general public license for more details": "GPLDetails",
    "licensed under cc by #": "CCBY",
    "licensed under cc by sa #": "CCBYSA",
    "licensed under cc by nc #": "CCBYNC",
    "licensed under cc by nd #": "CCBYND",
    "licensed under cc by nc sa #": "CCBYNCSA",
    "licensed under cc by nc nd #": "CCBYNCND",
    "this work is licensed under a creative commons attribution # international license": "CCBY",
    "this work is licensed under a creative commons attribution noncommercial # international license": "CCBYNC",
    "licensed under the mozilla public license version #": "MPL",
    "this source code form is subject to the terms of the mozilla public license v #": "MPL",
    "licensed under the eclipse public license version #": "EPL",
    "licensed under the bsd # clause license": "BSD",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "BSDGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following "
    "disclaimer": "BSDSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
    "disclaimer in the documentation and or other materials provided with the distribution": "BSDBinary",
    "this work is dedicated to the public domain": "PublicDomain",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "all rights reserved": "AllRights",
}
#: Ordered rules: sequence of identifiers, and the licence (a # takes the first one's version).
RULES = [
    (("GPLNoticeLater", "GPLWarranty", "GPLDetails"), "GPL-#-or-later"),
    (("GPLNotice", "GPLWarranty", "GPLDetails"), "GPL-#-only"),
    (("GPLNoticeLater",), "GPL-#-or-later"),
    (("GPLNotice",), "GPL-#-only"),
    (("MITGrant", "MITNotice"), "MIT"),
    (("MITGrant",), "MIT"),
    (("Apache", "ApacheUse", "ApacheCopy"), "Apache-#"),
    (("BSDGrant", "BSDSource", "BSDBinary"), "BSD-2-Clause"),
    (("AllRights", "BSDGrant", "BSDSource", "BSDBinary"), "BSD-2-Clause"),
    (("Apache",), "Apache-#"),
    (("MIT",), "MIT"),
    (("AGPL",), "AGPL-#"),
    (("LGPL",), "LGPL-#"),
    (("GPL",), "GPL-#"),
    (("CCBYNCND",), "CC-BY-NC-ND-#"),
    (("CCBYNCSA",), "CC-BY-NC-SA-#"),
    (("CCBYNC",), "CC-BY-NC-#"),
    (("CCBYND",), "CC-BY-ND-#"),
    (("CCBYSA",), "CC-BY-SA-#"),
    (("CCBY",), "CC-BY-#"),
    (("MPL",), "MPL-#"),
    (("EPL",), "EPL-#"),
    (("BSD",), "BSD-#-Clause"),
    (("Unlicense",), "Unlicense"),
    (("PublicDomain",), "public-domain"),
    (("AllRights",), "all-rights-reserved"),
]
RULES.sort(key=lambda r: -len(r[0]))          # longer sequences first; order kept otherwise
# fixed values: sentences and rules that the DuckDB twin does not know
MORE_SENTENCES = {
    "all advertising materials mentioning features or use of this software must display the following "
    "acknowledgement": "BSDAds",
    "neither the name of @ nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission": "BSDName",
    "neither the name of @ nor the names of their contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission": "BSDName",
    "the name of the author may not be used to endorse or promote products derived from this software without specific "
    "prior written permission": "BSDName",
}
MORE_RULES = [
    (("AllRights", "BSDGrant", "BSDSource", "BSDBinary", "BSDAds", "BSDName"), "BSD-4-Clause"),
    (("BSDGrant", "BSDSource", "BSDBinary", "BSDAds", "BSDName"), "BSD-4-Clause"),
    (("AllRights", "BSDGrant", "BSDSource", "BSDBinary", "BSDName"), "BSD-3-Clause"),
    (("BSDGrant", "BSDSource", "BSDBinary", "BSDName"), "BSD-3-Clause"),
]
NAME = r"[a-z0-9]+(?:[ \n]{1,2}[a-z0-9]+){0,19}?\n?"   # what @ stands for: a holder of up to 20 words, as in "Foo Inc. nor"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _pattern(ids: tuple[str, ...]) -> str:
    """A rule as a pattern over identifiers written ``<name:version>``; group 1 is the version."""
    return f"<{ids[0]}:([0-9.]*)>" + "".join(f"<{i}:[0-9.]*>" for i in ids[1:])


def sentences(text: Column) -> Column:
    """Known sentences in order, on one line each, numbers still in place."""
    s = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    for pattern, to in ((r"\r\n?", "\n"), (r"[.!?][ \t\n]+", "\n\n"), (r"[;:][ \t\n]+", "\n"),
                        (r"[^a-z0-9\n]+", " "), (r" ?\n ?", "\n")):
        s = F.regexp_replace(s, pattern, to)
    every = sorted([*SENTENCES, *MORE_SENTENCES], key=lambda k: (-len(k), k))
    known = "|".join(k.replace(" ", r"[ \n]").replace(r"]v[ \n]#", r"]v[ \n]{1,2}#").replace("#", "[0-9][0-9 ]*").replace("@", NAME) for k in every)
    return F.transform(F.regexp_extract_all(F.trim(s), F.lit(f"(?m)^(?:{known})$"), 0), lambda x: F.regexp_replace(x, r"\n+", " "))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses, unmatched) for every row of ``docs``.

    n_sentences counts known sentences, sentence_ids lists them in order as
    ``<identifier:version>``, licenses (comma-joined) the licences in the order of the rules,
    each once per match in text order, unmatched what no rule used.  A null or empty text gives
    0 and empty strings; null ids and repeated rows stay; other columns are not read; no rows
    give none.
    """
    known = F.create_map(*[F.lit(x) for kv in (SENTENCES | MORE_SENTENCES).items() for x in kv])
    ids = F.transform(sentences(F.col(text_col)), lambda s: F.struct(
        F.try_element_at(known, F.regexp_replace(F.regexp_replace(s, "^(neither the name of ).*?( nor the names)", "$1@$2"),
                                                 "[0-9]([0-9 ]*[0-9])?", "#")).alias("id"),
        F.translate(F.rtrim(F.regexp_extract(s, "[0-9][0-9 ]*", 0)), " ", ".").alias("version")))
    ids = F.filter(ids, lambda x: x["id"].isNotNull())
    ids = F.array_join(F.transform(ids, lambda x: F.concat(F.lit("<"), x["id"], F.lit(":"), x["version"], F.lit(">"))), "")
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), ids.alias("sentence_ids"))
    out = out.withColumn("rest", F.col("sentence_ids")).withColumn("found", F.array().cast("array<string>"))

    def rule(df: DataFrame, r) -> DataFrame:
        p, (before, _, after) = _pattern(r[0]), r[1].partition("#")
        versions = F.regexp_extract_all("rest", F.lit(p), 1)
        names = F.transform(versions, lambda v: F.concat(F.lit(before), v, F.lit(after))) if "#" in r[1] \
            else F.transform(versions, lambda v: F.lit(r[1]))
        hit = F.col("rest") != ""
        return df.select("doc_id", "sentence_ids",
                         F.when(hit, F.concat("found", names)).otherwise(F.col("found")).alias("found"),
                         F.when(hit, F.regexp_replace("rest", p, "|")).otherwise(F.col("rest")).alias("rest"))

    out = reduce(rule, sorted([*RULES, *MORE_RULES], key=lambda r: -len(r[0])), out)
    return out.select("doc_id", F.regexp_count("sentence_ids", F.lit("<")).cast("long").alias("n_sentences"), "sentence_ids",
                      F.array_join("found", ",").alias("licenses"),
                      F.regexp_replace("rest", r"\|", "").alias("unmatched"))


def duckdb_sql(table: str = "documents") -> str:
    """The same scan in DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in SENTENCES.items()) + "}"
    steps, prev = [], "ids"
    for i, (seq, name) in enumerate(RULES):
        p, (before, _, after) = _pattern(seq), name.partition("#")
        value = f"{quote(before)} || v || {quote(after)}" if "#" in name else quote(name)
        steps.append(f"r{i} AS (SELECT doc_id, sentence_ids, list_concat(found, list_transform(regexp_extract_all(rest, "
                     f"{quote(p)}, 1), lambda v: {value})) AS found, regexp_replace(rest, {quote(p)}, '|', 'g') AS rest FROM {prev})")
        prev = f"r{i}"
    return f"""
WITH cut AS (
  SELECT doc_id, list_transform(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
         '[.!?;:][ \\t\\r\\n]+|[\\r\\n]+'), lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))) AS parts
  FROM {table}),
looked AS (
  SELECT doc_id, list_filter(list_transform(parts, lambda s: {{
    'id': ({known})[regexp_replace(s, '[0-9]+( [0-9]+)*', '#', 'g')],
    'version': translate(regexp_extract(s, '[0-9]+( [0-9]+)*'), ' ', '.')}}), lambda x: x.id IS NOT NULL) AS hits
  FROM cut),
marked AS (
  SELECT doc_id, coalesce(array_to_string(list_transform(hits, lambda x: '<' || x.id || ':' || x.version || '>'), ''), '')
         AS sentence_ids FROM looked),
ids AS (SELECT doc_id, sentence_ids, []::VARCHAR[] AS found, sentence_ids AS rest FROM marked),
{", ".join(steps)}
SELECT doc_id, length(sentence_ids) - length(replace(sentence_ids, '<', '')) AS n_sentences, sentence_ids,
       coalesce(array_to_string(found, ','), '') AS licenses, replace(rest, '|', '') AS unmatched
FROM {prev}"""
