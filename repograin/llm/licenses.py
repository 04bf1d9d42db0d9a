"""License scans by sentence rules.

A text is cut into sentences, each sentence is normalised and mapped to the
identifier of a known license sentence, and the sequence of identifiers is
matched against ordered rules: the first rule that fits takes its identifiers
out of the sequence, and later rules see what is left. A text is read twice,
with line ends as sentence ends and as running text, since notices stand on
lines of their own or are wrapped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known license sentences, as patterns over normalised text (lower case, single spaces, no punctuation but inner dots).
SENTENCES = {
    "all_rights": r"all rights reserved",
    "apache2_as_is": r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2_comply": r"you may not use this file except in compliance with the license",
    "apache2_copy": r"you may obtain a copy of the license at .*apache.org licenses license 2.0",
    "apache2_limits": r"see the license for the specific language governing permissions and limitations under the license",
    "apache2_ref": r"(this [a-z]+ is )?(licensed|released|distributed|available) under (the )?(terms of the )?apache( software)? license( version)? (v )?2(.0)?( the license)?",
    "bsd_as_is": r"this software is provided by the (copyright holders?|author|regents)( and contributors)? as is and any express or implied warranties .* are disclaimed",
    "bsd_binary": r"([0-9]\.? )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_endorse": r"([0-9]\.? )?neither the name of .* nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_ref": r"(this [a-z]+ is )?(licensed|released|distributed|available) under (the )?(terms of the )?(3 clause |new )?bsd( 3 clause)? license",
    "bsd_source": r"(.* met )?([0-9]\.? )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_use": r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met.*",
    "cc0": r"(this [a-z]+ is )?(licensed|released|distributed|available|dedicated) (under|to) (the )?(creative commons )?cc0( 1.0)?( universal)?( license)?",
    "cc_by": r"(this [a-z]+ is )?(licensed|released|distributed|available) under (a |the )?(cc|creative commons) (by|attribution) 4.0( international)?( license)?",
    "cc_by_nc": r"(this [a-z]+ is )?(licensed|released|distributed|available) under (a |the )?(cc|creative commons) (by nc|attribution noncommercial) 4.0( international)?( license)?",
    "cc_by_sa": r"(this [a-z]+ is )?(licensed|released|distributed|available) under (a |the )?(cc|creative commons) (by sa|attribution sharealike) 4.0( international)?( license)?",
    "gpl2_later": r"(this|it|you) .*under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl2_ref": r"(this [a-z]+ is )?(licensed|released|distributed|available) under (the )?(terms of the )?gnu general public license( gpl)? (version |v )?2(.0)?",
    "gpl3_later": r"(this|it|you) .*under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl3_ref": r"(this [a-z]+ is )?(licensed|released|distributed|available) under (the )?(terms of the )?gnu general public license( gpl)? (version |v )?3(.0)?",
    "gpl_received": r"you should have received a copy of the gnu general public license along with this .*",
    "gpl_useful": r"this .* is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "mit_as_is": r"the software is provided as is without warranty of any kind express or implied .*",
    "mit_grant": r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files .*",
    "mit_notice": r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_ref": r"(this [a-z]+ is )?(licensed|released|distributed|available) under (the )?(terms of the )?(mit|expat) license",
    "mit_title": r"(the )?mit license( mit)?",
    "public_domain": r"this [a-z]+ is (in|dedicated to|released into) the public domain",
    "spdx_apache2": r"spdx license identifier apache 2.0",
    "spdx_bsd3": r"spdx license identifier bsd 3 clause",
    "spdx_gpl3": r"spdx license identifier gpl 3.0( only)?",
    "spdx_mit": r"spdx license identifier mit",
}

# Rules in the order they are tried, the longer before the shorter; a license and the sentences that follow each other.
RULES = [
    ("GPL-3.0-or-later", ("gpl3_later", "gpl_useful", "gpl_received")),
    ("GPL-2.0-or-later", ("gpl2_later", "gpl_useful", "gpl_received")),
    ("GPL-3.0-or-later", ("gpl3_later", "gpl_useful")),
    ("GPL-2.0-or-later", ("gpl2_later", "gpl_useful")),
    ("GPL-3.0-or-later", ("gpl3_later",)),
    ("GPL-2.0-or-later", ("gpl2_later",)),
    ("GPL-3.0-only", ("gpl3_ref",)),
    ("GPL-2.0-only", ("gpl2_ref",)),
    ("Apache-2.0", ("apache2_ref", "apache2_comply", "apache2_copy", "apache2_as_is", "apache2_limits")),
    ("Apache-2.0", ("apache2_ref", "apache2_comply")),
    ("Apache-2.0", ("apache2_ref",)),
    ("MIT", ("mit_title", "mit_grant", "mit_notice", "mit_as_is")),
    ("MIT", ("mit_grant", "mit_notice", "mit_as_is")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("MIT", ("mit_ref",)),
    ("MIT", ("mit_title",)),
    ("BSD-3-Clause", ("bsd_use", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_as_is")),
    ("BSD-3-Clause", ("bsd_use", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_use", "bsd_source", "bsd_binary", "bsd_as_is")),
    ("BSD-2-Clause", ("bsd_use", "bsd_source", "bsd_binary")),
    ("BSD-3-Clause", ("bsd_ref",)),
    ("CC0-1.0", ("cc0",)),
    ("CC-BY-NC-4.0", ("cc_by_nc",)),
    ("CC-BY-SA-4.0", ("cc_by_sa",)),
    ("CC-BY-4.0", ("cc_by",)),
    ("Apache-2.0", ("spdx_apache2",)),
    ("BSD-3-Clause", ("spdx_bsd3",)),
    ("GPL-3.0-only", ("spdx_gpl3",)),
    ("MIT", ("spdx_mit",)),
    ("LicenseRef-public-domain", ("public_domain",)),
    ("LicenseRef-all-rights-reserved", ("all_rights",)),
]

_HINT = r"(?i)licen[cs]e|copyright|permission|redistribut|warrant|rights\s+reserved|public\s+domain|cc0|creative|\bcc\b"  # every known sentence has one of these


def _marked(ids) -> str:
    return "".join(f"<{i}>" for i in ids)


def readings(text: Column) -> Column:
    """The sentences of the text as two arrays: line ends as sentence ends, and as running text with blank lines as ends."""
    plain = F.regexp_replace(text, "\r\n?", "\n")
    ended = F.regexp_replace(plain, "([.!?])[ \t]+", "$1\n")
    running = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "\n[ \t]*\n", "\f"), "[ \t\n]+", " "), "([.!?]) ", "$1\f")
    return F.array(F.split(ended, "\n"), F.split(running, "\f"))


def normalized(sentence: Column) -> Column:
    """Lower-case ASCII letters, digits and dots inside words; one space between words; licence is license, v2 is v 2."""
    words = F.regexp_replace(F.lower(sentence), "[^a-z0-9.]+", " ")
    words = F.trim(F.regexp_replace(F.regexp_replace(words, "\\.+( |$)", " "), " +", " "))
    return F.regexp_replace(F.regexp_replace(words, "licence", "license"), "\\bv([0-9])", "v $1")


def identifier(sentence: Column) -> Column:
    """``<id>`` of the first known sentence, by name, that the normalised sentence is; empty for others."""
    out = None
    for name in sorted(SENTENCES):
        test = sentence.rlike(f"^({SENTENCES[name]})$")
        out = F.when(test, F.lit(f"<{name}>")) if out is None else out.when(test, F.lit(f"<{name}>"))
    return out.otherwise(F.lit(""))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, license, rule, sentences`` for every license that a text names, with the first rule (from 1) that found it.

    Null and empty texts name none; sentences that are not known are passed
    over; rows that repeat a key are one document. Nothing but the found
    licenses is shuffled.
    """
    hinted = df.select(F.col(key).alias("key"), F.col(text).alias("body")).where(F.col("body").rlike(_HINT))
    read = hinted.select("key", F.explode(readings(F.col("body"))).alias("said"))
    left = read.select("key", F.array_join(F.transform(F.transform("said", normalized), identifier), "").alias("left")).where("left <> ''")
    found = []
    for number, (license_id, ids) in enumerate(RULES, 1):
        before = F.col("left")
        for _, earlier in RULES[: number - 1]:
            if set(earlier) & set(ids):
                before = F.replace(before, F.lit(_marked(earlier)), F.lit("<>"))
        found.append(F.when(F.contains(before, F.lit(_marked(ids))), F.struct(F.lit(license_id).alias("license"), F.lit(number).alias("rule"), F.lit(",".join(ids)).alias("sentences"))))
    hits = left.select("key", F.explode(F.array_compact(F.array(*found))).alias("hit"))
    best = hits.groupBy("key", "hit.license").agg(F.min(F.struct("hit.rule", "hit.sentences")).alias("best"))
    return best.select(F.col("key").alias(key), "license", "best.rule", "best.sentences")


def scan_sql(table: str = "documents") -> str:
    """The same question for an outside engine."""

    def lit(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    cases = " ".join(f"WHEN regexp_matches(s, {lit(f'^({SENTENCES[name]})$')}) THEN {lit(f'<{name}>')}" for name in sorted(SENTENCES))
    hits = []
    for number, (license_id, ids) in enumerate(RULES, 1):
        before = "left_over"
        for _, earlier in RULES[: number - 1]:
            before = f"replace({before}, {lit(_marked(earlier))}, '<>')"
        hits.append(f"SELECT doc_id, {lit(license_id)} AS license, {number}::INTEGER AS rule, {lit(','.join(ids))} AS sentences FROM i WHERE contains({before}, {lit(_marked(ids))})")
    return f"""
WITH p AS (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS body FROM {table} WHERE regexp_matches(text, {lit(_HINT)})),
r AS (
  SELECT doc_id, string_split(regexp_replace(body, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)) AS said FROM p
  UNION ALL
  SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(body, '\\n[ \\t]*\\n', chr(12), 'g'), '[ \\t\\n]+', ' ', 'g'), '([.!?]) ', '\\1' || chr(12), 'g'), chr(12)) FROM p),
n AS (
  SELECT doc_id, list_transform(said, lambda x: regexp_replace(replace(trim(regexp_replace(regexp_replace(
         regexp_replace(lower(x), '[^a-z0-9.]+', ' ', 'g'), '\\.+( |$)', ' ', 'g'), ' +', ' ', 'g')), 'licence', 'license'), '\\bv([0-9])', 'v \\1', 'g')) AS said FROM r),
i AS (SELECT doc_id, list_aggregate(list_transform(said, lambda s: CASE {cases} ELSE '' END), 'string_agg', '') AS left_over FROM n),
h AS ({' UNION ALL '.join(hits)})
SELECT doc_id, license, min(rule) AS rule, arg_min(sentences, rule) AS sentences FROM h GROUP BY doc_id, license"""
