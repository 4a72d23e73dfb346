"""License scans with ordered signature rules, in DataFrame functions alone.

Texts are lower-cased and searched for a few keywords; only those that hold one go on. Each rule has a keyword that all
its matches hold, and only where the text holds that is its pattern tried, on the words of the text with single spaces between them.
Every match is an interval with its rule's priority. An interval inside one of the same or a higher priority is
suppressed, so that a grant of a license hides the bare name in it, and what is left gives labels and a score.

Base phrases are found beside the rules and always keep their labels.

Rows: a null or empty text has no words, labels or score; repeated rows are scanned alike; a null doc_id is kept; an
empty table gives an empty result; other columns of any name are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: Phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Priorities: what a text says at length outranks a grant, a grant an identifier, and that a name.
NOTICE, GRANT, IDENTIFIER, NAME = 4, 3, 2, 1
CONFIDENCE = {NOTICE: 1.0, GRANT: 0.9, IDENTIFIER: 0.85, NAME: 0.7}


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: str
    pattern: str


#: label, with -short and more for names that share no keyword with its others: (keyword, pattern of its names, pattern of
#: its SPDX identifiers or None), over lower-case words.
FAMILIES = {
    "mit": ("mit", r"(?:the )?mit(?: x11| expat)?", r"mit(?: 0| modern variant)?"),
    "mit-short-expat": ("expat", r"(?:the )?expat(?: x11| expat)?", None),
    "mit-short-x11": ("x11", r"(?:the )?x11(?: x11| expat)?", None),
    "apache": ("apache", r"(?:the )?apache(?: software)?(?: public)?(?: license| licence)?(?: v(?:ersion)? ?)?(?: ?[12](?: [01])?)?", r"apache [12] [01]"),
    "gpl": ("general public", r"(?:the )?(?:gnu )?general public(?: license| licence)?(?: v(?:ersion)? ?)?(?: ?[123](?: 0)?)?", r"gpl [123] 0(?: only| or later)?"),
    "gpl-short": ("gpl", r"(?:the )?(?:gnu )?gpl ?v? ?[123]?(?: 0)?", r"gplv[123]"),
    "lgpl": ("general public", r"(?:the )?(?:gnu )?(?:lesser|library) general public(?: license| licence)?(?: v(?:ersion)? ?)?(?: ?[23](?: [01])?)?", r"lgpl [23] [01](?: only| or later)?"),
    "lgpl-short": ("lgpl", r"(?:the )?(?:gnu )?lgpl ?v? ?[23]?(?: [01])?", r"lgplv[23]"),
    "agpl": ("affero", r"(?:the )?(?:gnu )?affero general public(?: license| licence)?(?: v(?:ersion)? ?)?(?: ?[13](?: 0)?)?", r"agpl [13] 0(?: only| or later)?"),
    "agpl-short": ("agpl", r"(?:the )?(?:gnu )?agpl ?v? ?3?(?: 0)?", r"agplv3"),
    "bsd": ("bsd", r"(?:the )?(?:new |modified |simplified |revised |original |free )?bsd(?: (?:[0-4]|two|three|four) clause)?", r"bsd [0-4] clause(?: patent| clear| views| lbnl)?"),
    "mpl": ("mozilla public", r"(?:the )?mozilla public(?: license| licence)?(?: v(?:ersion)? ?)?(?: ?[12](?: [01])?)?", r"mpl [12] [01](?: no copyleft exception)?"),
    "epl": ("eclipse public", r"(?:the )?eclipse public(?: license| licence)?(?: v(?:ersion)? ?)?(?: ?[12](?: 0)?)?", r"epl [12] 0"),
    "edl": ("eclipse distribution", r"(?:the )?eclipse distribution(?: license| licence)?(?: v(?:ersion)? ?)?(?: ?1(?: 0)?)?", r"edl 1 0"),
    "cddl": ("common development and distribution", r"(?:the )?common development and distribution(?: license| licence)?(?: v(?:ersion)? ?)?(?: ?1(?: [01])?)?", r"cddl 1 [01]"),
    "cpl": ("common public", r"(?:the )?common public(?: license| licence)?(?: v(?:ersion)? ?)?(?: ?1(?: 0)?)?", r"cpl 1 0"),
    "isc": ("isc", r"(?:the )?isc", r"isc"),
    "zlib": ("zlib", r"(?:the )?zlib(?: libpng)?", r"zlib(?: acknowledgement)?"),
    "boost": ("boost software", r"(?:the )?boost software(?: license| licence)?(?: v(?:ersion)? ?)?(?: ?1(?: 0)?)?", r"bsl 1 0"),
    "artistic": ("artistic", r"(?:the )?(?:perl )?artistic(?: license| licence)?(?: v(?:ersion)? ?)?(?: ?[12](?: 0)?)?", r"artistic [12] 0(?: perl| cl8)?"),
    "unlicense": ("unlicense", r"(?:the )?unlicense", r"unlicense"),
    "wtfpl": ("wtfpl", r"(?:the )?wtfpl(?: v(?:ersion)? ?)?(?: ?[12])?", r"wtfpl"),
    "cc0": ("cc0", r"(?:the )?(?:creative commons )?cc0(?: 1 0)?(?: universal)?", r"cc0 1 0"),
    "cc-by-sa": ("commons", r"(?:the )?(?:creative commons )(?:attribution|by) ?(?:share ?alike|sa)(?: [1234] [05])?", r"cc by sa [1234] [05]"),
    "cc-by-nc": ("commons", r"(?:the )?(?:creative commons )(?:attribution|by) ?(?:non ?commercial|nc)(?: ?(?:share ?alike|sa|no ?deriv(?:ative)?s|nd))?(?: [1234] [05])?", r"cc by nc(?: sa| nd)? [1234] [05]"),
    "cc-by-nd": ("commons", r"(?:the )?(?:creative commons )(?:attribution|by) ?(?:no ?deriv(?:ative)?s|nd)(?: [1234] [05])?", r"cc by nd [1234] [05]"),
    "cc-by": ("commons", r"(?:the )?(?:creative commons )(?:attribution|by)(?: [1234] [05])?(?: international| unported| generic)?", r"cc by [1234] [05]"),
    "gfdl": ("free documentation", r"(?:the )?(?:gnu )?free documentation(?: license| licence)?(?: v(?:ersion)? ?)?(?: ?1(?: [123])?)?", r"gfdl 1 [123](?: only| or later)?"),
    "ofl": ("open font", r"(?:the )?(?:sil )?open font(?: license| licence)?(?: v(?:ersion)? ?)?(?: ?1(?: [01])?)?", r"ofl 1 [01]"),
    "python": ("python software foundation", r"(?:the )?python software foundation(?: license| licence)?(?: agreement)?(?: v(?:ersion)? ?)?(?: ?2)?", r"(?:psf|python) 2 0"),
    "python-short": ("psf", r"(?:the )?psf(?: license| licence)?(?: agreement)?(?: v(?:ersion)? ?)?(?: ?2)?", None),
    "ruby": ("ruby", r"(?:the )?ruby", r"ruby"),
    "php": ("php", r"(?:the )?php(?: license| licence)?(?: v(?:ersion)? ?)?(?: ?3(?: 0| 01)?)?", r"php 3 0?1?"),
    "postgresql": ("postgresql", r"(?:the )?postgresql", r"postgresql"),
    "openssl": ("openssl", r"(?:the )?openssl(?: and ssleay)?", r"openssl"),
    "openldap": ("openldap", r"(?:the )?openldap public", r"oldap 2 [0-8](?: [12])?"),
    "ms-pl": ("microsoft public", r"(?:the )?microsoft public", r"ms pl"),
    "ms-rl": ("microsoft reciprocal", r"(?:the )?microsoft reciprocal", r"ms rl"),
    "eupl": ("european union public", r"(?:the )?european union public(?: license| licence)?(?: v(?:ersion)? ?)?(?: ?1(?: [012])?)?", r"eupl 1 [012]"),
    "osl": ("open software", r"(?:the )?open software(?: license| licence)(?: v(?:ersion)? ?)?(?: ?[123](?: [01])?)?", r"osl [123] [01]"),
    "afl": ("academic free", r"(?:the )?academic free(?: license| licence)?(?: v(?:ersion)? ?)?(?: ?[123](?: [012])?)?", r"afl [123] [012]"),
    "ecl": ("educational community", r"(?:the )?educational community(?: license| licence)?(?: v(?:ersion)? ?)?(?: ?[12](?: 0)?)?", r"ecl [12] 0"),
    "ncsa": ("ncsa", r"(?:the )?(?:university of illinois )?ncsa(?: open source)?", r"ncsa"),
    "qpl": ("q public", r"(?:the )?q public(?: license| licence)?(?: v(?:ersion)? ?)?(?: ?1(?: 0)?)?", r"qpl 1 0"),
    "sleepycat": ("sleepycat", r"(?:the )?sleepycat", r"sleepycat"),
    "w3c": ("w3c", r"(?:the )?w3c(?: software)?(?: notice and)?", r"w3c(?: 19980720| 20150513)?"),
    "zpl": ("zope public", r"(?:the )?zope public(?: license| licence)?(?: v(?:ersion)? ?)?(?: ?[12](?: [01])?)?", r"zpl [12] [01]"),
    "apsl": ("apple public source", r"(?:the )?apple public source(?: license| licence)?(?: v(?:ersion)? ?)?(?: ?[12](?: [0-2])?)?", r"apsl [12] [0-2]"),
    "ibmpl": ("ibm public", r"(?:the )?ibm public(?: license| licence)?(?: v(?:ersion)? ?)?(?: ?1(?: 0)?)?", r"ipl 1 0"),
    "lppl": ("latex project public", r"(?:the )?latex project public(?: license| licence)?(?: v(?:ersion)? ?)?(?: ?1(?: [0-3])?)?", r"lppl 1 [0-3]c?"),
    "cecill": ("cecill", r"(?:the )?cecill(?: [bc])?(?: license| licence)?(?: v(?:ersion)? ?)?(?: ?[12](?: [01])?)?", r"cecill (?:[bc]|[12] [01])"),
    "upl": ("universal permissive", r"(?:the )?universal permissive", r"upl 1 0"),
    "blueoak": ("blue oak", r"(?:the )?blue oak model", r"blueoak 1 0 0"),
    "mulan": ("mulan", r"(?:the )?mulan (?:psl|permissive software)(?: license| licence)?(?: v ?[12])?", r"mulanpsl [12] 0"),
    "sspl": ("server side public", r"(?:the )?server side public", r"sspl 1 0"),
    "elastic": ("elastic", r"(?:the )?elastic(?: license| licence)(?: v(?:ersion)? ?)?(?: ?2(?: 0)?)?", r"elastic 2 0"),
    "busl": ("business source", r"(?:the )?business source", r"busl 1 1"),
    "polyform": ("polyform", r"(?:the )?polyform (?:noncommercial|small business|free trial|internal use|perimeter|shield|strict)", r"polyform (?:noncommercial|small business) 1 0 0"),
    "odbl": ("open database", r"(?:the )?open database", r"odbl 1 0"),
    "odc-by": ("open data commons", r"(?:the )?open data commons(?: attribution)?", r"odc by 1 0"),
    "pddl": ("public domain dedication", r"(?:the )?public domain dedication(?: and)?", r"pddl 1 0"),
}

_LICENSE = r"(?: (?:open source )?(?:licen[sc]es?|terms|conditions))?"
#: (priority, what stands around a name): the ways to speak of a license.
FORMS = [
    (NAME, r"{name} licen[sc]e"),
    (GRANT, r"(?:dual )?licen[sc]ed (?:to you |solely |only )?(?:under|by|with|according to)(?: the)?(?: (?:terms|conditions)(?: and conditions)? of)? {name}" + _LICENSE),
    (GRANT, r"(?:released|distributed|available|published|provided|shared|offered|redistribute it(?: and or modify it)?) (?:to you )?under(?: the)?(?: (?:terms|conditions)(?: and conditions)? of)? {name}" + _LICENSE),
    (GRANT, r"(?:governed by|subject to|covered by|use of this (?:software|source code|file) is governed by)(?: the)?(?: (?:terms|conditions)(?: and conditions)? of)? {name}" + _LICENSE),
]

#: Notices that say a license at length.
NOTICES = [
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "substantial portions", r"shall be included in all copies or substantial portions of the software"),
    ("mit", "without restriction", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute"),
    ("isc", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "neither the name", r"neither the name of .{1,80}? nor the names of (?:its|any) contributors may be used to endorse or promote products"),
    ("bsd", "all advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledg"),
    ("apache", "you may not use this file", r"you may not use this file except in compliance with the license"),
    ("apache", "apache org licenses", r"(?:https? )?(?:www )?apache org licenses license 2 0"),
    ("apache", "perpetual worldwide", r"grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent)? ?license"),
    ("apache", "apache software foundation", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("gpl", "free software you can redistribute", r"(?:is|are) free software you can redistribute (?:it|them) and or modify (?:it|them) under the terms of the gnu general public license"),
    ("gpl", "received a copy of the gnu general", r"received a copy of the gnu general public license along with"),
    ("gpl", "either version", r"general public license as published by the free software foundation either version [123]"),
    ("lgpl", "received a copy of the gnu", r"received a copy of the gnu (?:lesser|library) general public license along with"),
    ("lgpl", "general public license as published by", r"under the terms of the gnu (?:lesser|library) general public license as published by"),
    ("agpl", "gnu affero general", r"under the terms of the gnu affero general public license as published by"),
    ("mpl", "mozilla public license v", r"subject to the terms of the mozilla public license v(?:ersion)? ?[12] [01]"),
    ("mpl", "mozilla org mpl", r"(?:https? )?(?:www )?mozilla org mpl(?: 2 0)?"),
    ("epl", "eclipse org", r"(?:https? )?(?:www )?eclipse org (?:legal|org documents) epl"),
    ("zlib", "provided as is without any express", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "must not be misrepresented", r"the origin of this software must not be misrepresented"),
    ("boost", "boost org license", r"(?:https? )?(?:www )?boost org license 1 0"),
    ("boost", "accompanying documentation covered by this license", r"copy of the software and accompanying documentation covered by this license"),
    ("unlicense", "released into the public domain", r"free and unencumbered software released into the public domain"),
    ("wtfpl", "do what the fuck", r"do what the fuck you want to public license"),
    ("cc0", "creativecommons org publicdomain", r"(?:https? )?creativecommons org publicdomain zero 1 0"),
    ("cc-by", "creativecommons org licenses by", r"(?:https? )?creativecommons org licenses by [1234] [05]"),
    ("cc-by-sa", "creativecommons org licenses by sa", r"(?:https? )?creativecommons org licenses by sa [1234] [05]"),
    ("cc-by-nc", "creativecommons org licenses by nc", r"(?:https? )?creativecommons org licenses by nc(?: sa| nd)? [1234] [05]"),
    ("cc-by-nd", "creativecommons org licenses by nd", r"(?:https? )?creativecommons org licenses by nd [1234] [05]"),
    ("gfdl", "permission is granted to copy", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("ofl", "scripts sil org ofl", r"(?:https? )?scripts sil org ofl"),
    ("artistic", "copyright holder maintains", r"the copyright holder maintains some semblance of artistic control"),
    ("postgresql", "postgresql global development", r"portions copyright .{1,40}? postgresql global development group"),
    ("openssl", "openssl toolkit", r"software developed by the openssl project for use in the openssl toolkit"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
    ("proprietary", "confidential and proprietary", r"confidential and proprietary(?: information)?"),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this file via any medium is strictly prohibited"),
]


def rules() -> list[Rule]:
    """In order: notices, then each family's identifiers, grants and names."""
    out = [Rule(label, NOTICE if label != "proprietary" else NAME, keyword, pattern) for label, keyword, pattern in NOTICES]
    for key, (keyword, name, spdx) in FAMILIES.items():
        label = key.partition("-short")[0]
        if spdx:
            out.append(Rule(label, IDENTIFIER, "spdx", rf"spdx license identifier (?:{spdx})"))
        for priority, form in FORMS:
            out.append(Rule(label, priority, keyword, form.replace("{name}", f"(?:{name})")))
    return out


#: A text without any of these words can't match a rule.
GATE = ["licen", "spdx", "copyright", "copies", "redistribut", "permission", "restriction", "domain", "neither", "advertising", "perpetual", "misrepresented", "warranty", "documentation", "artistic", "openssl", "rights", "proprietary", "unauthorized", "released", "distributed", "available", "published", "provided", "shared", "offered", "governed", "subject", "covered", "mozilla", "eclipse", "creativecommons", "scripts"]


def _phrase(phrase: str) -> str:
    return rf"(?<!{WORD})" + rf"{SEPARATOR}+".join(phrase.split(" ")) + rf"(?!{WORD})"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _detections(norm: Column, found: Column) -> Column:
    """The intervals of the rules whose keyword the text holds."""

    def intervals(rule: Column) -> Column:
        pattern = F.concat(F.lit("(?<![^ ])(?:"), rule["pattern"], F.lit(")(?![^ ])"))
        between = F.split(norm, pattern)
        matched = F.regexp_extract_all(norm, F.concat(F.lit("("), pattern, F.lit(")")), F.lit(1))
        # lengths of what lies before each match, added up
        walked = F.aggregate(
            F.arrays_zip(F.slice(between, F.lit(1), F.size(matched)).alias("gap"), matched.alias("match")),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("all")),
            lambda acc, x: F.struct(
                (acc["at"] + F.length(x["gap"]) + F.length(x["match"])).alias("at"),
                F.array_append(acc["all"], F.struct((acc["at"] + F.length(x["gap"])).alias("start"), (acc["at"] + F.length(x["gap"]) + F.length(x["match"])).alias("end"))).alias("all"),
            ),
        )
        return F.transform(walked["all"], lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), (-rule["priority"]).alias("rank"), rule["label"].alias("label")))

    return F.flatten(F.transform(F.filter(found, lambda r: F.contains(norm, r["keyword"])), intervals))


def _kept(detections: Column) -> Column:
    """(labels, best priority) of the intervals that no other of their or a higher priority contains.

    In the order of start, longest first, one is contained exactly if the furthest end so far, of its priority or a
    higher one, reaches its own.
    """
    levels = [NAME, IDENTIFIER, GRANT, NOTICE]
    start = F.struct(*[F.lit(-1).alias(f"end{p}") for p in levels], F.array().cast("array<string>").alias("labels"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        end, priority = -x["back"], -x["rank"]
        reach = F.greatest(*[F.when(F.lit(p) >= priority, acc[f"end{p}"]).otherwise(F.lit(-1)) for p in levels])
        hidden = reach >= end
        ends = [F.when(priority == p, F.greatest(acc[f"end{p}"], end)).otherwise(acc[f"end{p}"]).alias(f"end{p}") for p in levels]
        return F.struct(*ends, F.when(hidden, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(x["label"]))).alias("labels"), F.when(hidden, acc["best"]).otherwise(F.greatest(acc["best"], priority)).alias("best"))

    return F.aggregate(F.array_sort(detections), start, step)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    table = F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern")) for r in rules()])
    rows = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low")).withColumn("n_words", _count(F.col("low"), f"{WORD}+"))
    low = F.col("low")
    places, firsts, lasts, names = [], [], [], []
    for phrase, label in BASE.items():
        pattern = _phrase(phrase)
        parts = F.split(low, pattern)
        here = F.contains(low, F.lit("license")) & F.contains(low, F.lit(phrase.split(" ")[0]))
        n = F.when(here, _count(low, pattern)).otherwise(F.lit(0))
        places.append(n)
        firsts.append(F.when(n > 0, _count(F.element_at(parts, 1), f"{WORD}+")))
        lasts.append(F.when(n > 0, F.col("n_words") - _count(F.element_at(parts, -1), f"{WORD}+") - len(phrase.split(" "))))
        names.append(F.when(n > 0, F.lit(label)))
    total = places[0] + places[1] + places[2]
    base = F.array_sort(F.array_compact(F.array(*names)))
    gated = F.contains(low, F.lit(GATE[0]))
    for keyword in GATE[1:]:
        gated = gated | F.contains(low, F.lit(keyword))
    rows = rows.select("doc_id", "n_words", "low", total.alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"), base.alias("base"), gated.alias("gated"))
    norm = F.trim(F.regexp_replace("low", f"{SEPARATOR}+", " "))
    rows = rows.withColumn("norm", F.when(F.col("gated"), norm))
    kept = F.when(F.col("gated"), _kept(_detections(F.col("norm"), table)))
    rows = rows.withColumn("kept", kept)
    labels = F.array_sort(F.array_union("base", F.coalesce(F.col("kept.labels"), F.array().cast("array<string>"))))
    level = F.coalesce(F.col("kept.best"), F.lit(0))
    score = F.lit(0.0)
    for priority, value in CONFIDENCE.items():
        score = F.when(level == priority, F.lit(value)).otherwise(score)
    score = F.greatest(score, F.when(F.col("n_base") > 0, F.lit(CONFIDENCE[NAME])).otherwise(F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
