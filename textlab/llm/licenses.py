"""License scans by ordered signature rules, in DataFrame functions alone.

A text becomes its lower-case words between single spaces.  Each rule has a
keyword, a pattern over that form, a label and its place in the order: rules
of higher priority come first.  The keyword is a name or phrase between
spaces, without which the pattern cannot match; keywords are looked up once
each, and only where a word that several share is found, and only the rules of
those found are tried.  Of the detections, one that
lies inside another of an earlier rule is suppressed.

There are two families of rules.  Signatures are written by hand from the
licenses' own texts: grants, notices, disclaimers, file headers and or-later
forms, which need not name their license.  Mentions are made from license
names and sentence forms; a mention that denies the license comes first of all
and has no label, so that it only suppresses.

Everything happens inside a row: no shuffle, no join, nothing broadcast.
Lower-casing is the engine's; it differs from that of A-Z alone only in
non-ASCII letters, which are word characters before and after, and in the
Kelvin sign, whose letter is in no base phrase.

Defined results: NULL and empty texts have no words, no detections and score
0; equal spans of several rules are the earliest rule's; a text of many matches
costs time in proportion to them; repeated rows get equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label: names, as words; the first is the one that identifier lines use.
NAMES = {
    "apache-1.1": ["apache 1 1", "apache license version 1 1", "apache software license 1 1"],
    "apache-2.0": ["apache 2 0", "apache license version 2 0", "apache license 2 0", "apache software license 2 0"],
    "mit": ["mit", "mit license", "expat license", "x11 license"],
    "mit-0": ["mit 0", "mit no attribution"],
    "bsd-2-clause": ["bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd license"],
    "bsd-3-clause": ["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd"],
    "bsd-4-clause": ["bsd 4 clause", "original bsd"],
    "0bsd": ["0bsd", "zero clause bsd"],
    "isc": ["isc", "isc license"],
    "zlib": ["zlib", "zlib license", "zlib libpng license"],
    "gpl-2.0": ["gpl 2 0", "gnu general public license version 2", "gpl v2", "gplv2", "gnu gpl version 2"],
    "gpl-3.0": ["gpl 3 0", "gnu general public license version 3", "gpl v3", "gplv3", "gnu gpl version 3"],
    "lgpl-2.1": ["lgpl 2 1", "gnu lesser general public license version 2 1", "lgplv2 1", "gnu lgpl version 2 1"],
    "lgpl-3.0": ["lgpl 3 0", "gnu lesser general public license version 3", "lgplv3", "gnu lgpl version 3"],
    "agpl-3.0": ["agpl 3 0", "gnu affero general public license version 3", "agplv3", "gnu agpl version 3"],
    "mpl-1.1": ["mpl 1 1", "mozilla public license version 1 1", "mozilla public license 1 1"],
    "mpl-2.0": ["mpl 2 0", "mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0"],
    "epl-1.0": ["epl 1 0", "eclipse public license version 1 0", "eclipse public license v1 0"],
    "epl-2.0": ["epl 2 0", "eclipse public license version 2 0", "eclipse public license v 2 0"],
    "cddl-1.0": ["cddl 1 0", "common development and distribution license version 1 0"],
    "cpl-1.0": ["cpl 1 0", "common public license version 1 0"],
    "artistic-2.0": ["artistic 2 0", "artistic license 2 0", "artistic license version 2 0"],
    "bsl-1.0": ["bsl 1 0", "boost software license version 1 0", "boost software license 1 0"],
    "eupl-1.2": ["eupl 1 2", "european union public licence version 1 2", "eupl v1 2"],
    "unlicense": ["unlicense", "unlicense license"],
    "wtfpl": ["wtfpl", "do what the fuck you want to public license"],
    "cc0-1.0": ["cc0 1 0", "cc0", "creative commons zero"],
    "cc-by-3.0": ["cc by 3 0", "creative commons attribution 3 0"],
    "cc-by-4.0": ["cc by 4 0", "creative commons attribution 4 0"],
    "cc-by-sa-3.0": ["cc by sa 3 0", "creative commons attribution sharealike 3 0"],
    "cc-by-sa-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0"],
    "cc-by-nc-3.0": ["cc by nc 3 0", "creative commons attribution noncommercial 3 0"],
    "cc-by-nc-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0"],
    "cc-by-nd-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0"],
    "cc-by-nc-sa-4.0": ["cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0"],
    "cc-by-nc-nd-4.0": ["cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0"],
    "ofl-1.1": ["ofl 1 1", "sil open font license version 1 1", "sil open font license 1 1"],
    "odbl-1.0": ["odbl 1 0", "open database license version 1 0"],
    "postgresql": ["postgresql license", "postgresql licence"],
    "python-2.0": ["python 2 0", "python software foundation license version 2"],
    "ruby": ["ruby license", "ruby s license"],
    "openssl": ["openssl license"],
    "public-domain": ["public domain"],
    "proprietary": ["all rights reserved", "proprietary and confidential"],
}
#: (priority, words before a name, words after it); priorities are hundredths of a score.
FORMS = [
    (100, "spdx license identifier ", ""),
    (95, "(?:dual )?(?:re)?licen[cs]ed (?:to you )?(?:only )?under (?:the (?:terms of (?:the )?)?)?", ""),
    (92, "(?:released|distributed|published|available) under (?:the (?:terms of (?:the )?)?)?", ""),
    (90, "subject to (?:the )?(?:terms of (?:the )?)?", ""),
    (85, "licen[cs]e (?:is )?", ""),
    (70, "", " licen[cs]ed?"),
    (60, "", ""),
]
#: Names that mean a license only inside a sentence form.
_PLAIN = {"mit", "isc", "zlib", "python 2 0"}
#: What stands before a name that a text says it is not under.
DENIED = ("(?:not|never|no longer|isn t|aren t|wasn t) (?:be |been |being )?(?:(?:re)?licen[cs]ed |released |distributed |"
          "published |available )?(?:to you )?under (?:the (?:terms of (?:the )?)?)?")
#: Fixed values, the licenses' own words.  keyword: (label, priority, pattern), the keyword a part of each pattern.
SIGNATURES = {
    "hereby granted": [
        ("mit", 96, "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                    "associated documentation files"),
        ("mit-0", 98, "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                      "associated documentation files the software to deal in the software without restriction "
                      "(?:[^ ]+ ){1,40}?to do so the software is provided"),
        ("ncsa", 98, "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                     "associated documentation files the software to deal with the software"),
        ("bsl-1.0", 96, "permission is hereby granted free of charge to any person or organization obtaining a copy of the "
                        "software and accompanying documentation"),
        ("unicode", 96, "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
        ("upl-1.0", 96, "permission is hereby granted to any person obtaining a copy of this software associated "
                        "documentation and or data"),
        ("isc", 96, "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee "
                    "is hereby granted provided that the above copyright notice and this permission notice appear"),
        ("0bsd", 96, "permission to use copy modify and or distribute this software for any purpose with or without fee is "
                     "hereby granted the software is provided"),
        ("hpnd", 94, "permission to use copy modify and distribute this software and its documentation for any purpose "
                     "(?:and )?(?:with or )?without fee is hereby granted provided that the above copyright notice"),
        ("postgresql", 96, "permission to use copy modify and distribute this software and its documentation for any purpose "
                           "without fee and without a written agreement is hereby granted"),
    ],
    "substantial portions": [
        ("mit", 88, "the above copyright notice and this permission notice shall be included in all copies or substantial "
                    "portions of the software"),
    ],
    "otherwise to promote": [
        ("x11", 96, "except as contained in this notice the names? of (?:[^ ]+ ){1,20}?shall not be used in advertising or "
                    "otherwise to promote the sale use or other dealings in this software"),
    ],
    "redistribution and use": [
        ("bsd", 93, "redistribution and use in source and binary forms with or without modification are permitted provided "
                    "that the following conditions are met"),
    ],
    "endorse or promote": [
        ("bsd-3-clause", 96, "neither the names? of (?:[^ ]+ ){1,24}?may be used to endorse or promote products derived from "
                             "this software"),
    ],
    "advertising materials": [
        ("bsd-4-clause", 97, "all advertising materials mentioning features or use of this software must display the "
                             "following acknowledge?ment"),
    ],
    "express or implied": [
        ("bsd", 80, "this software is provided by the (?:[^ ]+ ){1,12}?as is and any express or implied warranties"),
        ("bsd-3-clause-clear", 97, "no express or implied licenses to any party s patent rights are granted by this license"),
        ("zlib", 90, "this software is provided as is without any express or implied warranty in no event will the authors? "
                     "be held liable"),
    ],
    "official policies": [
        ("bsd-2-clause-views", 96, "the views and conclusions contained in the software and documentation are those of the "
                                   "authors and should not be interpreted as representing official policies"),
    ],
    "is governed by": [
        ("bsd", 94, "use of this source code is governed by a bsd style licen[cs]e"),
        ("mit", 94, "use of this source code is governed by an mit style licen[cs]e"),
    ],
    "compliance with the license": [
        ("apache-2.0", 94, "licensed under the apache license version 2 0 the license you may not use this file except in "
                           "compliance with the license"),
        ("apache-2.0", 84, "you may not use this file except in compliance with the license"),
    ],
    "on an as is basis": [
        ("apache-2.0", 86, "unless required by applicable law or agreed to in writing software distributed under the license "
                           "is distributed on an as is basis"),
        ("python-2.0", 96, "psf is making python (?:[^ ]+ )?available to licensee on an as is basis"),
    ],
    "hereby grants": [
        ("apache-2.0", 94, "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free "
                           "irrevocable copyright license"),
        ("busl-1.1", 96, "the licensor hereby grants you the right to copy modify create derivative works redistribute and "
                         "make non production use of the licensed work"),
    ],
    "end user documentation": [
        ("apache-1.1", 96, "the end user documentation included with the redistribution if any must include the following "
                           "acknowledge?ment"),
    ],
    "any later version": [
        ("gpl-1.0-or-later", 97, "gnu general public license (?:[^ ]+ ){0,12}?either version 1 (?:[^ ]+ ){0,4}?or at your "
                                 "option any later version"),
        ("gpl-2.0-or-later", 97, "gnu general public license (?:[^ ]+ ){0,12}?either version 2 (?:[^ ]+ ){0,4}?or at your "
                                 "option any later version"),
        ("gpl-3.0-or-later", 97, "gnu general public license (?:[^ ]+ ){0,12}?either version 3 (?:[^ ]+ ){0,4}?or at your "
                                 "option any later version"),
        ("lgpl-2.0-or-later", 97, "gnu library general public license (?:[^ ]+ ){0,12}?either version 2 (?:[^ ]+ ){0,4}?or at "
                                  "your option any later version"),
        ("lgpl-2.1-or-later", 97, "gnu lesser general public license (?:[^ ]+ ){0,12}?either version 2 1 (?:[^ ]+ ){0,4}?or at "
                                  "your option any later version"),
        ("lgpl-3.0-or-later", 97, "gnu lesser general public license (?:[^ ]+ ){0,12}?either version 3 (?:[^ ]+ ){0,4}?or at "
                                  "your option any later version"),
        ("agpl-3.0-or-later", 97, "gnu affero general public license (?:[^ ]+ ){0,12}?either version 3 (?:[^ ]+ ){0,4}?or at "
                                  "your option any later version"),
        ("gfdl", 96, "gnu free documentation license version [^ ]+ (?:[^ ]+ )?or any later version"),
    ],
    "free software foundation": [
        ("gpl-2.0", 95, "gnu general public license (?:[^ ]+ ){0,3}?version 2 as published by the free software foundation"),
        ("gpl-3.0", 95, "gnu general public license (?:[^ ]+ ){0,3}?version 3 as published by the free software foundation"),
    ],
    "in the hope that it will be useful": [
        ("gpl", 84, "this program is distributed in the hope that it will be useful but without any warranty"),
        ("lgpl", 84, "this library is distributed in the hope that it will be useful but without any warranty"),
    ],
    "you should have received a copy": [
        ("gpl", 86, "you should have received a copy of the gnu general public license"),
        ("lgpl", 86, "you should have received a copy of the gnu (?:lesser|library) general public license"),
        ("agpl", 86, "you should have received a copy of the gnu affero general public license"),
    ],
    "freedom to share and change": [
        ("gpl-2.0", 95, "the licenses for most software are designed to take away your freedom to share and change it"),
        ("gpl-3.0", 95, "the licenses for most software and other practical works are designed to take away your freedom to "
                        "share and change the works"),
    ],
    "free copyleft license": [
        ("gpl-3.0", 96, "the gnu general public license is a free copyleft license for software and other kinds of works"),
        ("agpl-3.0", 96, "the gnu affero general public license is a free copyleft license for software and other kinds of "
                         "works"),
    ],
    "incorporates the terms": [
        ("lgpl-3.0", 96, "this version of the gnu lesser general public license incorporates the terms and conditions of "
                         "version 3"),
    ],
    "gnu library public license": [
        ("lgpl-2.1", 96, "it also counts as the successor of the gnu library public license version 2"),
    ],
    "statically or dynamically": [
        ("classpath-exception-2.0", 96, "linking this library statically or dynamically with other modules is making a "
                                        "combined work"),
    ],
    "a copy of the mpl": [
        ("mpl-2.0", 94, "if a copy of the mpl was not distributed with this file you can obtain one"),
    ],
    "incompatible with secondary licenses": [
        ("mpl-2.0-no-copyleft-exception", 97, "this source code form is incompatible with secondary licenses"),
    ],
    "the accompanying program": [
        ("epl", 92, "the accompanying program is provided under the terms of this eclipse public license"),
        ("cpl-1.0", 94, "the accompanying program is provided under the terms of this common public license"),
    ],
    "the contents of this file are subject to": [
        ("cddl", 92, "the contents of this file are subject to the terms of the common development and distribution license"),
        ("mpl-1.1", 96, "the contents of this file are subject to the mozilla public license version 1 1"),
        ("npl-1.1", 96, "the contents of this file are subject to the netscape public license version 1 1"),
    ],
    "package may be copied": [
        ("artistic-1.0", 96, "the intent of this document is to state the conditions under which a package may be copied"),
        ("artistic-2.0", 96, "this license establishes the terms under which a given free software package may be copied"),
    ],
    "must not be misrepresented": [
        ("zlib", 95, "the origin of this software must not be misrepresented you must not claim that you wrote the original "
                     "software"),
    ],
    "plainly marked": [
        ("zlib", 88, "altered source versions must be plainly marked as such"),
    ],
    "free and unencumbered": [
        ("unlicense", 97, "this is free and unencumbered software released into the public domain"),
    ],
    "you just do what": [
        ("wtfpl", 96, "you just do what the fuck you want to"),
    ],
    "to the extent possible under law": [
        ("cc0-1.0", 92, "to the extent possible under law (?:[^ ]+ ){1,16}?(?:has|have) (?:dedicated|waived) all copyright"),
    ],
    "with this deed": [
        ("cc0-1.0", 96, "the person who associated a work with this deed has dedicated the work to the public domain"),
    ],
    "the material": [
        ("cc", 85, "copy and redistribute the material in any medium or format"),
        ("cc-nc", 88, "you may not use the material for commercial purposes"),
        ("cc-sa", 90, "if you remix transform or build upon the material you must distribute your contributions under the "
                      "same license"),
        ("cc-nd", 90, "if you remix transform or build upon the material you may not distribute the modified material"),
    ],
    "appropriate credit": [
        ("cc-by", 88, "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ],
    "font": [
        ("ofl-1.1", 95, "the goals of the open font license ofl are to stimulate worldwide development of collaborative font "
                        "projects"),
        ("ofl-1.1", 92, "no modified version of the font software may use the reserved font name"),
    ],
    "modify and use this database": [
        ("odbl-1.0", 96, "is a license agreement intended to allow users to freely share modify and use this database"),
    ],
    "this product includes": [
        ("openssl", 94, "this product includes software developed by the openssl project for use in the openssl toolkit"),
        ("ssleay", 94, "this product includes cryptographic software written by eric young"),
    ],
    "the accompanying software": [
        ("ms-pl", 92, "this license governs use of the accompanying software if you use the software you accept this license"),
    ],
    "reciprocal grants": [
        ("ms-rl", 94, "reciprocal grants for any file you distribute that contains code from the software"),
    ],
    "applies to": [
        ("eupl", 94, "this european union public licence the eupl applies to the work"),
        ("afl", 94, "this academic free license the license applies to any original work of authorship"),
        ("osl", 94, "this open software license the license applies to any original work of authorship"),
    ],
    "free software license agreement": [
        ("cecill", 92, "this agreement is a free software license agreement that is the result of discussions between its "
                       "authors"),
    ],
    "unmodified copies of vim": [
        ("vim", 95, "there are no restrictions on distributing unmodified copies of vim"),
    ],
    "buy me a beer": [
        ("beerware", 95, "you think this stuff is worth it you can buy me a beer in return"),
    ],
    "for good not evil": [
        ("json", 97, "the software shall be used for good not evil"),
    ],
    "independent jpeg group": [
        ("ijg", 94, "this software is based in part on the work of the independent jpeg group"),
    ],
    "latex project public license": [
        ("lppl", 94, "this work may be distributed and or modified under the conditions of the latex project public license"),
    ],
    "by obtaining": [
        ("w3c", 93, "by obtaining using and or copying this work you the licensee agree that you have read understood and "
                    "will comply"),
    ],
    "give away verbatim copies": [
        ("ruby", 90, "you may make and give away verbatim copies of the source form of the software without restriction"),
        ("artistic-1.0", 88, "you may make and give away verbatim copies of the source form of the standard version"),
    ],
    "under the same terms as": [
        ("perl-5", 94, "you can redistribute it and or modify it under the same terms as (?:the )?perl"),
    ],
    "the db software": [
        ("sleepycat", 95, "information on how to obtain complete source code for the db software"),
    ],
    "mulan psl": [
        ("mulanpsl-2.0", 94, "you can use this software according to the terms and conditions of the mulan psl v2"),
    ],
    "hosted or managed service": [
        ("elastic-2.0", 94, "you may not provide the software to third parties as a hosted or managed service"),
    ],
    "third parties as a service": [
        ("sspl-1.0", 94, "if you make the functionality of the program or a modified version available to third parties as a "
                         "service"),
    ],
    "derivatives of the model": [
        ("openrail", 90, "you agree not to use the model or derivatives of the model"),
    ],
    "community license": [
        ("llama-community", 92, "is licensed under the llama [^ ]+ community license"),
    ],
    "proprietary information": [
        ("proprietary", 92, "this software is the confidential and proprietary information of"),
    ],
    "strictly prohibited": [
        ("proprietary", 92, "unauthorized copying of this (?:file|software|program) via any medium is strictly prohibited"),
    ],
    "may be reproduced": [
        ("proprietary", 90, "no part of this (?:publication|book|document|work) may be reproduced"),
    ],
    "disclaims copyright": [
        ("blessing", 95, "the author disclaims copyright to this source code"),
    ],
    "united states government": [
        ("public-domain", 88, "this (?:work|software) is a work of the united states government"),
    ],
}


def rules() -> list[dict]:
    """All rules in their order: priority, then the longer name or signature."""
    made = [(priority, len(pattern), label, f" {keyword} ", f"(?<= ){pattern}(?= )")
            for keyword, own in SIGNATURES.items() for label, priority, pattern in own]
    for label, names in NAMES.items():
        for name in names:
            made.append((110, len(name), "", f" {name} ", f"(?<= ){DENIED}{name}(?: licen[cs]e)?(?= )"))
            for priority, before, after in FORMS:
                if priority == 60 and name in _PLAIN or priority == 70 and "licen" in name:
                    continue
                made.append((priority, len(name), label, f" {name} ",
                             f"(?<= ){before}{name}{after}(?= )"))
    made.sort(key=lambda r: (-r[0], -r[1], r[2], r[4]))
    return [{"place": k, "priority": p, "label": label, "keyword": word, "pattern": pattern}
            for k, (p, _, label, word, pattern) in enumerate(made)]


#: Words that keywords share, and so are looked up before them; a keyword of several is in the first one's group.
#: They begin with a letter, of which a text has fewer than spaces.
GATES = ("licen", "gpl", "bsd", "cc0", "creative", "software", "public", "hereby", "copy", "apache", "mpl", "epl",
         "eupl", "cc")


def gated(keywords: list[str]) -> dict[str, list[str]]:
    """gate: its keywords, which are in no text that the gate is not in; a keyword of no gate is one itself."""
    out: dict[str, list[str]] = {}
    for k in keywords:
        out.setdefault(next((g for g in GATES if g in k), k.strip()), []).append(k)
    return out


def words_form(text: Column) -> Column:
    """Lower-case words between single spaces, with a space at either end; one space for no words."""
    t = F.trim(F.regexp_replace(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(t == "", " ").otherwise(F.concat(F.lit(" "), t, F.lit(" ")))


def _n_words(form: Column) -> Column:
    """Words of a form, or of its beginning up to and with a space."""
    return (F.length(form) - F.length(F.replace(form, F.lit(" "), F.lit(""))) - 1).cast("long")


#: Elements of an array that one fold takes: a fold copies its state at each step, so long arrays go in runs.
_RUN = 64


def _let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _runs(array: Column) -> Column:
    last = F.floor(F.greatest(F.size(array) - 1, F.lit(0)) / _RUN).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(array, k * _RUN + 1, F.lit(_RUN)))


def places(form: Column, pattern: Column) -> Column:
    """array<struct<start, end>> (characters) of a pattern's matches."""
    def pairs(found: Column) -> Column:
        gaps = F.slice(F.split(form, pattern, -1), F.lit(1), F.size(found))
        return F.zip_with(gaps, found, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit")))

    def summed(run: Column) -> Column:
        return F.aggregate(run, F.lit(0), lambda n, x: n + x["gap"] + x["hit"])

    def in_run(run: Column, at: Column) -> Column:
        none = F.array().cast("array<struct<start: int, end: int>>")
        return F.aggregate(run, F.struct(at.alias("at"), none.alias("out")), lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["hit"]).alias("at"),
            F.array_append(acc["out"], F.struct((acc["at"] + x["gap"]).alias("start"),
                                                (acc["at"] + x["gap"] + x["hit"]).alias("end"))).alias("out")),
            lambda acc: acc["out"])

    def all_runs(runs: Column) -> Column:
        starts = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
                             lambda acc, run: F.struct((acc["at"] + summed(run)).alias("at"),
                                                       F.array_append(acc["out"], acc["at"]).alias("out")),
                             lambda acc: acc["out"])
        return F.flatten(F.zip_with(runs, starts, in_run))

    return _let(_let(F.regexp_extract_all(form, pattern, F.lit(0)), pairs), lambda p: _let(_runs(p), all_runs))


HIT = "struct<start: int, back: int, place: int, priority: int, label: string>"


def unsuppressed(hits: Column) -> Column:
    """Of hits by (start, -end, place), those inside no other of an earlier rule.

    One sweep: what holds a hit comes before it, and of that, hits suppressed themselves can be left out,
    so a hit is compared with the open ones alone.
    """
    none = F.array().cast(f"array<{HIT}>")

    def inside(still: Column, d: Column) -> Column:
        return F.exists(still, lambda e: (e["back"] <= d["back"]) & (e["place"] < d["place"]))

    def opened(still: Column, d: Column) -> Column:
        return F.array_append(F.filter(still, lambda e: -e["back"] > d["start"]), d)

    def in_run(run: Column, still: Column) -> Column:
        return F.aggregate(run, F.struct(still.alias("open"), none.alias("out")), lambda acc, d: F.when(
            inside(acc["open"], d), acc).otherwise(F.struct(
                opened(acc["open"], d).alias("open"), F.array_append(acc["out"], d).alias("out"))), lambda acc: acc["out"])

    def all_runs(runs: Column) -> Column:
        no_runs = F.slice(F.array(none), F.lit(1), F.lit(0))
        at_starts = F.aggregate(runs, F.struct(none.alias("open"), no_runs.alias("out")), lambda acc, run: F.struct(
            F.aggregate(run, acc["open"], lambda still, d: F.when(inside(still, d), still).otherwise(
                opened(still, d))).alias("open"),
            F.array_append(acc["out"], acc["open"]).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(runs, at_starts, in_run))

    return _let(_runs(hits), all_runs)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, detections, labels, score).

    ``detections`` are those not suppressed: start and end (characters of the words form), rule and label.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    form = F.col("form")
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), words_form(text).alias("form"))
    spots = F.array().cast("array<struct<start: int, end: int, label: string>>")

    def phrase(words: str, label: str) -> Column:
        return F.transform(places(form, F.lit(f"(?<= ){words}(?= )")), lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), F.lit(label).alias("label")))

    base = F.flatten(F.array(*(phrase(*x) for x in PHRASES.items())))
    by_keyword: dict[str, list[dict]] = {}
    for r in rules():
        by_keyword.setdefault(r["keyword"], []).append(r)
    gates = F.from_json(F.lit(json.dumps([{"gate": g, "keywords": [{"keyword": k, "rules": by_keyword[k]} for k in own]}
                                          for g, own in gated(list(by_keyword)).items()])),
                        "array<struct<gate: string, keywords: array<struct<keyword: string, rules: array<struct<place: int, "
                        "priority: int, label: string, pattern: string>>>>>>")  # one constant
    keywords = F.flatten(F.transform(F.filter(gates, lambda g: F.contains(form, g["gate"])), lambda g: g["keywords"]))
    held = F.flatten(F.transform(F.filter(keywords, lambda n: F.contains(form, n["keyword"])), lambda n: n["rules"]))
    hits = F.flatten(F.transform(
        held,
        lambda r: F.transform(places(form, r["pattern"]), lambda x: F.struct(
            x["start"].alias("start"), (-x["end"]).alias("back"), r["place"].alias("place"),
            r["priority"].alias("priority"), r["label"].alias("label")))))
    out = out.select("doc_id", _n_words(form).alias("n_words"), "form",
                     F.when(form.contains(" license "), F.sort_array(base)).otherwise(spots).alias("base"),
                     F.sort_array(hits).alias("hits"))
    left = F.when(F.size("hits") > 0, unsuppressed(F.col("hits"))).otherwise(F.array().cast(f"array<{HIT}>"))
    out = out.withColumn("detections", F.transform(F.filter(left, lambda d: d["label"] != ""), lambda d: F.struct(
        d["start"].alias("start"), (-d["back"]).alias("end"), d["place"].alias("place"),
        d["priority"].alias("priority"), d["label"].alias("label"))))

    def word(place: Column) -> Column:
        return F.when(F.size("base") > 0, _n_words(F.substring(form, F.lit(1), place["start"])))

    own = F.transform("base", lambda x: x["label"])
    more = F.transform("detections", lambda x: x["label"])

    def joined(labels: Column) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(labels)), ",")

    best = F.coalesce(F.array_max(F.transform("detections", lambda x: x["priority"])), F.lit(0))
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        word(F.get(F.col("base"), F.lit(0))).alias("first_word"),
        word(F.element_at(F.col("base"), -1)).alias("last_word"),
        joined(own).alias("base_labels"), "detections", joined(F.concat(own, more)).alias("labels"),
        (F.greatest(best, F.when(F.size("base") > 0, 50).otherwise(0)) / 100).cast("double").alias("score"))

