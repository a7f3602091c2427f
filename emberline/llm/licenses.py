"""License detection by ordered signature rules, with DataFrame functions only.

A text becomes its words between single blanks. A rule is a regular expression over that string with a label, a priority
and a keyword; only rules whose keyword occurs in the text are run. Rules know licenses by name, by acronym, by SPDX id and by
sentences of their bodies. Detections are intervals of the string. One that lies
inside another of the same or a better priority is suppressed, so ``apache license version 2`` hides ``apache license``.
The exact base phrases have the best priority and are never suppressed.
"""
from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame, functions as F

# The base phrases and labels of the task.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# License families as (label, keyword, regular expression of the name, of the version or nothing).
FAMILIES = [
    ("mit", "mit", "(?:the )?mit(?: x11| expat)?", ""),
    ("apache-1", "apache", "(?:the )?apache(?: software)?", "1(?: [01])?"),
    ("apache-2", "apache", "(?:the )?apache(?: software)?", "2(?: 0)?"),
    ("gpl-1", "general", "(?:the )?(?:gnu )?general public", "1(?: 0)?"),
    ("gpl-2", "general", "(?:the )?(?:gnu )?general public", "2(?: 0)?"),
    ("gpl-3", "general", "(?:the )?(?:gnu )?general public", "3(?: 0)?"),
    ("lgpl-2", "lesser", "(?:the )?(?:gnu )?(?:lesser|library) general public", "2(?: [01])?"),
    ("lgpl-3", "lesser", "(?:the )?(?:gnu )?lesser general public", "3(?: 0)?"),
    ("agpl-3", "affero", "(?:the )?(?:gnu )?affero general public", "3(?: 0)?"),
    ("gfdl-1", "documentation", "(?:the )?(?:gnu )?free documentation", "1(?: [123])?"),
    ("mpl-1", "mozilla", "(?:the )?mozilla public", "1(?: [01])?"),
    ("mpl-2", "mozilla", "(?:the )?mozilla public", "2(?: 0)?"),
    ("bsd-2", "bsd", "(?:the )?(?:simplified |2 clause |two clause )bsd(?: 2 clause)?", ""),
    ("bsd-3", "bsd", "(?:the )?(?:new |modified |3 clause |three clause )bsd(?: 3 clause)?", ""),
    ("bsd-4", "bsd", "(?:the )?(?:original |4 clause |four clause )bsd(?: 4 clause)?", ""),
    ("isc", "isc", "(?:the )?isc", ""),
    ("epl-1", "eclipse", "(?:the )?eclipse public", "1(?: 0)?"),
    ("epl-2", "eclipse", "(?:the )?eclipse public", "2(?: 0)?"),
    ("cddl-1", "distribution", "(?:the )?common development and distribution", "1(?: [01])?"),
    ("artistic-1", "artistic", "(?:the )?artistic", "1(?: 0)?"),
    ("artistic-2", "artistic", "(?:the )?artistic", "2(?: 0)?"),
    ("bsl-1", "boost", "(?:the )?boost software", "1(?: 0)?"),
    ("eupl-1", "european", "(?:the )?european union public", "1(?: [012])?"),
    ("zlib", "zlib", "(?:the )?zlib(?: libpng)?", ""),
    ("unlicense", "unlicense", "(?:the )?unlicense", ""),
    ("wtfpl", "wtfpl", "(?:the )?wtfpl", "2"),
    ("ofl-1", "ofl", "(?:the )?(?:sil )?(?:open font )?ofl", "1(?: 1)?"),
    ("psf-2", "python", "(?:the )?python software foundation", "2(?: 0)?"),
    ("postgresql", "postgresql", "(?:the )?postgresql", ""),
    ("ms-pl", "microsoft", "(?:the )?microsoft public", ""),
    ("cc0", "cc0", "(?:creative commons )?cc0", "1(?: 0)?"),
    ("cc-by", "cc", "(?:creative commons )?cc by", "[1-4](?: [05])?"),
    ("cc-by-sa", "cc", "(?:creative commons )?cc by sa", "[1-4](?: [05])?"),
    ("cc-by-nd", "cc", "(?:creative commons )?cc by nd", "[1-4](?: [05])?"),
    ("cc-by-nc", "cc", "(?:creative commons )?cc by nc", "[1-4](?: [05])?"),
    ("cc-by-nc-sa", "cc", "(?:creative commons )?cc by nc sa", "[1-4](?: [05])?"),
    ("cc-by-nc-nd", "cc", "(?:creative commons )?cc by nc nd", "[1-4](?: [05])?"),
]
# Acronyms and SPDX ids as (label, keyword, expression, version or nothing, are they clear without more words).
# Unclear ones need a version of two numbers, the word version, or the word license.
ACRONYMS = [
    ("gpl-1", "gpl", "(?:the )?(?:gnu )?gpl", "1(?: 0)?", True), ("gpl-2", "gpl", "(?:the )?(?:gnu )?gpl", "2(?: 0)?", True),
    ("gpl-3", "gpl", "(?:the )?(?:gnu )?gpl", "3(?: 0)?", True), ("lgpl-2", "lgpl", "(?:the )?(?:gnu )?lgpl", "2(?: [01])?", True),
    ("lgpl-3", "lgpl", "(?:the )?(?:gnu )?lgpl", "3(?: 0)?", True), ("agpl-1", "agpl", "(?:the )?agpl", "1(?: 0)?", True),
    ("agpl-3", "agpl", "(?:the )?(?:gnu )?agpl", "3(?: 0)?", True), ("gfdl-1", "gfdl", "(?:the )?(?:gnu )?gfdl", "1(?: [123])?", True),
    ("mpl-1", "mpl", "(?:the )?mpl", "1 [01]", False), ("mpl-2", "mpl", "(?:the )?mpl", "2 0", False),
    ("epl-1", "epl", "(?:the )?epl", "1 0", False), ("epl-2", "epl", "(?:the )?epl", "2 0", False),
    ("apache-1", "apache", "(?:the )?apache", "1 [01]", False), ("apache-2", "apache", "(?:the )?apache", "2 0", False),
    ("apache-2", "asl", "(?:the )?asl", "2 0", False), ("cddl-1", "cddl", "(?:the )?cddl", "1(?: [01])?", True),
    ("artistic-1", "artistic", "(?:the )?artistic", "1 0", False), ("artistic-2", "artistic", "(?:the )?artistic", "2 0", False),
    ("bsl-1", "bsl", "(?:the )?bsl", "1 0", False), ("eupl-1", "eupl", "(?:the )?eupl", "1(?: [012])?", True),
    ("psf-2", "psf", "(?:the )?psf", "2 0", False), ("ms-pl", "ms", "(?:the )?ms pl", "", True), ("ofl-1", "ofl", "(?:the )?(?:sil )?ofl", "1 [01]", False),
    ("ofl-1", "sil", "(?:the )?sil open font", "1(?: [01])?", False), ("sspl-1", "sspl", "(?:the )?sspl", "1(?: 0)?", True),
    ("bsd-2", "bsd", "(?:the )?(?:bsd (?:2|two) clause|(?:2|two) clause bsd)", "", True),
    ("bsd-3", "bsd", "(?:the )?(?:bsd (?:3|three) clause|(?:3|three) clause bsd)", "", True),
    ("bsd-4", "bsd", "(?:the )?(?:bsd (?:4|four) clause|(?:4|four) clause bsd)", "", True),
    ("bsd-2", "bsd", "(?:the )?(?:simplified|freebsd) bsd", "", False), ("bsd-3", "bsd", "(?:the )?revised bsd", "", False),
    ("bsd", "bsd", "(?:the )?bsd(?: style)?", "", False), ("0bsd", "0bsd", "(?:the )?0bsd", "", True),
    ("cc0", "creativecommons", "creativecommons org publicdomain zero", "1(?: 0)?", True), ("cc0", "creative", "creative commons zero", "", True),
] + [(label, keyword, start + kind, "[1-4](?: [05])?", True)
     for label, words, kinds in [("cc-by", "", "by"), ("cc-by-sa", " share ?alike", "by sa"), ("cc-by-nd", " no ?deriv(?:ative|ativework|ativeworks|atives|s)", "by nd"),
                                 ("cc-by-nc", " non ?commercial", "by nc"), ("cc-by-nc-sa", " non ?commercial share ?alike", "by nc sa"),
                                 ("cc-by-nc-nd", " non ?commercial no ?deriv(?:ative|ativework|ativeworks|atives|s)", "by nc nd")]
     for keyword, start, kind in [("creative", "creative commons attribution", words), ("creativecommons", "creativecommons org licenses ", kinds)]]
# Acronyms that carry their version in the same word.
JOINED = {"gplv1": "gpl-1", "gplv2": "gpl-2", "gpl2": "gpl-2", "gplv3": "gpl-3", "gpl3": "gpl-3", "lgplv2": "lgpl-2", "lgpl2": "lgpl-2", "lgplv3": "lgpl-3",
          "lgpl3": "lgpl-3", "agplv3": "agpl-3", "agpl3": "agpl-3", "gfdlv1": "gfdl-1", "mplv1": "mpl-1", "mplv2": "mpl-2", "mpl2": "mpl-2", "eplv1": "epl-1",
          "eplv2": "epl-2", "apache2": "apache-2", "apachev2": "apache-2", "asl2": "apache-2", "asl20": "apache-2", "eupl12": "eupl-1"}
# Sentences of the license bodies, as (keyword, label, expression).
GRANT = "permission is hereby granted free of charge to any person "
USE = "permission to use copy modify and (?:or )?distribute this software "
TERMS = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
UNLESS = "(?!redistribution and use in |this software is provided )"
NEITHER = "neither the names? of |may not be used to endorse or promote "
MIT_FILES = "a copy of this software and associated documentation files"
BODIES = [
    ("hereby", "mit", f"{GRANT}obtaining {MIT_FILES}(?: the software)?(?: to deal in the software without restriction)?"),
    ("noninfringement", "mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("hereby", "bsl-1", f"{GRANT}or organization obtaining a copy of the software and accompanying documentation"),
    ("hereby", "isc", f"{USE}for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("hereby", "0bsd", f"{USE}for any purpose with or without fee is hereby granted(?! provided)"),
    ("hereby", "postgresql", f"{USE}and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("redistribution", "bsd", TERMS.rstrip()),
    ("redistribution", "bsd-2", f"{TERMS}(?:{UNLESS}(?!{NEITHER}|all advertising materials )[^ ]++ ){{10,300}}this software is provided by"),
    ("redistribution", "bsd-3", f"{TERMS}(?:{UNLESS}(?!{NEITHER}|all advertising materials )[^ ]++ ){{10,300}}(?:{NEITHER})(?:{UNLESS}[^ ]++ ){{1,100}}this software is provided by"),
    ("redistribution", "bsd-4", f"{TERMS}(?:{UNLESS}(?!all advertising materials )[^ ]++ ){{5,300}}all advertising materials mentioning features or use of this software must display"),
    ("endorse", "bsd-3", "neither the names? of (?:[^ ]++ ){1,40}?may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("advertising", "bsd-4", "all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment"),
    ("apache", "apache-2", "www apache org licenses license 2 0"),
    ("contributor", "apache-2", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("mozilla", "mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mozilla", "mpl-1", "the contents of this file are subject to the mozilla public license version 1 [01]"),
    ("mozilla", "mpl-2", "you can obtain one at https? mozilla org mpl 2 0"),
    ("eclipse", "epl-2", "(?:https? )?(?:www )?eclipse org legal epl (?:2 0|v20)"), ("eclipse", "epl-1", "(?:https? )?(?:www )?eclipse org legal epl v10"),
    ("warranty", "zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("misrepresented", "zlib", "the origin of this software must not be misrepresented"),
    ("unencumbered", "unlicense", "this is free and unencumbered software released into the public domain"),
    ("verbatim", "wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("fuck", "wtfpl", "(?:you )?(?:just )?do what the fuck you want to(?: public license)?"),
    ("artistic", "artistic-1", "the artistic license preamble the intent of this document is to state the conditions under which a package may be copied"),
    ("preamble", "artistic-2", "preamble this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("copyleft", "gpl-3", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("copyleft", "agpl-3", "the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("freedom", "gpl-2", "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license is intended to guarantee your freedom to share and change free software"),
    ("incorporates", "lgpl-3", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("successor", "lgpl-2", "(?:it also counts as )?the successor of the gnu library public license"),
    ("functional", "gfdl-1", "the purpose of this license is to make a manual textbook or other functional and useful document free"),
    ("bundled", "ofl-1", "the fonts including any derivative works can be bundled embedded redistributed and or sold with any software"),
    ("psf", "psf-2", "this license agreement is between the python software foundation psf and the individual or organization"),
    ("affirmer", "cc0", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders"),
    ("modifications", "cddl-1", "covered software means a the original software or b modifications or c the combination of files containing original software with files containing modifications"),
    ("eupl", "eupl-1", "this european union public licen[sc]e the eupl applies to the work"),
    ("contributors", "ms-pl", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("evil", "json", "the software shall be used for good not evil"),
]
# What may stand before a name, as (priority, confidence, expression, is the word license needed after it).
FORMS = [
    (1, 0.95, "spdx license identifier ", False),
    (1, 0.95, "licen[sc]ed under (?:the terms of )?", False),
    (1, 0.9, "(?:released|distributed|available|published|provided) under (?:the terms of )?", True),
    (2, 0.9, "licen[sc]es? (?:is )?", False),
    (2, 0.9, "(?:terms|conditions) of ", True),
    (2, 0.9, "(?:subject to|governed by|covered by) (?:the terms of )?", True),
    (2, 0.85, "(?:see|read) ", True),
    (2, 0.85, "(?:0|1|clause|later|only|mit|isc|zlib|unlicense) (?:or|and) (?!later )", False),
    (3, 0.8, "", True),
]
# What may stand between a name and its version and after it; a version may be one word with its v.
PUBLISHED = "(?: as published by the free software foundation(?: inc)?)?(?: either)?"
LATER = "(?: of the licen[sc]e)?(?: only| or (?:at your option )?(?:any )?later(?: version)?)?"


def rules() -> list[tuple[str, str, int, float, str]]:
    """(keyword, label, priority, confidence, regular expression), in order: base phrases, every form of every family, of every
    acronym and SPDX id, of the acronyms that hold their version, then the sentences of license bodies.

    A family with versions gives one rule with its version and one without; the latter has the label without the version.
    """
    keywords = {"mit": "mit", "apache-2": "apache", "cc-by-nc": "cc"}
    out = [(keywords[label], label, 0, 1.0, phrase) for phrase, label in BASE.items()]
    # Names that need no word license after them are clear.
    known = [(*f, f[1].startswith("cc") or f[0] in ("unlicense", "wtfpl"), True) for f in FAMILIES] + [(*f, False) for f in ACRONYMS]
    for label, keyword, name, version, clear, full in known:
        stem = label.rpartition("-")[0] if version and label[-1].isdigit() and label != "cc0" else label
        for priority, confidence, before, needed in FORMS:
            word, maybe = " licen[sc]ed?", "(?: licen[sc]ed?)?"
            start = before + name + (word if needed and not clear else maybe)
            if version:
                mark = "(?: [al]?gpl| mpl| epl)?" + PUBLISHED + f"(?: version| ver| v)? v?{version}"
                if not full and not clear:
                    mark = f"(?:{mark}|{PUBLISHED}(?: version| ver| v)(?: |(?<= v)){version[0]}| v?{version})"
                out.append((keyword, label, priority, confidence, (start if full else before + name + maybe) + mark + LATER))
            out.append((keyword, stem, priority, confidence if not version else confidence - 0.1, start))
    for word, label in JOINED.items():
        out += [(word, label, priority, confidence, f"{before}(?:the )?(?:gnu )?{word}(?: [0123])?(?: licen[sc]ed?)?{LATER}") for priority, confidence, before, _ in FORMS]
    out += [(keyword, label, 1, 0.95, sentence) for keyword, label, sentence in BODIES]
    return list(dict.fromkeys(out))


def plain(text: Column) -> Column:
    """The words of the text between single blanks, with a blank at either end; the empty string if there are none."""
    joined = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", " "))
    return F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit(" "), joined, F.lit(" ")))


def _table() -> dict[str, Column]:
    """The rules' fields, one constant array each: the optimiser folds a split text at once, but not a thousand structs."""
    keyword, label, priority, confidence, regex = zip(*rules())
    column = lambda values, kind: F.split(F.lit("\n".join(map(str, values))), "\n").cast(f"array<{kind}>")
    return {"at": column(range(1, len(regex) + 1), "int"), "keyword": column(keyword, "string"), "label": column(label, "string"),
            "priority": column(priority, "int"), "confidence": column(map(float, confidence), "double"),
            "regex": column([f"(?i)(?<= )(?:{rx})(?= )" for rx in regex], "string")}


def _intervals(norm: Column, rule: dict[str, Column]) -> Column:
    """Where the rule's expression matches: the pieces between the matches and the matches give the positions."""
    hits = F.regexp_extract_all(norm, rule["regex"], F.lit(0))
    sizes = F.transform(F.arrays_zip(F.split(norm, rule["regex"], -1).alias("gap"), hits.alias("hit")),
                        lambda z: F.struct(F.length(z["gap"]).alias("gap"), F.length(z["hit"]).alias("hit")))
    none = F.array().cast("array<struct<start:int,stop:int,priority:int,confidence:double,label:string>>")
    walk = F.aggregate(
        F.slice(sizes, F.lit(1), F.size(hits)), F.struct(F.lit(0).alias("at"), none.alias("found")),
        lambda s, z: F.struct((s["at"] + z["gap"] + z["hit"]).alias("at"), F.concat(s["found"], F.array(F.struct(
            (s["at"] + z["gap"]).alias("start"), (s["at"] + z["gap"] + z["hit"]).alias("stop"), rule["priority"].alias("priority"),
            rule["confidence"].alias("confidence"), rule["label"].alias("label")))).alias("found")))
    return F.when(F.size(hits) > 0, walk["found"]).otherwise(none)


def detect(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_suppressed.

    Words are runs of letters, digits and all characters beyond ASCII, whatever their case in A-Z. n_base counts the places
    of the base phrases, first_word and last_word are their smallest and largest start (null without one). labels holds the
    base labels and those of the surviving rules, score the largest confidence among them, 0 without one. Null and empty
    texts have no word and no detection. Repeated rows and null ids are answered row by row; an empty table gives an empty
    result; other columns are not read.
    """
    norm, table = F.col("norm"), _table()
    keys = sorted({r[0] for r in rules()})
    src = docs.select("doc_id", plain(F.col("text")).alias("norm"))
    # One pass over the text tells whether any keyword occurs; only then is each looked for, and only its rules are run.
    heads = [(c, "|".join(k[1:] for k in group)) for c, group in groupby(keys, lambda k: k[0])]
    gate = norm.rlike("(?i) (?:" + "|".join(f"{c}(?:{rest})" for c, rest in heads) + ") ")
    low = F.lower(norm)
    present = F.filter(F.array(*[F.when(F.contains(low, F.lit(f" {k} ")), F.lit(k)) for k in keys]), lambda k: k.isNotNull())
    src = src.withColumn("keys", F.when(gate, present))
    rule = lambda i: {name: F.element_at(values, i) for name, values in table.items()}
    active = F.filter(table["at"], lambda i: F.array_contains(F.col("keys"), rule(i)["keyword"]))
    src = src.withColumn("found", F.when(F.size("keys") > 0, F.array_sort(
        F.flatten(F.transform(active, lambda i: _intervals(norm, rule(i)))),
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["stop"] != b["stop"], b["stop"] - a["stop"])
        .when(a["priority"] != b["priority"], a["priority"] - b["priority"])
        .when(a["label"] < b["label"], F.lit(-1)).when(a["label"] > b["label"], F.lit(1)).otherwise(F.lit(0)))))
    # Sweep from the left: ``reach`` has, per priority, how far the detections so far go. Sorted by start, a detection is
    # inside an earlier one exactly if that one reaches at least as far.
    level = len({r[2] for r in rules()})
    begin = F.struct(F.array(*[F.lit(-1)] * level).alias("reach"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("hidden"))

    def step(s: Column, d: Column) -> Column:
        hidden = (d["priority"] > 0) & (F.array_max(F.slice(s["reach"], F.lit(1), d["priority"] + 1)) >= d["stop"])
        reach = F.transform(s["reach"], lambda x, i: F.when(i == d["priority"], F.greatest(x, d["stop"])).otherwise(x))
        return F.when(hidden, F.struct(s["reach"].alias("reach"), s["labels"].alias("labels"), s["score"].alias("score"), (s["hidden"] + 1).alias("hidden"))).otherwise(
            F.struct(reach.alias("reach"), F.array_union(s["labels"], F.array(d["label"])).alias("labels"),
                     F.greatest(s["score"], d["confidence"]).alias("score"), s["hidden"].alias("hidden")))

    src = src.withColumn("end", F.aggregate("found", begin, step))
    src = src.withColumn("base", F.filter("found", lambda d: d["priority"] == 0))
    words = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    place = lambda at: words(F.substring(norm, F.lit(1), at)).cast("long") - 1
    starts = F.transform("base", lambda d: d["start"])
    join = lambda labels: F.coalesce(F.array_join(F.array_sort(F.array_distinct(labels)), ","), F.lit(""))
    return src.select(
        "doc_id", F.greatest(words(norm) - 1, F.lit(0)).cast("long").alias("n_words"),
        F.greatest(F.coalesce(F.size("base"), F.lit(0)), F.lit(0)).cast("long").alias("n_base"),
        F.when(F.size("base") > 0, place(F.array_min(starts))).alias("first_word"),
        F.when(F.size("base") > 0, place(F.array_max(starts))).alias("last_word"),
        join(F.transform("base", lambda d: d["label"])).alias("base_labels"), join(F.col("end.labels")).alias("labels"),
        F.coalesce("end.score", F.lit(0.0)).alias("score"), F.coalesce("end.hidden", F.lit(0)).cast("long").alias("n_suppressed"))
