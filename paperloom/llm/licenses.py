"""License scans by sentence rules.

Texts are cut into pieces at sentence ends, line ends and a few inner places of licence sentences, and pieces normalised to
lower-case words.  A known sentence is a run of whole pieces, so it is found however it is wrapped, indented or marked as a
comment, but not inside a longer line.  Known sentences have identifiers; a document becomes the sequence of the identifiers it
holds, and ordered rules are matched against that sequence: a rule is a list of identifiers that must follow each other, other
sentences in between allowed up to ``gap`` places, wrapped lines counted once.  Rules stand by precedence: a sentence that an
earlier rule has used is not used again by a later one.  All of it is Catalyst expressions.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only

#: Identifiers of known licence sentences, in normal form.
SENTENCES = {
    "apache-grant": "licensed under the apache license version 2 0",
    "apache-terms": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "mit-name": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "as-is": "the software is provided as is without warranty of any kind express or implied",
    "gpl3-name": "this work is licensed under the gnu general public license version 3",
    "gpl2-name": "this work is licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-v3-later": "either version 3 of the license or at your option any later version",
    "gpl-v2-later": "either version 2 of the license or at your option any later version",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc0": "licensed under cc0 1 0",
    "mpl2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "reserved": "all rights reserved",
}
#: Licence, whether it permits training use, and the identifiers in order; longer rules first.
RULES = [
    ("Apache-2.0", True, ["apache-grant", "apache-terms", "apache-copy"]),
    ("GPL-3.0-or-later", False, ["gpl-free", "gpl-v3-later"]),
    ("GPL-2.0-or-later", False, ["gpl-free", "gpl-v2-later"]),
    ("BSD-3-Clause", True, ["bsd-grant", "bsd-names"]),
    ("MIT", True, ["mit-grant", "as-is"]),
    ("Apache-2.0", True, ["apache-grant"]),
    ("MIT", True, ["mit-name"]),
    ("MIT", True, ["mit-grant"]),
    ("GPL-3.0-only", False, ["gpl3-name"]),
    ("GPL-2.0-only", False, ["gpl2-name"]),
    ("BSD-2-Clause", True, ["bsd-grant"]),
    ("CC-BY-4.0", True, ["cc-by"]),
    ("CC-BY-SA-4.0", False, ["cc-by-sa"]),
    ("CC-BY-NC-4.0", False, ["cc-by-nc"]),
    ("CC0-1.0", True, ["cc0"]),
    ("MPL-2.0", False, ["mpl2"]),
    ("Proprietary", False, ["reserved"]),
]
_GPL = "you can redistribute it and or modify it under the terms of the gnu general public license"
_CC = {"cc-by": ("attribution", "by"), "cc-by-sa": ("attribution sharealike", "by sa"), "cc-by-nc": ("attribution noncommercial", "by nc")}
_APACHE_URL = "www apache org licenses license 2 0"
#: Further wordings of the known sentences, from the licences' own texts and notices; ``spdx-`` ones have MORE_RULES.
WORDINGS = {
    "apache-grant": [
        "licensed under the apache license version 2 0 the license", "the asf licenses this file to you under the apache license version 2 0 the license",
        "apache license version 2 0 january 2004", "spdx license identifier apache 2 0",
    ],
    "apache-copy": [f"you may obtain a copy of the license at {x}" for x in (f"https {_APACHE_URL}", f"http {_APACHE_URL} txt", f"https {_APACHE_URL} txt", f"http {_APACHE_URL} html", f"https {_APACHE_URL} html")],
    "mit-name": ["licensed under the mit license", "this project is licensed under the mit license", "spdx license identifier mit"],
    "mit-grant": [
        SENTENCES["mit-grant"] + " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
    ],
    "as-is": [SENTENCES["as-is"] + " including but not limited to the warranties of merchantability fitness for a particular purpose and " + x for x in ("noninfringement", "non infringement")],
    "gpl3-name": [
        "gnu general public license version 3 29 june 2007", f"{_GPL} version 3 as published by the free software foundation", f"{_GPL} as published by the free software foundation version 3",
        f"{_GPL} as published by the free software foundation version 3 of the license", "spdx license identifier gpl 3 0", "spdx license identifier gpl 3 0 only",
    ],
    "gpl2-name": [
        "gnu general public license version 2 june 1991", f"{_GPL} version 2 as published by the free software foundation", f"{_GPL} as published by the free software foundation version 2",
        f"{_GPL} as published by the free software foundation version 2 of the license", "spdx license identifier gpl 2 0", "spdx license identifier gpl 2 0 only",
    ],
    "gpl-free": [f"{_GPL} as published by the free software foundation"],
    "bsd-grant": ["spdx license identifier bsd 2 clause"],
    "bsd-names": [f"nor the names of {x} contributors may be used to endorse or promote products derived from this software without specific prior written permission" for x in ("its", "the")],
    **{
        i: [f"{lead}licensed under {a} creative commons {name} 4 0 international license" for lead in ("", "this work is ") for a in ("a", "the")]
        + [f"this work is licensed under cc {short} 4 0", f"spdx license identifier cc {short} 4 0"]
        for i, (name, short) in _CC.items()
    },
    "cc0": [
        "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work",
        "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", "spdx license identifier cc0 1 0",
    ],
    "mpl2": ["this source code form is subject to the terms of the mozilla public license version 2 0", "spdx license identifier mpl 2 0"],
    "spdx-gpl3-later": ["spdx license identifier gpl 3 0 or later"],
    "spdx-gpl2-later": ["spdx license identifier gpl 2 0 or later"],
    "spdx-bsd3": ["spdx license identifier bsd 3 clause"],
}
MORE_RULES = [("GPL-3.0-or-later", False, ["spdx-gpl3-later"]), ("GPL-2.0-or-later", False, ["spdx-gpl2-later"]), ("BSD-3-Clause", True, ["spdx-bsd3"])]
KNOWN = {s: i for i, s in SENTENCES.items()} | {s: i for i, ss in WORDINGS.items() for s in ss}
#: The beginnings, by words, of the known sentences: what a piece has to be for a run to start with it.
STARTS = sorted({" ".join(s.split(" ")[: n + 1]) for s in KNOWN for n in range(len(s.split(" ")))})
LONGEST = max(len(s.split(" ")) for s in KNOWN)
#: One of these is in every known sentence, so texts without them need not be cut.
ANCHORS = ["licen", "permission", "permitted", "warranty", "reserved", "rights"]
assert all(any(w in s for w in ANCHORS) for s in KNOWN), "a known sentence without an anchor"
GAP = 8
OTHER_CHARS = r"[^a-z0-9]+"
#: Pieces of one sentence end at line ends, colons, and inside two sentences that have free words beside the fixed ones.
INNER = r"\n|:(?=\s)|,(?=[^a-z0-9]+either[^a-z0-9]+version[^a-z0-9])|[^a-z0-9](?=nor[^a-z0-9]+the[^a-z0-9]+names[^a-z0-9]+of[^a-z0-9])"
#: Sentences end here and at lines without words.
END = r"[;!?]+|\.(?=\s|$)"
BLANK = r"\n(?:[^a-z0-9\n]*\n)+"


def _plain(s: Column) -> Column:
    return F.btrim(F.regexp_replace(s, OTHER_CHARS, " "))


def _sentences(text: Column) -> Column:
    """array<array<string>>: sentences of ``text`` and their pieces in normal form; null if no known sentence can be in it."""
    low = F.lower(F.coalesce(text, F.lit("")))
    # GPL-3.0+ is another licence than GPL-3.0, and a plus sign no word.
    full = F.regexp_replace(low, r"(gpl-[23]\.0)\+", "$1-or-later")
    sentences = F.transform(F.split(full, f"{END}|{BLANK}"), lambda s: F.filter(F.transform(F.split(s, INNER), _plain), lambda p: p != ""))
    return F.when(reduce(or_, (F.contains(low, F.lit(w)) for w in ANCHORS)), F.filter(sentences, lambda s: F.size(s) > 0))


def _found(pieces: Column, words: Column) -> Column:
    """array<struct<at, sentence, id, n>>: known sentences by their first piece; ``n`` pieces each."""
    known = F.create_map(*(F.lit(x) for pair in KNOWN.items() for x in pair))
    placed = F.transform(pieces, lambda p, i: F.struct(i.alias("at"), p["sentence"].alias("sentence"), p["words"].alias("words")))

    def runs(e: Column) -> Column:
        sizes = F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.size(words) - e["at"]))
        tried = F.transform(sizes, lambda n: F.struct(e["at"].alias("at"), e["sentence"].alias("sentence"), known[F.array_join(F.slice(words, e["at"] + 1, n), " ")].alias("id"), n.alias("n")))
        return F.filter(tried, lambda x: x["id"].isNotNull())

    return F.flatten(F.transform(F.filter(placed, lambda e: e["words"].isin(STARTS)), runs))


def _distinct(found: Column) -> Column:
    """Of ``found``, no sentence that lies inside a longer one, and one for each place and identifier."""
    over = lambda x, e: (x["at"] <= e["at"]) & (x["at"] + x["n"] >= e["at"] + e["n"]) & (x["n"] > e["n"])
    outer = F.filter(found, lambda e: ~F.exists(found, lambda x: over(x, e)))
    return F.transform(outer, lambda e: F.struct(e["at"].alias("at"), e["sentence"].alias("sentence"), e["id"].alias("id")))


def _follow(seq: Column, ids: list[str], gap: int) -> Column:
    """Starts (at, sentence) of ``ids`` following one another in ``seq``."""

    def ends(e: Column, k: int) -> Column:
        if k == len(ids):
            return F.lit(True)
        return F.exists(seq, lambda x: (x["id"] == ids[k]) & (x["at"] > e["at"]) & (x["sentence"] <= e["sentence"] + gap) & ends(x, k + 1))

    return F.transform(F.filter(seq, lambda e: (e["id"] == ids[0]) & ends(e, 1)), lambda e: F.struct(e["at"].alias("at"), e["sentence"].alias("sentence")))


def _outside(starts: Column, longer: Column, gap: int) -> Column:
    """The starts that no longer rule, begun at one of ``longer``, may have used."""
    return F.filter(starts, lambda a: ~F.exists(longer, lambda b: (a["at"] > b["at"]) & (a["sentence"] <= b["sentence"] + gap)))


def _marked(starts: Column, no: int) -> Column:
    return F.transform(starts, lambda a: F.struct(a["at"].cast("int").alias("at"), F.lit(no).alias("rule")))


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, gap: int = GAP) -> DataFrame:
    """(doc_id, sentence_ids, licenses, n_matches, permissive) for every row.

    ``licenses`` is sorted and distinct; ``permissive`` is null without a licence, false if one of them forbids.  Null and
    empty texts hold no sentence.  Repeated rows give one row each; an empty table none; other columns are not read.
    """
    d = only(df, **{doc_id: "doc", text: "text"}).select("doc", _sentences(F.col("text")).alias("cut"))
    numbered = F.transform("cut", lambda s, k: F.transform(s, lambda p: F.struct(k.alias("sentence"), p.alias("words"))))
    d = d.select("doc", F.flatten(numbered).alias("pieces"), F.flatten("cut").alias("words"))
    d = d.select("doc", _found(F.col("pieces"), F.col("words")).alias("found"))
    none = F.array().cast("array<struct<at:int,sentence:int,id:string>>")
    d = d.select("doc", F.when(F.size("found") > 0, _distinct(F.col("found"))).otherwise(none).alias("seq"))
    few = F.size("seq") > 0
    used = F.array().cast("array<struct<at:int,rule:int>>")
    rules = RULES + MORE_RULES
    for no, (_, _, ids) in enumerate(rules):
        starts = _follow(F.col("seq"), ids, gap)
        # What a longer rule began with is not begun with again.
        firsts = [k for k, (_, _, other) in enumerate(rules[:no]) if other[0] == ids[0]]
        if firsts:
            taken = F.flatten(F.array(*(_follow(F.col("seq"), rules[k][2], gap) for k in firsts)))
            starts = F.array_except(starts, taken)
        inside = [k for k, (_, _, other) in enumerate(rules[:no]) if ids[0] in other[1:]]
        if inside:
            starts = _outside(starts, F.flatten(F.array(*(_follow(F.col("seq"), rules[k][2], gap) for k in inside))), gap)
        used = F.concat(used, _marked(starts, no))
    d = d.withColumn("used", F.when(few, used).otherwise(F.array().cast("array<struct<at:int,rule:int>>")))
    names = F.array(*(F.lit(name) for name, _, _ in rules))
    allows = F.array(*(F.lit(ok) for _, ok, _ in rules))
    return d.select(
        F.col("doc").alias(doc_id),
        F.transform("seq", lambda e: e["id"]).alias("sentence_ids"),
        F.array_sort(F.array_distinct(F.transform("used", lambda u: F.element_at(names, u["rule"] + 1)))).alias("licenses"),
        F.size("used").cast("long").alias("n_matches"),
        F.when(F.size("used") > 0, F.forall("used", lambda u: F.element_at(allows, u["rule"] + 1))).alias("permissive"),
    )
