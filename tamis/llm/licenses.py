"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory. DataFrame functions only.

Templates are notices, titles and opening words of licences, and SPDX tags. Each has an anchor, one of its words; wherever a text, at any length
and however its lines break, holds that word, the terms around it that lie as the template's do are compared to the template. A window's terms
are rows; joined to the templates' weights (fixed, so broadcast) and summed they give the cosine. Versions and families are told apart by words
that a window must hold or must not hold, whatever its cosine.

A file without a licence of its own takes that of the nearest directory above it that has a licence file. Directories, not files, are joined
to their ancestors, and files look their directory up by salted keys, so a directory with a third of all files spreads over many tasks.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import keep

_GPL = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_NC = "noncommercial sharealike noderivatives"
#: Licence, notice or opening words, anchor, words that must be there, words that must not.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache", "2.0", ""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache", "2.0", ""),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 Terms and conditions for use, reproduction, and distribution", "apache", "2.0", ""),
    ("MIT", "Released under the MIT License.", "mit", "license", ""),
    ("MIT", "The MIT License (MIT) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "hereby", "granted software", ""),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "hereby", "granted software", ""),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "hereby", "granted purpose fee", ""),
    ("GPL-1.0", "GNU General Public License Version 1, February 1989", "gnu", "general 1", "lesser library affero"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991", "gnu", "general 2", "lesser library affero"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu", "general 2", "lesser library affero"),
    ("GPL-2.0", "This program is free software; " + _GPL.format("General Public License", "2"), "gnu", "general 2", "lesser library affero"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007", "gnu", "general 3", "lesser library affero"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu", "general 3", "lesser library affero"),
    ("GPL-3.0", "This program is free software: " + _GPL.format("General Public License", "3"), "gnu", "general 3", "lesser library affero"),
    ("LGPL-2.0", "GNU Library General Public License Version 2, June 1991", "gnu", "library 2", ""),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999", "gnu", "lesser 2.1", ""),
    ("LGPL-2.1", "This library is free software; " + _GPL.format("Lesser General Public License", "2.1"), "gnu", "lesser 2.1", ""),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007", "gnu", "lesser 3", ""),
    ("LGPL-3.0", "This library is free software: " + _GPL.format("Lesser General Public License", "3"), "gnu", "lesser 3", ""),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007", "gnu", "affero 3", ""),
    ("AGPL-3.0", "This program is free software: " + _GPL.format("Affero General Public License", "3"), "gnu", "affero 3", ""),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008", "gnu", "documentation 1.3", ""),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution", "source binary", ""),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "bsd", "style", ""),
    ("MPL-1.1", "Mozilla Public License Version 1.1", "mozilla", "public 1.1", ""),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1", "mozilla", "public 1.1", ""),
    ("MPL-2.0", "Mozilla Public License Version 2.0", "mozilla", "public 2.0", ""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla", "public 2.0", ""),
    ("Artistic-2.0", "The Artistic License 2.0", "artistic", "license 2.0", ""),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc", "by 4.0", "nc sa nd"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc", "by sa 4.0", "nc nd"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", "cc", "by nd 4.0", "nc sa"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc", "by nc 4.0", "sa nd"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative", "attribution 4.0", _NC),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "creative", "attribution sharealike 4.0", "noncommercial noderivatives"),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "creative", "attribution noderivatives 4.0", "noncommercial sharealike"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "creative", "attribution noncommercial 4.0", "sharealike noderivatives"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work", "waived", "law rights", ""),
    ("Unlicense", "This is free and unencumbered software released into the public domain", "unencumbered", "software", ""),
)
FILE = r"(?i)^(un)?(licen[cs]e|copying|copyright)([.\-_].*)?$"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
#: What tells the third clause of the BSD licences.
ENDORSE = r"(?i)endorse or promote"
#: Keys that a directory is salted with.
SALTS = 32


def _terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


#: The notices, and a tag by SPDX for each licence.
TEMPLATES = NOTICES + tuple((name, f"SPDX-License-Identifier: {name}", "spdx", " ".join(_terms(name)), "") for name in dict.fromkeys(n for n, *_ in NOTICES))


def weights(templates=TEMPLATES) -> tuple[list[tuple], dict[str, float], float]:
    """Rows (template, term, weight of unit length, 1 if it must be there, 1 if it must not), the terms' IDF, and the IDF of a term in no template."""
    counts = [Counter(_terms(t)) for _, t, *_ in templates]
    df = Counter(w for c in counts for w in c)
    idf = {w: math.log((1 + len(counts)) / (1 + n)) + 1 for w, n in df.items()}
    out = []
    for i, (c, (_, _, _, need, lack)) in enumerate(zip(counts, templates, strict=True)):
        norm, need, lack = math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items())), _terms(need), _terms(lack)
        out += [(i, w, c[w] * idf.get(w, 0.0) / norm, int(w in need), int(w in lack)) for w in sorted({*c, *lack})]
    return out, idf, math.log(1 + len(counts)) + 1


def directory(path: Column) -> Column:
    """Of a path, without its last part; the empty string at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan(files: DataFrame, key: str = "path", text: str = "text", header: float = 0.7) -> DataFrame:
    """files (key, path, text) -> key, path, license, score, basis ('header', 'file', 'inherited' or null), directory (that it is inherited from);
    a row for each row.

    The window with the best cosine wins, from `header` on; ties go to the earlier template. A licence file is one named so. Of a directory's licence files
    the best wins, ties go to the lesser path. Null and empty texts have no licence of their own, null paths inherit none. Extra columns are left out.
    Rows that repeat a key and a text get the same result, as do null keys. No rows give none.
    """
    spark = files.sparkSession
    terms, idf, other = weights()
    vector = F.broadcast(spark.createDataFrame(terms, "template int, term string, w double, need int, lack int"))
    known = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, idf double"))
    needs = F.array(*(F.lit(len(set(_terms(n)))) for *_, n, _ in TEMPLATES))
    names = F.array(*(F.lit(n) for n, *_ in TEMPLATES))
    anchors = sorted({x for _, _, x, *_ in TEMPLATES})
    specs = F.array(*(F.struct(F.lit(i).alias("template"), F.lit(x).alias("anchor"), F.lit(_terms(t).index(x)).alias("before"), F.lit(len(_terms(t))).alias("n")) for i, (_, t, x, *_) in enumerate(TEMPLATES)))
    rows = files.select(F.col(key).alias("id"), F.col("path").cast("string").alias("path"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    cued = rows.filter(F.col("text").rlike(rf"(?i)(?<![a-z0-9])(?:{'|'.join(anchors)})(?![a-z0-9])")).select("id", F.xxhash64("text").alias("h"), F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)).alias("t")).withColumn("row", F.monotonically_increasing_id())  # rows may repeat
    at = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda p: F.get("t", p).isin(anchors))
    window = lambda p, x: F.struct(x["template"].alias("template"), F.slice("t", F.greatest(F.lit(1), p - x["before"] + 1), x["n"]).alias("terms"))
    windows = F.array_distinct(F.flatten(F.transform(at, lambda p: F.transform(F.filter(specs, lambda x: x["anchor"] == F.get("t", p)), lambda x: window(p, x)))))
    units = cued.filter(F.size("t") > 0).select("id", "h", "row", F.posexplode(windows).alias("unit", "x")).select("id", "h", "row", "unit", "x.template", "x.terms")
    tf = F.transform(F.array_distinct("terms"), lambda w: F.struct(w.alias("term"), F.size(F.filter("terms", lambda y: y == w)).alias("n")))
    tf = units.select("id", "h", "row", "unit", "template", F.inline(tf)).join(known, "term", "left").join(vector, ["template", "term"], "left")
    idf_or_other = F.coalesce("idf", F.lit(other))
    # a window's rows come from one row and so stand in one task, in order: the sums are the same in every run
    sums = tf.groupBy("id", "h", "row", "unit", "template").agg(F.sum(F.col("n") * idf_or_other * F.coalesce("w", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.pow(F.col("n") * idf_or_other, F.lit(2)))).alias("norm"), F.sum("need").alias("need"), F.sum("lack").alias("lack"))
    scored = sums.filter((F.col("need") == F.get(needs, F.col("template"))) & (F.col("lack") == 0)).select("id", "h", F.struct((F.col("dot") / F.col("norm")).alias("score"), (-F.col("template")).alias("t")).alias("x"))
    best = keep(scored.groupBy("id", "h").agg(F.max("x").alias("x")).filter(F.col("x.score") >= header), "licence-scores").select(F.col("id").alias("id2"), F.col("h").alias("h2"), "x")
    named = F.coalesce(F.regexp_extract("path", r"[^/]*$", 0).rlike(FILE), F.lit(False))
    rows = rows.select("id", "path", F.xxhash64("text").alias("h"), named.alias("named"), directory(F.col("path")).alias("dir"), F.col("text").rlike(ENDORSE).alias("endorse"))
    rows = rows.join(best, F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")), "left").withColumn("is_file", F.col("named") & F.col("x").isNotNull())
    two, three = (F.lit(n) for n in ("BSD-2-Clause", "BSD-3-Clause"))
    own = F.get(names, -F.col("x.t"))
    rows = keep(rows.select("id", "path", "h", "dir", "is_file", F.col("x.score").alias("score"), F.when((own == two) & F.col("endorse"), three).otherwise(own).alias("own")), "licence-files")
    of_dir = rows.filter("is_file AND path IS NOT NULL").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "own")).alias("f"))
    above = lambda d: F.concat(F.array(F.lit("")), F.transform(F.filter(F.sequence(F.lit(1), F.length(d) + 1), lambda i: (d != "") & (F.substr(F.concat(d, F.lit("/")), i, F.lit(1)) == "/")), lambda i: F.substr(d, F.lit(1), i - 1)))
    need = rows.filter("own IS NULL AND path IS NOT NULL").select("dir").distinct().select("dir", F.explode(above(F.col("dir"))).alias("up"))
    near = need.join(of_dir.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max(F.struct(F.length("up").alias("n"), "up", "f")).alias("near"))
    near = near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.withColumn("salt", F.pmod(F.xxhash64("id", "path", "h"), F.lit(SALTS)).cast("int")).join(near, ["dir", "salt"], "left")
    inherits = F.col("own").isNull() & F.col("near").isNotNull() & F.col("path").isNotNull()
    basis = F.when(F.col("is_file"), "file").when(F.col("own").isNotNull(), "header").when(inherits, "inherited")
    licence, score = F.when(inherits, F.col("near.f.own")).otherwise(F.col("own")), F.when(inherits, -F.col("near.f.s")).otherwise(F.col("score"))
    return out.select(F.col("id").alias(key), *([] if key == "path" else ["path"]), licence.alias("license"), score.alias("score"), basis.alias("basis"), F.when(inherits, F.col("near.up")).alias("directory"))
