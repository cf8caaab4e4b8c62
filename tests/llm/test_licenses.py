"""Licence scans against plain cosines, and inheritance on small trees."""

import math
import re
from collections import Counter

import pytest
from tamis.llm import licenses as lic

from tests.llm.helpers import texts

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)"


def frame(spark, rows):
    return spark.createDataFrame([(i, p, t, 1.0, "x") for i, p, t in rows], "doc_id long, path string, text string, score double, dir string")


def plain(text):
    """The best template of any window: (score, licence)."""
    split = lambda t: re.findall(lic.TERM, t.lower())
    counts = [Counter(split(t)) for _, t, *_ in lic.TEMPLATES]
    df = Counter(w for c in counts for w in c)
    idf = lambda w: math.log((1 + len(counts)) / (1 + df[w])) + 1
    terms, best = split(text), (0.0, None)
    for (name, t, anchor, need, lack), c in zip(lic.TEMPLATES, counts, strict=True):
        t = split(t)
        for p in (p for p, w in enumerate(terms) if w == anchor):
            start = max(0, p - t.index(anchor))
            a = Counter(terms[start : start + len(t)])
            if set(split(need)) <= set(a) and not set(split(lack)) & set(a):
                dot = sum(n * idf(w) * c[w] * idf(w) for w, n in a.items())
                s = dot / math.sqrt(sum((n * idf(w)) ** 2 for w, n in a.items()) * sum((n * idf(w)) ** 2 for w, n in c.items()))
                best = (s, name) if s > best[0] + 1e-12 else best
    return best


#: (text, licence), headers and openings of whole licence files among them.
CASES = [
    ("// Licensed under the Apache License, Version 2.0 (the License);\n// you may not use this file except in compliance\n// with the License.\n// You may obtain\n// a copy\n// of the License at\nint x;", "Apache-2.0"),
    ("Some words before it. Released under the MIT License. " + "And many words more behind it. " * 3000, "MIT"),
    ("# SPDX-License-Identifier: Apache-2.0\nimport os", "Apache-2.0"), ("// SPDX-License-Identifier: MIT", "MIT"), ("/* SPDX-License-Identifier: LGPL-2.1-or-later */", "LGPL-2.1"),
    ("GNU GENERAL PUBLIC LICENSE\n   Version 1, February 1989\n\nCopyright (C) 1989 Free Software Foundation", "GPL-1.0"),
    ("GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991\n\nCopyright (C) 1989, 1991", "GPL-2.0"),
    ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nuse the GNU Lesser General Public License instead. See section 13 of the GNU Affero General Public License.", "GPL-3.0"),
    ("GNU LIBRARY GENERAL PUBLIC LICENSE\nVersion 2, June 1991", "LGPL-2.0"), ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999\n the ordinary GNU General Public License, version 2, instead", "LGPL-2.1"),
    ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n version 3 of the GNU General Public License", "LGPL-3.0"), ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007", "AGPL-3.0"),
    ("GNU Free Documentation License\nVersion 1.3, 3 November 2008", "GFDL-1.3"), ("MOZILLA PUBLIC LICENSE\nVersion 1.1", "MPL-1.1"), ("Mozilla Public License Version 2.0\n====", "MPL-2.0"),
    ('The "Artistic License"\n\nPreamble\n\nThe intent of this document is to state the conditions', None), ("Apache License 1.1 and nothing else", None),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:", "BSD-2-Clause"),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\nNeither the name nor the names may be used to endorse or promote products", "BSD-3-Clause"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under CC BY-NC-SA 4.0.", None),
    ("copyright 1999 somebody", None), ("the gnu at the zoo, and a letter from MIT", None), ("mit", None),
]


def test_headers(spark):
    rows = [(i, f"d{i}/f.txt", t) for i, t in texts()] + [(8000 + i, f"a{i}/b.c", t) for i, (t, _) in enumerate(CASES)]
    out = {r.doc_id: r for r in lic.scan(frame(spark, rows), "doc_id").collect()}
    assert len(out) == len(rows)
    for i, (t, want) in enumerate(CASES):
        assert out[8000 + i].license == want, (t[:200], out[8000 + i])
    for i, _, t in rows:
        s, name = plain(t or "")
        if s >= 0.7:
            name = "BSD-3-Clause" if name == "BSD-2-Clause" and re.search(lic.ENDORSE, t) else name
            assert out[i].license == name and out[i].score == pytest.approx(s) and out[i].basis == "header", i
        else:
            assert out[i].license is None and out[i].basis is None, i
    assert any(r.license for i, r in out.items() if i < 8000)


def test_every_template_is_its_own_licence(spark):
    rows = [(i, f"{i}/x.py", t) for i, (_, t, *_) in enumerate(lic.TEMPLATES)]
    out = {r.doc_id: (r.license, r.score) for r in lic.scan(frame(spark, rows), "doc_id").collect()}
    for i, (name, *_) in enumerate(lic.TEMPLATES):
        assert out[i][0] == name and out[i][1] == pytest.approx(1), (i, name, out[i])


def test_inheritance(spark):
    rows = [(1, "LICENSE", MIT), (2, "src/a.py", "x"), (3, "src/lib/COPYING.txt", "GNU General Public License Version 3, 29 June 2007 Everyone is permitted to copy"), (4, "src/lib/deep/b.py", ""), (5, "src/lib2/c.py", None), (6, "top.py", "y"), (7, None, "z"), (8, "src/lib/deep/d.py", "Released under the MIT License."), (8, "src/lib/deep/d.py", "Released under the MIT License."), (None, "src/e.py", "x")]
    out = list((str(r.doc_id), r.license, r.basis, r.directory) for r in lic.scan(frame(spark, rows), "doc_id").collect())
    out.sort(key=str)
    assert out == sorted([("1", "MIT", "file", None), ("2", "MIT", "inherited", ""), ("3", "GPL-3.0", "file", None), ("4", "GPL-3.0", "inherited", "src/lib"), ("5", "MIT", "inherited", ""), ("6", "MIT", "inherited", ""), ("7", None, None, None), ("8", "MIT", "header", None), ("8", "MIT", "header", None), ("None", "MIT", "inherited", "")], key=str)
    assert lic.scan(frame(spark, rows).limit(0), "doc_id").count() == 0


def test_query_inherits(spark, tmp_path):
    """Some documents of the query's tree are licence files by name, so others inherit from the nearest one."""
    from tamis.llm.queries import op1_license_scan

    rows = [(20, "Released under the MIT License.", "en", "s"), (21, "no licence", "en", "s"), (60, "Licensed under the Apache License, Version 2.0.", "en", "s"), (22, "none", "de", "s"), (23, "none", "de", "t"), (24, "Released under the MIT License.", None, None), (None, "none", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: (r.license, r.basis, r.directory) for r in op1_license_scan(spark, str(tmp_path)).collect()}
    assert out == {20: ("MIT", "file", None), 21: ("MIT", "inherited", "s/en"), 60: ("Apache-2.0", "file", None), 22: ("Apache-2.0", "inherited", "s"), 23: (None, None, None), 24: ("MIT", "header", None), None: ("Apache-2.0", "inherited", "s")}
