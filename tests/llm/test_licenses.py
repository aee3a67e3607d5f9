import math
import random
from collections import Counter

from tidewharf.llm import licenses as lic

FILES = "path string, text string"


def brute(files):
    """Licenses by dense vectors and a walk up the directories."""
    lines = [lic.words_of(x) for _, t in files for x in (t or "").split("\n")]
    lines = [w for w in lines if w]
    held = Counter(w for line in lines for w in set(line))
    known = {w for _, t in lic.TEMPLATES for w in lic.words_of(t)}
    n = len(lines)

    def vector(words):
        return {w: c * (math.log((1 + n) / (1 + held[w])) + 1 if w in known
                        else math.log(1 + max(n, 1)) + 1) for w, c in Counter(words).items()}

    def cosine(a, b):
        dot = sum(x * b.get(w, 0) for w, x in a.items())
        return dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    own, licensed = [], {}
    vectors = [(name, vector(lic.words_of(t))) for name, t in lic.TEMPLATES]
    for path, text in files:
        found = []
        for section in lic.sections(text or ""):
            near = {}
            for name, t in vectors:
                near[name] = max(near.get(name, 0), round(cosine(vector(section), t), 9))
            first, second = sorted((-c, name) for name, c in near.items())[:2]
            if -first[0] >= lic.MIN_COSINE and second[0] - first[0] >= lic.MARGIN:
                found.append(first)
        best = min(found, default=(0, None))
        name = best[1]
        own.append(name)
        if name and path is not None and len(lic.words_of(text)) <= lic.FILE_WORDS:
            folder = path.rpartition("/")[0]
            licensed.setdefault(folder, []).append((best[0], name))
    out = []
    for (path, _), name in zip(files, own):
        origin, source = ("own", None) if name else (None, None)
        if not name and path is not None:
            folder = path.rpartition("/")[0]
            while True:
                if folder in licensed:
                    name, origin, source = min(licensed[folder])[1], "inherited", folder
                    break
                if not folder:
                    break
                folder = folder.rpartition("/")[0]
        out.append((path, name, origin, source))
    return sorted(out, key=repr)


def tree(seed, n=90):
    rng = random.Random(seed)
    files = []
    for _ in range(n):
        folder = "/".join(rng.choice("abc") for _ in range(rng.randint(0, 4)))
        text = " ".join(rng.choice(("alpha", "beta", "the", "of", "work", "license", "under"))
                        for _ in range(rng.randint(0, 40)))
        if rng.random() < 0.2:
            notice = rng.choice(lic.TEMPLATES)[1]
            text = rng.choice((notice, f"{text}\n{notice}", f"{notice.upper()}\n\n{text}",
                               notice.replace(" the", " this"), notice.replace(", ", ",\n")))
        files.append((f"{folder}/f{rng.randrange(10**6)}".lstrip("/"), text))
    return files + [(None, "Released under the MIT License."), (None, None), ("a/x", ""),
                    ("top", None), files[0], ("a/b/c/LICENSE", "Licensed under CC BY 4.0.\n" + "x " * 99)]


def result(df):
    return sorted(((r.path, r.license, r.origin, r.licensed_by) for r in lic.scan(df).collect()),
                  key=repr)


def test_as_brute_force(spark):
    for seed in (1, 2):
        files = tree(seed)
        expected = brute(files[:-1])
        assert result(spark.createDataFrame(files[:-1], FILES).repartition(3)) == expected
        assert {e[2] for e in expected} == {"own", "inherited", None}


def test_a_long_file_with_a_licence_files_name(spark):
    files = tree(3)[-1:] + [("a/b/c/d/e", "plain"), ("a/b/z", "plain")]
    assert result(spark.createDataFrame(files, FILES)) == [
        ("a/b/c/LICENSE", "CC-BY-4.0", "own", None),
        ("a/b/c/d/e", "CC-BY-4.0", "inherited", "a/b/c"), ("a/b/z", None, None, None)]


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([("d/f", "Released under the MIT License.", "mine", 3)],
                               "path string, text string, license string, dir int")
    assert lic.scan(df).select("license", "dir", "origin").collect() == [("MIT", 3, "own")]
    assert lic.scan(df.limit(0)).collect() == []


def test_a_very_long_text(spark):
    text = "filler words\n" * 100_000 + "Released under the MIT License."
    assert result(spark.createDataFrame([("a/b", text)], FILES)) == [("a/b", "MIT", "own", None)]


FILLER = [(f"z/{i}", " ".join(random.Random(i).choices([f"w{j}" for j in range(5000)], k=12)) + "\nthe of and to")
          for i in range(400)]


def licenses_of(spark, texts):
    files = [(f"d{i}/x", t) for i, t in enumerate(texts)]
    got = {r.path: r.license for r in lic.scan(spark.createDataFrame(files + FILLER, FILES)).collect()}
    return [got[path] for path, _ in files]


def test_headers_that_are_not_the_templates(spark):
    cases = [
        ("SPDX-License-Identifier: MIT", "MIT"), ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
        ("# SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"), ("MIT License", "MIT"),
        ("Apache License\n   Version 2.0, January 2004", "Apache-2.0"),
        ("GNU GENERAL PUBLIC LICENSE\n Version 2, June 1991", "GPL-2.0"),
        ("Copyright (c) 2021 Example Inc. Released under the MIT License.", "MIT"),
        ("This file is part of Example. It is licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
         "CC-BY-NC-4.0"),
        ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU"
         " Affero General Public License as published\nby the Free Software Foundation, either version 3 of the"
         " License, or\n(at your option) any later version.", "AGPL-3.0"),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser"
         " General Public License as published by the Free Software Foundation; either version 2.1 of the License,"
         " or (at your option) any later version.", "LGPL-2.1"),
        ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is"
         " hereby granted, provided that the above copyright notice and this permission notice appear in all"
         " copies.", "ISC"),
        ("The Unlicense", "Unlicense"), ("License: BSD 2-Clause License", "BSD-2-Clause"),
        # Nothing, or not which.
        ("GNU General Public License", None), ("All rights reserved.", None), ("License", None),
        ("He got his driving license at MIT in the version of 2004.", None),
        ("We apply the rules of the public and the terms of this work under no license.", None),
    ]
    assert list(zip([t for t, _ in cases], licenses_of(spark, [t for t, _ in cases]))) == cases


def test_whole_license_files(spark):
    mit = f"MIT License\n\nCopyright (c) 2020 A. Person\n\n{lic._MIT_START}\n\n{lic._MIT_END}"
    lines = "\n".join(lic._MIT_START[i:i + 70] for i in range(0, len(lic._MIT_START), 70))
    two = f"Copyright (c) 2020, Somebody\nAll rights reserved.\n\n{lic._BSD_START}\n\n{lic._BSD_TWO}\n\n{lic._BSD_END}"
    three = two.replace(lic._BSD_END, f"{lic._BSD_THIRD}\n\n{lic._BSD_END}")
    assert licenses_of(spark, [mit, lines, two, three]) == ["MIT", "MIT", "BSD-2-Clause", "BSD-3-Clause"]
    files = [("a/LICENSE", three), ("a/b/code.py", "x = 1"), ("a/COPYING.txt", None), ("c/code.py", "x = 2")]
    assert result(spark.createDataFrame(files, FILES)) == [
        ("a/COPYING.txt", "BSD-3-Clause", "inherited", "a"), ("a/LICENSE", "BSD-3-Clause", "own", None),
        ("a/b/code.py", "BSD-3-Clause", "inherited", "a"), ("c/code.py", None, None, None)]


def test_clashing_inner_names(spark):
    df = spark.createDataFrame([("d/f", "Released under the MIT License.", "o", 1, "l", "w", True)],
                               "path string, text string, __own string, __license int, row string, dir string,"
                               " is_file boolean")
    row = lic.scan(df).first()
    assert row.asDict() == {"path": "d/f", "__own": "o", "__license": 1, "row": "l", "dir": "w", "is_file": True,
                            "license": "MIT", "cosine": row.cosine, "origin": "own", "licensed_by": None}
