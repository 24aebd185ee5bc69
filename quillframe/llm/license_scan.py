"""License scans: min-hash bands over overlapping windows of text retrieve templates, exact containment verifies them.

Words are lower-cased runs of letters and digits; shingles are ``SHINGLE`` words. A text is cut into windows of
``WINDOW`` words, one every ``STRIDE``; so is every template, at every word and clipped at its ends, so that some pair
of windows shares at least the fraction ``SHARED`` of its shingles wherever a template stands in a text. Each window
has ``bands_for(SHARED, MISS)`` min-hashes, each a band of its own: the chance that such a pair meets in none is below
MISS, and a notice of several windows has as many chances. A retrieved template counts if the stretch of text around
the window holds at least ``CONTAINED`` of the template's shingles, exactly, and of what tells it from the template of
another license that is nearly the same (each run of shingles that the other lacks: a version, "lesser", "affero") one or
more shingles; else a license would be reported that differs from the text's own by one word. A template that is part of
another license's (two clauses of three) does not count where that one stands. The bands find a template that stands
as it is; how often they find edited ones at the bound of containment is measured in the tests.

A window without a shingle of any template cannot meet one in a band, as a min-hash is the hash of a shingle; texts
that have none at all are not windowed. Column functions only; the texts are read once and not shuffled, only windows
that met a template are; what is broadcast has the size of the template list.

Defined results: null, empty and wordless texts, and texts shorter than a shingle, match nothing; equal rows give one
row, and rows of one id with different texts one row for each license found in any; ties between stretches go to the first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.llm._common import bound, row_key

SHINGLE, WINDOW, STRIDE = 3, 8, 4
SHARED, MISS, CONTAINED = 0.5, 1e-3, 0.8

# Wordings of public licenses and of common notices that name them. The notices of the GNU licenses differ in what
# names the license alone, as a word like program or library would count as telling them apart.
GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
TEMPLATES = (
    ("MIT", GRANT + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT-0", GRANT + "."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("BSD-2-Clause", BSD),
    ("BSD-4-Clause", BSD + " All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by"),
    ("BSD-3-Clause", BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-2.1", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License."),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("PostgreSQL", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."),
    ("NCSA", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal with the Software without restriction"),
    ("Artistic-2.0", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed."),
    ("MS-PL", "This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software."),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("PSF-2.0", "This LICENSE AGREEMENT is between the Python Software Foundation (\"PSF\"), and the Individual or Organization (\"Licensee\") accessing and otherwise using this software"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def bands_for(shared: float, miss: float) -> int:
    """The fewest bands of one min-hash each in which windows with that Jaccard index fail to meet with a chance of at most miss."""
    return math.ceil(math.log(miss) / math.log(1 - shared))


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9\x80-\U0010FFFF]+", text.lower()) if w]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^a-z0-9\x{80}-\x{10FFFF}]+"), "")


def shingles(of: Column) -> Column:
    """Hashes of the shingles of an array of words, in order."""

    def hashed(own: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(own) - SHINGLE), lambda i: F.xxhash64(*(F.get(own, i + k) for k in range(SHINGLE))))

    return bound(of, lambda own: F.when(F.size(own) >= SHINGLE, hashed(own)).otherwise(F.array().cast("array<bigint>")))


def bands(window: Column, n: int) -> Column:
    return F.array(*(F.array_min(F.transform(window, lambda h: F.xxhash64(h, F.lit(seed)))) for seed in range(n)))  # noqa: B023


def library(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """template, license, shingles (distinct) and windows, an array of clipped windows of shingles."""
    rows = [(k, name, template_words(text)) for k, (name, text) in enumerate(templates)]
    df = spark.createDataFrame(rows, "template int, license string, words array<string>").withColumn("own", shingles(F.col("words")))
    width = WINDOW - SHINGLE + 1
    starts = F.sequence(F.lit(1 - width // 2), F.size("own") - width // 2)
    clipped = F.transform(starts, lambda s: F.slice("own", F.greatest(s, F.lit(1)), F.least(s + width - 1, F.size("own")) - F.greatest(s, F.lit(1)) + 1))
    return df.where(F.size("own") > 0).select("template", "license", F.array_distinct("own").alias("shingles"), clipped.alias("windows"))


def telling(own: list[int], others: list[list[int]]) -> list[list[int]]:
    """The runs of a template's shingles that templates of other licenses lack which hold CONTAINED of it."""
    runs = set()
    for other in map(set, others):
        if sum(h in other for h in own) < CONTAINED * len(own):
            continue
        for lacks, run in itertools.groupby(own, lambda h: h not in other):  # noqa: B023
            if lacks:
                runs.add(tuple(run))
    return [list(run) for run in sorted(runs)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """A row for each document and license found in it: id, license, containment (the best) and first_word, where its best stretch's window begins."""
    spark = docs.sparkSession
    n, width = bands_for(SHARED, MISS), WINDOW - SHINGLE + 1
    known = library(spark, templates).collect()  # of the size of the template list
    vocabulary = sorted({h for r in known for h in r.shingles})
    longest = max((len(template_words(text)) for _, text in templates), default=0)

    longer = lambda r: [o.template for o in known if o.license != r.license and len(o.shingles) > len(r.shingles) and len({*r.shingles} & {*o.shingles}) >= CONTAINED * len(r.shingles)]
    rows = [(r.template, r.license, r.shingles, telling(r.shingles, [o.shingles for o in known if o.license != r.license and o.template not in longer(r)]), longer(r), r.windows) for r in known]
    table = spark.createDataFrame(rows, "template int, license string, shingles array<bigint>, telling array<array<bigint>>, longer array<int>, windows array<array<bigint>>")
    met = table.select("template", F.explode("windows").alias("window")).select("template", F.explode(bands(F.col("window"), n)).alias("band")).distinct()

    cut = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row"), shingles(words(F.coalesce(F.col(text_col), F.lit("")))).alias("own"))
    cut = cut.where(F.arrays_overlap("own", F.lit(vocabulary).cast("array<bigint>")))
    starts = F.sequence(F.lit(0), F.greatest(F.size("own") - 1, F.lit(0)), F.lit(STRIDE))
    windows = cut.select("id", "row", "own", F.explode(starts).alias("at"))
    begin = F.greatest(F.col("at") - longest, F.lit(0))
    windows = windows.select("id", "row", "at", F.slice("own", F.col("at") + 1, F.lit(width)).alias("window"), F.slice("own", begin + 1, F.lit(2 * longest + width)).alias("stretch"), begin.alias("begin"))
    windows = windows.where(F.arrays_overlap("window", F.lit(vocabulary).cast("array<bigint>")))
    # of the size of the template list, whatever the corpus: a window that meets a template by several bands is verified as often
    found = windows.select("id", "row", "at", "stretch", "begin", F.explode(F.array_distinct(bands(F.col("window"), n))).alias("band")).join(F.broadcast(met), "band").drop("band")
    found = found.join(F.broadcast(table.drop("windows")), "template")
    size = F.size("shingles")
    low = F.greatest(F.col("at") - size - SHINGLE - F.col("begin"), F.lit(0))
    near = F.slice("stretch", low + 1, F.col("at") - F.col("begin") - low + size + SHINGLE + width)
    held = F.size(F.array_intersect(near, "shingles")) / size
    told = F.forall("telling", lambda run: F.arrays_overlap(near, run))
    found = found.where(told).select("id", "row", "template", "license", "longer", "at", held.alias("containment")).where(F.col("containment") >= CONTAINED)
    # of templates that stand at one place, as two versions of a license do, the closest counts, and a whole before its part
    place = Window.partitionBy("row", "at")
    found = found.withColumn("here", F.collect_set("template").over(place)).where(~F.arrays_overlap("longer", "here"))
    found = found.withColumn("most", F.max("containment").over(place)).where("containment = most")
    best = found.groupBy("id", "license").agg(F.max(F.struct("containment", (-F.col("at")).alias("at"))).alias("best"))
    return best.select(F.col("id").alias(id_col), "license", F.col("best.containment").alias("containment"), (-F.col("best.at")).cast("long").alias("first_word"))
