"""License notices in documents by MinHash bands over overlapping windows.

Templates are grouped by length: one of n shingles is sought in windows of W
shingles, W the power of two from 2 n on (8 at least), at every W / 2, so it
lies wholly in some window. Only windows that hold a template's shingle can
contain it and are laid. A window's MinHash has BANDS values, one a band; a
template contained in it to 0.8 is at least 0.16 of the union, so a band
agrees with that chance and some of the 64 with 1 - 0.84^64 > 0.99998.
Candidates are verified by exact containment of the template's shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylens import session
from quarrylens.llm import common, windows

BANDS = 64
LEAST_WINDOW = 8

# Notices that projects put on their files (public texts).
TEMPLATES = {
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS",
    ],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSD-4-Clause": [
        "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "EPL-1.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
    ],
    "GPL-2.0-or-later": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-2.0": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    ],
    "LGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
}
# Other SPDX identifiers than the names above.
SPDX = {
    "AGPL-3.0": ["AGPL-3.0-only", "AGPL-3.0-or-later"], "GPL-2.0": ["GPL-2.0-only"], "GPL-3.0": ["GPL-3.0-only", "GPL-3.0-or-later"],
    "LGPL-2.0": ["LGPL-2.0-only", "LGPL-2.0-or-later"], "LGPL-2.1": ["LGPL-2.1-only", "LGPL-2.1-or-later"],
    "LGPL-3.0": ["LGPL-3.0-only", "LGPL-3.0-or-later"],
}
for _name, _texts in TEMPLATES.items():
    _texts += [f"SPDX-License-Identifier: {i}" for i in (_name, *SPDX.get(_name, []))]


def template_table(spark: SparkSession, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """license, template_no, text"""
    rows = [(name, i, text) for name, texts in templates.items() for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "license string, template_no int, text string")


def _bands(h: str) -> Column:
    return F.expr(f"transform(sequence(0, {BANDS - 1}), b -> array_min(transform({h}, x -> xxhash64(x, b))))")


def licenses(docs: DataFrame, templates: DataFrame | None = None, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, license, template_no, containment, start (first word of the best
    window): one row per document and template found in it.

    A template is found where a window holds at least num / den of its distinct
    shingles (five words of letters and digits, lower-cased), unless templates of
    other licenses fit better (a larger share, or as large a one of more words)
    on half of the positions where it matches. Null and empty texts hold none;
    repeated rows (id and text) count once; a null id is an id of its own;
    templates of fewer than five words are sought as they are.
    """
    spark = docs.sparkSession
    given = templates if templates is not None else template_table(spark)
    n_words = F.size(windows.plain_words(F.col("text")))
    given = session.cut_lineage(given.select("license", "template_no", "text", n_words.alias("n_words")))
    t = windows.hashed(given.where(F.col("n_words") >= windows.SHINGLE), "license", "template_no", "n_words")
    t = t.withColumn("h", F.array_distinct("h")).withColumn("size", F.size("h"))
    doubled = F.ceil(F.log2((F.col("size") * 2).cast("double"))).cast("int")
    t = t.withColumn("m", F.greatest(F.lit(LEAST_WINDOW), F.expr("cast(1 AS int)") * F.pow(F.lit(2), doubled)).cast("int"))
    t = session.cut_lineage(t.withColumn("bands", _bands("h"))).where("size > 0")
    anchors = session.cut_lineage(t.select("m", F.explode("h").alias("x")).distinct())
    hits = windows.positions(docs).join(common.if_bounded(anchors), "x")
    step = F.col("m") / 2
    at = F.floor(F.col("pos") / step)
    spans = hits.select("doc_id", "key", "m", F.explode(F.array(at, F.greatest(at - 1, F.lit(0)))).alias("no"))
    spans = spans.select("doc_id", "key", (F.col("no") * step).cast("int").alias("s"), "m").distinct()
    cut = session.cut_lineage(windows.cut_out(docs, session.cut_lineage(spans)))
    probes = cut.select("doc_id", "key", "s", "m", "h", F.posexplode(_bands("h")).alias("band", "v"))
    known = t.select("license", "template_no", "n_words", "m", F.col("h").alias("ht"), F.posexplode("bands").alias("band", "v"))
    found = probes.join(known, ["m", "band", "v"]).dropDuplicates(["doc_id", "key", "s", "m", "license", "template_no"])
    found = found.withColumn("x", F.size(F.array_intersect("h", "ht"))).where(F.col("x") * den >= F.size("ht") * num)
    matched = "filter(transform(h, (y, i) -> CASE WHEN array_contains(ht, y) THEN s + i END), p -> p IS NOT NULL)"
    row = ["doc_id", "key", "s", "m", "license", "template_no"]
    found = found.select(*row, "n_words", (F.col("x") / F.size("ht")).alias("containment"), F.expr(matched).alias("at"))
    for n in range(1, windows.SHINGLE):
        short = given.where(F.col("n_words") == n)
        if not short.isEmpty():
            short = windows.hashed(short, "license", "template_no", "n_words", n=n).select(
                "license", "template_no", "n_words", F.explode("h").alias("x")
            )
            at = windows.positions(docs, n).join(common.if_bounded(session.cut_lineage(short)), "x")
            found = found.union(at.select(
                "doc_id", "key", F.col("pos").alias("s"), F.lit(n).alias("m"), "license", "template_no", "n_words",
                F.lit(1.0).alias("containment"), F.array("pos").alias("at"),
            ).distinct())
    # versions and variants of a license match on the same positions: the best fit stands
    placed = found.withColumn("fit", F.struct("containment", "n_words")).select(*row, "fit", F.explode("at").alias("pos"))
    best_here = F.max(F.struct("fit", "license")).over(Window.partitionBy("doc_id", "key", "pos"))
    placed = placed.withColumn("top", best_here)
    beaten = (F.col("top.fit") > F.col("fit")) & (F.col("top.license") != F.col("license"))
    kept = placed.groupBy(*row).agg(F.max("fit.containment").alias("containment"), F.avg(beaten.cast("int")).alias("lost"))
    best = F.max(F.struct("containment", (-F.col("s")).alias("back")))
    out = kept.where("lost < 0.5").groupBy("doc_id", "license", "template_no").agg(best.alias("best"))
    return out.select(
        "doc_id", "license", "template_no", "best.containment", (-F.col("best.back")).cast("long").alias("start")
    )
