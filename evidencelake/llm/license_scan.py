"""License scan with DataFrame functions only.

Words (lower-case runs of letters and digits) of texts and templates give five-word
shingles. Of a text only shingles that some template has can count, so the others go at
once. Overlapping windows of the rest get MinHash values; each is a band of its own, and a
text window is compared with the templates that it shares a band with. The number of bands
follows from the least similarity at which retrieval must succeed with the wanted
probability. What is retrieved is verified: the share of the template's shingles that the
window contains.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 5
CONTAINMENT = 0.8
RECALL = 0.99999
MAX_SHINGLES = 5000
WORD_BREAK = r"[^\p{L}\p{N}]+"

#: Notices by which texts are licensed.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        'License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law '
        'or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        'CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and '
        'limitations under the License.'
    ),
    "mit-line": "Released under the MIT License.",
    "mit-permission": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation '
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        'modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software '
        'is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be '
        'included in all copies or substantial portions of the Software.'
    ),
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program "
        "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "isc-permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "cc-by-4.0-line": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-4.0-short": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-nd-4.0-short": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-nc-sa-4.0-short": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nd-4.0-short": "Licensed under CC BY-ND 4.0.",
    "cc-by-sa-4.0-short": "Licensed under CC BY-SA 4.0.",
}


def bands_for(least: float, recall: float = RECALL) -> int:
    """Bands of one MinHash value each that find a similarity of ``least`` with ``recall``."""
    return 1 if least >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - least))


def least_jaccard(sizes: Mapping[str, tuple[int, int]], containment: float = CONTAINMENT) -> float:
    """The least similarity of a template (its shingles, reach) and a window that contains
    ``containment`` of it, where all other places of the window hold shingles of other
    templates."""
    least = 1.0
    for n, reach in sizes.values():
        shared = max(1, math.ceil(containment * n - 1e-9))
        least = min(least, shared / (n + max(2 * reach - shared, 0)))
    return least


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD_BREAK, -1), lambda x: x != "")


def _shingles(text: Column) -> Column:
    """Array of (at, h): place and hash of each run of five words."""

    def all_of(own: Column) -> Column:
        return F.when(
            F.size(own) >= WIDTH,
            F.transform(
                F.sequence(F.lit(0), F.size(own) - WIDTH),
                lambda i: F.struct(i.alias("at"), F.xxhash64(*(F.get(own, i + k) for k in range(WIDTH))).alias("h")),
            ),
        )

    return F.flatten(F.transform(F.array(_words(text)), all_of))


def _templates(spark, templates: Mapping[str, str]) -> DataFrame:
    """(template, reach, shingles): a template's window is ``2 * reach`` shingles long; reach
    is its own number of shingles, or the next power of two, so that there are few kinds of
    windows. Longer windows would hold more of other templates and hide a short one."""
    rows = spark.createDataFrame(sorted(templates.items()), "template string, text string")
    rows = rows.select("template", F.array_distinct(F.transform(_shingles(F.col("text")), lambda x: x["h"])).alias("shingles"))
    return rows.withColumn("reach", F.pow(F.lit(2), F.ceil(F.log2(F.size("shingles")))).cast("int"))


def scan(
    df: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    containment: float = CONTAINMENT,
    bands: int | None = None,
) -> DataFrame:
    """One row for each row of ``df``: id and licenses, an array of (template, containment,
    word) by template; ``word`` is where its first shingle stands in the best window.

    A template matches where a window of ``2 * reach`` consecutive shingles, which start at
    each multiple of reach, contains ``containment`` or more of its distinct shingles. Null,
    empty and short texts match nothing. Rows with equal id and text have equal results.
    A template must have five words or more, and all together ``MAX_SHINGLES`` shingles at
    most, which bounds what is broadcast. Texts are not shuffled: only shingles that occur in
    a template leave their row.
    """
    spark = df.sparkSession
    known = _templates(spark, templates)
    vocabulary = known.select("reach", F.explode("shingles").alias("h"), "template").collect()
    if {r["template"] for r in vocabulary} != set(templates):
        raise ValueError("a template has fewer than five words")
    if len(vocabulary) > MAX_SHINGLES:
        raise ValueError(f"templates have more than {MAX_SHINGLES} shingles")
    hashes = sorted({r["h"] for r in vocabulary})
    sizes = {name: (n, reach) for (name, reach), n in Counter((r["template"], r["reach"]) for r in vocabulary).items()}
    bands = bands or bands_for(least_jaccard(sizes, containment))

    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("code"), F.col(text_col).alias("text"))
    hits = rows.select(
        "id",
        "code",
        F.explode(F.filter(_shingles(F.col("text")), lambda x: x["h"].isin(hashes))).alias("s"),
    ).select("id", "code", "s.*")
    kinds = F.broadcast(spark.createDataFrame(sorted({(r["h"], r["reach"]) for r in vocabulary}), "h long, reach int"))
    at = F.floor(F.col("at") / F.col("reach"))
    placed = hits.join(kinds, "h").select("id", "code", "reach", "h", "at", F.explode(F.array(at - 1, at)).alias("window"))
    values = [F.min(F.xxhash64("h", F.lit(k))).alias(f"b{k}") for k in range(bands)]
    windows = placed.groupBy("id", "code", "reach", "window").agg(
        F.collect_set("h").alias("own"),
        F.collect_set(F.struct("at", "h")).alias("places"),
        *values,
    )
    banded = windows.select(
        "id",
        "code",
        "reach",
        "window",
        "own",
        "places",
        F.posexplode(F.array(*(f"b{k}" for k in range(bands)))).alias("band", "value"),
    )

    sketch = known.select("template", "reach", "shingles", F.explode("shingles").alias("h")).groupBy("template", "reach", "shingles").agg(*values)
    sketch = F.broadcast(
        sketch.select("template", "reach", "shingles", F.posexplode(F.array(*(f"b{k}" for k in range(bands)))).alias("band", "value"))
    )
    found = banded.join(sketch, ["reach", "band", "value"])
    share = F.size(F.array_intersect("own", "shingles")) / F.size("shingles")
    first = F.array_min(F.transform(F.filter("places", lambda x: F.array_contains("shingles", x["h"])), lambda x: x["at"]))
    found = found.select("id", "code", "template", share.alias("containment"), first.alias("word")).where(F.col("containment") >= containment)
    best = found.groupBy("id", "code", "template").agg(F.max(F.struct("containment", (-F.col("word")).alias("before"))).alias("m"))
    best = best.groupBy("id", "code").agg(
        F.array_sort(
            F.collect_list(F.struct("template", F.col("m.containment").alias("containment"), (-F.col("m.before")).cast("long").alias("word")))
        ).alias("licenses")
    )
    best = best.select(F.col("id").alias("id2"), F.col("code").alias("code2"), "licenses")
    every = rows.select("id", "code").join(best, F.col("id").eqNullSafe(F.col("id2")) & (F.col("code") == F.col("code2")), "left")
    return every.select(F.col("id").alias(id_col), F.coalesce("licenses", F.array().cast(best.schema["licenses"].dataType)).alias("licenses"))
