"""License scan: a trained paragraph classifier with a calibrated unknown class, confirmed by templates.

A paragraph is a line. Its hashed word 1- and 2-grams (and a mark for a version number next to a word) go
through a multinomial logistic regression over the licence families and ``unknown``, trained in numpy on
variants of the templates below and on unrelated sentences. Logits are divided by a temperature and a
family is named only at the probability that a held-out half of the variants calibrates; else the
paragraph is unknown. A named family is confirmed if a template of that family resembles the paragraph;
a paragraph of one or two words, if a title or tag of the family stands in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paritylab.llm.common import gram_hashes, lean, mix64, prefix_hash, range_hash, share, slices, spread_symbols, texts_of

BUCKETS = 1 << 15
UNKNOWN = "unknown"
#: Least share of a template's or the paragraph's word 3-grams (whichever has fewer) that both must have.
CONFIRM = 0.5
#: Least share of correct families among the held-out variants at or above the calibrated probability.
PRECISION = 0.995

#: Notices and opening paragraphs of public licences.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL version 3 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU GPL version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Licensed under the 3-Clause BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, you can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
        "Released under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "Proprietary": [
        "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
        "Copyright, all rights reserved. Proprietary and confidential.",
    ],
}
#: Titles and metadata lines, which are templates too. Those of one or two words confirm lines of one or two words.
TITLES: dict[str, list[str]] = {
    "MIT": ["MIT License", "The MIT License", "License: MIT", "MIT Licensed"],
    "Apache-2.0": ["Apache License", "Apache License 2.0", "License: Apache-2.0", "Apache-2.0"],
    "GPL-3.0": ["GPLv3", "GPL v3", "GNU GPLv3", "License: GPLv3", "License: GPL-3.0"],
    "GPL-2.0": ["GPLv2", "GPL v2", "GNU GPLv2", "License: GPLv2", "License: GPL-2.0"],
    "LGPL": ["LGPL", "GNU LGPL", "License: LGPL", "LGPLv3", "GNU Lesser General Public License"],
    "BSD": ["BSD License", "License: BSD", "License: BSD-3-Clause"],
    "MPL-2.0": ["MPLv2", "License: MPL-2.0", "Mozilla Public License"],
    "ISC": ["ISC License", "License: ISC"],
    "CC-BY-NC": ["CC BY-NC", "License: CC BY-NC 4.0"],
    "CC-BY-SA": ["CC BY-SA", "License: CC BY-SA 4.0"],
    "CC-BY": ["CC BY", "License: CC BY 4.0"],
    "CC0": ["CC0", "License: CC0"],
    "Unlicense": ["Unlicense", "The Unlicense", "License: Unlicense"],
    "Proprietary": ["Proprietary License", "License: Proprietary"],
}
#: Sentences that share words with licences and are none.
OTHERS = [
    "The driver showed a valid license at the border and was released without charge.", "Permission denied while opening the file for writing.",
    "A fishing license costs twenty dollars and is valid for one year.", "The new version of the software was released on Monday.",
    "Please see the documentation for version 2.0 of the public interface.", "The general public was free to attend the work of art.",
    "Under the terms of the agreement both parties share the costs.", "The university was founded under a royal licence in 1592.",
    "Copies of the report were distributed to all members without restriction.", "He works under the general, who was released last year.",
    "The source of the river is subject to heavy rain.", "This library opens at nine and is free for students.",
    "Apache helicopters were seen above the mountains.", "MIT researchers published a study on sleep.", "She was granted free access to the archive.",
    "We reserve the right to change the schedule at any time.", "The restaurant is licensed to sell beer and wine.", "Commons and lords met for the first time.",
    "License", "The license", "Driver license", "Software license", "License agreement", "License: unknown", "License: none", "General public", "Public library", "MIT", "MIT students", "Apache", "Apache server",
]
FRAMES = ["{}", "{}", "This file is part of the project. {}", "{} See the file for details.", "Copyright (c) 2019 The Authors. {}", "Note: {}", "# {}", "* {}"]
WORD = re.compile(r"[^\W_]+")
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
FAMILIES = [UNKNOWN, *TEMPLATES]


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, paragraph, words of each paragraph) of the hashed word 1- and 2-grams; paragraphs in lower case."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    edge = np.diff(np.concatenate([[0], IS_WORD[data].view(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    word = range_hash(prefix_hash(spread_symbols(np.arange(256))[data]), first, last)
    where = np.searchsorted(starts, first, side="right") - 1
    pair = gram_hashes(word, 2)
    inside = where[:-1] == where[1:] if len(where) > 1 else np.zeros(0, bool)
    bucket = np.concatenate([mix64(word), mix64(pair[inside])]) % np.uint64(BUCKETS)
    return bucket.astype(np.int64), np.concatenate([where, where[:-1][inside] if len(where) > 1 else where[:0]]), np.bincount(where, minlength=len(texts))


def normal(paragraph: str) -> bytes:
    return paragraph.lower().encode("utf-8", "surrogatepass")


def variants(rng: np.random.Generator, each: int) -> tuple[list[bytes], np.ndarray]:
    """Framed templates with some words lost, foreign words between, or the end cut, and other sentences likewise."""
    texts, y = [], []
    syllables = ["th", "er", "on", "an", "re", "ou", "ti", "sch", "eau", "ción", "en", "de", "la", "ing", "ble"]
    invent = lambda: "".join(rng.choice(syllables, rng.integers(1, 5)))
    for label, family in enumerate(FAMILIES):
        pool = [*TEMPLATES[family], *TITLES[family]] if label else OTHERS
        for template in pool:
            for n in range(each):
                words = template.split()
                if n % 3 and len(words) > 12:
                    words = [w for w in words if rng.random() > 0.1]
                    words = words[:max(12, int(len(words) * rng.uniform(0.5, 1)))]
                text = " ".join(words)
                if n % 4 == 3:
                    extra = [invent() for _ in range(rng.integers(1, 12))]
                    text = " ".join([*extra, text]) if n % 8 == 3 else " ".join([text, *extra])
                texts.append(normal(str(rng.choice(FRAMES)).format(text)))
                y.append(label)
    for _ in range(60 * each):
        texts.append(normal(" ".join(invent() for _ in range(rng.integers(1, 40)))))
        y.append(0)
    for _ in range(6 * each):  # single words of licences among others
        pick = [str(rng.choice(str(rng.choice(TEMPLATES[str(rng.choice(list(TEMPLATES)))])).split())) for _ in range(2)]
        texts.append(normal(" ".join([*(invent() for _ in range(rng.integers(3, 15))), *pick])))
        y.append(0)
    return texts, np.array(y)


class LicenseModel:
    """Weights per bucket and family, the temperature and the least probability of a named family."""

    def __init__(self, seed: int = 3, each: int = 24, rounds: int = 120):
        rng = np.random.default_rng(seed)
        texts, y = variants(rng, each)
        held = np.arange(len(y)) % 2 == 1
        bucket, row, n = features(texts)
        scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(texts)), 1))
        used, col = np.unique(bucket, return_inverse=True)
        k = len(FAMILIES)
        weight, bias, g_w, g_b = np.zeros((len(used), k)), np.zeros(k), 1e-8, 1e-8
        train = np.flatnonzero(~held)
        mine = ~held[row]
        r, c, v = row[mine], col[mine], scale[row[mine]]
        target = np.eye(k)[y]
        g_w = np.full(weight.shape, 1e-8)
        g_b = np.full(k, 1e-8)
        for _ in range(rounds):
            z = np.zeros((len(y), k))
            np.add.at(z, r, weight[c] * v[:, None])
            z = z[train] + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = np.zeros((len(y), k))
            g[train] = (p - target[train]) / len(train)
            dw = 1e-5 * weight
            np.add.at(dw, c, g[r] * v[:, None])
            db = g.sum(0)
            g_w += dw * dw
            g_b += db * db
            weight -= 0.5 * dw / np.sqrt(g_w)
            bias -= 0.5 * db / np.sqrt(g_b)
        self.weight = np.zeros((BUCKETS, k), np.float32)
        self.weight[used] = weight
        self.bias = bias.astype(np.float32)
        z = self.logits(texts)[held]
        own = y[held]
        self.temperature = min((float(t) for t in np.geomspace(0.05, 5, 40)), key=lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(own)), own], 1e-12)).mean())
        p = softmax(z / self.temperature)
        best = p.argmax(1)
        named = best > 0
        order = np.argsort(-p.max(1) * named)
        right = (best == own)[order][:named.sum()]
        share = np.cumsum(right) / np.arange(1, len(right) + 1)
        enough = np.flatnonzero(share >= PRECISION)
        self.least = float(max(0.5, p.max(1)[order][enough[-1]])) if len(enough) else 1.0
        self.templates = {f: [grams3(t) for t in [*ts, *TITLES[f]]] for f, ts in TEMPLATES.items()}

    def logits(self, paragraphs: list[bytes]) -> np.ndarray:
        bucket, row, _ = features(paragraphs)
        order = np.argsort(row, kind="stable")
        count = np.bincount(row, minlength=len(paragraphs))
        z = np.tile(self.bias, (len(paragraphs), 1)).astype(np.float64)
        has = np.flatnonzero(count)
        if len(has):
            z[has] += np.add.reduceat(self.weight[bucket[order]], (np.cumsum(count) - count)[has]) / np.sqrt(count[has])[:, None]
        return z

    def named(self, paragraphs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(family index, probability); index 0 where the paragraph is unknown."""
        p = softmax(self.logits(paragraphs) / self.temperature)
        best = p.argmax(1)
        top = p[np.arange(len(best)), best]
        return np.where(top >= self.least, best, 0), top

    def resemblance(self, family: str, paragraph: bytes) -> float:
        """Share of 3-grams; 1 for a paragraph of one or two words in which a template of as many words or fewer stands whole."""
        text = paragraph.decode("utf-8", "surrogatepass")
        own = grams3(text)
        if own and len(next(iter(own))) < 3:
            words = WORD.findall(text)
            runs = {tuple(words[i:j]) for j in range(1, len(words) + 1) for i in range(j)}
            return float(any(t <= runs for t in self.templates[family]))
        return max((len(own & t) / min(len(own), len(t)) for t in self.templates[family] if own and t), default=0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def grams3(text: str) -> set[tuple[str, ...]]:
    words = WORD.findall(text.lower())
    return {tuple(words[i:i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def scan_texts(model: LicenseModel, texts: list[str]) -> list[list[dict]]:
    """Licence paragraphs of each text: paragraph number, character offset, family, probability, resemblance, confirmed."""
    out: list[list[dict]] = [[] for _ in texts]
    lines, where = [], []
    for i, t in enumerate(texts):
        own = t.split("\n")
        lines += own
        where += [(i, n) for n in range(len(own))]
    low = [normal(x) for x in lines]
    family, top = model.named(low)
    for j in np.flatnonzero(family):
        i, n = where[j]
        name = FAMILIES[family[j]]
        like = model.resemblance(name, low[j])
        start = sum(len(x) + 1 for x in lines[j - n:j])
        out[i].append({"paragraph": n, "start": start, "family": name, "probability": float(top[j]), "resemblance": like, "confirmed": like >= CONFIRM})
    return out


def scan_documents(docs: DataFrame, model: LicenseModel | None = None, text: str = "text") -> DataFrame:
    """doc_id, n_paragraphs and ``licenses`` (paragraph, start, family, probability, resemblance, confirmed).

    Null and empty texts have one empty paragraph, which is unknown. The model is fitted on the driver from the
    templates alone, so it does not depend on the input. A narrow pass in bounded slices."""
    model = model or LicenseModel()
    shared = share(docs.sparkSession, model)  # BUCKETS x families floats

    def run(batches) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("paragraph", pa.int64()), ("start", pa.int64()), ("family", pa.string()), ("probability", pa.float64()),
                                   ("resemblance", pa.float64()), ("confirmed", pa.bool_())]))
        for b in slices(batches, text, 1 << 20):
            texts = texts_of(b, text)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([t.count("\n") + 1 for t in texts], pa.int64()),
                                              pa.array(scan_texts(shared(), texts), kind)], names=["doc_id", "n_paragraphs", "licenses"])

    return (docs.selectExpr("cast(doc_id as bigint) AS doc_id", f"`{text}`")
            .mapInArrow(lean(run), "doc_id bigint, n_paragraphs bigint, licenses array<struct<paragraph: bigint, start: bigint, family: string, "
                             "probability: double, resemblance: double, confirmed: boolean>>"))
