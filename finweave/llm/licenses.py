"""Licence scan: a trained paragraph classifier, applied by column expressions only.

A paragraph is a run of lines that each hold a word of the vocabulary; other lines, blank ones and
empty comment lines end it.  So a notice that is wrapped over lines or stands in a comment block is
one paragraph, and prose around it is none of it.  Features are the vocabulary words of a paragraph
and their pairs with a neighbour.  A lasso logistic regression for each family, fitted on the driver
on the texts below, on parts and shortened forms of them, and on paragraphs of no or of another
licence, keeps few of them.

A paragraph is of unknown class unless its family's probability reaches a limit that is calibrated on
held-out paragraphs of other licences and of none.  A prediction is confirmed if a template of the
family shares ``CONFIRM`` of its n-grams with the paragraph, and of those n-grams that no other family
and no other licence has as well; a template without such n-grams must share ``CONFIRM_COMMON``.

No paragraph is known whose document lacks all of the gate's words: the gate is built from the
weights so that the features without these words together cannot reach the limit in any family.  So
clean text costs one scan, and the gate changes no result.

Edge cases: null and empty texts have no paragraphs; repeated rows are judged alike; a document of
any length is judged whole; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finweave.llm.common import clean_text
from finweave.llm.quality import lasso_logistic
from finweave.llm.trees import sigmoid


def _gnu(name: str, short: str, version: str, thing: str) -> tuple[str, ...]:
    """The notice that the GNU licences ask for, and short forms."""
    return (
        f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
        f"This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.",
        f"You should have received a copy of the GNU {name} along with this {thing}. If not, see https://www.gnu.org/licenses/.",
        f"GNU {name.upper()} Version {version}", f"This work is licensed under the GNU {name}, version {version}.", f"Licensed under the {short} v{version}.", f"Released under the GNU {short} license.", f"{short} licensed", f"{short}v{version}", f"{short} {version}", f"SPDX-License-Identifier: {short}-{version}.0-or-later",
    )


def _commons(name: str, code: str) -> tuple[str, ...]:
    return (
        f"This work is licensed under a Creative Commons {name} 4.0 International License.", f"To view a copy of this license, visit http://creativecommons.org/licenses/{code.lower()}/4.0/",
        f"Licensed under CC {code} 4.0.", f"Released under CC {code}.", f"Creative Commons {name} license", f"SPDX-License-Identifier: CC-{code}-4.0",
    )


#: Public licence texts by paragraph, the notices that they ask for, and the short forms that projects use.
NOTICES: dict[str, tuple[str, ...]] = {
    "agpl": (*_gnu("Affero General Public License", "AGPL", "3", "program"), "GNU AGPL"),
    "apache": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004", "Released under the Apache 2.0 license.", "Apache 2.0 licensed", "Apache-2.0", "Apache 2 license", "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
        "Released under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License.", "This is distributed under the BSD license.", "BSD licensed", "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": _commons("Attribution", "BY"),
    "cc-by-nc": (*_commons("Attribution-NonCommercial", "BY-NC"), "Released under CC BY-NC, no commercial use."),
    "cc-by-nd": _commons("Attribution-NoDerivatives", "BY-ND"),
    "cc-by-sa": _commons("Attribution-ShareAlike", "BY-SA"),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released into the public domain under CC0 1.0 Universal.",
        "This work is marked with CC0 1.0.", "CC0", "CC0 1.0 Universal Public Domain Dedication", "SPDX-License-Identifier: CC0-1.0",
    ),
    "gpl": (*_gnu("General Public License", "GPL", "3", "program"), "This work is licensed under the GNU General Public License, version 2.", "Licensed under the GPL v2.", "GPL 2"),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
        "Released under the ISC License.", "Licensed under the ISC license.", "ISC licensed", "SPDX-License-Identifier: ISC",
    ),
    "lgpl": (*_gnu("Lesser General Public License", "LGPL", "3", "library"), "Licensed under the GNU LGPL version 2.1 or later.", "Licensed under the LGPL v2.1.", "LGPL 2.1"),
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        "Released under the MIT License.", "Licensed under the MIT license.", "The MIT License (MIT)", "MIT licensed", "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.", "Released under the MPL 2.0 license.", "MPL 2.0 licensed", "Mozilla Public License", "SPDX-License-Identifier: MPL-2.0",
    ),
    "proprietary": ("All rights reserved.", "Copyright Example Company. All rights reserved.", "All rights reserved. No part of this publication may be reproduced without permission.", "Unauthorized copying of this file is strictly prohibited. Proprietary and confidential."),
}
#: Notices of licences that are no family here; the classifier must leave them unknown.
OTHER_LICENCES = (
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "Licensed under the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0",
    "Licensed under the EUPL, Version 1.2 or, as soon they will be approved by the European Commission, subsequent versions of the EUPL", "European Union Public Licence", "You may not use this work except in compliance with the Licence. You may obtain a copy of the Licence at https://joinup.ec.europa.eu",
    "This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "The Unlicense",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "Released under the zlib license",
    "Distributed under the Boost Software License, Version 1.0.", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    "This library is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.", "This Font Software is licensed under the SIL Open Font License, Version 1.1.", "Common Development and Distribution License 1.0", "Licensed under the Microsoft Public License", "Licensed under the Python Software Foundation License",
    "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "Licensed under the Open Database License", "Business Source License 1.1", "Server Side Public License", "Academic Free License version 3.0", "LaTeX Project Public License", "GNU Free Documentation License", "Common Public Attribution License Version 1.0", "This work is in the public domain.", "DO WHAT YOU WANT TO PUBLIC LICENSE",
)
#: Sentences with the same words that are no notice.
OTHERS = (
    "He got his driving license last year.", "A new version of the work was released in January.", "The general public may use the source of water.", "She has permission to copy the form.",
    "The license of the restaurant was taken.", "Commercial use of the common land is old.", "The free fee was granted to any person.", "All of the terms are subject to the law.",
    "The creative work of the company is public.", "The foundation of the house is of apache stone.", "Copyright law is a field of law.", "In version two the clause was lesser.", "The binary star is in the domain of the universal public.",
    "Under the license act a person may obtain a permit.", "A copy of the software was released.", "They reserved all seats on the right.", "The publication of the source is without purpose.", "No license is needed to fish here.",
    "She studied at MIT before she went on to publish software.", "The Apache server ran on an old machine.", "The mozilla browser and the BSD kernel were compared in a paper.", "The rights of the author were discussed at length.", "The damages in this case were consequential.",
)
#: Frequent words that are no features alone; in pairs with a word of the vocabulary they count.
STOP = frozenset("a along also an and any are as at be been but by c can do even every file for form forms from had has have he her his how if in is it its kind later list may met more most my name names no not of on one only or other our out part parts program project s see she should so such than that the their them there these they thing things this those to under up upon use used v version view visit was way we were what when which who will with without work you your".split())
TOKEN = re.compile(r"[a-z]+|[0-9]+")
#: Shares that a template and a paragraph must have in common.
CONFIRM, CONFIRM_COMMON = 0.5, 0.8
#: Weight of the lasso: larger keeps fewer features, so fewer words are in the gate.
STRENGTH = 2e-4
#: Variants of each notice that the classifier is fitted on.
VARIANTS = 6


def words_of(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def grams_of_words(words: list[str], vocabulary: frozenset[str]) -> set[str]:
    """Vocabulary words and the pairs of neighbours that hold one."""
    out = {w for w in words if w in vocabulary}
    return out | {f"{a} {b}" for a, b in zip(words, words[1:]) if a in vocabulary or b in vocabulary}


@dataclass(frozen=True)
class Template:
    """N-grams of a notice, and those that nothing but its family has."""

    grams: tuple[str, ...]
    own: tuple[str, ...]

    @property
    def least(self) -> float:
        """N-grams that a paragraph must share at least."""
        return (CONFIRM if self.own else CONFIRM_COMMON) * len(self.grams)


@dataclass(frozen=True)
class LicenseModel:
    families: tuple[str, ...]
    vocabulary: frozenset[str]
    features: tuple[str, ...]
    weights: np.ndarray  # (features, families)
    intercepts: np.ndarray
    limit: float
    templates: dict[str, tuple[Template, ...]]

    def probabilities(self, text: str) -> np.ndarray:
        found = grams_of_words(words_of(text), self.vocabulary)
        x = np.array([f in found for f in self.features], dtype=float)
        return sigmoid(x @ self.weights + self.intercepts)

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Family or unknown, its probability, and whether a template confirms it."""
        p = self.probabilities(text)
        k = int(np.argmax(p))
        found = grams_of_words(words_of(text), self.vocabulary)
        confirmed = any(len(found.intersection(t.grams)) >= t.least and len(found.intersection(t.own)) >= CONFIRM * len(t.own) for t in self.templates[self.families[k]])
        known = p[k] >= self.limit
        return (self.families[k] if known else "unknown"), float(p[k]), bool(known and confirmed)


def variants(words: list[str], rng: np.random.Generator, n: int, own: frozenset[str] = frozenset()) -> list[list[str]]:
    """The words as they are, amid others, with some but their family's own left out, and a run of them as a wrapped line has."""
    out = [words, ["this", "project", "is", *words, "see", "file"]]
    for _ in range(n - len(out)):
        part = words
        if len(words) > 24 and rng.random() < 0.5:
            size = int(rng.integers(16, len(words)))
            at = int(rng.integers(0, len(words) - size + 1))
            part = words[at : at + size]
        out.append([w for w in part if w in own or rng.random() > 0.08])
    return out


def paragraphs_of_no_family(rng: np.random.Generator, own_words: dict[str, frozenset[str]]) -> list[list[str]]:
    """Other licences, sentences, loose words that several families share, single words of one family, and notices whose distinguishing words are others."""
    out = [v for t in OTHER_LICENCES for v in variants(words_of(t), rng, VARIANTS)]
    out += [v for t in OTHERS for v in variants(words_of(t), rng, 2)]
    pool = sorted({w for texts in NOTICES.values() for t in texts for w in words_of(t)} - frozenset().union(*own_words.values()))
    out += [list(rng.choice(pool, size=int(rng.integers(1, 4)))) for _ in range(240)]
    # A word of one family alone, as a name or in another language, is no notice.
    out += [[f"zq{rng.integers(100)}", w, f"zq{rng.integers(100)}"] for w in sorted(frozenset().union(*own_words.values())) for _ in range(2)]
    for family, texts in NOTICES.items():
        # Without its own words, a notice of a family that qualifies another one is one of that other.
        if any(family.startswith(f"{f}-") for f in NOTICES):
            continue
        for t in texts:
            words = words_of(t)
            if len(words) <= 24 and own_words[family].intersection(words):
                out += [[f"zq{rng.integers(100)}" if w in own_words[family] else w for w in words] for _ in range(2)]
    return out


def only_here(families: dict[str, list[set[str]]], others: list[set[str]]) -> dict[str, frozenset[str]]:
    """What the sets of one family have and those of no other family and of no other licence have."""
    held = Counter(x for sets in families.values() for x in set().union(*sets))
    elsewhere = set().union(*others)
    return {f: frozenset(x for x in set().union(*sets) if held[x] == 1 and x not in elsewhere) for f, sets in families.items()}


@lru_cache(maxsize=1)
def train() -> LicenseModel:
    rng = np.random.default_rng(11)
    families = tuple(NOTICES)
    notices = {f: [words_of(t) for t in texts] for f, texts in NOTICES.items()}
    other_words = [words_of(t) for t in (*OTHER_LICENCES, *OTHERS)]
    own_words = only_here({f: [set(w) for w in ws] for f, ws in notices.items()}, [set(words_of(t)) for t in OTHER_LICENCES])
    fitted = [(v, f) for f, ws in notices.items() for w in ws for v in variants(w, rng, VARIANTS, own_words[f])]
    no = paragraphs_of_no_family(rng, own_words)
    held_no = no[1::2]
    fitted += [(v, "") for v in no[::2]]
    vocabulary = frozenset(w for ws in notices.values() for words in ws for w in words if w.isalpha()) - STOP
    found = [grams_of_words(v, vocabulary) for v, _ in fitted]
    often = Counter(f for s in found for f in s)
    names = sorted(f for f, n in often.items() if n > 2)
    column = {f: i for i, f in enumerate(names)}
    a = np.zeros((len(found), len(names)))
    for i, s in enumerate(found):
        a[i, [column[f] for f in s if f in column]] = 1
    y = np.array([[f == family for family in families] for _, f in fitted], dtype=float)
    intercepts, weights = lasso_logistic(a, y, STRENGTH, 500)
    weights[np.abs(weights) < 1e-2] = 0
    kept = np.flatnonzero(np.abs(weights).sum(axis=1))
    grams = {f: [grams_of_words(w, vocabulary) for w in ws] for f, ws in notices.items()}
    own = only_here(grams, [grams_of_words(w, vocabulary) for w in other_words])
    templates = {f: tuple(Template(tuple(sorted(g)), tuple(sorted(g & own[f]))) for g in gs) for f, gs in grams.items()}
    model = LicenseModel(families, vocabulary, tuple(names[i] for i in kept), weights[kept], intercepts, 0.0, templates)
    # The unknown class: above what 99 of 100 held-out paragraphs of no family reach, an even chance at least.
    held = [model.probabilities(" ".join(v)).max() for v in held_no]
    return LicenseModel(families, vocabulary, model.features, model.weights, intercepts, max(0.5, float(np.quantile(held, 0.99))), templates)


def gate_words(model: LicenseModel) -> tuple[str, ...]:
    """Words without which no family can reach the limit, whatever else a paragraph has.

    Words are taken until the positive weights of the features without them are too few in every family.
    """
    need = np.log(model.limit / (1 - model.limit))
    gain = np.maximum(model.weights, 0)
    holds = [set(f.split()) & model.vocabulary for f in model.features]
    open_, words = np.ones(len(holds), bool), []
    while (excess := model.intercepts + gain[open_].sum(axis=0) - need).max() >= 0:
        by_word: dict[str, np.ndarray] = {}
        for i in np.flatnonzero(open_):
            for w in holds[i]:
                by_word[w] = by_word.get(w, 0) + gain[i]
        best = max(sorted(by_word), key=lambda w: np.minimum(by_word[w], np.maximum(excess, 0)).sum())
        words.append(best)
        open_ &= np.array([best not in h for h in holds])
    return tuple(sorted(words))


def _any_word(words) -> str:
    """A regular expression of any of the words, bordered by no letter as tokens are; words are tried by first letter."""
    tails: dict[str, list[str]] = {}
    for w in sorted(words):
        tails.setdefault(w[0], []).append(w[1:])
    groups = "|".join(f"{letter}(?:{'|'.join(rest)})" for letter, rest in tails.items())
    return rf"(?<![a-z])(?:{groups})(?![a-z])"


def paragraphs(text: Column, model: LicenseModel) -> Column:
    """Array of (line_no, paragraph): runs of lines that each hold a word of the vocabulary."""
    has_word = _any_word(model.vocabulary)
    lines = F.transform(F.split(text, "\n", -1), lambda line, i: F.when(F.rlike(F.lower(line), F.lit(has_word)), F.concat(i.cast("string"), F.lit("\u0001"), line)).otherwise(F.lit("")))
    runs = F.filter(F.split(F.array_join(lines, "\n"), "\n\n+"), lambda run: F.trim(run, F.lit("\n")) != "")
    first = lambda run: F.substring_index(F.ltrim(run, F.lit("\n")), "\u0001", 1).cast("int")
    return F.transform(runs, lambda run: F.struct(first(run).alias("line_no"), F.regexp_replace(F.trim(run, F.lit("\n")), "(^|\n)[0-9]+\u0001", "$1").alias("paragraph")))


def _folded(value, kind: str) -> Column:
    """A constant of the plan, read once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def judge(found: Column, model: LicenseModel) -> Column:
    """Adds family, probability and confirmed to an array of paragraphs.

    Each step is a transform of its own, so what it makes is computed once for a paragraph.
    """
    weights = _folded({f: [float(w) for w in row] for f, row in zip(model.features, model.weights)}, "map<string,array<double>>")
    start = _folded([float(b) for b in model.intercepts], "array<double>")
    names = _folded(list(model.families), "array<string>")
    templates = _folded([[{"grams": t.grams, "own": t.own, "least": t.least} for t in model.templates[f]] for f in model.families], "array<array<struct<grams:array<string>,own:array<string>,least:double>>>")
    vocabulary, features = (_folded(sorted(x), "array<string>") for x in (model.vocabulary, model.features))

    def grams(paragraph: Column) -> Column:
        words = F.regexp_extract_all(F.lower(paragraph), F.lit("([a-z]+|[0-9]+)"), 1)
        pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.array_union(F.array_intersect(words, vocabulary), F.filter(pairs, lambda p: p.isNotNull()))

    def best(g: Column) -> Column:
        # Set operations hash, a map's lookup does not: only n-grams that are features are looked up.
        odds = F.aggregate(F.array_intersect(g, features), start, lambda acc, f: F.zip_with(acc, F.element_at(weights, f), lambda x, w: x + w))
        places = F.zip_with(odds, F.sequence(F.lit(0), F.lit(len(model.families) - 1)), lambda z, k: F.struct(z.alias("z"), (-k).alias("k")))
        return F.array_max(places)

    def confirmed(g: Column, k: Column) -> Column:
        shared = lambda part: F.size(F.array_intersect(g, part))
        return F.exists(F.get(templates, k), lambda t: (shared(t["grams"]) >= t["least"]) & (shared(t["own"]) >= F.size(t["own"]) * CONFIRM))

    with_grams = F.transform(found, lambda p: F.struct(p["line_no"].alias("line_no"), p["paragraph"].alias("paragraph"), grams(p["paragraph"]).alias("grams")))
    scored = F.transform(with_grams, lambda p: F.struct(p["line_no"].alias("line_no"), p["paragraph"].alias("paragraph"), p["grams"].alias("grams"), best(p["grams"]).alias("best")))
    known = lambda p: F.lit(1.0) / (F.lit(1.0) + F.exp(-p["best"]["z"])) >= F.lit(model.limit)
    kept = F.filter(scored, known)
    out = lambda p: F.struct(p["line_no"].alias("line_no"), p["paragraph"].alias("paragraph"), F.get(names, -p["best"]["k"]).alias("family"), (F.lit(1.0) / (F.lit(1.0) + F.exp(-p["best"]["z"]))).alias("probability"), confirmed(p["grams"], -p["best"]["k"]).alias("confirmed"))
    return F.transform(kept, out)


def known_paragraphs(docs: DataFrame, gated: bool = True) -> DataFrame:
    """doc_id and ``found``, the array of judged paragraphs of known family; null where the gate ends it."""
    model = train()
    text = clean_text()
    passed = F.when(F.lower(text).rlike(_any_word(gate_words(model))), text) if gated else text
    # A generator keeps the projections apart; merged, the gate and the judgement would be written out, and
    # computed, wherever the next step reads them.
    rows = docs.select("doc_id", F.explode(F.array(passed)).alias("passed"))
    return rows.select("doc_id", F.explode(F.array(judge(paragraphs(F.col("passed"), model), model))).alias("found"))


def license_paragraphs(docs: DataFrame, gated: bool = True) -> DataFrame:
    """doc_id, line_no, paragraph, family, probability, confirmed of the paragraphs that the model knows."""
    return known_paragraphs(docs, gated).select("doc_id", F.explode("found").alias("p")).select("doc_id", "p.*")


def license_scan(docs: DataFrame, gated: bool = True) -> DataFrame:
    """doc_id, licenses (sorted families of confirmed paragraphs, by comma), n_paragraphs, n_unconfirmed for every row."""
    sure = F.filter("found", lambda p: p["confirmed"])
    rows = known_paragraphs(docs, gated).select("doc_id", F.coalesce(F.size("found"), F.lit(0)).alias("n"), F.transform(sure, lambda p: p["family"]).alias("families"))
    rows = rows.select("doc_id", F.greatest("n", F.lit(0)).alias("n"), F.coalesce("families", F.array().cast("array<string>")).alias("families"))
    return rows.select("doc_id", F.array_join(F.array_sort(F.array_distinct("families")), ",").alias("licenses"), F.size("families").alias("n_paragraphs"), (F.col("n") - F.size("families")).alias("n_unconfirmed"))
