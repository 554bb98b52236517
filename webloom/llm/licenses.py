"""License scans: TF-IDF cosine of texts to licence templates, and inheritance from the nearest ancestor folder."""

from __future__ import annotations

import math
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import slices, written
from webloom.llm.decontam import words

#: Notices by which texts declare a licence, by SPDX identifier.
NOTICES = (
    ("AGPL-3.0-only", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License."),
    ("BSD-2-Clause", "This software is released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "This software is released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, Creative Commons Attribution 4.0 International."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0-only", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LicenseRef-All-Rights-Reserved", "All rights reserved."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the "
        "Free Software Foundation, either version {1} of the License, or (at your option) any later version.")
_GNU_REST = (" This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
             "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should "
             "have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>.")
_APACHE_TAIL = ("you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                "http://www.apache.org/licenses/LICENSE-2.0")
#: Headers of several lines that licences ask for in source files: their first paragraph and the whole.
HEADERS = (
    ("Apache-2.0", f"Licensed under the Apache License, Version 2.0 (the \"License\"); {_APACHE_TAIL}"),
    ("Apache-2.0", f"Licensed under the Apache License, Version 2.0 (the \"License\"); {_APACHE_TAIL} Unless required by applicable "
                   "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                   "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
                   "language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *((spdx, _GNU.format(title, version) + rest)
      for spdx, title, version in (
          ("AGPL-3.0-or-later", "Affero General Public License", "3"), ("GPL-2.0-or-later", "General Public License", "2"),
          ("GPL-3.0-or-later", "General Public License", "3"), ("LGPL-2.1-or-later", "Lesser General Public License", "2.1"),
          ("LGPL-3.0-or-later", "Lesser General Public License", "3"))
      for rest in ("", _GNU_REST.format(title))),
)
TEXTS = os.path.join(os.path.dirname(__file__), "license_texts")


def license_texts(folder: str = TEXTS) -> tuple[tuple[str, str], ...]:
    """(SPDX identifier, full text) of the licences in ``folder``; that of the AGPL is the GPL's under its name."""
    out = []
    for name in sorted(os.listdir(folder)):
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            out.append((name.removesuffix(".txt"), f.read()))
    gpl = " ".join(dict(out).get("GPL-3.0-only", "").split())
    affero = gpl.replace("GNU General Public License", "GNU Affero General Public License").replace(
        "GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE").replace("GNU GPL", "GNU AGPL")
    return (*out, ("AGPL-3.0-only", affero))


FULL = license_texts()
TEMPLATES = NOTICES + HEADERS + FULL
#: Reserves rights, often beside a licence that grants some; counts only where nothing else is declared.
RESERVED = "LicenseRef-All-Rights-Reserved"
THRESHOLD = 0.85
#: Distinct words whose document counts a task gathers before it passes them on.
GATHER_WORDS = 1 << 18
#: How comment lines begin.
COMMENT = (b"#", b"//", b"*", b"/*", b"--", b";", b"%", b"<!--")
COPYRIGHT = (b"copyright", b"\xc2\xa9", b"(c)")
#: Names of files that license their folder and all below it.
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)(\.[a-z]+)?$"


class Matcher:
    """Cosines of word-count vectors to the templates; words weigh by their rarity among all documents.

    ``seen`` counts the documents of each template word. Where the counts of
    other words are not at hand they weigh 1, the least that a word can, which
    bounds the cosine from above.
    """

    def __init__(self, seen: dict[bytes, int], n_docs: int, templates: tuple = TEMPLATES, least: float = THRESHOLD):
        own = [(name, Counter(words(text.encode()))) for name, text in templates]
        self.index = {w: i for i, w in enumerate(sorted({w for _, c in own for w in c}))}
        self.known = frozenset(self.index)
        self.weight = np.array([math.log((1 + n_docs) / (1 + min(n_docs, seen.get(w, 0)))) + 1 for w in self.index])
        self.names = [name for name, _ in own]
        full = set(FULL)
        self.ranks = [0 if t in full else 2 if t[0] == RESERVED else 1 for t in templates]
        self.least = least
        unit = np.zeros((len(self.index), len(own)))
        for k, (_, c) in enumerate(own):
            for w, x in c.items():
                unit[self.index[w], k] = x * self.weight[self.index[w]]
        unit /= np.sqrt((unit ** 2).sum(0))
        self.parts = unit * self.weight[:, None]
        # a text's cosine is at most the norm of the template's part in its words: it needs a word of those that hold most
        self.needed: dict[bytes, int] = {}
        listed = list(self.index)
        for mass in (unit ** 2).T:
            order = np.argsort(-mass, kind="stable")
            total = np.cumsum(mass[order])
            enough = least ** 2 * (1 - 1e-9)
            fewest = int(np.searchsorted(total, enough)) + 1
            for i in order[:int(np.searchsorted(total, 1 - enough, "right")) + 1]:
                w = listed[i]
                self.needed[w] = min(self.needed.get(w, fewest), fewest)
        self.keys = frozenset(self.needed)

    def _dots(self, counts: dict[bytes, int]) -> tuple[np.ndarray, float]:
        """Products with the templates, and the square of the norm of the template words."""
        at = np.array([self.index[w] for w in counts], int)
        x = np.array(list(counts.values()), float)
        return x @ self.parts[at], float(((x * self.weight[at]) ** 2).sum())

    def possible(self, own: list[bytes], some: set[bytes]) -> bool:
        """Whether words ``own`` (``some`` are the distinct ones) may reach the least cosine, whatever other words weigh."""
        hits = self.keys & some
        if not hits:
            return False
        inside = self.known & some
        if len(inside) < min(self.needed[w] for w in hits):
            return False
        counts = Counter(own)
        dots, norm = self._dots({w: counts[w] for w in inside})
        outside = sum(x * x for w, x in counts.items() if w not in inside)
        return float(dots.max()) >= self.least * math.sqrt(norm + outside) * (1 - 1e-9)

    def best(self, own: list[bytes], norm: float) -> tuple[float, str, int] | None:
        """The best template of the least cosine or more, of equals the first by name, for words whose vector has the norm.

        The third value is 0 for a full licence text, 2 for a mere reservation of rights, and 1 for others.
        """
        counts = Counter(w for w in own if w in self.known)
        if not counts:
            return None
        dots, _ = self._dots(counts)
        cosine, name, rank = min((-min(1.0, round(float(d) / norm, 9)), n, r)
                                 for d, n, r in zip(dots, self.names, self.ranks, strict=True))
        return (-cosine, name, rank) if -cosine >= self.least else None


def template_words(templates: tuple = TEMPLATES) -> set[bytes]:
    return {w for _, text in templates for w in words(text.encode())}


def document_counts(files: DataFrame) -> DataFrame:
    """``(word, n)``: in how many of all files each word stands; the empty word counts the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                   names=["word", "n"])

        seen: Counter = Counter()
        for b in slices(batches):
            seen[b""] += b.num_rows
            for t in b.column(0).to_pylist():
                seen.update(set(words(t or b"")))
                if len(seen) >= GATHER_WORDS:
                    yield told()
                    seen.clear()
        yield told()

    return written(files.select(F.col("text").cast("binary")).mapInArrow(run, "word binary, n long").groupBy("word").agg(
        F.sum("n").alias("n")), "document-counts")


def segments(text: bytes) -> Iterator[tuple[list[bytes], set[bytes]]]:
    """Words, and distinct words, of what may declare a licence: every line, lines joined to headers, the whole text.

    Headers are paragraphs (runs of lines with words) and blocks of comment
    lines, each whole and without lines that begin with a copyright.
    """
    raw = text.split(b"\n")
    lines = [words(x) for x in raw]
    some = [set(x) for x in lines]
    for x, y in zip(lines, some, strict=True):
        if x:
            yield x, y
    if len(lines) == 1:
        return
    seen = set()
    for start, end in (*_runs([bool(x) for x in lines]), *_runs(_comments(raw)), (0, len(lines))):
        at = [i for i in range(start, end) if lines[i]]
        bare = [i for i in at if not raw[i].lstrip(b" \t#/*;%-<!").lower().startswith(COPYRIGHT)]
        for part in (at, bare):
            if len(part) > 1 and (key := (part[0], part[-1], len(part))) not in seen:
                seen.add(key)
                yield [w for i in part for w in lines[i]], set().union(*(some[i] for i in part))


def _runs(flags: list[bool]) -> list[tuple[int, int]]:
    """(start, end) of the runs of true flags."""
    out, start = [], None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        elif not f and start is not None:
            out.append((start, i))
            start = None
    return out


def _comments(raw: list[bytes]) -> list[bool]:
    """Which lines are comments, by how they begin or as they stand between ``/*`` or ``<!--`` and its end."""
    out, end = [], b""
    for x in raw:
        bare = x.strip()
        out.append(bool(end) or bare.startswith(COMMENT))
        if not end and bare.startswith((b"/*", b"<!--")):
            end = b"*/" if bare.startswith(b"/*") else b"-->"
        if end and end in bare:
            end = b""
    return out


def _candidates(files: DataFrame, matcher: Matcher) -> DataFrame:
    """``files`` with ``__bags``: the sorted words of each distinct segment that may reach the least cosine."""
    shared = files.sparkSession.sparkContext.broadcast(matcher)
    at = files.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            bags = [sorted({b" ".join(sorted(own)) for own, some in segments(t or b"") if m.possible(own, some)})
                    for t in b.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bags, pa.list_(pa.binary()))],
                                             names=[*b.schema.names, "__bags"])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema]
    return files.mapInArrow(run, ", ".join([*schema, "__bags array<binary>"]))


def _scores(bags: DataFrame, counts: DataFrame, n_docs: int, matcher: Matcher) -> DataFrame:
    """``(id, own, cosine, rank)`` of the ``bags(id, bag)`` that reach the least cosine, with the real weight of every word."""
    split = bags.select("id", F.explode(F.split(F.col("bag").cast("string"), " ")).alias("word"))
    used = split.groupBy("id", F.col("word").cast("binary").alias("word")).agg(F.count(F.lit(1)).alias("x"))
    weight = F.log(F.lit(1.0 + n_docs) / (1 + F.col("n"))) + 1
    norms = used.join(counts, "word").groupBy("id").agg(F.sqrt(F.sum(F.pow(F.col("x") * weight, 2))).alias("norm"))
    shared = bags.sparkSession.sparkContext.broadcast(matcher)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            found = [m.best(bag.split(), norm) for bag, norm in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), pa.array([f and f[1] for f in found], pa.string()),
                                   pa.array([f and f[0] for f in found], pa.float64()),
                                   pa.array([f and f[2] for f in found], pa.int32())], names=["id", "own", "cosine", "rank"])

    scored = bags.join(norms, "id").select("id", "bag", "norm")
    return written(scored.mapInArrow(run, "id string, own string, cosine double, rank int").filter("own is not null"), "scores")


def declared(files: DataFrame, least: float = THRESHOLD, templates: tuple = TEMPLATES) -> DataFrame:
    """``files`` with ``own`` (licence that the text declares, or null) and ``cosine``.

    Every line, header (see ``segments``) and whole text may declare a licence;
    the best cosine counts, of equals the first by name. A full licence text
    goes before the headers that it quotes, and any licence before a mere
    reservation of rights. Word weights follow
    the files that hold the word, of all words: their table is joined to the
    words of the segments that could match, each distinct one once. Only the
    counts of the template words are collected.
    """
    counts = document_counts(files)
    known = files.sparkSession.createDataFrame([(bytearray(w),) for w in sorted(template_words(templates) | {b""})], "word binary")
    seen = {bytes(r.word): r.n for r in counts.join(F.broadcast(known), "word").collect()}
    n_docs = seen.pop(b"", 0)
    matcher = Matcher(seen, n_docs, templates, least)
    kept = files.select(*(F.col(c) for c in files.columns if c not in ("own", "cosine")))
    rows = written(_candidates(kept, matcher).withColumn("__row", F.monotonically_increasing_id()), "license-candidates")
    bag = F.explode("__bags").alias("bag")
    bags = written(rows.select(bag).distinct().select(F.sha2("bag", 256).alias("id"), "bag"), "license-bags")
    scores = _scores(bags, counts, n_docs, matcher)
    best = rows.select("__row", bag).select("__row", F.sha2("bag", 256).alias("id")).join(scores, "id").groupBy("__row").agg(
        F.min(F.struct("rank", (-F.col("cosine")).alias("c"), "own")).alias("best"))
    best = best.select("__row", F.col("best.own").alias("own"), (-F.col("best.c")).alias("cosine"))
    return rows.drop("__bags").join(best, "__row", "left").drop("__row")


def _folder(path: Column) -> Column:
    """The folder of a path, the root being the empty string."""
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def _ancestors(folder: Column) -> Column:
    """A folder and all above it, up to the root."""
    parts = F.split(folder, "/", -1)
    return F.when(folder == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))))


def scan_licenses(files: DataFrame, least: float = THRESHOLD, templates: tuple = TEMPLATES) -> DataFrame:
    """``files(path, text, ...)`` with ``license``, ``origin``, ``cosine`` and ``license_folder``, for every row.

    A file that declares a licence (``origin`` declared) has that one. Others
    take that of the nearest folder above them with a licence file that declares
    one (inherited); of several such files in a folder the best cosine counts,
    then the first licence by name. All others have none. Folders are resolved
    once each, by joins of their ancestors' paths with the licensed folders,
    before files are joined with them.

    A null text is empty and declares nothing; a null path has no folder and
    inherits nothing. Repeated rows each give a row. An empty table gives none.
    Columns named like a result give way to it; names that begin with two
    underscores are taken.
    """
    taken = ("own", "cosine", "license", "origin", "license_folder")
    kept = [c for c in files.columns if c not in taken]
    found = declared(files.select(*kept), least, templates).withColumn("__folder", _folder(F.col("path")))
    licensed = found.filter(F.col("path").rlike(LICENSE_FILE) & F.col("own").isNotNull()).groupBy("__folder").agg(
        F.min(F.struct((-F.col("cosine")).alias("c"), "own")).alias("best")).select(
        F.col("__folder").alias("above"), F.col("best.own").alias("license"))
    folders = found.select("__folder").dropna().distinct()
    above = folders.select("__folder", F.explode(_ancestors(F.col("__folder"))).alias("above"))
    nearest = above.join(licensed, "above").groupBy("__folder").agg(
        F.max(F.struct(F.length("above").alias("depth"), "above", "license")).alias("__near"))
    rows = found.join(nearest, "__folder", "left")
    inherited = F.col("own").isNull() & F.col("__near").isNotNull()
    return rows.select(
        *kept, F.coalesce("own", "__near.license").alias("license"),
        F.when(F.col("own").isNotNull(), "declared").when(inherited, "inherited").otherwise("none").alias("origin"),
        "cosine", F.when(inherited, F.col("__near.above")).alias("license_folder"))
