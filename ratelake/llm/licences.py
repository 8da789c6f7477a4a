"""License scans by conditional compression.

Texts are cut into pieces at line and sentence ends. A piece that holds a license
cue gives candidate blocks: the piece alone, with a neighbour on either side, and
the whole run of cue pieces around it; for every template, the words around each cue
are a block too, so that a notice inside a sentence is found. Each block is compressed alone and with
every template as a raw zstandard dictionary; templates are ranked by the share of
the block's size that they save, which must pass a threshold. A winner is confirmed
by its exact wording differences: the words inserted, deleted or replaced against
the best-aligned part of the block, which must hold the license's naming words. Of overlapping blocks the closest wording
stays. Template texts and sizes are fixed, so nothing that grows leaves a task.

Offsets are code points, ends exclusive. Defined results: null and empty texts
have no blocks; equal rows give equal results; ties go to the first template; an
empty table gives an empty result; other columns are ignored. Pieces are joined up
to ``BLOCK_CHARS``; a single longer piece is still compared whole.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: license notices and grants (public wording)
TEMPLATES: dict[str, str] = {
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met:",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "Copyright. All rights reserved.",
    "BSD": "Released under the BSD License.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
}

# Words of a template that a notice must have: they tell it from other licenses.
NAMES: dict[str, set[str]] = {
    "GPL-3.0": {"general", "3"},
    "GPL-2.0": {"general", "2"},
    "LGPL-3.0": {"lesser", "3"},
    "AGPL-3.0": {"affero", "3"},
    "CC-BY-NC-4.0": {"by-nc", "4.0"},
    "CC-BY-4.0-short": {"by", "4.0"},
    "CC-BY-4.0": {"attribution", "4.0"},
    "CC-BY-SA-4.0": {"attribution-sharealike", "4.0"},
    "MIT": {"mit"},
    "BSD": {"bsd"},
    "Apache-2.0": {"apache"},
    "MPL-2.0": {"mozilla"},
}

CUES = ("licens", "licenc", "copyright", "hereby granted", "redistribut", "public domain", "all rights reserved", "spdx", "waived")
CUE = re.compile("|".join(map(re.escape, CUES)))
BLOCK_CHARS = 4096
LEAST_SAVING = 0.35  # share of the block's own compressed size that the template saves
MOST_DIFFERENT = 0.25  # share of the template's words that may differ
PIECE_END = re.compile(r"\n+|[.!?]\s+(?=[^\W\d_a-z])")
WORD = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")


Tools = tuple[zstandard.ZstdCompressor, dict[str, zstandard.ZstdCompressor]]


def compressors() -> Tools:
    """One compressor without a dictionary and one for each template; made once per task."""
    make = lambda t: zstandard.ZstdCompressor(
        level=19,
        dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT),
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )
    plain = zstandard.ZstdCompressor(level=19, write_content_size=False, write_checksum=False, write_dict_id=False)
    return plain, {name: make(t) for name, t in TEMPLATES.items()}


def has_cue(text: str) -> bool:
    low = text.lower()
    return any(c in low for c in CUES)


def blocks(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the candidate blocks."""
    if not text or not has_cue(text):
        return []
    ends = [m.end() for m in PIECE_END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    pieces = list(zip([0, *ends[:-1]], ends, strict=True))
    cued = [i for i, (a, b) in enumerate(pieces) if has_cue(text[a:b])]
    spans: set[tuple[int, int]] = set()
    run: list[int] = []
    for i in cued:
        if not run or i > run[-1] + 2:
            run = []
        run.append(i)
        for first, last in ((i, i), (i - 1, i), (i, i + 1), (i - 1, i + 1), (run[0], i)):
            first, last = max(first, 0), min(last, len(pieces) - 1)
            if first == last or pieces[last][1] - pieces[first][0] <= BLOCK_CHARS:
                spans.add((pieces[first][0], pieces[last][1]))
    return sorted(spans)


def savings(block: str, tools: Tools) -> list[tuple[float, str]]:
    """(share saved, template), best first."""
    plain, by_name = tools
    raw = block.encode()
    alone = len(plain.compress(raw))
    got = [(1 - len(c.compress(raw)) / alone, name) for name, c in by_name.items()]
    return sorted(got, key=lambda x: -x[0])


def saved_share(block: str, name: str, tools: Tools) -> float:
    """Share of the block's compressed size that one template saves."""
    plain, by_name = tools
    raw = block.encode()
    return 1 - len(by_name[name].compress(raw)) / len(plain.compress(raw))


def named(block: str, name: str) -> bool:
    """Whether the block has the words that tell the license from others."""
    return NAMES.get(name, set()) <= {m.group().lower() for m in WORD.finditer(block)}


def wording(block: str, template: str) -> tuple[int, int, int, list[str]]:
    """Start and end of the template's wording in the block, differing words, and the differences."""
    found = [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(block)]
    want = [m.group().lower() for m in WORD.finditer(template)]
    match = difflib.SequenceMatcher(None, want, [w for w, _, _ in found], autojunk=False)
    same = [b for b in match.get_matching_blocks() if b.size]
    if not same:
        return 0, 0, len(want), []
    first, last = same[0], same[-1]
    n, said = 0, []
    for tag, i1, i2, j1, j2 in match.get_opcodes():
        if tag == "equal" or (tag == "insert" and (j1 < first.b or j2 > last.b + last.size)):
            continue  # words of the block around the notice are not part of it
        if j1 >= last.b + last.size:  # at an end, only as many words as the template has there
            j2 = min(j2, j1 + i2 - i1)
        elif j2 <= first.b:
            j1 = max(j1, j2 - (i2 - i1))
        n += max(i2 - i1, j2 - j1)
        said.append(f"{' '.join(want[i1:i2])}>{' '.join(w for w, _, _ in found[j1:j2])}")
    return found[first.b][1], found[last.b + last.size - 1][2], n, said


def windows(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, template): the words around every cue that may hold the template's notice, sentence ends or not."""
    if not text or not has_cue(text):
        return []
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer: offsets hold for A-Z only
        low = "".join(c.lower() if c.isascii() else c for c in text)
    words = [(m.group(), m.start(), m.end()) for m in WORD.finditer(low)]
    ends = [e for _, _, e in words]
    at = sorted({bisect.bisect_right(ends, m.start()) for m in CUE.finditer(low)})
    out = set()
    for name, template in TEMPLATES.items():
        want = [m.group().lower() for m in WORD.finditer(template)]
        least = (1 - MOST_DIFFERENT) * len(set(want))
        for i in at:
            near = words[max(0, i - len(want)) : i + len(want) + 1]
            if near and len(set(want) & {w for w, _, _ in near}) >= least:
                out.add((near[0][1], near[-1][2], name))
    return sorted(out)


def find_notices(text: str | None, tools: Tools) -> list[tuple[int, int, str, float, int, str]]:
    """(start, end, license, saving, differing words, differences) of the confirmed notices."""
    found = []
    for a, b in blocks(text):
        for saving, name in savings(text[a:b], tools)[:3]:
            if saving < LEAST_SAVING:
                break
            s, e, n, said = wording(text[a:b], TEMPLATES[name])
            share = n / len(WORD.findall(TEMPLATES[name]))
            if share <= MOST_DIFFERENT and named(text[a + s : a + e], name):
                found.append((share, -saving, a + s, a + e, name, n, "; ".join(said)))
                break
    for a, b, name in windows(text):
        s, e, n, said = wording(text[a:b], TEMPLATES[name])
        share = n / len(WORD.findall(TEMPLATES[name]))
        if share <= MOST_DIFFERENT and named(text[a + s : a + e], name):
            saving = saved_share(text[a + s : a + e], name, tools)
            if saving >= LEAST_SAVING:
                found.append((share, -saving, a + s, a + e, name, n, "; ".join(said)))
    out: list[tuple[int, int, str, float, int, str]] = []
    for _, saving, a, b, name, n, said in sorted(found):
        if all(b <= x or y <= a for x, y, *_ in out):
            out.append((a, b, name, -saving, n, said))
    return sorted(out)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per confirmed notice: doc_id, start, end, license, saving, n_diffs, diffs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tools = compressors()
        for f in frames:
            rows = [(doc, *hit) for doc, t in zip(f["doc_id"], f["t"], strict=True) for hit in find_notices(t, tools)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "license", "saving", "n_diffs", "diffs"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("t")).mapInPandas(
        run, "doc_id long, start long, end long, license string, saving double, n_diffs int, diffs string"
    )
