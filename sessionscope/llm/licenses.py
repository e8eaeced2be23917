"""License scans by conditional compression.

Around each word about licensing, blocks of as many words as a template has are slid over
the text, so prose around a notice does not thin its saving.  White space of any kind
separates words, so notices may be wrapped over lines.  A block is compressed plainly
and with the template as raw zstandard dictionary; templates that save at least
``min_saving`` of the size in their best block are judged by their wording: from the first
to the last word that block and template share, the words that differ are listed, and at
most ``max_differences`` of the template's words may differ, none of them a number, a negation or a word
that names a license (``license_texts.NAMING``: "Lesser" is no small difference).  A negation among
the ``reach`` words before the notice, in the same clause, refuses it too, as does an operator behind an
SPDX tag, which then names a part of an expression.  A template is tried around a cue if all words of its
own that name a license stand within its length of the cue; without them nothing could be confirmed.
The clause that two BSD licenses share is reported under both; the third clause stands for itself.  Among
templates whose blocks overlap, confirmed ones win, then the one that shares the most words
less those that differ, then the larger saving, then the first by name; so notices that
stand beside each other are each reported.  ``line`` and ``word`` are those
of the block's first word; the words of ``block`` are joined by blanks; marks without a letter or digit are left out.

Null and empty texts have no block.  Notices that repeat are each reported.  Rows that repeat
are scanned as often as they occur.  An empty table gives no row.  Only doc_id and text
are read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionscope.llm.license_texts import NAMING, NEGATIONS, OPERATORS, TAG, TEMPLATES

CUE = r"(?i)\b(licen[sc]e[ds]?|licen[sc]ing|copyright|permission|redistribution|CC\s+BY)\b"
# For Spark, whose white space and word ends differ: passes at least every text with a cue.
ROUGH = r"(?iu)(licen[sc]|copyright|permission|redistribution|CC[^\p{L}\p{N}_])"
FOUND = (
    "doc_id long, line int, word int, license string, saving double, differences array<string>, "
    "confirmed boolean, block string"
)


@dataclass(frozen=True)
class Settings:
    min_saving: float = 0.3
    max_differences: float = 0.2
    reach: int = 3
    level: int = 9


class Scanner:
    """Finds the notices of a text: blocks under templates, confirmed by wording."""

    def __init__(self, templates: dict[str, str], settings: Settings):
        self.settings = settings
        self.plain = self._compressor(None)
        self.names = sorted(templates)
        self.with_template = [self._compressor(templates[n]) for n in self.names]
        self.words = [words_of(templates[n]) for n in self.names]
        self.lengths = [len(templates[n].split()) for n in self.names]
        self.naming = [[w for w in words if names_license(w)] for words in self.words]
        self.anchors = {w for words in self.naming for w in words}
        self.tags = [templates[n].startswith(TAG) for n in self.names]

    def _compressor(self, template: str | None) -> zstandard.ZstdCompressor:
        content = None
        if template is not None:
            content = zstandard.ZstdCompressionDict(template.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(
            level=self.settings.level, dict_data=content, write_content_size=False, write_dict_id=False
        )

    def scan(self, text: str) -> tuple[str, float, list[str], bool] | None:
        """License, saving, differences and verdict of the best notice, or None."""
        found = self._chosen([t for t, _ in tokens_of(text)], cues_of(text))
        return found[0][1:5] if found else None

    def notices(self, text: str) -> list[tuple[int, str, float, list[str], bool, str]]:
        """Place in the text of the first word, then license, saving, differences, verdict and block, in order."""
        tokens = tokens_of(text)
        words = [t for t, _ in tokens]
        found = self._chosen(words, cues_of(text, tokens))
        return [(tokens[low][1], *rest, " ".join(words[low:high])) for low, *rest, high in sorted(found, key=lambda f: f[0])]

    def _chosen(self, words: list[str], cues: list[int]) -> list[tuple[int, str, float, list[str], bool, int]]:
        """The winners, best first, with their first place and the place behind their last."""
        lower = [w.lower() for w in words]
        places = self._anchored(lower, cues)
        sizes = {}
        judged = []
        for i, length in enumerate(self.lengths):
            seen = {}
            for cue in cues:
                if not all(any(abs(p - cue) < length for p in places.get((cue, w), ())) for w in self.naming[i]):
                    continue
                best = None
                last = max(0, len(words) - length)
                for low in range(max(0, min(cue - length + 1, last)), min(cue, last) + 1):
                    if low not in seen:
                        data = " ".join(lower[low : low + length]).encode()
                        size = sizes.get((low, length)) or len(self.plain.compress(data))
                        sizes[low, length] = size
                        seen[low] = (size - len(self.with_template[i].compress(data))) / size
                    if best is None or seen[low] > seen[best]:
                        best = low
                if seen[best] >= self.settings.min_saving:
                    judged.append(self._judged(i, best, seen[best], words))
        taken = set()
        chosen = []
        for *_, low, high, found in sorted(judged, key=lambda j: j[:-1]):
            if taken.isdisjoint(range(low, high)):
                taken.update(range(low, high))
                chosen.append((low, *found, high))
        return chosen

    def _anchored(self, lower: list[str], cues: list[int]) -> dict[tuple[int, str], list[int]]:
        """By cue and word that names a license: its places as near as the longest template reaches."""
        far, known, places = max(self.lengths, default=0), {}, {}
        for cue in cues:
            for p in range(max(0, cue - far + 1), min(len(lower), cue + far)):
                if p not in known:
                    known[p] = self.anchors.intersection(words_of(lower[p]))
                for word in known[p]:
                    places.setdefault((cue, word), []).append(p)
        return places

    def _judged(self, i: int, low: int, saving: float, words: list[str]) -> tuple:
        """What candidates are sorted by, place, end, and the findings."""
        template = self.words[i]
        allowed = self.settings.max_differences * len(template)
        high = min(len(words), low + self.lengths[i])
        # Added words push a notice beyond the block; those allowed are looked at too.
        more = int(allowed)
        found = []
        for start, end in ((low, high), (max(0, low - more), min(len(words), high + more))):
            block = [(word, p) for p in range(start, end) for word in words_of(words[p])]
            changed, first = differences(template, [word for word, _ in block])
            found.append((changed, start if first is None else block[first][1]))
        changed, first = min(found, key=lambda f: len(f[0]))
        confirmed = len(changed) <= allowed and not any(decides(w[1:]) for w in changed)
        confirmed &= not negated(words[max(0, first - self.settings.reach) : first])
        confirmed &= not (self.tags[i] and words[high : high + 1] and words[high] in OPERATORS)
        shared = len(template) - sum(w.startswith("-") for w in changed)
        found = (self.names[i], saving, changed, confirmed)
        return (not confirmed, len(changed) - shared, -saving, self.names[i], low, high, found)


def words_of(text: str) -> list[str]:
    return re.findall(r"[\w.-]*\w", text.lower())


def names_license(word: str) -> bool:
    return not NAMING.isdisjoint(re.split(r"[-_.]", word))


def decides(word: str) -> bool:
    """Whether a notice with or without this word means something else."""
    return any(c.isdigit() for c in word) or word in NEGATIONS or names_license(word)


def negated(before: list[str]) -> bool:
    """Whether a negation stands among these words, with no mark behind it that ends the clause."""
    for word in reversed(before):
        if word[-1] in ".!?;:,":
            return False
        if word.lower().replace("\u2019", "'").strip("\"'()*_") in NEGATIONS:
            return True
    return False


def differences(template: list[str], block: list[str]) -> tuple[list[str], int | None]:
    """Template words missing (-) and block words added (+) where the two overlap; where that begins."""
    matcher = SequenceMatcher(None, template, block, autojunk=False)
    matches = [m for m in matcher.get_matching_blocks() if m.size]
    if not matches:
        return [f"-{w}" for w in template], None
    first, last = matches[0].b, matches[-1].b + matches[-1].size
    changed = []
    for tag, a0, a1, b0, b1 in matcher.get_opcodes():
        if tag != "equal":
            changed += [f"-{w}" for w in template[a0:a1]]
            changed += [f"+{w}" for w in block[max(b0, first) : min(b1, last)]]
    return changed, first


def tokens_of(text: str) -> list[tuple[str, int]]:
    """Stretches without white space that hold a letter or digit, and where they begin."""
    return [(m.group(), m.start()) for m in re.finditer(r"\S+", text) if re.search(r"\w", m.group())]


def cues_of(text: str, tokens: list[tuple[str, int]] | None = None) -> list[int]:
    """Numbers of the tokens with a word about licensing."""
    starts = [at for _, at in (tokens_of(text) if tokens is None else tokens)]
    return sorted({bisect_right(starts, m.start()) - 1 for m in re.finditer(CUE, text)})


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, settings: Settings = Settings()) -> DataFrame:
    """One row per candidate block with a winner, see ``FOUND``; ``confirmed`` is the verdict."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner, names = Scanner(templates, settings), [field.split()[0] for field in FOUND.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].array, batch["text"]):
                number = word = before = 0
                for at, *found in scanner.notices(text):
                    # On from the notice before, so that a long line is counted once.
                    start = text.rfind("\n", before, at) + 1
                    number += text.count("\n", before, at)
                    word = len(text[start:at].split()) if start else word + len(text[before:at].split())
                    before = at
                    rows.append((None if pd.isna(doc_id) else int(doc_id), number, word, *found))
            frame = pd.DataFrame(rows, columns=names)
            yield frame.astype({"doc_id": "Int64"})

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return texts.where(F.col("text").rlike(ROUGH)).mapInPandas(scan, FOUND)
