"""Evaluation passages inside a corpus.

One Aho-Corasick automaton holds every run of three words of the test items
(stock sentences aside), with all items that have it; a text is scanned once, without blanks, marks and case, so that layout
and lost spaces do not matter. Texts with hits are compared with the items they
hit, word by word, and hits are mapped back to offsets of the original text.

The test set is given and small: its patterns are broadcast, and
``MAX_ITEM_CHARS`` bounds those of an automaton. More patterns make more
automata; what the items share is worked out once over all of them.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from genoquery.session import ship

MAX_ITEM_CHARS = 8_000_000  # of the patterns of one automaton; the results do not depend on it
MAX_SET_CHARS = 200_000_000  # of the whole test set, which every worker holds; a larger one is refused
GRAM = 3
LEAK_SHARE = 0.42
# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("аерсохуікмтвнԁѕјһԛԝαοερικντυνχ", "aepcoxyikmtbhdsjhqwaoepikvtuvx", strict=True)) | {"ı": "i", "ł": "l", "ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "ς": "σ"}
_FOLD = str.maketrans(LOOKALIKES)
_TAG = re.compile(r"<[/!?]?[a-z][^<>]*>|&#?\w{1,8};")
# a word is a run of letters and digits; in scripts that are written without blanks (kana, Han) each sign is one
_WORD = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff]|[^\W_\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff]+")
_DROP = {i: None for i in range(128) if not chr(i).isalnum()}
_NOT_ALNUM = re.compile(r"[\W_]+")
_LINE_HYPHEN = re.compile(r"(?<=[^\W\d_])-\n\s*(?=[^\W\d_])")


def _letters(text: str) -> str:
    """Lower case without accents, look-alikes as Latin letters."""
    t = text.lower()
    if t.isascii():
        return t
    return "".join(c for c in unicodedata.normalize("NFKD", t).translate(_FOLD) if not unicodedata.combining(c))


def fold(text: str) -> str:
    """Lower case letters without accents, look-alikes and tags."""
    t = _letters(text)
    return _TAG.sub("", t) if "<" in t or "&" in t else t


def squeeze(folded: str) -> str:
    """The letters and digits of a folded text, of any script."""
    return folded.translate(_DROP) if folded.isascii() else _NOT_ALNUM.sub("", folded)


def words_of(folded: str) -> list[str]:
    return _WORD.findall(_LINE_HYPHEN.sub("", folded))


def squeezed_with_offsets(text: str) -> tuple[str, list[int]]:
    """``squeeze(fold(text))`` and, for each of its characters, the offset in ``text`` it comes from."""
    out, at = [], []
    for i, c in enumerate(text):
        for x in _letters(c):
            out.append(x)
            at.append(i)
    t = "".join(out)
    skip = bytearray(len(t))
    for pattern in (_TAG, _NOT_ALNUM):
        for m in pattern.finditer(t):
            skip[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    return "".join(c for c, s in zip(out, skip) if not s), [i for i, s in zip(at, skip) if not s]


class Items:
    """The test items: their words by sentence, the runs with the items that have them, and the rare words.

    Items of equal words are one, under the first's id; ``same`` has the ids of all. A sentence that more than ``few`` items have
    is stock and does not count, unless more than half of an item would go that way.
    """

    def __init__(self, rows: list[tuple[int, str]]):
        self.sentences: dict[int, list[list[str]]] = {}
        self.same: dict[int, list[int]] = defaultdict(list)
        first: dict[tuple, int] = {}
        for item, text in rows:
            parts = [words_of(fold(s)) for s in re.split(r"(?<=[.?!])\s+", text or "")]
            parts = [p for p in parts if p]
            one = first.setdefault(tuple(map(tuple, parts)), item)
            self.sentences[one] = parts
            self.same[one].append(item)
        self.words_in = Counter(w for ss in self.sentences.values() for w in {w for s in ss for w in s})
        stock = Counter(tuple(s) for ss in self.sentences.values() for s in {tuple(s) for s in ss})
        few = max(2, len(rows) // 100)
        self.stock = {s for s, n in stock.items() if n > few}
        owners: dict[str, set[int]] = defaultdict(set)
        for item, ss in self.sentences.items():
            own = [s for s in ss if tuple(s) not in self.stock]
            self.sentences[item] = ss = own if sum(map(len, own)) * 2 >= sum(map(len, ss)) else ss
            for s in ss:
                for k in range(max(1, len(s) - GRAM + 1)):
                    owners["".join(s[k : k + GRAM])].add(item)
        usable = {p for p in owners if len(p) >= 6 or (len(p) >= 3 and not p.isascii())}
        # an item without any usable run goes by all of its runs, which then have to be whole words of the text
        self.whole_words = {item for item, ss in self.sentences.items() if ss and not any(p in usable for p in self._runs(ss))}
        self.patterns = {p: sorted(o) for p, o in owners.items() if p in usable or o & self.whole_words}
        self.words = {item: {w for s in ss for w in s} for item, ss in self.sentences.items()}
        self.short: dict[int, set[str]] = defaultdict(set)  # runs too short for a pattern
        for p, o in owners.items():
            if p not in self.patterns:
                for item in o:
                    self.short[item].add(p)
        self.few = few
        # fewer runs than this cannot cover the share of the item that makes a leak
        self.least = {}
        for item, ss in self.sentences.items():
            runs = Counter(self._runs(ss))
            if runs:
                self.least[item] = max(1, -int(-LEAK_SHARE * sum(map(len, ss)) // (GRAM * max(runs.values()))) - len(self.short.get(item, ())))

    @staticmethod
    def _runs(sentences: list[list[str]]) -> list[str]:
        return ["".join(s[k : k + GRAM]) for s in sentences for k in range(max(1, len(s) - GRAM + 1))]

    def share(self, item: int, runs: set[str], seen: set[str]) -> float:
        """The share of the item's words, stock sentences aside, that the text reproduces.

        ``runs`` has the text's word runs, ``seen`` its words. A sentence counts by the words its runs cover, and only
        where at least half of its rare words (codes, numbers) are there as well: else it is another of the same build.
        """
        total = got = 0
        for s in self.sentences[item]:
            total += len(s)
            rare = [w for w in s if self.words_in[w] <= self.few or w.isdigit()]
            if rare and sum(w in seen for w in rare) * 2 < len(rare):
                continue
            covered = bytearray(len(s))
            for k in range(max(1, len(s) - GRAM + 1)):
                if "".join(s[k : k + GRAM]) in runs:
                    covered[k : k + GRAM] = b"\1" * len(s[k : k + GRAM])
            got += sum(covered)
        return got / total if total else 0.0


def automaton(patterns: dict[str, list[int]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for p, owners in patterns.items():
        a.add_word(p, (owners, p))
    a.make_automaton()
    return a


def blocks(patterns: dict[str, list[int]], limit: int) -> list[dict[str, list[int]]]:
    """The patterns in parts of at most ``limit`` characters; a longer one is a part of its own."""
    out: list[dict[str, list[int]]] = []
    size = 0
    for p, owners in patterns.items():
        if not out or size + len(p) > limit:
            out.append({})
            size = 0
        out[-1][p] = owners
        size += len(p)
    return out


_ready: dict[str, tuple] = {}


def _prepared(key: str, rows: list[tuple[int, str]], limit: int) -> tuple:
    """The items and their automata, made once per worker."""
    if key not in _ready:
        _ready.clear()
        k = Items(rows)
        _ready[key] = k, [automaton(b) for b in blocks(k.patterns, limit)]
    return _ready[key]


def stretch(ends: dict[str, list[int]], reach: int) -> tuple[int, int]:
    """First and last character of the stretches that hold the runs: places more than ``reach`` apart are stretches of their own,
    and one that adds no run to those with more is another use of the same words."""
    places = sorted((e - len(p) + 1, e, p) for p, es in ends.items() for e in es)
    groups: list[list[tuple]] = []
    for x in places:
        if not groups or x[0] - groups[-1][-1][1] > reach:
            groups.append([])
        groups[-1].append(x)
    seen: set[str] = set()
    kept = []
    for g in sorted(groups, key=lambda g: (-len({p for _, _, p in g}), g[0])):
        own = {p for _, _, p in g}
        if own - seen:
            seen |= own
            kept += g
    return min(x[0] for x in kept), max(x[1] for x in kept)


def find(docs: DataFrame, items: list[tuple[int, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, share, first_char, last_char`` of each text that reproduces enough of an item.

    The offsets are of the original text, from 0, of the first and last run that the automaton met in it, of those that the
    item alone has where there are any. Items may have any length and script; one of so few letters that no run of it has
    six (three beyond ASCII) has to stand there in whole words. Null and empty texts and items give
    no row; copies of a text, and of an item, give the same rows under their own ids; other columns are not read.
    """
    items = [(i, t) for i, t in items if i is not None and t]
    if sum(len(t) for _, t in items) > MAX_SET_CHARS:
        raise ValueError(f"the test set has more than {MAX_SET_CHARS} characters")
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(items)
    limit = MAX_ITEM_CHARS
    key = hashlib.md5(repr((limit, items)).encode()).hexdigest()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, machines = _prepared(key, shared.value, limit)
        for batch in batches:
            out = []
            for doc, text in zip(batch[id_col], batch[text_col]):
                if not isinstance(text, str) or not text:
                    continue
                folded = fold(text)
                squeezed = squeeze(folded)
                met: dict[str, list[int]] = defaultdict(list)
                hits: dict[int, set[str]] = defaultdict(set)
                for machine in machines:
                    for end, (owners, p) in machine.iter(squeezed):
                        ends = met[p]
                        if not ends:
                            for item in owners:
                                hits[item].add(p)
                        ends.append(end)
                offsets = spaced = None
                for item, ps in hits.items():
                    if len(ps) < k.least[item]:
                        continue
                    # runs are looked up without blanks, so words that lost their blank still count
                    runs = ps | {r for r in k.short[item] if r in squeezed}
                    if item in k.whole_words:
                        spaced = spaced or f" {' '.join(words_of(folded))} "
                        runs = {"".join(s[j : j + GRAM]) for s in k.sentences[item] for j in range(max(1, len(s) - GRAM + 1)) if f" {' '.join(s[j : j + GRAM])} " in spaced}
                    if k.share(item, runs, k.words[item]) < LEAK_SHARE:
                        continue  # not even with all of its words
                    seen = {w for w in k.words[item] if w in squeezed}
                    share = k.share(item, runs, seen)
                    if share >= LEAK_SHARE:
                        offsets = offsets or squeezed_with_offsets(text)[1]
                        alone = [p for p in ps if len(k.patterns[p]) == 1]
                        first, last = stretch({p: met[p] for p in alone or ps}, sum(len(w) for s in k.sentences[item] for w in s))
                        out.extend((doc, i, share, offsets[first], offsets[last]) for i in k.same[item])
            yield pd.DataFrame(out, columns=[id_col, "item_id", "share", "first_char", "last_char"])

    return docs.select(id_col, text_col).mapInPandas(scan, f"{id_col} long, item_id long, share double, first_char long, last_char long")
