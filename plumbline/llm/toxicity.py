"""Toxicity: a lexicon trie intersected with Levenshtein automata, and context windows.

The lexicon comes from labelled texts: terms and stems (a stem stands for all
words that begin with it) which toxic texts hold far more often than others.
Terms are put in a trie; each carries a Levenshtein automaton for one
edit.  Trie and automata are intersected into one deterministic automaton,
built state by state as words need it and run over all different words of a
chunk at once, so misspelled terms cost no more than right ones.

Each hit is weighed by a window of words around it: quotation marks and cues
of reporting lower it, cues of direct address and further hits raise it.
Cues are a few fixed words and, in any language, those that labelled texts
hold near hits in one class far more often than in the other.  A logistic
regression over the sums of exact, misspelled and stem hits turns them into a
probability.
"""

from __future__ import annotations

import math
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm._text import expand, hash_words, slices, string_bytes
from plumbline.llm.labelled import MAX_CHARS, MAX_ROWS, fit_sample, release
from plumbline.llm.quality import apply_scores

THRESHOLD = 0.3
#: Words to each side of a hit that make its context.
WINDOW = 8
#: Misspellings of terms from this length on are counted apart: few other words are so near to them.
LONG_TERM = 7
#: Letters that stand apart and are read as one word.
SPACED = 4
#: Texts of a class in which a learned cue stands near hits, and how many times its share in the other class it has there.
CUE_TEXTS, CUE_RATIO = 5, 6.0
#: How often a text holds a stem that tells of its class (chance makes such a word now and then), and of such texts the least number and share of all toxic ones.
STEM_TIMES, STEM_TEXTS, STEM_SHARE = 2, 2, 0.01
#: Weight of a misspelled term against a right one where the sample has no say.
MISSPELLED = 0.9
#: Weights towards which the fit is drawn: logs and presence of exact, misspelled, stem and long misspelled hits, rate, few words.
PRIOR = np.array([1.0, 0.3, 0.5, 1.0, 2.5, 0.8, 1.5, 2.5, 1.0, 0.0])

# Letters that stand for others in disguised words, and cues of context.
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
REPORTING = ["said", "says", "saying", "quote", "quoted", "quotes", "wrote", "writes", "word", "words", "term", "called", "calls", "phrase", "cited", "reported", "dictionary", "means", "meaning"]
ADDRESS = ["you", "your", "youre", "yours", "yourself", "u", "ur", "they", "them", "these", "all", "such"]

_OTHER, _DIGIT, _QUOTE = 27, 28, 29
CLASSES = 30
_ACCENTS = "AAAAAAACEEEEIIIIDNOOOOO OUUUUYTSaaaaaaaceeeeiiiidnooooo ouuuuyty"  # U+00C0 to U+00FF without marks


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Code of each byte (-1: separates words, 0: left out, 1-26: letters), and of bytes after 0xC3."""
    code = np.zeros(256, dtype=np.int8)
    code[[9, 10, 11, 12, 13, 32, *map(ord, ',;:!?()[]{}/\\|<>=+~^`#%')]] = -1
    for i in range(26):
        code[65 + i] = code[97 + i] = i + 1
    code[48:58] = _DIGIT
    for c, letter in DISGUISES.items():
        code[ord(c)] = ord(letter) - 96
    code[ord('"')] = _QUOTE
    code[0xC2:0xF5] = _OTHER  # one for each character; its further bytes are left out
    code[0xC3] = 0
    after = np.zeros(256, dtype=np.int8)
    for i, c in enumerate(_ACCENTS):
        after[0x80 + i] = ord(c.lower()) - 96 if c != " " else _OTHER
    return code, after


_CODE, _AFTER = _tables()


def coded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Folded letters of all words (without marks inside), word starts, ends and rows, and the number of quotation marks in its row before each word and in all.

    Folding drops case and the accents of Latin letters, reads disguise
    characters as letters and leaves out points, dashes and stars, so a word
    with such marks between its letters is one word; so are four or more
    letters in a row that stand apart.
    """
    code = _CODE[data]
    accent = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    code[accent] = _AFTER[data[accent]]
    # Low and high typographic quotes: E2 80 9C-9F, C2 AB, C2 BB.
    if len(data) > 2:
        q = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80) & (data[2:] >= 0x9C) & (data[2:] <= 0x9F))
        code[q] = _QUOTE
        q = np.flatnonzero((data[:-1] == 0xC2) & ((data[1:] == 0xAB) | (data[1:] == 0xBB)))
        code[q] = _QUOTE
    quote = code == _QUOTE
    separates = (code == -1) | quote
    letter = ~separates & (code > 0)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    # A word's number changes at each separator and row edge; words without letters vanish.
    piece = np.cumsum(separates | edge[:-1])
    at = np.flatnonzero(letter)
    first = np.flatnonzero(np.r_[True, piece[at][1:] != piece[at][:-1]]) if len(at) else np.zeros(0, np.int64)
    rows = np.searchsorted(offsets, at[first], side="right") - 1
    quotes = np.r_[0, np.cumsum(quote)]
    begin = quotes[offsets[rows]]
    ends = np.r_[first[1:], len(at)] if len(at) else first
    before, in_row = quotes[at[first]] - begin, quotes[offsets[rows + 1]] - begin
    # Letters that stand apart, SPACED of them or more, are one word.
    single = ends - first == 1
    follows = np.r_[False, single[1:] & single[:-1] & (rows[1:] == rows[:-1])] if len(first) else single
    head = np.flatnonzero(~follows)
    many = np.diff(np.r_[head, len(first)])
    apart = np.repeat(many >= SPACED, many)
    keep = ~(apart & follows)
    last = np.r_[np.flatnonzero(keep)[1:], len(first)] - 1 if len(first) else head
    return code[at].astype(np.uint8), first[keep], ends[last], rows[keep], before[keep], in_row[keep]


def fold(word: str) -> bytes:
    raw = np.frombuffer(word.encode(), np.uint8)
    return coded(raw, np.array([0, len(raw)]))[0].tobytes()


class Lexicon:
    """Trie of terms and stems, with the automaton of its words and their misspellings.

    A state of the automaton is a set of (trie node, edits) pairs; numbers are
    given in order of first use.  From `min_fuzzy` letters on, a term is also
    met with one letter wrong, missing, added or two neighbours exchanged;
    from `min_mild` on with a letter added or two exchanged: a letter wrong or
    missing makes other words of short ones.
    """

    NONE, EXACT, FUZZY, STEM, LONG_FUZZY = 0, 1, 2, 3, 4

    #: What was done to a term: nothing, an edit of longer terms, one of short terms too.
    RIGHT, EDITED, MILD = 0, 1, 2

    def __init__(self, terms: list[str], stems: list[str], min_fuzzy: int = 5, min_mild: int = 4, innocent: np.ndarray | None = None, cues: tuple[np.ndarray, np.ndarray] | None = None):
        #: Hashes of words that are a letter off a term but stand in harmless texts.
        self.innocent = np.zeros(0, np.uint64) if innocent is None else innocent
        #: Hashes of cues of reporting and of address.
        self.cues = _cue_hashes() if cues is None else cues
        self.terms, self.stems = sorted({fold(t) for t in terms} - {b""}), sorted({fold(s) for s in stems} - {b""})
        self.child: list[dict[int, int]] = [{}]
        self.term_at: list[bool] = [False]
        self.stem_at: list[bool] = [False]
        self.longest = [0]
        for words, ends in ((self.terms, self.term_at), (self.stems, self.stem_at)):
            for w in words:
                node, path = 0, [0]
                for c in w:
                    if c not in self.child[node]:
                        self.child[node][c] = len(self.child)
                        self.child.append({})
                        self.term_at.append(False)
                        self.stem_at.append(False)
                        self.longest.append(0)
                    node = self.child[node][c]
                    path.append(node)
                ends[node] = True
                if ends is self.term_at:
                    for p in path:
                        self.longest[p] = max(self.longest[p], len(w))
        self.depth = [0] * len(self.child)
        for node, kids in enumerate(self.child):
            for k in kids.values():
                self.depth[k] = self.depth[node] + 1
        self.min_fuzzy, self.min_mild = min_fuzzy, min_mild
        self.number: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.table = np.full((64, CLASSES), -1, dtype=np.int32)
        self.kind = np.zeros(64, dtype=np.int8)
        self.dead = self._state(frozenset())
        self.start = self._state(self._closed({(0, 0, -1)}))

    def _closed(self, items: set[tuple[int, int, int]]) -> frozenset:
        """Add what is reached by leaving out a letter of a term."""
        out = set(items)
        for node, edits, _ in items:
            if node >= 0 and edits == 0:
                out |= {(k, self.EDITED, -1) for k in self.child[node].values() if self.longest[k] >= self.min_fuzzy}
        return frozenset(out)

    def _state(self, items: frozenset) -> int:
        if items not in self.number:
            self.number[items] = n = len(self.states)
            self.states.append(items)
            if n >= len(self.kind):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
                self.kind = np.concatenate([self.kind, np.zeros_like(self.kind)])
            exact = any(node >= 0 and self.term_at[node] and e == 0 and m < 0 for node, e, m in items)
            near = any(node >= 0 and self.term_at[node] and e and m < 0 and self.depth[node] >= (self.min_mild if e == self.MILD else self.min_fuzzy) for node, e, m in items)
            stem = (-1, 0, -1) in items or any(node >= 0 and self.stem_at[node] and e == 0 and m < 0 for node, e, m in items)
            far = near and any(node >= 0 and self.term_at[node] and e and m < 0 and self.depth[node] >= LONG_TERM for node, e, m in items)
            self.kind[n] = self.EXACT if exact else self.STEM if stem else self.LONG_FUZZY if far else self.FUZZY if near else self.NONE
        return self.number[items]

    def _step(self, state: int, c: int) -> int:
        items: set[tuple[int, int, int]] = set()
        for node, edits, owed in self.states[state]:
            if node < 0:  # within a word that began with a stem
                items.add((-1, 0, -1))
                continue
            if owed >= 0:  # the second of two exchanged letters
                if c == owed:
                    items.add((node, self.MILD, -1))
                continue
            if edits == 0 and self.stem_at[node]:
                items.add((-1, 0, -1))
            kids = self.child[node]
            if c in kids:
                items.add((kids[c], edits, -1))
            if edits == 0 and self.longest[node] >= self.min_mild:
                items.add((node, self.MILD, -1))
                for letter, k in kids.items():
                    if letter != c and self.longest[k] >= self.min_fuzzy:
                        items.add((k, self.EDITED, -1))
                    if letter != c and c in self.child[k] and self.longest[k] >= self.min_mild:
                        items.add((self.child[k][c], self.MILD, letter))
        to = self._state(self._closed(items))
        self.table[state, c] = to
        return to

    def match(self, letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Kind of each word: NONE, EXACT, FUZZY or STEM."""
        state = np.full(len(starts), self.start, dtype=np.int64)
        alive = np.arange(len(starts))
        lens = ends - starts
        step = 0
        while len(alive):
            alive = alive[(lens[alive] > step) & (state[alive] != self.dead)]
            if not len(alive):
                break
            c = letters[starts[alive] + step]
            to = self.table[state[alive], c]
            if (to < 0).any():
                new = np.unique(state[alive][to < 0] * CLASSES + c[to < 0])
                for key in new.tolist():
                    self._step(*divmod(key, CLASSES))
                to = self.table[state[alive], c]
            state[alive] = to
            step += 1
        return self.kind[state]


class _Sample:
    """Folded words of labelled texts as arrays; equal texts count once, toxic if any copy is."""

    def __init__(self, sample: pa.Table):
        firsts: dict[bytes, int] = {}
        letters, starts, ends, rows, base = [], [], [], [], 0
        toxic: list[int] = []
        for batch in slices(sample.to_batches()):
            data, offsets = string_bytes(batch.column(batch.schema.get_field_index("text")))
            y = batch.column(batch.schema.get_field_index("y")).to_pylist()
            number = np.full(len(y), -1)
            raw = data.tobytes()
            for i, label in enumerate(y):
                key = sha256(raw[offsets[i] : offsets[i + 1]]).digest()
                if key in firsts:
                    toxic[firsts[key]] |= label
                else:
                    number[i] = firsts[key] = len(toxic)
                    toxic.append(label)
            w, s, e, r, *_ = coded(data, offsets)
            plain = np.r_[0, np.cumsum(w > 26)]
            keep = (number[r] >= 0) & (plain[e] == plain[s])
            letters.append(w)
            starts.append((s[keep] + base).astype(np.int32))
            ends.append((e[keep] + base).astype(np.int32))
            rows.append(number[r[keep]].astype(np.int32))
            base += len(w)
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.letters, self.starts, self.ends, self.rows = join(letters).astype(np.uint8), join(starts), join(ends), join(rows)
        self.lens, self.y = self.ends - self.starts, np.array(toxic, dtype=np.int64)
        self.words = hash_words(self.letters, self.starts, self.ends)
        same = np.r_[False, self.rows[1:] == self.rows[:-1]] if len(self.rows) else np.zeros(0, bool)
        self.before = np.where(same, np.roll(self.words, 1), np.uint64(0))

    def text(self, i: int, length: int | None = None) -> str:
        s = self.starts[i]
        return "".join(chr(96 + c) for c in self.letters[s : s + length if length else self.ends[i]])

    def table(self, keys: np.ndarray, at: np.ndarray, times: int = 1) -> dict[str, np.ndarray]:
        """Per different key of the words `at`: its first word, texts of either class that hold it `times` times or more, words before it and words in toxic texts."""
        uniq, first, group = np.unique(keys, return_index=True, return_inverse=True)
        group = group.astype(np.int32)
        pair, many = np.unique(group.astype(np.int64) * len(self.y) + self.rows[at], return_counts=True)
        pair = pair[many >= times]
        label = self.y[pair % len(self.y)]
        out = {"first": at[first], "group": group}
        out["toxic"], out["other"] = (np.bincount(pair[label == k] // len(self.y), minlength=len(uniq)) for k in (1, 0))
        bad = self.y[self.rows[at]] == 1
        for name, values in (("contexts", self.before), ("words", self.words)):
            order = np.lexsort((values[at][bad], group[bad]))
            g, v = group[bad][order], values[at][bad][order]
            new = np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])] if len(g) else np.zeros(0, bool)
            out[name] = np.bincount(g[new], minlength=len(uniq))
        return out


def learn_lexicon(sample: pa.Table, least: int = 4, ratio: float = 30.0) -> tuple[list[str], list[str]]:
    """Terms and stems whose share of toxic texts is `ratio` times that of the others.

    Equal texts count once, and a word needs at least `least` different words
    before it in toxic texts, so that copies of one text lend no weight.  A
    stem is the shortest beginning (4 to 8 letters) of many different words
    that holds to the same measure in texts with two such words or more,
    lengthened as far as nearly all of them agree; words that a stem covers
    are no terms.
    """
    w = _Sample(sample)
    n = [int((w.y == k).sum()) for k in (0, 1)]
    if not n[0] or not n[1]:
        return [], []

    def telling(t: dict[str, np.ndarray], least: int = least, more: float = 1.0) -> np.ndarray:
        seen = np.minimum(t["contexts"], t["toxic"])
        return (seen >= least) & (seen / n[1] >= ratio * (t["other"] + more) / n[0])

    long = np.flatnonzero(w.lens > 3).astype(np.int32)
    if not len(long):
        return [], []
    words = w.table(w.words[long], long)
    terms = {w.text(i) for i in words["first"][telling(words)]}
    common = np.zeros(len(w.lens), dtype=np.int64)
    common[long] = words["toxic"][words["group"]]
    stems: list[str] = []
    left = long[w.lens[long] > 4]
    for size in range(4, 9):
        at = left[w.lens[left] >= size]
        if not len(at):
            break
        t = w.table(hash_words(w.letters, w.starts[at], w.starts[at] + size), at, STEM_TIMES)
        most = np.zeros(len(t["first"]), dtype=np.int64)
        np.maximum.at(most, t["group"], common[at])
        # Met in more texts than its commonest word: else that word is the term.
        chosen = telling(t, max(STEM_TEXTS, math.ceil(STEM_SHARE * n[1])), 0.4) & (t["words"] >= least) & (t["toxic"] > most)
        for k in np.flatnonzero(chosen):
            head = w.text(t["first"][k], size)
            if head in terms:
                continue
            mine = at[t["group"] == k]
            for longer in range(size + 1, 9):
                fits = mine[w.lens[mine] >= longer]
                if not len(fits):
                    break
                u = w.table(hash_words(w.letters, w.starts[fits], w.starts[fits] + longer), fits, STEM_TIMES)
                best = int(u["toxic"].argmax())
                if u["toxic"][best] < 0.98 * t["toxic"][k] or u["words"][best] < 0.9 * t["words"][k]:
                    break
                head = w.text(u["first"][best], longer)
            stems.append(head)
        left = at[~chosen[t["group"]]]
    return sorted(x for x in terms if not any(x.startswith(s) for s in stems)), sorted(set(stems))


def hits(lexicon: Lexicon, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, kind and context weight of each hit, and the number of words of each row."""
    letters, starts, ends, rows, quotes, in_row = coded(data, offsets)
    n_rows = len(offsets) - 1
    words = np.bincount(rows, minlength=n_rows)
    if not len(starts):
        return rows, np.zeros(0, np.int8), np.zeros(0), words
    keys = hash_words(letters, starts, ends)
    uniq, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    kinds = lexicon.match(letters, starts[first], ends[first])
    kinds[np.isin(kinds, (Lexicon.FUZZY, Lexicon.LONG_FUZZY)) & np.isin(uniq, lexicon.innocent)] = Lexicon.NONE
    at = np.flatnonzero(kinds[inverse])
    kind = kinds[inverse[at]]
    reporting, address = lexicon.cues
    said, you, hit = (np.r_[0, np.cumsum(m[inverse])] for m in (np.isin(uniq, reporting), np.isin(uniq, address), kinds > 0))
    row_first, row_end, lo, hi = _windows(rows, at)
    # Quoted: an odd number of marks before it, and a mark within the window to each side.
    opened = quotes[at] - np.where(lo == row_first, 0, quotes[lo])
    closed = np.where(hi == row_end, in_row[at], quotes[hi - 1]) - quotes[at]
    quoted = (quotes[at] % 2 == 1) & (opened > 0) & (closed > 0)
    weight = np.where(quoted, 0.4, 1.0) * np.where(said[hi] > said[lo], np.where(quoted, 0.5, 0.8), 1.0)
    weight *= 1 + 0.2 * (you[hi] > you[lo]) + 0.1 * np.minimum(5, hit[hi] - hit[lo] - 1)
    return rows[at], kind, weight, words


def _windows(rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and end of the row of each word `at`, and of its window there."""
    row_first = np.searchsorted(rows, rows[at], side="left")
    row_end = np.searchsorted(rows, rows[at], side="right")
    return row_first, row_end, np.maximum(at - WINDOW, row_first), np.minimum(at + WINDOW + 1, row_end)


def learn_cues(lexicon: Lexicon, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of reporting and address cues: the fixed words, and words near hits that harmless or toxic texts hold far more often than the others."""
    near, labels = [[], []], [0, 0]
    for data, offsets, y in parts:
        letters, starts, ends, rows, *_ = coded(data, offsets)
        words = hash_words(letters, starts, ends)
        uniq, first, inverse = np.unique(words, return_index=True, return_inverse=True)
        hit = lexicon.match(letters, starts[first], ends[first])[inverse] > 0
        at = np.flatnonzero(hit)
        _, _, lo, hi = _windows(rows, at)
        around = expand(lo, hi - lo)
        around = around[~hit[around]]
        for k in (0, 1):
            labels[k] += int((y[np.unique(rows[at])] == k).sum())
            mine = around[y[rows[around]] == k]
            # Each word once for a text.
            order = np.lexsort((words[mine], rows[mine]))
            w, r = words[mine][order], rows[mine][order]
            new = np.r_[True, (w[1:] != w[:-1]) | (r[1:] != r[:-1])] if len(w) else np.zeros(0, bool)
            near[k].append(w[new])
    seen = [np.unique(np.concatenate(n) if n else np.zeros(0, np.uint64), return_counts=True) for n in near]
    out = []
    for k, fixed in enumerate(_cue_hashes()):
        word, many = seen[k]
        other = np.zeros(len(word))
        at = np.searchsorted(seen[1 - k][0], word)
        inside = at < len(seen[1 - k][0])
        there = np.flatnonzero(inside)[seen[1 - k][0][at[inside]] == word[inside]]
        other[there] = seen[1 - k][1][at[there]]
        share = (many + 0.5) / (labels[k] + 1) / ((other + 0.5) / (labels[1 - k] + 1))
        out.append(np.unique(np.r_[fixed, word[(many >= CUE_TEXTS) & (share >= CUE_RATIO)]]))
    # What tells of both tells of neither.
    both = np.intersect1d(*out)
    return np.setdiff1d(out[0], both), np.setdiff1d(out[1], both)


def _cue_hashes() -> tuple[np.ndarray, np.ndarray]:
    out = []
    for words in (REPORTING, ADDRESS):
        coded_words = [np.frombuffer(fold(w), np.uint8) for w in words]
        lens = np.array([len(c) for c in coded_words])
        ends = np.cumsum(lens)
        out.append(hash_words(np.concatenate(coded_words), ends - lens, ends))
    return out[0], out[1]


def near_words(lexicon: Lexicon, data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hashes of the words of chosen rows that are a letter off a term."""
    letters, starts, ends, row, *_ = coded(data, offsets)
    keep = rows[row] if len(row) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    uniq, first = np.unique(hash_words(letters, starts, ends), return_index=True)
    kinds = lexicon.match(letters, starts[first], ends[first])
    return uniq[np.isin(kinds, (Lexicon.FUZZY, Lexicon.LONG_FUZZY))]


def features(lexicon: Lexicon, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row: logs of the weighted exact, misspelled, stem and long misspelled hits, their presence, their rate per word, and if it has few words."""
    rows, kind, weight, words = hits(lexicon, data, offsets)
    n = len(offsets) - 1
    sums = np.stack([np.bincount(rows[kind == k], weights=weight[kind == k], minlength=n) for k in (1, 2, 3, 4)], axis=1)
    sums[:, 2] = np.maximum(0, sums[:, 2] - 1)  # one word with a stem is chance
    rate = sums.sum(axis=1, keepdims=True) / np.maximum(1, words)[:, None]
    return np.concatenate([np.log1p(sums), np.minimum(sums, 1), np.sqrt(rate), (words[:, None] < 10)], axis=1).astype(float)


def fit_weights(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, ridge: float = 0.5, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps, drawn to `prior` by a ridge; the last weight is the intercept."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    prior = prior if len(prior) == x.shape[1] else np.r_[prior, 0.0]
    w = prior.copy()
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * (w - prior))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """A lexicon with the weights that turn its hits into a probability.

    Words near a term that harmless texts of the sample hold are no
    misspellings.  What is left of these is weighed like the terms themselves
    (by MISSPELLED), as far as the sample doesn't speak against it: a sample
    may hold none.
    """

    def __init__(self, sample: pa.Table, shift: float):
        y = sample.column("y").to_numpy()
        self.terms, self.stems = learn_lexicon(sample)
        self.shift = shift
        parts = [(*string_bytes(b.column(b.schema.get_field_index("text"))), b.column(b.schema.get_field_index("y")).to_numpy()) for b in slices(sample.to_batches())]
        lexicon = Lexicon(self.terms, self.stems)
        self.innocent = np.unique(np.concatenate([near_words(lexicon, data, offsets, label == 0) for data, offsets, label in parts] or [lexicon.innocent]))
        lexicon.innocent = self.innocent
        self.cues = lexicon.cues = learn_cues(lexicon, parts)
        x = np.concatenate([features(lexicon, data, offsets) for data, offsets, _ in parts] or [np.zeros((0, len(PRIOR)))])
        first = fit_weights(x, y.astype(float))
        prior = first.copy()
        for exact, others in ((0, (1, 3)), (4, (5, 7))):  # logs, then presence
            for k in others:
                prior[k] = MISSPELLED * first[exact]
        self.weights = fit_weights(x, y.astype(float), prior)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_lexicon"}

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if "_lexicon" not in self.__dict__:
            self._lexicon = Lexicon(self.terms, self.stems, innocent=self.innocent, cues=self.cues)
        dot = features(self._lexicon, data, offsets) @ self.weights[:-1] + self.weights[-1] + self.shift
        return 1 / (1 + np.exp(-np.clip(dot, -35, 35)))


def score(docs: DataFrame, labels: DataFrame, target: str = "toxic", threshold: float = THRESHOLD, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, fit_docs: DataFrame | None = None, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """All columns of `docs` (or those in `keep`) with score (0 to 1) and predicted (1 where score >= threshold).

    A null text scores as an empty one; repeated rows score alike; an empty
    table gives an empty one.  Columns of the added names (`prefix` goes
    before them) in `docs` are replaced.  Without labels of both classes
    nothing is in the lexicon and the score is the labels' share of 1.
    """
    sample, shift = fit_sample(fit_docs if fit_docs is not None else docs, labels, target, max_rows, max_chars)
    model = docs.sparkSession.sparkContext.broadcast(Model(sample, shift))
    del sample
    release()
    return apply_scores(docs, lambda data, offsets: model.value.scores(data, offsets), threshold, keep, prefix)
